"""Aggregations over the driver's tables, which stand in for findings and runs, with the same results in SQL.

events stand for findings (event_type for severity), orders with lineitem for
files before and after, labels for reviews, conversations for run states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenestra.functions.measures import reduction
from fenestra.operators import reports
from fenestra.sources import tables

Q: dict[str, tuple] = {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = (f, sql)
        return f

    return add


SEVERITY = "CASE event_type WHEN 'view' THEN 'info' WHEN 'click' THEN 'warning' ELSE 'error' END"


def _severity():
    t = F.col("event_type")
    return F.when(t == "view", "info").when(t == "click", "warning").otherwise("error")


@query(f"""SELECT user_id, count(*) FILTER (s = 'error') AS issue_count, count(*) FILTER (s = 'error') AS error_count, count(*) FILTER (s = 'warning') AS warning_count,
  count(*) FILTER (s = 'info') AS info_count, count(*) AS total_issue_count FROM (SELECT user_id, {SEVERITY} AS s FROM events) GROUP BY user_id""")
def severity_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.level_report(tables.read(spark, d, "events"), _severity(), ["user_id"])


@query("""SELECT user_id, max(total)::BIGINT AS total, string_agg(event_type || ':' || n, ';' ORDER BY event_type) AS codes
  FROM (SELECT user_id, event_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY user_id) AS total FROM events GROUP BY user_id, event_type) GROUP BY user_id""")
def code_count_maps(spark: SparkSession, d: str) -> DataFrame:
    rows = reports.code_counts(tables.read(spark, d, "events"), ["user_id"], "event_type")
    text = F.array_join(F.transform(F.map_entries("codes"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ";")
    return rows.select("user_id", "total", text.alias("codes"))


@query("""SELECT count(*) AS findings, count(*) FILTER (s = 'error' AND coalesce(r, 'xml_safe') = 'xml_safe') AS actionable, count(*) FILTER (NOT (s = 'error' AND coalesce(r, 'xml_safe') = 'xml_safe')) AS deferred
  FROM (SELECT {0} AS s, CASE WHEN event_id % 3 = 0 THEN 'xml_safe' WHEN event_id % 3 = 1 THEN 'manual_review' END AS r FROM events)""".format(SEVERITY))
def repair_gate(spark: SparkSession, d: str) -> DataFrame:
    safe = F.when(F.col("event_id") % 3 == 0, "xml_safe").when(F.col("event_id") % 3 == 1, "manual_review")
    gate = reports.actionable(_severity(), safe)
    return tables.read(spark, d, "events").agg(F.count("*").alias("findings"), F.count_if(gate).alias("actionable"), F.count_if(~gate).alias("deferred"))


@query("""SELECT o_orderpriority, count(*) AS tasks, sum(b)::BIGINT AS before_total, sum(a)::BIGINT AS after_total, round((sum(b) - sum(a)) / nullif(sum(b), 0), 8) AS rate,
  round(avg(a), 8) AS mean_after, median(a)::DOUBLE AS median_after, count(*) FILTER (a = 0) AS zero_after
  FROM (SELECT o_orderkey, o_orderpriority, count(l_orderkey) AS b, count(*) FILTER (l_returnflag = 'R') AS a FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL) GROUP BY o_orderpriority""")
def condition_rates(spark: SparkSession, d: str) -> DataFrame:
    lines = tables.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("before"), F.count_if(F.col("l_returnflag") == "R").alias("after"))
    rows = tables.read(spark, d, "orders").select("o_orderkey", "o_orderpriority").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderpriority", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    out = reports.condition_summary(rows, ["o_orderpriority"], "before", "after")
    return out.withColumns({"rate": F.round("rate", 8), "mean_after": F.round("mean_after", 8), "median_after": F.col("median_after").cast("double")})


@query("""SELECT source, CASE WHEN count(toxic) = count(*) THEN sum(toxic)::BIGINT END AS strict_sum, sum(toxic)::BIGINT AS loose_sum, count(*) AS documents, count(toxic) AS reviewed
  FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def null_rules(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.read(spark, d, "documents").select("doc_id", "source").join(tables.read(spark, d, "labels"), "doc_id", "left")
    return rows.groupBy("source").agg(reports.sum_or_null(F.col("toxic")).alias("strict_sum"), F.sum("toxic").alias("loose_sum"), F.count("*").alias("documents"), F.count("toxic").alias("reviewed"))


@query("""WITH p AS (SELECT event_type, user_id, day(ts) % 4 AS rep, sum(value) AS v FROM events GROUP BY ALL),
  w AS (SELECT event_type, user_id, stddev_samp(v) AS sd, min(v) = max(v) AS same FROM p GROUP BY ALL),
  i AS (SELECT event_type, avg(sd) AS mean_within_sd, count(*) FILTER (same) AS unchanged, count(*) AS subjects FROM w GROUP BY ALL),
  t AS (SELECT event_type, rep, sum(v) AS t FROM p GROUP BY ALL)
  SELECT event_type, count(*) AS repetitions, round(avg(t), 6) AS mean_total, round(stddev_samp(t), 6) AS sd_total, round(min(t), 6) AS min_total, round(max(t), 6) AS max_total,
  round(max(mean_within_sd), 6) AS mean_within_sd, max(unchanged) AS unchanged, max(subjects) AS subjects FROM t JOIN i USING (event_type) GROUP BY event_type""")
def repetition_stability(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.read(spark, d, "events").withColumn("rep", F.dayofmonth("ts") % 4)
    out = reports.stability(rows, "user_id", "rep", "value", ["event_type"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean_total", "sd_total", "min_total", "max_total", "mean_within_sd")})


@query("""WITH c AS (SELECT p_brand AS brand, count(*) AS n FROM part WHERE p_size > 40 GROUP BY 1), t AS (SELECT 'Brand#' || i AS brand, 10 + i % 3 AS target FROM range(1, 31) r(i))
  SELECT brand, target::BIGINT AS target, coalesce(n, 0) AS n, greatest(target - coalesce(n, 0), 0)::BIGINT AS gap, round(coalesce(n, 0) / target, 8) AS ratio,
  CASE WHEN coalesce(n, 0) = target THEN 'met' WHEN coalesce(n, 0) < target THEN 'below' ELSE 'above' END AS status FROM t LEFT JOIN c USING (brand)""")
def quota_gaps(spark: SparkSession, d: str) -> DataFrame:
    counts = tables.read(spark, d, "part").where("p_size > 40").groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n"))
    targets = spark.range(1, 31).select(F.concat(F.lit("Brand#"), F.col("id").cast("string")).alias("brand"), (10 + F.col("id") % 3).alias("target"))
    return reports.with_targets(counts, targets, "brand", "n", "target").withColumn("ratio", F.round("ratio", 8))


@query("""SELECT p_brand, string_agg(p_type || ':' || n, ';' ORDER BY r) AS top FROM (SELECT p_brand, p_type, n, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS r
  FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL)) WHERE r <= 3 GROUP BY p_brand""")
def top_components(spark: SparkSession, d: str) -> DataFrame:
    return reports.top_list(tables.read(spark, d, "part"), ["p_brand"], "p_type", 3)


@query("""WITH s AS (SELECT count(*) AS n, count(DISTINCT source) AS sources, max(c) AS biggest, sum(c) AS total FROM documents, (SELECT max(c) AS c FROM (SELECT count(*) AS c FROM documents GROUP BY source)) GROUP BY ALL),
  t AS (SELECT n, sources, biggest FROM s)
  SELECT 'enough_documents' AS "check", n >= 200 AS passed FROM t UNION ALL SELECT 'enough_sources', sources >= 15 FROM t UNION ALL SELECT 'source_share', biggest <= 0.1 * n FROM t UNION ALL SELECT 'more_than_a_million', n > 1000000 FROM t""")
def hard_checks(spark: SparkSession, d: str) -> DataFrame:
    per = tables.read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("c"))
    summary = per.agg(F.sum("c").alias("n"), F.count("source").alias("sources"), F.max("c").alias("biggest"))
    c = F.col
    return reports.checks(summary, {"enough_documents": c("n") >= 200, "enough_sources": c("sources") >= 15, "source_share": c("biggest") <= 0.1 * c("n"), "more_than_a_million": c("n") > 1000000})


@query("""SELECT role, count(*) AS calls, CASE WHEN count(i) > 0 THEN sum(i)::BIGINT END AS input_tokens, sum(o)::BIGINT AS output_tokens, sum(turn)::DOUBLE AS duration_ms, sum(greatest(turn - 1, 0))::BIGINT AS retries,
  string_agg(DISTINCT m, ';' ORDER BY m) AS models FROM (SELECT role, turn, CASE WHEN role <> 'system' THEN length(text) END AS i, length(text) AS o, 'm' || (conv_id % 3) AS m FROM conversations) GROUP BY role""")
def model_calls(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.read(spark, d, "conversations").select("role", F.concat(F.lit("m"), (F.col("conv_id") % 3).cast("string")).alias("model"), F.col("turn").alias("attempts"), F.when(F.col("role") != "system", F.length("text").cast("long")).alias("input_tokens"), F.length("text").cast("long").alias("output_tokens"), F.col("turn").cast("double").alias("duration_ms"))
    return reports.call_summary(rows, ["role"]).withColumn("models", F.array_join("models", ";"))


@query("""SELECT conv_id, count(*) FILTER (role = 'assistant') AS attempts, count(*) FILTER (role = 'assistant' AND length(text) > 400) AS accepted, max(turn) AS last_turn FROM conversations GROUP BY conv_id""")
def nested_turns(spark: SparkSession, d: str) -> DataFrame:
    c = tables.read(spark, d, "conversations")
    attempt = F.struct(F.when(F.length("text") > 400, "accepted").otherwise("rejected").alias("status"), F.col("role").alias("role"))
    rounds = c.groupBy("conv_id", "turn").agg(F.struct(F.col("turn").alias("round"), F.filter(F.collect_list(attempt), lambda a: a["role"] == "assistant").alias("attempts")).alias("r"))
    states = rounds.groupBy("conv_id").agg(F.collect_list("r").alias("rounds"), F.max("turn").alias("last_turn"))
    return states.select("conv_id", reports.nested_attempts().cast("long").alias("attempts"), reports.nested_attempts(status="accepted").cast("long").alias("accepted"), "last_turn")


@query("""SELECT k, count(*) AS n, round(avg(value), 8) AS mean_value FROM (SELECT (props->>'k')::INT AS k, value FROM events) GROUP BY k""")
def json_cells(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return tables.read(spark, d, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 8).alias("mean_value"))


@query("""SELECT lang, count(*) AS documents, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS poor, count(*) FILTER (quality IS NULL) AS unlabelled, round(count(*) / sum(count(*)) OVER (), 8) AS share FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def distribution(spark: SparkSession, d: str) -> DataFrame:
    docs = tables.read(spark, d, "documents").select("doc_id", "lang")
    rows = docs.join(tables.read(spark, d, "labels"), "doc_id", "left")
    per = rows.groupBy("lang").agg(F.count("*").alias("documents"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("poor"), F.count_if(F.col("quality").isNull()).alias("unlabelled"))
    total = per.agg(F.sum("documents").alias("_all")).withColumn("_one", F.lit(1))
    return per.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").select("lang", "documents", "good", "poor", "unlabelled", F.round(F.col("documents") / F.col("_all"), 8).alias("share"))


@query("""SELECT o_custkey, round((f - o) / nullif(f, 0), 8) AS reduction, f::BIGINT AS before, o::BIGINT AS after FROM (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o FROM orders GROUP BY 1)""")
def reductions(spark: SparkSession, d: str) -> DataFrame:
    per = tables.read(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("before"), F.count_if(F.col("o_orderstatus") == "O").alias("after"))
    return per.select("o_custkey", F.round(reduction(F.col("before"), F.col("after")), 8).alias("reduction"), "before", "after")
