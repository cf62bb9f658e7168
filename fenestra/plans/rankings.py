"""Ranks, selections, set operations and statistics over the driver's tables, with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenestra.functions.text import layout_path, stable_key
from fenestra.operators import metrics, ranking, sets, stats
from fenestra.operators.graph import grouped
from fenestra.plans.reports import query
from fenestra.sources import tables


@query("""SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1""")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top(tables.read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), "o_orderkey"])


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY sha256('11|' || o_orderkey), o_orderkey) > 2 AS over_cap FROM orders""")
def capped_per_group(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return ranking.capped(rows, ["o_custkey", "o_orderstatus"], [stable_key(11, "o_orderkey"), F.col("o_orderkey")], 2).select("o_orderkey", "over_cap")


@query("""SELECT p_partkey, p_type, turn FROM (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey)::INT AS turn, p_retailprice FROM part) WHERE turn <= 20 ORDER BY turn, p_type, p_retailprice DESC, p_partkey LIMIT 50""")
def round_robin(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.read(spark, d, "part").select("p_partkey", "p_type", "p_retailprice")
    return ranking.round_robin(rows, "p_type", [F.desc("p_retailprice"), "p_partkey"], 50, 20).select("p_partkey", "p_type", "turn")


@query("""SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0::DOUBLE AS mid_rank FROM part""")
def mid_ranks(spark: SparkSession, d: str) -> DataFrame:
    return ranking.mid_ranks(tables.read(spark, d, "part").select("p_partkey", "p_brand", "p_size"), "p_size", ["p_brand"]).select("p_partkey", F.col("mid_rank").cast("double").alias("mid_rank"))


@query("""WITH e AS (SELECT event_id, user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b, ts FROM events),
  i AS (SELECT *, sum(CASE WHEN value < b OR b IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM e)
  SELECT event_id, (sum(CASE WHEN value < b OR b IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id))::BIGINT AS streak FROM i""")
def streaks(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    rows = tables.read(spark, d, "events").select("event_id", "user_id", "ts", "value")
    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    marked = rows.withColumn("better", F.coalesce(F.col("value") < before, F.lit(True)))
    return ranking.streaks(marked, ["user_id"], ["ts", "event_id"], F.col("better")).select("event_id", "streak")


@query("""WITH c AS (SELECT p_brand, p_partkey, p_size, sum(p_size) OVER w AS s, count(*) OVER w AS n FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT p_brand, p_partkey FROM c WHERE n < 5 OR coalesce(s, 0) < 120""")
def quota_apps(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.read(spark, d, "part").select("p_brand", "p_partkey", "p_size", "p_retailprice")
    return ranking.until_met(rows, ["p_retailprice", "p_partkey"], "p_size", 5, 120, ["p_brand"]).select("p_brand", "p_partkey")


@query("""SELECT 'source' AS key_name, source AS "key", string_agg(DISTINCT lang, ';' ORDER BY lang) AS splits FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1
  UNION ALL SELECT 'digest', md5(text), string_agg(DISTINCT lang, ';' ORDER BY lang) FROM documents GROUP BY 2 HAVING count(DISTINCT lang) > 1""")
def leaking_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.read(spark, d, "documents").select("lang", "source", F.md5(F.col("text").cast("binary")).alias("digest"))
    return sets.leakage(rows, "lang", ["source", "digest"])


@query("""(SELECT doc_id, 'both' AS side FROM (SELECT doc_id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM labels WHERE toxic = 1))
  UNION ALL (SELECT doc_id, 'first' FROM (SELECT doc_id FROM labels WHERE quality = 1 EXCEPT SELECT doc_id FROM labels WHERE toxic = 1))""")
def set_sides(spark: SparkSession, d: str) -> DataFrame:
    labels = tables.read(spark, d, "labels")
    good, toxic = labels.where("quality = 1"), labels.where("toxic = 1")
    return sets.shared(good, toxic, "doc_id").withColumn("side", F.lit("both")).unionByName(sets.only_left(good, toxic, "doc_id").withColumn("side", F.lit("first")))


@query("""SELECT conv_id, concat_ws(';', CASE WHEN dd < 3 THEN 'missing_condition' END, CASE WHEN n > dd THEN 'repeated_condition' END) AS problems FROM (SELECT conv_id, count(*) AS n, count(DISTINCT role) AS dd FROM conversations GROUP BY 1) WHERE dd < 3 OR n > dd""")
def broken_designs(spark: SparkSession, d: str) -> DataFrame:
    return sets.incomplete(tables.read(spark, d, "conversations"), "conv_id", "role", ["system", "user", "assistant"])


@query("""WITH b AS (SELECT p_partkey AS path, md5(p_name) AS digest FROM part WHERE p_partkey % 4 <> 0), a AS (SELECT p_partkey AS path, md5(CASE WHEN p_partkey % 6 = 1 THEN p_type ELSE p_name END) AS digest FROM part WHERE p_partkey % 5 <> 0)
  SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.path = b.path WHERE a.digest IS DISTINCT FROM b.digest""")
def snapshots(spark: SparkSession, d: str) -> DataFrame:
    part = tables.read(spark, d, "part").select(F.col("p_partkey").alias("path"), "p_name", "p_type")
    digest = lambda c: F.md5(c.cast("binary")).alias("digest")
    before = part.where("path % 4 <> 0").select("path", digest(F.col("p_name")))
    after = part.where("path % 5 <> 0").select("path", digest(F.when(F.col("path") % 6 == 1, F.col("p_type")).otherwise(F.col("p_name"))))
    return sets.snapshot_difference(before, after)


@query("""WITH l AS (SELECT source, lpad(doc_id::VARCHAR, 12, '0') AS path, md5(text) AS digest FROM documents), n AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY path, digest NULLS FIRST) - 1) // 100 AS r FROM l),
h AS (SELECT source, r, count(*) AS n, sha256(coalesce(string_agg(path || chr(0) || digest, chr(10) ORDER BY path, digest), '')) AS h FROM n GROUP BY source, r)
SELECT source, sum(n)::BIGINT AS files, CASE WHEN count(*) = 1 THEN min(h) ELSE sha256(string_agg(h, chr(10) ORDER BY r)) END AS tree FROM h GROUP BY source""")
def tree_digests(spark: SparkSession, d: str) -> DataFrame:
    files = tables.read(spark, d, "documents").select("source", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.md5(F.col("text").cast("binary")).alias("digest"))
    return sets.tree_digest(files, ["source"], size=100)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT a.c_custkey AS u, b.c_custkey AS v FROM customer a JOIN customer b ON (a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment) OR a.c_custkey % 97 = b.c_custkey % 97),
  r(u, v) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u) SELECT u AS c_custkey, min(v) AS root FROM r GROUP BY u""")
def shared_key_groups(spark: SparkSession, d: str) -> DataFrame:
    c = tables.read(spark, d, "customer").select("c_custkey", F.concat_ws("|", F.col("c_nationkey").cast("string"), F.col("c_mktsegment")).alias("place"), (F.col("c_custkey") % 97).alias("remainder"))
    return grouped(c, "c_custkey", "place", "remainder")


@query("""SELECT seed, round(gap, 8) AS gap FROM (SELECT seed, abs(sum(CASE WHEN ('0x' || substr(sha256(seed || '|' || c_nationkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.3 THEN n ELSE 0 END) / sum(n) - 0.3) AS gap
  FROM (SELECT c_nationkey, count(*)::DOUBLE AS n FROM customer GROUP BY 1), (SELECT unnest(range(0, 200)) AS seed) GROUP BY seed) ORDER BY gap, seed LIMIT 1""")
def best_split(spark: SparkSession, d: str) -> DataFrame:
    groups = tables.read(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").cast("double").alias("n"))
    return sets.best_seed(groups, "c_nationkey", "n", 200, 0.3).select(F.col("seed").cast("long").alias("seed"), F.round("gap", 8).alias("gap"))


@query("""WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
  l AS (SELECT source, doc_id, quality + toxic AS grade FROM documents JOIN labels USING (doc_id)),
  g AS (SELECT r.*, coalesce(l.grade, 0) AS grade FROM r LEFT JOIN l USING (source, doc_id) WHERE r.rank <= 10),
  a AS (SELECT source, count(*) FILTER (grade >= 1 AND rank <= 1) AS h1, count(*) FILTER (grade >= 1 AND rank <= 3) AS h3, count(*) FILTER (grade >= 1 AND rank <= 5) AS h5,
    sum(CASE WHEN rank <= 1 THEN (pow(2.0, grade) - 1) / log2(rank + 1.0) ELSE 0 END) AS d1, sum(CASE WHEN rank <= 3 THEN (pow(2.0, grade) - 1) / log2(rank + 1.0) ELSE 0 END) AS d3, sum(CASE WHEN rank <= 5 THEN (pow(2.0, grade) - 1) / log2(rank + 1.0) ELSE 0 END) AS d5,
    min(rank) FILTER (grade >= 1) AS first FROM g GROUP BY source),
  i AS (SELECT source, grade, row_number() OVER (PARTITION BY source ORDER BY grade DESC, doc_id) AS rank FROM l),
  b AS (SELECT source, count(*) FILTER (grade >= 1) AS rel, sum(CASE WHEN rank <= 1 THEN (pow(2.0, grade) - 1) / log2(rank + 1.0) ELSE 0 END) AS i1, sum(CASE WHEN rank <= 3 THEN (pow(2.0, grade) - 1) / log2(rank + 1.0) ELSE 0 END) AS i3, sum(CASE WHEN rank <= 5 THEN (pow(2.0, grade) - 1) / log2(rank + 1.0) ELSE 0 END) AS i5 FROM i GROUP BY source)
  SELECT b.source, round(coalesce(h1 / 1.0, 0), 8)::DOUBLE AS precision_1, round(coalesce(h1 / nullif(rel, 0), 0), 8)::DOUBLE AS recall_1, round(coalesce(d1 / nullif(i1, 0), 0), 8) AS ndcg_1, round(coalesce(h3 / 3.0, 0), 8)::DOUBLE AS precision_3, round(coalesce(h3 / nullif(rel, 0), 0), 8)::DOUBLE AS recall_3, round(coalesce(d3 / nullif(i3, 0), 0), 8) AS ndcg_3,
  round(coalesce(h5 / 5.0, 0), 8)::DOUBLE AS precision_5, round(coalesce(h5 / nullif(rel, 0), 0), 8)::DOUBLE AS recall_5, round(coalesce(d5 / nullif(i5, 0), 0), 8) AS ndcg_5, round(coalesce(1.0 / first, 0), 8)::DOUBLE AS reciprocal_rank FROM b LEFT JOIN a USING (source)""")
def ranking_metrics(spark: SparkSession, d: str) -> DataFrame:
    docs = tables.read(spark, d, "documents").select("source", "doc_id", "n_chars")
    found = ranking.top(docs, ["source"], [F.desc("n_chars"), "doc_id"], 10, "rank")
    labels = docs.join(tables.read(spark, d, "labels"), "doc_id").select("source", "doc_id", (F.col("quality") + F.col("toxic")).alias("grade"))
    out = metrics.ranked_metrics(found, labels, "source", "doc_id")
    return out.select("source", *(F.round(c, 8).alias(c) for c in out.columns if c != "source"))


@query("""WITH q AS (SELECT o_custkey, avg(o_totalprice) AS m, count(*) AS n FROM orders GROUP BY 1) SELECT c_nationkey, count(*) AS queries, round(avg(m), 4) AS m, round(avg(n), 8) AS n FROM q JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def macro_means(spark: SparkSession, d: str) -> DataFrame:
    per = tables.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("m"), F.count("*").alias("n"))
    out = metrics.macro(per, "c_custkey", tables.read(spark, d, "customer"), "c_nationkey")
    return out.select("c_nationkey", "queries", F.round("m", 4).alias("m"), F.round("n", 8).alias("n"))


PAIRS = "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') - count(*) FILTER (o_orderstatus = 'F') AS delta FROM orders GROUP BY 1"


def _deltas(spark: SparkSession, d: str) -> DataFrame:
    is_ = lambda s: F.count_if(F.col("o_orderstatus") == s)
    per = tables.read(spark, d, "orders").groupBy("o_custkey").agg((is_("O") - is_("F")).alias("delta"))
    return per.join(tables.read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation")), "o_custkey")


@query(f"""WITH RECURSIVE p AS (SELECT c_nationkey AS nation, count(*) FILTER (delta > 0) AS wins, count(*) FILTER (delta < 0) AS losses, count(*) FILTER (delta = 0) AS ties FROM ({PAIRS}) JOIN customer ON o_custkey = c_custkey GROUP BY 1),
  t AS (SELECT nation, 0 AS i, 1.0::DOUBLE AS c, 1.0::DOUBLE AS s FROM p UNION ALL SELECT t.nation, i + 1, c * (wins + losses - i) / (i + 1), s + c * (wins + losses - i) / (i + 1) FROM t JOIN p USING (nation) WHERE i < least(wins, losses))
  SELECT p.*, round(CASE WHEN wins + losses = 0 THEN 1.0 ELSE least(1.0, 2 * s / pow(2.0, wins + losses)) END, 8) AS p_value FROM p JOIN t ON p.nation = t.nation AND i = least(wins, losses)""")
def sign_tests(spark: SparkSession, d: str) -> DataFrame:
    return stats.sign_test(_deltas(spark, d), by=["nation"]).withColumn("p_value", F.round("p_value", 8))


@query(None)
def wilcoxon_tests(spark: SparkSession, d: str) -> DataFrame:
    return stats.wilcoxon(_deltas(spark, d), by=["nation"])


@query("""WITH p AS (SELECT s_nationkey AS nation, count(*) FILTER (s_acctbal > 5000 AND s_suppkey % 3 <> 0) AS only_first, count(*) FILTER (s_acctbal <= 5000 AND s_suppkey % 3 = 0) AS only_second, count(*) AS n FROM supplier GROUP BY 1),
  f AS (SELECT *, least(only_first, only_second) AS k, only_first + only_second AS m FROM p)
  SELECT nation, only_first, only_second, n, round(CASE WHEN m = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, k + 1), lambda i: (factorial(m::INT) / (factorial(i::INT) * factorial((m - i)::INT)))::DOUBLE)) / pow(2.0, m)) END, 8) AS p_value FROM f""")
def mcnemar_tests(spark: SparkSession, d: str) -> DataFrame:
    s = tables.read(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), (F.col("s_acctbal") > 5000).alias("a"), (F.col("s_suppkey") % 3 == 0).alias("b"))
    return stats.mcnemar(s, "a", "b", ["nation"]).withColumn("p_value", F.round("p_value", 8))


@query("""WITH p AS (SELECT n_nationkey AS k, ((n_nationkey * 37) % 25 + 1) / 200.0::DOUBLE AS p FROM nation),
  s AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p, k) + 1) * p AS v FROM p) SELECT k, p, round(least(1.0, max(v) OVER (ORDER BY p, k ROWS UNBOUNDED PRECEDING)), 10) AS adjusted FROM s""")
def holm_adjusted(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), (((F.col("n_nationkey") * 37) % 25 + 1) / 200.0).alias("p"))
    return ranking.holm(rows, "p", "k").withColumn("adjusted", F.round("adjusted", 10))


@query("""WITH d AS (SELECT s_suppkey, s_nationkey, s_acctbal, r, ('0x' || substr(md5('5|' || r || '|' || s_suppkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM supplier, (SELECT unnest(range(0, 200)) AS r)),
  c AS (SELECT i, sum(p) OVER (ORDER BY i) AS q FROM (SELECT i, exp(-1) / factorial(i::INT) AS p FROM range(0, 11) t(i))),
  w AS (SELECT d.s_suppkey, d.r, count(*) AS k FROM d JOIN c ON d.u >= c.q GROUP BY ALL),
  m AS (SELECT d.s_nationkey, d.r, sum(s_acctbal * coalesce(k, 0)) / nullif(sum(coalesce(k, 0)), 0) AS mean FROM d LEFT JOIN w USING (s_suppkey, r) GROUP BY ALL)
  SELECT s_nationkey, round(quantile_cont(mean, 0.025), 4) AS low, round(quantile_cont(mean, 0.975), 4) AS high, count(*) AS resamples FROM m GROUP BY 1""")
def bootstrap_intervals(spark: SparkSession, d: str) -> DataFrame:
    out = stats.bootstrap_mean(tables.read(spark, d, "supplier"), "s_acctbal", "s_suppkey", 200, 5, by=["s_nationkey"])
    return out.withColumns({"low": F.round("low", 4), "high": F.round("high", 4)})


@query("""SELECT url, regexp_replace(url, '(^|/)layout-[^/]+/', '\\1layout/') AS neutral, sha256('3|' || url) AS order_key FROM (SELECT CASE WHEN page_id % 2 = 0 THEN 'app/res/layout-land/p' ELSE 'app/res/layout/p' END || page_id || '.xml' AS url FROM pages)""")
def neutral_paths(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id")
    url = F.concat(F.when(i % 2 == 0, "app/res/layout-land/p").otherwise("app/res/layout/p"), i.cast("string"), F.lit(".xml"))
    return tables.read(spark, d, "pages").select(url.alias("url")).select("url", layout_path(F.col("url")).alias("neutral"), stable_key(3, "url").alias("order_key"))
