"""Selections that cover, over the driver's tables; greedy picks in SQL are a recursion that looks at the whole pool for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenestra.operators import cover
from fenestra.plans.reports import query
from fenestra.sources import tables

#: Suppliers as apps: the brands of returned parts are their safe codes, the types and brands of all parts their codes.
POOL = """c AS (SELECT l_suppkey AS id, list_sort(list_distinct(list(p_brand) FILTER (l_returnflag = 'R' AND l_quantity > 49))) AS codes, list_sort(list_distinct(list(p_brand || '/' || p_type) FILTER (l_quantity > 48))) AS every,
  count(*) FILTER (l_returnflag = 'R' AND l_quantity > 49) AS safe, any_value(s_nationkey) AS cat, any_value(s_name) AS name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1),
e AS (SELECT id, codes, coalesce(every, []) AS every, safe, cat, name FROM c WHERE len(codes) > 0),
o AS (SELECT code, count(*) AS n FROM (SELECT unnest(codes) AS code FROM e) GROUP BY 1),
r AS (SELECT id, sum(1 / n ORDER BY code) AS rarity FROM (SELECT id, unnest(codes) AS code FROM e) JOIN o USING (code) GROUP BY id),
k AS (SELECT e.*, rarity FROM e JOIN r USING (id))"""


def _pool(spark: SparkSession, d: str) -> DataFrame:
    read = lambda t: tables.read(spark, d, t)
    lines = read("lineitem").select("l_suppkey", "l_partkey", "l_returnflag", "l_quantity").join(read("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type"), "l_partkey")
    safe, all_ = (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 49), F.col("l_quantity") > 48
    codes = lambda when, what: F.array_sort(F.collect_set(F.when(when, what)))
    apps = lines.groupBy(F.col("l_suppkey").alias("id")).agg(codes(safe, F.col("p_brand")).alias("codes"), codes(all_, F.concat_ws("/", "p_brand", "p_type")).alias("every"), F.count_if(safe).alias("safe")).where(F.size("codes") > 0)
    named = apps.join(read("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("cat"), F.col("s_name").alias("name")), "id")
    return cover.rarity(named, "id", "codes").withColumns({"few": F.least("safe", F.lit(10)), "less": -F.col("safe"), "kinds": F.size("codes"), "odd": (F.col("id") % 3 == 0).cast("int")})


@query(f"""WITH RECURSIVE {POOL},
p AS (SELECT 0 AS step, NULL::BIGINT AS id, []::BIGINT[] AS ids, []::VARCHAR[] AS s, []::VARCHAR[] AS a, []::INT[] AS cats
UNION ALL SELECT step + 1, b.id, list_append(ids, b.id), list_distinct(list_concat(s, b.codes)), list_distinct(list_concat(a, b.every)), list_append(cats, b.cat) FROM (
  SELECT p.*, arg_max(k, ROW(len(list_filter(k.codes, lambda x: NOT list_contains(s, x))), rarity, NOT list_contains(cats, k.cat), len(list_filter(k.every, lambda x: NOT list_contains(a, x))), least(safe, 10), -safe, name, k.id)) AS b
  FROM p, k WHERE step < 20 AND NOT list_contains(ids, k.id) AND len(list_filter(cats, lambda x: x = k.cat)) < 2 GROUP BY ALL))
SELECT id, step::INT AS pick FROM p WHERE step > 0""")
def marginal_picks(spark: SparkSession, d: str) -> DataFrame:
    """Twenty suppliers that cover most brands, then rare ones, nations and kinds; two of a nation, unless that is too few."""
    terms = [cover.New("codes"), cover.Fixed("rarity"), cover.Fresh("cat"), cover.New("every"), cover.Fixed("few"), cover.Fixed("less")]
    return cover.marginal(_pool(spark, d), "id", terms, 20, "name", "cat", 2)


@query(f"""WITH RECURSIVE {POOL},
p AS (SELECT 0 AS step, NULL::BIGINT AS id, []::BIGINT[] AS ids, []::VARCHAR[] AS types
UNION ALL SELECT step + 1, b.id, list_append(ids, b.id), list_concat(types, b.codes) FROM (
  SELECT p.*, arg_max(k, ROW(len(list_filter(k.codes, lambda x: len(list_filter(types, lambda y: y = x)) < 4)), len(k.codes), least(safe, 10), name, k.id)) AS b
  FROM p, k WHERE step < 25 AND NOT list_contains(ids, k.id) GROUP BY ALL))
SELECT id, step::INT AS pick FROM p WHERE step > 0""")
def undercovered_picks(spark: SparkSession, d: str) -> DataFrame:
    """Twenty-five suppliers, those first whose brands fewer than four picks have."""
    return cover.marginal(_pool(spark, d), "id", [cover.New("codes", 4), cover.Fixed("kinds"), cover.Fixed("few")], 25, "name")


@query(f"""WITH RECURSIVE {POOL},
p AS (SELECT 0 AS step, NULL::BIGINT AS id, []::BIGINT[] AS ids, []::VARCHAR[] AS s, []::INT[] AS cats, 0 AS odds
UNION ALL SELECT step + 1, b.id, list_append(ids, b.id), list_distinct(list_concat(s, b.codes)), list_append(cats, b.cat), odds + (b.id % 3 = 0)::INT FROM (
  SELECT p.*, arg_max(k, ROW(len(list_filter(k.codes, lambda x: NOT list_contains(s, x))), k.id % 3 = 0 AND odds < 6 AND 6 - odds >= 10 - step, rarity, k.id % 3 = 0, len(k.codes), name, k.id)) AS b
  FROM p, k WHERE step < 10 AND NOT list_contains(cats, k.cat) GROUP BY ALL))
SELECT id, step::INT AS pick FROM p WHERE step > 0""")
def covering_picks(spark: SparkSession, d: str) -> DataFrame:
    """Ten suppliers, one of a nation, at least six of them with ids that can be divided by three."""
    terms = [cover.New("codes"), cover.Due("odd", 6, 10), cover.Fixed("rarity"), cover.Fixed("odd"), cover.Fixed("kinds")]
    return cover.covering(_pool(spark, d), "id", "cat", "codes", [], terms, 10, "name")


@query("""WITH t AS (SELECT * FROM (SELECT c_nationkey AS nation, c_custkey, c_name, floor(c_acctbal / 1000) AS score, row_number() OVER (PARTITION BY c_nationkey ORDER BY floor(c_acctbal / 1000) DESC, c_name) AS i FROM customer) WHERE i <= 7),
f AS (SELECT nation, i, c_name, score, o_orderkey AS id, o_orderpriority AS code, o_orderstatus = 'F' AS error, o_totalprice > 200000 AS safe FROM t LEFT JOIN orders ON o_custkey = c_custkey),
s AS (SELECT x.nation, [x.i, y.i] AS pos, x.score + y.score AS score FROM t x JOIN t y ON x.nation = y.nation AND x.i < y.i
  UNION ALL SELECT x.nation, [x.i, y.i, z.i], x.score + y.score + z.score FROM t x JOIN t y ON x.nation = y.nation AND x.i < y.i JOIN t z ON x.nation = z.nation AND y.i < z.i),
w AS (SELECT s.nation, pos, count(DISTINCT code) FILTER (safe) AS a, -greatest(count(DISTINCT id) FILTER (safe) - 20, 0) AS b, count(DISTINCT code) FILTER (error) AS c, count(DISTINCT code) AS d, least(count(DISTINCT id) FILTER (safe), 5) AS e, any_value(s.score) AS g
  FROM s JOIN f ON f.nation = s.nation AND list_contains(pos, f.i) GROUP BY s.nation, pos),
b AS (SELECT nation, pos FROM w QUALIFY row_number() OVER (PARTITION BY nation ORDER BY a DESC, b DESC, c DESC, d DESC, e DESC, g DESC, len(pos), pos) = 1)
SELECT b.nation, string_agg(c_name, ',' ORDER BY i) AS chosen FROM b JOIN t ON t.nation = b.nation AND list_contains(pos, i) GROUP BY b.nation""")
def best_trios(spark: SparkSession, d: str) -> DataFrame:
    """Of each nation's seven richest customers, the pair or trio whose orders cover most priorities."""
    read = lambda t: tables.read(spark, d, t)
    finding = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("code"), (F.col("o_orderstatus") == "F").alias("error"), (F.col("o_totalprice") > 200000).alias("safe"))
    found = read("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(finding).alias("found"))
    rows = read("customer").join(found, "c_custkey", "left").select(F.col("c_nationkey").alias("nation"), "c_name", F.floor(F.col("c_acctbal") / 1000).alias("score"), F.coalesce("found", F.array().cast("array<struct<id:bigint,code:string,error:boolean,safe:boolean>>")).alias("found"))
    return cover.best_subset(rows, "nation", "c_name", "score", "found", 7).select("nation", F.array_join("chosen", ",").alias("chosen"))


@query("""WITH n AS (SELECT o_custkey, o_orderkey, o_totalprice > 250000 AS sure, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS size FROM orders),
f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (size > 3 AND sure) DESC, n) AS place FROM n WHERE n <= 12) SELECT o_custkey, o_orderkey, place::INT AS place FROM f WHERE place <= 3""")
def evidence_first(spark: SparkSession, d: str) -> DataFrame:
    """Three orders of each customer: large ones among the first twelve, then the first ones."""
    rows = tables.read(spark, d, "orders").select("o_custkey", "o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("at"), (F.col("o_totalprice") > 250000).cast("int").alias("sure"))
    return cover.with_evidence_first(rows, "o_custkey", "at", "sure", 3).select("o_custkey", "o_orderkey", "place")
