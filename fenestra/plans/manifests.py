"""Manifests and merged candidates over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenestra.operators import manifests
from fenestra.plans.reports import query
from fenestra.sources import tables


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'existing' ELSE 'extension' END AS source_partition, CASE o_orderstatus WHEN 'F' THEN o_totalprice END AS o_totalprice
FROM orders WHERE o_orderstatus = 'O' OR (o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49))""")
def combined_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Filled orders without those that have a large line, and open ones, whose prices aren't known yet."""
    orders = tables.read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    large = tables.read(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    parts = {"existing": orders.where("o_orderstatus = 'F'").drop("o_orderstatus"), "extension": orders.where("o_orderstatus = 'O'").select("o_orderkey")}
    return manifests.combined(parts, "o_orderkey", large, ("existing",))


@query("""WITH m AS (SELECT 'https://example.org/r' || o_custkey AS repository, o_orderkey, o_orderstatus, o_orderpriority, o_totalprice, l_linenumber AS code, l_quantity, l_returnflag, l_linestatus
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_linenumber <= 3 AND c_acctbal >= 0),
a AS (SELECT repository, min(o_orderkey) AS app_id, count(DISTINCT o_orderkey) AS apps, bool_or(o_totalprice > 150000) AS active FROM m GROUP BY 1),
k AS (SELECT repository, array_to_string(list_sort(list_distinct(list(x))), ',') AS categories FROM (SELECT repository, unnest([o_orderstatus, o_orderpriority]) AS x FROM m) GROUP BY 1),
e AS (SELECT repository, code, max(l_quantity) AS score, array_to_string(list_sort(list_distinct(list(x))), '') AS evidence FROM (SELECT repository, code, l_quantity, unnest([l_returnflag, l_linestatus]) AS x FROM m) GROUP BY 1, 2)
SELECT repository, app_id, apps, active, categories, code, score, evidence FROM a JOIN k USING (repository) JOIN e USING (repository)""")
def merged_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Orders as apps of their customer's repository, lines as matches of a code, their number; repositories of customers in debt are there already."""
    c = F.col
    home = lambda k: F.concat(F.lit("https://example.org/r"), c(k).cast("string")).alias("repository_url")
    apps = tables.read(spark, d, "orders").select(c("o_orderkey").alias("app_id"), F.lit("").alias("app_name"), home("o_custkey"), F.array("o_orderstatus", "o_orderpriority").alias("categories"), (c("o_totalprice") > 150000).alias("active"))
    matched = tables.read(spark, d, "lineitem").select(c("l_orderkey").alias("app_id"), c("l_linenumber").alias("code"), c("l_quantity").alias("score"), F.array("l_returnflag", "l_linestatus").alias("evidence"))
    wanted = matched.select("code").where("code <= 3")
    there = tables.read(spark, d, "customer").where("c_acctbal < 0").select(home("c_custkey"))
    rows = manifests.merged_candidates(apps, matched, wanted, there).withColumn("t", F.explode("targets"))
    return rows.select("repository", "app_id", F.size("app_ids").cast("long").alias("apps"), "active", F.array_join("categories", ",").alias("categories"), "t.code", "t.score", F.array_join("t.evidence", "").alias("evidence"))
