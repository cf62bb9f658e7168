"""Labels, relocation, closures and owners over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fenestra.operators import placement
from fenestra.operators.rules import described
from fenestra.operators.tree import parse
from fenestra.plans.reports import query
from fenestra.sources import tables

NS = 'xmlns:android="http://schemas.android.com/apk/res/android"'


@query("""WITH v AS (SELECT l_orderkey, l_linenumber AS n, l_quantity <= 25 AS fits, CASE WHEN l_quantity <= 25 THEN 'Part ' || l_partkey WHEN l_linenumber % 2 = 0 THEN ' 12 % ' ELSE 'Value' END || '"/>' AS said FROM lineitem),
l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n, said) AS i FROM v),
s AS (SELECT l_orderkey, count(*) FILTER (fits) AS fit, coalesce(max(i) FILTER (fits AND n < 3), min(i) FILTER (fits AND n >= 3)) AS chosen FROM l GROUP BY 1)
SELECT o_orderkey::VARCHAR AS doc, '/Root[1]/TextView[' || chosen || ']' AS selector,
  CASE o_orderstatus WHEN 'F' THEN 'nearby' WHEN 'O' THEN 'adjacent_container' ELSE 'nested_container' END || '_visible_label_candidate' AS relationship, '@id/o' || o_orderkey AS required_value
FROM orders JOIN s ON l_orderkey = o_orderkey WHERE chosen IS NOT NULL AND (o_orderstatus <> 'P' OR fit = 1)""")
def related_labels(spark: SparkSession, d: str) -> DataFrame:
    """An order as a layout: its lines are text views, those of small quantities with words; a field stands after the second, none, one or two containers deep by the order's status."""
    lines = tables.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") <= 25, F.concat(F.lit("Part "), F.col("l_partkey").cast("string"))).when(F.col("l_linenumber") % 2 == 0, F.lit(" 12 % ")).otherwise(F.lit("Value")).alias("said"))
    views = F.concat(F.lit('<TextView android:text="'), "said", F.lit('"/>'))
    packed = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", views.alias("v")))).alias("vs"))
    joined = lambda keep: F.array_join(F.transform(F.filter("vs", keep), lambda x: x["v"]), "")
    depth = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    field = F.concat(F.repeat(F.lit("<Box>"), depth), F.lit('<EditText android:id="@+id/o'), F.col("o_orderkey").cast("string"), F.lit('"/>'), F.repeat(F.lit("</Box>"), depth))
    xml = F.concat(F.lit(f"<Root {NS}>"), joined(lambda x: x["l_linenumber"] < 3), field, joined(lambda x: x["l_linenumber"] >= 3), F.lit("</Root>"))
    rows = tables.read(spark, d, "orders").join(packed, "o_orderkey").select(F.col("o_orderkey").cast("string").alias("doc"), F.lit("r").alias("root"), xml.alias("xml"))
    nodes = described(rows)
    targets = nodes.where("local_tag = 'EditText'").select("doc", "path")
    return placement.related_labels(targets, nodes).select("doc", "selector", "relationship", "required_value")


@query("""WITH o AS (SELECT o_custkey, o_orderstatus AS id, o_orderpriority AS text, CASE WHEN o_totalprice > 150000 THEN 'EditText' ELSE 'Button' END AS kind FROM orders),
f AS (SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN substr('FOP', (c_custkey % 3 + 1)::INT, 1) END AS id, CASE WHEN c_custkey % 5 <> 0 THEN 'Button' END AS kind, CASE WHEN c_custkey % 2 = 0 THEN '1-URGENT' END AS text FROM customer),
p AS (SELECT c_custkey, f.text IS NULL OR o.text = f.text AS same FROM f JOIN o ON o_custkey = c_custkey AND (f.id IS NULL OR o.id = f.id) AND (f.kind IS NULL OR o.kind = f.kind)
  UNION ALL SELECT c_custkey, f.text IS NULL FROM f WHERE id IS NULL AND kind IS NULL AND c_custkey IN (SELECT o_custkey FROM o)),
s AS (SELECT c_custkey, count(*) AS every, count(*) FILTER (same) AS same FROM p GROUP BY 1)
SELECT c_custkey, coalesce(CASE WHEN same > 0 THEN same ELSE every END, 0)::BIGINT AS matches FROM f LEFT JOIN s USING (c_custkey)""")
def relocated_findings(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders as elements: ids are statuses and may repeat; stored findings know an id, a kind and a text, or not all of these."""
    price, key = F.col("o_totalprice") > 150000, F.col("c_custkey")
    element = F.concat(F.lit("<"), F.when(price, "EditText").otherwise("Button"), F.lit(' android:id="@+id/'), "o_orderstatus", F.lit('" android:text="'), "o_orderpriority", F.lit('"/>'))
    docs = tables.read(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("doc")).agg(F.concat(F.lit(f"<Root {NS}>"), F.array_join(F.array_sort(F.collect_list(element)), ""), F.lit("</Root>")).alias("xml"))
    none = F.create_map().cast("map<string,string>")
    stored = tables.read(spark, d, "customer").select(
        "c_custkey", key.cast("string").alias("doc"), F.when(key % 4 != 0, F.concat(F.lit("@id/"), F.substring(F.lit("FOP"), (key % 3 + 1).cast("int"), F.lit(1)))).alias("widget_id"), F.when(key % 5 != 0, "com.example.Button").otherwise("").alias("widget_type"),
        F.when(key % 2 == 0, F.create_map(F.lit("text"), F.lit("1-URGENT"), F.lit("layout_width"), F.lit("8dp"))).otherwise(none).alias("attributes"),
    )
    return placement.relocated(stored, "c_custkey", parse(docs, "doc", "xml")).select("c_custkey", "matches").distinct()


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus = 'P' AS bad, o_orderpriority AS id FROM orders)
SELECT a.o_orderkey AS start, array_to_string(list_sort(list_distinct(list(b.id))), ',') AS ids, NOT bool_or(b.bad) AS complete
FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND (b.o_orderkey >= a.o_orderkey OR a.o_custkey % 2 = 0) GROUP BY a.o_orderkey""")
def complete_closures(spark: SparkSession, d: str) -> DataFrame:
    """An order includes its customer's next one; the last one of every other customer includes the first, a cycle. Orders of status P include what isn't there."""
    o = tables.read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    mine = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    following = F.coalesce(F.lead("o_orderkey").over(mine), F.when(F.col("o_custkey") % 2 == 0, F.min("o_orderkey").over(mine)))
    linked = o.select("o_orderkey", "o_orderstatus", following.alias("next"))
    name = lambda c: F.concat(F.lit("order_"), F.col(c).cast("string"))
    includes = linked.where("next IS NOT NULL").select(F.col("o_orderkey").alias("path"), name("next").alias("name")).unionByName(linked.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("path"), F.lit("gone").alias("name")))
    layouts = o.select(name("o_orderkey").alias("name"), F.col("o_orderkey").alias("path"))
    found = placement.include_closure(o.select(F.col("o_orderkey").alias("path"), F.lit(True).alias("ok")), includes, layouts, o.select(F.col("o_orderkey").alias("path"), F.col("o_orderpriority").alias("id")), o.select(F.col("o_orderkey").alias("path")))
    return found.select("start", F.array_join("ids", ",").alias("ids"), "complete")


OWNED = """f AS (SELECT DISTINCT p_type AS code, p_partkey AS file, p_name AS selector, p_size > 25 AS severity FROM part JOIN lineitem ON l_partkey = p_partkey),
h AS (SELECT DISTINCT l_orderkey AS screen, l_partkey AS file FROM lineitem)"""


def _findings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lines = tables.read(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    part = tables.read(spark, d, "part").join(lines.select(F.col("l_partkey").alias("p_partkey")), "p_partkey")  # one for each line: repeats
    findings = part.select(F.col("p_type").alias("code"), F.col("p_partkey").alias("file"), F.col("p_name").alias("selector"), (F.col("p_size") > 25).alias("severity"), F.lit(None).cast("string").alias("repairability"))
    return findings, lines.select(F.col("l_orderkey").alias("screen"), F.col("l_partkey").alias("file"))


@query(f"""WITH {OWNED}, w AS (SELECT file, screen, count(*) OVER (PARTITION BY file) AS screens, row_number() OVER (PARTITION BY file ORDER BY screen <> file, -o_totalprice, o_orderpriority, screen) AS n FROM h JOIN orders ON o_orderkey = screen)
SELECT code, file, selector, severity, screen AS owner, screens FROM f JOIN w USING (file) WHERE n = 1""")
def owned_findings(spark: SparkSession, d: str) -> DataFrame:
    """Orders as screens that take in parts, each with one finding: the dearest order owns it, unless one has the part's own number."""
    findings, closure = _findings(spark, d)
    screens = tables.read(spark, d, "orders").select(F.col("o_orderkey").alias("screen"), F.col("o_orderpriority").alias("name"), F.col("o_totalprice").alias("score"))
    return placement.owned(findings, closure, screens).drop("repairability")


@query(f"""WITH {OWNED} SELECT screen, code, count(*) AS n FROM h JOIN f USING (file) GROUP BY screen, code""")
def screen_code_counts(spark: SparkSession, d: str) -> DataFrame:
    return placement.screen_counts(*_findings(spark, d))
