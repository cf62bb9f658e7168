"""Names, runs, prompts, trees and rules over the driver's tables, with the same results in SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fenestra.functions import text
from fenestra.operators import curation, metrics, prompts, reports, runs, sets, tree
from fenestra.operators.rules import findings
from fenestra.plans.curate import _layouts
from fenestra.plans.reports import query
from fenestra.sources import tables

WIDGETS = ("ImageButton", "AutoCompleteTextView", "EditText", "Spinner", "RadioButton", "ImageView", "CheckBox", "RatingBar", "TextView", "MapView")


@query("""SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN 'ImageButton' WHEN 1 THEN 'SelectionControl' WHEN 2 THEN 'EditText' WHEN 3 THEN 'SelectionControl' WHEN 4 THEN 'Button'
  WHEN 5 THEN 'ImageView' WHEN 6 THEN 'SelectionControl' WHEN 7 THEN 'SelectionControl' WHEN 8 THEN 'TextView' ELSE 'MapView' END AS kind FROM part""")
def widget_kinds(spark: SparkSession, d: str) -> DataFrame:
    tag = F.concat(F.lit("{ns}com.example."), F.lower("p_type"), F.lit("."), F.element_at(F.array(*map(F.lit, WIDGETS)), (F.col("p_partkey") % 10 + 1).cast("int")))
    return tables.read(spark, d, "part").select("p_partkey", text.view_type(text.local_name(tag)).alias("kind"))


@query(r"""SELECT p_partkey, replace(lower(p_name), ' ', '') AS identity, 'https://code.example/' || lower(p_brand) AS repository, 'layout/p' || p_partkey || '.xml' AS resource,
  '&lt;' || p_name || '&gt; &amp; &quot;' || p_brand || '&quot;' AS escaped, CASE WHEN p_partkey % 2 = 0 THEN 'part_' || p_partkey END AS named,
  lower(p_type) || ',' || replace(p_name, ' ', ',') AS tokens, p_name LIKE '%widget' AS is_widget, p_partkey % 4 IN (0, 1) AS said_yes, p_partkey % 3 = 0 AS empty FROM part""")
def names_and_references(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("p_partkey")
    key = i.cast("string")
    address = F.concat(F.when(i % 2 == 0, "  HTTPS://Code.Example/").otherwise("git@code.example:"), "p_brand", F.when(i % 3 == 0, ".git/ ").otherwise("//"))
    pointer = F.concat(F.when(i % 2 == 0, "@+id/part_").otherwise("@string/part_"), key)
    mark = F.element_at(F.array(*map(F.lit, (" TRUE", "Yes ", "no", ""))), (i % 4 + 1).cast("int"))
    return tables.read(spark, d, "part").select(
        "p_partkey", text.identity(F.col("p_name")).alias("identity"), text.repository_url(address).alias("repository"), text.resource_path(F.concat(F.lit("app\\src\\res/layout/../res\\layout\\p"), key, F.lit(".xml"))).alias("resource"),
        text.escaped(F.concat(F.lit("<"), "p_name", F.lit('> & "'), "p_brand", F.lit('"'))).alias("escaped"), text.reference(pointer, "id").alias("named"),
        F.array_join(text.name_tokens(F.concat(F.lower("p_type"), F.initcap("p_name"))), ",").alias("tokens"), text.has_term(F.col("p_name"), {"widget"}).alias("is_widget"),
        text.truth(mark, "loose").alias("said_yes"), text.is_empty(F.when(i % 6 == 0, " @null ").when(i % 3 != 0, F.col("p_name"))).alias("empty"),
    )


@query("""SELECT p_partkey, ((p_name LIKE '%widget%' OR p_name LIKE 'small%')::INT + (p_type = 'SMALL')::INT) AS evidence,
  concat_ws(';', CASE WHEN p_name LIKE '%widget%' OR p_name LIKE 'small%' THEN 'p_name' END, CASE WHEN p_type = 'SMALL' THEN 'p_type' END) AS found_in FROM part""")
def purpose_evidence(spark: SparkSession, d: str) -> DataFrame:
    return curation.evidence_count(tables.read(spark, d, "part"), "p_partkey", ["p_name", "p_type", "p_brand"], {"widget", "small"})


@query("""SELECT p_partkey, s AS score, s >= 50 AS accepted FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 0.0::DOUBLE ELSE least(p_size * 2.0::DOUBLE, 60.0::DOUBLE) + least(length(p_name) * 1.5::DOUBLE, 15.0::DOUBLE) END AS s FROM part)""")
def layout_scores(spark: SparkSession, d: str) -> DataFrame:
    score, accepted = curation.score_layout({"controls": (F.col("p_size"), 2.0, 60.0), "words": (F.length("p_name"), 1.5, 15.0)}, F.col("p_partkey") % 7 == 0)
    return tables.read(spark, d, "part").select("p_partkey", score.alias("score"), accepted.alias("accepted"))


@query("""SELECT CASE WHEN l_discount >= 0.08 THEN 'high' WHEN l_discount >= 0.05 THEN 'medium' ELSE 'low' END AS confidence, count(*) AS n FROM lineitem GROUP BY ALL""")
def confidence_labels(spark: SparkSession, d: str) -> DataFrame:
    return tables.read(spark, d, "lineitem").groupBy(curation.confidence_label(F.col("l_discount"), 0.08, 0.05).alias("confidence")).agg(F.count("*").alias("n"))


@query("""WITH u AS (SELECT DISTINCT user_id, event_type FROM events WHERE user_id IS NOT NULL), n AS (SELECT count(DISTINCT user_id) AS n FROM u)
  SELECT event_type AS doc_id, count(*) AS apps, round(count(*) / max(n), 9) AS share, count(*) / max(n) >= 0.75 AS common FROM u, n GROUP BY event_type""")
def document_shares(spark: SparkSession, d: str) -> DataFrame:
    """In how many users' events each type is, and whether in those of most."""
    rows = tables.read(spark, d, "events").where("user_id IS NOT NULL").select("user_id", F.col("event_type").alias("doc_id"))
    return prompts.document_share(rows, "user_id").withColumn("share", F.round("share", 9))


def _by_status(spark: SparkSession, d: str) -> DataFrame:
    return tables.read(spark, d, "lineitem").groupBy("l_suppkey", "l_linestatus").agg(F.count("*").alias("n"), (F.count("*") % 3).alias("remaining"))


@query("""WITH r AS (SELECT l_suppkey, l_linestatus AS s, count(*) AS n FROM lineitem GROUP BY ALL)
  SELECT l_suppkey, max(n) FILTER (s = 'F') AS "F_n", max(n % 3) FILTER (s = 'F') AS "F_remaining", max(n) FILTER (s = 'O') AS "O_n", max(n % 3) FILTER (s = 'O') AS "O_remaining" FROM r GROUP BY l_suppkey""")
def wide_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.wide(_by_status(spark, d), "l_suppkey", "l_linestatus", ["F", "O"], ["n", "remaining"])


@query("""WITH r AS (SELECT l_suppkey, l_linestatus, count(*) % 3 AS n FROM lineitem GROUP BY ALL)
  SELECT l_suppkey, min(n) AS remaining FROM r GROUP BY l_suppkey HAVING count(*) = 2 AND min(n) = max(n) AND min(n) > 0""")
def stuck_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.stuck(_by_status(spark, d), "l_suppkey", "remaining", 2)


def _states(spark: SparkSession, d: str) -> DataFrame:
    """Events as run states: what ended them is in their type."""
    t = F.col("event_type")
    status = F.when(t == "view", "completed").when(t == "click", "Running").when(t == "error", "failed").when(t == "signup", "provider_error")
    return tables.read(spark, d, "events").select("event_id", status.alias("status"), F.when((t == "error") & (F.col("event_id") % 2 == 0), "HTTP_503").when(t == "error", "no repair found").alias("stop_reason"))


REASON = """CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN 'unfinished' WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'infrastructure' END WHEN 'signup' THEN 'infrastructure' ELSE 'no_state' END"""


@query(f"SELECT event_id, {REASON} AS reason FROM events")
def failure_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _states(spark, d).select("event_id", runs.failure_reason().alias("reason"))


@query(f"SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT event_id FROM events WHERE {REASON} IS NULL AND event_id IS NOT NULL)")
def tasks_to_run(spark: SparkSession, d: str) -> DataFrame:
    """Orders are tasks, the event of the same number is a task's state."""
    return runs.to_run(tables.read(spark, d, "orders").select("o_orderkey"), _states(spark, d).withColumnRenamed("event_id", "o_orderkey"), ["o_orderkey"])


@query("SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT event_id FROM events WHERE event_id IS NOT NULL)")
def missing_from_right(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose number no event has."""
    return sets.only_left(tables.read(spark, d, "orders"), tables.read(spark, d, "events").withColumnRenamed("event_id", "o_orderkey"), "o_orderkey")


@query("""SELECT item_id, item_id % 3 <> 0 AS isolated, (item_id % 50 + 2)::INT AS injected_chars FROM benchmark""")
def prompt_audits(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of prompts about an item; in each third the files differ too."""
    i, task, asked = F.col("item_id"), F.lit("Repair the layout"), F.concat(F.lit("item "), F.col("item_id").cast("string"))
    block = F.concat(F.lit(prompts.OPEN + "\n"), F.expr("repeat('k', cast(item_id % 50 as int))"), F.lit("\n" + prompts.CLOSE))
    files = F.when(i % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    pairs = tables.read(spark, d, "benchmark").select("item_id", prompts.rendered(task, F.col("text"), asked).alias("plain"), prompts.rendered(task, files, asked, block).alias("guided"))
    return prompts.audited(pairs, "plain", "guided").select("item_id", "isolated", "injected_chars")


@query("""SELECT p_partkey, concat_ws(' ', 'Android XML accessibility repair', p_brand, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE 'Button' END) AS neutral,
  concat_ws(' ', 'Android XML accessibility repair', p_brand, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE 'Button' END, p_name) AS full_query FROM part""")
def issue_queries(spark: SparkSession, d: str) -> DataFrame:
    part = tables.read(spark, d, "part")
    rows = part.select("p_partkey", F.col("p_brand").alias("code"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise("").alias("component"), F.lit("Button").alias("element"), F.col("p_name").alias("message"), F.lit("").alias("repair_query"))
    return rows.select("p_partkey", prompts.issue_query(True).alias("neutral"), prompts.issue_query().alias("full_query"))


@query("""WITH RECURSIVE r(start, item) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT r.start, p_partkey // 2 FROM r JOIN part ON p_partkey = r.item) SELECT start, item FROM r""")
def include_closure(spark: SparkSession, d: str) -> DataFrame:
    """Each part includes the one of half its number: what is reached from each."""
    part = tables.read(spark, d, "part").select("p_partkey")
    return tree.reachable(part.select(F.col("p_partkey").alias("source"), F.expr("p_partkey div 2").alias("target")), part.withColumnRenamed("p_partkey", "item"))


@query(r"""SELECT doc_id::VARCHAR AS path, 'the' AS needle, nullif(list_position([contains(x, 'the') for x in string_split(text, chr(10))], true), 0)::INT AS line FROM documents""")
def first_line_numbers(spark: SparkSession, d: str) -> DataFrame:
    files = tables.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    return tree.first_lines(files, "path", "text", files.select("path", F.lit("the").alias("needle")))


@query("""SELECT p_partkey::VARCHAR AS doc, min(p_partkey) OVER (PARTITION BY p_name, p_size, p_partkey % 3 = 0, p_partkey % 2 = 0) AS class FROM part""")
def layout_classes(spark: SparkSession, d: str) -> DataFrame:
    """Layouts that are alike node by node, named by the smallest part of a class."""
    nodes = tree.parse(_layouts(spark, d), "doc", "xml")
    signed = tree.signature(nodes, "doc")
    return signed.join(signed.groupBy("signature").agg(F.min(F.col("doc").cast("long")).alias("class")), "signature").select("doc", "class")


@query("""SELECT p_partkey AS doc, name, CASE name WHEN 'a' THEN p_brand ELSE p_name END AS value, CASE name WHEN 'a' THEN 3 ELSE 2 END AS node FROM part, (VALUES ('a'), ('b')) n(name)""")
def last_of_each_id(spark: SparkSession, d: str) -> DataFrame:
    """Of elements with the same id, the last in document order."""
    el = lambda name, value: F.concat(F.lit(f'<e id="{name}" v="'), value, F.lit('"/>'))
    files = tables.read(spark, d, "part").select(F.col("p_partkey").alias("doc"), F.concat(F.lit("<r>"), el("a", F.col("p_type")), el("b", F.col("p_name")), el("a", F.col("p_brand")), F.lit("</r>")).alias("xml"))
    return tree.last_by_id(tree.parse(files, "doc", "xml"), "doc", F.col("attrs")["id"], {"value": F.col("attrs")["v"], "node": F.col("node")})


#: One widget for each rule, and what the rule says of it: (XML without the namespace's prefix, (code, severity, tag) of each finding).
SCREENS = (
    ('<ImageButton/>', (("MISSING_ACCESSIBLE_NAME", "error", "ImageButton"),)),
    ('<EditText hint="Phone"/>', (("PHONE_INPUTTYPE_MISSING", "warning", "EditText"),)),
    ('<EditText hint="Your password"/>', (("PASSWORD_INPUTTYPE_MISSING", "warning", "EditText"),)),
    ('<TextView text="Town" labelFor="@id/gone"/>', (("LABELFOR_TARGET_MISSING", "error", "TextView"),)),
    ('<Button text="Go on" importantForAccessibility="no"/>', (("INTERACTIVE_HIDDEN_FROM_ACCESSIBILITY", "error", "Button"),)),
    ('<Button text="Go on" focusable="false"/>', (("INTERACTIVE_NOT_FOCUSABLE", "warning", "Button"),)),
    ('<TextView text="Pale" textColor="#777777" background="#888888"/>', (("LOW_TEXT_CONTRAST", "warning", "TextView"),)),
    ('<ProgressBar/>', (("PROGRESS_MISSING_STATUS_LABEL", "warning", "ProgressBar"),)),
    ('<ImageView src="@drawable/xyz"/>', (("IMAGE_SEMANTICS_REQUIRES_REVIEW", "warning", "ImageView"),)),
    ('<FrameLayout focusable="true"/>', (("UNNAMED_FOCUSABLE_CONTAINER", "warning", "FrameLayout"),)),
    ('<EditText/>', (("INPUT_MISSING_LABEL_OR_HINT", "error", "EditText"),)),
    ('<EditText hint="12"/>', (("INPUT_WEAK_LABEL_OR_HINT", "warning", "EditText"),)),
    ('<Button text="Go on" layout_width="20dp" layout_height="20dp"/>', (("TOUCH_TARGET_TOO_SMALL", "warning", "Button"),)),
    ('<Button text="Go on" layout_width="@dimen/w" layout_height="@dimen/w"/>', (("TOUCH_TARGET_SIZE_REQUIRES_REVIEW", "info", "Button"),)),
    ('<Button text="Go on"/><TextView text="Town" labelFor="@id/b"/><TextView id="@+id/b" text="Place"/>', (("LABELFOR_TARGET_NOT_INPUT", "warning", "TextView"),)),
    ('<Button text="Go on"/>', ()),
)
EXPECTED = ", ".join(f"({i}, 'ANDROID_XML_{code}', '{severity}', '/LinearLayout[1]/{tag}[1]')" for i, (_, found) in enumerate(SCREENS) for code, severity, tag in found)


def _screens(spark: SparkSession, d: str) -> DataFrame:
    screens = [re.sub(r' (\w+)="', r' android:\1="', xml) for xml, _ in SCREENS]
    body = F.element_at(F.array(*map(F.lit, screens)), (F.col("p_partkey") % len(screens) + 1).cast("int"))
    key, head = F.col("p_partkey").cast("string"), F.lit('<LinearLayout xmlns:android="http://schemas.android.com/apk/res/android">')
    return tables.read(spark, d, "part").select(key.alias("doc"), F.lit("r").alias("root"), F.concat(F.lit("res/layout/p"), key, F.lit(".xml")).alias("path"), F.concat(head, body, F.lit("</LinearLayout>")).alias("xml"), "p_brand")


@query(f"SELECT p_partkey::VARCHAR AS doc, code, severity, selector FROM part JOIN (VALUES {EXPECTED}) e(i, code, severity, selector) ON p_partkey % {len(SCREENS)} = i")
def rule_codes(spark: SparkSession, d: str) -> DataFrame:
    """A screen for each part, of one widget that one rule is about; whatever else is found counts as well."""
    return findings(_screens(spark, d).drop("p_brand")).select("doc", "code", "severity", "selector")


@query("""WITH c AS (SELECT p_brand, count(*) FILTER (i IN (1, 2, 10, 11)) AS input_widget, 0::BIGINT AS input_type, count(*) FILTER (i IN (3, 14)) AS label_for, count(*) FILTER (i = 4) AS important_no,
  count(*) FILTER (i = 5) AS focusable_false, 0::BIGINT AS clickable FROM (SELECT p_brand, p_partkey % 16 AS i FROM part) GROUP BY p_brand) SELECT *, label_for + important_no + focusable_false > 0 AS worth FROM c""")
def marker_counts(spark: SparkSession, d: str) -> DataFrame:
    return curation.marker_counts(_screens(spark, d), ["p_brand"], "xml")


@query("""SELECT event_id, CASE WHEN event_id % 4 < 2 THEN props END AS reply FROM events""")
def json_replies(spark: SparkSession, d: str) -> DataFrame:
    """Objects in fences and in prose; replies without one, and with one that doesn't parse."""
    i, props = F.col("event_id") % 4, F.col("props")
    reply = F.when(i == 0, F.concat(F.lit("```json\n"), props, F.lit("\n```"))).when(i == 1, F.concat(F.lit("Here it is: "), props, F.lit(" Done."))).when(i == 2, "nothing to change").otherwise(F.concat(props, F.lit(" {")))
    return tables.read(spark, d, "events").select("event_id", text.json_object(reply).alias("reply"))


@query("""SELECT p_partkey, p_name || ';' || p_type AS plain, '按钮 ' || p_type AS chinese, CASE p_partkey % 3 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN 0 END AS cell FROM part""")
def keyword_cells(spark: SparkSession, d: str) -> DataFrame:
    plain, chinese = text.split_keywords(F.array("p_name", F.concat(F.lit("按钮 "), "p_type"), "p_name", "p_type"))
    cell = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"))).when(F.col("p_partkey") % 3 == 1, " ").otherwise("n/a")
    return tables.read(spark, d, "part").select("p_partkey", F.array_join(plain, ";").alias("plain"), F.array_join(chinese, ";").alias("chinese"), text.number(cell).alias("cell"))


@query("""SELECT user_id, count(*) AS candidates, sum(event_id % 3)::BIGINT AS model_calls, count(*) FILTER (event_type = 'view') AS blocked, count(*) FILTER (event_type <> 'error' AND event_id % 2 = 0) AS refusals FROM events GROUP BY user_id""")
def boundary_summaries(spark: SparkSession, d: str) -> DataFrame:
    t, i = F.col("event_type"), F.col("event_id")
    rows = tables.read(spark, d, "events").select("user_id", (i % 3).cast("string").alias("model_calls"), F.when(t == "view", "blocked_before_model").otherwise("called").alias("decision"), F.when((t != "error") & (i % 2 == 0), "True").otherwise("false").alias("refused"))
    return reports.boundary_summary(rows, ["user_id"])


@query("""WITH g AS (SELECT p_partkey, (p_size - 25) / 50::DOUBLE AS g FROM part) SELECT p_partkey, CASE WHEN g > 0 AND g - 0.2::DOUBLE > 0 AND p_partkey % 3 <> 0 THEN 'limited_measurable_rag_contribution'
  WHEN g < 0 AND g + 0.2::DOUBLE < 0 THEN 'rag_negative_repair_effect' ELSE 'no_measurable_rag_contribution' END AS outcome FROM g""")
def contributions(spark: SparkSession, d: str) -> DataFrame:
    gain = (F.col("p_size") - 25) / F.lit(50.0)
    return tables.read(spark, d, "part").select("p_partkey", reports.contribution(gain, gain - 0.2, gain + 0.2, F.col("p_partkey") % 3 != 0).alias("outcome"))


def _lists(spark: SparkSession, d: str) -> DataFrame:
    """Two lists of parts for each brand: the two smallest, and the four cheapest."""
    part = tables.read(spark, d, "part")
    by = lambda c, k: part.withColumn("place", F.row_number().over(Window.partitionBy("p_brand").orderBy(c, "p_partkey"))).where(F.col("place") <= k).withColumn("k", F.lit(k))
    rows = by("p_size", 2).unionByName(by("p_retailprice", 4)).groupBy("p_brand", "k").agg(F.array_sort(F.collect_list(F.struct("place", "p_partkey"))).alias("l"))  # four of a group at most
    return metrics.new_at_k(rows.withColumn("l", F.transform("l", lambda x: x["p_partkey"])), "p_brand", "k", "l")


LISTS = """a AS (SELECT p_brand, 2 AS k, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey)::INT AS rank, p_partkey AS doc_id, p_name FROM part QUALIFY rank <= 2),
  b AS (SELECT p_brand, 4 AS k, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey)::INT AS rank, p_partkey AS doc_id, p_name FROM part QUALIFY rank <= 4), u AS (FROM a UNION ALL FROM b)"""


@query(f"WITH {LISTS} SELECT p_brand, k, rank, doc_id, k = 2 OR doc_id NOT IN (SELECT doc_id FROM a) AS is_new FROM u")
def new_in_longer_lists(spark: SparkSession, d: str) -> DataFrame:
    return _lists(spark, d)


@query(f"""WITH {LISTS}, s AS (SELECT x.p_brand, x.k, x.doc_id AS first, y.doc_id AS second, list_distinct(string_split(x.p_name, ' ')) AS a, list_distinct(string_split(y.p_name, ' ')) AS b FROM u x JOIN u y ON x.p_brand = y.p_brand AND x.k = y.k AND x.rank < y.rank)
  SELECT p_brand, k, first, second, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) AS similarity FROM s WHERE len(list_intersect(a, b)) >= 0.3 * (len(a) + len(b) - len(list_intersect(a, b)))""")
def alike_in_lists(spark: SparkSession, d: str) -> DataFrame:
    words = tables.read(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.array_distinct(F.split("p_name", " ")).alias("words"))
    return metrics.alike_in_lists(_lists(spark, d).join(words, "doc_id"), "p_brand", "k", "words", 0.3).withColumn("similarity", F.round("similarity", 6))


@query("""SELECT p_type, p_brand FROM (SELECT p_type, p_brand, count(*) AS n, max(p_retailprice) AS m FROM part GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY n DESC, m, p_brand) = 1""")
def best_configurations(spark: SparkSession, d: str) -> DataFrame:
    per = tables.read(spark, d, "part").groupBy("p_type", "p_brand").agg(F.count("*").alias("n"), F.max("p_retailprice").alias("m"))
    return metrics.best_configuration(per, "p_brand", [-F.col("n"), F.col("m")], ["p_type"])


@query("SELECT n_nationkey, n_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name IN ('ASIA', 'EUROPE')")
def chosen_regions(spark: SparkSession, d: str) -> DataFrame:
    region = curation.chosen(tables.read(spark, d, "region"), "r_name", ["EUROPE", "ASIA", "EUROPE"])
    return tables.read(spark, d, "nation").join(region, F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey", "n_name")
