"""Small cases, by hand, of functions that the queries on the tables don't reach."""

import pytest
from pyspark.sql import functions as F

from fenestra.functions import text
from fenestra.operators import curation, metrics, reports, tree


def values(spark, column, cells, kind="string"):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], f"i int, c {kind}")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("c"))).collect()]


def test_json_object(spark):
    good = '{"a": [1, {"b": "}"}]}'
    cells = [good, f"```json\n{good}\n```", f"So: {good} done", f"{good} done", f"{good}, {good}", f"{good}] {{}}", f"{good}}} {{}}", "none", "", None, "x } y {"]
    assert values(spark, text.json_object, cells) == [good, good, good] + [None] * 8


def test_keywords_and_numbers(spark):
    assert values(spark, lambda c: text.split_keywords(c)[0], [["a", "字", "a"], [], None], "array<string>") == [["a"], [], []]
    assert values(spark, lambda c: text.split_keywords(c)[1], [["a", "字b", "字b"], [], None], "array<string>") == [["字b"], [], []]
    assert values(spark, text.number, [" 1.5 ", "", None, "x"]) == [1.5, 0.0, 0.0, None]


def test_contribution_at_the_borders_and_with_nulls(spark):
    rows = spark.createDataFrame([(0, 0.1, 0.01, 0.2, True), (1, 0.1, 0.01, 0.2, False), (2, 0.1, 0.0, 0.2, True), (3, -0.1, -0.2, -0.01, False), (4, -0.1, -0.2, 0.0, True), (5, None, 0.1, 0.2, True), (6, 0.1, None, None, True)], "i int, g double, l double, h double, s boolean")
    got = [r[0].split("_")[0] for r in rows.orderBy("i").select(reports.contribution(F.col("g"), F.col("l"), F.col("h"), F.col("s"))).collect()]
    assert got == ["limited", "no", "no", "rag", "no", "no", "no"]


def test_chosen_names(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "name string, n int")
    assert sorted(r["n"] for r in curation.chosen(rows, "name", ["b"]).collect()) == [2, 3]
    with pytest.raises(ValueError, match="unknown name: c, d"):
        curation.chosen(rows, "name", ["d", "b", "c"])


def test_markers_of_null_and_empty_files(spark):
    files = spark.createDataFrame([("r", '<EditText android:inputType="text"/>'), ("r", None), ("s", ""), ("t", "<a importantForAccessibility='no'/>")], "root string, xml string")
    got = {r["root"]: (r["input_widget"], r["input_type"], r["worth"]) for r in curation.marker_counts(files, ["root"], "xml").collect()}
    assert got == {"r": (1, 1, True), "s": (0, 0, False), "t": (0, 0, True)}


def test_best_configuration_breaks_ties_by_name(spark):
    rows = spark.createDataFrame([("b", 2, 1.0), ("a", 2, 1.0), ("c", 1, 0.0)], "name string, n int, cost double")
    assert [r[0] for r in metrics.best_configuration(rows, "name", [-F.col("n"), F.col("cost")]).collect()] == ["a"]


def test_last_by_id_with_a_column_named_node(spark):
    nodes = spark.createDataFrame([("d", 0, "x"), ("d", 4, "x"), ("d", 3, None)], "doc string, node int, id string")
    assert [tuple(r) for r in tree.last_by_id(nodes, "doc", F.col("id"), {"node": F.col("node")}).collect()] == [("d", "x", 4)]
