"""Manifests and merged candidates on small tables, odd rows included."""

from fenestra.operators import manifests as M


def test_combined_and_faults(spark):
    a, b = spark.createDataFrame([("x", 1), ("y", 2), (None, 3)], "k string, n int"), spark.createDataFrame([("x", "q")], "k string, other string")
    rows = M.combined({"a": a, "b": b}, "k", spark.createDataFrame([("x",), ("x",), (None,)], "k string"), ("a",))
    assert sorted((r.source_partition, r.k or "", r.n, r.other) for r in rows.collect()) == [("a", "", 3, None), ("a", "y", 2, None), ("b", "x", None, "q")]
    assert M.faults(rows, "k", {"a": 2, "b": 1}).count() == 0
    whole = M.combined({"a": a, "b": b}, "k")
    got = {r.check: (r.expected, r.found) for r in M.faults(whole, "k", {"a": 2, "c": 4}).collect()}
    assert got == {"rows of a": (2, 3), "rows of b": (0, 1), "rows of c": (4, 0), "repeated keys": (0, 1)}
    assert [tuple(r) for r in M.faults(whole.where("false"), "k", {"a": 1}).collect()] == [("rows of a", 1, 0)]


def test_merged_candidates(spark):
    apps = [("b", "B", "https://h.org/p/r.git", ["Z", "A"], False), ("a", "A", "https://h.org/p/r/", None, None), ("c", "C", "https://h.org/p/s", [], True), ("d", "D", "https://h.org/p/t", ["T"], True), ("e", "E", None, [], True), ("f", "F", "https://h.org/p/r", ["no match"], True)]
    frame = spark.createDataFrame(apps, "app_id string, app_name string, repository_url string, categories array<string>, active boolean")
    hits = [("a", "X", 3, ["q"]), ("b", "X", 5, ["q", "m"]), ("b", "Y", 1, []), ("c", "X", 1, ["s"]), ("d", "X", 9, []), ("e", "X", 9, []), ("f", "W", 9, ["w"])]
    matched = spark.createDataFrame(hits, "app_id string, code string, score int, evidence array<string>")
    gaps, there = spark.createDataFrame([("X",), ("X",), ("Y",)], "code string"), spark.createDataFrame([("https://h.org/p/t.git",), (None,)], "repository_url string")
    got = {r.app_id: r for r in M.merged_candidates(frame.repartition(3), matched, gaps, there).collect()}
    assert set(got) == {"a", "c"}
    r = got["a"]
    assert (r.app_name, r.repository_url, r.app_ids, r.categories, r.active) == ("A", "https://h.org/p/r/", ["a", "b"], ["A", "Uncategorized", "Z"], False)
    assert [tuple(t) for t in r.targets] == [("X", 5, ["m", "q"]), ("Y", 1, [])]
    assert got["c"].categories == ["Uncategorized"] and got["c"].active
    assert M.merged_candidates(frame, matched, gaps.where("false")).count() == 0
