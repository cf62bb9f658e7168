"""What large tables broke: sides that were broadcast by the size of compressed files, pairs that were all made, sums held in one task."""

import random

from fenestra.operators import edits, matching, retrieval, rules, stats, tasks, tree
from pyspark.sql import functions as F

NS = 'xmlns:android="http://schemas.android.com/apk/res/android"'


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sides_of_edits_are_shuffled(spark, tmp_path):
    spark.range(200).selectExpr("cast(id as string) AS package", f"'res/layout/a.xml' AS path", f"'<L {NS}><V/></L>' AS content").write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))
    ops = files.selectExpr("package", "0 AS position", "'set_attribute' AS op", "path", "'/L[1]/V[1]' AS selector", "'hint' AS attribute", "'x' AS value", "cast(null AS string) AS name")
    assert "Broadcast" not in plan_of(edits.validated(ops, files))
    new, verdicts = edits.applied(files, ops)
    assert verdicts.where("accepted").count() == 200 and "Broadcast" not in plan_of(new)


def test_trees_leave_in_batches_and_whole(spark):
    rows = [(i, "<a>" + "<b k='1'/>" * (i % 7) + "</a>" if i % 11 else "<a") for i in range(1500)] + [(9999, None)]
    nodes = tree.parse(spark.createDataFrame(rows, "doc long, xml string").coalesce(1), "doc", "xml")
    batches = spark.sparkContext.accumulator(0)

    def count(some):
        for batch in some:
            batches.add(1)
            yield batch

    got = sorted(((r.doc, r.node if r.node is not None else -1, r.path, r.attrs) for r in nodes.mapInArrow(count, nodes.schema).collect()), key=lambda r: r[:2])
    want = [(d, n["node"] if n["node"] is not None else -1, n.get("path"), n["attrs"]) for d, x in rows for n in tree.nodes_of(x, "xml")]
    assert got == want and batches.value < 100


TASK, DOCUMENT = "task int, codes array<string>, terms array<string>", "doc_id int, codes array<string>, terms array<string>, views boolean, compose_only boolean, general boolean, length int"


def test_contenders_hold_what_all_pairs_give(spark):
    rng = random.Random(8)
    some = lambda n, of: [rng.choice(of) for _ in range(rng.randrange(n))]
    for sparse in (0.1, 0.7):
        wanted = spark.createDataFrame([(t, some(3, "abcdefgh"), some(4, [*"abcdefgh", None])) for t in range(60)] + [(98, None, ["a"]), (99, ["a"], None)], TASK)
        docs = spark.createDataFrame([(d, some(3, "abcdefgh"), some(5, [*"abcdefgh", None]), rng.random() < sparse, rng.random() < 0.2, rng.random() < 0.2, rng.randrange(3)) for d in range(150)] + [(998, None, None, True, False, False, 0)], DOCUMENT).repartition(3)
        related = spark.createDataFrame([(rng.randrange(60), rng.randrange(200)) for _ in range(150)], "task int, doc_id int")
        pairs = tasks.relevant(wanted, docs, related)
        for limit in (1, 2, 4):
            assert sorted(tasks.helpful(tasks.contenders(wanted, docs, related, limit), limit).collect()) == sorted(tasks.helpful(pairs, limit).collect())
        assert sorted(tasks.unhelpful(wanted, docs, None, 3, 5).collect()) == sorted(tasks.unhelpful(wanted, docs, pairs, 3, 5).collect())


def test_contenders_are_few(spark):
    """Each of 400 tasks shares a code and two terms with each of 400 documents."""
    wanted = spark.range(400).selectExpr("cast(id as int) AS task", "array('c') AS codes", "array('x', 'y') AS terms")
    docs = spark.range(400).selectExpr("cast(id as int) AS doc_id", "array('c') AS codes", "array('x', 'y') AS terms", "id % 2 = 0 AS views", "false AS compose_only", "false AS general", "cast(id % 5 as int) AS length")
    few = tasks.contenders(wanted, docs, spark.createDataFrame([(1, 7)], "task int, doc_id int"))
    assert few.count() <= 400 * 4 + 1 and {(r.task, r.place): r.doc_id for r in tasks.helpful(few).collect()}[1, 1] == 7
    assert tasks.unhelpful(wanted.limit(5), docs, None).count() == 0


def test_steps_give_the_best_of_all_matches(spark):
    rng = random.Random(4)
    for most in (3, 40):
        left = spark.createDataFrame([(i, rng.randrange(4), rng.choice([None, *range(most)])) for i in range(300)], "a long, g int, x int")
        right = spark.createDataFrame([(i, rng.randrange(3), rng.choice([None, *range(most)])) for i in rng.sample(range(1000), 200)], "b long, g int, y int").repartition(3)
        want = matching.best_match(left, right.where("y IS NOT NULL"), ["g"], ["a"], [(F.col("y") >= F.col("x")).desc_nulls_last(), F.col("b")]).selectExpr("a", "CASE WHEN y >= x THEN b END")
        assert sorted(matching.first_reaching(left, right, ["g"], "x", "y", "b", "b").select("a", "b").collect()) == sorted(want.collect())


def test_rows_meet_steps_not_groups(spark):
    """5,000 rows and 5,000 of the same group; steps are some tens."""
    left = spark.range(5000).selectExpr("id AS a", "1 AS g", "pmod(xxhash64(id, 1), 100000) AS x")
    right = spark.range(5000).selectExpr("id AS b", "1 AS g", "pmod(xxhash64(id, 2), 100000) AS y")
    found = matching.first_reaching(left, right, ["g"], "x", "y", "b", "b")
    assert found.count() == 5000 and found.select("b").distinct().count() < 60


def test_signed_ranks_of_large_groups_by_an_integral(monkeypatch):
    rng = random.Random(1)
    for distinct, size in ((9, 900), (400, 900), (2000, 700)):
        values = [rng.randrange(1, distinct) for _ in range(size)]
        ties = [(float(v), values.count(v)) for v in sorted(set(values))]
        for share in (0.4, 0.5, 0.53):
            up = [(v, int(k * share + rng.random())) for v, k in ties]
            monkeypatch.setattr(stats, "HELD", 1 << 62)
            held = stats.wilcoxon_p(up, ties)
            monkeypatch.setattr(stats, "HELD", 0)
            got = stats.wilcoxon_p(up, ties)
            assert got[0] == held[0] and abs(got[1] / held[1] - 1) < 1e-9


def test_signed_ranks_hold_no_list_of_sums():
    """20,000 differences have 400 million rank sums."""
    import tracemalloc

    ties = [(float(v), 2000) for v in range(1, 11)]
    tracemalloc.start()
    w, p = stats.wilcoxon_p([(v, 1015) for v, _ in ties], ties)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # By the normal distribution, corrected for ties, which is right to some per cent here.
    assert peak < 100e6 and w == 1015 * sum(2000 * i + 1000.5 for i in range(10)) and 0.05 < p < 0.12


def test_described_trees_are_compressed_tables_without_a_join(spark):
    rows = [(str(i), f"r{i % 3}", f"<L {NS}>" + "<V/>" * 5 + "</L>") for i in range(20)] + [(None, "r", "<L/>"), ("x", None, "<L")]
    nodes = rules.described(spark.createDataFrame(rows, "doc string, root string, xml string"))
    assert "FileScan parquet" in plan_of(nodes) and "ExistingRDD" not in plan_of(nodes)
    assert nodes.count() == 121 and {(r.doc, r.root) for r in nodes.collect()} == {(d, r) for d, r, _ in rows if d}
    assert nodes.where("error IS NOT NULL").select("doc").collect() == [("x",)]


def test_best_documents_without_all_pairs(spark, monkeypatch):
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(n)))
    docs = spark.createDataFrame([(f"d{i:03}", text(12)) for i in range(150)] + [(f"e{i}", "a b c") for i in range(9)] + [("none", None), ("odd", "中文 zz")], "doc string, text string").repartition(5)
    asked = spark.createDataFrame([(i, text(6)) for i in range(20)] + [(50, "a b c a"), (51, None), (52, "nowhere"), (53, "中文")], "ask int, text string")
    monkeypatch.setattr(retrieval, "BLOCK", 7)
    every = retrieval.bm25(asked, docs, "ask", "doc", F.col("text"), F.col("text")).select("ask", "doc", F.round("score", 6).alias("s")).collect()
    want = {}
    for r in sorted(every, key=lambda r: (r.ask, -r.s, r.doc)):
        want.setdefault(r.ask, []).append((r.doc, r.s))
    got = {}
    for r in sorted(retrieval.bm25_top(asked, docs, "ask", "doc", F.col("text"), F.col("text"), 3, 6).collect(), key=lambda r: (r.ask, r["rank"])):
        got.setdefault(r.ask, []).append((r.doc, r.score))
    assert got == {a: x[:3] for a, x in want.items()} and got[53][0][0] == "odd" and 52 not in got
    assert retrieval.bm25_top(asked, docs.where("false"), "ask", "doc", F.col("text"), F.col("text"), 3, 6).count() == 0


def test_hybrid_without_rows_of_pairs(spark, monkeypatch):
    rng = random.Random(9)
    words = ["label", "labels", "labelled", "hint", "hints", "button", "x", "中文", "view7"]
    docs = spark.createDataFrame([(i, rng.choice("ab"), " ".join(rng.choice(words) for _ in range(rng.randrange(9)))) for i in range(140)] + [(i, "a", "label hint") for i in range(200, 206)] + [(300, None, "label"), (301, "c", None)], "doc int, g string, text string").repartition(4)
    asked = docs.where("doc % 5 = 0").withColumnRenamed("doc", "ask")
    lexical = retrieval.normalised(retrieval.bm25(asked, docs, "ask", "doc", F.col("text"), F.col("text"), "g"), "ask").withColumnRenamed("score", "l")
    q, v = (retrieval.subword_vectors(df, [n, "g"], retrieval.tokens(F.col("text"))) for df, n in ((asked, "ask"), (docs, "doc")))
    near = retrieval.normalised(retrieval.sparse_cosine(q, v, "ask", "doc", ["g"]), "ask").withColumnRenamed("score", "d")
    pairs = lexical.join(near, ["ask", "doc"], "left").where("ask <> doc").select("ask", "doc", F.round(0.65 * F.col("l") + (1 - 0.65) * F.coalesce("d", F.lit(0.0)), 9).alias("s")).collect()
    want = {}
    for r in sorted(pairs, key=lambda r: (r.ask, -r.s, r.doc)):
        want.setdefault(r.ask, []).append((r.doc, r.s))
    monkeypatch.setattr(retrieval, "REMEMBERED", 3)
    for part, share in ((4096, 1024), (17, 5)):
        got = {}
        for r in sorted(retrieval.hybrid_top(asked, docs, "ask", "doc", "text", "g", 3, part=part, share=share).collect(), key=lambda r: (r.ask, r["rank"])):
            got.setdefault(r.ask, []).append((r.doc, r.hybrid))
        assert {a: [x for x, _ in y] for a, y in got.items()} == {a: [x for x, _ in y[:3]] for a, y in want.items()}
        assert all(abs(x[1] - y[1]) < 2e-9 for a in got for x, y in zip(got[a], want[a]))


def test_words_are_forgotten_between_documents():
    vectors = retrieval.SubwordVectors(64)
    vectors.known = {str(i): None for i in range(retrieval.REMEMBERED + 1)}
    assert abs((vectors.of(["hint", "label"]) ** 2).sum() - 1) < 1e-12 and vectors.of([]).sum() == 0


def test_states_of_loops_are_not_written_anew_each_round(spark, monkeypatch):
    from fenestra import checkpoints

    rows, plain = [], checkpoints.written

    def counted(df):
        out = plain(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(checkpoints, "written", counted)
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)], "source long, target long")
    got = tree.reachable(edges, spark.createDataFrame([(0,)], "item long"))
    assert sorted(r.item for r in got.collect()) == list(range(21)) and sum(rows) < 21 * 4


def test_layouts_of_a_small_file_are_made_in_many_tasks(spark, sf):
    from fenestra.plans.curate import _layouts

    assert _layouts(spark, sf).rdd.getNumPartitions() == 4


def test_files_are_parsed_once_for_edits(spark):
    files = spark.createDataFrame([("p", "res/layout/a.xml", f"<L {NS}><V/></L>")], "package string, path string, content string")
    ops = spark.createDataFrame([("p", 0, "set_attribute", "res/layout/a.xml", "/L[1]/V[1]", "hint", "x", None)], "package string, position int, op string, path string, selector string, attribute string, value string, name string")
    assert "MapInArrow" not in plan_of(edits.validated(ops, files)) and edits.validated(ops, files).first().rejected is None
