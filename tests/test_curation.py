"""Curation, contexts, runs, sources and sinks on small rows."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fenestra.functions import measures, text
from fenestra.operators import context, curation, runs, stats
from fenestra.sources import files, sinks
from fenestra.streaming import findings


def in_order(rows, keys, caps):
    taken, counts, out = {k: set() for k in keys}, {k: {} for k in caps}, {}
    for r in sorted(rows, key=lambda r: (r["o"], r["i"])):
        reason = next((k for k, c in keys.items() if tuple(r[x] for x in c) in taken[k]), None) or next((k for k, (c, n) in caps.items() if counts[k].get(tuple(r[x] for x in c), 0) >= n), None)
        out[r["i"]] = reason
        if reason is None:
            for k, c in keys.items():
                taken[k].add(tuple(r[x] for x in c))
            for k, (c, _) in caps.items():
                g = tuple(r[x] for x in c)
                counts[k][g] = counts[k].get(g, 0) + 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_cascade_is_the_pass_in_order(spark, seed):
    rng = random.Random(seed)
    rows = [{"i": i, "o": rng.randint(0, 30), "a": rng.randint(0, 25), "b": rng.randint(0, 12), "c": rng.randint(0, 4), "d": rng.choice("xyz")} for i in range(90)]
    keys, caps = {"same_a": ["a"], "same_bc": ["b", "c"]}, {"cap_d": (["d"], 9), "cap_cd": (["c", "d"], 2)}
    got = curation.cascade(spark.createDataFrame(rows), "i", ["o"], keys, caps).collect()
    assert {r.i: r.exclusion_reason for r in got} == in_order(rows, keys, caps)


def test_candidates(spark):
    rows = [("r", "ANDROID_XML_BUTTON_MISSING_ACCESSIBLE_NAME", "error", "xml_safe", 0.95, "/A[1]", "f", "Button", {"android:id": "@+id/x"}, 0), ("r", "ANDROID_XML_INPUT_WEAK_LABEL_OR_HINT", "error", "xml_safe", 0.9, "/A[2]", "f", "EditText", {"android:hint": "@string/gone"}, 1),
            ("r", "ANDROID_XML_NON_SEMANTIC_CLICKABLE", "warning", "requires_structure_or_code", 0.65, "/A[3]", "f", "View", {"z": "1", "a": "2"}, 0), ("r", "ANDROID_XML_TOUCH_TARGET_SIZE_REQUIRES_REVIEW", "info", "manual_review", 0.35, "/A[4]", "f", "Button", {"z": "1"}, 0)]
    found = spark.createDataFrame(rows, "root string, code string, severity string, repairability string, confidence double, selector string, file string, element string, attributes map<string,string>, unresolved int")
    meta = spark.createDataFrame([("r", "git@Host:a/b.git", "c1", "App", "p.a")], "root string, repository_url string, commit_hash string, app_name string, package_name string")
    got = {r.selector: r for r in curation.candidates(found, meta).collect()}
    assert set(got) == {"/A[1]", "/A[2]", "/A[3]"}
    assert (got["/A[1]"].selection_status, got["/A[1]"].confidence) == ("candidate", "high")
    assert (got["/A[2]"].selection_status, got["/A[2]"].confidence, got["/A[2]"].severity, got["/A[2]"].xml_safe) == ("excluded", "medium", "warning", False)
    assert (got["/A[3]"].difficulty, got["/A[3]"].selection_status, got["/A[3]"].relevant_attributes) == ("boundary", "candidate", '{"a":"2","z":"1"}')


def test_greedy_sample(spark):
    rows = [(i, f"app{i % 6}", f"f{i % 9}", "xy"[i % 2], f"{i * 7919 % 100:03}") for i in range(80)]
    df = spark.createDataFrame(rows, "i long, app string, file string, kind string, o string")
    picks = [r.i for r in curation.greedy_sample(df, "i", "app", "file", "kind", "o", {"x": 12, "y": 9}, per_app=4).collect()]
    apps = [f"app{i % 6}" for i in picks]
    assert len(picks) == 21 and max(map(apps.count, apps)) <= 4 and sum(i % 2 for i in picks) == 9


def picked_in_order(pool, quotas, per_app, most, new_apps_until):
    """Rows (i, app, file, kind, o): each pick looks at all that is left."""
    pool, picks, apps, files, wanted = list(pool), [], Counter(), set(), Counter(quotas)
    while len(picks) < most:
        offered = [r for r in pool if wanted[r[3]] > 0 and apps[r[1]] < per_app]
        if not offered:
            break
        in_file, kinds = Counter(r[1:3] for r in offered), {}
        for r in offered:
            kinds.setdefault(r[1], set()).add(r[3])
        fresh = len(apps) < new_apps_until
        best = min(offered, key=lambda r: (-len(kinds[r[1]]), (r[1] in apps) == fresh, r[1:3] not in files, -in_file[r[1:3]], apps[r[1]], r[4], r[0]))
        pool.remove(best)
        picks.append(best[0])
        apps[best[1]] += 1
        files.add(best[1:3])
        wanted[best[3]] -= 1
    return picks


@pytest.mark.parametrize("seed, frontier, fresh", [(1, 3, 5), (2, 8, 12), (3, 400, 7), (4, 1, 3)])
def test_greedy_sample_is_the_pass_in_order(spark, seed, frontier, fresh):
    rng = random.Random(seed)
    rows = [(i, f"app{rng.randrange(14)}", f"f{min(rng.randrange(12), rng.randrange(12))}", rng.choice("uvwxyz"), f"{rng.randrange(60):03}") for i in range(300)]
    quotas = {"u": 9, "v": 4, "w": 7, "x": 11, "q": 3}
    df = spark.createDataFrame(rows, "i long, app string, file string, kind string, o string")
    got = curation.greedy_sample(df, "i", "app", "file", "kind", "o", quotas, per_app=4, most=28, new_apps_until=fresh, frontier=frontier).orderBy("pick").collect()
    assert [r.i for r in got] == picked_in_order(rows, quotas, 4, 28, fresh)


def test_context(spark):
    issues = spark.createDataFrame([(1, "r", "Button", "Button", "/A[1]", {"id": "@+id/send", "text": "@string/go"}, 0), (2, "r", "View", "View", "/B", {"x": "y"}, 1)], "issue long, root string, component string, element string, selector string, attributes map<string,string>, position int")
    code = "\n".join(["import a"] * 10 + ["findViewById(R.id.send)"] + ["end"] * 10)
    app = spark.createDataFrame([("r", "src/A.kt", code.replace("R.id.send", "send")), ("r", "res/values/s.xml", '<string name="go">Go</string>'), ("q", "B.kt", "send")], "root string, path string, text string")
    got = context.app_context(issues, app, "issue", "root").orderBy("rank").collect()
    assert [(r.issue, r.path, r.kind, r.score, r.line_start, r.line_end) for r in got] == [(1, "src/A.kt", "controller_code", 5, 7, 15), (1, "res/values/s.xml", "resource_value", 4, 1, 1)]
    assert context.merged_context(context.app_context(issues, app, "issue", "root"), issues, "issue", 1).count() == 1


def test_runs(spark, tmp_path):
    call = {"provider_attempts": 2, "duration_ms": 5.0, "usage": {"total_tokens": 7}}
    states = [
        {"task_id": "t1", "model": "m", "group": "g", "status": "completed", "initial_errors": 4, "final_errors": 1, "rounds": [{"round": 1, "attempts": [{"status": "rejected", "model_call": call}, {"status": "accepted", "model_call": call}]}, {"round": 2, "attempts": []}]},
        {"task_id": "t2", "model": "m", "group": "g", "status": "provider_error", "initial_errors": 0, "final_errors": 0, "rounds": []},
    ]
    for i, s in enumerate(states):
        (tmp_path / f"{i}.json").write_text(json.dumps(s))
    (tmp_path / "bad.json").write_text("{not json")
    read = files.states(spark, f"{tmp_path}/*.json")
    got = {r.task_id: r for r in runs.result_rows(read).collect()}
    assert set(got) == {"t1", "t2"}
    assert (got["t1"].attempts, got["t1"].rejected, got["t1"].retries, got["t1"].total_tokens, got["t1"].repaired, got["t1"].rate) == (2, 1, 2, 14, 3, 0.75)
    assert (got["t2"].total_tokens, got["t2"].rate, got["t2"].failure) == (None, None, "infrastructure")
    tasks = spark.createDataFrame([(t, "m", "g") for t in ("t1", "t2", "t3")], "task_id string, model string, `group` string")
    assert sorted(r.task_id for r in runs.to_run(tasks, read, ["task_id", "model", "group"]).collect()) == ["t2", "t3"]
    assert runs.summary(runs.result_rows(read), ["model"]).first().completed == 1


def test_sources_and_sinks(spark, tmp_path):
    assert files.csv(spark, f"{tmp_path}/none.csv", "a", "b").collect() == []
    with pytest.raises(Exception):
        files.csv(spark, f"{tmp_path}/none.csv", "a", strict=True).collect()
    df = spark.createDataFrame([(1, "x,\"y\"\nz", None)], "a long, b string, c string")
    sinks.csv(df, f"{tmp_path}/out", ["a", "b"])
    assert [tuple(r) for r in files.csv(spark, f"{tmp_path}/out", "a", "b").collect()] == [("1", 'x,"y"\nz')]
    with pytest.raises(ValueError):
        sinks.csv(df, f"{tmp_path}/out2", ["a"], strict=True)
    manifest = spark.createDataFrame(sinks.checksums(spark, f"{tmp_path}/out").collect())
    assert sinks.changed_since(spark, f"{tmp_path}/out", manifest).collect() == []
    for n in (1, 2):
        sinks.staged(spark.range(n), f"{tmp_path}/table")
        assert spark.read.parquet(f"{tmp_path}/table").count() == n
    (tmp_path / "j").mkdir()
    (tmp_path / "j/a.json").write_text('[{"code":"a"}]')
    (tmp_path / "j/b.json").write_text('{"issues":[{"code":"b"},{"code":"c"}]}')
    (tmp_path / "j/c.json").write_text("{broken")
    assert sorted(r.code for r in files.json_list(spark, f"{tmp_path}/j", "issues", files.strings("code")).collect()) == ["a", "b", "c"]


def test_lint_and_layouts(spark, tmp_path):
    report = '<issues><issue id="ContentDescription" severity="Warning" message="m"><location file="f.xml" line="3"/><location file="g.xml"/></issue><issue id="Other" severity="Fatal" summary="s"/></issues>'
    df = spark.createDataFrame([("r.xml", report)], "path string, text string")
    assert [(r.type, r.code, r.file, r.line, r.locations) for r in files.lint_issues(df).collect()] == [("warning", "ANDROID_LINT_ContentDescription", "f.xml", "3", 2)]
    assert files.lint_issues(df, True).where("type = 'error' and message = 's'").count() == 1
    for p in ("app/src/main/res/layout/a.xml", "app/src/main/res/values/s.xml", "app/build/res/layout/b.xml", "app/src/test/res/layout/c.xml"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("<A/>")
    layouts, values = files.layouts(spark, str(tmp_path))
    assert [r.path.endswith("main/res/layout/a.xml") for r in layouts.collect()] == [True] and values.count() == 1
    assert layouts.first().root.endswith("app/src/main/res")


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"id": "1", "found_at": "2024-01-01T00:01:00Z", "severity": "error"}, {"id": "1", "found_at": "2024-01-01T00:02:00Z", "severity": "error"}, {"id": "2", "found_at": "2024-01-01T00:03:00Z", "severity": "odd"}]
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, rows)))
    once = findings.once(findings.read(spark, f"{tmp_path}/in"))
    q = once.writeStream.format("memory").queryName("seen").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("seen").count() == 2
    assert findings.level_counts(spark.table("seen")).first().error_count == 2


def test_hand_worked_statistics(spark):
    pairs = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "delta double")
    assert stats.wilcoxon(pairs).first().p_value == 0.25
    five = spark.createDataFrame([(False, True)] * 5, "a boolean, b boolean")
    assert stats.mcnemar(five, "a", "b").first().p_value == 0.0625
    row = spark.range(1).select(measures.contrast(measures.rgb(F.lit("#000")), measures.rgb(F.lit("#FFFFFFFF"))).alias("c"), measures.dp(F.lit("48 dip")).alias("d"), measures.dp(F.lit("12sp")).alias("n"), text.has_term(F.lit("userEmailField"), {"email"}).alias("t"), text.has_term(F.lit("emails"), {"email"}).alias("u"), text.repository_url(F.lit("git@GitHub.com:A/B.git/")).alias("r")).first()
    assert (round(row.c, 6), row.d, row.n, row.t, row.u, row.r) == (21.0, 48.0, None, True, False, "https://github.com/a/b")
