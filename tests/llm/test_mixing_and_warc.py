import hashlib
import random
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from fenestra.llm import mixing, warc


def test_targets_by_hand(spark):
    rows = [("a", 10)] * 10 + [("b", 10)] * 10 + [("c", 1)] * 10 + [(None, 10)] * 2
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    # 230 words; weights 1, 2, 3, 1: c stops at 30; the rest shares 200 by 1, 2, 1
    assert got == {"a": 50.0, "b": 100.0, "c": 30.0, None: 50.0}


def test_taken_is_near_target_and_moments_follow_schedules(spark, sf):
    rows = mixing.op8_mixing(spark, sf).collect()
    taken, target, biggest = defaultdict(int), {}, defaultdict(int)
    sources = {r.doc_id: r.source for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in rows:
        s = sources[r.doc_id]
        taken[s] += r.taken
        target[s] = r.target
        biggest[s] = max(biggest[s], r.size)
        assert r.taken <= 3 * r.size
    assert all(abs(taken[s] - target[s]) <= biggest[s] for s in target)
    again = {(r.doc_id, r.taken, r.first_moment) for r in mixing.op8_mixing(spark, sf).collect()}
    assert again == {(r.doc_id, r.taken, r.first_moment) for r in rows}


def test_moment_inverts_the_integral(spark):
    schedule = ((0.0, 0.0), (0.25, 2.0), (0.75, 1.0), (1.0, 0.0))

    def integral(x):
        total = 0.0
        for (a, u), (b, v) in zip(schedule, schedule[1:]):
            w = min(max(x - a, 0), b - a)
            total += u * w + (v - u) / (b - a) * w * w / 2
        return total

    for r in spark.range(101).select((F.col("id") / 100).alias("y")).select("y", mixing.moment(F.col("y"), schedule).alias("t")).collect():
        assert abs(integral(r.t) - r.y * integral(1.0)) < 1e-9


def test_training_order_is_sorted(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text")
    rows = mixing.training_order(mixing.plan(mixing.sized(docs))).collect()
    positions = [r.position for r in rows]
    assert positions == sorted(positions)
    # A position is what training has read by then, but for the rounding of sources to whole documents.
    read, biggest, sources = 0, max(r.size for r in rows), len({r.source for r in rows})
    for r in rows:
        assert abs(read + r.size / 2 - r.position) <= biggest * sources
        read += r.size


def test_running_sums_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 3)
    monkeypatch.setattr(mixing, "GROUP", 4)
    rng = random.Random(3)
    docs = [(i if i % 7 else None, "a" if rng.random() < 0.6 else rng.choice(["b", None, "c"]), " ".join("w" * 3 for _ in range(rng.randint(0, 9))) + f" {i}") for i in range(300)]
    got = mixing.plan(mixing.sized(spark.createDataFrame(docs, "doc_id long, source string, text string"))).collect()
    key = lambda d: hashlib.md5((str(d[0]) if d[0] is not None else d[2]).encode()).hexdigest()
    want, targets = [], {r.source: (r.target, r.source_size) for r in got}
    for s in targets:
        at, (target, size) = 0, targets[s]
        passes = min(int(target // size), 3)
        for d in sorted((d for d in docs if d[1] == s), key=key):
            n = len(d[2].split())
            want.append((str(d[0]), str(s), n, n * (passes + (passes < 3 and 2 * at + n <= 2 * (target - passes * size)))))
            at += n
    assert sorted((str(r.doc_id), str(r.source), r.size, r.taken) for r in got) == sorted(want)


def test_targets_against_brute_force(spark):
    rng = random.Random(5)
    for _ in range(4):
        sizes = {f"s{i:02d}": rng.choice([0, 1, 5, 50, 1000, 20000]) for i in range(11)}
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
        weight = {s: i % 3 + 1.0 for i, s in enumerate(sorted(sizes))}
        full = set()
        while True:
            rest = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
            level = rest / sum(w for s, w in weight.items() if s not in full)
            new = {s for s in sizes if s not in full and weight[s] * level > 3 * sizes[s]}
            if not new:
                break
            full |= new
        for s in sizes:
            assert abs(got[s] - (3 * sizes[s] if s in full else weight[s] * level)) < 1e-6


def test_audit_of_repeated_and_damaged_pages(spark, tmp_path):
    damaged = [i for i in range(60) if hashlib.md5(str(i).encode()).hexdigest()[0] in "0f"]
    pages = [(i, f"http://{i}", f"page {i}") for i in range(60)] + [(damaged[0], "u", "other")] * 3 + [(None, None, None)] * 2
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(warc.OP6_SQL)
    got = warc.op6_fixity(spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall())) and len(got) == len(damaged) + 3


def test_one_huge_volume_and_ties(spark):
    rows = [("v", (i // 3) * 1000, 1000, i % 5, f"d{i % 2}") for i in range(6000)]
    schema = "volume string, offset long, length long, record_id long, digest string"
    ours = spark.createDataFrame(rows, schema)
    theirs = spark.createDataFrame([r for i, r in enumerate(rows) if i != 3000], schema)
    gone = rows[3000]
    got = warc.audit(ours, theirs).collect()
    assert [(r.offset, r.record_id) for r in got] == [(gone[1], gone[3])]


def test_audit_finds_what_is_wrong(spark):
    rows = [("v", i * 30000, 30000, i, f"d{i}") for i in range(200)] + [(None, 0, 5, 0, "n")]
    schema = "volume string, offset long, length long, record_id long, digest string"
    ours = spark.createDataFrame(rows, schema)
    bad = [(v, o, n, i, "rot" if i == 17 and v else d) for v, o, n, i, d in rows if i != 150] + [("v", 9000000, 5, 999, "x"), ("w", 0, 1, 1, "y")]
    got = {(r.volume, r.record_id, r.state) for r in warc.audit(ours, spark.createDataFrame(bad, schema)).collect()}
    assert got == {("v", 17, "altered"), ("v", 150, "missing"), ("v", 999, "extra"), ("w", 1, "extra")}
    assert warc.audit(ours, ours).collect() == []
