"""Running sums and places over ranges, and what is built on them, against plain loops."""

import hashlib
import random
from itertools import accumulate

from fenestra.operators import ranking, sets


def test_running(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(9)) for i in range(0, 5000, 7)]
    frame = spark.createDataFrame(rows, "id long, n int").repartition(9)
    assert [r.position for r in ranking.numbered(frame, ["id"]).orderBy("id").collect()] == list(range(len(rows)))
    got = {r.id: r.before for r in ranking.running(frame, ["id"], {"before": frame["n"]}).collect()}
    assert got == dict(zip((i for i, _ in rows), (0, *accumulate(n for _, n in rows))))
    assert ranking.numbered(frame.where("false"), ["id"]).count() == 0


def test_ranks_and_minimums_without_groups(spark):
    rows = [(1, 5), (2, 5), (3, 1), (4, 9), (5, 5)]
    frame = spark.createDataFrame(rows, "k int, v int").repartition(3)
    assert {r.k: r.mid_rank for r in ranking.mid_ranks(frame, "v").collect()} == {3: 1.0, 1: 3.0, 2: 3.0, 5: 3.0, 4: 5.0}
    assert {r.k for r in ranking.until_met(frame, ["k"], "v", 2, 11).collect()} == {1, 2, 3}
    assert {r.k for r in ranking.until_met(frame, ["k"], "v", 4, 1).collect()} == {1, 2, 3, 4}


def test_tree_digest_in_ranges(spark):
    rng = random.Random(2)
    rows = [(g, f"p{rng.randrange(40)}", rng.choice(["x", "y", None])) for g in ("a", "b", None) for _ in range(70)] + [("one", "p", "x"), ("none", "p", None)]
    got = {r.g: (r.files, r.tree) for r in sets.tree_digest(spark.createDataFrame(rows, "g string, path string, digest string").repartition(6), ["g"], size=8).collect()}
    sha = lambda x: hashlib.sha256("\n".join(x).encode()).hexdigest()
    for g in {r[0] for r in rows}:
        mine = sorted(((p, d) for x, p, d in rows if x == g), key=lambda x: (x[0], x[1] or ""))
        parts = [sha(f"{p}\0{d}" for p, d in mine[i : i + 8] if d is not None) for i in range(0, len(mine), 8)]
        assert got[g] == (len(mine), parts[0] if len(parts) == 1 else sha(parts))
    assert len(got) == 5
