"""Selections against passes in order over the whole pool."""

import random
from collections import Counter
from itertools import chain, combinations

import pytest
from pyspark.sql import functions as F

from fenestra.operators import cover

SCHEMA = "i long, app string, category string, codes array<string>, all_codes array<string>, safe int, unseen int, size int"


def pool(seed, n=120, apps=60):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        codes = rng.sample("abcdefghij", rng.randint(1, 4))
        out.append((i, f"app{rng.randrange(apps)}", rng.choice("XYZ"), codes, codes + rng.sample("klmnop", rng.randint(0, 3)), rng.randint(1, 15), rng.randint(0, 1), rng.randint(1, 16)))
    return out


def rare(rows, at=3):
    often = Counter(c for r in rows for c in set(r[at]))
    return {r[0]: sum(1 / often[c] for c in sorted(set(r[at]))) for r in rows}


def in_order(rows, target, cap):
    """Each pick looks at all that is left."""
    rarity, left, picks, categories = rare(rows), list(rows), [], Counter()
    safe, every, limit = set(), set(), cap
    while left and len(picks) < target:
        some = [r for r in left if limit <= 0 or categories[r[2]] < limit]
        if not some:
            if limit > 0:
                limit += 1
                continue
            break
        best = max(some, key=lambda r: (len(set(r[3]) - safe), rarity[r[0]], categories[r[2]] == 0, len(set(r[4]) - every), min(r[5], 10), -r[5], r[1], r[0]))
        picks.append(best[0])
        left.remove(best)
        categories[best[2]] += 1
        safe.update(best[3])
        every.update(best[4])
    return picks


@pytest.mark.parametrize("seed, target, cap, frontier", [(1, 12, 0, 7), (2, 30, 4, 5), (3, 200, 3, 50), (4, 9, 2, 500)])
def test_marginal_is_the_pass_in_order(spark, seed, target, cap, frontier):
    rows = pool(seed)
    df = cover.rarity(spark.createDataFrame(rows, SCHEMA), "i", "codes").withColumns({"few": F.least("safe", F.lit(10)), "less": -F.col("safe")})
    terms = [cover.New("codes"), cover.Fixed("rarity"), cover.Fresh("category"), cover.New("all_codes"), cover.Fixed("few"), cover.Fixed("less")]
    got = cover.marginal(df, "i", terms, target, "app", "category", cap, frontier).orderBy("pick").collect()
    assert [r.i for r in got] == in_order(rows, target, cap)


@pytest.mark.parametrize("need", [1, 3])
def test_elements_that_are_needed_more_than_once(spark, need):
    rows = pool(7)
    counts, left, want = Counter(), list(rows), []
    for _ in range(25):
        best = max(left, key=lambda r: (sum(counts[c] < need for c in set(r[3])), len(set(r[3])), r[1], r[0]))
        want.append(best[0])
        left.remove(best)
        counts.update(set(best[3]))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("kinds", F.size("codes"))
    got = cover.marginal(df, "i", [cover.New("codes", need), cover.Fixed("kinds")], 25, "app", frontier=6).orderBy("pick").collect()
    assert [r.i for r in got] == want


def two_phases(rows, hard, target, least, most):
    apps = lambda rs: {r[1] for r in rs}
    codes = lambda rs: {c for r in rs for c in r[3]} & set(hard)
    bounded = [r for r in rows if r[7] <= most]
    if len(apps(bounded)) >= target and codes(rows) <= codes(bounded):
        rows = bounded
    often = Counter(c for r in rows for c in set(r[3]))
    picks, seen, covered, categories = [], set(), set(), Counter()

    def take(some, due=False):
        best = max(some, key=lambda r: (len(set(r[3]) & set(hard) - covered), len(set(r[3]) - covered), int(due and r[6]), r[6], int(categories[r[2]] == 0), len(set(r[3])), r[1], r[0]))
        picks.append(best)
        seen.add(best[1])
        covered.update(best[3])
        categories[best[2]] += 1

    for c in sorted(codes(rows), key=lambda c: (often[c], c)):
        if c not in covered and len(picks) < target:
            some = [r for r in rows if r[1] not in seen and c in r[3]]
            if some:
                take(some)
    while len(picks) < target:
        unseen, slots = sum(r[6] for r in picks), target - len(picks)
        take([r for r in rows if r[1] not in seen], unseen < least and least - unseen >= slots)
    return [r[0] for r in picks]


@pytest.mark.parametrize("seed, target, least, most, frontier", [(1, 12, 6, 12, 4), (2, 20, 17, 12, 9), (3, 8, 8, 3, 500), (4, 30, 25, 14, 20)])
def test_covering_is_the_two_phases(spark, seed, target, least, most, frontier):
    rows, hard = pool(seed), ["a", "b", "c", "zz"]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"hard": F.array_intersect("codes", F.lit(hard)), "kinds": F.size("codes")})
    terms = [cover.New("hard"), cover.New("codes"), cover.Due("unseen", least, target), cover.Fixed("unseen"), cover.Fresh("category"), cover.Fixed("kinds")]
    got = cover.covering(df, "i", "app", "codes", hard, terms, target, "app", "size", most, frontier).orderBy("pick").collect()
    assert [r.i for r in got] == two_phases(rows, hard, target, least, most)
    assert len({rows[r.i][1] for r in got}) == target


def test_too_few_groups(spark):
    with pytest.raises(ValueError, match="only"):
        cover.covering(spark.createDataFrame(pool(1, 10, 3), SCHEMA), "i", "app", "codes", [], [cover.New("codes")], 9, "app")


@pytest.mark.parametrize("seed", range(4))
def test_best_subset(spark, seed):
    rng = random.Random(seed)
    findings = [(k, rng.choice("abcdef"), rng.random() < 0.5, rng.random() < 0.6) for k in range(40)]
    rows = [(g, f"s{i}", rng.randint(0, 5), rng.sample(findings, rng.randint(0, 14))) for g in range(6) for i in range(rng.randint(1, 7))]
    df = spark.createDataFrame(rows, "g int, name string, score int, found array<struct<id:int,code:string,error:boolean,safe:boolean>>")

    def worth(combo):
        every = {f[0]: f for r in combo for f in r[3]}.values()
        safe = [f for f in every if f[3]]
        return (len({f[1] for f in safe}), -max(len(safe) - 8, 0), len({f[1] for f in every if f[2]}), len({f[1] for f in every}), min(len(safe), 5), sum(r[2] for r in combo), -len(combo))

    want = {}
    for g in range(6):
        top = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))[:5]
        want[g] = [r[1] for r in (top if len(top) < 2 else max(chain(combinations(top, 2), combinations(top, 3)), key=worth))]
    got = {r.g: r.chosen for r in cover.best_subset(df, "g", "name", "score", "found", 5, too_many=8).collect()}
    assert got == want


def test_evidence_first(spark):
    rows = [("a", i, int(i in (3, 5, 9))) for i in range(12)] + [("b", i, i) for i in range(2)]
    got = cover.with_evidence_first(spark.createDataFrame(rows, "g string, r int, e int"), "g", "r", "e", 3, 3).orderBy("g", "place").collect()
    assert [(r.g, r.r) for r in got] == [("a", 3), ("a", 5), ("a", 0), ("b", 0), ("b", 1)]
