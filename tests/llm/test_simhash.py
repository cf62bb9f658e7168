import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fenestra.llm import simhash as s
from fenestra.llm.common import cut
from fenestra.operators.graph import components


def brute(values, tau=3):
    unique = sorted(set(values))
    root = {v: v for v in unique}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(unique):
        for b in unique[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= tau:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {v: find(v) for v in unique}


def clusters(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 1, 5, 40])):
            v = centre
            for _ in range(rng.randint(0, 3)):
                v ^= 1 << rng.randrange(64)
            out.append(v - (1 << 64) if v >> 63 else v)
    return out


@pytest.mark.parametrize("bucket", [4096, 20])
def test_links_lose_nothing(spark, bucket):
    values = clusters(5, 120)
    df = spark.createDataFrame([(v,) for v in set(values)], "fp long")
    roots = {r.u: r.root for r in components(s.edges(df, df.count(), bucket=bucket)).collect()}
    want = brute(values)
    assert {v: roots.get(v, v) for v in want} == want


@pytest.mark.parametrize("total", [10**3, 10**6, 10**10])
def test_plan_finds_all_pairs(total):
    rng = np.random.default_rng(1)
    sample = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    parts = s.chosen(sample, total)
    assert sum(t + 1 for _, t in parts) == 4
    used = 0
    for mask, _ in parts:
        assert not used & mask
        used |= mask
    masks = s.probes(parts)
    for _ in range(2000):
        a = int(rng.integers(0, 1 << 63))
        b = a
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            b ^= 1 << int(bit)
        assert any(a & m == b & m for m in masks)


def test_fingerprint_by_hand():
    from xxhash import xxh64_intdigest

    def by_bits(text):
        words = text.encode().lower().split()
        if not words:
            return 0
        grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
        h = [xxh64_intdigest(g, 42) for g in grams]
        v = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        return v - (1 << 64) if v >> 63 else v

    for text in ["", "One", "One two", "a b c", "A b C d e f a b c", "x " * 300 + "Ä ä"]:
        assert s.fingerprint_of(text.encode()) == by_bits(text)


def test_query_against_brute_force(spark, sf):
    got = s.op5_simhash(spark, sf).collect()
    fp = {r.doc_id: int(r.fingerprint, 16) for r in got}
    signed = {d: v - (1 << 64) if v >> 63 else v for d, v in fp.items()}
    roots = brute(signed.values())
    lowest = {}
    for d, v in signed.items():
        lowest[roots[v]] = min(lowest.get(roots[v], d), d)
    assert {r.doc_id: r.component_id for r in got} == {d: lowest[roots[v]] for d, v in signed.items()}


def test_deduplicated(spark):
    texts = [(3, "a b c d"), (1, "a b c d"), (2, "other words are here"), (2, "other words are here"), (None, "a b c d"), (9, None)]
    out = s.deduplicated(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted(str(r.doc_id) for r in out) == ["1", "2", "9", "None"]


def edited_copies(seed, groups, copies, share):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    out = []
    for g in range(groups):
        base = [word() for _ in range(rng.randint(120, 300))]
        for c in range(copies):
            words = list(base)
            for _ in range(int(len(words) * share * (c > 0))):
                words[rng.randrange(len(words))] = word()
            out.append((g * 1000 + c, " ".join(words), g))
    return out


@pytest.mark.parametrize("crowd", [50_000, 3])
def test_similar_texts_are_linked(spark, crowd, monkeypatch):
    monkeypatch.setattr(s.similar_edges, "__defaults__", (crowd,))
    docs = edited_copies(3, 60, 5, 0.012)  # five-word shingles alike by about 0.88
    found = s.near_duplicates(spark.createDataFrame([(a, b) for a, b, _ in docs], "doc_id long, text string"), similar=True).collect()
    group = {a: g for a, _, g in docs}
    lowest = {g: g * 1000 for g in set(group.values())}
    assert all(group[r.component_id] == group[r.doc_id] for r in found)
    assert sum(r.component_id == lowest[group[r.doc_id]] for r in found) >= 0.95 * len(found)


def test_crowded_bands_lose_no_link(spark):
    """Families in bands of many members, with and without a centre: the components are those of the path without crowds."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(60)]
    docs = []
    for family in range(14):  # of one passage, and a part of their own by families
        own = [f"f{family}x{i}" for i in range(25)]
        for copy in range(rng.randint(1, 12)):
            words = passage + own
            words[rng.randrange(60, 85)] = f"c{family}x{copy}"
            docs.append((len(docs), " ".join(words)))
    docs += [(1000 + i, x) for i, (x, _) in enumerate(changed_pairs(9, 60, 0.8, 0.9))] + [(2000 + i, y) for i, (_, y) in enumerate(changed_pairs(9, 60, 0.8, 0.9))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    texts = df.select(F.xxhash64("text").alias("t"), "text")
    nodes = cut(texts.select("t", s.codes("text").alias("c")).select("t", "c.*").dropDuplicates(["t"]))
    of = lambda crowd: {r.u: r.root for r in components(s.similar_edges(nodes, texts, crowd)).collect()}
    whole, crowded = of(50_000), of(3)
    assert whole == crowded and len(whole) > 80


def test_a_family_gives_a_tree():
    n = 300
    code, sets = np.zeros((n, s.MINIMA), np.uint8), [np.arange(100, dtype=np.uint64)] * n
    assert len(s.similar_forest(np.arange(n), None, code, sets)) == n - 1
    assert len(s.similar_forest(np.arange(n), np.arange(n) % 2, code, sets)) == n - 1
    assert s.similar_forest(np.zeros(n, np.int64), None, code, sets) == []


def test_documents_that_share_an_id(spark):
    rows = [(1, "one text of its own here now", "b"), (1, "one text of its own here now", "a"), (1, "quite another text under the same id", "c"), (2, "one text of its own here now", "d"), (None, "one text of its own here now", "e"), (3, None, "f"), (4, "", "g")]
    kept = sorted((str(r.doc_id), r.text) for r in s.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect())
    assert kept == [("1", rows[0][1]), ("1", rows[2][1]), ("3", None), ("None", rows[0][1])]


def test_code_starts_with_the_fingerprint():
    for text in [b"", b"one", b"one two three four five six", b"x y z " * 500]:
        fp, code, probes = s.code_of(text)
        assert fp == s.fingerprint_of(text) and len(code) == s.CODE // 8 and len(probes) == (s.TABLES * 64 // s.WIDTH if text else 0)


def shared_five(a, b):
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def changed_pairs(seed, n, lowest, highest):
    """Pairs of texts by turns with one block added, one block put in the place of another, and scattered words changed, alike by lowest to highest."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    out = []
    while len(out) < n:
        base = [word() for _ in range(rng.randint(120, 300))]
        share, words = rng.uniform(0.02, 0.3), list(base)
        if len(out) % 3 == 0:
            words += [word() for _ in range(int(len(base) * share))]
        elif len(out) % 3 == 1:
            k = int(len(base) * share / 2)
            words[:k] = [word() for _ in range(k)]
        else:
            for i in rng.sample(range(len(base)), int(len(base) * share / 5)):
                words[i] = word()
        a, b = " ".join(base), " ".join(words)
        if lowest <= shared_five(a, b) < highest:
            out.append((a, b))
    return out


def linked(spark, pairs):
    docs = [(2 * i + k, text) for i, pair in enumerate(pairs) for k, text in enumerate(pair)]
    found = {r.doc_id: r.component_id for r in s.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), similar=True).collect()}
    return [found[2 * i] == found[2 * i + 1] for i in range(len(pairs))]


def test_block_and_word_changes_are_linked_from_four_fifths(spark):
    near, far = changed_pairs(7, 240, 0.8, 0.9), changed_pairs(8, 120, 0.6, 0.78)
    found = linked(spark, near + far)
    print("linked", [sum(found[k : 240 : 3]) for k in range(3)], "of 80 each;", sum(found[240:]), "of 120 below")
    assert sum(found[:240]) >= 239 and sum(found[240:]) == 0


def chain(n, step):
    """Texts in windows of the same words, each alike to the next only."""
    words = [f"w{i}" for i in range(n * step + 200)]
    return [" ".join(words[i * step : i * step + 200]) for i in range(n)]


@pytest.mark.parametrize("crowd", [50_000, 3])
def test_chains_are_linked_whole(spark, crowd, monkeypatch):
    monkeypatch.setattr(s.similar_edges, "__defaults__", (crowd,))
    docs = [(i, t) for i, t in enumerate(chain(30, 18))] + [(100 + i, "far " + t) for i, t in enumerate(" ".join(f"x{k}" for k in range(j, j + 50)) for j in (0, 40))]
    found = {r.doc_id: r.component_id for r in s.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), similar=True).collect()}
    assert all(found[i] == 0 for i in range(30)) and found[100] != found[101]


def test_no_bucket_is_larger_than_two_blocks(spark, monkeypatch):
    made, seen = s._forests, spark.sparkContext.accumulator(0)

    def strict(tau):
        found = made(tau).func

        def bounded(buckets: pa.Array) -> pa.Array:
            seen.add(sum(n > 60 for n in buckets.value_lengths().to_pylist()))
            return found(buckets)

        return F.arrow_udf(bounded, s.EDGE)

    monkeypatch.setattr(s, "_forests", strict)
    values = {0} | {1 << i | 1 << j for i in range(0, 64, 2) for j in range(0, 64, 3)}
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    roots = {r.u: r.root for r in components(s.edges(df, df.count(), bucket=20)).collect()}
    want = brute([v - (1 << 64) if v >> 63 else v for v in values])
    assert {v: roots.get(v, v) for v in want} == want and seen.value == 0
