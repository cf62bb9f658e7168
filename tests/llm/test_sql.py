"""Operators that SQL can express, against DuckDB."""

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from fenestra.llm import backoff, lines, queries


def plain(v):
    return (None if math.isnan(v) else float(f"{v:.9g}")) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    want = con.sql(queries.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(map(repr, (tuple(plain(r[c]) for c in columns) for r in df.collect()))) == sorted(map(repr, (tuple(plain(r[i]) for i in at) for r in want.fetchall())))


def test_common_lines_deplete(spark):
    shared = "one line that every page of this host repeats word for word"
    docs = [(i, f"{shared}\nshort {i}", "h") for i in range(40)] + [(100 + i, f"{shared}\n\n" + " ".join(f"own{i}{k}" for k in range(30)) + f"\n{shared.upper()}", "h") for i in range(3)]
    docs += [(200 + i, shared + " elsewhere", "other") for i in range(5)] + [(300 + i, "the same text over and over in all of its many copies", "h") for i in range(50)]
    docs += [(400, None, "x"), (401, "x", None), (None, shared + " and ten words of its own that nobody else has", None), (300, docs[48][1], "h")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in lines.judged(df).collect()}
    assert not any(got[i].kept for i in range(40)) and all(got[100 + i].kept for i in range(3))
    assert all(got[200 + i].kept for i in range(5)) and not any(got[300 + i].kept for i in range(50))
    assert got[400].left is None and got[401].left == 1 and got[None].kept
    clean = {r.doc_id: r.text for r in lines.cleaned(df).collect()}
    assert sorted(clean, key=str) == sorted((i for i in got if got[i].kept), key=str)
    assert clean[100] == "\n" + " ".join(f"own0{k}" for k in range(30)) and clean[200] == docs[43][1]
    assert all(len(clean[i].split()) == got[i].left for i in clean)


def test_repeat_words():
    assert lines.repeat_words("a b c d e a b c d e".split()) == 10
    assert lines.repeat_words("a a a a a a".split()) == 6
    assert lines.repeat_words("a b c d e f".split()) == 0


def brute_scores(texts, order, prune=2, factor=0.4):
    words = [(x or "").encode().split() for x in texts]
    c = Counter(tuple(w[i : i + n]) for w in words for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(map(len, words))
    for w in words:
        score = back = 0
        for i in range(len(w)):
            top = n = min(i + 1, order)
            while n > 1 and c[tuple(w[i - n + 1 : i + 1])] < prune:
                n -= 1
            gram = tuple(w[i - n + 1 : i + 1])
            score += math.log(c[gram] / (c[gram[:-1]] if n > 1 else total)) + (top - n) * math.log(factor)
            back += n < top
        yield len(w), score, back


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_scores_against_brute_force(spark, order):
    rng = random.Random(order)
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randint(0, 30))) for _ in range(60)] + [None, "", "a b c d e f g", "a b c d e f g", "only once"]
    docs = spark.createDataFrame([(i if i != 3 else None, x) for i, x in enumerate(texts)], "doc_id long, text string")
    want = sorted((n, round(s, 6), b) for n, s, b in brute_scores(texts, order))
    for df in (docs, docs.repartition(7).orderBy("text")):
        assert sorted((r.n_words, round(r.score, 6), r.n_backoff) for r in backoff.scores(df, order).collect()) == want


def test_scores_do_not_depend_on_blocks_and_buckets_and_little_is_shuffled(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 40))) for _ in range(120)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = sorted((n, round(s, 6), b) for n, s, b in brute_scores(texts, 3))
    for tokens, buckets in ((1, 1), (50, 7), (10**6, 300)):
        assert sorted((r.n_words, round(r.score, 6), r.n_backoff) for r in backoff.scores(docs, tokens=tokens, buckets=buckets).collect()) == want
    # Distinct n-grams take under 6.5 bytes each where blocks have a million places; rows of a join took 20 and more for each place.
    hashes = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 10**6, np.int64).astype(np.uint64) * np.uint64(2))
    data = backoff.packed_sorted(hashes)
    assert len(data) < 6.5 * len(hashes) and (backoff.unpacked_sorted(data, len(hashes)) == hashes).all()
    assert len(backoff.unpacked_sorted(backoff.packed_sorted(hashes[:0]), 0)) == 0
