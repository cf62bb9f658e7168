"""Phrases: exact at any size of the sketch, against counting in Python."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fenestra.llm import phrases

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) by dictionaries and integers."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(UPPER)):
            ws = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(ws)
            f.update((lang, tuple(ws[i : i + k])) for k in (1, 2, 3) for i in range(len(ws) - k + 1))
    longest = {}
    for (lang, p), a in f.items():
        if len(p) == 3 and a >= least:
            for q in (p[:2], p[1:]):
                longest[lang, q] = max(a, longest.get((lang, q), 0))
    out = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least and 100 * longest.get((lang, p), 0) < 50 * a:
            cuts = [(1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


def spark_rows(spark, rows, cells=1 << 12, **how):
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    return sorted(tuple(r) for r in phrases.best(df, cells=cells, **how).collect())


def corpus(seed):
    rng = random.Random(seed)
    words = ["New", "york", "city", "of", "the", "état", "字", "a-b", "\x00x", " y", "z z"]
    text = lambda: "".join(rng.choice(words[: rng.randint(2, len(words))]) + rng.choice(["  ", " ", "\t", " ", ". ", ",", "\n", "\x0b", "\r\n", " ? "]) for _ in range(rng.randint(0, 60)))
    rows = [(rng.choice(["en", "en", "de", None, "und"]), text()) for _ in range(150)]
    return rows + [("en", None), (None, ""), ("fr", "only once"), ("en", "New York City " * 40), ("en", "same words, " * 15), ("en", "same words, " * 15), ("xx", "to be or " * 5000)]


@pytest.mark.parametrize("cells", [64, 1 << 16, phrases.CELLS])
def test_against_brute_force(spark, monkeypatch, cells):
    """A sketch of 64 cells lets everything through; counts are the same."""
    monkeypatch.setattr(phrases, "FAN_IN", 2)
    rows = corpus(3)
    want = brute(rows)
    assert len(want) > 50 and spark_rows(spark, rows, cells=cells) == want


def test_best_of_a_language(spark):
    rows = corpus(4)
    assert spark_rows(spark, rows, top=7, least=3) == brute(rows, least=3, top=7)


def test_odd_rows(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("lang", "text").collect()]
    want = brute(rows)
    assert want and spark_rows(spark, rows) == want


def test_the_sketch_never_counts_too_little(spark):
    rng = random.Random(5)
    texts = [("en", " ".join(f"w{min(rng.randrange(1, 400), rng.randrange(1, 400))}" for _ in range(400))) for _ in range(40)]
    f = Counter(w for _, t in texts for w in t.split())
    bits = phrases.bitmap(spark.createDataFrame(texts, "lang string, text string").repartition(5), 10, 1 << 10)
    assert bits.shape == (phrases.ROWS, 128)
    words = phrases.Words()
    ids = np.array([words[w.encode()] for w in f])
    _, h, _ = next(phrases.grams("en", ids, words))
    good = np.ones(len(h), bool)
    for row in range(phrases.ROWS):
        c = phrases.cells_of(h, row, 1 << 10)
        good &= (bits[row][c >> 3] >> (7 - (c & 7)) & 1).astype(bool)
    assert all(g for g, n in zip(good, f.values()) if n >= 10)


def test_blocks(monkeypatch):
    """Small blocks, and words that are numbered anew, lose and join nothing."""
    monkeypatch.setattr(phrases, "TOKENS", 50)
    monkeypatch.setattr(phrases, "REMEMBERED", 5)
    rows = [(lang or "und", text or "") for lang, text in corpus(6)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows[i : i + 30])], ["lang", "text"]) for i in range(0, len(rows), 30)]
    got = Counter()
    for lang, ids, words in phrases.blocks(batches):
        for n, _, at in phrases.grams(lang, ids, words):
            got.update((lang, n, b" ".join(words.words[i] for i in ids[p : p + n])) for p in at.tolist())
    want = Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text.translate(UPPER)):
            ws = re.findall("[^\x20\x09]+", piece)
            want.update((lang, k, " ".join(ws[i : i + k]).encode()) for k in (1, 2, 3) for i in range(len(ws) - k + 1))
    assert got == want


def test_many_distinct_words():
    big = [np.array([1, 1 << 22, 1, 5]), np.array([2, 3, 2, 5])]
    rows, f = phrases.counted(big)
    assert sorted(zip(*(x.tolist() for x in rows), f.tolist())) == [(1, 2, 2), (5, 5, 1), (1 << 22, 3, 1)]
    rows, f = phrases.counted([np.array([1, 4, 1]), np.array([2, 3, 2])])
    assert sorted(zip(*(x.tolist() for x in rows), f.tolist())) == [(1, 2, 2), (4, 3, 1)]
