"""The quality network: the filters against loops, gradients, held-out labels, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fenestra.llm import quality as q


def naive(text, tables):
    """Highest response of each filter in each chunk, place by place."""
    data = q.symbols(text)
    segments = len(data) // q.SEGMENT
    starts = list(range(0, max(1, segments - q.CHUNK + 1), q.CHUNK - 1))
    if starts[-1] + q.CHUNK < segments:
        starts.append(segments - q.CHUNK)
    places = lambda s: range(s * q.SEGMENT, (s + q.CHUNK) * q.SEGMENT, q.STRIDE)
    return np.array([np.max([sum(tables[k][data[p + k]] for k in range(q.WIDTH)) for p in places(s)], 0) for s in starts])


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 449, 64 * 10 + 3, 64 * q.SEGMENTS + 70])
def test_chunks_cover_the_text(n):
    rng = np.random.default_rng(n)
    text = "".join(map(chr, rng.integers(32, 120, n))) + "é" * (n > 300)
    tables = rng.normal(size=(q.WIDTH, q.SYMBOLS, q.FILTERS)).astype(np.float32)
    assert np.allclose(q.pooled(q.symbols(text), tables), naive(text, tables), atol=1e-4)
    starts = q.chunk_starts(len(q.symbols(text)) // q.SEGMENT)
    covered = {s + k for s in starts.tolist() for k in range(q.CHUNK)}
    assert covered == set(range(len(q.symbols(text)) // q.SEGMENT))
    assert all(b - a < q.CHUNK for a, b in zip(starts, starts[1:]))  # chunks overlap


def test_repetitions_are_symbols():
    data = q.symbols("abcdefgh abcdefgh stop")
    assert [i for i, x in enumerate(data.tolist()) if x >= 256] == list(range(9, 15))
    assert [int(x) & 255 for x in data[:22]] == list(b"abcdefgh abcdefgh stop")


def test_a_place_decides():
    """One odd passage in a long text is seen wherever it stands, as no prefix is."""
    rng = np.random.default_rng(1)
    words = ["lorem", "ipsum", "dolor", "sit", "amet"]
    plain = lambda n: " ".join(rng.choice(words, n))
    texts = [plain(300) for _ in range(60)] + [plain(100 + 2 * i) + " ####$$$$ " * 30 + plain(200 - 2 * i) for i in range(60)]
    net = q.train(texts, [1] * 60 + [0] * 60)
    start = plain(2000)
    assert q.scores([start], net)[0] > 0.5 > q.scores([start + " ####$$$$ " * 40 + plain(1000)], net)[0]


def test_held_out_labels(spark):
    """Held-out documents of scale 0.1, by a network that has seen the other folds only."""
    big = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    net = q.fit(docs, labels)
    rows = q.score(docs.join(labels.where(q.is_held_out("doc_id")), "doc_id").repartition(8), net).select("quality", "score").collect()
    low, good = [r.score for r in rows if r.quality == 0], [r.score for r in rows if r.quality == 1]
    assert len(low) > 100 and np.mean(np.array(low) < q.THRESHOLD) > 0.93 and np.mean(np.array(good) >= q.THRESHOLD) > 0.99


def test_odd_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert q.fit(docs, spark.read.parquet(f"{folder}/labels.parquet")) is None
    assert {r.score for r in q.score(docs, None).collect()} == {1.0}
    rng = np.random.default_rng(0)
    net = q.train(["".join(rng.choice(list("abc "), 300)) for _ in range(10)] + ["#$" * 200] * 10, [1] * 10 + [0] * 10)
    got = q.score(docs, net).select("doc_id", F.col("text").isNull().alias("none"), "text", "score").collect()
    assert all(0 <= r.score <= 1 for r in got)
    by_text = {}
    for r in got:
        by_text.setdefault(r.text or "", set()).add(round(r.score, 12))
    assert all(len(v) == 1 for v in by_text.values())  # null as empty, repeated rows alike
    assert all(abs(r.score - q.scores([r.text], net)[0]) < 1e-9 for r in got)
    assert q.score(docs, net).columns == docs.columns  # the caller's score is replaced
