"""Quality classifier: a byte-level convolutional network in numpy.

The bytes of a whole text pass ``FILTERS`` learned filters of ``WIDTH`` bytes, at
every ``STRIDE``-th byte. A byte that starts four bytes which stood there up to
``REACH`` bytes before is a symbol of its own, so repetition can be learnt. A chunk is ``CHUNK`` segments of ``SEGMENT`` bytes, and the next one
starts a segment before its end, so chunks overlap and cover the document. Each
filter is max-pooled over a chunk; a hidden layer sees the pooled values, and a
document's probability comes from the mean and the maximum of the hidden layer
over its chunks, however many there are.

A filter is the product of a learned embedding of symbols and learned weights, so
a trained filter is a table of a value for each symbol at each offset, and scoring
is lookups and sums. As the maximum of a chunk has its gradient at one place for
each filter, training costs little beyond the lookups.

Training sees a bounded sample of labelled documents (``SAMPLE``), and of each
some chunks drawn anew in each step. A part of the sample is kept apart, and a
logistic curve through its scores gives the probability.

Defined results: null text scores as empty text does, which is one chunk of zero
bytes, as all ends are padded with zeros. Rows that repeat score alike. Without
``LEAST`` labelled rows of each kind all rows score 1. Labels are used for rows
outside the held-out fold only; doc_id, language and source are never inputs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fenestra.llm.common import cut, table
from fenestra.llm.toxicity import logistic

#: Filters, bytes that each sees, bytes from one place to the next, values that stand for a symbol, values of the hidden layer.
FILTERS, WIDTH, STRIDE, EMBEDDED, HIDDEN = 32, 6, 2, 8, 16
#: Bytes before in which a repetition is sought; symbols: bytes, and bytes that start a repetition.
REACH, SYMBOLS = 20, 512
#: Bytes of a segment, segments of a chunk; segments that a task works on at a time (what they make fits the processor's cache).
SEGMENT, CHUNK, SEGMENTS = 64, 4, 64
#: Labelled documents of each label in the sample, and the characters that one of them may have.
SAMPLE, SAMPLE_CHARACTERS = 1000, 100_000
#: Steps of training, documents of a step, chunks of a document in it, size of steps, weight of the squares of weights.
STEPS, DOCUMENTS, CHUNKS, RATE, DECAY = 400, 48, 5, 4e-3, 1e-4
#: One document of so many is kept apart for the curve; labelled documents of each kind without which nothing is learnt.
APART, LEAST = 4, 5
THRESHOLD = 0.3
SEED = 20


# -- the network -------------------------------------------------------------
@dataclass(frozen=True)
class Network:
    tables: np.ndarray  # WIDTH x SYMBOLS x FILTERS: what a symbol adds to each filter at each offset
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    slope: float = 1.0
    shift: float = 0.0


def symbols(text: str | None) -> np.ndarray:
    """The symbols of a text, with zeros up to whole segments, one chunk at least, and a filter's width more."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    segments = max(CHUNK, -(-len(data) // SEGMENT))
    out = np.zeros(segments * SEGMENT + WIDTH - STRIDE, np.uint16)
    out[: len(data)] = data
    if len(data) > 7:
        four = data[:-3] | data[1:-2].astype(np.uint32) << 8 | data[2:-1].astype(np.uint32) << 16 | data[3:].astype(np.uint32) << 24
        again = np.zeros(len(four), bool)
        for back in range(4, min(REACH, len(four) - 1) + 1):
            again[back:] |= four[back:] == four[:-back]
        out[: len(again)] += again.astype(np.uint16) << 8
    return out


def responses(data: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """places x filters: the sums of the table values of the symbols that each place sees."""
    end = data.shape[-1] - WIDTH + 1
    total = tables[0].take(data[..., :end:STRIDE], axis=0)
    for k in range(1, WIDTH):
        total += tables[k].take(data[..., k : k + end : STRIDE], axis=0)
    return total


def chunk_starts(segments: int) -> np.ndarray:
    """First segments of the chunks; the last chunk ends with the text."""
    step = CHUNK - 1
    starts = np.arange(0, max(1, segments - CHUNK + 1), step)
    return starts if starts[-1] + CHUNK >= segments else np.r_[starts, segments - CHUNK]


def pooled(data: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """chunks x filters: the highest response of each filter in each chunk of a text's symbols."""
    segments = len(data) // SEGMENT
    top = np.empty((segments, FILTERS), np.float32)
    for lo in range(0, segments, SEGMENTS):
        hi = min(segments, lo + SEGMENTS)
        part = responses(data[lo * SEGMENT : hi * SEGMENT + WIDTH - STRIDE], tables)
        top[lo:hi] = part.reshape(hi - lo, SEGMENT // STRIDE, FILTERS).max(1)
    return np.maximum.reduce([top[chunk_starts(segments) + k] for k in range(CHUNK)])


def logit(chunks: np.ndarray, net: Network) -> float:
    u = np.maximum(np.maximum(chunks + net.bias, 0) @ net.hidden + net.hidden_bias, 0)
    return float(np.r_[u.mean(0), u.max(0)] @ net.out + net.out_bias)


def scores(texts: list[str | None], net: Network) -> np.ndarray:
    raw = np.array([logit(pooled(symbols(t), net.tables), net) for t in texts])
    return 1 / (1 + np.exp(-np.clip(net.slope * raw + net.shift, -60, 60)))


# -- training ----------------------------------------------------------------
def learnt(texts: list[np.ndarray], label: np.ndarray) -> Network:
    """Adam on the logistic loss, both labels of equal weight; the gradient of a maximum goes to the place that has it."""
    rng = np.random.default_rng(SEED)
    normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    p = {
        "e": normal(SYMBOLS, EMBEDDED, scale=1.0),
        "w": normal(WIDTH, EMBEDDED, FILTERS, scale=(WIDTH * EMBEDDED) ** -0.5),
        "b": np.zeros(FILTERS, np.float32),
        "h": normal(FILTERS, HIDDEN, scale=(2 / FILTERS) ** 0.5),
        "c": np.zeros(HIDDEN, np.float32),
        "o": normal(2 * HIDDEN, scale=HIDDEN**-0.5),
        "d": np.zeros(1, np.float32),
    }
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    length = CHUNK * SEGMENT + WIDTH - STRIDE
    starts = [chunk_starts(len(t) // SEGMENT) * SEGMENT for t in texts]
    kinds = [np.flatnonzero(label == v) for v in (0, 1)]
    column = np.arange(FILTERS)
    for step in range(1, STEPS + 1):
        chosen = np.concatenate([rng.choice(k, DOCUMENTS // 2) for k in kinds])
        y = label[chosen].astype(np.float32)
        at = [(i, s) for i in chosen for s in (starts[i] if len(starts[i]) <= CHUNKS else rng.choice(starts[i], CHUNKS, replace=False))]
        of = np.repeat(np.arange(len(chosen)), [min(CHUNKS, len(starts[i])) for i in chosen])
        first_of = np.searchsorted(of, np.arange(len(chosen)))
        data = np.stack([texts[i][s : s + length] for i, s in at])
        tables = p["e"] @ p["w"]
        r = responses(data, tables)  # chunks x places x filters
        where = r.argmax(1)
        top = np.take_along_axis(r, where[:, None], 1)[:, 0] + p["b"]
        z = np.maximum(top, 0)
        u = np.maximum(z @ p["h"] + p["c"], 0)
        n = np.diff(np.r_[first_of, len(of)])[:, None]
        mean, high = np.add.reduceat(u, first_of) / n, np.maximum.reduceat(u, first_of)
        g = np.hstack([mean, high])
        f = g @ p["o"] + p["d"]
        df = ((1 / (1 + np.exp(-f))) - y) / len(y)
        dg = df[:, None] * p["o"]
        won = u == high[of]
        won = won / np.add.reduceat(won, first_of)[of]
        du = (dg[:, :HIDDEN] / n)[of] + dg[:, HIDDEN:][of] * won
        du[u <= 0] = 0
        dz = du @ p["h"].T
        dz[top <= 0] = 0
        dt = np.zeros((WIDTH, SYMBOLS, FILTERS), np.float32)
        row = np.arange(len(data))[:, None]
        for k in range(WIDTH):
            np.add.at(dt[k], (data[row, where * STRIDE + k], column), dz)
        d = {"e": np.einsum("kbf,kef->be", dt, p["w"]), "w": np.einsum("be,kbf->kef", p["e"], dt), "b": dz.sum(0), "h": z.T @ du, "c": du.sum(0), "o": g.T @ df, "d": df.sum(keepdims=True)}
        for k in p:
            d[k] = d[k] + DECAY * p[k]
            first[k] = 0.9 * first[k] + 0.1 * d[k]
            second[k] = 0.999 * second[k] + 0.001 * d[k] ** 2
            rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
            p[k] = p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Network((p["e"] @ p["w"]).astype(np.float32), p["b"], p["h"], p["c"], p["o"], float(p["d"][0]))


def train(texts: list[str | None], label: list[int], odds: float | None = None) -> Network | None:
    """A network from documents, with a curve from those that it doesn't learn from; odds: documents of label 0 for each of label 1 where it is used."""
    y = np.array(label, int)
    if min((y == 1).sum(), (y == 0).sum()) < LEAST:
        return None
    place = np.where(y == 1, np.cumsum(y == 1), np.cumsum(y == 0))
    apart = place % APART == 0
    if min((y[apart] == 1).sum(), (y[apart] == 0).sum()) < LEAST:
        apart = np.ones(len(y), bool)  # too few: all serve for both
    data = [symbols(t) for t in texts]
    seen = ~apart if not apart.all() else apart
    net = learnt([d for d, s in zip(data, seen) if s], y[seen])
    raw = np.array([logit(pooled(d, net.tables), net) for d, a in zip(data, apart) if a])
    good = y[apart] == 1
    odds = odds or (~good).sum() / good.sum()
    slope, shift = logistic(raw, good, np.where(good, 1.0, odds * good.sum() / (~good).sum()))
    return Network(net.tables, net.bias, net.hidden, net.hidden_bias, net.out, net.out_bias, slope, shift)


def is_held_out(doc_id: str | Column) -> Column:
    """Whether crc32 of the id as text can be divided by 5; a null id is in no fold."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Network | None:
    """A network from the first SAMPLE labelled rows of each label outside the held-out fold, in the order of a hash of their ids, of texts with at most SAMPLE_CHARACTERS."""
    folds = labels.select("doc_id", "quality").where(~is_held_out("doc_id") & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    short = docs.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARACTERS)
    known = cut(folds.join(short.select("doc_id").distinct(), "doc_id", "left_semi"))
    counted = dict(known.groupBy("quality").count().collect())
    ordered = known.orderBy(F.xxhash64("doc_id"), "doc_id")
    some = ordered.where("quality = 1").limit(SAMPLE).unionByName(ordered.where("quality = 0").limit(SAMPLE))
    rows = short.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("quality").alias("quality")).orderBy("doc_id").collect()
    return train([r.text for r in rows], [r.quality for r in rows], counted.get(0, 0) / max(1, counted.get(1, 0)))


# -- scoring -----------------------------------------------------------------
def score(df: DataFrame, net: Network | None, text: str = "text", out: str = "score") -> DataFrame:
    """df with a column ``out``, the probability of label 1; a column of that name is replaced."""
    if net is None:
        return df.withColumn(out, F.lit(1.0))
    sent = df.sparkSession.sparkContext.broadcast(net)

    @F.arrow_udf(T.DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array([scores([x.as_py()], sent.value)[0] for x in texts], pa.float64())

    return df.withColumn(out, scored(F.col(text)))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
