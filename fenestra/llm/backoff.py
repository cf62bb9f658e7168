"""LM scoring: stupid-backoff scores, from exact counts that travel as compressed lists.

    S(w | c) = count(c w) / count(c)   if count(c w) >= prune
             = 0.4 S(w | c without its first word)   otherwise

and count(w) / N without context. The corpus that is scored is the corpus that
is counted, so every n-gram occurs: what is there once only is the text's own,
and no evidence. It is as good as unseen (``PRUNE``), else each text that is
unlike all others would have probability 1.

*Blocks.* Tasks turn texts into blocks of about ``TOKENS`` words: the hashes of a
block's distinct words, and the number of the word at each place, the most
frequent first. Blocks are written once, under keys of their own; all else is made
from what was written, so no two scans are matched by order or partition.

*Counts.* A block gives its distinct n-grams of 1 to ``order`` words, with their
counts, as sorted lists of 64-bit hashes, one for each range of hashes (bucket).
Of a list, differences are kept, without the bytes that density makes zero.
Buckets are added up, and each list is answered with the counts of its n-grams
in the whole corpus; below ``prune`` these are 0. A very common n-gram is one
entry of each block.

*Scores.* A block meets the answers to its lists: its places have the counts of
their n-grams, and the context of an n-gram is the one that is a word shorter and
ends a place earlier. Per document the scores of all places are summed. A seen
n-gram has only seen n-grams inside, so its context's count is there.

Nothing is kept in memory for the corpus: tasks hold a block or a bucket. A text
longer than a block is in one block.

Defined results: null and empty texts have no words, score 0 and no mean. Rows
that repeat count, and score, each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from fenestra.llm.common import cut, table, text_or_empty
from fenestra.llm.phrases import squeezed, unsqueezed

#: Longest n-gram; count below which an n-gram is as good as unseen; factor for each word of context given up.
ORDER, PRUNE, BACKOFF = 3, 2, 0.4
#: Words of a block; words of the corpus for each bucket, and the fewest buckets.
TOKENS, BUCKET_WORDS, BUCKETS = 2_000_000, 1 << 21, 16
#: Low bytes of a difference, which are kept as they are: few lists are so dense that the highest of these is zero.
LOW = 5

A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
BLOCK_NAMES = ["block", "docs", "sizes", "words", "ids", "n_docs", "n_distinct", "n_words"]
LIST_NAMES = ["block", "n", "bucket", "size", "hashes", "counts"]
LISTS = "block long, n int, bucket int, size long, hashes binary, counts binary"


# -- numbers in bytes ----------------------------------------------------------
def packed(values: np.ndarray) -> bytes:
    """Numbers, byte by byte: first the lowest of all of them."""
    return squeezed(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T))


def unpacked(data: pa.Scalar | bytes, size: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(unsqueezed(data, size * width).reshape(width, size).T).view(kind).reshape(-1)


def packed_sorted(hashes: np.ndarray) -> bytes:
    parts = np.diff(hashes, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)
    return parts[:, :LOW].tobytes() + squeezed(np.ascontiguousarray(parts[:, LOW:].T))


def unpacked_sorted(data: bytes, size: int) -> np.ndarray:
    parts = np.empty((size, 8), np.uint8)
    parts[:, :LOW] = np.frombuffer(data, np.uint8, size * LOW).reshape(size, LOW)
    parts[:, LOW:] = unsqueezed(data[size * LOW :], size * (8 - LOW)).reshape(8 - LOW, size).T
    return np.cumsum(parts.view(np.uint64).reshape(-1), dtype=np.uint64)


# -- blocks --------------------------------------------------------------------
class Words(dict):
    """Numbers of words as they come, with hashes."""

    def __init__(self):
        super().__init__()
        self.hashes = []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.hashes)
        self.hashes.append(xxh64_intdigest(word, 1))
        return number


def _blocker(tokens: int) -> Callable:
    def block(key: int, kind: pa.DataType, docs: list, texts: list[np.ndarray], words: Words) -> pa.RecordBatch:
        ids = np.concatenate(texts)
        order = np.argsort(-np.bincount(ids, minlength=len(words)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        hashes = np.array(words.hashes, np.uint64)[order]
        row = [key, docs, packed(np.array([len(x) for x in texts], np.int32)), hashes.tobytes(), packed(rank[ids]), len(docs), len(hashes), len(ids)]
        kinds = [pa.int64(), pa.list_(kind), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], BLOCK_NAMES)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kind = TaskContext.get().partitionId() << 32, pa.null()
        docs, texts, held, words = [], [], 0, Words()
        for batch in batches:
            kind = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = text.as_py().encode().split()
                docs.append(doc_id)
                texts.append(np.fromiter(map(words.__getitem__, own), np.int32, len(own)))
                held += len(own)
                if held >= tokens:
                    yield block(key, kind, docs, texts, words)
                    key, docs, texts, held, words = key + 1, [], [], 0, Words()
        if docs:
            yield block(key, kind, docs, texts, words)

    return blocks


def blocks(docs: DataFrame, tokens: int = TOKENS) -> DataFrame:
    """A row for each block: doc_id and number of words of its rows, hashes of its distinct words, numbers of the words at its places."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"block long, docs array<{kind}>, sizes binary, words binary, ids binary, n_docs long, n_distinct long, n_words long"
    return docs.select("doc_id", text_or_empty("text").alias("text")).mapInArrow(_blocker(tokens), schema)


def opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each document, hash of the word at each place, its place in its document) of a block."""
    sizes = unpacked(row["sizes"], row["n_docs"], np.int32).astype(np.int64)
    words = np.frombuffer(row["words"], np.uint64)[unpacked(row["ids"], row["n_words"], np.uint32)]
    return sizes, words, np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def ngrams(words: np.ndarray, place: np.ndarray, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, places where n-grams end, their hashes), shortest first."""
    h = words
    for n in range(1, order + 1):
        if n > 1:
            mixed = (np.r_[np.uint64(0), h[:-1]] * A) ^ words if len(words) else words
            mixed ^= mixed >> np.uint64(29)
            mixed = mixed * B + np.uint64(n)
            mixed ^= mixed >> np.uint64(32)
            h = mixed
        at = np.flatnonzero(place >= n - 1)
        yield n, at, h[at]


# -- counts --------------------------------------------------------------------
def edges(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range of sorted hashes starts, and the end."""
    starts = np.array([(k << 64) // buckets for k in range(buckets)], np.uint64)
    return np.r_[np.searchsorted(hashes, starts), len(hashes)]


def lists(rows: DataFrame, order: int, buckets: int) -> DataFrame:
    """(block, n, bucket, size, hashes, counts): the distinct n-grams of each block."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).drop_columns(["docs"]).to_pylist()[0]
                _, words, place = opened(row)
                for n, _, h in ngrams(words, place, order):
                    h, c = np.unique(h, return_counts=True)
                    at = edges(h, buckets)
                    out = [(row["block"], n, k, int(hi - lo), packed_sorted(h[lo:hi]), packed(c[lo:hi])) for k, (lo, hi) in enumerate(zip(at, at[1:])) if hi > lo]
                    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], k) for j, k in enumerate(kinds)], LIST_NAMES)

    return rows.mapInArrow(listed, LISTS)


def answers(found: DataFrame, prune: int = PRUNE) -> DataFrame:
    """(block, n, bucket, size, counts): for each list the counts of its n-grams in all lists; single words all, of longer ones 0 below ``prune``."""

    def add(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        sizes = group["size"].to_pylist()
        hashes = np.concatenate([unpacked_sorted(x.as_py(), n) for x, n in zip(group["hashes"], sizes)])
        distinct, which = np.unique(hashes, return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        ends = np.cumsum(sizes).tolist()
        for x, n, end in zip(group["counts"], sizes, ends):
            total[which[end - n : end]] += unpacked(x, n, np.int64)  # a list has no hash twice
        if key[0].as_py() > 1:
            total[total < prune] = 0
        counts = [packed(total[which[end - n : end]]) for n, end in zip(sizes, ends)]
        return pa.table({c: group[c] for c in ("block", "n", "bucket", "size")} | {"counts": pa.array(counts, pa.binary())})

    return found.groupBy("n", "bucket").applyInArrow(add, "block long, n int, bucket int, size long, counts binary")


# -- scores --------------------------------------------------------------------
def _scorer(order: int, factor: float, total: int) -> Callable:
    def score(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.drop_columns(["docs"]).to_pylist()[0]
        sizes, words, place = opened(row)
        told: dict[int, list] = {}
        for n, _, size, counts in sorted(zip(*(right[c].to_pylist() for c in ("n", "bucket", "size", "counts"))), key=lambda x: x[:2]):
            told.setdefault(n, []).append(unpacked(counts, size, np.int64))
        value, used, shorter = np.zeros(len(words)), np.ones(len(words), np.int64), None
        for n, at, h in ngrams(words, place, order):
            count = np.zeros(len(words), np.int64)
            if len(h):
                count[at] = np.concatenate(told[n])[np.searchsorted(np.unique(h), h)]
            seen = np.flatnonzero(count)
            value[seen] = np.log(count[seen] / (total if n == 1 else shorter[seen - 1]))
            used[seen] = n
            shorter = count
        given_up = np.minimum(place + 1, order) - used
        value += given_up * np.log(factor)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        sums = np.bincount(doc, value, len(sizes)), np.bincount(doc[given_up > 0], minlength=len(sizes))
        return pa.table({"doc_id": left["docs"].combine_chunks().flatten(), "n_words": sizes, "score": sums[0].astype(np.float64), "n_backoff": sums[1].astype(np.int64)})

    return score


def scores(docs: DataFrame, order: int = ORDER, prune: int = PRUNE, factor: float = BACKOFF, tokens: int = TOKENS, buckets: int | None = None) -> DataFrame:
    """doc_id, n_words, score (sum of ln S) and n_backoff (words for which context was given up) of each row of docs (doc_id, text)."""
    rows = cut(blocks(docs, tokens))
    total = rows.agg(F.sum("n_words")).first()[0] or 0
    told = cut(answers(lists(rows, order, buckets or max(BUCKETS, total // BUCKET_WORDS)), prune))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, score double, n_backoff long"
    return rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_scorer(order, factor, max(1, total)), schema)


def op4_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scores(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", F.round("score", 4).alias("score"), F.when(F.col("n_words") > 0, F.round(F.col("score") / F.col("n_words"), 6)).alias("mean_score"), "n_backoff")


def _sql(order: int = ORDER, prune: int = PRUNE, factor: float = BACKOFF) -> str:
    """The same in SQL, with the words of an n-gram themselves as its key."""
    ks = range(1, order + 1)
    gram = lambda k: f"CASE WHEN i >= {k} THEN ws[i - {k - 1}:i] END AS g{k}"
    tables = ",\n".join(f"c{k} AS (SELECT g{k}, count(*) AS c FROM p WHERE g{k} IS NOT NULL GROUP BY g{k} HAVING count(*) >= {prune if k > 1 else 1})" for k in ks)
    joins = " ".join(f"LEFT JOIN c{k} ON p.g{k} = c{k}.g{k}" for k in ks)
    lags = ", ".join(f"lag(n{k}) OVER w AS b{k}" for k in range(1, order)) or "0 AS b0"
    value = reduce(lambda rest, k: f"CASE WHEN n{k} IS NOT NULL THEN ln(n{k} / b{k - 1}) - {k} * ln({factor}) ELSE {rest} END", range(2, order + 1), f"ln(n1 / (SELECT count(*) FROM p)) - ln({factor})")
    used = reduce(lambda rest, k: f"CASE WHEN n{k} IS NOT NULL THEN {k} ELSE {rest} END", range(2, order + 1), "1")
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, i, {", ".join(map(gram, ks))} FROM d, unnest(range(1, len(ws) + 1)) t(i)),
{tables},
j AS (SELECT doc_id, i, {", ".join(f"c{k}.c AS n{k}" for k in ks)} FROM p {joins}),
l AS (SELECT *, {lags} FROM j WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, sum({value} + least(i, {order}) * ln({factor})) AS score, count(*) FILTER (least(i, {order}) > {used}) AS n_backoff FROM l GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, round(coalesce(score, 0), 4) AS score, CASE WHEN len(ws) > 0 THEN round(score / len(ws), 6) END AS mean_score, coalesce(n_backoff, 0)::BIGINT AS n_backoff
FROM d LEFT JOIN g USING (doc_id)
"""


OP4_SQL = _sql()
