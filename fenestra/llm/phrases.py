"""Phrase collocations: a count-min sketch first, exact counts of what survives it, then scores.

*First pass.* Each task counts the hashes of its n-grams (1 to 3 words, by
language) in a sketch of ``ROWS`` rows of cells that stop at 255. Sketches are cut
into slices, compressed, and slices of one place are added up in a tree of
bounded groups. A cell below the least count proves that no n-gram in it is
frequent; what an n-gram's cells all allow survives. The sketch never counts too
little, so nothing frequent is lost.

*Second pass.* The cells that reach the least count are a bitmap of bounded
size, which is broadcast. Tasks count the survivors' occurrences under the words
themselves, in blocks of text; as most of what survives is seen once in a block, a
block's counts are shuffled as sorted, compressed lists, a bucket of phrases in
each. Buckets are added up; what is below the least count after all goes. Counts
are exact at any size of the sketch: one that is too small for its corpus lets more
through, and costs only time.

*Scores.* A phrase is cut after each of its words; its parts are at least as
frequent as it is, so their counts are there. A phrase inside a longer one of
at least half its count goes. Numbers are exact decimals.

Defined results: null and empty texts have no words; a null language is ``und``,
as the language of that name. Rows that repeat count each. A language without
phrases has no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from fenestra.llm.common import cut, table, text_or_empty

#: Longest phrase, its least count, phrases returned for a language, percentage of its count that a longer phrase must have to replace it.
WORDS, LEAST, TOP, INSIDE = 3, 10, 2000, 50
#: Rows of the sketch; cells of a row, a power of two; cells of a slice; sketches added up in one group.
ROWS, CELLS, SLICE, FAN_IN = 2, 1 << 25, 1 << 20, 16
#: Bytes of text for each bucket of phrases, and the fewest buckets; buckets over which the phrases that start with one word are spread.
BUCKET_BYTES, BUCKETS, SPREAD = 1 << 24, 16, 16
#: Words that a task works on at a time; distinct words that it remembers before it starts again; bits of a word's number in the key of an n-gram.
TOKENS, REMEMBERED, BITS = 400_000, 100_000, 21
#: Parts of a language from which its best phrases are taken first.
PARTS = 64

#: Bytes: A to Z become small, ends of pieces 0xFF, which no UTF-8 has.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 255 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))
END = b"\xff"
LIST_NAMES = ["lang", "bucket", "n", "phrases", "counts", "bytes", "size"]
LISTS = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


# -- words and hashes --------------------------------------------------------
class Words(dict):
    """Numbers of words from 1 on, given as they come, with hashes; the end of a piece is 0."""

    def __init__(self):
        super().__init__({END: 0})
        self.words, self.hashes, self.array = [END], [0], np.zeros(1, np.uint64)

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self.words)
        self.words.append(word)
        self.hashes.append(xxh64_intdigest(word, 7))
        return self[word]

    def hashed(self, ids: np.ndarray) -> np.ndarray:
        if len(self.array) < len(self.hashes):
            self.array = np.r_[self.array, np.array(self.hashes[len(self.array) :], np.uint64)]
        return self.array[ids]


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, Words]]:
    """(language, numbers of words, the words) of bounded blocks of texts; texts, like pieces, end with 0. A text longer than a block is in one block."""
    words, waiting, held = Words(), {}, 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            tokens = text.as_py().encode().translate(FOLD).replace(END, b" \xff ").split()
            ids = np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens))
            waiting.setdefault(lang, []).extend((ids, np.zeros(1, np.int64)))
            held += len(ids)
            if held >= TOKENS:
                for at, parts in waiting.items():
                    yield at, np.concatenate(parts), words
                waiting, held = {}, 0
                if len(words) >= REMEMBERED:
                    words = Words()
    for at, parts in waiting.items():
        yield at, np.concatenate(parts), words


def grams(lang: str, ids: np.ndarray, words: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, hashes, places where they start) of the n-grams inside pieces."""
    own = words.hashed(ids)
    inside = ids > 0
    h = own ^ np.uint64(xxh64_intdigest(lang, 3))
    for n in range(1, WORDS + 1):
        if n > 1:
            h = (h[:-1] * A) ^ own[n - 1 :]
            inside = inside[:-1] & (ids[n - 1 :] > 0)
        mixed = (h ^ (h >> np.uint64(31))) * B
        mixed ^= mixed >> np.uint64(29)
        h = mixed
        at = np.flatnonzero(inside)
        yield n, h[at], at


def counted(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """(distinct rows as columns, how often each is there)."""
    if max((int(c.max(initial=0)) for c in columns)) >> BITS:  # a text of millions of distinct words
        rows, f = np.unique(np.stack(columns, 1), axis=0, return_counts=True)
        return list(rows.T), f
    key = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        key = key << BITS | c
    key, f = np.unique(key, return_counts=True)
    return [key >> (BITS * k) & ((1 << BITS) - 1) for k in reversed(range(len(columns)))], f


def cells_of(h: np.ndarray, row: int, cells: int) -> np.ndarray:
    """The cell of each hash in a row of the sketch."""
    return ((h >> np.uint64(32 * row)) & np.uint64(cells - 1)).astype(np.int64)


# -- first pass --------------------------------------------------------------
def _sketcher(cells: int) -> Callable:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((ROWS, cells), np.uint8)
        for lang, ids, words in blocks(batches):
            for _, h, _ in grams(lang, ids, words):
                for row in range(ROWS):
                    c, more = np.unique(cells_of(h, row, cells).astype(np.int32), return_counts=True)
                    counts[row][c] = np.minimum(counts[row][c] + more, 255)
        yield from slices(counts, TaskContext.get().partitionId())

    return sketch


def squeezed(data: np.ndarray) -> bytes:
    return pa.Codec("zstd").compress(data.tobytes(), asbytes=True)


def unsqueezed(data: pa.Scalar | bytes, size: int) -> np.ndarray:
    data = data if isinstance(data, (bytes, bytearray)) else data.as_py()
    return np.frombuffer(pa.Codec("zstd").decompress(bytes(data), size, asbytes=True), np.uint8)


def slices(counts: np.ndarray, task: int) -> Iterator[pa.RecordBatch]:
    step = min(SLICE, counts.shape[1])
    for row in range(counts.shape[0]):
        for lo in range(0, counts.shape[1], step):
            place = row * (counts.shape[1] // step) + lo // step
            yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([task], pa.int32()), pa.array([squeezed(counts[row, lo : lo + step])], pa.binary())], ["place", "task", "cells"])


def merged(sketches: DataFrame, tasks: int, step: int) -> DataFrame:
    """One row for each place: slices are added up FAN_IN at a time."""

    def add(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        total = np.zeros(step, np.uint8)
        for data in group["cells"]:
            some = unsqueezed(data, step)
            total = np.where(total > 255 - some, 255, total + some).astype(np.uint8)
        return pa.table({"place": pa.array([key[0].as_py()], pa.int32()), "task": pa.array([key[1].as_py()], pa.int32()), "cells": pa.array([squeezed(total)], pa.binary())})

    while True:
        tasks = -(-tasks // FAN_IN)
        sketches = sketches.groupBy("place", F.floor(F.col("task") / FAN_IN).cast("int").alias("_group")).applyInArrow(add, "place int, task int, cells binary")
        if tasks <= 1:
            return sketches


def bitmap(docs: DataFrame, least: int = LEAST, cells: int = CELLS) -> np.ndarray:
    """rows x cells / 8: bits of the cells that reach the least count."""
    step = min(SLICE, cells)
    sketches = cut(docs.mapInArrow(_sketcher(cells), "place int, task int, cells binary"))
    tasks = (sketches.agg(F.max("task")).first()[0] or 0) + 1
    out = np.zeros((ROWS * cells // step, step // 8), np.uint8)

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [squeezed(np.packbits(unsqueezed(x, step) >= least)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], ["place", "bits"])

    for place, bits in merged(sketches, tasks, step).select("place", "cells").mapInArrow(reached, "place int, bits binary").collect():
        out[place] = unsqueezed(bits, step // 8)
    return out.reshape(ROWS, cells // 8)


# -- second pass -------------------------------------------------------------
def survivors(docs: DataFrame, bits: np.ndarray, buckets: int) -> DataFrame:
    """(lang, bucket, n, phrases, counts): counts of a block's n-grams that the sketch lets through, as lists; n = 0: all words of the block."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)
    cells = bits.shape[1] * 8

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for lang, ids, words in blocks(batches):
            # Numbers in the order of the words, so that lists come out sorted.
            seen = np.unique(ids[ids > 0])
            vocabulary = sorted((words.words[i], i) for i in seen.tolist())
            rank = np.zeros(len(words.words), np.int64)
            rank[[i for _, i in vocabulary]] = np.arange(len(vocabulary))
            texts = [w for w, _ in vocabulary]
            hashes = words.hashed(np.array([i for _, i in vocabulary], np.int64))
            out = [(0, 0, b"", np.array([np.count_nonzero(ids)]))]
            for n, h, at in grams(lang, ids, words):
                good = np.ones(len(h), bool)
                for row in range(ROWS):
                    c = cells_of(h, row, cells)
                    good &= (bits[row][c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1).astype(bool)
                at = at[good]
                rows, f = counted([rank[ids[at + k]] for k in range(n)])
                # A bucket has phrases of few first words, as they are short when sorted.
                key = hashes[rows[0]] % np.uint64(buckets)
                if n > 1:
                    key = (key + hashes[rows[1]] % np.uint64(SPREAD)) % np.uint64(buckets)
                order = np.argsort(key, kind="stable")
                key, f = key[order], f[order]
                parts = [x[order] for x in rows]
                edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]).tolist() if len(key) else [0]
                for lo, hi in zip(edges, edges[1:]):
                    lines = zip(*([texts[i] for i in x[lo:hi].tolist()] for x in parts))
                    out.append((int(key[lo]), n, b"\n".join(map(b" ".join, lines)), f[lo:hi]))
            columns = [[lang] * len(out), [b for b, *_ in out], [n for _, n, *_ in out], [squeezed(np.frombuffer(p, np.uint8)) for _, _, p, _ in out], [squeezed(f.astype(np.int32)) for *_, f in out], [len(p) for _, _, p, _ in out], [len(f) for *_, f in out]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, LISTS)], LIST_NAMES)

    return docs.mapInArrow(count, "lang string, bucket int, n int, phrases binary, counts binary, bytes long, size long")


def added(lists: DataFrame, least: int) -> DataFrame:
    """(lang, n, phrase, f): the lists of each bucket added up; below the least count goes."""

    def add(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        phrases, counts = [], []
        for p, f, n_bytes, size in zip(group["phrases"], group["counts"], group["bytes"].to_pylist(), group["size"].to_pylist()):
            phrases.append(pa.array(unsqueezed(p, n_bytes).tobytes().split(b"\n"), pa.binary()))
            counts.append(pa.array(unsqueezed(f, 4 * size).view(np.int32), pa.int64()))
        table = pa.table({"phrase": pa.chunked_array(phrases), "f": pa.chunked_array(counts)}).group_by("phrase").aggregate([("f", "sum")])
        table = table.filter(pc.greater_equal(table["f_sum"], least if key[2].as_py() else 0))
        n = len(table)
        return pa.table({"lang": pa.array([key[0].as_py()] * n, pa.string()), "n": pa.array([key[2].as_py()] * n, pa.int32()), "phrase": table["phrase"].cast(pa.string()), "f": table["f_sum"]})

    return lists.groupBy("lang", "bucket", "n").applyInArrow(add, "lang string, n int, phrase string, f long")


def counts(docs: DataFrame, least: int = LEAST, cells: int = CELLS) -> DataFrame:
    """(lang, n, phrase, f): exact counts of the n-grams that are there ``least`` times or more, and, with n = 0, of all words of a language."""
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text_or_empty("text").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return added(survivors(docs, bitmap(docs, least, cells), max(BUCKETS, int(size // BUCKET_BYTES))), least)


def scored(found: DataFrame, inside: int = INSIDE) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of two words or more that no longer one replaces."""
    words = F.split("phrase", " ")
    parts = found.where("n BETWEEN 1 AND 2").select("lang", F.col("phrase").alias("part"), F.col("f").alias("of"))
    phrases = found.where("n > 1").select("lang", "n", "phrase", F.col("f").alias("a"))
    # A longer phrase of at least the share of its parts' counts takes their place.
    longer = phrases.where("n > 2").select("lang", F.explode(F.array(F.array_join(F.slice(words, 1, 2), " "), F.array_join(F.slice(words, 2, 2), " "))).alias("phrase"), "a")
    covered = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    kept = phrases.join(covered, ["lang", "phrase"], "left").where(F.col("longest").isNull() | (F.col("longest") * 100 < F.col("a") * inside))
    cuts = kept.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"), words.alias("ws"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("ws", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("ws", F.col("k") + 1, F.lit(WORDS)), " ").alias("right"))
    cuts = cuts.join(parts.select("lang", F.col("part").alias("left"), F.col("of").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("part").alias("right"), F.col("of").alias("r")), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("_a", (wide("a") * wide("a")) * F.lit(1000000).cast("decimal(7,0)")).withColumn("_b", wide("l") * wide("r"))
    cuts = cuts.withColumn("score", F.expr("_a div _b").cast("long"))
    lowest = cuts.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "score"), F.struct("score", "k")).alias("x"))
    return lowest.select("lang", "phrase", "x.*")


def best(docs: DataFrame, top: int = TOP, least: int = LEAST, cells: int = CELLS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's phrases that score highest."""
    found = cut(counts(docs, least, cells))
    ranked = scored(found)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    for by in ((F.col("lang"), F.pmod(F.xxhash64("phrase"), F.lit(PARTS))), (F.col("lang"),)):
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = found.where("n = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM d),
o AS (SELECT lang, k AS n, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM p, range(1, 4) t(k), unnest(range(1, len(ws) - k + 2)) u(i)),
f AS (SELECT lang, n, phrase, count(*) AS f FROM o GROUP BY ALL HAVING count(*) >= 10),
t AS (SELECT lang, count(*) AS n FROM o WHERE n = 1 GROUP BY lang),
c AS (SELECT lang, phrase, f AS a, n AS size, string_split(phrase, ' ') AS ws FROM f WHERE n > 1),
x AS (SELECT lang, phrase, max(a) AS longest FROM (SELECT lang, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) AS phrase, a FROM c WHERE size = 3) GROUP BY ALL),
k AS (SELECT lang, phrase, a, ws, unnest(range(1, size)) AS k FROM c LEFT JOIN x USING (lang, phrase) WHERE longest IS NULL OR 100 * longest < 50 * a),
s AS (SELECT k.lang, k.phrase, a, k, y.f AS l, z.f AS r, ((1000000::HUGEINT * a * a) // (y.f::HUGEINT * z.f))::BIGINT AS score FROM k
  JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(ws[1:k], ' ') JOIN f z ON z.lang = k.lang AND z.phrase = array_to_string(ws[k + 1:], ' ')),
m AS (SELECT lang, phrase, a, l, r, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM m)
SELECT lang, rank, phrase, a, l, r, n, score FROM r JOIN t USING (lang) WHERE rank <= 2000
"""
