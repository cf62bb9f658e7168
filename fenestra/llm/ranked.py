"""Ranked lexical search: document-at-a-time over an inverted index, shard by shard.

*Index.* Each task turns the documents that it reads into shards of a bounded
size; texts are not shuffled. A shard has a row for each of its terms, with a
compressed list of postings in doc_id order (varints of gaps and frequencies),
and a header row with its documents' ids and lengths. The index is written once,
so that a shard never changes under a search.

*Search.* Items are dealt into blocks of a bounded number, and their terms are
joined to the index. A group is a shard and a block: its postings are merged by
a k-way heap in doc_id order, each document is met once, with all its terms, and
the scores of all items of the block are summed at once. An item keeps its best
documents in a heap of bounded size, keyed by score, then doc_id. The bests of
the shards are merged in two steps. No group grows with the corpus.

Defined results: null and empty texts, and texts of separators, have no terms,
are in no result and don't count in N; rows that repeat are documents each. Rows
of items with one id are one item, of the terms of all of them; an item without
terms has no rows. Documents without an id rank after others of equal score.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fenestra.llm.common import cut, table

#: Documents returned for an item; bytes of texts after which a shard ends, and its most documents; items of a block; parts in which a result is merged first.
TOP, SHARD_BYTES, SHARD_DOCUMENTS, BLOCK, PARTS = 50, 32 << 20, 1 << 16, 256, 64

#: Fixed value: the pattern of terms of the contract.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

INDEX = "shard string, term binary, df long, size long, postings binary"
#: For bytes: letters A to Z become small, separators blanks. Bytes of other characters are 0x80 or more, so terms of bytes are those of characters.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
NO_ID = np.iinfo(np.int64).max


# -- compressed lists --------------------------------------------------------
def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Varints of non-negative numbers, low bits first: (bytes, where each number ends)."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        more = v >= np.uint64(1 << 7 * k)
        if not more.any():
            break
        size += more
    ends = np.cumsum(size)
    out = np.zeros(ends[-1] if len(v) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        at = size > k
        low = (v[at] >> np.uint64(7 * k)).astype(np.uint8) & 127
        out[ends[at] - size[at] + k] = low | np.where(size[at] > k + 1, 128, 0).astype(np.uint8)
    return out, ends


def unpacked(data: bytes) -> np.ndarray:
    """The numbers of ``packed``."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(b < 128)
    starts = np.r_[0, ends[:-1] + 1]
    place = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((b & 127).astype(np.uint64) << (7 * place).astype(np.uint64), starts).astype(np.int64)


# -- index -------------------------------------------------------------------
class Vocabulary(dict):
    """Numbers of terms, given as they come."""

    def __missing__(self, term: bytes) -> int:
        self[term] = len(self)
        return self[term]


class Shard:
    """Documents that become the rows of a shard."""

    def __init__(self):
        self.vocabulary, self.ids, self.lengths, self.terms, self.counts, self.bytes = Vocabulary(), [], [], [], [], 0

    def add(self, doc_id: int | None, text: str) -> None:
        data = text.encode()
        found = data.translate(FOLD).split(b" ")
        of = self.vocabulary.__getitem__
        terms, counts = np.unique(np.fromiter(map(of, filter(None, found)), np.int64), return_counts=True)
        if len(terms):
            self.bytes += len(data)
            self.ids.append(doc_id)
            self.lengths.append(int(counts.sum()))
            self.terms.append(terms.astype(np.int32))
            self.counts.append(counts.astype(np.int64))

    def rows(self, name: str) -> pa.RecordBatch:
        """A header, the first row, without a term: sorted ids, lengths, one after another. Then a row for each term."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        terms = np.concatenate([self.terms[i] for i in order])
        tf = np.concatenate([self.counts[i] for i in order])
        doc = np.repeat(np.arange(len(order)), [len(self.terms[i]) for i in order])
        by_term = np.argsort(terms, kind="stable")
        terms, tf, doc = terms[by_term], tf[by_term], doc[by_term]
        first = np.flatnonzero(np.r_[True, np.diff(terms) > 0])
        df = np.diff(np.r_[first, len(terms)])
        gaps = np.diff(doc, prepend=0)
        gaps[first] = doc[first]
        data, ends = packed(np.stack([gaps, tf], 1).ravel())
        ids = np.array([NO_ID if self.ids[i] is None else self.ids[i] for i in order], np.int64)
        header = ids.tobytes() + np.array([self.lengths[i] for i in order], np.int64).tobytes()
        blobs = data.tobytes()
        cuts = np.r_[0, ends[np.r_[first[1:], len(terms)] * 2 - 1]].tolist()
        words = list(self.vocabulary)
        n = len(first)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([name] * (n + 1), pa.string()),
                pa.array([None, *(words[t] for t in terms[first].tolist())], pa.binary()),
                pa.array(np.r_[len(order), df], pa.int64()),
                pa.array(np.r_[sum(self.lengths), np.add.reduceat(tf, first)], pa.int64()),
                pa.array([header, *(blobs[a:b] for a, b in zip(cuts, cuts[1:]))], pa.binary()),
            ],
            ["shard", "term", "df", "size", "postings"],
        )


def index(docs: DataFrame, size: int = SHARD_BYTES) -> DataFrame:
    """(shard, term, df, size, postings): all documents, written once. Without a term, a shard's header: df its documents with terms, size their terms with repeats."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, done, part = Shard(), 0, TaskContext.get().partitionId()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                shard.add(doc_id.as_py(), text.as_py() or "")
                if shard.bytes >= size or len(shard.ids) >= SHARD_DOCUMENTS:
                    yield shard.rows(f"{part}-{done}")
                    shard, done = Shard(), done + 1
        if shard.ids:
            yield shard.rows(f"{part}-{done}")

    return cut(docs.select("doc_id", "text").mapInArrow(shards, INDEX))


# -- search ------------------------------------------------------------------
def _scores(rows: list[tuple], top: int, n_docs: int, n_terms: int) -> Iterator[tuple]:
    """(item, doc_id, score) of the best documents of one shard for the items of one block, from rows (term's weight, its items, postings); the header has no weight."""
    header = next((p for w, _, p in rows if w is None), None)
    rows = [r for r in rows if r[0] is not None]
    if header is None or not rows:
        return
    ids, lengths = np.frombuffer(header, np.int64).reshape(2, -1)
    m = 50 + np.array([50 * n * n_docs // n_terms for n in lengths.tolist()], np.int64)
    # The lists of all terms, one after another, each in doc_id order.
    lists = [unpacked(p).reshape(-1, 2) for _, _, p in rows]
    sizes = [len(x) for x in lists]
    doc = np.concatenate([np.cumsum(x[:, 0]) for x in lists])
    tf = np.concatenate([x[:, 1] for x in lists])
    term = np.repeat(np.arange(len(rows)), sizes)
    worth = np.repeat(np.array([r[0] for r in rows], np.int64), sizes) * (1000000000 * tf // (1000 * tf + 20 * m[doc]))
    # Terms of each item, item after item.
    pairs = np.array(sorted((item, t) for t, (_, items, _) in enumerate(rows) for item in items))
    items, starts = np.unique(pairs[:, 0], return_index=True)
    of_item = pairs[:, 1]
    # A cursor for each list; the heap gives the next posting of the lowest document. Place and document are in one number.
    cursors, at = [], 0
    for size in sizes:
        cursors.append(((doc[at : at + size] << 32) | np.arange(at, at + size)).tolist())
        at += size
    best: list[list[tuple[int, int]]] = [[] for _ in items]
    least = np.zeros(len(items), np.int64)
    now = np.zeros(len(rows), np.int64)

    def finish(d: int, places: list[int]) -> None:
        p = np.array(places)
        now[term[p]] = worth[p]
        score = np.add.reduceat(now[of_item], starts)
        now[term[p]] = 0
        for i in np.flatnonzero(score > least).tolist():
            entry = (int(score[i]), -d)  # of equal scores the later document goes first
            if len(best[i]) < top:
                heapq.heappush(best[i], entry)
            else:
                heapq.heapreplace(best[i], entry)
            if len(best[i]) == top:
                least[i] = best[i][0][0]

    current, places = -1, []
    for x in heapq.merge(*cursors):
        d = x >> 32
        if d != current:
            if places:
                finish(current, places)
            current, places = d, []
        places.append(x & 0xFFFFFFFF)
    finish(current, places)
    for i, entries in enumerate(best):
        for score, d in entries:
            yield int(items[i]), None if ids[-d] == NO_ID else int(ids[-d]), score


def terms_of(text: str) -> Column:
    small = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(small, F.lit(TERM), F.lit(0))


def search(found: DataFrame, items: DataFrame, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): the documents of an index that score highest for each of items (item_id, text)."""
    n_docs, n_terms = found.where("term IS NULL").agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    wanted = cut(items.select("item_id", F.explode(terms_of("text")).alias("t")).distinct())
    # Items by number, so that an item without an id is as good as others; blocks by the number's digits.
    numbered = cut(wanted.select("item_id").distinct().withColumn("item", F.monotonically_increasing_id()))
    blocks = max(1, -(-numbered.count() // block))
    numbered = numbered.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))
    asked = wanted.join(numbered.withColumnRenamed("item_id", "_id"), F.col("item_id").eqNullSafe(F.col("_id"))).select(F.col("t").cast("binary").alias("term"), "block", "item")
    df = found.join(asked.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("all"))
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2.0 * n_docs) + 2.0) / (F.col("all") * F.lit(2.0) + 1.0))).cast("long")
    weighed = cut(asked.join(df, "term").groupBy("term", "block").agg(F.collect_list("item").alias("items"), F.first(weight).alias("w")))
    lists = found.join(weighed, "term").select("shard", "block", "w", "items", "postings")
    none = F.lit(None)
    headers = found.where("term IS NULL").select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), none.cast("long").alias("w"), none.cast("array<long>").alias("items"), "postings")

    def scored(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        rows = list(zip(group["w"].to_pylist(), group["items"].to_pylist(), group["postings"].to_pylist()))
        out = list(_scores(rows, top, n_docs, n_terms))
        columns = zip(*out) if out else ((), (), ())
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns] + [pa.array([key[0].as_py()] * len(out), pa.string())], ["item", "doc_id", "score", "shard"])

    hits = lists.unionByName(headers).groupBy("shard", "block").applyInArrow(scored, "item long, doc_id long, score long, shard string")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = F.pmod(F.xxhash64("shard"), F.lit(PARTS))
    for by in ((F.col("item"), part), (F.col("item"),)):
        hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    return hits.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS d, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
p AS (SELECT d, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM t GROUP BY d, term),
n AS (SELECT d, sum(tf)::BIGINT AS own FROM p GROUP BY d),
g AS (SELECT count(*) AS docs, sum(own)::BIGINT AS terms FROM n),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY term, docs),
m AS (SELECT d, 100 - 50 + ((50 * own * docs) // terms) AS m FROM n, g),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, d, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (d) GROUP BY item_id, d),
r AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST))::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""
