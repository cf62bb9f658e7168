"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints that differ in at most ``tau`` bits are linked. The bits are
grouped into parts, correlated bits together, and each part i gets a threshold
t_i of its own, -1 or more, with sum(t_i + 1) = tau + 1; then of two linked
fingerprints some part differs in at most t_i bits, whatever the parts and
thresholds are. A dynamic programme picks the thresholds (and the number of
parts) that cost least by candidate counts estimated from a bounded sample of
fingerprints; the sample steers cost only, never results.

Two parts within t_i bits are equal outside some t_i of their bits, so probing
is an equi-join on the part with those bits masked. Rows with a key form a
bucket. Buckets hold distinct fingerprints (exact copies are one), and each is
verified pair by pair inside but gives only a spanning forest of its links, so
what leaves it grows with its members, not with their pairs. A bucket over
``BUCKET`` members is split by the pigeonhole again, over the bits that its key
leaves open, up to ``LEVELS`` times; what agrees in so many bits and is still
many is dealt into blocks of about ``BUCKET`` members, and each two blocks of it are
verified together, so no task holds more than two blocks and no pair is left out.
Large-star and small-star rounds join the forests to components.

Three bits of 64 find copies with very few changes only. ``near_duplicates`` with
``similar`` also links texts of whose sets of five-word shingles 0.8 or more is
shared (of a shorter text, all its words are the one shingle). Candidates are those
that agree in one of ``BANDS`` bands of ``ROWS`` minima of the sets: at 0.8, 5 pairs
in 100,000 agree in none, wherever the changes are. Every candidate is verified by
the sets themselves. Verified pairs of a bucket's members and a centre come first,
by ``STARS`` choices of the centre; then what is still in different
components, in blocks of at most ``CROWD`` members, two to a task: pairs are compared
there by their minima, then by their sets, in each band that they share, and only
a spanning forest of a block's links comes out, so no family gives all its pairs.

Defined results: null text and text without words have fingerprint 0, linked
like any other. component_id is the smallest non-null doc_id of the component,
null if it has none. Rows that repeat get the same result each.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from fenestra.llm.common import cut, table
from fenestra.operators.graph import components

BITS, TAU, SEED = 64, 3, 42
#: Fingerprints of the sample that steers the plan; members of a bucket that isn't split, times that one is; shingles hashed at a time.
SAMPLE, BUCKET, LEVELS, SHINGLES = 2048, 4096, 2, 1 << 16
#: Codes for similar texts, of CODE / 8 minima, a byte of each: a probe for each WIDTH of TABLES * 64, so BANDS of ROWS minima; words of a shingle.
TABLES, WIDTH, CODE, ROWS, WORDS = 8, 20, 1024, 5, 5
BANDS, MINIMA = TABLES * 64 // WIDTH, CODE // 8
#: Shared of all shingles, in tenths, from which texts are similar; equal minima below which they aren't looked at (4 deviations below: 3 pairs in 100,000); centres tried; members of a block, and bytes of their sets.
ALIKE, EQUAL, STARS, CROWD, BYTES = 8, 84, 2, 2000, 16 << 20
#: Cost of a pair to verify, in rows to shuffle.
PAIR_COST = 0.02


# -- fingerprints --------------------------------------------------------------
def fingerprint_of(text: bytes) -> int:
    """64 bits as a signed number."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - 2)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, SHINGLES):
        some = words[i : i + SHINGLES + 2]
        shingles = map(b" ".join, zip(some, some[1:], some[2:])) if len(words) > 2 else [b" ".join(words)]
        hashes = np.array([xxh64_intdigest(s, SEED) for s in shingles], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


@F.arrow_udf(T.LongType())
def fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array([fingerprint_of((x.as_py() or "").encode()) for x in texts], pa.int64())


MIX = np.uint64(0x9E3779B97F4A7C15)
MULTIPLIERS, FLIPS = np.random.Generator(np.random.PCG64(SEED)).integers(0, 1 << 63, (2, MINIMA, 1), np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
#: Shingles whose minima are taken at a time, few enough for a processor's cache.
STEP = 256


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted hashes of the distinct five-word shingles, each from the hashes of its words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - WORDS + 1)
    out = np.full(n, len(words) if len(words) < WORDS else WORDS, np.uint64)
    for i in range(min(WORDS, len(words))):
        out = (out ^ each[i : i + n]) * MIX
        out ^= out >> np.uint64(31)
    return np.unique(out)


def code_of(text: bytes) -> tuple[int, bytes, list[int]]:
    """The fingerprint, a byte of each minimum, and the probes; a text without words has no probes."""
    own = shingle_set(text)
    if not len(own):
        return 0, bytes(MINIMA), []
    least = np.full(MINIMA, (1 << 64) - 1, np.uint64)
    for i in range(0, len(own), STEP):
        some = own[None, i : i + STEP] ^ FLIPS
        some *= MULTIPLIERS
        np.minimum(least, some.min(1), out=least)
    bands = least[: BANDS * ROWS].reshape(BANDS, ROWS)
    return fingerprint_of(text), least.astype(np.uint8).tobytes(), [xxh64_intdigest(b.tobytes(), SEED) - (1 << 63) for b in bands]


@F.arrow_udf(T.StructType([T.StructField("fp", T.LongType()), T.StructField("code", T.BinaryType()), T.StructField("probes", T.ArrayType(T.LongType()))]))
def codes(texts: pa.Array) -> pa.Array:
    fps, bits, probes = zip(*(code_of((x.as_py() or "").encode()) for x in texts)) if len(texts) else ((), (), ())
    return pa.StructArray.from_arrays([pa.array(fps, pa.int64()), pa.array(bits, pa.binary()), pa.array(probes, pa.list_(pa.int64()))], ["fp", "code", "probes"])


@F.arrow_udf(T.BooleanType())
def may_be_similar(a: pa.Array, b: pa.Array) -> pa.Array:
    left, right = (np.frombuffer(b"".join(x.as_py() for x in side), np.uint8).reshape(-1, MINIMA) for side in (a, b))
    return pa.array((left == right).sum(1) >= EQUAL, pa.bool_())


def are_similar(x: np.ndarray, y: np.ndarray) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 10 * shared >= ALIKE * (len(x) + len(y) - shared)


@F.arrow_udf(T.BinaryType())
def shingle_sets(texts: pa.Array) -> pa.Array:
    return pa.array([shingle_set(x.as_py().encode()).tobytes() for x in texts], pa.binary())


def similar_forest(root: np.ndarray, part: np.ndarray | None, code: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of places that, with the members of one root taken as linked, link all that similar members do; with parts, members of different parts only are compared.

    Each pair is a branch of a tree, so there are fewer than members, however
    many of them are similar to each other.
    """
    open_, out = np.ones(len(root), bool), []
    for start in range(len(root)):
        if not open_[start]:
            continue
        todo = np.flatnonzero(open_ & (root == root[start])).tolist()
        open_[todo] = False
        while todo:
            at = todo.pop()
            rest = np.flatnonzero(open_ if part is None else open_ & (part != part[at]))
            near = rest[(code[rest] == code[at]).sum(1) >= EQUAL]
            for x in near.tolist():
                if open_[x] and are_similar(sets[at], sets[x]):
                    out.append((at, x))
                    own = np.flatnonzero(open_ & (root == root[x]))
                    open_[own] = False
                    todo.extend(own.tolist())
    return out


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])))
def links_inside(blocks: pa.Array, same: pa.Array) -> pa.Array:
    """Links of each block's members (fp, root, p, code, set), all of one band; a block of two parts is compared across them only, as each part is a block with itself."""
    out, ends = [], [0]
    for own, one in zip(blocks, same.to_pylist()):
        rows = own.values
        fp, root, part = (rows.field(c).to_numpy() for c in ("fp", "root", "p"))
        code = np.frombuffer(b"".join(x.as_py() for x in rows.field("code")), np.uint8).reshape(-1, MINIMA)
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in rows.field("set")]
        out += [(int(fp[a]), int(fp[b])) for a, b in similar_forest(root, None if one else part, code, sets)]
        ends.append(len(out))
    u, v = zip(*out) if out else ((), ())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"]))


@F.arrow_udf(T.BooleanType())
def similar(a: pa.Array, b: pa.Array) -> pa.Array:
    out, known, own = [], None, None
    for x, y in zip(a, b):
        text = x.as_py()
        if text != known:  # centres come in runs
            known, own = text, shingle_set(text.encode())
        out.append(are_similar(own, shingle_set(y.as_py().encode())))
    return pa.array(out, pa.bool_())


# -- the plan --------------------------------------------------------------------
def grouped_bits(bits: np.ndarray, m: int) -> list[list[int]]:
    """m parts of like sizes; each grows by the bit that correlates most with those it has. bits: sample x 64."""
    x = bits - bits.mean(0)
    deviation = np.sqrt((x * x).sum(0))
    corr = np.abs(x.T @ x) / np.maximum(np.outer(deviation, deviation), 1e-9)
    left, parts = list(range(BITS)), []
    for k in range(m):
        size = len(left) // (m - k)
        part = [max(left, key=lambda b: corr[b, left].sum())]
        left.remove(part[0])
        while len(part) < size:
            best = max(left, key=lambda b: corr[b, part].mean())
            part.append(best)
            left.remove(best)
        parts.append(sorted(part))
    return parts


def mask_of(part) -> int:
    return sum(1 << b for b in part)


def chosen(sample: np.ndarray, total: int, tau: int = TAU) -> list[tuple[int, int]]:
    """(mask, threshold) of each part that is used."""
    bits = (sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)
    best: tuple[float, list[tuple[int, int]]] = (float("inf"), [])
    for m in range(1, tau + 2):
        parts = grouped_bits(bits.astype(np.float64), m)
        costs = []
        for part in parts:
            w, own = len(part), sample & np.uint64(mask_of(part))
            near = np.zeros(tau + 1)
            for i in range(1, len(own)):
                near += np.bincount(np.bitwise_count(own[i:] ^ own[: len(own) - i]), minlength=BITS + 1)[: tau + 1]
            pairs = max(1, len(own) * (len(own) - 1) / 2)
            row = [0.0]
            for t in range(tau + 1):
                even = sum(comb(w, k) for k in range(t + 1)) / 2.0**w
                share = max(near[: t + 1].sum() / pairs, even)
                row.append(comb(w, t) * (1 + PAIR_COST * total * share / max(1, comb(w, t))) if comb(w, t) < 3000 else float("inf"))
            costs.append(row)
        # reach[b]: the least cost of the parts so far with sum(t + 1) = b
        reach: list[tuple[float, list[int]]] = [(0.0, [])] + [(float("inf"), [])] * (tau + 1)
        for row in costs:
            reach = [min(((reach[b - s][0] + row[s], [*reach[b - s][1], s - 1]) for s in range(b + 1)), key=lambda x: x[0]) for b in range(tau + 2)]
        cost, thresholds = reach[tau + 1]
        if cost < best[0]:
            best = (cost, [(mask_of(p), t) for p, t in zip(parts, thresholds) if t >= 0])
    return best[1]


def probes(parts: list[tuple[int, int]]) -> list[int]:
    """Masks whose equality finds all pairs within the parts' thresholds."""
    out = []
    for mask, t in parts:
        own = [b for b in range(BITS) if mask >> b & 1]
        out += [mask & ~mask_of(open_) for open_ in combinations(own, t)]
    return out


def narrowed(mask: int, tau: int = TAU) -> list[int]:
    """Masks for the members of one bucket: the bits that its key leaves open, in tau + 1 equal parts, one of which agrees."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    return [mask | mask_of(free[k :: tau + 1]) for k in range(tau + 1)]


# -- buckets ---------------------------------------------------------------------
def forest(values: np.ndarray, tau: int = TAU) -> list[tuple[int, int]]:
    """(member, smallest member it is linked to, directly or not) for all but the smallest of each linked set."""
    left, out = np.unique(values), []
    unsigned = left.view(np.uint64)
    open_ = np.ones(len(left), bool)
    for start in range(len(left)):
        if not open_[start]:
            continue
        open_[start] = False
        todo = [start]
        while todo:
            at = todo.pop()
            rest = np.flatnonzero(open_)
            near = rest[np.bitwise_count(unsigned[rest] ^ unsigned[at]) <= tau]
            open_[near] = False
            todo.extend(near.tolist())
            out.extend((int(left[i]), int(left[start])) for i in near)
    return out


EDGE = T.ArrayType(T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())]))


def _forests(tau: int):
    @F.arrow_udf(EDGE)
    def found(buckets: pa.Array) -> pa.Array:
        rows, ends = [], [0]
        values, at = buckets.flatten().to_numpy(), 0
        for n in buckets.value_lengths().to_pylist():
            own = values[at : at + n]
            at += n
            if n == 2:  # most buckets
                a, b = sorted(own.tolist())
                rows += [(b, a)] if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= tau else []
            else:
                rows += forest(np.ascontiguousarray(own), tau)
            ends.append(len(rows))
        u, v = zip(*rows) if rows else ((), ())
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"]))

    return found


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) of texts' hashes that are similar, with their fingerprints (x, y)."""
    side = lambda t, fp, code: nodes.select(F.col("t").alias(t), F.col("fp").alias(fp), F.col("code").alias(code))
    near = cut(pairs.join(side("u", "x", "cu"), "u").join(side("v", "y", "cv"), "v").where(may_be_similar("cu", "cv")).select("u", "v", "x", "y"))
    wanted = near.select(F.explode(F.array("u", "v")).alias("t")).distinct()
    own = cut(texts.join(wanted, "t", "left_semi").dropDuplicates(["t"]))
    both = near.join(own.select(F.col("t").alias("v"), F.col("text").alias("b")), "v").join(own.select(F.col("t").alias("u"), F.col("text").alias("a")), "u")
    return cut(both.where(similar("a", "b")).select("u", "v", "x", "y"))


def crowded_links(live: DataFrame, open_: DataFrame, nodes: DataFrame, texts: DataFrame, crowd: int) -> DataFrame:
    """Links (u, v) of fingerprints between members of open bands that are in different components, compared in blocks of at most ``crowd`` members and ``BYTES``, two to a task."""
    members = live.join(open_.select("b"), "b")
    wanted = members.select("t").distinct()
    own = cut(texts.join(wanted, "t", "left_semi").dropDuplicates(["t"]).select("t", shingle_sets("text").alias("set")))
    sizes = members.join(own.select("t", F.octet_length("set").alias("n")), "t").groupBy("b").agg(F.greatest(F.ceil(F.count("*") / crowd), F.ceil(F.sum("n") / BYTES)).cast("int").alias("parts"))
    full = members.join(sizes, "b").join(nodes.select("t", "fp", "code"), "t").join(own, "t").withColumn("p", F.pmod(F.xxhash64("t"), F.col("parts")).cast("int"))
    dealt = full.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q")).groupBy("b", F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi"))
    blocks = dealt.agg(F.collect_list(F.struct("fp", "root", "p", "code", "set")).alias("members")).where(F.size("members") > 1)
    return cut(blocks.select(F.explode(links_inside("members", F.col("lo") == F.col("hi"))).alias("e")).select("e.u", "e.v").distinct())


def similar_edges(nodes: DataFrame, texts: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links (u, v) between fingerprints that connect all that similar candidates do. nodes: (t, fp, code, probes), t a text's hash and unique; texts: (t, text)."""
    rows = nodes.select("t", F.posexplode("probes")).select("pos", F.xxhash64("pos", "col").alias("b"), "t")
    shared = rows.groupBy("b").agg(F.count("*").alias("n")).where("n > 1")
    live = cut(rows.join(shared.select("b"), "b", "left_semi").withColumn("root", F.col("t")))
    nodes, pair = nodes.drop("probes"), [F.least("t", "c").alias("u"), F.greatest("t", "c").alias("v")]
    tried, found, links = None, None, nodes.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0)
    for turn in range(STARS + 1):
        centre = F.min(F.struct(F.xxhash64("t", F.lit(turn)), F.col("t").alias("c"), F.col("root").alias("at"))).alias("centre")
        open_ = live.groupBy("b").agg(F.min("root").alias("low"), F.max("root").alias("high"), centre).where("low < high")
        if turn == STARS:
            open_ = cut(open_.select("b"))
            return links if open_.isEmpty() else links.unionByName(crowded_links(live, open_, nodes, texts, crowd)).where("u != v").distinct()
        pairs = live.join(open_.select("b", "centre.c", "centre.at"), "b").where("root != at").select(*pair).distinct()
        pairs = cut(pairs if tried is None else pairs.join(tried, ["u", "v"], "left_anti"))
        if pairs.isEmpty():
            continue
        own = verified(pairs, nodes, texts)
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = own if found is None else found.unionByName(own)
        links = links.unionByName(own.select(F.col("x").alias("u"), F.col("y").alias("v")))
        roots = components(found.select("u", "v")).select(F.col("u").alias("t"), F.col("root").alias("r"))
        live = cut(live.join(roots, "t", "left").select("pos", "b", "t", F.coalesce("r", "t").alias("root")))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def keyed(fps: DataFrame, masks: list[int]) -> DataFrame:
    probe = F.explode(F.array(*(F.struct(F.lit(i).alias("probe"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks))))
    return fps.select("fp", probe.alias("k")).select("k.probe", "k.key", "fp")


def block_pairs(rows: DataFrame, large: DataFrame, bucket: int) -> DataFrame:
    """rows of the large buckets (probe, key, count), dealt into blocks; every two blocks of a bucket are a bucket in turn, so every pair of members shares one."""
    parts = rows.join(large.select("probe", "key", F.ceil(F.col("count") / bucket).cast("int").alias("parts")), ["probe", "key"])
    own = parts.withColumn("p", F.pmod(F.xxhash64("fp", F.lit(SEED)), F.col("parts")).cast("int"))
    both = own.select("*", F.explode(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: q != F.col("p"))).alias("q"))
    return both.select("probe", F.xxhash64("key", F.least("p", "q"), F.greatest("p", "q")).alias("key"), "fp")


def edges(fps: DataFrame, total: int, tau: int = TAU, bucket: int = BUCKET) -> DataFrame:
    """Links (u, v) that connect the same fingerprints as all links do. fps: distinct, in column fp."""
    sample = np.array([r[0] for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    masks = probes(chosen(sample, total, tau)) if len(sample) else [(1 << 64) - 1]
    rows, out, found = keyed(fps, masks), None, _forests(tau)
    for level in range(LEVELS + 1):
        large = cut(rows.groupBy("probe", "key").count().where(F.col("count") > bucket))
        over = large.count()
        fit = rows.join(large, ["probe", "key"], "left_anti") if over else rows
        if over and level == LEVELS:
            fit = fit.unionByName(block_pairs(rows, large, bucket))
        buckets = fit.groupBy("probe", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
        own = buckets.select(F.explode(found("fps")).alias("e")).select("e.u", "e.v")
        out = own if out is None else out.unionByName(own)
        if not over or level == LEVELS:
            break
        split_up = {r[0] for r in large.select("probe").distinct().collect()}  # of at most as many as there are masks
        finer = [(i, m) for i, mask in enumerate(masks) if i in split_up for m in narrowed(mask, tau)]
        split = F.array(*(F.struct(F.lit(i).alias("from"), F.lit(j).alias("probe"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for j, (i, m) in enumerate(finer)))
        inside = rows.join(large, ["probe", "key"], "left_semi")
        rows = cut(inside.select("fp", F.explode(F.filter(split, lambda s: s["from"] == F.col("probe"))).alias("k")).select("k.probe", "k.key", "fp"))
        masks = [m for _, m in finer]
    return out.distinct()


# -- components ------------------------------------------------------------------
def near_duplicates(docs: DataFrame, tau: int = TAU, text: str | Column = "text", similar: bool = False) -> DataFrame:
    """doc_id, fp and component_id for each row of docs; similar: whether similar texts are linked as well, with columns t, a hash of the text, and root, which tells components apart whose smallest ids are equal."""
    column = F.col(text) if isinstance(text, str) else text
    if similar:
        rows = cut(docs.select("doc_id", F.xxhash64(column).alias("t"), codes(column).alias("c")).select("doc_id", "t", "c.*"))
    else:
        rows = cut(docs.select("doc_id", fingerprints(column).alias("fp")))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("lowest")))
    links = edges(nodes.select("fp"), nodes.count(), tau)
    if similar:
        distinct = cut(rows.where(F.size("probes") > 0).select("t", "fp", "code", "probes").dropDuplicates(["t"]))
        links = links.unionByName(similar_edges(distinct, docs.select(F.xxhash64(column).alias("t"), column.alias("text"))))
    # Nodes are ordered by their smallest doc_id, those without one last, so a component's root has its id and nothing is joined by root.
    named = nodes.select("fp", F.struct(F.col("lowest").isNull().alias("none"), "lowest", "fp").alias("node"))
    end = lambda c: named.select(F.col("fp").alias(c), F.col("node").alias(f"{c}_node"))
    roots = components(links.join(end("u"), "u").join(end("v"), "v").select(F.col("u_node").alias("u"), F.col("v_node").alias("v")))
    joined = nodes.join(roots.select(F.col("u.fp").alias("fp"), F.col("root.lowest").alias("first"), F.col("root.fp").alias("root")), "fp", "left")
    joined = joined.select("fp", F.coalesce("first", "lowest").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    return rows.select("doc_id", "fp", "t").join(joined, "fp") if similar else rows.select("doc_id", "fp").join(joined.drop("root"), "fp")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one document of each component of equal, nearly equal and similar texts, the one with its smallest doc_id; a row without doc_id stays.

    Rows that share a doc_id are decided on by their texts: each may stay for a
    component of its own; of those of one component, the text with the smallest
    hash, and of rows that are alike in both, the first by a hash of all columns.
    """
    found = cut(near_duplicates(docs, similar=True))
    known = found.where(F.col("doc_id").isNotNull())
    if known.groupBy("doc_id").count().where("count > 1").isEmpty():
        gone = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id")
        return docs.join(gone, "doc_id", "left_anti")
    stays = known.where(F.col("doc_id") == F.col("component_id")).groupBy("root").agg(F.min(F.struct("doc_id", "t")).alias("k")).select("k.*").distinct()
    rows = docs.where(F.col("doc_id").isNotNull()).withColumn("_simhash_t", F.xxhash64("text"))
    kept = rows.join(stays.withColumnRenamed("t", "_simhash_t"), ["doc_id", "_simhash_t"], "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id", "_simhash_t").orderBy(F.xxhash64(*docs.columns), *docs.columns))
    one = kept.withColumn("_simhash_n", first).where("_simhash_n = 1").select(*docs.columns)
    return one.unionByName(docs.where(F.col("doc_id").isNull()))
