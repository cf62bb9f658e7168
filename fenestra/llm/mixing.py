"""Mixing sources to target weights: a time-varying curriculum.

Each source has a weight, and a schedule: how densely its words are wanted at
each moment of training, from 0 to 1. ``plan`` gives every source its target
(shares by weight, at most ``epochs`` times its words, the excess shared anew),
lays its documents end to end in an order that depends only on their ids, takes
whole passes and then documents up to the target, and inverts the integral of
the schedule at the middle of each copy: the moment at which the source's
demand reaches it. What all sources together demand up to that moment, in
words, is the copy's training position. ``training_order`` has a row for each
copy, range-sorted by position. ``taken`` of a source differs from its target
by at most half a document.

Running sums are taken in buckets of some hundred documents of a source, over
buckets in groups of ``GROUP``, and over groups, so a source that holds most
rows is spread as well. Sources are numbered in their order by ranges; targets
are found in rounds of sums over sources.

Defined results: null text has size 0 and is taken no words; a null source is a
source, the last; rows without doc_id are ordered by their texts; rows that
repeat are laid out one after another. With no words at all, targets are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fenestra.llm.common import WORD, cut, table

#: Weights of the sources in order, repeating; passes over a source at most; documents of a bucket; buckets of a group.
WEIGHTS, EPOCHS, BUCKET, GROUP = (1.0, 2.0, 3.0), 3, 500, 4096
#: Schedules by weight number, as densities at moments from 0 to 1: early, even, late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0)))


def numbered(rows: DataFrame, order: Column, name: str) -> DataFrame:
    """rows with their place in the order, from 0; each range of it is numbered by itself, after the rows of the ranges before."""
    placed = cut(rows.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    sizes = dict(placed.groupBy("_range").count().collect())  # of as many ranges as there are partitions
    before, at = 0, {}
    for k in sorted(sizes):
        at[k], before = before, before + sizes[k]
    start = F.element_at(F.create_map(*(F.lit(x) for kv in at.items() for x in kv)), F.col("_range")) if at else F.lit(0)
    return placed.withColumn(name, F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1 + start).drop("_range")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """A row for each source: source_size, kind (of weight and schedule), target."""
    totals = numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), F.col("source").asc_nulls_last(), "_place")
    named = totals.withColumn("kind", F.pmod("_place", F.lit(len(weights)))).drop("_place")
    weighed = cut(named.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("kind") + 1).cast("int"))).withColumn("cap", F.col("source_size") * float(epochs)))
    # The level is what each unit of weight gets; sources whose cap is below it are capped, which raises it for the others.
    level = 0.0
    while True:
        capped = F.col("cap") < F.lit(level) * F.col("weight")
        free = F.sum(F.when(~capped, F.col("weight")))
        r = weighed.agg(F.sum("source_size").alias("all"), F.sum(F.when(capped, F.col("cap"))).alias("full"), free.alias("free")).first()
        new = ((r["all"] or 0) - (r["full"] or 0.0)) / r["free"] if r["free"] else level
        if new <= level * (1 + 1e-12):
            break
        level = new
    return weighed.withColumn("target", F.least("cap", F.lit(float(level)) * F.col("weight"))).select("source", "source_size", "kind", "target")


def integral(t: Column, schedule: tuple[tuple[float, float], ...]) -> Column:
    """The share of a piecewise linear density's whole that is before t."""
    out, whole = F.lit(0.0), 0.0
    for (t0, v0), (t1, v1) in zip(schedule, schedule[1:]):
        w = F.least(F.greatest(t - t0, F.lit(0.0)), F.lit(t1 - t0))
        out = out + w * v0 + (v1 - v0) / (t1 - t0) * w * w / 2
        whole += (v0 + v1) / 2 * (t1 - t0)
    return out / whole


def moment(share: Column, schedule: tuple[tuple[float, float], ...]) -> Column:
    """The time at which the integral of a piecewise linear density reaches a share of its whole."""
    pieces, whole = [], 0.0
    for (t0, v0), (t1, v1) in zip(schedule, schedule[1:]):
        pieces.append((t0, v0, (v1 - v0) / (t1 - t0), whole))
        whole += (v0 + v1) / 2 * (t1 - t0)
    wanted, out = share * whole, None
    for t0, v0, slope, start in pieces:
        rest = F.greatest(wanted - start, F.lit(0.0))
        root = v0 + F.sqrt(F.greatest(v0 * v0 + 2 * slope * rest, F.lit(0.0)))
        at = F.when(root > 0, t0 + 2 * rest / root).otherwise(F.lit(t0))
        out = at if out is None else F.when(wanted >= start, at).otherwise(out)
    return F.least(out, F.lit(1.0))


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, schedules: tuple = SCHEDULES, epochs: int = EPOCHS, rows: int | None = None) -> DataFrame:
    """docs (doc_id, source, size, and others) with size, source_size, target, copies, taken and moments, an array with one for each copy."""
    rows = docs.count() if rows is None else rows
    # The order: by the digest of the id; a bucket is a range of digests.
    digest = F.col("_digest") if "_digest" in docs.columns else digest_of("doc_id")
    spread = F.coalesce(F.conv(F.substring("_digest", 1, 8), 16, 10).cast("long"), F.lit(0))
    laid = docs.withColumn("_digest", digest).withColumn("_bucket", F.floor(spread * F.lit(rows // BUCKET + 1) / F.lit(float(1 << 32))).cast("long"))
    sums = cut(laid.groupBy("source", "_bucket").agg(F.sum("size").alias("_words"))).withColumn("_group", F.floor(F.col("_bucket") / GROUP))
    sources = cut(targets(sums.select("source", F.col("_words").alias("size")), weights, epochs))
    so_far = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c, *keys: F.coalesce(F.sum(c).over(so_far(*keys)), F.lit(0))
    groups = sums.groupBy(F.col("source").alias("_s"), F.col("_group").alias("_g")).agg(F.sum("_words").alias("_words")).select("_s", "_g", earlier("_words", "_s", "_g").alias("_group_start"))
    in_groups = sums.select("source", "_bucket", "_group", earlier("_words", "source", "_group", "_bucket").alias("_in_group"))
    starts = in_groups.join(groups, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_group") == F.col("_g"))).select(F.col("source").alias("_source"), F.col("_bucket").alias("_b"), (F.col("_group_start") + F.col("_in_group")).alias("_start"))
    in_bucket = Window.partitionBy("source", "_bucket").orderBy("_digest", "size").rowsBetween(Window.unboundedPreceding, -1)
    running = laid.withColumn("_within", F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
    placed = running.join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_b")), "left")
    sources = sources.withColumnRenamed("source", "_named")
    full = placed.join(sources, F.col("source").eqNullSafe(F.col("_named")), "left").withColumn("_before", F.col("_start") + F.col("_within"))
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(epochs))).otherwise(0).cast("long")
    rest = F.col("target") - passes * F.col("source_size")
    once_more = ((2 * F.col("_before") + F.col("size")) <= 2 * rest) & (passes < epochs) & (F.col("size") > 0)
    full = full.withColumn("copies", F.when(F.col("size") > 0, passes).otherwise(0) + once_more.cast("int"))
    middle = lambda k: (k * F.col("source_size") + F.col("_before") + F.col("size") / 2) / F.col("target")

    demand = {r["kind"]: r["t"] for r in sources.groupBy("kind").agg(F.sum("target").alias("t")).collect()}  # of as many kinds as schedules

    def at(k: Column) -> Column:
        out = moment(middle(k), schedules[-1])
        for i, schedule in enumerate(schedules[:-1]):
            out = F.when(F.col("kind") == i, moment(middle(k), schedule)).otherwise(out)
        return out

    position = lambda t: sum((F.lit(demand.get(i, 0.0)) * integral(t, s) for i, s in enumerate(schedules)), F.lit(0.0))
    moments = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int")), at)).otherwise(F.array().cast("array<double>"))
    timed = full.withColumn("taken", F.col("size") * F.col("copies")).withColumn("moments", moments).withColumn("positions", F.transform("moments", position))
    return timed.select(*(c for c in docs.columns if c != "_digest"), "source_size", "target", "copies", "taken", "moments", "positions")


def training_order(planned: DataFrame) -> DataFrame:
    """A row for each copy of a document, range-sorted by the position, in words, at which training reaches it."""
    return planned.withColumn("position", F.explode("positions")).drop("moments", "positions").orderBy("position", "doc_id")


def digest_of(*columns: str) -> Column:
    """The digest of the first that isn't null, as text; empty if all are."""
    return F.coalesce(*(F.md5(F.col(c).cast("string").cast("binary")) for c in columns), F.lit(""))


def sized(docs: DataFrame) -> DataFrame:
    """docs with their size and what orders them, instead of text."""
    return docs.withColumns({"size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"), "_digest": digest_of("doc_id", "text")}).drop("text")


def mixed(docs: DataFrame) -> DataFrame:
    """The training order of docs, with their columns only."""
    inner = docs.withColumn("_document", F.struct(*(F.col(f"`{c}`") for c in docs.columns))).select("_document", "doc_id", "source", "text")
    return training_order(plan(sized(inner), rows=docs.count())).select("_document.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan, in the order in which training first reaches the documents; those it takes nothing of are last."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    planned = plan(cut(sized(docs)))
    ends = [F.round(f(c), digits).alias(f"{end}_{c[:-1]}") for c, digits in (("moments", 6), ("positions", 2)) for end, f in (("first", F.array_min), ("last", F.array_max))]
    shown = planned.select("doc_id", "size", "source_size", "target", "taken", *ends)
    return shown.orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


OP8_SQL = r"""
WITH s AS (SELECT doc_id, source, coalesce(md5(doc_id::VARCHAR), md5(text), '') AS digest, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
tot AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS kind, source_size * 3.0::DOUBLE AS cap FROM tot),
w2 AS (SELECT *, (kind + 1)::DOUBLE AS weight FROM w),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER b, 0.0::DOUBLE)) / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER b, 0.0::DOUBLE)) AS level
      FROM w2 WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT arg_min(level, cap / weight) AS common FROM l WHERE cap >= level * weight),
t AS (SELECT l.source, l.source_size, l.kind, least(l.cap, coalesce(c.common, 0) * l.weight) AS target FROM l, c),
p AS (SELECT s.*, t.source_size, t.target, t.kind, coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.digest, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS passes FROM p),
r AS (SELECT *, CASE WHEN size > 0 THEN passes + (CASE WHEN 2 * prior + size <= 2 * (target - passes * source_size) AND passes < 3 THEN 1 ELSE 0 END) ELSE 0 END AS copies FROM q),
m AS (SELECT *, (prior + size / 2.0::DOUBLE) / target AS y1, ((copies - 1) * source_size + prior + size / 2.0::DOUBLE) / target AS y2 FROM r),
f AS (SELECT *,
  CASE kind WHEN 0 THEN 2 * y1 / (1.5 + sqrt(greatest(2.25 - 2 * y1, 0))) WHEN 1 THEN y1
    ELSE CASE WHEN y1 >= 0.3125 / 1.0 THEN 0.5 + 2 * (y1 - 0.3125) / (0.75 + sqrt(0.5625 + 5.0 * (y1 - 0.3125))) ELSE 2 * y1 / (0.5 + sqrt(0.25 + y1)) END END AS t1,
  CASE kind WHEN 0 THEN 2 * y2 / (1.5 + sqrt(greatest(2.25 - 2 * y2, 0))) WHEN 1 THEN y2
    ELSE CASE WHEN y2 >= 0.3125 / 1.0 THEN 0.5 + 2 * (y2 - 0.3125) / (0.75 + sqrt(0.5625 + 5.0 * (y2 - 0.3125))) ELSE 2 * y2 / (0.5 + sqrt(0.25 + y2)) END END AS t2 FROM m),
k AS (SELECT coalesce(sum(target) FILTER (kind = 0), 0) AS k0, coalesce(sum(target) FILTER (kind = 1), 0) AS k1, coalesce(sum(target) FILTER (kind = 2), 0) AS k2 FROM t),
h AS (SELECT *, least(t1, 1.0) AS m1, least(t2, 1.0) AS m2 FROM f, k)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken,
  CASE WHEN copies > 0 THEN round(m1, 6) END AS first_moment, CASE WHEN copies > 0 THEN round(m2, 6) END AS last_moment,
  CASE WHEN copies > 0 THEN round(k0 * (1.5 * m1 - 0.5 * m1 * m1) + k1 * m1 + k2 * CASE WHEN m1 < 0.5 THEN 0.5 * m1 + 0.25 * m1 * m1 ELSE 0.3125 + 0.75 * (m1 - 0.5) + 1.25 * (m1 - 0.5) * (m1 - 0.5) END, 2) END AS first_position,
  CASE WHEN copies > 0 THEN round(k0 * (1.5 * m2 - 0.5 * m2 * m2) + k1 * m2 + k2 * CASE WHEN m2 < 0.5 THEN 0.5 * m2 + 0.25 * m2 * m2 ELSE 0.3125 + 0.75 * (m2 - 0.5) + 1.25 * (m2 - 0.5) * (m2 - 0.5) END, 2) END AS last_position
FROM h
"""
