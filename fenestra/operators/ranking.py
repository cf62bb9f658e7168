"""Ranks, caps, quotas and streaks. Every order ends in an identifier, so that none is left to chance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fenestra.checkpoints import written


def running(rows: DataFrame, order: Sequence[Column | str], amounts: dict[str, Column]) -> DataFrame:
    """rows, written, with the sum of each amount over all rows before, 0 for the first; no task holds all rows.

    Rows go to ranges of the order, which should be total; rows equal in it stay
    together. What comes before a range is summed over ranges, of which there are as
    many as partitions.
    """
    names = {n: f"_{n}" for n in amounts}
    parts = written(rows.withColumns({names[n]: a for n, a in amounts.items()}).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sums = parts.groupBy("_part").agg(*(F.sum(t).alias(t) for t in names.values()))
    sums = sums.select("_part", *(F.coalesce(F.sum(t).over(before), F.lit(0)).alias(f"{t}_before") for t in names.values()))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    full = parts.withColumns({n: F.coalesce(F.sum(t).over(inside), F.lit(0)) for n, t in names.items()}).join(F.broadcast(sums), "_part")
    return full.withColumns({n: F.col(n) + F.col(f"{t}_before") for n, t in names.items()}).drop("_part", *names.values(), *(f"{t}_before" for t in names.values()))


def numbered(rows: DataFrame, order: Sequence[Column | str], out: str = "position") -> DataFrame:
    """rows, written, with their places from 0 on in a total order."""
    return running(rows, order, {out: F.lit(1).cast("long")})


def ranked(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], out: str = "rank") -> DataFrame:
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], k: int = 1, out: str | None = None) -> DataFrame:
    """The first k rows of each group."""
    first = ranked(rows, by, order, "_rank").where(F.col("_rank") <= k)
    return first.withColumnRenamed("_rank", out) if out else first.drop("_rank")


def capped(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], maximum: int) -> DataFrame:
    """rows with over_cap: whether a row comes after the cap of its group."""
    return ranked(rows, by, order, "_rank").withColumn("over_cap", F.col("_rank") > maximum).drop("_rank")


def round_robin(rows: DataFrame, queue: str, order: Sequence[Column | str], limit: int, cap: int | None = None) -> DataFrame:
    """The first rows in turn from each queue, queues in their order; at most cap of each."""
    turn = ranked(rows, [queue], order, "turn")
    turn = turn.where(F.col("turn") <= cap) if cap else turn
    return turn.orderBy("turn", queue, *order).limit(limit)


def mid_ranks(rows: DataFrame, value: str, by: Sequence[str] = (), out: str = "mid_rank") -> DataFrame:
    """Ranks from 1, of equal values the mean; by equal values aggregated first, so that ranks are summed over values, not rows."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("_n"))
    if by:
        counts = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    else:
        counts = running(counts, [value], {"_upto": F.col("_n")}).withColumn("_upto", F.col("_upto") + F.col("_n"))
    mid = counts.withColumn(out, F.col("_upto") - (F.col("_n") - 1) / 2.0).drop("_n", "_upto")
    return rows.join(mid, [*by, value])


def holm(tests: DataFrame, p: str, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Step-down adjusted p-values of a family of tests."""
    family = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    order = family.orderBy(p, key)
    scaled = (F.count("*").over(family) - F.row_number().over(order) + 1) * F.col(p)
    return tests.withColumn("_scaled", scaled).withColumn("adjusted", F.least(F.lit(1.0), F.max("_scaled").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("_scaled")


def streaks(rows: DataFrame, by: Sequence[str], order: Sequence[str], improved: Column, out: str = "streak") -> DataFrame:
    """How many rows in a row, up to each, did not improve."""
    w = Window.partitionBy(*by).orderBy(*order)
    islands = rows.withColumn("_better", improved).withColumn("_island", F.sum(F.col("_better").cast("int")).over(w))
    inside = Window.partitionBy(*by, "_island").orderBy(*order)
    return islands.withColumn(out, F.sum((~F.col("_better")).cast("int")).over(inside)).drop("_better", "_island")


def until_met(rows: DataFrame, order: Sequence[Column | str], amount: str, minimum_rows: int, minimum_amount: float, by: Sequence[str] = ()) -> DataFrame:
    """Rows in order until both minimums are met, the row that meets them included."""
    if by:
        before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumns({"_rows": F.count("*").over(before), "_amount": F.coalesce(F.sum(amount).over(before), F.lit(0))})
    else:
        rows = running(rows, order, {"_rows": F.lit(1).cast("long"), "_amount": F.coalesce(amount, F.lit(0))})
    return rows.where((F.col("_rows") < minimum_rows) | (F.col("_amount") < minimum_amount)).drop("_rows", "_amount")
