"""Exact paired tests, bootstrap intervals, percentiles.

Counts are aggregated by Spark; what a test sees is one row for a group: two
counts, or the counts of distinct absolute differences. The tests take the
exact distribution at every size; beyond ``EXACT`` subjects its terms are
floating-point numbers instead of fractions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction
from math import asin, comb, exp, gcd, lgamma, log, pi

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Subjects up to which sign patterns are counted in whole numbers; products of a rank sum's size and the differences up to which sums are added one difference at a time; the greatest rank sum up to which all sums are held; points of an integral at a time, and the logarithm of what is too small to count in it.
EXACT, STEPWISE, HELD, POINTS, FAINT = 2000, 1 << 31, 1 << 22, 1 << 17, 55


def binomial_p(x: int, y: int) -> float:
    """P of a split as uneven as x to y, or more so, if both sides are as likely; 1 without any."""
    n, k = x + y, min(x, y)
    if n <= EXACT:
        return min(1.0, float(Fraction(2 * sum(comb(n, i) for i in range(k + 1)), 2**n))) if n else 1.0
    # The tail, from its largest term down: each is the one before times i / (n - i + 1).
    first, total, term, i = lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * log(2), 1.0, 1.0, k
    while i > 0 and term > 1e-18 * total:
        term *= i / (n - i + 1)
        total += term
        i -= 1
    return min(1.0, 2 * exp(first + log(total)))


@F.pandas_udf(T.DoubleType())
def binomial_two_sided(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([binomial_p(int(x), int(y)) for x, y in zip(a, b)])


def sign_test(pairs: DataFrame, delta: str = "delta", by: Sequence[str] = ()) -> DataFrame:
    counts = pairs.groupBy(*by).agg(F.count_if(F.col(delta) > 0).alias("wins"), F.count_if(F.col(delta) < 0).alias("losses"), F.count_if(F.col(delta) == 0).alias("ties"))
    return counts.withColumn("p_value", binomial_two_sided("wins", "losses"))


def mcnemar(pairs: DataFrame, first: str, second: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact test of two yes-or-no outcomes of the same subjects."""
    counts = pairs.groupBy(*by).agg(F.count_if(F.col(first) & ~F.col(second)).alias("only_first"), F.count_if(~F.col(first) & F.col(second)).alias("only_second"), F.count("*").alias("n"))
    return counts.withColumn("p_value", binomial_two_sided("only_first", "only_second"))


def rank_sums(steps: list[tuple[int, int, float]]) -> np.ndarray:
    """Chances of each sum of ranks, if each of n ranks r of the steps (r, n, q) is in it with chance q or not."""
    total, count = sum(r * n for r, n, _ in steps), sum(n for _, n, _ in steps)
    if len(steps) > 1 and total * count > STEPWISE:  # halves, multiplied as polynomials
        half = len(steps) // 2
        a, b = rank_sums(steps[:half]), rank_sums(steps[half:])
        size = 1 << (total).bit_length()
        return np.maximum(np.fft.irfft(np.fft.rfft(a, size) * np.fft.rfft(b, size), size)[: total + 1], 0)
    out = np.ones(1)
    for r, n, q in steps:
        for _ in range(n):
            longer = np.zeros(len(out) + r)
            longer[: len(out)] = out * (1 - q)
            longer[r:] += out * q
            out = longer
    return out


def _near(rank: int, circle: int, reach: float) -> Iterator[np.ndarray]:
    """The points k of the upper half of a circle for which the squared sine of half of k ranks' angle is up to ``reach``, some at a time."""
    if reach >= 1:
        for start in range(0, circle // 2 + 1, POINTS):
            yield np.arange(start, min(start + POINTS, circle // 2 + 1), dtype=np.int64)
        return
    wide = int(2 * asin(reach**0.5) / (2 * pi) * circle) + 1
    turns = max(1, POINTS * rank // (2 * wide + rank))  # of as many points together
    for start in range(0, rank // 2 + 2, turns):
        middle = np.arange(start, min(start + turns, rank // 2 + 2), dtype=np.int64) * circle
        low, high = np.maximum(-((wide - middle) // rank), 0), np.minimum((middle + wide) // rank, circle // 2)
        low[1:] = np.maximum(low[1:], high[:-1] + 1)
        many = np.maximum(high - low + 1, 0)
        k = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
        for part in range(0, len(k), POINTS):
            yield k[part : part + POINTS]


def integrated_tail(r: np.ndarray, n: np.ndarray, most: int, t: float) -> float:
    """``lower_tail`` of n times each rank r (whole numbers, as floats) by the integral that inverts the transform of the sum, tilted by t < 0.

    The tail is the mean, over a circle of points w, of M(t + iw) / (e^(most (t + iw))
    (1 - e^(t + iw))), M the product of (1 + e^((t + iw) r)) / 2. With points enough
    for 80 standard deviations of the tilted sum, what the sum of points adds to the
    integral is under e^-40 of it. Where the product of some factors is under e^-55 of
    its greatest, the others aren't looked at: that is nearly everywhere, and of the strongest factor known beforehand. Points are
    taken some at a time, so nothing grows with the sums; their number grows with the
    1.5th power of the differences.
    """
    q = lambda t: 1 / (1 + np.exp(np.minimum(-t * r, 700)))
    spread = lambda t: float(np.sqrt((n * r * r * q(t) * (1 - q(t))).sum()))
    while t > -1 / max(spread(t), 1e-9):  # not nearer to the pole at 0 than a deviation
        t = -1 / max(spread(t), 1e-9) * 1.000001
    chance, circle = q(t), max(1 << 12, int(80 * spread(t)) + 1)
    whole, total = r.astype(np.int64), 0.0
    # How far from a whole turn a factor may be: its size falls with the squared sine of half the angle.
    reach = np.minimum(-np.expm1(-2 * FAINT / n) / np.maximum(4 * chance * (1 - chance), 1e-300), 1)
    order = np.argsort(reach, kind="stable")
    for k in _near(int(whole[order[0]]), circle, float(reach[order[0]])):
        size = np.zeros(len(k))
        for i in order:
            angle = (k * (whole[i] % circle) % circle) * (2 * np.pi / circle)
            size += n[i] / 2 * np.log1p(np.maximum(-4 * chance[i] * (1 - chance[i]) * np.sin(angle / 2) ** 2, -1 + 1e-300))
            near = size > -FAINT
            if not near.all():
                k, size = k[near], size[near]
        if len(k):
            w, turn = k * (2 * np.pi / circle), (k * (most % circle) % circle) * (-2 * np.pi / circle)
            for i in range(len(r)):
                angle = (k * (whole[i] % circle) % circle) * (2 * np.pi / circle)
                turn += n[i] * np.arctan2(chance[i] * np.sin(angle), 1 - 2 * chance[i] * np.sin(angle / 2) ** 2)
            value = np.exp(size) * (np.exp(1j * turn) / (1 - np.exp(t + 1j * w))).real
            total += float((value * np.where((k == 0) | (2 * k == circle), 1.0, 2.0)).sum())
    tilt = float((n * (np.logaddexp(0, t * r) - log(2))).sum() - t * most)
    return exp(tilt) * total / circle


def lower_tail(steps: list[tuple[int, int]], most: int) -> float:
    """The chance that a sum of ranks is at most ``most``, if each of n ranks r of the steps (r, n) is in it or not; most is under half of all.

    Errors of a product of polynomials are of the size of its largest terms, and
    a tail may be smaller by hundreds of orders. So chances are tilted by
    exp(t r), with the t for which the mean sum is ``most``: there the tail is where
    the mass is. Taking the tilt back is exact but for rounding.
    """
    common = gcd(*(r for r, _ in steps))
    r, n, most = np.array([r // common for r, _ in steps], float), np.array([n for _, n in steps], float), most // common
    if n.sum() <= 52:  # chances are multiples of 2^-52: nothing is rounded, so nothing need be tilted
        return float(rank_sums([(int(x), int(k), 0.5) for x, k in zip(r, n)])[: most + 1].sum())
    chance = lambda t: 1 / (1 + np.exp(np.minimum(-t * r, 700)))
    low, high = -800.0, 0.0
    for _ in range(200):
        t = (low + high) / 2
        low, high = (t, high) if float((n * r * chance(t)).sum()) < most else (low, t)
    t = max((low + high) / 2, -40.0)
    if float((n * r).sum()) > HELD:
        return integrated_tail(r, n, most, t)
    tilted = rank_sums([(int(x), int(k), float(q)) for x, k, q in zip(r, n, chance(t))])[: most + 1]
    back = np.exp(t * (most - np.arange(most + 1)))
    return float(exp((n * (np.log1p(np.exp(t * r)) - log(2))).sum() - t * most) * (tilted * back).sum())


def wilcoxon_p(positive: list[tuple[float, int]], ties: list[tuple[float, int]]) -> tuple[float, float]:
    """(sum of positive ranks, two-sided p). ties: how often each absolute difference is there, positive: how often as a positive one."""
    ranks, seen = {}, 0
    for value, n in sorted(ties):
        ranks[value] = 2 * seen + n + 1  # twice the mid-rank
        seen += n
    if seen == 0:
        return 0.0, 1.0
    w, total = sum(ranks[v] * n for v, n in positive), sum(ranks[v] * n for v, n in ties)
    if 2 * w == total:
        return w / 2, 1.0
    # Sums are as likely from below as from above.
    return w / 2, min(1.0, 2 * lower_tail([(ranks[v], n) for v, n in sorted(ties)], min(w, total - w)))


def wilcoxon(pairs: DataFrame, delta: str = "delta", by: Sequence[str] = ()) -> DataFrame:
    """Signed-rank test; zeros are left out, ties get mid-ranks. A group's distinct differences go to one task; its rank sums are held there only up to ``HELD`` of them."""
    per = pairs.where(F.col(delta) != 0).groupBy(*by, F.abs(delta).cast("double").alias("v")).agg(F.count("*").alias("n"), F.count_if(F.col(delta) > 0).alias("up"))
    grouped_ = per.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("v", "n", "up"))).alias("values"))

    @F.pandas_udf("w_plus double, p_value double, n long")
    def tested(values: pd.Series) -> pd.DataFrame:
        rows = []
        for own in values:
            ties = [(x["v"], int(x["n"])) for x in own]
            w, p = wilcoxon_p([(x["v"], int(x["up"])) for x in own], ties)
            rows.append((w, p, sum(n for _, n in ties)))
        return pd.DataFrame(rows, columns=["w_plus", "p_value", "n"])

    if by:  # few rows, each of some work: dealt, as a plan by bytes would give them to one task
        grouped_ = grouped_.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
    return grouped_.withColumn("t", tested("values")).select(*by, "t.*")


def bootstrap_mean(rows: DataFrame, value: str, key: str, resamples: int, seed: int, level: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """Interval of the mean by a Poisson bootstrap: in each resample a row counts as often as a hash of seed, resample and key says.

    Rows of any number are summed where they are; only sums per resample are shuffled.
    """
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("resample").cast("string"), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    # How often: the inverse of the Poisson distribution of mean 1.
    weight, below, term = F.lit(0), 0.0, 0.36787944117144233
    for k in range(1, 12):
        below += term
        weight = weight + (u >= below).cast("int")
        term /= k
    drawn = rows.select(*by, F.col(value).cast("double").alias("_v"), key, F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("resample")).withColumn("_w", weight)
    means = drawn.groupBy(*by, "resample").agg(F.try_divide(F.sum(F.col("_v") * F.col("_w")), F.sum("_w").cast("double")).alias("mean"))
    low = (1 - level) / 2
    return means.groupBy(*by).agg(F.percentile("mean", low).alias("low"), F.percentile("mean", 1 - low).alias("high"), F.count("*").alias("resamples"))
