"""Set operations, integrity of designs, leakage and splits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fenestra.functions.text import stable_key
from fenestra.operators.graph import grouped
from fenestra.operators.ranking import numbered, running


def leakage(rows: DataFrame, split: str, keys: Sequence[str]) -> DataFrame:
    """(key_name, key, splits): keys found in more than one split."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("key_name"), F.col(k).cast("string").alias("key")) for k in keys)))
    long = rows.select(split, pairs.alias("k")).select(split, "k.*").where(F.col("key").isNotNull() & (F.col("key") != ""))
    return long.groupBy("key_name", "key").agg(F.array_join(F.array_sort(F.collect_set(split)), ";").alias("splits")).where(F.contains("splits", F.lit(";")))


def shared(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).intersect(right.select(key))


def only_left(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).exceptAll(right.select(key)).distinct()


def incomplete(rows: DataFrame, subject: str, condition: str, conditions: Sequence, same: Sequence[str] = ()) -> DataFrame:
    """Subjects whose design is broken, and why: conditions missing or repeated, or fields that differ between conditions."""
    per = rows.groupBy(subject).agg(F.count("*").alias("n"), F.count_distinct(condition).alias("d"), *(F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))).alias(f"_{c}") for c in same))
    k = len(conditions)
    reasons = F.array_compact(F.array(F.when(F.col("d") < k, "missing_condition"), F.when(F.col("n") > F.col("d"), "repeated_condition"), *(F.when(F.col(f"_{c}") > 1, f"{c}_differs") for c in same)))
    return per.where(F.size(reasons) > 0).select(subject, F.array_join(reasons, ";").alias("problems"))


def snapshot_difference(before: DataFrame, after: DataFrame, path: str = "path", digest: str = "digest") -> DataFrame:
    """(path, change): added, removed or changed files of two snapshots."""
    b, a = before.select(path, F.col(digest).alias("b")), after.select(path, F.col(digest).alias("a"))
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").otherwise("changed")
    return b.join(a, path, "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select(path, change.alias("change"))


def tree_digest(files: DataFrame, by: Sequence[str], path: str = "path", digest: str = "digest", size: int = 1000) -> DataFrame:
    """(by, files, tree): one hash for each group's files, of their paths and hashes in order of paths.

    A group's lines are hashed in ranges of ``size``; the tree is the hash of its
    only range, else that of its ranges' hashes in order, one a line. So no row
    holds more than a range, or a group's hashes of ranges. Files without a hash are
    counted, and a line less; a null group is a group.
    """
    places = numbered(files.select(*by, path, digest), [*by, path, digest], "_at")
    first = places.groupBy(*by).agg(F.min("_at").alias("_first"))
    same = reduce(lambda a, b: a & b, (F.col(f"f.{n}").eqNullSafe(F.col(f"p.{n}")) for n in by))
    rows = places.alias("p").join(first.alias("f"), same).select("p.*", F.floor((F.col("_at") - F.col("_first")) / size).alias("_range"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(path, digest))), lambda x: F.concat(x[path], F.lit("\0"), x[digest]))
    ranges = rows.groupBy(*by, "_range").agg(F.count("*").alias("_n"), F.sha2(F.array_join(lines, "\n"), 256).alias("_hash"))
    hashes = F.transform(F.array_sort(F.collect_list(F.struct("_range", "_hash"))), lambda x: x["_hash"])
    groups = ranges.groupBy(*by).agg(F.sum("_n").alias("files"), hashes.alias("_h"))
    return groups.select(*by, "files", F.when(F.size("_h") == 1, F.col("_h")[0]).otherwise(F.sha2(F.array_join("_h", "\n"), 256)).alias("tree"))


def split_by_group(rows: DataFrame, unit: str, keys: Sequence[str], seed: str | int, share: float) -> DataFrame:
    """(unit, root, split): units that share a key stay together; groups in a repeatable order fill the development part up to its share of the rows."""
    roots = grouped(rows, unit, *keys)
    sizes = rows.groupBy(unit).agg(F.count("*").alias("n")).join(roots, unit).groupBy("root").agg(F.sum("n").alias("n"))
    placed = running(sizes.withColumn("_key", stable_key(seed, "root")), ["_key", "root"], {"_before": F.col("n")})
    whole = placed.agg(F.sum("n")).first()[0] or 0
    parts = placed.select("root", F.when(F.col("_before") < F.floor(F.lit(whole) * share), "development").otherwise("test").alias("split"))
    return roots.join(parts, "root").select(unit, "root", "split")


def best_seed(groups: DataFrame, root: str, n: str, seeds: int, share: float, coverage: str | None = None) -> DataFrame:
    """Of many random splits of the groups, the one closest to the share; first by categories missing from either part if a coverage column is given."""
    tried = groups.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    spread = F.conv(F.substring(F.sha2(F.concat_ws("|", F.col("seed").cast("string"), F.col(root).cast("string")), 256), 1, 8), 16, 10).cast("double") / float(1 << 32)
    parted = tried.withColumn("dev", spread < share)
    gap = F.abs(F.sum(F.when(F.col("dev"), F.col(n)).otherwise(0)) / F.sum(n) - share)
    per = parted.groupBy("seed").agg(gap.alias("gap"))
    if coverage:
        sides = parted.groupBy("seed", coverage).agg(F.count_distinct("dev").alias("sides"))
        per = per.join(sides.groupBy("seed").agg(F.count_if(F.col("sides") < 2).alias("missing")), "seed")
        order: list[Column | str] = ["missing", "gap", "seed"]
    else:
        order = ["gap", "seed"]
    return per.orderBy(*order).limit(1)
