"""Manifests put together from parts, and candidates of one repository merged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fenestra.functions.text import repository_url


def combined(parts: dict[str, DataFrame], key: str, excluded: DataFrame | None = None, without: tuple[str, ...] = ()) -> DataFrame:
    """Rows of all parts with source_partition; the parts named in ``without`` lose the keys of excluded. Columns that a part lacks are null; a null key is never excluded."""
    gone = None if excluded is None else excluded.select(key).distinct()
    rows = (part.join(gone, key, "left_anti") if gone is not None and name in without else part for name, part in parts.items())
    tagged = [df.withColumn("source_partition", F.lit(name)) for name, df in zip(parts, rows)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def faults(rows: DataFrame, key: str, expected: dict[str, int]) -> DataFrame:
    """(check, expected, found) of what is wrong with a manifest: ``rows of`` a part that differ in number, and ``repeated keys``; no rows if all is right.

    A part that is there but not expected should have none. Counts are aggregated
    before anything is compared, so nothing but a row for each part meets the list.
    """
    spark = rows.sparkSession
    want = spark.createDataFrame([(f"rows of {n}", k) for n, k in expected.items()] + [("repeated keys", 0)], "check string, expected long")
    counts = rows.groupBy(F.concat(F.lit("rows of "), "source_partition").alias("check")).agg(F.count("*").alias("found"))
    repeats = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").groupBy(F.lit("repeated keys").alias("check")).agg(F.count("*").alias("found"))
    full = want.join(counts.unionByName(repeats), "check", "full_outer")
    return full.select("check", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("expected", "found"))).where("expected <> found")


def merged_candidates(candidates: DataFrame, matched: DataFrame, gaps: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """A candidate for each repository: apps with a match of a code that is still wanted, in repositories that aren't there yet.

    candidates (app_id, app_name, repository_url, categories, active), matched
    (app_id, code, score, evidence), gaps (code), existing (repository_url). The
    first app by its id gives name and address; apps, categories and evidence are
    sorted, each once; of a code's scores the highest counts. No categories are
    ``Uncategorized``; an app without an address is left out.
    """
    c = F.col
    rows = candidates.where("coalesce(repository_url, '') <> ''").withColumn("repository", repository_url(c("repository_url")))
    if existing is not None:
        rows = rows.join(existing.select(repository_url(c("repository_url")).alias("repository")).distinct(), "repository", "left_anti")
    hits = matched.join(gaps.select("code").distinct(), "code", "left_semi")
    mine = rows.join(hits.select("app_id").distinct(), "app_id", "left_semi")
    each = lambda lists: F.array_sort(F.array_distinct(F.flatten(F.collect_set(lists))))
    kinds = F.when(F.size("categories") > 0, c("categories")).otherwise(F.array(F.lit("Uncategorized")))
    apps = mine.groupBy("repository").agg(F.min_by(F.struct("app_id", "app_name", "repository_url"), "app_id").alias("_lead"), F.array_sort(F.collect_set("app_id")).alias("app_ids"), each(kinds).alias("categories"), F.coalesce(F.bool_or("active"), F.lit(False)).alias("active"))
    codes = mine.select("repository", "app_id").distinct().join(hits, "app_id").groupBy("repository", "code").agg(F.max("score").alias("score"), each("evidence").alias("evidence"))
    targets = codes.groupBy("repository").agg(F.array_sort(F.collect_list(F.struct("code", "score", "evidence"))).alias("targets"))
    return apps.join(targets, "repository").select("repository", "_lead.*", "app_ids", "categories", "active", "targets")
