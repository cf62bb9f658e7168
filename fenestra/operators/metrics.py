"""Ranking metrics with graded or binary relevance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fenestra.operators.retrieval import jaccard


def ranked_metrics(ranking: DataFrame, labels: DataFrame, query: str, item: str, ks: Sequence[int] = (1, 3, 5), relevant: int = 1) -> DataFrame:
    """Per query: precision, recall and nDCG at each k (gain 2^grade - 1), and the reciprocal rank.

    ranking: (query, item, rank from 1); labels: (query, item, grade). The ideal
    order is of all labels of the query; precision divides by k even where fewer
    items were returned. Queries with labels but no results count as zero.
    """
    gain, discount = F.pow(F.lit(2.0), F.col("grade")) - 1, F.log2(F.col("rank") + 1.0)
    graded = ranking.select(query, item, "rank").join(labels.select(query, item, "grade"), [query, item], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    ideal = labels.select(query, "grade", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("grade"), item)).alias("rank"))
    hit = F.col("grade") >= relevant
    got = graded.groupBy(query).agg(*(F.count_if(hit & (F.col("rank") <= k)).alias(f"hits_{k}") for k in ks), *(F.sum(F.when(F.col("rank") <= k, gain / discount).otherwise(0.0)).alias(f"dcg_{k}") for k in ks), F.min(F.when(hit, F.col("rank"))).alias("first"))
    best = ideal.groupBy(query).agg(F.count_if(hit).alias("relevant"), *(F.sum(F.when(F.col("rank") <= k, gain / discount).otherwise(0.0)).alias(f"ideal_{k}") for k in ks))
    both = best.join(got, query, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    columns = []
    for k in ks:
        columns += [
            zero(F.col(f"hits_{k}") / float(k)).alias(f"precision_{k}"),
            zero(F.try_divide(F.col(f"hits_{k}").cast("double"), F.col("relevant").cast("double"))).alias(f"recall_{k}"),
            zero(F.try_divide(F.col(f"dcg_{k}"), F.col(f"ideal_{k}"))).alias(f"ndcg_{k}"),
        ]
    return both.select(query, *columns, zero(1.0 / F.col("first")).alias("reciprocal_rank"))


def macro(metrics: DataFrame, query: str, strata: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """Means of per-query metrics, in all or by a stratum of the queries."""
    names = [c for c in metrics.columns if c != query]
    rows = metrics.join(strata.select(query, by), query) if strata is not None else metrics
    return rows.groupBy(*([by] if by else [])).agg(F.count("*").alias("queries"), *(F.avg(c).alias(c) for c in names))


def gates(summary: DataFrame, minimums: dict[str, float], maximums: dict[str, float] | None = None) -> DataFrame:
    """A flag for each threshold, and whether all hold."""
    flags = {f"{c}_ok": F.coalesce(F.col(c) >= v, F.lit(False)) for c, v in minimums.items()} | {f"{c}_ok": F.coalesce(F.col(c) <= v, F.lit(False)) for c, v in (maximums or {}).items()}
    out = summary.withColumns(flags)
    passed = F.lit(True)
    for f in flags:
        passed = passed & F.col(f)
    return out.withColumn("passed", passed)


def new_at_k(results: DataFrame, task: str, k: str, documents: str) -> DataFrame:
    """(task, k, rank from 1, doc_id, is_new): lists of documents by their length limit k as rows, and whether a document is in none of the task's shorter lists."""
    rows = results.select(task, k, F.posexplode(documents).alias("_pos", "doc_id"))
    first = F.min(k).over(Window.partitionBy(task, "doc_id"))
    return rows.select(task, k, (F.col("_pos") + 1).alias("rank"), "doc_id", (F.col(k) == first).alias("is_new"))


def alike_in_lists(rows: DataFrame, task: str, k: str, tokens: str, limit: float) -> DataFrame:
    """(task, k, first, second, similarity): pairs of documents of one list, of k at most, whose token sets are alike by a Jaccard similarity at or above the limit."""
    a, b = rows.select(task, k, F.col("rank").alias("_ra"), F.col("doc_id").alias("first"), F.col(tokens).alias("_a")), rows.select(task, k, F.col("rank").alias("_rb"), F.col("doc_id").alias("second"), F.col(tokens).alias("_b"))
    pairs = a.join(b, [task, k]).where(F.col("_ra") < F.col("_rb")).withColumn("similarity", jaccard(F.col("_a"), F.col("_b")))
    return pairs.where(F.col("similarity") >= limit).select(task, k, "first", "second", "similarity")


def best_configuration(summaries: DataFrame, name: str, better: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """(by, name): the configuration that comes first by the columns in their order, smaller first (negate what should be large), then by name."""
    return summaries.groupBy(*by).agg(F.min_by(name, F.struct(*better, F.col(name))).alias(name))
