"""Aggregations: level reports, rates, null rules, nested counts, distributions, checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fenestra.functions.measures import reduction
from fenestra.functions.text import truth

#: Fixed value: the levels of a finding; other texts count as the first.
LEVELS = ("error", "warning", "info")


def severity(level: Column, legacy: Column | None = None) -> Column:
    given = F.coalesce(level, legacy) if legacy is not None else level
    return F.when(given.isin(*LEVELS), given).otherwise(LEVELS[0])


def actionable(severity_: Column, repairability: Column) -> Column:
    """The gate of automatic repair; findings that don't say are taken for safe."""
    return (severity_ == "error") & (F.coalesce(repairability, F.lit("xml_safe")) == "xml_safe")


def level_report(findings: DataFrame, level: Column, by: Sequence[str] = (), levels: Sequence[str] = LEVELS) -> DataFrame:
    """A count for each level, and in all. issue_count means the first level only."""
    counts = [F.count_if(level == x).alias(f"{x}_count") for x in levels]
    return findings.groupBy(*by).agg(F.count_if(level == levels[0]).alias("issue_count"), *counts, F.count("*").alias("total_issue_count"))


def code_counts(findings: DataFrame, by: Sequence[str], code: str) -> DataFrame:
    """A map of counts by code for each group, keys in order."""
    per = findings.groupBy(*by, code).agg(F.count("*").alias("n"))
    return per.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(code, "n")))).alias("codes"), F.sum("n").alias("total"))


def sum_or_null(value: Column) -> Column:
    """Null if any value is null."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))


def condition_summary(rows: DataFrame, by: Sequence[str], before: str, after: str) -> DataFrame:
    """Totals, the rate of reduction (null without anything before), means and medians of a condition."""
    b, a = F.sum(before), F.sum(after)
    return rows.groupBy(*by).agg(
        F.count("*").alias("tasks"), b.alias("before_total"), a.alias("after_total"), reduction(b, a).alias("rate"),
        F.avg(after).alias("mean_after"), F.median(after).alias("median_after"), F.count_if(F.col(after) == 0).alias("zero_after"),
    )


def stability(rows: DataFrame, subject: str, repetition: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Over repetitions: mean, spread and range of the totals, mean spread within subjects, and subjects that never change."""
    per = rows.groupBy(*by, subject, repetition).agg(F.sum(value).alias("v"))
    within = per.groupBy(*by, subject).agg(F.stddev_samp("v").alias("sd"), (F.min("v") == F.max("v")).alias("same"), F.count("*").alias("n"))
    inner = within.groupBy(*by).agg(F.avg("sd").alias("mean_within_sd"), F.count_if("same").alias("unchanged"), F.count("*").alias("subjects"))
    totals = per.groupBy(*by, repetition).agg(F.sum("v").alias("t"))
    outer = totals.groupBy(*by).agg(F.count("*").alias("repetitions"), F.avg("t").alias("mean_total"), F.stddev_samp("t").alias("sd_total"), F.min("t").alias("min_total"), F.max("t").alias("max_total"))
    if by:
        return outer.join(inner, list(by))
    return outer.withColumn("_one", F.lit(1)).join(inner.withColumn("_one", F.lit(1)), "_one").drop("_one")  # a row each


def with_targets(counts: DataFrame, targets: DataFrame, key: str, n: str, target: str) -> DataFrame:
    """Counts against a list of targets, groups without rows included: gap, ratio, and whether the target is met."""
    full = targets.join(counts, key, "left").withColumn(n, F.coalesce(n, F.lit(0)))
    status = F.when(F.col(n) == F.col(target), "met").when(F.col(n) < F.col(target), "below").otherwise("above")
    return full.withColumn("gap", F.greatest(F.col(target) - F.col(n), F.lit(0))).withColumn("ratio", F.try_divide(F.col(n).cast("double"), F.col(target).cast("double"))).withColumn("status", status)


def top_list(rows: DataFrame, by: Sequence[str], item: str, k: int, out: str = "top") -> DataFrame:
    """The k commonest items of each group as text, ties by name."""
    from pyspark.sql import Window

    per = rows.groupBy(*by, item).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), item))
    best = per.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", item, "n"))), lambda x: F.concat(x[item], F.lit(":"), x["n"].cast("string"))), ";").alias(out))


def checks(summary: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """(check, passed) of a one-row summary; a check that can't be told fails."""
    pairs = F.array(*(F.struct(F.lit(k).alias("check"), F.coalesce(c, F.lit(False)).alias("passed")) for k, c in conditions.items()))
    return summary.select(F.explode(pairs).alias("c")).select("c.check", "c.passed")


def call_summary(calls: DataFrame, by: Sequence[str]) -> DataFrame:
    """Model calls (model, attempts, input_tokens, output_tokens, duration_ms): sums stay null if all values are null."""
    return calls.groupBy(*by).agg(
        F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("duration_ms").alias("duration_ms"),
        F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))).alias("retries"), F.array_sort(F.collect_set("model")).alias("models"),
    )


def nested_attempts(rounds: str = "rounds", status: str | None = None) -> Column:
    """Number of attempts in rounds[].attempts[], of one status if it is given."""
    attempts = F.flatten(F.transform(F.coalesce(F.col(rounds), F.array()), lambda r: r["attempts"]))
    return F.size(F.filter(attempts, lambda a: a["status"] == status) if status else attempts)


def boundary_summary(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Of findings that no edit can mend (model_calls, decision, refused as text): how many there are, were stopped before a call, and were rightly refused."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("candidates"), F.sum(F.coalesce(F.col("model_calls").cast("long"), F.lit(0))).alias("model_calls"),
        F.count_if(F.col("decision") == "blocked_before_model").alias("blocked"), F.count_if(truth(F.col("refused"))).alias("refusals"),
    )


def contribution(gain: Column, low: Column, high: Column, safe: Column) -> Column:
    """What a difference in repair rates says with its interval: a contribution if both are above zero and nothing became less safe, harm if both are below; null bounds or gains say nothing."""
    # The names of the three outcomes.
    good, bad, none = "limited_measurable_rag_contribution", "rag_negative_repair_effect", "no_measurable_rag_contribution"
    return F.when((gain > 0) & (low > 0) & safe, good).when((gain < 0) & (high < 0), bad).otherwise(none)
