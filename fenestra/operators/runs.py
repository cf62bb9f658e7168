"""Run states: nested rounds and attempts as rows, reasons of failure, resumption, rollups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CALL = T.StructType([T.StructField(n, t) for n, t in (("status", T.StringType()), ("provider", T.StringType()), ("requested_model", T.StringType()), ("provider_attempts", T.IntegerType()), ("http_status", T.IntegerType()), ("duration_ms", T.DoubleType()))] + [T.StructField("usage", T.StructType([T.StructField(n, T.LongType()) for n in ("input_tokens", "output_tokens", "total_tokens")]))])
ATTEMPT = T.StructType([T.StructField("status", T.StringType()), T.StructField("error", T.StringType()), T.StructField("model_call", CALL)])
ROUND = T.StructType([T.StructField("round", T.IntegerType()), T.StructField("before_errors", T.IntegerType()), T.StructField("after_errors", T.IntegerType()), T.StructField("attempts", T.ArrayType(ATTEMPT))])
STATE = T.StructType([T.StructField(n, T.StringType()) for n in ("task_id", "model", "group", "status", "stop_reason", "started_at", "completed_at")] + [T.StructField("initial_errors", T.IntegerType()), T.StructField("final_errors", T.IntegerType()), T.StructField("rounds", T.ArrayType(ROUND))])


def attempts(states: DataFrame, keys: Sequence[str] = ("task_id", "model", "group")) -> DataFrame:
    """A row for each attempt; runs without one keep a row of nulls."""
    by_round = states.select(*keys, F.explode_outer("rounds").alias("r"))
    return by_round.select(*keys, F.col("r.round").alias("round"), F.posexplode_outer("r.attempts").alias("attempt", "a")).select(*keys, "round", "attempt", F.col("a.status").alias("status"), F.col("a.error").alias("error"), *(F.col(f"a.model_call.{n}").alias(n) for n in CALL.names if n != "status"))


def failure_reason(status: str = "status", stop: str = "stop_reason") -> Column:
    """Why a run has to be run again: it never ended, or ended for a fault of the infrastructure; null if it is done."""
    s, r = F.lower(F.coalesce(F.col(status), F.lit(""))), F.lower(F.coalesce(F.col(stop), F.lit("")))
    return F.when(s == "", "no_state").when(s.isin("running", "pending"), "unfinished").when(s.isin("provider_error", "infrastructure_failed") | r.rlike("timeout|network|rate.?limit|http_5"), "infrastructure")


def to_run(tasks: DataFrame, states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tasks without a finished state."""
    done = states.where(failure_reason().isNull()).select(*keys)
    return tasks.join(done, list(keys), "left_anti")


def result_rows(states: DataFrame, keys: Sequence[str] = ("task_id", "model", "group")) -> DataFrame:
    """One flat row for each run: errors before and after, repaired, rate (null without errors before), calls, retries and tokens (null if no call tells)."""
    calls = attempts(states, keys)
    sums = calls.groupBy(*keys).agg(F.count("attempt").alias("attempts"), F.count_if(F.col("status") == "rejected").alias("rejected"), F.sum(F.greatest(F.col("provider_attempts") - 1, F.lit(0))).alias("retries"), F.sum("usage.total_tokens").alias("total_tokens"), F.sum("duration_ms").alias("duration_ms"))
    base = states.select(*keys, "status", "initial_errors", "final_errors", F.size(F.coalesce("rounds", F.array().cast(ROUND_ARRAY))).alias("rounds"), failure_reason().alias("failure"))
    repaired = F.greatest(F.col("initial_errors") - F.col("final_errors"), F.lit(0))
    return base.join(sums, list(keys), "left").withColumns({"repaired": repaired, "rate": F.try_divide((F.col("initial_errors") - F.col("final_errors")).cast("double"), F.col("initial_errors").cast("double"))})


ROUND_ARRAY = T.ArrayType(ROUND)


def summary(results: DataFrame, by: Sequence[str]) -> DataFrame:
    return results.groupBy(*by).agg(
        F.count("*").alias("runs"), F.count_if(F.col("failure").isNull()).alias("completed"), F.count_if(F.col("failure") == "infrastructure").alias("infrastructure_failed"),
        F.sum("initial_errors").alias("before"), F.sum("final_errors").alias("after"), F.avg("rate").alias("mean_rate"), F.sum("total_tokens").alias("total_tokens"), F.count_if(F.col("final_errors") == 0).alias("without_errors"),
    )


def wide(results: DataFrame, key: str, condition: str, conditions: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row for each key with a column for each condition and value."""
    return results.groupBy(key).pivot(condition, list(conditions)).agg(*(F.first(v).alias(v) for v in values))


def stuck(results: DataFrame, key: str, after: str, conditions: int) -> DataFrame:
    """Keys whose remaining errors are equal, and not zero, under all conditions."""
    return results.groupBy(key).agg(F.count("*").alias("n"), F.min(after).alias("low"), F.max(after).alias("high")).where((F.col("n") == conditions) & (F.col("low") == F.col("high")) & (F.col("low") > 0)).select(key, F.col("low").alias(after))
