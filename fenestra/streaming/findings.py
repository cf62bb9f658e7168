"""Findings as a stream. An extension: the batch rules have no notion of time.

Files of findings arrive; each finding counts once within the watermark, and
levels are counted in windows of event time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fenestra.operators.reports import LEVELS, severity

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("found_at", T.TimestampType()), T.StructField("code", T.StringType()), T.StructField("severity", T.StringType()), T.StructField("file", T.StringType())])


def read(spark: SparkSession, folder: str, schema: T.StructType = SCHEMA, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(folder)


def once(findings: DataFrame, late: str = "10 minutes") -> DataFrame:
    return findings.withWatermark("found_at", late).dropDuplicatesWithinWatermark(["id"])


def level_counts(findings: DataFrame, window: str = "5 minutes") -> DataFrame:
    """(window, counts by level) of a watermarked stream, or of a table."""
    level = severity(F.col("severity"))
    return findings.groupBy(F.window("found_at", window)).agg(*(F.count_if(level == x).alias(f"{x}_count") for x in LEVELS), F.count("*").alias("total_issue_count"))
