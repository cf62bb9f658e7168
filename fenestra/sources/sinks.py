"""Writers: fixed columns, checksums, staged replacement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenestra.operators.sets import snapshot_difference


def csv(df: DataFrame, path: str, columns: Sequence[str], strict: bool = False, mode: str = "error") -> None:
    """The columns in order, with a header even if there are no rows. Other columns are left out, or refused if strict."""
    if strict and set(df.columns) - set(columns):
        raise ValueError(f"columns that are not asked for: {sorted(set(df.columns) - set(columns))}")
    df.select(*columns).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def jsonl(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """(path, digest, size) of all files below a folder, paths from it on."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    base = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    own = F.substring_index(base, folder.rstrip("/").split("://")[-1].rstrip("/") + "/", -1)
    return found.select(own.alias("path"), F.sha2("content", 256).alias("digest"), F.col("length").alias("size"))


def changed_since(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(path, change) of a folder against its manifest; empty if the freeze is intact."""
    return snapshot_difference(manifest, checksums(spark, folder))


def staged(df: DataFrame, path: str) -> None:
    """df written beside its place, then moved there, so that readers see all of it or what was there before."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}.building")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at(path)):
        fs.rename(at(path), at(f"{path}.old"))
    fs.rename(at(f"{path}.building"), at(path))
    fs.delete(at(f"{path}.old"), True)
