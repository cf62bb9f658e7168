"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only where none is set and all runs on one machine, as in tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fenestra-ckpt-"))
    return spark.sparkContext.getCheckpointDir()


#: Whether Spark deletes shuffle files once the query that wrote them has ended, not when the driver happens to collect its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def freed(spark: SparkSession) -> None:
    """What shuffles wrote goes with the end of each query; what is used again is in checkpoints."""
    spark.conf.set(FREED, "true")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared checkpoint folder; a lost executor loses none of it."""
    checkpoint_dir(df.sparkSession)
    freed(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df, written as a table in the shared folder and read back, for the state of a loop.

    A checkpoint keeps the size that its plan was estimated at. Joins multiply
    estimates, so in a loop they get thousands of digits and planning stalls;
    a table is as large as its files.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/state-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def grown(parts: list[DataFrame], most: int = 8) -> DataFrame:
    """The rows of all parts, written tables of a loop; beyond ``most`` of them they become one, in place, so that neither each round writes all rows nor plans grow with rounds."""
    if len(parts) > most:
        parts[:] = [written(reduce(DataFrame.unionByName, parts))]
    return reduce(DataFrame.unionByName, parts)


def apart(df: DataFrame) -> DataFrame:
    """df as a side of a join that is shuffled, whatever its estimated size.

    Estimates come from the bytes of compressed files. What is made of their rows
    (texts, parsed trees) may be a hundred times that, and would be broadcast
    through the driver.
    """
    return df.hint("merge")
