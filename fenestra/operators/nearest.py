"""Exact nearest vectors over all rows, in blocks, with blocks left out that can't hold one.

Rows are dealt to the nearest of a bounded number of pivots; a block keeps how far
(as an angle) its members are from the pivot. By the triangle inequality on the
sphere no member of a block is nearer to a query than the query's angle to the
pivot less that radius. A query first meets the block of its best bound; the k-th
best similarity there is what others have to beat, so in a second step it meets
only blocks whose bound reaches it. Nothing is approximate: the pivots steer cost
only. Large blocks are dealt into parts, of items and of queries, so a task holds
two parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fenestra.checkpoints import cut

#: Pivots, at most; rows of a part of a block; decimals by which similarities are compared (sums in another order differ beyond).
PIVOTS, PART, DECIMALS = 256, 4096, 9
#: Allowance for rounding in bounds.
SLACK = 1e-7


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = np.asarray(rows, np.float64)
    length = np.sqrt((rows * rows).sum(1, keepdims=True))
    return rows / np.where(length > 0, length, 1)


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    flat = (vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors).flatten().to_numpy(zero_copy_only=False)
    return _unit(flat.reshape(-1, width))


def pivots(items: DataFrame, vector: str, most: int = PIVOTS) -> np.ndarray:
    """Up to ``most`` vectors in the order of a hash, different ones, as unit vectors: about the square root of the rows."""
    n = items.count()
    want = int(min(most, max(1, n**0.5)))
    rows = [r[0] for r in items.select(vector).distinct().orderBy(F.xxhash64(vector), vector).limit(want).collect()]
    return _unit(np.array(rows)) if rows else np.zeros((0, 1))


def dense_top(queries: DataFrame, items: DataFrame, query: str, item: str, vector: str, k: int, most: int = PIVOTS, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """((query, item, score, rank), (query, met, every)): the k items of highest cosine of all items, a row's own id left out, ties by item; and how many items each query was compared with.

    Vectors are of one length, without nulls; a vector of zeros has cosine 0 with
    all. Ids are unique among queries and among items.
    """
    items = items.select(F.col(item).alias("_item"), F.col(vector).alias("_v"))
    queries = queries.select(F.col(query).alias("_query"), F.col(vector).alias("_v"))
    centre = pivots(items, "_v", most)
    width = centre.shape[1]
    ids = {"q": dict(queries.dtypes)["_query"], "i": dict(items.dtypes)["_item"]}
    if not len(centre):
        none = queries.limit(0).select(F.col("_query").alias(query), F.lit(None).cast(ids["i"]).alias(item), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
        return none, queries.select(F.col("_query").alias(query), F.lit(0).cast("long").alias("met"), F.lit(0).cast("long").alias("every"))

    @F.arrow_udf(T.StructType([T.StructField("block", T.IntegerType()), T.StructField("angle", T.DoubleType())]))
    def dealt(vectors: pa.Array) -> pa.Array:
        near = _matrix(vectors, width) @ centre.T
        block = near.argmax(1)
        angle = np.arccos(np.clip(near[np.arange(len(near)), block], -1, 1))
        return pa.StructArray.from_arrays([pa.array(block, pa.int32()), pa.array(angle, pa.float64())], ["block", "angle"])

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def angles(vectors: pa.Array) -> pa.Array:
        out = np.arccos(np.clip(_matrix(vectors, width) @ centre.T, -1, 1))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel(), pa.float64()))

    placed = cut(items.withColumn("_d", dealt("_v")).select("_item", "_v", "_d.block", "_d.angle"))
    # As many rows as there are pivots.
    blocks = cut(placed.groupBy("block").agg(F.max("angle").alias("radius"), F.count("*").alias("n"), F.ceil(F.count("*") / part).cast("int").alias("parts")))
    near = queries.withColumn("_a", angles("_v")).select("_query", "_v", F.posexplode("_a").alias("block", "away")).join(F.broadcast(blocks), "block")
    bound = F.cos(F.greatest(F.col("away") - F.col("radius"), F.lit(0.0))) + SLACK
    near = cut(near.select("_query", "block", bound.alias("bound"), "n"))
    asked = cut(queries)

    def met(pairs: DataFrame) -> DataFrame:
        """(query, item, score): the k best of each block that a query meets. pairs: (_query, block)."""
        load = pairs.groupBy("block").agg(F.ceil(F.count("*") / part).cast("int").alias("shares"))
        sizes = F.broadcast(blocks.join(load, "block").select("block", "parts", "shares"))
        q = pairs.join(asked, "_query").join(sizes, "block").withColumn("s", F.pmod(F.xxhash64("_query"), F.col("shares")).cast("int"))
        q = q.select("_query", "_v", "block", "s", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"))
        i = placed.join(sizes, "block").withColumn("p", F.pmod(F.xxhash64("_item"), F.col("parts")).cast("int"))
        i = i.select("_item", "_v", "block", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("s"), "p")

        def best(left: pa.Table, right: pa.Table) -> pa.Table:
            a, b = left["_query"].to_pylist(), right["_item"].to_pylist()
            out: list[tuple] = []
            if a and b:
                order = np.argsort(np.array(b), kind="stable")
                own = np.array(b)[order]
                values = np.round(_matrix(left["_v"], width) @ _matrix(right["_v"], width)[order].T, DECIMALS)
                for x, row in zip(a, values):
                    row = np.where(own == x, -np.inf, row)
                    top = np.argsort(-row, kind="stable")[:k]  # ties stay in the order of items
                    out += [(x, own[j].item(), float(row[j])) for j in top if row[j] > -np.inf]
            columns = list(zip(*out)) or [(), (), ()]
            return pa.table({"_query": pa.array(columns[0], left.schema.field("_query").type), "_item": pa.array(columns[1], right.schema.field("_item").type), "score": pa.array(columns[2], pa.float64())})

        return q.groupBy("block", "s", "p").cogroup(i.groupBy("block", "s", "p")).applyInArrow(best, f"_query {ids['q']}, _item {ids['i']}, score double")

    by_bound = Window.partitionBy("_query").orderBy(F.col("bound").desc(), "block")
    first = cut(near.withColumn("_n", F.row_number().over(by_bound)).where("_n = 1").drop("_n"))
    found = cut(met(first.select("_query", "block")))
    ranked = Window.partitionBy("_query").orderBy(F.col("score").desc(), "_item")
    least = found.withColumn("_n", F.row_number().over(ranked)).where(F.col("_n") == k).select("_query", F.col("score").alias("least"))
    rest = cut(near.join(first.select("_query", "block"), ["_query", "block"], "left_anti").join(least, "_query", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least"))))
    every = found.unionByName(met(rest.select("_query", "block")))
    top = every.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    compared = first.select("_query", "n").unionByName(rest.select("_query", "n")).groupBy("_query").agg(F.sum("n").alias("met"))
    total = blocks.agg(F.sum("n")).first()[0]
    return top.select(F.col("_query").alias(query), F.col("_item").alias(item), "score", "rank"), compared.select(F.col("_query").alias(query), "met", F.lit(total).alias("every"))
