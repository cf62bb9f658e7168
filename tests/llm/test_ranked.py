"""Ranked search: compressed lists, several shards and blocks, ties, odd rows."""

import random

import duckdb
import numpy as np
import pytest

from fenestra.llm import ranked


def test_compressed_numbers():
    rng = random.Random(1)
    for n in (0, 1, 5, 1000):
        values = np.array([rng.randrange(1 << rng.randrange(1, 63)) for _ in range(n)], np.int64)
        data, ends = ranked.packed(values)
        assert ranked.unpacked(data.tobytes()).tolist() == values.tolist()
        if n:
            assert ranked.unpacked(data.tobytes()[: ends[n // 2]]).tolist() == values[: n // 2 + 1].tolist()


def by_sql(documents, items):
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar)")
    con.sql("create table benchmark (item_id bigint, text varchar)")
    for name, rows in (("documents", documents), ("benchmark", items)):
        con.executemany(f"insert into {name} values (?, ?)", [list(r) for r in rows])
    found = con.sql(ranked.OP11_SQL)
    at = [found.columns.index(c) for c in ("item_id", "rank", "doc_id", "score")]
    return sorted(map(repr, (tuple(r[i] for i in at) for r in found.fetchall())))


def by_spark(spark, documents, items, block=ranked.BLOCK, size=ranked.SHARD_BYTES, parts=5):
    docs = spark.createDataFrame(documents, "doc_id long, text string").repartition(parts)
    found = ranked.search(ranked.index(docs, size), spark.createDataFrame(items, "item_id long, text string"), block=block)
    return sorted(map(repr, map(tuple, found.collect())))


@pytest.mark.parametrize("block, size", [(256, 1 << 25), (3, 500), (1, 1)])
def test_shards_blocks_and_ties(spark, block, size):
    """Tiny shards and blocks give the same as one of each; most scores are shared by many documents, and some by all."""
    rng = random.Random(2)
    words = ["alpha", "Beta", "gämma", "x1", "字", "the", "rare"]
    documents = [(i * 7 % 400, " ".join(rng.choice(words[: rng.randint(1, 7)]) for _ in range(rng.randint(1, 9)))) for i in range(400)]
    documents += [(1000 + i, "Alpha alpha,BETA") for i in range(90)] + [(5, "rare"), (5, "rare"), (None, "rare rare"), (None, None), (6, ""), (7, "-- ..")]
    items = [(1, "alpha beta"), (2, "RARE"), (3, "the 字 x1 x1"), (4, "nowhere"), (5, None), (None, "gämma the"), (1, "x1"), (6, "")]
    want = by_sql(documents, items)
    assert len(want) > 150 and by_spark(spark, documents, items, block, size) == want


def test_odd_rows(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    assert by_spark(spark, docs, items) == by_sql(docs, items)


def test_nothing(spark):
    docs = [(1, "a b"), (2, "b c")]
    assert by_spark(spark, docs, []) == by_spark(spark, [], [(1, "a")]) == by_spark(spark, [(1, None)], [(1, "a")]) == []
