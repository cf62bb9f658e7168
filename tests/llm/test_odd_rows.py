"""Nulls, empty and very long texts, repeated rows, clashing columns and empty tables, for every operator and stage."""

import pytest

import corpus_pipeline
from fenestra.llm import queries
from fenestra.llm.common import cut


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_rows(spark, folder, name):
    got = queries.QUERIES[name](spark, folder).collect()
    if name in ("op11_ranked_search", "op13_phrases"):
        assert got  # values: test_ranked.py, test_phrases.py
    elif name != "op6_fixity":
        assert len(got) == 9
        assert sorted(str(r.doc_id) for r in got) == sorted(map(str, [0, 1, 2, 3, 4, 5, 5, None, 7]))
        alike = {str(r) for r in got if r.doc_id == 5}
        assert len(alike) == (2 if name == "op8_mixing" else 1)  # in a mix, rows that repeat stand one after another


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, nothing, name):
    assert queries.QUERIES[name](spark, nothing).collect() == []


def test_pipeline_of_odd_rows(spark, folder, nothing):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
            assert dict(out.dtypes) == dict(docs.dtypes), name
            docs = cut(out)
    assert out.count() > 0
    assert corpus_pipeline.run(spark, nothing).collect() == []
