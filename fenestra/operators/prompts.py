"""Prompts as columns: rendering, and the audit that two of them differ in nothing but the knowledge they carry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<knowledge>", "</knowledge>"
BLOCK = r"(?s)<knowledge>.*?</knowledge>"


def issue_query(neutral: bool = False) -> Column:
    """What is asked of the knowledge base about a finding: the neutral form leaves out its message and prepared query."""
    parts = [F.lit("Android XML accessibility repair"), F.col("code"), F.coalesce(F.when(F.col("component") != "", F.col("component")), F.col("element"))]
    parts += [] if neutral else [F.col("message"), F.col("repair_query")]
    return F.concat_ws(" ", *(F.when(p != "", p) for p in parts))


def knowledge_block(results: DataFrame, documents: DataFrame, by: Sequence[str], place: str = "place") -> DataFrame:
    """(by, knowledge): titles and summaries of a group's documents, in their places."""
    titled = documents.select("doc_id", F.concat_ws("\n", F.concat(F.lit("## "), F.coalesce(F.col("source.title_en"), F.col("doc_id"))), F.col("content.summary_en")).alias("_text"))
    rows = results.join(titled, "doc_id").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(place, "_text"))).alias("t"))
    return rows.select(*by, F.concat(F.lit(OPEN + "\n"), F.array_join(F.transform("t", lambda x: x["_text"]), "\n\n"), F.lit("\n" + CLOSE)).alias("knowledge"))


def rendered(task: Column, files: Column, findings: Column, knowledge: Column | None = None) -> Column:
    """A prompt; without knowledge its block is there and empty."""
    block = F.coalesce(knowledge, F.lit(OPEN + "\n" + CLOSE)) if knowledge is not None else F.lit(OPEN + "\n" + CLOSE)
    return F.concat_ws("\n\n", task, F.lit("# Files"), files, F.lit("# Findings"), findings, block)


def skeleton(prompt: Column) -> Column:
    return F.regexp_replace(prompt, BLOCK, OPEN + CLOSE)


def audited(pairs: DataFrame, plain: str, guided: str) -> DataFrame:
    """pairs with isolated: the prompts are the same but for the block, which only the guided one fills; and the lengths that are injected."""
    same = skeleton(F.col(plain)) == skeleton(F.col(guided))
    inside = lambda c: F.length(F.regexp_extract(c, BLOCK, 0)) - len(OPEN) - len(CLOSE)
    return pairs.withColumns({"isolated": F.coalesce(same & (inside(plain) <= 1), F.lit(False)), "injected_chars": F.greatest(inside(guided), F.lit(0))})


def document_share(results: DataFrame, app: str, threshold: float = 0.75) -> DataFrame:
    """(doc_id, apps, share, common): in how many apps each document is used, and whether in most."""
    apps = results.select(app).distinct().count()
    share = F.col("apps") / F.lit(apps)
    return results.select(app, "doc_id").distinct().groupBy("doc_id").agg(F.count("*").alias("apps")).select("doc_id", "apps", share.alias("share"), (share >= threshold).alias("common"))
