"""Source lines around the names that a finding mentions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lines before and after; fixed values: base scores of code, values and other resources, and patterns of names.
RADIUS, CODE, VALUES, OTHER = 4, 4, 3, 2
ID, RESOURCE = r"@\+?id/([A-Za-z0-9_.]+)", r"@(?:string|dimen|color|drawable|style)/([A-Za-z0-9_.]+)"


def evidence_terms(issues: DataFrame, issue: str) -> DataFrame:
    """(issue, term): names of ids and resources in component, element, selector and attributes, each once."""
    texts = F.concat(F.array("component", "element", "selector"), F.map_values("attributes"))
    names = F.flatten(F.transform(F.filter(texts, lambda t: t.isNotNull()), lambda t: F.concat(F.regexp_extract_all(t, F.lit(ID), F.lit(1)), F.regexp_extract_all(t, F.lit(RESOURCE), F.lit(1)))))
    return issues.select(issue, F.explode(F.array_distinct(names)).alias("term"))


def app_context(issues: DataFrame, files: DataFrame, issue: str, root: str, limit: int = 8) -> DataFrame:
    """The best excerpts of each issue (issue, root, ...) from the files of its app (root, path, text).

    Lines meet terms on the identifiers they contain, so no issue sees all
    lines; a line's score is that of its kind of file and its distinct terms.
    """
    terms = evidence_terms(issues, issue).join(issues.select(issue, root), issue)
    lines = files.select(root, "path", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    words = lines.select(root, "path", "n", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"[A-Za-z0-9_.]+"), F.lit(0)))).alias("term"))
    hits = words.join(terms, [root, "term"]).groupBy(issue, root, "path", "n").agg(F.array_sort(F.collect_set("term")).alias("matched"))
    kind = F.when(F.col("path").rlike(r"\.(kt|java)$"), "controller_code").when(F.contains(F.concat(F.lit("/"), F.col("path")), F.lit("/values")), "resource_value").otherwise("xml_context")
    base = F.when(kind == "controller_code", CODE).when(kind == "resource_value", VALUES).otherwise(OTHER)
    ranked = hits.withColumns({"kind": kind, "score": base + F.size("matched"), "first": F.greatest(F.col("n") - RADIUS, F.lit(0))})
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(issue).orderBy(F.desc("score"), "path", "first", "n"))).where(F.col("rank") <= limit)
    span = F.slice(F.split("text", "\n"), F.col("first") + 1, F.col("n") - F.col("first") + RADIUS + 1)
    return ranked.join(files, [root, "path"]).select(issue, "rank", "path", "kind", (F.col("first") + 1).alias("line_start"), (F.col("first") + F.size(span)).alias("line_end"), "score", "matched", F.trim(F.array_join(span, "\n")).alias("excerpt"))


def merged_context(contexts: DataFrame, issues: DataFrame, issue: str, limit: int = 12, by: Sequence[str] = ()) -> DataFrame:
    """Excerpts of many issues (issue, position) as one list, each span once, in the order of issues."""
    rows = contexts.join(issues.select(issue, *by, "position"), issue)
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "path", "line_start", "line_end").orderBy("position", "rank"))).where("_n = 1").drop("_n")
    if not by:  # a window over one list only after it has been cut to the limit
        first = first.orderBy("position", "rank", "path", "line_start", "line_end").limit(limit)
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("position", "rank", "path", "line_start", "line_end"))).where(F.col("place") <= limit)
