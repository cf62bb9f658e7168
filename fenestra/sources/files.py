"""Readers of text files: CSV, JSON, XML resources, reports, metadata. Schemas are declared, never inferred."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Folders of builds, words of accessibility in lint reports.
EXCLUDED = r"/(build|\.git|\.gradle)/"
TEST_SOURCES = r"/(test|androidTest|sharedTest)/"
LINT_WORDS = ("accessib", "contentdescription", "content description", "labelfor", "talkback", "touch target", "clickable", "focusable", "autofill", "hint", "contrast")


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def csv(spark: SparkSession, path: str, *columns: str, strict: bool = False) -> DataFrame:
    """All cells as text, empty ones as null. A missing file is an empty table, or an error if strict, as are broken rows."""
    try:
        return spark.read.schema(strings(*columns)).option("header", True).option("mode", "FAILFAST" if strict else "PERMISSIVE").option("enforceSchema", False).option("multiLine", True).option("escape", '"').csv(path)
    except AnalysisException as e:
        if strict or "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], strings(*columns))


def json_list(spark: SparkSession, path: str, name: str, item: T.StructType) -> DataFrame:
    """Rows of files that hold a list, or an object with the list under a name; other files have none."""
    text = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", T.ArrayType(item), {"mode": "PERMISSIVE"})
    under = F.from_json("value", T.StructType([T.StructField(name, T.ArrayType(item))]), {"mode": "PERMISSIVE"})[name]
    rows = F.when(F.ltrim("value").startswith("["), listed).otherwise(under)
    return text.select(F.input_file_name().alias("file"), F.explode(rows).alias("r")).select("file", "r.*")


def states(spark: SparkSession, glob: str) -> DataFrame:
    """Run states, one JSON object a file; unreadable files are skipped."""
    from fenestra.operators.runs import STATE

    return spark.read.schema(STATE).option("multiLine", True).option("ignoreCorruptFiles", True).option("mode", "DROPMALFORMED").json(glob)


def files(spark: SparkSession, folder: str, glob: str = "*.xml") -> DataFrame:
    """(path, text) of all files below a folder."""
    return spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def is_layout(path: Column, tests: bool = False) -> Column:
    own = path.rlike(r"/layout[^/]*/[^/]+\.xml$") & ~path.rlike(EXCLUDED)
    return own if tests else own & ~path.rlike(TEST_SOURCES)


def is_values(path: Column) -> Column:
    return path.rlike(r"/values[^/]*/[^/]+\.xml$") & ~path.rlike(EXCLUDED)


def resource_root(path: Column) -> Column:
    """The res folder above a file."""
    root = F.regexp_extract(path, r"^(.*?/res)/", 1)
    return F.when(root != "", root)


def layouts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(layouts, values) of a source tree as rules read them: (doc, root, path, xml) and (root, path, xml)."""
    found = files(spark, folder).withColumn("root", F.coalesce(resource_root(F.col("path")), F.lit("")))
    return found.where(is_layout(F.col("path"))).select(F.col("path").alias("doc"), "root", "path", F.col("text").alias("xml")), found.where(is_values(F.col("path"))).select("root", "path", F.col("text").alias("xml"))


def lint_issues(reports: DataFrame, include_all: bool = False) -> DataFrame:
    """Issues of lint reports (path, text): type, code, message, first location; those about accessibility only, unless all are asked for."""
    from fenestra.operators.tree import parse

    nodes = parse(reports.select(F.col("path").alias("report"), "text"), "report", "text")
    a = lambda n: F.coalesce(F.col("attrs")[n], F.lit(""))
    issues = nodes.where("local_tag = 'issue' and depth = 1").select("report", "node", *(a(n).alias(n) for n in ("id", "severity", "category", "message", "summary", "explanation")))
    places = nodes.where("local_tag = 'location'").groupBy(F.col("report").alias("_p"), F.col("parent").alias("_n")).agg(F.min_by("attrs", "node").alias("place"), F.count("*").alias("locations"))
    about = F.lower(F.concat_ws(" ", "id", "category", "message", "summary", "explanation")).rlike("|".join(LINT_WORDS))
    kept = issues if include_all else issues.where(about)
    s = F.lower("severity")
    full = kept.join(places, (F.col("report") == F.col("_p")) & (F.col("node") == F.col("_n")), "left")
    return full.select(F.col("report").alias("path"), F.when(s.isin("fatal", "error"), "error").when(s == "warning", "warning").otherwise("notice").alias("type"), F.concat(F.lit("ANDROID_LINT_"), F.when(F.col("id") != "", F.col("id")).otherwise("UNKNOWN")).alias("code"), F.when(F.col("message") != "", F.col("message")).otherwise(F.col("summary")).alias("message"), F.coalesce(F.col("place")["file"], "report").alias("file"), F.col("place")["line"].alias("line"), F.coalesce("locations", F.lit(0)).alias("locations"))


def app_metadata(texts: DataFrame) -> DataFrame:
    """Rows of YAML app metadata (path, text): those with a git repository over http(s), not disabled; the enabled build with the highest code, else any. Needs a YAML library."""
    schema = "package_name string, app_name string, repository_url string, repo_type string, categories array<string>, version string, commit_hash string, subdir string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["text"]):
                try:
                    d = yaml.safe_load(text)
                except yaml.YAMLError:
                    continue
                if not isinstance(d, dict) or d.get("Disabled") or str(d.get("RepoType", "")).lower() != "git" or not str(d.get("Repo", "")).startswith(("http://", "https://")):
                    continue
                builds = [b for b in d.get("Builds") or [] if isinstance(b, dict)]
                on = [b for b in builds if not b.get("disable")] or builds
                build = max(on, key=lambda b: (int(b.get("versionCode") or 0), str(b.get("versionName") or "")), default={})
                name = str(path).rsplit("/", 1)[-1].rsplit(".", 1)[0]
                rows.append((name, str(d.get("AutoName") or d.get("Name") or name), d["Repo"], "git", sorted(map(str, d.get("Categories") or ["Uncategorized"])), str(build.get("versionName") or ""), str(build.get("commit") or ""), str(build.get("subdir") or "")))
            yield pd.DataFrame(rows, columns=["package_name", "app_name", "repository_url", "repo_type", "categories", "version", "commit_hash", "subdir"])

    return texts.select("path", "text").mapInPandas(run, schema)
