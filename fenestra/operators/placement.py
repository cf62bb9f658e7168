"""Where things belong in trees of files: labels of fields, stored findings in changed files, includes that resolve, owners of shared findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fenestra.checkpoints import grown, written
from fenestra.functions.text import reference, view_type
from fenestra.operators import vocabulary as V
from fenestra.operators.rules import words
from fenestra.operators.tree import reachable

# How a label is related to its field, by the number of containers between; attributes that don't tell elements apart.
RELATIONS = ("nearby_visible_label_candidate", "adjacent_container_visible_label_candidate", "nested_container_visible_label_candidate")
PLAIN = ("layout_width", "layout_height", "id")


def _own(name: str) -> Column:
    return F.coalesce(F.col("attrs")[f"android:{name}"], F.lit(""))


def may_own_label() -> Column:
    """Whether a node is a visible text view with words that say something, and labels nothing yet."""
    said = F.when(_own("text") != "", words("text")).otherwise(F.coalesce(words("contentDescription"), F.lit("")))
    plain = F.lower(F.regexp_replace(F.trim(said), r"\s+", " "))
    weak = plain.isin(*V.WEAK_NAMES) | plain.rlike(r"^[\d\s.,:%+-]+$")
    return F.col("local_tag").endswith("TextView") & ~_own("visibility").isin("gone", "invisible") & (_own("labelFor") == "") & (said != "") & ~weak


def related_labels(targets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc, path, selector, relationship, required_value): the text view that can safely label each target (doc, path) with an id of its own.

    Of the nodes beside the target the nearest before it, else the nearest after
    it; else the same beside its container; else beside the container of that, if
    just one can. Targets without such a label have no row. nodes are those of
    ``rules.described``. What stands nearest before and after a node comes from a
    window over its siblings, so no node meets all others of its container.
    """
    fits = F.when(may_own_label(), F.col("path"))
    peers = Window.partitionBy("doc", "parent")
    line = peers.orderBy("ordinal")
    ident = reference(F.col("attrs")["android:id"], "id")
    read = nodes.where(F.col("error").isNull())
    # Only what siblings are looked at for goes through the window.
    rows = written(read.select("doc", "node", "parent", "ordinal", fits.alias("_fit")).withColumns({
        "_before": F.last("_fit", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1)),
        "_after": F.first("_fit", ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing)),
        "_others": F.count("_fit").over(peers) - F.col("_fit").isNotNull().cast("int"),
    }).select("doc", "node", "parent", F.coalesce("_before", "_after").alias("nearest"), "_others").where("parent IS NOT NULL AND nearest IS NOT NULL"))
    own = targets.select("doc", "path").distinct().join(read.select("doc", "node", "parent", "path", "ancestors", ident.alias("_ident")).where("parent IS NOT NULL AND _ident IS NOT NULL"), ["doc", "path"])
    # A target, its container and the container of that stand among siblings of their own.
    at = own.select("doc", "path", F.concat(F.lit("@id/"), "_ident").alias("required_value"), F.posexplode(F.slice(F.concat(F.array("node"), F.col("ancestors")), 1, 3)).alias("level", "node"))
    beside = at.join(rows.select("doc", "node", "nearest", "_others"), ["doc", "node"])
    good = beside.where((F.col("level") < 2) | (F.col("_others") == 1))
    first = good.groupBy("doc", "path", "required_value").agg(F.min_by(F.struct("nearest", "level"), "level").alias("x"))
    return first.select("doc", "path", F.col("x.nearest").alias("selector"), F.element_at(F.array(*map(F.lit, RELATIONS)), F.col("x.level") + 1).alias("relationship"), "required_value")


def relocated(findings: DataFrame, ident: str, nodes: DataFrame) -> DataFrame:
    """(ident, matches, node, path): each node that a stored finding (ident, doc, widget_id, widget_type, attributes) may be about, and how many there are.

    A node must have the finding's id and its kind of widget, as far as these are
    known. If several do, those that have all its attributes as well, where there
    are any. A finding without a match has one row, 0 and null.
    """
    bare = lambda c: F.map_from_entries(F.transform(F.map_entries(c), lambda e: F.struct(F.element_at(F.split(e["key"], ":"), -1), e["value"])))
    has = nodes.where(F.col("error").isNull()).select("doc", "node", "path", F.col("attrs"), reference(F.coalesce(F.col("attrs")["android:id"], F.col("attrs")["id"]), "id").alias("_id"), view_type(F.col("local_tag")).alias("_kind"))
    stored = findings.select(ident, "doc", "attributes", F.coalesce(reference(F.col("widget_id"), "id"), reference(F.col("attributes")["id"], "id")).alias("_id"), F.when(F.col("widget_type") != "", view_type(F.col("widget_type"))).alias("_kind"))
    tells = F.filter(F.map_entries("attributes"), lambda e: ~e["key"].isin(*PLAIN))
    pairs = None
    # By id where there is one, else by kind, so that a finding meets only what it can match.
    for keys, which in ((["_id"], F.col("_id").isNotNull()), (["_kind"], F.col("_id").isNull() & F.col("_kind").isNotNull()), ([], F.col("_id").isNull() & F.col("_kind").isNull())):
        some = stored.where(which).withColumnRenamed("_kind", "_want").withColumn("_kind", F.col("_want"))
        joined = some.drop(*({"_id", "_kind"} - set(keys))).join(has, ["doc", *keys])
        joined = joined.where(F.col("_want").isNull() | (F.col("_want") == F.col("_kind")))
        found = joined.select(ident, "node", "path", F.forall(tells, lambda e: F.coalesce(bare(F.col("attrs"))[e["key"]] == e["value"], F.lit(False))).alias("_same"))
        pairs = found if pairs is None else pairs.unionByName(found)
    every = Window.partitionBy(ident)
    kept = pairs.withColumn("_n", F.count_if("_same").over(every)).where(F.col("_same") | (F.col("_n") == 0))
    kept = kept.withColumn("matches", F.count("*").over(every)).select(ident, "matches", "node", "path")
    return findings.select(ident).join(kept, ident, "left").withColumn("matches", F.coalesce("matches", F.lit(0)))


def include_closure(files: DataFrame, includes: DataFrame, layouts: DataFrame, ids: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, ids, complete): ids of all files that a start takes in, and whether all that it includes could be read.

    files (path, ok: it parsed), includes (path, name; null: not a layout), layouts
    (name, path: one or more), ids (path, id), starts (path). A file is broken that
    doesn't parse or includes what isn't there; what reaches a broken file, over
    whatever cycles, is incomplete. That is found backwards from the broken files,
    a mark for each file, not a row for each path.
    """
    edges = written(includes.join(layouts.select("name", F.col("path").alias("target")), "name").select(F.col("path").alias("source"), "target").distinct())
    unresolved = includes.join(layouts.select("name"), "name", "left_anti").select("path")
    new = written(files.where(~F.col("ok")).select("path").unionByName(unresolved).distinct())
    parts = [new]
    while not new.isEmpty():
        new = written(edges.join(new.select(F.col("path").alias("target")), "target").select(F.col("source").alias("path")).distinct().join(grown(parts), "path", "left_anti"))
        parts.append(new)
    marked = grown(parts)
    unreadable = files.where(~F.col("ok")).select("path")
    inside = reachable(edges.join(unreadable.withColumnRenamed("path", "source"), "source", "left_anti"), starts.select(F.col("path").alias("item")))
    named = inside.join(ids.select(F.col("path").alias("item"), "id"), "item", "left").groupBy("start").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    bad = marked.select(F.col("path").alias("start"), F.lit(False).alias("_ok"))
    return named.join(bad, "start", "left").select("start", "ids", F.coalesce("_ok", F.lit(True)).alias("complete"))


SIGNATURE = ("code", "file", "selector", "severity", "repairability")


def distinct_findings(findings: DataFrame) -> DataFrame:
    """One row for each signature; null selectors count as empty ones, a missing repairability as ``xml_safe``."""
    return findings.select("code", "file", F.coalesce("selector", F.lit("")).alias("selector"), "severity", F.coalesce("repairability", F.lit("xml_safe")).alias("repairability")).distinct()


def owned(findings: DataFrame, closure: DataFrame, screens: DataFrame) -> DataFrame:
    """Distinct findings with the screen that owns each: the one whose own file has it, else of those that take the file in the one of highest score, then by name and path.

    closure (screen, file), screens (screen, name, score). Membership is by file, so
    owners are found for files, not for findings; findings of files in no screen go.
    """
    held = closure.select("screen", "file").distinct().join(screens, "screen")
    first = F.min_by("screen", F.struct((F.col("screen") != F.col("file")).alias("a"), (-F.col("score")).alias("b"), "name", "screen"))
    owner = held.groupBy("file").agg(first.alias("owner"), F.count("*").alias("screens"))
    return distinct_findings(findings).join(owner, "file")


def screen_counts(findings: DataFrame, closure: DataFrame) -> DataFrame:
    """(screen, code, n): distinct findings by code in all that a screen takes in; counted by file before screens are joined, so a file of many screens is counted once."""
    by_file = distinct_findings(findings).groupBy("file", "code").agg(F.count("*").alias("n"))
    return closure.select("screen", "file").distinct().join(by_file, "file").groupBy("screen", "code").agg(F.sum("n").alias("n"))
