"""Trees of XML and HTML documents as node tables, and what lies around a node.

A document is parsed once, into a row for each element with its path and its
ancestors' numbers; all else is joins and aggregates on (document, node).
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODE = "node int, parent int, ordinal int, depth int, tag string, local_tag string, attrs map<string,string>, text string, path string, ancestors array<int>, error string"

# Nodes that leave Python together (documents are never split), prefixes of name spaces, and HTML elements without content.
BATCH = 2000
PREFIXES = {"http://schemas.android.com/apk/res/android": "android", "http://schemas.android.com/apk/res-auto": "app", "http://schemas.android.com/tools": "tools"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def local(name: str) -> str:
    return re.split(r"[}.]", name)[-1]


def prefixed(name: str) -> str:
    space, _, rest = name[1:].partition("}") if name.startswith("{") else ("", "", name)
    return f"{PREFIXES.get(space, space)}:{rest}" if space else rest


def _xml_events(text: str):
    """("start", tag, attributes, text before children) and ("end",) of an XML text."""

    def walk(e):
        yield "start", e.tag, {prefixed(k): v for k, v in e.attrib.items()}, "".join(e.itertext()) if len(e) else e.text or ""
        for child in e:
            if isinstance(child.tag, str):
                yield from walk(child)
        yield ("end",)

    yield from walk(ElementTree.fromstring(text))


class _Html(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.events: list[tuple] = []
        self.open: list[str] = []

    def handle_starttag(self, tag, attrs):
        self.events.append(("start", tag, {k: v or "" for k, v in attrs}, ""))
        if tag in VOID:
            self.events.append(("end",))
        else:
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.events += [("start", tag, {k: v or "" for k, v in attrs}, ""), ("end",)]

    def handle_endtag(self, tag):
        while tag in self.open:
            self.events.append(("end",))
            if self.open.pop() == tag:
                break

    def handle_data(self, data):
        self.events.append(("text", data))


def _html_events(text: str):
    parser = _Html()
    parser.feed(text)
    parser.close()
    yield from parser.events + [("end",)] * len(parser.open)


def nodes_of(text: str | None, kind: str) -> list[dict]:
    """Rows of one document; a single row with an error if it can't be read."""
    out: list[dict] = []
    stack: list[int] = []
    children: dict[int, dict[str, int]] = {-1: {}}
    size: dict[int, int] = {-1: 0}
    try:
        for event in (_html_events if kind == "html" else _xml_events)(text or ""):
            if event[0] == "end":
                stack.pop()
            elif event[0] == "text":
                if stack:
                    out[stack[-1]]["text"] += event[1]
            else:
                _, tag, attrs, own = event
                up, name = stack[-1] if stack else -1, local(tag)
                children[up][name] = children[up].get(name, 0) + 1
                node = len(out)
                path = (out[up]["path"] if up >= 0 else "") + f"/{name}[{children[up][name]}]"
                out.append({"node": node, "parent": up if up >= 0 else None, "ordinal": size[up], "depth": len(stack), "tag": tag, "local_tag": name, "attrs": attrs, "text": own, "path": path, "ancestors": stack[::-1], "error": None})
                size[up] += 1
                children[node], size[node] = {}, 0
                stack.append(node)
    except ElementTree.ParseError as e:
        return [{"node": None, "attrs": None, "ancestors": None, "error": str(e)}]
    return out


def parse(documents: DataFrame, key: str, content: str, kind: str = "xml", also: Sequence[str] = ()) -> DataFrame:
    """(key, also, columns of NODE): a row for each element in document order; null content is an error row like any that doesn't parse, null HTML has no nodes. also: columns of the document that its nodes have too."""
    kinds, ids = dict(documents.dtypes), [key, *also]
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in ids), NODE])
    arrow = pa.schema([("node", pa.int32()), ("parent", pa.int32()), ("ordinal", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()), ("local_tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("path", pa.string()), ("ancestors", pa.list_(pa.int32())), ("error", pa.string())])

    def table(of: list[int], rows: list[dict], batch: pa.RecordBatch) -> pa.RecordBatch:
        body = [pa.array([list(r["attrs"].items()) if r["attrs"] is not None else None for r in rows] if f.name == "attrs" else [r.get(f.name) for r in rows], f.type) for f in arrow]
        return pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(of)) for i in range(len(ids))), *body], names=[*ids, *arrow.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, rows = [], []
            for i, text in enumerate(batch.column(len(ids))):
                found = nodes_of(text.as_py(), kind)
                of += [i] * len(found)
                rows += found
                if len(rows) >= BATCH:
                    yield table(of, rows, batch)
                    of, rows = [], []
            if rows:
                yield table(of, rows, batch)

    return documents.select(*ids, content).mapInArrow(run, schema)


def ancestry(nodes: DataFrame, key: str, columns: dict[str, Column], own: bool = False) -> DataFrame:
    """(key, node, distance, columns of the ancestor): one row for each node and ancestor, itself included if own."""
    up = F.posexplode(F.concat(F.array("node"), F.col("ancestors")) if own else F.col("ancestors"))
    pairs = nodes.select(key, "node", up.alias("distance", "_up"))
    values = nodes.select(F.col(key), F.col("node").alias("_up"), *(c.alias(n) for n, c in columns.items()))
    return pairs.join(values, [key, "_up"]).select(key, "node", "distance", *columns)


def last_by_id(nodes: DataFrame, key: str, name: Column, columns: dict[str, Column]) -> DataFrame:
    """Of the nodes that share a name, the last in document order: (key, name, columns)."""
    named = nodes.select(key, name.alias("name"), F.col("node").alias("_node"), F.struct(*(c.alias(n) for n, c in columns.items())).alias("v")).where(F.col("name").isNotNull())
    return named.groupBy(key, "name").agg(F.max_by("v", "_node").alias("v")).select(key, "name", *(F.col(f"v.{n}").alias(n) for n in columns))


def signature(nodes: DataFrame, key: str, erased: tuple[str, ...] = ()) -> DataFrame:
    """(key, signature): a hash of each tree's tags, attributes (in order of name, the erased ones' values left out) and shape; the key of near copies, or of exact ones with nothing erased."""
    kept = F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.concat(e["key"], F.lit("="), F.when(e["key"].isin(*erased), "*").otherwise(e["value"]) if erased else e["value"]))
    line = F.concat_ws("\x1f", F.col("depth").cast("string"), F.col("tag"), F.array_join(kept, "\x1e"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("node", line.alias("line")))), lambda x: x["line"])
    return nodes.where(F.col("error").isNull()).groupBy(key).agg(F.sha2(F.array_join(ordered, "\n"), 256).alias("signature"))


def shape(nodes: DataFrame, key: str) -> DataFrame:
    """Elements, depth, package-named tags and references of each tree."""
    references = F.size(F.filter(F.map_values("attrs"), lambda v: v.startswith("@")))
    return nodes.where(F.col("error").isNull()).groupBy(key).agg(F.count("*").alias("elements"), F.max("depth").alias("max_depth"), F.count_if(F.contains("tag", F.lit("."))).alias("custom_tags"), F.sum(references).alias("references"))


def located(targets: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """targets (key, path) with the node that a path stands for, null if there is none."""
    return targets.join(nodes.select(key, "path", "node", "tag", "attrs"), [key, "path"], "left")


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, item): what is reached from each start over edges (source, target), itself included; cycles end as nothing new is reached."""
    from fenestra.checkpoints import grown, written

    frontier = written(starts.select(F.col("item").alias("start"), "item").distinct())
    steps, parts = edges.select(F.col("source").alias("item"), "target"), [frontier]
    while not frontier.isEmpty():
        frontier = written(frontier.join(steps, "item").select("start", F.col("target").alias("item")).distinct().join(grown(parts), ["start", "item"], "left_anti"))
        parts.append(frontier)
    return grown(parts)


def first_lines(files: DataFrame, path: str, content: str, wanted: DataFrame) -> DataFrame:
    """wanted (path, needle) with the first line, from 1, that holds the needle."""
    rows = files.select(path, F.posexplode(F.split(content, "\n")).alias("_n", "_line"))
    hit = wanted.join(rows, path).where(F.contains("_line", F.col("needle")))
    return wanted.join(hit.groupBy(path, "needle").agg((F.min("_n") + 1).alias("line")), [path, "needle"], "left")


def siblings(key: str, condition: Column) -> Column:
    """How many nodes of the same parent meet a condition (a window's column)."""
    return F.count_if(condition).over(Window.partitionBy(key, "parent"))
