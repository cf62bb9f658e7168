"""WARC: a Merkle fixity audit of two replicas.

A replica is a table of records (volume, offset, length, record_id, digest).
Its tree hashes, for each volume, the records of an offset range of ``RANGE``
bytes in order of their offsets, then ``FANOUT`` neighbouring ranges, and so on
up to the volume's root. The audit compares roots, and at each level keeps the
children of nodes that differ; below the lowest it compares the records of the
ranges left, and says which are altered, missing or extra.

Groups are bounded by the range and the fan-out, so a volume of any size is
spread; only hashes are shuffled, never payloads.

Defined results: a null payload is hashed as an empty one; a null volume is a
volume; records at the same place are ordered by their id and digest, and a
repeated record is compared by how often it is there. Replicas with no records
agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fenestra.llm.common import cut, table

#: Bytes of an offset range; children of a node.
RANGE, FANOUT = 64 << 10, 16
#: Pages of a volume of the query's archive.
VOLUME = 500


def record(url: Column, html: Column, ident: Column) -> Column:
    """A response record as text."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(ident.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def archive(pages: DataFrame, *more: Column) -> DataFrame:
    """pages (page_id, url, html) as records, end to end in volumes of neighbouring ids; more: columns of each page to keep beside its record."""
    written = record(F.col("url"), F.col("html"), F.col("page_id"))
    own = [F.floor(F.col("page_id") / VOLUME).alias("volume"), F.col("page_id").alias("record_id"), F.octet_length(written).cast("long").alias("length"), F.sha2(written, 256).alias("digest")]
    rows = pages.select(*own, *more)
    before = Window.partitionBy("volume").orderBy("record_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def tree(records: DataFrame, levels: int, fanout: int = FANOUT) -> list[DataFrame]:
    """Nodes (volume, node, digest) of each level, from ranges to roots."""
    entry = F.struct("offset", "record_id", "length", "digest")
    line = lambda e: F.concat_ws(":", e["offset"].cast("string"), F.coalesce(e["record_id"].cast("string"), F.lit("")), e["length"].cast("string"), e["digest"])
    hashed = lambda c, f: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(c)), f), ";"), 256).alias("digest")
    out = [cut(records.groupBy("volume", F.floor(F.col("offset") / RANGE).alias("node")).agg(hashed(entry, line)))]
    for _ in range(levels):
        child = F.struct("node", "digest")
        out.append(cut(out[-1].groupBy("volume", F.floor(F.col("node") / fanout).alias("node")).agg(hashed(child, lambda c: F.concat_ws(":", c["node"].cast("string"), c["digest"])))))
    return out


def differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """(volume, node) of the nodes that are not alike in both."""
    on = F.col("l.volume").eqNullSafe(F.col("r.volume")) & (F.col("l.node") == F.col("r.node"))
    both = left.alias("l").join(right.alias("r"), on, "full_outer").where(~F.col("l.digest").eqNullSafe(F.col("r.digest")))
    return both.select(F.coalesce("l.volume", "r.volume").alias("volume"), F.coalesce("l.node", "r.node").alias("node"))


def below(nodes: DataFrame, parents: DataFrame, size: int, of: str = "node") -> DataFrame:
    on = nodes["volume"].eqNullSafe(F.col("p.volume")) & (F.floor(nodes[of] / size) == F.col("p.node"))
    return nodes.join(parents.alias("p"), on, "left_semi")


def audit(primary: DataFrame, replica: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Records that are not alike: volume, offset, record_id, state, expected and found (digests)."""
    last = primary.select("offset").unionByName(replica.select("offset")).agg(F.max("offset")).first()[0] or 0
    levels, reach = 0, RANGE
    while reach <= last:
        levels, reach = levels + 1, reach * fanout
    ours, theirs = tree(primary, levels, fanout), tree(replica, levels, fanout)
    wrong = cut(differing(ours[levels], theirs[levels]))
    for level in range(levels - 1, -1, -1):
        wrong = cut(differing(below(ours[level], wrong, fanout), below(theirs[level], wrong, fanout)))
    places = ["volume", "offset", "record_id", "length", "digest"]
    a, b = (below(r.select(*places), wrong, RANGE, "offset").groupBy("volume", "offset", "record_id").agg(F.array_sort(F.collect_list(F.struct("length", "digest"))).alias("has")) for r in (primary, replica))
    same = lambda c: F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    both = a.alias("a").join(b.alias("b"), same("volume") & same("offset") & same("record_id"), "full_outer").where(~F.col("a.has").eqNullSafe(F.col("b.has")))
    state = F.when(F.col("b.has").isNull(), "missing").when(F.col("a.has").isNull(), "extra").otherwise("altered")
    digests = lambda c: F.array_join(F.col(c)["digest"], ",")
    return both.select(*(F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in ("volume", "offset", "record_id")), state.alias("state"), digests("a.has").alias("expected"), digests("b.has").alias("found"))


def op6_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive of pages against a replica that lost records, and had letters changed in others, by a rule on the hash of their ids."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    fate = F.coalesce(F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 1), F.lit(""))
    changed = record(F.col("url"), F.concat(F.lit("~"), F.substring("html", 2, 1 << 30)), F.col("page_id"))
    both = cut(archive(pages, fate.alias("_fate"), F.when(fate == "0", F.sha2(changed, 256)).alias("_changed")))
    replica = both.where("_fate <> 'f'").withColumn("digest", F.coalesce("_changed", "digest")).drop("_fate", "_changed")
    return audit(both.drop("_fate", "_changed"), replica)


OP6_SQL = r"""
WITH r AS (SELECT page_id, floor(page_id / 500.0)::BIGINT AS volume, substr(md5(page_id::VARCHAR), 1, 1) AS fate,
  'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
  || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) AS head, coalesce(html, '') AS html, chr(13) || chr(10) || chr(13) || chr(10) AS tail FROM pages),
h AS (SELECT *, sha256(head || html || tail) AS digest, sha256(head || '~' || substr(html, 2) || tail) AS bad, strlen(head || html || tail) AS length FROM r),
o AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY volume ORDER BY page_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM h)
SELECT volume, "offset", page_id AS record_id, CASE fate WHEN 'f' THEN 'missing' ELSE 'altered' END AS state, digest AS expected, CASE fate WHEN '0' THEN bad END AS found
FROM o WHERE fate = 'f' OR (fate = '0' AND bad <> digest)
"""
