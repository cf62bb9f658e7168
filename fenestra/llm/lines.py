"""Quality rules: cross-document line frequency.

Lines are normalised (lower case, runs of white space as one space) and hashed
together with their host. Per host, the distinct documents of a line are
counted. Lines of more than ``LIMIT`` documents of a host are removed; a
document of whose words fewer than ``LEFT`` remain, or that lost some and has
fewer than ``LEFT_WORDS``, is depleted and rejected. Base rules on each text
come first. ``cleaned`` gives the documents kept, without the lines removed.

A document is its doc_id with its text: copies under other ids are documents of
their own, rows that repeat are one. Only hashes and counts are shuffled. The
count of a line is aggregated before the shuffle; what is joined back are the
lines above the limit, by line, where a line of very many documents is a skewed
join that Spark splits.

Defined results: null text has no words, and fails the base rules; a null host
is a host; rows without doc_id are one document for each text. Rows that repeat
get the same result each.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fenestra.llm.common import cut, table, text_or_empty

#: Documents of a host that may share a line; the share of words, and the words, that must remain.
LIMIT, LEFT, LEFT_WORDS = 20, 0.2, 5
#: Fixed values of the base rules.
SYMBOLS, BLANKS, MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = "#*$%&|<>", " \t\n\x0b\x0c\r", 10, 20, 5

BASE = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])


def repeat_words(words: list) -> int:
    """Words that are in a window which the text has twice or more."""
    windows = list(zip(*(words[i:] for i in range(WINDOW))))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered, end = Counter(windows), 0, 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            covered += i + WINDOW - max(i, end)
            end = i + WINDOW
    return covered


def base_of(text: str) -> tuple[int, int, int, int, int]:
    words = text.encode().split()  # of bytes: at the six blanks only
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words)


@F.arrow_udf(BASE)
def base(texts: pa.Array) -> pa.Array:
    columns = zip(*(base_of(x.as_py() or "") for x in texts)) if len(texts) else [()] * 5
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], BASE.names)


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " "))


def hashed(*columns: Column) -> Column:
    """A hash that tells null from nothing."""
    return F.xxhash64(*(x for c in columns for x in (c.isNull(), c)))


def hash_of(host: Column, line: Column) -> Column:
    """line: normalised."""
    return F.xxhash64(host.isNull(), host, line)


def document() -> Column:
    return hashed(F.col("doc_id"), F.col("source"), F.col("text"))


def line_table(docs: DataFrame) -> DataFrame:
    """(document, line, words): a hash of each document and of each of its lines with words, and the words of all such lines in it."""
    words = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    some = F.filter(F.transform(F.split(text_or_empty("text"), "\n"), normalised), lambda x: x != "")
    lines = F.transform(some, lambda x: F.struct(hash_of(F.col("source"), x).alias("line"), words(x).alias("words")))
    rows = docs.select(document().alias("document"), F.explode(lines).alias("l"))
    return rows.groupBy("document", "l.line").agg(F.sum("l.words").alias("words"))


def common(lines: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Lines of more than ``limit`` documents of a host."""
    return lines.groupBy("line").agg(F.count("*").alias("documents")).where(F.col("documents") > limit)


def verdicts(docs: DataFrame, limit: int = LIMIT, left: float = LEFT, left_words: int = LEFT_WORDS) -> DataFrame:
    """(document, words, left, depleted, removed) of each document that has words; removed: the lines to remove."""
    lines = cut(line_table(docs))
    marked = lines.join(common(lines, limit), "line", "left")
    over = F.col("documents").isNotNull()
    sums = marked.groupBy("document").agg(F.sum("words").alias("words"), F.sum(F.when(~over, F.col("words")).otherwise(0)).alias("left"), F.collect_list(F.when(over, F.col("line"))).alias("removed"))
    return sums.withColumn("depleted", (F.col("left") < F.lit(left) * F.col("words")) | ((F.col("left") < left_words) & (F.col("left") < F.col("words"))))


def judged(docs: DataFrame, limit: int = LIMIT, left: float = LEFT, left_words: int = LEFT_WORDS) -> DataFrame:
    """doc_id, the base counts, base_failed, words left, and kept, for each row of docs (doc_id, text, source)."""
    marked = docs.select("doc_id", document().alias("document"), base(text_or_empty("text")).alias("base"))
    flat = marked.select("*", "base.*").drop("base")
    n = F.col("n_words")
    failed = flat.withColumn("base_failed", (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n))
    full = failed.join(verdicts(docs, limit, left, left_words).drop("removed"), "document", "left")
    return full.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("depleted", F.lit(False))).drop("document")


def cleaned(docs: DataFrame, limit: int = LIMIT, left: float = LEFT, left_words: int = LEFT_WORDS) -> DataFrame:
    """The rows of docs that are kept, their texts without the lines removed; all else as it is, but for n_chars, where it is there."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    whole = docs.select(row, document().alias("document"), base(text_or_empty("text")).alias("base"))
    n = F.col("base.n_words")
    fit = whole.where((n >= MIN_WORDS) & (100 * F.col("base.n_repeat_words") <= MAX_REPEAT_PERCENT * n)).drop("base")
    full = fit.join(verdicts(docs, limit, left, left_words).where("not depleted").select("document", "removed"), "document")
    rest = F.filter(F.split("_row.text", "\n"), lambda x: (normalised(x) == "") | ~F.array_contains("removed", hash_of(F.col("_row.source"), normalised(x))))
    text = F.when(F.size("removed") > 0, F.array_join(rest, "\n")).otherwise(F.col("_row.text"))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return full.select(*((new[c] if c in new else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged(docs).select(*columns, F.coalesce("left", F.lit(0)).cast("long").alias("words_left"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, string_split(text, chr(10)) AS ls FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 3, 1))) t(i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM rep, unnest(range(0, 5)) u(o) GROUP BY doc_id),
dup AS (SELECT doc_id, (count(*) - count(DISTINCT l))::BIGINT AS n_dup_lines FROM (SELECT doc_id, unnest(ls) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
nl AS (SELECT doc_id, source, text, trim(regexp_replace(lower(l), '[\x20\x09-\x0D]+', ' ', 'g')) AS l FROM (SELECT doc_id, source, text, unnest(ls) AS l FROM w)),
ll AS (SELECT doc_id, source, text, l, sum(length(l) - length(replace(l, ' ', '')) + 1) AS words FROM nl WHERE l <> '' GROUP BY ALL),
lc AS (SELECT *, count(*) OVER (PARTITION BY source, l) AS n FROM ll),
v AS (SELECT doc_id, source, text, sum(words)::BIGINT AS words, sum(CASE WHEN n <= 20 THEN words ELSE 0 END)::BIGINT AS rest FROM lc GROUP BY ALL),
b AS (SELECT w.doc_id, w.source, w.text, len(ws)::BIGINT AS n_words, coalesce(length(array_to_string(ws, '')), 0)::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN dup USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(rest < 0.2 * words OR (rest < 5 AND rest < words), false) AS kept, coalesce(rest, 0)::BIGINT AS words_left
FROM f LEFT JOIN v USING (doc_id)
"""
