"""PII: information-theoretic sanitisation, with DataFrame functions only.

E-mail addresses, IP addresses, card numbers and phone numbers are found by
patterns and checks; each value is a protected entity. The words of a text may
give an entity away though the value itself is hidden. How strongly, is
estimated from the corpus: with c(e) documents that have the entity, c(t) that
have the term, c(e, t) that have both, and N in all,

    PMI(e; t) = log2(N c(e, t) / (c(e) c(t))),   IC(e) = log2(N / c(e)),

and the disclosure is PMI / IC: 1 if the term is found with the entity only. A
term seen with an entity in at least ``SUPPORT`` documents with a disclosure of
``GENERALISE`` or more is generalised to the kind of word it is, wherever it
stands in a text with that entity, and removed from ``REMOVE`` on. Texts that
are equal count as one document, so copies are no evidence.

Texts stay where they are scanned. A first pass writes the spans, and for texts
with spans hashes of their distinct words; pairs are counted from entities with
enough documents only. c(t) is counted in a second pass that keeps only terms
which some entity needs; a third one finds the places of disclosing terms. What
these passes look for is broadcast up to ``BROADCAST`` bytes, and joined by a
shuffle beyond. Counts are aggregated before shuffling.

Defined results: null text has no spans. Rows that repeat get the same result
each. Spans are in code points; base spans always stay as they are, and a term
that overlaps one is left to it. A run of letters without blanks, as in Chinese,
is one word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fenestra.llm.common import cut, table, text_or_empty

#: Documents of evidence; limits of disclosure; bytes that may be broadcast.
SUPPORT, GENERALISE, REMOVE, BROADCAST = 3, 0.8, 0.95, 16 << 20
#: Pieces of a text that are added up at a time.
STEP = 128

# The kinds in order, what a text must have for one, and their patterns. Where nothing but the cost of a failed try
# differs, quantifiers don't give back, and a match starts where its run of characters does (or where the last match ended).
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": ("@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (".", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": ("", r"[0-9](?:[\x20-]?[0-9]){11,}+"),
    "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
WORD_PATTERN = r"[\p{L}\p{N}]++"
MARK, OTHER = "\x01", "\x02"


MATCHES = "array<struct<start:int,end:int,value:string>>"


def found(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of the leftmost matches that don't overlap."""
    marked = F.regexp_replace(F.translate(text, MARK, OTHER), pattern, f"{MARK}$0{MARK}")
    pieces = F.split(marked, MARK)  # every second one is a match
    none = F.array().cast(MATCHES)

    def step(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.length(piece)
        match = F.struct(acc["at"].alias("start"), end.alias("end"), piece.alias("value"))
        return F.struct(end.alias("at"), (~acc["inside"]).alias("inside"), F.when(acc["inside"], F.array_append(acc["out"], match)).otherwise(acc["out"]).alias("out"))

    # Arrays grow by copies, so they are filled in runs of STEP pieces, and the runs are put together once.
    def run(acc: Column, i: Column) -> Column:
        start = F.struct(acc["at"].alias("at"), F.lit(False).alias("inside"), none.alias("out"))
        return F.aggregate(F.slice(pieces, i * STEP + 1, F.lit(STEP)), start, step, lambda own: F.struct(own["at"].alias("at"), F.array_append(acc["runs"], own["out"]).alias("runs")))

    runs = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / STEP).cast("int"))
    whole = F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{MATCHES}>").alias("runs")), run, lambda acc: F.flatten(acc["runs"]))
    few = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(F.size(pieces) <= 1, none).when(F.size(pieces) <= STEP, few).otherwise(whole)


def luhn(digits: Column) -> Column:
    """Whether the sum, with every second digit from the right doubled and its digits added, ends in 0."""
    n = F.length(digits)
    digit = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    value = lambda i: F.when(i % 2 == 0, digit(i)).otherwise(2 * digit(i) - F.when(digit(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: part.try_cast("double") <= 255)
    if kind == "card":
        return F.when(n.between(12, 19), luhn(digits)).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def valid(matches: Column, kind: str) -> Column:
    return F.filter(matches, lambda m: holds(kind, m["value"]))


def tagged(matches: Column | str, order: int, kind: str) -> Column:
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("order"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["value"].alias("value")))


def base_spans(text: Column) -> dict[str, Column]:
    """By kind: array of (start, end, value)."""
    out = {}
    for kind in KINDS:
        needs, pattern = PATTERNS[kind]
        all_ = valid(found(text, pattern), kind)
        none = F.array().cast(MATCHES)
        out[kind] = F.when(F.contains(text, F.lit(needs)), all_).otherwise(none) if needs else all_
    return out


def term_of(word: Column) -> Column:
    return F.xxhash64(F.lower(word))


def terms_of(text: Column) -> Column:
    """Hashes of the distinct words, lower-cased."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0)), term_of))


def digest(text: Column | str) -> Column:
    """128 bits for a text, by which its cuts find it again: at 10^10 texts, two that differ share one once in 10^18 times."""
    return F.unhex(F.md5(F.col(text).cast("binary") if isinstance(text, str) else text.cast("binary")))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, document (a digest of the text), spans by kind in one sorted array, and for texts with spans the terms."""
    text = F.col("_text")
    rows = docs.select("doc_id", text_or_empty("text").alias("_text"))
    kinds = base_spans(text)
    rows = rows.withColumns({f"_{k}": v for k, v in kinds.items()})
    every = F.concat(*(tagged(f"_{k}", i, k) for i, k in enumerate(KINDS)))
    rows = rows.select("doc_id", digest("_text").alias("document"), "_text", F.array_sort(every).alias("spans"))
    return rows.withColumn("words", F.when(F.size("spans") > 0, terms_of(text))).drop("_text")


def small(rows: DataFrame, each: Column) -> DataFrame:
    """rows, to be broadcast if the bytes of all of them, by what each takes, are few enough; else the join is a shuffle. rows are read from what was written of them."""
    return F.broadcast(rows) if (rows.agg(F.sum(each)).first()[0] or 0) <= BROADCAST else rows


def term_counts(docs: DataFrame, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, c_t): how many distinct texts have each wanted term. rows: of scanned().

    Texts that are there once are counted where they are read, without a shuffle of
    their terms; only those whose hash is there more often are told apart first.
    """
    key = F.xxhash64("document").alias("key")
    copied = small(cut(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select("key")), F.lit(16))
    texts = docs.select(digest(text_or_empty("text")).alias("document"), "text").withColumn("key", key)
    once = texts.join(copied, "key", "left_anti").select(F.explode(terms_of(F.col("text"))).alias("term"))
    more = texts.join(copied, "key", "left_semi").select("document", terms_of(F.col("text")).alias("terms")).dropDuplicates(["document"]).select(F.explode("terms").alias("term"))
    counts = [x.join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("c")) for x in (once, more)]
    return counts[0].unionByName(counts[1]).groupBy("term").agg(F.sum("c").alias("c_t"))


def disclosing(docs: DataFrame, rows: DataFrame, support: int = SUPPORT, limit: float = GENERALISE) -> DataFrame:
    """(document, hidden): for each document with disclosing terms a map of these to the strongest disclosure. rows: of scanned()."""
    n = F.lit(float(max(1, rows.select("document").distinct().count())))
    entities = F.array_distinct(F.transform("spans", lambda s: F.xxhash64(s["kind"], F.lower(s["value"]))))
    having = rows.where(F.size("spans") > 0)
    once = having.select("document", F.explode(entities).alias("entity")).distinct()
    of_entity = cut(once.groupBy("entity").agg(F.count("*").alias("c_e")).where(F.col("c_e") >= support))
    known = cut(once.join(small(of_entity, F.lit(40)), "entity"))  # (entity, document, c_e)
    listed = known.groupBy("document").agg(F.collect_list(F.struct("entity", "c_e")).alias("entities"))  # those of one text
    words = having.select("document", "words").join(listed, "document").dropDuplicates(["document"])
    both = words.select(F.explode("entities").alias("e"), "words").select("e.*", F.explode("words").alias("term"))
    pairs = both.groupBy("entity", "term").agg(F.count("*").alias("c_et"), F.first("c_e").alias("c_e")).where(F.col("c_et") >= support)
    # A term is in at least as many documents as have it with any entity; pairs that can't reach the limit even so need no count.
    at_least = pairs.groupBy("term").agg(F.max("c_et").alias("c_with"))
    pairs = pairs.join(at_least, "term").where(F.col("c_with") <= 1.000001 * F.col("c_et") * F.pow(n / F.col("c_e"), F.lit(1 - limit)))
    pairs = cut(pairs.drop("c_with"))
    wanted = small(cut(pairs.select("term").distinct()), F.lit(32))
    of_term = term_counts(docs, rows, wanted)
    pmi = F.log2(n * F.col("c_et") / (F.col("c_e") * F.col("c_t")))
    # An entity that every document has is no information.
    disclosure = F.when(F.col("c_e") < n, pmi / F.log2(n / F.col("c_e"))).otherwise(0.0)
    strong = cut(pairs.join(of_term, "term").withColumn("disclosure", disclosure).where(F.col("disclosure") >= limit).select("entity", "term", "disclosure"))
    # For each document the terms that its own entities are disclosed by, whether it has them all or not: as many as its entities have.
    of_document = known.select("document", "entity").join(small(strong, F.lit(48)), "entity").groupBy("document", "term").agg(F.max("disclosure").alias("disclosure"))
    return of_document.groupBy("document").agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("hidden"))


def spanned(docs: DataFrame, support: int = SUPPORT, limit: float = GENERALISE) -> DataFrame:
    """doc_id, document, spans, and terms: array of (start, end, value, disclosure) of the terms to be hidden."""
    rows = cut(scanned(docs))
    hidden = cut(disclosing(docs, rows, support, limit))
    text = F.col("_text")
    texts = docs.select(text_or_empty("text").alias("_text")).select(digest("_text").alias("document"), "_text")
    level = lambda m: F.element_at("hidden", term_of(m["value"]))
    hits = F.filter(F.transform(found(text, WORD_PATTERN), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), level(m).alias("disclosure"))), lambda m: m["disclosure"].isNotNull())
    terms = texts.join(small(hidden, 80 + 40 * F.size("hidden")), "document").select("document", hits.alias("terms")).dropDuplicates(["document"])
    clear = lambda t: ~F.exists("spans", lambda s: (t["start"] < s["end"]) & (s["start"] < t["end"]))
    joined = rows.drop("words").join(terms, "document", "left")
    return joined.withColumn("terms", F.coalesce(F.filter("terms", clear), F.array().cast("array<struct<start:int,end:int,value:string,disclosure:double>>")))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    plain = lambda s, order, kind: F.struct(s["start"].alias("start"), order.alias("order"), s["end"].alias("end"), kind.alias("kind"))
    base = F.transform("spans", lambda s: plain(s, s["order"], s["kind"]))
    terms = F.transform("terms", lambda s: plain(s, F.lit(len(KINDS)), F.lit("term")))
    return rows.select("doc_id", *map(count, KINDS), F.sha2(written(base), 256).alias("base_sha256"), written(F.array_sort(F.concat(base, terms))).alias("spans"))


def kind_of(word: Column) -> Column:
    """What a term is generalised to: a code if it has digits, a name if it begins with a capital or has no cases, else a word."""
    first = F.substring(word, 1, 1)
    name = (first == F.upper(first)) & ((first != F.lower(first)) | F.regexp_like(word, F.lit(r"^\p{Lo}")))
    return F.when(F.regexp_like(word, F.lit(r"\p{N}")), "[CODE]").when(name, "[NAME]").otherwise("[WORD]")


def sanitised(docs: DataFrame) -> DataFrame:
    """docs with values replaced by their kind, and disclosing terms by the kind of word they are, or by nothing."""
    found_ = spanned(docs.select("doc_id", "text")).where((F.size("spans") > 0) | (F.size("terms") > 0))
    put = lambda s, text: F.struct(s["start"].alias("start"), s["end"].alias("end"), text.alias("put"))
    values = F.transform("spans", lambda s: put(s, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
    cuts = F.array_sort(F.concat(values, F.transform("terms", lambda s: put(s, F.when(s["disclosure"] >= REMOVE, "").otherwise(kind_of(s["value"]))))))
    per_text = found_.select("document", cuts.alias("_cuts")).dropDuplicates(["document"])
    text = F.col("_row.text")

    # What is before each cut, from the end of the one before it, and what is put there; cuts that begin inside an earlier one are left out.
    merged = F.aggregate(
        "_cuts", F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, c: F.when(c["start"] >= acc["at"], F.struct(c["end"].alias("at"), F.array_append(acc["out"], F.concat(F.substring(text, acc["at"] + 1, c["start"] - acc["at"]), c["put"])).alias("out"))).otherwise(acc),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))),
    )
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), digest(text_or_empty("text")).alias("document")).join(per_text, "document", "left")
    hit = F.col("_cuts").isNotNull()
    clean = rows.withColumn("_text", F.when(hit, merged).otherwise(text))
    new = {"text": F.col("_text"), "n_chars": F.when(hit, F.length("_text").cast("long")).otherwise(F.col("_row.n_chars"))} if "n_chars" in docs.columns else {"text": F.col("_text")}
    return clean.select(*((new.get(c, F.col(f"_row.`{c}`"))).alias(c) for c in docs.columns))
