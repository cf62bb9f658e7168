import hashlib
import math
import random
import re
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from fenestra.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, value):
    d = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def base(text):
    return sorted((m.start(), i, m.end(), k) for i, k in enumerate(PATTERNS) for m in re.finditer(PATTERNS[k], text, re.A) if holds(k, m[0]))


def test_base_spans_against_brute_force(spark, sf, tmp_path):
    rng = random.Random(4)
    pieces = ["a", "b@c", "@x.y", "a.b@c.d", "1.2.3.4", "255.1.1.9", "300.", "+1 (234) 567-8901", "4111 1111 1111 1111", "5500-0000-0000-0004", " ", "-", ".", "+", "\x01", "é", "字", "9", "12", "_", "%", "\n", "007"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    texts += [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in pii.op10_pii(spark, str(tmp_path)).collect():
        spans = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).encode()).hexdigest(), texts[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[3] == k for s in spans) for k in PATTERNS]


WORDS = regex.compile(r"\p{L}[\p{L}\p{N}]*+")


def brute_terms(texts, support=3, limit=0.8):
    """Spans of disclosing terms of each text."""
    whole = {x: ({(k, x[a:b].lower()) for a, _, b, k in base(x)}, {w.lower() for w in WORDS.findall(x)}) for x in {t or "" for t in texts}}
    n, c_e, c_t, c_et = len(whole), Counter(), Counter(), Counter()
    for entities, words in whole.values():
        c_e.update(entities)
        c_t.update(words)
        c_et.update((e, w) for e in entities for w in words)
    strong = {(e, w): math.log2(n * c / (c_e[e] * c_t[w])) / math.log2(n / c_e[e]) for (e, w), c in c_et.items() if c >= support and c_e[e] < n}
    out = []
    for x in (t or "" for t in texts):
        spans, hidden = base(x), {}
        for (e, w), d in strong.items():
            if e in whole[x][0] and d >= limit:
                hidden[w] = max(d, hidden.get(w, 0))
        out.append([(m.start(), m.end(), round(hidden[m[0].lower()], 9)) for m in WORDS.finditer(x) if m[0].lower() in hidden and not any(m.start() < b and a < m.end() for a, _, b, _ in spans)])
    return out


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_disclosing_terms_by_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(pii, "BROADCAST", broadcast)
    rng = random.Random(8)
    people = [("Kim", "kim@a.org"), ("Ann Lee", "+1 (234) 567-8901"), ("\u738b\u82b3", "10.0.0.7"), ("Zebulon", "4111 1111 1111 1111")]
    texts = [None, "", "same text of a@b.c", "same text of a@b.c"]
    for i in range(400):
        words = [rng.choice(["the", "of", "report", "notes", "Kim", "weather", f"w{rng.randint(0, 60)}"]) for _ in range(rng.randint(3, 90))]
        if rng.random() < 0.25:
            name, value = rng.choice(people)
            words.insert(0, name)
            words.insert(rng.randint(0, len(words)), value)
        texts.append(" ".join(words))
    texts += texts[10:40]
    df = spark.createDataFrame([(i if i % 9 else None, x) for i, x in enumerate(texts)], "doc_id long, text string")
    want = sorted(map(repr, brute_terms(texts)))
    got = sorted(repr([(t["start"], t["end"], round(t["disclosure"], 9)) for t in r.terms]) for r in pii.spanned(df).collect())
    assert got == want and sum(x != "[]" for x in want) > 30


def test_many_matches_in_a_text(spark):
    text = " ".join(f"a{i}@b.c 1.2.3.{i % 300}" for i in range(3000)) + " end"
    r = pii.spanned(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(s["start"], s["end"]) for s in r.spans] == [(a, b) for a, _, b, _ in base(text)]


def test_disclosing_terms(spark):
    docs = [(i, f"Contact Zebulon about report{i} at zeb@corp.org for more, number {i} of these notes") for i in range(6)]
    docs += [(100 + i, f"Other notes about weather and number {i} with words that differ each time{i} for more of these") for i in range(200)]
    docs += [(400 + i, f"Contact somebody{i} about report at no{i}@corp.org") for i in range(5)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: {docs[r.doc_id][1][t["start"] : t["end"]] for t in r.terms} for r in pii.spanned(df).where("doc_id < 6").collect()}
    assert all("Zebulon" in words and "about" not in words for words in got.values())
    assert all(not r.terms for r in pii.spanned(df).where("doc_id >= 100").collect())
    clean = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    assert "zeb@corp.org" not in clean[0] and "Zebulon" not in clean[0] and "[EMAIL]" in clean[0] and clean[150] == docs[56][1]
    kinds = spark.createDataFrame([("Zebulon",), ("weather",), ("x23",), ("\u738b\u82b3",), ("\u00c9mile",)], "w string").select(pii.kind_of(F.col("w")).alias("k"))
    assert [r.k for r in kinds.collect()] == ["[NAME]", "[WORD]", "[CODE]", "[NAME]", "[NAME]"]


@pytest.mark.parametrize("broadcast", [pii.BROADCAST, 0])
def test_terms_of_texts_without_copies_are_counted_where_they_are_read(spark, monkeypatch, broadcast):
    monkeypatch.setattr(pii, "BROADCAST", broadcast)
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["Foo", "foo", "bar", "baz", "字", "7"]) for _ in range(rng.randint(0, 5))) + f" t{i % 90}" for i in range(120)] + [None, "", "", "foo foo", "foo foo"]
    docs = spark.createDataFrame([(i % 7, x) for i, x in enumerate(texts)], "doc_id long, text string").repartition(5)
    want = Counter(w for x in {t or "" for t in texts} for w in {y.lower() for y in x.split()})
    rows = pii.cut(pii.scanned(docs))
    wanted = spark.createDataFrame([(w,) for w in want], "w string").select(pii.term_of(F.col("w")).alias("term"), "w")
    got = pii.term_counts(docs, rows, wanted.select("term"))
    assert {r.w: r.c_t for r in wanted.join(got, "term").collect()} == want
    # Shuffles by document and term moved a row for each word of each text; what is shuffled now by document has its terms in one row.
    assert not re.search(r"hashpartitioning\(document#\d+, term#|hashpartitioning\(term#\w+, document#", got._jdf.queryExecution().executedPlan().toString())
