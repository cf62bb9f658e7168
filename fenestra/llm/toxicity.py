"""Toxicity: a subsequence string-kernel support vector machine on Nyström landmarks.

The kernel of two words is that of their common subsequences of four letters,
each weighed by a decay to the power of the stretch of letters that it spans
(seven at most), so insults with letters put in between or with other endings
still match; it is divided by a length of each word that depends on its number
of letters. Words are folded first: case, accents, look-alike digits and signs,
marks between letters; single letters in a row are one word. The kernel of two
sentences is the sum over pairs of their distinct words. A sentence ends at a full stop,
at a line's end, or after ``WORDS`` words.

Training sees a bounded sample of labelled documents, and its instances are the
sentences. Landmarks are sentences of one word; the kernel among them gives the
Nyström map, on which a linear machine with squared hinge loss is trained by
Newton steps. Labels are given for documents. Sentences of clean documents are
clean; of a toxic document those are toxic at first that have its most telling
word, and in each round those that the machine finds so, and its highest one;
its other sentences count as neither.

As the kernel is an inner product over subsequences, the trained machine comes
down to a weight for each subsequence of the landmarks: a table of bounded size
that is broadcast. A sentence is scored by the sum over its distinct words, a
document by its highest sentence, calibrated by a logistic curve.

Defined results: null text scores as empty text does, by the intercept alone.
Rows that repeat score alike. Without LEAST labelled rows of each kind
all rows score 0. Labels are used for rows of the training folds only; doc_id, language
and source are never inputs.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fenestra.llm.common import cut, table

#: Letters of a subsequence, the stretch it may span, and its decay; words of a sentence.
LENGTH, SPAN, DECAY, WORDS = 4, 7, 0.6, 40
#: Documents of each label in the training sample, and the characters that one of them may have.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARACTERS = 700, 1100, 20_000
#: Landmarks of each kind; rounds of relabelling; Newton steps; the cost of errors; share of the largest eigenvalue below which directions are left out.
LANDMARKS, ROUNDS, STEPS, COST, RANK = 64, 4, 12, 3e5, 1e-3
#: Scores of words that a Python worker remembers; characters of the texts handled at a time.
MEMO, CHARACTERS = 300_000, 1_000_000
THRESHOLD = 0.3
#: Rows that a step of training works on at a time.
BLOCK = 8192
#: Toxic documents that must have a word, for it to be taken for telling.
SUPPORT = 3
#: Labelled documents of each kind without which nothing is learnt.
LEAST = 5
#: Of the sampled documents one in so many is kept for calibration.
CALIBRATE = 4

#: Signs that stand for letters.
ALIKE = str.maketrans("0134578@$!", "oieastbasi")
SENTENCE = re.compile(r"[.!?\n]+(?=\s|$)|\n")
SPACED = re.compile(r"(?<!\S)\w(?:[ .*_-]\w){2,}(?!\S)")
GAPS = [(0, *rest) for rest in combinations(range(1, SPAN), LENGTH - 1)]


# -- words -------------------------------------------------------------------
def sentences_of(text: str) -> list[list[str]]:
    """The distinct words of each sentence."""
    text = text.lower()
    if SPACED.search(text):
        text = SPACED.sub(lambda m: re.sub(r"[ .*_-]", "", m[0]), text)
    return [list(dict.fromkeys(words[i : i + WORDS])) for s in SENTENCE.split(text) if (words := s.split()) for i in range(0, len(words), WORDS)]


def letter(c: str) -> int:
    """The code point of a letter without case, accent or disguise; 0 for marks, which are left out."""
    base = unicodedata.normalize("NFD", c)[0].lower()[0].translate(ALIKE)
    return ord("s" if base == "ß" else base) if base.isalnum() else 0


#: Of the characters of the first plane; those beyond it stand for themselves. A line feed is a word's start.
LETTERS = np.array([letter(chr(i)) if not 0xD800 <= i < 0xE000 else 0 for i in range(0x10000)], np.uint32)
START = 10
#: Codes of subsequences are sums of powers of this, by place.
POWER = np.uint64(0x9E3779B97F4A7C15)


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all words, each word after its start, and the numbers of the words they are in."""
    points = np.frombuffer("\n".join(["", *words]).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = points == START
    classes = np.where(points < 0x10000, LETTERS[np.minimum(points, 0xFFFF)], points)
    classes[starts] = START
    keep = classes > 0
    return classes[keep].astype(np.uint64), (np.cumsum(starts) - 1)[keep].astype(np.int32)


def occurrences(words: list[str]):
    """For each shape of gaps: (word's number, subsequence, weight) of all its occurrences."""
    c, word = letters(words)
    for gaps in GAPS:
        n = len(c) - gaps[-1]
        if n <= 0:
            continue
        inside = np.flatnonzero(word[:n] == word[gaps[-1] :])
        code = np.zeros(len(inside), np.uint64)
        for g in gaps:
            code = code * POWER + c[inside + g]
        yield word[inside], code, DECAY ** (gaps[-1] + 1)


def folded(words: list[str]) -> list[str]:
    """Words that differ in no letter are one; here by a name for each."""
    c, word = letters(words)
    names = "".join(map(chr, c.tolist()))
    ends = np.searchsorted(word, np.arange(len(words) + 1)).tolist()
    return [names[a + 1 : b] for a, b in zip(ends, ends[1:])]


def norms(words: list[str]) -> np.ndarray:
    """The length of each word, by its number of letters: the root of the sum of its occurrences' squared weights."""
    out = np.zeros(len(words))
    for word, _, weight in occurrences(words):
        out += np.bincount(word, minlength=len(words)) * weight**2
    return np.sqrt(np.maximum(out, 1e-12))


class Table:
    """Numbers by subsequence: sorted codes, and a filter by their upper bits, as most codes that are looked up aren't there."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.shift = codes, np.uint64(64 - 22)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.slot(codes)] = True

    def slot(self, codes: np.ndarray) -> np.ndarray:
        return (codes * POWER) >> self.shift

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the codes are there, their places)."""
        hit = np.flatnonzero(self.maybe[self.slot(codes)])
        at = np.minimum(np.searchsorted(self.codes, codes[hit]), len(self.codes) - 1)
        same = self.codes[at] == codes[hit]
        return hit[same], at[same]


# -- training ----------------------------------------------------------------
@dataclass(eq=False)
class Machine:
    codes: np.ndarray
    weights: np.ndarray  # by code
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def words(self, words: list[str], known: Table | None = None) -> np.ndarray:
        known = known or Table(self.codes)
        total, size = np.zeros(len(words)), np.zeros(len(words))
        for word, code, weight in occurrences(words):
            hit, at = known.find(code)
            total += np.bincount(word[hit], self.weights[at], len(words)) * weight
            size += np.bincount(word, minlength=len(words)) * weight**2
        return total / np.sqrt(np.maximum(size, 1e-12))

    def score(self, highest: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * highest + self.shift, -40, 40)))


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """words x landmarks."""
    own = [(w, c, x) for w, c, x in occurrences(landmarks)]
    known = Table(np.unique(np.concatenate([c for _, c, _ in own])) if own else np.zeros(1, np.uint64))
    at = np.zeros((len(known.codes), len(landmarks)), np.float32)
    for w, c, x in own:
        np.add.at(at, (np.searchsorted(known.codes, c), w), x)
    at /= norms(landmarks)[None, :]
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for lo in range(0, len(words), 4000):
        some = words[lo : lo + 4000]
        part = np.zeros((len(some), len(landmarks)), np.float32)
        for w, c, x in occurrences(some):
            hit, place = known.find(c)
            if len(hit):  # occurrences stand in the order of their words
                w_hit, rows = w[hit], at[place]
                first = np.flatnonzero(np.r_[True, w_hit[1:] != w_hit[:-1]])
                part[w_hit[first]] += np.add.reduceat(rows, first) * np.float32(x)
        out[lo : lo + len(some)] = part / norms(some)[:, None]
    return out


def svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Newton steps on squared hinge loss, of errors by weight; the last entry is the bias. Sums are taken over blocks of rows."""
    n = z.shape[1]
    w = np.zeros(n + 1)
    for _ in range(STEPS):
        h, g = np.diag(np.r_[np.ones(n), 1e-6]), np.zeros(n + 1)
        for lo in range(0, len(z), BLOCK):
            own = np.hstack([z[lo : lo + BLOCK], np.ones((len(z[lo : lo + BLOCK]), 1), np.float32)])
            on = (y[lo : lo + BLOCK] * (own @ w.astype(np.float32)) < 1) & (weight[lo : lo + BLOCK] > 0)
            own, c = own[on], (COST * weight[lo : lo + BLOCK][on]).astype(np.float32)
            h += (own * c[:, None]).T @ own
            g += own.T @ (c * y[lo : lo + BLOCK][on].astype(np.float32))
        new = np.linalg.solve(h, g)
        done = np.abs(new - w).max() < 1e-3
        w = new
        if done:
            break
    return w


class Sentences:
    """The sentences of documents, as numbers of folded words."""

    def __init__(self, texts: list[str]):
        raw, self.of, sizes = [], [], []
        for i, text in enumerate(texts):
            for words in sentences_of(text) or [[""]]:
                raw.append(words)
                self.of.append(i)
                sizes.append(len(words))
        names = folded([w for words in raw for w in words])
        self.vocabulary = sorted(set(names))
        number = {w: i for i, w in enumerate(self.vocabulary)}
        self.words = np.fromiter(map(number.__getitem__, names), np.int64, len(names))
        self.of, self.starts = np.array(self.of), np.cumsum([0, *sizes])[:-1]
        self.first = np.flatnonzero(np.r_[True, self.of[1:] != self.of[:-1]])  # sentence of each document

    def __len__(self) -> int:
        return len(self.of)

    def of_word(self) -> np.ndarray:
        """The sentence of each word."""
        return np.repeat(np.arange(len(self)), np.diff(np.r_[self.starts, len(self.words)]))

    def kernel(self, landmarks: list[str]) -> np.ndarray:
        """sentences x landmarks: sums over the words of each sentence."""
        k = kernel(self.vocabulary, landmarks)
        out = np.zeros((len(self), len(landmarks)), np.float32)
        for lo in range(0, len(self), BLOCK):
            starts = self.starts[lo : lo + BLOCK]
            end = self.starts[lo + BLOCK] if lo + BLOCK < len(self) else len(self.words)
            out[lo : lo + BLOCK] = np.add.reduceat(k[self.words[starts[0] : end]], starts - starts[0])
        return out


def highest_of(f: np.ndarray, s: Sentences) -> tuple[np.ndarray, np.ndarray]:
    """(each document's highest score, whether a sentence is its document's highest)."""
    top = np.maximum.reduceat(f, s.first)
    return top, f == top[s.of]


def train(texts: list[str], toxic: list[int], odds: float | None = None) -> Machine | None:
    """A machine from documents, calibrated on every CALIBRATE-th of each label, which it isn't trained on; odds: clean documents for each toxic one where it is used."""
    label = np.array(toxic, bool)
    if min(label.sum(), (~label).sum()) < LEAST:
        return None
    place = np.where(label, np.cumsum(label), np.cumsum(~label))
    apart = place % CALIBRATE == 0
    if min(label[apart].sum(), (~label[apart]).sum()) < LEAST:
        apart = np.ones(len(label), bool)  # too few: all serve for both
        machine = trained(texts, label)
    else:
        machine = trained([t for t, a in zip(texts, apart) if not a], label[~apart])
    tops, label = Scorer(machine).highest([t for t, a in zip(texts, apart) if a]), label[apart]
    odds = odds or (~label).sum() / label.sum()
    machine.slope, machine.shift = logistic(tops, label, np.where(label, 1.0, odds * label.sum() / (~label).sum()))
    return machine


def trained(texts: list[str], label: np.ndarray) -> Machine:
    """Instances are sentences: those of clean documents are clean; of toxic ones, what the machine finds so. Without calibration."""
    s = Sentences(texts)
    inside = label[s.of]  # sentences of toxic documents
    pairs = np.unique(np.stack([s.words, s.of[s.of_word()]]), axis=1)
    present = [np.bincount(pairs[0][label[pairs[1]] == t], minlength=len(s.vocabulary)) for t in (False, True)]
    n1, n0 = label.sum(), (~label).sum()
    ratio = np.log((present[1] + 0.5) / (n1 + 1)) - np.log((present[0] + 0.5) / (n0 + 1))
    strength = np.where(present[1] >= min(SUPPORT, n1), ratio * np.log1p(present[1]), -np.inf)
    by = lambda key: [s.vocabulary[i] for i in np.argsort(-key, kind="stable")[:LANDMARKS] if np.isfinite(key[i])]
    landmarks = list(dict.fromkeys(by(strength) + by(present[0].astype(float))))
    # At first, the sentences with the most telling word of each toxic document are toxic.
    f = np.maximum.reduceat(np.maximum(strength, -1e9)[s.words], s.starts)
    y = np.where(inside & highest_of(f, s)[1] & (f > 0), 1.0, -1.0)
    k = s.kernel(landmarks)
    for turn in range(ROUNDS):
        among = kernel(landmarks, landmarks).astype(np.float64)
        value, vector = np.linalg.eigh((among + among.T) / 2)
        good = value > RANK * value.max()
        back = vector[:, good] / np.sqrt(value[good])
        z = k @ back.astype(np.float32)
        up = y > 0
        weight = np.where(up, 1 / max(1, up.sum()), np.where(inside, 0, 1 / max(1, (~inside).sum())))
        w = svm(z, y, weight)
        f = z @ w[:-1].astype(np.float32) + w[-1]
        top, highest = highest_of(f, s)
        y = np.where(inside & (highest | (f > 0)), 1.0, -1.0)
        if turn < ROUNDS - 1:  # the words of the clean sentences that are hardest to tell become landmarks as well
            hard = np.argsort(-np.where(inside, -np.inf, f), kind="stable")[: 4 * LANDMARKS]
            common = Counter(int(i) for h in hard for i in s.words[s.starts[h] : s.starts[h + 1] if h + 1 < len(s) else len(s.words)])
            worth = kernel([s.vocabulary[i] for i in common], landmarks) @ (back @ w[:-1]).astype(np.float32)
            score = dict(zip(common, worth.tolist()))
            new = [s.vocabulary[i] for i in sorted(common, key=lambda i: (-score[i], i)) if s.vocabulary[i] not in set(landmarks)][:LANDMARKS]
            if new:
                landmarks += new
                k = np.hstack([k, s.kernel(new)])
        del z
    scale = back @ w[:-1] / norms(landmarks)
    every = [(word, code, x) for word, code, x in occurrences(landmarks)]
    codes = np.unique(np.concatenate([c for _, c, _ in every])) if every else np.zeros(1, np.uint64)
    weights = np.zeros(len(codes))
    for word, code, x in every:
        np.add.at(weights, np.searchsorted(codes, code), scale[word] * x)
    return Machine(codes, weights, float(w[-1]))


def logistic(x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a curve through the labels, with targets drawn in a little from 0 and 1."""
    n1, n0 = weight[label].sum(), weight[~label].sum()
    target = np.where(label, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    unit = x.std() or 1.0
    x = np.stack([x / unit, np.ones(len(x))])

    def loss(v: np.ndarray) -> float:
        f = v @ x
        return float((weight * (np.logaddexp(0, f) - target * f)).sum())

    v = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-v @ x))
        step = np.linalg.solve((x * (weight * p * (1 - p))) @ x.T + 1e-6 * np.eye(2), x @ (weight * (target - p)))
        while loss(v + step) > loss(v) and np.abs(step).max() > 1e-9:  # Newton steps may go too far
            step = step / 2
        v = v + step
    return float(v[0] / unit), float(v[1])


def is_held_out(doc_id: str | Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; a null id is in no fold."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Machine | None:
    """A machine from the first SAMPLE_TOXIC and SAMPLE_CLEAN labelled rows outside the held-out fold, in the order of a hash of their ids, of texts with at most SAMPLE_CHARACTERS."""
    folds = labels.select("doc_id", "toxic").where(~is_held_out("doc_id") & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    lengths = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("_n")).where(F.col("_n") <= SAMPLE_CHARACTERS).select("doc_id").distinct()
    known = cut(folds.join(lengths, "doc_id", "left_semi"))
    counted = dict(known.groupBy("toxic").count().collect())
    ordered = known.orderBy(F.xxhash64("doc_id"), "doc_id")
    some = ordered.where("toxic = 1").limit(SAMPLE_TOXIC).unionByName(ordered.where("toxic = 0").limit(SAMPLE_CLEAN))
    texts = docs.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARACTERS)
    rows = texts.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")).orderBy("doc_id").collect()
    return train([r.text or "" for r in rows], [r.toxic for r in rows], counted.get(0, 0) / max(1, counted.get(1, 0)))


# -- scoring -----------------------------------------------------------------
class Scorer:
    def __init__(self, machine: Machine):
        self.machine, self.table, self.known = machine, Table(machine.codes), {}

    def highest(self, texts: list[str]) -> np.ndarray:
        documents = [sentences_of(t) for t in texts]
        new = {w for d in documents for s in d for w in s}.difference(self.known)
        if len(self.known) + len(new) > MEMO:
            self.known.clear()
            new = {w for d in documents for s in d for w in s}
        if new:
            words = list(new)
            self.known.update(zip(words, self.machine.words(words, self.table).tolist()))
        of = self.known.__getitem__
        return np.array([max((sum(map(of, s)) for s in d), default=0.0) + self.machine.bias for d in documents])

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.machine.score(self.highest(texts))


@lru_cache(1)
def scorer_of(machine: Machine) -> Scorer:
    return Scorer(machine)


def score(df: DataFrame, machine: Machine | None, text: str = "text", out: str = "score") -> DataFrame:
    if machine is None:
        return df.withColumn(out, F.lit(0.0))
    sent = df.sparkSession.sparkContext.broadcast(machine)

    @F.arrow_udf(T.DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        scorer = scorer_of(sent.value)
        out, some, size = [], [], 0
        for x in texts:
            some.append(x.as_py() or "")
            size += len(some[-1])
            if size > CHARACTERS:
                out.append(scorer.scores(some))
                some, size = [], 0
        if some:
            out.append(scorer.scores(some))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return df.withColumn(out, scored(F.col(text)))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs that score below the threshold, by a machine trained on those of them that are labelled and not held out."""
    return score(docs, fit(docs, labels), out="_toxicity").where(F.col("_toxicity") < THRESHOLD).drop("_toxicity")
