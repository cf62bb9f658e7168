import functools
import itertools
import math
import random
import zlib

import pytest

from fenestra.llm import toxicity as t

INSULTS = ["stupid", "idiot", "scum", "worthless", "moron", "pathetic"]


def corpus(n, seed):
    rng = random.Random(seed)
    parts = ["th", "er", "an", "re", "in", "on", "ble", "ing", "tion", "ly", "es", "ou", "ha", "st"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    out = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 120))]
        bad = rng.random() < 0.3
        for _ in range(rng.randint(1, 4) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        out.append((i, " ".join(words).capitalize() + ".", int(bad)))
    return out


def test_held_out_accuracy_and_gaps(spark):
    docs = corpus(900, 1)
    df = spark.createDataFrame([(a, b) for a, b, _ in docs], "doc_id long, text string")
    labels = spark.createDataFrame([(a, c) for a, _, c in docs], "doc_id long, toxic int")
    machine = t.fit(df, labels)
    truth = {a: c for a, _, c in docs}
    got = {r.doc_id: r for r in t.score(df, machine).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((got[i].score >= t.THRESHOLD) == (truth[i] == 1) for i in held)
    assert right / len(held) > 0.97
    usual = max(machine.words(["therly", "ingtion", "hastre", "onblees"]))
    assert min(machine.words(["stupid", "st*upid", "s.t.u.p.i.d", "stuupid", "idi0t", "idioot"])) > usual
    for text in ["You are a st-u-p-id one. Other words.", "thing " * 60 + "moron", docs[0][1]]:
        assert abs(t.Scorer(machine).highest([text])[0] - brute_highest(machine, text)) < 1e-3
    assert t.Scorer(machine).scores(["You are s t u p i d."])[0] > 0.5 > t.Scorer(machine).scores(["Therly ingtion."])[0]


def test_labels_of_the_held_out_fold_are_not_used(spark):
    docs = corpus(300, 2)
    df = spark.createDataFrame([(a, b) for a, b, _ in docs], "doc_id long, text string")
    flip = lambda i, c: 1 - c if zlib.crc32(str(i).encode()) % 4 == 2 else c
    one = t.fit(df, spark.createDataFrame([(a, c) for a, _, c in docs], "doc_id long, toxic int"))
    two = t.fit(df, spark.createDataFrame([(a, flip(a, c)) for a, _, c in docs], "doc_id long, toxic int"))
    assert len(one.weights) == len(two.weights) and (one.weights == two.weights).all() and (one.slope, one.shift) == (two.slope, two.shift)


def folded(word):
    return t.folded([word])[0]


def brute_kernel(a, b):
    """Pairs of equal subsequences of two words (each after its start), by dynamic programming over both ends and spans."""
    x, y = "\n" + a, "\n" + b

    @functools.cache
    def pairs(i, j, n, first_i, first_j):  # of n letters, that end at i and j and begin at first_i and first_j
        if x[i] != y[j]:
            return 0
        if n == 1:
            return int(i == first_i and j == first_j)
        return sum(pairs(p, q, n - 1, first_i, first_j) for p in range(first_i, i) for q in range(first_j, j))

    spans = lambda w: [(s, e) for s in range(len(w)) for e in range(s + t.LENGTH - 1, min(len(w), s + t.SPAN))]
    return sum(pairs(e, f, t.LENGTH, s, r) * t.DECAY ** (e - s + 1 + f - r + 1) for s, e in spans(x) for r, f in spans(y))


def length(word):
    """Of a word: every subsequence by itself, as if no two were equal."""
    n = len(word) + 1
    return math.sqrt(sum(math.comb(k - 2, t.LENGTH - 2) * (n - k + 1) * t.DECAY ** (2 * k) for k in range(t.LENGTH, min(n, t.SPAN) + 1))) or 1e-6


def brute_highest(machine, text):
    weight = dict(zip(machine.codes.tolist(), machine.weights.tolist()))

    def worth(word):
        total, w = 0.0, "\n" + folded(word)
        for places in itertools.combinations(range(len(w)), t.LENGTH):
            if places[-1] - places[0] < t.SPAN:
                code = 0
                for i in places:
                    code = (code * int(t.POWER) + ord(w[i])) % 2**64
                total += weight.get(code, 0.0) * t.DECAY ** (places[-1] - places[0] + 1)
        return total / length(folded(word))

    return max((sum(map(worth, set(s))) for s in t.sentences_of(text)), default=0.0) + machine.bias


def test_kernel_by_dynamic_programming():
    words = ["stupid", "studip", "moron", "the", "stxuxpid", "aaaaaaa", "\u0438\u0434\u0438\u043e\u0442", "\u0438\u0434\u0438\u043e\u0442\u043a\u0430", "\u5b57\u5b57\u5b57\u5b57", "ab"]
    k = t.kernel(words, words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert abs(k[i, j] - brute_kernel(a, b) / (length(a) * length(b))) < 1e-4, (a, b)
    assert k[0, 4] > 0.2 and k[6, 7] > 0.3 and k[0, 6] == 0


def test_kernel_of_sentences_is_the_sum_over_pairs_of_words():
    s = t.Sentences(["St\u00fcpid moron, you. The the weather", "", "A moron"])
    assert [s.vocabulary[i] for i in s.words] == ["stupid", "moron", "you", "the", "weather", "", "a", "moron"]
    k = s.kernel(["moron", "stupid"])
    want = [["stupid", "moron", "you"], ["the", "weather"], [""], ["a", "moron"]]
    for i, words in enumerate(want):
        assert abs(k[i] - t.kernel(words, ["moron", "stupid"]).sum(0)).max() < 1e-5


def test_letters_of_all_scripts():
    assert [folded(x) for x in ("\u00c9t\u00e9", "1d!0t", "\u0418\u0434\u0438\u043e\u0442", "s-t.u", "\U0001d538")] == ["ete", "idiot", "\u0438\u0434\u0438\u043e\u0442", "stu", "\U0001d538"]


@pytest.mark.parametrize("scale, found, rejected", [("0.01", 0.35, 0.05), ("0.1", 0.72, 0.03)])
def test_held_out_labels_of_the_tables(spark, scale, found, rejected):
    """Measured: 6 of 14 found, 1 of 80 rejected; 94 of 120 found, 8 of 870 rejected."""
    d = f"/root/testdata/sf{scale}"
    rows = t.op9_toxicity(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    share = lambda label: sum(r.predicted for r in rows if r.toxic == label) / sum(r.toxic == label for r in rows)
    assert share(1) >= found and share(0) <= rejected
