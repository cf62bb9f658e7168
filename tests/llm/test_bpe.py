import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from fenestra.llm import bpe, tokens

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TINY = bpe.TreeBPE(open(P.path("byte_bpe_50k.tiktoken"), "rb").read(), P.PATTERN, leaf=6, piece=4)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from([*"abtheing'sdl 12!\n\t字é  "]), max_size=80))
def test_tree_encodes_as_the_library(text):
    ids = TINY.encode(text)
    assert ids == LIBRARY.encode_ordinary(text)
    assert TINY.decode(ids) == text.encode()


def test_long_pre_tokens():
    rng = random.Random(1)
    for _ in range(300):
        piece = bytes(rng.choice(b"abcdeth\xc3\xa9") for _ in range(rng.randint(1, 200)))
        assert TINY.encode_piece(piece) == LIBRARY._core_bpe.encode_single_piece(piece)
    text = "a" * 5000 + "the" * 3000 + " " * 4000 + "字" * 3000
    whole = bpe.TreeBPE(open(P.path("byte_bpe_50k.tiktoken"), "rb").read(), P.PATTERN)
    assert whole.encode(text) == LIBRARY.encode_ordinary(text)


def test_query_against_the_library(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in bpe.op1_byte_bpe(spark, sf).collect():
        ids = LIBRARY.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_whole_tokens_and_counts(spark, sf):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in tokens.op7_token_counts(spark, sf).collect():
        n = len(library.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(docs[r.doc_id].encode()), n > 1024)
    count = tokens._counter(tokens._proof(P.path("byte_bpe_50k.json")))
    for text in ["", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", " 　\n\u0085 x"]:
        assert count(text) == len(library.encode(text, add_special_tokens=False).ids)


POINTS = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]


def agree(text, count, library):
    return TINY.encode(text) == LIBRARY.encode_ordinary(text) and count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_all_code_points_and_random_texts():
    from tokenizers import Tokenizer

    library, count, rng = Tokenizer.from_file(P.path("byte_bpe_50k.json")), tokens._counter(tokens._proof(P.path("byte_bpe_50k.json"))), random.Random(1)
    for i in range(0, len(POINTS), 40):
        text = "".join(c + rng.choice(["a", "", " ", "1"]) for c in POINTS[i : i + 40])
        assert agree(text, count, library), i
    usual = [*"abtheing'sdl 12!\n\t\u00e9\u5b57\u3000\u0085\U0001d7ce\u1c90"]
    for i in range(10000):
        text = "".join(rng.choice(rng.choice([usual, POINTS])) for _ in range(rng.randint(0, rng.choice([5, 40, 400]))))
        assert agree(text, count, library), text
    whole = bpe.TreeBPE(open(P.path("byte_bpe_50k.tiktoken"), "rb").read(), P.PATTERN)
    for i in range(40):  # long ones without hard boundaries
        text = "".join(rng.choice(rng.choice([usual[:15], POINTS])) for _ in range(6000)).translate({32: None, 9: None, 10: None})
        assert whole.encode(text) == LIBRARY.encode_ordinary(text)


SCRIPTS = {
    "Chinese": ("天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏", "，。、！？"),
    "Thai": ("กขคงจฉชซญดตถทนบปผพฟมยรลวสหอ", "ิีึืุู่้"),
    "English": ("etaoinshrdlu", [" ", " ", ", ", ". "]),
    "Korean": ("가나다라마바사아자차카타파하", [" ", " ", ". "]),
    "code": ("abcxyz", ["(", ");\n", "_", " = ", "+"]),
    "one sign in the middle": ("天地玄黄", None),
}


@pytest.mark.parametrize("script", SCRIPTS)
def test_no_text_is_encoded_twice_over(script):
    letters, marks = SCRIPTS[script]
    rng = random.Random(len(script))
    if marks:
        text = "".join(rng.choice(letters) if rng.random() < 0.8 else rng.choice(marks) for _ in range(100_000))
    else:  # an end without signs, a long run before and behind
        text = "".join(rng.choice(letters) for _ in range(30_000)) + "，a" + "".join(rng.choice(letters) for _ in range(50_000))
    whole = bpe.TreeBPE(open(P.path("byte_bpe_50k.tiktoken"), "rb").read(), P.PATTERN)
    assert whole.encode(text) == LIBRARY.encode_ordinary(text)
    assert len(text) <= whole.encoded <= 2 * len(text if marks else text.encode())


def test_unhandled_files_are_refused():
    import json

    file = json.loads(open(P.path("byte_bpe_50k.json")).read())
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"added_tokens": [{**file["added_tokens"][0], "lstrip": True}]}, {"model": {**file["model"], "byte_fallback": True}}):
        with pytest.raises(ValueError):
            tokens.prove(json.dumps({**file, **change}).encode())


def test_vocabulary_limit(tmp_path, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_VOCABULARY_BYTES", 3)
    (tmp_path / "v").write_bytes(b"12345")
    with pytest.raises(ValueError):
        bpe.read_vocabulary(str(tmp_path / "v"))
