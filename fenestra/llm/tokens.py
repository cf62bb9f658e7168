"""Token counts by the whole-token shortcut.

Offline, on the driver, each vocabulary string is put through the merges; those
that end as one token are *whole*. A pre-token that is a whole string counts as
one token without any merging; only the rest are merged, by the model of the
file, each distinct one once while it stays in a bounded memo.

Texts are split as the file says, by its own pre-tokeniser. A file is refused
if it has what isn't handled here: another model than BPE or another split than
that into bytes, a normaliser, dropout, marks in or behind words, bytes as a
fallback, or added tokens that take blanks or whole words only.

Special strings in a text count as one token each, as the library does by
default, and split the text around them. Null and empty texts have no tokens;
a null text has no bytes. Nothing is shuffled; the vocabulary, of bounded size,
is broadcast.
"""

from __future__ import annotations

import json
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from fenestra.llm.bpe import read_vocabulary
from fenestra.llm.common import table, text_or_empty

#: Distinct pre-tokens of a Python worker that are remembered.
MEMO = 200_000
LIMIT = 1024
#: What a model may not have set.
UNHANDLED = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")


def merged(symbols: list[str], order: dict[tuple[str, str], int]) -> list[str]:
    """symbols, after merging the earliest pair of the list, leftmost first, until no pair is in it."""
    while len(symbols) > 1:
        best = min(zip(symbols, symbols[1:]), key=lambda pair: order.get(pair, len(order)))
        if best not in order:
            break
        out, i = [], 0
        while i < len(symbols):
            if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == best:
                out.append(symbols[i] + symbols[i + 1])
                i += 2
            else:
                out.append(symbols[i])
                i += 1
        symbols = out
    return symbols


def prove(vocabulary: bytes) -> tuple[list[str], list[str]]:
    """(whole strings, special strings) of a tokenizers file; a whole string is written in the letters that stand for bytes."""
    file = json.loads(vocabulary)
    model = file["model"]
    wrong = [k for k in UNHANDLED if model.get(k)] + [k for x in file["added_tokens"] for k in ("single_word", "lstrip", "rstrip") if x[k]]
    if file["normalizer"] is not None:
        wrong.append("normalizer")
    if model["type"] != "BPE" or (file["pre_tokenizer"] or {}).get("type") != "ByteLevel":
        wrong.append("model or pre_tokenizer")
    if wrong:
        raise ValueError(f"not handled: {wrong}")
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    order = {pair: i for i, pair in enumerate(pairs)}
    special = [x["content"] for x in file["added_tokens"]]
    return [t for t in model["vocab"] if t not in special and merged([*t], order) == [t]], special


class Rest(dict):
    """Numbers of tokens by pre-token: whole ones are there from the start, others are merged when first seen."""

    def __init__(self, model, whole: list[str]):
        super().__init__(dict.fromkeys(whole, 1))
        self.room, self.merge = len(self) + MEMO, model.tokenize

    def __missing__(self, piece: str) -> int:
        n = len(self.merge(piece))
        if len(self) < self.room:
            self[piece] = n
        return n


@lru_cache(2)
def _counter(proof: bytes):
    vocabulary, whole, special = json.loads(proof)
    library = Tokenizer.from_str(vocabulary)
    rest, pieces = Rest(library.model, whole), library.pre_tokenizer.pre_tokenize_str
    split = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))).split if special else lambda t: [t]

    def count(text: str) -> int:
        parts = split(text)
        return len(parts) - 1 + sum(rest[piece] for part in parts if part for piece, _ in pieces(part))

    return count


@lru_cache(4)
def _proof(path: str) -> bytes:
    vocabulary = read_vocabulary(path)
    return json.dumps([vocabulary.decode(), *prove(vocabulary)]).encode()


def count_tokens(df: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """df with ``out``, the number of tokens of ``text``; path: a file of the tokenizers library with byte-level BPE."""
    sent = df.sparkSession.sparkContext.broadcast(_proof(path))

    @F.arrow_udf(T.LongType())
    def counted(texts: pa.Array) -> pa.Array:
        count = _counter(sent.value)
        return pa.array([count(x.as_py() or "") for x in texts], pa.int64())

    return df.withColumn(out, counted(text_or_empty(text)))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return docs.select("doc_id", F.octet_length(text_or_empty("text")).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
