"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is cut in halves down to leaves of ``leaf`` characters. Leaves are
encoded alone; two neighbours are joined by encoding anew a window around the
cut, which grows until the tokens outside it provably cannot change:

* between characters, the window ends at *hard* boundaries, where a visible
  character is followed by white space, or a letter by a mark or a sign that is
  no letter, number or apostrophe. No pre-token contains such a pair, and where
  a pre-token starts depends only on what follows, so both sides of a hard
  boundary are split, and encoded, alone. Such pairs are frequent in any script;
  where a window would be longer than a leaf all the same, the cut moves to its
  end, where nothing has to be encoded anew, and a span without any such pair is
  not cut between characters. So no text is encoded twice over;
* inside one over-long pre-token of characters that all libraries class alike, halves of its bytes are encoded, and the
  window of tokens around the cut is encoded anew. A token sequence is the
  encoding of its bytes exactly if each adjacent pair is the encoding of that
  pair's bytes, so it is enough that the pairs at both ends of the window hold;
  otherwise the window doubles.

Joining is associative, so any tree gives the same tokens. Decoding
concatenates bytes up the same kind of tree.

Defined results: null text encodes to no tokens and decodes to no bytes, as
does empty text; null ids decode to no bytes. Rows that repeat are each
encoded. Columns other than the one named are passed through.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fenestra.llm.common import table, text_or_empty

#: Characters of a leaf; bytes of a leaf inside one pre-token; tokens of the first window there.
LEAF, PIECE, WINDOW = 512, 256, 4
#: Tokens of a leaf in decoding.
DECODE_LEAF = 8192
#: A vocabulary file is broadcast; it may not be larger.
MAX_VOCABULARY_BYTES = 64 << 20


class TreeBPE:
    """The monoid: ids of spans, and how neighbours join."""

    def __init__(self, ranks: bytes, pattern: str, leaf: int = LEAF, piece: int = PIECE):
        pairs = (line.split() for line in ranks.splitlines() if line)
        table_ = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table_, special_tokens={})._core_bpe
        self.pre_token = regex.compile(pattern)
        # Libraries differ in which letters and numbers they know; of these characters all say the same.
        self.plain = regex.compile("[\\t\\n\\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*+")
        # Both characters are read alike by every regex library: visible ones and blanks; letters and signs or marks (of CJK and Thai as well).
        letter = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff\u0e01-\u0e30\u0e40-\u0e46\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
        sign = "!-&(-/:-@\\[-`{-~\u0e31\u0e34-\u0e3a\u0e47-\u0e4e\u3001\u3002\u300a-\u3011\uff01\uff08\uff09\uff0c\uff1a\uff1b\uff1f"
        hard = rf"(?:[!-~\p{{L}}][ \n\t]|[{letter}][{sign}])"
        self.hard, self.hard_back = regex.compile(hard), regex.compile(f"(?r){hard}")
        self.leaf, self.piece, self.encoded = leaf, piece, 0
        self.pair_holds = lru_cache(1 << 16)(self._pair_holds)

    # -- text ---------------------------------------------------------------
    def encode(self, text: str) -> list[int]:
        return self._tree(text, 0, len(text))

    def _library(self, text: str) -> list[int]:
        self.encoded += len(text)
        return self.core.encode_ordinary(text)

    def _tree(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf:
            return self._library(text[lo:hi])
        mid = (lo + hi) // 2
        start, end = self._before(text, lo, mid), self._after(text, mid, hi)
        if end - start > self.leaf:
            cut = start if start > lo else end
            return self._span(text[lo:hi]) if cut == hi else self._tree(text, lo, cut) + self._tree(text, cut, hi)
        left, right = self._tree(text, lo, mid), self._tree(text, mid, hi)
        drop, skip = len(self._span(text[start:mid])), len(self._span(text[mid:end]))
        return left[: len(left) - drop] + self._span(text[start:end]) + right[skip:]

    def _before(self, text: str, lo: int, mid: int) -> int:
        """The last hard boundary of the left part; lo if it has none."""
        width = 64
        while True:
            if found := self.hard_back.search(text, max(lo, mid - width), mid):
                return found.start() + 1
            if width >= mid - lo:
                return lo
            width *= 2

    def _after(self, text: str, mid: int, hi: int) -> int:
        width = 64
        while True:
            if found := self.hard.search(text, mid, min(hi, mid + width)):
                return found.start() + 1
            if width >= hi - mid:
                return hi
            width *= 2

    def _span(self, text: str) -> list[int]:
        """A span between boundaries; a long one is one with hardly any white space. The library splits it, unless it is long and there is no doubt where."""
        if len(text) <= self.leaf or not self.plain.fullmatch(text):
            return self._library(text)
        return [i for m in self.pre_token.finditer(text) for i in self.encode_piece(m[0].encode())]

    # -- one pre-token ------------------------------------------------------
    def encode_piece(self, piece: bytes) -> list[int]:
        if len(piece) <= self.piece:
            return self._single(piece)
        mid = len(piece) // 2
        return self._join(self.encode_piece(piece[:mid]), self.encode_piece(piece[mid:]))

    def _single(self, piece: bytes) -> list[int]:
        self.encoded += len(piece)
        return self.core.encode_single_piece(piece)

    def _join(self, left: list[int], right: list[int]) -> list[int]:
        width = WINDOW
        while True:
            keep, skip = max(0, len(left) - width), min(len(right), width)
            window = self._single(self.core.decode_bytes(left[keep:] + right[:skip]))
            if (keep == 0 or self.pair_holds(left[keep - 1], window[0])) and (skip == len(right) or self.pair_holds(window[-1], right[skip])):
                return left[:keep] + window + right[skip:]
            width *= 2

    def _pair_holds(self, a: int, b: int) -> bool:
        return self.core.encode_single_piece(self.core.decode_bytes([a, b])) == [a, b]

    # -- back ---------------------------------------------------------------
    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= DECODE_LEAF:
            return self.core.decode_bytes(ids)
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


@lru_cache(4)
def _codec(ranks: bytes, pattern: str) -> TreeBPE:
    return TreeBPE(ranks, pattern)


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as file:
        data = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return data


def _shared(spark: SparkSession, path: str, pattern: str):
    sent = spark.sparkContext.broadcast(read_vocabulary(path))
    return lambda: _codec(sent.value, pattern)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with ``out``, the token ids of ``text``; path: a file of base64 tokens and ranks."""
    codec = _shared(df.sparkSession, path, pattern)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pa.Array) -> pa.Array:
        code, rows = codec().encode, []
        for x in texts:
            rows.append(np.array(code(x.as_py() or ""), dtype=np.int32))
        ends = np.cumsum([0, *map(len, rows)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *rows]), pa.int32()))

    return df.withColumn(out, ids(text_or_empty(text)))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with ``out``, the bytes that ``ids`` stand for."""
    codec = _shared(df.sparkSession, path, pattern)

    @F.arrow_udf(T.BinaryType())
    def decoded(lists: pa.Array) -> pa.Array:
        back = codec().decode
        return pa.array([back(x.values.to_numpy().tolist()) if x.is_valid else b"" for x in lists], pa.binary())

    return df.withColumn(out, decoded(F.col(ids)))


def digests(df: DataFrame) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 from ids and decoded."""
    return df.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def apply(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    import public_tokenizers

    path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    return digests(decode(encode(docs.select("doc_id", "text"), path, pattern), path, pattern))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(table(spark, sf_dir, "documents"))
