"""Media columns: Matroska files in a binary column, and their packets.

``mux`` stores 8-bit samples as an audio track (PCM, 8 bits, mono) in laced
SimpleBlocks of timed clusters, with cues; ``parse`` reads any Matroska bytes,
element by element: variable-length identifiers and sizes, clusters of known
or unknown size, SimpleBlocks and BlockGroups, the three kinds of lacing, and
cues. It returns a packet array (track, cluster, timestamp in ns, byte range,
key-frame flag, lacing, whether the cluster has a cue); ``packet_table``
explodes it; ``read`` gathers the bytes of the ranges.

Defined results: null media has no packets and null payload; bytes that break
off or are not Matroska give the packets before the break and ``error`` says
what was met. Null or empty payload muxes to a file with no packets. Equal
payloads give equal files. All state is in the row, so nothing is shuffled.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fenestra.llm.common import table, text_or_empty

# Element identifiers of the format.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, SEEK_HEAD, INFO, TIMESTAMP_SCALE, MUXING_APP, WRITING_APP = 0x18538067, 0x114D9B74, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, DEFAULT_DURATION, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x23E383, 0x86
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TAGS, CHAPTERS, ATTACHMENTS = 0x1254C367, 0x1043A770, 0x1941A469
TOP_LEVEL = {SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, TAGS, CHAPTERS, ATTACHMENTS}

#: Samples a second, samples of a packet (128 ms), packets of a block, blocks of a cluster (16,384 ms: block times have 16 bits).
RATE, PACKET, LACE, BLOCKS = 8000, 1024, 8, 16
MS = 1_000_000
PACKET_MS = PACKET * 1000 // RATE
LACINGS = ("none", "xiph", "fixed", "ebml")

PACKETS = T.StructType(
    [
        T.StructField("error", T.StringType()),
        T.StructField("cues", T.IntegerType()),
        T.StructField(
            "packets",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("track", T.IntegerType()),
                        T.StructField("cluster", T.IntegerType()),
                        T.StructField("timestamp", T.LongType()),
                        T.StructField("offset", T.LongType()),
                        T.StructField("length", T.LongType()),
                        T.StructField("key", T.BooleanType()),
                        T.StructField("lacing", T.StringType()),
                        T.StructField("cued", T.BooleanType()),
                    ]
                )
            ),
        ),
    ]
)


# -- writing -----------------------------------------------------------------
def vint(value: int, width: int = 0) -> bytes:
    """A size; all value bits set is kept for unknown sizes, so such a value takes a byte more."""
    width = width or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


HEADER = element(
    EBML,
    number(EBML_VERSION, 1) + number(EBML_READ_VERSION, 1) + number(EBML_MAX_ID, 4) + number(EBML_MAX_SIZE, 8)
    + element(DOC_TYPE, b"matroska") + number(DOC_TYPE_VERSION, 4) + number(DOC_TYPE_READ_VERSION, 2),
)
ABOUT = element(INFO, number(TIMESTAMP_SCALE, MS) + element(MUXING_APP, b"fenestra") + element(WRITING_APP, b"fenestra")) + element(
    TRACKS,
    element(
        TRACK_ENTRY,
        number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(FLAG_LACING, 1) + number(DEFAULT_DURATION, PACKET_MS * MS)
        + element(CODEC_ID, b"A_PCM/INT/LIT")
        + element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8)),
    ),
)


def lace_sizes(sizes: list[int], kind: str) -> bytes:
    """What stands before the frames of a block: their number less one, and all sizes but the last."""
    head = bytes([len(sizes) - 1])
    if kind == "xiph":
        return head + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    if kind == "ebml":
        out = head + vint(sizes[0])
        for before, n in zip(sizes, sizes[1:-1]):
            step = n - before
            width = next(k for k in range(1, 9) if abs(step) < (1 << 7 * k - 1) - 1)
            out += vint(step + (1 << 7 * width - 1) - 1, width)
        return out
    return head


def block(frames: list[bytes], at: int, index: int) -> bytes:
    """A SimpleBlock; frames of one size are laced as such, others by the two other kinds in turn."""
    sizes = [len(x) for x in frames]
    kind = "none" if len(frames) == 1 else "fixed" if len({*sizes}) == 1 else ("ebml", "xiph")[index % 2]
    flags = 0x80 | LACINGS.index(kind) << 1
    return element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", at, flags) + (b"" if kind == "none" else lace_sizes(sizes, kind)) + b"".join(frames))


def mux_bytes(payload: bytes) -> bytes:
    frames = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    blocks = [frames[i : i + LACE] for i in range(0, len(frames), LACE)]
    body, cues = [ABOUT], []
    position = len(ABOUT)
    for first in range(0, len(blocks), BLOCKS):
        start = first * LACE * PACKET_MS
        own = blocks[first : first + BLOCKS]
        cluster = element(CLUSTER, number(TIMESTAMP, start) + b"".join(block(x, i * LACE * PACKET_MS, first + i) for i, x in enumerate(own)))
        cues.append(element(CUE_POINT, number(CUE_TIME, start) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER_POSITION, position))))
        body.append(cluster)
        position += len(cluster)
    if cues:
        body.append(element(CUES, b"".join(cues)))
    return HEADER + element(SEGMENT, b"".join(body))


# -- reading -----------------------------------------------------------------
def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int]:
    """(value, place behind it); -1 for an unknown size."""
    width = 9 - data[at].bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError(f"broken length at byte {at}")
    value = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return value, at + width
    value &= (1 << 7 * width) - 1
    return (-1 if value == (1 << 7 * width) - 1 else value), at + width


def elements(data: bytes, at: int, end: int, stop: frozenset[int] | set[int] = frozenset()):
    """(identifier, start, body's start, body's end) of the elements in a range; one of unknown size ends with the range or before an element that can't be inside it."""
    while at < end:
        start = at
        ident, at = read_vint(data, at, keep_marker=True)
        if ident in stop:
            return
        size, at = read_vint(data, at)
        if size < 0:
            stop_at = end
            if ident == CLUSTER:
                stop_at = max((e for *_, e in elements(data, at, end, TOP_LEVEL)), default=at)
            yield ident, start, at, stop_at
            at = stop_at
            continue
        if at + size > end:
            raise ValueError(f"element at byte {start} is longer than what holds it")
        yield ident, start, at, at + size
        at += size


def uint(data: bytes, start: int, end: int) -> int:
    return int.from_bytes(data[start:end], "big")


def frames_of(data: bytes, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Track, relative time, flags and byte ranges of a block."""
    track, at = read_vint(data, at)
    if at + 3 > end:
        raise ValueError(f"broken block before byte {end}")
    time, flags = struct.unpack_from(">hB", data, at)
    at += 3
    kind = LACINGS[flags >> 1 & 3]
    if kind == "none":
        return track, time, flags, [(at, end - at)]
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == "xiph":
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif kind == "ebml" and n > 1:
        size, at = read_vint(data, at)
        sizes.append(size)
        for _ in range(n - 2):
            before = at
            step, at = read_vint(data, at)
            sizes.append(sizes[-1] + step - ((1 << 7 * (at - before) - 1) - 1))
    elif kind == "fixed":
        sizes = [(end - at) // n] * (n - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"lacing is longer than the block before byte {end}")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return track, time, flags, out


def parse_bytes(data: bytes) -> tuple[str | None, int, list[tuple]]:
    """(error, number of cues, packets)."""
    packets: list[tuple] = []
    cued: set[int] = set()
    clusters: list[int] = []
    error = None
    try:
        top = list(elements(data, 0, len(data)))
        if not top or top[0][0] != EBML:
            raise ValueError("no EBML header")
        for ident, _, segment, segment_end in top:
            if ident != SEGMENT:
                continue
            scale, durations = MS, {}
            for kind, start, body, end in elements(data, segment, segment_end):
                if kind == INFO:
                    scale = next((uint(data, b, e) for k, _, b, e in elements(data, body, end) if k == TIMESTAMP_SCALE), scale)
                elif kind == TRACKS:
                    for k, _, b, e in elements(data, body, end):
                        if k == TRACK_ENTRY:
                            own = {x: uint(data, y, z) for x, _, y, z in elements(data, b, e) if x in (TRACK_NUMBER, DEFAULT_DURATION)}
                            durations[own.get(TRACK_NUMBER, 0)] = own.get(DEFAULT_DURATION, 0)
                elif kind == CUES:
                    for k, _, b, e in elements(data, body, end):
                        for x, _, y, z in elements(data, b, e) if k == CUE_POINT else ():
                            if x == CUE_TRACK_POSITIONS:
                                cued |= {segment + uint(data, q, r) for p, _, q, r in elements(data, y, z) if p == CUE_CLUSTER_POSITION}
                elif kind == CLUSTER:
                    base = 0
                    clusters.append(start)
                    for k, _, b, e in elements(data, body, end):
                        if k == TIMESTAMP:
                            base = uint(data, b, e)
                            continue
                        key = None
                        if k == BLOCK_GROUP:
                            inner = list(elements(data, b, e))
                            key = all(x != REFERENCE_BLOCK for x, *_ in inner)
                            found = [(y, z) for x, _, y, z in inner if x == BLOCK]
                        else:
                            found = [(b, e)] if k == SIMPLE_BLOCK else []
                        for y, z in found:
                            track, time, flags, ranges = frames_of(data, y, z)
                            at = (base + time) * scale
                            for i, (offset, length) in enumerate(ranges):
                                packets.append((track, len(clusters) - 1, at + i * durations.get(track, 0), offset, length, bool(flags & 0x80) if key is None else key, LACINGS[flags >> 1 & 3]))
    except (ValueError, IndexError) as e:
        error = str(e)
    return error, len(cued), [(*p, clusters[p[1]] in cued) for p in packets]


# -- columns -----------------------------------------------------------------
@F.arrow_udf(T.BinaryType())
def muxed(payloads: pa.Array) -> pa.Array:
    return pa.array([mux_bytes(x.as_py() or b"") for x in payloads], pa.binary())


@F.arrow_udf(PACKETS)
def parsed(media: pa.Array) -> pa.Array:
    rows = [parse_bytes(x.as_py()) if x.is_valid else (None, 0, []) for x in media]
    flat = [p for _, _, packets in rows for p in packets]
    columns = [*zip(*flat)] if flat else [()] * 8
    fields = [(f.name, pa.array(c, t)) for f, c, t in zip(PACKETS["packets"].dataType.elementType, columns, [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.bool_()])]
    ends = np.cumsum([0, *(len(p) for _, _, p in rows)]).astype(np.int32)
    packets = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([a for _, a in fields], [n for n, _ in fields]))
    return pa.StructArray.from_arrays([pa.array([e for e, _, _ in rows], pa.string()), pa.array([c for _, c, _ in rows], pa.int32()), packets], ["error", "cues", "packets"])


@F.arrow_udf(T.BinaryType())
def gathered(media: pa.Array, packets: pa.Array) -> pa.Array:
    out = []
    for data, own in zip(media, packets):
        if not data.is_valid:
            out.append(None)
            continue
        data = data.as_buffer().to_pybytes()
        ranges = zip(own.values.field("offset").to_pylist(), own.values.field("length").to_pylist()) if own.is_valid else ()
        out.append(b"".join(data[o : o + n] for o, n in ranges))
    return pa.array(out, pa.binary())


@F.arrow_udf(T.StringType())
def described(payloads: pa.Array) -> pa.Array:
    """Of the samples about their middle: sum, sum of squares, zero crossings, largest step."""
    out = []
    for x in payloads:
        v = np.frombuffer(x.as_buffer(), np.uint8).astype(np.int64) - 128 if x.is_valid and len(x.as_py()) else np.zeros(0, np.int64)
        out.append(f"sum={v.sum()};squares={(v * v).sum()};crossings={np.count_nonzero((v[1:] < 0) != (v[:-1] < 0))};step={np.abs(np.diff(v)).max(initial=0)}")
    return pa.array(out, pa.string())


def mux(df: DataFrame, payload: str = "payload", out: str = "media") -> DataFrame:
    return df.withColumn(out, muxed(F.col(payload)))


def parse(df: DataFrame, media: str = "media", out: str = "parsed") -> DataFrame:
    return df.withColumn(out, parsed(F.col(media)))


def packet_table(df: DataFrame, keys: list[str], media: str = "media") -> DataFrame:
    """A row for each packet: keys, packet (its number in the file), and the packet's columns."""
    rows = parse(df.select(*keys, media), media, "_parsed").select(*keys, F.posexplode("_parsed.packets").alias("packet", "_p"))
    return rows.select(*keys, "packet", "_p.*")


def read(df: DataFrame, media: str = "media", packets: Column | str = "parsed.packets", out: str = "read") -> DataFrame:
    return df.withColumn(out, gathered(F.col(media), F.col(packets) if isinstance(packets, str) else packets))


def padded(text: Column) -> Column:
    """The bytes of a text, and bytes 0 up to a positive multiple of 64."""
    data = F.encode(text, "UTF-8")
    n = F.octet_length(text)
    fill = F.when(n == 0, 64).otherwise(F.pmod(-n, F.lit(64)))
    return F.concat(data, F.substring(F.unhex(F.lit("00" * 64)), F.lit(1), fill))


def op2_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = text_or_empty("text")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), padded(text).alias("payload"))
    stored = read(parse(mux(docs)))
    got, p = F.col("read"), F.col("parsed.packets")
    last = F.element_at(p, -1)
    return stored.select(
        "doc_id",
        "n_bytes",
        F.octet_length(got).cast("long").alias("payload_bytes"),
        F.sha2(got, 256).alias("payload_sha256"),
        F.crc32(F.substring(got, -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(
            ";",
            F.format_string("packets=%d", F.size(p)),
            F.format_string("clusters=%d", last["cluster"] + 1),
            F.format_string("cues=%d", F.col("parsed.cues")),
            F.format_string("last_ns=%d", last["timestamp"]),
            F.concat(F.lit("lacing="), F.array_join(F.array_distinct(p["lacing"]), "+")),
            described(got),
        ).alias("feature"),
    )
