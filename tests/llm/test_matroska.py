import hashlib
import random
import zlib

import pytest

from fenestra.llm import matroska as m


@pytest.mark.parametrize("n", [0, 1, 64, 1024, 1025, 8192, 8193, 131072, 300000])
def test_round_trip(n):
    data = random.Random(n).randbytes(n)
    error, cues, packets = m.parse_bytes(m.mux_bytes(data))
    file = m.mux_bytes(data)
    assert error is None and b"".join(file[p[3] : p[3] + p[4]] for p in packets) == data
    assert [p[2] for p in packets] == [i * 128 * 10**6 for i in range(len(packets))] and all(p[7] for p in packets)
    assert cues == -(-n // (1024 * 8 * 16))


@pytest.mark.parametrize("kind", ["xiph", "ebml"])
def test_lacings(kind):
    rng = random.Random(2)
    frames = [rng.randbytes(k) for k in (3, 300, 255, 510, 0, 70000, 5)]
    body = b"\x81\x00\x00" + bytes([m.LACINGS.index(kind) << 1]) + m.lace_sizes([len(f) for f in frames], kind) + b"".join(frames)
    assert [body[o : o + k] for o, k in m.frames_of(body, 0, len(body))[3]] == frames


def test_unknown_sizes_groups_and_broken_files():
    unknown = b"\x01" + b"\xff" * 7
    group = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, b"\x81\x00\x05\x00abc") + m.number(m.REFERENCE_BLOCK, 1))
    file = m.HEADER + m.SEGMENT.to_bytes(4, "big") + unknown + m.ABOUT + m.CLUSTER.to_bytes(4, "big") + unknown + m.number(m.TIMESTAMP, 7) + group
    file += m.element(m.CLUSTER, m.number(m.TIMESTAMP, 9) + m.element(m.SIMPLE_BLOCK, b"\x81\x00\x00\x80xyz"))
    error, _, packets = m.parse_bytes(file)
    assert error is None and [(file[p[3] : p[3] + p[4]], p[1], p[2], p[5]) for p in packets] == [(b"abc", 0, 12 * 10**6, False), (b"xyz", 1, 9 * 10**6, True)]
    whole = m.mux_bytes(b"q" * 40000)
    for cut in range(0, len(whole), 997):
        m.parse_bytes(whole[:cut])
    assert m.parse_bytes(b"junk")[0] and m.parse_bytes(b"")[0]


def test_query(spark, sf):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in m.op2_matroska(spark, sf).collect():
        data = docs[r.doc_id]
        payload = data + b"\0" * (-len(data) % 64 if data else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_sha256 == hashlib.sha256(m.mux_bytes(payload)).hexdigest()


def test_packet_table(spark):
    df = spark.createDataFrame([(1, bytearray(m.mux_bytes(b"a" * 3000))), (2, None), (3, bytearray(b"no"))], "k long, media binary")
    rows = m.packet_table(df, ["k"]).orderBy("packet").collect()
    assert [(r.k, r.packet, r.length, r.timestamp) for r in rows] == [(1, 0, 1024, 0), (1, 1, 1024, 128000000), (1, 2, 952, 256000000)]
