import hashlib
import struct
import zlib

import pytest

from lexmill.llm import media as M


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 192 * 12, 192 * 12 + 1, 192 * 32, 192 * 33, 192 * 100 + 5])
def test_round_trip_and_tables(n):
    text = "aé€x"[: max(0, n)] * (n // 4 + 1) if n else ""
    payload, size = M.padded(text)
    assert size == len(text.encode()) and len(payload) % 192 == 0 and payload[:size] == text.encode()
    data = M.wrap(payload)
    assert M.read_payload(data) == payload
    d = M.describe(data)
    frames = len(payload) // 192
    assert d["error"] is None and d["codec"] == "raw " and d["samples"] == d["duration"] == frames
    assert len(d["key_offsets"]) == -(-frames // M.GOP)
    for i, (at, k) in enumerate(zip(d["key_offsets"], d["key_sizes"], strict=True)):
        assert data[at : at + k] == payload[i * M.GOP * 192 : i * M.GOP * 192 + 192]


def test_other_containers():
    """Variable sample sizes, 32-bit chunk offsets out of order, no sync table, moov after mdat."""
    samples = [b"aa", b"b", b"cccc", b"dd"]
    mdat = M._box(b"mdat", samples[2] + samples[3] + samples[0] + samples[1])
    ftyp = M._box(b"ftyp", b"isom", bytes(4))
    base = len(ftyp) + 8
    stbl = M._box(
        b"stbl",
        M._full(b"stsd", struct.pack(">I", 1), M._box(b"mp4a", bytes(28))),
        M._full(b"stts", struct.pack(">IIIII", 2, 1, 10, 3, 5)),
        M._full(b"stsc", struct.pack(">IIII", 1, 1, 2, 1)),
        M._full(b"stsz", struct.pack(">II4I", 0, 4, *map(len, samples))),
        M._full(b"stco", struct.pack(">III", 2, base + 6, base)),
    )
    mdhd = M._full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 100, 25, 0, 0))
    data = ftyp + mdat + M._box(b"moov", M._box(b"trak", M._box(b"mdia", mdhd, M._box(b"minf", stbl))))
    d = M.describe(data)
    assert (d["codec"], d["timescale"], d["duration"], d["error"]) == ("mp4a", 100, 25, None)
    assert d["key_offsets"].tolist() == [base + 6, base + 8, base, base + 4]
    assert M.read_payload(data) == b"".join(samples)


def test_damage_is_told_not_raised():
    data = M.wrap(M.padded("x" * 5000)[0])
    assert M.describe(None)["error"] == "null"
    assert M.describe(b"")["error"]
    for cut in (3, 20, 200, 500, len(data) - 1):
        assert M.describe(data[:cut])["error"]
    for i in range(0, 700, 7):
        M.describe(data[:i] + bytes([data[i] ^ 255]) + data[i + 1 :])


def test_columns(spark):
    rows = [(1, "abc", "x"), (2, None, "y"), (3, "", "z"), (4, "é" * 70000, "z"), (4, "é" * 70000, "z"), (None, "abc", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = M.digest_media(M.wrap_texts(docs)).collect()
    assert len(got) == 6
    by_text = {name: text for name, text, _ in rows}
    for r in got:
        data = (by_text[r.doc_id] or "").encode()
        payload = data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data))
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
    assert len({(r.media_sha256, r.feature) for r in got}) == 3
    described = {r.doc_id: r for r in M.describe_media(M.wrap_texts(docs)).collect()}
    assert described[1].codec == "raw " and described[4].samples == -(-140000 // 192)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert M.digest_media(M.wrap_texts(empty)).count() == 0
