"""Containers of several tracks, compact sizes, fragments, and damage that asks for memory."""

import random
import struct

import numpy as np

from lexmill.llm import media as M


def track(number: int, handler: bytes, codec: bytes, tables: bytes) -> bytes:
    mdhd = M._full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 100, 0, 0, 0))
    tkhd = M._full(b"tkhd", struct.pack(">III", 0, 0, number), bytes(68))
    stsd = M._full(b"stsd", struct.pack(">I", 1), M._box(codec, bytes(28)))
    return M._box(b"trak", tkhd, M._box(b"mdia", mdhd, M._full(b"hdlr", bytes(4), handler, bytes(13)), M._box(b"minf", M._box(b"stbl", stsd, tables))))


def tables(sizes: list[int], at: int, keys: list[int] | None = None, bits: int = 32) -> bytes:
    if bits == 4:
        packed = bytes((a << 4) | b for a, b in zip(sizes[::2], [*sizes[1::2], 0], strict=False))
    else:
        packed = np.array(sizes, f">u{bits // 8}").tobytes()
    size = M._full(b"stsz", struct.pack(">II", 0, len(sizes)), packed) if bits == 32 else M._full(b"stz2", bytes(3), bytes([bits]), struct.pack(">I", len(sizes)), packed)
    return b"".join([
        M._full(b"stts", struct.pack(">III", 1, len(sizes), 4)), M._full(b"stsc", struct.pack(">IIII", 1, 1, len(sizes), 1)), size,
        M._full(b"stco", struct.pack(">II", 1, at)), M._full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)) if keys is not None else b"",
    ])


def test_video_comes_before_audio_and_sizes_may_be_compact():
    body = bytes(range(100))
    for bits in (4, 8, 16, 32):
        sizes = [3, 9, 1, 15, 2]
        mdat = M._box(b"mdat", body)
        data = mdat + M._box(b"moov", track(1, b"soun", b"mp4a", tables([5, 5], 8)), track(2, b"vide", b"avc1", tables(sizes, 20, [1, 4], bits)))
        every = M.tracks(data)
        assert [(t["handler"], t["codec"]) for t in every] == [("soun", "mp4a"), ("vide", "avc1")]
        d = M.describe(data)
        assert (d["codec"], d["samples"], d["duration"]) == ("avc1", 5, 20)
        assert list(zip(d["key_offsets"].tolist(), d["key_sizes"].tolist(), strict=True)) == [(20, 3), (33, 15)]
        assert M.read_payload(data) == data[20:50]


def test_fragments():
    empty = tables([], 0).replace(M._full(b"stco", struct.pack(">II", 1, 0)), M._full(b"stco", struct.pack(">I", 0))).replace(M._full(b"stsc", struct.pack(">IIII", 1, 1, 0, 1)), M._full(b"stsc", struct.pack(">I", 0)))
    trex = M._full(b"trex", struct.pack(">IIIII", 7, 1, 10, 6, 0x10000))
    head = M._box(b"ftyp", b"isom", bytes(4)) + M._box(b"moov", track(7, b"vide", b"hvc1", empty), M._box(b"mvex", trex))
    # a run with sizes and a first key frame; then one with defaults, all of it not key frames
    run = M._full(b"trun", struct.pack(">IiI3I", 3, 1000, 0, 4, 5, 6), flags=0x205)
    moof = M._box(b"moof", M._full(b"mfhd", struct.pack(">I", 1)), M._box(b"traf", M._full(b"tfhd", struct.pack(">I", 7), flags=0x20000), run, M._full(b"trun", struct.pack(">I", 2))))
    data = head + moof
    start = len(head)
    data += bytes(start + 1000 + 40 - len(data))[:-8] + M._box(b"free")
    d = M.describe(data[: start + len(moof)] + M._box(b"mdat", bytes(2000)))
    assert d["error"] is None and (d["codec"], d["samples"], d["duration"]) == ("hvc1", 5, 50)
    assert d["key_offsets"].tolist() == [start + 1000] and d["key_sizes"].tolist() == [4]
    t = M.sample_table(data[: start + len(moof)] + M._box(b"mdat", bytes(2000)))
    assert t["offsets"].tolist() == [start + 1000, start + 1004, start + 1009, start + 1015, start + 1021] and t["sizes"].tolist() == [4, 5, 6, 6, 6]


def test_damage_asks_for_no_memory():
    data = M.wrap(M.padded("x" * 5000)[0])
    at = data.index(b"stsz")
    huge = data[: at + 12] + struct.pack(">I", 2**32 - 1) + data[at + 16 :]
    assert M.describe(huge)["error"]
    assert M.describe(data[: data.index(b"mdhd") - 4])["error"]
    mdhd = M._box(b"moov", M._box(b"trak", M._full(b"stsd", bytes(4)), M._full(b"stts", bytes(4)), M._full(b"stsc", bytes(4)), M._full(b"stsz", bytes(8)), M._full(b"stco", bytes(4)), M._box(b"mdhd")))
    assert M.describe(mdhd)["error"]
    rng = random.Random(4)
    for _ in range(3000):
        broken = bytearray(data[:1200])
        for _ in range(rng.randint(1, 4)):
            broken[rng.randrange(1000)] = rng.choice([0, 1, 127, 255, rng.randrange(256)])
        M.describe(bytes(broken))


def test_deep_nesting_is_read():
    inner = track(1, b"vide", b"raw ", tables([4], 8))
    deep = inner[8:]
    for _ in range(300):
        deep = M._box(b"udta", deep)
    data = M._box(b"mdat", b"abcd") + M._box(b"moov", M._box(b"trak", deep))
    assert M.read_payload(data) == b"abcd"
