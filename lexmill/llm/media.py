"""Media columns: ISO base media containers in a binary column, described without decoding their payload.

`tracks` walks the nested boxes of a container (ISO/IEC 14496-12), to any depth, and decodes the sample tables of all
tracks, compact sizes and movie fragments included; `describe` gives codec, timing and the byte ranges of the key frames of the
first video track, or of the first track where there is no video. Media data boxes are skipped, never read. `wrap_texts` is the writing side: it stores a text as raw 8-bit samples of 16 x 12
grey pixels (192 bytes a frame), a key frame every `GOP` frames, `CHUNK` frames to a chunk, so that
the text can be read back byte by byte through the sample tables.

Defined results. A null text is an empty one, which is one frame of spaces. A container that is
null has null fields and error 'null'; one that is cut off or damaged has the reason in `error` and null
fields, and never fails the job. Without a sync sample table every sample is a key frame. Rows are
independent of each other: repeated rows repeat, empty tables give no rows, other columns are not read.
Memory is bounded by one batch of documents, dealt on in pieces of `PIECE` bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lexmill.llm.common import table

FRAME, WIDTH, HEIGHT = 192, 16, 12
TIMESCALE, DELTA, GOP, CHUNK = 25, 1, 12, 32
PIECE = 8 << 20
#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex", b"udta"}


# ---- writing ----


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def wrap(payload: bytes) -> bytes:
    """A container of one video track whose frames are payload, a multiple of FRAME bytes."""
    frames = len(payload) // FRAME
    chunks = -(-frames // CHUNK)
    duration = frames * DELTA
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = _box(
        b"raw ",
        bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", WIDTH, HEIGHT, 0x480000, 0x480000, 0, 1),
        bytes(32), struct.pack(">Hh", 40, -1),
    )
    keys = np.arange(1, frames + 1, GOP, dtype=">u4")
    stsc = [(1, CHUNK)] if frames % CHUNK == 0 else [(1, CHUNK), (chunks, frames % CHUNK)] if chunks > 1 else [(1, frames)]

    def moov(first: int) -> bytes:
        offsets = (first + np.arange(chunks, dtype=np.int64) * (CHUNK * FRAME)).astype(">u8")
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, frames, DELTA)),
            _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            _full(b"stsc", struct.pack(">I", len(stsc)), b"".join(struct.pack(">III", a, n, 1) for a, n in stsc)),
            _full(b"stsz", struct.pack(">II", FRAME, frames)),
            _full(b"co64", struct.pack(">I", chunks), offsets.tobytes()),
        )
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        minf = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), dinf, stbl)
        mdhd = _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, duration, 0x55C4, 0), version=1)
        hdlr = _full(b"hdlr", bytes(4), b"vide", bytes(12), b"frames\0")
        tkhd = _full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, duration), bytes(16), matrix, struct.pack(">II", WIDTH << 16, HEIGHT << 16), version=1, flags=7)
        mvhd = _full(b"mvhd", struct.pack(">QQIQ", 0, 0, TIMESCALE, duration), struct.pack(">IH", 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2), version=1)
        return _box(b"moov", mvhd, _box(b"trak", tkhd, _box(b"mdia", mdhd, hdlr, minf)))

    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    head = len(ftyp) + len(moov(0)) + 16
    mdat = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload))
    return b"".join([ftyp, moov(head), mdat, payload])


def padded(text: str | None) -> tuple[bytes, int]:
    """The payload of a text and the number of its own bytes."""
    data = (text or "").encode()
    return data + b" " * (max(FRAME, -(-len(data) // FRAME) * FRAME) - len(data)), len(data)


# ---- reading ----


def boxes(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(kind, first, end) of the boxes in data[start:end]; only their headers are read."""
    end = len(data) if end is None else end
    while start < end:
        if start + 8 > end:
            raise ValueError("box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if start + 16 > end:
                raise ValueError("box header is cut off")
            (size,), head = struct.unpack_from(">Q", data, start + 8), 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind.decode('latin-1')} leaves its parent")
        yield kind, start + head, start + size
        start += size


def _number(data: bytes, at: tuple[int, int], offset: int, kind: str = ">I") -> int:
    """One number of the box at, `offset` bytes from its first."""
    a, b = at
    if a + offset + struct.calcsize(kind) > b:
        raise ValueError("a box is cut off")
    return struct.unpack_from(kind, data, a + offset)[0]


def _leaves(data: bytes, start: int, end: int) -> dict[bytes, tuple[int, int]]:
    """Where the leaf boxes in start..end lie, the first of each kind; boxes may be nested to any depth."""
    found: dict[bytes, tuple[int, int]] = {}
    todo = [(start, end)]
    while todo:
        for kind, a, b in boxes(data, *todo.pop()):
            if kind in NESTED:
                todo.append((a, b))
            else:
                found.setdefault(kind, (a, b))
    return found


def _table(data: bytes, at: tuple[int, int], kind: str, width: int, skip: int = 4) -> np.ndarray:
    """Rows of a counted table in a full box; skip: bytes before the count."""
    a, b = at
    n = _number(data, at, skip)
    if a + skip + 4 + n * width * np.dtype(kind).itemsize > b:
        raise ValueError("a sample table is cut off")
    return np.frombuffer(data, kind, n * width, a + skip + 4).astype(np.int64).reshape(n, width)


def _sizes(data: bytes, boxes_of: dict[bytes, tuple[int, int]]) -> np.ndarray:
    """The size of every sample, from stsz or the compact stz2."""
    if b"stsz" in boxes_of:
        fixed, n = _number(data, boxes_of[b"stsz"], 4), _number(data, boxes_of[b"stsz"], 8)
        if not fixed:
            return _table(data, boxes_of[b"stsz"], ">u4", 1, skip=8)[:, 0]
        if fixed * n > len(data):  # before room is made for them
            raise ValueError("a sample lies outside the file")
        return np.full(n, fixed, np.int64)
    a, b = boxes_of[b"stz2"]
    bits, n = _number(data, (a, b), 7, ">B"), _number(data, (a, b), 8)
    if bits not in (4, 8, 16) or a + 12 + -(-n * bits // 8) > b:
        raise ValueError("a sample table is cut off")
    if bits == 4:
        pairs = np.frombuffer(data, np.uint8, -(-n // 2), a + 12)
        return np.stack([pairs >> 4, pairs & 15], 1).ravel()[:n].astype(np.int64)
    return np.frombuffer(data, f">u{bits // 8}", n, a + 12).astype(np.int64)


def _samples(data: bytes, track: dict[bytes, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Offsets, sizes, keys of the samples that a track's tables name, and their duration."""
    sizes = _sizes(data, track)
    n = len(sizes)
    times = _table(data, track[b"stts"], ">u4", 2)
    chunk_at = (_table(data, track[b"co64"], ">u8", 1) if b"co64" in track else _table(data, track[b"stco"], ">u4", 1))[:, 0]
    runs = _table(data, track[b"stsc"], ">u4", 3)
    per_chunk = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0] - 1, len(chunk_at)))) if len(runs) else np.zeros(0, np.int64)
    if per_chunk.sum() != n or len(per_chunk) != len(chunk_at):
        raise ValueError("chunks and samples disagree")
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(per_chunk) - per_chunk  # the first sample of each chunk
    base = np.repeat(chunk_at - before[np.minimum(first, n - 1)], per_chunk) if n else np.zeros(0, np.int64)
    keys = np.ones(n, bool)
    if b"stss" in track:
        keys = np.zeros(n, bool)
        which = _table(data, track[b"stss"], ">u4", 1)[:, 0] - 1
        if len(which) and (which.min() < 0 or which.max() >= n):
            raise ValueError("a key frame is no sample")
        keys[which] = True
    return base + before, sizes, keys, int((times[:, 0] * times[:, 1]).sum())


def _fragment(data: bytes, moof: tuple[int, int], start: int, defaults: dict[int, tuple[int, int, int]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(track, offsets, sizes, keys, duration) of each run of samples in a movie fragment that begins at start."""
    for kind, a, b in boxes(data, *moof):
        if kind != b"traf":
            continue
        parts = list(boxes(data, a, b))
        head = next(((x, y) for k, x, y in parts if k == b"tfhd"), None)
        if head is None:
            raise ValueError("a fragment lacks its header")
        flags, track, at = _number(data, head, 0) & 0xFFFFFF, _number(data, head, 4), 8
        base, given = start, list(defaults.get(track, (0, 0, 0)))
        if flags & 1:
            base, at = _number(data, head, at, ">Q"), at + 8
        at += 4 * bool(flags & 2)
        for i, bit in enumerate((8, 16, 32)):
            if flags & bit:
                given[i], at = _number(data, head, at), at + 4
        place = base
        for kind_of, x, y in parts:
            if kind_of != b"trun":
                continue
            flags, n, at = _number(data, (x, y), 0) & 0xFFFFFF, _number(data, (x, y), 4), 8
            if flags & 1:
                place, at = base + _number(data, (x, y), at, ">i"), at + 4
            first = None
            if flags & 4:
                first, at = _number(data, (x, y), at), at + 4
            columns = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
            if x + at + 4 * n * len(columns) > y or (not columns and n * max(1, given[1]) > len(data)):
                raise ValueError("a sample table is cut off")
            rows = np.frombuffer(data, ">u4", n * len(columns), x + at).astype(np.int64).reshape(n, len(columns))
            column = lambda bit, value, n=n, rows=rows, columns=columns: rows[:, columns.index(bit)] if bit in columns else np.full(n, value, np.int64)
            sizes, marks = column(0x200, given[1]), column(0x400, given[2]).copy()
            if first is not None and n:
                marks[0] = first
            yield track, place + np.cumsum(sizes) - sizes, sizes, marks & 0x10000 == 0, int(column(0x100, given[0]).sum())
            place += int(sizes.sum())


def tracks(data: bytes) -> list[dict]:
    """handler, codec, timescale, duration, and offset, size and key of every sample, of each track; those in fragments come last."""
    found, defaults, reason, fragments = [], {}, "no track", []
    for kind, a, b in boxes(data):
        if kind == b"moov":
            for k, x, y in boxes(data, a, b):
                if k == b"trak":
                    found.append(_leaves(data, x, y))
                elif k == b"mvex":
                    for e, p, q in boxes(data, x, y):
                        if e == b"trex":
                            defaults[_number(data, (p, q), 4)] = tuple(_number(data, (p, q), i) for i in (12, 16, 20))
        elif kind == b"moof":
            fragments.append((a, b))
    pieces: dict[int, list] = {}
    for a, b in fragments:
        for track, *rest in _fragment(data, (a, b), a - 8, defaults):
            pieces.setdefault(track, []).append(rest)
    out = []
    for track in found:
        missing = [k.decode() for k in (b"stsd", b"mdhd") if k not in track]
        placed = (b"stsz" in track or b"stz2" in track) and (b"stco" in track or b"co64" in track) and b"stts" in track and b"stsc" in track
        number = _number(data, track[b"tkhd"], 20 if _number(data, track[b"tkhd"], 0, ">B") == 1 else 12) if b"tkhd" in track else 0
        if missing or not (placed or number in pieces):
            reason = f"a track lacks {', '.join(missing) or 'its sample places'}"
            continue
        timescale = _number(data, track[b"mdhd"], 20 if _number(data, track[b"mdhd"], 0, ">B") == 1 else 12)
        if not timescale:
            raise ValueError("no timescale")
        _number(data, track[b"stsd"], 12)
        codec = data[track[b"stsd"][0] + 12 : track[b"stsd"][0] + 16].decode("latin-1")
        handler = data[track[b"hdlr"][0] + 8 : track[b"hdlr"][0] + 12].decode("latin-1") if b"hdlr" in track else ""
        parts = ([_samples(data, track)] if placed else []) + pieces.get(number, [])
        offsets, sizes, keys = (np.concatenate([p[i] for p in parts]) for i in range(3))
        if len(sizes) and (offsets.min() < 0 or (offsets + sizes).max() > len(data)):
            raise ValueError("a sample lies outside the file")
        if not len(sizes):
            reason = "no samples"
            continue
        out.append({"handler": handler, "codec": codec, "timescale": timescale, "duration": sum(p[3] for p in parts), "offsets": offsets, "sizes": sizes, "keys": keys})
    if not out:
        raise ValueError(reason)
    return out


def sample_table(data: bytes) -> dict:
    """The first video track that has samples, or else the first track that has some."""
    every = tracks(data)
    return next((t for t in every if t["handler"] == "vide"), every[0])


def describe(data: bytes | None) -> dict:
    """codec, timescale, duration (in timescale units), samples, key_offsets, key_sizes, error."""
    none = dict.fromkeys(("codec", "timescale", "duration", "samples", "key_offsets", "key_sizes"))
    if data is None:
        return none | {"error": "null"}
    try:
        t = sample_table(data)
    except (ValueError, OverflowError, struct.error) as e:
        return none | {"error": str(e)}
    return {"codec": t["codec"], "timescale": t["timescale"], "duration": t["duration"], "samples": len(t["sizes"]), "key_offsets": t["offsets"][t["keys"]], "key_sizes": t["sizes"][t["keys"]], "error": None}


def read_payload(data: bytes) -> bytes:
    """All samples in order, found through the sample tables; neighbours in the file are read at once."""
    t = sample_table(data)
    starts = np.flatnonzero(np.concatenate([[True], t["offsets"][1:] != t["offsets"][:-1] + t["sizes"][:-1]]))
    ends = np.append(starts[1:], len(t["sizes"])) - 1
    return b"".join(data[t["offsets"][a] : t["offsets"][b] + t["sizes"][b]] for a, b in zip(starts, ends, strict=True))


# ---- columns ----

MEDIA = "media binary, n_bytes long"
DESCRIBED = pa.schema([("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("samples", pa.int64()), ("key_offsets", pa.list_(pa.int64())), ("key_sizes", pa.list_(pa.int64())), ("error", pa.string())])

_SPARK_DESCRIBED = [("codec", "string"), ("timescale", "long"), ("duration", "long"), ("samples", "long"), ("key_offsets", T.ArrayType(T.LongType())), ("key_sizes", T.ArrayType(T.LongType())), ("error", "string")]


def _pieces(rows: Iterator[tuple], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    """Batches of rows, each a little over PIECE bytes at most one row beyond."""
    part, full = [], 0
    for row in rows:
        part.append(row)
        full += size(row)
        if full >= PIECE or len(part) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)
            part, full = [], 0
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


def _wrap(key: pa.DataType):
    schema = pa.schema([("doc_id", key), ("media", pa.binary()), ("n_bytes", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                payload, n = padded(text.as_py())
                yield name.as_py(), wrap(payload), n

    return lambda batches: _pieces(rows(batches), schema, lambda row: len(row[1]))


def wrap_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, media, n_bytes): the container of every text."""
    key = docs.select("doc_id").schema
    return docs.select("doc_id", "text").mapInArrow(_wrap(_arrow(docs)), key.add("media", "binary").add("n_bytes", "long"))


def _arrow(df: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema["doc_id"].dataType)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = None

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for name, media in zip(batch.column(0), batch.column(1), strict=True):
            yield (name.as_py(), *describe(media.as_py()).values())

    for batch in batches:
        schema = pa.schema([batch.schema.field(0), *DESCRIBED])
        yield from _pieces(rows(batch), schema, lambda row: 64 + 16 * len(row[5] if row[5] is not None else ()))


def describe_media(media: DataFrame) -> DataFrame:
    """Of (doc_id, media): doc_id, codec, timescale, duration, samples, key_offsets, key_sizes, error."""
    schema = media.select("doc_id").schema
    for name, kind in _SPARK_DESCRIBED:
        schema = schema.add(name, kind)
    return media.select("doc_id", "media").mapInArrow(_describe, schema)


def feature(d: dict) -> str:
    """What describe() found, on one line: the key frames' byte ranges by number, ends and checksum."""
    if d["error"]:
        return f"error={d['error']}"
    at, size = np.asarray(d["key_offsets"], np.int64), np.asarray(d["key_sizes"], np.int64)
    ranges = zlib.crc32(np.stack([at, at + size], 1).astype("<i8").tobytes())
    ends = f"first={at[0]}+{size[0]};last={at[-1]}+{size[-1]};" if len(at) else ""
    return f"codec={d['codec'].strip()};seconds={d['duration'] / d['timescale']:.2f};samples={d['samples']};keyframes={len(at)};{ends}ranges={ranges:08x}"


_DIGEST = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]


def _digest(key: pa.DataType):
    schema = pa.schema([("doc_id", key), *_DIGEST, *DESCRIBED])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for name, media, n in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                data = media.as_py()
                payload, d = read_payload(data), describe(data)
                yield name.as_py(), n.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(d), *d.values()

    return lambda batches: _pieces(rows(batches), schema, lambda row: 400 + 16 * len(row[12]))


def digest_media(media: DataFrame) -> DataFrame:
    """Of (doc_id, media, n_bytes) made by wrap_texts: the digests of the stored bytes and what is read back from them, then what describe() finds."""
    schema = media.select("doc_id").schema
    for name, kind in (("n_bytes", "long"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string"), *_SPARK_DESCRIBED):
        schema = schema.add(name, kind)
    return media.select("doc_id", "media", "n_bytes").mapInArrow(_digest(_arrow(media)), schema)


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_media(wrap_texts(table(spark, sf_dir, "documents"))).drop("error")
