"""Repeated byte strings by suffix arrays: every byte covered by a `span`-byte string that occurs twice.

Sharding. Suffix arrays of arbitrary shards would have to be merged pair by pair. So text is dealt
by content: of the 32-byte grams in a window of span bytes the one with the least hash is its anchor,
and neighbouring windows with the same anchor make a context. Equal windows have equal anchors, so all
occurrences of a string meet in the shard of their anchor, and a shard's suffix array is complete by itself.

  1. anchors: per context (anchor hash, hash of its bytes, document, first and last window) - one
     row for about 85 bytes of text, no text;
  2. anchors that occur once are dropped; contexts whose bytes occur twice are repeated as a whole;
  3. what is left, different contexts of one anchor, is fetched from the texts, each once, and
     dealt out by anchor. A task gathers up to `shard_bytes`, sorts the suffixes by Larsson-Sadakane
     refinement, takes Kasai common prefixes, and tells the windows with a prefix of span bytes or more;
  4. an anchor with over `longest` different contexts is dealt over several shards. Their sorted windows
     are then merged by binary search, in ranges of a digest of the window, so each is sent once.

Counts are partly aggregated before the shuffle, and joins bring a hot anchor's rows together with
one row of counts, so AQE may split them. Copies of a text carry the same key (hash and length) and
cost rows, not text.

Nulls: a null text is empty. Texts under span bytes and empty ones keep all their bytes. Repeated
rows are documents like any others, so they remove each other wholly from span bytes on. Empty tables give no rows;
other columns are not read. Long texts are cut into overlapping pieces of `PIECE` bytes for step 1 only.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import cut, drop_table, table

SPAN, GRAM, PIECE = 200, 32, 512 << 10
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], np.uint64)
LOW = np.uint64(0xFFFFFFFF)


# ---- anchors ----


def gram_hashes(data: bytes) -> np.ndarray:
    """Of all 32-byte grams of data."""
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)).astype(np.uint64)
    n = len(data) - GRAM + 1
    x = words[:n] * _MIX[0]
    for k in (1, 2, 3):
        x ^= x >> np.uint64(31)
        x += words[8 * k : 8 * k + n] * _MIX[k]
    x ^= x >> np.uint64(29)
    x *= _MIX[4]
    return x ^ (x >> np.uint64(32))


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    done = 1
    n = len(v) - width + 1
    while 2 * done <= width:
        v = np.minimum(v[:-done], v[done:])
        done *= 2
    return np.minimum(v[:n], v[width - done : width - done + n])


def contexts(data: bytes, starts: np.ndarray, ends: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor hash, first, last): runs of windows with one anchor, in the texts data[starts:ends]."""
    if len(data) < span:
        return (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    x = gram_hashes(data)
    best = sliding_min((x & ~LOW) | np.arange(len(x), dtype=np.uint64), span - GRAM + 1)
    at = (best & LOW).astype(np.int64)
    n = len(at)
    edge = np.zeros(n + 1, np.int32)  # windows that begin in one text and end in another
    np.add.at(edge, np.clip(ends - span + 1, starts, ends).clip(0, n), 1)
    np.add.at(edge, ends.clip(0, n), -1)
    good = np.cumsum(edge[:n]) == 0
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (good[1:] != good[:-1])]))
    last = np.append(new[1:], n) - 1
    keep = good[new]
    first, last = new[keep], last[keep]
    return np.searchsorted(starts, first, "right") - 1, x[at[first]], first, last


_ANCHORS = pa.schema([("h", pa.int64()), ("ctx", pa.int64()), ("tid", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _anchors(span: int):
    def of(texts: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        """texts: key, length of the whole text, place of the piece in it, piece; longest texts come piecewise."""
        data = b"".join(t[3] for t in texts)
        length = np.array([len(t[3]) for t in texts], np.int64)
        ends = np.cumsum(length)
        starts = ends - length
        which, h, first, last = contexts(data, starts, ends, span)
        view = memoryview(data)
        ctx = [xxhash.xxh64_intdigest(view[a:b]) for a, b in zip(first.tolist(), (last + span).tolist(), strict=True)]
        key, n, place = (np.array([t[k] for t in texts], np.int64) for k in range(3))
        move = (place - starts)[which]
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.array(ctx, np.uint64).view(np.int64)), pa.array(key[which]), pa.array(n[which]), pa.array(first + move), pa.array(last + move)], schema=_ANCHORS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = text.as_buffer()
                n = data.size
                for p in range(0, max(1, n - span + 1), PIECE):
                    if n >= span:
                        piece = data.slice(p, min(PIECE + span - 1, n - p)).to_pybytes()
                        held.append((key, n, p, piece))
                        size += len(piece)
                    if size >= PIECE:
                        yield of(held)
                        held, size = [], 0
        if held:
            yield of(held)

    return run


# ---- suffix arrays ----


def suffix_array(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, rank) of the texts that end at ends, one after another in data.

    Suffixes end with their text; equal ones are in the order of their places, so that what
    follows them is, too, as Kasai's bound needs. By Larsson-Sadakane: sorted on 7 bytes, then
    groups of equals are refined by the rank of what follows, twice as far each time.
    """
    n = len(data)
    end = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
    left = end - np.arange(n)
    depth = int(left.max(initial=0))
    # seven bytes, and how many there are, so that a text that ends comes before one that goes on with zeros
    words = np.ndarray((n,), ">u8", data + bytes(8), strides=(1,)).astype(np.uint64)
    words &= ~np.uint64(255)
    short = np.flatnonzero(left < 7)
    words[short] &= ~np.uint64(0) << (np.uint64(8) * (np.uint64(8) - left[short].astype(np.uint64)))
    words |= np.minimum(left, 7).astype(np.uint64)
    order = np.argsort(words)
    ties = words[order]
    new = np.concatenate([[True], ties[1:] != ties[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = 7
    while True:
        size = np.diff(np.append(np.flatnonzero(new), n))
        places = np.flatnonzero(np.repeat(size > 1, size))  # in groups not yet sorted
        if h >= depth or not len(places):
            break
        who = order[places]
        ahead = np.where(left[who] > h, rank[np.minimum(who + h, n - 1)] + 1, 0)
        key = rank[who] * (n + 1) + ahead
        by = np.argsort(key)
        who, key = who[by], key[by]
        order[places] = who
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        new[places] = fresh
        rank[who] = np.maximum.accumulate(np.where(fresh, places, 0))
        h *= 2
    who = order[places]  # equal to their ends
    order[places] = who[np.argsort(rank[who] * n + who)]
    rank[order] = np.arange(n)
    return order, rank


def common_prefixes(data: bytes, ends: np.ndarray, order: np.ndarray, rank: np.ndarray, span: int) -> np.ndarray:
    """By Kasai: for each rank, the prefix it shares with the rank before, up to span; 0 where a suffix is under span.

    All texts go forward together, one suffix at a time, each keeping all but one byte of its last prefix.
    """
    n = len(data)
    starts = np.concatenate([[0], ends[:-1]])
    end = np.repeat(ends, ends - starts)
    words = np.ndarray((n,), "<u8", data + bytes(8), strides=(1,)).astype(np.uint64)
    out = np.zeros(n, np.int64)
    texts = np.argsort(starts - ends, kind="stable")  # longest first
    at, stop = starts[texts], ends[texts] - span
    held = np.zeros(len(texts), np.int64)
    for t in range(int((stop - at).max(initial=-1)) + 1):
        live = int(np.searchsorted(at - stop, -t, "right"))  # texts that still have a window here
        i = at[:live] + t
        r = rank[i]
        j = order[np.maximum(r - 1, 0)]
        most = np.where(r > 0, np.minimum(span, np.minimum(end[i] - i, end[j] - j)), 0)
        l = np.minimum(np.maximum(held[:live] - 1, 0), most)
        go = np.flatnonzero(l < most)
        while len(go):
            x = words[i[go] + l[go]] ^ words[j[go] + l[go]]
            same = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) // 8).astype(np.int64)
            l[go] = np.minimum(l[go] + same, most[go])
            go = go[(same == 8) & (l[go] < most[go])]
        held[:live] = l
        out[r] = l
    return out


def repeated(texts: list[bytes], span: int = SPAN) -> np.ndarray:
    """For each place in the joined texts, whether the string of span bytes there begins elsewhere too."""
    data = b"".join(texts)
    ends = np.cumsum([len(t) for t in texts])
    order, rank = suffix_array(data, ends)
    shared = common_prefixes(data, ends, order, rank, span) >= span
    both = shared.copy()
    both[:-1] |= shared[1:]
    out = np.empty(len(data), bool)
    out[order] = both
    return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of true."""
    edge = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


_FOUND = pa.schema([("tid", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
_WINDOW = pa.schema([*_FOUND, ("d1", pa.int64()), ("d2", pa.int64())])


def _shards(span: int, shard_bytes: int, hot: bool):
    """Rows (part, tid, n, a, hot, known, bytes), a part's rows together: windows found repeated.

    Of hot parts also, with their digests, the windows that other shards may hold: those not found
    with their place, and one of each sort of the others without.
    """
    schema = _WINDOW if hot else _FOUND

    def of(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        flags = repeated([r[6] for r in rows], span)
        found, at, sorts = [], 0, set()
        for _, tid, n, a, _, known, data in rows:
            mine = flags[at : at + len(data) - span + 1]
            at += len(data)
            if not known:
                found += [(tid, n, a + int(x), a + int(y), None, None)[: len(schema)] for x, y in zip(*_runs(mine), strict=True)]
            for s in range(len(mine)) if hot else ():
                digest = hashlib.blake2b(data[s : s + span], digest_size=16).digest()
                place = (None, None, None, None) if known or mine[s] else (tid, n, a + s, a + s)
                if place[0] is not None or digest not in sorts:
                    found.append((*place, *np.frombuffer(digest, "<i8").tolist()))
                if place[0] is None:
                    sorts.add(digest)
            if len(found) >= 20_000:
                yield _rows(found, schema)
                found = []
        if found:
            yield _rows(found, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= shard_bytes and held[-1][0] != row[0]:
                    yield from of(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[6])
        if held:
            yield from of(held)

    return run


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows (tid, n, a, b, d1, d2) of all shards, sorted by digest: those with a place that occur twice or more."""
    left: pa.Table | None = None

    def of(t: pa.Table) -> list[pa.RecordBatch]:
        d1, d2 = t["d1"].to_numpy(), t["d2"].to_numpy()
        new = np.concatenate([[True], (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])])
        first = np.flatnonzero(new)
        # the range of each row's digest, by binary search
        k = np.searchsorted(first, np.arange(len(t)), "right")
        times = np.append(first, len(t))[k] - first[k - 1]
        keep = (times > 1) & t["tid"].is_valid().to_numpy()
        return t.select(["tid", "n", "a", "b"]).filter(pa.array(keep)).combine_chunks().to_batches()

    for batch in batches:
        t = pa.Table.from_batches([batch])
        left = t if left is None else pa.concat_tables([left, t])
        d = left["d1"].to_numpy()
        whole = int(np.searchsorted(d, d[-1])) if len(d) else 0
        if whole:
            yield from of(left.slice(0, whole))
            left = left.slice(whole).combine_chunks()
    if left is not None and len(left):
        yield from of(left)


def _cut_out(span: int):
    """Of a text and the places wanted of it: the bytes there."""
    schema = pa.schema([("h", pa.int64()), ("tid", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("hot", pa.int64()), ("known", pa.bool_()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for tid, n, text, wanted in zip(*batch.columns, strict=True):
                data, tid, n = text.as_buffer().to_pybytes(), tid.as_py(), n.as_py()
                for w in wanted.as_py():
                    rows.append((w["h"], tid, n, w["a"], w["hot"], w["known"], data[w["a"] : w["b"] + span]))
                    size += w["b"] + span - w["a"]
                if size >= PIECE:
                    yield _rows(rows, schema)
                    rows, size = [], 0
            if rows:
                yield _rows(rows, schema)

    return run


def _free(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of what is no longer referred to."""
    gc.collect()
    spark._jvm.System.gc()


def repeated_spans(docs: DataFrame, span: int = SPAN, longest: int = 16_384, shard_bytes: int = 1 << 20) -> DataFrame:
    """(tid, n, a, b) of docs (tid, n, text): the strings that begin at a..b of text tid occur elsewhere, too."""
    spark = docs.sparkSession
    rows = cut(docs.select("tid", F.col("text").cast("binary")).mapInArrow(_anchors(span), "h long, ctx long, tid long, n long, a long, b long"), "suffix-anchors")
    often = rows.groupBy("h").agg(F.count("*").alias("c"), F.min("ctx").alias("lo"), F.max("ctx").alias("hi")).where("c > 1")
    # a table of its own, so that the join's two sides are plain shuffles and AQE may split a hot anchor
    often = cut(often.select("h", (F.col("lo") != F.col("hi")).alias("differ")), "suffix-counts")
    mine = cut(rows.join(often, "h"), "suffix-often")
    drop_table(rows)
    _free(spark)
    alike = mine.where(~F.col("differ")).select("tid", "n", "a", "b")
    other = mine.where("differ")
    each = cut(other.groupBy("h", "ctx").agg(F.count("*").alias("c"), F.min(F.struct("tid", "n", "a", "b")).alias("r")), "suffix-contexts")
    same = other.join(each.where("c > 1").select("h", "ctx"), ["h", "ctx"]).select("tid", "n", "a", "b")
    hot = each.groupBy("h").count().where(F.col("count") > longest).select("h", F.ceil(F.col("count") / longest).alias("hot"))
    hot = cut(hot, "suffix-hot")
    wanted = each.join(hot, "h", "left").select("h", "r.*", F.coalesce("hot", F.lit(0)).cast("long").alias("hot"), (F.col("c") > 1).alias("known"))
    wanted = wanted.groupBy("tid", "n").agg(F.collect_list(F.struct("h", "a", "b", "hot", "known")).alias("wanted"))
    # one of each group of copies, partly chosen before the shuffle: copies of a text never meet in one task
    one = docs.select("tid", "n", F.col("text").cast("binary").alias("text")).groupBy("tid", "n").agg(F.first("text").alias("text"))
    texts = one.join(wanted, ["tid", "n"]).select("tid", "n", "text", "wanted")
    pieces = cut(texts.mapInArrow(_cut_out(span), "h long, tid long, n long, a long, hot long, known boolean, bytes binary"), "suffix-pieces")
    _free(spark)
    part = F.when(F.col("hot") > 0, F.xxhash64("h", F.pmod(F.xxhash64("tid", "a"), F.col("hot")))).otherwise(F.col("h"))
    dealt = lambda d: d.select(part.alias("part"), "tid", "n", "a", "hot", "known", "bytes").repartition("part").sortWithinPartitions("part")
    found = dealt(pieces.where("hot = 0")).mapInArrow(_shards(span, shard_bytes, False), "tid long, n long, a long, b long")
    if hot.limit(1).count():
        windows = dealt(pieces.where("hot > 0")).mapInArrow(_shards(span, shard_bytes, True), "tid long, n long, a long, b long, d1 long, d2 long")
        windows = cut(windows, "suffix-windows")
        merged = windows.where("d1 is not null").repartition("d1").sortWithinPartitions("d1", "d2").mapInArrow(_merge, "tid long, n long, a long, b long")
        found = found.unionByName(merged).unionByName(windows.where("d1 is null").select("tid", "n", "a", "b"))
    return alike.unionByName(same).unionByName(cut(found, "suffix-found"))


def keep_rest(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of data without the spans (from, to), bytes removed, and maximal runs removed."""
    kept, removed, runs, at = [], 0, 0, 0
    end = -1  # of the run that is being removed
    for a, b in sorted(spans):
        if a > end:
            runs += 1
            if end >= 0:
                removed += end - at
                at = end
            kept.append(data[at:a])
            at = a
        end = max(end, b)
    if end >= 0:
        removed += end - at
        at = end
    kept.append(data[at:])
    return b"".join(kept), removed, runs


def _remove(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                n, removed, runs, kept = [], [], [], []
                for text, spans in zip(part.column(1), part.column(2), strict=True):
                    data = text.as_buffer().to_pybytes()
                    rest, r, k = keep_rest(data, [(s["a"], s["b"] + span) for s in spans.as_py() or ()])
                    n.append(len(data))
                    removed.append(r)
                    runs.append(k)
                    kept.append(rest)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, span: int = SPAN, longest: int = 16_384, shard_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of docs (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", F.xxhash64(text).alias("tid"), F.octet_length(text).cast("long").alias("n"), text.alias("text"))
    spans = repeated_spans(keyed.drop("doc_id"), span, longest, shard_bytes)
    spans = cut(spans.groupBy("tid", "n").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "suffix-spans")
    _free(docs.sparkSession)
    joined = keyed.join(spans, ["tid", "n"], "left").select("doc_id", F.col("text").cast("binary"), "spans")
    schema = docs.select("doc_id").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary")
    return joined.mapInArrow(_remove(span), schema)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
