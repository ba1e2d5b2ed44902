"""SimHash near-duplicates: a byte-position inverted index with count filtering.

Fingerprints. Words are runs of anything but ASCII white space, A-Z lower-cased; every 4-word
shingle counts as often as it occurs. A text without words has fingerprint zero and is linked like
any other.

Index. Two fingerprints with at most 4 differing bits agree in at least 4 of their 8 bytes. A list
of all fingerprints that share one byte at one position would hold 1/256 of them, and pairs from it
grow with the square of the input. So postings are kept for bytes at three positions at once: of
the 56 triples, 20 are enough for each set of 4 positions to hold one (a Turan system). Within a
posting list the positional bytes that a pair shares are tallied, pairs with 4 or more are
retained, and their bits are compared. No link is lost.

Skew. Exact copies share a fingerprint and are one row here. A list yields a spanning forest of
its links, not its pairs: a search from one fingerprint to all not yet reached, so that a dense list
costs about its length. A list longer than `longest` is dealt into chunks, and pairs of chunks go
to different tasks; it holds different fingerprints only, of which few fit near one another.

Nulls and ties. A null text counts as empty. A null id takes part but never names a component
unless all ids in it are null. Repeated rows get equal results. Empty tables give no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import connected_components, cut, drop_table, table

WORDS, BITS = 4, 4
#: Fingerprints in one task's piece of a posting list.
LONGEST = 4096


def fingerprint(text: str | None, width: int = WORDS) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes = [xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(np.array(hashes[i : i + (1 << 16)], "<u8").view(np.uint8), bitorder="little")
        counts += bits.reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns before the text, which is the last one, and fp."""
    for batch in batches:
        found = np.array([fingerprint(x.as_py()) for x in batch.column(batch.num_columns - 1)], np.uint64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], [*batch.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, *kept: Column | str) -> DataFrame:
    """kept and fp of docs (text)."""
    with_text = docs.select(*kept, "text")
    return with_text.mapInArrow(_fingerprints, with_text.drop("text").schema.add("fp", "long"))


def _triples() -> list[tuple[int, ...]]:
    """20 triples of positions such that any 4 of the 8 positions contain one.

    Turan's construction: positions in groups of 3, 3 and 2; triples within one group, and those
    with two positions in a group and one in the next.
    """
    group = [0, 0, 0, 1, 1, 1, 2, 2]

    def chosen(triple: tuple[int, ...]) -> bool:
        a, b, c = (group[p] for p in triple)  # in ascending order
        return a == c or (a == b and c == (a + 1) % 3) or (b == c and a == (b + 1) % 3)

    return [t for t in itertools.combinations(range(8), 3) if chosen(t)]


def _postings(fps: DataFrame) -> DataFrame:
    byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
    key = lambda i, t: F.lit(i << 24).cast("long") + F.shiftleft(byte(t[0]), 16) + F.shiftleft(byte(t[1]), 8) + byte(t[2])
    return fps.select("fp", F.explode(F.array(*[key(i, t) for i, t in enumerate(_triples())])).alias("key"))


def linked(x: np.ndarray, y: np.ndarray | np.uint64, bits: int = BITS) -> np.ndarray:
    """Whether fingerprints are linked: the tally of shared positional bytes first, then the bits."""
    differ = np.atleast_1d(x ^ y)
    tally = np.count_nonzero(differ.view(np.uint8).reshape(-1, 8) == 0, axis=1)
    out = tally >= 8 - bits
    out[out] = np.bitwise_count(differ[out]) <= bits
    return out


def forest(fps: np.ndarray, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges (from, to) of a spanning forest of the links among different fingerprints."""
    edges, rest, front = [], fps, np.empty(0, np.uint64)
    while len(rest):
        if not len(front):
            front, rest = rest[:1], rest[1:]
        here, front = front[0], front[1:]
        if (hit := linked(rest, here, bits)).any():
            edges.append((np.full(hit.sum(), here), rest[hit]))
            front, rest = np.concatenate([front, rest[hit]]), rest[~hit]
    return edges


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp), a key's rows next to each other: edges within each key."""
    keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)

    def edges(keys: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(first, len(keys)))
        few = np.repeat((sizes > 1) & (sizes <= 16), sizes)
        k, f = keys[few], fps[few]
        for lag in range(1, min(16, len(k))):
            same = k[lag:] == k[:-lag]
            if not same.any():
                break
            x, y = f[lag:][same], f[:-lag][same]
            hit = linked(x, y)
            yield x[hit], y[hit]
        for a, n in zip(first[sizes > 16], sizes[sizes > 16], strict=True):
            yield from forest(fps[a : a + n])

    def out(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        for x, y in edges(keys, fps) if len(keys) else ():
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

    for batch in batches:
        keys = np.concatenate([keys, batch.column(0).to_numpy()])
        fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
        if len(keys) and keys[0] != keys[-1]:
            last = len(keys) - int(np.argmax(keys[::-1] != keys[-1]))  # the last key may go on
            yield from out(keys[:last], fps[:last])
            keys, fps = keys[last:], fps[last:]
    yield from out(keys, fps)


def _edges(lists: DataFrame) -> DataFrame:
    return lists.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(_links, "a long, b long")


def links(fps: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Edges (a, b) whose components are those of all links among the fingerprints fps (fp, all different)."""
    lists = _postings(fps)
    long_ones = cut(lists.groupBy("key").count().where(F.col("count") > longest), "simhash-long")
    if not long_ones.limit(1).count():
        return _edges(lists)
    chunks = F.ceil(F.col("count") / longest).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    dealt = lists.join(long_ones.select("key", chunks.alias("chunks")), "key").withColumn("mine", mine)
    dealt = dealt.select("key", "fp", "mine", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    dealt = dealt.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "fp")
    return _edges(lists.join(long_ones, "key", "left_anti")).unionByName(_edges(dealt))


def grouped(fps: DataFrame, longest: int = LONGEST) -> DataFrame:
    """fps (fp, all different, and more) with `component`, one fingerprint of their group."""
    groups = connected_components(links(fps.select("fp"), longest), "simhash")
    named = fps.join(groups, F.col("fp") == F.col("node"), "left").select(*fps.columns, F.coalesce("component", "fp").alias("component"))
    return cut(named, "simhash-named")


def near_duplicates(docs: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(doc_id, fp, component_id) of every document; component_id is the least id reachable by links."""
    each = cut(fingerprints(docs, "doc_id"), "simhash-each")
    fps = cut(each.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-fps")
    named = grouped(fps, longest)
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = cut(named.join(least, "component").select("fp", "component_id"), "simhash-labels")
    drop_table(fps)
    return each.join(labels, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Of each group of near-duplicates one row: that of the least id (rows without one come last), then of the least hash of id and text.

    Rows are told apart by two 64-bit hashes of id and text, so rows that share an id don't go for one another; of rows equal in both one stays, that
    of the least hash of all columns (but maps), so reruns agree.
    """
    key = lambda: F.struct(F.xxhash64(docs["doc_id"], docs["text"]).alias("a"), F.xxhash64(docs["text"], docs["doc_id"], F.lit(1)).alias("b"))
    place = F.struct(docs["doc_id"].isNull().alias("without"), docs["doc_id"].alias("doc_id"), key().alias("row")).alias("place")
    each = cut(fingerprints(docs, place), "simhash-each")
    named = grouped(cut(each.groupBy("fp").agg(F.min("place").alias("place")), "simhash-fps"), longest)
    stays = cut(named.groupBy("component").agg(F.min("place").alias("place")).select(F.col("place.row").alias("_stays")).distinct(), "simhash-stays")
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    told = F.xxhash64(*[docs[f.name] for f in docs.schema if "map<" not in f.dataType.simpleString()])
    found = docs.select(row, told.alias("_told"), key().alias("_stays")).join(stays, "_stays")
    return found.groupBy("_stays").agg(F.min_by("row", "_told").alias("row")).select("row.*")


def hex64(x: Column) -> Column:
    return F.lower(F.lpad(F.hex(x), 16, "0"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")
