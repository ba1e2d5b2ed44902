"""Token-id output: fixed-width bit packing with block offsets.

A shard file holds, little-endian:
  magic b"LEXPACK1"; uint32 bits per id, ids per block, number of blocks, 0; uint64 ids, documents;
  uint64 byte offset of every block and of the end, from the first block;
  int64 doc_id and uint8 validity of every document, uint64 end of every document, in ids;
  the blocks: ids of `bits` bits each, lowest bit first, every block starting on a whole byte.
`bits` is the least that the vocabulary needs. Any document is found from its end and the end before
it, and read by unpacking its blocks only.

Writing. Rows are range-partitioned and sorted by doc_id, so shard k holds smaller ids than shard
k + 1; their number follows the bytes of text (`shard_bytes` each). A task tokenises its rows and
writes its shard under a name of its own; the manifest, itself a table, names the files of the tasks
that succeeded, so retried and speculative tasks do no harm. Only counts of shards meet in one place.

Tokenising. Words of a text recur, so a worker remembers the ids of pieces between spaces or line
feeds, up to `REMEMBER` of them. No token spans white space and special tokens contain none, so
the ids of a text are those of its pieces in turn. A new piece is split once more: punctuation at its
end, after a Latin letter or digit, is always a token of its own, and lower case is what the vocabulary has, so the rest is looked up
in ASCII lower case. Pieces that might hold a special token are not split. This holds for
tokenizers that split words from punctuation and lower-case them, as word_bpe_49k.json does.

Nulls and ties. A null text is empty: its ids are the end id alone. Null doc_ids come first. Rows with
equal doc_id each get their own place, in any order among them. Ids are longs, or what casts to one; any other fails the job. An empty table gives no shard and no row.
"""

from __future__ import annotations

import math
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.llm.common import cut, new_path, small_batches, table

MAGIC, BLOCK, END = b"LEXPACK1", 4096, 1
HEAD = "<8s4I2Q"
REMEMBER = 300_000
#: Neither letters nor digits nor white space.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceTokenizer:
    """Ids of texts as little-endian uint32 bytes, from a tokenizers file; if narrow, and the vocabulary allows it, as uint16."""

    def __init__(self, path: str, narrow: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        vocabulary = self.inner.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self.kind = "<u2" if narrow and len(self.ends) <= 1 << 16 else "<u4"
        self.code, self.width = {"<u2": "H", "<u4": "I"}[self.kind], int(self.kind[2])
        self.known: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}

    @property
    def size(self) -> int:
        return self.inner.get_vocab_size(with_added_tokens=True)

    def ids(self, text: str) -> bytes:
        pieces = text.replace("\n", " ").split(" ")
        known = self.known
        new = set(pieces).difference(known)
        if not new:
            return b"".join(map(known.__getitem__, pieces))
        found = self._learn(new)
        known.update(found)
        out = b"".join(map(known.__getitem__, pieces))
        if len(known) > REMEMBER:  # what comes first, mostly the frequent, is remembered
            for p in found:
                del known[p]
        return out

    def _alone(self, piece: str) -> bytes:
        return array(self.code, self.inner.encode_batch_fast([piece], add_special_tokens=False)[0].ids).tobytes()

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words, each all letters: encoded as one text, cut after tokens that end a word."""
        every = array(self.code, self.inner.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids)
        last = np.flatnonzero(self.ends[np.frombuffer(every, self.kind)]) + 1 if words else []
        if len(last) != len(words):  # a letter that the tokenizer does not take for one
            return [self._alone(x) for x in words]
        data, cuts = every.tobytes(), [0, *(self.width * np.asarray(last)).tolist()]
        return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces that aren't known."""
        cores, parts = self.cores, []
        for p in pieces:
            if "<|" in p:
                parts.append((p, p, ""))
                continue
            core = p.rstrip(MARKS)
            if core and len(core) < len(p) and not (core[-1].isalnum() and core[-1] < "\u0250" and core[-1] != "\u0130"):
                core = p  # other signs, such as combining ones, form one token with the marks
            low = core.lower() if core.isascii() else core
            parts.append((p, p if low == p else low, p[len(core) :]))  # one string for both memories where it is the same
        new = list({x for _, core, marks in parts for x in (core, marks) if x not in cores})
        found: dict[str, bytes] = {}
        words = [x for x in new if x.isalpha()]
        found.update(zip(words, self._words(words), strict=True))
        found.update((x, self._alone(x)) for x in new if x not in found)
        ids = {p: (found.get(core) if core in found else cores[core]) + (found.get(marks) if marks in found else cores[marks]) for p, core, marks in parts}
        if len(cores) < REMEMBER:
            cores.update(found)
        return ids


def pack(ids: np.ndarray, bits: int) -> bytes:
    """The lowest `bits` bits of each id, one after another."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = (ids[:, None].astype(np.uint32) >> np.arange(bits, dtype=np.uint32)).astype(np.uint8) & 1
    return np.packbits(each, bitorder="little").tobytes()


def unpack(data: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    each = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (each.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


def shard_parts(doc_ids: list[int | None], every: np.ndarray, counts: list[int], bits: int, block: int = BLOCK) -> list[bytes]:
    """The bytes of a shard file, in pieces; every: the ids of all documents, counts: how many each has."""
    ends = np.cumsum(counts, dtype=np.uint64)
    if every.dtype == np.uint16 and bits == 16:  # packed already: the blocks are views
        blocks = [every[i : i + block].astype("<u2", copy=False).view(np.uint8).data for i in range(0, len(every), block)]
    else:
        blocks = [pack(every[i : i + block], bits) for i in range(0, len(every), block)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    names = np.array([x or 0 for x in doc_ids], "<i8")
    known = np.array([x is not None for x in doc_ids], np.uint8)
    head = struct.pack(HEAD, MAGIC, bits, block, len(blocks), 0, len(every), len(doc_ids))
    return [head, offsets.tobytes(), names.tobytes(), known.tobytes(), ends.astype("<u8").tobytes(), *blocks]


def encode_shard(doc_ids: list[int | None], ids: list[bytes], bits: int, block: int = BLOCK) -> bytes:
    return b"".join(shard_parts(doc_ids, np.frombuffer(b"".join(ids), "<u4"), [len(x) // 4 for x in ids], bits, block))


class Shard:
    """Random access to the documents of a shard file held in data."""

    def __init__(self, data: bytes):
        magic, self.bits, self.block, blocks, _, self.n_ids, n = struct.unpack_from(HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = struct.calcsize(HEAD)
        take = lambda kind, k: np.frombuffer(data, kind, k, at)
        self.offsets = take("<u8", blocks + 1).astype(np.int64)
        at += 8 * (blocks + 1)
        self.doc_ids = take("<i8", n)
        at += 8 * n
        self.known = take(np.uint8, n).astype(bool)
        at += n
        self.ends = take("<u8", n).astype(np.int64)
        self.data, self.first = memoryview(data), at + 8 * n

    def __len__(self) -> int:
        return len(self.ends)

    def read(self, start: int, end: int) -> np.ndarray:
        """Ids start..end-1 of the shard."""
        if start >= end:
            return np.empty(0, np.uint32)
        a, b = start // self.block, (end - 1) // self.block
        found = [unpack(self.data[self.first + self.offsets[k] : self.first + self.offsets[k + 1]], min(self.block, self.n_ids - k * self.block), self.bits) for k in range(a, b + 1)]
        return np.concatenate(found)[start - a * self.block : end - a * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.read(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))


def _writer(folder: str, path: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the ids of a whole shard are held as narrow as they can be
        tokenizer, names, counts, ids = PieceTokenizer(path, narrow=True), [], [], bytearray()
        bits, end = max(1, math.ceil(math.log2(tokenizer.size))), np.array([END], tokenizer.kind).tobytes()
        for batch in batches:
            names += batch.column(0).to_pylist()
            for x in batch.column(1):
                before = len(ids)
                ids += tokenizer.ids(x.as_py() or "")
                ids += end
                counts.append((len(ids) - before) // tokenizer.width)
        if names:
            shard = TaskContext.get().partitionId()
            store, root = _store(folder)
            store.create_dir(root, recursive=True)
            name = f"shard-{shard:06d}-{uuid.uuid4().hex}.bin"
            with store.open_output_stream(f"{root}/{name}") as out:
                for part in shard_parts(names, np.frombuffer(ids, tokenizer.kind), counts, bits):
                    out.write(part)
            row = {"shard": [shard], "file": [f"{folder}/{name}"], "docs": [len(names)], "ids": [sum(counts)]}
            yield pa.RecordBatch.from_pydict(row, pa.schema([("shard", pa.int64()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    return write


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, shard_bytes: int = 32 << 20) -> DataFrame:
    """Write shard files of docs (doc_id, text) to folder; the manifest: shard, file, docs, ids, start."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange(max(1, math.ceil(size / shard_bytes)), "doc_id").sortWithinPartitions("doc_id")
    # else a shard's whole text is one batch, held beside its ids
    with small_batches(docs.sparkSession):
        made = cut(rows.mapInArrow(_writer(folder, tokenizer), "shard long, file string, docs long, ids long"), "token-manifest")
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return made.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


_ROWS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            folder, _, name = file.rpartition("/")
            store, root = _store(folder)
            with store.open_input_file(f"{root}/{name}") as f:
                shard = Shard(f.read())
            starts = np.concatenate([[0], shard.ends[:-1]])
            for i in range(0, len(shard), 4096):
                part = slice(i, i + 4096)
                first, last = int(starts[part][0]), int(shard.ends[part][-1])
                ids = shard.read(first, last).astype("<u4").tobytes()
                crc = [zlib.crc32(ids[4 * (a - first) : 4 * (b - first)]) for a, b in zip(starts[part].tolist(), shard.ends[part].tolist(), strict=True)]
                names = pa.array(shard.doc_ids[part], pa.int64(), mask=~shard.known[part])
                yield pa.RecordBatch.from_arrays([names, pa.array(starts[part] + base), pa.array(shard.ends[part] - starts[part]), pa.array(crc, pa.int64())], schema=_ROWS)


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the shard files."""
    # one row is a whole shard: the rows are spread, a few to a task
    return manifest.select("file", "start").repartition(max(1, manifest.count())).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None) -> DataFrame:
    folder = folder or new_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, tokenizer or tokenizer_path()))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"))
