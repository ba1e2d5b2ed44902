"""Ids of a shard are held as narrow as the file has them."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexmill.llm import token_output as T
from lexmill.llm.common import BATCH_BYTES


def test_narrow_ids_are_the_same_ids():
    wide, narrow = T.PieceTokenizer(T.tokenizer_path()), T.PieceTokenizer(T.tokenizer_path(), narrow=True)
    for x in ("", "Two words.", "naïve “quotes” <|endoftext|> ++", "机器学习\n\tab  cd", "x" * 5000 + " y!!!"):
        a, b = np.frombuffer(wide.ids(x), "<u4"), np.frombuffer(narrow.ids(x), "<u2")
        assert a.tolist() == b.tolist()


def test_narrow_ids_give_the_same_file_without_copies():
    every = np.random.default_rng(1).integers(0, 49_408, 3 * T.BLOCK + 17)
    counts = [5, 0, len(every) - 5]
    wide, narrow = every.astype("<u4"), every.astype("<u2")
    parts = T.shard_parts([1, None, 3], narrow, counts, 16)
    assert b"".join(parts) == b"".join(T.shard_parts([1, None, 3], wide, counts, 16))
    assert all(np.shares_memory(np.frombuffer(x, np.uint8), narrow) for x in parts[5:]) and len(parts[5:]) == 4
    assert T.Shard(b"".join(parts)).document(2).tolist() == every[5:].tolist()


def test_a_shard_comes_in_small_batches(spark, monkeypatch, tmp_path):
    """3,000 texts of 10,000 bytes, a shard of 30 MB: its rows come in batches of 4 MB about, and the session's setting is left as it was."""

    def writer(folder, path):
        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_pydict({"shard": [0], "file": [""], "docs": [b.num_rows], "ids": [b.nbytes]}, pa.schema([("shard", pa.int64()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

        return sizes

    monkeypatch.setattr(T, "_writer", writer)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("0123456789"), 1000).alias("text"))
    before = spark.conf.get(BATCH_BYTES, None)
    got = T.write_tokens(docs, str(tmp_path), "").collect()
    assert sum(r.docs for r in got) == 3000 and max(r.ids for r in got) < 5 << 20
    assert spark.conf.get(BATCH_BYTES, None) == before
