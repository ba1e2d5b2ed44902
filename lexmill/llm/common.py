"""What the training-data operators share: tables, `let`, small batches; scratch tables and connected components are the core's."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators.graphs import connected_components  # noqa: F401
from lexmill.sources.files import spread
from lexmill.sources.scratch import cut, drop_table, new_path, shared_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; documents and pages that are read from fewer pieces than there are cores are dealt out over them."""
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(found) if name in ("documents", "pages") else found


#: Arrow's batches go by this setting of the session, in bytes.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, most: int = 4 << 20) -> Iterator[None]:
    """What runs inside hands rows to Python workers in batches of about `most` bytes, or one row; the session's own setting is back afterwards.

    A batch is held by the JVM, outside its heap and twice while it grows, and by the worker. 10,000 texts, as many as Spark takes, are some 34 MB of the test data.
    """
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, str(most))
    try:
        yield
    finally:
        spark.conf.unset(BATCH_BYTES) if before is None else spark.conf.set(BATCH_BYTES, before)


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, however often the body refers to it."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; the plain lower() is the same for text that is all ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) > F.char_length(text), F.translate(text, upper, upper.lower())).otherwise(F.lower(text))
