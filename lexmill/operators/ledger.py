"""Which books are done: ledgers of categories, pending work and marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators.translation import upserted
from lexmill.schemas import LEDGER
from lexmill.sources import files
from lexmill.sources.stored import StoredTable


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def initialised(spark: SparkSession, root: str, folder: str) -> dict[str, StoredTable]:
    """A stored ledger in folder for each category of the text tree under root; those that are there already keep their rows.

    A root that isn't a folder, or holds no category, has none.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not (fs.exists(path) and fs.isDirectory(path)):
        return {}
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("_metadata")
    names = files.initial_categories(raw.select(files.relative_path(spark, root).alias("path")))
    out = {}
    for r in names.orderBy("category").toLocalIterator():  # a name for each folder
        out[r["category"]] = StoredTable(spark, f"{folder.rstrip('/')}/{r['category']}", LEDGER)
        if not out[r["category"]].versions():
            out[r["category"]].commit(empty_ledger(spark))
    return out


def pending(books: DataFrame, ledger: DataFrame) -> DataFrame:
    """books (book_path, ...) that aren't in the ledger."""
    return books.join(ledger.select("book_path"), "book_path", "left_anti").select(*books.columns)


def marked(ledger: DataFrame, done: DataFrame) -> DataFrame:
    """The ledger with done (book_path, word_count) written over what it had of these books."""
    now = done.select("book_path", F.current_timestamp().alias("processed_at"), F.col("word_count").cast("long").alias("word_count"), F.lit(None).cast("string").alias("hash"))
    return upserted(ledger, now, ["book_path"])
