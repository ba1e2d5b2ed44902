"""Books as they come: a file stream into the word table, each book once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexmill.operators import vocabulary
from lexmill.sources import files

FILES = "book_path string, text string"


def book_stream(spark: SparkSession, root: str) -> DataFrame:
    """(book_path, category, book, text) of text files under root, new ones as they appear."""
    raw = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(root)
    return files.text_files(raw, root)


def write_words(books: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Count the words of each batch of books into folder/batch=n; the checkpoint is the ledger of books done.

    A batch that is tried again writes over its own folder, so each book counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        vocabulary.word_counts(batch, mend=True).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return books.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
