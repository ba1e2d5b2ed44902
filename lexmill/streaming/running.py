"""Vocabularies of categories kept up to date as books come.

Three things are kept in a folder. `words`: per category and word the count and the number of books it is in, so that both the summed union and the
words of all books can be read off it. `books`: the ledger, one row a file, with its category and book. `book_words`: the words of
every batch's books, by batch, which is only read again where a file comes for a book that is there already, since its
words must not count as another book's.

A batch is applied once. Its number is noted with the rows of `words` and with those of `books`, each changed in one step, words
first: a batch that failed between them is found to have changed the words and then only enters the ledger; one that is
repeated as a whole changes nothing. New counts are those of the batch alone, added to the kept ones, so earlier texts are
never read again; what is rewritten is one row for each category and word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexmill.operators import vocabulary
from lexmill.operators.joins import join_same
from lexmill.schemas import DEFAULT, Settings
from lexmill.sources.stored import StoredTable

_BOOK = ["category", "book"]


class RunningVocabulary:
    def __init__(self, spark: SparkSession, folder: str, settings: Settings = DEFAULT, mend: bool = True) -> None:
        self.spark, self.folder, self.settings, self.mend = spark, folder.rstrip("/"), settings, mend
        self.words = StoredTable(spark, f"{self.folder}/words", "category string, word string, cnt long, books long")
        self.books = StoredTable(spark, f"{self.folder}/books", "book_path string, category string, book string")

    def _batch_words(self, number: int, new: DataFrame) -> DataFrame:
        """(category, book, word, cnt) of a batch's new files; written to its own folder, over what a try before has left."""
        path = f"{self.folder}/book_words/batch={number}"
        counted = vocabulary.word_counts(new, self.settings, self.mend)
        counted.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(counted.schema).parquet(path)

    def apply(self, batch: DataFrame, number: int) -> None:
        """Add the files of batch (book_path, category, book, text) that aren't in the ledger; numbers rise from batch to batch.

        Rows with one book_path are one file, so it should come whole, in one batch.
        """
        if self.books.pointer()["notes"].get("batch", -1) >= number:
            return
        done = self.books.read()
        new = batch.join(done.select("book_path"), "book_path", "left_anti")
        if self.words.pointer()["notes"].get("batch", -1) < number:
            counted = self._batch_words(number, new)
            first = counted.withColumn("_first", F.lit(1).cast("long"))
            known = join_same(counted.select(*_BOOK).distinct(), done.select(*_BOOK).distinct(), _BOOK, "left_semi")
            if not known.isEmpty():
                every = self.spark.read.schema(counted.schema.add("batch", "long")).parquet(f"{self.folder}/book_words").where(F.col("batch") < number)
                before = join_same(every, known, _BOOK, "left_semi").select(*_BOOK, "word").distinct().withColumn("_seen", F.lit(1))
                first = join_same(counted, before, [*_BOOK, "word"], "left").withColumn("_first", F.when(F.col("_seen").isNull(), 1).otherwise(0).cast("long"))
            delta = first.select("category", "word", "cnt", F.col("_first").alias("books"))
            both = self.words.read().unionByName(delta)
            self.words.commit(both.groupBy("category", "word").agg(F.sum("cnt").alias("cnt"), F.sum("books").alias("books")), batch=number)
        self.books.commit(done.unionByName(new.select("book_path", *_BOOK).dropDuplicates(["book_path"])), batch=number)

    def union(self) -> DataFrame:
        """(category, word, cnt), as union_of_books has it."""
        return self.words.read().select("category", "word", "cnt")

    def intersection(self) -> DataFrame:
        """(category, word, cnt), as intersection_of_books has it, without counting anew."""
        per_category = self.books.read().select(*_BOOK).distinct().groupBy("category").agg(F.count("*").alias("_books"))
        return join_same(self.words.read(), per_category, ["category"]).where("_books >= 2 and books = _books").select("category", "word", "cnt")

    def follow(self, books: DataFrame, checkpoint: str) -> StreamingQuery:
        """Apply a stream of books, as book_stream has it, batch by batch."""
        return books.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
