"""Word frequencies, stop words, and vocabularies of categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators.joins import join_same
from lexmill.schemas import DEFAULT, Settings


def _tokens(books: DataFrame, settings: Settings, mend: bool) -> DataFrame:
    text = X.mend_breaks(F.lower("text")) if mend else F.col("text")
    return X.each(books, "category", "book", word=X.words_of(text, settings))


def word_counts(books: DataFrame, settings: Settings = DEFAULT, mend: bool = False) -> DataFrame:
    """(category, book, word, cnt) of books (category, book, text); mend: repair broken lines first."""
    return _tokens(books, settings, mend).groupBy("category", "book", "word").agg(F.count("*").alias("cnt"))


def category_counts(books: DataFrame, settings: Settings = DEFAULT, mend: bool = False) -> DataFrame:
    """(category, word, cnt): union_of_books() of all of books' words, without their counts by book in between."""
    return _tokens(books, settings, mend).groupBy("category", "word").agg(F.count("*").alias("cnt"))


def without_stop_words(words: DataFrame, *lists: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """words less those in any of the lists (word); no list applies where one of several is missing (empty)."""
    if not lists:
        return words
    if settings.require_both_stop_lists and any(x.limit(1).isEmpty() for x in lists):
        return words
    stop = lists[0].select("word")
    for x in lists[1:]:
        stop = stop.unionByName(x.select("word"))
    return words.join(stop.distinct(), "word", "left_anti").select(*words.columns)


def union_of_books(words: DataFrame) -> DataFrame:
    """(category, word, cnt): counts of all books of a category together."""
    return words.groupBy("category", "word").agg(F.sum("cnt").alias("cnt"))


def intersection_of_books(words: DataFrame, books: DataFrame) -> DataFrame:
    """(category, word, cnt) of words that occur in every one of a category's books, where it has two or more.

    books (category, book) names all books, including those of which no word is left.
    """
    per_category = books.select("category", "book").distinct().groupBy("category").agg(F.count("*").alias("_books"))
    in_books = words.groupBy("category", "word").agg(F.sum("cnt").alias("cnt"), F.count_distinct("book").alias("_in"))
    return join_same(in_books, per_category, ["category"]).where("_books >= 2 and _in = _books").select("category", "word", "cnt")


def is_general(path: Column, mark: str = "non_science") -> Column:
    """The two passes: general books first, then the others, told apart by their path."""
    return path.contains(mark)
