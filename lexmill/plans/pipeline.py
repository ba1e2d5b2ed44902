"""The whole way from books to vocabularies and translations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from lexmill.operators import lemmas, popularity, similarity, vocabulary
from lexmill.operators.joins import join_same
from lexmill.schemas import DEFAULT, Settings
from lexmill.sources.scratch import cut


def vocabulary_of(books: DataFrame, *stop_lists: DataFrame, settings: Settings = DEFAULT, mend: bool = False, dictionary: DataFrame | None = None) -> DataFrame:
    """(category, book, word, cnt, target) of books (category, book, text), stop words taken out, merges decided.

    dictionary (word, lemma): words are first replaced by their lemmas, those outside it by rules learnt from it.
    """
    words = vocabulary.word_counts(books, settings, mend)
    if dictionary is not None:
        words = lemmas.by_rules(words, dictionary)
    return similarity.merge_targets(vocabulary.without_stop_words(words, *stop_lists, settings=settings), settings)


def run(books: DataFrame, general: list[Column], settings: Settings = DEFAULT, mend: bool = False, dictionary: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables by name. general: for each stop list, which books it is made of; all other books are the subject; dictionary: as for vocabulary_of.

    First the general books are made into vocabularies of their own, whose words are the stop lists of the second pass. Both passes end in a
    table in the scratch folder, since what follows reads them several times.
    """
    is_general = general[0]
    for g in general[1:]:
        is_general = is_general | g
    first = cut(similarity.clustered(vocabulary_of(books.where(is_general), settings=settings, mend=mend, dictionary=dictionary)), "general-words")
    stop = [first.where(g).select("word").distinct() for g in general]
    subject = books.where(~is_general)
    targets = cut(vocabulary_of(subject, *stop, settings=settings, mend=mend, dictionary=dictionary), "subject-words")
    book_words = similarity.clustered(targets)
    union = vocabulary.union_of_books(book_words)
    return {
        "general_words": first,
        "book_words": book_words,
        "deleted_words": similarity.deleted(targets),
        "global_union": union,
        "word_intersection": vocabulary.intersection_of_books(book_words, subject),
        "popular_words": popularity.popular_words(union, settings),
    }


def refreshed(old: dict[str, DataFrame], book_words: DataFrame, books: DataFrame, done: DataFrame) -> dict[str, DataFrame]:
    """The aggregates of `old` after the books in done (category, ...) were added to book_words and books.

    Those of categories in done are made anew from the tables of books; the others stay.
    """
    touched = done.select("category").distinct()
    mine = lambda df: join_same(df, touched, ["category"], "left_semi")
    rest = lambda df: join_same(df, touched, ["category"], "left_anti")
    now = {"global_union": vocabulary.union_of_books(mine(book_words)), "word_intersection": vocabulary.intersection_of_books(mine(book_words), mine(books))}
    return {name: rest(old[name]).unionByName(now[name]) for name in now}
