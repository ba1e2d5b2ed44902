"""Main language of a book: samples, a detector, a vote.

Detectors: a plug-in; a model of letter trigrams that is fitted on words of known language; frequent short words, where there is neither.

The model is a table. A word has the trigrams of itself between two marks, so grams are counted over vocabularies and not over texts: each
different word is taken apart once, weighed by its count. A language's score of a text is the sum of ln((c + 1) / (N + V)) over its grams, in
thousandths rounded down, c being the gram's count in the language, N that of all its grams, V the number of different grams. Only the grams that a
language has are rows; all others score alike, so they come in as the text's number of grams.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators.joins import join_same
from lexmill.sources.scratch import cut


def samples(books: DataFrame, count: int = 10, length: int = 1000, seed: int = 0) -> DataFrame:
    """(category, book, sample): pieces of each text at places given by a hash, line feeds taken out."""
    where = lambda i: F.pmod(F.xxhash64("text", F.lit(seed) + i), F.greatest(F.length("text") - length, F.lit(1)).cast("long")).cast("int") + 1
    pieces = F.transform(F.sequence(F.lit(1), F.lit(count)), lambda i: F.replace(F.substring(F.col("text"), where(i), F.lit(length)), F.lit("\n"), F.lit("")))
    return books.where("text is not null").select("category", "book", F.explode(pieces).alias("sample"))


def byte_windows(books: DataFrame, count: int = 10, size: int = 1000, seed: int = 0) -> DataFrame:
    """(category, book, sample): windows of so many bytes at hashed offsets, without the characters cut off at their ends, and without line feeds.

    A text of no more bytes is its own window, each time. Windows that are blank are left out.
    """
    raw = F.encode("text", "UTF-8")
    at = lambda i: F.pmod(F.xxhash64("text", F.lit(seed) + i), F.greatest(F.octet_length("text") - size + 1, F.lit(1)).cast("long")).cast("int") + 1
    whole = lambda w: F.regexp_replace(F.make_valid_utf8(w.cast("string")), "^\uFFFD{1,3}|\uFFFD{1,3}$", "")
    pieces = F.transform(F.sequence(F.lit(1), F.lit(count)), lambda i: F.replace(whole(F.substring(raw, at(i), F.lit(size))), F.lit("\n"), F.lit("")))
    found = books.where("text is not null").select("category", "book", F.explode(pieces).alias("sample"))
    return found.where(F.col("sample").rlike(r"(?U)\S"))


@dataclass
class LanguageModel:
    """grams (gram, language, gain), gain what a gram scores above one that the language doesn't have; base: what that one scores, by language."""

    grams: DataFrame
    base: dict[str, int]


def _grams(word: Column) -> Column:
    marked = F.concat(F.lit("_"), word, F.lit("_"))
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(marked, i, F.lit(3)))


def fit(words: DataFrame) -> LanguageModel:
    """The model of words (language, word, cnt); rows without a language are left out."""
    known = words.where("language is not null and word <> ''").groupBy("language", "word").agg(F.sum("cnt").alias("cnt"))
    counts = X.each(known, "language", "cnt", gram=_grams(F.col("word"))).groupBy("language", "gram").agg(F.sum("cnt").alias("c"))
    counts = cut(counts, "language-grams")
    kinds = counts.agg(F.count_distinct("gram")).first()[0]
    totals = counts.groupBy("language").agg(F.floor(1000 * F.ln((F.sum("c") + kinds).cast("double"))).cast("long").alias("base"))
    base = {r["language"]: -r["base"] for r in totals.collect()}  # a row for each language
    return LanguageModel(counts.select("gram", "language", F.floor(1000 * F.ln((F.col("c") + 1).cast("double"))).cast("long").alias("gain")), base)


def identify(texts: DataFrame, keys: list[str], model: LanguageModel) -> DataFrame:
    """keys and language of texts (keys, text), the texts of one key taken together; ties go to the first in the alphabet, und without words.

    Every different word is scored once, for all texts.
    """
    words = X.each(texts, *keys, word=F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).groupBy(*keys, "word").agg(F.count("*").alias("n"))
    words = cut(words, "language-words")
    each_word = X.each(words.select("word").distinct(), "word", gram=_grams(F.col("word")))
    every = texts.select(*keys).distinct()
    if not model.base:
        return every.select(*keys, F.lit("und").alias("language"))
    # a column for each language: rows would be shuffled once more for each of them
    languages = sorted(model.base.items())
    gain = [F.sum(F.when(F.col("language") == k, F.col("gain"))).alias(f"_gain{i}") for i, (k, _) in enumerate(languages)]
    gains = each_word.join(model.grams, "gram").groupBy("word").agg(*gain)
    grams = F.sum(F.col("n") * F.length("word"))
    score = lambda i, base: grams * base + F.coalesce(F.sum(F.col("n") * F.col(f"_gain{i}")), F.lit(0))
    options = [F.struct((-score(i, base)).alias("s"), F.lit(k).alias("l")) for i, (k, base) in enumerate(languages)]
    best = words.join(gains, "word", "left").groupBy(*keys).agg(F.array_min(F.array(*options))["l"].alias("language"))
    return join_same(every, best, keys, "left").select(*keys, F.coalesce("language", F.lit("und")).alias("language"))


def detect_by_model(pieces: DataFrame, model: LanguageModel) -> DataFrame:
    """(category, book, language) of every sample (category, book, sample); null where it has no word, so that it has no vote."""
    numbered = cut(pieces.select("category", "book", F.col("sample").alias("text"), F.monotonically_increasing_id().alias("_sample")), "language-samples")
    found = identify(numbered, ["category", "book", "_sample"], model)
    return found.select("category", "book", F.nullif("language", F.lit("und")).alias("language"))


#: Frequent short words by which the built-in detector knows a language; a parameter.
FREQUENT = {
    "de": "der die und das nicht ist von mit ein auch", "en": "the of and to in that is was for with", "es": "el los las que una por con para del como",
    "fr": "le les des est que une dans pour qui pas", "ru": "и в не на что он как это по из",
}


def by_frequent_words(text: Column, frequent: dict[str, str] = FREQUENT) -> Column:
    """The language most of whose frequent words a text has (ties: the first in the alphabet), null if it has none."""
    words = F.regexp_extract_all(F.lower(text), F.lit(X.WORD), F.lit(0))
    hit = lambda own: -F.size(F.filter(words, lambda w: w.isin(*own.split())))
    hits = F.array(*[F.struct(hit(own).alias("n"), F.lit(k).alias("language")) for k, own in sorted(frequent.items())])
    best = F.array_min(hits)
    return F.when(best["n"] < 0, best["language"])


def detect(pieces: DataFrame, detector: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """(category, book, language) of every sample: by a plug-in (its answers may be of the form __label__xx), or by frequent words."""
    found = F.pandas_udf(detector, "string")(F.col("sample")) if detector else by_frequent_words(F.col("sample"))
    return pieces.select("category", "book", F.replace(found, F.lit("__label__"), F.lit("")).alias("language"))


def vote(found: DataFrame, keys: list[str], column: str = "language") -> DataFrame:
    """keys and language: the most frequent one that isn't null (ties: the first in the alphabet), und without any."""
    counts = found.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("n"))
    best = counts.groupBy(*keys).agg(F.min(F.struct(-F.col("n"), F.col(column).alias("l")))["l"].alias("language"))
    every = found.select(*keys).distinct()
    return join_same(every, best, keys, "left").select(*keys, F.coalesce("language", F.lit("und")).alias("language"))
