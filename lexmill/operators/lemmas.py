"""Lemmas: by a dictionary table, by rules learnt from one, or by a plug-in that each worker loads once.

A rule puts one ending in the place of another. Each pair of the dictionary tells what follows the letters that word and lemma begin with, and says
so with up to three of these letters as well, so that a rule for `-ies` need not be that for `-s`. Of the rules for one ending the most frequent holds; a
word takes the rule of its longest ending that has one. Pairs that are equal are rules, too: they keep endings as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as X

#: Makes a function from word to lemma for a language; called once per task, so it may load a model.
Lemmatiser = Callable[[str], Callable[[str], str]]
LANGUAGES = ("ru", "en")


def _counted(words: DataFrame) -> DataFrame:
    return words.groupBy("category", "book", "word").agg(F.sum("cnt").alias("cnt"))


def by_dictionary(words: DataFrame, lemmas: DataFrame) -> DataFrame:
    """words (category, book, word, cnt) by their lemma in lemmas (word, lemma), one per word; others stay as they are."""
    found = words.join(lemmas.select("word", "lemma"), "word", "left")
    return _counted(found.select("category", "book", F.coalesce("lemma", "word").alias("word"), "cnt"))


#: Letters before the change that a rule may look at; letters of an ending; times that a rule must have been seen; letters that are left of a word before its ending.
CONTEXT, ENDING, SEEN, STEM = 3, 8, 2, 2


def suffix_rules(dictionary: DataFrame, context: int = CONTEXT, longest: int = ENDING, seen: int = SEEN) -> DataFrame:
    """(ending, put, n) learnt from dictionary (word, lemma): for each ending what most often takes its place (ties: the first in the alphabet)."""
    shorter = F.least(F.length("word"), F.length("lemma"))
    same = F.size(F.filter(F.sequence(F.lit(1), F.greatest(shorter, F.lit(1))), lambda i: F.left("word", i) == F.left("lemma", i)))
    pairs = dictionary.where("word <> '' and lemma <> ''").select("word", "lemma", same.alias("same"))
    each = pairs.select("word", "lemma", F.explode(F.sequence(F.greatest(F.col("same") - context, F.lit(0)), F.col("same"))).alias("from"))
    ends = each.select(F.substring("word", F.col("from") + 1, F.length("word")).alias("ending"), F.substring("lemma", F.col("from") + 1, F.length("lemma")).alias("put"))
    counts = ends.where(F.length("ending") <= longest).groupBy("ending", "put").agg(F.count("*").alias("n"))
    best = counts.groupBy("ending").agg(F.min(F.struct((-F.col("n")).alias("n"), "put")).alias("r"))
    return best.select("ending", "r.put", (-F.col("r.n")).alias("n")).where(F.col("n") >= seen)


def guessed(words: DataFrame, rules: DataFrame, longest: int = ENDING, stem: int = STEM) -> DataFrame:
    """(word, lemma) of words (word: distinct) that a rule applies to: that of the longest ending."""
    sizes = F.filter(F.sequence(F.lit(0), F.lit(longest)), lambda k: k <= F.length("word") - stem)
    tried = X.each(words.select("word"), "word", size=sizes).withColumn("ending", F.right("word", F.col("size")))
    best = tried.join(rules.select("ending", "put"), "ending").groupBy("word").agg(F.max_by(F.struct("size", "put"), "size").alias("r"))
    return best.select("word", F.concat(F.left("word", F.length("word") - F.col("r.size")), "r.put").alias("lemma"))


def by_rules(words: DataFrame, dictionary: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """words by their lemma in dictionary (word, lemma), one per word, those outside it by rules, by default those learnt from it."""
    unknown = words.select("word").distinct().join(dictionary.select("word"), "word", "left_anti")
    found = guessed(unknown, suffix_rules(dictionary) if rules is None else rules)
    return by_dictionary(words, dictionary.select("word", "lemma").unionByName(found))


def by_function(words: DataFrame, lemmatiser: Lemmatiser, language: str) -> DataFrame:
    """The same by a plug-in, which sees every different word once."""
    if language not in LANGUAGES:
        raise ValueError(f"no lemmas for {language!r}; languages are {', '.join(LANGUAGES)}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lemma = lemmatiser(language)
        for frame in frames:
            yield frame.assign(lemma=frame["word"].map(lemma))

    return by_dictionary(words, words.select("word").distinct().mapInPandas(run, "word string, lemma string"))
