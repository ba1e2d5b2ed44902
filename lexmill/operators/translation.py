"""Translation of popular words with a cache in both directions, and its tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators.joins import join_same
from lexmill.operators.ranking import ranked_in_ranges
from lexmill.schemas import DEFAULT, Settings

#: Translates words from one language to another, in order; may raise.
Translator = Callable[[list[str], str, str], list[str]]


def batches(words: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """words (word, cnt) with source and target language and the number of their request, from 0, within a direction."""
    routed = words.select("word", "cnt", X.script_language(F.col("word")).alias("src_lang"), X.other_language(F.col("word")).alias("tgt_lang"))
    numbered = ranked_in_ranges(routed, ["src_lang", "tgt_lang"])
    return numbered.select("word", "cnt", "src_lang", "tgt_lang", F.floor((F.col("rn") - 1) / settings.translate_batch).cast("long").alias("batch"))


def cached(words: DataFrame, cache: DataFrame) -> DataFrame:
    """words with their valid translations in the cache (word, translation)."""
    return words.join(cache.select("word", "translation"), "word").where(X.valid_translation(F.col("word"), F.col("translation")))


def missing(words: DataFrame, cache: DataFrame) -> DataFrame:
    return words.join(cache.select("word"), "word", "left_anti").select(*words.columns)


#: What a response is read as; its other members are left out.
RESPONSE = "translations array<struct<text:string>>"


def requests(words: DataFrame, settings: Settings = DEFAULT, **constant: str) -> DataFrame:
    """(src_lang, batch, words, body): a JSON body for each request of words (word, cnt); constant: members that all bodies begin with, such as the folderId."""
    numbered = batches(words, settings)
    grouped = numbered.groupBy("src_lang", "tgt_lang", "batch").agg(F.array_sort(F.collect_list(F.struct((-F.col("cnt")).alias("c"), "word"))).alias("of"))  # translate_batch at most
    found = grouped.select("src_lang", "tgt_lang", "batch", F.transform("of", lambda x: x["word"]).alias("words"))
    members = [F.lit(v).alias(k) for k, v in constant.items()]
    return found.select("src_lang", "batch", "words", F.to_json(F.struct(*members, F.col("words").alias("texts"), F.col("tgt_lang").alias("targetLanguageCode"))).alias("body"))


def answered(asked: DataFrame, responses: DataFrame) -> DataFrame:
    """(word, translation) of requests and responses (src_lang, batch, body); all words of a request get the mark of failure if
    its response isn't there, can't be read, or has another number of translations; a word whose text isn't there gets it alone."""
    read = F.from_json("body", RESPONSE)["translations"]
    came = responses.select("src_lang", "batch", read.alias("texts"))
    both = asked.select("src_lang", "batch", "words").join(came, ["src_lang", "batch"], "left")
    fits = F.coalesce(F.size("texts") == F.size("words"), F.lit(False))
    pairs = F.transform("words", lambda w, i: F.struct(w.alias("word"), F.coalesce(F.when(fits, F.get("texts", i)["text"]), F.lit(X.BROKEN)).alias("translation")))
    return both.select(F.explode(pairs).alias("p")).select("p.*")


def translate(words: DataFrame, translator: Translator, settings: Settings = DEFAULT) -> DataFrame:
    """(word, translation) by a plug-in, one request per batch; what fails gets the mark of failure."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for (src, tgt), part in frame.groupby(["src_lang", "tgt_lang"], sort=False):
                for i in range(0, len(part), settings.translate_batch):
                    these = part["word"].iloc[i : i + settings.translate_batch].tolist()
                    try:
                        found = list(translator(these, src, tgt))
                    except Exception:  # a plug-in's failure is data here: it is marked and not cached
                        found = []
                    yield pd.DataFrame({"word": these, "translation": found if len(found) == len(these) else [X.BROKEN] * len(these)})

    return batches(words, settings).repartition("src_lang", "batch").select("word", "src_lang", "tgt_lang").mapInPandas(run, "word string, translation string")


def remembered(new: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows to add to the cache for new (seq, word, translation): both directions, the first of a key wins, what is cached stays."""
    good = new.where(X.valid_translation(F.col("word"), F.col("translation")))
    both = good.select(F.explode(F.array(
        F.struct((2 * F.col("seq")).alias("at"), F.col("word").alias("word"), F.col("translation").alias("translation")),
        F.struct((2 * F.col("seq") + 1).alias("at"), F.col("translation").alias("word"), F.col("word").alias("translation")),
    )).alias("r")).select("r.*")
    first = both.groupBy("word").agg(F.min_by("translation", "at").alias("translation"))
    return first.join(cache.select("word"), "word", "left_anti").select("word", "translation")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with the same keys."""
    return join_same(old, new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def with_translation(words: DataFrame, translations: DataFrame, word: str | Column | None = None) -> DataFrame:
    """words with their translation, or null; of one word only if given."""
    found = words.join(translations.select("word", "translation"), "word", "left")
    return found if word is None else found.where(F.col("word") == word)


def first_translation(words: DataFrame, translations: DataFrame, word: str) -> DataFrame:
    """The first row of a word by its other columns, with its translation: one row, or none."""
    found = with_translation(words, translations, word)
    return found.orderBy(*[c for c in found.columns if c != "word"]).limit(1)
