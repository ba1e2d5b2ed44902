"""The most popular words of a category: those that cover a share of all its occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators.joins import join_same
from lexmill.operators.ranking import ranked_in_ranges
from lexmill.schemas import DEFAULT, Settings


def running_coverage(words: DataFrame) -> DataFrame:
    """(category, word, cnt, rn, running, n, total) by falling count."""
    return ranked_in_ranges(words, ["category"], totals=True)


def popular_words(words: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(category, word, cnt, rn) of words (category, word, cnt).

    The cut is the count at which the share `coverage` is reached, not before min_ratio and not after
    max_ratio of the words, and min_count at least; words of that count stay. If too few are left, the first min_ratio are taken.
    """
    all_words = running_coverage(words)
    coverage = min(max(settings.coverage, 0.1), 0.95)
    at_least = F.greatest(F.lit(1), F.floor(F.col("n") * settings.min_ratio))
    at_most = F.greatest(at_least, F.floor(F.col("n") * settings.max_ratio))
    bounded = all_words.withColumn("mn", at_least).withColumn("mx", at_most)
    reached = ((F.col("rn") >= F.col("mn")) & (F.col("running") >= F.col("total") * coverage)) | (F.col("rn") >= F.col("mx"))
    cut = bounded.where(reached).groupBy("category", "mn", "mx").agg(F.min(F.struct("rn", "cnt"))["cnt"].alias("at")).withColumn("cut", F.greatest(F.col("at"), F.lit(settings.min_count)))
    cut = cut.select("category", "mn", "mx", "cut")
    with_cut = join_same(all_words, cut, ["category"])
    several = with_cut.where("cnt >= cut").groupBy("category").agg(F.count("*").alias("k"))
    taken = join_same(with_cut, several, ["category"], "left").withColumn("np", F.least(F.coalesce("k", F.lit(0)), "mx"))
    return taken.where(F.col("rn") <= F.when(F.col("np") >= F.col("mn"), F.col("np")).otherwise(F.col("mn"))).select("category", "word", "cnt", "rn")
