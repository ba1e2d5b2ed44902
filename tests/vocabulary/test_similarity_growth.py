"""What words of one beginning cost: how many meet, and how often their distance is taken."""

import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators import similarity as S
from tests.vocabulary.test_similarity import WORDS, close_words


def test_distance_is_written_once(spark):
    """Spark makes what a condition has twice before the rest of it, so a cheaper test before it would save nothing."""
    assert S.alike(F.col("a"), F.col("b"))._jc.toString().count("levenshtein") == 1


def test_words_meet_by_rests(spark):
    rng = random.Random(1)
    names = sorted({"abcd" + "".join(rng.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(1500)})
    assert S.met_pairs(spark.createDataFrame([("c", "b", w, 1) for w in names], WORDS)).count() < len(names) ** 2 / 2 / 500


@pytest.mark.parametrize("tasks", [1, 3])
def test_rests_of_words_are_not_shuffled(spark, tasks):
    words = spark.createDataFrame([("c", "b", w, 1) for w in close_words(random.Random(3), "abcd", 60)], WORDS)
    met = S.met_pairs(words, tasks=tasks).distinct()
    assert met._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_pairs_are_the_same_where_rests_are_dealt_out(spark):
    rng = random.Random(5)
    words = spark.createDataFrame([("c", b, w, rng.randint(1, 3)) for b in (None, "b") for w in close_words(rng, "abc", 60)], WORDS)
    rows = lambda *bounds: sorted(map(tuple, S.similar_pairs(words, S.DEFAULT, *bounds).collect()), key=repr)
    want = rows()
    assert rows(0, 0) == want == rows(0, 50) and len(want) > 50


def test_more_pairs_are_grouped_by_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(S, "PAIRS_A_TASK", 20, raising=False)
    words = spark.createDataFrame([("c", "b", w, 1) for w in close_words(random.Random(5), "abc", 60)], WORDS)
    pairs = S.similar_pairs(words)
    assert S.components(pairs).rdd.getNumPartitions() == -(-pairs.count() // 20) > 4
