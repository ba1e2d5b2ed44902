"""What line-break repair costs where there is little to repair."""

import random
import time

from pyspark.sql import functions as F

from lexmill.functions import text as X


def test_letters_without_a_break_are_passed_by_one_look(spark):
    """The eight steps over long texts take no more than a few times what eight patterns take that stop at each letter."""
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 12))) for _ in range(500)]
    texts = [" ".join(rng.choice(words) for _ in range(4000)) + "-\n tail" for _ in range(64)]
    docs = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4).cache()
    docs.count()
    plain = F.col("t")
    for i in range(8):
        plain = F.regexp_replace(plain, F.lit(f"[^a-z]\x01{i}"), F.lit(""))

    def took(column) -> float:
        best = []
        for _ in range(4):
            began = time.time()
            docs.select(column.alias("m")).write.format("noop").mode("overwrite").save()
            best.append(time.time() - began)
        return min(best)

    base, mended = took(plain), took(X.mend_breaks(F.col("t")))
    docs.unpersist()
    print(f"plain {base:.2f} s, mended {mended:.2f} s, {mended / base:.1f} times")
    assert mended < 6 * base


def test_tails_are_no_heads(spark):
    """Breaks one after another: what one took as its tail doesn't join the next, in each of the ways."""
    rng = random.Random(6)
    gaps = ["-\n", " - ", "-  \n ", " -\n", "\n  ", "\r\n ", " \n\n", "\n", ".\n\n", "\n\n\n", "- "]
    runs = ["a", "bc", "def", "ghij", "klmno", "pqrstu", "vwxyzab", "o" * 8, "n" * 9, "m" * 10, "l" * 11, "k" * 14, "я" * 15, "x" * 16, "y" * 24, "Z" * 25, "é", "9", ""]
    texts = ["".join(rng.choice(runs) + rng.choice(gaps) for _ in range(rng.randint(2, 9))) + rng.choice(runs) for _ in range(8000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4).select("t", X.mend_breaks(F.col("t")).alias("m")).collect()
    assert [r for r in rows if r.m != X.mend(r.t)] == []
