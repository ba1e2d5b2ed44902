import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexmill.llm import resampling as R

DOCS = "doc_id long, text string, score string, bucket int"


def words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def buckets(text, n, m):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % m for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def plain(docs, target, n=1, m=10_000, percent=10, least=20):
    mine, theirs = [buckets(t, n, m) for _, t in docs], Counter(b for t in target for b in buckets(t, n, m))
    s = Counter(b for x in mine for b in x)
    big_s, big_t = sum(s.values()), sum(theirs.values())
    gain = lambda b: math.floor(1000 * math.log((theirs[b] + 1) * (big_s + m) / ((s[b] + 1) * (big_t + m))))
    out = []
    for (i, text), x in zip(docs, mine, strict=True):
        weight = sum(map(gain, x)) // len(x) if x else 0
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words(text))])
    enough = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(enough[: len(enough) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("seed,n,m,percent", [(0, 1, 10_000, 10), (1, 2, 50, 35), (2, 3, 7, 100)])
def test_against_plain_python(spark, seed, n, m, percent):
    rng = random.Random(seed)
    some = ["The", "the", "straße", "ÉTÉ", "x9", "naïve", "日本", "a", "b-c", "\x00d", "I", "İ", "Σας"]
    text = lambda: rng.choice([None, "", "...", *[" ".join(rng.choices(some, k=rng.choice([3, 19, 20, 60]))) for _ in range(9)]])
    docs = [(rng.choice([None, i, i, i, 7]), text()) for i in range(150)]
    docs += [docs[3]] * 3 + [(5, " ".join(["the"] * 3000))] * 40
    target = [text() for _ in range(10)]
    df = spark.createDataFrame([(i, t, "mine", 1) for i, t in docs], DOCS)
    how = dict(n=n, buckets=m, percent=percent)
    got = R.importance_sample(df.repartition(5), spark.createDataFrame([(t,) for t in target], "text string"), **how)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, target, n, m, percent)


def test_drawn_rows_keep_their_columns(spark):
    docs = [(i, "w%d " % (i % 3) * 25) for i in range(60)]
    df = spark.createDataFrame([(i, t, f"mine{i}", i) for i, t in docs], DOCS)
    target = spark.createDataFrame([("w1 w1 w1",)], "text string")
    rows = R.resampled(df, target, percent=20)
    assert rows.columns == df.columns
    drawn = {r[0] for r in plain(docs, ["w1 w1 w1"], percent=20) if r[4]}
    assert {tuple(r) for r in rows.collect()} == {(i, t, f"mine{i}", i) for i, t in docs if i in drawn} and len(drawn) == 12


def test_empty_tables(spark):
    none, target = spark.createDataFrame([], DOCS), spark.createDataFrame([("a b",)], "text string")
    assert R.importance_sample(none, target).count() == 0
    docs = [(i, "a b c d e " * 5) for i in range(20)]
    got = R.importance_sample(spark.createDataFrame([(i, t, None, None) for i, t in docs], DOCS), target.where(F.lit(False)))
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, [])
    nulls = spark.createDataFrame([(None, None, None, None)] * 3, DOCS)
    assert [r.rank for r in R.importance_sample(nulls, target).collect()] == [None] * 3


def test_draws_are_like_the_target(spark):
    docs = [(i, " ".join([("near" if i % 10 == 0 else "far") + str(j % 4) for j in range(30)])) for i in range(500)]
    df = spark.createDataFrame([(i, t, None, None) for i, t in docs], DOCS)
    target = spark.createDataFrame([("near0 near1 near2 near3 " * 20,)], "text string")
    drawn = [r.doc_id for r in R.importance_sample(df, target).where("rank is not null").collect()]
    assert len(drawn) == 50 and sum(i % 10 == 0 for i in drawn) >= 40
