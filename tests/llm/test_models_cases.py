"""The two classifiers: gradient and brute-force fit, repeated rows, ties, clashing columns, empty tables, texts without spaces."""

import math
import random

import numpy as np
import pytest

from lexmill.llm import language_id as L
from lexmill.llm import quality as Q


def problem(seed: int):
    rng = np.random.default_rng(seed)
    docs, features = 40, 6
    rows, cols = np.nonzero(rng.random((docs, features)) < 0.5)
    values = rng.integers(1, 3, len(rows)).astype(float)
    y = rng.integers(0, 3, docs)
    return rows, cols, values, y, np.full(docs, 1 / docs), rng.standard_normal(features + 2) / 2


def plain_loss(p, rows, cols, values, y, mass) -> float:
    """Document by document, from the definition."""
    n, total = len(p) - 2, 0.0
    cuts = [p[n], p[n] + math.exp(p[n + 1])]
    for i, grade in enumerate(y):
        score = sum(p[c] * v for r, c, v in zip(rows, cols, values, strict=True) if r == i)
        below = [0.0, *(1 / (1 + math.exp(score - c)) for c in cuts), 1.0]
        total -= mass[i] * math.log(below[grade + 1] - below[grade])
    return total


@pytest.mark.parametrize("seed", range(4))
def test_gradient_of_the_cumulative_link(seed):
    *data, p = problem(seed)
    loss, g = Q.loss_and_gradient(p, *data)
    assert loss == pytest.approx(plain_loss(p, *data))
    for i in range(len(p)):
        e = np.zeros_like(p)
        e[i] = 1e-5
        assert g[i] == pytest.approx((plain_loss(p + e, *data) - plain_loss(p - e, *data)) / 2e-5, rel=1e-4, abs=1e-7)


def test_fit_comes_to_what_plain_descent_comes_to():
    """Words that tell the grades apart, each in many texts: weights without the soft threshold against gradient descent from the definition."""
    rng = random.Random(1)
    texts, grades = [], []
    for _ in range(150):
        k = rng.randrange(3)
        texts.append(" ".join(rng.choice([["vv", "ww"], ["ww", "xx"], ["xx", "yy"]][k if rng.random() < 0.8 else rng.randrange(3)]) for _ in range(6)))
        grades.append(k)
    model = Q.CumulativeLink.fit(texts, grades, steps=3000, sparse=0.0)
    names = sorted({p for t in texts for f in Q.features(t) for p in Q.places_of(f)})
    names = [p for p in names if sum(p in {q for f in Q.features(t) for q in Q.places_of(f)} for t in texts) >= 5]
    place = {p: i for i, p in enumerate(names)}
    cells = [(i, place[p]) for i, t in enumerate(texts) for f in Q.features(t) for p in Q.places_of(f) if p in place]
    rows, cols = np.array(cells).T
    per = np.bincount(grades, minlength=3)
    data = (rows, cols, np.ones(len(rows)), np.array(grades), np.array([1 / (3 * per[g]) for g in grades]))
    p = np.zeros(len(names) + 2)
    for _ in range(6000):
        p -= 0.5 * Q.loss_and_gradient(p, *data)[1]
    mine = np.array([*(model.weights.get(n, 0.0) for n in names), model.thresholds[0], math.log(model.thresholds[1] - model.thresholds[0])])
    assert plain_loss(mine, *data) == pytest.approx(plain_loss(p, *data), rel=0.02)


def test_quality_of_repeated_rows_ties_and_odd_tables(spark):
    rows = [(i, f"good words number {i % 7} of many", i) for i in range(40)] + [(i, f"vile words number {i % 7}", i) for i in range(40, 80)] + [(1, "a second text of id one", 0)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, p_good long").withColumnRenamed("p_good", "expected_grade")
    labels = spark.createDataFrame([(i, int(i < 40), int(i >= 40), "x") for i in range(80)] + [(3, 1, 0, "x"), (3, 0, 0, "x"), (None, 1, 1, "x"), (999, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")
    model = Q.train(docs, labels)
    assert model.thresholds.tolist() == Q.train(docs.repartition(3), labels.repartition(3)).thresholds.tolist()
    got = Q.grade(docs, model)
    assert got.columns == ["doc_id", "expected_grade", "p_not_toxic", "p_good"] and got.count() == len(rows)
    by_text: dict = {}
    text = {(r[0], r[1]): r[1] for r in rows}
    for r in got.where("doc_id <> 1").collect():
        by_text.setdefault(next(t for (i, t) in text if i == r.doc_id), set()).add((r.expected_grade, r.p_not_toxic))
    assert all(len(x) == 1 for x in by_text.values())
    assert Q.grade(docs.limit(0), model).count() == 0
    nothing = Q.train(docs.limit(0), labels)
    assert [round(r.p_not_toxic, 6) for r in Q.grade(docs.limit(1), nothing).collect()] == [round(2 / 3, 6)]


def test_languages_of_numerals_repeated_rows_and_texts_without_spaces(spark):
    rng = random.Random(2)
    letters = {"ja": "日月火水木金土山川田", "zh": "的一是不了人我在有他"}
    spaced = {"aa": "badokelumi", "bb": "thwxsrngqv"}
    rows = []
    for i in range(300):
        k = rng.choice(["ja", "zh", "aa", "bb"])
        if k in letters:
            rows.append((i, "".join(rng.choice(letters[k]) for _ in range(rng.randint(20, 200))), k, 1.0))
        else:
            rows.append((i, " ".join("".join(rng.choice(spaced[k]) for _ in range(rng.randint(2, 8))) for _ in range(30)), k, 1.0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = L.train(docs, steps=300)
    cases = [(1000, "²"), (1001, "½ ①"), (1002, "Ⅷ"), (1003, "12 !! 3"), (1004, None), (1005, ""), (1006, "².日"), (1007, rows[0][1]), (1007, rows[0][1])]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(cases, "doc_id long, text string"))
    got = [r for r in L.identify(table.selectExpr("doc_id", "text", "1 AS lang_pred", "2 AS score"), model).collect()]
    named = {r.doc_id: r.lang_pred for r in got}
    assert all(named[i] == "und" for i in range(1000, 1006)) and named[1006] != "und"
    assert np.mean([named[i] == k for i, _, k, _ in rows]) > 0.95
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id in (0, 1007)}) == 1 and sum(r.doc_id == 1007 for r in got) == 2
    assert L.identify(table.limit(0), model).count() == 0
    kept = {r.doc_id for r in L.of_known_language(docs, model).collect()}
    assert len(kept) > 290


def test_more_languages_than_two_hundred():
    rng = random.Random(5)
    texts, labels = [], []
    for k in range(230):
        word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
        texts.append(" ".join([word] * 20))
        labels.append(f"l{k:03d}")
    model = L.BiGru(sorted(set(labels)), 16).fit(texts, labels, steps=20)
    assert len(model.languages) == 230 and L.Reader(model).predict(texts[:3])[0][0] in model.languages
