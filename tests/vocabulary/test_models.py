import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexmill.operators import language as L
from lexmill.operators import lemmas
from lexmill.plans import pipeline

SF = "/root/testdata/sf0.001"


def test_held_out_books(spark):
    """Fitted on some books, the model knows the language of the others' documents, and of their books by windows and a vote."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 200")
    held = F.col("source").rlike("[13579]$")
    words = docs.where(~held).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    model = L.fit(words.groupBy(F.col("lang").alias("language"), "word").agg(F.count("*").alias("cnt")))
    out = docs.where(held)
    found = L.identify(out.select("doc_id", "text"), ["doc_id"], model).join(out.select("doc_id", "lang"), "doc_id")
    right, n = found.agg(F.count_if(F.col("language") == F.col("lang")), F.count("*")).first()
    assert n > 50 and right / n >= 0.95
    books = out.select(F.col("lang").alias("category"), F.col("source").alias("book"), "text")
    voted = L.vote(L.detect_by_model(L.byte_windows(books, 4, 300), model), ["category", "book"]).collect()
    assert len(voted) > 10 and sum(r.language == r.category for r in voted) / len(voted) >= 0.95


def test_scores_and_cases(spark):
    rows = [("aa", "ab", 3), ("aa", "abc", 1), ("bb", "xyz", 2), (None, "never", 9), ("bb", "ab", 1)]
    model = L.fit(spark.createDataFrame(rows, "language string, word string, cnt long"))
    grams = lambda w: [f"_{w}_"[i : i + 3] for i in range(len(w))]
    c = {k: Counter() for k in ("aa", "bb")}
    for k, w, n in rows:
        for g in grams(w) if k else []:
            c[k][g] += n
    kinds = len(set(c["aa"]) | set(c["bb"]))
    assert model.base == {k: -math.floor(1000 * math.log(sum(x.values()) + kinds)) for k, x in c.items()}
    assert {(r.gram, r.language): r.gain for r in model.grams.collect()} == {(g, k): math.floor(1000 * math.log(n + 1)) for k, x in c.items() for g, n in x.items()}
    texts = spark.createDataFrame([(1, "ab AB abc"), (2, "xyz"), (3, None), (4, "12 !"), (None, "xyz ab"), (5, "ö")], "id long, text string")
    got = {r.id: r.language for r in L.identify(texts, ["id"], model).collect()}

    def best(words):
        score = {k: sum(model.base[k] + (math.floor(1000 * math.log(c[k][g] + 1)) if c[k][g] else 0) for w in words for g in grams(w)) for k in c}
        return min(score, key=lambda k: (-score[k], k))

    assert got == {1: best(["ab", "ab", "abc"]), 2: best(["xyz"]), 3: "und", 4: "und", None: best(["xyz", "ab"]), 5: best(["ö"])}
    nobody = L.fit(spark.createDataFrame([], "language string, word string, cnt long"))
    assert {r.language for r in L.identify(texts, ["id"], nobody).collect()} == {"und"}


@pytest.mark.parametrize("text", ["аяё" * 50, "a😀é" * 40, "short", "\n\nab\ncd" * 30])
def test_windows_hold_whole_characters(spark, text):
    books = spark.createDataFrame([("c", "b", text), ("c", "n", None), ("c", "e", " \n ")], "category string, book string, text string")
    got = L.byte_windows(books, 8, 50).collect()
    raw = text.encode()
    windows = {raw[i : i + 50].decode(errors="ignore").replace("\n", "") for i in range(max(len(raw) - 50, 0) + 1)}
    assert len(got) == 8 and {r.book for r in got} == {"b"} and {r["sample"] for r in got} <= windows
    assert [r["sample"] for r in got] == [r["sample"] for r in L.byte_windows(books, 8, 50).collect()]


def test_suffix_rules(spark):
    pairs = [("cats", "cat"), ("dogs", "dog"), ("maps", "map"), ("cities", "city"), ("parties", "party"), ("ladies", "lady"), ("glass", "glass"), ("class", "class"), ("went", "go"), ("", "x"), ("ran", "")]
    dictionary = spark.createDataFrame(pairs, "word string, lemma string")
    rules = {r.ending: (r.put, r.n) for r in lemmas.suffix_rules(dictionary).collect()}
    assert rules["s"] == ("", 3) and rules["ies"] == ("y", 3) and rules["ass"] == ("ass", 2) and "nt" not in rules and "went" not in rules
    words = spark.createDataFrame([("c", "b", w, 2) for w in ("cats", "cat", "trees", "berries", "brass", "was", "s", "went")], "category string, book string, word string, cnt long")
    got = {r.word: r.cnt for r in lemmas.by_rules(words, dictionary).collect()}
    assert got == {"cat": 4, "tree": 2, "berry": 2, "brass": 2, "wa": 2, "s": 2, "go": 2}
    none = spark.createDataFrame([], dictionary.schema)
    assert {r.word for r in lemmas.by_rules(words, none).collect()} == {r.word for r in words.collect()}


def test_lemmas_go_through_the_pipeline(spark):
    books = spark.createDataFrame([("c", "g", "cats running often"), ("c", "b", "cats dogs towers tower table"), ("c", "d", "tower tables")], "category string, book string, text string")
    dictionary = spark.createDataFrame([("cats", "cat"), ("dogs", "dog"), ("towers", "tower"), ("tables", "table")], "word string, lemma string")
    out = pipeline.run(books, [F.col("book") == "g"], dictionary=dictionary)
    assert {(r.word, r.cnt) for r in out["global_union"].collect()} == {("dog", 1), ("tower", 3), ("table", 2)}
    assert {r.word for r in out["word_intersection"].collect()} == {"tower", "table"}
