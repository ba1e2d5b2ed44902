"""What identify() shuffles: a row for each word of a text, whatever the number of languages."""

from pyspark.sql import functions as F

from lexmill.operators import language as G


def test_a_word_is_one_row_for_all_languages(spark):
    rows = [(k, w, n) for k, ws in (("en", "the then there"), ("de", "der dann dort"), ("fr", "le les leur")) for n, w in enumerate(ws.split(), 1)]
    model = G.fit(spark.createDataFrame(rows, "language string, word string, cnt long"))
    texts = spark.createDataFrame([(1, "the then"), (2, "dort dann"), (3, "12"), (None, "les leur"), (4, "zzzz")], "k long, text string")
    found = G.identify(texts, ["k"], model)
    assert {r.k: r.language for r in found.collect()} == {1: "en", 2: "de", 3: "und", None: "fr", 4: min(model.base, key=lambda k: (-model.base[k], k))}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Aggregate [k#" in x and "language#" in x.split("]")[0]]
