import random
import uuid
from collections import defaultdict

from pyspark.sql import functions as F

from lexmill.operators import callgraph, language, ranking, translation
from lexmill.plans import pipeline
from lexmill.sources import files, tables


def test_functions_of_one_name_share_their_calls(spark):
    source = 'def f(self, a):\n    """Doc.\n    more"""\n    g(1)\n\nclass A:\n    def f(x, self):\n        h.k()\n\ndef g():\n    pass\n'
    found = callgraph.functions(spark.createDataFrame([("m", source), ("bad", "def ("), ("none", None)], "module string, source string"))
    rows = sorted((r.name, r.args, r.doc, r.calls) for r in found.collect())
    assert rows == [("f", ["a"], "Doc.", ["g", "k"]), ("f", ["x", "self"], "", ["g", "k"]), ("g", [], "", [])]
    lines = [r.line for r in callgraph.dot(found, callgraph.edges(found)).orderBy("part", "line").collect()]
    assert lines[0] == "digraph calls {" and lines[-1] == "}" and '"m.f" -> "m.g";' in lines and '"m.f" [label="f(a)\\nDoc.", group="m"];' in lines


def test_built_in_detector_and_labels(spark):
    books = spark.createDataFrame([("c", "x", "the cat and the dog in the house"), ("c", "y", "der Hund und das Haus"), ("c", "z", "123"), ("d", "w", "он не был на войне и в мире")], "category string, book string, sample string")
    got = {r.book: r.language for r in language.detect(books).collect()}
    assert got == {"x": "en", "y": "de", "z": None, "w": "ru"}
    plugged = language.detect(books, lambda texts: texts.map(lambda t: "__label__xx")).collect()
    assert {r.language for r in plugged} == {"xx"}
    assert {r.category: r.language for r in language.vote(language.detect(books), ["category"]).collect()} == {"c": "de", "d": "ru"}


def test_touched_categories_are_made_anew(spark):
    words = spark.createDataFrame([("a", "p", "x", 1), ("a", "q", "x", 2), ("a", "q", "y", 5), ("b", "r", "z", 3), (None, "s", "n", 1)], "category string, book string, word string, cnt long")
    books = words.select("category", "book").distinct()
    old = {"global_union": spark.createDataFrame([("a", "x", 1), ("b", "stale", 9)], "category string, word string, cnt long"), "word_intersection": spark.createDataFrame([("a", "w", 1), ("b", "stale", 9)], "category string, word string, cnt long")}
    done = spark.createDataFrame([("a",), (None,)], "category string")
    now = {k: sorted(map(tuple, v.collect()), key=str) for k, v in pipeline.refreshed(old, words, books, done).items()}
    assert now["global_union"] == sorted([("a", "x", 3), ("a", "y", 5), ("b", "stale", 9), (None, "n", 1)], key=str)
    assert now["word_intersection"] == sorted([("a", "x", 3), ("b", "stale", 9)], key=str)


def test_first_translation_and_order(spark):
    words = spark.createDataFrame([("b", "w", 2), ("a", "w", 1), ("a", "v", 1), ("a", "u", 7)], "category string, word string, cnt long")
    cache = spark.createDataFrame([("w", "t")], "word string, translation string")
    assert [(r.category, r.translation) for r in translation.first_translation(words, cache, "w").collect()] == [("a", "t")]
    assert translation.first_translation(words, cache, "none").count() == 0
    assert [r.word for r in ranking.in_order(words, "category").collect()] == ["u", "v", "w", "w"]


def test_spread(spark):
    one = spark.range(100).coalesce(1)
    assert files.spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and files.spread(one).agg(F.sum("id")).first()[0] == 4950
    many = spark.range(100).repartition(50)
    assert files.spread(many) is many


def test_ranks_by_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), f"w{i}", rng.choice([1, 1, 1, 2, 9, 40])) for i in range(700)]
    words = spark.createDataFrame(rows, "category string, word string, cnt long").repartition(6)
    for keys in ([], ["category"]):
        got = ranking.ranked_in_ranges(words, keys, totals=True)
        want, seen = [], defaultdict(lambda: [0, 0])
        group = lambda r: r[0] if keys else 0
        for r in sorted(rows, key=lambda r: (-r[2], r[1])):
            s = seen[group(r)]
            s[0] += 1
            s[1] += r[2]
            want.append((*r, *s))
        want = [(*r, *seen[group(r)]) for r in want]
        assert sorted(map(tuple, got.select("category", "word", "cnt", "rn", "running", "n", "total").collect()), key=repr) == sorted(want, key=repr)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Window" in plan and "SinglePartition" not in plan and "hashpartitioning(category" not in plan.split("Window")[1].split("\n")[2]
    empty = words.where("cnt < 0")
    assert ranking.ranked_in_ranges(empty, [], totals=True).count() == ranking.ranked_in_ranges(empty, ["category"]).count() == 0


def test_bucketed_tables(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        names = [f"lexmill_test_{uuid.uuid4().hex}" for _ in range(2)]
        union = spark.createDataFrame([("c", f"w{i}", i) for i in range(500)], "category string, word string, cnt long")
        cache = spark.createDataFrame([(f"w{i}", f"t{i}") for i in range(0, 500, 3)], "word string, translation string")
        for rows, name in zip((union, cache), names, strict=True):
            tables.bucketed(rows, name, "word", buckets=8)
        one = spark.table(names[0]).where("word = 'w77'")
        assert [tuple(r) for r in one.collect()] == [("c", "w77", 77)]
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # so that the plan says it
        one = spark.table(names[0]).where("word = 'w77'")
        assert "1 out of 8" in one._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        both = translation.cached(spark.table(names[0]), spark.table(names[1]))
        assert both.count() == 167
        assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
        for name in names:
            spark.sql(f"DROP TABLE {name}")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
