import pytest
from pyspark.sql import functions as F

from lexmill.operators import callgraph, language, ledger, lemmas, popularity, translation, vocabulary
from lexmill.operators.ranking import ranked
from lexmill.plans import pipeline
from lexmill.schemas import Settings

UNION = "category string, word string, cnt long"


def test_rank_and_running_sum(spark):
    rows = [("a", w, n) for w, n in (("x", 5), ("b", 5), ("ba", 5), ("bb", 1), ("é", 1), ("zz", 1))] + [(None, "q", 2), (None, "r", 7)]
    got = {(r.category, r.word): (r.rn, r.running, r.n, r.total) for r in ranked(spark.createDataFrame(rows, UNION), ["category"], totals=True).collect()}
    for c in ("a", None):
        total = sum(n for k, _, n in rows if k == c)
        running = 0
        order = sorted((r for r in rows if r[0] == c), key=lambda r: (-r[2], r[1]))
        for i, (_, w, n) in enumerate(order, 1):
            running += n
            assert got[c, w] == (i, running, len(order), total)


def pick(counts: list[tuple[str, int]], coverage=0.6, low=0.05, high=0.4, least=5) -> set[str]:
    """The cut, from its definition."""
    rows = sorted(counts, key=lambda r: (-r[1], r[0]))
    n, total = len(rows), sum(c for _, c in rows)
    if not n:
        return set()
    mn = max(1, int(n * low))
    mx = max(mn, int(n * high))
    if total <= 0:
        return {w for w, _ in rows[:mn]}
    running = 0
    for k, (_, c) in enumerate(rows, 1):
        running += c
        if (k >= mn and running >= total * coverage) or k >= mx:
            break
    cut = max(rows[k - 1][1], least)
    found = min(sum(c >= cut for _, c in rows), mx)
    return {w for w, _ in rows[: found if found >= mn else mn]}


@pytest.mark.parametrize(
    "counts",
    [
        [("a", 9)],
        [(f"w{i}", 0) for i in range(30)],
        [(f"w{i}", 1) for i in range(60)],
        [(f"w{i:03}", 200 // (i + 1) + 1) for i in range(120)],
        [(f"w{i:03}", 7) for i in range(50)],
        [(f"w{i:03}", 100 if i < 2 else 4) for i in range(100)],
    ],
)
def test_popular_words(spark, counts):
    words = spark.createDataFrame([("c", w, n) for w, n in counts] + [(None, "alone", 6)], UNION)
    got = popularity.popular_words(words).collect()
    assert {r.word for r in got if r.category == "c"} == pick(counts) and {r.word for r in got if r.category is None} == {"alone"}
    assert popularity.popular_words(words.limit(0)).count() == 0


def test_cache_takes_both_directions_first_wins(spark):
    empty = spark.createDataFrame([], "word string, translation string")
    new = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "—"), (4, "d", "D")], "seq long, word string, translation string")
    first = translation.remembered(new, empty)
    assert {tuple(r) for r in first.collect()} == {("a", "x"), ("x", "a"), ("b", "x")}
    assert translation.remembered(new, first).count() == 0
    words = spark.createDataFrame([("a", 3), ("q", 2)], "word string, cnt long")
    assert [r.translation for r in translation.cached(words, first).collect()] == ["x"]
    assert [r.word for r in translation.missing(words, first).collect()] == ["q"]


def test_translator_plug_in(spark):
    words = spark.createDataFrame([(f"w{i}", i) for i in range(7)] + [("слово", 3), ("да", 1)], "word string, cnt long")

    def translator(these, src, tgt):
        if src == "ru":
            raise OSError("no route")
        assert len(these) <= 3
        return [w.upper() + tgt for w in these]

    got = {r.word: r.translation for r in translation.translate(words, translator, Settings(translate_batch=3)).collect()}
    assert got == {f"w{i}": f"W{i}ru" for i in range(7)} | {"слово": "—", "да": "—"}


def test_upsert_and_lookup(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "word string, cnt long, translation string")
    new = spark.createDataFrame([("b", 5, "z"), ("c", 1, "w")], old.schema)
    now = translation.upserted(old, new, ["word"])
    assert {tuple(r) for r in now.collect()} == {("a", 1, "x"), ("b", 5, "z"), ("c", 1, "w")}
    found = translation.with_translation(spark.createDataFrame([("a", 1), ("n", 1)], "word string, cnt long"), now, "n").collect()
    assert [(r.word, r.translation) for r in found] == [("n", None)]


def test_ledger(spark):
    books = spark.createDataFrame([("a/1.txt",), ("a/2.txt",)], "book_path string")
    first = ledger.marked(ledger.empty_ledger(spark), spark.createDataFrame([("a/1.txt", 3)], "book_path string, word_count long"))
    assert [r.book_path for r in ledger.pending(books, first).collect()] == ["a/2.txt"]
    again = ledger.marked(first, spark.createDataFrame([("a/1.txt", 9)], "book_path string, word_count long")).collect()
    assert [(r.book_path, r.word_count, r.hash) for r in again] == [("a/1.txt", 9, None)]


def test_vote_and_samples(spark):
    votes = spark.createDataFrame([("b", "en"), ("b", "de"), ("b", None), ("c", None), (None, "fr")], "book string, language string")
    assert {(r.book, r.language) for r in language.vote(votes, ["book"]).collect()} == {("b", "de"), ("c", "und"), (None, "fr")}
    books = spark.createDataFrame([("c", "b", "ab\n" * 2000), ("c", "s", "x"), ("c", "n", None)], "category string, book string, text string")
    pieces = language.samples(books, 10, 100)
    assert pieces.count() == 20 and pieces.where(F.length("sample") > 100).count() == 0
    found = language.detect(pieces, lambda s: s.map(lambda x: "aa" if "a" in x else "xx"))
    assert {(r.book, r.language) for r in language.vote(found, ["book"]).collect()} == {("b", "aa"), ("s", "xx")}


def test_books_without_words_count_in_the_intersection(spark):
    books = spark.createDataFrame([("c", "1", "alpha beta beta"), ("c", "2", "alpha gamma"), ("d", "1", "delta"), ("e", "1", "omega"), ("e", "2", "12")], "category string, book string, text string")
    words = vocabulary.word_counts(books)
    assert {tuple(r) for r in vocabulary.intersection_of_books(words, books).collect()} == {("c", "alpha", 2)}
    assert {tuple(r) for r in vocabulary.union_of_books(words).where("category = 'c'").collect()} == {("c", "alpha", 2), ("c", "beta", 2), ("c", "gamma", 1)}


def test_stop_lists_both_or_none(spark):
    words = spark.createDataFrame([("alpha",), ("beta",), ("gamma",)], "word string")
    one, none = words.where("word = 'alpha'"), words.limit(0)
    assert vocabulary.without_stop_words(words, one, words.where("word = 'beta'")).count() == 1
    assert vocabulary.without_stop_words(words, one, none).count() == 3
    assert vocabulary.without_stop_words(words, one, none, settings=Settings(require_both_stop_lists=False)).count() == 2


def test_pipeline(spark):
    rows = [("en", "g1", "common words house"), ("en", "g2", "common the"), ("en", "s1", "common running runnings running quantum field"), ("en", "s2", "quantum fields field running")]
    books = spark.createDataFrame(rows, "category string, book string, text string")
    out = pipeline.run(books, [F.col("book") == "g1", F.col("book") == "g2"], mend=True)
    assert {(r.book, r.word): r.cnt for r in out["book_words"].collect()} == {("s1", "running"): 3, ("s1", "quantum"): 1, ("s1", "field"): 1, ("s2", "quantum"): 1, ("s2", "field"): 2, ("s2", "running"): 1}
    assert {(r.word, r.cnt) for r in out["word_intersection"].collect()} == {("running", 4), ("quantum", 2), ("field", 3)}
    assert {(r.deleted_word, r.merged_to) for r in out["deleted_words"].collect()} == {("runnings", "running"), ("fields", "field")}
    assert out["popular_words"].count() >= 1


def test_callgraph(spark):
    a = 'def f(self, x):\n    """Doc.\n    More."""\n    g(x)\n    def inner():\n        h()\n    return m.k()\nf(1)\nasync def no():\n    g()\n'
    b = "def g(): pass\ndef h(): return g()\nclass C:\n    def g(self): pass\n"
    sources = spark.createDataFrame([("a", a), ("b", b), ("bad", "def ("), ("none", None)], "module string, source string")
    found = callgraph.functions(sources)
    f = found.where("name = 'f'").first()
    assert (f.args, f.doc, f.calls) == (["x"], "Doc.", ["g", "k"])
    edges = callgraph.edges(found)
    assert {tuple(r) for r in edges.collect()} == {("a.f", "b.g", True), ("a.inner", "b.h", True), ("b.h", "b.g", False)}
    many = spark.createDataFrame([("s", f"d{i:02}") for i in range(12)], "src string, dst string")
    assert {r.dst for r in callgraph.pruned(many).collect()} == {f"d{i:02}" for i in range(8)}


def test_lemmas(spark):
    words = spark.createDataFrame([("c", "b", "cats", 2), ("c", "b", "cat", 1), (None, "b", "dog", 4)], "category string, book string, word string, cnt long")
    got = lemmas.by_function(words, lambda lang: lambda w: w.rstrip("s"), "en")
    assert {tuple(r) for r in got.collect()} == {("c", "b", "cat", 3), (None, "b", "dog", 4)}
    with pytest.raises(ValueError):
        lemmas.by_function(words, lambda lang: str, "de")
