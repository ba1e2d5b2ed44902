import random

import pytest

from lexmill.operators import vocabulary as V
from lexmill.sources import files
from lexmill.streaming import books as B
from lexmill.streaming.running import RunningVocabulary

BOOKS = "book_path string, category string, book string, text string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def same_as_whole(spark, running, done):
    whole = spark.createDataFrame(done, BOOKS)
    words = V.word_counts(whole, mend=True)
    assert rows_of(running.union()) == rows_of(V.union_of_books(words).select("category", "word", "cnt"))
    assert rows_of(running.intersection()) == rows_of(V.intersection_of_books(words, whole))


def test_batches_equal_the_whole(spark, tmp_path):
    rng = random.Random(3)
    running = RunningVocabulary(spark, f"file://{tmp_path}")
    text = lambda: rng.choice([None, "", "so-\nme", *[" ".join(rng.choices(["all", "some", "few", "été", "x"], k=4)) + " all" for _ in range(8)]])
    done = []
    for number in range(4):
        batch = [(f"p{number}.{i}", rng.choice(["a", "b", None]), f"k{rng.randint(0, 3) if number > 1 else 10 * number + i}", text()) for i in range(5)]
        again = done[:2]  # files that are in the ledger
        running.apply(spark.createDataFrame(batch + [(p, c, b, "other words") for p, c, b, _ in again], BOOKS), number)
        done += batch
        same_as_whole(spark, running, done)
    versions = running.words.versions(), running.books.versions()
    running.apply(spark.createDataFrame([("new", "a", "new", "never counted")], BOOKS), 3)  # a number that is done
    assert (running.words.versions(), running.books.versions()) == versions
    same_as_whole(spark, running, done)


@pytest.mark.parametrize("table", ["words", "books"])
def test_a_batch_that_failed_is_tried_again(spark, tmp_path, monkeypatch, table):
    running = RunningVocabulary(spark, f"file://{tmp_path}")
    first, second = [("p1", "a", "k1", "one two three")], [("p2", "a", "k2", "two three three"), ("p3", "a", "k1", "one four")]
    running.apply(spark.createDataFrame(first, BOOKS), 0)
    with monkeypatch.context() as m:
        m.setattr(getattr(running, table), "_switch", lambda pointer: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError, match="gone"):
            running.apply(spark.createDataFrame(second, BOOKS), 1)
    if table == "words":
        same_as_whole(spark, running, first)
    running.apply(spark.createDataFrame(second, BOOKS), 1)
    same_as_whole(spark, running, first + second)


def test_follows_a_stream(spark, tmp_path):
    root, running = tmp_path / "in", RunningVocabulary(spark, f"file://{tmp_path}/kept")
    for name, text in {"math/my book.txt": "some words", "math/b.txt": "more words", "math/notes.md": "no words", "en/c.txt": "a+b words"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)

    def run():
        running.follow(B.book_stream(spark, str(root)), f"{tmp_path}/mark").awaitTermination()
        return {tuple(r) for r in running.books.read().collect()}, {tuple(r) for r in running.intersection().collect()}

    names = {("math/my book.txt", "math", "mybook"), ("math/b.txt", "math", "b"), ("en/c.txt", "en", "c")}
    assert run() == (names, {("math", "words", 2)})
    assert {(r.book_path, r.category, r.book) for r in files.text_books(spark, str(root)).collect()} == names
    (root / "math/d+e.txt").write_text("other")
    assert run() == (names | {("math/d+e.txt", "math", "de")}, set())
    assert run()[1] == set()
