from pyspark.sql import functions as F

from lexmill.sources import files, tables
from lexmill.streaming import books


def _tree(root):
    for path, text in {"science/One book.v2.txt": "od-\nnako dva", "science/two.txt": "dva", "en_non_science/three.txt": "dva tri", "science/skip.pdf": "x"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)


def test_text_and_pdf_books(spark, tmp_path):
    root = tmp_path / "txt"
    _tree(root)
    got = {(r.category, r.book): r.text for r in files.text_books(spark, str(root)).collect()}
    assert got == {("science", "Onebook"): "od-\nnako dva", ("science", "two"): "dva", ("ennonscience", "three"): "dva tri"}
    pdf = tmp_path / "pdf"
    _tree(pdf)
    found = files.pdf_books(spark, str(pdf), lambda data: data.decode() * 2)
    assert [tuple(r) for r in found.collect()] == [("science/skip.txt", "xx")]
    assert files.pdf_books(spark, str(pdf), bytes.decode, found.select("book_path")).count() == 0


def test_folders(spark):
    paths = spark.createDataFrame([("a/b/c.txt",), ("a/b/d/e.txt",), ("f.txt",), ("a/g.txt",)], "path string")
    assert {tuple(r) for r in files.folders(paths).collect()} == {("a", 1), ("a/b", 2), ("a/b/d", 3)}
    assert [tuple(r) for r in files.depth_two_files(paths).collect()] == [("b", "c.txt", "b/c.txt")]


def test_python_sources(spark, tmp_path):
    for name in ("m.py", "_hidden.py", "setup.py", "n.txt"):
        (tmp_path / name).write_text("def f(): pass")
    assert [r.module for r in files.python_sources(spark, str(tmp_path)).collect()] == ["m"]


def test_tables(spark):
    spark.sql("DROP TABLE IF EXISTS book_words")
    tables.create(spark, "book_words")
    tables.create(spark, "book_words")
    rows = spark.createDataFrame([("c", "b", "w", 1), ("c", "b", "w", 1), ("c", "b", "v", 2)], spark.table("book_words").schema)
    tables.append(rows, "book_words")
    assert spark.table("book_words").count() == 2 and "book_words" in tables.names(spark)
    tables.replace(rows.limit(1), "book_words_copy")
    tables.replace(rows.limit(1), "book_words_copy")
    assert spark.table("book_words_copy").count() == 1
    spark.sql("DROP TABLE book_words")
    spark.sql("DROP TABLE book_words_copy")


def test_stream_counts_each_book_once(spark, tmp_path):
    root, out, mark = tmp_path / "in", tmp_path / "out", tmp_path / "mark"
    _tree(root)
    (root / "science/skip.pdf").unlink()

    def run() -> dict:
        books.write_words(books.book_stream(spark, str(root)), str(out), str(mark)).awaitTermination()
        return {r.word: r.n for r in spark.read.parquet(str(out)).groupBy("word").agg(F.sum("cnt").alias("n")).collect()}

    assert run() == {"odnako": 1, "dva": 3, "tri": 1}
    (root / "science/four.txt").write_text("dva")
    assert run()["dva"] == 4
    assert run()["dva"] == 4


def test_folders_that_are_called_like_the_root(spark, tmp_path):
    root = tmp_path / "txt"
    for name in ("latextxt/a.txt", "txt/b.txt", "math/txt/c.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x")
    for given in (str(root), f"{root}/", f"file://{root}"):
        got = {(r.book_path, r.category, r.book) for r in files.text_books(spark, given).collect()}
        assert got == {("latextxt/a.txt", "latextxt", "a"), ("txt/b.txt", "txt", "b"), ("math/txt/c.txt", "math", "txt")}


def test_pdf_names_end_at_their_own_first_dot(spark, tmp_path):
    for name in ("v1.2/x/a.pdf", "v1.2/x/b.c.pdf", "e.pdf", "txt/no.pdf"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    found = files.pdf_books(spark, str(tmp_path), bytes.decode)
    assert {r.book_path for r in found.collect()} == {"v1.2/x/a.txt", "v1.2/x/b.txt", "e.txt"}
    done = found.where("book_path <> 'v1.2/x/b.txt'").select("book_path")
    assert [r.book_path for r in files.pdf_books(spark, str(tmp_path), bytes.decode, done).collect()] == ["v1.2/x/b.txt"]
