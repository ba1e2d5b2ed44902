"""Books from files: text trees, PDF by a plug-in, names and folders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as X

#: What the name of a category keeps is Latin letters, digits and all of the Cyrillic block.
CATEGORY_DROPS = r"[^a-zA-Z0-9\u0400-\u04FF]"
#: Text of a PDF file's bytes.
Extractor = Callable[[bytes], str]


def spread(files: DataFrame) -> DataFrame:
    """A table read from fewer pieces than there are cores, dealt out evenly over them; others stay as they are.

    One file of one row group is otherwise read, split into words and counted by a single task.
    """
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(cores) if files.rdd.getNumPartitions() < cores else files


def relative_path(spark: SparkSession, root: str) -> Column:
    """A file's path below root, decoded, of files read from root; root is a folder of any file system, not a pattern."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    top = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().getPath().rstrip("/")
    # a plus is itself in a path, but a blank to url_decode
    file = F.url_decode(F.replace(F.regexp_replace("_metadata.file_path", "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), F.lit("+"), F.lit("%2B")))
    return F.substring(file, F.lit(len(top) + 2), F.length(file))


def text_files(raw: DataFrame, root: str) -> DataFrame:
    """(book_path, category, book, text) of whole text files read from root, batch or stream: those with .txt in their path."""
    files = raw.select(relative_path(raw.sparkSession, root).alias("book_path"), F.col("value").alias("text"))
    return named(files.where(F.col("book_path").contains(".txt")))


def named(files: DataFrame) -> DataFrame:
    """(book_path, category, book, text) of files (book_path, text): names by the rule for paths category/file."""
    name = X.plain_name(F.col("book_path"))
    return files.select("book_path", F.split_part(name, F.lit("/"), F.lit(1)).alias("category"), F.split_part(name, F.lit("/"), F.lit(2)).alias("book"), "text")


def text_books(spark: SparkSession, root: str) -> DataFrame:
    """Books under root/category/file.txt, one row each."""
    return text_files(spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True), root)


def table_books(documents: DataFrame) -> DataFrame:
    """(category, book, text): a document's language is its category, its source the book it is a part of."""
    return documents.select(F.col("lang").alias("category"), F.col("source").alias("book"), "text")


def pdf_books(spark: SparkSession, root: str, extractor: Extractor, done: DataFrame | None = None) -> DataFrame:
    """(book_path, text) of the PDF files under root, outside folders named txt, that aren't in done (book_path)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"book_path": frame["book_path"], "text": [extractor(bytes(x)) for x in frame["content"]]})

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(root)
    at = raw.where(~F.col("path").contains("/txt/")).select(relative_path(spark, root).alias("at"), "content")
    # the file's name ends at its first dot; folders keep theirs
    name = F.substring_index("at", "/", -1)
    folder = F.left("at", F.length("at") - F.length(name))
    files = at.select(F.concat(folder, F.substring_index(name, ".", 1), F.lit(".txt")).alias("book_path"), "content")
    if done is not None:
        files = files.join(done.select("book_path"), "book_path", "left_anti").select("book_path", "content")
    return files.mapInPandas(run, "book_path string, text string")


def python_sources(spark: SparkSession, root: str) -> DataFrame:
    """(module, source) of the Python files right in root, without hidden ones and setup.py."""
    raw = spark.read.option("pathGlobFilter", "*.py").text(root, wholetext=True)
    name = F.substring_index(F.col("_metadata.file_path"), "/", -1)
    return raw.select(name.alias("file"), "value").where(~F.col("file").rlike("^[._]") & (F.col("file") != "setup.py")).select(F.regexp_replace("file", r"\.py$", "").alias("module"), F.col("value").alias("source"))


def initial_categories(paths: DataFrame) -> DataFrame:
    """(category) of the folders right under the root that hold a file in paths (path, below the root): letters and digits of their names, those of
    which nothing is left without."""
    named = paths.where(F.col("path").contains("/")).select(F.regexp_replace(F.substring_index("path", "/", 1), CATEGORY_DROPS, "").alias("category"))
    return named.where("category <> ''").distinct()


def folders(paths: DataFrame) -> DataFrame:
    """(folder, depth) of all folders above the files in paths (path)."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    found = paths.where(F.col("path").contains("/")).select(F.explode(above).alias("folder")).distinct()
    return found.select("folder", F.size(F.split("folder", "/")).cast("long").alias("depth"))


def depth_two_files(paths: DataFrame) -> DataFrame:
    """(category, file) of the files at root/category/file."""
    parts = F.split("path", "/")
    return paths.where(F.size(parts) == 3).select(parts[1].alias("category"), parts[2].alias("file"), F.concat_ws("/", parts[1], parts[2]).alias("book_path")).distinct()
