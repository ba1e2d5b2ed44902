"""The engine's own tables: create, append without repeats, replace as a whole or by partition, buckets by word."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.schemas import TABLES


def create(spark: SparkSession, name: str, kind: str | None = None, partition: str | None = None) -> None:
    """An empty Parquet table of a kind named in schemas.TABLES, unless it exists."""
    if not spark.catalog.tableExists(name):
        writer = spark.createDataFrame([], TABLES[kind or name]).write.format("parquet")
        (writer.partitionBy(partition) if partition else writer).saveAsTable(name)


def append(rows: DataFrame, name: str) -> None:
    """Rows are added in any order, equal ones among them once."""
    columns = rows.sparkSession.table(name).columns
    rows.select(*columns).dropDuplicates().write.insertInto(name)


def replace(rows: DataFrame, name: str) -> None:
    """Drop the table and make it anew."""
    rows.write.mode("overwrite").format("parquet").saveAsTable(name)


def replace_partitions(rows: DataFrame, name: str) -> None:
    """Rows take the place of all rows of the partitions that they are of; other partitions stay, and are not read.

    The table must be partitioned (see create). Rows are staged by the writer and put in place, partition by partition, when all are there. An empty
    string in the partition's column is stored as null. A table can't be replaced by rows that are read from it.
    """
    spark = rows.sparkSession
    columns = spark.catalog.listColumns(name)
    folder = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'").first()["data_type"]
    # by folder: the writer of a folder takes the mode as its own option, not as the session's setting
    writer = rows.select(*[c.name for c in columns]).write.option("partitionOverwriteMode", "dynamic").mode("overwrite")
    writer.partitionBy(*[c.name for c in columns if c.isPartition]).parquet(folder)
    spark.catalog.recoverPartitions(name)
    spark.catalog.refreshTable(name)


def bucketed(rows: DataFrame, name: str, *columns: str, buckets: int = 32) -> None:
    """A new table in files by buckets of the columns, sorted by them: what an index on them is to a database.

    A look-up by value reads one bucket, and in it the row groups whose range holds the value; tables in as many buckets of the same columns
    are joined on them without a shuffle. Rows are dealt out first, so there is one file a bucket.
    """
    dealt = rows.repartition(buckets, *columns)
    dealt.write.bucketBy(buckets, *columns).sortBy(*columns).format("parquet").mode("overwrite").saveAsTable(name)


def names(spark: SparkSession, database: str = "default", without: tuple[str, ...] = ("processed_books", "word_intersection", "global_union", "translations", "translations_cache")) -> list[str]:
    """Tables of books: all but the engine's own results."""
    return sorted(t.name for t in spark.catalog.listTables(database) if not t.isTemporary and t.name not in without)
