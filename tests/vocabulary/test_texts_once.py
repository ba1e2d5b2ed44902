"""Queries that need a vocabulary several times split the texts into words once."""

import pytest

from lexmill.operators import vocabulary
from lexmill.plans import catalogue
from lexmill.sources import tables

SF = "/root/testdata/sf0.001"


def reads_texts(df) -> bool:
    return any("documents.parquet" in f for f in df.inputFiles())


@pytest.mark.parametrize("query", ["cache_misses", "cache_lookup", "merged_translations", "word_with_translation", "lemma_rules"])
def test_results_come_from_a_table_of_words(spark, query):
    assert not reads_texts(catalogue.QUERIES[query](spark, SF))


@pytest.mark.parametrize("query", ["replaced_categories", "indexed_lookup"])
def test_tables_are_written_from_a_table_of_words(spark, query, monkeypatch):
    written = []
    for name in ("append", "replace_partitions", "bucketed"):
        real = getattr(tables, name)
        monkeypatch.setattr(tables, name, lambda rows, *a, real=real, **k: (written.append(reads_texts(rows)), real(rows, *a, **k)))
    catalogue.QUERIES[query](spark, SF)
    assert written == [False, False]


def test_counts_of_a_category_are_those_of_its_books(spark):
    books = spark.createDataFrame([("a", "x", "one two two"), ("a", "y", "two 2two"), (None, "x", "one"), (None, None, None), ("b", "x", "")], "category string, book string, text string")
    found = sorted(map(tuple, vocabulary.category_counts(books).collect()), key=str)
    assert found == sorted(map(tuple, vocabulary.union_of_books(vocabulary.word_counts(books)).collect()), key=str)
    assert ("a", "two", 3) in found and (None, "one", 1) in found
