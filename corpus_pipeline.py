"""From raw documents to token files: five stages, each over all that the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.

  language_id      a bidirectional recurrent network; documents without a language go
  near_dedup       SimHash; of each group of near-duplicates the document with the least id stays
  decontaminate    winnowing; documents go that hold 13 words in a row of a benchmark item, or of whose words
                   shorter items cover 5 % or more
  mix              capped water-filling; documents are repeated as their source's target asks
  token_output     ids packed into shard files; one row per document of the mix, read back from them

Defined results. Null, empty and letterless texts have no language and go in the first stage. Rows that share an id are documents
of their own; of rows equal in id and text one is left after near_dedup. A null id is kept as such, a null source is a source like any
other, a null lang is not looked at. Texts are taken whole, however long. An empty table gives no rows, and so
does one of which nothing is left. Other columns, whatever their names, go through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import decontamination, language_id, mixing, simhash, token_output
from lexmill.llm.common import cut, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.of_known_language(docs, language_id.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean_of(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_output.token_output(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix", mix),
    ("token_output", write_token_ids),
]

#: SQL can't express the recurrent network, XXH64 fingerprints or the tokenizer; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
