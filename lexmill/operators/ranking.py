"""Ranks and running sums within groups of any size.

A window over one key sorts all its rows in one task. Here the order is first cut into pieces whose
rows are counted; a piece's offset comes from these counts, and only pieces are sorted. So no group,
however large, meets in one task, and results are those of row_number() and sum() over the whole group.

`ranked` is for many groups, such as books: its pieces are words of one count and beginning, and a group's pieces meet. `ranked_in_ranges` is for few and large
ones, down to one for the whole table: its pieces are ranges of the order over all groups, as many as there are partitions.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.operators.joins import join_same
from lexmill.sources.scratch import cut


def ranked(words: DataFrame, keys: list[str], totals: bool = False) -> DataFrame:
    """words (keys, word, cnt) with rn: 1, 2, ... by falling cnt, then word; with totals also running, n and total.

    Pieces are words of one count with the same first two letters.
    """
    piece = [*keys, "cnt", "_head"]
    headed = words.withColumn("_head", F.substring("word", 1, 2))
    counts = headed.groupBy(*piece).agg(F.count("*").alias("_in"))
    before = W.partitionBy(*keys).orderBy(F.desc("cnt"), "_head").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(*keys)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_in").over(before), F.lit(0)))
    if totals:
        offsets = (
            offsets.withColumn("_sum", F.coalesce(F.sum(F.col("_in") * F.col("cnt")).over(before), F.lit(0)))
            .withColumn("n", F.sum("_in").over(every)).withColumn("total", F.sum(F.col("_in") * F.col("cnt")).over(every))
        )
    here = F.row_number().over(W.partitionBy(*piece).orderBy("word"))
    joined = join_same(headed, offsets.drop("_in"), piece)
    out = joined.withColumn("rn", (F.col("_before") + here).cast("long"))
    if totals:
        out = out.withColumn("running", F.col("_sum") + (F.col("rn") - F.col("_before")) * F.col("cnt")).drop("_sum")
    return out.drop("_head", "_before")


def _in_ranges(rows: DataFrame, order: list, name: str) -> tuple[DataFrame, Column, Column]:
    """rows as a table, dealt out by ranges of the order and sorted in them; a row's partition, and its number in it."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # the id holds the partition above bit 33 and the row's number in it below; once written, both stay
    table = cut(dealt.withColumn("_at", F.monotonically_increasing_id()), name)
    return table, F.shiftrightunsigned("_at", 33).cast("int"), F.col("_at").bitwiseAND((1 << 33) - 1)


def _before(table: DataFrame, part: Column, *sums: Column) -> list[Column]:
    """For each of the sums what the partitions before a row's add up to: numbers for each partition, not for each row, come to the driver."""
    found = {r["_part"]: r[1:] for r in table.groupBy(part.alias("_part")).agg(*sums).collect()}
    parts = range(max(found, default=0) + 1)
    return [F.get(F.lit([0, *accumulate(found[p][i] if p in found else 0 for p in parts)]).cast("array<bigint>"), part) for i in range(len(sums))]


def placed(rows: DataFrame, *order: Column | str, name: str = "placed") -> DataFrame:
    """rows with `place`: 0, 1, 2, ... in the given order, whatever their number.

    Rows are dealt out by ranges of the order and sorted in their partitions; a partition's offset is the number of rows
    before it. Rows equal in the whole order share a range, so it should end in something
    that tells rows apart. The order is looked at twice, so rows are best a table.
    """
    table, part, inside = _in_ranges(rows, list(order), name)
    (before,) = _before(table, part, F.count("*"))
    return table.select(*rows.columns, (before + inside).alias("place"))


def ranked_in_ranges(words: DataFrame, keys: list[str], totals: bool = False) -> DataFrame:
    """The same as ranked(), for few groups of any size, or one (no keys). No window is over a group; cnt isn't negative."""
    order = [*[F.asc_nulls_first(k) for k in keys], F.desc("cnt"), "word"]
    table, part, inside = _in_ranges(words, order, "ranked")
    rows_before, sum_before = _before(table, part, F.count("*"), F.coalesce(F.sum("cnt"), F.lit(0)))
    every = table.withColumn("_place", rows_before + inside)
    if totals:
        run = F.sum("cnt").over(W.partitionBy(part).orderBy("_at").rowsBetween(W.unboundedPreceding, 0))
        every = every.withColumn("_sum", sum_before + run)
    if not keys:
        out = every.withColumn("rn", F.col("_place") + 1)
        if totals:
            n, total = table.agg(F.count("*"), F.coalesce(F.sum("cnt"), F.lit(0))).first()
            out = out.withColumn("running", F.col("_sum")).withColumn("n", F.lit(n).cast("long")).withColumn("total", F.lit(total).cast("long"))
    else:
        first = [F.min("_place").alias("_first")]
        if totals:
            first += [F.min(F.col("_sum") - F.col("cnt")).alias("_sum_first"), F.count("*").alias("n"), F.sum("cnt").alias("total")]
        out = join_same(every, every.groupBy(*keys).agg(*first), keys).withColumn("rn", F.col("_place") - F.col("_first") + 1)
        if totals:
            out = out.withColumn("running", F.col("_sum") - F.col("_sum_first"))
    return out.select(*words.columns, "rn", *(["running", "n", "total"] if totals else []))


def in_order(words: DataFrame, *keys: str) -> DataFrame:
    """words sorted for output: by keys, falling count and word."""
    return words.orderBy(*keys, F.desc("cnt"), "word")
