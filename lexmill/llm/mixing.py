"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Everything here is DataFrame code; no Python runs on the executors.

Water-filling. Let source i have size s_i (words), weight w_i and cap c_i = epochs * s_i, and let
the mix want T words. Filling every source at the same rate per weight, a source is clamped at
c_i once the water has risen to c_i / w_i; what it cannot take goes to the others by weight.
Sorted by c_i / w_i, source i is clamped just if c_i * W <= w_i * (T - C), with W the weight of i
and all after it and C the caps before it; one pass over the sources (never over their rows)
therefore yields what repeated clamping and resharing converges to. The comparison is in whole
numbers, so it is exact.

Sampling. A target of r * s_i words is floor(r) whole repetitions of every document and, in an
order given by a seeded hash, one more repetition of documents until the target is met; the one
document in which it is met takes a fraction. The order is never built: documents are counted in
4,096 hash buckets per source, the bucket holding the border is found from these sums, and only
the documents of that bucket (1/4096 of a source) are ranked. A source with a third of all rows
thus costs no more than any other.

Nulls and ties. A null text has size 0 and takes nothing; null is a source like any other, sorted
last; a null id is hashed as the word null. The hash is of id and text; rows that repeat both are separate documents that sit
next to each other in the hash order. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.llm.common import cut, table

WORD = r"[^\x20\x09-\x0D]+"
#: Broadcast the table of sources up to this many rows (under 10 MB); beyond, the join shuffles.
SOURCES_TO_BROADCAST = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, total: Column, max_epochs: int = 2) -> DataFrame:
    """Add `target` to sources (source, source_size, weight): capped water-filling of total words."""
    cap = max_epochs * F.col("source_size")
    order = [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()]
    before = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rest = W.orderBy(*order).rowsBetween(0, W.unboundedFollowing)
    filled = (
        sources.withColumn("cap", cap)
        .withColumn("total", total)
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_rest", F.sum("weight").over(rest))
        # twice the total is whole, as the total is half of a whole number
        .withColumn("clamped", 2 * F.col("cap") * F.col("weight_rest") <= F.col("weight") * (2 * F.col("total") - 2 * F.col("caps_before")).cast("long"))
    )
    alone = W.partitionBy()
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("clamped"), F.col("cap"))).over(alone), F.lit(0))
    weight = F.sum(F.when(~F.col("clamped"), F.col("weight"))).over(alone)
    return filled.withColumn("target", F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(left.cast("double") * F.col("weight") / weight)).select("source", "source_size", "weight", "target")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2, seed: str = "mix-1", rows: bool = False) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, and, if asked for, its whole row as a struct `row`.

    docs needs doc_id, text and source. Sources in code
    point order get the weights in turn. share must be a multiple of a half.
    """
    # the text as well, so that rows without an id, or with one id, don't fall into one bucket
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.coalesce("text", F.lit(""))))
    kept = ["row"] if rows else []
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), order.alias("_order"), *[F.struct(*[docs[c] for c in docs.columns]).alias(c) for c in kept])
    slim = cut(sized.select("doc_id", "source", "size", "_order"), "mix-sizes")
    buckets = slim.groupBy("source", F.substring("_order", 1, 3).alias("bucket")).agg(F.sum("size").alias("size"))
    buckets = cut(buckets, "mix-buckets")

    by_name = W.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = buckets.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", turn.cast("long"))
    total = F.sum("source_size").over(W.partitionBy()) * F.lit(share)
    targets = water_fill(sources, total, max_epochs)
    # words that every document gives, and words still wanted after that
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("whole", whole.cast("long")).withColumn("extra", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))

    same = F.col("b.source").eqNullSafe(F.col("t.source"))
    run = W.partitionBy("source").orderBy("bucket")
    border = (
        buckets.alias("b").join(targets.alias("t"), same).select("t.*", "bucket", "size")
        .withColumn("upto", F.sum("size").over(run))
        .withColumn("before", F.col("upto") - F.col("size"))
        .groupBy("source", "source_size", "target", "whole", "extra")
        .agg(F.min(F.when(F.col("upto") > F.col("extra"), F.struct("bucket", "before"))).alias("at"))
        .select("source", "source_size", "target", "whole", "extra", F.col("at.bucket").alias("border"), F.col("at.before").alias("before"))
    )
    border = cut(border, "mix-border")
    few = border.count() <= SOURCES_TO_BROADCAST

    def with_border(rows: DataFrame) -> DataFrame:
        side = F.broadcast(border) if few else border
        return rows.alias("d").join(side.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.*", "t.source_size", "t.target", "t.whole", "t.extra", "t.border", "t.before")

    mixed = with_border(sized if rows else slim).withColumn("_bucket", F.substring("_order", 1, 3))
    out = ["doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("_more")).cast("long").alias("taken"), *kept]
    whole_bucket = F.col("border").isNull() | (F.col("_bucket") < F.col("border"))
    away = mixed.where(~F.col("_bucket").eqNullSafe(F.col("border"))).withColumn("_more", F.when(whole_bucket & (F.col("extra") > 0), F.col("size")).otherwise(0))
    rank = W.partitionBy("source").orderBy("_order", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    inside = mixed.where(F.col("_bucket") == F.col("border")).withColumn("_done", F.coalesce(F.sum("size").over(rank), F.lit(0)) + F.col("before"))
    inside = inside.withColumn("_more", F.greatest(F.lit(0), F.least(F.col("size"), F.col("extra") - F.col("_done"))))
    return away.select(*out).unionByName(inside.select(*out))


def repeated(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: rows of docs as often as it takes them.

    A fraction of a document is a row with as many of its words, joined by spaces; a column n_chars then follows the text.
    """
    times = F.floor(F.col("taken") / F.col("size")).cast("int")
    words = F.slice(F.regexp_extract_all(F.col("row.text"), F.lit(WORD), F.lit(0)), 1, (F.col("taken") % F.col("size")).cast("int"))
    part = F.col("row").withField("text", F.array_join(words, " "))
    if "n_chars" in docs.columns:
        part = part.withField("n_chars", F.length(F.array_join(words, " ")).cast(docs.schema["n_chars"].dataType))
    copies = F.concat(F.array_repeat("row", times), F.when(F.col("taken") % F.col("size") > 0, F.array(part)).otherwise(F.array_repeat("row", 0)))
    return mix_sources(docs, rows=True, **how).where("taken > 0").select(F.explode_outer(copies).alias("row")).select("row.*")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')) AS o
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w
  FROM d GROUP BY source),
t AS (
  SELECT *, 2 * source_size AS cap, 3 * (sum(source_size) OVER ())::BIGINT AS twice,
         coalesce(sum(2 * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c,
         (sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS wr
  FROM s),
u AS (SELECT *, 2 * cap * wr <= w * (twice - 2 * c) AS clamped FROM t),
v AS (
  SELECT source, source_size,
         CASE WHEN clamped THEN cap::DOUBLE
              ELSE (twice::DOUBLE / 2 - coalesce(sum(CASE WHEN clamped THEN cap END) OVER (), 0)::DOUBLE) * w / (sum(CASE WHEN NOT clamped THEN w END) OVER ())::DOUBLE END AS target
  FROM u),
x AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM v),
y AS (SELECT *, round(target - whole * source_size)::BIGINT AS extra FROM x),
z AS (
  SELECT d.doc_id, d.size, y.source_size, y.target, whole, extra,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY o, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS done
  FROM d JOIN y ON d.source IS NOT DISTINCT FROM y.source)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, extra - done)))::BIGINT AS taken
FROM z
"""
