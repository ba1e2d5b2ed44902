"""Importance resampling towards a target distribution, in DataFrame code only.

Features are all runs of 1 to n consecutive words of a text; each falls into one of `buckets` by its CRC-32. A bucket's
gain is 1000 times the logarithm of how much more frequent it is in the target than in the documents, with one added to every
count, rounded down. A document's weight is the mean of its features' gains; with Gumbel noise drawn from a hash of its id
added, the highest scores are a sample without replacement in proportion to the weights.

  1. the documents' buckets are written once, as arrays; feature counts are grouped sums over them, partly added up before
     the shuffle, so that a word that makes up a third of all features is one row a task;
  2. gains are a table of `buckets` rows, which is what is broadcast: its size is a parameter, not the data's;
  3. buckets are exploded, joined to their gains and summed up by document, partly before the shuffle, too: a long document
     is one row a task;
  4. scores are sorted in ranges; a document's rank is its place in its range and the number of rows in those before.

Defined results. A null or wordless text has no features, weight 0, and is never drawn. A null id is hashed as the word null and comes last
among ties. Rows that share an id are documents of their own; of those with equal scores the one with fewer features comes
first, and rows equal in that, too, get their ranks in any order. Empty documents or an empty target count as no features; an empty table gives
no rows. Other columns are ignored by `importance_sample` and kept by `resampled`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.llm.common import cut, let, lower_ascii, table
from lexmill.operators.ranking import placed

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
#: Hashes are of so many values.
HASHES = 1 << 32


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def bucket(feature: Column, buckets: int = BUCKETS) -> Column:
    return (F.crc32(feature) % buckets).cast("int")


def feature_buckets(words: Column, n: int = 1, buckets: int = BUCKETS) -> Column:
    """The bucket of every run of 1 to n words, as often as it occurs."""

    def runs(k: int) -> Column:
        if k == 1:
            return F.transform(words, lambda w: bucket(w, buckets))
        every = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: bucket(F.concat_ws(" ", *[F.get(words, i + j) for j in range(k)]), buckets))
        return F.when(F.size(words) >= k, every).otherwise(F.array().cast("array<int>"))

    return F.concat(*[runs(k) for k in range(1, n + 1)]) if n > 1 else runs(1)


def _featured(docs: DataFrame, n: int, buckets: int, *more: Column) -> DataFrame:
    """more, n_words and the buckets of docs (text)."""
    made = let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), feature_buckets(w, n, buckets).alias("buckets")))
    return docs.select(*more, made.alias("f")).select(*[c for c in docs.select(*more).columns], "f.n_words", "f.buckets")


def bucket_counts(featured: DataFrame, name: str) -> DataFrame:
    """(bucket, name): how many features fall into each bucket that has some."""
    return featured.select(F.explode_outer("buckets").alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias(name))


def gain_table(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for all buckets; docs and target have their buckets."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    counts = every.join(bucket_counts(docs, "s"), "bucket", "left").join(bucket_counts(target, "t"), "bucket", "left").select("bucket", zero(F.col("s")).alias("s"), zero(F.col("t")).alias("t"))
    total = lambda c: F.sum(c).over(W.partitionBy())  # noqa: E731  over `buckets` rows, however many documents there are
    ratio = ((F.col("t") + 1) * (total("s") + buckets)).cast("double") / ((F.col("s") + 1) * (total("t") + buckets)).cast("double")
    return counts.select("bucket", F.floor(1000 * F.ln(ratio)).cast("long").alias("gain"))


def noise(doc_id: Column, seed: int) -> Column:
    """1000 times a Gumbel variate made of the hash of the seed and the id, rounded down."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / HASHES))).cast("long")


def importance_sample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, percent: int = 10, least_words: int = 20, seed: int = 2024, rows: bool = False) -> DataFrame:
    """Per document: doc_id, n_features, weight, score, rank (null if not drawn), and, if asked for, its whole row as a struct `row`.

    docs needs doc_id and text, target a text. Of the documents with least_words words or more, percent in a hundred are drawn.
    """
    kept = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if rows else []
    mine = cut(_featured(docs, n, buckets, F.monotonically_increasing_id().alias("uid"), F.col("doc_id"), *kept), "resample-buckets")
    gains = cut(gain_table(mine, _featured(target, n, buckets), buckets).coalesce(1), "resample-gains")

    by = ["uid", "doc_id", "n_words", "n_features"]
    every = mine.select("uid", "doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), F.explode_outer("buckets").alias("bucket"))
    sums = every.join(F.broadcast(gains), "bucket", "left").groupBy(*by).agg(F.coalesce(F.sum("gain"), F.lit(0)).alias("gain"))
    count = F.greatest("n_features", F.lit(1))
    weight = F.call_function("div", F.col("gain") - F.pmod(F.col("gain"), count), count).cast("long")  # whole numbers: no rounding but down
    scored = sums.select("uid", "doc_id", "n_words", "n_features", weight.alias("weight"), (weight + noise(F.col("doc_id"), seed)).alias("score"))
    # those that may be drawn come first
    draw = mine.where(F.col("n_words") >= least_words).count() * percent // 100
    ranks = placed(scored, F.desc(F.col("n_words") >= least_words), F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "uid", name="resample-order")
    ranks = ranks.withColumn("rank", F.when(F.col("place") < draw, F.col("place") + 1))
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranks.join(mine.select("uid", "row"), "uid").select(*out, "row") if rows else ranks.select(*out)


def resampled(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The drawn documents themselves, with all their columns."""
    return importance_sample(docs, target, rows=True, **how).where("rank is not null").select("row.*")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY i) AS tab FROM range(256) r(i)),
d AS (
  SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (SELECT uid, unnest(w) AS word FROM d),
bw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
voc AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(word)), lambda i: ('0x' || substr(hex(word), 2 * i + 1, 2))::BIGINT)),
                               lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT word FROM dw UNION SELECT word FROM bw), crc_table),
sc AS (SELECT bucket, count(*) AS s FROM dw JOIN voc USING (word) GROUP BY bucket),
tc AS (SELECT bucket, count(*) AS t FROM bw JOIN voc USING (word) GROUP BY bucket),
tot AS (SELECT (SELECT count(*) FROM dw) AS big_s, (SELECT count(*) FROM bw) AS big_t),
gain AS (
  SELECT b AS bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * (big_s + 10000))::DOUBLE / ((coalesce(s, 0) + 1) * (big_t + 10000))::DOUBLE))::BIGINT AS gain
  FROM range(10000) r(b) LEFT JOIN sc ON b = sc.bucket LEFT JOIN tc ON b = tc.bucket, tot),
sums AS (SELECT uid, sum(gain)::BIGINT AS g FROM dw JOIN voc USING (word) JOIN gain USING (bucket) GROUP BY uid),
x AS (
  SELECT d.uid, doc_id, len(w)::BIGINT AS n_features, floor(coalesce(g, 0)::DOUBLE / greatest(len(w), 1))::BIGINT AS weight,
         ('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, 'null'))[1:8])::BIGINT AS h
  FROM d LEFT JOIN sums ON d.uid = sums.uid),
y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM x),
z AS (SELECT uid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS r, (10 * count(*) OVER ()) // 100 AS k FROM y WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= k THEN r END AS rank FROM y LEFT JOIN z ON y.uid = z.uid
"""
