"""Benchmark decontamination by winnowing, in DataFrame code only.

A window is 13 consecutive words of an item (an item of fewer is one window as a whole). Both
sides hash their 5-grams and keep, of every 9 consecutive ones (13 words), the least, leftmost
first. Two equal windows hold the same 9 hashes, so they keep the same 5-gram at the same place:
joining the kept fingerprints finds every window that occurs. A hit is then extended word by word,
8 words to each side, which covers every window that kept it; runs of 13 equal words or more count.
Words, not hashes, are compared, so no collision can mark a word.

  1. fingerprints: (document, place, hash), three numbers a row, joined with those of the benchmark. These are
     broadcast up to `PRINTS_TO_BROADCAST` (24 bytes each); beyond, both sides are shuffled by the hash;
  2. extension: documents with hits are read once more, and give the 21 words around each place that was hit; an item gives
     those around each fingerprint. So neither a long document nor a long item is ever copied as a whole.

Step 1 hashes words in lower case (capital sigma as a small one, whatever follows), step 2 compares words of which A-Z alone is
lower-cased: what is equal in 2 is equal in 1.

Items shorter than 13 words take their leading k-gram (k = 5 or their length) as the fingerprint
and are met by all k-grams of the documents, which are only made if there are such items.

Nulls: a null text has no words. Rows are told apart by two 64-bit hashes of id and text, so repeated ids do not mix;
identical rows get identical results. A null item_id still marks words; it is counted in n_items and left out of items_sha256, as SQL's
aggregates do. Empty tables give no hits or no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import cut, let, lower_ascii, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words in a window, words in a fingerprint, words looked at on each side of a fingerprint.
N, K = 13, 5
SIDE = N - K
#: Rows of three numbers.
PRINTS_TO_BROADCAST = 1_000_000
HITS_TO_BROADCAST = 200_000
#: The key of the row that carries a document's number of words; its place is negative, as no other's is.
COUNT = 0
_PRINTS = "array<struct<pos:int,key:bigint>>"


def _split(lowered: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def words_of(text: Column) -> Column:
    return _split(lower_ascii(text))


def _low(text: Column) -> Column:
    return F.lower(F.replace(text, F.lit("Σ"), F.lit("σ")))


def row_key() -> Column:
    return F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64("text", "doc_id", F.lit(1)).alias("b"))


def _gram(words: Column, start: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(words, start + j) for j in range(k)])


def winnow(words: Column, n: int = N, k: int = K) -> Column:
    """array<struct<pos int, key long>>: kept k-grams, pos from 0; empty if there are under n words.

    Elements are fetched one by one: slice() would copy them through collections.
    """
    wide = n - k + 1
    third = wide // 3
    # order by the upper 32 bits of the hash, then by place, in one long; the last k - 1 are not whole and in no window
    packed = F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, k)]).bitwiseAND(F.lit(-(1 << 32))) + i)
    least_of_third = lambda p: F.transform(p, lambda x, i: F.least(x, *[F.get(p, i + j) for j in range(1, third)]))
    starts = [*range(0, wide - third, third), wide - third]  # thirds that cover a window
    least = lambda m: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(m) - n), lambda i: F.least(*[F.get(m, i + j) for j in starts])))
    place = lambda x: x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    kept = F.transform(let(let(packed, least_of_third), least), lambda x: F.struct(place(x).alias("pos"), _gram(words, place(x), k).alias("key")))
    return F.when(F.size(words) >= n, kept).otherwise(F.array().cast(_PRINTS))


def _all_grams(words: Column, k: int) -> Column:
    every = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.struct(i.alias("pos"), _gram(words, i, k).alias("key")))
    return F.when(F.size(words) >= k, every).otherwise(F.array().cast(_PRINTS))


def fingerprints(text: Column, short: list[int]) -> Column:
    """Kept k-grams of a text, all k-grams for the lengths in short, and its number of words."""

    def of(words: Column) -> Column:
        kept = [_all_grams(words, K) if K in short else winnow(words), *[_all_grams(words, k) for k in short if k < K]]
        return F.concat(*kept, F.array(F.struct((-1 - F.size(words)).alias("pos"), F.lit(COUNT).cast("long").alias("key"))))

    return let(_split(_low(text)), of)


def _around(words: Column, pos: Column) -> Column:
    """struct<left, words>: the words around the k-gram at pos, `left` of them before it."""
    left = F.least(F.lit(SIDE), pos)
    return F.struct(left.alias("left"), F.slice(words, pos - left + 1, left + K + SIDE).alias("words"))


def _run(d: Column, i: Column) -> Column:
    """How many words from the start on are equal."""
    n = F.least(F.size(d), F.size(i))
    return let(F.filter(F.sequence(F.lit(0), n), lambda j: (j >= n) | ~F.get(d, j).eqNullSafe(F.get(i, j))), lambda x: F.get(x, F.lit(0)))


def _extend(d: Column, i: Column) -> Column:
    """struct<before, after>: how many words are equal before and from the k-grams on."""
    left = F.least(d["left"], i["left"])
    back = lambda x: F.reverse(F.slice(x["words"], x["left"] - left + 1, left))
    ahead = lambda x: F.slice(x["words"], x["left"] + 1, K + SIDE)
    return F.struct(_run(back(d), back(i)).alias("before"), _run(ahead(d), ahead(i)).alias("after"))


def _bounded(side: DataFrame, most: int) -> DataFrame:
    return F.broadcast(side) if side.count() <= most else side


def contaminated_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, row_key, n_words, item, item_id, from, to): words from..to-1 of a document lie in windows of the item.

    item tells items apart by id and words. Every document also has a row with its n_words, whose from is null.
    """
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    items = cut(items.select(F.monotonically_increasing_id().alias("item"), "item_id", F.size("words").alias("n"), "words"), "bench-items")
    short = sorted(r["k"] for r in items.where(F.col("n") < N).select(F.least("n", F.lit(K)).alias("k")).distinct().collect())  # K numbers at most
    lowered = lambda w: F.transform(w, _low)
    lead = lambda w: F.array(F.struct(F.lit(0).alias("pos"), _gram(w, F.lit(0), K).alias("key")))
    kept = let(lowered(F.col("words")), lambda w: F.when(F.size(w) >= N, winnow(w)).otherwise(lead(w)))
    with_around = let(F.col("words"), lambda w: F.transform(kept, lambda f: F.struct(f["pos"].alias("pos"), f["key"].alias("key"), _around(w, f["pos"]).alias("around"))))
    prints = items.select("item", "item_id", "n", with_around.alias("f")).select("item", "item_id", "n", F.explode_outer("f").alias("f"))
    prints = cut(prints.select("item", "item_id", "n", F.col("f.pos").alias("ipos"), F.col("f.key").alias("key"), F.col("f.around").alias("i")), "bench-prints")

    counter = docs.sparkSession.range(1).select(F.lit(None).cast("long").alias("item"), F.lit(-1).alias("ipos"), F.lit(COUNT).cast("long").alias("key"))
    side = prints.select("item", "ipos", "key")
    # explode would first filter by the size of what it explodes, and so make the fingerprints twice
    mine = docs.select("doc_id", row_key().alias("row_key"), fingerprints(F.col("text"), short).alias("f")).select("doc_id", "row_key", F.explode_outer("f").alias("f"))
    mine = mine.select("doc_id", "row_key", F.col("f.pos").alias("pos"), F.col("f.key").alias("key"))
    if side.count() <= PRINTS_TO_BROADCAST:
        met = mine.join(F.broadcast(side.unionByName(counter)), "key").where(F.when(F.col("pos") < 0, F.col("ipos") < 0).otherwise(F.col("ipos") >= 0))
    else:
        counts = mine.where("pos < 0").select(*mine.columns, F.lit(None).cast("long").alias("item"), F.lit(-1).alias("ipos"))
        met = mine.where("pos >= 0").join(side, "key").select(*mine.columns, "item", "ipos").unionByName(counts)
    met = cut(met.select("doc_id", "row_key", "pos", "item", "ipos"), "bench-met")

    # rows equal in id and text have equal hits: once is enough
    hits = cut(met.where("pos >= 0").distinct(), "bench-hits")
    places = hits.groupBy("row_key").agg(F.collect_set("pos").alias("at"))  # as many as a document has fingerprints at most
    few = hits.count() <= HITS_TO_BROADCAST
    found = docs.select(row_key().alias("row_key"), "text").join(F.broadcast(places) if few else places, "row_key")
    around = let(words_of(F.col("text")), lambda w: F.transform("at", lambda p: F.struct(p.alias("pos"), _around(w, p).alias("d"))))
    found = found.select("row_key", around.alias("f")).select("row_key", F.explode_outer("f").alias("f")).select("row_key", F.col("f.pos").alias("pos"), F.col("f.d").alias("d"))
    # identical rows come as often as they are there; their spans are made distinct below
    aligned = hits.join(found, ["row_key", "pos"]).join(prints.select("item", "ipos", "item_id", "n", "i"), ["item", "ipos"])
    spans = aligned.select("doc_id", "row_key", "item", "item_id", "n", "pos", _extend(F.col("d"), F.col("i")).alias("s"))
    spans = spans.where(F.col("s.before") + F.col("s.after") >= F.least(F.lit(N), F.col("n")))
    spans = spans.select("doc_id", "row_key", F.lit(None).cast("long").alias("n_words"), "item", "item_id", (F.col("pos") - F.col("s.before")).alias("from"), (F.col("pos") + F.col("s.after")).alias("to")).distinct()
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    counts = met.where("pos < 0").select("doc_id", "row_key", (-1 - F.col("pos")).cast("long").alias("n_words"), none("item", "long"), none("item_id", benchmark.schema["item_id"].dataType), none("from", "int"), none("to", "int"))
    return spans.unionByName(counts)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, row_key, n_words, n_hit, n_items, items_sha256, contaminated (5 % of its words hit or more), passage.

    passage: whether it holds a whole window of 13 words. row_key is row_key(), by which the documents themselves may be joined.
    """
    spans = cut(contaminated_spans(docs, benchmark), "bench-spans")
    hits, key = spans.where(F.col("from").isNotNull()), "row_key"
    words = hits.select(key, F.explode(F.sequence("from", F.col("to") - 1)).alias("w")).distinct().groupBy(key).agg(F.count("*").alias("n_hit"))
    names = hits.groupBy(key, "item_id").agg(F.max(F.col("to") - F.col("from")).alias("longest"))
    names = names.groupBy(key).agg(F.count("*").alias("n_items"), F.max("longest").alias("longest"), F.array_join(F.array_sort(F.collect_list(F.col("item_id").cast("string"))), ",").alias("items"))
    hit = words.join(names, key)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return spans.where("from is null").join(hit, key, "left").select(
        "doc_id", key, "n_words", zero("n_hit").alias("n_hit"), zero("n_items").alias("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        ((zero("n_hit") > 0) & (20 * zero("n_hit") >= F.col("n_words"))).alias("contaminated"), (zero("longest") >= N).alias("passage"))


def clean_of(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no whole window of 13 words, and of whose words under 5 % are hit by shorter items."""
    bad = decontaminate(docs, benchmark).where("contaminated or passage").select(F.col("row_key").alias("_bad_row")).distinct()
    return docs.join(_bounded(cut(bad, "bench-bad"), HITS_TO_BROADCAST), row_key() == F.col("_bad_row"), "left_anti")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_key", "passage")


OP5_SQL = r"""
WITH low AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
win AS (
  SELECT DISTINCT id AS item, least(13, len(w)) AS n, array_to_string(w[p:p + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM low WHERE kind = 'b' AND len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
pos AS (
  SELECT id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
  FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM low, lens WHERE kind = 'd' AND len(w) >= n)),
met AS (SELECT pos.id, pos.n, pos.p, win.item FROM pos JOIN win ON pos.n = win.n AND pos.g = win.g),
hit AS (SELECT id, count(DISTINCT x) AS n_hit FROM (SELECT id, unnest(range(p, p + n)) AS x FROM met) GROUP BY id),
it AS (SELECT id, count(*) AS n_items, string_agg(item::VARCHAR, ',' ORDER BY item::VARCHAR) AS items FROM (SELECT DISTINCT id, item FROM met) GROUP BY id)
SELECT low.id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM low LEFT JOIN hit ON low.id = hit.id LEFT JOIN it ON low.id = it.id WHERE kind = 'd'
"""
