"""Registered queries over the driver's tables, with DuckDB SQL for each.

A document's language is its category and its source the book it belongs to. The books src0 and src1
stand for the general ones, of which stop lists are made. Words reversed stand for translations.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators import callgraph, language, ledger, lemmas, popularity, similarity, translation, vocabulary
from lexmill.operators.callgraph import pruned
from lexmill.operators.ranking import in_order, ranked, ranked_in_ranges
from lexmill.plans import pipeline
from lexmill.sources import files, renames, tables
from lexmill.sources.scratch import cut, new_path
from lexmill.sources.stored import StoredTable
from lexmill.streaming.running import RunningVocabulary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
GENERAL = ("src0", "src1")


def _query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.table_books(_documents(spark, sf_dir))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.word_counts(_books(spark, sf_dir))


def _union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of all books, as a table: what is made of it reads it several times, and texts are split into words once."""
    return cut(vocabulary.category_counts(_books(spark, sf_dir)), "union")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host and path of every page's address."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", F.regexp_extract("url", "^https?://([^/]+)/", 1).alias("host"), F.regexp_extract("url", "^https?://[^/]+/([^?#]*)", 1).alias("path"))


# ---- pieces of SQL ----

TOKENS = r"""tok AS (
  SELECT doc_id, lang AS category, source AS book, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM documents),
fit AS (SELECT * FROM tok WHERE NOT regexp_matches(word, '\p{Nd}') AND length(word) BETWEEN 3 AND 17),
wc AS MATERIALIZED (SELECT category, book, word, count(*)::BIGINT AS cnt FROM fit GROUP BY ALL)"""

#: DuckDB's levenshtein counts bytes: letters beyond ASCII are first mapped to capitals, which no word holds.
ALIKE = "(abs(length({a}) - length({b})) <= 1 AND levenshtein(translate({a}, 'ßäçèéêíñóöü', 'ABCDEFGHIJK'), translate({b}, 'ßäçèéêíñóöü', 'ABCDEFGHIJK')) <= least(2, 0.25::DOUBLE * greatest(length({a}), length({b}))))"


def _pairs_sql(words: str, out: str) -> str:
    """Pairs meet on the first letters and a length that is that of the one and within one of the other's."""
    alike = ALIKE.format(a="x.word", b="y.word")
    return f"""{out}_long AS MATERIALIZED (SELECT category, book, left(word, 4) AS prefix, length(word) AS len, word, cnt FROM {words} WHERE length(word) >= 5),
{out}_met AS MATERIALIZED (SELECT *, unnest([len - 1, len, len + 1]) AS meets FROM {out}_long),
{out} AS (
  SELECT x.category, x.book, x.prefix, x.word AS word_a, x.cnt AS cnt_a, y.word AS word_b, y.cnt AS cnt_b
  FROM {out}_long x JOIN {out}_met y ON x.category = y.category AND x.book = y.book AND x.prefix = y.prefix AND x.len = y.meets
  WHERE (x.cnt > y.cnt OR (x.cnt = y.cnt AND x.word < y.word)) AND {alike})"""


def _groups_sql(words: str, p: str) -> str:
    """CTEs p_pairs, p_head (category, book, word, head_word) and p_target (words with their target)."""
    return f"""{_pairs_sql(words, f"{p}_pairs")},
{p}_both AS (SELECT category, book, word_a AS a, word_b AS b FROM {p}_pairs UNION ALL SELECT category, book, word_b, word_a FROM {p}_pairs),
{p}_reach AS (
  SELECT DISTINCT category, book, a AS word, a AS other FROM {p}_both
  UNION
  SELECT r.category, r.book, r.word, e.b FROM {p}_reach r JOIN {p}_both e ON r.category = e.category AND r.book = e.book AND r.other = e.a),
{p}_head AS (
  SELECT r.category, r.book, r.word, arg_min(w.word, struct_pack(k := -w.cnt, w := w.word)) AS head_word
  FROM {p}_reach r JOIN {words} w ON r.category = w.category AND r.book = w.book AND r.other = w.word GROUP BY ALL),
{p}_target AS (
  SELECT w.*, CASE WHEN h.head_word IS NOT NULL AND {ALIKE.format(a="w.word", b="h.head_word")} THEN h.head_word ELSE w.word END AS target
  FROM {words} w LEFT JOIN {p}_head h ON w.category = h.category AND w.book = h.book AND w.word = h.word),
{p}_kept AS (SELECT category, book, target AS word, sum(cnt)::BIGINT AS cnt FROM {p}_target GROUP BY ALL)"""


UNION = "gu AS MATERIALIZED (SELECT category, word, sum(cnt)::BIGINT AS cnt FROM wc GROUP BY ALL)"
POPULAR = """r0 AS (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY cnt DESC, word) AS rn,
         (sum(cnt) OVER (PARTITION BY category ORDER BY cnt DESC, word ROWS UNBOUNDED PRECEDING))::BIGINT AS running,
         count(*) OVER (PARTITION BY category) AS n, (sum(cnt) OVER (PARTITION BY category))::BIGINT AS total
  FROM gu),
r1 AS (SELECT *, greatest(1, floor(n * 0.05::DOUBLE)) AS mn, greatest(greatest(1, floor(n * 0.05::DOUBLE)), floor(n * 0.4::DOUBLE)) AS mx FROM r0),
r2 AS (SELECT category, greatest(arg_min(cnt, rn), 5) AS cut FROM r1 WHERE (rn >= mn AND running >= total * 0.6::DOUBLE) OR rn >= mx GROUP BY category),
r3 AS (SELECT r1.*, least(count(*) FILTER (cnt >= cut) OVER (PARTITION BY r1.category), mx) AS np FROM r1 JOIN r2 USING (category)),
pop AS MATERIALIZED (SELECT category, word, cnt, rn FROM r3 WHERE rn <= CASE WHEN np >= mn THEN np ELSE mn END)"""
CACHE = "cache AS (SELECT word, reverse(word) AS translation FROM (SELECT DISTINCT word FROM wc) WHERE length(word) % 2 = 0)"
VALID = "(trim({t}) <> '' AND {t} <> '\"\"' AND {t} <> '—' AND lower({t}) <> lower({w}))"
SCIENCE = "sc AS (SELECT * FROM wc WHERE book NOT IN ('src0', 'src1'))"


def _with(*parts: str, then: str) -> str:
    return f"WITH RECURSIVE {', '.join(parts)}\n{then}"


# ---- text ----


@_query(r"SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda p: regexp_matches(p, '\S'))) AS paragraph FROM documents")
def paragraph_split(spark, sf_dir):
    return X.each(_documents(spark, sf_dir), "doc_id", paragraph=X.paragraphs(F.col("text")))


@_query(_with(TOKENS, then="SELECT doc_id, word FROM fit"))
def tokenize_filter(spark, sf_dir):
    return X.each(_documents(spark, sf_dir), "doc_id", word=X.words_of(F.col("text")))


@_query("SELECT doc_id, translate(text, chr(173) || chr(8203) || chr(8209), '') AS clean FROM documents")
def soft_char_strip(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", X.strip_soft(F.col("text")).alias("clean"))


@_query(r"SELECT doc_id, regexp_replace(lower(text), '([а-яА-ЯёЁa-zA-Z])\s*\r?\n\s*([а-яА-ЯёЁa-zA-Z])', '\1 \2', 'g') AS mended FROM documents")
def hyphen_repair(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", X.mend_breaks(F.lower("text")).alias("mended"))


BREAKS = [("([a-z]{3})([a-z]{3,5})", "\n  "), ("([a-z]{4})([a-z]{5})", "-\n"), ("([a-z]{5})([a-z]{5,6})", " - "), ("([a-z]{4})([a-z]{8,9})", "-  \n "), ("([a-z]{7})([a-z]{7,11})", " -\n")]


@_query(r"SELECT doc_id, regexp_replace(lower(text), '([а-яА-ЯёЁa-zA-Z])\s*\r?\n\s*([а-яА-ЯёЁa-zA-Z])', '\1 \2', 'g') AS mended FROM documents")
def broken_documents(spark, sf_dir):
    """Every word of 6 to 18 letters a-z cut in two by its length, in one of five ways, and mended again."""
    broken = F.lower("text")
    # a look for one of a-z tells places within words before all letters are asked for
    for word, gap in BREAKS:  # parts of a cut word are shorter than the words that later patterns look for
        broken = F.regexp_replace(broken, F.lit(rf"(?<![a-z])(?<![\p{{L}}\p{{N}}\p{{M}}-]){word}(?![\p{{L}}\p{{N}}\p{{M}}-])"), F.lit(f"$1{gap}$2"))
    return _documents(spark, sf_dir).select("doc_id", X.mend_breaks(broken).alias("mended"))


# ---- frequencies ----


@_query(_with(TOKENS, then="SELECT * FROM wc"))
def word_counts(spark, sf_dir):
    return _words(spark, sf_dir)


@_query(_with(TOKENS, then="SELECT *, row_number() OVER (PARTITION BY category, book ORDER BY cnt DESC, word) AS rn FROM wc"))
def ranked_words(spark, sf_dir):
    return ranked(_words(spark, sf_dir), ["category", "book"])


@_query("SELECT lang AS category, source AS book, source IN ('src0', 'src1') AS is_general, count(*) AS docs FROM documents GROUP BY ALL")
def category_pass_split(spark, sf_dir):
    path = F.concat_ws("/", F.when(F.col("book").isin(*GENERAL), F.concat("category", F.lit("_non_science"))).otherwise(F.col("category")), "book")
    return _books(spark, sf_dir).groupBy("category", "book", vocabulary.is_general(path).alias("is_general")).agg(F.count("*").alias("docs"))


@_query(_with(TOKENS, SCIENCE, then="SELECT * FROM sc WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT word FROM wc WHERE book IN ('src0', 'src1')) g WHERE g.word = sc.word)"))
def stopword_antijoin(spark, sf_dir):
    words = _words(spark, sf_dir)
    lists = [words.where(F.col("book") == b).select("word").distinct() for b in GENERAL]
    return vocabulary.without_stop_words(words.where(~F.col("book").isin(*GENERAL)), *lists)


@_query(_with(TOKENS, UNION, then="SELECT * FROM gu"))
def global_union(spark, sf_dir):
    return vocabulary.category_counts(_books(spark, sf_dir))


INTERSECTION = """SELECT category, word, sum(cnt)::BIGINT AS cnt FROM {words} w GROUP BY category, word
HAVING count(DISTINCT book) = (SELECT count(DISTINCT source) FROM documents d WHERE d.lang = w.category{general}) AND count(DISTINCT book) >= 2"""


@_query(_with(TOKENS, then=INTERSECTION.format(words="wc", general="")))
def word_intersection(spark, sf_dir):
    books = _books(spark, sf_dir)
    return vocabulary.intersection_of_books(vocabulary.word_counts(books), books)


@_query(_with(TOKENS, "le AS (SELECT category, book, CASE WHEN word LIKE '%s' AND length(word) > 4 THEN left(word, length(word) - 1) ELSE word END AS word, cnt FROM wc)", then="SELECT category, book, word, sum(cnt)::BIGINT AS cnt FROM le GROUP BY ALL"))
def lemma_dictionary(spark, sf_dir):
    words = _words(spark, sf_dir)
    plural = words.where(F.col("word").endswith("s") & (F.length("word") > 4)).select("word").distinct()
    return lemmas.by_dictionary(words, plural.select("word", F.expr("left(word, length(word) - 1)").alias("lemma")))


DICTIONARY = """dict AS (SELECT word, CASE WHEN word LIKE '%ies' THEN left(word, length(word) - 3) || 'y' WHEN word LIKE '%s' THEN left(word, length(word) - 1) ELSE word END AS lemma
  FROM (SELECT DISTINCT word FROM wc WHERE book IN ('src0', 'src1')) WHERE length(word) > 4)"""


@_query(_with(TOKENS, DICTIONARY, """same AS (SELECT *, len(list_filter(range(1, least(length(word), length(lemma)) + 1), lambda i: left(word, i) = left(lemma, i))) AS s FROM dict),
ends AS (SELECT substr(word, f + 1) AS ending, substr(lemma, f + 1) AS put FROM (SELECT *, unnest(range(greatest(s - 3, 0), s + 1)) AS f FROM same)),
rules AS (SELECT ending, arg_min(put, struct_pack(n := -n, p := put)) AS put, max(n) AS n FROM (SELECT ending, put, count(*) AS n FROM ends WHERE length(ending) <= 8 GROUP BY ALL) GROUP BY ending HAVING max(n) >= 2),
unk AS (SELECT DISTINCT word FROM wc WHERE word NOT IN (SELECT word FROM dict)),
tried AS (SELECT word, size, right(word, size) AS ending FROM (SELECT word, unnest(range(0, least(8, length(word) - 2) + 1)) AS size FROM unk)),
hit AS (SELECT word, arg_max(struct_pack(size := size, put := put), size) AS r FROM tried JOIN rules USING (ending) GROUP BY word),
lem AS (SELECT word, left(word, length(word) - r.size) || r.put AS lemma FROM hit UNION ALL SELECT * FROM dict)""",
              then="SELECT category, book, coalesce(lemma, word) AS word, sum(cnt)::BIGINT AS cnt FROM wc LEFT JOIN lem USING (word) GROUP BY ALL"))
def lemma_rules(spark, sf_dir):
    """All books by the lemmas of a dictionary made of the general books' words, other words by rules learnt from it."""
    words = cut(_words(spark, sf_dir), "words")
    known = words.where(F.col("book").isin(*GENERAL) & (F.length("word") > 4)).select("word").distinct()
    lemma = F.when(F.col("word").endswith("ies"), F.concat(F.expr("left(word, length(word) - 3)"), F.lit("y"))).when(F.col("word").endswith("s"), F.expr("left(word, length(word) - 1)")).otherwise(F.col("word"))
    return lemmas.by_rules(words, cut(known.select("word", lemma.alias("lemma")), "dictionary"))


@_query(_with(TOKENS, then=r"SELECT category, book, count(*)::BIGINT AS occurrences, count(*) FILTER (regexp_full_match(word, '\p{L}+'))::BIGINT AS letters_only FROM tok GROUP BY ALL"))
def letters_only_tokens(spark, sf_dir):
    tokens = X.each(_books(spark, sf_dir), "category", "book", word=F.regexp_extract_all(F.lower("text"), F.lit(X.WORD), F.lit(0)))
    return tokens.groupBy("category", "book").agg(F.count("*").alias("occurrences"), F.count_if(F.col("word").rlike(r"^\p{L}+$")).alias("letters_only"))


@_query(_with(TOKENS, UNION, then="SELECT category, count(*)::BIGINT AS total_unique, sum(cnt)::BIGINT AS total_occurrences FROM gu GROUP BY category"))
def vocabulary_totals(spark, sf_dir):
    union = _union(spark, sf_dir)
    return union.groupBy("category").agg(F.count("*").alias("total_unique"), F.sum("cnt").alias("total_occurrences"))


# ---- similarity ----


@_query(_with(TOKENS, _pairs_sql("wc", "p"), then="SELECT category, book, word_a, word_b FROM p"))
def similar_pairs(spark, sf_dir):
    return similarity.similar_pairs(_words(spark, sf_dir)).select("category", "book", "word_a", "word_b")


@_query(_with(TOKENS, _groups_sql("wc", "c"), then="SELECT * FROM c_head"))
def components(spark, sf_dir):
    return similarity.components(similarity.similar_pairs(_words(spark, sf_dir)))


@_query(_with(TOKENS, _groups_sql("wc", "c"), then="SELECT * FROM c_kept"))
def clustered_words(spark, sf_dir):
    return similarity.clustered(similarity.merge_targets(_words(spark, sf_dir)))


@_query(_with(TOKENS, _groups_sql("wc", "c"), then="SELECT category, book, word AS deleted_word, cnt, target AS merged_to FROM c_target WHERE word <> target"))
def deleted_words(spark, sf_dir):
    return similarity.deleted(similarity.merge_targets(_words(spark, sf_dir)))


GENERAL_WORDS = "gw AS (SELECT * FROM wc WHERE book IN ('src0', 'src1'))"
SUBJECT = "sw AS (SELECT * FROM wc WHERE book NOT IN ('src0', 'src1') AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT word FROM g_kept) k WHERE k.word = wc.word))"
FAITHFUL = (TOKENS, GENERAL_WORDS, _groups_sql("gw", "g"), SUBJECT, _groups_sql("sw", "s"))


def _pipeline(spark, sf_dir) -> dict[str, DataFrame]:
    return pipeline.run(_books(spark, sf_dir), [F.col("book") == b for b in GENERAL])


@_query(_with(*FAITHFUL, then="SELECT category, word, sum(cnt)::BIGINT AS cnt FROM s_kept GROUP BY ALL"))
def pipeline_union(spark, sf_dir):
    return _pipeline(spark, sf_dir)["global_union"]


@_query(_with(*FAITHFUL, then=INTERSECTION.format(words="s_kept", general=" AND source NOT IN ('src0', 'src1')")))
def pipeline_intersection(spark, sf_dir):
    return _pipeline(spark, sf_dir)["word_intersection"]


@_query(_with(*FAITHFUL, then="SELECT category, book, word AS deleted_word, cnt, target AS merged_to FROM s_target WHERE word <> target"))
def pipeline_deleted(spark, sf_dir):
    return _pipeline(spark, sf_dir)["deleted_words"]


# ---- popularity ----


@_query(_with(TOKENS, UNION, POPULAR, then="SELECT category, word, cnt, rn, running, n, total FROM r0"))
def running_coverage(spark, sf_dir):
    return popularity.running_coverage(_union(spark, sf_dir))


def _popular(spark, sf_dir) -> DataFrame:
    return popularity.popular_words(_union(spark, sf_dir))


@_query(_with(TOKENS, UNION, POPULAR, then="SELECT * FROM pop"))
def popular_words(spark, sf_dir):
    return _popular(spark, sf_dir)


# ---- languages and translation ----


@_query(r"SELECT doc_id, CASE WHEN regexp_matches(text, '[а-яА-Я]') THEN 'ru' ELSE 'en' END AS script FROM documents")
def script_language(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", X.script_language(F.col("text")).alias("script"))


@_query("""WITH c AS (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY ALL)
SELECT d.source, coalesce((SELECT arg_min(lang, struct_pack(k := -n, l := lang)) FROM c WHERE c.source = d.source), 'und') AS language FROM (SELECT DISTINCT source FROM documents) d""")
def language_vote(spark, sf_dir):
    return language.vote(_documents(spark, sf_dir), ["source"], "lang")


@_query(r"""WITH w AS (SELECT doc_id, lang, source, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents),
fitted AS (SELECT lang, word, count(*) AS cnt FROM w WHERE lang IS NOT NULL AND regexp_matches(source, '[02468]$') GROUP BY ALL),
voc AS (SELECT word, unnest(list_transform(range(1, length(word) + 1), lambda i: substr('_' || word || '_', i, 3))) AS gram FROM (SELECT DISTINCT word FROM w)),
counts AS (SELECT lang, gram, sum(cnt)::BIGINT AS c FROM fitted JOIN voc USING (word) GROUP BY ALL),
base AS (SELECT lang, -floor(1000 * ln((sum(c) + (SELECT count(DISTINCT gram) FROM counts))::DOUBLE))::BIGINT AS base FROM counts GROUP BY lang),
gains AS (SELECT word, lang, sum(floor(1000 * ln((c + 1)::DOUBLE))::BIGINT)::BIGINT AS gain FROM voc JOIN counts USING (gram) GROUP BY ALL),
dw AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL),
gained AS (SELECT doc_id, gains.lang, sum(n * gain)::BIGINT AS gained FROM dw JOIN gains USING (word) GROUP BY ALL),
total AS (SELECT doc_id, sum(n * length(word))::BIGINT AS grams FROM dw GROUP BY doc_id),
best AS (SELECT t.doc_id, arg_min(b.lang, struct_pack(s := -(grams * base + coalesce(gained, 0)), l := b.lang)) AS language FROM total t, base b LEFT JOIN gained g ON g.doc_id = t.doc_id AND g.lang = b.lang GROUP BY t.doc_id)
SELECT d.doc_id, coalesce(language, 'und') AS language FROM documents d LEFT JOIN best ON d.doc_id = best.doc_id""")
def language_model(spark, sf_dir):
    """Every document's language by a model of the books with even numbers."""
    docs = _documents(spark, sf_dir)
    words = X.each(docs.where(F.col("source").rlike("[02468]$")), "lang", word=F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    model = language.fit(words.groupBy(F.col("lang").alias("language"), "word").agg(F.count("*").alias("cnt")))
    return language.identify(docs.select("doc_id", "text"), ["doc_id"], model)


@_query(_with(TOKENS, UNION, POPULAR, """m AS (SELECT word, sum(cnt)::BIGINT AS cnt FROM pop GROUP BY word),
d AS (SELECT *, CASE WHEN regexp_matches(word, '[а-яА-Я]') THEN 'ru' ELSE 'en' END AS src_lang FROM m)""", then="""SELECT word, cnt, src_lang, CASE WHEN src_lang = 'ru' THEN 'en' ELSE 'ru' END AS tgt_lang,
  floor((row_number() OVER (PARTITION BY src_lang ORDER BY cnt DESC, word) - 1) / 800)::BIGINT AS batch FROM d"""))  # fmt: skip
def translation_batches(spark, sf_dir):
    return translation.batches(_popular(spark, sf_dir).groupBy("word").agg(F.sum("cnt").alias("cnt")))


@_query(_with(TOKENS, UNION, POPULAR, """m AS (SELECT word, sum(cnt)::BIGINT AS cnt FROM pop GROUP BY word),
d AS (SELECT *, CASE WHEN regexp_matches(word, '[а-яА-Я]') THEN 'ru' ELSE 'en' END AS src_lang FROM m),
n AS (SELECT *, row_number() OVER (PARTITION BY src_lang ORDER BY cnt DESC, word) AS rn FROM d)""", then="""SELECT src_lang, ((rn - 1) // 800)::BIGINT AS batch,
  '{"folderId":"f","texts":[' || string_agg('"' || word || '"', ',' ORDER BY rn) || '],"targetLanguageCode":"' || CASE WHEN src_lang = 'ru' THEN 'en' ELSE 'ru' END || '"}' AS body
FROM n GROUP BY src_lang, (rn - 1) // 800"""))  # fmt: skip
def translation_requests(spark, sf_dir):
    words = _popular(spark, sf_dir).groupBy("word").agg(F.sum("cnt").alias("cnt"))
    return translation.requests(words, folderId="f").select("src_lang", "batch", "body")


@_query(_with(TOKENS, UNION, POPULAR, """n AS (SELECT word, row_number() OVER (ORDER BY cnt DESC, word) AS rn FROM (SELECT word, sum(cnt)::BIGINT AS cnt FROM pop GROUP BY word))""",
              then="SELECT word, CASE WHEN (rn - 1) // 800 % 3 = 1 THEN '—' ELSE reverse(word) END AS translation FROM n"))
def translation_answers(spark, sf_dir):
    """Responses made of the requests, every third of them broken, read back."""
    words = _popular(spark, sf_dir).groupBy("word").agg(F.sum("cnt").alias("cnt"))
    asked = translation.requests(words, folderId="f")
    texts = F.transform(F.from_json("body", "texts array<string>")["texts"], lambda t: F.struct(F.reverse(t).alias("text"), F.lit("en").alias("detectedLanguageCode")))
    body = F.when(F.col("batch") % 3 == 1, '{"code": 429}').otherwise(F.to_json(F.struct(texts.alias("translations"))))
    return translation.answered(asked, asked.select("src_lang", "batch", body.alias("body")))


def _cache(union: DataFrame) -> DataFrame:
    words = union.select("word").distinct()
    return words.where(F.length("word") % 2 == 0).select("word", F.reverse("word").alias("translation"))


@_query(_with(TOKENS, UNION, POPULAR, CACHE, then=f"SELECT category, word, cnt, translation FROM pop JOIN cache USING (word) WHERE {VALID.format(t='translation', w='word')}"))
def cache_lookup(spark, sf_dir):
    union = _union(spark, sf_dir)
    return translation.cached(popularity.popular_words(union), _cache(union)).select("category", "word", "cnt", "translation")


@_query(_with(TOKENS, UNION, POPULAR, CACHE, then="SELECT category, word, cnt FROM pop WHERE NOT EXISTS (SELECT 1 FROM cache c WHERE c.word = pop.word)"))
def cache_misses(spark, sf_dir):
    union = _union(spark, sf_dir)
    return translation.missing(popularity.popular_words(union).select("category", "word", "cnt"), _cache(union))


NEW = "nw AS (SELECT row_number() OVER (ORDER BY cnt DESC, word) AS seq, word, left(word, 3) AS translation FROM (SELECT word, sum(cnt)::BIGINT AS cnt FROM pop GROUP BY word))"


@_query(_with(TOKENS, UNION, POPULAR, CACHE, NEW, f"""g AS (SELECT * FROM nw WHERE {VALID.format(t='translation', w='word')}),
b AS (SELECT 2 * seq AS a, word, translation FROM g UNION ALL SELECT 2 * seq + 1, translation, word FROM g),
f AS (SELECT word, arg_min(translation, a) AS translation FROM b GROUP BY word)""", then="SELECT word, translation FROM f WHERE NOT EXISTS (SELECT 1 FROM cache c WHERE c.word = f.word)"))  # fmt: skip
def cache_bidirectional(spark, sf_dir):
    union = _union(spark, sf_dir)
    words = ranked_in_ranges(popularity.popular_words(union).groupBy("word").agg(F.sum("cnt").alias("cnt")), [])
    new = words.select(F.col("rn").alias("seq"), "word", F.substring("word", 1, 3).alias("translation"))
    return translation.remembered(new, _cache(union))


@_query(_with(TOKENS, UNION, POPULAR, """o AS (SELECT category, word, 0::BIGINT AS cnt, word || 'x' AS translation FROM gu WHERE length(word) = 5),
n AS MATERIALIZED (SELECT category, word, cnt, reverse(word) AS translation FROM pop)""", then="SELECT * FROM n UNION ALL SELECT o.* FROM o ANTI JOIN n USING (category, word)"))  # fmt: skip
def translations_upsert(spark, sf_dir):
    union = _union(spark, sf_dir)
    old = union.where(F.length("word") == 5).select("category", "word", F.lit(0).cast("long").alias("cnt"), F.concat("word", F.lit("x")).alias("translation"))
    new = popularity.popular_words(union).select("category", "word", "cnt", F.reverse("word").alias("translation"))
    return translation.upserted(old, new, ["category", "word"])


@_query(_with(TOKENS, UNION, POPULAR, """o AS (SELECT category, word, 0::BIGINT AS cnt, word || 'x' AS translation FROM gu WHERE length(word) = 5),
n AS MATERIALIZED (SELECT category, word, cnt, reverse(word) AS translation FROM pop)""", then="SELECT 2 AS version, * FROM n UNION ALL SELECT 2, o.* FROM o ANTI JOIN n USING (category, word) UNION ALL SELECT 1, * FROM o"))  # fmt: skip
def stored_translations(spark, sf_dir):
    """Translations stored in one version and upserted in the next; both are read back."""
    union = _union(spark, sf_dir)
    stored = StoredTable(spark, new_path(spark, "translations"), "category string, word string, cnt long, translation string")
    stored.commit(union.where(F.length("word") == 5).select("category", "word", F.lit(0).alias("cnt"), F.concat("word", F.lit("x")).alias("translation")))
    stored.upsert(popularity.popular_words(union).select("category", "word", "cnt", F.reverse("word").alias("translation")), ["category", "word"])
    versions = [stored.read(v).select(F.lit(v).alias("version"), "*") for v in stored.versions()]
    return versions[0].unionByName(versions[1])


@_query(_with(TOKENS, UNION, CACHE, then="SELECT category, word, cnt, translation FROM gu LEFT JOIN cache USING (word)"))
def word_with_translation(spark, sf_dir):
    union = _union(spark, sf_dir)
    return translation.with_translation(union, _cache(union)).select("category", "word", "cnt", "translation")


@_query(_with(TOKENS, UNION, CACHE, then="SELECT category, word, cnt, translation FROM gu LEFT JOIN cache USING (word) WHERE word = 'with'"))
def word_lookup(spark, sf_dir):
    union = _union(spark, sf_dir)
    return translation.with_translation(union, _cache(union), "with").select("category", "word", "cnt", "translation")


def _indexed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The union and the cache, both in buckets by word."""
    found = []
    union = _union(spark, sf_dir)
    for kind, rows in (("union", union), ("cache", _cache(union))):
        name = f"lexmill_{kind}_{uuid.uuid4().hex}"
        tables.bucketed(rows, name, "word", buckets=8)
        found.append(spark.table(name))
    return found[0], found[1]


@_query(_with(TOKENS, UNION, CACHE, then="SELECT category, word, cnt, translation FROM gu LEFT JOIN cache USING (word) WHERE word IN ('with', 'nicht', 'leur')"))
def indexed_lookup(spark, sf_dir):
    """word_lookup over bucketed tables: one bucket of each for each of the words."""
    union, cache = (x.where(F.col("word").isin("with", "nicht", "leur")) for x in _indexed(spark, sf_dir))
    return translation.with_translation(union, cache).select("category", "word", "cnt", "translation")


@_query(_with(TOKENS, UNION, CACHE, then=f"SELECT category, word, cnt, translation FROM gu JOIN cache USING (word) WHERE {VALID.format(t='translation', w='word')}"))
def indexed_cache(spark, sf_dir):
    """cache_lookup of the whole union over bucketed tables: a join without a shuffle."""
    return translation.cached(*_indexed(spark, sf_dir)).select("category", "word", "cnt", "translation")


@_query(_with(TOKENS, UNION, POPULAR, CACHE, f"""c AS (SELECT category, word, translation FROM pop JOIN cache USING (word) WHERE {VALID.format(t='translation', w='word')}),
n AS (SELECT category, word, left(word, 3) AS translation FROM pop WHERE NOT EXISTS (SELECT 1 FROM cache k WHERE k.word = pop.word))""", then="SELECT * FROM c UNION ALL SELECT * FROM n"))  # fmt: skip
def merged_translations(spark, sf_dir):
    union = _union(spark, sf_dir)
    popular, cache = cut(popularity.popular_words(union), "popular"), _cache(union)
    new = translation.missing(popular, cache).select("category", "word", F.substring("word", 1, 3).alias("translation"))
    return translation.cached(popular, cache).select("category", "word", "translation").unionByName(new)


# ---- ledger and tables ----

PATHS = "SELECT DISTINCT lang || '/' || source || '.txt' AS book_path, lang AS category, source AS book FROM documents"


def _paths(spark, sf_dir) -> DataFrame:
    books = _documents(spark, sf_dir).select(F.col("lang").alias("category"), F.col("source").alias("book")).distinct()
    return books.select(F.concat("category", F.lit("/"), "book", F.lit(".txt")).alias("book_path"), "category", "book")


def _done(spark, sf_dir) -> DataFrame:
    """A ledger of the books whose number ends in 5 or more."""
    done = _paths(spark, sf_dir).where(F.col("book").rlike("[5-9]$")).select("book_path", F.lit(1).alias("word_count"))
    return ledger.marked(ledger.empty_ledger(spark), done)


@_query(f"SELECT * FROM ({PATHS}) WHERE NOT regexp_matches(book, '[5-9]$')")
def ledger_pending(spark, sf_dir):
    return ledger.pending(_paths(spark, sf_dir), _done(spark, sf_dir))


@_query(_with(TOKENS, f"p AS ({PATHS})", "k AS (SELECT category, book, count(*) AS word_count FROM wc GROUP BY ALL)", then="""SELECT book_path, word_count FROM p JOIN k USING (category, book) WHERE regexp_matches(book, '[0-6]$')
UNION ALL SELECT book_path, 1 FROM p WHERE regexp_matches(book, '[7-9]$')"""))  # fmt: skip
def ledger_upsert(spark, sf_dir):
    counts = _words(spark, sf_dir).where(F.col("book").rlike("[0-6]$")).groupBy("category", "book").agg(F.count("*").alias("word_count"))
    done = counts.select(F.concat("category", F.lit("/"), "book", F.lit(".txt")).alias("book_path"), "word_count")
    return ledger.marked(_done(spark, sf_dir), done).select("book_path", "word_count")


@_query("SELECT DISTINCT source AS book, lang AS category, n_chars FROM documents")
def insert_dedup(spark, sf_dir):
    return _documents(spark, sf_dir).select(F.col("source").alias("book"), F.col("lang").alias("category"), "n_chars").dropDuplicates()


@_query("SELECT DISTINCT lang AS category FROM documents WHERE lang <> ''")
def categories(spark, sf_dir):
    return _paths(spark, sf_dir).select(F.split_part(X.plain_name(F.col("book_path")), F.lit("/"), F.lit(1)).alias("category")).where("category <> ''").distinct()


@_query("SELECT lang AS category, count(DISTINCT source) AS books, count(*) AS docs FROM documents GROUP BY lang")
def table_catalog(spark, sf_dir):
    return _books(spark, sf_dir).groupBy("category").agg(F.count_distinct("book").alias("books"), F.count("*").alias("docs"))


# ---- names and folders ----

ADDRESS = "a AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)/', 1) AS host, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS path FROM pages)"


@_query(_with(ADDRESS, "n AS (SELECT page_id, regexp_replace(string_split(path, '.')[1], '[^a-zA-Z0-9а-яА-ЯёЁ/]', '', 'g') AS name FROM a)", then="SELECT page_id, split_part(name, '/', 1) AS category, split_part(name, '/', 2) AS book FROM n"))
def normalize_names(spark, sf_dir):
    named = files.named(_pages(spark, sf_dir).select(F.col("path").alias("book_path"), F.col("page_id").cast("string").alias("text")))
    return named.select(F.col("text").cast("long").alias("page_id"), "category", "book")


def _clean_sql(name: str) -> str:
    out = name
    for old, new in ((".", "_"), (" ", "_"), (",", "_"), ("__", "_"), ("___", "_"), ("[", "_"), ("]", "_"), ("_pdf", ".pdf")):
        out = f"replace({out}, '{old}', '{new}')"
    return f"CASE WHEN length({name}) - length(replace({name}, '.', '')) > 1 THEN {out} ELSE {name} END"


@_query(_with(ADDRESS, then=f"SELECT page_id, host AS name, {_clean_sql('host')} AS clean_name FROM a"))
def clean_filenames(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.col("host").alias("name"), X.clean_filename(F.col("host")).alias("clean_name"))


@_query(_with(ADDRESS, f"f AS (SELECT DISTINCT coalesce(host, '') AS folder, left(host, 3) || '.' || path AS name FROM a), w AS (SELECT folder, name, {_clean_sql('name')} AS target FROM f)",
              then="SELECT folder, min(name) AS name, target FROM w WHERE name <> target AND NOT EXISTS (SELECT 1 FROM f WHERE f.folder = w.folder AND f.name = w.target) GROUP BY folder, target"))
def planned_renames(spark, sf_dir):
    """Which files of a tree made of the pages' addresses get a new name."""
    return renames.targets(_pages(spark, sf_dir).select(F.col("host").alias("folder"), F.concat(F.left("host", F.lit(3)), F.lit("."), "path").alias("name")))


def _tree(spark, sf_dir) -> DataFrame:
    return _pages(spark, sf_dir).select(F.concat("host", F.lit("/"), "path").alias("path"))


@_query(_with(ADDRESS, then=r"""SELECT DISTINCT regexp_replace(split_part(path, '/', 1), '[^a-zA-Z0-9\x{0400}-\x{04FF}]', '', 'g') AS category FROM a
WHERE contains(path, '/') AND regexp_replace(split_part(path, '/', 1), '[^a-zA-Z0-9\x{0400}-\x{04FF}]', '', 'g') <> ''"""))  # fmt: skip
def initial_categories(spark, sf_dir):
    return files.initial_categories(_pages(spark, sf_dir))


TREE = "t AS (SELECT string_split(host || '/' || path, '/') AS p FROM a)"


@_query(_with(ADDRESS, TREE, "f AS (SELECT DISTINCT array_to_string(p[1:n], '/') AS folder, n FROM (SELECT p, unnest(range(1, len(p))) AS n FROM t))", then="SELECT folder, n::BIGINT AS depth FROM f"))
def folder_listing(spark, sf_dir):
    return files.folders(_tree(spark, sf_dir))


@_query(_with(ADDRESS, TREE, then="SELECT DISTINCT p[2] AS category, p[3] AS file, p[2] || '/' || p[3] AS book_path FROM t WHERE len(p) = 3"))
def depth2_files(spark, sf_dir):
    return files.depth_two_files(_tree(spark, sf_dir))


@_query("SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS k FROM (SELECT DISTINCT lang AS src, source AS dst FROM documents)) WHERE k <= 8")
def callgraph_prune(spark, sf_dir):
    return pruned(_documents(spark, sf_dir).select(F.col("lang").alias("src"), F.col("source").alias("dst")).distinct())


# ---- tables, refresh, call graphs ----

@_query(_with(TOKENS, then="SELECT category, book, word, cnt FROM wc WHERE book NOT IN ('src0', 'src1') UNION ALL SELECT category, book, word, cnt FROM wc WHERE book IN ('src0', 'src1')"))
def table_words(spark, sf_dir):
    """Words written to a table of the engine's own in two batches, each row of the first twice, and read back."""
    name = f"lexmill_table_words_{uuid.uuid4().hex}"  # a warehouse may still hold what an earlier session wrote
    tables.create(spark, name, "book_words", "category")
    words = _words(spark, sf_dir)
    general = F.col("book").isin(*GENERAL)
    tables.append(words.where(~general).unionByName(words.where(~general)), name)
    tables.append(words.where(general), name)
    return spark.table(name).select("category", "book", "word", "cnt")


@_query(_with(TOKENS, UNION, then="SELECT category, word, CASE WHEN category IN ('de', 'en') THEN -cnt ELSE cnt END AS cnt FROM gu WHERE category NOT IN ('de', 'en') OR cnt > 1"))
def replaced_categories(spark, sf_dir):
    """The union stored by category; then two categories are replaced, by other rows, and the others stay."""
    name = f"lexmill_replaced_{uuid.uuid4().hex}"
    tables.create(spark, name, "global_union", "category")
    union = _union(spark, sf_dir)
    tables.append(union, name)
    tables.replace_partitions(union.where(F.col("category").isin("de", "en") & (F.col("cnt") > 1)).withColumn("cnt", -F.col("cnt")), name)
    return spark.table(name).select("category", "word", "cnt")


@_query(_with(TOKENS, f"every AS ({INTERSECTION.format(words='wc', general='')})", """gb AS (SELECT category, word, sum(cnt)::BIGINT AS cnt, count(*) AS books FROM wc GROUP BY ALL)""",
              then="SELECT gb.*, every.word IS NOT NULL AS everywhere FROM gb LEFT JOIN every ON gb.category = every.category AND gb.word = every.word"))
def running_vocabulary(spark, sf_dir):
    """Counts and numbers of books kept over three batches of books, the second of which comes twice, and whether all books of the category have the word."""
    running = RunningVocabulary(spark, new_path(spark, "running"), mend=False)
    paths = _books(spark, sf_dir).withColumn("book_path", F.concat_ws("/", "category", F.concat("book", F.lit(".txt"))))
    for number, last in enumerate(("[0-3]$", "[4-6]$", "[4-6]$", "[7-9]$")):
        running.apply(paths.where(F.col("book").rlike(last)), number)
    every = running.intersection().select("category", "word", F.lit(True).alias("everywhere"))
    return running.words.read().join(every, ["category", "word"], "left").withColumn("everywhere", F.coalesce("everywhere", F.lit(False)))


@_query(_with(TOKENS, UNION, then="SELECT * FROM gu"))
def refreshed_union(spark, sf_dir):
    """The union of all books but those whose number is over 14, then refreshed with them."""
    books, words = _books(spark, sf_dir), _words(spark, sf_dir)
    late = F.col("book").rlike("1[5-9]$")
    old = {"global_union": vocabulary.union_of_books(words.where(~late)), "word_intersection": vocabulary.intersection_of_books(words.where(~late), books.where(~late))}
    return pipeline.refreshed(old, words, books, books.where(late))["global_union"]


@_query(_with(TOKENS, UNION, then="SELECT category, word, cnt FROM gu ORDER BY category, cnt DESC, word"))
def union_in_order(spark, sf_dir):
    return in_order(_union(spark, sf_dir), "category")


@_query(_with(TOKENS, UNION, CACHE, then="SELECT category, word, cnt, translation FROM gu LEFT JOIN cache USING (word) WHERE word = 'with' ORDER BY category, cnt, translation LIMIT 1"))
def word_lookup_first(spark, sf_dir):
    union = _union(spark, sf_dir)
    return translation.first_translation(union, _cache(union), "with").select("category", "word", "cnt", "translation")


def _sources(spark, sf_dir) -> DataFrame:
    """Python sources made of the table nation: a module for each region, functions whose names recur within and across modules."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    name = lambda k: F.concat(F.lit("f"), (k % 7).cast("string"))
    code = F.concat(F.lit("def "), name(F.col("n_nationkey")), F.lit("(self, a, b):\n    \"\"\"What it does.\n\n    More.\"\"\"\n    return other."), name(3 * F.col("n_nationkey")), F.lit("(a, print(b))\n"))
    each = nation.select(F.concat(F.lit("m"), F.col("n_regionkey").cast("string")).alias("module"), "n_nationkey", code.alias("code"))
    return each.groupBy("module").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "code"))), lambda x: x["code"]), "\n").alias("source"))


CALLS = """fn AS (SELECT 'm' || n_regionkey AS module, 'f' || (n_nationkey % 7) AS name, 'f' || (3 * n_nationkey % 7) AS callee FROM nation),
ed AS (SELECT DISTINCT a.module || '.' || a.name AS src, b.module || '.' || b.name AS dst, a.module <> b.module AS crosses FROM fn a JOIN fn b ON a.callee = b.name)"""


@_query(f"WITH {CALLS} SELECT * FROM ed")
def callgraph_edges(spark, sf_dir):
    return callgraph.edges(callgraph.functions(_sources(spark, sf_dir)))


@_query(f"""WITH {CALLS} SELECT 0 AS part, 'digraph calls {{' AS line UNION ALL SELECT 3, '}}'
UNION ALL SELECT DISTINCT 1, '"' || module || '.' || name || '" [label="' || name || '(a, b)\\nWhat it does.", group="' || module || '"];' FROM fn
UNION ALL SELECT 2, '"' || src || '" -> "' || dst || '"' || CASE WHEN crosses THEN ' [penwidth=1.4]' ELSE '' END || ';' FROM ed""")
def callgraph_dot(spark, sf_dir):
    found = callgraph.functions(_sources(spark, sf_dir))
    return callgraph.dot(found, callgraph.edges(found))
