"""Words spelled alike within a book: pairs, connected groups, and merging into the most frequent word.

Two words are alike if they share their first letters, differ in length by one at most, and are at
most two edits and a quarter of the longer one's length apart.

Pairs. Words meet on (category, book, beginning) and the length of the longer one. Those of a beginning that few words have are compared with one another, first by their
letters: an edit changes two letters of a word's set at most. Where many words begin alike, what follows the beginning is written with letters left out. Of words k edits apart or fewer, the longer by g letters, k letters left out of
the longer one and k - g of the shorter one can leave the same, so only words that have one such rest in common are compared; a rest of k letters or fewer leaves nothing, but such words are as few as the letters there are.
The rests are made where the words of a beginning and length are, after they were dealt out, so only words are shuffled; those of a beginning that more words have than one task should hold are dealt out themselves.

Groups can't cross a beginning. Those of one (category, book, beginning) are found inside a partition, in one pass; where there are
too many pairs of one beginning for that, in rounds over the cluster.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators.graphs import connected_components
from lexmill.operators.joins import join_same
from lexmill.schemas import DEFAULT, Settings
from lexmill.sources.scratch import cut

#: Words of one (category, book, beginning) that are compared all with all: so many take less time than their rests do.
WORDS_COMPARED = 2_000
#: Words of one (category, book, beginning) whose rests are made in one task.
WORDS_IN_ONE_TASK = 200_000
#: Pairs that one task compares, about, and words whose rests it makes.
COMPARED_IN_ONE_TASK, RESTS_IN_ONE_TASK = 4_000_000, 20_000
#: Pairs of one (category, book, beginning) whose groups are found in one task's memory.
PAIRS_IN_ONE_TASK = 1_000_000
#: Pairs of all beginnings of one task together, about.
PAIRS_A_TASK = 250_000


def alike(a: Column, b: Column, settings: Settings = DEFAULT) -> Column:
    # the distance is written once: what a condition has twice is made before the rest of it, for every pair
    near = F.call_function("levenshtein", a, b, _edits(F.greatest(F.length(a), F.length(b)), settings)) >= 0  # -1: farther
    return F.when(F.abs(F.length(a) - F.length(b)) <= settings.length_gap, near).otherwise(False)


def _edits(length: Column, settings: Settings) -> Column:
    """How many edits a pair may be apart whose longer word has this length."""
    return F.least(F.lit(settings.edits), F.floor(settings.edit_share * length).cast("int"))


def _left_out(rest: Column, n: int) -> Column:
    """array<string>: what is left of a text of n letters or more if any n of them are left out."""
    if n == 0:
        return F.array(rest)
    last = lambda i: F.transform(_left_out(F.left(rest, i - 1), n - 1), lambda x: F.concat(x, F.substring(rest, i + 1, F.length(rest))))
    return F.flatten(F.transform(F.sequence(F.lit(n), F.length(rest)), last))


def _as_longer(long_words: DataFrame, settings: Settings, *facts: Column) -> DataFrame:
    """long_words once for each length of a longer word that they may be alike to: that `size`, the edits `k` it allows, by how much they are `shorter`."""
    length = F.length("word")
    sizes = F.array(*[F.struct((length + g).alias("size"), _edits(length + g, settings).alias("k"), F.lit(g).alias("shorter")) for g in range(settings.length_gap + 1)])
    found = long_words.select("*", *facts, F.explode(sizes).alias("_s"))
    return found.where("_s.k >= _s.shorter").select(*long_words.columns, *[f for f in found.columns if f not in [*long_words.columns, "_s"]], "_s.size", "_s.k", "_s.shorter")


def met_pairs(words: DataFrame, settings: Settings = DEFAULT, tasks: int | None = None) -> DataFrame:
    """(category, book, prefix, word_a, cnt_a, word_b, cnt_b) of words that have a rest in common, some of them more than once; word_a is the shorter, then the first.

    tasks: words are dealt over so many, by beginning and length; without it their rests are.
    """
    keys = ["category", "book", "prefix"]
    long_words = words.where(F.length("word") >= settings.merge_from).select("category", "book", "word", "cnt", F.substring("word", 1, settings.prefix).alias("prefix"))
    sized = _as_longer(long_words, settings)
    if tasks:
        sized = sized.repartition(tasks, *keys, "size")
    rest = F.substring("word", settings.prefix + 1, F.length("word"))
    # no more letters are left out of the shorter word than it has, and as many more of the longer one as it is longer
    out = F.least(F.col("k") - F.col("shorter"), F.length(rest))
    rests = F.array_distinct(reduce(lambda so_far, n: F.when(out == n, _left_out(rest, n)).otherwise(so_far), range(1, settings.edits + 1), F.array(rest)))
    one = F.struct("word", "cnt")
    met = X.each(sized.select("*", rests.alias("rests")), *keys, "size", "word", "cnt", "shorter", on=F.col("rests")).groupBy(*keys, "size", "on")
    met = met.agg(F.collect_list(one).alias("a"), F.collect_list(F.when(F.col("shorter") == 0, one)).alias("b")).where((F.size("a") > 1) & (F.size("b") > 0))
    met = met.select(*keys, "size", "a", F.explode("b").alias("b")).select(*keys, "size", F.explode("a").alias("a"), "b")
    met = met.where((F.length("a.word") < F.length("b.word")) | (F.col("a.word") < F.col("b.word")))
    return met.select(*keys, "size", F.col("a.word").alias("word_a"), F.col("a.cnt").alias("cnt_a"), F.col("b.word").alias("word_b"), F.col("b.cnt").alias("cnt_b"))


def _letters(word: Column) -> Column:
    """The set of a word's letters, as bits by their code points."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(x) % 64)))


def _compared(long_words: DataFrame, settings: Settings, tasks: int) -> DataFrame:
    """Pairs as met_pairs() has them, of words that are compared all with all, those that are alike."""
    keys = ["category", "book", "prefix"]
    sized = _as_longer(long_words, settings, _letters(F.col("word")).alias("letters")).withColumn("on", F.xxhash64(*keys, "size"))
    side = lambda df, x: df.select("on", "k", *[F.col(c).alias(f"{c}_{x}") for c in (*keys, "word", "cnt", "letters")]).repartition(tasks, "on")
    met = side(sized, "a").join(side(sized.where("shorter = 0"), "b").drop("k"), "on")
    order = (F.length("word_a") < F.length("word_b")) | (F.col("word_a") < F.col("word_b"))
    few = F.bit_count(F.col("letters_a").bitwiseXOR(F.col("letters_b"))) <= 2 * F.col("k")
    same = reduce(lambda x, y: x & y, [F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")) for c in keys])
    # one expression: the optimizer would put the distance first, and make keys of the rest
    met = met.where(F.when(few & order & same, alike(F.col("word_a"), F.col("word_b"), settings)).otherwise(False))
    return met.select(*[F.col(f"{c}_a").alias(c) for c in keys], "word_a", "cnt_a", "word_b", "cnt_b")


def similar_pairs(words: DataFrame, settings: Settings = DEFAULT, block: int = WORDS_COMPARED, most: int = WORDS_IN_ONE_TASK) -> DataFrame:
    """(category, book, prefix, word_a, cnt_a, word_b, cnt_b), the more frequent (then alphabetically first) word as a.

    A (category, book, beginning) with up to `block` words has all of them compared, one with more by what is left of them without some letters, over the cluster from `most` on; the pairs are the same.
    """
    keys = ["category", "book", "prefix"]
    long_words = cut(words.where(F.length("word") >= settings.merge_from).select("category", "book", "word", "cnt", F.substring("word", 1, settings.prefix).alias("prefix")), "long-words")
    lengths = long_words.groupBy(*keys, F.length("word").alias("size")).agg(F.count("*").alias("n"))
    sizes = cut(lengths.groupBy(*keys).agg(F.sum("n").alias("_n"), F.sum(F.col("n") * F.col("n")).alias("_work")), "beginnings")
    crowded, many = F.col("_n") > block, F.col("_n") > most
    work, rests, spread = sizes.agg(F.sum(F.when(~crowded, F.col("_work"))), F.sum(F.when(crowded & ~many, F.col("_n"))), F.count_if(crowded & many)).first()
    of = lambda which, how: join_same(long_words, sizes.where(which).select(*keys), keys, how)
    near = alike(F.col("word_a"), F.col("word_b"), settings)
    pairs = _compared(of(crowded, "left_anti") if rests or spread else long_words, settings, math.ceil((work or 1) / COMPARED_IN_ONE_TASK))
    # a pair is found by each rest it shares, in the task that has its beginning and length
    once = lambda met: met.where(near).distinct().drop("size")
    if rests:
        pairs = pairs.unionByName(once(met_pairs(of(crowded & ~many, "left_semi"), settings, math.ceil(rests / RESTS_IN_ONE_TASK))))
    if spread:
        pairs = pairs.unionByName(once(met_pairs(of(crowded & many, "left_semi"), settings)))
    first = (F.col("cnt_a") > F.col("cnt_b")) | ((F.col("cnt_a") == F.col("cnt_b")) & (F.col("word_a") < F.col("word_b")))
    a, b = F.struct(F.col("word_a").alias("word"), F.col("cnt_a").alias("cnt")), F.struct(F.col("word_b").alias("word"), F.col("cnt_b").alias("cnt"))
    ordered = pairs.select(*keys, F.when(first, a).otherwise(b).alias("a"), F.when(first, b).otherwise(a).alias("b"))
    return ordered.select(*keys, F.col("a.word").alias("word_a"), F.col("a.cnt").alias("cnt_a"), F.col("b.word").alias("word_b"), F.col("b.cnt").alias("cnt_b"))


def _close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs sorted by group: (category, book, word, head_word) of every word in a pair."""
    held: tuple | None = None
    parent: dict[str, str] = {}
    count: dict[str, int] = {}
    out: list[tuple] = []

    def root(w: str) -> str:
        while parent[w] != w:
            parent[w] = parent[parent[w]]
            w = parent[w]
        return w

    def first(a: str, b: str) -> bool:
        return (-count[a], a) < (-count[b], b)

    def close() -> None:
        out.extend((held[0], held[1], w, root(w)) for w in parent)
        parent.clear()
        count.clear()

    def frame() -> pd.DataFrame:
        return pd.DataFrame(out, columns=["category", "book", "word", "head_word"])

    for batch in batches:
        for category, book, prefix, a, n, b, m in batch.itertuples(index=False, name=None):
            if held != (category, book, prefix):
                if held is not None:
                    close()
                held = (category, book, prefix)
            for w, k in ((a, n), (b, m)):
                if w not in parent:
                    parent[w], count[w] = w, k
            x, y = root(a), root(b)
            if x != y:
                x, y = (x, y) if first(x, y) else (y, x)
                parent[y] = x
        if len(out) > 50_000:
            yield frame()
            out.clear()
    if held is not None:
        close()
    if out:
        yield frame()


def _over_the_cluster(pairs: DataFrame) -> DataFrame:
    """components() of pairs of which one beginning may have any number: words get numbers, the numbers components, those their heads."""
    keys = ["category", "book", "prefix"]
    sides = [pairs.select(*keys, F.col(f"word_{x}").alias("word"), F.col(f"cnt_{x}").alias("cnt")) for x in "ab"]
    words = cut(sides[0].unionByName(sides[1]).distinct().withColumn("_id", F.monotonically_increasing_id()), "similar-words")
    edges = pairs.select(*keys, "word_a", "word_b")
    for x in "ab":
        edges = join_same(edges, words.select(*keys, F.col("word").alias(f"word_{x}"), F.col("_id").alias(x)), [*keys, f"word_{x}"])
    groups = connected_components(edges.select("a", "b"), "similar")
    named = words.join(groups, words["_id"] == groups["node"])
    head = named.groupBy("component").agg(F.min_by("word", F.struct(-F.col("cnt"), "word")).alias("head_word"))
    return named.join(head, "component").select("category", "book", "word", "head_word")


def components(pairs: DataFrame, most: int = PAIRS_IN_ONE_TASK) -> DataFrame:
    """(category, book, word, head_word): the connected groups of pairs, headed by their most frequent word.

    Pairs are written once. A (category, book, beginning) with over `most` of them isn't gathered.
    """
    keys = ["category", "book", "prefix"]
    found = cut(pairs, "similar-pairs")
    crowded = cut(found.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(*keys), "similar-crowded")
    few = found if (none := crowded.isEmpty()) else join_same(found, crowded, keys, "left_anti")
    # tasks by pairs, so that what one of them sorts does not grow with the input
    near = few.repartition(math.ceil((found.count() or 1) / PAIRS_A_TASK), *keys).sortWithinPartitions(*keys).mapInPandas(_close, "category string, book string, word string, head_word string")
    return near if none else near.unionByName(_over_the_cluster(join_same(found, crowded, keys, "left_semi")))


def merge_targets(words: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """words with `target`: the head of the word's group where it is alike to it, else the word itself."""
    words = cut(words, "words")  # read for the pairs, and once more here
    heads = components(similar_pairs(words, settings))
    joined = join_same(words, heads, ["category", "book", "word"], "left")
    target = F.when(alike(F.col("word"), F.col("head_word"), settings), F.col("head_word")).otherwise(F.col("word"))
    return joined.select(*words.columns, target.alias("target"))


def clustered(targets: DataFrame) -> DataFrame:
    """(category, book, word, cnt) after merging."""
    return targets.groupBy("category", "book", F.col("target").alias("word")).agg(F.sum("cnt").alias("cnt"))


def deleted(targets: DataFrame) -> DataFrame:
    """(category, book, deleted_word, cnt, merged_to)."""
    return targets.where("word <> target").select("category", "book", F.col("word").alias("deleted_word"), "cnt", F.col("target").alias("merged_to"))
