"""Merkle manifest of a dataset: a trie over exact ranks, with a proof for every row.

Every row is a leaf: the SHA-256 of its fields, each `-` if null, else its length in bytes, a colon and its value. Leaves of a
group are numbered by their key; the digits of a number, base 8, are the leaf's way from the group's root, so nodes are keyed by
prefixes of digits and reduced from the longest prefix on: all nodes under one prefix, 8 at most, become one. Roots of groups
are numbered by the group's value, nulls first, and reduced likewise.

Ranks. No group is sorted as a whole. Keys of a group are told apart by as many of their leading digits as leave some 500 rows a
cell (digits that all keys of a cell share are skipped); cells are counted, and the rows before a cell come from this
histogram and from its roll-ups, 6 bits of a digit at a time, so a window holds 64 counts. A cell that still has over
`CELL` rows, as ids that lie close together or are equal do, is cut again by its own digits, then by those of the leaf, then of
the row's number in the table. Only cells are sorted. A group with a third of all rows, or an id that a third of all rows
share, are so dealt over tasks like any other rows.

Proofs go down the trie: a node's proof is its siblings, then its parent's proof. A run meets its parent once, and is one row
of 8 nodes, so what is shuffled at the lowest level is an eighth of the proofs.

Defined results. A null key is ordered like the smallest long. Rows with one key are ordered by their leaves; equal
leaves stand side by side, each with a proof of its own, and which of the equal rows has which is left open (their rows can't be told apart). A group
of one row has its leaf as root, and one group's root is the whole's; an empty table has no rows and no root (None). Texts
are hashed whole. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.llm.common import cut, lower_ascii, table
from lexmill.operators.ranking import placed

#: Bits of a node's digit: 8 children. Bits of a histogram's.
BITS, DIGIT = 3, 6
#: Rows that are sorted in one piece.
CELL = 2048
#: Rows of a few numbers each.
CELLS_TO_BROADCAST = 1_000_000
#: Groups, and bytes of their names.
GROUPS_TO_BROADCAST, NAMES_TO_BROADCAST = 100_000, 16 << 20
_SIGN = -(1 << 63)


def encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _shift(how: str, value: Column, by: Column) -> Column:
    return F.call_function(f"shift{how}", value, by.cast("int"))


# ---- ranks ----


def _rows_before(counts: DataFrame, cell: list[str], width: int) -> DataFrame:
    """counts (cell, _d, _n) with _before: the rows of the same cell with smaller digits. Windows hold 2 ** DIGIT counts at most."""
    inside = W.partitionBy(*cell, "_up").orderBy("_d").rowsBetween(W.unboundedPreceding, -1)
    near = counts.withColumn("_up", F.shiftright("_d", DIGIT)).withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    if width <= DIGIT:
        return near.select(*cell, "_d", "_before")
    rolled = counts.groupBy(*cell, F.shiftright("_d", DIGIT).alias("_d")).agg(F.sum("_n").alias("_n"))
    far = _rows_before(rolled, cell, width - DIGIT).withColumnsRenamed({"_d": "_up", "_before": "_far"})
    return near.join(far, [*cell, "_up"]).select(*cell, "_d", (F.col("_before") + F.col("_far")).alias("_before"))


def _small(side: DataFrame) -> DataFrame:
    return F.broadcast(side) if side.count() <= CELLS_TO_BROADCAST else side


def group_ranks(rows: DataFrame, group: str, keys: list[str], cell: int = CELL) -> DataFrame:
    """rows with `pos`: 0, 1, 2, ... within their group (a long), by keys, which are longs and together tell rows apart.

    rows should be a table: it is read three times for each digit that is looked at.
    """
    at = [group, "_base"]  # no two cells of a group have as many rows before them
    settled, todo = [], rows.withColumn("_base", F.lit(0).cast("long"))
    while True:
        span = lambda k: F.length(F.bin(F.col(f"_lo_{k}").bitwiseXOR(F.col(f"_hi_{k}"))))
        ends = [f(k).alias(f"_{n}_{k}") for k in keys for n, f in (("lo", F.min), ("hi", F.max))]
        sizes = todo.groupBy(*at).agg(F.count("*").alias("_n"), *ends).where(F.col("_n") > cell)
        which, bits = F.lit(len(keys) - 1), span(keys[-1])
        for i, k in reversed(list(enumerate(keys[:-1]))):
            differ = F.col(f"_lo_{k}") != F.col(f"_hi_{k}")
            which, bits = F.when(differ, i).otherwise(which), F.when(differ, span(k)).otherwise(bits)
        width = F.least(bits, F.ceil(F.log2(F.col("_n") / cell)).cast("int") + 2)
        crowded = cut(sizes.select(*at, which.alias("_which"), (bits - width).alias("_by"), width.alias("_width")), "rank-cells")
        widest = crowded.agg(F.max("_width")).first()[0]
        if widest is None:
            settled.append(todo)
            break
        crowded = _small(crowded)
        settled.append(todo.join(crowded, at, "left_anti"))
        key = F.col(keys[-1])
        for i, k in enumerate(keys[:-1]):
            key = F.when(F.col("_which") == i, F.col(k)).otherwise(key)
        digit = _shift("rightunsigned", key.bitwiseXOR(F.lit(_SIGN)), F.col("_by")).bitwiseAND(_shift("left", F.lit(1).cast("long"), F.col("_width")) - 1)
        split = todo.join(crowded, at).withColumn("_d", digit)
        counts = cut(split.groupBy(*at, "_d").agg(F.count("*").alias("_n")), "rank-counts")
        before = _small(cut(_rows_before(counts, at, widest), "rank-before"))
        todo = cut(split.join(before, [*at, "_d"]).select(*rows.columns, (F.col("_base") + F.col("_before")).alias("_base")), "rank-rows")
    every = settled[0]
    for more in settled[1:]:
        every = every.unionByName(more)
    place = F.row_number().over(W.partitionBy(*at).orderBy(*keys))
    return every.withColumn("pos", F.col("_base") + place - 1).drop("_base")


# ---- the trie ----


def _levels(n: Column) -> Column:
    """The levels of a tree of n leaves at which nodes are reduced."""
    return F.filter(F.sequence(F.lit(0), F.lit(63 // BITS - 1)), lambda j: _shift("left", F.lit(1).cast("long"), j * BITS) < n)


def reduced(leaves: DataFrame, most: int, *kept: str) -> tuple[list[DataFrame], DataFrame]:
    """Runs of every level, tables of (tree, n, run, of: the run's nodes in order), and the roots (tree, n, hash).

    leaves is (tree, n, idx, hash) and the columns kept, n the number of leaves of a tree, most that of the largest.
    """
    nodes, runs, roots, level = leaves, [], leaves.where("n = 1").select("tree", "n", "hash"), 0
    while 1 << (BITS * level) < most:
        one = F.struct("idx", "hash", *(kept if level == 0 else ()))
        of = F.array_sort(F.collect_list(one)).alias("of")  # 8 at most
        here = nodes.where(F.col("n") > 1 << (BITS * level)).groupBy("tree", "n", F.shiftright("idx", BITS).alias("run")).agg(of)
        runs.append(cut(here, f"trie-{level}"))
        hashes = F.array_join(F.transform("of", lambda x: x["hash"]), "")
        nodes = runs[-1].select("tree", "n", F.col("run").alias("idx"), digest(hashes).alias("hash"))
        level += 1
        roots = roots.unionByName(nodes.where((F.col("n") <= 1 << (BITS * level)) & (F.col("n") > 1 << (BITS * (level - 1)))).select("tree", "n", "hash"))
    return runs, roots


def _proofs(leaves: DataFrame, runs: list[DataFrame], tops: DataFrame, *kept: str) -> DataFrame:
    """(tree, n, idx, hash, kept, subroot, proof): a leaf's siblings, level by level, then what tops (tree, n, subroot, proof) has for its tree."""
    above = None
    for level in range(len(runs) - 1, -1, -1):
        here = tops.where((F.col("n") > 1 << (BITS * level)) & (F.col("n") <= 1 << (BITS * (level + 1))))
        here = here.select("tree", F.lit(0).cast("long").alias("run"), "subroot", "proof")
        parents = here if above is None else here.unionByName(above.select("tree", F.col("idx").alias("run"), "subroot", "proof"))
        others = lambda x: F.array_join(F.transform(F.filter("of", lambda y: y["idx"] != x["idx"]), lambda y: y["hash"]), "")
        each = F.transform("of", lambda x: F.struct(x.alias("node"), F.concat(others(x), F.col("proof")).alias("proof")))
        found = runs[level].join(parents, ["tree", "run"]).select("tree", "n", "subroot", F.explode_outer(each).alias("e"))
        above = found.select("tree", "n", "e.node.idx", "e.node.hash", *[F.col(f"e.node.{c}").alias(c) for c in (kept if level == 0 else ())], "subroot", "e.proof")
    alone = leaves.where("n = 1").join(tops.select("tree", "subroot", "proof"), "tree").select("tree", "n", "idx", "hash", *kept, "subroot", "proof")
    return alone if above is None else above.unionByName(alone)


def folded(leaf: Column, proof: Column, *ways: tuple[Column, Column]) -> Column:
    """The root that a leaf and its proof lead to; ways: its place and the number of leaves, of the group and then of the groups."""

    def climb(place: Column, n: Column):
        def step(state: Column, level: Column) -> Column:
            at = _shift("right", place, level * BITS)
            nodes = _shift("right", n + _shift("left", F.lit(1).cast("long"), level * BITS) - 1, level * BITS)
            digit = at.bitwiseAND((1 << BITS) - 1)
            others = F.least(F.lit(1 << BITS).cast("long"), nodes - (at - digit)) - 1
            off = state["off"]
            left = F.substring(proof, off + 1, (64 * digit).cast("int"))
            right = F.substring(proof, (off + 1 + 64 * digit).cast("int"), (64 * (others - digit)).cast("int"))
            return F.struct(digest(left, state["h"], right).alias("h"), (off + 64 * others).cast("int").alias("off"))

        return step

    state = F.struct(leaf.alias("h"), F.lit(0).cast("int").alias("off"))
    for place, n in ways:
        state = F.aggregate(_levels(n), state, climb(place, n))
    return state["h"]


def _tops(groups: DataFrame) -> DataFrame:
    """The groups' roots as leaves of one tree. Its number is a column of the table and no constant, so that joins on it are by key."""
    return groups.select(F.col("top").alias("tree"), F.col("groups").alias("n"), F.col("tree").alias("idx"), F.col("subroot").alias("hash"), F.col("n").alias("size"))


@dataclass
class Manifest:
    """A dataset's trie. leaves (tree, n, idx, hash, kept), runs as `reduced` has them; groups (tree, value, n, subroot, top, groups)."""

    leaves: DataFrame
    runs: list[DataFrame]
    groups: DataFrame
    top: list[DataFrame]
    n_groups: int
    root: str | None
    kept: tuple[str, ...]

    def nodes(self) -> DataFrame:
        """(tree, level, digits, hash) of all nodes above the leaves; digits: the number of the first leaf below, base 8, without its `level` last digits."""
        none = "tree long, level int, digits string, hash string"
        out = self.leaves.sparkSession.createDataFrame([], none)
        for level, runs in enumerate(self.runs, 1):
            hashes = F.array_join(F.transform("of", lambda x: x["hash"]), "")
            out = out.unionByName(runs.select("tree", F.lit(level).alias("level"), F.conv(F.col("run").cast("string"), 10, 1 << BITS).alias("digits"), digest(hashes).alias("hash")))
        return out

    def proofs(self) -> DataFrame:
        """(tree, n, idx, hash, kept, subroot, proof) of all leaves."""
        tops = _tops(self.groups)
        end = tops.select("tree", "n", F.lit("").alias("subroot"), F.lit("").alias("proof")).limit(1)
        ways = _proofs(tops, self.top, end, "size").select(F.col("idx").alias("tree"), F.col("size").alias("n"), F.col("hash").alias("subroot"), "proof")
        return _proofs(self.leaves, self.runs, ways, *self.kept)


def manifest(rows: DataFrame, group: str, key: str, leaf: Column, **kept: Column) -> Manifest:
    """The trie over rows: leaves `leaf`, by group and, within it, key (a whole number); kept: short columns that go with the leaves."""
    slim = rows.select(F.col(group).alias("value"), F.coalesce(F.col(key).cast("long"), F.lit(_SIGN)).alias("_id"), leaf.alias("hash"), F.monotonically_increasing_id().alias("_row"), *[c.alias(k) for k, c in kept.items()])
    slim = cut(slim, "leaves")
    named = cut(placed(slim.groupBy("value").agg(F.count("*").alias("n")), F.asc_nulls_first("value"), name="groups").withColumnRenamed("place", "tree"), "trees")
    n_groups, most, names = named.agg(F.count("*"), F.max("n"), F.sum(F.octet_length("value"))).first()
    known = F.broadcast(named) if n_groups <= GROUPS_TO_BROADCAST and (names or 0) <= NAMES_TO_BROADCAST else named
    tied = F.conv(F.substring("hash", 1, 15), 16, 10).cast("long")
    keyed = slim.alias("s").join(known.alias("g"), F.col("s.value").eqNullSafe(F.col("g.value"))).select("g.tree", "g.n", "_id", tied.alias("_leaf"), "_row", "hash", *kept)
    leaves = cut(group_ranks(keyed, "tree", ["_id", "_leaf", "_row"]).select("tree", "n", F.col("pos").alias("idx"), "hash", *kept), "ranked")
    runs, roots = reduced(leaves, most or 0, *kept)
    subroots = named.join(roots.select("tree", F.col("hash").alias("subroot")), "tree")
    groups = cut(subroots.withColumns({"top": F.lit(0).cast("long"), "groups": F.lit(n_groups).cast("long")}), "subroots")
    top, root = reduced(_tops(groups), n_groups, "size")
    root = root.first()  # one row
    return Manifest(leaves, runs, groups, top, n_groups, root and root["hash"], tuple(kept))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof; those whose id's CRC-32 is divisible by 3 are checked with their text's A-Z lower-cased."""
    docs = table(spark, sf_dir, "documents")
    leaf = lambda text: digest(*[encoded(text if c == "text" else F.col(c)) for c in FIELDS])
    low = lower_ascii(F.col("text"))
    altered = F.when((F.crc32(F.col("doc_id").cast("string")) % 3 == 0) & (low != F.col("text")), leaf(low))
    made = manifest(docs, "lang", "doc_id", leaf(F.col("text")), doc_id=F.col("doc_id"), altered=altered)
    root = F.lit(made.root)
    ways = [(F.col("idx"), F.col("n")), (F.col("tree"), F.lit(made.n_groups).cast("long"))]
    end = folded(F.coalesce("altered", "hash"), F.col("proof"), *ways)
    out = made.proofs().select("doc_id", F.col("hash").alias("leaf"), "subroot", root.alias("root"), F.sha2("proof", 256).alias("proof_sha256"), end.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


OP11_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY i) AS tab FROM range(256) r(i)),
enc AS (
  SELECT row_number() OVER () AS uid, doc_id, lang, text,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
         || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head,
         xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, i + 1, 1))::BIGINT)),
                         lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS crc
  FROM documents, crc_table),
lf AS (
  SELECT uid, doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN crc % 3 = 0 THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS altered
  FROM enc),
pos AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n FROM lf),
tree AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) OVER () AS ng FROM (SELECT DISTINCT lang FROM lf)),
places AS (SELECT pos.*, g, ng FROM pos JOIN tree ON pos.lang IS NOT DISTINCT FROM tree.lang),
nodes AS (
  SELECT 0 AS level, g, n, p, leaf AS h FROM places
  UNION ALL
  SELECT level + 1, g, any_value(n), p // 8, sha256(string_agg(h, '' ORDER BY p)) FROM nodes WHERE n > 8 ** level GROUP BY level, g, p // 8),
subs AS (SELECT g, arg_max(h, level) AS subroot FROM nodes GROUP BY g),
top AS (
  SELECT 0 AS level, ng AS n, g AS p, subroot AS h FROM subs JOIN (SELECT DISTINCT g, ng FROM places) USING (g)
  UNION ALL
  SELECT level + 1, any_value(n), p // 8, sha256(string_agg(h, '' ORDER BY p)) FROM top WHERE n > 8 ** level GROUP BY level, p // 8),
one AS (SELECT arg_max(h, level) AS root FROM top),
ways AS (
  SELECT a.uid, m.level AS step, string_agg(m.h, '' ORDER BY m.p) FILTER (m.p < a.p // (8 ** m.level)::BIGINT) AS lt, string_agg(m.h, '' ORDER BY m.p) FILTER (m.p > a.p // (8 ** m.level)::BIGINT) AS rt
  FROM places a JOIN nodes m ON m.g = a.g AND a.n > 8 ** m.level AND m.p // 8 = a.p // (8 ** (m.level + 1))::BIGINT GROUP BY ALL
  UNION ALL
  SELECT a.uid, 100 + m.level, string_agg(m.h, '' ORDER BY m.p) FILTER (m.p < a.g // (8 ** m.level)::BIGINT), string_agg(m.h, '' ORDER BY m.p) FILTER (m.p > a.g // (8 ** m.level)::BIGINT)
  FROM places a JOIN top m ON a.ng > 8 ** m.level AND m.p // 8 = a.g // (8 ** (m.level + 1))::BIGINT GROUP BY ALL),
proof AS (SELECT uid, string_agg(coalesce(lt, '') || coalesce(rt, ''), '' ORDER BY step) AS proof, list({'l': coalesce(lt, ''), 'r': coalesce(rt, '')} ORDER BY step) AS steps FROM ways GROUP BY uid),
climb AS (
  SELECT a.uid, 1 AS k, coalesce(altered, leaf) AS h, steps FROM places a LEFT JOIN proof ON a.uid = proof.uid
  UNION ALL
  SELECT uid, k + 1, sha256(steps[k].l || h || steps[k].r), steps FROM climb WHERE k <= len(steps)),
ends AS (SELECT uid, arg_max(h, k) AS folded_root FROM climb GROUP BY uid)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM places q JOIN subs USING (g) JOIN ends ON q.uid = ends.uid LEFT JOIN proof ON q.uid = proof.uid, one
"""
