import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lexmill.operators import similarity as S
from lexmill.schemas import Settings

WORDS = "category string, book string, word string, cnt long"


def lev(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def alike(a: str, b: str) -> bool:
    return abs(len(a) - len(b)) <= 1 and (d := lev(a, b)) <= 2 and d <= 0.25 * max(len(a), len(b))


def plain(words: dict[str, int]) -> dict[str, str]:
    """Target of every word of one book."""
    order = sorted(words, key=lambda w: (-words[w], w))
    head = {w: w for w in order}
    for w in order:
        if head[w] != w:
            continue
        todo = [w]
        while todo:
            a = todo.pop()
            for b in order:
                if b != w and head[b] == b and len(a) >= 5 and len(b) >= 5 and a[:4] == b[:4] and alike(a, b):
                    head[b] = w
                    todo.append(b)
    return {w: head[w] if alike(w, head[w]) else w for w in order}


def test_cases(spark):
    rows = [("running", 9), ("runnings", 4), ("house", 5), ("houze", 3), ("table", 5), ("tabla", 2), ("abcdxxxx", 9), ("abcdxxyy", 5), ("abcdyyyy", 2), ("abcd", 3), ("abce", 2)]
    words = spark.createDataFrame([("c", "b", w, n) for w, n in rows], WORDS)
    targets = S.merge_targets(words).cache()
    kept = {r.word: r.cnt for r in S.clustered(targets).collect()}
    assert kept == {"running": 13, "house": 5, "houze": 3, "table": 7, "abcdxxxx": 14, "abcdyyyy": 2, "abcd": 3, "abce": 2}
    assert {(r.deleted_word, r.cnt, r.merged_to) for r in S.deleted(targets).collect()} == {("runnings", 4, "running"), ("tabla", 2, "table"), ("abcdxxyy", 5, "abcdxxxx")}


def test_against_plain_python(spark):
    rng = random.Random(4)
    books = defaultdict(dict)
    for book in (None, "b1", "b2"):
        for _ in range(250):
            w = rng.choice(["abcd", "abce", "xyéz"]) + "".join(rng.choice("abé") for _ in range(rng.randint(0, 6)))
            books[book][w] = rng.randint(1, 6)
    rows = [("c", b, w, n) for b in books for w, n in books[b].items()]
    words = spark.createDataFrame(rows, WORDS)
    for parts in (1, 7):
        got = {(r.book, r.word): r.target for r in S.merge_targets(words.repartition(parts)).collect()}
        assert got == {(b, w): t for b in books for w, t in plain(books[b]).items()}
    targets = S.merge_targets(words)
    assert S.clustered(targets).agg(F.sum("cnt")).first()[0] == sum(r[3] for r in rows)


def test_empty(spark):
    assert S.merge_targets(spark.createDataFrame([], WORDS)).count() == 0


def close_words(rng, letters, n, longest=9):
    stem = lambda: rng.choice(["abcd", "xyéz"]) + "".join(rng.choice(letters) for _ in range(rng.randint(0, longest)))
    out = {stem() for _ in range(n)}
    for w in list(out):  # and words up to two edits away
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(4, len(w))
            w = rng.choice([w[:at] + rng.choice(letters) + w[at:], w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at + 1 :]])
        out.add(w)
    return sorted(out)


@pytest.mark.parametrize("how", [{}, {"edits": 1}, {"edits": 3, "edit_share": 0.5, "length_gap": 2}, {"length_gap": 0}, {"edit_share": 1.0}])
def test_pairs_against_all_pairs(spark, how):
    rng = random.Random(str(how))
    settings = Settings(**how)
    names = close_words(rng, "abé", 80) + close_words(rng, "abcdefghijk", 80)
    counts = {w: rng.randint(1, 3) for w in names}
    rows = [("c", b, w, n) for b in (None, "x") for w, n in counts.items()] + [(None, "x", w, 1) for w in names[:20]]
    words = spark.createDataFrame(rows, WORDS)
    got, blocks = (S.similar_pairs(words, settings, block).collect() for block in (0, 60))

    def near(a, b):
        return a[:4] == b[:4] and min(len(a), len(b)) >= 5 and abs(len(a) - len(b)) <= settings.length_gap and (d := lev(a, b)) <= settings.edits and d <= settings.edit_share * max(len(a), len(b))

    want = [(c, b, w[:4], w, n, v, m) for c, b, w, n in rows for d, e, v, m in rows if (c, b) == (d, e) and (-n, w) < (-m, v) and near(w, v)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) == sorted(map(tuple, blocks), key=repr)


def test_few_pairs_meet(spark):
    """Words of one beginning are not compared all with all."""
    rng = random.Random(1)
    names = sorted({"abcd" + "".join(rng.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(1500)})
    words = spark.createDataFrame([("c", "b", w, 1) for w in names], WORDS)
    met = S.met_pairs(words)
    assert met.count() < len(names) ** 2 / 2 / 50
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("most", [0, 5, 10**9])
def test_groups_are_the_same_for_any_bound(spark, most):
    rng = random.Random(9)
    counts = {w: rng.randint(1, 4) for w in close_words(rng, "ab", 60)}
    pairs = S.similar_pairs(spark.createDataFrame([("c", b, w, n) for b in (None, "b") for w, n in counts.items()], WORDS))
    got = sorted(map(tuple, S.components(pairs, most).collect()), key=repr)
    assert got == sorted(map(tuple, S.components(pairs).collect()), key=repr) and len(got) > 50
