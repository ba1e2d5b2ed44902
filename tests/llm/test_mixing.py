import random
from collections import defaultdict

import pytest

from lexmill.llm import mixing as M


def fill(size: dict, weight: dict, total: float, epochs: int = 2) -> dict:
    """Clamp and reshare until none is over its cap."""
    free, target = set(size), {}
    while free:
        share = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if share * weight[s] > epochs * size[s]}
        if not over:
            return target | {s: share * weight[s] for s in free}
        target |= {s: float(epochs * size[s]) for s in over}
        free -= over
    return target


@pytest.mark.parametrize("seed", range(4))
def test_mix(spark, seed):
    rng = random.Random(seed)
    names = [None, "", "a", "b", "é", "Z", "😀"][: rng.randint(1, 7)]
    rows = [(i, " ".join("w" * rng.randint(1, 4) for _ in range(rng.choice([0, 1, 5, 40, 200]))), rng.choices(names, [9, *[1] * (len(names) - 1)])[0], "x") for i in range(150)]
    rows += [(1000, None, names[0], "y"), rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = M.mix_sources(docs, rows=True).collect()
    again = M.mix_sources(docs.repartition(5)).collect()
    key = lambda r: str((r.doc_id, r.size, r.taken))
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    source_of = {r[0]: r[2] for r in rows}
    size, taken = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.size == len((r.row.text or "").split()) and 0 <= r.taken <= 2 * r.size
        size[source_of[r.doc_id]] += r.size
        taken[source_of[r.doc_id]] += r.taken
    order = sorted(size, key=lambda s: (s is None, s))
    want = fill(size, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(size.values()))
    for r in got:
        s = source_of[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(want[s])
    for s in size:
        assert abs(taken[s] - want[s]) <= 0.5 + 1e-6
    mixed = M.repeated(docs).collect()
    assert sum(len((r.text or "").split()) for r in mixed) == sum(taken.values())


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mix_sources(docs).count() == 0 and M.repeated(docs).count() == 0
    nothing = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert {(r.doc_id, r.size, r.target, r.taken) for r in M.mix_sources(nothing).collect()} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}
