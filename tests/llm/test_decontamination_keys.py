"""Items whose item_id is null or repeated, with fingerprints broadcast and shuffled."""

import pytest

from lexmill.llm import decontamination as D


@pytest.mark.parametrize("bound", [200_000, -1])
def test_null_and_repeated_item_ids(spark, monkeypatch, bound):
    monkeypatch.setattr(D, "PRINTS_TO_BROADCAST", bound)
    monkeypatch.setattr(D, "HITS_TO_BROADCAST", bound)
    passage = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    items = [(None, passage("p", 20)), (None, passage("q", 15)), (7, passage("r", 18)), (7, passage("s", 16))]
    docs = [(1, passage("p", 20)), (2, "so " + passage("q", 14)), (3, passage("r", 13) + " and " + passage("s", 16)), (4, passage("t", 30))]
    got = D.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.n_hit, r.n_items, r.contaminated) for r in got.collect()) == [(1, 20, 1, True), (2, 14, 1, True), (3, 29, 1, True), (4, 0, 0, False)]
