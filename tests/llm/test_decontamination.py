import hashlib
import random
import re

import pytest

from lexmill.llm import decontamination as D


def low(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    windows: dict[tuple, set] = {}
    for name, text in items:
        w = low(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(name)
    lengths = {len(k) for k in windows}
    out = []
    for name, text in docs:
        w, hit, found = low(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if names := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= names
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((name, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize(("seed", "short", "bound"), [(1, False, 200_000), (2, True, 200_000), (3, False, -1), (4, True, -1)])
def test_against_all_windows(spark, monkeypatch, seed, short, bound):
    monkeypatch.setattr(D, "PRINTS_TO_BROADCAST", bound)
    monkeypatch.setattr(D, "HITS_TO_BROADCAST", bound)
    rng = random.Random(seed)
    vocabulary = ["the", "of", "a1", "ünï", "Straße", "x", "ÉÀ", "q7", "ΑΣ", "n"]
    text = lambda n: " ".join(rng.choice(vocabulary[: rng.choice([2, 4, 9])]) for _ in range(n))
    items = [(i, text(rng.randint(1 if short else 13, 40))) for i in range(12)] + [(90, None), (91, " ,, ")] + [(92, text(20))] * 2
    docs = [(i, text(rng.randint(0, 60))) for i in range(40)]
    for i in range(30):
        words = rng.choice(items[:12])[1].split()
        a = rng.randint(0, max(0, len(words) - 13))
        docs.append((100 + i, f"{text(rng.randint(0, 20))} {', '.join(words[a : a + rng.choice([12, 13, 14, 30])])} {text(rng.randint(0, 9))}".swapcase() if i % 2 else " ".join(words)))
    docs += [(200, None), (201, ""), docs[45]]
    got = D.decontaminate(spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, n_words int"), spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, words int"))
    rows = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()]
    assert sorted(rows) == sorted(plain(docs, items))


def test_long_items_and_documents(spark):
    """One item of 200,000 words, one document of 1,000,000 that holds parts of it."""
    word = lambda i: f"w{i * 2654435761 % 2**32:x}"
    item = [word(i) for i in range(200_000)]
    other = [word(10**7 + i) for i in range(1_000_000)]
    other[5000:5013], other[900_000:900_300], other[70:82] = item[1000:1013], item[150_000:150_300], item[7:19]
    docs = spark.createDataFrame([(1, " ".join(other)), (2, "a b c")], "doc_id long, text string")
    got = {r.doc_id: r for r in D.decontaminate(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].n_items, got[1].contaminated, got[1].passage) == (1_000_000, 313, 1, False, True)
    assert (got[2].n_hit, got[2].passage) == (0, False)
    assert [r.doc_id for r in D.clean_of(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()] == [2]


def test_a_passage_in_a_long_document_goes_and_a_short_item_in_it_stays(spark):
    text = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    items = spark.createDataFrame([(1, text("p", 30)), (2, "yes it is")], "item_id long, text string")
    rows = [(1, f"{text('x', 500)} {' '.join(text('p', 30).split()[4:17])} {text('y', 500)}"), (2, f"{text('x', 500)} yes it is {text('y', 500)}"), (3, f"{text('x', 500)} {' '.join(text('p', 30).split()[4:16])} {text('y', 500)}"), (4, "Yes, it IS")]
    assert sorted(r.doc_id for r in D.clean_of(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()) == [2, 3]


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join("abcdefghijklmnop"))], "item_id long, text string")
    assert D.decontaminate(docs.limit(0), items).count() == 0
    assert [r.n_hit for r in D.decontaminate(docs, items.limit(0)).collect()] == [0]
    assert D.clean_of(docs, items).count() == 1


def test_clean_documents_keep_their_columns(spark):
    item = " ".join("abcdefghijklmnop")
    docs = spark.createDataFrame([(1, "all is well here", 5, "r"), (2, item, 6, "s"), (3, None, 7, None)], "doc_id long, text string, row_key long, item string")
    got = D.clean_of(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=str) == [(1, "all is well here", 5, "r"), (3, None, 7, None)]
