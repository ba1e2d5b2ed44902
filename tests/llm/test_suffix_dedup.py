import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lexmill.llm import suffix_dedup as S


def brute(texts: list[bytes], span: int) -> list[tuple[int, int, bytes]]:
    """Bytes removed, runs, rest, of every text."""
    seen = Counter(t[i : i + span] for t in texts for i in range(len(t) - span + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - span + 1):
            if seen[t[i : i + span]] > 1:
                gone[i : i + span] = True
        runs = int(gone[:-1][0:1].sum() + (gone[1:-1] & ~gone[:-2]).sum()) if len(t) else 0
        out.append((int(gone.sum()), runs, bytes(b for b, g in zip(t, gone, strict=False) if not g)))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_and_prefixes(seed):
    rng = random.Random(seed)
    texts = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 12))]
    texts += rng.choices(texts, k=3) + [b"\0" * 20, b"a" * 33]
    data, ends = b"".join(texts), np.cumsum([len(t) for t in texts])
    end = np.repeat(ends, [len(t) for t in texts])
    order, rank = S.suffix_array(data, ends)
    suffixes = [data[i : end[i]] for i in order]
    assert suffixes == sorted(suffixes) and (rank[order] == np.arange(len(data))).all()
    span = 9
    want = Counter(t[i : i + span] for t in texts for i in range(len(t) - span + 1))
    got = S.repeated(texts, span)
    assert got.tolist() == [end[i] - i >= span and want[data[i : i + span]] > 1 for i in range(len(data))]


def test_bound_holds_where_many_texts_share_long_parts():
    rng = random.Random(2)
    base = bytes(rng.choice(b"abc ") for _ in range(420))
    for _ in range(30):
        texts = []
        for _ in range(12):
            t = bytearray(base[rng.randint(0, 60) : rng.randint(300, 420)])
            for _ in range(rng.randint(0, 2)):
                t[rng.randrange(len(t))] = 120
            texts.append(bytes(t))
        want = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
        assert S.repeated(texts).tolist() == [i + 200 <= len(t) and want[t[i : i + 200]] > 1 for t in texts for i in range(len(t))]


def corpus(seed: int = 3) -> list[str]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(n) for n in (20, 45, 60, 90)]
    out = ["", "x" * 150, "x" * 900, "ab" * 300, text(30)]
    for _ in range(40):
        out.append(text(rng.randint(0, 60)) + rng.choice(passages) + text(rng.randint(0, 60)))
    base = text(150)
    for _ in range(40):  # near copies
        words = base.split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = word()
        out.append(" ".join(words))
    return out + out[5:9] + [out[50] + out[50]]


@pytest.mark.parametrize("longest", [16_384, 3])
def test_against_brute_force(spark, longest):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, None, 0)], "doc_id long, text string, n long").repartition(5)
    got = {r.doc_id: r for r in S.remove_repeats(docs, longest=longest, shard_bytes=5000).collect()}
    assert len(got) == len(texts) + 1 and got.pop(None).n_bytes == 0
    for i, want in enumerate(brute([t.encode() for t in texts], 200)):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == (len(texts[i].encode()), *want), i


def test_long_texts_and_empty_table(spark, monkeypatch):
    texts = [t.encode() for t in corpus(5)] + [b"".join(t.encode() for t in corpus(6))]
    starts = np.cumsum([0] + [len(t) for t in texts])
    which, h, a, b = S.contexts(b"".join(texts), starts[:-1], starts[1:])
    covered = Counter(int(x) for i, j in zip(a, b, strict=True) for x in range(i, j + 1))
    want = {s + i for s, t in zip(starts, texts, strict=False) for i in range(len(t) - 199)}
    assert set(covered) == want and max(covered.values()) == 1
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.remove_repeats(empty).count() == 0


def test_keep_rest():
    assert S.keep_rest(b"abcdefgh", [(1, 3), (2, 4), (6, 8)]) == (b"aef", 5, 2)
    assert S.keep_rest(b"abcd", [(0, 2), (2, 4)]) == (b"", 4, 1)
    assert S.keep_rest(b"abc", []) == (b"abc", 0, 0)
    assert hashlib.sha256(S.keep_rest(b"", [])[0]).hexdigest() == hashlib.sha256(b"").hexdigest()
