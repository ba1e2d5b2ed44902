"""Language ID, quality classifier and token output."""

import random
import zlib

import numpy as np
import pytest

from lexmill.llm import language_id as L
from lexmill.llm import quality as Q
from lexmill.llm import token_output as T


def test_gradients_are_those_of_the_loss():
    m = L.BiGru(["a", "b", "c"], 5)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    words = np.random.default_rng(0).integers(97, 110, (4, 3)).astype(np.uint8)
    label = np.array([0, 1, 2, 1])
    _, g = m.gradients(words, label)
    for k in m.p:
        i = np.unravel_index(np.argmax(abs(g[k])), g[k].shape)
        e = 1e-4
        m.p[k][i] += e
        up = m.gradients(words, label)[0]
        m.p[k][i] -= 2 * e
        down = m.gradients(words, label)[0]
        m.p[k][i] += e
        assert g[k][i] == pytest.approx((up - down) / 2 / e, rel=1e-2, abs=1e-6)


def _languages(n: int):
    rng = random.Random(2)
    letters = {"aa": "badokelumi", "bb": "thwxsrngqv", "cc": "éàüçômñiöß"}
    for i in range(n):
        k = rng.choice(list(letters))
        yield i, " ".join("".join(rng.choice(letters[k]) for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(3, 60))), k


def test_language_id(spark):
    rows = list(_languages(300)) + [(300, None, "aa"), (301, "", "bb"), (302, "12 !! 3", "cc"), (303, "bado" * 40_000, None), (None, "kelu", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.train(docs, steps=200)
    got = {r.doc_id: r for r in L.identify(docs.drop("lang"), model).collect()}
    held = [(i, k) for i, _, k in rows[:300] if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].lang_pred == k for i, k in held]) > 0.95
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (300, 301, 302)) and got[303].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values())
    again = {r.doc_id: r.score for r in L.identify(docs, L.train(docs, steps=200)).collect()}
    assert all(again[i] == r.score for i, r in got.items())
    kept = L.of_known_language(docs, model)
    assert kept.dtypes == docs.dtypes and not {300, 301, 302} & {r.doc_id for r in kept.collect()}
    nothing = L.train(docs.limit(0))
    assert {r.lang_pred for r in L.identify(docs, nothing).collect()} == {"und"} and L.identify(docs.limit(0), model).count() == 0


def test_words_of_every_byte():
    text = "".join(map(chr, range(1, 700))) + "x" * 200
    words = L.words_of(text)
    assert max(map(len, words)) <= L.LONGEST and b"".join(words) == text.encode().translate(L._PLAIN).replace(b" ", b"")


def test_quality(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    docs, labels = [], []
    for i in range(600):
        grade = rng.choice([0, 1, 2, 2])
        words = [word() for _ in range(rng.randint(5, 60))]
        if grade == 0:
            words[rng.randrange(len(words))] = rng.choice(["vile", "viler", "vilest"])
        if grade == 1:
            words = [w + rng.choice(["***", "###"]) for w in words]
        docs.append((i, " ".join(words)))
        if i % 5:
            labels.append((i, int(grade == 2), int(grade == 0)))
        else:
            labels.append((i, None, None))
    docs += [(1000, None), (1001, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = Q.train(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert model.thresholds[0] < model.thresholds[1]
    got = {r.doc_id: r for r in Q.grade(d, model).collect()}
    assert len(got) == 602 and all(r.p_not_toxic >= r.p_good and r.expected_grade == pytest.approx(r.p_not_toxic + r.p_good) for r in got.values())
    test = [(i, t) for i, t in docs[:600] if i % 5 == 0]
    assert np.mean([(got[i].p_not_toxic < 0.5) == ("vile" in t) for i, t in test]) > 0.9
    assert np.mean([(got[i].p_good < 0.5) == ("vile" in t or "*" in t or "#" in t) for i, t in test]) > 0.9
    none = Q.train(d, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert [round(r.expected_grade, 6) for r in Q.grade(d.limit(1), none).collect()] == [1.0]


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 31, 32])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 10_001, dtype=np.uint64).astype(np.uint32)
    assert (T.unpack(T.pack(ids, bits), len(ids), bits) == ids).all() and len(T.pack(ids, bits)) == -(-len(ids) * bits // 8)
    parts = [ids[:1], ids[1:1], ids[1:5000], ids[5000:]]
    shard = T.Shard(T.encode_shard([4, None, 5, 5], [x.astype("<u4").tobytes() for x in parts], bits, 512))
    assert [shard.document(i).tolist() for i in range(4)] == [x.tolist() for x in parts]
    assert shard.known.tolist() == [True, False, True, True] and shard.read(511, 1030).tolist() == ids[511:1030].tolist()


def test_pieces_are_tokenised_as_wholes():
    from tokenizers import Tokenizer

    inner, mine = Tokenizer.from_file(T.tokenizer_path()), T.PieceTokenizer(T.tokenizer_path())
    rng = random.Random(1)
    signs = "aBcé ß  \n\t.,'!*#12İΣσς\x1c ́ﬁ日本<|>Ⅷ²_-–"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["it's <|endoftext|>, <|ENDOFTEXT|> x<|startoftext|>.", "don't I'LL we've 'S", "naïve... (word), word) word.,", "", " ", "Word word WORD, word. word***"]
    for t in texts:
        assert np.frombuffer(mine.ids(t), "<u4").tolist() == inner.encode(t, add_special_tokens=False).ids, t


def test_token_files(spark, tmp_path):
    rows = [(5, "hello world", 0), (2, None, 0), (9, "", 0), (5, "other", 0), (None, "none", 0), (7, "long " * 30_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    manifest = T.write_tokens(docs, str(tmp_path / "tokens"), T.tokenizer_path(), shard_bytes=1000)
    got = sorted(T.read_tokens(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 2, 5, 5, 7, 9]
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    from tokenizers import Tokenizer

    inner = Tokenizer.from_file(T.tokenizer_path())
    crc = lambda t: zlib.crc32(np.array(inner.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes())
    assert sorted(r.ids_crc32 for r in got) == sorted(crc(t) for _, t, _ in rows)
    assert T.token_output(docs.limit(0), str(tmp_path / "empty")).count() == 0
