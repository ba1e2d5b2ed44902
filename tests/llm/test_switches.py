"""Nothing changes at a bound: texts on both sides of it are treated alike."""

import math

import numpy as np
import pytest

from lexmill.llm import language_id as L
from lexmill.llm import quality as Q


def distinct(text):
    return next(int(f[9:]) for f in Q.features(text) if f.startswith(b"#distinct"))


@pytest.mark.parametrize("n", [10, 998, 999, 1000, 1001, 5000])
def test_distinct_words_at_any_length(n):
    some, every = "a b c " * (n // 3), " ".join("w" + "".join(chr(97 + int(d)) for d in str(i)) for i in range(n))
    assert distinct(every) == int(20 * math.log(n + 1) / math.log(n + 2)) >= 18
    assert distinct(some) == int(20 * math.log(4) / math.log(3 * (n // 3) + 2))
    assert abs(distinct(every) - distinct(every + " more")) <= 1


def test_runs_of_marks_are_whole():
    assert b"#!!!!" in Q.features("no !!!!") and b"#!!!!!!" in Q.features("no !!!!!!") and b"#!!!!" not in Q.features("no !!!!!!")


@pytest.fixture(scope="module")
def model():
    texts = ["der hund und die katze sind nicht hier " * 5, "the dog and the cat are not in here " * 5, "日本語の文字はここにある" * 10, "Это длинное слово" * 10]
    return L.BiGru(["de", "en", "ja", "ru"]).fit(texts, ["de", "en", "ja", "ru"], steps=150, batch=64)


@pytest.mark.parametrize("n", [1, L.LONGEST - 1, L.LONGEST, L.LONGEST + 1, 2 * L.LONGEST, 700])
def test_long_words_are_read_as_a_whole(model, monkeypatch, n):
    word = ("ab日本語ж" * 100).encode().translate(L._PLAIN)[:n]
    pieces = _readings(word)
    got = model.pooled(pieces).sum(0)
    monkeypatch.setattr(L, "LONGEST", 1000)
    want = model.pooled([word])[0]
    assert got[-1] == want[-1] == n + 1
    np.testing.assert_allclose(got, want, rtol=0.02, atol=0.02 * n)


def _readings(word):
    """readings() of bytes that need not be whole characters."""

    class Text(str):
        def encode(self):
            return word

    return L.readings(Text("x"))


def test_texts_without_spaces(model):
    """A text of one script without spaces, cut nowhere by chance, is of its language with and without an odd byte before it."""
    reader = L.Reader(model)
    text = "日本語の文字はここにある" * 300
    found = reader.predict([text, "é" + text, "a" + text, text[:15], text[:17]])
    assert {x for x, _ in found} == {"ja"} and max(s for _, s in found[:3]) - min(s for _, s in found[:3]) < 0.01
