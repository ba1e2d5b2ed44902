"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

The network reads the bytes of a text: A-Z lower-cased, every run of ASCII that isn't letters read
as one space. Its state starts anew at each space, so a word always gets the same labels and is computed
once per worker. It gives every position (each byte of a word and the space after it) a probability for
each language. A document pools its positions: the language with the largest mean log probability is
predicted, and `score` is the mean probability that the positions gave it.

Training is backpropagation through time with Adam, on the driver, over a bounded sample: at most
about `docs_per_language` documents of each language of at most `max_bytes` bytes, chosen by a hash of their id,
never one whose crc32(doc_id) is 0 modulo `folds`. Only text and lang are learned from. The sample
and the seed are fixed, so reruns agree.

Defined results. A text that is null or has no letter is `und` with score 0, as is every text if
nothing was learned. Words of over `LONGEST` bytes, such as whole texts of scripts without spaces, are labelled in pieces of that length, each read with as
many bytes before and after it, so that no state begins at a piece's edge, or within a character; the sample's are learned without. Null ids are
never used for training. Rows are independent; repeated rows repeat; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import table

LONGEST = 48
#: Words whose labels a worker keeps; the first to come, mostly the frequent.
REMEMBER = 400_000
SPACE, BATCH = 32, 1024
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else SPACE for b in range(256))
#: Letters, and numerals that are none.
_LETTERS = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTERS.finditer(text))


def words_of(text: str) -> list[bytes]:
    words = text.encode().translate(_PLAIN).split()
    if max(map(len, words), default=0) > LONGEST:
        words = [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
    return words


def readings(text: str) -> list[bytes | tuple[bytes, int, int]]:
    """The words of a text; instead of one of over LONGEST bytes its pieces, with what is around them, and which of the positions are theirs."""
    words = text.encode().translate(_PLAIN).split()
    if max(map(len, words), default=0) <= LONGEST:
        return words
    out: list[bytes | tuple[bytes, int, int]] = []
    for w in words:
        if len(w) <= LONGEST:
            out.append(w)
            continue
        for i in range(0, len(w), LONGEST):
            a, end = max(0, i - LONGEST), min(len(w), i + LONGEST)
            # the last piece has the space after the word, too
            out.append((w[a : end + LONGEST], i - a, end - a + (end == len(w))))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.reciprocal(1 + np.exp(-x))


class BiGru:
    """Bytes to language probabilities at every position. Gates come in the order z, r, n."""

    def __init__(self, languages: list[str], hidden: int = 16, seed: int = 0):
        rng, c, h = np.random.default_rng(seed), len(languages), hidden
        self.languages, self.h = languages, h
        init = lambda *s: (rng.standard_normal(s) / np.sqrt(h)).astype(np.float32)
        self.p = {f"{k}{d}": v for d in "fb" for k, v in (("x", 0.3 * init(256, 3 * h)), ("u", init(h, 3 * h)))}
        self.p |= {"o": init(2 * h, c), "c": np.zeros(c, np.float32)}

    def _run(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """States after each of the steps x (steps, batch), and what the way back needs."""
        h, u, w = self.h, self.p[f"u{d}"], self.p[f"x{d}"]
        state, states, kept = np.zeros((x.shape[1], h), np.float32), [], []
        for row in x:
            a, hu = w[row], state @ u
            zr = _sigmoid(a[:, : 2 * h] + hu[:, : 2 * h])
            z, r, hn = zr[:, :h], zr[:, h:], hu[:, 2 * h :]
            n = np.tanh(a[:, 2 * h :] + r * hn)
            kept.append((row, state, z, r, n, hn))
            state = n + z * (state - n)
            states.append(state)
        return np.stack(states), kept

    def log_probabilities(self, words: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Of words (batch, bytes), all of one length, each with its space: (steps, batch, languages)."""
        x = np.concatenate([words.T, np.full((1, len(words)), SPACE, np.uint8)])
        ahead, kf = self._run(x, "f")
        back, kb = self._run(x[::-1], "b")
        both = np.concatenate([ahead, back[::-1]], 2)
        y = both @ self.p["o"] + self.p["c"]
        y -= y.max(2, keepdims=True)
        y -= np.log(np.exp(y).sum(2, keepdims=True))
        return y, (both, kf, kb)

    def _back(self, grad: np.ndarray, kept: list, d: str, out: dict) -> None:
        h, u = self.h, self.p[f"u{d}"]
        gx, gu, later = np.zeros_like(self.p[f"x{d}"]), np.zeros_like(u), np.zeros_like(kept[0][1])
        for g, (row, state, z, r, n, hn) in zip(grad[::-1], reversed(kept), strict=True):
            g = g + later
            gn = g * (1 - z) * (1 - n * n)
            gz = g * (state - n) * z * (1 - z)
            gr = gn * hn * r * (1 - r)
            ga = np.concatenate([gz, gr, gn], 1)
            gh = np.concatenate([gz, gr, gn * r], 1)
            np.add.at(gx, row, ga)
            gu += state.T @ gh
            later = g * z + gh @ u.T
        out[f"x{d}"], out[f"u{d}"] = gx, gu

    def gradients(self, words: np.ndarray, label: np.ndarray) -> tuple[float, dict]:
        y, (both, kf, kb) = self.log_probabilities(words)
        steps, batch, _ = y.shape
        loss = -y[:, np.arange(batch), label].mean()
        g = np.exp(y)
        g[:, np.arange(batch), label] -= 1
        g /= steps * batch
        out = {"o": np.einsum("tbh,tbc->hc", both, g), "c": g.sum((0, 1))}
        gh = g @ self.p["o"].T
        self._back(gh[:, :, : self.h], kf, "f", out)
        self._back(gh[::-1, :, self.h :], kb, "b", out)
        return float(loss), out

    def fit(self, texts: list[str], labels: list[str], steps: int = 600, batch: int = 256, rate: float = 0.02, seed: int = 1) -> BiGru:
        """Adam over batches of words of one length; languages weigh the same, words by how often they occur."""
        rng, index = np.random.default_rng(seed), {x: i for i, x in enumerate(self.languages)}
        counts: dict[tuple[bytes, int], float] = Counter()
        for text, label in zip(texts, labels, strict=True):
            counts.update((w, index[label]) for w in words_of(text))
        if not counts:
            return self
        items = sorted(counts)
        weight = np.array([counts[k] for k in items], np.float64)
        label = np.array([k[1] for k in items])
        weight /= np.bincount(label, weight, len(self.languages))[label]
        length = np.array([len(k[0]) for k in items])
        groups = {n: np.flatnonzero(length == n) for n in np.unique(length)}
        rows = {n: np.frombuffer(b"".join(items[i][0] for i in at), np.uint8).reshape(-1, n) for n, at in groups.items()}
        share = np.array([weight[at].sum() * (n + 1) for n, at in groups.items()])
        sums = {n: np.cumsum(weight[at]) for n, at in groups.items()}
        one = {k: np.zeros_like(v) for k, v in self.p.items()}
        two = {k: np.zeros_like(v) for k, v in self.p.items()}
        for t in range(1, steps + 1):
            n = rng.choice(list(groups), p=share / share.sum())
            at = np.minimum(np.searchsorted(sums[n], rng.random(batch) * sums[n][-1]), len(sums[n]) - 1)
            _, grad = self.gradients(rows[n][at], label[groups[n][at]])
            now = rate * (1 - 0.9 * t / steps)
            for k, g in grad.items():
                one[k] += 0.1 * (g - one[k])
                two[k] += 0.01 * (g * g - two[k])
                self.p[k] = (self.p[k] - now * (one[k] / (1 - 0.9**t)) / (np.sqrt(two[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        return self

    def _states(self, x: np.ndarray, d: str) -> np.ndarray:
        """What _run returns first, keeping nothing for the way back."""
        h, u, w = self.h, self.p[f"u{d}"], self.p[f"x{d}"]
        out = np.zeros((len(x) + 1, x.shape[1], h), np.float32)
        for t, row in enumerate(x):
            a, hu = w[row], out[t] @ u
            zr = a[:, : 2 * h] + hu[:, : 2 * h]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            n = hu[:, 2 * h :] * zr[:, h:]
            n += a[:, 2 * h :]
            np.tanh(n, out=n)
            np.subtract(out[t], n, out=out[t + 1])
            out[t + 1] *= zr[:, :h]
            out[t + 1] += n
        return out[1:]

    def pooled(self, read: list[bytes | tuple[bytes, int, int]]) -> np.ndarray:
        """Per word or piece: sums over its positions of log probabilities, then of probabilities, then their number."""
        c = len(self.languages)
        words = [w if isinstance(w, bytes) else w[0] for w in read]
        begin = np.array([0 if isinstance(w, bytes) else w[1] for w in read], np.int64)
        end = np.array([len(w) + 1 if isinstance(w, bytes) else w[2] for w in read], np.int64)
        out = np.zeros((len(words), 2 * c + 1), np.float32)
        length = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(length, kind="stable")
        first = np.searchsorted(length[order], np.arange(3 * LONGEST + 2))
        for n in np.unique(length):
            at = order[first[n] : first[n + 1]]
            for i in range(0, len(at), BATCH):
                part = at[i : i + BATCH]
                bytes_of = np.frombuffer(b"".join([words[j] for j in part]), np.uint8).reshape(-1, n).T
                x = np.concatenate([bytes_of, np.full((1, len(part)), SPACE, np.uint8)])
                y = self._states(x, "f") @ self.p["o"][: self.h]
                y += (self._states(x[::-1], "b") @ self.p["o"][self.h :])[::-1]
                y += self.p["c"]
                p = np.exp(y)
                total = p.sum(2, keepdims=True)
                y -= np.log(total)
                p /= total
                if n > LONGEST:  # pieces
                    at_step = np.arange(n + 1)[:, None]
                    mine = ((at_step >= begin[part]) & (at_step < end[part]))[:, :, None]
                    y, p = y * mine, p * mine
                out[part, :c], out[part, c:-1], out[part, -1] = y.sum(0), p.sum(0), end[part] - begin[part]
        return out


class Reader:
    """Predictions of one worker; remembers words."""

    def __init__(self, model: BiGru):
        self.model, self.place = model, {}
        self.sums = np.zeros((0, 2 * len(model.languages) + 1), np.float32)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        docs = [readings(t) if t and has_letter(t) else [] for t in texts]
        new = [w for w in dict.fromkeys(w for d in docs for w in d) if w not in self.place]
        sums = self.model.pooled(new)
        place = {w: len(self.sums) + i for i, w in enumerate(new)}
        every = np.concatenate([self.sums, sums])
        out = []
        for words in docs:
            if not words or not self.model.languages:
                out.append(("und", 0.0))
                continue
            at = np.array([place[w] if w in place else self.place[w] for w in words])
            total = every[at].sum(0, dtype=np.float64)
            c = len(self.model.languages)
            best = int(np.argmax(total[:c]))
            out.append((self.model.languages[best], float(min(1.0, max(0.0, total[c + best] / total[-1])))))
        if len(self.place) < REMEMBER:
            self.place |= place
            self.sums = every
        return out


def training_sample(docs: DataFrame, docs_per_language: int = 300, max_bytes: int = 20_000, folds: int = 5) -> list:
    """(lang, text) rows, a bounded sample by hash of the id; docs has doc_id, text and lang."""
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    usable = docs.where((fold != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes))
    counts = usable.groupBy("lang").count().orderBy("lang").collect()
    if not counts:
        return []
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language-id")), F.lit(1 << 30))
    chosen = F.lit(False)
    for r in counts:
        chosen |= (F.col("lang") == r["lang"]) & (draw < int((1 << 30) * min(1.0, docs_per_language / r["count"])))
    # ids that recur may bring more rows: then those of the least hash of id and text are taken
    least = F.xxhash64("doc_id", "text", F.lit("language-id"))
    found = usable.where(chosen).select("lang", "text", "doc_id").orderBy(least, "doc_id", "text", "lang").limit(2 * docs_per_language * len(counts)).collect()
    return sorted(found, key=lambda r: (r["doc_id"], r["text"], r["lang"]))


def train(docs: DataFrame, hidden: int = 16, steps: int = 600, **sample) -> BiGru:
    rows = training_sample(docs, **sample)
    model = BiGru(sorted({r["lang"] for r in rows}), hidden)
    return model.fit([r["text"] for r in rows], [r["lang"] for r in rows], steps) if model.languages else model


def _predict(model: BiGru):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                found = reader.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return predict


def identify(docs: DataFrame, model: BiGru) -> DataFrame:
    """doc_id, lang_pred and score of docs (doc_id, text)."""
    schema = docs.select("doc_id").schema.add("lang_pred", "string").add("score", "double")
    return docs.select("doc_id", "text").mapInArrow(_predict(model), schema)


def _known(model: BiGru, text: int, least: float):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                found = reader.predict(part.column(text).to_pylist())
                yield part.filter(pa.array([x != "und" and s >= least for x, s in found], pa.bool_()))

    return keep


def of_known_language(docs: DataFrame, model: BiGru, above_chance: float = 1.2) -> DataFrame:
    """The documents that have a language: predicted, with a score of `above_chance` times that of a guess, 0.3 at most."""
    least = min(0.3, above_chance / max(1, len(model.languages)))
    return docs.mapInArrow(_known(model, docs.columns.index("text"), least), docs.schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return identify(docs, train(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
