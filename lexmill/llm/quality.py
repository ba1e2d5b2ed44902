"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades, from the labels: 0 toxic, 1 of low quality, 2 good. One vector of weights on hashed text
features gives a document a score w.x, shared by all grades; ordered thresholds cut it:
P(grade <= k) = sigmoid(t_k - w.x). Hence an expected grade and a tail probability for each threshold,
by which documents are selected.

Features are counted over the different words of a text and hashed to 2**24 places: words in lower
case and their beginnings, runs of marks, and the levels of capitals, of marks, of distinct words and of
length. A feature takes part if `least` rated documents have it. Weights are fitted with Adam and a soft threshold, which leaves words that say nothing at zero.

The fit uses a bounded sample: about `rated` labelled documents of at most `max_bytes` bytes, chosen by a hash of
their id, each grade weighing the same per document. Fit and sample are seeded, so reruns agree.

Defined results. A null text is empty; it has the features of its length only. Documents with several labels
count once for each; labels with a null grade or without a document are not used. Without labels every probability
is that of equal grades. Rows are independent, other columns are not read, empty tables give no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import table

PLACES = 1 << 24
GRADES = 3
#: Documents are selected from this probability of not being toxic on.
KEEP = 0.7
#: Bytes.
BEGINNINGS = (3, 4, 5, 6, 7)
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MARK = bytes(32 if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 or 48 <= b <= 57 or b < 33 else b for b in range(256))

def features(text: str | None) -> set[bytes]:
    data = (text or "").encode()
    words, marks = data.translate(_WORD).split(), data.translate(_MARK).split()
    out = set(words)
    kinds = len(out)
    capitals = sum(data.count(bytes([b])) for b in range(65, 91))
    out.update(b"#" + m for m in set(marks))
    out.add(b"#length%d" % min(12, int(math.log2(len(words) + 1))))
    # how the number of different words grows with that of all, the same for texts of any length
    out.add(b"#distinct%d" % int(20 * math.log(kinds + 1) / math.log(len(words) + 2)))
    out.add(b"#capitals%d" % (10 * capitals // (len(data) + 1)))
    out.add(b"#marks%d" % min(10, 10 * len(marks) // (len(words) + 1)))
    return out


def places_of(feature: bytes) -> list[int]:
    """Where a feature counts: itself and, of a word, its beginnings."""
    parts = [feature] if feature[:1] == b"#" else [feature, *(b"^" + feature[:k] for k in BEGINNINGS if len(feature) > k)]
    return [zlib.crc32(x) & (PLACES - 1) for x in parts]


def loss_and_gradient(p: np.ndarray, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, mass: np.ndarray) -> tuple[float, np.ndarray]:
    """Of the mean -log P(grade), by p: weights, first threshold, logs of the steps between thresholds.

    Document rows[i] has values[i] of the feature cols[i]; y has the documents' grades and mass what each weighs.
    """
    n = len(p) - (GRADES - 1)
    w, steps_up, i = p[:n], np.exp(p[n + 1 :]), np.arange(len(y))
    thresholds = p[n] + np.concatenate([[0], np.cumsum(steps_up)])
    score = np.bincount(rows, w[cols] * values, len(y))
    below = 1 / (1 + np.exp(np.clip(score[:, None] - thresholds[None], -60, 60)))  # P(grade <= k)
    edges = np.concatenate([np.zeros((len(y), 1)), below, np.ones((len(y), 1))], 1)
    prob = np.maximum(edges[i, y + 1] - edges[i, y], 1e-12)
    slope = edges * (1 - edges)
    # d(-log prob) by the threshold above and the one below the grade
    up, down = -slope[i, y + 1] / prob * mass, slope[i, y] / prob * mass
    by_threshold = np.array([up[y == k].sum() + down[y == k + 1].sum() for k in range(GRADES - 1)])
    by_score = -(up + down)
    g = np.concatenate([np.bincount(cols, by_score[rows] * values, n), [by_threshold.sum()], by_threshold[::-1].cumsum()[::-1][1:] * steps_up])
    return float(-(mass * np.log(prob)).sum()), g


class CumulativeLink:
    def __init__(self, places: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.weights = dict(zip(places.tolist(), weights.tolist(), strict=True))
        self.thresholds = thresholds

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for k in 0, 1, ...: (documents, thresholds)."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None] - scores[:, None], -60, 60)))

    @staticmethod
    def fit(texts: list[str], grades: list[int], least: int = 5, steps: int = 300, rate: float = 0.08, sparse: float = 3e-4) -> CumulativeLink:
        found = [np.unique(np.array([p for f in features(t) for p in places_of(f)], np.int32), return_counts=True) for t in texts]
        found = [(f, k.astype(np.float32)) for f, k in found]
        count = np.zeros(PLACES, np.int32)
        for f, _ in found:
            count[f] += 1
        places = np.flatnonzero(count >= least).astype(np.int32)
        del count
        y = np.array(grades, np.int64)
        start = np.array([-1.0, 1.0])
        if not len(y) or not len(places):
            return CumulativeLink(places[:0], np.empty(0), np.array([-math.log(2), math.log(2)]))
        rows, cols, values = [], [], []
        for i, (f, k) in enumerate(found):
            at = np.minimum(np.searchsorted(places, f), len(places) - 1)
            here = places[at] == f
            rows.append(np.full(here.sum(), i, np.int32))
            cols.append(at[here].astype(np.int32))
            values.append(k[here])
        rows, cols, values = np.concatenate(rows), np.concatenate(cols), np.concatenate(values)
        del found
        per_grade = np.bincount(y, minlength=GRADES)
        mass = 1.0 / (per_grade[y] * (per_grade > 0).sum())
        # parameters: weights, first threshold, logs of the steps between thresholds
        p = np.concatenate([np.zeros(len(places)), start[:1], np.log(np.diff(start))])
        one, two, n = np.zeros_like(p), np.zeros_like(p), len(places)
        for t in range(1, steps + 1):
            _, g = loss_and_gradient(p, rows, cols, values, y, mass)
            one += 0.1 * (g - one)
            two += 0.001 * (g * g - two)
            now = rate * (1 - 0.9 * t / steps)
            p -= now * (one / (1 - 0.9**t)) / (np.sqrt(two / (1 - 0.999**t)) + 1e-5)
            scale = now / (np.sqrt(two[:n] / (1 - 0.999**t)) + 1e-5)
            p[:n] = np.sign(p[:n]) * np.maximum(np.abs(p[:n]) - np.minimum(sparse * scale, 0.02), 0)
        keep = p[:n] != 0
        return CumulativeLink(places[keep], p[:n][keep], p[n] + np.concatenate([[0], np.cumsum(np.exp(p[n + 1 :]))]))


class Scorer:
    """Scores of one worker; remembers the weight of every word that has one, and that others have none."""

    def __init__(self, model: CumulativeLink, remember: int = 500_000):
        self.model, self.known, self.remember = model, {}, remember

    def score(self, text: str | None) -> float:
        known, found = self.known, features(text)
        total = 0.0
        for f in found:
            w = known.get(f)
            if w is None:
                w = sum(self.model.weights.get(p, 0.0) for p in places_of(f))
                if len(known) < self.remember:
                    known[f] = w
            total += w
        return total


def graded(docs: DataFrame, labels: DataFrame, rated: int = 3000, max_bytes: int = 20_000) -> list:
    """(doc_id, text, grade) rows, a bounded sample of the labelled documents."""
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).when(F.col("quality").isNotNull(), 1)
    marks = labels.select("doc_id", grade.alias("grade")).where("grade is not null and doc_id is not null")
    n = marks.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30))
    marks = marks.where(draw < int((1 << 30) * min(1.0, rated / max(1, n)))).orderBy(draw, "doc_id", "grade").limit(2 * rated)
    side = F.broadcast(marks)  # at most 2 * rated rows
    found = docs.where(F.octet_length("text") <= max_bytes).select("doc_id", "text").join(side, "doc_id").orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text", "grade").limit(4 * rated).collect()
    return sorted(found, key=lambda r: (r["doc_id"], r["grade"], r["text"]))


def train(docs: DataFrame, labels: DataFrame, **bounds) -> CumulativeLink:
    rows = graded(docs, labels, **bounds)
    return CumulativeLink.fit([r["text"] for r in rows], [r["grade"] for r in rows])


def _grade(model: CumulativeLink):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for i in range(0, len(batch), 1024):
                part = batch.slice(i, 1024)
                scores = np.array([scorer.score(x.as_py()) for x in part.column(1)], np.float64)
                tails = model.tails(scores)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tails.sum(1)), pa.array(tails[:, 0]), pa.array(tails[:, 1])], ["doc_id", "expected_grade", "p_not_toxic", "p_good"])

    return run


def grade(docs: DataFrame, model: CumulativeLink) -> DataFrame:
    """doc_id, expected_grade, p_not_toxic and p_good of docs (doc_id, text)."""
    schema = docs.select("doc_id").schema.add("expected_grade", "double").add("p_not_toxic", "double").add("p_good", "double")
    return docs.select("doc_id", "text").mapInArrow(_grade(model), schema)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = grade(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", "expected_grade", "p_not_toxic", "p_good", (F.col("p_not_toxic") >= KEEP).alias("keep"))
