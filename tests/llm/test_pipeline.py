"""The pipeline against a version in plain Python, on a small corpus with planted cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from lexmill.llm import language_id, simhash, token_output

LANGUAGES = {"aa": "bado kelu mira", "bb": "thwix strong quov", "cc": "éàü çôm ñiöß"}


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    rng = random.Random(7)
    letters = {k: v.replace(" ", "") for k, v in LANGUAGES.items()}
    word = lambda k: "".join(rng.choice(letters[k]) for _ in range(rng.randint(2, 8)))
    text = lambda k, n: " ".join(word(k) for _ in range(n))
    rows = []
    for i in range(240):
        k = rng.choice(list(LANGUAGES))
        rows.append([i, text(k, rng.randint(20, 150)), k, f"s{min(5, int(rng.expovariate(0.5)))}"])
    items = [text("aa", 30), text("bb", 14)]
    rows[5][1] = items[0] + " " + rows[5][1]
    rows[6][1] = rows[6][1] + " " + items[1].upper()
    rows[7][1] = f"{text('aa', 900)} {' '.join(items[0].split()[8:21])} {text('aa', 900)}"  # one window in a long document
    rows += [[240, rows[9][1], "aa", "s0"], [241, rows[9][1] + " x", "aa", None], [242, None, "aa", "s1"], [243, "12 345 !!", None, "s1"], [244, "", "bb", "s2"]]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def plain(spark, sf_dir) -> list[tuple[int, int]]:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((r.asDict() for r in docs.collect()), key=lambda r: r["doc_id"])
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    # 8
    guess = language_id.Reader(language_id.train(docs)).predict([r["text"] for r in rows])
    rows = [r for r, (x, s) in zip(rows, guess, strict=True) if x != "und" and s >= 0.3]
    # 2
    group = {r["doc_id"]: r["doc_id"] for r in rows}
    prints = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in rows}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = root(a), root(b)
                group[max(x, y)] = min(x, y)
    rows = [r for r in rows if root(r["doc_id"]) == r["doc_id"]]
    # 5
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    windows = {tuple(w[i : i + 13]) for w in map(low, items) for i in range(len(w) - 12)}

    def dirty(t):
        w = low(t)
        hit = {j for i in range(len(w) - 12) if tuple(w[i : i + 13]) in windows for j in range(i, i + 13)}
        return bool(hit)  # both items are of 13 words or more

    rows = [r for r in rows if not dirty(r["text"])]
    # 4
    words = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", r["text"]) for r in rows}
    of = defaultdict(list)
    for r in rows:
        of[r["source"]].append(r)
    size = {s: sum(len(words[r["doc_id"]]) for r in of[s]) for s in of}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(of, key=lambda s: (s is None, s)))}
    free, target, total = set(of), {}, 1.5 * sum(size.values())
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * size[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * size[s] for s in over}
        free -= over
    texts = []
    for s in of:
        whole = int(target[s] // size[s])
        more = int(np.floor(target[s] - whole * size[s] + 0.5))
        for r in sorted(of[s], key=lambda r: hashlib.md5(f"mix-1:{r['doc_id']}:{r['text']}".encode()).hexdigest()):
            texts += [(r["doc_id"], r["text"])] * whole
            n = min(more, len(words[r["doc_id"]]))
            more -= n
            if n:
                texts.append((r["doc_id"], r["text"] if n == len(words[r["doc_id"]]) else " ".join(words[r["doc_id"]][:n])))
    # 6
    from tokenizers import Tokenizer

    inner = Tokenizer.from_file(token_output.tokenizer_path())
    ids = [(i, inner.encode(t, add_special_tokens=False).ids + [1]) for i, t in texts]
    return sorted((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids)


def test_against_plain_python(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == plain(spark, sf_dir)
    ids = {r.doc_id for r in got}
    assert not ids & {5, 7, 240, 242, 243, 244}
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_stages_return_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for extra in (docs, docs.limit(0), docs.withColumn("size", docs.n_chars).withColumn("row_key", docs.doc_id)):
        now = extra
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, sf_dir)
            assert now.dtypes == extra.dtypes
            now.count()
