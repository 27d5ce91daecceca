"""The whole TF-IDF space, the exact search in it, and scores against plain loops."""

import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np

from parlance.llm import toxicity


def test_copy_of_a_toxic_example_without_marking_words(spark):
    word = lambda i: "".join(chr(97 + int(d)) for d in str(i)) * 2
    docs = [(i, " ".join(f"{word(i * 50 + j)}" for j in range(30)) + " the and of") for i in range(60)]
    docs.append((100, docs[7][1]))
    docs.append((101, docs[30][1]))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 10)) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.fit(frame, labels)
    (toxic, near), (clean, other), (none, _) = model.score([docs[60][1], docs[61][1], None])
    assert near[0] == 7 and other[0] == 30 and toxic > clean
    assert none == model.base_rate == 10 / 60


def test_nearest_is_exact():
    rng = np.random.default_rng(4)
    n, terms = 700, 300
    dense = rng.random((n, terms)) * (rng.random((n, terms)) < rng.random(terms) ** 3)
    at = [np.flatnonzero(dense[:, t]) for t in range(terms)]
    begin = np.concatenate([[0], np.cumsum([len(a) for a in at])])
    model = toxicity.Model(np.arange(terms, dtype=np.uint64), np.ones(terms), np.arange(n), np.zeros(n), np.ones(n), begin, np.concatenate(at), np.concatenate([dense[a, t] for t, a in enumerate(at)]), 0.1)
    assert 0 < model.cells.shape[2] < terms
    vectors = []
    for size in (0, 1, 5, 40, 150):
        ts = np.sort(rng.choice(terms, size, replace=False))
        vectors.append((ts.astype(np.int64), rng.random(size)))
    for without in (None, [3, 1, 4, 1, 5]):
        for i, ((ts, v), (cosine, found)) in enumerate(zip(vectors, model.nearest(vectors, without=without), strict=True)):
            score = (dense[:, ts] @ v).round(12)
            if without:
                score[without[i]] = 0
            best = [j for j in sorted(range(n), key=lambda j: (-score[j], j))[:15] if score[j] > 0]
            assert found.tolist() == best and np.allclose(cosine, score[best])


def brute_scores(rows, labels, texts):
    """Scores worked out term by term: (id, text) rows, {id: toxic} labels."""

    def terms(text):
        out = Counter()
        for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
            for t in {w, *(w[:k] + "-" for k in (4, 6) if len(w) >= k)}:
                out[t] += 1
        return out

    train = sorted((d, labels[d], terms(t)) for d, t in rows if d in labels and crc32(str(d).encode()) % 3 != 1)
    n = [sum(y == k for _, y, _ in train) for k in (0, 1)]
    has = [Counter(t for _, y, f in train if y == k for t in f) for k in (0, 1)]
    weight = {}
    for t in {*has[0], *has[1]}:
        told = 0.0
        for y in (0, 1):
            for inside in (True, False):
                k = has[y][t] if inside else n[y] - has[y][t]
                row = has[0][t] + has[1][t] if inside else sum(n) - has[0][t] - has[1][t]
                if k:
                    told += 2 * k * math.log(k / (row * n[y] / sum(n)))
        told = max(told, 0.0)
        weight[t] = (math.log((sum(n) + 1) / (1 + has[0][t] + has[1][t])) + 1) * (told + 0.01) / (told + 10)

    def unit(found):
        raw = {t: (1 + math.log(k)) * weight[t] for t, k in found.items() if t in weight}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {t: x / norm for t, x in raw.items()}

    index = [(d, y, unit(f)) for d, y, f in train]
    base = n[1] / sum(n)

    def raw(vector, without=None):
        near = sorted(((-round(sum(x * e.get(t, 0.0) for t, x in vector.items()), 12), i) for i, (d, _, e) in enumerate(index) if d != without))
        near = [(-c, i) for c, i in near[:15] if c < 0]
        top = sum(c * c * index[i][1] for c, i in near) + 0.5 * base
        return top / (sum(c * c for c, _ in near) + 0.5)

    said = [raw(e, d) for d, _, e in index]
    slope, shift = toxicity.calibration(np.array(said), np.array([float(y) for _, y, _ in index]), np.ones(len(index)))
    out = []
    for text in texts:
        vector = unit(terms(text))
        p = raw(vector)
        out.append(1 / (1 + math.exp(-(slope * math.log(p / (1 - p)) + shift))) if vector else base)
    return out


def test_scores_against_plain_loops(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows, labels = [], {}
    for d in range(150):
        toxic = int(rng.random() < 0.3)
        rows.append((d, " ".join([*rng.choices(words, k=rng.randint(5, 60)), *rng.choices(["vilebad", "vileness", "awful"], k=2 * toxic)])))
        if rng.random() < 0.8:
            labels[d] = toxic
    rows += [(200, ""), (201, None), (202, "zzz qqq"), (203, "VILENESS, vilebad")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score_documents(frame, marks).collect()}
    for (d, _), wanted in zip(rows, brute_scores(rows, labels, [t for _, t in rows]), strict=True):
        assert math.isclose(got[d], wanted, abs_tol=1e-9), d


def test_scores_mean_what_they_say(spark):
    """Reliability on the held-out rows: in each band of scores the share of toxic rows is near the mean score."""
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet").join(labels, "doc_id", "left_semi")
    rows = toxicity.score_documents(docs, labels).where("held_out").join(labels, "doc_id").select("score", "toxic", "predicted").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit / sum(r.predicted for r in rows) >= 0.9 and hit / sum(r.toxic for r in rows) >= 0.9
    for low, high in ((0.0, 0.3), (0.3, 0.7), (0.7, 1.01)):
        band = [r for r in rows if low <= r.score < high]
        if len(band) >= 10:
            assert abs(sum(r.score for r in band) / len(band) - sum(r.toxic for r in band) / len(band)) < 0.2
