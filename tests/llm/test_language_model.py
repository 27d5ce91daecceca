"""The class model's scores, classes and probabilities against plain loops."""

import math
import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from parlance.llm import common, language_model


def held_out():
    F = common.F
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2


def is_held(doc_id):
    return doc_id is not None and crc32(str(doc_id).encode()) % 7 == 2


@pytest.fixture(scope="module")
def corpus(spark):
    """Sentences in which nouns follow articles and verbs nouns, so that there are classes to find."""
    rng = random.Random(6)
    kinds = [[f"{k}{i}" for i in range(n)] for k, n in (("art", 5), ("noun", 60), ("verb", 40))]
    rows = []
    for d in range(400):
        out = []
        for _ in range(rng.randint(0, 12)):
            out += [rng.choice(kinds[0]), rng.choice(kinds[1]), rng.choice(kinds[2])]
        if rng.random() < 0.3:
            out.insert(0, f"Odd{rng.randint(0, 400)}")
        rows.append((d, " ".join(out)))
    rows += [(500, None), (501, ""), (None, "art1 noun2"), (502, "zzz yyy"), (502, "zzz yyy")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def spaced(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()


@pytest.mark.parametrize("most", [30, 10**6])
def test_scores_against_plain_loops(corpus, most):
    rows, frame = corpus
    model, _, _, least = language_model.fit(frame, held_out(), most=most, core=20, classes=6)
    train = [spaced(t) for d, t in rows if not is_held(d)]
    count = Counter(w for t in train for w in t)
    held = {w for w in count if count[w] >= least}
    assert {w.decode() for w in model.number} == held and len(held) <= most

    def unit(w):
        return w if w in held else crc32(w.encode()[-4:]) % 256

    number = {w.decode(): i for w, i in model.number.items()}
    label = lambda u: int(model.classes[0 if u is None else number[u] if isinstance(u, str) else len(number) + 1 + u])
    every = [None, *sorted(held), *range(256)]
    times = Counter({None: len(train)})
    inside: dict = defaultdict(Counter)
    pairs: Counter = Counter()
    for t in train:
        units = [None, *map(unit, t), None]
        pairs.update((label(a), label(b)) for a, b in zip(units, units[1:]))
        times.update(units[1:-1])
        for w in t:
            if w not in held:
                inside[unit(w)][w] += 1
    k = len(model.transition)
    mass = [sum(times[u] + 1e-3 for u in every if label(u) == c) for c in range(k)]
    out = [sum(n for (a, _), n in pairs.items() if a == c) for c in range(k)]

    def p(before, u, w):
        a, b = label(before), label(u)
        prior = max(mass[b] / sum(mass), 1e-12)
        found = math.log10((pairs[a, b] + 8 * prior) / (out[a] + 8)) + math.log10((times[u] + 1e-3) / mass[b])
        if isinstance(u, int) and inside[u]:
            total = sum(inside[u].values())
            n = inside[u][w]
            found += math.log10((n - 0.5 if n else 0.5 * len(inside[u])) / total)
        return found

    got = sorted(((r.doc_id is None, r.doc_id or 0, r.score) for r in language_model.score_documents(frame, held_out(), most=most, core=20, classes=6).collect()))
    wanted = []
    for d, t in rows:
        units, seen = [None, *map(unit, spaced(t)), None], [None, *spaced(t), None]
        wanted.append((d is None, d or 0, sum(p(units[i - 1], units[i], seen[i]) for i in range(1, len(units)))))
    assert [x[:2] for x in got] == [x[:2] for x in sorted(wanted)]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in sorted(wanted)])
    for before in (None, "art1", 7):  # the words and each group's unseen word: all there is adds up to 1
        total = sum(10 ** p(before, u, w) for u in every for w in ([u] if not isinstance(u, int) else [*inside[u], "\0"]))
        assert total == pytest.approx(1)


def test_classes_are_found_outside_the_core(corpus):
    _, frame = corpus
    model, *_ = language_model.fit(frame, held_out(), core=12, classes=6)
    where = Counter((w.decode()[:3], int(model.classes[i])) for w, i in model.number.items())
    pure = sum(max(n for (_, other), n in where.items() if other == c) for c in {c for _, c in where})
    assert pure > 0.95 * sum(where.values())


def test_best_classes_against_plain_loops():
    rng = np.random.default_rng(2)
    k = 5
    between = rng.integers(50, 200, (k, k)).astype(float)
    before, after = rng.integers(0, 5, (40, k)).astype(float), rng.integers(0, 5, (40, k)).astype(float)
    now = rng.integers(-1, k, 40)
    got = language_model.best_classes(before, after, now, between)
    for u in range(40):
        scores = []
        for d in range(k):
            n = between.copy()
            if now[u] == d:
                n[d] -= after[u]
                own_in = between[:, d] - before[u]
            else:
                own_in = between[:, d]
            s = sum(after[u, c] * math.log(n[d, c] + 0.5) for c in range(k)) + sum(before[u, c] * math.log(own_in[c] + 0.5) for c in range(k))
            less_out, less_in = (after[u].sum(), before[u].sum()) if now[u] == d else (0, 0)
            s -= after[u].sum() * math.log(between[d].sum() - less_out + 0.5) + before[u].sum() * math.log(between[:, d].sum() - less_in + 0.5)
            scores.append(s)
        assert scores[got[u]] == pytest.approx(max(scores))


def test_counts_of_neighbours_take_few_bytes(spark):
    core, k, parts = 10, 4, 3
    rng = np.random.default_rng(5)
    texts = [[0, *(rng.zipf(1.3, 300) % 3_000 + 1).tolist(), 0] for _ in range(60)]
    texts += [[0, *[11, 2_999] * 700, 0], [0, 0]]  # counts and steps beyond a byte
    here = np.array([u % (k + 1) - 1 for u in range(3_001)], np.int16)
    wanted: Counter = Counter()
    for t in texts:
        for a, b in zip(t, t[1:]):
            wanted.update([(a, k + 0, int(here[b]))] if a >= core and here[b] >= 0 else [])
            wanted.update([(b, 0, int(here[a]))] if b >= core and here[a] >= 0 else [])
    frame = spark.createDataFrame([(np.array(t, "<i4").tobytes(),) for t in texts], "units binary").coalesce(1)
    rows = language_model._neighbours(frame, spark.sparkContext.broadcast(here), core, k, parts).toArrow()
    got: Counter = Counter()
    for part, *blobs in zip(*(rows[c] for c in ("part", "steps", "far", "n", "many"))):
        keys, n = np.cumsum(language_model._long(*blobs[:2])), language_model._long(*blobs[2:])
        for key, times in zip(keys.tolist(), n.tolist()):
            side = key % (2 * k) // k
            got[key // (2 * k) * parts + part.as_py(), k * (1 - side), key % k] += times
    assert got == wanted
    assert sum(len(x.as_py()) for c in ("steps", "far", "n", "many") for x in rows[c]) < 3 * len(wanted)  # two whole numbers take 8


def test_held_out_perplexity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = language_model.score_documents(docs, held_out()).where("held_out").collect()
    tokens = sum(r.n_tokens for r in rows)
    perplexity, base = (10 ** (-sum(r[c] for r in rows) / tokens) for c in ("score", "base_score"))
    assert perplexity < base / 3
