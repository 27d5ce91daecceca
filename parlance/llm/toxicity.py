"""Toxicity: nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

Terms are all words of the labelled examples and their openings (inflected forms share them); none is left out. A
term's weight is its idf times how much its presence tells about the labels, a smooth function of the log-likelihood
ratio of the two. Votes of the nearest examples, weighted by similarity and by how many labelled rows each example
stands for, give a raw score, which a logistic curve turns into a probability; the curve is fitted on the examples,
each scored by the others.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import materialise, table

#: Labelled rows of each class that a model is fitted on, the ones with the smallest hash of their id.
MAX_EXAMPLES = 1_000
OPENINGS = (4, 6)
NEIGHBOURS = 15
BLOCK = 64
#: A term with a log-likelihood ratio of this much has half of its idf as weight.
HALF_EVIDENCE = 10.0
#: Terms in over one in OFTEN of the examples, the most frequent ones, are held by blocks; at most so many.
OFTEN, BLOCKED = 16, 1_024
#: Blocks that set a text's first bound, and texts that are scored together.
FIRST_BLOCKS, TOGETHER = 4, 32
#: Texts whose result a worker remembers, and words whose terms.
REMEMBERED = 10_000
WORDS = 100_000
THRESHOLD = 0.7
PRIOR_VOTES = 0.5

_WORD = re.compile(r"[^\W\d_]+")
_NO_TERMS = np.zeros(0, np.int64)


def openings(word: str) -> list[str]:
    """The word, and its openings of 4 and 6 letters marked by a hyphen."""
    return [word, *(word[:k] + "-" for k in OPENINGS if len(word) >= k)]


def term_key(term: str) -> int:
    return xxhash.xxh64_intdigest(term)


def terms(text: str | None) -> Counter:
    """Counts of the words in lower case and of their openings."""
    found: Counter = Counter()
    for word, n in Counter(_WORD.findall((text or "").lower())).items():
        for term in openings(word):
            found[term] += n
    return found


def evidence(clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int) -> np.ndarray:
    """Log-likelihood ratio of a term's presence and the label, from the numbers of examples that have the term."""
    cells, total = 0.0, n_clean + n_toxic
    for k, row, col in (
        (toxic, toxic + clean, n_toxic), (clean, toxic + clean, n_clean),
        (n_toxic - toxic, total - toxic - clean, n_toxic), (n_clean - clean, total - toxic - clean, n_clean),
    ):
        expected = row * (col / max(total, 1))
        cells = cells + np.where(k > 0, k * np.log(np.maximum(k, 1) / np.where(expected > 0, expected, 1.0)), 0.0)
    return np.maximum(2 * cells, 0.0)


def term_weights(clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int) -> np.ndarray:
    idf = np.log((n_clean + n_toxic + 1) / (1 + clean + toxic)) + 1
    told = evidence(clean, toxic, n_clean, n_toxic)
    return idf * (told + 0.01) / (told + HALF_EVIDENCE)


@dataclass
class Model:
    """The index. Terms go by the hash of their text: keys are the hashes in order, a term's number its place. begin[t] to begin[t + 1] are term t's postings (at: example, w: weight), by example. Those of the most
    frequent terms, which have a place >= 0, are held by blocks of BLOCK examples instead: cells[block, example, place],
    and best, their largest weight in each block. slope and shift are the calibration."""

    keys: np.ndarray
    weights: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    votes: np.ndarray
    begin: np.ndarray
    at: np.ndarray
    w: np.ndarray
    base_rate: float
    slope: float = 1.0
    shift: float = 0.0
    n_blocks: int = field(init=False)

    def __post_init__(self):
        n = len(self.ids)
        self.n_blocks = n // BLOCK + 1
        held = np.diff(self.begin)
        frequent = [t for t in np.argsort(-held, kind="stable")[:BLOCKED].tolist() if held[t] * OFTEN > n]
        self.place = np.full(len(held), -1, np.int32)
        self.place[frequent] = np.arange(len(frequent))
        cells = np.zeros((self.n_blocks * BLOCK, len(frequent)))
        for i, t in enumerate(frequent):
            span = slice(self.begin[t], self.begin[t + 1])
            cells[self.at[span], i] = self.w[span]
        self.cells = cells.reshape(self.n_blocks, BLOCK, len(frequent))
        self.best = self.cells.max(1)
        rare = np.repeat(self.place < 0, held)
        self.at, self.w = self.at[rare].astype(np.int16 if n < 2**15 else np.int32), self.w[rare]
        self.begin = np.concatenate([[0], np.cumsum(np.where(self.place < 0, held, 0))])
        self.known: dict[bytes, tuple[float, list[int]]] = {}
        self.word_no: dict[str, int] = {}
        self.terms_of = np.full((WORDS, 1 + len(OPENINGS)), -1, np.int32)

    def __getstate__(self) -> dict:
        """Without what a worker finds again as it goes."""
        return self.__dict__ | {"known": {}, "word_no": {}, "terms_of": np.full((WORDS, 1 + len(OPENINGS)), -1, np.int32)}

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and weights of the text's terms, of length 1 over all terms that any example has."""
        counts = Counter(_WORD.findall((text or "").lower()))
        if len(self.word_no) + len(counts) > len(self.terms_of):
            self.word_no.clear()
            self.terms_of = np.full((max(WORDS, len(counts)), self.terms_of.shape[1]), -1, np.int32)
        numbers = list(map(self.word_no.get, counts))
        if None in numbers and len(self.keys):
            fresh = [word for word, n in zip(counts, numbers, strict=True) if n is None]
            first = len(self.word_no)
            self.word_no.update(zip(fresh, range(first, first + len(fresh)), strict=True))
            mine = [openings(word) for word in fresh]
            place = np.repeat(np.arange(first, first + len(fresh)), [len(m) for m in mine])
            slot = np.concatenate([np.arange(len(m)) for m in mine])
            hashes = np.array([term_key(t) for m in mine for t in m], np.uint64)
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            self.terms_of[place, slot] = np.where(self.keys[at] == hashes, at, -1)
            numbers = list(map(self.word_no.get, counts))
        elif not len(self.keys):
            return _NO_TERMS, np.zeros(0)
        found = self.terms_of[numbers] if numbers else self.terms_of[:0]
        known = found >= 0
        times = np.broadcast_to(np.fromiter(counts.values(), float, len(counts))[:, None], found.shape)[known]
        found = found[known]
        if not len(found):
            return _NO_TERMS, np.zeros(0)
        ts, back = np.unique(found.astype(np.int64), return_inverse=True)
        raw = (1 + np.log(np.bincount(back, times))) * self.weights[ts]
        return ts, raw / math.sqrt(raw @ raw)

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each vector the cosines and numbers of the k nearest examples, nearest first, ties by number; the
        example numbered in without is left out. Exact: the rarer terms are added up in full, and a block is left out
        only if its largest such sum and the sum of its largest weights of the frequent terms are together below
        the k-th best cosine of the text's first blocks."""
        n, many = self.n_blocks * BLOCK, len(vectors)
        part, q = np.zeros((many, n)), np.zeros((many, self.cells.shape[2]))
        for i, (ts, v) in enumerate(vectors):
            place = self.place[ts]
            q[i, place[place >= 0]] = v[place >= 0]
            ts, v = ts[place < 0], v[place < 0]
            first = self.begin[ts]
            size = self.begin[ts + 1] - first
            if size.sum():
                index = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
                part[i] = np.bincount(self.at[index], self.w[index] * np.repeat(v, size), n)
        if without is not None:
            part[np.arange(many), without] = -np.inf
        blocks = part.reshape(many, self.n_blocks, BLOCK)
        upper = blocks.max(2) + q @ self.best.T
        least = np.zeros(many)
        for i in range(many):
            ahead = np.argsort(-upper[i], kind="stable")[:FIRST_BLOCKS]
            score = np.concatenate([blocks[i, b] + self.cells[b] @ q[i] for b in ahead])
            if len(score) >= k:
                least[i] = max(np.partition(score, len(score) - k)[-k], 0.0)
        score = np.full((many, self.n_blocks, BLOCK), -np.inf)
        for b in range(self.n_blocks):
            mine = np.flatnonzero((upper[:, b] >= least - 1e-9) & (upper[:, b] > 0))
            if len(mine):
                score[mine, b] = blocks[mine, b] + q[mine] @ self.cells[b].T
        out = []
        for row in score.reshape(many, n).round(12):
            top = np.flatnonzero(row >= np.partition(row, n - k)[-k]) if n > k else np.arange(n)
            top = top[row[top] > 0]
            top = top[np.lexsort((top, -row[top]))][:k]
            out.append((row[top], top))
        return out

    def votes_of(self, cosine: np.ndarray, at: np.ndarray) -> float:
        w = cosine * cosine * self.votes[at]
        return float((w @ self.labels[at] + PRIOR_VOTES * self.base_rate) / (w.sum() + PRIOR_VOTES))

    def calibrated(self, raw: float) -> float:
        if not 0 < raw < 1:
            return raw
        return 1 / (1 + math.exp(-(self.slope * math.log(raw / (1 - raw)) + self.shift)))

    def score(self, texts: list[str | None]) -> list[tuple[float, list[int]]]:
        """Score from 0 to 1, and the ids of the three nearest examples. Without any known term: the rate of
        toxic rows among labelled rows."""
        keys = [xxhash.xxh3_128_digest((t or "").encode()) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        fresh = {key: text for key, text in zip(keys, texts, strict=True) if key not in self.known}  # copies come again and again
        todo = list(fresh.items())
        for i in range(0, len(todo), TOGETHER):
            part = todo[i : i + TOGETHER]
            for (key, _), (cosine, at) in zip(part, self.nearest([self.vector(t) for _, t in part]), strict=True):
                score = self.calibrated(self.votes_of(cosine, at)) if len(at) else self.base_rate
                self.known[key] = score, self.ids[at[:3]].tolist()
        return [self.known[key] for key in keys]


def calibration(raw: np.ndarray, toxic: np.ndarray, votes: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve over the log odds of raw scores that fits the labels best, by Newton's
    method, with a pull of the slope towards 1."""
    x = np.log(np.clip(raw, 1e-9, 1 - 1e-9) / (1 - np.clip(raw, 1e-9, 1 - 1e-9)))
    slope, shift = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * x + shift, -500, 500)))
        g, h = votes * (p - toxic), votes * np.maximum(p * (1 - p), 1e-9)
        bend = np.array([[(h * x * x).sum() + 1, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-3]])
        step = np.clip(np.linalg.solve(bend, np.array([(g * x).sum() + slope - 1, g.sum()])), -1, 1)
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(slope), float(shift)


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> Model:
    """docs (doc_id, text), labels (doc_id, toxic) -> Model. Rows without id, label or text are left out; an id
    labelled twice counts as toxic if one label says so, of several texts of an id the one with the smallest hash
    counts. Without labels every score is 0."""
    spark = docs.sparkSession
    rows = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = rows.withColumn("toxic", (F.col("toxic") > 0).cast("int"))
    totals = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for y in (0, 1):
        part = rows.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
        chosen = part if chosen is None else chosen.unionAll(part)
    chosen = spark.createDataFrame(chosen.collect(), rows.schema)  # 2 * max_examples pairs of numbers at most
    examples = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null")
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x")
    examples = materialise(examples.groupBy("doc_id", "toxic").agg(one).select("doc_id", "toxic", "x.text"))

    def count(batches):
        tally: dict[str, list[int]] = {}
        for batch in batches:
            for text, y in zip(batch["text"], batch["toxic"].to_pylist(), strict=True):
                for t in terms(text.as_py()):
                    tally.setdefault(t, [0, 0])[y] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array([v[0] for v in tally.values()], pa.int64()), pa.array([v[1] for v in tally.values()], pa.int64())], ["term", "clean", "toxic"])

    found = examples.mapInArrow(count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    found = found.toArrow().sort_by("term")  # the terms of 2 * max_examples texts, whatever the input
    n = {r.toxic: r.n for r in examples.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_clean, n_toxic = n.get(0, 0), n.get(1, 0)
    stands_for = [totals.get(0, 0) / max(n_clean, 1), totals.get(1, 0) / max(n_toxic, 1)]
    keys = np.array([term_key(t.as_py()) for t in found["term"]], np.uint64)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    weights = term_weights(found["clean"].to_numpy()[order], found["toxic"].to_numpy()[order], n_clean, n_toxic)
    base_rate = totals.get(1, 0) / max(sum(totals.values()), 1)
    nothing = np.zeros(0)
    shared = spark.sparkContext.broadcast(Model(keys, weights, nothing, nothing, nothing, np.zeros(len(keys) + 1, np.int64), np.zeros(0, np.int32), nothing, base_rate))

    def vectors(batches):
        for batch in batches:
            out = [shared.value.vector(x.as_py()) for x in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["toxic"], pa.array([t for t, _ in out], pa.list_(pa.int32())), pa.array([v for _, v in out], pa.list_(pa.float64()))], ["doc_id", "toxic", "terms", "weights"])

    # the vectors of 2 * max_examples texts at most
    indexed = examples.select("doc_id", "text", "toxic").mapInArrow(vectors, "doc_id long, toxic int, terms array<int>, weights array<double>").toArrow().sort_by("doc_id").combine_chunks()
    shared.unpersist()
    sizes = np.array([len(x) for x in indexed["terms"]], np.int64)
    term, w = (np.concatenate([np.zeros(0, k), *[c.flatten().to_numpy() for c in indexed[name].chunks]]) for name, k in (("terms", np.int32), ("weights", float)))
    at = np.repeat(np.arange(len(indexed), dtype=np.int32), sizes)
    order = np.argsort(term, kind="stable")
    begin = np.searchsorted(term[order], np.arange(len(keys) + 1))
    ids, y = indexed["doc_id"].to_numpy().astype(np.int64), indexed["toxic"].to_numpy().astype(float)
    votes = np.where(y > 0, stands_for[1], stands_for[0])
    model = Model(keys, weights, ids, y, votes, begin, at[order], w[order], base_rate)
    if n_clean and n_toxic:
        shared = spark.sparkContext.broadcast(model)
        place = {d: i for i, d in enumerate(ids.tolist())}

        def others_say(batches):
            m = shared.value
            for batch in batches:
                texts, own = batch["text"].to_pylist(), [place[d] for d in batch["doc_id"].to_pylist()]
                raw = []
                for i in range(0, len(texts), TOGETHER):
                    found = m.nearest([m.vector(t) for t in texts[i : i + TOGETHER]], without=own[i : i + TOGETHER])
                    raw += [m.votes_of(c, a) for c, a in found]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(raw, pa.float64())], ["own", "raw"])

        said = examples.select("doc_id", "text").mapInArrow(others_say, "own long, raw double").toArrow()
        shared.unpersist()
        own = said["own"].to_numpy()
        model.slope, model.shift = calibration(said["raw"].to_numpy(), y[own], votes[own])
    return model


def training_part(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def scorer(spark: SparkSession, model: Model):
    """A column function text -> struct<score, evidence>. Null and empty texts get the base rate."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("score double, evidence array<long>")
    def score(texts: pd.Series) -> pd.DataFrame:
        found = shared.value.score(texts.tolist())
        return pd.DataFrame({"score": [s for s, _ in found], "evidence": [e for _, e in found]})

    return score


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text) and labels -> doc_id, held_out, score, predicted, evidence (nearest examples' ids).

    Learns from labels outside the held-out third only. Each row of docs gives one row; a null id is not
    held out. Other columns are ignored.
    """
    labels = labels.select("doc_id", "toxic").where(training_part(F.col("doc_id")))
    score = scorer(docs.sparkSession, fit(docs, labels))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return docs.select("doc_id", held_out.alias("held_out"), score("text").alias("s")).select(
        "doc_id", "held_out", "s.score", (F.col("s.score") >= THRESHOLD).cast("int").alias("predicted"), "s.evidence"
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
