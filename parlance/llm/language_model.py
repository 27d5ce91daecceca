"""LM scoring with a class-based bigram model (Brown).

Every word that the workers can hold has a class of its own choice: the most frequent words are clustered by exchange
on the driver, which moves one word at a time; the classes of all others, and of the groups in which still rarer words
share by their ending, are found by distributed exchange: each moves to the class in which the classes of its
neighbours in the whole corpus are likeliest, until the likelihood grows no more. The probability of a word is
p(class | previous class) * p(unit | class) * p(word | unit), where a unit is a word that is held, or a group.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import materialise, shuffle_partitions, shuffles_deleted, table
from parlance.llm.tokens import common_from, tally

#: Words that every Python worker may hold, with count and class; rarer ones are joined by a shuffle.
COMMON = 300_000
#: Words that are clustered on the driver; their square is the size of its matrix.
CORE = 768
#: Groups, by ending, of words too rare to be held: those seen once, and all beyond COMMON.
GROUPS = 256
CLASSES = 64
#: Growth of the likelihood, in log10 a pair, below which the distributed exchange ends.
TOLERANCE = 1e-3
#: Units that a task gathers before it counts their neighbours.
HELD_UNITS = 6_000_000
DISCOUNT = 0.5
PRIOR_MASS = 8.0
END = 0  # the unit of the end token, before and after every text


def words(text: str | None) -> list[bytes]:
    """Words of the text with A-Z in lower case, in UTF-8. ASCII white space alone separates them."""
    return (text or "").encode().lower().split()


def group_of(word: bytes) -> int:
    return crc32(word[-4:]) % GROUPS


def _nlogn(x):
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """Class of each unit from counts of unit pairs (from, to). Units start by rank of frequency; each in turn
    moves to the class with the largest sum of n log n over class bigrams less that over class totals, until a
    round moves none. Each move raises the likelihood, so that comes. Deterministic, ties to the smaller class."""
    n_units = len(pairs)
    classes = max(1, min(classes, n_units))
    f = _nlogn
    total = pairs.sum(0) + pairs.sum(1)
    order = np.argsort(-total, kind="stable")
    label = np.empty(n_units, np.int64)
    label[order] = np.arange(n_units) % classes
    member = np.eye(classes)[label]
    to, fro = pairs @ member, pairs.T @ member  # unit -> class, class -> unit
    between = member.T @ to
    left, right = pairs.sum(1), pairs.sum(0)
    out, into = member.T @ left, member.T @ right
    moved = True
    while moved:
        moved = False
        for u in order.tolist():
            if not total[u]:
                continue
            c, loop = int(label[u]), pairs[u, u]
            a, b = to[u].copy(), fro[u].copy()
            a[c] -= loop
            b[c] -= loop
            between[c] -= a
            between[:, c] -= b
            between[c, c] -= loop
            out[c] -= left[u]
            into[c] -= right[u]
            base = f(between)
            rows = f(between + a).sum(1) - base.sum(1)
            cols = f(between + b[:, None]).sum(0) - base.sum(0)
            d = np.diag(between)
            both = f(d + a + b + loop) - f(d + a) - f(d + b) + f(d)
            gain = rows + cols + both - (f(out + left[u]) - f(out)) - (f(into + right[u]) - f(into))
            best = int(np.argmax(gain))
            if gain[best] <= gain[c] + 1e-7 * max(1.0, abs(gain[c])):
                best = c
            between[best] += a
            between[:, best] += b
            between[best, best] += loop
            out[best] += left[u]
            into[best] += right[u]
            if best != c:
                moved = True
                label[u] = best
                to[:, c] -= pairs[:, u]
                to[:, best] += pairs[:, u]
                fro[:, c] -= pairs[u]
                fro[:, best] += pairs[u]
    return label


def likelihood(between: np.ndarray) -> float:
    """Log10 likelihood of the class bigrams, without the part that no class changes."""
    return float(_nlogn(between).sum() - _nlogn(between.sum(0)).sum() - _nlogn(between.sum(1)).sum()) / math.log(10)


def best_classes(before: np.ndarray, after: np.ndarray, now: np.ndarray, between: np.ndarray) -> np.ndarray:
    """The likeliest class of each unit from the counts of the classes before and after it (rows), its class now (or
    -1) and the class bigrams. A unit's own share is taken out of its class. Ties stay, else the smaller class."""
    log = lambda x: np.log(np.maximum(x, 0) + 0.5)
    out, into = between.sum(1), between.sum(0)
    n_after, n_before = after.sum(1), before.sum(1)
    score = after @ log(between).T + before @ log(between) - np.outer(n_after, log(out)) - np.outer(n_before, log(into))
    has = np.flatnonzero(now >= 0)
    c = now[has]
    a, b = after[has], before[has]
    own = (a * log(between[c] - a)).sum(1) + (b * log(between[:, c].T - b)).sum(1)
    score[has, c] = own - n_after[has] * log(out[c] - n_after[has]) - n_before[has] * log(into[c] - n_before[has])
    best = score.argmax(1)
    stay = score[has, c] >= score[has, best[has]] - 1e-9
    best[has[stay]] = c[stay]
    return best


@dataclass
class Model:
    """Units are END, the held words by falling count (numbers from 1), then the groups. log_count has log10(count + 1)
    of each held word, classes the class of each unit; transition[c, d]: log10 p(class d | class c); emission[u]: log10
    p(unit u | its class)."""

    number: dict[bytes, int]
    counts: np.ndarray
    end_count: int
    vocabulary: int
    tokens: int
    group_tokens: np.ndarray
    group_words: np.ndarray
    classes: np.ndarray
    transition: np.ndarray
    emission: np.ndarray

    @property
    def first_group(self) -> int:
        return len(self.number) + 1

    @property
    def units(self) -> int:
        return self.first_group + GROUPS

    def encode(self, found: list[bytes]) -> tuple[np.ndarray, Counter]:
        """Units of the words with END before and after, and the words that are not held with their counts."""
        units = np.array([END, *map(self.number.get, found, repeat(-1)), END], np.int32)
        rare: Counter = Counter()
        for i in np.flatnonzero(units < 0).tolist():
            word = found[i - 1]
            rare[word] += 1
            units[i] = self.first_group + group_of(word)
        return units, rare

    def unknown(self, group: int) -> float:
        """log10 of what a group leaves to its words not seen in training, which count as one."""
        return math.log10(DISCOUNT * self.group_words[group] / self.group_tokens[group]) if self.group_tokens[group] else 0.0

    def share(self, group: int) -> float:
        """log10 p(word | group) of a seen word less log10(its count - DISCOUNT)."""
        return -math.log10(self.group_tokens[group]) if self.group_tokens[group] else 0.0


def count_words(docs: DataFrame, most: int = COMMON) -> tuple[Model, DataFrame, int]:
    """A model without classes, the counts (word, n) of all words of docs (text), and the least n of held words."""
    counts = docs.select("text").mapInArrow(lambda b: tally(b, "text", words, "word"), "word string, n long")
    counts = materialise(counts.groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.agg(F.count("*").alias("v"), F.sum("n").alias("n")).first()
    end_count = docs.count()
    least = max(common_from(counts, most), 2)  # words seen once tell, in their groups, what unseen ones are like
    held = counts.where(F.col("n") >= least).toArrow().sort_by([("n", "descending"), ("word", "ascending")])  # `most` rows at most
    number = {w.as_py().encode(): i + 1 for i, w in enumerate(held["word"])}
    held_counts = held["n"].to_numpy()
    del held

    def spread(batches):
        n, v = np.zeros(GROUPS, np.int64), np.zeros(GROUPS, np.int64)
        for batch in batches:
            at = np.fromiter((group_of(w.encode()) for w in batch["word"].to_pylist()), np.int64, batch.num_rows)
            n += np.bincount(at, batch["n"].to_numpy(), GROUPS).astype(np.int64)
            v += np.bincount(at, minlength=GROUPS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(GROUPS)), pa.array(n), pa.array(v)], ["g", "n", "v"])

    rare = counts.where(F.col("n") < least).mapInArrow(spread, "g long, n long, v long").groupBy("g").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    tokens, kinds = np.zeros(GROUPS), np.zeros(GROUPS)
    for r in rare:
        tokens[r.g], kinds[r.g] = r.n, r.v
    n_units = len(number) + 1 + GROUPS
    empty = np.zeros(0)
    model = Model(number, held_counts, end_count, (total.v or 0) + (end_count > 0), (total.n or 0) + end_count, tokens, kinds, np.full(n_units, -1, np.int16), empty, empty)
    return model, counts, least


def _chunks(batches):
    """Units of many texts in one array, each text from END to END."""
    held, size = [], 0
    for batch in batches:
        for raw in batch["units"]:
            held.append(np.frombuffer(raw.as_buffer(), "<i4"))
            size += len(held[-1])
            if size >= HELD_UNITS:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def _pairs(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours (from, to). Every other END ends a text, and the one behind it starts the next: no pair."""
    real = np.ones(len(units) - 1, bool)
    real[np.flatnonzero(units == END)[1:-1:2]] = False
    return units[:-1][real], units[1:][real]


def _table_of(texts: DataFrame, size: int, code) -> np.ndarray:
    """size x size counts of the codes of neighbouring units. Tasks pass on the cells they found; these are summed in
    eight tasks and then in one, whose size x size numbers reach the driver."""

    def cells(total: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array([at.astype("<i4").tobytes()], pa.binary()), pa.array([total[at].tobytes()], pa.binary())], ["at", "n"])

    def count(batches):
        total = np.zeros(size * size, np.int64)
        for units in _chunks(batches):
            a, b = _pairs(units)
            total += np.bincount(code(a).astype(np.int64) * size + code(b), minlength=size * size)
        yield cells(total)

    def add(batches):
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            for at, n in zip(batch["at"], batch["n"], strict=True):
                total[np.frombuffer(at.as_buffer(), "<i4")] += np.frombuffer(n.as_buffer(), "<i8")
        yield cells(total)

    with shuffles_deleted(texts.sparkSession):
        found = texts
        for parts, step in ((0, count), (8, add), (1, add)):
            found = (found.repartition(parts) if parts else found).mapInArrow(step, "at binary, n binary")
        rows = found.collect()
    out = np.zeros(size * size)
    for r in rows:
        out[np.frombuffer(r.at, "<i4")] += np.frombuffer(r.n, "<i8")
    return out.reshape(size, size)


def _short(values: np.ndarray) -> tuple[bytes, bytes]:
    """A byte for each value, and the whole values of those that a byte can't hold."""
    far = values >= 255
    return np.where(far, 255, values).astype(np.uint8).tobytes(), values[far].astype("<i4").tobytes()


def _long(short: pa.Scalar, far: pa.Scalar) -> np.ndarray:
    """The values of _short()."""
    values = np.frombuffer(short.as_buffer(), np.uint8).astype(np.int64)
    values[values == 255] = np.frombuffer(far.as_buffer(), "<i4")
    return values


_NEIGHBOURS = "part int, steps binary, far binary, n binary, many binary"


def _neighbours(texts: DataFrame, shared, core: int, k: int, parts: int) -> DataFrame:
    """Counts of the classes next to the units outside the core, a row (_NEIGHBOURS) for each part of a task's find.
    Units are dealt to parts in turn. A key is the unit's number within its part * 2k + the class after, or + k + the
    class before; keys ascend and go as steps, which like most counts fit in a byte."""

    def run(batches):
        here = shared.value
        for units in _chunks(batches):
            a, b = _pairs(units)
            keys = []
            for one, other, shift in ((a, b, 0), (b, a, k)):
                mine = one >= core
                c = here[other[mine]].astype(np.int32)
                keys.append((one[mine] * np.int32(2 * k) + np.int32(shift) + c)[c >= 0])
            keys, n = np.unique(np.concatenate(keys), return_counts=True)
            unit = keys // (2 * k)
            part, keys = unit % parts, unit // parts * (2 * k) + keys % (2 * k)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            for p in range(parts):
                mine = order[cuts[p] : cuts[p + 1]]
                if len(mine):
                    cols = [pa.array([x], pa.binary()) for x in (*_short(np.diff(keys[mine], prepend=0)), *_short(n[mine]))]
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *cols], ["part", "steps", "far", "n", "many"])

    return texts.mapInArrow(run, _NEIGHBOURS).repartitionById(parts, F.col("part"))


def _chosen(neighbours: DataFrame, shared, between: np.ndarray, parts: int) -> pa.Table:
    """(unit, class), a row for each unit outside the core that has a neighbour with a class."""
    k = len(between)

    def choose(batches):
        here = shared.value
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, steps, far, n, many in zip(batch["part"].to_pylist(), *(batch[c] for c in ("steps", "far", "n", "many")), strict=True):
                if part not in tables:
                    tables[part] = np.zeros((len(here) // parts + 1) * 2 * k)
                tables[part][np.cumsum(_long(steps, far))] += _long(n, many)  # a key is once in a row
        for part, table in tables.items():
            table = table.reshape(-1, 2 * k)
            every = np.flatnonzero(table.any(1))
            for i in range(0, len(every), 4_096):
                row = every[i : i + 4_096]
                unit = row * parts + part
                best = best_classes(table[row, k:], table[row, :k], here[unit].astype(np.int64), between)
                yield pa.RecordBatch.from_arrays([pa.array(unit, pa.int32()), pa.array(best, pa.int32())], ["unit", "class"])

    with shuffles_deleted(neighbours.sparkSession):
        return neighbours.mapInArrow(choose, "unit int, class int").toArrow()  # at most COMMON + GROUPS rows


def learn_classes(model: Model, texts: DataFrame, core: int = CORE, classes: int = CLASSES) -> np.ndarray:
    """Sets model.classes from texts (units binary) and returns the counts of class bigrams.

    The first turn knows the classes of the core alone; each further one knows all of the turn before. Turns end
    when the likelihood of the class bigrams grows by no more than TOLERANCE a pair; the best turn counts.
    """
    spark = texts.sparkSession
    parts = shuffle_partitions(spark)
    core = min(core, len(model.number) + 1)  # END is one of them; the last code stands for all other units
    label = exchange(_table_of(texts, core + 1, lambda u: np.minimum(u, core)), classes)
    k = int(label.max()) + 1
    now = np.full(model.units, -1, np.int16)
    now[:core] = label[:core]
    reached, bigrams, turn = -math.inf, np.zeros((k, k)), 0
    while True:
        shared = spark.sparkContext.broadcast(now)
        between = _table_of(texts, k + 1, lambda u, s=shared: s.value[u] + 1)[1:, 1:]  # units without a class are code 0
        if turn:
            value = likelihood(between)
            grown, before = value - reached, reached
            if grown > 0:
                model.classes, reached, bigrams = now, value, between
            if before > -math.inf and grown <= TOLERANCE * between.sum():
                return bigrams
        moved = _chosen(_neighbours(texts, shared, core, k, parts), shared, between, parts)
        now = now.copy()
        now[core:] = np.where(now[core:] < 0, label[core], now[core:])
        now[moved["unit"].to_numpy()] = moved["class"].to_numpy()
        shared.unpersist()
        turn += 1


def set_probabilities(model: Model, bigrams: np.ndarray) -> None:
    times = np.concatenate([[model.end_count], model.counts, model.group_tokens]) + 1e-3  # units never seen keep a trace
    in_class = np.bincount(model.classes, times, len(bigrams))
    prior = in_class / in_class.sum()
    model.transition = np.log10((bigrams + PRIOR_MASS * np.maximum(prior, 1e-12)) / (bigrams.sum(1, keepdims=True) + PRIOR_MASS))
    model.emission = np.log10(times / in_class[model.classes])


_ENCODED = "held_out boolean, n_tokens long, known long, base double, units binary, rare array<string>, times array<int>, seen array<double>, unseen array<double>"


def fit(docs: DataFrame, held_out: Column, most: int = COMMON, core: int = CORE, classes: int = CLASSES) -> tuple[Model, DataFrame, DataFrame, int]:
    """The model of the rows of docs (doc_id, text) that are not held out; all rows encoded (row, doc_id, _ENCODED);
    the counts (word, n) of the training words, and the least n of a word that is held."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    model, counts, least = count_words(docs.where(~F.col("held_out")), most)
    shared = spark.sparkContext.broadcast(model)

    def encode(batches):
        m = shared.value
        unknown, share = [m.unknown(g) for g in range(GROUPS)], [m.share(g) for g in range(GROUPS)]
        log_count = np.concatenate([[0.0], np.log10(m.counts + 1), np.zeros(GROUPS)])
        end_log, end_known = math.log10(m.end_count + 1), int(m.end_count > 0)
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for value in batch["text"]:
                found = words(value.as_py())
                units, rare = m.encode(found)
                groups = [group_of(w) for w in rare]
                row = (len(found) + 1, len(found) - rare.total() + end_known, float(log_count[units].sum()) + end_log, units.tobytes(), [w.decode() for w in rare], list(rare.values()), [share[g] for g in groups], [unknown[g] for g in groups])
                for col, x in zip(cols, row, strict=True):
                    col.append(x)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], *map(pa.array, cols, kinds)], ["doc_id", *(x.split()[0] for x in _ENCODED.split(", "))])

    kind = dict(docs.dtypes)["doc_id"]
    rows = materialise(docs.mapInArrow(encode, f"doc_id {kind}, {_ENCODED}").withColumn("row", F.monotonically_increasing_id()))
    shared.unpersist()
    set_probabilities(model, learn_classes(model, rows.where("not held_out").select("units"), core, classes))
    return model, rows, counts, least


def score_documents(docs: DataFrame, held_out: Column, most: int = COMMON, core: int = CORE, classes: int = CLASSES) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Learns from the rows that are not held out. Scores are log10 probabilities of the whole text with its end;
    null and empty texts are an end alone. base_score is the add-one unigram model's. The outcomes that either model
    gives probabilities to, which add up to 1, are the training words and what no training text has: one outcome for
    the base, one for each group here. Each row of docs gives one row; other columns are ignored.
    """
    model, rows, counts, least = fit(docs, held_out, most, core, classes)
    shared = docs.sparkSession.sparkContext.broadcast((model.classes, model.transition, model.emission))
    spread = math.log10(model.tokens + model.vocabulary + 1)

    def measure(batches):
        classes, transition, emission = shared.value
        for batch in batches:
            part = []
            for raw in batch["units"]:
                units = np.frombuffer(raw.as_buffer(), "<i4")
                label = classes[units]
                part.append(float(transition[label[:-1], label[1:]].sum() + emission[units[1:]].sum()))
            i = batch.schema.get_field_index("units")
            yield batch.set_column(i, pa.field("part", pa.float64()), pa.array(part, pa.float64()))

    kind = dict(docs.dtypes)["doc_id"]
    tail = rows.select("row", F.explode(F.arrays_zip("rare", "times", "seen", "unseen")).alias("x")).select("row", F.col("x.rare").alias("word"), "x.times", "x.seen", "x.unseen")
    n = F.col("n")
    tail = tail.join(counts.where(n < least), "word", "left").groupBy("row").agg(
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.when(n > 0, F.col("times") * F.log10(n + 1)).otherwise(0.0)).alias("more_base"),
        F.sum(F.col("times") * F.when(n > 0, F.log10(n - DISCOUNT) + F.col("seen")).otherwise(F.col("unseen"))).alias("more_score"),
    )
    rows = rows.select("row", "doc_id", "held_out", "n_tokens", "known", "base", "units")
    out = rows.mapInArrow(measure, f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, part double").join(tail, "row", "left")
    more = lambda c: F.coalesce(c, F.lit(0))
    score = F.col("part") + more("more_score")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + more("more_known")).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more("more_base") - F.col("n_tokens") * F.lit(spread)).alias("base_score"),
        score.alias("score"), F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), held_out)
