"""Analysis that carries on across the batches of a stream: a session's windows are the same however it is cut.

Two state folds with the stateless analytics of a line between them: the language in charge (the last confidences), then
rolling mood, momentum and topic shifts (the last scores and the words of the last lines). A session keeps some twenty
values and six lists of words, whatever its length.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce
from operator import add

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import StructType

from parlance.functions import language as L
from parlance.functions import text as T
from parlance.operators import analyse as A
from parlance.operators import sequence

#: Microseconds are kept, where the default form has fewer.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


class Windows:
    """The windows of one session, line by line: what sequence.rolling and sequence.topic_shifts give for whole ones."""

    def __init__(self, toggles: A.Toggles, size: int = sequence.WINDOW, least: int = 4):
        self.toggles, self.size, self.least = toggles, max(2, size), least
        self.scores: list[float] = []
        self.words: list[list[str]] = []
        self.told, self.kept = 0, -toggles.window

    def mood(self, compound: float | None) -> tuple[float, float]:
        if compound is not None:
            self.scores = [*self.scores, compound][-self.size :]
        mean = lambda v: reduce(add, v, 0.0) / max(len(v), 1)  # noqa: E731 - sum() would round otherwise than the engine
        n = len(self.scores)
        return mean(self.scores), mean(self.scores[n // 2 :]) - mean(self.scores[: n // 2]) if n >= 4 else 0.0

    def shift(self, seq: int, words: list[str] | None) -> bool:
        """words is None for a line that is not judged."""
        if words is None or not self.toggles.topics:
            return False
        w = self.toggles.window
        self.words = [*self.words, words][-2 * w :]
        self.told += 1
        before, now = (Counter(x for line in part for x in line) for part in (self.words[:-w], self.words[-w:]))
        if self.told < 2 * w or min(before.total(), now.total()) < self.least:
            return False
        dot = lambda a, b: float(sum(n * b[x] for x, n in a.items()))
        if dot(before, now) / math.sqrt(dot(before, before) * dot(now, now)) >= self.toggles.threshold or seq - self.kept < w:
            return False
        self.kept = seq
        return True


def _packed(rows: DataFrame) -> DataFrame:
    """All columns in one text, so that none changes its type on the way through Python."""
    return rows.withColumn("packed", F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), _JSON))


def _unpacked(rows: DataFrame, schema: StructType) -> DataFrame:
    return rows.withColumn("packed", F.from_json("packed", schema, _JSON)).select("packed.*", *[c for c in rows.columns if c != "packed"])


def _in_order(parts) -> pd.DataFrame:
    """A session's lines of one batch; a batch is bounded by the source's options."""
    return pd.concat(list(parts)).sort_values("seq", kind="stable")


class _Fold(StatefulProcessor):
    """step(lines in order, state or None) -> (columns, state), for each session of each batch."""

    def __init__(self, step, state: str, names: list[str]):
        self.step, self.state, self.names = step, state, names

    def init(self, handle) -> None:
        self.held = handle.getValueState("held", self.state)

    def handleInputRows(self, key, rows, timers):  # noqa: N802
        lines = _in_order(rows)
        columns, after = self.step(lines, self.held.get() if self.held.exists() else None)
        self.held.update(after)
        yield lines[["packed"]].assign(**columns)[self.names]

    def close(self) -> None:
        pass


def _fold(rows: DataFrame, step, out: str, state: str) -> DataFrame:
    names = ["packed", *[c.split()[0] for c in out.split(", ")]]
    return rows.groupBy("session_id").transformWithStateInPandas(_Fold(step, state, names), f"packed string, {out}", "append", "none")


def _languages(rows: DataFrame, default: str) -> DataFrame:
    """L.sticky of a stream."""
    schema = rows.schema

    def step(lines: pd.DataFrame, held):
        now, codes, sure = held or (default, [], [])
        recent, out = list(zip(codes, sure, strict=True)), []
        for code, confidence in zip(lines["code"], lines["confidence"], strict=True):
            recent = [*recent, (code, float(confidence))][-L.WINDOW :]
            now = L.in_charge(recent, now)
            out.append(now)
        return {"current": out}, (now, [c for c, _ in recent], [x for _, x in recent])

    folded = _fold(_packed(rows).select("session_id", "seq", "packed", "code", "confidence"), step, "current string", "now string, codes array<string>, sure array<double>")
    return _unpacked(folded, schema)


def _windows(rows: DataFrame, toggles: A.Toggles) -> DataFrame:
    schema = rows.schema
    words = F.when(F.coalesce("subject", F.lit("")) != "", T.tokens(F.col("subject"), drop_stopwords=True))
    slim = _packed(rows).select("session_id", "seq", "packed", F.col("sentiment.compound").alias("compound"), words.alias("words"))

    def step(lines: pd.DataFrame, held):
        w = Windows(toggles)
        if held:
            w.scores, w.words, w.told, w.kept = list(held[0]), [list(x) for x in held[1]], int(held[2]), int(held[3])
        out = []
        for seq, compound, said in zip(lines["seq"], lines["compound"], lines["words"], strict=True):
            mood = w.mood(None if pd.isna(compound) else float(compound))
            out.append((*mood, w.shift(int(seq), None if said is None or isinstance(said, float) else list(said))))
        rolling, momentum, shifts = map(list, zip(*out, strict=True))
        return {"rolling": rolling, "momentum": momentum, "topic_shift": shifts}, (w.scores, w.words, w.told, w.kept)

    folded = _fold(slim, step, "rolling double, momentum double, topic_shift boolean", "scores array<double>, words array<array<string>>, told long, kept long")
    return _unpacked(folded, schema)


def analyse_stream(lines: DataFrame, toggles: A.Toggles = A.Toggles(), translator=None) -> DataFrame:  # noqa: B008
    """analyse.analyse() of a stream of lines, row for row the same for every cut of a session into batches.

    The lines of a session come in the order of seq from batch to batch, in any order within one. session_id and seq are
    not null, or null throughout.
    """
    names = lines.columns
    rows = A.with_language(lines, toggles)
    if toggles.language:
        rows = _languages(rows, toggles.default)
    rows = A.judged(A.led(rows, names, toggles), toggles, translator)
    return A.ordered(A.extracted(_windows(rows, toggles), toggles), names)
