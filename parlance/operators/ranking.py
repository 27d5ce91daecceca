"""Summary sentences and keyphrases of a session."""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from parlance.functions import text as T

DAMPING, ROUNDS, TOLERANCE = 0.85, 40, 1e-5


def sentence_table(lines: DataFrame, language: str = "en") -> DataFrame:
    """session_id, position, sentence, words of all sentences, numbered along the session."""
    parts = lines.select("session_id", "seq", F.posexplode(T.sentences(F.col("text"))).alias("i", "sentence"))
    order = W.partitionBy("session_id").orderBy("seq", "i")
    return parts.select("session_id", (F.row_number().over(order) - 1).alias("position"), "sentence", T.tokens(F.col("sentence"), True, language).alias("words"))


def edges(sentences: DataFrame) -> DataFrame:
    """session_id, i, j, weight for i < j: shared words over the logarithms of both lengths. Sentences meet by word,
    so those that share none never do."""
    parts = sentences.select("session_id", "position", F.size("words").alias("n"), F.explode(F.array_distinct("words")).alias("word"))
    a = parts.select("session_id", "word", F.col("position").alias("i"), F.col("n").alias("ni"))
    b = parts.select("session_id", "word", F.col("position").alias("j"), F.col("n").alias("nj"))
    met = a.join(b, ["session_id", "word"]).where("i < j").groupBy("session_id", "i", "j", "ni", "nj").agg(F.count("*").alias("shared"))
    weight = F.col("shared") / (F.log(F.col("ni") + 1.0) + F.log(F.col("nj") + 1.0))
    return met.select("session_id", "i", "j", weight.alias("weight"))


def inbound(sentences: DataFrame) -> DataFrame:
    """session_id, position, c of the sentences that share a word with another: the sum over the others of the edge's
    weight over the other's total weight.

    No two sentences meet. An edge's weight is a sum over shared words of 1 / (log n + log m), which depends on the
    lengths n and m alone, so that a word's part in the totals comes from how many of its sentences have each length,
    and its part in c from the sum of 1 / total at each length, both less the sentence itself. A word of any number of
    sentences is a few rows, one for each length.
    """
    key = ["session_id", "word"]
    parts = sentences.select("session_id", "position", F.size("words").alias("n"), F.explode(F.array_distinct("words")).alias("word"))
    span = lambda x, y: F.log(x["n"] + 1.0) + F.log(y["n"] + 1.0)
    weigh = lambda size: lambda x: F.struct(
        x["n"].alias("n"), F.aggregate("lengths", F.lit(0.0), lambda t, y: t + size(x, y) / span(x, y)).alias("part"), x["amount"].alias("amount"), x["count"].alias("count")
    )

    def by_length(rows: DataFrame, amount: Column, size) -> DataFrame:
        lengths = rows.groupBy(*key, "n").agg(amount.alias("amount"), F.count("*").alias("count"))
        words = lengths.groupBy(*key).agg(F.collect_list(F.struct("n", "amount", "count")).alias("lengths"), F.sum("count").alias("holders"))
        return words.where("holders > 1").select(*key, F.explode(F.transform("lengths", weigh(size))).alias("x")).select(*key, "x.*")

    parts = parts.repartition(*key, "n")
    others = by_length(parts, F.lit(0.0), lambda x, y: (y["count"] - F.when(x["n"] == y["n"], 1).otherwise(0)).cast("double"))
    met = parts.join(others.select(*key, "n", "part"), [*key, "n"])
    total = met.groupBy("session_id", "position").agg(F.sum("part").alias("total"))
    back = met.drop("part").join(total, ["session_id", "position"]).withColumn("one", 1 / F.col("total"))
    masses = by_length(back, F.sum("one"), lambda x, y: F.when(x["n"] == y["n"], 0.0).otherwise(y["amount"]))
    same = F.when(F.col("count") > 1, F.col("amount") - F.col("one")).otherwise(0.0) / (2 * F.log(F.col("n") + 1.0))
    return back.join(masses, [*key, "n"]).groupBy("session_id", "position").agg(F.sum(F.col("part") + same).alias("c"))


def _sessions(batches):
    """(session, positions, inbound weights) of the sessions of a sorted partition."""
    session, position, c = None, [], []
    for batch in batches:
        keys = batch["session_id"].to_numpy()
        for at in np.split(np.arange(len(keys)), np.flatnonzero(keys[1:] != keys[:-1]) + 1) if len(keys) else []:
            if position and keys[at[0]] != session:
                yield session, np.concatenate(position), np.concatenate(c)
                position, c = [], []
            session = keys[at[0]]
            position.append(batch["position"].to_numpy()[at])
            c.append(batch["c"].to_numpy()[at])
    if position:
        yield session, np.concatenate(position), np.concatenate(c)


def _frames(rows, columns: list[str], size: int = 5000):
    rows = iter(rows)
    while part := list(islice(rows, size)):
        yield pd.DataFrame(part, columns=columns)


def text_rank(lines: DataFrame, k: int = 5, language: str = "en") -> DataFrame:
    """session_id, position, sentence, score, rank of the k best sentences. A sentence's inbound weight c is fixed, and
    scores turn by x = (1 - d) / n + d * c * x, scaled to sum 1 each turn; a task has the numbers of one session."""
    s = sentence_table(lines, language)
    rows = s.select("session_id", "position").join(inbound(s), ["session_id", "position"], "left").withColumn("c", F.coalesce("c", F.lit(0.0)))

    def best(batches):
        for session, position, c in _sessions(batches):
            score = turned(c)
            order = np.lexsort((position, -score.round(12)))[:k]
            yield from ((session, int(position[i]), float(score[i]), rank) for rank, i in enumerate(order, 1))

    kind = lines.schema["session_id"].dataType.simpleString()
    ordered = rows.select("session_id", "position", "c").repartition("session_id").sortWithinPartitions("session_id", "position")
    top = ordered.mapInPandas(lambda batches: _frames(best(batches), ["session_id", "position", "score", "rank"]), f"session_id {kind}, position int, score double, rank int")
    return top.join(s.select("session_id", "position", "sentence"), ["session_id", "position"]).select("session_id", "position", "sentence", "score", "rank")


def turned(c: np.ndarray) -> np.ndarray:
    """The scores of a session's sentences from their inbound weights: turns until they move by less than TOLERANCE."""
    n = len(c)
    x = np.full(n, 1.0 / n)
    for _ in range(ROUNDS if n > 1 else 0):
        new = (1 - DAMPING) / n + DAMPING * c * x
        new /= new.sum()
        x, moved = new, np.abs(new - x).sum()
        if moved < TOLERANCE:
            break
    return x


_SPLIT = re.compile(r"[^^\w'\-]+|[\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_FILLER = frozenset({"um", "uh", "erm", "hmm", "mm", "ah", "eh", "like", "yeah", "okay"})


def phrases(text: str | None, stop: frozenset[str] = frozenset(T.STOPWORDS) | _FILLER) -> list[list[str]]:
    """Runs of words of three letters or more between sentence ends, stop words, fillers and digits; a run is cut
    after each four words."""
    out, run = [], []
    for sentence in _SENTENCE.split(text or ""):
        for piece in [*_SPLIT.split(sentence.strip()), ""]:
            piece = piece.lower()
            held = len(piece) >= 3 and piece not in stop
            if held:
                run.append(piece)
            if run and (not held or len(run) == 4):
                out.append(run)
                run = []
    return out


def rake(lines: DataFrame, k: int = 12, language: str = "en") -> DataFrame:
    """session_id, phrase, score, occurrences, rank: the sum over a phrase's words of (degree + frequency) / frequency."""

    stop = frozenset(T.stopwords(language)) | _FILLER

    @F.pandas_udf("array<array<string>>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: phrases(t, stop))

    found = lines.select("session_id", F.explode(split("text")).alias("words"))
    found = found.groupBy("session_id", "words").agg(F.count("*").alias("n"))
    word = found.select("session_id", "n", F.size("words").alias("size"), F.explode("words").alias("word"))
    score = word.groupBy("session_id", "word").agg(F.sum("n").alias("f"), F.sum(F.col("n") * (F.col("size") - 1)).alias("d"))
    score = score.select("session_id", "word", ((F.col("d") + F.col("f")) / F.col("f")).alias("s"))
    each = found.select("session_id", "words", "n", F.explode("words").alias("word")).join(score, ["session_id", "word"])
    total = each.groupBy("session_id", "words", "n").agg(F.sum("s").alias("score")).withColumn("phrase", F.array_join("words", " "))
    order = W.partitionBy("session_id").orderBy(F.desc(F.round(F.col("score") * F.log1p("n"), 9)), "phrase")
    return total.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("session_id", "phrase", "score", F.col("n").alias("occurrences"), "rank")


