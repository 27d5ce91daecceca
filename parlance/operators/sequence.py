"""Analytics along the lines of a session, as window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from parlance.functions import text as T
from parlance.functions.sentiment import bound

WINDOW = 12
MIN_CUE = 0.4


def by_session() -> W:
    return W.partitionBy("session_id").orderBy("seq")


def rolling(lines: DataFrame, value: str = "compound", window: int = WINDOW) -> DataFrame:
    """lines with rolling (mean of the last scored values) and momentum (newer half's mean less the older half's, 0
    below four values). Lines without a value carry the last ones on."""
    size = max(2, window)
    so_far = by_session().rowsBetween(W.unboundedPreceding, 0)
    rated = lines.withColumn("_nth", F.count(value).over(so_far))
    # a line without a value has the number of the last one with a value, so the frame has that one's values
    frame = W.partitionBy("session_id").orderBy("_nth").rangeBetween(-(size - 1), 0)
    rated = rated.withColumn("_recent", F.collect_list(F.when(F.col(value).isNotNull(), F.struct("seq", F.col(value).cast("double").alias("v")))).over(frame))
    values = F.transform(F.array_sort("_recent"), lambda x: x["v"])

    def both(recent: Column) -> Column:
        n = F.size(recent)
        half = F.floor(n / 2).cast("int")
        mean = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.greatest(F.size(a), F.lit(1))
        newer, older = F.slice(recent, half + 1, n - half), F.slice(recent, F.lit(1), half)
        return F.struct(mean(recent).alias("rolling"), F.when(n < 4, 0.0).otherwise(mean(newer) - mean(older)).alias("momentum"))

    out = rated.withColumn("_both", bound(values, both))
    return out.select(*[F.col(f"`{c}`") for c in lines.columns], "_both.rolling", "_both.momentum")


def cues(lines: DataFrame, least: float = MIN_CUE, origin: Column | None = None) -> DataFrame:
    """lines (started_at, ended_at) with cue_start, cue_end from origin (the session's first start), without overlap: a cue starts
    when the one before has ended and keeps its length. In closed form, with the running sum D of lengths:
    end = D + max over lines so far of (start - D before)."""
    whole = W.partitionBy("session_id")
    base = F.min("started_at").over(whole) if origin is None else origin
    s = F.greatest(F.lit(0.0), F.col("started_at") - base)
    length = F.greatest(F.col("ended_at") - base - s, F.lit(least))
    upto = by_session().rowsBetween(W.unboundedPreceding, 0)
    rows = lines.withColumn("s", s).withColumn("length", length)
    rows = rows.withColumn("d", F.sum("length").over(upto))
    end = F.col("d") + F.max(F.col("s") - (F.col("d") - F.col("length"))).over(upto)
    return rows.withColumn("cue_end", end).withColumn("cue_start", F.col("cue_end") - F.col("length")).drop("s", "d", "length")


def topic_candidates(lines: DataFrame, window: int = 3, threshold: float = 0.2, least: int = 4) -> DataFrame:
    """lines (session_id, seq, text) -> those where the words of the last `window` lines and of the `window` before
    are unlike: session_id, seq, similarity (cosine of word counts)."""
    words = lines.withColumn("words", T.tokens(F.col("text"), drop_stopwords=True))
    now, past = by_session().rowsBetween(-(window - 1), 0), by_session().rowsBetween(-(2 * window - 1), -window)
    frames = words.select(
        "session_id", "seq", F.flatten(F.collect_list("words").over(past)).alias("a"), F.flatten(F.collect_list("words").over(now)).alias("b"),
        F.count("*").over(by_session()).alias("n"),
    ).where((F.col("n") >= 2 * window) & (F.size("a") >= least) & (F.size("b") >= least))
    count = lambda a, w: F.size(F.filter(a, lambda x: x == w))
    dot = lambda a, b: F.aggregate(F.array_distinct(a), F.lit(0.0), lambda s, w: s + count(a, w) * count(b, w))
    a, b = F.col("a"), F.col("b")
    similarity = dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
    return frames.select("session_id", "seq", similarity.alias("similarity")).where(F.col("similarity") < threshold)


def topic_shifts(lines: DataFrame, window: int = 3, threshold: float = 0.2, least: int = 4) -> DataFrame:
    """topic_candidates() at least `window` lines after the last one kept: a fold over a session's candidates."""
    found = topic_candidates(lines, window, threshold, least)

    kind = "array<struct<seq:int,similarity:double>>"
    every = F.array_sort(F.collect_list(F.struct("seq", "similarity"))).cast(kind)

    def step(kept: Column, x: Column) -> Column:
        near = x["seq"] - F.coalesce(F.get(kept, F.size(kept) - 1)["seq"], F.lit(-window)) < window
        return F.when(near, kept).otherwise(F.concat(kept, F.array(x)))

    kept = found.groupBy("session_id").agg(every.alias("all")).select("session_id", F.aggregate("all", F.array().cast(kind), step).alias("kept"))
    return kept.select("session_id", F.explode("kept").alias("k")).select("session_id", "k.*")


def last_lines(lines: DataFrame, n: int) -> DataFrame:
    newest = W.partitionBy("session_id").orderBy(F.desc("seq"))
    return lines.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= n).drop("back")
