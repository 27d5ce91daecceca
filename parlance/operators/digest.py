"""Digests of sessions: summary sentences, keyphrases and figures, as columns and as a page of Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import ranking

SENTENCES, PHRASES = 5, 12


def figures(lines: DataFrame) -> DataFrame:
    """session_id, word_count, unique_words, speaking_rate: words a minute of audio, 0 without audio."""
    said = lines.where(T.strip(F.coalesce("text", F.lit(""))) != "")
    seconds = F.coalesce(F.sum("audio_seconds"), F.lit(0.0)) if "audio_seconds" in lines.columns else F.lit(0.0)
    words = said.select("session_id", F.explode(T.tokens(F.col("text"))).alias("w")).groupBy("session_id").agg(F.count("*").alias("word_count"), F.countDistinct("w").alias("unique_words"))
    audio = lines.groupBy("session_id").agg(seconds.cast("double").alias("audio"))
    out = audio.join(words, "session_id", "left").select("session_id", "audio", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("word_count", "unique_words")])
    rate = F.when(F.col("audio") > 0, F.col("word_count") / (F.col("audio") / 60)).otherwise(0.0)
    return out.select("session_id", "word_count", "unique_words", rate.alias("speaking_rate"))


def _listed(rows: DataFrame, order: str, *fields: str) -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_order"), *fields)))
    return rows.groupBy("session_id").agg(F.transform(items, lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("items"))


def build(lines: DataFrame, sentences: int = SENTENCES, phrases: int = PHRASES, compress: bool = True, language: str = "en") -> DataFrame:
    """lines -> a row for each session: summary (array of text, score, position, in the order told), keyphrases (array
    of phrase, score, best first), word_count, unique_words, speaking_rate, markdown. Blank lines do not count; a
    session of blank lines alone has empty lists."""
    said = lines.where(T.strip(F.coalesce("text", F.lit(""))) != "")
    best = ranking.text_rank(said, sentences, language)
    best = best.withColumn("text", T.compress(F.col("sentence")) if compress else F.col("sentence"))
    summary = _listed(best, "position", "text", "score", "position").withColumnRenamed("items", "summary")
    phrases_of = ranking.rake(said, phrases, language)
    keys = _listed(phrases_of, "rank", "phrase", "score").withColumnRenamed("items", "keyphrases")
    out = figures(lines).join(summary, "session_id", "left").join(keys, "session_id", "left")
    out = out.withColumn("summary", F.coalesce("summary", F.array().cast("array<struct<text:string,score:double,position:int>>")))
    out = out.withColumn("keyphrases", F.coalesce("keyphrases", F.array().cast("array<struct<phrase:string,score:double>>")))
    return out.withColumn("markdown", markdown(F.col("summary"), F.col("keyphrases")))


def _points(items: Column, one, none: str) -> Column:
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, one), "\n")).otherwise(none)


def markdown(summary: Column, keyphrases: Column) -> Column:
    points = _points(summary, lambda s: F.concat(F.lit("- "), s["text"]), "- nothing captured yet")
    keys = _points(keyphrases, lambda k: F.format_string("- %s (%.1f)", k["phrase"], k["score"]), "- none")
    return F.concat(F.lit("## Summary\n\n"), points, F.lit("\n\n## Key topics\n\n"), keys)
