"""All analytics of a line in one pass: language, translation, subject, rules, entities, sentiment, topics, mood."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import language as L
from parlance.functions import sentiment as S
from parlance.functions import text as T
from parlance.operators import entities, rules, sequence


@dataclass(frozen=True)
class Toggles:
    """What analyse() does; a part that is off leaves a typed empty or null column."""

    language: bool = True
    translate: bool = True
    rules: bool = True
    entities: bool = True
    sentiment: bool = True
    topics: bool = True
    target: str = "en"
    default: str = "en"
    window: int = 3
    threshold: float = 0.2


def subject(text: Column, code: Column, translation: Column, toggles: Toggles) -> Column:
    """The text that is judged: itself in a language that is served, else its translation, else null."""
    served = code.isin(*L.SUPPORTED)
    other = F.when(F.lit(toggles.translate and toggles.target in L.SUPPORTED) & (F.coalesce(translation, F.lit("")) != ""), translation)
    return F.when(served, text).otherwise(other)


def analyse(lines: DataFrame, toggles: Toggles = Toggles(), translator=None) -> DataFrame:  # noqa: B008
    """lines (session_id, seq, text; translation where they have one) with language, confidence, current, translation,
    subject, via_translation, extractions, entities, sentiment (struct), rolling, momentum, topic_shift.

    translator is a column function (text, from, to) -> text or null; a translation that comes with the line goes
    before it. Entities are taken from the original where there is no subject. Each row gives one row; a null text
    counts as empty, is neutral, and has no extraction.
    """
    names = lines.columns
    rows = with_language(lines, toggles)
    rows = judged(led(L.sticky(rows, toggles.default) if toggles.language else rows, names, toggles), toggles, translator)
    rows = sequence.rolling(rows.withColumn("compound", F.col("sentiment.compound"))).drop("compound")
    if toggles.topics:
        told = rows.where(F.coalesce("subject", F.lit("")) != "").select("session_id", "seq", F.col("subject").alias("text"))
        # distinct: Spark leaves the join out where topic_shift is not asked for
        shifts = sequence.topic_shifts(told, toggles.window, toggles.threshold).select("session_id", "seq").distinct().withColumn("topic_shift", F.lit(True))
        rows = rows.join(shifts, ["session_id", "seq"], "left").withColumn("topic_shift", F.coalesce("topic_shift", F.lit(False)))
    else:
        rows = rows.withColumn("topic_shift", F.lit(False))
    return ordered(extracted(rows, toggles), names)


def with_language(lines: DataFrame, toggles: Toggles) -> DataFrame:
    """lines with a stripped text and, where languages are told apart, code and confidence of each by itself."""
    rows = lines.withColumn("text", T.strip(F.coalesce("text", F.lit(""))))
    if not toggles.language:
        return rows
    return rows.withColumn("_g", L.detect(F.col("text"), toggles.default)).select(*[f"`{c}`" for c in lines.columns], F.col("_g.code").alias("code"), F.col("_g.confidence").alias("confidence"))


def led(rows: DataFrame, names: list[str], toggles: Toggles) -> DataFrame:
    """rows with language, confidence and current; where languages are not told apart, the default."""
    if toggles.language:
        return rows.withColumnsRenamed({"code": "language"})
    return rows.select(*[f"`{c}`" for c in names], F.lit(toggles.default).alias("language"), F.lit(0.0).alias("confidence"), F.lit(toggles.default).alias("current"))


def _spoken(toggles: Toggles) -> Column:
    return F.when(F.col("via_translation"), toggles.target).otherwise(F.col("current"))


def judged(rows: DataFrame, toggles: Toggles, translator=None) -> DataFrame:
    """rows with translation, subject, via_translation and sentiment, by the language in charge."""
    given = F.nullif(F.col("translation"), F.lit("")) if "translation" in rows.columns else F.lit(None).cast("string")
    made = translator(F.col("text"), F.col("current"), F.lit(toggles.target)) if translator and toggles.translate else F.lit(None).cast("string")
    need = (F.col("current") != toggles.target) & (F.col("text") != "")
    rows = rows.withColumn("translation", F.when(need, F.coalesce(given, made)).otherwise(given))
    rows = rows.withColumn("subject", subject(F.col("text"), F.col("current"), F.col("translation"), toggles))
    translated = ~F.col("current").isin(*L.SUPPORTED) & F.col("subject").isNotNull()
    rows = rows.withColumn("via_translation", translated)
    mood = S.score(F.col("subject"), _spoken(toggles)) if toggles.sentiment else F.lit(None).cast("struct<compound:double,positive:double,negative:double,neutral:double,label:string>")
    return rows.withColumn("sentiment", F.when(F.col("subject").isNotNull(), mood))


def extracted(rows: DataFrame, toggles: Toggles) -> DataFrame:
    """rows with extractions and entities."""
    hit = "array<struct<kind:string,text:string,rule:string,start:int,end:int,confidence:double,priority:int,due:string>>"
    found = rules.matched(F.col("subject"), _spoken(toggles)) if toggles.rules else F.array().cast(hit)
    named = entities.matched(F.coalesce("subject", F.col("text"))) if toggles.entities else F.array().cast(entities.SCHEMA)
    return rows.withColumn("extractions", F.coalesce(found, F.array().cast(hit))).withColumn("entities", F.coalesce(named, F.array().cast(entities.SCHEMA)))


_MADE = ("language", "confidence", "current", "translation", "subject", "via_translation", "extractions", "entities", "sentiment", "rolling", "momentum", "topic_shift")


def ordered(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.select(*[f"`{c}`" for c in [*names, *(c for c in _MADE if c not in names)]])


def children(analysed: DataFrame) -> dict[str, DataFrame]:
    """The child tables of analysed lines: action_items of the stored kinds, entities, topics."""
    action = analysed.select("session_id", "seq", F.explode("extractions").alias("x")).select("session_id", "seq", "x.*").where(F.col("kind").isin(*rules.STORED))
    action = action.withColumn("id", rules.item_id(F.col("session_id"), F.col("seq"), F.col("kind"), F.col("start"))).withColumn("done", F.lit(False))
    named = analysed.select("session_id", "seq", F.explode("entities").alias("e")).select("session_id", "seq", "e.text", "e.kind", "e.label")
    return {"action_items": action, "entities": named, "topics": analysed.where("topic_shift").select("session_id", F.col("seq").alias("at_index"))}
