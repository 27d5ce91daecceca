"""Transcripts as subtitles, plain text and JSON.

Each format is a DataFrame of blocks (session_id, n, block), so that a session of any length is written in order
without being gathered into one value; document() joins the blocks of short sessions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from parlance.functions import text as T
from parlance.operators import sequence

FORMATS = ("srt", "vtt", "txt", "json")


def _sound(pieces: Column) -> Column:
    return F.filter(F.coalesce(pieces, F.array()), lambda p: (T.strip(p["text"]) != "") & (p["end"] > p["start"]))


def pieces(lines: DataFrame, granularity: str = "segment", translated: bool = False) -> DataFrame:
    """lines (session_id, seq, text, started_at, ended_at; speaker, translation and spans where they have them) ->
    session_id, seq, part, text, started_at, ended_at, speaker, origin.

    A line gives its spans, or their words, where those have text and a length, else itself; a translated line
    gives its translation. Blank lines are left out; origin is the session's first start.
    """
    has = set(lines.columns)
    kept = lines.where(T.strip(F.col("text")) != "")
    kept = kept.withColumn("origin", F.min("started_at").over(W.partitionBy("session_id")))
    unit = lambda c: F.struct(F.col("started_at").cast("double").alias("start"), F.col("ended_at").cast("double").alias("end"), c.alias("text"))
    plain = lambda p: F.struct(p["start"].cast("double").alias("start"), p["end"].cast("double").alias("end"), p["text"].alias("text"))
    found = F.array(unit(F.col("text")))
    if "spans" in has:
        spans = _sound(F.col("spans"))
        timed = F.transform(spans, plain)
        found = F.when(F.size(timed) > 0, timed).otherwise(found)
        if granularity == "word":
            words = F.transform(_sound(F.flatten(F.transform(spans, lambda s: F.coalesce(s["words"], F.array())))), plain)
            found = F.when(F.size(words) > 0, words).otherwise(found)
    if translated and "translation" in has:
        found = F.when(F.coalesce("translation", F.lit("")) != "", F.array(unit(F.col("translation")))).otherwise(found)
    speaker = F.col("speaker") if "speaker" in has else F.lit(None).cast("string")
    out = kept.select("session_id", "seq", speaker.alias("speaker"), "origin", F.posexplode(found).alias("part", "p"))
    return out.select("session_id", "seq", "part", "speaker", "origin", F.col("p.text").alias("text"), F.col("p.start").alias("started_at"), F.col("p.end").alias("ended_at"))


def cues(lines: DataFrame, granularity: str = "segment", translated: bool = False) -> DataFrame:
    """Numbered cues without overlap: session_id, n, cue_start, cue_end, speaker, text (white space collapsed)."""
    order = W.partitionBy("session_id").orderBy("seq", "part")
    numbered = pieces(lines, granularity, translated).withColumn("n", F.row_number().over(order))
    timed = sequence.cues(numbered.drop("seq").withColumnRenamed("n", "seq"), origin=F.col("origin"))
    text = T.strip(F.regexp_replace("text", r"(?U)\s+", " "))
    return timed.select("session_id", F.col("seq").alias("n"), "cue_start", "cue_end", "speaker", text.alias("text"))


def blocks(lines: DataFrame, form: str, speakers: bool = True, granularity: str = "segment", translated: bool = False) -> DataFrame:
    """session_id, n, block in one of FORMATS; the plain text never takes translations or words."""
    if form not in FORMATS:
        raise ValueError(f"unknown format {form!r}; known: {', '.join(FORMATS)}")
    if form == "json":
        return lines.select("session_id", F.col("seq").alias("n"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in lines.columns])).alias("block"))
    c = cues(lines) if form == "txt" else cues(lines, granularity, translated)
    said = F.col("text")
    if speakers:
        said = F.when(F.coalesce("speaker", F.lit("")) != "", F.concat(F.lit("["), "speaker", F.lit("] "), "text")).otherwise(said)
    if form == "txt":
        block = F.concat(F.lit("["), F.substring(T.clock(F.col("cue_start")), 1, 8), F.lit("] "), said, F.lit("\n"))
    else:
        mark = "," if form == "srt" else "."
        times = F.concat(T.clock(F.col("cue_start"), mark), F.lit(" --> "), T.clock(F.col("cue_end"), mark), F.lit("\n"))
        lead = F.concat(F.col("n").cast("string"), F.lit("\n")) if form == "srt" else F.when(F.col("n") == 1, "WEBVTT\n\n").otherwise("")
        gap = F.when(F.col("n") == 1, "").otherwise("\n")
        block = F.concat(gap, lead, times, said, F.lit("\n"))
    return c.select("session_id", "n", block.alias("block"))


def document(found: DataFrame) -> DataFrame:
    """blocks -> session_id, content: one string a session, for sessions that fit a row."""
    rows = F.array_sort(F.collect_list(F.struct("n", "block")))
    return found.groupBy("session_id").agg(F.array_join(F.transform(rows, lambda r: r["block"]), "").alias("content"))


def _line(column: str) -> Column:
    """The writer ends what it writes with a line feed, so the one at the end goes."""
    return F.regexp_replace(column, r"\n\z", "").alias(column)


def write(found: DataFrame, path: str) -> None:
    """blocks as text files, a folder for each session, in the order of n; folders of other sessions stay."""
    ordered = found.repartition("session_id").sortWithinPartitions("session_id", "n")
    ordered.select("session_id", _line("block")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").text(path)


def session_documents(sessions: DataFrame, lines: DataFrame, actions: DataFrame, entities: DataFrame) -> DataFrame:
    """session_id, content: a JSON document for each session with its lines, actions, speakers and entities."""
    from parlance.operators import store

    def gathered(rows: DataFrame, name: str, *order: str) -> DataFrame:
        fields = F.struct(*order, F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != "session_id"]).alias("_row"))
        return rows.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(fields)), lambda x: x["_row"]).alias(name))

    out = sessions
    for part in (
        gathered(lines, "transcript", "seq"), gathered(store.speaker_totals(lines), "speakers", "rank"),
        gathered(actions.withColumn("urgent", -F.col("priority")), "actions", "urgent", "created_at", "id"), store.entity_map(entities),
    ):
        out = out.join(part, "session_id", "left")
    session = F.struct(*[F.col(f"`{c}`") for c in sessions.columns]).alias("session")
    return out.select("session_id", F.to_json(F.struct(session, "transcript", "actions", "speakers", "entities")).alias("content"))


SUFFIX = {"srt": ".srt", "vtt": ".vtt", "txt": ".txt", "md": ".md", "json": ".json"}


def write_documents(found: DataFrame, folder: str, form: str) -> None:
    """documents (session_id, content) as files of one form below folder, a folder for each session."""
    if form not in SUFFIX:
        raise ValueError(f"unknown format {form!r}; known: {', '.join(sorted(SUFFIX))}")
    found.select("session_id", _line("content")).write.mode("overwrite").partitionBy("session_id").text(f"{folder}/{form}")
