"""Queries over stored sessions: summaries, totals, status and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def summaries(sessions: DataFrame, lines: DataFrame) -> DataFrame:
    """Sessions with any line: utterances, audio_seconds, speakers."""
    joined = sessions.join(lines.select("session_id", "seq", "speaker", "audio_seconds"), "session_id", "left")
    out = joined.groupBy("session_id", "name").agg(F.count("seq").alias("utterances"), F.sum("audio_seconds").alias("audio_seconds"), F.countDistinct("speaker").alias("speakers"))
    return out.where("utterances > 0")


def latest_with_lines(sessions: DataFrame, lines: DataFrame) -> DataFrame:
    return sessions.join(lines, "session_id", "left_semi").orderBy(F.desc("ended_at"), "session_id").limit(1)


def entity_totals(entities: DataFrame) -> DataFrame:
    """entities (session_id, text, kind) by text in lower case and kind; the smallest spelling stands for all."""
    out = entities.groupBy(F.lower("text").alias("name"), "kind")
    return out.agg(F.min("text").alias("text"), F.count("*").alias("mentions"), F.countDistinct("session_id").alias("sessions"))


def speaker_share(lines: DataFrame, seconds: str = "audio_seconds") -> DataFrame:
    """Lines and seconds of each speaker, with the share of the session's seconds; nameless speakers are left out."""
    named = lines.where(F.trim(F.coalesce("speaker", F.lit(""))) != "")
    out = named.groupBy("session_id", "speaker").agg(F.count("*").alias("lines"), F.sum(seconds).alias("seconds"))
    total = F.sum("seconds").over(W.partitionBy("session_id"))
    return out.withColumn("share", F.when(total > 0, F.col("seconds") / total).otherwise(0.0))


def metrics(lines: DataFrame, actions: DataFrame) -> DataFrame:
    """Utterances and speakers of each session, and its actions, open ones apart."""
    a = actions.groupBy("session_id").agg(F.count("*").alias("total_actions"), F.count_if(~F.col("done")).alias("open_actions"))
    u = lines.groupBy("session_id").agg(F.count("*").alias("utterances"), F.countDistinct("speaker").alias("speakers"))
    out = u.join(a, "session_id", "left")
    return out.select("session_id", "utterances", "speakers", F.coalesce("total_actions", F.lit(0)).alias("total_actions"), F.coalesce("open_actions", F.lit(0)).alias("open_actions"))


def latest_status(actions: DataFrame, changes: DataFrame) -> DataFrame:
    """actions (id) with done from the newest change (id, at, done); false without one."""
    newest = changes.groupBy("id").agg(F.max_by("done", F.struct("at", "done")).alias("done"))
    return actions.drop("done").join(newest, "id", "left").withColumn("done", F.coalesce("done", F.lit(False)))


def rename_speakers(lines: DataFrame, names: DataFrame) -> DataFrame:
    """names (speaker, new_name); a label that gets another's name joins it."""
    return lines.join(names, "speaker", "left").withColumn("speaker", F.coalesce("new_name", "speaker")).drop("new_name")


def top_actions(actions: DataFrame, n: int = 500) -> DataFrame:
    """Open actions, most urgent and then oldest first, with their rank."""
    top = actions.where(~F.col("done")).orderBy(F.desc("priority"), "created_at", "id").limit(n)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("priority"), "created_at", "id")))


LINES = "session_id string, seq int, text string, started_at double, ended_at double, audio_seconds double, inference_seconds double, compound double, label string, speaker string, translation string"
TABLES = ("transcript", "action_items", "entities", "topics")


def append(folder: str, batch_id: int, analysed: DataFrame) -> DataFrame:
    """The analysed lines of one batch, written once and read back.

    One write in a folder of its own holds a line with all that belongs to it, and its mark of success is the commit:
    a reader sees all tables of a batch or none, and a batch that is written again, after a failure, replaces itself.
    """
    path = f"{folder}/lines/batch_id={batch_id}"
    analysed.write.mode("overwrite").parquet(path)
    return analysed.sparkSession.read.schema(analysed.schema).parquet(path)


def committed(spark: SparkSession, folder: str) -> list[str]:
    """The folders of the batches that were written to the end."""
    jvm = spark.sparkContext._jvm
    marks = jvm.org.apache.hadoop.fs.Path(f"{folder}/lines/batch_id=*/_SUCCESS")
    found = marks.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(marks)
    return sorted(str(f.getPath().getParent().toString()) for f in found or [])


def stored(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table (TABLES) of the committed batches."""
    from parlance.operators import analyse

    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}; known: {', '.join(TABLES)}")
    paths = committed(spark, folder)
    if not paths:
        raise ValueError(f"nothing is stored in {folder}")
    rows = spark.read.parquet(*paths)
    if name != "transcript":
        return analyse.children(rows)[name]
    return rows.withColumn("compound", F.col("sentiment.compound")).withColumn("label", F.col("sentiment.label"))



def load_session(lines: DataFrame, session_id, limit: int = 1_000) -> DataFrame:
    """One session's lines in order; the filter reaches the scan."""
    return lines.where(F.col("session_id") == session_id).orderBy("seq").limit(limit)


def load_actions(actions: DataFrame, session_id) -> DataFrame:
    """One session's actions, most urgent and then oldest first, with their rank."""
    order = W.orderBy(F.desc("priority"), "created_at", "id")
    return actions.where(F.col("session_id") == session_id).withColumn("rank", F.row_number().over(order))


def session_info(sessions: DataFrame, ids: DataFrame) -> DataFrame:
    """A row for each id in ids (session_id): its session, or one named after the id without times."""
    found = ids.join(sessions, "session_id", "left")
    return found.withColumn("name", F.coalesce("name", F.col("session_id").cast("string")))


def past_sessions(sessions: DataFrame, limit: int = 25) -> DataFrame:
    """Newest first, with their rank."""
    order = (F.desc("started_at"), F.col("session_id"))
    return sessions.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(W.orderBy(*order)))


def scored_summaries(sessions: DataFrame, lines: DataFrame) -> DataFrame:
    """summaries() with the mean compound."""
    joined = sessions.join(lines.select("session_id", "seq", "speaker", "audio_seconds", "compound"), "session_id", "left")
    out = joined.groupBy("session_id", "name", "started_at").agg(
        F.count("seq").alias("utterances"), F.avg("compound").alias("average_sentiment"), F.sum("audio_seconds").alias("audio_seconds"), F.countDistinct("speaker").alias("speakers")
    )
    return out.where("utterances > 0")


def all_actions(actions: DataFrame, sessions: DataFrame, limit: int = 500, open_only: bool = False) -> DataFrame:
    """Actions with their session's name and start, newest session first, then most urgent, then oldest, with rank."""
    kept = actions.where(~F.col("done")) if open_only else actions
    named = kept.join(sessions.select("session_id", F.col("name").alias("session_name"), F.col("started_at").alias("session_started")), "session_id", "left")
    order = (F.desc_nulls_last("session_started"), F.desc("priority"), F.col("created_at"), F.col("id"))
    return named.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(W.orderBy(*order)))


def ranked_entities(entities: DataFrame, kind: str | None = None, limit: int | None = None) -> DataFrame:
    """entity_totals() in the order of reports: in most sessions first, then most mentions, with rank."""
    found = entity_totals(entities)
    found = found.where(F.col("kind") == kind) if kind else found
    order = (F.desc("sessions"), F.desc("mentions"), F.col("name"), F.col("kind"))
    found = found.orderBy(*order).limit(limit) if limit else found
    return found.withColumn("rank", F.row_number().over(W.orderBy(*order)))


def entity_counts(entities: DataFrame) -> DataFrame:
    """session_id, kind, text, n: spellings apart, unlike entity_totals()."""
    return entities.groupBy("session_id", "kind", "text").agg(F.count("*").alias("n"))


def entity_map(entities: DataFrame) -> DataFrame:
    """session_id, entities: map of kind to map of text to n."""
    inner = entity_counts(entities).groupBy("session_id", "kind").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("text", "n")))).alias("counts"))
    return inner.groupBy("session_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", F.to_json("counts").alias("j"))))).alias("m")).select(
        "session_id", F.transform_values("m", lambda _, j: F.from_json(j, "map<string,bigint>")).alias("entities")
    )


def top_entities(entities: DataFrame, per_kind: int = 8) -> DataFrame:
    """The most frequent of each session and kind, with their rank."""
    order = W.partitionBy("session_id", "kind").orderBy(F.desc("n"), "text")
    return entity_counts(entities).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_kind)


def speaker_totals(lines: DataFrame) -> DataFrame:
    """Lines, seconds (two digits), mean compound and share of the session's rounded seconds, most talkative first."""
    named = lines.where(F.trim(F.coalesce("speaker", F.lit(""))) != "")
    out = named.groupBy("session_id", "speaker").agg(F.count("*").alias("lines"), F.round(F.sum("audio_seconds"), 2).alias("seconds"), F.avg("compound").alias("average_sentiment"))
    total = F.sum("seconds").over(W.partitionBy("session_id"))
    rank = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("seconds"), "speaker"))
    return out.withColumn("share", F.when(total > 0, F.col("seconds") / total).otherwise(0.0)).withColumn("rank", rank)


def session_metrics(lines: DataFrame, actions: DataFrame, topics: DataFrame) -> DataFrame:
    """metrics() with topic_shifts and uptime, the seconds from a session's first start to its last end."""
    t = topics.groupBy("session_id").agg(F.count("*").alias("topic_shifts"))
    up = lines.groupBy("session_id").agg((F.max("ended_at") - F.min("started_at")).alias("uptime"))
    out = metrics(lines, actions).join(up, "session_id").join(t, "session_id", "left")
    return out.withColumn("topic_shifts", F.coalesce("topic_shifts", F.lit(0)))


def failure_counts(failures: DataFrame, recent: int = 50) -> tuple[DataFrame, DataFrame]:
    """failures (component, message, at): how many each component had, and the newest ones."""
    newest = failures.orderBy(F.desc("at"), "component", "message").limit(recent)
    return failures.groupBy("component").agg(F.count("*").alias("failures"), F.max("at").alias("last_at")), newest


def engine_stats(analysed: DataFrame) -> DataFrame:
    """One row over the rows of analyse(): lines, actions, entities, lines in a language that is not served, lines
    judged by their translation, and the means a line."""
    n = F.count("*")
    return analysed.agg(
        n.alias("processed"), F.sum(F.size("extractions")).alias("extractions"), F.sum(F.size("entities")).alias("entities"),
        F.count_if(F.col("subject").isNull()).alias("skipped_language"), F.count_if(F.col("via_translation")).alias("via_translation"),
        F.try_divide(F.sum(F.size("extractions")), n).alias("extractions_a_line"), F.try_divide(F.sum(F.size("entities")), n).alias("entities_a_line"),
    )
