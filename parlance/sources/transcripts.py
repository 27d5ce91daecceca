"""Transcript sources. The order of a session's lines is (session_id, seq)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: A transcript made from orders; the same text runs in both engines once STRING is spelled as there.
TEMPLATED = """
SELECT CAST(o_custkey % 50 AS BIGINT) AS session_id,
       CAST(row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderdate, o_orderkey) AS INT) AS seq,
       CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN 'Speaker A' WHEN 1 THEN 'Speaker B' ELSE 'Speaker C' END AS speaker,
       CASE CAST(o_orderkey % 8 AS INT)
         WHEN 0 THEN concat('Remind me to send order ', CAST(o_orderkey AS STRING), ' to Sarah Chen.')
         WHEN 1 THEN concat('The deadline is Friday and I am worried about order ', CAST(o_orderkey AS STRING), '.')
         WHEN 2 THEN 'I am blocked on the audio driver, it crashes constantly.'
         WHEN 3 THEN 'Great news, the rewrite landed and it feels fantastic!'
         WHEN 4 THEN concat('We decided to ship the ', lower(o_orderpriority), ' queue first.')
         WHEN 5 THEN 'Can you follow up with legal before end of week?'
         WHEN 6 THEN concat('Email Priya Nair at p', CAST(o_custkey AS STRING), '@northwind.com about latency, not good.')
         ELSE 'La fecha del informe es muy importante para todo el equipo.' END AS text,
       CAST(o_totalprice / 10000.0 AS DOUBLE) AS audio_seconds,
       o_orderkey AS line_id
FROM orders"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def templated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, seq, speaker, text, audio_seconds, line_id."""
    return spark.sql(TEMPLATED.replace("FROM orders", "FROM {orders}"), orders=read(spark, sf_dir, "orders"))


def timed(lines: DataFrame) -> DataFrame:
    """started_at and ended_at from the running sum of audio_seconds; started_at is pulled in so that lines overlap."""
    before = W.partitionBy("session_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum("audio_seconds").over(before), F.lit(0.0))
    return lines.withColumn("started_at", start * 0.9).withColumn("ended_at", start + F.col("audio_seconds"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"), (F.col("turn") + 1).cast("int").alias("seq"), F.col("role").alias("speaker"), "text"
    )


def sessions(lines: DataFrame) -> DataFrame:
    """id, name and times of the sessions in lines of timed()."""
    return lines.groupBy("session_id").agg(F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at")).select(
        "session_id", F.concat(F.lit("Session "), F.col("session_id").cast("string")).alias("name"), "started_at", "ended_at"
    )


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files as transcripts, a session for each file, blank lines left out. A file is one row as it is
    read, so that its lines keep their order wherever they are dealt."""
    files = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("session_id"), "value")
    lines = files.select("session_id", F.posexplode(F.split("value", r"\r\n|[\r\n]")).alias("at", "text")).where(F.trim("text") != "")
    order = W.partitionBy("session_id").orderBy("at")
    return lines.select("session_id", F.row_number().over(order).cast("int").alias("seq"), F.trim("text").alias("text"))
