"""The registered queries and their SQL, and what the query modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parlance.operators.scratch import workspace  # noqa: F401  (the query modules take it from here)
from parlance.sources import transcripts as src

QUERIES: dict = {}
SQL: dict[str, str] = {}

_LINES = "WITH lines AS (" + src.TEMPLATED.replace("AS STRING", "AS VARCHAR") + ")"
_TIMED = (
    _LINES
    + """, timed AS (SELECT *, before * 0.9 AS started_at, before + audio_seconds AS ended_at FROM (
  SELECT *, coalesce(sum(audio_seconds) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before FROM lines))"""
)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.templated(spark, sf_dir)
