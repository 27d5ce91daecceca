"""Speakers told apart over the batches of a stream: a session's voices are kept as state."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from parlance.audio import speakers
from parlance.streaming.carried import _fold, _packed, _unpacked


def clusters_stream(vectors: DataFrame, threshold: float = 0.72, room: int = 8, rate: float = 0.25, profiles: DataFrame | None = None) -> DataFrame:
    """vectors (session_id, seq, embedding, and more) with speaker, similarity, is_new, confidence and centroid: the rows
    of speakers.clusters(moved=True) however a session is cut into batches, also after a restart.

    The rows of a session come in the order of seq from batch to batch, in any order within one. The state of a session
    is `room` voices, or as many as there are profiles; profiles are read when the stream is started, and a session that
    has begun keeps its own voices. speakers.voices() makes profiles of the rows.
    """
    known = speakers.known_voices(profiles)
    names = [c.split()[0] for c in speakers.HEARD.split(", ")]

    def step(rows: pd.DataFrame, held):
        start = known if held is None else list(zip(held[0], held[1], strict=True))
        voices = speakers.tracker(start, threshold, room, rate)
        heard = [voices.hear(None if v is None else np.asarray(v, np.float32)) for v in rows["embedding"]]
        columns = dict(zip(names, map(list, zip(*heard, strict=True)), strict=True))
        return columns, (list(voices.names), [c.tolist() for c in voices.centroids])

    slim = _packed(vectors).select("session_id", "seq", "packed", "embedding")
    return _unpacked(_fold(slim, step, speakers.HEARD, "names array<string>, centroids array<array<float>>"), vectors.schema)
