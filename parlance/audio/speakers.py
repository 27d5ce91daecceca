"""Who speaks: nearest known voice, and voices told apart as they come."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Known voices that one row may hold; they are counted before.
MAX_PROFILES = 10_000
PROFILES = "label string, centroid array<float>, segments int, total_seconds double"


def nearest(vectors: DataFrame, profiles: DataFrame) -> DataFrame:
    """vectors (embedding) with label, similarity and runner_up: the profile (label, centroid) of the largest dot
    product, the smallest label of equals, and the next one's product (0 without one). At most MAX_PROFILES profiles
    travel, as one row, to all vectors."""
    if profiles.count() > MAX_PROFILES:
        raise ValueError(f"more than {MAX_PROFILES} profiles")
    whole = profiles.agg(F.array_sort(F.collect_list(F.struct("label", "centroid"))).alias("_known"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    scored = F.transform("_known", lambda p: F.struct((-dot(p["centroid"], F.col("embedding"))).alias("less"), p["label"].alias("label")))
    out = vectors.join(F.broadcast(whole)).withColumn("_best", F.slice(F.array_sort(scored), 1, 2))
    best, second = F.get("_best", F.lit(0)), F.get("_best", F.lit(1))
    return out.select(*vectors.columns, best["label"].alias("label"), (-best["less"]).alias("similarity"), F.coalesce(-second["less"], F.lit(0.0)).alias("runner_up"))


@dataclass
class Tracker:
    """Voices of one session. A vector that is unlike all of them is a new one, while there is room; else the nearest
    takes it and moves towards it."""

    threshold: float = 0.72
    room: int = 8
    rate: float = 0.25
    names: list[str] = field(default_factory=list)
    centroids: list[np.ndarray] = field(default_factory=list)

    def assign(self, vector: np.ndarray) -> tuple[str, float, bool, float]:
        """label, similarity, is_new, confidence (twice the lead over the next voice, at most 1)."""
        v = np.asarray(vector, np.float32)
        products = np.array([float(c @ v) for c in self.centroids])
        order = np.argsort(-products, kind="stable")
        best = products[order[0]] if len(order) else 0.0
        if not len(order) or (best < self.threshold and len(order) < self.room):
            name = self._name()
            self.names.append(name)
            self.centroids.append(v.copy())
            return name, float(best), True, 1.0
        i = int(order[0])
        self.centroids[i] = blend(self.centroids[i], v, self.rate)
        second = products[order[1]] if len(order) > 1 else 0.0
        return self.names[i], float(best), False, float(np.clip(2 * (best - second if second > 0 else best), 0, 1))


    def _name(self) -> str:
        """The next letter that no voice has, also where known voices came first."""
        letters = [chr(ord("A") + (len(self.names) + i) % 26) for i in range(26)]
        return next((n for n in map("Speaker {}".format, letters) if n not in self.names), f"Speaker {letters[0]}")

    def hear(self, vector) -> tuple[str | None, float, bool, float, list[float] | None]:
        """assign(), and the voice as it is after that; nothing for a row without a vector."""
        if vector is None:
            return None, 0.0, False, 0.0, None
        found = self.assign(vector)
        return *found, self.centroids[self.names.index(found[0])].tolist()


HEARD = "speaker string, similarity double, is_new boolean, confidence double, centroid array<float>"


def known_voices(profiles: DataFrame | None) -> list[tuple[str, list[float]]]:
    """label and centroid of at most MAX_PROFILES profiles, by label: what every session starts with."""
    rows = [] if profiles is None else profiles.select("label", "centroid").orderBy("label").limit(MAX_PROFILES + 1).collect()
    if len(rows) > MAX_PROFILES:
        raise ValueError(f"more than {MAX_PROFILES} profiles")
    return [(r.label, list(r.centroid)) for r in rows]


def tracker(known: list[tuple[str, list[float]]], threshold: float, room: int, rate: float) -> Tracker:
    return Tracker(threshold, room, rate, [n for n, _ in known], [np.asarray(c, np.float32) for _, c in known])


def blend(centroid: np.ndarray, vector: np.ndarray, rate: float) -> np.ndarray:
    both = (1 - rate) * centroid + rate * vector
    size = np.linalg.norm(both)
    return (both / size).astype(np.float32) if size > 0 else centroid


def clusters(vectors: DataFrame, threshold: float = 0.72, room: int = 8, rate: float = 0.25, profiles: DataFrame | None = None, moved: bool = False) -> DataFrame:
    """vectors (session_id, seq, embedding) -> session_id, seq, speaker, similarity, is_new, confidence, told apart in
    order; a row without a vector has no speaker. Every session starts with the voices of profiles, which count towards
    `room`. With moved also centroid, the speaker's voice after the row. A task keeps the voices of one session."""
    kind = dict(vectors.dtypes)["session_id"]
    known = known_voices(profiles)
    names = ["session_id", "seq", *[c.split()[0] for c in HEARD.split(", ")]]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, voices = object(), None
        for part in batches:
            out = []
            for key, seq, v in zip(part["session_id"], part["seq"], part["embedding"], strict=True):
                if key != session:
                    session, voices = key, tracker(known, threshold, room, rate)
                out.append((key, seq, *voices.hear(v)))
            yield pd.DataFrame(out, columns=names)

    ordered = vectors.select("session_id", F.col("seq").cast("int"), "embedding").repartition("session_id").sortWithinPartitions("session_id", "seq")
    told = ordered.mapInPandas(run, f"session_id {kind}, seq int, {HEARD}")
    return told if moved else told.drop("centroid")


def voices(heard: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """session_id and PROFILES from rows with session_id, seq, speaker, centroid and seconds: each voice as its last row
    left it, with the segments and seconds of the profile it started from added."""
    out = heard.where("speaker is not null").groupBy("session_id", F.col("speaker").alias("label")).agg(
        F.max_by("centroid", "seq").alias("centroid"), F.count("*").cast("int").alias("segments"), F.coalesce(F.sum("seconds"), F.lit(0.0)).cast("double").alias("total_seconds")
    )
    if profiles is None:
        return out
    before = profiles.select("label", F.col("segments").alias("_n"), F.col("total_seconds").alias("_s"))
    more = lambda c, old, none: (F.col(c) + F.coalesce(old, F.lit(none))).alias(c)
    return out.join(before, "label", "left").select("session_id", "label", "centroid", more("segments", "_n", 0), more("total_seconds", "_s", 0.0))


def save_profiles(profiles: DataFrame, path: str) -> None:
    profiles.write.mode("overwrite").json(path)


def load_profiles(spark: SparkSession, path: str) -> DataFrame:
    """PROFILES from JSON lines; lines that cannot be read, or that have no label or centroid, are left out."""
    return spark.read.schema(PROFILES).option("mode", "DROPMALFORMED").json(path).where("label is not null and size(centroid) > 0")
