"""Recordings and speakers over a stream: the rows of one batch, with lost, late and repeated blocks, and after a restart."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance import streaming
from parlance.audio import segments, signal, speakers
from parlance.streaming import voices

RATE = signal.RATE
BLOCKS = "stream_id string, block_no int, samples array<float>, last boolean, at timestamp"
START = datetime.datetime(2024, 5, 1, 10)


def recording(seed):
    rng = np.random.default_rng(seed)
    quiet = lambda s: rng.normal(0, 2e-4, int(s * RATE)).astype(np.float32)
    both = signal.two_voices()
    return np.concatenate([quiet(1), both, quiet(1), both[: 2 * RATE], quiet(1), both[-2 * RATE :]])


def blocks_of(name, samples, size=4000):
    return [(name, i, [float(x) for x in samples[k : k + size]], False, START + datetime.timedelta(seconds=k / RATE)) for i, k in enumerate(range(0, len(samples), size))]


def told(rows):
    return sorted((r.stream_id, r.n, r.reason, round(r.started_at, 6), r.k) for r in rows)


def test_stream_without_an_end_gives_the_rows_of_a_batch(spark, tmp_path):
    rng = random.Random(5)
    sent = []
    for name, seed in (("a", 1), ("b", 2)):
        sent += [b for b in blocks_of(name, recording(seed)) if b[1] not in (7, 30)]  # two blocks are lost
    whole = spark.createDataFrame(sent + [sent[3], sent[-4]], BLOCKS)
    size = F.size("samples").alias("k")
    wanted = told(segments.segments(whole, voices=True).select("*", size).collect())
    assert any(r[2] == "speaker_change" for r in wanted) and any(r[2] == "flush" for r in wanted)
    parts = [sent[i::2] + [sent[3]] for i in (0, 1)]  # each batch has gaps that the next one fills, and a repeat
    late = [("tick", 0, [], True, START + datetime.timedelta(hours=1)), ("tock", 0, [], True, START + datetime.timedelta(hours=2))]
    for k, part in enumerate([*parts, late[:1], late[1:]]):
        rng.shuffle(part)
        spark.createDataFrame(part, BLOCKS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = []
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    made = segments.streamed(stream, voices=True, idle=30.0, late=60.0).select("*", size)
    streaming.sink(made, lambda rows, _: got.extend(rows.collect()), f"{tmp_path}/check").awaitTermination()
    assert told(got) == wanted


def test_a_missing_block_is_given_up_and_late_ones_are_dropped():
    order = segments.Reordered(segments.Segmenter(), patience=3)
    for no in (0, 2, 3, 4):
        order.put(no, [0.0] * 480, False)
    list(order.ready())
    assert order.following == 1 and len(order.waiting) == 3
    order.put(5, None, False)
    list(order.ready())
    assert order.following == 6 and not order.waiting
    order.put(1, [0.0], False)
    order.put(5, [0.0], False)
    assert not order.waiting
    order.put(7, [], True)
    list(order.ready())
    assert not order.ended
    list(order.ready(all_of_them=True))
    assert order.ended


VECTORS = "session_id string, seq int, embedding array<float>, seconds double, at timestamp"


def unit(rng, near=None, noise=0.08):
    v = rng.normal(size=26) if near is None else near + rng.normal(size=26) * noise
    return v / np.linalg.norm(v)


@pytest.fixture(scope="module")
def heard(spark):
    rng = np.random.default_rng(3)
    people = [unit(rng) for _ in range(5)]
    rows = []
    for name in ("s", "t"):
        for i in range(60):
            v = None if i % 17 == 5 else [float(x) for x in unit(rng, people[rng.integers(5)])]
            rows.append((name, i, v, 1.5, START + datetime.timedelta(seconds=i)))
    known = spark.createDataFrame([("Ann", [float(x) for x in people[0]], 4, 10.0), ("Speaker C", [float(x) for x in people[1]], 1, 2.0)], speakers.PROFILES)
    return rows, known


def test_profiles_lead_and_go_on(spark, heard, tmp_path):
    rows, known = heard
    out = speakers.clusters(spark.createDataFrame(rows, VECTORS), profiles=known, moved=True).cache()
    labels = {r.speaker for r in out.collect()}
    assert {"Ann", "Speaker C", None} <= labels and len(labels) == 6  # five voices; the new ones take other letters
    made = speakers.voices(out.withColumn("seconds", F.lit(1.5)), known).where("session_id = 's'").drop("session_id")
    ann = made.where("label = 'Ann'").first()
    assert ann.segments == 4 + out.where("session_id = 's' and speaker = 'Ann'").count() and ann.total_seconds == 10.0 + 1.5 * (ann.segments - 4)
    speakers.save_profiles(made, f"{tmp_path}/p")
    again = speakers.clusters(spark.createDataFrame(rows, VECTORS), profiles=speakers.load_profiles(spark, f"{tmp_path}/p"))
    assert {r.speaker for r in again.collect()} == labels and again.where("is_new").count() == 0


@pytest.mark.parametrize("cut", [1, 4])
def test_speakers_over_batches_and_a_restart(spark, heard, tmp_path, cut):
    rows, known = heard
    frame = spark.createDataFrame(rows, VECTORS)
    wanted = speakers.clusters(frame, profiles=known, moved=True).orderBy("session_id", "seq").collect()
    got = []
    for k in range(cut):
        part = [r for r in rows if r[1] * cut // 60 == k][::-1]
        spark.createDataFrame(part, VECTORS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in")  # a new query over the same state
        made = voices.clusters_stream(stream, profiles=known)
        assert made.columns == [*frame.columns, "speaker", "similarity", "is_new", "confidence", "centroid"]
        streaming.sink(made, lambda b, _: got.extend(b.collect()), f"{tmp_path}/check").awaitTermination()
    got.sort(key=lambda r: (r.session_id, r.seq))
    assert [(r.session_id, r.seq, r.speaker, r.similarity, r.is_new, r.confidence, r.centroid) for r in got] == [tuple(r) for r in wanted]
