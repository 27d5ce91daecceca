"""Signals, segments in batch and as a stream, and speakers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance import streaming
from parlance.audio import segments, signal, speakers

RATE = signal.RATE


def speech(seconds, pitch=140.0):
    t = np.arange(int(seconds * RATE)) / RATE
    return (0.2 * sum(np.sin(2 * np.pi * pitch * k * t) / k for k in range(1, 9))).astype(np.float32)


def silence(seconds):
    return (1e-4 * np.random.default_rng(1).standard_normal(int(seconds * RATE))).astype(np.float32)


def talk():
    return np.concatenate([silence(1), speech(2), silence(1), speech(0.3), silence(1), speech(14), silence(0.7), speech(1.5)])


def test_segments_open_and_close():
    machine = segments.Segmenter()
    found = [*machine.push(talk())]
    last = machine.flush()
    found += [last]
    assert [s["reason"] for s in found] == ["silence", "max_length", "silence", "flush"] and [s["n"] for s in found] == [0, 1, 2, 3]
    assert all(s["is_final"] for s in found) and math.isclose(found[0]["started_at"], 1 - 0.24, abs_tol=0.04)
    assert math.isclose(len(found[1]["samples"]) / RATE, 12.0, abs_tol=0.03)
    for s in found:
        assert math.isclose(s["ended_at"] - s["started_at"], len(s["samples"]) / RATE, abs_tol=1e-6)


def test_blocks_of_any_size_give_the_same():
    whole = [*segments.Segmenter().push(talk())]
    machine, parts, at = segments.Segmenter(), [], 0
    for n in np.random.default_rng(2).integers(1, 3_000, 500):
        parts += machine.push(talk()[at : at + n])
        at += n
    assert [(s["n"], s["reason"], len(s["samples"])) for s in parts] == [(s["n"], s["reason"], len(s["samples"])) for s in whole]


def test_noise_and_partials():
    noise = (0.1 * np.random.default_rng(3).standard_normal(3 * RATE)).astype(np.float32)
    assert not [*segments.Segmenter().push(noise)]
    gate = segments.Gate(partials=True)
    found = [*segments.Segmenter(gate).push(np.concatenate([speech(6), silence(1)]))]
    assert [s["is_final"] for s in found].count(False) >= 2 and found[-1]["is_final"] and {s["n"] for s in found} == {0}


def blocks(streams):
    rows = []
    for name, samples in streams.items():
        cut = np.array_split(samples, 23)
        rows += [(name, i, [float(x) for x in c], i == len(cut) - 1) for i, c in enumerate(cut)]
    return rows


def test_batch_and_stream_agree(spark, tmp_path):
    rows = blocks({"a": talk(), "b": np.concatenate([speech(2, 200.0), silence(1)]), "c": silence(1)})
    frame = spark.createDataFrame(rows, "stream_id string, block_no int, samples array<float>, last boolean")
    batch = segments.segments(frame).select("stream_id", "n", "reason", F.size("samples").alias("k")).collect()
    frame.repartition(5).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = []
    query = streaming.sink(segments.streamed(stream), lambda rows, _: got.extend(rows.select("stream_id", "n", "reason", F.size("samples").alias("k")).collect()), f"{tmp_path}/check")
    query.awaitTermination()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch)) and len(batch) == 5


def test_voices(spark):
    both = signal.two_voices()
    half = len(both) // 2
    at = signal.change_point(both)
    assert at is not None and abs(at - half) < 0.3 * RATE
    parts = segments.split_voices({"n": 0, "started_at": 1.0, "ended_at": 1 + len(both) / RATE, "reason": "silence", "samples": both, "is_final": True})
    assert [p["reason"] for p in parts] == ["speaker_change", "silence"] and parts[0]["ended_at"] == parts[1]["started_at"]
    assert signal.change_point(both[:half]) is None
    a, b = signal.embedding(both[:half]), signal.embedding(both[half:])
    assert len(a) == 26 and math.isclose(float(a @ a), 1, abs_tol=1e-5) and float(a @ b) < 0.72
    assert signal.embedding(both[:300]) is None
    rows = [("s", i, [float(x) for x in v] if v is not None else None) for i, v in enumerate([a, b, None, a, b, b])] + [("t", 1, [float(x) for x in b])]
    got = speakers.clusters(spark.createDataFrame(rows, "session_id string, seq int, embedding array<float>")).orderBy("session_id", "seq").collect()
    assert [r.speaker for r in got] == ["Speaker A", "Speaker B", None, "Speaker A", "Speaker B", "Speaker B", "Speaker A"]
    assert [r.is_new for r in got] == [True, True, False, False, False, False, True]


def test_profiles(spark, tmp_path):
    rows = [("x", [1.0, 0.0], 1, 2.0), ("y", [0.0, 1.0], 1, 2.0)]
    made = spark.createDataFrame(rows, speakers.PROFILES)
    speakers.save_profiles(made, f"{tmp_path}/p")
    (tmp_path / "p" / "bad.json").write_text('{"label": 1, "centroid": "no"}\nnot json\n')
    known = speakers.load_profiles(spark, f"{tmp_path}/p")
    assert known.count() == 2
    got = speakers.nearest(spark.createDataFrame([(1, [0.6, 0.8]), (2, [1.0, 0.0])], "i int, embedding array<float>"), known).orderBy("i").collect()
    assert [r.label for r in got] == ["y", "x"] and got[0].runner_up == pytest.approx(0.6)
    assert speakers.Tracker(room=1).assign(np.ones(2)) and np.allclose(speakers.blend(np.zeros(2), np.zeros(2), 0.5), 0)


def test_partials_and_finals(spark):
    rows = [("s", 1, "he", False), ("s", 2, "hello", True), ("t", 1, "wa", False), ("t", 2, "wait", False), ("u", 1, "", True)]
    frame = spark.createDataFrame(rows, "session_id string, at int, text string, is_final boolean")
    assert [r.text for r in streaming.finals(frame).collect()] == ["hello"]
    assert [tuple(r) for r in streaming.latest_partial(frame).collect()] == [("t", "wait")]
    assert streaming.shed(frame, F.lit(1), F.lit(0.1)).count() == 2 and streaming.shed(frame, F.lit(0), F.lit(0.5)).count() == 5
