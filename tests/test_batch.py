"""A folder of recordings: each segment is recognised once, a second run does what is left."""

import wave

import numpy as np

from parlance import batch
from parlance.audio import signal


def save(path, samples):
    with wave.open(str(path), "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(signal.RATE)
        f.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())


def test_one_recognition_a_segment_and_resume(spark, tmp_path):
    (tmp_path / "in").mkdir()
    quiet = np.random.default_rng(1).normal(0, 2e-4, signal.RATE).astype(np.float32)
    whole = np.concatenate([quiet, signal.two_voices(), quiet])
    save(tmp_path / "in" / "a.wav", whole)
    (tmp_path / "in" / "bad.wav").write_bytes(b"no sound")
    calls, folder, out = tmp_path / "calls", str(tmp_path / "in"), str(tmp_path / "out")

    def factory(calls=str(calls)):
        def speak(samples, rate):
            with open(calls, "a") as f:
                f.write(".")
            return "Remind me to call Sarah Chen."

        return speak

    first = {r.path.rsplit("/", 1)[-1]: r for r in batch.run_folder(spark, folder, out, factory).collect()}
    assert first["a.wav"].status == "done" and first["bad.wav"].status == "failed" and first["bad.wav"].error
    assert len(calls.read_text()) == first["a.wav"].segments == first["a.wav"].lines > 0
    save(tmp_path / "in" / "bad.wav", whole)
    before = len(calls.read_text())
    second = {r.path.rsplit("/", 1)[-1]: r for r in batch.run_folder(spark, folder, out, factory).collect()}
    assert second["a.wav"].status == "skipped" and second["bad.wav"].status == "done"
    assert len(calls.read_text()) - before == second["bad.wav"].segments
    kept = batch.load_manifest(spark, f"{out}/manifest").collect()
    assert sorted((r.path.rsplit("/", 1)[-1], r.status) for r in kept) == [("a.wav", "done"), ("bad.wav", "done")]
    assert len(list((tmp_path / "out" / "srt").glob("session_id=*"))) == 2  # the second run leaves the first one's
