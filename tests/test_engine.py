"""Settings, plug-ins, the batch runner, the engine and the command line."""

import io
import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance import batch, cli, config, engine, plugins
from parlance.audio import signal
from parlance.operators import analyse, store
from parlance.sources import recordings, transcripts


def test_settings(tmp_path):
    settings, unknown = config.from_dict({"audio": {"rate": 8000, "colour": 1}, "extra": {}, "privacy": {"mode": "mask"}})
    assert settings.audio.rate == 8000 and settings.privacy.mode == "mask" and settings.speakers.room == 8
    assert unknown == ["audio.colour", "extra"] and not config.problems(settings)
    settings.segments.least, settings.privacy.kinds, settings.export.formats = 20, ["shoe"], ["pdf"]
    assert len(config.problems(settings)) == 3
    config.save(config.Settings(), f"{tmp_path}/c.json")
    assert config.load(f"{tmp_path}/c.json") == config.Settings() == config.load(f"{tmp_path}/none.json")
    with pytest.raises(ValueError):
        (tmp_path / "bad.json").write_text("{")
        config.load(f"{tmp_path}/bad.json")


def test_plugins(spark):
    assert plugins.available(plugins.RECOGNISERS)["none"] == "ready"

    @plugins.recogniser("broken", 99)
    def broken():
        raise RuntimeError("no model here")

    try:
        assert plugins.available(plugins.RECOGNISERS)["broken"] == "no model here"
        assert plugins.chosen(plugins.RECOGNISERS)()(np.zeros(3), 16000) == ""
        with pytest.raises(ValueError):
            plugins.chosen(plugins.RECOGNISERS, "nobody")
    finally:
        del plugins.RECOGNISERS["broken"]
    words = plugins.translate(plugins.dictionary({("nl", "en"): {"goed": "good", "nieuws": "news"}}))
    rows = [("goed nieuws", "nl", "en"), ("goed", "en", "en"), ("", "nl", "en"), (None, "nl", "en"), ("goed", "nl", "fr")]
    frame = spark.createDataFrame(rows, "t string, a string, b string")
    assert [r[0] for r in frame.select(words(F.col("t"), F.col("a"), F.col("b"))).collect()] == ["good news", None, None, None, None]


def test_analysis_by_translation(spark):
    dutch = "ik heb goed nieuws maar niet voor vandaag en morgen"
    frame = spark.createDataFrame([("s", 1, dutch), ("s", 2, dutch), ("s", 3, None)], "session_id string, seq int, text string")
    words = plugins.translate(plugins.dictionary({("nl", "en"): {"goed": "good", "nieuws": "news", "niet": "not"}}))
    plain = analyse.analyse(frame).orderBy("seq").collect()
    assert plain[1].current == "nl" and plain[1].subject is None and plain[1].sentiment is None and plain[1].extractions == []
    done = analyse.analyse(frame, translator=words).orderBy("seq").collect()
    assert done[1].via_translation and "good" in done[1].subject and done[1].sentiment.compound > 0
    assert store.engine_stats(analyse.analyse(frame, translator=words)).first().via_translation >= 2
    off = analyse.analyse(frame, analyse.Toggles(False, False, False, False, False, False)).collect()
    assert all(r.extractions == [] and r.entities == [] and r.sentiment is None and not r.topic_shift for r in off)


def test_topic_shifts_cost_nothing_unless_asked_for(spark):
    said = ["alpha beta gamma delta epsilon"] * 6 + ["kilo lima mike november oscar"] * 6
    done = analyse.analyse(spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(said)], "session_id long, seq int, text string"))
    assert [r.seq for r in done.where("topic_shift").orderBy("seq").collect()] == [9]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan(done) and "Join" not in plan(done.select("session_id", "seq", "current", "sentiment", "entities"))


def wav(samples, width=2):
    raw = io.BytesIO()
    with wave.open(raw, "wb") as f:
        f.setnchannels(1), f.setsampwidth(width), f.setframerate(16_000)
        f.writeframes((samples * 32_000).astype("<i2").tobytes())
    return raw.getvalue()


def test_batch_runner(spark, tmp_path):
    both = signal.two_voices()
    quiet = np.zeros(16_000, np.float32)
    folder = tmp_path / "in" / "deep"
    folder.mkdir(parents=True)
    (folder / "a.WAV").write_bytes(wav(np.concatenate([quiet, both, quiet])))
    (folder.parent / "bad.wav").write_bytes(b"not a recording")
    (folder.parent / "other.txt").write_text("no")
    speak = plugins.scripted(["Remind me to call Sarah Chen."])
    first = {r.path.rsplit("/", 1)[1]: r for r in batch.run_folder(spark, str(tmp_path / "in"), f"{tmp_path}/out", speak).collect()}
    assert first["a.WAV"].status == "done" and first["a.WAV"].lines == 2 and first["bad.wav"].status == "failed" and first["bad.wav"].error
    again = {r.path.rsplit("/", 1)[1]: r.status for r in batch.run_folder(spark, str(tmp_path / "in"), f"{tmp_path}/out", speak).collect()}
    assert again == {"a.WAV": "skipped", "bad.wav": "failed"}
    third = {r.path.rsplit("/", 1)[1]: r.status for r in batch.run_folder(spark, str(tmp_path / "in"), f"{tmp_path}/out", speak).collect()}
    assert third == again  # done once is done for good
    assert recordings.discover(spark, f"{tmp_path}/nowhere").count() == 0
    assert recordings.discover(spark, str(folder / "a.WAV")).count() == 1
    job = batch.run(recordings.discover(spark, str(folder)), speak)
    assert sorted(r.speaker for r in job.lines.collect()) == ["Speaker A", "Speaker B"]


def test_text_lines_keep_their_order(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.txt").write_text("\n".join(["", *(f"line {name} {i}" for i in range(500)), " "]))
    got = transcripts.text_lines(spark, str(tmp_path)).orderBy("session_id", "seq").collect()
    assert [r.text for r in got] == [f"line {n} {i}" for n in "ab" for i in range(500)] and got[499].seq == 500


def test_engine(spark, tmp_path):
    settings = config.Settings()
    settings.store.folder = f"{tmp_path}/db"
    settings.privacy.redact_at_source = True
    e = engine.Engine(spark, settings)
    seen = []
    e.subscribe("transcript", lambda rows: seen.append(rows.count()))
    e.subscribe("transcript", lambda rows: 1 / 0)
    e.subscribe("actions", lambda rows: seen.append(rows.count()))
    lines = spark.createDataFrame([("s", 1, "Remind me to call Sarah Chen."), ("s", 2, "Great!")], "session_id string, seq int, text string")
    for _ in range(2):  # a batch that comes again
        e.submit(lines, 7)
    assert seen == [2, 1, 2, 1] and len(e.failures) == 2
    assert e.stored("transcript").count() == 2 and e.stored("action_items").first().text == "call [PERSON_1]"
    assert "Chen" not in json.dumps([r.asDict() for r in e.stored("transcript").select("text").collect()])
    lines.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(lines.schema).parquet(f"{tmp_path}/in")
    e.follow(stream, f"{tmp_path}/check").awaitTermination()
    assert e.stored("transcript").count() == 4
    settings.segments.ratio = 0
    with pytest.raises(ValueError):
        engine.Engine(spark, settings)


@pytest.mark.parametrize(
    "argv, code, said",
    [
        (["demo"], 0, "## Summary"), (["digest"], 0, "## Key topics"), (["sessions"], 0, "Session demo"), (["actions"], 0, "blocker"),
        (["review"], 0, "Still open"), (["search", "dead"], 0, "«deadline»"), (["search", "zebra"], 1, ""), (["redact", "I am Dr Jane Roe"], 0, "[PERSON_1]"),
        (["translate", "hi", "en", "fr"], 1, "hi"), (["pairs"], 0, "identity"), (["selftest"], 0, "pass\tsearches"),
    ],
)
def test_commands(spark, capsys, argv, code, said):
    assert cli.main(argv) == code
    assert said in capsys.readouterr().out


def test_commands_that_write(spark, tmp_path, capsys):
    assert cli.main(["init", f"{tmp_path}/c.json"]) == 0 and cli.main(["validate", f"{tmp_path}/c.json"]) == 0
    (tmp_path / "d.json").write_text('{"audio": {"rate": 1}}')
    assert cli.main(["validate", f"{tmp_path}/d.json"]) == 1
    for form in ("srt", "vtt", "txt", "md", "json"):
        assert cli.main(["export", form, f"{tmp_path}/out"]) == 0
    texts = ["".join(p.read_text() for p in (tmp_path / "out" / f).rglob("part-*.txt")) for f in ("srt", "vtt", "md", "json")]
    assert texts[0].startswith("1\n00:00:00,000 --> ") and texts[1].startswith("WEBVTT\n\n") and "## Transcript" in texts[2] and json.loads(texts[3])["transcript"]
