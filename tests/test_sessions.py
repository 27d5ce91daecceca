"""A stream of lines gives the analysis of whole sessions, however the sessions are cut into batches."""

import random

import pytest
from pyspark.sql import functions as F

from parlance import config, engine, plugins
from parlance.operators import analyse, store
from parlance.streaming import carried

SAID = [
    "I love this great plan, wonderful work", "This is a terrible and awful problem", "", "Remind me to call Sarah Chen by Friday.", None,
    "el presupuesto es muy bueno para todo el equipo y los clientes", "pero no hay tiempo para esto porque todo está muy mal", "okay",
    "the budget and the invoice for the finance team", "the budget review with finance and the invoice again", "finance wants the invoice budget numbers",
    "kubernetes cluster deploy pipeline broken again", "deploy pipeline cluster kubernetes rollout", "the cluster rollout pipeline and deploy",
    "ik heb goed nieuws maar niet voor vandaag en morgen", "die Arbeit ist heute sehr gut und wir sind immer bereit",
]
SCHEMA = "session_id string, seq int, text string, started_at double, spans array<struct<start:double,text:string>>, at timestamp, n long"


def rows(seed):
    import datetime

    rng = random.Random(seed)
    at = datetime.datetime(2024, 5, 1, 10, 0, 0, 123456)
    out = []
    for name in ("a", "b", "Ω"):
        said = [t for t in SAID for _ in range(3)]
        rng.shuffle(said) if name != "a" else None
        out += [(name, i + 1, t, i * 0.1, [(0.5, "x")] if i % 2 else None, at, None if i % 3 else 2**60 + i) for i, t in enumerate(said)]
    return out


def translator():
    return plugins.translate(plugins.dictionary({("nl", "en"): {"goed": "good", "nieuws": "news", "niet": "not"}}))


@pytest.mark.parametrize("toggles", [analyse.Toggles(), analyse.Toggles(language=False, rules=False, sentiment=False), analyse.Toggles(topics=False, entities=False)])
def test_any_cut_gives_the_rows_of_one_batch(spark, tmp_path, toggles):
    data = rows(1)
    whole = spark.createDataFrame(data, SCHEMA)
    wanted = analyse.analyse(whole, toggles, translator())
    expected = sorted(map(tuple, wanted.collect()), key=repr)
    assert not toggles.topics or not toggles.language or any(r[-1] for r in expected)
    for cut in (1, 7) if toggles.language and toggles.topics else (7,):
        rng, left, folder = random.Random(cut), list(data), tmp_path / f"in{cut}"
        for k in range(cut):
            size = len(left) if k == cut - 1 else rng.randint(1, len(left) // 2)
            ready = sorted(left, key=lambda r: (r[1] + 10 * ord(r[0][0]) % 17, r[0]))[:size]
            left = [r for r in left if r not in ready]
            spark.createDataFrame(ready, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        got = []
        out = carried.analyse_stream(stream, toggles, translator())
        assert out.dtypes == wanted.dtypes
        query = out.writeStream.foreachBatch(lambda df, i: got.extend(map(tuple, df.collect()))).option("checkpointLocation", f"{tmp_path}/check{cut}").trigger(availableNow=True).start()
        query.awaitTermination()
        assert len(got) == len(expected)
        unlike = [(a[:2], name, x, y) for a, b in zip(sorted(got, key=repr), expected) for name, x, y in zip(out.columns, a, b) if x != y]
        assert not unlike, unlike[:5]


def test_follow_goes_on_after_a_stop_and_analyses_once(spark, tmp_path):
    settings = config.Settings()
    settings.store.folder = f"{tmp_path}/db"
    calls = spark.sparkContext.accumulator(0)
    plain = translator()

    @F.udf("string")
    def counted(text, source, target):
        if text and source == "nl":
            calls.add(1)
        return None

    def spoken(text, source, target):
        return F.coalesce(counted(text, source, target), plain(text, source, target))

    data = [("s", i, SAID[14] if i > 4 else SAID[0]) for i in range(1, 21)]
    schema = "session_id string, seq int, text string"
    e = engine.Engine(spark, settings)
    e.translator = spoken
    seen = []
    e.subscribe("transcript", lambda r: seen.append(r.count()))
    e.subscribe("actions", lambda r: r.count())
    for part in (data[:9], data[9:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        e.follow(stream, f"{tmp_path}/check").awaitTermination()
    kept = e.stored("transcript").orderBy("seq").collect()
    once = analyse.analyse(spark.createDataFrame(data, schema), e.toggles(), translator()).orderBy("seq").collect()
    assert [(r.current, r.rolling, r.momentum, r.topic_shift) for r in kept] == [(r.current, r.rolling, r.momentum, r.topic_shift) for r in once]
    assert seen == [9, 11] and calls.value == sum(r.current == "nl" for r in once)


def test_half_a_batch_is_not_seen(spark, tmp_path):
    settings = config.Settings()
    settings.store.folder = f"{tmp_path}/db"
    e = engine.Engine(spark, settings)
    with pytest.raises(ValueError):
        e.stored("transcript")
    lines = spark.createDataFrame([("s", 1, "Remind me to call Sarah Chen.")], "session_id string, seq int, text string")
    e.submit(lines, 1)
    broken = analyse.analyse(lines).withColumn("text", F.when(F.col("seq") == 1, F.raise_error(F.lit("killed"))))
    with pytest.raises(Exception, match="killed"):
        store.append(settings.store.folder, 2, broken)
    assert len(store.committed(spark, settings.store.folder)) == 1
    assert [e.stored(t).count() for t in store.TABLES] == [1, 1, 1, 0]
