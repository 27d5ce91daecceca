"""Search from the stored index gives the rows of search over the lines."""

import random

import pytest
from pyspark.sql import functions as F

from parlance import config, engine
from parlance.operators import search, search_index

WORDS = "order orders ordinary send sender sent legal Friday Straße 東京 42 a über".split()


def lines(spark, seed, sessions=9, n=150):
    rng = random.Random(seed)
    rows = []
    for s in range(sessions):
        for q in range(1, 1 + (n * 5 if s == 0 else n)):
            size = rng.choice([0, 1, 3, 8, 60 if s == 3 else 5])
            rows.append((f"s{s}", q, " ".join(rng.choices(WORDS, [8, 1, 1, 5, 1, 1, 2, 2, 1, 1, 1, 9, 1], k=size))))
    rows += [("null", 1, None), ("null", 2, ""), ("null", 3, "?!")]
    return spark.createDataFrame(rows, "session_id string, seq int, text string")


def found(df):
    return [(r.session_id, r.seq, round(r.score, 9), round(r.relevance, 9), r["rank"]) for r in df.orderBy("rank").collect()]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    said = lines(spark, 1)
    folder = str(tmp_path_factory.mktemp("index"))
    even = F.col("seq") % 2 == 0
    search_index.add(said.where(even), folder, "0")
    search_index.add(said.where(~even), folder, "1")
    search_index.add(said.where(~even), folder, "1")  # written again: replaced
    return said, folder


@pytest.mark.parametrize("query,k", [(["send", "ord"], 1), (["send", "ord"], 20), (["send", "ord"], 5000), (["o"], 20), (["ord", "order"], 20), (["東", "straß"], 7), (["send", "none"], 3), ([], 3)])
def test_same_rows(spark, stored, query, k):
    said, folder = stored
    index = search_index.Index(spark, folder)
    assert found(index.bm25(query, k)) == (found(search.bm25(said, query, k)) if query else [])


def test_some_sessions(spark, stored):
    said, folder = stored
    index = search_index.Index(spark, folder)
    assert found(index.bm25(["send"], 9, without="s0")) == found(search.bm25(said.where("session_id <> 's0'"), ["send"], 9))
    assert found(index.bm25(["send"], 9, session="s3")) == found(search.bm25(said.where("session_id = 's3'"), ["send"], 9))
    assert found(index.bm25(["send"], 9, session="null")) == []


def test_parts_without_sizes_and_empty_tables(spark, stored, tmp_path):
    said, _ = stored
    folder = str(tmp_path)
    search_index.add(said.where("session_id = 's1'"), folder, "a")
    before = found(search_index.Index(spark, folder).bm25(["send"]))
    search_index.add(said.where("session_id = 's2'"), folder, "b")
    import shutil

    shutil.rmtree(f"{folder}/sizes/part=b")  # as a writer that was killed leaves it
    assert found(search_index.Index(spark, folder).bm25(["send"])) == before
    search_index.add(said.where("false"), folder, "c")
    assert found(search_index.Index(spark, folder).bm25(["send"])) == before


def test_only_asked_words_and_blocks_are_read(spark, stored):
    _, folder = stored
    index = search_index.Index(spark, folder)
    plan = index.bm25(["send"], 3)._jdf.queryExecution().toString()
    scans = [x for x in plan.split("FileScan") if "postings" in x]
    assert scans and "StringStartsWith(word,send)" in plan and "PartitionFilters" in plan


def test_engine_searches_what_it_has_stored(spark, tmp_path):
    settings = config.Settings()
    settings.store.folder, settings.store.index = f"{tmp_path}/db", True
    e = engine.Engine(spark, settings)
    schema = "session_id string, seq int, text string"
    for i, text in enumerate(["Remind me to send the order.", "The order was sent", "Nothing here"]):
        e.submit(spark.createDataFrame([("s", i, text)], schema), i)
    named = spark.createDataFrame([("s", "Monday")], "session_id string, name string")
    got = e.search_stored(named, "ord").orderBy("rank").collect()
    assert [(r.seq, r.session_name, r.marked) for r in got] == [(1, "Monday", "The «ord»er was sent"), (0, "Monday", "Remind me to send the «ord»er.")]
    assert e.search_stored(named, "ord", without="s").count() == 0
