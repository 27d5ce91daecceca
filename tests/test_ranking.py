"""Inbound weights from word and length counts against the sum over pairs, and a long session."""

import math
import random
from collections import defaultdict

import pytest

from parlance.operators import ranking


def pairs(sentences):
    weight = defaultdict(float)
    for s, i, a in sentences:
        for t, j, b in sentences:
            if s == t and i != j and set(a) & set(b):
                weight[s, i, j] = len(set(a) & set(b)) / (math.log(len(a) + 1) + math.log(len(b) + 1))
    total = defaultdict(float)
    for (s, i, _), w in weight.items():
        total[s, i] += w
    out = defaultdict(float)
    for (s, i, j), w in weight.items():
        out[s, i] += w / total[s, j]
    return out


def test_inbound_weights(spark):
    rng = random.Random(4)
    rows = [(s, i, [rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 9))]) for s in "xyz" for i in range(25)]
    rows += [("solo", 0, ["alone"]), ("solo", 1, ["other", "other"]), ("same", 0, ["w"]), ("same", 1, ["w"]), ("none", 0, [])]
    got = {(r.session_id, r.position): r.c for r in ranking.inbound(spark.createDataFrame(rows, "session_id string, position int, words array<string>")).collect()}
    wanted = pairs(rows)
    assert got.keys() == wanted.keys()
    assert all(got[k] == pytest.approx(wanted[k], rel=1e-9) for k in wanted)


def test_a_session_of_many_sentences(spark):
    said = spark.range(40_000).selectExpr("'one' as session_id", "cast(id as int) as seq", "concat('every meeting repeats project number', cast(id % 500 as string), ' topic', chr(97 + id % 26), 'word.') as text")
    got = ranking.text_rank(said).collect()
    assert sorted(r["rank"] for r in got) == [1, 2, 3, 4, 5]  # a pair for every two sentences would be 800 million


def test_no_words(spark):
    lines = spark.createDataFrame([("a", 1, None), ("b", 1, ""), ("c", 1, "The of. And?"), ("d", 1, "Budget. Budget!")], "session_id string, seq int, text string")
    assert sorted((r.session_id, r.position) for r in ranking.text_rank(lines).collect()) == [("c", 0), ("c", 1), ("d", 0), ("d", 1)]
    assert ranking.text_rank(lines.limit(0)).count() == 0
