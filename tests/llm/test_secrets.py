"""Planted secrets that no base pattern knows, and decoys."""

import base64
import random
import string
import uuid

from parlance.llm import secrets, spans
from pyspark.sql import functions as F


def planted(rng):
    pick = lambda alphabet, n: "".join(rng.choices(alphabet, k=n))
    alnum = string.ascii_letters + string.digits
    return [
        "ghp_" + pick(alnum, 36), pick(alnum + "+/", 40), "xoxb-" + pick(string.digits, 12) + "-" + pick(alnum, 24), "sk-" + pick(alnum, 48),
        "eyJ" + pick(alnum + "_-", 60), pick("0123456789ABCDEF", 32), base64.b64encode(rng.randbytes(24)).decode(), pick(string.ascii_letters, 32), pick(alnum, 24),
    ]


def decoys(rng, word):
    camel = lambda n: "".join(word().capitalize() for _ in range(n))
    return [
        str(uuid.UUID(bytes=rng.randbytes(16))), "/".join(word() for _ in range(6)), "-".join(word() for _ in range(5)) + "-2024-05-17", "".join(word() for _ in range(6)),
        camel(5), "_".join(word().upper() for _ in range(5)), "".join(rng.choices(string.digits, k=30)), "abc12" * 6, "=" * 40, "2024-01-01/2024-12-31/2025-06-30", camel(4) + "2", "your_api_key_example_1234567890",
    ]


def test_planted_secrets_and_decoys(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice(c) for c in rng.choice(["bcdfglmnprst", "bdklmnprstvz"]) + "aeiou" for _ in range(1))[:2] + rng.choice(["ran", "tion", "ment", "lo", "ster", "ve", "ding"])
    rows, good = [], set()
    for i in range(60):
        items = [(x, True) for x in planted(rng)] + [(x, False) for x in decoys(rng, word)]
        rng.shuffle(items)
        for x, secret in items:
            rows.append((len(rows), f"{word()} ({x}) {word()}"))
            if secret:
                good.add(rows[-1][0])
    found = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    hit = {r.doc_id for r in found.where(F.size("entropy") > 0).select("doc_id").collect()}
    assert len(hit & good) / len(good) >= 0.9 and len(hit & good) / len(hit) >= 0.9
    text = dict(rows)
    for r in found.where(F.size("entropy") > 0).collect():
        for s in r.entropy:
            assert text[r.doc_id][s.start : s.end] == s.text


def test_entropy_spans_that_reach_beyond_others_are_masked_whole(spark):
    inner = "a3f09c1be47d2856f0c3b9e1"
    rows = [(1, f"key Zk3{inner}QmX9vT7pLr2Wd8 end"), (2, f"key {inner} end"), (3, None), (4, "")]
    out = {r.doc_id: r.text for r in secrets.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: "key [SECRET] end", 2: "key [SECRET] end", 3: None, 4: ""}


def test_many_matches_in_one_text(spark):
    rng = random.Random(2)
    text = "".join(f"{'é' * rng.randint(0, 3)}{'7' * rng.randint(1, 4)} " for _ in range(20_000))
    frame = spark.createDataFrame([(text,)], "text string")
    got = frame.select(spans.matches(F.col("text"), "[0-9]++").alias("s")).first().s
    at, wanted = 0, []
    for run in text.split(" ")[:-1]:
        start = at + run.index("7")
        wanted.append((start, at + len(run)))
        at += len(run) + 1
    assert [(s.start, s.end) for s in got] == wanted
