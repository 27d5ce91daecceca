"""Near-equal commitments of any number go to the leaders that a loop over them gives."""

import random

import pytest

from parlance.operators import insights

WORDS = "audio driver crash crashes report reports send order legal review budget finance queue latency outage".split()


def said(seed, n):
    """kind, signature, place: chains of texts that differ a little, repeats, long and empty ones."""
    rng, out = random.Random(seed), []
    for i in range(n):
        if out and rng.random() < 0.6:
            text = list(rng.choice(out)[1])
            for _ in range(rng.choice([0, 1, 2, 4])):
                at = rng.randrange(len(text) + 1)
                text[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "é", "s", " "])
            text = "".join(text)
        else:
            text = rng.choice(["", "a", "é" * 3, " ".join(rng.choices(WORDS, k=rng.choice([1, 2, 3, 4, 60])))])
        out.append((rng.choice(["blocker", "blocker", "decision"]), text, i * 3))
    rng.shuffle(out)
    return out


def loop(rows):
    """Item by item, in order: the first leader of its kind that is alike, else itself."""
    led, out = {}, {}
    for kind, text, place in sorted(rows, key=lambda r: r[2]):
        found = next((p for p, t in led.get(kind, []) if insights.alike(t, text)), None)
        if found is None:
            led.setdefault(kind, []).append((place, text))
        out[place] = place if found is None else found
    return out


@pytest.mark.parametrize("seed,n,chunk", [(1, 350, 40), (2, 200, 2000)])
def test_leaders_are_those_of_a_loop(spark, seed, n, chunk):
    rows = said(seed, n)
    wanted = loop(rows)
    assert len(set(wanted.values())) < len(wanted) - 20 and len({len(t) for _, t, _ in rows}) > 20
    items = spark.createDataFrame(rows, "kind string, signature string, place long")
    assert {r.place: r.leader for r in insights.leaders(items, chunk=chunk).collect()} == wanted
    if n < 300:
        assert {r.place: r.leader for r in insights.clusters(items).collect()} == wanted


def test_reports_of_everything_are_those_of_a_large_limit(spark):
    texts = [t or "..." for _, t, _ in said(4, 90)]
    rows = [(f"i{i:03}", f"s{i % 7}", f"S {i % 7}", None if i % 7 == 3 else float(i % 7), ["blocker", "decision", "risk"][i % 3], t, i % 4, None, float(i % 11), i % 9 == 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id string, session_id string, session_name string, session_started double, kind string, text string, priority int, due string, created_at double, done boolean")
    for report in (lambda limit: insights.open_items(df, 86_400.0, limit), lambda limit: insights.recurring_items(df, limit=limit)):
        assert sorted(map(str, report(None).collect())) == sorted(map(str, report(1000).collect()))
    assert insights.open_items(df.where("false"), 0.0, None).count() == 0
