import math

import pytest
from pyspark.sql import functions as F

from parlance.functions import language as L
from parlance.functions import sentiment as S
from parlance.functions import text as T
from parlance.operators import ranking, rules, search, sequence


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_text(spark):
    col = F.col("t")
    assert one(spark, T.tokens(col), t="Don't Naïve x re-do it2") == ["don", "naïve", "re", "do", "it"]
    assert one(spark, T.sentences(col), t="One. Two!  Three\nfour ") == ["One.", "Two!", "Three", "four"]
    assert one(spark, T.priority(col), t="urgent but later") == 0 and one(spark, T.priority(col), t="ASAP") == 3
    assert one(spark, T.due_date(col), t="by 5 pm or 3/4") == "by 5 pm" and one(spark, T.due_date(col), t="at 10:30") == "10:30"
    assert one(spark, T.compress(col), t="So, um, you know we basically ship it , , today") == "We ship it, today"
    assert spark.range(1).select(T.clock(F.lit(59.9996))).first()[0] == "00:01:00,000"
    assert spark.range(1).select(T.highlight(F.lit("Go goal"), ["go"])).first()[0] == "«Go» «go»al"


def test_rules(spark):
    text = "Remind me to call Bob by friday. The deadline is Monday and we decided to ship."
    got = rules.extract(spark.createDataFrame([(1, text)], "id int, text string")).collect()
    assert [(r.kind, r.fragment, r.rule) for r in got] == [("action_item", "call Bob by friday", "reminder"), ("deadline", "Monday", "deadline"), ("decision", "ship", "decision")]
    assert all(text[r.start : r.end].strip() == r.fragment for r in got) and got[0].due == "friday"


def _polarity(spark, *texts, language="en", extra=None):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = frame.select("i", S.polarity(F.col("t"), language, extra).alias("p"), S.score(F.col("t"), language, extra).alias("s")).orderBy("i").collect()
    return [r.p for r in rows], [r.s for r in rows]


def test_sentiment(spark):
    p, s = _polarity(spark, "not good", "good", "very good!", "", None, "fine but terrible", "It's GREAT", "good! bad!", "GOOD", "the GOOD end")
    assert p[0].compound < 0 < p[1].compound < p[2].compound
    for i in (3, 4):
        assert tuple(s[i]) == (0.0, 0.0, 0.0, 1.0, "neutral")
    assert s[5].label == "negative"
    assert p[1].compound == pytest.approx(1.9 / math.sqrt(1.9**2 + 15))
    assert s[6].compound == 0.5719  # a word with an apostrophe is no reason to call it shouting
    x = 1.9 - 2.5 - 2 * 0.292
    assert p[7].compound == pytest.approx(x / math.sqrt(x * x + 15))
    assert p[8].compound == pytest.approx(p[1].compound) and p[9].compound > p[8].compound


def test_sentiment_against_a_plain_loop(spark):
    import random
    import re

    from parlance.functions import lexicons as L

    rng = random.Random(3)
    pool = [*rng.sample(list(L.VALENCES["en"]), 12), "very", "slightly", "not", "never", "but", "but", "don't", "the", "it's", "I", "zzz", "!", "?", "?!", "..."]
    texts = [" ".join(w.upper() if rng.random() < 0.2 else w for w in rng.choices(pool, k=rng.randint(0, 14))) for _ in range(300)]

    def loop(text):
        raw = re.findall(r"[A-Za-z']+|[!?]+", text)
        low = [t.lower() for t in raw]
        capitals = [t for t in raw if t.isalpha() and t.isupper() and len(t) > 1]
        loud = 0 < len(capitals) < sum(t.isalpha() for t in raw)
        found = []
        for i, w in enumerate(low):
            v = L.VALENCES["en"].get(w)
            if v is not None:
                sign = 1 if v > 0 else -1
                v += 0.733 * sign * (loud and raw[i].isupper())
                v += sum(sign * L.BOOSTERS["en"].get(low[i - d], 0) * f for d, f in ((1, 1.0), (2, 0.85), (3, 0.7)) if i >= d)
                v *= -0.74 if set(low[max(0, i - 3) : i]) & set(L.NEGATIONS["en"].split()) else 1
                v *= 1 if "but" not in low else 0.5 if i < low.index("but") else 1.5
                found.append(v)
        if not found:
            return 0.0
        x = sum(found)
        marks = 0.292 * min(text.count("!"), 4) + (0.18 * min(text.count("?"), 3) if text.count("?") > 1 else 0)
        x += marks if x >= 0 else -marks
        return x / math.sqrt(x * x + 15)

    p, _ = _polarity(spark, *texts)
    assert [r.compound for r in p] == pytest.approx([loop(t) for t in texts])


def test_sentiment_of_other_languages(spark):
    p, _ = _polarity(spark, "muy bueno", "no es bueno", language="es", extra={"Es": 0.0})
    assert p[0].compound > 0 > p[1].compound
    frame = spark.createDataFrame([("es", "bueno"), ("fr", "mauvais"), ("en", "good"), ("xx", "good"), (None, "bad")], "code string, t string")
    rows = frame.select("code", S.score(F.col("t"), F.col("code")).alias("s")).collect()
    assert [r.s.label for r in rows] == ["positive", "negative", "positive", "positive", "negative"]


def test_language(spark):
    for text, code in (("the cat and the dog have you with this", "en"), ("la casa de los días está muy bien también", "es"), ("short text", "en")):
        assert one(spark, L.detect(F.col("t")), t=text).code == code
    lines = spark.createDataFrame([(1, i, c, 0.9) for i, c in enumerate(["en", "es", "es", "es", "en"])], "session_id int, seq int, code string, confidence double")
    assert [r.current for r in L.sticky(lines).orderBy("seq").collect()] == ["en", "en", "es", "es", "es"]


def test_cues_equal_a_loop(spark):
    import random

    rng = random.Random(3)
    rows, at = [], 0.0
    for i in range(120):
        at += rng.random() * 2
        rows.append((1, i, at, at + rng.random() * 3))
    got = sequence.cues(spark.createDataFrame(rows, "session_id int, seq int, started_at double, ended_at double")).orderBy("seq").collect()
    base, end = rows[0][2], 0.0
    for r, (_, _, a, b) in zip(got, rows):
        start, length = max(a - base, end), max(b - a, 0.4)
        end = start + length
        assert (r.cue_start, r.cue_end) == pytest.approx((start, end))


def test_topics(spark):
    say = ["budget money invoice"] * 4 + ["garden flower plant"] * 4
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(say)], "session_id int, seq int, text string")
    assert [r.seq for r in sequence.topic_shifts(lines, 2, 0.2, 4).collect()] == [5]


def test_ranking(spark):
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(["The audio driver crashes.", "Audio driver latency is bad.", "Lunch was nice.", "Fix the audio driver."])], "session_id int, seq int, text string")
    top = ranking.text_rank(lines, 3).orderBy("rank").collect()
    assert len(top) == 3 and "Lunch was nice." not in [r.sentence for r in top]
    assert ranking.rake(lines).where("rank = 1").count() == 1


def test_search(spark):
    lines = spark.createDataFrame([(1, 1, "send the order"), (1, 2, "order order"), (2, 1, "nothing")], "session_id int, seq int, text string")
    assert [(r.session_id, r.seq) for r in search.bm25(lines, ["sen", "ord"]).collect()] == [(1, 1)]
    best = search.tf_idf(lines, ["order", "send"]).orderBy("rank").first()
    assert (best.seq, best.relevance) == (1, 1.0)
