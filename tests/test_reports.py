import hashlib

import pytest

from parlance.operators import entities, exports, insights, redaction

TEXT = "Email Sarah Chen at sarah@acme.com or call 555-123-4567 today, paid $4,200 to Acme Labs."


def test_entities(spark):
    got = [(e["kind"], e["text"]) for e in entities.find(TEXT)]
    assert got == [("person", "Sarah Chen"), ("contact", "sarah@acme.com"), ("money", "$4,200"), ("organization", "Acme Labs")]
    assert all(TEXT[e["start"] : e["end"]] == e["text"] for e in entities.find(TEXT))
    assert entities.find(None) == entities.find("") == [] and [e["text"] for e in entities.find("Tell Dr. Ann Lee")] == ["Ann Lee"]
    df = spark.createDataFrame([(1, TEXT), (2, "nothing here"), (3, None)], "id int, text string")
    assert {r.id for r in entities.extract(df).collect()} == {1} and entities.extract(df).count() == 4


def test_redaction(spark):
    rows = [("s", 1, TEXT), ("s", 2, "Ann Lee and SARAH@acme.com met Sarah Chen."), ("t", 1, "Ann Lee — naïve 😀 Bob Ray"), ("t", 2, None), ("t", 3, "")]
    df = spark.createDataFrame(rows, "session_id string, seq int, text string")
    got = {(r.session_id, r.seq): (r.text, r.n_redacted) for r in redaction.redact(df).collect()}
    assert got["s", 1] == ("Email [PERSON_1] at [EMAIL_1] or call [PHONE_1] today, paid $4,200 to Acme Labs.", 3)
    assert got["s", 2] == ("[PERSON_2] and [EMAIL_1] met [PERSON_1].", 3)
    assert got["t", 1] == ("[PERSON_1] — naïve 😀 [PERSON_2]", 2) and got["t", 2] == (None, 0) and got["t", 3] == ("", 0)
    one = lambda mode: redaction.redact(df.where("session_id = 's' and seq = 2"), ("person",), mode, "x").first().text
    h = lambda v: hashlib.sha256(("x" + v).encode()).hexdigest()[:8]
    assert one("label") == "[PERSON] and SARAH@acme.com met [PERSON]." and one("mask") == "███████ and SARAH@acme.com met ██████████."
    assert one("hash") == f"[PERSON:{h('ann lee')}] and SARAH@acme.com met [PERSON:{h('sarah chen')}]."
    with pytest.raises(ValueError):
        redaction.redact(df, mode="none")


def test_exports(spark):
    schema = "session_id string, seq int, text string, started_at double, ended_at double, speaker string, translation string, spans array<struct<start:double,end:double,text:string,words:array<struct<start:double,end:double,text:string>>>>"
    rows = [
        ("s", 1, "Hello  there", 10.0, 12.5, "Ann", "Hola", [(10.0, 11.0, "Hello", [(10.0, 10.5, "Hel"), (10.5, 11.0, "lo")]), (11.0, 11.0, "gone", None)]),
        ("s", 2, "Bye", 11.5, 13.0, None, None, None),
        ("s", 3, "  ", 14.0, 15.0, None, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    text = lambda *a, **k: exports.document(exports.blocks(df, *a, **k)).first().content
    assert text("srt") == "1\n00:00:00,000 --> 00:00:01,000\n[Ann] Hello\n\n2\n00:00:01,500 --> 00:00:03,000\nBye\n"
    assert text("vtt", speakers=False, translated=True) == "WEBVTT\n\n00:00:00.000 --> 00:00:02.500\nHola\n\n00:00:02.500 --> 00:00:04.000\nBye\n"
    assert text("txt") == "[00:00:00] [Ann] Hello\n[00:00:01] Bye\n"
    assert text("srt", granularity="word").count("-->") == 3
    with pytest.raises(ValueError):
        exports.blocks(df, "docx")


def test_review(spark):
    rows = [
        ("a", "s1", "Mon", 1.0, "blocker", "the audio driver crash", 3, None, 100.0, False),
        ("b", "s2", "Tue", 2.0, "blocker", "the audio driver crashes", 1, None, 86_400.0 * 8, False),
        ("c", "s2", "Tue", 2.0, "decision", "the audio driver crash", 1, None, 86_400.0 * 8, True),
        ("d", "s2", "Tue", 2.0, "risk", "never stored", 1, None, 0.0, False),
    ]
    df = spark.createDataFrame(rows, "id string, session_id string, session_name string, session_started double, kind string, text string, priority int, due string, created_at double, done boolean")
    (item,) = insights.open_items(df, as_of=86_400.0 * 9).collect()
    assert (item.id, item.occurrences, item.created_at, item.stale) == ("b", 2, 100.0, True)
    assert insights.open_items(df, as_of=0.0, collapse=False).count() == 2
    (again,) = insights.recurring_items(df).collect()
    assert again.sessions == ["Mon", "Tue"] and again.kind == "blocker" and len(again.variants) == 2
