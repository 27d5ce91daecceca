import pytest

from parlance.operators import redaction

TEXTS = [
    "Sarah Chen wrote to a@b.example", "SARAH CHEN", "Dr Wu, Mr. Lee and Priya\x1cNair", "call 555-1234 or +44 (20) 7946 0958", "card 4 1 1 1-1 1 1 1 1 1 1 1 1 1 1 1",
    "DE89370400440532013000", "123-45-6789", "zoë@exämple.de", "nothing here, order 82464", "", None,
]


def test_likely_leaves_out_only_texts_without_spans(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    told = {r.text: r.likely for r in rows.select("text", redaction.likely(rows["text"]).alias("likely")).collect()}
    assert all(told[t] for t in TEXTS if redaction.spans(t)) and sum(bool(redaction.spans(t)) for t in TEXTS) >= 6
    assert not told["nothing here, order 82464"] and told[None] is False


@pytest.mark.parametrize("counted", [True, False])
def test_together_with_many_values_repeated_places_and_no_scope(spark, counted):
    rows = [(i % 2 if i < 400 else None, i // 50, f"mail u{i}@x.example and Sarah Chen", "plain") for i in range(450)] + [(0, 0, "u0@x.example again", "to Sarah Chen"), (0, 0, "none", None)]
    frame = spark.createDataFrame(rows, "session_id long, seq int, text string, note string")
    out = redaction.redact_together({"lines": (frame, ["text", "note"], ["seq"])}, counted=counted)["lines"]
    found = [r.asDict() for r in out.collect()]
    assert len(found) == len(rows) and not any("@" in r["text"] or "Chen" in r["text"] + (r["note"] or "") for r in found)
    numbers = [{r["text"].split()[1] for r in found if r["session_id"] == s and r["text"].startswith("mail")} for s in (0, 1, None)]
    assert [len(n) for n in numbers] == [200, 200, 50]
    last = next(r for r in found if r["text"].endswith("again"))
    assert last["text"].split()[0] in numbers[0] and last["note"] == "to [PERSON_1]"
    assert not counted or sum(r["n_redacted"] for r in found) == 902
