"""Candidate phrases of the keyphrase ranking."""

import pytest

from parlance.operators import ranking


@pytest.mark.parametrize(
    "text,wanted",
    [
        ("alpha bravo charlie delta echo foxtrot", ["alpha bravo charlie delta", "echo foxtrot"]),
        ("alpha bravo charlie delta", ["alpha bravo charlie delta"]),
        ("Alpha bravo. Charlie, delta the echo", ["alpha bravo", "charlie delta", "echo"]),
        ("alpha\nbravo 12 charlie um delta", ["alpha", "bravo", "charlie", "delta"]),
        (None, []),
    ],
)
def test_runs_are_cut_not_dropped(text, wanted):
    assert [" ".join(p) for p in ranking.phrases(text)] == wanted


def test_rake_counts_long_runs(spark):
    lines = spark.createDataFrame([(1, 1, "alpha bravo charlie delta echo foxtrot")], "session_id long, seq long, text string")
    assert {r.phrase for r in ranking.rake(lines).collect()} == {"alpha bravo charlie delta", "echo foxtrot"}
