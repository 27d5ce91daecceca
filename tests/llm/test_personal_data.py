"""Identifiers that no base pattern knows, planted behind, before and among words, and decoys behind ordinary words."""

import random

from parlance.llm import pii


def corpus(rng):
    word = lambda: rng.choice(["the", "of", "order", "year", "page", "room", "was", "paid", "in", "list", "since", "about", "me"])
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    email = lambda: f"{rng.choice('abcdef')}{digits(4)}@mail{digits(2)}.org"
    phone = lambda: f"+1 555 {digits(3)} {digits(4)}"
    rows, good, bad = [], set(), set()

    def add(text, group=None):
        rows.append((len(rows), text))
        if group is not None:
            group.add(len(rows) - 1)

    for _ in range(40):
        fill = lambda: " ".join(word() for _ in range(rng.randint(2, 6)))
        add(f"{fill()} mailto: {email()} {fill()}")
        add(f"{fill()} reach me {email()} {fill()}")
        add(f"{fill()} {email()} replied {fill()}")
        add(f"{fill()} cellphone {phone()} {fill()}")
        add(f"{fill()} {fill()} {fill()}")
        add(f"{fill()} the {email()} {fill()}")  # a seed behind an ordinary word
    for _ in range(12):
        add(f"{word()} mailto: user{digits(5)}@localhost, {word()}", good)
        add(f"{word()} reach me x{digits(6)} {word()}", good)
        add(f"{word()} handle{digits(5)} replied {word()}", good)
        add(f"{word()} in the order {digits(6)} {word()}", bad)
        add(f"{word()} since {digits(4)}-{digits(4)} {word()}", bad)
        add(f"{word()} the {digits(16)} {word()}", bad)
        add(f"{word()} me {digits(5)}. {word()}", bad)
    return rows, good, bad


def test_planted_and_decoys(spark):
    rows, good, bad = corpus(random.Random(4))
    got = {r.doc_id: r.context for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    hit = {d for d, spans in got.items() if spans}
    assert len(hit & good) / len(good) >= 0.9 and len(hit & good) / len(hit) >= 0.9 and not hit & bad
    text = dict(rows)
    for d in hit & good:
        (s,) = got[d]
        assert text[d][s.start : s.end].rstrip(".,") == text[d][s.start : s.end] and any(c.isdigit() for c in text[d][s.start : s.end])


def test_accepted_instances_induce_patterns(spark):
    """Numbers accepted behind one word make another word before them a pattern, which accepts more."""
    rows = [f"contact a{i}@b{i}.org now" for i in range(20)]
    rows += [f"contact id{1000 + i} now" for i in range(5)] + [f"badge id{1000 + i} here" for i in range(5)] + ["badge id9999 here"]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: len(r.context) for r in pii.find_personal_data(frame).collect()}
    assert got[len(rows) - 1] == 1 and all(got[i] == 1 for i in range(20, len(rows))) and not any(got[i] for i in range(20))


def test_nothing_to_learn_from(spark):
    rows = [(1, None), (2, ""), (3, "no seeds 12345 here"), (None, "12345 12345 12345"), (4, "a@b.c"), (4, "a@b.c")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, kind string, row int")
    got = pii.find_personal_data(frame).collect()
    assert len(got) == len(rows) and not any(r.context for r in got)
