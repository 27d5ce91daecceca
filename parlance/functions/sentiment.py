"""Lexicon sentiment as column expressions. The tokeniser is ASCII, so accented entries of a lexicon never match; that
is kept."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions import lexicons as L

# The constants of the score.
ALPHA, CAPS, NEGATED = 15.0, 0.733, -0.74
EXCLAMATION, QUESTION = 0.292, 0.18
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
NEAR = (1.0, 0.85, 0.7)
TOKEN = r"[A-Za-z']+|[!?]+"
LABEL_AT = 0.05


def bound(value: Column, use) -> Column:
    """use(value) with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _known(word: Column, values: Mapping[str, float]) -> Column:
    """The word's value, null without one. Most words have none, which a hash set tells."""
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.when(word.isin(list(values)), F.element_at(table, word)) if values else F.lit(None).cast("double")


def _values(raw: Column, low: Column, lexicon: Mapping[str, float], negations: list[str], boosters: Mapping[str, float]) -> Column:
    """array<double>: the valences of the words in the lexicon, in order, with all that changes them."""
    capitals = F.size(F.filter(raw, lambda t: t.rlike("^[A-Z]{2,}$")))
    shouting = (capitals > 0) & (capitals < F.size(F.filter(raw, lambda t: t.rlike("^[A-Za-z]+$"))))
    but = F.array_position(low, "but")

    def value(x: Column) -> Column:
        at, base = x["at"], x["value"]
        sign = F.when(base > 0, 1.0).otherwise(-1.0)
        out = base + F.when(shouting & F.get(raw, at).rlike("^'*[A-Z][A-Z']*$"), CAPS * sign).otherwise(0.0)
        for k, factor in enumerate(NEAR, 1):
            boost = F.when(at >= k, _known(F.get(low, F.greatest(at - k, F.lit(0))), boosters))
            out = out + F.coalesce(boost * factor, F.lit(0.0)) * sign
        before = F.slice(low, F.greatest(at - 2, F.lit(1)), F.least(at, F.lit(3)))
        out = out * F.when(F.exists(before, lambda w: w.isin(negations)), NEGATED).otherwise(1.0)
        return out * F.when(but == 0, 1.0).when(at + 1 < but, BEFORE_BUT).otherwise(AFTER_BUT)

    hits = F.filter(F.transform(low, lambda w, i: F.struct(i.alias("at"), _known(w, lexicon).alias("value"))), lambda x: x["value"].isNotNull())
    return F.transform(hits, value)


def _score(text: Column, raw: Column, values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    shouts, asks = F.length(F.regexp_replace(text, "[^!]", "")), F.length(F.regexp_replace(text, "[^?]", ""))
    stress = F.least(shouts, F.lit(4)) * EXCLAMATION + F.when(asks > 1, F.least(asks, F.lit(3)) * QUESTION).otherwise(0.0)
    part = lambda keep, one: F.aggregate(F.filter(values, keep), F.lit(0.0), lambda a, v: a + v + one)
    rest = (F.size(raw) - F.size(values)).cast("double")

    def made(x: Column) -> Column:
        whole = x["up"] + x["down"] + rest
        compound = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x["total"] / F.sqrt(x["total"] * x["total"] + ALPHA)))
        found = F.struct(compound.alias("compound"), (x["up"] / whole).alias("positive"), (x["down"] / whole).alias("negative"), (rest / whole).alias("neutral"))
        none = F.struct(F.lit(0.0).alias("compound"), F.lit(0.0).alias("positive"), F.lit(0.0).alias("negative"), F.lit(1.0).alias("neutral"))
        return F.when(F.size(values) > 0, found).otherwise(none)

    sums = F.struct(
        (total + F.when(total >= 0, stress).otherwise(-stress)).alias("total"),
        part(lambda v: v > 0, 1.0).alias("up"), F.abs(part(lambda v: v < 0, -1.0)).alias("down"),
    )
    return bound(sums, made)


def polarity(text: Column, language: str = "en", extra: Mapping[str, float] | None = None) -> Column:
    """struct<compound,positive,negative,neutral>, not rounded, by the lexicon of a language and extra entries. A text
    without a word of the lexicon, null and empty ones too, is neutral."""
    lexicon = dict(L.VALENCES.get(language, {})) | {k.lower(): float(v) for k, v in (extra or {}).items()}
    negations = L.NEGATIONS.get(language, L.NEGATIONS["en"]).split()
    boosters = L.BOOSTERS.get(language, L.BOOSTERS["en"])
    text = F.coalesce(text, F.lit(""))

    def of(raw: Column) -> Column:
        return bound(F.transform(raw, F.lower), lambda low: bound(_values(raw, low, lexicon, negations, boosters), lambda v: _score(text, raw, v)))

    return bound(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), of)


def label(compound: Column) -> Column:
    return F.when(compound >= LABEL_AT, "positive").when(compound <= -LABEL_AT, "negative").otherwise("neutral")


def score(text: Column, language: str | Column = "en", extra: Mapping[str, float] | None = None) -> Column:
    """struct<compound,positive,negative,neutral,label>, rounded to four digits; the label is of the compound before
    that. A language column picks the lexicon of each row, English for other codes than those with one."""
    if isinstance(language, str):
        found = polarity(text, language, extra)
    else:
        found = None
        for code in L.VALENCES:
            if code != "en":
                one = polarity(text, code, extra)
                found = F.when(language == code, one) if found is None else found.when(language == code, one)
        found = found.otherwise(polarity(text, "en", extra))
    four = lambda x, c: F.round(x[c], 4).alias(c)
    return bound(found, lambda x: F.struct(four(x, "compound"), four(x, "positive"), four(x, "negative"), four(x, "neutral"), label(x["compound"]).alias("label")))
