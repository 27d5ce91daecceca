"""Spans of pattern matches as column expressions: built-in functions give matches but no offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,text:string>>"
#: Matches whose offsets are summed up in one fold. A fold copies its list at each step, so a text's matches are
#: folded by chunks, and then the chunks: the work grows with the number of matches, not with its square.
CHUNK = 128


def bound(value: Column, use) -> Column:
    """use(value) with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def matches(text: Column, pattern: str, before=None, after=None) -> Column:
    """All leftmost non-overlapping matches with their code point offsets, as SPAN.

    The text is split at the matches, and the lengths of pieces and matches add up. The pattern never matches
    an empty string. Null texts have no match. With before and after each match also has what these functions
    make of the piece of text before it and the one behind it (fields before and after).
    """
    around = {"before": before, "after": after} if before else {}
    kind = f"array<struct<start:int,end:int,text:string{''.join(f',{k}:string' for k in around)}>>"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def pieces(gaps: Column) -> Column:
        one = lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("text"))
        if before:
            rows = F.zip_with(F.slice(gaps, 1, F.size(gaps) - 1), F.slice(gaps, 2, F.size(gaps)), lambda g, h: F.struct(g.alias("g"), h.alias("h")))
            return F.zip_with(rows, found, lambda g, m: F.struct(F.length(g["g"]).alias("gap"), m.alias("text"), before(g["g"]).alias("before"), after(g["h"]).alias("after")))
        return F.zip_with(F.slice(gaps, 1, F.size(gaps) - 1), found, one)

    def cut(pieces: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / CHUNK).cast("int")), lambda k: F.slice(pieces, k * CHUNK + 1, CHUNK))

    def starts(chunks: Column) -> Column:
        size = lambda chunk: F.aggregate(chunk, F.lit(0), lambda n, x: n + x["gap"] + F.length(x["text"]))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, c: F.struct((acc["at"] + size(c)).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
        return F.aggregate(chunks, zero, step, lambda acc: acc["out"])

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.length(x["text"])
        fields = [begin.alias("start"), end.alias("end"), x["text"].alias("text"), *(x[k].alias(k) for k in around)]
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(*fields)).alias("out"))

    def placed(chunks: Column) -> Column:
        one = lambda c, at: F.aggregate(c, F.struct(at.alias("at"), F.array().cast(kind).alias("out")), step, lambda acc: acc["out"])
        return F.flatten(F.zip_with(chunks, starts(chunks), one))

    spans = bound(gaps, lambda g: bound(pieces(g), lambda p: bound(cut(p), placed)))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(kind))


def kept(spans: Column, test) -> Column:
    return F.filter(spans, lambda s: test(s["text"]))


def labelled(spans: Column, kind: str, rank: int) -> Column:
    """Spans as array<struct<start,rank,end,kind>>, which sorts by start and then by rank."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def as_text(spans: Column) -> Column:
    """kind:start:end by start, then rank, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
