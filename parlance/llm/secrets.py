"""Secret scans with built-in functions alone: patterns, and the entropy of a window sliding over candidates.

The entropy comes from counts of the characters in the window. A step changes two of them, so the sum of
c * log2(c) over the counts is kept up to date and H = log2(w) - sum / w.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import spans
from parlance.llm.common import table

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs of 20 and 24 characters; a greedy run with a shorter limit and a test of its length finds the same.
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
#: Whole runs of at least a window of these characters.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: Class of a candidate: the characters it consists of, and the bits that one of its windows must reach. Windows of 20
#: random characters have 3.2 to 3.6 bits (of 16 signs), 3.9 to 4.2 (of 62 or 64); written words and names of one case
#: stay below 3.6 but have no upper bound that random letters of one case pass, so those are no candidates at all,
#: nor are numbers. 4.32 bits, of 20 different characters, are the most.
CLASSES = (
    ("decimal", r"^[0-9]+$", 99.0),
    ("one case", r"^(?:[a-z+/_=-]+|[A-Z+/_=-]+)$", 99.0),
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", 3.0),
    ("letters", r"^[A-Za-z]+$", 3.8),
    ("alnum", r"^[A-Za-z0-9]+$", 3.6),
    ("base64", r"^[A-Za-z0-9+/_=-]+$", 3.8),
)
#: Candidates that are no secret: UUIDs, placeholders, words and numbers joined by signs or by capitals, repeated parts.
#: Repeated groups are possessive: the others take a stack frame a repetition, and a long run ends the JVM.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|placeholder|changeme|dummy|sample|x{6}|0{8}|123456789",
    r"^(?:[A-Z]?[a-z]*|[A-Z]*)[0-9]*(?:[/_=+-]++(?:(?:[A-Z]?+[a-z]{2,}+)++|[A-Z]*+[a-z]*+)[0-9]*+)++$",
    r"^(?:[A-Z]?+[a-z]{2,}+)++[0-9]{0,4}$",
    r"^(.{1,8})\1+$",
)

_XLOGX = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 2)]
_FIRST, _LAST = 43, 122  # code points of a candidate's characters, '+' to 'z'


_EACH, _BITS = 10, 6  # counts that a long holds, and bits of a count


def window_entropy(text: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy in bits of any `window` characters in a row; one pass, counts kept.

    The counts are packed into a few longs, and a step changes two of them, so the work grows with the text's length.
    """
    xlogx = F.array(*[F.lit(v) for v in _XLOGX])
    f = lambda count: F.element_at(xlogx, count.cast("int") + 1)
    longs = -(-(_LAST - _FIRST + 1) // _EACH)
    one = lambda shift: F.call_function("shiftleft", F.lit(1).cast("long"), shift)
    place = lambda code: ((code / _EACH).cast("int"), (code % _EACH * _BITS).cast("int"))
    count = lambda counts, word, shift: F.call_function("shiftrightunsigned", F.get(counts, word), shift).bitwiseAND(2**_BITS - 1)

    def entry(codes: Column):
        def at(code: Column, i: Column) -> Column:
            gone = F.when(i >= window, F.get(codes, i - window)).otherwise(F.lit(-1))
            (word, shift), (old_word, old_shift) = place(code), place(F.greatest(gone, F.lit(0)))
            return F.struct(
                word.alias("word"), shift.alias("shift"), old_word.alias("old_word"), old_shift.alias("old_shift"),
                (gone >= 0).alias("full"), (gone == code).alias("same"), (i + 1 >= window).alias("whole"),
            )

        return at

    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), longs).alias("counts"), F.lit(0.0).cast("double").alias("sum"), F.lit(-1.0).cast("double").alias("best"))

    def step(acc: Column, x: Column) -> Column:
        grown, shrunk = count(acc["counts"], x["word"], x["shift"]), count(acc["counts"], x["old_word"], x["old_shift"])
        less = F.when(x["full"], f(F.greatest(shrunk - 1, F.lit(0))) - f(shrunk)).otherwise(F.lit(0.0))
        total = acc["sum"] + F.when(x["same"], F.lit(0.0)).otherwise(f(grown + 1) - f(grown) + less)
        moved = F.transform(
            acc["counts"],
            lambda v, i: v + F.when(i == x["word"], one(x["shift"])).otherwise(F.lit(0)) - F.when(x["full"] & (i == x["old_word"]), one(x["old_shift"])).otherwise(F.lit(0)),
        )
        here = F.when(x["whole"], F.lit(math.log2(window)) - total / window).otherwise(F.lit(-1.0))
        return F.struct(F.when(x["same"], acc["counts"]).otherwise(moved).alias("counts"), total.alias("sum"), F.greatest(acc["best"], here).alias("best"))

    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c) - _FIRST)
    return spans.bound(spans.bound(codes, lambda codes: F.transform(codes, entry(codes))), lambda steps: F.aggregate(steps, zero, step, lambda acc: acc["best"]))


def is_random(candidate: Column) -> Column:
    """A window of the candidate reaches the entropy asked of its class, and no allow-list pattern fits."""
    least = F.lit(99.0)
    for _, characters, bits in reversed(CLASSES):
        least = F.when(candidate.rlike(characters), bits).otherwise(least)
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | candidate.rlike(pattern)
    return ~allowed & F.when(least < 99.0, window_entropy(candidate) >= least).otherwise(False)


def scan(docs: DataFrame) -> DataFrame:
    """docs with text -> the same with assign, access, hex and entropy (arrays of start, end, text).

    Offsets are code points. Null and empty texts have no span, a text of any length is scanned whole. Columns of
    docs named like the four are replaced. An entropy span is a whole candidate, unless a span of another kind has it all.
    """
    text = F.col("text")
    whole = docs.withColumn("assign", spans.kept(spans.matches(text, ASSIGN), lambda t: F.length(F.regexp_extract(t, ASSIGN, 2)) >= 6))
    whole = whole.withColumn("access", spans.matches(text, ACCESS)).withColumn("hex", spans.matches(text, HEX))
    base = F.concat("assign", "access", "hex")
    more = lambda s: ~F.exists(base, lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))
    random = F.filter(spans.matches(text, CANDIDATE), lambda s: is_random(s["text"]))
    return whole.withColumn("entropy", F.filter(random, more))


_SPANS = "array<struct<start:int,end:int>>"


def _gaps(cuts: Column) -> Column:
    """The stretch before each of the sorted spans that does not overlap or touch an earlier one; folded by chunks."""
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(cuts) - 1) / spans.CHUNK).cast("int")), lambda k: F.slice(cuts, k * spans.CHUNK + 1, spans.CHUNK))
    none = lambda kind: F.array().cast(kind).alias("out")

    def reached(chunks: Column) -> Column:
        furthest = lambda chunk: F.array_max(F.transform(chunk, lambda s: s["end"]))
        step = lambda acc, c: F.struct(F.greatest(acc["at"], furthest(c)).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
        return F.aggregate(chunks, F.struct(F.lit(-1).alias("at"), none("array<int>")), step, lambda acc: acc["out"])

    def step(acc: Column, s: Column) -> Column:
        gap = F.struct(F.greatest(acc["at"], F.lit(0)).alias("start"), s["start"].alias("end"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] > acc["at"], F.array_append(acc["out"], gap)).otherwise(acc["out"]).alias("out"))

    one = lambda chunk, at: F.aggregate(chunk, F.struct(at.alias("at"), none(_SPANS)), step, lambda acc: acc["out"])
    return spans.bound(chunks, lambda chunks: F.flatten(F.zip_with(chunks, reached(chunks), one)))


def _without(signs: Column, cuts: Column, mark: str) -> Column:
    """The text of signs, a list of characters, with mark for each of the sorted spans cuts."""
    text = lambda start, size: F.array_join(F.slice(signs, start + 1, size), "")
    end = F.array_max(F.transform(cuts, lambda s: s["end"]))
    before = F.transform(_gaps(cuts), lambda g: F.concat(text(g["start"], g["end"] - g["start"]), F.lit(mark)))
    return F.concat(F.array_join(before, ""), text(end, F.size(signs) - end))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with text (and n_chars, if it has that) -> the same rows and columns, each secret replaced by mark.

    Spans that overlap or touch are replaced together. Null texts stay null.
    """
    names = docs.columns
    data = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    found = scan(docs.select(data, F.col("text")))
    every = F.array_sort(F.transform(F.concat("assign", "access", "hex", "entropy"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    hidden = spans.bound(F.split("text", ""), lambda signs: spans.bound(every, lambda cuts: _without(signs, cuts, mark)))
    done = found.withColumn("spans", every).withColumn("new", F.when(F.size("spans") > 0, hidden).otherwise(F.col("text")))
    out = {"text": F.col("new"), "n_chars": F.when(F.size("spans") > 0, F.length("new")).otherwise(F.col("row.n_chars")) if "n_chars" in names else None}
    return done.select(*[(out[c].cast(docs.schema[c].dataType) if out.get(c) is not None else F.col(f"row.`{c}`")).alias(c) for c in names])


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.concat(*[spans.labelled(F.col(k), k, i) for i, k in enumerate(KINDS[:3])])
    every = F.concat(base, spans.labelled(F.col("entropy"), "entropy", 3))
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        spans.digest(spans.as_text(base)).alias("base_sha256"), spans.as_text(every).alias("spans"),
    )
