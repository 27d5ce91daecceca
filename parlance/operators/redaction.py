"""Redaction of personal data: spans by patterns and entities, replaced by stable aliases."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from parlance.operators import entities

# The patterns of each kind, the kinds that entities give, and those taken by default.
PATTERNS = {
    "email": r"\b[\w.+-]+@[\w-]+\.[\w.]{2,}\b",
    "url": r"(?i)\bhttps?://\S+",
    "phone": r"(?<![\w.])(?:\+\d{1,3}[\s.-]?)?(?:\(\d{2,4}\)[\s.-]?)?\d{3,4}[\s.-]\d{3,4}(?:[\s.-]\d{2,4})?(?![\w.])",
    "card": r"\b(?:\d[ -]?){13,19}\b",
    "iban": r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b",
    "ip": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "postcode": r"\b[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
}
ENTITY_KINDS = ("person", "organization", "location", "contact", "link")
DEFAULT_KINDS = ("email", "phone", "card", "iban", "ssn", "person")
MODES = ("pseudonym", "hash", "mask", "label")

#: What a text with a match of the kind holds, written for ASCII; other texts always count as likely.
LIKELY = {
    "email": "@", "url": "://", "phone": r"[0-9]{3}[\s\x1C-\x1F.-][0-9]{3}", "card": r"(?:[0-9][ -]?){13}", "iban": r"[A-Z]{2}[0-9]{2}[A-Z0-9]{10}",
    "ip": r"[0-9]\.[0-9]", "postcode": r"[A-Z][0-9]", "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "contact": "@", "link": "://",
    "person": r"Mr|Mrs|Ms|Dr|Prof|[A-Z][a-z]{2,}[\s\x1C-\x1F]+[A-Z][a-z]{2}", "organization": r"[A-Z]", "location": r"[A-Z]",
}

SCHEMA = "array<struct<start:int,end:int,kind:string,value:string>>"
_compiled = {k: re.compile(p) for k, p in PATTERNS.items()}


def spans(text: str | None, kinds: Sequence[str] = DEFAULT_KINDS) -> list[dict]:
    """Spans that do not overlap: the leftmost, of those the longest, of those the kind named first."""
    text = text or ""
    named = entities.find(text) if set(kinds) & set(ENTITY_KINDS) else []
    found = [(m.start(), m.end(), k, m[0].strip()) for k, p in _compiled.items() if k in kinds for m in p.finditer(text)]
    found += [(e["start"], e["end"], e["kind"], e["text"]) for e in named if e["kind"] in kinds]
    out: list[dict] = []
    for start, end, kind, value in sorted(found, key=lambda f: (f[0], -f[1])):
        if not out or start >= out[-1]["end"]:
            out.append({"start": start, "end": end, "kind": kind, "value": value})
    return out


def likely(text: Column, kinds: Sequence[str] = DEFAULT_KINDS) -> Column:
    """False only where spans() finds nothing, so that Python sees few texts. Never null."""
    found = F.lit(False) if set(kinds) <= set(LIKELY) else F.lit(True)
    for pattern in [r"[^\x00-\x7F]", *(LIKELY[k] for k in kinds if k in LIKELY)]:
        found = found | text.rlike(pattern)
    return F.coalesce(found, F.lit(False))


def _splice(text: Column, pieces: Column) -> Column:
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda s, p: F.struct(F.concat(s["out"], F.substring(text, s["at"] + 1, p["start"] - s["at"]), p["alias"]).alias("out"), p["end"].alias("at"))
    return F.aggregate(pieces, begin, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))


def redact(
    lines: DataFrame, kinds: Sequence[str] = DEFAULT_KINDS, mode: str = "pseudonym", salt: str = "",
    scope: Sequence[str] = ("session_id",), order: Sequence[str] = ("seq",), column: str = "text",
) -> DataFrame:
    """lines with the personal data of column replaced, and n_redacted.

    A pseudonym numbers the values of a kind by first appearance within scope, so that numbering is spread over
    the scopes; the other modes need no shuffle. scope and order identify a line and are not null.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; known: {', '.join(MODES)}")

    @F.pandas_udf(SCHEMA)
    def match(texts: pd.Series) -> pd.Series:
        return pd.Series([spans(t, kinds) for t in texts])

    found = lines.withColumn("_spans", match(column))
    key = lambda v: F.lower(F.trim(v))
    if mode == "pseudonym":
        at = [*scope, *order]
        each = found.where(F.size("_spans") > 0).select(*at, F.explode("_spans").alias("p")).select(*at, "p.start", "p.end", "p.kind", key(F.col("p.value")).alias("key"))
        first = each.groupBy(*scope, "kind", "key").agg(F.min(F.struct(*order, "start")).alias("first"))
        number = F.row_number().over(W.partitionBy(*scope, "kind").orderBy("first"))
        alias = F.concat(F.lit("["), F.upper("kind"), F.lit("_"), number.cast("string"), F.lit("]"))
        names = first.select(*scope, "kind", "key", alias.alias("alias"))
        pieces = each.join(names, [*scope, "kind", "key"]).groupBy(*at).agg(F.array_sort(F.collect_list(F.struct("start", "end", "alias"))).alias("_pieces"))
        found = found.drop("_spans").join(pieces, at, "left")
    else:
        alias = {
            "hash": lambda p: F.concat(F.lit("["), F.upper(p["kind"]), F.lit(":"), F.substring(F.sha2(F.concat(F.lit(salt), key(p["value"])), 256), 1, 8), F.lit("]")),
            "mask": lambda p: F.repeat(F.lit("█"), F.greatest(F.lit(4), F.least(F.length(p["value"]), F.lit(12)))),
            "label": lambda p: F.concat(F.lit("["), F.upper(p["kind"]), F.lit("]")),
        }[mode]
        found = found.withColumn("_pieces", F.transform("_spans", lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), alias(p).alias("alias"))))
    text = F.when(F.size(F.coalesce("_pieces", F.array())) > 0, _splice(F.col(column), F.col("_pieces"))).otherwise(F.col(column))
    n = F.when(F.col("_pieces").isNull(), 0).otherwise(F.size("_pieces"))
    return found.withColumn("n_redacted", n).withColumn(column, text).select(*lines.columns, "n_redacted")


def redact_together(
    tables: dict[str, tuple[DataFrame, Sequence[str], Sequence[str]]], kinds: Sequence[str] = DEFAULT_KINDS, scope: Sequence[str] = ("session_id",), counted: bool = False,
) -> dict[str, DataFrame]:
    """Several tables under one set of pseudonyms: {name: (rows, columns to redact, columns that order its rows)} -> the
    same tables with these columns redacted, and n_redacted if counted.

    Values are numbered, by kind and scope, as they first come, tables and columns in the order given. Only texts
    that may hold something go to Python; their pseudonyms are joined value by value, so that a scope may have any
    number of them, and come back to the rows by scope and text.
    """

    @F.pandas_udf(SCHEMA)
    def match(texts: pd.Series) -> pd.Series:
        return pd.Series([spans(t, kinds) for t in texts])

    key = lambda v: F.lower(F.trim(v))
    to = [F.col(s).alias(f"_scope_{i}") for i, s in enumerate(scope)]
    same = reduce(lambda x, y: x & y, [F.col(s).eqNullSafe(F.col(f"_scope_{i}")) for i, s in enumerate(scope)], F.lit(True))
    each, parts = None, {}
    for t, (name, (rows, columns, order)) in enumerate(tables.items()):
        for i, c in enumerate(columns):
            place = F.struct(F.lit(t).alias("t"), F.concat_ws("\x1f", *[F.lpad(F.col(o).cast("string"), 20, "0") for o in order]).alias("o"), F.lit(i).alias("i"))
            texts = rows.where(likely(F.col(c), kinds)).groupBy(*scope, F.col(c).alias("_text")).agg(F.min(place).alias("place"))
            part = texts.select("*", F.explode(match("_text")).alias("p")).select(*scope, "_text", "place", "p.start", "p.end", "p.kind", key(F.col("p.value")).alias("key"))
            parts[name, c] = part
            part = part.select(*scope, "kind", "key", F.struct("place", "start").alias("at"))
            each = part if each is None else each.unionByName(part)
    first = each.groupBy(*scope, "kind", "key").agg(F.min("at").alias("first"))
    number = F.row_number().over(W.partitionBy(*scope, "kind").orderBy("first"))
    alias = F.concat(F.lit("["), F.upper("kind"), F.lit("_"), number.cast("string"), F.lit("]"))
    names = first.select(*to, F.col("kind").alias("_kind"), F.col("key").alias("_key"), alias.alias("alias"))
    out = {}
    for name, (rows, columns, _) in tables.items():
        held = reduce(lambda x, y: x | y, [likely(F.col(c), kinds) for c in columns]) if columns else F.lit(False)
        done, n = rows.where(held), F.lit(0)
        for i, c in enumerate(columns):
            part = parts[name, c]
            named = part.join(names, same & (F.col("kind") == F.col("_kind")) & (F.col("key") == F.col("_key")))
            named = named.select(*[f"_scope_{k}" for k in range(len(scope))], "_text", F.struct("start", "end", "alias").alias("piece"))
            pieces = named.groupBy(*[f"_scope_{k}" for k in range(len(scope))], "_text").agg(F.array_sort(F.collect_list("piece")).alias(f"_pieces_{i}"))
            done = done.join(pieces, same & (F.col(c) == F.col("_text")), "left").drop("_text", *[f"_scope_{k}" for k in range(len(scope))])
        for i, c in enumerate(columns):
            n = n + F.when(F.col(f"_pieces_{i}").isNull(), 0).otherwise(F.size(f"_pieces_{i}"))
        texts = {c: F.when(F.col(f"_pieces_{i}").isNotNull(), _splice(F.col(c), F.col(f"_pieces_{i}"))).otherwise(F.col(c)) for i, c in enumerate(columns)}
        done = done.withColumns({"n_redacted": n, **texts}).select(*rows.columns, "n_redacted").unionByName(rows.where(~held).withColumn("n_redacted", F.lit(0)))
        out[name] = done if counted else done.select(*rows.columns)
    return out


def removals(lines: DataFrame, kinds: Sequence[str] = DEFAULT_KINDS, column: str = "text") -> DataFrame:
    """What redact() takes out of column: the other columns, kind, start, end, length, never the value."""

    @F.pandas_udf(SCHEMA)
    def match(texts: pd.Series) -> pd.Series:
        return pd.Series([spans(t, kinds) for t in texts])

    others = [F.col(f"`{c}`") for c in lines.columns if c != column]
    found = lines.select(*others, F.explode(match(F.col(column))).alias("_p"))
    return found.select(*others, "_p.kind", "_p.start", "_p.end", (F.col("_p.end") - F.col("_p.start")).alias("length"))


def counts(lines: DataFrame, kinds: Sequence[str] = DEFAULT_KINDS, by: Sequence[str] = ("session_id",)) -> DataFrame:
    return removals(lines, kinds).groupBy(*by, "kind").agg(F.count("*").alias("removed"))


def merged_counts(entity_counts: DataFrame) -> DataFrame:
    """Counts (session_id, kind, text, n) of redacted entities: those that share an alias are one."""
    return entity_counts.groupBy("session_id", "kind", "text").agg(F.sum("n").alias("n"))
