"""Named things in lines, by patterns, with their offsets."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Label, kind, pattern and the group that is the entity, in order of precedence.
PATTERNS = (
    ("ORG", "organization", r"\b([A-Z][A-Za-z0-9&.\-]*(?:\s+[A-Z][A-Za-z0-9&.\-]*)*)\s+(Inc|LLC|Ltd|Corp|Corporation|Company|GmbH|PLC|Group|Labs|Technologies|Systems)\b", 0),
    ("PERSON", "person", r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.?\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)", 1),
    ("MONEY", "money", r"(?i)[$€£]\s?\d[\d,]*(?:\.\d+)?(?:\s?(?:k|m|bn|million|billion))?", 0),
    ("PERCENT", "percent", r"(?i)\b\d+(?:\.\d+)?\s?(?:%|percent)\b", 0),
    ("EMAIL", "contact", r"\b[\w.+-]+@[\w-]+\.[\w.]+\b", 0),
    ("URL", "link", r"\bhttps?://\S+\b", 0),
    ("PERSON", "person", r"\b(?=([A-Z][a-z]{2,}\s+[A-Z][a-z]{2,})\b)", 1),
)
# Words that begin a sentence rather than a name.
NOT_NAMES = frozenset(
    """
    email call text remind ask tell send ship review check follow meet let please can could
    would should will shall the this that these those there here what when where which who
    why how our your their his her its every each some many most next last first second
    good great morning afternoon evening hello thanks thank sorry maybe perhaps also but and
    before after during until while because since though although however therefore
    monday tuesday wednesday thursday friday saturday sunday today tomorrow yesterday
    january february march april may june july august september october november december
    """.split()
)

SCHEMA = "array<struct<text:string,label:string,kind:string,start:int,end:int>>"
_compiled = [(label, kind, re.compile(p), group) for label, kind, p, group in PATTERNS]


def find(text: str | None) -> list[dict]:
    """Entities by start; one that overlaps an earlier pattern's is left out."""
    taken: list[dict] = []
    for rank, (label, kind, pattern, group) in enumerate(_compiled):
        for m in pattern.finditer(text or ""):
            start, end = m.span(group)
            name = m[group].strip()
            if rank == len(_compiled) - 1 and name.split()[0].lower() in NOT_NAMES:
                continue
            if all(end <= t["start"] or start >= t["end"] for t in taken):
                taken.append({"text": name, "label": label, "kind": kind, "start": start, "end": end})
    return sorted(taken, key=lambda t: t["start"])


def matched(text: Column) -> Column:
    """SCHEMA of a text."""

    @F.pandas_udf(SCHEMA)
    def match(texts: pd.Series) -> pd.Series:
        return pd.Series([find(t) for t in texts])

    return match(text)


def extract(lines: DataFrame) -> DataFrame:
    """lines with text -> one row for each entity: the other columns of lines, entity, label, kind, start, end.

    Lines without a capital letter, an address or an amount are dropped before Python sees them.
    """
    likely = lines.where(F.col("text").rlike(r"[A-Z$€£%@]|://|(?i:percent)"))
    others = [F.col(f"`{c}`") for c in lines.columns if c != "text"]
    found = likely.select("*", F.explode(matched(F.col("text"))).alias("_hit"))
    return found.select(*others, F.col("_hit.text").alias("entity"), "_hit.label", F.col("_hit.kind").alias("kind"), "_hit.start", "_hit.end")
