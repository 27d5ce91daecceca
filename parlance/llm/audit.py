"""How filters overlap: what each removes first, again or alone in every order, and its share by Shapley.

The documents of a part are counted by the set (mask) of filters that they fail. With x_i the chance that filter i is on,
the number removed is the multilinear polynomial sum over masks of n * (1 - product of (1 - x_i) over the mask). Its
corners (each x 0 or 1) say what any set of filters removes, and with that the survivors of every step. A filter's
Shapley value is the integral of the polynomial's derivative by its x along the diagonal from 0 to 1.
"""

from __future__ import annotations

from collections import Counter
from fractions import Fraction
from itertools import permutations
from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import materialise, table

FILTERS = "ABCDE"
MIN_WORDS = 100
#: Least share of distinct words and largest share of capitals, in hundredths.
MIN_DISTINCT, MAX_CAPITALS = 80, 10
ODD = "[#$%&*|]"

Polynomial = dict[int, int]  # set of variables, as a mask -> coefficient


def removal(counts: dict[int, int]) -> Polynomial:
    """What is removed as a polynomial of the filters' variables, from the number of documents of each mask."""
    out: Counter = Counter()
    for mask, n in counts.items():
        sub = mask
        while sub:  # 1 - product of (1 - x) has (-1) ** (size + 1) at every subset but the empty one
            out[sub] += n if sub.bit_count() % 2 else -n
            sub = (sub - 1) & mask
    return out


def corner(poly: Polynomial, on: int) -> int:
    """The value with the variables in on at 1 and the others at 0."""
    return sum(c for mask, c in poly.items() if mask & ~on == 0)


def derivative(poly: Polynomial, i: int) -> Polynomial:
    return {mask ^ 1 << i: c for mask, c in poly.items() if mask >> i & 1}


def diagonal_integral(poly: Polynomial) -> Fraction:
    """The integral from 0 to 1 of the polynomial with all variables equal to t."""
    return sum((Fraction(c, mask.bit_count() + 1) for mask, c in poly.items()), Fraction(0))


def audit_part(masks: list[int], totals: list[int], good: list[int], toxic: list[int], names: str = FILTERS) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for all orders of one part."""
    k = len(names)
    every = sum(totals)
    gone, gone_good, gone_toxic = (removal(dict(zip(masks, n, strict=True))) for n in (totals, good, toxic))
    corners = [[corner(p, on) for on in range(1 << k)] for p in (gone, gone_good, gone_toxic)]
    whole = (1 << k) - 1
    shapley = [factorial(k) * diagonal_integral(derivative(gone, i)) for i in range(k)]
    alone = [corners[0][whole] - corners[0][whole ^ 1 << i] for i in range(k)]
    out = []
    for order in permutations(range(k)):
        on = 0
        for step, i in enumerate(order, 1):
            after = on | 1 << i
            removed, good_lost, toxic_lost = (c[after] - c[on] for c in corners)
            redundant = corners[0][1 << i] - removed
            out.append(("".join(names[j] for j in order), step, every - corners[0][after], removed, redundant, alone[i], good_lost, toxic_lost, int(shapley[i])))
            on = after
    return out


def quality_mask(text: Column) -> Column:
    """Filters A to D that text fails, as bits 0 to 3: few words, few distinct ones, many capitals, odd characters."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    sizes = F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("distinct")))
    n, distinct = F.get(sizes, F.lit(0))["n"], F.get(sizes, F.lit(0))["distinct"]
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = [n < MIN_WORDS, 100 * distinct < MIN_DISTINCT * n, 100 * capitals.cast("long") > MAX_CAPITALS * F.length(text).cast("long"), text.rlike(ODD)]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, lang, text), labels (doc_id, quality, toxic) -> (part, mask, n, good, toxic), one row for each mask
    that a part has. Texts are read once and only their hash is shuffled.

    Rows of one text, or one id, may be a third of all: equal rows are added up first, the smallest id of each text is
    joined by text and id together, and null ids are dealt by their text.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), quality_mask(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("h"))
    rows = materialise(rows.groupBy("doc_id", "part", "mask", "h").agg(F.count("*").alias("n")))
    first = rows.where("doc_id is not null").groupBy("h").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    labels = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    labels = labels.select(F.col("doc_id").alias("key"), F.lit(b"").alias("spread"), "good", "toxic")
    rows = rows.join(first, ["h", "doc_id"], "left").withColumn("key", F.coalesce("doc_id", F.lit(0))).withColumn("spread", F.when(F.col("doc_id").isNull(), F.col("h")).otherwise(F.lit(b"")))
    rows = rows.join(labels, ["key", "spread"], "left")
    copy = F.when(F.col("doc_id").isNull() | F.coalesce("is_first", F.lit(False)), 0).otherwise(1 << FILTERS.index("E"))
    counted = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c)
    return rows.groupBy("part", (F.col("mask") + copy).alias("mask")).agg(counted("good"), counted("toxic"), F.sum("n").alias("n"))


_COLUMNS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, lang, text) and labels (doc_id, quality, toxic) -> _COLUMNS, 600 rows for each lang.

    A null lang is the part "", a null text is empty, a text of any length is judged whole. A text equal to that of a
    smaller id fails E; rows of the same smallest id and text all pass, and a null id neither fails E nor lets others
    fail. A label counts for every row of its id; of several labels of one id the largest do. Other columns are
    ignored, an empty table gives no rows.
    """
    masks = mask_counts(docs, labels).groupBy("part").agg(*[F.collect_list(c).alias(c) for c in ("mask", "n", "good", "toxic")])  # 32 masks at most

    def audit(batches):
        for batch in batches:
            for r in batch.itertuples():
                rows = audit_part(*[[int(x) for x in c] for c in (r.mask, r.n, r.good, r.toxic)])
                yield pd.DataFrame([(r.part, *x) for x in rows], columns=[c.split()[0] for c in _COLUMNS.split(", ")])

    return masks.mapInPandas(audit, _COLUMNS)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return audit_filters(docs, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


_ORDERS = ", ".join(f"('{''.join(o)}')" for o in permutations(FILTERS))
OP11_SQL = rf"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
lab AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
fails AS (
  SELECT part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
         len(words) < {MIN_WORDS} AS A, 100 * len(list_distinct(words)) < {MIN_DISTINCT} * len(words) AS B,
         100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > {MAX_CAPITALS} * length(text) AS C, regexp_matches(text, '{ODD}') AS D,
         coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false) AS E
  FROM docs d LEFT JOIN lab l USING (doc_id)),
orders(filter_order) AS (VALUES {_ORDERS}),
steps AS (SELECT filter_order, CAST(s AS INT) AS step, substr(filter_order, 1, s - 1) AS before, substr(filter_order, s, 1) AS f FROM orders, range(1, 6) t(s)),
letters AS (
  SELECT part, good, toxic, (CASE WHEN A THEN 'A' ELSE '' END) || (CASE WHEN B THEN 'B' ELSE '' END) || (CASE WHEN C THEN 'C' ELSE '' END)
         || (CASE WHEN D THEN 'D' ELSE '' END) || (CASE WHEN E THEN 'E' ELSE '' END) AS failed, count(*) AS n
  FROM fails GROUP BY ALL),
judged AS (
  SELECT *, contains(failed, f) AS fails, length(translate(failed, before, '')) < length(failed) AS gone FROM letters, steps),
counts AS (
  SELECT part, filter_order, step, f, sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed = f THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN NOT gone AND fails AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND fails AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM judged GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counts
"""
