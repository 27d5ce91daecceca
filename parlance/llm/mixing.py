"""Mixing sources to target weights.

Documents are aggregated by membership pattern (the set of sources that hold them), a min-cost flow
routes the token capacity of each pattern to the quotas of its sources, repetition costing more with
each further copy, and seeded hashes then pick the documents that make up each pattern's flow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from parlance.llm.common import materialise, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3
SEED = 11
#: Patterns and sources that the driver's flow may hold (about 1 KB each). They are counted before they are collected.
MAX_PATTERNS = 1_000_000
#: Bits of the seeded hash by which one selection step narrows the boundary of a pattern.
STEP_BITS = 12
HASH_BITS = 60


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def seeded_hash(doc_id: Column, seed: int = SEED) -> Column:
    """60 bits of md5 over seed and id: the same in any engine, on any rerun."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size) -> the same with target: weights cycle over sources by code point, null last.

    Water filling: the sources that reach max_copies times their size first (by that cap over weight)
    stop there, the others share the rest by weight. Sources number at most MAX_PATTERNS.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    number = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), number + 1)
    s = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size").cast("double") * max_copies)
    rank = W.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before, rest = rank.rowsBetween(W.unboundedPreceding, -1), rank.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    s = s.withColumn("left_over", F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("left_w", F.sum("w").over(rest))
    s = s.withColumn("open", F.col("left_over") * F.col("w") <= F.col("cap") * F.col("left_w"))
    s = s.withColumn("level", F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("w"), "left_over", "left_w"))).over(everything))
    s = s.withColumn("is_open", F.max(F.col("open").cast("int")).over(rank.rowsBetween(W.unboundedPreceding, 0)) == 1)
    shared = F.col("level.left_over") * F.col("w") / F.col("level.left_w")
    return s.select("source", "source_size", F.when(F.col("is_open"), shared).otherwise(F.col("cap")).alias("target"))


def route(patterns: dict[int, tuple[list[int], int]], quotas: dict[int, int], max_copies: int = MAX_COPIES) -> dict[tuple[int, int], int]:
    """Min-cost flow of tokens from patterns to quotas: {(pattern, source): tokens}.

    patterns: id -> (sources, tokens). The k-th copy of a pattern's tokens costs k * k a token. As nothing else costs,
    a cheapest path costs what its copy costs: the flow of first copies is made as large as can be, then second
    copies are let in and it is augmented, and so on; each of these is a largest flow by blocking flows along
    shortest paths. Arcs are taken in the order of the numbers, so reruns agree.
    """
    order, names = sorted(patterns), sorted(quotas)
    place = {s: len(order) + i for i, s in enumerate(names)}
    n = len(order) + len(names)
    begin, to, flow, back = [0], [], [], []
    of_source: list[list[int]] = [[] for _ in names]
    for i, p in enumerate(order):
        for s in sorted(set(patterns[p][0]) & quotas.keys()):
            of_source[place[s] - len(order)].append(len(to))
            to.append(place[s])
            back.append(i)
            flow.append(0)
        begin.append(len(to))
    supply, quota = [0] * len(order), [quotas[s] for s in names]
    for _ in range(max_copies):
        for i, p in enumerate(order):
            supply[i] += patterns[p][1]
        while True:
            depth = [-1] * n
            front = [i for i in range(len(order)) if supply[i]]
            for i in front:
                depth[i] = 0
            reached = False
            while front and not reached:
                following = []
                for v in front:
                    if v < len(order):
                        steps = to[begin[v] : begin[v + 1]]
                    else:
                        steps = [back[e] for e in of_source[v - len(order)] if flow[e]]
                    for w in steps:
                        if depth[w] < 0:
                            depth[w] = depth[v] + 1
                            following.append(w)
                            reached |= w >= len(order) and quota[w - len(order)] > 0
                front = following
            if not reached:
                break
            _block(order, begin, to, back, of_source, flow, supply, quota, depth)
    return {(order[back[e]], names[to[e] - len(order)]): f for e, f in enumerate(flow) if f}


def _block(order, begin, to, back, of_source, flow, supply, quota, depth) -> None:
    """A blocking flow along the layers of depth: paths are grown arc by arc, arcs that lead nowhere are left behind."""
    first = len(order)
    at = begin[:-1] + [0] * len(quota)
    for root in range(first):
        while supply[root] and depth[root] == 0:
            path, v = [], root  # (arc, forward)
            while v < first or not quota[v - first]:
                if v < first:
                    while at[v] < begin[v + 1] and depth[to[at[v]]] != depth[v] + 1:
                        at[v] += 1
                    if at[v] < begin[v + 1]:
                        path.append((at[v], True))
                        v = to[at[v]]
                        continue
                else:
                    arcs = of_source[v - first]
                    while at[v] < len(arcs) and (not flow[arcs[at[v]]] or depth[back[arcs[at[v]]]] != depth[v] + 1):
                        at[v] += 1
                    if at[v] < len(arcs):
                        path.append((arcs[at[v]], False))
                        v = back[arcs[at[v]]]
                        continue
                if not path:  # nothing leads on from the root
                    depth[root] = -1
                    break
                arc, forward = path.pop()
                v = back[arc] if forward else to[arc]
                at[v] += 1
            else:
                push = min([supply[root], quota[v - first], *(flow[e] for e, forward in path if not forward)])
                supply[root] -= push
                quota[v - first] -= push
                for e, forward in path:
                    flow[e] += push if forward else -push


def mix(docs: DataFrame, quotas: DataFrame, max_copies: int = MAX_COPIES, seed: int = SEED) -> DataFrame:
    """docs (doc_id, size, sources array<string>) and quotas (source, target) -> docs with copies.

    A pattern's tokens F are met by whole documents: F div size copies of each, and one more of those
    with the smallest seeded hash until the rest is met (the last one is taken if that comes nearer).
    The boundary is found by two passes of per-pattern sums over 4,096 hash ranges each; only the rows of
    the last range (about one row in 16 million of a pattern, or equal ids) are put in order one by one,
    so no task holds a pattern. Null in sources stands for the null source. Size 0 takes no copy.
    """
    spark = docs.sparkSession
    docs = docs.withColumn("sources", F.array_sort(F.array_distinct("sources")))
    totals = materialise(docs.groupBy("sources").agg(F.sum("size").alias("tokens")))
    if totals.count() > MAX_PATTERNS or quotas.count() > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns or sources")
    patterns = sorted(((list(r.sources), int(r.tokens)) for r in totals.collect()), key=lambda x: [(s is None, s or "") for s in x[0]])
    names = sorted({r.source for r in quotas.select("source").collect()}, key=lambda s: (s is None, s or ""))
    number = {s: i for i, s in enumerate(names)}
    limits = {number[r.source]: int(round(r.target)) for r in quotas.collect()}
    flow = route({i: ([number[s] for s in p if s in number], n) for i, (p, n) in enumerate(patterns) if n}, limits, max_copies)
    routed: dict[int, int] = {}
    for (p, _), n in flow.items():
        routed[p] = routed.get(p, 0) + n
    schema = T.StructType.fromDDL("sources array<string>, pattern int, whole int, rest long")
    rows = [(p, i, *(divmod(routed.get(i, 0), n) if n else (0, 0))) for i, (p, n) in enumerate(patterns)]
    plan = F.broadcast(spark.createDataFrame(rows, schema))
    h = materialise(docs.join(plan, "sources").withColumn("h", seeded_hash(F.col("doc_id"), seed)).select("doc_id", "size", "pattern", "whole", "rest", "h"))
    edge = plan.select("pattern", F.lit(0).cast("long").alias("prefix"), "rest")
    for step in (1, 2):
        shift = HASH_BITS - step * STEP_BITS
        cut = F.shiftright("h", shift)
        inside = h.drop("rest").join(F.broadcast(edge), "pattern").where(F.shiftright("h", shift + STEP_BITS) == F.col("prefix"))
        sums = inside.groupBy("pattern", "rest", cut.alias("bin")).agg(F.sum("size").alias("n"))
        upto = F.sum("n").over(W.partitionBy("pattern").orderBy("bin"))
        edge = (
            sums.withColumn("upto", upto).where(F.col("upto") > F.col("rest"))
            .groupBy("pattern").agg(F.min(F.struct("bin", (F.col("rest") - F.col("upto") + F.col("n")).alias("rest"))).alias("e"))
            .select("pattern", F.col("e.bin").alias("prefix"), F.col("e.rest").alias("rest"))
        )
        edge = materialise(edge)
    shift = HASH_BITS - 2 * STEP_BITS
    # edge has a row for each pattern at most, so it is as bounded as plan
    h = h.drop("rest").join(F.broadcast(edge.select("pattern", "prefix", "rest")), "pattern", "left")
    place = F.shiftright("h", shift)
    last = h.where(place == F.col("prefix"))
    order = W.partitionBy("pattern").orderBy("h", "doc_id", "size")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    last = last.withColumn("more", F.when(F.col("rest") - before >= F.col("size") / 2, 1).otherwise(0))
    others = h.where(F.col("prefix").isNull() | (place != F.col("prefix")))
    others = others.withColumn("more", F.when(place < F.col("prefix"), 1).otherwise(0))
    copies = F.when(F.col("size") > 0, F.least(F.col("whole") + F.col("more"), F.lit(max_copies))).otherwise(0)
    return others.unionByName(last).select("doc_id", "size", "pattern", copies.cast("int").alias("copies"))


def mix_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_copies: int = MAX_COPIES, seed: int = SEED) -> DataFrame:
    """(doc_id, text, source) -> doc_id, size, source_size, target, taken; each row of docs gives one row.

    Null texts have size 0, the null source comes last, repeated ids are rows of their own, other columns
    are ignored, an empty table gives an empty table.
    """
    sized = materialise(docs.select("doc_id", word_count(F.col("text")).alias("size"), "source"))
    sizes = materialise(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    if sizes.count() > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} sources")
    goal = materialise(targets(sizes, weights, max_copies))
    mixed = mix(sized.select("doc_id", "size", F.array("source").alias("sources")), goal, max_copies, seed)
    by_pattern = goal.withColumn("pattern", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    return mixed.join(F.broadcast(by_pattern), "pattern").select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST(concat('0x', substr(md5(concat('11:', coalesce(CAST(doc_id AS VARCHAR), ''))), 1, 15)) AS BIGINT) AS h
  FROM documents),
sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3.0::DOUBLE * CAST(sum(size) AS DOUBLE) AS cap,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)] AS w
  FROM sized GROUP BY source),
filled AS (
  SELECT *, sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
         sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w
  FROM sizes),
opened AS (
  SELECT *, max(CASE WHEN left_over * w <= cap * left_w THEN 1 ELSE 0 END) OVER (ORDER BY cap / w, source NULLS LAST) AS is_open FROM filled),
level AS (SELECT left_over AS lo, left_w AS lw FROM opened WHERE is_open = 1 ORDER BY cap / w, source NULLS LAST LIMIT 1),
goal AS (
  SELECT source, source_size, CASE WHEN is_open = 1 THEN lo * w / lw ELSE cap END AS target FROM opened LEFT JOIN level ON true),
routed AS (
  SELECT *, CAST(round_even(target, 0) AS BIGINT) AS f FROM goal),
placed AS (
  SELECT s.doc_id, s.size, r.source_size, r.target,
         CASE WHEN r.source_size > 0 THEN r.f // r.source_size ELSE 0 END AS whole,
         CASE WHEN r.source_size > 0 THEN r.f % r.source_size ELSE 0 END AS rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size AS before
  FROM sized s JOIN routed r ON s.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
       CAST(size * least(3, whole + CASE WHEN rest - before >= size / 2.0 AND before < rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed
"""
