"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are dealt by blocks of bits, of which linked ones must share some (pigeonhole), so that every
group fits a task. In each task a forest is built over the groups: fingerprints in Gray rank order are the
leaves, a node above holds the bits that all fingerprints below share (its mask and pattern). The self-join
walks pairs of nodes from the roots; the differences on bits that both share add up along the way, and a pair
of whole groups is given up as soon as they exceed the limit, or when all in them are linked already.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from parlance.llm.common import components, fresh, materialise, table

SHINGLE = 4
BITS = 4
FANOUT = 8
#: Fingerprints of one group that one task joins; larger groups are dealt out as pairs of chunks of this size.
GROUP_LIMIT = 50_000
#: Pairs of nodes that are expanded at once.
FRONTIER = 100_000
#: Farthest neighbour in Gray order that is tried before the walk (1, 2, 4, ... up to it).
NEIGHBOURS = 64
#: Fingerprints that an average group should hold at most; decides into how many blocks the bits are cut.
GROUP_AIM = 256

#: Hashes of a text whose bits are counted at once.
STEP = 255 * 16

_ALL = 0xFFFFFFFFFFFFFFFF


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles, repeats included. A-Z count as a-z, ASCII white space separates words;
    fewer words than a shingle are one shingle, no words none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)], "<u8")


def majorities(hashes: np.ndarray) -> np.ndarray:
    """For each row of hashes (views, n): bit i is 1 if it is set in over half of them; 0 without hashes. The bits of
    STEP hashes a row are laid open at once, however many there are."""
    rows, n = hashes.shape
    if n == 0:
        return np.zeros(rows, "<u8")
    sums = np.zeros((rows, 64), np.int64)
    for i in range(0, n, STEP):
        part = np.ascontiguousarray(hashes[:, i : i + STEP], "<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(rows, -1, 8), axis=2, bitorder="little")
        for k in range(0, bits.shape[1], 255):
            sums += bits[:, k : k + 255].sum(1, dtype=np.uint8)
    return np.packbits(sums * 2 > n, axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    return int(views(shingle_hashes(text, shingle), 1)[0])


def views(h: np.ndarray, n: int) -> np.ndarray:
    """n independent fingerprints from shingle hashes; the first is the fingerprint, the others come from mixed hashes."""
    mixed = np.tile(h, (n, 1))
    with np.errstate(over="ignore"):
        x = mixed[1:]
        x ^= (np.arange(1, n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
        for c in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            x ^= x >> np.uint64(30)
            x *= np.uint64(c)
        x ^= x >> np.uint64(31)
    return majorities(mixed)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, n: int = 1) -> DataFrame:
    """docs with text -> its other columns and fp0 long to fp(n-1) long (the 64 bits as signed numbers)."""
    others = docs.drop("text")
    schema = T.StructType([*others.schema.fields, *[T.StructField(f"fp{i}", T.LongType()) for i in range(n)]])

    def run(batches):
        for batch in batches:
            fps = np.array([views(shingle_hashes(x.as_py(), shingle), n) for x in batch["text"]], np.uint64).reshape(-1, n).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in schema.names[:-n]], *[pa.array(fps[:, i]) for i in range(n)]], schema.names)

    return docs.mapInArrow(run, schema)


def masks(n: int, bits: int = BITS, aim: int = GROUP_AIM) -> list[int]:
    """Masks of which any two numbers with at most `bits` different bits of 64 share one in full.

    The 64 bits are cut into bits + k blocks and each mask holds k of them; k grows until n fingerprints,
    if they were spread evenly, come to `aim` a group.
    """
    for k in range(1 if bits <= 4 else 2, 6):
        blocks = bits + k
        edges = [64 * i // blocks for i in range(blocks + 1)]
        block = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(blocks)]
        if n / 2 ** (64 * k // blocks) <= aim or k == 5:
            break
    return [sum(c) for c in combinations(block, k)]


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray order."""
    out = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


class Forest:
    """The hierarchical index over groups of codes, sorted by (group, Gray rank). Levels go from the leaves up."""

    def __init__(self, codes: np.ndarray, groups: np.ndarray):
        self.n = len(codes)
        self.group = groups
        self.pattern, self.mask = [codes], [np.full(len(codes), _ALL, np.uint64)]
        self.first: list[np.ndarray] = [np.arange(len(codes) + 1)]  # leaves below node i: first[i] to first[i + 1]
        self.child: list[np.ndarray] = []  # children of node i one level down, likewise
        group = groups
        while True:
            begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            if len(begins) == len(group):
                break
            place = np.arange(len(group)) - np.repeat(begins, np.diff(np.append(begins, len(group))))
            start = np.flatnonzero(place % FANOUT == 0)
            ones = np.bitwise_and.reduceat(self.pattern[-1] & self.mask[-1], start)
            zeros = np.bitwise_and.reduceat(~self.pattern[-1] & self.mask[-1], start)
            self.child.append(np.append(start, len(group)))
            self.first.append(self.first[-1][self.child[-1]])
            self.pattern.append(ones)
            self.mask.append(ones | zeros)
            group = group[start]

    def links(self, bits: int) -> np.ndarray:
        """Label of each leaf: equal for leaves that a chain of links within their group joins.

        Leaves close in Gray rank are tried first: what they link, the walk need not open again.
        """
        label = np.arange(self.n)
        codes = self.pattern[0]
        for step in (1 << k for k in range(NEIGHBOURS.bit_length())):
            near = (np.bitwise_count(codes[:-step] ^ codes[step:]) <= bits) & (self.group[:-step] == self.group[step:])
            a = np.flatnonzero(near)
            label = unite(label, a, a + step)
        top = len(self.child)
        roots = np.arange(len(self.pattern[top]))
        stack = [(top, roots, roots)]
        uniform: dict[int, np.ndarray] = {}
        while stack:
            level, a, b = stack.pop()
            if len(a) > FRONTIER:
                stack.append((level, a[FRONTIER:], b[FRONTIER:]))
                a, b = a[:FRONTIER], b[:FRONTIER]
            differ = (self.pattern[level][a] ^ self.pattern[level][b]) & self.mask[level][a] & self.mask[level][b]
            keep = np.bitwise_count(differ) <= bits
            if level:
                if level not in uniform:
                    start = self.first[level][:-1]
                    low, high = np.minimum.reduceat(label, start), np.maximum.reduceat(label, start)
                    uniform[level] = np.where(low == high, low, -1 - np.arange(len(low)))
                same = uniform[level]
                keep &= (same[a] != same[b]) | (same[a] < 0)
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            if level:
                stack.append((level - 1, *self._expand(level, a, b)))
            else:
                differ = label[a] != label[b]
                if differ.any():
                    label = unite(label, a[differ], b[differ])
                    uniform = {}
        return label

    def _expand(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of children of pairs of nodes, each pair once."""
        child = self.child[level - 1]
        na, nb = child[a + 1] - child[a], child[b + 1] - child[b]
        pair = np.repeat(np.arange(len(a)), na * nb)
        inner = np.arange(len(pair)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
        x, y = child[a][pair] + inner // nb[pair], child[b][pair] + inner % nb[pair]
        keep = (a[pair] != b[pair]) | (x < y if level == 1 else x <= y)
        return x[keep], y[keep]


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking a[i] with b[i]; the smaller label stays."""
    parent = np.arange(len(label))
    while True:
        x, y = parent[label[a]], parent[label[b]]
        if (x == y).all():
            return parent[label]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent[parent] != parent).any():
            parent = parent[parent]


def near_edges(fps: DataFrame, bits: int = BITS, limit: int = GROUP_LIMIT) -> DataFrame:
    """fps (view int, fp long, distinct) -> edges (view, a, b) that join all of a view with at most `bits`
    different bits.

    Each group gives a spanning forest of its links, not all pairs. A group over `limit` is cut into chunks by
    hash and each pair of chunks is a task's group, which joins the same fingerprints and stays exact.
    """
    held = masks(fps.groupBy("view").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0], bits)
    signed = [m - 2**64 if m >= 2**63 else m for m in held]
    keyed = fps.select("fp", "view", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("m", "key"))
    keyed = keyed.withColumn("m", F.col("view") * len(held) + F.col("m")).drop("view")
    large = materialise(keyed.groupBy("m", "key").agg(F.count("*").alias("n")).where(F.col("n") > limit))
    if large.isEmpty():
        keyed = keyed.withColumn("part", F.lit(0))
    else:  # at most a limit-th of the rows have a row here; joined without a hint
        chunks = F.ceil(F.col("n") * 2 / limit).cast("int")
        mine = F.pmod(F.xxhash64("fp"), chunks).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), chunks - 1), lambda c: F.least(c, mine) * 65536 + F.greatest(c, mine))
        keyed = keyed.join(large, ["m", "key"], "left").select("fp", "m", "key", F.explode(F.when(F.col("n").isNull(), F.array(F.lit(0))).otherwise(pairs)).alias("part"))
    keyed = keyed.repartition(F.col("m"), F.col("key"), F.col("part")).select("fp", F.col("m").cast("short").alias("m"), "part")
    table_of_masks = np.array(held, np.uint64)

    def join(batches):
        parts = [(b["fp"].to_numpy(), b["m"].to_numpy(), b["part"].to_numpy()) for b in batches]
        if not parts:
            return
        fp, m, part = (np.concatenate(x) for x in zip(*parts, strict=True))
        fp = np.ascontiguousarray(fp).view(np.uint64)
        key = fp & table_of_masks[m % len(table_of_masks)]
        order = np.lexsort((gray_rank(fp), part, key, m))
        fp, m, part, key = fp[order], m[order], part[order], key[order]
        group = np.cumsum(np.concatenate([[False], (m[1:] != m[:-1]) | (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
        several = np.bincount(group)[group] > 1
        if not several.any():
            return
        fp, group, view = fp[several], group[several], m[several] // len(table_of_masks)
        label = Forest(fp, group).links(bits)
        linked = np.flatnonzero(label != np.arange(len(label)))
        values = fp.view(np.int64)
        for i in range(0, len(linked), 100_000):
            at = linked[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(view[at].astype(np.int32)), pa.array(values[at]), pa.array(values[label[at]])], ["view", "a", "b"])

    return keyed.mapInArrow(join, "view int, a long, b long")


def thin(edges: DataFrame) -> DataFrame:
    """Fewer edges (a, b) that join the same: each task joins what it has, and gives every node of it one edge to the
    smallest node of its component there.

    An a has at most one b for each view and mask (near_edges), so its array is bounded; the many b of a dense group
    mostly are the same few.
    """

    def forest(batches):
        parts = [(b["a"].to_numpy(), b["to"]) for b in batches]
        if not parts:
            return
        x = np.concatenate([np.repeat(a, np.diff(to.offsets.to_numpy())) for a, to in parts])
        y = np.concatenate([to.flatten().to_numpy() for _, to in parts])
        nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
        label = unite(np.arange(len(nodes)), at[: len(x)], at[len(x) :])
        tied = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[tied], pa.int64()), pa.array(nodes[label[tied]], pa.int64())], ["a", "b"])

    grouped = edges.groupBy("a").agg(F.collect_set("b").alias("to"))
    return grouped.mapInArrow(forest, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fingerprint, component_id.

    component_id is the smallest doc_id reachable by links of fingerprints with at most `bits` different bits.
    Null and empty texts have fingerprint zero, linked like any other. Null ids count as no id: such a row gets
    its component's smallest id, null if it has none. Each row gives one row; other columns are ignored.
    """
    prints = materialise(fingerprints(docs.select("doc_id", "text"), shingle).withColumnRenamed("fp0", "fp"))
    fps = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(near_edges(fps.select(F.lit(0).alias("view"), "fp"), bits).select("a", "b"))
    rooted = fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_rows(docs: DataFrame, prints: DataFrame, links: DataFrame) -> DataFrame:
    """The first row of each group of docs. prints (doc_id, th, node) has a row for each row of docs, th the hash of
    its text; links (a, b) join nodes. The row with the smallest doc_id stays (one without id only if its group has
    none); of rows that share it the one with the smallest hash of the text and then of the other columns."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    mark = F.xxhash64("text")
    roots = components(thin(links)).withColumnRenamed("node", "of")
    rooted = prints.join(roots, F.col("node") == F.col("of"), "left").withColumn("root", F.coalesce("root", "node"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "th")).alias("x")
    chosen = materialise(rooted.groupBy("root").agg(first).select(F.col("x.id").alias("_id"), F.col("x.th").alias("_th")).distinct())
    again = prints.groupBy("doc_id", "th").agg(F.count("*").alias("rows")).where("rows > 1")
    again = materialise(again.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")))
    same = lambda ids: docs["doc_id"].eqNullSafe(ids["_id"]) & (mark == ids["_th"])
    kept = docs.join(chosen, same(chosen), "left_semi")
    if again.isEmpty():
        return kept
    order = W.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in others]) if others else F.lit(0))
    nth = fresh(docs, "_nth")
    repeated = kept.join(again, same(again), "left_semi").withColumn(nth, F.row_number().over(order))
    return kept.join(again, same(again), "left_anti").unionByName(repeated.where(F.col(nth) == 1).drop(nth))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))

