"""A Merkle tree over a table: a leaf for each row, a tree of threes for each source, a tree over the sources.

Authentication paths come by Merkle traversal. The leaves of a source, in order, are cut into aligned blocks.
Within a block each level of the path has its run of siblings, and a treehash stack that makes the level's next run while
the leaves of this one pass, so that a path costs a few steps and the memory is that of some runs a level. The roots of
the blocks are the leaves of the next tree, until a source has one root; a block's path there is shared by its leaves and
appended to theirs. The subroots are the leaves of the last tree, handled the same way. Digests are lowercase hex text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.llm.common import materialise, shuffle_partitions, table

ARITY = 3
#: Levels of a block, which has ARITY ** HEIGHT nodes at most.
HEIGHT = 6

Step = tuple[str, str]  # the hex text of the siblings left and right of a node in its run


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Treehash:
    """Makes a run of ARITY nodes of a level, leaf by leaf; of the levels below it holds unfinished runs only."""

    def __init__(self, level: int, start: int, end: int):
        self.level, self.at = level, min(start, end)
        self.end = min(end, start + ARITY ** (level + 1))
        self.runs: list[list[str]] = [[] for _ in range(level + 1)]

    @property
    def done(self) -> bool:
        return self.at == self.end

    def lowest(self) -> int:
        """The level of the lowest node held: the stack that has the lowest one goes first, so that few hold low nodes."""
        return next((level for level, run in enumerate(self.runs) if run), self.level)

    def step(self, leaves: list[str]) -> None:
        """Takes one leaf; the last one closes the runs that the end leaves short."""
        self.runs[0].append(leaves[self.at])
        self.at += 1
        for level in range(self.level):
            if len(self.runs[level]) == ARITY or self.done and self.runs[level]:
                self.runs[level + 1].append(digest("".join(self.runs[level])))
                self.runs[level] = []

    def finish(self, leaves: list[str]) -> list[str]:
        while not self.done:
            self.step(leaves)
        return self.runs[self.level]


def height_of(first: int, size: int, most: int) -> int:
    """Of the tree in a block whose first leaf has the index first: the only block of its tree ends at one node, one
    of several goes up all levels, most."""
    if first or size == ARITY**most:
        return most
    height = 0
    while ARITY**height < size:
        height += 1
    return height


def block_root(leaves: list[str], height: int) -> str:
    return Treehash(height, 0, len(leaves)).finish(leaves)[0]


def traverse(leaves: list[str], height: int) -> Iterator[list[Step]]:
    """The authentication path of each leaf, lowest level first, leaf by leaf (one list, changed in place)."""
    n = len(leaves)
    now = [Treehash(level, 0, n).finish(leaves) for level in range(height)]
    ahead = [Treehash(level, ARITY ** (level + 1), n) for level in range(height)]
    path: list[Step] = [("", "")] * height
    for i in range(n):
        for level in range(height):
            width = ARITY**level
            if i % width:
                break  # here and above, the nodes are those of the leaf before
            at = i // width % ARITY
            if at == 0 and i:
                now[level] = ahead[level].finish(leaves)
                ahead[level] = Treehash(level, i + ARITY * width, n)
            path[level] = "".join(now[level][:at]), "".join(now[level][at + 1 :])
        yield path
        for _ in range(height):  # as many steps as there are levels keep every stack in time
            open_ = [t for t in ahead if not t.done]
            if open_:
                min(open_, key=Treehash.lowest).step(leaves)


def fold(leaf: str, path: list[Step]) -> str:
    for left, right in path:
        leaf = digest(left + leaf + right)
    return leaf


def _field(column: Column) -> Column:
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_of(**changed: Column) -> Column:
    """The digest of a row: of its FIELDS, each with its length in bytes; changed replaces some."""
    return F.sha2(F.concat(*[_field(changed.get(c, F.col(c))) for c in FIELDS]).cast("binary"), 256)


def _ranked(rows: DataFrame, *order: str) -> DataFrame:
    """rows with key -> the same with rank, from 0 within key by the order columns, which tell all rows apart.

    Rows are dealt by ranges of (key, order), so a key of any size is spread; a range has few keys, and only their
    numbers of rows are added up to where each range begins.
    """
    dealt = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), "key", *order).sortWithinPartitions("key", *order)
    placed = materialise(dealt.withColumn("at", F.monotonically_increasing_id())).withColumn("piece", F.shiftright("at", 33))
    pieces = placed.groupBy("key", "piece").agg(F.min("at").alias("low"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select("key", "piece", (before - F.col("low")).alias("shift"))
    return placed.join(pieces, ["key", "piece"]).withColumn("rank", F.col("at") + F.col("shift")).drop("at", "piece", "shift")


_NODES = "key string, rank long, digest string"
_PATHS = "key string, rank long, path array<string>, subroot string, root string"


def _block(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"rank div {ARITY**height}"))


def _in_order(nodes: pd.DataFrame, most: int) -> tuple[pd.DataFrame, list[str], int]:
    nodes = nodes.sort_values("rank")
    return nodes, nodes["digest"].tolist(), height_of(int(nodes["rank"].iloc[0]), len(nodes), most)


def _climb(nodes: DataFrame, most: int) -> list[DataFrame]:
    """nodes and the roots of their blocks, tree by tree, until each key has one."""

    def roots(key, block):
        _, leaves, height = _in_order(block, most)
        return pd.DataFrame([(key[0], key[1], block_root(leaves, height))], columns=["key", "rank", "digest"])

    levels = [nodes]
    while len(levels) == 1 or levels[-1].agg(F.max("rank")).first()[0]:
        levels.append(materialise(_block(levels[-1].select("key", "rank", "digest"), most).groupBy("key", "block").applyInPandas(roots, _NODES)))
    return levels


def _descend(nodes: DataFrame, above: DataFrame, most: int, make, schema: str) -> DataFrame:
    """make(row, path, subroot, root) for each node, path a list of steps up to the root; above has the paths of the blocks."""

    def extend(block, shared):
        if block.empty:
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        block, leaves, height = _in_order(block, most)
        up = shared.iloc[0]
        upper = list(zip(up["path"][::2], up["path"][1::2], strict=True))
        rows = [make(row, path + upper, up["subroot"], up["root"]) for row, path in zip(block.itertuples(), traverse(leaves, height))]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return _block(nodes, most).groupBy("key", "block").cogroup(above.withColumnRenamed("rank", "block").groupBy("key", "block")).applyInPandas(extend, schema)


def _with_path(row, path: list[Step], subroot: str, root: str) -> tuple:
    return row.key, row.rank, [x for step in path for x in step], subroot, root


def _descend_all(levels: list[DataFrame], above: DataFrame, most: int) -> DataFrame:
    for nodes in reversed(levels):
        above = materialise(_descend(nodes.select("key", "rank", "digest"), above, most, _with_path, _PATHS))
    return above


def authenticate(leaves: DataFrame, order: tuple[str, ...], make=_with_path, schema: str = _PATHS, height: int = HEIGHT) -> DataFrame:
    """leaves (source, digest and the columns of order) -> make(row, path, subroot, root) of each.

    Within a source leaves go by the columns of order, then by digest; sources by their bytes, null first. Equal rows
    are leaves each. An empty table gives an empty one. Trees are cut into blocks, so no task has more than one
    block's nodes at a time; a source may have any share of the rows.
    """
    keyed = leaves.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).withColumn("row", F.monotonically_increasing_id())
    ranked = materialise(_ranked(materialise(keyed), *order, "digest", "row"))
    levels = _climb(ranked, height)
    tops = levels[-1].select(F.lit("").alias("key"), F.col("key").alias("source"), "digest")
    sources = materialise(_ranked(tops, "source"))
    trees = _climb(sources, height)
    top = trees[-1].select("key", "rank", F.array().cast("array<string>").alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    paths = _descend_all(trees[:-1], top, height).select("rank", "path", "root")
    above = sources.join(paths, "rank").select(F.col("source").alias("key"), F.lit(0).cast("long").alias("rank"), "path", F.col("digest").alias("subroot"), "root")
    return _descend(ranked, _descend_all(levels[1:-1], above, height), height, make, schema)


def _ids() -> list[Column]:
    """doc_id without null, which pandas would turn into fractions: null ids first."""
    return [F.col("doc_id").isNotNull().alias("has_id"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id")]


def prove(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """docs with FIELDS -> doc_id, source, leaf, subroot, root, path (left and right siblings of each level in turn, hex
    text): the manifest that fold() checks a row against. Null fields and ids, and texts of any length, are leaves like
    others; ids that repeat go by the leaf. Other columns are not part of it."""

    def make(row, path, subroot, root):
        source = row.key[1:] if row.key else None
        return row.id if row.has_id else None, source, row.digest, subroot, root, [x for step in path for x in step]

    leaves = docs.select("source", *_ids(), leaf_of().alias("digest"))
    return authenticate(leaves, ("has_id", "id"), make, "doc_id long, source string, leaf string, subroot string, root string, path array<string>", height)


_OP12 = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def check_tampered(docs: DataFrame, tampered: Column, height: int = HEIGHT) -> DataFrame:
    """The manifest of docs held against the same rows with text replaced by the column tampered: _OP12, a row for each of docs."""

    def make(row, path, subroot, root):
        folded = fold(row.tampered or row.digest, path)
        proof = digest("".join(left + right for left, right in path))
        return row.id if row.has_id else None, row.digest, subroot, root, proof, folded, folded == root

    changed = F.when(~tampered.eqNullSafe(F.col("text")), leaf_of(text=tampered))
    leaves = docs.select("source", *_ids(), leaf_of().alias("digest"), changed.alias("tampered"))
    return authenticate(leaves, ("has_id", "id"), make, _OP12, height)


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return check_tampered(table(spark, sf_dir, "documents").select(*FIELDS), F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))


def _levels_sql(name: str, key: str, depth: int) -> str:
    """Common table expressions name0 .. name<depth>: the nodes of each level with the siblings left and right."""
    run = f"OVER (PARTITION BY {key}, i // {ARITY} ORDER BY i ROWS BETWEEN"
    out = []
    for k in range(depth + 1):
        if k:
            out.append(
                f"{name}{k}_ AS (SELECT {key}, i // {ARITY} AS i, CASE WHEN n > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE any_value(d) END AS d, "
                f"CASE WHEN n > 1 THEN (n + {ARITY - 1}) // {ARITY} ELSE 1 END AS n FROM {name}{k - 1} GROUP BY {key}, i // {ARITY}, n)"
            )
        out.append(
            f"{name}{k} AS (SELECT *, coalesce(string_agg(d, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
            f"coalesce(string_agg(d, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k}_)"
        )
    return ",\n".join(out)


def _fold_sql(name: str, key: str, depth: int, start: str, i: str) -> str:
    """Joins of the rows start, whose index is i, with the levels: f (folded) and p (siblings) grow by a level at a time."""
    out = start
    for k in range(depth):
        out = (
            f"(SELECT t.* EXCLUDE (f, p), CASE WHEN v.n > 1 THEN sha256(v.l || t.f || v.r) ELSE t.f END AS f, CASE WHEN v.n > 1 THEN t.p || v.l || v.r ELSE t.p END AS p "
            f"FROM {out} t JOIN {name}{k} v ON t.{key} = v.{key} AND t.{i} // {ARITY**k} = v.i)"
        )
    return out


#: Levels that the SQL has: ARITY ** DEPTH leaves a source, and the same for sources.
_DEPTH = 13, 6
_SIZED = "||".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in FIELDS)
_CRC = "list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda a, b: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)), xor(a, b)), 4294967295::BIGINT)"
OP12_SQL = f"""
WITH leaves AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS s, sha256({_SIZED}) AS leaf,
         CASE WHEN xor({_CRC}, 4294967295::BIGINT) % 2 = 0 THEN sha256({_SIZED.replace("text::VARCHAR", "replace(text, chr(10), '')")}) END AS changed FROM documents),
leaf0_ AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS d, count(*) OVER (PARTITION BY s) AS n FROM leaves),
{_levels_sql("leaf", "s", _DEPTH[0])},
top0_ AS (SELECT 0 AS one, s, d, row_number() OVER (ORDER BY s) - 1 AS i, count(*) OVER () AS n FROM leaf{_DEPTH[0]}),
{_levels_sql("top", "one", _DEPTH[1])},
own AS (SELECT t.*, u.i AS j, u.d AS subroot, 0 AS one FROM {_fold_sql("leaf", "s", _DEPTH[0], "(SELECT doc_id, s, leaf, i, coalesce(changed, leaf) AS f, '' AS p FROM leaf0_)", "i")} t JOIN top0 u ON t.s = u.s),
whole AS (SELECT * FROM {_fold_sql("top", "one", _DEPTH[1], "own", "j")})
SELECT doc_id, leaf, subroot, (SELECT d FROM top{_DEPTH[1]}) AS root, sha256(p) AS proof_sha256, f AS folded_root, f = (SELECT d FROM top{_DEPTH[1]}) AS verified
FROM whole
"""
