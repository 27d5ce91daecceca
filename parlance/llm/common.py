"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_folder: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where that is unset, a temporary one for a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        base = _own_folder.setdefault(app, "file://" + tempfile.mkdtemp(prefix="parlance-"))
    return base


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Tables made and read in it have their shuffle files deleted when that ends: for results that are read once."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and a lost executor costs nothing.

    The files are deleted when the application ends.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/tables/{uuid.uuid4().hex}"
    with shuffles_deleted(spark):
        df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores until df has no such column (case does not tell columns apart)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a long, b long): (node, root), root the smallest node.

    Alternates large-star and small-star steps, each a grouped minimum and an equi-join, until the
    edge set stays the same. Every round is written to the shared folder; nothing is collected but
    two numbers. Nodes without an edge do not appear. Nodes that hang on one smaller node alone, most of a dense
    group once it is thin, stay out of the rounds and take that node's root at the end.
    """
    hi, lo = F.greatest("a", "b"), F.least("a", "b")
    whole = materialise(edges.where("a <> b").select(hi.alias("a"), lo.alias("b")).distinct())
    ones = whole.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b")).where("n = 1").select("a", "b")
    leaves = materialise(ones.join(whole.select(F.col("b").alias("a")).distinct(), "a", "left_anti"))
    roots = _rounds(materialise(whole.join(leaves.select("a"), "a", "left_anti")))
    above = leaves.join(roots, F.col("b") == F.col("node"), "left").select(F.col("a").alias("node"), F.coalesce("root", "b").alias("root"))
    return roots.unionByName(above)


def _rounds(current: DataFrame) -> DataFrame:
    mark = _mark(current)
    while mark[0]:
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
            current.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = materialise(small.unionAll(least.select("a", F.col("m").alias("b"))).distinct())
        before, mark = mark, _mark(current)
        if before == mark:
            break
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first())
