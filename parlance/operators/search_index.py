"""A stored inverted index of transcript lines, and ranked search from it.

One row of `postings` is a word in a block of 64 neighbouring lines of a session: a bit for each line that has it, the
largest count and the shortest length among those lines, and the lists themselves. Files hold ranges of words in order,
in folders by the word's first letter, so a prefix reads its own stretch of one folder. Bits and bounds are columns of
their own: lines are counted and blocks ruled out before any list is read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators import search

BLOCK = 64
BUCKETS = 16
#: Blocks scored first, for each line asked for, to learn how good a block has to be.
FIRST = 4


def _bucket(word: Column) -> Column:
    return F.pmod(F.crc32(F.substring(word, 1, 1).cast("binary")), F.lit(BUCKETS)).cast("int")


def _has_prefix(prefix: str) -> Column:
    return (F.col("bucket") == zlib.crc32(prefix[0].encode()) % BUCKETS) & F.col("word").startswith(prefix)


def add(lines: DataFrame, folder: str, part: str) -> None:
    """Index lines (session_id, seq, text) as one part; (session_id, seq) names a line and is in one part alone.

    A part that is written again replaces itself. Its sizes are written last, and a part without them is not searched.
    Lines without words are not counted, as in search.bm25(); null texts have none.
    """
    sized = lines.select("session_id", "seq", search.words(F.col("text")).alias("words")).where(F.size("words") > 0)
    sized = sized.select("session_id", "seq", F.size("words").alias("length"), "words")
    counted = sized.select("session_id", "seq", "length", F.explode("words").alias("word")).groupBy("word", "session_id", "seq", "length").agg(F.count("*").cast("int").alias("tf"))
    block = F.floor(F.col("seq") / BLOCK).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("seq"), F.lit(BLOCK)).cast("int"))
    rows = counted.groupBy("word", "session_id", block.alias("block")).agg(
        F.bit_or(bit).alias("lines"), F.max("tf").alias("most"), F.min("length").alias("least"),
        F.array_sort(F.collect_list(F.struct("seq", "tf", "length"))).alias("postings"),
    )
    rows = rows.withColumn("bucket", _bucket(F.col("word"))).repartitionByRange("bucket", "word", "session_id", "block")
    rows.sortWithinPartitions("bucket", "word", "session_id", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings/part={part}")
    sizes = sized.groupBy("session_id").agg(F.count("*").alias("n"), F.sum("length").alias("total"))
    sizes.write.mode("overwrite").parquet(f"{folder}/sizes/part={part}")


@dataclass(frozen=True)
class Asked:
    """What a search has learnt before it reads a list."""

    prefixes: list[str]
    n: int
    mean: float
    found: list[int]

    def score(self, counts: list[Column], length: Column) -> Column:
        """BM25 of a line with these counts of the prefixes; larger counts and a shorter length never lower it."""
        out = F.lit(0.0)
        for df, t in zip(self.found, counts, strict=True):
            idf = F.greatest(F.log((F.lit(float(self.n)) - df + 0.5) / (F.lit(float(df)) + 0.5)), F.lit(1e-6))
            out = out + idf * t * (search.K1 + 1) / (t + search.K1 * (1 - search.B + search.B * length / F.lit(self.mean)))
        return out


class Index:
    """The parts of a folder that were written to the end when it was opened."""

    def __init__(self, spark: SparkSession, folder: str):
        self.sizes = spark.read.parquet(f"{folder}/sizes")
        parts = [r.part for r in self.sizes.select(F.col("part").cast("string").alias("part")).distinct().collect()]  # one a batch; compact() joins them
        self.postings = spark.read.parquet(f"{folder}/postings").where(F.col("part").cast("string").isin(parts))

    def _asked(self, prefixes: list[str]) -> DataFrame:
        any_of = F.lit(False)
        for p in prefixes:
            any_of = any_of | _has_prefix(p)
        return self.postings.where(any_of)

    def bm25(self, query: list[str], k: int = 20, without=None, session=None) -> DataFrame:
        """The rows of search.bm25(lines, query, k), over one session alone or without one.

        First the bits and bounds of the asked words: how many lines each prefix has, and for each block that has all
        of them in one line the best score a line of it could have. The blocks with the best bounds are scored; then
        only those blocks whose bound reaches the k-th score found. No line is left out that belongs to the k best.
        """
        prefixes = list(dict.fromkeys(p for p in query if p))
        keep = F.lit(True) if without is None else F.col("session_id") != without
        keep = keep if session is None else keep & (F.col("session_id") == session)
        empty = self.postings.where("false").select("session_id", F.lit(0).alias("seq"), F.lit(0.0).alias("score"))
        total = self.sizes.where(keep).agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
        if not prefixes or not total.n:
            return search.ranked(empty, k)
        mine = lambda p, c, none: F.when(_has_prefix(p), F.col(c)).otherwise(F.lit(none))
        each = [
            c for i, p in enumerate(prefixes)
            for c in (F.bit_or(mine(p, "lines", 0)).alias(f"lines{i}"), F.sum(mine(p, "most", 0)).alias(f"most{i}"))
        ]
        blocks = self._asked(prefixes).where(keep).groupBy("session_id", "block").agg(*each, F.min("least").alias("least"))
        df = blocks.agg(*[F.sum(F.bit_count(f"lines{i}")).alias(f"df{i}") for i in range(len(prefixes))]).first()
        asked = Asked(prefixes, total.n, total.total / total.n, [d or 0 for d in df])
        if not all(asked.found):
            return search.ranked(empty, k)
        common = F.col("lines0")
        for i in range(1, len(prefixes)):
            common = common.bitwiseAND(F.col(f"lines{i}"))
        bound = asked.score([F.col(f"most{i}") for i in range(len(prefixes))], F.col("least"))
        blocks = blocks.where(common != 0).select("session_id", "block", bound.alias("bound"))
        first = self._lines(asked, blocks.orderBy(F.desc("bound"), "session_id", "block").limit(FIRST * k), keep)
        kth = first.orderBy(F.desc("score")).limit(k).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
        if kth.n == k:
            blocks = blocks.where(F.col("bound") >= kth.least - 1e-8)  # ranks go by nine digits
        return search.ranked(self._lines(asked, blocks, keep), k)

    def _lines(self, asked: Asked, blocks: DataFrame, keep: Column) -> DataFrame:
        """session_id, seq, score of the lines in blocks that have every prefix."""
        rows = self._asked(asked.prefixes).where(keep).join(blocks.select("session_id", "block"), ["session_id", "block"], "left_semi")
        hits = rows.select("session_id", "word", "bucket", F.inline("postings"))
        counts = [F.sum(F.when(_has_prefix(p), F.col("tf")).otherwise(0)).alias(f"tf{i}") for i, p in enumerate(asked.prefixes)]
        hits = hits.groupBy("session_id", "seq", "length").agg(*counts)
        every = F.lit(True)
        for i in range(len(asked.prefixes)):
            every = every & (F.col(f"tf{i}") > 0)
        return hits.where(every).select("session_id", "seq", asked.score([F.col(f"tf{i}") for i in range(len(asked.prefixes))], F.col("length")).alias("score"))
