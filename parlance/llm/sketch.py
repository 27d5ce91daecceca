"""Document fingerprints: every shingle hash below a fixed fraction of the hash range is kept.

The same threshold holds for every text, so sketches of very unequal documents stay comparable, and they merge by union.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import shuffle_partitions, table

SHINGLE_BYTES = 16
#: One in so many hashes is kept; of the 27 bits that vary below the threshold the upper 24 are written.
ONE_IN = 32
KEPT_BITS = 24
_LIMIT = np.uint32(2**32 // ONE_IN)
_DROPPED = 32 - KEPT_BITS - (ONE_IN - 1).bit_length()


def _windows(text: str | None) -> np.ndarray:
    raw = (text or "").encode()
    if not raw:
        return np.zeros(0, np.uint32)
    if len(raw) < SHINGLE_BYTES:
        raw = raw.ljust(SHINGLE_BYTES, b"\0")
    halves = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    with np.errstate(over="ignore"):
        h = halves[:-8] * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h += halves[8:]
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x165667B19E3779F9)
    return (h >> np.uint64(32)).astype(np.uint32)


def sketch(text: str | None) -> np.ndarray:
    """Sorted distinct numbers of the UTF-8 text's 16-byte windows with a hash below the threshold; a shorter text is
    one window, an empty one has none. A text of few windows may keep none."""
    h = _windows(text)
    return np.unique(h[h < _LIMIT] >> np.uint32(_DROPPED))


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of both texts' windows together."""
    return np.union1d(a, b)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's windows that b has; 0 if a keeps none."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 0.0


def fingerprint(text: str | None, kept: np.ndarray) -> str:
    """Base64 of the number of the text's bytes (four bytes) and of its sketch (three bytes a hash): 4 characters
    for 32 of text."""
    size = len((text or "").encode()).to_bytes(8, "big")[-4:]
    return base64.b64encode(size + kept.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes()).decode()


def likeness(one: tuple[str, np.ndarray], other: tuple[str, np.ndarray]) -> float:
    """Of fingerprints with their sketches: 1 for equal fingerprints, else the containment of the first in the second."""
    return 1.0 if one[0] == other[0] else containment(one[1], other[1])


_NO_ID = -(2**63)


def neighbours_in_order(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) in ranges of (doc_id, hash of the text), one range a partition, sorted; the first row of the
    next range (of the first one, after the last) is at each end with copy true. Texts are shuffled once. An id of
    more rows than a range should have, null included, is cut by the hash."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(_NO_ID)).alias("oid"))
    docs = docs.withColumn("h", F.xxhash64("text"))
    rows = docs.count()
    cuts = {(int(c), -(2**63)) for c in docs.stat.approxQuantile("oid", [i / parts for i in range(1, parts)], 0.1 / parts)} if parts > 1 else set()
    fair = max(1, rows // parts)
    for r in docs.groupBy("oid").agg(F.count("*").alias("n")).where(F.col("n") > fair).collect():  # parts ids at most
        pieces = -(-r.n // fair)
        cuts |= {(r.oid, -(2**63) + k * 2**64 // pieces) for k in range(pieces)}
    bounds = F.array(*[F.struct(F.lit(i).cast("long").alias("oid"), F.lit(h).cast("long").alias("h")) for i, h in sorted(cuts)]).cast("array<struct<oid:bigint,h:bigint>>")
    part: Column = F.size(F.filter(bounds, lambda c: c <= F.struct("oid", "h")))
    docs = docs.withColumn("part", part)
    # one row for each range: the first key in it
    heads = docs.groupBy("part").agg(F.min(F.struct("oid", "h")).alias("first")).select("part", "first.*").orderBy("part").collect()
    homes = [(heads[i].oid, heads[i].h, heads[i - 1].part) for i in range(len(heads))]
    home = spark.createDataFrame(homes, "oid long, h long, home int")
    own = docs.select("doc_id", "oid", "h", "text", "part", F.lit(False).alias("copy"))
    copies = docs.drop("part").join(F.broadcast(home), ["oid", "h"]).groupBy("home").agg(F.first("doc_id").alias("doc_id"), F.first("oid").alias("oid"), F.first("h").alias("h"), F.first("text").alias("text"))
    dealt = own.unionByName(copies.withColumnRenamed("home", "part").withColumn("copy", F.lit(True))).repartitionById(len(cuts) + 1, F.col("part"))
    return dealt.sortWithinPartitions("copy", "oid", "h", "text").select("doc_id", "text", "copy")


_COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """docs (doc_id long, text) -> the columns of _COLUMNS.

    The next document is the one with the next larger id (null ids first, equal ids by xxhash64 of the text; after the
    last the first). Null texts are empty, texts of any length are whole. A single document is its own next, equal
    rows are each other's. An empty table gives an empty one; other columns are ignored, whatever their names.
    """

    def measure(batches):
        before, out = None, []
        for batch in batches:
            for doc_id, text, copy in zip(batch["doc_id"].to_pylist(), batch["text"], batch["copy"].to_pylist(), strict=True):
                if before is None and copy or before and before[3]:
                    continue
                text = text.as_py()
                kept = sketch(text)
                now = (doc_id, text, (fingerprint(text, kept), kept), copy)
                if before:
                    out.append(_row(before, now))
                before = now
                if len(out) >= 500:
                    yield _batch(out)
                    out = []
        if out:
            yield _batch(out)

    return neighbours_in_order(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(measure, _COLUMNS)


def _row(doc, following) -> tuple:
    doc_id, text, own, _ = doc
    q = len(text) // 4
    edited = text[: len(text) - q] + following[1][:q]
    changed = own
    if edited != text:
        kept = sketch(edited)
        changed = fingerprint(edited, kept), kept
    return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own[0], changed[0], likeness(own, changed), likeness(own, following[2])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _COLUMNS.split(", ")])


def op7_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
