"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark, one scan of each text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import materialise, table

WINDOW = 10
#: Words of windows that one automaton may hold; a larger benchmark is scanned for in several passes.
MAX_AUTOMATON_WORDS = 4_000_000

#: ASCII that is no letter or digit becomes a space; lengths stay, so offsets are those of the original.
_SPACED = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
_built: dict[str, object] = {}


def normalised(text: str | None) -> bytes:
    return (text or "").encode().lower().translate(_SPACED)


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    words = normalised(text).split()
    if not words:
        return []
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


class Patterns:
    """Windows of one shard and the items that hold them. The automaton is built once in each Python worker."""

    def __init__(self, by_window: dict[bytes, list[int]], item_ids: list[str | None]):
        self.by_window, self.item_ids = by_window, item_ids
        self.key = hashlib.sha256(repr((sorted(by_window.items()), item_ids)).encode()).hexdigest()

    def automaton(self):
        import ahocorasick

        if self.key not in _built:
            _built.clear()
            made = ahocorasick.Automaton()
            for i, (window, items) in enumerate(sorted(self.by_window.items())):
                made.add_word(f" {window.decode('latin-1')} ", (len(window), items))
            made.make_automaton()
            _built[self.key] = made
        return _built[self.key]

    def scan(self, text: str | None) -> tuple[np.ndarray, set[int]]:
        """Whether each word is hit, and the numbers of the items found."""
        words = normalised(text).split()
        if not words or not self.by_window:
            return np.zeros(len(words), bool), set()
        joined = f" {b' '.join(words).decode('latin-1')} "
        found = list(self.automaton().iter(joined))
        if not found:
            return np.zeros(len(words), bool), set()
        spaces = np.flatnonzero(np.frombuffer(joined.encode("latin-1"), np.uint8) == 0x20)
        ends = np.fromiter((e for e, _ in found), np.int64, len(found))
        starts = ends - np.fromiter((v[0] for _, v in found), np.int64, len(found)) - 1
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, np.searchsorted(spaces, starts), 1)
        np.add.at(change, np.searchsorted(spaces, ends), -1)
        return np.cumsum(change[:-1]) > 0, {i for _, v in found for i in v[1]}


def shards(benchmark: DataFrame, size: int = WINDOW, most: int = MAX_AUTOMATON_WORDS) -> Iterator[Patterns]:
    """benchmark (item_id, text) in shards of a bounded number of window words; at least one shard."""
    by_window: dict[bytes, list[int]] = {}
    ids: list[str | None] = []
    words = 0
    for item_id, text in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        ids.append(item_id)
        for window in windows(text, size):
            if window not in by_window:
                words += window.count(b" ") + 1
            holders = by_window.setdefault(window, [])
            if not holders or holders[-1] != len(ids) - 1:
                holders.append(len(ids) - 1)
        if words >= most:
            yield Patterns(by_window, ids)
            by_window, ids, words = {}, [], 0
    if ids or not words:
        yield Patterns(by_window, ids)


def find_leaks(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, most: int = MAX_AUTOMATON_WORDS) -> DataFrame:
    """(doc_id, text) -> doc_id, n_words, n_hit, items array<string>, spans array<struct<start,end>>.

    Spans are code points of the original text, one for each run of hit words. Null and empty texts have
    no words. Each row of docs gives one row, repeated or not; benchmark items without an id hit words but
    name no item; an empty benchmark hits nothing. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.array().cast("array<int>").alias("hit"), F.array().cast("array<string>").alias("items"))
    ahead = shards(benchmark, size, most)
    patterns = next(ahead)
    while (following := next(ahead, None)) is not None:
        rows = materialise(rows.mapInArrow(_scanner(spark.sparkContext.broadcast(patterns), last=False), rows.schema))
        patterns = following
    return rows.mapInArrow(_scanner(spark.sparkContext.broadcast(patterns), last=True), _RESULT)


_RESULT = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scanner(shared, last: bool):
    def scan(batches):
        patterns = shared.value
        for batch in batches:
            hits, items, counts, spans = [], [], [], []
            for text, hit, item in zip(batch["text"].to_pylist(), batch["hit"].to_pylist(), batch["items"].to_pylist(), strict=True):
                marks, found = patterns.scan(text)
                hits.append(sorted({*np.flatnonzero(marks).tolist(), *hit}))
                items.append(sorted({*item, *(x for i in found if (x := patterns.item_ids[i]) is not None)}))
                counts.append(len(marks))
                if last:
                    spans.append(_spans(text, hits[-1]) if hits[-1] else [])
            found = pa.array(items, pa.list_(pa.string()))
            if last:
                n_hit = pa.array([len(h) for h in hits], pa.int64())
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(counts, pa.int64()), n_hit, found, pa.array(spans, _SPAN)], ["doc_id", "n_words", "n_hit", "items", "spans"])
            else:
                yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text"], pa.array(hits, pa.list_(pa.int32())), found], ["doc_id", "text", "hit", "items"])

    return scan


def _spans(text: str, marks: list[int]) -> list[dict[str, int]]:
    flat = normalised(text)
    raw = np.frombuffer(flat, np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate([[False], raw, [False]]).view(np.int8)))
    points = np.concatenate([[0], np.cumsum((np.frombuffer((text).encode(), np.uint8) & 0xC0) != 0x80)])
    starts, ends = points[edges[::2]], points[edges[1::2]]
    runs = np.split(np.array(marks), np.flatnonzero(np.diff(marks) > 1) + 1)
    return [{"start": int(starts[r[0]]), "end": int(ends[r[-1]])} for r in runs]


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    ids: Column = F.array_join("items", ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
