"""Repeated passages: every byte that a 100-byte string covers which also starts earlier is removed.

1. Each text gives anchors: in every 100 bytes the 32-byte piece of the smallest hash (so equal strings share
   an anchor at the same place, and one byte in 35 begins one).
2. Anchors of equal hash meet; those that occur once are dropped.
3. An anchor that is left brings the bytes that a 100-byte string around it can reach. Texts of a task compare
   theirs first: what is equal to an earlier one is removed right there, so a passage that any number of
   documents share leaves a task once.
4. Anchors of equal hash meet again with these bytes. They are cut to what another shares, and a suffix array
   over the cut strings gives the groups of equal 100-byte strings, of which all but the first are removed.
   An anchor with too many members is not brought as bytes but as one hash for each 100-byte string, which
   meet by that hash, likewise after each task has dropped its own repeats.
5. The runs go back to their texts.
"""

from __future__ import annotations

from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import materialise, shuffle_partitions, table
from parlance.llm.suffixes import suffix_array

LENGTH = 100
PIECE = 32
REACH = LENGTH - PIECE
#: Bytes of text that a task looks at together before it passes on what it found.
HELD_BYTES = 16_000_000
#: Members of an anchor beyond which it goes by hashes of 100-byte strings.
LARGE = 20_000
_NO_ID = -(2**63)


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 64-bit hashes of the anchors of a text, ascending."""
    n = len(raw) - PIECE + 1
    if len(raw) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    with np.errstate(over="ignore"):
        h = words[:n] * np.uint64(0x9E3779B97F4A7C15)
        for at, c in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9), (24, 0x27D4EB2F165667C5)):
            h ^= h >> np.uint64(31)
            h += words[at : at + n]
            h *= np.uint64(c)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    width = 1
    low = key
    span = LENGTH - PIECE + 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: n - span + 1], low[span - width :][: n - span + 1])
    at = np.unique((low & np.uint64(0xFFFFFFFF)).astype(np.int64))
    return at, h[at]


def _order_columns(docs: DataFrame) -> DataFrame:
    """doc_id, text, and what puts rows in order: oid (null first), h (of the text). Rows equal in both are equal."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("oid"), F.xxhash64("text").alias("h")
    )


def _bins(rows: np.ndarray, parts: int) -> np.ndarray:
    return ((rows >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)


_ANCHOR = np.dtype([("a", "<u8"), ("oid", "<i8"), ("h", "<i8"), ("at", "<i4")])


def _pack(rows: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(rows[f]).tobytes() for f in _ANCHOR.names)


def _unpack(blob: bytes) -> np.ndarray:
    n = len(blob) // _ANCHOR.itemsize
    out, at = np.empty(n, _ANCHOR), 0
    for f in _ANCHOR.names:
        size = n * _ANCHOR[f].itemsize
        out[f] = np.frombuffer(blob, _ANCHOR[f], n, at)
        at += size
    return out


def _changes(rows: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], np.any([rows[f][1:] != rows[f][:-1] for f in _ANCHOR.names], axis=0)])


_FOUND = "part int, blob binary, times binary, known binary"


def _find_anchors(parts: int):
    """Blobs of one row for each anchor hash of the texts held together, with how often it occurs; the other rows
    of a hash that occurs again go as known."""

    def out(rows: list[np.ndarray]):
        every = np.concatenate(rows)
        every = every[np.lexsort((every["at"], every["h"], every["oid"], every["a"]))]
        every = every[_changes(every)]
        first = np.flatnonzero(np.concatenate([[True], every["a"][1:] != every["a"][:-1]]))
        times = np.diff(np.append(first, len(every)))
        ones = every[first]
        rest = np.delete(every, first)
        bins, known_bins = _bins(ones["a"], parts), _bins(rest["a"], parts)
        order, known_order = np.argsort(bins, kind="stable"), np.argsort(known_bins, kind="stable")
        cut = np.searchsorted(bins[order], np.arange(parts + 1))
        known_cut = np.searchsorted(known_bins[known_order], np.arange(parts + 1))
        cols: list[list] = [[], [], [], []]
        for p in range(parts):
            mine, known = order[cut[p] : cut[p + 1]], rest[known_order[known_cut[p] : known_cut[p + 1]]]
            if len(mine):
                for col, x in zip(cols, (p, _pack(ones[mine]), times[mine].astype("<i4").tobytes(), _pack(known)), strict=True):
                    col.append(x)
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays(list(map(pa.array, cols, kinds)), ["part", "blob", "times", "known"])

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for text, oid, h in zip(batch["text"], batch["oid"].to_pylist(), batch["h"].to_pylist(), strict=True):
                raw = text.as_py().encode()
                at, a = anchors(raw)
                if len(at):
                    part = np.empty(len(at), _ANCHOR)
                    part["a"], part["oid"], part["h"], part["at"] = a, oid, h, at
                    rows.append(part)
                size += len(raw)
                if size >= HELD_BYTES and rows:
                    yield out(rows)
                    rows, size = [], 0
        if rows:
            yield out(rows)

    return run


_CANDIDATES = "oid long, h long, at array<int>, anchor array<long>, large array<boolean>"


def _meet(batches):
    """Anchors whose hash occurs again, by text. A blob holds a hash once, so a task gets as many rows of it as
    there were blobs at most; known rows, which more rows can share, are only passed through."""
    blobs, known = [], []
    for batch in batches:
        for blob, times, more in zip(batch["blob"].to_pylist(), batch["times"].to_pylist(), batch["known"].to_pylist(), strict=True):
            blobs.append((_unpack(blob), np.frombuffer(times, "<i4").astype(np.int64)))
            known.append(more)
    if not blobs:
        return
    rows, times = np.concatenate([b for b, _ in blobs]), np.concatenate([t for _, t in blobs])
    del blobs
    order = np.lexsort((rows["at"], rows["h"], rows["oid"], rows["a"]))
    rows, times = rows[order], times[order]
    new = np.concatenate([[True], rows["a"][1:] != rows["a"][:-1]])
    other = _changes(rows)
    total = np.add.reduceat(times - 1 + other, np.flatnonzero(new))
    total_of = total[np.cumsum(new) - 1]
    yield from _by_text(rows[(total_of > 1) & other], total_of[(total_of > 1) & other] > LARGE)
    hashes, totals = rows["a"][new], total
    for blob in known:
        more = _unpack(blob)
        if len(more):
            yield from _by_text(more, totals[np.searchsorted(hashes, more["a"])] > LARGE)


def _by_text(rows: np.ndarray, large: np.ndarray):
    order = np.lexsort((rows["at"], rows["h"], rows["oid"]))
    rows, large = rows[order], large[order]
    if not len(rows):
        return
    first = np.flatnonzero(np.concatenate([[True], (rows["oid"][1:] != rows["oid"][:-1]) | (rows["h"][1:] != rows["h"][:-1])]))
    for i in range(0, len(first), 20_000):
        starts = first[i : i + 20_000]
        end = first[i + 20_000] if i + 20_000 < len(first) else len(rows)
        span = slice(starts[0], end)
        offsets = pa.array(np.append(starts, end) - starts[0], pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (rows["at"][span], rows["a"][span].astype(np.int64), large[span])]
        yield pa.RecordBatch.from_arrays([pa.array(rows["oid"][starts]), pa.array(rows["h"][starts]), *lists], _names(_CANDIDATES))


def _names(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.split(", ")]


#: kind 0: a run [at, end) of a text to be removed. 1: an anchor at `at` with the bytes it reaches, of which `end`
#: stand before it. 2: the hash of the 100 bytes at `at`.
_PIECES = "part long, kind int, oid long, h long, at int, end int, bytes binary"
_PIECE_TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _PIECE_TYPES, strict=True)], _names(_PIECES))


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _with_texts(batches, fields: list[str]):
    """(oid, h, text, how many rows it has, the other rows' fields) from rows in order, texts before the others."""
    key, text, many, rest = None, None, 0, []
    for batch in batches:
        cols = [batch[c].to_pylist() for c in ("oid", "h", *fields)]
        for i, value in enumerate(batch["text"]):
            now = (cols[0][i], cols[1][i])
            if now != key:
                if key is not None:
                    yield *key, text, many, rest
                key, text, many, rest = now, None, 0, []
            if value.is_valid:
                text, many = value.as_py(), many + 1
            else:
                rest.append(tuple(c[i] for c in cols[2:]))
    if key is not None:
        yield *key, text, many, rest


def _bring_bytes(batches):
    rows: list[tuple] = []
    seen: set[bytes] = set()
    size = 0
    for oid, h, text, _, rest in _with_texts(batches, ["at", "anchor", "large"]):
        marks = sorted({x for at, anchor, large in rest for x in zip(at, anchor, large, strict=True)})
        if not marks:
            continue
        raw = text.encode()
        size += len(raw)
        runs, done = [], set()
        for at, anchor, large in marks:
            begin, end = max(0, at - REACH), min(len(raw), at + LENGTH)
            piece = raw[begin:end]
            name = xxhash.xxh3_128_digest(piece + bytes([at - begin]))
            if name in seen:
                runs.append((begin, end))
                continue
            seen.add(name)
            if not large:
                rows.append((anchor, 1, oid, h, at, at - begin, piece))
                continue
            for i in range(begin, end - LENGTH + 1):
                if i not in done:
                    done.add(i)
                    name = xxhash.xxh3_128_digest(raw[i : i + LENGTH])
                    if name in seen:
                        runs.append((i, i + LENGTH))
                    else:
                        seen.add(name)
                        rows.append((int.from_bytes(name[:8], "little", signed=True), 2, oid, h, i, 0, name))
        rows += [(oid ^ h, 0, oid, h, a, b, None) for a, b in _merged(runs)]
        if len(rows) >= 5_000:
            yield _pieces(rows)
            rows = []
        if size >= HELD_BYTES:
            seen.clear()
            size = 0
    if rows:
        yield _pieces(rows)


def _shared(strings: list[bytes]) -> list[int]:
    """For each string the longest start it shares with another (as long as strings are of REACH bytes at most)."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    out = [0] * len(strings)
    for i, j in zip(order, order[1:], strict=False):
        a, b = strings[i], strings[j]
        n = min(len(a), len(b))
        if a[:n] != b[:n]:
            low = 0
            while low < n:  # bisection of the first difference
                mid = (low + n + 1) // 2
                if a[:mid] == b[:mid]:
                    low = mid
                else:
                    n = mid - 1
            n = low
        out[i], out[j] = max(out[i], n), max(out[j], n)
    return out


def earlier_copies(members: list[tuple[int, int, int, int, bytes]]) -> list[tuple[int, int, int, int]]:
    """members: (oid, h, at, before, bytes) of one anchor, in order. Runs (oid, h, begin, end) of 100-byte strings
    around it that an earlier member has at the same place from its anchor."""
    left = _shared([m[4][: m[3]][::-1] for m in members])
    right = _shared([m[4][m[3] + PIECE :] for m in members])
    cut: dict[tuple[int, bytes], tuple] = {}
    out = []
    for (oid, h, at, before, raw), a, b in zip(members, left, right, strict=True):
        if a + PIECE + b < LENGTH:
            continue
        piece = (a, raw[before - a : before + PIECE + b])
        if piece in cut:
            out.append((oid, h, at - a, at + PIECE + b))
        else:
            cut[piece] = (oid, h, at - a)
    if len(cut) < 2:
        return out
    # dict order is the members' order, and a string's place in `whole` tells which member it is of
    starts, owner, symbols, whole = [], [], [], b""
    for i, (_, piece) in enumerate(cut):
        starts.append(len(whole))
        owner += [i] * (len(piece) + 1)
        symbols += [c + 2 for c in piece]
        symbols.append(1)
        whole += piece + b"\0"
    owners = list(cut.values())
    last = [end - 1 - LENGTH for end in [*starts[1:], len(whole)]]  # the last place of a string of LENGTH in each piece
    symbols.append(0)
    order = [i for i in suffix_array(symbols)[1:] if i <= last[owner[i]]]
    for _, same in groupby(order, key=lambda i: whole[i : i + LENGTH]):
        places = set()  # a text that repeats itself can show one place through two anchors
        for i in same:
            oid, h, begin = owners[owner[i]]
            places.add((oid, h, begin + i - starts[owner[i]]))
        places.discard(min(places))
        out += [(oid, h, at, at + LENGTH) for oid, h, at in places]
    return out


def _compare(batches):
    rows: list[tuple] = []
    groups: dict[tuple[int, int], list[tuple]] = {}
    for batch in batches:
        kind = batch["kind"].to_numpy()
        passed = batch.filter(pa.array(kind == 0))
        if passed.num_rows:
            yield passed.select(_RUN)
        found = batch.filter(pa.array(kind != 0))
        for what, part, *member in zip(*(found[c].to_pylist() for c in ("kind", "part", "oid", "h", "at", "end", "bytes")), strict=True):
            groups.setdefault((what, part), []).append(tuple(member))
    for (kind, _), members in groups.items():
        if len(members) < 2:
            continue
        members.sort(key=itemgetter(0, 1, 2))
        if kind == 1:
            rows += earlier_copies(members)
        else:
            seen: set[bytes] = set()
            for oid, h, at, _, name in members:
                if name in seen:
                    rows.append((oid, h, at, at + LENGTH))
                seen.add(name)
    by_text: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for oid, h, a, b in rows:
        by_text.setdefault((oid, h), []).append((a, b))
    merged = [(*k, a, b) for k, runs in by_text.items() for a, b in _merged(runs)]
    for i in range(0, len(merged), 50_000):
        cols = zip(*merged[i : i + 50_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], _RUN)


_RUN = ["oid", "h", "at", "end"]


def _together(docs: DataFrame, others: DataFrame, parts: int) -> DataFrame:
    """Texts and the rows about them in one partition, a text before its rows."""
    both = docs.unionByName(others, allowMissingColumns=True)
    return both.repartition(parts, "oid", "h").sortWithinPartitions("oid", "h", F.col("text").isNull())


def repeated_runs(docs: DataFrame) -> DataFrame:
    """docs of _order_columns -> runs (oid, h, at, end), in bytes, to be removed; runs may overlap."""
    parts = shuffle_partitions(docs.sparkSession)
    docs = docs.select("oid", "h", "text")
    found = docs.mapInArrow(_find_anchors(parts), _FOUND).repartitionById(parts, F.col("part")).mapInArrow(_meet, _CANDIDATES)
    found = materialise(found)
    pieces = _together(docs, found, parts).mapInArrow(_bring_bytes, _PIECES)
    return pieces.repartition(parts, "part").mapInArrow(_compare, "oid long, h long, at int, end int")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept (binary, what is left of the UTF-8 text).

    Earlier means a smaller doc_id (null first), then an earlier start. Rows of one id come in the order of a
    hash of their text; of rows that are equal in both, all but one count as later. Null texts are empty. Each
    row gives one row; other columns are ignored.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    docs = _order_columns(docs)
    runs = materialise(repeated_runs(docs))
    runs = runs.groupBy("oid", "h").agg(F.collect_list(F.struct("at", "end")).alias("runs"))  # of one text

    def cut(batches):
        rows = []
        for oid, _, text, many, rest in _with_texts(batches, ["runs"]):
            raw = text.encode()
            gone = _merged([(r["at"], r["end"]) for (found,) in rest for r in found])
            at, kept = 0, []
            for a, b in gone:
                kept.append(raw[at:a])
                at = b
            doc_id = None if oid == _NO_ID else oid
            rows.append((doc_id, len(raw), sum(b - a for a, b in gone), len(gone), b"".join(kept) + raw[at:]))
            whole = len(raw) >= LENGTH
            rows += [(doc_id, len(raw), len(raw) if whole else 0, int(whole), b"" if whole else raw)] * (many - 1)
            if len(rows) >= 500:
                yield _kept(rows)
                rows = []
        if rows:
            yield _kept(rows)

    whole = _together(docs.select("oid", "h", "text"), runs, shuffle_partitions(spark))
    return whole.mapInArrow(cut, f"doc_id long, {_KEPT}").withColumn("doc_id", F.col("doc_id").cast(kind))


_KEPT = "n_bytes long, n_removed long, n_spans long, kept binary"


def _kept(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", *_names(_KEPT)])


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest: Column = F.sha2("kept", 256)
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", digest.alias("kept_sha256"))
