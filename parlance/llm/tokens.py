"""Token counts: pieces are counted once per distinct pre-token and joined to each document's pre-token frequencies."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import materialise, table

#: Pre-tokens that every Python worker may hold; rarer ones are joined by a shuffle.
COMMON = 300_000
#: Characters of a pre-token that workers may hold; longer ones are joined however frequent they are.
COMMON_CHARS = 64
#: Distinct pre-tokens that a task gathers before it passes them on.
HELD = 400_000
LIMIT = 4096

#: The model puts a space before the text and has no piece with a space or line feed behind another
#: character, so a merge never crosses these places. It writes a space as U+2581, so the two are one.
_SPACE = "\u2581"
_PRE = re.compile(r" +[^ \n]*|\n[^ \n]*")
_loaded: dict[str, object] = {}


def pre_tokens(text: str | None) -> list[str]:
    return _PRE.findall(" " + text.replace(_SPACE, " ")) if text else []


def piece_count(pre_token: str, processor) -> int:
    """Pieces of a pre-token; the processor itself puts a space in front, which is taken off here or not counted."""
    if pre_token[0] == "\n":
        return len(processor.encode(pre_token)) - 1
    return len(processor.encode(pre_token[1:])) if len(pre_token) > 1 else 1


def processor(model: str):
    if model not in _loaded:
        import sentencepiece

        _loaded[model] = sentencepiece.SentencePieceProcessor(model_file=model)
    return _loaded[model]


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tally(batches, column: str, items, name: str):
    """Counts of items over a task's rows, passed on whenever HELD distinct ones are gathered."""
    held: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array(list(held.values()), pa.int64())], [name, "n"])

    for batch in batches:
        for value in batch[column]:
            held.update(items(value.as_py()))
            if len(held) >= HELD:
                yield out()
                held.clear()
    yield out()


def common_from(counts: DataFrame, most: int = COMMON) -> int:
    """The smallest n for which at most `most` rows of counts (n) have n or more."""
    level = F.floor(F.log2("n") * 8)
    left = most
    found = 2**62
    for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("rows"), F.min("n").alias("least")).orderBy(F.desc("level")).collect():
        left -= r.rows
        if left < 0:
            break
        found = r.least
    return found


def count_tokens(docs: DataFrame, model: str, limit: int = LIMIT, most: int = COMMON) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, n_tokens, over_limit, as the library encodes the whole text.

    Null and empty texts have no token. Each row of docs gives one row; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id"), "text")
    counts = docs.select("text").mapInArrow(lambda b: tally(b, "text", pre_tokens, "piece"), "piece string, n long")
    counts = counts.groupBy("piece").agg(F.sum("n").alias("n"))

    def encode(batches):
        sp = processor(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([piece_count(x, sp) for x in batch["piece"].to_pylist()], pa.int64())], ["piece", "n", "pieces"])

    counts = materialise(counts.mapInArrow(encode, "piece string, n long, pieces long"))
    least = common_from(counts, most)
    common = (F.col("n") >= least) & (F.length("piece") <= COMMON_CHARS)
    shared = spark.sparkContext.broadcast({r.piece: r.pieces for r in counts.where(common).select("piece", "pieces").toLocalIterator()})

    def measure(batches):
        known = shared.value
        for batch in batches:
            sizes, sums, rare, times = [], [], [], []
            for value in batch["text"]:
                text = value.as_py()
                found = Counter(pre_tokens(text))
                sizes.append(len((text or "").encode()))
                sums.append(sum(known[x] * n for x, n in found.items() if x in known))
                left = [x for x in found if x not in known]
                rare.append(left)
                times.append([found[x] for x in left])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(rare, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int32()))],
                ["doc_id", "n_bytes", "known", "rare", "times"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.mapInArrow(measure, f"doc_id {kind}, n_bytes long, known long, rare array<string>, times array<int>")
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()))
    seen = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("piece"), F.col("x.times").alias("times"))
    rest = seen.join(counts.where(~common).select("piece", "pieces"), "piece")
    rest = rest.groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    total = F.col("known") + F.coalesce("more", F.lit(0))
    out = rows.select("row", "doc_id", "n_bytes", "known").join(rest, "row", "left")
    return out.select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), model_path())
