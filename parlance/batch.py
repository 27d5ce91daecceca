"""Folders of recordings, one file after the other kept apart: decode, segment, tell voices, recognise, analyse, write."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance import plugins
from parlance.audio import segments, signal, speakers
from parlance.operators import analyse, exports
from parlance.operators.scratch import written
from parlance.sources import recordings

MANIFEST = "path string, status string, audio_seconds double, segments int, lines int, error string"


@dataclass
class Job:
    """What a folder gave: the analysed lines, and a manifest row for each file (MANIFEST)."""

    lines: DataFrame
    manifest: DataFrame


def session_of(path):
    return F.substring(F.sha2(path, 256), 1, 12)  # a file's stem may come in two folders


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A row for each path of the manifest, to which every run adds its rows: the newest one, but done stays done. None
    where there is no file; rows that cannot be read are left out."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], MANIFEST)
    rows = spark.read.schema(MANIFEST).option("mode", "DROPMALFORMED").json(path).where("path is not null and status is not null")
    return _newest(rows.select("*", F.col("_metadata.file_modification_time").alias("at")))


def _newest(rows: DataFrame) -> DataFrame:
    best = F.max_by(F.struct(*[f.split()[0] for f in MANIFEST.split(", ")]), F.struct((F.col("status") == "done").cast("int"), "at"))
    return rows.groupBy(F.col("path").alias("_p")).agg(best.alias("x")).select("x.*")


def run(files: DataFrame, factory: Callable, gate: segments.Gate = segments.Gate(), toggles: analyse.Toggles = analyse.Toggles()) -> Job:  # noqa: B008
    """files (path, content) -> Job. Spark's tasks are the workers; a file that cannot be read, or whose recogniser
    fails, is marked failed with the reason, and the others go on."""
    loaded = recordings.load(files)
    blocks = loaded.where("error is null").select(F.col("path").alias("stream_id"), F.lit(0).alias("block_no"), "samples")
    cut = segments.segments(blocks, gate, voices=True)
    voiced = cut.withColumn("embedding", signal.embeddings(F.col("samples")))
    order = F.row_number().over(_in_order()).cast("int")
    voiced = voiced.withColumn("seq", order).withColumn("session_id", session_of(F.col("stream_id")))
    told = speakers.clusters(voiced.select("session_id", "seq", "embedding")).select("session_id", "seq", "speaker", F.col("confidence").alias("speaker_confidence"))
    heard = plugins.recognise(voiced.drop("embedding", "n", "peak_rms", "noise_floor", "is_final"), factory)
    said = written(heard.drop("samples"))  # lines and manifest both come from it, and a segment is recognised once
    said = said.join(told, ["session_id", "seq"], "left").withColumn("audio_seconds", F.col("ended_at") - F.col("started_at"))
    lines = analyse.analyse(said.where("error is null"), toggles)
    per_file = said.groupBy(F.col("stream_id").alias("path")).agg(F.count("*").cast("int").alias("segments"), F.count_if(F.col("error").isNull()).cast("int").alias("lines"), F.max("error").alias("spoken_error"))
    done = loaded.select("path", F.col("seconds").alias("audio_seconds"), "error").join(per_file, "path", "left")
    error = F.coalesce("error", "spoken_error")
    manifest = done.select(
        "path", F.when(error.isNull(), "done").otherwise("failed").alias("status"), "audio_seconds",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("segments", "lines")], error.alias("error"),
    )
    return Job(lines, manifest)


def _in_order():
    from pyspark.sql.window import Window as W

    return W.partitionBy("stream_id").orderBy("n", "started_at")


def run_folder(spark: SparkSession, folder: str, output: str, factory: Callable, form: str = "srt") -> DataFrame:
    """The files of folder that are not done yet, their transcripts below output, and the manifest beside them, which is
    returned with the files passed over marked skipped."""
    files = recordings.discover(spark, folder).select("path", "content")
    old = written(load_manifest(spark, f"{output}/manifest"))
    job = run(recordings.pending(files, old), factory)
    exports.write(exports.blocks(job.lines, form), f"{output}/{form}")
    now = written(job.manifest)
    now.write.mode("append").json(f"{output}/manifest")  # last: a file is done once its transcript is there
    passed = files.select("path").join(old.where("status = 'done'"), "path").withColumn("status", F.lit("skipped"))
    return now.unionByName(passed.select(*now.columns))
