"""Recordings: file discovery, WAV decoding, and manifests of finished files."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RATE = 16_000


def discover(spark: SparkSession, target: str) -> DataFrame:
    """path, length, content of a .wav file, or of all below a folder, whatever the case of the suffix, by path; a
    target that is not there gives none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "path string, length long, content binary")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[wW][aA][vV]").load(target)
    return found.select("path", "length", "content").orderBy("path")


def decode(content: bytes, rate: int = RATE) -> np.ndarray:
    """Mono float samples at `rate`. 8, 16 and 32 bit PCM; others raise ValueError."""
    with wave.open(io.BytesIO(content)) as f:
        width, channels, source = f.getsampwidth(), f.getnchannels(), f.getframerate()
        raw = f.readframes(f.getnframes())
    if width == 1:
        samples = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 2:
        samples = np.frombuffer(raw, "<i2").astype(np.float32) / 2**15
    elif width == 4:
        samples = (np.frombuffer(raw, "<i4") / 2**31).astype(np.float32)
    else:
        raise ValueError(f"{width * 8} bit samples are not supported")
    return resample(samples.reshape(-1, channels).mean(1), source, rate)


def resample(samples: np.ndarray, source: int, target: int) -> np.ndarray:
    """Linear interpolation."""
    if source == target or not len(samples):
        return samples.astype(np.float32)
    n = max(1, round(len(samples) * target / source))
    at = np.linspace(0, len(samples) - 1, n)
    return np.interp(at, np.arange(len(samples)), samples).astype(np.float32)


def load(files: DataFrame, rate: int = RATE) -> DataFrame:
    """path, samples, seconds, error: a file that can't be read has its error and no samples, the others go on."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, content in zip(part["path"], part["content"], strict=True):
                try:
                    samples = decode(content, rate)
                    rows.append((path, samples, len(samples) / rate, None))
                except (ValueError, EOFError, wave.Error) as e:
                    rows.append((path, None, 0.0, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "samples", "seconds", "error"])

    return files.mapInPandas(run, "path string, samples array<float>, seconds double, error string")


def pending(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that no manifest row marks as done; done once is done for good."""
    return files.join(manifest.where("status = 'done'").select("path"), "path", "left_anti")


def report(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("status").agg(F.count("*").alias("files"), F.sum("audio_seconds").alias("audio_seconds"))
