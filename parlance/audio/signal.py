"""Figures of sample arrays, and voice features, as NumPy functions and as columns."""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RATE = 16_000
FLOOR_DB = -90.0
# The band of speech and the limits of the gate; the sizes of the cepstral front end.
SPEECH_BAND = (150.0, 3_800.0)
MIN_BAND_RATIO, MAX_FLATNESS, MAX_CROSSINGS = 0.30, 0.30, 0.35
PRE_EMPHASIS, FRAME_MS, STRIDE_MS, FFT, MELS, CEPSTRA, LIFTER = 0.97, 25, 10, 512, 26, 13, 22


def rms(samples: np.ndarray) -> float:
    return float(np.sqrt(np.mean(np.square(samples, dtype=np.float64)))) if len(samples) else 0.0


def figures(samples: Column) -> Column:
    """struct<rms,peak,dbfs> of an array of samples; an empty or null one is silent."""
    x = F.transform(F.coalesce(samples, F.array().cast("array<double>")), lambda s: s.cast("double"))
    n = F.greatest(F.size(x), F.lit(1))
    level = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, s: a + s * s) / n)
    peak = F.aggregate(x, F.lit(0.0), lambda a, s: F.greatest(a, F.abs(s)))
    db = F.when(level > 0, F.greatest(F.lit(FLOOR_DB), F.log10(level) * 20)).otherwise(FLOOR_DB)
    return F.struct(level.alias("rms"), peak.alias("peak"), db.alias("dbfs"))


def spectral_profile(frame: np.ndarray, rate: int = RATE) -> tuple[float, float, float]:
    """Share of the power in the band of speech, flatness (geometric over arithmetic mean of the power), and share of
    neighbouring samples with a change of sign. Frames of under 64 samples count as noise."""
    x = np.asarray(frame, np.float64)
    if len(x) < 64:
        return 0.0, 1.0, 0.0
    power = np.abs(np.fft.rfft(x * np.hanning(len(x)))) ** 2 + 1e-12
    pitch = np.fft.rfftfreq(len(x), 1 / rate)
    inside = (pitch >= SPEECH_BAND[0]) & (pitch <= SPEECH_BAND[1])
    signs = np.signbit(x)
    flatness = min(1.0, float(np.exp(np.log(power).mean()) / power.mean()))
    return float(power[inside].sum() / power.sum()), flatness, float((signs[1:] != signs[:-1]).mean())


def is_speech(frame: np.ndarray, rate: int = RATE) -> bool:
    band, flatness, crossings = spectral_profile(frame, rate)
    return band >= MIN_BAND_RATIO and flatness <= MAX_FLATNESS and crossings <= MAX_CROSSINGS


def mel(hertz):
    return 2595 * np.log10(1 + np.asarray(hertz, np.float64) / 700)


def hertz(mels):
    return 700 * (10 ** (np.asarray(mels, np.float64) / 2595) - 1)


@cache
def _filters(rate: int) -> np.ndarray:
    """MELS triangles, evenly spaced in mel from 0 to half the rate, over the bins of the spectrum."""
    edges = np.floor((FFT + 1) * hertz(np.linspace(0, mel(rate / 2), MELS + 2)) / rate).astype(int)
    bins = np.arange(FFT // 2 + 1)
    rows = []
    for low, mid, high in zip(edges, edges[1:], edges[2:], strict=False):
        mid = max(mid, low + 1)
        high = min(max(high, mid + 1), FFT // 2)
        mid = min(mid, high - 1) if high - 1 > low else mid
        up, down = (bins - low) / max(1, mid - low), (high - bins) / max(1, high - mid)
        rows.append(np.where((bins >= low) & (bins < mid), up, np.where((bins >= mid) & (bins < high), down, 0.0)))
    return np.array(rows)


@cache
def _cosines() -> np.ndarray:
    order, grid = np.arange(CEPSTRA)[:, None], np.arange(MELS)[None] + 0.5
    return np.cos(np.pi * order * grid / MELS) * np.sqrt(2 / MELS)


def cepstra(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """CEPSTRA mel cepstral coefficients of every frame; none for under FFT samples."""
    x = np.asarray(samples, np.float64)
    size, stride = round(rate * FRAME_MS / 1000), round(rate * STRIDE_MS / 1000)
    if len(x) < max(FFT, size):
        return np.zeros((0, CEPSTRA))
    x = np.concatenate([x[:1], x[1:] - PRE_EMPHASIS * x[:-1]])
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[::stride] * np.hamming(size)
    power = np.abs(np.fft.rfft(frames, FFT)) ** 2 / FFT
    found = np.log(np.maximum(power @ _filters(rate).T, 1e-10)) @ _cosines().T
    return found * (1 + LIFTER / 2 * np.sin(np.pi * np.arange(CEPSTRA) / LIFTER))


def embedding(samples: np.ndarray, rate: int = RATE) -> np.ndarray | None:
    """Means and standard deviations of the cepstra, of length 1; none for fewer than three frames."""
    found = cepstra(samples, rate)
    if len(found) < 3:
        return None
    both = np.concatenate([found.mean(0), found.std(0)])
    size = np.linalg.norm(both)
    return (both / size).astype(np.float32) if np.isfinite(size) and size > 0 else None


def embeddings(samples: Column) -> Column:
    """embedding() of a column; null where there is none."""

    @F.pandas_udf("array<float>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda s: None if s is None else embedding(np.asarray(s)))

    return run(samples)


def change_point(samples: np.ndarray, rate: int = RATE, window: float = 0.8, hop: float = 0.2, threshold: float = 0.35) -> int | None:
    """The sample where the voices of the windows on both sides differ most, if by more than threshold."""
    size, step = int(window * rate), max(1, int(hop * rate))
    best, at = threshold, None
    for centre in range(size, len(samples) - size + 1, step):
        a, b = embedding(samples[centre - size : centre], rate), embedding(samples[centre : centre + size], rate)
        if a is not None and b is not None and 1 - float(a @ b) > best:
            best, at = 1 - float(a @ b), centre
    return at


def two_voices(seconds: float = 2.0, rate: int = RATE, seed: int = 11) -> np.ndarray:
    """Two made-up voices, one after the other: harmonics of 170 and 240 Hz in differing strengths, a little noise."""
    t = np.arange(int(seconds * rate)) / rate
    rng = np.random.default_rng(seed)
    parts = []
    for base, fall, last in ((170.0, 1.6, 5), (240.0, 0.4, 11)):
        voice = sum(np.sin(2 * np.pi * base * k * t) / k**fall for k in range(1, last + 1))
        parts.append(0.3 * voice / np.abs(voice).max() + 0.002 * rng.standard_normal(len(t)))
    return np.concatenate(parts).astype(np.float32)
