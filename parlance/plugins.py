"""Speech recognisers and translators that a deployment brings: registries, and simple ones to go on with."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECOGNISERS: dict[str, tuple[int, Callable]] = {}
TRANSLATORS: dict[str, tuple[int, Callable]] = {}


def recogniser(name: str, priority: int = 0):
    """Registers a factory of functions (samples, rate) -> text. A factory that cannot work here raises."""
    return lambda f: RECOGNISERS.__setitem__(name, (priority, f)) or f


def translator(name: str, priority: int = 0):
    """Registers a factory of functions (text, source, target) -> text or None."""
    return lambda f: TRANSLATORS.__setitem__(name, (priority, f)) or f


def available(registry: Mapping[str, tuple[int, Callable]]) -> dict[str, str]:
    """name -> 'ready', or why not, the best first."""
    out = {}
    for name, (_, factory) in sorted(registry.items(), key=lambda x: (-x[1][0], x[0])):
        try:
            factory()
            out[name] = "ready"
        except Exception as e:  # noqa: BLE001  (a plug-in may fail in any way)
            out[name] = str(e) or type(e).__name__
    return out


def chosen(registry: Mapping[str, tuple[int, Callable]], name: str = "auto") -> Callable:
    """The factory named, or the one of the highest priority that works."""
    if name != "auto":
        if name not in registry:
            raise ValueError(f"unknown plug-in {name!r}; known: {', '.join(sorted(registry)) or 'none'}")
        return registry[name][1]
    for candidate, state in available(registry).items():
        if state == "ready":
            return registry[candidate][1]
    raise ValueError("no plug-in works here")


@recogniser("none", -100)
def _silent():
    return lambda samples, rate: ""


def scripted(lines: list[str]):
    """A recogniser factory that tells the lines in turn, by the loudness of the samples: for tests and demonstrations."""
    return lambda: lambda samples, rate: lines[int(1_000 * float(np.abs(samples).max())) % len(lines)] if len(samples) else ""


@translator("identity", -100)
def _identity():
    return lambda text, source, target: text if source == target else None


def dictionary(tables: Mapping[tuple[str, str], Mapping[str, str]]):
    """A translator factory, word by word: tables (source, target) -> words. Unknown words stay, unknown pairs give None."""

    def make():
        def run(text: str, source: str, target: str) -> str | None:
            table = tables.get((source, target))
            return None if table is None else " ".join(table.get(w.lower(), w) for w in text.split())

        return run

    return make


def recognise(segments: DataFrame, factory: Callable, rate: int = 16_000) -> DataFrame:
    """segments (samples) with text, inference_seconds, realtime_factor, error in place of samples. Segments without text
    are left out; one that fails has its error and an empty text, and the others go on."""
    names = [f.name for f in segments.schema if f.name != "samples"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in segments.schema if f.name != "samples")

    def run(batches):
        import time

        speak = factory()
        for part in batches:
            rows = []
            for samples in part["samples"]:
                began = time.perf_counter()
                x = np.asarray(samples if samples is not None else [], np.float32)
                try:
                    text, error = (speak(x, rate) or "").strip(), None
                except Exception as e:  # noqa: BLE001
                    text, error = "", str(e) or type(e).__name__
                took = time.perf_counter() - began
                rows.append((text, took, took * rate / len(x) if len(x) else 0.0, error))
            found = pd.DataFrame(rows, columns=["text", "inference_seconds", "realtime_factor", "error"], index=part.index)
            yield pd.concat([part[names], found], axis=1)

    out = segments.mapInPandas(run, f"{kinds}, text string, inference_seconds double, realtime_factor double, error string")
    return out.where((F.col("text") != "") | F.col("error").isNotNull())


def translate(factory: Callable):
    """A column function (text, from, to) -> text, null where the text is empty, the languages are the same, or the
    translator has none or fails. Equal texts of a batch are translated once."""

    def column(text: Column, source: Column, target: Column) -> Column:
        @F.pandas_udf("string")
        def run(texts: pd.Series, sources: pd.Series, targets: pd.Series) -> pd.Series:
            say, known = factory(), {}

            def one(t, a, b):
                if not t or not t.strip() or a == b:
                    return None
                if (t, a, b) not in known:
                    try:
                        known[t, a, b] = say(t, a, b)
                    except Exception:  # noqa: BLE001
                        known[t, a, b] = None
                return known[t, a, b]

            return pd.Series([one(*x) for x in zip(texts, sources, targets, strict=True)])

        return run(text, source, target)

    return column


def reanchored(spans: Column, start: Column) -> Column:
    """Spans (start, end, text, words) of a segment on the clock of its session."""
    moved = lambda s, *more: F.struct((s["start"] + start).alias("start"), (s["end"] + start).alias("end"), s["text"].alias("text"), *more)
    return F.transform(spans, lambda s: moved(s, F.transform(s["words"], moved).alias("words")))
