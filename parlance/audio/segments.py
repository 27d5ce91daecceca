"""Speech segments of a sample stream: one state machine for batch and streaming."""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parlance.audio import signal


@dataclass(frozen=True)
class Gate:
    """When a segment opens and closes. Lengths in seconds are taken in whole frames."""

    rate: int = signal.RATE
    frame_ms: int = 30
    silence: float = 1.5e-3
    ratio: float = 3.2
    floor_keeps: float = 0.95
    start_frames: int = 3
    pre_roll: float = 0.35
    hangover: float = 0.55
    least: float = 1.2
    most: float = 12.0
    spectral: bool = True
    partials: bool = False
    partial_every: float = 2.0
    partial_least: float = 1.0

    @property
    def frame(self) -> int:
        return max(1, self.rate * self.frame_ms // 1000)

    def frames(self, seconds: float) -> int:
        return max(1, int(seconds * 1000 / self.frame_ms))


@dataclass
class Segmenter:
    """Samples in, segments out: dicts of n, started_at, ended_at (seconds of the stream), reason, is_final, peak_rms,
    noise_floor and samples. Frames are gated by an adaptive level and by their spectrum; the floor learns from every
    frame that is no speech, within segments too. A segment that is too short is dropped and takes no number."""

    gate: Gate = field(default_factory=Gate)
    floor: float = -1.0
    frames_seen: int = 0
    number: int = 0
    loud: int = 0
    quiet: int = 0
    peak: float = 0.0
    shown: float = 0.0
    opened: bool = False
    rest: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    held: list[np.ndarray] = field(default_factory=list)

    def push(self, samples: np.ndarray) -> Iterator[dict]:
        g = self.gate
        if self.floor < 0:
            self.floor = g.silence
        both = np.concatenate([self.rest, np.asarray(samples, np.float32)])
        whole = len(both) // g.frame * g.frame
        self.rest = both[whole:]
        for frame in both[:whole].reshape(-1, g.frame):
            found = self._frame(frame)
            if found:
                yield found

    def flush(self) -> dict | None:
        """The open segment, whatever its length, at the end of the stream."""
        rest, self.rest = self.rest, self.rest[:0]
        found = None
        if self.opened:
            self.held.append(rest)
            found = self._segment("flush", len(rest))
            self.number += 1
        self._close()
        return found

    def _frame(self, frame: np.ndarray) -> dict | None:
        g = self.gate
        self.frames_seen += 1
        level = signal.rms(frame)
        speech = level >= max(g.silence, self.floor * g.ratio) and (not g.spectral or signal.is_speech(frame, g.rate))
        if not speech:
            self.floor = g.floor_keeps * self.floor + (1 - g.floor_keeps) * level
        self.held.append(frame)
        if not self.opened:
            del self.held[: -g.frames(g.pre_roll)]
            self.loud = self.loud + 1 if speech else 0
            if self.loud >= g.start_frames:
                self.opened, self.quiet, self.peak = True, 0, 0.0
            return None
        self.peak = max(self.peak, level)
        self.quiet = 0 if speech else self.quiet + 1
        seconds = self._seconds()
        if seconds >= g.most:
            return self._emit("max_length")
        if self.quiet >= g.frames(g.hangover):
            if seconds >= g.least:
                return self._emit("silence")
            self._close()
            return None
        if g.partials and seconds >= g.partial_least and seconds - self.shown >= g.partial_every:
            self.shown = seconds
            return self._segment("partial")
        return None

    def _seconds(self) -> float:
        return sum(map(len, self.held)) / self.gate.rate

    def _segment(self, reason: str, more: int = 0) -> dict:
        samples = np.concatenate(self.held)
        end = (self.frames_seen * self.gate.frame + more) / self.gate.rate
        found = {"n": self.number, "started_at": end - len(samples) / self.gate.rate, "ended_at": end, "reason": reason, "is_final": reason != "partial"}
        return found | {"peak_rms": self.peak, "noise_floor": self.floor, "samples": samples}

    def _emit(self, reason: str) -> dict:
        found = self._segment(reason)
        self._close()
        self.number += 1
        return found

    def _close(self) -> None:
        self.held, self.opened = [], False
        self.loud = self.quiet = 0
        self.peak = self.shown = 0.0


SCHEMA = "n int, started_at double, ended_at double, reason string, is_final boolean, peak_rms double, noise_floor double, samples array<float>"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def split_voices(segment: dict, rate: int = signal.RATE, threshold: float = 0.35, window: float = 0.8, least: float = 0.6) -> list[dict]:
    """The segment, or its two parts where another voice takes over; both keep its number."""
    samples = segment["samples"]
    if len(samples) / rate < 2 * window + least:
        return [segment]
    at = signal.change_point(samples, rate, window, threshold=threshold)
    if at is None or min(at, len(samples) - at) / rate < least:
        return [segment]
    cut = segment["started_at"] + at / rate
    return [segment | {"samples": samples[:at], "ended_at": cut, "reason": "speaker_change"}, segment | {"samples": samples[at:], "started_at": cut}]


def _parts(found: dict, gate: Gate, voices: bool) -> list[dict]:
    return split_voices(found, gate.rate) if voices and found["is_final"] else [found]


def segments(blocks: DataFrame, gate: Gate = Gate(), voices: bool = False) -> DataFrame:  # noqa: B008
    """blocks (stream_id, block_no, samples) -> stream_id and SCHEMA. Blocks of a stream come in order through one
    task, block by block; what is open at a stream's end is given out. A block that is there twice counts once; one that
    is missing leaves no gap."""
    kind = dict(blocks.dtypes)["stream_id"]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, machine, before, out = None, None, None, []

        def add(found, key):
            out.extend({"stream_id": key, **s} for s in _parts(found, gate, voices))

        for part in batches:
            for key, no, samples in zip(part["stream_id"], part["block_no"], part["samples"], strict=True):
                if machine is None or key != stream:
                    if machine and (last := machine.flush()):
                        add(last, stream)
                    stream, machine, before = key, Segmenter(gate), None
                if no == before:
                    continue
                before = no
                for found in machine.push(samples if samples is not None else []):
                    add(found, key)
            if out:
                yield pd.DataFrame(out, columns=["stream_id", *_COLUMNS])
                out = []
        if machine and (last := machine.flush()):
            add(last, stream)
            yield pd.DataFrame(out, columns=["stream_id", *_COLUMNS])

    ordered = blocks.select("stream_id", "block_no", "samples").repartition("stream_id").sortWithinPartitions("stream_id", "block_no")
    return ordered.mapInPandas(run, f"stream_id {kind}, {SCHEMA}")


#: Blocks that wait for a missing one before it is given up.
PATIENCE = 64


@dataclass
class Reordered:
    """Blocks by number, in order, to a machine. A missing one is waited for until `patience` later ones are there, then
    left out; one that comes after its place has passed, a repeat too, is dropped."""

    machine: Segmenter
    patience: int = PATIENCE
    following: int = 0
    ends: int | None = None
    waiting: dict[int, np.ndarray] = field(default_factory=dict)

    def put(self, no: int, samples, last: bool) -> None:
        if last:
            self.ends = no if self.ends is None else min(self.ends, no)
        if no >= self.following:
            self.waiting.setdefault(no, np.asarray(samples if samples is not None else [], np.float32))

    def ready(self, all_of_them: bool = False) -> Iterator[dict]:
        while self.waiting and not self.ended:
            if self.following not in self.waiting:
                if not all_of_them and len(self.waiting) <= self.patience:
                    return
                self.following = min(self.waiting)
            samples = self.waiting.pop(self.following)
            self.following += 1
            yield from self.machine.push(samples)

    @property
    def ended(self) -> bool:
        return self.ends is not None and self.following > self.ends


def streamed(blocks: DataFrame, gate: Gate = Gate(), voices: bool = False, idle: float | None = None, late: float = 10.0, patience: int = PATIENCE) -> DataFrame:  # noqa: B008
    """segments() of a streaming DataFrame (stream_id string, block_no from 0, samples, last boolean): the machine of each
    stream is its state, one open segment and at most `patience` blocks that wait for an earlier one.

    A block with last true ends its stream. With idle, blocks also have `at`, a timestamp: a stream without a new block
    for idle seconds of event time (late more before the watermark passes) gives out what waits and what is open, and its
    state goes. A later block of it begins a new recording, numbered from 0 again.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        order = pickle.loads(state.get[0]) if state.exists else Reordered(Segmenter(gate), patience)
        newest, out = state.get[1] if state.exists else 0, []
        for part in parts:
            for no, samples, last in zip(part["block_no"], part["samples"], part["last"], strict=True):
                order.put(int(no), samples, bool(last))
            out += order.ready()
            if idle is not None and len(part):
                newest = max(newest, int(part["at_ms"].max()))
        if state.hasTimedOut:
            out += order.ready(all_of_them=True)
        if state.hasTimedOut or order.ended:
            last = order.machine.flush()
            out += [last] if last else []
            state.remove()
        else:
            state.update((pickle.dumps(order), newest))
            if idle is not None:
                state.setTimeoutTimestamp(max(newest + int(idle * 1000), state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame([{"stream_id": key[0], **s} for found in out for s in _parts(found, gate, voices)], columns=["stream_id", *_COLUMNS])

    rows = blocks if idle is None else blocks.withWatermark("at", f"{late} seconds").withColumn("at_ms", F.unix_millis("at"))
    how = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.EventTimeTimeout
    return rows.groupBy("stream_id").applyInPandasWithState(step, f"stream_id string, {SCHEMA}", "machine binary, newest long", "append", how)
