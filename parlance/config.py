"""Settings in sections, read from JSON: unknown keys are dropped and named, missing ones have their defaults."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from typing import Any

from parlance.functions.language import SUPPORTED
from parlance.operators.exports import SUFFIX
from parlance.operators.redaction import DEFAULT_KINDS, ENTITY_KINDS, MODES, PATTERNS


@dataclass
class Audio:
    rate: int = 16_000
    frame_ms: int = 30


@dataclass
class Segments:
    silence: float = 1.5e-3
    ratio: float = 3.2
    pre_roll: float = 0.35
    hangover: float = 0.55
    least: float = 1.2
    most: float = 12.0
    partials: bool = False


@dataclass
class Speech:
    backend: str = "auto"
    translate: bool = False
    most_of_real_time: float = 0.75


@dataclass
class Speakers:
    threshold: float = 0.72
    room: int = 8
    rate: float = 0.25


@dataclass
class Analytics:
    rules: bool = True
    entities: bool = True
    sentiment: bool = True
    topics: bool = True
    language: bool = True
    default: str = "en"
    target: str = "en"
    topic_window: int = 6
    topic_threshold: float = 0.15


@dataclass
class Privacy:
    redact_at_source: bool = False
    kinds: list[str] = field(default_factory=lambda: list(DEFAULT_KINDS))
    mode: str = "pseudonym"
    salt: str = ""


@dataclass
class Store:
    folder: str = ""
    transcript_lines: int = 5_000
    timeline_lines: int = 2_000
    index: bool = False  # of the words of stored lines, for Engine.search_stored


@dataclass
class Export:
    formats: list[str] = field(default_factory=lambda: ["md", "srt"])


@dataclass
class Settings:
    audio: Audio = field(default_factory=Audio)
    segments: Segments = field(default_factory=Segments)
    speech: Speech = field(default_factory=Speech)
    speakers: Speakers = field(default_factory=Speakers)
    analytics: Analytics = field(default_factory=Analytics)
    privacy: Privacy = field(default_factory=Privacy)
    store: Store = field(default_factory=Store)
    export: Export = field(default_factory=Export)


def from_dict(data: dict[str, Any]) -> tuple[Settings, list[str]]:
    """The settings, and the keys (section.key) that are none."""
    settings, unknown = Settings(), []
    for name, values in (data or {}).items():
        section = getattr(settings, name, None)
        if section is None or not isinstance(values, dict):
            unknown.append(name)
            continue
        known = {f.name for f in fields(section)}
        unknown += [f"{name}.{k}" for k in values if k not in known]
        for k in known & values.keys():
            setattr(section, k, values[k])
    return settings, sorted(unknown)


def load(path: str) -> Settings:
    """Settings of a JSON file; one that is missing gives the defaults, one that is not JSON raises ValueError."""
    try:
        with open(path, encoding="utf-8") as f:
            return from_dict(json.load(f))[0]
    except FileNotFoundError:
        return Settings()


def save(settings: Settings, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(to_json(settings) + "\n")


def to_json(settings: Settings) -> str:
    return json.dumps(asdict(settings), indent=2, ensure_ascii=False)


def problems(settings: Settings) -> list[str]:
    """What is wrong with the settings, a line for each; none if they can be used."""
    s, out = settings, []

    def need(good: bool, text: str) -> None:
        if not good:
            out.append(text)

    need(s.audio.rate >= 8_000, "audio.rate must be 8000 at least")
    need(s.audio.frame_ms in (10, 20, 30), "audio.frame_ms must be 10, 20 or 30")
    need(s.segments.ratio > 1, "segments.ratio must be over 1")
    need(s.segments.silence >= 0, "segments.silence must not be negative")
    need(0 < s.segments.least < s.segments.most, "segments.least must be positive and below segments.most")
    need(s.segments.pre_roll >= 0 and s.segments.hangover > 0, "segments.pre_roll and segments.hangover must not be negative")
    need(0 < s.speech.most_of_real_time <= 1, "speech.most_of_real_time must be between 0 and 1")
    need(0 < s.speakers.threshold < 1, "speakers.threshold must be between 0 and 1")
    need(1 <= s.speakers.room <= 26, "speakers.room must be between 1 and 26")
    need(0 <= s.speakers.rate <= 1, "speakers.rate must be between 0 and 1")
    need(s.analytics.default in SUPPORTED and s.analytics.target in SUPPORTED, f"analytics.default and analytics.target must be of {', '.join(SUPPORTED)}")
    need(s.analytics.topic_window >= 1 and 0 < s.analytics.topic_threshold < 1, "analytics.topic_window must be positive and topic_threshold between 0 and 1")
    need(s.privacy.mode in MODES, f"privacy.mode must be of {', '.join(MODES)}")
    need(set(s.privacy.kinds) <= {*PATTERNS, *ENTITY_KINDS}, f"privacy.kinds must be of {', '.join([*PATTERNS, *ENTITY_KINDS])}")
    need(s.store.transcript_lines > 0 and s.store.timeline_lines > 0, "store.transcript_lines and store.timeline_lines must be positive")
    need(set(s.export.formats) <= set(SUFFIX), f"export.formats must be of {', '.join(SUFFIX)}")
    return out
