"""The whole as one object: lines in, analysed sessions out, with their stores, searches, exports and figures."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance import config, plugins, streaming
from parlance.operators import analyse, digest, exports, insights, notes, redaction, search, search_index, store
from parlance.streaming import carried

log = logging.getLogger("parlance")


def log_to_stderr(level: int = logging.INFO) -> None:
    """One handler, however often it is asked for."""
    if not log.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(handler)
    log.setLevel(level)


class Engine:
    """lines (session_id, seq, text, speaker, started_at, ended_at, audio_seconds) analysed under settings."""

    def __init__(self, spark: SparkSession, settings: config.Settings | None = None, translator: Callable | None = None):
        self.spark, self.settings = spark, settings or config.Settings()
        wrong = config.problems(self.settings)
        if wrong:
            raise ValueError("; ".join(wrong))
        self.translator = plugins.translate(translator) if translator else None
        self.listeners: dict[str, list[Callable[[DataFrame], None]]] = {}
        self.failures: list[tuple[str, str]] = []

    def subscribe(self, event: str, listener: Callable[[DataFrame], None]) -> None:
        """listener is called with the rows of each event ('transcript', 'actions'); one that fails is noted and the
        others are called all the same."""
        self.listeners.setdefault(event, []).append(listener)

    def _emit(self, event: str, rows: DataFrame) -> None:
        for listener in self.listeners.get(event, []):
            try:
                listener(rows)
            except Exception as e:  # noqa: BLE001
                log.warning("a listener of %s failed: %s", event, e)
                self.failures.append((event, str(e)))

    def toggles(self) -> analyse.Toggles:
        a = self.settings.analytics
        return analyse.Toggles(a.language, self.translator is not None, a.rules, a.entities, a.sentiment, a.topics, a.target, a.default, a.topic_window, a.topic_threshold)

    def scrub(self, lines: DataFrame) -> DataFrame:
        """lines without personal data, in every text column, under one set of pseudonyms."""
        p = self.settings.privacy
        columns = [c for c in ("text", "translation") if c in lines.columns]
        if p.mode == "pseudonym":
            return redaction.redact_together({"lines": (lines, columns, ["seq"])}, p.kinds)["lines"]
        for c in columns:
            lines = redaction.redact(lines, p.kinds, p.mode, p.salt, column=c).drop("n_redacted")
        return lines

    def submit(self, lines: DataFrame, batch_id: int | None = None) -> DataFrame:
        """Analysed lines; with a folder in the settings and a batch_id also stored, with their child tables."""
        if self.settings.privacy.redact_at_source:
            lines = self.scrub(lines)
        return self._keep(analyse.analyse(lines, self.toggles(), self.translator), batch_id)

    def _keep(self, found: DataFrame, batch_id: int | None) -> DataFrame:
        """Analysed lines to the store, once, and from there to the listeners."""
        if self.settings.store.folder and batch_id is not None:
            found = store.append(self.settings.store.folder, batch_id, found)
            if self.settings.store.index:
                search_index.add(found, f"{self.settings.store.folder}/index", str(batch_id))
        self._emit("transcript", found)
        self._emit("actions", analyse.children(found)["action_items"])
        return found

    def follow(self, stream: DataFrame, checkpoint: str):
        """Every batch of a stream analysed, stored and told to the listeners, until all that is there has been read.

        What runs along a session (language in charge, mood, topics) is kept as state from batch to batch. Pseudonyms
        are numbered in a batch, so with redact_at_source in that mode each batch is analysed by itself.
        """
        p = self.settings.privacy
        if p.redact_at_source and p.mode == "pseudonym":
            return streaming.sink(stream, self.submit, checkpoint)
        lines = self.scrub(stream) if p.redact_at_source else stream
        return streaming.sink(carried.analyse_stream(lines, self.toggles(), self.translator), self._keep, checkpoint)

    def stored(self, name: str) -> DataFrame:
        return store.stored(self.spark, self.settings.store.folder, name)

    def digest(self, lines: DataFrame, language: str | None = None) -> DataFrame:
        return digest.build(lines, language=language or self.settings.analytics.default)

    def search(self, lines: DataFrame, sessions: DataFrame, query: str, k: int = 20) -> DataFrame:
        return search.search_sessions(lines, sessions, query, k)

    def search_stored(self, sessions: DataFrame, query: str, k: int = 20, without: str | None = None) -> DataFrame:
        """search() of all stored lines, from their index."""
        index = search_index.Index(self.spark, f"{self.settings.store.folder}/index")
        return search.search_sessions(self.stored("transcript"), sessions, query, k, without, index)

    def review(self, sessions: DataFrame, lines: DataFrame, actions: DataFrame, entities: DataFrame, as_of: float) -> dict[str, DataFrame]:
        return insights.review(sessions, lines, actions, entities, as_of)

    def export(self, form: str, sessions: DataFrame, lines: DataFrame, actions: DataFrame, entities: DataFrame) -> DataFrame:
        """session_id, content in a form of exports.SUFFIX."""
        if form == "md":
            return notes.build(sessions, lines, actions, entities)
        if form == "json":
            return exports.session_documents(sessions, lines, actions, entities)
        return exports.document(exports.blocks(lines, form))

    def health(self, lines: DataFrame, actions: DataFrame, topics: DataFrame) -> DataFrame:
        return store.session_metrics(lines, actions, topics)
