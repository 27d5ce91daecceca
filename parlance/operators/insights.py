"""Commitments across sessions: the same one told twice is shown once, and what keeps coming back."""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from parlance.functions import text as T
from parlance.operators.rules import STORED
from parlance.operators.scratch import written

ALIKE = 0.82
STALE_DAYS = 7.0


def alike(a: str, b: str, least: float = ALIKE) -> bool:
    return bool(a) and bool(b) and (a == b or SequenceMatcher(None, a, b).ratio() >= least)


def clusters(items: DataFrame, least: float = ALIKE) -> DataFrame:
    """items (kind, signature, place) with leader: the place of the first item of the kind, in order of place, that
    leads a cluster and is alike; the item's own place if there is none.

    The order decides who leads, so a kind is one task: for the bounded reports below only.
    """

    def assign(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place")
        leaders: list[tuple[int, str]] = []
        chosen: dict[str, int] = {}
        out = []
        for place, signature in zip(part["place"], part["signature"], strict=True):
            if signature in chosen:
                out.append(chosen[signature])
                continue
            leader = next((p for p, s in leaders if alike(s, signature, least)), None)
            if leader is None:
                leader = place
                leaders.append((place, signature))
            if signature:
                chosen[signature] = leader
            out.append(leader)
        return part.assign(leader=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", leader long"
    return items.groupBy("kind").applyInPandas(assign, schema)


#: Texts of one side of a comparison that a task holds at a time, about.
CHUNK = 2_000


def _letters(texts: pd.Series) -> np.ndarray:
    """How often each text has the characters of each of 64 classes."""
    out = np.zeros((len(texts), 64), np.int32)
    for row, text in zip(out, texts, strict=True):
        np.add.at(row, [ord(c) % 64 for c in text], 1)
    return out


def alike_pairs(texts: DataFrame, least: float = ALIKE, chunk: int = CHUNK) -> DataFrame:
    """texts (kind, signature), distinct and not empty -> kind, a, b, a_leads, b_leads: the pairs that are alike with the
    one or the other as the leader (the ratio is not symmetric).

    Two texts can be alike only if the longer one has at most (2 - least) / least times the other's length, so they lie in
    one band of lengths or in neighbouring ones, and only if they share enough letters; the ratio decides the rest. Bands
    are cut into chunks, and a task compares two of them: no group is held whole, and only pairs that are alike leave a
    task. The comparisons grow with the square of a band, the memory of a task does not.
    """
    width = math.log((2 - least) / least) * (1 + 1e-9)
    sized = texts.select("kind", "signature").withColumn("band", F.floor(F.log(F.length("signature")) / width))
    classes = sized.groupBy("kind", "band").agg(F.ceil(F.count("*") / chunk).alias("pieces"))
    placed = sized.join(classes, ["kind", "band"]).withColumn("piece", F.pmod(F.xxhash64("signature"), F.col("pieces")))
    works = classes.select("kind", "band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"))
    one, two = (works.select("kind", F.col("band").alias(f"band{i}"), F.col("piece").alias(f"piece{i}")) for i in (1, 2))
    beside = one.withColumn("band2", F.explode(F.array("band1", F.col("band1") + 1))).join(two, ["kind", "band2"])
    deal = written(beside.where("band1 < band2 or piece1 <= piece2"))
    key = ["kind", "band1", "piece1", "band2", "piece2"]
    sides = [deal.join(placed.select("kind", F.col("band").alias(f"band{i}"), F.col("piece").alias(f"piece{i}"), "signature"), ["kind", f"band{i}", f"piece{i}"]).select(*key, "signature", F.lit(i).alias("side")) for i in (1, 2)]

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        left, right, out = part[part["side"] == 1], part[part["side"] == 2], []
        if len(left) and len(right):
            x, y = left["signature"].tolist(), right["signature"].tolist()
            own = tuple(left.iloc[0][["band1", "piece1"]]) == tuple(left.iloc[0][["band2", "piece2"]])
            mine, theirs, sizes = _letters(left["signature"]), _letters(right["signature"]), np.array([len(t) for t in y])
            for a, counts in zip(x, mine, strict=True):
                shared = np.minimum(counts, theirs).sum(axis=1)
                for j in np.nonzero(2 * shared >= least * (sizes + len(a)) - 1e-6)[0]:
                    b = y[j]
                    if a < b if own else True:
                        ab, ba = alike(a, b, least), alike(b, a, least)
                        if ab or ba:
                            out.append((left["kind"].iat[0], a, b, ab, ba))
        return pd.DataFrame(out, columns=["kind", "a", "b", "a_leads", "b_leads"])

    return sides[0].unionByName(sides[1]).groupBy(*key).applyInPandas(compare, f"kind {dict(texts.dtypes)['kind']}, a string, b string, a_leads boolean, b_leads boolean")


def leaders(items: DataFrame, least: float = ALIKE, chunk: int = CHUNK) -> DataFrame:
    """clusters() of any number of items: place may be any type with an order. Each text goes by its first place.

    Texts without an earlier one that is alike lead. In rounds, what a leader is alike with is no leader, and a text whose
    earlier ones are all decided, and none a leader, leads; at the end each takes the first leader that is alike. There
    are as many rounds as the longest such chain of texts has links.
    """
    texts = written(items.where("signature <> ''").groupBy("kind", "signature").agg(F.min("place").alias("place")))
    pairs = alike_pairs(texts, least, chunk)
    place = lambda c: texts.select("kind", F.col("signature").alias(c), F.col("place").alias(f"{c}_place"))
    both = pairs.join(place("a"), ["kind", "a"]).join(place("b"), ["kind", "b"])
    first = F.col("a_place") < F.col("b_place")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    links = written(both.where(pick("a_leads", "b_leads")).select("kind", pick("a", "b").alias("early"), pick("b", "a").alias("late"), pick("a_place", "b_place").alias("early_place")))
    late = lambda df: df.select("kind", F.col("late").alias("signature")).distinct()
    early = lambda df: df.select("kind", F.col("signature").alias("early"))
    lead = written(texts.select("kind", "signature").join(late(links), ["kind", "signature"], "left_anti"))
    every, left, new = lead, links.select("kind", "early", "late"), lead
    while not left.isEmpty():
        covered = written(late(left.join(early(new), ["kind", "early"], "left_semi")))
        open_ = left.join(covered.select("kind", F.col("signature").alias("late")), ["kind", "late"], "left_anti")
        rest = written(open_.join(early(covered), ["kind", "early"], "left_anti"))
        new = written(late(open_).join(late(rest), ["kind", "signature"], "left_anti"))
        every, left = every.unionByName(new), rest
    chosen = links.join(early(every), ["kind", "early"], "left_semi").groupBy("kind", F.col("late").alias("signature")).agg(F.min("early_place").alias("_led"))
    told = texts.join(every.withColumn("_leads", F.lit(True)), ["kind", "signature"], "left").join(chosen, ["kind", "signature"], "left")
    told = told.select("kind", "signature", F.when(F.col("_leads"), F.col("place")).otherwise(F.col("_led")).alias("leader"))
    return items.join(told, ["kind", "signature"], "left").withColumn("leader", F.coalesce("leader", "place"))


def _everything(actions: DataFrame) -> DataFrame:
    """_newest() without a limit; the place is the order itself, so that nothing is numbered in one task."""
    down = lambda c: (F.col(c).isNull(), -F.col(c))
    place: Column = F.struct(*down("session_started"), *down("priority"), "created_at", "id")
    rows = actions.where(F.col("kind").isin(*STORED)).withColumn("place", place)
    return rows.withColumn("signature", F.coalesce(T.signature(F.col("text")), F.lit("")))


def _newest(actions: DataFrame, limit: int) -> DataFrame:
    """The report's rows: the first `limit` actions, newest session first, then most urgent, then oldest; of them
    those of a stored kind, numbered in that order."""
    order = (F.desc("session_started"), F.desc("priority"), F.col("created_at"), F.col("id"))
    top = actions.orderBy(*order).limit(limit)
    numbered = top.withColumn("place", F.row_number().over(W.orderBy(*order)).cast("long"))
    return numbered.where(F.col("kind").isin(*STORED)).withColumn("signature", F.coalesce(T.signature(F.col("text")), F.lit("")))


def open_items(actions: DataFrame, as_of: float, limit: int | None = 200, collapse: bool = True) -> DataFrame:
    """Open commitments, most urgent and then oldest first: the newest wording, since when, how often, and whether
    it is stale. actions: id, session_id, session_name, session_started, kind, text,
    priority, due, created_at, done. limit None takes all of them."""
    told = actions.where(~F.col("done"))
    rows = _everything(told) if limit is None else _newest(told, limit)
    grouped = (leaders(rows) if limit is None else clusters(rows)) if collapse else rows.withColumn("leader", F.col("place"))
    first = lambda c: F.min_by(c, "place").alias(c)
    out = grouped.groupBy("kind", "leader").agg(
        *[first(c) for c in ("id", "text", "priority", "due", "session_id", "session_name")],
        F.min("created_at").alias("created_at"), F.count("*").alias("occurrences"),
    )
    age = F.greatest(F.lit(0.0), (F.lit(as_of) - F.col("created_at")) / 86_400)
    out = out.withColumn("age_days", age).withColumn("stale", F.col("age_days") >= STALE_DAYS)
    return out.orderBy(F.desc("priority"), F.desc("age_days"), "leader").drop("leader")


def recurring_items(actions: DataFrame, least_sessions: int = 2, limit: int | None = 400) -> DataFrame:
    """Commitments of the newest `limit` actions, or of all, that come back in at least so many sessions."""
    rows = (_everything(actions) if limit is None else _newest(actions, limit)).where("signature <> ''")
    grouped = leaders(rows) if limit is None else clusters(rows)
    out = grouped.groupBy("kind", "leader").agg(
        F.min_by("text", "place").alias("text"), F.count("*").alias("occurrences"),
        F.array_sort(F.collect_set("session_name")).alias("sessions"), F.array_sort(F.collect_set("text")).alias("variants"),
    )
    return out.where(F.size("sessions") >= least_sessions).orderBy(F.desc(F.size("sessions")), F.desc("occurrences"), "leader").drop("leader")


def review(sessions: DataFrame, lines: DataFrame, actions: DataFrame, entities: DataFrame, as_of: float, newest: int = 20, people: int = 8) -> dict[str, DataFrame]:
    """Across sessions: sessions (the newest, with their figures), open_items, recurring, people (most often named),
    sentiment_trend (oldest of the newest first). lines have compound; actions are as in open_items()."""
    from parlance.operators import store

    order = (F.desc_nulls_last("started_at"), F.col("session_id"))
    summed = store.scored_summaries(sessions, lines).orderBy(*order).limit(newest)
    trend = summed.select("session_id", F.coalesce("name", F.col("session_id").cast("string")).alias("name"), "utterances", F.coalesce("average_sentiment", F.lit(0.0)).alias("average_sentiment"), "started_at")
    place = F.row_number().over(W.orderBy(F.asc_nulls_first("started_at"), F.desc("session_id")))
    return {
        "sessions": summed, "open_items": open_items(actions, as_of), "recurring": recurring_items(actions),
        "people": store.ranked_entities(entities, "person", people), "sentiment_trend": trend.withColumn("place", place),
    }


def review_markdown(parts: dict[str, DataFrame]) -> str:
    """The page of a review(); its parts are bounded reports, so they are collected."""
    found = {name: df.collect() for name, df in parts.items()}
    items = found["open_items"]
    out = ["# Across your sessions", "", f"{len(found['sessions'])} session(s) · {len(items)} open item(s) · {sum(r.stale for r in items)} older than {STALE_DAYS:.0f} days", "", "## Still open", ""]
    for r in items:
        kind = "" if r.kind == "action_item" else r.kind.replace("_", " ") + ": "
        more = (f" · due {r.due}" if r.due else "") + (f" · raised {r.occurrences}x" if r.occurrences > 1 else "")
        out.append(f"- [ ] {kind}{r.text}{more} _({r.session_name or r.session_id}, {r.age_days:.0f}d ago)_" + (" **stale**" if r.stale else ""))
    if not items:
        out.append("- nothing outstanding")
    if found["recurring"]:
        out += ["", "## Keeps coming up", "", *(f"- {r.text} — {r.occurrences} times across {len(r.sessions)} sessions" for r in found["recurring"])]
    if found["people"]:
        out += ["", "## Named most often", "", *(f"- {r.text} · {r.mentions} mentions in {r.sessions} sessions" for r in sorted(found["people"], key=lambda r: r["rank"]))]
    if found["sentiment_trend"]:
        out += ["", "## Mood by session", "", "| session | utterances | sentiment |", "| --- | --- | --- |"]
        out += [f"| {r.name} | {r.utterances} | {r.average_sentiment:+.2f} |" for r in sorted(found["sentiment_trend"], key=lambda r: r.place)]
    return "\n".join([*out, ""])
