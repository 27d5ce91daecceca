"""Meeting notes as Markdown: a row a session, put together from its parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.operators import digest, store


def _joined(rows: DataFrame, order: list[str], line: Column) -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct(*order, line.alias("_line"))))
    return rows.groupBy("session_id").agg(F.array_join(F.transform(items, lambda x: x["_line"]), "\n").alias("part"), F.count("*").alias("n"))


def actions_part(actions: DataFrame) -> DataFrame:
    """Check boxes, most urgent and then oldest first."""
    kind = F.when(F.col("kind") == "action_item", "").otherwise(F.concat(F.lit("**"), F.translate("kind", "_", " "), F.lit("** ")))
    due = F.when(F.coalesce("due", F.lit("")) != "", F.concat(F.lit(" _(due "), "due", F.lit(")_"))).otherwise("")
    line = F.concat(F.when(F.col("done"), "- [x] ").otherwise("- [ ] "), kind, F.col("text"), due)
    return _joined(actions.withColumn("_urgent", -F.col("priority")), ["_urgent", "created_at", "id"], line)


def speakers_part(lines: DataFrame) -> DataFrame:
    """A table of store.speaker_totals()."""
    s = store.speaker_totals(lines)
    line = F.format_string("| %s | %.0f%% | %d | %+.2f |", "speaker", F.col("share") * 100, "lines", F.coalesce("average_sentiment", F.lit(0.0)))
    return _joined(s, ["rank"], line)


def entities_part(entities: DataFrame) -> DataFrame:
    """A line for each kind, its entities by how often they come."""
    counted = store.entity_counts(entities).withColumn("_often", -F.col("n"))
    each = F.array_sort(F.collect_list(F.struct("_often", "text", F.format_string("%s (%d)", "text", "n").alias("said"))))
    kinds = counted.groupBy("session_id", "kind").agg(F.array_join(F.transform(each, lambda x: x["said"]), ", ").alias("said"))
    return _joined(kinds, ["kind"], F.concat(F.lit("- **"), "kind", F.lit("**: "), "said"))


def transcript_part(lines: DataFrame) -> DataFrame:
    who = F.when(F.coalesce("speaker", F.lit("")) != "", F.concat(F.lit("**"), "speaker", F.lit("** · "))).otherwise("")
    line = F.concat(F.lit("- "), who, F.coalesce("text", F.lit("")))
    if "translation" in lines.columns:
        line = F.concat(line, F.when(F.coalesce("translation", F.lit("")) != "", F.concat(F.lit("\n  - _"), "translation", F.lit("_"))).otherwise(""))
    return _joined(lines, ["seq"], line)


def build(sessions: DataFrame, lines: DataFrame, actions: DataFrame, entities: DataFrame, with_digest: bool = True) -> DataFrame:
    """session_id, content: the notes of every session in sessions (session_id, name). A session's notes are one row,
    as a page is written whole."""
    parts = {"_actions": actions_part(actions), "_speakers": speakers_part(lines), "_entities": entities_part(entities), "_lines": transcript_part(lines)}
    out = sessions.select("session_id", "name")
    for name, part in parts.items():
        out = out.join(part.withColumnsRenamed({"part": name, "n": f"{name}_n"}), "session_id", "left")
    summary = F.lit("")
    if with_digest:
        out = out.join(digest.build(lines).select("session_id", "markdown"), "session_id", "left")
        summary = F.concat(F.coalesce("markdown", digest.markdown(F.array().cast("array<struct<text:string>>"), F.array().cast("array<struct<phrase:string,score:double>>"))), F.lit("\n\n"))
    some = lambda c, head: F.when(F.col(c).isNotNull(), F.concat(F.lit(head), F.col(c), F.lit("\n"))).otherwise("")
    count = lambda c: F.coalesce(F.col(f"{c}_n"), F.lit(0)).cast("string")
    content = F.concat(
        F.lit("# "), F.coalesce("name", F.lit("Session")), F.lit("\n\n"), summary,
        F.lit("## Action items\n\n"), F.coalesce("_actions", F.lit("- none captured")), F.lit("\n"),
        some("_speakers", "\n## Speakers\n\n| speaker | share | lines | sentiment |\n| --- | --- | --- | --- |\n"), some("_entities", "\n## Entities\n\n"),
        F.lit("\n## Transcript\n\n"), F.coalesce("_lines", F.lit("")), F.lit("\n\n---\n\n"),
        count("_lines"), F.lit(" utterances · "), count("_actions"), F.lit(" extracted items\n"),
    )
    return out.select("session_id", content.alias("content"))
