"""Command line: python -m parlance.cli COMMAND. Transcripts are text files, a line each."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from parlance import batch, config, engine, plugins
from parlance.functions import sentiment as S
from parlance.operators import analyse, exports, insights, redaction, search, store
from parlance.sources import transcripts

DEMO = (
    "Remind me to send the report to Sarah Chen tomorrow.", "The deadline is Friday and I am worried about it.", "We decided to ship the small version first.",
    "I am blocked on the audio driver.", "Great news, the rewrite landed!", "Can you follow up with legal by 5 pm?",
)


def _spark() -> SparkSession:
    return SparkSession.builder.appName("parlance").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _lines(spark: SparkSession, path: str | None):
    if path:
        found = transcripts.text_lines(spark, path)
    else:
        found = spark.createDataFrame([("demo", i + 1, t) for i, t in enumerate(DEMO)], "session_id string, seq int, text string")
    timed = found.withColumn("audio_seconds", F.lit(4.0)).withColumn("speaker", F.lit(None).cast("string"))
    return transcripts.timed(timed)


def _analysed(spark: SparkSession, path: str | None):
    a = analyse.analyse(_lines(spark, path))
    a = a.withColumn("compound", F.col("sentiment.compound"))
    children = analyse.children(a)
    return a, children["action_items"].withColumn("created_at", F.col("seq").cast("double")), children["entities"]


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="parlance")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("demo", "digest", "sessions", "actions", "review"):
        sub.add_parser(name).add_argument("path", nargs="?")
    p = sub.add_parser("search")
    p.add_argument("query")
    p.add_argument("path", nargs="?")
    p = sub.add_parser("export")
    p.add_argument("form", choices=sorted(exports.SUFFIX))
    p.add_argument("output")
    p.add_argument("path", nargs="?")
    p = sub.add_parser("redact")
    p.add_argument("text")
    p.add_argument("--mode", choices=redaction.MODES, default="pseudonym")
    p = sub.add_parser("translate")
    p.add_argument("text")
    p.add_argument("source")
    p.add_argument("target")
    p = sub.add_parser("batch")
    p.add_argument("folder")
    p.add_argument("output")
    p.add_argument("--backend", default="auto")
    for name in ("init", "validate"):
        sub.add_parser(name).add_argument("file")
    sub.add_parser("pairs")
    sub.add_parser("selftest")
    p = sub.add_parser("bench")
    p.add_argument("--iterations", type=int, default=3)
    args = parser.parse_args(argv)
    return globals()[f"_{args.command}"](args)


def _demo(args) -> int:
    a, actions, _ = _analysed(_spark(), args.path)
    for r in store.top_actions(actions).orderBy("rank").collect():
        print(f"[{r.kind}] {r.text}" + (f" (due {r.due})" if r.due else ""))
    print(engine.Engine(a.sparkSession).digest(a).orderBy("session_id").first().markdown)
    return 0


def _digest(args) -> int:
    for r in engine.Engine(_spark()).digest(_lines(_spark(), args.path)).orderBy("session_id").collect():
        print(f"# {r.session_id}\n\n{r.markdown}\n")
    return 0


def _sessions(args) -> int:
    for r in store.past_sessions(transcripts.sessions(_lines(_spark(), args.path))).orderBy("rank").collect():
        print(r["name"], r.started_at, r.ended_at, sep="\t")
    return 0


def _actions(args) -> int:
    for r in store.top_actions(_analysed(_spark(), args.path)[1]).orderBy("rank").collect():
        print(r.priority, r.kind, r.text, sep="\t")
    return 0


def _review(args) -> int:
    a, actions, entities = _analysed(_spark(), args.path)
    sessions = transcripts.sessions(a)
    named = actions.join(sessions.select("session_id", F.col("name").alias("session_name"), F.col("started_at").alias("session_started")), "session_id", "left")
    print(insights.review_markdown(insights.review(sessions, a.drop("started_at"), named, entities, time.time())))
    return 0


def _search(args) -> int:
    lines = _lines(_spark(), args.path)
    hits = search.search_sessions(lines, transcripts.sessions(lines), args.query).orderBy("rank").collect()
    for r in hits:
        print(f"{r.session_name}:{r.seq}\t{r.snippet}")
    return 0 if hits else 1


def _export(args) -> int:
    a, actions, entities = _analysed(_spark(), args.path)
    made = engine.Engine(a.sparkSession).export(args.form, transcripts.sessions(a), a, actions, entities)
    exports.write_documents(made, args.output, args.form)
    return 0


def _redact(args) -> int:
    frame = _spark().createDataFrame([(1, 1, args.text)], "session_id int, seq int, text string")
    row = redaction.redact(frame, mode=args.mode).first()
    print(row.text)
    print(f"{row.n_redacted} removed", file=sys.stderr)
    return 0


def _translate(args) -> int:
    made = plugins.translate(plugins.chosen(plugins.TRANSLATORS))
    frame = _spark().createDataFrame([(args.text, args.source, args.target)], "t string, a string, b string")
    found = frame.select(made(F.col("t"), F.col("a"), F.col("b")).alias("t")).first().t
    print(found if found is not None else args.text)
    return 0 if found is not None or args.source == args.target else 1


def _batch(args) -> int:
    found = batch.run_folder(_spark(), args.folder, args.output, plugins.chosen(plugins.RECOGNISERS, args.backend)).orderBy("path").collect()
    for r in found:
        print(r.status, r.path, r.error or "", sep="\t")
    return int(any(r.status == "failed" for r in found))


def _init(args) -> int:
    config.save(config.Settings(), args.file)
    return 0


def _validate(args) -> int:
    with open(args.file, encoding="utf-8") as f:
        settings, unknown = config.from_dict(json.load(f))
    wrong = config.problems(settings) + [f"unknown key {k}" for k in unknown]
    print("\n".join(wrong) or "fine")
    return int(bool(wrong))


def _pairs(args) -> int:
    for kind, registry in (("recogniser", plugins.RECOGNISERS), ("translator", plugins.TRANSLATORS)):
        for name, state in plugins.available(registry).items():
            print(kind, name, state, sep="\t")
    return 0


def checks(spark: SparkSession) -> list[tuple[str, str, str, float]]:
    """name, pass or fail, detail, seconds of each check of the installation."""
    a, actions, entities = _analysed(spark, None)
    tests = {
        "extracts actions": lambda: actions.count() >= 4, "finds people": lambda: entities.where("kind = 'person'").count() == 1,
        "scores moods": lambda: spark.range(1).select(S.polarity(F.lit("great"))["compound"].alias("c")).first().c > 0.5,
        "summarises": lambda: "## Summary" in engine.Engine(spark).digest(a).first().markdown, "searches": lambda: not search.search_sessions(a, transcripts.sessions(a), "dead").isEmpty(),
        "redacts": lambda: "Chen" not in redaction.redact(a.select("session_id", "seq", "text")).orderBy("seq").first().text,
    }
    out = []
    for name, test in tests.items():
        began = time.perf_counter()
        try:
            state, detail = ("pass", "") if test() else ("fail", "unexpected result")
        except Exception as e:  # noqa: BLE001
            state, detail = "fail", str(e)
        out.append((name, state, detail, time.perf_counter() - began))
    return out


def _selftest(args) -> int:
    found = checks(_spark())
    for name, state, detail, seconds in found:
        print(f"{state}\t{name}\t{seconds:.1f} s\t{detail}")
    return int(any(state == "fail" for _, state, _, _ in found))


def _bench(args) -> int:
    a, _, _ = _analysed(_spark(), None)
    for name, run in {"analytics": lambda: a.count(), "digest": lambda: engine.Engine(a.sparkSession).digest(a).count()}.items():
        run()
        began = time.perf_counter()
        for _ in range(args.iterations):
            run()
        print(f"{name}\t{(time.perf_counter() - began) / args.iterations:.3f} s")
    return 0


if __name__ == "__main__":
    sys.exit(main())
