"""Queries over stored sessions, entities, redaction, files, profiles and failures, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.audio import signal, speakers
from parlance.functions import language as L
from parlance.functions import lexicons
from parlance.functions import sentiment as S
from parlance.operators import digest, entities, insights, notes, redaction, search, search_index, store
from parlance.plans.analytics import _SCORED, _polarity_sql, _sticky_sql
from parlance.plans.catalogue import _ACTIONS, actions
from parlance.plans.registry import _LINES, _TIMED, SQL, lines, query, workspace
from parlance.sources import recordings
from parlance.sources import transcripts as src

_SESSIONS = "sessions AS (SELECT session_id, concat('Session ', CAST(session_id AS VARCHAR)) AS name, min(started_at) AS started_at, max(ended_at) AS ended_at FROM timed GROUP BY session_id)"
_BEGAN = "began AS (SELECT session_id, concat('Session ', CAST(session_id AS VARCHAR)) AS name, CAST(session_id * 100 AS DOUBLE) AS started_at FROM lines GROUP BY session_id)"


def _began(spark, sf_dir) -> DataFrame:
    """Sessions with a made-up start each: those of timed() all start at 0."""
    t = lines(spark, sf_dir).select("session_id").distinct()
    return t.select("session_id", F.concat(F.lit("Session "), F.col("session_id").cast("string")).alias("name"), (F.col("session_id") * 100).cast("double").alias("started_at"))


def _with_mood(spark, sf_dir) -> DataFrame:
    return src.timed(lines(spark, sf_dir)).withColumn("compound", S.polarity(F.col("text"))["compound"])


_MOOD = _SCORED + f", {_BEGAN}"


@query(_MOOD + """ SELECT l.session_id, name, started_at, count(*) AS utterances, round(avg(compound), 8) AS average_sentiment, round(sum(audio_seconds), 6) AS audio_seconds, count(DISTINCT speaker) AS speakers
FROM lines l JOIN scored USING (session_id, seq) JOIN began b ON b.session_id = l.session_id GROUP BY ALL""")
def session_summaries_scored(spark, sf_dir):
    out = store.scored_summaries(_began(spark, sf_dir), _with_mood(spark, sf_dir).drop("started_at"))
    return out.withColumn("average_sentiment", F.round("average_sentiment", 8)).withColumn("audio_seconds", F.round("audio_seconds", 6))


@query(_MOOD + """, s AS (SELECT session_id, name, started_at, count(*) AS utterances, avg(compound) AS m FROM scored JOIN began USING (session_id) GROUP BY ALL ORDER BY started_at DESC, session_id LIMIT 20)
SELECT session_id, name, utterances, round(m, 8) AS average_sentiment, started_at, CAST(row_number() OVER (ORDER BY started_at, session_id DESC) AS INT) AS place FROM s""")
def sentiment_trend(spark, sf_dir):
    parts = insights.review(_began(spark, sf_dir), _with_mood(spark, sf_dir).drop("started_at"), _reported(spark, sf_dir), entities.extract(lines(spark, sf_dir).select("session_id", "text")).withColumnRenamed("entity", "text"), 0.0)
    return parts["sentiment_trend"].withColumn("average_sentiment", F.round("average_sentiment", 8))


def _reported(spark, sf_dir):
    named = _began(spark, sf_dir).select("session_id", F.col("name").alias("session_name"), F.col("started_at").alias("session_started"))
    return actions(spark, sf_dir).join(named, "session_id", "left")


@query(_ACTIONS + f""", {_BEGAN} SELECT id, a.session_id, kind, text, CAST(priority AS INT) AS priority, created_at, name AS session_name,
CAST(row_number() OVER (ORDER BY started_at DESC, priority DESC, created_at, id) AS INT) AS rank FROM actions a LEFT JOIN began b ON b.session_id = a.session_id QUALIFY rank <= 500""")
def all_actions_left_join(spark, sf_dir):
    return store.all_actions(actions(spark, sf_dir), _began(spark, sf_dir)).select("id", "session_id", "kind", "text", "priority", "created_at", "session_name", "rank")


@query(_LINES + " SELECT session_id, seq, text FROM lines WHERE session_id = 7 ORDER BY seq LIMIT 100")
def load_session(spark, sf_dir):
    return store.load_session(lines(spark, sf_dir), 7, 100).select("session_id", "seq", "text")


@query(_ACTIONS + " SELECT id, kind, text, CAST(priority AS INT) AS priority, created_at, CAST(row_number() OVER (ORDER BY priority DESC, created_at, id) AS INT) AS rank FROM actions WHERE session_id = 7")
def load_actions(spark, sf_dir):
    return store.load_actions(actions(spark, sf_dir), 7).select("id", "kind", "text", "priority", "created_at", "rank")


@query(_LINES + f", {_BEGAN} SELECT ids.session_id, coalesce(name, CAST(ids.session_id AS VARCHAR)) AS name, started_at FROM (VALUES (3::BIGINT), (9999::BIGINT)) AS ids(session_id) LEFT JOIN began ON began.session_id = ids.session_id")
def session_info(spark, sf_dir):
    return store.session_info(_began(spark, sf_dir), spark.createDataFrame([(3,), (9999,)], "session_id long"))


@query(_LINES + f", {_BEGAN} SELECT *, CAST(row_number() OVER (ORDER BY started_at DESC, session_id) AS INT) AS rank FROM began QUALIFY rank <= 25")
def past_sessions(spark, sf_dir):
    return store.past_sessions(_began(spark, sf_dir))


_ENTITIES = _LINES + r""", ents AS (
  SELECT session_id, seq, n AS entity, 'PERSON' AS label, 'person' AS kind, CAST(strpos(text, n) - 1 AS INT) AS start, CAST(strpos(text, n) + len(n) - 1 AS INT) AS "end" FROM lines, (VALUES ('Sarah Chen'), ('Priya Nair')) AS v(n) WHERE contains(text, n)
  UNION ALL SELECT session_id, seq, m, 'EMAIL', 'contact', CAST(strpos(text, m) - 1 AS INT), CAST(strpos(text, m) + len(m) - 1 AS INT) FROM (SELECT *, regexp_extract(text, '[a-z0-9]+@northwind\.com') AS m FROM lines) WHERE m <> '')"""
SQL["entity_lines"] = _ENTITIES + " SELECT * FROM ents"


def _named(spark, sf_dir) -> DataFrame:
    return entities.extract(lines(spark, sf_dir).select("session_id", "seq", "text")).select("session_id", "seq", F.col("entity").alias("text"), "kind")


@query(_ENTITIES + " SELECT session_id, kind, entity AS text, count(*) AS n FROM ents GROUP BY ALL")
def entity_counts_per_session(spark, sf_dir):
    return store.entity_counts(_named(spark, sf_dir))


@query(_ENTITIES + """, t AS (SELECT lower(entity) AS name, kind, min(entity) AS text, count(*) AS mentions, count(DISTINCT session_id) AS sessions FROM ents GROUP BY lower(entity), kind)
SELECT *, CAST(row_number() OVER (ORDER BY sessions DESC, mentions DESC, name, kind) AS INT) AS rank FROM t""")
def entity_totals_ranked(spark, sf_dir):
    return store.ranked_entities(_named(spark, sf_dir))


@query(_ENTITIES + " SELECT session_id, kind, entity AS text, count(*) AS n, CAST(row_number() OVER (PARTITION BY session_id, kind ORDER BY count(*) DESC, entity) AS INT) AS rank FROM ents GROUP BY session_id, kind, entity QUALIFY rank <= 8")
def top_entities_per_kind(spark, sf_dir):
    return store.top_entities(_named(spark, sf_dir))


@query(_SCORED + """, g AS (SELECT l.session_id, speaker, count(*) AS lines, round(sum(audio_seconds), 2) AS seconds, avg(compound) AS m FROM lines l JOIN scored USING (session_id, seq) GROUP BY l.session_id, speaker)
SELECT session_id, speaker, lines, round(m, 8) AS average_sentiment, round(seconds / sum(seconds) OVER (PARTITION BY session_id), 8) AS share, CAST(row_number() OVER (PARTITION BY session_id ORDER BY seconds DESC, speaker) AS INT) AS rank FROM g""")
def speaker_totals(spark, sf_dir):
    out = store.speaker_totals(_with_mood(spark, sf_dir))
    return out.select("session_id", "speaker", "lines", F.round("average_sentiment", 8).alias("average_sentiment"), F.round("share", 8).alias("share"), "rank")


@query(_TIMED + """ SELECT session_id, round(max(ended_at) - min(started_at), 6) AS uptime, count(*) AS utterances, count(*) FILTER (WHERE seq % 40 = 0) AS topic_shifts FROM timed GROUP BY session_id""")
def session_uptime(spark, sf_dir):
    t = src.timed(lines(spark, sf_dir))
    out = store.session_metrics(t, actions(spark, sf_dir), t.where("seq % 40 = 0").select("session_id"))
    return out.select("session_id", F.round("uptime", 6).alias("uptime"), "utterances", "topic_shifts")


@query(_LINES + r""", w AS (SELECT session_id, unnest(regexp_extract_all(lower(text), '\p{L}{2,}')) AS w FROM lines), c AS (SELECT session_id, count(*) AS word_count, count(DISTINCT w) AS unique_words FROM w GROUP BY session_id),
a AS (SELECT session_id, sum(audio_seconds) AS s FROM lines GROUP BY session_id)
SELECT session_id, word_count, unique_words, round(word_count / (s / 60), 8) AS speaking_rate FROM c JOIN a USING (session_id)""")
def word_stats_speaking_rate(spark, sf_dir):
    return digest.figures(lines(spark, sf_dir)).withColumn("speaking_rate", F.round("speaking_rate", 8))


@query()
def digest_markdown(spark, sf_dir):
    return digest.build(src.conversations(spark, sf_dir)).select("session_id", "word_count", "unique_words", "markdown")


@query(_ACTIONS + """, l AS (SELECT session_id, CASE WHEN done THEN '- [x] ' ELSE '- [ ] ' END || CASE kind WHEN 'action_item' THEN '' ELSE '**' || replace(kind, '_', ' ') || '** ' END || text || CASE WHEN due IS NULL THEN '' ELSE ' _(due ' || due || ')_' END AS line, priority, created_at, id FROM actions)
SELECT session_id, string_agg(line, chr(10) ORDER BY priority DESC, created_at, id) AS part, count(*) AS n FROM l GROUP BY session_id""")
def notes_actions(spark, sf_dir):
    return notes.actions_part(actions(spark, sf_dir))


@query(_LINES + " SELECT session_id, string_agg('- **' || speaker || '** · ' || text, chr(10) ORDER BY seq) AS part, count(*) AS n FROM lines GROUP BY session_id")
def notes_transcript(spark, sf_dir):
    return notes.transcript_part(lines(spark, sf_dir))


@query(_ENTITIES + """, c AS (SELECT session_id, kind, entity, count(*) AS n FROM ents GROUP BY ALL),
k AS (SELECT session_id, kind, string_agg(entity || ' (' || n || ')', ', ' ORDER BY n DESC, entity) AS said FROM c GROUP BY session_id, kind)
SELECT session_id, string_agg('- **' || kind || '**: ' || said, chr(10) ORDER BY kind) AS part, count(*) AS n FROM k GROUP BY session_id""")
def notes_entities(spark, sf_dir):
    return notes.entities_part(_named(spark, sf_dir))


@query()
def notes_markdown(spark, sf_dir):
    few = _with_mood(spark, sf_dir).where("seq <= 40")
    return notes.build(_began(spark, sf_dir), few, actions(spark, sf_dir), _named(spark, sf_dir))


_REDACTED = _ENTITIES + r""", pieces AS (SELECT session_id, seq, start, CASE kind WHEN 'contact' THEN 'email' ELSE kind END AS kind, entity AS value FROM ents),
firsts AS (SELECT session_id, kind, lower(value) AS key, row_number() OVER (PARTITION BY session_id, kind ORDER BY min(seq * 1000 + start)) AS k FROM pieces GROUP BY session_id, kind, lower(value)),
p AS (SELECT x.*, f.k FROM pieces x JOIN firsts f ON f.session_id = x.session_id AND f.kind = x.kind AND f.key = lower(x.value)),
person AS (SELECT * FROM p WHERE kind = 'person'), mail AS (SELECT * FROM p WHERE kind = 'email')"""


def _replaced(alias: str) -> str:
    one = lambda t: f"CASE WHEN {t}.value IS NULL THEN {{}} ELSE replace({{}}, {t}.value, {alias.format(t=t)}) END"
    text = one("person").format("l.text", "l.text")
    text = one("mail").format(text, text)
    n = "CAST((person.value IS NOT NULL)::INT + (mail.value IS NOT NULL)::INT AS INT)"
    return _REDACTED + f" SELECT l.session_id, l.seq, {text} AS text, {n} AS n_redacted FROM lines l LEFT JOIN person ON person.session_id = l.session_id AND person.seq = l.seq LEFT JOIN mail ON mail.session_id = l.session_id AND mail.seq = l.seq"


SQL["redact_lines"] = _replaced("'[' || upper({t}.kind) || '_' || {t}.k || ']'")


def _redact(mode: str, alias: str):
    def run(spark, sf_dir):
        return redaction.redact(lines(spark, sf_dir).select("session_id", "seq", "text"), mode=mode, salt="pepper")

    run.__name__ = f"redact_{mode}"
    return query(_replaced(alias))(run)


redact_label = _redact("label", "'[' || upper({t}.kind) || ']'")
redact_hash = _redact("hash", "'[' || upper({t}.kind) || ':' || substr(sha256('pepper' || lower({t}.value)), 1, 8) || ']'")
redact_mask = _redact("mask", "repeat('█', greatest(4, least(len({t}.value), 12)))")


@query(_REDACTED + " SELECT session_id, kind, count(*) AS removed FROM p GROUP BY ALL")
def redaction_counts(spark, sf_dir):
    return redaction.counts(lines(spark, sf_dir))


@query(_REDACTED + ', e AS (SELECT * FROM ents) SELECT session_id, seq, CASE kind WHEN \'contact\' THEN \'email\' ELSE kind END AS kind, start, "end", "end" - start AS length FROM e')
def redaction_audit(spark, sf_dir):
    return redaction.removals(lines(spark, sf_dir).select("session_id", "seq", "text"))


@query(_replaced("'[' || upper({t}.kind) || '_' || {t}.k || ']'").replace(" AS n_redacted FROM", " AS gone FROM").replace("SELECT l.session_id, l.seq,", "SELECT l.session_id, l.seq, "))
def redact_tables_together(spark, sf_dir):
    """Lines and, under the same pseudonyms, what was made of them; here the lines."""
    mine = lines(spark, sf_dir).select("session_id", "seq", "text")
    again = mine.select("session_id", "seq", F.upper("text").alias("text"))
    out = redaction.redact_together({"lines": (mine, ["text"], ["seq"]), "again": (again, ["text"], ["seq"])}, counted=True)["lines"]
    return out.withColumnRenamed("n_redacted", "gone")


@query("""WITH files AS (SELECT 'a/' || o_orderkey || '.wav' AS path, o_orderkey AS k FROM orders), done AS (SELECT path FROM files WHERE k % 4 = 0)
SELECT path FROM files ANTI JOIN done USING (path)""")
def resume_anti_join(spark, sf_dir):
    files, manifest = _files(spark, sf_dir)
    return recordings.pending(files.select("path"), manifest)


def _files(spark, sf_dir):
    o = src.read(spark, sf_dir, "orders")
    files = o.select(F.concat(F.lit("a/"), F.col("o_orderkey").cast("string"), F.lit(".wav")).alias("path"), "o_orderkey", F.round(F.col("o_totalprice") / 10_000, 2).alias("audio_seconds"))
    status = F.when(F.col("o_orderkey") % 4 == 0, "done").when(F.col("o_orderkey") % 4 == 1, "failed").otherwise("skipped")
    return files, files.withColumn("status", status)


@query("""SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'done' WHEN o_orderkey % 4 = 1 THEN 'failed' ELSE 'skipped' END AS status, count(*) AS files, round(sum(round(o_totalprice / 10000, 2)), 4) AS audio_seconds FROM orders GROUP BY ALL""")
def batch_status_counts(spark, sf_dir):
    return recordings.report(_files(spark, sf_dir)[1]).withColumn("audio_seconds", F.round("audio_seconds", 4))


@query("SELECT event_type AS component, count(*) AS failures, max(ts) AS last_at FROM events WHERE value < 50 GROUP BY ALL")
def failure_counts(spark, sf_dir):
    failed = src.read(spark, sf_dir, "events").where("value < 50").select(F.col("event_type").alias("component"), F.col("props").alias("message"), F.col("ts").alias("at"))
    return store.failure_counts(failed)[0]


@query("SELECT event_type AS component, props AS message, ts AS at FROM events WHERE value < 50 ORDER BY ts DESC, event_type, props LIMIT 50")
def recent_failures(spark, sf_dir):
    failed = src.read(spark, sf_dir, "events").where("value < 50").select(F.col("event_type").alias("component"), F.col("props").alias("message"), F.col("ts").alias("at"))
    return store.failure_counts(failed)[1]


@query("""WITH p AS (SELECT 'voice ' || lpad(CAST(label AS VARCHAR), 3, '0') AS label, arg_min(embedding, vec_id) AS c FROM embeddings GROUP BY label),
s AS (SELECT vec_id, p.label, list_inner_product(CAST(embedding AS DOUBLE[]), CAST(c AS DOUBLE[])) AS d FROM embeddings e, p),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d DESC, label) AS r FROM s)
SELECT vec_id, max(CASE WHEN r = 1 THEN label END) AS label, round(max(CASE WHEN r = 1 THEN d END), 6) AS similarity, round(max(CASE WHEN r = 2 THEN d END), 6) AS runner_up FROM r WHERE r <= 2 GROUP BY vec_id""")
def knn_profiles(spark, sf_dir):
    e = src.read(spark, sf_dir, "embeddings")
    name = F.concat(F.lit("voice "), F.lpad(F.col("label").cast("string"), 3, "0"))
    profiles = e.groupBy(name.alias("label")).agg(F.min_by("embedding", "vec_id").alias("centroid"))
    out = speakers.nearest(e.select("vec_id", "embedding"), profiles)
    return out.select("vec_id", "label", F.round("similarity", 6).alias("similarity"), F.round("runner_up", 6).alias("runner_up"))


@query("""WITH x AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), r AS (SELECT vec_id, sqrt(avg(v * v)) AS rms, max(abs(v)) AS peak FROM x GROUP BY vec_id)
SELECT vec_id, round(rms, 6) AS rms, round(peak, 6) AS peak, round(greatest(-90, 20 * log10(rms)), 6) AS dbfs FROM r""")
def rms_peak_dbfs(spark, sf_dir):
    e = src.read(spark, sf_dir, "embeddings").select("vec_id", signal.figures(F.col("embedding")).alias("f"))
    return e.select("vec_id", *[F.round(f"f.{c}", 6).alias(c) for c in ("rms", "peak", "dbfs")])


@query()
def speaker_clusters(spark, sf_dir):
    e = src.read(spark, sf_dir, "embeddings").select((F.col("vec_id") % 20).alias("session_id"), F.col("vec_id").alias("seq"), "embedding")
    return speakers.clusters(e).drop("similarity", "confidence")


SQL["search_all_sessions"] = SQL["bm25_search"].replace("SELECT session_id, seq, round(score, 6) AS score, CAST(r AS INT) AS rank FROM t WHERE r <= 20", """SELECT t.session_id, t.seq, CAST(r AS INT) AS rank, concat('Session ', CAST(t.session_id AS VARCHAR)) AS session_name,
regexp_replace(text, '(send|order)', '«\\1»', 'gi') AS marked FROM t JOIN lines l ON l.session_id = t.session_id AND l.seq = t.seq WHERE r <= 20""")


@query(SQL["search_all_sessions"])
def search_all_sessions(spark, sf_dir):
    out = search.search_sessions(lines(spark, sf_dir), _began(spark, sf_dir), 'send "order"')
    return out.select("session_id", "seq", "rank", "session_name", "marked")


@query(SQL["bm25_search"])
def indexed_search(spark, sf_dir):
    """bm25_search from an index written of all lines, in two parts, and searched as stored."""
    folder, said = workspace(spark), lines(spark, sf_dir)
    for i in range(2):
        search_index.add(said.where(F.col("session_id") % 2 == i), folder, str(i))
    hits = search_index.Index(spark, folder).bm25(["send", "order"])
    return hits.select("session_id", "seq", F.round("score", 6).alias("score"), "rank")


@query()
def open_commitments_whole(spark, sf_dir):
    """Every open commitment, however many: the same one told twice is one row."""
    return insights.open_items(_reported(spark, sf_dir), as_of=10 * 86_400.0, limit=None)


@query()
def recurring_commitments_whole(spark, sf_dir):
    return insights.recurring_items(_reported(spark, sf_dir), limit=None)


_LEXICON = ", ".join(f"'{code}'" for code in lexicons.VALENCES)
_SERVED = ", ".join(f"'{code}'" for code in L.SUPPORTED)


@query(_LINES.replace("WITH lines", "WITH RECURSIVE lines", 1) + f""", {_sticky_sql("lines")},
heard AS (SELECT session_id, seq, text, CASE WHEN current IN ({_LEXICON}) THEN current ELSE 'en' END AS lang FROM lines JOIN told USING (session_id, seq)),
{_polarity_sql("heard", "session_id, seq, lang", "lang")}
SELECT session_id, seq, current AS language_used, CASE WHEN current IN ({_SERVED}) THEN round(compound, 4) END AS compound, contains(text, 'Chen') OR contains(text, 'Nair') AS has_person
FROM lines JOIN told USING (session_id, seq) JOIN scored USING (session_id, seq)""")
def analysed_lines(spark, sf_dir):
    """All analytics of every line, by the language in charge of its session."""
    from parlance.operators import analyse

    out = analyse.analyse(src.timed(lines(spark, sf_dir)))
    person = F.exists("entities", lambda e: e["kind"] == "person")
    return out.select("session_id", "seq", F.col("current").alias("language_used"), "sentiment.compound", person.alias("has_person"))
