"""Queries over texts, sequences, vectors and events, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from parlance.functions import language as L
from parlance.functions import lexicons
from parlance.functions import sentiment as S
from parlance.functions import text as T
from parlance.operators import ranking, rules, search, sequence
from parlance.plans.registry import _LINES, _TIMED, SQL, lines, query
from parlance.sources import transcripts as src


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_STOP = _quoted(T.STOPWORDS)


def _polarity_sql(source: str, keys: str, spoken: str = "'en'") -> str:
    """CTEs up to `scored` (keys, compound): source (keys, text) by the lexicon of the code that spoken says; that is
    one of keys, or English."""
    codes = ["en"] if spoken == "'en'" else list(lexicons.VALENCES)
    rows = lambda code, table: (f"('{code}', {_quoted([w])}, {v}::DOUBLE)" for w, v in table.items())
    values = ", ".join(r for c in codes for r in rows(c, lexicons.VALENCES[c]))
    boosts = ", ".join(r for c in codes for r in rows(c, lexicons.BOOSTERS.get(c, lexicons.BOOSTERS["en"])))
    negative = _quoted(f"{c} {w}" for c in codes for w in lexicons.NEGATIONS.get(c, lexicons.NEGATIONS["en"]).split())
    negated = " OR ".join(f"concat({spoken}, ' ', p{i}) IN ({negative})" for i in (1, 2, 3))
    boosted = " ".join(f"LEFT JOIN boost b{i} ON b{i}.word = p{i} AND b{i}.code = {spoken}" for i in (1, 2, 3))
    return f"""
lex(code, word, v) AS (VALUES {values}), boost(code, word, b) AS (VALUES {boosts}),
split AS (SELECT {keys}, text, regexp_extract_all(text, '[A-Za-z'']+|[!?]+') AS t FROM {source}),
tok AS (SELECT {keys}, unnest(t) AS raw, generate_subscripts(t, 1) AS i FROM split),
prev AS (SELECT *, lower(raw) AS w, lag(lower(raw), 1) OVER o AS p1, lag(lower(raw), 2) OVER o AS p2, lag(lower(raw), 3) OVER o AS p3,
  min(CASE WHEN lower(raw) = 'but' THEN i END) OVER (PARTITION BY {keys}) AS but,
  count(*) FILTER (WHERE regexp_full_match(raw, '[A-Z][A-Z]+')) OVER (PARTITION BY {keys}) AS caps,
  count(*) FILTER (WHERE regexp_full_match(raw, '[A-Za-z]+')) OVER (PARTITION BY {keys}) AS alpha
  FROM tok WINDOW o AS (PARTITION BY {keys} ORDER BY i)),
val AS (SELECT {keys}, i, but,
  (lex.v + sign(lex.v) * (CASE WHEN caps > 0 AND caps < alpha AND raw = upper(raw) THEN 0.733 ELSE 0 END
   + coalesce(b1.b, 0) + coalesce(b2.b, 0) * 0.85 + coalesce(b3.b, 0) * 0.7))
  * CASE WHEN {negated} THEN -0.74 ELSE 1 END
  * CASE WHEN but IS NULL THEN 1 WHEN i < but THEN 0.5 ELSE 1.5 END AS v
  FROM prev JOIN lex ON lex.word = w AND lex.code = {spoken} {boosted}),
total AS (SELECT {keys}, sum(v) AS x, sum(v + 1) FILTER (WHERE v > 0) AS up, -sum(v - 1) FILTER (WHERE v < 0) AS down, count(*) AS hits FROM val GROUP BY {keys}),
marked AS (SELECT s.*, x, coalesce(up, 0) AS up, coalesce(down, 0) AS down, len(t) - hits AS rest, least(len(regexp_replace(text, '[^!]', '', 'g')), 4) * 0.292
  + CASE WHEN len(regexp_replace(text, '[^?]', '', 'g')) > 1 THEN least(len(regexp_replace(text, '[^?]', '', 'g')), 3) * 0.18 ELSE 0 END AS stress
  FROM split s LEFT JOIN total USING ({keys})),
scored AS (SELECT {keys}, CASE WHEN x IS NULL THEN 0 ELSE (x + CASE WHEN x >= 0 THEN stress ELSE -stress END)
  / sqrt((x + CASE WHEN x >= 0 THEN stress ELSE -stress END) ** 2 + 15) END AS compound FROM marked)"""


_SCORED = _LINES + "," + _polarity_sql("lines", "session_id, seq")
_PART = "round(CASE WHEN x IS NULL THEN {none} ELSE {c} / (up + down + rest) END, 4) AS {name}"
SQL["sentiment_lines"] = _SCORED + f""", s AS (SELECT session_id, seq, round(compound, 4) AS compound, {_PART.format(c="up", none=0, name="positive")}, {_PART.format(c="down", none=0, name="negative")},
  {_PART.format(c="rest", none=1, name="neutral")}, CASE WHEN compound >= 0.05 THEN 'positive' WHEN compound <= -0.05 THEN 'negative' ELSE 'neutral' END AS label FROM scored JOIN marked USING (session_id, seq)),
r AS (SELECT *, list(compound) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS v FROM s)
SELECT * EXCLUDE (v), round(list_avg(v), 8) AS rolling, round(CASE WHEN len(v) < 4 THEN 0 ELSE list_avg(v[len(v) // 2 + 1 : len(v)]) - list_avg(v[1 : len(v) // 2]) END, 8) AS momentum FROM r"""


def _polarity(spark, sf_dir):
    return lines(spark, sf_dir).withColumn("compound", S.polarity(F.col("text"))["compound"])


@query(_SCORED + " SELECT session_id, seq, round(compound, 8) AS compound FROM scored")
def sentiment_compound(spark, sf_dir):
    return _polarity(spark, sf_dir).select("session_id", "seq", F.round("compound", 8).alias("compound"))


@query(_SCORED + " SELECT session_id, CASE WHEN compound >= 0.05 THEN 'positive' WHEN compound <= -0.05 THEN 'negative' ELSE 'neutral' END AS label, count(*) AS lines FROM scored GROUP BY ALL")
def sentiment_label_counts(spark, sf_dir):
    return _polarity(spark, sf_dir).groupBy("session_id", S.label(F.col("compound")).alias("label")).agg(F.count("*").alias("lines"))


@query(_SCORED + """, r AS (SELECT session_id, seq, list(compound) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS v FROM scored)
SELECT session_id, seq, round(list_avg(v), 8) AS rolling, round(CASE WHEN len(v) < 4 THEN 0 ELSE list_avg(v[len(v) // 2 + 1 : len(v)]) - list_avg(v[1 : len(v) // 2]) END, 8) AS momentum FROM r""")
def rolling_sentiment(spark, sf_dir):
    out = sequence.rolling(_polarity(spark, sf_dir).select("session_id", "seq", "compound"))
    return out.select("session_id", "seq", F.round("rolling", 8).alias("rolling"), F.round("momentum", 8).alias("momentum"))


@query(_SCORED + """, gaps AS (SELECT session_id, seq, CASE WHEN seq % 3 = 0 THEN NULL ELSE compound END AS c FROM scored),
n AS (SELECT *, count(c) OVER (PARTITION BY session_id ORDER BY seq) AS k FROM gaps)
SELECT session_id, seq, round(coalesce((SELECT avg(m.c) FROM n m WHERE m.session_id = n.session_id AND m.c IS NOT NULL AND m.k BETWEEN n.k - 11 AND n.k), 0), 8) AS rolling FROM n""")
def rolling_over_gaps(spark, sf_dir):
    """Lines without a score carry the last mean on."""
    some = _polarity(spark, sf_dir).select("session_id", "seq", F.when(F.col("seq") % 3 != 0, F.col("compound")).alias("compound"))
    return sequence.rolling(some).select("session_id", "seq", F.round("rolling", 8).alias("rolling"))


def _ratio(code: str) -> str:
    marks = f"len(list_filter(w, lambda x: x IN ({_quoted(L.MARKERS[code].split())}))) / greatest(len(w), 1)"
    signs = " + ".join(f"(CASE WHEN contains(low, '{c}') THEN 0.04 ELSE 0 END)" for c in L.DIACRITICS.get(code, "")) or "0"
    return f"{marks} + least({signs}, 0.2::DOUBLE)"


def _language_sql(source: str, keys: str) -> str:
    each = " UNION ALL ".join(f"SELECT {keys}, '{c}' AS code, {i} AS rank, CAST({_ratio(c)} AS DOUBLE) AS score FROM w WHERE len(w) >= 4" for i, c in enumerate(L.MARKERS))
    return f"""w AS (SELECT {keys}, lower(coalesce(text, '')) AS low, regexp_extract_all(lower(coalesce(text, '')), '\\p{{L}}+') AS w FROM {source}),
each AS ({each}),
placed AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, rank) AS r FROM each),
best AS (SELECT {keys}, max(CASE WHEN r = 1 THEN score END) AS b, max(CASE WHEN r = 2 THEN score END) AS s, max(CASE WHEN r = 1 THEN code END) AS code FROM placed GROUP BY {keys}),
guess AS (SELECT {keys}, CASE WHEN coalesce(b, 0) > 0 THEN code ELSE 'en' END AS code, CASE WHEN coalesce(b, 0) > 0 THEN least(1.0, b + b - s) ELSE 0.0 END AS confidence FROM w LEFT JOIN best USING ({keys}))"""


SQL["detect_language"] = f"WITH {_language_sql('documents', 'doc_id')} SELECT doc_id, lang, code, round(confidence, 8) AS confidence FROM guess JOIN documents USING (doc_id)"


@query(f"WITH {_language_sql('documents', 'doc_id')} SELECT lang, code, count(*) AS documents FROM guess JOIN documents USING (doc_id) GROUP BY ALL")
def language_confusion(spark, sf_dir):
    return src.read(spark, sf_dir, "documents").groupBy("lang", L.detect(F.col("text"))["code"].alias("code")).agg(F.count("*").alias("documents"))


_SAID = "said AS (SELECT conv_id AS session_id, CAST(turn + 1 AS INT) AS seq, text FROM conversations)"


def _sticky_sql(source: str) -> str:
    """CTEs up to `guess` and `told` (session_id, seq, current): the language in charge along source."""
    return f"""{_language_sql(source, 'session_id, seq')},
ordered AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS k FROM guess),
codes(code, rank) AS (VALUES {', '.join(f"('{c}', {i})" for i, c in enumerate(L.MARKERS))}),
tally AS MATERIALIZED (SELECT a.session_id, a.k, c.code, c.rank, coalesce(sum(b.confidence) FILTER (WHERE b.code = c.code), 0) AS score
  FROM ordered a CROSS JOIN codes c JOIN ordered b ON b.session_id = a.session_id AND b.k BETWEEN a.k - 4 AND a.k GROUP BY ALL),
lead AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, k ORDER BY score DESC, rank) AS r FROM tally) WHERE r = 1),
fold AS (
  SELECT session_id, CAST(0 AS BIGINT) AS k, 'en' AS current FROM (SELECT DISTINCT session_id FROM ordered)
  UNION ALL
  SELECT f.session_id, f.k + 1, CASE WHEN l.code <> f.current AND l.score - t.score >= 0.15 THEN l.code ELSE f.current END
  FROM fold f JOIN lead l ON l.session_id = f.session_id AND l.k = f.k + 1 JOIN tally t ON t.session_id = f.session_id AND t.k = f.k + 1 AND t.code = f.current),
told AS (SELECT session_id, seq, current FROM ordered JOIN fold USING (session_id, k))"""


SQL["sticky_language"] = f"""WITH RECURSIVE {_SAID}, {_sticky_sql('said')}
SELECT o.session_id, o.seq, o.code, round(o.confidence, 8) AS confidence, f.current FROM ordered o JOIN fold f USING (session_id, k)"""


@query(_LINES + r""", h AS (
  SELECT *, 'action_item' AS kind, 'reminder' AS rule, regexp_extract(text, '(?i)\bremind\s+(?:me|us|him|her|them)\s+to\s+([^.?!;\n]+)', 1) AS f FROM lines
  UNION ALL SELECT *, 'deadline', 'deadline', regexp_extract(text, '(?i)\bdeadline\s+(?:is|was|will be)?\s*([^.?!;,\n]+?)(?:[.?!;,]|\s+and\b|\s+but\b|$)', 1) FROM lines
  UNION ALL SELECT *, 'risk', 'risk', regexp_extract(text, '(?i)\b(?:risk is|concern is|worried about|problem is)\s+([^.?!;\n]+)', 1) FROM lines
  UNION ALL SELECT *, 'blocker', 'blocker', regexp_extract(text, '(?i)\b(?:blocked (?:on|by)|blocker is|stuck on)\s+([^.?!;\n]+)', 1) FROM lines
  UNION ALL SELECT *, 'decision', 'decision', regexp_extract(text, '(?i)\bwe(?:''ve| have)?\s+decided\s+(?:to|that)\s+([^.?!;\n]+)', 1) FROM lines
  UNION ALL SELECT *, 'action_item', 'assignment', regexp_extract(text, '(?i)\b(?:can|could|will|would)\s+you\s+(?:please\s+)?([^.?!;\n]+)', 1) FROM lines)
SELECT session_id, seq, kind, rule, trim(f, ' ,;:-') AS fragment FROM h WHERE f <> ''""")
def rule_hits_union(spark, sf_dir):
    """Hits of all rules but amounts, hits within longer ones of their kind left out."""
    found = rules.extract(lines(spark, sf_dir)).where("kind <> 'metric'")
    return found.select("session_id", "seq", "kind", "rule", "fragment")


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


_HINT = "CASE WHEN {n0} THEN 0 WHEN {n3} THEN 3 WHEN {n2} THEN 2 ELSE 1 END".format(
    **{f"n{n}": f"regexp_matches(lower(whole), '{'|'.join(w for w, v in T.PRIORITY_HINTS.items() if v == n)}')" for n in (0, 2, 3)}
)


def _due(said: str) -> str:
    found = ", ".join(f"nullif(regexp_extract({said}, '(?i){_sql(p)}'), '')" for p in (T.RELATIVE_DATE, T.NUMERIC_DATE, T.TIME))
    return f"trim(coalesce({found}))"


SQL["find_due_date"] = _LINES + f" SELECT session_id, seq, {_due('text')} AS due FROM lines"
_SAID_BY_RULE = {
    "reminder": r"\bremind\s+(?:me|us|him|her|them)\s+to\s+([^.?!;\n]+)", "assignment": r"\b(?:can|could|will|would)\s+you\s+(?:please\s+)?([^.?!;\n]+)",
    "deadline": r"\bdeadline\s+(?:is|was|will be)?\s*([^.?!;,\n]+?)(?:[.?!;,]|\s+and\b|\s+but\b|$)", "risk": r"\b(?:risk is|concern is|worried about|problem is)\s+([^.?!;\n]+)",
    "blocker": r"\b(?:blocked (?:on|by)|blocker is|stuck on)\s+([^.?!;\n]+)", "decision": r"\bwe(?:'ve| have)?\s+decided\s+(?:to|that)\s+([^.?!;\n]+)",
    "metric": r"\b((?:\$|€|£)?\d[\d,.]*\s*(?:%|percent|k|m|bn|million|billion|users|dollars)?)\b",
}
_HITS = " UNION ALL ".join(
    f"SELECT *, '{r.kind}' AS kind, '{r.name}' AS rule, {r.confidence}::DOUBLE AS confidence, regexp_extract(text, '(?i){_sql(p)}') AS whole, regexp_extract(text, '(?i){_sql(p)}', 1) AS said FROM lines"
    for name, p in _SAID_BY_RULE.items() for r in rules.RULES if r.name == name and r.language == "en"
)
SQL["rule_hits"] = _LINES + f""", h AS ({_HITS})
SELECT session_id, seq, speaker, audio_seconds, line_id, kind, trim(said, ' ,;:-') AS fragment, rule, CAST(strpos(text, said) - 1 AS INT) AS start, CAST(strpos(text, said) - 1 + len(said) AS INT) AS "end", confidence,
CAST({_HINT} AS INT) AS priority, {_due('whole')} AS due FROM h WHERE len(trim(said, ' ,;:-')) >= 3"""


def _rule(name: str, sql: str):
    def run(spark, sf_dir):
        return rules.one_rule(lines(spark, sf_dir), name).select("session_id", "seq", "kind", "fragment", "priority", "due")

    run.__name__ = f"rule_{name}"
    return query(_LINES + sql)(run)


_HIT = " SELECT session_id, seq, '{kind}' AS kind, trim(regexp_extract(text, '{pattern}', 1), ' ,;:-') AS fragment, {priority} AS priority, {due} AS due FROM lines WHERE regexp_matches(text, '{pattern}')"
rule_reminder = _rule("reminder", _HIT.format(kind="action_item", pattern=r"(?i)\bremind\s+(?:me|us|him|her|them)\s+to\s+([^.?!;\n]+)", priority=1, due="CAST(NULL AS VARCHAR)"))
rule_deadline = _rule("deadline", _HIT.format(kind="deadline", pattern=r"(?i)\bdeadline\s+(?:is|was|will be)?\s*([^.?!;,\n]+?)(?:[.?!;,]|\s+and\b|\s+but\b|$)", priority=1, due="'Friday'"))
rule_blocker = _rule("blocker", _HIT.format(kind="blocker", pattern=r"(?i)\b(?:blocked (?:on|by)|blocker is|stuck on)\s+([^.?!;\n]+)", priority=1, due="CAST(NULL AS VARCHAR)"))
rule_decision = _rule("decision", _HIT.format(kind="decision", pattern=r"(?i)\bwe(?:''ve| have)?\s+decided\s+(?:to|that)\s+([^.?!;\n]+)", priority="CASE WHEN contains(lower(text), 'urgent') THEN 3 ELSE 1 END", due="CAST(NULL AS VARCHAR)"))


@query(_LINES + rf" SELECT session_id, seq, array_to_string(list_filter(regexp_extract_all(lower(text), '\p{{L}}{{2,}}'), lambda t: len(t) > 2 AND t NOT IN ({_STOP})), ' ') AS words FROM lines")
def tokenize_stopwords(spark, sf_dir):
    return lines(spark, sf_dir).select("session_id", "seq", F.array_join(T.tokens(F.col("text"), drop_stopwords=True), " ").alias("words"))


@query(r"""WITH parts AS (SELECT conv_id, turn, unnest(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+')) AS s FROM conversations)
SELECT conv_id, turn, count(*) AS sentences, sum(len(trim(s, ' ' || chr(9)))) AS letters FROM parts WHERE trim(s, ' ' || chr(9)) <> '' GROUP BY ALL""")
def split_sentences(spark, sf_dir):
    said = src.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(T.sentences(F.col("text"))).alias("s"))
    return said.groupBy("conv_id", "turn").agg(F.count("*").alias("sentences"), F.sum(F.length("s")).alias("letters"))


_SENTENCES = rf"""WITH raw AS (SELECT conv_id AS session_id, turn, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM (
  SELECT conv_id, turn, regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+') AS p FROM conversations)),
sent AS (SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY turn, i) - 1 AS INT) AS position, trim(s, ' ' || chr(9)) AS sentence FROM raw WHERE trim(s, ' ' || chr(9)) <> ''),
w AS (SELECT session_id, position, list_filter(regexp_extract_all(lower(sentence), '\p{{L}}{{2,}}'), lambda t: len(t) > 2 AND t NOT IN ({_STOP})) AS t FROM sent),
word AS (SELECT DISTINCT session_id, position, len(t) AS n, unnest(t) AS word FROM w),
edge AS (SELECT a.session_id, a.position AS i, b.position AS j, count(*) / (ln(a.n + 1) + ln(b.n + 1)) AS weight
  FROM word a JOIN word b ON a.session_id = b.session_id AND a.word = b.word AND a.position < b.position GROUP BY a.session_id, a.position, b.position, a.n, b.n),
both_ways AS (SELECT session_id, i AS u, j AS v, weight FROM edge UNION ALL SELECT session_id, j, i, weight FROM edge),
total AS (SELECT session_id, u AS v, sum(weight) AS out FROM both_ways GROUP BY ALL),
inbound AS (SELECT b.session_id, b.u AS position, sum(weight / out) AS c FROM both_ways b JOIN total t ON t.session_id = b.session_id AND t.v = b.v GROUP BY ALL)"""


@query(_SENTENCES + " SELECT session_id, i, j, round(weight, 8) AS weight FROM edge")
def sentence_similarity_edges(spark, sf_dir):
    e = ranking.edges(ranking.sentence_table(src.conversations(spark, sf_dir)))
    return e.select("session_id", "i", "j", F.round("weight", 8).alias("weight"))


SQL["textrank_top"] = _SENTENCES.replace("WITH raw", "WITH RECURSIVE raw", 1) + """,
start AS (SELECT s.session_id, s.position, coalesce(c, 0) AS c, count(*) OVER (PARTITION BY s.session_id) AS n FROM sent s LEFT JOIN inbound i ON i.session_id = s.session_id AND i.position = s.position),
turn AS (
  SELECT session_id, position, c, n, 0 AS t, 1.0::DOUBLE / n AS x, 1e9::DOUBLE AS moved FROM start
  UNION ALL
  SELECT session_id, position, c, n, t + 1, y, sum(abs(y - x)) OVER (PARTITION BY session_id) FROM (
    SELECT *, (0.15 / n + 0.85 * c * x) / sum(0.15 / n + 0.85 * c * x) OVER (PARTITION BY session_id) AS y FROM turn WHERE t < 40 AND n > 1 AND moved >= 1e-5)),
last AS (SELECT session_id, position, x FROM turn QUALIFY t = max(t) OVER (PARTITION BY session_id)),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY round(x, 12) DESC, position) AS INT) AS rank FROM last)
SELECT p.session_id, p.position, sentence, round(x, 8) AS score, rank FROM placed p JOIN sent s ON s.session_id = p.session_id AND s.position = p.position WHERE rank <= 5"""


@query(_LINES + r""", w AS (SELECT DISTINCT session_id, seq, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM lines) SELECT word, count(*) AS lines FROM w GROUP BY word""")
def document_frequency(spark, sf_dir):
    return search.token_table(lines(spark, sf_dir)).groupBy("word").agg(F.count("*").alias("lines"))


@query(SQL["tfidf_search"].replace("SELECT session_id, seq, round(score, 6) AS score, CAST(r AS INT) AS rank FROM t WHERE r <= 20", "SELECT session_id, seq, round(score / max(score) OVER (), 8) AS relevance FROM t WHERE r <= 20") if "tfidf_search" in SQL else None)
def relevance_normalise(spark, sf_dir):
    return search.tf_idf(lines(spark, sf_dir), ["friday", "legal"]).select("session_id", "seq", F.round("relevance", 8).alias("relevance"))


_CLOCK = "lpad(CAST({ms} // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST({ms} // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({ms} // 1000 % 60 AS VARCHAR), 2, '0') || ',' || lpad(CAST({ms} % 1000 AS VARCHAR), 3, '0')"
_CUES = _TIMED + """, b AS (SELECT *, started_at - min(started_at) OVER (PARTITION BY session_id) AS s, ended_at - min(started_at) OVER (PARTITION BY session_id) AS e FROM timed),
l AS (SELECT *, greatest(e - s, 0.4) AS len FROM b),
d AS (SELECT *, sum(len) OVER (PARTITION BY session_id ORDER BY seq) AS d FROM l),
c AS (SELECT *, d + max(s - (d - len)) OVER (PARTITION BY session_id ORDER BY seq) AS cue_end FROM d),
m AS (SELECT *, CAST(round(greatest(cue_end - len, 0) * 1000) AS BIGINT) AS a, CAST(round(cue_end * 1000) AS BIGINT) AS z FROM c)"""
SQL["cue_deoverlap"] = _CUES + f" SELECT session_id, seq, {_CLOCK.format(ms='a')} AS start, {_CLOCK.format(ms='z')} AS \"end\" FROM m"
SQL["export_srt"] = _CUES + f""" SELECT session_id, CAST(seq AS INT) AS n, CASE WHEN seq = 1 THEN '' ELSE chr(10) END || CAST(seq AS VARCHAR) || chr(10) || {_CLOCK.format(ms='a')} || ' --> ' || {_CLOCK.format(ms='z')}
 || chr(10) || '[' || speaker || '] ' || text || chr(10) AS block FROM m"""


@query("SELECT time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE * k AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events CROSS JOIN (VALUES (0), (1), (2), (3)) AS s(k) GROUP BY ALL")
def events_sliding(spark, sf_dir):
    e = src.read(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour", "15 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return e.select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("""WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY event_type ORDER BY ts) + INTERVAL 10 MINUTE THEN 1 ELSE 0 END AS cut FROM events),
s AS (SELECT *, sum(cut) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT event_type, min(ts) AS start, max(ts) + INTERVAL 10 MINUTE AS "end", count(*) AS n FROM s GROUP BY event_type, k""")
def events_session_window(spark, sf_dir):
    e = src.read(spark, sf_dir, "events").groupBy("event_type", F.session_window("ts", "10 minutes").alias("w")).agg(F.count("*").alias("n"))
    return e.select("event_type", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


SQL["topic_shifts"] = rf"""WITH RECURSIVE said AS (SELECT conv_id AS session_id, CAST(turn + 1 AS INT) AS seq, list_filter(regexp_extract_all(lower(text), '\p{{L}}{{2,}}'), lambda t: len(t) > 2 AND t NOT IN ({_STOP})) AS t FROM conversations),
f AS (SELECT session_id, seq, flatten(list(t) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN 3 PRECEDING AND 2 PRECEDING)) AS a, flatten(list(t) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)) AS b, count(*) OVER (PARTITION BY session_id ORDER BY seq) AS n FROM said),
k AS (SELECT * FROM f WHERE n >= 4 AND len(a) >= 4 AND len(b) >= 4),
ca AS (SELECT session_id, seq, w, count(*) AS n FROM (SELECT session_id, seq, unnest(a) AS w FROM k) GROUP BY ALL),
cb AS (SELECT session_id, seq, w, count(*) AS n FROM (SELECT session_id, seq, unnest(b) AS w FROM k) GROUP BY ALL),
dots AS (SELECT session_id, seq, coalesce((SELECT sum(x.n * y.n) FROM ca x JOIN cb y USING (session_id, seq, w) WHERE x.session_id = k.session_id AND x.seq = k.seq), 0)
  / sqrt((SELECT sum(n * n) FROM ca WHERE ca.session_id = k.session_id AND ca.seq = k.seq) * (SELECT sum(n * n) FROM cb WHERE cb.session_id = k.session_id AND cb.seq = k.seq)) AS similarity FROM k),
cand AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS r FROM dots WHERE similarity < 0.5),
fold AS (SELECT session_id, r, seq AS last, seq, similarity, true AS kept FROM cand WHERE r = 1
  UNION ALL SELECT c.session_id, c.r, CASE WHEN c.seq - f.last < 2 THEN f.last ELSE c.seq END, c.seq, c.similarity, c.seq - f.last >= 2 FROM fold f JOIN cand c ON c.session_id = f.session_id AND c.r = f.r + 1)
SELECT session_id, seq, round(similarity, 8) AS similarity FROM fold WHERE kept"""
