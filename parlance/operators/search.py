"""Ranked search over transcript lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from parlance.functions import text as T

K1, B = 1.2, 0.75


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def token_table(lines: DataFrame) -> DataFrame:
    """session_id, seq, word, tf, length of every word of a line. search_index keeps an index that is searched."""
    sized = lines.select("session_id", "seq", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    parts = sized.select("session_id", "seq", F.size("words").alias("length"), F.explode("words").alias("word"))
    return parts.groupBy("session_id", "seq", "length", "word").agg(F.count("*").alias("tf"))


def tf_idf(lines: DataFrame, query: list[str], k: int = 20) -> DataFrame:
    """Sum over the query's words in a line of ln(1 + N / lines with it); whole words, a repeated one counts again."""
    n = lines.agg(F.count("*").cast("double").alias("total"))
    wanted = list(dict.fromkeys(query))
    found = lines.select("session_id", "seq", F.explode(F.array_intersect(words(F.col("text")), F.array(*map(F.lit, wanted)))).alias("word"))
    times = F.create_map(*[F.lit(x) for w in wanted for x in (w, query.count(w))])
    df = found.groupBy("word").agg(F.count("*").alias("df")).crossJoin(n)  # a row for each word of the query, and one row
    score = F.sum(F.element_at(times, F.col("word")) * F.log1p(F.col("total") / F.col("df")))
    return ranked(found.join(F.broadcast(df), "word").groupBy("session_id", "seq").agg(score.alias("score")), k)


def bm25(lines: DataFrame, query: list[str], k: int = 20) -> DataFrame:
    """Lines that have a word with each prefix in query, by BM25 with the frequencies of the prefixes."""
    sized = lines.select("session_id", "seq", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    stats = sized.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean")).first()
    parts = sized.select("session_id", "seq", F.size("words").alias("length"), F.explode("words").alias("word"))
    prefixes = list(dict.fromkeys(query))
    tf = [F.count_if(F.col("word").startswith(p)).alias(f"tf{i}") for i, p in enumerate(prefixes)]
    any_hit = F.lit(False)
    for p in prefixes:
        any_hit = any_hit | F.col("word").startswith(p)
    hit = parts.where(any_hit).groupBy("session_id", "seq", "length").agg(*tf)
    df = hit.agg(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(prefixes))]).first()
    score = F.lit(0.0)
    both = F.lit(True)
    for i in range(len(prefixes)):
        idf = F.greatest(F.log((F.lit(float(stats.n)) - df[i] + 0.5) / (F.lit(float(df[i])) + 0.5)), F.lit(1e-6))
        t = F.col(f"tf{i}")
        score = score + idf * t * (K1 + 1) / (t + K1 * (1 - B + B * F.col("length") / F.lit(float(stats.mean or 1))))
        both = both & (t > 0)
    return ranked(hit.where(both).select("session_id", "seq", score.alias("score")), k)


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """The k best with rank and relevance, which is 1 for the best; equal scores go to the later line."""
    order = [F.desc(F.round("score", 9)), F.desc("seq"), "session_id"]
    top = hits.orderBy(*order).limit(k)
    best = F.max("score").over(W.partitionBy())
    return top.select("session_id", "seq", "score", F.when(best > 0, F.col("score") / best).otherwise(1.0).alias("relevance"), F.row_number().over(W.orderBy(*order)).alias("rank"))


def search_sessions(lines: DataFrame, sessions: DataFrame, query: str, k: int = 20, without: str | None = None, index=None) -> DataFrame:
    """bm25() of a query as typed over all sessions: every word a prefix, quotes taken off, with the session's name and
    the line marked. without leaves the session at hand out. An empty query finds nothing. With a search_index.Index of
    the lines the hits come from it, and lines give their texts alone."""
    terms = query_terms(query)
    pool = lines if without is None else lines.where(F.col("session_id") != without)
    if index is not None:
        hits = index.bm25(terms, k, without)
    else:
        hits = bm25(pool, terms, k) if terms else bm25(pool.limit(0), ["x"], k)
    named = hits.join(lines.select("session_id", "seq", "text"), ["session_id", "seq"])
    named = named.join(F.broadcast(sessions.select("session_id", F.col("name").alias("session_name"))), "session_id", "left") if sessions is not None else named
    return named.withColumn("marked", T.highlight(F.col("text"), terms)).withColumn("snippet", snippet(F.col("text"), terms))


def search_session(lines: DataFrame, session_id, query: str, k: int = 20) -> DataFrame:
    """Lines of one session with every word of the query, by BM25; if none has, those with any, by TF-IDF."""
    mine = lines.where(F.col("session_id") == session_id)
    terms = query_terms(query)
    hits = bm25(mine, terms, k) if terms else None
    if hits is None or not hits.isEmpty():
        return bm25(mine.limit(0), ["x"], k) if hits is None else hits
    return tf_idf(mine, [t for t in terms if t], k)


def query_terms(query: str) -> list[str]:
    found = [t.replace('"', "").lower() for t in query.split()]
    return [t for t in found if t]


def snippet(text: Column, terms: list[str], size: int = 12) -> Column:
    """The first `size` words from the first one that begins with a term, each such word marked."""
    said = F.split(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), " ")
    hit = lambda w: F.exists(F.array(*map(F.lit, terms)), lambda t: F.lower(F.regexp_replace(w, r"^[^\p{L}\p{N}]+", "")).startswith(t)) if terms else F.lit(False)
    first = F.coalesce(F.get(F.filter(F.transform(said, lambda w, i: F.when(hit(w), i)), lambda i: i.isNotNull()), F.lit(0)), F.lit(0))
    begin = F.greatest(F.lit(0), F.least(first, F.size(said) - size))
    shown = F.transform(F.slice(said, begin + 1, size), lambda w: F.when(hit(w), F.concat(F.lit("«"), w, F.lit("»"))).otherwise(w))
    return F.concat(F.when(begin > 0, "…").otherwise(""), F.array_join(shown, " "), F.when(begin + size < F.size(said), "…").otherwise(""))
