"""Personal data with built-in functions alone: patterns, then contextual extraction bootstrapped from them.

Matches of the patterns are the seeds. The one and two words before seeds and the word behind them become lexical
patterns; Spark scores the graph of patterns and instances (identifier-like words) in turns. A pattern is trusted by
the share of its uses in the whole corpus, ordinary words counted, that a seed or an accepted instance fills, so words
that stand before anything are never trusted. Trusted patterns accept instances, which count for the patterns of the
next turn, until a turn accepts none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import spans
from parlance.llm.common import materialise, table

#: Possessive forms of the stated patterns; the look-behinds only skip starts inside a run, where no leftmost match starts.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "context")

#: An instance is a word with an at sign or four digits, without the signs that end or close it.
INSTANCE = r"(?<![^\s])(?:(?:[^\s0-9]*+[0-9]){4}|[^\s@]*+@)[^\s]*+"
#: A pattern counts if so many distinct trusted instances fill it, and is trusted from such a share of its uses.
MIN_SEEDS = 3
CONFIDENT = 0.6
#: Words of possible patterns that are broadcast at most; more are joined by a shuffle.
MAX_WORDS = 100_000
SALT = 16


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    from_end = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 1, c.try_cast("int") * 2).otherwise(c.try_cast("int")))
    return F.aggregate(from_end, F.lit(0), lambda acc, d: acc + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def _small(part: Column) -> Column:
    value = F.regexp_replace(part, "^0+", "")
    return (F.length(value) <= 3) & (F.coalesce(F.when(F.length(value) <= 3, value).try_cast("int"), F.lit(0)) <= 255)


def base_spans(text: Column) -> dict[str, Column]:
    """kind -> array<struct<start,end,text>>; failing matches are dropped and not tried again."""
    n = lambda t: F.length(digits(t))
    return {
        "email": spans.matches(text, EMAIL),
        "ip": spans.kept(spans.matches(text, IP), lambda t: F.forall(F.split(t, r"\."), _small)),
        "card": spans.kept(spans.matches(text, CARD), lambda t: n(t).between(14, 19) & F.when(n(t).between(14, 19), luhn(digits(t))).otherwise(False)),
        "phone": spans.kept(spans.matches(text, PHONE), lambda t: n(t).between(10, 15)),
    }


def _folded(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[0-9]+", "0")


def occurrences(text: Column, base: Column) -> Column:
    """array<struct<start,end,patterns,instance,seed>> of the identifier-like words in a text. Patterns are array
    <struct<kind,word,other>>: the word before, that with the one before it, the word behind, in lower case with one 0
    for digits in a row; a neighbour that is an instance itself gives none."""
    before = lambda gap: F.regexp_extract(gap, r"(?<![^\s])((?:[^\s]++\s++)?[^\s]++)\s*+$", 1)
    after = lambda gap: F.regexp_extract(gap, r"^[^\s]*+\s++([^\s]++)(?=\s|$)", 1)

    def one(s: Column) -> Column:
        word = F.regexp_replace(s["text"], r"[.,;:!?)\]>\"']++$", "")
        end = s["start"] + F.length(word)
        left = F.split(_folded(s["before"]), r"\s+")
        near = F.element_at(left, -1)
        far = F.when(F.size(left) > 1, F.element_at(left, 1)).otherwise("")
        behind = _folded(s["after"])
        pattern = lambda kind, w, o: F.struct(F.lit(kind).alias("kind"), w.alias("word"), o.alias("other"))
        found = F.array(pattern("before", near, F.lit("")), pattern("two", near, far), pattern("behind", behind, F.lit("")))
        found = F.filter(found, lambda p: (p["word"] != "") & ((p["kind"] != "two") | (p["other"] != "")))
        seed = F.exists(base, lambda b: (b["start"] < end) & (s["start"] < b["end"]))
        return F.struct(s["start"].alias("start"), end.alias("end"), found.alias("patterns"), F.lower(word).alias("instance"), seed.alias("seed"))

    return F.transform(spans.matches(text, INSTANCE, before, after), one)


_PATTERN = ("kind", "word", "other")


def uses(docs: DataFrame, patterns: DataFrame, most: int = MAX_WORDS) -> DataFrame:
    """docs (text), patterns (kind, word, other) -> patterns with uses: how often it stands in the texts. Texts meet the
    patterns' words, and pairs of words, in the tasks that read them, if these are `most` at most; only counts travel."""
    near = lambda df: F.broadcast(df) if df.count() <= most else df
    pair = patterns.where("kind = 'two'").select("word", "other")
    follow = lambda w, o: F.struct(w.alias("word"), o.alias("other"))
    pairs = spans.bound(F.split(_folded(F.col("text")), r"\s+"), lambda a: F.zip_with(a, F.concat(F.array(F.lit("")), F.slice(a, 1, F.size(a) - 1)), follow))
    pairs = docs.where("text is not null").select(F.explode(pairs).alias("p")).select("p.word", "p.other")
    pairs = pairs.join(near(patterns.select("word").distinct()), "word", "left_semi")
    pairs = pairs.join(near(pair.withColumn("asked", F.lit(True))), ["word", "other"], "left")
    counts = materialise(pairs.groupBy("word", F.when(F.col("asked"), F.col("other")).alias("other")).agg(F.count("*").alias("n")))
    one = counts.groupBy("word").agg(F.sum("n").alias("uses"))
    alone = patterns.where("kind <> 'two'").join(one, "word").select(*_PATTERN, "uses")
    return alone.unionByName(patterns.where("kind = 'two'").join(counts, ["word", "other"]).select(*_PATTERN, F.col("n").alias("uses")))


def confident_patterns(found: DataFrame, docs: DataFrame, least: float = CONFIDENT, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """found (patterns, instance, seed), docs (text) -> kind, word, other, trust of the trusted patterns.

    An edge joins a pattern with each distinct instance that fills it; n counts how often. Patterns that fewer than
    min_seeds distinct instances fill cannot be trusted in any turn and are left out first. The trust of a pattern is
    the number of its uses that a trusted instance fills over all its uses and one more.
    """
    edges = found.select(F.explode("patterns").alias("p"), "instance", "seed").groupBy("p.kind", "p.word", "p.other", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("n"))
    edges = materialise(edges)
    possible = materialise(edges.groupBy(*_PATTERN).agg(F.count("*").alias("many")).where(F.col("many") >= min_seeds).select(*_PATTERN))
    used = materialise(uses(docs, possible))
    seeds = materialise(found.where("seed").select("instance").distinct())
    accepted, trusted = seeds, None
    while True:
        marked = edges.join(accepted, "instance", "left_semi")
        sums = marked.groupBy(*_PATTERN).agg(F.count("*").alias("many"), F.sum("n").alias("n")).where(F.col("many") >= min_seeds)
        sums = sums.join(used, list(_PATTERN)).withColumn("trust", F.col("n") / (F.col("uses") + 1)).where(F.col("trust") >= least)
        trusted = materialise(sums.select(*_PATTERN, "trust"))
        spread = trusted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        salted = edges.withColumn("salt", F.pmod(F.hash("instance"), SALT))
        more = salted.join(spread.drop("trust"), [*_PATTERN, "salt"], "left_semi").select("instance").distinct().join(accepted, "instance", "left_anti")
        more = materialise(more)
        if more.isEmpty():
            return trusted
        accepted = materialise(accepted.unionByName(more))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, email, ip, card, phone, context: arrays of start, end (code points).

    Null and empty texts have none; a text of any length is searched whole. Each row of docs gives one row; other
    columns are ignored, whatever their names. context has the instances that no base span touches and that stand in
    a trusted pattern.
    """
    text = F.col("text")
    plain = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    base = base_spans(text)
    rows = docs.select("doc_id", "text", *[plain(c).alias(k) for k, c in base.items()])
    rows = rows.select("doc_id", *base, occurrences(text, F.concat(*base)).alias("seen"))
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()))
    seen = rows.select("row", F.explode("seen").alias("s")).select("row", "s.*")
    trusted = confident_patterns(seen, docs.select("text")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    new = seen.where("not seed").select("row", "start", "end", F.explode("patterns").alias("p")).select("row", "start", "end", "p.*")
    new = new.withColumn("salt", F.pmod(F.hash("row"), SALT)).join(trusted, [*_PATTERN, "salt"], "left_semi")
    new = new.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("context"))  # a text's own spans
    return rows.drop("seen").join(new, "row", "left").select("doc_id", *base, F.coalesce("context", F.array().cast("array<struct<start:int,end:int>>")).alias("context"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.concat(*[spans.labelled(F.col(k), k, i) for i, k in enumerate(KINDS[:4])])
    every = F.concat(base, spans.labelled(F.col("context"), "context", 4))
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:4]],
        spans.digest(spans.as_text(base)).alias("base_sha256"), spans.as_text(every).alias("spans"),
    )
