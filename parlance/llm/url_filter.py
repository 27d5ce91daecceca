"""URL verdicts from lists of hosts and paths by Bloom filter cascades, with built-in functions alone.

A list of keys (host and path in one string) becomes a chain of Bloom filters. The first holds the listed keys, the second
the other keys of the corpus that the first lets through, the third the listed keys that the second lets through, and so
on until none is left. For all keys of the corpus, the complete universe, the chain's answer is exact; a row is judged
where it is read, without a join or a shuffle.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import fresh, materialise, table

#: What a level lets through by mistake is about one key for 2 ** RATE that it holds, or less.
RATE = 4
#: Bits of a key in one word of a filter.
BITS = 6
#: Words that a level has at least: short lists need few levels then.
LEAST_WORDS = 64
#: Words that a level may have, 16 MB in each task. A longer list is cut by the hash of the key into parts with a chain
#: each, and the rows are judged part by part.
MOST_WORDS = 2**21
#: Shapes of keys (labels of the host, characters of the path) that one pass over the rows tries.
SHAPES_A_PASS = 32

RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
)
#: Parts of a host's labels that put it on the list of blocked hosts in op13.
ABUSE = ("ads", "bets", "casino", "pills", "spam")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Level(NamedTuple):
    """A Bloom filter of 64-bit words; a key sets up to BITS bits in each of some words."""

    number: int
    probes: int
    size: int  # words
    words: DataFrame | None = None  # one row, array<bigint>

    def bits(self, key: Column) -> list[tuple[Column, Column]]:
        """(word, bits) of each probe of key."""
        out = []
        for i in range(self.probes):
            x = F.xxhash64(key, F.lit(self.number), F.lit(i))
            mask = F.lit(0).cast("long")
            for k in range(BITS):
                mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(x, 6 * k).bitwiseAND(63).cast("int")))
            out.append(((F.shiftrightunsigned(x, 6 * BITS) % self.size).cast("int"), mask))
        return out

    def holds(self, key: Column) -> Column:
        words, out = self.words.scalar(), F.lit(True)
        for word, mask in self.bits(key):
            out = out & (F.bitwise_not(F.get(words, word)).bitwiseAND(mask) == 0)
        return out

    def filled(self, keys: DataFrame) -> Level:
        probes = F.explode(F.array(*[F.struct(w.cast("long").alias("word"), m.alias("bits")) for w, m in self.bits(F.col("key"))]))
        none = keys.sparkSession.range(self.size).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
        words = keys.select(probes.alias("p")).select("p.*").unionAll(none).groupBy("word").agg(F.bit_or("bits").alias("bits"))
        whole = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"]).alias("words"))
        return self._replace(words=materialise(whole))


def _level(number: int, n: int, others: int) -> Level:
    """Without its words: for n keys, to keep out all but a small share of n of the others."""
    probes = math.ceil((RATE + max(0.0, math.log2(max(others, 1) / n))) / BITS)
    return Level(number, probes, max(LEAST_WORDS, math.ceil(1.6 * BITS * probes * n / 64)))


def cascade(keys: DataFrame) -> list[Level]:
    """keys (key, listed), each key of the universe once -> the levels; none if no key is listed."""
    inside, outside = keys.where("listed").select("key"), keys.where("not listed").select("key")
    n, others = inside.count(), outside.count()
    levels: list[Level] = []
    while n:
        level = _level(len(levels), n, others).filled(inside)
        levels.append(level)
        let_through = materialise(outside.where(level.holds(F.col("key"))))
        inside, outside, n, others = let_through, inside, let_through.count(), n
    return levels


def member(levels: list[Level], key: Column) -> Column:
    """Whether key, one of the universe, is listed: a key that stops at an even level is not, at an odd one it is."""
    out = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        out = F.when(~level.holds(key), F.lit(level.number % 2 == 1)).otherwise(out)
    return out


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(_rest(url), "^[^/?#]*+", ""), "^[^?#]*", 0)


def _rest(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."))) + 1


def _key(host: Column, path: Column, shape: tuple[int, int]) -> Column:
    """The last labels of host and the first characters of path; null where there are not so many."""
    labels, size = shape
    return F.when((_labels(host) >= labels) & (F.length(path) >= size), F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, size)))


def judge_urls(pages: DataFrame, rules: DataFrame, hosts: DataFrame) -> DataFrame:
    """pages with url, rules (host, path, verdict allow or block) and blocked hosts (host) -> pages with host, path, rule, verdict.

    A rule fits its host and all its subdomains if the path begins with the rule's; of several the longest decides (of
    equal length the longer host, then block before allow). Without one the verdict is block for a blocked host and its
    subdomains, else allow. A null or empty url, or one without "://", has an empty host and path and no rule. Urls of
    any length are whole; rows that repeat are judged each; columns named like the four are replaced, others pass. An
    empty table gives an empty one, empty lists allow all.
    """
    rules = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host is not null")
    hosts = hosts.select(F.translate("host", _UPPER, _LOWER).alias("host"), F.lit("").alias("path"), F.lit("host").alias("verdict")).where("host is not null")
    listed = materialise(rules.unionByName(hosts).withColumn("labels", _labels(F.col("host"))).withColumn("size", F.length("path")))
    shapes_of: dict[str, list] = {}
    for kind, *shape in listed.select("verdict", "labels", "size").distinct().sort("verdict", "labels", "size").collect():  # lengths, not keys
        shapes_of.setdefault(kind, []).append(tuple(shape))
    kinds, shapes = list(shapes_of), sorted({s for own in shapes_of.values() for s in own})
    url = F.col("url")
    out = pages.withColumn("host", host_of(url)).withColumn("path", path_of(url))
    best, blocked = fresh(out, "best"), fresh(out, "listed")
    nothing = F.lit(None).cast("struct<size:int,host:int,verdict:string,key:string>")
    out = out.withColumn(best, nothing).withColumn(blocked, F.lit(False))
    first = True
    for some in [shapes[i : i + SHAPES_A_PASS] for i in range(0, len(shapes), SHAPES_A_PASS)]:
        found = F.explode(F.array(*[_key(host_of(url), path_of(url), s) for s in some])).alias("key")
        universe = materialise(pages.select(found).where("key is not null").distinct())
        own = {k: [s for s in some if s in shapes_of[k]] for k in kinds}
        chains = {k: _chains(universe, listed.where(F.col("verdict") == k)) for k in kinds if own[k]}
        for part in range(max(map(len, chains.values()))):
            out = out if first else materialise(out)
            first = False
            out = _pass(out, own, {k: (c[part], part, len(c)) for k, c in chains.items() if part < len(c)}, best, blocked)
    rule, decided = F.col(f"{best}.key"), F.col(f"{best}.verdict")
    verdict = F.coalesce(decided, F.when(F.col(blocked), "block").otherwise("allow"))
    return out.withColumn("rule", rule).withColumn("verdict", verdict).drop(best, blocked)


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("part")), F.lit(parts))


def _chains(universe: DataFrame, listed: DataFrame) -> list[list[Level]]:
    """The chains of the keys listed that the universe has, one for each part."""
    marked = universe.select("key", F.lit(False).alias("listed"), F.lit(True).alias("seen"))
    marked = marked.unionAll(listed.select(F.concat("host", "path"), F.lit(True), F.lit(False)))
    keys = materialise(marked.groupBy("key").agg(F.max("listed").alias("listed"), F.max("seen").alias("seen")).where("seen").drop("seen"))
    n, others = keys.agg(F.count_if("listed"), F.count_if(~F.col("listed"))).first()
    parts = math.ceil(_level(0, n, others).size / MOST_WORDS) if n else 1
    return [cascade(keys.where(_part(F.col("key"), parts) == p) if parts > 1 else keys) for p in range(parts)]


def _pass(rows: DataFrame, shapes: dict, chains: dict, best: str, blocked: str) -> DataFrame:
    names = {s: fresh(rows, f"key_{s[0]}_{s[1]}") for own in shapes.values() for s in own}
    keyed = rows.withColumns({n: _key(F.col("host"), F.col("path"), s) for s, n in names.items()})
    candidates, blocks = [F.col(best)], F.col(blocked)
    for kind, (levels, part, parts) in chains.items():
        for labels, size in shapes[kind]:
            key = F.col(names[labels, size])
            fits = key.isNotNull() & member(levels, key)
            fits = fits & (_part(key, parts) == part) if parts > 1 else fits
            if kind == "host":
                blocks = blocks | F.coalesce(fits, F.lit(False))
            else:
                whole = F.length(key)
                candidates.append(F.when(fits, F.struct(whole.alias("size"), (whole - size).alias("host"), F.lit(kind).alias("verdict"), key.alias("key"))))
    top = F.array_max(F.array(*candidates)) if len(candidates) > 1 else candidates[0]
    return keyed.withColumns({best: top, blocked: blocks}).drop(*names.values())


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    hosts = pages.select(host_of(F.col("url")).alias("host")).distinct().where(F.col("host").rlike(f"(^|[.-])({'|'.join(ABUSE)})([.-]|$)"))
    return judge_urls(pages, rules, hosts).select("page_id", "host", "path", "rule", "verdict")


OP13_SQL = rf"""
WITH rules(host, path, verdict) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM cut),
fitted AS (
  SELECT *, (SELECT arg_max(r.host || r.path, length(r.host || r.path)) FROM rules r
             WHERE (split.host = r.host OR ends_with(split.host, '.' || r.host)) AND starts_with(split.path, r.path)) AS rule FROM split)
SELECT page_id, f.host, f.path, f.rule,
       coalesce(r.verdict, CASE WHEN regexp_matches(f.host, '(^|[.-])({"|".join(ABUSE)})([.-]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM fitted f LEFT JOIN rules r ON f.rule = r.host || r.path
"""
