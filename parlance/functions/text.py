"""Text functions as column expressions. Patterns carry (?diuU), so that classes are Unicode's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions import lexicons

# Stop words, filler words and phrases, priority hints and date patterns.
STOPWORDS = """
    a about above after again against all am an and any are aren't as at be because been before
    being below between both but by can cannot could couldn't did didn't do does doesn't doing
    don't down during each few for from further had hadn't has hasn't have haven't having he he'd
    he'll he's her here here's hers herself him himself his how how's i i'd i'll i'm i've if in
    into is isn't it it's its itself let's me more most mustn't my myself no nor not of off on once
    only or other ought our ours ourselves out over own same shan't she she'd she'll she's should
    shouldn't so some such than that that's the their theirs them themselves then there there's
    these they they'd they'll they're they've this those through to too under until up very was
    wasn't we we'd we'll we're we've were weren't what what's when when's where where's which while
    who who's whom why why's with won't would wouldn't you you'd you'll you're you've your yours
    yourself yourselves just really actually basically kind sort like okay yeah yes um uh gonna
    wanna going get got know think mean say said thing things stuff lot bit right well now also
    """.split()
FILLER_PHRASES = (
    r"\b(?:you know|i mean|sort of|kind of|like i said|to be honest|basically|actually|"
    r"literally|obviously|at the end of the day|if that makes sense|or something|right\?)\b"
)
LEADING_FILLER = ("so", "well", "okay", "ok", "right", "yeah", "um", "uh", "and", "but", "anyway")
PRIORITY_HINTS = {
    "critical": 3, "urgent": 3, "asap": 3, "immediately": 3, "blocker": 3,
    "important": 2, "priority": 2, "soon": 2, "today": 2, "tonight": 2,
    "whenever": 0, "eventually": 0, "sometime": 0, "later": 0,
}
RELATIVE_DATE = (
    r"\b("
    r"today|tonight|tomorrow|yesterday|"
    r"next\s+(?:week|month|year|monday|tuesday|wednesday|thursday|friday|saturday|sunday)|"
    r"this\s+(?:week|month|afternoon|evening|morning|monday|tuesday|wednesday|thursday|friday)|"
    r"end\s+of\s+(?:day|week|month|quarter|sprint)|"
    r"eod|eow|cob|"
    r"in\s+\d+\s+(?:minutes?|hours?|days?|weeks?|months?)|"
    r"by\s+\d{1,2}(?::\d{2})?\s*(?:am|pm)|"
    r"(?:mon|tues|wednes|thurs|fri|satur|sun)day|"
    r"jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|"
    r"aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
    r")\b"
)
NUMERIC_DATE = r"\b\d{1,4}[/-]\d{1,2}(?:[/-]\d{1,4})?\b"
TIME = r"\b\d{1,2}(?::\d{2})?\s*(?:am|pm)\b|\b\d{1,2}:\d{2}\b"

FLAGS = "(?diuU)"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def stopwords(language: str = "en") -> list[str]:
    """The English stop words and the language's own."""
    return list(dict.fromkeys([*STOPWORDS, *lexicons.STOPWORDS.get(language, "").split()]))


def tokens(text: Column, drop_stopwords: bool = False, language: str = "en") -> Column:
    """Runs of two letters or more, in lower case."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)[^\W\d_][^\W\d_'\-]+"), F.lit(0))
    if not drop_stopwords:
        return found
    return F.filter(found, lambda t: (F.length(t) > 2) & ~t.isin(stopwords(language)))


def sentences(text: Column) -> Column:
    parts = F.split(text, r"(?U)(?<=[.!?])\s+|\n+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def clean(text: Column) -> Column:
    """White space collapsed, ends freed of blanks and ,;:-."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^[ ,;:\-]+|[ ,;:\-]+$", "")


def compress(text: Column) -> Column:
    """The sentence without verbal filler; the sentence itself if nothing is left."""
    out = F.regexp_replace(text, FLAGS + FILLER_PHRASES, "")
    out = F.regexp_replace(out, FLAGS + rf"^(?:(?:{'|'.join(LEADING_FILLER)})[,\s]+)++", "")
    out = F.regexp_replace(out, r"(?U)\s*,(?:\s*,)+", ",")
    out = F.regexp_replace(out, r"(?U)\s+([,.;!?])", "$1")
    out = F.regexp_replace(F.regexp_replace(out, r"(?U)\s{2,}", " "), r"^[ ,;\-]+|[ ,;\-]+$", "")
    first = F.upper(F.substring(out, 1, 1))
    return F.when(out == "", strip(text)).otherwise(F.concat(first, F.substring(out, F.lit(2), F.length(out))))


def priority(text: Column) -> Column:
    """3, 2 or 0 by the hints that occur anywhere in the text, 1 without any; a 0 hint wins over the others."""
    low = F.lower(text)
    has = lambda n: F.lit(False) if not (w := [k for k, v in PRIORITY_HINTS.items() if v == n]) else low.rlike("|".join(w))
    return F.when(has(0), 0).when(has(3), 3).when(has(2), 2).otherwise(1)


def due_date(text: Column) -> Column:
    """The first relative date, else numeric date, else time of day; null without any."""
    found = [F.nullif(F.regexp_extract(text, FLAGS + p, 0), F.lit("")) for p in (RELATIVE_DATE, NUMERIC_DATE, TIME)]
    return strip(F.coalesce(*found))


def signature(text: Column) -> Column:
    """Sorted tokens of a commitment; its lower-case text where it has none."""
    found = tokens(text, drop_stopwords=True)
    return F.when(F.size(found) > 0, F.array_join(F.array_sort(found), " ")).otherwise(clean(F.lower(text)))


def highlight(text: Column, words: list[str]) -> Column:
    import re

    return F.regexp_replace(text, f"(?iu)({'|'.join(re.escape(w) for w in words)})", "«$1»") if words else text


def clock(seconds: Column, mark: str = ",") -> Column:
    """HH:MM:SS and milliseconds; rounding carries into the seconds."""
    ms = F.round(F.greatest(seconds, F.lit(0.0)) * 1000).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    part = lambda size, most: F.floor(ms / size) % most
    hours = F.floor(ms / 3_600_000)
    long_hours = F.when(hours < 100, two(hours)).otherwise(hours.cast("string"))
    return F.concat(long_hours, F.lit(":"), two(part(60_000, 60)), F.lit(":"), two(part(1000, 60)), F.lit(mark), F.lpad((ms % 1000).cast("string"), 3, "0"))
