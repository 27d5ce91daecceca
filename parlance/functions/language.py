"""Language detection by marker words and diacritics, and the sticky choice along a session."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.sentiment import bound

# Marker words and diacritics of each language.
MARKERS = {
    "en": """the and that have for not with you this but his from they say her she will one all would there their what
        about which when make like time just know take into your some could them than then look only come over think also
        back after use two how our work first well way even want because these give day most need should does going""",
    "es": """que de no la el es en lo un por qué una los con para está esto del las muy más pero todo bien sí aquí
        ahora cuando porque hacer puede tiene vamos también hasta desde sobre entre nosotros ustedes ellos este esa ese cómo
        dónde quién gracias señor nada algo otro tiempo año día""",
    "fr": """que de je est pas le vous la tu il et les des en un une ce qui nous sur pour dans avec mais tout plus
        bien être avoir faire comme aussi très quand parce alors donc chose temps jour année merci oui non peut cette ces
        leur sans sous entre après avant encore toujours jamais""",
    "de": """der die und ich das nicht sie ist es den zu wir mit ein eine auf für aber auch als war hat dass sich von
        dem noch wie über nur muss kann sehr schon immer jetzt hier dann weil wenn oder mehr einen seine ihre unser
        danke bitte heute morgen jahr zeit arbeit machen haben""",
    "it": """che di non il la un per sono una mi con ma come questo bene più anche molto quando perché cosa tutto solo
        adesso grazie sì noi loro essere fare avere dove chi tempo anno giorno lavoro sempre mai ancora dopo prima""",
    "pt": """que não de para com uma você por mais isso está muito como mas quando porque então aqui agora obrigado sim nós
        eles fazer ter ser tempo ano dia trabalho sempre nunca ainda depois antes tudo nada algo outro esse essa""",
    "nl": """de het een ik je niet dat en van is we op voor met maar ook als zijn hebben worden kunnen moeten heel
        altijd nooit vandaag morgen jaar tijd werk dank graag omdat wanneer waar wie hoe nog alleen samen""",
}
DIACRITICS = {"es": "ñáéíóúü¿¡", "fr": "àâçéèêëîïôûùüÿœ", "de": "äöüß", "pt": "ãõáâçéêíóôú", "it": "àèéìòù", "nl": "ëïĳ"}
SUPPORTED = ("en", "es", "fr", "de", "it", "pt")
MIN_TOKENS = 4
LEAD = 0.15
WINDOW = 5


def _among(values: list[str]):
    return lambda w: w.isin(values)  # a hash lookup, where array_contains would go through the list


def scores(text: Column) -> Column:
    """array<struct<score,rank,code>>, one for each language in the order of MARKERS. The words are gone through once
    for those that mark any language, and the text once for its diacritics; each language looks at what is left."""
    low = F.lower(F.coalesce(text, F.lit("")))
    every = sorted({w for markers in MARKERS.values() for w in markers.split()})
    signs = "".join(sorted(set("".join(DIACRITICS.values()))))

    def each(words: Column) -> Column:
        return bound(F.struct(F.filter(words, _among(every)).alias("marks"), F.regexp_replace(low, f"[^{signs}]", "").alias("signs")), lambda x: of(words, x))

    def of(words: Column, x: Column) -> Column:
        out = []
        for i, (code, markers) in enumerate(MARKERS.items()):
            ratio = F.size(F.filter(x["marks"], _among(markers.split()))) / F.greatest(F.size(words), F.lit(1))
            hints = F.lit(0.0)
            for c in DIACRITICS.get(code, ""):
                hints = hints + F.when(x["signs"].contains(c), 0.04).otherwise(0.0)
            out.append(F.struct((ratio + F.least(hints, F.lit(0.2))).alias("score"), F.lit(-i).alias("rank"), F.lit(code).alias("code")))
        return F.when(F.size(words) >= MIN_TOKENS, F.array(*out)).otherwise(F.array().cast("array<struct<score:double,rank:int,code:string>>"))

    return bound(F.regexp_extract_all(low, F.lit(r"\p{L}+"), F.lit(0)), each)


def detect(text: Column, default: str = "en") -> Column:
    """struct<code,confidence>: the best score and its lead; the default with confidence 0 for short or unmarked texts."""

    def pick(order: Column) -> Column:
        best, second = F.get(order, F.lit(0)), F.get(order, F.lit(1))
        known = F.coalesce(best["score"], F.lit(0.0)) > 0
        sure = F.least(F.lit(1.0), best["score"] + best["score"] - second["score"])  # from the left, as in SQL: sums meet LEAD to the bit
        return F.struct(F.when(known, best["code"]).otherwise(default).alias("code"), F.when(known, sure).otherwise(0.0).alias("confidence"))

    return bound(F.reverse(F.array_sort(scores(text))), pick)


def in_charge(recent, now: str) -> str:
    """The language after the last lines (code, confidence): the leader of their sums if it leads the one now by LEAD."""
    rank = {code: i for i, code in enumerate(MARKERS)}
    tally: dict[str, float] = {}
    for code, confidence in recent:
        tally[code] = tally.get(code, 0.0) + confidence
    lead = min(tally, key=lambda c: (-tally[c], rank.get(c, len(rank))))
    return lead if lead != now and tally[lead] - tally.get(now, 0.0) >= LEAD else now


def sticky(lines: DataFrame, default: str = "en") -> DataFrame:
    """lines (session_id, seq, code, confidence) with current: a language takes over when it leads the one in charge
    by LEAD in the summed confidence of the last lines. One fold over the lines in order, whatever the length of a
    session; a task keeps the last lines of one session."""

    def fold(batches):  # Arrow, so that no other column changes its type
        session, now, recent = object(), default, deque(maxlen=WINDOW)
        for part in batches:
            out = []
            for key, code, confidence in zip(*(part.column(c).to_pylist() for c in ("session_id", "code", "confidence")), strict=True):
                if key != session:
                    session, now = key, default
                    recent.clear()
                recent.append((code, confidence))
                now = in_charge(recent, now)
                out.append(now)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], [*part.schema.names, "current"])

    ordered = lines.repartition("session_id").sortWithinPartitions("session_id", "seq")
    return ordered.mapInArrow(fold, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema) + ", current string")
