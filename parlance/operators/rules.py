"""Rule extraction: a table of rules, matched with offsets by one Arrow function, or one rule at a time in SQL."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import text as T


@dataclass(frozen=True)
class Rule:
    name: str
    kind: str
    pattern: str
    confidence: float
    language: str = "en"


# The English rules, which always apply, and those of the other languages.
RULES = (
    Rule("reminder", "action_item", r"\bremind\s+(?:me|us|him|her|them)\s+to\s+(.+?)(?=[.?!;]|$)", 0.95),
    Rule("assignment", "action_item", r"\b(?:can|could|will|would)\s+you\s+(?:please\s+)?(.+?)(?=[.?!;]|$)", 0.8),
    Rule("commitment", "action_item", r"\bi(?:'ll| will| am going to| gonna)\s+(.+?)(?=[.?!;]|$)", 0.85),
    Rule("team_commitment", "action_item", r"\bwe\s+(?:need|have)\s+to\s+(.+?)(?=[.?!;]|$)", 0.85),
    Rule("directive", "action_item", r"\b(?:make sure|be sure|don't forget|do not forget)\s+to\s+(.+?)(?=[.?!;]|$)", 0.9),
    Rule("follow_up", "action_item", r"\b(?:follow up|circle back|check back)\s+(?:on|with)\s+(.+?)(?=[.?!;]|$)", 0.85),
    Rule("action_item_phrase", "action_item", r"\baction item(?:s)?\s*(?:is|are|:)?\s*(.+?)(?=[.?!;]|$)", 0.9),
    Rule("task_assignment", "action_item", r"\b(?:let's|lets)\s+(.+?)(?=[.?!;]|$)", 0.7),
    Rule("deadline", "deadline", r"\bdeadline\s+(?:is|was|will be)?\s*(.+?)(?=[.?!;,]|\s+and\b|\s+but\b|$)", 0.95),
    Rule("due_by", "deadline", r"\b(?:due|needs to be done|has to be ready)\s+(?:by|on|before)\s+(.+?)(?=[.?!;]|$)", 0.9),
    Rule("ship_by", "deadline", r"\b(?:ship|deliver|submit|send)\s+(?:it|this|that)?\s*by\s+(.+?)(?=[.?!;]|$)", 0.85),
    Rule("decision", "decision", r"\bwe(?:'ve| have)?\s+decided\s+(?:to|that)\s+(.+?)(?=[.?!;]|$)", 0.9),
    Rule("agreement", "decision", r"\b(?:we agreed|agreement is|consensus is)\s+(?:to|that|on)?\s*(.+?)(?=[.?!;]|$)", 0.85),
    Rule("blocker", "blocker", r"\b(?:blocked (?:on|by)|blocker is|stuck on)\s+(.+?)(?=[.?!;]|$)", 0.9),
    Rule("risk", "risk", r"\b(?:risk is|concern is|worried about|problem is)\s+(.+?)(?=[.?!;]|$)", 0.8),
    Rule("question", "question", r"((?:^|[.!?]\s*)(?:who|what|when|where|why|how|which)\b[^.?!]*\?)", 0.75),
    Rule("metric", "metric", r"\b((?:\$|€|£)?\d[\d,.]*\s*(?:%|percent|k|m|bn|million|billion|users|dollars)?)\b", 0.6),
    Rule("recordatorio", "action_item", r"\brecu[ée]rdame\s+(?:que\s+)?(.+?)(?=[.?!;]|$)", 0.95, "es"),
    Rule("compromiso", "action_item", r"\b(?:voy a|tengo que|hay que|necesitamos)\s+(.+?)(?=[.?!;]|$)", 0.85, "es"),
    Rule("peticion", "action_item", r"\b(?:puedes|podr[íi]as)\s+(?:por favor\s+)?(.+?)(?=[.?!;]|$)", 0.8, "es"),
    Rule("fecha_limite", "deadline", r"\b(?:fecha l[íi]mite|plazo)\s+(?:es|era)?\s*(.+?)(?=[.?!;,]|\s+y\b|$)", 0.95, "es"),
    Rule("entrega", "deadline", r"\b(?:para|antes del|antes de)\s+(lunes|martes|mi[ée]rcoles|jueves|viernes|s[áa]bado|domingo|ma[ñn]ana|hoy|fin de semana)\b", 0.85, "es"),
    Rule("bloqueo", "blocker", r"\b(?:estoy bloqueado|bloqueado (?:en|por)|atascado en)\s+(.+?)(?=[.?!;]|$)", 0.9, "es"),
    Rule("decision", "decision", r"\b(?:hemos decidido|decidimos)\s+(?:que\s+)?(.+?)(?=[.?!;]|$)", 0.9, "es"),
    Rule("rappel", "action_item", r"\brappelle[- ]moi\s+(?:de\s+)?(.+?)(?=[.?!;]|$)", 0.95, "fr"),
    Rule("engagement", "action_item", r"\b(?:je vais|il faut|nous devons|on doit)\s+(.+?)(?=[.?!;]|$)", 0.85, "fr"),
    Rule("demande", "action_item", r"\b(?:peux-tu|pouvez-vous|pourrais-tu)\s+(?:s'il te pla[îi]t\s+)?(.+?)(?=[.?!;]|$)", 0.8, "fr"),
    Rule("echeance", "deadline", r"\b(?:date limite|[ée]ch[ée]ance|d[ée]lai)\s+(?:est|était)?\s*(.+?)(?=[.?!;,]|\s+et\b|$)", 0.95, "fr"),
    Rule("livraison", "deadline", r"\b(?:avant|pour)\s+(lundi|mardi|mercredi|jeudi|vendredi|samedi|dimanche|demain|aujourd'hui|la fin de la semaine)\b", 0.85, "fr"),
    Rule("blocage", "blocker", r"\b(?:je suis bloqu[ée]|bloqu[ée] (?:sur|par)|coinc[ée] sur)\s+(.+?)(?=[.?!;]|$)", 0.9, "fr"),
    Rule("decision", "decision", r"\b(?:nous avons d[ée]cid[ée]|on a d[ée]cid[ée])\s+(?:de\s+|que\s+)?(.+?)(?=[.?!;]|$)", 0.9, "fr"),
    Rule("erinnerung", "action_item", r"\berinnere mich\s+(?:daran,?\s+)?(.+?)(?=[.?!;]|$)", 0.95, "de"),
    Rule("zusage", "action_item", r"\b(?:ich werde|wir m[üu]ssen|ich muss|wir sollten)\s+(.+?)(?=[.?!;]|$)", 0.85, "de"),
    Rule("bitte", "action_item", r"\b(?:kannst du|k[öo]nnen sie|k[öo]nntest du)\s+(?:bitte\s+)?(.+?)(?=[.?!;]|$)", 0.8, "de"),
    Rule("frist", "deadline", r"\b(?:frist|deadline|abgabetermin)\s+(?:ist|war)?\s*(.+?)(?=[.?!;,]|\s+und\b|$)", 0.95, "de"),
    Rule("termin", "deadline", r"\b(?:bis)\s+(montag|dienstag|mittwoch|donnerstag|freitag|samstag|sonntag|morgen|heute|ende der woche)\b", 0.85, "de"),
    Rule("blocker", "blocker", r"\b(?:ich bin blockiert|blockiert (?:durch|von)|h[äa]nge an)\s+(.+?)(?=[.?!;]|$)", 0.9, "de"),
    Rule("entscheidung", "decision", r"\bwir haben entschieden,?\s+(?:dass\s+)?(.+?)(?=[.?!;]|$)", 0.9, "de"),
    Rule("promemoria", "action_item", r"\bricordami\s+(?:di\s+)?(.+?)(?=[.?!;]|$)", 0.95, "it"),
    Rule("impegno", "action_item", r"\b(?:devo|dobbiamo|bisogna)\s+(.+?)(?=[.?!;]|$)", 0.85, "it"),
    Rule("richiesta", "action_item", r"\b(?:puoi|potresti|potete)\s+(?:per favore\s+)?(.+?)(?=[.?!;]|$)", 0.8, "it"),
    Rule("scadenza", "deadline", r"\b(?:scadenza|termine)\s+(?:è|era)?\s*(.+?)(?=[.?!;,]|\s+e\b|$)", 0.95, "it"),
    Rule("consegna", "deadline", r"\b(?:entro|prima di)\s+(luned[ìi]|marted[ìi]|mercoled[ìi]|gioved[ìi]|venerd[ìi]|sabato|domenica|domani|oggi|fine settimana)\b", 0.85, "it"),
    Rule("blocco", "blocker", r"\b(?:sono bloccato|bloccato (?:su|da))\s+(.+?)(?=[.?!;]|$)", 0.9, "it"),
    Rule("decisione", "decision", r"\b(?:abbiamo deciso|si è deciso)\s+(?:di\s+|che\s+)?(.+?)(?=[.?!;]|$)", 0.9, "it"),
    Rule("lembrete", "action_item", r"\blembre?-?me\s+(?:de\s+)?(.+?)(?=[.?!;]|$)", 0.95, "pt"),
    Rule("compromisso", "action_item", r"\b(?:vou|precisamos|preciso|temos que)\s+(.+?)(?=[.?!;]|$)", 0.85, "pt"),
    Rule("pedido", "action_item", r"\b(?:voc[êe] pode|poderia)\s+(?:por favor\s+)?(.+?)(?=[.?!;]|$)", 0.8, "pt"),
    Rule("prazo", "deadline", r"\b(?:prazo|data limite)\s+(?:é|era)?\s*(.+?)(?=[.?!;,]|\s+e\b|$)", 0.95, "pt"),
    Rule("entrega", "deadline", r"\b(?:at[ée]|antes de)\s+(segunda|ter[çc]a|quarta|quinta|sexta|s[áa]bado|domingo|amanh[ãa]|hoje|fim de semana)\b", 0.85, "pt"),
    Rule("bloqueio", "blocker", r"\b(?:estou bloqueado|bloqueado (?:em|por)|travado em)\s+(.+?)(?=[.?!;]|$)", 0.9, "pt"),
    Rule("decisao", "decision", r"\b(?:decidimos|n[óo]s decidimos)\s+(?:que\s+)?(.+?)(?=[.?!;]|$)", 0.9, "pt"),
)
#: Kinds that are stored; the others are only reported with their line.
STORED = ("action_item", "deadline", "blocker", "decision")

_HITS = "array<struct<kind:string,text:string,rule:string,start:int,end:int,confidence:double>>"


def hits(line: str | None, rules: Sequence[tuple[Rule, re.Pattern]]) -> list[dict]:
    """First hit for each kind and text, surest first, without those inside a longer hit of the kind."""
    first: dict[tuple[str, str], dict] = {}
    for rule, pattern in rules:
        for m in pattern.finditer(line or ""):
            fragment = re.sub(r"\s+", " ", m[1] or "").strip(" ,;:-")
            if len(fragment) >= 3:
                hit = {"kind": rule.kind, "text": fragment, "rule": rule.name, "start": m.start(1), "end": m.end(1), "confidence": rule.confidence, "whole": m[0]}
                first.setdefault((rule.kind, fragment.lower()), hit)
    found = sorted(first.values(), key=lambda h: (-h["confidence"], h["start"]))

    def hidden(i: int) -> bool:
        h = found[i]
        for j, o in enumerate(found):
            around = o["kind"] == h["kind"] and o["start"] <= h["start"] and o["end"] >= h["end"]
            if j != i and around and (o["end"] - o["start"] > h["end"] - h["start"] or j < i):
                return True
        return False

    return [h for i, h in enumerate(found) if not hidden(i)]


def matched(text: Column, language: Column, rules: Sequence[Rule] = RULES) -> Column:
    """array<struct<kind,text,rule,start,end,confidence,priority,due>> of a text; English rules and the language's."""

    @F.pandas_udf("array<struct<kind:string,text:string,rule:string,start:int,end:int,confidence:double,whole:string>>")
    def match(texts: pd.Series, codes: pd.Series) -> pd.Series:
        compiled = [(r, re.compile(r.pattern, re.IGNORECASE)) for r in rules]
        return pd.Series([hits(t, [x for x in compiled if x[0].language in ("en", c)]) for t, c in zip(texts, codes, strict=True)])

    whole = lambda h: F.struct(*[h[c].alias(c) for c in ("kind", "text", "rule", "start", "end", "confidence")], T.priority(h["whole"]).alias("priority"), T.due_date(h["whole"]).alias("due"))
    return F.transform(match(text, language), whole)


def extract(lines: DataFrame, rules: Sequence[Rule] = RULES, language: str | None = None) -> DataFrame:
    """lines with text (and the column named by language) -> one row for each hit, with the columns of lines, kind,
    fragment, rule, start, end, confidence, priority and due. English rules apply to every line. Lines that no pattern
    finds anything in are left out before Python sees them."""
    code = F.col(language) if language else F.lit("en")
    may = None
    for name in dict.fromkeys(r.language for r in rules):
        hit = F.col("text").rlike(T.FLAGS + "|".join(f"(?:{r.pattern})" for r in rules if r.language == name))
        hit = hit if name == "en" else (code == name) & hit
        may = hit if may is None else may | hit

    @F.pandas_udf("array<struct<kind:string,text:string,rule:string,start:int,end:int,confidence:double,whole:string>>")
    def match(texts: pd.Series, codes: pd.Series) -> pd.Series:
        compiled = [(r, re.compile(r.pattern, re.IGNORECASE)) for r in rules]
        return pd.Series([hits(t, [x for x in compiled if x[0].language in ("en", c)]) for t, c in zip(texts, codes, strict=True)])

    found = (lines if may is None else lines.where(may)).select("*", F.explode(match("text", code)).alias("hit"))
    return found.select(
        *lines.columns, "hit.kind", F.col("hit.text").alias("fragment"), "hit.rule", "hit.start", "hit.end", "hit.confidence",
        T.priority(F.col("hit.whole")).alias("priority"), T.due_date(F.col("hit.whole")).alias("due"),
    )


def one_rule(lines: DataFrame, name: str) -> DataFrame:
    """Hits of one rule with built-in functions alone: the columns of lines, kind, fragment, priority, due."""
    rule = next(r for r in RULES if r.name == name)
    whole = F.explode(F.regexp_extract_all("text", F.lit(T.FLAGS + rule.pattern), F.lit(0))).alias("whole")
    fragment = T.clean(F.regexp_extract("whole", T.FLAGS + rule.pattern.split("(?=")[0].replace("(.+?)", "(.+)"), 1))
    found = lines.where(F.col("text").rlike(T.FLAGS + rule.pattern)).select("*", whole)
    return found.select(*lines.columns, F.lit(rule.kind).alias("kind"), fragment.alias("fragment"), T.priority(F.col("whole")).alias("priority"), T.due_date(F.col("whole")).alias("due")).where(F.length("fragment") >= 3)


def stored(found: DataFrame) -> DataFrame:
    return found.where(F.col("kind").isin(*STORED))


def item_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]), 256), 1, 12)
