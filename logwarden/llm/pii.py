"""Personal data in text: proposed by patterns, confirmed by checksums, scored by context.

DataFrame functions only.  Patterns start at the first character of a run (or where
the last match ended) and use possessive repeats, so that long runs cost linear time
and no deep recursion; the matches are those of the plain patterns.

Kinds: ``email ip card phone`` (base) and ``iban ssn`` (added).  A span's score is the
kind's base score, plus 0.15 if a checksum confirmed it, plus 0.25 if a word that
announces the kind stands in the 40 characters before it, less 0.3 if a word that
denies it does; kept within 0 to 1.  Base spans are always kept, added ones from
``min_score`` on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import set_aside

# Kinds in their order, patterns, prior scores and context words.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
}
#: What a text must hold for the kind's pattern to be tried at all.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.6, "phone": 0.6, "iban": 0.7, "ssn": 0.4}
CONTEXT = {
    "email": "mail|e-mail|contact|kontakt|correo|courriel",
    "ip": "ip|address|host|server|adresse|direcci",
    "card": "card|visa|mastercard|credit|karte|tarjeta|carte",
    "phone": "phone|call|tel|mobile|fax|telefon|tel[eé]fono",
    "iban": "iban|account|bank|konto|cuenta|compte",
    "ssn": "ssn|social|security|tax",
}
DENIAL = "version|release|isbn|serial|order|example"
CHECKED = ("card", "iban")
REACH = 40
MIN_SCORE = 0.5
ITEM = "struct<kind:string,ord:int,start:long,stop:long,score:double,value:string>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if a text of at most 19 digits passes the Luhn check."""
    padded = F.lpad(digits, 20, "0")
    total = F.lit(0)
    for i in range(20):
        d = F.substring(padded, i + 1, 1).cast("int")
        total = total + (d if i % 2 else F.when(d > 4, 2 * d - 9).otherwise(2 * d))
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """True if an account number without spaces has remainder 1 modulo 97 (letters count 10 to 35, first four characters last)."""
    turned = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))
    value = lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda rest, c: (rest * F.when(c.rlike("^[0-9]$"), 10).otherwise(100) + value(c)) % 97
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(match, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    if kind == "card":
        return F.length(_digits(match)).between(14, 19) & luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    if kind == "iban":
        return mod97(F.replace(match, F.lit(" "), F.lit("")))
    if kind == "ssn":
        return ~match.rlike("^(000|666|9)|-00-|-0000$")
    return F.lit(True)


def _score(kind: str, before: Column) -> Column:
    near = F.lower(before)
    score = F.lit(PRIOR[kind] + 0.15 * (kind in CHECKED))
    score = score + F.when(near.rlike(rf"\b(?:{CONTEXT[kind]})"), 0.25).otherwise(0.0) - F.when(near.rlike(rf"\b(?:{DENIAL})\b"), 0.3).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4)


def _spans(kind: str, text: Column) -> Column:
    """Valid spans of one kind: array of (kind, order, start, stop, score, value); code points, end exclusive.

    The pieces between the matches and the matches themselves give the offsets.
    """
    pattern = F.lit(PATTERNS[kind])
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    pieces = F.split(text, PATTERNS[kind], -1)
    empty = F.lit(None).cast("array<struct<piece:string,value:string>>")
    zipped = F.transform(found, lambda m, i: F.struct(F.get(pieces, i).alias("piece"), m.alias("value")))
    grow = lambda acc, x: F.struct(
        (acc["at"] + F.length(x["piece"]) + F.length(x["value"])).cast("long").alias("at"),
        F.concat(
            acc["out"],
            F.when(
                _valid(kind, x["value"]),
                F.array(
                    F.struct(
                        F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).alias("ord"), (acc["at"] + F.length(x["piece"])).cast("long").alias("start"),
                        (acc["at"] + F.length(x["piece"]) + F.length(x["value"])).cast("long").alias("stop"), F.lit(0.0).alias("score"), x["value"].alias("value"),
                    ).cast(ITEM)
                ),
            ).otherwise(F.array().cast(f"array<{ITEM}>")),
        ).alias("out"),
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{ITEM}>").alias("out"))
    return F.aggregate(F.coalesce(zipped, empty, F.array().cast("array<struct<piece:string,value:string>>")), start, grow)["out"]


def _scorer(kind: str, body: Column):
    """Puts the score, by what stands before the span in ``body``, into a span."""

    def scored(s: Column) -> Column:
        lead = s["start"].cast("int")
        before = F.substring(body, F.greatest(F.lit(1), lead + 1 - REACH), F.least(F.lit(REACH), lead))
        return F.struct(*(s[c].alias(c) for c in ("kind", "ord", "start", "stop")), _score(kind, before).alias("score"), s["value"].alias("value"))

    return scored


def find(docs: DataFrame, text: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` with ``pii``: the spans of all kinds by start, then kind, as (kind, ord, start, stop, score, value).

    Null text is empty; repeated rows give repeated results; other columns pass through, unless they are named ``pii``,
    which is replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    held = []
    for kind in KINDS:
        guard = F.contains(body, F.lit(NEEDS[kind])) if kind in NEEDS else body.rlike("[0-9][0-9]" if kind == "iban" else "[0-9][ -]?[0-9]")
        scored = F.transform(_spans(kind, body), _scorer(kind, body))
        if kind not in BASE:
            scored = F.filter(scored, lambda s: s["score"] >= min_score)
        held.append(F.when(guard, scored).otherwise(F.array().cast(f"array<{ITEM}>")))
    by = lambda a, b: F.when((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["ord"] < b["ord"])), -1).when((a["start"] == b["start"]) & (a["ord"] == b["ord"]), 0).otherwise(1)
    return docs.withColumn("pii", F.array_sort(F.concat(*held), by))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def redact(docs: DataFrame, text: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` with every found span replaced by ``<KIND>``; of overlapping spans the union goes, named by the first.

    Null texts stay null.  The columns are those of ``docs``, whatever their names.
    """
    plain = set_aside(docs, text)
    found = find(plain.withColumn("_body", F.col(text)), "_body", min_score)
    step = lambda acc, s: F.struct(
        F.greatest(acc["at"], s["stop"]).alias("at"),
        F.concat(
            acc["out"],
            F.when(s["start"] >= acc["at"], F.array(F.concat(F.substring(F.col("_body"), acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit("<"), F.upper(s["kind"]), F.lit(">")))).otherwise(F.array().cast("array<string>")),
        ).alias("out"),
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate("pii", start, step)
    clean = F.concat(F.array_join(done["out"], ""), F.substring(F.col("_body"), done["at"].cast("int") + 1, F.length("_body")))
    out = found.withColumn(text, F.when(F.size("pii") > 0, clean).otherwise(F.col("_body")))
    return out.select(*plain.columns).toDF(*docs.columns)
