"""Personal data: patterns propose spans, checksums confirm them, context words adjust their scores.

All of it is column expressions on the row that holds the text: no shuffle, no
Python.  Patterns are written so that the regular-expression engine neither
recurses nor re-scans a run: separators that may stand inside a match are first
replaced, one for one, by a private-use character, which turns a repeated group
into one character class and keeps every position.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aspectra.llm.common import spans

#: Stands for a separator inside a match; where a text holds it, ``FREED`` stands for it, which is in no class of any pattern either.
MARK, FREED = "", ""
#: Kinds that every result holds if they match; the others need ``threshold``.
BASE = ("email", "ip", "card", "phone")
#: Characters before and after a span in which context words count.
NEARBY = 40


@dataclass(frozen=True)
class Kind:
    name: str
    #: A cheap test that every text with a match passes.
    hint: str
    #: Separators to replace by MARK; none if empty.
    joined: str
    pattern: str
    score: float
    boost: float
    context: str


#: Fixed patterns: the first four as the base rules state them, in their linear form.
KINDS = (
    Kind("email", "@", r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])",
         rf"(?:\G|(?<![A-Za-z0-9._%+{MARK}-]))[A-Za-z0-9._%+{MARK}-]++@[A-Za-z0-9-]++{MARK}[A-Za-z0-9{MARK}-]++", 0.8, 0.2, "mail|contact|address|kontakt|correo"),
    Kind("ip", r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, 0.3, "ip|host|server|address|login"),
    Kind("card", r"[0-9][0-9 -]{11,}[0-9]", r"(?<=[0-9])[ -](?=[0-9])", rf"[0-9][0-9{MARK}]{{12,}}", 0.7, 0.3, "card|visa|credit|payment|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9]", "", r"\+[0-9][ ().0-9-]+[0-9]", 0.6, 0.3, "phone|call|tel|mobile|fax|telefon"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}[ A-Z0-9]", "",
         r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])", 0.8, 0.2, "iban|bank|account|konto|compte|cuenta"),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3, 0.4, "ssn|social security|tax id|taxpayer"),
)


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def mod97(hit: Column) -> Column:
    """Remainder of an account number: its first four characters go last, letters count from 10."""
    plain = F.replace(hit, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, 5, 34), F.substring(plain, 1, 4))

    def step(acc, c):
        letter = F.ascii(c) - 55
        return F.when(F.ascii(c) >= 65, (acc * 100 + letter) % 97).otherwise((acc * 10 + F.ascii(c) - 48) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), step)


def confirmed(kind: str, hit: Column) -> Column:
    """Whether a proposed span passes its kind's checks."""
    n = F.length(digits(hit))
    if kind == "ip":
        parts = F.transform(F.split(hit, r"\."), lambda x: F.regexp_replace(x, "^0+", ""))
        return F.forall(parts, lambda x: (F.length(x) < 3) | ((F.length(x) == 3) & (x <= "255")))
    if kind == "card":
        return n.between(13, 19) & F.call_function("luhn_check", digits(hit))
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        return F.length(F.replace(hit, F.lit(" "), F.lit(""))).between(15, 34) & (mod97(hit) == 1)
    if kind == "ssn":
        area = F.substring(hit, 1, 3)
        return ~area.isin("000", "666") & (area < "900") & (F.substring(hit, 5, 2) != "00") & (F.substring(hit, 8, 4) != "0000")
    return F.lit(True)


def _found(kind: Kind, threshold: float) -> Column:
    """The kind's confirmed spans in columns ``text`` and, with separators replaced, ``text_<kind>``."""
    text = F.col(f"text_{kind.name}" if kind.joined else "text")

    def scored(x):
        before = F.substring(F.col("text"), F.greatest(x["start"] - NEARBY, F.lit(0)) + 1, F.least(x["start"], F.lit(NEARBY)))
        after = F.substring(F.col("text"), x["end"] + 1, F.lit(NEARBY))
        near = F.lower(F.concat(before, F.lit(" "), after)).rlike(rf"\b(?:{kind.context})")
        score = F.lit(kind.score) + F.when(near, F.lit(kind.boost)).otherwise(F.lit(0.0))
        return F.struct(F.lit(kind.name).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), score.alias("score"))

    hits = F.transform(F.filter(spans(text, kind.pattern), lambda x: confirmed(kind.name, x["hit"])), scored)
    if kind.name not in BASE:
        hits = F.filter(hits, lambda x: x["score"] >= threshold)
    return F.when(F.col("text").rlike(kind.hint), hits).otherwise(F.expr("cast(array() as array<struct<kind:string,start:int,end:int,score:double>>)"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``doc_id, text, spans`` per row of ``docs``; ``spans`` is an array of kind, start, end (code points, end exclusive) and score.

    Spans are ordered by kind (email, ip, card, phone, iban, ssn), then start.
    Spans of the base kinds stay whatever their score; an account number needs a
    right mod-97 remainder, a social-security number the words around it that
    lift its score to ``threshold``.  A null text is empty.  Null ids and
    repeated rows are scanned like any other row; extra columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    for k in KINDS:
        if k.joined:
            marked = F.regexp_replace(F.translate("text", MARK, FREED), k.joined, MARK)
            rows = rows.withColumn(f"text_{k.name}", F.when(F.col("text").rlike(k.hint), marked).otherwise(F.lit("")))
    rows = rows.withColumns({k.name: _found(k, threshold) for k in KINDS})
    return rows.select("doc_id", "text", F.concat(*(F.col(k.name) for k in KINDS)).alias("spans"))


def redact(found: DataFrame) -> DataFrame:
    """Adds ``redacted``: the text with every span of ``find`` replaced by its kind in brackets."""
    cuts = F.array_sort(F.col("spans"), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        kept = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), x["kind"], F.lit("]"))
        return F.when(x["start"] >= acc["at"], F.struct(x["end"].alias("at"), kept.alias("out"))).otherwise(
            F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out"))
        )

    whole = F.aggregate(cuts, start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return found.withColumn("redacted", whole)
