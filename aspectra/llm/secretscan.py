"""Secret scan with a trigram inverted index.

Every rule's regular expression is turned into a Boolean query over trigrams
that each of its matches must hold.  Documents are indexed by the trigrams that
some rule asks for; a rule's candidates are the documents whose postings hold
all trigrams of one of its alternatives, and only these are verified with the
expression itself.  A rule without mandatory trigrams scans every document.
The index is over lower-cased texts, so it can only name too many documents.
"""

from __future__ import annotations

import re._constants as op
import re._parser as regex_parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aspectra.llm.common import let, spans


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Characters that a match, or its last group if it has groups, must have at least.
    least: int = 0


#: Fixed patterns; the first three are the base rules.  Their runs of one class are maximal, so a run that is too short
#: holds no later match and its length can stand in the pattern.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
RULES = (
    *BASE,
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hosting_token", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
)

#: A class or product of alternatives larger than this ends a literal run.
SPELLED = 64


def _grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


#: One way to match: literal text at its end, trigrams of what stands before, whether that text begins after something open.
Way = tuple[str, frozenset[str], bool]


def _closed(ways: list[Way]) -> list[Way]:
    """Nothing that follows is next to the literal text any more."""
    return list(dict.fromkeys(("", g | _grams(t), True) for t, g, _ in ways))


def _then(ways: list[Way], more: list[Way]) -> list[Way]:
    if len(ways) * len(more) > SPELLED:
        ways = _closed(ways)
    both = [(t2, g | _grams(t) | g2, True) if open2 else (t + t2, g | g2, is_open) for (t, g, is_open), (t2, g2, open2) in product(ways, more)]
    return list(dict.fromkeys(both))


def _ways(tree) -> list[Way]:
    """The ways to match a parsed expression; what it may hold beside their literals is left out."""
    found: list[Way] = [("", frozenset(), False)]
    for kind, value in tree:
        if kind is op.LITERAL:
            found = _then(found, [(chr(value).lower(), frozenset(), False)])
        elif kind is op.IN and len(value) <= SPELLED and all(k is op.LITERAL for k, _ in value):
            found = _then(found, [(chr(v).lower(), frozenset(), False) for _, v in value])
        elif kind is op.SUBPATTERN:
            found = _then(found, _ways(value[-1]))
        elif kind is op.BRANCH:
            found = _then(found, [w for branch in value[1] for w in _ways(branch)])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and tuple(value[:2]) == (0, 1):
            found = _then(found, [("", frozenset(), False), *_ways(value[2])])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] >= 1:
            found = _closed(_then(found, _ways(value[2])))
        elif kind is not op.AT:
            found = _closed(found)
    return found


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """A match of ``pattern`` holds all trigrams of at least one of these sets; None if some match may hold none.

    >>> trigram_query("ab[a-z]+cd") is None
    True
    >>> sorted(map(sorted, trigram_query("abc|xyz+")))
    [['abc'], ['xyz']]
    """
    sets = {g | _grams(t) for t, g, _ in _ways(regex_parser.parse(pattern))}
    if frozenset() in sets:
        return None
    return sorted((s for s in sets if not any(o < s for o in sets)), key=sorted)


def row_key() -> Column:
    """Names a row by id and text; rows that share it only share candidates, which are verified."""
    return F.xxhash64("doc_id", "text")


def postings(rows: DataFrame, grams: list[str]) -> DataFrame:
    """The inverted index: ``gram, key`` for each of ``grams`` that a row's lower-cased text holds."""
    held = let(F.lower("text"), lambda low: F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains(low, g)))
    return rows.select(row_key().alias("key"), F.explode(held).alias("gram"))


def candidates(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``key, kinds``: the rules whose query a row's postings satisfy."""
    asked = {r.kind: trigram_query(r.pattern) for r in rules}
    wanted = [(kind, i, gram, len(s)) for kind, sets in asked.items() for i, s in enumerate(sets or []) for gram in sorted(s)]
    spark = rows.sparkSession
    if not wanted:
        return spark.createDataFrame([], "key long, kinds array<string>")
    queries = spark.createDataFrame(wanted, "kind string, alternative int, gram string, needed int")
    index = postings(rows, sorted({w[2] for w in wanted}))
    # queries hold one row per trigram of the rules; a key and alternative get one row per task before the shuffle
    met = (
        index.join(F.broadcast(queries), "gram").groupBy("key", "kind", "alternative")
        .agg(F.collect_set("gram").alias("grams"), F.first("needed").alias("needed"))
        .where(F.size("grams") == F.col("needed"))
    )
    return met.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def _found(rule: Rule) -> Column:
    text = F.col("text")
    hits = spans(text, rule.pattern)
    groups = regex_parser.parse(rule.pattern).state.groups - 1
    if groups:
        last = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(groups))
        hits = F.zip_with(hits, last, lambda x, g: F.struct(x["start"].alias("start"), x["end"].alias("end"), g.alias("hit")))
    kept = F.filter(hits, lambda x: F.length(x["hit"]) >= rule.least)
    return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(rule.kind).alias("kind"), x["end"].alias("end")))


def scanned(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Adds ``spans`` to rows with ``doc_id`` and a ``text`` that is not null."""
    named = rows.withColumn("key", row_key()).join(candidates(rows, rules), "key", "left")
    none = F.expr("cast(array() as array<struct<start:int,kind:string,end:int>>)")
    cols = {}
    for r in rules:
        hits = _found(r)
        cols[f"hits_{r.kind}"] = hits if trigram_query(r.pattern) is None else F.when(F.array_contains("kinds", r.kind), hits).otherwise(none)
    order = F.array(*(F.lit(r.kind) for r in rules))

    def by_start(a, b):
        return F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise((F.array_position(order, a["kind"]) - F.array_position(order, b["kind"])).cast("int"))

    return named.withColumns(cols).select(*rows.columns, F.array_sort(F.concat(*(F.col(c) for c in cols)), by_start).alias("spans"))


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, spans`` per row of ``docs``; ``spans`` is an array of start, kind, end in code points, end exclusive.

    Spans are ordered by start, then by the rules' order.  Per rule they are the
    leftmost non-overlapping matches that are long enough.  A null text is
    empty.  Null ids and repeated rows are scanned like any other row; extra
    columns are ignored.
    """
    return scanned(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), rules)


def redact(text: Column, found: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; a span inside another goes with it."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        kept = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), x["kind"], F.lit("]"))
        return F.when(x["start"] >= acc["at"], F.struct(x["end"].alias("at"), kept.alias("out"))).otherwise(
            F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out"))
        )

    return F.aggregate(found, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` (the columns of documents) with every span replaced in ``text`` and ``n_chars`` counted again; null texts stay null."""
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("text").isNull().alias("no_text"), F.struct(*(F.col(f"`{c}`") for c in rest)).alias("rest"))
    found = scanned(rows, rules).withColumn("clean", F.when(F.size("spans") > 0, redact(F.col("text"), F.col("spans"))).otherwise(F.col("text")))
    new = {"text": F.when(~F.col("no_text"), F.col("clean")), "n_chars": F.when(F.size("spans") > 0, F.length("clean").cast("long")).otherwise(F.col("rest.n_chars"))}
    return found.select(*(new.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns))
