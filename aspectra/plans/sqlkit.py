"""Small helpers to write the DuckDB oracle SQL (independent of the Spark code)."""

from __future__ import annotations

from collections.abc import Iterable


def q(s: str) -> str:
    return "'" + str(s).replace("'", "''") + "'"


def in_list(expr: str, words: Iterable[str]) -> str:
    ws = sorted(set(words))
    if not ws:
        return "FALSE"
    return f"({expr} IN ({', '.join(q(w) for w in ws)}))"


def values(rows, cols: list[str], alias: str = "t") -> str:
    """(VALUES ...) AS t(cols) for literal parameter tables."""
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, (int, float)):
            return repr(v)
        return q(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS {alias}({', '.join(cols)})"


def clean_words(x: str) -> str:
    """T3 in SQL."""
    return (f"CASE WHEN {x} IS NULL OR {x} = '' OR lower({x}) = 'nan' THEN '' ELSE "
            f"trim(regexp_replace(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_\\s\\-]', ' ', 'g'), "
            f"'[\\s\\-]+', ' ', 'g')) END")


def valid_word(w: str, stop, irrelevant) -> str:
    return (f"(length({w}) >= 2 AND NOT {in_list(w, stop)} AND NOT {in_list(w, irrelevant)} "
            f"AND NOT regexp_full_match({w}, '[0-9]+') "
            f"AND length(regexp_replace({w}, '[^0-9]', '', 'g')) * 2 <= length({w}))")


CATALOG_TEXT = "lower(p_type || ' ' || p_name)"
