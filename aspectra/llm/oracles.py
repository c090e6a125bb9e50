"""DuckDB SQL for the queries that SQL can express, written from the results' definitions."""

from __future__ import annotations

from aspectra.llm import pii, secretscan


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, h, unnest(range(n - 99)) AS p FROM d WHERE n >= 100),
k AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS s FROM w),
r AS (SELECT doc_id, p FROM k QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1),
g AS (SELECT doc_id, p, p - coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -1000) > 100 AS begins FROM r),
n AS (SELECT doc_id, p, sum(begins::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g),
c AS (SELECT doc_id, min(p) AS s, max(p) + 100 AS e FROM n GROUP BY doc_id, run),
x AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS after FROM c),
a AS (SELECT x.doc_id, sum(e - s) AS gone, count(*) AS spans, max(e) AS last,
        string_agg(substr(h, 2 * after + 1, 2 * (s - after)), '' ORDER BY s) AS kept FROM x JOIN d USING (doc_id) GROUP BY x.doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)"""

_WORDS = (
    "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
)

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
q AS (SELECT item_id, w, least(len(w), 13) AS n FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1:i + n], ' ') AS s FROM (SELECT item_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM q)),
m AS (SELECT DISTINCT n FROM g),
o AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + n], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, m WHERE len(w) >= n)),
h AS (SELECT doc_id, n, i, item_id FROM o JOIN g USING (n, s)),
k AS (SELECT doc_id, count(DISTINCT j) AS hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM h GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(hit, 0) > 0 AND 20 * coalesce(hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN t USING (doc_id)"""


def _spans(pattern: str, last_group: int = 0) -> str:
    """List of {s, e, hit} of the matches of ``pattern`` in column t; ``hit`` is the last group if there is one."""
    p = _quoted(pattern)
    lengths = "list_transform({0}, lambda x: length(x))"
    pieces, hits = lengths.format(f"string_split_regex(t, {p})"), lengths.format(f"regexp_extract_all(t, {p})")
    return f"""list_transform(range(1, len(regexp_extract_all(t, {p})) + 1), lambda i:
      {{'s': list_sum({pieces}[1:i]) + coalesce(list_sum({hits}[1:i - 1]), 0),
        'e': list_sum({pieces}[1:i]) + list_sum({hits}[1:i]), 'hit': regexp_extract_all(t, {p}, {last_group})[i]}})"""


def _digest(base, found: str, ordered: str) -> str:
    """``found``: a query of doc_id and list ``f`` of {k, s, e}, in the order to print."""
    counts = ", ".join(f"len(list_filter(f, lambda x: x.k = '{k}'))::BIGINT AS n_{k}" for k in base)
    text = "array_to_string(list_transform({0}, lambda x: x.k || ':' || x.s || ':' || x.e), ',')"
    return f"""WITH f AS ({found})
SELECT doc_id, {counts}, sha256(coalesce({text.format(f"list_filter(f, lambda x: x.k IN ({', '.join(map(_quoted, base))}))")}, '')) AS base_sha256,
  coalesce({text.format('f')}, '') AS spans FROM (SELECT doc_id, {ordered} AS f FROM f)"""


def secret_scan() -> str:
    parts = []
    for i, r in enumerate(secretscan.RULES):
        groups = 2 if r.kind == "assign" else 0
        parts.append(f"list_transform(list_filter({_spans(r.pattern, groups)}, lambda x: length(x.hit) >= {r.least}), lambda x: {{'s': x.s::BIGINT, 'o': {i}, 'k': '{r.kind}', 'e': x.e::BIGINT}})")
    both = "list_concat(" * (len(parts) - 1) + parts[0] + "".join(f", {p})" for p in parts[1:])
    return _digest([r.kind for r in secretscan.BASE], f"SELECT doc_id, {both} AS g FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)", "list_sort(g)")


#: The proposals as the definition states them, and what a proposal x must pass.
_DIGITS = "regexp_replace(x.hit, '[^0-9]', '', 'g')"
_PLAIN = "replace(x.hit, ' ', '')"
_LUHN = f"""list_sum(list_transform(range(length({_DIGITS})), lambda j: CASE WHEN j % 2 = 0 THEN substr(reverse({_DIGITS}), j + 1, 1)::INT
  ELSE (2 * substr(reverse({_DIGITS}), j + 1, 1)::INT) // 10 + (2 * substr(reverse({_DIGITS}), j + 1, 1)::INT) % 10 END)) % 10 = 0"""
_MOD97 = f"""list_reduce(list_prepend(0, list_transform(string_split(substr({_PLAIN}, 5) || substr({_PLAIN}, 1, 4), ''), lambda c: CASE WHEN ascii(c) >= 65 THEN ascii(c) - 55 + 100 ELSE ascii(c) - 48 END)),
  lambda a, v: CASE WHEN v >= 100 THEN (a * 100 + v - 100) % 97 ELSE (a * 10 + v) % 97 END) = 1"""
_PASSES = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(x.hit, '.'), lambda y: y::HUGEINT > 255)) = 0"),
    "card": (r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
}


def personal_data() -> str:
    """The base kinds.  The engine has no look-around for the kinds that the method adds; the tests cover them, and the
    driver's tables hold none."""
    parts = [
        f"list_transform(list_filter({_spans(p)}, lambda x: {test}), lambda x: {{'o': {i}, 's': x.s::BIGINT, 'e': x.e::BIGINT, 'k': '{kind}'}})"
        for i, (kind, (p, test)) in enumerate(_PASSES.items())
    ]
    both = "list_concat(" * (len(parts) - 1) + parts[0] + "".join(f", {p})" for p in parts[1:])
    return _digest(list(pii.BASE), f"SELECT doc_id, {both} AS g FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)", "g")
