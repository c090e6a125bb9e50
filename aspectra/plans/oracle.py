"""DuckDB oracle SQL, one statement per registered query (written independently of
the Spark code; only the fixed word lists are shared)."""

from __future__ import annotations

from aspectra import lexicons as L
from aspectra.plans import fixtures as FX
from aspectra.plans.sqlkit import CATALOG_TEXT, clean_words, in_list, q, valid_word, values

ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


# ---------------------------------------------------------------------------
# N
# ---------------------------------------------------------------------------

_NG_TOKENS = f"""
r AS (SELECT p_partkey AS review_key, {clean_words(CATALOG_TEXT)} AS t FROM part),
tk AS (
  SELECT review_key, w, pos - 1 AS pos,
         {valid_word('w', L.NGRAM_STOPWORDS, ())} AS v,
         {in_list('w', FX.FX_ADJECTIVES)} AS a, {in_list('w', FX.FX_NOUNS)} AS n
  FROM (SELECT review_key, unnest(string_split(t, ' ')) AS w,
               generate_subscripts(string_split(t, ' '), 1) AS pos FROM r WHERE t <> '') s
),
uni AS (SELECT review_key, pos, w AS keyword FROM tk WHERE v AND (a OR n)),
bi AS (SELECT t1.review_key, t1.pos, t1.w || ' ' || t2.w AS keyword
       FROM tk t1 JOIN tk t2 ON t1.review_key = t2.review_key AND t2.pos = t1.pos + 1
       WHERE t1.v AND t2.v AND (t1.a OR t1.n) AND t2.n),
tri AS (SELECT t1.review_key, t1.pos, t1.w || ' ' || t2.w || ' ' || t3.w AS keyword
        FROM tk t1 JOIN tk t2 ON t1.review_key = t2.review_key AND t2.pos = t1.pos + 1
                   JOIN tk t3 ON t1.review_key = t3.review_key AND t3.pos = t1.pos + 2
        WHERE t1.v AND t2.v AND t3.v AND t1.a AND (t2.a OR t2.n) AND t3.n),
occ AS (SELECT review_key, 'unigrams' AS ngram_type, 1 AS type_rank, pos, keyword FROM uni
        UNION ALL SELECT review_key, 'bigrams', 2, pos, keyword FROM bi
        UNION ALL SELECT review_key, 'trigrams', 3, pos, keyword FROM tri),
cnt AS (SELECT ngram_type, type_rank, keyword, count(*) AS frequency,
               min(review_key * 1000000 + pos) AS first_seen
        FROM occ GROUP BY ngram_type, type_rank, keyword HAVING count(*) >= 2)"""


def _category_case(col: str) -> tuple[str, str]:
    cat = "CASE"
    rank = "CASE"
    for r, (name, ws) in enumerate(FX.FX_CATEGORIES, start=1):
        cond = " OR ".join(f"contains(lower({col}), {q(w)})" for w in ws.split())
        cat += f" WHEN {cond} THEN {q(name)}"
        rank += f" WHEN {cond} THEN {r}"
    cat += f" ELSE {q(L.DEFAULT_CATEGORY)} END"
    rank += f" ELSE {len(FX.FX_CATEGORIES) + 1} END"
    return cat, rank


_CAT, _CATRANK = _category_case("keyword")

_NG_REPORT = f"""WITH {_NG_TOKENS},
cat AS (SELECT *, {_CAT} AS category, CAST({_CATRANK} AS BIGINT) AS category_rank FROM cnt),
rep AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY frequency DESC, type_rank, first_seen)
                  AS rank_in_category FROM cat)"""

oracle("ng_valid_words", f"""
WITH d AS (SELECT {clean_words('text')} AS t FROM documents),
w AS (SELECT unnest(CASE WHEN t = '' THEN []::VARCHAR[] ELSE string_split(t, ' ') END) AS word FROM d)
SELECT word, {valid_word('word', L.NGRAM_STOPWORDS, L.IRRELEVANT_WORDS)} AS is_valid, count(*) AS n
FROM w GROUP BY ALL""")

oracle("ng_unigrams", f"WITH {_NG_TOKENS} SELECT review_key, pos, keyword FROM uni")
oracle("ng_bigrams", f"WITH {_NG_TOKENS} SELECT review_key, pos, keyword FROM bi")
oracle("ng_trigrams", f"WITH {_NG_TOKENS} SELECT review_key, pos, keyword FROM tri")
oracle("ng_counts_min2", f"WITH {_NG_TOKENS} SELECT ngram_type, keyword, frequency FROM cnt")
oracle("ng_categorize", f"WITH {_NG_TOKENS} SELECT ngram_type, keyword, frequency, {_CAT} AS category FROM cnt")
oracle("ng_report", f"""{_NG_REPORT}
SELECT category, keyword, ngram_type, frequency, category_rank, rank_in_category FROM rep""")
oracle("ng_top3", f"""{_NG_REPORT}
SELECT category, count(*) OVER (PARTITION BY category) AS n_keywords, rank_in_category, keyword, frequency
FROM rep QUALIFY rank_in_category <= 3""")


# ---------------------------------------------------------------------------
# T1–T7
# ---------------------------------------------------------------------------
from aspectra.functions.text import SYMBOLS  # noqa: E402

NORM = "lower(trim(regexp_replace({x}, '\\s+', ' ', 'g')))"


def norm(x: str) -> str:
    return NORM.format(x=x)


oracle("txt_normalize", f"SELECT doc_id AS review_key, {norm('text')} AS normalized_text FROM documents")
oracle("txt_normalize_light", """SELECT doc_id AS review_key,
  trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s.,!?]', ' ', 'g'), '\\s+', ' ', 'g')) AS light_text
FROM documents""")
oracle("txt_clean_words", f"SELECT doc_id AS review_key, {clean_words('text')} AS clean_text FROM documents")
oracle("txt_symbol_cleanup", f"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  html, '{SYMBOLS}', '. ', 'g'), '\\+{{2,}}', '. ', 'g'), '\\x{{2026}}+', '. ', 'g'), '\\s+', ' ', 'g')) AS clean_html
FROM pages""")


def _lang_case(text_expr: str) -> str:
    langs = sorted(FX.FX_LANG_STOPWORDS)
    scores = {lg: f"len(list_filter(regexp_extract_all(lower({text_expr}), '\\p{{L}}+'), lambda t: "
                  f"{in_list('t', FX.FX_LANG_STOPWORDS[lg].split())}))" for lg in langs}
    g = "greatest(" + ", ".join(scores.values()) + ")"
    case = f"CASE WHEN {g} = 0 THEN 'en'"
    for lg in langs:
        case += f" WHEN {scores[lg]} = {g} THEN {q(lg)}"
    return case + " END"


def _clean_tokens(text_expr: str) -> str:
    return (f"list_filter(list_transform(string_split({text_expr}, ' '), "
            f"lambda t: lower(regexp_replace(t, '[^a-zA-Z]+', '', 'g'))), "
            f"lambda t: length(t) >= 3 AND NOT {in_list('t', L.ENGLISH_STOPWORDS)} "
            f"AND NOT {in_list('t', L.IRRELEVANT_WORDS)})")


oracle("lang_detect", f"SELECT doc_id AS review_key, lang, {_lang_case('text')} AS lang_detected FROM documents")
oracle("lang_filter_en", f"SELECT doc_id AS review_key, source AS organization_id FROM documents "
                         f"WHERE {_lang_case('text')} = 'en'")
oracle("tok_clean", f"""SELECT doc_id AS review_key, array_to_string(tk, ' ') AS tokens, CAST(len(tk) AS BIGINT) AS n_tokens
FROM (SELECT doc_id, {_clean_tokens(norm('text'))} AS tk FROM documents)""")
oracle("txt_skip_counts", f"""
WITH d AS (SELECT {norm("coalesce(text, '')")} AS nt FROM documents),
s AS (SELECT CASE WHEN nt = '' THEN 'empty' WHEN {_lang_case('nt')} <> 'en' THEN 'language'
                  WHEN len({_clean_tokens('nt')}) = 0 THEN 'no_tokens' END AS skip FROM d)
SELECT count(*) AS n_rows, count(*) FILTER (WHERE skip IN ('empty', 'no_tokens')) AS skipped_empty,
       count(*) FILTER (WHERE skip = 'language') AS skipped_language, count(*) FILTER (WHERE skip IS NULL) AS ingested
FROM s""")

# ---------------------------------------------------------------------------
# S
# ---------------------------------------------------------------------------
oracle("src_reviews", "SELECT source AS source_id, coalesce(text, '') AS text FROM documents")
oracle("src_row_ids", "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_pos, coalesce(text, '') AS text FROM documents")
oracle("src_nonnull_reviews", "SELECT CAST(doc_id AS VARCHAR) AS REVIEW_ID, NULL::VARCHAR AS ORGANIZATION_ID, text "
                              "FROM documents WHERE text IS NOT NULL")
oracle("src_text_fallback", """SELECT conv_id, turn, picked AS text FROM (
  SELECT conv_id, turn, coalesce(nullif(CASE WHEN role = 'user' THEN text ELSE '' END, ''),
                                 nullif(CASE WHEN role = 'assistant' THEN text END, ''), '') AS picked
  FROM conversations) WHERE regexp_matches(picked, '\\S')""")
oracle("dim_mapping", """
WITH m AS (SELECT lower(trim(CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE ' ' || p_name || ' ' END)) AS keyword,
                  p_partkey AS pos, p_partkey AS KPI_ID, p_brand AS KPI_NAME, CAST(p_size AS BIGINT) AS DEPARTMENT_ID,
                  p_type AS DEPARTMENT_NAME FROM part)
SELECT keyword, min(pos) AS pos, arg_max(KPI_ID, pos) AS KPI_ID, arg_max(KPI_NAME, pos) AS KPI_NAME,
       arg_max(DEPARTMENT_ID, pos) AS DEPARTMENT_ID, arg_max(DEPARTMENT_NAME, pos) AS DEPARTMENT_NAME
FROM m GROUP BY keyword""")
oracle("dim_label_list", "SELECT n_name AS label, row_number() OVER (ORDER BY n_nationkey) - 1 AS pos FROM nation "
                         "WHERE n_name IS NOT NULL AND n_regionkey IS NOT NULL")
oracle("sink_csv_roundtrip", f"""{_NG_REPORT}
SELECT category AS Category, keyword AS Keyword, ngram_type AS Type, frequency AS Frequency FROM rep""")
oracle("run_serial", """
WITH n AS (SELECT CASE WHEN lang = 'en' THEN CAST(n_chars AS VARCHAR) || '_keywords.json'
                       ELSE source || '_keywords.json' END AS name FROM documents),
m AS (SELECT max(CAST(regexp_extract(name, '^(\\d+)_keywords\\.json$', 1) AS BIGINT)) AS m FROM n
      WHERE regexp_extract(name, '^(\\d+)_keywords\\.json$', 1) <> '')
SELECT CAST(CASE WHEN m IS NULL THEN 4 ELSE greatest(m, 3) + 1 END AS BIGINT) AS next_serial,
       CAST(CASE WHEN m IS NULL THEN 4 ELSE greatest(m, 3) + 1 END AS VARCHAR) || '_keywords.json' AS next_name FROM m""")

# ---------------------------------------------------------------------------
# E2–E9
# ---------------------------------------------------------------------------


def _probs(k: int) -> str:
    return f"""(SELECT vec_id, list_transform(e, lambda v: v / list_sum(e)) AS p FROM (
  SELECT vec_id, list_transform(x, lambda v: exp(v - list_max(x))) AS e FROM (
    SELECT vec_id, CAST(embedding[1:{k}] AS DOUBLE[]) AS x FROM embeddings)))"""


oracle("sent_softmax", f"""SELECT vec_id, CAST(list_position(p, list_max(p)) - 1 AS BIGINT) AS pred_idx,
  round(list_max(p), 6) AS confidence FROM {_probs(5)}""")
oracle("sent_stars5", f"""SELECT vec_id, stars, CASE WHEN stars <= 2 THEN 'Negative' WHEN stars = 3 THEN 'Neutral'
  ELSE 'Positive' END AS label, confidence FROM (
  SELECT vec_id, CAST(list_position(p, list_max(p)) AS BIGINT) AS stars, round(list_max(p), 6) AS confidence
  FROM {_probs(5)})""")
oracle("sent_class3", f"""SELECT vec_id, stars, CASE stars WHEN 1 THEN 'Negative' WHEN 2 THEN 'Neutral'
  ELSE 'Positive' END AS label, confidence FROM (
  SELECT vec_id, CAST(list_position(p, list_max(p)) AS BIGINT) AS stars, round(list_max(p), 6) AS confidence
  FROM {_probs(3)})""")
oracle("sent_label_names", """SELECT event_id, pred_idx, label,
  CAST(CASE label WHEN 'Negative' THEN 1 WHEN 'Neutral' THEN 2 ELSE 3 END AS BIGINT) AS stars FROM (
  SELECT event_id, pred_idx, CASE WHEN contains(lower(raw), 'neg') THEN 'Negative'
    WHEN contains(lower(raw), 'neu') THEN 'Neutral' WHEN contains(lower(raw), 'pos') THEN 'Positive'
    ELSE coalesce(CASE pred_idx WHEN 0 THEN 'Negative' WHEN 1 THEN 'Neutral' WHEN 2 THEN 'Positive' END, 'Neutral') END AS label
  FROM (SELECT event_id, pred_idx, CASE pred_idx WHEN 0 THEN 'LABEL_0' WHEN 1 THEN 'neg' WHEN 2 THEN 'POSITIVE'
                                    ELSE CAST(pred_idx AS VARCHAR) END AS raw
        FROM (SELECT event_id, CAST(floor(value) AS BIGINT) % 4 AS pred_idx FROM events)))""")

ASPECT_SCORES = """(SELECT user_id AS review_id, event_id // 400 AS review_part, event_id AS pos,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 'Positive' WHEN event_type = 'error' THEN 'Negative'
       ELSE 'Neutral' END AS label,
  round(least(value, 500.0) * 2) / 1000 AS confidence FROM events)"""

_VOTE = f"""
g AS (SELECT review_id, review_part, count(*) AS n,
        count(*) FILTER (WHERE label = 'Positive') AS npos, count(*) FILTER (WHERE label = 'Negative') AS nneg,
        count(*) FILTER (WHERE label = 'Neutral') AS nneu,
        CAST(sum(CASE WHEN label = 'Positive' THEN CAST(round(confidence * 1000) AS BIGINT) ELSE 0 END) AS BIGINT) AS spos,
        CAST(sum(CASE WHEN label = 'Negative' THEN CAST(round(confidence * 1000) AS BIGINT) ELSE 0 END) AS BIGINT) AS sneg
      FROM {ASPECT_SCORES} GROUP BY review_id, review_part),
h AS (SELECT *, (npos + nneg) * 5 >= n * 3 AS polar FROM g),
w AS (SELECT *, CASE WHEN polar THEN greatest(npos, nneg) ELSE greatest(npos, nneg, nneu) END AS mx FROM h),
x AS (SELECT *, npos = mx AS wpos, nneg = mx AS wneg, (NOT polar AND nneu = mx) AS wneu,
             spos * nneg AS lhs, sneg * npos AS rhs FROM w),
v AS (SELECT review_id, review_part, n AS n_aspects,
  CASE WHEN wpos::INT + wneg::INT + wneu::INT = 1 THEN CASE WHEN wpos THEN 'Positive' WHEN wneg THEN 'Negative' ELSE 'Neutral' END
       WHEN wpos AND wneg AND NOT wneu THEN CASE WHEN lhs > rhs THEN 'Positive' WHEN rhs > lhs THEN 'Negative' ELSE 'Neutral' END
       ELSE 'Neutral' END AS review_sentiment,
  CASE WHEN wpos::INT + wneg::INT + wneu::INT = 1 THEN 1.0
       WHEN wpos AND wneg AND NOT wneu THEN CASE WHEN lhs > rhs THEN ((2 * spos + npos) // (2 * npos)) / 1000.0
                                                 WHEN rhs > lhs THEN ((2 * sneg + nneg) // (2 * nneg)) / 1000.0 ELSE 0.5 END
       ELSE 0.5 END::DOUBLE AS review_confidence FROM x)"""

oracle("sent_vote_majority", f"WITH {_VOTE} SELECT * FROM v")
oracle("sent_broadcast", f"""WITH {_VOTE}
SELECT a.pos, a.review_id, a.review_part, a.label, a.confidence, v.review_sentiment,
       round(v.review_confidence, 3) AS review_confidence, 'MajorityVote+TieBreak+NeutralFix' AS aggregation_method
FROM {ASPECT_SCORES} a LEFT JOIN v ON a.review_id = v.review_id AND a.review_part = v.review_part""")
oracle("sent_vote_topk", f"""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY review_id, review_part ORDER BY confidence DESC, pos) AS rk
           FROM {ASPECT_SCORES} QUALIFY rk <= 5),
p AS (SELECT review_id, review_part, label, CAST(sum(CAST(round(confidence * 1000) AS BIGINT)) AS BIGINT) AS w,
             min(rk) AS first FROM t GROUP BY ALL),
s AS (SELECT review_id, review_part, arg_max(label, (w, -first)) AS lab, max(w) AS ww, sum(w) AS total
      FROM p GROUP BY ALL)
SELECT review_id, review_part, lab AS review_sentiment,
  CASE WHEN total > 0 THEN ((2000 * ww + total) // (2 * total)) / 1000.0 ELSE 0.0 END::DOUBLE AS review_confidence FROM s""")


# ---------------------------------------------------------------------------
# V
# ---------------------------------------------------------------------------
UNIT = """(SELECT vec_id, list_transform(x, lambda v: v / (CASE WHEN nrm = 0 THEN 1.0 ELSE nrm END)) AS u FROM (
  SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda v: v * v))) AS nrm FROM (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)))"""
PHRASES = """(SELECT e.vec_id, p.p_name || ' ' || CAST(e.vec_id AS VARCHAR) AS phrase, e.embedding, e.label
  FROM embeddings e JOIN part p ON e.vec_id = p.p_partkey)"""

oracle("vec_encode_hashed", f"""
WITH p AS (SELECT DISTINCT {CATALOG_TEXT} AS phrase FROM part),
g AS (SELECT phrase, unnest(list_transform(range(1, length(phrase) - 1), lambda i: substr(phrase, i, 3))) AS gram FROM p),
b AS (SELECT phrase, ('0x' || substr(md5(gram), 1, 8))::BIGINT % 64 AS bucket, count(*) AS c FROM g GROUP BY ALL),
n AS (SELECT phrase, sqrt(sum(c * c)) AS nrm FROM b GROUP BY phrase)
SELECT b.phrase, b.bucket, round(c / nrm, 6) AS weight FROM b JOIN n USING (phrase)""")
oracle("vec_normalize", f"""SELECT vec_id, CAST(generate_subscripts(u, 1) - 1 AS BIGINT) AS dim, round(unnest(u), 6) AS value
FROM {UNIT}""")

_PAIRS = f"""
u AS {UNIT},
pr AS (SELECT a.vec_id AS i, b.vec_id AS j, list_inner_product(a.u, b.u) AS sim FROM u a, u b),
rk AS (SELECT i, j, sim, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS rank FROM pr QUALIFY rank <= 5)"""
oracle("vec_ppmi", """
WITH t AS (SELECT regexp_extract_all(lower(text), '\\p{L}+') AS w FROM documents),
v AS (SELECT u AS word FROM (SELECT unnest(w) AS u FROM t) GROUP BY u HAVING count(*) >= 50),
p AS (SELECT unnest(list_zip(w[1:len(w) - k], w[k + 1:len(w)])) AS z FROM t, range(1, 5) r(k) WHERE len(w) > k),
c AS (SELECT least(z[1], z[2]) AS a, greatest(z[1], z[2]) AS b, count(*) AS n FROM p GROUP BY ALL),
f AS (SELECT * FROM c WHERE a IN (SELECT word FROM v) AND b IN (SELECT word FROM v)),
s AS (SELECT a, b, CASE WHEN a = b THEN 2 * n ELSE n END AS n FROM f UNION ALL SELECT b, a, n FROM f WHERE a <> b),
r AS (SELECT a, sum(n) AS na FROM s GROUP BY a),
e AS (SELECT s.a, s.b, ln(CAST(s.n AS DOUBLE) * (SELECT sum(na) FROM r) / r.na / q.na) AS x FROM s JOIN r ON r.a = s.a JOIN r q ON q.a = s.b)
SELECT a, b, round(x, 6) AS ppmi FROM e WHERE x > 0""")
oracle("vec_topk_neighbors", f"WITH {_PAIRS} SELECT i AS vec_id, rank, j AS nbr, round(sim, 6) AS sim FROM rk")

_CANON = f"""WITH RECURSIVE {_PAIRS},
nn1 AS (SELECT i, j AS nn, sim FROM rk WHERE j <> i QUALIFY row_number() OVER (PARTITION BY i ORDER BY rank) = 1),
f AS (SELECT u.vec_id AS i, CASE WHEN nn1.sim >= {0.40} THEN nn1.nn END AS nn FROM u LEFT JOIN nn1 ON u.vec_id = nn1.i),
walk(i, cur) AS (SELECT i, i FROM f
                 UNION ALL SELECT w.i, f.nn FROM walk w JOIN f ON f.i = w.cur WHERE f.nn IS NOT NULL AND f.nn < w.cur),
e AS (SELECT i, min(cur) AS cur FROM walk GROUP BY i),
c AS (SELECT e.i AS vec_id, CASE WHEN f.nn IS NULL THEN e.cur ELSE f.nn END AS canonical FROM e JOIN f ON f.i = e.cur),
ph AS {PHRASES},
cp AS (SELECT ph.vec_id, ph.phrase, ph2.phrase AS canonical_phrase FROM ph JOIN c ON ph.vec_id = c.vec_id
       JOIN ph ph2 ON ph2.vec_id = c.canonical)"""
oracle("vec_canonical", f"{_CANON} SELECT phrase, canonical_phrase FROM cp")
oracle("vec_dedup_group", f"""{_CANON},
r AS (SELECT p.p_brand AS source_id, cp.canonical_phrase AS phrase, round(p.p_retailprice / 2000, 6) AS score,
             list_filter(string_split(p.p_name, ' '), lambda t: {in_list('t', FX.FX_FUNCTIONAL)}) AS sents
      FROM cp JOIN part p ON cp.vec_id = p.p_partkey),
x AS (SELECT source_id, phrase, score, unnest(CASE WHEN len(sents) = 0 THEN [NULL] ELSE sents END) AS s FROM r),
g1 AS (SELECT source_id, phrase, s, max(score) AS m FROM x GROUP BY ALL)
SELECT source_id, phrase, max(m) AS score,
       array_to_string(list_sort(list_filter(list(s), lambda z: z IS NOT NULL)), ',') AS sentiments
FROM g1 GROUP BY source_id, phrase""")

_MAP = f"""
u AS {UNIT}, ph AS {PHRASES},
kw AS (SELECT ph.vec_id AS kw_index, ph.phrase AS Matched_Keyword, u.u AS kv, CAST(ph.label AS BIGINT) AS KPI_ID,
              'KPI ' || CAST(ph.label AS VARCHAR) AS KPI_Name, ph.vec_id AS Department_ID,
              'Dept ' || CAST(ph.vec_id AS VARCHAR) AS Department_Name
       FROM ph JOIN u ON ph.vec_id = u.vec_id WHERE ph.vec_id < 20),
asp AS (SELECT ph.vec_id AS aspect_id, ph.phrase AS aspect_phrase, u.u AS au FROM ph JOIN u ON ph.vec_id = u.vec_id
        WHERE ph.vec_id >= 20),
best AS (SELECT asp.aspect_id, asp.aspect_phrase, kw.kw_index, list_inner_product(asp.au, kw.kv) AS cosine_similarity
         FROM asp, kw QUALIFY row_number() OVER (PARTITION BY asp.aspect_id ORDER BY cosine_similarity DESC, kw.kw_index) = 1),
m AS (SELECT best.*, kw.Matched_Keyword, kw.KPI_ID, kw.KPI_Name, kw.Department_ID, kw.Department_Name
      FROM best JOIN kw USING (kw_index)),
t AS (SELECT aspect_id, cosine_similarity, cosine_similarity < {0.30} AS unmapped_before,
             CASE WHEN cosine_similarity < {0.30} THEN aspect_phrase ELSE Matched_Keyword END AS Matched_Keyword,
             CASE WHEN cosine_similarity < {0.30} THEN 'N/A' ELSE CAST(KPI_ID AS VARCHAR) END AS KPI_ID,
             CASE WHEN cosine_similarity < {0.30} THEN 'N/A' ELSE KPI_Name END AS KPI_Name,
             CASE WHEN cosine_similarity < {0.30} THEN 'N/A' ELSE CAST(Department_ID AS VARCHAR) END AS Department_ID,
             CASE WHEN cosine_similarity < {0.30} THEN 'N/A' ELSE Department_Name END AS Department_Name FROM m)"""
oracle("map_best", f"""WITH {_MAP} SELECT aspect_id, Matched_Keyword, round(cosine_similarity, 4) AS cosine_similarity,
  KPI_ID, KPI_Name, Department_ID, Department_Name FROM m""")
oracle("map_threshold", f"""WITH {_MAP} SELECT aspect_id, Matched_Keyword, round(cosine_similarity, 4) AS cosine_similarity,
  KPI_ID, KPI_Name, Department_ID, Department_Name, unmapped_before FROM t""")
oracle("map_unmapped_counts", f"""WITH {_MAP} SELECT count(*) FILTER (WHERE unmapped_before) AS unmapped_before,
  count(*) FILTER (WHERE lower(Matched_Keyword) = 'unmapped') AS unmapped_after FROM t""")


# ---------------------------------------------------------------------------
# R
# ---------------------------------------------------------------------------
_SYN_ROWS = [(t, s) for t, ss in FX.FX_SYNONYMS.items() for s in ss]
_HINT_ROWS = [(i, a, b) for i, (a, b) in enumerate(FX.FX_DEPT_HINTS)]
_INITCAP = "array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"

_RULES = f"""
kpis AS (SELECT {_INITCAP.format(x='p_name')} AS kpi FROM part
         UNION SELECT {_INITCAP.format(x="string_split(p_name, ' ')[-1]")} FROM part),
k AS (SELECT DISTINCT trim(kpi) AS kpi FROM kpis WHERE trim(kpi) <> ''),
kt AS (SELECT kpi, regexp_extract_all(lower(kpi), '[a-zA-Z]+') AS tokens,
              list_sort(list_distinct(regexp_extract_all(lower(kpi), '[a-zA-Z]+'))) AS utoks,
              dense_rank() OVER (ORDER BY kpi) AS kpi_rank FROM k),
nk AS (SELECT greatest(count(*), 1) AS N FROM kt),
tt AS (SELECT kpi, unnest(utoks) AS token, generate_subscripts(utoks, 1) - 1 AS tok_pos FROM kt),
dfc AS (SELECT token, count(*) AS df FROM tt GROUP BY token),
idf AS (SELECT tt.kpi, tt.token AS keyword, ln((1 + N) / (1 + df)) + 1 AS weight FROM tt JOIN dfc USING (token), nk),
syn AS (SELECT DISTINCT tt.kpi, lower(t.synonym) AS keyword FROM tt JOIN {values(_SYN_ROWS, ['token', 'synonym'])}
        USING (token)),
syn2 AS (SELECT kpi, keyword, 0.45 AS weight FROM syn WHERE NOT EXISTS
         (SELECT 1 FROM idf WHERE idf.kpi = syn.kpi AND idf.keyword = syn.keyword)),
w AS (SELECT kpi, keyword, weight, 'token' AS source FROM idf UNION ALL SELECT kpi, keyword, weight, 'synonym' FROM syn2),
h AS (SELECT * FROM {values(_HINT_ROWS, ['hint_pos', 'hint', 'dept'])}),
d1 AS (SELECT kpi, arg_min(dept, tok_pos * 1000 + hint_pos) AS d1 FROM tt JOIN h ON contains(tt.token, h.hint) GROUP BY kpi),
dn AS (SELECT r_name AS department, r_regionkey AS pos, regexp_replace(lower(r_name), '[^a-z]', '', 'g') AS norm
       FROM region WHERE regexp_replace(lower(r_name), '[^a-z]', '', 'g') <> ''),
d2 AS (SELECT kpi, arg_min(department, pos * 1000 + tok_pos) AS d2 FROM tt JOIN dn
       ON contains(regexp_replace(tt.token, '[^a-z]', '', 'g'), dn.norm) GROUP BY kpi),
d3 AS (SELECT arg_min(r_name, r_regionkey) AS d3 FROM region),
dep AS (SELECT kt.kpi, coalesce(d1, d2, d3, 'General') AS department FROM kt LEFT JOIN d1 USING (kpi)
        LEFT JOIN d2 USING (kpi), d3),
rules AS (SELECT kt.kpi, kt.kpi_rank, dep.department, kt.tokens,
                 (SELECT list_sort(list(keyword)) FROM w WHERE w.kpi = kt.kpi) AS keywords,
                 greatest((SELECT sum(weight) FROM w WHERE w.kpi = kt.kpi AND source = 'token'), 1.0) AS target_weight
          FROM kt JOIN dep USING (kpi)),
ph AS {PHRASES},
hits AS (SELECT p.phrase, r.kpi, r.kpi_rank, r.department, r.target_weight, sum(w.weight) AS matched
         FROM (SELECT DISTINCT phrase FROM ph) p JOIN w ON contains(lower(p.phrase), w.keyword) AND w.keyword <> ''
         JOIN rules r ON r.kpi = w.kpi GROUP BY ALL HAVING sum(w.weight) > 0),
best AS (SELECT phrase, kpi, department, least(1.0, matched / greatest(target_weight, 1e-6)) AS confidence FROM hits
         QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY confidence DESC, kpi_rank) = 1)"""

oracle("rule_idf", f"WITH {_RULES} SELECT kpi, keyword AS token, round(weight, 6) AS idf FROM idf")
oracle("rule_synonyms", f"WITH {_RULES} SELECT kpi, keyword, weight FROM syn2")
oracle("rule_department", f"WITH {_RULES} SELECT kpi, department FROM dep")
oracle("rule_table", f"""WITH {_RULES} SELECT kpi, department, array_to_string(keywords, ',') AS keywords,
  CAST(len(keywords) AS BIGINT) AS n_keywords, array_to_string(tokens, ' ') AS primary_phrase,
  round(target_weight, 6) AS target_weight FROM rules""")
oracle("rule_match", f"WITH {_RULES} SELECT phrase, kpi, department, round(confidence, 6) AS confidence FROM best")
oracle("rule_annotate", f"""WITH {_RULES} SELECT ph.vec_id, best.kpi AS domain_kpi, best.department AS domain_department,
  round(best.confidence, 6) AS domain_confidence FROM ph JOIN best USING (phrase) WHERE best.confidence >= 0.5""")
oracle("rule_retention", f"""WITH {_RULES},
cl AS (SELECT vec_id, phrase, CASE WHEN vec_id % 37 = 0 THEN -1 WHEN vec_id < 2 THEN 10 ELSE label END AS cluster FROM ph),
a AS (SELECT cl.* FROM cl JOIN best USING (phrase) WHERE best.confidence >= 0.5 AND cl.cluster >= 0)
SELECT (SELECT count(*) FROM a) AS matched_rows, (SELECT count(DISTINCT phrase) FROM a) AS matched_unique_phrases,
       (SELECT count(*) FROM cl) - (SELECT count(*) FROM a) AS filtered_out""")


# ---------------------------------------------------------------------------
# T8–T16, A
# ---------------------------------------------------------------------------
SEPC = chr(1)


def clauses_sql(x: str) -> str:
    words = "|".join(L.CONTRAST_WORDS)
    t = f"regexp_replace({x}, ';\\s*', ';{SEPC}', 'g')"
    t = f"regexp_replace({t}, '(?i)(^|[^\\p{{L}}\\p{{N}}_])({words})\\s+', '\\1\\2{SEPC}', 'g')"
    t = f"regexp_replace({t}, ',\\s+(and|or|but|nor|yet|so|for)\\s+', ', \\1{SEPC}', 'g')"
    t = f"regexp_replace({t}, ',\\s+([A-Z])', ',{SEPC}\\1', 'g')"
    t = f"regexp_replace({t}, '([.!?])\\s+', '\\1{SEPC}', 'g')"
    return (f"list_filter(list_transform(string_split({t}, '{SEPC}'), "
            f"lambda p: trim(regexp_replace(p, '\\s+', ' ', 'g'))), lambda p: p <> '')")


DOC_CLAUSES = f"""(SELECT doc_id AS review_key, CAST(generate_subscripts(cl, 1) - 1 AS BIGINT) AS clause_pos,
  unnest(cl) AS clause FROM (SELECT doc_id, {clauses_sql('text')} AS cl FROM documents))"""
ORDER_REVIEWS = f"""(SELECT l_orderkey AS review_key, string_agg({CATALOG_TEXT}, ' ; '
  ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS text
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)"""
# order-review clauses consist of fixture words only, so each clause is one chunk: its letters
ORDER_CHUNKS = f"""(SELECT review_key, clause_pos, clause,
  trim(regexp_replace(regexp_replace(lower(clause), '[^\\p{{L}}\\p{{N}}\\s''-]', ' ', 'g'), '\\s+', ' ', 'g')) AS phrase
  FROM (SELECT review_key, CAST(generate_subscripts(cl, 1) - 1 AS BIGINT) AS clause_pos, unnest(cl) AS clause
        FROM (SELECT review_key, {clauses_sql('text')} AS cl FROM {ORDER_REVIEWS})))"""

oracle("seg_clauses", f"SELECT * FROM {DOC_CLAUSES}")
_chunks_sql = f"""SELECT review_key, clause_pos, CAST(0 AS BIGINT) AS chunk_pos, phrase FROM {ORDER_CHUNKS}
WHERE length(phrase) > 2 AND NOT {in_list('phrase', L.STOP_ASPECTS)}"""
oracle("asp_chunks", _chunks_sql)
oracle("asp_informative", _chunks_sql)
oracle("asp_distinct", f"""
WITH c AS (SELECT review_key, clause_pos, phrase,
                  CASE WHEN len(string_split_regex(trim(clause), '\\s+')) > 48
                       THEN array_to_string(string_split_regex(trim(clause), '\\s+')[1:48], ' ') || ' ...'
                       ELSE array_to_string(string_split_regex(trim(clause), '\\s+'), ' ') END AS snippet
           FROM {ORDER_CHUNKS} WHERE length(phrase) > 2 AND NOT {in_list('phrase', L.STOP_ASPECTS)}),
a AS (SELECT review_key, phrase, snippet, min(clause_pos) AS first FROM c GROUP BY ALL)
SELECT review_key, row_number() OVER (PARTITION BY review_key ORDER BY first) - 1 AS aspect_pos,
       phrase AS aspect_phrase, snippet AS aspect_snippet FROM a""")
oracle("asp_entities", f"""
WITH nm AS (SELECT DISTINCT lower(p_name) AS name FROM part WHERE split_part(p_name, ' ', 1) IN ('hot', 'cold')),
c AS (SELECT review_key, clause_pos, phrase, array_to_string(string_split_regex(trim(clause), '\\s+'), ' ') AS snippet FROM {ORDER_CHUNKS}
      WHERE length(phrase) > 2 AND NOT {in_list('phrase', L.STOP_ASPECTS)}),
k AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM nm WHERE contains(' ' || c.phrase || ' ', ' ' || nm.name || ' '))),
a AS (SELECT review_key, phrase, snippet, min(clause_pos) AS first FROM k GROUP BY ALL)
SELECT review_key, row_number() OVER (PARTITION BY review_key ORDER BY first) - 1 AS aspect_pos,
       phrase AS aspect_phrase, snippet AS aspect_snippet FROM a
UNION ALL SELECT review_key, 0, 'general', trim(text) FROM {ORDER_REVIEWS} WHERE review_key NOT IN (SELECT review_key FROM k)""")
oracle("asp_general_fallback", """SELECT doc_id AS review_key, CAST(0 AS BIGINT) AS aspect_pos,
  'general' AS aspect_phrase, trim(text) AS aspect_snippet FROM documents WHERE text IS NOT NULL AND trim(text) <> ''""")

_W = "string_split_regex(trim(clause), '\\s+')"
oracle("snip_head", f"""SELECT review_key, clause_pos, CASE WHEN len({_W}) > 48
  THEN array_to_string({_W}[1:48], ' ') || ' ...' ELSE array_to_string({_W}, ' ') END AS snippet FROM {DOC_CLAUSES}""")
oracle("snip_window", f"""
WITH c AS (SELECT review_key, clause_pos, {_W} AS w,
                  lower(coalesce(string_split(clause, ' ')[2], '')) AS phrase FROM {DOC_CLAUSES}),
i AS (SELECT *, list_filter(range(len(w)), lambda j: contains(lower(w[j + 1]), phrase))[1] AS idx FROM c),
s AS (SELECT *, greatest(0, idx - 12) AS st, least(len(w), idx + 13) AS en FROM i)
SELECT review_key, clause_pos, CASE WHEN idx IS NULL THEN
    CASE WHEN len(w) > 32 THEN array_to_string(w[1:32], ' ') || ' ...' ELSE array_to_string(w, ' ') END
  ELSE array_to_string(w[st + 1:st + least(en - st, 32)], ' ') END AS snippet FROM s""")
oracle("snip_centered", f"""
WITH c AS (SELECT review_key, clause_pos, {_W} AS w FROM {DOC_CLAUSES}),
s AS (SELECT *, greatest(0, len(w) // 2 - 24) AS st FROM c)
SELECT review_key, clause_pos, CASE WHEN len(w) <= 48 THEN array_to_string(w, ' ')
  ELSE array_to_string(w[st + 1:least(len(w), st + 48)], ' ') END AS snippet FROM s""")

_VOCAB = """(SELECT term, freq FROM (SELECT term, count(*) AS freq, sum(count(*)) OVER () AS total FROM (
  SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents) GROUP BY term)
  WHERE freq >= total * 1e-4)"""
_CORRECTABLE = "length(tok) >= 2 AND regexp_matches(tok, '\\p{L}') AND NOT regexp_matches(tok, '\\p{N}')"


def _spell(tokens_sql: str, dist: int, order: str, out: str) -> str:
    """tokens_sql: a query giving (doc_id, tk)."""
    return f"""
WITH t AS ({tokens_sql}),
x AS (SELECT doc_id, unnest(tk) AS tok, generate_subscripts(tk, 1) AS pos FROM t),
v AS {_VOCAB},
u AS (SELECT DISTINCT tok FROM x WHERE tok NOT IN (SELECT term FROM v) AND {_CORRECTABLE}),
c AS (SELECT u.tok, v.term, v.freq, levenshtein(u.tok, v.term) AS dist FROM u, v
      WHERE abs(length(u.tok) - length(v.term)) <= {dist} AND levenshtein(u.tok, v.term) <= {dist}),
b AS (SELECT tok, term AS corr FROM c QUALIFY row_number() OVER (PARTITION BY tok ORDER BY {order}) = 1),
r AS (SELECT x.doc_id, string_agg(coalesce(b.corr, x.tok), ' ' ORDER BY x.pos) AS s FROM x LEFT JOIN b USING (tok)
      GROUP BY x.doc_id)
SELECT t.doc_id AS review_key, coalesce(r.s, '') AS {out} FROM t LEFT JOIN r USING (doc_id)"""


oracle("spell_correct_1", _spell(f"SELECT doc_id, {_clean_tokens(norm('text'))} AS tk FROM documents",
                                 1, "freq DESC, term", "tokens"))
_LIGHT = "trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s.,!?]', ' ', 'g'), '\\s+', ' ', 'g'))"
oracle("spell_correct_2", _spell(
    f"SELECT doc_id, CASE WHEN lt = '' THEN []::VARCHAR[] ELSE string_split(lt, ' ') END AS tk "
    f"FROM (SELECT doc_id, {_LIGHT} AS lt FROM documents)",
    2, "dist, freq DESC, term", "text"))

_LEX = values([r[:3] for r in FX.fx_token_lexicon_rows()], ["word", "tag", "lemma"], "l")
_SENSES = values(FX.FX_SENSES, ["lemma", "sense", "domain"], "sx")
_CAT_TOKENS = f"""(SELECT p_partkey AS review_key, CAST(generate_subscripts(ws, 1) - 1 AS BIGINT) AS pos,
  unnest(ws) AS token FROM (SELECT p_partkey, string_split({CATALOG_TEXT}, ' ') AS ws FROM part))"""
_TAGGED = f"""(SELECT t.review_key, t.pos, t.token, coalesce(l.tag, 'NN') AS tag, coalesce(l.lemma, t.token) AS lemma
  FROM {_CAT_TOKENS} t LEFT JOIN {_LEX} ON l.word = t.token)"""
_SUFFIX = " OR ".join(f"suffix(lemma, {q(s)})" for s in L.ABSTRACT_SUFFIXES)
_NOUNS = f"""(SELECT lemma, is_abstract,
  CASE WHEN {in_list('lemma', FX.FX_DOMAIN_NOUNS)} THEN TRUE
       WHEN {in_list('lemma', FX.FX_NOISE)} OR {in_list('lemma', FX.FX_ABSTRACT)} THEN FALSE
       ELSE NOT is_abstract END AS is_concrete, n_senses FROM (
  SELECT w.lemma, CASE WHEN {in_list('w.lemma', FX.FX_ABSTRACT)} THEN TRUE WHEN {_SUFFIX.replace('lemma', 'w.lemma')} THEN TRUE
       WHEN coalesce(s.any_c, FALSE) THEN FALSE WHEN coalesce(s.any_a, FALSE) THEN TRUE ELSE FALSE END AS is_abstract,
       CAST(coalesce(s.n, 0) AS BIGINT) AS n_senses
  FROM (SELECT DISTINCT lemma FROM {_TAGGED}) w LEFT JOIN (
    SELECT lemma, count(*) AS n, bool_or({in_list('domain', L.CONCRETE_DOMAINS)}) AS any_c,
           bool_or({in_list('domain', L.ABSTRACT_DOMAINS)}) AS any_a FROM {_SENSES} GROUP BY lemma) s
  ON s.lemma = w.lemma))"""

oracle("tok_pos_lemma", f"SELECT review_key, pos, token, tag, lemma FROM {_TAGGED} WHERE substr(tag, 1, 2) IN ('NN', 'JJ')")
oracle("noun_abstract", f"SELECT lemma, is_abstract FROM {_NOUNS}")
oracle("noun_concrete", f"SELECT lemma, is_concrete FROM {_NOUNS}")
oracle("noun_sense_count", f"SELECT lemma, n_senses FROM {_NOUNS}")
oracle("tok_lemma_filter", f"""
WITH t AS (SELECT t.*, n.is_concrete FROM {_TAGGED} t JOIN {_NOUNS} n USING (lemma)),
k AS (SELECT * FROM t WHERE substr(tag, 1, 2) IN ('NN', 'JJ') AND NOT {in_list('lemma', L.ENGLISH_STOPWORDS)}
      AND length(lemma) > 2 AND (NOT starts_with(tag, 'NN') OR (NOT {in_list('lemma', FX.FX_NOISE)}
      AND NOT {in_list('lemma', FX.FX_ABSTRACT)} AND ({in_list('lemma', FX.FX_DOMAIN_NOUNS)}
      OR {in_list('lemma', FX.FX_WHITELIST)} OR is_concrete))))
SELECT review_key, string_agg(lemma, ' ' ORDER BY pos) AS clean_text,
       string_agg(substr(tag, 1, 2), ' ' ORDER BY pos) AS pos_tags FROM k GROUP BY review_key""")
oracle("phrase_generic", f"""SELECT p_partkey AS review_key, CASE WHEN trim(t) = '' THEN TRUE ELSE
  len(list_filter(string_split_regex(trim(t), '\\s+'), lambda w: NOT {in_list('w', FX.FX_GENERIC)})) = 0 END AS is_generic
  FROM (SELECT p_partkey, {CATALOG_TEXT} AS t FROM part)""")


# ---------------------------------------------------------------------------
# C
# ---------------------------------------------------------------------------
FXC = f"""(SELECT vec_id, phrase, embedding, label,
  CASE WHEN vec_id % 37 = 0 THEN -1 WHEN vec_id < 2 THEN 10 ELSE label END AS cluster FROM {PHRASES})"""


def silhouette_sql(pts: str, distance: str = "list_distance(a.v, b.v)") -> str:
    """pts: (vec_id, v DOUBLE[], cluster) of the non-noise points."""
    return f"""(WITH p AS {pts},
d AS (SELECT a.vec_id AS i, a.cluster AS ci, b.cluster AS c, {distance} AS dist
      FROM p a, p b WHERE a.vec_id <> b.vec_id),
s AS (SELECT i, ci, c, avg(dist) AS m FROM d GROUP BY ALL),
own AS (SELECT i, m AS a FROM s WHERE c = ci),
oth AS (SELECT i, min(m) AS b FROM s WHERE c <> ci GROUP BY i),
sil AS (SELECT CASE WHEN own.a IS NULL OR oth.b IS NULL THEN 0.0 ELSE (oth.b - own.a) / greatest(own.a, oth.b) END AS s
        FROM p LEFT JOIN own ON own.i = p.vec_id LEFT JOIN oth ON oth.i = p.vec_id)
SELECT CASE WHEN (SELECT count(DISTINCT cluster) FROM p) <= 1 OR (SELECT count(*) FROM p) < 2 THEN 0.0
            ELSE avg(s) END AS silhouette FROM sil)"""


_PTS = f"(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, cluster FROM {FXC} WHERE cluster >= 0)"
_CEN = f"""(SELECT cluster, list(x ORDER BY dim) AS c, max(n) AS size FROM (
  SELECT cluster, dim, avg(x) AS x, count(*) AS n FROM (
    SELECT cluster, generate_subscripts(v, 1) - 1 AS dim, unnest(v) AS x FROM {_PTS}) GROUP BY ALL) GROUP BY cluster)"""
_DBI = f"""(WITH p AS {_PTS}, cen AS {_CEN},
sc AS (SELECT p.cluster, avg(list_distance(p.v, cen.c)) AS s FROM p JOIN cen USING (cluster) GROUP BY ALL),
cs AS (SELECT * FROM cen JOIN sc USING (cluster)),
r AS (SELECT a.cluster AS k, max((a.s + b.s) / list_distance(a.c, b.c)) AS r FROM cs a, cs b
      WHERE a.cluster <> b.cluster GROUP BY a.cluster)
SELECT CASE WHEN (SELECT count(DISTINCT cluster) FROM p) <= 1 OR (SELECT count(*) FROM p) < 2 THEN 'inf'::DOUBLE
            ELSE avg(r) END AS davies_bouldin FROM r)"""

oracle("clu_silhouette", f"SELECT round(silhouette, 6) AS silhouette FROM {silhouette_sql(_PTS)}")
oracle("clu_silhouette_sq", f"""SELECT round(silhouette, 6) AS silhouette_sq
  FROM {silhouette_sql(_PTS, 'list_distance(a.v, b.v) ** 2')}""")
oracle("clu_davies_bouldin", f"SELECT round(davies_bouldin, 6) AS davies_bouldin FROM {_DBI}")
oracle("clu_centroids", f"""SELECT CAST(cluster AS BIGINT) AS cluster, CAST(generate_subscripts(c, 1) - 1 AS BIGINT) AS dim,
  round(unnest(c), 6) AS value FROM {_CEN}""")
oracle("clu_reassign", f"""
WITH f AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, cluster FROM {FXC}),
sz AS (SELECT cluster, count(*) AS n FROM f GROUP BY cluster),
cen AS {_CEN},
cu AS (SELECT cluster, list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda y: y * y)))) AS u FROM cen),
mv AS (SELECT f.vec_id, list_transform(f.v, lambda x: x / sqrt(list_sum(list_transform(f.v, lambda y: y * y)))) AS u
       FROM f JOIN sz USING (cluster) WHERE f.cluster = -1 OR sz.n < 3),
best AS (SELECT mv.vec_id, cu.cluster FROM mv, cu
         QUALIFY row_number() OVER (PARTITION BY mv.vec_id ORDER BY list_inner_product(mv.u, cu.u) DESC, cu.cluster) = 1)
SELECT f.vec_id, CAST(coalesce(best.cluster, f.cluster) AS BIGINT) AS cluster FROM f LEFT JOIN best USING (vec_id)""")
oracle("clu_drop_small", f"""
WITH f AS (SELECT vec_id, cluster FROM {FXC}), sz AS (SELECT cluster, count(*) AS n FROM f GROUP BY cluster),
d AS (SELECT vec_id, CASE WHEN cluster <> -1 AND n < 3 THEN -1 ELSE cluster END AS cluster FROM f JOIN sz USING (cluster))
SELECT vec_id, CAST(CASE WHEN (SELECT max(cluster) FROM d) = -1 THEN 0 ELSE cluster END AS BIGINT) AS cluster FROM d""")

_PROFILE = f"""WITH {_RULES},
rows AS (SELECT c.vec_id, c.phrase, c.cluster, best.confidence,
                len(list_filter(string_split_regex(trim(c.phrase), '\\s+'), lambda w: NOT {in_list('w', FX.FX_GENERIC)})) = 0
                  AS is_generic FROM {FXC} c LEFT JOIN best USING (phrase)),
g AS (SELECT cluster, count(*) AS size, avg(CASE WHEN coalesce(confidence, 0) >= 0.5 THEN 1.0 ELSE 0.0 END) AS pr,
             avg(CASE WHEN is_generic THEN 1.0 ELSE 0.0 END) AS gr, min(coalesce(confidence, 0.0)) AS mn,
             max(coalesce(confidence, 0.0)) AS mx FROM rows GROUP BY cluster),
prof AS (SELECT cluster, size, CASE WHEN cluster = -1 THEN 0.0 ELSE pr END AS pass_ratio,
                CASE WHEN cluster = -1 THEN 1.0 ELSE 1.0 - pr END AS noise_ratio,
                CASE WHEN cluster = -1 THEN 1.0 ELSE gr END AS generic_ratio,
                CASE WHEN cluster = -1 THEN NULL ELSE mn END AS min_confidence,
                CASE WHEN cluster = -1 THEN NULL ELSE mx END AS max_confidence FROM g)"""
oracle("clu_profile", f"""{_PROFILE} SELECT CAST(cluster AS BIGINT) AS cluster, size, round(pass_ratio, 6) AS pass_ratio,
  round(noise_ratio, 6) AS noise_ratio, round(generic_ratio, 6) AS generic_ratio,
  round(min_confidence, 6) AS min_confidence, round(max_confidence, 6) AS max_confidence FROM prof""")
oracle("clu_noisiest", f"""{_PROFILE} SELECT CAST(cluster AS BIGINT) AS cluster, round(noise_ratio, 3) AS noise_ratio,
  row_number() OVER (ORDER BY round(noise_ratio, 3) DESC, cluster) AS rank FROM prof WHERE cluster >= 0
  QUALIFY rank <= 5""")

_NONNOUN = sorted({w for w, t, _l, _e in FX.fx_token_lexicon_rows() if not t.startswith("NN")})
_SCORED = f"""(SELECT c.*, round(p.p_retailprice / 2000, 6) AS score FROM {FXC} c JOIN part p ON c.vec_id = p.p_partkey)"""
oracle("clu_labels", f"""
WITH b AS (SELECT cluster, phrase FROM {_SCORED} WHERE cluster >= 0
           QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY score DESC, length(phrase) DESC, phrase) = 1),
n AS (SELECT cluster, phrase, list_filter(string_split(lower(phrase), ' '), lambda t: NOT {in_list('t', _NONNOUN)}) AS ns FROM b),
d AS (SELECT cluster, phrase, array_to_string(list_filter(ns, lambda t, i: list_position(ns, t) = i), ' ') AS nouns FROM n),
l AS (SELECT cluster, CASE WHEN nouns <> '' THEN nouns ELSE lower(phrase) END AS raw FROM d)
SELECT CAST(cluster AS BIGINT) AS cluster,
       array_to_string(list_transform(string_split(raw, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS label FROM l
UNION ALL SELECT DISTINCT CAST(cluster AS BIGINT), 'Noise' FROM {FXC} WHERE cluster = -1""")
oracle("clu_highlights", f"""SELECT CAST(cluster AS BIGINT) AS cluster,
  row_number() OVER (PARTITION BY cluster ORDER BY score DESC, phrase) AS rank, phrase FROM {_SCORED} WHERE cluster >= 0
  QUALIFY rank <= 5""")
oracle("clu_sizes", f"""
WITH s AS (SELECT cluster, count(*) AS size FROM {FXC} GROUP BY cluster)
SELECT CAST(cluster AS BIGINT) AS cluster, size, row_number() OVER (ORDER BY size DESC, cluster) AS size_rank,
  round(sum(CASE WHEN cluster = -1 THEN size ELSE 0 END) OVER () / sum(size) OVER (), 6) AS noise_ratio,
  CAST(sum(CASE WHEN cluster <> -1 THEN 1 ELSE 0 END) OVER () AS BIGINT) AS cluster_count FROM s""")
_DROPPED = f"""(WITH f AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, cluster FROM {FXC}),
sz AS (SELECT cluster, count(*) AS n FROM f GROUP BY cluster),
d AS (SELECT vec_id, v, CASE WHEN cluster <> -1 AND n < 3 THEN -1 ELSE cluster END AS cluster FROM f JOIN sz USING (cluster))
SELECT vec_id, v, CASE WHEN (SELECT max(cluster) FROM d) = -1 THEN 0 ELSE cluster END AS cluster FROM d)"""
oracle("clu_select", f"""
WITH km AS (SELECT (SELECT silhouette FROM {silhouette_sql(_PTS)}) AS ks, (SELECT davies_bouldin FROM {_DBI}) AS kd),
dd AS (SELECT * FROM {_DROPPED} WHERE cluster >= 0),
dn AS (SELECT (SELECT silhouette FROM {silhouette_sql('(SELECT * FROM dd)')}) AS ds,
              (SELECT count(DISTINCT cluster) FROM dd) AS n),
j AS (SELECT ks < 0.25 OR kd > 1.0 AS switched, ds, n FROM km, dn)
SELECT CASE WHEN switched AND n > 2 AND ds >= 0.2 THEN 'density' ELSE 'kmeans' END AS method, switched FROM j""")


# ---------------------------------------------------------------------------
# M
# ---------------------------------------------------------------------------
_TRN = f"""{_RULES},
seed AS (SELECT trim(c) AS phrase, kpi, department, -1 AS cluster, kpi_rank * 10 + i - 1 AS seq FROM (
           SELECT kpi, kpi_rank, department, unnest(cand) AS c, generate_subscripts(cand, 1) AS i FROM (
             SELECT kpi, kpi_rank, department, [array_to_string(tokens, ' ')] || keywords[1:3] AS cand FROM rules))
         WHERE trim(c) <> ''),
fxc AS {FXC},
ann AS (SELECT fxc.vec_id, fxc.phrase, fxc.cluster, best.kpi AS domain_kpi, best.department AS domain_department,
               best.confidence AS domain_confidence FROM fxc JOIN best USING (phrase)
        WHERE best.confidence >= 0.5 AND fxc.cluster >= 0),
rulet AS (SELECT phrase, domain_kpi AS kpi, domain_department AS department, cluster, vec_id AS seq FROM ann
          WHERE domain_confidence >= 0.7),
kc AS (SELECT cluster, domain_kpi AS v, count(*) AS n FROM ann GROUP BY ALL),
dc AS (SELECT cluster, domain_department AS v, count(*) AS n FROM ann GROUP BY ALL),
clus AS (SELECT 'cluster_' || k.cluster || '_centroid' AS phrase, k.v AS kpi, d.v AS department, k.cluster,
                k.cluster AS seq
         FROM (SELECT * FROM kc QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, v) = 1) k
         JOIN (SELECT * FROM dc QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, v) = 1) d USING (cluster)),
cids AS (SELECT DISTINCT cluster AS alt FROM fxc WHERE cluster >= 0),
neg AS (SELECT phrase || '__neg_' || alt AS phrase, '__noise__' AS kpi, 'Unknown' AS department, alt AS cluster,
               vec_id AS seq FROM (
          SELECT ann.phrase, ann.vec_id, cids.alt FROM ann JOIN cids ON cids.alt <> ann.cluster
          QUALIFY row_number() OVER (PARTITION BY ann.phrase, ann.cluster, ann.vec_id
                                     ORDER BY md5(ann.phrase || '|' || cids.alt || '|42')) = 1)),
un AS (SELECT *, 0 AS source_rank FROM seed UNION ALL SELECT *, 1 FROM rulet UNION ALL SELECT *, 2 FROM clus
       UNION ALL SELECT *, 3 FROM neg),
dd AS (SELECT * FROM un QUALIFY row_number() OVER (PARTITION BY phrase, kpi, cluster ORDER BY source_rank, seq) = 1),
st AS (SELECT count(*) AS n, count(DISTINCT kpi) AS k, CASE WHEN count(*) >= 40 THEN 0.25 ELSE 0.2 END AS f FROM dd),
mc AS (SELECT min(c) AS minc FROM (SELECT count(*) AS c FROM dd GROUP BY kpi)),
sp AS (SELECT dd.*, CASE WHEN st.n <= 4 OR st.k <= 1 THEN NULL
         WHEN mc.minc >= 2 THEN row_number() OVER (PARTITION BY kpi ORDER BY md5(phrase || '|' || kpi || '|' || cluster || '|42'))
                                <= floor(count(*) OVER (PARTITION BY kpi) * st.f + 0.5)
         ELSE row_number() OVER (ORDER BY md5(phrase || '|' || kpi || '|' || cluster || '|42')) <= floor(st.n * st.f + 0.5)
         END AS is_test FROM dd, st, mc)"""

oracle("trn_seed", f"WITH {_TRN} SELECT phrase, kpi, department, CAST(cluster AS BIGINT) AS cluster, CAST(seq AS BIGINT) AS seq FROM seed")
oracle("trn_rule", f"WITH {_TRN} SELECT phrase, kpi, department, CAST(cluster AS BIGINT) AS cluster, CAST(seq AS BIGINT) AS seq FROM rulet")
oracle("trn_cluster", f"WITH {_TRN} SELECT phrase, kpi, department, CAST(cluster AS BIGINT) AS cluster FROM clus")
oracle("trn_negatives", f"WITH {_TRN} SELECT phrase, kpi, department, CAST(cluster AS BIGINT) AS cluster, CAST(seq AS BIGINT) AS seq FROM neg")
oracle("trn_union_dedup", f"""WITH {_TRN} SELECT phrase, kpi, department, CAST(cluster AS BIGINT) AS cluster,
  CAST(source_rank AS BIGINT) AS source_rank FROM dd""")
oracle("feat_label_index", f"WITH {_TRN} SELECT kpi, CAST(dense_rank() OVER (ORDER BY kpi) - 1 AS BIGINT) AS label_index "
                           f"FROM (SELECT DISTINCT kpi FROM dd)")
oracle("feat_split", f"WITH {_TRN} SELECT phrase, kpi, CAST(cluster AS BIGINT) AS cluster, is_test FROM sp")
oracle("feat_weights", f"""WITH {_TRN}, tr AS (SELECT kpi, count(*) AS cnt FROM sp WHERE NOT coalesce(is_test, FALSE) GROUP BY kpi)
SELECT kpi, round(sum(cnt) OVER () / (count(*) OVER () * cnt), 6) AS weight FROM tr""")
oracle("feat_concat", f"""
WITH f AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, cluster FROM {FXC}),
cen AS (SELECT cluster, c[1:48] AS c FROM {_CEN}),
j AS (SELECT f.vec_id, f.e, coalesce(cen.c, f.e) AS c FROM f LEFT JOIN cen USING (cluster)),
x AS (SELECT vec_id, e || CASE WHEN len(c) = len(e) THEN c
                               ELSE list_transform(range(len(e)), lambda i: c[(i % len(c)) + 1]) END AS feat FROM j)
SELECT vec_id, CAST(generate_subscripts(feat, 1) - 1 AS BIGINT) AS dim, round(unnest(feat), 6) AS value FROM x""")

_PP = "(SELECT doc_id, CAST(quality AS BIGINT) AS y_true, CAST(1 - toxic AS BIGINT) AS y_pred FROM labels)"
oracle("clf_metrics", f"""
WITH p AS {_PP}, lab AS (SELECT y_true AS l FROM p UNION SELECT y_pred FROM p),
s AS (SELECT lab.l, (SELECT count(*) FROM p WHERE y_true = lab.l AND y_pred = lab.l) AS tp,
             (SELECT count(*) FROM p WHERE y_pred = lab.l) AS pc, (SELECT count(*) FROM p WHERE y_true = lab.l) AS tc FROM lab),
m AS (SELECT tp, tc, CASE WHEN pc > 0 THEN tp / pc ELSE 0.0 END AS pr, CASE WHEN tc > 0 THEN tp / tc ELSE 0.0 END AS rc FROM s)
SELECT round(sum(tp) / sum(tc), 6) AS accuracy, round(avg(pr), 6) AS precision, round(avg(rc), 6) AS recall,
       round(avg(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END), 6) AS f1 FROM m""")
oracle("clf_confusion", f"""
WITH p AS {_PP}, lab AS (SELECT y_true AS l FROM p UNION SELECT y_pred FROM p)
SELECT a.l AS y_true, b.l AS y_pred, (SELECT count(*) FROM p WHERE p.y_true = a.l AND p.y_pred = b.l) AS n
FROM lab a, lab b""")
oracle("clf_support", f"SELECT y_true AS label, count(*) AS support FROM {_PP} GROUP BY y_true")

_FUSE = f"""{_RULES},
pr AS (SELECT vec_id, phrase, list_transform(e, lambda v: v / list_sum(e)) AS p FROM (
         SELECT vec_id, phrase, list_transform(x, lambda v: exp(v - list_max(x))) AS e FROM (
           SELECT vec_id, phrase, CAST(embedding[1:4] AS DOUBLE[]) AS x FROM ph))),
m AS (SELECT vec_id, phrase, p[4] AS noise, list_position(p[1:3], list_max(p[1:3])) AS bi, p FROM pr),
mm AS (SELECT m.*, ['Bolt', 'Gear', 'Ring'][bi] AS mk, p[bi] * greatest(0.0, 1 - noise) AS mp FROM m),
j AS (SELECT mm.vec_id, mm.noise, mm.mk, mm.mp, coalesce(rd.department, 'General') AS mdept,
             best.kpi AS rk, best.department AS rdept, best.confidence AS r
      FROM mm LEFT JOIN best USING (phrase) LEFT JOIN (SELECT kpi, department FROM rules) rd ON rd.kpi = mm.mk),
d AS (SELECT *, r IS NOT NULL AND ((r >= 0.7 AND r >= mp AND r >= 0.5) OR NOT (mp >= 0.6 AND mp >= r)) AS use_rule FROM j),
e AS (SELECT vec_id, noise, CASE WHEN use_rule THEN rk ELSE mk END AS kpi, CASE WHEN use_rule THEN rdept ELSE mdept END AS department,
             CASE WHEN r IS NOT NULL THEN greatest(r, mp) ELSE mp END AS prob, use_rule FROM d),
fz AS (SELECT vec_id, kpi, department, CASE WHEN kpi = '__noise__' THEN least(prob, 0.0) ELSE prob END AS probability,
              use_rule AND kpi <> '__noise__' AS rule_applied, noise AS noise_probability FROM e)"""
oracle("fuse_decision", f"""WITH {_FUSE} SELECT vec_id, kpi, department, round(probability, 6) AS probability, rule_applied,
  round(noise_probability, 6) AS noise_probability,
  probability >= 0.6 AND kpi <> '__noise__' AND noise_probability < 0.5 AS accepted FROM fz""")
oracle("fuse_accepted", f"""WITH {_FUSE} SELECT vec_id, kpi, round(probability, 6) AS probability FROM fz
  WHERE probability >= 0.6 AND kpi <> '__noise__' AND noise_probability < 0.5""")


# ---------------------------------------------------------------------------
# E1, E6, E10, G, S8
# ---------------------------------------------------------------------------


def lexicon_star_sql(text: str, pos, neg) -> str:
    """(net, stars, confidence) columns of the built-in lexicon scorer."""
    toks = f"regexp_extract_all(lower({text}), '\\p{{L}}+')"
    net = (f"least(2, greatest(-2, len(list_filter({toks}, lambda t: {in_list('t', pos)})) - "
           f"len(list_filter({toks}, lambda t: {in_list('t', neg)}))))")
    return net


def _softmax_max(net: str) -> str:
    terms = " + ".join(f"exp(-abs({net} - ({k})) + abs({net} - {net}))" for k in range(-2, 3))
    return f"(1.0 / ({terms}))"


oracle("sent_lexicon_score", f"""SELECT review_key, CAST(net + 3 AS BIGINT) AS stars, round({_softmax_max('net')}, 6) AS confidence
FROM (SELECT doc_id AS review_key, {lexicon_star_sql('text', FX.FX_POSITIVE, FX.FX_NEGATIVE)} AS net FROM documents)""")

def _class_logits(rows: str, model: str) -> str:
    """Raw class logits of ``rows`` (id, text) under the counted ``model`` CTEs (counts ``c``, totals ``tk``, priors ``pr``)."""
    parts = ", ".join(
        f"(SELECT lp FROM pr WHERE y = {k}) + coalesce(sum(ln((coalesce(c{k}.n, 0) + 0.1) / ((SELECT n FROM tk WHERE y = {k}) + 0.1 * 65536))), 0) AS l{k}" for k in range(3))
    joins = " ".join(f"LEFT JOIN c c{k} ON c{k}.b = g.b AND c{k}.y = {k}" for k in range(3))
    return f"SELECT r.id, {parts} FROM {rows} r LEFT JOIN {model} g ON g.id = r.id {joins} GROUP BY r.id"


_TM_GRAMS = """(SELECT id, ('0x' || substr(md5(g), 1, 8))::BIGINT % 65536 AS b FROM (
  SELECT id, unnest(list_concat(w, list_transform(range(greatest(len(w) - 1, 0)), lambda i: w[i + 1] || ' ' || w[i + 2]))) AS g
  FROM (SELECT id, regexp_extract_all(lower(coalesce(text, '')), '\\p{L}+')[1:256] AS w FROM d)))"""
oracle("sent_trained", f"""
WITH d AS (SELECT doc_id AS id, text FROM documents),
gr AS MATERIALIZED {_TM_GRAMS},
lab AS (SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 0 WHEN quality = 0 THEN 1 ELSE 2 END AS y,
               ('0x' || substr(md5(text), 9, 8))::BIGINT % 5 = 0 AS held FROM labels JOIN documents USING (doc_id) WHERE text IS NOT NULL),
c AS MATERIALIZED (SELECT b, y, count(*) AS n FROM gr JOIN lab USING (id) WHERE NOT held GROUP BY b, y),
tk AS (SELECT y, sum(n) AS n FROM c GROUP BY y),
ny AS (SELECT k AS y, coalesce(n, 0.5) AS n FROM range(3) r(k) LEFT JOIN (SELECT y, count(*) AS n FROM lab WHERE NOT held GROUP BY y) z ON z.y = k),
pr AS (SELECT y, ln(n / (SELECT sum(n) FROM ny)) AS lp FROM ny),
raw AS MATERIALIZED ({_class_logits('d', 'gr')}),
ls AS (SELECT t, sum(ln(exp(l0 / t - m) + exp(l1 / t - m) + exp(l2 / t - m)) + m - CASE y WHEN 0 THEN l0 WHEN 1 THEN l1 ELSE l2 END / t) AS loss
       FROM (SELECT raw.*, lab.y, CAST(2 ** k AS DOUBLE) AS t, greatest(l0, l1, l2) / CAST(2 ** k AS DOUBLE) AS m
             FROM raw JOIN lab USING (id), range(10) r(k) WHERE held) GROUP BY t),
te AS (SELECT t FROM ls ORDER BY loss, t LIMIT 1)
SELECT id AS doc_id, CAST(CASE WHEN l0 >= l1 AND l0 >= l2 THEN 0 WHEN l1 >= l2 THEN 1 ELSE 2 END AS BIGINT) AS label_index, t AS temperature,
       round((l0 - greatest(l0, l1, l2)) / t, 4) AS below_0, round((l1 - greatest(l0, l1, l2)) / t, 4) AS below_1,
       round((l2 - greatest(l0, l1, l2)) / t, 4) AS below_2
FROM raw, te""")

_ALL_LIGHT_TOKENS = (f"SELECT doc_id, CASE WHEN lt = '' THEN []::VARCHAR[] ELSE string_split(lt, ' ') END AS tk "
                     f"FROM (SELECT doc_id, {_LIGHT} AS lt FROM documents)")
oracle("sent_review", f"""
WITH s AS ({_spell(_ALL_LIGHT_TOKENS, 2, 'dist, freq DESC, term', 'text')}),
n AS (SELECT review_key, text, {lexicon_star_sql('text', FX.FX_POSITIVE, FX.FX_NEGATIVE)} AS net FROM s)
SELECT review_key, text,
  CASE WHEN trim(text) = '' THEN 'EMPTY' WHEN net + 3 <= 2 THEN 'NEGATIVE' WHEN net + 3 = 3 THEN 'NEUTRAL' ELSE 'POSITIVE' END
    AS sentiment,
  CASE WHEN trim(text) = '' THEN 0.0 ELSE round({_softmax_max('net')}, 4) END AS confidence FROM n""")

_ASP = f"""(
WITH c AS (SELECT review_key, clause_pos, phrase,
                  CASE WHEN len(string_split_regex(trim(clause), '\\s+')) > 48
                       THEN array_to_string(string_split_regex(trim(clause), '\\s+')[1:48], ' ') || ' ...'
                       ELSE array_to_string(string_split_regex(trim(clause), '\\s+'), ' ') END AS snippet
           FROM {ORDER_CHUNKS} WHERE length(phrase) > 2 AND NOT {in_list('phrase', L.STOP_ASPECTS)}),
a AS (SELECT review_key, phrase, snippet, min(clause_pos) AS first FROM c GROUP BY ALL)
SELECT review_key, row_number() OVER (PARTITION BY review_key ORDER BY first) - 1 AS aspect_pos,
       phrase AS aspect_phrase, snippet AS aspect_snippet FROM a)"""

oracle("rep_counts", f"""SELECT (SELECT count(*) FROM {ORDER_REVIEWS}) AS reviews_in, count(*) AS aspect_rows,
  count(DISTINCT review_key) AS reviews_with_aspects FROM {_ASP}""")


def _hashed(src: str) -> str:
    """Sparse hashed vectors (phrase, bucket, w) of the distinct phrases in ``src``(phrase)."""
    return f"""(WITH p AS (SELECT DISTINCT phrase FROM {src}),
g AS (SELECT phrase, unnest(list_transform(range(1, length(phrase) - 1), lambda i: substr(phrase, i, 3))) AS gram FROM p),
b AS (SELECT phrase, ('0x' || substr(md5(gram), 1, 8))::BIGINT % 64 AS bucket, count(*) AS c FROM g GROUP BY ALL),
n AS (SELECT phrase, sqrt(sum(c * c)) AS nrm FROM b GROUP BY phrase)
SELECT b.phrase, b.bucket, c / nrm AS w FROM b JOIN n USING (phrase))"""


_MAPDIM = """(SELECT keyword, min(pos) AS pos, arg_max(KPI_ID, pos) AS KPI_ID, arg_max(KPI_NAME, pos) AS KPI_NAME,
       arg_max(DEPARTMENT_ID, pos) AS DEPARTMENT_ID, arg_max(DEPARTMENT_NAME, pos) AS DEPARTMENT_NAME FROM (
  SELECT lower(trim(CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE ' ' || p_name || ' ' END)) AS keyword,
         p_partkey AS pos, p_partkey AS KPI_ID, p_brand AS KPI_NAME, CAST(p_size AS BIGINT) AS DEPARTMENT_ID,
         p_type AS DEPARTMENT_NAME FROM part) GROUP BY keyword)"""

def _aspect_table_sql(half: int, source: str) -> str:
    """Chain B with 2 * half + 1 classes: the net word count, clipped to +-half, picks the class."""
    net = f"least({half}, greatest(-{half}, {lexicon_star_sql('aspect_snippet', FX.FX_ASPECT_POSITIVE, FX.FX_ASPECT_NEGATIVE)}))"
    confidence = f"(1.0 / ({' + '.join(f'exp(-abs(net - ({k})))' for k in range(-half, half + 1))}))"
    return f"""
WITH orv AS (SELECT r.review_key, r.text, o.o_custkey AS org FROM {ORDER_REVIEWS} r
             LEFT JOIN orders o ON o.o_orderkey = r.review_key),
asp AS (SELECT a.*, orv.text, orv.org FROM {_ASP} a JOIN orv USING (review_key)),
kd AS {_MAPDIM},
kv AS {_hashed('(SELECT keyword AS phrase FROM kd)')},
av AS {_hashed('(SELECT aspect_phrase AS phrase FROM asp)')},
sims AS (SELECT av.phrase AS ap, kd.pos, sum(av.w * kv.w) AS sim FROM av JOIN kv USING (bucket)
         JOIN kd ON kd.keyword = kv.phrase GROUP BY ALL),
allp AS (SELECT DISTINCT aspect_phrase AS ap FROM asp),
cand AS (SELECT allp.ap, kd.pos, coalesce(sims.sim, 0.0) AS sim FROM allp CROSS JOIN kd
         LEFT JOIN sims ON sims.ap = allp.ap AND sims.pos = kd.pos),
best AS (SELECT ap, pos, sim FROM cand QUALIFY row_number() OVER (PARTITION BY ap ORDER BY round(sim, 12) DESC, pos) = 1),
m AS (SELECT asp.*, kd.keyword AS Matched_Keyword, best.sim, kd.KPI_ID, kd.KPI_NAME, kd.DEPARTMENT_ID, kd.DEPARTMENT_NAME
      FROM asp JOIN best ON best.ap = asp.aspect_phrase JOIN kd ON kd.pos = best.pos),
sc AS (SELECT m.*, {net} AS net FROM m),
sa AS (SELECT *, CASE WHEN net < 0 THEN 'Negative' WHEN net = 0 THEN 'Neutral' ELSE 'Positive' END AS Aspect_Sentiment,
              round({confidence}, 3) AS Confidence_Sentiment, CAST(net + {half} + 1 AS BIGINT) AS Stars FROM sc),
g AS (SELECT review_key, trim(text) AS tx, count(*) AS n,
        count(*) FILTER (WHERE Aspect_Sentiment = 'Positive') AS npos, count(*) FILTER (WHERE Aspect_Sentiment = 'Negative') AS nneg,
        count(*) FILTER (WHERE Aspect_Sentiment = 'Neutral') AS nneu,
        CAST(sum(CASE WHEN Aspect_Sentiment = 'Positive' THEN CAST(round(Confidence_Sentiment * 1000) AS BIGINT) ELSE 0 END) AS BIGINT) AS spos,
        CAST(sum(CASE WHEN Aspect_Sentiment = 'Negative' THEN CAST(round(Confidence_Sentiment * 1000) AS BIGINT) ELSE 0 END) AS BIGINT) AS sneg
      FROM sa GROUP BY ALL),
h AS (SELECT *, (npos + nneg) * 5 >= n * 3 AS polar FROM g),
w AS (SELECT *, CASE WHEN polar THEN greatest(npos, nneg) ELSE greatest(npos, nneg, nneu) END AS mx FROM h),
x AS (SELECT *, npos = mx AS wpos, nneg = mx AS wneg, (NOT polar AND nneu = mx) AS wneu, spos * nneg AS lhs, sneg * npos AS rhs FROM w),
v AS (SELECT review_key, tx,
  CASE WHEN wpos::INT + wneg::INT + wneu::INT = 1 THEN CASE WHEN wpos THEN 'Positive' WHEN wneg THEN 'Negative' ELSE 'Neutral' END
       WHEN wpos AND wneg AND NOT wneu THEN CASE WHEN lhs > rhs THEN 'Positive' WHEN rhs > lhs THEN 'Negative' ELSE 'Neutral' END
       ELSE 'Neutral' END AS rs,
  CASE WHEN wpos::INT + wneg::INT + wneu::INT = 1 THEN 1.0
       WHEN wpos AND wneg AND NOT wneu THEN CASE WHEN lhs > rhs THEN ((2 * spos + npos) // (2 * npos)) / 1000.0
                                                 WHEN rhs > lhs THEN ((2 * sneg + nneg) // (2 * nneg)) / 1000.0 ELSE 0.5 END
       ELSE 0.5 END::DOUBLE AS rc FROM x)
SELECT sa.review_key AS REVIEW_ID, CAST(sa.org AS VARCHAR) AS ORGANIZATION_ID, trim(sa.text) AS Original_Review,
  sa.aspect_phrase AS N_gram, sa.Matched_Keyword, round(sa.sim, 4) AS Cosine_Similarity, CAST(sa.KPI_ID AS VARCHAR) AS KPI_ID,
  sa.KPI_NAME AS KPI_Name, CAST(sa.DEPARTMENT_ID AS VARCHAR) AS Department_ID, sa.DEPARTMENT_NAME AS Department_Name,
  sa.aspect_phrase AS Aspect_Phrase, sa.aspect_snippet AS Aspect_Snippet, sa.Aspect_Sentiment, sa.Confidence_Sentiment,
  sa.Stars, '{source}' AS Sentiment_Source, v.rs AS Review_Sentiment, round(v.rc, 3) AS Review_Confidence,
  'MajorityVote+TieBreak+NeutralFix' AS Aggregation_Method
FROM sa JOIN v ON v.review_key = sa.review_key AND v.tx = trim(sa.text)"""


oracle("aspect_table", _aspect_table_sql(2, "LexiconScorer(aspect-first)"))
oracle("aspect_table_class3", _aspect_table_sql(1, "LexiconScorer(3-class)"))

_ASSIGN = f"""{_FUSE},
acc AS (SELECT fz.vec_id, fz.kpi, fz.department, fz.probability, fz.rule_applied, c.phrase, c.cluster,
               list_filter(string_split(c.phrase, ' '), lambda t: {in_list('t', FX.FX_FUNCTIONAL)}) AS sents,
               len(list_filter(string_split_regex(trim(c.phrase), '\\s+'), lambda w: NOT {in_list('w', FX.FX_GENERIC)})) = 0
                 AS is_generic
        FROM fz JOIN {FXC} c USING (vec_id)
        WHERE fz.probability >= 0.6 AND fz.kpi <> '__noise__' AND fz.noise_probability < 0.5),
lb AS (SELECT b.cluster, array_to_string(list_transform(string_split(
         CASE WHEN nouns <> '' THEN nouns ELSE lower(phrase) END, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS label
       FROM (SELECT cluster, phrase, array_to_string(list_filter(ns, lambda t, i: list_position(ns, t) = i), ' ') AS nouns FROM (
         SELECT cluster, phrase, list_filter(string_split(lower(phrase), ' '), lambda t: NOT {in_list('t', _NONNOUN)}) AS ns FROM (
           SELECT cluster, phrase FROM {_SCORED} WHERE cluster >= 0
           QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY score DESC, length(phrase) DESC, phrase) = 1))) b
       UNION ALL SELECT DISTINCT cluster, 'Noise' FROM {FXC} WHERE cluster = -1),
cr AS (SELECT acc.cluster AS cluster_id, coalesce(lb.label, 'Cluster ' || acc.cluster) AS label,
              1.0 - sum(CASE WHEN NOT is_generic THEN 1 ELSE 0 END) / greatest(count(*), 1) AS generic_ratio,
              count(*) AS n_keywords FROM acc LEFT JOIN lb ON lb.cluster = acc.cluster GROUP BY ALL),
kr AS (SELECT acc.*, row_number() OVER (PARTITION BY cluster ORDER BY probability DESC, phrase) AS rank FROM acc)"""

oracle("rep_clusters", f"""WITH {_ASSIGN} SELECT CAST(cluster_id AS BIGINT) AS cluster_id, label,
  round(generic_ratio, 6) AS generic_ratio, n_keywords FROM cr""")
oracle("sink_json_roundtrip", f"""WITH {_ASSIGN} SELECT CAST(cr.cluster_id AS BIGINT) AS cluster_id, cr.label,
  round(cr.generic_ratio, 6) AS generic_ratio, cr.n_keywords, kr.phrase AS top_phrase
  FROM cr LEFT JOIN kr ON kr.cluster = cr.cluster_id AND kr.rank = 1""")
oracle("rep_cluster_top15", f"""WITH {_ASSIGN} SELECT CAST(cluster AS BIGINT) AS cluster, rank, phrase, kpi, department,
  round(probability, 6) AS probability, CASE WHEN rule_applied THEN 'RULE' ELSE 'MODEL' END AS source,
  array_to_string(sents[1:3], ',') AS sentiments FROM kr WHERE rank <= 15""")
oracle("rep_run_summary", f"""
WITH {_FUSE},
ann2 AS (SELECT c.vec_id FROM {FXC} c JOIN best USING (phrase) WHERE best.confidence >= 0.5 AND c.cluster >= 0),
sz AS (SELECT cluster, count(*) AS size FROM {FXC} GROUP BY cluster),
cm AS ({ORACLES["clf_metrics"]})
SELECT round((SELECT silhouette FROM {silhouette_sql(_PTS)}), 6) AS silhouette,
       round((SELECT davies_bouldin FROM {_DBI}), 6) AS davies_bouldin,
       cm.precision AS classifier_precision, cm.recall AS classifier_recall, cm.f1 AS classifier_f1,
       cm.accuracy AS classifier_accuracy,
       (SELECT count(*) FROM sz WHERE cluster <> -1) AS cluster_count,
       round((SELECT sum(CASE WHEN cluster = -1 THEN size ELSE 0 END) / sum(size) FROM sz), 6) AS noise_ratio,
       (SELECT count(*) FROM fz WHERE probability >= 0.6 AND kpi <> '__noise__' AND noise_probability < 0.5)
         AS total_keywords,
       (SELECT count(*) FROM ann2) AS retained_candidates, 0.6 AS threshold FROM cm""")


# ---------------------------------------------------------------------------
# X (candidate generation; the scored stages have no SQL oracle yet)
# ---------------------------------------------------------------------------
_KX_DOC = (f"coalesce(nullif(text, ''), nullif({norm('text')}, ''), "
           f"nullif(array_to_string({_clean_tokens(norm('text'))}, ' '), ''))")
oracle("kx_document_text", f"SELECT doc_id AS review_key, {_KX_DOC} AS document_text FROM documents WHERE lang = 'en'")
oracle("kx_candidates", f"""
WITH d AS (SELECT doc_id, list_filter(regexp_extract_all(lower({_KX_DOC}), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
                                      lambda t: NOT {in_list('t', L.ENGLISH_STOPWORDS)}) AS k
           FROM documents WHERE lang = 'en'),
g AS (SELECT doc_id, unnest(k) AS phrase FROM d
      UNION ALL SELECT doc_id, unnest(list_transform(range(greatest(len(k) - 1, 0)), lambda i: k[i + 1] || ' ' || k[i + 2])) FROM d
      UNION ALL SELECT doc_id, unnest(list_transform(range(greatest(len(k) - 2, 0)),
                                                     lambda i: k[i + 1] || ' ' || k[i + 2] || ' ' || k[i + 3])) FROM d)
SELECT DISTINCT doc_id AS review_key, phrase FROM g""")

_KX_CAND = ORACLES["kx_candidates"]
oracle("kx_rank_candidates", f"""
WITH d AS (SELECT doc_id, {_KX_DOC} AS doc FROM documents WHERE lang = 'en'),
dg AS (SELECT doc_id, unnest(list_transform(range(greatest(len(ch) - 2, 0)),
                                            lambda i: ch[i + 1] || ch[i + 2] || ch[i + 3])) AS g
       FROM (SELECT doc_id, string_split(doc, '') AS ch FROM d)),
db AS (SELECT doc_id, ('0x' || substr(md5(g), 1, 8))::BIGINT % 64 AS b, count(*) AS c FROM dg GROUP BY ALL),
dn AS (SELECT doc_id, sqrt(sum(c * c)) AS nrm FROM db GROUP BY doc_id),
du AS (SELECT db.doc_id, b, c / nrm AS w FROM db JOIN dn USING (doc_id)),
cand AS (SELECT review_key AS doc_id, phrase FROM ({_KX_CAND})),
pg AS (SELECT doc_id, phrase, unnest(list_transform(range(greatest(length(phrase) - 2, 0)),
                                                    lambda i: substr(phrase, i + 1, 3))) AS g FROM cand),
pb AS (SELECT doc_id, phrase, ('0x' || substr(md5(g), 1, 8))::BIGINT % 64 AS b, count(*) AS c FROM pg GROUP BY ALL),
pn AS (SELECT doc_id, phrase, sqrt(sum(c * c)) AS nrm FROM pb GROUP BY ALL),
dt AS (SELECT pb.doc_id, pb.phrase, sum(pb.c * du.w) AS dp FROM pb JOIN du ON du.doc_id = pb.doc_id AND du.b = pb.b
       GROUP BY ALL),
sc AS (SELECT cand.doc_id, cand.phrase,
              CASE WHEN pn.nrm IS NULL OR pn.nrm = 0 THEN 0.0 ELSE round(coalesce(dt.dp, 0.0) / pn.nrm, 12) END AS score
       FROM cand LEFT JOIN pn USING (doc_id, phrase) LEFT JOIN dt USING (doc_id, phrase)),
rk AS (SELECT doc_id, phrase, score,
              row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, phrase) - 1 AS cand_rank FROM sc
       QUALIFY cand_rank < 30)
SELECT doc_id AS review_key, CAST(cand_rank AS BIGINT) AS cand_rank, phrase, round(score, 6) AS score FROM rk""")

_JJ = sorted(w for w, t, _l, _e in FX.fx_token_lexicon_rows() if t.startswith("JJ"))
_OTHER = sorted(w for w, t, _l, _e in FX.fx_token_lexicon_rows() if not t.startswith("JJ") and not t.startswith("NN"))
_SUF = " OR ".join(f"suffix(t, {q(s)})" for s in L.ABSTRACT_SUFFIXES)
_IS_NOUN = f"(NOT {in_list('t', _JJ)} AND NOT {in_list('t', _OTHER)})"
_IS_ABS = (f"({in_list('t', L.ABSTRACT_IDEA_NOUNS)} OR {_SUF} OR "
           f"(NOT coalesce(w.any_c, FALSE) AND coalesce(w.any_a, FALSE)))")
_IS_CONC = (f"({in_list('t', L.HOTEL_DOMAIN_NOUNS)} OR (NOT {in_list('t', L.NOISE_NOUNS)} AND "
            f"NOT {in_list('t', L.ABSTRACT_IDEA_NOUNS)} AND NOT {_IS_ABS}))")
oracle("kx_reject_reason", f"""
WITH rk AS MATERIALIZED ({ORACLES["kx_rank_candidates"].replace("round(score, 6) AS score", "score").replace("cand AS (", "cand AS MATERIALIZED (")}),
sx AS (SELECT * FROM {_SENSES} UNION ALL SELECT term, 1, 'noun.artifact' FROM {_VOCAB}),
w AS MATERIALIZED (SELECT lemma, count(*) AS n, bool_or({in_list('domain', L.CONCRETE_DOMAINS)}) AS any_c,
             bool_or({in_list('domain', L.ABSTRACT_DOMAINS)}) AS any_a FROM sx GROUP BY lemma),
ct AS MATERIALIZED (SELECT review_key, cand_rank, phrase, score,
              list_filter(list_transform(string_split(phrase, ' '), lambda t: regexp_replace(lower(t), '[^a-z]+', '', 'g')),
                          lambda t: t <> '') AS toks FROM rk),
tt AS (SELECT review_key, cand_rank, unnest(toks) AS t FROM ct),
agg AS (SELECT tt.review_key, tt.cand_rank,
          bool_or({in_list('t', L.PRAISE_TARGETS)}) AS any_praise, bool_or({_IS_NOUN}) AS any_noun,
          bool_or({in_list('t', L.NOISE_NOUNS)}) AS any_noise, bool_or({_IS_ABS}) AS any_abs,
          bool_and({in_list('t', L.GENERIC_PHRASE_COMPONENTS)}) AS all_generic,
          bool_or({in_list('t', _JJ)} AND NOT {in_list('t', L.FUNCTIONAL_ADJECTIVES)}) AS bad_adj,
          bool_or({in_list('t', _OTHER)}) AS any_other,
          bool_or({_IS_NOUN} AND ({in_list('t', L.ASPECT_NOUN_WHITELIST | L.HOTEL_DOMAIN_NOUNS)} OR {_IS_CONC})) AS allowed,
          bool_or({_IS_NOUN} AND coalesce(w.n, 0) >= 2) AS multi,
          bool_and(w.lemma IS NULL) AS no_sense
        FROM tt LEFT JOIN w ON w.lemma = tt.t GROUP BY ALL)
SELECT ct.review_key, ct.cand_rank, ct.phrase,
  CASE WHEN len(ct.toks) = 0 THEN 'pattern' WHEN ct.score < 0.6 THEN 'similarity' WHEN any_praise THEN 'praise'
       WHEN NOT any_noun THEN 'pattern' WHEN any_noise THEN 'noise' WHEN any_abs THEN 'abstract'
       WHEN all_generic THEN 'generic' WHEN bad_adj THEN 'sentiment' WHEN any_other THEN 'other_tag'
       WHEN NOT allowed AND NOT multi THEN 'sense' WHEN no_sense THEN 'wordnet' END AS reason
FROM ct LEFT JOIN agg USING (review_key, cand_rank)""")

_KX_REASON = ORACLES["kx_reject_reason"].replace(
    "SELECT ct.review_key, ct.cand_rank, ct.phrase,\n  CASE", "SELECT ct.review_key, ct.cand_rank, ct.phrase, ct.score, ct.toks,\n  CASE")
_KX_SEL = f"""WITH r AS ({_KX_REASON}),
k AS (SELECT *, row_number() OVER (PARTITION BY review_key ORDER BY cand_rank) AS kept_rank FROM r WHERE reason IS NULL
      QUALIFY kept_rank <= 6)"""
oracle("kx_top_per_doc", f"""{_KX_SEL}
SELECT k.review_key, d.source AS source_id, CAST(k.kept_rank AS BIGINT) AS kept_rank, k.phrase, round(k.score, 6) AS score
FROM k JOIN documents d ON d.doc_id = k.review_key""")
oracle("kx_sentiments", f"""WITH r AS ({_KX_REASON})
SELECT review_key, phrase, array_to_string(list_filter(toks, lambda t: {in_list('t', _JJ)} AND
  {in_list('t', L.FUNCTIONAL_ADJECTIVES)}), ',') AS sentiments FROM r WHERE reason IS NULL""")
oracle("kx_doc_freq", f"""{_KX_SEL} SELECT phrase, count(*) AS count, count(*) AS doc_freq FROM k GROUP BY phrase""")
oracle("kx_raw_counts", f"""WITH r AS ({_KX_REASON}) SELECT CAST(len(toks) AS BIGINT) AS n_tokens, count(*) AS n FROM r
GROUP BY ALL""")

_ALLOWED = L.ASPECT_NOUN_WHITELIST | L.HOTEL_DOMAIN_NOUNS
oracle("kx_prune_freq", f"""{_KX_SEL},
f AS (SELECT phrase, count(*) AS cnt FROM k GROUP BY phrase),
nd AS (SELECT greatest(count(*), 1) AS n FROM documents WHERE lang = 'en')
SELECT k.review_key, k.phrase, f.cnt AS count, f.cnt AS doc_freq,
  CASE WHEN len(string_split(k.phrase, ' ')) > 1 AND f.cnt < 2 THEN 'docfreq_low'
       WHEN f.cnt / nd.n > 0.25 AND NOT list_bool_or(list_transform(string_split(k.phrase, ' '),
            lambda t: {in_list('t', _ALLOWED)})) THEN 'docfreq_high' END AS prune
FROM k JOIN f USING (phrase), nd""")
oracle("kx_top_phrases", f"""{_KX_SEL}, f AS (SELECT phrase, count(*) AS n FROM k GROUP BY phrase)
SELECT row_number() OVER (ORDER BY n DESC, phrase) AS rank, phrase, n FROM f QUALIFY rank <= 10""")

_EX_REASONS = ["noise", "abstract", "pattern", "generic", "sentiment", "docfreq_high", "docfreq_low", "wordnet", "praise"]
oracle("kx_drop_examples", f"""
WITH pr AS ({ORACLES["kx_prune_freq"]}),
r AS ({_KX_REASON}),
u AS (SELECT reason, phrase FROM r WHERE {in_list('reason', _EX_REASONS)}
      UNION ALL SELECT prune, phrase FROM pr WHERE prune IS NOT NULL),
c AS (SELECT reason, phrase, count(*) AS n FROM u GROUP BY ALL)
SELECT reason, row_number() OVER (PARTITION BY reason ORDER BY n DESC, phrase) AS rank, phrase, n FROM c
QUALIFY rank <= 10""")

_FUNNEL_R = ["pattern", "similarity", "praise", "noise", "abstract", "generic", "other_tag", "sense", "wordnet"]
_funnel_rows = [
    ("raw_candidates", "(SELECT count(*) FROM r)"),
    ("raw_unigrams", "(SELECT count(*) FROM r WHERE len(toks) = 1)"),
    ("raw_bigrams", "(SELECT count(*) FROM r WHERE len(toks) = 2)"),
    ("raw_trigrams", "(SELECT count(*) FROM r WHERE len(toks) >= 3)"),
    *[(f"{x}_pruned", f"(SELECT count(*) FROM r WHERE reason = {q(x)})") for x in _FUNNEL_R],
    ("sentiment_captured", "(SELECT count(*) FROM r WHERE reason = 'sentiment')"),
    ("unique_candidates", "(SELECT count(DISTINCT phrase) FROM k)"),
    ("low_freq_pruned", "(SELECT count(*) FROM pr WHERE prune = 'docfreq_low')"),
    ("high_docfreq_pruned", "(SELECT count(*) FROM pr WHERE prune = 'docfreq_high')"),
    ("post_freq_candidates", "(SELECT count(DISTINCT phrase) FROM pr WHERE prune IS NULL)"),
    ("final_records", "(SELECT count(*) FROM pr WHERE prune IS NULL)"),
    ("documents", "(SELECT greatest(count(*), 1) FROM documents WHERE lang = 'en')"),
    ("token_pruned", "0"),
    ("accepted", "(SELECT count(*) FROM pr WHERE prune IS NULL)"),
]
oracle("kx_funnel", f"""{_KX_SEL},
pr AS ({ORACLES["kx_prune_freq"]})
""" + " UNION ALL ".join(f"SELECT {q(m)} AS metric, CAST({e} AS BIGINT) AS value" for m, e in _funnel_rows))

oracle("src_reviews_csv", """SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS VARCHAR) AS source_id, coalesce(text, '') AS text
  FROM documents""")
oracle("dim_label_list_csv", """SELECT p_name AS label, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part
  WHERE p_partkey % 7 <> 0""")

oracle("clu_density", """
WITH RECURSIVE p AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT a.vec_id AS i, b.vec_id AS j FROM p a, p b WHERE list_distance(a.v, b.v) <= 0.9),
core AS (SELECT i FROM n GROUP BY i HAVING count(*) >= 2),
e AS (SELECT n.i, n.j FROM n JOIN core USING (i) JOIN core k ON k.i = n.j),
r(i, root) AS (SELECT i, j FROM e UNION SELECT r.i, e.j FROM r JOIN e ON e.i = r.root),
m AS (SELECT i, min(root) AS root FROM r GROUP BY i),
o AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster FROM m GROUP BY root HAVING count(*) >= 2)
SELECT p.vec_id, CAST(coalesce(o.cluster, -1) AS BIGINT) AS cluster FROM p LEFT JOIN m ON m.i = p.vec_id LEFT JOIN o USING (root)""")
