"""For each query the SQL that DuckDB must answer alike, written from the rules and not from the Spark code."""

from __future__ import annotations

import re

from catalog.dirty import dirty_cte
from catalog.queries import EMPTY_SQL, HEADERS_SQL, QUESTION_TEXT_SQL
from gritsieve.constants import NUMERIC_CODES, TEXT_CODES

ORACLES: dict[str, str] = {}

COLUMNS = [
    "respondent_id", "respondent_name", "age", "gender", "state", "Q1", "Q7_Part_1", "Q7_Part_2", "Q7_Part_3",
    "Q9_followup", "monthly_income", "survey_date", "treatment_arm", "outcome", "consent", "free_text_comment",
]
MEMBERS = ["Q7_Part_1", "Q7_Part_2", "Q7_Part_3"]
TEXTS = [c for c in COLUMNS if c != "monthly_income"]
BLANKS = (
    r"chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)||chr(5760)"
    + "".join(f"||chr({i})" for i in [*range(8192, 8203), 8232, 8233, 8239, 8287, 12288])
)
NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)$"


def norm(c: str) -> str:
    return f"lower(trim({c}, {BLANKS}))"


def number(c: str) -> str:
    return f"CASE WHEN regexp_matches(trim({c}), '{NUMBER}') THEN TRY_CAST(trim({c}) AS DOUBLE) END"


def date_like(c: str) -> str:
    t = f"trim({c}, {BLANKS})"
    return (
        f"(regexp_matches({t}, '[0-9]') AND (length(regexp_replace({t}, '[^/.-]', '', 'g')) >= 2 "
        rf"OR regexp_matches({t}, '(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)')))"
    )


MONTH_FIRST = "['%Y-%m-%d', '%Y/%m/%d', '%m/%d/%Y', '%d/%m/%Y', '%m-%d-%Y', '%d-%m-%Y']"
DAY_FIRST = "['%Y-%m-%d', '%Y/%m/%d', '%d/%m/%Y', '%m/%d/%Y', '%d-%m-%Y', '%m-%d-%Y']"
DIRTY = dirty_cte()
GENDER = "CASE WHEN gender IN ('m', 'Man', '1') THEN 'Male' WHEN gender IN ('f', 'Woman', '2') THEN 'Female' ELSE gender END"
STATE = "CASE WHEN state IN ('  Lagos', 'LAGOS', 'lagos') THEN 'Lagos' ELSE state END"
LEVELS = "['strongly disagree', 'disagree', 'neutral', 'agree', 'strongly agree']"
ORDINAL = f"CAST(list_position({LEVELS}, lower(Q1)) AS BIGINT)"

# The cleaned table: members folded, constant dropped, codes blanked, types fixed, spellings merged; then first of equals.
STEPS = f"""
steps AS (
  SELECT row_id, respondent_id, respondent_name,
    CASE WHEN age NOT IN ('999', 'Prefer not to say') THEN CAST(age AS DOUBLE) END AS age,
    {GENDER} AS gender, {STATE} AS state, lower(Q1) AS Q1, Q7_Part_1, Q7_Part_2, Q7_Part_3, Q9_followup,
    CASE WHEN monthly_income <> -99 THEN monthly_income END AS monthly_income,
    try_strptime(survey_date, {MONTH_FIRST}) AS survey_date, treatment_arm, outcome,
    CASE WHEN free_text_comment NOT IN ('', '-', 'Don''t know', 'N/A') THEN free_text_comment END AS free_text_comment,
    CAST((Q7_Part_1 IS NOT NULL)::INT + (Q7_Part_2 IS NOT NULL)::INT + (Q7_Part_3 IS NOT NULL)::INT AS BIGINT) AS Q7_count,
    concat_ws(', ', Q7_Part_1, Q7_Part_2, Q7_Part_3) AS Q7_selected, {ORDINAL} AS Q1__ord
  FROM dirty
)"""
CLEAN = f"""{DIRTY},{STEPS},
clean AS (SELECT min(row_id) AS row_id, * EXCLUDE (row_id) FROM steps GROUP BY ALL)"""
CLEAN_COLUMNS = [c for c in COLUMNS if c != "consent"] + ["Q7_count", "Q7_selected"]


def dirty(name: str, body: str) -> None:
    ORACLES[name] = f"WITH {DIRTY} {body}"


def clean(name: str, body: str, more: str = "") -> None:
    ORACLES[name] = f"WITH {CLEAN}{more} {body}"


# Cell functions

ORACLES["fn_norm"] = f"SELECT doc_id, md5({norm('text')}) AS norm_md5 FROM documents"
ORACLES["fn_name_tokens"] = (
    "SELECT page_id, lower(trim(regexp_replace(regexp_replace(url, '([a-z])([A-Z])', '\\1 \\2', 'g'), "
    "'[_\\-./]+', ' ', 'g'))) AS tokens FROM pages"
)
dirty("fn_date_shape", "SELECT regexp_replace(survey_date, '[0-9]', 'd', 'g') AS shape, count(*) AS n FROM dirty GROUP BY 1")
dirty("fn_looks_like_date", f"""
, cells AS (
  SELECT survey_date AS t FROM dirty UNION ALL SELECT age FROM dirty UNION ALL SELECT free_text_comment FROM dirty
  UNION ALL SELECT CAST(monthly_income AS VARCHAR) FROM dirty)
SELECT regexp_replace(t, '[0-9]', 'd', 'g') AS shape, {date_like('t')} AS is_date, count(*) AS n
FROM cells WHERE t IS NOT NULL GROUP BY 1, 2""")
dirty("fn_number", f"""
, cells AS (
  SELECT survey_date AS t FROM dirty UNION ALL SELECT age FROM dirty UNION ALL SELECT free_text_comment FROM dirty
  UNION ALL SELECT gender FROM dirty)
SELECT t AS text, {number('t')} AS number, count(*) AS n FROM cells WHERE t IS NOT NULL GROUP BY 1, 2""")
ORACLES["fn_hash_prefix"] = "SELECT c_custkey, substr(sha256(c_name), 1, 12) AS name_hash FROM customer"

# Cleaning operators

dirty("clean_promote_header_row", """
SELECT row_id, respondent_id FROM dirty WHERE row_id NOT IN (SELECT row_id FROM dirty ORDER BY row_id LIMIT 3)""")
ORACLES["clean_drop_repeated_header_rows"] = f"""WITH {DIRTY}, more AS ({HEADERS_SQL.format(dirty='dirty')})
SELECT row_id, age, gender, Q1 FROM more WHERE {' + '.join(
    f"coalesce({norm(f'CAST({c} AS VARCHAR)')} = '{c.lower()}', false)::INT" for c in COLUMNS)} < 8"""
ORACLES["clean_drop_empty_rows"] = f"""WITH {DIRTY}, more AS ({EMPTY_SQL.format(dirty='dirty')})
SELECT row_id, age, monthly_income FROM more WHERE NOT ({' AND '.join(f'{c} IS NULL' for c in COLUMNS)})"""
ORACLES["clean_drop_column"] = "SELECT * EXCLUDE (o_orderstatus) FROM orders"
ORACLES["clean_rename_column"] = "SELECT * RENAME (c_acctbal AS balance) FROM customer"
dirty("clean_drop_constant_columns", "SELECT * EXCLUDE (consent, free_text_comment, survey_date) FROM dirty")
dirty("clean_collapse_multiselect", """
SELECT row_id, Q7_Part_1, Q7_Part_2, Q7_Part_3,
  CAST((Q7_Part_1 IS NOT NULL)::INT + (Q7_Part_2 IS NOT NULL)::INT + (Q7_Part_3 IS NOT NULL)::INT AS BIGINT) AS Q7_count,
  concat_ws(', ', Q7_Part_1, Q7_Part_2, Q7_Part_3) AS Q7_selected FROM dirty""")
ORACLES["clean_recode_sentinel_missing"] = (
    f"WITH {DIRTY}, {STEPS} SELECT row_id, age, monthly_income, free_text_comment FROM steps"
)
dirty("clean_order_likert", f"SELECT row_id, lower(Q1) AS Q1, {ORDINAL} AS Q1__ord FROM dirty")
dirty("clean_coerce_numeric", f"SELECT row_id, {number('age')} AS age FROM dirty")
dirty("clean_coerce_datetime", f"""
SELECT row_id, try_strptime(survey_date, {MONTH_FIRST}) AS survey_date,
  try_strptime(survey_date, {DAY_FIRST}) AS day_first FROM dirty""")
dirty("clean_strip_whitespace", "SELECT row_id, trim(state) AS state FROM dirty")
dirty("clean_map_categories", f"SELECT row_id, {GENDER} AS gender, {STATE} AS state FROM dirty")
dirty("clean_drop_duplicates", f"""
SELECT row_id, respondent_id, age, monthly_income
FROM (SELECT min(row_id) AS row_id, * EXCLUDE (row_id) FROM dirty GROUP BY ALL)""")
AGE = "CASE WHEN age NOT IN ('999', 'Prefer not to say') THEN CAST(age AS DOUBLE) END"
for method, fill in {
    "median": "(SELECT quantile_cont(a, 0.5) FROM ages)",
    "mean": "(SELECT avg(a) FROM ages)",
    "mode": "(SELECT a FROM ages WHERE a IS NOT NULL GROUP BY a ORDER BY count(*) DESC, a LIMIT 1)",
}.items():
    dirty(
        f"clean_fill_missing_{method}",
        f", ages AS (SELECT row_id, {AGE} AS a FROM dirty) SELECT row_id, round(coalesce(a, {fill}), 6) AS age FROM ages",
    )
dirty("clean_fill_missing_constant", "SELECT row_id, coalesce(outcome, 'unknown') AS outcome FROM dirty")
dirty("clean_clip_outliers", f"""
, ages AS (SELECT row_id, {number('age')} AS a, monthly_income AS m FROM dirty)
SELECT row_id, CASE WHEN a < 20 THEN 20 WHEN a > 70 THEN 70 ELSE a END AS age,
  CASE WHEN m < 0 THEN 0 WHEN m > 300000 THEN 300000 ELSE m END AS monthly_income FROM ages""")
dirty("clean_flag_out_of_range", f"""
, ages AS (SELECT row_id, {number('age')} AS age FROM dirty)
SELECT row_id, age, coalesce(age < 0 OR age > 120, false) AS age_out_of_range FROM ages""")
ORACLES["clean_flag_date_order"] = """
SELECT coalesce(l_shipdate < o_orderdate, false) AS l_shipdate_before_o_orderdate, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"""
dirty("clean_deidentify", "SELECT row_id, substr(sha256(respondent_id), 1, 12) AS respondent_id, age FROM dirty")

# Profile and score


def profile_sql(source: str, names: list[str], texts: list[str], order: str | None, sample: bool = True) -> str:
    parts = []
    for c in names:
        text = f"CAST({c} AS VARCHAR)"
        if order:
            firsts = (
                f"(SELECT string_agg(v, '|' ORDER BY f) FROM (SELECT {text} AS v, min({order}) AS f FROM {source} "
                f"WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY f LIMIT 5))"
            )
            shown = f", coalesce({firsts}, '') AS sample"
        else:
            shown = ""
        parts.append(f"""
SELECT '{c}' AS "column", count(*) AS n_rows, count(*) - count({c}) AS n_missing,
  round((count(*) - count({c})) / count(*), 9) AS pct_missing, count(DISTINCT {c}) AS n_unique,
  count(DISTINCT {c}) + (count({c}) < count(*))::INT AS n_unique_with_na,
  count(DISTINCT {c}) + (count({c}) < count(*))::INT <= 1 AS is_constant,
  {'count(DISTINCT ' + c + ') > 50' if c in texts else 'false'} AS is_free_text{shown} FROM {source}""")
    return " UNION ALL ".join(parts)


dirty("profile_columns", profile_sql("dirty", COLUMNS, TEXTS, "row_id"))
ORACLES["profile_orders"] = profile_sql(
    "orders",
    ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    ["o_orderstatus", "o_orderpriority"], None,
)
ORACLES["profile_lineitem"] = profile_sql(
    "lineitem",
    [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate",
    ],
    ["l_returnflag", "l_linestatus"], None,
)
ORACLES["profile_documents"] = profile_sql(
    "documents", ["doc_id", "text", "lang", "source", "n_chars"], ["text", "lang", "source"], None
)
ORACLES["profile_embeddings"] = profile_sql("embeddings", ["vec_id", "embedding", "label"], [], None)

DUPLICATES = "(SELECT count(*) FROM dirty) - (SELECT count(*) FROM (SELECT DISTINCT * EXCLUDE (row_id) FROM dirty))"
dirty("duplicate_count", f"SELECT {DUPLICATES} AS n_duplicates")
BLANK_CELLS = " + ".join(f"count(*) - count({c})" for c in COLUMNS)
BREAKDOWN = f"""
, counted AS (
  SELECT count(*) AS n_rows, CAST({len(COLUMNS)} AS BIGINT) AS n_cols, CAST({BLANK_CELLS} AS BIGINT) AS missing_cells,
    {DUPLICATES} AS duplicate_rows, CAST({' + '.join(
        f"(count(DISTINCT {c}) + (count({c}) < count(*))::INT <= 1)::INT" for c in COLUMNS)} AS BIGINT) AS constant_columns
  FROM dirty)"""


def coded_values(source: str = "dirty", columns: list[str] = COLUMNS, texts: list[str] = TEXTS) -> str:
    """Every (column, value) that is a missing-data code, with its confidence after the majority rule."""
    words = ", ".join(
        "('" + code.replace("'", "''") + f"', {conf})" for code, conf in TEXT_CODES.items()
    )
    digits = ", ".join(f"(CAST('{code}' AS DOUBLE), {conf})" for code, conf in NUMERIC_CODES.items())
    counts = " UNION ALL ".join(
        f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS v, {'true' if c in texts else 'false'} AS is_text, count(*) AS n "
        f"FROM {source} WHERE {c} IS NOT NULL GROUP BY 2"
        for c in columns
    )
    return f"""
, words(w, wc) AS (VALUES {words}), digits(d, dc) AS (VALUES {digits}), vc AS ({counts}),
coded AS (
  SELECT col, v, n, CASE WHEN n / (SELECT count(*) FROM {source}) > 0.5 THEN raw * 0.4 ELSE raw END AS conf
  FROM (SELECT vc.*, coalesce(CASE WHEN is_text THEN wc END, dc) AS raw
        FROM vc LEFT JOIN words ON {norm('v')} = w LEFT JOIN digits ON {number('v')} = d) WHERE raw IS NOT NULL),
hits AS (SELECT * FROM coded WHERE conf >= 0.5)"""


SCORE = """
, coded_columns AS (SELECT count(DISTINCT col) AS sentinel_columns FROM hits)"""
dirty("score_breakdown", BREAKDOWN + coded_values() + SCORE + " SELECT * FROM counted, coded_columns")
FORMULA = (
    "CAST(round_even(100 - missing_cells / (n_rows * n_cols) * 40 - duplicate_rows / n_rows * 20 "
    "- constant_columns / n_cols * 15 - least(sentinel_columns * 3, 25), 0) AS BIGINT)"
)
dirty("quality_score", BREAKDOWN + coded_values() + SCORE + f" SELECT {FORMULA} AS score FROM counted, coded_columns")
AFTER_BLANKS = " + ".join(f"count(*) - count({c})" for c in CLEAN_COLUMNS)
CODED_AFTER = coded_values("clean", CLEAN_COLUMNS, [c for c in CLEAN_COLUMNS if c not in ("age", "monthly_income", "survey_date", "Q1", "Q7_count")])
for word in ("words", "digits", "vc", "coded", "hits"):
    CODED_AFTER = re.sub(rf"\b{word}\b", word + "2", CODED_AFTER)
ORACLES["scorecard"] = f"""WITH {CLEAN} {BREAKDOWN} {coded_values()} {SCORE} {CODED_AFTER},
later AS (
  SELECT count(*) AS n_rows, CAST({len(CLEAN_COLUMNS)} AS BIGINT) AS n_cols, CAST({AFTER_BLANKS} AS BIGINT) AS missing_cells,
    CAST(0 AS BIGINT) AS duplicate_rows, CAST(0 AS BIGINT) AS constant_columns,
    (SELECT count(DISTINCT col) FROM hits2) AS sentinel_columns FROM clean),
before_score AS (SELECT {FORMULA} AS score, * FROM counted, coded_columns),
after_score AS (SELECT {FORMULA} AS score, * FROM later)
{' UNION ALL '.join(
    f"SELECT '{m}' AS measure, b.{m} AS before, a.{m} AS after, a.{m} - b.{m} AS change FROM before_score b, after_score a"
    for m in ("score", "n_rows", "n_cols", "duplicate_rows"))}"""
SMALL_TEXTS = [c for c in CLEAN_COLUMNS if c not in ("age", "monthly_income", "survey_date", "Q7_count", "Q1")]
LISTED = "CASE WHEN count(DISTINCT {0}) BETWEEN 1 AND 60 THEN string_agg(DISTINCT {0}, '|' ORDER BY {0}) END"
clean("schema_summary", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {'true' if c == 'Q1' else 'false'} AS is_ordered, """
    + (f"array_to_string({LEVELS}, '|')" if c == "Q1" else LISTED.format(c) if c in SMALL_TEXTS else "CAST(NULL AS VARCHAR)")
    + " AS levels FROM clean HAVING count(*) > 0"
    for c in CLEAN_COLUMNS
))

# Detectors

ORACLES["detect_two_row_header"] = f"""
WITH t AS ({QUESTION_TEXT_SQL.format(orders='orders')}), first AS (SELECT * FROM t ORDER BY row_id LIMIT 1),
rest AS (SELECT * FROM t WHERE row_id > (SELECT row_id FROM first)),
long_cells AS (SELECT (length(Q1) > 40)::INT + (length(Q2) > 40)::INT AS k FROM first),
rescued AS (SELECT (avg(({number('Q1')} IS NOT NULL)::INT) > 0.8)::INT + (avg(({number('Q2')} IS NOT NULL)::INT) > 0.8)::INT AS r FROM rest)
SELECT 'two_row_header' AS kind, '<table>' AS "column", round(least(0.60 + k / 2 * 0.3 + r / 2 * 0.2, 0.97), 6) AS confidence,
  CAST(1 AS BIGINT) AS n_affected, 'promote_header_row' AS op FROM long_cells, rescued WHERE k / 2 >= 0.3"""

SENTINEL = """
SELECT 'sentinel_missing' AS kind, col AS "column", CAST(max(conf) AS DOUBLE) AS confidence, CAST(sum(n) AS BIGINT) AS n_affected,
  'recode_sentinel_missing' AS op"""
dirty("detect_sentinel_missing", coded_values() + SENTINEL + """, string_agg(v, '|' ORDER BY v) AS "values" FROM hits GROUP BY col, conf""")

SCALES_SQL = """
, scales(scale_no, place, lvl) AS (
  SELECT s, generate_subscripts(l, 1), unnest(l) FROM (VALUES
    (1, ['strongly disagree', 'disagree', 'neutral', 'agree', 'strongly agree']),
    (2, ['strongly disagree', 'disagree', 'somewhat disagree', 'neutral', 'somewhat agree', 'agree', 'strongly agree']),
    (3, ['never', 'rarely', 'sometimes', 'often', 'always']),
    (4, ['never', 'rarely', 'monthly', 'weekly', 'daily', 'multiple times a day']),
    (5, ['very dissatisfied', 'dissatisfied', 'neutral', 'satisfied', 'very satisfied']),
    (6, ['very poor', 'poor', 'fair', 'good', 'excellent']),
    (10, ['no', 'yes'])) x(s, l))"""


def text_counts() -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS col, {c} AS v, {norm(c)} AS nv, count(*) AS n, min(row_id) AS f FROM dirty WHERE {c} IS NOT NULL GROUP BY 2, 3"
        for c in TEXTS
    )


LIKERT = f"""
, tc AS ({text_counts()}), answers AS (SELECT col, nv, sum(n) AS n FROM tc GROUP BY 1, 2),
d AS (SELECT col, count(*) AS d FROM answers GROUP BY 1 HAVING count(*) BETWEEN 2 AND 8) {SCALES_SQL},
matched AS (
  SELECT a.col, scale_no, count(*) / max(d.d) AS share, CAST(sum(n) AS BIGINT) AS n_affected, string_agg(lvl, '|' ORDER BY place) AS ord
  FROM answers a JOIN d USING (col) JOIN scales ON nv = lvl GROUP BY 1, 2),
best AS (SELECT * FROM matched QUALIFY row_number() OVER (PARTITION BY col ORDER BY share DESC, scale_no) = 1),
likert AS (SELECT 'likert_scale' AS kind, col AS "column", round_even(least(share, 0.95), 2) AS confidence, n_affected,
  'order_likert' AS op, ord AS "order" FROM best WHERE share >= 0.75)"""
dirty("detect_likert_scale", LIKERT + " SELECT * FROM likert")

SYNONYMS = f"""
, tc AS ({text_counts()}), d AS (SELECT col, count(DISTINCT nv) AS d FROM tc GROUP BY 1 HAVING count(DISTINCT nv) BETWEEN 3 AND 14),
vocab(vno, answer, alias) AS (
  SELECT 1, 'Yes', unnest(['yes', 'y', 'true', 't', '1', '1.0', 'positive', 'present', 'affirmative']) UNION ALL
  SELECT 1, 'No', unnest(['no', 'n', 'false', 'f', '0', '0.0', 'negative', 'absent', 'nil']) UNION ALL
  SELECT 2, 'Male', unnest(['male', 'm', 'man', 'boy', '1', '1.0']) UNION ALL
  SELECT 2, 'Female', unnest(['female', 'f', 'woman', 'girl', '2', '2.0'])),
hit AS (SELECT tc.*, d, vno, answer FROM tc JOIN d USING (col) JOIN vocab ON nv = alias),
scored AS (
  SELECT col, vno, count(DISTINCT nv) AS known, max(d) AS d,
    count(DISTINCT nv) / max(d) + CASE WHEN vno = 2 AND col IN ('gender') THEN 0.3 ELSE 0 END AS score
  FROM hit GROUP BY 1, 2 HAVING count(DISTINCT nv) / max(d) >= 0.6 AND count(DISTINCT answer) = 2),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY col ORDER BY score DESC, vno) = 1),
synonyms AS (
  SELECT 'value_synonyms' AS kind, hit.col AS "column", CAST(CASE WHEN max(best.d) - max(known) <= 2 THEN 0.93 ELSE 0.85 END AS DOUBLE) AS confidence,
    CAST(sum(n) AS BIGINT) AS n_affected, 'map_categories' AS op, string_agg(v || '=>' || answer, '|' ORDER BY v) AS mapping
  FROM hit JOIN best ON hit.col = best.col AND hit.vno = best.vno WHERE v <> answer GROUP BY hit.col)"""
dirty("detect_value_synonyms", SYNONYMS + " SELECT * FROM synonyms")

VARIANTS = f"""
, tc AS ({text_counts()}), d AS (SELECT col FROM tc GROUP BY 1 HAVING count(*) BETWEEN 2 AND 60),
spelled AS (
  SELECT tc.*, row_number() OVER w AS place, first_value(v) OVER w AS main FROM tc JOIN d USING (col)
  WINDOW w AS (PARTITION BY col, nv ORDER BY n DESC, f)),
variants AS (
  SELECT 'case_variants' AS kind, col AS "column", CAST(0.92 AS DOUBLE) AS confidence, CAST(sum(n) AS BIGINT) AS n_affected,
    'map_categories' AS op, string_agg(v || '=>' || main, '|' ORDER BY v) AS mapping
  FROM spelled WHERE place > 1 GROUP BY col)"""
dirty("detect_case_variants", VARIANTS + " SELECT * FROM variants")

ORACLES["detect_repeated_header_row"] = f"""WITH {DIRTY}, more AS ({HEADERS_SQL.format(dirty='dirty')})
SELECT 'repeated_header_row' AS kind, '<table>' AS "column", CAST(0.95 AS DOUBLE) AS confidence, count(*) AS n_affected,
  'drop_repeated_header_rows' AS op FROM more WHERE {' + '.join(
    f"coalesce({norm(f'CAST({c} AS VARCHAR)')} = '{c.lower()}', false)::INT" for c in COLUMNS)} >= 8 HAVING count(*) > 0"""
DUPLICATE_ROW = f"""
SELECT 'duplicate_rows' AS kind, '<table>' AS "column", CAST(0.95 AS DOUBLE) AS confidence, n AS n_affected, 'drop_duplicates' AS op
FROM (SELECT {DUPLICATES} AS n) WHERE n > 0"""
dirty("detect_duplicate_rows", DUPLICATE_ROW)
CONSTANT = f"""
SELECT 'constant_columns' AS kind, string_agg(c, ', ') AS "column", CAST(0.90 AS DOUBLE) AS confidence, count(*) AS n_affected,
  'drop_constant_columns' AS op
FROM ({' UNION ALL '.join(
    f"SELECT '{c}' AS c FROM dirty HAVING count(DISTINCT {c}) + (count({c}) < count(*))::INT <= 1" for c in COLUMNS)}) HAVING count(*) > 0"""
dirty("detect_constant_columns", CONSTANT)
dirty("detect_implausible_range", f"""
, ages AS (SELECT {number('age')} AS a FROM dirty)
SELECT 'implausible_range' AS kind, 'age' AS "column", CAST(0.75 AS DOUBLE) AS confidence, count(*) AS n_affected,
  'flag_out_of_range' AS op, CAST(0 AS DOUBLE) AS lower, CAST(120 AS DOUBLE) AS upper FROM ages WHERE a < 0 OR a > 120 HAVING count(*) > 0""")
DATES = " UNION ALL ".join(f"""
SELECT 'date_like' AS kind, '{c}' AS "column", round_even(least(count(m) / count(t), 0.95), 2) AS confidence, count(m) AS n_affected,
  'coerce_datetime' AS op
FROM (SELECT {c} AS t, CASE WHEN {date_like(c)} THEN try_strptime({c}, {MONTH_FIRST}) END AS m FROM dirty)
HAVING count(t) >= 5 AND count(*) FILTER (WHERE {date_like('t')}) / count(t) >= 0.85 AND count(m) / count(t) >= 0.85""" for c in TEXTS)
dirty("detect_date_like", DATES)
NUMERICS = " UNION ALL ".join(f"""
SELECT 'numeric_like' AS kind, '{c}' AS "column", round_even(least(count({number(c)}) / count({c}), 0.95), 2) AS confidence,
  count({number(c)}) AS n_affected, 'coerce_numeric' AS op
FROM dirty HAVING count({c}) >= 5 AND count({number(c)}) / count({c}) >= 0.80 AND count(DISTINCT {c}) > 2""" for c in TEXTS)
dirty("detect_numeric_like", NUMERICS)
TICKED = "CAST(count(Q7_Part_1) + count(Q7_Part_2) + count(Q7_Part_3) AS BIGINT)"
MULTI = f"""
SELECT 'multiselect_group' AS kind, 'Q7' AS "column", CAST(0.90 AS DOUBLE) AS confidence, {TICKED} AS n_affected,
  'collapse_multiselect' AS op"""
dirty("detect_multiselect_group", MULTI + ", 'Q7_Part_1|Q7_Part_2|Q7_Part_3' AS members FROM dirty")
PII = """
SELECT 'pii' AS kind, 'respondent_id' AS "column", CAST(0.80 AS DOUBLE) AS confidence, count(respondent_id) AS n_affected, 'deidentify' AS op FROM dirty
UNION ALL SELECT 'pii', 'respondent_name', 0.80, count(respondent_name), 'deidentify' FROM dirty
UNION ALL SELECT 'pii', 'free_text_comment', 0.50, count(free_text_comment), NULL FROM dirty"""
dirty("detect_pii", PII)
STRUCTURAL = " UNION ALL ".join(f"""
SELECT 'structural_missing' AS kind, '{c}' AS "column",
  CAST(CASE WHEN 1 - count({c}) / count(*) >= 0.95 THEN 0.90 WHEN 1 - count({c}) / count(*) >= 0.75 THEN 0.75 ELSE 0.55 END AS DOUBLE) AS confidence,
  count(*) - count({c}) AS n_affected, CAST(NULL AS VARCHAR) AS op
FROM dirty HAVING (count(*) - count({c})) / count(*) >= 0.45""" for c in COLUMNS if c not in MEMBERS)
dirty("detect_structural_missing", STRUCTURAL)


def scan_cte() -> str:
    """All findings of the dirty view as `found(kind, column, confidence, n_affected, op)`."""
    variants = VARIANTS.replace(f", tc AS ({text_counts()}), d AS", ", d3 AS").replace("JOIN d USING", "JOIN d3 USING")
    synonyms = (
        SYNONYMS.replace(f", tc AS ({text_counts()}), d AS", ", d2 AS").replace("JOIN d USING (col) JOIN vocab", "JOIN d2 USING (col) JOIN vocab")
        .replace("best AS", "best2 AS").replace("JOIN best ON", "JOIN best2 best ON")
    )
    wanted = 'kind, "column", confidence, n_affected, op'
    return f"""{DIRTY} {coded_values()} {LIKERT} {synonyms} {variants},
found AS ({SENTINEL} FROM hits GROUP BY col, conf
  UNION ALL SELECT {wanted} FROM likert UNION ALL SELECT {wanted} FROM synonyms UNION ALL SELECT {wanted} FROM variants
  UNION ALL SELECT * FROM ({DUPLICATE_ROW}) UNION ALL SELECT * FROM ({CONSTANT}) UNION ALL SELECT * FROM ({DATES})
  UNION ALL SELECT * FROM ({NUMERICS}) UNION ALL SELECT * FROM ({MULTI} FROM dirty) UNION ALL SELECT * FROM ({PII})
  UNION ALL SELECT * FROM ({STRUCTURAL}))"""


CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
ORACLES["scan_customers"] = f"""WITH {coded_values('customer', CUSTOMER, ['c_name', 'c_mktsegment']).lstrip().lstrip(',')}
{SENTINEL} FROM hits GROUP BY col, conf
UNION ALL SELECT 'pii', 'c_name', 0.80, count(c_name), 'deidentify' FROM customer"""
ORACLES["scan"] = f"WITH {scan_cte()} SELECT * FROM found"

# Plan and recipe

STAGE_CASE = """CASE op WHEN 'collapse_multiselect' THEN 1 WHEN 'drop_constant_columns' THEN 1 WHEN 'recode_sentinel_missing' THEN 2
  WHEN 'order_likert' THEN 3 WHEN 'coerce_numeric' THEN 3 WHEN 'coerce_datetime' THEN 3 WHEN 'map_categories' THEN 4
  WHEN 'drop_duplicates' THEN 5 WHEN 'deidentify' THEN 9 END"""
LABEL_CASE = """CASE stage WHEN 1 THEN 'Fix structure' WHEN 2 THEN 'Recode disguised missing' WHEN 3 THEN 'Fix types'
  WHEN 4 THEN 'Standardise values' WHEN 5 THEN 'Remove duplicates' WHEN 9 THEN 'De-identify' END"""
PLAN = f"""{scan_cte()}, staged AS (SELECT *, CAST({STAGE_CASE} AS BIGINT) AS stage FROM found WHERE op IS NOT NULL),
planned AS (SELECT row_number() OVER (ORDER BY stage, confidence DESC, op, "column") AS step, stage, {LABEL_CASE} AS stage_label,
  op, "column" AS target, confidence, false AS is_blocked FROM staged)"""
ORACLES["plan"] = f"WITH {PLAN} SELECT * FROM planned"
ORACLES["auto_apply"] = f"WITH {PLAN} SELECT op, target, confidence FROM planned WHERE confidence >= 0.90"
ORACLES["never_impute"] = f"""WITH {scan_cte()}
SELECT "column" FROM found WHERE kind IN ('structural_missing', 'multiselect_group') UNION
SELECT unnest(['Q7_Part_1', 'Q7_Part_2', 'Q7_Part_3']) FROM found WHERE kind = 'multiselect_group'"""
ORACLES["plan_blocked"] = f"""WITH {scan_cte()}
SELECT CAST(6 AS BIGINT) AS stage, 'fill_missing' AS op, "column" AS target, confidence FROM found WHERE kind = 'structural_missing'
UNION ALL SELECT 7, 'clip_outliers', "column", confidence FROM found WHERE kind = 'numeric_like'
UNION ALL SELECT 3, CASE kind WHEN 'numeric_like' THEN 'coerce_datetime' ELSE 'coerce_numeric' END, "column", CAST(0.86 AS DOUBLE)
FROM found WHERE kind IN ('numeric_like', 'date_like')"""
ORACLES["order_violations"] = f"""WITH {scan_cte()},
seqd AS (SELECT row_number() OVER (ORDER BY confidence DESC, kind, "column") AS seq, op, CAST({STAGE_CASE} AS BIGINT) AS stage
  FROM found WHERE op IS NOT NULL),
seen AS (SELECT *, max(stage) OVER w AS after_stage, arg_max(op, stage * 1000 + seq) OVER w AS after_op FROM seqd
  WINDOW w AS (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT seq, stage, after_stage, op, after_op FROM seen WHERE stage < after_stage"""
clean("replay_clean", "SELECT * FROM clean")
ORACLES["stream_clean"] = f"WITH {DIRTY},{STEPS} SELECT * FROM steps"


def ledger_rows() -> str:
    rows = [
        ("collapse_multiselect", "count(*)", 16, 18), ("drop_constant_columns", "count(*)", 18, 17),
        ("recode_sentinel_missing", "count(*) FILTER (WHERE free_text_comment IN ('', '-', 'Don''t know', 'N/A'))", 17, 17),
        ("recode_sentinel_missing", "count(*) FILTER (WHERE age IN ('999', 'Prefer not to say'))", 17, 17),
        ("recode_sentinel_missing", "count(*) FILTER (WHERE monthly_income = -99)", 17, 17),
        ("coerce_datetime", f"count(try_strptime(survey_date, {MONTH_FIRST}))", 17, 17),
        ("coerce_numeric", f"count({AGE})", 17, 17),
        ("order_likert", f"count({ORDINAL})", 17, 17),
        ("map_categories", "count(*) FILTER (WHERE gender IN ('m', 'Man', '1', 'f', 'Woman', '2'))", 17, 17),
        ("map_categories", "count(*) FILTER (WHERE state IN ('  Lagos', 'LAGOS', 'lagos'))", 17, 17),
    ]
    parts = [
        f"SELECT CAST({i} AS BIGINT) AS seq, '{op}' AS op, count(*) AS rows_before, count(*) AS rows_after, {hit} AS rows_affected, "
        f"CAST({before} AS BIGINT) AS cols_before, CAST({after} AS BIGINT) AS cols_after FROM dirty"
        for i, (op, hit, before, after) in enumerate(rows, 1)
    ]
    parts.append(
        "SELECT 11, 'drop_duplicates', (SELECT count(*) FROM dirty), (SELECT count(*) FROM clean), "
        "(SELECT count(*) FROM dirty) - (SELECT count(*) FROM clean), 17, 17"
    )
    return " UNION ALL ".join(parts)


clean("ledger", ledger_rows())
clean("ledger_for_reading", f"""SELECT seq, op AS operation, rows_affected,
  rows_before || 'x' || cols_before || ' -> ' || rows_after || 'x' || cols_after AS shape FROM ({ledger_rows()})""")

# Roles and charts


def clean_distinct() -> str:
    return " UNION ALL ".join(
        f"""SELECT {i} AS pos, '{c}' AS "column", count(DISTINCT {c}) AS d, count(*) AS n FROM clean"""
        for i, c in enumerate(CLEAN_COLUMNS)
    )


ROLES = f""", dc AS ({clean_distinct()}),
roles AS (SELECT CAST(pos AS BIGINT) AS pos, "column", d, CASE
    WHEN "column" IN ('Q7_Part_1', 'Q7_Part_2', 'Q7_Part_3') THEN 'multiselect_member'
    WHEN "column" IN ('respondent_id', 'respondent_name') THEN 'identifier'
    WHEN "column" = 'survey_date' THEN 'datetime' WHEN "column" = 'Q1' THEN 'ordered'
    WHEN "column" IN ('age', 'monthly_income', 'Q7_count') THEN CASE WHEN d > 5 THEN 'numeric' END
    WHEN d <= 14 THEN 'categorical' WHEN d > 0.9 * n THEN 'identifier' ELSE 'free_text' END AS role FROM dc)"""
clean("roles", 'SELECT pos, "column", role FROM roles WHERE role IS NOT NULL', ROLES)
clean("chart_suggestions", """
SELECT row_number() OVER (ORDER BY score DESC, rule, p1, p2 NULLS FIRST) AS place, kind, title, score FROM (
  SELECT CAST(0.95 AS DOUBLE) AS score, 0 AS rule, 'likert_bar' AS kind, c || ', level by level' AS title, i AS p1, NULL AS p2 FROM ord
  UNION ALL SELECT 0.92, 1, 'grouped_bar', 'Levels of ' || o.c || ' within each ' || g.c, g.i, o.i FROM ord o, cat g
  UNION ALL SELECT 0.80, 2, 'category_bar', 'How often each ' || c || ' occurs', j, NULL FROM allcat
  UNION ALL SELECT 0.78, 3, 'histogram', 'How ' || c || ' is spread', i, NULL FROM num
  UNION ALL SELECT 0.74, 4, 'box_by_group', 'Spread of ' || n.c || ' in each ' || g.c, g.i, n.i FROM num n, cat g
  UNION ALL SELECT 0.70, 5, 'timeseries', 'Rows per day of ' || c, i, NULL FROM tim
  UNION ALL SELECT 0.66, 6, 'scatter', a.c || ' against ' || b.c, a.i, b.i FROM num a, num b WHERE a.i < b.i
  UNION ALL SELECT 0.62, 7, 'missingness', 'Blank cells of every column', 1, NULL)""", ROLES + """,
ord AS (SELECT "column" AS c, row_number() OVER (ORDER BY pos) AS i FROM roles WHERE role = 'ordered'),
allcat AS (SELECT "column" AS c, d, row_number() OVER (ORDER BY pos) AS j FROM roles WHERE role = 'categorical'),
cat AS (SELECT c, row_number() OVER (ORDER BY j) AS i FROM allcat WHERE d <= 8),
num AS (SELECT "column" AS c, row_number() OVER (ORDER BY pos) AS i FROM roles WHERE role = 'numeric'),
tim AS (SELECT "column" AS c, row_number() OVER (ORDER BY pos) AS i FROM roles WHERE role = 'datetime')""")


def histogram_sql(source: str, c: str) -> str:
    return f"""
span AS (SELECT min({c}) AS lo, max({c}) AS hi, (max({c}) - min({c})) / 20 AS w FROM {source}),
edges AS (SELECT i, lo + i * w AS low, CASE WHEN i = 19 THEN hi ELSE lo + (i + 1) * w END AS high FROM span, range(20) r(i)),
binned AS (SELECT (SELECT count(*) FROM edges e WHERE e.i > 0 AND x.{c} >= e.low) AS bin, count(*) AS n FROM {source} x WHERE {c} IS NOT NULL GROUP BY 1)
SELECT CAST(i AS BIGINT) AS bin, round(low, 4) AS low, round(high, 4) AS high, coalesce(n, 0) AS n FROM edges LEFT JOIN binned ON i = bin"""


clean("chart_histogram", histogram_sql("clean", "monthly_income"), ",")
ORACLES["chart_histogram_lineitem"] = "WITH " + histogram_sql("lineitem", "l_extendedprice")
clean("chart_likert_bar", f"""
SELECT CAST(p AS BIGINT) AS place, {LEVELS}[p] AS label, (SELECT count(*) FROM clean WHERE Q1__ord = p) AS n FROM range(1, 6) r(p)""")
clean("chart_category_bar", "SELECT state AS value, count(*) AS n, rank() OVER (ORDER BY count(*) DESC, state) AS place FROM clean WHERE state IS NOT NULL GROUP BY 1")
ORACLES["chart_category_bar_parts"] = "SELECT p_type AS value, count(*) AS n, rank() OVER (ORDER BY count(*) DESC, p_type) AS place FROM part GROUP BY 1"


def days_sql(source: str, c: str) -> str:
    return f"""
days AS (SELECT CAST({c} AS DATE) AS day, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY 1),
calendar AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM days)
SELECT day, coalesce(n, 0) AS n FROM calendar LEFT JOIN days USING (day)"""


clean("chart_timeseries", days_sql("clean", "survey_date"), ",")
ORACLES["chart_timeseries_events"] = "WITH " + days_sql("events", "ts")


def shares_sql(group: str, level: str) -> str:
    return f""",
known AS (SELECT {group} AS g, {level} AS l FROM clean WHERE {group} IS NOT NULL AND {level} IS NOT NULL),
totals AS (SELECT g, count(*) AS total FROM known GROUP BY 1),
cells AS (SELECT g, l, count(*) AS n FROM known GROUP BY 1, 2)"""


SHARES = """SELECT t.g AS "group", c.l AS level, n, round(n / total * 100, 6) AS pct FROM totals t JOIN cells c ON c.g = t.g"""
clean("chart_grouped_bar", SHARES, shares_sql("gender", "Q1"))


def box_sql(source: str, group: str, c: str) -> str:
    return f"""
q AS (SELECT {group} AS g, count({c}) AS n, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q3
  FROM {source} WHERE {group} IS NOT NULL AND {c} IS NOT NULL GROUP BY 1)
SELECT g AS "group", n, round(q.q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
  round(least(min({c}) FILTER (WHERE {c} >= q.q1 - 1.5 * (q3 - q.q1) AND {c} <= q3 + 1.5 * (q3 - q.q1)), q.q1), 4) AS whisker_low,
  round(greatest(max({c}) FILTER (WHERE {c} >= q.q1 - 1.5 * (q3 - q.q1) AND {c} <= q3 + 1.5 * (q3 - q.q1)), q3), 4) AS whisker_high,
  count(*) FILTER (WHERE {c} < q.q1 - 1.5 * (q3 - q.q1) OR {c} > q3 + 1.5 * (q3 - q.q1)) AS n_beyond
FROM {source} JOIN q ON {group} = g WHERE {c} IS NOT NULL GROUP BY g, n, q.q1, median, q3"""


clean("chart_box_by_group", box_sql("clean", "state", "monthly_income"), ",")
ORACLES["chart_box_lineitem"] = "WITH " + box_sql("lineitem", "l_returnflag", "l_extendedprice")
clean("chart_scatter", "SELECT age AS x, monthly_income AS y FROM clean WHERE age IS NOT NULL AND monthly_income IS NOT NULL")
clean("chart_missingness", 'SELECT "column", round(p, 6) AS pct, p BETWEEN 20 AND 60 AS to_decide FROM (' + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", (count(*) - count({c})) / count(*) * 100 AS p FROM clean"""
    for c in CLEAN_COLUMNS if c not in MEMBERS
) + ")")

# Descriptive findings

clean("finding_completeness", f"""
SELECT count(*) AS records, CAST({len(CLEAN_COLUMNS)} AS BIGINT) AS fields,
  round(1 - ({AFTER_BLANKS}) / (count(*) * {len(CLEAN_COLUMNS)}), 9) AS filled_share FROM clean""")
clean("finding_thin_fields", "SELECT field, round_even(share * 100, 1) AS pct_blank, row_number() OVER (ORDER BY share DESC, pos) AS place FROM (" + " UNION ALL ".join(
    f"SELECT {i} AS pos, '{c}' AS field, (count(*) - count({c})) / count(*) AS share FROM clean" for i, c in enumerate(CLEAN_COLUMNS)
) + ") WHERE share > 0.2")
clean("finding_outcome_split", """
SELECT outcome AS level, count(*) AS records, round_even(count(*) / known * 100, 1) AS pct_of_known, known, blank
FROM clean, (SELECT count(outcome) AS known, count(*) - count(outcome) AS blank FROM clean)
WHERE outcome IS NOT NULL AND known >= 30 GROUP BY outcome, known, blank""")
BAD = "('died', 'death', 'dead', 'deceased', 'yes', 'true', '1', 'relapsed', 'readmitted', 'complication', 'failed', 'worsened')"
clean("finding_bad_value", f"SELECT outcome AS value FROM clean WHERE lower(trim(outcome)) IN {BAD} ORDER BY row_id LIMIT 1")
RATES = """,
rates AS (SELECT treatment_arm AS "group", count(*) AS records, round_even(avg((outcome = 'Died')::INT) * 100, 1) AS rate
  FROM clean WHERE treatment_arm IS NOT NULL AND outcome IS NOT NULL GROUP BY 1 HAVING count(*) >= 30)"""
clean("finding_group_rates", "SELECT * FROM rates", RATES)
clean("finding_group_gap", """
SELECT 'outcome' AS outcome, 'treatment_arm' AS group_column, h."group" AS high_group, h.records AS high_records, h.rate AS high_rate,
  l."group" AS low_group, l.records AS low_records, l.rate AS low_rate, round_even(h.rate - l.rate, 1) AS gap_points
FROM (SELECT * FROM rates ORDER BY rate DESC LIMIT 1) h, (SELECT * FROM rates ORDER BY rate LIMIT 1) l WHERE h.rate - l.rate >= 8""", RATES)
clean("finding_concentration", """
SELECT value, records, round(records / known, 9) AS share, rank() OVER (ORDER BY records DESC, value) AS place FROM (
  SELECT state AS value, count(*) AS records, sum(count(*)) OVER () AS known, max(count(*)) OVER () AS most, count(*) OVER () AS levels
  FROM clean WHERE state IS NOT NULL GROUP BY 1)
WHERE known >= 30 AND levels >= 2 AND most / known >= 0.6""")


def summary_sql(source: str, c: str) -> str:
    return f"""SELECT '{c}' AS "column", n, round(median, 4) AS median, round(q1, 4) AS q1, round(q3, 4) AS q3, round(mean, 4) AS mean,
  median <> 0 AND abs(mean - median) / greatest(abs(median), 1e-9) > 0.15 AS skewed
FROM (SELECT count({c}) AS n, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, avg({c}) AS mean
  FROM {source}) WHERE n >= 30"""


clean("finding_numeric_summary", summary_sql("clean", "monthly_income"))
ORACLES["finding_numeric_summary_lineitem"] = summary_sql("lineitem", "l_extendedprice")

CATEGORICAL = ["gender", "state", "treatment_arm", "outcome"]
# Categorical columns with 2 to 12 levels, in table order.
FINDINGS = f"""{ROLES},
cats AS (SELECT "column" AS c, row_number() OVER (ORDER BY pos) AS i FROM roles WHERE role = 'categorical' AND d BETWEEN 2 AND 12),
groups(gcol, g, bad) AS ({' UNION ALL '.join(
    f"SELECT '{c}', {c}, (outcome = 'Died')::INT FROM clean WHERE {c} IS NOT NULL AND outcome IS NOT NULL"
    for c in ('gender', 'state', 'treatment_arm', 'free_text_comment', 'Q9_followup', 'Q7_selected'))}),
rates AS (SELECT gcol, g, count(*) AS k, round_even(avg(bad) * 100, 1) AS rate FROM groups GROUP BY 1, 2 HAVING count(*) >= 30),
gaps AS (SELECT gcol, max(rate) - min(rate) AS gap FROM rates GROUP BY 1 HAVING count(*) >= 2 AND max(rate) - min(rate) >= 8),
tried AS (SELECT c FROM cats WHERE c <> 'outcome'),
vals(vcol, v) AS ({' UNION ALL '.join(
    f"SELECT '{c}', {c} FROM clean WHERE {c} IS NOT NULL"
    for c in ('gender', 'state', 'treatment_arm', 'outcome', 'free_text_comment', 'Q9_followup', 'Q7_selected'))}),
conc AS (SELECT vcol FROM (SELECT vcol, v, count(*) AS k FROM vals GROUP BY 1, 2) GROUP BY 1
  HAVING sum(k) >= 30 AND count(*) >= 2 AND max(k) / sum(k) >= 0.6),
nums AS (SELECT * FROM ({summary_sql('clean', 'age')}) UNION ALL SELECT * FROM ({summary_sql('clean', 'monthly_income')})),
said AS (
  SELECT 'completeness' AS kind, '' AS columns, CAST(1.0 AS DOUBLE) AS importance
  UNION ALL SELECT 'outcome_split', 'outcome', 0.95
  UNION ALL SELECT 'group_gap', gcol || '|outcome', round(0.9 + least(gap / 200, 0.09), 6) FROM gaps WHERE gcol IN (SELECT c FROM tried)
  UNION ALL SELECT 'concentration', vcol, 0.7 FROM conc WHERE vcol IN (SELECT c FROM cats)
  UNION ALL SELECT 'numeric_summary', "column", CASE WHEN skewed THEN 0.75 ELSE 0.65 END FROM nums)"""
clean("findings", "SELECT * FROM said", FINDINGS)
clean("recommendations", f"""
, thin AS (SELECT * FROM ({' UNION ALL '.join(
    f"SELECT {i} AS pos, '{c}' AS c, (count(*) - count({c})) / count(*) AS share FROM clean" for i, c in enumerate(CLEAN_COLUMNS))})
  WHERE share > 0.3),
split AS (SELECT pos, c FROM ({' UNION ALL '.join(
    f"SELECT {i} AS pos, '{c}' AS c, min(k) AS least, count(*) AS levels FROM (SELECT {c}, count(*) AS k FROM clean WHERE {c} IS NOT NULL GROUP BY 1)"
    for i, c in enumerate(CLEAN_COLUMNS) if c in SMALL_TEXTS)}) WHERE levels BETWEEN 2 AND 12 AND least < 30),
steps2 AS (SELECT 1 AS o, row_number() OVER (ORDER BY importance DESC, columns) AS i, 'investigate_gap' AS kind, columns AS subject
    FROM said WHERE kind = 'group_gap'
  UNION ALL SELECT 2, pos, 'fix_collection', c FROM thin UNION ALL SELECT 3, pos, 'do_not_split', c FROM split
  UNION ALL SELECT 4, 0, 'attach_script', '')
SELECT row_number() OVER (ORDER BY o, i) AS place, kind, subject FROM steps2""", FINDINGS)

# Questions

clean("questions", """
SELECT row_number() OVER (ORDER BY score DESC, rule, p1, p2 NULLS FIRST) AS place, question, score, category FROM (
  SELECT CAST(1.0 AS DOUBLE) AS score, 0 AS rule, 0 AS p1, 0 AS p2, 'How does outcome differ between the groups of treatment_arm?' AS question,
    'headline' AS category
  UNION ALL SELECT 0.95, 1, 0, NULL, 'How often does each outcome occur, and how often is it blank?', 'sanity'
  UNION ALL SELECT 0.9, 2, i, 0, 'Does outcome go with ' || c || '?', 'comparison' FROM cats WHERE c NOT IN ('outcome', 'treatment_arm')
  UNION ALL SELECT 0.8, 4, 0, i, 'Which level of Q1 is the middle one, overall and for each ' || c || '?', 'comparison' FROM cats
  UNION ALL SELECT 0.75, 5, n.i, cats.i, 'How far apart are mean and median of ' || n.c || ' for each ' || cats.c || '?', 'comparison' FROM nums2 n, cats
  UNION ALL SELECT 0.7, 6, i, NULL, 'Between which limits does ' || c || ' lie, and where are its quartiles?', 'sanity' FROM nums2
  UNION ALL SELECT 0.7, 7, 0, i, 'How many rows has each month, for each ' || c || '?', 'sanity' FROM cats
  UNION ALL SELECT 0.6, 8, i, NULL, 'How many rows has each ' || c || '?', 'explore' FROM cats)""", ROLES + """,
cats AS (SELECT "column" AS c, row_number() OVER (ORDER BY pos) AS i FROM roles WHERE role = 'categorical' AND d BETWEEN 2 AND 12),
nums2 AS (SELECT "column" AS c, row_number() OVER (ORDER BY pos) AS i FROM roles WHERE role = 'numeric')""")
clean("question_outcome_by_exposure", SHARES, shares_sql("treatment_arm", "outcome"))
clean("question_outcome_by_group", SHARES, shares_sql("gender", "outcome"))
clean("question_records_per_outcome", "SELECT outcome AS value, count(*) AS records FROM clean GROUP BY 1")
clean("question_median_by_group", """
SELECT treatment_arm AS "group", count(monthly_income) AS n, round(quantile_cont(monthly_income, 0.5), 4) AS median
FROM clean WHERE monthly_income IS NOT NULL GROUP BY 1""")
clean("question_median_level", f"""
, m AS (SELECT true AS overall, CAST(NULL AS VARCHAR) AS "group", count(*) AS n, quantile_disc(Q1__ord, 0.5) AS place FROM clean
  UNION ALL SELECT false, gender, count(*), quantile_disc(Q1__ord, 0.5) FROM clean GROUP BY 2)
SELECT overall, "group", n, place, {LEVELS}[place] AS label FROM m""")
clean("question_mean_and_median", """
SELECT gender AS "group", count(age) AS n, round(avg(age), 4) AS mean, round(quantile_cont(age, 0.5), 4) AS median
FROM clean WHERE age IS NOT NULL GROUP BY 1""")
clean("question_spread", """
SELECT count(monthly_income) AS n, min(monthly_income) AS minimum, round(quantile_cont(monthly_income, 0.25), 4) AS q1,
  round(quantile_cont(monthly_income, 0.5), 4) AS median, round(quantile_cont(monthly_income, 0.75), 4) AS q3, max(monthly_income) AS maximum
FROM clean""")
clean("question_records_by_month", """
SELECT CAST(date_trunc('month', survey_date) AS DATE) AS month, gender AS "group", count(*) AS records
FROM clean WHERE survey_date IS NOT NULL GROUP BY 1, 2""")
clean("question_records_by_category", "SELECT gender AS value, count(*) AS records FROM clean GROUP BY 1")

clean("sql_readonly", """
SELECT state, gender, count(*) AS n, max(monthly_income) AS most FROM clean WHERE monthly_income IS NOT NULL GROUP BY 1, 2""")

# Sources

READ = ", ".join(
    f"CASE WHEN {c} NOT IN ('', 'N/A') THEN {c} END AS {c}" if c == "free_text_comment" else c
    for c in COLUMNS if c != "monthly_income"
)
dirty("load_delimited", f"SELECT {READ} FROM dirty")
ORACLES["load_json_lines"] = (
    'SELECT o_custkey AS "by.o_custkey", o_orderstatus AS "by.state.o_orderstatus", o_orderkey, o_totalprice FROM orders'
)
ORACLES["load_with_title_block"] = "SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name, c_mktsegment AS segment FROM customer"


def rank_sql(name: str, columns: list[str]) -> str:
    filled = " + ".join(f"count({c})" for c in columns)
    used = " + ".join(f"(count({c}) > 0)::INT" for c in columns)
    return (
        f"SELECT '{name}' AS \"table\", count(*) AS n_rows, CAST({used} AS BIGINT) AS n_cols, CAST({filled} AS BIGINT) AS filled_cells, "
        f"round(CAST({filled} AS DOUBLE) * (1 + 0.1 * {min(len(columns), 40)}) * CASE WHEN count(*) < 3 THEN 0.1 ELSE 1 END, 4) AS score FROM {name}"
    )


ORACLES["rank_candidate_tables"] = " UNION ALL ".join(rank_sql(name, columns.split()) for name, columns in {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props",
    "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding label",
    "pages": "page_id url html",
    "benchmark": "item_id text",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn role text",
}.items())

# Streams

ORACLES["stream_distinct"] = "SELECT DISTINCT event_type, user_id FROM events"
COUNTERS = " UNION ALL ".join(
    f"SELECT strftime(ts, '%Y-%m-%d') AS day, '{label}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_blank, "
    f"count(*) FILTER (WHERE CAST({c} AS VARCHAR) IN ({codes})) AS n_codes, {beyond} AS n_beyond FROM events GROUP BY 1"
    for c, label, codes, beyond in [
        ("event_type", "event_type", "'missing', 'unknown', 'other'", "CAST(0 AS BIGINT)"),
        ("user_id", "user_id", ", ".join(f"'{k}'" for k in NUMERIC_CODES), "CAST(0 AS BIGINT)"),
        ("value", "rate", ", ".join(f"'{k}.0'" for k in NUMERIC_CODES), "count(*) FILTER (WHERE value < 0 OR value > 100)"),
    ]
)
ORACLES["stream_quality_window"] = COUNTERS
ORACLES["stream_scan"] = f"WITH {scan_cte()} SELECT CAST(0 AS BIGINT) AS batch_id, kind, \"column\", confidence, n_affected FROM found"
ORACLES["stream_scan_so_far"] = ORACLES["scan"]
ORACLES["sql_pipe"] = """
SELECT CAST(substring(o_orderpriority, 1, 1) AS BIGINT) AS n, o_orderstatus, count(*) AS orders, CAST(max(o_totalprice) AS DOUBLE) AS most
FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2"""

# Equality, codes, wide tables, sinks and readers

ORACLES["duplicate_count_floats"] = """
WITH t AS (SELECT l_suppkey, l_returnflag, CASE WHEN l_linenumber IN (3, 4) THEN 0 WHEN l_linenumber > 4 THEN l_quantity END AS v FROM lineitem),
d AS (SELECT count(*) AS k FROM (SELECT DISTINCT * FROM t))
SELECT count(*) - any_value(k) AS n_duplicates, any_value(k) AS n_kept FROM t, d"""
ORACLES["auto_apply_real_values"] = """
SELECT CASE WHEN o_orderkey % 10 <> 0 THEN 18 + o_orderkey % 85 END AS age, count(*) AS n FROM orders GROUP BY 1"""
ORACLES["detect_repeated_header_row_wide"] = """
SELECT 'repeated_header_row' AS kind, '<table>' AS "column", CAST(0.95 AS DOUBLE) AS confidence, count(*) AS n_affected,
  'drop_repeated_header_rows' AS op FROM customer WHERE c_custkey % 50 = 0 HAVING count(*) > 0"""
ORACLES["cautions"] = f"""WITH {scan_cte()}
SELECT 'never_impute' AS kind, "column" FROM found WHERE kind IN ('structural_missing', 'multiselect_group')
UNION SELECT 'never_impute', unnest(['Q7_Part_1', 'Q7_Part_2', 'Q7_Part_3']) FROM found WHERE kind = 'multiselect_group'
UNION SELECT 'identifying', "column" FROM found WHERE kind = 'pii' UNION SELECT 'filled', 'age'"""
ORACLES["replay_from_json"] = ORACLES["stream_clean"]
clean("sink_clean", "SELECT respondent_id, gender, state, age, Q1 FROM clean")
clean("sink_ledger", f"SELECT seq, op, rows_before, rows_after, rows_affected FROM ({ledger_rows()})")
ORACLES["load_multiline"] = "SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS text_md5, lang FROM documents"
ORACLES["load_names"] = """
SELECT CAST(n_nationkey AS VARCHAR) AS "0_key", n_name AS "1_name", CAST(n_regionkey AS VARCHAR) AS "2_key_3", upper(n_name) AS "3_NAME_4",
  CAST(2 AS BIGINT) AS notes FROM nation"""
clean("finding_headlines", """
, o AS (SELECT outcome AS v, count(*) AS k, (SELECT count(outcome) FROM clean) AS known, (SELECT count(*) FROM clean) AS total FROM clean
  WHERE outcome IS NOT NULL GROUP BY 1 ORDER BY k DESC, v LIMIT 1)
SELECT 'The usual outcome is ' || v || ' (' || CAST(round_even(k / known * 100, 0) AS INT) || '%)' AS headline,
  format('{:,}', k) || ' of the ' || format('{:,}', known) || ' rows that have a value; ' || format('{:,}', total - known) || ' rows have none.' AS detail
FROM o
UNION ALL SELECT CAST(round_even((1 - blank / cells) * 100, 0) AS INT) || '% of the cells of ' || format('{:,}', n) || ' rows hold a value',
  'The table has ' || c || ' columns; ' || format('{:,}', blank) || ' of ' || format('{:,}', cells) || ' cells are blank.'
FROM (SELECT count(*) AS n, """ + f"{len(CLEAN_COLUMNS)} AS c, CAST({AFTER_BLANKS} AS BIGINT) AS blank, count(*) * {len(CLEAN_COLUMNS)}" + """ AS cells FROM clean)
UNION ALL SELECT 'Most rows have the same ' || vcol || ': ' || v, format('{:,}', k) || ' of ' || format('{:,}', known) || ', or '
  || CAST(round_even(k / known * 100, 0) AS INT) || '%; all others together are few.'
FROM (SELECT vcol, v, count(*) AS k, sum(count(*)) OVER (PARTITION BY vcol) AS known, row_number() OVER (PARTITION BY vcol ORDER BY count(*) DESC, v) AS r
      FROM vals GROUP BY 1, 2) WHERE r = 1 AND vcol IN (SELECT vcol FROM conc) AND vcol IN (SELECT c FROM cats)""", FINDINGS)
