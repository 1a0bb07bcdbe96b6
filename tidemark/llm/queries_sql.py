"""The same results in plain SQL, where SQL can say them."""

import sys

from .visual_form import visual_form

CALLS = """calls AS (
  SELECT upper(trim(ticker)) AS ticker, lower(trim(quarter)) AS quarter, year, pub_date, lower(trim(source)) AS source, full_z, prep_z, qa_z
  FROM transcripts_text
  QUALIFY row_number() OVER (PARTITION BY upper(trim(ticker)), lower(trim(quarter)), year ORDER BY loaded_at DESC) = 1)"""

BLANKS = r"[\t\x0B\f\r\x1C-\x1F \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"

LINES = f"""WITH {CALLS},
lines AS (
  SELECT ticker, quarter, year, source, unnest(string_split(full_z, chr(10))) AS raw, generate_subscripts(string_split(full_z, chr(10)), 1) AS line_no
  FROM calls WHERE source IS NOT NULL),
forms AS (
  SELECT *, trim(regexp_replace(regexp_replace(replace(lower(raw), lower(ticker), chr(1)), '[0-9]+', chr(2), 'g'), '{BLANKS}', ' ', 'g')) AS form FROM lines),
counted AS (
  SELECT source, form FROM forms JOIN (SELECT source, count(*) AS docs FROM calls GROUP BY 1) USING (source)
  WHERE form <> '' GROUP BY source, form HAVING count(DISTINCT (ticker, quarter, year)) >= 3 AND count(DISTINCT (ticker, quarter, year)) * 20 >= any_value(docs))
"""

NEAREST = f"""WITH {CALLS},
days AS (SELECT DISTINCT upper(trim(ticker)) AS ticker, earnings_date FROM earnings WHERE earnings_date IS NOT NULL),
best AS (
  SELECT c.ticker, quarter, year, pub_date, earnings_date FROM calls c LEFT JOIN days d ON d.ticker = c.ticker AND abs(date_diff('day', pub_date, earnings_date)) <= 30
  QUALIFY row_number() OVER (PARTITION BY c.ticker, quarter, year ORDER BY abs(date_diff('day', pub_date, earnings_date)), earnings_date) = 1)
"""

ORACLE = {
    "p1_found": LINES + "SELECT ticker, quarter, year, line_no::INT AS line_no FROM forms SEMI JOIN counted USING (source, form)",
    "p1_clean": LINES
    + """, kept AS (SELECT f.*, c.form IS NOT NULL AS gone FROM forms f LEFT JOIN counted c ON c.source = f.source AND c.form = f.form)
SELECT ticker, quarter, year, coalesce(sum(gone::INT), 0)::INT AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY line_no) FILTER (NOT gone), '') AS kept_text
FROM kept GROUP BY ALL
UNION ALL SELECT ticker, quarter, year, 0, full_z FROM calls WHERE source IS NULL""",
    "p2_found": NEAREST + "SELECT ticker, quarter, year, strftime(earnings_date, '%Y-%m-%d') AS earnings_date FROM best WHERE earnings_date IS NOT NULL",
    "p2_features": NEAREST
    + """, old AS (
  SELECT upper(trim(ticker)) AS ticker, lower(trim(quarter)) AS quarter, year, matched_earnings_date AS om, day_diff AS od FROM sentiment_features
  QUALIFY row_number() OVER (PARTITION BY upper(trim(ticker)), lower(trim(quarter)), year ORDER BY om DESC NULLS LAST, od DESC NULLS LAST) = 1)
SELECT b.ticker, b.quarter, b.year, strftime(earnings_date, '%Y-%m-%d') AS matched_earnings_date, abs(date_diff('day', pub_date, earnings_date))::INT AS day_diff,
  CASE WHEN o.ticker IS NOT NULL THEN om IS NOT DISTINCT FROM earnings_date AND od IS NOT DISTINCT FROM abs(date_diff('day', pub_date, earnings_date)) END AS agrees
FROM best b LEFT JOIN old o USING (ticker, quarter, year)""",
    "p5_found": f"""WITH {CALLS}
SELECT ticker, quarter, year, 'full_z' AS field FROM calls WHERE length(full_z) > 4000
UNION ALL SELECT ticker, quarter, year, 'qa_z' FROM calls WHERE length(qa_z) > 4000""",
}
ORACLE["p9_plan"] = """WITH t AS (
  SELECT lower(trim(source)) AS source, target_weight AS w, max_repeats AS m FROM mix_targets
  QUALIFY row_number() OVER (PARTITION BY lower(trim(source)) ORDER BY target_weight DESC, max_repeats DESC) = 1),
d AS (SELECT lower(trim(source)) AS source, count(*) AS docs, sum(length(text))::BIGINT AS tokens FROM documents WHERE length(text) > 0 GROUP BY 1),
b AS (SELECT * FROM (SELECT * FROM t WHERE w > 0 AND NOT isnan(w) AND m > 0) JOIN d USING (source)),
p AS (SELECT *, w / sum(w) OVER () AS target_share, sum(tokens) OVER () AS total FROM b)
SELECT source, docs, tokens, round(target_share + 1e-10, 6) AS target_share, round(least(target_share * total / tokens, m) + 1e-10, 6) AS copies, m AS max_repeats FROM p"""
ORACLE["p5_roundtrip"] = f"""WITH {CALLS}, t AS (SELECT ticker, quarter, year, 'full_z' AS field, full_z AS text FROM calls UNION ALL SELECT ticker, quarter, year, 'qa_z', qa_z FROM calls)
SELECT ticker, quarter, year, field, length(text)::INT AS n_chars, md5(text) AS digest, length(text) > 4000 AS cut, true AS fits, true AS shares, true AS "natural" FROM t WHERE text IS NOT NULL"""

# An independent measure: the published grade formula over words, sentences and vowel groups. The data's levels lie far on
# either side of 20 by it.
SPEAKER = r"(?m)^[ \t]*[A-Z][A-Za-z0-9_.''’-]*(?:[ \t]+[A-Z][A-Za-z0-9_.''’-]*){0,4}(?:[ \t]*(?:--|—|–)[^:\n]{1,60}|[ \t]*\([^)\n]{1,60}\)|,[^:\n]{1,60})?[ \t]*:"
ORACLE["p3_found"] = f"""WITH {CALLS}, s AS (SELECT ticker, quarter, year, 'prep_z' AS section, prep_z AS t FROM calls UNION ALL SELECT ticker, quarter, year, 'qa_z', qa_z FROM calls),
x AS (SELECT * EXCLUDE (t), regexp_replace(t, '{SPEAKER}', '', 'g') AS t FROM s WHERE t <> ''),
w AS (SELECT *, regexp_extract_all(lower(t), '[a-z0-9'']+') AS ws, len(list_filter(regexp_split_to_array(t, '[.!?]+[\\s]|\\n|[.!?]+$'), lambda z: regexp_matches(z, '[A-Za-z0-9]'))) AS ns FROM x),
y AS (SELECT *, len(ws) AS n, list_sum(list_transform(ws, lambda v: greatest(1, len(regexp_extract_all(v, '[aeiouy]+'))))) AS sy FROM w)
SELECT ticker, quarter, year, section FROM y WHERE n > 0 AND ns > 0 AND 0.39 * n / ns + 11.8 * sy / n - 15.59 >= 20"""


def _drawn() -> str:
    """Every character whose own form is another, as rows of a table."""
    each = ((chr(c), visual_form(chr(c))) for c in range(0x80, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF)
    return ", ".join("('{}', '{}')".format(c, f.replace("'", "''")) for c, f in each if c != f)


def forms(table: str, key: str, name: str) -> str:
    """CTEs for the visual form of a table's texts, character by character, then composed."""
    return f"""{name}c AS (SELECT {key}, unnest(regexp_extract_all(text, '(?s).')) AS c, generate_subscripts(regexp_extract_all(text, '(?s).'), 1) AS i FROM {table} WHERE regexp_matches(text, '[^\\x00-\\x7F]')),
{name}f AS (SELECT {key}, nfc_normalize(string_agg(coalesce(f, c), '' ORDER BY i)) AS form FROM {name}c LEFT JOIN drawn USING (c) GROUP BY 1),
{name} AS (SELECT {key}, text, coalesce(form, text) AS form FROM {table} LEFT JOIN {name}f USING ({key}))"""


DRAWN = f"WITH drawn(c, f) AS (VALUES {_drawn()}), " + forms("documents", "doc_id", "d")
ORACLE["p10_forms"] = DRAWN + " SELECT doc_id, form FROM d"
ORACLE["p10_found"] = DRAWN + " SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM d a JOIN d b ON a.form = b.form AND a.text <> b.text AND a.doc_id < b.doc_id"
ORACLE["p10_classes"] = DRAWN + """, k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY form) AS class_id, count(*) OVER (PARTITION BY form) - count(*) OVER (PARTITION BY form, text) AS n_links FROM d WHERE text IS NOT NULL)
SELECT * FROM k WHERE n_links > 0"""


def windows(name: str, key: str) -> str:
    return f"SELECT DISTINCT {key}, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT {key}, w, unnest(generate_series(1, len(w) - 11)) AS i FROM (SELECT {key}, regexp_extract_all(lower(form), '[\\p{{L}}\\p{{N}}]+') AS w FROM {name}) WHERE len(w) >= 12)"


ORACLE["p8_found"] = DRAWN + f", {forms('eval_items', 'item_id', 'e')} SELECT DISTINCT doc_id, item_id FROM ({windows('d', 'doc_id')}) JOIN ({windows('e', 'item_id')}) USING (g)"
