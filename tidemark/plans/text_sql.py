"""The text and table queries in plain SQL."""

from ..functions import features as X
from ..functions import patterns as P
from ..functions import polarity as V
from ..functions.text import SPACE, spaced
from ..operators.events import Z_COLS
from ..operators.incremental import SCORE_FIELDS
from .market_sql import EV, PX, iso, r6
from .strategy_sql import PRED

CALLS = """calls AS (
  SELECT upper(trim(ticker)) AS ticker, lower(trim(quarter)) AS quarter, year, pub_date, lower(trim(source)) AS source, full_z, prep_z, qa_z, has_qa, n_turns, loaded_at FROM transcripts_text
  QUALIFY row_number() OVER (PARTITION BY upper(trim(ticker)), lower(trim(quarter)), year ORDER BY loaded_at DESC NULLS LAST) = 1)"""
KEY = "ticker, quarter, year"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(e: str) -> str:
    return f"regexp_replace({e}, {q(f'^{SPACE}+|{SPACE}+$')}, '', 'g')"


def clean(c: str) -> str:
    t = f"regexp_replace(coalesce({c}, ''), '<[^>]+>', ' ', 'g')"
    t = f"replace(translate({t}, '‘’“”–', {q(chr(39) * 2 + chr(34) * 2 + '-')}), '—', '--')"
    for p in P.BOILERPLATE:
        t = f"regexp_replace({t}, {q('(?i)' + spaced(p))}, ' ', 'g')"
    t = strip(f"regexp_replace({t}, {q(SPACE + '+')}, ' ', 'g')")
    t = f"regexp_replace({t}, ' *\\. *\\. *\\. *', '. ', 'g')"
    t = f"regexp_replace({t}, ' *, *, *', ', ', 'g')"
    return f"regexp_replace({t}, ' {{2,}}', ' ', 'g')"


SECT = f"""{CALLS}, sect AS (
  SELECT {KEY}, 'full' AS section, coalesce(full_z, '') AS text FROM calls UNION ALL SELECT {KEY}, 'prepared_remarks', coalesce(prep_z, '') FROM calls WHERE has_qa = 1
  UNION ALL SELECT {KEY}, 'qa', coalesce(qa_z, '') FROM calls WHERE has_qa = 1)"""
WORDS = f"list_filter(regexp_split_to_array(text, {q(SPACE + '+')}), lambda w: w <> '')"
SENT = f"list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: length({strip('s')}) > 0)"
TOKENS = "regexp_extract_all(lower(text), '[a-z'']+')"


def has(lex: list[str]) -> str:
    return f"len(list_filter({TOKENS}, lambda t: list_contains([{', '.join(map(q, lex))}], t)))"


LING = "round_even(coalesce(len(list_distinct(list_transform(w, lambda v: lower(v)))) / nullif(len(w), 0), 0), 4) AS unique_word_ratio, round_even(coalesce(len(w) / nullif(s, 0), 0), 1) AS avg_sentence_length"
LM3 = (("lm_net", "(p - n) / (p + n + 1)"), ("lm_pos_ratio", "p / (p + n + 1)"), ("lm_neg_ratio", "n / (p + n + 1)"))
READ = f"""fam AS (SELECT list(DISTINCT w) AS f FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z'']+')) AS w FROM level_samples WHERE grade <= 4)),
r AS (SELECT {KEY}, section, {TOKENS} AS tk, greatest(1, len({SENT}))::DOUBLE AS s FROM sect),
tw AS (SELECT {KEY}, section, count(*) AS strange FROM (SELECT {KEY}, section, unnest(tk) AS w FROM r) WHERE w NOT IN (SELECT unnest(f) FROM fam) GROUP BY ALL),
c AS (SELECT r.* EXCLUDE (tk), len(tk)::DOUBLE AS n, coalesce(strange, 0)::DOUBLE AS strange, list_sum(list_transform(tk, lambda w: length(w)))::DOUBLE AS l,
  list_sum(list_transform(tk, lambda w: greatest(1, len(regexp_extract_all(w, '[aeiouy]+')))))::DOUBLE AS ys, len(list_filter(tk, lambda w: len(regexp_extract_all(w, '[aeiouy]+')) >= 3))::DOUBLE AS h FROM r LEFT JOIN tw USING ({KEY}, section))"""
SIX = (("flesch_reading_ease", "206.835 - 1.015 * n / s - 84.6 * ys / n"), ("flesch_kincaid_grade", "0.39 * n / s + 11.8 * ys / n - 15.59"), ("gunning_fog", "0.4 * (n / s + 100 * h / n)"), ("smog_index", "1.043 * sqrt(30 * h / s) + 3.1291"), ("automated_readability", "4.71 * l / n + 0.5 * n / s - 21.43"), ("dale_chall_score", "0.1579 * (100 * strange / n) + 0.0496 * n / s + CASE WHEN 100 * strange / n > 5 THEN 3.6365 ELSE 0 END"))
QWORDS = f"list_filter(regexp_split_to_array(qa_z, {q(SPACE + '+')}), lambda w: w <> '')"
CUT100 = "CASE WHEN len(w) > 100 THEN array_to_string(w[1:100], ' ') || ' [TRUNCATED]' ELSE qa_z END"
# Greedy packing, one sentence of every text at a time.
PACK = f"""{SECT}, ps AS (SELECT {KEY}, section, list_filter(string_split(regexp_replace({strip("text")}, {q(f"([.!?]){SPACE}+")}, '\\1' || chr(1), 'g'), chr(1)), lambda z: z <> '') AS s FROM sect),
pw AS (SELECT *, list_transform(s, lambda z: len(list_filter(regexp_split_to_array(z, {q(SPACE + "+")}), lambda w: w <> ''))) AS k FROM ps WHERE len(s) > 0),
st AS (SELECT {KEY}, section, 1 AS j, 0 AS i, k[1] AS n FROM pw
  UNION ALL SELECT st.ticker, st.quarter, st.year, st.section, j + 1, CASE WHEN n + k[j + 1] > 256 THEN i + 1 ELSE i END, CASE WHEN n + k[j + 1] > 256 THEN k[j + 1] ELSE n + k[j + 1] END FROM st JOIN pw USING ({KEY}, section) WHERE j < len(k)),
packed AS (SELECT {KEY}, section, i, string_agg(s[j], ' ' ORDER BY j) AS chunk FROM st JOIN pw USING ({KEY}, section) GROUP BY ALL)"""
LABEL = "CASE WHEN round(positive, 12) = round(greatest(positive, negative, neutral), 12) THEN 'positive' WHEN round(negative, 12) = round(greatest(positive, negative, neutral), 12) THEN 'negative' ELSE 'neutral' END"
IN = lambda lex: f"len(list_filter(regexp_extract_all(lower(chunk), '[a-z'']+'), lambda t: list_contains([{', '.join(map(q, lex))}], t)))"
PROBS = f"""e AS (SELECT {KEY}, section, exp({IN(P.POSITIVE)} / 4) AS a, exp({IN(P.NEGATIVE)} / 4) AS b, exp(1) AS c FROM packed),
pr AS (SELECT {KEY}, section, count(*) AS chunks, avg(a / (a + b + c)) AS positive, avg(b / (a + b + c)) AS negative, avg(c / (a + b + c)) AS neutral FROM e GROUP BY ALL),
pl AS (SELECT {KEY}, section, coalesce(chunks, 0) AS chunks, positive, negative, neutral, {LABEL} AS label FROM sect LEFT JOIN pr USING ({KEY}, section))"""
MARK = q("(?i)(" + spaced(P.SECTION_MARK) + ")")
TURN = r"^([A-Z][A-Za-z.''-]*(?: [A-Z][A-Za-z.''-]*){0,3}(?: -- [^:]{1,60}| \([^)]{1,40}\))?): ?(.*)$"
NAME = "regexp_extract_all(regexp_split_to_array(lower(speaker), '--|—|\\(|,')[1], '[a-z]+')"
SCORES = ", ".join(f"greatest({low}, least({high}, k - {i}))::INT AS {f}" for i, (f, (low, high, _)) in enumerate(SCORE_FIELDS.items()))

HEDGES = q("(?i)" + spaced(P.HEDGES))
TURNS = f"""l AS (SELECT {KEY}, part, unnest(string_split(t, chr(10))) AS raw, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM (SELECT {KEY}, 1 AS part, prep_z AS t FROM calls UNION ALL SELECT {KEY}, 2, qa_z FROM calls)),
ls AS (SELECT {KEY}, part, i, {strip("raw")} AS line FROM l),
lf AS (SELECT *, regexp_matches(line, '{TURN}') AS named, row_number() OVER (PARTITION BY {KEY}, part ORDER BY i) AS n FROM ls WHERE line <> ''),
lg AS (SELECT *, sum((named OR n = 1)::INT) OVER (PARTITION BY {KEY}, part ORDER BY n) AS g, CASE WHEN named THEN regexp_extract(line, '{TURN}', 2) ELSE line END AS said FROM lf),
tg AS (SELECT {KEY}, part, g, max(CASE WHEN named THEN regexp_extract(line, '{TURN}', 1) ELSE '' END) AS speaker, coalesce(string_agg(said, ' ' ORDER BY n) FILTER (said <> ''), '') AS text FROM lg GROUP BY ALL),
tu AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY part, g) - 1 AS i, regexp_matches(speaker, '(?i){P.MODERATOR}') AS moderator FROM tg),
tb AS (SELECT {KEY}, coalesce(arg_min(i + moderator::INT, i) FILTER (regexp_matches(text, {q("(?i)" + spaced(P.QUESTIONS_BEGIN))})), max(i) + 1) AS b FROM tu GROUP BY ALL),
tk AS (SELECT tu.*, i >= b AS qa, {NAME} AS nm, speaker <> '' AND NOT moderator AS counts, len(list_filter(regexp_split_to_array(text, {q(SPACE + "+")}), lambda w: w <> '')) AS w, len(regexp_extract_all(text, {HEDGES})) AS hd, contains(text, '?') AS asks FROM tu JOIN tb USING ({KEY})),
tn AS (SELECT *, CASE WHEN len(nm) = 0 THEN '' WHEN len(nm) = 1 THEN nm[1] ELSE nm[1] || ' ' || nm[-1] END AS key FROM tk),
te AS (SELECT *, (max((counts AND NOT qa)::INT) OVER (PARTITION BY {KEY}, key) = 1 AND key <> '') OR coalesce(avg(CASE WHEN counts AND qa THEN asks::INT END) OVER (PARTITION BY {KEY}, key) < 0.5, false) AS ex FROM tn),
ta AS (SELECT {KEY}, count(*) AS n_turns, coalesce(string_agg(text, ' ' ORDER BY i) FILTER (NOT qa), '') AS prepared_text, coalesce(string_agg(text, ' ' ORDER BY i) FILTER (qa), '') AS q,
  count(DISTINCT key) FILTER (NOT qa AND counts AND key <> '') AS n_exec_speakers, count(DISTINCT key) FILTER (qa AND counts AND NOT ex) AS n_analyst_speakers, count(*) FILTER (qa AND counts AND NOT ex AND asks) AS n_analyst_questions,
  coalesce(sum(w) FILTER (qa AND counts AND NOT ex), 0) AS analyst_q_words, coalesce(sum(w) FILTER (qa AND counts AND ex), 0) AS exec_a_words, coalesce(sum(hd) FILTER (qa AND counts AND ex), 0) AS h FROM te GROUP BY ALL),
split AS (SELECT {KEY}, coalesce(prepared_text, '') AS prepared_text, CASE WHEN length(q) >= 250 THEN q ELSE '' END AS qa_text, {strip("concat_ws(' ', coalesce(prepared_text, ''), coalesce(q, ''))")} AS full_text, coalesce(length(q) >= 250, false)::INT AS has_qa,
  {", ".join(f"coalesce({c}, 0)::INT AS {c}" for c in ("n_turns", "n_exec_speakers", "n_analyst_speakers", "n_analyst_questions", "analyst_q_words", "exec_a_words"))},
  coalesce(exec_a_words / nullif(analyst_q_words, 0), 0) AS answer_question_ratio, coalesce(h * 1000 / nullif(exec_a_words, 0), 0) AS hedge_per_1k FROM (SELECT {KEY} FROM calls) LEFT JOIN ta USING ({KEY}))"""

# The polarity rules, a word at a time with the three words before it; chunk -1 is the whole text.
def words_of(lex) -> str:
    return "(" + ", ".join(map(q, lex)) + ")"


def negates(c: str) -> str:
    return f"({c} IN {words_of(V.NEGATING)} OR contains({c}, {q(chr(110) + chr(39) + chr(116))}))"


def step(n: int, back: int) -> str:
    """One place further back: boosters, then negations, of a word that is not in the lexicon itself."""
    c, near = f"l{back}", [f"l{k}" for k in range(1, back)]
    between = lambda w: "(" + " OR ".join(f"{x} = {q(w)}" for x in near) + ")"
    special = f"WHEN {c} = 'never' AND ({between('so')} OR {between('this')}) THEN 1.25 WHEN {c} = 'without' AND {between('doubt')} THEN 1 " if near else ""
    weight = (1, 0.95, 0.9)[back - 1]
    boost = f"CASE WHEN {c} IN {words_of(V.RAISING)} THEN 0.293 WHEN {c} IN {words_of(V.LOWERING)} THEN -0.293 ELSE 0 END"
    raised = f"(v + CASE WHEN {boost} <> 0 THEN ({boost} * sign(v) + CASE WHEN mixed AND u{back} THEN 0.733 * sign(v) ELSE 0 END) * {weight} ELSE 0 END)"
    out = f"{raised} * CASE {special}WHEN {negates(c)} THEN -0.74 ELSE 1 END"
    return f"v{n} AS (SELECT * REPLACE (CASE WHEN v <> 0 AND {c} IS NOT NULL AND {c} NOT IN {words_of(P.VALENCE)} THEN {out} ELSE v END AS v) FROM v{n - 1})"


TONE = f"""{SECT}, sp AS (SELECT {KEY}, section, text, regexp_split_to_array(text, '[.!?]+') AS s FROM sect WHERE length({strip("text")}) > 0),
ck AS (SELECT {KEY}, section, -1 AS chunk, text AS t FROM sp UNION ALL SELECT {KEY}, section, i, array_to_string(s[i * 5 + 1:i * 5 + 5], ' ') FROM (SELECT *, unnest(generate_series(0, (len(s) - 1) // 5)) AS i FROM sp)),
cc AS (SELECT * FROM ck WHERE length({strip("t")}) > 0),
wd AS (SELECT {KEY}, section, chunk, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT *, list_filter(regexp_split_to_array(t, {q(SPACE + "+")}), lambda w: w <> '') AS ws FROM cc)),
wt AS (SELECT * REPLACE (CASE WHEN length(regexp_replace(w, '^[^\\w]+|[^\\w]+$', '', 'g')) > 2 THEN regexp_replace(w, '^[^\\w]+|[^\\w]+$', '', 'g') ELSE w END AS w) FROM wd),
wu AS (SELECT *, lower(w) AS low, w = upper(w) AND w <> lower(w) AS up FROM wt),
lx(low, val) AS (VALUES {", ".join(f"({q(w)}, {v}::DOUBLE)" for w, v in P.VALENCE.items())}),
wv AS (SELECT wu.*, CASE WHEN wu.low IN {words_of([*V.RAISING, *V.LOWERING])} THEN 0 ELSE coalesce(val, 0) END AS v FROM wu LEFT JOIN lx ON lx.low = wu.low),
wl AS (SELECT *, {", ".join(f"lag(low, {k}) OVER w AS l{k}, lag(up, {k}) OVER w AS u{k}" for k in (1, 2, 3))}, count(*) FILTER (up) OVER g BETWEEN 1 AND count(*) OVER g - 1 AS mixed, min(CASE WHEN low = 'but' THEN i END) OVER g AS but
  FROM wv WINDOW w AS (PARTITION BY {KEY}, section, chunk ORDER BY i), g AS (PARTITION BY {KEY}, section, chunk)),
v0 AS (SELECT * REPLACE (CASE WHEN v <> 0 AND mixed AND up THEN v + 0.733 * sign(v) ELSE v END AS v) FROM wl),
{step(1, 1)}, {step(2, 2)}, {step(3, 3)},
v4 AS (SELECT * REPLACE (CASE WHEN v <> 0 AND l1 = 'least' AND NOT coalesce(l2 IN ('at', 'very'), false) THEN v * -0.74 ELSE v END AS v) FROM v3),
v5 AS (SELECT * REPLACE (v * CASE WHEN i < but THEN 0.5 WHEN i > but THEN 1.5 ELSE 1 END AS v) FROM v4),
ld AS (SELECT {KEY}, section, chunk, least(4, len(regexp_extract_all(t, '!'))) * 0.292 + CASE WHEN len(regexp_extract_all(t, '[?]')) < 2 THEN 0 WHEN len(regexp_extract_all(t, '[?]')) < 4 THEN len(regexp_extract_all(t, '[?]')) * 0.18 ELSE 0.96 END AS loud FROM cc),
sm AS (SELECT {KEY}, section, chunk, round(sum(v), 9) AS total, coalesce(sum(v + 1) FILTER (v > 0), 0) AS pos, coalesce(sum(v - 1) FILTER (v < 0), 0) AS neg, count(*) FILTER (v = 0) AS neu FROM v5 GROUP BY ALL),
s2 AS (SELECT {KEY}, section, chunk, total + CASE WHEN total > 0 THEN loud WHEN total < 0 THEN -loud ELSE 0 END AS total, pos + CASE WHEN pos > -neg THEN loud ELSE 0 END AS pos, neg - CASE WHEN pos < -neg THEN loud ELSE 0 END AS neg, neu FROM sm JOIN ld USING ({KEY}, section, chunk)),
s3 AS (SELECT {KEY}, section, chunk, total / sqrt(total * total + 15) AS c, pos / (pos - neg + neu) AS pos, -neg / (pos - neg + neu) AS neg, neu / (pos - neg + neu) AS neu FROM s2),
s4 AS (SELECT {KEY}, section, max(c) FILTER (chunk < 0) AS compound, {", ".join(f"avg({k}) FILTER (chunk >= 0) AS {k}" for k in ("pos", "neg", "neu"))}, avg(c) FILTER (chunk >= 0) AS mean, stddev_pop(c) FILTER (chunk >= 0) AS std, min(c) FILTER (chunk >= 0) AS min, max(c) FILTER (chunk >= 0) AS max,
  quantile_cont(c, 0.1) FILTER (chunk >= 0) AS p10, quantile_cont(c, 0.9) FILTER (chunk >= 0) AS p90, avg((c < -0.05)::INT) FILTER (chunk >= 0) AS pct_neg, avg((c > 0.05)::INT) FILTER (chunk >= 0) AS pct_pos, count(*) FILTER (chunk >= 0) AS n_chunks, count(*) FILTER (chunk >= 0) AS n_paragraphs FROM s3 GROUP BY ALL),
tone AS (SELECT {KEY}, section, {", ".join(f"CASE WHEN coalesce(n_chunks, 0) = 0 THEN 0 ELSE {k} END AS {k}" for k in V.KEYS)} FROM sect LEFT JOIN s4 USING ({KEY}, section))"""

ORACLE = {
    "clean_transcript": f"WITH {CALLS} SELECT {KEY}, {clean('full_z')} AS clean FROM calls",
    "boilerplate_lines": f"WITH {CALLS}, l AS (SELECT {KEY}, unnest(string_split(full_z, chr(10))) AS line FROM calls) SELECT {KEY}, sum(({' OR '.join(f'contains(lower(line), {q(p)})' for p in P.BOILERPLATE_PHRASES)})::INT)::BIGINT AS n_boilerplate, count(*) AS n_lines FROM l GROUP BY ALL",
    "split_sections": f"""WITH {CALLS}, m AS (SELECT {KEY}, full_z, regexp_extract(full_z, {MARK}, 1) AS mark FROM calls),
s AS (SELECT *, CASE WHEN mark <> '' THEN {strip("substr(full_z, instr(full_z, mark) + length(mark))")} END AS qa, CASE WHEN mark <> '' THEN {strip("substr(full_z, 1, instr(full_z, mark) - 1)")} END AS prep FROM m)
SELECT {KEY}, CASE WHEN length(qa) >= 250 THEN length(prep) END::INT AS n_prepared, CASE WHEN length(qa) >= 250 THEN length(qa) END::INT AS n_qa, CASE WHEN length(qa) >= 250 THEN NULL ELSE length(full_z) END::INT AS n_full FROM s""",
    "section_texts": f"WITH {SECT} SELECT {KEY}, section, length(text)::INT AS n_chars, md5(text) AS digest FROM sect",
    "cleaned_sections": f"""WITH {CALLS}, m AS (SELECT {KEY}, full_z, regexp_extract(full_z, {MARK}, 1) AS mark FROM calls),
s AS (SELECT *, CASE WHEN mark <> '' THEN {strip("substr(full_z, instr(full_z, mark) + length(mark))")} END AS qa, CASE WHEN mark <> '' THEN {strip("substr(full_z, 1, instr(full_z, mark) - 1)")} END AS prep FROM m)
SELECT {KEY}, CASE WHEN length(qa) >= 250 THEN {clean("prep")} END AS prepared, CASE WHEN length(qa) >= 250 THEN {clean("qa")} END AS qa, CASE WHEN length(qa) >= 250 THEN NULL ELSE {clean("full_z")} END AS "full" FROM s""",
    "linguistic_features": f"WITH {SECT}, x AS (SELECT {KEY}, section, {WORDS} AS w, len({SENT}) AS s FROM sect) SELECT {KEY}, section, s::INT AS n_sentences, len(w)::INT AS n_words, {LING} FROM x",
    "lm_counts": f"WITH {SECT}, x AS (SELECT {KEY}, section, {has(P.POSITIVE)} AS p, {has(P.NEGATIVE)} AS n FROM sect) SELECT {KEY}, section, p::INT AS lm_positive, n::INT AS lm_negative, {', '.join(r6(e, k) for k, e in LM3)} FROM x",
    "readability": f"WITH {SECT}, {READ} SELECT {KEY}, section, {', '.join(r6(f'CASE WHEN n > 0 THEN {e} ELSE 0 END', k) for k, e in SIX)} FROM c",
    "plain_features": f"""WITH {SECT}, {READ}, a AS (SELECT {KEY}, section, {WORDS} AS w, {SENT} AS st, {has(P.POSITIVE)} AS p, {has(P.NEGATIVE)} AS q FROM sect),
l AS (SELECT {KEY}, section, p, q, len(st) AS n_s, len(w) AS n_w, {LING.replace("nullif(s, 0)", "nullif(len(st), 0)")} FROM a)
SELECT {KEY}, section, {r6("p", "lm_positive")}, {r6("q", "lm_negative")}, {", ".join(r6("0", f"lm_{k}") for k in ("uncertainty", "litigious", "constraining", "strong_modal", "weak_modal"))}, {", ".join(r6(e.replace("n)", "q)").replace("n +", "q +").replace("n /", "q /"), k) for k, e in LM3)},
  {r6("n_s", "n_sentences")}, {r6("n_w", "n_words")}, {r6("unique_word_ratio")}, {r6("avg_sentence_length")}, {", ".join(r6(f"CASE WHEN n > 0 THEN {e} ELSE 0 END", k) for k, e in SIX)} FROM l JOIN c USING ({KEY}, section)""",
    "prompts": f"WITH {CALLS}, x AS (SELECT {KEY}, qa_z, {QWORDS} AS w FROM calls WHERE qa_z IS NOT NULL) SELECT {KEY}, md5('Score this.' || chr(10) || chr(10) || '--- TRANSCRIPT Q&A SECTION ---' || chr(10) || {CUT100} || chr(10) || '--- END TRANSCRIPT ---' || chr(10) || chr(10) || 'JSON:') AS digest FROM x",
    "scored_calls": f"""WITH {CALLS}, x AS (SELECT {KEY}, qa_z, {QWORDS} AS w FROM calls WHERE qa_z IS NOT NULL), n AS (SELECT {KEY}, len(regexp_extract_all(CASE WHEN len(w) > 5000 THEN array_to_string(w[1:5000], ' ') ELSE qa_z END, '\\?')) AS n FROM x)
SELECT {KEY}, {", ".join(f"least(30, n)::INT AS {f}" if f == "n_questions_dodged" else f"0 AS {f}" for f in SCORE_FIELDS)}, CASE WHEN n % 3 = 0 THEN 2 ELSE 1 END AS attempts FROM n""",
    "scoring_cost": f"WITH {CALLS}, x AS (SELECT ceil(({len("Score this.") + 2 + len("--- TRANSCRIPT Q&A SECTION ---") + 1 + 1 + len("--- END TRANSCRIPT ---") + 2 + len("JSON:")} + length(CASE WHEN len({QWORDS}) > 5000 THEN array_to_string(({QWORDS})[1:5000], ' ') || ' [TRUNCATED]' ELSE qa_z END)) / 4) AS t FROM calls WHERE qa_z IS NOT NULL) SELECT count(*) AS calls, sum(t)::BIGINT AS tokens_in, {r6('(sum(t) * 0.1 + count(*) * 150 * 0.4) / 1e6', 'cost')} FROM x",
    "sentence_groups": f"""WITH {SECT}, x AS (SELECT {KEY}, section, list_transform({SENT}, lambda z: {strip("z")}) AS s FROM sect),
g AS (SELECT {KEY}, section, s, unnest(generate_series(0, (len(s) - 1) // 5)) AS i FROM x WHERE len(s) > 0), c AS (SELECT {KEY}, section, i::INT AS i, array_to_string(s[i * 5 + 1:i * 5 + 5], '. ') AS chunk FROM g)
SELECT {KEY}, section, i, length(chunk)::INT AS n_chars, md5(chunk) AS digest FROM c""",
    "packed_sentences": f"WITH RECURSIVE {PACK} SELECT {KEY}, section, i, len(list_filter(regexp_split_to_array(chunk, {q(SPACE + '+')}), lambda w: w <> ''))::INT AS n_words, md5(chunk) AS digest FROM packed",
    "chunk_probabilities": f"WITH RECURSIVE {PACK}, {PROBS} SELECT {KEY}, section, chunks, label, {r6('positive')}, {r6('negative')}, {r6('neutral')}, {r6('positive - negative', 'net')} FROM pl",
    "tone_combined": f"""WITH RECURSIVE {PACK}, {PROBS}, n AS (SELECT {KEY}, section, len({WORDS}) AS words FROM sect),
b AS (SELECT {KEY}, pl.*  EXCLUDE ({KEY}, section, label), words FROM pl JOIN n USING ({KEY}, section) WHERE section <> 'full'),
t AS (SELECT {KEY}, coalesce(sum(chunks) FILTER (words > 0 AND positive IS NOT NULL), 0)::BIGINT AS chunks, {", ".join(f"sum({k} * words) FILTER (words > 0 AND positive IS NOT NULL) / nullif(sum(words) FILTER (words > 0 AND positive IS NOT NULL), 0) AS {k}" for k in ("positive", "negative", "neutral"))} FROM b GROUP BY ALL)
SELECT {KEY}, chunks, {LABEL} AS label, {r6("positive")}, {r6("negative")}, {r6("neutral")}, {r6("positive - negative", "net")} FROM t""",
    "hedge_rate": f"WITH {CALLS} SELECT {KEY}, coalesce(len(regexp_extract_all(qa_z, {q('(?i)' + spaced(P.HEDGES))})), 0)::INT AS n_hedges FROM calls",
    "truncated_words": f"WITH {CALLS}, x AS (SELECT {KEY}, qa_z, list_filter(regexp_split_to_array(qa_z, {q(SPACE + '+')}), lambda w: w <> '') AS w FROM calls) SELECT {KEY}, CASE WHEN len(w) > 100 THEN array_to_string(w[1:100], ' ') || ' [TRUNCATED]' ELSE qa_z END AS text FROM x",
    "speaker_turns": f"""WITH {CALLS}, l AS (SELECT {KEY}, part, unnest(string_split(t, chr(10))) AS raw, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM (SELECT {KEY}, 1 AS part, prep_z AS t FROM calls UNION ALL SELECT {KEY}, 2, qa_z FROM calls)),
s AS (SELECT {KEY}, part, i, {strip("raw")} AS line FROM l),
f AS (SELECT *, regexp_matches(line, '{TURN}') AS named, row_number() OVER (PARTITION BY {KEY}, part ORDER BY i) AS n FROM s WHERE line <> ''),
t AS (SELECT {KEY}, CASE WHEN named THEN regexp_extract(line, '{TURN}', 1) ELSE '' END AS speaker FROM f WHERE named OR n = 1),
k AS (SELECT *, {NAME} AS nm FROM t),
kk AS (SELECT *, CASE WHEN len(nm) = 0 THEN '' WHEN len(nm) = 1 THEN nm[1] ELSE nm[1] || ' ' || nm[-1] END AS key FROM k)
SELECT {KEY}, count(*) AS n_turns, count(DISTINCT key) FILTER (key <> '') AS n_speakers, sum(regexp_matches(speaker, '(?i){P.MODERATOR}')::INT)::BIGINT AS n_moderator FROM kk GROUP BY ALL""",
    "parsed_props": "SELECT event_type, count(k) AS n, sum(k)::BIGINT AS sum_k FROM (SELECT event_type, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1",
    "validated_scores": f"SELECT event_id, {SCORES} FROM (SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INT) AS k FROM events)",
    "upsert_latest": f"WITH {CALLS} SELECT {KEY}, strftime(loaded_at, '%Y-%m-%d %H:%M:%S') AS loaded_at FROM calls",
    "resume_antijoin": f"WITH {CALLS} SELECT {KEY} FROM calls ANTI JOIN (SELECT upper(trim(ticker)) AS ticker, lower(trim(quarter)) AS quarter, year FROM sentiment_features) USING (ticker, quarter, year)",
    "incremental_cutoff": f"WITH {CALLS}, {PRED}, m AS (SELECT ticker, max(date) AS last FROM pred GROUP BY 1) SELECT c.ticker, quarter, year, {iso('pub_date')} FROM calls c LEFT JOIN m ON m.ticker = c.ticker WHERE pub_date IS NOT NULL AND (last IS NULL OR pub_date > last)",
    "snapshot_counts": f"SELECT {iso('snap_date')}, count(DISTINCT upper(trim(ticker))) AS n FROM analyst_snapshot GROUP BY snap_date",
    "pilot_sample": """WITH t AS (SELECT DISTINCT upper(trim(ticker)) AS ticker FROM transcripts_text), s AS (SELECT ticker, 'S' || (ascii(ticker[1]) % 4) AS sector, least(1.0, 10 / count(*) OVER ()) AS f FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY md5(ticker), ticker) AS n, greatest(1, round_even(count(*) OVER (PARTITION BY sector) * f, 0)) AS k FROM s)
SELECT ticker, sector FROM k WHERE n <= k ORDER BY sector, n LIMIT 10""",
    "fiscal_quarter": f"WITH {EV} SELECT ticker, {iso('earnings_date')}, CASE WHEN month(earnings_date) IN (12, 1, 2) THEN 'q4' WHEN month(earnings_date) <= 5 THEN 'q1' WHEN month(earnings_date) <= 8 THEN 'q2' ELSE 'q3' END AS quarter, (year(earnings_date) + CASE WHEN month(earnings_date) IN (12, 1, 2) THEN 1 ELSE 0 END)::INT AS year FROM ev",
    "filing_window": f"WITH {PX}, {EV} SELECT ev.ticker, {iso('earnings_date')}, strftime(min(date), '%Y-%m-%d') AS first_date FROM ev LEFT JOIN px ON px.ticker = ev.ticker AND date BETWEEN earnings_date - 1 AND earnings_date + 3 GROUP BY ev.ticker, earnings_date",
    "stream_snapshot_dedup": f"SELECT DISTINCT {iso('snap_date')}, upper(trim(ticker)) AS ticker FROM analyst_snapshot",
    "stream_event_counts": f"SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, {r6('sum(value)', 'value')} FROM events GROUP BY 1, 2",
    "filing_exhibit": f"""WITH {PX}, {EV}, x AS (SELECT ticker, date AS filed, dayofmonth(date) % 3 = 0 AS late FROM px WHERE close IS NOT NULL),
f AS (SELECT ticker, filed, i AS seq, CASE WHEN i = 2 AND late THEN 'Exhibit 99' ELSE 'Annex ' || i END AS description, ticker || '/' || filed || '/' || i AS url FROM x, (VALUES (1), (2)) v(i)),
j AS (SELECT ev.ticker, earnings_date, url, description FROM ev LEFT JOIN f ON f.ticker = ev.ticker AND filed BETWEEN earnings_date - 1 AND earnings_date + 3
  QUALIFY row_number() OVER (PARTITION BY ev.ticker, earnings_date ORDER BY filed DESC, description LIKE '%99%' DESC, seq) = 1)
SELECT ticker, {iso("earnings_date")}, url, description FROM j""",
    "new_calls": f"WITH {CALLS}, h AS (SELECT ticker, max(pub_date) AS last FROM calls WHERE pub_date IS NOT NULL AND year <= 2023 GROUP BY 1) SELECT c.ticker, quarter, year, {iso('pub_date')} FROM calls c LEFT JOIN h ON h.ticker = c.ticker WHERE pub_date IS NOT NULL AND year > 2023 AND (last IS NULL OR pub_date > last)",
    "resumed_scores": f"WITH {CALLS} SELECT {KEY}, has_qa * 2 AS score, (SELECT count(*) FROM calls WHERE year % 2 = 1) AS fresh FROM calls",
    "recorded_snapshots": f"SELECT DISTINCT {iso('snap_date')}, upper(trim(ticker)) AS ticker FROM analyst_snapshot",
    "missing_table": "SELECT 0::BIGINT AS n",
    "core_universe": "SELECT upper(trim(ticker)) AS ticker FROM transcripts_text WHERE ticker IS NOT NULL UNION SELECT 'AAA' UNION SELECT 'BMKIDX'",
    "unpivoted_prices": f"WITH v AS (SELECT date, max(CASE WHEN NOT isnan(vix_close) THEN vix_close END) AS c, count(*)::DOUBLE AS n FROM vix GROUP BY 1) SELECT {iso('date')}, 'close' AS field, c AS value FROM v UNION ALL SELECT {iso('date')}, 'rows', n FROM v",
    "stream_upsert": f"WITH {CALLS} SELECT {KEY}, strftime(loaded_at, '%Y-%m-%d %H:%M:%S') AS loaded_at FROM calls",
    "stream_water_mark": f"WITH {PRED}, m AS (SELECT ticker, max(date) AS last FROM pred GROUP BY 1), c AS (SELECT DISTINCT upper(trim(ticker)) AS ticker, lower(trim(quarter)) AS quarter, year, pub_date FROM transcripts_text WHERE pub_date IS NOT NULL) SELECT c.ticker, quarter, year, {iso('pub_date')} FROM c LEFT JOIN m ON m.ticker = c.ticker WHERE last IS NULL OR pub_date > last",
    "split_turns": f"WITH {CALLS}, {TURNS} SELECT * REPLACE (round(answer_question_ratio + 1e-10, 6) + 0.0 AS answer_question_ratio, round(hedge_per_1k + 1e-10, 6) + 0.0 AS hedge_per_1k) FROM split",
    "stored_calls": f"""WITH {CALLS}, {TURNS}, all_calls AS (SELECT s.*, CASE WHEN s.n_turns = 0 THEN {strip("coalesce(full_z, '')")} ELSE full_text END AS whole FROM split s JOIN calls USING ({KEY}))
SELECT {KEY}, has_qa, n_turns, len(list_filter(regexp_split_to_array(whole, {q(SPACE + "+")}), lambda w: w <> ''))::INT AS n_words_full, round_even(answer_question_ratio, 4) AS answer_question_ratio, round_even(hedge_per_1k, 4) AS hedge_per_1k FROM all_calls WHERE whole <> ''""",
    "tone_features": f"WITH {TONE} SELECT {KEY}, section, {', '.join(r6(k) for k in V.KEYS)} FROM tone",
}
_plain = ORACLE["plain_features"].replace(f"WITH {SECT}, ", "", 1)
ORACLE["sentiment_rows"] = f"WITH {TONE}, {_plain[:_plain.index(f'SELECT {KEY}, section, round(p +')].rstrip()}, pf AS ({_plain[_plain.index(f'SELECT {KEY}, section, round(p +'):]}) SELECT {KEY}, section, {', '.join(r6(k, f'vader_{k}') for k in V.KEYS)}, pf.* EXCLUDE ({KEY}, section) FROM tone JOIN pf USING ({KEY}, section)"
ORACLE["section_features"] = f"WITH sr AS ({ORACLE['sentiment_rows']}) SELECT {KEY}, " + ", ".join(f"max({c}) FILTER (section = '{k}') AS {k}_{c}" for k in X.SECTIONS for c in X.ALL) + f" FROM sr GROUP BY {KEY}"
_cols = [f"{s}_{c}" for s in ("full", "qa") for c in Z_COLS if c in X.ALL]
_z = ", ".join(r6(f"CASE WHEN count({c}) OVER w >= 3 AND stddev_samp({c}) OVER w >= 1e-12 THEN ({c} - avg({c}) OVER w) / stddev_samp({c}) OVER w END", f"{c}_z") for c in _cols)
ORACLE["section_z_scores"] = f"WITH sf AS ({ORACLE['section_features']}), {CALLS} SELECT {KEY}, {_z} FROM sf JOIN (SELECT {KEY}, pub_date FROM calls) USING ({KEY}) WINDOW w AS (PARTITION BY ticker ORDER BY pub_date NULLS FIRST, quarter, year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
