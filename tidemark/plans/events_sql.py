"""The event queries in plain SQL."""

from .market_sql import CALLS, EV, PX, RETURNS, iso, num, r6

KEY = "ticker, quarter, year"
NUMBERS = ["n_turns", "hedge_per_1k", "answer_question_ratio", "full_n_words", "full_vader_mean", "full_lm_net", "qa_vader_mean", "qa_lm_net", "abnormal_30d"]
FT = f"""ft AS (SELECT * FROM (SELECT upper(trim(ticker)) AS ticker, lower(trim(quarter)) AS quarter, year, max(matched_earnings_date) AS date, max(has_qa) AS has_qa, {", ".join(f"max({num(f'{c}::DOUBLE', 9)}) AS {c}" for c in NUMBERS)}
  FROM sentiment_features GROUP BY ALL) WHERE date IS NOT NULL)"""
SEC = "sec AS (SELECT DISTINCT ticker, 'S' || (ascii(ticker[1]) % 4) AS sector FROM ft WHERE ascii(ticker[1]) % 4 < 3)"
W = "(PARTITION BY ticker ORDER BY date, quarter, year)"
PAST = "(PARTITION BY ticker ORDER BY date, quarter, year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
Z = ", ".join(f"CASE WHEN count({c}) OVER {PAST} >= 3 AND stddev_samp({c}) OVER {PAST} >= 1e-12 THEN ({c} - avg({c}) OVER {PAST}) / stddev_samp({c}) OVER {PAST} END AS {c}_z" for c in ("full_vader_mean", "full_lm_net", "qa_vader_mean", "qa_lm_net"))
QOQ = ", ".join(f"{c} - lag({c}) OVER {W} AS {c}_qoq" for c in ("full_lm_net", "full_vader_mean", "qa_vader_mean", "hedge_per_1k", "answer_question_ratio", "full_n_words"))
at = lambda n: f"(SELECT close FROM ix WHERE ix.ticker = b1.ticker AND ix.cal_idx = b1.e - {n})"
FEATURES = f"""{PX}, {EV}, {FT}, {SEC},
b0 AS (SELECT ft.*, coalesce(sector, 'Other') AS sector FROM ft LEFT JOIN sec USING (ticker)),
b1 AS (SELECT b0.*, (SELECT min(cal_idx) FROM cal WHERE cal.date >= b0.date) AS e FROM b0),
b2 AS (SELECT b1.*, {at(0)} / nullif({at(5)}, 0) - 1 AS pre_momentum_5d, {at(0)} / nullif({at(20)}, 0) - 1 AS pre_momentum_20d FROM b1),
b3 AS (SELECT b2.*, ev.eps_surprise_pct FROM b2 LEFT JOIN ev ON ev.ticker = b2.ticker AND ev.eps_surprise_pct IS NOT NULL AND abs(date_diff('day', ev.earnings_date, b2.date)) <= 30
  QUALIFY row_number() OVER (PARTITION BY b2.ticker, quarter, year ORDER BY abs(date_diff('day', ev.earnings_date, b2.date)), ev.earnings_date) = 1),
rr AS (SELECT ticker, date, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS r FROM px),
vv AS (SELECT ticker, date, CASE WHEN count(r) OVER w >= 30 THEN stddev_samp(r) OVER w END AS vol FROM rr WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
b4 AS (SELECT b3.*, vol AS pre_vol_60d FROM b3 LEFT JOIN vv ON vv.ticker = b3.ticker AND vol IS NOT NULL AND vv.date <= b3.date AND date_diff('day', vv.date, b3.date) <= 10
  QUALIFY row_number() OVER (PARTITION BY b3.ticker, quarter, year ORDER BY vv.date DESC) = 1),
b5 AS (SELECT *, eps_surprise_pct / nullif(CASE WHEN count(eps_surprise_pct) OVER {PAST} >= 2 THEN stddev_samp(eps_surprise_pct) OVER {PAST} END, 0) AS q, sign(coalesce(eps_surprise_pct, 0))::INT AS s, {Z}, {QOQ},
  CASE WHEN count(abnormal_30d) OVER {PAST} >= 2 THEN avg(abnormal_30d) OVER {PAST} END AS past_abnormal_30d_mean, CASE WHEN count(abnormal_30d) OVER {PAST} >= 2 THEN stddev_samp(abnormal_30d) OVER {PAST} END AS past_abnormal_30d_std FROM b4),
b6 AS (SELECT *, CASE WHEN q IS NULL THEN 0 ELSE greatest(-10, least(10, q)) END AS sue, CASE WHEN s = 0 OR lag(s) OVER {W} IS DISTINCT FROM s THEN 1 ELSE 0 END AS fresh, CASE WHEN pre_vol_60d IS NOT NULL THEN greatest(pre_vol_60d * sqrt(30), 0.03) END AS scale0 FROM b5),
b7 AS (SELECT *, sum(fresh) OVER {W} AS isle FROM b6),
b8 AS (SELECT *, row_number() OVER (PARTITION BY ticker, isle ORDER BY date, quarter, year) * s AS run FROM b7),
b9 AS (SELECT *, coalesce(lag(run) OVER {W}, 0) AS surprise_streak, coalesce(scale0, (SELECT quantile_cont(scale0, 0.5) FROM b8)) AS va_scale, coalesce(past_abnormal_30d_mean, 0) AS va_mean FROM b8),
ef AS (SELECT *, (abnormal_30d - va_mean) / va_scale AS abnormal_30d_va, {", ".join(f"coalesce({c}, 0) * coalesce(eps_surprise_pct, 0) AS ix_{c}_x_surprise" for c in ("full_lm_net", "full_lm_net_z", "full_vader_mean", "full_vader_mean_z"))},
  qa_vader_mean - full_vader_mean AS qa_delta_vader_mean, qa_lm_net - full_lm_net AS qa_delta_lm_net FROM b9)"""
NAMES = ["pre_momentum_5d", "pre_momentum_20d", "eps_surprise_pct", "sue", "surprise_streak", "pre_vol_60d", "full_vader_mean_z", "full_lm_net_z", "qa_vader_mean_z", "qa_lm_net_z", "full_lm_net_qoq", "full_vader_mean_qoq", "qa_vader_mean_qoq", "hedge_per_1k_qoq", "answer_question_ratio_qoq", "full_n_words_qoq", "past_abnormal_30d_mean", "past_abnormal_30d_std", "va_scale", "va_mean", "abnormal_30d_va", "ix_full_lm_net_x_surprise", "ix_full_lm_net_z_x_surprise", "ix_full_vader_mean_x_surprise", "ix_full_vader_mean_z_x_surprise", "qa_delta_vader_mean", "qa_delta_lm_net"]


def _least(c: str) -> str:
    if c.startswith("va_") or c == "abnormal_30d_va":
        return "2"
    return "0.3" if c.startswith("qa_delta") else "0.5" if c.endswith(("_z", "_qoq")) or c.startswith("past_") else "0.95"


ORACLE = {
    "event_features": f"WITH {FEATURES} SELECT {KEY}, {iso('date')}, sector, {', '.join(r6(c) for c in NAMES)} FROM ef",
    "full_sample_scores": f"WITH {FT} SELECT {KEY}, {', '.join(r6(f'CASE WHEN count({c}) OVER w >= 3 AND stddev_samp({c}) OVER w >= 1e-12 THEN ({c} - avg({c}) OVER w) / stddev_samp({c}) OVER w END', f'{c}_fz') for c in ('full_lm_net', 'full_vader_mean'))} FROM ft WINDOW w AS (PARTITION BY ticker)",
    "sectors_of_tickers": f"WITH {EV}, {FT}, {SEC} SELECT DISTINCT ev.ticker, coalesce(sector, 'Other') AS sector FROM ev LEFT JOIN sec USING (ticker)",
    "valid_calls": "SELECT DISTINCT upper(trim(ticker)) AS ticker, lower(trim(quarter)) AS quarter, year FROM transcripts_text WHERE year >= 2023 AND length(trim(qa_z)) > 0 AND lower(trim(quarter)) IN ('q1', 'q2', 'q3', 'q4')",
    "column_coverage": f"WITH {FEATURES} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, {r6(f'count({c}) / count(*)', 'share')}, count({c}) / count(*) > {_least(c)} AS candidate FROM ef" for c in NAMES),
    "renamed_features": f"WITH {FT} SELECT {KEY}, {r6('full_vader_mean')}, {r6('full_lm_net')} FROM ft",
    "median_fill": f"WITH {FT} SELECT {KEY}, {r6('coalesce(abnormal_30d, (SELECT quantile_cont(abnormal_30d, 0.5) FROM ft))', 'abnormal_30d')} FROM ft",
    "call_summary": f"""WITH c AS (SELECT upper(trim(ticker)) AS ticker, pub_date, has_qa, n_words_full, n_analyst_questions FROM transcripts_text
  QUALIFY row_number() OVER (PARTITION BY upper(trim(ticker)), lower(trim(quarter)), year ORDER BY loaded_at DESC NULLS LAST, pub_date DESC NULLS LAST, has_qa DESC NULLS LAST, n_words_full DESC NULLS LAST, n_analyst_questions DESC NULLS LAST) = 1)
SELECT count(*) AS n, count(DISTINCT ticker) AS tickers, {iso("min(pub_date)", "first")}, {iso("max(pub_date)", "last")}, {r6("avg(has_qa)", "qa_share")}, quantile_cont(n_words_full, 0.5) AS median_n_words_full, quantile_cont(n_analyst_questions, 0.5) AS median_n_analyst_questions FROM c""",
    "covered_tickers": f"WITH {FT}, c AS (SELECT ticker, avg((abnormal_30d IS NOT NULL)::INT) AS coverage FROM ft GROUP BY 1) SELECT ticker, {r6('coverage')} FROM c WHERE coverage >= 0.8",
    "key_overlap": f"WITH {CALLS}, {FT}, j AS (SELECT c.ticker, f.ticker AS t FROM calls c LEFT JOIN ft f ON f.ticker = c.ticker AND f.quarter = c.quarter AND f.year = c.year) SELECT count(t) AS both, count(*) = count(t) AS covered FROM j",
    "first_calls": f"WITH {FT} SELECT {KEY} FROM ft ORDER BY ticker, year, quarter LIMIT 10",
    "top_and_bottom": f"WITH {FT}, r AS (SELECT *, row_number() OVER (ORDER BY abnormal_30d DESC, ticker, quarter, year) AS a, row_number() OVER (ORDER BY abnormal_30d, ticker DESC, quarter DESC, year DESC) AS b FROM ft WHERE abnormal_30d IS NOT NULL) SELECT {KEY}, {r6('abnormal_30d')} FROM r WHERE a <= 15 OR b <= 15",
    "sampled_calls": f"WITH {FT} SELECT {KEY} FROM ft ORDER BY md5(ticker || '|' || quarter || '|' || year), ticker, quarter, year LIMIT 5000",
    "row_folds": f"""WITH {FT}, p AS (SELECT *, row_number() OVER (ORDER BY date, ticker, quarter, year) - 1 AS i, count(*) OVER () AS n FROM ft), s AS (SELECT *, floor(n * 0.7 + 1e-9) AS s0 FROM p)
SELECT {KEY}, ({" + ".join(f"(i >= floor(s0 + (n - s0) * {k} / 3 + 1e-9))::INT" for k in range(3))})::INT AS fold FROM s""",
    "earnings_clean": "SELECT DISTINCT upper(trim(ticker)) AS ticker, strftime(earnings_date, '%Y-%m-%d') AS earnings_date, CASE WHEN NOT isnan(reported_eps) THEN reported_eps END AS reported_eps, CASE WHEN NOT isnan(eps_surprise_pct) THEN eps_surprise_pct END AS eps_surprise_pct FROM earnings WHERE earnings_date >= DATE '2023-01-01'",
    "last_prices": f"""WITH p AS (SELECT upper(trim(ticker)) AS ticker, date, loaded_at, {num("close")} AS close, {num("volume")} AS volume FROM prices WHERE date IS NOT NULL)
SELECT ticker, {iso("date")}, arg_max(close, (loaded_at, close)) FILTER (close IS NOT NULL) AS close, arg_max(volume, (loaded_at, volume)) FILTER (volume IS NOT NULL) AS volume FROM p GROUP BY ticker, date""",
}
_RET = RETURNS[RETURNS.index("vx AS ("):]
_FENT = "fent AS (SELECT ticker, earnings_date, (SELECT min(cal_idx) FROM cal WHERE cal.date >= earnings_date) AS e FROM fb)"
_FRET = _RET[_RET.index("ret AS (") :].replace("ret AS (", "fret AS (").replace("ent.", "fent.").replace("FROM ent ", "FROM fent ")
ORACLE["call_returns"] = f"""WITH {RETURNS}, {CALLS},
nr AS (SELECT c.ticker, quarter, year, pub_date, r.earnings_date AS m FROM calls c LEFT JOIN ret r ON r.ticker = c.ticker AND abs(date_diff('day', pub_date, r.earnings_date)) <= 30 WHERE pub_date IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY c.ticker, quarter, year ORDER BY abs(date_diff('day', pub_date, r.earnings_date)), r.earnings_date) = 1),
fb AS (SELECT DISTINCT ticker, pub_date AS earnings_date FROM nr WHERE m IS NULL), {_FENT}, {_FRET},
allr AS (SELECT nr.*, ret.* EXCLUDE (ticker, earnings_date), m AS matched, 'earnings_date' AS return_anchor FROM nr JOIN ret ON ret.ticker = nr.ticker AND ret.earnings_date = m
  UNION ALL SELECT nr.*, fret.* EXCLUDE (ticker, earnings_date), pub_date, 'pub_date' FROM nr JOIN fret ON fret.ticker = nr.ticker AND fret.earnings_date = pub_date WHERE m IS NULL AND return_1d IS NOT NULL)
SELECT {KEY}, {iso("pub_date")}, {iso("matched", "matched_earnings_date")}, {", ".join(r6(f"{k}_{n}d") for k in ("return", "abnormal") for n in (1, 30, 90))}, {r6("vix_close")}, is_covid, abs(date_diff('day', pub_date, matched))::INT AS day_diff, return_anchor FROM allr"""
