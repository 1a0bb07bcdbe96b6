"""The market queries in plain SQL."""


def num(c: str, digits: int = 4) -> str:
    return f"round(CASE WHEN NOT isnan({c}) THEN {c} END, {digits})"


def r6(e: str, name: str | None = None) -> str:
    return f"round({e} + 1e-10, 6) + 0.0 AS {name or e}"


def iso(c: str, name: str | None = None) -> str:
    return f"strftime({c}, '%Y-%m-%d') AS {name or c}"


PX = f"""px AS (
  SELECT upper(trim(ticker)) AS ticker, date, {num("close")} AS close, {num("volume")} AS volume FROM prices WHERE date IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY upper(trim(ticker)), date ORDER BY loaded_at DESC NULLS LAST, {num("close")} DESC NULLS LAST, {num("volume")} DESC NULLS LAST) = 1),
cal AS (SELECT date, (row_number() OVER (ORDER BY date) - 1)::INT AS cal_idx FROM (SELECT DISTINCT date FROM px)),
ix AS (SELECT ticker, date, close, volume, cal_idx FROM px JOIN cal USING (date))"""
EV = f"""ev AS (
  SELECT upper(trim(ticker)) AS ticker, earnings_date, max({num("eps_estimate")}) AS eps_estimate, max({num("reported_eps")}) AS reported_eps, max({num("eps_surprise_pct")}) AS eps_surprise_pct
  FROM earnings WHERE earnings_date IS NOT NULL GROUP BY ALL)"""
CALLS = """calls AS (
  SELECT upper(trim(ticker)) AS ticker, lower(trim(quarter)) AS quarter, year, pub_date FROM transcripts_text
  QUALIFY row_number() OVER (PARTITION BY upper(trim(ticker)), lower(trim(quarter)), year ORDER BY loaded_at DESC NULLS LAST, pub_date DESC NULLS LAST) = 1)"""
ENTRY = """ent AS (SELECT ticker, earnings_date, (SELECT min(cal_idx) FROM cal WHERE cal.date >= earnings_date) AS e FROM ev)"""


def at(n: int, name: str, key: str = "ent.ticker") -> str:
    return f"LEFT JOIN ix {name} ON {name}.ticker = {key} AND {name}.cal_idx = ent.e + ({n})"


RETURNS = f"""{PX}, {EV}, {ENTRY},
vx AS (SELECT date, max({num("vix_close")}) AS vix_close FROM vix GROUP BY 1),
ret AS (
  SELECT ent.ticker, earnings_date,
    {", ".join(f"s{n}.close / nullif(s0.close, 0) - 1 AS return_{n}d" for n in (1, 30, 90))},
    {", ".join(f"(s{n}.close / nullif(s0.close, 0) - 1) - (b{n}.close / nullif(b0.close, 0) - 1) AS abnormal_{n}d" for n in (1, 30, 90))},
    (SELECT arg_max(vix_close, date) FROM vx WHERE date <= earnings_date AND vix_close IS NOT NULL) AS vix_close,
    earnings_date BETWEEN DATE '2022-06-01' AND DATE '2022-12-31' AS is_covid
  FROM ent {" ".join(at(n, f"s{n}") for n in (0, 1, 30, 90))} {" ".join(at(n, f"b{n}", "'BMKIDX'") for n in (0, 1, 30, 90))})"""

LAGS = "".join(f", c{n} AS (PARTITION BY ticker ORDER BY cal_idx RANGE BETWEEN {n} PRECEDING AND {n} PRECEDING)" for n in (5, 21, 126, 252))


def frame(n: int, shift: int = 0) -> str:
    return f"(PARTITION BY ticker ORDER BY cal_idx RANGE BETWEEN {n - 1 + shift} PRECEDING AND {shift} PRECEDING)" if shift else f"(PARTITION BY ticker ORDER BY cal_idx RANGE BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(fn: str, c: str, n: int, least: int, name: str, shift: int = 0) -> str:
    return f"CASE WHEN count({c}) OVER {frame(n, shift)} >= {least} THEN {fn}({c}) OVER {frame(n, shift)} END AS {name}"


def lagged(n: int) -> str:
    return f"close / nullif(max(close) OVER (PARTITION BY ticker ORDER BY cal_idx RANGE BETWEEN {n} PRECEDING AND {n} PRECEDING), 0) - 1"


DAILY = f"""{PX},
dr AS (SELECT *, {lagged(1)} AS r FROM ix)"""
VA = ", ".join(f"CASE WHEN {v} > 1e-8 THEN {c} / {v} END AS {c}_va" for c, v in (("mom_12_1", "vol_60d"), ("mom_6_1", "vol_60d"), ("idio_mom", "vol_60d"), ("rev_5d", "vol_20d")))
MOMENTUM = f"""{DAILY},
bm0 AS (SELECT cal_idx, r AS m, ticker, (1 + ({lagged(252)})) / nullif(1 + ({lagged(21)}), 0) - 1 AS mom_m FROM dr WHERE ticker = 'BMKIDX'),
bm AS (SELECT cal_idx, m, mom_m, {roll("avg", "m", 252, 126, "m_avg")}, {roll("var_samp", "m", 252, 126, "m_var")} FROM bm0),
f0 AS (SELECT dr.*, r * m AS rm, mom_m, m_avg, m_var FROM dr LEFT JOIN bm USING (cal_idx)),
f1 AS (
  SELECT *, {lagged(5)} AS rev_5d, {lagged(21)} AS rev_21d, {lagged(126)} AS r126, {lagged(252)} AS r252, {roll("max", "close", 252, 200, "hi")},
    {roll("stddev_samp", "r", 60, 40, "vol_60d")}, {roll("stddev_samp", "r", 20, 15, "vol_20d")}, {roll("avg", "rm", 252, 126, "rm_avg")}, {roll("avg", "r", 252, 126, "r_avg")}
  FROM f0),
f2 AS (
  SELECT *, (1 + r252) / nullif(1 + rev_21d, 0) - 1 AS mom_12_1, (1 + r126) / nullif(1 + rev_21d, 0) - 1 AS mom_6_1, close / nullif(hi, 0) - 1 AS dist_52wk,
    (rm_avg - r_avg * m_avg) / nullif(m_var, 0) AS beta_252 FROM f1),
f3 AS (SELECT *, mom_12_1 - beta_252 * mom_m AS idio_mom FROM f2),
feat AS (SELECT *, {VA} FROM f3)"""
BASE = ["mom_12_1", "mom_6_1", "rev_5d", "rev_21d", "dist_52wk", "vol_60d", "vol_20d", "beta_252", "idio_mom"]
VAS = ["mom_12_1_va", "mom_6_1_va", "idio_mom_va", "rev_5d_va"]
LIQUID = f"""l0 AS (SELECT *, close * volume AS dv FROM %s),
l1 AS (SELECT *, {roll("avg", "dv", 21, 15, "a21")}, {roll("avg", "dv", 126, 60, "a126")} FROM l0),
liq AS (SELECT *, CASE WHEN a126 > 0 THEN a21 / a126 - 1 END AS turn_trend, CASE WHEN a21 > 0 THEN ln(a21) END AS log_adv FROM l1)"""


def pct(c: str, by: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY {c} NULLS LAST) + (count({c}) OVER (PARTITION BY {by}, {c}) - 1) / 2) / count({c}) OVER (PARTITION BY {by}) END"


SECTOR = "'S' || (ascii(ticker[1]) % 4)"
PANEL = f"""{MOMENTUM}, {LIQUID % "feat"},
ahead AS (SELECT *, max(close) OVER (PARTITION BY ticker ORDER BY cal_idx RANGE BETWEEN 21 FOLLOWING AND 21 FOLLOWING) / nullif(close, 0) - 1 AS raw_target FROM liq),
ends AS (SELECT max(cal_idx) AS cal_idx FROM cal GROUP BY date_trunc('month', date)),
reb AS (SELECT a.*, b.raw_target AS bt FROM ahead a LEFT JOIN (SELECT cal_idx, raw_target FROM ahead WHERE ticker = 'BMKIDX') b USING (cal_idx)
  WHERE cal_idx IN (SELECT cal_idx FROM ends WHERE cal_idx BETWEEN 260 AND (SELECT max(cal_idx) FROM cal) - 21)),
p0 AS (SELECT *, raw_target - beta_252 * bt AS target, {SECTOR} AS sector FROM reb WHERE ticker <> 'BMKIDX'),
p1 AS (SELECT * FROM p0 WHERE target IS NOT NULL AND mom_12_1 IS NOT NULL),
p2 AS (SELECT *, {", ".join(f"{pct(c, 'date, sector')} AS {c}_sn" for c in [*BASE, *VAS, "turn_trend", "log_adv"])} FROM p1)"""
SIGNS = {"mom_12_1": 1, "mom_6_1": 1, "idio_mom": 1, "dist_52wk": 1, "mom_12_1_va": 1, "mom_6_1_va": 1, "idio_mom_va": 1, "rev_5d": -1, "rev_21d": -1, "vol_60d": -1, "rev_5d_va": -1}
COMPOSITE = PANEL + ", comp AS (SELECT *, (" + " + ".join(f"({v}) * ({pct(c + s, 'date')})" for c, v in SIGNS.items() for s in ("", "_sn")) + ") / 22 AS composite FROM p2)"


def past(fn: str, c: str) -> str:
    return f"{fn}({c}) OVER (PARTITION BY ticker ORDER BY earnings_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def near(fallback: bool) -> str:
    pick = f"{iso('coalesce(m, t)', 'anchor_date')}, CASE WHEN m IS NULL THEN 'pub_date' ELSE 'earnings_date' END AS return_anchor" if fallback else f"{iso('t', 'pub_date')}, {iso('m', 'matched')}"
    return f"""WITH {CALLS}, {EV},
j AS (SELECT c.ticker, quarter, year, pub_date AS t, earnings_date AS m FROM calls c LEFT JOIN ev ON ev.ticker = c.ticker AND abs(date_diff('day', pub_date, earnings_date)) <= 30
  WHERE pub_date IS NOT NULL QUALIFY row_number() OVER (PARTITION BY c.ticker, quarter, year ORDER BY abs(date_diff('day', pub_date, earnings_date)), earnings_date) = 1)
SELECT ticker, quarter, year, {pick} FROM j"""


ORACLE = {
    "scan_prices": f"WITH {PX} SELECT ticker, {iso('date')}, close, volume FROM px",
    "calendar_index": f"WITH {PX} SELECT {iso('date')}, cal_idx FROM cal",
    "universe_union": "SELECT upper(trim(ticker)) AS ticker FROM prices WHERE date IS NOT NULL UNION SELECT upper(trim(ticker)) FROM earnings WHERE earnings_date IS NOT NULL UNION SELECT upper(trim(ticker)) FROM transcripts_text",
    "null_counts": f"WITH {PX} SELECT count(*) AS n, count(*) - count(close) AS close_nulls, count(*) - count(volume) AS volume_nulls FROM px",
    "event_returns": f"WITH {RETURNS} SELECT ticker, {iso('earnings_date')}, {', '.join(r6(f'{k}_{n}d') for k in ('return', 'abnormal') for n in (1, 30, 90))}, {r6('vix_close')}, is_covid FROM ret",
    "robust_event_summary": f"WITH {RETURNS} SELECT year(earnings_date)::INT AS year, count(return_30d) AS n, {r6('avg(return_30d)', 'mean_30d')}, {r6('stddev_samp(return_30d)', 'std_30d')} FROM ret WHERE NOT is_covid GROUP BY 1",
    "describe_returns": f"WITH {RETURNS} SELECT count(abnormal_30d) AS n, {r6('avg(abnormal_30d)', 'mean')}, {r6('stddev_samp(abnormal_30d)', 'std')}, {r6('min(abnormal_30d)', 'min')}, {', '.join(r6(f'quantile_cont(abnormal_30d, {q / 100})', f'q{q}') for q in (25, 50, 75))}, {r6('max(abnormal_30d)', 'max')} FROM ret",
    "trailing_returns": f"WITH {PX}, {EV}, {ENTRY} SELECT ent.ticker, {iso('earnings_date')}, {r6('s0.close / nullif(s5.close, 0) - 1', 'mom_5d')}, {r6('s0.close / nullif(s20.close, 0) - 1', 'mom_20d')} FROM ent {at(0, 's0')} {at(-5, 's5')} {at(-20, 's20')}",
    "asof_nearest_30d": f"""WITH {CALLS}, {EV},
j AS (SELECT c.ticker, quarter, year, pub_date, eps_surprise_pct FROM calls c LEFT JOIN ev ON ev.ticker = c.ticker AND eps_surprise_pct IS NOT NULL AND abs(date_diff('day', pub_date, earnings_date)) <= 30
  WHERE pub_date IS NOT NULL QUALIFY row_number() OVER (PARTITION BY c.ticker, quarter, year ORDER BY abs(date_diff('day', pub_date, earnings_date)), earnings_date) = 1)
SELECT ticker, quarter, year, {iso("pub_date")}, eps_surprise_pct FROM j""",
    "asof_legacy_nearest": near(False),
    "asof_legacy_unmatched": f"SELECT count(matched) AS matched, count(*) - count(matched) AS unmatched FROM ({near(False)})",
    "asof_unmatched_fallback": near(True),
    "asof_backward_10d": f"""WITH {DAILY}, {EV}, v AS (SELECT ticker, date, {roll("stddev_samp", "r", 60, 30, "vol", 1)} FROM dr),
j AS (SELECT ev.ticker, earnings_date, v.vol FROM ev LEFT JOIN v ON v.ticker = ev.ticker AND v.date <= earnings_date AND date_diff('day', v.date, earnings_date) <= 10 AND vol IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY ev.ticker, earnings_date ORDER BY v.date DESC) = 1)
SELECT ticker, {iso("earnings_date")}, {r6("vol")} FROM j""",
    "expanding_surprise_z": f"WITH {EV} SELECT ticker, {iso('earnings_date')}, round(CASE WHEN {past('count', 'eps_surprise_pct')} >= 3 AND {past('stddev_samp', 'eps_surprise_pct')} >= 1e-12 THEN (eps_surprise_pct - {past('avg', 'eps_surprise_pct')}) / {past('stddev_samp', 'eps_surprise_pct')} END + 1e-10, 6) + 0.0 AS eps_surprise_pct_z FROM ev",
    "qoq_delta": f"WITH {EV} SELECT ticker, {iso('earnings_date')}, {', '.join(r6(f'{c} - lag({c}) OVER (PARTITION BY ticker ORDER BY earnings_date)', f'{c}_qoq') for c in ('eps_surprise_pct', 'reported_eps'))} FROM ev",
    "past_target_stats": f"WITH {RETURNS} SELECT ticker, {iso('earnings_date')}, {', '.join(r6(f'CASE WHEN {past("count", "abnormal_30d")} >= 2 THEN {past(fn, "abnormal_30d")} END', f'abnormal_30d_past_{n}') for fn, n in (('avg', 'mean'), ('stddev_samp', 'std')))} FROM ret",
    "sue": f"""WITH {EV}, q AS (SELECT ticker, earnings_date, eps_surprise_pct / nullif(CASE WHEN {past("count", "eps_surprise_pct")} >= 2 THEN {past("stddev_samp", "eps_surprise_pct")} END, 0) AS q FROM ev)
SELECT ticker, {iso("earnings_date")}, round(CASE WHEN q IS NULL THEN 0 ELSE greatest(-10, least(10, q)) END + 1e-10, 6) + 0.0 AS sue FROM q""",
    "surprise_streak": f"""WITH {EV}, s AS (SELECT *, sign(coalesce(eps_surprise_pct, 0))::INT AS s FROM ev),
n AS (SELECT *, CASE WHEN s = 0 OR lag(s) OVER w IS DISTINCT FROM s THEN 1 ELSE 0 END AS new FROM s WINDOW w AS (PARTITION BY ticker ORDER BY earnings_date)),
i AS (SELECT *, sum(new) OVER (PARTITION BY ticker ORDER BY earnings_date) AS isle FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY ticker, isle ORDER BY earnings_date) * s AS run FROM i)
SELECT ticker, {iso("earnings_date")}, coalesce(lag(run) OVER (PARTITION BY ticker ORDER BY earnings_date), 0)::INT AS streak FROM r""",
    "momentum_features": f"WITH {MOMENTUM} SELECT ticker, {iso('date')}, {', '.join(r6(c) for c in [*BASE, *VAS])} FROM feat",
    "liquidity_feats": f"WITH {PX}, {LIQUID % 'ix'} SELECT ticker, {iso('date')}, {r6('turn_trend')}, {r6('log_adv')} FROM liq",
    "dma200": f"WITH {PX}, x AS (SELECT ticker, date, {roll('avg', 'close', 200, 200, 'dma')} FROM ix) SELECT ticker, {iso('date')}, {r6('dma')} FROM x",
    "momentum_panel": f"WITH {PANEL} SELECT ticker, {iso('date')}, sector, {', '.join(r6(c) for c in ('target', 'raw_target', 'mom_12_1_sn', 'rev_5d_sn', 'log_adv_sn', 'beta_252_sn', 'turn_trend'))} FROM p2",
    "composite_score": f"WITH {COMPOSITE} SELECT ticker, {iso('date')}, {r6('composite')} FROM comp",
    "correlation": f"WITH {RETURNS} SELECT {', '.join(r6(f'corr({a}, {b})', f'{a}_{b}') for a, b in (('return_1d', 'return_30d'), ('return_1d', 'return_90d'), ('return_30d', 'return_90d')))} FROM ret",
    "surprise_ranks": f"""WITH {EV}, m AS (SELECT *, date_trunc('month', earnings_date) AS m FROM ev)
SELECT ticker, {iso("earnings_date")}, {r6(pct("eps_surprise_pct", "m"), "pct")}, {r6("CASE WHEN eps_surprise_pct IS NOT NULL THEN rank() OVER (PARTITION BY m ORDER BY eps_surprise_pct NULLS LAST) + (count(eps_surprise_pct) OVER (PARTITION BY m, eps_surprise_pct) - 1) / 2 END", "avg_rank")} FROM m""",
}
