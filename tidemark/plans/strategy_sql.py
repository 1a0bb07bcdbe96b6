"""The strategy queries in plain SQL."""

from .market_sql import COMPOSITE, ENTRY, PX, iso, num, pct, r6, roll

PRED = f"""pred AS (
  SELECT *, date_trunc('month', date)::DATE AS month FROM (
    SELECT upper(trim(ticker)) AS ticker, lower(trim(quarter)) AS quarter, year, max(matched_earnings_date) AS date, max({num("full_lm_net", 9)}) AS score,
      max({num("qa_lm_net", 9)}) AS score2, max({num("full_vader_mean", 9)}) AS tone, max({num("abnormal_30d", 9)}) AS actual
    FROM sentiment_features GROUP BY ALL) WHERE date IS NOT NULL)"""
VX = f"vx AS (SELECT date, max({num('vix_close')}) AS vix_close FROM vix GROUP BY 1)"


BREADTH = f"""ux AS (SELECT ticker, date, close FROM px WHERE ticker <> 'BMKIDX' AND close IS NOT NULL),
uc AS (SELECT date, row_number() OVER (ORDER BY date) AS cal_idx FROM (SELECT DISTINCT date FROM ux)),
dm AS (SELECT ux.*, {roll("avg", "close", 200, 200, "dma")} FROM (SELECT ux.*, cal_idx FROM ux JOIN uc USING (date)) ux),
br AS (SELECT date, sum(coalesce((close > dma)::INT, 0)) / nullif(count(close), 0) AS share FROM dm GROUP BY 1)"""


SIGNAL = "CASE WHEN share IS NULL THEN 0.0 WHEN share < 0.3 THEN -1.0 WHEN share < 0.5 THEN 0.0 ELSE 1.0 END::DOUBLE"


def regime(change: str = "NULL::DOUBLE", extra: str = "") -> str:
    return f"""{VX}, {BREADTH},{extra}
bench AS (SELECT date, close, CASE WHEN count(close) OVER w >= 200 THEN avg(close) OVER w END AS dma FROM px WHERE ticker = 'BMKIDX' AND close IS NOT NULL WINDOW w AS (ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)),
s0 AS (SELECT b.date, vx.vix_close, close / nullif(dma, 0) - 1 AS gap, share, {change} AS change FROM bench b LEFT JOIN vx ON vx.date = b.date LEFT JOIN br ON br.date = b.date{" LEFT JOIN cr ON cr.date = b.date" if extra else ""}),
sig AS (SELECT *, (CASE WHEN vix_close > 35 THEN -1 WHEN vix_close > 25 THEN -0.5 ELSE 0 END)::DOUBLE AS vix, (CASE WHEN gap < -0.1 THEN -1 WHEN gap < 0 THEN 0 ELSE 1 END)::DOUBLE AS spy, {SIGNAL} AS breadth,
  (CASE WHEN change < -0.05 THEN -1 WHEN change < -0.02 THEN -0.5 ELSE 0 END)::DOUBLE AS credit FROM s0),
reg AS (SELECT *, vix + spy + breadth + credit AS composite, (CASE WHEN least(vix, spy, breadth, credit) <= -1 THEN 0.25 WHEN vix < 0 OR spy <= 0 OR breadth <= 0 OR credit < 0 THEN 0.6 ELSE 1.0 END)::DOUBLE AS multiplier FROM sig)"""


CREDIT = """
pair AS (SELECT min(ticker) AS a, max(ticker) AS b FROM px WHERE ticker <> 'BMKIDX'),
rt AS (SELECT x.date, x.close / nullif(y.close, 0) AS ratio FROM px x JOIN px y ON x.date = y.date WHERE x.ticker = (SELECT a FROM pair) AND y.ticker = (SELECT b FROM pair)),
rp AS (SELECT date, last_value(ratio IGNORE NULLS) OVER (ORDER BY date) AS ratio FROM rt),
cr AS (SELECT date, ratio / nullif(lag(ratio, 20) OVER (ORDER BY date), 0) - 1 AS change FROM rp),"""
PCT = ", ".join(r6(f"avg((multiplier = {m})::INT) * 100", f"{n}_pct") for m, n in ((1.0, "risk_on"), (0.6, "caution"), (0.25, "risk_off")))


def z(c: str, by: str) -> str:
    return f"CASE WHEN stddev_samp({c}) OVER (PARTITION BY {by}) > 0 THEN ({c} - avg({c}) OVER (PARTITION BY {by})) / stddev_pop({c}) OVER (PARTITION BY {by}) ELSE 0 END"


DECAY = f"""{PRED},
es AS (SELECT ticker, date AS event_date, max(score) AS score FROM pred GROUP BY ALL),
ez AS (SELECT ticker, event_date, {z("score", "event_date")} AS z, (SELECT min(cal_idx) FROM cal WHERE cal.date >= event_date) AS e FROM es WHERE score IS NOT NULL),
dec AS (SELECT c.date, ticker, max(z * (1 - i / 30)) AS eca_z FROM ez JOIN range(30) t(i) ON true JOIN cal c ON c.cal_idx = e + i WHERE c.date <= event_date + 60 GROUP BY ALL)"""
DAILY = f"""mz AS (SELECT date, ticker, {z("composite", "date")} AS z FROM comp),
pr AS (SELECT ticker, date FROM px WHERE close IS NOT NULL),
ends2 AS (SELECT ticker, max(date) AS last FROM pr GROUP BY 1),
grid AS (SELECT c.date, ticker, last FROM (SELECT DISTINCT date FROM pr) c, ends2 WHERE c.date >= (SELECT min(date) FROM comp)),
md AS (SELECT g.date, g.ticker, CASE WHEN g.date <= last THEN last_value(z IGNORE NULLS) OVER (PARTITION BY g.ticker ORDER BY g.date) END AS momentum_z FROM grid g LEFT JOIN mz ON mz.date = g.date AND mz.ticker = g.ticker)"""
BOOK = COMPOSITE + ", book AS (SELECT date, ticker, sector, composite AS score, vol_60d AS vol, coalesce(composite IS NOT NULL AND vol_60d > 0, false) AS ok0 FROM comp)"


def _sizing(BOOK: str) -> str:
    steps = ["z0 AS (SELECT *, ok0 AND sum(ok0::INT) OVER (PARTITION BY date) >= 4 AS ok, sum(ok0::INT) OVER (PARTITION BY date) AS n FROM book)"]
    steps.append("z1 AS (SELECT *, CASE WHEN ok THEN score / vol END AS w0 FROM z0)")
    steps.append("z2 AS (SELECT * EXCLUDE (w0), w0 - avg(w0) OVER (PARTITION BY date) AS w FROM z1)")
    scale = "CASE WHEN sum(abs(w)) OVER (PARTITION BY date) > 0 THEN w * 2.0 / sum(abs(w)) OVER (PARTITION BY date) ELSE w * 0 END"
    clip = "CASE WHEN w IS NOT NULL THEN greatest(-0.03, least(0.03, w)) END"
    exprs = [scale, clip, scale, clip, scale, clip, scale, clip]
    exprs.append("CASE WHEN sector IS NOT NULL AND abs(sum(w) OVER (PARTITION BY date, sector)) > 0.25 THEN w - (sum(w) OVER (PARTITION BY date, sector) - sign(sum(w) OVER (PARTITION BY date, sector)) * 0.25) / sum(ok::INT) OVER (PARTITION BY date, sector) ELSE w END")
    exprs.append("CASE WHEN abs(sum(w) OVER (PARTITION BY date)) > 0.2 THEN w - (sum(w) OVER (PARTITION BY date) - sign(sum(w) OVER (PARTITION BY date)) * 0.2) / n ELSE w END")
    for i, e in enumerate(exprs):
        steps.append(f"z{i + 3} AS (SELECT * REPLACE ({e} AS w) FROM z{i + 2})")
    steps.append(f"sized AS (SELECT date, ticker, coalesce(w, 0) AS weight FROM z{len(exprs) + 2})")
    return BOOK + ", " + ", ".join(steps)


SIZED = _sizing(BOOK)
OWN_VOL = COMPOSITE + f""", sv AS (SELECT ticker, date, {roll("stddev_samp", "r", 60, 30, "vol", 1)} FROM dr),
book AS (SELECT c.date, c.ticker, sector, composite AS score, vol, coalesce(composite IS NOT NULL AND vol > 0, false) AS ok0 FROM comp c LEFT JOIN sv USING (ticker, date))"""


def deciles(score: str) -> str:
    return f"""WITH {BOOK}, d0 AS (SELECT *, CASE WHEN ok0 THEN score END AS s0 FROM book), d00 AS (SELECT *, {score} AS s FROM d0), d1 AS (SELECT *, {pct("s", "date")} AS p, count(s) OVER (PARTITION BY date) AS n FROM d00),
d2 AS (SELECT *, CASE WHEN n < 10 THEN 0 WHEN p >= 1 - 0.1 THEN 1 WHEN p <= 0.1 THEN -1 ELSE 0 END AS side FROM d1), d3 AS (SELECT *, CASE WHEN side <> 0 THEN 1 / vol END AS inv FROM d2),
d4 AS (SELECT *, side * inv / sum(inv) OVER (PARTITION BY date, side) AS w FROM d3)
SELECT {iso("date")}, ticker, round(CASE WHEN w IS NULL THEN 0 ELSE greatest(-0.03, least(0.03, w)) END + 1e-10, 6) + 0.0 AS weight FROM d4"""




def trades(by: str = "date", cutoff: str = "0.2", src: str = "pred") -> str:
    return f"""t0 AS (SELECT *, {pct("score", by)} AS p, count(*) OVER (PARTITION BY {by}) AS n_names FROM {src} WHERE actual IS NOT NULL),
t1 AS (SELECT *, coalesce(n_names >= 5 AND p >= 1 - {cutoff}, false) AS lg, coalesce(n_names >= 5 AND p <= {cutoff}, false) AS sh FROM t0),
t2 AS (SELECT *, CASE WHEN lg THEN 1 / sum(lg::INT) OVER (PARTITION BY {by}) ELSE 0 END - CASE WHEN sh THEN 1 / sum(sh::INT) OVER (PARTITION BY {by}) ELSE 0 END AS weight FROM t1),
tr AS (SELECT *, CASE WHEN lg THEN 1 WHEN sh THEN -1 ELSE 0 END AS side, weight * actual AS gross, actual / n_names AS ew,
  weight * actual - (abs(weight) * 0.001 + CASE WHEN weight < 0 THEN abs(weight) * 0.005 * 30 / 252 ELSE 0 END) AS net FROM t2)"""


def pnl_of(by: str) -> str:
    return f"SELECT {by}, count(*) AS n, sum(gross) AS gross, sum(net) AS net, sum(ew) AS ew, sum(lg::INT)::BIGINT AS n_long, sum(sh::INT)::BIGINT AS n_short, avg(actual) FILTER (lg) AS long_only, avg(actual) FILTER (sh) AS short_raw FROM tr GROUP BY ALL"


PNL = f"""{PX}, {PRED}, {trades()}, p0 AS ({pnl_of("date")}),
p1 AS (SELECT p0.*, (SELECT min(cal_idx) FROM cal WHERE cal.date >= p0.date) AS e FROM p0),
pnl AS (SELECT p1.*, coalesce(b.close / nullif(a.close, 0) - 1, 0) AS spy FROM p1 LEFT JOIN ix a ON a.ticker = 'BMKIDX' AND a.cal_idx = e LEFT JOIN ix b ON b.ticker = 'BMKIDX' AND b.cal_idx = e + 30)"""
SERIES = " UNION ALL ".join(f"SELECT date, '{c}' AS series, {c} AS r FROM pnl" for c in ("gross", "net", "ew", "spy", "long_only"))


def metrics(src: str, by: str, r: str) -> str:
    few = ", ".join(f"CASE WHEN n < 2 THEN 0 ELSE {c} END AS {c}" for c in ("max_drawdown", "win_rate", "avg"))
    return f"""q0 AS (SELECT *, product(1 + {r}) OVER (PARTITION BY {by} ORDER BY date) AS equity FROM {src} WHERE {r} IS NOT NULL),
qq AS (SELECT DISTINCT {by} FROM {src}),
q1 AS (SELECT *, max(equity) OVER (PARTITION BY {by} ORDER BY date) AS peak FROM q0),
q2 AS (SELECT {by}, count(*) AS n, product(1 + {r}) AS fin, avg({r}) AS avg, stddev_samp({r}) AS sd, min((equity - peak) / nullif(peak, 0)) AS max_drawdown, avg(({r} > 0)::INT) AS win_rate, greatest(date_diff('day', min(date), max(date)) / 365.25, 1 / 12) AS years FROM q1 GROUP BY {by}),
q3 AS (SELECT qq.{by}, coalesce(n, 0) AS n, fin, avg, sd, max_drawdown, win_rate, years FROM qq LEFT JOIN q2 USING ({by})),
met AS (SELECT {by}, n, CASE WHEN n < 2 THEN 0 ELSE fin - 1 END AS total, CASE WHEN n < 2 THEN 0 WHEN fin > 0 THEN pow(fin, 1 / years) - 1 END AS cagr, CASE WHEN n < 2 OR sd = 0 THEN 0 ELSE avg / sd * sqrt(252 / 30) END AS sharpe, {few} FROM q3)"""


def blended(gate: str = "", tail: str = "", what: str | None = None) -> str:
    what = what or f"{iso('date')}, ticker, {r6('momentum_z')}, {r6('eca_z')}, regime, {r6('ensemble_z')}"
    return f"""WITH {COMPOSITE}, {DAILY}, {DECAY}, {regime()},
bl AS (SELECT coalesce(md.date, dec.date) AS date, coalesce(md.ticker, dec.ticker) AS ticker, coalesce(momentum_z, 0) AS momentum_z, coalesce(eca_z, 0) AS eca_z FROM md FULL JOIN dec ON md.date = dec.date AND md.ticker = dec.ticker),
b2 AS (SELECT bl.*, coalesce(multiplier, 1.0) AS regime, (0.5 * momentum_z + 0.5 * eca_z){gate} AS raw FROM bl LEFT JOIN reg ON reg.date = bl.date),
b3 AS (SELECT *, {z("raw", "date")} AS ensemble_z FROM b2) SELECT {what} FROM b3{tail}"""


def ic(score: str, name: str) -> str:
    rank = lambda c: f"rank() OVER (PARTITION BY month ORDER BY {c}) + (count(*) OVER (PARTITION BY month, {c}) - 1) / 2"
    return f"""{name}0 AS (SELECT month, {rank(score)} AS s, {rank("actual")} AS a FROM pred WHERE {score} IS NOT NULL AND actual IS NOT NULL),
{name} AS (SELECT month, count(*) AS n, CASE WHEN stddev_pop(s) > 0 AND stddev_pop(a) > 0 THEN corr(s, a) END AS ic FROM {name}0 GROUP BY 1 HAVING count(*) >= 5)"""


SUMMARY = "summ AS (SELECT count(*) AS periods, avg(ic) AS mean_ic, stddev_samp(ic) AS std_ic, avg((ic > 0)::INT) AS share_positive, avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(*)) AS t FROM {} WHERE ic IS NOT NULL)"
OK = "score IS NOT NULL AND actual IS NOT NULL"
EDGES = " + ".join(f"(1 + (n - 1) * ({k} / 10::DOUBLE) < rn)::INT" for k in range(11))
MI = ", ".join(f"quantile_disc({c}, [{', '.join(f'{k}/8::DOUBLE' for k in range(1, 8))}]) AS q_{c}" for c in ("score", "score2", "tone", "actual"))

ORACLE = {
    "signal_breadth": f"WITH {PX}, {BREADTH} SELECT {iso('date')}, {r6('share')}, {SIGNAL} AS signal FROM br",
    "regime_gate": f"WITH {PX}, {regime()} SELECT {iso('date')}, {r6('vix_close')}, vix, spy, breadth, credit, composite, multiplier FROM reg",
    "regime_credit": f"WITH {PX}, {regime('cr.change', CREDIT)} SELECT {iso('date')}, vix, spy, breadth, credit, composite, multiplier FROM reg",
    "regime_summary": f"WITH {PX}, {regime()} SELECT count(*) AS days, {iso('min(date)', 'first')}, {iso('max(date)', 'last')}, {PCT} FROM reg",
    "regime_stress": f"""WITH {PX}, {regime()}, w(label, a, b) AS (VALUES ('2022 bear market', DATE '2022-01-01', DATE '2022-10-15'), ('2023 first half', DATE '2023-01-01', DATE '2023-06-30'), ('2024 summer', DATE '2024-07-15', DATE '2024-08-31'), ('2018 last quarter', DATE '2018-10-01', DATE '2018-12-31'))
SELECT label, count(*) AS days, {r6("avg(multiplier)", "mean_multiplier")}, {r6("avg(vix_close)", "mean_vix")}, {PCT} FROM reg JOIN w ON date BETWEEN a AND b GROUP BY 1""",
    "regime_forward": f"""WITH {PX}, {regime()}, fw AS (SELECT date, {", ".join(f"lead(close, {n}) OVER (ORDER BY date) / nullif(close, 0) - 1 AS f{n}" for n in (21, 63))} FROM px WHERE ticker = 'BMKIDX')
SELECT multiplier, count(*) AS days, {r6("avg(f21)", "fwd_21")}, {r6("avg(f63)", "fwd_63")} FROM reg JOIN fw USING (date) WHERE f21 IS NOT NULL AND f63 IS NOT NULL GROUP BY 1""",
    "event_decay": f"WITH {PX}, {DECAY} SELECT {iso('date')}, ticker, {r6('eca_z')} FROM dec",
    "momentum_daily": f"WITH {COMPOSITE}, {DAILY} SELECT {iso('date')}, ticker, {r6('momentum_z')} FROM md",
    "ensemble_scores": blended(),
    "ensemble_gated": blended(gate=" * coalesce(multiplier, 1.0)"),
    "ensemble_as_of": blended(tail=" WHERE date = DATE '2024-06-03'"),
    "ensemble_summary": blended(what=f"count(DISTINCT date) AS n_dates, count(DISTINCT ticker) AS n_tickers, {r6('avg((abs(momentum_z) > 1e-8)::INT) * 100', 'pct_momentum_active')}, {r6('avg((abs(eca_z) > 1e-8)::INT) * 100', 'pct_eca_active')}, {r6('avg(regime)', 'avg_regime')}, {iso('min(date)', 'first')}, {iso('max(date)', 'last')}"),
    "size_one_date": f"WITH {SIZED} SELECT {iso('date')}, ticker, {r6('weight')} FROM sized",
    "size_book": f"WITH {_sizing(OWN_VOL)} SELECT {iso('date')}, ticker, {r6('weight')} FROM sized",
    "size_deciles": deciles("s0"),
    "size_deciles_neutral": deciles("s0 - avg(s0) OVER (PARTITION BY date, coalesce(sector, 'Other'))"),
    "book_stats": f"WITH {SIZED} SELECT {iso('date')}, sum((weight <> 0)::INT)::BIGINT AS n, {r6('sum(abs(weight))', 'gross')}, {r6('sum(weight)', 'net')}, {r6('max(abs(weight))', 'max_abs')}, {r6('sum(abs(weight)) * sum(abs(weight)) / nullif(sum(weight * weight), 0)', 'effective_n')} FROM sized GROUP BY date",
    "backtest_trades": f"WITH {PNL} SELECT ticker, quarter, year, {iso('date')}, n_names, side, {r6('weight')}, {r6('gross')}, {r6('net')}, {r6('ew')} FROM tr",
    "trades_by_month": f"WITH {PRED}, {trades('month')} SELECT ticker, quarter, year, {iso('month')}, n_names, side, {r6('weight')}, {r6('gross')}, {r6('net')}, {r6('ew')} FROM tr",
    "event_pnl": f"WITH {PNL} SELECT {iso('date')}, n, n_long, n_short, {', '.join(r6(c) for c in ('gross', 'net', 'ew', 'spy', 'long_only', 'short_raw'))} FROM pnl",
    "portfolio_metrics": f"WITH {PNL}, five AS ({SERIES}), {metrics('five', 'series', 'r')} SELECT series, n, {', '.join(r6(c) for c in ('total', 'cagr', 'sharpe', 'max_drawdown', 'win_rate', 'avg'))} FROM met",
    "drawdown": f"WITH {PNL}, e AS (SELECT date, product(1 + net) OVER (ORDER BY date) AS equity FROM pnl), k AS (SELECT *, max(equity) OVER (ORDER BY date) AS peak FROM e) SELECT {iso('date')}, {r6('equity')}, {r6('(equity - peak) / nullif(peak, 0)', 'drawdown')} FROM k",
    "rolling_sharpe": f"""WITH {PNL}, o AS (SELECT date, net, row_number() OVER (ORDER BY date) AS i, least(20, count(*) OVER () // 4) AS k FROM pnl),
v AS (SELECT a.date, a.i, any_value(a.k) AS k, avg(b.net) AS m, stddev_samp(b.net) AS sd FROM o a JOIN o b ON b.i BETWEEN a.i - a.k + 1 AND a.i GROUP BY 1, 2)
SELECT {iso("o.date", "date")}, round(CASE WHEN o.k >= 4 AND o.i >= o.k THEN CASE WHEN sd > 0 THEN m / sd * sqrt(252 / 30) ELSE 0 END END + 1e-10, 6) + 0.0 AS rolling_sharpe FROM o LEFT JOIN v USING (i)""",
    "cutoff_sensitivity": f"""WITH {PRED}, pc AS (SELECT pred.*, cutoff FROM pred JOIN (SELECT unnest([0.10, 0.15, 0.20, 0.25, 0.30, 0.40, 0.50])::DOUBLE AS cutoff) ON true), {trades("date, cutoff", "cutoff", "pc")},
mc AS ({pnl_of("cutoff, date")}), {metrics("mc", "cutoff", "net")}, ap AS (SELECT cutoff, sum(n_long + n_short) / count(*) AS avg_positions FROM mc GROUP BY 1)
SELECT cutoff, n, {r6("total")}, {r6("sharpe")}, {r6("win_rate")}, {r6("avg_positions")} FROM met JOIN ap USING (cutoff)""",
    "leg_decomposition": f"WITH {PNL} SELECT 'long_only' AS leg, count(long_only) AS dates, {r6('avg(long_only)', 'mean_return')}, {r6('avg((long_only > 0)::INT)', 'hit_rate')} FROM pnl UNION ALL SELECT 'short_raw', count(short_raw), {r6('avg(short_raw)')}, {r6('avg((-short_raw > 0)::INT)')} FROM pnl".replace(" AS avg(short_raw)", "").replace(" AS avg((-short_raw > 0)::INT)", ""),
    "monthly_long_short": f"""WITH {COMPOSITE}, m AS (SELECT *, {pct("composite", "date")} AS p FROM comp WHERE composite IS NOT NULL),
g AS (SELECT date, avg(target) FILTER (p >= 0.9) - avg(target) FILTER (p <= 0.1) AS gross, avg(raw_target) FILTER (p >= 0.9) - avg(raw_target) FILTER (p <= 0.1) AS raw_gross FROM m GROUP BY 1)
SELECT {iso("date")}, {r6("gross")}, {r6("gross - (0.002 + 0.005 * 21 / 252)", "net")}, {r6("raw_gross")}, {r6("raw_gross - (0.002 + 0.005 * 21 / 252)", "raw_net")} FROM g""",
    "monthly_ic": f"WITH {PRED}, {ic('score', 'i')} SELECT {iso('month')}, n, {r6('ic')} FROM i",
    "ic_summary": f"WITH {PRED}, {ic('score', 'i')}, {SUMMARY.format('i')} SELECT periods, {', '.join(r6(c) for c in ('mean_ic', 'std_ic', 'share_positive', 't'))} FROM summ",
    "ic_paired_t": f"WITH {PRED}, {ic('score', 'i')}, {ic('score2', 'k')}, d AS (SELECT month, i.ic - k.ic AS ic FROM i JOIN k USING (month)), {SUMMARY.format('d')} SELECT periods, {r6('mean_ic', 'mean_diff')}, {r6('t')} FROM summ",
    "decile_spread_qcut": f"WITH {PRED}, r AS (SELECT *, row_number() OVER (ORDER BY score, ticker, quarter, year) AS rn, count(*) OVER () AS n FROM pred WHERE {OK}) SELECT greatest(0, {EDGES} - 1)::INT AS decile, count(*) AS n, {r6('avg(actual)', 'mean_actual')} FROM r GROUP BY 1",
    "decile_spread_bps": f"WITH {PRED}, r AS (SELECT *, row_number() OVER (ORDER BY score, ticker, quarter, year) AS rn, count(*) OVER () AS n FROM pred WHERE {OK}), m AS (SELECT greatest(0, {EDGES} - 1)::INT AS decile, avg(actual) AS a FROM r GROUP BY 1) SELECT {r6('((SELECT a FROM m WHERE decile = 9) - (SELECT a FROM m WHERE decile = 0)) * 1e4', 'spread_bps')}",
    "decile_spread_pct": f"WITH {PRED}, r AS (SELECT *, {pct('score', 'month')} AS p FROM pred WHERE {OK}) SELECT least(floor(p * 10), 9)::INT AS decile, count(*) AS n, {r6('avg(actual)', 'mean_actual')} FROM r GROUP BY 1",
    "regression_quality": f"WITH {PRED}, x AS (SELECT *, avg(actual) OVER () AS m FROM pred WHERE {OK}) SELECT count(*) AS n, {r6('sqrt(avg(pow(actual - score, 2)))', 'rmse')}, {r6('1 - sum(pow(actual - score, 2)) / nullif(sum(pow(actual - m, 2)), 0)', 'r2')}, {r6('avg((sign(actual) = sign(score))::INT)', 'sign_accuracy')}, {r6('sqrt(avg(pow(actual - m, 2)))', 'naive_rmse')} FROM x",
    "confusion": f"""WITH {PRED}, c AS (SELECT count(*) FILTER (score > 0 AND actual > 0) AS tp, count(*) FILTER (score > 0 AND actual <= 0) AS fp, count(*) FILTER (score <= 0 AND actual > 0) AS fn, count(*) FILTER (score <= 0 AND actual <= 0) AS tn FROM pred WHERE {OK})
SELECT *, {r6("(tp + tn) / nullif(tp + fp + fn + tn, 0)", "accuracy")}, {r6("2 * tp / nullif(2 * tp + fp + fn, 0)", "f1")} FROM c""",
    "roc_auc": f"""WITH {PRED}, r AS (SELECT (actual > 0) AS pos, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rk FROM pred WHERE {OK}),
s AS (SELECT sum(rk) FILTER (pos) AS rs, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS q FROM r) SELECT {r6("(rs - p * (p + 1) / 2) / nullif(p * q, 0)", "auc")} FROM s""",
    "winsor_bounds": f"WITH {PRED} SELECT {r6('quantile_cont(actual, 0.01)', 'low')}, {r6('quantile_cont(actual, 0.99)', 'high')} FROM pred",
    "mi_ranking": f"""WITH {PRED}, q AS (SELECT {MI} FROM pred),
l AS (SELECT feature, len(list_filter(c, lambda e: e < x)) AS b, len(list_filter(q_actual, lambda e: e < actual)) AS t FROM (
  SELECT 'score' AS feature, score AS x, q_score AS c, actual, q_actual FROM pred, q UNION ALL SELECT 'score2', score2, q_score2, actual, q_actual FROM pred, q UNION ALL SELECT 'tone', tone, q_tone, actual, q_actual FROM pred, q)
  WHERE x IS NOT NULL AND actual IS NOT NULL),
k AS (SELECT feature, b, t, count(*) AS c FROM l GROUP BY ALL),
i AS (SELECT feature, c / sum(c) OVER (PARTITION BY feature) * ln(c * sum(c) OVER (PARTITION BY feature) / (sum(c) OVER (PARTITION BY feature, b) * sum(c) OVER (PARTITION BY feature, t))) AS i FROM k)
SELECT feature, {r6("sum(i)", "mi")} FROM i GROUP BY 1""",
    "verdict": f"""WITH {PRED}, {ic('score', 'i')}, {SUMMARY.format('i')}, r AS (SELECT *, row_number() OVER (ORDER BY score, ticker, quarter, year) AS rn, count(*) OVER () AS n FROM pred WHERE {OK}), m AS (SELECT greatest(0, {EDGES} - 1)::INT AS decile, avg(actual) AS a FROM r GROUP BY 1),
e AS (SELECT sqrt(avg(pow(actual - score, 2))) AS rmse, avg((sign(actual) = sign(score))::INT) AS sign_accuracy FROM pred WHERE {OK}),
k AS (SELECT (actual > 0) AS pos, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rk FROM pred WHERE {OK}), a AS (SELECT (sum(rk) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2) / nullif(count(*) FILTER (pos) * count(*) FILTER (NOT pos), 0) AS auc FROM k)
SELECT {r6('rmse')}, {r6('sign_accuracy')}, {r6('mean_ic')}, {r6('t')}, {r6('((SELECT a FROM m WHERE decile = 9) - (SELECT a FROM m WHERE decile = 0)) * 1e4', 'spread_bps')}, {r6('auc')}, CASE WHEN abs(t) >= 2 AND mean_ic > 0 THEN 'usable' WHEN mean_ic > 0 THEN 'weak' ELSE 'none' END AS verdict FROM summ, e, a""",
}
