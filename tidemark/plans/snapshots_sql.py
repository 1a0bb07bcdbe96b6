"""The same results in plain SQL, for comparison."""

EST = """est AS (
  SELECT snap_date, upper(trim(ticker)) AS ticker, lower(trim(period)) AS period,
         round(CASE WHEN NOT isnan(eps_current) THEN eps_current END, 4) + 0.0 AS eps_current,
         round(CASE WHEN NOT isnan(est_eps_avg) THEN est_eps_avg END, 4) + 0.0 AS est_eps_avg
  FROM estimate_snapshot
  QUALIFY row_number() OVER (PARTITION BY snap_date, upper(trim(ticker)), lower(trim(period)) ORDER BY loaded_at DESC) = 1)"""

VERSIONS = f"""WITH {EST},
seen AS (SELECT DISTINCT snap_date, upper(trim(ticker)) AS ticker FROM analyst_snapshot),
keys AS (SELECT DISTINCT ticker, period FROM est),
cells AS (
  SELECT coalesce(s.snap_date, e.snap_date) AS d, coalesce(s.ticker, e.ticker) AS ticker, coalesce(s.period, e.period) AS period,
         e.ticker IS NOT NULL AS present, e.eps_current, e.est_eps_avg
  FROM (SELECT * FROM seen JOIN keys USING (ticker)) s FULL JOIN est e ON s.ticker = e.ticker AND s.period = e.period AND s.snap_date = e.snap_date),
marked AS (
  SELECT *, lag(present) OVER w AS p0, lag(eps_current) OVER w AS e0, lag(est_eps_avg) OVER w AS a0, row_number() OVER w AS n
  FROM cells WINDOW w AS (PARTITION BY ticker, period ORDER BY d)),
starts AS (
  SELECT * FROM marked
  WHERE n = 1 OR p0 <> present OR e0 IS DISTINCT FROM eps_current OR a0 IS DISTINCT FROM est_eps_avg),
ended AS (
  SELECT *, coalesce(lead(d) OVER (PARTITION BY ticker, period ORDER BY d), DATE '9999-12-31') AS until FROM starts)
"""

CHANGES = f"""WITH {EST},
days AS (SELECT snap_date AS d, lag(snap_date) OVER (ORDER BY snap_date) AS prev FROM (SELECT DISTINCT snap_date FROM analyst_snapshot)),
cur AS (SELECT d, ticker, period, eps_current AS c FROM days JOIN est ON snap_date = d WHERE prev IS NOT NULL),
pre AS (SELECT d, ticker, period, eps_current AS p FROM days JOIN est ON snap_date = prev),
diff AS (
  SELECT strftime(coalesce(cur.d, pre.d), '%Y-%m-%d') AS snap_date, coalesce(cur.ticker, pre.ticker) AS ticker, coalesce(cur.period, pre.period) AS period,
         CASE WHEN pre.d IS NULL THEN 'added' WHEN cur.d IS NULL THEN 'removed' WHEN c IS DISTINCT FROM p THEN 'changed' END AS change
  FROM cur FULL JOIN pre ON cur.d = pre.d AND cur.ticker = pre.ticker AND cur.period = pre.period)
"""

ORACLE = {
    "p4_found": VERSIONS + "SELECT ticker, period, strftime(d, '%Y-%m-%d') AS valid_from, strftime(until, '%Y-%m-%d') AS valid_to FROM ended WHERE present",
    "p4_versions": VERSIONS + "SELECT ticker, period, strftime(d, '%Y-%m-%d') AS valid_from, strftime(until, '%Y-%m-%d') AS valid_to, eps_current, est_eps_avg FROM ended WHERE present",
    "p6_found": CHANGES + "SELECT * FROM diff WHERE change IS NOT NULL",
    "p6_summary": CHANGES + "SELECT snap_date, change, count(*) AS n FROM diff WHERE change IS NOT NULL GROUP BY ALL",
}
KNOWN = """WITH ev AS (SELECT DISTINCT upper(trim(ticker)) AS ticker, earnings_date AS d FROM earnings WHERE earnings_date IS NOT NULL),
es AS (SELECT ev.ticker, d, max(snap_date) AS snap_date FROM ev JOIN estimate_snapshot e ON upper(trim(e.ticker)) = ev.ticker
       WHERE lower(trim(period)) = '0q' AND eps_current IS NOT NULL AND NOT isnan(eps_current) AND snap_date < d AND loaded_at < d GROUP BY ALL),
px AS (SELECT ev.ticker, d, max(date) AS price_date FROM ev JOIN prices p ON upper(trim(p.ticker)) = ev.ticker
       WHERE close IS NOT NULL AND NOT isnan(close) AND date < d AND loaded_at < d GROUP BY ALL),
vx AS (SELECT d, max(date) AS vix_date FROM (SELECT DISTINCT d FROM ev) JOIN vix ON date < d WHERE vix_close IS NOT NULL AND NOT isnan(vix_close) GROUP BY ALL),
known AS (SELECT ev.ticker, ev.d, snap_date, price_date, vix_date FROM ev LEFT JOIN es USING (ticker, d) LEFT JOIN px USING (ticker, d) LEFT JOIN vx USING (d))
"""
ORACLE["p7_found"] = KNOWN + "SELECT ticker, strftime(d, '%Y-%m-%d') AS earnings_date, " + ", ".join(f"coalesce(strftime({c}, '%Y-%m-%d'), '') AS {c}" for c in ("snap_date", "price_date", "vix_date")) + " FROM known"
ORACLE["p7_features"] = (
    KNOWN
    + """SELECT ticker, strftime(d, '%Y-%m-%d') AS earnings_date,
  (SELECT arg_max(round(eps_current, 4) + 0.0, (loaded_at, round(eps_current, 4) + 0.0)) FROM estimate_snapshot e WHERE upper(trim(e.ticker)) = known.ticker AND lower(trim(period)) = '0q' AND e.snap_date = known.snap_date AND loaded_at < d AND NOT isnan(eps_current)) AS eps_known,
  (SELECT arg_max(round(close, 4), (loaded_at, round(close, 4))) FROM prices p WHERE upper(trim(p.ticker)) = known.ticker AND p.date = known.price_date AND loaded_at < d AND NOT isnan(close)) AS close_known,
  (SELECT max(round(vix_close, 4)) FROM vix WHERE date = known.vix_date AND NOT isnan(vix_close)) AS vix_close
FROM known"""
)

# The ledger by its definition: every assertion, until the next of its cell; the end of a day's interval is the nearest
# later day first recorded by then.
CELLS = """WITH e AS (SELECT upper(trim(ticker)) AS ticker, lower(trim(period)) AS period, snap_date AS d, loaded_at AS r, true AS present,
  round(CASE WHEN NOT isnan(eps_current) THEN eps_current END, 4) + 0.0 AS a, round(CASE WHEN NOT isnan(est_eps_avg) THEN est_eps_avg END, 4) + 0.0 AS b FROM estimate_snapshot),
s AS (SELECT upper(trim(ticker)) AS ticker, snap_date AS d, date_trunc('day', min(loaded_at)) + INTERVAL 1 DAY AS r FROM analyst_snapshot GROUP BY 1, 2),
al AS (SELECT * FROM e UNION ALL SELECT ticker, period, d, r, false, NULL, NULL FROM s JOIN (SELECT DISTINCT ticker, period FROM e) USING (ticker)),
o AS (SELECT * REPLACE (coalesce(r, TIMESTAMP '1970-01-01') AS r) FROM al WHERE ticker IS NOT NULL AND period IS NOT NULL AND d IS NOT NULL),
u AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY ticker, period, d, r ORDER BY present DESC, a DESC NULLS LAST, b DESC NULLS LAST) = 1),
n AS (SELECT * FROM u QUALIFY present OR row_number() OVER (PARTITION BY ticker, period, d ORDER BY r) = 1),
c AS (SELECT * FROM n WINDOW w AS (PARTITION BY ticker, period, d ORDER BY r) QUALIFY row_number() OVER w = 1 OR lag(present) OVER w <> present OR lag(a) OVER w IS DISTINCT FROM a OR lag(b) OVER w IS DISTINCT FROM b),
chain AS (SELECT *, coalesce(lead(r) OVER w, TIMESTAMP '9999-12-31') AS until FROM c WINDOW w AS (PARTITION BY ticker, period, d ORDER BY r)),
f AS (SELECT ticker, period, d, min(r) AS f FROM chain GROUP BY 1, 2, 3),
p AS (SELECT x.ticker, x.period, x.d, x.f AS first, y.d AS d2, y.f AS f2 FROM f x LEFT JOIN f y ON y.ticker = x.ticker AND y.period = x.period AND y.d > x.d),
st AS (SELECT DISTINCT ticker, period, d, first AS since FROM p UNION SELECT DISTINCT ticker, period, d, f2 FROM p WHERE f2 > first),
en AS (SELECT st.ticker, st.period, st.d, since, coalesce(min(d2) FILTER (f2 <= since), DATE '9999-12-31') AS until_day FROM st JOIN p USING (ticker, period, d) GROUP BY ALL),
ch AS (SELECT * FROM en WINDOW w AS (PARTITION BY ticker, period, d ORDER BY since) QUALIFY lag(until_day) OVER w IS DISTINCT FROM until_day),
steps AS (SELECT *, coalesce(lead(since) OVER w, TIMESTAMP '9999-12-31') AS upto FROM ch WINDOW w AS (PARTITION BY ticker, period, d ORDER BY since)),
led AS (SELECT chain.*, until_day, greatest(r, since) AS rf, least(until, upto) AS rt FROM chain JOIN steps USING (ticker, period, d))
"""
ORACLE["p4_ledger"] = (
    CELLS
    + """SELECT ticker, period, strftime(d, '%Y-%m-%d') AS valid_from, strftime(until_day, '%Y-%m-%d') AS valid_to, strftime(rf, '%Y-%m-%d %H:%M:%S') AS recorded_from, strftime(rt, '%Y-%m-%d %H:%M:%S') AS recorded_to, present, a AS eps_current, b AS est_eps_avg
FROM led WHERE rf < rt"""
)
