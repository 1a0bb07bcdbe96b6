"""What of the models SQL can say: baselines, folds, and ridge regression by Cramer's rule for its three features."""

from .events_sql import FEATURES, FT
from .market_sql import pct, r6
from .strategy_sql import PRED

def folds(src: str, by: str = "") -> str:
    return FOLDS.replace("SRC", src).replace("BY_ORDER", f"PARTITION BY {by} ORDER BY" if by else "ORDER BY").replace("BY_ALL", f"PARTITION BY {by}" if by else "")


FOLDS = f"""pos AS (SELECT *, row_number() OVER (BY_ORDER date, ticker, quarter, year) - 1 AS i, count(*) OVER (BY_ALL) AS n FROM SRC), cut AS (SELECT *, floor(n * 0.7 + 1e-9) AS s0 FROM pos),
fd AS (SELECT *, ({" + ".join(f"(i >= floor(s0 + (n - s0) * {k} / 3 + 1e-9))::INT" for k in range(3))})::INT AS fold FROM cut)"""
X = ("score", "score2", "tone")


def det(m: list[list[str]]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = m
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def ridge(label: str, winsor: float | None = None, src: str = "fd", alpha: float = 5.0, by: str = "") -> str:
    """CTEs up to ``rp`` with the predictions of folds 1 to 3, a model for each ``by`` (a column with its comma)."""
    y = f"CASE WHEN {label} IS NOT NULL THEN greatest(lo, least(hi, {label})) END" if winsor else label
    bounds = f"(SELECT k, quantile_cont({label}, {winsor}) AS lo, quantile_cont({label}, {1 - winsor}) AS hi FROM {src}, ks WHERE fold < k AND {label} IS NOT NULL GROUP BY k)" if winsor else "ks"
    z = lambda c: f"(coalesce({c}, 0) - m_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1 END"
    s = [[f"(s{min(i, j)}{max(i, j)}{f' + {alpha}' if i == j else ''})" for j in range(3)] for i in range(3)]
    key = f"{by} k"
    with_b = lambda k: [[f"b{i}" if j == k else s[i][j] for j in range(3)] for i in range(3)]
    return f"""ks AS (SELECT unnest([1, 2, 3]) AS k), bd AS (SELECT * FROM {bounds}),
tr AS (SELECT k, {by} {y} AS y, {", ".join(X)} FROM {src}, bd WHERE fold < k AND {label} IS NOT NULL),
sc AS (SELECT k, {by} avg(y) AS my, {", ".join(f"avg(coalesce({c}, 0)) AS m_{c}, stddev_pop(coalesce({c}, 0)) AS s_{c}" for c in X)} FROM tr GROUP BY ALL),
tz AS (SELECT k, {by} y - my AS y, {", ".join(f"{z(c)} AS z{i}" for i, c in enumerate(X))} FROM tr JOIN sc USING ({key})),
sm AS (SELECT k, {by} {", ".join(f"sum(z{i} * z{j}) AS s{i}{j}" for i in range(3) for j in range(i, 3))}, {", ".join(f"sum(z{i} * y) AS b{i}" for i in range(3))} FROM tz GROUP BY ALL),
w AS (SELECT k, {by} {", ".join(f"{det(with_b(i))} / {det(s)} AS w{i}" for i in range(3))} FROM sm),
rp AS (SELECT f.*, my + {" + ".join(f"w{i} * {z(c)}" for i, c in enumerate(X))} AS predicted FROM (SELECT *, fold AS k FROM {src}) f JOIN sc USING ({key}) JOIN w USING ({key}))"""


SECTORS = f"{PRED}, ps AS (SELECT *, ascii(ticker[1]) % 4 AS sector FROM pred QUALIFY count(*) OVER (PARTITION BY ascii(ticker[1]) % 4) >= 20), {folds('ps', 'sector')}, {ridge('actual', by='sector,')}"
LONG = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c}::DOUBLE AS x, abnormal_30d AS y FROM tn" for c in ("n_turns", "hedge_per_1k", "answer_question_ratio", "full_n_words", "full_vader_mean", "full_lm_net", "qa_vader_mean", "qa_lm_net"))
EIGHTHS = "[" + ", ".join(f"{k}/8::DOUBLE" for k in range(1, 8)) + "]"
ORACLE = {
    "baseline_mean": f"""WITH {PRED}, d AS (SELECT date, sum(actual) AS s, count(actual) AS c FROM pred GROUP BY 1),
b AS (SELECT date, sum(s) OVER w / nullif(sum(c) OVER w, 0) AS baseline FROM d WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT ticker, quarter, year, round(baseline + 1e-12, 9) + 0.0 AS baseline FROM pred JOIN b USING (date)""",
    "baseline_fold_mean": f"WITH {PRED}, {folds('pred')} SELECT ticker, quarter, year, fold, {r6('(SELECT avg(actual) FROM fd g WHERE g.fold < fd.fold)', 'baseline')} FROM fd WHERE fold > 0",
    "ridge_walkforward": f"WITH {PRED}, {folds('pred')}, {ridge('actual')} SELECT ticker, quarter, year, fold, {r6('actual')}, {r6('predicted')} FROM rp",
    "ridge_winsorised": f"WITH {PRED}, {folds('pred')}, {ridge('actual', 0.01)} SELECT ticker, quarter, year, fold, {r6('actual')}, {r6('predicted')} FROM rp",
    "rank_target_model": f"WITH {PRED}, {folds('pred')}, fr AS (SELECT *, {pct('actual', 'month')} AS rank_label FROM fd), {ridge('rank_label', src='fr')} SELECT ticker, quarter, year, fold, {r6('rank_label')}, {r6('predicted')} FROM rp",
    "sector_submodels": f"WITH {SECTORS} SELECT ticker, quarter, year, fold, sector, actual, {r6('predicted')} FROM rp",
    "sector_quality": f"""WITH {SECTORS}, o AS (SELECT sector::VARCHAR AS sector, actual, predicted FROM rp WHERE actual IS NOT NULL), b AS (SELECT * FROM o UNION ALL SELECT 'all', actual, predicted FROM o)
SELECT sector, count(*) AS n, {r6("sqrt(avg(pow(actual - predicted, 2)))", "rmse")}, {r6("avg((sign(actual) = sign(predicted))::INT)", "sign_accuracy")} FROM b GROUP BY 1""",
    "selected_features": f"""WITH {FT}, {folds("ft")}, tn AS (SELECT * FROM fd WHERE fold = 0), lg AS ({LONG}),
qs AS (SELECT feature, quantile_disc(x, {EIGHTHS}) AS qx FROM lg WHERE x IS NOT NULL GROUP BY 1), qt AS (SELECT quantile_disc(abnormal_30d, {EIGHTHS}) AS qy FROM tn),
bn AS (SELECT feature, len(list_filter(qx, lambda e: e < x)) AS b, len(list_filter(qy, lambda e: e < y)) AS t FROM lg JOIN qs USING (feature), qt WHERE x IS NOT NULL AND y IS NOT NULL),
ce AS (SELECT feature, b, t, count(*) AS c FROM bn GROUP BY ALL),
it AS (SELECT feature, c / sum(c) OVER (PARTITION BY feature) * ln(c * sum(c) OVER (PARTITION BY feature) / (sum(c) OVER (PARTITION BY feature, b) * sum(c) OVER (PARTITION BY feature, t))) AS i FROM ce),
mi AS (SELECT feature, sum(i) AS m FROM it GROUP BY 1) SELECT (row_number() OVER (ORDER BY m DESC, feature))::INT AS place, feature FROM mi ORDER BY m DESC, feature LIMIT 3""",
    "adjusted_target_model": f"""WITH {FEATURES}, ea AS (SELECT ticker, quarter, year, date, full_lm_net AS score, qa_lm_net AS score2, full_vader_mean AS tone, abnormal_30d_va, va_scale, va_mean FROM ef), {folds("ea")}, {ridge("abnormal_30d_va")}
SELECT ticker, quarter, year, fold, CASE WHEN abs(abnormal_30d_va) > 0.5 THEN (abnormal_30d_va > 0)::INT END AS direction, {r6("abnormal_30d_va")}, {r6("predicted")}, {r6("predicted * va_scale + va_mean", "predicted_raw")} FROM rp""",
}
