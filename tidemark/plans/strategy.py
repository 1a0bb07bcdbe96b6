"""Queries over signals, scores, sizes and outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import rolling_std
from ..operators import ensemble as E
from ..operators import evaluate as V
from ..operators import market as M
from ..operators import portfolio as P
from ..operators import regime as R
from ..operators.relational import exact_quantiles
from ..runtime import store
from ..sources.tables import day, lowered, number, read, ticker
from .market import BENCHMARK, cal, panel, prices, r6, sector, vix

CUTOFFS = (0.10, 0.15, 0.20, 0.25, 0.30, 0.40, 0.50)
STRESS = [("2022 bear market", "2022-01-01", "2022-10-15"), ("2023 first half", "2023-01-01", "2023-06-30"), ("2024 summer", "2024-07-15", "2024-08-31"), ("2018 last quarter", "2018-10-01", "2018-12-31")]
AS_OF = "2024-06-03"


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Scores and outcomes of matched calls, from the older feature run: one row per call, greatest values."""
    s = read(spark, d, "sentiment_features")
    key = [ticker().alias("ticker"), lowered("quarter").alias("quarter"), "year"]
    x = s.groupBy(*key).agg(F.max("matched_earnings_date").alias("date"), *[F.max(F.round(number(c), 9)).alias(a) for c, a in (("full_lm_net", "score"), ("qa_lm_net", "score2"), ("full_vader_mean", "tone"), ("abnormal_30d", "actual"))])
    return x.filter("date is not null").withColumn("month", F.trunc("date", "MM"))


def _stored_prices(spark, d):
    """Prices that several parts of one query read, cleaned once."""
    return store(prices(spark, d), "prices").df


def signal_breadth(spark, d):
    x = R.breadth(prices(spark, d), [BENCHMARK])
    return x.select(day("date").alias("date"), r6("share"), R.breadth_signal(F.col("share")).alias("signal"))


def _regime(spark, d, p=None):
    return R.regime(p if p is not None else _stored_prices(spark, d), BENCHMARK, vix(spark, d))


def regime_gate(spark, d):
    return _regime(spark, d).select(day("date").alias("date"), r6("vix_close"), "vix", "spy", "breadth", "credit", "composite", "multiplier")


def regime_credit(spark, d):
    """The gate with a credit pair: the least and the greatest ticker that stand for a risky and a safe bond fund."""
    p = _stored_prices(spark, d)
    a, b = p.filter(F.col("ticker") != BENCHMARK).agg(F.min("ticker"), F.max("ticker")).first()
    x = R.regime(p, BENCHMARK, vix(spark, d), R.credit_ratio(p, a, b))
    return x.select(day("date").alias("date"), "vix", "spy", "breadth", "credit", "composite", "multiplier")


def regime_summary(spark, d):
    x = _regime(spark, d).agg(F.count("*").alias("days"), day(F.min("date")).alias("first"), day(F.max("date")).alias("last"), *R.occupancy())
    return x.select("days", "first", "last", r6("risk_on_pct"), r6("caution_pct"), r6("risk_off_pct"))


def regime_stress(spark, d):
    x = R.stress_windows(_regime(spark, d), STRESS)
    return x.select("label", "days", *[r6(c) for c in ("mean_multiplier", "mean_vix", "risk_on_pct", "caution_pct", "risk_off_pct")])


def regime_forward(spark, d):
    p = _stored_prices(spark, d)
    return R.forward_by_regime(_regime(spark, d, p), p, BENCHMARK).select("multiplier", "days", r6("fwd_21"), r6("fwd_63"))


def _decay(spark, d):
    days = cal(spark, d)
    s = predictions(spark, d).groupBy("ticker", F.col("date").alias("event_date")).agg(F.max("score").alias("score"))
    entry = M.entries(s.select("event_date").distinct(), "event_date", days)
    return E.event_decay(s, days, entry)


def event_decay(spark, d):
    return _decay(spark, d).select(day("date").alias("date"), "ticker", r6("eca_z"))


def _momentum_daily(spark, d, p):
    return E.momentum_daily(M.scored_panel(p, cal(spark, d), BENCHMARK, sector()), p)


def momentum_daily(spark, d):
    return _momentum_daily(spark, d, _stored_prices(spark, d)).select(day("date").alias("date"), "ticker", r6("momentum_z"))


def _ensemble(spark, d, **how):
    p = _stored_prices(spark, d)
    return E.blend(_momentum_daily(spark, d, p), _decay(spark, d), _regime(spark, d, p), **how)


def _scores(x):
    return x.select(day("date").alias("date"), "ticker", r6("momentum_z"), r6("eca_z"), "regime", r6("ensemble_z"))


def ensemble_scores(spark, d):
    return _scores(_ensemble(spark, d))


def ensemble_gated(spark, d):
    return _scores(_ensemble(spark, d, gate=True))


def ensemble_as_of(spark, d):
    return _scores(_ensemble(spark, d, as_of=AS_OF))


def ensemble_summary(spark, d):
    x = E.summary(_ensemble(spark, d))
    return x.select("n_dates", "n_tickers", r6("pct_momentum_active"), r6("pct_eca_active"), r6("avg_regime"), day("first").alias("first"), day("last").alias("last"))


def _book(spark, d):
    return panel(spark, d).select("date", "ticker", "sector", F.col("composite").alias("score"), F.col("vol_60d").alias("vol"))


def size_one_date(spark, d):
    return P.size_one_date(_book(spark, d)).select(day("date").alias("date"), "ticker", r6("weight"))


def size_deciles(spark, d):
    return P.size_deciles(_book(spark, d)).select(day("date").alias("date"), "ticker", r6("weight"))


def size_deciles_neutral(spark, d):
    """Scores less their sector's mean before the tails are taken."""
    return P.size_deciles(_book(spark, d), sector_neutral=True).select(day("date").alias("date"), "ticker", r6("weight"))


def size_book(spark, d):
    """Each rebalance sized with the volatility of the 60 rows before it."""
    p, days = _stored_prices(spark, d), cal(spark, d)
    x = M.scored_panel(p, days, BENCHMARK, sector()).select("date", "ticker", "sector", F.col("composite").alias("score"))
    r = M.daily_returns(M.on_calendar(p, days))
    vol = r.select("date", "ticker", rolling_std("r", "ticker", "cal_idx", 60, 30, 1).alias("vol"))
    return P.size_one_date(x.join(vol, ["date", "ticker"], "left")).select(day("date").alias("date"), "ticker", r6("weight"))


def book_stats(spark, d):
    x = P.book_stats(P.size_one_date(_book(spark, d)))
    return x.select(day("date").alias("date"), "n", *[r6(c) for c in ("gross", "net", "max_abs", "effective_n")])


def backtest_trades(spark, d):
    x = P.trades(predictions(spark, d), "date")
    return x.select("ticker", "quarter", "year", day("date").alias("date"), "n_names", "side", r6("weight"), r6("gross"), r6("net"), r6("ew"))


def trades_by_month(spark, d):
    """The same with the names of a month as one group, which has more of them than one event date."""
    x = P.trades(predictions(spark, d), "month")
    return x.select("ticker", "quarter", "year", day("month").alias("month"), "n_names", "side", r6("weight"), r6("gross"), r6("net"), r6("ew"))


def _pnl(spark, d):
    """Entry-date returns, with the benchmark's over the same rows, 0 where it has none."""
    x = P.event_pnl(P.trades(predictions(spark, d), "date"), ["date"])
    days = cal(spark, d)
    e = M.entries(x.withColumn("ticker", F.lit(BENCHMARK)).select("ticker", "date"), "date", days)
    b = M.event_window_returns(e, ["date"], prices(spark, d).filter(F.col("ticker") == BENCHMARK), days, (30,))
    return x.join(b, "date", "left").withColumn("spy", F.coalesce("r30", F.lit(0.0))).drop("r30")


def event_pnl(spark, d):
    return _pnl(spark, d).select(day("date").alias("date"), "n", "n_long", "n_short", *[r6(c) for c in ("gross", "net", "ew", "spy", "long_only", "short_raw")])


SERIES = ("gross", "net", "ew", "spy", "long_only")


def portfolio_metrics(spark, d):
    each = F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).alias("r")) for c in SERIES])
    x = _pnl(spark, d).select("date", F.explode(each).alias("x")).select("date", "x.*")
    return P.metrics(x, ["series"], "date", "r", 252 / 30).select("series", "n", *[r6(c) for c in ("total", "cagr", "sharpe", "max_drawdown", "win_rate", "avg")])


def drawdown(spark, d):
    x = P.drawdowns(_pnl(spark, d).withColumn("s", F.lit(1)), ["s"], "date", "net")
    return x.select(day("date").alias("date"), r6("equity"), r6("drawdown"))


def rolling_sharpe(spark, d):
    return P.rolling_sharpe(_pnl(spark, d), "date", "net", 252 / 30).select(day("date").alias("date"), r6("rolling_sharpe"))


def cutoff_sensitivity(spark, d):
    x = predictions(spark, d).withColumn("cutoff", F.explode(F.array(*[F.lit(c) for c in CUTOFFS])))
    x = P.event_pnl(P.trades(x, "date", F.col("cutoff")), ["cutoff", "date"])
    m = P.metrics(x, ["cutoff"], "date", "net", 252 / 30)
    avg = x.groupBy("cutoff").agg((F.sum(F.col("n_long") + F.col("n_short")) / F.count("*")).alias("avg_positions"))
    return m.join(avg, "cutoff").select("cutoff", "n", *[r6(c) for c in ("total", "sharpe", "win_rate", "avg_positions")])


def leg_decomposition(spark, d):
    """Means over dates of each leg's mean outcome, and how often the leg earned."""
    x = _pnl(spark, d)
    leg = lambda c, s: x.agg(F.lit(c).alias("leg"), F.count(c).alias("dates"), F.avg(c).alias("mean_return"), F.avg((F.col(c) * s > 0).cast("double")).alias("hit_rate"))
    return leg("long_only", 1).unionByName(leg("short_raw", -1)).select("leg", "dates", r6("mean_return"), r6("hit_rate"))


def monthly_long_short(spark, d):
    """The composite's top less bottom decile at each rebalance, as published and net of costs."""
    x = store(panel(spark, d).filter("composite is not null"), "scored").df
    own, raw = P.long_short(x, "composite", "target"), P.long_short(x, "composite", "raw_target").select("date", F.col("gross").alias("raw_gross"), F.col("net").alias("raw_net"))
    return own.join(raw, "date").select(day("date").alias("date"), *[r6(c) for c in ("gross", "net", "raw_gross", "raw_net")])


def monthly_ic(spark, d):
    return V.rank_ic(predictions(spark, d), "month").select(day("month").alias("month"), "n", r6("ic"))


def ic_summary(spark, d):
    return V.ic_summary(V.rank_ic(predictions(spark, d), "month")).select("periods", *[r6(c) for c in ("mean_ic", "std_ic", "share_positive", "t")])


def ic_paired_t(spark, d):
    p = predictions(spark, d)
    a = V.rank_ic(p, "month").select("month", F.col("ic").alias("a"))
    b = V.rank_ic(p, "month", score="score2").select("month", F.col("ic").alias("b"))
    return V.ic_summary(a.join(b, "month").withColumn("ic", F.col("a") - F.col("b"))).select("periods", r6("mean_ic", "mean_diff"), r6("t"))


def decile_spread_qcut(spark, d):
    x = V.decile_means(predictions(spark, d), ["ticker", "quarter", "year"])
    return x.select("decile", "n", r6("mean_actual"))


def decile_spread_bps(spark, d):
    return V.spread_bps(V.decile_means(predictions(spark, d), ["ticker", "quarter", "year"])).select(r6("spread_bps"))


def decile_spread_pct(spark, d):
    return V.pct_deciles(predictions(spark, d), "month").select("decile", "n", r6("mean_actual"))


def regression_quality(spark, d):
    return V.regression_quality(predictions(spark, d)).select("n", *[r6(c) for c in ("rmse", "r2", "sign_accuracy", "naive_rmse")])


def confusion(spark, d):
    return V.confusion(predictions(spark, d)).select("tp", "fp", "fn", "tn", r6("accuracy"), r6("f1"))


def roc_auc(spark, d):
    return V.roc_auc(predictions(spark, d)).select(r6("auc"))


def winsor_bounds(spark, d):
    return exact_quantiles(predictions(spark, d), "actual", [0.01, 0.99]).select(r6(F.col("q")[0], "low"), r6(F.col("q")[1], "high"))


def mi_ranking(spark, d):
    return V.mutual_information(predictions(spark, d), ["score", "score2", "tone"], "actual").select("feature", r6("mi"))


def verdict(spark, d):
    """All measures of a run in one row, with a word on what they say."""
    p = store(predictions(spark, d), "predictions").df
    one = lambda x: F.broadcast(x)  # noqa: E731  one row each
    x = V.ic_summary(V.rank_ic(p, "month")).select("mean_ic", "t")
    x = x.join(one(V.regression_quality(p).select("rmse", "sign_accuracy"))).join(one(V.spread_bps(V.decile_means(p, ["ticker", "quarter", "year"])))).join(one(V.roc_auc(p)))
    say = F.when((F.abs("t") >= 2) & (F.col("mean_ic") > 0), "usable").when(F.col("mean_ic") > 0, "weak").otherwise("none")
    return x.select(*[r6(c) for c in ("rmse", "sign_accuracy", "mean_ic", "t", "spread_bps", "auc")], say.alias("verdict"))


QUERIES = {f.__name__: f for f in (signal_breadth, regime_gate, regime_credit, regime_summary, regime_stress, regime_forward, event_decay, momentum_daily, ensemble_scores, ensemble_gated, ensemble_as_of, ensemble_summary, size_one_date, size_deciles, size_deciles_neutral, size_book, book_stats, backtest_trades, trades_by_month, event_pnl, portfolio_metrics, drawdown, rolling_sharpe, cutoff_sensitivity, leg_decomposition, monthly_long_short, monthly_ic, ic_summary, ic_paired_t, decile_spread_qcut, decile_spread_bps, decile_spread_pct, regression_quality, confusion, roc_auc, winsor_bounds, mi_ranking, verdict)}
