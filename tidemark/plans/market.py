"""Queries over prices, events and VIX."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import average_rank, clip, pct_rank, rolling_avg
from ..operators import market as M
from ..operators.asof import asof_backward, asof_legacy, asof_nearest
from ..operators.relational import exact_quantiles
from ..operators.panel import expanding_z, past_stats, qoq, streak
from ..runtime import latest, store
from ..sources.tables import day, lowered, number, read, ticker

BENCHMARK = "BMKIDX"
SPECIAL = ("2022-06-01", "2022-12-31")


def r6(c: str | Column, name: str | None = None) -> Column:
    # The shift keeps exact halves, which engines round differently, off the edge.
    out = F.round((F.col(c) if isinstance(c, str) else c) + F.lit(1e-10), 6) + F.lit(0.0)
    return out.alias(name or c) if (name or isinstance(c, str)) else out


def prices(spark: SparkSession, d: str) -> DataFrame:
    raw = read(spark, d, "prices").filter("date is not null")
    vals = [F.round(number(c), 4).alias(c) for c in ("close", "volume")]
    return M.clean_prices(raw.select(ticker().alias("ticker"), "date", *vals, "loaded_at"))


def cal(spark: SparkSession, d: str) -> DataFrame:
    """The calendar of all price dates, from the date column alone."""
    return M.calendar(read(spark, d, "prices").select("date"))


def on_cal(spark: SparkSession, d: str) -> DataFrame:
    return M.on_calendar(prices(spark, d), cal(spark, d))


def events(spark: SparkSession, d: str) -> DataFrame:
    """Distinct events with their greatest values, at 4 decimals."""
    e = read(spark, d, "earnings").filter("earnings_date is not null")
    return e.groupBy(ticker().alias("ticker"), "earnings_date").agg(*[F.max(F.round(number(c), 4)).alias(c) for c in ("eps_estimate", "reported_eps", "eps_surprise_pct")])


def vix(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "vix").groupBy("date").agg(F.max(F.round(number("vix_close"), 4)).alias("vix_close"))


def sector() -> Column:
    return F.concat(F.lit("S"), (F.ascii(F.substring("ticker", 1, 1)) % 4).cast("string"))


def scan_prices(spark, d):
    return prices(spark, d).select("ticker", day("date").alias("date"), "close", "volume")


def calendar_index(spark, d):
    return cal(spark, d).select(day("date").alias("date"), "cal_idx")


def universe_union(spark, d):
    t = prices(spark, d).select("ticker").union(events(spark, d).select("ticker")).union(read(spark, d, "transcripts_text").select(ticker().alias("ticker")))
    return t.distinct()


def null_counts(spark, d):
    p = prices(spark, d)
    return p.agg(F.count("*").alias("n"), *[F.sum(F.col(c).isNull().cast("bigint")).alias(f"{c}_nulls") for c in ("close", "volume")])


def event_returns(spark, d):
    return _event_returns(spark, d).select("ticker", day("earnings_date").alias("earnings_date"), *[r6(f"{k}_{n}d") for k in ("return", "abnormal") for n in M.WINDOWS], r6("vix_close"), "is_covid")


def _event_returns(spark, d):
    return M.event_returns(events(spark, d).select("ticker", "earnings_date"), prices(spark, d), cal(spark, d), BENCHMARK, vix(spark, d), SPECIAL)


def robust_event_summary(spark, d):
    x = _event_returns(spark, d).filter(~F.col("is_covid"))
    return x.groupBy(F.year("earnings_date").alias("year")).agg(F.count("return_30d").alias("n"), r6(F.avg("return_30d"), "mean_30d"), r6(F.stddev_samp("return_30d"), "std_30d"))


def describe_returns(spark, d):
    x = store(_event_returns(spark, d).select("abnormal_30d"), "returns").df
    out = x.agg(F.count("abnormal_30d").alias("n"), F.avg("abnormal_30d").alias("mean"), F.stddev_samp("abnormal_30d").alias("std"), F.min("abnormal_30d").alias("min"), F.max("abnormal_30d").alias("max"))
    out = out.join(F.broadcast(exact_quantiles(x, "abnormal_30d", [0.25, 0.5, 0.75])))  # one row each
    return out.select("n", r6("mean"), r6("std"), r6("min"), *[r6(F.col("q")[i], f"q{25 * (i + 1)}") for i in range(3)], r6("max"))


def trailing_returns(spark, d):
    days = cal(spark, d)
    e = M.entries(events(spark, d).select("ticker", "earnings_date"), "earnings_date", days)
    out = M.event_window_returns(e, ["ticker", "earnings_date"], prices(spark, d), days, (5, 20), forward=False)
    return out.select("ticker", day("earnings_date").alias("earnings_date"), r6("r5", "mom_5d"), r6("r20", "mom_20d"))


def _calls(spark, d):
    c = read(spark, d, "transcripts_text").select(ticker().alias("ticker"), lowered("quarter").alias("quarter"), "year", "pub_date", "loaded_at")
    return latest(c, ["ticker", "quarter", "year"], "loaded_at").drop("loaded_at")


def asof_nearest_30d(spark, d):
    """Nearest event with a surprise, within 30 days; of two equally near ones the earlier."""
    right = events(spark, d).filter("eps_surprise_pct is not null").select("ticker", F.col("earnings_date").alias("t"), "eps_surprise_pct")
    left = _calls(spark, d).filter("pub_date is not null").withColumnRenamed("pub_date", "t")
    out = asof_nearest(left, right, ["ticker"], "t", ["eps_surprise_pct"], 30)
    return out.select("ticker", "quarter", "year", day("t").alias("pub_date"), "eps_surprise_pct")


def asof_legacy_nearest(spark, d):
    right = events(spark, d).select("ticker", F.col("earnings_date").alias("t"), "eps_surprise_pct")
    left = _calls(spark, d).filter("pub_date is not null").withColumnRenamed("pub_date", "t")
    out = asof_legacy(left, ["ticker", "quarter", "year"], right, ["ticker"], "t", 30)
    return out.select("ticker", "quarter", "year", day("t").alias("pub_date"), day("matched").alias("matched"))


def asof_legacy_unmatched(spark, d):
    """How many dated calls have an event near, and how many none."""
    x = asof_legacy_nearest(spark, d)
    return x.agg(F.count("matched").alias("matched"), (F.count("*") - F.count("matched")).alias("unmatched"))


def asof_unmatched_fallback(spark, d):
    """Calls with their event; where none is near, the publication date stands in."""
    right = events(spark, d).select("ticker", F.col("earnings_date").alias("t"))
    left = _calls(spark, d).filter("pub_date is not null").withColumnRenamed("pub_date", "t")
    out = asof_legacy(left, ["ticker", "quarter", "year"], right, ["ticker"], "t", 30)
    anchor = F.when(F.col("matched").isNull(), "pub_date").otherwise("earnings_date")
    return out.select("ticker", "quarter", "year", day(F.coalesce("matched", "t")).alias("anchor_date"), anchor.alias("return_anchor"))


def asof_backward_10d(spark, d):
    """Trailing volatility, one row late, attached to events no more than 10 days after it."""
    x = M.daily_returns(on_cal(spark, d))
    x = x.select("ticker", F.col("date").alias("t"), M.rolling("r", F.stddev_samp("r"), 60, 30, 1).alias("vol"))
    e = events(spark, d).select("ticker", F.col("earnings_date").alias("t"))
    return asof_backward(e, x.filter("vol is not null"), ["ticker"], "t", ["vol"], 10).select("ticker", day("t").alias("earnings_date"), r6("vol"))


def expanding_surprise_z(spark, d):
    e = events(spark, d)
    return expanding_z(e, ["ticker"], ["earnings_date"], ["eps_surprise_pct"]).select("ticker", day("earnings_date").alias("earnings_date"), r6("eps_surprise_pct_z"))


def qoq_delta(spark, d):
    return qoq(events(spark, d), ["ticker"], ["earnings_date"], ["eps_surprise_pct", "reported_eps"]).select("ticker", day("earnings_date").alias("earnings_date"), r6("eps_surprise_pct_qoq"), r6("reported_eps_qoq"))


def past_target_stats(spark, d):
    x = _event_returns(spark, d)
    return past_stats(x, ["ticker"], ["earnings_date"], "abnormal_30d", 2).select("ticker", day("earnings_date").alias("earnings_date"), r6("abnormal_30d_past_mean"), r6("abnormal_30d_past_std"))


def sue(spark, d):
    x = past_stats(events(spark, d), ["ticker"], ["earnings_date"], "eps_surprise_pct", 2)
    q = F.try_divide("eps_surprise_pct", F.nullif("eps_surprise_pct_past_std", F.lit(0.0)))
    return x.select("ticker", day("earnings_date").alias("earnings_date"), r6(F.coalesce(clip(q, -10.0, 10.0), F.lit(0.0)), "sue"))


def surprise_streak(spark, d):
    return streak(events(spark, d), ["ticker"], ["earnings_date"], "eps_surprise_pct").select("ticker", day("earnings_date").alias("earnings_date"), "streak")


def momentum_features(spark, d):
    x = M.momentum_features(on_cal(spark, d), BENCHMARK)
    cols = [*M.BASE, "mom_12_1_va", "mom_6_1_va", "idio_mom_va", "rev_5d_va"]
    return x.select("ticker", day("date").alias("date"), *[r6(c) for c in cols])


def liquidity_feats(spark, d):
    return M.liquidity(on_cal(spark, d)).select("ticker", day("date").alias("date"), r6("turn_trend"), r6("log_adv"))


def dma200(spark, d):
    x = on_cal(spark, d)
    return x.select("ticker", day("date").alias("date"), r6(rolling_avg("close", "ticker", "cal_idx", 200, 200), "dma"))


def panel(spark, d):
    return M.scored_panel(prices(spark, d), cal(spark, d), BENCHMARK, sector())


def momentum_panel(spark, d):
    cols = ["target", "raw_target", "mom_12_1_sn", "rev_5d_sn", "log_adv_sn", "beta_252_sn", "turn_trend"]
    x = M.momentum_panel(prices(spark, d), cal(spark, d), BENCHMARK, sector())
    return x.select("ticker", day("date").alias("date"), "sector", *[r6(c) for c in cols])


def composite_score(spark, d):
    return panel(spark, d).select("ticker", day("date").alias("date"), r6("composite"))


def correlation(spark, d):
    x = _event_returns(spark, d)
    cols = ["return_1d", "return_30d", "return_90d"]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    return x.agg(*[r6(F.corr(a, b), f"{a}_{b}") for a, b in pairs])


def surprise_ranks(spark, d):
    e = events(spark, d).withColumn("m", F.trunc("earnings_date", "MM"))
    return e.select("ticker", day("earnings_date").alias("earnings_date"), r6(pct_rank("eps_surprise_pct", "m"), "pct"), r6(average_rank("eps_surprise_pct", "m"), "avg_rank"))


QUERIES = {f.__name__: f for f in (scan_prices, calendar_index, universe_union, null_counts, event_returns, robust_event_summary, describe_returns, trailing_returns, asof_nearest_30d, asof_legacy_nearest, asof_legacy_unmatched, asof_unmatched_fallback, asof_backward_10d, expanding_surprise_z, qoq_delta, past_target_stats, sue, surprise_streak, momentum_features, liquidity_feats, dma200, momentum_panel, composite_score, correlation, surprise_ranks)}
