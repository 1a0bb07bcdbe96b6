"""Calls joined to their events' returns, and the features of an event made from its past, its prices and its text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import clip
from ..runtime import store
from . import market as M
from .asof import asof_backward, asof_nearest
from .panel import expanding_z, past_stats, qoq, streak
from .relational import fill_median

# Features that get a z-score against the past, a change against the call before, a difference between
# sections, and a product with the surprise.
Z_COLS = """vader_compound vader_mean vader_std vader_pct_neg vader_pct_pos vader_pos vader_neg vader_neu lm_net lm_pos_ratio lm_neg_ratio lm_positive
lm_negative lm_uncertainty finbert_net finbert_positive finbert_negative finbert_neutral flesch_reading_ease flesch_kincaid_grade gunning_fog smog_index
automated_readability dale_chall_score unique_word_ratio avg_sentence_length""".split()
QOQ_COLS = """full_finbert_net full_lm_net full_vader_mean full_vader_pct_neg qa_finbert_net qa_vader_mean hedge_per_1k answer_question_ratio
full_flesch_kincaid_grade full_n_words""".split()
DELTA_COLS = "vader_compound vader_mean vader_std vader_pct_neg vader_pct_pos finbert_net lm_net flesch_reading_ease unique_word_ratio".split()
INTERACTIONS = "full_finbert_net full_lm_net full_vader_mean qa_finbert_net".split()
RETURNS = ["return_1d", "return_30d", "return_90d", "abnormal_1d", "abnormal_30d", "abnormal_90d", "vix_close", "is_covid"]


def call_returns(calls: DataFrame, key: list[str], returns: DataFrame, priced, tolerance: int = 30) -> DataFrame:
    """Calls with the returns of the nearest event within ``tolerance`` days, else those from their publication on.

    ``calls``: ``key``, ticker, pub_date; rows without a date are left out. ``priced(events)`` gives the returns of any
    (ticker, earnings_date). Calls without an event are kept only where prices give a first return.
    """
    left = calls.filter("pub_date is not null").withColumnRenamed("pub_date", "t")
    right = returns.withColumn("t", F.col("earnings_date"))
    m = store(asof_nearest(left, right, ["ticker"], "t", ["earnings_date", *RETURNS], tolerance), "nearest").df
    hit = m.filter("earnings_date is not null").withColumn("return_anchor", F.lit("earnings_date"))
    miss = m.filter("earnings_date is null").drop("earnings_date", *RETURNS).withColumn("earnings_date", F.col("t"))
    own = priced(miss.select("ticker", "earnings_date").distinct())
    miss = miss.join(own, ["ticker", "earnings_date"]).filter("return_1d is not null").withColumn("return_anchor", F.lit("pub_date"))
    out = hit.unionByName(miss)
    return out.select(*key, F.col("t").alias("pub_date"), F.col("earnings_date").alias("matched_earnings_date"), *RETURNS, F.abs(F.datediff("t", "earnings_date")).alias("day_diff"), "return_anchor")


def own_row_vol(prices: DataFrame, window: int = 60, least: int = 30) -> DataFrame:
    """(ticker, date, vol): deviation of the returns of a ticker's last ``window`` rows before each of its rows."""
    w = W.partitionBy("ticker").orderBy("date")
    r = prices.select("ticker", "date", (F.try_divide("close", F.lag("close").over(w)) - 1).alias("r"))
    past = w.rowsBetween(-window, -1)
    return r.select("ticker", "date", F.when(F.count("r").over(past) >= least, F.stddev_samp("r").over(past)).alias("vol")).filter("vol is not null")


def event_features(rows: DataFrame, sectors: DataFrame, prices: DataFrame, cal: DataFrame, surprises: DataFrame, target: str = "abnormal_30d", scores: DataFrame | None = None) -> DataFrame:
    """The features of each event, none of which looks past it.

    ``rows``: ticker, quarter, year, date and what section features there are; columns that the lists above name and
    ``rows`` lacks are passed over. ``surprises``: ticker, earnings_date, eps_surprise_pct. ``scores``: ticker, quarter,
    year and scores of an outside model. The scale of the adjusted target takes the median of all rows where there is
    no volatility. Rows of one ticker and date go by quarter and year.
    """
    key, order = ["ticker", "quarter", "year"], ["date", "quarter", "year"]
    sectors = sectors.select("ticker", F.coalesce("sector", F.lit("Other")).alias("sector"))
    x = rows.join(store(sectors, "sectors").hinted(), "ticker", "left").fillna({"sector": "Other"})

    at = M.entries(x.select(*key, "date"), "date", cal)
    before = M.event_window_returns(at, [*key, "date"], prices, cal, (5, 20), forward=False)
    x = x.join(before.select(*key, F.col("r5").alias("pre_momentum_5d"), F.col("r20").alias("pre_momentum_20d")), key, "left")

    known = surprises.filter("eps_surprise_pct is not null").select("ticker", F.col("earnings_date").alias("date"), "eps_surprise_pct")
    x = asof_nearest(x, known, ["ticker"], "date", ["eps_surprise_pct"], 30)
    x = asof_backward(x, own_row_vol(prices), ["ticker"], "date", ["vol"], 10).withColumnRenamed("vol", "pre_vol_60d")

    x = past_stats(x, ["ticker"], order, "eps_surprise_pct", 2)
    q = F.try_divide("eps_surprise_pct", F.nullif("eps_surprise_pct_past_std", F.lit(0.0)))
    x = x.withColumn("sue", F.coalesce(clip(q, -10.0, 10.0), F.lit(0.0))).drop("eps_surprise_pct_past_mean", "eps_surprise_pct_past_std")
    x = streak(x, ["ticker"], order, "eps_surprise_pct").withColumnRenamed("streak", "surprise_streak")
    x = expanding_z(x, ["ticker"], order, [f"{s}_{c}" for s in ("full", "qa") for c in Z_COLS if f"{s}_{c}" in x.columns])
    if scores is not None:
        mine = [c for c in scores.columns if c not in key]
        x = x.join(scores.select(*key, *[F.col(c).alias(f"llm_{c}") for c in mine]), key, "left")
        x = qoq(x, ["ticker"], order, [f"llm_{c}" for c in ("guidance_direction", "demand_outlook", "margin_outlook", "tone_numbers_gap", "n_questions_dodged") if c in mine])
    x = qoq(x, ["ticker"], order, [c for c in QOQ_COLS if c in x.columns])
    x = past_stats(x, ["ticker"], order, target, 2).withColumnsRenamed({f"{target}_past_mean": f"past_{target}_mean", f"{target}_past_std": f"past_{target}_std"})

    x = x.withColumn("va_scale", F.when(F.col("pre_vol_60d").isNotNull(), F.greatest(F.col("pre_vol_60d") * F.sqrt(F.lit(30.0)), F.lit(0.03))))
    x = fill_median(store(x, "event-features").df, "va_scale").withColumn("va_mean", F.coalesce(f"past_{target}_mean", F.lit(0.0)))
    x = x.withColumn(f"{target}_va", (F.col(target) - F.col("va_mean")) / F.col("va_scale"))
    surprise = F.coalesce("eps_surprise_pct", F.lit(0.0))
    each = [c + z for c in INTERACTIONS for z in ("", "_z") if c + z in x.columns]
    deltas = [m for m in DELTA_COLS if f"full_{m}" in x.columns and f"qa_{m}" in x.columns]
    return x.select("*", *[(F.coalesce(c, F.lit(0.0)) * surprise).alias(f"ix_{c}_x_surprise") for c in each], *[(F.col(f"qa_{m}") - F.col(f"full_{m}")).alias(f"qa_delta_{m}") for m in deltas])


def raw_prediction(df: DataFrame, predicted: str, out: str) -> DataFrame:
    """A prediction of the adjusted target in the units of the target itself."""
    return df.withColumn(out, F.col(predicted) * F.col("va_scale") + F.col("va_mean"))
