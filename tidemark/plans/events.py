"""Queries over events with their features, and the small relational operators on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events as EV
from ..operators import market as M
from ..operators import relational as L
from ..operators.panel import full_sample_z
from ..runtime import latest, store
from ..sources import sinks as K
from ..sources.tables import calls_key, day, lowered, number, read, ticker
from .market import BENCHMARK, SPECIAL, cal, events, prices, r6, vix

CALL = ["ticker", "quarter", "year"]
NUMBERS = ["n_turns", "hedge_per_1k", "answer_question_ratio", "full_n_words", "full_vader_mean", "full_lm_net", "qa_vader_mean", "qa_lm_net", "abnormal_30d"]


def feature_table(spark: SparkSession, d: str) -> DataFrame:
    """The older feature run, one row per call with the greatest values, matched calls only."""
    s = read(spark, d, "sentiment_features")
    x = s.groupBy(*[e.alias(k) for k, e in calls_key().items()]).agg(F.max("matched_earnings_date").alias("date"), F.max("has_qa").alias("has_qa"), *[F.max(F.round(number(F.col(c).cast("double")), 9)).alias(c) for c in NUMBERS])
    return x.filter("date is not null")


def sector_table(spark: SparkSession, d: str) -> DataFrame:
    """A sector dimension that knows three of four tickers, some of them twice."""
    t = feature_table(spark, d).select("ticker").distinct().withColumn("k", F.ascii(F.substring("ticker", 1, 1)) % 4).filter("k < 3")
    return t.select("ticker", F.concat(F.lit("S"), F.col("k").cast("string")).alias("sector"))


def event_table(spark: SparkSession, d: str) -> DataFrame:
    sur = events(spark, d).select("ticker", "earnings_date", "eps_surprise_pct")
    p = store(prices(spark, d), "prices").df
    return EV.event_features(feature_table(spark, d), sector_table(spark, d), p, cal(spark, d), sur)


FEATURES = ["pre_momentum_5d", "pre_momentum_20d", "eps_surprise_pct", "sue", "surprise_streak", "pre_vol_60d", "full_vader_mean_z", "full_lm_net_z", "qa_vader_mean_z", "qa_lm_net_z", "full_lm_net_qoq", "full_vader_mean_qoq", "qa_vader_mean_qoq", "hedge_per_1k_qoq", "answer_question_ratio_qoq", "full_n_words_qoq", "past_abnormal_30d_mean", "past_abnormal_30d_std", "va_scale", "va_mean", "abnormal_30d_va", "ix_full_lm_net_x_surprise", "ix_full_lm_net_z_x_surprise", "ix_full_vader_mean_x_surprise", "ix_full_vader_mean_z_x_surprise", "qa_delta_vader_mean", "qa_delta_lm_net"]


def event_features(spark, d):
    x = event_table(spark, d)
    return x.select(*CALL, day("date").alias("date"), "sector", *[r6(F.col(c).cast("double"), c) for c in FEATURES])


def full_sample_scores(spark, d):
    """The z-score over all of a ticker's calls, later ones too, beside which the leak-free one stands."""
    x = full_sample_z(feature_table(spark, d), ["ticker"], ["full_lm_net", "full_vader_mean"])
    return x.select(*CALL, r6("full_lm_net_fz"), r6("full_vader_mean_fz"))


def call_returns(spark, d):
    """Calls with the returns of their event, or from their publication on where none is near."""
    p, days, v = store(prices(spark, d), "prices").df, cal(spark, d), vix(spark, d)
    priced = lambda e: M.event_returns(e, p, days, BENCHMARK, v, SPECIAL)
    c = read(spark, d, "transcripts_text").select(*[e.alias(k) for k, e in calls_key().items()], "pub_date", "loaded_at")
    c = latest(c, CALL, "loaded_at").select(*CALL, "pub_date")
    returns = store(priced(events(spark, d).select("ticker", "earnings_date")), "returns").df
    x = EV.call_returns(c, CALL, returns, priced)
    return x.select(*CALL, day("pub_date").alias("pub_date"), day("matched_earnings_date").alias("matched_earnings_date"), *[r6(f"{k}_{n}d") for k in ("return", "abnormal") for n in M.WINDOWS], r6("vix_close"), "is_covid", "day_diff", "return_anchor")


def sectors_of_tickers(spark, d):
    t = events(spark, d).select("ticker").distinct()
    return L.with_attribute(t, sector_table(spark, d).union(sector_table(spark, d)), "ticker", "sector", "Other")


def valid_calls(spark, d):
    c = read(spark, d, "transcripts_text").select(*[e.alias(k) for k, e in calls_key().items()], "qa_z")
    return L.valid_calls(c, 2023, text="qa_z").select(*CALL).distinct()


def column_coverage(spark, d):
    """Share of present values of each numeric column, and whether it would be a candidate."""
    x = store(event_table(spark, d), "features").df
    groups = [("^qa_delta_", 0.3), ("_z$", 0.5), ("_qoq$|^past_", 0.5), ("^full_", 0.95), ("^(?!qa_|va_)", 0.95)]
    chosen = L.select_candidates(x, groups, ["year", "abnormal_30d", "abnormal_30d_va"])
    share = L.coverage(x, FEATURES)
    return spark.createDataFrame([(c, v, c in chosen) for c, v in share.items()], "feature string, share double, candidate boolean").select("feature", r6("share"), "candidate")


def renamed_features(spark, d):
    old = feature_table(spark, d).select(*CALL, "date", *[F.col(f"full_{c}").alias(c) for c in ("vader_mean", "lm_net")])
    x = L.prefixed(L.prefixed(old, "full_", "vader_mean", [*CALL, "date"]), "full_", "vader_mean", [*CALL, "date"])
    return x.select(*CALL, r6("full_vader_mean"), r6("full_lm_net"))


def median_fill(spark, d):
    return L.fill_median(feature_table(spark, d), "abnormal_30d").select(*CALL, r6("abnormal_30d"))


def call_summary(spark, d):
    c = read(spark, d, "transcripts_text").select(*[e.alias(k) for k, e in calls_key().items()], "pub_date", "has_qa", "n_words_full", "n_analyst_questions", "loaded_at")
    x = L.describe_calls(latest(c, CALL, "loaded_at"))
    return x.select("n", "tickers", day("first").alias("first"), day("last").alias("last"), r6("qa_share"), "median_n_words_full", "median_n_analyst_questions")


def covered_tickers(spark, d):
    return L.covered_entities(feature_table(spark, d), "ticker", "abnormal_30d", 0.8).select("ticker", r6("coverage"))


def key_overlap(spark, d):
    c = read(spark, d, "transcripts_text").select(*[e.alias(k) for k, e in calls_key().items()])
    return L.overlap(c, feature_table(spark, d), CALL)


def first_calls(spark, d):
    """The first ten calls by ticker, year and quarter, as a limit behind a full order."""
    return feature_table(spark, d).orderBy("ticker", "year", "quarter").limit(10).select(*CALL)


def top_and_bottom(spark, d):
    return L.head_tail(feature_table(spark, d).select(*CALL, "abnormal_30d"), "abnormal_30d", 15, CALL).select(*CALL, r6("abnormal_30d"))


def sampled_calls(spark, d):
    return L.hash_sample(feature_table(spark, d).select(*CALL), CALL, 5000)


def row_folds(spark, d):
    return L.row_folds(feature_table(spark, d), "date", CALL).select(*CALL, "fold")


def earnings_clean(spark, d):
    raw = read(spark, d, "earnings").withColumnsRenamed({"eps_surprise_pct": "Surprise(%)", "reported_eps": "Reported EPS"})
    x = K.earnings_rows(raw, "2023-01-01")
    return x.select(ticker().alias("ticker"), day("earnings_date").alias("earnings_date"), "reported_eps", "eps_surprise_pct").distinct()


def last_prices(spark, d):
    """Of each ticker and day the last present close and volume of all deliveries."""
    raw = read(spark, d, "prices").filter("date is not null").select(ticker().alias("ticker"), "date", "loaded_at", *[F.round(number(c), 4).alias(c) for c in ("close", "volume")])
    return K.last_values(raw, ["ticker", "date"], "loaded_at", ["close", "volume"]).select("ticker", day("date").alias("date"), "close", "volume")


QUERIES = {f.__name__: f for f in (event_features, full_sample_scores, call_returns, sectors_of_tickers, valid_calls, column_coverage, renamed_features, median_fill, call_summary, covered_tickers, key_overlap, first_calls, top_and_bottom, sampled_calls, row_folds, earnings_clean, last_prices)}
