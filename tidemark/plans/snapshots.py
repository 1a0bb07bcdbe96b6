"""Queries over the snapshot and event tables: history, differences, values as known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import believed, bitemporal_ledger, versions
from ..operators.point_in_time import as_known
from ..operators.snapshot_diff import snapshot_changes
from ..runtime import store
from ..sources.tables import day, eps, lowered, number, read, ticker

KEYS = ["ticker", "period"]
VALUES = ["eps_current", "est_eps_avg"]


def estimate_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    est = read(spark, sf_dir, "estimate_snapshot").select(ticker().alias("ticker"), lowered("period").alias("period"), "snap_date", "loaded_at", *[eps(v).alias(v) for v in VALUES])
    seen = read(spark, sf_dir, "analyst_snapshot").select(ticker().alias("ticker"), "snap_date", "loaded_at").groupBy("ticker", "snap_date").agg(F.min("loaded_at").alias("loaded_at"))
    # A delivery is complete when the day it was loaded on is over; only then is a missing record known to be absent.
    seen = seen.withColumn("loaded_at", F.date_add(F.to_date("loaded_at"), 1).cast("timestamp"))
    absent = seen.join(est.select(*KEYS).distinct(), "ticker")
    est = est.withColumn("loaded_at", F.col("loaded_at").cast("timestamp"))
    return bitemporal_ledger(est, absent, KEYS, "snap_date", "loaded_at", VALUES)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = versions(believed(estimate_ledger(spark, sf_dir)), KEYS, VALUES)
    return rows.select(*KEYS, day("valid_from").alias("valid_from"), day("valid_to").alias("valid_to"))


def p4_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = versions(believed(estimate_ledger(spark, sf_dir)), KEYS, VALUES)
    return rows.select(*KEYS, day("valid_from").alias("valid_from"), day("valid_to").alias("valid_to"), *VALUES)


def p4_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("recorded_from", "recorded_to")]
    return estimate_ledger(spark, sf_dir).select(*KEYS, day("valid_from").alias("valid_from"), day("valid_to").alias("valid_to"), *stamp, "present", *VALUES)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    est = read(spark, sf_dir, "estimate_snapshot").select("snap_date", ticker().alias("ticker"), lowered("period").alias("period"), eps("eps_current").alias("eps_current"), "loaded_at")
    out = snapshot_changes(est, read(spark, sf_dir, "analyst_snapshot"), "snap_date", KEYS, ["eps_current"], "loaded_at")
    return out.select(day("snap_date").alias("snap_date"), *KEYS, "change")


def p6_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_found(spark, sf_dir).groupBy("snap_date", "change").agg(F.count("*").alias("n"))


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "earnings").select(ticker().alias("ticker"), "earnings_date")
    est = read(spark, sf_dir, "estimate_snapshot").filter((lowered("period") == "0q") & number("eps_current").isNotNull()).select(ticker().alias("ticker"), "snap_date", "loaded_at")
    px = read(spark, sf_dir, "prices").filter(number("close").isNotNull()).select(ticker().alias("ticker"), "date", "loaded_at")
    vix = read(spark, sf_dir, "vix").filter(number("vix_close").isNotNull()).select("date")
    return as_known(events, "earnings_date", [
        {"rows": est, "entity": ["ticker"], "date": "snap_date", "loaded": "loaded_at", "out": "snap_date"},
        {"rows": px, "entity": ["ticker"], "date": "date", "loaded": "loaded_at", "out": "price_date"},
        {"rows": vix, "entity": [], "date": "date", "out": "vix_date", "few": True},
    ])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _known(spark, sf_dir)
    return known.select("ticker", day("earnings_date").alias("earnings_date"), *[F.coalesce(day(c), F.lit("")).alias(c) for c in ("snap_date", "price_date", "vix_date")])


def p7_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the values behind :func:`p7_found`, from the latest delivery loaded before the event's day."""
    known = store(_known(spark, sf_dir), "known").df

    def value(rows: DataFrame, date: str, col: str, out: str) -> DataFrame:
        k = known.select("ticker", "earnings_date", date).dropna()
        j = k.join(rows, ["ticker", date]).filter(F.to_date("loaded_at") < F.col("earnings_date"))
        return j.groupBy("ticker", "earnings_date").agg(F.max(F.struct("loaded_at", F.col(col))).alias("m")).select("ticker", "earnings_date", F.col("m")[col].alias(out))

    est = read(spark, sf_dir, "estimate_snapshot").filter((lowered("period") == "0q") & number("eps_current").isNotNull()).select(ticker().alias("ticker"), "snap_date", "loaded_at", eps("eps_current").alias("eps_current"))
    px = read(spark, sf_dir, "prices").filter(number("close").isNotNull()).select(ticker().alias("ticker"), F.col("date").alias("price_date"), "loaded_at", F.round("close", 4).alias("close"))
    vix = read(spark, sf_dir, "vix").filter(number("vix_close").isNotNull()).groupBy(F.col("date").alias("vix_date")).agg(F.max(F.round("vix_close", 4)).alias("vix_close"))
    keys = ["ticker", "earnings_date"]
    out = known.select(*keys, "vix_date").join(F.broadcast(vix), "vix_date", "left")  # one row per calendar day
    out = out.join(value(est, "snap_date", "eps_current", "eps_known"), keys, "left").join(value(px, "price_date", "close", "close_known"), keys, "left")
    return out.select("ticker", day("earnings_date").alias("earnings_date"), "eps_known", "close_known", "vix_close")


QUERIES = {f.__name__: f for f in (p4_found, p4_versions, p4_ledger, p6_found, p6_summary, p7_found, p7_features)}
