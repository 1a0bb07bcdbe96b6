"""Measures of predictions against outcomes, all from columns ``score`` and ``actual``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import average_rank, pct_rank, quantile_bin
from ..runtime import store


def rank_ic(df: DataFrame, by: str, least: int = 5, score: str = "score", actual: str = "actual") -> DataFrame:
    """Spearman correlation per group with at least ``least`` pairs."""
    x = df.dropna(subset=[score, actual]).select(by, average_rank(score, by).alias("_s"), average_rank(actual, by).alias("_a"))
    return x.groupBy(by).agg(F.count("*").alias("n"), F.corr("_s", "_a").alias("ic")).filter(F.col("n") >= least)


def ic_summary(ic: DataFrame, c: str = "ic") -> DataFrame:
    out = ic.filter(F.col(c).isNotNull() & ~F.isnan(c)).agg(F.count("*").alias("periods"), F.avg(c).alias("mean_ic"), F.stddev_samp(c).alias("std_ic"), F.avg((F.col(c) > 0).cast("double")).alias("share_positive"))
    return out.withColumn("t", F.try_divide("mean_ic", "std_ic") * F.sqrt("periods"))


def decile_means(df: DataFrame, order: list[str], bins: int = 10) -> DataFrame:
    """Mean outcome by bin of the first-come rank of the score.

    The rank over all rows is made by range-partitioned counting: rows are sorted in parallel by value and numbered by
    the counts of the value ranges before them.
    """
    x = ranges(df.dropna(subset=["score", "actual"]), "score")
    per = x.groupBy("_b").agg(F.count("*").alias("_c"))
    w = W.orderBy("_b")  # a row per range
    per = per.withColumn("_before", F.sum("_c").over(w) - F.col("_c")).withColumn("_n", F.sum("_c").over(W.partitionBy()))
    x = x.join(F.broadcast(per), "_b").withColumn("_r", F.col("_before") + F.row_number().over(W.partitionBy("_b").orderBy("score", *order)))
    return x.groupBy(quantile_bin(F.col("_r"), F.col("_n"), bins).alias("decile")).agg(F.count("*").alias("n"), F.avg("actual").alias("mean_actual"))


def spread_bps(deciles: DataFrame, bins: int = 10) -> DataFrame:
    top = F.max(F.when(F.col("decile") == bins - 1, F.col("mean_actual")))
    bottom = F.max(F.when(F.col("decile") == 0, F.col("mean_actual")))
    return deciles.agg(((top - bottom) * 1e4).alias("spread_bps"))


def pct_deciles(df: DataFrame, by: str) -> DataFrame:
    x = df.dropna(subset=["score", "actual"]).withColumn("_p", pct_rank("score", by))
    return x.groupBy(F.least(F.floor(F.col("_p") * 10), F.lit(9)).cast("int").alias("decile")).agg(F.count("*").alias("n"), F.avg("actual").alias("mean_actual"))


def regression_quality(df: DataFrame) -> DataFrame:
    x = df.dropna(subset=["score", "actual"])
    mean = x.agg(F.avg("actual").alias("_m"))
    x = x.join(F.broadcast(mean))  # one row
    err = F.pow(F.col("actual") - F.col("score"), 2)
    return x.agg(F.count("*").alias("n"), F.sqrt(F.avg(err)).alias("rmse"), (1 - F.try_divide(F.sum(err), F.sum(F.pow(F.col("actual") - F.col("_m"), 2)))).alias("r2"), F.avg((F.signum("actual") == F.signum("score")).cast("double")).alias("sign_accuracy"), F.sqrt(F.avg(F.pow(F.col("actual") - F.col("_m"), 2))).alias("naive_rmse"))


def confusion(df: DataFrame) -> DataFrame:
    """Signs of score against signs of outcome: counts, accuracy, F1 of the positive class."""
    x = df.dropna(subset=["score", "actual"]).select((F.col("score") > 0).alias("p"), (F.col("actual") > 0).alias("a"))
    n = lambda c: F.sum(c.cast("bigint"))
    out = x.agg(n(F.col("p") & F.col("a")).alias("tp"), n(F.col("p") & ~F.col("a")).alias("fp"), n(~F.col("p") & F.col("a")).alias("fn"), n(~F.col("p") & ~F.col("a")).alias("tn"))
    return out.select("*", F.try_divide(F.expr("tp + tn"), F.expr("tp + fp + fn + tn")).alias("accuracy"), F.try_divide(F.expr("2 * tp"), F.expr("2 * tp + fp + fn")).alias("f1"))


def ranges(df: DataFrame, c: str, n: int = 256) -> DataFrame:
    """``df`` with ``_b``, the range of ``c`` each row falls in, cut at approximate quantiles of the data."""
    cut = df.agg(F.percentile_approx(c, F.array(*[F.lit(k / n) for k in range(1, n)]), 10000).alias("_e"))
    return df.join(F.broadcast(cut)).withColumn("_b", F.size(F.filter("_e", lambda e: e < F.col(c)))).drop("_e")  # one row


def roc_auc(df: DataFrame) -> DataFrame:
    """Area under the curve by the rank sum, from counts per distinct score, so no global sort of rows is needed."""
    x = df.dropna(subset=["score", "actual"]).groupBy("score").agg(F.sum((F.col("actual") > 0).cast("bigint")).alias("p"), F.sum((F.col("actual") <= 0).cast("bigint")).alias("q"))
    x = ranges(store(x, "scores").df, "score")
    cell = x.groupBy("_b").agg(F.sum("q").alias("_cq"))
    cell = cell.withColumn("_below", F.sum("_cq").over(W.orderBy("_b")) - F.col("_cq")).drop("_cq")  # a row per range
    x = x.join(F.broadcast(cell), "_b").withColumn("_in", F.sum("q").over(W.partitionBy("_b").orderBy("score")) - F.col("q"))
    return x.agg(F.try_divide(F.sum(F.col("p") * (F.col("_below") + F.col("_in") + F.col("q") / 2)), F.sum("p") * F.sum("q")).alias("auc"))


def mutual_information(df: DataFrame, features: list[str], target: str, bins: int = 8) -> DataFrame:
    """Binned mutual information of each feature with the target, in nats; bins by approximate quantiles."""
    probs = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    cuts = df.agg(*[F.percentile_approx(c, probs, 10000).alias(f"_q_{c}") for c in [*features, target]])
    bin_of = lambda c: F.size(F.filter(f"_q_{c}", lambda e: e < F.col(c)))
    x = df.join(F.broadcast(cuts))  # one row
    long = x.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.when(F.col(c).isNotNull() & F.col(target).isNotNull(), bin_of(c)).alias("b")) for c in features])).alias("f"), bin_of(target).alias("t")).select("f.*", "t").filter("b is not null")
    cells = long.groupBy("feature", "b", "t").agg(F.count("*").alias("c"))
    n = F.sum("c").over(W.partitionBy("feature"))
    term = F.col("c") / n * F.log(F.col("c") * n / (F.sum("c").over(W.partitionBy("feature", "b")) * F.sum("c").over(W.partitionBy("feature", "t"))))
    return cells.withColumn("_i", term).groupBy("feature").agg(F.sum("_i").alias("mi"))
