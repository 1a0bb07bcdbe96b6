"""Walk-forward models over the matched calls and over the monthly panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as V
from ..operators import market as M
from ..operators import ml as L
from ..operators.events import raw_prediction
from ..operators.relational import row_folds
from ..runtime import store
from .events import event_table, feature_table
from .market import panel, r6
from .strategy import predictions

CALL = ["ticker", "quarter", "year"]
FEATURES = ["score", "score2", "tone"]
OUT = [*CALL, "fold"]


def _data(spark: SparkSession, d: str) -> DataFrame:
    """The first 70 % of rows by date are there to learn from, the rest in three folds to be predicted."""
    return row_folds(predictions(spark, d), "date", CALL, 3, 0.7)


def ridge_walkforward(spark, d):
    x = L.walk_forward(_data(spark, d), FEATURES, "actual", L.ridge())
    return x.select(*OUT, r6("actual"), r6("predicted"))


def ridge_winsorised(spark, d):
    x = L.walk_forward(_data(spark, d), FEATURES, "actual", L.ridge(), winsor=0.01)
    return x.select(*OUT, r6("actual"), r6("predicted"))


def tuned_ridge(spark, d):
    x = _data(spark, d)
    params, _ = L.search(x, FEATURES, "actual", {"alpha": [0.5, 5.0, 50.0]}, L.ridge, 30)
    return L.walk_forward(x, FEATURES, "actual", L.ridge(**params)).select(*OUT, "actual", "predicted")


def logit_walkforward(spark, d):
    """Directions of clear moves, from a model of clear moves; NULL for the others."""
    x = L.dead_zone(_data(spark, d), "actual", 0.02)
    p = L.walk_forward(row_folds(x.filter("direction is not null").drop("fold"), "date", CALL, 3, 0.7), FEATURES, "direction", L.logit(), classify=True)
    return L.map_back(x.filter("fold > 0").select(*OUT, "direction"), p.withColumn("label", (F.col("predicted") >= 0.5).cast("int")), CALL, ["predicted", "label"])


def gbt_walkforward(spark, d):
    return L.walk_forward(_data(spark, d), FEATURES, "actual", L.boosted(), winsor=0.01).select(*OUT, "actual", "predicted")


def rank_target_model(spark, d):
    x = L.rank_label(_data(spark, d), "actual", "month")
    return L.walk_forward(x, FEATURES, "rank_label", L.ridge()).select(*OUT, r6("rank_label"), r6("predicted"))


def _sector_models(spark, d):
    x = predictions(spark, d).withColumn("sector", F.ascii(F.substring("ticker", 1, 1)) % 4)
    fit = lambda p: L.walk_forward(row_folds(p, "date", CALL, 3, 0.7), FEATURES, "actual", L.ridge())
    out = L.by_group(x, "sector", [0, 1, 2, 3], 20, fit)
    return out if out is not None else x.limit(0).withColumn("fold", F.lit(0)).withColumn("predicted", F.lit(None).cast("double"))


def sector_submodels(spark, d):
    return _sector_models(spark, d).select(*OUT, "sector", "actual", r6("predicted"))


def sector_quality(spark, d):
    """Measures of each sector's model and of all together."""
    x = store(_sector_models(spark, d).select(F.col("sector").cast("string").alias("sector"), F.col("predicted").alias("score"), "actual").dropna(), "sectors").df
    both = x.unionByName(x.withColumn("sector", F.lit("all")))
    err = F.pow(F.col("actual") - F.col("score"), 2)
    out = both.groupBy("sector").agg(F.count("*").alias("n"), F.sqrt(F.avg(err)).alias("rmse"), F.avg((F.signum("actual") == F.signum("score")).cast("double")).alias("sign_accuracy"))
    return out.select("sector", "n", r6("rmse"), r6("sign_accuracy"))


def baseline_mean(spark, d):
    x = L.expanding_mean(predictions(spark, d), "date", "actual")
    return x.select("ticker", "quarter", "year", (F.round(F.col("baseline") + F.lit(1e-12), 9) + F.lit(0.0)).alias("baseline"))


def baseline_fold_mean(spark, d):
    return L.fold_mean(_data(spark, d), "actual").select(*OUT, r6("baseline"))


CANDIDATES = ["n_turns", "hedge_per_1k", "answer_question_ratio", "full_n_words", "full_vader_mean", "full_lm_net"]
EXTRA = ["qa_vader_mean", "qa_lm_net"]


def _events(spark, d):
    x = row_folds(feature_table(spark, d), "date", CALL, 3, 0.7).withColumn("month", F.trunc("date", "MM"))
    return store(x, "events").df


def selected_features(spark, d):
    x = _events(spark, d)
    chosen = L.best_features(x, CANDIDATES + EXTRA, "abnormal_30d", 3)
    return spark.createDataFrame([(i, c) for i, c in enumerate(chosen, 1)], "place int, feature string")


def arms_compared(spark, d):
    return L.two_arms(_events(spark, d), CANDIDATES, EXTRA, "abnormal_30d", "abnormal_30d", "month", L.ridge(), least=3)


def _final(spark, d):
    x = L.prepared(_data(spark, d), FEATURES, "actual")
    return x, *L.fit_one(x.filter("_y is not null"), FEATURES, L.boosted(maxIter=50))


def feature_importances(spark, d):
    _, model, _ = _final(spark, d)
    return L.importances(model, FEATURES, spark)


def shapley_means(spark, d):
    """Mean size of each feature's part in the predictions of the final model, greatest first."""
    x, model, apply = _final(spark, d)
    v = L.shapley_values(apply(x), model, FEATURES, CALL)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.abs(f"shap_{f}").alias("v")) for f in FEATURES]))
    return v.select(each.alias("x")).groupBy("x.feature").agg(F.avg("x.v").alias("mean_abs")).orderBy(F.desc("mean_abs")).limit(8)


def adjusted_target_model(spark, d):
    """The adjusted target predicted, brought back to raw returns, beside the direction of clear moves."""
    x = row_folds(event_table(spark, d), "date", CALL, 3, 0.7)
    x = L.dead_zone(x, "abnormal_30d_va", 0.5)
    p = L.walk_forward(x, ["full_lm_net", "qa_lm_net", "full_vader_mean"], "abnormal_30d_va", L.ridge())
    p = raw_prediction(p, "predicted", "predicted_raw")
    return p.select(*OUT, "direction", r6("abnormal_30d_va"), r6("predicted"), r6("predicted_raw"))


PANEL = [*M.BASE, "mom_12_1_va", "mom_6_1_va", "idio_mom_va", "rev_5d_va", "turn_trend", "log_adv"]


def momentum_model(spark, d):
    """The monthly panel's target by boosted trees over all its features, over whole dates, with clipped training labels."""
    x = L.date_folds(store(panel(spark, d), "panel").df, "date", 3, 0.7)
    return L.walk_forward(x, PANEL, "target", L.boosted(), winsor=0.01).select(F.date_format("date", "yyyy-MM-dd").alias("date"), "ticker", "fold", "target", "predicted")


def momentum_against_composite(spark, d):
    """Paired difference of the model's and the composite's rank correlation by date."""
    x = L.date_folds(store(panel(spark, d), "panel").df, "date", 3, 0.7)
    p = store(L.walk_forward(x, PANEL, "target", L.ridge(), winsor=0.01).select("date", "composite", F.col("predicted").alias("score"), F.col("target").alias("actual")), "predicted").df
    a = V.rank_ic(p, "date").select("date", F.col("ic").alias("a"))
    b = V.rank_ic(p, "date", score="composite").select("date", F.col("ic").alias("b"))
    return V.ic_summary(a.join(b, "date").withColumn("ic", F.col("a") - F.col("b"))).select("periods", "mean_ic", "t")


QUERIES = {f.__name__: f for f in (ridge_walkforward, ridge_winsorised, tuned_ridge, logit_walkforward, gbt_walkforward, rank_target_model, sector_submodels, sector_quality, baseline_mean, baseline_fold_mean, selected_features, arms_compared, feature_importances, shapley_means, adjusted_target_model, momentum_model, momentum_against_composite)}
