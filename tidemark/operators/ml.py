"""Models fitted forward in time: each fold is predicted by a model that has only seen earlier dates.

Folds are made over distinct dates, a calendar, and joined back, so no row order of the whole data is needed. The loop
over folds runs a fixed number of fits on the driver's side; each fit is a distributed job.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import clip, pct_rank
from ..runtime import store
from .evaluate import mutual_information, rank_ic
from .relational import exact_quantiles, feature_count


def date_folds(df: DataFrame, date: str, k: int, start: float = 0.4) -> DataFrame:
    """``fold`` 1..k over the dates after the first ``start`` of them, which are fold 0; the first folds get extras."""
    days = df.select(date).dropna().distinct()
    days = days.withColumn("_r", F.percent_rank().over(W.orderBy(date)))
    test = days.filter(F.col("_r") >= start).select(date, F.ntile(k).over(W.orderBy(date)).alias("fold"))
    return df.join(F.broadcast(test), date, "left").fillna({"fold": 0})  # one row per day


#: Stored bytes of a task's part of the training rows, at least.
PART_BYTES = 4 << 20
#: Makes an estimator from the number of training rows and the population deviation of their labels.
Maker = Callable[[int, float], object]


def ridge(alpha: float = 5.0) -> Maker:
    """Least squares with ``alpha`` times the squared weights. Spark divides its parameter by the rows and by the deviation
    of the label, which is made good here."""
    return lambda n, sd: LinearRegression(featuresCol="_x", labelCol="_y", elasticNetParam=0.0, regParam=alpha * sd / max(n, 1), standardization=False, solver="normal")


def logit(c: float = 1.0) -> Maker:
    return lambda n, sd: LogisticRegression(featuresCol="_x", labelCol="_y", regParam=1.0 / (c * max(n, 1)), standardization=False, maxIter=500, tol=1e-9)


def boosted(classify: bool = False, **params) -> Maker:
    p = {"maxIter": 300, "maxDepth": 3, "stepSize": 0.05, "seed": 42} | params
    return lambda n, sd: (GBTClassifier if classify else GBTRegressor)(featuresCol="_x", labelCol="_y", **p)


def expanding_mean(df: DataFrame, date: str, label: str) -> DataFrame:
    """Baseline: the mean of all labels of earlier dates."""
    per = df.groupBy(date).agg(F.sum(label).alias("_s"), F.count(label).alias("_c"))
    w = W.orderBy(date).rowsBetween(W.unboundedPreceding, -1)
    per = per.select(date, F.try_divide(F.sum("_s").over(w), F.sum("_c").over(w)).alias("baseline"))
    return df.join(F.broadcast(per), date, "left")  # one row per day


def fold_mean(df: DataFrame, label: str) -> DataFrame:
    """Baseline: the mean of all labels of earlier folds, for rows of folds from 1 on."""
    per = df.groupBy("fold").agg(F.sum(label).alias("_s"), F.count(label).alias("_c"))
    w = W.orderBy("fold").rowsBetween(W.unboundedPreceding, -1)  # a row per fold
    per = per.select("fold", F.try_divide(F.sum("_s").over(w), F.sum("_c").over(w)).alias("baseline"))
    return df.filter("fold > 0").join(F.broadcast(per), "fold")


def prepared(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Stored rows with ``_f_{feature}`` (missing ones 0) and ``_y``, which all fits of a run read."""
    f = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_f_{c}") for c in features]
    kept = store(df.select("*", *f, F.col(label).cast("double").alias("_y")), "training")
    return kept.df.coalesce(max(1, kept.bytes // PART_BYTES))  # boosting runs a job per level: few rows in few tasks


def fit_one(train: DataFrame, features: list[str], model: Maker, winsor: float | None = None):
    """A pipeline fitted to rows with a label: features less their mean over their population deviation, then the model.
    ``winsor`` clips labels at those tails of the training rows."""
    cols = [f"_f_{c}" for c in features]
    if winsor:
        low, high = exact_quantiles(train, "_y", [winsor, 1 - winsor]).first()[0]
        train = train.withColumn("_y", clip("_y", low, high))
    at = train.agg(F.count("*").alias("n"), F.stddev_pop("_y").alias("sd"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    scaled = [(F.col(c) - F.lit(at[f"m{i}"])) / F.lit(at[f"s{i}"] or 1.0) for i, c in enumerate(cols)]
    put = lambda df: VectorAssembler(inputCols=[f"_z_{c}" for c in features], outputCol="_x").transform(df.select("*", *[e.alias(f"_z_{c}") for e, c in zip(scaled, features)]))
    fitted = model(at["n"], at["sd"] or 0.0).fit(put(train))
    return fitted, lambda df: fitted.transform(put(df))


def walk_forward(df: DataFrame, features: list[str], label: str, model: Maker, k: int = 3, classify: bool = False, winsor: float | None = None) -> DataFrame:
    """Rows of folds 1..k with ``predicted`` (a probability if ``classify``). Missing features count as 0, missing
    labels are predicted but not learned from. Folds without earlier labelled rows are left out."""
    x = prepared(df, features, label)
    out = []
    for i in range(1, k + 1):
        train, test = x.filter((F.col("fold") < i) & F.col("_y").isNotNull()), x.filter(F.col("fold") == i)
        if train.isEmpty() or (classify and train.select("_y").distinct().count() < 2):
            continue
        _, apply = fit_one(train, features, model, winsor)
        value = vector_to_array("probability")[1] if classify else F.col("prediction")
        out.append(apply(test).select(*df.columns, value.alias("predicted")))
    return reduce(DataFrame.unionByName, out) if out else df.limit(0).withColumn("predicted", F.lit(None).cast("double"))


def search(df: DataFrame, features: list[str], label: str, space: dict[str, list], make: Callable[..., Maker], trials: int, date: str = "date", k: int = 5, seed: int = 42) -> tuple[dict, float]:
    """The best of ``trials`` different seeded draws from ``space``, or of all of it if it has no more, by mean squared
    error over ``k`` time-ordered folds of fold 0, whose dates come before all that are predicted."""
    grid = [dict(zip(space, values)) for values in itertools.product(*space.values())]
    draws = grid if len(grid) <= trials else random.Random(seed).sample(grid, trials)
    tune = store(date_folds(df.filter("fold = 0").drop("fold"), date, k, 1 / (k + 1)), "tuning").df
    best: tuple[dict, float] = ({}, float("inf"))
    for params in draws:
        err = walk_forward(tune, features, label, make(**params), k).agg(F.avg(F.pow(F.col("predicted") - F.col(label), 2))).first()[0]
        if err is not None and err < best[1]:
            best = (params, err)
    return best


def dead_zone(df: DataFrame, target: str, width: float = 0.5) -> DataFrame:
    """``direction``: 1 or 0 where the target is beyond ``width``, else NULL."""
    return df.withColumn("direction", F.when(F.abs(target) > width, (F.col(target) > 0).cast("int")))


def rank_label(df: DataFrame, target: str, by: str) -> DataFrame:
    return df.withColumn("rank_label", pct_rank(target, by))


def by_group(df: DataFrame, group: str, groups: list, least: int, fit: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """``fit`` on each of the listed groups with at least ``least`` rows; the results together."""
    out = []
    for g in groups:
        part = df.filter(F.col(group) == g)
        if part.limit(least).count() >= least:
            out.append(fit(part))
    return reduce(DataFrame.unionByName, out) if out else None


def best_features(df: DataFrame, candidates: list[str], target: str, k: int | None = None) -> list[str]:
    """The ``k`` candidates that tell most about the target, by binned mutual information over rows of fold 0; by default
    as many as the rows support."""
    tune = store(df.filter("fold = 0"), "tuning").df
    k = k or feature_count(df.count())
    ranked = mutual_information(tune, candidates, target).orderBy(F.desc("mi"), "feature").limit(k)
    return [r.feature for r in ranked.collect()]


def map_back(df: DataFrame, scored: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    """All rows with the columns of those that were scored, NULL for the others."""
    return df.join(scored.select(*key, *cols), key, "left")


def importances(model, features: list[str], spark) -> DataFrame:
    """(feature, gain, splits) of a fitted tree ensemble: its own importances and how many nodes split by each."""
    splits = dict.fromkeys(range(len(features)), 0)
    for t in _trees(model):
        for n in t:
            if n[0] >= 0:
                splits[n[0]] += 1
    gain = model.featureImportances.toArray()
    return spark.createDataFrame([(f, float(gain[i]), splits[i]) for i, f in enumerate(features)], "feature string, gain double, splits int")


def _trees(model) -> list[list[tuple[int, float, int, int, float, float]]]:
    """Each tree as rows (feature or -1, threshold, left, right, prediction, training weight)."""
    out = []
    for tree, weight in zip(model.trees, model.treeWeights):
        rows: list[list] = []

        def walk(node, weight=weight, rows=rows) -> int:
            at = len(rows)
            rows.append([-1, 0.0, -1, -1, node.prediction() * weight, float(node.impurityStats().count())])
            if node.subtreeDepth() > 0:
                split = node.split()
                rows[at][:2] = split.featureIndex(), split.threshold()
                rows[at][2] = walk(node.leftChild())
                rows[at][3] = walk(node.rightChild())
            return at

        walk(tree._java_obj.rootNode())
        out.append([tuple(r) for r in rows])
    return out


def shapley(trees: list[list[tuple]], x: np.ndarray) -> np.ndarray:
    """Shapley values of every row of ``x`` for the sum of the trees, one column per feature.

    Of a tree only the features it splits by can have a value; for each set of them the expectation is that of the tree
    with the others followed both ways by their training weight. A tree of depth 3 has at most 7 such features.
    """
    out = np.zeros_like(x, dtype=float)
    for t in trees:
        used = sorted({n[0] for n in t if n[0] >= 0})

        def expect(at: int, known: frozenset[int], t=t) -> np.ndarray:
            f, cut, a, b, value, _ = t[at]
            if f < 0:
                return np.full(len(x), value)
            left, right = expect(a, known), expect(b, known)
            if f in known:
                return np.where(x[:, f] <= cut, left, right)
            w = t[a][5] / max(t[a][5] + t[b][5], 1e-300)
            return w * left + (1 - w) * right

        value = {s: expect(0, s) for r in range(len(used) + 1) for s in map(frozenset, itertools.combinations(used, r))}
        m = len(used)
        for f in used:
            for s in value:
                if f not in s:
                    out[:, f] += math.factorial(len(s)) * math.factorial(m - len(s) - 1) / math.factorial(m) * (value[s | {f}] - value[s])
    return out


def shapley_values(scaled: DataFrame, model, features: list[str], keys: list[str]) -> DataFrame:
    """``keys`` and ``shap_{feature}`` of rows with the assembled features ``_x``; trees go to the workers, rows stay there."""
    trees = scaled.sparkSession.sparkContext.broadcast(_trees(model))  # as large as the model

    def values(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            x = np.array(s.tolist(), float).reshape(len(s), len(features))
            yield pd.Series(list(shapley(trees.value, x)), index=s.index, dtype=object)

    v = scaled.select(*keys, F.pandas_udf(values, "array<double>")(vector_to_array("_x")).alias("_v"))
    return v.select(*keys, *[F.col("_v")[i].alias(f"shap_{f}") for i, f in enumerate(features)])


def two_arms(df: DataFrame, base: list[str], extra: list[str], label: str, actual: str, period: str, model: Maker, k: int = 3, gate: float = 0.01, least: int = 5) -> DataFrame:
    """One row: mean rank correlation by period of a model without and with the ``extra`` candidates, their difference, its
    paired t, and whether it passes the gate. Both arms choose their features alike, on fold 0."""
    ics = []
    for cands in (base, base + extra):
        chosen = best_features(df, cands, label)
        p = walk_forward(df, chosen, label, model, k)
        ics.append(store(rank_ic(p.select(period, F.col("predicted").alias("score"), F.col(actual).alias("actual")), period, least).filter("ic is not null and not isnan(ic)"), "ic").df)
    both = ics[0].select(period, F.col("ic").alias("a")).join(ics[1].select(period, F.col("ic").alias("b")), period)
    out = both.agg(F.count("*").alias("periods"), F.avg("a").alias("ic_without"), F.avg("b").alias("ic_with"), F.avg(F.col("b") - F.col("a")).alias("difference"), F.try_divide(F.avg(F.col("b") - F.col("a")), F.stddev_samp(F.col("b") - F.col("a"))).alias("_r"))
    return out.select("periods", "ic_without", "ic_with", "difference", (F.col("_r") * F.sqrt("periods")).alias("t"), F.coalesce(F.col("difference") >= gate, F.lit(False)).alias("passes"))
