"""Classifiers with out-of-fold scores: Spark ML pipelines in a loop over folds, and ridge logistics by Newton steps on sums over the rows."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import Imputer, StandardScaler, UnivariateFeatureSelector, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import calibrate, stats
from .index import stored


def balanced(rows: DataFrame, label: str = "label") -> DataFrame:
    """Adds weight: rows / (labels * rows of the label), so that every label weighs the same."""
    counts = rows.groupBy(label).agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n").alias("__all"), F.count("*").alias("__k"))
    joined = rows.join(F.broadcast(counts), label).join(F.broadcast(total), F.col("__all") >= F.col("__n"))
    return joined.withColumn("weight", F.col("__all") / (F.col("__k") * F.col("__n"))).drop("__n", "__all", "__k")


def with_vectors(rows: DataFrame, array: str = "embedding") -> DataFrame:
    return rows.withColumn("raw", array_to_vector(F.col(array).cast("array<double>")))


def logistic(c: float = 1.0, elastic: float = 0.0, iterations: int = 50) -> Pipeline:
    """Standardized, class-weighted logistic regression; ``c`` is the inverse of the penalty."""
    scale = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)
    model = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=1.0 / (100.0 * c), elasticNetParam=elastic, maxIter=iterations, standardization=False)
    return Pipeline(stages=[scale, model])


def selected_elastic_net(columns: Sequence[str], features: int, c: float, elastic: float) -> Pipeline:
    """Median imputation, the features with the best F-test, standardization, elastic-net logistic regression."""
    filled = [f"{name}_filled" for name in columns]
    return Pipeline(
        stages=[
            Imputer(inputCols=list(columns), outputCols=filled, strategy="median"),
            VectorAssembler(inputCols=filled, outputCol="assembled"),
            UnivariateFeatureSelector(featuresCol="assembled", outputCol="raw", labelCol="label").setFeatureType("continuous").setLabelType("categorical").setSelectionMode("numTopFeatures").setSelectionThreshold(features),
            *logistic(c, elastic).getStages(),
        ]
    )


def boosted_trees(iterations: int = 20, seed: int = 7) -> Pipeline:
    return Pipeline(stages=[GBTClassifier(featuresCol="raw", labelCol="label", weightCol="weight", maxIter=iterations, seed=seed)])


def perceptron(inputs: int, hidden: int, classes: int, seed: int = 7) -> Pipeline:
    scale = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)
    return Pipeline(stages=[scale, MultilayerPerceptronClassifier(featuresCol="features", labelCol="label", layers=[inputs, hidden, classes], maxIter=60, seed=seed)])


def scored(model: PipelineModel, rows: DataFrame, alias: str = "score") -> DataFrame:
    """Adds the probability of class 1."""
    return model.transform(rows).withColumn(alias, vector_to_array("probability")[1])


def out_of_fold(rows: DataFrame, build: Callable[[], Pipeline], fold: str, folds: int, keep: Sequence[str]) -> DataFrame:
    """Class probabilities of every row by a model fitted on the other folds.

    One fit a fold, each distributed over the rows; the loop is over folds, not data.
    """
    out = None
    for k in range(folds):
        model = build().fit(balanced(rows.where(F.col(fold) != k)))
        part = model.transform(rows.where(F.col(fold) == k)).select(*keep, vector_to_array("probability").alias("probabilities"))
        out = part if out is None else out.unionByName(part)
    return out


def nested_out_of_fold(rows: DataFrame, grid: Sequence[float], fold: str, inner: str, folds: int, inner_folds: int, group: str = "case_id", how: Sequence[str] = ("mean", "max", "top2_mean")) -> DataFrame:
    """Case decisions with penalty, instance aggregation and threshold chosen inside each outer fold's training part.

    Rows are instances with raw, label (0 / 1), the case, and the outer and inner fold of their
    group. Returns case, fold, score, threshold, predicted and what was chosen.
    """
    out = None
    for k in range(folds):
        train, test = rows.where(F.col(fold) != k), rows.where(F.col(fold) == k)
        best = None
        for c in grid:
            inside = out_of_fold(train, lambda c=c: logistic(c), inner, inner_folds, [group, "instance", "label"])
            cases = stats.instance_aggregates(inside.withColumn("p", F.col("probabilities")[1]), "p", [group, "label"]).withColumn("truth", F.col("label") == 1).cache()
            for name in how:
                chosen = calibrate.best_threshold(cases, "unit", score=name).first()
                order = (chosen["minimum_rate"], chosen["balanced_accuracy"], -c)
                if best is None or order > best[0]:
                    best = (order, c, name, chosen["threshold"])
            cases.unpersist()
        _, c, name, threshold = best
        model = logistic(c).fit(balanced(train))
        cases = stats.instance_aggregates(scored(model, test, "p"), "p", [group, "label"])
        part = cases.select(group, F.lit(k).alias("fold"), F.col(name).alias("score"), F.lit(float(threshold)).alias("threshold"), (F.col(name) >= threshold).alias("predicted"), F.lit(float(c)).alias("c"), F.lit(name).alias("aggregation"))
        out = part if out is None else out.unionByName(part)
    return out


def one_against_one(rows: DataFrame, classes: Sequence[int], fold: str, folds: int, key: str) -> DataFrame:
    """(key, left, right, p of right) for every pair of classes, out of fold; rows of other classes are scored as well."""
    out = None
    for left, right in itertools.combinations(classes, 2):
        pair = rows.withColumn("__two", (F.col("label") == right).cast("double"))
        for k in range(folds):
            train = pair.where((F.col(fold) != k) & F.col("label").isin(left, right)).drop("label").withColumnRenamed("__two", "label")
            model = logistic().fit(balanced(train))
            part = scored(model, pair.where(F.col(fold) == k), "p").select(key, F.lit(str(left)).alias("left"), F.lit(str(right)).alias("right"), "p")
            out = part if out is None else out.unionByName(part)
    return out


def hard_instances(rows: DataFrame, rounds: int, group: str = "case_id") -> PipelineModel:
    """Multiple-instance fit: negatives stay whole, of each positive case only the instance that the last model found likeliest."""
    model = logistic().fit(balanced(rows))
    for _ in range(rounds):
        likely = scored(model, rows.where("label = 1"), "__p")
        kept = likely.groupBy(group).agg(F.max_by("instance", F.struct("__p", (-F.col("instance")).alias("o"))).alias("instance"))
        chosen = rows.where("label = 0").unionByName(rows.where("label = 1").join(kept, [group, "instance"], "left_semi"))
        model = logistic().fit(balanced(chosen))
    return model


def ridge_logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 80) -> np.ndarray:
    """Intercept and coefficients of class-balanced logistic regression with a ridge on all but the intercept, by Newton steps."""
    design = np.column_stack([np.ones(len(x)), x])
    share = y.mean()
    weight = np.where(y == 1, 0.5 / max(share, 1e-12), 0.5 / max(1 - share, 1e-12))
    penalty = np.full(design.shape[1], ridge)
    penalty[0] = 0
    beta = np.zeros(design.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -35, 35)))
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag(penalty + 1e-12)
        step = np.linalg.solve(hessian, design.T @ (weight * (y - p)) - penalty * beta)
        beta += step
        if np.abs(step).max() < 1e-10:
            break
    return beta


@dataclass(frozen=True)
class Fit:
    """One ridge fit: its penalty, and what it holds out: rows with any of the (column, value) pairs. The last pair's rows are those it scores, if no other holds them out."""

    ridge: float
    held: tuple[tuple[str, int], ...]

    def parts(self, frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Which rows the fit learns from, and which it scores."""
        *outer, (column, value) = [(frame[c].to_numpy(), v) for c, v in self.held]
        inside = np.ones(len(frame), bool)
        for other, own in outer:
            inside &= other != own
        return inside & (column != value), inside & (column == value)


@dataclass
class Fitted:
    """Means and spreads of the features where a fit learned, and intercept and coefficients of what they standardize."""

    middle: np.ndarray
    spread: np.ndarray
    beta: np.ndarray

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), (x - self.middle) / self.spread])

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.design(x) @ self.beta, -35, 35)))


def _summed(rows: DataFrame, features: Sequence[str], fits: Sequence[Fit], part: Callable[[int, np.ndarray, np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """For each fit, ``width`` sums over all rows it learns from: ``part`` of the fit's number, the features and the truths of a batch.

    All fits are added up in one pass. A task sends its own sums once, as many numbers as fits times
    ``width``, and Spark adds those of all tasks up.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(fits), width))
        for frame in frames:
            x, y = frame[list(features)].to_numpy(float), frame["truth"].to_numpy(bool)
            for k, fit in enumerate(fits):
                train, _ = fit.parts(frame)
                total[k] += part(k, x[train], y[train])
        yield pd.DataFrame({"at": np.arange(total.size), "value": total.ravel()})

    out = np.zeros(len(fits) * width)
    for at, value in rows.mapInPandas(run, "at bigint, value double").groupBy("at").agg(F.sum("value")).collect():
        out[at] = value
    return out.reshape(len(fits), width)


def ridge_fits(rows: DataFrame, features: Sequence[str], fits: Sequence[Fit], steps: int = 80) -> list[Fitted]:
    """All fits' class-balanced ridge logistic regressions on features standardized where each one learns; ``truth`` is boolean.

    One pass for means, one for spreads, then one for each Newton step, in which every fit that has not
    settled gets its gradient and Hessian as sums over the rows. No rows are moved or copied and no task
    holds a fold; the driver solves one small system a fit. Equal to ``ridge_logistic`` but for the order of sums.
    """
    d = len(features)
    sums = _summed(rows, features, fits, lambda k, x, y: np.concatenate(([len(x), y.sum()], x.sum(axis=0))), d + 2)
    counts, positives = np.maximum(sums[:, 0], 1), sums[:, 1]
    middle = sums[:, 2:] / counts[:, None]
    spread = np.sqrt(_summed(rows, features, fits, lambda k, x, y: ((x - middle[k]) ** 2).sum(axis=0), d) / counts[:, None])
    out = [Fitted(m, np.where(s > 0, s, 1.0), np.zeros(d + 1)) for m, s in zip(middle, spread, strict=True)]
    share = positives / counts
    weights = 0.5 / np.maximum(share, 1e-12), 0.5 / np.maximum(1 - share, 1e-12)
    left = list(range(len(fits)))
    for _ in range(steps):
        now = [(out[k], weights[0][k], weights[1][k]) for k in left]

        def part(i: int, x: np.ndarray, y: np.ndarray, now: list = now) -> np.ndarray:
            model, one, zero = now[i]
            design, weight = model.design(x), np.where(y, one, zero)
            p = 1 / (1 + np.exp(-np.clip(design @ model.beta, -35, 35)))
            return np.concatenate((design.T @ (weight * (y - p)), ((design * (weight * p * (1 - p))[:, None]).T @ design).ravel()))

        found = _summed(rows, features, [fits[k] for k in left], part, (d + 1) * (d + 2))
        moving = []
        for k, sums_ in zip(left, found, strict=True):
            penalty = np.full(d + 1, float(fits[k].ridge))
            penalty[0] = 0
            hessian = sums_[d + 1 :].reshape(d + 1, d + 1) + np.diag(penalty + 1e-12)
            step = np.linalg.solve(hessian, sums_[: d + 1] - penalty * out[k].beta)
            out[k].beta = out[k].beta + step
            if np.abs(step).max() >= 1e-10:
                moving.append(k)
        left = moving
        if not left:
            break
    return out


def _usable(rows: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Rows with a truth and all features, written once for the passes over them."""
    whole = F.col("truth").isNotNull()
    for name in features:
        whole = whole & F.col(name).isNotNull() & ~F.isnan(F.col(name).cast("double"))
    return stored(rows.where(whole).select(*keep, "truth", *[F.col(n).cast("double").alias(n) for n in features]), "ridge-rows")


def _held_out(rows: DataFrame, features: Sequence[str], fits: Sequence[Fit], models: Sequence[Fitted], key: str) -> DataFrame:
    """(fit, key, truth, score) of the rows that each fit scores."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = frame[list(features)].to_numpy(float)
            for k, (fit, model) in enumerate(zip(fits, models, strict=True)):
                _, test = fit.parts(frame)
                if test.any():
                    yield pd.DataFrame({"fit": k, key: frame[key][test], "truth": frame["truth"][test], "score": model.scores(x[test])})

    return rows.mapInPandas(run, f"fit int, `{key}` {dict(rows.dtypes)[key]}, truth boolean, score double")


def ridge_selected(rows: DataFrame, features: Sequence[str], grid: Sequence[float], fold: str, inner: str, folds: int, inner_folds: int, key: str = "case_id") -> DataFrame:
    """Each outer fold's ridge and threshold, chosen by inner out-of-fold scores: smaller rate, balanced accuracy, larger ridge, smaller threshold.

    Fits for every outer fold, inner fold and ridge go on at once, a pass over the rows for each Newton
    step. Rows without a truth or a feature take no part.
    """
    usable = _usable(rows, features, [key, fold, inner])
    fits = [Fit(float(r), ((fold, k), (inner, j))) for k in range(folds) for r in grid for j in range(inner_folds)]
    scores = _held_out(usable, features, fits, ridge_fits(usable, features, fits), key)
    number = F.floor(F.col("fit") / inner_folds).cast("int")
    ridge = F.element_at(F.array(*[F.lit(float(r)) for r in grid]), F.pmod(number, F.lit(len(grid))) + 1)
    placed = stored(scores.select(key, "truth", "score", F.floor(number / len(grid)).cast("int").alias("outer_fold"), ridge.alias("ridge")), "ridge-scores")
    found = calibrate.best_threshold(placed, "midpoints", ["outer_fold", "ridge"])
    best = F.max_by(F.struct("ridge", "threshold", "minimum_rate", "balanced_accuracy"), F.struct("minimum_rate", "balanced_accuracy", "ridge", (-F.col("threshold")).alias("o"))).alias("b")
    return found.groupBy("outer_fold").agg(best).select("outer_fold", "b.*")


def ridge_scores(rows: DataFrame, features: Sequence[str], ridge: float, fold: str, folds: int, key: str = "case_id") -> DataFrame:
    """Out-of-fold scores of a ridge logistic on standardized features: key, truth, part (the fold) and score; rows without a truth or a feature have none."""
    usable = _usable(rows, features, [key, fold])
    fits = [Fit(float(ridge), ((fold, k),)) for k in range(folds)]
    return _held_out(usable, features, fits, ridge_fits(usable, features, fits), key).select(key, "truth", F.col("fit").alias("part"), "score")


def nested_ridge(rows: DataFrame, features: Sequence[str], grid: Sequence[float], fold: str, inner: str, folds: int, inner_folds: int, key: str = "case_id") -> DataFrame:
    """Decisions of every row by the ridge and threshold that ``ridge_selected`` chooses for its outer fold: key, truth, outer_fold, ridge, score, threshold, predicted.

    The chosen ridges (a row an outer fold) say which fit each outer fold is scored by.
    """
    chosen = {r["outer_fold"]: r for r in ridge_selected(rows, features, grid, fold, inner, folds, inner_folds, key).collect()}
    usable = _usable(rows, features, [key, fold])
    parts = sorted(chosen)
    fits = [Fit(chosen[k]["ridge"], ((fold, k),)) for k in parts]
    scores = _held_out(usable, features, fits, ridge_fits(usable, features, fits), key)
    said = rows.sparkSession.createDataFrame([(i, k, float(chosen[k]["ridge"]), float(chosen[k]["threshold"])) for i, k in enumerate(parts)], "fit int, outer_fold int, ridge double, threshold double")
    return scores.join(F.broadcast(said), "fit").select(key, "truth", "outer_fold", "ridge", "score", "threshold", (F.col("score") >= F.col("threshold")).alias("predicted"))


def margin_scores(margins: DataFrame, fold: str, folds: int, ridge: float = 1.0, key: str = "case_id") -> DataFrame:
    """The meta model: out-of-fold scores of a ridge logistic on signed margins (``features``, an array of one length; rows without take no part)."""
    width = margins.where("features is not null").select(F.max(F.size("features"))).first()[0] or 0
    names = [f"m{k}" for k in range(width)]
    rows = margins.where("features is not null").select(key, fold, "truth", *[F.col("features")[k].alias(n) for k, n in enumerate(names)])
    return ridge_scores(rows, names, ridge, fold, folds, key)
