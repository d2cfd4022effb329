import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.operators import calibrate, models


def cohort(n, seed):
    draw = np.random.default_rng(seed)
    y = draw.random(n) < 0.4
    x = draw.normal(size=(n, 3)) * [1, 5, 0.1] + y[:, None] * [0.8, -2, 0.0]
    return x, y, draw.integers(0, 4, n), draw.integers(0, 3, n)


def frame(spark, x, y, fold, inner):
    return spark.createDataFrame([(i, *map(float, r), bool(t), int(a), int(b)) for i, (r, t, a, b) in enumerate(zip(x, y, fold, inner))], "case_id int, a double, b double, c double, truth boolean, fold int, inner_fold int").repartition(5)


def alone(x, y, ridge):
    middle, spread = x.mean(axis=0), x.std(axis=0)
    return middle, spread, models.ridge_logistic((x - middle) / spread, y.astype(float), ridge)


def predicted(model, x):
    middle, spread, beta = model
    return 1 / (1 + np.exp(-np.clip(np.column_stack([np.ones(len(x)), (x - middle) / spread]) @ beta, -35, 35)))


def best(scores, truths):
    levels = sorted(set(scores))
    def order(t):
        a, b = (scores[truths] >= t).mean(), (scores[~truths] < t).mean()
        return (min(a, b), (a + b) / 2, -abs(a - b), -t)
    t = max([levels[0] - 1e-12, *[(a + b) / 2 for a, b in zip(levels, levels[1:])], levels[-1] + 1e-12], key=order)
    return t, order(t)


def test_summed_fits_equal_whole_fits(spark):
    x, y, fold, inner = cohort(300, 1)
    df = frame(spark, x, y, fold, inner)
    fits = [models.Fit(r, held) for r in (0.0, 0.5, 50.0) for held in ((("fold", 1),), (("fold", 2), ("inner_fold", 0)))]
    for fit, got in zip(fits, models.ridge_fits(df, ["a", "b", "c"], fits), strict=True):
        train = np.all([{"fold": fold, "inner_fold": inner}[c] != v for c, v in fit.held], axis=0)
        middle, spread, beta = alone(x[train], y[train], fit.ridge)
        assert np.allclose(got.middle, middle, atol=1e-10) and np.allclose(got.spread, spread, atol=1e-10) and np.allclose(got.beta, beta, atol=1e-8)


def test_out_of_fold_scores_equal_refitting(spark):
    x, y, fold, inner = cohort(200, 2)
    df = frame(spark, x, y, fold, inner).withColumn("a", F.when(F.col("case_id") != 7, F.col("a")))
    kept = np.arange(200) != 7
    got = {r.case_id: (r.part, r.score) for r in models.ridge_scores(df, ["a", "b", "c"], 1.0, "fold", 4).collect()}
    assert sorted(got) == [i for i in range(200) if i != 7]
    for k in range(4):
        model = alone(x[(fold != k) & kept], y[(fold != k) & kept], 1.0)
        for i in np.flatnonzero((fold == k) & kept):
            assert got[i][0] == k and abs(got[i][1] - predicted(model, x[i : i + 1])[0]) < 1e-8


def test_nested_choice_equals_refitting(spark):
    x, y, fold, inner = cohort(160, 3)
    grid = [0.01, 1.0, 100.0]
    got = {r.case_id: (r.ridge, r.score, r.threshold) for r in models.nested_ridge(frame(spark, x, y, fold, inner), ["a", "b", "c"], grid, "fold", "inner_fold", 4, 3).collect()}
    assert len(got) == 160
    for k in range(4):
        found = []
        for ridge in grid:
            scores, truths = [], []
            for j in range(3):
                train, test = (fold != k) & (inner != j), (fold != k) & (inner == j)
                scores += list(predicted(alone(x[train], y[train], ridge), x[test]))
                truths += list(y[test])
            t, order = best(np.array(scores), np.array(truths))
            found.append(((order[0], order[1], ridge), t))
        (_, _, ridge), threshold = max(found)
        model = alone(x[fold != k], y[fold != k], ridge)
        for i in np.flatnonzero(fold == k):
            assert got[i][0] == ridge and abs(got[i][2] - threshold) < 1e-8 and abs(got[i][1] - predicted(model, x[i : i + 1])[0]) < 1e-8


def test_no_task_holds_a_fold(spark):
    x, y, fold, inner = cohort(50, 4)
    plan = models.ridge_scores(frame(spark, x, y, fold, inner), ["a", "b"], 1.0, "fold", 4)._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" in plan and "FlatMapGroups" not in plan and "Exchange" not in plan


def test_margins_and_empty_rows(spark):
    rows = spark.createDataFrame([(i, i % 3, i % 2 == 0, [float(i % 5), float(i % 2)] if i % 7 else None) for i in range(60)], "case_id int, fold int, truth boolean, features array<double>")
    got = models.margin_scores(rows, "fold", 3)
    assert got.count() == 51 and calibrate.best_threshold(got).first().minimum_rate == 1.0
    assert models.ridge_scores(rows.limit(0).withColumn("m", F.lit(1.0)), ["m"], 1.0, "fold", 3).count() == 0
