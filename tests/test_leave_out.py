import random

import pytest
from pyspark.sql import functions as F

from verdigris.operators import leave_out


def ecdf(value, reference):
    return (sum(x < value for x in reference) + 0.5 * sum(x == value for x in reference)) / len(reference)


def fused(train, row, weights):
    total = 0.0
    for k, w in enumerate(weights):
        total = total + w * ecdf(row[k], [t[k] for t in train])
    return total


def rates(scores, truths, t):
    p, n = [s for s, y in zip(scores, truths) if y], [s for s, y in zip(scores, truths) if not y]
    return sum(s >= t for s in p) / len(p), sum(s < t for s in n) / len(n)


def best(train, weights):
    scores, truths = [fused(train, t, weights) for t in train], [t[-1] for t in train]
    levels = sorted(set(scores))
    def order(t):
        a, b = rates(scores, truths, t)
        return (min(a, b), (a + b) / 2, -abs(a - b), -t)
    return max([levels[0] - 1e-12, *[(a + b) / 2 for a, b in zip(levels, levels[1:])], levels[-1] + 1e-12], key=order)


def cohort(seed, n, levels, lift):
    draw = random.Random(seed)
    rows = []
    for _ in range(n):
        y = draw.random() < 0.45
        rows.append(tuple(draw.randrange(levels) / levels + lift * y for _ in range(3)) + (y,))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "case_id int, a double, b double, c double, truth boolean")


@pytest.mark.parametrize(("seed", "levels", "lift"), [(0, 1000, 0.1), (1, 6, 0.2), (2, 1, 0.0), (3, 1000, 2.0), (4, 30, -0.5)])
def test_fusion_equals_refitting(spark, seed, levels, lift):
    rows = cohort(seed, 60, levels, lift)
    weights = {"a": 0.5, "b": 0.3, "c": 0.2}
    got = {r.case_id: (r.fused, r.threshold, r.predicted) for r in leave_out.leave_one_out_fusion(frame(spark, rows), weights).collect()}
    for i, row in enumerate(rows):
        rest = rows[:i] + rows[i + 1 :]
        t, s = best(rest, weights.values()), fused(rest, row, weights.values())
        assert got[i] == (s, t, s >= t), i


@pytest.mark.parametrize(("seed", "levels", "lift"), [(5, 1000, 0.1), (6, 5, 0.2)])
def test_nested_equals_refitting(spark, seed, levels, lift):
    rows, grid = [(a, b, 0.0, y) for a, b, _, y in cohort(seed, 24, levels, lift)], [0.0, 0.1, 0.25]
    got = {r.case_id: (r.w, r.fused, r.threshold) for r in leave_out.nested_leave_one_out(frame(spark, rows), "a", "b", grid).collect()}
    for i, row in enumerate(rows):
        rest = rows[:i] + rows[i + 1 :]
        def order(w, rest=rest):
            pair = (1 - w, w)
            said = []
            for j, mine in enumerate(rest):
                inside = rest[:j] + rest[j + 1 :]
                said.append(fused(inside, mine, pair) >= best(inside, pair))
            p, n = sum(r[-1] for r in rest), sum(not r[-1] for r in rest)
            sens, spec = sum(s and r[-1] for s, r in zip(said, rest)) / p, sum(not s and not r[-1] for s, r in zip(said, rest)) / n
            return (min(sens, spec), (sens + spec) / 2, sens, -w)
        w = max(grid, key=order)
        assert got[i] == (w, fused(rest, row, (1 - w, w)), best(rest, (1 - w, w))), i


def test_band_is_small_and_rows_are_many(spark, monkeypatch):
    monkeypatch.setattr(leave_out, "MOST_BAND_ROWS", 4000)
    rows = spark.range(100_000).selectExpr("id as case_id", "(id * 7919) % 100003 / 100003.0D as a", "(id * 104729) % 100003 / 100003.0D as b", "xxhash64(id) % 1000 < 1000 * ((id * 7919) % 100003 / 100003.0D) - 500 as truth")
    row = leave_out.leave_one_out_fusion(rows, {"a": 0.75, "b": 0.25}).agg(F.count("threshold"), F.min("threshold"), F.max("threshold")).first()
    assert row[0] == 100_000 and row[2] - row[1] < 0.01


def test_cases(spark):
    rows = [("x", 1.0, True), ("x", 2.0, False), ("x", None, True), ("x", 3.0, None), ("y", 1.0, True), ("y", 1.0, True), ("y", 0.0, False), ("y", 0.0, False), ("y", float("nan"), False), (None, 1.0, True)]
    df = spark.createDataFrame(rows, "g string, a double, truth boolean")
    got = leave_out.leave_one_out_fusion(df, {"a": 1.0}, ["g"])
    assert got.columns == ["g", "a", "truth", "fused", "threshold", "predicted"] and got.count() == len(rows)
    assert sorted(tuple(r) for r in got.where("threshold is not null").select("a", "truth", "predicted").collect()) == [(0.0, False, False)] * 2 + [(1.0, True, True)] * 2
    assert leave_out.leave_one_out_fusion(df.limit(0), {"a": 1.0}).count() == 0
    with pytest.raises(ValueError, match="negative"):
        leave_out.leave_one_out_fusion(df, {"a": -1.0})
    with pytest.raises(ValueError, match="between"):
        leave_out.nested_leave_one_out(df, "a", "a", [1.5])
