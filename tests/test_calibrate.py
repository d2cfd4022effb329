import random

import pytest
from pyspark.sql import functions as F

from verdigris.operators import calibrate, folds
from verdigris.operators.order import Scan, running_totals, scanned


def rows_of(spark, seed, n=60, levels=12):
    draw = random.Random(seed)
    data = [(i, draw.choice("xy"), draw.random() < 0.4, draw.randrange(levels) / levels) for i in range(n)]
    return data, spark.createDataFrame(data, "case_id int, g string, truth boolean, score double")


def rates(data, t):
    p, n = [s for *_, y, s in data if y], [s for *_, y, s in data if not y]
    return sum(s >= t for s in p) / len(p) if p else 0.0, sum(s < t for s in n) / len(n) if n else 0.0


def test_running_totals_over_many_ranges(spark):
    data = [(k % 3, float(k * k % 101), 1) for k in range(90)]
    want = {}
    for g in range(3):
        values = sorted({v for a, v, _ in data if a == g})
        for i, v in enumerate(values):
            want[g, v] = (sum(1 for a, w, _ in data if a == g and w < v), values[i + 1] if i + 1 < len(values) else None, i == 0)
    levels = spark.createDataFrame(data, "g int, v double, n int").groupBy("g", "v").count().withColumnRenamed("count", "n")
    got = {(r.g, r.v): (r.n_below, r.next_value, r.is_first) for r in running_totals(levels, ["g"], "v", ["n"], 7).collect()}
    assert got == want


def test_ecdf_is_the_mid_rank(spark):
    data, df = rows_of(spark, 1)
    got = {r.case_id: r.ecdf for r in calibrate.ecdf(df, "score", ["g"]).collect()}
    for i, g, _, s in data:
        peers = [x[3] for x in data if x[1] == g]
        assert abs(got[i] - (sum(p < s for p in peers) + 0.5 * sum(p == s for p in peers)) / len(peers)) < 1e-12


def test_ecdf_uses_reference_rows_only(spark):
    df = spark.createDataFrame([(1, 1.0, True), (2, 2.0, True), (3, 1.5, False), (4, None, False)], "case_id int, v double, ref boolean")
    got = {r.case_id: r.ecdf for r in calibrate.ecdf(df, "v", reference="ref").collect()}
    assert got == {1: 0.25, 2: 0.75, 3: 0.5, 4: None}


@pytest.mark.parametrize("seed", range(3))
def test_best_threshold_maximizes_the_smaller_rate(spark, seed):
    data, df = rows_of(spark, seed)
    scores = sorted({s for *_, s in data})
    candidates = [scores[0] - 1e-12, *[(a + b) / 2 for a, b in zip(scores, scores[1:])], scores[-1] + 1e-12]
    def order(t):
        a, b = rates(data, t)
        return (min(a, b), (a + b) / 2, -abs(a - b), -t)
    assert calibrate.best_threshold(df, "midpoints").first().threshold == max(candidates, key=order)


@pytest.mark.parametrize("seed", range(3))
def test_leave_one_out_equals_refitting(spark, seed):
    data, df = rows_of(spark, seed, 25, 9)
    got = {r.case_id: r.threshold for r in calibrate.leave_one_out_threshold(df).collect()}
    for i in range(len(data)):
        rest = data[:i] + data[i + 1 :]
        scores = sorted({s for *_, s in rest})
        candidates = [scores[0] - 1e-12, *[(a + b) / 2 for a, b in zip(scores, scores[1:])], scores[-1] + 1e-12]
        def order(t, rest=rest):
            a, b = rates(rest, t)
            return (min(a, b), (a + b) / 2, -abs(a - b), -t)
        assert got[i] == max(candidates, key=order)


def test_scans_equal_plain_windows(spark):
    draw = random.Random(4)
    data = [(g, v, draw.choice([None, draw.randrange(100)])) for g in ("a", "b", None) for v in draw.sample(range(1000), 120)]
    placed = running_totals(spark.createDataFrame(data, "g string, v int, x int"), ["g"], "v", ["x"], 9, keep_ranges=True)
    wanted = {f"{how}_{below}": Scan("x", how, below) for how in ("sum", "max", "min") for below in (True, False)}
    fold = {"sum": sum, "max": max, "min": min}
    for row in scanned(placed, ["g"], "v", wanted).collect():
        for alias, scan in wanted.items():
            others = [x for g, v, x in data if g == row.g and x is not None and (v < row.v if scan.below else v > row.v)]
            assert row[alias] == (fold[scan.how](others) if others else None)


def test_leave_one_out_spreads_one_group_over_tasks(spark):
    rows = spark.range(1_000_000).selectExpr("id as case_id", "(id * 7919) % 1000003 / 1000003.0D as score", "xxhash64(id) % 1000 < 400 + 200 * ((id * 7919) % 1000003 / 1000003.0D) as truth")
    found = calibrate.leave_one_out_threshold(rows)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("__range" in line for line in windows)
    parts = running_totals(rows.select("score", F.lit(1).alias("n")), [], "score", ["n"], keep_ranges=True).groupBy("__range").count()
    assert parts.count() == 64 and parts.agg(F.max("count")).first()[0] < 2 * 1_000_000 // 64
    best = calibrate.best_threshold(rows).first().threshold
    ends = found.agg(F.min("threshold"), F.max("threshold"), F.count("*"), F.count_if(F.col("predicted") != (F.col("score") >= best))).first()
    assert ends[0] <= best <= ends[1] and ends[2] == 1_000_000 and ends[3] < 100


@pytest.mark.parametrize("seed", range(3))
def test_leave_one_out_in_groups_with_repeats(spark, seed):
    data, df = rows_of(spark, 10 + seed, 40, 5 + 20 * seed)
    got = {r.case_id: r.threshold for r in calibrate.leave_one_out_threshold(df, ["g"]).collect()}
    for i, (_, g, *_) in enumerate(data):
        rest = [d for d in data[:i] + data[i + 1 :] if d[1] == g]
        scores = sorted({s for *_, s in rest})
        candidates = [scores[0] - 1e-12, *[(a + b) / 2 for a, b in zip(scores, scores[1:])], scores[-1] + 1e-12]
        def order(t, rest=rest):
            a, b = rates(rest, t)
            return (min(a, b), (a + b) / 2, -abs(a - b), -t)
        assert got[i] == max(candidates, key=order)


def test_one_row_has_a_threshold(spark):
    row = calibrate.best_threshold(spark.createDataFrame([(True, 0.3)], "truth boolean, score double")).first()
    assert row.sensitivity == 1.0 and row.specificity == 0.0


def test_hash_folds_are_even_inside_labels(spark):
    rows = spark.createDataFrame([(f"c{i}", "POSITIVE" if i % 4 else "NEGATIVE") for i in range(100)], "case_id string, label string")
    dealt = folds.hash_folds(rows, 5, 1, 2)
    counts = dealt.groupBy("repeat", "label", "fold").count().collect()
    assert len(counts) == 20 and {r["count"] for r in counts if r.label == "NEGATIVE"} == {5}
    assert dealt.exceptAll(folds.hash_folds(rows.orderBy("label"), 5, 1, 2)).isEmpty()


def test_group_folds_keep_groups_together(spark):
    rows = spark.createDataFrame([(f"c{i}", f"g{i // 2}", "POSITIVE" if i // 2 % 2 else "NEGATIVE") for i in range(80)], "case_id string, patient_group_id string, label string")
    dealt = folds.group_hash_folds(rows, 4, 5)
    assert folds.split_violations(dealt, 4).isEmpty()
    nested = folds.nested_group_folds(rows, 5, 4, 7)
    assert nested.where("role = 'test'").count() == 40 and nested.groupBy("outer_fold", "group_id").count().where("count > 1").isEmpty()
    broken = dealt.withColumn("fold", dealt.fold * 0)
    assert {r.rule for r in folds.split_violations(broken, 4).collect()} == {"fold_without_cases"}


def test_conflicting_group_is_refused(spark):
    rows = spark.createDataFrame([("a", "g", "POSITIVE"), ("b", "g", "NEGATIVE")], "case_id string, patient_group_id string, label string")
    with pytest.raises(ValueError):
        folds.nested_group_folds(rows, 2, 2, 1)


def test_margins_follow_the_policy(spark):
    rows = spark.createDataFrame([("s1", 1, 0.7, 0.5, False), ("s2", 1, 0.1, 0.5, True), ("s1", 2, None, 0.5, False)], "signal string, case_id int, score double, threshold double, technical_failure boolean")
    get = lambda policy: {r.case_id: r.features for r in calibrate.margin_features(rows, ["s1", "s2"], policy).collect()}
    assert get("fail_case") == {1: None, 2: None}
    assert [round(x, 9) for x in get("zero_margin_with_indicator")[1]] == [0.2, 0.0, 0.0, 1.0] and get("zero_margin")[2] is None


def greedy(sizes, n_folds):
    """(fold of each group): groups in their order, each to the fold with the fewest cases of its label, the fewest cases, the first."""
    own, whole, out = {}, [0] * n_folds, []
    for label, size in sizes:
        mine = own.setdefault(label, [0] * n_folds)
        fold = min(range(n_folds), key=lambda f: (mine[f], whole[f], f))
        mine[fold] += size
        whole[fold] += size
        out.append(fold)
    return out


@pytest.mark.parametrize("seed", range(40))
def test_rounds_equal_a_greedy_deal(seed):
    draw = random.Random(seed)
    n_folds = draw.randrange(2, 7)
    sizes = sorted(((draw.choice("ab"), draw.choice([1, 1, 2, 3, 5, 40, draw.randrange(1, 30)])) for _ in range(draw.randrange(1, 150))), key=lambda g: (-g[1], g[0]))
    counts = {}
    for g in sizes:
        counts[g] = counts.get(g, 0) + 1
    got = []
    for label, size, rounds in folds.greedy_rounds([(label, size, n) for (label, size), n in counts.items()], n_folds):
        for place in range(counts[label, size]):
            begin, ring = [r for r in rounds if r[0] <= place][-1]
            got.append(ring[(place - begin) % len(ring)])
    assert got == greedy(sizes, n_folds)


def test_a_billion_groups_are_dealt_at_once():
    (_, _, first), (_, _, rest) = folds.greedy_rounds([("a", 1000, 1), ("a", 1, 10**9)], 3)
    assert first == [(0, [0])] and len(rest) == 3 and rest[-1] == (2000, [0, 1, 2])


def test_groups_of_unequal_sizes_are_balanced(spark):
    rows = [(f"c{g}-{i}", f"g{g}", "x") for g, n in enumerate((5, 3, 3, 1)) for i in range(n)]
    dealt = folds.group_hash_folds(spark.createDataFrame(rows, "case_id string, patient_group_id string, label string"), 2, 3)
    assert sorted(r["count"] for r in dealt.groupBy("fold").count().collect()) == [6, 6]
    assert folds.split_violations(dealt, 2).isEmpty()


def test_labels_need_a_group_in_every_inner_fold(spark):
    rows = spark.createDataFrame([(f"c{i}", f"g{i}", "POSITIVE" if i < 5 else "NEGATIVE") for i in range(30)], "case_id string, patient_group_id string, label string")
    assert folds.nested_group_folds(rows, 5, 4, 1).where("role = 'test'").count() == 30
    with pytest.raises(ValueError, match="every fold"):
        folds.nested_group_folds(rows, 5, 5, 1)
