import hashlib
import random

import pytest
from pyspark.sql import functions as F

from verdigris.functions.numbers import wilson
from verdigris.operators import metrics

CASES = "case_id string, truth string, prediction string, status string, tags array<string>, negative_subtype string, positive_subtype string"


@pytest.fixture(scope="module")
def cases(spark):
    """Four cases of each truth; one right in each group."""
    rows = [
        ("p1", "positive", "POSITIVA", "decisive", ["a", "b", "a"], None, "hcc"),
        ("p2", "positive", "NEGATIVA", "decisive", ["a"], None, None),
        ("p3", "positive", "INCONCLUSIVA", "inconclusive", [], None, "hcc"),
        ("p4", "positive", None, "timeout", None, None, "hcc"),
        ("n1", "negative", "NEGATIVA", "decisive", ["b"], "normal", None),
        ("n2", "negative", "POSITIVA", "decisive", ["a"], "normal", None),
        ("n3", "negative", None, "failure", [], "", None),
        ("n4", "negative", None, "invalid_response", ["b"], None, None),
    ]
    return spark.createDataFrame(rows, CASES)


def test_everything_that_is_not_right_counts_against_its_group(cases):
    row = metrics.primary_metrics(cases).first()
    assert (row.tp, row.tn, row.fp, row.fn) == (1, 1, 3, 3)
    assert row.sensitivity == row.specificity == row.accuracy == 0.25
    assert row.coverage_rate == 0.5 and row.failed_cases == 3 and not row.gate_passed


def test_empty_cohort_has_null_rates_and_reasons(cases):
    row = metrics.undefined_reasons(metrics.primary_metrics(cases.limit(0))).first()
    assert row.total_cases == 0 and row.sensitivity is None and row.sensitivity_low is None
    assert set(row.undefined) == {"sensitivity", "specificity", "precision", "decisions_only"}


def test_decisions_only_leaves_out_what_was_not_decided(cases):
    row = metrics.decisions_only(cases).first()
    assert (row.total_cases, row.tp, row.tn, row.fp, row.fn) == (4, 1, 1, 1, 1) and row.accuracy == 0.5


def test_categorical_confusion_has_both_truths(cases):
    rows = {r.truth: r for r in metrics.categorical_confusion(cases.where("truth = 'positive'")).collect()}
    assert rows["negative"].POSITIVA == 0 and rows["positive"].TIMEOUT == 1 and rows["positive"].INCONCLUSIVA == 1


def test_tags_overlap_and_count_once_a_case(cases):
    rows = {r.tag: r for r in metrics.tag_metrics(cases).collect()}
    assert rows["a"].total == 3 and rows["b"].total == 3
    assert rows["a"].sensitivity_on_tagged_positives == 0.5 and rows["b"].specificity_on_tagged_negatives == 0.5


def test_subtypes_without_name_are_unspecified(cases):
    rows = {r.subtype: r for r in metrics.subtype_metrics(cases, "negative", "negative_subtype").collect()}
    assert rows["normal"].specificity == 0.5 and rows["unspecified"].total == 2 and rows["unspecified"].failure_rate == 1.0


def test_wilson_bounds(spark):
    row = spark.range(1).select(wilson(F.lit(5), F.lit(10)).alias("w"), wilson(F.lit(0), F.lit(0)).alias("n"), wilson(F.lit(0), F.lit(0), None, 0.0).alias("z")).first()
    assert round(row.w.low, 4) == 0.2366 and round(row.w.high, 4) == 0.7634
    assert row.n.low is None and row.z.low == 0.0
    with pytest.raises(ValueError):
        wilson(F.lit(1), F.lit(2), 1.5)


@pytest.mark.parametrize("seed", range(4))
def test_auc_is_the_share_of_won_pairs(spark, seed):
    draw = random.Random(seed)
    rows = [(draw.choice("xy"), draw.random() < 0.4, draw.choice([None, *[k / 8 for k in range(9)]])) for _ in range(120)]
    found = {r.g: r.auc for r in metrics.roc_auc(spark.createDataFrame(rows, "g string, positive boolean, score double"), ["g"]).collect()}
    for g in "xy":
        p = [s for a, b, s in rows if a == g and b and s is not None]
        n = [s for a, b, s in rows if a == g and not b and s is not None]
        assert abs(found[g] - sum((x > y) + 0.5 * (x == y) for x in p for y in n) / (len(p) * len(n))) < 1e-12


def test_auc_without_a_class_is_null(spark):
    rows = spark.createDataFrame([(True, 0.1), (True, 0.2)], "positive boolean, score double")
    assert metrics.roc_auc(rows).first().auc is None


def test_technical_failure_is_an_error_of_its_label(spark):
    rows = spark.createDataFrame([("a", "POSITIVE", "POSITIVE", True), ("b", "NEGATIVE", "NEGATIVE", False), ("c", "NEGATIVE", None, None)], "case_id string, label string, prediction string, technical_failure boolean")
    row = metrics.robustness_metrics(rows).first()
    assert (row.tp, row.tn, row.fp, row.fn, row.technical_failures) == (0, 1, 1, 1, 1) and row.sensitivity == 0.0


def test_multiclass_counts_undetermined_as_error(spark):
    classes = ("a", "b", "c", "d")
    rows = [("a", "decisive", True, "a"), ("a", "decisive", True, "a"), ("b", "decisive", True, "b"), ("b", "failure", True, "b"), ("c", "decisive", True, "c"), ("c", "decisive", True, "c"), ("d", "decisive", True, "d"), ("d", "decisive", True, "d")]
    df = spark.createDataFrame(rows, "truth string, status string, determined boolean, subtype string")
    df = df.withColumn("predicted", metrics.scored_subtype(F.col("status"), F.col("determined"), F.col("subtype"), classes))
    row = metrics.multiclass_metrics(df, classes).first()
    assert row.top1_accuracy == 0.875 and row.balanced_accuracy == 0.875 and row.gate_met
    assert not metrics.multiclass_metrics(df.where("truth <> 'd'"), classes).first().gate_met


def test_bootstrap_is_repeatable_and_brackets_the_rate(spark):
    rows = spark.createDataFrame([(f"g{i % 12}", "POSITIVE" if i % 3 else "NEGATIVE", "POSITIVE" if i % 3 and i % 5 else "NEGATIVE", False) for i in range(120)], "patient_group_id string, label string, prediction string, technical_failure boolean")
    a, b = (metrics.resampled_interval(rows, "patient_group_id", 100, 3).first() for _ in range(2))
    rate = metrics.robustness_metrics(rows).first().sensitivity
    assert a == b and a.sensitivity_low <= rate <= a.sensitivity_high


@pytest.mark.parametrize("strata", [1, 3])
def test_resamples_draw_as_many_rows_as_there_are(spark, strata):
    rng = random.Random(strata)
    rows = [(f"k{i}", f"s{i % strata}" if i % 7 else None, rng.randint(0, 3), rng.randint(0, 60), rng.randint(0, 1)) for i in range(400)]
    cells = spark.createDataFrame(rows, "key string, s string, a long, b long, c long")
    got = {r.resample: (r.drawn, r.a, r.b, r.c) for r in metrics.resampled_counts(cells, ["key"], ["a", "b", "c"], F.col("s"), 40, 9).collect()}
    ranked = {}
    for key, s, *counts in sorted(rows, key=lambda r: r[2:]):
        ranked.setdefault(s or "", []).append(counts)
    for resample in range(40):
        want = [0, 0, 0, 0]
        for key, s, *_ in rows:
            own = ranked[s or ""]
            drawn = own[int(hashlib.sha256(f"9|{resample}|{key}".encode()).hexdigest()[:12], 16) % len(own)]
            want = [want[0] + 1, *(x + y for x, y in zip(want[1:], drawn, strict=True))]
        assert got[resample] == tuple(want) and want[0] == len(rows)
    assert len(got) == 40


def test_bootstrap_draws_are_added_up_where_they_are_made(spark):
    rows = [(f"k{i}" if i else None, "ab"[i % 2], i % 3, i % 5) for i in range(90)]
    cells = spark.createDataFrame(rows, "key string, s string, a long, b long")
    one, other = (metrics.resampled_counts(cells, ["key", "s"], ["a", "b"], F.col("s"), 30, 4, most) for most in (metrics.MOST_KINDS, 3))
    assert sorted(one.collect()) == sorted(other.collect()) and one.count() == 30
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (one, other)]
    assert "Generate" not in plans[0] and "Join" not in plans[0] and "Generate" in plans[1]
