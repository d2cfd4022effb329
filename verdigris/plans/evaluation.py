"""Queries of the evaluation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import ranked_classes, wilson
from ..operators import metrics
from .base import COHORT, PREDICTIONS, cohort, predictions, query, table

Z = "1.9599639845400536"


def _wilson(k: str, n: str, end: str, z: str = Z) -> str:
    """SQL of one end of the interval."""
    sign = "-" if end == "low" else "+"
    p = f"({k})::double / nullif({n}, 0)"
    value = f"(({p} + {z} * {z} / (2 * nullif({n}, 0))) {sign} {z} * sqrt({p} * (1 - {p}) / nullif({n}, 0) + {z} * {z} / (4 * nullif({n}, 0) * nullif({n}, 0)))) / (1 + {z} * {z} / nullif({n}, 0))"
    return f"case when {n} > 0 then round({'greatest(0.0, ' if end == 'low' else 'least(1.0, '}{value}), 9) end"


def _ends(report: DataFrame) -> DataFrame:
    """Interval ends to nine decimals: at the limits their last bits depend on the order of operations."""
    return report.withColumns({c: F.round(c, 9) for c in report.columns if c.endswith(("low", "high", "low80", "high80"))})


def _interval(name: str, k: str, n: str) -> str:
    return f"{_wilson(k, n, 'low')} as {name}_low, {_wilson(k, n, 'high')} as {name}_high"


_PRIMARY = f"""
with {COHORT}, counts as (
  select dataset_id, count(*) as total_cases, count(*) filter (truth = 'positive') as positive_cases, count(*) filter (truth = 'negative') as negative_cases,
         count(*) filter (truth = 'positive' and prediction = 'POSITIVA') as tp, count(*) filter (truth = 'negative' and prediction = 'NEGATIVA') as tn,
         count(*) filter (status = 'decisive' and prediction in ('POSITIVA', 'NEGATIVA')) as decisive_cases,
         count(*) filter (status = 'inconclusive') as inconclusive_count, count(*) filter (status = 'failure') as failure_count,
         count(*) filter (status = 'timeout') as timeout_count, count(*) filter (status = 'invalid_response') as invalid_response_count
  from cohort group by rollup(dataset_id)
), errors as (select *, positive_cases - tp as fn, negative_cases - tn as fp, failure_count + timeout_count + invalid_response_count as failed_cases from counts)
select *, total_cases - failed_cases as completed_reports, (total_cases - failed_cases) / nullif(total_cases, 0) as completion_rate,
       decisive_cases / nullif(total_cases, 0) as coverage_rate, inconclusive_count / nullif(total_cases, 0) as inconclusive_rate, failed_cases / nullif(total_cases, 0) as failure_rate,
       (tp + tn) / nullif(total_cases, 0) as accuracy, tp / nullif(positive_cases, 0) as sensitivity, tn / nullif(negative_cases, 0) as specificity,
       tp / nullif(tp + fp, 0) as precision, 2 * tp / nullif(2 * tp + fp + fn, 0) as f1_score,
       {_interval('accuracy', 'tp + tn', 'total_cases')}, {_interval('sensitivity', 'tp', 'positive_cases')}, {_interval('specificity', 'tn', 'negative_cases')},
       {_interval('precision', 'tp', '(tp + fp)')}, {_interval('coverage', 'decisive_cases', 'total_cases')},
       coalesce(round(tp / nullif(positive_cases, 0), 4) >= 0.75 and round(tn / nullif(negative_cases, 0), 4) >= 0.75, false) as gate_passed
from errors
"""


@query(_PRIMARY)
def cohort_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the penalized report of every dataset and of the whole cohort."""
    return _ends(metrics.primary_metrics(cohort(spark, sf_dir), ["dataset_id"], overall=True))


@query(f"""
with {COHORT}, made as (select * from cohort where status = 'decisive' and prediction in ('POSITIVA', 'NEGATIVA')), counts as (
  select dataset_id, count(*) as total_cases, count(*) filter (truth = 'positive' and prediction = 'POSITIVA') as tp, count(*) filter (truth = 'negative' and prediction = 'NEGATIVA') as tn,
         count(*) filter (truth = 'negative' and prediction = 'POSITIVA') as fp, count(*) filter (truth = 'positive' and prediction = 'NEGATIVA') as fn from made group by rollup(dataset_id)
)
select *, (tp + tn) / nullif(total_cases, 0) as accuracy, tp / nullif(tp + fn, 0) as sensitivity, tn / nullif(tn + fp, 0) as specificity, tp / nullif(tp + fp, 0) as precision,
       2 * tp / nullif(2 * tp + fp + fn, 0) as f1_score from counts
""")
def decisions_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.decisions_only(cohort(spark, sf_dir), ["dataset_id"], overall=True)


@query(f"""
with {COHORT}
select truth, count(*) filter (prediction = 'POSITIVA') as POSITIVA, count(*) filter (prediction = 'NEGATIVA') as NEGATIVA, count(*) filter (status = 'inconclusive') as INCONCLUSIVA,
       count(*) filter (status = 'failure') as FAILURE, count(*) filter (status = 'timeout') as TIMEOUT, count(*) filter (status = 'invalid_response') as INVALID_RESPONSE
from cohort group by truth
""")
def categorical_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.categorical_confusion(cohort(spark, sf_dir))


_TERMINAL = "count(*) filter (prediction = 'POSITIVA') as positive_predictions, count(*) filter (prediction = 'NEGATIVA') as negative_predictions, count(*) filter (status = 'inconclusive') as inconclusive, count(*) filter (status = 'failure') as failure, count(*) filter (status = 'timeout') as timeout, count(*) filter (status = 'invalid_response') as invalid_response"


@query(f"with {COHORT} select patient_group_id, {_TERMINAL} from cohort group by 1")
def terminal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort(spark, sf_dir).groupBy("patient_group_id").agg(*metrics.terminal_counts())


@query(f"""
with {COHORT}, counts as (select coalesce(negative_subtype, 'unspecified') as subtype, count(*) as total, count(*) filter (prediction = 'NEGATIVA') as true_negatives, {_TERMINAL} from cohort where truth = 'negative' group by 1)
select *, total - true_negatives as false_positives_penalized, true_negatives / total as specificity, positive_predictions / total as positive_prediction_rate,
       inconclusive / total as inconclusive_rate, (failure + timeout + invalid_response) / total as failure_rate from counts
""")
def negative_subtypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.subtype_metrics(cohort(spark, sf_dir), "negative", "negative_subtype")


@query(f"""
with {COHORT}, counts as (select coalesce(positive_subtype, 'unspecified') as subtype, count(*) as total, count(*) filter (prediction = 'POSITIVA') as true_positives, {_TERMINAL} from cohort where truth = 'positive' group by 1)
select *, total - true_positives as false_negatives_penalized, true_positives / total as sensitivity, negative_predictions / total as negative_prediction_rate,
       inconclusive / total as inconclusive_rate, (failure + timeout + invalid_response) / total as failure_rate from counts
""")
def positive_subtypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.subtype_metrics(cohort(spark, sf_dir), "positive", "positive_subtype")


@query(f"""
with {COHORT}, rows as (select *, unnest(list_distinct(tags)) as tag from cohort), counts as (
  select tag, count(*) as total, count(*) filter (truth = 'negative') as negative_cases, count(*) filter (truth = 'positive') as positive_cases, {_TERMINAL},
         count(*) filter (truth = 'negative' and prediction = 'NEGATIVA') as tn, count(*) filter (truth = 'positive' and prediction = 'POSITIVA') as tp from rows group by 1)
select * exclude (tn, tp), tn / nullif(negative_cases, 0) as specificity_on_tagged_negatives, tp / nullif(positive_cases, 0) as sensitivity_on_tagged_positives,
       positive_predictions / total as positive_prediction_rate, inconclusive / total as inconclusive_rate from counts
""")
def tag_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.tag_metrics(cohort(spark, sf_dir))


@query(f"""
with {COHORT}, counts as (select patient_group_id, count(*) as total_cases, count(*) filter (truth = 'positive') as p, count(*) filter (truth = 'negative') as n,
  count(*) filter (truth = 'positive' and prediction = 'POSITIVA') as tp, count(*) filter (truth = 'negative' and prediction = 'NEGATIVA') as tn, count(*) filter (status = 'decisive' and prediction in ('POSITIVA', 'NEGATIVA')) as d from cohort group by 1)
select patient_group_id, array_to_string(list_sort(list_filter([case when p = 0 then 'sensitivity=no_positive_cases' end, case when n = 0 then 'specificity=no_negative_cases' end,
  case when tp + n - tn = 0 then 'precision=no_penalized_positive_predictions' end, case when d = 0 then 'decisions_only=no_binary_decisions' end], lambda x: x is not null)), ';') as undefined from counts
""")
def undefined_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = metrics.undefined_reasons(metrics.primary_metrics(cohort(spark, sf_dir), ["patient_group_id"]))
    pairs = F.array_sort(F.transform(F.map_entries("undefined"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return report.select("patient_group_id", F.array_join(pairs, ";").alias("undefined"))


@query(f"""
with {COHORT}, counts as (select patient_group_id, count(*) as n, count(*) filter (prediction = 'NEGATIVA') as k from cohort group by 1)
select patient_group_id, n, k, {_wilson('k', 'n', 'low')} as low, {_wilson('k', 'n', 'high')} as high, {_wilson('k', 'n', 'low', '1.2815515655446006')} as low80, {_wilson('k', 'n', 'high', '1.2815515655446006')} as high80 from counts
""")
def wilson_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = cohort(spark, sf_dir).groupBy("patient_group_id").agg(F.count("*").alias("n"), F.count_if(F.col("prediction") == "NEGATIVA").alias("k"))
    a, b = wilson(F.col("k"), F.col("n")), wilson(F.col("k"), F.col("n"), 0.8)
    return _ends(counts.select("patient_group_id", "n", "k", a["low"].alias("low"), a["high"].alias("high"), b["low"].alias("low80"), b["high"].alias("high80")))




@query(f"""
with {COHORT}, pairs as (
  select a.dataset_id, sum(case when a.score > b.score then 1.0 when a.score = b.score then 0.5 else 0.0 end)::double as wins
  from cohort a join cohort b on a.truth = 'positive' and b.truth = 'negative' and a.dataset_id = b.dataset_id group by 1
), sizes as (select dataset_id, count(*) filter (truth = 'positive') as positives, count(*) filter (truth = 'negative') as negatives from cohort group by 1)
select dataset_id, positives, negatives, wins / nullif(positives * negatives, 0) as auc from sizes left join pairs using (dataset_id)
""")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roc_auc(cohort(spark, sf_dir).withColumn("positive", F.col("truth") == "positive"), ["dataset_id"])


@query(f"""
with {COHORT}, pairs as (
  select sum(case when a.score > b.score then 1.0 when a.score = b.score then 0.5 else 0.0 end)::double as wins from cohort a join cohort b on a.truth = 'positive' and b.truth = 'negative'
), sizes as (select count(*) filter (truth = 'positive') as positives, count(*) filter (truth = 'negative') as negatives from cohort)
select positives, negatives, wins / nullif(positives * negatives, 0) as auc from sizes, pairs
""")
def roc_auc_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roc_auc(cohort(spark, sf_dir).withColumn("positive", F.col("truth") == "positive"))


def _robust(by: str, rows: str = "predictions") -> str:
    z = "1.959963984540054"
    return f"""counted as (
  select {by}, count(*) as case_count, count(*) filter (label = 'POSITIVE' and not technical_failure and said = 'POSITIVE') as tp, count(*) filter (label = 'NEGATIVE' and not technical_failure and said = 'NEGATIVE') as tn,
         count(*) filter (label = 'POSITIVE') as p, count(*) filter (label = 'NEGATIVE') as n, count(*) filter (technical_failure) as technical_failures from {rows} group by all
), robust as (
  select * exclude (p, n), n - tn as fp, p - tp as fn, coalesce(tp / nullif(p, 0), 0.0) as sensitivity, coalesce(tn / nullif(n, 0), 0.0) as specificity,
         coalesce({_wilson('tp', 'p', 'low', z)}, 0.0) as sensitivity_low, coalesce({_wilson('tp', 'p', 'high', z)}, 0.0) as sensitivity_high,
         coalesce({_wilson('tn', 'n', 'low', z)}, 0.0) as specificity_low, coalesce({_wilson('tn', 'n', 'high', z)}, 0.0) as specificity_high,
         (coalesce(tp / nullif(p, 0), 0.0) + coalesce(tn / nullif(n, 0), 0.0)) / 2 as balanced_accuracy,
         coalesce(tp / nullif(p, 0), 0.0) >= 0.75 and coalesce(tn / nullif(n, 0), 0.0) >= 0.75 as passed from counted
)"""


@query(f"with {PREDICTIONS}, {_robust('dataset_id')} select * from robust")
def robustness_by_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ends(metrics.robustness_metrics(predictions(spark, sf_dir), ["dataset_id"]))


@query(f"with {PREDICTIONS}, {_robust('patient_group_id')} select count(*) as datasets, min(sensitivity) as worst_sensitivity, min(specificity) as worst_specificity, bool_and(passed) as all_passed from robust")
def worst_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.stability(metrics.robustness_metrics(predictions(spark, sf_dir), ["patient_group_id"]))


@query(f"""
with {PREDICTIONS}, counts as (
  select count(*) filter (label = 'NEGATIVE') as negative_case_count, count(*) filter (label = 'NEGATIVE' and negative_subtype is not null) as negative_cases_with_subtype,
         count(*) filter (label = 'POSITIVE') as positive_case_count, count(*) filter (label = 'POSITIVE' and positive_subtype is not null) as positive_cases_with_subtype,
         count(*) as case_count, count(*) filter (len(tags) > 0) as cases_with_tag from predictions)
select *, negative_cases_with_subtype / nullif(negative_case_count, 0) as negative_subtype_coverage, positive_cases_with_subtype / nullif(positive_case_count, 0) as positive_subtype_coverage, cases_with_tag / nullif(case_count, 0) as tag_coverage from counts
""")
def subgroup_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.subgroup_coverage(predictions(spark, sf_dir))


@query(f"""
with {PREDICTIONS}, named as (select *, lower(trim(coalesce(positive_subtype, negative_subtype))) as clinical_subtype from predictions where coalesce(positive_subtype, negative_subtype) is not null),
{_robust('clinical_subtype', 'named')}, axis as (select clinical_subtype, string_agg(distinct label, ',' order by label) as label_class from named group by 1)
select robust.*, label_class, case label_class when 'POSITIVE' then 'sensitivity' when 'NEGATIVE' then 'specificity' else 'mixed' end as relevant_axis from robust join axis using (clinical_subtype)
""")
def clinical_subtypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir)
    return _ends(metrics.clinical_subtype_metrics(rows.withColumn("clinical_subtype", metrics.clinical_subtype(F.col("positive_subtype"), F.col("negative_subtype")))))


_VERDICTS = "verdicts as (select *, case when case_id % 7 = 0 then 'in_sample' when case_id % 7 < 4 then 'out_of_sample' else 'unknown' end as verdict from predictions)"


@query(f"with {PREDICTIONS}, {_VERDICTS}, {_robust('verdict', 'verdicts')} select * from robust")
def metrics_by_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    seven = F.col("case_id") % 7
    rows = predictions(spark, sf_dir).withColumn("verdict", F.when(seven == 0, "in_sample").when(seven < 4, "out_of_sample").otherwise("unknown"))
    return _ends(metrics.robustness_metrics(rows, ["verdict"]))


@query(f"""
with {COHORT}, paired as (select *, case when score >= 0.5 then 'positive' else 'negative' end as a, case when case_id % 3 = 0 then 'positive' else 'negative' end as b from cohort), counts as (
  select truth, count(*) as cases, count(*) filter (a = truth and b = truth) as both_correct, count(*) filter (a = truth and b <> truth) as only_first,
         count(*) filter (a <> truth and b = truth) as only_second, count(*) filter (a <> truth and b <> truth) as both_wrong from paired group by 1)
select *, (cases - both_wrong) / cases as oracle_rate from counts
""")
def complementarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cohort(spark, sf_dir).withColumns({"a": F.when(F.col("score") >= 0.5, "positive").otherwise("negative"), "b": F.when(F.col("case_id") % 3 == 0, "positive").otherwise("negative")})
    return metrics.complementarity(rows, "a", "b")


@query(f"""
with {COHORT}, paired as (select *, case when score >= 0.5 then 'positive' else 'negative' end as a, case when case_id % 3 = 0 then 'positive' else 'negative' end as b from cohort)
select case_id, array_to_string(list_filter([case when a = truth and b = truth then 'correct_in_both' when a <> truth and b = truth then 'corrected' when a = truth then 'introduced' else 'persistent_error' end,
  case when score >= 0.75 then 'upper_quartile' when score <= 0.25 then 'lower_quartile' else 'middle_half' end, case when abs(score - 0.5) <= 0.05 then 'near_threshold' end, case when case_id % 4 = 0 then 'no_candidate' end], lambda x: x is not null), ',') as flags from paired
""")
def audit_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cohort(spark, sf_dir)
    change = metrics.transition(F.col("truth"), F.when(F.col("score") >= 0.5, "positive").otherwise("negative"), F.when(F.col("case_id") % 3 == 0, "positive").otherwise("negative"))
    return rows.select("case_id", F.array_join(metrics.audit_flags(change, F.col("score") - 0.5, F.col("score"), F.col("case_id") % 4), ",").alias("flags"))


CLASSES = tuple(str(k) for k in range(10))
_CLASSES = "classes as (select vec_id, label::varchar as truth, case when vec_id % 9 = 0 then 'failure' else 'decisive' end as status, vec_id % 11 <> 0 as determined, ((label + case when vec_id % 4 = 0 then 1 else 0 end) % 12)::varchar as subtype from embeddings), scored as (select *, case when status = 'decisive' and determined and subtype in ('0','1','2','3','4','5','6','7','8','9') then subtype else 'undetermined' end as predicted from classes)"


def _class_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("truth"), F.when(v % 9 == 0, "failure").otherwise("decisive").alias("status"), (v % 11 != 0).alias("determined"), ((F.col("label") + F.when(v % 4 == 0, 1).otherwise(0)) % 12).cast("string").alias("subtype"))
    return rows.withColumn("predicted", metrics.scored_subtype(F.col("status"), F.col("determined"), F.col("subtype"), CLASSES))


@query(f"""
with {_CLASSES}, per as (select truth, count(*) as total, count(*) filter (predicted = truth) as correct, count(*) filter (predicted <> 'undetermined') as determined from scored group by 1),
whole as (select sum(total)::bigint as total_cases, sum(correct)::bigint as correct_cases, sum(determined)::bigint as determined_cases, count(*) as represented_classes, sum(correct / total) as recalls from per)
select * exclude (recalls), correct_cases / total_cases as top1_accuracy, recalls / represented_classes as balanced_accuracy, determined_cases / total_cases as determination_rate,
       represented_classes = 10 as class_coverage_complete, represented_classes = 10 and recalls / represented_classes >= 0.75 as gate_met from whole
""")
def multiclass_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.multiclass_metrics(_class_rows(spark, sf_dir), CLASSES)


@query(f"""
with {_CLASSES} select truth, {', '.join(f"count(*) filter (predicted = '{c}') as as_{c}" for c in (*CLASSES, 'undetermined'))} from scored group by 1
""")
def multiclass_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.multiclass_confusion(_class_rows(spark, sf_dir), CLASSES)


@query(f"""
with {_CLASSES}, per as (select truth, count(*) as total, count(*) filter (predicted = truth) as correct from scored group by 1)
select *, total - correct as errors, correct / total as recall, {_wilson('correct', 'total', 'low')} as low, {_wilson('correct', 'total', 'high')} as high from per
""")
def per_class_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ends(metrics.per_class_recall(_class_rows(spark, sf_dir)))


@query("""
with mass as (select vec_id, label, unnest(['a', 'b', 'c', 'd']) as name, unnest([abs(embedding[1]), abs(embedding[2]), abs(embedding[3]), abs(embedding[4])]) as m from embeddings),
ranked as (select *, row_number() over (partition by vec_id order by m desc, name) as r from mass)
select vec_id, max(name) filter (r = 1) as top1, max(name) filter (r = 2) as top2 from ranked group by 1
""")
def class_map_top2(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda i: F.abs(F.element_at("embedding", i))
    ranked = ranked_classes(F.create_map(*[x for i, name in enumerate("abcd", 1) for x in (F.lit(name), part(i))]))
    return table(spark, sf_dir, "embeddings").select("vec_id", ranked[0].alias("top1"), ranked[1].alias("top2"))


def _bootstrap(group: str, resamples: int, label: bool = False) -> str:
    return f"""
with {PREDICTIONS}, marked as (select {group} as g, label, not technical_failure and coalesce(said = label, false) as hit from predictions),
cells as (select g, {"label" if label else "''"} as l, count(*) filter (hit and label = 'POSITIVE') as tp, count(*) filter (label = 'POSITIVE') as p, count(*) filter (hit and label = 'NEGATIVE') as tn, count(*) filter (label = 'NEGATIVE') as n from marked group by all),
kinds as (select l, p, n, tp, tn, count(*) as m from cells group by all), totals as (select l, count(*) as total from cells group by 1),
begins as (select *, sum(m) over (partition by l order by p, n, tp, tn) - m as b from kinds),
drawn as (select r, l, ('0x' || substr(sha256('20260724|' || r || '|' || g{" || '|' || l" if label else ""}), 1, 12))::bigint % total as b from cells join totals using (l), generate_series(0, {resamples - 1}) t(r)),
sums as (select r, sum(tp) as tp, sum(p) as p, sum(tn) as tn, sum(n) as n from drawn asof join begins using (l, b) group by 1),
rates as (select coalesce(tp / nullif(p, 0), 0.0)::double as se, coalesce(tn / nullif(n, 0), 0.0)::double as sp from sums)
select count(*) as resamples, quantile_cont(se, 0.025) as sensitivity_low, quantile_cont(se, 0.975) as sensitivity_high, quantile_cont(sp, 0.025) as specificity_low, quantile_cont(sp, 0.975) as specificity_high from rates
"""


@query(_bootstrap("patient_group_id", 2000))
def group_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patient-grouped bootstrap interval."""
    return metrics.resampled_interval(predictions(spark, sf_dir), "patient_group_id", 2000, 20260724)


@query(_bootstrap("case_id", 10_000, True))
def stratified_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases resampled inside their label."""
    return metrics.resampled_interval(predictions(spark, sf_dir), "case_id", 10_000, 20260724, by_label=True)
