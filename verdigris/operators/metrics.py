"""Evaluation of predictions against labels: penalized confusion counts, rates, intervals, AUC, subgroup and multiclass reports.

Case rows have case_id, truth (positive / negative), prediction (POSITIVA / NEGATIVA /
INCONCLUSIVA or null) and status (decisive, inconclusive, failure, timeout,
invalid_response). What is not correct counts against its truth group, whatever kept it from
being correct. All reports are single aggregations; only the bootstrap collects, a table of its different counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import ratio, wilson
from .index import stored
from .order import running_totals

#: The states of a prediction and of a case, as result rows spell them.
POSITIVE, NEGATIVE, INCONCLUSIVE = "POSITIVA", "NEGATIVA", "INCONCLUSIVA"
STATUSES = ("decisive", "inconclusive", "failure", "timeout", "invalid_response")
STATUS_ALIASES = {"failed": "failure", "invalid": "invalid_response"}


def true_positive() -> Column:
    return (F.col("truth") == "positive") & F.col("prediction").eqNullSafe(POSITIVE)


def true_negative() -> Column:
    return (F.col("truth") == "negative") & F.col("prediction").eqNullSafe(NEGATIVE)


def canonical_status(status: Column) -> Column:
    """Lower-cased status with aliases resolved."""
    value = F.lower(F.trim(status))
    out = value
    for alias, name in STATUS_ALIASES.items():
        out = F.when(value == alias, F.lit(name)).otherwise(out)
    return out


def is_decision() -> Column:
    """A decisive case with one of the two binary predictions."""
    return (F.col("status") == "decisive") & F.col("prediction").isin(POSITIVE, NEGATIVE)


def _by(df: DataFrame, by: Sequence[str], overall: bool):
    if not by:
        return df.groupBy()
    return df.rollup(*by) if overall else df.groupBy(*by)


def _of_status(status: str) -> Column:
    return F.count_if(F.col("status") == status)


def terminal_counts() -> list[Column]:
    """How many rows end in each prediction and each failure state."""
    return [
        F.count_if(F.col("prediction") == POSITIVE).alias("positive_predictions"),
        F.count_if(F.col("prediction") == NEGATIVE).alias("negative_predictions"),
        *[_of_status(s).alias(s) for s in STATUSES[1:]],
    ]


def primary_metrics(cases: DataFrame, by: Sequence[str] = (), overall: bool = False, minimum_sensitivity: float = 0.75, minimum_specificity: float = 0.75, confidence: float = 0.95) -> DataFrame:
    """The penalized report over all cases, one row for each group; with ``overall`` also for the whole (group columns null)."""
    counts = _by(cases, by, overall).agg(
        F.count("*").alias("total_cases"),
        F.count_if(F.col("truth") == "positive").alias("positive_cases"),
        F.count_if(F.col("truth") == "negative").alias("negative_cases"),
        F.count_if(true_positive()).alias("tp"),
        F.count_if(true_negative()).alias("tn"),
        F.count_if(is_decision()).alias("decisive_cases"),
        *[_of_status(s).alias(f"{s}_count") for s in STATUSES[1:]],
    )
    counts = counts.withColumns({"fn": F.col("positive_cases") - F.col("tp"), "fp": F.col("negative_cases") - F.col("tn"), "failed_cases": F.col("failure_count") + F.col("timeout_count") + F.col("invalid_response_count")})
    total, tp, tn, fp, fn = (F.col(c) for c in ("total_cases", "tp", "tn", "fp", "fn"))
    rates = counts.withColumns(
        {
            "completed_reports": total - F.col("failed_cases"),
            "completion_rate": ratio(total - F.col("failed_cases"), total),
            "coverage_rate": ratio(F.col("decisive_cases"), total),
            "inconclusive_rate": ratio(F.col("inconclusive_count"), total),
            "failure_rate": ratio(F.col("failed_cases"), total),
            "accuracy": ratio(tp + tn, total),
            "sensitivity": ratio(tp, F.col("positive_cases")),
            "specificity": ratio(tn, F.col("negative_cases")),
            "precision": ratio(tp, tp + fp),
            "f1_score": ratio(2 * tp, 2 * tp + fp + fn),
        }
    )
    ends = {}
    for name, successes, trials in (("accuracy", tp + tn, total), ("sensitivity", tp, F.col("positive_cases")), ("specificity", tn, F.col("negative_cases")), ("precision", tp, tp + fp), ("coverage", F.col("decisive_cases"), total)):
        interval = wilson(successes, trials, confidence)
        ends |= {f"{name}_low": interval["low"], f"{name}_high": interval["high"]}
    passed = F.coalesce((F.round("sensitivity", 4) >= minimum_sensitivity) & (F.round("specificity", 4) >= minimum_specificity), F.lit(False))
    return rates.withColumns(ends).withColumn("gate_passed", passed)


def undefined_reasons(report: DataFrame) -> DataFrame:
    """Adds ``undefined``: metric -> reason for each denominator of a primary report that is zero."""
    reasons = {"sensitivity": (F.col("positive_cases"), "no_positive_cases"), "specificity": (F.col("negative_cases"), "no_negative_cases"), "precision": (F.col("tp") + F.col("fp"), "no_penalized_positive_predictions"), "decisions_only": (F.col("decisive_cases"), "no_binary_decisions")}
    whole = F.create_map(*[x for name, (n, why) in reasons.items() for x in (F.lit(name), F.when(n == 0, F.lit(why)))])
    return report.withColumn("undefined", F.map_filter(whole, lambda _, why: why.isNotNull()))


def decisions_only(cases: DataFrame, by: Sequence[str] = (), overall: bool = False) -> DataFrame:
    """The secondary report: binary decisions alone, which leaves out what the primary one penalizes."""
    made = cases.where(is_decision())
    cell = lambda truth, prediction: F.count_if((F.col("truth") == truth) & (F.col("prediction") == prediction))
    counts = _by(made, by, overall).agg(F.count("*").alias("total_cases"), cell("positive", POSITIVE).alias("tp"), cell("negative", NEGATIVE).alias("tn"), cell("negative", POSITIVE).alias("fp"), cell("positive", NEGATIVE).alias("fn"))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return counts.withColumns({"accuracy": ratio(tp + tn, F.col("total_cases")), "sensitivity": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp), "precision": ratio(tp, tp + fp), "f1_score": ratio(2 * tp, 2 * tp + fp + fn)})


def categorical_confusion(cases: DataFrame) -> DataFrame:
    """truth x (three predictions, three failure states); both truths are there, with zeros."""
    states = {POSITIVE: F.col("prediction") == POSITIVE, NEGATIVE: F.col("prediction") == NEGATIVE, INCONCLUSIVE: F.col("status") == "inconclusive", "FAILURE": F.col("status") == "failure", "TIMEOUT": F.col("status") == "timeout", "INVALID_RESPONSE": F.col("status") == "invalid_response"}
    found = cases.groupBy("truth").agg(*[F.count_if(test).alias(name) for name, test in states.items()])
    truths = cases.sparkSession.createDataFrame([("negative",), ("positive",)], "truth string")
    return truths.join(found, "truth", "left").na.fill(0)


def subtype_metrics(cases: DataFrame, truth: str, column: str) -> DataFrame:
    """Rates of each subtype of one truth group; rows without a subtype are ``unspecified``."""
    right = POSITIVE if truth == "positive" else NEGATIVE
    names = ("true_positives", "false_negatives_penalized", "sensitivity", "negative_prediction_rate") if truth == "positive" else ("true_negatives", "false_positives_penalized", "specificity", "positive_prediction_rate")
    other = "negative_predictions" if truth == "positive" else "positive_predictions"
    group = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("unspecified")).alias("subtype")
    counts = cases.where(F.col("truth") == truth).groupBy(group).agg(F.count("*").alias("total"), F.count_if(F.col("prediction") == right).alias(names[0]), *terminal_counts())
    total = F.col("total")
    return counts.withColumns({names[1]: total - F.col(names[0]), names[2]: ratio(F.col(names[0]), total), names[3]: ratio(F.col(other), total), "inconclusive_rate": ratio(F.col("inconclusive"), total), "failure_rate": ratio(F.col("failure") + F.col("timeout") + F.col("invalid_response"), total)})


def tag_metrics(cases: DataFrame, tags: str = "tags") -> DataFrame:
    """One row for each tag; a case counts under each of its different tags."""
    rows = cases.withColumn("tag", F.explode(F.array_distinct(tags)))
    counts = rows.groupBy("tag").agg(F.count("*").alias("total"), F.count_if(F.col("truth") == "negative").alias("negative_cases"), F.count_if(F.col("truth") == "positive").alias("positive_cases"), F.count_if(true_negative()).alias("tn"), F.count_if(true_positive()).alias("tp"), *terminal_counts())
    total = F.col("total")
    return counts.withColumns({"specificity_on_tagged_negatives": ratio(F.col("tn"), F.col("negative_cases")), "sensitivity_on_tagged_positives": ratio(F.col("tp"), F.col("positive_cases")), "positive_prediction_rate": ratio(F.col("positive_predictions"), total), "inconclusive_rate": ratio(F.col("inconclusive"), total)}).drop("tn", "tp")


def roc_auc(rows: DataFrame, by: Sequence[str] = (), score: str = "score", positive: str = "positive") -> DataFrame:
    """Area under the ROC curve by ranks with ties at one half: one aggregation by score and one running sum.

    ``positive`` is a boolean column; rows without a score take no part; null where a class is
    missing. Equal scores are added up first, so the running sum goes over distinct scores and
    no task ranks the rows of a group.
    """
    known = rows.where(F.col(score).isNotNull() & F.col(positive).isNotNull())
    levels = running_totals(known.groupBy(*by, score).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n")), by, score, ["n"])
    wins = levels.withColumn("wins", F.col("p") * (F.col("n_below") + F.col("n") / 2))
    return wins.groupBy(*by).agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"), F.try_divide(F.sum("wins"), (F.sum("p") * F.sum("n")).cast("double")).alias("auc"))


def robustness_metrics(rows: DataFrame, by: Sequence[str] = (), overall: bool = False, gate: float = 0.75) -> DataFrame:
    """Penalized counts of prediction rows: case_id, label and prediction (POSITIVE / NEGATIVE), technical_failure.

    A technical failure is an error of its label; an empty class has rate 0, not null.
    """
    failed, label, said = F.coalesce(F.col("technical_failure"), F.lit(False)), F.col("label") == "POSITIVE", F.col("prediction")
    right = ~failed & F.coalesce((label & (said == "POSITIVE")) | (~label & (said == "NEGATIVE")), F.lit(False))
    counts = _by(rows, by, overall).agg(F.count("*").alias("case_count"), F.count_if(label & right).alias("tp"), F.count_if(~label & right).alias("tn"), F.count_if(~label & ~right).alias("fp"), F.count_if(label & ~right).alias("fn"), F.count_if(failed).alias("technical_failures"))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    out = counts.withColumns({"sensitivity": ratio(tp, tp + fn, 0.0), "specificity": ratio(tn, tn + fp, 0.0)})
    ends = {}
    for name, successes, trials in (("sensitivity", tp, tp + fn), ("specificity", tn, tn + fp)):
        interval = wilson(successes, trials, None, 0.0)
        ends |= {f"{name}_low": interval["low"], f"{name}_high": interval["high"]}
    return out.withColumns({"balanced_accuracy": (F.col("sensitivity") + F.col("specificity")) / 2, **ends, "passed": (F.col("sensitivity") >= gate) & (F.col("specificity") >= gate)})


def stability(by_dataset: DataFrame) -> DataFrame:
    """Smallest rates over the datasets of a robustness report, and whether all passed."""
    return by_dataset.agg(F.count("*").alias("datasets"), F.min("sensitivity").alias("worst_sensitivity"), F.min("specificity").alias("worst_specificity"), F.bool_and("passed").alias("all_passed"))


def subgroup_coverage(rows: DataFrame) -> DataFrame:
    """How many negative and positive cases name a subtype, and how many cases have tags."""
    named = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    counts = rows.agg(
        F.count_if(F.col("label") == "NEGATIVE").alias("negative_case_count"),
        F.count_if((F.col("label") == "NEGATIVE") & named("negative_subtype")).alias("negative_cases_with_subtype"),
        F.count_if(F.col("label") == "POSITIVE").alias("positive_case_count"),
        F.count_if((F.col("label") == "POSITIVE") & named("positive_subtype")).alias("positive_cases_with_subtype"),
        F.count("*").alias("case_count"),
        F.count_if(F.coalesce(F.size("tags") > 0, F.lit(False))).alias("cases_with_tag"),
    )
    return counts.withColumns({"negative_subtype_coverage": ratio(F.col("negative_cases_with_subtype"), F.col("negative_case_count")), "positive_subtype_coverage": ratio(F.col("positive_cases_with_subtype"), F.col("positive_case_count")), "tag_coverage": ratio(F.col("cases_with_tag"), F.col("case_count"))})


def clinical_subtype(*columns: Column) -> Column:
    """The first non-empty of several fields, trimmed and lower-cased."""
    return F.lower(F.trim(F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])))


def clinical_subtype_metrics(rows: DataFrame, column: str = "clinical_subtype") -> DataFrame:
    """Robustness metrics for each subtype and the axis that applies: sensitivity, specificity, or mixed."""
    known = rows.where(F.col(column).isNotNull())
    axis = known.groupBy(column).agg(F.array_sort(F.collect_set("label")).alias("labels"))
    which = F.when(F.size("labels") > 1, "mixed").when(F.col("labels")[0] == "POSITIVE", "sensitivity").when(F.col("labels")[0] == "NEGATIVE", "specificity").otherwise("mixed")
    return robustness_metrics(known, [column]).join(axis, column).withColumn("relevant_axis", which).withColumn("label_class", F.array_join("labels", ",")).drop("labels")


def scored_subtype(status: Column, determined: Column, subtype: Column, classes: Sequence[str], undetermined: str = "undetermined") -> Column:
    """The predicted class as it is scored: undetermined unless decisive, determined and in the vocabulary."""
    return F.when((status == "decisive") & F.coalesce(determined, F.lit(False)) & subtype.isin(*classes), subtype).otherwise(undetermined)


def multiclass_confusion(rows: DataFrame, classes: Sequence[str], undetermined: str = "undetermined") -> DataFrame:
    """truth x (classes and undetermined) with zeros, from columns truth and predicted."""
    counts = rows.groupBy("truth").agg(*[F.count_if(F.col("predicted") == c).alias(f"as_{c}") for c in (*classes, undetermined)])
    truths = rows.sparkSession.createDataFrame([(c,) for c in classes], "truth string")
    return truths.join(counts, "truth", "left").na.fill(0)


def multiclass_metrics(rows: DataFrame, classes: Sequence[str], minimum: float = 0.75, undetermined: str = "undetermined") -> DataFrame:
    """Top-1, macro recall over the represented classes, determination rate, and the gate, which asks for all classes."""
    per_class = rows.groupBy("truth").agg(F.count("*").alias("total"), F.count_if(F.col("predicted") == F.col("truth")).alias("correct"), F.count_if(F.col("predicted") != undetermined).alias("determined"))
    recall = ratio(F.col("correct"), F.col("total"))
    whole = per_class.agg(F.sum("total").alias("total_cases"), F.sum("correct").alias("correct_cases"), F.sum("determined").alias("determined_cases"), F.count("*").alias("represented_classes"), F.sum(recall).alias("recalls"))
    out = whole.withColumns({"top1_accuracy": ratio(F.col("correct_cases"), F.col("total_cases")), "balanced_accuracy": ratio(F.col("recalls"), F.col("represented_classes")), "determination_rate": ratio(F.col("determined_cases"), F.col("total_cases"))}).drop("recalls")
    complete = F.col("represented_classes") == len(classes)
    return out.withColumns({"class_coverage_complete": complete, "gate_met": complete & (F.col("balanced_accuracy") >= minimum)})


def per_class_recall(rows: DataFrame, confidence: float = 0.95) -> DataFrame:
    counts = rows.groupBy("truth").agg(F.count("*").alias("total"), F.count_if(F.col("predicted") == F.col("truth")).alias("correct"))
    interval = wilson(F.col("correct"), F.col("total"), confidence)
    return counts.withColumns({"errors": F.col("total") - F.col("correct"), "recall": ratio(F.col("correct"), F.col("total")), "low": interval["low"], "high": interval["high"]})


def complementarity(rows: DataFrame, first: str, second: str) -> DataFrame:
    """Paired correctness of two prediction columns against truth, and what an oracle choosing between them would get."""
    a, b = F.col(first) == F.col("truth"), F.col(second) == F.col("truth")
    cells = {"both_correct": a & b, "only_first": a & ~b, "only_second": ~a & b, "both_wrong": ~a & ~b}
    out = rows.groupBy("truth").agg(F.count("*").alias("cases"), *[F.count_if(test).alias(name) for name, test in cells.items()])
    return out.withColumn("oracle_rate", ratio(F.col("cases") - F.col("both_wrong"), F.col("cases")))


def transition(truth: Column, before: Column, after: Column) -> Column:
    """What a second model changed: correct_in_both, corrected, introduced (an error) or persistent_error."""
    a, b = before == truth, after == truth
    return F.when(a & b, "correct_in_both").when(~a & b, "corrected").when(a & ~b, "introduced").otherwise("persistent_error")


def rank_band(percentile: Column) -> Column:
    return F.when(percentile >= 0.75, "upper_quartile").when(percentile <= 0.25, "lower_quartile").otherwise("middle_half")


def audit_flags(change: Column, margin: Column, percentile: Column, candidates: Column, near: float = 0.05) -> Column:
    """Transition and rank band, then near_threshold and no_candidate where they apply."""
    flags = F.array(change, rank_band(percentile), F.when(F.abs(margin) <= near, F.lit("near_threshold")), F.when(candidates == 0, F.lit("no_candidate")))
    return F.filter(flags, lambda f: f.isNotNull())


#: Parts of the numbers of a stratum's groups by which draws find the counts that they stand for, when these are too many for one table.
PARTS = 1024
#: Different counts that are sent to all tasks as one table, and draws of a task.
MOST_KINDS, DRAWS = 200_000, 10_000_000


def resampled_counts(cells: DataFrame, keys: Sequence[str], columns: Sequence[str], stratum: Column, resamples: int, seed: int, most_kinds: int = MOST_KINDS) -> DataFrame:
    """Sums of ``columns`` (whole numbers, the first two telling most rows apart) over bootstrap draws of the rows of ``cells``, which ``keys`` name.

    Returns resample (from 0), drawn, and the sums. Each row draws once in each resample, by a hash of
    (seed, resample, keys), a number below the count of its stratum's rows; so a resample draws exactly as many
    rows of each stratum as it has, with replacement. Rows with the same columns are interchangeable: they are counted,
    the counts take ranges of numbers, and a draw looks up the range of its number. Rows are spread over tasks by
    their draws, and a task gives one row a resample: draws are neither kept nor shuffled. Only where there are more
    than ``most_kinds`` different counts, draws are shuffled to the ranges.
    """
    name = F.concat_ws("|", F.lit(""), *keys)
    rows = stored(cells.select(F.coalesce(stratum.cast("string"), F.lit("")).alias("__stratum"), name.alias("__name"), *columns), "bootstrap-cells")
    kinds = rows.groupBy("__stratum", *columns).agg(F.count("*").alias("__m"))
    if kinds.limit(most_kinds + 1).count() > most_kinds:
        return _joined_draws(rows, kinds, columns, resamples, seed)
    table = kinds.orderBy("__stratum", *columns).toArrow()
    of, m = table.column("__stratum").to_pylist(), table.column("__m").to_numpy()
    values = np.stack([table.column(c).to_numpy() for c in columns], axis=1)
    edges = [k for k in range(len(of)) if k == 0 or of[k] != of[k - 1]] + [len(of)]
    ranges = {of[a]: (np.cumsum(m[a:b]), values[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)}
    tasks = min(max(1, -(-int(m.sum()) * resamples // DRAWS)), 8192)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = [b"%d|%d" % (seed, r) for r in range(resamples)]
        sums, drawn = np.zeros((resamples, len(columns)), np.int64), 0
        for batch in batches:
            for s, tail in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ends, counts = ranges[s]
                tail = tail.encode()
                digests = b"".join([hashlib.sha256(head + tail).digest() for head in heads])
                number = (np.frombuffer(digests, ">u8")[::4] >> np.uint64(16)).astype(np.int64) % ends[-1]
                sums += counts[np.searchsorted(ends, number, "right")]
                drawn += 1
        if drawn:
            yield pa.record_batch([pa.array(np.arange(resamples, dtype=np.int32)), pa.array(np.full(resamples, drawn)), *[pa.array(c) for c in sums.T]], names=["resample", "drawn", *columns])

    spread = rows.select("__stratum", "__name").repartition(tasks, "__name")
    found = spread.mapInArrow(draw, f"resample int, drawn bigint, {', '.join(f'`{c}` bigint' for c in columns)}")
    return found.groupBy("resample").agg(*[F.sum(c).alias(c) for c in ("drawn", *columns)])


def _joined_draws(rows: DataFrame, kinds: DataFrame, columns: Sequence[str], resamples: int, seed: int) -> DataFrame:
    """The same, by a join of all draws with the ranges."""
    first, second = columns[:2], columns[2:]
    before = lambda total, part, order: F.coalesce(F.sum(total).over(Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = Window.partitionBy("__stratum")
    heads = kinds.groupBy("__stratum", *first).agg(F.sum("__m").alias("__h"))
    heads = heads.select("__stratum", *first, before("__h", ["__stratum"], first).alias("__before"), F.sum("__h").over(whole).alias("__total"))
    begin = F.col("__before") + before("__m", ["__stratum", *first], second)
    ranges = kinds.join(heads, ["__stratum", *first]).select("__stratum", *columns, "__total", "__m", begin.alias("__begin")).withColumn("__end", F.col("__begin") + F.col("__m"))
    part = lambda number: F.floor(number * PARTS / F.col("__total"))
    ranges = ranges.withColumn("__part", F.explode(F.sequence(part(F.col("__begin")), part(F.col("__end") - 1))))
    totals = rows.groupBy("__stratum").agg(F.count("*").alias("__total"))
    number = F.conv(F.substring(F.sha2(F.concat(F.concat_ws("|", F.lit(seed), "resample"), "__name"), 256), 1, 12), 16, 10).cast("bigint")
    draws = rows.select("__stratum", "__name").withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).join(totals, "__stratum")
    draws = draws.select("__stratum", "resample", F.pmod(number, F.col("__total")).alias("__number"), "__total").withColumn("__part", part(F.col("__number"))).drop("__total")
    inside = (F.col("__number") >= F.col("__begin")) & (F.col("__number") < F.col("__end"))
    return draws.join(ranges, ["__stratum", "__part"]).where(inside).groupBy("resample").agg(F.count("*").alias("drawn"), *[F.sum(c).alias(c) for c in columns])


def resampled_interval(rows: DataFrame, group: str, resamples: int, seed: int, by_label: bool = False) -> DataFrame:
    """Bootstrap of whole groups: percentile interval of penalized sensitivity and specificity.

    Each resample draws, with replacement, as many groups as there are (``by_label``: of each label), by hashes:
    the draw needs no random state and no order, and any executor can repeat it. The counts of a group are
    summed before groups are drawn, so the work grows with groups times resamples.
    """
    keys = [group, "label"] if by_label else [group]
    right = ~F.coalesce(F.col("technical_failure"), F.lit(False)) & F.coalesce(F.col("prediction") == F.col("label"), F.lit(False))
    cells = rows.groupBy(*keys).agg(F.count_if(right & (F.col("label") == "POSITIVE")).alias("tp"), F.count_if(F.col("label") == "POSITIVE").alias("p"), F.count_if(right & (F.col("label") == "NEGATIVE")).alias("tn"), F.count_if(F.col("label") == "NEGATIVE").alias("n"))
    sums = resampled_counts(cells, keys, ["p", "n", "tp", "tn"], F.col("label") if by_label else F.lit(""), resamples, seed)
    rates = sums.select(ratio(F.col("tp"), F.col("p"), 0.0).alias("sensitivity"), ratio(F.col("tn"), F.col("n"), 0.0).alias("specificity"))
    ends = [F.percentile(c, F.lit(q)).alias(f"{c}_{name}") for c in ("sensitivity", "specificity") for name, q in (("low", 0.025), ("high", 0.975))]
    return rates.agg(F.count("*").alias("resamples"), *ends)
