"""Score calibration and fusion: rank transforms, threshold searches, held-out selection, weighted and signed-margin fusion.

Rank transforms and threshold searches work on counts of distinct scores with running sums, so
equal scores never have to be ordered among each other and no pairs of rows are formed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import ratio
from .index import stored
from .order import RANGE, Scan, running_totals, scanned

#: Fixed value: how far outside the observed scores the outer candidates lie.
EDGE = 1e-12


def ecdf(rows: DataFrame, value: str, by: Sequence[str] = (), alias: str = "ecdf", reference: str | None = None) -> DataFrame:
    """Mid-rank ECDF of a column: (rows below + half the equal rows) / rows.

    ``reference`` names a boolean column; only its rows make up the distribution, all rows are
    looked up in it. Null without a reference row in the group.
    """
    return ecdfs(rows, {value: alias}, by, reference)


def ecdfs(rows: DataFrame, columns: Mapping[str, str], by: Sequence[str] = (), reference: str | None = None) -> DataFrame:
    """The same of several columns, each under its alias; all are counted from ``rows``, none from another's result, so that the plan grows with the columns."""
    counted = F.lit(True) if reference is None else F.coalesce(F.col(reference), F.lit(False))
    out = rows
    for value, alias in columns.items():
        levels = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count_if(counted).alias("n"))
        placed = running_totals(levels, by, value, ["n"]).withColumn(alias, ratio(F.col("n_below") + F.col("n") / 2, F.col("n_all")))
        out = _looked_up(out, placed, by, value, alias)
    return out


def _looked_up(rows: DataFrame, placed: DataFrame, by: Sequence[str], value: str, alias: str) -> DataFrame:
    return rows.join(placed.select(*by, value, alias), [*by, value], "left")


def percentile_rank(rows: DataFrame, value: str, by: Sequence[str] = (), alias: str = "percentile") -> DataFrame:
    """Mean 0-based rank of equal values over n - 1 (over 1 for a single row)."""
    levels = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    placed = running_totals(levels, by, value, ["n"]).withColumn(alias, (F.col("n_below") + (F.col("n") - 1) / 2) / F.greatest(F.lit(1), F.col("n_all") - 1))
    return _looked_up(rows, placed, by, value, alias)


def cume_dist(rows: DataFrame, value: str, by: Sequence[str] = (), alias: str = "cume_dist") -> DataFrame:
    """Share of rows that are not greater."""
    levels = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    placed = running_totals(levels, by, value, ["n"]).withColumn(alias, ratio(F.col("n_below") + F.col("n"), F.col("n_all")))
    return _looked_up(rows, placed, by, value, alias)


def weighted_ecdf(rows: DataFrame, weights: Mapping[str, float], by: Sequence[str] = (), alias: str = "fused", reference: str | None = None) -> DataFrame:
    """Weighted sum of the signals' ECDFs, added in the order of ``weights``."""
    out = ecdfs(rows, {name: f"__{name}" for name in weights}, by, reference)
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.lit(weight) * F.col(f"__{name}")
    return out.withColumn(alias, total).drop(*[f"__{name}" for name in weights])


def two_level_fusion(rows: DataFrame, weights: Mapping[str, float], reader: str, blend: tuple[float, float], by: Sequence[str] = (), alias: str = "fused", reference: str | None = None) -> DataFrame:
    """blend[0] * (weighted ECDF of the signals) + blend[1] * ECDF of another reader."""
    inner = weighted_ecdf(rows, weights, by, "__inner", reference)
    outer = ecdf(inner, reader, by, "__reader", reference)
    return outer.withColumn(alias, F.lit(blend[0]) * F.col("__inner") + F.lit(blend[1]) * F.col("__reader")).drop("__inner", "__reader")


def frozen_scores(rows: DataFrame, references: DataFrame, weights: Mapping[str, float], threshold: float, key: str = "case_id") -> DataFrame:
    """Scores of unseen rows under a stored calibrator: reference values (signal, value) and a threshold.

    Reference values become cumulative counts once; rows find theirs in a merged order of both
    sides, so the reference may be large as well. Returns the key, score, threshold, prediction.
    """
    names = list(weights)
    seen = rows.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias("signal"), F.col(n).cast("double").alias("value")) for n in names])).alias("s")).select(key, "s.signal", "s.value")
    both = seen.withColumn("__ref", F.lit(False)).unionByName(references.select(F.lit(None).cast(dict(rows.dtypes)[key]).alias(key), "signal", F.col("value").cast("double").alias("value"), F.lit(True).alias("__ref")))
    looked = ecdf(both, "value", ["signal"], "e", "__ref").where("not __ref")
    weight = F.element_at(F.create_map(*[x for n, w in weights.items() for x in (F.lit(n), F.lit(float(w)))]), F.col("signal"))
    parts = F.sort_array(F.collect_list(F.struct(F.array_position(F.array(*[F.lit(n) for n in names]), F.col("signal")).alias("i"), (weight * F.col("e")).alias("x"))))
    score = F.aggregate(parts, F.lit(0.0), lambda a, p: a + p["x"])
    out = looked.groupBy(key).agg(score.alias("score"))
    return out.withColumns({"threshold": F.lit(float(threshold)), "prediction": F.when(F.col("score") >= threshold, "POSITIVE").otherwise("NEGATIVE")})


def _levels(rows: DataFrame, by: Sequence[str], score: str, truth: str, keep_ranges: bool = False) -> DataFrame:
    """Distinct scores with their positives and negatives, and how many of each lie below; with the columns of ``RANGE`` if asked."""
    levels = rows.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("__s")).agg(F.count_if(F.col(truth)).alias("p"), F.count_if(~F.col(truth)).alias("n"))
    placed = running_totals(levels, by, "__s", ["p", "n"], keep_ranges=keep_ranges)
    return placed.select(*(RANGE if keep_ranges else ()), *by, "__s", *[F.col(a).alias(b) for a, b in (("p", "__p"), ("n", "__n"), ("p_all", "__pos"), ("n_all", "__neg"), ("p_below", "__pb"), ("n_below", "__nb"), ("next_value", "__next"), ("is_first", "__first"))])


def candidates(rows: DataFrame, kind: str, by: Sequence[str] = (), score: str = "score", truth: str = "truth") -> DataFrame:
    """All candidate thresholds of a kind with the rates of ``score >= threshold``.

    midpoints: a step below the least score, the midpoints, a step above the greatest.
    unit: 0, 1, all scores and the midpoints. observed: the scores.
    frontier: minus infinity, the scores, infinity. edges: the scores and a step outside them.
    """
    levels = _levels(rows, by, score, truth)
    at = lambda t, p, n: F.struct(t.alias("threshold"), p.alias("p"), n.alias("n"))
    here = at(F.col("__s"), F.col("__pb"), F.col("__nb"))
    above = (F.col("__pb") + F.col("__p"), F.col("__nb") + F.col("__n"))
    middle = F.when(F.col("__next").isNotNull(), at((F.col("__s") + F.col("__next")) / 2, *above))
    low = lambda t: F.when(F.col("__first"), at(t, F.col("__pb"), F.col("__nb")))
    high = lambda t: F.when(F.col("__next").isNull(), at(t, *above))
    unit = lambda v: F.when(F.col("__first") & (F.col("__s") >= v), at(F.lit(v), F.lit(0), F.lit(0))).when((F.col("__s") < v) & (F.col("__next").isNull() | (F.col("__next") >= v)), at(F.lit(v), *above))
    made = {
        "midpoints": [low(F.col("__s") - EDGE), middle, high(F.col("__s") + EDGE)],
        "unit": [unit(0.0), unit(1.0), here, middle],
        "observed": [here],
        "frontier": [low(F.lit(float("-inf"))), here, high(F.lit(float("inf")))],
        "edges": [low(F.col("__s") - EDGE), here, high(F.col("__s") + EDGE)],
    }[kind]
    typed = [F.when(F.lit(True), c).cast("struct<threshold:double,p:bigint,n:bigint>") for c in made]
    rows = levels.select(*by, "__pos", "__neg", F.explode(F.filter(F.array(*typed), lambda c: c.isNotNull())).alias("c"))
    sensitivity, specificity = ratio(F.col("__pos") - F.col("c.p"), F.col("__pos"), 0.0), ratio(F.col("c.n"), F.col("__neg"), 0.0)
    rates = rows.select(*by, F.col("c.threshold").alias("threshold"), (F.col("__pos") - F.col("c.p")).alias("tp"), F.col("c.n").alias("tn"), (F.col("__neg") - F.col("c.n")).alias("fp"), F.col("c.p").alias("fn"), sensitivity.alias("sensitivity"), specificity.alias("specificity"))
    return rates.withColumns({"minimum_rate": F.least("sensitivity", "specificity"), "balanced_accuracy": (F.col("sensitivity") + F.col("specificity")) / 2})


def _order(kind: str, prefer: str) -> list[Column]:
    """What a best candidate maximizes, in turn."""
    least, balanced, t = F.col("minimum_rate"), F.col("balanced_accuracy"), F.col("threshold")
    return {
        "even": [least, balanced, -F.abs(F.col("sensitivity") - F.col("specificity")), -t],
        "near_half": [least, balanced, -F.abs(t - 0.5), -t],
        "large": [least, F.col("sensitivity") + F.col("specificity"), t],
        "sensitive": [least, balanced, F.col("sensitivity"), F.col("specificity"), t],
    }[prefer]


#: The preference that goes with each kind of candidates.
PREFERENCES = {"midpoints": "even", "unit": "near_half", "observed": "large", "frontier": "sensitive", "edges": "near_half"}


def best_threshold(rows: DataFrame, kind: str = "midpoints", by: Sequence[str] = (), score: str = "score", truth: str = "truth", prefer: str | None = None, gate: float = 0.75) -> DataFrame:
    """The best candidate of each group, its rates, and how many candidates pass the gate.

    All preferences maximize the smaller rate first, then: ``even`` balanced accuracy, small
    difference of the rates, small threshold; ``near_half`` balanced accuracy, nearness to 0.5,
    small threshold; ``large`` the rates' sum, large threshold; ``sensitive`` balanced accuracy,
    sensitivity, specificity, large threshold. So ties never depend on the order of rows.
    """
    found = candidates(rows, kind, by, score, truth)
    columns = ["threshold", "tp", "tn", "fp", "fn", "sensitivity", "specificity", "minimum_rate", "balanced_accuracy"]
    order = [c.alias(f"o{i}") for i, c in enumerate(_order(kind, prefer or PREFERENCES[kind]))]
    best = F.max_by(F.struct(*columns), F.struct(*order)).alias("b")
    passing = F.count_if((F.col("sensitivity") >= gate) & (F.col("specificity") >= gate)).alias("feasible")
    return found.groupBy(*by).agg(best, passing).select(*by, *[f"b.{c}" for c in columns], "feasible")


def frontier_both_directions(rows: DataFrame, by: Sequence[str] = (), score: str = "score", truth: str = "truth", gate: float = 0.75) -> DataFrame:
    """The frontier's best candidate for ``score >= t`` (direction 1) and for ``-score >= t`` (direction -1) of each group, and the better direction.

    Equal ones: direction 1. Thresholds are those of the directed score.
    """
    both = rows.withColumn("direction", F.explode(F.array(F.lit(1), F.lit(-1)))).withColumn("__directed", F.col(score) * F.col("direction"))
    found = best_threshold(both, "frontier", [*by, "direction"], "__directed", truth, gate=gate)
    order = F.struct("minimum_rate", "balanced_accuracy", "sensitivity", "specificity", "direction")
    best = found.groupBy(*by).agg(F.max_by("direction", order).alias("__best")) if by else found.agg(F.max_by("direction", order).alias("__best"))
    joined = found.join(best, list(by)) if by else found.crossJoin(F.broadcast(best))  # one row of a whole table's best direction
    return joined.withColumn("chosen", F.col("direction") == F.col("__best")).drop("__best")


def folded(rows: DataFrame, fold: str, folds: int) -> DataFrame:
    """Every row once for each fold, with ``held_out`` (1 row in ``folds``) and the fold's number in ``part``."""
    return rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumn("held_out", F.col(fold) == F.col("part"))


def cross_validated_threshold(rows: DataFrame, fold: str, folds: int, by: Sequence[str] = (), kind: str = "midpoints", score: str = "score", truth: str = "truth") -> DataFrame:
    """Decisions of every row by the threshold that the other folds select.

    Rows are copied once a fold, which is linear in the rows; each copy's threshold comes from
    counts. Adds threshold and predicted.
    """
    keys = [*by, "part"]
    parts = folded(rows, fold, folds)
    chosen = best_threshold(parts.where("not held_out"), kind, keys, score, truth).select(*keys, "threshold")
    return parts.where("held_out").join(chosen, keys).withColumn("predicted", F.col(score) >= F.col("threshold")).drop("part", "held_out")


def leave_one_out_threshold(rows: DataFrame, by: Sequence[str] = (), score: str = "score", truth: str = "truth") -> DataFrame:
    """Decisions of every row by the midpoint threshold that all other rows select; adds threshold and predicted.

    No search is repeated. Without a row of score s and truth t, a candidate's rates depend only
    on t and on which side of s it lies, so the best one is the better of the best candidate below
    s and the best one above: two scans of maxima over the order of the scores, cut into ranges,
    so that one group's scores are spread over tasks. A score that only this row has vanishes
    with it, and the two candidates beside it become the one between its neighbours.
    """
    levels = stored(scanned(_levels(rows, by, score, truth, keep_ranges=True), by, "__s", {"__prev": Scan("__s", "max")}), "levels")
    here, above = (F.col("__pb"), F.col("__nb")), (F.col("__pb") + F.col("__p"), F.col("__nb") + F.col("__n"))

    def rated(threshold: Column, counts: tuple[Column, Column], positive: bool, above: bool) -> Column:
        """Order of a candidate with so many at or below it once a row of the truth is gone that lies under (above: the candidate is above it) or over it."""
        (pb, nb), P, N = counts, F.col("__pos") - int(positive), F.col("__neg") - int(not positive)
        sens = ratio(F.col("__pos") - pb - int(positive and not above), P, 0.0)
        spec = ratio(nb - int(not positive and above), N, 0.0)
        return F.struct(F.least(sens, spec).alias("a"), ((sens + spec) / 2).alias("b"), (-F.abs(sens - spec)).alias("c"), (-threshold).alias("d"))

    upper = F.when(F.col("__next").isNull(), F.col("__s") + EDGE).otherwise((F.col("__s") + F.col("__next")) / 2)
    lower = F.when(F.col("__prev").isNull(), F.col("__s") - EDGE).otherwise((F.col("__s") + F.col("__prev")) / 2)
    # candidates below a level are the lower ones of this and of earlier levels, those above the upper ones of this and of later levels
    own, scans = {}, {}
    for t, positive in (("p", True), ("n", False)):
        own |= {f"__lo_{t}": rated(lower, here, positive, False), f"__hi_{t}": rated(upper, above, positive, True)}
        scans |= {f"__below_{t}": Scan(f"__lo_{t}", "max"), f"__above_{t}": Scan(f"__hi_{t}", "max", below=False)}
    out = scanned(levels.withColumns(own), by, "__s", scans)
    between = F.when(F.col("__prev").isNull(), F.col("__next") - EDGE).when(F.col("__next").isNull(), F.col("__prev") + EDGE).otherwise((F.col("__prev") + F.col("__next")) / 2)
    alone = F.col("__p") + F.col("__n") == 1
    chosen = []
    for t, positive in (("p", True), ("n", False)):
        others = F.greatest(f"__below_{t}", f"__above_{t}")
        best = F.when(alone, F.greatest(others, F.when(between.isNotNull(), rated(between, here, positive, False)))).otherwise(F.greatest(others, f"__lo_{t}", f"__hi_{t}"))
        chosen.append(F.when(F.col(f"__{t}") > 0, F.struct(F.lit(positive).alias("t"), (-best["d"]).alias("threshold"))))
    pairs = out.select(*by, F.col("__s").alias(score), F.explode(F.filter(F.array(*chosen), lambda c: c.isNotNull())).alias("c")).select(*by, score, F.col("c.t").alias(truth), "c.threshold")
    return rows.join(pairs, [*by, score, truth]).withColumn("predicted", F.col(score) >= F.col("threshold"))


def cross_validated_fusion(rows: DataFrame, weights: Mapping[str, float], fold: str, folds: int, by: Sequence[str] = (), truth: str = "truth") -> DataFrame:
    """ECDF references, fusion and threshold fitted on the other folds for every row; adds fused, threshold and predicted."""
    keys = [*by, "part"]
    parts = folded(rows, fold, folds).withColumn("__train", ~F.col("held_out"))
    fused = stored(weighted_ecdf(parts, weights, keys, "fused", "__train"), "fused")
    chosen = best_threshold(fused.where("__train"), "midpoints", keys, "fused", truth).select(*keys, "threshold")
    return fused.where("held_out").join(chosen, keys).withColumn("predicted", F.col("fused") >= F.col("threshold")).drop("part", "held_out", "__train")


def nested_weight(rows: DataFrame, first: str, second: str, grid: Sequence[float], inner: str, inner_folds: int, by: Sequence[str] = (), truth: str = "truth") -> DataFrame:
    """The weight w of (1 - w) * ECDF(first) + w * ECDF(second) with the best inner cross-validated decisions; ties to the small weight."""
    grown = rows.withColumn("w", F.explode(F.array(*[F.lit(float(w)) for w in grid])))
    keys = [*by, "w", "part"]
    parts = folded(grown, inner, inner_folds).withColumn("__train", ~F.col("held_out"))
    ranked = stored(ecdfs(parts, {first: "__a", second: "__b"}, keys, "__train").withColumn("fused", (1 - F.col("w")) * F.col("__a") + F.col("w") * F.col("__b")), "blended")
    chosen = best_threshold(ranked.where("__train"), "midpoints", keys, "fused", truth).select(*keys, "threshold")
    decided = ranked.where("held_out").join(chosen, keys).withColumn("predicted", F.col("fused") >= F.col("threshold"))
    scored = binary_rates(decided, [*by, "w"], truth)
    best = F.max_by(F.struct("w", "sensitivity", "specificity", "minimum_rate", "balanced_accuracy"), F.struct("minimum_rate", "balanced_accuracy", "sensitivity", (-F.col("w")).alias("o"))).alias("b")
    return scored.groupBy(*by).agg(best).select(*by, "b.*")


def nested_cross_validated_weight(rows: DataFrame, first: str, second: str, grid: Sequence[float], outer: str, outer_folds: int, inner: str, inner_folds: int, truth: str = "truth") -> DataFrame:
    """Decisions of every row by a blend whose weight and threshold its outer fold's training rows select.

    The weight is that of ``nested_weight`` on the training rows; references and threshold are then
    fitted on all of them. With as many outer folds as rows it is nested leave-one-out. Rows are
    copied once an outer fold, and those once an inner one and weight. Adds w, fused, threshold and predicted.
    """
    parts = folded(rows, outer, outer_folds).withColumnRenamed("part", "__outer")
    train = parts.where("not held_out").drop("held_out")
    chosen = stored(nested_weight(train, first, second, grid, inner, inner_folds, ["__outer"], truth).select("__outer", "w"), "weights")
    placed = parts.withColumn("__train", ~F.col("held_out")).join(F.broadcast(chosen), "__outer")  # a row an outer fold
    keys = ["__outer"]
    fused = stored(ecdfs(placed, {first: "__a", second: "__b"}, keys, "__train").withColumn("fused", (1 - F.col("w")) * F.col("__a") + F.col("w") * F.col("__b")), "blended")
    bound = best_threshold(fused.where("__train"), "midpoints", keys, "fused", truth).select(*keys, "threshold")
    return fused.where("held_out").join(bound, keys).withColumn("predicted", F.col("fused") >= F.col("threshold")).drop("__outer", "__a", "__b", "__train", "held_out")


def binary_rates(decided: DataFrame, by: Sequence[str] = (), truth: str = "truth", predicted: str = "predicted", gate: float = 0.75) -> DataFrame:
    """Counts and rates of boolean decisions; an empty class has rate 0."""
    t, p = F.col(truth), F.col(predicted)
    counts = decided.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    out = counts.withColumns({"sensitivity": ratio(F.col("tp"), F.col("tp") + F.col("fn"), 0.0), "specificity": ratio(F.col("tn"), F.col("tn") + F.col("fp"), 0.0)})
    return out.withColumns({"balanced_accuracy": (F.col("sensitivity") + F.col("specificity")) / 2, "minimum_rate": F.least("sensitivity", "specificity"), "passed": (F.col("sensitivity") >= gate) & (F.col("specificity") >= gate)})


def repeated_summary(rates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Over repeats: how many pass, medians and minima of the rates."""
    return rates.groupBy(*by).agg(F.count("*").alias("repeats"), F.count_if("passed").alias("runs_passing"), F.median("sensitivity").alias("median_sensitivity"), F.median("specificity").alias("median_specificity"), F.min("sensitivity").alias("minimum_sensitivity"), F.min("specificity").alias("minimum_specificity"))


def aligned(signals: DataFrame, cases: DataFrame, key: str = "case_id") -> DataFrame:
    """Signal rows (signal, key, ...) of the cases that every signal and the protected side have, with the case's metadata."""
    signal_count = signals.agg(F.count_distinct("signal").alias("__signals"))
    full = signals.groupBy(key).agg(F.count_distinct("signal").alias("__have")).join(F.broadcast(signal_count), F.col("__have") == F.col("__signals")).select(key)
    return signals.join(full, key, "left_semi").join(cases, key)


def one_sided(left: DataFrame, right: DataFrame, key: str = "case_id") -> DataFrame:
    """Keys that only one side has; a join of equal universes needs it empty."""
    a, b = left.select(key).distinct().withColumn("__l", F.lit(True)), right.select(key).distinct().withColumn("__r", F.lit(True))
    return a.join(b, key, "full").where("__l is null or __r is null").select(key, F.when(F.col("__l").isNotNull(), "left").otherwise("right").alias("side"))


def late_fusion(rows: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Signed margin: the weighted sum of score - threshold over columns <name>_score, <name>_threshold, <name>_failed.

    A row that lacks any score, or whose signal failed, is a technical failure without a margin.
    """
    margin, failed = F.lit(0.0), F.lit(False)
    for name, weight in weights.items():
        margin = margin + F.lit(float(weight)) * (F.col(f"{name}_score") - F.col(f"{name}_threshold"))
        failed = failed | F.coalesce(F.col(f"{name}_failed"), F.lit(False)) | F.col(f"{name}_score").isNull()
    out = rows.withColumn("technical_failure", failed).withColumn("margin", F.when(~F.col("technical_failure"), margin))
    return out.withColumn("prediction", F.when(F.col("technical_failure"), "TECHNICAL_FAILURE").when(F.col("margin") >= 0, "POSITIVE").otherwise("NEGATIVE"))


def margin_features(signals: DataFrame, names: Sequence[str], policy: str = "fail_case", key: str = "case_id") -> DataFrame:
    """Stacking features: an array of score - threshold for each named signal.

    A missing signal (no row, a failure, no score or threshold) under ``fail_case`` leaves the
    array null, under ``zero_margin`` is 0, under ``zero_margin_with_indicator`` is 0 and has a 1
    in a second half of the array. A case without any valid signal has no array.
    """
    if policy not in ("fail_case", "zero_margin", "zero_margin_with_indicator"):
        raise ValueError("unknown policy for missing signals")
    valid = ~F.coalesce(F.col("technical_failure"), F.lit(False)) & F.col("score").isNotNull() & F.col("threshold").isNotNull()
    wide = signals.groupBy(key).agg(*[F.max(F.when((F.col("signal") == n) & valid, F.col("score") - F.col("threshold"))).alias(f"__{i}") for i, n in enumerate(names)])
    cells = [F.col(f"__{i}") for i in range(len(names))]
    values = [F.coalesce(c, F.lit(0.0)) for c in cells]
    if policy == "zero_margin_with_indicator":
        values += [c.isNull().cast("double") for c in cells]
    complete = cells[0].isNotNull()
    any_valid = cells[0].isNotNull()
    for c in cells[1:]:
        complete, any_valid = complete & c.isNotNull(), any_valid | c.isNotNull()
    return wide.select(key, F.when(complete if policy == "fail_case" else any_valid, F.array(*values)).alias("features"))


def score_correlation(signals: DataFrame, first: str, second: str, key: str = "case_id") -> DataFrame:
    """Pearson correlation over cases where both signals have a score and no failure; null for fewer than two."""
    usable = signals.where(F.col("signal").isin(first, second) & ~F.coalesce(F.col("technical_failure"), F.lit(False)) & F.col("score").isNotNull())
    wide = usable.groupBy(key).agg(F.max(F.when(F.col("signal") == first, F.col("score"))).alias("a"), F.max(F.when(F.col("signal") == second, F.col("score"))).alias("b")).where("a is not null and b is not null")
    return wide.agg(F.count("*").alias("shared_cases"), F.when(F.count("*") >= 2, F.corr("a", "b")).alias("correlation"))
