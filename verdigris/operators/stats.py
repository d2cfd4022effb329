"""Statistics of numeric series by group: robust scales, moments, tails, entropy, quantile definitions, runs, rolling means, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import ratio

#: Consistency factors of the median deviation and of the quartile range for a normal distribution.
MAD_FACTOR, IQR_FACTOR = 1.4826, 1.349


def robust_scale(rows: DataFrame, value: str, by: Sequence[str], least: float = 1e-8, deviation: bool = True) -> DataFrame:
    """(group, median, scale): scale from the median deviation, else from the quartile range, else the standard deviation.

    A scale counts only above ``least``; null where none does. ``deviation`` False leaves the last step out.
    """
    known = rows.where(F.col(value).isNotNull() & ~F.isnan(value))
    first = known.groupBy(*by).agg(F.median(value).alias("median"), F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.stddev_pop(value).alias("sd"))
    spread = known.join(first.select(*by, "median"), list(by)).groupBy(*by).agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))
    mad, iqr, sd = F.lit(MAD_FACTOR) * F.col("mad"), (F.col("q")[1] - F.col("q")[0]) / IQR_FACTOR, F.col("sd")
    scale = F.when(mad > least, mad).when(iqr > least, iqr)
    if deviation:
        scale = scale.when(sd > least, sd)
    return first.join(spread, list(by)).select(*by, "median", scale.alias("scale"))


def robust_z(rows: DataFrame, value: str, by: Sequence[str], limit: float = 8.0, least: float = 1e-6) -> DataFrame:
    """Adds z: (value - median) / robust scale, clipped; rows of groups without a scale go."""
    scales = robust_scale(rows, value, by, least, deviation=False).where("scale is not null")
    z = (F.col(value) - F.col("median")) / F.col("scale")
    return rows.join(scales, list(by)).withColumn("z", F.greatest(F.lit(-limit), F.least(F.lit(limit), z))).drop("median", "scale")


def normalized(rows: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Adds zscore (population deviation) and minmax; null where a group does not vary."""
    stats = rows.groupBy(*by).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"), F.min(value).alias("__a"), F.max(value).alias("__b"))
    out = rows.join(stats, list(by))
    return out.withColumns({"zscore": F.try_divide(F.col(value) - F.col("__m"), F.col("__s")), "minmax": F.try_divide(F.col(value) - F.col("__a"), F.col("__b") - F.col("__a"))}).drop("__m", "__s", "__a", "__b")


def entropy(rows: DataFrame, value: str, by: Sequence[str], low: float = -5.0, high: float = 5.0, bins: int = 32) -> DataFrame:
    """(group, entropy) in bits of the histogram of clipped values; the last bin holds the upper end."""
    clipped = F.greatest(F.lit(low), F.least(F.lit(high), F.col(value)))
    place = F.least(F.lit(bins - 1), F.floor((clipped - low) / F.lit((high - low) / bins)))
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, place.alias("__bin")).agg(F.count("*").alias("n"))
    total = counts.groupBy(*by).agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.log2("n")).alias("x"))
    return total.select(*by, (F.log2("all") - F.col("x") / F.col("all")).alias("entropy"))


def distribution(rows: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Mean, population deviation, bias-corrected skewness and excess kurtosis, six quantiles, four tail shares."""
    v = F.col(value)
    quantiles = {"q01": 0.01, "q05": 0.05, "q10": 0.1, "q90": 0.9, "q95": 0.95, "q99": 0.99}
    base = rows.where(v.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.skewness(v).alias("g1"), F.kurtosis(v).alias("g2"),
        F.percentile(v, F.array(*[F.lit(q) for q in quantiles.values()])).alias("q"),
        *[F.avg(test.cast("double")).alias(name) for name, test in (("gt_2", v > 2), ("gt_3", v > 3), ("lt_minus2", v < -2), ("lt_minus3", v < -3))],
    )
    n = F.col("n")
    skew = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurtosis = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    return base.select(*by, "n", "mean", "std", F.coalesce(F.nanvl(skew, F.lit(0.0)), F.lit(0.0)).alias("skew"), F.coalesce(F.nanvl(kurtosis, F.lit(0.0)), F.lit(0.0)).alias("kurtosis"), *[F.col("q")[i].alias(name) for i, name in enumerate(quantiles)], "gt_2", "gt_3", "lt_minus2", "lt_minus3")


def tails(rows: DataFrame, value: str, by: Sequence[str], absolute: bool = False) -> DataFrame:
    """q90, q95, q99, the mean of the highest ceil(1 %) values and the maximum, of values or of their absolutes.

    The highest values are summed from counts of distinct values, so no group is sorted as a whole.
    """
    from .order import running_totals

    x = F.abs(F.col(value)) if absolute else F.col(value)
    known = rows.where(F.col(value).isNotNull()).select(*by, x.alias("__x"))
    base = known.groupBy(*by).agg(F.percentile("__x", F.array(F.lit(0.9), F.lit(0.95), F.lit(0.99))).alias("q"), F.max("__x").alias("maximum"))
    levels = running_totals(known.groupBy(*by, "__x").agg(F.count("*").alias("n")), by, "__x", ["n"])
    top = F.greatest(F.lit(1), F.ceil(F.col("n_all") * 0.01))
    taken = F.least(F.col("n"), F.greatest(F.lit(0), top - (F.col("n_all") - F.col("n_below") - F.col("n"))))
    means = levels.groupBy(*by).agg((F.sum(F.col("__x") * taken) / F.sum(taken)).alias("top1pct_mean"))
    return base.join(means, list(by)).select(*by, F.col("q")[0].alias("q90"), F.col("q")[1].alias("q95"), F.col("q")[2].alias("q99"), "top1pct_mean", "maximum")


def quantile(rows: DataFrame, value: str, q: float, mode: str, by: Sequence[str]) -> DataFrame:
    """One quantile under one of five definitions, all over the n sorted values counted from 0.

    linear: interpolated at (n - 1) q. nearest: the value at ceil(q n) - 1. higher: at ceil((n - 1) q).
    rounded: at round(q (n - 1)), half to even. truncated: at int(q (n - 1)).
    """
    known = rows.where(F.col(value).isNotNull())
    if mode == "linear":
        return known.groupBy(*by).agg(F.percentile(value, F.lit(q)).alias("quantile"))
    from .order import running_totals

    n, x = F.col("n_all"), F.lit(q)
    index = {"nearest": F.ceil(x * n) - 1, "higher": F.ceil((n - 1) * x), "rounded": F.bround(x * (n - 1), 0).cast("bigint"), "truncated": F.floor(x * (n - 1))}[mode]
    index = F.greatest(F.lit(0), F.least(n - 1, index))
    levels = running_totals(known.groupBy(*by, value).agg(F.count("*").alias("n")), by, value, ["n"])
    return levels.where((F.col("n_below") <= index) & (index < F.col("n_below") + F.col("n"))).select(*by, F.col(value).alias("quantile"))


def five_numbers(rows: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    ends = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")
    return rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.min(value).alias("minimum"), F.max(value).alias("maximum"), F.avg(value).alias("mean"), ends).select(*by, "n", "minimum", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"), "maximum", "mean")


def mode(rows: DataFrame, value: str, order: str, by: Sequence[str]) -> DataFrame:
    """The most frequent value, of equally frequent ones that which comes first in the order."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("f"))
    return counts.groupBy(*by).agg(F.min_by(value, F.struct((-F.col("n")).alias("n"), F.col("f"))).alias("mode"))


def rolling_maximum(rows: DataFrame, value: str, order: Sequence[str], width: int, by: Sequence[str]) -> DataFrame:
    """The highest mean of ``width`` consecutive values; the plain mean of a shorter series."""
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(width - 1), 0)
    out = rows.select(*by, value, F.avg(value).over(window).alias("__m"), F.count("*").over(window).alias("__n"))
    return out.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("__n") == width, F.col("__m"))), F.avg(value)).alias("rolling_maximum"))


def longest_run(rows: DataFrame, flag: Column, order: Sequence[str], by: Sequence[str], first: int | None = None) -> DataFrame:
    """The longest stretch of consecutive rows with a true flag, among the first rows only if asked."""
    flagged = rows.withColumn("__i", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).withColumn("__f", F.coalesce(flag, F.lit(False)))
    if first is not None:
        flagged = flagged.where(F.col("__i") <= first)
    island = F.col("__i") - F.row_number().over(Window.partitionBy(*by, "__f").orderBy("__i"))
    runs = flagged.withColumn("__g", island).groupBy(*by, "__f", "__g").agg(F.count("*").alias("n"))
    return runs.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("__f"), F.col("n"))), F.lit(0)).alias("longest_run"))


def coverage_selection(components: DataFrame, size: str, key: str, by: Sequence[str], least: int, most: int, target: float) -> DataFrame:
    """The largest components of each group until at least ``least`` of them cover the target share; ``most`` at most.

    Returns the selected rows with their rank and running share; groups that stay under the target have none.
    """
    window = Window.partitionBy(*by)
    ranked = components.withColumn("rank", F.row_number().over(window.orderBy(F.desc(size), key)))
    ranked = ranked.withColumns({"__n": F.count("*").over(window), "__total": F.sum(size).over(window), "__run": F.sum(size).over(window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))})
    ranked = ranked.withColumn("covered", ratio(F.col("__run"), F.col("__total")))
    enough = (F.col("rank") >= F.least(F.lit(least), F.col("__n"))) & (F.col("covered") >= target)
    stop = ranked.withColumn("__stop", F.min(F.when(enough, F.col("rank"))).over(window))
    return stop.where((F.col("__stop") <= most) & (F.col("rank") <= F.col("__stop"))).drop("__n", "__total", "__run", "__stop")


def largest(components: DataFrame, size: str, key: str, by: Sequence[str], k: int) -> DataFrame:
    """The k largest components of each group, equal sizes by key."""
    return components.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(size), key))).where(F.col("rank") <= k)


def balanced_blocks(rows: DataFrame, order: Sequence[str], blocks: int, by: Sequence[str]) -> DataFrame:
    """Adds block (from 1): consecutive stretches whose lengths differ by one at most, longer ones first."""
    return rows.withColumn("block", F.ntile(blocks).over(Window.partitionBy(*by).orderBy(*order)))


def weighted_means(rows: DataFrame, weight: str, values: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Means weighted by size: sum(n x) / sum(n)."""
    return rows.groupBy(*by).agg(*[ratio(F.sum(F.col(weight) * F.col(v)), F.sum(weight)).alias(f"weighted_{v}") for v in values])


def dice(rows: DataFrame, first: str, second: str, by: Sequence[str]) -> DataFrame:
    """2 |A and B| / (|A| + |B|) of two boolean columns; null if both are empty."""
    return rows.groupBy(*by).agg(ratio(2 * F.count_if(F.col(first) & F.col(second)), F.count_if(first) + F.count_if(second)).alias("dice"))


def segment_overlap(rows: DataFrame, lesion: str, segment: str, by: Sequence[str]) -> DataFrame:
    """Rows of the lesion in each segment, their percentage, and the dominant segment (equal counts by name)."""
    inside = rows.where(F.col(lesion))
    total = inside.groupBy(*by).agg(F.count("*").alias("all"))
    counts = inside.where(F.col(segment).isNotNull()).groupBy(*by, segment).agg(F.count("*").alias("n")).join(total, list(by))
    first = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), segment)) == 1
    return counts.select(*by, segment, "n", (100 * F.col("n") / F.col("all")).alias("percent"), first.alias("dominant"))


def case_signals(panels: DataFrame, by: str = "case_id", positive: str = "p", negative: str = "n", inconclusive: str = "i") -> DataFrame:
    """Ten case signals of panel probability triples."""
    p, n, i = F.col(positive), F.col(negative), F.col(inconclusive)
    two = F.slice(F.sort_array(F.collect_list(p), False), 1, 2)
    return panels.groupBy(by).agg(
        F.avg(p).alias("mean_positive"), F.median(p).alias("median_positive"), F.max(p).alias("max_positive"),
        (F.aggregate(two, F.lit(0.0), lambda a, x: a + x) / F.size(two)).alias("top2_mean_positive"),
        F.avg(p - n).alias("mean_positive_minus_negative"), F.max(p - n).alias("max_positive_minus_negative"),
        F.avg(((p >= n) & (p >= i)).cast("double")).alias("positive_vote_fraction"),
        (-F.avg(n)).alias("inverse_mean_negative"), (-F.max(n)).alias("inverse_max_negative"), F.avg(i - n).alias("mean_inconclusive_minus_negative"),
    )


def precedence_state(panels: DataFrame, by: str, order: str, state: str, confidence: str, texts: dict[str, str]) -> DataFrame:
    """One report of several panels: any positive wins, then any inconclusive; the least confidence among the panels that decide; texts joined in order with a panel prefix."""
    rank = F.when(F.col(state) == "POSITIVA", 2).when(F.col(state) == "INCONCLUSIVA", 1).otherwise(0)
    sure = F.when(F.col(confidence) == "baixa", 0).when(F.col(confidence) == "moderada", 1).otherwise(2)
    joined = {name: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, F.concat(F.lit("Painel "), F.col(order).cast("string"), F.lit(": "), F.col(column)).alias("t")))), lambda s: s["t"]), " | ") for name, column in texts.items()}
    best = panels.withColumn("__r", rank).withColumn("__c", sure)
    out = best.groupBy(by).agg(F.max("__r").alias("__top"), F.min(F.struct((-F.col("__r")).alias("r"), "__c")).alias("__min"), *[v.alias(k) for k, v in joined.items()])
    name = lambda c, names: F.element_at(F.array(*[F.lit(x) for x in names]), c + 1)
    return out.select(by, name(F.col("__top"), ("NEGATIVA", "INCONCLUSIVA", "POSITIVA")).alias("state"), name(F.col("__min.__c"), ("baixa", "moderada", "alta")).alias("confidence"), *texts)


def panel_flags(panels: DataFrame, by: str, order: str) -> DataFrame:
    """Fields that only newer reports have (lesion, variant, artifact, other_type, reason), put together where every panel of a group has them all, else null.

    A flag holds if any panel's does; the other type is none, the one that was named, or other if
    several were; reasons are joined in order with a panel prefix.
    """
    fields = ("lesion", "variant", "artifact", "other_type", "reason")
    complete = F.bool_and(F.coalesce(*[F.when(F.col(c).isNull(), F.lit(False)) for c in fields], F.lit(True)))
    kinds = F.array_sort(F.collect_set(F.when(~F.col("other_type").isin("none", ""), F.col("other_type"))))
    note = F.when(F.trim("reason") != "", F.struct(order, F.concat(F.lit("Painel "), F.col(order).cast("string"), F.lit(": "), F.trim("reason")).alias("t")))
    notes = F.array_join(F.transform(F.sort_array(F.collect_list(note)), lambda s: s["t"]), " | ")
    out = panels.groupBy(by).agg(complete.alias("complete"), *[F.bool_or(F.coalesce(c, F.lit(False))).alias(c) for c in fields[:3]], kinds.alias("__kinds"), notes.alias("__notes"))
    kind = F.when(F.size("__kinds") == 0, "none").when(F.size("__kinds") == 1, F.get("__kinds", F.lit(0))).otherwise("other")
    reason = F.when(F.col("__notes") == "", "Agregação determinística dos painéis sem síntese clínica adicional.").otherwise(F.col("__notes"))
    full = lambda c: F.when(F.col("complete"), c)
    return out.select(by, "complete", *[full(F.col(c)).alias(c) for c in fields[:3]], full(kind).alias("other_type"), full(reason).alias("reason"))


def median_profile(rows: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Medians of named features."""
    return rows.groupBy(*by).agg(*[F.median(c).alias(c) for c in names])


def instance_aggregates(instances: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Mean, maximum, top-2 and top-3 mean of instance scores, and the two best instances' numbers (equal scores: lower number)."""
    ordered = F.sort_array(F.collect_list(value), False)
    mean = lambda k: F.aggregate(F.slice(ordered, 1, k), F.lit(0.0), lambda a, x: a + x) / F.least(F.size(ordered), F.lit(k))
    best = F.transform(F.slice(F.sort_array(F.collect_list(F.struct((-F.col(value)).alias("s"), F.col("instance")))), 1, 2), lambda s: s["instance"])
    return instances.groupBy(*by).agg(F.avg(value).alias("mean"), F.max(value).alias("max"), mean(2).alias("top2_mean"), mean(3).alias("top3_mean"), best.alias("top_instances"))


def class_mass(instances: DataFrame, by: str = "case_id", name: str = "class", value: str = "p", how: str = "top2_mean") -> DataFrame:
    """(case, class, share): per class the instances' aggregate, divided by the case's total."""
    per = instance_aggregates(instances, value, [by, name]).select(by, name, F.col(how).alias("m"))
    return per.withColumn("share", ratio(F.col("m"), F.sum("m").over(Window.partitionBy(by)))).select(by, name, "share")


def pairwise_mass(pairs: DataFrame, by: str = "case_id") -> DataFrame:
    """(case, class, share) from one-against-one probabilities (left, right, p of right): each class adds up its own side."""
    sides = F.explode(F.array(F.struct(F.col("left").alias("class"), (1 - F.col("p")).alias("v")), F.struct(F.col("right").alias("class"), F.col("p").alias("v"))))
    votes = pairs.select(by, sides.alias("s")).groupBy(by, F.col("s.class").alias("class")).agg(F.sum("s.v").alias("v"))
    return votes.withColumn("share", ratio(F.col("v"), F.sum("v").over(Window.partitionBy(by)))).select(by, "class", "share")


def resolved_subtype(mass: DataFrame, named: Sequence[str], floor: float, by: str = "case_id") -> DataFrame:
    """The most probable named class and its part of the named mass; undetermined below the floor. Equal masses: first in ``named``."""
    rank = F.array_position(F.array(*[F.lit(n) for n in named]), F.col("class"))
    rows = mass.withColumn("__i", rank)
    out = rows.groupBy(by).agg(F.coalesce(F.sum(F.when(F.col("__i") > 0, F.col("share"))), F.lit(0.0)).alias("named_mass"), F.min(F.when(F.col("__i") > 0, F.struct((-F.col("share")).alias("s"), "__i", "class"))).alias("b"))
    known = F.col("named_mass") >= floor
    return out.select(by, "named_mass", known.alias("determined"), F.when(known, F.col("b.class")).alias("subtype"), F.when(known, ratio(-F.col("b.s"), F.col("named_mass"))).alias("confidence"))


def integrity_scores(rows: DataFrame) -> DataFrame:
    """Mean of four goodness terms less penalties, from components, euler, roughness, largest_fraction, touches_border, hole_fraction."""
    base = (F.col("largest_fraction") + 1 / F.greatest(F.lit(1), F.col("components")) + 1 / (1 + F.abs(F.col("euler") - 1)) + F.when(F.col("roughness") > 0, 1 / F.col("roughness")).otherwise(0.0)) / 4
    penalty = F.when(F.col("touches_border"), 0.15).otherwise(0.0) + F.when(F.coalesce(F.col("hole_fraction"), F.lit(0.0)) > 0.001, 0.1).otherwise(0.0)
    return rows.withColumn("score", base - penalty)
