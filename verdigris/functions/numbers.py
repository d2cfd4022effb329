"""Ratios, intervals and array statistics as Column expressions."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the 97.5 % point of the normal distribution as the robustness reports state it.
Z_95 = 1.959963984540054


def ratio(numerator: Column, denominator: Column, empty: float | None = None) -> Column:
    """numerator / denominator as double; null, or ``empty`` where given, for a zero denominator."""
    value = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return value if empty is None else F.coalesce(value, F.lit(float(empty)))


def wilson(successes: Column, total: Column, confidence: float | None = 0.95, empty: float | None = None) -> Column:
    """struct(low, high) of the Wilson score interval, unrounded and clamped to [0, 1].

    ``confidence`` None takes the fixed 97.5 % point. Without trials both ends are null, or
    ``empty`` where given.
    """
    if confidence is not None and not 0 < confidence < 1:
        raise ValueError("confidence must lie between 0 and 1")
    z = Z_95 if confidence is None else NormalDist().inv_cdf(1 - (1 - confidence) / 2)
    n, p = total.cast("double"), ratio(successes, total)
    width = 1 + F.lit(z * z) / F.nullif(n, F.lit(0.0))
    centre = (p + F.lit(z * z) / (2 * F.nullif(n, F.lit(0.0)))) / width
    margin = F.lit(z) * F.sqrt(p * (1 - p) / F.nullif(n, F.lit(0.0)) + F.lit(z * z) / (4 * F.nullif(n * n, F.lit(0.0)))) / width
    low, high = F.when(n > 0, F.greatest(F.lit(0.0), centre - margin)), F.when(n > 0, F.least(F.lit(1.0), centre + margin))
    if empty is not None:
        low, high = F.coalesce(low, F.lit(empty)), F.coalesce(high, F.lit(empty))
    return F.struct(low.alias("low"), high.alias("high"))


def array_sum(values: Column) -> Column:
    """Sum in the array's order, so that the same array always has the same double sum."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))


def array_mean(values: Column) -> Column:
    return ratio(array_sum(values), F.size(values))


def top_mean(values: Column, k: int) -> Column:
    """Mean of the k largest values, of all if there are fewer."""
    return array_mean(F.slice(F.sort_array(values, False), 1, k))


def array_median(values: Column) -> Column:
    """The middle of the sorted values, or the mean of the two middle ones."""
    ordered, n = F.sort_array(values), F.size(values)
    return F.when(n > 0, (F.element_at(ordered, F.floor((n + 1) / 2).cast("int")) + F.element_at(ordered, F.floor(n / 2 + 1).cast("int"))) / 2)


def log_odds(positive: Column, negative: Column, epsilon: float = 1e-8) -> Column:
    return F.log((positive + epsilon) / (negative + epsilon))


def sigmoid(value: Column, limit: float = 35.0) -> Column:
    """1 / (1 + exp(-x)) with x clipped to +-limit."""
    return 1 / (1 + F.exp(-F.greatest(F.lit(-limit), F.least(F.lit(limit), value))))


def softmax(logits: Column) -> Column:
    """Stabilized softmax of an array."""
    powers = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(powers, lambda x: x / array_sum(powers))


def prompt_ensemble_probability(logits: Column, positive: int) -> Column:
    """Softmax mass of the first ``positive`` prompts."""
    return array_sum(F.slice(softmax(logits), 1, positive))


def class_shares(mass: Column) -> Column:
    """A map of class masses divided by their total."""
    total = array_sum(F.map_values(mass))
    return F.transform_values(mass, lambda _, v: v / total)


def ranked_classes(mass: Column) -> Column:
    """Class names by falling mass, equal masses by name."""
    entries = F.transform(F.map_entries(mass), lambda e: F.struct((-e["value"]).alias("order"), e["key"].alias("name")))
    return F.transform(F.array_sort(entries), lambda e: e["name"])


def uniform_indices(n: Column, count: int) -> Column:
    """``count`` indices spread over 0 .. n - 1, rounded half to even; null unless they are distinct."""
    steps = F.sequence(F.lit(0), F.lit(count - 1))
    spread = F.transform(steps, lambda i: F.bround(i * (n - 1) / F.lit(max(1, count - 1))).cast("int"))
    return F.when((n >= count) & (F.size(F.array_distinct(spread)) == count), spread)


def centred_window(centre: Column, size: int, count: Column) -> Column:
    """Indices of a window of ``size`` around ``centre``, moved inside 0 .. count - 1; null if it does not fit."""
    start = F.least(F.greatest(centre - F.lit(size // 2), F.lit(0)), count - size)
    return F.when(count >= size, F.sequence(start.cast("int"), (start + size - 1).cast("int")))


def lists_close(a: Column, b: Column, tolerance: float) -> Column:
    """Whether two arrays of one length differ by at most ``tolerance`` everywhere."""
    return (F.size(a) == F.size(b)) & F.forall(F.arrays_zip(a.alias("x"), b.alias("y")), lambda z: F.abs(z["x"] - z["y"]) <= tolerance)
