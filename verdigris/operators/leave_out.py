"""Leave-one-out fusion by ECDFs, weights and thresholds that never see the row they judge, without refitting on copies of the table.

Without a row, every other row's mid-rank falls by one, a half or nothing, as it lies over, beside or
under the row that is gone. So a fused score moves by at most the sum of the weights, in units of
one rank, and sensitivity and specificity at a threshold by a few rows. As the one falls and the
other rises with the threshold, the best threshold of every refit lies in one band around the point
where they cross. The band follows from counts over the whole table; rows outside it are only
counted, rows inside it are re-scored for each row that is left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .index import stored
from .order import running_totals

#: Rows of different signals that all bands may hold together, as every task holds them; more are an error.
MOST_BAND_ROWS = 500_000
#: Fixed value: how far outside the scores the outer candidates lie.
EDGE = 1e-12


def _ranked(rows: DataFrame, names: Sequence[str], by: Sequence[str], truth: str) -> DataFrame:
    """Different signal vectors with a JSON key of their group, positives, negatives, and each signal's mid-rank (rows below and half the equal ones)."""
    usable = F.col(truth).isNotNull()
    for name in names:
        usable = usable & F.col(name).isNotNull() & ~F.isnan(F.col(name).cast("double"))
    kept = rows.where(usable).select(F.to_json(F.struct(*by), {"ignoreNullFields": "false"}).alias("__g") if by else F.lit("{}").alias("__g"), F.col(truth).alias("__t"), *[F.col(n).cast("double").alias(f"x{k}") for k, n in enumerate(names)])
    xs = [f"x{k}" for k in range(len(names))]
    vectors = stored(kept.groupBy("__g", *xs).agg(F.count_if("__t").alias("p"), F.count_if(~F.col("__t")).alias("n")), "vectors")
    out = vectors
    for k, x in enumerate(xs):
        levels = vectors.groupBy("__g", x).agg(F.sum(F.col("p") + F.col("n")).alias("c"))
        out = out.join(running_totals(levels, ["__g"], x, ["c"]).select("__g", x, (F.col("c_below") + F.col("c") / 2).alias(f"r{k}")), ["__g", x])
    return stored(out, "ranked")


def _bands(ranked: DataFrame, weights: Sequence[Sequence[float]], removed: int) -> tuple[DataFrame, DataFrame]:
    """For each group and weights (``w``, their number): bounds and outside counts, and the vectors inside.

    Bounds are proved for up to ``removed`` rows less. Let S be the weighted sum of ranks, W that of the
    weights, v the least smaller rate that the threshold with the best one in the whole table has
    after a removal. A threshold T of a better or equal refit has sensitivity of at least v although
    only rows with S >= T can be over it, and specificity of at least v although only rows with
    S < T + removed * W can be under it. The band goes so far beyond these that the neighbours
    which make up midpoint thresholds are inside as well, whichever rows are gone.
    """
    total = lambda w: F.lit(0.0) if not w else sum((F.lit(float(x)) * F.col(f"r{k}") for k, x in enumerate(w)), F.lit(0.0))
    placed = ranked.withColumn("__w", F.explode(F.array(*[F.struct(F.lit(i).alias("w"), total(w).alias("s"), F.lit(float(removed * sum(w))).alias("move")) for i, w in enumerate(weights)])))
    placed = placed.select(*ranked.columns, "__w.*")
    keys = ["__g", "w"]
    levels = placed.groupBy(*keys, "s", "move").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    levels = stored(running_totals(levels, keys, "s", ["p", "n"]).drop("next_value", "is_first"), "levels")
    P, N, s, d = F.col("p_all"), F.col("n_all"), F.col("s"), removed
    fixed = lambda one: F.first(one)

    def joined(found: DataFrame) -> DataFrame:
        return levels.join(F.broadcast(found), keys)  # a row a group and weights

    rates = F.least((P - F.col("p_below")) / P, F.col("n_below") / N)
    known = levels.where((P > d) & (N > d)).groupBy(*keys).agg(F.max_by("s", F.struct(rates, -s)).alias("t0"))
    v = F.least((F.sum(F.when(s >= F.col("t0") + F.col("move"), F.col("p")).otherwise(0)) - d) / fixed(P), (F.sum(F.when(s < F.col("t0"), F.col("n")).otherwise(0)) - d) / fixed(N)) - 1e-9
    known = joined(known).groupBy(*keys).agg(v.alias("v"))
    high = F.max(F.when(P - F.col("p_below") >= F.col("v") * (P - d), s))
    low = F.min(F.when(F.col("n_below") + F.col("n") >= F.col("v") * (N - d), s)) - fixed(F.col("move"))
    known = joined(known).groupBy(*keys).agg(low.alias("low"), high.alias("high"))
    size, before = F.col("p") + F.col("n"), F.col("p_below") + F.col("n_below")
    top = F.col("high") + F.col("move")
    known = joined(known).groupBy(*keys).agg(fixed("low").alias("low"), fixed("high").alias("high"), F.sum(F.when(s < F.col("low"), size).otherwise(0)).alias("under"), F.sum(F.when(s <= top, size).otherwise(0)).alias("upto"))
    margin = fixed(1e-6 + 1e-9 * (P + N))
    start = F.max(F.when((s < F.col("low")) & (F.col("under") - before > d), s)) - fixed(F.col("move")) - margin
    end = F.min(F.when((s > top) & (before + size - F.col("upto") > d), s)) + fixed(F.col("move")) + margin
    known = joined(known).groupBy(*keys).agg((fixed("low") - margin).alias("low"), (fixed("high") + margin).alias("high"), F.coalesce(start, F.lit(float("-inf"))).alias("start"), F.coalesce(end, F.lit(float("inf"))).alias("end"))
    count = lambda test, c: F.sum(F.when(test, F.col(c)).otherwise(0))
    outside = {f"{c}_{side}": count(test, c) for c in ("p", "n") for side, test in (("under", s < F.col("start")), ("over", s > F.col("end")))}
    bounds = joined(known).groupBy(*keys).agg(*[fixed(c).alias(c) for c in ("low", "high", "start", "end")], fixed(P).alias("p_all"), fixed(N).alias("n_all"), *[e.alias(a) for a, e in outside.items()])
    bounds = stored(bounds, "bounds")
    inside = placed.join(F.broadcast(bounds.select(*keys, "start", "end")), keys).where((s >= F.col("start")) & (s <= F.col("end"))).drop("start", "end", "move", "s")
    return bounds, inside


class Band:
    """One group's band for one weighting: the rows inside by signals, ranks and counts, and how many lie outside."""

    def __init__(self, weights: Sequence[float], bounds: Mapping[str, float], rows: np.ndarray) -> None:
        k = len(weights)
        self.weights, self.bounds = weights, bounds
        self.x, self.r, self.p, self.n = rows[:, :k], rows[:, k : 2 * k], rows[:, 2 * k].copy(), rows[:, 2 * k + 1].copy()

    def score(self, ranks: np.ndarray, rows: int) -> np.ndarray:
        out = np.zeros(len(ranks))
        for k, w in enumerate(self.weights):
            out = out + w * (ranks[:, k] / rows)
        return out

    def side(self, ranks: np.ndarray) -> int:
        """-1, 0 or 1: a vector lies under, in or over the band."""
        s = sum(w * r for w, r in zip(self.weights, ranks, strict=True))
        return int(s > self.bounds["end"]) - int(s < self.bounds["start"])

    def threshold(self, gone: Sequence[tuple[np.ndarray, np.ndarray, bool]]) -> tuple[float, float]:
        """The best threshold without the rows ``gone`` (signals, ranks, truth), and the last one's score under it."""
        b = self.bounds
        ranks, counts = self.r, {True: self.p, False: self.n}
        under, whole = {True: b["p_under"], False: b["n_under"]}, {True: b["p_all"], False: b["n_all"]}
        for x, own, truth in gone:
            ranks = ranks - ((x < self.x) + 0.5 * (x == self.x))
            whole[truth] -= 1
            side = self.side(own)
            if side == 0:
                counts[truth] = counts[truth] - (self.x == x).all(axis=1)
            under[truth] -= side < 0
        rows = whole[True] + whole[False]
        held = counts[True] + counts[False] > 0
        scores, at = np.unique(self.score(ranks, rows)[held], return_inverse=True)
        p, n = (np.concatenate(([0], np.cumsum(np.bincount(at, counts[t][held], len(scores))))) + under[t] for t in (True, False))
        t = (scores[:-1] + scores[1:]) / 2
        t = t[(t * rows >= b["low"]) & (t * rows <= b["high"])]
        edges = [scores[0] - EDGE] * (b["start"] == -np.inf) + [scores[-1] + EDGE] * (b["end"] == np.inf)
        t = np.concatenate((t, edges))
        below = np.searchsorted(scores, t, "left")
        sens, spec = (whole[True] - p[below]) / whole[True], n[below] / whole[False]
        best = np.lexsort((t, np.abs(sens - spec), -(sens + spec) / 2, -np.minimum(sens, spec)))[0]
        x, own, _ = gone[-1]
        mine = own - sum((y < x) + 0.5 * (y == x) for y, *_ in gone)
        return float(t[best]), float(self.score(mine[None, :], rows)[0])


def _collected(bounds: DataFrame, inside: DataFrame, weights: Sequence[Sequence[float]]) -> dict[str, list[Band | None]]:
    """All bands by group, then by weights; their size is checked before anything is brought to the driver."""
    k = len(weights[0])
    size = inside.count()
    if size > MOST_BAND_ROWS:
        raise ValueError(f"{size} different rows lie where the best threshold may be, more than the {MOST_BAND_ROWS} that every task is to hold")
    rows = inside.select("__g", "w", *[f"x{i}" for i in range(k)], *[f"r{i}" for i in range(k)], "p", "n").toPandas()
    held = {key: part.iloc[:, 2:].to_numpy(float) for key, part in rows.groupby(["__g", "w"])}
    out: dict[str, list[Band | None]] = {}
    for b in bounds.collect():
        own = out.setdefault(b["__g"], [None] * len(weights))
        own[b["w"]] = Band(weights[b["w"]], b.asDict(), held.get((b["__g"], b["w"]), np.zeros((0, 2 * k + 2))))
    return out


def _judged(rows: DataFrame, ranked: DataFrame, names: Sequence[str], by: Sequence[str], truth: str, judge, columns: Mapping[str, str]) -> DataFrame:
    """Rows with what ``judge(group, signals, ranks, truth)`` says of each different vector and truth; a vector is judged once, however many rows have it."""
    k = len(names)
    xs = [f"x{i}" for i in range(k)]
    truths = F.filter(F.array(F.when(F.col("p") > 0, F.lit(True)), F.when(F.col("n") > 0, F.lit(False))), lambda t: t.isNotNull())
    asked = ranked.select("__g", *xs, *[f"r{i}" for i in range(k)], F.explode(truths).alias("__t")).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x, r = frame[xs].to_numpy(float), frame[[f"r{i}" for i in range(k)]].to_numpy(float)
            found = [judge(g, a, b, bool(t)) for g, a, b, t in zip(frame["__g"], x, r, frame["__t"], strict=True)]
            yield pd.concat([frame[["__g", *xs, "__t"]].reset_index(drop=True), pd.DataFrame(found, columns=list(columns), dtype=float)], axis=1)

    said = asked.mapInPandas(run, f"__g string, {', '.join(f'{x} double' for x in xs)}, __t boolean, {', '.join(f'{c} {kind}' for c, kind in columns.items())}")
    keyed = rows.withColumns({"__g": F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("{}"), "__t": F.col(truth)} | {x: F.col(n).cast("double") for x, n in zip(xs, names, strict=True)})
    out = keyed.join(said, ["__g", *xs, "__t"], "left").drop("__g", "__t", *xs)
    return out.withColumn("predicted", F.col("fused") >= F.col("threshold"))


def leave_one_out_fusion(rows: DataFrame, weights: Mapping[str, float], by: Sequence[str] = (), truth: str = "truth") -> DataFrame:
    """Every row judged by the ECDFs and the midpoint threshold of all other rows of its group; adds fused, threshold and predicted.

    The fused score is the weighted sum of mid-rank ECDFs among the others; thresholds go by the smaller
    rate, balanced accuracy, small difference of the rates, small threshold. Equal to refitting without each row.

    Rows without a truth or a signal take no part and get nulls, so do groups with fewer than two
    rows of a class. Weights must not be negative. Rows whose signals are all equal are judged
    together. Work grows with the rows times those of the band, which holds a few rows unless
    many fused scores lie within one rank of each other; a band over ``MOST_BAND_ROWS`` is an error.
    """
    names, values = list(weights), [float(w) for w in weights.values()]
    if min(values) < 0:
        raise ValueError("weights must not be negative")
    ranked = _ranked(rows, names, by, truth)
    shared = rows.sparkSession.sparkContext.broadcast(_collected(*_bands(ranked, [values], 1), [values]))

    def judge(group: str, x: np.ndarray, ranks: np.ndarray, own: bool) -> tuple[float | None, float | None]:
        bands = shared.value.get(group)
        if bands is None:
            return None, None
        threshold, score = bands[0].threshold([(x, ranks, own)])
        return score, threshold

    return _judged(rows, ranked, names, by, truth, judge, {"fused": "double", "threshold": "double"})


def nested_leave_one_out(rows: DataFrame, first: str, second: str, grid: Sequence[float], by: Sequence[str] = (), truth: str = "truth") -> DataFrame:
    """Every row judged by a blend (1 - w) * ECDF(first) + w * ECDF(second) whose weight all other rows choose by leave-one-out among themselves; adds w, fused, threshold and predicted.

    Weights go by the inner decisions' smaller rate, balanced accuracy, sensitivity, small weight;
    threshold and score are then those of the other rows under that weight. Equal to refitting
    without each pair of rows. Of a row's inner decisions only those of the band are computed: what lies
    outside it is on its side whichever two rows are gone. Cases as in ``leave_one_out_fusion``, with
    three rows of a class at least; work grows with the rows times the square of those of a band.
    """
    weights = [(1 - float(w), float(w)) for w in grid]
    if min(map(min, weights)) < 0:
        raise ValueError("weights must lie between 0 and 1")
    ranked = _ranked(rows, [first, second], by, truth)
    shared = rows.sparkSession.sparkContext.broadcast(_collected(*_bands(ranked, weights, 2), weights))

    def inner(band: Band, x: np.ndarray, ranks: np.ndarray, own: bool) -> tuple[float, float, float]:
        b, side = band.bounds, band.side(ranks)
        right = {True: b["p_over"] - (own and side > 0), False: b["n_under"] - (not own and side < 0)}
        whole = {True: b["p_all"] - own, False: b["n_all"] - (not own)}
        for j in range(len(band.x)):
            same = side == 0 and (band.x[j] == x).all()
            for truth_, count in ((True, band.p[j] - (own and same)), (False, band.n[j] - (not own and same))):
                if count > 0:
                    threshold, score = band.threshold([(x, ranks, own), (band.x[j], band.r[j], truth_)])
                    right[truth_] += count * ((score >= threshold) == truth_)
        sens, spec = right[True] / whole[True], right[False] / whole[False]
        return min(sens, spec), (sens + spec) / 2, sens

    def judge(group: str, x: np.ndarray, ranks: np.ndarray, own: bool) -> tuple[float | None, float | None, float | None]:
        bands = shared.value.get(group)
        if bands is None:
            return None, None, None
        best = max(range(len(weights)), key=lambda i: (*inner(bands[i], x, ranks, own), -weights[i][1]))
        threshold, score = bands[best].threshold([(x, ranks, own)])
        return float(grid[best]), score, threshold

    return _judged(rows, ranked, [first, second], by, truth, judge, {"w": "double", "fused": "double", "threshold": "double"})
