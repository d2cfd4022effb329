"""Folds: hash-ordered stratified assignment, group-stratified nested splits, and the checks that no group leaks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import dealt


def _hashed(*parts: Column) -> Column:
    """SHA-256 of the parts with a bar between them; folds follow its order, so any executor repeats them."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def hash_folds(cases: DataFrame, folds: int, seed: int, repeats: int = 1, key: str = "case_id", label: str = "label", alias: str = "fold") -> DataFrame:
    """A fold for each case and repeat: position, modulo the folds, in the order of sha256(seed|repeat|label|case) inside its label."""
    rows = cases.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    order = _hashed(F.lit(seed), F.col("repeat"), F.col(label), F.col(key))
    return dealt(rows, ["repeat", label], order, key, "__place").withColumn(alias, F.pmod("__place", F.lit(folds))).drop("__place")


def inner_hash_folds(cases: DataFrame, folds: int, seed: int, key: str = "case_id", label: str = "label", alias: str = "inner_fold") -> DataFrame:
    """The same from sha256(seed|case), once."""
    return dealt(cases, [label], _hashed(F.lit(seed), F.col(key)), key, "__place").withColumn(alias, F.pmod("__place", F.lit(folds))).drop("__place")


def stable_seed(seed: int, token: str) -> int:
    """The first eight bytes of sha256(seed|token) as a number."""
    return int.from_bytes(hashlib.sha256(f"{seed}|{token}".encode()).digest()[:8], "big")


def _groups(cases: DataFrame, group: str, label: str) -> DataFrame:
    """(group_id, label, n); a group whose cases have several labels is an error."""
    groups = cases.groupBy(F.col(group).cast("string").alias("group_id")).agg(F.count_distinct(label).alias("labels"), F.min(F.col(label).cast("string")).alias("label"), F.count("*").alias("n"))
    if not groups.where("labels <> 1").isEmpty():
        raise ValueError("a group has conflicting labels")
    return groups.select("group_id", "label", "n")


def _rounds(cases: Sequence[int], ahead: Sequence[int], size: int, count: int) -> tuple[list[int], list[tuple[int, list[int]]]]:
    """Deals ``count`` groups of one size, each to the fold with the fewest ``cases``, then the least ``ahead``, then the first.

    Fold f takes its k-th group when f's key (cases + k * size, ahead, f) is the least, so the deal is
    the merge of the folds' keys: round the folds that have started, in an order that stays the same until
    one more starts. Returns what each fold takes and the rounds: the place from which one holds, and its folds.
    """
    begins = sorted(range(len(cases)), key=lambda f: (cases[f], ahead[f], f))
    taken, rounds, place = [0] * len(cases), [], 0
    for started, last in enumerate(begins, 1):
        ring = sorted(begins[:started], key=lambda f: (cases[f] + taken[f] * size, ahead[f], f))
        room = count - place
        if started < len(begins):
            following = begins[started]
            gaps = [(f, cases[following] - cases[f] - taken[f] * size) for f in ring]
            room = min(room, sum(-(-gap // size) + (gap % size == 0 and (ahead[f], f) < (ahead[following], following)) for f, gap in gaps if gap >= 0))
        if room:
            rounds.append((place, ring))
            each, rest = divmod(room, len(ring))
            for k, f in enumerate(ring):
                taken[f] += each + (k < rest)
            place += room
    return taken, rounds


def greedy_rounds(histogram: Iterable[tuple[str, int, int]], folds: int) -> list[tuple[str, int, list[tuple[int, list[int]]]]]:
    """How the groups of each (label, size) are dealt by ``_rounds``, large ones first, then by label: to the fold with the fewest cases of the label, then the fewest cases, then the first."""
    own: dict[str, list[int]] = {}
    whole, out = [0] * folds, []
    for label, size, count in sorted(histogram, key=lambda h: (-h[1], h[0])):
        cases = own.setdefault(label, [0] * folds)
        taken, rounds = _rounds(cases, [w - c for w, c in zip(whole, cases, strict=True)], size, count)
        for f, n in enumerate(taken):
            cases[f] += n * size
            whole[f] += n * size
        out.append((label, size, rounds))
    return out


def _group_folds(groups: DataFrame, folds: int, seeds: Column, alias: str, by: Sequence[str] = (), each_label: bool = False) -> DataFrame:
    """Groups dealt greedily: large ones first, equal ones by label, then in the order of sha256(seed|group).

    Groups of one label and size are interchangeable, so the greedy deal needs their number only: the
    histogram of labels and sizes comes to the driver (its sizes add up to at most the cases, so that there
    are no more different ones than the square root of twice their number), and the rounds go back.
    ``each_label`` refuses a label with fewer groups than folds.
    """
    counts = groups.groupBy(*by, "label", "n").agg(F.count("*").alias("groups")).collect()
    parts: dict[tuple, list[tuple[str, int, int]]] = {}
    for row in counts:
        parts.setdefault(tuple(row[c] for c in by), []).append((row["label"], row["n"], row["groups"]))
    for histogram in parts.values() if each_label else ():
        labels: dict[str, int] = {}
        for label, _, number in histogram:
            labels[label] = labels.get(label, 0) + number
        if min(labels.values()) < folds:
            raise ValueError("at least two folds, and for each label a group in every fold")
    kinds = dict(groups.dtypes)
    rounds = [(*part, label, size, [(place, ring) for place, ring in found]) for part, histogram in parts.items() for label, size, found in greedy_rounds(histogram, folds)]
    keys = [*by, "label", "n"]
    dealing = groups.sparkSession.createDataFrame(rounds, ", ".join(f"__d_{c} {kinds[c]}" for c in keys) + ", __rounds array<struct<place:bigint,ring:array<int>>>")
    placed = dealt(groups, keys, _hashed(seeds, F.col("group_id")), "group_id", "__place")
    match = F.lit(True)
    for c in keys:
        match = match & placed[c].eqNullSafe(dealing[f"__d_{c}"])
    own = F.element_at(F.filter("__rounds", lambda r: r["place"] <= F.col("__place")), -1)
    fold = F.get(own["ring"], F.pmod(F.col("__place") - own["place"], F.size(own["ring"])).cast("int"))
    return placed.join(dealing, match).withColumn(alias, fold).drop("__place", "__rounds", *[f"__d_{c}" for c in keys])


def nested_group_folds(cases: DataFrame, outer: int, inner: int, seed: int, key: str = "case_id", group: str = "patient_group_id", label: str = "label") -> DataFrame:
    """(outer_fold, inner_fold, group_id, role): inner_fold null for the outer test groups.

    Groups go to the fold with the fewest cases of their label, and once more among those that an outer
    fold trains on, by a seed of its own. Rows join the result on the group, so that no group can be on both sides of a fold.
    """
    groups = _groups(cases, group, label)
    if min(outer, inner) < 2 or groups.isEmpty():
        raise ValueError("at least two folds, and for each label a group in every fold")
    placed = _group_folds(groups, outer, F.lit(seed), "__own", each_label=True).withColumn("outer_fold", F.explode(F.sequence(F.lit(0), F.lit(outer - 1))))
    test = placed.where("__own = outer_fold").select("outer_fold", F.lit(None).cast("int").alias("inner_fold"), "group_id", F.lit("test").alias("role"))
    seeds = F.element_at(F.array(*[F.lit(str(stable_seed(seed, f"outer-{k}"))) for k in range(outer)]), F.col("outer_fold") + 1)
    train = _group_folds(placed.where("__own <> outer_fold"), inner, seeds, "inner_fold", ["outer_fold"], each_label=True)
    return test.unionByName(train.select("outer_fold", "inner_fold", "group_id", F.lit("train").alias("role")))


def group_hash_folds(cases: DataFrame, folds: int, seed: int, group: str = "patient_group_id", label: str = "label", alias: str = "fold") -> DataFrame:
    """Folds of whole groups, as an outer fold of the nested ones; of several labels of a group the greatest counts."""
    groups = cases.groupBy(F.col(group).alias("__g")).agg(F.max(F.col(label).cast("string")).alias("label"), F.count("*").alias("n")).withColumn("group_id", F.col("__g").cast("string"))
    placed = _group_folds(groups, folds, F.lit(seed), "__fold").select("__g", F.col("__fold").alias(alias))
    return cases.join(placed, cases[group] == placed["__g"]).drop("__g")


def split_violations(assigned: DataFrame, folds: int, key: str = "case_id", group: str = "patient_group_id", fold: str = "fold") -> DataFrame:
    """What is wrong with an assignment: cases in no or several folds, groups in several, folds without cases."""
    per_case = assigned.groupBy(key).agg(F.count_distinct(fold).alias("n")).where("n <> 1").select(F.lit("case_not_in_one_fold").alias("rule"), F.col(key).cast("string").alias("subject"))
    per_group = assigned.groupBy(group).agg(F.count_distinct(fold).alias("n")).where("n > 1").select(F.lit("group_crosses_folds").alias("rule"), F.col(group).cast("string").alias("subject"))
    expected = assigned.sparkSession.range(folds).select(F.col("id").cast("int").alias(fold))
    empty = expected.join(assigned.select(fold).distinct(), fold, "left_anti").select(F.lit("fold_without_cases").alias("rule"), F.col(fold).cast("string").alias("subject"))
    return per_case.union(per_group).union(empty)


def restricted(assigned: DataFrame, allowed: DataFrame, key: str = "case_id") -> DataFrame:
    """An assignment cut to a universe of cases; no case changes its fold."""
    return assigned.join(allowed.select(key).distinct(), key, "left_semi")


def outer_train(assigned: DataFrame, fold: str = "fold", folds: int = 5, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """(part, keys): for each fold the rows of all others."""
    return assigned.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where(F.col(fold) != F.col("part")).select("part", *keys)
