"""Running totals and scans over the order of a column without one task holding a group.

Values are cut into ranges by approximate quantiles; totals of ranges are added up first (a few
hundred rows a group), then rows inside ranges. Any group, also the whole table, is spread
over as many tasks as there are ranges, and the result is exact whatever the cuts are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Ranges into which each group's values are cut, at least and at most; between that, as many as a shuffle of the session has partitions.
RANGES, MOST_RANGES = 64, 8192
_BELOW = (Window.unboundedPreceding, -1)


#: The columns that say which range of which group a row is in; ``running_totals`` keeps them if asked, ``scanned`` takes them.
RANGE = ("__group", "__range")


def running_totals(levels: DataFrame, by: Sequence[str], value: str, columns: Sequence[str], ranges: int | None = None, keep_ranges: bool = False) -> DataFrame:
    """Adds, for rows with distinct non-null values in a group, what the columns add up to.

    <c>_below: over smaller values; <c>_all: over the group; next_value: the next larger value;
    is_first: whether there is no smaller one. ``keep_ranges`` leaves the columns of ``RANGE`` for scans over the same order.
    """
    ranges = ranges or min(MOST_RANGES, max(RANGES, int(levels.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    keys = ["__group"]
    rows = levels.withColumn("__group", F.xxhash64(*by) if by else F.lit(0).cast("bigint"))
    cuts = rows.groupBy(*keys).agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 16 * ranges).alias("__cuts"))
    placed = rows.join(cuts, keys).withColumn("__range", F.size(F.filter("__cuts", lambda c: c <= F.col(value)))).drop("__cuts")
    parts = [*keys, *by, "__range"]
    totals = placed.groupBy(*parts).agg(*[F.sum(c).alias(f"__t_{c}") for c in columns], F.min(value).alias("__low"))
    across = Window.partitionBy(*keys, *by)
    order = across.orderBy("__range")
    totals = totals.select(*parts, F.lead("__low").over(order).alias("__next_low"), (F.row_number().over(order) == 1).alias("__first_range"), *[F.coalesce(F.sum(f"__t_{c}").over(order.rowsBetween(*_BELOW)), F.lit(0)).alias(f"__b_{c}") for c in columns], *[F.sum(f"__t_{c}").over(across).alias(f"{c}_all") for c in columns])
    joined = _with_totals(placed, totals, parts)
    inside = Window.partitionBy(*parts).orderBy(value)
    out = joined.withColumns({f"{c}_below": F.col(f"__b_{c}") + F.coalesce(F.sum(c).over(inside.rowsBetween(*_BELOW)), F.lit(0)) for c in columns} | {"next_value": F.coalesce(F.lead(value).over(inside), F.col("__next_low")), "is_first": F.col("__first_range") & (F.row_number().over(inside) == 1)})
    return out.drop(*([] if keep_ranges else RANGE), "__next_low", "__first_range", *[f"__b_{c}" for c in columns])


def _with_totals(rows: DataFrame, totals: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Rows with their range's columns of ``totals``; parts may be null."""
    renamed = totals.select(*[F.col(c).alias(f"__j_{c}") for c in parts], *[c for c in totals.columns if c not in parts])
    match = F.lit(True)
    for c in parts:
        match = match & rows[c].eqNullSafe(F.col(f"__j_{c}"))
    return rows.join(renamed, match).drop(*[f"__j_{c}" for c in parts])


@dataclass(frozen=True)
class Scan:
    """What an associative operation (sum, max or min) makes of a column over all smaller (``below``) or larger values; nulls take no part, null over none.

    Columns of max and min may be structs, which are compared field by field.
    """

    column: str
    how: str
    below: bool = True


#: How an aggregate of a range and what lies before or behind it go together.
_JOINED = {"sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b), "max": F.greatest, "min": F.least}
_AGGREGATES = {"sum": F.sum, "max": F.max, "min": F.min}


def scanned(placed: DataFrame, by: Sequence[str], value: str, scans: Mapping[str, Scan]) -> DataFrame:
    """Adds each scan under its alias to rows that ``running_totals`` left with their ranges.

    Ranges are aggregated first, their aggregates (at most ``MOST_RANGES`` a group) are scanned, then
    the rows inside ranges; so no task holds a group, whatever the operation.
    """
    parts = [RANGE[0], *by, RANGE[1]]
    totals = placed.groupBy(*parts).agg(*[_AGGREGATES[s.how](s.column).alias(f"__t_{a}") for a, s in scans.items()])

    def over(s: Scan, column: str, window: WindowSpec, order: str) -> Column:
        # larger values are those before a row in the reversed order: a frame up to the end would be added up anew for each row
        return _AGGREGATES[s.how](column).over(window.orderBy(F.asc(order) if s.below else F.desc(order)).rowsBetween(*_BELOW))

    across, inside = Window.partitionBy(RANGE[0], *by), Window.partitionBy(*parts)
    totals = totals.select(*parts, *[over(s, f"__t_{a}", across, RANGE[1]).alias(f"__o_{a}") for a, s in scans.items()])
    joined = _with_totals(placed, totals, parts)
    return joined.withColumns({a: _JOINED[s.how](F.col(f"__o_{a}"), over(s, s.column, inside, value)) for a, s in scans.items()}).drop(*[f"__o_{a}" for a in scans])


def dealt(rows: DataFrame, by: Sequence[str], order: Column, key: str, alias: str, cell: Column | None = None) -> DataFrame:
    """Adds each row's place (from 0) in its group in the order of a text or another value, equal ones by ``key``.

    ``cell`` is a beginning of that value, of a text its first three characters unless given: rows are counted by
    cell, the cells' counts are added up, and rows are ranked inside cells, so that no task ranks a whole group.
    """
    placed = rows.withColumn("__order", order)
    placed = placed.withColumn("__cell", F.substring("__order", 1, 3) if cell is None else cell)
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__cell").rowsBetween(*_BELOW)), F.lit(0))
    cells = placed.groupBy(*by, "__cell").agg(F.count("*").alias("__n")).select(*[F.col(c).alias(f"__j_{c}") for c in (*by, "__cell")], before.alias("__before"))
    match = F.lit(True)
    for c in (*by, "__cell"):
        match = match & placed[c].eqNullSafe(cells[f"__j_{c}"])
    inside = F.row_number().over(Window.partitionBy(*by, "__cell").orderBy("__order", key))
    return placed.join(cells, match).withColumn(alias, F.col("__before") + inside - 1).drop("__order", "__cell", "__before", *[f"__j_{c}" for c in (*by, "__cell")])
