"""Point sets by group: component labelling, shape from covariance, box cover, nearest distances."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .index import stored
from .order import dealt


#: Edge of the cubes into which masks are cut; a task labels the points of one, at most its cube.
TILE = 64


def _steps(neighbours: int) -> list[tuple[int, int, int]]:
    """One of each two opposite steps to a neighbour."""
    most = {6: 1, 18: 2, 26: 3}[neighbours]
    return [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if 0 < abs(a) + abs(b) + abs(c) <= most and (a, b, c) > (0, 0, 0)]


def _roots(flat: np.ndarray, apart: Sequence[int]) -> np.ndarray:
    """For ascending numbers, the place of the first one that each is joined to, where those so far apart are joined."""
    parent = np.arange(len(flat))
    for step in apart:
        other = flat + step
        place = np.minimum(np.searchsorted(flat, other), len(flat) - 1)
        pairs = np.flatnonzero(flat[place] == other)
        a, b = pairs, place[pairs]
        while len(a):  # join by the smaller root until all pairs agree
            ra, rb = parent[a], parent[b]
            while (parent[ra] != ra).any():
                ra = parent[ra]
            while (parent[rb] != rb).any():
                rb = parent[rb]
            differ = ra != rb
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
    while (parent[parent] != parent).any():
        parent = parent[parent]
    return parent


def _tiles_labelled(steps: Sequence[tuple[int, int, int]], tile: int, most: int = 1 << 18):
    """Rows (group, cube, places in the cube), sorted, as a row a component of a cube: group, cube, its first place, its places.

    Many cubes are labelled at once; of what came, whole cubes go on and the last, which may go on, is kept.
    """
    edge = tile + 2  # cubes stand apart by a layer on each side
    apart = [(z * edge + y) * edge + x for z, y, x in steps]

    def label(part: pa.RecordBatch, number: np.ndarray) -> pa.RecordBatch:
        cell = part.column(4).to_numpy()
        fresh = np.concatenate(([True], (cell[1:] != cell[:-1]) | (number[1:] != number[:-1])))
        rows, cell = np.flatnonzero(fresh), cell[fresh].astype(np.int64)
        z, y, x = cell // tile**2, cell // tile % tile, cell % tile
        root = _roots(((number[rows].astype(np.int64) * edge + z + 1) * edge + y + 1) * edge + x + 1, apart)
        order = np.argsort(root, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], root[order][1:] != root[order][:-1])))
        cells = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), pa.array(cell[order].astype(np.int32)))
        own = part.take(pa.array(rows[order[first]]))
        return pa.record_batch([*own.columns, cells], names=[*own.schema.names, "cells"])

    def numbers(rows: pa.RecordBatch) -> np.ndarray:
        """Of the cube of each row."""
        new = np.zeros(rows.num_rows, dtype=bool)
        for column in rows.columns[:4]:
            codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        return np.cumsum(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < most:
                continue
            rows = pa.concat_batches(held)
            number = numbers(rows)
            end = int(np.searchsorted(number, number[-1]))
            held = [rows.slice(end)]
            if end:
                yield label(rows.slice(0, end), number[:end])
        if held and sum(b.num_rows for b in held):
            rows = pa.concat_batches(held)
            yield label(rows, numbers(rows))

    return run


def _contracted(links: DataFrame, by: str) -> DataFrame:
    """(by, node, least) for the nodes of links (by, a, b): the least node that can be reached, by least labels of neighbours and labels of labels, a stored table a round."""
    both = stored(links.unionByName(links.select(by, F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "tile-links")
    labels = stored(both.groupBy(by, F.col("a").alias("node")).agg(F.min("b").alias("b")).select(by, "node", F.least("node", "b").alias("least")), "tile-labels")
    while True:
        near = both.join(labels.select(by, F.col("node").alias("b"), "least"), [by, "b"]).groupBy(by, F.col("a").alias("node")).agg(F.min("least").alias("near"))
        taken = labels.join(near, [by, "node"]).select(by, "node", F.col("least").alias("old"), F.least("least", "near").alias("least"))
        jumps = labels.select(by, F.col("node").alias("least"), F.col("least").alias("next"))
        labels = stored(taken.join(jumps, [by, "least"]).select(by, "node", F.least("least", "next").alias("least"), (F.least("least", "next") != F.col("old")).alias("moved")), "tile-labels")
        if labels.where("moved").isEmpty():
            return labels.drop("moved")


def connected_components(points: DataFrame, by: str, least: int = 1, neighbours: int = 18, tile: int = TILE) -> DataFrame:
    """(group, component, z, y, x): points of one mask joined over faces and edges (18), faces (6) or corners too (26); small components go.

    Components are numbered in the order of their first point. Masks are cut into cubes of edge ``tile``,
    whose points are labelled by themselves; what touches across cubes is linked, and the links are
    contracted, so that a mask of any size is spread over tasks. A label is the first point of its
    component; the contraction needs no other name. Repeated points are one; points with a null are left out.
    """
    steps = _steps(neighbours)
    axes = ["z", "y", "x"]
    cubes = [f"__{c}" for c in axes]
    kinds = dict(points.dtypes)

    def placed(cell: Column) -> list[Column]:
        """Coordinates of a place in its row's cube."""
        inside = {"z": F.floor(cell / F.lit(tile * tile)), "y": F.floor(cell / F.lit(tile)) % tile, "x": cell % tile}
        return [(F.col(f"__{c}") * tile + inside[c]).cast(kinds[c]).alias(c) for c in axes]

    whole = F.lit(True)
    for c in axes:
        whole = whole & F.col(c).isNotNull()
    cell = F.lit(0)
    for c in axes:
        cell = cell * tile + F.pmod(F.col(c), F.lit(tile)).cast("int")
    rows = points.where(whole).select(by, *axes).distinct().select(by, *[F.floor(F.col(c) / F.lit(tile)).cast("bigint").alias(f"__{c}") for c in axes], cell.cast("int").alias("cell"))
    rows = rows.repartition(by, *cubes).sortWithinPartitions(by, *cubes, "cell")
    tiled = rows.mapInArrow(_tiles_labelled(steps, tile), f"`{by}` {kinds[by]}, {', '.join(f'`{c}` bigint' for c in cubes)}, cell int, cells array<int>")
    tiled = stored(tiled.select(by, *cubes, F.struct(*placed(F.col("cell"))).alias("node"), "cells"), "tiles")
    # a step leads out of its cube from an outer layer only, and only masks of several cubes have others, so few points are looked up
    cube = F.struct(*cubes)
    several = tiled.groupBy(by).agg((F.min(cube) != F.max(cube)).alias("several")).where("several").select(by)
    outer, moved = F.lit(False), F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(axes, step, strict=True)]) for step in steps])
    for c in axes:
        outer = outer | F.pmod(F.col(c), F.lit(tile)).isin(0, tile - 1)
    rim = tiled.join(several, by, "left_semi").select(by, *cubes, "node", F.explode("cells").alias("cell")).select(by, "node", *placed(F.col("cell"))).where(outer)
    ways = rim.select(by, F.col("node").alias("a"), *[F.col(c).alias(f"o{c}") for c in axes], F.explode(moved).alias("s")).select(by, "a", *[(F.col(f"o{c}") + F.col(f"s.{c}")).cast(kinds[c]).alias(c) for c in axes], *[F.floor(F.col(f"o{c}") / F.lit(tile)).alias(f"t{c}") for c in axes])
    across = F.lit(False)
    for c in axes:
        across = across | (F.floor(F.col(c) / F.lit(tile)) != F.col(f"t{c}"))
    links = ways.where(across).join(rim.select(by, *axes, F.col("node").alias("b")), [by, *axes]).select(by, "a", "b").where(F.col("a") != F.col("b"))
    nodes = tiled.select(by, "node", F.size("cells").cast("bigint").alias("n"))
    named = stored(nodes.join(_contracted(links, by), [by, "node"], "left").withColumn("first", F.coalesce("least", "node")).drop("least"), "tile-nodes")
    sizes = named.groupBy(by, "first").agg(F.sum("n").alias("size"))
    # stored, as one stage of windows and joins would hold the sorted rows of all of them at once
    numbers = stored(dealt(sizes, [by], F.col("first"), "first", "__place", cell=F.col("first.z")).where(F.col("size") >= least).select(by, "first", (F.col("__place") + 1).alias("component")), "tile-numbers")
    labelled = stored(named.select(by, "node", "first").join(numbers, [by, "first"]).select(by, "node", "component"), "tile-components")
    labelled = stored(tiled.join(labelled, [by, "node"]).select(by, "component", *cubes, "cells"), "labelled-tiles")
    return labelled.select(by, "component", *cubes, F.explode("cells").alias("cell")).select(by, "component", *placed(F.col("cell")))


def component_shapes(points: DataFrame, by: list[str], spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Linearity, planarity, sphericity, axis ratio and box fill of each component of four points or more.

    Covariances are sums that Spark adds up; only the 3 x 3 eigenvalues are left to numpy, row by row in batches.
    """
    z, y, x = (F.col(c) * s for c, s in zip("zyx", spacing, strict=True))
    pairs = {"zz": (z, z), "zy": (z, y), "zx": (z, x), "yy": (y, y), "yx": (y, x), "xx": (x, x)}
    box = F.lit(1)
    for c in "zyx":
        box = box * (F.max(c) - F.min(c) + 1)
    sums = points.groupBy(*by).agg(F.count("*").alias("voxels"), box.alias("box"), *[F.covar_samp(a, b).alias(name) for name, (a, b) in pairs.items()]).where("voxels >= 4")

    @F.pandas_udf("struct<major:double,middle:double,minor:double>")
    def eigen(zz: pd.Series, zy: pd.Series, zx: pd.Series, yy: pd.Series, yx: pd.Series, xx: pd.Series) -> pd.DataFrame:
        matrix = np.stack([np.stack([zz, zy, zx], -1), np.stack([zy, yy, yx], -1), np.stack([zx, yx, xx], -1)], axis=1)
        values = np.sort(np.maximum(np.linalg.eigvalsh(matrix), 1e-9), axis=1) if len(matrix) else np.zeros((0, 3))
        return pd.DataFrame({"major": values[:, 2], "middle": values[:, 1], "minor": values[:, 0]})

    out = sums.withColumn("e", eigen("zz", "zy", "zx", "yy", "yx", "xx"))
    major, middle, minor = F.col("e.major"), F.col("e.middle"), F.col("e.minor")
    return out.select(*by, "voxels", (1 - middle / major).alias("linearity"), ((middle - minor) / major).alias("planarity"), (minor / major).alias("sphericity"), F.sqrt(major / minor).alias("axis_ratio"), (F.col("voxels") / F.col("box")).alias("bbox_fill"))


def shape_features(shapes: DataFrame, by: str) -> DataFrame:
    """Per mask: components, total size, share of the largest, and each shape feature of the largest and weighted by size."""
    names = ["linearity", "planarity", "sphericity", "axis_ratio", "bbox_fill"]
    window = Window.partitionBy(by).orderBy(F.desc("voxels"), "component")
    ranked = shapes.withColumn("__r", F.row_number().over(window))
    first = [F.max(F.when(F.col("__r") == 1, F.col(n))).alias(f"largest_{n}") for n in names]
    weighted = [(F.sum(F.col("voxels") * F.col(n)) / F.sum("voxels")).alias(f"weighted_{n}") for n in names]
    return ranked.groupBy(by).agg(F.count("*").alias("components"), F.sum("voxels").alias("voxels"), (F.max("voxels") / F.sum("voxels")).alias("largest_fraction"), F.max("linearity").alias("max_linearity"), *first, *weighted)


def box_cover(points: DataFrame, by: list[str], size: tuple[int, int, int]) -> DataFrame:
    """The grid boxes, counted from each component's least corner, that hold its points."""
    corner = points.groupBy(*by).agg(*[F.min(c).alias(f"__{c}") for c in "zyx"])
    cell = [F.floor((F.col(c) - F.col(f"__{c}")) / s).cast("int").alias(f"b{c}") for c, s in zip("zyx", size, strict=True)]
    return points.join(corner, by).select(*by, *cell).distinct()


def nearest_distance(points: DataFrame, targets: DataFrame, cell: float, by: str = "role") -> DataFrame:
    """The least distance from each target set to the points, both with z, y, x.

    Cubes of both sides are halved until they are ``cell`` wide or less, all sets at once. What is kept of a
    level are pairs of cubes whose nearest sides are no farther apart than the farthest corners of the
    set's best pair; the next level looks into these alone. Points meet points only in the last pairs.
    Each level is written to the shared folder; the driver sees the bounds of all coordinates, no rows.

    Cases: points with a null or non-finite coordinate and targets without a set take no part; repeated points
    count once; a set without targets, or any set where there are no points, gives no row; other columns are not read.
    """
    axes, far = "zyx", float("inf")

    def clean(df: DataFrame, *more: str) -> DataFrame:
        usable = F.lit(True)
        for c in axes:
            usable = usable & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < far)
        for c in more:
            usable = usable & F.col(c).isNotNull()
        return df.select(*more, *[F.col(c).cast("double").alias(c) for c in axes]).where(usable)

    points, targets = clean(points), clean(targets, by)
    low, span, levels = _frame(points.unionByName(targets.drop(by)), cell)
    at = lambda c: F.least(F.floor((F.col(c) - F.lit(low[c])) / F.lit(span) * F.lit(float(1 << levels))).cast("bigint"), F.lit((1 << levels) - 1))
    cube = lambda level, name: F.struct(*[F.shiftright(at(c), levels - level).alias(c) for c in axes]).alias(name)
    up = lambda name: F.struct(*[F.shiftright(f"{name}.{c}", 1).alias(c) for c in axes])
    pairs = targets.select(by, cube(0, "t")).distinct().select(by, "t", F.col("t").alias("p"), F.lit(far).alias("best"))
    # a coordinate that rounding puts on the wrong side of a wall is off by far less than this share of a cube
    within = lambda best: F.sqrt("near") <= F.sqrt(best) + F.lit(1e-3)
    for level in range(1, levels + 1):
        mine = targets.select(by, cube(level, "tc")).distinct().withColumn("t", up("tc"))
        theirs = points.select(cube(level, "pc")).distinct().withColumn("p", up("pc"))
        near, most = F.lit(0.0), F.lit(0.0)
        for c in axes:
            apart = F.abs(F.col(f"tc.{c}") - F.col(f"pc.{c}")).cast("double")
            near, most = near + F.pow(F.greatest(apart - 1, F.lit(0.0)), 2), most + F.pow(apart + 1, 2)
        children = pairs.join(mine, [by, "t"]).join(theirs, "p").select(by, F.col("tc").alias("t"), F.col("pc").alias("p"), near.alias("near"), most.alias("most"), "best")
        found = stored(children.where(within(F.col("best") * 4)).drop("best"), "cubes")
        best = found.groupBy(by).agg(F.min("most").alias("best"))
        pairs = found.join(best, by).where(within(F.col("best"))).select(by, "t", "p", "best")
    d = F.sqrt(F.pow(F.col("z") - F.col("tz"), 2) + F.pow(F.col("y") - F.col("ty"), 2) + F.pow(F.col("x") - F.col("tx"), 2))
    mine = targets.distinct().select(by, cube(levels, "t"), *[F.col(c).alias(f"t{c}") for c in axes])
    theirs = points.distinct().select(cube(levels, "p"), *axes)
    return pairs.join(mine, [by, "t"]).join(theirs, "p").groupBy(by).agg(F.min(d).alias("distance"))


def _frame(points: DataFrame, cell: float) -> tuple[dict[str, float], float, int]:
    """Least coordinates, the edge of a cube around all points, and how often it is halved until it is ``cell`` or less; 40 halvings are still told apart by doubles."""
    ends = points.agg(*[f(c).alias(f"{name}{c}") for c in "zyx" for name, f in (("low", F.min), ("high", F.max))]).first()
    if ends.lowz is None:
        return dict.fromkeys("zyx", 0.0), 1.0, 1
    low = {c: ends[f"low{c}"] for c in "zyx"}
    span = max(ends[f"high{c}"] - low[c] for c in "zyx") or 1.0
    return low, span, min(max(1, math.ceil(math.log2(span / cell))), 40)
