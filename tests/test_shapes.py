import math
import random

import numpy as np
import pyarrow as pa
import pytest

from verdigris.operators import shapes


def brute(points, neighbours, least):
    most = {6: 1, 18: 2, 26: 3}[neighbours]
    out = []
    for mask in {p[0] for p in points}:
        left, number = sorted({p[1:] for p in points if p[0] == mask}), 0
        free = set(left)
        for start in left:
            if start not in free:
                continue
            number += 1
            free.discard(start)
            found, edge = [start], [start]
            while edge:
                z, y, x = edge.pop()
                for a in (-1, 0, 1):
                    for b in (-1, 0, 1):
                        for c in (-1, 0, 1):
                            q = (z + a, y + b, x + c)
                            if abs(a) + abs(b) + abs(c) <= most and q in free:
                                free.discard(q)
                                found.append(q)
                                edge.append(q)
            if len(found) >= least:
                out += [(mask, number, *p) for p in found]
    return sorted(out)


@pytest.mark.parametrize(("neighbours", "tile", "least", "share"), [(6, 3, 1, 0.35), (18, 4, 3, 0.15), (26, 2, 2, 0.1), (18, 64, 1, 0.2)])
def test_components_equal_a_flood_fill(spark, neighbours, tile, least, share):
    draw = random.Random(neighbours * tile)
    points = [(m, z, y, x) for m in ("a", "b") for z in range(-5, 6) for y in range(-4, 5) for x in range(-6, 7) if draw.random() < share]
    df = spark.createDataFrame(points + points[:20], "mask string, z int, y int, x int").repartition(6)
    assert sorted(tuple(r) for r in shapes.connected_components(df, "mask", least, neighbours, tile).collect()) == brute(points, neighbours, least)


@pytest.mark.parametrize("size", [1, 5, 1000])
def test_many_cubes_are_labelled_together(size):
    """Cubes of many masks in one pass, whatever batches and cubes' ends come together; one group of rows a cube took a call each."""
    draw = random.Random(size)
    cubes = [(mask, cube, 0, 0) for mask in (None, 1, 2, 3) for cube in (-1, 0)]
    points = [(*c, cell) for c in cubes for cell in range(64) for _ in range(draw.choice([0, 0, 1, 2]))]
    columns = [pa.array(v, pa.int32() if k == 4 else pa.int64()) for k, v in enumerate(zip(*points, strict=True))]
    whole = pa.record_batch(columns, names=["mask", "__z", "__y", "__x", "cell"])
    found = []
    for batch in shapes._tiles_labelled(shapes._steps(18), 4, 7)(whole.slice(k, size) for k in range(0, len(points), size)):
        found += [((r["mask"], r["__z"], r["__y"], r["__x"]), r["cell"], r["cells"]) for r in batch.to_pylist()]
    wanted = []
    for c in cubes:
        parts = {}
        for _, number, *at in brute([(0, *np.unravel_index(p[4], (4, 4, 4))) for p in points if p[:4] == c], 18, 1):
            parts.setdefault(number, []).append(int(np.ravel_multi_index(at, (4, 4, 4))))
        wanted += [(c, min(cells), sorted(cells)) for cells in parts.values()]
    assert sorted(found, key=str) == sorted(wanted, key=str)


def test_one_long_body_over_many_tiles(spark):
    # a snake through all rows of a plane, joined at alternating ends, and one point apart
    rows = spark.range(200 * 200).selectExpr("'m' as mask", "0 as z", "cast(id div 200 as int) as r", "cast(id % 200 as int) as x")
    snake = rows.selectExpr("mask", "z", "2 * r as y", "x").union(rows.where("r < 199 and x = case when r % 2 = 0 then 199 else 0 end").selectExpr("mask", "z", "2 * r + 1", "x"))
    apart = spark.createDataFrame([("m", 5, 0, 0)], snake.schema)
    got = shapes.connected_components(snake.union(apart), "mask", neighbours=6, tile=16).groupBy("component").count().orderBy("component").collect()
    assert [tuple(r) for r in got] == [(1, 200 * 200 + 199), (2, 1)]
    assert shapes.connected_components(snake.limit(0), "mask").count() == 0


def nearest(points, targets):
    out = {}
    for role, *t in targets:
        for p in points:
            out[role] = min(out.get(role, math.inf), math.dist(t, p))
    return out


@pytest.mark.parametrize(("spread", "cell"), [(1.0, 0.01), (100.0, 8.0), (5.0, 1000.0), (1e6, 1.0)])
def test_nearest_distance_equals_all_pairs(spark, spread, cell):
    rng = random.Random(spread)
    at = lambda shift: tuple(rng.choice([rng.random(), rng.randint(0, 9) / 9]) * spread + shift for _ in "zyx")
    points = [at(0) for _ in range(120)] * 2
    targets = [(role, *at(shift)) for role, shift in (("a", 0), ("b", spread / 2), ("c", 30 * spread), ("d", -3 * spread)) for _ in range(50)] + [("e", *points[7])]
    got = shapes.nearest_distance(spark.createDataFrame(points, "z double, y double, x double"), spark.createDataFrame(targets, "role string, z double, y double, x double"), cell)
    assert {r.role: pytest.approx(r.distance, rel=1e-12) for r in got.collect()} == nearest(points, targets)


def test_nearest_distance_with_nulls_and_nothing(spark):
    points = spark.createDataFrame([(0.0, 0.0, None), (float("nan"), 0.0, 0.0), (1.0, 1.0, 1.0)], "z double, y double, x double")
    targets = spark.createDataFrame([("a", 1.0, 1.0, 3.0, 5), (None, 1.0, 1.0, 1.0, 5), ("b", None, 1.0, 1.0, 5), ("c", 1.0, float("inf"), 1.0, 5)], "role string, z double, y double, x double, p int")
    assert [tuple(r) for r in shapes.nearest_distance(points, targets, 1.0).collect()] == [("a", 2.0)]
    assert shapes.nearest_distance(points.limit(0), targets, 1.0).count() == 0 and shapes.nearest_distance(points, targets.limit(0), 1.0).count() == 0


def test_two_far_sets_are_not_compared_point_by_point(spark):
    """Two sheets of 40,000 points; all pairs would be 1.6 thousand million."""
    sheet = spark.range(40_000).selectExpr("double(id div 200) y", "double(id % 200) x")
    points, targets = sheet.selectExpr("0d z", "y", "x"), sheet.selectExpr("1 role", "100 + (y * y + x) / 1000 z", "y", "x")
    assert [tuple(r) for r in shapes.nearest_distance(points, targets, 4.0).collect()] == [(1, 100.0)]
