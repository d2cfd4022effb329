"""Rules over measured rows: endpoints of subtypes, shape contrasts, index to world, and the gates of masks, bodies and meshes with their reasons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The binary endpoint of each subtype.
ENDPOINTS = {"hcc": "positive", "fnh": "negative", "hemangioma": "negative", "hepatic_cyst": "negative"}
#: Least volume (ml), extents (mm) and share of the largest component of an organ's mask.
LEAST_VOLUME_ML, LEAST_AXIAL_MM, LEAST_INPLANE_MM, LEAST_FRACTION = 300.0, 60.0, 70.0, 0.90
#: The greatest volume error (percent) and surface deviation (in largest voxel edges) of a mesh.
MOST_VOLUME_ERROR, MOST_SURFACE_VOXELS = 2.0, 1.0


def endpoint(subtype: Column) -> Column:
    """positive or negative; a subtype outside the closed list is an error, a null one stays null."""
    known = F.element_at(F.create_map(*[F.lit(x) for item in ENDPOINTS.items() for x in item]), subtype)
    return F.when(subtype.isNull() | known.isNotNull(), known).otherwise(F.raise_error(F.concat(F.lit("unknown subtype: "), subtype)))


def in_unit(value: Column) -> Column:
    """The value if it is finite and from 0 to 1, else null; NaN is greater than any number."""
    return F.when(value.between(0.0, 1.0), value)


def shape_contrasts(planarity: Column, linearity: Column, sphericity: Column, fill: Column) -> Column:
    """Planarity less linearity, 1 less sphericity, and the filled share of the box; null where an input is out of range."""
    return F.struct((in_unit(planarity) - in_unit(linearity)).alias("planarity_contrast"), (1 - in_unit(sphericity)).alias("inverse_sphericity"), in_unit(fill).alias("bbox_fill"))


def world(index: Sequence[Column], origin: Sequence[float], spacing: Sequence[float], direction: Sequence[float]) -> list[Column]:
    """x, y and z in space of an array index (z, y, x): direction (nine numbers, row by row) times index times spacing, plus the origin."""
    steps = [index[2 - k] * F.lit(float(spacing[k])) for k in range(3)]
    return [F.lit(float(direction[3 * r])) * steps[0] + F.lit(float(direction[3 * r + 1])) * steps[1] + F.lit(float(direction[3 * r + 2])) * steps[2] + F.lit(float(origin[r])) for r in range(3)]


def _reasons(rules: Mapping[str, Column]) -> Column:
    return F.filter(F.array(*[F.when(F.coalesce(test, F.lit(True)), F.lit(name)) for name, test in rules.items()]), lambda r: r.isNotNull())


def mask_gate(masks: DataFrame) -> DataFrame:
    """Adds failure_reasons and gate_passed from same_geometry, volume_ml, extent_x, extent_y, extent_z (mm) and largest_fraction; what is null fails."""
    rules = {
        "geometry_mismatch": ~F.col("same_geometry"),
        "physical_volume_below_minimum": F.col("volume_ml") < LEAST_VOLUME_ML,
        "axial_extent_below_minimum": F.col("extent_z") < LEAST_AXIAL_MM,
        "inplane_extent_below_minimum": F.least("extent_x", "extent_y") < LEAST_INPLANE_MM,
        "excessive_fragmentation": F.col("largest_fraction") < LEAST_FRACTION,
    }
    return masks.withColumn("failure_reasons", _reasons(rules)).withColumn("gate_passed", F.size("failure_reasons") == 0)


def mesh_gate(meshes: DataFrame) -> DataFrame:
    """Adds volume_error_percent, surface_limit_mm, failure_reasons and gate_passed from mask_volume, mesh_volume, surface_p95_mm, largest_spacing_mm and watertight."""
    error = F.when(F.col("mask_volume") > 0, F.abs(F.col("mesh_volume") - F.col("mask_volume")) / F.col("mask_volume") * 100)
    out = meshes.withColumns({"volume_error_percent": error, "surface_limit_mm": F.col("largest_spacing_mm") * MOST_SURFACE_VOXELS})
    rules = {"volume_error": F.col("volume_error_percent") > MOST_VOLUME_ERROR, "surface_deviation": F.col("surface_p95_mm") > F.col("surface_limit_mm"), "not_watertight": ~F.col("watertight")}
    return out.withColumn("failure_reasons", _reasons(rules)).withColumn("gate_passed", F.size("failure_reasons") == 0)


def main_body(points: DataFrame, by: str, component: str = "component", least: float = LEAST_FRACTION) -> DataFrame:
    """Points of each mask's largest component if it has at least ``least`` of them; else all points, as a mask in pieces is not hidden.

    Adds fraction (of the largest) and isolated. Equal components: the smaller number.
    """
    sizes = points.groupBy(by, component).agg(F.count("*").alias("__n"))
    most = sizes.groupBy(by).agg(F.max(F.struct("__n", (-F.col(component)).alias("c"))).alias("__top"), F.sum("__n").alias("__all"), F.count("*").alias("__k"))
    most = most.select(F.col(by), (-F.col("__top.c")).alias("__largest"), (F.col("__top.__n") / F.col("__all")).alias("fraction"), (F.col("__k") > 1).alias("__several"))
    out = points.join(most, by).withColumn("isolated", F.col("__several") & (F.col("fraction") >= least))
    return out.where(~F.col("isolated") | (F.col(component) == F.col("__largest"))).drop("__largest", "__several")
