"""Pareto skylines.

Dominated means: another row is at least as good everywhere and better somewhere. Equal rows stand
together. A row dominated within any subset is dominated overall, so subsets are reduced first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def mark_pareto(candidates: str, quality: str = "quality", cost: str = "cost", latency: str = "latency") -> Column:
    """For an array of candidate structs of bounded size: array of booleans, True where undominated."""
    return F.expr(
        f"""transform({candidates}, c -> NOT exists({candidates}, o ->
              o.{quality} >= c.{quality} AND o.{cost} <= c.{cost} AND o.{latency} <= c.{latency}
              AND (o.{quality} > c.{quality} OR o.{cost} < c.{cost} OR o.{latency} < c.{latency})))"""
    )


def _skyline_points(points: DataFrame, groups: list[str], up: str, down: str) -> DataFrame:
    """Undominated (up, down) points, given one row per group and ``up`` value with its least ``down``."""
    better = Window.partitionBy(*groups).orderBy(F.col(up).desc()).rowsBetween(Window.unboundedPreceding, -1)
    return points.withColumn("_best", F.min(down).over(better)).where(
        F.col("_best").isNull() | (F.col(down) < F.col("_best"))
    ).drop("_best")


def skyline(rows: DataFrame, groups: list[str], up: str, down: str, tiles: int = 64) -> DataFrame:
    """Rows no other row of their group dominates: ``up`` as large, ``down`` as small as possible.

    No pairs are formed. One row per (group, up) value survives the first, map-side combined,
    aggregate. Those are reduced per tile of a group before tiles meet, and the surviving points,
    few by nature, select the rows.
    """
    best = rows.groupBy(*groups, up).agg(F.min(down).alias(down))
    tiled = best.withColumn("_tile", F.pmod(F.xxhash64(up), F.lit(tiles)))
    local = _skyline_points(tiled, [*groups, "_tile"], up, down).drop("_tile")
    points = _skyline_points(local, groups, up, down)
    return rows.join(points, [*groups, up, down], "left_semi")
