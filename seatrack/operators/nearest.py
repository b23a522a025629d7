"""Nearest of many segments for each point, by grids of growing cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatrack.functions.geo import EARTH_RADIUS_M, segment_distance

#: Up to so many segments every point is compared with all of them, as constants of the expression.
FEW = 32
#: Cell of the finest grid, and how cells grow from grid to grid until one holds the plane.
CELL_M, GROWTH, PLANE_M = 5_000.0, 4.0, 2 * math.pi * EARTH_RADIUS_M
#: A grid is broadcast up to so many rows (a cell's candidate segment each); a larger one is a shuffled join by cell.
MAX_BROADCAST_ROWS = 200_000
_SEGMENT = ["ord", "lane_id", "ax", "ay", "bx", "by"]


def local_xy(lat: Column, lon: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """Metres east and north of an origin in degrees, on the plane whose scale is true at the origin's latitude."""
    return F.radians(lon - lon0) * (math.cos(math.radians(lat0)) * EARTH_RADIUS_M), F.radians(lat - lat0) * EARTH_RADIUS_M


def _cells_of(segments: DataFrame, g: float) -> DataFrame:
    """(cx, cy, candidates): for each cell near a segment those segments that may be the nearest of a point in it and lie within g.

    Long segments are cut, so that a piece reaches a bounded number of cells.
    A segment stays unless another is nearer to every point of the cell.
    """
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    cut = segments.withColumn("pieces", F.greatest(F.lit(1), F.ceil(length / (4 * g)).cast("int"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    at = lambda a, b, i: F.col(a) + (F.col(b) - F.col(a)) * i / F.col("pieces")
    cover = lambda a, b: F.sequence(
        F.floor(F.least(at(a, b, F.col("i")), at(a, b, F.col("i") + 1)) / g - 1.001), F.floor(F.greatest(at(a, b, F.col("i")), at(a, b, F.col("i") + 1)) / g + 1.001)
    )
    dealt = cut.withColumn("cx", F.explode(cover("ax", "bx"))).withColumn("cy", F.explode(cover("ay", "by"))).select("cx", "cy", *_SEGMENT).distinct()
    far = segment_distance((F.col("cx") + 0.5) * g, (F.col("cy") + 0.5) * g, F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    half = g * math.sqrt(0.5) * (1 + 1e-9)
    near = dealt.withColumn("far", far).where(F.col("far") <= g + half)
    least = near.groupBy("cx", "cy").agg(F.min("far").alias("least"))
    kept = near.join(least, ["cx", "cy"]).where(F.col("far") <= F.col("least") + 2 * half)
    return kept.groupBy("cx", "cy").agg(F.collect_list(F.struct(*_SEGMENT)).alias("candidates"))


def nearest_segment(points: DataFrame, segments: DataFrame, lat0: float, lon0: float) -> DataFrame:
    """points with a struct column nearest (m, ord, lane_id) of the segment (ord, lane_id, a_lat, a_lon, b_lat, b_lon) at the least distance, the first by (ord, lane_id) of equal ones; null without segments or place.

    Segments are dealt to the cells of grids whose cells grow. A point asks its
    cell of the finest grid, and the next one only if nothing lies within a
    cell's width: all segments within it are known to the cell. The last grid
    knows every segment that may be nearest. Only points without a hit go
    on, as columns of the same row: there is no shuffle of points while the
    grids are small enough to be broadcast, which is checked, and no pairs.
    """
    ax, ay = local_xy(F.col("a_lat"), F.col("a_lon"), lat0, lon0)
    bx, by = local_xy(F.col("b_lat"), F.col("b_lon"), lat0, lon0)
    flat = segments.select("ord", "lane_id", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"))
    steps = [CELL_M * GROWTH**i for i in range(1 + math.ceil(math.log(PLANE_M / CELL_M, GROWTH)))]
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    told = flat.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.ceil(length / (4 * g)) + 1).alias(f"r{i}") for i, g in enumerate(steps)]).first()
    px, py = local_xy(F.col("lat"), F.col("lon"), lat0, lon0)
    distance = lambda s: segment_distance(px, py, s["ax"], s["ay"], s["bx"], s["by"])
    best = lambda some: F.array_min(F.transform(some, lambda s: F.struct(distance(s).alias("m"), s["ord"].alias("ord"), s["lane_id"].alias("lane_id"))))
    kinds = {f.name: f.dataType for f in flat.schema}
    placed = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    if told["n"] <= FEW:
        some = [F.struct(*[F.lit(r[c]).cast(kinds[c]).alias(c) for c in _SEGMENT]) for r in flat.collect()]  # FEW rows at most
        if not some:
            return points.withColumn("nearest", F.lit(None).cast(f"struct<m:double,ord:{kinds['ord'].simpleString()},lane_id:{kinds['lane_id'].simpleString()}>"))
        return points.withColumn("nearest", F.when(placed, best(F.array(*some))))
    out, found = points, F.lit(None).cast(f"struct<m:double,ord:{kinds['ord'].simpleString()},lane_id:{kinds['lane_id'].simpleString()}>")
    out = out.withColumn("nearest", found)
    for i, g in enumerate(steps):
        grid = _cells_of(flat, g).withColumnsRenamed({"cx": "_cx", "cy": "_cy", "candidates": "_candidates"})
        if told[f"r{i}"] * 16 <= MAX_BROADCAST_ROWS:
            grid = F.broadcast(grid)
        asks = F.col("nearest").isNull() & placed
        # rows that have their segment, or no place, match no cell; they are spread, should the join be shuffled
        idle = -(1 << 40) - F.pmod(F.xxhash64("lat", "lon"), F.lit(1024))
        out = out.withColumn("_x", F.when(asks, F.floor(px / g)).otherwise(idle)).withColumn("_y", F.floor(py / g))
        out = out.join(grid, (F.col("_x") == F.col("_cx")) & (F.col("_y") == F.col("_cy")), "left").withColumn("_b", best(F.col("_candidates")))
        out = out.withColumn("nearest", F.coalesce("nearest", F.when(F.col("_b.m") <= g, F.col("_b")))).drop("_x", "_y", "_cx", "_cy", "_candidates", "_b")
    return out
