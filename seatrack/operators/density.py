"""Density hierarchy of places on the sphere: the search behind the waypoint clusters (L4)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seatrack.functions.geo import EARTH_RADIUS_M

from .graph import connected_components, written

#: Distances below count as this one, so that repeated places have a density.
FLOOR_M = 1e-3
#: The search radius grows by this factor from scale to scale.
GROWTH = 4.0
#: The first scale is the largest whose cells hold so many places at most.
FIRST_CELL = 256
#: Edges of a scale that are joined in one task; where there are more, each component has a task of its own.
FEW_EDGES = 100_000
#: Two groups of places are compared by all their pairs up to so many; larger ones by the parts of them that may hold the nearest pair.
MAX_PAIRS = 1 << 16
_FINER = 8.0
_ROUND = 2 * math.pi
_HALF_GLOBE_M = math.pi * EARTH_RADIUS_M
_CELL = ["row", "col"]
_XYZ = ["x", "y", "z"]


def _height(cell_m: float) -> float:
    """Height of a row of cells in radians, so that any two points of a cell are within cell_m."""
    return 0.999 * cell_m / math.sqrt(2) / EARTH_RADIUS_M


def _columns(row: Column, h: float) -> Column:
    """Cells in a row: whole cells around the globe, none wider than high at the row's edge nearest the equator."""
    nearest = F.when(row >= 0, row * h).otherwise(-(row + 1) * h)
    return F.greatest(F.lit(1), F.ceil(_ROUND * F.cos(F.least(nearest, F.lit(math.pi / 2))) / h)).cast("long")


def with_cells(points: DataFrame, cell_m: float) -> DataFrame:
    """Adds row and col of the cell of each point's lat and lon."""
    h = _height(cell_m)
    rows = points.withColumn("row", F.floor(F.radians("lat") / h))
    n = _columns(F.col("row"), h)
    turn = F.pmod(F.radians("lon") + math.pi, F.lit(_ROUND)) / _ROUND
    return rows.withColumn("col", F.least(F.floor(turn * n), n - 1))


def near_cells(cells: DataFrame, cell_m: float, reach_m: float) -> DataFrame:
    """(row, col, row_2, col_2): existing cells, the same one included, that may hold a point within reach_m of one in the first."""
    h, row, col = _height(cell_m), F.col("row"), F.col("col")
    rows = math.ceil(reach_m / EARTH_RADIUS_M / h)
    found = cells.withColumn("row_2", F.explode(F.sequence(F.col("row") - rows, F.col("row") + rows)))
    n, n_2 = _columns(row, h), _columns(F.col("row_2"), h)
    far = F.least(F.greatest(*[F.abs(r * h) for r in (row, row + 1, F.col("row_2"), F.col("row_2") + 1)]), F.lit(math.pi / 2))
    half = math.sin(min(reach_m * (1 + 1e-9) / 2 / EARTH_RADIUS_M, math.pi / 2)) / F.greatest(F.cos(far), F.lit(1e-12))
    reach = F.when(half >= 1, math.pi).otherwise(2 * F.asin(F.least(half, F.lit(1.0)))) / _ROUND
    first, last = F.floor((col / n - reach) * n_2), F.floor(((col + 1) / n + reach) * n_2)
    found = found.withColumn("c", F.explode(F.sequence(first, F.least(last, first + n_2 - 1)))).withColumn("col_2", F.pmod("c", n_2))
    found = found.select(*_CELL, "row_2", "col_2")
    return found.join(cells.select(F.col("row").alias("row_2"), F.col("col").alias("col_2")), ["row_2", "col_2"], "left_semi")


def _second(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{c}_2") for c in columns])


def _metres(chord: Column) -> Column:
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), chord / 2))


def _distance() -> Column:
    return _metres(F.sqrt(sum((F.col(c) - F.col(f"{c}_2")) * (F.col(c) - F.col(f"{c}_2")) for c in _XYZ)))


def _places(points: DataFrame) -> DataFrame:
    """(key, lat, lon, x, y, z, n): the distinct places of the points and how many each holds."""
    known = points.where("lat is not null and lon is not null").groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("n"))
    la, lo = F.radians("lat"), F.radians("lon")
    xyz = {"x": F.cos(la) * F.cos(lo), "y": F.cos(la) * F.sin(lo), "z": F.sin(la)}
    return known.select(F.concat_ws(",", "lat", "lon").alias("key"), "lat", "lon", *[v.alias(k) for k, v in xyz.items()], "n")


def _first_scale(places: DataFrame) -> float:
    """Largest of some cell sizes of which none holds more than FIRST_CELL places."""
    sizes = [_HALF_GLOBE_M / GROWTH**i for i in range(1, 18)]
    each = [with_cells(places, s).groupBy(*_CELL).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).select(F.lit(s).alias("s"), "n") for s in sizes]
    told = each[0]
    for other in each[1:]:
        told = told.unionByName(other)
    return told.where(F.col("n") <= FIRST_CELL).agg(F.max("s")).first()[0] or sizes[-1]


def _with_cores(places: DataFrame, cell_m: float, reach_m: float, min_points: int) -> DataFrame:
    """Fills core, the distance that holds min_points points, the place's own counted, where it is reach_m at most and not known yet.

    A place that asks has fewer than min_points points within cell_m, so few of
    its cell ask, and each meets the places of a bounded number of cells.
    """
    asking = with_cells(places.where("core is null"), cell_m).select("key", *_CELL, *_XYZ)
    around = near_cells(with_cells(places, cell_m).select(*_CELL).distinct(), cell_m, reach_m)
    met = asking.join(around, _CELL).join(_second(with_cells(places, cell_m), *_CELL, *_XYZ, "n"), ["row_2", "col_2"])
    met = met.select("key", _distance().alias("d"), "n_2").where(F.col("d") <= reach_m)
    by_distance = Window.partitionBy("key").orderBy("d")
    nearest = met.withColumn("i", F.row_number().over(by_distance)).where(F.col("i") <= min_points)
    heard = nearest.withColumn("held", F.sum("n_2").over(by_distance.rowsBetween(Window.unboundedPreceding, 0)))
    found = heard.where(F.col("held") >= min_points).groupBy("key").agg(F.min("d").alias("_core"))
    return places.join(found, "key", "left").withColumn("core", F.coalesce("core", "_core")).drop("_core")


def _groups(places: DataFrame) -> DataFrame:
    """Places of a cell and component together: how many, the least core, and their box."""
    box = [f(c).alias(f"{p}{c}") for c in _XYZ for p, f in (("lo_", F.min), ("hi_", F.max))]
    return places.groupBy(*_CELL, "comp").agg(F.count(F.lit(1)).alias("m"), F.min("core").alias("core"), *box)


_GROUP = [*_CELL, "comp", "m", "core", *[f"{p}{c}" for c in _XYZ for p in ("lo_", "hi_")]]


def _bounds(pairs: DataFrame) -> DataFrame:
    """Adds low and high, between which the least mutual reachability of two groups lies."""
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"lo_{c}") - F.col(f"hi_{c}_2"), F.col(f"lo_{c}_2") - F.col(f"hi_{c}"))
    span = lambda c: F.greatest(F.col(f"hi_{c}"), F.col(f"hi_{c}_2")) - F.least(F.col(f"lo_{c}"), F.col(f"lo_{c}_2"))
    length = lambda f: _metres(F.least(F.lit(2.0), F.sqrt(sum(f(c) * f(c) for c in _XYZ))))
    cores = F.greatest("core", "core_2")
    return pairs.withColumn("low", F.greatest(cores, length(gap) * (1 - 1e-9) - 1e-6)).withColumn("high", F.greatest(cores, length(span) * (1 + 1e-9) + 1e-6))


def _least_edges(live: DataFrame, cell_m: float, reach_m: float) -> DataFrame:
    """(a, b, w): for components a < b the least mutual reachability between cells of them, where it is reach_m at most.

    Groups of a cell and component meet the groups of the cells around. Small
    ones are compared by all pairs of their places; of large ones only those
    parts, in finer cells, that may hold the least pair, until they are small.
    """
    celled = written(with_cells(live, cell_m))
    groups = _groups(celled)
    around = near_cells(celled.select(*_CELL).distinct(), cell_m, reach_m)
    met = groups.join(around, _CELL).join(_second(groups, *_GROUP), ["row_2", "col_2"]).where(F.col("comp") < F.col("comp_2"))
    pairs = written(_bounds(met).where(F.col("low") <= reach_m))
    found: DataFrame | None = None
    while True:
        small = (F.col("m") * F.col("m_2") <= MAX_PAIRS) | F.lit(cell_m < FLOOR_M)
        opened = pairs.where(small).select(*_CELL, "comp", "row_2", "col_2", "comp_2").join(celled.select(*_CELL, "comp", "core", *_XYZ), [*_CELL, "comp"])
        opened = opened.join(_second(celled, *_CELL, "comp", "core", *_XYZ), ["row_2", "col_2", "comp_2"])
        edges = opened.select(F.col("comp").alias("a"), F.col("comp_2").alias("b"), F.greatest("core", "core_2", _distance()).alias("w")).where(F.col("w") <= reach_m)
        edges = edges.groupBy("a", "b").agg(F.min("w").alias("w"))
        found = edges if found is None else found.unionByName(edges)
        large = pairs.where(~small)
        if large.isEmpty():
            return found.groupBy("a", "b").agg(F.min("w").alias("w"))
        cell_m /= _FINER
        # the same places in finer cells; each part knows the group it is of
        fine = written(with_cells(celled.withColumnsRenamed({"row": "up_row", "col": "up_col"}), cell_m))
        box = [f(c).alias(f"{p}{c}") for c in _XYZ for p, f in (("lo_", F.min), ("hi_", F.max))]
        parts = fine.groupBy("up_row", "up_col", "comp", *_CELL).agg(F.count(F.lit(1)).alias("m"), F.min("core").alias("core"), *box)
        up = ["up_row", "up_col", "comp"]
        named = large.select(*[F.col(c).alias(f"up_{c}") if c in _CELL else F.col(c) for c in (*_CELL, "comp")], F.col("row_2").alias("up_row_2"), F.col("col_2").alias("up_col_2"), "comp_2")
        finer = named.join(parts, up).join(_second(parts, *up, *_CELL, "m", "core", *[f"{p}{c}" for c in _XYZ for p in ("lo_", "hi_")]), [f"{c}_2" for c in up])
        finer = written(_bounds(finer).where(F.col("low") <= reach_m))
        best = finer.groupBy("comp", "comp_2").agg(F.min("high").alias("best"))
        pairs = written(finer.join(best, ["comp", "comp_2"]).where(F.col("low") <= F.col("best")))
        celled = fine.drop("up_row", "up_col")


_OUT = "kind string, node string, up string, size long, cluster string, total double, inner double, stability double"


def _merged(scale: int, min_size: int):
    """Whole components of a scale: their parts of the scale before, joined along their edges from the shortest.

    Rows are parts (node, size, cluster, total, inner) and edges (a, b, w). A
    part of min_size points is a cluster; total is the sum over the points
    that left it so far of the density where they left, inner the best sum
    of stabilities below it. Tells the components, ended clusters with their
    parent, and to which cluster or component each small part went.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        parts, edges = rows[rows.a.isna()], rows[rows.a.notna()].sort_values(["w", "a", "b"])
        name, size = parts.node.tolist(), parts["size"].astype(int).tolist()
        cluster, total, inner = [c or None for c in parts.cluster], parts.total.tolist(), parts.inner.tolist()
        at, root, small, out = {n: i for i, n in enumerate(name)}, list(range(len(name))), [[i] for i in range(len(name))], []
        whole = f"{scale}/{min(name)}"

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        def leave(i: int, target: str) -> None:
            out.extend(("link", name[k], target, None, None, None, None, None) for k in small[i])
            small[i] = []

        def join(parts: list[int], w: float) -> None:
            density, both = 1 / max(w, FLOOR_M), sum(size[k] for k in parts)
            big, i = [k for k in parts if cluster[k]], parts[0]
            if len(big) > 1:
                new, best = f"c{whole}/{len(out)}", 0.0
                for k in big:
                    stability = total[k] - size[k] * density
                    best += max(stability, inner[k])
                    out.append(("cluster", cluster[k], new, size[k], None, None, inner[k], stability))
                cluster[i], total[i], inner[i] = new, both * density, best
            elif big:
                kept = big[0]
                cluster[i], total[i], inner[i] = cluster[kept], total[kept] + (both - size[kept]) * density, inner[kept]
            elif both >= min_size:
                cluster[i], total[i], inner[i] = f"c{whole}/{len(out)}", both * density, 0.0
            if cluster[i]:
                for k in parts:
                    leave(k, cluster[i])
            else:
                small[i] = [m for k in parts for m in small[k]]
            for k in parts[1:]:
                root[k] = i
            size[i] = both

        for w, same in edges.groupby("w", sort=False):
            # edges of one length join at once, in whatever order they come
            met: dict[int, list[int]] = {}
            for a, b in zip(same.a, same.b, strict=True):
                i, j = find(at[a]), find(at[b])
                one, other = met.setdefault(i, [i]), met.setdefault(j, [j])
                if one is not other:
                    if len(one) < len(other):
                        one, other = other, one
                    one += other
                    met.update(dict.fromkeys(other, one))
            for parts_met in {id(v): v for v in met.values()}.values():
                if len(parts_met) > 1:
                    join(sorted(parts_met), w)
        least: dict[int, str] = {}
        for k, n in enumerate(name):
            top = find(k)
            least[top] = min(n, least.get(top, n))
        for top, n in least.items():
            leave(top, f"{scale}/{n}")
            out.append(("part", f"{scale}/{n}", None, size[top], cluster[top], total[top], inner[top], None))
        members = pd.DataFrame({"kind": "member", "node": name, "up": [f"{scale}/{least[find(k)]}" for k in range(len(name))]})
        return pd.concat([pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")]), members]).astype({"size": "Int64"})

    return run


def _lift(nodes: DataFrame) -> DataFrame:
    """(node, best): of nodes (node, up, best) the last non-null best on the way up. Pointers double in each round."""
    reach = written(nodes.select("node", "up", "best"))
    while not reach.where("up is not null").isEmpty():
        above = reach.select(F.col("node").alias("up"), F.col("up").alias("far"), F.col("best").alias("higher"))
        reach = written(reach.join(above, "up", "left").select("node", F.col("far").alias("up"), F.coalesce("higher", "best").alias("best")))
    return reach.select("node", "best")


def _scales(places: DataFrame, min_points: int, max_edge_m: float | None) -> Iterator[tuple[int, DataFrame, DataFrame, float]]:
    """Per scale (number, places with comp and core, edges a, b, w between components, reach). The caller sends back the places with their new comp."""
    cell_m = _first_scale(places)
    limit = min(max_edge_m or _HALF_GLOBE_M, _HALF_GLOBE_M)
    current = places.withColumn("comp", F.concat(F.lit("p"), "key")).withColumn("core", F.when(F.col("n") >= min_points, 0.0))
    reach, scale = 0.0, 0
    while reach < limit:
        reach, scale = min(cell_m, limit), scale + 1
        current = written(_with_cores(current, reach if scale == 1 else reach / GROWTH, reach, min_points))
        edges = written(_least_edges(current.where("core is not null"), reach if scale == 1 else reach / GROWTH, reach))
        sent = yield scale, current, edges, reach
        current = current if sent is None else sent
        cell_m = reach * GROWTH
        if current.select("comp").distinct().limit(2).count() < 2:
            return


def density_clusters(points: DataFrame, level_m: float, min_points: int) -> DataFrame:
    """(lat, lon, root) of every dense place, written to the shared folder; places with one root form a cluster, all others are noise.

    A place is dense if at least min_points points, itself counted, lie within
    level_m. Dense places within level_m of each other are in one cluster: the
    level level_m of the density hierarchy. Rows with a null lat or lon are noise.
    """
    steps, sent, current = _scales(written(_places(points)), min_points, level_m), None, None
    while True:
        try:
            _, current, edges, _ = steps.send(sent)
        except StopIteration:
            break
        roots = connected_components(edges.select("a", "b")).select(F.col("node").alias("comp"), "root")
        sent = current = written(current.join(roots, "comp", "left").withColumn("comp", F.coalesce("root", "comp")).drop("root"))
    return written(current.where("core is not null").select("lat", "lon", F.col("comp").alias("root")))


def hierarchy_clusters(points: DataFrame, min_size: int, max_edge_m: float | None = None) -> DataFrame:
    """(lat, lon, root) of places in the clusters that the density hierarchy keeps; all others are noise.

    HDBSCAN: the spanning tree of mutual reachability (the greatest of two
    places' cores and their distance; a core holds min_size points, its own
    counted), condensed to clusters of min_size points, of which those with
    the greatest sum of stabilities stay; the whole of a table is no cluster.
    Equal edges join at once, so ties have one result: what joins two clusters
    at the length where they meet belongs to neither.

    The search radius grows scale by scale. At each, components of the scale
    before meet within cells of that radius, and each new component joins its
    own parts in a task that holds a row for each part and pair of parts, not
    for each place; few edges (FEW_EDGES) are joined in one task. With max_edge_m the tree is cut there, so that distant
    regions stay apart and each may be a cluster as a whole.
    """
    places = written(_places(points))
    first = places.withColumn("comp", F.concat(F.lit("p"), "key"))
    big = F.col("n") >= min_size
    parts = first.select(
        F.col("comp").alias("node"), F.col("n").alias("size"), F.when(big, F.concat(F.lit("c"), "comp")).alias("cluster"),
        F.when(big, F.col("n") / FLOOR_M).otherwise(0.0).alias("total"), F.lit(0.0).alias("inner"),
    )
    told = first.where(big).select(F.col("comp").alias("node"), F.concat(F.lit("c"), "comp").alias("up"))
    links, clusters = [told], []
    parts = written(parts)
    steps, sent = _scales(places, min_size, max_edge_m), None
    current = first
    while True:
        try:
            scale, current, edges, _ = steps.send(sent)
        except StopIteration:
            break
        sent = current
        if edges.isEmpty():
            continue
        joined = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
        if edges.limit(FEW_EDGES + 1).count() <= FEW_EDGES:
            roots = joined.withColumn("root", F.lit(""))
        else:
            roots = written(connected_components(edges.select("a", "b")))
        nothing = lambda kind: F.lit(None).cast(kind)
        of_parts = parts.join(roots, "node").select("root", "node", "size", "cluster", "total", "inner", nothing("string").alias("a"), nothing("string").alias("b"), nothing("double").alias("w"))
        of_edges = edges.join(roots, edges.a == roots.node).select("root", nothing("string").alias("node"), nothing("long").alias("size"), nothing("string").alias("cluster"), nothing("double").alias("total"), nothing("double").alias("inner"), "a", "b", "w")
        out = written(of_parts.unionByName(of_edges).groupBy("root").applyInPandas(_merged(scale, min_size), _OUT))
        links.append(out.where("kind = 'link'").select("node", "up"))
        clusters.append(out.where("kind = 'cluster'").select("node", "up", "stability", "inner"))
        moved = out.where("kind = 'member'").select(F.col("node").alias("comp"), F.col("up").alias("to"))
        parts = written(parts.join(roots, "node", "left_anti").unionByName(out.where("kind = 'part'").select("node", "size", "cluster", "total", "inner")))
        sent = current = written(current.join(moved, "comp", "left").withColumn("comp", F.coalesce("to", "comp")).drop("to"))
    last = parts.where("cluster is not null").select(F.col("cluster").alias("node"), F.lit(None).cast("string").alias("up"), (F.col("total") - F.col("size") / F.lit(max_edge_m or _HALF_GLOBE_M)).alias("stability"), "inner")
    alone = max_edge_m is None
    tree = last.withColumn("open", F.lit(not alone))
    for c in clusters:
        tree = tree.unionByName(c.withColumn("open", F.lit(True)))
    chosen = tree.select("node", "up", F.when(F.col("open") & (F.col("stability") >= F.col("inner")), F.col("node")).alias("best"))
    every = chosen
    for told in links:
        every = every.unionByName(told.select("node", "up", F.lit(None).cast("string").alias("best")))
    lifted = _lift(every)
    kept = first.select("lat", "lon", F.col("comp").alias("node")).join(lifted, "node").where("best is not null")
    return written(kept.select("lat", "lon", F.col("best").alias("root")))
