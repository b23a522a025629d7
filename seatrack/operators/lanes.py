"""Quality gate, canonical tracks and lane building (Q1, L1-L9), and lane-graph routes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seatrack.functions.geo import CAPS_MPS, EARTH_RADIUS_M
from seatrack.sources.tables import LAYOUT, upsert_table, with_layout

from .density import density_clusters, hierarchy_clusters
from .graph import durable, written
from .joins import asof_join

RDP_M, MIN_CLUSTER = 200.0, 2
#: Points of a chord that one task simplifies.
MAX_CHORD = 50_000
REQUIRED = ("mmsi", "t", "lat", "lon", "sog", "cog")


def quality_report(df: DataFrame, min_rows: int = 1) -> DataFrame:
    """Q1: (check, passed, unexpected) of the raw extract (mmsi, t text, lat, lon, sog, cog, seq). Range checks pass nulls."""
    spark = df.sparkSession
    missing = [c for c in REQUIRED if c not in df.columns]
    rows = [(f"column_{c}", c not in missing, int(c in missing)) for c in REQUIRED]
    present = spark.createDataFrame(rows, "check string, passed boolean, unexpected long")
    if missing:
        return present
    time = F.try_to_timestamp("t")
    w = Window.partitionBy("mmsi").orderBy("seq")
    timed = df.withColumn("_t", time).withColumn("_p", F.lag("_t").over(w))
    out = lambda c, a, b: F.count_if(F.coalesce(~F.col(c).between(a, b), F.lit(False)))
    sums = timed.agg(
        F.greatest(F.lit(min_rows) - F.count(F.lit(1)), F.lit(0)).alias("row_count"), out("lat", -90, 90).alias("lat_range"), out("lon", -180, 180).alias("lon_range"),
        out("mmsi", 100_000_000, 999_999_999).alias("mmsi_range"), F.count_if(F.col("mmsi").isNull()).alias("mmsi_not_null"),
        F.count_if(F.col("_t").isNull() | (F.col("_t") < F.col("_p"))).alias("time_monotone"),
    )
    told = sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), (F.col(c) == 0).alias("passed"), F.col(c).cast("long").alias("unexpected")) for c in sums.columns])).alias("r")).select("r.*")
    return present.unionByName(told)


def require_quality(df: DataFrame, min_rows: int = 1) -> DataFrame:
    """Q1: df, if every check passes; else an error that names the failures, before anything is written."""
    failed = [r["check"] for r in quality_report(df, min_rows).where("not passed").collect()]  # a dozen rows at most
    if failed:
        raise ValueError("quality gate: " + ", ".join(sorted(failed)))
    return df


def canonicalize(df: DataFrame) -> DataFrame:
    """L1: typed columns, the first ingested row of each (mmsi, t), sorted by vessel and time inside partitions."""
    typed = df.select(F.col("mmsi").cast("long").alias("mmsi"), F.try_to_timestamp(F.col("t").cast("string")).alias("t"), *[F.col(c).cast("double").alias(c) for c in ("lat", "lon", "sog", "cog")], "seq")
    first = typed.groupBy("mmsi", "t").agg(F.min_by(F.struct("lat", "lon", "sog", "cog", "seq"), "seq").alias("r")).select("mmsi", "t", "r.*")
    return first.repartition("mmsi").sortWithinPartitions("mmsi", "t")


def project_local(df: DataFrame, by: list[str]) -> DataFrame:
    """L2: x, y in metres about the centroid of each group."""
    w = Window.partitionBy(*by)
    lat0, lon0 = F.avg("lat").over(w), F.avg("lon").over(w)
    out = df.withColumn("_lat0", lat0).withColumn("_lon0", lon0)
    x = F.radians(F.col("lon") - F.col("_lon0")) * F.cos(F.radians("_lat0")) * EARTH_RADIUS_M
    return out.withColumn("x", x).withColumn("y", F.radians(F.col("lat") - F.col("_lat0")) * EARTH_RADIUS_M).drop("_lat0", "_lon0")


def rdp_keep(x: np.ndarray, y: np.ndarray, epsilon: float) -> np.ndarray:
    """Mask of the points that Ramer-Douglas-Peucker keeps; distances are from the infinite chord, and the first farthest point splits."""
    keep = np.zeros(len(x), dtype=bool)
    if len(x):
        keep[[0, -1]] = True
    stack = [(0, len(x) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        dx, dy = x[b] - x[a], y[b] - y[a]
        px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
        norm = np.hypot(dx, dy)
        d = np.abs(dx * py - dy * px) / norm if norm > 0 else np.hypot(px, py)
        at = int(np.argmax(d))
        if d[at] > epsilon:
            keep[a + 1 + at] = True
            stack += [(a, a + 1 + at), (a + 1 + at, b)]
    return keep


def _finished(epsilon_m: float):
    """Interior points that a chord keeps: rows of one chord with its ends."""

    def run(points: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values(["t", "tie"], kind="stable")
        ends = [np.array([points[f"{e}_{c}"].iloc[0]]) for e in ("lo", "hi") for c in "xy"]
        x, y = np.concatenate((ends[0], points.x.to_numpy(), ends[2])), np.concatenate((ends[1], points.y.to_numpy(), ends[3]))
        return points.loc[rdp_keep(x, y, epsilon_m)[1:-1], ["track", "x", "y"]]

    return run


def simplify_tracks(df: DataFrame, epsilon_m: float = RDP_M, by: str = "mmsi") -> DataFrame:
    """L3: the points that outline each track, ordered by t, then by seq if there is one; a kept place stays at every visit.

    A chord of more than MAX_CHORD points is split by rounds of DataFrames: its
    farthest point is a grouped maximum, and the points on both sides go on
    with their own chord. Chords that are short enough are finished in a
    task each, so no task holds a long track.
    """
    centre = df.groupBy(by).agg(F.avg("lat").alias("_lat0"), F.avg("lon").alias("_lon0"))
    named = df.join(centre.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
    x = F.radians(F.col("lon") - F.col("_lon0")) * F.cos(F.radians("_lat0")) * EARTH_RADIUS_M
    flat = written(named.withColumns({"_x": x, "_y": F.radians(F.col("lat") - F.col("_lat0")) * EARTH_RADIUS_M}).drop("_lat0", "_lon0"))
    tie = F.col("seq").cast("long") if "seq" in df.columns else F.xxhash64("lat", "lon")
    points = flat.select(F.col(by).alias("track"), "t", tie.alias("tie"), F.col("_x").alias("x"), F.col("_y").alias("y"))
    place = F.struct("t", "tie", "x", "y")
    ends = points.groupBy("track").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.count(F.lit(1)).alias("n"))
    kept = [ends.select("track", f"{e}.x", f"{e}.y") for e in ("lo", "hi")]
    inside = lambda rows: rows.where((place > F.col("lo")) & (place < F.col("hi")))
    open_ = inside(points.join(ends.withColumnRenamed("track", "_t"), F.col("track").eqNullSafe(F.col("_t"))).drop("_t"))
    kind = points.schema["track"].dataType.simpleString()
    while True:
        open_ = written(open_)
        short = open_.where(F.col("n") <= MAX_CHORD).select("track", "t", "tie", "x", "y", F.col("lo").alias("chord"), *[F.col(f"{e}.{c}").alias(f"{e}_{c}") for e in ("lo", "hi") for c in "xy"])
        done = short.groupBy("track", "chord").applyInPandas(_finished(epsilon_m), f"track {kind}, x double, y double")
        kept.append(written(done))
        long_ = open_.where(F.col("n") > MAX_CHORD)
        dx, dy = F.col("hi.x") - F.col("lo.x"), F.col("hi.y") - F.col("lo.y")
        px, py, norm = F.col("x") - F.col("lo.x"), F.col("y") - F.col("lo.y"), F.hypot(dx, dy)
        off = F.when(norm > 0, F.abs(dx * py - dy * px) / F.when(norm > 0, norm)).otherwise(F.hypot(px, py))
        # the first of the farthest points
        far = long_.withColumn("off", off).groupBy("track", "lo").agg(F.min(F.struct((-F.col("off")).alias("off"), place.alias("at"))).alias("far"))
        far = written(far.where(-F.col("far.off") > epsilon_m).select(F.col("track").alias("_t"), F.col("lo").alias("_lo"), F.col("far.at").alias("at")))
        if far.isEmpty():
            break
        kept.append(far.select(F.col("_t").alias("track"), "at.x", "at.y"))
        sided = long_.drop("n").join(far, F.col("track").eqNullSafe(F.col("_t")) & (F.col("lo") == F.col("_lo"))).drop("_t", "_lo").where(place != F.col("at"))
        sided = sided.withColumn("after", place > F.col("at"))
        sided = sided.withColumn("lo", F.when(F.col("after"), F.col("at")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("after"), F.col("hi")).otherwise(F.col("at"))).drop("at", "after")
        sizes = sided.groupBy("track", "lo").agg(F.count(F.lit(1)).alias("n")).select(F.col("track").alias("_t"), F.col("lo").alias("_lo"), "n")
        open_ = sided.join(sizes, F.col("track").eqNullSafe(F.col("_t")) & (F.col("lo") == F.col("_lo"))).drop("_t", "_lo")
    places = kept[0]
    for more in kept[1:]:
        places = places.unionByName(more)
    places = places.distinct().toDF("_track", "_kx", "_ky")
    same = F.col(by).eqNullSafe(F.col("_track")) & (F.col("_x") == F.col("_kx")) & (F.col("_y") == F.col("_ky"))
    return flat.join(places, same, "left_semi").select(*df.columns)


def cluster_waypoints(points: DataFrame, level_m: float | None = None, min_cluster_size: int = MIN_CLUSTER, max_edge_m: float | None = None) -> tuple[DataFrame, DataFrame]:
    """L4: (points with node_id or null, nodes).

    Clusters are those that the density hierarchy keeps (hierarchy_clusters,
    cut at max_edge_m if given) or, with level_m, those of that one level:
    points with min_cluster_size points within that distance, joined where they
    are within it. The others, and clusters of fewer points, are noise. A node lies
    at its points' mean; longitudes are averaged about the cluster's first one,
    so that a node on the antimeridian stays there.
    """
    places = density_clusters(points, level_m, min_cluster_size) if level_m else hierarchy_clusters(points, min_cluster_size, max_edge_m)
    known = places.withColumn("node_id", F.concat(F.lit("n"), F.substring(F.sha2("root", 256), 1, 12))).drop("root")
    tagged = points.join(known, ["lat", "lon"], "left")
    about = tagged.where("node_id is not null").groupBy("node_id").agg(F.min("lon").alias("lon_0"))
    turned = tagged.join(about, "node_id").withColumn("off", F.pmod(F.col("lon") - F.col("lon_0") + 180, F.lit(360.0)) - 180)
    sums = turned.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"), F.avg("lat").alias("lat"), F.first("lon_0").alias("lon_0"), F.avg("off").alias("off"), F.countDistinct("mmsi").alias("vessel_count"))
    lon = F.pmod(F.col("lon_0") + F.col("off") + 180, F.lit(360.0)) - 180
    nodes = sums.where(F.col("n") >= min_cluster_size).select("node_id", "lat", lon.alias("lon"), "vessel_count")
    small = nodes.select("node_id", F.lit(True).alias("_kept"))
    out = tagged.join(small, "node_id", "left").withColumn("node_id", F.when(F.col("_kept"), F.col("node_id"))).drop("_kept")
    return out.select(*points.columns, "node_id"), nodes


def lane_edges(points: DataFrame) -> DataFrame:
    """Transitions between the nodes that each vessel visits in turn, noise left out and repeats collapsed."""
    w = Window.partitionBy("mmsi").orderBy("t")
    steps = points.where("node_id is not null").select("mmsi", "t", F.col("node_id").alias("to_node"), F.lag("node_id").over(w).alias("from_node"))
    return steps.where("from_node <> to_node").groupBy("from_node", "to_node").agg(F.count(F.lit(1)).alias("frequency"))


def build_lanes(df: DataFrame, epsilon_m: float = RDP_M, max_edge_m: float | None = None, min_cluster_size: int = MIN_CLUSTER) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from canonical positions."""
    points, nodes = cluster_waypoints(simplify_tracks(df, epsilon_m), None, min_cluster_size, max_edge_m)
    return nodes, lane_edges(points)


def fingerprint(df: DataFrame, time: str | None = None) -> DataFrame:
    """One row of count, order-free sums of the rows' hash words, and the time range; any changed row changes it."""
    digest = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    word = lambda i: F.sum(F.conv(F.substring("_d", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).alias(f"word_{i}")
    span = [F.min(time).alias("first_t"), F.max(time).alias("last_t")] if time else []
    return df.withColumn("_d", digest).agg(F.count(F.lit(1)).alias("n"), *[word(i) for i in range(4)], *span)


def export_training_set(requests: DataFrame, features: DataFrame, max_age_s: float | None = None, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(requests(mmsi, event_timestamp, ...) with the features known at their time as f_ columns, fingerprint of these rows)."""
    rows = asof_join(requests, features, "mmsi", "event_timestamp", "t", max_age_s, order)
    return rows, fingerprint(rows, "event_timestamp")


def run_backfill(raw: DataFrame, path: str, min_rows: int = 1) -> DataFrame:
    """Gate, canonical positions, lanes and edges as tables below path; (table, n) of what they hold.

    Nothing is written if the gate fails. Lanes are built from the written
    positions, and a rerun over the same extract leaves every count as it is.
    """
    spark = raw.sparkSession
    upsert_table(with_layout(canonicalize(require_quality(raw, min_rows)), "positions"), f"{path}/positions", ["mmsi", "t"], LAYOUT["positions"])
    nodes, edges = build_lanes(spark.read.parquet(f"{path}/positions").drop(*LAYOUT["positions"]))
    upsert_table(nodes, f"{path}/graph_nodes", ["node_id"])
    upsert_table(edges, f"{path}/graph_edges", ["from_node", "to_node"])
    counts = [spark.read.parquet(f"{path}/{t}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table"), "n") for t in LAYOUT]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def feasible_edges(lengths: DataFrame, dt_s: float, domain: str = "vessel", slack: float = 1.05) -> DataFrame:
    """G1: edges (with length_m) that can be sailed in dt_s."""
    return lengths.where((F.lit(dt_s) > 0) & (F.col("length_m") <= CAPS_MPS[domain] * dt_s * slack))


def route_reward(routes: DataFrame, nodes: DataFrame, lengths: DataFrame) -> DataFrame:
    """Share of all vessel counts that the route's distinct nodes cover, less its metres / 100 km. A hop that is no edge is an error."""
    total = nodes.agg(F.sum("vessel_count").alias("all_vessels"))
    stops = routes.select("route_id", F.posexplode("route").alias("i", "node_id"))
    w = Window.partitionBy("route_id").orderBy("i")
    hops = stops.withColumn("to_node", F.lead("node_id").over(w)).where("to_node is not null").join(lengths.select(F.col("from_node").alias("node_id"), "to_node", "length_m"), ["node_id", "to_node"], "left")
    metres = hops.groupBy("route_id").agg(F.sum(F.coalesce("length_m", F.raise_error(F.lit("hop is not an edge")).cast("double"))).alias("metres"))
    cover = stops.select("route_id", "node_id").distinct().join(nodes, "node_id").groupBy("route_id").agg(F.sum("vessel_count").alias("covered"))
    out = routes.select("route_id").join(cover, "route_id", "left").join(metres, "route_id", "left").crossJoin(F.broadcast(total))
    return out.select("route_id", (F.coalesce(F.col("covered") / F.col("all_vessels"), F.lit(0.0)) - F.coalesce("metres", F.lit(0.0)) / 100_000.0).alias("reward"))


def _gains(nodes: DataFrame) -> DataFrame:
    total = nodes.agg(F.sum("vessel_count").alias("t")).first()[0]
    return nodes.select("node_id", (F.col("vessel_count") / F.lit(total)).alias("gain"))


def _extended(step: DataFrame) -> DataFrame:
    """Routes (start, route, used, reward) joined to their next hop (_from, to_node, length_m, gain), with that hop taken unless its edge is used."""
    step = step.withColumn("_edge", F.concat_ws(">", "_from", "to_node")).where(~F.array_contains("used", F.col("_edge")))
    gain = F.when(F.array_contains("route", F.col("to_node")), 0.0).otherwise(F.col("gain"))
    taken = {"route": F.concat("route", F.array("to_node")), "used": F.concat("used", F.array("_edge")), "reward": F.col("reward") + gain - F.col("length_m") / 100_000.0}
    return step.withColumns(taken).drop("_from", "to_node", "_edge", "length_m", "gain", "ahead")


def best_routes(nodes: DataFrame, lengths: DataFrame, horizon: int = 3, beam: int | None = None, guess: int = 4) -> DataFrame:
    """From every node, the route of at most `horizon` hops with the largest reward that uses no edge twice; ties go to the first route by its nodes.

    With `beam`, each start keeps its best `beam` partial routes after every hop.
    Without, the result is exact by branch and bound: a search of beam `guess`
    tells a reward that each start can reach, and a partial route goes on only
    if that may still be reached. What a route can add in the hops left is
    bounded by the best walk from its end, which may collect a gain again.
    """
    if not nodes.agg(F.sum("vessel_count")).first()[0]:
        return nodes.select(F.col("node_id").alias("start"), F.array("node_id").alias("route"), F.lit(0.0).alias("reward")).limit(0)
    n = _gains(nodes)
    first = n.select(F.col("node_id").alias("start"), F.array("node_id").alias("route"), F.array().cast("array<string>").alias("used"), F.col("gain").alias("reward"))
    hops = durable(lengths.join(n, lengths.to_node == n.node_id).select(F.col("from_node").alias("_from"), "to_node", "length_m", "gain"))
    w = Window.partitionBy("start").orderBy(F.desc(F.round("reward", 9)), F.concat_ws(">", "route"))
    chosen = lambda df: df.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("start", "route", "reward")
    if beam:
        routes = everything = first
        for _ in range(horizon):
            routes = _extended(routes.join(hops, F.element_at("route", -1) == F.col("_from")))
            best = Window.partitionBy("start").orderBy(F.desc("reward"), F.concat_ws(">", "route"))
            routes = routes.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= beam).drop("_n")
            everything = everything.unionByName(routes)
        return chosen(everything)
    reachable = durable(best_routes(nodes, lengths, horizon, guess).select("start", F.col("reward").alias("reach")))
    # ahead: the most that a hop and the walk after it can add
    ahead, rest = [], n.select("node_id", F.lit(0.0).alias("more"))
    for _ in range(horizon):
        step = hops.join(rest, hops.to_node == rest.node_id, "left").withColumn("ahead", F.col("gain") - F.col("length_m") / 100_000.0 + F.coalesce("more", F.lit(0.0))).drop("node_id", "more")
        ahead.append(durable(step))
        rest = ahead[-1].groupBy(F.col("_from").alias("node_id")).agg(F.greatest(F.lit(0.0), F.max("ahead")).alias("more"))
    routes = first.join(reachable, "start")
    everything = first
    for left in reversed(range(horizon)):
        may = routes.join(ahead[left], F.element_at("route", -1) == F.col("_from")).where(F.col("reward") + F.col("ahead") >= F.col("reach") - 1e-8)
        routes = durable(_extended(may))
        everything = everything.unionByName(routes.drop("reach"))
    return chosen(everything)
