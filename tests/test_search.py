"""Nearest segments, overlapping boxes and best routes against all pairs and all routes."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seatrack.operators import detect, lanes, nearest, prisms


def test_nearest_of_many_lanes(spark):
    """10,000 segments from a metre to 3,000 km, some of them twice; points on them, near and far."""
    r = random.Random(1)
    ends = []
    for i in range(9000):
        la, lo, size = r.uniform(-60, 70), r.uniform(-179, 179), 10 ** r.uniform(-5, -0.3) if i % 300 else r.uniform(5, 30)
        ends.append((la, lo, la + r.uniform(-size, size), lo + r.uniform(-size, size)))
    rows = [(i % 700, f"lane{i % 37:02}", *e) for i, e in enumerate(ends + ends[:1000])]
    segments = spark.createDataFrame(rows, "ord long, lane_id string, a_lat double, a_lon double, b_lat double, b_lon double").withColumns({"lat0": F.lit(20.0), "lon0": F.lit(5.0)})
    places = [(r.uniform(-80, 80), r.uniform(-180, 180)) for _ in range(250)] + [(e[0] + r.gauss(0, s), e[1] + r.gauss(0, s)) for e in r.sample(ends, 250) for s in (0.001,)] + [ends[5][:2], ends[6][2:]]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(places)] + [(-1, None, 1.0)], "i long, lat double, lon double").repartition(3)
    plan = detect.nearest_lane(points, segments)
    assert "Cartesian" not in plan._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString()
    got = {x.i: (x.lane_m, x.lane_id) for x in plan.collect()}
    scale, radius = np.cos(np.radians(20.0)), 6_371_000.0
    flat = lambda la, lo: (np.radians(np.asarray(lo) - 5.0) * scale * radius, np.radians(np.asarray(la) - 20.0) * radius)
    e = np.array([x[2:] for x in rows])
    (ax, ay), (bx, by) = flat(e[:, 0], e[:, 1]), flat(e[:, 2], e[:, 3])
    for i, (la, lo) in enumerate(places):
        px, py = flat(la, lo)
        dx, dy = bx - ax, by - ay
        t = np.clip(((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy), 0, 1)
        d = np.hypot(px - (ax + t * dx), py - (ay + t * dy))
        first = min((rows[k][0], rows[k][1]) for k in np.flatnonzero(d <= d.min() + 1e-9))
        assert got[i][0] == pytest.approx(d.min(), rel=1e-9, abs=1e-6) and got[i][1] == first[1]
    assert got[-1] == (None, None)


def test_grids_joined_by_shuffle_and_few_segments(spark, monkeypatch):
    r = random.Random(2)
    rows = [(i, "l", r.uniform(0, 2), r.uniform(0, 2), r.uniform(0, 2), r.uniform(0, 2), 1.0, 1.0) for i in range(60)]
    segments = spark.createDataFrame(rows, "ord long, lane_id string, a_lat double, a_lon double, b_lat double, b_lon double, lat0 double, lon0 double")
    points = spark.createDataFrame([(r.uniform(-1, 3), r.uniform(-1, 3)) for _ in range(200)], "lat double, lon double")
    values = lambda: sorted(tuple(x) for x in detect.nearest_lane(points, segments).collect())
    many = values()
    monkeypatch.setattr(nearest, "MAX_BROADCAST_ROWS", 0)
    shuffled = values()
    monkeypatch.setattr(nearest, "FEW", 100)
    few = values()
    assert many == shuffled and [x[:2] for x in few] == [x[:2] for x in many] and [x[3] for x in few] == pytest.approx([x[3] for x in many])
    none = detect.nearest_lane(points, segments.limit(0)).first()
    assert none.lane_id is None and none.lane_m is None


def boxes(seed, n):
    r = random.Random(seed)
    out = []
    for i in range(n):
        size, span = 10 ** r.uniform(-2, 1.5), 10 ** r.uniform(1, 5.5)
        x, y, t = r.choice([r.uniform(-180, 180), 179.9, -179.9]), r.uniform(-70, 70) * r.choice([0.02, 1]), r.uniform(0, 4e5)
        out.append((i, x, x + size, y, y + size / 2, t, t + span))
    return out + [(n, 0.0, 0.5, 0.0, 0.5, 0.0, 3600.0), (n + 1, 0.5, 1.0, 0.5, 1.0, 3600.0, 7200.0), (n + 2, 0.5, 1.0, 0.5, 1.0, 3599.0, 7200.0)]


@pytest.mark.parametrize("full", [2048, 3])
def test_box_pairs_by_all_pairs(spark, full, monkeypatch):
    monkeypatch.setattr(prisms, "CELL_BOXES", full)
    rows = boxes(3, 400)
    df = spark.createDataFrame(rows, "k long, x0 double, x1 double, y0 double, y1 double, t0 double, t1 double").repartition(3)
    a = np.array(rows)
    want = set()
    for turn in (-360.0, 0.0, 360.0):
        over = (a[:, None, 1] <= a[None, :, 2] + turn) & (a[None, :, 1] + turn <= a[:, None, 2]) & (a[:, None, 3] <= a[None, :, 4]) & (a[None, :, 3] <= a[:, None, 4])
        over &= (a[:, None, 5] < a[None, :, 6]) & (a[None, :, 5] < a[:, None, 6])
        want |= {(int(i), int(j)) for i, j in zip(*np.nonzero(over), strict=True) if i < j}
    got = prisms.box_pairs(df, "k").collect()
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want and len(want) > 200


def test_rows_dealt_for_a_box_are_bounded(spark):
    """From a minute and 100 m to a month and the globe: eight rows for each level that is used."""
    rows = [(i, 0.0, w, 0.0, w / 2, 0.0, s) for i, (w, s) in enumerate((w, s) for w in (0.001, 0.3, 4.0, 60.0, 300.0) for s in (60.0, 86_400.0, 259_200.0, 2.6e6))]
    df = spark.createDataFrame(rows, "k long, x0 double, x1 double, y0 double, y1 double, t0 double, t1 double")
    dealt = prisms.dealt_boxes(df, "k").groupBy("k", "level").count().collect()
    assert max(r["count"] for r in dealt) <= 8
    assert max(r.n for r in prisms.dealt_boxes(df, "k").groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()) <= 8 * (prisms.LEVELS + 1)


def all_routes(counts, edges, horizon):
    total, out = sum(counts.values()), {}
    for start in counts:
        best = None
        stack = [((start,), frozenset(), counts[start] / total)]
        while stack:
            route, used, reward = stack.pop()
            key = (-round(reward, 9), ">".join(route))
            best = min(best or (key, reward), (key, reward))
            if len(used) < horizon:
                for (a, b), m in edges.items():
                    if a == route[-1] and (a, b) not in used:
                        stack.append(((*route, b), used | {(a, b)}, reward + (0 if b in route else counts[b] / total) - m / 100_000))
        out[start] = best[0][1]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_best_routes_by_all_routes(spark, seed):
    r = random.Random(seed)
    counts = {f"n{i}": r.randint(1, 30) for i in range(14)}
    edges = {(a, b): r.choice([500.0, 2000.0, 9000.0]) for a in counts for b in counts if r.random() < 0.25}
    nodes = spark.createDataFrame(list(counts.items()), "node_id string, vessel_count long")
    lengths = spark.createDataFrame([(a, b, m) for (a, b), m in edges.items()], "from_node string, to_node string, length_m double")
    got = {x.start: ">".join(x.route) for x in lanes.best_routes(nodes, lengths, 4).collect()}
    assert got == all_routes(counts, edges, 4)


def test_routes_through_a_hub_stay_few(spark, monkeypatch):
    """Of the 300^2 routes through the hub only those that may still be best are made."""
    counts = [(f"n{i:03}", 1 + i % 50) for i in range(300)] + [("hub", 5)]
    edges = [(n, "hub", 90.0) for n, _ in counts[:-1]] + [("hub", n, 100.0) for n, _ in counts[:-1]]
    nodes, lengths = spark.createDataFrame(counts, "node_id string, vessel_count long"), spark.createDataFrame(edges, "from_node string, to_node string, length_m double")
    seen, real = [], lanes.durable

    def counted(df):
        out = real(df)
        if "reach" in out.columns and "route" in out.columns:
            seen.append(out.count())
        return out

    monkeypatch.setattr(lanes, "durable", counted)
    got = {x.start: x.route for x in lanes.best_routes(nodes, lengths, 4).collect()}
    # the six nodes of 50 vessels end most routes; the first two by name are taken
    assert got["n000"] == ["n000", "hub", "n049", "hub", "n099"] and len(got) == 301
    assert max(seen) < 300 * 40


def brute_outline(x, y, epsilon_m):
    keep = lanes.rdp_keep(x, y, epsilon_m)
    kept = {(a, b) for a, b, k in zip(x.tolist(), y.tolist(), keep, strict=True) if k}
    return {i for i, p in enumerate(zip(x.tolist(), y.tolist(), strict=True)) if p in kept}


def test_outline_of_a_very_long_track(spark, monkeypatch):
    """A track of 200,000 points, a fifth of which lie where it was before, in rounds; short tracks beside it in one task each."""
    rng = np.random.default_rng(5)
    steps = rng.normal(0, 3e-4, (200_000, 2)) + 2e-4 * np.sin(np.arange(200_000) / 9_000)[:, None]
    walk = np.cumsum(steps, axis=0) + [40.0, -60.0]
    walk[150_000:190_000] = walk[10_000:50_000]
    local = [(1, i, float(a), float(b)) for i, (a, b) in enumerate(walk)] + [(v, i, 10.0 + v + (i % 7) * 0.01, 5.0 + i * 0.002) for v in (2, 3) for i in range(40)]
    table = pd.DataFrame(local, columns=["mmsi", "seq", "lat", "lon"])
    df = spark.createDataFrame(table).withColumn("t", F.timestamp_seconds(F.floor(F.col("seq") / 2) + 1_717_200_000))
    got = {}
    for r in lanes.simplify_tracks(df, 3_000.0).select("mmsi", "seq").collect():
        got.setdefault(r.mmsi, set()).add(r.seq)
    for v, part in table.groupby("mmsi"):
        x = np.radians(part.lon - part.lon.mean()) * np.cos(np.radians(part.lat.mean())) * 6_371_000.0
        y = np.radians(part.lat - part.lat.mean()) * 6_371_000.0
        assert got[v] == brute_outline(x.to_numpy(), y.to_numpy(), 3_000.0)
    assert 20 < len(got[1]) < 20_000
