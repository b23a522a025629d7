"""The density hierarchy against one made of all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seatrack.operators import density, lanes


def metres(places):
    la, lo = np.radians(np.array(places)).T
    xyz = np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], axis=1)
    chord = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(axis=2))
    return 2 * 6_371_000.0 * np.arcsin(np.minimum(1.0, chord / 2))


def brute_hierarchy(points, k, max_edge_m=None):
    """Sets of indices in the clusters kept: from the whole distance matrix, top down."""
    d = metres(points)
    core = np.sort(d, axis=1)[:, k - 1] if len(points) >= k else np.full(len(points), np.inf)
    reach = np.maximum(np.maximum(core[:, None], core[None]), d)
    # Prim's spanning tree
    left, best, near, tree = np.ones(len(points), dtype=bool), np.full(len(points), np.inf), np.zeros(len(points), dtype=int), []
    at = 0
    for _ in range(len(points) - 1):
        left[at] = False
        closer = left & (reach[at] < best)
        best[closer], near[closer] = reach[at][closer], at
        at = int(np.argmin(np.where(left, best, np.inf)))
        tree.append((best[at], int(near[at]), at))
    merges, root, node = sorted(t for t in tree if max_edge_m is None or t[0] <= max_edge_m), {}, {i: (0.0, [], frozenset([i])) for i in range(len(points))}

    def find(i):
        while i in root:
            i = root[i]
        return i

    # what is joined at one length has one node
    for w, a, b in merges:
        a, b = find(a), find(b)
        kids = [k for i in (a, b) for k in (node[i][1] if node[i][0] == w and node[i][1] else [i])]
        new = len(node)
        root[a] = root[b] = new
        node[new] = (w, kids, node[a][2] | node[b][2])
    tops = [i for i in node if i not in root and len(node[i][2]) >= k]

    def keep(i, born, may):
        """(sum of stabilities, clusters) of the cluster that begins at node i."""
        total, top = 0.0, i
        while True:
            w, kids, members = node[i]
            lam = 1 / max(w, density.FLOOR_M)
            big = [c for c in kids if len(node[c][2]) >= k]
            below = 0.0, []
            if len(big) != 1:
                total += len(members) * (lam - born)
                parts = [keep(c, lam, True) for c in big]
                below = sum(p[0] for p in parts), [x for p in parts for x in p[1]]
                break
            total += (len(members) - len(node[big[0]][2])) * (lam - born)
            i = big[0]
        return (total, [top]) if may and total >= below[0] else below

    out = []
    for t in tops:
        out += keep(t, 1 / max_edge_m if max_edge_m else 1 / (math.pi * 6_371_000.0), max_edge_m is not None)[1]
    return {node[i][2] for i in out}


def mixed_places(seed, n):
    """Ports a few metres wide, anchorages, lanes and loose places, also about the antimeridian."""
    r = random.Random(seed)
    out = []
    while len(out) < n:
        la, lo, spread = r.uniform(-60, 60), r.choice([-179.99, 179.98, r.uniform(-170, 170)]), 10 ** r.uniform(-4.5, -0.5)
        for _ in range(r.choice([1, 2, 3, 5, 20, 90])):
            out.append((la + r.gauss(0, spread), (lo + r.gauss(0, spread) + 180) % 360 - 180))
    out = out[: n - 6]
    return out + out[:3] + [out[5]] * 3


def found(spark, places, k, **how):
    df = spark.createDataFrame([(i, i % 7, la, lo) for i, (la, lo) in enumerate(places)], "i long, mmsi long, lat double, lon double")
    got = {}
    for r in lanes.cluster_waypoints(df, min_cluster_size=k, **how)[0].collect():
        got.setdefault(r.node_id, set()).add(r.i)
    got.pop(None, None)
    return {frozenset(x) for x in got.values()}


@pytest.mark.parametrize(("k", "parts", "n", "edge"), [(5, 4, 1000, None), (2, 7, 200, 20_000.0)])
def test_hierarchy_by_all_pairs(spark, k, parts, n, edge, monkeypatch):
    monkeypatch.setattr(density, "GROWTH", 16.0)
    places, before = mixed_places(k, n), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        want = brute_hierarchy(places, k, edge)
        assert len(want) > 3 and found(spark, places, k, max_edge_m=edge) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_large_groups_are_narrowed(spark, monkeypatch):
    """Two dense regions side by side are compared by the parts that may hold the nearest pair."""
    monkeypatch.setattr(density, "MAX_PAIRS", 50)
    monkeypatch.setattr(density, "FIRST_CELL", 8)
    monkeypatch.setattr(density, "FEW_EDGES", 40)
    r = random.Random(4)
    places = [(la + r.uniform(-0.01, 0.01), lo + r.uniform(-0.01, 0.01)) for la, lo in ((10.0, 10.0), (10.0, 10.05), (10.08, 10.02)) for _ in range(120)]
    assert found(spark, places, 3) == brute_hierarchy(places, 3)


def test_links_near_the_limit_are_found(spark):
    """p and q are linked only by the place that lies a metre further off its line."""
    places = [(0.00045950, 0.001), (0.00045020, 0.0009), (0.00045020, 0.0010001), (0.0112514, 0.0153880)]
    df = spark.createDataFrame(places, "lat double, lon double")
    assert density.density_clusters(df, 2000.0, 1).select("root").distinct().count() == 1


def test_shared_corridor(spark):
    """Four vessels that share two turns and nothing else: two nodes and one edge of as many trips."""
    for n in (4,):
        rows = []
        for v in range(n):
            jitter, spread = 0.0002 * v, 0.5 * v
            legs = [(40.30 - spread, -74.20 - spread), (40.30 + jitter, -74.15), (40.35, -74.05 + jitter), (40.35 + spread, -74.00 + spread)]
            rows += [(100 + v, t * 600, la, lo) for t, (la, lo) in enumerate(legs)]
        df = spark.createDataFrame(rows, "mmsi long, s long, lat double, lon double").withColumn("t", F.timestamp_seconds("s"))
        points, nodes = lanes.cluster_waypoints(df, min_cluster_size=3)
        assert [r.vessel_count for r in nodes.collect()] == [n, n]
        assert [r.frequency for r in lanes.lane_edges(points).collect()] == [n]


def test_few_places(spark):
    assert found(spark, [(1.0, 1.0)] * 4 + [(2.0, 2.0)] * 4, 3) == {frozenset(range(4)), frozenset(range(4, 8))}
