"""Pinned values, properties and edge cases of the track and registry operators."""

import json
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from seatrack.operators import cdc, detect, features, graph, joins, lanes, prisms, stats
from seatrack.plans import track_queries
from seatrack.sources import reports, tables
from seatrack.streaming import jobs


def test_drift_values(spark):
    a = spark.createDataFrame([(float(x),) for x in np.linspace(0, 10, 50)], "x double")
    b = spark.createDataFrame([(float(x),) for x in np.linspace(5, 15, 50)], "x double")
    r = stats.input_drift(a, b).first()
    assert (r.psi, r.ks, r.ks_pvalue) == (pytest.approx(6.652284902471817), pytest.approx(0.5), pytest.approx(3.6276162006545173e-06)) and r.drifted


def test_auc_and_crps(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)], "label int, score double")
    assert stats.roc_auc(df, "label", "score").first().auc == pytest.approx(0.875)
    for mu, sigma, y, want in ((0.0, 1.0, 0.0, 0.233695), (0.0, 1.0, 1.0, 0.602441), (2.0, 0.5, 2.3, 0.186578), (5.0, 2.0, 1.0, 2.905584)):
        one = spark.createDataFrame([(mu, sigma, y)], "mu double, sigma double, y double")
        assert stats.crps_gaussian(one).first().crps == pytest.approx(want, abs=1e-6)
    assert stats.roc_auc(df.where("label = 1"), "label", "score").first().auc is None


def test_prefix_sum_does_not_depend_on_partitions(spark):
    df = spark.range(200).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"), (F.col("id") % 2).alias("g"))
    want = {r.k: sum(i % 7 for i in range(r.k + 1) if i % 2 == r.g) for r in df.collect()}
    assert {r.k: r.cum_v for r in joins.prefix_sum(df, "k", ["v"], ["g"]).collect()} == want


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_ordered_statistics_on_many_partitions(spark, adaptive):
    """AUC and KS of 300,000 rows equal plain NumPy ones, with other columns about and however partitions are merged."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    for k, v in zip(before, ("16", adaptive, "200k"), strict=True):
        spark.conf.set(k, v)
    try:
        df = spark.range(300_000).select(
            "id", (F.pmod(F.xxhash64("id"), F.lit(100_003)) / 100_003).alias("score"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)) == 0).cast("int").alias("label"), F.concat(F.lit("extra"), "id").alias("extra")
        )
        local = df.select("score", "label").toPandas()
        values, first, counts = np.unique(local.score.to_numpy(), return_inverse=True, return_counts=True)
        ranks = (np.cumsum(counts) - (counts - 1) / 2.0)[first]
        pos = local.label.to_numpy() == 1
        want = (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
        assert stats.roc_auc(df, "label", "score").first().auc == pytest.approx(want, abs=1e-12)
        per = {r.g: r.auc for r in stats.roc_auc(df.withColumn("g", F.col("id") % 2), "label", "score", ["g"]).collect()}
        assert len(per) == 2 and all(abs(x - want) < 0.01 for x in per.values())
        steps = np.searchsorted(np.sort(local.score[pos]), values, side="right") / pos.sum() - np.searchsorted(np.sort(local.score[~pos]), values, side="right") / (~pos).sum()
        ks = stats.ks_statistic(df.where("label = 1"), df.where("label <> 1"), ["score"]).first().ks
        assert ks == pytest.approx(np.abs(steps).max(), abs=1e-12)
        plain = df.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.max("extra").alias("extra"))
        got = {r.score: r.cum_n for r in joins.prefix_sum(plain, "score", ["n"]).collect()}
        assert got == dict(zip(values.tolist(), np.cumsum(counts).tolist(), strict=True))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_guard_converges_under_any_delivery(spark):
    events = [(f"k{i % 3}", "cudr"[i % 4], i * 37 % 101, f"v{i}") for i in range(24)]
    best = {}
    for k, op, lsn, v in events:
        g = 0 if op == "r" else lsn
        if k not in best or g > best[k][0]:
            best[k] = (g, None if op == "d" else v)
    for seed in range(3):
        r = random.Random(seed)
        sent = [(f"{n}", *e) for n, e in enumerate(r.sample(events + r.sample(events, 8), 32))]
        df = spark.createDataFrame([("vessels", k, op, lsn, v, int(n)) for n, k, op, lsn, v in sent], "event_table string, pk string, op string, lsn long, after string, seq long")
        got = {x.pk: (x.lsn, x.content) for x in cdc.reduce_state(df).collect()}
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in best.items()}
        halves = cdc.merge_state(cdc.reduce_state(df.where("seq < 15")), cdc.reduce_state(df.where("seq >= 15")))
        assert {x.pk: (x.lsn, x.content) for x in halves.collect()} == got


def test_envelopes(spark):
    def env(op="c", table="vessels", lsn=5, wrap=True):
        body = {"op": op, "before": None, "after": {"mmsi": 1}, "source": {"table": table, "lsn": lsn}, "ts_ms": 7}
        return json.dumps({"payload": body} if wrap else body)

    key = '{"payload": {"mmsi": 1}}'
    rows = [(0, "t", key, env()), (1, "t", key, env(wrap=False)), (2, "t", key, None), (3, "__heartbeat.x", key, "{}"), (4, "schema-changes", None, "{}"), (5, "t", key, env(op="x")), (6, "t", key, env(table="other")), (7, "t", key, env(lsn=None)), (8, "t", None, env()), (9, "t", key, "{broken")]
    got = [r.kind for r in cdc.parse_envelopes(spark.createDataFrame(rows, "seq long, topic string, key string, value string")).orderBy("seq").collect()]
    assert got == ["change", "change", "tombstone", "skip", "skip", *["error"] * 5]


def test_stream_equals_batch_and_redelivery_adds_nothing(spark, tmp_path):
    rows = [(200 + v, v * 100 + i, 1717200000 + i * 600, 40.0 + i * (0.002 + v * 0.03), -74.0 + i * 0.002) for v in range(3) for i in range(9)]
    df = spark.createDataFrame(rows, "mmsi long, seq long, t_s long, lat double, lon double").withColumn("t", F.timestamp_seconds("t_s")).drop("t_s")
    df.where("seq % 100 < 5").coalesce(1).write.parquet(str(tmp_path / "in"))
    df.where("seq % 100 >= 5").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = jobs.stream_features(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = {(r.mmsi, r.seq): r for r in features.with_history(features.track_features(df)).collect()}
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == len(batch) == 27
    for r in got:
        b = batch[r.mmsi, r.seq]
        assert (r.gap_s, r.distance_m, r.p_physical) == (pytest.approx(b.gap_s), pytest.approx(b.distance_m), pytest.approx(b.p_physical)) and len(r.history) == len(b.history)


def test_late_and_future(spark):
    df = spark.createDataFrame([(1, 1000), (2, 100), (3, 99999)], "k int, s long").withColumn("t", F.timestamp_seconds("s"))
    good, side, top = jobs.split_late(df, 900.0, late_s=600, now=1100.0)
    assert {r.k for r in good.collect()} == {1} and {(r.k, r.reason) for r in side.collect()} == {(2, "late"), (3, "future")} and top == 1000.0


def test_reports(spark, tmp_path):
    good = '{"mmsi": 5, "t": "2024-06-01T00:00:00Z", "lat": 1, "lon": 2, "sog": null}'
    rows = [good, '{"mmsi": true, "t": "2024-06-01T00:00:00Z", "lat": 1, "lon": 2}', '{"mmsi": "007", "t": "2024-06-01T00:00:00+01:00", "lat": 1, "lon": 2}', "{broken", '{"mmsi": 5, "t": "2024-06-01T00:00:00", "lat": 1, "lon": 2}', '{"mmsi": 1000000000, "t": "2024-06-01T00:00:00Z", "lat": 1, "lon": 2}']
    got = reports.parse_reports(spark.createDataFrame([(x,) for x in rows], "value string")).collect()
    assert [r.reject_reason for r in got] == [None, "mmsi", None, "json", "t", "mmsi"] and got[2].mmsi == 7
    (tmp_path / "a.jsonl").write_text(good + "\n\n" + good.replace('"lat": 1', '"lat": 91') + "\n")
    assert [r.reject_reason for r in reports.read_positions(spark, str(tmp_path / "a.jsonl"), "quarantine").collect()] == [None, "lat"]
    with pytest.raises(Exception, match="bad report"):
        reports.read_positions(spark, str(tmp_path / "a.jsonl")).collect()


def test_upsert_and_compaction(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([(1, "x", "p"), (2, "y", "q")], "k long, v string, part string")
    for _ in range(2):
        tables.upsert_table(a, path, ["k"], ["part"])
    tables.upsert_table(spark.createDataFrame([(2, "z", "q"), (3, "w", "q")], a.schema), path, ["k"], ["part"])
    tables.upsert_table(a.limit(0), path, ["k"], ["part"])
    assert {(r.k, r.v) for r in spark.read.parquet(path).collect()} == {(1, "x"), (2, "z"), (3, "w")}
    done = {r.state: r for r in tables.compact(spark, path, str(tmp_path / "u")).collect()}
    assert done["before"]["rows"] == done["after"]["rows"] == 3 and done["after"].files == 1


def test_tracks_lanes_and_routes(spark):
    x, y = np.array([0.0, 1000, 2000, 2000, 2000]), np.array([0.0, 1, 0, 1000, 2000])
    assert lanes.rdp_keep(x, y, 200).tolist() == [True, False, True, False, True]
    nodes = spark.createDataFrame([("a", 40.0, -74.0, 3), ("b", 40.5, -74.0, 5)], "node_id string, lat double, lon double, vessel_count long")
    edges = spark.createDataFrame([("a", "b", 2), ("b", "a", 1)], "from_node string, to_node string, frequency long")
    length = joins.edge_lengths(nodes, edges)
    best = {r.start: (r.route, r.reward) for r in lanes.best_routes(nodes, length, 3).collect()}
    assert best["b"][0] == ["b"] and best["b"][1] == pytest.approx(5 / 8)
    with pytest.raises(Exception, match="hop is not an edge"):
        lanes.route_reward(spark.createDataFrame([("r", ["a", "a"])], "route_id string, route array<string>"), nodes, length).collect()
    edges = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(20)] + [("x", "y")], "a string, b string")
    assert {r.root for r in graph.connected_components(edges).collect()} == {"000", "x"}


def test_prisms_and_meetings(spark):
    at = lambda s: __import__("datetime").datetime.fromtimestamp(s, __import__("datetime").timezone.utc)
    point = lambda s, lat, lon: (at(s), lat, lon)
    kind = "struct<t:timestamp,lat:double,lon:double>"
    rows = [("p1", 1, point(0, 40.50, -73.95), point(7200, 40.55, -73.90)), ("p2", 2, point(0, 40.60, -73.95), point(7200, 40.56, -73.91)), ("p3", 3, point(0, 10.0, 10.0), point(7200, 10.01, 10.01)), ("p4", 4, point(5, 0.0, 0.0), point(5, 0.0, 0.0))]
    table = prisms.footprints(prisms.prisms(spark.createDataFrame(rows, f"prism_id string, mmsi long, a {kind}, b {kind}"))).cache()
    met = prisms.rendezvous(table).collect()
    assert [(r.a, r.b) for r in met] == [("p1", "p2")] and 0.1 <= met[0].confidence <= 0.99
    assert {r.reject_reason for r in table.collect()} == {None, "duration"}
    square = np.array([[0.0, 0], [2, 0], [2, 2], [0, 2]])
    assert prisms.ring_area(prisms.clip_convex(square[None], square[None] + 1.0)) == pytest.approx(1.0)
    turned = np.array([[1.0, -1], [3, 1], [1, 3], [-1, 1]])  # holds all but the corners' outside of the square
    many = np.stack((square, square + 5.0, square / 2 + 0.5, turned))
    assert prisms.ring_area(prisms.clip_convex(many, np.stack([square] * 4))).tolist() == pytest.approx([4.0, 0.0, 1.0, 4.0])
    assert prisms.overlap_groups(np.array([179.0, -179.5, 0.0]), np.array([181.0, -178.5, 1.0]), np.zeros(3), np.ones(3)).tolist() == [0, 0, 2]


def test_meetings_need_common_time_and_measure_turned_rectangles(spark):
    at = lambda s: __import__("datetime").datetime.fromtimestamp(s, __import__("datetime").timezone.utc)
    point = lambda s, lat, lon: (at(s), lat, lon)
    rows = [("a", 1, point(0, 0.0, 0.0), point(7200, 0.2, 0.2)), ("b", 2, point(7200, 0.0, 0.0), point(14400, 0.2, 0.2)), ("c", 3, point(7199.5, 0.0, 0.0), point(14400, 0.2, 0.2)), ("d", 4, point(0, 0.1, 179.9), point(7200, 0.1, -179.9)), ("e", 5, point(60, 0.1, -179.95), point(7200, 0.1, 179.95))]
    kind = "struct<t:timestamp,lat:double,lon:double>"
    base = prisms.prisms(spark.createDataFrame(rows, f"prism_id string, mmsi long, a {kind}, b {kind}"))
    met = {(r.a, r.b): r for r in prisms.rendezvous(prisms.footprints(base)).collect()}
    assert set(met) == {("a", "c"), ("b", "c"), ("d", "e")}  # a and b only touch in time
    assert met["a", "c"].t0 == 7_199_500_000 and met["a", "c"].t1 == 7_200_000_000
    # near the equator degrees are square: the rectangle's area is that of its half axes, not of the box about the turned ellipse
    shape = {r.prism_id: (2 * r.semi_major_m * 2 * r.semi_minor_m) / (np.pi / 180 * 6371000.0) ** 2 for r in base.collect()}
    assert met["b", "c"].box_union == pytest.approx(max(shape["b"], shape["c"]), rel=0.01)
    ring = prisms.footprints(base, "rectangle").where("prism_id = 'a'").first()
    assert len(ring.ring) == 4 * prisms.SIDE_POINTS and ring.x1 - ring.x0 > 0


def test_meetings_use_every_silence_over_600_s(spark, monkeypatch):
    every = track_queries.gap_prisms
    monkeypatch.setattr(track_queries, "gap_prisms", lambda s, d: every(s, d).where("duration_s <= 1500 and prism_id in ('200000000-77', '200000004-70')"))
    for name in ("d14_prism_intersections", "d13_rendezvous_tgard"):
        met = track_queries.ENTRIES[name][0](spark, "/root/testdata/sf0.001").select("a", "b").collect()
        assert [tuple(r) for r in met] == [("200000000-77", "200000004-70")], name


def test_courses_of_rounding_noise_are_duckdbs(spark):
    """Steps between reports whose places differ by a last bit: 1,200 turns, as DuckDB's sines give them."""
    rng = random.Random(8)
    rows = []
    for v in range(1200):
        lat, lon = rng.uniform(-60, 60), rng.uniform(-170, 170)
        rows += [(v, 3 * v, 0, lat, lon), (v, 3 * v + 1, 60, math.nextafter(lat, 90) if v % 2 else lat, math.nextafter(lon, 180)), (v, 3 * v + 2, 120, lat + rng.uniform(-0.1, 0.1), lon + rng.uniform(-0.1, 0.1))]
    df = spark.createDataFrame(rows, "mmsi long, seq long, t_s long, lat double, lon double").withColumn("t", F.timestamp_seconds("t_s"))
    got = {r.seq: r.heading_change_deg for r in features.course_change(features.assemble_track(features.with_history(df))).collect()}
    local = df.drop("t").toPandas()
    con = duckdb.connect()
    con.register("positions", local)
    want = dict(con.sql(f"with {track_queries.TRACK},{track_queries.TURN} select seq, heading_change_deg from turn").fetchall())
    assert got == want and sum(x > 0 for x in got.values()) > 1100


def test_turns_far_from_waypoints_make_each_track_once(spark):
    """The track's sort stands in the plan at most twice (itself and the turn of it), however often its points are named."""
    df = spark.createDataFrame([(1, i, 40.0 + i * i * 0.01, -74.0 + i * 0.1) for i in range(8)], "mmsi long, seq long, lat double, lon double").withColumn("t", F.timestamp_seconds(F.col("seq") * 600))
    marks = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0)], "lat double, lon double, lat0 double, lon0 double")
    turns = detect.unexpected_turns(detect.nearest_waypoint(features.course_change(features.assemble_track(features.with_history(df))), marks)).where("unexpected_turn")
    plan = turns.select("mmsi", "seq", "waypoint_m", "turn_severity")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_sort(") <= 2


def test_short_history_scores_no_gap(spark):
    rows = [(1, i, 1717200000 + i * 5000, 40.4, -74.1) for i in range(3)]
    df = spark.createDataFrame(rows, "mmsi long, seq long, s long, lat double, lon double").select("mmsi", "seq", F.timestamp_seconds("s").alias("t"), "lat", "lon")
    segments = spark.createDataFrame([("l", 0, 40.4, -74.1, 40.9, -73.4, 40.6, -73.7)], "lane_id string, ord long, a_lat double, a_lon double, b_lat double, b_lon double, lat0 double, lon0 double")
    marks = spark.createDataFrame([], "lat double, lon double, lat0 double, lon0 double")
    got = detect.score_fleet(df, segments, marks).collect()
    assert [r.score for r in got] == [0.0, 0.0, 0.0] and all(math.isinf(r.waypoint_m) for r in got)


def test_backfill_twice(spark, tmp_path):
    rows = [(200000000 + v, f"2024-06-01T{i // 60:02}:{i % 60:02}:00Z", 40.0 + i * 0.005 * (i < 10) + 0.05 * (i >= 10), -74.0 + 0.005 * max(0, i - 10), 1.0, 2.0, v * 100 + i) for v in range(3) for i in range(20)]
    raw = spark.createDataFrame(rows, "mmsi long, t string, lat double, lon double, sog double, cog double, seq long")
    first = {r.table: r.n for r in lanes.run_backfill(raw, str(tmp_path / "lake")).collect()}
    assert first["positions"] == 60 and first["graph_nodes"] >= 2 and first["graph_edges"] >= 1
    assert {r.table: r.n for r in lanes.run_backfill(raw, str(tmp_path / "lake")).collect()} == first
    with pytest.raises(ValueError, match="lat_range"):
        lanes.run_backfill(raw.withColumn("lat", F.lit(95.0)), str(tmp_path / "other"))
    assert not (tmp_path / "other").exists()


def brute_clusters(places, edge_m, k):
    """Sets of the indices that are dense and reach each other, by all pairs."""
    lat, lon = np.radians(np.array(places)).T
    s = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat[:, None]) * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
    near = 2 * 6_371_000.0 * np.arcsin(np.sqrt(np.minimum(1, s))) <= edge_m
    dense, left, found = set(np.flatnonzero(near.sum(axis=1) >= k).tolist()), [], set()
    while dense:
        group, left = set(), [dense.pop()]
        while left:
            at = left.pop()
            group.add(at)
            more = dense & set(np.flatnonzero(near[at]).tolist())
            dense -= more
            left += more
        if len(group) >= k:
            found.add(frozenset(group))
    return found


@pytest.mark.parametrize("k", [2, 4])
def test_waypoint_clusters_by_all_pairs(spark, k):
    rng = random.Random(k)
    centres = [(40.5, -74.0), (0.0, 180.0), (-67.2, -179.99), (71.99, 12.0)]
    places = [(la + rng.uniform(-0.12, 0.12), (lo + rng.uniform(-0.12, 0.12) / math.cos(math.radians(la)) + 180) % 360 - 180) for la, lo in centres for _ in range(170)]
    places += places[:3] + [(10.0, 10.0)] * k
    rows = [(i, i % 9, la, lo) for i, (la, lo) in enumerate(places)]
    df = spark.createDataFrame([*rows, (-1, 1, None, 3.0)], "i long, mmsi long, lat double, lon double")
    points, nodes = lanes.cluster_waypoints(df, 2000.0, k)
    got = {}
    for r in points.collect():
        got.setdefault(r.node_id, set()).add(r.i)
    noise = got.pop(None)
    want = brute_clusters(places, 2000.0, k)
    assert {frozenset(x) for x in got.values()} == want and -1 in noise and len(want) > 5
    assert {r.node_id for r in nodes.collect()} == set(got)
    edge = [r for r in nodes.collect() if abs(abs(r.lon) - 180) < 0.2 and abs(r.lat) < 1]
    assert edge and all(-180 <= r.lon < 180 for r in edge)
    assert lanes.cluster_waypoints(df.limit(0))[1].count() == 0
