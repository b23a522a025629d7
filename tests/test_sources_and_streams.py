"""Landing, replay, extracts, lane files, drift windows, manifests, and the streaming jobs."""

import json
import time

import pytest
from pyspark.sql import functions as F

from seatrack.operators import features, monitor, preference
from seatrack.sources import reports, tables
from seatrack.streaming import jobs

TRACK = "mmsi long, seq long, t_s long, lat double, lon double"


def track(spark, n=6, vessels=2, jump=0.0):
    rows = [(200 + v, v * 100 + i, 1717200000 + i * 600, 40.4 + i * 0.01 + (jump if i == n - 1 else 0.0), -74.1 + i * 0.01) for v in range(vessels) for i in range(n)]
    return spark.createDataFrame(rows, TRACK).withColumn("t", F.timestamp_seconds("t_s")).drop("t_s")


def test_provider_envelopes(spark):
    def message(kind="PositionReport", heading=511, when="2024-06-01 10:00:00.123456789 +0000 UTC", lat=40.5):
        position = {"Latitude": lat, "Longitude": -74.0, "Sog": 1.5, "Cog": 90.0, "TrueHeading": heading}
        return json.dumps({"MessageType": kind, "MetaData": {"MMSI": 7, "time_utc": when}, "Message": {"PositionReport": position}})

    rows = [message(), message(heading=12), message(kind="ShipStaticData"), message(when="soon"), message(lat=None), "{broken", None]
    got = reports.parse_provider_envelope(spark.createDataFrame([(x,) for x in rows], "value string")).collect()
    assert [(r.mmsi, r.lat, r.sog, r.heading) for r in got] == [(7, 40.5, 1.5, None), (7, 40.5, 1.5, 12.0)]
    assert got[0].t.microsecond == 123456


def test_landing_keeps_every_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one\ntwo\n{broken\n")
    stream = spark.readStream.schema("value string").text(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        assert reports.land_raw(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(60)
    got = spark.read.text(str(tmp_path / "out"))
    assert sorted(r.value for r in got.collect()) == ["one", "two", "{broken"] and "ingest_date" in got.columns
    assert list((tmp_path / "out").rglob("*.gz"))


def test_replay_streams_every_row(spark, tmp_path):
    df = track(spark, 20)
    stream = reports.replay_as_stream(spark, df, str(tmp_path / "slices"), 3600)
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.mmsi, r.seq) for r in got.collect()} == {(r.mmsi, r.seq) for r in df.collect()} and got.count() == 40
    assert q.lastProgress["batchId"] >= 3  # four slices of an hour


def test_extract_days(spark, tmp_path):
    rows = [(1, f"2024-06-0{d}T00:00:00Z", 40.0, -74.0, 1.0, 2.0) for d in (1, 2, 3)]
    spark.createDataFrame(rows, reports.EXTRACT).write.parquet(str(tmp_path / "x"))
    days = lambda *a: sorted(r.t[:10] for r in reports.read_extract(spark, str(tmp_path / "x"), *a).collect())
    assert len(days()) == 3 and days("2024-06-02") == ["2024-06-02", "2024-06-03"] and days(None, "2024-06-01") == ["2024-06-01"]


def test_lane_file(spark, tmp_path):
    lanes = [{"id": "a", "name": "A", "nodes": [[-74.0, 40.0], [-73.0, 41.0], [-72.0, 42.0]]}, {"id": "b", "name": "B", "nodes": [[-71.0, 40.0], [-70.0, 40.0]]}]
    (tmp_path / "lanes.json").write_text(json.dumps({"lanes": lanes, "waypoints": [{"id": "w", "lonlat": [-73.0, 41.0]}]}, indent=1))
    segments, marks = reports.read_lanes(spark, str(tmp_path / "lanes.json"))
    got = segments.orderBy("ord").collect()
    assert [(r.lane_id, r.a_lon, r.b_lon) for r in got] == [("a", -74.0, -73.0), ("a", -73.0, -72.0), ("b", -71.0, -70.0)]
    assert got[0].lat0 == pytest.approx(40.6) and got[0].lon0 == pytest.approx(-72.0)
    assert [(r.waypoint_id, r.lat, r.lon) for r in marks.collect()] == [("w", 41.0, -73.0)]


def test_window_selection(spark, tmp_path):
    path = str(tmp_path / "w")
    good = track(spark, 60).withColumn("sog", F.lit(1.0))
    good.coalesce(1).write.parquet(path)
    good.limit(5).coalesce(1).write.mode("append").parquet(path)
    good.withColumn("sog", F.when(F.col("seq") == 3, float("nan")).otherwise(1.0)).coalesce(1).write.mode("append").parquet(path)
    window, verdicts = tables.select_window(spark, path, good, ["sog"], min_rows=100, max_rows=110)
    assert sorted(str(r.reject_reason) for r in verdicts.collect()) == ["None", "numbers", "rows"]
    assert window.count() == 110 and window.agg(F.min("t")).first()[0] > good.agg(F.min("t")).first()[0]
    window, verdicts = tables.select_window(spark, path, good.drop("sog"), ["sog"])
    assert {r.reject_reason for r in verdicts.collect()} == {"schema"} and window.count() == 0


def test_manifests(spark):
    rows = [(1, "m1", "sha"), (3, "m3", " "), (2, "m2", None)]
    df = spark.createDataFrame(rows, "seq long, model string, commit string")
    assert reports.latest_manifest(df).first().model == "m3" and reports.latest_manifest(df.limit(0)).count() == 0
    assert {r.model: r.missing for r in reports.incomplete_manifest(df, ["model", "commit"]).collect()} == {"m3": ["commit"], "m2": ["commit"]}


def test_layout_keeps_a_vessel_in_one_bucket(spark):
    got = tables.with_layout(track(spark, 200, 40), "positions")
    per = got.groupBy("mmsi").agg(F.countDistinct("mmsi_bucket").alias("n"), F.min("mmsi_bucket").alias("low"), F.max("mmsi_bucket").alias("high")).collect()
    assert all(r.n == 1 and 0 <= r.low <= r.high < tables.BUCKETS for r in per) and len({r.low for r in per}) > 5
    assert {str(r.t_day) for r in got.select("t_day").distinct().collect()} == {"2024-06-01", "2024-06-02"}
    assert tables.with_layout(got, "graph_nodes").columns == got.columns


def test_upsert_takes_the_largest_of_equal_keys(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "c"), (1, "b"), (2, None)], "k long, v string")
    for _ in range(2):
        tables.upsert_table(df.repartition(4), str(tmp_path / "t"), ["k"])
        assert {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {(1, "c"), (2, None)}


def envelope(mmsi, lsn, op="u", name="x"):
    after = None if op == "d" else {"mmsi": mmsi, "name": name}
    return json.dumps({"payload": {"op": op, "before": None, "after": after, "source": {"table": "vessels", "lsn": lsn}, "ts_ms": 7}})


MESSAGES = [(0, 1, 5, "c", "a"), (1, 2, 6, "c", "b"), (2, 1, 9, "u", "new"), (3, 1, 7, "u", "old"), (4, 2, 8, "d", ""), (5, 3, 4, "r", "s")]


def messages(spark, rows):
    made = [(seq, "t", json.dumps({"payload": {"mmsi": m}}), envelope(m, lsn, op, name)) for seq, m, lsn, op, name in rows]
    return spark.createDataFrame(made, "seq long, topic string, key string, value string")


def final_state(spark, path):
    return {json.loads(r.pk)["mmsi"]: (r.lsn, r.deleted, r.content and json.loads(r.content)["name"]) for r in jobs.registry_state(spark, path).collect()}


def test_batches_converge_after_failure_and_redelivery(spark, tmp_path):
    want = {1: (9, False, "new"), 2: (8, True, None), 3: (0, False, "s")}
    path = str(tmp_path / "a")
    for batch_id in (0, 1, 1, 2):  # batch 1 is repeated as after a failed sink, batch 2 delivers batch 0 again
        part = MESSAGES[:3] if batch_id in (0, 2) else MESSAGES[3:]
        jobs.apply_batch(messages(spark, part), batch_id, path)
    assert final_state(spark, path) == want
    audit = spark.read.parquet(f"{path}/audit").collect()
    assert len(audit) == 9 and not any(r.applied for r in audit if r.batch_id == 2)
    assert spark.read.parquet(f"{path}/touched").select("pk").distinct().count() == 3


def test_registry_stream(spark, tmp_path):
    for part in (MESSAGES[:3], MESSAGES[3:]):
        messages(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq long, topic string, key string, value string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert jobs.stream_registry(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    assert final_state(spark, str(tmp_path / "out")) == {1: (9, False, "new"), 2: (8, True, None), 3: (0, False, "s")}


def test_scored_stream_fills_the_queue_once(spark, tmp_path):
    track(spark, 8, 2, jump=0.05).coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema("mmsi long, seq long, lat double, lon double, t timestamp").parquet(str(tmp_path / "in"))
    segments = spark.createDataFrame([("l", 0, 30.0, -60.0, 30.1, -60.1, 30.0, -60.0)], "lane_id string, ord long, a_lat double, a_lon double, b_lat double, b_lon double, lat0 double, lon0 double")
    marks = spark.createDataFrame([(30.0, -60.0, 30.0, -60.0)], "lat double, lon double, lat0 double, lon0 double")
    items = spark.createDataFrame([(200, "watchlist", False, "r", 0.9)], "mmsi long, feature_name string, deleted boolean, reason string, severity double")
    queue = str(tmp_path / "queue")
    counts = []
    for run in range(2):  # a new checkpoint delivers everything again
        scored = jobs.stream_scores(jobs.stream_features(read()), segments, marks, items, queue, str(tmp_path / f"c{run}"), gate=0.0)
        assert scored.awaitTermination(120)
        counts.append(spark.read.parquet(queue).count())
    stored = spark.read.parquet(queue)
    assert counts[0] == counts[1] == stored.select("trace_id").distinct().count() > 0


def test_batches_write_what_they_touch(spark, tmp_path):
    """A batch of three keys rewrites three buckets at most, versions before the last two go, and no key is lost."""
    path = str(tmp_path / "a")
    jobs.apply_batch(messages(spark, [(i, i, 1, "c", "a") for i in range(500)]), 0, path)
    assert len(list((tmp_path / "a/state").glob("bucket=*"))) == jobs.STATE_BUCKETS
    for batch_id in (1, 2, 3):
        before = {p: p.stat().st_mtime_ns for p in (tmp_path / "a/state").rglob("*.parquet")}
        jobs.apply_batch(messages(spark, [(i, i, batch_id + 1, "u", f"b{batch_id}") for i in range(3)]), batch_id, path)
        after = {p: p.stat().st_mtime_ns for p in (tmp_path / "a/state").rglob("*.parquet")}
        assert 1 <= len({p for p in after if before.get(p) != after[p]}) <= 3
    assert len(list((tmp_path / "a/state").rglob("*.parquet"))) <= jobs.STATE_BUCKETS + 3
    state = final_state(spark, path)
    assert len(state) == 500 and state[1] == (4, False, "b3") and state[7] == (1, False, "a")


def test_late_reports_stay_late_after_a_restart(spark, tmp_path):
    kind, path = "k long, t timestamp", str(tmp_path / "out")
    for rows in ([(1, 10_000), (2, 9_500)], [(3, 5_000), (4, 10_100), (5, 99_999)]):
        df = spark.createDataFrame(rows, "k long, s long").select("k", F.timestamp_seconds("s").alias("t"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        assert jobs.stream_on_time(stream, path, str(tmp_path / "c"), now=10_200.0).awaitTermination(120)
    assert sorted(r.k for r in spark.read.parquet(f"{path}/on_time").collect()) == [1, 2, 4]
    assert {(r.k, r.reason) for r in spark.read.parquet(f"{path}/side").collect()} == {(3, "late"), (5, "future")}
    assert spark.read.parquet(f"{path}/seen").agg(F.max("until")).first()[0] == 10_100.0


def test_quiet_vessels_lose_their_history(spark, tmp_path):
    """Seven days by the reports' times, with a trigger that ends: vessel 1 was quiet for eight, vessel 2 was not."""
    day = 86_400
    for rows in ([(1, 0, 0), (1, 1, 600), (2, 2, 0), (2, 3, 5 * day)], [(3, 4, 8 * day)], [(1, 5, 8 * day + 60), (2, 6, 8 * day + 60)]):
        df = spark.createDataFrame(rows, "mmsi long, seq long, s long").select("mmsi", "seq", F.timestamp_seconds(F.col("s") + 1_717_200_000).alias("t"), F.lit(40.0).alias("lat"), F.lit(-74.0).alias("lon"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    q = jobs.stream_features(stream, ttl_ms=7 * day * 1000).writeStream.format("parquet").option("path", str(tmp_path / "out"))
    assert q.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    got = {r.seq: (round(r.gap_s), len(r.history)) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: (0, 0), 1: (600, 1), 2: (0, 0), 3: (5 * day, 1), 4: (0, 0), 5: (0, 0), 6: (3 * day + 60, 2)}


def test_newest_acceptable_window(spark, tmp_path):
    """Of three files the newest has text for numbers and the next is no table."""
    path = tmp_path / "w"
    good = track(spark, 60).select("mmsi", "t", "lat")
    good.coalesce(1).write.parquet(str(path / "a"))
    time.sleep(1.1)
    (path / "b").mkdir()
    (path / "b" / "x.parquet").write_text("no table")
    time.sleep(1.1)
    good.withColumn("lat", F.lit("text")).coalesce(1).write.parquet(str(path / "c"))
    window, verdicts = tables.select_window(spark, str(path), good, ["lat"], min_rows=50, max_rows=70)
    told = [str(r.reject_reason).split(":")[0] for r in verdicts.orderBy(F.desc("at")).collect()]
    assert told == ["schema", "unreadable", "None"] and window.count() == 70
    again = tables.select_window(spark, str(path), good, ["lat"], min_rows=50, max_rows=70)[1]
    digest = lambda v: [r.content_hash for r in v.where("reject_reason is null").collect()]
    assert digest(again) == digest(verdicts) and len(digest(verdicts)[0]) == 64


def test_triples_are_appended(spark, tmp_path):
    df = spark.createDataFrame([("t1", "good", "bad")], "trace_id string, chosen string, rejected string")
    for _ in range(2):
        preference.write_triples(df, str(tmp_path / "t"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "t")).select("trace_id", "chosen", "rejected").collect()] == [("t1", "good", "bad")] * 2


def test_small_reports(spark):
    df = spark.createDataFrame([(1, "a"), (2, "")], "k long, tenant_id string")
    assert features.require_tenant(df.where("k = 1")).count() == 1
    with pytest.raises(Exception, match="row without tenant"):
        features.require_tenant(df).collect()
    keys = spark.createDataFrame([("x",)] * 9 + [("y",)], "key string")
    counts = {r.shard: r.n for r in monitor.shard_counts(keys, "key", 4).collect()}
    assert sum(counts.values()) == 10 and len(counts) == 4
    assert monitor.shard_skew(keys, "key", 4).first().skew == pytest.approx(max(counts.values()) / 10 * 4)
    assert monitor.shard_skew(keys.limit(0), "key", 4).first().skew == 1.0
    got = monitor.trial_variation(spark.createDataFrame([(1.0,), (3.0,)], "p95 double")).first()
    assert (got["mean"], got.deviation, got.variation) == (2.0, pytest.approx(2**0.5), pytest.approx(2**0.5 / 2))
    scored = spark.createDataFrame([([("gap", 1.0), ("turn", 2.0)],), ([("gap", 1.0)],), ([],)], "reasons array<struct<code:string,weight:double>>")
    assert {r.code: r.n for r in monitor.reason_counts(scored).collect()} == {"gap": 2, "turn": 1}
