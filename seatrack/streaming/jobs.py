"""Structured Streaming forms (T1-T6): the batch operators under a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.utils import AnalysisException

from seatrack.functions.geo import EARTH_RADIUS_M, EPS, VESSEL_CAP_MPS
from seatrack.operators import cdc, detect, joins
from seatrack.operators.graph import durable

HISTORY = 5
#: Buckets of keys of a registry's state.
STATE_BUCKETS = 64
OUTPUT = "mmsi long, seq long, t timestamp, lat double, lon double, gap_s double, distance_m double, v_required_mps double, p_physical double, history array<struct<t:timestamp,lat:double,lon:double>>"
_STATE = "t timestamp, lat double, lon double"


class _VesselFeatures(StatefulProcessor):
    """The last reports of one vessel; rows of a batch are taken in delivery order."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getListState("last", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        import math

        kept = [tuple(x) for x in self.last.get()] if self.last.exists() else []
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        out = []
        for r in batch.itertuples():
            gap = distance = speed = 0.0
            p = 1.0
            if kept and self.ttl_ms and (pd.Timestamp(r.t) - pd.Timestamp(kept[-1][0])).total_seconds() * 1000 > self.ttl_ms:
                kept = []
            if kept:
                t0, lat0, lon0 = kept[-1]
                gap = max(0.0, (pd.Timestamp(r.t) - pd.Timestamp(t0)).total_seconds())
                a, b = math.radians(lat0), math.radians(r.lat)
                s = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(r.lon - lon0) / 2) ** 2
                distance = 2 * EARTH_RADIUS_M * math.asin(min(1.0, math.sqrt(s)))
                speed = distance / max(gap, EPS)
                p = min(1.0, VESSEL_CAP_MPS / max(speed, EPS))
            history = [{"t": pd.Timestamp(t).to_pydatetime(), "lat": la, "lon": lo} for t, la, lo in kept]
            out.append((key[0], r.seq, r.t, r.lat, r.lon, gap, distance, speed, p, history))
            kept = [*kept, (pd.Timestamp(r.t).to_pydatetime(), r.lat, r.lon)][-HISTORY:]
        self.last.put(kept)
        if self.ttl_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(pd.Timestamp(kept[-1][0]).timestamp() * 1000) + self.ttl_ms)
        yield pd.DataFrame(out, columns=["mmsi", "seq", "t", "lat", "lon", "gap_s", "distance_m", "v_required_mps", "p_physical", "history"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_features(stream: DataFrame, ttl_ms: int | None = None, watermark: str = "10 minutes") -> DataFrame:
    """Features and history of every report of a stream (mmsi, seq, t, lat, lon); the gate is a filter on p_physical after it.

    With ttl_ms a report that comes so long after the vessel's last one, by the
    reports' times, begins a new history; event-time timers drop the state of
    vessels that stay quiet, once the watermark has passed. Such a stream
    leaves out reports behind the watermark.
    """
    rows = stream.select("mmsi", "seq", "t", "lat", "lon")
    if ttl_ms:
        rows = rows.withWatermark("t", watermark)
    return rows.groupBy("mmsi").transformWithStateInPandas(_VesselFeatures(ttl_ms), OUTPUT, "Append", "EventTime" if ttl_ms else "None")


def minute_representatives(df: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """The latest report of each vessel and minute, the first delivered on ties; rows of a table or of a stream."""
    source = df.withWatermark("t", watermark) if df.isStreaming else df
    best = source.groupBy("mmsi", F.window("t", "1 minute").alias("w")).agg(F.max_by(F.struct("seq", "t", "lat", "lon"), F.struct(F.col("t"), -F.col("seq"))).alias("r"))
    return best.select("mmsi", F.col("w.start").alias("minute"), "r.*")


def split_late(batch: DataFrame, seen_until: float | None, late_s: float = 600.0, future_s: float = 300.0, now: float | None = None) -> tuple[DataFrame, DataFrame, float | None]:
    """(on time, side table with reason, new running maximum) of one micro-batch.

    Late is late_s before the largest accepted time of earlier batches. Times
    more than future_s ahead of `now` go to the side and never move the maximum.
    """
    t = F.unix_micros("t") / 1e6
    future = (t > now + future_s) if now is not None else F.lit(False)
    late = (t < seen_until - late_s) if seen_until is not None else F.lit(False)
    told = batch.withColumn("reason", F.when(future, "future").when(late, "late"))
    top = told.where("reason is null").agg(F.max(t)).first()[0]
    now_seen = max(x for x in (top, seen_until, float("-inf")) if x is not None)
    return told.where("reason is null").drop("reason"), told.where("reason is not null"), None if now_seen == float("-inf") else now_seen


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def stream_on_time(stream: DataFrame, path: str, checkpoint: str, late_s: float = 600.0, future_s: float = 300.0, now: float | None = None):
    """A stream of reports into path/on_time and path/side (with reason), by batch; split_late with the largest time of all batches before.

    That time is committed with each batch in one of two slots, so a restart
    goes on where the last batch ended, and a repeated batch sees what it saw.
    """

    def split(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = _read(spark, f"{path}/seen")
        until = None if seen is None else seen.where(F.col("batch_id") < batch_id).agg(F.max_by("until", "batch_id")).first()[0]
        good, side, top = split_late(durable(batch), until, late_s, future_s, now)
        good.write.mode("overwrite").parquet(f"{path}/on_time/batch_id={batch_id}")
        side.write.mode("overwrite").parquet(f"{path}/side/batch_id={batch_id}")
        told = spark.createDataFrame([(batch_id, top)], "batch_id long, until double")
        told.write.mode("overwrite").parquet(f"{path}/seen/slot={batch_id % 2}")

    return stream.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_scores(features: DataFrame, segments: DataFrame, waypoints: DataFrame, registry: DataFrame | None, queue_path: str, checkpoint: str, gate: float = 0.3, **trigger):
    """T4: scores of gated reports go to the review queue. Trace ids hash the request, so a redelivery adds nothing.

    The batch id names its folder, so a repeated batch replaces its own rows.
    The default trigger ends with what is there.
    """

    def score(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        from seatrack.operators import features as W

        # read several times below, while the state behind it may be opened once a batch
        gated = durable(batch.where(F.col("p_physical") >= gate))
        df, _ = W.reject_corrupt(W.speed_signal(W.assemble_track(gated)))
        df = detect._track_gap(W.course_change(df))
        df = detect.unexpected_turns(detect.nearest_waypoint(detect.off_lane(detect.nearest_lane(df, segments, ["mmsi", "seq"])), waypoints))
        if registry is None:
            df = df.withColumn("watchlisted", F.lit(False)).withColumn("sanctioned", F.lit(False))
        else:
            df = joins.with_registry(df, registry)
        scored = detect.fuse(df).withColumn("trace_id", F.sha2(F.to_json(F.struct("mmsi", "t", "lat", "lon", "history")), 256))
        rows = scored.where("needs_review").select("trace_id", "mmsi", "seq", "t", "score", "confidence", "reasons", F.col("t").alias("created_at"))
        stored = _read(spark, queue_path)
        if stored is not None:
            earlier = stored.where(F.col("batch_id") != batch_id)
            rows = joins.enqueue(earlier, rows)
        else:
            rows = rows.dropDuplicates(["trace_id"])
        rows.write.mode("overwrite").parquet(f"{queue_path.rstrip('/')}/batch_id={batch_id}")

    return features.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _buckets() -> Column:
    return F.pmod(F.xxhash64("event_table", "pk"), F.lit(STATE_BUCKETS)).cast("int")


def registry_state(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The registry's state (event_table, pk, lsn, deleted, content, bucket, slot): each bucket's newest version, or the newest below `before`; None if nothing is stored."""
    stored = _read(spark, f"{path}/state")
    if stored is None:
        return None
    if before is not None:
        stored = stored.where(F.col("version") < before)
    newest = stored.groupBy("bucket").agg(F.max("version").alias("version"))  # a row for each bucket
    return stored.join(F.broadcast(newest), ["bucket", "version"]).drop("version")


def apply_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """One batch of envelopes (seq, topic, key, value): verdicts against the stored state, audit rows, and the state of the keys it names.

    The state lies in STATE_BUCKETS buckets of keys, and a batch rewrites those
    that it touches only. Each bucket has two slots: the new version takes the
    one that doesn't hold the version before it, which a failure leaves whole,
    and older versions are overwritten. A repeated batch starts from the same
    versions and gives the same rows.
    """
    spark = batch.sparkSession
    parsed = durable(cdc.parse_envelopes(batch))
    changes = parsed.where("kind = 'change'")
    touched = [r[0] for r in changes.select(_buckets()).distinct().collect()]  # STATE_BUCKETS numbers at most
    base = registry_state(spark, path, batch_id)
    slots = {}
    if base is not None:
        base = durable(base.where(F.col("bucket").isin(touched)))
        slots = dict(base.select("bucket", "slot").distinct().collect())
        base = base.drop("bucket", "slot")
    verdicts = cdc.guard_verdicts(changes, base)
    cdc.audit_rows(verdicts, batch_id).drop("batch_id").write.mode("overwrite").parquet(f"{path}/audit/batch_id={batch_id}")
    cdc.touched_keys(verdicts).write.mode("overwrite").parquet(f"{path}/touched/batch_id={batch_id}")
    if not touched:
        return
    state = cdc.reduce_state(changes)
    state = cdc.merge_state(base, state) if base is not None else state
    used = F.create_map(*[F.lit(x) for b in touched for x in (b, 1 - slots.get(b, 1))])
    rows = state.withColumn("version", F.lit(batch_id).cast("long")).withColumn("bucket", _buckets()).withColumn("slot", F.element_at(used, F.col("bucket")))
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "slot").parquet(f"{path}/state")


def stream_registry(messages: DataFrame, path: str, checkpoint: str):
    """T5: applies a stream of envelopes batch by batch."""
    return messages.writeStream.foreachBatch(lambda b, i: apply_batch(b, i, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
