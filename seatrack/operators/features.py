"""Track features of each vessel (W1-W8) and the predicates over them."""

from __future__ import annotations

import math

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seatrack.functions.geo import CAPS_MPS, EPS, VESSEL_CAP_MPS, bound, haversine_m, seconds_between

GATE = 0.3
HISTORY = 5
CORRUPT_FACTOR = 12.0
SLACK = 1.05


def delivery(by: str = "mmsi", order: str = "seq"):
    """All of one vessel's reports in delivery order: one shuffle on the vessel, shared by every operator that uses it."""
    return Window.partitionBy(by).orderBy(order)


def track_features(positions: DataFrame, order: str = "seq", cap_mps: float = VESSEL_CAP_MPS) -> DataFrame:
    """gap_s, distance_m, v_required_mps, p_physical against the previous report; 0, 0, 0, 1 for a first one."""
    w = delivery(order=order)
    previous = positions.select("*", F.lag(F.struct("t", "lat", "lon")).over(w).alias("prev"))
    gap = F.greatest(F.lit(0.0), seconds_between(F.col("prev.t"), F.col("t")))
    distance = haversine_m(F.col("prev.lat"), F.col("prev.lon"), F.col("lat"), F.col("lon"))
    first = F.col("prev").isNull()
    out = previous.withColumn("gap_s", F.when(first, 0.0).otherwise(gap)).withColumn("distance_m", F.when(first, 0.0).otherwise(distance))
    out = out.withColumn("v_required_mps", F.when(first, 0.0).otherwise(F.col("distance_m") / F.greatest(F.col("gap_s"), F.lit(EPS))))
    return out.withColumn("p_physical", F.when(first, 1.0).otherwise(F.least(F.lit(1.0), cap_mps / F.greatest(F.col("v_required_mps"), F.lit(EPS))))).drop("prev")


def with_history(positions: DataFrame, n: int = HISTORY, order: str = "seq") -> DataFrame:
    """Up to n earlier reports of the vessel, oldest first."""
    w = delivery(order=order).rowsBetween(-n, -1)
    return positions.withColumn("history", F.collect_list(F.struct("t", "lat", "lon")).over(w))


def physics_gate(features: DataFrame, threshold: float = GATE) -> DataFrame:
    """Plausible reports only. It stands after the history windows, as rejected reports are history too."""
    return features.where(F.col("p_physical") >= threshold)


def assemble_track(df: DataFrame) -> DataFrame:
    """History and current report by time; of equal times the first one, in history order, stays."""
    points = F.concat("history", F.array(F.struct("t", "lat", "lon")))
    tagged = F.transform(points, lambda p, i: F.struct(p["t"].alias("t"), i.alias("i"), p["lat"].alias("lat"), p["lon"].alias("lon")))
    first = bound(F.array_sort(tagged), lambda ordered: F.filter(ordered, lambda p, i: (i == 0) | (p["t"] != F.element_at(ordered, F.greatest(i, F.lit(1)))["t"])))
    return df.withColumn("track", F.transform(first, lambda p: F.struct(p["t"].alias("t"), p["lat"].alias("lat"), p["lon"].alias("lon"))))


def _steps(track: Column) -> Column:
    """Consecutive pairs of a track."""
    n = F.size(track)
    return F.when(n > 1, F.zip_with(F.slice(track, F.lit(1), F.greatest(n - 1, F.lit(1))), F.slice(track, F.lit(2), F.greatest(n - 1, F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).otherwise(
        F.array().cast("array<struct<a:struct<t:timestamp,lat:double,lon:double>,b:struct<t:timestamp,lat:double,lon:double>>>")
    )


def speed_signal(df: DataFrame, cap_mps: float = VESSEL_CAP_MPS, saturation: float = 3.0) -> DataFrame:
    """The largest speed that any step of the track requires, and its severity; steps without time count as 0."""
    step = lambda s: F.when(
        seconds_between(s["a"]["t"], s["b"]["t"]) > 0,
        haversine_m(s["a"]["lat"], s["a"]["lon"], s["b"]["lat"], s["b"]["lon"]) / seconds_between(s["a"]["t"], s["b"]["t"]),
    ).otherwise(0.0)
    out = df.withColumn("v_max_mps", F.coalesce(bound(F.col("track"), lambda track: F.array_max(F.transform(_steps(track), step))), F.lit(0.0)))
    return out.withColumn("speed_severity", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("v_max_mps") / cap_mps - 1.0) / saturation)))


def reject_corrupt(df: DataFrame, cap_mps: float = VESSEL_CAP_MPS, factor: float = CORRUPT_FACTOR) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by the largest speed of the track."""
    bad = F.col("v_max_mps") > factor * cap_mps
    return df.where(~bad), df.where(bad)


def _turn_deg(ends: pa.Array) -> pa.Array:
    """Angle between the courses of two steps, 0 to 180, for [lat, lon, lat, lon, lat, lon]."""
    lat, lon = ([pc.list_element(ends, 2 * i + k) for i in range(3)] for k in (0, 1))

    def course(m, n):
        a, b, across = pc.multiply(lat[m], math.pi / 180), pc.multiply(lat[n], math.pi / 180), pc.multiply(pc.subtract(lon[n], lon[m]), math.pi / 180)
        north = pc.subtract(pc.multiply(pc.cos(a), pc.sin(b)), pc.multiply(pc.multiply(pc.sin(a), pc.cos(b)), pc.cos(across)))
        return pc.multiply(pc.atan2(pc.multiply(pc.sin(across), pc.cos(b)), north), 180 / math.pi)

    raw = pc.abs(pc.subtract(course(0, 1), course(1, 2)))
    turn = pc.subtract(raw, pc.multiply(pc.floor(pc.divide(raw, 360.0)), 360.0))
    return pc.min_element_wise(turn, pc.subtract(360.0, turn), skip_nulls=False)


def course_change(df: DataFrame) -> DataFrame:
    """Angle between the last two steps of the track, 0 to 180; 0 with fewer than three points.

    Two reports of one place may differ by their last bit, and the course of
    such a step is the rounding of sines. Arrow takes them from the C library,
    as DuckDB does; the JVM's own differ in the last bit now and then, and
    there by any angle.
    """
    turn = F.arrow_udf(_turn_deg, "double").asNondeterministic()  # else a filter on it computes it again
    last = lambda track: F.when(F.size(track) >= 3, F.array(*[F.element_at(track, -k)[c] for k in (3, 2, 1) for c in ("lat", "lon")]))
    return df.withColumn("heading_change_deg", turn(bound(F.col("track"), last))).withColumn("heading_change_deg", F.when(F.size("track") >= 3, F.col("heading_change_deg")).otherwise(0.0))


def detector_flags(df: DataFrame) -> DataFrame:
    """Which detectors have enough history."""
    n = F.size("history")
    return df.select("*", n.alias("n_history"), (n >= 1).alias("runs_speed"), (n >= 3).alias("runs_gap"), F.lit(True).alias("runs_lane"))


def feature_rows(features: DataFrame, ttl_days: int = 7) -> DataFrame:
    """An online item for each gated report, expiring ttl_days after it."""
    return features.select(
        F.col("mmsi").cast("string").alias("entity_id"), F.lit("track").alias("feature_name"), "seq", F.col("t").alias("event_time"),
        "gap_s", "distance_m", "v_required_mps", "p_physical", (F.unix_seconds("t") + ttl_days * 86400).alias("ttl"),
    )


def latest_features(rows: DataFrame) -> DataFrame:
    """The last delivered item of each key."""
    rest = [c for c in rows.columns if c not in ("entity_id", "feature_name")]
    return rows.groupBy("entity_id", "feature_name").agg(F.max_by(F.struct(*rest), "seq").alias("r")).select("entity_id", "feature_name", "r.*")


def score_requests(df: DataFrame) -> DataFrame:
    """The request document of each report."""
    time = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    point = lambda p: F.struct(time(p["t"]).alias("t"), p["lat"].alias("lat"), p["lon"].alias("lon"))
    body = F.struct("mmsi", F.struct(time(F.col("t")).alias("t"), "lat", "lon", "sog", "cog").alias("fix"), F.transform("history", point).alias("history"))
    return df.select("mmsi", "seq", F.to_json(body).alias("request"))


def monotone_violations(df: DataFrame, time: str = "t", order: str = "seq") -> DataFrame:
    """Reports whose time is missing or before that of the vessel's previous report."""
    previous = F.lag(time).over(delivery(order=order))
    return df.withColumn("prev_t", previous).where(F.col(time).isNull() | (F.col(time) < F.col("prev_t")))


def flag_uncertain(df: DataFrame, threshold: float = 0.6, margin: float = 0.1, max_variance: float = 0.05) -> DataFrame:
    """Near the threshold, or of high variance; an unknown variance never flags."""
    near = F.abs(F.col("score") - threshold) <= margin
    return df.withColumn("uncertain", F.coalesce(near, F.lit(False)) | F.coalesce(F.col("epistemic_variance") > max_variance, F.lit(False)))


def for_tenant(df: DataFrame, tenant: str | None) -> DataFrame:
    """P5: one tenant's rows; no tenant sees none."""
    return df.where(F.col("tenant_id") == F.nullif(F.lit(tenant).cast("string"), F.lit("")))


def require_tenant(df: DataFrame) -> DataFrame:
    """P5: fails the job at the first row that would be written without a tenant."""
    return df.withColumn("tenant_id", F.when(F.coalesce(F.col("tenant_id"), F.lit("")) == "", F.raise_error(F.lit("row without tenant"))).otherwise(F.col("tenant_id")))


def kinematic_violations(anchors: DataFrame, cap_mps: float = VESSEL_CAP_MPS, slack: float = SLACK) -> DataFrame:
    """Consecutive anchors in time that no vessel can join, with the slack."""
    w = Window.partitionBy("mmsi").orderBy("t", "seq")
    p = anchors.withColumn("prev", F.lag(F.struct("t", "lat", "lon")).over(w)).where("prev is not null")
    dt = seconds_between(F.col("prev.t"), F.col("t"))
    v = haversine_m(F.col("prev.lat"), F.col("prev.lon"), F.col("lat"), F.col("lon")) / F.when(dt > 0, dt)
    return p.withColumn("speed_mps", v).where((dt > 0) & (F.col("speed_mps") > slack * cap_mps)).drop("prev")


def admit_requests(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(admitted, rejected with `reason`): ranges of a score request; null speed, course and heading pass."""
    checks = [
        ("mmsi", F.col("mmsi").isNull() | ~F.col("mmsi").between(0, 999_999_999)),
        ("lat", F.col("lat").isNull() | F.isnan("lat") | ~F.col("lat").between(-90, 90)),
        ("lon", F.col("lon").isNull() | F.isnan("lon") | ~F.col("lon").between(-180, 180)),
        ("t", F.col("t").isNull()),
        ("sog", F.coalesce(F.col("sog") < 0, F.lit(False))),
        ("cog", F.coalesce(~F.col("cog").between(0, 360), F.lit(False))),
        ("heading", F.coalesce(~F.col("heading").between(0, 360), F.lit(False))),
        ("domain", ~F.coalesce(F.col("domain"), F.lit("")).isin(*CAPS_MPS)),
    ]
    reason = F.coalesce(*[F.when(bad, F.lit(name)) for name, bad in checks])
    told = df.withColumn("reason", reason)
    return told.where("reason is null").drop("reason"), told.where("reason is not null")
