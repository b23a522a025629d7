"""Error budgets, load, pressure, stream skew, cost and slot lag."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import order_statistics

# Tiers: name, burn threshold, long and short window in seconds, status rank (2 page, 1 warning).
TIERS = (("fast", 14.4, 3600, 300, 2), ("slow", 6.0, 21600, 1800, 2), ("warn", 3.0, 86400, 7200, 1))
SLOT_LAG_BYTES = 200 * 1024 * 1024
LATENCY_BOUNDS = (0.05, 0.1, 0.2, 0.3, 0.5, 1.0, 2.5, 5.0)


def burn_rate(buckets: DataFrame, bucket_seconds: float, target: str = "target", by: str = "tenant_id") -> DataFrame:
    """Burn rates and status as of every bucket of (by, ts, total, bad, target); the last row is the present.

    A window is the last ceil(window / bucket_seconds) buckets, an idle one burns nothing, and a tier fires
    where both of its windows are strictly over the threshold.
    """
    order = Window.partitionBy(by).orderBy("ts")
    out, fired = buckets, []
    for name, limit, long_s, short_s, rank in TIERS:
        over = []
        for label, seconds in (("long", long_s), ("short", short_s)):
            w = order.rowsBetween(-(max(1, math.ceil(seconds / bucket_seconds)) - 1), 0)
            total, bad = F.sum("total").over(w), F.sum("bad").over(w)
            burn = F.when(total > 0, bad / total).otherwise(0.0) / (1.0 - F.col(target))
            out = out.withColumn(f"{name}_{label}", burn)
            over.append(F.col(f"{name}_{label}") > limit)
        fired.append(F.when(over[0] & over[1], rank).otherwise(0))
    return out.withColumn("rank", F.greatest(*fired)).withColumn("status", F.element_at(F.array(*map(F.lit, ("ok", "warning", "page"))), F.col("rank") + 1)).drop("rank")


def tenant_burn(buckets: DataFrame, tiers: DataFrame, bucket_seconds: float) -> DataFrame:
    """M5: burn rates under each tenant's tier target (tenant_id, target); a tenant without a tier has none."""
    return burn_rate(buckets.join(F.broadcast(tiers) if tiers.isLocal() else tiers, "tenant_id"), bucket_seconds)


def load_summary(records: DataFrame, by: str = "trial") -> DataFrame:
    """Counts, ratios, rates and percentiles of load records (by, offset_s, outcome, http_status, good, latency_s)."""
    counts = records.where("latency_s is not null").groupBy(by, "latency_s").agg(F.count(F.lit(1)).alias("n"))
    q = order_statistics(counts, "latency_s", [0.5, 0.9, 0.95, 0.99], [by]).select(F.col(by).alias("_by"), "q")
    out = records.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "ok").alias("n_ok"), F.count_if("good").alias("n_good"), F.count_if(F.col("http_status") >= 500).alias("n_5xx"),
        F.max("latency_s").alias("latency_max"), F.avg("latency_s").alias("latency_mean"), F.max("offset_s").alias("span_s"),
    )
    out = out.join(q, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")
    out = out.withColumn("good_ratio", F.col("n_good") / F.col("n")).withColumn("rate_per_s", F.col("n") / F.greatest(F.col("span_s"), F.lit(1.0)))
    for i, name in enumerate(("p50", "p90", "p95", "p99")):
        out = out.withColumn(name, F.col("q")[i])
    return out.withColumn("throughput", 1.0 / F.col("latency_mean")).drop("q")


def load_buckets(records: DataFrame, bucket_s: int = 60, by: str = "trial") -> DataFrame:
    """Requests and good ones of each bucket, with zeros for idle buckets."""
    counts = records.groupBy(by, F.floor(F.col("offset_s") / bucket_s).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("n_good"))
    spans = records.groupBy(by).agg(F.floor(F.max("offset_s") / bucket_s).alias("last"))
    every = spans.select(by, F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("bucket"))
    return every.join(counts, [by, "bucket"], "left").fillna(0, ["n", "n_good"])


def trial_variation(summaries: DataFrame, value: str = "p95") -> DataFrame:
    """Mean, deviation and coefficient of variation of one value over trials."""
    out = summaries.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("deviation"))
    return out.withColumn("variation", F.col("deviation") / F.col("mean"))


def pressure_summary(samples: DataFrame, settle: float = 0.1, tail: int = 3) -> DataFrame:
    """Per vertex, largest pressure of each phase and since when it stays settled. samples: vertex, t, phase, pressure.

    settled_at is the first recovery time from which the pressure never again
    exceeds `settle`, given `tail` samples or more from there, one with a
    pressure among them; samples of one time count together. It follows from
    the vertex's last excess, last pressure and `tail` last times, so no task
    holds or orders all of a vertex's samples.
    """
    t, phase, pressure = F.col("t"), F.col("phase"), F.col("pressure")
    peak = lambda p: F.max(F.when(phase == p, pressure)).alias(f"{p}_max")
    told = samples.groupBy("vertex").agg(
        peak("baseline"), peak("burst"), peak("recovery"), F.max(F.when(pressure > settle, t)).alias("_loud"), F.max(F.when(pressure.isNotNull(), t)).alias("_heard")
    )
    last = samples.where(t.isNotNull()).select("vertex", "t").withColumn("_i", F.row_number().over(Window.partitionBy("vertex").orderBy(F.desc("t")))).where(F.col("_i") <= tail)
    bound = last.groupBy("vertex").agg(F.when(F.count(F.lit(1)) >= tail, F.min("t")).alias("_from")).withColumnRenamed("vertex", "_v")
    told = told.join(bound, F.col("vertex").eqNullSafe(F.col("_v")), "left").drop("_v")
    limits = told.where("_from is not null and _heard is not null").select(F.col("vertex").alias("_v"), "_loud", F.least("_from", "_heard").alias("_until"))
    calm = samples.where(phase == "recovery").join(limits, F.col("vertex").eqNullSafe(F.col("_v"))).where(((t > F.col("_loud")) | F.col("_loud").isNull()) & (t <= F.col("_until")))
    settled = calm.groupBy("_v").agg(F.min("t").alias("settled_at"))
    return told.join(settled, F.col("vertex").eqNullSafe(F.col("_v")), "left").drop("_v", "_loud", "_heard", "_from")


def pressure_conditions(samples: DataFrame, settle: float = 0.1, tail: int = 3) -> DataFrame:
    """Per vertex, whether it was calm before the burst, pressed in it and calm after it. samples: vertex, t, phase, pressure.

    Calm is a largest pressure of at most `settle` among the last `tail` samples
    of the phase, of equal times the larger pressures first. error names a
    phase that has too few samples (one for the burst), and then no condition
    holds.
    """
    last = Window.partitionBy("vertex", "phase").orderBy(F.desc("t"), F.desc("pressure"))
    tails = samples.withColumn("_i", F.row_number().over(last)).where(F.col("_i") <= tail)
    of = lambda p, c: F.max(F.when(F.col("phase") == p, F.col(c)))
    held = tails.groupBy("vertex").agg(of("baseline", "pressure").alias("baseline_tail_max"), of("baseline", "_i").alias("_b"), of("recovery", "pressure").alias("recovery_tail_max"), of("recovery", "_i").alias("_r"))
    peak = samples.groupBy("vertex").agg(of("burst", "pressure").alias("burst_max"))
    out = held.join(peak, "vertex")
    few = lambda c: F.coalesce(F.col(c), F.lit(0)) < tail
    error = F.when(few("_b"), "too few samples: baseline").when(F.col("burst_max").isNull(), "too few samples: burst").when(few("_r"), "too few samples: recovery")
    out = out.withColumn("error", error)
    ok = F.col("error").isNull()
    out = out.withColumns({"calm_before": ok & (F.col("baseline_tail_max") <= settle), "pressed": ok & (F.col("burst_max") > settle), "calm_after": ok & (F.col("recovery_tail_max") <= settle)})
    return out.withColumn("all_true", F.col("calm_before") & F.col("pressed") & F.col("calm_after")).drop("_b", "_r")


def shard_counts(df: DataFrame, key: str, n_shards: int) -> DataFrame:
    """Records of each shard by the md5 of the key, with zeros. 56 bits of the digest are scaled to the shards."""
    high = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long")
    shard = F.shiftright(high * n_shards, 32)
    counts = df.groupBy(shard.alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    return df.sparkSession.range(n_shards).withColumnRenamed("id", "shard").join(counts, "shard", "left").fillna(0, ["n"])


def shard_skew(df: DataFrame, key: str, n_shards: int) -> DataFrame:
    """Hottest share times the number of shards; 1 where there are no records."""
    out = shard_counts(df, key, n_shards).agg(F.sum("n").alias("n"), F.max("n").alias("hottest"))
    return out.withColumn("skew", F.when(F.col("n") > 0, F.col("hottest") / F.col("n") * n_shards).otherwise(1.0))


def reason_counts(scored: DataFrame) -> DataFrame:
    """Scores that name each reason."""
    return scored.select(F.explode("reasons.code").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def latency_histogram(df: DataFrame, value: str = "latency_s", bounds: tuple = LATENCY_BOUNDS) -> DataFrame:
    """Cumulative counts up to each bound, and all."""
    counts = df.agg(*[F.count_if(F.col(value) <= b).alias(f"le_{i}") for i, b in enumerate(bounds)], F.count(value).alias("le_all"))
    rows = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"le_{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit(float("inf")).alias("le"), F.col("le_all").alias("n")))
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def cost_ledger(calls: DataFrame, rate_per_vcpu_s: float) -> DataFrame:
    """Cost of the calls (mmsi, t, vcpu, seconds) by vessel and day."""
    cost = F.col("vcpu") * F.col("seconds") * rate_per_vcpu_s
    return calls.groupBy("mmsi", F.to_date("t").alias("day")).agg(F.count(F.lit(1)).alias("n_calls"), F.sum(cost).alias("cost"))


def slot_lag_alerts(slots: DataFrame, threshold: int = SLOT_LAG_BYTES) -> DataFrame:
    """Slots (name, current_lsn, confirmed_lsn, restart_lsn) whose lag reaches the threshold; no position means no lag."""
    if threshold <= 0:
        raise ValueError("the threshold must be positive")
    lag = F.coalesce(F.col("current_lsn") - F.coalesce("confirmed_lsn", "restart_lsn"), F.lit(0))
    return slots.withColumn("lag_bytes", lag).withColumn("alert", F.col("lag_bytes") >= threshold)
