"""Drift, ranking and calibration statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seatrack.functions.geo import erf, kolmogorov_sf

from .graph import durable
from .joins import order_statistics, prefix_sum

PSI_WARN, PSI_ALERT, KS_ALPHA, BINS = 0.1, 0.25, 0.05, 10
MIN_AUC, MAX_CRPS, RATIO_BAND = 0.85, 1.0, (0.8, 1.2)


def long_form(df: DataFrame, features: list[str], by: list[str] | None = None) -> DataFrame:
    """(by..., feature, value) of the numeric features; nulls and NaN are left out."""
    by = by or []
    cast = df.select(*by, *[F.col(f).cast("double").alias(f) for f in features])
    out = cast.unpivot(by, features, "feature", "value") if by else cast.withColumn("_one", F.lit(1)).unpivot("_one", features, "feature", "value").drop("_one")
    return out.where("value is not null and not isnan(value)")


def value_counts(reference: DataFrame, current: DataFrame, features: list[str], by: list[str] | None = None) -> DataFrame:
    """(by..., feature, value, r, c, cum_r, cum_c): how often each value occurs on either side and their prefix sums, computed once and written; psi and ks_statistic share it."""
    keys = [*(by or []), "feature"]
    both = long_form(reference, features, by).withColumn("side", F.lit(0)).unionByName(long_form(current, features, by).withColumn("side", F.lit(1)))
    counts = both.groupBy(*keys, "value").agg(F.count_if(F.col("side") == 0).alias("r"), F.count_if(F.col("side") == 1).alias("c"))
    return durable(prefix_sum(durable(counts), "value", ["r", "c"], keys))


def psi(reference: DataFrame, current: DataFrame, features: list[str], n_bins: int = BINS, by: list[str] | None = None, eps: float = 1e-6, counts: DataFrame | None = None) -> DataFrame:
    """A1: (by..., feature, psi). Edges are the unique reference quantiles with open ends; bins are closed on the left."""
    keys = [*(by or []), "feature"]
    counts = value_counts(reference, current, features, by) if counts is None else counts
    quantiles = order_statistics(counts, "value", [i / n_bins for i in range(n_bins + 1)], keys, "r", "cum_r")
    edges = quantiles.select(*keys, F.array_distinct("q").alias("edges"))
    # n edges make n - 1 bins; what lies left of the second edge is in the first bin
    bin_of = F.size(F.filter(F.slice("edges", F.lit(2), F.greatest(F.size("edges") - 2, F.lit(0))), lambda e: e <= F.col("value")))
    counted = counts.join(edges, keys).groupBy(*keys, bin_of.alias("bin")).agg(F.sum("r").alias("r"), F.sum("c").alias("c"), F.max(F.size("edges")).alias("n_edges"))
    sums = counted.groupBy(*keys).agg(F.sum("r").alias("nr"), F.sum("c").alias("nc"), F.collect_list(F.struct("bin", "r", "c")).alias("bins"), F.max("n_edges").alias("n_edges"))
    frac = lambda x, n: F.greatest(x / n, F.lit(eps))
    term = lambda b: (frac(b["c"], F.col("nc")) - frac(b["r"], F.col("nr"))) * F.ln(frac(b["c"], F.col("nc")) / frac(b["r"], F.col("nr")))
    value = F.aggregate("bins", F.lit(0.0), lambda acc, b: acc + term(b))
    empty = (F.col("nr") == 0) | (F.col("nc") == 0) | (F.col("n_edges") < 2)
    return sums.select(*keys, F.when(empty, 0.0).otherwise(value).alias("psi"))


def ks_statistic(reference: DataFrame, current: DataFrame, features: list[str], by: list[str] | None = None, counts: DataFrame | None = None) -> DataFrame:
    """A2: (by..., feature, ks, n, m) by counts for each distinct value and a distributed prefix sum."""
    keys = [*(by or []), "feature"]
    counts = value_counts(reference, current, features, by) if counts is None else counts
    totals = counts.groupBy(*keys).agg(F.sum("r").alias("n"), F.sum("c").alias("m"))
    cum = counts.join(totals, keys)
    gap = F.when((F.col("n") > 0) & (F.col("m") > 0), F.abs(F.col("cum_r") / F.col("n") - F.col("cum_c") / F.col("m"))).otherwise(0.0)
    return cum.groupBy(*keys).agg(F.max(gap).alias("ks"), F.max("n").alias("n"), F.max("m").alias("m"))


def ks_pvalue(d: Column, n: Column, m: Column) -> Column:
    """A3: asymptotic p-value with the small-sample correction."""
    en = F.sqrt(n * m / (n + m))
    return F.when((n == 0) | (m == 0), 1.0).otherwise(kolmogorov_sf((en + 0.12 + 0.11 / en) * d))


def input_drift(reference: DataFrame, current: DataFrame, by: list[str] | None = None, n_bins: int = BINS) -> DataFrame:
    """A4, A5: psi, ks, ks_pvalue and drifted for every shared numeric column."""
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    own = dict(current.dtypes)
    features = [c for c, t in reference.dtypes if (t in numeric or t.startswith("decimal")) and c in own and c not in (by or [])]
    keys = [*(by or []), "feature"]
    counts = value_counts(reference, current, features, by)
    out = psi(reference, current, features, n_bins, by, counts=counts).join(ks_statistic(reference, current, features, by, counts), keys)
    out = out.withColumn("ks_pvalue", ks_pvalue(F.col("ks"), F.col("n"), F.col("m")))
    drifted = (F.col("psi") >= PSI_ALERT) | ((F.col("psi") >= PSI_WARN) & (F.col("ks_pvalue") < KS_ALPHA))
    return out.withColumn("drifted", drifted)


def tenant_drift(reference: DataFrame, current: DataFrame, tenant: str = "tenant_id") -> DataFrame:
    """A5: drift of each tenant and, as tenant `pooled`, of all rows together."""
    per = input_drift(reference, current, [tenant])
    pooled = input_drift(reference.drop(tenant), current.drop(tenant)).withColumn(tenant, F.lit("pooled"))
    return per.unionByName(pooled)


def roc_auc(df: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """(by..., auc, n_pos, n_neg); ties count half, one class gives null."""
    by = by or []
    counts = df.groupBy(*by, F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    cum = prefix_sum(counts, "s", ["neg"], by)
    wins = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2.0))
    out = cum.groupBy(*by).agg(wins.alias("wins"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return out.select(*by, F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("wins") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"), "n_pos", "n_neg")


def crps_gaussian(df: DataFrame, mu: str = "mu", sigma: str = "sigma", y: str = "y", by: list[str] | None = None) -> DataFrame:
    """Mean closed-form score of y under the normal law of mu and sigma."""
    df = df.withColumn("_z", (F.col(y) - F.col(mu)) / F.col(sigma)).withColumn("_u", F.col("_z") / math.sqrt(2.0))
    z = F.col("_z")
    cdf = 0.5 * (1.0 + erf(F.col("_u")))
    pdf = F.exp(-z * z / 2.0) / math.sqrt(2 * math.pi)
    score = F.col(sigma) * (z * (2.0 * cdf - 1.0) + 2.0 * pdf - 1.0 / math.sqrt(math.pi))
    return df.withColumn("_crps", score).groupBy(*(by or [])).agg(F.avg("_crps").alias("crps"))


def calibration_ratio(df: DataFrame, err: str = "err", var: str = "var", by: list[str] | None = None) -> DataFrame:
    """Mean squared error over mean variance, infinite where that is 0 or not finite."""
    out = df.groupBy(*(by or [])).agg(F.avg(F.col(err) * F.col(err)).alias("mse"), F.avg(var).alias("mean_var"), F.count(F.lit(1)).alias("n"))
    finite = (F.col("mean_var") > 0) & (F.col("mean_var") < float("inf"))
    return out.withColumn("ratio", F.when(finite, F.col("mse") / F.col("mean_var")).otherwise(F.lit(float("inf"))))


def holdout_gate(df: DataFrame, by: str = "candidate_id") -> DataFrame:
    """Auc, crps, ratio, failures and passed for each candidate. df: label, score, mu, sigma, y."""
    auc = roc_auc(df, "label", "score", [by]).select(by, "auc")
    crps = crps_gaussian(df, by=[by])
    ratio = calibration_ratio(df.withColumn("err", F.col("y") - F.col("mu")).withColumn("var", F.col("sigma") * F.col("sigma")), by=[by]).select(by, "ratio")
    out = auc.join(crps, by).join(ratio, by)
    failures = F.array_compact(F.array(
        F.when(F.coalesce(F.col("auc") < MIN_AUC, F.lit(True)), "auc"),
        F.when(F.coalesce(F.col("crps") > MAX_CRPS, F.lit(True)), "crps"),
        F.when(~F.col("ratio").between(*RATIO_BAND), "calibration"),
    ))
    return out.withColumn("failures", failures).withColumn("passed", F.size("failures") == 0)


def calibration_watch(outcomes: DataFrame, by: list[str], min_rows: int = 20) -> DataFrame:
    """A10: status insufficient, ok or alert of labelled outcomes (err, var) for each group."""
    out = calibration_ratio(outcomes, by=by)
    return out.withColumn("status", F.when(F.col("n") < min_rows, "insufficient").when(F.col("ratio").between(*RATIO_BAND), "ok").otherwise("alert"))


def disagreement_rate(queue: DataFrame, threshold: float = 0.6, by: list[str] | None = None) -> DataFrame:
    """Share of incorrect labels among scores at or above the threshold, and the rows left out."""
    counted = (F.col("score") >= threshold) & F.col("label").isin("correct", "incorrect")
    out = queue.groupBy(*(by or [])).agg(
        F.count_if(counted & (F.col("label") == "incorrect")).alias("n_incorrect"), F.count_if(counted).alias("n_counted"),
        F.count_if(~F.coalesce(counted, F.lit(False))).alias("n_excluded"),
    )
    return out.withColumn("rate", F.when(F.col("n_counted") > 0, F.col("n_incorrect") / F.col("n_counted")).otherwise(0.0))


def disagreement_threshold(windows: DataFrame, by: str = "tenant_id", min_n: int = 20, min_windows: int = 5, fallback: float = 0.2) -> DataFrame:
    """max(nearest-rank 95th percentile, twice the mean, 0.05) of the rates (by, n_counted, rate) of large enough windows."""
    big = windows.where(F.col("n_counted") >= min_n).groupBy(by, "rate").agg(F.count(F.lit(1)).alias("n"))
    cum = prefix_sum(big, "rate", ["n"], [by])
    told = cum.groupBy(by).agg(F.sum("n").alias("n_windows"), (F.sum(F.col("rate") * F.col("n")) / F.sum("n")).alias("mean"))
    rank = F.floor((F.col("n_windows") * 19 + 19) / 20)
    q95 = cum.join(told, by).groupBy(by, "n_windows", "mean").agg(F.max(F.when((F.col("cum_n") - F.col("n") < rank) & (rank <= F.col("cum_n")), F.col("rate"))).alias("q95"))
    own = F.greatest("q95", 2 * F.col("mean"), F.lit(0.05))
    out = windows.select(by).distinct().join(q95, by, "left")
    n = F.coalesce("n_windows", F.lit(0)).cast("int")
    return out.select(by, n.alias("n_windows"), F.when(n >= min_windows, own).otherwise(fallback).alias("threshold"))


def classify_drift(inputs: DataFrame) -> DataFrame:
    """Decision of each row (concept, calibration, input booleans): concept before calibration before input."""
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    return inputs.withColumn("decision", F.when(on("concept"), "concept").when(on("calibration"), "calibration").when(on("input"), "input").otherwise("none"))


def reward_probe(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Blocked where the candidate's mean reward rises while violations rise or the structural term falls. df: arm, reward, structural, violation."""
    side = lambda arm, v: F.avg(F.when(F.col("arm") == arm, v))
    names = {"reward": F.col("reward"), "structural": F.col("structural"), "violation": F.col("violation").cast("double")}
    out = df.groupBy(*(by or [])).agg(*[side(arm, v).alias(f"{arm}_{k}") for arm in ("baseline", "candidate") for k, v in names.items()])
    up = F.col("candidate_reward") > F.col("baseline_reward")
    worse = (F.col("candidate_violation") > F.col("baseline_violation")) | (F.col("candidate_structural") < F.col("baseline_structural"))
    return out.withColumn("blocked", F.coalesce(up & worse, F.lit(False)))
