"""Joins (J1-J8) and the numbered prefix sum that ordered statistics share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seatrack.functions.geo import haversine_m, seconds_between

from .graph import durable


#: Groups up to which a few rows for each of them are broadcast.
MAX_BROADCAST_GROUPS = 10_000


def prefix_sum(df: DataFrame, order: str, values: list[str], by: list[str] | None = None) -> DataFrame:
    """Adds cum_<value>: sums over all rows with `order` up to the row's, within `by`, without one task for a group.

    Quantiles of `order` cut each group once, and are written before they are
    used, so that a row's stretch stays the same however often and on however
    many partitions it is computed. Each stretch sums its own rows and the
    totals of the stretches before it. Rows with equal (by, order) must have
    been aggregated before; null comes first, NaN last.
    """
    by = by or []
    keys = by or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(0))
    n_cuts = min(512, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = durable(rows.groupBy(*keys).agg(F.percentile_approx(order, [i / n_cuts for i in range(1, n_cuts)] or [0.5], 10 * n_cuts).alias("_cuts")))
    small = cuts.count() <= MAX_BROADCAST_GROUPS
    shared = F.broadcast if small else lambda x: x
    same = lambda other: [F.col(k).eqNullSafe(other[f"_k{i}"]) for i, k in enumerate(keys)]  # noqa: E731  also groups named by null
    named = lambda x: x.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    cuts = named(cuts)
    part = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(order))), F.lit(0))
    cut = rows.join(shared(cuts), same(cuts)).withColumn("_part", F.when(F.col(order).isNull(), F.lit(-1)).otherwise(part)).select(*rows.columns, "_part")
    inside = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*keys, "_part").agg(*[F.sum(v).alias(f"t_{v}") for v in values])
    totals = totals.select(F.col("_part").alias("_p"), *keys, *[F.coalesce(F.sum(f"t_{v}").over(before), F.lit(0)).alias(f"b_{v}") for v in values])
    totals = named(totals)
    local = cut.select("*", *[F.sum(v).over(inside).alias(f"l_{v}") for v in values])
    joined = local.join(shared(totals), [*same(totals), F.col("_part") == F.col("_p")])
    return joined.select(*df.columns, *[(F.col(f"l_{v}") + F.col(f"b_{v}")).alias(f"cum_{v}") for v in values])


def order_statistics(counts: DataFrame, value: str, shares: list[float], by: list[str], n: str = "n", cum: str | None = None) -> DataFrame:
    """(by..., n_all, q): quantiles of each group at the shares, with linear interpolation between the two nearest rows, as F.percentile gives them.

    counts: a row for each distinct value with its number `n`; `cum` names its
    prefix sum, if it is there already. Each value tells for which ranks it
    stands, so no task holds a group's values.
    """
    if cum is None:
        counts, cum = prefix_sum(counts, value, [n], by), f"cum_{n}"
    keys = by or ["_all"]
    rows = (counts if by else counts.withColumn("_all", F.lit(0))).where(F.col(n) > 0)
    totals = rows.groupBy(*keys).agg(F.sum(n).alias("n_all"))
    named = totals.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    ranked = rows.join(named, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    at = lambda p: p * (F.col("n_all") - 1)
    holds = lambda rank: F.max(F.when((F.col(cum) - F.col(n) <= rank) & (rank < F.col(cum)), F.col(value)))
    ends = [e for i, p in enumerate(shares) for e in (holds(F.floor(at(p))).alias(f"_l{i}"), holds(F.ceil(at(p))).alias(f"_h{i}"))]
    out = ranked.groupBy(*keys, "n_all").agg(*ends)
    part = lambda i, p: F.when(F.col(f"_l{i}") == F.col(f"_h{i}"), F.col(f"_l{i}")).otherwise((F.ceil(at(p)) - at(p)) * F.col(f"_l{i}") + (at(p) - F.floor(at(p))) * F.col(f"_h{i}"))
    return out.select(*by, "n_all", F.array(*[part(i, p) for i, p in enumerate(shares)]).alias("q"))


def asof_join(left: DataFrame, right: DataFrame, by: str, left_ts: str, right_ts: str, max_age_s: float | None = None, order: str | None = None) -> DataFrame:
    """The latest right row at or before each left row, per `by`; nulls without one or beyond max_age_s.

    Both sides meet in one sorted union: one shuffle, no pairs. Every left row
    stays, also repeated ones. Of right rows at one time the largest `order` wins.
    """
    rest = [c for c in right.columns if c != by]
    pick = F.struct(*[F.col(c) for c in rest])
    l_side = left.select(F.col(by).alias("_by"), F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("string").alias("_o"), F.struct("*").alias("_l"), F.lit(None).cast(right.select(pick.alias("p")).schema["p"].dataType).alias("_r"))
    r_side = right.select(F.col(by).alias("_by"), F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), (F.lpad(F.col(order).cast("string"), 20, "0") if order else F.lit(None).cast("string")).alias("_o"), F.lit(None).cast(l_side.schema["_l"].dataType).alias("_l"), pick.alias("_r"))
    w = Window.partitionBy("_by").orderBy("_t", "_side", "_o").rowsBetween(Window.unboundedPreceding, 0)
    both = l_side.unionByName(r_side).withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    if max_age_s is not None:
        both = both.withColumn("_m", F.when(seconds_between(F.col(f"_m.{right_ts}"), F.col("_t")) <= max_age_s, F.col("_m")))
    return both.select("_l.*", *[F.col(f"_m.{c}").alias(f"f_{c}") for c in rest])


def registry_status(items: DataFrame) -> DataFrame:
    """One row for each mmsi from online items (mmsi, feature_name, deleted, reason, severity, regime, name)."""
    live = items.where(~F.coalesce(F.col("deleted"), F.lit(False)))
    return live.groupBy("mmsi").agg(
        F.max(F.col("feature_name") == "watchlist").alias("watchlisted"),
        F.max(F.when(F.col("feature_name") == "watchlist", F.col("severity"))).alias("list_severity"),
        F.max(F.col("feature_name").startswith("sanctions:")).alias("sanctioned"),
        F.array_sort(F.collect_set(F.when(F.col("feature_name").startswith("sanctions:"), F.substring_index("feature_name", ":", -1)))).alias("regimes"),
    )


def with_registry(df: DataFrame, items: DataFrame) -> DataFrame:
    """Registry columns of each vessel; a vessel without items is neither listed nor sanctioned."""
    out = df.join(registry_status(items), "mmsi", "left")
    return out.withColumn("watchlisted", F.coalesce("watchlisted", F.lit(False))).withColumn("sanctioned", F.coalesce("sanctioned", F.lit(False)))


def apply_feedback(queue: DataFrame, feedback: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queue with each trace's last label and reviewer, feedback on unknown traces)."""
    last = feedback.groupBy("trace_id").agg(F.max_by(F.struct("label", "reviewer"), "seq").alias("f"))
    merged = queue.join(last, "trace_id", "left")
    out = [F.coalesce(F.col(f"f.{c}"), F.col(c)).alias(c) if c in ("label", "reviewer") else F.col(c) for c in queue.columns]
    return merged.select(*out), feedback.join(queue.select("trace_id"), "trace_id", "left_anti")


def pending(queue: DataFrame) -> DataFrame:
    """Cases without a label, oldest first."""
    return queue.where("label is null").orderBy("created_at", "trace_id")


def enqueue(queue: DataFrame, scored: DataFrame, order: str = "created_at") -> DataFrame:
    """The scored rows that the queue has not, one for each trace: the first."""
    first = scored.withColumn("_n", F.row_number().over(Window.partitionBy("trace_id").orderBy(order))).where("_n = 1").drop("_n")
    return first.join(queue.select("trace_id"), "trace_id", "left_anti")


def score_diff(champion: DataFrame, shadow: DataFrame, on: str, limit: float = 0.05) -> DataFrame:
    """n_pairs, n_unpaired, mean_abs_diff, max_abs_diff, passed; unpaired or no rows never pass."""
    both = champion.select(on, F.col("score").alias("a")).join(shadow.select(on, F.col("score").alias("b")), on, "full_outer")
    d = F.abs(F.col("a") - F.col("b"))
    out = both.agg(F.count(d).alias("n_pairs"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("n_unpaired"), F.avg(d).alias("mean_abs_diff"), F.max(d).alias("max_abs_diff"))
    return out.withColumn("passed", (F.col("n_pairs") > 0) & (F.col("n_unpaired") == 0) & (F.col("mean_abs_diff") <= limit))


def edge_lengths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends' places and their great-circle length."""
    end = lambda p: nodes.select(F.col("node_id").alias(f"{p}_node"), F.col("lat").alias(f"{p}_lat"), F.col("lon").alias(f"{p}_lon"))
    out = edges.join(end("from"), "from_node").join(end("to"), "to_node")
    return out.withColumn("length_m", haversine_m(F.col("from_lat"), F.col("from_lon"), F.col("to_lat"), F.col("to_lon")))


def graph_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, key) of everything that a lane graph must not hold."""
    pair = F.concat_ws(">", "from_node", "to_node")
    told = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), key.alias("key"))
    known = nodes.select("node_id").distinct()
    parts = [
        told(nodes.groupBy("node_id").count().where("count > 1"), "duplicate_node", F.col("node_id")),
        told(edges.groupBy("from_node", "to_node").count().where("count > 1"), "duplicate_edge", pair),
        told(edges.join(known, edges.from_node == known.node_id, "left_anti"), "unknown_from", pair),
        told(edges.join(known, edges.to_node == known.node_id, "left_anti"), "unknown_to", pair),
        told(edges.where("from_node = to_node"), "self_loop", pair),
        told(nodes.where(~F.col("lat").between(-90, 90) | ~F.col("lon").between(-180, 180)), "range", F.col("node_id")),
        told(nodes.where("vessel_count < 0"), "negative_count", F.col("node_id")),
        told(edges.where("frequency < 1"), "frequency", pair),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def evaluate_slo(measured: DataFrame, targets: DataFrame) -> DataFrame:
    """Every target with its measurement and `met`; a missing measurement is a breach."""
    out = targets.join(measured, ["tenant_id", "metric"], "left")
    ok: Column = F.when(F.col("comparator") == ">=", F.col("value") >= F.col("target")).otherwise(F.col("value") <= F.col("target"))
    return out.withColumn("met", F.coalesce(ok, F.lit(False)))
