"""Operator 4: mixes sources to target weights by apportioning equal-token blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import count_blank_separated, saved

WEIGHTS = (5.0, 2.0, 1.0)
#: No source is repeated more often than this.
MAX_REPEATS = 3
#: Blocks for each shard of a source, on average, and documents for each shard number.
BLOCKS_PER_SHARD = 20
DOCS_PER_SHARD = 10_000
MIN_SHARDS = 64


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """sources(source, source_size) with weight and target.

    The level is the tokens for each unit of weight at which the targets
    min(level x weight, max_repeats x size) sum to all tokens: what a source
    cannot take goes to the others by weight until none is above its limit.
    The windows run over one row for each source, never over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    ranked = sources.withColumn("rank", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(float(max_repeats))).withColumn("ratio", F.col("most") / F.col("weight"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    summed = (
        ranked.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.col("weight_left"))
    )
    # the level that holds is that of the first source, by ratio, which stays below its limit
    free = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"]
    return summed.withColumn("free", free).select(
        "source", "source_size", "weight", F.coalesce(F.least(F.col("free") * F.col("weight"), F.col("most")), F.col("most")).alias("target")
    )


def _apportioned(shares: DataFrame, seats: str, share: str, key: list[str], within: list[str], order: list) -> DataFrame:
    """Sainte-Laguë: adds `quota`, the number of quotients share / (2k + 1) among the highest `seats` of the group.

    Rounding share / sum(share) x seats gives the quotas but for a few seats;
    those go by the next highest (or back by the lowest) quotients.
    """
    group = Window.partitionBy(*within)
    even = F.col(share) / F.sum(share).over(group) * F.col(seats)
    near = shares.withColumn("near", F.when(F.col(share) > 0, F.round(even)).otherwise(F.lit(0.0)).cast("long"))
    near = near.withColumn("short", F.col(seats) - F.sum("near").over(group))
    steps = F.when(F.col("short") > 0, F.sequence(F.col("near"), F.col("near") + F.col("short") - 1)).when(
        (F.col("short") < 0) & (F.col("near") > 0),
        F.sequence(F.greatest(F.col("near") + F.col("short"), F.lit(0).cast("long")), F.col("near") - 1),
    )
    quotients = near.where((F.col("short") != 0) & (F.col(share) > 0)).select(*key, "short", share, F.explode(steps).alias("k"))
    quotients = quotients.withColumn("q", F.col(share) / (2 * F.col("k") + 1))
    best = Window.partitionBy(*within).orderBy(F.when(F.col("short") > 0, -F.col("q")).otherwise(F.col("q")), *order, "k")
    moved = (
        quotients.withColumn("place", F.row_number().over(best)).where(F.col("place") <= F.abs("short"))
        .groupBy(*key).agg(F.sum(F.signum("short")).cast("long").alias("moved"))
    )
    moved = moved.select(*[F.col(k).alias(f"m_{k}") for k in key], "moved")
    same = None
    for k in key:
        own = F.col(k).eqNullSafe(F.col(f"m_{k}"))
        same = own if same is None else same & own
    return near.join(moved, same, "left").withColumn("quota", F.col("near") + F.coalesce("moved", F.lit(0))).drop("near", "short", "moved", *[f"m_{k}" for k in key])


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    seed: int = 11,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: bool = False,
) -> DataFrame:
    """Per row: `id_col`, size, source_size, target, taken and, with `carry`, the whole row as `carried`.

    A source takes all its documents as often as its target fits whole, and for
    the rest equal-token blocks: Sainte-Laguë gives every source its blocks,
    then every shard of the source, and a seeded order picks the shard's
    blocks. `taken` is whole repeats plus the words inside picked blocks, so it
    never exceeds MAX_REPEATS times the size.

    Null texts have size 0; a null source is a source of its own, last in
    order. Rows that repeat others are documents of their own. Reruns agree:
    order and picks depend on hashes of the rows, and equal rows are
    interchangeable. Empty tables and corpora without words take nothing.
    """
    whole_row = ["carried"] if carry else []
    d = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), count_blank_separated(F.col(text_col)).alias("size"),
        F.xxhash64(F.lit(seed), id_col, text_col).alias("draw"), *([F.struct("*").alias("carried")] if carry else []),
    )
    sizes = saved(d.select("source", "size", "draw"))
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    targets = saved(source_targets(sources.select("source", "source_size"), weights))
    shards = max(MIN_SHARDS, -(-sizes.count() // DOCS_PER_SHARD))
    shard = F.pmod("draw", F.lit(shards)).alias("shard")

    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # a target on the limit is whole repeats; the tolerance keeps rounding from opening a tiny rest
    whole = F.floor(ratio + 1e-9)
    plan = targets.withColumn("whole", whole).withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    per_shard = sizes.select("source", "size", shard).groupBy("source", "shard").agg(F.sum("size").alias("shard_size"))
    n_blocks = max(1, BLOCKS_PER_SHARD * shards * targets.count())
    total = targets.agg(F.sum("source_size")).first()[0] or 0
    block = max(1.0, total / n_blocks)
    seats = int(round((plan.agg(F.sum("rest")).first()[0] or 0.0) / block))
    plan = saved(_apportioned(plan.withColumn("seats", F.lit(seats).cast("long")), "seats", "rest", ["source"], [], ["source"]).select("source", "source_size", "target", "whole", F.col("quota").alias("source_quota")))
    lookup = plan.withColumnRenamed("source", "plan_source")
    shared = per_shard.join(lookup, F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")
    quotas = _apportioned(shared, "source_quota", "shard_size", ["source", "shard"], ["source"], ["shard"])
    # a shard's words are cut into blocks of equal size near the common one
    quotas = quotas.withColumn("n_parts", F.greatest(F.round(F.col("shard_size") / block), F.lit(1)).cast("long"))
    order = F.array_sort(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_parts") - 1), lambda b: F.struct(F.xxhash64(F.lit(seed), "source", "shard", b).alias("h"), b.alias("b"))))
    quotas = quotas.withColumn("part", F.col("shard_size") / F.col("n_parts")).withColumn(
        "picked", F.when(F.col("source_quota") > 0, F.slice(order["b"], F.lit(1), F.least("quota", "n_parts").cast("int"))).otherwise(F.array().cast("array<bigint>"))
    )
    picks = quotas.select(F.col("source").alias("q_source"), F.col("shard").alias("q_shard"), "source_size", "target", "whole", "part", "picked")

    stream = Window.partitionBy("source", "shard").orderBy("draw", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = d.withColumn("shard", F.pmod("draw", F.lit(shards))).withColumn("start", F.coalesce(F.sum("size").over(stream), F.lit(0)))
    joined = placed.join(picks, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("shard") == F.col("q_shard")), "left")
    inside = F.aggregate(
        F.filter("picked", lambda b: ((b + 1) * F.col("part") > F.col("start")) & (b * F.col("part") < F.col("start") + F.col("size"))),
        F.lit(0.0),
        lambda acc, b: acc + F.least((b + 1) * F.col("part"), F.col("start") + F.col("size")) - F.greatest(b * F.col("part"), F.col("start").cast("double")),
    )
    taken = F.least(F.col("whole") * F.col("size") + F.coalesce(F.round(inside), F.lit(0)), F.col("size") * MAX_REPEATS).cast("long")
    return joined.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("taken"), *whole_row)


def mixture(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, seed: int = 11) -> DataFrame:
    """The documents that the mix takes, all columns, with mix_size, mix_taken and the source's mix_target.

    Columns of these three names are replaced. Null and empty texts have no
    words to take and go; repeated rows are taken each on its own. An empty
    table gives none.
    """
    added = ("size", "taken", "target")
    out = mix(docs, weights, seed, carry=True).where("taken > 0")
    stay = [F.col(f"carried.`{c}`") for c in docs.columns if c not in {f"mix_{x}" for x in added}]
    return out.select(*stay, *[F.col(c).alias(f"mix_{c}") for c in added])
