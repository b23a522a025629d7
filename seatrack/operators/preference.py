"""Preference data and promotion (M1-M4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# What downstream readers of triples and promotion records expect.
WEIGHTS = (5, 25, 50, 100)
PARTS = ("total", "structural", "shaping", "data", "pref")
OPERATOR_CHOICE, RAISED_ALARM = "not_anomalous", "anomalous"


def _zero():
    return F.struct(*[F.lit(0.0).alias(p) for p in PARTS])


def _latest(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row a key: that of the largest `seq`, if there is such a column; equal ones are told apart by a hash of the row."""
    order = F.struct(*[F.col(c) for c in ("seq",) if c in df.columns], F.xxhash64(*columns))
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_r"))
    return best.select(key, *[F.col(f"_r.{c}").alias(c) for c in columns])


def triples_from_labels(queue: DataFrame, contexts: DataFrame, rewards: DataFrame | None = None, threshold: float = 0.6, structural_min: float = 0.0) -> DataFrame:
    """M1: a triple for each case (queue row) at or above the threshold that its label calls incorrect: the label is chosen, the raised alarm rejected.

    A case carries its own chosen_reward and rejected_reward, if the queue has
    these columns; `rewards` by trace fills those that are missing, zeros the
    rest. A trace with several contexts or rewards gives its latest, so a case
    stays one triple. Either arm below structural_min is a violation.
    """
    wrong = queue.where((F.col("label") == "incorrect") & (F.col("score") >= threshold))
    arms = ("chosen_reward", "rejected_reward")
    own = [F.col(c) if c in queue.columns else F.lit(None).cast(f"struct<{','.join(f'{p}:double' for p in PARTS)}>").alias(c) for c in arms]
    who = F.col("reviewer") if "reviewer" in queue.columns else F.lit(None).cast("string").alias("reviewer")
    out = wrong.select("trace_id", "mmsi", who, *own).join(_latest(contexts, "trace_id", ["context"]), "trace_id", "left")
    if rewards is not None:
        told = _latest(rewards, "trace_id", list(arms)).withColumnsRenamed({c: f"_{c}" for c in arms})
        out = out.join(told, "trace_id", "left").withColumns({c: F.coalesce(c, f"_{c}") for c in arms})
    out = out.withColumns({c: F.coalesce(c, _zero()) for c in arms})
    bad = (F.col("chosen_reward.structural") < structural_min) | (F.col("rejected_reward.structural") < structural_min)
    return out.select("trace_id", "mmsi", "reviewer", "context", F.lit(OPERATOR_CHOICE).alias("chosen"), F.lit(RAISED_ALARM).alias("rejected"), *arms, bad.alias("structural_violation"))


def triples_from_rewards(candidates: DataFrame, margin: float = 0.5) -> DataFrame:
    """M2: the candidate of largest total, the first on ties, against each other one that is behind by the margin. Rows with arrays of unequal length are skipped."""
    even = candidates.where(F.size("verdicts") == F.size("rewards"))
    each = even.select("trace_id", "mmsi", F.posexplode(F.arrays_zip("verdicts", "rewards")).alias("pos", "c")).select("trace_id", "mmsi", "pos", F.col("c.verdicts").alias("verdict"), F.col("c.rewards").alias("reward"))
    w = Window.partitionBy("trace_id").orderBy(F.desc("reward.total"), "pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best = each.withColumn("best", F.first(F.struct("verdict", "reward", "pos")).over(w)).where("pos <> best.pos")
    best = best.withColumn("gap", F.col("best.reward.total") - F.col("reward.total")).where(F.col("gap") >= margin)
    return best.select("trace_id", "mmsi", F.col("best.verdict").alias("chosen"), F.col("verdict").alias("rejected"), F.col("best.reward").alias("chosen_reward"), F.col("reward").alias("rejected_reward"), "gap", "pos")


def write_triples(df: DataFrame, path: str) -> None:
    """M3: appends the triples as JSON lines."""
    df.write.mode("append").json(path)


def promotion_decisions(gates: DataFrame, probes: DataFrame, shadows: DataFrame, burns: DataFrame) -> DataFrame:
    """M4: steps (stage:action) and status of each candidate: gate, probe if there is one, shadow, then the canary weights until one burns.

    gates (candidate_id, passed), probes (candidate_id, blocked), shadows
    (candidate_id, passed), burns (candidate_id, weight, burning). Of repeated
    results the worst counts: a failed gate or shadow, a blocked probe, the
    least weight that burns. Candidates are those with a gate.
    """
    first_burn = burns.where("burning").groupBy("candidate_id").agg(F.min("weight").alias("burn_weight"))
    worst = lambda df, c, name: df.groupBy("candidate_id").agg(F.bool_and(F.coalesce(c, F.lit(False))).alias(name))
    any_block = probes.groupBy("candidate_id").agg(F.bool_or(F.coalesce("blocked", F.lit(True))).alias("blocked"))
    j = worst(gates, "passed", "gate").join(any_block, "candidate_id", "left").join(worst(shadows, "passed", "shadow"), "candidate_id", "left").join(first_burn, "candidate_id", "left")
    gate, shadow, blocked = F.col("gate"), F.coalesce("shadow", F.lit(False)), F.coalesce("blocked", F.lit(False))
    say = lambda stage, ok: F.array(F.concat(F.lit(f"{stage}:"), F.when(ok, "pass").otherwise("fail")))
    ramp = F.transform(
        F.filter(F.array(*map(F.lit, WEIGHTS)), lambda x: F.col("burn_weight").isNull() | (x <= F.col("burn_weight"))),
        lambda x: F.concat(F.lit("canary_"), x.cast("string"), F.when(x == F.col("burn_weight"), ":revert").otherwise(":advance")),
    )
    none = F.array().cast("array<string>")
    steps = F.concat(
        say("gate", gate), F.when(gate & F.col("blocked").isNotNull(), say("reward_probe", ~blocked)).otherwise(none),
        F.when(gate & ~blocked, say("shadow", shadow)).otherwise(none), F.when(gate & ~blocked & shadow, ramp).otherwise(none),
    )
    status = (
        F.when(~gate, "rejected_gate").when(blocked, "rejected_reward_probe").when(~shadow, "rejected_shadow")
        .when(F.col("burn_weight").isNotNull(), "rolled_back").otherwise("promoted")
    )
    return j.select("candidate_id", steps.alias("steps"), status.alias("status"))
