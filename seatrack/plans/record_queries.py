"""Queries over preference records, promotions and registries whose keys repeat, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from seatrack.operators import cdc, monitor, preference

from .adapters import ctes, view

Q = "with " + ctes("queue")


def _reward(structural):
    return F.struct(*[(structural if p == "structural" else F.lit(0.0)).alias(p) for p in preference.PARTS])


def m1(s, d):
    q = view(s, d, "queue")
    contexts = q.where("seq % 2 = 0").select("trace_id", F.concat(F.lit("ctx"), "seq").alias("context"), "seq")
    arm = lambda n: _reward(F.when(F.col("seq") % n == 0, -1.0).otherwise(0.5))
    cases = q.withColumn("chosen_reward", arm(7)).withColumn("rejected_reward", F.when(F.col("seq") % 5 != 2, arm(3)))
    by_trace = q.where("seq % 4 = 2").select("trace_id", "seq", arm(7).alias("chosen_reward"), arm(11).alias("rejected_reward"))
    out = preference.triples_from_labels(cases, contexts, by_trace)
    return out.select("trace_id", "context", "reviewer", "chosen", F.col("rejected_reward.structural").alias("rejected_structural"), "structural_violation")


M1_SQL = f"""{Q},
ctx as (select trace_id, arg_max('ctx' || seq, seq) as context from queue where seq % 2 = 0 group by 1),
rew as (select trace_id, case when max(seq) % 11 = 0 then -1.0e0 else 0.5e0 end as structural from queue where seq % 4 = 2 group by 1),
cases as (
  select q.*, case when seq % 7 = 0 then -1.0e0 else 0.5e0 end as chosen_structural,
    coalesce(case when seq % 5 <> 2 then case when seq % 3 = 0 then -1.0e0 else 0.5e0 end end, rew.structural, 0.0e0) as rejected_structural
  from queue q left join rew using (trace_id))
select trace_id, context, reviewer, 'not_anomalous' as chosen, rejected_structural,
  chosen_structural < 0 or rejected_structural < 0 as structural_violation
from cases left join ctx using (trace_id) where label = 'incorrect' and score >= 0.6e0"""


def m4(s, d):
    n = F.col("seq")
    c = view(s, d, "queue").select(F.col("trace_id").alias("candidate_id"), "seq")
    gates, shadows = c.select("candidate_id", (n % 5 != 0).alias("passed")), c.select("candidate_id", (n % 7 != 0).alias("passed"))
    probes = c.where(n % 2 == 0).select("candidate_id", (n % 3 == 0).alias("blocked"))
    weights = F.explode(F.array(*map(F.lit, preference.WEIGHTS))).alias("weight")
    burns = c.select("candidate_id", "seq", weights).select("candidate_id", "weight", ((n % 11 == 0) & (F.col("weight") >= 25)).alias("burning"))
    return preference.promotion_decisions(gates, probes, shadows, burns).select("candidate_id", F.array_join("steps", ",").alias("steps"), "status")


M4_SQL = f"""{Q},
c as (
  select trace_id as candidate_id, bool_and(seq % 5 <> 0) as gate, bool_or(seq % 3 = 0) filter (where seq % 2 = 0) as blocked,
    bool_and(seq % 7 <> 0) as shadow, bool_or(seq % 11 = 0) as burns
  from queue group by 1),
k as (select *, gate and not coalesce(blocked, false) as goes_on from c)
select candidate_id,
  concat_ws(',', 'gate:' || case when gate then 'pass' else 'fail' end,
    case when gate and blocked is not null then 'reward_probe:' || case when blocked then 'fail' else 'pass' end end,
    case when goes_on then 'shadow:' || case when shadow then 'pass' else 'fail' end end,
    case when goes_on and shadow then
      case when burns then 'canary_5:advance,canary_25:revert' else 'canary_5:advance,canary_25:advance,canary_50:advance,canary_100:advance' end end) as steps,
  case when not gate then 'rejected_gate' when coalesce(blocked, false) then 'rejected_reward_probe' when not shadow then 'rejected_shadow'
    when burns then 'rolled_back' else 'promoted' end as status
from k"""


def c10(s, d):
    q = view(s, d, "queue")
    stored = q.where("label is not null").select("trace_id", F.col("tenant_id").alias("reason"), "created_at", F.col("created_at").alias("updated_at"))
    blank = F.when(F.col("seq") % 9 == 0, " ").otherwise(F.concat(F.lit("new"), "seq"))
    changes = q.select("trace_id", blank.alias("reason"), (F.col("seq") % 4 == 0).alias("deleted"), (F.col("created_at") + 7).alias("changed_at"), "seq")
    return cdc.upsert_registry(stored, changes, ["trace_id"])


C10_SQL = f"""{Q},
o as (
  select trace_id, arg_max(tenant_id, created_at) as reason, min(created_at) as created_at, max(created_at) as updated_at
  from queue where label is not null group by 1),
gone as (select trace_id, max(seq) as seq from queue where seq % 4 = 0 group by 1),
n as (
  select trace_id, arg_max('new' || q.seq, q.seq) as reason, min(created_at) + 7 as first_at, max(created_at) + 7 as last_at
  from queue q left join gone g using (trace_id)
  where q.seq % 4 <> 0 and q.seq % 9 <> 0 and (g.seq is null or q.seq > g.seq) group by 1),
kept as (select * from o where trace_id not in (select trace_id from gone))
select coalesce(kept.trace_id, n.trace_id) as trace_id, coalesce(n.reason, kept.reason) as reason,
  coalesce(kept.created_at, first_at) as created_at, coalesce(last_at, kept.updated_at) as updated_at
from kept full join n on kept.trace_id = n.trace_id"""

#: Each vessel's flags before and after, three spellings of two regimes.
_REGIME = "case event_id % 5 when 0 then ' OFAC ' when 1 then 'ofac' when 2 then 'Eu' when 3 then 'EU ' else ' ' end"


def c10_sanctions(s, d):
    e = s.read.parquet(f"{d}/events.parquet").select(
        (F.col("user_id") % 400).alias("mmsi"), F.expr(_REGIME).alias("regime"), F.concat(F.lit("ref"), "event_id").alias("reference"), F.col("event_id").alias("seq")
    )
    told = e.withColumn("id", F.lit(None).cast("string"))
    stored = told.where("seq % 3 = 0 and trim(regime) <> ''").select("mmsi", "regime", "id", "reference", (F.col("seq") * 60).alias("created_at"), (F.col("seq") * 60 + 1).alias("updated_at"))
    changes = told.where("seq % 3 <> 0").select("mmsi", "regime", "id", "reference", (F.col("seq") % 23 == 0).alias("deleted"), (F.col("seq") * 90).alias("changed_at"), "seq")
    return cdc.upsert_sanctions(stored, changes)


C10_SANCTIONS_SQL = f"""with e as (select user_id % 400 as mmsi, lower(trim({_REGIME})) as regime, 'ref' || event_id as reference, event_id as seq from events),
o as (
  select mmsi, regime, arg_max(reference, seq) as reference, min(seq) * 60 as created_at, max(seq) * 60 + 1 as updated_at
  from e where seq % 3 = 0 and regime <> '' group by 1, 2),
gone as (select mmsi, max(seq) as seq from e where seq % 3 <> 0 and seq % 23 = 0 group by 1),
n as (
  select mmsi, regime, arg_max(reference, e.seq) as reference, min(e.seq) * 90 as first_at, max(e.seq) * 90 as last_at
  from e left join gone g using (mmsi)
  where e.seq % 3 <> 0 and e.seq % 23 <> 0 and regime <> '' and (g.seq is null or e.seq > g.seq) group by 1, 2),
kept as (select * from o where mmsi not in (select mmsi from gone))
select mmsi, regime, mmsi || ':' || regime as id, coalesce(n.reference, kept.reference) as reference,
  coalesce(kept.created_at, first_at) as created_at, coalesce(last_at, kept.updated_at) as updated_at
from kept full join n using (mmsi, regime)"""



def a17_conditions(s, d):
    """Vertices are trial and minute; of some, phases are missing or short."""
    load = view(s, d, "load").withColumn("at", F.col("offset_s") % 60)
    phase = F.when(F.col("at") < 20, "baseline").when(F.col("at") < 40, "burst").otherwise("recovery")
    vertex = F.concat(F.col("trial"), F.lit("/"), F.floor(F.col("offset_s") / 60))
    out = monitor.pressure_conditions(load.select(vertex.alias("vertex"), F.col("offset_s").alias("t"), phase.alias("phase"), F.col("latency_s").alias("pressure")))
    return out.select("vertex", "error", "calm_before", "pressed", "calm_after", "all_true", F.round("burst_max", 6).alias("burst_max"))


A17_SQL = f"""with {ctes("load")},
s as (
  select trial || '/' || cast(floor(offset_s / 60) as bigint) as vertex, offset_s as t, latency_s as p,
    case when offset_s % 60 < 20 then 'baseline' when offset_s % 60 < 40 then 'burst' else 'recovery' end as phase
  from load),
k as (select *, row_number() over (partition by vertex, phase order by t desc, p desc) as i from s),
v as (
  select vertex, max(p) filter (where phase = 'baseline' and i <= 3) as b, count(*) filter (where phase = 'baseline') as nb, max(p) filter (where phase = 'burst') as x,
    max(p) filter (where phase = 'recovery' and i <= 3) as r, count(*) filter (where phase = 'recovery') as nr
  from k group by 1),
e as (
  select *, case when nb < 3 then 'too few samples: baseline' when x is null then 'too few samples: burst' when nr < 3 then 'too few samples: recovery' end as error from v),
c as (select *, error is null and b <= 0.1e0 as calm_before, error is null and x > 0.1e0 as pressed, error is null and r <= 0.1e0 as calm_after from e)
select vertex, error, calm_before, pressed, calm_after, calm_before and pressed and calm_after as all_true, round(x, 6) as burst_max from c"""

ENTRIES = {
    "a17_conditions": (a17_conditions, A17_SQL),
    "m1_label_triples": (m1, M1_SQL),
    "m4_promotion": (m4, M4_SQL),
    "c10_registry_upsert": (c10, C10_SQL),
    "c10_sanction_flags": (c10_sanctions, C10_SANCTIONS_SQL),
}
