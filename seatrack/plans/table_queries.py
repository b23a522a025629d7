"""Queries over statistics, monitoring, change capture, lake tables and preference data, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from seatrack.operators import cdc, lanes, monitor, preference, stats
from seatrack.sources import reports, tables

from .adapters import ctes, view
from .track_queries import pick, rounded


def halves(s, d, *cols):
    w = view(s, d, "windows").select("tenant_id", "quantity", "price", "discount", "is_reference")
    keep = [c for c in ("tenant_id", *cols) if c]
    return w.where("is_reference").select(*keep), w.where("not is_reference").select(*keep)


def drift(s, d, tenant=False):
    a, b = halves(s, d, "quantity", "price", "discount")
    out = stats.tenant_drift(a, b) if tenant else stats.input_drift(a.drop("tenant_id"), b.drop("tenant_id"))
    return rounded(out.select(*(["tenant_id"] if tenant else []), "feature", "psi", "ks", "ks_pvalue", "drifted"), 6)


def _drift_sql(key: str, source: str) -> str:
    return f"""
long as ({source}),
edge as (select {key}feature, list_distinct([quantile_cont(value, i * 0.1e0) for i in []]) as unused, unnest(range(0, 11)) as i from long where is_reference group by {key}feature),
q as (select {key}feature, quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) as e from long where is_reference group by {key}feature),
u as (select {key}feature, list_sort(list_distinct(e)) as e from q),
b as (select l.*, len(list_filter(e[2:len(e) - 1], lambda x: x <= value)) as bin from long l join u using ({key}feature)),
c as (select {key}feature, bin, count(*) filter (where is_reference) as r, count(*) filter (where not is_reference) as k from b group by {key}feature, bin),
n as (select {key}feature, sum(r) as nr, sum(k) as nk from c group by {key}feature),
psi as (select {key}feature, sum((greatest(k / nk, 1e-6) - greatest(r / nr, 1e-6)) * ln(greatest(k / nk, 1e-6) / greatest(r / nr, 1e-6))) as psi from c join n using ({key}feature) group by {key}feature),
v as (select {key}feature, value, count(*) filter (where is_reference) as r, count(*) filter (where not is_reference) as k from long group by {key}feature, value),
cum as (select {key}feature, sum(r) over w as cr, sum(k) over w as ck from v window w as (partition by {key}feature order by value)),
ks as (select {key}feature, max(abs(cr / nr - ck / nk)) as ks, max(nr) as nr, max(nk) as nk from cum join n using ({key}feature) group by {key}feature),
lam as (select *, (sqrt(nr * nk / (nr + nk)) + 0.12e0 + 0.11e0 / sqrt(nr * nk / (nr + nk))) * ks as lam from ks),
p as (select {key}feature, ks, case when lam < 0.1e0 then 1.0e0 when lam < 1 then greatest(0.0e0, least(1.0e0, 1 - sqrt(2 * pi()) / lam * list_sum([exp(-power(2 * j - 1, 2) * pi() * pi() / (8 * lam * lam)) for j in range(1, 21)])))
  else greatest(0.0e0, least(1.0e0, 2 * list_sum([(case when j % 2 = 1 then 1 else -1 end) * exp(-2.0e0 * j * j * lam * lam) for j in range(1, 101)]))) end as ks_pvalue from lam)""".replace(
        f"edge as (select {key}feature, list_distinct([quantile_cont(value, i * 0.1e0) for i in []]) as unused, unnest(range(0, 11)) as i from long where is_reference group by {key}feature),\n", ""
    )


_LONG = "select tenant_id, 'quantity' as feature, quantity * 1.0e0 as value, is_reference from windows union all select tenant_id, 'price', price * 1.0e0, is_reference from windows union all select tenant_id, 'discount', discount * 1.0e0, is_reference from windows"
_LONG_ALL = _LONG.replace("select tenant_id,", "select")
_LONG_POOLED = _LONG + " union all " + _LONG.replace("select tenant_id,", "select 'pooled',")
_VERDICT = "psi >= 0.25e0 or (psi >= 0.1e0 and ks_pvalue < 0.05e0) as drifted"


def burn(s, d):
    b = view(s, d, "buckets").withColumn("target", F.when(F.col("tenant_id") == "T0", 0.999).when(F.col("tenant_id") == "T1", 0.995).otherwise(0.99))
    return rounded(monitor.burn_rate(b, 60.0).select("tenant_id", "ts", "fast_long", "fast_short", "slow_long", "warn_short", "status"), 5)


_W = lambda n: f"over (partition by tenant_id order by ts rows between {n - 1} preceding and current row)"
_BURN = ", ".join(f"case when sum(total) {_W(n)} > 0 then sum(bad) {_W(n)} / sum(total) {_W(n)} else 0.0e0 end / (1 - target) as {name}" for name, n in (("fast_long", 60), ("fast_short", 5), ("slow_long", 360), ("slow_short", 30), ("warn_long", 1440), ("warn_short", 120)))
BURN_SQL = "with " + ctes("buckets") + f""", t as (select *, case tenant_id when 'T0' then 0.999e0 when 'T1' then 0.995e0 else 0.99e0 end as target from buckets), r as (select tenant_id, ts, {_BURN} from t)
select tenant_id, cast(ts as bigint) as ts, round(fast_long, 5) as fast_long, round(fast_short, 5) as fast_short, round(slow_long, 5) as slow_long, round(warn_short, 5) as warn_short,
 case when (fast_long > 14.4e0 and fast_short > 14.4e0) or (slow_long > 6 and slow_short > 6) then 'page' when warn_long > 3 and warn_short > 3 then 'warning' else 'ok' end as status from r"""


def verdicts(s, d):
    return cdc.guard_verdicts(view(s, d, "changes"))


GUARD = "with " + ctes("changes") + """, g as (select *, case when op = 'r' then 0 else lsn end as guard_lsn from changes),
v as (select *, not content_error and coalesce(guard_lsn > max(case when not content_error then guard_lsn end) over (partition by event_table, pk order by seq rows between unbounded preceding and 1 preceding), true) as applied from g)"""


def raw_extract(s, d):
    p = view(s, d, "positions")
    return p.select("mmsi", F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("t"), F.when(F.col("seq") % 301 == 0, 95.0).otherwise(F.col("lat")).alias("lat"), "lon", "sog", "cog", "seq")


def l1(s, d):
    p = view(s, d, "positions").withColumn("t", F.timestamp_seconds(F.floor(F.col("t_s") / 1800) * 1800).cast("string"))
    return rounded(lanes.canonicalize(p).select("mmsi", F.unix_seconds("t").alias("t_s"), "seq", "lat"))


def training_set(s, d):
    p = view(s, d, "positions")
    asked = p.where("event_type = 'purchase'").select("mmsi", F.col("t").alias("event_timestamp"), "seq")
    return lanes.export_training_set(asked, p.where("event_type = 'view'").select("mmsi", "t", F.round("lat", 6).alias("lat"), F.col("seq").alias("fseq")), 86_400, "fseq")[0].drop("event_timestamp", "f_t")


def messages(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", F.concat(F.lit('{"mmsi": '), F.when(F.col("event_id") % 7 == 0, F.lit("true")).when(F.col("event_id") % 7 == 1, F.concat(F.lit('"00'), F.col("user_id"), F.lit('"'))).when(F.col("event_id") % 7 == 2, F.lit("1.0")).otherwise(F.col("user_id").cast("string")),
        F.lit(', "t": "2024-06-01T00:00:00'), F.when(F.col("event_id") % 11 == 0, F.lit("")).otherwise(F.lit("Z")), F.lit('", "lat": 1.5, "lon": '), F.when(F.col("event_id") % 13 == 0, F.lit('"x"')).otherwise(F.lit("2")), F.lit("}")).alias("value"))


def m2(s, d):
    c = view(s, d, "candidates").groupBy("trace_id", "mmsi").agg(F.array_sort(F.collect_list(F.struct("pos", "verdict", "total"))).alias("x"))
    zero = F.lit(0.0)
    c = c.select("trace_id", "mmsi", F.transform("x", lambda x: x["verdict"]).alias("verdicts"), F.transform("x", lambda x: F.struct(x["total"].alias("total"), zero.alias("structural"), zero.alias("shaping"), zero.alias("data"), zero.alias("pref"))).alias("rewards"))
    return preference.triples_from_rewards(c).select("trace_id", "chosen", "rejected", F.round("gap", 6).alias("gap"))


def holdout_auc(s, d):
    return rounded(stats.roc_auc(view(s, d, "holdout"), "label", "score", ["candidate_id"]), 8)


def disagreement(s, d):
    return rounded(stats.disagreement_rate(view(s, d, "queue"), by=["tenant_id"]))


def reduced(s, d):
    return cdc.reduce_state(view(s, d, "changes").where("not content_error"))


def lane_edges(s, d):
    node = F.when(F.col("seq") % 5 != 0, F.concat(F.lit("c"), F.floor(F.col("lat") * 2)))
    visits = view(s, d, "positions").groupBy("mmsi", "t").agg(F.max_by(node, "seq").alias("node_id"))
    return lanes.lane_edges(visits)


LANE_EDGES_SQL = f"""with {ctes("positions")},
last as (select mmsi, t_s, max(seq) as seq from positions group by 1, 2),
visits as (
  select l.mmsi, l.t_s, 'c' || cast(floor(p.lat * 2) as bigint) as node_id
  from last l join positions p on l.mmsi = p.mmsi and l.seq = p.seq where l.seq % 5 <> 0),
steps as (select lag(node_id) over (partition by mmsi order by t_s) as from_node, node_id as to_node from visits)
select from_node, to_node, count(*) as frequency from steps where from_node <> to_node group by 1, 2"""


def fingerprint(s, d):
    """Words of every row's whole numbers and event type; as text, since they exceed 64 bits."""
    rows = view(s, d, "positions").select("mmsi", "seq", "idx", "event_type", "t_s", F.round(F.col("lat") * 10000).cast("long").alias("lat_e4"))
    rows = rows.select(*[F.col(c).cast("string" if c == "event_type" else "long").alias(c) for c in rows.columns])
    out = lanes.fingerprint(rows, "t_s")
    return out.select("n", *[F.col(f"word_{i}").cast("string").alias(f"word_{i}") for i in range(4)], F.col("first_t").alias("first_s"), F.col("last_t").alias("last_s"))


FINGERPRINT_SQL = f"""with {ctes("positions")},
r as (select *, cast(round(lat * 10000) as bigint) as lat_e4 from positions),
d as (
  select t_s, sha256('{{"event_type":"' || event_type || '","idx":' || idx || ',"lat_e4":' || lat_e4 || ',"mmsi":' || mmsi || ',"seq":' || seq || ',"t_s":' || t_s || '}}') as d
  from r)
select count(*) as n,
  {", ".join(f"cast(sum(cast('0x' || substr(d, {1 + 12 * i}, 12) as bigint)) as varchar) as word_{i}" for i in range(4))},
  min(t_s) as first_s, max(t_s) as last_s
from d"""

H = "with " + ctes("holdout")
Q = "with " + ctes("queue")



def _erf_sql(x: str) -> str:
    """The error function of a column of at most 3, as DuckDB has none."""
    series = "1.0e0"
    for n in reversed(range(1, 71)):
        series = f"(1.0e0 + 2 * {x} * {x} / {2 * n + 1} * {series})"
    return f"(2 * {x} * exp(-{x} * {x}) / sqrt(pi()) * {series})"


def _tail_sql(x: str) -> str:
    """The error function of a column above 3."""
    tail = f"({x} + 1)"
    for n in reversed(range(1, 61)):
        tail = f"({x} + {n / 2} / {tail})"
    return f"(1 - exp(-{x} * {x}) / sqrt(pi()) / {tail})"


A9_SQL = f"""{H},
c as (select candidate_id, score, count(*) filter (where label = 1) as pos, count(*) filter (where label <> 1) as neg from holdout group by 1, 2),
k as (select *, sum(neg) over (partition by candidate_id order by score) as cn from c),
auc as (select candidate_id, sum(pos * (cn - neg / 2.0e0)) / (sum(pos) * sum(neg)) as auc from k group by 1),
z as (select *, (y - mu) / sigma as z, abs((y - mu) / sigma) / sqrt(2.0e0) as u from holdout),
e as (select *, sign(z) * case when u < 3 then {_erf_sql("u")} else {_tail_sql("u")} end as erf from z),
s as (select candidate_id, avg(sigma * (z * erf + 2 * exp(-z * z / 2) / sqrt(2 * pi()) - 1 / sqrt(pi()))) as crps, avg((y - mu) * (y - mu)) / avg(sigma * sigma) as ratio from e group by 1),
j as (select *, concat_ws(',', case when auc < 0.85e0 then 'auc' end, case when crps > 1 then 'crps' end, case when not ratio between 0.8e0 and 1.2e0 then 'calibration' end) as failures from auc join s using (candidate_id))
select candidate_id, round(auc, 6) as auc, round(crps, 6) as crps, round(ratio, 6) as ratio, failures, failures = '' as passed from j"""

ENTRIES = {
    "a1_a4_input_drift": (drift, "with " + ctes("windows") + "," + _drift_sql("", _LONG_ALL) + f" select feature, round(psi, 6) as psi, round(ks, 6) as ks, round(ks_pvalue, 6) as ks_pvalue, {_VERDICT} from psi join p using (feature)"),
    "a5_tenant_drift": (lambda s, d: drift(s, d, True), "with " + ctes("windows") + "," + _drift_sql("tenant_id, ", _LONG_POOLED) + f" select tenant_id, feature, round(psi, 6) as psi, round(ks, 6) as ks, round(ks_pvalue, 6) as ks_pvalue, {_VERDICT} from psi join p using (tenant_id, feature)"),
    "a6_roc_auc": (holdout_auc, H + ", c as (select candidate_id, score, count(*) filter (where label = 1) as pos, count(*) filter (where label <> 1) as neg from holdout group by 1, 2), k as (select *, sum(neg) over (partition by candidate_id order by score) as cn from c) select candidate_id, round(sum(pos * (cn - neg / 2.0e0)) / (sum(pos) * sum(neg)), 8) as auc, cast(sum(pos) as bigint) as n_pos, cast(sum(neg) as bigint) as n_neg from k group by 1"),
    "a8_calibration_ratio": (lambda s, d: rounded(stats.calibration_ratio(view(s, d, "holdout").withColumn("err", F.col("y") - F.col("mu")).withColumn("var", F.col("sigma") * F.col("sigma")), by=["candidate_id"]), 7),
        H + " select candidate_id, round(avg((y - mu) * (y - mu)), 7) as mse, round(avg(sigma * sigma), 7) as mean_var, count(*) as n, round(avg((y - mu) * (y - mu)) / avg(sigma * sigma), 7) as ratio from holdout group by 1"),
    "a9_holdout_gate": (lambda s, d: rounded(stats.holdout_gate(view(s, d, "holdout")).withColumn("failures", F.array_join("failures", ",")), 6), A9_SQL),
    "a10_calibration_watch": (lambda s, d: stats.calibration_watch(view(s, d, "holdout").withColumn("err", F.col("y") - F.col("mu")).withColumn("var", F.col("sigma") * F.col("sigma")).withColumn("g", F.col("doc_id") % 30), ["g"]).select("g", "n", "status"),
        H + ", r as (select doc_id % 30 as g, count(*) as n, avg((y - mu) * (y - mu)) / avg(sigma * sigma) as ratio from holdout group by 1) select g, n, case when n < 20 then 'insufficient' when ratio between 0.8e0 and 1.2e0 then 'ok' else 'alert' end as status from r"),
    "a11_disagreement_rate": (disagreement, Q + ", c as (select *, score >= 0.6e0 and coalesce(label in ('correct', 'incorrect'), false) as k from queue) select tenant_id, count(*) filter (where k and label = 'incorrect') as n_incorrect, count(*) filter (where k) as n_counted, count(*) filter (where not k) as n_excluded, round(count(*) filter (where k and label = 'incorrect') / count(*) filter (where k), 5) as rate from c group by 1"),
    "a12_disagreement_threshold": (lambda s, d: rounded(stats.disagreement_threshold(stats.disagreement_rate(view(s, d, "queue").withColumn("w", F.floor(F.col("seq") / 150)), by=["tenant_id", "w"]))),
        Q + ", c as (select tenant_id, seq // 150 as w, count(*) filter (where label = 'incorrect') as i, count(*) as n from queue where score >= 0.6e0 and label in ('correct', 'incorrect') group by 1, 2), g as (select tenant_id, list_sort(list(i / n) filter (where n >= 20)) as r, avg(i / n) filter (where n >= 20) as m from c group by 1) select tenant_id, coalesce(cast(len(r) as int), 0) as n_windows, case when len(r) >= 5 then round(greatest(r[(len(r) * 19 + 19) // 20], 2 * m, 0.05e0), 5) else 0.2e0 end as threshold from g"),
    "a13_drift_decision": (lambda s, d: stats.classify_drift(view(s, d, "queue").select("seq", (F.col("seq") % 7 == 0).alias("concept"), (F.col("seq") % 5 == 0).alias("calibration"), F.when(F.col("seq") % 3 != 1, F.col("seq") % 3 == 0).alias("input"))).select("seq", "decision"),
        Q + " select seq, case when seq % 7 = 0 then 'concept' when seq % 5 = 0 then 'calibration' when seq % 3 = 0 then 'input' else 'none' end as decision from queue"),
    "a14_reward_probe": (lambda s, d: rounded(stats.reward_probe(view(s, d, "queue").select("tenant_id", F.when(F.col("seq") % 2 == 0, "baseline").otherwise("candidate").alias("arm"), F.col("score").alias("reward"), (F.col("seq") % 13 * 0.1).alias("structural"), (F.col("seq") % 17 == 0).alias("violation")), ["tenant_id"]).select("tenant_id", "baseline_reward", "candidate_reward", "candidate_violation", "blocked"), 7),
        Q + ", g as (select tenant_id, avg(score) filter (where seq % 2 = 0) as br, avg(score) filter (where seq % 2 = 1) as cr, avg(seq % 13 * 0.1e0) filter (where seq % 2 = 0) as bs, avg(seq % 13 * 0.1e0) filter (where seq % 2 = 1) as cs, avg(cast(seq % 17 = 0 as int)) filter (where seq % 2 = 0) as bv, avg(cast(seq % 17 = 0 as int)) filter (where seq % 2 = 1) as cv from queue group by 1) select tenant_id, round(br, 7) as baseline_reward, round(cr, 7) as candidate_reward, round(cv, 7) as candidate_violation, cr > br and (cv > bv or cs < bs) as blocked from g"),
    "a15_m5_burn_rate": (burn, BURN_SQL),
    "a16_a21_load_summary": (lambda s, d: rounded(monitor.load_summary(view(s, d, "load")).select("trial", "n", "n_good", "n_5xx", "good_ratio", "p50", "p95", "p99", "latency_max", "rate_per_s"), 6),
        "with " + ctes("load") + " select trial, count(*) as n, count(*) filter (where good) as n_good, count(*) filter (where http_status >= 500) as n_5xx, round(count(*) filter (where good) / count(*), 6) as good_ratio, round(quantile_cont(latency_s, 0.5), 6) as p50, round(quantile_cont(latency_s, 0.95), 6) as p95, round(quantile_cont(latency_s, 0.99), 6) as p99, round(max(latency_s), 6) as latency_max, round(count(*) / greatest(max(offset_s), 1.0e0), 6) as rate_per_s from load group by 1"),
    "a16_load_buckets": (lambda s, d: monitor.load_buckets(view(s, d, "load")), "with " + ctes("load") + ", e as (select trial, unnest(range(0, cast(floor(max(offset_s) / 60) as bigint) + 1)) as bucket from load group by 1), c as (select trial, cast(floor(offset_s / 60) as bigint) as bucket, count(*) as n, count(*) filter (where good) as n_good from load group by 1, 2) select e.trial, e.bucket, coalesce(n, 0) as n, coalesce(n_good, 0) as n_good from e left join c using (trial, bucket)"),
    "a17_pressure_summary": (lambda s, d: rounded(monitor.pressure_summary(view(s, d, "load").select(F.col("trial").alias("vertex"), F.col("offset_s").alias("t"), F.when(F.col("offset_s") < 100, "baseline").when(F.col("offset_s") < 300, "burst").otherwise("recovery").alias("phase"), F.col("latency_s").alias("pressure")))),
        "with " + ctes("load") + ", s as (select trial as vertex, offset_s as t, latency_s as p, case when offset_s < 100 then 'baseline' when offset_s < 300 then 'burst' else 'recovery' end as phase from load), a as (select *, max(p) over w as mx, count(*) over w as n from s window w as (partition by vertex order by t rows between current row and unbounded following)) select vertex, round(max(p) filter (where phase = 'baseline'), 5) as baseline_max, round(max(p) filter (where phase = 'burst'), 5) as burst_max, round(max(p) filter (where phase = 'recovery'), 5) as recovery_max, round(min(t) filter (where phase = 'recovery' and mx <= 0.1e0 and n >= 3), 5) as settled_at from a group by 1"),
    "a18_shard_counts": (lambda s, d: monitor.shard_counts(view(s, d, "positions"), "mmsi", 8), "with " + ctes("positions") + ", c as (select ((cast('0x' || substr(md5(cast(mmsi as varchar)), 1, 8) as bigint)) * 8) >> 32 as shard, count(*) as n from positions group by 1) select r.range as shard, coalesce(n, 0) as n from range(8) r left join c on c.shard = r.range"),
    "a19_latency_histogram": (lambda s, d: monitor.latency_histogram(view(s, d, "load")), "with " + ctes("load") + ", b as (select unnest([0.05e0, 0.1e0, 0.2e0, 0.3e0, 0.5e0, 1.0e0, 2.5e0, 5.0e0, 'infinity'::double]) as le) select le, (select count(*) from load where latency_s <= le) as n from b"),
    "a20_cost_ledger": (lambda s, d: rounded(monitor.cost_ledger(view(s, d, "positions").select("mmsi", "t", F.lit(2.0).alias("vcpu"), (F.col("seq") % 10 * 0.1).alias("seconds")), 0.0001).withColumn("day", F.col("day").cast("string")), 7),
        "with " + ctes("positions") + " select mmsi, cast(cast(timestamp '1970-01-01' + to_seconds(t_s) as date) as varchar) as day, count(*) as n_calls, round(sum(2.0e0 * (seq % 10 * 0.1e0) * 0.0001e0), 7) as cost from positions group by 1, 2"),
    "a22_slot_lag": (lambda s, d: monitor.slot_lag_alerts(view(s, d, "queue").select(F.col("seq").alias("name"), (F.col("seq") * 1_000_000).alias("current_lsn"), F.when(F.col("seq") % 3 == 0, F.col("seq") * 900_000).alias("confirmed_lsn"), F.when(F.col("seq") % 3 == 1, F.col("seq") * 950_000).alias("restart_lsn"))).select("name", "lag_bytes", "alert"),
        Q + ", l as (select seq as name, case seq % 3 when 0 then seq * 100000 when 1 then seq * 50000 else 0 end as lag_bytes from queue) select name, lag_bytes, lag_bytes >= 209715200 as alert from l"),
    "c3_guard_verdicts": (lambda s, d: verdicts(s, d).select("seq", "event_table", "pk", "applied"), GUARD + " select seq, event_table, pk, applied from v"),
    "c4_reduced_state": (reduced, "with " + ctes("changes") + ", g as (select *, case when op = 'r' then 0 else lsn end as guard_lsn from changes where not content_error) select event_table, pk, arg_max(guard_lsn, (guard_lsn, -seq)) as lsn, arg_max(op, (guard_lsn, -seq)) = 'd' as deleted, nullif(arg_max(case when op = 'd' then '' else after end, (guard_lsn, -seq)), '') as content from g group by 1, 2"),
    "c6_audit_rows": (lambda s, d: cdc.audit_rows(verdicts(s, d), 1).select("batch_id", "seq", "op", "lsn", "after_json", "applied"), GUARD + " select cast(1 as bigint) as batch_id, seq, op, lsn, after as after_json, applied from v"),
    "c8_touched_keys": (lambda s, d: cdc.touched_keys(view(s, d, "changes")), "with " + ctes("changes") + " select distinct event_table, pk from changes where not content_error"),
    "c9_batch_census": (lambda s, d: cdc.batch_census(verdicts(s, d).withColumn("kind", F.when(F.col("content_error"), "error").otherwise("change"))), GUARD + " select count(*) filter (where not content_error) as events, count(*) filter (where not content_error and applied) as applied, count(*) filter (where not content_error and not applied) as rejected, count(*) filter (where not content_error and op = 'd') as deletes, cast(0 as bigint) as tombstones, count(*) filter (where content_error) as errors, cast(0 as bigint) as skips from v"),
    "c2_tenants": (lambda s, d: cdc.normalize_tenant(view(s, d, "changes").select("seq", F.when(F.col("lsn") % 2 == 0, F.lit("AAAAAAAA-0000-0000-0000-000000000001")).alias("key_tenant"), F.when(F.col("lsn") % 3 == 0, F.lit("aaaaaaaa-0000-0000-0000-000000000001")).when(F.col("lsn") % 5 == 0, "bad").alias("before_tenant"), F.lit(None).cast("string").alias("after_tenant"))).select("seq", "tenant_id", "tenant_error"),
        "with " + ctes("changes") + ", k as (select seq, lsn % 2 = 0 as a, lsn % 3 = 0 as b, lsn % 3 <> 0 and lsn % 5 = 0 as c from changes) select seq, case when c then null when a or b then 'aaaaaaaa-0000-0000-0000-000000000001' else '00000000-0000-0000-0000-000000000000' end as tenant_id, case when a and c then 'tenants differ' when c then 'no uuid' end as tenant_error from k"),
    "c7_online_items": (lambda s, d: cdc.online_items(view(s, d, "items").select(F.when(F.col("feature_name") == "vessel_meta", "vessels").otherwise("watchlist").alias("event_table"), F.to_json(F.struct("mmsi")).alias("pk"), F.lit(1).cast("long").alias("lsn"), "deleted", F.to_json(F.struct("reason", F.lit(5).alias("lsn"))).alias("content"))).select("entity_id", "feature_name", "deleted", F.col("attributes")["reason"].alias("reason"), F.size("attributes").alias("n_attributes")),
        "with " + ctes("items") + " select '00000000-0000-0000-0000-000000000000:' || mmsi as entity_id, case when feature_name = 'vessel_meta' then 'vessel_meta' else 'watchlist' end as feature_name, deleted, reason, cast(1 as int) as n_attributes from items"),
    "q1_quality_report": (lambda s, d: lanes.quality_report(raw_extract(s, d), 10).where("check not like 'column%'"),
        "with " + ctes("positions") + ", p as (select *, lag(t_s) over (partition by mmsi order by seq) as p_t from positions) select 'lat_range' as check, false as passed, count(*) filter (where seq % 301 = 0) as unexpected from p union all select 'time_monotone', count(*) filter (where t_s < p_t) = 0, count(*) filter (where t_s < p_t) from p union all select c, true, 0 from (select unnest(['row_count', 'lon_range', 'mmsi_range', 'mmsi_not_null']) as c)"),
    "l1_canonical": (l1, "with " + ctes("positions") + " select mmsi, t_s // 1800 * 1800 as t_s, min(seq) as seq, round(arg_min(lat, seq), 5) as lat from positions group by 1, 2"),
    "l2_local_projection": (lambda s, d: rounded(lanes.project_local(view(s, d, "positions"), ["mmsi"]).select("mmsi", "seq", "x", "y"), 2),
        "with " + ctes("positions") + ", c as (select *, avg(lat) over (partition by mmsi) as la, avg(lon) over (partition by mmsi) as lo from positions) select mmsi, seq, round(radians(lon - lo) * cos(radians(la)) * 6371000, 2) as x, round(radians(lat - la) * 6371000, 2) as y from c"),
    "l3_simplified_tracks": (lambda s, d: rounded(lanes.simplify_tracks(view(s, d, "positions").select("mmsi", "seq", "t", "lat", "lon")).select("mmsi", "seq", "lat", "lon")), None),
    "l5_lane_edges": (lane_edges, LANE_EDGES_SQL),
    "l9_fingerprint": (fingerprint, FINGERPRINT_SQL),
    "l8_training_set": (training_set, "with " + ctes("positions") + ", a as (select mmsi, seq, t_s from positions where event_type = 'purchase'), b as (select mmsi, t_s, arg_max(lat, seq) as lat, max(seq) as fseq from positions where event_type = 'view' group by mmsi, t_s), j as (select a.mmsi, a.seq, b.fseq, b.lat, a.t_s - b.t_s as age from a asof left join b on a.mmsi = b.mmsi and a.t_s >= b.t_s) select mmsi, seq, case when age <= 86400 then fseq end as f_fseq, case when age <= 86400 then round(lat, 6) end as f_lat from j"),
    "s2_parse_reports": (lambda s, d: reports.parse_reports(messages(s, d)).select("event_id", "mmsi", "lat", "lon", "reject_reason"),
        "select event_id, case when event_id % 7 in (0, 2) then null else user_id end as mmsi, 1.5e0 as lat, case when event_id % 13 = 0 then null else 2.0e0 end as lon, case when event_id % 7 in (0, 2) then 'mmsi' when event_id % 11 = 0 then 't' when event_id % 13 = 0 then 'lon' end as reject_reason from events"),
    "s4_quarantine": (lambda s, d: reports.split_quarantine(reports.parse_reports(messages(s, d)))[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n")),
        "select reason, count(*) as n from (select case when event_id % 7 in (0, 2) then 'mmsi' when event_id % 11 = 0 then 't' when event_id % 13 = 0 then 'lon' end as reason from events) where reason is not null group by 1"),
    "s10_layout": (lambda s, d: tables.with_layout(view(s, d, "positions"), "positions").groupBy(F.col("t_day").cast("string").alias("t_day")).agg(F.count(F.lit(1)).alias("n")),
        "with " + ctes("positions") + " select cast(cast(timestamp '1970-01-01' + to_seconds(t_s) as date) as varchar) as t_day, count(*) as n from positions group by 1"),
    "m2_reward_triples": (m2, "with " + ctes("candidates") + ", b as (select *, first_value(verdict) over w as chosen, first_value(total) over w as best, first_value(pos) over w as bp from candidates window w as (partition by trace_id order by total desc, pos)) select trace_id, chosen, verdict as rejected, round(best - total, 6) as gap from b where pos <> bp and best - total >= 0.5e0"),
}
