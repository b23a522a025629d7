"""Domain tables derived from the given tables. The text runs in Spark SQL and in DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START_S = 1_717_200_000

SQL = {
    # ten minutes apart by vessel, with jitter, silences, jumps and a few impossible places
    "positions": f"""
select 200000000 + user_id as mmsi, event_id as seq, idx, event_type,
  {START_S} + idx * 600 + (event_id % 11 - 5) * 60 + case when event_id % 37 = 0 then 2000 else 0 end as t_s,
  40.4e0 + (user_id % 50) * 0.01e0 + (idx % 300) * 0.004e0 + (event_id % 13) * 0.0005e0
    + case when event_id % 41 = 0 then 0.15e0 else 0.0e0 end + case when event_id % 499 = 0 then 3.0e0 else 0.0e0 end as lat,
  -74.1e0 + (idx % 300) * 0.005e0 - (event_id % 17) * 0.0005e0 as lon,
  case when event_id % 9 = 0 then null else (event_id % 200) * 0.1e0 end as sog, (event_id * 7 % 360) * 1.0e0 as cog, (event_id * 11 % 360) * 1.0e0 as heading
from (select *, row_number() over (partition by user_id order by event_id) as idx from events) e""",
    "queue": """
select concat('t', event_id % 4000) as trace_id, 200000000 + user_id as mmsi, concat('T', user_id % 3) as tenant_id, event_id as seq, (event_id * 37 % 1000) * 0.001e0 as score,
  case when event_id % 6 = 0 then null else (event_id % 10) * 0.01e0 end as epistemic_variance,
  case event_id % 5 when 1 then 'correct' when 2 then 'incorrect' when 3 then 'correct' else null end as label,
  case when event_id % 5 in (1, 2, 3) then concat('r', event_id % 7) else null end as reviewer, event_id * 60 as created_at from events""",
    "changes": """
select case event_type when 'view' then 'vessels' when 'click' then 'watchlist' else 'sanctions_flags' end as event_table,
  concat('k', user_id % 40) as pk, case event_id % 7 when 0 then 'd' when 1 then 'c' when 3 then 'r' else 'u' end as op,
  event_id * 7919 % 100003 as lsn, event_id + copy * 100000000 as seq, event_id % 53 = 0 as content_error,
  concat('{"v": ', cast(event_id as string), '}') as after, cast(null as string) as before, event_id as ts_ms
from events, (select 0 as copy union all select 1 as copy) c where copy = 0 or event_id % 10 = 0""",
    "nodes": "select concat('n', n_nationkey) as node_id, 40.0e0 + n_nationkey * 0.11e0 as lat, -74.0e0 + (n_nationkey * 7 % 25) * 0.13e0 as lon, 1 + n_nationkey * 7 % 13 as vessel_count from nation",
    "edges": "select concat('n', c_nationkey) as from_node, concat('n', (c_nationkey + 1 + c_custkey % 3) % 25) as to_node, count(*) as frequency from customer group by 1, 2",
    "holdout": """
select concat('c', l.doc_id % 3) as candidate_id, l.doc_id, l.quality as label, (d.n_chars % 1000) * 0.0005e0 + l.quality * 0.3e0 as score,
  (d.n_chars % 100) * 0.01e0 as mu, 0.5e0 + (d.n_chars % 7) * 0.1e0 as sigma, (d.n_chars % 90) * 0.01e0 + l.toxic * 0.5e0 as y
from labels l join documents d on l.doc_id = d.doc_id""",
    "buckets": "select concat('T', user_id % 3) as tenant_id, floor(event_id / 10) * 60 as ts, count(*) * 100 as total, sum(case when event_type = 'error' then event_id % 9 else 0 end) as bad from events group by 1, 2",
    "load": """
select concat('L', user_id % 3) as trial, event_id * 0.5e0 as offset_s, case when event_id % 50 = 0 then 'timeout' else 'ok' end as outcome,
  case when event_id % 50 = 0 then 503 else 200 end as http_status, event_id % 50 <> 0 as good, value * 0.001e0 as latency_s from events where event_id % 700 < 500""",
    "segments": """
select 'lane' as lane_id, ord, a_lat, a_lon, b_lat, b_lon, 40.833333e0 as lat0, -73.4e0 as lon0 from
 (select 0 as ord, 40.40e0 as a_lat, -74.10e0 as a_lon, 40.85e0 as b_lat, -73.40e0 as b_lon union all select 1, 40.85e0, -73.40e0, 41.25e0, -72.70e0) s""",
    "waypoints": """
select lat, lon, 40.833333e0 as lat0, -73.4e0 as lon0 from
 (select 40.40e0 as lat, -74.10e0 as lon union all select 40.85e0, -73.40e0 union all select 41.25e0, -72.70e0) w""",
    "items": """
select 200000000 + user_id as mmsi, case event_id % 3 when 0 then 'vessel_meta' when 1 then 'watchlist' else concat('sanctions:', case when event_id % 2 = 0 then 'ofac' else 'eu' end) end as feature_name,
  event_id % 4 = 0 as deleted, concat('r', event_id % 5) as reason, (event_id % 10) * 0.1e0 as severity from events where event_id % 11 = 0""",
    "windows": "select l_returnflag as tenant_id, l_quantity as quantity, l_extendedprice as price, l_discount as discount, l_shipdate < timestamp '1995-06-17 00:00:00' as is_reference from lineitem",
    "candidates": """
select event_id as trace_no, concat('t', event_id) as trace_id, 200000000 + user_id as mmsi, pos, concat('v', pos) as verdict, (event_id * (pos + 3) * 13 % 40) * 0.1e0 as total
from events, (select 0 as pos union all select 1 as pos union all select 2 as pos) p where event_id % 3 = 0""",
}
TABLES = {"positions": ["events"], "queue": ["events"], "changes": ["events"], "nodes": ["nation"], "edges": ["customer"], "holdout": ["labels", "documents"], "buckets": ["events"], "load": ["events"], "segments": [], "waypoints": [], "items": ["events"], "windows": ["lineitem"], "candidates": ["events"]}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived table over the files of sf_dir."""
    text = SQL[name].replace("{", "{{").replace("}", "}}")
    frames = {}
    import re

    for t in TABLES[name]:
        frames[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        text = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", text)
    df = spark.sql(text, **frames)
    if name == "positions":
        df = df.withColumn("t", F.timestamp_seconds("t_s"))
    return df


def ctes(*names: str) -> str:
    """`name as (...)` for the oracle's WITH clause."""
    return ",\n".join(f"{n} as ({SQL[n].replace('as string)', 'as varchar)')})" for n in names)
