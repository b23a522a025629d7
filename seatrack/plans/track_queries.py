"""Queries over tracks, detectors and joins, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from seatrack.operators import detect, joins, lanes, prisms
from seatrack.operators import features as W

from .adapters import ctes, view

R = "6371000.0e0"
CAP = "12.8611e0"


def hav(a, b, c, d):
    return (
        f"2 * {R} * asin(least(1.0e0, sqrt(power(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * power(sin(radians({d} - {b}) / 2), 2))))"
    )


def rounded(df, digits=5, **special):
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, special.get(c, digits)).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


FEAT = f"""
lagged as (select *, lag(t_s) over w as p_t, lag(lat) over w as p_lat, lag(lon) over w as p_lon from positions window w as (partition by mmsi order by seq)),
moved as (select *, case when p_t is null then 0.0e0 else greatest(0.0e0, t_s - p_t) end as gap_s, case when p_t is null then 0.0e0 else {hav('p_lat', 'p_lon', 'lat', 'lon')} end as distance_m from lagged),
feat as (select *, case when p_t is null then 0.0e0 else distance_m / greatest(gap_s, 1e-6) end as v_required_mps,
  case when p_t is null then 1.0e0 else least(1.0e0, {CAP} / greatest(distance_m / greatest(gap_s, 1e-6), 1e-6)) end as p_physical from moved)"""
POS = "with " + ctes("positions")
#: points of each report's track: history and itself, by time, the first of equal times
TRACK = f"""{FEAT},
hist as (select mmsi, seq, p_physical, list({{'t': t_s, 'lat': lat, 'lon': lon}}) over (partition by mmsi order by seq rows between 5 preceding and current row) as h from feat),
pts as (select mmsi, seq, i, h[i].t as t, h[i].lat as lat, h[i].lon as lon from (select mmsi, seq, h, unnest(range(1, len(h) + 1)) as i from hist)),
uniq as (select mmsi, seq, t, arg_min(lat, i) as lat, arg_min(lon, i) as lon from pts group by mmsi, seq, t),
steps as (select *, lag(t) over w as t0, lag(lat) over w as lat0, lag(lon) over w as lon0 from uniq window w as (partition by mmsi, seq order by t)),
speeds as (select mmsi, seq, coalesce(max(case when t > t0 then {hav('lat0', 'lon0', 'lat', 'lon')} / (t - t0) else 0.0e0 end), 0.0e0) as v_max_mps from steps group by mmsi, seq)"""
BEAR = lambda a, b, c, d: (
    f"degrees(atan2(sin(radians({d} - {b})) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - {b}))))"
)
TURN = f"""last3 as (select *, row_number() over (partition by mmsi, seq order by t desc) as k from uniq),
wide as (select mmsi, seq, count(*) as n, max(case when k = 1 then lat end) as la1, max(case when k = 1 then lon end) as lo1, max(case when k = 2 then lat end) as la2, max(case when k = 2 then lon end) as lo2,
  max(case when k = 3 then lat end) as la3, max(case when k = 3 then lon end) as lo3 from last3 group by mmsi, seq),
turned as (select mmsi, seq, n, case when n >= 3 then abs({BEAR('la3', 'lo3', 'la2', 'lo2')} - ({BEAR('la2', 'lo2', 'la1', 'lo1')})) else 0.0e0 end as raw from wide),
turn as (select mmsi, seq, least(raw - 360 * floor(raw / 360), 360 - (raw - 360 * floor(raw / 360))) as heading_change_deg from turned)"""
GAPS = f"""led as (select *, lead(t_s) over w as e_t, lead(lat) over w as e_lat, lead(lon) over w as e_lon from positions window w as (partition by mmsi order by t_s, seq)),
gaps as (select mmsi, seq, t_s, e_t - t_s as duration_s, {hav('lat', 'lon', 'e_lat', 'e_lon')} as distance_m from led where e_t - t_s > 600)"""
AGM = lambda d, s: (
    f"(0.6e0 * (1.0e0 - least(1.0e0, {CAP} / greatest({d} / greatest({s}, 1.0e0), 1e-6))) + 0.4e0 * (1.0e0 / (1.0e0 + exp(-((ln(1 + {d}) + 0.001e0 * {s} - 12.0e0) / 3.0e0)))))"
)
LX = lambda lat, lon: (f"(radians({lon} - lon0) * cos(radians(lat0)) * {R})", f"(radians({lat} - lat0) * {R})")
_px, _py = LX("p.lat", "p.lon")
_ax, _ay = LX("a_lat", "a_lon")
_bx, _by = LX("b_lat", "b_lon")
LANE = f"""flat as (select p.mmsi, p.seq, ord, {_px} as px, {_py} as py, {_ax} as ax, {_ay} as ay, {_bx} as bx, {_by} as by_ from positions p, segments),
para as (select *, greatest(0.0e0, least(1.0e0, ((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) as u from flat),
lane as (select mmsi, seq, min(sqrt(power(px - ax - u * (bx - ax), 2) + power(py - ay - u * (by_ - ay), 2))) as lane_m from para group by mmsi, seq)"""
_mx, _my = LX("w.lat", "w.lon")
MARK = f"mark as (select p.mmsi, p.seq, min(sqrt(power({_px} - {_mx}, 2) + power({_py} - {_my}, 2))) as waypoint_m from positions p, waypoints w group by 1, 2)"


def pos(s, d):
    return view(s, d, "positions")


def track(s, d):
    return W.assemble_track(W.with_history(pos(s, d)))


def w3(s, d):
    return rounded(track(s, d).select("mmsi", "seq", F.size("track").alias("n_points"), F.unix_seconds(F.col("track")[0]["t"]).alias("first_s"), F.unix_seconds(F.element_at("track", -1)["t"]).alias("last_s"),
                                      F.aggregate("track", F.lit(0.0), lambda a, p: a + p["lat"]).alias("sum_lat")))


def gaps(s, d):
    return detect.gap_measure(detect.gap_candidates(pos(s, d)))


def p7(s, d):
    odd = pos(s, d).withColumn("lat", F.when(F.col("seq") % 19 == 0, 91.0).otherwise(F.col("lat"))).withColumn("sog", F.when(F.col("seq") % 23 == 0, -1.0).otherwise(F.col("sog"))).withColumn("domain", F.when(F.col("seq") % 29 == 0, "submarine").otherwise("vessel"))
    return W.admit_requests(odd)[1].select("mmsi", "seq", "reason")


def d12(s, d):
    scored = detect.score_fleet(pos(s, d), view(s, d, "segments"), view(s, d, "waypoints"), joins.registry_status(view(s, d, "items")))
    return rounded(scored.select("mmsi", "seq", F.array_join("reasons.code", ",").alias("reasons"), "score", "confidence", "needs_review"))


def d1(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("mmsi").orderBy("t", "seq")
    pairs = pos(s, d).select("mmsi", "seq", F.struct("t", "lat", "lon").alias("a"), F.lead(F.struct("t", "lat", "lon")).over(w).alias("b")).where("b is not null")
    return prisms.prisms(pairs).withColumn("prism_id", F.concat_ws("-", "mmsi", "seq"))


def gap_prisms(s, d, kind="ellipse"):
    return prisms.footprints(d1(s, d).where((F.col("duration_s") > 600) & F.col("reject_reason").isNull()), kind)


def meetings(s, d, method):
    """Pairs are sought among all the vessels' silences; a vessel a day apart is elsewhere in this table's layout."""
    return prisms.rendezvous(gap_prisms(s, d), method, ("area",) if method == "stp" else ("area", "box_union")).select("a", "b", "t0", "t1", F.round("area", 7).alias("area"), F.round("confidence", 5).alias("confidence"))


def j1(s, d):
    p = pos(s, d)
    asked = p.where("event_type = 'view'").select("mmsi", "seq", "t")
    feats = p.where("event_type = 'click'").select("mmsi", "t", "lat", F.col("seq").alias("fseq"))
    out = joins.asof_join(asked, feats, "mmsi", "t", "t", max_age_s=3600, order="fseq")
    return out.select("mmsi", "seq", "f_fseq", F.round("f_lat", 6).alias("f_lat"))


def j3(s, d):
    q = view(s, d, "queue").withColumn("label", F.lit(None).cast("string")).withColumn("reviewer", F.lit(None).cast("string"))
    return joins.apply_feedback(q, view(s, d, "queue").where("label is not null"))[0].select("trace_id", "label", "reviewer")


def lengths(s, d):
    return joins.edge_lengths(view(s, d, "nodes"), view(s, d, "edges"))


def g2(s, d):
    e = view(s, d, "edges")
    routes = e.alias("x").join(e.alias("y"), F.expr("x.to_node = y.from_node")).select(F.concat_ws(">", "x.from_node", "x.to_node", "y.to_node").alias("route_id"), F.array("x.from_node", "x.to_node", "y.to_node").alias("route"))
    return rounded(lanes.route_reward(routes, view(s, d, "nodes"), lengths(s, d)), 7)


def pick(df, *cols):
    return rounded(df.select(*cols))


LEN = f"lengths as (select e.*, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} as length_m from edges e join nodes a on e.from_node = a.node_id join nodes b on e.to_node = b.node_id)"
NE = "with " + ctes("nodes", "edges")



def _plane(name, lat, lon):
    """x and y of a point about (lat_ref, lon_ref), all in radians, as SQL columns."""
    half = f"power(sin(({lat} - lat_ref) / 2), 2) + cos(lat_ref) * cos({lat}) * power(sin(({lon} - lon_ref) / 2), 2)"
    c = f"(2 * asin(sqrt(least(1.0e0, {half}))))"
    k = f"(6371000.0e0 * case when {c} = 0 then 1.0e0 else {c} / sin({c}) end)"
    x = f"{k} * cos({lat}) * sin({lon} - lon_ref) as x_{name}"
    return f"{x}, {k} * (cos(lat_ref) * sin({lat}) - sin(lat_ref) * cos({lat}) * cos({lon} - lon_ref)) as y_{name}"


D2_SQL = f"""{POS},
led as (select *, lead(t_s) over w as e_t, lead(lat) over w as e_lat, lead(lon) over w as e_lon
        from positions window w as (partition by mmsi order by t_s, seq)),
q as (select mmsi || '-' || seq as prism_id, {hav('lat', 'lon', 'e_lat', 'e_lon')} as dist, {CAP} * (e_t - t_s) as reach,
             radians(lat) as la, radians(lon) as oa, radians(e_lat) as lb, radians(e_lon) as ob
      from led where e_t - t_s > 600),
mid as (select *, atan2(sin(la) + sin(lb), sqrt(power(cos(la) * cos(oa) + cos(lb) * cos(ob), 2) + power(cos(la) * sin(oa) + cos(lb) * sin(ob), 2))) as lat_ref,
               atan2(cos(la) * sin(oa) + cos(lb) * sin(ob), cos(la) * cos(oa) + cos(lb) * cos(ob)) as lon_ref from q),
plane as (select *, {_plane('a', 'la', 'oa')}, {_plane('b', 'lb', 'ob')} from mid),
shape as (select prism_id, lat_ref, lon_ref, atan2(y_b - y_a, x_b - x_a) as turn,
                 case when dist - 1e-6 <= reach then reach / 2 else dist / 2 end as major,
                 case when dist - 1e-6 <= reach then sqrt(greatest(0.0e0, reach * reach - dist * dist)) / 2 else 0.0e0 end as minor from plane),
edge as (select *, major * cos(2 * pi() * i / 64) as u, minor * sin(2 * pi() * i / 64) as v from shape, range(64) r(i)),
far as (select *, sqrt(u * u + v * v) / 6371000.0e0 as c, atan2(u * cos(turn) - v * sin(turn), u * sin(turn) + v * cos(turn)) as toward from edge),
north as (select *, asin(greatest(-1.0e0, least(1.0e0, sin(lat_ref) * cos(c) + cos(lat_ref) * sin(c) * cos(toward)))) as lat from far),
ring as (select prism_id, degrees(lat) as y, degrees(lon_ref + atan2(sin(toward) * sin(c) * cos(lat_ref), cos(c) - sin(lat_ref) * sin(lat))) as x from north)
select prism_id, round(min(x), 6) as x0, round(max(x), 6) as x1, round(min(y), 6) as y0, round(max(y), 6) as y1,
       cast(count(*) as int) as n_points, cast(1 as int) as n_parts
from ring group by prism_id"""

ENTRIES = {
    "w1_track_features": (lambda s, d: pick(W.track_features(pos(s, d)), "mmsi", "seq", "gap_s", "distance_m", "v_required_mps", "p_physical"),
        f"{POS},{FEAT} select mmsi, seq, round(gap_s, 5) as gap_s, round(distance_m, 5) as distance_m, round(v_required_mps, 5) as v_required_mps, round(p_physical, 5) as p_physical from feat"),
    "p1_physics_gate": (lambda s, d: pick(W.physics_gate(W.track_features(pos(s, d))), "mmsi", "seq", "p_physical"), f"{POS},{FEAT} select mmsi, seq, round(p_physical, 5) as p_physical from feat where p_physical >= 0.3e0"),
    "w2_history": (lambda s, d: pick(W.with_history(pos(s, d)), "mmsi", "seq", F.size("history").alias("n_history"), F.try_element_at("history", F.lit(1))["lat"].alias("oldest_lat"), F.try_element_at("history", F.lit(-1))["lat"].alias("newest_lat")),
        f"{POS} select mmsi, seq, cast(count(*) over w as int) as n_history, round(first_value(lat) over w, 5) as oldest_lat, round(last_value(lat) over w, 5) as newest_lat from positions window w as (partition by mmsi order by seq rows between 5 preceding and 1 preceding)"),
    "w3_track": (w3, f"{POS},{TRACK} select mmsi, seq, cast(count(*) as int) as n_points, min(t) as first_s, max(t) as last_s, round(sum(lat), 5) as sum_lat from uniq group by 1, 2"),
    "w4_speed_signal": (lambda s, d: pick(W.speed_signal(track(s, d)), "mmsi", "seq", "v_max_mps", "speed_severity"),
        f"{POS},{TRACK} select mmsi, seq, round(v_max_mps, 5) as v_max_mps, round(greatest(0.0e0, least(1.0e0, (v_max_mps / {CAP} - 1) / 3)), 5) as speed_severity from speeds"),
    "p2_corrupt_tracks": (lambda s, d: pick(W.reject_corrupt(W.speed_signal(track(s, d)))[1], "mmsi", "seq", "v_max_mps"), f"{POS},{TRACK} select mmsi, seq, round(v_max_mps, 5) as v_max_mps from speeds where v_max_mps > 12 * {CAP}"),
    "w5_course_change": (lambda s, d: rounded(W.course_change(track(s, d)).select("mmsi", "seq", "heading_change_deg"), 4), f"{POS},{TRACK},{TURN} select mmsi, seq, round(heading_change_deg, 4) as heading_change_deg from turn"),
    "p3_detector_flags": (lambda s, d: W.detector_flags(W.with_history(pos(s, d))).select("mmsi", "seq", "n_history", "runs_speed", "runs_gap", "runs_lane"),
        f"{POS} select mmsi, seq, cast(least(idx - 1, 5) as int) as n_history, idx > 1 as runs_speed, idx > 3 as runs_gap, true as runs_lane from positions"),
    "w6_latest_features": (lambda s, d: pick(W.latest_features(W.feature_rows(W.physics_gate(W.track_features(pos(s, d))))), "entity_id", "feature_name", "seq", "ttl", "p_physical"),
        f"{POS},{FEAT} select cast(mmsi as varchar) as entity_id, 'track' as feature_name, max(seq) as seq, arg_max(t_s, seq) + 604800 as ttl, round(arg_max(p_physical, seq), 5) as p_physical from feat where p_physical >= 0.3e0 group by mmsi"),
    "w7_score_requests": (lambda s, d: W.score_requests(W.with_history(pos(s, d))).select("mmsi", "seq", F.size(F.from_json("request", "history array<struct<t:string>>")["history"]).alias("n_history"), F.get_json_object("request", "$.fix.t").alias("t")),
        f"{POS} select mmsi, seq, cast(least(idx - 1, 5) as int) as n_history, strftime(timestamp '1970-01-01' + to_seconds(t_s), '%Y-%m-%dT%H:%M:%SZ') as t from positions"),
    "w8_time_violations": (lambda s, d: W.monotone_violations(pos(s, d)).select("mmsi", "seq"), f"{POS},{FEAT} select mmsi, seq from feat where t_s < p_t"),
    "p4_uncertain": (lambda s, d: W.flag_uncertain(view(s, d, "queue")).select("seq", "uncertain"), "with " + ctes("queue") + " select seq, abs(score - 0.6e0) <= 0.1e0 or coalesce(epistemic_variance > 0.05e0, false) as uncertain from queue"),
    "p5_tenant_rows": (lambda s, d: W.for_tenant(view(s, d, "queue"), "T1").select("seq", "tenant_id"), "with " + ctes("queue") + " select seq, tenant_id from queue where tenant_id = 'T1'"),
    "p6_kinematic_violations": (lambda s, d: pick(W.kinematic_violations(pos(s, d)), "mmsi", "seq", "speed_mps"),
        f"{POS}, o as (select *, lag(t_s) over w as p_t, lag(lat) over w as p_lat, lag(lon) over w as p_lon from positions window w as (partition by mmsi order by t_s, seq)), v as (select mmsi, seq, {hav('p_lat', 'p_lon', 'lat', 'lon')} / (t_s - p_t) as speed_mps from o where t_s > p_t) select mmsi, seq, round(speed_mps, 5) as speed_mps from v where speed_mps > 1.05e0 * {CAP}"),
    "p7_rejected_requests": (p7, f"{POS} select mmsi, seq, case when seq % 19 = 0 then 'lat' when seq % 23 = 0 then 'sog' else 'domain' end as reason from positions where seq % 19 = 0 or seq % 23 = 0 or seq % 29 = 0"),
    "d1_prisms": (lambda s, d: pick(d1(s, d), "mmsi", "seq", "distance_m", "duration_s", "feasible", "semi_major_m", F.round("semi_minor_m", 2).alias("semi_minor_m"), "reject_reason"),
        f"{POS}, led as (select *, lead(t_s) over w as e_t, lead(lat) over w as e_lat, lead(lon) over w as e_lon from positions window w as (partition by mmsi order by t_s, seq)), q as (select mmsi, seq, {hav('lat', 'lon', 'e_lat', 'e_lon')} as dist, (e_t - t_s) * 1.0e0 as dur from led where e_t is not null) select mmsi, seq, round(dist, 5) as distance_m, dur as duration_s, dist - 1e-6 <= {CAP} * dur as feasible, round(case when dist - 1e-6 <= {CAP} * dur then {CAP} * dur / 2 else dist / 2 end, 5) as semi_major_m, round(case when dist - 1e-6 <= {CAP} * dur then sqrt(greatest(0.0e0, power({CAP} * dur, 2) - dist * dist)) / 2 else 0.0e0 end, 2) as semi_minor_m, case when dur <= 0 then 'duration' end as reject_reason from q"),
    "d2_footprint_boxes": (lambda s, d: rounded(gap_prisms(s, d).select("prism_id", "x0", "x1", "y0", "y1", F.size("ring").alias("n_points"), F.size("parts").alias("n_parts")), 6), D2_SQL),
    "d3_ellipse_at": (lambda s, d: pick(prisms.ellipse_at(d1(s, d).where("duration_s > 0").withColumn("mid", F.timestamp_seconds((F.unix_seconds("a.t") + F.unix_seconds("b.t")) / 2)), "mid"), "mmsi", "seq", F.col("at_semi_major_m").alias("semi_major_m")),
        f"{POS}, led as (select *, lead(t_s) over w as e_t, lead(lat) over w as e_lat, lead(lon) over w as e_lon from positions window w as (partition by mmsi order by t_s, seq)), q as (select mmsi, seq, {hav('lat', 'lon', 'e_lat', 'e_lon')} as dist, (e_t - t_s) * 1.0e0 as dur from led where e_t > t_s) select mmsi, seq, round(case when dist - 1e-6 <= {CAP} * dur then {CAP} * dur / 2 else dist / 2 end, 5) as semi_major_m from q"),
    "d4_gap_candidates": (lambda s, d: pick(detect.gap_candidates(pos(s, d)), "mmsi", "seq", "duration_s", "distance_m"), f"{POS}, {GAPS} select mmsi, seq, duration_s * 1.0e0 as duration_s, round(distance_m, 5) as distance_m from gaps"),
    "d5_gap_regions": (lambda s, d: prisms.merge_gap_regions(gap_prisms(s, d, "rectangle")).groupBy("mmsi", "region_id").agg(F.count(F.lit(1)).alias("n_gaps"), F.min("a.t").alias("head_t")).select("mmsi", "region_id", "n_gaps", F.unix_seconds("head_t").alias("head_s")), None),
    "d6_gap_measure": (lambda s, d: pick(gaps(s, d), "mmsi", "seq", "p_physical", "p_data", "agm", F.when(F.col("rank") == 1, True).otherwise(False).alias("first")),
        f"{POS}, {GAPS}, m as (select *, {AGM('distance_m', 'duration_s')} as agm from gaps) select mmsi, seq, round(least(1.0e0, {CAP} / greatest(distance_m / greatest(duration_s, 1.0e0), 1e-6)), 5) as p_physical, round(1.0e0 / (1.0e0 + exp(-((ln(1 + distance_m) + 0.001e0 * duration_s - 12.0e0) / 3.0e0))), 5) as p_data, round(agm, 5) as agm, row_number() over (partition by mmsi order by agm desc, t_s, seq) = 1 as first from m"),
    "d8_nearest_lane": (lambda s, d: pick(detect.off_lane(detect.nearest_lane(pos(s, d), view(s, d, "segments"), [])), "mmsi", "seq", F.round("lane_m", 3).alias("lane_m"), "off_lane", "lane_severity"),
        "with " + ctes("positions", "segments") + f", {LANE} select mmsi, seq, round(lane_m, 3) as lane_m, lane_m > 2000 as off_lane, round(greatest(0.0e0, least(1.0e0, (lane_m - 2000) / 4000)), 5) as lane_severity from lane"),
    "d9_unexpected_turns": (lambda s, d: pick(detect.unexpected_turns(detect.nearest_waypoint(W.course_change(track(s, d)), view(s, d, "waypoints"))).where("unexpected_turn"), "mmsi", "seq", F.round("waypoint_m", 3).alias("waypoint_m"), "turn_severity"),
        "with " + ctes("positions", "waypoints") + f",{TRACK},{TURN},{MARK} select mmsi, seq, round(waypoint_m, 3) as waypoint_m, round(greatest(0.5e0, least(1.0e0, heading_change_deg / 90)), 5) as turn_severity from turn join mark using (mmsi, seq) where heading_change_deg > 45 and waypoint_m > 5000"),
    "d10_model_scores": (lambda s, d: pick(detect.gap_measure(detect.with_model_scores(detect.gap_candidates(pos(s, d)), pos(s, d).where("seq % 2 = 0").select("mmsi", "seq", F.lit(0.25).alias("model_score"), F.lit(0.01).alias("epistemic_variance")))), "mmsi", "seq", "p_data", "epistemic_variance"),
        f"{POS}, {GAPS} select mmsi, seq, case when seq % 2 = 0 then 0.25e0 else round(1.0e0 / (1.0e0 + exp(-((ln(1 + distance_m) + 0.001e0 * duration_s - 12.0e0) / 3.0e0))), 5) end as p_data, case when seq % 2 = 0 then 0.01e0 end as epistemic_variance from gaps"),
    "d12_score_fleet": (d12, "with " + ctes("positions", "segments", "waypoints", "items") + f""",{TRACK},{TURN},{LANE},{MARK},
gapped as (select mmsi, seq, t - t0 as dur, {hav('lat0', 'lon0', 'lat', 'lon')} as dist, t0 from steps where t - t0 > 600),
measured as (select *, {AGM('dist', 'dur')} as agm from gapped),
gap as (select mmsi, seq, max(agm) as agm, arg_max(dur, (agm, -t0)) as dur from measured group by 1, 2),
reg as (select mmsi, bool_or(feature_name = 'watchlist') as wl, bool_or(feature_name like 'sanctions:%') as sl from items where not deleted group by mmsi),
sev as (select f.mmsi, f.seq, greatest(0.0e0, least(1.0e0, (v_max_mps / {CAP} - 1) / 3)) as s1,
  case when f.idx > 3 and gap.agm is not null then greatest(0.0e0, least(1.0e0, 0.5e0 * greatest(0.0e0, least(1.0e0, (gap.dur - 600) / 6600.0e0)) + 0.5e0 * gap.agm)) else 0.0e0 end as s2,
  case when lane_m > 2000 then greatest(0.0e0, least(1.0e0, (lane_m - 2000) / 4000)) else 0.0e0 end as s3,
  case when heading_change_deg > 45 and waypoint_m > 5000 then greatest(0.5e0, least(1.0e0, heading_change_deg / 90)) else 0.0e0 end as s4,
  case when coalesce(wl, false) then 0.9e0 else 0.0e0 end as s5, case when coalesce(sl, false) then 0.95e0 else 0.0e0 end as s6
  from feat f join speeds using (mmsi, seq) join turn using (mmsi, seq) join lane using (mmsi, seq) join mark using (mmsi, seq) left join gap using (mmsi, seq) left join reg on f.mmsi = reg.mmsi
  where f.p_physical >= 0.3e0 and v_max_mps <= 12 * {CAP}),
scored as (select *, 1 - (1 - s1) * (1 - s2) * (1 - s3) * (1 - s4) * (1 - s5) * (1 - s6) as sc from sev)
select mmsi, seq, concat_ws(',', case when s1 > 0 then 'implausible_speed' end, case when s2 > 0 then 'abnormal_gap' end, case when s3 > 0 then 'off_corridor' end, case when s4 > 0 then 'unexpected_node' end, case when s5 > 0 then 'watchlist_hit' end, case when s6 > 0 then 'sanctions_hit' end) as reasons,
  round(sc, 5) as score, round(1 - 2 * least(sc, 1 - sc), 5) as confidence, 1 - 2 * least(sc, 1 - sc) < 0.7e0 or sc >= 0.6e0 as needs_review from scored"""),
    "d13_rendezvous_tgard": (lambda s, d: meetings(s, d, "tgard"), None),
    "d13_rendezvous_dc_tgard": (lambda s, d: meetings(s, d, "dc-tgard"), None),
    "d13_rendezvous_stp": (lambda s, d: meetings(s, d, "stp"), None),
    "d14_prism_intersections": (lambda s, d: prisms.intersect_prisms(gap_prisms(s, d), ("area",)).select("a", "b", "t0", "t1", F.round("area", 7).alias("area")), None),
    "j1_asof_join": (j1, f"{POS}, a as (select mmsi, seq, t_s from positions where event_type = 'view'), b as (select mmsi, t_s, arg_max(lat, seq) as lat, max(seq) as fseq from positions where event_type = 'click' group by mmsi, t_s), j as (select a.mmsi, a.seq, b.fseq, b.lat, a.t_s - b.t_s as age from a asof left join b on a.mmsi = b.mmsi and a.t_s >= b.t_s) select mmsi, seq, case when age <= 3600 then fseq end as f_fseq, case when age <= 3600 then round(lat, 6) end as f_lat from j"),
    "j2_registry_status": (lambda s, d: joins.registry_status(view(s, d, "items")).select("mmsi", "watchlisted", "sanctioned", F.round("list_severity", 5).alias("list_severity"), F.array_join("regimes", ",").alias("regimes")),
        "with " + ctes("items") + " select mmsi, bool_or(feature_name = 'watchlist') as watchlisted, bool_or(feature_name like 'sanctions:%') as sanctioned, round(max(severity) filter (where feature_name = 'watchlist'), 5) as list_severity, coalesce(string_agg(distinct replace(feature_name, 'sanctions:', ''), ',' order by replace(feature_name, 'sanctions:', '')) filter (where feature_name like 'sanctions:%'), '') as regimes from items where not deleted group by mmsi"),
    "j3_apply_feedback": (j3, "with " + ctes("queue") + ", f as (select trace_id, arg_max(label, seq) as label, arg_max(reviewer, seq) as reviewer from queue where label is not null group by 1) select q.trace_id, f.label, f.reviewer from queue q left join f using (trace_id)"),
    "j4_enqueue": (lambda s, d: joins.enqueue(view(s, d, "queue").where("seq % 3 = 0"), view(s, d, "queue")).select("trace_id", "seq"), "with " + ctes("queue") + " select trace_id, min(seq) as seq from queue where trace_id not in (select trace_id from queue where seq % 3 = 0) group by 1"),
    "j5_score_diff": (lambda s, d: rounded(joins.score_diff(view(s, d, "queue").select("seq", "score"), view(s, d, "queue").where("seq % 97 <> 0").select("seq", (F.col("score") * 0.98).alias("score")), "seq"), 7),
        "with " + ctes("queue") + " select count(*) filter (where seq % 97 <> 0) as n_pairs, count(*) filter (where seq % 97 = 0) as n_unpaired, round(avg(case when seq % 97 <> 0 then abs(score - score * 0.98e0) end), 7) as mean_abs_diff, round(max(case when seq % 97 <> 0 then abs(score - score * 0.98e0) end), 7) as max_abs_diff, false as passed from queue"),
    "j6_edge_lengths": (lambda s, d: pick(lengths(s, d), "from_node", "to_node", "length_m"), f"{NE}, {LEN} select from_node, to_node, round(length_m, 5) as length_m from lengths"),
    "j7_graph_violations": (lambda s, d: joins.graph_violations(view(s, d, "nodes").where("node_id <> 'n3'"), view(s, d, "edges").withColumn("frequency", F.when(F.col("frequency") % 5 == 0, 0).otherwise(F.col("frequency")))),
        f"{NE} select 'unknown_from' as kind, from_node || '>' || to_node as key from edges where from_node = 'n3' union all select 'unknown_to', from_node || '>' || to_node from edges where to_node = 'n3' union all select 'self_loop', from_node || '>' || to_node from edges where from_node = to_node union all select 'frequency', from_node || '>' || to_node from edges where frequency % 5 = 0"),
    "j8_slo": (lambda s, d: joins.evaluate_slo(
            view(s, d, "queue").where("tenant_id <> 'T2'").groupBy("tenant_id").agg(F.avg("score").alias("value")).withColumn("metric", F.lit("score")),
            view(s, d, "queue").select("tenant_id").distinct().select("tenant_id", F.lit("score").alias("metric"), F.lit(">=").alias("comparator"), F.lit(0.4).alias("target"))).select("tenant_id", "metric", F.round("value", 6).alias("value"), "met"),
        "with " + ctes("queue") + " select tenant_id, 'score' as metric, case when tenant_id <> 'T2' then round(avg(score), 6) end as value, tenant_id <> 'T2' and avg(score) >= 0.4e0 as met from queue group by tenant_id"),
    "g1_feasible_edges": (lambda s, d: lanes.feasible_edges(lengths(s, d), 14400.0).select("from_node", "to_node"), f"{NE}, {LEN} select from_node, to_node from lengths where length_m <= {CAP} * 14400 * 1.05e0"),
    "g2_route_reward": (g2, f"{NE}, {LEN}, r as (select x.from_node as a, x.to_node as b, y.to_node as c, x.length_m + y.length_m as m from lengths x join lengths y on x.to_node = y.from_node), g as (select node_id, vessel_count * 1.0e0 / (select sum(vessel_count) from nodes) as gain from nodes) select a || '>' || b || '>' || c as route_id, round(ga.gain + case when b <> a then gb.gain else 0 end + case when c <> a and c <> b then gc.gain else 0 end - m / 100000, 7) as reward from r join g ga on ga.node_id = a join g gb on gb.node_id = b join g gc on gc.node_id = c"),
    "g3_best_routes": (lambda s, d: rounded(lanes.best_routes(view(s, d, "nodes"), lengths(s, d), 2).select("start", F.concat_ws(">", "route").alias("route"), "reward"), 6),
        f"{NE}, {LEN}, g as (select node_id, vessel_count * 1.0e0 / (select sum(vessel_count) from nodes) as gain from nodes), r0 as (select node_id as start, node_id as route, gain as reward, node_id as last from g), r1 as (select start, route || '>' || to_node as route, reward + case when to_node = start then 0 else gain end - length_m / 100000 as reward, to_node as last from r0 join lengths on from_node = last join g on g.node_id = to_node), r2 as (select start, route || '>' || l.to_node as route, reward + case when l.to_node = start or l.to_node = last then 0 else gain end - length_m / 100000 as reward, l.to_node as last from r1 join lengths l on l.from_node = last join g on g.node_id = l.to_node where not (l.from_node = start and l.to_node = last)), u as (select * from r0 union all select * from r1 union all select * from r2) select start, route, round(reward, 6) as reward from u qualify row_number() over (partition by start order by round(reward, 9) desc, route) = 1"),
    "t2_minute_representatives": (lambda s, d: __import__("seatrack.streaming.jobs", fromlist=["x"]).minute_representatives(pos(s, d)).select("mmsi", F.unix_seconds("minute").alias("minute_s"), "seq"),
        f"{POS} select mmsi, t_s // 60 * 60 as minute_s, arg_max(seq, (t_s, -seq)) as seq from positions group by 1, 2"),
}
