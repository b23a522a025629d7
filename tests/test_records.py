"""Preference records, promotions and registries whose keys repeat."""

import random

from pyspark.sql import functions as F

from seatrack.operators import cdc, monitor, preference


def test_one_case_one_triple(spark):
    zero = dict.fromkeys(preference.PARTS, 0.0)
    kind = "struct<" + ",".join(f"{p}:double" for p in preference.PARTS) + ">"
    bad = {**zero, "structural": -0.5}
    queue = spark.createDataFrame(
        [("t1", 1, 0.9, "incorrect", "ann", bad, zero), ("t1", 1, 0.8, "incorrect", "bob", zero, zero), ("t2", 2, 0.7, "incorrect", None, None, None), ("t3", 3, 0.9, "correct", "ann", None, None), ("t4", 4, 0.1, "incorrect", "ann", None, None)],
        f"trace_id string, mmsi long, score double, label string, reviewer string, chosen_reward {kind}, rejected_reward {kind}",
    )
    contexts = spark.createDataFrame([("t1", "old", 1), ("t1", "new", 2), ("t9", "other", 1)], "trace_id string, context string, seq long")
    rewards = spark.createDataFrame([("t2", zero, zero, 1), ("t2", zero, bad, 2)], f"trace_id string, chosen_reward {kind}, rejected_reward {kind}, seq long")
    got = {(r.trace_id, r.reviewer, r.context, r.structural_violation) for r in preference.triples_from_labels(queue, contexts, rewards).collect()}
    # the violation of t1 is in the chosen arm, that of t2 in the rejected one
    assert got == {("t1", "ann", "new", True), ("t1", "bob", "new", False), ("t2", None, None, True)}
    assert {r.structural_violation for r in preference.triples_from_labels(queue, contexts).where("trace_id = 't2'").collect()} == {False}


def test_worst_result_of_a_candidate_counts(spark):
    gates = spark.createDataFrame([("a", True), ("a", False), ("b", True), ("b", True), ("c", True), ("d", True), ("e", True)], "candidate_id string, passed boolean")
    probes = spark.createDataFrame([("b", False), ("b", True), ("c", False)], "candidate_id string, blocked boolean")
    shadows = spark.createDataFrame([("c", True), ("c", True), ("d", True), ("d", False)], "candidate_id string, passed boolean")
    burns = spark.createDataFrame([("c", 50, True), ("c", 25, True), ("c", 5, False)], "candidate_id string, weight int, burning boolean")
    got = {r.candidate_id: (r.steps, r.status) for r in preference.promotion_decisions(gates, probes, shadows, burns).collect()}
    assert got == {
        "a": (["gate:fail"], "rejected_gate"), "b": (["gate:pass", "reward_probe:fail"], "rejected_reward_probe"),
        "c": (["gate:pass", "reward_probe:pass", "shadow:pass", "canary_5:advance", "canary_25:revert"], "rolled_back"),
        "d": (["gate:pass", "shadow:fail"], "rejected_shadow"), "e": (["gate:pass", "shadow:fail"], "rejected_shadow"),
    }


def test_registry_of_repeated_keys(spark):
    stored = spark.createDataFrame([(1, "x", 10, 10), (1, "y", 5, 20), (2, "z", 1, 1), (3, "q", 1, 1)], "mmsi long, reason string, created_at long, updated_at long")
    changes = spark.createDataFrame(
        [(1, "a", False, 30, 1), (1, "b", False, 30, 2), (2, None, True, 31, 3), (2, "back", False, 31, 4), (3, " ", False, 32, 5), (4, "n", False, 33, 6), (4, "n", True, 34, 7)],
        "mmsi long, reason string, deleted boolean, changed_at long, seq long",
    )
    got = {r.mmsi: (r.reason, r.created_at, r.updated_at) for r in cdc.upsert_registry(stored, changes, ["mmsi"]).collect()}
    assert got == {1: ("b", 5, 30), 2: ("back", 31, 31), 3: ("q", 1, 1)}
    assert [(r.mmsi, r.reject_reason) for r in cdc.registry_rejects(changes).collect()] == [(3, "reason is blank")]
    assert [r.mmsi for r in cdc.list_registry(stored, ["mmsi", "updated_at"]).collect()] == [1, 1, 2, 3]
    assert cdc.upsert_registry(stored, changes.where("seq > 99"), ["mmsi"]).count() == 3


def test_sanctions_by_vessel(spark):
    stored = spark.createDataFrame([(1, "OFAC", "r1", 1, 1), (1, " eu", "r2", 1, 1), (2, "eu", "r3", 1, 1)], "mmsi long, regime string, reference string, created_at long, updated_at long")
    changes = spark.createDataFrame(
        [(1, None, None, True, 5), (1, " Ofac ", "r4", False, 6), (2, "EU", "r5", False, 6), (2, " ", "r6", False, 7), (3, "un", "r7", False, 4), (3, None, None, True, 5)],
        "mmsi long, regime string, reference string, deleted boolean, changed_at long",
    )
    got = {r.id: (r.reference, r.created_at, r.updated_at) for r in cdc.upsert_sanctions(stored, changes).collect()}
    assert got == {"1:ofac": ("r4", 6, 6), "2:eu": ("r5", 1, 6)}
    assert cdc.registry_rejects(changes).select(F.max("reject_reason")).first()[0] == "regime is blank"


def test_settled_times_by_every_later_sample(spark):
    """Random samples of 60 vertices, with repeated times, missing pressures and a vertex without a name, against all later samples of each time; no window over all that follow."""
    rng = random.Random(4)
    rows = []
    for v in range(60):
        quiet, n = rng.randrange(30), rng.randrange(1, 30)
        for i in range(n):
            t = float(i if v % 4 else i // 3)
            rows.append((f"v{v}" if v else None, None if rng.random() < 0.02 else t, "baseline" if i < 3 else "burst" if i < 8 else "recovery", None if rng.random() < 0.1 else rng.uniform(0, 0.09 if i >= quiet else 0.2)))
    out = monitor.pressure_summary(spark.createDataFrame(rows, "vertex string, t double, phase string, pressure double").repartition(3))
    got = {r.vertex: (r.burst_max, r.settled_at) for r in out.collect()}
    want = {}
    for v in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == v]
        times = []
        for at in {r[1] for r in own if r[1] is not None and r[2] == "recovery"}:
            later = [r[3] for r in own if r[1] is not None and r[1] >= at]
            some = [p for p in later if p is not None]
            if len(later) >= 3 and some and max(some) <= 0.1:
                times.append(at)
        want[v] = (max((r[3] for r in own if r[2] == "burst" and r[3] is not None), default=None), min(times, default=None))
    assert got == want and 10 < sum(s is not None for _, s in want.values()) < 50
    assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower()


def test_pressure_conditions(spark):
    def phases(vertex, before, burst, after):
        return [(vertex, float(i), p, v) for i, (p, v) in enumerate([("baseline", x) for x in before] + [("burst", x) for x in burst] + [("recovery", x) for x in after])]

    rows = phases("good", [0.9, 0.0, 0.1, 0.0], [0.05, 0.6], [0.7, 0.1, 0.0, 0.05]) + phases("late", [0.0] * 3, [0.5], [0.0, 0.0, 0.2])
    rows += phases("short", [0.0] * 2, [0.5], [0.0] * 3) + phases("idle", [0.0] * 3, [], [0.0] * 3) + phases("cut", [0.0] * 3, [0.5], [0.0] * 2)
    got = {r.vertex: (r.error, r.calm_before, r.pressed, r.calm_after, r.all_true) for r in monitor.pressure_conditions(spark.createDataFrame(rows, "vertex string, t double, phase string, pressure double")).collect()}
    assert got == {
        "good": (None, True, True, True, True), "late": (None, True, True, False, False), "short": ("too few samples: baseline", False, False, False, False),
        "idle": ("too few samples: burst", False, False, False, False), "cut": ("too few samples: recovery", False, False, False, False),
    }
