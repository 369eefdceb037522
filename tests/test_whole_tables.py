"""Registered queries read whole tables: rows beyond any former cut of ids count."""

import datetime as dt

import pytest

from vaneflow.queries import QUERIES

START = dt.datetime(2024, 1, 8, tzinfo=dt.UTC)  # within the window of the checks
USERS = [0, 3, 19, 20, 21, 5000]


@pytest.fixture(scope="module")
def events_dir(spark, tmp_path_factory):
    """Users of two clicks and two views each; users of an even place click high."""
    rows = []
    for n, u in enumerate(USERS):
        high = 60.0 if n % 2 == 0 else 10.0
        for i, (kind, v) in enumerate([("view", 1.0), ("click", high), ("click", high + 10), ("view", 3.0)]):
            rows.append((len(rows), u, kind, v, START + dt.timedelta(seconds=10 * n + i)))
    d = tmp_path_factory.mktemp("events")
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, ts timestamp").write.parquet(f"file://{d}/events.parquet")
    return f"file://{d}"


def test_checks_of_every_user(spark, events_dir):
    got = {r.check_id: (r.status, r.actual) for r in QUERIES["threshold_checks"](spark, events_dir).collect()}
    assert got == {f"threshold_{u}": ("passed", 65.0) if n % 2 == 0 else ("failed", 15.0) for n, u in enumerate(USERS)}
    got = {r.check_id: r.actual for r in QUERIES["tracks_setpoint"](spark, events_dir).collect()}
    assert got == {f"tracks_setpoint_{u}": round(70 - (1 + 2 * 2 / 3), 6) if n % 2 == 0 else round(20 - (1 + 2 * 2 / 3), 6) for n, u in enumerate(USERS)}


@pytest.mark.parametrize("name", ["threshold_outside", "transition_checks", "no_transition_checks", "state_equals_any_all", "state_not_equals_checks", "diverges_from_setpoint", "monotonic_delta", "same_direction", "tracks_parameter", "derived_expression_check"])
def test_a_check_for_each_user(spark, events_dir, name):
    ids = sorted(int(r.check_id.rsplit("_", 1)[1]) for r in QUERIES[name](spark, events_dir).collect())
    assert ids == USERS


def test_verdicts_of_every_user(spark, events_dir):
    got = {int(r.mechanism): r.verdict for r in QUERIES["verification_pipeline"](spark, events_dir).collect()}
    assert got == {u: "supported" if n % 2 == 0 else "mixed" for n, u in enumerate(USERS)}


@pytest.fixture(scope="module")
def tables_dir(spark, tmp_path_factory, events_dir):
    """Ids on both sides of the former cuts."""
    d = f"file://{tmp_path_factory.mktemp('tables')}"
    for name, schema, rows in [
        ("customer", "c_custkey long, c_nationkey long, c_name string", [(1, 0, "a"), (199, 1, "b"), (200, 1, "c"), (9000, 0, "d")]),
        ("supplier", "s_suppkey long, s_nationkey long", [(1, 0), (59, 1), (60, 1), (75, 0)]),
        ("nation", "n_nationkey long, n_regionkey long", [(0, 0), (1, 1)]),
        ("lineitem", "l_orderkey long, l_partkey long, l_returnflag string", [(7, 1, "N"), (7, 2, "N"), (900, 1, "R"), (900, 3, "N"), (901, 2, "N"), (902, 4, "R")]),
        ("events", "event_id long, user_id long, event_type string, value double, ts timestamp", [(i, u, k, 1.0, START) for i, u, k in [(1, 1, "click"), (700, 1, "view"), (701, 2, "click"), (702, 2, "error"), (49, 3, "click"), (50, 3, "click")]]),
    ]:
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    return d


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("reachability_closure", {(f"c{c}", n, k) for c, g in [(1, 0), (199, 1), (200, 1), (9000, 0)] for n, k in [(f"c{c}", 0), (f"n{g}", 1), (f"r{g}", 2)]}),
        ("leaf_dependencies", {("c1", "r0"), ("c199", "r1"), ("c200", "r1"), ("c9000", "r0")}),
        ("source_survey", {(7, 1, 0, 1), (7, 2, 0, 1), (900, 1, 1, 1), (900, 3, 1, 1)}),  # order 900 consumes what 7 writes
        ("only_matches", {(3, 900), (4, 902)}),  # parts 1 and 2 are in two orders each
        ("renamed_fields", {(1, "click", 1), (1, "view", 1), (2, "view", 1), (2, "fault", 1), (3, "view", 1)}),  # log 1 has a view of its own, later
        ("actuator_mapping", {(1, "0", "1"), (59, "1", None), (60, "1", None), (75, "0", None), (39, None, "199"), (40, None, "200,9000")}),
        ("warnings_with_dropouts", {("dropout of 1 ms", 2), ("dropout of 2 ms", 2), ("dropout of 3 ms", 2), ("error", 1)}),
    ],
)
def test_rows_beyond_former_cuts(spark, tables_dir, name, want):
    assert {tuple(r) for r in QUERIES[name](spark, tables_dir).collect()} == want


def test_directions_of_one_signal_alone_are_unresolved(spark, tmp_path):
    """A user of one click and of views that hardly change: the change of clicks isn't known."""
    rows = [(i, 7, kind, v, START + dt.timedelta(seconds=i)) for i, (kind, v) in enumerate([("view", 1.0), ("click", 5.0), ("view", 1.5)])]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, ts timestamp").write.parquet(f"file://{tmp_path}/events.parquet")
    got = [tuple(r) for r in QUERIES["same_direction"](spark, f"file://{tmp_path}").collect()]
    assert got == [("same_direction_change_7", "unresolved", None)]


def test_matches_keep_no_list_of_inputs(spark, tables_dir):
    plan = QUERIES["only_matches"](spark, tables_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "count(distinct" not in plan
