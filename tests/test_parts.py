"""Configuration, sources, actuators, store."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermolith import config as C
from thermolith.errors import ConfigurationError, InputValidationError, RunStateError, StorageError
from thermolith.operators import reports
from thermolith.operators.store import NullStore, RunStore, legacy_results, widened
from thermolith.operators.windows import increasing
from thermolith.plans.kernel import Loop, State
from thermolith.sources import signals as S


def state(applied, queue=()):
    a = lambda v: np.array([float(v)])
    return State(a(24), a(24), a(applied), np.array([list(queue)], float).reshape(1, -1), a(0), np.zeros((1, 0)))


def moved(mode, target, applied, queue=(), **more):
    lp = Loop(C.Facility(), C.Condition("x", mode, **more), "baseline")
    s = state(applied, queue)
    now, q, up, down = lp.move(np.array([float(target)]), s.applied, s.queue)
    return float(now[0]), q, bool(up[0]), bool(down[0])


def test_actuators():
    assert moved("ideal", 150, 0)[0] == 150
    assert moved("rate_limited", 250, 100, ramp_up_kw=30.0, ramp_down_kw=50.0)[::2] == (130.0, True)
    assert moved("rate_limited", 0, 130, ramp_up_kw=30.0, ramp_down_kw=50.0)[0] == 80.0
    one = moved("first_order", 200, 0)[0]
    two = moved("first_order", 200, one)[0]
    assert 0 < one < two < 200
    now, queue, *_ = moved("delayed", 120, 0, (0.0,))
    assert now == 0 and moved("delayed", 60, 0, queue[0])[0] == 120


def test_unreachable_bounds():
    lp = Loop(C.Facility(), C.Condition("x", "rate_limited", ramp_up_kw=30.0, ramp_down_kw=50.0), "baseline")
    _, none = lp.aware_target(np.array([0.0]), state(0), np.array([200.0]), np.array([280.0]))
    assert none[0]


def test_config_round_trip_and_rules():
    f = C.facility()
    assert C.facility(C.to_mapping(f)) == f
    for bad in ({"min_temp_c": 40.0}, {"low_price": 0.9}, {"horizon_steps": 0}, {"precool_floor_c": 10.0}):
        with pytest.raises(ConfigurationError):
            C.replace(f, **bad).validated()
    with pytest.raises(ConfigurationError):
        C.facility({"datacenter": {}})
    with pytest.raises(ConfigurationError):
        C.condition("unknown")
    with pytest.raises(ConfigurationError):
        C.Condition(actuator="delayed", delay_steps=0).validated()


def test_simple_files():
    text = "# c\na:\n  b: 1\n  c: 0.5\n  d: true\n  e: 'x: y'\nf: 2026-01-01T00:00:00\n"
    assert C.read_simple(text) == {"a": {"b": 1, "c": 0.5, "d": True, "e": "x: y"}, "f": "2026-01-01T00:00:00"}


@pytest.mark.parametrize("text,want", [
    ("a:\n      b: 1\n   c: 2\nd: 3", {"a": {"b": 1, "c": 2}, "d": 3}), ("a: 1\n    b: 2", {"a": 1, "b": 2}), ("  # x\n\n  a:\n    b:\n      c: -1.5e3\n  d: +7", {"a": {"b": {"c": -1500.0}}, "d": 7}),
    ("a: \"1\"\nb: 'true'\nc: TRUE\nd: hello\ne: 1.2.3\nf: .5\ng: 5.", {"a": "1", "b": "true", "c": True, "d": "hello", "e": "1.2.3", "f": 0.5, "g": 5.0}), ("a:\nb:\n", {"a": {}, "b": {}}), ("", {}), ("a : x # y\n", {"a": "x # y"}),
])
def test_odd_simple_files(text, want):
    assert C.read_simple(text) == want


def test_a_line_without_a_colon():
    with pytest.raises(ConfigurationError, match="no colon in: b"):
        C.read_simple("a: 1\n  b\n")


def test_conditions_and_scenarios_from_mappings():
    own = {
        "actuators": {"slow": {"mode": "rate_limited", "max_ramp_up_kw_per_step": 30}}, "mismatch_scenarios": {"m": {"thermal_capacity_scale": 1.1}}, "measurements": {"n": {"mode": "gaussian", "temperature_noise_std_c": 0.1, "seed": 5}},
        "conditions": {"x": {"actuator": "slow", "mismatch": "m", "measurement": "n"}},
    }
    c = C.conditions(own)["x"]
    assert (c.actuator, c.ramp_up_kw, c.capacity_scale, c.measurement, c.noise_seed) == ("rate_limited", 30.0, 1.1, "gaussian", 5)
    with pytest.raises(ConfigurationError):
        C.conditions(own | {"measurements": {}})
    assert C.scenarios({}) == C.SCENARIO_TABLE and C.scenarios({"scenarios": {"s": {"dispatch_strategy": "immediate", "cooling_strategy": "finite_horizon"}}}) == [("finite_horizon", "immediate", 8)]
    with pytest.raises(ConfigurationError):
        C.scenarios({"scenarios": {"s": {"dispatch_strategy": "immediate", "cooling_strategy": "?"}}})
    f = C.Facility()
    assert C.thawed(f, beam_width=3).beam_width == 3 and f.beam_width == 24


def test_csv_round_trip_and_legacy(spark, tmp_path):
    day = S.generate(spark)
    S.write_csv(day.drop("step_index"), f"{tmp_path}/a")
    back, tag = S.read_csv(spark, f"{tmp_path}/a")
    assert tag == "csv" and back.count() == 96
    S.write_csv(S.legacy(day.drop("step_index")), f"{tmp_path}/b")
    old, tag = S.read_csv(spark, f"{tmp_path}/b")
    assert tag == "csv:legacy-normalized"
    joined = back.alias("x").join(old.alias("y"), "timestamp").select(F.max(F.abs(F.col("x.renewable_power_kw") - F.col("y.renewable_power_kw")))).first()[0]
    assert joined < 1e-9
    assert back.agg(F.min("timestamp").cast("string")).first()[0] == "2025-12-31 16:00:00"


def test_generator_is_reproducible(spark):
    a, b = (S.generate(spark, renewable_enabled=on).orderBy("step_index").toPandas() for on in (True, False))
    assert a["online_workload"].equals(b["online_workload"]) and b["renewable_power_kw"].max() == 0
    assert round(a["renewable_power_kw"].max(), 6) == 320


def test_validation(spark):
    day = S.generate(spark).withColumn("dataset_id", F.lit(1))
    S.validated(day)
    for bad in (day.where("step_index <> 7"), day.withColumn("renewable_power_kw", F.lit(-1.0)), day.withColumn("electricity_price", F.lit(float("nan"))), day.where("false"), day.unionByName(day.limit(1))):
        with pytest.raises(InputValidationError):
            S.validated(bad)
    with pytest.raises(InputValidationError):
        S.normalized(day)


def test_increasing(spark):
    rows = [([1, 2, 3],), ([1, 1],), ([5],), ([],)]
    got = spark.createDataFrame(rows, "t array<int>").select(increasing(F.col("t"))).collect()
    assert [r[0] for r in got] == [True, False, True, True]


def test_store(spark, tmp_path):
    store = RunStore(spark, f"file://{tmp_path}/store")
    with pytest.raises(StorageError):
        store.create_run("r", "baseline", 1)
    store.initialize().initialize()
    day = S.generate(spark)
    first = store.upsert_dataset("day", day)
    assert store.upsert_dataset("day", day.limit(2)) == first and store.datasets().count() == 1
    assert store.read("input_timeseries").count() == 2
    rows = day.select("step_index", F.lit(21.0).alias("temp_c"))
    metric = spark.createDataFrame([("energy_cost", 1.0)], "metric string, value double")
    good, bad = store.create_run("r", "baseline", first), store.create_run("r", "heuristic", first)
    assert (good, bad) == (1, 2)
    for run in (good, bad):
        store.append_inputs(run, day)
        store.append_steps(run, rows)
    store.finish_run(good, metric)
    store.fail_run(bad, ValueError("no"))
    assert {r["id"]: r["status"] for r in store.runs().collect()} == {1: "completed", 2: "failed"}
    assert store.read("simulation_results").groupBy("run_id").count().collect()[0]["count"] == 96
    with pytest.raises(RunStateError):
        store.append_steps(good, rows)
    store.upsert_metrics(good, spark.createDataFrame([("energy_cost", 2.0)], "metric string, value double"))
    assert [r["value"] for r in store.metrics().collect()] == [2.0]


def test_two_writers_and_a_second_process(spark, tmp_path):
    one, two = (RunStore(spark, f"file://{tmp_path}/s") for _ in range(2))
    with one, two:
        two.bind_config(C.Facility())
        ids = [w.create_run("r", "baseline", 1) for w in (one, two, one)]
        assert sorted(ids) == [1, 2, 3] and one._claim("experiment_runs-id", 0) == 4
        one.append_steps(1, spark.range(3).select(F.col("id").cast("int").alias("step_index"), F.lit(1.0).alias("temp_c")))
        two.finish_run(1, spark.createDataFrame([("m", 1.0)], "metric string, value double"))
        assert one.runs().where("id = 1").first()["status"] == "completed" and one.read("simulation_results").count() == 3
        assert "beam_width" in one.runs().where("id = 2").first()["config"]
    with pytest.raises(StorageError):
        one.runs()


def test_a_whole_older_store_is_taken_over(spark, tmp_path):
    old = {
        "experiment_runs": spark.createDataFrame([(4, "r", "optimized", 1, 7, "{}", "abc")], "id long, name string, scenario string, dataset_id long, seed long, config string, git_commit string"),
        "simulation_results": spark.createDataFrame([(4, 0, 21.5)], "run_id long, step_index int, temp_c double"), "run_metrics": spark.createDataFrame([(4, "energy_cost", 2.5)], "run_id long, metric string, value double"),
    }
    store = RunStore(spark, f"file://{tmp_path}/new")
    assert store.migrate(old) == {"experiment_runs": 1, "simulation_results": 1, "run_metrics": 1}
    r = store.runs().first()
    assert (r["status"], r["controller_name"], r["condition_name"], r["seed"]) == ("completed", "optimized", None, 7)
    row = store.read("simulation_results").first()
    assert (row["temp_c"], row["applied_cooling_kw"], row["fallback_reason"]) == (21.5, 0.0, "") and store.metrics().first()["value"] == 2.5
    assert store.create_run("r", "baseline", 1) == 5
    with pytest.raises(StorageError):
        store.migrate(old)


def test_prepared_signals(spark, tmp_path):
    path = f"file://{tmp_path}/day"
    first = S.prepared(spark, path, renewable_enabled=False)
    assert first.count() == 96 and first.agg(F.max("renewable_power_kw")).first()[0] == 0
    assert S.prepared(spark, path, regenerate=False).agg(F.max("renewable_power_kw")).first()[0] == 0
    assert S.prepared(spark, path).agg(F.max("renewable_power_kw")).first()[0] > 300


def test_events_outside_the_grid_are_counted(spark):
    rows = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ'2024-01-01 00:00:00', 'view', 1.0D), (TIMESTAMP_NTZ'2024-02-05 00:00:00', 'view', 1.0D), (NULL, 'view', 1.0D) AS t(ts, event_type, value)")
    assert S.outside_grid(rows) == 2 and S.from_events(rows).count() == 2880


def test_a_span_leaves_no_event_out(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    moved = events.withColumn("ts", F.when(F.col("event_id") % 5 == 0, F.timestamp_add("DAY", F.lit(400), F.col("ts"))).when(F.col("event_id") % 7 == 0, None).otherwise(F.col("ts")))
    span = S.span_of(moved)
    assert S.outside_grid(moved, **span) == moved.where("ts IS NULL").count() and S.outside_grid(moved) > S.outside_grid(moved, **span)
    day = S.from_events(moved, **span)
    assert day.count() == span["days"] * S.SLOTS and day.agg(F.max("online_workload")).first()[0] == 0.82
    with pytest.raises(InputValidationError):
        S.span_of(events.where("false"))


def test_services_must_fit_the_signals(spark):
    from thermolith.errors import InputValidationError as Wrong
    from thermolith.operators import dispatch

    day = S.generate(spark).withColumn("center", F.lit(1))
    service = day.select("center", "step_index", (F.col("batch_workload") * 2).alias("batch_service"))
    own = dispatch.workload(dispatch.with_service(day, service, "center"), "center")
    assert own.count() == 96 and own.agg(F.max(F.abs(F.col("workload_fraction") - F.col("online_workload") - F.col("batch_workload")))).first()[0] < 1e-9
    for bad in (service.where("step_index > 3"), service.unionByName(service.limit(1).withColumn("step_index", F.lit(200)))):
        with pytest.raises(Wrong):
            dispatch.with_service(day, bad, "center")


def test_a_year_is_dispatched_in_linear_time(spark):
    import time

    year = spark.range(35_040).select(F.lit(1).alias("center"), F.col("id").cast("int").alias("step_index"), (F.lit(0.4) + 0.3 * F.sin("id")).alias("online_workload"), F.lit(0.2).alias("batch_workload"), (F.lit(0.6) + 0.4 * F.cos(F.col("id") / 9)).alias("electricity_price"))
    begin = time.perf_counter()
    from thermolith.operators import dispatch

    out = dispatch.dispatched(year, "center", "price_aware_temporal_shift", C.Facility()).agg(F.count("*"), F.sum("batch_service")).first()
    assert out[0] == 35_040 and 0 < out[1] <= 0.2 * 35_040 + 1e-6
    assert time.perf_counter() - begin < 20


def test_one_loop_and_one_shuffle_a_run(spark, folder):
    from thermolith import queries as Q

    plan = Q.run_metrics_wide(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1  # the loop
    plan = Q.loop_baseline(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange hashpartitioning(run_id") == 1


def test_null_store(spark):
    store = NullStore().initialize()
    run = store.create_run()
    store.append_steps(run, spark.range(3))
    store.finish_run(run)
    with pytest.raises(RunStateError):
        store.fail_run(run, "late")


def test_legacy_defaults_and_widening(spark):
    old = spark.createDataFrame([(1, 5.0, 3.0)], "run_id long, renewable_available_kw double, renewable_used_kw double")
    row = legacy_results(old, ["run_id", "renewable_curtailed_kw", "fallback_reason", "temp_c"]).first()
    assert tuple(row) == (1, 2.0, "", 0.0)
    assert widened(old, "run_id long, status string", {"status": "completed"}).first()["status"] == "completed"


def test_report_text(spark):
    df = spark.createDataFrame([("cost", 1.5), ("carbon", None)], "name string, value double")
    lines = [r[0] for r in reports.fixed_width(df, [("name", 8), ("value", 10)]).collect()]
    assert lines == ["cost        1.5000", "carbon     missing"]


def test_sqlite_source(spark, tmp_path):
    import sqlite3

    from thermolith.sources import sqlite

    path = str(tmp_path / "old.sqlite")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE run_metrics (run_id INTEGER, metric TEXT, value REAL)")
        c.executemany("INSERT INTO run_metrics VALUES (?, ?, ?)", [(i % 3, f"m{i}", i / 2 if i % 5 else None) for i in range(50)])
    sqlite.register(spark)
    df = spark.read.format("thermolith_sqlite").option("path", path).option("table", "run_metrics").load()
    assert [d for _, d in df.dtypes] == ["bigint", "string", "double"]
    assert df.count() == 50 and df.where("value IS NULL").count() == 10 and df.agg(F.sum("value")).first()[0] == sum(i / 2 for i in range(50) if i % 5)
