"""SQL text with bound arguments, and the physics as SQL functions."""

import pytest
from pyspark.sql import functions as F

from thermolith.config import Condition, Facility
from thermolith.functions import physics as P
from thermolith.operators import sqltext
from thermolith.operators.store import RunStore

FAC = Facility()


@pytest.fixture(scope="module")
def runs(spark):
    rows = [(1, "a", 1, "baseline", None), (2, "a", 1, "heuristic", "ideal"), (3, "a", 1, "finite_horizon", "ideal"), (4, "a", 1, "baseline", "noisy"), (5, "b", 1, "finite_horizon", None), (6, "a", 1, "heuristic", "ideal"), (7, "a", 1, "it's", None)]
    sqltext.views(spark, experiment_runs=spark.createDataFrame(rows, "id long, name string, dataset_id long, scenario string, condition_name string"))
    sqltext.views(spark, run_metrics=spark.createDataFrame([(1, "x", 1.0), (1, "y", 2.0), (2, "x", 3.0)], "run_id long, metric string, value double"))


def test_lists_and_nulls(spark, runs):
    ask = lambda text, **a: sorted(map(tuple, sqltext.ask(spark, text, **a).collect()), key=str)
    got = ask(sqltext.COMPARABLE_RUNS, anchor="finite_horizon", condition="ideal", scenarios=["baseline", "heuristic"])
    assert got == [("a", 1, 3, "baseline", 1), ("a", 1, 3, "heuristic", 2)]
    assert ask(sqltext.COMPARABLE_RUNS, anchor="finite_horizon", condition="ideal", scenarios=[]) == []
    assert ask(sqltext.RUN_METRICS, first=1, last=1, metrics=None) == [(1, "x", 1.0), (1, "y", 2.0)]
    assert ask(sqltext.RUN_METRICS, first=1, last=2, metrics=["x"]) == [(1, "x", 1.0), (2, "x", 3.0)]
    assert ask(sqltext.RUNS_UNDER, condition=None) == [("it's", 1, 7), ("baseline", 1, 1), ("finite_horizon", 1, 5)]
    assert ask(sqltext.RUNS_UNDER, condition="x' OR '1' = '1") == []


def test_functions_are_the_columns(spark):
    assert set(sqltext.register(spark)) == set(sqltext.functions_of(FAC))
    d = spark.range(400).select(*[((F.xxhash64("id", F.lit(k)) % 1000) * s + o).cast("double").alias(n) for k, (n, (s, o)) in enumerate({"temp": (0.01, 25), "heat": (0.2, 150), "outdoor": (0.02, 15), "q": (0.4, 100), "load": (0.001, 0.5)}.items())])
    c = Condition("m", model_capacity_scale=1.1, model_heat_scale=0.9, model_cooling_scale=1.2)
    x = {n: F.col(n) for n in d.columns}
    least, most = P.bounds(x["temp"], x["heat"], x["outdoor"], FAC, 20.5)
    m_least, m_most = P.model_bounds(x["temp"], x["heat"], x["outdoor"], FAC, c, 20.5, 32.0)
    pairs = {
        "it_power(load)": P.it_power(x["load"], FAC), "cooling_cop(outdoor)": P.cop(x["outdoor"], FAC), "cooling_power(q, outdoor)": P.cooling_power(x["q"], x["outdoor"], FAC),
        "renewable_used(q, heat)": P.renewable_used(x["q"], x["heat"]), "renewable_curtailed(q, heat)": P.renewable_curtailed(x["q"], x["heat"]), "energy_cost(heat, load)": P.energy_cost(x["heat"], x["load"], FAC),
        "carbon_mass(heat, load)": P.carbon_kg(x["heat"], x["load"], FAC), "next_temperature(temp, heat, q, outdoor)": P.next_temperature(x["temp"], x["heat"], x["q"], x["outdoor"], FAC),
        "next_temperature(temp, heat, q, outdoor, 1.1, 0.9, 1.2)": P.predicted_temperature(x["temp"], x["heat"], x["q"], x["outdoor"], FAC, c), "least_cooling(temp, heat, outdoor)": least,
        "most_cooling(temp, heat, outdoor, low => 20.5)": most, "least_cooling(temp, heat, outdoor, 1.1, 0.9, 1.2)": m_least, "most_cooling(temp, heat, outdoor, 1.1, 0.9, 1.2, 20.5)": m_most,
        "safe_cooling(q, least_cooling(temp, heat, outdoor), most_cooling(temp, heat, outdoor, low => 20.5))": P.safe_action(x["q"], least, most, FAC),
    }
    sqltext.views(spark, states=d.select("*", *[v.alias(f"w{i}") for i, v in enumerate(pairs.values())]))
    worst = spark.sql("SELECT " + ", ".join(f"max(abs({call} - w{i})) AS d{i}" for i, call in enumerate(pairs)) + ", count(*) AS n FROM states").first()
    assert worst["n"] == 400 and max(worst[f"d{i}"] for i in range(len(pairs))) < 1e-9
    plan = spark.sql("SELECT cooling_power(q, outdoor) AS x FROM states")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "greatest" in plan


def test_a_store_is_asked(spark, tmp_path):
    store = RunStore(spark, str(tmp_path)).initialize()
    first, second = (store.create_run("a", n, 1, condition=c) for n, c in (("baseline", "ideal"), ("finite_horizon", None)))
    store.finish_run(first, spark.createDataFrame([("x", 1.0)], "metric string, value double"))
    assert [tuple(r) for r in store.ask(sqltext.RUN_METRICS, first=first, last=second, metrics=["x", "y"]).collect()] == [(first, "x", 1.0)]
    assert [r["run_id"] for r in store.ask(sqltext.COMPARABLE_RUNS, anchor="finite_horizon", condition="ideal", scenarios=["baseline"]).collect()] == [first]
    store.fail_run(second, "stopped")
    assert store.ask("SELECT count(*) AS n FROM experiment_runs WHERE status = :status", status="failed").first()["n"] == 1
