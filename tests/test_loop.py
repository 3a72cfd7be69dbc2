"""Golden runs, invariants, no look-ahead, and the streaming form."""

import pytest
from pyspark.sql import functions as F

from thermolith.config import SCENARIO_TABLE, Condition, Facility
from thermolith.errors import TimeAlignmentError
from thermolith.operators import metrics, records
from thermolith.operators import windows as W
from thermolith.plans import loop
from thermolith.sources import signals as S
from thermolith.streaming import loop as live

# Published cost and carbon of the three controllers on the standard day.
GOLDEN = {"baseline": (2421.4561, 2189.4853), "heuristic": (2364.9363, 2168.3593), "finite_horizon": (2332.7363, 2125.1807)}
FAC = Facility()


@pytest.fixture(scope="module")
def golden(spark):
    day = S.generate(spark).withColumn("center", F.lit(1))
    runs = loop.runs_of(day, "center", [(n, d) for n, d, _ in SCENARIO_TABLE], ["ideal"], FAC)
    rec = records.records(loop.simulate(runs, FAC), FAC).cache()
    met = metrics.wide(rec, FAC).join(rec.select("run_id", "controller").distinct(), "run_id").toPandas().set_index("controller")
    return rec, met


@pytest.mark.parametrize("name", sorted(GOLDEN))
def test_golden(golden, name):
    row = golden[1].loc[name]
    assert round(row["energy_cost"], 4) == GOLDEN[name][0]
    assert round(row["carbon_kg"], 4) == GOLDEN[name][1]
    assert row["temperature_violation_count"] == row["thermal_infeasibility_count"] == row["invalid_value_count"] == 0
    assert max(row["max_abs_power_balance_error"], row["max_abs_renewable_balance_error"]) <= 1e-9


def test_shape(golden):
    rec, met = golden
    assert rec.count() == 288
    assert len([c for c in rec.columns if c not in ("run_id", "step_index", "center", "controller", "condition")]) == 90
    assert len([c for c in met.columns if c != "run_id"]) == 66


def day_inputs(spark, **columns):
    d = S.generate(spark).withColumn("run_id", F.lit(1).cast("long")).withColumn("workload_fraction", F.col("online_workload") + F.col("batch_workload"))
    for k, v in columns.items():
        d = d.withColumn(k, v)
    return d


def test_no_look_ahead_past_the_horizon(spark):
    base = day_inputs(spark, controller=F.lit("finite_horizon"), condition=F.lit("ideal"))
    other = base.withColumn("electricity_price", F.when(F.col("step_index") > 8, F.lit(9.0)).otherwise(F.col("electricity_price")))
    first = [loop.simulate(x, FAC).where("step_index <= 0").first()["proposed_cooling_kw"] for x in (base, other)]
    assert first[0] == first[1]


def test_external_action_and_ramp(spark):
    c = {"slow": Condition("slow", "rate_limited", ramp_up_kw=30.0, ramp_down_kw=50.0)}
    out = loop.simulate(day_inputs(spark, controller=F.lit("external"), condition=F.lit("slow"), action=F.lit(150.0)), FAC, c).orderBy("step_index").toPandas()
    assert out["applied_cooling_kw"].diff().max() <= 30.0 + 1e-9
    assert out["target_c"].isna().all()


def test_own_controller(spark):
    import numpy as np

    def steady(lp, state, x, window):
        assert window["price"].shape[1] <= lp.f.horizon_steps
        return np.full(len(state.true), 90.0), np.full(len(state.true), 23.0), np.full(len(state.true), lp.f.min_temp_c)

    out = loop.simulate(day_inputs(spark, controller=F.lit("steady"), condition=F.lit("ideal")), FAC, controllers={"steady": steady}).toPandas()
    assert (out["proposed_cooling_kw"] == 90.0).all() and (out["target_c"] == 23.0).all()


def test_gap_is_an_error(spark):
    broken = day_inputs(spark, controller=F.lit("baseline"), condition=F.lit("ideal")).where("step_index <> 5")
    with pytest.raises(Exception, match=TimeAlignmentError.__name__):
        loop.simulate(broken, FAC).count()


def rows_for_stream(spark, controller, cond):
    d = W.precool_flag(day_inputs(spark), "run_id", FAC).select("*", F.col("timestamp").alias("at"), *[F.col(v).alias(k) for k, v in loop.INPUT.items()])
    d = W.forecast(d, "run_id", FAC.horizon_steps, ["at", "load", "price", "ci", "outdoor", "renewable"])
    return d.select("run_id", F.lit(controller).alias("controller"), F.lit(cond).alias("condition"), "at", "load", "price", "ci", "outdoor", "renewable", "precool", F.lit(None).cast("double").alias("action"), "forecast")


def test_stream_equals_batch_over_two_batches_and_rejects_late_rows(spark, tmp_path):
    rows = rows_for_stream(spark, "heuristic", "combined_nonideal").cache()
    cut = rows.orderBy("at").limit(40).agg(F.max("at")).first()[0]
    late = rows.where(F.col("at") == cut)
    rows.where("false").write.parquet(f"{tmp_path}/in")
    stream = live.simulate(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), FAC)

    def feed(part):
        part.write.mode("append").parquet(f"{tmp_path}/in")
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()

    feed(rows.where(F.col("at") <= cut))
    feed(rows.where(F.col("at") > cut).unionByName(late))
    out = spark.read.schema(live.OUT).parquet(f"{tmp_path}/out").toPandas()
    assert out["error"].notna().sum() == 1
    good = out[out["error"].isna()].sort_values("step_index")
    batch = loop.simulate(day_inputs(spark, controller=F.lit("heuristic"), condition=F.lit("combined_nonideal")), FAC).orderBy("step_index").toPandas()
    assert len(good) == 96
    assert abs(good["true_temperature_c"].to_numpy() - batch["true_temperature_c"].to_numpy()).max() < 1e-12
