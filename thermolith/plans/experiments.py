"""Experiments from end to end: signals, dispatch, loop, records, metrics, store, reports.

All runs of an experiment are one job; the store gets each run's steps as a partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CONDITION_TABLE, SCENARIO_TABLE, Facility
from ..operators import metrics, records, reports
from ..operators import windows as W
from ..operators.store import RunStore, git_commit
from ..sources import signals as S
from . import loop

#: Metrics that the comparison shows, in order.
SHOWN = ("energy_cost", "carbon_kg", "total_grid_energy_kwh", "cooling_energy_kwh", "renewable_utilization_rate", "peak_grid_power_kw", "average_temperature_c", "temperature_violation_count", "thermal_infeasibility_count")


def run(store: RunStore, signals: DataFrame, name: str, conditions: list[str], f: Facility | None = None, scenarios=SCENARIO_TABLE, dataset: str = "day", seed: int = 42, root: str = ".") -> list[int]:
    """Runs every scenario under every condition over one series and stores the runs; their ids."""
    f = (f or Facility()).validated()
    dataset_id = store.upsert_dataset(dataset, signals.drop("step_index"), "generated", f.step_minutes)
    series = signals.withColumn("center", F.lit(0))
    rec = records.records(loop.simulate(loop.runs_of(series, "center", [(n, d) for n, d, _ in scenarios], conditions, f), f), f)
    rec = rec.persist()
    keys = [{"run_id": i * len(conditions) + k, "controller": n, "condition": c} for i, (n, *_) in enumerate(scenarios) for k, c in enumerate(conditions)]  # as loop.runs_of numbers the one series
    commit = git_commit(root)
    ids = store.create_runs([{"name": name, "scenario": k["controller"], "dataset_id": dataset_id, "controller_name": k["controller"], "condition_name": k["condition"], "seed": seed, "config": f.snapshot(), "git_commit": commit} for k in keys])
    try:
        own = F.element_at(F.create_map(*[F.lit(x) for k, i in zip(keys, ids) for x in (k["run_id"], i)]), F.col("run_id"))
        store.append_steps_of(ids, rec.withColumn("run_id", own))
        store.finish_runs(ids, metrics.long(metrics.wide(rec, f)).withColumn("run_id", own))
    except Exception as error:
        store.fail_runs(ids, error)
        raise
    finally:
        rec.unpersist()
    return ids


def mini(spark: SparkSession, path: str, f: Facility | None = None) -> DataFrame:
    """The smallest experiment: every scenario over the standard day, the records of all in one CSV, and a summary of each."""
    f = (f or Facility()).validated()
    day = S.prepared(spark, f"{path}/signals").withColumn("center", F.lit(0))
    rec = records.records(loop.simulate(loop.runs_of(day, "center", [(n, d) for n, d, _ in SCENARIO_TABLE], ["ideal"], f), f), f)
    S.write_csv(rec.withColumn("scenario", F.col("controller")), f"{path}/results")
    back = spark.read.option("header", True).csv(f"{path}/results")
    return back.groupBy("scenario").agg(
        F.sum(F.col("grid_energy_kwh").cast("double")).alias("energy_kwh"), F.sum(F.col("energy_cost_step").cast("double")).alias("cost"), F.sum(F.col("carbon_kg_step").cast("double")).alias("carbon_kg")
    ).orderBy("scenario")


def single_center(spark: SparkSession, folder: str) -> list[int]:
    return run(RunStore(spark, folder).initialize(), S.generate(spark), "single_center", ["ideal"])


def robustness(spark: SparkSession, folder: str, conditions: list[str] | None = None) -> list[int]:
    return run(RunStore(spark, folder).initialize(), S.generate(spark), "single_center_robustness", conditions or [c[0] for c in CONDITION_TABLE])


def comparable_runs(store: RunStore, anchor: str = "finite_horizon") -> DataFrame:
    """The newest completed run of ``anchor``, and of each other scenario the latest one of the
    same name and dataset that is no newer; runs under other conditions than ideal don't count.
    ``optimized`` is an older name of heuristic. Runs that failed or still run don't count either: they have no metrics to compare."""
    r = store.runs().where("status = 'completed' AND (condition_name IS NULL OR condition_name = 'ideal')")
    r = r.withColumn("scenario", F.when(F.col("scenario") == "optimized", "heuristic").otherwise(F.col("scenario"))).select("id", "name", "dataset_id", "scenario")
    newest = r.where(F.col("scenario") == anchor).orderBy(F.col("id").desc()).limit(1)
    wanted = newest.drop("scenario").crossJoin(F.broadcast(r.sparkSession.createDataFrame([(s[0],) for s in SCENARIO_TABLE], "scenario string")))
    return W.comparable(wanted, r, ["name", "dataset_id", "scenario"], name="run_id")


def compare(store: RunStore) -> tuple[DataFrame, DataFrame]:
    """(metric by scenario with changes, PASS or FAIL) of the comparable runs."""
    chosen = comparable_runs(store).select("run_id", F.col("scenario").alias("controller"), F.lit(1).alias("center"))
    rows = store.metrics().join(chosen, "run_id")
    return reports.comparison(rows.where(F.col("metric").isin(*SHOWN))), reports.acceptance(rows)


def compare_lines(store: RunStore) -> DataFrame:
    """The comparison as text: the table, then the conclusions."""
    chosen = comparable_runs(store).select("run_id", F.col("scenario").alias("controller"), F.lit(1).alias("center"))
    return reports.comparison_lines(store.metrics().join(chosen, "run_id")).orderBy("line_no").select("line")


def _results(store: RunStore, runs: DataFrame) -> DataFrame:
    """The steps of a few runs (run_id, scenario)."""
    return store.read("simulation_results").join(F.broadcast(runs), "run_id")  # one run a scenario


def coordination(store: RunStore) -> DataFrame:
    """What each scenario does in the key windows of the signals."""
    chosen = comparable_runs(store).select("run_id", "scenario")
    steps = _results(store, chosen).withColumn("center", F.lit(1))
    base = steps.where("scenario = 'baseline'")
    parts = [W.highest_window(base, "center", c).withColumn("signal", F.lit(c)).drop("mean") for c in ("electricity_price", "carbon_intensity_kg_per_kwh", "outdoor_temperature_c", "renewable_available_kw")]
    windows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return W.window_sums(steps, windows, "center").orderBy("signal", "scenario")


def thermal(store: RunStore) -> tuple[DataFrame, DataFrame]:
    """(first steps, summary) of the latest run of each scenario."""
    latest = store.runs().groupBy("scenario").agg(F.max("id").alias("run_id"))
    steps = _results(store, latest)
    return reports.head(steps, "scenario", ["temp_c", "temp_min_c", "temp_max_c", "cooling_kw"]).orderBy("scenario", "step_index"), reports.thermal(steps, "scenario").orderBy("scenario")


def events(store: RunStore, controller: str = "finite_horizon", condition_name: str = "combined_nonideal") -> DataFrame:
    """The extreme steps of the latest robustness run of a controller under a condition."""
    r = store.runs().where((F.col("name") == "single_center_robustness") & (F.col("controller_name") == controller) & (F.col("condition_name") == condition_name))
    return reports.events(_results(store, r.agg(F.max("id").alias("run_id"))), "run_id")


def degradation(store: RunStore) -> DataFrame:
    """The latest run of each controller and condition against its ideal one."""
    r = W.latest(store.runs().where("status = 'completed' AND name = 'single_center_robustness'"), ["controller_name", "condition_name"])
    keyed = r.select(F.col("id").alias("run_id"), F.col("controller_name").alias("controller"), F.col("condition_name").alias("condition"), F.lit(1).alias("center"))
    return reports.degradation_matrix(store.metrics().join(keyed, "run_id").drop("run_id"), list(SHOWN))


def inspect(store: RunStore, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """(last runs with dataset names, health of each)."""
    last = reports.latest_runs(store.runs(), store.datasets(), n)
    runs = last.select(F.col("id").alias("run_id"), "dataset_id")
    results = store.read("simulation_results").join(F.broadcast(runs.select("run_id")), "run_id")  # n rows
    return last, reports.health(results, store.metrics(), runs, store.read("input_timeseries"))
