"""Run metrics from records: one grouped aggregate, made by block of time first; streaks are mergeable summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Facility
from ..functions.physics import ratio
from ..schema import METRIC_NAMES
from .blocks import STEPS, TwoLevels


def wide(rec: DataFrame, f: Facility | None = None, by: str = "run_id", steps: int = STEPS, keys: tuple[str, ...] = (), last_backlog: bool = False) -> DataFrame:
    """One row a run, the metrics as columns; before them ``keys``, columns that have one value a run.
    ``final_backlog`` is 0, or with ``last_backlog`` the last step's backlog, as in the older form."""
    h = (f or Facility()).step_hours
    t = TwoLevels(steps)
    c, total, mean, top = F.col, t.sum, t.avg, t.max
    flags = lambda x: F.coalesce(t.sum(x), F.lit(0)).cast("double")
    only = lambda x, flag: F.coalesce(t.avg(F.when(c(flag) == 1, c(x))), F.lit(0.0))
    err = c("one_step_temperature_prediction_error_c")
    aggs = {
        "total_grid_energy_kwh": total("grid_energy_kwh"), "total_dc_energy_kwh": total("dc_energy_kwh"), "cooling_energy_kwh": total("cooling_energy_kwh"),
        "renewable_energy_available_kwh": total(c("renewable_available_kw") * h), "renewable_energy_used_kwh": total(c("renewable_used_kw") * h),
        "renewable_energy_curtailed_kwh": total(c("renewable_curtailed_kw") * h), "energy_cost": total("energy_cost_step"), "carbon_kg": total("carbon_kg_step"),
        "average_temperature_c": mean("temp_c"), "maximum_temperature_c": top("temp_c"), "minimum_temperature_c": t.min("temp_c"), "temperature_violation_count": flags("temperature_violation"),
        "peak_grid_power_kw": top("grid_power_kw"), "mean_cooling_command": mean("cooling_kw"), "max_cooling_command": top("cooling_kw"), "control_movement_total": total("control_movement_kw"),
        "proposed_control_movement_total": total("proposed_control_movement_kw"), "applied_control_movement_total": total("applied_control_movement_kw"),
        "mean_actuator_tracking_error_kw": mean("actuator_tracking_error_kw"), "max_actuator_tracking_error_kw": top("actuator_tracking_error_kw"),
        "total_actuator_tracking_error_kw": total("actuator_tracking_error_kw"), "ramp_limited_count": flags("actuator_ramp_limited"), "ramp_up_limited_count": flags("actuator_ramp_up_limited"),
        "ramp_down_limited_count": flags("actuator_ramp_down_limited"), "actuator_induced_thermal_infeasibility_count": flags("actuator_induced_thermal_infeasibility"),
        "optimizer_success_count": flags("optimizer_success"), "optimizer_failure_count": flags("optimizer_failure"), "optimizer_fallback_count": flags("optimizer_fallback"),
        "prediction_infeasibility_count": flags("prediction_infeasibility"), "actuator_infeasibility_count": flags("actuator_infeasibility"),
        "mean_optimizer_candidate_evaluations": only("optimizer_candidate_evaluations", "optimizer_attempted"), "mean_objective_value": only("objective_total", "optimizer_success"),
        "mean_objective_energy_cost": only("objective_energy_cost", "optimizer_success"), "mean_objective_carbon": only("objective_carbon", "optimizer_success"),
        "mean_objective_temperature": only("objective_temperature", "optimizer_success"), "mean_objective_control_movement": only("objective_control_movement", "optimizer_success"),
        "mean_abs_temperature_prediction_error_c": mean(F.abs(err)), "max_abs_temperature_prediction_error_c": top(F.abs(err)), "rmse_temperature_prediction_error_c": F.sqrt(mean(err * err)),
        "temperature_prediction_bias_c": mean(err), "below_min_temperature_count": flags("below_min_temperature"), "above_max_temperature_count": flags("above_max_temperature"),
        "mean_temperature_deviation_from_setpoint": mean("temperature_deviation_from_setpoint_c"), "max_temperature_deviation_from_setpoint": top("temperature_deviation_from_setpoint_c"),
        "thermal_infeasibility_count": flags("thermal_infeasible"), "cooling_constraint_intervention_count": flags("cooling_constraint_intervention"),
        "cooling_constraint_intervention_energy_kwh": total("cooling_constraint_intervention_energy_kwh"), "invalid_value_count": flags("invalid_value_count"),
        "negative_power_count": flags("negative_power_count"),
    }
    for kind in ("power", "renewable", "thermal"):
        aggs[f"max_abs_{kind}_balance_error"] = top(F.abs(f"{kind}_balance_error"))
        aggs[f"mean_abs_{kind}_balance_error"] = mean(F.abs(f"{kind}_balance_error"))
    aggs |= {"longest_below_min_streak": t.longest_streak(c("below_min_temperature") == 1), "longest_above_max_streak": t.longest_streak(c("above_max_temperature") == 1)}
    aggs |= {k: t.max(k) for k in keys} | {"final_backlog": t.last("backlog") if last_backlog else F.max(F.lit(0.0))}
    one = t.of(rec, by, aggs).withColumns({
        "energy_kwh": c("total_grid_energy_kwh"), "total_energy_kwh": c("total_dc_energy_kwh"), "cost": c("energy_cost"), "max_temp_c": c("maximum_temperature_c"),
        "thermal_violations": c("temperature_violation_count"), "peak_grid_kw": c("peak_grid_power_kw"), "mean_actuator_lag_kw": c("mean_actuator_tracking_error_kw"),
        "renewable_utilization_rate": ratio(c("renewable_energy_used_kwh"), c("renewable_energy_available_kwh")),
    })
    return one.select(by, *keys, *[c(n).cast("double").alias(n) for n in METRIC_NAMES])


def long(metrics: DataFrame, by: str = "run_id", keys: tuple[str, ...] = ()) -> DataFrame:
    """(run, keys, metric, value)."""
    return metrics.unpivot([by, *keys], [c for c in metrics.columns if c not in (by, *keys)], "metric", "value")


def as_map(metrics: DataFrame, by: str = "run_id") -> DataFrame:
    """One map a run from the long form."""
    return metrics.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("metrics"))


def legacy(rec: DataFrame, f: Facility | None = None, by: str = "run_id") -> DataFrame:
    """The older summary, of the same 66 names: energies from powers and the step's length, and the last step's backlog."""
    h = (f or Facility()).step_hours
    power = {"dc_energy_kwh": "total_power_kw", "grid_energy_kwh": "grid_power_kw", "cooling_energy_kwh": "cooling_power_kw"}
    again = rec.withColumns({energy: F.col(kw) * h for energy, kw in power.items()})
    return wide(again, f, by, last_backlog=True)
