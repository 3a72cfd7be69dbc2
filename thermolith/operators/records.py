"""Step records: everything that follows from a step's outputs, by columns alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Condition, Facility, condition
from ..functions import physics as P
from ..schema import RECORD_COLUMNS

CHECKED = ("total_load", "it_power_kw", "heat_kw", "true_temperature_c", "applied_cooling_kw", "cooling_power_kw", "grid_power_kw")


def records(sim: DataFrame, f: Facility | None = None, conditions: dict[str, Condition] | None = None) -> DataFrame:
    """The record columns for each row of ``simulate``'s result, after its key columns."""
    f = f or Facility()
    known = {n: condition(n) for n in ("ideal", "rate_limited", "mild_mismatch", "rate_limited_mild_mismatch", "combined_nonideal")} | (conditions or {})
    n, h = P.num, f.step_hours
    scale = lambda field: F.element_at(F.create_map(*[x for k, c in known.items() for x in (F.lit(k), n(getattr(c, field)))]), F.col("condition"))
    c = F.col
    as_int = lambda x: x.cast("int")

    d = sim.withColumns({"total_load": F.greatest(n(0), c("workload_fraction"))})
    d = d.withColumns({"it_power_kw": P.it_power(c("total_load"), f), "renewable_available_kw": F.greatest(n(0), c("renewable_power_kw")), "cooling_power_kw": P.cooling_power(c("applied_cooling_kw"), c("outdoor_temperature_c"), f)})
    d = d.withColumns({"heat_kw": c("it_power_kw"), "total_power_kw": c("it_power_kw") + c("cooling_power_kw") + n(f.p_aux_kw)})
    d = d.withColumns({"renewable_used_kw": P.renewable_used(c("renewable_available_kw"), c("total_power_kw"))})
    d = d.withColumns({"renewable_curtailed_kw": c("renewable_available_kw") - c("renewable_used_kw"), "grid_power_kw": c("total_power_kw") - c("renewable_used_kw")})
    again = c("prev_temp_c") + n(h) * (c("heat_kw") * scale("heat_scale") - c("applied_cooling_kw") * scale("cooling_scale") - (c("prev_temp_c") - c("outdoor_temperature_c")) / n(f.thermal_resistance_c_per_kw)) / (n(f.thermal_capacitance_kwh_per_c) * scale("capacity_scale"))
    total = lambda xs: sum(xs[1:], xs[0])
    invalid = total([as_int(~P.finite(c(x))) for x in CHECKED])
    negative = total([as_int(P.finite(c(x)) & (c(x) < 0)) for x in CHECKED])
    ramp = as_int((c("ramp_up") + c("ramp_down")) > 0)
    fallback = F.when(c("prediction_infeasible") == 1, "prediction_infeasibility").when(c("fallback") == 1, "optimizer_failure").otherwise("")
    below, above = c("true_temperature_c") < f.min_temp_c, c("true_temperature_c") > f.max_temp_c
    applied_move, proposed_move = F.abs(c("applied_cooling_kw") - c("prev_applied_kw")), F.abs(c("proposed_cooling_kw") - c("prev_proposed_kw"))
    made = {
        "online_load": c("workload_fraction"), "batch_load": n(0), "online_workload": c("workload_fraction"), "batch_workload": n(0), "batch_service": n(0), "backlog": n(0),
        "price": c("electricity_price"), "carbon": c("carbon_intensity_kg_per_kwh") * 1000.0, "outdoor_temp": c("outdoor_temperature_c"),
        "renewable": c("renewable_power_kw") / 100.0, "renewable_kw": c("renewable_power_kw"), "cooling_command_kw": c("proposed_cooling_kw"), "cooling_kw": c("applied_cooling_kw"),
        "proposed_control_movement_kw": proposed_move, "applied_control_movement_kw": applied_move, "control_movement_kw": applied_move,
        "actuator_tracking_error_kw": c("tracking_kw"), "actuator_ramp_limited": ramp, "actuator_ramp_up_limited": c("ramp_up"), "actuator_ramp_down_limited": c("ramp_down"),
        "actuator_alpha": c("alpha"), "actuator_induced_thermal_infeasibility": c("unreachable"), "cooling_constraint_intervention": as_int(c("intervention_kw") > 1e-9),
        "cooling_constraint_intervention_kw": c("intervention_kw"), "cooling_constraint_intervention_energy_kwh": c("intervention_kw") * h, "p_aux_kw": n(f.p_aux_kw),
        "temp_c": c("true_temperature_c"), "actual_next_temperature_c": c("true_temperature_c"),
        "one_step_temperature_prediction_error_c": c("predicted_next_temperature_c") - c("true_temperature_c"), "temp_min_c": n(f.min_temp_c), "temp_setpoint_c": n(f.setpoint_temp_c),
        "temp_max_c": n(f.max_temp_c), "temp_deadband_c": n(f.deadband_c), "temp_control_target_c": c("target_c"), "precool_floor_c": c("floor_c"), "precooling_active": c("precooling"),
        "power_balance_error": c("grid_power_kw") - (c("it_power_kw") + c("cooling_power_kw") + n(f.p_aux_kw) - c("renewable_used_kw")),
        "renewable_balance_error": c("renewable_available_kw") - c("renewable_used_kw") - c("renewable_curtailed_kw"), "thermal_balance_error": c("true_temperature_c") - again,
        "temperature_is_finite": as_int(invalid == 0), "temperature_within_physical_range": as_int(c("true_temperature_c").between(-50.0, 100.0)),
        "temperature_step_change": c("true_temperature_c") - c("prev_temp_c"), "below_min_temperature": as_int(below), "above_max_temperature": as_int(above),
        "temperature_violation": as_int(below | above), "temperature_deviation_from_setpoint_c": F.abs(c("true_temperature_c") - n(f.setpoint_temp_c)),
        "optimizer_attempted": c("attempted"), "optimizer_success": c("success"), "optimizer_failure": as_int((c("fallback") == 1) & (c("prediction_infeasible") == 0)),
        "optimizer_fallback": c("fallback"), "prediction_infeasibility": c("prediction_infeasible"), "actuator_infeasibility": c("unreachable"), "fallback_reason": fallback,
        "optimizer_candidate_evaluations": c("evaluations"), "invalid_value_count": invalid, "negative_power_count": negative,
        "dc_energy_kwh": c("total_power_kw") * h, "grid_energy_kwh": c("grid_power_kw") * h, "cooling_energy_kwh": c("cooling_power_kw") * h,
        "energy_cost_step": P.energy_cost(c("grid_power_kw"), c("electricity_price"), f), "carbon_kg_step": P.carbon_kg(c("grid_power_kw"), c("carbon_intensity_kg_per_kwh"), f),
    }
    keys = [k for k in sim.columns if k in ("run_id", "step_index", "center", "dataset_id", "controller", "condition")]
    return d.select(*keys, *[made[x].alias(x) if x in made else c(x) for x in RECORD_COLUMNS])


def observations(sim: DataFrame) -> DataFrame:
    """``sim`` with ``observation``: what the controller saw at each step of the loop."""
    return sim.withColumn("observation", F.struct(
        F.col("controller_measured_temperature_c").alias("measured_temperature_c"), F.col("prev_applied_kw").alias("previous_applied_cooling_kw"), "workload_fraction", "electricity_price",
        "carbon_intensity_kg_per_kwh", "outdoor_temperature_c", "renewable_power_kw",
    ))
