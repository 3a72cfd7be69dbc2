"""Schemas, units and names."""

from __future__ import annotations

from pyspark.sql import types as T

# Signal columns and units, record columns, metric names.
SIGNAL_UNITS = {
    "timestamp": "timezone-aware timestamp", "online_workload": "capacity fraction", "batch_workload": "capacity fraction", "electricity_price": "currency/kWh",
    "carbon_intensity_kg_per_kwh": "kgCO2/kWh", "outdoor_temperature_c": "degC", "renewable_power_kw": "kW",
}
SIGNAL_COLUMNS = tuple(SIGNAL_UNITS)
LEGACY_COLUMNS = {
    "timestamp": "timestamp", "online_load": "online_workload", "batch_load": "batch_workload", "price": "electricity_price",
    "carbon": "carbon_intensity_kg_per_kwh", "outdoor_temp": "outdoor_temperature_c", "renewable": "renewable_power_kw",
}
SIGNALS = T.StructType([T.StructField(n, T.TimestampType() if n == "timestamp" else T.DoubleType(), True, {"unit": u}) for n, u in SIGNAL_UNITS.items()])
INPUTS = "run_id long, step_index int, timestamp timestamp_ntz, workload_fraction double, electricity_price double, carbon_intensity_kg_per_kwh double, outdoor_temperature_c double, renewable_power_kw double"

RECORD_COLUMNS = """
timestamp online_load batch_load online_workload batch_workload batch_service backlog
total_load prev_temp_c price electricity_price carbon carbon_intensity_kg_per_kwh
outdoor_temp outdoor_temperature_c renewable renewable_kw renewable_available_kw
renewable_used_kw renewable_curtailed_kw it_power_kw heat_kw proposed_cooling_kw
constrained_cooling_kw applied_cooling_kw cooling_command_kw cooling_kw
proposed_control_movement_kw applied_control_movement_kw control_movement_kw
actuator_tracking_error_kw actuator_ramp_limited actuator_ramp_up_limited
actuator_ramp_down_limited actuator_alpha actuator_induced_thermal_infeasibility
cooling_min_feasible_kw cooling_max_feasible_kw cooling_constraint_intervention
cooling_constraint_intervention_kw cooling_constraint_intervention_energy_kwh
cooling_power_kw p_aux_kw total_power_kw grid_power_kw temp_c true_temperature_c
measured_temperature_c controller_measured_temperature_c predicted_next_temperature_c
actual_next_temperature_c one_step_temperature_prediction_error_c temp_min_c
temp_setpoint_c temp_max_c temp_deadband_c temp_control_target_c precool_floor_c
precooling_active power_balance_error renewable_balance_error thermal_balance_error
temperature_is_finite temperature_within_physical_range temperature_step_change
below_min_temperature above_max_temperature temperature_violation
temperature_deviation_from_setpoint_c thermal_infeasible optimizer_attempted
optimizer_success optimizer_failure optimizer_fallback prediction_infeasibility
actuator_infeasibility fallback_reason optimizer_candidate_evaluations objective_total
objective_energy_cost objective_carbon objective_temperature objective_control_movement
invalid_value_count negative_power_count dc_energy_kwh grid_energy_kwh
cooling_energy_kwh energy_cost_step carbon_kg_step
""".split()
#: Not kept in the result table.
TRANSIENT_COLUMNS = RECORD_COLUMNS[-5:]

METRIC_NAMES = """
energy_kwh total_grid_energy_kwh total_energy_kwh total_dc_energy_kwh
cooling_energy_kwh renewable_energy_available_kwh renewable_energy_used_kwh
renewable_energy_curtailed_kwh renewable_utilization_rate cost energy_cost carbon_kg
average_temperature_c max_temp_c maximum_temperature_c thermal_violations
temperature_violation_count peak_grid_kw peak_grid_power_kw final_backlog
mean_cooling_command max_cooling_command control_movement_total
proposed_control_movement_total applied_control_movement_total
mean_actuator_tracking_error_kw max_actuator_tracking_error_kw
total_actuator_tracking_error_kw mean_actuator_lag_kw ramp_limited_count
ramp_up_limited_count ramp_down_limited_count
actuator_induced_thermal_infeasibility_count optimizer_success_count
optimizer_failure_count optimizer_fallback_count prediction_infeasibility_count
actuator_infeasibility_count mean_optimizer_candidate_evaluations mean_objective_value
mean_objective_energy_cost mean_objective_carbon mean_objective_temperature
mean_objective_control_movement mean_abs_temperature_prediction_error_c
max_abs_temperature_prediction_error_c rmse_temperature_prediction_error_c
temperature_prediction_bias_c max_abs_power_balance_error mean_abs_power_balance_error
max_abs_renewable_balance_error mean_abs_renewable_balance_error
max_abs_thermal_balance_error mean_abs_thermal_balance_error below_min_temperature_count
above_max_temperature_count minimum_temperature_c
mean_temperature_deviation_from_setpoint max_temperature_deviation_from_setpoint
longest_below_min_streak longest_above_max_streak thermal_infeasibility_count
cooling_constraint_intervention_count cooling_constraint_intervention_energy_kwh
invalid_value_count negative_power_count
""".split()
