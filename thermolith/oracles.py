"""SQL that DuckDB runs on the same tables, for comparison with each query.

Written on its own, from the definitions: the loops are recursive tables over steps, not
the lockstep plan.
"""

from __future__ import annotations

import math

_D = lambda x: f"CAST({x!r} AS DOUBLE)"
_r = lambda x, name, places=6: f"round({x}, {places}) + 0.0 AS {name}"

SIG = f"""
ev AS (SELECT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day, CAST(hour(ts) * 4 + minute(ts) // 15 AS BIGINT) AS slot, event_type, value FROM events WHERE ts IS NOT NULL),
cnt AS (SELECT day, slot, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE event_type = 'purchase') AS DOUBLE) AS p, round(sum(value), 2) AS v FROM ev GROUP BY 1, 2),
top AS (SELECT max(n) AS nmax, max(v) AS vmax FROM cnt),
sig AS (SELECT CAST(i // 96 + 1 AS INTEGER) AS center, CAST(i % 96 AS INTEGER) AS step_index, TIMESTAMP '2024-01-01' + to_minutes(i * 15) AS timestamp,
  {_D(0.22)} + {_D(0.6)} * coalesce(n, 0.0) / nmax AS online_workload,
  {_D(0.05)} + {_D(0.29)} * coalesce(p, 0.0) / nmax AS batch_workload,
  {_D(0.2)} + {_D(0.9)} * coalesce(v, 0.0) / vmax AS electricity_price,
  {_D(0.25)} + {_D(0.05)} * (coalesce(n, 0.0) % 7) AS carbon_intensity_kg_per_kwh,
  round({_D(15.0)} + {_D(10.5)} * sin({_D(2.0)} * pi() * ((i % 96) * {_D(0.25)} - {_D(7.0)}) / {_D(24.0)}), 6) AS outdoor_temperature_c,
  {_D(320.0)} * round(pow(greatest(sin(pi() * ((i % 96) * {_D(0.25)} - {_D(6.0)}) / {_D(12.0)}), {_D(0.0)}), {_D(1.6)}), 6) AS renewable_power_kw
  FROM range(2880) AS r(i) CROSS JOIN top LEFT JOIN cnt ON cnt.day = i // 96 AND cnt.slot = i % 96)"""

_VALUES = ("online_workload", "batch_workload", "electricity_price", "carbon_intensity_kg_per_kwh", "outdoor_temperature_c", "renewable_power_kw")


def heat(load: str) -> str:
    return f"({_D(80.0)} + least(greatest(({load}) / {_D(1.0)}, {_D(0.0)}), {_D(1.0)}) * {_D(180.0)})"


def cop(outdoor: str = "outdoor_temperature_c") -> str:
    return f"greatest({_D(2.2)}, {_D(4.0)} - {_D(0.035)} * {outdoor})"


def cooling(kw: str, outdoor: str = "outdoor_temperature_c") -> str:
    return f"(greatest({_D(0.0)}, {kw}) / {cop(outdoor)})"


def used(have: str, need: str) -> str:
    return f"least(greatest({_D(0.0)}, {have}), greatest({_D(0.0)}, {need}))"


def thermal(t: str, q: str, cool: str, out: str, cap: float = 1.0, hs: float = 1.0, cs: float = 1.0) -> str:
    return f"({t} + {_D(0.25)} * (({q}) * {_D(hs)} - ({cool}) * {_D(cs)} - (({t}) - {out}) / {_D(0.18)}) / {_D(55.0 * cap)})"


def bound(t: str, q: str, out: str, limit: str) -> str:
    return f"({q} - ({t} - {out}) / {_D(0.18)} - ({limit} - {t}) * {_D(55.0)} / {_D(0.25)})"


#: Work served by price: backlog over steps.
DISPATCH = f"""
pre AS (SELECT *, min(electricity_price) OVER (PARTITION BY center ORDER BY step_index ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS low, 96.0 - step_index AS rem, greatest({_D(0.0)}, {_D(0.85)} - online_workload) AS cap FROM sig),
disp AS (
  SELECT center, CAST(-1 AS INTEGER) AS step_index, {_D(0.0)} AS batch_service, {_D(0.0)} AS backlog FROM (SELECT DISTINCT center FROM sig)
  UNION ALL
  SELECT center, step_index, CAST(s AS DOUBLE), CAST(b - s AS DOUBLE) FROM (
    SELECT *, CASE WHEN rem <= 8 THEN least(b, cap, greatest(s0, b / rem)) ELSE s0 END AS s FROM (
      SELECT *, least(b, CASE WHEN electricity_price <= {_D(0.4)} OR electricity_price <= low THEN {_D(1.0)} WHEN electricity_price >= {_D(0.72)} THEN {_D(0.25)} ELSE {_D(0.55)} END * cap) AS s0 FROM (
        SELECT p.center, p.step_index, p.electricity_price, p.low, p.rem, p.cap, d.backlog + p.batch_workload AS b FROM disp d JOIN pre p ON p.center = d.center AND p.step_index = d.step_index + 1))))"""


def served(strategy: str) -> str:
    """``srv``: batch_service by step; then ``inp`` with the workload."""
    if strategy == "immediate":
        srv = "srv AS (SELECT center, step_index, batch_workload AS batch_service FROM sig)"
    else:
        srv = DISPATCH.strip() + ",\nsrv AS (SELECT center, step_index, batch_service FROM disp WHERE step_index >= 0)"
    return srv + f""",
wrk AS (
  SELECT center, CAST(-1 AS INTEGER) AS step_index, {_D(0.0)} AS done, {_D(0.0)} AS waiting FROM (SELECT DISTINCT center FROM sig)
  UNION ALL
  SELECT center, step_index, CAST(d AS DOUBLE), CAST(b - d AS DOUBLE) FROM (SELECT *, least(b, greatest({_D(0.0)}, batch_service)) AS d FROM (
    SELECT g.center, g.step_index, v.batch_service, w.waiting + g.batch_workload AS b FROM wrk w JOIN sig g ON g.center = w.center AND g.step_index = w.step_index + 1 JOIN srv v ON v.center = g.center AND v.step_index = g.step_index))),
inp AS (SELECT s.*, v.batch_service, greatest({_D(0.0)}, s.online_workload + w.done) AS wl,
  coalesce(s.electricity_price <= {_D(0.4)} AND max(s.electricity_price) OVER (PARTITION BY s.center ORDER BY s.step_index ROWS BETWEEN 1 FOLLOWING AND 23 FOLLOWING) >= {_D(0.72)}, false) AS precool
  FROM sig s JOIN wrk w ON w.center = s.center AND w.step_index = s.step_index JOIN srv v ON v.center = s.center AND v.step_index = s.step_index)"""


MISMATCH = {"ideal": (1.0, 1.0, 1.0), "mild": (1.05, 0.95, 1.05)}


def loop(controller: str = "baseline", actuator: str = "ideal", mismatch: str = "ideal", name: str = "lp", noise: list[float] | None = None) -> str:
    """A recursive table of the closed loop over ``inp``: t is the true temperature, m the measured one."""
    nz = "[" + ", ".join(_D(x) for x in noise) + "]" if noise else None
    first, later = (f" + {_D(noise[0])}", f" + list_extract({nz}, step_index + 2)") if noise else ("", "")
    cap, hs, cs = MISMATCH[mismatch]
    alpha = 1.0 - math.exp(-15 / 30.0)
    if controller == "heuristic":
        target, floor = f"CASE WHEN precool THEN {_D(21.0)} ELSE {_D(24.0)} END", f"CASE WHEN precool THEN {_D(20.5)} ELSE {_D(18.0)} END"
    else:
        target, floor = _D(24.0), _D(18.0)
    proposed = "least(greatest(ff + CASE WHEN e > 0.5 THEN 30.0 * (e - 0.5) WHEN e < -0.5 THEN 30.0 * (e + 0.5) ELSE 0.0 END, 0.0), 280.0)"
    if controller == "finite_horizon":
        proposed, floor = f"CASE WHEN first IS NOT NULL THEN first ELSE {proposed} END", f"CASE WHEN b.first IS NOT NULL THEN {_D(20.5)} ELSE {_D(18.0)} END"
    best, joined = (", b.first AS first", f" LEFT JOIN {_search(name)} b ON b.center = l.center") if controller == "finite_horizon" else ("", "")
    if controller == "external":
        proposed = f"({_D(60.0)} + online_workload * {_D(150.0)})"
    reach = {
        "ideal": (_D(0.0), _D(280.0)), "rate_limited": (f"greatest({_D(0.0)}, a - {_D(90.0)})", f"least({_D(280.0)}, a + {_D(70.0)})"),
        "first_order": (f"a * {_D(1.0 - alpha)}", f"a + {_D(alpha)} * ({_D(280.0)} - a)"), "delayed": ("q", "q"),
    }[actuator]
    move = {
        "ideal": lambda x: x, "rate_limited": lambda x: f"least(greatest({x}, {reach[0]}), {reach[1]})", "first_order": lambda x: f"(a + {_D(alpha)} * ({x} - a))", "delayed": lambda x: "q",
    }[actuator]
    aware = f"(a + (w - a) / {_D(alpha)})" if actuator == "first_order" else "w"
    keep = "true" if actuator == "delayed" else "lo2 > hi2 + 1e-9 OR abs(w - m0) <= 1e-9"
    return f"""
{name} AS (
  SELECT center, CAST(-1 AS INTEGER) AS step_index, {_D(24.0)} AS t, {_D(24.0)}{first} AS m, {_D(0.0)} AS a, {_D(0.0)} AS q, {_D(0.0)} AS p, {_D(0.0)} AS g, {_D(0.0)} AS lo, {_D(0.0)} AS hi, {_D(0.0)} AS tp, {_D(0.0)} AS pt, {_D(0.0)} AS pa, {_D(0.0)} AS pp, {_D(0.0)} AS safe, false AS none FROM (SELECT DISTINCT center FROM sig)
  UNION ALL
  SELECT center, step_index, {thermal('t', 'h', 'x', 'o', cap, hs, cs)}, {thermal('t', 'h', 'x', 'o', cap, hs, cs)}{later}, x, q2, p, g, lo, hi, {thermal('m', 'h', 'x', 'o')}, t, a, p0, safe, none FROM (
    SELECT *, least(greatest({move('g')}, 0.0), 280.0) AS x, g AS q2 FROM (
      SELECT *, least(greatest(CASE WHEN {keep} THEN safe ELSE {aware} END, 0.0), 280.0) AS g, lo2 > hi2 + 1e-9 AS none FROM (
        SELECT *, least(greatest(m0, lo2), hi2) AS w FROM (
          SELECT *, least(greatest({move('safe')}, 0.0), 280.0) AS m0, greatest({reach[0]}, lo) AS lo2, least({reach[1]}, hi) AS hi2 FROM (
            SELECT *, CASE WHEN lo <= hi + 1e-9 THEN least(greatest(least(greatest(p, 0.0), 280.0), lo), hi) WHEN lo > 280.0 THEN 280.0 ELSE 0.0 END AS safe FROM (
              SELECT *, {proposed} AS p, greatest(0.0, {bound('m', 'h', 'o', _D(32.0))}) AS lo, least(280.0, {bound('m', 'h', 'o', f'greatest({_D(18.0)}, fl)')}) AS hi FROM (
                SELECT *, h - (tg - o) / {_D(0.18)} AS ff, m - tg AS e FROM (
                  SELECT l.center, i.step_index, l.t, l.m, l.a, l.q, l.p AS p0, i.online_workload, i.outdoor_temperature_c AS o, {heat('i.wl')} AS h, {target.replace('precool', 'i.precool')} AS tg, {floor.replace('precool', 'i.precool')} AS fl{best}
                  FROM {name} l JOIN inp i ON i.center = l.center AND i.step_index = l.step_index + 1{joined})))))))))"""


def _with(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(c.strip() for c in ctes)


def _loop_query(controller="baseline", actuator="ideal", mismatch="ideal", strategy="immediate") -> str:
    return _with(SIG, served(strategy), loop(controller, actuator, mismatch)) + f"""
SELECT center, step_index, {_r('p', 'proposed_cooling_kw')}, {_r('g', 'constrained_cooling_kw')}, {_r('a', 'applied_cooling_kw')}, {_r('t', 'true_temperature_c')}, {_r('tp', 'predicted_next_temperature_c')},
  {_r('lo', 'cooling_min_feasible_kw')}, {_r('hi', 'cooling_max_feasible_kw')} FROM lp WHERE step_index >= 0"""


def record(name: str = "lp", inp: str = "inp", heuristic: bool = True, ramps: bool = True, mismatch: str = "ideal", tag: str = "rec") -> str:
    """Record columns over a loop's rows."""
    cap, hs, cs = MISMATCH[mismatch]
    z = _D(0.0)
    up, down = ("(l.g > least(280.0, l.pa + 70.0) + 1e-9)", "(l.g < greatest(0.0, l.pa - 90.0) - 1e-9)") if ramps else ("false", "false")
    pre = "i.precool" if heuristic else "false"
    b = lambda x: f"CAST({x} AS INTEGER)"
    base = f"""
{tag}0 AS (SELECT l.*, i.timestamp, i.wl, i.batch_service AS served, i.electricity_price, i.carbon_intensity_kg_per_kwh AS ci, i.outdoor_temperature_c AS o, i.renewable_power_kw AS ren, {heat('i.wl')} AS h, {cooling('l.a', 'i.outdoor_temperature_c')} AS pc, {pre} AS pre, {up} AS up, {down} AS down
  FROM {name} l JOIN {inp} i ON i.center = l.center AND i.step_index = l.step_index WHERE l.step_index >= 0),
{tag}1 AS (SELECT *, h + pc + {_D(12.0)} AS pw, greatest({z}, ren) AS av FROM {tag}0),
{tag}2 AS (SELECT *, {used('av', 'pw')} AS us FROM {tag}1),
{tag}3 AS (SELECT *, pw - us AS grid, abs(a - pa) AS am, abs(p - pp) AS pm, abs(safe - p) AS iv, t < 18.0 AS bl, t > 32.0 AS ab FROM {tag}2)"""
    cols = {
        "timestamp": "timestamp", "online_load": "wl", "batch_load": z, "online_workload": "wl", "batch_workload": z, "batch_service": z, "backlog": z, "total_load": "wl", "prev_temp_c": "pt",
        "price": "electricity_price", "electricity_price": "electricity_price", "carbon": "ci * 1000.0", "carbon_intensity_kg_per_kwh": "ci", "outdoor_temp": "o", "outdoor_temperature_c": "o",
        "renewable": "ren / 100.0", "renewable_kw": "ren", "renewable_available_kw": "av", "renewable_used_kw": "us", "renewable_curtailed_kw": "av - us", "it_power_kw": "h", "heat_kw": "h",
        "proposed_cooling_kw": "p", "constrained_cooling_kw": "g", "applied_cooling_kw": "a", "cooling_command_kw": "p", "cooling_kw": "a", "proposed_control_movement_kw": "pm",
        "applied_control_movement_kw": "am", "control_movement_kw": "am", "actuator_tracking_error_kw": "abs(g - a)", "actuator_ramp_limited": b("up OR down"), "actuator_ramp_up_limited": b("up"),
        "actuator_ramp_down_limited": b("down"), "actuator_alpha": _D(1.0), "actuator_induced_thermal_infeasibility": b("none"), "cooling_min_feasible_kw": "lo", "cooling_max_feasible_kw": "hi",
        "cooling_constraint_intervention": b("iv > 1e-9"), "cooling_constraint_intervention_kw": "iv", "cooling_constraint_intervention_energy_kwh": "iv * 0.25", "cooling_power_kw": "pc",
        "p_aux_kw": _D(12.0), "total_power_kw": "pw", "grid_power_kw": "grid", "temp_c": "t", "true_temperature_c": "t", "measured_temperature_c": "t", "controller_measured_temperature_c": "pt",
        "predicted_next_temperature_c": "tp", "actual_next_temperature_c": "t", "one_step_temperature_prediction_error_c": "tp - t", "temp_min_c": _D(18.0), "temp_setpoint_c": _D(24.0),
        "temp_max_c": _D(32.0), "temp_deadband_c": _D(0.5), "temp_control_target_c": f"CASE WHEN pre THEN {_D(21.0)} ELSE {_D(24.0)} END", "precool_floor_c": f"CASE WHEN pre THEN {_D(20.5)} ELSE {_D(18.0)} END",
        "precooling_active": b("pre"), "power_balance_error": "grid - (h + pc + 12.0 - us)", "renewable_balance_error": "av - us - (av - us)", "thermal_balance_error": f"t - {thermal('pt', 'h', 'a', 'o', cap, hs, cs)}",
        "temperature_is_finite": "1", "temperature_within_physical_range": b("t BETWEEN -50.0 AND 100.0"), "temperature_step_change": "t - pt", "below_min_temperature": b("bl"),
        "above_max_temperature": b("ab"), "temperature_violation": b("bl OR ab"), "temperature_deviation_from_setpoint_c": "abs(t - 24.0)", "thermal_infeasible": b("NOT (lo <= hi + 1e-9)"),
        "optimizer_attempted": "0", "optimizer_success": "0", "optimizer_failure": "0", "optimizer_fallback": "0", "prediction_infeasibility": "0", "actuator_infeasibility": b("none"), "fallback_reason": "''",
        "optimizer_candidate_evaluations": "0", "objective_total": "CAST(NULL AS DOUBLE)", "objective_energy_cost": "CAST(NULL AS DOUBLE)", "objective_carbon": "CAST(NULL AS DOUBLE)",
        "objective_temperature": "CAST(NULL AS DOUBLE)", "objective_control_movement": "CAST(NULL AS DOUBLE)", "invalid_value_count": "0",
        "negative_power_count": "CAST(wl < 0 AS INTEGER) + CAST(h < 0 AS INTEGER) * 2 + CAST(t < 0 AS INTEGER) + CAST(a < 0 AS INTEGER) + CAST(pc < 0 AS INTEGER) + CAST(grid < 0 AS INTEGER)",
        "dc_energy_kwh": "pw * 0.25", "grid_energy_kwh": "grid * 0.25", "cooling_energy_kwh": "pc * 0.25", "energy_cost_step": "grid * 0.25 * electricity_price", "carbon_kg_step": "grid * 0.25 * ci",
    }
    return base + f",\n{tag} AS (SELECT center, step_index, served, " + ", ".join(f"{v} AS {k}" for k, v in cols.items()) + f" FROM {tag}3)"


_INTS = set("""actuator_ramp_limited actuator_ramp_up_limited actuator_ramp_down_limited actuator_induced_thermal_infeasibility cooling_constraint_intervention precooling_active
temperature_is_finite temperature_within_physical_range below_min_temperature above_max_temperature temperature_violation thermal_infeasible optimizer_attempted optimizer_success optimizer_failure
optimizer_fallback prediction_infeasibility actuator_infeasibility optimizer_candidate_evaluations invalid_value_count negative_power_count""".split())

_REC = (SIG, served("price"), loop("heuristic", "rate_limited", "mild"), record(mismatch="mild"))


def _records_query() -> str:
    from .schema import RECORD_COLUMNS

    plain = _INTS | {"timestamp", "fallback_reason"}
    return _with(*_REC) + "\nSELECT center, step_index, " + ", ".join(c if c in plain else _r(c, c) for c in RECORD_COLUMNS) + " FROM rec"


def _metric_ctes() -> str:
    """``met``: the run metrics by center."""
    total = lambda c: f"sum({c})"
    m = {
        "energy_kwh": total("grid_energy_kwh"), "total_grid_energy_kwh": total("grid_energy_kwh"), "total_energy_kwh": total("dc_energy_kwh"), "total_dc_energy_kwh": total("dc_energy_kwh"),
        "cooling_energy_kwh": total("cooling_energy_kwh"), "renewable_energy_available_kwh": total("renewable_available_kw * 0.25"), "renewable_energy_used_kwh": total("renewable_used_kw * 0.25"),
        "renewable_energy_curtailed_kwh": total("renewable_curtailed_kw * 0.25"),
        "renewable_utilization_rate": "CASE WHEN sum(renewable_available_kw * 0.25) > 0 THEN sum(renewable_used_kw * 0.25) / sum(renewable_available_kw * 0.25) ELSE 0.0 END",
        "cost": total("energy_cost_step"), "energy_cost": total("energy_cost_step"), "carbon_kg": total("carbon_kg_step"), "average_temperature_c": "avg(temp_c)", "max_temp_c": "max(temp_c)",
        "maximum_temperature_c": "max(temp_c)", "thermal_violations": total("temperature_violation"), "temperature_violation_count": total("temperature_violation"), "peak_grid_kw": "max(grid_power_kw)",
        "peak_grid_power_kw": "max(grid_power_kw)", "final_backlog": "0", "mean_cooling_command": "avg(cooling_kw)", "max_cooling_command": "max(cooling_kw)", "control_movement_total": total("control_movement_kw"),
        "proposed_control_movement_total": total("proposed_control_movement_kw"), "applied_control_movement_total": total("applied_control_movement_kw"),
        "mean_actuator_tracking_error_kw": "avg(actuator_tracking_error_kw)", "max_actuator_tracking_error_kw": "max(actuator_tracking_error_kw)", "total_actuator_tracking_error_kw": total("actuator_tracking_error_kw"),
        "mean_actuator_lag_kw": "avg(actuator_tracking_error_kw)", "ramp_limited_count": total("actuator_ramp_limited"), "ramp_up_limited_count": total("actuator_ramp_up_limited"),
        "ramp_down_limited_count": total("actuator_ramp_down_limited"), "actuator_induced_thermal_infeasibility_count": total("actuator_induced_thermal_infeasibility"), "optimizer_success_count": "0",
        "optimizer_failure_count": "0", "optimizer_fallback_count": "0", "prediction_infeasibility_count": "0", "actuator_infeasibility_count": total("actuator_infeasibility"),
        "mean_optimizer_candidate_evaluations": "0", "mean_objective_value": "0", "mean_objective_energy_cost": "0", "mean_objective_carbon": "0", "mean_objective_temperature": "0",
        "mean_objective_control_movement": "0", "mean_abs_temperature_prediction_error_c": "avg(abs(predicted_next_temperature_c - temp_c))",
        "max_abs_temperature_prediction_error_c": "max(abs(predicted_next_temperature_c - temp_c))", "rmse_temperature_prediction_error_c": "sqrt(avg((predicted_next_temperature_c - temp_c) * (predicted_next_temperature_c - temp_c)))",
        "temperature_prediction_bias_c": "avg(predicted_next_temperature_c - temp_c)", "below_min_temperature_count": total("below_min_temperature"), "above_max_temperature_count": total("above_max_temperature"),
        "minimum_temperature_c": "min(temp_c)", "mean_temperature_deviation_from_setpoint": "avg(temperature_deviation_from_setpoint_c)", "max_temperature_deviation_from_setpoint": "max(temperature_deviation_from_setpoint_c)",
        "thermal_infeasibility_count": total("thermal_infeasible"), "cooling_constraint_intervention_count": total("cooling_constraint_intervention"),
        "cooling_constraint_intervention_energy_kwh": total("cooling_constraint_intervention_energy_kwh"), "invalid_value_count": total("invalid_value_count"), "negative_power_count": total("negative_power_count"),
    }
    for k in ("power", "renewable", "thermal"):
        m[f"max_abs_{k}_balance_error"] = f"max(abs({k}_balance_error))"
        m[f"mean_abs_{k}_balance_error"] = f"avg(abs({k}_balance_error))"
    streak = lambda flag, name, cte: f"""
{cte} AS (SELECT center, coalesce(max(n), 0) AS {name} FROM (SELECT center, k, count(*) FILTER (WHERE {flag} = 1) AS n FROM (
  SELECT center, {flag}, step_index - sum({flag}) OVER (PARTITION BY center ORDER BY step_index) AS k FROM rec) GROUP BY 1, 2) GROUP BY 1)"""  # noqa: E731
    return "agg AS (SELECT center, " + ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in m.items()) + " FROM rec GROUP BY 1)," + streak("below_min_temperature", "longest_below_min_streak", "s1") + "," + streak("above_max_temperature", "longest_above_max_streak", "s2") + """,
met AS (SELECT agg.*, CAST(longest_below_min_streak AS DOUBLE) AS longest_below_min_streak, CAST(longest_above_max_streak AS DOUBLE) AS longest_above_max_streak FROM agg JOIN s1 USING (center) JOIN s2 USING (center))"""


def _metrics_query(long: bool) -> str:
    from .schema import METRIC_NAMES

    head = _with(*_REC, _metric_ctes())
    if long:
        return head + "\nSELECT center, metric, round(value, 5) + 0.0 AS value FROM (UNPIVOT met ON COLUMNS(* EXCLUDE (center)) INTO NAME metric VALUE value)"
    return head + "\nSELECT center, " + ", ".join(_r(n, n, 5) for n in METRIC_NAMES) + " FROM met"


_COMBOS = [("baseline", a, m, c) for a, m, c in (("ideal", "ideal", "ideal"), ("rate_limited", "ideal", "rate_limited"), ("ideal", "mild", "mild_mismatch"), ("rate_limited", "mild", "rate_limited_mild_mismatch"))]


def _matrix(conditions: tuple[str, ...]) -> str:
    """``tot``: totals by center, controller and condition; ``allrec``: their records."""
    parts, picks = [SIG], []
    rename = lambda sql, tag: sql.replace("srv", f"srv{tag}").replace("wrk", f"wrk{tag}").replace("inp AS", f"inp{tag} AS")
    parts += [rename(served("immediate"), "b"), rename(served("price"), "h")]
    for who, tag in (("baseline", "b"), ("heuristic", "h")):
        for _, actuator, mismatch, cond in _COMBOS:
            if cond in conditions:
                n = f"{tag}_{cond}"
                parts.append(loop(who, actuator, mismatch, f"lp_{n}").replace("JOIN inp i", f"JOIN inp{tag} i"))
                parts.append(record(f"lp_{n}", f"inp{tag}", who == "heuristic", actuator == "rate_limited", mismatch, f"rec_{n}"))
                picks.append(f"SELECT '{who}' AS controller, '{cond}' AS condition, * FROM rec_{n}")
    parts.append("allrec AS (" + " UNION ALL ".join(picks) + ")")
    parts.append("tot AS (SELECT center, controller, condition, sum(energy_cost_step) AS energy_cost, sum(carbon_kg_step) AS carbon_kg, max(temp_c) AS max_temp_c, sum(grid_energy_kwh) AS grid_kwh FROM allrec GROUP BY ALL)")
    return _with(*parts)


_STATE = f"st AS (SELECT *, {_D(17.0)} + online_workload * {_D(20.0)} AS t, electricity_price * {_D(400.0)} - {_D(60.0)} AS request, {heat('online_workload')} AS h, outdoor_temperature_c AS o FROM sig)"
_LO, _HI = f"greatest({_D(0.0)}, {bound('t', 'h', 'o', _D(32.0))})", f"least({_D(280.0)}, {bound('t', 'h', 'o', _D(18.0))})"
_HI_FLOOR = f"least({_D(280.0)}, {bound('t', 'h', 'o', _D(20.5))})"
#: Columns of the tables that are listed.
_LISTED = {
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    "nation": ("n_nationkey", "n_name", "n_regionkey"), "events": ("event_id", "ts", "user_id", "event_type", "value", "props"),
}
#: All days as one series.
_ONE = "one AS (SELECT * REPLACE (CAST(1 AS INTEGER) AS center, CAST((center - 1) * 96 + step_index AS INTEGER) AS step_index) FROM sig)"
_STORED = "stored AS (SELECT o_orderkey AS id, 'c' || (o_custkey % 7) AS name, o_custkey % 50 AS dataset_id, o_orderpriority AS scenario, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS condition_name FROM orders)"


def _lines(names) -> str:
    value = {"quantity": "CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE)", "largest": "max(l_extendedprice)", "discount": "min(l_discount)"}
    return "\nUNION ALL\n".join(f"SELECT l_orderkey AS run_id, '{n}' AS metric, {_r(value[n], 'value')} FROM lineitem GROUP BY 1" for n in names)


_RUNS = "runs AS (SELECT o_orderkey AS id, o_custkey AS dataset_id, o_orderpriority AS controller_name, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS condition_name, o_totalprice AS value FROM orders)"


def _model_bound(limit: float) -> str:
    return f"(h * {_D(0.9)} - (t - o) / {_D(0.18)} - ({_D(limit)} - t) * {_D(55.0 * 1.12)} / {_D(0.25)}) / {_D(1.12)}"


def _search(name: str) -> str:
    """The first action of the best plan from each row of the recursive table ``name``, by eight levels of candidates; a window that ends early keeps its plans."""
    z = _D(0.0)
    grid = f"list_transform(range(7), lambda i: round({_D(280.0)} * i / {_D(6.0)}, 9))"
    parts = [f"p0 AS (SELECT center, step_index + 1 AS s, 1 AS place, m AS temp, a AS applied, CAST(NULL AS DOUBLE) AS first, {z} AS cost, {z} AS carbon, {z} AS comfort, {z} AS move FROM {name} WHERE step_index < 95)"]
    for k in range(8):
        parts.append(f"""
e{k} AS (SELECT p.*, i.electricity_price AS pr, i.carbon_intensity_kg_per_kwh AS ci, i.outdoor_temperature_c AS o, i.renewable_power_kw AS ren, {heat('i.wl')} AS h,
  unnest(list_distinct(list_concat({grid}, [round(least(greatest(p.applied, 0.0), 280.0), 9)]))) AS action FROM p{k} p JOIN inp i ON i.center = p.center AND i.step_index = p.s + {k}),
f{k} AS (SELECT *, {thermal('temp', 'h', 'action', 'o')} AS nxt, h + {cooling('action', 'o')} + {_D(12.0)} AS pw FROM e{k}),
g{k} AS (SELECT *, (pw - least(ren, pw)) * {_D(0.25)} AS en FROM f{k} WHERE nxt >= 20.5 - 1e-9 AND nxt <= 32.0 + 1e-9),
h{k} AS (SELECT center, s, place, action, nxt AS temp, coalesce(first, action) AS first, cost + {_D(1.0)} * pr * en AS cost, carbon + {_D(0.15)} * ci * en AS carbon,
  comfort + {_D(0.5)} * ((nxt - 24.0) * (nxt - 24.0)) AS comfort, move + {_D(2.0)} * (((action - applied) / 280.0) * ((action - applied) / 280.0)) AS move FROM g{k}),
p{k + 1} AS (SELECT center, s, CAST(rk AS INTEGER) AS place, temp, action AS applied, first, cost, carbon, comfort, move FROM (
  SELECT *, row_number() OVER (PARTITION BY center ORDER BY ((cost + carbon) + comfort) + move, place, action) AS rk FROM h{k}) WHERE rk <= 24
  UNION ALL SELECT * FROM p{k} WHERE s + {k} > 95)""")
    return "(WITH " + ",\n".join(parts) + "\nSELECT center, first FROM p8 WHERE place = 1)"


def _mpc() -> str:
    z = _D(0.0)
    grid = f"list_transform(range(7), lambda i: round({_D(280.0)} * i / {_D(6.0)}, 9))"
    parts = [SIG, served("immediate"), f"p0 AS (SELECT center, 1 AS place, {_D(24.0)} AS temp, {z} AS applied, CAST(NULL AS DOUBLE) AS first, {z} AS cost, {z} AS carbon, {z} AS comfort, {z} AS move FROM (SELECT DISTINCT center FROM sig))"]
    for k in range(8):
        parts.append(f"""
e{k} AS (SELECT p.*, i.electricity_price AS pr, i.carbon_intensity_kg_per_kwh AS ci, i.outdoor_temperature_c AS o, i.renewable_power_kw AS ren, {heat('i.wl')} AS h,
  unnest(list_distinct(list_concat({grid}, [round(least(greatest(p.applied, 0.0), 280.0), 9)]))) AS action FROM p{k} p JOIN inp i ON i.center = p.center AND i.step_index = {32 + k}),
f{k} AS (SELECT *, {thermal('temp', 'h', 'action', 'o')} AS nxt FROM e{k}),
g{k} AS (SELECT *, h + {cooling('action', 'o')} + {_D(12.0)} AS pw FROM f{k} WHERE nxt >= 20.5 - 1e-9 AND nxt <= 32.0 + 1e-9),
h{k} AS (SELECT *, (pw - least(ren, pw)) * {_D(0.25)} AS en FROM g{k}),
i{k} AS (SELECT center, place, action, nxt AS temp, coalesce(first, action) AS first, cost + {_D(1.0)} * pr * en AS cost, carbon + {_D(0.15)} * ci * en AS carbon,
  comfort + {_D(0.5)} * ((nxt - 24.0) * (nxt - 24.0)) AS comfort, move + {_D(2.0)} * (((action - applied) / 280.0) * ((action - applied) / 280.0)) AS move FROM h{k}),
p{k + 1} AS (SELECT center, rk AS place, temp, action AS applied, first, cost, carbon, comfort, move FROM (
  SELECT *, row_number() OVER (PARTITION BY center ORDER BY ((cost + carbon) + comfort) + move, place, action) AS rk FROM i{k}) WHERE rk <= 24)""")
    return _with(*parts) + f"\nSELECT center, {_r('first', 'first_action')}, {_r('cost', 'cost')}, {_r('carbon', 'carbon')}, {_r('comfort', 'comfort')}, {_r('move', 'move')}, {_r('((cost + carbon) + comfort) + move', 'total')}, {_r('temp', 'temp')} FROM p8 WHERE place = 1"


def _best_window(col: str) -> str:
    return f"""SELECT center, step_index - 3 AS start_step, step_index AS end_step, m AS mean, '{col}' AS signal FROM (SELECT *, row_number() OVER (PARTITION BY center ORDER BY m DESC, step_index) AS k FROM (
  SELECT center, step_index, avg({col}) OVER (PARTITION BY center ORDER BY step_index ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS m FROM sig) WHERE step_index >= 3) WHERE k = 1"""


#: Records with faults: run 3 is absent, run 5 has a value that is no number, 6 an infinite one, 7 negative powers, 8 steps twice, 9 steps missing.
_DIRTY = """dirty AS (SELECT * REPLACE (
    CASE WHEN center = 5 AND step_index = 10 THEN CAST('nan' AS DOUBLE) ELSE grid_power_kw END AS grid_power_kw, CASE WHEN center = 6 AND step_index IN (4, 9) THEN CAST('inf' AS DOUBLE) ELSE temp_c END AS temp_c,
    CASE WHEN center = 7 AND step_index < 5 THEN -1.0 ELSE cooling_power_kw END AS cooling_power_kw)
  FROM (SELECT * FROM rec WHERE center <> 3 AND NOT (center = 9 AND step_index % 10 = 0) UNION ALL SELECT * FROM rec WHERE center = 8 AND step_index < 7))"""

_EVENTS = (
    ("maximum prediction error", "abs(one_step_temperature_prediction_error_c)", "model and plant differ, and the measurement is noisy"), ("maximum actuator tracking error", "actuator_tracking_error_kw", "the actuator cannot follow its target at once"),
    ("smallest thermal safety margin", "-least(true_temperature_c - temp_min_c, temp_max_c - true_temperature_c)", "the temperature is nearest to one of its limits"),
    ("maximum applied action change", "applied_control_movement_kw", "the largest movement of the actuator between two steps"),
)
_SHOWN = ("true_temperature_c", "measured_temperature_c", "predicted_next_temperature_c", "proposed_cooling_kw", "constrained_cooling_kw", "applied_cooling_kw", "electricity_price", "carbon_intensity_kg_per_kwh", "outdoor_temperature_c", "renewable_available_kw")


def _event(name: str, key: str, cause: str) -> str:
    return f"SELECT center, '{name}' AS event, step_index, timestamp, {', '.join(_r(c, c) for c in _SHOWN)}, '{cause}' AS cause FROM rec QUALIFY row_number() OVER (PARTITION BY center ORDER BY {key} DESC, step_index) = 1"


def _streak_of(flag: str) -> str:
    return f"(SELECT center, max(n) AS n FROM (SELECT center, k, count(*) FILTER (WHERE f) AS n FROM (SELECT center, f, step_index - count(*) FILTER (WHERE f) OVER (PARTITION BY center ORDER BY step_index) AS k FROM (SELECT center, step_index, {flag} AS f FROM rec)) GROUP BY 1, 2) GROUP BY 1)"


def _comparison_report() -> str:
    """Two scenarios' metrics by center, from their records, then text."""
    m = {
        "energy_cost": ("Energy cost", "sum(energy_cost_step)"), "carbon_kg": ("Carbon (kg)", "sum(carbon_kg_step)"), "total_grid_energy_kwh": ("Grid energy (kWh)", "sum(grid_energy_kwh)"),
        "cooling_energy_kwh": ("Cooling energy (kWh)", "sum(cooling_energy_kwh)"), "renewable_utilization_rate": ("Renewable utilization", "CASE WHEN sum(renewable_available_kw) > 0 THEN sum(renewable_used_kw * 0.25) / sum(renewable_available_kw * 0.25) ELSE 0.0 END"),
        "peak_grid_power_kw": ("Peak grid power (kW)", "max(grid_power_kw)"), "average_temperature_c": ("Average temperature (C)", "avg(temp_c)"),
        "temperature_violation_count": ("Temperature violations", "sum(temperature_violation)"), "thermal_infeasibility_count": ("Thermal infeasibility", "sum(thermal_infeasible)"),
    }
    side = lambda who: f"(SELECT center, " + ", ".join(f"CAST({x} AS DOUBLE) AS {k}" for k, (_, x) in m.items()) + f", max(abs(power_balance_error)) AS pe, max(abs(renewable_balance_error)) AS re FROM allrec WHERE controller = '{who}' GROUP BY 1)"
    cell = lambda t, k: f"lpad(printf('%.4f', round({t}.{k}, 4) + 0.0), 16, ' ')"
    verdict = lambda ok: f"CASE WHEN {ok} THEN 'PASS' ELSE 'FAIL' END"
    rate = lambda t: f"printf('%.2f%%', round({t}.renewable_utilization_rate * 100, 2) + 0.0)"
    lines = [f"rpad('{label}', 30, ' ') || {cell('b', k)} || {cell('h', k)}" for k, (label, _) in m.items()]
    lines += [
        "'Economic improvement: ' || " + verdict("round(h.energy_cost, 9) < round(b.energy_cost, 9)"), "'Carbon improvement: ' || " + verdict("round(h.carbon_kg, 9) <= round(b.carbon_kg, 9)"),
        "'Thermal feasibility: ' || " + verdict("b.temperature_violation_count + b.thermal_infeasibility_count + h.temperature_violation_count + h.thermal_infeasibility_count = 0"),
        f"'Renewable utilization: baseline=' || {rate('b')} || ', heuristic=' || {rate('h')}", "'Numerical validity: ' || " + verdict("greatest(b.pe, b.re, h.pe, h.re) <= 1e-9"),
        "'heuristic vs baseline cost: ' || printf('%.2f%%', round((h.energy_cost - b.energy_cost) / abs(b.energy_cost) * 100.0, 2) + 0.0)",
    ]
    parts = " UNION ALL ".join(f"SELECT b.center, {i} AS line_no, {x} AS line FROM b JOIN h USING (center)" for i, x in enumerate(lines))
    return _matrix(("ideal",)) + f",\nb AS {side('baseline')},\nh AS {side('heuristic')}\n{parts}"


def _noise() -> list[float]:
    """The draws of the noisy condition: fixed by its seed, so stated as values."""
    import numpy as np

    return np.random.default_rng(2026).normal(0.0, 0.15, 97).tolist()


_DEG = "CASE WHEN ideal_value = 0 THEN printf('absolute change %+.4f', round(value - ideal_value, 4) + 0.0) ELSE printf('%+.2f%%', round((value - ideal_value) / abs(ideal_value) * 100.0, 2) + 0.0) END"
_ACCEPT = lambda ok, name: f"CASE WHEN {ok} THEN 'PASS' ELSE 'FAIL' END AS {name}"

_LEGACY = (("online_workload", "online_load", "{}", "{}"), ("batch_workload", "batch_load", "{}", "{}"), ("electricity_price", "price", "{}", "{}"), ("carbon_intensity_kg_per_kwh", "carbon", "{} * 1000.0", "{} / 1000.0"), ("outdoor_temperature_c", "outdoor_temp", "{}", "{}"), ("renewable_power_kw", "renewable", "{} / 100.0", "{} * 100.0"))

ORACLES: dict[str, str] = {
    "signals_canonical": _with(SIG) + "\nSELECT center, step_index, timestamp, " + ", ".join(_r(c, c) for c in _VALUES) + " FROM sig",
    "signals_whole_span": _with(SIG) + "\nSELECT center, step_index, timestamp, " + ", ".join(_r(c, c) for c in _VALUES) + " FROM sig",
    "signals_legacy_normalized": _with(SIG) + "\nSELECT timestamp, " + ", ".join(_r({"carbon_intensity_kg_per_kwh": "carbon_intensity_kg_per_kwh * 1000.0 / 1000.0", "renewable_power_kw": "renewable_power_kw / 100.0 * 100.0"}.get(c, c), c) for c in _VALUES) + " FROM sig",
    "signals_legacy_roundtrip": _with(SIG) + "\nSELECT timestamp, " + ", ".join(_r(e, n) for e, n in (("online_workload", "online_load"), ("batch_workload", "batch_load"), ("electricity_price", "price"), ("carbon_intensity_kg_per_kwh * 1000.0", "carbon"), ("outdoor_temperature_c", "outdoor_temp"), ("renewable_power_kw / 100.0", "renewable"))) + " FROM sig",
    "signal_quality": _with(SIG) + "\nSELECT center, count(*) AS n_steps, CAST(0 AS BIGINT) AS not_monotonic, count(*) - count(DISTINCT timestamp) AS duplicates, CAST(0 AS BIGINT) AS gaps, count(*) FILTER (WHERE NOT isfinite(electricity_price)) AS not_finite, count(*) FILTER (WHERE renewable_power_kw < 0) AS negative_renewable FROM sig GROUP BY 1",
    "step_gap_check": _with(SIG) + "\nSELECT center, count(*) AS n_steps, count(*) FILTER (WHERE timestamp - prev <> INTERVAL 15 MINUTE) AS gaps FROM (SELECT *, lag(timestamp) OVER (PARTITION BY center ORDER BY timestamp) AS prev FROM sig WHERE online_workload > 0.22) GROUP BY 1",
    "duplicate_steps": "SELECT user_id, count(*) AS steps, count(DISTINCT date_trunc('hour', ts)) AS distinct_steps, greatest(0, count(*) - count(DISTINCT date_trunc('hour', ts))) AS duplicate_steps FROM events GROUP BY 1",
    "dataset_metadata": _with(SIG) + "\nSELECT center, min(timestamp) AS first_timestamp, max(timestamp) AS last_timestamp, count(*) AS n_steps FROM sig GROUP BY 1",
    "it_power": _with(SIG) + f"\nSELECT center, step_index, {_r(heat('online_workload + batch_workload'), 'it_power_kw')} FROM sig",
    "cooling_cop_power": _with(SIG) + f"\nSELECT center, step_index, {_r(cop(), 'cop')}, {_r(cooling('online_workload * 300.0 - 90.0'), 'cooling_power_kw')} FROM sig",
    "renewable_alloc": _with(SIG) + f"\nSELECT center, step_index, {_r(used('renewable_power_kw - 20.0', 'online_workload * 400.0'), 'used_kw')}, {_r('greatest(0.0, renewable_power_kw - 20.0) - ' + used('renewable_power_kw - 20.0', 'online_workload * 400.0'), 'curtailed_kw')} FROM sig",
    "energy_accounting": _with(SIG, f"a AS (SELECT *, {heat('online_workload + batch_workload')} AS h FROM sig)", f"b AS (SELECT *, h + {cooling('h * 0.5')} + 12.0 AS pw FROM a)", f"c AS (SELECT *, pw - {used('renewable_power_kw', 'pw')} AS grid FROM b)") + f"\nSELECT center, {_r('sum(grid * 0.25)', 'energy_kwh')}, {_r('sum(grid * 0.25 * electricity_price)', 'energy_cost')}, {_r('sum(grid * 0.25 * carbon_intensity_kg_per_kwh)', 'carbon_kg')}, {_r('max(grid)', 'peak_grid_kw')} FROM c GROUP BY 1",
    "plant_step": _with(SIG, _STATE) + f"\nSELECT center, step_index, {_r(thermal('t', 'h', 'least(greatest(request, 0.0), 280.0)', 'o', 1.05, 0.95, 1.05), 'next_c')}, {_r(thermal('t', 'h', 'least(greatest(request, 0.0), 280.0)', 'o'), 'predicted_c')} FROM st",
    "feasible_bounds": _with(SIG, _STATE) + f"\nSELECT center, step_index, {_r(_LO, 'least_kw')}, {_r(_HI, 'most_kw')}, CAST({_LO} <= {_HI} + 1e-9 AS INTEGER) AS feasible FROM st",
    "model_bounds": _with(SIG, _STATE) + f"\nSELECT center, step_index, {_r(f'greatest(0.0, {_model_bound(32.0)})', 'least_kw')}, {_r(f'least(280.0, {_model_bound(20.5)})', 'most_kw')} FROM st",
    "safety_clamp": _with(SIG, _STATE, f"b AS (SELECT *, {_LO} AS lo, {_HI_FLOOR} AS hi FROM st)", "c AS (SELECT *, CASE WHEN lo <= hi + 1e-9 THEN least(greatest(least(greatest(request, 0.0), 280.0), lo), hi) WHEN lo > 280.0 THEN 280.0 ELSE 0.0 END AS act FROM b)") + f"\nSELECT center, step_index, {_r('act', 'action_kw')}, {_r('abs(act - request)', 'intervention_kw')} FROM c",
    "safety_clamp_legacy": _with(SIG, _STATE, f"b AS (SELECT *, {_LO} AS lo, {_HI} AS hi0, {_HI_FLOOR} AS hf FROM st)", "c AS (SELECT *, CASE WHEN lo <= hi0 + 1e-9 AND hf >= lo THEN least(hi0, hf) ELSE hi0 END AS hi FROM b)") + f"\nSELECT center, step_index, {_r('CASE WHEN lo <= hi0 + 1e-9 THEN least(greatest(least(greatest(request, 0.0), 280.0), lo), hi) WHEN lo > 280.0 THEN 280.0 ELSE 0.0 END', 'action_kw')}, {_r('lo', 'least_kw')}, {_r('hi', 'most_kw')} FROM c",
    "forecast_window_array": _with(SIG) + f"\nSELECT center, step_index, CAST(count(*) OVER w AS INTEGER) AS n, {_r('first_value(electricity_price) OVER w', 'first')}, {_r('last_value(electricity_price) OVER w', 'last')}, {_r('avg(electricity_price) OVER w', 'mean')} FROM sig WINDOW w AS (PARTITION BY center ORDER BY step_index ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)",
    "forward_min_price": _with(SIG) + f"\nSELECT center, step_index, {_r('min(electricity_price) OVER (PARTITION BY center ORDER BY step_index ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)', 'forward_min_price')}, CAST(96 - step_index AS BIGINT) AS steps_left FROM sig",
    "precool_flag": _with(SIG) + "\nSELECT center, step_index, CAST(coalesce(electricity_price <= 0.4 AND max(electricity_price) OVER (PARTITION BY center ORDER BY step_index ROWS BETWEEN 1 FOLLOWING AND 23 FOLLOWING) >= 0.72, false) AS INTEGER) AS precool FROM sig",
    "dispatch_immediate": _with(SIG) + f"\nSELECT center, step_index, {_r('batch_workload', 'batch_service')} FROM sig",
    "dispatch_price_aware": _with(SIG, DISPATCH) + f"\nSELECT center, step_index, {_r('batch_service', 'batch_service')}, {_r('backlog', 'backlog')} FROM disp WHERE step_index >= 0",
    "workload_fraction": _with(SIG, served("price")) + f"\nSELECT center, step_index, {_r('wl', 'workload_fraction')} FROM inp",
    "actuator_ideal": _loop_query(), "actuator_rate_limited": _loop_query(actuator="rate_limited"), "actuator_first_order": _loop_query(actuator="first_order"), "actuator_delayed": _loop_query(actuator="delayed"),
    "loop_baseline": _loop_query(), "loop_heuristic": _loop_query("heuristic", strategy="price"), "loop_external_action": _loop_query("external"),
    "loop_finite_horizon": _loop_query("finite_horizon"),
    "measurement_noise": _with(SIG, served("immediate"), loop("baseline", "first_order", "mild", noise=_noise())) + f"\nSELECT center, step_index, {_r('t', 'true_temperature_c')}, {_r('m', 'measured_temperature_c')} FROM lp WHERE step_index >= 0",
    "streaming_loop": _with(SIG, served("immediate"), loop("heuristic")) + f"\nSELECT CAST(center AS BIGINT) AS run_id, step_index, {_r('p', 'proposed_cooling_kw')}, {_r('a', 'applied_cooling_kw')}, {_r('t', 'true_temperature_c')}, CAST(NULL AS VARCHAR) AS error FROM lp WHERE step_index >= 0",
    "stream_rejections": _with(SIG) + """
SELECT CAST(center AS BIGINT) AS run_id, CAST(95 AS BIGINT) AS steps, CASE center % 6 WHEN 0 THEN 'load is not finite' WHEN 1 THEN 'price is negative' WHEN 2 THEN 'the forecast does not begin at the current step'
  WHEN 3 THEN 'the forecast''s times do not increase' WHEN 4 THEN 'the controller may see 8 steps at most' ELSE 'time does not follow the last step' END AS error FROM (SELECT DISTINCT center FROM sig)""",
    "observation_series": _with(SIG, served("immediate"), loop(actuator="rate_limited")) + f"\nSELECT l.center, l.step_index, {_r('l.pt', 'measured_temperature_c')}, {_r('l.pa', 'previous_applied_cooling_kw')}, {_r('i.wl', 'workload_fraction')}, " + ", ".join(_r("i." + c, c) for c in ("electricity_price", "carbon_intensity_kg_per_kwh", "outdoor_temperature_c", "renewable_power_kw")) + " FROM lp l JOIN inp i ON i.center = l.center AND i.step_index = l.step_index WHERE l.step_index >= 0",
    "event_report": _with(*_REC) + "\nSELECT * FROM (" + ") UNION ALL SELECT * FROM (".join(_event(*e) for e in _EVENTS) + ")",
    "thermal_report": _with(*_REC) + f"\nSELECT a.*, coalesce(l.n, 0) AS longest_below_min_streak, coalesce(h.n, 0) AS longest_above_max_streak FROM (SELECT center, count(*) FILTER (WHERE temp_c < temp_min_c) AS below_min_count, count(*) FILTER (WHERE temp_c > temp_max_c) AS above_max_count, {_r('min(temp_c)', 'minimum_temperature')}, {_r('max(temp_c)', 'maximum_temperature')} FROM rec GROUP BY 1) a JOIN {_streak_of('temp_c < temp_min_c')} l USING (center) JOIN {_streak_of('temp_c > temp_max_c')} h USING (center)",
    "thermal_head": _with(*_REC) + f"\nSELECT center, step_index, {', '.join(_r(c, c) for c in ('temp_c', 'temp_min_c', 'temp_max_c', 'cooling_kw'))} FROM rec WHERE step_index < 12",
    "comparison_report": _comparison_report(),
    "scenario_listing": _with(_RUNS) + "\nSELECT controller_name AS scenario, max(id) AS run_id FROM runs GROUP BY 1 ORDER BY 1",
    "iso_times": _with(SIG) + "\nSELECT center, step_index, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS text, strftime(timestamp + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') || '+08:00' AS local_text FROM sig",
    "forecast_contract": _with(SIG) + """
SELECT center, step_index, controller, CASE WHEN least(center, 30, 96 - step_index) > reach THEN printf('the controller may see %d steps at most', reach) END AS error
FROM sig CROSS JOIN (VALUES ('baseline', 1), ('heuristic', 24), ('finite_horizon', 8)) AS c(controller, reach)""",
    "csv_canonical": _with(SIG) + "\nSELECT timestamp, 'csv' AS source, " + ", ".join(_r(c, c) for c in _VALUES) + " FROM sig",
    "csv_legacy": _with(SIG) + "\nSELECT timestamp, 'csv:legacy-normalized' AS source, " + ", ".join(_r(c, c) for c in _VALUES) + " FROM sig",
    "csv_sorted": _with(SIG) + f"\nSELECT timestamp, step_index, {_r('electricity_price', 'price')}, {_r('carbon_intensity_kg_per_kwh * 1000.0', 'carbon')} FROM sig",
    "both_layouts": _with(SIG) + "\nSELECT timestamp, " + ", ".join(_r(old.format(c), n) for c, n, old, _ in _LEGACY) + ", " + ", ".join(_r("CASE WHEN minute(timestamp) % 30 = 0 THEN electricity_price + 1.0 ELSE electricity_price END" if c == "electricity_price" else back.format("(" + old.format(c) + ")"), c) for c, _, old, back in _LEGACY) + " FROM sig",
    "batch_service_alignment": _with(SIG, f"""
wrk AS (SELECT center, CAST(-1 AS INTEGER) AS step_index, {_D(0.0)} AS done, {_D(0.0)} AS waiting FROM (SELECT DISTINCT center FROM sig)
  UNION ALL SELECT center, step_index, CAST(d AS DOUBLE), CAST(b - d AS DOUBLE) FROM (SELECT *, least(b, greatest({_D(0.0)}, want)) AS d FROM (
    SELECT g.center, g.step_index, g.electricity_price * {_D(0.4)} - {_D(0.1)} AS want, w.waiting + g.batch_workload AS b FROM wrk w JOIN sig g ON g.center = w.center AND g.step_index = w.step_index + 1)))""") + f"\nSELECT s.center, s.step_index, {_r('greatest(0.0, s.online_workload + w.done)', 'workload_fraction')} FROM sig s JOIN wrk w ON w.center = s.center AND w.step_index = s.step_index",
    "metric_map": _with(*_REC) + f"\nSELECT center, CAST(66 AS INTEGER) AS n, {_r('sum(energy_cost_step)', 'energy_cost', 5)}, CAST(0 AS DOUBLE) AS final_backlog FROM rec GROUP BY 1",
    "legacy_summary": _metrics_query(False).replace("sum(grid_energy_kwh)", "sum(grid_power_kw * 0.25)").replace("sum(dc_energy_kwh)", "sum(total_power_kw * 0.25)").replace("sum(cooling_energy_kwh)", "sum(cooling_power_kw * 0.25)"),
    "schema_columns": "\nUNION ALL\n".join(f"SELECT '{t}' AS table_name, CAST({i} AS INTEGER) AS position, '{c}' AS column_name, count({c}) AS n_values FROM {t}" for t, columns in _LISTED.items() for i, c in enumerate(columns, 1)),
    "backlog_one_series": _with(SIG, _ONE, DISPATCH.replace("FROM sig", "FROM one").replace("96.0 - step_index", "2880.0 - step_index")) + f"\nSELECT step_index, {_r('batch_service', 'batch_service')}, {_r('backlog', 'backlog')} FROM disp WHERE step_index >= 0",
    "streak_one_series": _with(SIG, _ONE) + "\nSELECT CAST(1 AS INTEGER) AS center, " + ", ".join(f"(SELECT max(n) FROM (SELECT count(*) FILTER (WHERE f = 1) AS n FROM (SELECT f, step_index - sum(f) OVER (ORDER BY step_index) AS k FROM (SELECT step_index, CAST({flag} AS INTEGER) AS f FROM one)) GROUP BY k)) AS {name}" for name, flag in (("cheap", "electricity_price <= 0.6"), ("busy", "online_workload > 0.3"))) + ", (SELECT count(*) FROM one WHERE online_workload > 0.3) AS n_busy",
    "sql_comparable_runs": _with(_STORED) + """
SELECT a.name, a.dataset_id, a.id AS anchor_id, s.scenario, max(r.id) AS run_id
FROM (SELECT * FROM stored WHERE scenario = '3-MEDIUM' AND (condition_name = 'F' OR condition_name IS NULL) QUALIFY row_number() OVER (PARTITION BY name, dataset_id ORDER BY id DESC) = 1) a
CROSS JOIN (VALUES ('1-URGENT'), ('3-MEDIUM'), ('it''s none')) AS s(scenario)
JOIN stored r ON r.scenario = s.scenario AND r.name = a.name AND r.dataset_id = a.dataset_id AND r.id <= a.id AND (r.condition_name = 'F' OR r.condition_name IS NULL)
GROUP BY ALL""",
    "sql_run_metrics": _lines(("quantity", "discount")), "sql_run_metrics_any": _lines(("quantity", "discount", "largest")),
    "sql_runs_under_none": _with(_STORED) + "\nSELECT scenario, count(*) AS n, max(id) AS last_id FROM stored WHERE condition_name IS NULL GROUP BY 1",
    "sql_latest_runs": _with(_STORED) + "\nSELECT r.id, r.scenario, r.condition_name, c_name AS dataset_name FROM (SELECT * FROM stored ORDER BY id DESC LIMIT 25) r JOIN customer ON c_custkey = r.dataset_id",
    "sql_accounted_steps": _with(SIG, f"""
p AS (SELECT *, {heat('online_workload + batch_workload')} + {cooling(heat('online_workload + batch_workload') + ' * ' + _D(0.5))} + {_D(12.0)} AS power FROM sig),
g AS (SELECT *, power - {used('renewable_power_kw', 'power')} AS grid, greatest({_D(0.0)}, renewable_power_kw) - {used('renewable_power_kw', 'power')} AS lost FROM p)""") + f"""
SELECT center AS run_id, count(*) AS steps, {_r('sum(grid * 0.25)', 'energy_kwh')}, {_r('sum(grid * 0.25 * electricity_price)', 'energy_cost')}, {_r('sum(grid * 0.25 * carbon_intensity_kg_per_kwh)', 'carbon_kg')}, {_r('sum(lost)', 'curtailed_kw')} FROM g GROUP BY 1""",
    "sql_bounded_steps": _with(SIG, f"""
st AS (SELECT center AS run_id, step_index, {_D(17.0)} + online_workload * {_D(20.0)} AS t, {heat('online_workload + batch_workload')} AS h, outdoor_temperature_c AS o, electricity_price * {_D(400.0)} - {_D(60.0)} AS want FROM sig),
bd AS (SELECT *, greatest({_D(0.0)}, {bound('t', 'h', 'o', _D(32.0))}) AS lo, least({_D(280.0)}, {bound('t', 'h', 'o', _D(20.5))}) AS hi,
  least({_D(280.0)}, (h * {_D(0.95)} - (t - o) / {_D(0.18)} - ({_D(20.5)} - t) * {_D(55.0 * 1.05)} / {_D(0.25)}) / {_D(1.05)}) AS mhi FROM st),
ac AS (SELECT *, CASE WHEN lo <= hi + 1e-9 THEN least(greatest(least(greatest(want, 0.0), 280.0), lo), hi) WHEN lo > 280.0 THEN 280.0 ELSE 0.0 END AS a FROM bd)""") + f"""
SELECT run_id, step_index, {_r('lo', 'least_kw')}, {_r('hi', 'most_kw')}, {_r('mhi', 'model_most_kw')}, {_r('a', 'action_kw')}, {_r(thermal('t', 'h', 'a', 'o', 1.05, 0.95, 1.05), 'next_c')} FROM ac""",
    "csv_quarantine": _with(SIG, "f AS (SELECT *, (step_index + center) % 24 AS k FROM sig)") + """
SELECT 'good' AS reason, count(*) AS n, count(*) FILTER (WHERE k <> 4) AS n_workloads, round(sum(round(electricity_price, 6)), 4) + 0.0 AS price FROM f WHERE k NOT IN (1, 2, 3, 5, 6, 7)
UNION ALL
SELECT CASE WHEN k IN (5, 7) THEN 'wrong number of fields' WHEN k = 1 THEN 'timestamp: no time' WHEN k = 2 THEN 'timestamp: missing' WHEN k = 3 THEN 'online_workload: no number' ELSE 'renewable_power_kw: no number' END, count(*), 0, 0.0
FROM f WHERE k IN (1, 2, 3, 5, 6, 7) GROUP BY 1""",
    "stream_stored_totals": "SELECT event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE) AS value, 'completed' AS status, (SELECT count(*) FROM events) AS n_stored FROM events GROUP BY 1",
    "stream_slots": """
SELECT slot_start, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, round(round(sum(value), 2), 2) + 0.0 AS value
FROM (SELECT *, time_bucket(INTERVAL 15 MINUTE, ts) AS slot_start, (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE AS closed FROM events)
WHERE slot_start + INTERVAL 15 MINUTE <= closed GROUP BY slot_start""",
    "run_store": _with(SIG) + """
SELECT CAST(nth AS BIGINT) AS nth, CAST(0 AS BIGINT) AS dataset, scenario, status, message, (SELECT count(*) FROM sig) AS n_steps, CASE WHEN nth = 0 THEN (SELECT count(*) FROM sig) END AS steps,
  CASE WHEN nth = 0 THEN (SELECT round(sum(electricity_price), 6) FROM sig) END AS price, CASE WHEN nth = 0 THEN CAST(2 AS BIGINT) END AS metrics, CASE WHEN nth = 0 THEN CAST(5.0 AS DOUBLE) END AS largest
FROM (VALUES (0, 'baseline', 'completed', NULL), (1, 'heuristic', 'failed', 'no power'), (2, 'finite_horizon', 'running', NULL)) AS r(nth, scenario, status, message)""",
    "mpc_open_loop_solve": _mpc(),
    "robustness_matrix": _matrix(("ideal", "rate_limited", "mild_mismatch", "rate_limited_mild_mismatch")) + "\nSELECT center, controller, condition, " + ", ".join(_r(c, c, 5) for c in ("energy_cost", "carbon_kg", "max_temp_c", "grid_kwh")) + " FROM tot",
    "step_records": _records_query(), "run_metrics_wide": _metrics_query(False), "run_metrics_long": _metrics_query(True),
    "control_movement": _with(SIG, served("immediate"), loop()) + f"\nSELECT center, step_index, {_r('abs(p - pp)', 'proposed_movement_kw')}, {_r('abs(a - pa)', 'applied_movement_kw')} FROM lp WHERE step_index >= 0",
    "step_change": _with(SIG, served("immediate"), loop()) + f"\nSELECT center, step_index, {_r('CASE WHEN step_index > 0 THEN t - pt END', 'change_c')} FROM lp WHERE step_index >= 0",
    "conditional_means": _with(SIG) + f"\nSELECT center, {_r('coalesce(avg(electricity_price) FILTER (WHERE batch_workload > 0.2), 0.0)', 'price_when_busy')}, {_r('coalesce(avg(online_workload) FILTER (WHERE electricity_price > 5), 0.0)', 'never')} FROM sig GROUP BY 1",
    "prediction_error_stats": _with(SIG, served("immediate"), loop(mismatch="mild")) + f"\nSELECT center, {_r('avg(abs(tp - t))', 'mean_abs')}, {_r('max(abs(tp - t))', 'max_abs')}, {_r('sqrt(avg((tp - t) * (tp - t)))', 'rmse')}, {_r('avg(tp - t)', 'bias')} FROM lp WHERE step_index >= 0 GROUP BY 1",
    "longest_streak": _with(SIG) + "\nSELECT center, max(n) AS longest_streak FROM (SELECT center, k, count(*) FILTER (WHERE f = 1) AS n FROM (SELECT center, f, step_index - sum(f) OVER (PARTITION BY center ORDER BY step_index) AS k FROM (SELECT *, CAST(electricity_price <= 0.4 AS INTEGER) AS f FROM sig)) GROUP BY 1, 2) GROUP BY 1",
    "extreme_events": _with(SIG, "k AS (SELECT *, row_number() OVER (PARTITION BY center ORDER BY electricity_price DESC, step_index) AS hi, row_number() OVER (PARTITION BY center ORDER BY electricity_price, step_index) AS lo FROM sig)") + f"\nSELECT h.center, h.step_index AS high_step, {_r('h.electricity_price', 'high_price')}, l.step_index AS low_step, {_r('l.electricity_price', 'low_price')} FROM k h JOIN k l ON l.center = h.center AND l.lo = 1 WHERE h.hi = 1",
    "safety_margin": _with(*_REC) + f"\nSELECT center, step_index, {_r('temp_c', 'temp_c')}, {_r('m', 'margin_c')} FROM (SELECT *, row_number() OVER (PARTITION BY center ORDER BY m, step_index) AS k FROM (SELECT center, step_index, temp_c, least(temp_c - 18.0, 32.0 - temp_c) AS m FROM rec)) WHERE k = 1",
    "key_windows": _with(SIG) + f"\nSELECT center, start_step, end_step, {_r('mean', 'mean')}, signal FROM (" + " UNION ALL ".join(_best_window(c) for c in ("electricity_price", "online_workload", "renewable_power_kw")) + ")",
    "key_window_by_scenario": _matrix(("ideal",)) + f",\nwin AS ({_best_window('electricity_price')})\nSELECT center, signal, controller AS scenario, {_r('sum(batch_service)', 'batch_service')}, {_r('sum(grid_power_kw * 0.25)', 'grid_kwh')}, {_r('sum(cooling_power_kw * 0.25)', 'cooling_kwh')}, {_r('sum(renewable_used_kw * 0.25)', 'renewable_kwh')}, {_r('avg(temp_c)', 'mean_temp_c')}, {_r('avg(cooling_kw)', 'mean_control_kw')} FROM allrec JOIN win USING (center) WHERE step_index BETWEEN start_step AND end_step GROUP BY center, signal, controller",
    "latest_run_per_group": _with(_RUNS) + f"\nSELECT controller_name, condition_name, id, dataset_id, {_r('value', 'value')} FROM runs WHERE condition_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY controller_name, condition_name ORDER BY id DESC) = 1",
    "asof_comparable_run": _with(_RUNS) + "\nSELECT a.id, a.dataset_id, (SELECT max(b.id) FROM runs b WHERE b.condition_name = 'O' AND b.dataset_id = a.dataset_id AND b.id <= a.id) AS match_id FROM runs a WHERE a.condition_name = 'F'",
    "asof_clustered_run": _with(_RUNS) + "\nSELECT a.id, a.dataset_id, (SELECT max(b.id) FROM runs b WHERE b.condition_name = 'O' AND b.dataset_id = a.dataset_id AND b.id <= a.id) AS match_id FROM runs a WHERE a.condition_name = 'F'",
    "latest_ten_runs": _with(_RUNS) + f"\nSELECT dataset_id, id, controller_name, condition_name, {_r('value', 'value')}, c_name AS dataset_name FROM (SELECT * FROM runs ORDER BY id DESC LIMIT 10) JOIN customer ON c_custkey = dataset_id",
    "null_tolerant_filter": _with(_RUNS) + "\nSELECT controller_name, count(*) AS n FROM runs WHERE condition_name = 'O' OR condition_name IS NULL GROUP BY 1",
    "in_list_filter": _with(_RUNS) + "\nSELECT condition_name, count(*) AS n, max(id) AS last_id FROM runs WHERE controller_name IN ('1-URGENT', '2-HIGH') GROUP BY 1",
    "scenario_pivot": _matrix(("ideal",)) + f",\nm AS (UNPIVOT (SELECT center, controller, energy_cost, carbon_kg FROM tot) ON energy_cost, carbon_kg INTO NAME metric VALUE value)\nSELECT center, metric, {_r('b', 'baseline', 4)}, {_r('h', 'heuristic', 4)}, {_r('CASE WHEN b <> 0 THEN (h - b) / abs(b) * 100 END', 'heuristic_change_pct', 4)} FROM (SELECT center, metric, max(value) FILTER (WHERE controller = 'baseline') AS b, max(value) FILTER (WHERE controller = 'heuristic') AS h FROM m GROUP BY 1, 2)",
    "pct_change": _with(_RUNS) + f"\nSELECT controller_name, {_r('(o - b) / abs(b) * 100', 'pct')}, CAST(NULL AS DOUBLE) AS no_base FROM (SELECT controller_name, CAST(sum(CAST(round(value, 2) AS DECIMAL(18, 2))) FILTER (WHERE condition_name = 'O') AS DOUBLE) AS b, CAST(sum(CAST(round(value, 2) AS DECIMAL(18, 2))) FILTER (WHERE condition_name = 'F') AS DOUBLE) AS o FROM runs GROUP BY 1)",
    "degradation_matrix": _matrix(("ideal", "rate_limited")) + f",\nm AS (SELECT center, controller, condition, 'energy_cost' AS metric, energy_cost AS value FROM tot UNION ALL SELECT center, controller, condition, 'carbon_kg', carbon_kg FROM tot UNION ALL SELECT center, controller, condition, 'absent', 0.0 FROM tot),\nd AS (SELECT m.*, i.value AS ideal_value FROM m JOIN m i ON i.center = m.center AND i.controller = m.controller AND i.metric = m.metric AND i.condition = 'ideal')\nSELECT center, controller, condition, metric, {_r('value', 'value', 4)}, {_DEG} AS degradation FROM d",
    "acceptance_checks": _matrix(("ideal",)) + ",\nx AS (SELECT center, max(energy_cost) FILTER (WHERE controller = 'heuristic') AS hc, max(energy_cost) FILTER (WHERE controller = 'baseline') AS bc, max(carbon_kg) FILTER (WHERE controller = 'heuristic') AS hk, max(carbon_kg) FILTER (WHERE controller = 'baseline') AS bk FROM tot GROUP BY 1),\ny AS (SELECT center, sum(temperature_violation) + sum(thermal_infeasible) AS bad, max(abs(power_balance_error)) AS pe, max(abs(renewable_balance_error)) AS re FROM allrec GROUP BY 1)\nSELECT center, " + ", ".join((_ACCEPT("round(hc, 9) < round(bc, 9)", "economic"), _ACCEPT("round(hk, 9) <= round(bk, 9)", "carbon"), _ACCEPT("bad = 0", "thermal"), _ACCEPT("pe <= 1e-9 AND re <= 1e-9", "numerical"))) + " FROM x JOIN y USING (center)",
    "health_counters": _with(*_REC, _metric_ctes(), _DIRTY) + """
SELECT CAST(n_nationkey + 1 AS BIGINT) AS run_id, coalesce(r.steps, 0) AS steps, coalesce(mt.metrics, 0) AS metrics, coalesce(r.bad, 0) AS invalid_values, coalesce(neg, 0) AS negative_power,
  greatest(0, 96 - coalesce(r.steps, 0)) AS missing_steps, coalesce(r.steps - r.times, 0) AS duplicate_steps,
  CAST(coalesce(tv, 0) AS BIGINT) AS temperature_violations, CAST(coalesce(ti, 0) AS BIGINT) AS thermal_infeasible, CAST(coalesce(ci, 0) AS BIGINT) AS cooling_interventions
FROM nation LEFT JOIN (SELECT center, count(*) AS metrics FROM (UNPIVOT met ON COLUMNS(* EXCLUDE (center)) INTO NAME metric VALUE value) GROUP BY 1) mt ON mt.center = n_nationkey + 1
LEFT JOIN (SELECT center, count(*) AS steps, count(DISTINCT timestamp) AS times,
    count(*) FILTER (WHERE NOT (isfinite(total_load) AND isfinite(it_power_kw) AND isfinite(heat_kw) AND isfinite(cooling_power_kw) AND isfinite(grid_power_kw) AND isfinite(temp_c))) AS bad,
    count(*) FILTER (WHERE it_power_kw < -1e-9 OR heat_kw < -1e-9 OR cooling_power_kw < -1e-9 OR grid_power_kw < -1e-9) AS neg,
    sum(temperature_violation) AS tv, sum(thermal_infeasible) AS ti, sum(cooling_constraint_intervention) AS ci FROM dirty GROUP BY 1) r ON r.center = n_nationkey + 1""",
    "dataset_upsert": _with(_RUNS) + f"\nSELECT dataset_id, id, {_r('value', 'value')} FROM runs QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY id DESC) = 1",
    "metric_upsert": _with(_RUNS) + f"\nSELECT dataset_id, controller_name AS metric, {_r('value', 'value')} FROM runs QUALIFY row_number() OVER (PARTITION BY dataset_id, controller_name ORDER BY id DESC) = 1",
    "schema_evolution": "SELECT r_regionkey, r_name, 'completed' AS status, CAST(NULL AS DOUBLE) AS weight FROM region",
    "candidate_grid": _with(SIG) + f", c AS (SELECT center, step_index, list_distinct(list_concat(list_transform(range(7), lambda i: round({_D(280.0)} * i / {_D(6.0)}, 9)), [round(least(greatest(online_workload * {_D(400.0)}, 0.0), 280.0), 9)])) AS g FROM sig)\nSELECT center, step_index, CAST(len(g) AS INTEGER) AS n, round(unnest(g), 6) + 0.0 AS action_kw FROM c",
    "union_scenarios": _with(SIG, DISPATCH) + f"\nSELECT 'baseline' AS scenario, center, step_index, {_r('batch_workload', 'batch_service')} FROM sig UNION ALL SELECT 'heuristic', center, step_index, round(batch_service, 6) + 0.0 FROM disp WHERE step_index >= 0",
    "coordination_series": _with(SIG, DISPATCH) + f"\nSELECT center, step_index, 'baseline' AS scenario, {_r('online_workload + batch_workload', 'workload')}, {_r('electricity_price', 'electricity_price')} FROM sig UNION ALL SELECT s.center, s.step_index, 'heuristic', round(s.online_workload + d.batch_service, 6) + 0.0, round(s.electricity_price, 6) + 0.0 FROM sig s JOIN disp d ON d.center = s.center AND d.step_index = s.step_index",
    "mini_summary": _with(*_REC) + f"\nSELECT center, {_r('sum(grid_energy_kwh)', 'energy_kwh', 5)}, {_r('sum(energy_cost_step)', 'cost', 5)}, {_r('sum(carbon_kg_step)', 'carbon_kg', 5)} FROM rec GROUP BY 1",
}
