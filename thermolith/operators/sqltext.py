"""The engine from SQL text: tables as views, arguments by name, the physics as SQL functions.

Values reach a text only as arguments (``:name``), which Spark binds to the parsed statement, so no text is ever put together
from values. An argument may be null (``x <=> :x``, or ``:x IS NULL OR x = :x`` where null means any) or a list (``array_contains(:list, x)``).
The functions are SQL functions: Catalyst puts their bodies in the place of their calls, so they run in generated code as the
columns of ``functions.physics`` do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Facility


def views(spark: SparkSession, **tables: DataFrame) -> None:
    """Registers tables under their names, for this session; a name given again is replaced."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def ask(spark: SparkSession, text: str, **args) -> DataFrame:
    """What a text says, with its arguments bound: scalars, None, or lists of scalars."""
    return spark.sql(text, args={k: _bound(v) for k, v in args.items()})


def _bound(value) -> Column:
    if isinstance(value, (list, tuple, set, frozenset)):
        return F.array(*map(F.lit, value))
    return value if isinstance(value, Column) else F.lit(value)


def functions_of(f: Facility) -> dict[str, tuple[str, str]]:
    """Name: (arguments, body) of the physics of a facility."""
    n = lambda x: f"{float(x)!r}D"
    loss = f"(temp - outdoor) / {n(f.thermal_resistance_c_per_kw)}"
    free = f"heat * heat_scale - {loss}"
    rate = f"{n(f.thermal_capacitance_kwh_per_c)} * capacity_scale / {n(f.step_hours)}"
    state = "temp DOUBLE, heat DOUBLE, outdoor DOUBLE"
    scales = "capacity_scale DOUBLE DEFAULT 1.0D, heat_scale DOUBLE DEFAULT 1.0D, cooling_scale DOUBLE DEFAULT 1.0D"
    most = n(f.max_cooling_kw)
    return {
        "it_power": ("load DOUBLE", f"{n(f.p_idle_kw)} + least(greatest(load / {n(f.max_load)}, 0D), 1D) * {n(f.p_peak_kw - f.p_idle_kw)}"),
        "next_temperature": (f"temp DOUBLE, heat DOUBLE, cooling DOUBLE, outdoor DOUBLE, {scales}", f"temp + {n(f.step_hours)} * (heat * heat_scale - cooling * cooling_scale - {loss}) / ({n(f.thermal_capacitance_kwh_per_c)} * capacity_scale)"),
        "cooling_cop": ("outdoor DOUBLE", f"greatest({n(f.cop_min)}, {n(f.cop_base)} - {n(f.cop_temp_slope)} * outdoor)"),
        "cooling_power": ("cooling DOUBLE, outdoor DOUBLE", "greatest(0D, cooling) / cooling_cop(outdoor)"),
        "renewable_used": ("available DOUBLE, power DOUBLE", "least(greatest(0D, available), greatest(0D, power))"),
        "renewable_curtailed": ("available DOUBLE, power DOUBLE", "greatest(0D, available) - renewable_used(available, power)"),
        "grid_energy": ("grid DOUBLE", f"grid * {n(f.step_hours)}"),
        "energy_cost": ("grid DOUBLE, price DOUBLE", "grid_energy(grid) * price"),
        "carbon_mass": ("grid DOUBLE, intensity DOUBLE", "grid_energy(grid) * intensity"),
        "least_cooling": (f"{state}, {scales}, high DOUBLE DEFAULT {n(f.max_temp_c)}", f"greatest(0D, ({free} - (high - temp) * ({rate})) / cooling_scale)"),
        "most_cooling": (f"{state}, {scales}, low DOUBLE DEFAULT {n(f.min_temp_c)}", f"least({most}, ({free} - (low - temp) * ({rate})) / cooling_scale)"),
        "safe_cooling": (
            "wanted DOUBLE, least_kw DOUBLE, most_kw DOUBLE",
            f"CASE WHEN least_kw <= most_kw + 1e-9D THEN least(greatest(least(greatest(wanted, 0D), {most}), least_kw), most_kw) WHEN least_kw > {most} THEN {most} ELSE 0D END",
        ),
    }


def register(spark: SparkSession, f: Facility | None = None) -> list[str]:
    """Makes the physics callable from SQL in this session; the functions' names."""
    known = functions_of((f or Facility()).validated())
    for name, (arguments, body) in known.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS DOUBLE RETURN {body}")
    return list(known)


#: The latest run of ``:anchor`` of each dataset and name, and of each of ``:scenarios`` the latest comparable one that is no newer.
COMPARABLE_RUNS = """
WITH fit AS (SELECT id, name, dataset_id, scenario FROM experiment_runs WHERE condition_name <=> :condition OR condition_name IS NULL),
anchors AS (SELECT name, dataset_id, max(id) AS anchor_id FROM fit WHERE scenario = :anchor GROUP BY name, dataset_id)
SELECT a.name, a.dataset_id, a.anchor_id, r.scenario, max(r.id) AS run_id
FROM anchors a JOIN fit r ON r.name = a.name AND r.dataset_id = a.dataset_id AND r.id <= a.anchor_id
WHERE array_contains(CAST(:scenarios AS ARRAY<STRING>), r.scenario)
GROUP BY a.name, a.dataset_id, a.anchor_id, r.scenario
"""

#: Metrics of runs ``:first`` to ``:last``; ``:metrics`` null means all of them.
RUN_METRICS = """
SELECT run_id, metric, value FROM run_metrics
WHERE run_id BETWEEN :first AND :last AND (:metrics IS NULL OR array_contains(CAST(:metrics AS ARRAY<STRING>), metric))
"""

#: How many runs each scenario has under a condition; null asks for the runs that have none.
RUNS_UNDER = """
SELECT scenario, count(*) AS n, max(id) AS last_id FROM experiment_runs WHERE condition_name <=> :condition GROUP BY scenario
"""

#: The last ``:n`` runs with their datasets' names.
LATEST_RUNS = """
SELECT r.id, r.scenario, r.condition_name, d.name AS dataset_name
FROM (SELECT * FROM experiment_runs ORDER BY id DESC LIMIT :n) r JOIN datasets d ON d.id = r.dataset_id
"""

#: Energy, cost and carbon of each run's steps from ``:first`` to ``:last`` (null: to the end), cooled by ``:share`` of their heat.
ACCOUNTED_STEPS = """
WITH powered AS (
  SELECT run_id, step_index, electricity_price, carbon_intensity_kg_per_kwh, renewable_power_kw,
    it_power(workload) + cooling_power(it_power(workload) * :share, outdoor_temperature_c) + :aux AS power
  FROM simulation_steps WHERE step_index >= :first AND (:last IS NULL OR step_index <= :last)),
drawn AS (SELECT *, power - renewable_used(renewable_power_kw, power) AS grid, renewable_curtailed(renewable_power_kw, power) AS curtailed FROM powered)
SELECT run_id, count(*) AS steps, sum(grid_energy(grid)) AS energy_kwh, sum(energy_cost(grid, electricity_price)) AS energy_cost,
  sum(carbon_mass(grid, carbon_intensity_kg_per_kwh)) AS carbon_kg, sum(curtailed) AS curtailed_kw
FROM drawn GROUP BY run_id
"""

#: Bounds, safe action and next temperature of each step, by the plant and by a scaled model.
BOUNDED_STEPS = """
WITH s AS (
  SELECT run_id, step_index, temp, outdoor_temperature_c AS outdoor, it_power(workload) AS heat, wanted,
    least_cooling(temp, it_power(workload), outdoor_temperature_c) AS least_kw, most_cooling(temp, it_power(workload), outdoor_temperature_c, low => :floor) AS most_kw,
    most_cooling(temp, it_power(workload), outdoor_temperature_c, capacity_scale => :capacity, heat_scale => :heat, cooling_scale => :cooling, low => :floor) AS model_most_kw
  FROM simulation_steps)
SELECT run_id, step_index, least_kw, most_kw, model_most_kw, safe_cooling(wanted, least_kw, most_kw) AS action_kw,
  next_temperature(temp, heat, safe_cooling(wanted, least_kw, most_kw), outdoor, capacity_scale => :capacity, heat_scale => :heat, cooling_scale => :cooling) AS next_c
FROM s
"""
