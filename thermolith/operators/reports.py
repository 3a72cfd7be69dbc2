"""Health, comparison, degradation and coordination reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import physics as P
from . import windows as W
from .blocks import TwoLevels

HEALTH_VALUES = ("total_load", "it_power_kw", "heat_kw", "cooling_power_kw", "grid_power_kw", "temp_c")


def health(results: DataFrame, metrics: DataFrame, runs: DataFrame, inputs: DataFrame) -> DataFrame:
    """Nine counters for each of ``runs`` (run_id, dataset_id): three grouped aggregates joined, no query per run."""
    bad = F.lit(False)
    for c in HEALTH_VALUES:
        bad = bad | F.isnan(c) | (F.abs(c) > 1e308)
    negative = F.lit(False)
    for c in ("it_power_kw", "heat_kw", "cooling_power_kw", "grid_power_kw"):
        negative = negative | (F.col(c) < -1e-9)
    flag = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    steps = results.groupBy("run_id").agg(
        F.count("*").alias("steps"), F.countDistinct("timestamp").alias("distinct_steps"), F.count_if(bad).alias("invalid_values"), F.count_if(negative).alias("negative_power"),
        flag("temperature_violation").alias("temperature_violations"), flag("thermal_infeasible").alias("thermal_infeasible"), flag("cooling_constraint_intervention").alias("cooling_interventions"),
    )
    named = metrics.groupBy("run_id").agg(F.count("*").alias("metrics"))
    expected = inputs.groupBy("dataset_id").agg(F.count("*").alias("expected"))
    d = runs.select("run_id", "dataset_id").join(steps, "run_id", "left").join(named, "run_id", "left").join(expected, "dataset_id", "left").na.fill(0)
    zero = F.lit(0).cast("long")
    return d.select(
        "run_id", "steps", "metrics", "invalid_values", "negative_power", F.greatest(zero, F.col("expected") - F.col("steps")).alias("missing_steps"),
        F.greatest(zero, F.col("steps") - F.col("distinct_steps")).alias("duplicate_steps"), "temperature_violations", "thermal_infeasible", "cooling_interventions",
    )


def latest_runs(runs: DataFrame, datasets: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` runs with their dataset's name: a top-n before the join."""
    last = runs.orderBy(F.col("id").desc()).limit(n)
    return last.join(datasets.select(F.col("id").alias("dataset_id"), F.col("name").alias("dataset_name")), "dataset_id").orderBy(F.col("id").desc())


def comparison(metrics: DataFrame, group: str = "center", scenarios=("baseline", "heuristic", "finite_horizon"), base: str = "baseline") -> DataFrame:
    """Rows (group, metric), a column for each scenario, and the percent change of each against ``base``."""
    one = metrics.groupBy(group, "metric").pivot("controller", list(scenarios)).agg(F.first("value"))
    return one.select(group, "metric", *scenarios, *[P.percent_change(F.col(base), F.col(s)).alias(f"{s}_change_pct") for s in scenarios if s != base])


def shown(x: Column) -> Column:
    """Four places, or the word for a missing value."""
    return F.when(x.isNull(), "missing").otherwise(F.format_string("%.4f", x))


def _value(who: str, metric: str) -> Column:
    return F.max(F.when((F.col("controller") == who) & (F.col("metric") == metric), F.col("value")))


def _verdicts(base: str, best: str) -> list[Column]:
    """PASS or FAIL of each test, as aggregates over the metrics of a group."""
    n = F.size(F.collect_set("controller"))  # as many as there are scenarios
    holds = lambda m, ok: F.count_if((F.col("metric") == m) & ok) == n
    v = F.col("value")
    verdict = lambda ok: F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("FAIL")
    return [
        verdict(F.round(_value(best, "energy_cost"), 9) < F.round(_value(base, "energy_cost"), 9)).alias("economic"),
        verdict(F.round(_value(best, "carbon_kg"), 9) <= F.round(_value(base, "carbon_kg"), 9)).alias("carbon"),
        verdict(holds("temperature_violation_count", v == 0) & holds("thermal_infeasibility_count", v == 0)).alias("thermal"),
        verdict(holds("invalid_value_count", v == 0) & holds("max_abs_power_balance_error", v <= 1e-9) & holds("max_abs_renewable_balance_error", v <= 1e-9)).alias("numerical"),
    ]


def acceptance(metrics: DataFrame, group: str = "center", base: str = "baseline", best: str = "finite_horizon") -> DataFrame:
    """PASS or FAIL by group; a missing metric fails its test. ``metrics``: (group, controller, metric, value).
    Sums are compared to nine places, so that equal runs tie whatever the order they were added in."""
    return metrics.groupBy(group).agg(*_verdicts(base, best))


def degradation_matrix(metrics: DataFrame, names: list[str], group: str = "center") -> DataFrame:
    """(group, controller, condition, metric, value, degradation) against the same controller's ideal run; a missing value is 0.
    One aggregate makes a row of each run, one window over a controller's few runs finds the ideal one."""
    value = lambda n: F.coalesce(F.max(F.when(F.col("metric") == n, F.col("value"))), F.lit(0.0))
    runs = metrics.groupBy(group, "controller", "condition").agg(*[value(n).alias(f"__{i}") for i, n in enumerate(names)])
    ideal = lambda c: F.coalesce(F.max(F.when(F.col("condition") == "ideal", F.col(c))).over(Window.partitionBy(group, "controller")), F.lit(0.0))
    each = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"__{i}").alias("value"), F.col(f"__ideal{i}").alias("ideal")) for i, n in enumerate(names)])
    both = runs.withColumns({f"__ideal{i}": ideal(f"__{i}") for i in range(len(names))}).select(group, "controller", "condition", F.explode(each).alias("m"))
    return both.select(group, "controller", "condition", "m.metric", "m.value", P.degradation(F.col("m.ideal"), F.col("m.value")).alias("degradation"))


def safety_margin(records: DataFrame, by: str = "run_id") -> DataFrame:
    """The step with the smallest distance to either temperature limit."""
    margin = F.least(F.col("temp_c") - F.col("temp_min_c"), F.col("temp_max_c") - F.col("temp_c"))
    return W.extreme(records.withColumn("margin_c", margin), by, F.col("margin_c"), ["step_index", "temp_c", "margin_c"], largest=False)


def fixed_width(df: DataFrame, columns: list[tuple[str, int]]) -> DataFrame:
    """One line of text a row; numbers right-aligned with four places, other values left-aligned."""
    cells = [F.lpad(shown(F.col(c)), w, " ") if df.schema[c].dataType.typeName() == "double" else F.rpad(F.col(c).cast("string"), w, " ") for c, w in columns]
    return df.select(F.concat(*cells).alias("line"))


#: What an event shows, and the four events with their causes.
EVENT_COLUMNS = ("timestamp", "true_temperature_c", "measured_temperature_c", "predicted_next_temperature_c", "proposed_cooling_kw", "constrained_cooling_kw", "applied_cooling_kw", "electricity_price", "carbon_intensity_kg_per_kwh", "outdoor_temperature_c", "renewable_available_kw")
EVENTS = {
    "maximum prediction error": (lambda: F.abs("one_step_temperature_prediction_error_c"), "model and plant differ, and the measurement is noisy"),
    "maximum actuator tracking error": (lambda: F.col("actuator_tracking_error_kw"), "the actuator cannot follow its target at once"),
    "smallest thermal safety margin": (lambda: -F.least(F.col("true_temperature_c") - F.col("temp_min_c"), F.col("temp_max_c") - F.col("true_temperature_c")), "the temperature is nearest to one of its limits"),
    "maximum applied action change": (lambda: F.col("applied_control_movement_kw"), "the largest movement of the actuator between two steps"),
}


def events(records: DataFrame, by: str = "run_id") -> DataFrame:
    """(by, event, step_index, columns of the step, cause): the four extreme steps of each run, the first of equal ones; one aggregate."""
    row = F.struct("step_index", *EVENT_COLUMNS)
    rank = lambda key: F.struct(key.alias("k"), (-F.col("step_index")).alias("i"))
    found = records.groupBy(by).agg(*[F.max_by(row, rank(key())).alias(f"e{i}") for i, (key, _) in enumerate(EVENTS.values())])
    each = F.array(*[F.struct(F.lit(name).alias("event"), F.col(f"e{i}").alias("row"), F.lit(cause).alias("cause")) for i, (name, (_, cause)) in enumerate(EVENTS.items())])
    return found.select(by, F.explode(each).alias("e")).select(by, "e.event", "e.row.*", "e.cause")


def thermal(records: DataFrame, by: str = "run_id") -> DataFrame:
    """Steps outside of the limits, their longest stretches, and the extreme temperatures of each run."""
    below, above = F.col("temp_c") < F.col("temp_min_c"), F.col("temp_c") > F.col("temp_max_c")
    t = TwoLevels()
    return t.of(records, by, {
        "below_min_count": t.count_if(below), "above_max_count": t.count_if(above), "longest_below_min_streak": t.longest_streak(below), "longest_above_max_streak": t.longest_streak(above),
        "minimum_temperature": t.min("temp_c"), "maximum_temperature": t.max("temp_c"),
    })


def head(records: DataFrame, by: str, columns: list[str], n: int = 12) -> DataFrame:
    """The first ``n`` steps of each run."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy("step_index"))
    return records.select(by, "step_index", *columns, nth.alias("__nth")).where(F.col("__nth") <= n).drop("__nth")


#: Metrics of the comparison, with their labels, in order.
LABELS = {
    "energy_cost": "Energy cost", "carbon_kg": "Carbon (kg)", "total_grid_energy_kwh": "Grid energy (kWh)", "cooling_energy_kwh": "Cooling energy (kWh)", "renewable_utilization_rate": "Renewable utilization",
    "peak_grid_power_kw": "Peak grid power (kW)", "average_temperature_c": "Average temperature (C)", "temperature_violation_count": "Temperature violations", "thermal_infeasibility_count": "Thermal infeasibility",
}


def comparison_lines(metrics: DataFrame, group: str = "center", scenarios=("baseline", "heuristic", "finite_horizon"), base: str = "baseline", best: str = "finite_horizon") -> DataFrame:
    """(group, line_no, line): a table of the metrics in fixed widths, then the conclusions.

    ``metrics``: (group, controller, metric, value). Where any scenario lacks a metric, its
    whole line says so. One aggregate by group has all values and verdicts; the lines are an array.
    """
    values = F.array(*[F.array(*[_value(s, m) for s in scenarios]) for m in LABELS])
    rates = F.array(*[_value(s, "renewable_utilization_rate") for s in scenarios])
    change = P.percent_change(_value(base, "energy_cost"), _value(best, "energy_cost"))
    one = metrics.groupBy(group).agg(values.alias("__values"), rates.alias("__rates"), change.alias("__change"), *_verdicts(base, best))
    share = lambda x: F.format_string("%.2f%%", F.round(F.coalesce(x, F.lit(0.0)) * 100, 2) + F.lit(0.0))
    lines = []
    for i, label in enumerate(LABELS.values()):
        own = F.col("__values")[i]
        cell = lambda k, own=own: F.lpad(F.when(F.exists(own, F.isnull), "missing").otherwise(F.format_string("%.4f", F.round(own[k], 4) + F.lit(0.0))), 16, " ")
        lines.append(F.concat(F.rpad(F.lit(label), 30, " "), *[cell(k) for k in range(len(scenarios))]))
    changed = F.when(F.col("__change").isNull(), "missing").otherwise(F.format_string("%.2f%%", P.signed(F.col("__change"), 2)))
    lines += [
        F.concat(F.lit("Economic improvement: "), "economic"), F.concat(F.lit("Carbon improvement: "), "carbon"), F.concat(F.lit("Thermal feasibility: "), "thermal"),
        F.concat(F.lit("Renewable utilization: "), F.concat_ws(", ", *[F.concat(F.lit(f"{s}="), share(F.col("__rates")[k])) for k, s in enumerate(scenarios)])),
        F.concat(F.lit("Numerical validity: "), "numerical"), F.concat(F.lit(f"{best} vs {base} cost: "), changed),
    ]
    return one.select(group, F.posexplode(F.array(*lines)).alias("k", "line")).select(group, F.col("k").cast("int").alias("line_no"), "line")
