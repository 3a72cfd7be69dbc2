"""Physics and accounting as column expressions; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Condition, Facility


def num(x: float | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, num(low)), num(high))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def it_power(load: Column, f: Facility) -> Column:
    used = clamp(load / num(f.max_load), 0.0, 1.0)
    return num(f.p_idle_kw) + used * num(f.p_peak_kw - f.p_idle_kw)


def next_temperature(temp: Column, heat: Column, cooling: Column, outdoor: Column, f: Facility, capacity_scale: float = 1.0) -> Column:
    loss = (temp - outdoor) / num(f.thermal_resistance_c_per_kw)
    return temp + num(f.step_hours) * (heat - cooling - loss) / num(f.thermal_capacitance_kwh_per_c * capacity_scale)


def plant_temperature(temp: Column, heat: Column, cooling: Column, outdoor: Column, f: Facility, c: Condition) -> Column:
    return next_temperature(temp, heat * num(c.heat_scale), cooling * num(c.cooling_scale), outdoor, f, c.capacity_scale)


def predicted_temperature(temp: Column, heat: Column, cooling: Column, outdoor: Column, f: Facility, c: Condition) -> Column:
    return next_temperature(temp, heat * num(c.model_heat_scale), cooling * num(c.model_cooling_scale), outdoor, f, c.model_capacity_scale)


def cop(outdoor: Column, f: Facility) -> Column:
    return F.greatest(num(f.cop_min), num(f.cop_base) - num(f.cop_temp_slope) * outdoor)


def cooling_power(cooling: Column, outdoor: Column, f: Facility) -> Column:
    return F.greatest(num(0), cooling) / cop(outdoor, f)


def renewable_used(available: Column, power: Column) -> Column:
    return F.least(F.greatest(num(0), available), F.greatest(num(0), power))


def renewable_curtailed(available: Column, power: Column) -> Column:
    return F.greatest(num(0), available) - renewable_used(available, power)


def grid_energy(grid: Column, f: Facility) -> Column:
    return grid * num(f.step_hours)


def energy_cost(grid: Column, price: Column, f: Facility) -> Column:
    return grid * num(f.step_hours) * price


def carbon_kg(grid: Column, intensity: Column, f: Facility) -> Column:
    return grid * num(f.step_hours) * intensity


def bounds(temp: Column, heat: Column, outdoor: Column, f: Facility, floor: Column | float | None = None) -> tuple[Column, Column]:
    """Least and most cooling that keep the next temperature inside the limits (floor: a higher lower limit)."""
    rate = f.thermal_capacitance_kwh_per_c
    loss = (temp - outdoor) / num(f.thermal_resistance_c_per_kw)
    low_limit = num(f.min_temp_c) if floor is None else F.greatest(num(f.min_temp_c), num(floor))
    least = F.greatest(num(0), heat - loss - (num(f.max_temp_c) - temp) * num(rate) / num(f.step_hours))
    most = F.least(num(f.max_cooling_kw), heat - loss - (low_limit - temp) * num(rate) / num(f.step_hours))
    return least, most


def model_bounds(temp: Column, heat: Column, outdoor: Column, f: Facility, c: Condition, low: float, high: float) -> tuple[Column, Column]:
    """Bounds by the scaled prediction model."""
    rate = f.thermal_capacitance_kwh_per_c * c.model_capacity_scale
    free = heat * num(c.model_heat_scale) - (temp - outdoor) / num(f.thermal_resistance_c_per_kw)
    side = lambda limit: (free - (num(limit) - temp) * num(rate) / num(f.step_hours)) / num(c.model_cooling_scale)
    return F.greatest(num(0), side(high)), F.least(num(f.max_cooling_kw), side(low))


def feasible(least: Column, most: Column) -> Column:
    return least <= most + num(1e-9)


def safe_action(request: Column, least: Column, most: Column, f: Facility) -> Column:
    """The request inside the bounds; where there is none, all cooling or none of it."""
    wanted = clamp(request, 0.0, f.max_cooling_kw)
    return F.when(feasible(least, most), F.least(F.greatest(wanted, least), most)).when(least > num(f.max_cooling_kw), num(f.max_cooling_kw)).otherwise(num(0))


def safe_action_soft_floor(request: Column, temp: Column, heat: Column, outdoor: Column, f: Facility, floor: Column | float) -> tuple[Column, Column, Column]:
    """Action and bounds where the floor only counts if it is compatible with the upper limit."""
    least, most = bounds(temp, heat, outdoor, f)
    by_floor = bounds(temp, heat, outdoor, f, floor)[1]
    upper = F.when(feasible(least, most) & (by_floor >= least), F.least(most, by_floor)).otherwise(most)
    wanted = clamp(request, 0.0, f.max_cooling_kw)
    action = F.when(feasible(least, most), F.least(F.greatest(wanted, least), upper)).when(least > num(f.max_cooling_kw), num(f.max_cooling_kw)).otherwise(num(0))
    return action, least, upper


def grid_of_actions(previous: Column, f: Facility) -> Column:
    """Sorted distinct candidate actions: an even grid over the cooling range, and the action before."""
    n = f.candidate_count
    even = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.round(num(f.max_cooling_kw) * i / num(n - 1), 9))
    return F.array_sort(F.array_distinct(F.concat(even, F.array(F.round(clamp(previous, 0.0, f.max_cooling_kw), 9)))))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b isn't positive."""
    return F.when(b > 0, a / b).otherwise(num(0))


def percent_change(base: Column, other: Column) -> Column:
    """Null where the base is 0."""
    return F.when(base != 0, (other - base) / F.abs(base) * num(100))


def signed(x: Column, places: int) -> Column:
    """Rounded for a signed format; what rounds to zero has no minus."""
    return F.round(x, places) + num(0)


def degradation(ideal: Column, other: Column) -> Column:
    """Text: the change in percent, or the absolute one where ideal is 0."""
    share = signed((other - ideal) / F.abs(F.when(ideal != 0, ideal)) * num(100), 2)
    return F.when(ideal == 0, F.format_string("absolute change %+.4f", signed(other - ideal, 4))).otherwise(F.format_string("%+.2f%%", share))
