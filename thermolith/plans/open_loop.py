"""The beam search as a fold: a series' levels are one array, the beam is another, sorted and of bounded size.

Each level makes of every plan one for each candidate action, drops what leaves the
temperature limits, and keeps the best ``beam_width`` by (total, place of the plan, action). Ideal actuator and perfect model.
All of it is one aggregate by series; no row is joined or exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Facility
from ..functions import physics as P

#: What is carried of a plan, in the order in which plans are sorted.
_PLAN = ("total", "place", "applied", "temp", "first", "cost", "carbon", "comfort", "move")


def _plan(**x: Column) -> Column:
    return F.struct(*(F.coalesce(x[n], F.lit(0)).cast("int").alias(n) if n == "place" else x[n].cast("double").alias(n) for n in _PLAN))


def _grown(plans: Column, at: Column, f: Facility) -> Column:
    """The next beam, from this one and what the level is."""
    n = P.num
    tried = F.flatten(F.transform(plans, lambda p, i: F.transform(P.grid_of_actions(p["applied"], f), lambda a: F.struct(p.alias("p"), i.alias("i"), a.alias("a")))))
    ended = F.transform(tried, lambda t: F.struct(t["p"].alias("p"), t["i"].alias("i"), t["a"].alias("a"), P.next_temperature(t["p"]["temp"], at["heat"], t["a"], at["outdoor"], f).alias("then")))
    kept = F.filter(ended, lambda t: (t["then"] >= f.mpc_floor_c - 1e-9) & (t["then"] <= f.max_temp_c + 1e-9))

    def energy(t: Column) -> Column:
        power = at["heat"] + P.cooling_power(t["a"], at["outdoor"], f) + n(f.p_aux_kw)
        return (power - F.least(at["renewable"], power)) * n(f.step_hours)

    priced = F.transform(kept, lambda t: F.struct(t["p"].alias("p"), t["i"].alias("i"), t["a"].alias("a"), t["then"].alias("then"), energy(t).alias("energy"), ((t["a"] - t["p"]["applied"]) / n(f.max_cooling_kw)).alias("step")))

    def scored(t: Column) -> Column:
        p, off = t["p"], t["then"] - n(f.setpoint_temp_c)
        cost, carbon = p["cost"] + n(f.cost_weight) * at["price"] * t["energy"], p["carbon"] + n(f.carbon_weight) * at["intensity"] * t["energy"]
        comfort, move = p["comfort"] + n(f.temperature_weight) * (off * off), p["move"] + n(f.movement_weight) * (t["step"] * t["step"])
        return _plan(total=((cost + carbon) + comfort) + move, place=t["i"], applied=t["a"], temp=t["then"], first=F.coalesce(p["first"], t["a"]), cost=cost, carbon=carbon, comfort=comfort, move=move)

    return F.slice(F.array_sort(F.transform(priced, scored)), 1, f.beam_width)


def solve(inputs: DataFrame, by: str, f: Facility, first_step: int = 0) -> DataFrame:
    """(by, first_action, objective parts and total, last temperature) of the best plan from ``first_step`` on;
    series that end before the horizon, or have no plan inside the limits, have none."""
    zero = F.lit(0.0)
    level = F.struct(
        "step_index", P.it_power(F.col("workload_fraction"), f).alias("heat"), F.col("electricity_price").alias("price"), F.col("carbon_intensity_kg_per_kwh").alias("intensity"),
        F.col("outdoor_temperature_c").alias("outdoor"), F.col("renewable_power_kw").alias("renewable"),
    )
    ahead = inputs.where(F.col("step_index").between(first_step, first_step + f.horizon_steps - 1)).groupBy(by).agg(F.array_sort(F.collect_list(level)).alias("levels"))
    start = F.array(_plan(total=zero, place=F.lit(0), applied=zero, temp=F.lit(f.initial_temp_c), first=F.lit(None), cost=zero, carbon=zero, comfort=zero, move=zero))
    beam = ahead.where(F.size("levels") == f.horizon_steps).select(by, F.get(F.aggregate("levels", start, lambda plans, at: _grown(plans, at, f)), F.lit(0)).alias("best"))
    return beam.where("best IS NOT NULL").select(by, F.col("best.first").alias("first_action"), *[f"best.{c}" for c in ("cost", "carbon", "comfort", "move", "total", "temp")])
