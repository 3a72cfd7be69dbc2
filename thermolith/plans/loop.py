"""The closed loop over a table of runs.

Inputs are dealt by run and sorted by step once. In each partition, whole runs of the
same length, controller and condition advance together by numpy (see ``lockstep`` and
``kernel``), and all columns of the inputs go through with them; what
does not depend on the loop's state (heat, power, cost, carbon, diagnostics) is computed
by Spark columns afterwards. A run's own steps can't be split, as each needs the state
of the one before; a run is at most some thousand rows a year, so a hot run is bounded
by time, not by the number of facilities.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CONTROLLERS, Condition, Facility, condition
from ..errors import ConfigurationError, TimeAlignmentError
from ..operators.windows import precool_flag
from .kernel import FLAGS, NUMBERS, Loop
from .lockstep import advance_together, numbers

INPUT = {"load": "workload_fraction", "price": "electricity_price", "ci": "carbon_intensity_kg_per_kwh", "outdoor": "outdoor_temperature_c", "renewable": "renewable_power_kw"}
RESULT = ", ".join(f"{n} double" for n in NUMBERS) + ", evaluations int, " + ", ".join(f"{n} int" for n in FLAGS)


def advance(loop: Loop, table: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """``table``: runs x steps arrays. The same of every output of a step."""
    runs, steps = table["load"].shape
    noise = np.zeros(steps + 1)
    if loop.c.measurement == "gaussian":
        noise = np.random.default_rng(loop.c.noise_seed).normal(0.0, loop.c.noise_std_c, steps + 1)  # draw 0 is of the start
    state = loop.start(runs, np.full(runs, noise[0]))
    reach = loop.f.horizon_steps if loop.controller == "finite_horizon" else 0
    if loop.act is not None:
        reach = getattr(loop.act, "max_forecast_steps", loop.f.horizon_steps)
        if hasattr(loop.act, "reset"):
            loop.act.reset(loop.c.noise_seed)
    outs = []
    for t in range(steps):
        window = {k: table[k][:, t : t + reach] for k in INPUT} if reach else None
        state, out = loop.step(state, {k: v[:, t] for k, v in table.items()}, np.full(runs, noise[t + 1]), window)
        outs.append(out)
    return {k: np.stack([o[k] for o in outs], axis=1) for k in outs[0]}


def simulate(inputs: DataFrame, f: Facility | None = None, conditions: dict[str, Condition] | None = None, controllers: dict | None = None) -> DataFrame:
    """``inputs`` with the outputs of each step.

    ``controllers``: controllers of the caller's own by name (see ``Loop.act``). Each sees the
    forecast of its ``max_forecast_steps`` (a plain function: of ``horizon_steps``) and no
    more, is reset where runs begin if it can be, and goes through the same safety, actuator
    and plant as the others.

    ``inputs``: run_id, step_index, timestamp, the five input columns of a step,
    ``controller`` and ``condition`` (constant in a run), and ``action`` for runs of the
    controller ``external``. Steps of a run must be the fixed step apart.
    """
    f = (f or Facility()).validated()
    known = {n: condition(n) for n in ("ideal", "rate_limited", "mild_mismatch", "rate_limited_mild_mismatch", "combined_nonideal")} | (conditions or {})
    own = controllers or {}
    if "action" not in inputs.columns:
        inputs = inputs.withColumn("action", F.lit(None).cast("double"))
    step_us = f.step_minutes * 60_000_000

    def group(kind: tuple, table, shape) -> dict[str, np.ndarray]:
        name, cond = kind
        if name not in CONTROLLERS and name not in own:
            raise ConfigurationError(f"unknown controller: {name}")
        if cond not in known:
            raise ConfigurationError(f"unknown condition: {cond}")
        at = table.column("__at").to_numpy().reshape(shape)
        if (np.diff(at, axis=1) != step_us).any():
            raise TimeAlignmentError("a run's timestamps are not the fixed step apart")
        columns = {k: numbers(table, c, shape) for k, c in INPUT.items()}
        columns |= {"precool": numbers(table, "__precool", shape).astype(np.int64), "action": numbers(table, "action", shape)}
        out = advance(Loop(f, known[cond].validated(), name, own.get(name)), columns)
        return {n: out[n] for n in NUMBERS} | {n: out[n].astype("int32") for n in ("evaluations", *FLAGS)}

    # One shuffle: the look-ahead window and the loop both go by run and step.
    dealt = precool_flag(inputs.repartition("run_id"), "run_id", f, "__precool").withColumn("__at", F.unix_micros(F.col("timestamp").cast("timestamp")))
    return advance_together(dealt.sortWithinPartitions("run_id", "step_index"), "run_id", ["controller", "condition"], group, RESULT).drop("__precool", "__at")


def runs_of(signals: DataFrame, by: str, scenarios: list[tuple[str, str]], conditions: list[str], f: Facility) -> DataFrame:
    """Inputs of every scenario (controller, dispatch strategy) under every condition, for
    every series: a union over the few strategies, each exploded by the few scenarios and conditions."""
    from ..operators.dispatch import dispatched

    parts = []
    names = [s for s, _ in scenarios]
    for strategy in dict.fromkeys(d for _, d in scenarios):
        served = dispatched(signals, by, strategy, f)
        own = F.array(*[F.struct(F.lit(s).alias("controller"), F.lit(c).alias("condition"), F.lit(names.index(s) * len(conditions) + conditions.index(c)).alias("k")) for s, d in scenarios if d == strategy for c in conditions])
        parts.append(served.withColumn("scenario", F.explode(own)))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    n = len(names) * len(conditions)
    return whole.select(
        (F.col(by).cast("long") * n + F.col("scenario.k")).alias("run_id"), F.col(by), "step_index", "timestamp", "workload_fraction", "electricity_price",
        "carbon_intensity_kg_per_kwh", "outdoor_temperature_c", "renewable_power_kw", "scenario.controller", "scenario.condition", "batch_service",
    )
