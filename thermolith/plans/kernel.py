"""One step of the closed loop for many runs at once.

Every quantity is a numpy array over runs, so a partition's runs advance in lockstep:
the cost of a step is a fixed number of array operations, however many runs there are.
The same step drives the batch plan and the streaming processor.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from ..config import Condition, Facility

EPS = 1e-9


def clip(x, low, high):
    return np.minimum(np.maximum(x, low), high)


@dataclass
class State:
    true: np.ndarray
    measured: np.ndarray
    applied: np.ndarray
    queue: np.ndarray  # runs x delay steps
    proposed: np.ndarray
    mpc_queue: np.ndarray  # the search's own picture of the queue


@dataclass
class Loop:
    """Runs of one controller under one condition."""

    f: Facility
    c: Condition
    controller: str
    #: A controller of the caller's own: (loop, state, inputs, window) to (request, target, floor), arrays over runs;
    #: a function, or an object with ``act_all`` and, if it has them, ``max_forecast_steps`` and ``reset``.
    act: object = None
    alpha: float = field(init=False)

    def __post_init__(self):
        self.alpha = 1.0 - float(np.exp(-self.f.step_minutes / self.c.time_constant_minutes)) if self.c.actuator == "first_order" else 1.0

    def start(self, runs: int, first_noise: np.ndarray) -> State:
        at = lambda v: np.full(runs, float(v))
        first = clip(self.c.initial_applied_kw, 0.0, self.f.max_cooling_kw)
        queue = np.full((runs, self.c.delay_steps if self.c.actuator == "delayed" else 0), first)
        return State(at(self.f.initial_temp_c), at(self.f.initial_temp_c) + first_noise, at(first), queue, at(0.0), queue.copy())

    # Physics -----------------------------------------------------------------------------

    def heat(self, load):
        f = self.f
        return f.p_idle_kw + clip(load / f.max_load, 0.0, 1.0) * (f.p_peak_kw - f.p_idle_kw)

    def next_temperature(self, temp, heat, cooling, outdoor, model: bool):
        c, f = self.c, self.f
        hs, cs, cap = (c.model_heat_scale, c.model_cooling_scale, c.model_capacity_scale) if model else (c.heat_scale, c.cooling_scale, c.capacity_scale)
        loss = (temp - outdoor) / f.thermal_resistance_c_per_kw
        return temp + f.step_hours * (heat * hs - cooling * cs - loss) / (f.thermal_capacitance_kwh_per_c * cap)

    def cooling_power(self, cooling, outdoor):
        return np.maximum(0.0, cooling) / np.maximum(self.f.cop_min, self.f.cop_base - self.f.cop_temp_slope * outdoor)

    # Actuator ----------------------------------------------------------------------------

    def move(self, target, applied, queue):
        """(applied, queue, held up, held down) after one step towards ``target``."""
        c, top = self.c, self.f.max_cooling_kw
        target = clip(target, 0.0, top)
        no = np.zeros(np.shape(target), bool)
        if c.actuator == "ideal":
            return target, queue, no, no
        if c.actuator == "rate_limited":
            upper, lower = np.minimum(top, applied + c.ramp_up_kw), np.maximum(0.0, applied - c.ramp_down_kw)
            return clip(clip(target, lower, upper), 0.0, top), queue, target > upper + EPS, target < lower - EPS
        if c.actuator == "first_order":
            return clip(applied + self.alpha * (target - applied), 0.0, top), queue, no, no
        now = queue[..., 0]
        return clip(now, 0.0, top), np.concatenate([queue[..., 1:], target[..., None]], axis=-1), no, no

    def reach(self, s: State):
        """What one step can bring about: a step's result never falls as its target rises, so the ends are those of no cooling and of all of it."""
        return tuple(self.move(np.full_like(s.applied, end), s.applied, s.queue)[0] for end in (0.0, self.f.max_cooling_kw))

    def aware_target(self, request, s: State, least, most):
        """The target nearest to ``request`` whose result lies in the bounds, and where no result does.

        The result of the request is brought into what is both reachable and allowed; what
        it takes to get there undoes the actuator's lag. A delayed actuator's result is settled already, so its target stands.
        """
        nearest, farthest = self.reach(s)
        low, high = np.maximum(nearest, least), np.minimum(farthest, most)
        unreachable = low > high + EPS
        plain = self.move(request, s.applied, s.queue)[0]
        result = clip(plain, low, high)
        changed = ~unreachable & (np.abs(result - plain) > EPS) if self.c.actuator != "delayed" else np.zeros_like(unreachable)
        lagged = s.applied + (result - s.applied) / self.alpha if self.alpha < 1.0 else result
        return clip(np.where(changed, lagged, request), 0.0, self.f.max_cooling_kw), unreachable

    # Controllers -------------------------------------------------------------------------

    def feedback(self, measured, heat, outdoor, target):
        f = self.f
        forward = heat - (target - outdoor) / f.thermal_resistance_c_per_kw
        off = measured - target
        gain = f.temperature_feedback_gain_kw_per_c
        back = np.where(off > f.deadband_c, gain * (off - f.deadband_c), np.where(off < -f.deadband_c, gain * (off + f.deadband_c), 0.0))
        return clip(forward + back, 0.0, f.max_cooling_kw)

    def search(self, s: State, window: dict[str, np.ndarray]):
        """Beam search over the forecast (runs x horizon); (first action, found, evaluations, four objective parts)."""
        f, runs = self.f, len(s.true)
        width, top = f.beam_width, f.max_cooling_kw
        depth = s.queue.shape[1]
        temp, applied = s.measured[:, None], s.applied[:, None]
        queue = s.mpc_queue[:, None, :]
        first = np.full((runs, 1), np.nan)
        parts = np.zeros((runs, 1, 4))
        live = np.ones((runs, 1), bool)
        evaluations = np.zeros(runs, np.int64)
        even = np.round(np.linspace(0.0, top, f.candidate_count), 9)
        rows = np.arange(runs)[:, None]
        for k in range(window["price"].shape[1]):
            price, intensity, outdoor, sun, load = (window[n][:, k][:, None, None] for n in ("price", "ci", "outdoor", "renewable", "load"))
            heat = self.heat(load)
            plans = temp.shape[1]
            actions = np.concatenate([np.broadcast_to(even, (runs, plans, len(even))), np.round(clip(applied, 0.0, top), 9)[..., None]], axis=2)
            actions = np.sort(actions, axis=2)
            real = np.ones(actions.shape, bool)
            real[..., 1:] = actions[..., 1:] != actions[..., :-1]
            real &= live[..., None]
            evaluations += real.sum((1, 2))
            before = np.broadcast_to(applied[..., None], actions.shape)
            waiting = np.broadcast_to(queue[:, :, None, :], (*actions.shape, depth))
            now, after, _, _ = self.move(actions, before, waiting)
            then = self.next_temperature(temp[..., None], heat, now, outdoor, True)
            real &= (then >= f.mpc_floor_c - EPS) & (then <= f.max_temp_c + EPS)
            power = heat + self.cooling_power(now, outdoor) + f.p_aux_kw
            energy = (power - np.minimum(sun, power)) * f.step_hours
            added = np.stack([f.cost_weight * price * energy, f.carbon_weight * intensity * energy, f.temperature_weight * (then - f.setpoint_temp_c) ** 2, f.movement_weight * ((now - before) / top) ** 2], axis=-1)
            total = parts[:, :, None, :] + added
            score = ((total[..., 0] + total[..., 1]) + total[..., 2]) + total[..., 3]
            flat = np.where(real, score, np.inf).reshape(runs, -1)
            best = np.argsort(flat, axis=1, kind="stable")[:, :width]
            live = np.isfinite(flat[rows, best])
            start = actions if k == 0 else np.broadcast_to(first[..., None], actions.shape)
            first = start.reshape(runs, -1)[rows, best]
            temp, applied = then.reshape(runs, -1)[rows, best], now.reshape(runs, -1)[rows, best]
            queue = after.reshape(runs, flat.shape[1], depth)[rows, best]
            parts = total.reshape(runs, -1, 4)[rows, best]
        return first[:, 0], live[:, 0], evaluations, parts[:, 0]

    # The step ----------------------------------------------------------------------------

    def step(self, s: State, x: dict[str, np.ndarray], noise: np.ndarray, window: dict[str, np.ndarray] | None = None) -> tuple[State, dict[str, np.ndarray]]:
        """``x``: load, price, ci, outdoor, renewable, and precool (0/1) or action by controller."""
        f, runs = self.f, len(s.true)
        heat = self.heat(x["load"])
        at = lambda v: np.full(runs, v)
        out: dict[str, np.ndarray] = {k: at(False) for k in ("attempted", "success", "fallback", "prediction_infeasible")}
        out |= {k: at(np.nan) for k in ("objective_total", "objective_energy_cost", "objective_carbon", "objective_temperature", "objective_control_movement")}
        out["evaluations"] = np.zeros(runs, np.int64)
        target, floor, cold = at(f.setpoint_temp_c), at(f.min_temp_c), at(False)
        next_mpc = s.mpc_queue
        if self.act is not None:
            proposed, target, floor = (self.act if callable(self.act) else self.act.act_all)(self, s, x, window)
        elif self.controller == "external":
            proposed, target, floor = x["action"].astype(float), at(np.nan), at(np.nan)
        elif self.controller == "finite_horizon":
            s.mpc_queue = s.mpc_queue if s.mpc_queue.shape[1] else s.queue
            action, found, evaluations, parts = self.search(s, window)
            plain = self.feedback(s.measured, heat, x["outdoor"], target)
            proposed = np.where(found, action, plain)
            floor = np.where(found, f.mpc_floor_c, f.min_temp_c)
            out |= {"attempted": at(True), "success": found, "fallback": ~found, "prediction_infeasible": ~found, "evaluations": np.where(found, evaluations, 0)}
            for i, k in enumerate(("objective_energy_cost", "objective_carbon", "objective_temperature", "objective_control_movement")):
                out[k] = np.where(found, parts[:, i], np.nan)
            out["objective_total"] = np.where(found, ((parts[:, 0] + parts[:, 1]) + parts[:, 2]) + parts[:, 3], np.nan)
            if s.mpc_queue.shape[1]:
                next_mpc = np.where(found[:, None], self.move(action, s.applied, s.mpc_queue)[1], s.mpc_queue)
        else:
            if self.controller == "heuristic":
                cold = x["precool"].astype(bool)
                target = np.where(cold, max(f.precool_floor_c, f.setpoint_temp_c - f.max_precool_delta_c), target)
                floor = np.where(cold, f.precool_floor_c, floor)
            proposed = self.feedback(s.measured, heat, x["outdoor"], target)

        loss = (s.measured - x["outdoor"]) / f.thermal_resistance_c_per_kw
        low_limit = np.where(np.isnan(floor), f.min_temp_c, np.fmax(f.min_temp_c, floor))
        least = np.maximum(0.0, heat - loss - (f.max_temp_c - s.measured) * f.thermal_capacitance_kwh_per_c / f.step_hours)
        most = np.minimum(f.max_cooling_kw, heat - loss - (low_limit - s.measured) * f.thermal_capacitance_kwh_per_c / f.step_hours)
        possible = least <= most + EPS
        safe = np.where(possible, clip(clip(proposed, 0.0, f.max_cooling_kw), least, most), np.where(least > f.max_cooling_kw, f.max_cooling_kw, 0.0))
        goal, unreachable = self.aware_target(safe, s, least, most)
        applied, queue, up, down = self.move(goal, s.applied, s.queue)
        true = self.next_temperature(s.true, heat, applied, x["outdoor"], False)
        predicted = self.next_temperature(s.measured, heat, applied, x["outdoor"], True)
        measured = true + noise
        out |= {
            "prev_temp_c": s.true, "prev_proposed_kw": s.proposed, "prev_applied_kw": s.applied, "controller_measured_temperature_c": s.measured,
            "proposed_cooling_kw": proposed, "constrained_cooling_kw": goal, "applied_cooling_kw": applied, "true_temperature_c": true,
            "measured_temperature_c": measured, "predicted_next_temperature_c": predicted, "cooling_min_feasible_kw": least, "cooling_max_feasible_kw": most,
            "intervention_kw": np.abs(safe - proposed), "thermal_infeasible": ~possible, "unreachable": unreachable, "ramp_up": up, "ramp_down": down,
            "tracking_kw": np.abs(clip(goal, 0.0, f.max_cooling_kw) - applied), "alpha": at(self.alpha), "target_c": target, "floor_c": floor, "precooling": cold,
        }
        return State(true, measured, applied, queue, proposed, next_mpc), out


#: What a step gives, and its Spark types.
FLAGS = ("attempted", "success", "fallback", "prediction_infeasible", "thermal_infeasible", "unreachable", "ramp_up", "ramp_down", "precooling")
NUMBERS = (
    "prev_temp_c", "prev_proposed_kw", "prev_applied_kw", "controller_measured_temperature_c", "proposed_cooling_kw", "constrained_cooling_kw", "applied_cooling_kw",
    "true_temperature_c", "measured_temperature_c", "predicted_next_temperature_c", "cooling_min_feasible_kw", "cooling_max_feasible_kw", "intervention_kw", "tracking_kw",
    "alpha", "target_c", "floor_c", "objective_total", "objective_energy_cost", "objective_carbon", "objective_temperature", "objective_control_movement",
)
