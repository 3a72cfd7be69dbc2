"""The engine's queries over the driver's tables: (spark, folder) to a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import CONDITION_TABLE, Condition, Facility, condition
from .functions import physics as P
from .operators import blocks, contracts, dispatch, metrics, records, reports, sqltext
from .operators import windows as W
from .operators.store import RunStore, clustered, last_version, widened
from .plans import loop, open_loop
from .sources import signals as S
from .streaming import events as stream_events
from .streaming import loop as live
from .streaming import sink

FAC = Facility()
#: The four actuators alone, as conditions of their own.
ACTUATORS = {f"act_{a}": Condition(f"act_{a}", a) for a in ("ideal", "rate_limited", "first_order", "delayed")}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sig(spark: SparkSession, folder: str) -> DataFrame:
    return S.from_events(read(spark, folder, "events"))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to fixed places, without negative zeros: the form that queries return."""
    return df.select(*[(F.round(c, places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _inputs(spark, folder, strategy="immediate") -> DataFrame:
    return dispatch.dispatched(sig(spark, folder), "center", strategy, FAC).withColumn("run_id", F.col("center").cast("long"))


def _simulated(spark, folder, controller="baseline", cond="ideal", strategy="immediate", extra=None) -> DataFrame:
    ready = _inputs(spark, folder, strategy).withColumns({"controller": F.lit(controller), "condition": F.lit(cond)} | (extra or {}))
    return loop.simulate(ready, FAC, ACTUATORS)


LOOP = ("center", "step_index", "proposed_cooling_kw", "constrained_cooling_kw", "applied_cooling_kw", "true_temperature_c", "predicted_next_temperature_c", "cooling_min_feasible_kw", "cooling_max_feasible_kw")


def _loop(spark, folder, **options) -> DataFrame:
    return rounded(_simulated(spark, folder, **options).select(*LOOP))


def signals_canonical(s, d):
    return rounded(sig(s, d))


def signals_whole_span(s, d):
    """The signals of all days that have events, whichever these are."""
    events = read(s, d, "events")
    return rounded(S.from_events(events, **S.span_of(events)))


def signals_legacy_normalized(s, d):
    keep = S.legacy(sig(s, d)).withColumn("timestamp", F.col("timestamp"))
    return rounded(S.normalized(keep))


def signals_legacy_roundtrip(s, d):
    return rounded(S.legacy(S.normalized(S.legacy(sig(s, d)))))


def signal_quality(s, d):
    return S.quality(sig(s, d), "center")


def step_gap_check(s, d):
    """Gaps between the slots of each day that have events."""
    return S.quality(sig(s, d).where(F.col("online_workload") > 0.22), "center").select("center", "n_steps", "gaps")


def duplicate_steps(s, d):
    """Hours of each user as bitmaps: exact, of fixed size for so many hours, and merged before the shuffle."""
    hour = F.unix_micros(F.date_trunc("hour", "ts").cast("timestamp")) / F.lit(3_600_000_000)
    e = read(s, d, "events").select("user_id", F.floor(hour).alias("hour"))
    return W.distinct_numbers(e, ["user_id"], "hour").select("user_id", F.col("rows").alias("steps"), F.col("distinct").alias("distinct_steps"), F.greatest(F.lit(0).cast("long"), F.col("rows") - F.col("distinct")).alias("duplicate_steps"))


def dataset_metadata(s, d):
    return S.metadata(sig(s, d), "center")


def it_power(s, d):
    return rounded(sig(s, d).select("center", "step_index", P.it_power(F.col("online_workload") + F.col("batch_workload"), FAC).alias("it_power_kw")))


def cooling_cop_power(s, d):
    cool = F.col("online_workload") * 300.0 - 90.0
    return rounded(sig(s, d).select("center", "step_index", P.cop(F.col("outdoor_temperature_c"), FAC).alias("cop"), P.cooling_power(cool, F.col("outdoor_temperature_c"), FAC).alias("cooling_power_kw")))


def renewable_alloc(s, d):
    have, need = F.col("renewable_power_kw") - 20.0, F.col("online_workload") * 400.0
    return rounded(sig(s, d).select("center", "step_index", P.renewable_used(have, need).alias("used_kw"), P.renewable_curtailed(have, need).alias("curtailed_kw")))


def energy_accounting(s, d):
    """Energy, cost and carbon by center with half of the heat's cooling: the flagship query."""
    heat = P.it_power(F.col("online_workload") + F.col("batch_workload"), FAC)
    x = sig(s, d).withColumn("heat", heat).withColumn("power", F.col("heat") + P.cooling_power(F.col("heat") * 0.5, F.col("outdoor_temperature_c"), FAC) + P.num(FAC.p_aux_kw))
    x = x.withColumn("grid", F.col("power") - P.renewable_used(F.col("renewable_power_kw"), F.col("power")))
    return rounded(x.groupBy("center").agg(
        F.sum(P.grid_energy(F.col("grid"), FAC)).alias("energy_kwh"), F.sum(P.energy_cost(F.col("grid"), F.col("electricity_price"), FAC)).alias("energy_cost"),
        F.sum(P.carbon_kg(F.col("grid"), F.col("carbon_intensity_kg_per_kwh"), FAC)).alias("carbon_kg"), F.max("grid").alias("peak_grid_kw"),
    ))


def _state(s, d) -> DataFrame:
    """A temperature and a request for each step, to try the state-free operators on."""
    return sig(s, d).select("*", (F.lit(17.0) + F.col("online_workload") * 20.0).alias("t"), (F.col("electricity_price") * 400.0 - 60.0).alias("request"), P.it_power(F.col("online_workload"), FAC).alias("heat"))


def plant_step(s, d):
    c = condition("mild_mismatch")
    x = _state(s, d).withColumn("q", P.clamp(F.col("request"), 0.0, FAC.max_cooling_kw))
    return rounded(x.select("center", "step_index", P.plant_temperature(F.col("t"), F.col("heat"), F.col("q"), F.col("outdoor_temperature_c"), FAC, c).alias("next_c"), P.predicted_temperature(F.col("t"), F.col("heat"), F.col("q"), F.col("outdoor_temperature_c"), FAC, c).alias("predicted_c")))


def feasible_bounds(s, d):
    least, most = P.bounds(F.col("t"), F.col("heat"), F.col("outdoor_temperature_c"), FAC)
    return rounded(_state(s, d).select("center", "step_index", least.alias("least_kw"), most.alias("most_kw"), P.feasible(least, most).cast("int").alias("feasible")))


def model_bounds(s, d):
    c = Condition("m", model_capacity_scale=1.12, model_heat_scale=0.9, model_cooling_scale=1.12)
    least, most = P.model_bounds(F.col("t"), F.col("heat"), F.col("outdoor_temperature_c"), FAC, c, 20.5, 32.0)
    return rounded(_state(s, d).select("center", "step_index", least.alias("least_kw"), most.alias("most_kw")))


def safety_clamp(s, d):
    least, most = P.bounds(F.col("t"), F.col("heat"), F.col("outdoor_temperature_c"), FAC, 20.5)
    act = P.safe_action(F.col("request"), least, most, FAC)
    return rounded(_state(s, d).select("center", "step_index", act.alias("action_kw"), F.abs(act - F.col("request")).alias("intervention_kw")))


def safety_clamp_legacy(s, d):
    act, least, most = P.safe_action_soft_floor(F.col("request"), F.col("t"), F.col("heat"), F.col("outdoor_temperature_c"), FAC, 20.5)
    return rounded(_state(s, d).select("center", "step_index", act.alias("action_kw"), least.alias("least_kw"), most.alias("most_kw")))


def forecast_window_array(s, d):
    """The forecast's length, first and last price, and mean price at each step."""
    x = W.forecast(sig(s, d), "center", 8, ["electricity_price"])
    prices = F.transform("forecast", lambda w: w["electricity_price"])
    total = F.aggregate(prices, F.lit(0.0), lambda a, b: a + b)
    return rounded(x.select("center", "step_index", F.size("forecast").alias("n"), F.element_at(prices, 1).alias("first"), F.element_at(prices, -1).alias("last"), (total / F.size("forecast")).alias("mean")))


def forward_min_price(s, d):
    return rounded(W.forward_min_price(sig(s, d), "center", 8).select("center", "step_index", "forward_min_price", W.steps_left("center").alias("steps_left")))


def precool_flag(s, d):
    return W.precool_flag(sig(s, d), "center", FAC).select("center", "step_index", "precool")


def dispatch_immediate(s, d):
    return rounded(dispatch.immediate(sig(s, d)).select("center", "step_index", "batch_service"))


def dispatch_price_aware(s, d):
    return rounded(dispatch.price_aware(sig(s, d), "center", FAC).select("center", "step_index", "batch_service", "backlog"))


def workload_fraction(s, d):
    return rounded(dispatch.dispatched(sig(s, d), "center", "price_aware_temporal_shift", FAC).select("center", "step_index", "workload_fraction"))


def actuator_ideal(s, d):
    return _loop(s, d, cond="act_ideal")


def actuator_rate_limited(s, d):
    return _loop(s, d, cond="act_rate_limited")


def actuator_first_order(s, d):
    return _loop(s, d, cond="act_first_order")


def actuator_delayed(s, d):
    return _loop(s, d, cond="act_delayed")


def loop_baseline(s, d):
    return _loop(s, d)


def loop_heuristic(s, d):
    return _loop(s, d, controller="heuristic", strategy="price_aware_temporal_shift")


def loop_external_action(s, d):
    return _loop(s, d, controller="external", extra={"action": F.lit(60.0) + F.col("online_workload") * 150.0})


def loop_finite_horizon(s, d):
    return _loop(s, d, controller="finite_horizon")


def measurement_noise(s, d):
    return rounded(_simulated(s, d, cond="combined_nonideal").select("center", "step_index", "true_temperature_c", "measured_temperature_c"))


def mpc_open_loop_solve(s, d):
    return rounded(open_loop.solve(_inputs(s, d), "center", FAC, 32))


SCENARIOS = [("baseline", "immediate"), ("heuristic", "price_aware_temporal_shift"), ("finite_horizon", "immediate")]
FEEDBACK = SCENARIOS[:2]


def _matrix(s, d, scenarios=FEEDBACK, conditions=("ideal", "rate_limited", "mild_mismatch", "rate_limited_mild_mismatch")) -> DataFrame:
    return records.records(loop.simulate(loop.runs_of(sig(s, d), "center", scenarios, list(conditions), FAC), FAC), FAC)


def _totals(rec: DataFrame) -> DataFrame:
    return rec.groupBy("center", "controller", "condition").agg(F.sum("energy_cost_step").alias("energy_cost"), F.sum("carbon_kg_step").alias("carbon_kg"), F.max("temp_c").alias("max_temp_c"), F.sum("grid_energy_kwh").alias("grid_kwh"))


def robustness_matrix(s, d):
    return rounded(_totals(_matrix(s, d)), 5)


def robustness_matrix_full(s, d):
    """All 15 combinations, the noisy ones and the search among them, as one job."""
    return rounded(_totals(_matrix(s, d, SCENARIOS, [c[0] for c in CONDITION_TABLE])), 5)


def _records(s, d) -> DataFrame:
    return records.records(_simulated(s, d, controller="heuristic", cond="rate_limited_mild_mismatch", strategy="price_aware_temporal_shift"), FAC)


def step_records(s, d):
    return rounded(_records(s, d).drop("run_id", "controller", "condition"))


def control_movement(s, d):
    return rounded(_simulated(s, d).select("center", "step_index", W.movement("proposed_cooling_kw", "run_id").alias("proposed_movement_kw"), W.movement("applied_cooling_kw", "run_id").alias("applied_movement_kw")))


def step_change(s, d):
    return rounded(_simulated(s, d).select("center", "step_index", W.step_change("true_temperature_c", "run_id").alias("change_c")))


def run_metrics_wide(s, d):
    return rounded(metrics.wide(_records(s, d), FAC, "center"), 5)


def run_metrics_long(s, d):
    return rounded(metrics.long(metrics.wide(_records(s, d), FAC, "center"), "center"), 5)


def conditional_means(s, d):
    x = sig(s, d)
    only = lambda v, c: F.coalesce(F.avg(F.when(c, F.col(v))), F.lit(0.0))
    return rounded(x.groupBy("center").agg(only("electricity_price", F.col("batch_workload") > 0.2).alias("price_when_busy"), only("online_workload", F.col("electricity_price") > 5.0).alias("never")))


def prediction_error_stats(s, d):
    r = _simulated(s, d, cond="mild_mismatch").withColumn("e", F.col("predicted_next_temperature_c") - F.col("true_temperature_c"))
    return rounded(r.groupBy("center").agg(F.avg(F.abs("e")).alias("mean_abs"), F.max(F.abs("e")).alias("max_abs"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg("e").alias("bias")))


def longest_streak(s, d):
    return W.longest_streak(sig(s, d), "center", F.col("electricity_price") <= FAC.low_price)


def extreme_events(s, d):
    """The steps of the highest and of the lowest price by series, in one aggregate."""
    step, price = F.col("step_index"), F.col("electricity_price")
    end = lambda key: F.max_by(F.struct("step_index", "electricity_price"), F.struct(key.alias("k"), (-step).alias("i")))
    both = sig(s, d).groupBy("center").agg(end(price).alias("high"), end(-price).alias("low"))
    return rounded(both.select("center", F.col("high.step_index").alias("high_step"), F.col("high.electricity_price").alias("high_price"), F.col("low.step_index").alias("low_step"), F.col("low.electricity_price").alias("low_price")))


def safety_margin(s, d):
    return rounded(reports.safety_margin(_records(s, d), "center"))


def key_windows(s, d):
    x = sig(s, d)
    parts = [W.highest_window(x, "center", c).withColumn("signal", F.lit(c)) for c in ("electricity_price", "online_workload", "renewable_power_kw")]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def key_window_by_scenario(s, d):
    x = sig(s, d)
    windows = W.highest_window(x, "center", "electricity_price").withColumn("signal", F.lit("electricity_price")).drop("mean")
    rec = _matrix(s, d, conditions=("ideal",)).withColumn("scenario", F.col("controller"))
    return rounded(W.window_sums(rec, windows, "center"))


def _runs(s, d) -> DataFrame:
    """Orders in the form of a run catalogue."""
    return read(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("dataset_id"), F.col("o_orderpriority").alias("controller_name"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("condition_name"), F.col("o_totalprice").alias("value"))


def latest_run_per_group(s, d):
    return rounded(W.latest(_runs(s, d).where("condition_name IS NOT NULL"), ["controller_name", "condition_name"]))


def asof_comparable_run(s, d):
    r = _runs(s, d)
    return W.comparable(r.where("condition_name = 'F'").select("id", "dataset_id"), r.where("condition_name = 'O'"), ["dataset_id"])


def asof_clustered_run(s, d):
    """The same over a stored table that is clustered by dataset: no shuffle but the one of its writing."""
    at = live.folder(s)
    runs = clustered(_runs(s, d), "runs_" + at.rpartition("-")[2], f"{at}/runs", ["dataset_id"], "id", buckets=8)
    return W.comparable_within(runs, ["dataset_id"], F.col("condition_name") == "F", F.col("condition_name") == "O").select("id", "dataset_id", "match_id")


def latest_ten_runs(s, d):
    c = read(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return rounded(reports.latest_runs(_runs(s, d), c))


def null_tolerant_filter(s, d):
    return _runs(s, d).where("condition_name = 'O' OR condition_name IS NULL").groupBy("controller_name").agg(F.count("*").alias("n"))


def in_list_filter(s, d):
    return _runs(s, d).where(F.col("controller_name").isin("1-URGENT", "2-HIGH")).groupBy("condition_name").agg(F.count("*").alias("n"), F.max("id").alias("last_id"))


def _long(s, d, **options) -> DataFrame:
    keys = ("center", "controller", "condition")
    return metrics.long(metrics.wide(_matrix(s, d, **options), FAC, keys=keys), keys=keys)


def scenario_pivot(s, d):
    rows = _totals(_matrix(s, d, conditions=("ideal",))).unpivot(["center", "controller"], ["energy_cost", "carbon_kg"], "metric", "value")
    return rounded(reports.comparison(rows, scenarios=("baseline", "heuristic")), 4)


def pct_change(s, d):
    r = _runs(s, d).groupBy("controller_name").agg(F.sum(F.when(F.col("condition_name") == "O", F.round(F.col("value"), 2).cast("decimal(18,2)"))).cast("double").alias("base"), F.sum(F.when(F.col("condition_name") == "F", F.round(F.col("value"), 2).cast("decimal(18,2)"))).cast("double").alias("other"))
    return rounded(r.select("controller_name", P.percent_change(F.col("base"), F.col("other")).alias("pct"), P.percent_change(F.col("base") - F.col("base"), F.col("other")).alias("no_base")))


def degradation_matrix(s, d):
    rows = _totals(_matrix(s, d, conditions=("ideal", "rate_limited"))).unpivot(["center", "controller", "condition"], ["energy_cost", "carbon_kg"], "metric", "value")
    return rounded(reports.degradation_matrix(rows, ["energy_cost", "carbon_kg", "absent"]), 4)


def acceptance_checks(s, d):
    return reports.acceptance(_long(s, d, conditions=("ideal",)), best="heuristic")


def health_counters(s, d):
    """Health of runs with every kind of fault: run 3 is absent, 5 has a value that is no number, 6 infinite ones, 7 negative powers, 8 steps twice, 9 steps missing."""
    rec = _records(s, d)
    at = lambda run, steps: (F.col("run_id") == run) & steps
    step = F.col("step_index")
    dirty = rec.where((F.col("run_id") != 3) & ~at(9, step % 10 == 0)).withColumn("__copies", F.when(at(8, step < 7), 2).otherwise(1)).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    dirty = dirty.withColumns({
        "grid_power_kw": F.when(at(5, step == 10), F.lit(float("nan"))).otherwise(F.col("grid_power_kw")), "temp_c": F.when(at(6, step.isin(4, 9)), F.lit(float("inf"))).otherwise(F.col("temp_c")),
        "cooling_power_kw": F.when(at(7, step < 5), F.lit(-1.0)).otherwise(F.col("cooling_power_kw")),
    })
    runs = read(s, d, "nation").select((F.col("n_nationkey") + 1).cast("long").alias("run_id"), (F.col("n_nationkey") + 1).alias("dataset_id"))
    long = metrics.long(metrics.wide(rec, FAC))
    return reports.health(dirty, long, runs, sig(s, d).withColumnRenamed("center", "dataset_id"))


def dataset_upsert(s, d):
    """The last order of each customer stands: an upsert by key and version."""
    return rounded(last_version(_runs(s, d).select("dataset_id", "id", "value"), ["dataset_id"], "id"))


def metric_upsert(s, d):
    r = _runs(s, d).select("dataset_id", F.col("controller_name").alias("metric"), "value", "id")
    return rounded(last_version(r, ["dataset_id", "metric"], "id").drop("id"))


def schema_evolution(s, d):
    return widened(read(s, d, "region"), "r_regionkey int, r_name string, status string, weight double", {"status": "completed"})


def candidate_grid(s, d):
    x = sig(s, d).select("center", "step_index", P.grid_of_actions(F.col("online_workload") * 400.0, FAC).alias("g"))
    return rounded(x.select("center", "step_index", F.size("g").alias("n"), F.explode("g").alias("action_kw")))


def union_scenarios(s, d):
    x = sig(s, d)
    tagged = dispatch.immediate(x).withColumn("scenario", F.lit("baseline")).select("scenario", "center", "step_index", "batch_service").unionByName(dispatch.price_aware(x, "center", FAC).withColumn("scenario", F.lit("heuristic")).select("scenario", "center", "step_index", "batch_service"))
    return rounded(tagged)


def coordination_series(s, d):
    x = sig(s, d)
    parts = [dispatch.dispatched(x, "center", strategy, FAC).select("center", "step_index", F.lit(name).alias("scenario"), (F.col("online_workload") + F.col("batch_service")).alias("workload"), "electricity_price") for name, strategy in FEEDBACK]
    return rounded(parts[0].unionByName(parts[1]))


def mini_summary(s, d):
    return rounded(_records(s, d).groupBy("center").agg(F.sum("grid_energy_kwh").alias("energy_kwh"), F.sum("energy_cost_step").alias("cost"), F.sum("carbon_kg_step").alias("carbon_kg")), 5)


def _stream_rows(s, d, controller, cond) -> DataFrame:
    ready = W.precool_flag(_inputs(s, d), "center", FAC)
    ready = ready.select("center", "step_index", "precool", F.col("timestamp").cast("timestamp").alias("at"), *[F.col(v).alias(k) for k, v in loop.INPUT.items()])
    ready = W.forecast(ready, "center", FAC.horizon_steps, ["at", "load", "price", "ci", "outdoor", "renewable"])
    return ready.select(F.col("center").cast("long").alias("run_id"), "step_index", F.lit(controller).alias("controller"), F.lit(cond).alias("condition"), "at", "load", "price", "ci", "outdoor", "renewable", "precool", F.lit(None).cast("double").alias("action"), "forecast")


def streaming_loop_equals_batch(s, d):
    """The stateful processor over the same inputs as a batch; ``difference`` is against the lockstep plan."""
    rows = _stream_rows(s, d, "finite_horizon", "combined_nonideal").drop("step_index")
    stepped = live.replay(rows, FAC).select("run_id", "step_index", F.col("true_temperature_c").alias("streamed_c"), "error")
    whole = _simulated(s, d, controller="finite_horizon", cond="combined_nonideal").select("run_id", "step_index", "true_temperature_c")
    return rounded(stepped.join(whole, ["run_id", "step_index"]).withColumn("difference", F.abs(F.col("streamed_c") - F.col("true_temperature_c"))))


def streaming_loop(s, d):
    """The feedback loop as a stream: the temperatures that it puts out."""
    return rounded(live.replay(_stream_rows(s, d, "heuristic", "ideal").drop("step_index"), FAC).select("run_id", "step_index", "proposed_cooling_kw", "applied_cooling_kw", "true_temperature_c", "error"))


def stream_rejections(s, d):
    """The last step of each series with another fault: what the stream says of it, and how many steps it took."""
    rows = _stream_rows(s, d, "finite_horizon", "ideal")
    fault = F.when(F.col("step_index") == 95, F.pmod("run_id", F.lit(6)))
    later = F.transform("forecast", lambda w: w.withField("at", F.timestamp_add("MINUTE", F.lit(15), w["at"])))
    broken = rows.withColumns({
        "load": F.when(fault == 0, F.lit(float("nan"))).otherwise(F.col("load")), "price": F.when(fault == 1, F.lit(-0.5)).otherwise(F.col("price")),
        "forecast": F.when(fault == 2, later).when(fault == 3, F.array_repeat(F.element_at("forecast", 1), 2)).when(fault == 4, F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.element_at("forecast", 1).withField("at", F.timestamp_add("MINUTE", i * 15, F.col("at"))))).otherwise(F.col("forecast")),
        "at": F.when(fault == 5, F.timestamp_add("MINUTE", F.lit(15), F.col("at"))).otherwise(F.col("at")),
    }).withColumn("forecast", F.when(fault == 5, later).otherwise(F.col("forecast")))
    out = live.replay(broken.drop("step_index"), FAC)
    return out.groupBy("run_id").agg(F.count_if(F.col("error").isNull()).alias("steps"), F.max("error").alias("error"))


def observation_series(s, d):
    """What the controller sees at each step: the last measurement, the action before, and the step's own values."""
    seen = records.observations(_simulated(s, d, cond="act_rate_limited"))
    return rounded(seen.select("center", "step_index", "observation.*"))


def event_report(s, d):
    return rounded(reports.events(_records(s, d), "center"))


def thermal_report(s, d):
    return rounded(reports.thermal(_records(s, d), "center"))


def thermal_head(s, d):
    return rounded(reports.head(_records(s, d), "center", ["temp_c", "temp_min_c", "temp_max_c", "cooling_kw"], 12))


def comparison_report(s, d):
    """The comparison as lines of text, with its conclusions, by center."""
    return reports.comparison_lines(_long(s, d, conditions=("ideal",)), scenarios=("baseline", "heuristic"), best="heuristic")


def scenario_listing(s, d):
    """The latest run of each scenario, in the order of their names."""
    return _runs(s, d).groupBy(F.col("controller_name").alias("scenario")).agg(F.max("id").alias("run_id")).orderBy("scenario")


def iso_times(s, d):
    return sig(s, d).select("center", "step_index", S.iso_text(F.col("timestamp")).alias("text"), S.iso_text(F.col("timestamp").cast("timestamp"), "Asia/Shanghai").alias("local_text"))


def forecast_contract(s, d):
    """Windows of each length from one to thirty steps, held against what each controller may see."""
    x = W.forecast(sig(s, d).withColumn("at", F.col("timestamp")), "center", 30, ["at", "electricity_price"])
    x = x.withColumn("controller", F.explode(F.array(*[F.lit(n) for n in ("baseline", "heuristic", "finite_horizon")]))).withColumn("forecast", F.slice("forecast", 1, F.least(F.col("center"), F.lit(30))))
    return x.select("center", "step_index", "controller", contracts.forecast_error().alias("error"))


def _kept(s, df: DataFrame, name: str, fmt: str = "csv") -> str:
    """Writes a file of a source query into the shared folder; its path."""
    path = f"{live.folder(s)}/{name}"
    if fmt == "csv":
        S.write_csv(df, path)
    else:
        df.write.parquet(path)
    return path


def csv_canonical(s, d):
    """The signals as a CSV of the canonical layout, read back by its own reader."""
    day = sig(s, d).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))
    back, tag = S.read_csv(s, _kept(s, day.select(*S.SIGNAL_COLUMNS), "canonical"), zone="UTC")
    return rounded(back.withColumn("source", F.lit(tag)).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")))


def csv_legacy(s, d):
    """The same through the older layout, with wall-clock times eight hours ahead."""
    day = S.legacy(sig(s, d)).withColumn("timestamp", F.date_format(F.timestamp_add("HOUR", F.lit(8), F.col("timestamp")), "yyyy-MM-dd HH:mm:ss"))
    back, tag = S.read_csv(s, _kept(s, day, "legacy"))
    return rounded(back.withColumn("source", F.lit(tag)).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")))


def csv_sorted(s, d):
    """The older layout in the order of times; the place of each row in it."""
    day = S.legacy(sig(s, d)).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))
    back = S.read_sorted(s, _kept(s, day.repartition(5, "price"), "sorted"))
    return rounded(S.steps(back.withColumn("dataset_id", F.date_trunc("day", "timestamp"))).select("timestamp", "step_index", "price", "carbon"))


def both_layouts(s, d):
    return rounded(S.both_layouts(S.legacy(sig(s, d)).withColumn("electricity_price", F.when(F.pmod(F.minute("timestamp"), F.lit(30)) == 0, F.col("price") + 1.0))))


def batch_service_alignment(s, d):
    """Any service, joined step by step, as far as there is work for it."""
    x = sig(s, d)
    wanted = x.select("center", "step_index", (F.col("electricity_price") * 0.4 - 0.1).alias("batch_service"))
    return rounded(dispatch.workload(dispatch.with_service(x, wanted, "center"), "center").select("center", "step_index", "workload_fraction"))


def metric_map(s, d):
    """Metrics as one map a run, and two of its values."""
    wide = metrics.wide(_records(s, d), FAC, "center", last_backlog=True)
    mapped = metrics.as_map(metrics.long(wide, "center"), "center")
    return rounded(mapped.select("center", F.size("metrics").alias("n"), F.element_at("metrics", F.lit("energy_cost")).alias("energy_cost"), F.element_at("metrics", F.lit("final_backlog")).alias("final_backlog")), 5)


def legacy_summary(s, d):
    return rounded(metrics.legacy(_records(s, d), FAC, "center"), 5)


def schema_columns(s, d):
    """The columns of some tables, as a catalogue lists them, with how many rows have a value."""
    parts = []
    for t in ("orders", "nation", "events"):
        df = read(s, d, t)
        each = F.array(*[F.struct(F.lit(t).alias("table_name"), F.lit(i).alias("position"), F.lit(c).alias("column_name"), F.count(c).alias("n_values")) for i, c in enumerate(df.columns, 1)])
        parts.append(df.agg(each.alias("c")).select(F.explode("c").alias("c")).select("c.*"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def stream_slots(s, d):
    """Events through a stream of fifteen-minute slots; those that the watermark has closed."""
    rows = read(s, d, "events").select("ts", "event_type", "value")
    at = _kept(s, rows, "events", "parquet")
    out = stream_events.slots(s.readStream.schema(rows.schema).parquet(at))
    out.writeStream.format("parquet").option("path", f"{at}-out").option("checkpointLocation", f"{at}-log").trigger(availableNow=True).start().awaitTermination()
    return rounded(s.read.schema(out.schema).parquet(f"{at}-out").withColumn("slot_start", F.col("slot_start").cast("timestamp_ntz")), 2)


def run_store(s, d):
    """The life of runs in a store: one finished, one failed, one that still runs; a dataset written twice and metrics three times."""
    x = sig(s, d)
    store = RunStore(s, live.folder(s)).initialize()
    first = store.upsert_dataset("day", x.where("center = 1"))
    dataset = store.upsert_dataset("day", x)
    runs = store.create_runs([{"name": "r", "scenario": n, "dataset_id": dataset} for n in ("baseline", "heuristic", "finite_horizon")])
    steps = x.select("step_index", F.col("electricity_price").alias("price"))
    for run in runs[:2]:
        store.append_inputs(run, x)
        store.append_steps(run, steps)
    metric = lambda v: s.createDataFrame([("energy_cost", v), ("carbon_kg", 2 * v)], "metric string, value double")
    store.finish_run(runs[0], metric(1.0))
    store.upsert_metrics(runs[0], metric(5.0).where("metric = 'energy_cost'"))
    store.fail_run(runs[1], "no power")
    kept = store.read("simulation_results").groupBy("run_id").agg(F.count("*").alias("steps"), F.sum("price").alias("price"))
    said = store.metrics().groupBy("run_id").agg(F.count("*").alias("metrics"), F.max("value").alias("largest"))
    sets = store.datasets().select(F.col("id").alias("dataset_id"), "n_steps")
    out = store.runs().join(kept, F.col("id") == kept["run_id"], "left").join(said, F.col("id") == said["run_id"], "left").join(sets, "dataset_id")
    return rounded(out.select((F.col("id") - runs[0]).alias("nth"), (F.col("dataset_id") - first).alias("dataset"), "scenario", "status", "message", "n_steps", "steps", "price", "metrics", "largest"))


def backlog_one_series(s, d):
    """All days as one series, its recurrence as a scan over blocks of 256 steps."""
    one = sig(s, d).withColumns({"step_index": (F.col("center") - 1) * S.SLOTS + F.col("step_index"), "center": F.lit(1)})
    return rounded(dispatch.price_aware(one, "center", FAC, steps=256).select("step_index", "batch_service", "backlog"))


def streak_one_series(s, d):
    """The longest runs of cheap and of dear steps of all days as one series, in blocks of 100 steps."""
    one = sig(s, d).withColumns({"step_index": (F.col("center") - 1) * S.SLOTS + F.col("step_index"), "center": F.lit(1)})
    t = blocks.TwoLevels(100)
    cheap, busy = F.col("electricity_price") <= 0.6, F.col("online_workload") > 0.3
    return t.of(one, "center", {"cheap": t.longest_streak(cheap), "busy": t.longest_streak(busy), "n_busy": t.count_if(busy)})


def _catalogue(s, d) -> None:
    """Views in the form of a store: orders as runs, customers as datasets, line items as metrics, signals as steps."""
    runs = read(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("c"), F.col("o_custkey") % 7).alias("name"), (F.col("o_custkey") % 50).alias("dataset_id"), F.col("o_orderpriority").alias("scenario"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("condition_name"))
    lines = read(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"), F.max("l_extendedprice").alias("largest"), F.min("l_discount").alias("discount"))
    steps = sig(s, d).select(F.col("center").alias("run_id"), "*", (F.col("online_workload") + F.col("batch_workload")).alias("workload"), (F.lit(17.0) + F.col("online_workload") * 20.0).alias("temp"), (F.col("electricity_price") * 400.0 - 60.0).alias("wanted"))
    datasets = read(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    sqltext.views(s, experiment_runs=runs, datasets=datasets, run_metrics=metrics.long(lines), simulation_steps=steps)
    sqltext.register(s, FAC)


def sql_comparable_runs(s, d):
    """Bound scalars and a list: the latest comparable runs of the listed scenarios, for every anchor."""
    _catalogue(s, d)
    return sqltext.ask(s, sqltext.COMPARABLE_RUNS, anchor="3-MEDIUM", condition="F", scenarios=["1-URGENT", "3-MEDIUM", "it's none"])


def sql_run_metrics(s, d):
    """A list as an argument."""
    _catalogue(s, d)
    return rounded(sqltext.ask(s, sqltext.RUN_METRICS, first=0, last=2**40, metrics=["quantity", "discount"]))


def sql_run_metrics_any(s, d):
    """The same text with a null in the list's place: all metrics."""
    _catalogue(s, d)
    return rounded(sqltext.ask(s, sqltext.RUN_METRICS, first=0, last=2**40, metrics=None))


def sql_runs_under_none(s, d):
    """A null as an argument that means null."""
    _catalogue(s, d)
    return sqltext.ask(s, sqltext.RUNS_UNDER, condition=None)


def sql_latest_runs(s, d):
    _catalogue(s, d)
    return sqltext.ask(s, sqltext.LATEST_RUNS, n=25)


def sql_accounted_steps(s, d):
    """Accounting by SQL functions, with an open end."""
    _catalogue(s, d)
    return rounded(sqltext.ask(s, sqltext.ACCOUNTED_STEPS, first=0, last=None, share=0.5, aux=FAC.p_aux_kw))


def sql_bounded_steps(s, d):
    """Bounds, safe action and temperature by SQL functions, with some arguments of theirs by name."""
    _catalogue(s, d)
    return rounded(sqltext.ask(s, sqltext.BOUNDED_STEPS, floor=20.5, capacity=1.05, heat=0.95, cooling=1.05))


def csv_quarantine(s, d):
    """Lines with every kind of fault, planted by step: how many are good, and how many are rejected for each reason."""
    x = sig(s, d)
    values = [F.col(c).cast("string") for c in S.SIGNAL_COLUMNS if c != "timestamp"]
    at, step = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), F.pmod(F.col("step_index") + F.col("center"), F.lit(24))
    cells = [F.when(step == 1, "soon").when(step == 2, "").otherwise(at), F.when(step == 3, "n/a").when(step == 4, "").otherwise(values[0]), *values[1:-1], F.when(step == 5, "1,5").when(step == 6, "12kW").otherwise(values[-1])]
    lines = x.select(F.when(step == 7, F.concat_ws(",", *cells[:3])).otherwise(F.concat_ws(",", *cells)).alias("line"))
    path = f"{live.folder(s)}/faulty"
    lines.write.text(path)
    good, bad = S.read_checked(s, path, columns=list(S.SIGNAL_COLUMNS))
    kept = good.agg(F.count("*").alias("n"), F.count("online_workload").alias("n_workloads"), F.sum(F.round("electricity_price", 6)).alias("price")).select(F.lit("good").alias("reason"), "n", "n_workloads", "price")
    lost = bad.groupBy("reason").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("n_workloads"), F.lit(0.0).alias("price"))
    return rounded(kept.unionByName(lost), 4)


def stream_stored_totals(s, d):
    """Events through a stream into the store, each batch delivered twice: what the store has, by kind, and that the run is completed."""
    rows = read(s, d, "events").select("event_type", F.col("value").cast("decimal(18,4)").alias("value"))
    at = live.folder(s)
    rows.repartition(6).write.parquet(f"{at}/in")
    store = RunStore(s, f"{at}/store").initialize()
    run = store.create_run("events", "stream", 1)
    life = sink.Lifecycle(store, lambda r: r.agg(F.count("*").cast("double").alias("value")).select(F.lit("n").alias("metric"), "value"))
    s.streams.addListener(life)
    twice = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    try:
        life.expect(f"run-{run}", run)
        deliver = lambda batch, number: [store.store_batch(run, number, batch) for _ in range(2)] and None
        twice.writeStream.queryName(f"run-{run}").option("checkpointLocation", f"{at}/log").foreachBatch(deliver).trigger(availableNow=True).start().awaitTermination()
        life.wait(run)
    finally:
        s.streams.removeListener(life)
    ended = store.runs().where(F.col("id") == run).select("status").join(store.metrics().where("metric = 'n'").select(F.col("value").cast("long").alias("n_stored")))
    return store.streamed(run).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").cast("double").alias("value")).join(F.broadcast(ended))  # one row


QUERIES = {f.__name__: f for f in (
    signals_canonical, signals_legacy_normalized, signals_legacy_roundtrip, signal_quality, step_gap_check, duplicate_steps, dataset_metadata, it_power, cooling_cop_power, renewable_alloc,
    energy_accounting, plant_step, feasible_bounds, model_bounds, safety_clamp, safety_clamp_legacy, forecast_window_array, forward_min_price, precool_flag, dispatch_immediate,
    dispatch_price_aware, workload_fraction, actuator_ideal, actuator_rate_limited, actuator_first_order, actuator_delayed, loop_baseline, loop_heuristic, loop_external_action,
    loop_finite_horizon, measurement_noise, mpc_open_loop_solve, robustness_matrix, robustness_matrix_full, step_records, control_movement, step_change, run_metrics_wide, run_metrics_long,
    conditional_means, prediction_error_stats, longest_streak, extreme_events, safety_margin, key_windows, key_window_by_scenario, latest_run_per_group, asof_comparable_run, latest_ten_runs,
    null_tolerant_filter, in_list_filter, scenario_pivot, pct_change, degradation_matrix, acceptance_checks, health_counters, dataset_upsert, metric_upsert, schema_evolution, candidate_grid,
    union_scenarios, coordination_series, mini_summary, streaming_loop_equals_batch, streaming_loop, stream_rejections, observation_series, event_report, thermal_report, thermal_head,
    comparison_report, scenario_listing, iso_times, forecast_contract, csv_canonical, csv_legacy, csv_sorted, both_layouts, batch_service_alignment, metric_map, legacy_summary, schema_columns, stream_slots, run_store,
    backlog_one_series, streak_one_series, sql_comparable_runs, sql_run_metrics, sql_run_metrics_any, sql_runs_under_none, sql_latest_runs, sql_accounted_steps, sql_bounded_steps,
    csv_quarantine, stream_stored_totals, asof_clustered_run, signals_whole_span,
)}
