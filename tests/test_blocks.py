"""Scans and streaks over blocks of time against step-by-step versions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from thermolith.config import Facility
from thermolith.operators import blocks, dispatch, reports
from thermolith.operators import windows as W

FAC = Facility()


def series(rng, n):
    return [(t, rng.random() * 0.9, rng.random() * 0.5 if rng.random() < 0.7 else 0.0, rng.choice([0.3, 0.5, 0.9]) + rng.random() / 50) for t in range(n)]


def frame(spark, all_series):
    rows = [(k, *r) for k, rs in all_series.items() for r in rs]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "center int, step_index int, online_workload double, batch_workload double, electricity_price double")


def price_aware(rows):
    out, left, n = {}, 0.0, len(rows)
    for t, online, batch, price in rows:
        free = max(0.0, FAC.max_service_per_step - online)
        low = min(p for *_, p in rows[t : t + FAC.batch_lookahead_steps])
        share = 1.0 if price <= FAC.batch_low_price or price <= low else 0.25 if price >= FAC.batch_high_price else 0.55
        waiting = left + batch
        done = min(waiting, share * free)
        if n - t <= FAC.batch_lookahead_steps:
            done = min(waiting, free, max(done, waiting / (n - t)))
        left = waiting - done
        out[t] = (done, left)
    return out


@pytest.mark.parametrize("steps", [7, 10, 64, 4096])
def test_dispatch_by_blocks_is_dispatch_by_steps(spark, steps):
    rng = random.Random(steps)
    whole = {1: series(rng, 200), 2: series(rng, 1), 3: series(rng, 8), 4: series(rng, 9), 5: series(rng, 63)}
    got = dispatch.price_aware(frame(spark, whole), "center", FAC, steps=steps).collect()
    assert len(got) == sum(map(len, whole.values()))
    want = {(k, t): v for k, rs in whole.items() for t, v in price_aware(rs).items()}
    assert max(abs(r["batch_service"] - want[r["center"], r["step_index"]][0]) + abs(r["backlog"] - want[r["center"], r["step_index"]][1]) for r in got) < 1e-9


@pytest.mark.parametrize("steps", [5, 50, 4096])
def test_workload_of_any_service(spark, steps):
    rng = random.Random(steps)
    whole = {1: series(rng, 120), 2: series(rng, 3)}
    df = frame(spark, whole).withColumn("batch_service", F.col("electricity_price") * 0.6 - 0.25)
    got = {(r["center"], r["step_index"]): r["workload_fraction"] for r in dispatch.workload(df, "center", steps).collect()}
    for k, rows in whole.items():
        left = 0.0
        for t, online, batch, price in rows:
            done = min(left + batch, max(0.0, price * 0.6 - 0.25))
            left += batch - done
            assert abs(got[k, t] - max(0.0, online + done)) < 1e-9


def test_one_series_lies_in_several_tasks_without_python(spark):
    long = spark.range(20_000).select(F.lit(1).alias("center"), F.col("id").cast("int").alias("step_index"), F.lit(0.5).alias("online_workload"), F.rand(1).alias("batch_workload"), F.rand(2).alias("electricity_price"))
    out = dispatch.price_aware(long, "center", FAC, steps=1000)
    assert "InArrow" not in out._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        local = blocks.with_waiting(blocks.cut(long.withColumn("c", F.lit(0.4)), 1000), "center", "batch_workload", "c")
        assert local.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("steps", [1, 3, 17, 4096])
def test_streaks_of_blocks(spark, steps):
    rng = random.Random(steps)
    flags = {1: [rng.random() < 0.8 for _ in range(150)], 2: [True] * 40, 3: [False] * 12, 4: [None, True, True, None, True], 5: [rng.random() < 0.5 for _ in range(60)]}
    df = spark.createDataFrame([(k, i, f) for k, fs in flags.items() for i, f in enumerate(fs)], "center int, step_index int, flag boolean").repartition(3)
    got = {r["center"]: r["longest_streak"] for r in W.longest_streak(df, "center", F.col("flag"), steps=steps).collect()}
    assert got == {k: max([len(list(g)) for held, g in itertools.groupby(fs) if held], default=0) for k, fs in flags.items()}


def test_two_levels_are_one_aggregate(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(k, i, rng.random() if rng.random() < 0.8 else None) for k in range(3) for i in range(101)] + [(9, 0, None)], "center int, step_index int, x double")
    t = blocks.TwoLevels(10)
    got = t.of(df, "center", {"a": t.avg("x"), "s": t.sum("x"), "hi": t.max("x"), "lo": t.min("x"), "n": t.count_if(F.col("x") > 0.5), "end": t.last("x")})
    want = df.groupBy("center").agg(F.avg("x").alias("a"), F.sum("x").alias("s"), F.max("x").alias("hi"), F.min("x").alias("lo"), F.count_if(F.col("x") > 0.5).alias("n"), F.max_by("x", "step_index").alias("end"))
    rounded = lambda d: sorted(tuple(None if v is None else round(v, 9) for v in r) for r in d.orderBy("center").collect())
    assert str(rounded(got)) == str(rounded(want))


def test_distinct_numbers(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), rng.choice([None, rng.randrange(50), rng.randrange(10**6), -rng.randrange(100)])) for _ in range(3000)] + [("only null", None)]
    got = {r["k"]: (r["rows"], r["distinct"]) for r in W.distinct_numbers(spark.createDataFrame(rows, "k string, n long"), ["k"], "n").collect()}
    assert got == {k: (sum(a == k for a, _ in rows), len({n for a, n in rows if a == k and n is not None})) for k in {a for a, _ in rows}}


def test_plans_have_one_loop(spark, folder):
    """The loop runs once in a query, twice where two dispatch strategies would need it; reports don't read their metrics again."""
    from thermolith import queries as Q

    for name in ("comparison_report", "degradation_matrix", "acceptance_checks", "metric_map", "legacy_summary", "run_metrics_wide", "health_counters"):
        plan = Q.QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") <= (2 if name == "health_counters" else 1), name


def test_lines_of_a_group_without_metrics(spark):
    some = spark.createDataFrame([(1, "baseline", "energy_cost", 2.0), (1, "heuristic", "energy_cost", 1.0)], "center int, controller string, metric string, value double")
    lines = {r["line_no"]: r["line"] for r in reports.comparison_lines(some, scenarios=("baseline", "heuristic"), best="heuristic").collect()}
    assert lines[0].endswith("2.0000          1.0000") and "missing" in lines[1] and lines[9] == "Economic improvement: PASS" and lines[14] == "heuristic vs baseline cost: -50.00%"


def test_no_shuffle_over_a_clustered_table(spark, folder):
    from thermolith import queries as Q

    found = Q.asof_clustered_run(spark, folder)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    rows = lambda df: sorted(map(str, df.select("id", "dataset_id", "match_id").collect()))
    assert rows(found) == rows(Q.asof_comparable_run(spark, folder))


def test_comparable_within_takes_rows_of_equal_order(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 5, "a"), (1, 4, "b"), (2, 1, "a"), (None, 1, "a"), (None, 0, "b"), (3, 9, None)], "k int, id int, side string")
    got = {(r["k"], r["id"]): r["match_id"] for r in W.comparable_within(df, ["k"], F.col("side") == "a", F.col("side") == "b").collect()}
    assert got == {(1, 5): 5, (2, 1): None, (None, 1): 0}
