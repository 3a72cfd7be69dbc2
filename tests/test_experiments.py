from thermolith.operators.store import RunStore
from thermolith.plans import experiments


def test_from_signals_to_reports(spark, tmp_path):
    folder = f"file://{tmp_path}/s"
    assert experiments.single_center(spark, folder) == [1, 2, 3]
    store = RunStore(spark, folder).initialize()
    table, verdict = experiments.compare(store)
    costs = {r["metric"]: r for r in table.collect()}["energy_cost"]
    assert [round(costs[k], 4) for k in ("baseline", "heuristic", "finite_horizon")] == [2421.4561, 2364.9363, 2332.7363]
    assert round(costs["finite_horizon_change_pct"], 2) == -3.66
    assert set(verdict.drop("center").first()) == {"PASS"}
    last, health = experiments.inspect(store)
    assert [r["id"] for r in last.collect()] == [3, 2, 1]
    rows = health.collect()
    assert len(rows) == 3 and all(r["steps"] == 96 and r["metrics"] == 66 and r["missing_steps"] == r["invalid_values"] == 0 for r in rows)
    assert experiments.robustness(spark, folder, ["ideal", "rate_limited"]) == [4, 5, 6, 7, 8, 9]
    matrix = experiments.degradation(store).where("condition = 'ideal'").collect()
    assert all(r["degradation"] in ("+0.00%", "absolute change +0.0000", "-0.00%") for r in matrix)
    lines = [r["line"] for r in experiments.compare_lines(store).collect()]
    assert lines[0] == "Energy cost                          2421.4561       2364.9363       2332.7363" and "Economic improvement: PASS" in lines and "finite_horizon vs baseline cost: -3.66%" in lines
    assert experiments.coordination(store).count() == 12
    head, summary = experiments.thermal(store)
    assert head.count() == 36 and all(r["below_min_count"] == r["longest_above_max_streak"] == 0 for r in summary.collect())
    assert {r["event"] for r in experiments.events(store, condition_name="rate_limited").collect()} == set(experiments.reports.EVENTS)


def test_a_missing_metric_is_said_in_its_line(spark):
    rows = [(1, w, m, 1.0) for w in ("baseline", "heuristic", "finite_horizon") for m in ("energy_cost", "carbon_kg") if (w, m) != ("heuristic", "carbon_kg")]
    got = [r["line"] for r in experiments.reports.comparison_lines(spark.createDataFrame(rows, "center int, controller string, metric string, value double")).orderBy("line_no").collect()]
    assert got[0].split()[-3:] == ["1.0000"] * 3 and got[1].split()[-3:] == ["missing"] * 3 and "Economic improvement: FAIL" in got and "finite_horizon vs baseline cost: 0.00%" in got


def test_mini(spark, tmp_path):
    got = {r["scenario"]: round(r["cost"], 4) for r in experiments.mini(spark, f"file://{tmp_path}/m").collect()}
    assert got == {"baseline": 2421.4561, "heuristic": 2364.9363, "finite_horizon": 2332.7363}
