"""Forecast windows, and controllers of the caller's own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermolith.config import Facility
from thermolith.errors import InputValidationError
from thermolith.operators import contracts
from thermolith.operators import windows as W
from thermolith.plans import loop
from thermolith.sources import signals as S

FAC = Facility()


def test_own_controller_sees_no_more_than_it_may(spark):
    class Far:
        max_forecast_steps = 3
        seen, resets = [], []

        def reset(self, seed=None):
            self.resets.append(seed)

        def act_all(self, lp, state, x, window):
            assert window["price"].shape[1] <= 3 and self.resets
            return window["price"].max(1) * 100, np.full(len(state.true), 24.0), np.full(len(state.true), 18.0)

    d = S.generate(spark).withColumn("run_id", F.lit(1).cast("long")).withColumn("workload_fraction", F.col("online_workload")).withColumns({"controller": F.lit("far"), "condition": F.lit("ideal")})
    assert loop.simulate(d, FAC, controllers={"far": Far()}).count() == 96


def test_window_access(spark):
    d = W.forecast(S.generate(spark).withColumn("k", F.lit(1)), "k", 4, ["electricity_price"])
    last = d.where("step_index = 95")
    assert d.where("step_index = 3").select(contracts.window_row("forecast", 3)).first()[0] is not None
    for bad in (1, -1):
        with pytest.raises(Exception, match="outside of the forecast window"):
            last.select(contracts.window_row("forecast", bad)).collect()
    assert d.select(contracts.window_values(d, "forecast", "electricity_price").alias("v")).where("size(v) = 4").count() == 93
    with pytest.raises(InputValidationError):
        contracts.window_values(d, "forecast", "none")
    for index in (-1, 96):
        with pytest.raises(IndexError):
            S.at_step(d, index)
