"""The loop step by step: one facility run a key, its state kept by Spark.

Inputs arrive as micro-batches in any order; those of one batch are sorted by time. A
step's values and its window (its forecast, part of the input, so nothing ahead of it is
ever seen) are checked by columns before the state is reached. A step must follow its
run's last one by exactly the fixed step. One that breaks a rule is rejected, never
buffered, and comes out as an error row; it leaves the state as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import Facility, condition
from ..errors import ConfigurationError
from ..operators.contracts import VALUES, forecast_error, input_error
from ..plans.kernel import Loop, State

OUT = "run_id long, at timestamp, step_index int, proposed_cooling_kw double, applied_cooling_kw double, true_temperature_c double, measured_temperature_c double, error string"
STATE = "true double, measured double, applied double, queue array<double>, proposed double, mpc_queue array<double>, step_index int, last_us long, noise string"
WINDOW = "array<struct<at:timestamp,load:double,price:double,ci:double,outdoor:double,renewable:double>>"
#: Columns of the input stream: one row a step. A null forecast is the current step alone.
INPUT = f"run_id long, controller string, condition string, at timestamp, load double, price double, ci double, outdoor double, renewable double, precool int, action double, forecast {WINDOW}"


def _one(x) -> np.ndarray:
    return np.array([x], float)


class Noise:
    """A run's measurement noise, draw by draw; what is kept of it is the generator's state, whatever the stream's age."""

    def __init__(self, loop: Loop, kept: str | None):
        self.std = loop.c.noise_std_c if loop.c.measurement == "gaussian" else 0.0
        self.rng = np.random.default_rng(loop.c.noise_seed) if self.std else None
        if self.rng is not None and kept:
            self.rng.bit_generator.state = json.loads(kept)

    def draw(self) -> np.ndarray:
        return _one(self.rng.normal(0.0, self.std) if self.rng is not None else 0.0)

    def state(self) -> str | None:
        return json.dumps(self.rng.bit_generator.state) if self.rng is not None else None


def processor(f: Facility):
    def of(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames), ignore_index=True).sort_values("at", kind="stable")
        loop = Loop(f, condition(rows["condition"].iat[0]), rows["controller"].iat[0])
        if state.exists:
            true, measured, applied, queue, proposed, mpc, index, last, kept = state.get
            noise = Noise(loop, kept)
            s = State(_one(true), _one(measured), _one(applied), np.array([queue], float).reshape(1, -1), _one(proposed), np.array([mpc], float).reshape(1, -1))
        else:
            noise = Noise(loop, None)
            s, index, last = loop.start(1, noise.draw()), 0, None
        out = []
        for r in rows.itertuples():
            wrong = r.error
            us = None if pd.isna(r.at) else int(pd.Timestamp(r.at).value // 1000)
            if not wrong and last is not None and us != last + f.step_minutes * 60_000_000:
                wrong = "time does not follow the last step"
            if wrong:
                out.append((key[0], r.at, None, None, None, None, None, wrong))
                continue
            x = {k: _one(getattr(r, k)) for k in (*VALUES, "action")} | {"precool": np.array([0 if pd.isna(r.precool) else int(r.precool)])}
            window = None
            if loop.controller == "finite_horizon":
                ahead = x if r.forecast is None else {k: np.array([w[k] for w in list(r.forecast)[: f.horizon_steps]], float) for k in VALUES}
                window = {k: np.asarray(ahead[k]).reshape(1, -1) for k in VALUES}
            s, made = loop.step(s, x, noise.draw(), window)
            out.append((key[0], r.at, index, *(float(made[k][0]) for k in ("proposed_cooling_kw", "applied_cooling_kw", "true_temperature_c", "measured_temperature_c")), None))
            index, last = index + 1, us
        if last is not None:
            state.update((float(s.true[0]), float(s.measured[0]), float(s.applied[0]), s.queue[0].tolist(), float(s.proposed[0]), s.mpc_queue[0].tolist(), index, last, noise.state()))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    return of


def simulate(stream: DataFrame, f: Facility | None = None) -> DataFrame:
    """A streaming frame of INPUT rows to one of OUT rows."""
    f = (f or Facility()).validated()
    reach = {"heuristic": f.precool_lookahead_steps, "finite_horizon": f.horizon_steps}
    checked = stream.withColumn("error", F.coalesce(input_error(), forecast_error(reach=reach)))
    return checked.groupBy("run_id").applyInPandasWithState(processor(f), OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def folder(spark) -> str:
    """A new folder under the one that driver and executors share, ``spark.checkpoint.dir``.
    A local session may go without; a cluster may not, as its machines see no folder of the driver's."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ConfigurationError("a cluster must name the shared folder in spark.checkpoint.dir")
        import tempfile

        named = "file://" + tempfile.mkdtemp(prefix="thermolith-")
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/stream-{uuid.uuid4().hex}"


def replay(rows: DataFrame, f: Facility | None = None) -> DataFrame:
    """Runs INPUT rows through the streaming loop to their end: written as files, read as
    a stream, and what comes out written as files and read again."""
    spark, at = rows.sparkSession, folder(rows.sparkSession)
    rows.write.parquet(f"{at}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{at}/in")
    query = simulate(stream, f).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(OUT).parquet(f"{at}/out")
