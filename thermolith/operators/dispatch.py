"""Batch work over time.

The backlog is a recurrence. A step of it is x -> max(0, x + arrivals - capacity), so it is a scan over
blocks of time (see ``operators.blocks``), and a series may be as long as it likes. Only the last steps of
a series, as many as are looked ahead, follow another rule; they are folded one by one, as an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Facility
from ..errors import ConfigurationError, InputValidationError
from ..sources.signals import written_checked
from . import blocks


def immediate(signals: DataFrame) -> DataFrame:
    return signals.withColumn("batch_service", F.col("batch_workload"))


def price_aware(signals: DataFrame, by: str, f: Facility, steps: int = blocks.STEPS) -> DataFrame:
    """Adds ``batch_service`` and ``backlog``: serve all when cheap, a quarter of the free
    capacity when dear, somewhat over half of it between; near the end, at least an even share."""
    look = f.batch_lookahead_steps
    ahead = blocks.block_window(by).rowsBetween(0, look - 1)
    d = blocks.cut_with_halo(signals, look - 1, steps).withColumn("__low_price", F.min("electricity_price").over(ahead)).where(~F.col("__halo"))
    price, free = F.col("electricity_price"), F.greatest(F.lit(0.0), F.lit(f.max_service_per_step) - F.col("online_workload"))
    share = F.when((price <= f.batch_low_price) | (price <= F.col("__low_price")), 1.0).when(price >= f.batch_high_price, 0.25).otherwise(0.55)
    d = blocks.with_waiting(d.withColumn("__free", free).withColumn("__most", share * F.col("__free")), by, "batch_workload", "__most")
    d = d.withColumn("__rem", (F.col("__n") - F.col("step_index")).cast("double"))
    late = F.col("__rem") <= look
    waiting = F.col("waiting_before") + F.col("batch_workload")
    early = d.where(~late).withColumn("batch_service", F.least(waiting, F.col("__most"))).withColumn("backlog", waiting - F.col("batch_service"))
    return early.select(*signals.columns, "batch_service", "backlog").unionByName(_last_steps(d.where(late), signals.columns, by))


def _last_steps(late: DataFrame, columns: list[str], by: str) -> DataFrame:
    """The last steps of each series, ``batch_lookahead_steps`` at most, one after the other: at least an even share of what waits."""
    row = F.struct("step_index", *[c for c in columns if c != "step_index"], "__most", "__free", "__rem", "waiting_before")
    each = late.groupBy(by).agg(F.array_sort(F.collect_list(row)).alias("__rows"))

    def step(s: Column, r: Column) -> Column:
        waiting = s["left"] + r["batch_workload"]
        plain = F.least(waiting, r["__most"])
        done = F.least(waiting, r["__free"], F.greatest(plain, waiting / r["__rem"]))
        left = waiting - done
        return F.struct(left.alias("left"), F.concat(s["done"], F.array(F.struct(done.alias("batch_service"), left.alias("backlog")))).alias("done"))

    none = F.array().cast("array<struct<batch_service:double,backlog:double>>")
    folded = F.aggregate("__rows", F.struct(F.col("__rows")[0]["waiting_before"].alias("left"), none.alias("done")), step, lambda s: s["done"])
    both = each.withColumn("__done", folded).select(F.explode(F.arrays_zip("__rows", "__done")).alias("r"))
    return both.select(*[F.col(f"r.__rows.{c}").alias(c) for c in columns], "r.__done.batch_service", "r.__done.backlog")


def workload(served: DataFrame, by: str, steps: int = blocks.STEPS) -> DataFrame:
    """Adds ``workload_fraction``: online work and what of any ``batch_service`` there is work for."""
    d = blocks.cut(served.drop("backlog"), steps).withColumn("__most", F.greatest(F.lit(0.0), F.col("batch_service")))
    d = blocks.with_waiting(d, by, "batch_workload", "__most")
    done = F.least(F.col("waiting_before") + F.col("batch_workload"), F.col("__most"))
    return d.withColumn("workload_fraction", F.greatest(F.lit(0.0), F.col("online_workload") + done)).drop("__block", "__most", "__n", "waiting_before")


def _aligned(signals: DataFrame, service: DataFrame, by: str) -> tuple[DataFrame, dict[str, Column]]:
    """Both sides step by step, and what must not be in them."""
    both = signals.withColumn("__asked", F.lit(True)).join(service.select(by, "step_index", "batch_service", F.lit(True).alias("__there")), [by, "step_index"], "full")
    return both, {"steps without a service": F.col("__there").isNull(), "services without a step": F.col("__asked").isNull()}


def with_service(signals: DataFrame, service: DataFrame, by: str) -> DataFrame:
    """``signals`` with the ``batch_service`` of ``service`` (by, step_index, batch_service), step by
    step; the two must have the same steps of the same series. The check is a job of its own; :func:`write_with_service` does it while writing."""
    both, wrong = _aligned(signals, service, by)
    lacking = both.agg(*[F.count_if(rule).alias(name) for name, rule in wrong.items()]).first().asDict()
    if any(lacking.values()):
        raise InputValidationError("batch service and signals differ: " + ", ".join(f"{n} {name}" for name, n in lacking.items()))
    return both.drop("__there", "__asked")


def write_with_service(signals: DataFrame, service: DataFrame, by: str, path: str) -> DataFrame:
    """The same as a table at ``path``, joined once: the check is observed in the job that writes."""
    both, wrong = _aligned(signals, service, by)
    written_checked(both, wrong, path)
    return both.sparkSession.read.parquet(path).drop("__there", "__asked")


def dispatched(signals: DataFrame, by: str, strategy: str, f: Facility) -> DataFrame:
    """Adds ``batch_service`` and ``workload_fraction``. Neither strategy serves more than
    waits, so all service is work done and :func:`workload` would add nothing."""
    if strategy == "immediate":
        served = immediate(signals)
    elif strategy == "price_aware_temporal_shift":
        served = price_aware(signals, by, f).drop("backlog")
    else:
        raise ConfigurationError(f"unknown dispatch strategy: {strategy}")
    return served.withColumn("workload_fraction", F.greatest(F.lit(0.0), F.col("online_workload") + F.col("batch_service")))
