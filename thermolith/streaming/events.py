"""Events and records as streams: slots by event time, and running totals of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def slots(events: DataFrame, lateness: str = "30 minutes") -> DataFrame:
    """(slot_start, n, purchases, value): fifteen-minute slots of a stream of events. A slot
    is put out once the watermark has passed it; later events of it are dropped."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    return timed.groupBy(F.window("at", "15 minutes")).agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.round(F.sum("value"), 2).alias("value")
    ).select(F.col("window.start").alias("slot_start"), "n", "purchases", "value")


def running_totals(records: DataFrame, by: str = "run_id") -> DataFrame:
    """Totals of each run so far, for ``update`` output: one row of state a run, no list of steps."""
    return records.groupBy(by).agg(
        F.count("*").alias("steps"), F.sum("grid_energy_kwh").alias("energy_kwh"), F.sum("energy_cost_step").alias("energy_cost"), F.sum("carbon_kg_step").alias("carbon_kg"),
        F.max("temp_c").alias("maximum_temperature_c"), F.sum("temperature_violation").alias("temperature_violation_count"),
    )
