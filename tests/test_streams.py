from pyspark.sql import functions as F

from thermolith.sources import signals as S
from thermolith.streaming import events


def run(stream, at, mode):
    q = stream.writeStream.format("memory").queryName(at).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def test_slots_equal_the_batch_count(spark, folder, tmp_path):
    whole = spark.read.parquet(f"{folder}/events.parquet")
    whole.write.parquet(f"{tmp_path}/e")
    run(events.slots(spark.readStream.schema(whole.schema).parquet(f"{tmp_path}/e")), "slots", "append")
    got = spark.table("slots")
    late = whole.agg(F.max("ts")).first()[0]
    want = whole.groupBy(F.date_trunc("hour", "ts").alias("h"), F.floor(F.minute("ts") / 15).alias("q")).count()
    assert got.agg(F.sum("n")).first()[0] <= whole.count()
    assert want.count() - got.count() <= 4 and got.agg(F.max("slot_start")).first()[0] < late


def test_running_totals(spark, tmp_path):
    rows = spark.range(10).select(F.lit(1).alias("run_id"), *[F.col("id").cast("double").alias(c) for c in ("grid_energy_kwh", "energy_cost_step", "carbon_kg_step", "temp_c")], F.lit(0).alias("temperature_violation"))
    rows.write.parquet(f"{tmp_path}/r")
    run(events.running_totals(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/r")), "totals", "update")
    r = spark.table("totals").orderBy(F.col("steps").desc()).first()
    assert (r["steps"], r["energy_cost"], r["maximum_temperature_c"]) == (10, 45.0, 9.0)


def test_both_layouts(spark):
    day = S.generate(spark).drop("step_index")
    a, b = S.both_layouts(day), S.both_layouts(S.legacy(day))
    assert a.columns == b.columns
    assert a.join(b.select("timestamp", F.col("renewable_power_kw").alias("r"), F.col("carbon").alias("c")), "timestamp").agg(F.max(F.abs(F.col("r") - F.col("renewable_power_kw")) + F.abs(F.col("c") - F.col("carbon")))).first()[0] < 1e-9
