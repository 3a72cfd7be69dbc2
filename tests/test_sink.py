"""Streams into the store: every batch once, runs that live as long as their streams."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from thermolith.errors import RunStateError
from thermolith.operators.store import RunStore
from thermolith.streaming import sink


@pytest.fixture
def store(spark, tmp_path):
    return RunStore(spark, f"{tmp_path}/store").initialize()


def total(rows):
    return rows.agg(F.count("*"), F.sum("id")).first()[:]


def test_a_batch_delivered_again_changes_nothing(spark, store):
    run = store.create_run("s", "stream", 1)
    assert store.store_batch(run, 0, spark.range(10)) and store.store_batch(run, 1, spark.range(10, 15))
    before = sorted(map(tuple, store.batches().collect()))
    assert not store.store_batch(run, 0, spark.range(10)) and not store.store_batch(run, 1, spark.range(10, 15))
    assert total(store.streamed(run)) == (15, sum(range(15))) and sorted(map(tuple, store.batches().collect())) == before


def test_a_batch_cut_off_before_its_ledger_row_is_not_seen_and_replaced(spark, store):
    run = store.create_run("s", "stream", 1)
    store.store_batch(run, 0, spark.range(3))
    spark.range(100, 200).write.parquet(store.path(f"stream_steps/run_id={run}/batch_id=1"))  # all that a dead driver left
    assert total(store.streamed(run)) == (3, 3)
    assert store.store_batch(run, 1, spark.range(3, 5)) and total(store.streamed(run)) == (5, 10)


def test_only_running_runs_take_batches(spark, store):
    run = store.create_run("s", "stream", 1)
    store.fail_run(run, "over")
    with pytest.raises(RunStateError):
        store.store_batch(run, 0, spark.range(3))


def stream(spark, at, files=3):
    spark.range(30).repartition(files).write.parquet(f"{at}/in")
    return spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{at}/in")


def test_a_stream_that_ends_completes_its_run(spark, store, tmp_path):
    run = store.create_run("s", "stream", 1)
    life = sink.Lifecycle(store, lambda rows: rows.agg(F.sum("id").cast("double").alias("value")).select(F.lit("sum").alias("metric"), "value"))
    spark.streams.addListener(life)
    try:
        sink.start(stream(spark, tmp_path), store, run, f"{tmp_path}/log", life, availableNow=True).awaitTermination()
        life.wait(run)
    finally:
        spark.streams.removeListener(life)
    assert store.batches().count() == 3 and total(store.streamed(run)) == (30, 435)
    assert store.runs().where(F.col("id") == run).first()["status"] == "completed"
    assert [tuple(r) for r in store.metrics().collect()] == [(run, "sum", 435.0)]


def test_a_stream_that_dies_fails_its_run_and_another_process_sees_it(spark, store, tmp_path):
    run = store.create_run("s", "stream", 1)
    life = sink.Lifecycle(store)
    spark.streams.addListener(life)
    try:
        broken = stream(spark, tmp_path).withColumn("id", F.when(F.col("id") == 17, F.raise_error(F.lit("the meter is gone"))).otherwise(F.col("id")).cast("long"))
        with pytest.raises(Exception, match="the meter is gone"):
            sink.start(broken, store, run, f"{tmp_path}/log", life, availableNow=True).awaitTermination()
        life.wait(run)
    finally:
        spark.streams.removeListener(life)
    row = store.runs().where(F.col("id") == run).first()
    assert row["status"] == "failed" and "the meter is gone" in row["message"]
    code = f"from thermolith.session import session; from thermolith.operators.store import RunStore; s = session('local[1]'); r = RunStore(s, {store.folder!r}).initialize().runs().where('id = {run}').first(); print('SAID', r['status'], 'the meter is gone' in r['message'])"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert "SAID failed True" in out.stdout, out.stderr[-500:]


def test_a_stream_goes_on_from_its_checkpoint(spark, store, tmp_path):
    """The stream stops in its second batch, before the ledger row; started again it stores each batch once."""
    run = store.create_run("s", "stream", 1)
    rows, calls = stream(spark, tmp_path), []

    def dies(batch, number):
        calls.append(number)
        if number == 1:
            batch.write.parquet(store.path(f"stream_steps/run_id={run}/batch_id=1"))
            raise RuntimeError("the driver is gone")
        store.store_batch(run, number, batch)

    with pytest.raises(Exception, match="the driver is gone"):
        rows.writeStream.option("checkpointLocation", f"{tmp_path}/log").foreachBatch(dies).trigger(availableNow=True).start().awaitTermination()
    sink.start(rows, store, run, f"{tmp_path}/log", availableNow=True).awaitTermination()
    assert calls == [0, 1] and total(store.streamed(run)) == (30, 435)
    assert sorted(r["batch_id"] for r in store.batches().collect()) == [0, 1, 2]
