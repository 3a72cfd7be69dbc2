"""CSV lines that can't be read, checks while writing."""

import os

import pytest
from pyspark.sql import functions as F

from thermolith.errors import InputValidationError
from thermolith.operators import dispatch
from thermolith.sources import signals as S


def test_every_line_is_good_or_rejected(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.csv").write_text("timestamp,x,y\n2024-01-01 00:00:00,1,2\n2024-01-01 00:15:00,one,2\n2024-01-01 00:30:00,,2\nlater,1,2\n,1,2\n2024-01-01 01:00:00,1\n2024-01-01 01:15:00,1,2,3\n2024-01-01 01:30:00,NaN,1e3\n")
    (tmp_path / "f/b.csv").write_text("timestamp,x,y\n2024-01-02 00:00:00,5,\"6\"\n2024-01-02 00:15:00,5,x y\n")
    good, bad = S.read_checked(spark, f"{tmp_path}/f")
    assert (good.count(), bad.count()) == (4, 6)
    assert good.where("x IS NULL").count() == 1 and good.agg(F.max("y")).first()[0] == 1000.0
    said = {(os.path.basename(r["file"]), r["line"]): r["reason"] for r in bad.collect()}
    assert said == {
        ("a.csv", "2024-01-01 00:15:00,one,2"): "x: no number", ("a.csv", "later,1,2"): "timestamp: no time", ("a.csv", ",1,2"): "timestamp: missing", ("a.csv", "2024-01-01 01:00:00,1"): "wrong number of fields",
        ("a.csv", "2024-01-01 01:15:00,1,2,3"): "wrong number of fields", ("b.csv", "2024-01-02 00:15:00,5,x y"): "y: no number",
    }
    zoned, _ = S.read_checked(spark, f"{tmp_path}/f/b.csv", zone="Asia/Shanghai")
    assert zoned.select(F.col("timestamp").cast("string")).first()[0] == "2024-01-01 16:00:00"
    with pytest.raises(InputValidationError):
        S.read_checked(spark, f"{tmp_path}/f", time="at")


def test_checks_are_made_in_the_job_that_writes(spark, tmp_path):
    rows = spark.range(100)
    assert S.written_checked(rows, {"negative": F.col("id") < 0}, f"{tmp_path}/good") == 100 and spark.read.parquet(f"{tmp_path}/good").count() == 100
    with pytest.raises(InputValidationError, match="large: 10, odd: 50"):
        S.written_checked(rows, {"large": F.col("id") >= 90, "negative": F.col("id") < 0, "odd": F.col("id") % 2 == 1}, f"{tmp_path}/bad")
    with pytest.raises(InputValidationError, match="no rows"):
        S.written_checked(rows.where("false"), {}, f"{tmp_path}/none")
    assert not os.path.exists(f"{tmp_path}/bad") and not os.path.exists(f"{tmp_path}/none")


def test_services_are_joined_once_and_checked_while_writing(spark, tmp_path):
    day = S.generate(spark).withColumn("center", F.lit(1))
    service = day.select("center", "step_index", (F.col("batch_workload") * 2).alias("batch_service"))
    assert dispatch.write_with_service(day, service, "center", f"{tmp_path}/a").count() == 96
    with pytest.raises(InputValidationError, match="steps without a service: 4"):
        dispatch.write_with_service(day, service.where("step_index > 3"), "center", f"{tmp_path}/b")
    with pytest.raises(InputValidationError, match="services without a step: 1"):
        dispatch.write_with_service(day, service.unionByName(service.limit(1).withColumn("step_index", F.lit(200))), "center", f"{tmp_path}/c")
