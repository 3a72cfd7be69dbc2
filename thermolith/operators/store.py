"""Runs in Parquet tables, with a tracked life: running, then completed or failed.

A table is a folder; a write is an append of files or the replacement of partitions, so
nothing is ever read back to be rewritten whole. The run table is a log of versions:
the last version of an id (or name) is its row, and the log is compacted on demand.
Steps are staged beside the result table and promoted when the run is completed, so a
failed run leaves none; with ``commit_each_step`` they are appended at once.
"""

from __future__ import annotations

import json
import subprocess
from datetime import datetime, timezone
from typing import Protocol

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Facility
from ..errors import RunStateError, StorageError
from ..schema import RECORD_COLUMNS, TRANSIENT_COLUMNS
from . import sqltext

SCHEMA_VERSION = 2
#: DDL of the tables; what a legacy table lacks is added as null.
TABLES = {
    "datasets": "id long, name string, source_path string, time_step_minutes int, n_steps long, first_timestamp timestamp, last_timestamp timestamp, metadata string, version long",
    "experiment_runs": "id long, name string, scenario string, dataset_id long, controller_name string, condition_name string, seed long, config string, git_commit string, status string, message string, created_at timestamp, version long",
    "run_metrics": "run_id long, metric string, value double, version long",
    "schema_versions": "version int, applied_at timestamp",
}


def git_commit(root: str) -> str | None:
    try:
        return subprocess.run(["git", "-C", root, "rev-parse", "HEAD"], capture_output=True, text=True, check=True, timeout=10).stdout.strip() or None
    except (OSError, subprocess.SubprocessError):
        return None


def last_version(df: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """Upsert's result: of each key the row of the largest version, by a partial aggregate."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(version)).alias("row")).select(*keys, "row.*")


def widened(df: DataFrame, ddl: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """``df`` in the columns of ``ddl``: what it lacks is null or its default, what is more is kept after them."""
    target = df.sparkSession.createDataFrame([], ddl).schema
    out = []
    for field in target:
        value = F.col(field.name).cast(field.dataType) if field.name in df.columns else F.lit(None).cast(field.dataType)
        if defaults and field.name in defaults:
            value = F.coalesce(value, F.lit(defaults[field.name]).cast(field.dataType))
        out.append(value.alias(field.name))
    return df.select(*out, *[c for c in df.columns if c not in target.names])


def legacy_results(df: DataFrame, columns: list[str]) -> DataFrame:
    """Result rows from an older writer: missing numbers are 0.0, a missing reason is empty,
    missing curtailment is what is available and not used."""
    out = []
    for c in columns:
        if c in df.columns:
            out.append(F.col(c))
        elif c == "fallback_reason":
            out.append(F.lit("").alias(c))
        elif c == "renewable_curtailed_kw" and {"renewable_available_kw", "renewable_used_kw"} <= set(df.columns):
            out.append(F.greatest(F.lit(0.0), F.col("renewable_available_kw") - F.col("renewable_used_kw")).alias(c))
        else:
            out.append(F.lit(0.0).alias(c))
    return df.select(*out)


class Store(Protocol):
    """What a store of runs can do; :class:`RunStore` and :class:`NullStore` both can."""

    def initialize(self) -> "Store": ...

    def create_run(self, name: str, scenario: str, dataset_id: int, **more) -> int: ...

    def append_inputs(self, run_id: int, inputs: DataFrame) -> None: ...

    def append_steps(self, run_id: int, records: DataFrame) -> None: ...

    def finish_run(self, run_id: int, metrics: DataFrame) -> None: ...

    def fail_run(self, run_id: int, error: Exception | str) -> None: ...


RUN_COLUMNS = [c.split()[0] for c in TABLES["experiment_runs"].split(", ")]


class RunStore:
    """Runs under one folder.

    Ids and versions are claimed by creating a file that must not be there yet, so two
    writers never get the same one. Whether a run is running is read from the table, so
    another process may finish or fail it.
    """

    def __init__(self, spark: SparkSession, folder: str, commit_each_step: bool = False):
        self.spark, self.folder, self.commit_each_step = spark, folder.rstrip("/"), commit_each_step
        self._ready, self._config = False, "{}"

    def __enter__(self) -> "RunStore":
        return self.initialize()

    def __exit__(self, *_) -> None:
        self.close()

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def _at(self, table: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(table))
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, table: str) -> bool:
        p, fs = self._at(table)
        return fs.exists(p)

    def bind_config(self, config: Facility) -> None:
        """The configuration that runs are created with where none is given."""
        self._config = config.snapshot()

    def initialize(self) -> "RunStore":
        for name, ddl in TABLES.items():
            if not self.exists(name):
                self.spark.createDataFrame([], ddl).write.parquet(self.path(name))
        self._ready = True
        if self.read("schema_versions").where(F.col("version") == SCHEMA_VERSION).isEmpty():
            self._append("schema_versions", [(SCHEMA_VERSION, self._now())])
        return self

    def read(self, table: str) -> DataFrame:
        if not self._ready:
            raise StorageError("the store is not initialized")
        return widened(self.spark.read.option("mergeSchema", "true").parquet(self.path(table)), TABLES[table]) if table in TABLES else self.spark.read.parquet(self.path(table))

    def columns(self) -> DataFrame:
        """(table, position, column, type) of every table that is there."""
        rows = [(t, i, f.name, f.dataType.simpleString()) for t in (*TABLES, "input_timeseries", "run_input_timeseries", "simulation_results") if self.exists(t) for i, f in enumerate(self.read(t).schema, 1)]
        return self.spark.createDataFrame(rows, "table string, position int, column string, type string")

    def _now(self) -> datetime:
        return datetime.now(timezone.utc)

    def _append(self, table: str, rows: list[tuple]) -> None:
        if not self._ready or not self.exists(table):
            raise StorageError(f"no table {table}: the store is not initialized")
        self.spark.createDataFrame(rows, TABLES[table]).coalesce(1).write.mode("append").parquet(self.path(table))

    def _claim(self, kind: str, used: int) -> int:
        """The first number after ``used`` that nobody has claimed."""
        while True:
            used += 1
            p, fs = self._at(f"_claims/{kind}/{used}")
            try:
                fs.create(p, False).close()
                return used
            except Py4JJavaError:
                if not fs.exists(p):
                    raise

    def _next(self, table: str, ids: int = 1) -> tuple[list[int], int]:
        """Ids for so many new rows, and a version."""
        r = self.read(table).agg(F.coalesce(F.max("id"), F.lit(0)).alias("i"), F.coalesce(F.max("version"), F.lit(0)).alias("v")).first()
        own, last = [], r["i"]
        for _ in range(ids):
            last = self._claim(f"{table}-id", last)
            own.append(last)
        return own, self._claim(f"{table}-version", r["v"])

    def upsert_dataset(self, name: str, signals: DataFrame, source: str = "", step_minutes: int = 15, meta: dict | None = None) -> int:
        """A new version of the dataset of this name; its rows replace the older ones of its id alone."""
        old = self.read("datasets").where(F.col("name") == name).agg(F.max("id")).first()[0]
        fresh, version = self._next("datasets", 1 if old is None else 0)
        own = fresh[0] if old is None else old
        s = signals.agg(F.count("*"), F.min("timestamp"), F.max("timestamp")).first()
        signals.withColumn("dataset_id", F.lit(own).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_id").parquet(self.path("input_timeseries"))
        self._append("datasets", [(own, name, source, step_minutes, s[0], s[1], s[2], json.dumps(meta or {}, sort_keys=True, ensure_ascii=False), version)])
        return own

    def datasets(self) -> DataFrame:
        return last_version(self.read("datasets"), ["name"])

    def create_runs(self, rows: list[dict]) -> list[int]:
        """Several runs in one append; each of ``rows`` names what it has of RUN_COLUMNS."""
        ids, version = self._next("experiment_runs", len(rows))
        plain = {"config": self._config, "seed": 0, "status": "running", "created_at": self._now(), "version": version}
        full = [plain | {k: v for k, v in r.items() if v is not None} | {"id": i} for i, r in zip(ids, rows)]
        self._append("experiment_runs", [tuple(({"controller_name": r.get("scenario")} | r).get(c) for c in RUN_COLUMNS) for r in full])
        return ids

    def create_run(self, name: str, scenario: str, dataset_id: int, controller: str | None = None, condition: str | None = None, seed: int = 0, config: str | None = None, commit: str | None = None) -> int:
        return self.create_runs([{"name": name, "scenario": scenario, "dataset_id": dataset_id, "controller_name": controller or scenario, "condition_name": condition, "seed": seed, "config": config, "git_commit": commit}])[0]

    def runs(self) -> DataFrame:
        return last_version(self.read("experiment_runs"), ["id"])

    def _running(self, ids: list[int]) -> list[dict]:
        """The rows of these runs, all of which must be running."""
        rows = [r.asDict() for r in self.runs().where(F.col("id").isin(*ids)).collect()]  # as many as ids
        live = {r["id"] for r in rows if r["status"] == "running"}
        for i in ids:
            if i not in live:
                raise RunStateError(f"run {i} is not running")
        return rows

    def _status(self, rows: list[dict], status: str, message: str | None) -> None:
        _, version = self._next("experiment_runs", 0)
        changed = [r | {"status": status, "message": message, "version": version} for r in rows]
        self._append("experiment_runs", [tuple(r[c] for c in RUN_COLUMNS) for r in changed])

    def append_inputs(self, run_id: int, inputs: DataFrame) -> None:
        self._running([run_id])
        inputs.withColumn("run_id", F.lit(run_id).cast("long")).write.mode("append").partitionBy("run_id").parquet(self.path("run_input_timeseries"))

    def append_steps(self, run_id: int, records: DataFrame) -> None:
        self.append_steps_of([run_id], records.withColumn("run_id", F.lit(run_id).cast("long")))

    def append_steps_of(self, ids: list[int], records: DataFrame) -> None:
        """Records (with ``run_id``) of some runs without their transient columns, in one write: into
        the result table or, until they are finished, the runs' stages."""
        self._running(ids)
        kept = records.select("step_index", *[c for c in RECORD_COLUMNS if c not in TRANSIENT_COLUMNS and c in records.columns], F.col("run_id").cast("long").alias("run_id"))
        kept.write.mode("append").partitionBy("run_id").parquet(self.path("simulation_results" if self.commit_each_step else "_stage"))

    def store_batch(self, run_id: int, batch_id: int, rows: DataFrame) -> bool:
        """Stores a micro-batch of a stream once, however often it is delivered; whether it was new.

        The rows of a batch have a partition of their own, which a delivery that was cut off leaves to be replaced by the next one.
        A batch counts once its row in the ledger is there, a single file that appears whole; rows without one are never read.
        """
        if self._committed(run_id, batch_id):
            return False
        self._running([run_id])
        seen = Observation()
        at = f"run_id={run_id}/batch_id={batch_id}"
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(self.path(f"stream_steps/{at}"))
        ledger = self.spark.createDataFrame([(seen.get["n"], self._now())], "n_rows long, committed_at timestamp")
        ledger.coalesce(1).write.mode("overwrite").parquet(self.path(f"stream_batches/{at}"))
        return True

    def _committed(self, run_id: int, batch_id: int) -> bool:
        files, fs = self._at(f"stream_batches/run_id={run_id}/batch_id={batch_id}/part-*")
        return len(fs.globStatus(files) or ()) > 0

    def batches(self) -> DataFrame:
        """The ledger: (run_id, batch_id, n_rows, committed_at)."""
        ddl = "n_rows long, committed_at timestamp, run_id long, batch_id long"
        return self.spark.read.schema(ddl).parquet(self.path("stream_batches")) if self.exists("stream_batches") else self.spark.createDataFrame([], ddl)

    def streamed(self, run_id: int | None = None) -> DataFrame:
        """The rows of all committed batches, or of one run's, with run_id and batch_id."""
        if not self.exists("stream_steps"):
            raise StorageError("no stream has stored anything")
        rows = self.spark.read.option("mergeSchema", "true").parquet(self.path("stream_steps"))
        rows = rows.withColumns({"run_id": F.col("run_id").cast("long"), "batch_id": F.col("batch_id").cast("long")})
        own = rows if run_id is None else rows.where(F.col("run_id") == run_id)
        return own.join(self.batches().select("run_id", "batch_id"), ["run_id", "batch_id"], "left_semi")

    def finish_run(self, run_id: int, metrics: DataFrame) -> None:
        self.finish_runs([run_id], metrics.withColumn("run_id", F.lit(run_id).cast("long")))

    def finish_runs(self, ids: list[int], metrics: DataFrame) -> None:
        """Promotes the steps, writes the metrics (run_id, metric, value), then the statuses, each in one write."""
        rows = self._running(ids)
        staged = [self.path(f"_stage/run_id={i}") for i in ids if self.exists(f"_stage/run_id={i}")]
        if staged:
            steps = self.spark.read.option("basePath", self.path("_stage")).option("mergeSchema", "true").parquet(*staged)
            steps.withColumn("run_id", F.col("run_id").cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(self.path("simulation_results"))
        self._put_metrics(metrics)
        self._status(rows, "completed", None)
        for i in ids:
            self._drop(f"_stage/run_id={i}")

    def fail_run(self, run_id: int, error: Exception | str) -> None:
        self.fail_runs([run_id], error)

    def fail_runs(self, ids: list[int], error: Exception | str) -> None:
        rows = self._running(ids)
        for i in ids:
            self._drop(f"_stage/run_id={i}")
        self._status(rows, "failed", str(error))

    def _drop(self, table: str) -> None:
        p, fs = self._at(table)
        fs.delete(p, True)

    def _put_metrics(self, metrics: DataFrame) -> None:
        used = self.read("run_metrics").agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]
        version = self._claim("run_metrics-version", used)
        metrics.select(F.col("run_id").cast("long").alias("run_id"), "metric", "value", F.lit(version).cast("long").alias("version")).write.mode("append").parquet(self.path("run_metrics"))

    def upsert_metrics(self, run_id: int, metrics: DataFrame) -> None:
        self._put_metrics(metrics.withColumn("run_id", F.lit(run_id)))

    def metrics(self) -> DataFrame:
        return last_version(self.read("run_metrics"), ["run_id", "metric"]).drop("version")

    def views(self) -> None:
        """The store's tables as views of their names: of runs, datasets and metrics what stands now, and all else that is there."""
        sqltext.views(self.spark, experiment_runs=self.runs(), datasets=self.datasets(), run_metrics=self.metrics(), **{t: self.read(t) for t in ("input_timeseries", "run_input_timeseries", "simulation_results") if self.exists(t)})

    def ask(self, text: str, **args) -> DataFrame:
        """SQL over the store's tables as they are now, with arguments by name."""
        self.views()
        return sqltext.ask(self.spark, text, **args)

    def migrate(self, older: dict[str, DataFrame]) -> dict[str, int]:
        """Takes over a whole older store, given as tables by name (from files, SQLite or JDBC); rows by table.

        What an older run table lacks is null; its runs count as completed and go by their
        scenario where no controller is named. Older results and metrics keep their ids, so the store must be new.
        """
        self.initialize()
        if not self.read("experiment_runs").isEmpty():
            raise StorageError("an older store can only be taken over by an empty one")
        taken = {}
        for name, df in older.items():
            if name == "schema_versions":
                continue
            if name in TABLES:
                df = df.withColumn("version", F.lit(1).cast("long")) if "version" not in df.columns else df
                df = widened(df, TABLES[name], {"status": "completed"} if name == "experiment_runs" else None)
                if name == "experiment_runs":
                    df = df.withColumn("controller_name", F.coalesce("controller_name", "scenario"))
                df.select(*[c.split()[0] for c in TABLES[name].split(", ")]).write.mode("append").parquet(self.path(name))
            elif name == "simulation_results":
                legacy_results(df, ["run_id", "step_index", *[c for c in RECORD_COLUMNS if c not in TRANSIENT_COLUMNS]]).write.mode("append").partitionBy("run_id").parquet(self.path(name))
            else:
                df.write.mode("append").parquet(self.path(name))
            taken[name] = df.count()
        return taken

    def close(self) -> None:
        self._ready = False


class NullStore:
    """The same life of runs without any table."""

    def __init__(self):
        self.states: dict[int, str] = {}

    def initialize(self) -> "NullStore":
        return self

    def create_run(self, *_, **__) -> int:
        run_id = len(self.states) + 1
        self.states[run_id] = "running"
        return run_id

    def _require_running(self, run_id: int) -> None:
        if self.states.get(run_id) != "running":
            raise RunStateError(f"run {run_id} is not running")

    def append_inputs(self, run_id: int, inputs: DataFrame) -> None:
        self._require_running(run_id)

    def append_steps(self, run_id: int, records: DataFrame) -> None:
        self._require_running(run_id)
        records.write.format("noop").mode("overwrite").save()

    def finish_run(self, run_id: int, metrics: DataFrame | None = None) -> None:
        self._require_running(run_id)
        self.states[run_id] = "completed"

    def fail_run(self, run_id: int, error: Exception | str) -> None:
        self._require_running(run_id)
        self.states[run_id] = "failed"


def clustered(df: DataFrame, name: str, path: str, keys: list[str], order: str, buckets: int | None = None) -> DataFrame:
    """``df`` as a table at ``path`` whose rows of equal keys lie in one bucket, in ``order``: groups, windows and joins by these keys
    read it without a shuffle. One shuffle while writing, so that a bucket is one file."""
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, *keys).write.mode("overwrite").bucketBy(n, *keys).sortBy(*keys, order).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def numbered(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Child rows numbered from 0 in each group."""
    return df.withColumn("step_index", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
