"""Signal series: from CSV, from events, generated; and checks of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import InputValidationError
from ..schema import LEGACY_COLUMNS, SIGNAL_COLUMNS, SIGNALS

SLOTS = 96


def require_columns(df: DataFrame, wanted) -> None:
    lacking = sorted(set(wanted) - set(df.columns))
    if lacking:
        raise InputValidationError("missing columns: " + ", ".join(lacking))


def local_time(ts: Column, zone: str) -> Column:
    """An instant from wall-clock text or NTZ in ``zone``; a text with an offset keeps its instant."""
    text = ts.cast("string")
    return F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.to_timestamp(text)).otherwise(F.to_utc_timestamp(F.to_timestamp_ntz(text), zone))


def normalized(df: DataFrame) -> DataFrame:
    """Legacy columns to canonical ones: carbon from g to kg, renewable from a share to kW."""
    require_columns(df, LEGACY_COLUMNS)
    scale = {"carbon": lambda c: c / 1000.0, "renewable": lambda c: c * 100.0}
    return df.select(*[(F.col(old) if old == "timestamp" else scale.get(old, lambda c: c)(F.col(old).cast("double"))).alias(new) for old, new in LEGACY_COLUMNS.items()])


def legacy(df: DataFrame) -> DataFrame:
    """Canonical columns to legacy ones."""
    require_columns(df, SIGNAL_COLUMNS)
    scale = {"carbon": lambda c: c * 1000.0, "renewable": lambda c: c / 100.0}
    return df.select(*[scale.get(old, lambda c: c)(F.col(new)).alias(old) for old, new in LEGACY_COLUMNS.items()])


def fallback(df: DataFrame, canonical: str, older: str, default: float | None = None, scale: float = 1.0) -> Column:
    """The canonical column, where it is missing or null the older one times ``scale``, else the default."""
    tried = [F.col(c).cast("double") * F.lit(k) for c, k in ((canonical, 1.0), (older, scale)) if c in df.columns]
    return F.coalesce(*tried, F.lit(default).cast("double"))


def both_layouts(df: DataFrame) -> DataFrame:
    """The time, and the values in the older and the canonical columns, each filled from the other."""
    factor = {"carbon": 1 / 1000.0, "renewable": 100.0}
    own = [fallback(df, new, old, 0.0, factor.get(old, 1.0)).alias(new) for old, new in LEGACY_COLUMNS.items() if old != "timestamp"]
    older = [fallback(df, old, new, 0.0, 1 / factor.get(old, 1.0)).alias(old) for old, new in LEGACY_COLUMNS.items() if old != "timestamp"]
    return df.select("timestamp", *older, *own)


def read_csv(spark: SparkSession, path: str, zone: str = "Asia/Shanghai", source: str = "csv") -> tuple[DataFrame, str]:
    """A signal file in either layout, and its source tag."""
    raw = spark.read.option("header", True).csv(path)
    if set(SIGNAL_COLUMNS) <= set(raw.columns):
        tag, df = source, raw.select(*[F.col(c) if c == "timestamp" else F.col(c).cast("double").alias(c) for c in SIGNAL_COLUMNS])
    else:
        tag, df = f"{source}:legacy-normalized", normalized(raw)
    return df.withColumn("timestamp", local_time(F.col("timestamp"), zone)), tag


def read_sorted(spark: SparkSession, path: str, columns=tuple(LEGACY_COLUMNS)) -> DataFrame:
    """A legacy file: columns checked, not empty, in time order."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    require_columns(df, columns)
    if df.isEmpty():
        raise InputValidationError("no rows")
    return df.select(F.to_timestamp_ntz("timestamp").alias("timestamp"), *[F.col(c).cast("double").alias(c) for c in columns if c != "timestamp"]).orderBy("timestamp")


#: Bad lines of :func:`read_checked`.
REJECTED = "file string, line string, reason string"


def read_checked(spark: SparkSession, path: str, columns: list[str] | None = None, time: str = "timestamp", zone: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected lines) of CSV files; every line is in one of the two.

    ``columns``: their names in order, for files without a header; else the header's. All but ``time`` are numbers. Good rows have
    them as doubles, and the time as :func:`local_time` reads it (a wall-clock time without ``zone``). A line is rejected, with its file and the first reason that holds, if it has
    too few or too many fields, no time or one that can't be read, or a field that is no number. An empty field is a null,
    not a fault; rules on values are :func:`quality`'s.
    """
    reader = spark.read.option("header", columns is None)
    names = columns or reader.csv(path).columns
    require_columns(spark.createDataFrame([], ", ".join(f"`{n}` string" for n in names)), [time])
    ddl = ", ".join(f"`{n}` string" for n in (*names, "__bad"))
    raw = reader.schema(ddl).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__bad").option("columnPruning", False).option("enforceSchema", True).csv(path)
    raw = raw.withColumn("__file", F.col("_metadata.file_path"))
    at = F.try_to_timestamp(F.col(time)) if zone else F.col(time).try_cast("timestamp_ntz")
    wrong = F.when(F.col("__bad").isNotNull(), F.lit("wrong number of fields")).when(F.trim(F.coalesce(F.col(time), F.lit(""))) == "", F.lit(f"{time}: missing")).when(at.isNull(), F.lit(f"{time}: no time"))
    for c in (n for n in names if n != time):
        wrong = wrong.when(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull(), F.lit(f"{c}: no number"))
    raw = raw.withColumn("__reason", wrong)
    read = local_time(F.col(time), zone) if zone else at
    good = raw.where("__reason IS NULL").select(*[read.alias(c) if c == time else F.col(c).try_cast("double").alias(c) for c in names])
    line = F.coalesce("__bad", F.concat_ws(",", *[F.coalesce(F.col(c), F.lit("")) for c in names]))
    return good, raw.where("__reason IS NOT NULL").select(F.col("__file").alias("file"), line.alias("line"), F.col("__reason").alias("reason"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def steps(df: DataFrame, by: str = "dataset_id", time: str = "timestamp") -> DataFrame:
    return df.withColumn("step_index", F.row_number().over(Window.partitionBy(by).orderBy(time)) - 1)


def quality(df: DataFrame, by: str, step_minutes: int = 15, time: str = "timestamp") -> DataFrame:
    """Counts of broken rules by series; all are 0 in a valid one.

    Order is that of ``step_index``. ``not_monotonic``: steps back; ``duplicates``; ``gaps``: steps that are
    not the fixed step; ``not_finite``: rows with a value that is null, NaN or infinite;
    ``negative_renewable``.
    """
    values = [c for c in SIGNAL_COLUMNS if c != "timestamp"]
    w = Window.partitionBy(by).orderBy("step_index")
    good = None
    for c in values:
        ok = F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
        good = ok if good is None else good & ok
    ahead = (F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(w).cast("timestamp"))) / F.lit(60_000_000)
    return df.withColumn("ahead", ahead).groupBy(by).agg(
        F.count("*").alias("n_steps"),
        F.count_if(F.col("ahead") < 0).alias("not_monotonic"),
        (F.count("*") - F.countDistinct(time)).alias("duplicates"),
        F.count_if(F.col("ahead") != step_minutes).alias("gaps"),
        F.count_if(~good).alias("not_finite"),
        F.count_if(F.col("renewable_power_kw") < 0).alias("negative_renewable"),
    )


def validated(df: DataFrame, by: str = "dataset_id", step_minutes: int = 15) -> DataFrame:
    """``df``, or an error that names the broken rules; one aggregate, no rows brought to the driver but bad ones' counts."""
    rules = ["not_monotonic", "duplicates", "gaps", "not_finite", "negative_renewable"]
    seen = quality(df, by, step_minutes).agg(F.count("*").alias("n"), *[F.sum(r).alias(r) for r in rules]).first()
    if not seen["n"]:
        raise InputValidationError("the series is empty")
    broken = [r for r in rules if seen[r]]
    if broken:
        raise InputValidationError("broken rules: " + ", ".join(broken))
    return df


def written_checked(df: DataFrame, rules: dict[str, Column], path: str, format: str = "parquet") -> int:
    """Writes ``df`` and counts what breaks each rule (a condition that should not hold) in the same pass; the number of rows.

    If any does, nothing is left at ``path`` and the error says how many rows broke which rule. ``path`` must not exist.
    """
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("n"), *[F.count_if(rule).alias(f"r{i}") for i, rule in enumerate(rules.values())]]
    df.observe(seen, *counts).write.format(format).mode("error").save(path)
    found = seen.get
    broken = [f"{name}: {found[f'r{i}']}" for i, name in enumerate(rules) if found[f"r{i}"]]
    if broken or not found["n"]:
        p = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        raise InputValidationError("broken rules: " + ", ".join(broken) if broken else "no rows")
    return found["n"]


def metadata(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp"), F.count("*").alias("n_steps"))


def at_step(df: DataFrame, index: int) -> DataFrame:
    """The row of one step; an error outside of the series."""
    if index < 0 or df.where(F.col("step_index") == index).isEmpty():
        raise IndexError("the step is outside of the series")
    return df.where(F.col("step_index") == index)


def iso_text(time: Column, zone: str | None = None) -> Column:
    """A time as ISO text with a space; an instant in ``zone`` has its offset, a wall-clock time has none."""
    if zone is None:
        return F.date_format(time, "yyyy-MM-dd HH:mm:ss")
    wall = F.from_utc_timestamp(time, zone)
    minutes = F.round((F.unix_micros(wall) - F.unix_micros(time)) / F.lit(60_000_000)).cast("int")
    offset = F.format_string("%s%02d:%02d", F.when(minutes < 0, "-").otherwise("+"), F.floor(F.abs(minutes) / 60).cast("int"), F.abs(minutes) % 60)
    return F.concat(F.date_format(wall, "yyyy-MM-dd HH:mm:ss"), offset)


# The standard day's generator.
GENERATOR = {
    "seed": 42, "start_timestamp": "2026-01-01T00:00:00", "timezone": "Asia/Shanghai", "steps": 96, "time_step_minutes": 15, "renewable_enabled": True, "renewable_peak_kw": 320.0,
    "workload_noise_std": 0.012, "batch_noise_std": 0.008, "price_noise_std": 0.012, "carbon_noise_std": 0.010, "temperature_noise_std_c": 0.15, "source": "synthetic-standard-v1",
}


def generate(spark: SparkSession, **options) -> DataFrame:
    """The standard synthetic day. The shapes are column expressions over a sequence of
    steps; the noise, five runs of draws from one seeded NumPy generator, is joined by
    step (a day's worth, bounded by ``steps``)."""
    o = GENERATOR | options
    if o["source"] != "synthetic-standard-v1":
        raise InputValidationError(f"unknown source: {o['source']}")
    n = int(o["steps"])
    rng = np.random.default_rng(int(o["seed"]))
    noise = [rng.normal(0.0, float(o[f"{k}_noise_std"]), n) for k in ("workload", "batch", "price", "carbon")] + [rng.normal(0.0, float(o["temperature_noise_std_c"]), n)]
    drawn = spark.createDataFrame([(i, *(float(x[i]) for x in noise)) for i in range(n)], "step_index int, e1 double, e2 double, e3 double, e4 double, e5 double")
    hour = F.col("step_index") * F.lit(float(o["time_step_minutes"])) / F.lit(60.0)
    bump = lambda at, width: F.exp(F.lit(-0.5) * F.pow((hour - F.lit(at)) / F.lit(width), F.lit(2.0)))
    m, e = bump(8.0, 2.0), bump(17.0, 2.3)
    sun = F.pow(F.greatest(F.sin(F.pi() * (hour - 6.0) / 12.0), F.lit(0.0)), F.lit(1.6))
    clip = lambda x, a, b: F.least(F.greatest(x, F.lit(a)), F.lit(b))
    wave = lambda shift: F.sin(F.lit(2.0) * F.pi() * (hour + shift) / 24.0)
    start = F.to_utc_timestamp(F.to_timestamp_ntz(F.lit(o["start_timestamp"])), o["timezone"])
    return drawn.select(
        "step_index",
        F.timestamp_add("MINUTE", F.col("step_index") * int(o["time_step_minutes"]), start).alias("timestamp"),
        clip(F.lit(0.32) + F.lit(0.28) * m + F.lit(0.34) * e + F.col("e1"), 0.22, 0.82).alias("online_workload"),
        clip(F.lit(0.12) + F.lit(0.13) * bump(5.5, 2.4) + F.lit(0.10) * bump(13.0, 3.0) + F.col("e2"), 0.05, 0.34).alias("batch_workload"),
        clip(F.lit(0.43) + F.lit(0.32) * m + F.lit(0.50) * e - F.lit(0.14) * bump(2.0, 2.7) + F.col("e3"), 0.20, 1.10).alias("electricity_price"),
        clip(F.lit(0.49) + F.lit(0.05) * m + F.lit(0.16) * e - F.lit(0.11) * sun + F.lit(0.025) * wave(1.5) + F.col("e4"), 0.25, 0.80).alias("carbon_intensity_kg_per_kwh"),
        (F.lit(15.0) + F.lit(10.5) * wave(-7.0) + F.col("e5")).alias("outdoor_temperature_c"),
        (F.lit(float(o["renewable_peak_kw"]) if o["renewable_enabled"] else 0.0) * sun).alias("renewable_power_kw"),
    )


def prepared(spark: SparkSession, path: str, regenerate: bool = True, zone: str = "Asia/Shanghai", **options) -> DataFrame:
    """The standard day's file, generated first (again, or with ``regenerate=False`` only if there is none), then read as any other."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if regenerate or not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        write_csv(generate(spark, **options).drop("step_index"), path)
    df, _ = read_csv(spark, path, zone)
    return steps(df.withColumn("__one", F.lit(1)), "__one").drop("__one")


def outside_grid(events: DataFrame, first_day: str = "2024-01-01", days: int = 30) -> int:
    """How many events :func:`from_events` leaves out: those without a time or outside of its days."""
    day = F.date_diff(F.col("ts").cast("date"), F.lit(first_day).cast("date"))
    return events.where(~F.coalesce(day.between(0, days - 1), F.lit(False))).count()


def span_of(events: DataFrame) -> dict:
    """``first_day`` and ``days`` of :func:`from_events` such that no event with a time is left out; one aggregate."""
    first, last = events.agg(F.min(F.col("ts").cast("date")), F.max(F.col("ts").cast("date"))).first()
    if first is None:
        raise InputValidationError("no event has a time")
    return {"first_day": first.isoformat(), "days": (last - first).days + 1}


def from_events(events: DataFrame, first_day: str = "2024-01-01", days: int = 30) -> DataFrame:
    """Fifteen-minute signals from an event stream, one series (``center``) a day.

    Events are counted by slot before any shuffle of theirs; the full grid of slots is
    joined to the counts. Scales are relative to the largest slot. The grid's days are given:
    events outside of them still count for the largest slot, and :func:`outside_grid` counts them. :func:`span_of` has the days that leave none out.
    """
    slot = F.hour("ts") * 4 + F.floor(F.minute("ts") / 15).cast("int")
    counted = events.where(F.col("ts").isNotNull()).groupBy(F.date_diff(F.col("ts").cast("date"), F.lit(first_day).cast("date")).alias("day"), slot.alias("slot")).agg(
        F.count("*").cast("double").alias("n"), F.count_if(F.col("event_type") == "purchase").cast("double").alias("p"), F.round(F.sum("value"), 2).alias("v")
    )
    top = counted.agg(F.max("n").alias("nmax"), F.max("v").alias("vmax"))
    grid = events.sparkSession.range(days * SLOTS).select(F.floor(F.col("id") / SLOTS).cast("int").alias("day"), F.pmod("id", F.lit(SLOTS)).cast("int").alias("slot"))
    zero = F.lit(0.0)
    full = grid.join(counted, ["day", "slot"], "left").crossJoin(F.broadcast(top))  # one row
    n, p, v = (F.coalesce(F.col(c), zero) for c in ("n", "p", "v"))
    hour = F.col("slot") * F.lit(0.25)
    return full.select(
        (F.col("day") + 1).alias("center"), F.col("slot").alias("step_index"),
        F.timestamp_add("MINUTE", (F.col("day") * SLOTS + F.col("slot")) * 15, F.to_timestamp_ntz(F.lit(first_day + " 00:00:00"))).alias("timestamp"),
        (F.lit(0.22) + F.lit(0.60) * n / F.col("nmax")).alias("online_workload"),
        (F.lit(0.05) + F.lit(0.29) * p / F.col("nmax")).alias("batch_workload"),
        (F.lit(0.20) + F.lit(0.90) * v / F.col("vmax")).alias("electricity_price"),
        (F.lit(0.25) + F.lit(0.05) * (n % F.lit(7.0))).alias("carbon_intensity_kg_per_kwh"),
        F.round(F.lit(15.0) + F.lit(10.5) * F.sin(F.lit(2.0) * F.pi() * (hour - F.lit(7.0)) / F.lit(24.0)), 6).alias("outdoor_temperature_c"),
        (F.lit(320.0) * F.round(F.pow(F.greatest(F.sin(F.pi() * (hour - F.lit(6.0)) / F.lit(12.0)), zero), F.lit(1.6)), 6)).alias("renewable_power_kw"),
    )


