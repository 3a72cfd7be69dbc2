"""Windows over ordered series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Facility
from . import blocks


def ahead(by: str, n: int, order: str = "step_index", skip: int = 0) -> Window:
    return Window.partitionBy(by).orderBy(order).rowsBetween(skip, n - 1)


def forecast(df: DataFrame, by: str, horizon: int, columns: list[str]) -> DataFrame:
    """``forecast``: the rows from this one on, ``horizon`` at most, as an array of structs."""
    return df.withColumn("forecast", F.collect_list(F.struct(*columns)).over(ahead(by, horizon)))


def forward_min_price(df: DataFrame, by: str, lookahead: int) -> DataFrame:
    return df.withColumn("forward_min_price", F.min("electricity_price").over(ahead(by, lookahead)))


def steps_left(by: str) -> Column:
    return F.count("*").over(Window.partitionBy(by)) - F.col("step_index")


def precool_flag(df: DataFrame, by: str, f: Facility, name: str = "precool") -> DataFrame:
    """Whether cooling ahead pays: cheap now, and dear within the lookahead."""
    dear = F.max("electricity_price").over(ahead(by, f.precool_lookahead_steps, skip=1)) >= f.high_price if f.precool_lookahead_steps > 1 else F.lit(False)
    return df.withColumn(name, (F.lit(f.precool_enabled) & (F.col("electricity_price") <= f.low_price) & F.coalesce(dear, F.lit(False))).cast("int"))


def increasing(times: Column) -> Column:
    """Whether an array of times is strictly increasing."""
    n = F.size(times)
    return (n < 2) | F.forall(F.zip_with(F.slice(times, 1, F.greatest(n - 1, F.lit(0))), F.slice(times, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: b > a), lambda ok: ok)


def step_change(x: str, by: str, first: Column | float | None = None) -> Column:
    before = F.lag(x).over(Window.partitionBy(by).orderBy("step_index"))
    if first is not None:
        before = F.coalesce(before, first if isinstance(first, Column) else F.lit(float(first)))
    return F.col(x) - before


def movement(x: str, by: str, first: Column | float = 0.0) -> Column:
    return F.abs(step_change(x, by, first))


def longest_streak(df: DataFrame, by: str, flag: Column, name: str = "longest_streak", steps: int = blocks.STEPS) -> DataFrame:
    """The longest run of true steps by series, 0 if there is none: summaries of blocks of time, put together in order."""
    t = blocks.TwoLevels(steps)
    return t.of(df, by, {name: t.longest_streak(flag)})


def extreme(df: DataFrame, by: str, key: Column, what: list[str], largest: bool = True) -> DataFrame:
    """The row of the largest (smallest) key by series, the first of equal ones; a partial aggregate, no sort."""
    rank = F.struct((key if largest else -key).alias("k"), (-F.col("step_index")).alias("i"))
    return df.groupBy(by).agg(F.max_by(F.struct(*what), rank).alias("row")).select(by, "row.*")


def highest_window(df: DataFrame, by: str, column: str, n: int = 4) -> DataFrame:
    """(by, start_step, end_step, mean) of the window of n steps with the highest trailing mean, the first of equal ones."""
    w = Window.partitionBy(by).orderBy("step_index").rowsBetween(-(n - 1), 0)
    trailing = df.select(by, "step_index", F.when(F.count(F.lit(1)).over(w) == n, F.avg(column).over(w)).alias("mean")).where("mean IS NOT NULL")
    best = extreme(trailing, by, F.col("mean"), ["step_index", "mean"])
    return best.select(by, (F.col("step_index") - (n - 1)).alias("start_step"), F.col("step_index").alias("end_step"), "mean")


def window_sums(results: DataFrame, windows: DataFrame, by: str, hours: float = 0.25) -> DataFrame:
    """Sums and means of each scenario inside a window found once for each series.

    ``windows`` (by, signal, start_step, end_step) is an equi-join on the series, with the range as its condition.
    """
    inside = results.join(windows, by).where(F.col("step_index").between(F.col("start_step"), F.col("end_step")))
    return inside.groupBy(by, "signal", "scenario").agg(
        F.sum("batch_service").alias("batch_service"), F.sum(F.col("grid_power_kw") * hours).alias("grid_kwh"), F.sum(F.col("cooling_power_kw") * hours).alias("cooling_kwh"),
        F.sum(F.col("renewable_used_kw") * hours).alias("renewable_kwh"), F.avg("temp_c").alias("mean_temp_c"), F.avg("cooling_kw").alias("mean_control_kw"),
    )


def latest(df: DataFrame, by: list[str], order: str = "id") -> DataFrame:
    """The row of the largest ``order`` in each group, by a partial aggregate."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.col(order)).alias("row")).select(*by, "row.*")


def comparable(anchors: DataFrame, others: DataFrame, keys: list[str], order: str = "id", take: str = "id", name: str = "match_id") -> DataFrame:
    """Backward as-of join: for each anchor the latest of ``others`` with equal keys and no larger ``order``.

    Both sides are one union, carried forward by a window over the keys and the order: one
    shuffle, no range join, no pairs.
    """
    a = anchors.select(*keys, F.col(order).alias("__at"), F.lit(1).alias("__side"), F.struct(*anchors.columns).alias("__row"), F.lit(None).cast(others.schema[take].dataType).alias("__take"))
    b = others.select(*keys, F.col(order).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.col(take).alias("__take"))
    w = Window.partitionBy(*keys).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn(name, F.last("__take", ignorenulls=True).over(w)).where("__side = 1").select("__row.*", name)


def distinct_numbers(df: DataFrame, by: list[str], number: str) -> DataFrame:
    """(by, rows, distinct): rows and different whole numbers of each group, nulls not among them.

    The numbers of a group are bits in maps of 4 KB, one for each 32,768 numbers that lie together, which add up: no pair of group and number is shuffled.
    """
    held = df.groupBy(*by, F.bitmap_bucket_number(number).alias("__bucket")).agg(F.count("*").alias("__rows"), F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("__bits"))
    return held.groupBy(*by).agg(F.sum("__rows").alias("rows"), F.sum(F.when(F.col("__bucket").isNotNull(), F.bitmap_count("__bits")).otherwise(0)).alias("distinct"))


def comparable_within(df: DataFrame, keys: list[str], anchor: Column, other: Column, order: str = "id", take: str = "id", name: str = "match_id") -> DataFrame:
    """The rows of ``df`` for which ``anchor`` holds, each with the latest row of equal keys and no larger ``order`` for which ``other`` holds.

    One window over the keys; over a table that is clustered by them (see ``store.clustered``) nothing is shuffled.
    """
    upto = Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(F.when(other, F.col(take)), ignorenulls=True).over(upto)).where(anchor)
