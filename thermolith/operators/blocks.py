"""Long series in blocks of time.

A series is cut into blocks of so many steps. What a block does to what comes before it is a
summary of fixed size; summaries are put together in order, and what comes in at the
start of a block is handed back to it. So the steps of one series lie in as many tasks as it has blocks,
and what meets by series is one row a block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Steps of a block.
STEPS = 4096


def cut(df: DataFrame, steps: int = STEPS, order: str = "step_index") -> DataFrame:
    """``df`` with ``__block``."""
    return df.withColumn("__block", F.floor(F.col(order) / F.lit(steps)))


def cut_with_halo(df: DataFrame, halo: int, steps: int = STEPS, order: str = "step_index") -> DataFrame:
    """The same, with the first ``halo`` steps of a block once more at the end of the block before (``__halo`` true)."""
    block = F.floor(F.col(order) / F.lit(steps))
    both = F.when((F.col(order) % steps < halo) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    return df.withColumn("__block", F.explode(both)).withColumn("__halo", F.col("__block") != block)


def block_window(by: str, order: str = "step_index") -> Window:
    return Window.partitionBy(by, "__block").orderBy(order)


def with_waiting(df: DataFrame, by: str, arrive: str, capacity: str, order: str = "step_index") -> DataFrame:
    """Adds ``waiting_before``, what is left over before each step of left' = max(0, left + arrive - capacity), from 0, and
    ``__n``, the steps of the series. ``df`` is cut into blocks.

    A step is x -> max(m, x + s) with m = 0; such functions are closed under composition, and that of the first t steps
    takes 0 to their running sum less its least value so far (0 included). Sums and least values are windows of a block;
    those of whole blocks are carried on.
    """
    w = block_window(by, order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("__change", F.col(arrive) - F.col(capacity)).withColumn("__sum", F.sum("__change").over(w))
    local = local.withColumn("__least", F.min("__sum").over(before))
    blocks = local.groupBy(by, "__block").agg(F.max_by("__sum", order).alias("__total"), F.min("__sum").alias("__low"), F.count("*").alias("__rows"))
    earlier = Window.partitionBy(by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.withColumn("__came", F.coalesce(F.sum("__total").over(earlier), F.lit(0.0)))
    carried = carried.withColumn("__came_least", F.min(F.col("__came") + F.col("__low")).over(earlier)).withColumn("__n", F.sum("__rows").over(Window.partitionBy(by)))
    both = local.join(carried.select(by, "__block", "__came", "__came_least", "__n"), [by, "__block"])
    sum_before = F.col("__came") + F.col("__sum") - F.col("__change")
    least = F.least(F.lit(0.0), F.col("__came_least"), F.col("__came") + F.col("__least"), sum_before)
    return both.withColumn("waiting_before", sum_before - least).drop("__change", "__sum", "__least", "__came", "__came_least")


def _streak(n, head, tail, best) -> Column:
    return F.struct(*(F.coalesce(x, F.lit(0)).cast("bigint").alias(name) for x, name in ((n, "n"), (head, "head"), (tail, "tail"), (best, "best"))))


def streak_of(flags: Column) -> Column:
    """Of an array of flags in order: its length, the runs of true ones at its start and its end, and the longest one."""
    def step(s: Column, flag: Column) -> Column:
        held = F.coalesce(flag, F.lit(False))
        run = F.when(held, s["tail"] + 1).otherwise(F.lit(0))
        return _streak(s["n"] + 1, F.when(held & (s["head"] == s["n"]), s["head"] + 1).otherwise(s["head"]), run, F.greatest(s["best"], run))

    return F.aggregate(flags, _streak(*[F.lit(0)] * 4), step)


def streaks_merged(parts: Column) -> Column:
    """The summary of series that follow each other, from theirs."""
    def both(a: Column, b: Column) -> Column:
        head = F.when(a["head"] == a["n"], a["n"] + b["head"]).otherwise(a["head"])
        tail = F.when(b["tail"] == b["n"], a["tail"] + b["n"]).otherwise(b["tail"])
        return _streak(a["n"] + b["n"], head, tail, F.greatest(a["best"], b["best"], a["tail"] + b["head"]))

    return F.aggregate(parts, _streak(*[F.lit(0)] * 4), both)


class TwoLevels:
    """An aggregate by series that is first made by block.

    Each function takes an expression over rows and returns one over blocks; :meth:`of` makes both levels.
    """

    def __init__(self, steps: int = STEPS, order: str = "step_index"):
        self.steps, self.order = steps, order
        self.parts: dict[str, Column] = {}
        self.flags: list[Column] = []

    def _part(self, x: Column) -> Column:
        """The same part is made once."""
        name = next((n for n, p in self.parts.items() if str(p) == str(x)), f"__p{len(self.parts)}")
        self.parts.setdefault(name, x)
        return F.col(name)

    def sum(self, x) -> Column:
        return F.sum(self._part(F.sum(x)))

    def max(self, x) -> Column:
        return F.max(self._part(F.max(x)))

    def min(self, x) -> Column:
        return F.min(self._part(F.min(x)))

    def avg(self, x) -> Column:
        n = F.sum(self._part(F.count(x)))
        return F.when(n > 0, F.sum(self._part(F.sum(x))).cast("double") / n)

    def count_if(self, x: Column) -> Column:
        return F.sum(self._part(F.count_if(x)))

    def last(self, x: str) -> Column:
        """The value of the last step."""
        part = self._part(F.max(F.struct(F.col(self.order).alias("at"), F.col(x).alias("value"))))
        return F.max(part)["value"]

    def longest_streak(self, flag: Column) -> Column:
        """The longest run of steps whose flag holds; a null flag breaks it."""
        self.flags.append(F.coalesce(flag, F.lit(False)).alias(f"f{len(self.flags)}"))
        return F.col(f"__s{len(self.flags) - 1}")["best"]

    def of(self, df: DataFrame, by: str, wanted: dict[str, Column]) -> DataFrame:
        """(by, names of ``wanted``)."""
        parts = [x.alias(n) for n, x in self.parts.items()]
        if self.flags:
            parts.append(F.array_sort(F.collect_list(F.struct(F.col(self.order).alias("at"), *self.flags))).alias("__steps"))  # of one block
        blocks = cut(df, self.steps, self.order).groupBy(by, "__block").agg(*parts)
        for i in range(len(self.flags)):
            blocks = blocks.withColumn(f"__s{i}", streak_of(_field("__steps", f"f{i}")))
        kept = {k: v for k, v in wanted.items() if "__s" not in str(v)}
        whole = [v.alias(k) for k, v in kept.items()]
        if self.flags:
            whole.append(F.array_sort(F.collect_list(F.struct("__block", *[f"__s{i}" for i in range(len(self.flags))]))).alias("__parts"))  # a row a block
        out = blocks.groupBy(by).agg(*whole)
        for i in range(len(self.flags)):
            out = out.withColumn(f"__s{i}", streaks_merged(_field("__parts", f"__s{i}")))
        return out.select(by, *[F.col(k) if k in kept else v.alias(k) for k, v in wanted.items()])


def _field(array: str, name: str) -> Column:
    take: Callable[[Column], Column] = lambda s: s[name]
    return F.transform(array, take)
