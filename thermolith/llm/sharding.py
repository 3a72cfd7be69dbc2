"""Consistent-hash ring with virtual nodes and bounded loads.

The ring is a circle of ``CELLS`` equal cells. A key lies in the cell that the hash of
its id names; each shard stands at ``vnodes`` cells. A key goes to the first shard at
or after its cell; a shard takes no more rows than its bound, and what overflows it
continues clockwise to the next shard that has room. The bounds add up to the number
of rows (the first shards take the remainder), so every shard is full in the end and
counts differ by one at most.

Only counts by cell and sub-cell are brought to the driver: ``CELLS * SUBS`` numbers and
``HOT * SPLITS`` more at most, however many rows there are. Which rows of a cell a shard takes is a range of
their order inside the cell, so the placement is a table of ranges with that same
bound, and it joins back by cell. The order inside a cell is (sub-cell, id, checksum);
sub-cells come from the text's checksum, so rows that share an id are ordered by several
tasks. Rows without an id lie in the cell that their checksum names. A sub-cell of over one in ``HOT`` of the
rows, such as one of equal rows, is ordered by as many as ``SPLITS`` tasks: the rows' keys are written once, with
the number of the partition that each was read in, and such a sub-cell is split by it.
"""

from __future__ import annotations

import bisect
import hashlib
import json
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .shared import written

CELLS = 8192
SUBS = 8
HOT, SPLITS = 1000, 64


def ring(shards: int, vnodes: int) -> tuple[list[int], list[int]]:
    """Cells and shards of the virtual nodes, in clockwise order. A shard's nodes do
    not depend on the number of shards, but where two want one cell the smaller
    shard has it and the other takes the next free one."""
    if shards * vnodes > CELLS:
        raise ValueError("more virtual nodes than cells")
    at: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            cell = int.from_bytes(hashlib.sha256(f"{shard}/{v}".encode()).digest()[:4], "big") % CELLS
            while cell in at:
                cell = (cell + 1) % CELLS
            at[cell] = shard
    cells = sorted(at)
    return cells, [at[c] for c in cells]


def place(counts: dict[int, int], shards: int, vnodes: int) -> list[tuple[int, int, int, int]]:
    """(cell, first rank, end rank, shard) for rows counted by cell; ``counts`` is bounded by CELLS.

    In rounds: every node takes what waits at it, in the order of cells and ranks, as far
    as its shard has room; what is left over then goes on to the next node of a shard with room.
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    cells, owner = ring(shards, vnodes)
    n = len(cells)
    waiting: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # by virtual node: (cell, lo, hi), clockwise
    for cell in sorted(counts):
        if counts[cell]:
            waiting[bisect.bisect_left(cells, cell) % n].append((cell, 0, counts[cell]))
    out = []
    while waiting:
        over = []
        for node in sorted(waiting):
            shard = owner[node]
            for cell, lo, hi in waiting[node]:
                taken = min(hi - lo, room[shard])
                if taken:
                    out.append((cell, lo, lo + taken, shard))
                    room[shard] -= taken
                if lo + taken < hi:
                    over.append((cell, lo + taken, hi, node))
        waiting = defaultdict(list)
        for cell, lo, hi, node in sorted(over):
            node = (node + 1) % n
            while not room[owner[node]]:
                node = (node + 1) % n
            waiting[node].append((cell, lo, hi))
    return sorted(out)


def cell_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(CELLS)).cast("int")


def _literal_table(df: DataFrame, name: str, rows: list, ddl: str) -> DataFrame:
    """``rows`` as a table held in the plan itself."""
    schema = T.ArrayType(T.StructType.fromDDL(ddl))
    names = schema.elementType.names
    data = json.dumps([dict(zip(names, r)) for r in rows])
    return df.sparkSession.range(1).select(F.explode(F.from_json(F.lit(data), schema)).alias(name)).select(f"{name}.*")


def shard_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 40, vnodes: int = 64) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard), one row per row of ``docs``.

    Size is the text's UTF-8 bytes plus 16, and a null text has none and checksum 0.
    Rows with a null id, and repeated rows, are placed like any other. An empty table
    gives an empty result. Slots count from 0 in each shard without gaps. Other columns aren't read.
    """
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    sized, _ = written(docs.select(
        F.col(id_col).alias("id"), (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 16).cast("long").alias("size"), crc.alias("text_crc32"),
        F.pmod(F.spark_partition_id(), F.lit(SPLITS)).alias("part"),
    ), "keys")
    cell = F.when(F.col("id").isNull(), cell_of(F.col("text_crc32"))).otherwise(cell_of(F.col("id")))
    sized = sized.withColumn("cell", cell).withColumn("sub", F.pmod(F.col("text_crc32"), F.lit(SUBS)).cast("int"))

    counted = sized.groupBy("cell", "sub").count().collect()  # CELLS * SUBS rows at most
    total = sum(r["count"] for r in counted)
    hot = [r["cell"] * SUBS + r["sub"] for r in counted if r["count"] * HOT > total]  # fewer than HOT
    split = F.when((F.col("cell") * SUBS + F.col("sub")).isin(hot), F.col("part")).otherwise(F.lit(0)) if hot else F.lit(0)
    sized = sized.withColumn("split", split)
    held = {(r["cell"], r["sub"], 0): r["count"] for r in counted if r["cell"] * SUBS + r["sub"] not in set(hot)}
    if hot:
        parts = sized.where((F.col("cell") * SUBS + F.col("sub")).isin(hot)).groupBy("cell", "sub", "split").count().collect()  # HOT * SPLITS rows at most
        held |= {(r["cell"], r["sub"], r["split"]): r["count"] for r in parts}
    whole: dict[int, int] = defaultdict(int)
    starts = []
    for (c, sub, part), n in sorted(held.items()):
        starts.append((c, sub, part, whole[c]))
        whole[c] += n
    base = [0] * shards
    ranges = []
    for cell, lo, hi, shard in place(whole, shards, vnodes):
        ranges.append((cell, lo, hi, shard, base[shard]))
        base[shard] += hi - lo

    start = _literal_table(docs, "s", starts, "cell int, sub int, split int, start long")
    where = _literal_table(docs, "w", ranges, "cell int, lo long, hi long, shard int, base long")
    order = Window.partitionBy("cell", "sub", "split").orderBy("id", "text_crc32", "size")
    ranked = sized.withColumn("nth", F.row_number().over(order) - 1)
    ranked = ranked.join(F.broadcast(start), ["cell", "sub", "split"]).withColumn("rank", F.col("start") + F.col("nth"))
    placed = ranked.join(F.broadcast(where), (ranked["cell"] == where["cell"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("base") + F.col("rank") - F.col("lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
