"""What several operators need: the shared folder, cut lineage, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A local session (a test) may go without: it gets a folder of its own. A cluster may
    not, as its machines see no folder of the driver's.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster must name the shared folder in spark.checkpoint.dir")
        import tempfile

        named = "file://" + tempfile.mkdtemp(prefix="thermolith-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def application_folder(spark: SparkSession) -> str:
    """All that this application writes there."""
    return f"{shared_folder(spark)}/thermolith/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{application_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clean(spark: SparkSession) -> None:
    """Removes everything that this application has written to the shared folder; results not
    yet read are lost with it."""
    drop_path(spark, application_folder(spark))


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder, reread: computed once, and
    not again if an executor is lost."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


class Scratch:
    """Tables that only the steps of one operator read: dropped together once its result is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        out, path = written(df, name)
        self.paths.append(path)
        return out

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written, and all the others dropped."""
        out, _ = written(df, name)
        for path in self.paths:
            drop_path(self.spark, path)
        self.paths.clear()
        return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """For a scan whose rows take long: one that comes in fewer parts than there are cores (a
    small file of one row group) is dealt over them; a larger one is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    while name in df.columns:
        name += "_"
    return name


#: A key that has over one in so many of the rows is a hub; there are fewer hubs than this.
HUBS = 1000


def joined_with_hubs(rows: DataFrame, one: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with ``one``, which has each key once and how many ``rows`` it has (``n``).

    Keys of over one in HUBS of the ``total`` rows, fewer than HUBS in number, are sent to the
    rows; only the other rows are shuffled, so no task gets a hub's.
    """
    hub = F.col("n") * HUBS > F.lit(total)
    hubs = F.broadcast(one.where(hub).limit(HUBS).drop("n"))  # fewer than HUBS by arithmetic; the limit states it to the planner
    names = [c for c in one.columns if c not in (key, "n")]
    return rows.join(hubs, key).unionByName(rows.join(hubs.select(key), key, "left_anti").join(one.where(~hub).drop("n"), key)).select(*rows.columns, *names)


def joined_salted(rows: DataFrame, one: DataFrame, key: str, by: str, hubs: DataFrame) -> DataFrame:
    """``rows`` joined with ``one`` (each key once, rows of any size) on ``key``; the rows of a hub
    are dealt over several tasks by ``by``, each of which gets its row of ``one``.

    ``hubs``: (key, copies) from :func:`hub_copies`, which is all that is sent to all tasks.
    """
    few = F.broadcast(hubs.select(F.col(key).alias("__hub"), "copies"))
    left = rows.join(few, rows[key] == F.col("__hub"), "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("copies")), F.lit(0).cast("long"))).drop("__hub", "copies")
    right = one.join(few, one[key] == F.col("__hub"), "left").withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("copies"), F.lit(1).cast("long")) - 1))).drop("__hub", "copies")
    return left.join(right, [key, "__salt"]).drop("__salt")


def hub_copies(rows: DataFrame, key: str, total: int) -> DataFrame:
    """(key, copies): keys of over one in HUBS of the ``total`` rows, fewer than HUBS, and in how many parts
    of about so many rows each is dealt."""
    counted = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") * HUBS > F.lit(total))
    return counted.select(key, F.ceil(F.col("n") * HUBS / F.lit(max(1, total))).cast("long").alias("copies")).limit(HUBS)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the
    smallest node reachable.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): every
    round is two grouped minima and two equi-joins, the edge set never grows, and
    the number of rounds is logarithmic in practice. Nodes with very many
    neighbours are joined without a shuffle (:func:`joined_with_hubs`); no
    neighbour list is ever collected. Each half of a round is written to the shared folder.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    spark = edges.sparkSession

    def state_of(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    current, path = written(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = state_of(current)
    for _ in range(max_rounds):
        # Large star: larger neighbours of u move to the smallest of u and its neighbours.
        sym = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")).where("n > 0").select("u", F.least("u", "m").alias("m"), "n")
        moved = joined_with_hubs(sym.where("v > u"), low, "u", state[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large, large_path = written(moved.where("u <> v").distinct(), "edges")
        # Small star: smaller neighbours of u, and u, move to the smallest of them. There are no more edges than before.
        low2 = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = (
            joined_with_hubs(large, low2, "u", state[0])
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .where("u <> v")
            .distinct()
        )
        nxt, nxt_path = written(small, "edges")
        after = state_of(nxt)
        drop_path(spark, path)
        drop_path(spark, large_path)
        current, path = nxt, nxt_path
        if after == state:
            break
        state = after
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
