"""Connected components by alternating star contraction, with joins instead of collected neighbourhoods.

Each round replaces every edge by edges to the smallest neighbour.  The minima are
aggregates (combined before the shuffle) and come back by an equi-join, so a hub
with a third of all vertices is a skewed join key, which adaptive execution
splits, and never a collected list.  Rounds are cut by tables written to the
folder that executors share.
"""
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where it is unset, the warehouse on a cluster; a new temporary folder where driver and executors are one process.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place and not spark.sparkContext.master.startswith("local-cluster") and spark.sparkContext.master.startswith("local"):
        place = _own_dir()
    return (place or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


@functools.cache
def _own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='spark-')}"


def written(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: the lineage ends here and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/evigraph/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _large_star(edges: DataFrame) -> DataFrame:
    """edges: (u, v) with u > v.  Every larger neighbour of a vertex is linked to the vertex's smallest neighbour or itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a vertex, and the vertex, is linked to the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("low"))
    moved = edges.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(low.select("u", F.col("low").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """(id, component): the component is the smallest id reachable; ids without an edge (or with a null end) are not listed.

    A self loop lists its id as a component of its own; repeated and reversed edges count once.
    """
    known = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    loops = known.where(F.col(src) == F.col(dst)).select(F.col(src).alias("id")).distinct()
    now = written(known.where(F.col(src) != F.col(dst)).select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct())
    digest = None
    for round_ in range(max_rounds + 1):
        if round_ == max_rounds:
            raise RuntimeError(f"components still change after {max_rounds} rounds")
        now = written(_small_star(_large_star(now)))
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (row["n"], row["h"]) == digest:
            break
        digest = (row["n"], row["h"])
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    centres = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    linked = stars.unionByName(centres)
    return linked.unionByName(loops.join(linked, "id", "left_anti").select("id", F.col("id").alias("component")))
