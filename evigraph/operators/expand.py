"""Directed expansion of edges, degrees and relation groups.  Everything about links stands on ``expand``."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.schemas import Registry


def expand(nodes: DataFrame, edges: DataFrame, registry: Registry, include_archived: bool = False) -> DataFrame:
    """(id, other, label, direction, edge_id, rel, background, conf, status): each edge read from both ends.

    Out under its relation, in under the inverse; a symmetric relation keeps its label and a
    self loop counts once.  Archived edges and edges to archived nodes are dropped; an end
    without a record counts as alive.  Edges that tell ``src_archived`` and ``dst_archived``
    themselves need not meet the nodes.
    """
    e = edges if include_archived else edges.where("status <> 'archived'")
    e = e.join(F.broadcast(registry.relations), "rel", "left").withColumn("inverse", F.coalesce("inverse", F.concat(F.lit("inverse of "), "rel")))
    tail = ["edge_id", "rel", "background", "conf", "status"]
    e = e.withColumnRenamed("id", "edge_id")
    symmetric = F.coalesce("symmetric", F.lit(False))
    end = lambda a, b, label, direction: F.struct(F.col(a).alias("id"), F.col(b).alias("other"), label.alias("label"), F.lit(direction).alias("direction"))
    told = {"src_archived", "dst_archived"} <= set(edges.columns) and not include_archived
    alive = lambda c: ~F.coalesce(F.col(c), F.lit(False)) if told else F.lit(True)
    out, into = end("src", "dst", F.col("rel"), "out"), end("dst", "src", F.when(symmetric, F.col("rel")).otherwise(F.col("inverse")), "in")
    # One scan of the edges gives both readings.
    loop = F.coalesce((F.col("src") == F.col("dst")) & symmetric, F.lit(False))
    ends = F.array_compact(F.array(F.when(alive("dst_archived"), out), F.when(alive("src_archived") & ~loop, into)))
    both = e.select(F.explode(ends).alias("_e"), *tail).select("_e.*", *tail)
    if include_archived or told:
        return both
    gone = nodes.where("status = 'archived'").select(F.col("id").alias("other"))
    return both.join(gone, "other", "left_anti")


def degree(expanded: DataFrame) -> DataFrame:
    """(id, degree): links that are not background."""
    return expanded.where("not background").groupBy("id").agg(F.count("*").alias("degree"))


def relation_groups(expanded: DataFrame) -> DataFrame:
    """(id, label, other, repeats, conf): one row for each neighbour under each label."""
    return expanded.where("not background").groupBy("id", "label", "other").agg(F.count("*").alias("repeats"), F.max("conf").alias("conf"))


def substantive(nodes: DataFrame, degrees: DataFrame, cited: DataFrame) -> DataFrame:
    """Nodes with ``substantive``: a summary, provenance and a link."""
    from evigraph.functions.scalars import is_summary

    told = nodes.withColumn("_told", is_summary(F.col("summary")))
    return told.join(degrees, "id", "left").join(cited.select(F.col("record_id").alias("id"), F.lit(True).alias("_cited")).distinct(), "id", "left").withColumn("substantive", F.col("_told") & F.col("_cited").isNotNull() & (F.coalesce("degree", F.lit(0)) >= 1)).drop("_cited", "_told")
