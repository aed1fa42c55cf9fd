"""Reviewed changes as batch jobs: each returns the next snapshot's rows."""
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions import scalars as S
from evigraph.operators.components import written

#: A symmetric relation's ends are stored sorted.
SYMMETRIC = ("same_as",)
#: Rows of merges, or of numbers of ids that meet, that are sent to every task.
MOST_SENT = 2_000_000


def merge_targets(merges: DataFrame) -> DataFrame:
    """(drop, keep) with chains resolved: A into B and B into C sends A to C.  merges: (keep, drop)."""
    from evigraph.operators.traverse import supersession_ends

    kept = merges.select(F.col("keep").alias("id")).subtract(merges.select(F.col("drop").alias("id"))).select("id", F.lit(None).cast("string").alias("superseded_by"), F.lit("active").alias("status"))
    rows = merges.select(F.col("drop").alias("id"), F.col("keep").alias("superseded_by"), F.lit("archived").alias("status")).unionByName(kept)
    return supersession_ends(rows).where("state = 'active' and steps > 0").select(F.col("id").alias("drop"), F.col("end").alias("keep"))


def apply_merges(nodes: DataFrame, edges: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after merges (keep, drop): dropped nodes are archived, their names go to the kept one's aliases, links move and old ones are archived.

    Moved links that meet an existing or another moved one become one; links between the
    merged become none.
    """
    to = merge_targets(merges)
    # A merge into an archived record is refused whole.
    to = written(to.join(nodes.where("status <> 'archived'").select(F.col("id").alias("keep")), "keep", "left_semi").select("drop", "keep"))
    names = to.join(nodes.select(F.col("id").alias("drop"), "name", "aliases"), "drop").groupBy(F.col("keep").alias("id")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_append("aliases", F.col("name")))))).alias("_more"))
    new_nodes = (
        nodes.join(names, "id", "left").join(to.select(F.col("drop").alias("id"), F.col("keep").alias("superseded_by")), "id", "left")
        .withColumn("aliases", F.when(F.col("_more").isNotNull(), F.array_except(F.array_union("aliases", "_more"), F.array("name"))).otherwise(F.col("aliases")))
        .withColumn("status", F.when(F.col("superseded_by").isNotNull(), "archived").otherwise(F.col("status"))).drop("_more")
    )
    a, b = (_sent(to.select(F.col("drop").alias(end), F.col("keep").alias(c))) for end, c in (("src", "_s"), ("dst", "_d")))
    e = edges.join(a, "src", "left").join(b, "dst", "left").select(*edges.columns, "_s", "_d")
    touched = F.col("_s").isNotNull() | F.col("_d").isNotNull()
    a, z = F.coalesce("_s", "src"), F.coalesce("_d", "dst")
    turned = F.col("rel").isin(*SYMMETRIC) & (a > z)
    src, dst = F.when(turned, z).otherwise(a), F.when(turned, a).otherwise(z)
    # One reading of the edges gives the old and the moved ones.
    like = lambda **new: F.struct(*[new.get(c, F.col(c)).alias(c) for c in edges.columns])
    old = like(status=F.when(touched, "archived").otherwise(F.col("status")))
    moved = F.when(touched & (F.col("status") != "archived") & (a != z), like(id=S.edge_id(src, "rel", dst, "key"), src=src, dst=dst))
    every = e.select(F.explode(F.array_compact(F.array(old, moved))).alias("e")).select("e.*")
    keep = [c for c in edges.columns if c != "id"]
    rank = F.struct(F.when(F.col("status") == "confirmed", 0).when(F.col("status") == "proposed", 1).otherwise(2).alias("s"), (-F.col("conf")).alias("c"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_{c}") for c in keep])
    # Only edges whose id others have too are dealt by it; numbers of the ids tell which.
    number = F.xxhash64("id").alias("_h")
    shared = _sent(written(every.select(number).groupBy("_h").agg(F.count("*").alias("n")).where("n > 1").select("_h")))
    told = every.withColumn("_h", number)
    one = told.join(shared, "_h", "left_semi").groupBy("id").agg(F.min_by(F.struct(*keep), rank).alias("e")).select("id", *[F.col(f"e.{c}").alias(c) for c in keep])
    return new_nodes, told.join(shared, "_h", "left_anti").select(edges.columns).unionByName(one.select(edges.columns))


def _sent(small: DataFrame) -> DataFrame:
    """A written table that is sent to every task up to ``MOST_SENT`` rows, else joined."""
    return F.broadcast(small) if small.limit(MOST_SENT + 1).count() <= MOST_SENT else small


def apply_archive(nodes: DataFrame, edges: DataFrame, archived: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after archiving ids (id, reason); a node takes its active edges along."""
    gone = archived.select("id", F.lit(True).alias("_gone")).distinct()
    new_nodes = nodes.join(gone, "id", "left").withColumn("status", F.when(F.col("_gone"), "archived").otherwise(F.col("status"))).drop("_gone")
    by = edges.join(gone.withColumnRenamed("_gone", "_e"), "id", "left").join(gone.select(F.col("id").alias("src"), F.col("_gone").alias("_s")), "src", "left").join(gone.select(F.col("id").alias("dst"), F.col("_gone").alias("_d")), "dst", "left")
    return new_nodes, by.withColumn("status", F.when(F.coalesce("_e", "_s", "_d", F.lit(False)), "archived").otherwise(F.col("status"))).select(*edges.columns)


def apply_updates(nodes: DataFrame, updates: DataFrame) -> DataFrame:
    """Nodes after updates (id, name, status, set map, unset array): a rename keeps the old name as an alias, a status only rises."""
    rank = lambda c: F.when(F.col(c) == "archived", 2).when(F.col(c) == "confirmed", 1).when(F.col(c) == "proposed", 0)
    u = updates.select("id", F.col("name").alias("_name"), F.col("status").alias("_status"), F.col("set").alias("_set"), F.col("unset").alias("_unset"))
    n = nodes.join(u, "id", "left")
    renamed = F.col("_name").isNotNull() & (F.col("_name") != F.col("name"))
    attrs = F.map_filter(F.coalesce("attrs", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, _: ~F.coalesce(F.array_contains("_unset", k), F.lit(False)) & ~F.coalesce(F.map_contains_key("_set", k), F.lit(False)))
    return n.withColumns({
        "aliases": F.when(renamed, F.array_except(F.array_union("aliases", F.array("name")), F.array("_name"))).otherwise(F.col("aliases")), "name": F.coalesce("_name", "name"),
        "status": F.when(rank("_status") > rank("status"), F.col("_status")).otherwise(F.col("status")), "attrs": F.when(F.col("_set").isNotNull() | F.col("_unset").isNotNull(), F.map_concat(attrs, F.coalesce("_set", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))).otherwise(F.col("attrs")),
    }).select(*nodes.columns)


def upsert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with new ones added under their hash: symmetric ends sorted, self links refused; of an existing edge only the confidence may rise."""
    turned = F.col("rel").isin(*SYMMETRIC) & (F.col("src") > F.col("dst"))
    rows = new.where("src <> dst").withColumns({"_s": F.when(turned, F.col("dst")).otherwise(F.col("src")), "_d": F.when(turned, F.col("src")).otherwise(F.col("dst"))}).drop("src", "dst").withColumnsRenamed({"_s": "src", "_d": "dst"}).withColumn("id", S.edge_id("src", "rel", "dst", "key"))
    rows = rows.groupBy("id").agg(F.min_by(F.struct(*[c for c in edges.columns if c != "id"]), F.struct((-F.col("conf")).alias("c"), "status")).alias("e")).select("id", "e.*").select(*edges.columns)
    both = edges.join(rows.select("id", F.col("conf").alias("_c")), "id", "left").withColumn("conf", F.greatest("conf", F.coalesce("_c", "conf"))).drop("_c")
    return both.select(*edges.columns).unionByName(rows.join(edges, "id", "left_anti"))


def erased(nodes: DataFrame, edges: DataFrame, prov: DataFrame, sources: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Everything after erasing nodes and sources (id): texts blank, quotes of erased sources gone everywhere, links of erased nodes archived."""
    gone = ids.select("id", F.lit(True).alias("_gone")).distinct()
    blank = lambda df, cols: df.join(gone, "id", "left").withColumns({c: F.when(F.col("_gone"), F.lit(None)).otherwise(F.col(c)) for c in cols}).withColumn("erased", F.coalesce("_gone", F.lit(False))).drop("_gone")
    quotes = prov.join(gone.select(F.col("id").alias("src"), F.col("_gone").alias("_s")), "src", "left").join(gone.select(F.col("id").alias("record_id"), F.col("_gone").alias("_r")), "record_id", "left")
    quotes = quotes.withColumn("quote", F.when(F.coalesce("_s", "_r", F.lit(False)), F.lit(None)).otherwise(F.col("quote"))).select(*prov.columns)
    _, links = apply_archive(nodes, edges, ids)
    return blank(nodes, ["name", "summary"]), links, quotes, blank(sources, ["text", "title", "url"])


def new_ids(names: DataFrame, taken: DataFrame) -> DataFrame:
    """(ref, id): ``kind:slug`` for new names (ref, kind, name), numbered -2, -3, ... beside each other and beside taken ids (id).

    A number is only given to ids that are still free, so an id stored with such an ending is passed over.
    """
    slugs = names.select("ref", F.concat("kind", F.lit(":"), S.slugify("name")).alias("stem"))
    used = taken.select(F.regexp_replace("id", r"-[0-9]+$", "").alias("stem"), F.coalesce(F.expr("try_cast(nullif(regexp_extract(id, '-([0-9]+)$', 1), '') as long)"), F.lit(1)).alias("n")).unionByName(taken.where(F.col("id").rlike(r"-[0-9]+$")).select(F.col("id").alias("stem"), F.lit(1).cast("long").alias("n")))
    places = slugs.withColumn("place", F.row_number().over(Window.partitionBy("stem").orderBy("ref")).cast("long"))
    used = used.join(slugs.select("stem").distinct(), "stem", "left_semi").distinct()
    wanted = places.groupBy("stem").agg(F.max("place").alias("most")).join(used.groupBy("stem").agg(F.count("*").alias("busy")), "stem", "left").select("stem", F.explode(F.sequence(F.lit(1), F.col("most") + F.coalesce("busy", F.lit(0)))).alias("n"))
    free = wanted.join(used, ["stem", "n"], "left_anti").withColumn("place", F.row_number().over(Window.partitionBy("stem").orderBy("n")).cast("long"))
    return places.join(free, ["stem", "place"]).select("ref", F.when(F.col("n") == 1, F.col("stem")).otherwise(F.concat("stem", F.lit("-"), "n")).alias("id"))


def op_problems(ops: DataFrame, nodes: DataFrame) -> DataFrame:
    """(prop_id, n, problem) of operations (prop_id, n, op, ref, target, reason): unknown or archived targets, open ``$`` handles, short reasons."""
    own = nodes.select(F.col("id").alias("target"), F.col("status").alias("_st"))
    handles = ops.where("ref is not null").select("prop_id", F.concat(F.lit("$"), "ref").alias("target"), F.lit(True).alias("_handle")).distinct()
    x = ops.join(own, "target", "left").join(handles, ["prop_id", "target"], "left")
    what = (
        F.when(F.col("target").startswith("$") & F.col("_handle").isNull(), "open_handle").when(F.col("target").isNotNull() & ~F.col("target").startswith("$") & F.col("_st").isNull(), "unknown_target")
        .when(F.col("_st") == "archived", "archived_target").when(F.col("op").isin("merge", "archive") & (F.length(F.coalesce("reason", F.lit(""))) < 20), "short_reason")
    )
    return x.select("prop_id", "n", what.alias("problem")).where("problem is not null")


def sound_proposals(ops: DataFrame, problems: DataFrame) -> DataFrame:
    """Operations of proposals without any problem: a proposal is applied whole or not at all."""
    return ops.join(problems.select("prop_id").distinct(), "prop_id", "left_anti")


def verdict_state(ops: DataFrame) -> DataFrame:
    """Operations with the status and trust that their verdict gives."""
    return ops.withColumn("status", F.when(F.col("verdict").isin("accept", "edit"), "confirmed").when(F.col("verdict") == "draft", "proposed")).withColumn("trust", F.when(F.col("verdict").isin("accept", "edit"), "reviewed").when(F.col("verdict") == "draft", "agent"))


def failed_expectations(expected: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, field) of expectations (id, field, want) that the records no longer meet."""
    have = nodes.select("id", F.explode(F.create_map(F.lit("name"), "name", F.lit("status"), "status", F.lit("summary"), "summary")).alias("field", "have"))
    return expected.join(have, ["id", "field"], "left").where(~F.col("want").eqNullSafe(F.col("have"))).select("id", "field")
