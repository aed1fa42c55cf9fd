"""Data-quality rules over graph tables.  Each rule is a DataFrame of (code, record_id, message); ``validate`` unions them."""
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions import scalars as S
from evigraph.operators.components import written
from evigraph.schemas import Registry

NODE_ID = r"^[a-z][a-z0-9_]*:[^\s/]+$"


def problems(rows: DataFrame, code: str, record, message) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), record.alias("record_id"), message.alias("message"))


#: What edges tell of their ends' records: kind (null without one), and how many are active and archived.
TOLD = frozenset(f"{end}_{what}" for end in ("src", "dst") for what in ("kind", "live", "gone"))


def tells_ends(edges: DataFrame) -> bool:
    """Whether the edges tell the records of their ends, so that they need not meet the nodes."""
    return TOLD <= set(edges.columns)


def dangling_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, end, missing) of active edges whose end has no record."""
    both = [F.struct(F.lit(end).alias("end"), F.col(end).alias("missing")) for end in ("src", "dst")]
    if tells_ends(edges):
        bare = F.array_compact(F.array(*[F.when(F.col(f"{end}_kind").isNull(), x) for end, x in zip(("src", "dst"), both)]))
        return edges.where("status <> 'archived'").select("id", F.explode(bare).alias("e")).select("id", "e.*")
    ends = edges.where("status <> 'archived'").select("id", F.explode(F.array(*both)).alias("e")).select("id", "e.*")
    return ends.join(nodes.select(F.col("id").alias("missing")), "missing", "left_anti").select("id", "end", "missing")


def signature_violations(nodes: DataFrame, edges: DataFrame, registry: Registry) -> DataFrame:
    """(id, rel, src_kind, dst_kind) of active edges whose relation may not link these kinds; ends without a record are no violation."""
    kinds = nodes.select("id", "kind")
    e = edges.where("status <> 'archived'")
    if tells_ends(edges):
        e = e.where("src_kind is not null and dst_kind is not null")
    else:
        e = e.select("id", "rel", "src", "dst").join(kinds.select(F.col("id").alias("src"), F.col("kind").alias("src_kind")), "src").join(kinds.select(F.col("id").alias("dst"), F.col("kind").alias("dst_kind")), "dst")
    sig = registry.signatures
    star = F.broadcast(sig.where("src_kind = '*' and dst_kind = '*'").select("rel").distinct())
    half = F.broadcast(sig.where("src_kind = '*' and dst_kind <> '*'").select("rel", "dst_kind").distinct())
    other = F.broadcast(sig.where("dst_kind = '*' and src_kind <> '*'").select("rel", "src_kind").distinct())
    bad = e.join(F.broadcast(sig), ["rel", "src_kind", "dst_kind"], "left_anti").join(star, "rel", "left_anti").join(half, ["rel", "dst_kind"], "left_anti").join(other, ["rel", "src_kind"], "left_anti")
    if tells_ends(edges):
        bad = bad.withColumn("_each", F.explode(F.array_repeat(F.lit(0), _record_pairs())))
    return bad.select("id", "rel", "src_kind", "dst_kind")


def _record_pairs() -> Column:
    """How many pairs of records the ends of an edge have, one each but where ids are used again."""
    return ((F.col("src_live") + F.col("src_gone")) * (F.col("dst_live") + F.col("dst_gone"))).cast("int")


def archived_touch(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, archived_end) of active edges at archived nodes."""
    if tells_ends(edges):
        ends = F.array_distinct(F.array_compact(F.array(*[F.when(F.col(f"{end}_gone") > 0, F.col(end)) for end in ("src", "dst")])))
        return edges.where("status <> 'archived'").select("id", F.explode(ends).alias("archived_end"))
    gone = nodes.where("status = 'archived'").select(F.col("id").alias("archived_end"))
    ends = edges.where("status <> 'archived'").select("id", F.explode(F.array_distinct(F.array("src", "dst"))).alias("archived_end"))
    return ends.join(gone, "archived_end", "left_semi").select("id", "archived_end")


def edge_id_mismatch(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("id") != S.edge_id("src", "rel", "dst", "key")).select("id")


def provenance_problems(prov: DataFrame, sources: DataFrame) -> DataFrame:
    """(record_id, ord, problem): ``unknown_source``, or ``span`` where the lines lie outside of the source.  sources: (id, n_lines)."""
    first, last = S.line_span("loc")
    joined = prov.join(sources.select(F.col("id").alias("src"), "n_lines").dropDuplicates(["src"]), "src", "left").withColumns({"_a": first, "_b": last})
    what = F.when(F.col("n_lines").isNull(), "unknown_source").when(F.col("_a").isNotNull() & ((F.col("_a") < 1) | (F.col("_b") < F.col("_a")) | (F.col("_b") > F.col("n_lines"))), "span")
    return joined.withColumn("problem", what).where("problem is not null").select("record_id", "ord", "problem")


def quote_check(prov: DataFrame, texts: DataFrame) -> DataFrame:
    """(record_id, ord, found): whether the normalised quote stands in the cited lines, or in the whole text for another location.

    Both sides are shuffled by source once, so each text travels once; a source that many
    records cite is a skewed key that adaptive execution splits.
    """
    first, last = S.line_span("loc")
    joined = prov.where("quote is not null").join(texts.select(F.col("id").alias("src"), "text").dropDuplicates(["src"]), "src").withColumns({"_a": first, "_b": last})
    lines = F.split("text", "\n")
    cited = F.when(F.col("_a").isNotNull() & (F.col("_a") >= 1) & (F.col("_b") >= F.col("_a")), F.array_join(F.slice(lines, F.col("_a"), F.least(F.col("_b"), F.size(lines)) - F.col("_a") + 1), "\n")).otherwise(F.col("text"))
    return joined.select("record_id", "ord", F.contains(S.normalize_ws(cited), S.normalize_ws(F.col("quote"))).alias("found"))


def alias_collisions(nodes: DataFrame) -> DataFrame:
    """(alias, a, b): a folded alias that two active nodes hold (a < b), told by each holder after the first; or that is another node's id.

    The first holder of an alias comes from an aggregate, so an alias that many share gives one row for each of them, not all pairs.
    """
    held = nodes.where("status <> 'archived'").select("id", F.explode("aliases").alias("a")).select("id", F.lower(F.trim("a")).alias("alias")).distinct()
    first = held.groupBy("alias").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1")
    twice = held.join(first, "alias").where("id <> a").select("alias", "a", F.col("id").alias("b"))
    taken = held.join(nodes.where("status <> 'archived'").select(F.lower("id").alias("alias"), F.col("id").alias("a")), "alias").where("a <> id").select("alias", "a", F.col("id").alias("b"))
    return twice.unionByName(taken)


def duplicate_lines(rows: DataFrame, key: str = "id") -> DataFrame:
    """(id, kind, n): ``repeated`` where an id's rows are all equal, ``reused`` where they differ."""
    hashed = rows.select(F.col(key).alias("id"), F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256).alias("h"))
    return hashed.groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("h").alias("kinds")).where("n > 1").select("id", F.when(F.col("kinds") == 1, "repeated").otherwise("reused").alias("kind"), "n")


def field_errors(nodes: DataFrame, constraints: DataFrame) -> DataFrame:
    """(id, field, keyword): attribute values that break a constraint.  constraints: (kind, field, keyword, value), broadcast.

    Keywords: enum (values joined by '|'), pattern, maxLength, minimum, maximum; values are JSON text.
    """
    values = nodes.select("id", "kind", F.explode("attrs").alias("field", "json"))
    plain = F.regexp_replace("json", '^"|"$', "")
    number = F.expr("try_cast(json as double)")
    joined = values.join(F.broadcast(constraints), ["kind", "field"]).withColumn("_v", plain)
    broken = (
        F.when(F.col("keyword") == "enum", ~F.array_contains(F.split("value", r"\|"), F.col("_v"))).when(F.col("keyword") == "pattern", ~F.regexp_like("_v", F.col("value")))
        .when(F.col("keyword") == "maxLength", F.length("_v") > F.expr("try_cast(value as int)")).when(F.col("keyword") == "minimum", ~F.coalesce(number >= F.expr("try_cast(value as double)"), F.lit(False)))
        .when(F.col("keyword") == "maximum", ~F.coalesce(number <= F.expr("try_cast(value as double)"), F.lit(False)))
    )
    return joined.where(broken).select("id", "field", "keyword")


def edge_problems(edges: DataFrame, registry: Registry) -> DataFrame:
    """(code, record_id, message): P07, P09, P10 and P13 of edges that tell their ends, in one reading of them."""
    kinds = registry.signatures.groupBy("rel").agg(F.collect_set(F.struct("src_kind", "dst_kind")).alias("_may"))
    rels = registry.relations.select("rel", "symmetric", F.lit(True).alias("_known")).join(kinds, "rel", "full_outer")
    e = edges.join(F.broadcast(rels), "rel", "left")
    fits = lambda may, kind: (may == "*") | (may == kind)
    allowed = F.coalesce(F.exists("_may", lambda m: fits(m["src_kind"], F.col("src_kind")) & fits(m["dst_kind"], F.col("dst_kind"))), F.lit(False))
    live = F.col("status") != "archived"
    told = lambda code, message: F.struct(F.lit(code).alias("code"), message.alias("message"))
    one = lambda when, code, message: F.when(when, F.array(told(code, message)))
    kinds_wrong = F.when(live & F.col("src_kind").isNotNull() & F.col("dst_kind").isNotNull() & ~allowed, F.array_repeat(told("P09", F.lit("kinds not allowed")), _record_pairs()))
    missing = [one(live & F.col(f"{end}_kind").isNull(), "P10", F.concat(F.lit("missing "), end)) for end in ("src", "dst")]
    again = lambda end: (F.lit(True) if end == "src" else ~F.coalesce((F.col("src_gone") > 0) & (F.col("src") == F.col("dst")), F.lit(False)))
    gone = [one(live & (F.col(f"{end}_gone") > 0) & again(end), "P13", F.concat(F.lit("archived "), end)) for end in ("src", "dst")]
    found = [
        one(F.col("id") != S.edge_id("src", "rel", "dst", "key"), "P07", F.lit("edge id differs from its hash")), one(F.col("_known").isNull(), "P09", F.lit("unknown relation")),
        kinds_wrong, one(F.col("symmetric") & (F.col("src") > F.col("dst")), "P09", F.lit("symmetric ends not sorted")), *missing, *gone,
    ]
    return e.select(F.col("id").alias("record_id"), F.explode(F.flatten(F.array_compact(F.array(*found)))).alias("_p")).select("_p.code", "record_id", "_p.message")


def validate(nodes: DataFrame, edges: DataFrame, prov: DataFrame, sources: DataFrame, registry: Registry, touched: DataFrame | None = None) -> DataFrame:
    """All problems of a graph: code, record_id, message.

    touched (id): then the rules of single records run for these ids alone; rules across records run for all.
    Edges that tell their ends are read once for all their rules.
    """
    own_nodes = nodes if touched is None else nodes.join(touched, "id", "left_semi")
    own_edges = edges if touched is None else edges.join(touched, "id", "left_semi")
    if touched is None and tells_ends(edges):
        of_edges = [edge_problems(edges, registry)]
    else:
        of_edges = [
            problems(edge_id_mismatch(own_edges), "P07", F.col("id"), F.lit("edge id differs from its hash")),
            problems(own_edges.join(F.broadcast(registry.relations.select("rel")), "rel", "left_anti"), "P09", F.col("id"), F.lit("unknown relation")),
            problems(signature_violations(nodes, own_edges, registry), "P09", F.col("id"), F.lit("kinds not allowed")),
            problems(own_edges.join(F.broadcast(registry.relations.where("symmetric").select("rel")), "rel", "left_semi").where("src > dst"), "P09", F.col("id"), F.lit("symmetric ends not sorted")),
            problems(dangling_endpoints(nodes, edges), "P10", F.col("id"), F.concat(F.lit("missing "), "missing")),
            problems(archived_touch(nodes, edges), "P13", F.col("id"), F.concat(F.lit("archived "), "archived_end")),
        ]
    rules = [
        *of_edges,
        problems(own_nodes.where(~F.col("id").rlike(NODE_ID)), "P07", F.col("id"), F.lit("id grammar")),
        problems(own_nodes.where(F.split_part("id", F.lit(":"), F.lit(1)) != F.col("kind")), "P07", F.col("id"), F.lit("id of another kind")),
        problems(own_nodes.join(F.broadcast(registry.kinds.select("kind")), "kind", "left_anti"), "P08", F.col("id"), F.lit("unknown kind")),
        problems(provenance_problems(prov, sources), "P11", F.col("record_id"), F.col("problem")),
        problems(duplicate_lines(nodes.select("id", "kind", "name", "status")), "P06", F.col("id"), F.col("kind")),
        problems(alias_collisions(nodes), "P06", F.col("b"), F.concat(F.lit("alias of "), "a")),
        problems(own_nodes.where("id like '%/%'"), "P16", F.col("id"), F.lit("qualified id in local nodes")),
    ]
    return reduce(lambda a, b: a.unionByName(b), rules)


def fresh_problems(after: DataFrame, before: DataFrame) -> DataFrame:
    """Problems that a change would add."""
    return after.exceptAll(before)


def problems_of_change(nodes: DataFrame, edges: DataFrame, more: DataFrame, links: DataFrame, registry: Registry) -> DataFrame:
    """``fresh_problems`` of a graph that gains the rows ``more`` (nodes) and ``links`` (edges), provenance staying as it is.

    Only what the new rows can touch is checked, before and after: edges at their ids or of their ids, records with those ids, at
    the ends of these edges, or under an alias that meets one of theirs.  All else has the same problems with and without them.
    """
    fold = F.array_append(F.transform("aliases", lambda a: F.lower(F.trim(a))), F.lower("id"))
    ids, keys = written(more.select("id").distinct()), written(more.select(F.explode(fold).alias("_key")).distinct())
    marks = {"src": ids, "dst": ids, "id": written(links.select("id").distinct())}
    near = edges
    for c, these in marks.items():
        near = near.join(these.select(F.col("id").alias(c), F.lit(True).alias(f"_{c}")), c, "left")
    near = written(near.where("_src or _dst or _id").select(edges.columns))
    ends = near.unionByName(links.select(edges.columns)).select(F.explode(F.array("src", "dst")).alias("id"))
    named = nodes.select("id", F.explode(fold).alias("_key")).join(keys, "_key", "left_semi").select("id")
    touched = written(ends.unionByName(ids).unionByName(named).distinct())
    kept = written(nodes.join(touched, "id", "left_semi").select(more.columns))
    none = nodes.sparkSession.createDataFrame([], "record_id string, ord int, src string, loc string, quote string")
    check = lambda n, e: validate(n, e, none, none.select(F.col("src").alias("id"), F.col("ord").alias("n_lines")), registry)
    return fresh_problems(check(kept.unionByName(more), near.unionByName(links.select(edges.columns))), check(kept, near))
