"""Gaps of every node, their ranking, dimension coverage and the richness of a graph."""
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions import scalars as S
from evigraph.operators.components import written
from evigraph.schemas import Registry

SEVERITY = {
    "contradiction": 8, "conflict": 8, "unconfirmed_hub": 7, "archived_premise": 7, "missing_field": 6, "missing_relation": 6, "orphan": 5, "thin": 5, "dangling_bridge": 5,
    "no_provenance": 5, "single_source": 4, "low_confidence": 4, "draft": 3, "draft_link": 3, "stale_source": 3, "open_question": 3,
}
WEIGHTS = {"coverage": 30, "completeness": 20, "connectivity": 15, "evidence": 20, "confirmation": 15}


def gap(rows: DataFrame, name: str, detail: Column | None = None) -> DataFrame:
    return rows.select("id", F.lit(name).alias("gap"), F.lit(SEVERITY[name]).alias("severity"), (F.lit("") if detail is None else detail).alias("detail"))


def link_counts(expanded: DataFrame, registry: Registry) -> DataFrame:
    """(id, degree, links, by): links that are not background, those among them that are not same_as, and how many are of each relation and direction that any kind is expected to have."""
    # A few registry rows name what is counted, so a record's counts are one row of numbers from the start.
    asked = sorted({(r["rel"], r["direction"]) for r in registry.expected_relations.select("rel", "direction").collect()})
    n = [F.count_if((F.col("rel") == rel) & (F.col("direction") == direction) & (F.col("rel") != "same_as")).alias(f"_n{k}") for k, (rel, direction) in enumerate(asked)]
    counted = expanded.where("not background").groupBy("id").agg(F.count("*").alias("degree"), F.count_if(F.col("rel") != "same_as").alias("links"), *n)
    by = F.array(*[F.col(f"_n{k}") for k in range(len(asked))]) if asked else F.array().cast("array<bigint>")
    return counted.select("id", "degree", "links", by.alias("by"))


def node_gaps(nodes: DataFrame, expanded: DataFrame, classes: DataFrame, prov: DataFrame, registry: Registry, counts: DataFrame | None = None, more: bool = False) -> DataFrame:
    """(id, gap, severity, detail) of all active nodes; with ``more`` also their kind and degree.

    Links are counted once (counts: see ``link_counts``, written by who reads it again); every node becomes one wide row with its counts, those
    of its class and what its kind expects, and one ``explode`` gives its gaps.  Only what is in a class meets its class; all else keeps its own counts.
    """
    own = link_counts(expanded, registry) if counts is None else counts
    asked = sorted({(r["rel"], r["direction"]) for r in registry.expected_relations.select("rel", "direction").collect()})
    heads = classes.select(F.col("class_id").alias("id"), "class_id").distinct().join(classes.select("id"), "id", "left_anti")
    members = classes.select("id", "class_id").unionByName(heads)
    sums = [F.coalesce(F.sum(F.col("by")[k]), F.lit(0)).alias(f"_n{k}") for k in range(len(asked))]
    shared = members.join(own, "id").groupBy("class_id").agg(F.sum("links").alias("_links"), *sums)
    shared = members.join(shared, "class_id").select("id", "_links", (F.array(*[F.col(f"_n{k}") for k in range(len(asked))]) if asked else F.array().cast("array<bigint>")).alias("_by"))
    cited = prov.groupBy(F.col("record_id").alias("id")).agg(F.count_distinct("src").alias("n_src"))
    place = F.array_position(F.array(*[F.lit(f"{rel} {direction}") for rel, direction in asked]) if asked else F.array().cast("array<string>"), F.concat_ws(" ", "rel", "direction")).cast("int")
    asks = registry.expected_relations.groupBy("kind").agg(F.collect_list(F.struct(F.concat_ws(" ", "rel", "direction").alias("k"), place.alias("at"), "least")).alias("asks"))
    wants = registry.expected_fields.groupBy("kind").agg(F.collect_list("field").alias("wants"))
    kinds = F.broadcast(registry.kinds.select("kind", "hub").join(asks, "kind", "full_outer").join(wants, "kind", "full_outer"))
    active = nodes.where("status <> 'archived'").select("id", "kind", "status", "summary", "conf", "attrs")
    rows = active.join(own, "id", "left").join(cited, "id", "left").join(shared, "id", "left").join(kinds, "kind", "left").withColumns({"links": F.coalesce("_links", "links"), "by": F.coalesce("_by", "by")})
    zero = lambda c: F.coalesce(c, F.lit(0))
    one = lambda name, when: F.when(when, F.array(F.struct(F.lit(name).alias("gap"), F.lit("").alias("detail"))))
    of = lambda name, details: F.transform(details, lambda d: F.struct(F.lit(name).alias("gap"), d.alias("detail")))
    bare = lambda f: F.regexp_replace(F.try_element_at("attrs", f), '^"|"$', "")
    draft, n_src = F.col("status") == "proposed", zero("n_src")
    filled = F.size(F.map_filter("attrs", lambda _, v: S.filled(v)))
    found = [
        one("unconfirmed_hub", draft & (zero("degree") >= 3)), of("missing_field", F.filter("wants", lambda f: ~S.filled(bare(f)))),
        of("missing_relation", F.transform(F.filter("asks", lambda a: zero(F.try_element_at("by", a["at"])) < a["least"]), lambda a: a["k"])),
        one("orphan", (zero("links") == 0) & ~F.coalesce("hub", F.lit(False))), one("thin", ~S.is_summary(F.col("summary")) & (F.coalesce(filled, F.lit(0)) <= 0)),
        one("no_provenance", draft & (n_src == 0)), one("single_source", n_src == 1), one("low_confidence", F.col("conf") < 0.5), one("draft", draft),
    ]
    weights = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    gaps = rows.select("id", "kind", zero("degree").alias("degree"), F.explode(F.flatten(F.array_compact(F.array(*found)))).alias("g"))
    return gaps.select("id", "g.gap", F.try_element_at(weights, F.col("g.gap")).alias("severity"), "g.detail", *(["kind", "degree"] if more else []))


def gaps_of(ids: DataFrame, nodes: DataFrame, expanded: DataFrame, classes: DataFrame, prov: DataFrame, registry: Registry) -> DataFrame:
    """``node_gaps`` of the records ``ids`` (id) alone, each once: only their links, and those of their classes' members, are counted."""
    asked = written(ids.where("id is not null").distinct())
    heads = classes.select(F.col("class_id").alias("id"), "class_id")
    held = classes.select("id", "class_id").unionByName(heads).join(asked, "id", "left_semi").select("class_id").distinct()
    kin = written(classes.join(held, "class_id", "left_semi").select("id", "class_id"))
    near = written(asked.unionByName(kin.select(F.explode(F.array("id", "class_id")).alias("id"))).distinct())
    counts = written(link_counts(expanded.join(near, "id", "left_semi"), registry))
    cited = prov.join(asked.withColumnRenamed("id", "record_id"), "record_id", "left_semi")
    return node_gaps(nodes.join(asked, "id", "left_semi"), expanded, kin, cited, registry, counts)


#: Gaps that an answer to their question settles; the others keep their own rules.
ANSWER_SETTLES = ("missing_field", "missing_relation", "orphan", "thin", "low_confidence", "unconfirmed_hub", "archived_premise")


def open_gaps(gaps: DataFrame, fold: DataFrame) -> DataFrame:
    """Gaps whose question ``q.gap.<gap>`` was not answered (nor ``na``) for the record.  fold: see ``logs.answer_fold``."""
    closed = fold.where(F.col("status").isin("answered", "na")).select(F.col("node").alias("id"), F.expr("substring(q, 7)").alias("gap")).where(F.col("gap").isin(*ANSWER_SETTLES)).distinct()
    return gaps.join(closed, ["id", "gap"], "left_anti").select(gaps.columns)


def ranked(gaps: DataFrame, degrees: DataFrame | None, limit: int | None = None) -> DataFrame:
    """Gaps with their place: severity, then degree, both falling, then gap, node and detail.  degrees: none where the gaps tell it."""
    keyed = gaps if degrees is None else gaps.join(degrees, "id", "left").na.fill(0, ["degree"])
    order = [F.desc("severity"), F.desc("degree"), "gap", "id", "detail"]
    if limit is not None:
        # A report of a few rows: kept by each task before they meet, then numbered.
        keyed = keyed.orderBy(*order).limit(limit)
    return keyed.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


def class_conflicts(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """(class_id, field, n_values, values): attributes on whose filled values the members of a class disagree."""
    values = nodes.where("status <> 'archived'").select("id", F.explode("attrs").alias("field", "value")).where(S.filled(F.col("value")))
    return values.join(classes, "id").groupBy("class_id", "field").agg(F.sort_array(F.collect_set("value")).alias("values")).where(F.size("values") > 1).select("class_id", "field", F.size("values").alias("n_values"), F.array_join("values", "|").alias("values"))


def unsettled(conflicts: DataFrame, classes: DataFrame, decisions: DataFrame) -> DataFrame:
    """Conflicts without an active decision scoped ``<member>#attrs.<field>``."""
    scoped = decisions.where("status = 'active'").select(F.explode("scope").alias("s")).where("s like '%#attrs.%'").select(F.split_part("s", F.lit("#attrs."), F.lit(1)).alias("id"), F.split_part("s", F.lit("#attrs."), F.lit(2)).alias("field"))
    settled = scoped.join(classes, "id").select("class_id", "field").distinct()
    return conflicts.join(settled, ["class_id", "field"], "left_anti")


def dimension_coverage(nodes: DataFrame, registry: Registry, closed: list[str] = ()) -> DataFrame:
    """(dimension, n, target, coverage): substantive active nodes against the target, 1 at most; closed dimensions are left out."""
    kinds = F.broadcast(registry.kinds.select("kind", "dimension"))
    counts = nodes.where("status <> 'archived'").join(kinds, "kind").groupBy("dimension").agg(F.count_if("substantive").alias("n"))
    open_ = registry.dimensions.where(~F.col("dimension").isin(list(closed))) if closed else registry.dimensions
    return F.broadcast(open_).join(counts, "dimension", "left").select("dimension", F.coalesce("n", F.lit(0)).alias("n"), "target", F.least(F.lit(1.0), F.coalesce("n", F.lit(0)) / F.col("target")).alias("coverage"))


def richness(nodes: DataFrame, edges: DataFrame, gaps: DataFrame, prov: DataFrame, coverage: DataFrame, registry: Registry) -> DataFrame:
    """One row: the six parts rounded to four places, the score (0 to 100) and its band.  A part without data is 1 where nothing is asked, else null.

    Depth is 1 - 2^(-evidence / targets) over the sums of both; it scales every part but coverage, as coverage does, unless nothing has a target.
    """
    active = nodes.where("status <> 'archived'")
    live = edges.where("status <> 'archived' and not background")
    asked_fields = active.join(F.broadcast(registry.expected_fields), "kind").agg(F.count("*").alias("fields"))
    asked_rels = active.join(F.broadcast(registry.expected_relations), "kind").agg(F.count("*").alias("rels"))
    missing = gaps.agg(F.count_if(F.col("gap") == "missing_field").alias("no_field"), F.count_if(F.col("gap") == "missing_relation").alias("no_rel"), F.count_if(F.col("gap") == "orphan").alias("orphans"))
    cited = prov.groupBy("record_id").agg(F.least(F.lit(2), F.count_distinct("src")).alias("n"))
    ids = active.select(F.col("id").alias("record_id")).unionByName(live.select(F.col("id").alias("record_id")))
    worth = F.coalesce("n", F.lit(0)) / 2
    evidence = ids.join(cited, "record_id", "left").agg(F.avg(worth).alias("evidence"), F.sum(worth).alias("mass"))
    states = active.agg(F.count("*").alias("nodes"), F.count_if(F.col("status") == "confirmed").alias("yes"), F.count_if(F.col("status") == "proposed").alias("no"))
    one = coverage.agg(F.avg("coverage").alias("coverage"), F.sum("target").alias("targets"))
    for part in (asked_fields, asked_rels, missing, evidence, states):
        one = one.join(F.broadcast(part))  # single rows
    share = lambda lost, of: F.when(F.col(of) == 0, 1.0).otherwise(1 - F.col(lost) / F.col(of))
    parts = one.select(
        F.round("coverage", 4).alias("coverage"), F.round(share("no_field", "fields"), 4).alias("completeness"), F.round(share("no_rel", "rels") * share("orphans", "nodes"), 4).alias("connectivity"),
        F.round("evidence", 4).alias("evidence"), F.round(F.when(F.col("yes") + F.col("no") == 0, 1.0).otherwise(F.col("yes") / (F.col("yes") + F.col("no"))), 4).alias("confirmation"),
        F.when(F.col("targets") > 0, F.round(1 - F.pow(F.lit(2.0), -F.coalesce("mass", F.lit(0.0)) / F.col("targets")), 4)).alias("depth"),
    )
    scaled = [F.col(p) * w * (F.lit(1.0) if p == "coverage" else F.col("coverage") * F.coalesce("depth", F.lit(1.0))) for p, w in WEIGHTS.items()]
    weight = [F.when(F.col(p).isNotNull(), w).otherwise(0) for p, w in WEIGHTS.items()]
    total, of = reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) for x in scaled]), reduce(lambda a, b: a + b, weight)
    score = S.half_up(F.round(100 * total / F.nullif(of, F.lit(0)), 6)).cast("long")
    return parts.withColumn("score", score).withColumn("band", F.when(F.col("score") < 20, "seed").when(F.col("score") < 40, "sketch").when(F.col("score") < 60, "working").when(F.col("score") < 80, "rich").otherwise("deep"))


def calibration(reviews: DataFrame) -> DataFrame:
    """(kind or null for all, n, brier, mean_conf, mean_outcome, accepted): how well forecasts met verdicts; drafts are no outcome."""
    judged = reviews.where("conf is not null and verdict in ('accept', 'edit', 'reject')").withColumn("outcome", F.when(F.col("verdict") == "reject", 0.0).otherwise(1.0))
    return judged.rollup("kind").agg(F.count("*").alias("n"), F.round(F.avg(F.pow(F.col("conf") - F.col("outcome"), 2)), 6).alias("brier"), F.round(F.avg("conf"), 6).alias("mean_conf"), F.round(F.avg("outcome"), 6).alias("mean_outcome"), F.count_if(F.col("outcome") == 1).alias("accepted"))
