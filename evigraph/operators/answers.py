"""Reads for people: filters, record views, pages, progress, next questions and what awaits review."""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions import scalars as S
from evigraph.schemas import Registry

#: A question of a gap is asked with this priority; what a gap, an open dimension and a repeated skip weigh.
PRIORITY, PER_SEVERITY, PER_DIMENSION = 30, 20, 100


def split_namespace(ids: DataFrame, own: str = "self") -> DataFrame:
    """Adds ns and local: what stands before and after the first slash; the own namespace's prefix is dropped, an id without one is local."""
    cut = F.instr("id", "/")
    ns = F.when(cut > 0, F.substring_index("id", "/", 1)).otherwise(F.lit(own))
    return ids.withColumns({"ns": ns, "local": F.when(cut > 0, F.expr("substring(id, instr(id, '/') + 1)")).otherwise(F.col("id"))})


def effective_kind(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, kind): the record's kind; without a record what its id says."""
    known = nodes.select("id", F.col("kind").alias("_k"))
    return ids.select("id").distinct().join(known, "id", "left").select("id", F.coalesce("_k", F.split_part("id", F.lit(":"), F.lit(1))).alias("kind"))


def marks(nodes: DataFrame) -> DataFrame:
    """(id, marks): the words that warn of a record, in order."""
    words = F.array(F.when(F.col("trust") == "untrusted", "untrusted"), F.when(F.col("status") == "proposed", "draft"), F.when(F.col("status") == "archived", "archived"))
    return nodes.select("id", F.array_join(words, " ").alias("marks"))


def of_kinds(nodes: DataFrame, wanted: list[str], registry: Registry) -> DataFrame:
    """Active nodes of kinds that are typed by name or plural, in any case."""
    typed = {w.strip().lower() for w in wanted}
    kinds = F.broadcast(registry.kinds.select("kind").where(F.col("kind").isin(*typed) | F.concat("kind", F.lit("s")).isin(*typed)))
    return nodes.where("status <> 'archived'").join(kinds, "kind", "left_semi")


def of_relations(expanded: DataFrame, wanted: list[str]) -> DataFrame:
    """Links by relation, read out, or by their label from this end."""
    return expanded.where(F.col("label").isin(*wanted) | (F.col("rel").isin(*wanted) & (F.col("direction") == "out")))


def decisions_about(decisions: DataFrame, words: list[str]) -> DataFrame:
    """Active decisions whose question and choice hold every word."""
    hay = F.lower(F.concat_ws(" ", "question", "chosen"))
    found = decisions.where("status = 'active'")
    for w in words:
        found = found.where(F.contains(hay, F.lit(w.lower())))
    return found


def card_counts(expanded: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, label, others): distinct neighbours by label, without background links and without same_as inside of a class.

    Only same_as links meet the classes.  Links are dealt by their record once, before they are told apart: few repeat, and counts
    by neighbour would travel a second time.
    """
    a, b = classes.select("id", F.col("class_id").alias("_a")), classes.select(F.col("id").alias("other"), F.col("class_id").alias("_b"))
    links, same = expanded.where("not background"), F.coalesce(F.col("rel") == "same_as", F.lit(False))
    met = links.where(same).join(a, "id", "left").join(b, "other", "left").where(~F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)))
    rest = links.where(~same).select("id", "label", "other").unionByName(met.select("id", "label", "other"))
    return rest.repartition("id").groupBy("id", "label").agg(F.count_distinct("other").alias("others"))


def record_views(records: DataFrame, degrees: DataFrame, prov: DataFrame, gaps: DataFrame, scopes: DataFrame) -> DataFrame:
    """One row a record: id, name, status, degree, its sources, gaps and decisions as sorted lists, which its own rows bound.  scopes: (id, scope_id)."""
    listed = lambda df, key, value, name: df.groupBy(F.col(key).alias("id")).agg(F.array_join(F.array_sort(F.collect_set(value)), ",").alias(name))
    out = records.select("id", "name", "status").join(degrees, "id", "left")
    for part in (listed(prov, "record_id", F.col("src"), "sources"), listed(gaps, "id", F.col("gap"), "gaps"), listed(scopes, "id", F.col("scope_id"), "decisions")):
        out = out.join(part, "id", "left")
    return out.na.fill(0, ["degree"]).na.fill("", ["sources", "gaps", "decisions"])


def page(rows: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """``limit`` rows from ``offset`` on, with the true total of all rows."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def progress(fold: DataFrame) -> DataFrame:
    """(q, answered, skipped, open, share): how far each question is, over nodes.  fold: see ``logs.answer_fold``."""
    done = F.count_if(F.col("status").isin("answered", "na"))
    out = fold.groupBy("q").agg(done.alias("answered"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if(F.col("status") == "later").alias("open"), F.count("*").alias("_n"))
    return out.withColumn("share", F.round(F.col("answered") / F.col("_n"), 4)).drop("_n")


def next_questions(gaps: DataFrame, nodes: DataFrame, degrees: DataFrame, coverage: DataFrame, registry: Registry, limit: int = 100, near: DataFrame | None = None, fold: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """(id, gap, detail, score, place): one question for each gap; severe gaps of well linked records in thin dimensions come first.

    Gaps that tell kind and degree (``node_gaps`` with ``more``) meet no nodes.  near (id): records near a goal weigh twice.  fold (q, node, skips, asked) with now: each skip takes 30, and what was asked in the last two days 300.
    """
    dims = F.broadcast(registry.kinds.select("kind", "dimension").join(coverage.select("dimension", F.col("coverage").alias("_c")), "dimension", "left"))
    rows = (gaps if {"kind", "degree"} <= set(gaps.columns) else gaps.join(nodes.select("id", "kind"), "id").join(degrees, "id", "left")).join(dims, "kind", "left")
    weight, less = F.lit(1), F.lit(0)
    if near is not None:
        rows = rows.join(near.select("id", F.lit(2).alias("_near")).distinct(), "id", "left")
        weight = F.coalesce("_near", F.lit(1))
    if fold is not None:
        asked = fold.where("q like 'q.gap.%'").select(F.col("node").alias("id"), F.expr("substring(q, 7)").alias("gap"), "skips", (F.unix_micros(now) - F.unix_micros("asked") <= 2 * 86_400_000_000).alias("_late"))
        rows = rows.join(asked, ["id", "gap"], "left")
        less = 30 * F.coalesce("skips", F.lit(0)) + F.when(F.col("_late"), 300).otherwise(0)
    score = PRIORITY + PER_DIMENSION * (1 - F.coalesce("_c", F.lit(1.0))) + PER_SEVERITY * F.col("severity") * F.log2(2 + F.coalesce("degree", F.lit(0))) * weight - less
    best = rows.select("id", "gap", "detail", F.round(score, 2).alias("score")).orderBy(F.desc("score"), "gap", "id", "detail").limit(limit)
    # ``limit`` rows are left to number.
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "gap", "id", "detail")))


def topic_gaps(coverage: DataFrame, texts: DataFrame, prov: DataFrame, nodes: DataFrame, bridges: DataFrame, backlog: DataFrame) -> DataFrame:
    """(gap, detail, severity) of the topic: dimensions under half their target, namespaces without bridges, sources that nothing cites, proposals that wait."""
    thin = coverage.where("coverage < 0.5").select(F.lit("missing_dimension").alias("gap"), F.col("dimension").alias("detail"), F.lit(9).alias("severity"))
    linked = bridges.select(F.explode(F.array("a", "b")).alias("ns")).distinct()
    alone = nodes.select("ns").distinct().join(linked, "ns", "left_anti").select(F.lit("unbridged_import").alias("gap"), F.col("ns").alias("detail"), F.lit(6).alias("severity"))
    uncited = texts.select("id").join(prov.select(F.col("src").alias("id")).distinct(), "id", "left_anti").select(F.lit("uncited_source").alias("gap"), F.col("id").alias("detail"), F.lit(3).alias("severity"))
    waiting = backlog.where("pending > 0").select(F.lit("pending_backlog").alias("gap"), F.col("pending").cast("string").alias("detail"), F.lit(2).alias("severity"))
    return thin.unionByName(alone).unionByName(uncited).unionByName(waiting)


#: A merge closes a duplicate gap of this severity.
DUPLICATE = 3


def closed_gaps(ops: DataFrame, gaps: DataFrame) -> DataFrame:
    """(prop_id, n, id, gap, detail, severity): gaps that operations close.

    A link closes both ends' orphan gap and their gap of this relation and direction; a change the missing fields that it sets and, with
    any field or a summary, that a record is thin.  ops: (prop_id, n, op, target, rel, other, fields).
    """
    want = lambda id_, gap, detail: F.struct(id_.alias("id"), F.lit(gap).alias("gap"), detail.alias("want"))
    none, linked = F.lit(None).cast("string"), F.col("op") == "add_edge"
    ends = [want(F.col(end), gap, detail) for end, way in (("target", "out"), ("other", "in")) for gap, detail in (("orphan", none), ("missing_relation", F.concat_ws(" ", "rel", F.lit(way))))]
    fields = F.filter(F.coalesce("fields", F.array().cast("array<string>")), lambda f: F.startswith(f, F.lit("attrs.")))
    told = F.exists(F.coalesce("fields", F.array().cast("array<string>")), lambda f: F.startswith(f, F.lit("attrs.")) | (f == "summary"))
    thin = F.when(told, F.array(want(F.col("target"), "thin", none))).otherwise(F.array().cast("array<struct<id:string,gap:string,want:string>>"))
    changed = F.concat(F.transform(F.array_distinct(fields), lambda f: want(F.col("target"), "missing_field", F.substring(f, F.lit(7), F.length(f)))), thin)
    wanted = ops.select("prop_id", "n", F.explode(F.when(linked, F.array(*ends)).when(F.col("op") == "update_node", changed)).alias("w")).select("prop_id", "n", "w.*")
    return wanted.join(gaps, ["id", "gap"]).where(F.col("want").isNull() | (F.col("want") == F.col("detail"))).select("prop_id", "n", "id", "gap", "detail", "severity")


def proposals(ops: DataFrame, gaps: DataFrame) -> DataFrame:
    """(prop_id, n_ops, drafts, closes, priority): priority is 10 for each severity of a gap that an operation closes, and 5 an operation.  ops: see ``closed_gaps``, with verdict."""
    severity = closed_gaps(ops, gaps).groupBy("prop_id").agg(F.sum("severity").alias("_s"))
    rows = ops.groupBy("prop_id").agg(F.count("*").alias("n_ops"), F.count_if(F.col("verdict") == "draft").alias("drafts"), F.count_if(F.col("op") == "merge").alias("_merges"))
    rows = rows.join(severity, "prop_id", "left").withColumn("closes", F.coalesce("_s", F.lit(0)) + DUPLICATE * F.col("_merges")).drop("_s", "_merges")
    return rows.withColumn("priority", 10 * F.col("closes") + 5 * F.col("n_ops"))


def backlog(props: DataFrame, most: int = 20) -> DataFrame:
    """(pending, over): proposals with an operation that waits, and whether they are more than ``most``."""
    return props.agg(F.count_if(F.col("drafts") > 0).alias("pending")).withColumn("over", F.col("pending") > most)


def destructive(ops: DataFrame, nodes: DataFrame) -> DataFrame:
    """Operations that merge or archive, or change a confirmed record.  ops: (prop_id, n, op, target)."""
    sure = nodes.where("status = 'confirmed'").select(F.col("id").alias("target"), F.lit(True).alias("_sure"))
    return ops.join(sure, "target", "left").where(F.col("op").isin("merge", "archive") | (F.col("op").isin("update_node", "update_edge") & F.col("_sure"))).drop("_sure")


def undraftable(ops: DataFrame) -> DataFrame:
    """Operations that were left as drafts although they can only be accepted or rejected."""
    return ops.where(F.col("op").isin("merge", "archive", "map_kinds", "add_question") & (F.col("verdict") == "draft"))


def same_content(ops: DataFrame) -> DataFrame:
    """(prop_id, same_as): proposals of the content of an earlier one (smallest id): the same author, source and operations in order, each with its target and values.

    ops: (prop_id, n, and what makes an operation); a proposal's operations bound its list.
    """
    told = [F.array_sort(F.map_entries(c)).alias(c) if kind.startswith("map") else F.col(c) for c, kind in sorted(ops.dtypes) if c not in ("prop_id", "n")]
    one = ops.select("prop_id", "n", F.to_json(F.struct(*told), {"ignoreNullFields": "false"}).alias("_told"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("n", "_told"))), lambda x: x["_told"])
    keyed = one.groupBy("prop_id").agg(F.sha2(F.array_join(in_order, "\n"), 256).alias("key"))
    first = keyed.groupBy("key").agg(F.min("prop_id").alias("same_as"))
    return keyed.join(first, "key").where("prop_id <> same_as").select("prop_id", "same_as")


def log_union(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Lines of both branches of a log, those of both once."""
    return ours.unionByName(theirs).distinct()


def short_ids(hashes: DataFrame, start: int = 12, step: int = 2, longest: int = 64) -> DataFrame:
    """(id, short): the shortest prefix of ``start`` digits or ``step`` more that no other id has.  hashes: (id) of equal length.

    Ids that share a prefix stand next to each other in order, so an id is told from its two neighbours among those of its first ``start`` digits.
    """
    by = Window.partitionBy(F.substring("id", 1, start)).orderBy("id")
    near = hashes.select("id", F.lag("id").over(by).alias("_a"), F.lead("id").over(by).alias("_b"))
    cut = lambda c, n: F.substring(c, F.lit(1), n)
    most = F.least(F.lit(longest), F.length("id"))
    lengths = F.when(most >= start, F.sequence(F.lit(start), most, F.lit(step)))
    alone = F.filter(lengths, lambda n: ~F.coalesce(cut("id", n) == cut("_a", n), F.lit(False)) & ~F.coalesce(cut("id", n) == cut("_b", n), F.lit(False)))
    return near.select("id", cut("id", F.coalesce(F.try_element_at(alone, F.lit(1)), F.length("id"))).alias("short")).distinct()


def warnings(gaps: DataFrame, stale: DataFrame, touched: DataFrame, waiting: DataFrame) -> DataFrame:
    """(code, n): W01 missing field, W02 orphan, W04 link to an archived record, W05 stale source, W06 backlog."""
    of = lambda df, code: df.agg(F.count("*").alias("n")).select(F.lit(code).alias("code"), "n")
    parts = [of(gaps.where("gap = 'missing_field'"), "W01"), of(gaps.where("gap = 'orphan'"), "W02"), of(touched, "W04"), of(stale, "W05"), of(waiting.where("over"), "W06")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def named(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(q, id, tier): records whose name (1), alias (2) or id's slug (3) is the query's, by name key; the best tier of each query."""
    live = nodes.where("status <> 'archived'")
    keys = live.select("id", F.lit(1).alias("tier"), S.name_key("name").alias("key"))
    keys = keys.unionByName(live.select("id", F.lit(2).alias("tier"), F.explode("aliases").alias("_a")).select("id", "tier", S.name_key("_a").alias("key")))
    keys = keys.unionByName(live.select("id", F.lit(3).alias("tier"), S.name_key(F.split_part("id", F.lit(":"), F.lit(2))).alias("key")))
    hits = queries.select("q", S.name_key("q").alias("key")).distinct().join(keys.where("key <> ''"), "key").groupBy("q", "id").agg(F.min("tier").alias("tier"))
    best = hits.groupBy("q").agg(F.min("tier").alias("tier"))
    return hits.join(best, ["q", "tier"]).select("q", "id", "tier")


def text_measures(rows: DataFrame, key: str, text: str = "text", width: int = 60) -> DataFrame:
    """(key, tokens, brief): a text's estimated tokens, and its first words on one line."""
    return rows.select(key, S.estimated_tokens(F.col(text)).cast("long").alias("tokens"), S.truncated(F.col(text), width).alias("brief"))
