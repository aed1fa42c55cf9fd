"""The registered graph queries: each applies an operator to the whole derived graph."""
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.functions import scalars as S
from evigraph.operators import answers, briefs, changes, components, compose, evidence, expand, logs, needs, quality, redaction, resolve, scopes, search, traverse
from evigraph.plans import testgraph as T
from evigraph.sources import fences, files, shapes, texts

SEARCHES = ["customer#000000007", "spring OR autumn", "order 1", "part:12", "machinery", "alt europe", "regions", "orders 77", "meated spring"]


class Tables:
    """The derived tables of one run, each built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        value = {
            "nodes": lambda: T.nodes(self.spark, self.sf), "edges": lambda: T.edges(self.spark, self.sf), "prov": lambda: T.provenance(self.spark, self.sf), "captured": lambda: T.sources(self.spark, self.sf),
            "answers": lambda: T.answers(self.spark, self.sf), "reviews": lambda: T.reviews(self.spark, self.sf), "decisions": lambda: T.decisions(self.spark, self.sf), "registry": lambda: T.graph(self.spark, self.sf).registry,
            "expanded": lambda: expand.expand(self.nodes, T.edges(self.spark, self.sf, True), self.registry), "classes": lambda: traverse.same_as_classes(self.edges), "degrees": lambda: expand.degree(self.expanded), "counts": lambda: components.written(needs.link_counts(self.expanded, self.registry)), "counted": lambda: self.counts.select("id", "degree"),
            "links": lambda: traverse.contracted(self.expanded, self.classes), "hubs": lambda: self.nodes.join(F.broadcast(self.registry.kinds.where("hub").select("kind")), "kind", "left_semi").select("id"),
            "texts": lambda: self.captured.select(S.source_id("text").alias("id"), "text").dropDuplicates(["id"]), "gaps": lambda: self.counted_gaps.drop("kind", "degree"),
            "told": lambda: T.edges_with_records(self.spark, self.sf), "asked_gaps": lambda: needs.gaps_of(_reviewed(self).select(F.explode(F.array("target", "other")).alias("id")), self.nodes, self.expanded, self.classes, self.prov, self.registry),
            "counted_gaps": lambda: needs.node_gaps(self.nodes, self.expanded, self.classes, self.prov, self.registry, self.counts, True),
            "store": lambda: logs.source_store(self.captured), "claims": lambda: T.claims(self.spark, self.sf), "conflicts": lambda: needs.class_conflicts(self.nodes, self.classes),
            "stale": lambda: logs.stale_sources(self.store, F.timestamp_seconds(F.lit(1704067200 + 86400 * 30))).select("id"), "premises": lambda: evidence.archived_premises(T.premises(self.spark, self.sf), self.claims),
        }[name]()
        setattr(self, name, value)
        return value

    def links_from(self, kinds: list[str] | None) -> DataFrame:
        """``links`` from class ids of ``kinds``; a class holds records of one kind, as same_as joins parts only."""
        return traverse.contracted(expand.expand(self.nodes, T.edges(self.spark, self.sf, True, kinds), self.registry), self.classes, kinds)

    def expanded_from(self, kinds: list[str] | None) -> DataFrame:
        """``expanded`` from ids of ``kinds``."""
        links = expand.expand(self.nodes, T.edges(self.spark, self.sf, True, kinds), self.registry)
        return links if kinds is None else links.where(traverse.kind_of("id").isin(kinds))

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf}/{name}.parquet")


def _coverage(t: Tables, degrees: DataFrame | None = None) -> DataFrame:
    return needs.dimension_coverage(expand.substantive(t.nodes, t.degrees if degrees is None else degrees, t.prov), t.registry)


def _points(t: Tables) -> DataFrame:
    e = t.raw("events")
    return e.groupBy(F.col("event_type").alias("key"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("at")).agg(F.count("*").cast("double").alias("value"))


def _epoch(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def _merges(t: Tables) -> DataFrame:
    """same_as links as merges: the later part goes into the earlier."""
    return t.edges.where("rel = 'same_as'").select(F.col("src").alias("keep"), F.col("dst").alias("drop"))


def _flat(df: DataFrame) -> DataFrame:
    return df.select("id", "src", "rel", "dst", "key", "status", "conf", "background")


def _snapshot(t: Tables) -> DataFrame:
    return t.nodes.select("id", "name", "status", "conf")


def _ours(t: Tables) -> DataFrame:
    return _snapshot(t).where("conf > 0.05 or name like 'S%'").withColumn("status", F.when(F.col("conf") > 0.75, "confirmed").otherwise(F.col("status")))


def _theirs(t: Tables) -> DataFrame:
    return _snapshot(t).withColumn("name", F.when((F.col("conf") > 0.65) & (F.col("conf") < 0.85), F.upper("name")).otherwise(F.col("name"))).withColumn("status", F.when(F.col("conf") > 0.85, "confirmed").otherwise(F.col("status")))


def _ops(t: Tables) -> DataFrame:
    return t.reviews.select("prop_id", "n", F.when(F.col("n") > 7, "archive").otherwise(F.col("op")).alias("op"), F.when(F.col("n") == 1, F.lit("r1")).alias("ref"), F.when(F.col("n") == 2, F.lit("$r1")).when(F.col("n") == 3, F.lit("$r9")).otherwise(F.concat("kind", F.lit(":"), (F.col("conf") * 10).cast("int") * 40)).alias("target"), F.when(F.col("n") == 8, "too short").otherwise("a reason of more than twenty letters").alias("reason"))


def _cues(t: Tables) -> DataFrame:
    """Each line of a turn as a cue of its own."""
    c = t.raw("conversations")
    stamp = lambda i: F.concat(F.lit("00:"), F.lpad((F.col("turn") % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((i % 60).cast("string"), 2, "0"), F.lit(".000 --> 00:59:59.000\n<v "), F.col("role"), F.lit(">"))
    blocks = F.transform(F.split("text", "\r\n?|\n"), lambda line, i: F.concat(stamp(i), line, F.lit("</v>")))
    return c.select("conv_id", "turn", texts.cue_lines(F.concat(F.lit("WEBVTT\n\n"), F.array_join(blocks, "\n\n"))).alias("cue"))


def _units(t: Tables) -> DataFrame:
    c = t.raw("conversations")
    return c.select(F.col("conv_id").cast("string").alias("subject"), F.col("turn").alias("rank"), (F.length("text") + 1).alias("size"))


def _reviewed(t: Tables) -> DataFrame:
    """The reviewed operations with their target, the record of their own number."""
    number = F.expr("cast(substring(prop_id, 6) as bigint) * 10 + n")
    op = F.when(F.col("n") > 8, "merge").when(F.col("n") > 7, "archive").when(F.col("n") > 5, "update_node").otherwise(F.col("op"))
    rows = t.reviews.select("prop_id", "n", op.alias("op"), "kind", "verdict", number.alias("_k"), F.concat("kind", F.lit(":"), number).alias("target"))
    linked, changed = F.col("op") == "add_edge", F.col("op") == "update_node"
    by_kind = lambda order, customer, part: F.when(F.col("kind") == "order", order).when(F.col("kind") == "customer", customer).otherwise(part)
    return rows.select(
        "prop_id", "n", "op", "kind", "verdict", "target", F.when(linked, by_kind(F.lit("contains"), F.lit("located_in"), F.lit("same_as"))).alias("rel"),
        F.when(linked, by_kind(F.concat(F.lit("part:"), "_k"), F.concat(F.lit("nation:"), F.col("_k") % 25), F.concat(F.lit("part:"), F.col("_k") + 1))).alias("other"),
        F.when(changed, F.array(F.when(F.col("n") == 7, "summary").otherwise(by_kind(F.lit("attrs.priority"), F.lit("attrs.segment"), F.lit("attrs.brand"))))).alias("fields"),
    )


def _drafted(t: Tables) -> DataFrame:
    """Proposals of one change to each line's part: the lines of an order are a proposal, many orders ask the same."""
    line = t.raw("lineitem")
    return line.select(F.concat(F.lit("prop-"), "l_orderkey", F.lit("-"), "l_linenumber").alias("prop_id"), F.lit(1).alias("n"), F.lit("update_node").alias("op"), F.concat(F.lit("part:"), F.col("l_partkey")).alias("target"), F.create_map(F.lit("attrs.size"), F.floor(F.col("l_quantity") / 10).cast("string")).alias("set"), F.col("l_returnflag").alias("by"))


def _bridges(t: Tables) -> DataFrame:
    side = lambda end, ns: t.nodes.select(F.col("id").alias(end), F.col("ns").alias(ns))
    return t.edges.where("rel = 'located_in'").join(side("src", "a"), "src").join(side("dst", "b"), "dst").where("a <> b").select("a", "b").distinct()


def _fold(t: Tables) -> DataFrame:
    return logs.answer_fold(t.answers)


def _log_lines(t: Tables, keep: str) -> DataFrame:
    return t.answers.where(keep).select("seq", "q", "node", "status")


def _customers(t: Tables) -> DataFrame:
    return t.nodes.where("kind = 'customer'")


def _name_classes(t: Tables) -> DataFrame:
    """Customers taken for one: each five in a row of keys."""
    c = t.raw("customer")
    return c.select(F.concat(F.lit("customer:"), "c_custkey").alias("id"), F.concat(F.lit("customer:"), F.floor(F.col("c_custkey") / 5) * 5).alias("class_id"))


def _linked(t: Tables) -> DataFrame:
    return evidence.linked_gaps(t.nodes, t.expanded, t.classes, t.prov, t.stale, t.conflicts, t.decisions, t.premises, evidence.broken_bridges(t.nodes, t.told), t.claims)


#: Questions of the log, taken for questions about gaps.
ASKED = ["single_source", "low_confidence", "thin", "missing_field", "missing_relation", "orphan", "draft"]


def _gap_fold(t: Tables) -> DataFrame:
    """The interview log as answers about customers' gaps."""
    name = F.element_at(F.array(*[F.lit(g) for g in ASKED]), F.expr("cast(substring(q, 2) as int) + 1"))
    return logs.answer_fold(t.answers.withColumns({"node": F.replace("node", F.lit("user:"), F.lit("customer:")), "q": F.concat(F.lit("q.gap."), name)}))


def _files(t: Tables) -> DataFrame:
    """Documents in three encodings, customers as JSON, suppliers as delimited text, nations as images."""
    mark = lambda h: F.unhex(F.lit(h))
    kind = F.col("doc_id") % 3
    content = F.when(kind == 0, F.concat(mark("EFBBBF"), F.encode("text", "UTF-8"))).when(kind == 1, F.concat(mark("FFFE"), F.encode("text", "UTF-16LE"))).otherwise(F.encode("text", "UTF-8"))
    docs = t.raw("documents").select(F.concat(F.lit("d/"), "doc_id", F.when(kind == 2, ".md").otherwise(".TXT")).alias("path"), content.alias("content"))
    spelt = t.raw("customer").select(F.concat(F.lit("c/"), "c_custkey", F.lit(".json")).alias("path"), F.encode(F.concat(F.lit('{"name":"'), "c_name", F.lit('", "at":['), "c_nationkey", F.lit(","), "c_custkey", F.lit('.50],"none":{}}')), "UTF-8").alias("content"))
    rows = t.raw("supplier").select(F.concat(F.lit("s/"), "s_suppkey", F.lit(".csv")).alias("path"), F.encode(F.concat(F.lit("key;;key\n"), "s_suppkey", F.lit(";;"), "s_name", F.lit(";past\n")), "UTF-8").alias("content"))
    images = t.raw("nation").select(F.concat(F.lit("n/"), "n_nationkey", F.lit(".txt")).alias("path"), F.concat(mark("89504E47"), F.encode("n_name", "UTF-8")).alias("content"))
    return T.union([docs, spelt, rows, images])


def _topic_fold(t: Tables) -> DataFrame:
    """The interview log as answers about the topic as a whole."""
    return logs.answer_fold(t.answers.withColumn("node", F.lit("topic")))


def _loads(t: Tables) -> DataFrame:
    """Records as three files hold them, in load order."""
    rows = [_snapshot(t), _ours(t), _theirs(t)]
    return T.union([df.withColumn("line", F.lit(k)) for k, df in enumerate(rows)])


def _log_changes(t: Tables) -> DataFrame:
    """Labels as changes: the proposal of their own number or one that was never made, and two records."""
    number = F.col("doc_id")
    return t.raw("labels").select(F.concat(F.lit("chg-"), number).alias("id"), F.when(number % 7 == 0, "prop-none").when(number % 5 > 0, F.concat(F.lit("prop-"), F.floor(number / 10))).alias("proposal"), F.array(F.concat(F.lit("part:"), number), F.concat(F.lit("order:"), number)).alias("ids"))


def _created(t: Tables) -> DataFrame:
    waiting = t.reviews.where("verdict = 'draft'").select("prop_id").distinct()
    return waiting.withColumn("created", F.date_add(F.lit("2024-01-01").cast("date"), F.expr("cast(substring(prop_id, 6) as int) % 90")))


def _tools(t: Tables) -> DataFrame:
    own = t.captured.select(S.source_id("text").alias("id"), F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("tool:"), F.col("doc_id") % 9)).alias("refresh_with"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("tool:"), F.col("doc_id") % 5)).alias("via"))
    return evidence.refresh_tools(own, t.prov, t.raw("supplier").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("id"), F.concat(F.lit("tool:"), F.col("s_suppkey") % 6).alias("tool")))


def _order_notes(t: Tables) -> DataFrame:
    """(key, text): a note on each order that names its customer and region in many ways."""
    rows = t.raw("orders").join(t.raw("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("c_custkey").cast("string")
    words = ["Placed by ", F.col("c_name"), " as self/customer:", k, ", not x/customer:", k, "; see customer:", k, ".txt, Customer-", k, " and alt ", F.col("c_name"), ", from ", F.col("r_name"), " or ", F.lower("r_name")]
    return rows.select(F.col("o_orderkey").alias("key"), F.concat(*[F.lit(w) if isinstance(w, str) else w for w in words]).alias("text"))


def _hidden(t: Tables) -> DataFrame:
    """Customers of one namespace and two regions."""
    return t.nodes.where("(kind = 'customer' and ns = 'b') or (kind = 'region' and k >= 3)").select("id")


def _brief_units(t: Tables) -> DataFrame:
    """Units of the briefs of all customers."""
    scopes = search.scope_overlaps(_customers(t).select("id"), t.decisions.select(F.col("id").alias("scope_id"), F.explode("scope").alias("scope")))
    return components.written(briefs.brief_units(_customers(t).select("id"), t.nodes, t.expanded, t.prov, t.gaps, scopes, t.decisions, t.hubs))


def _briefs(t: Tables) -> DataFrame:
    return briefs.fitted_texts(_brief_units(t), [0, 60, 200, 2000], briefs.SECTIONS)


def _phrases(t: Tables) -> DataFrame:
    """Part names as they stand, in the plural, and turned round with an unknown word; nations' aliases, suppliers, ids that are and are not there."""
    part = t.raw("part").select(F.col("p_name").alias("n")).distinct()
    turned = F.concat(F.split_part("n", F.lit(" "), F.lit(2)), F.lit(" the "), F.split_part("n", F.lit(" "), F.lit(1)), F.lit(" zzq"))
    one = lambda df, q: df.select(q.alias("q"))
    key = F.col("c_custkey").cast("string")
    return T.union([
        one(part, F.col("n")), one(part, F.concat("n", F.lit("s"))), one(part, turned), one(t.raw("nation"), F.concat(F.lit("alt "), "n_name")), one(t.raw("region"), F.concat(F.lit("qq"), "r_name", F.lit(" xx"))),
        one(t.raw("supplier"), F.col("s_name")), one(t.raw("customer"), F.concat(F.lit("Customer:"), key)), one(t.raw("customer"), F.concat(F.lit("customer:x"), key)),
    ])


def _record_lines(t: Tables) -> DataFrame:
    """(line): customers as record lines, of which some hold fields of other types or characters that may not stand there."""
    k = F.col("c_custkey")
    every = lambda n, then, other: F.when(k % n == 0, F.lit(then)).otherwise(other if isinstance(other, Column) else F.lit(other))
    name = every(29, '"two\\nlines"', every(7, "17", every(5, "null", F.concat(F.lit('"'), "c_name", F.lit('"')))))
    summary = every(31, '"bell\\u0007"', every(17, '["s"]', '"two\\nlines"'))
    aliases = every(37, '["ok","x\\u202ey"]', every(11, '"one"', F.concat(F.lit('["alt '), "c_name", F.lit('"]'))))
    attrs = every(13, "[1]", F.concat(F.lit('{"segment":"'), "c_mktsegment", F.lit('","deep":{"n":1.50}}')))
    prov = every(19, "{}", '[{"src":"s","quote":"x\\u202ey"}]')
    parts = [F.lit('{"id":"customer:'), k.cast("string"), F.lit('","name":'), name, F.lit(',"summary":'), summary, F.lit(',"aliases":'), aliases, F.lit(',"attrs":'), attrs, F.lit(',"prov":'), prov, every(23, ',"archived":"gone"', ""), every(41, ',"note":"\\ud83d"', ""), every(43, "", "}")]
    return t.raw("customer").select(F.concat(*parts).alias("line"))


def _contacts(t: Tables) -> DataFrame:
    """(c_custkey, text): notes on customers with addresses in many spellings; some hold a credential."""
    k = F.col("c_custkey")
    key = k.cast("string")
    words = ["mail c", key, "%40shop.example or c", key, "\uff20shop.example, ", F.when(k % 10 == 0, "api%5Fkey%3D0123456789abcdef0123").when(k % 10 == 1, "\uff54oken \uff1d 0123456789abcdef0123").otherwise("no key"), "\n", '{"phone": "07700', F.lpad(key, 6, "0"), '", "size": 4.50', F.when(k % 10 == 2, ', "client_secret": "s3cr3t-value"').otherwise(""), "}"]
    return t.raw("customer").select("c_custkey", F.concat(*[F.lit(w) if isinstance(w, str) else w for w in words]).alias("text"))


def _stored(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The index of sources and their files, of which some are lost, changed or not listed."""
    index = t.store.select("id", F.when(F.col("doc_id") % 11 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.col("sha256")).alias("sha256"), F.when(F.col("doc_id") % 13 == 0, F.col("bytes") + 1).otherwise(F.col("bytes")).alias("bytes"), (F.col("doc_id") % 22 == 0).alias("erased"))
    text = S.normal_text("text")
    kept = t.captured.select(F.encode(text, "UTF-8").alias("content"), F.concat(F.lit("src-"), F.substring(F.sha2(text, 256), 1, 12)).alias("id")).dropDuplicates(["id"]).where("substring(id, 5, 1) <> '0'")
    other = t.raw("nation").select(F.concat(F.lit("sources/"), F.when(F.col("n_nationkey") % 2 == 0, ".").otherwise("note-"), "n_nationkey").alias("path"), F.encode("n_name", "UTF-8").alias("content"))
    return index, kept.select(F.concat(F.lit("sources/"), "id", F.lit(".txt")).alias("path"), "content").unionByName(other)


def _bundles(t: Tables) -> DataFrame:
    """Exports of orders that bundle those of their parts, which bundle those of their suppliers."""
    # An order's lines meet once, for all three levels.
    line = t.raw("lineitem").select("l_orderkey", "l_partkey", "l_suppkey").repartition("l_orderkey").distinct()
    export = lambda node, inner: F.concat(F.lit('{"nodes":[{"id":"'), node, F.lit('"}], "bundled":{'), inner, F.lit("}}"))
    entry = lambda ns, of: F.concat(F.lit('"'), ns, F.lit('":{"export":'), of, F.lit("}"))
    supplier = line.select("l_orderkey", "l_partkey", entry(F.concat(F.lit("s"), "l_suppkey"), export(F.concat(F.lit("supplier:"), "l_suppkey"), F.lit(""))).alias("e"))
    part = supplier.groupBy("l_orderkey", "l_partkey").agg(F.array_join(F.collect_list("e"), ",").alias("inner"))
    part = part.select("l_orderkey", entry(F.concat(F.lit("p"), "l_partkey"), export(F.concat(F.lit("part:"), "l_partkey"), F.col("inner"))).alias("e"))
    return part.groupBy("l_orderkey").agg(F.array_join(F.collect_list("e"), ",").alias("inner")).select(F.col("l_orderkey").alias("key"), export(F.concat(F.lit("order:"), "l_orderkey"), F.col("inner")).alias("export"))


def _doubled(t: Tables) -> DataFrame:
    """Sources whose lines stand twice, some captured later, some erased, some with another text."""
    own = t.store.select("id", "sha256", F.col("captured_at"), F.lit(False).alias("erased"), "doc_id")
    k = F.col("doc_id") % 4
    again = own.select("id", F.when(k == 3, F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256"), F.when(k == 1, F.col("captured_at") - F.expr("interval 1 day")).otherwise(F.col("captured_at")).alias("captured_at"), (k == 2).alias("erased"), "doc_id")
    return own.unionByName(again)


def _fresh(t: Tables) -> DataFrame:
    """Problems that a change of each supplier would add: ids of another grammar, under a namespace, of an unknown kind, used again, and links of an unknown relation."""
    k, s = F.col("k"), t.nodes.where("kind = 'supplier'")
    n = (k % 5).cast("int")
    prefix = F.element_at(F.array(*[F.lit(p) for p in ("Supplier:", "x/supplier:", "gadget:", "supplier:")]), F.least(n + 1, F.lit(4)))
    more = s.where(n < 4).withColumns({"id": F.concat(prefix, k), "kind": F.when(n == 2, "gadget").otherwise("supplier"), "name": F.concat(F.lit("planted "), k), "aliases": F.array().cast("array<string>")})
    link = s.where(n == 4).select(F.concat(F.lit("e-"), F.lpad(k.cast("string"), 12, "0")).alias("id"), F.concat(F.lit("supplier:"), k).alias("src"), F.lit("eats").alias("rel"), F.lit("nation:0").alias("dst"), F.lit(None).cast("string").alias("key"), F.lit("confirmed").alias("status"), F.lit(0.5).alias("conf"), F.lit(False).alias("background"))
    return quality.problems_of_change(t.nodes, t.edges, more, link, t.registry)


def _spoken(t: Tables) -> DataFrame:
    """Turns as units: a conversation is a subject, its roles are sections, a turn of a system is essential."""
    c = t.raw("conversations")
    return c.select(F.col("conv_id").cast("string").alias("subject"), F.col("turn").alias("rank"), F.col("role").alias("section"), F.concat("role", F.lit(": "), "text").alias("text"), (F.length("role") + F.length("text") + 3).alias("size"), (F.col("role") == "system").alias("essential"), F.lit(1).alias("count"))


def _names(t: Tables) -> DataFrame:
    return t.raw("part").select(F.col("p_partkey").cast("string").alias("ref"), F.lit("part").alias("kind"), F.col("p_name").alias("name"))


QUERIES = {
    # expansion and counts
    "ranked_gaps": lambda t: needs.ranked(t.counted_gaps.drop("kind"), None, 500),
    "degree": lambda t: t.degrees,
    "directed_links": lambda t: t.expanded.select("id", "other", "label", "direction", "edge_id"),
    "relation_groups": lambda t: expand.relation_groups(expand.expand(t.nodes, T.edges(t.spark, t.sf, True, active=True), t.registry)),
    "status_counts": lambda t: t.nodes.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "proposed").alias("drafts"), F.count_if(F.col("status") == "archived").alias("archived")),
    "breakdown_kind_status": lambda t: t.nodes.groupingSets([["kind"], ["status"], []], "kind", "status").agg(F.count("*").alias("n")),
    "namespace_bridges": lambda t: t.edges.where("rel = 'located_in'").join(t.nodes.select(F.col("id").alias("src"), F.col("ns").alias("a")), "src").join(t.nodes.select(F.col("id").alias("dst"), F.col("ns").alias("b")), "dst").where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n")),
    # quality
    "dangling_endpoints": lambda t: quality.dangling_endpoints(t.nodes, t.told),
    "signature_violations": lambda t: quality.signature_violations(t.nodes, t.told, t.registry),
    "archived_touch": lambda t: quality.archived_touch(t.nodes, t.told),
    "alias_collisions": lambda t: quality.alias_collisions(t.nodes),
    "provenance_problems": lambda t: quality.provenance_problems(t.prov, t.texts.select("id", F.size(F.split("text", "\n")).alias("n_lines"))),
    "quote_check": lambda t: quality.quote_check(t.prov, t.texts),
    "provenance_index": lambda t: t.prov.groupBy("src").agg(F.count("*").alias("citations"), F.count_distinct("record_id").alias("records")),
    "field_errors": lambda t: quality.field_errors(t.nodes, t.spark.createDataFrame([("customer", "segment", "enum", "BUILDING|MACHINERY"), ("part", "brand", "pattern", "^Brand#[1-3][0-9]$"), ("part", "type", "maxLength", "18")], "kind string, field string, keyword string, value string")),
    "validate": lambda t: quality.validate(t.nodes, t.told, t.prov, t.texts.select("id", F.size(F.split("text", "\n")).alias("n_lines")), t.registry).groupBy("code").agg(F.count("*").alias("n")),
    "fresh_problems": _fresh,
    # needs and richness
    "needs_gaps": lambda t: t.gaps,
    "dimension_coverage": lambda t: _coverage(t).withColumn("coverage", F.round("coverage", 6)),
    "richness": lambda t: needs.richness(t.nodes, t.edges, t.gaps, t.prov, _coverage(t, t.counted), t.registry),
    "calibration": lambda t: needs.calibration(t.reviews),
    "class_conflicts": lambda t: needs.class_conflicts(t.nodes, t.classes),
    # what records rest on
    "archived_premises": lambda t: t.premises,
    "broken_bridges": lambda t: evidence.broken_bridges(t.nodes, t.told),
    "draft_links": lambda t: evidence.draft_links(t.expanded),
    "settled_conflicts": lambda t: evidence.settled_conflicts(needs.class_conflicts(t.nodes, _name_classes(t)), _name_classes(t), t.decisions.withColumn("status", F.when(F.col("supersedes").isNotNull(), "active").otherwise("superseded"))),
    "linked_gaps": _linked,
    "closed_dimensions": lambda t: evidence.closed_dimensions(_topic_fold(t), t.spark.createDataFrame([(f"q{k}", d) for k, d in enumerate(["geography", "market", "supply", "catalogue", "market", "supply", "people"])], "q string, dimension string")),
    "first_records": lambda t: evidence.first_records(_loads(t)),
    "log_disorder": lambda t: evidence.log_disorder(t.answers.withColumn("at", F.when(F.col("seq") % 11 == 0, F.col("at") - F.expr("interval 2 days")).otherwise(F.col("at"))), block=1000),
    "missing_references": lambda t: evidence.missing_references(_log_changes(t), t.reviews, t.nodes),
    "narrowed_decisions": lambda t: evidence.narrowed_decisions(t.decisions.withColumn("narrows", F.col("supersedes"))),
    "pending_block": lambda t: evidence.pending_block(_created(t), F.lit("2024-06-01").cast("date")),
    "path_values": lambda t: evidence.path_values(t.nodes, t.nodes.select("id", F.explode(F.array(*[F.lit(p) for p in ("attrs.brand", "attrs.segment", "name", "status", "summary", "gaps.x")])).alias("path"))),
    "distinct_provenance": lambda t: evidence.distinct_provenance(t.prov.unionByName(t.prov.withColumn("ord", F.col("ord") + 10))),
    "refresh_tools": _tools,
    "recited_proposals": lambda t: evidence.recited(_reviewed(t).select("prop_id", "n", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.col("n") % 3 + 1).alias("ns"), "target", F.lit("v1").alias("pin")), t.spark.createDataFrame([("a", "v2"), ("b", "v3")], "ns string, pin string"), t.nodes.select("ns", F.col("id").alias("target"))),
    "risk_findings": lambda t: evidence.risk_findings(*T.risks(t.spark, t.sf)),
    "open_gaps": lambda t: needs.open_gaps(t.gaps, _gap_fold(t)),
    "paced_questions": lambda t: answers.next_questions(t.counted_gaps, t.nodes, t.counted, _coverage(t, t.counted), t.registry, 100, t.expanded.where("id like 'supplier:%'").select(F.col("other").alias("id")), _gap_fold(t), F.lit("2024-01-20 00:00:00").cast("timestamp")),
    # walks
    "same_as_classes": lambda t: t.classes,
    "confirmed_classes": lambda t: traverse.same_as_classes(t.edges, True),
    "neighbours_2hop": lambda t: traverse.neighbours(t.nodes.where("kind = 'customer'").select("id"), t.links_from, t.hubs, 2),
    "goal_reach": lambda t: traverse.goal_reach(t.nodes.where("kind = 'supplier'").select("id"), t.expanded_from, t.hubs, 2, components.written(t.classes)),
    "related_records": lambda t: traverse.related(t.nodes.where("kind = 'supplier'").select("id", F.col("k").alias("rank")), t.links_from, t.hubs, 1),
    "k_paths": lambda t: traverse.shortest_paths(t.raw("supplier").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("a"), F.concat(F.lit("customer:"), "s_suppkey").alias("z")), t.links, t.hubs, 3, 3),
    "supersession_chains": lambda t: traverse.supersession_ends(t.decisions.select("id", "superseded_by", "status")),
    # resolution
    "duplicates": lambda t: resolve.duplicates(t.nodes.where("kind in ('region', 'nation', 'supplier', 'part')")),
    "bridge_candidates": lambda t: resolve.bridge_candidates(t.nodes, "a", "b", t.prov),
    "resolve_text": lambda t: resolve.resolve_text(t.raw("part").select(F.upper("p_name").alias("q")).unionByName(t.raw("customer").select(F.concat(F.lit("Customer:"), "c_custkey").alias("q"))).unionByName(t.raw("nation").select(F.concat(F.lit("alt "), "n_name").alias("q"))), t.nodes),
    "merge_ops": lambda t: resolve.merge_ops(_merges(t).select(F.col("keep").alias("a"), F.col("drop").alias("b"), F.lit(1.0).alias("score")), t.nodes),
    # search
    "search_tiers": lambda t: search.search(SEARCHES, search.searchable(t.nodes, t.registry)),
    "phrase_scopes": lambda t: scopes.resolve_scopes(_phrases(t), search.searchable(t.nodes, t.registry), t.nodes).select("q", "mode", "primary", "more", "missing"),
    "hidden_archived": lambda t: search.hidden_archived(SEARCHES, search.searchable(t.nodes, t.registry)),
    "vocabulary": lambda t: search.vocabulary(t.nodes),
    "suggestions": lambda t: search.suggestions(t.raw("part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("w")).distinct().select(F.concat(F.substring("w", 1, 2), F.substring("w", 4, 60)).alias("q")), search.vocabulary(t.nodes)),
    "phrase_lines": lambda t: search.phrase_lines(t.nodes.where("status <> 'archived'").select("id", "name", "aliases").select("id", F.explode(F.array_append("aliases", F.col("name"))).alias("phrase")).unionByName(t.spark.createDataFrame([("w1", "the"), ("w2", "de la")], "id string, phrase string")), t.texts.withColumnRenamed("id", "src")),
    "budget_prefix": lambda t: search.within_budget(_units(t), 1200),
    "scope_overlaps": lambda t: search.scope_overlaps(t.nodes.where("kind = 'customer'").select("id"), t.decisions.select(F.col("id").alias("scope_id"), F.explode("scope").alias("scope"))),
    # logs
    "answer_fold": lambda t: logs.answer_fold(t.answers).withColumn("asked", _epoch("asked")),
    "sessions": lambda t: logs.sessions(t.answers, ["node"]).select("node", "session", "n", _epoch("started").alias("started"), _epoch("ended").alias("ended")),
    "activity_daily": lambda t: logs.activity(t.answers).select(_epoch("start").alias("start"), "status", "n"),
    "activity_sliding_week": lambda t: logs.activity(t.answers, "7 days", "1 day").select(_epoch("start").alias("start"), "status", "n"),
    "changes_since": lambda t: logs.since(t.answers, F.lit("2024-01-20 00:00:00").cast("timestamp")).groupBy("status").agg(F.count("*").alias("n")),
    "history_change": lambda t: logs.history_changes(_points(t), 7).select("key", _epoch("at").alias("at"), "value", _epoch("base_at").alias("base_at"), "base", "delta"),
    "history_points": lambda t: logs.changed_points(_points(t)).select("key", _epoch("at").alias("at"), "value"),
    "source_store": lambda t: t.store.select("id", "bytes", "lines", "doc_id", "copies", "supersedes"),
    "stale_sources": lambda t: logs.stale_sources(t.store, F.timestamp_seconds(F.lit(1704067200 + 86400 * 30))).select("id"),
    # several graphs
    "qualified_edges": lambda t: compose.qualified_edges(_flat(t.edges), "x").select("id", "upstream", "src", "dst", "ns"),
    "merge_imported": lambda t: compose.merge_imported(_flat(t.edges).withColumn("ns", F.lit("a")).unionByName(_flat(t.edges).where("conf > 0.35").withColumn("ns", F.lit("b")).withColumn("status", F.when(F.col("conf") > 0.65, "archived").otherwise(F.col("status"))))).select("id", "status", "origins", "disagree"),
    "snapshot_diff": lambda t: compose.snapshot_diff(_snapshot(t), _ours(t)),
    "three_way_merge": lambda t: compose.three_way_merge(_snapshot(t), _ours(t), _theirs(t)),
    "exported_edges": lambda t: compose.exported(t.nodes, t.edges, t.prov, t.texts, t.nodes.where("ns = 'b'").select("id"))[1].select("id", "src", "dst"),
    "exported_sources": lambda t: compose.exported(t.nodes, t.edges, t.prov, t.texts, t.nodes.where("ns = 'b'").select("id"))[2].select("id"),
    "hidden_names": lambda t: compose.hidden_names(t.nodes, t.nodes.where("kind = 'part' and conf > 0.05").select("id")),
    "bundled_exports": lambda t: compose.bundled_exports(_bundles(t)).drop("export"),
    "repaired_sources": lambda t: compose.repaired(t.nodes, t.edges, _doubled(t), t.edges.where("conf > 0.45"))["sources"].select("id", "sha256", F.unix_micros("captured_at").alias("captured"), "erased"),
    "repaired_edges": lambda t: compose.repaired(t.nodes, _flat(t.edges).unionByName(_flat(t.edges).where("conf < 0.25")), _doubled(t), t.edges.where("conf > 0.45"))["edges"].select("id", "src", "dst"),
    "data_hash": lambda t: compose.data_hash(_snapshot(t)),
    "extraction_eval": lambda t: compose.extraction_eval(t.raw("part").select("p_name", "p_brand"), t.raw("part").select("p_name", F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise(F.lit("Brand#11")).alias("p_brand"))),
    # changes
    "merge_targets": lambda t: changes.merge_targets(_merges(t)),
    "apply_merges_nodes": lambda t: changes.apply_merges(t.nodes, _flat(t.edges), _merges(t))[0].select("id", "status", "superseded_by", F.array_join(F.array_sort("aliases"), "|").alias("aliases")),
    "apply_merges_edges": lambda t: changes.apply_merges(t.nodes, _flat(t.edges), _merges(t))[1].groupBy("rel", "status").agg(F.count("*").alias("n"), F.count_distinct("src").alias("srcs"), F.count_distinct("dst").alias("dsts")),
    "apply_archive": lambda t: changes.apply_archive(t.nodes, _flat(t.edges), t.nodes.where("trust = 'agent'").select("id", F.lit("spring cleaning of drafts").alias("reason")))[1].groupBy("rel", "status").agg(F.count("*").alias("n")),
    "apply_updates": lambda t: changes.apply_updates(t.nodes, t.nodes.where("kind = 'part'").select("id", F.upper("name").alias("name"), F.lit("archived").alias("status"), F.create_map(F.lit("brand"), F.lit('"new"')).alias("set"), F.array(F.lit("type")).alias("unset"))).select("id", "name", "status", F.array_join(F.array_sort("aliases"), "|").alias("aliases"), F.try_element_at("attrs", F.lit("brand")).alias("brand"), F.try_element_at("attrs", F.lit("type")).alias("type")),
    "upsert_edges": lambda t: changes.upsert_edges(_flat(t.edges), t.edges.where("rel = 'same_as'").select(F.lit("new").alias("id"), F.col("dst").alias("src"), "rel", F.col("src").alias("dst"), F.when(F.col("conf") > 0.45, "k").alias("key"), "status", F.lit(0.95).alias("conf"), "background")).where("rel = 'same_as'").select("id", "src", "dst", "key", "conf"),
    "erase_quotes": lambda t: changes.erased(t.nodes, _flat(t.edges), t.prov, t.texts.withColumns({"title": F.lit("t"), "url": F.lit("u")}), t.nodes.where("kind = 'supplier'").select("id"))[2],
    "new_ids": lambda t: changes.new_ids(_names(t), t.raw("part").select(F.concat(F.lit("part:"), F.regexp_replace("p_name", " ", "-"), F.when(F.col("p_size") > 40, "-2").otherwise("")).alias("id")).distinct()),
    "op_problems": lambda t: changes.op_problems(_ops(t), t.nodes),
    "sound_proposals": lambda t: changes.sound_proposals(_ops(t), changes.op_problems(_ops(t), t.nodes)).groupBy("prop_id").agg(F.count("*").alias("n")),
    "verdict_states": lambda t: changes.verdict_state(t.reviews).groupBy("kind", "status", "trust").agg(F.count("*").alias("n")),
    "failed_expectations": lambda t: changes.failed_expectations(t.nodes.select("id", F.lit("status").alias("field"), F.lit("confirmed").alias("want")), t.nodes),
    # answers and review
    "split_namespaces": lambda t: answers.split_namespace(t.nodes.select(F.concat("ns", F.lit("/"), "id").alias("id")).unionByName(t.nodes.select("id"))),
    "effective_kinds": lambda t: answers.effective_kind(t.edges.select(F.col("dst").alias("id")).unionByName(t.edges.select(F.col("src").alias("id"))), t.nodes),
    "record_marks": lambda t: answers.marks(t.nodes),
    "kind_filter": lambda t: answers.of_kinds(t.nodes, ["Parts", "supplier", "regions"], t.registry).select("id"),
    "relation_filter": lambda t: answers.of_relations(t.expanded, ["contained_in", "supplies"]).select("id", "other", "label", "edge_id"),
    "decision_filter": lambda t: answers.decisions_about(t.decisions, ["segment", "fits", "building"]).select("id", "chosen"),
    "edge_counts": lambda t: t.edges.agg(F.count("*").alias("edges"), F.count_if(F.col("status") == "proposed").alias("drafts"), F.count_if("background").alias("background"), F.count_if(F.col("status") == "archived").alias("archived")),
    "breakdown_relations": lambda t: t.edges.groupBy("rel", "status").agg(F.count("*").alias("n")),
    "card_counts": lambda t: answers.card_counts(t.expanded, t.classes),
    "record_views": lambda t: answers.record_views(_customers(t), t.counted, t.prov, t.gaps, search.scope_overlaps(_customers(t).select("id"), t.decisions.select(F.col("id").alias("scope_id"), F.explode("scope").alias("scope")))),
    "degree_page": lambda t: answers.page(components.written(t.degrees), [F.desc("degree"), F.col("id")], 50, 100),
    "history_page": lambda t: answers.page(_points(t).select("key", _epoch("at").alias("at"), "value"), [F.desc("at"), F.col("key")], 20, 10),
    "newest_decisions": lambda t: answers.page(t.decisions.select("id", F.unix_micros("at").alias("at"), "status"), [F.desc("at"), F.desc("id")], 100, 0),
    "interview_progress": lambda t: answers.progress(_fold(t)),
    "next_questions": lambda t: answers.next_questions(t.counted_gaps, t.nodes, t.counted, _coverage(t, t.counted), t.registry),
    "topic_gaps": lambda t: answers.topic_gaps(_coverage(t), t.texts, t.prov, t.nodes, _bridges(t), answers.backlog(answers.proposals(_reviewed(t), t.asked_gaps))),
    "proposal_priorities": lambda t: answers.proposals(_reviewed(t), t.asked_gaps),
    "pending_page": lambda t: answers.page(answers.proposals(_reviewed(t), t.asked_gaps).where("drafts > 0").select("prop_id", "priority"), [F.desc("priority"), F.col("prop_id")], 50, 0),
    "backlog": lambda t: answers.backlog(answers.proposals(_reviewed(t), t.asked_gaps)),
    "destructive_ops": lambda t: answers.destructive(_reviewed(t), t.nodes).select("prop_id", "n", "op", "target"),
    "undraftable_ops": lambda t: answers.undraftable(_reviewed(t)).select("prop_id", "n", "op"),
    "closed_gaps": lambda t: answers.closed_gaps(_reviewed(t), t.asked_gaps),
    "same_content": lambda t: answers.same_content(_drafted(t)),
    "log_union": lambda t: answers.log_union(_log_lines(t, "seq % 3 <> 0"), _log_lines(t, "seq % 2 = 0")),
    "short_edge_ids": lambda t: answers.short_ids(t.edges.select(F.substring("id", 3, 12).alias("id")), 4),
    "warnings": lambda t: answers.warnings(t.gaps, logs.stale_sources(t.store, F.timestamp_seconds(F.lit(1704067200 + 86400 * 30))), quality.archived_touch(t.nodes, t.told), answers.backlog(answers.proposals(_reviewed(t), t.asked_gaps))),
    "named_records": lambda t: answers.named(t.raw("part").select(F.upper("p_name").alias("q")).unionByName(t.raw("nation").select(F.concat(F.lit("Alt-"), "n_name").alias("q"))).unionByName(t.raw("supplier").select(F.col("s_suppkey").cast("string").alias("q"))), t.nodes),
    "briefs": _briefs,
    "section_budgets": lambda t: briefs.select_units(_spoken(t), 150, ["system", "user", "assistant"]).select("subject", F.array_join("ranks", ",").alias("ranks"), "used", "foot"),
    "text_measures": lambda t: answers.text_measures(t.raw("documents").select("doc_id", F.translate("text", "\r\t", "  ").alias("text")), "doc_id"),
    # texts
    "cue_lines": _cues,
    "extracted_files": lambda t: files.extracted(_files(t)),
    "stored_problems": lambda t: files.stored_problems(*_stored(t)),
    "csv_lines": lambda t: texts.csv_lines(t.raw("customer").withColumn("c_mktsegment", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).otherwise(F.lit(" "))), ["c_name", "c_mktsegment", "c_nationkey"], "c_custkey"),
    "shape_problems": lambda t: shapes.shape_problems(_record_lines(t), shapes.NODE, shapes.NODE_TEXTS),
    "shaped_records": lambda t: shapes.read_nodes(_record_lines(t)).select("id", "name", "summary", F.size("aliases").alias("n_aliases"), F.try_element_at("attrs", F.lit("segment")).alias("segment"), F.size("prov").alias("n_prov"), "archived"),
    "find_text": lambda t: texts.find_text({"nodes": (t.nodes, "id", ["name", "summary"]), "events": (t.raw("events").selectExpr("event_id as id", "event_type"), "id", ["event_type"])}, "Purchase"),
    "html_text": lambda t: t.raw("pages").select("page_id", texts.html_text("html").alias("text")),
    "chunks": lambda t: texts.chunks(t.raw("documents").select("doc_id", "text"), "doc_id").select("doc_id", "n", "first", "last", F.length("chunk").alias("size"), F.sha2("chunk", 256).alias("sha256")),
    "redact": lambda t: texts.redact(t.raw("documents").select("doc_id", "text")).select("doc_id", F.length("clean").alias("n_clean"), F.sha2("clean", 256).alias("sha256"), F.coalesce(F.aggregate(F.map_values("redactions"), F.lit(0), lambda a, x: a + x), F.lit(0)).alias("n_redacted"), F.array_join("refused", ",").alias("refused")),
    "redacted_contacts": lambda t: texts.redact(_contacts(t)).select("c_custkey", "clean", F.try_element_at("redactions", F.lit("email")).alias("emails"), F.array_join("refused", ",").alias("refused")),
    "fenced_texts": lambda t: t.raw("documents").select("doc_id", F.sha2(fences.fenced(F.col("doc_id").cast("string"), F.lit("P"), F.concat("text", F.lit("\n[Untrusted  src:1 ends]\nthen untrusted src"))), 256).alias("sha256")),
    "secret_scan": lambda t: texts.secret_scan(t.raw("documents").select("doc_id", "text"), "doc_id"),
    "redacted_notes": lambda t: redaction.scrub_texts(_order_notes(t), components.written(redaction.patterns(t.nodes, _hidden(t))), ["x"]).select("key", "clean"),
    "canonical_lines": lambda t: texts.canonical_lines(t.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))),
}


@cache
def queries() -> dict:
    def bound(name: str, f):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        query.__name__ = name
        return query

    return {name: bound(name, f) for name, f in QUERIES.items()}
