"""Briefs: ranked units of text about each subject, fitted into a budget of tokens."""
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions import scalars as S
from evigraph.operators.components import written

CHARS_PER_TOKEN = 4
#: Groups that a footer names; the rest is one number.
NAMED = 3
MOST_QUOTES, MOST_GAPS, PER_LINE, MOST_LABELS, SUMMARY = 3, 6, 8, 5, 100
SECTIONS = ["primary", "decisions", "quotes", "gaps", "related", "bridges"]


def footer(left: Column, sections: list[str], budget: int) -> Column:
    """``left out to fit N tokens: 3 gaps; 2 related; 4 more`` of counts in the order of ``sections``; empty if nothing is left out."""
    names = F.array(*[F.lit(s) for s in sections])
    groups = F.filter(F.zip_with(left, names, lambda n, s: F.struct(n.alias("n"), s.alias("s"))), lambda g: g["n"] > 0)
    told = F.transform(F.slice(groups, 1, NAMED), lambda g: F.concat(g["n"].cast("string"), F.lit(" "), g["s"]))
    rest = F.aggregate(F.slice(groups, NAMED + 1, len(sections)), F.lit(0).cast("long"), lambda a, g: a + g["n"])
    more = F.when(rest > 0, F.array(F.concat(rest.cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(groups) == 0, "").otherwise(F.concat(F.lit(f"left out to fit {budget} tokens: "), F.array_join(F.concat(told, more), "; ")))


def _let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once, however often it is named."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _fitted(budget: int, sections: list[str], head: int) -> Column:
    """(used, stops, halt, left) of ``_units`` in order and ``_left``: characters used, the first rank of each section that did not fit, the rank that ended all, counts left.

    The footer is spelt only where a unit could fit without it and not with the longest there is.
    """
    limit = budget * CHARS_PER_TOKEN
    longest = len(f"left out to fit {budget} tokens: ") + NAMED * (23 + max(map(len, sections), default=0)) + 27
    stop = "array<struct<section:int,rank:bigint>>"
    start = F.struct(F.lit(head).cast("long").alias("used"), F.array().cast(stop).alias("stops"), F.lit(None).cast("long").alias("halt"), F.col("_left").alias("left"))

    def take(acc: Column, u: Column) -> Column:
        skip = acc["halt"].isNotNull() | F.exists(acc["stops"], lambda s: s["section"] == u["section"])
        used = acc["used"] + u["size"]
        less = F.transform(acc["left"], lambda n, i: F.when(i == u["section"], n - u["count"]).otherwise(n))

        def judged(left: Column) -> Column:
            foot = _let(F.length(footer(left, sections, budget)), lambda n: F.when(n > 0, n + 1).otherwise(0))
            fits = F.when(used > limit, False).when(used + longest <= limit, True).otherwise(used + foot <= limit)
            refused = F.struct(
                acc["used"].alias("used"), F.array_append(acc["stops"], F.struct(u["section"].alias("section"), u["rank"].alias("rank"))).cast(stop).alias("stops"),
                F.when(u["essential"], u["rank"]).alias("halt"), acc["left"].alias("left"),
            )
            return F.when(fits, F.struct(used.alias("used"), acc["stops"].alias("stops"), acc["halt"].alias("halt"), left.alias("left"))).otherwise(refused)

        return F.when(skip, acc).otherwise(_let(less, judged))

    return F.aggregate("_units", start, take)


def _taken(fit: Column, u: Column) -> Column:
    """Whether the unit was taken: it stands before what ended all, and before what ended its section."""
    after = F.exists(fit["stops"], lambda s: ((s["section"] == u["section"]) & (u["rank"] >= s["rank"])) | (s["rank"] == u["rank"]))
    return (fit["halt"].isNull() | (u["rank"] < fit["halt"])) & ~F.coalesce(after, F.lit(False))


def _foot(fit: Column, budget: int, sections: list[str]) -> Column:
    """The footer, or how many items are left out where it does not fit itself."""
    whole = footer(fit["left"], sections, budget)
    items = F.aggregate(fit["left"], F.lit(0).cast("long"), lambda a, n: a + n)
    short = F.concat(F.lit(f"left out to fit {budget} tokens: "), items.cast("string"), F.lit(" items"))
    return _let(whole, lambda w: F.when((w != "") & (fit["used"] + F.length(w) + 1 > budget * CHARS_PER_TOKEN), short).otherwise(w))


def _listed_units(units: DataFrame, limit: int, sections: list[str], *more: str) -> DataFrame:
    """(subject, _units, _left): a subject's units in order of rank, and how many items each section has; no more units of a section than ``limit`` characters fit (0: all)."""
    number = F.array_position(F.array(*[F.lit(s) for s in sections]), F.col("section")) - 1
    rows = units.select("subject", F.col("rank").cast("long"), number.cast("int").alias("section"), F.col("size").cast("long"), "essential", F.col("count").cast("long"), *more)
    unit = F.struct("rank", "section", "size", "essential", "count", *more)
    count = lambda k: F.coalesce(F.sum(F.when(F.col("section") == k, F.col("count"))), F.lit(0)).alias(f"_t{k}")
    if limit:
        front = Window.partitionBy("subject", "section").orderBy("rank")
        rows, unit = rows.withColumn("_n", F.row_number().over(front)), F.when(F.col("_n") <= limit + 1, unit)
    found = rows.groupBy("subject").agg(F.array_sort(F.collect_list(unit)).alias("_units"), *[count(k) for k in range(len(sections))])
    return found.select("subject", "_units", F.array(*[F.col(f"_t{k}") for k in range(len(sections))]).alias("_left"))


def select_units(units: DataFrame, budget: int, sections: list[str], head: int = 0) -> DataFrame:
    """(subject, ranks, used, left, foot): the units of each subject that fit ``budget`` tokens (0: all), taken by rank.

    units: (subject, rank, section, size, essential, count), size in characters with their line ends.  A unit that does not fit, with the footer
    that would then stand, ends its section; an essential one ends everything.  This is a fold, which no window expresses: it runs as one
    ``aggregate`` over a subject's units.  A section is taken from its front, so no more units of it are gathered than characters fit.
    """
    lists = _listed_units(units, budget * CHARS_PER_TOKEN, sections)
    if not budget:
        used = F.aggregate("_units", F.lit(head).cast("long"), lambda a, u: a + u["size"])
        none = F.transform("_left", lambda _: F.lit(0).cast("long"))
        return lists.select("subject", F.transform("_units", lambda u: u["rank"]).alias("ranks"), used.alias("used"), none.alias("left"), F.lit("").alias("foot"))
    done = lists.withColumn("r", _fitted(budget, sections, head))
    ranks = F.transform(F.filter("_units", lambda u: _taken(F.col("r"), u)), lambda u: u["rank"])
    return done.select("subject", ranks.alias("ranks"), "r.used", "r.left", _foot(F.col("r"), budget, sections).alias("foot"))


def fitted_texts(units: DataFrame, budgets: int | list[int], sections: list[str]) -> DataFrame:
    """(subject, budget, taken, text, tokens): the lines of the units that fit, in order of rank, and the footer.  units: see ``select_units``, with text.

    A subject's units are gathered once, with their texts, for all budgets.
    """
    each = [budgets] if isinstance(budgets, int) else list(budgets)
    out = _listed_units(units, 0 if 0 in each else max(each) * CHARS_PER_TOKEN, sections, "text")
    for budget in filter(None, each):
        out = out.withColumn(f"_r{budget}", _fitted(budget, sections, 0))

    def brief(budget: int) -> Column:
        fit = F.col(f"_r{budget}")
        kept = F.transform(F.filter("_units", lambda u: _taken(fit, u)) if budget else F.col("_units"), lambda u: u["text"])
        foot = _foot(fit, budget, sections) if budget else F.lit("")
        # No line but the footer: then nothing goes before it.
        text = lambda k: F.concat_ws("\n", F.when(F.size(k) > 0, F.array_join(k, "\n")), _let(foot, lambda f: F.when(f != "", f)))
        return _let(kept, lambda k: F.struct(F.lit(budget).alias("budget"), F.size(k).cast("long").alias("taken"), text(k).alias("text")))

    rows = out.select("subject", F.explode(F.array(*[brief(b) for b in each])).alias("_b")).select("subject", "_b.*")
    return rows.withColumn("tokens", S.estimated_tokens(F.col("text")).cast("long"))


def _numbered(rows: DataFrame, tier: int, order: list[Column | str]) -> DataFrame:
    """``rows`` (subject, section, text, ...) with a rank: its tier, then its place in ``order``."""
    place = F.row_number().over(Window.partitionBy("subject").orderBy(*order))
    count = F.col("count") if "count" in rows.columns else F.lit(1)
    return rows.withColumn("rank", F.lit(tier * 10**9).cast("long") + place).select("subject", "rank", "section", "text", count.cast("long").alias("count"))


def _listed(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Lines of up to ``PER_LINE`` values of each key, in order: keys, line, ids, count."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(value)) - 1
    cut = rows.withColumn("_line", F.floor(place / PER_LINE))
    return cut.groupBy(*keys, "_line").agg(F.array_join(F.array_sort(F.collect_list(value)), ", ").alias("ids"), F.count("*").alias("count"))


def brief_units(subjects: DataFrame, nodes: DataFrame, expanded: DataFrame, prov: DataFrame, gaps: DataFrame, scopes: DataFrame, decisions: DataFrame, hubs: DataFrame) -> DataFrame:
    """(subject, rank, section, text, size, essential, count) of what a brief of each subject (id) may say, in the order it is taken.

    The record itself; its active decisions, newest first; its first quote; its gaps, most severe first; what is linked to it; links to other
    namespaces; what is two links away, not by way of a hub or a background link; further quotes.  scopes: (id, scope_id) of decisions.
    """
    who = subjects.select(F.col("id").alias("subject")).distinct()
    own = who.join(nodes, F.col("subject") == F.col("id"))
    ends = expanded.where("not background").join(who, F.col("id") == F.col("subject"))
    links = written(ends.groupBy("subject", "label", "other").agg(F.min(F.struct("edge_id", "direction", "rel")).alias("e")).select("subject", "label", "other", "e.*"))
    by_label = links.groupBy("subject", "label").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("other")).alias("_few"))
    # Labels of up to two neighbours name them, others count them; the first labels only.
    named = by_label.withColumn("_k", F.row_number().over(Window.partitionBy("subject").orderBy("label")))
    told = F.concat("label", F.lit(" "), F.when(F.col("n") <= 2, F.array_join(F.slice("_few", 1, 2), ", ")).otherwise(F.col("n").cast("string")))
    rels = named.groupBy("subject").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_k") <= MOST_LABELS, F.struct("_k", told.alias("t"))))), lambda x: x["t"]), "; ").alias("_rels"), F.count("*").alias("_labels")
    )
    cited = prov.select(F.col("record_id").alias("subject"), "src").distinct().groupBy("subject").agg(F.array_sort(F.collect_list("src")).alias("_src"))
    needs = gaps.join(who, F.col("id") == F.col("subject")).select("subject", "gap", "detail", "severity")
    ordered = written(needs.withColumn("_k", F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("severity"), "gap", "detail"))))
    top = ordered.where("_k <= 2").groupBy("subject").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "gap"))), lambda x: x["gap"]), ", ").alias("_needs"))
    attrs = F.array_join(F.transform(F.array_sort(F.map_entries("attrs")), lambda a: F.concat(a["key"], F.lit("="), a["value"])), "; ")
    sources = F.when(F.col("_src").isNull(), "no sources").otherwise(F.concat(F.size("_src").cast("string"), F.when(F.size("_src") == 1, " source: ").otherwise(" sources: "), F.array_join(F.slice("_src", 1, 2), ", "), F.when(F.size("_src") > 2, F.concat(F.lit(" +"), (F.size("_src") - 2).cast("string"), F.lit(" more"))).otherwise("")))
    more_labels = F.when(F.col("_labels") > MOST_LABELS, F.concat(F.lit("; +"), (F.col("_labels") - MOST_LABELS).cast("string"), F.lit(" more labels"))).otherwise("")
    head = F.concat_ws(
        " | ", F.concat("subject", F.lit("  "), "kind", F.lit(", "), "status", F.lit(", conf "), F.col("conf").cast("string")), F.nullif(attrs, F.lit("")), F.concat("_rels", more_labels), sources, F.concat(F.lit("needs: "), "_needs")
    )
    summary = F.when(S.is_summary(F.col("summary")), S.truncated(F.col("summary"), SUMMARY)).otherwise("no summary")
    primary = own.join(rels, "subject", "left").join(cited, "subject", "left").join(top, "subject", "left").select("subject", F.lit("primary").alias("section"), F.concat(head, F.lit("\n  "), summary).alias("text"))
    units = [_numbered(primary, 0, ["text"])]

    active = scopes.select(F.col("id").alias("subject"), F.col("scope_id").alias("id")).join(who, "subject").join(decisions.where("status = 'active'").select("id", "at", "question", "chosen"), "id")
    units.append(_numbered(active.select("subject", F.lit("decisions").alias("section"), F.concat(F.lit("decision "), "id", F.lit(": "), "question", F.lit(" -> "), "chosen").alias("text"), "at", "id"), 1, [F.desc("at"), F.desc("id")]))

    quotes = prov.where("quote IS NOT NULL AND trim(quote) <> ''").join(who, F.col("record_id") == F.col("subject")).withColumn("_k", F.row_number().over(Window.partitionBy("subject").orderBy("ord", "src", "loc")))
    line = F.concat(F.lit("quote "), "subject", F.lit(': "'), "quote", F.lit('" ('), "src", F.lit(" "), "loc", F.lit(")"))
    said = quotes.where(F.col("_k") <= MOST_QUOTES).select("subject", F.lit("quotes").alias("section"), line.alias("text"), "_k")
    rest = quotes.where(F.col("_k") > MOST_QUOTES).groupBy("subject").agg(F.count("*").alias("count")).select("subject", F.lit("quotes").alias("section"), F.concat(F.lit("quotes: +"), F.col("count").cast("string"), F.lit(" more")).alias("text"), "count")
    units += [_numbered(said.where("_k = 1"), 2, ["_k"]), _numbered(said.where("_k > 1"), 7, ["_k"]), _numbered(rest, 8, ["text"])]

    gap_line = F.concat(F.lit("open: "), F.rtrim(F.concat_ws(" ", "gap", "detail")), F.lit(" ("), F.col("severity").cast("string"), F.lit(")"))
    open_ = ordered.where(F.col("_k") <= MOST_GAPS).select("subject", F.lit("gaps").alias("section"), gap_line.alias("text"), "_k")
    hidden = ordered.where(F.col("_k") > MOST_GAPS).groupBy("subject").agg(F.count("*").alias("count")).select("subject", F.lit("gaps").alias("section"), F.concat(F.lit("open: +"), F.col("count").cast("string"), F.lit(" more")).alias("text"), "count")
    units += [_numbered(open_, 3, ["_k"]), _numbered(hidden, 4, ["text"])]

    many = by_label.where("n > 2").select("subject", "label")
    one = _listed(links.join(many, ["subject", "label"]).select("subject", "label", "other"), ["subject", "label"], "other")
    units.append(_numbered(one.select("subject", F.lit("related").alias("section"), F.concat(F.lit("related 1 "), "label", F.lit(": "), "ids").alias("text"), "count", "label", "_line"), 5, ["label", "_line"]))

    ns = nodes.select("id", "ns")
    across = links.join(ns.select(F.col("id").alias("subject"), F.col("ns").alias("_a")), "subject").join(ns.select(F.col("id").alias("other"), F.col("ns").alias("_b")), "other").where("_a <> _b")
    arrow = F.concat(F.lit("bridge "), F.when(F.col("direction") == "out", F.col("subject")).otherwise(F.col("other")), F.lit(" -"), "rel", F.lit("-> "), F.when(F.col("direction") == "out", F.col("other")).otherwise(F.col("subject")))
    units.append(_numbered(across.select("subject", F.lit("bridges").alias("section"), arrow.alias("text"), "edge_id"), 6, ["edge_id", "text"]).withColumn("rank", F.col("rank") + 5 * 10**8 - 10**9))

    via = links.select("subject", F.col("other").alias("via")).distinct().join(hubs.select(F.col("id").alias("via")), "via", "left_anti")
    second = via.join(expanded.where("not background").select(F.col("id").alias("via"), "label", "other"), "via").where("other <> subject")
    near = links.select("subject", "other").distinct()
    chosen = second.join(near, ["subject", "other"], "left_anti").groupBy("subject", "other").agg(F.min(F.struct("label", "via")).alias("m")).select("subject", "other", "m.label", "m.via")
    vias = chosen.groupBy("subject", "label").agg(F.count_distinct("via").alias("_v"), F.min("via").alias("_one"))
    two = _listed(chosen, ["subject", "label"], "other").join(vias, ["subject", "label"])
    where = F.when(F.col("_v") == 1, F.concat(F.lit(" via "), "_one")).otherwise(F.concat(F.lit(" via "), F.col("_v").cast("string"), F.lit(" nodes")))
    units.append(_numbered(two.select("subject", F.lit("related").alias("section"), F.concat(F.lit("related 2 "), "label", where, F.lit(": "), "ids").alias("text"), "count", "label", "_line"), 6, ["label", "_line"]))

    out = reduce(lambda a, b: a.unionByName(b), units)
    return out.select("subject", "rank", "section", "text", (F.length("text") + 1).alias("size"), F.lit(True).alias("essential"), "count")
