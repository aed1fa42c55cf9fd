"""Append-only logs: answer folds, sessions, changes over time, source stores, staleness."""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.functions import scalars as S


def answer_fold(log: DataFrame) -> DataFrame:
    """(q, node, status, seq, skips, asked): the state of each question at each node.

    A line replaces the state unless it is ``skipped`` or ``later`` and the state is ``answered``: the
    last other line wins if it is an answer, else the last line at all.  Pure aggregates.
    """
    order = F.struct("at", "seq")
    firm = ~F.col("status").isin("skipped", "later")
    line = F.struct("at", "seq", "status")
    rows = log.groupBy("q", "node").agg(F.max_by(line, order).alias("last"), F.max_by(F.when(firm, line), F.when(firm, order)).alias("firm"), F.count_if(F.col("status") == "skipped").alias("skips"), F.max("at").alias("asked"))
    wins = F.when(F.col("firm.status") == "answered", F.col("firm")).otherwise(F.col("last"))
    return rows.select("q", "node", wins["status"].alias("status"), wins["seq"].alias("seq"), "skips", "asked")


def sessions(log: DataFrame, by: list[str], gap_hours: int = 3) -> DataFrame:
    """(by..., session, n, started, ended): a pause of more than ``gap_hours`` opens a new session."""
    w = Window.partitionBy(*by).orderBy("at", "seq")
    new = F.coalesce((F.unix_micros("at") - F.unix_micros(F.lag("at").over(w)) > gap_hours * 3_600_000_000).cast("long"), F.lit(1))
    return log.withColumn("_new", new).withColumn("session", F.sum("_new").over(w)).groupBy(*by, "session").agg(F.count("*").alias("n"), F.min("at").alias("started"), F.max("at").alias("ended"))


def activity(log: DataFrame, window: str = "1 day", slide: str | None = None) -> DataFrame:
    """(start, status, n): lines by time window."""
    return log.groupBy(F.window("at", window, slide).alias("w"), "status").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "status", "n")


def since(log: DataFrame, moment: Column) -> DataFrame:
    """Lines at or after a moment; the comparison reaches the scan."""
    return log.where(F.col("at") >= moment)


def history_changes(points: DataFrame, days: int) -> DataFrame:
    """(key, at, value, base_at, base, delta): the latest point against the baseline near ``days`` before it.

    Candidates are at least days / 2 older; the nearest to the target wins, the older of two as near.
    points: (key, at, value).
    """
    known = points.where("value is not null")
    last = known.groupBy("key").agg(F.max_by(F.struct("at", "value"), "at").alias("l")).select("key", F.col("l.at").alias("last_at"), F.col("l.value").alias("last_value"))
    micros = 86_400_000_000
    # The join is on the key; the time bound filters it.
    past = known.join(last, "key").where(F.unix_micros("last_at") - F.unix_micros("at") >= days * micros / 2)
    off = F.abs(F.unix_micros("last_at") - days * micros - F.unix_micros("at"))
    base = past.groupBy("key").agg(F.min(F.struct(off.alias("off"), "at", "value")).alias("b"))
    return last.join(base, "key").select("key", F.col("last_at").alias("at"), F.col("last_value").alias("value"), F.col("b.at").alias("base_at"), F.col("b.value").alias("base"), F.round(F.col("last_value") - F.col("b.value"), 6).alias("delta"))


def changed_points(points: DataFrame) -> DataFrame:
    """Points that differ from the one before them, or are the first, by key."""
    before = F.lag("value").over(Window.partitionBy("key").orderBy("at"))
    first = F.row_number().over(Window.partitionBy("key").orderBy("at")) == 1
    return points.withColumn("_b", before).withColumn("_f", first).where(F.col("_f") | ~F.col("value").eqNullSafe(F.col("_b"))).drop("_b", "_f")


def source_store(captured: DataFrame) -> DataFrame:
    """(id, sha256, bytes, lines, doc_id, captured_at, stale_after_days, copies, supersedes): each text once, under its hash.

    Of equal texts the first captured stays; a source with the url (else kind and title) of an
    earlier one with another text supersedes the latest such.
    """
    text = S.normal_text("text")
    # The text stays behind: only its hash, size and line count are shuffled.
    rows = captured.select("doc_id", "kind", "title", "url", "captured_at", "stale_after_days", F.sha2(text, 256).alias("sha256"), F.octet_length(text).cast("long").alias("bytes"), F.when(F.length(text) == 0, 0).otherwise(F.size(F.split(text, "\n")) - 1).cast("long").alias("lines"))
    cols = [c for c in rows.columns if c != "sha256"]
    kept = rows.groupBy("sha256").agg(F.min_by(F.struct(*cols), F.struct("captured_at", "doc_id")).alias("s"), F.count("*").alias("copies")).select("sha256", "s.*", "copies").withColumn("id", F.concat(F.lit("src-"), F.substring("sha256", 1, 12)))
    chain = F.coalesce(F.col("url"), F.concat_ws("\x1f", "kind", "title"))
    before = F.lag("id").over(Window.partitionBy(chain).orderBy("captured_at", "id"))
    return kept.withColumn("supersedes", before).select("id", "sha256", "bytes", "lines", "doc_id", "captured_at", "stale_after_days", "copies", "supersedes")


def stale_sources(store: DataFrame, now: Column) -> DataFrame:
    """Sources past their days and not superseded."""
    replaced = store.where("supersedes is not null").select(F.col("supersedes").alias("id")).distinct()
    due = F.timestamp_seconds(F.unix_micros("captured_at") / 1_000_000 + F.col("stale_after_days") * 86400)
    return store.where((F.col("stale_after_days") > 0) & (due < now)).join(replaced, "id", "left_anti")
