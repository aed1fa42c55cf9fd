"""Streaming forms of batch operators; each equals its batch twin on the same rows."""
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evigraph.functions import scalars as S
from evigraph.operators.quality import quote_check


def stored_once(documents: DataFrame, horizon: str = "7 days") -> DataFrame:
    """Incoming documents (captured_at, text) once for each hash within a horizon."""
    hashed = documents.withColumn("sha256", F.sha2(S.normal_text("text"), 256))
    return hashed.withWatermark("captured_at", horizon).dropDuplicatesWithinWatermark(["sha256"])


def answer_sessions(answers: DataFrame, gap: str = "3 hours", late: str = "1 hour") -> DataFrame:
    """(node, started, ended, n): sessions of answers by node; lines later than ``late`` are left out."""
    grouped = answers.withWatermark("at", late).groupBy(F.session_window("at", gap).alias("w"), "node").agg(F.count("*").alias("n"))
    return grouped.select("node", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def activity(log: DataFrame, window: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    counted = log.withWatermark("at", late).groupBy(F.window("at", window, slide).alias("w"), "status").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "status", "n")


def latest_answers(answers: DataFrame) -> DataFrame:
    """(q, node, status, seq, skips): the fold of answer logs as state; a line older than the state's adds its skip only."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, firm, skips = state.get if state.exists else ((None, None, None), (None, None, None), 0)
        for rows in parts:
            for at, seq, status in sorted(zip(rows["at"], rows["seq"], rows["status"], strict=True)):
                line = (at.value, int(seq), status)
                skips += status == "skipped"
                if last[0] is None or line[:2] > tuple(last[:2]):
                    last = line
                if status not in ("skipped", "later") and (firm[0] is None or line[:2] > tuple(firm[:2])):
                    firm = line
        state.update((last, firm, skips))
        now = firm if firm[2] == "answered" else last
        yield pd.DataFrame({"q": [key[0]], "node": [key[1]], "status": [now[2]], "seq": [now[1]], "skips": [skips]})

    line = "struct<at:long,seq:long,status:string>"
    return answers.groupBy("q", "node").applyInPandasWithState(fold, "q string, node string, status string, seq long, skips long", f"last {line}, firm {line}, skips long", "update", GroupStateTimeout.NoTimeout)


def changed_points(points: DataFrame) -> DataFrame:
    """(key, at, value): measurements that differ from the one before, by key; the last is the state."""

    def changed(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        known, out = state.exists, []
        for rows in parts:
            for at, value in sorted(zip(rows["at"], rows["value"], strict=True)):
                if not known or value != last:
                    out.append((key[0], at, value))
                known, last = True, value
        state.update((last,))
        yield pd.DataFrame(out, columns=["key", "at", "value"])

    return points.groupBy("key").applyInPandasWithState(changed, "key string, at timestamp, value double", "value double", "append", GroupStateTimeout.NoTimeout)


def verified_quotes(prov: DataFrame, texts: DataFrame) -> DataFrame:
    """Quotes of incoming provenance against the stored texts."""
    return quote_check(prov, texts)


def stale_alerts(captured: DataFrame, late: str = "0 seconds") -> DataFrame:
    """(chain, id, at, state): ``stale`` once a source's days are over and nothing has superseded it, ``fresh`` when a later text of its chain does so afterwards.

    captured: (kind, title, url, captured_at, stale_after_days, text); a chain is a url, else kind and title.  The state of a chain is its latest source; an
    event-time timer at its capture and its days raises the alert, and a source that supersedes it sets the timer anew.  What comes later than ``late`` is
    dropped; the last row of an id is its state, as ``logs.stale_sources`` has it at that moment.
    """
    text = S.normal_text("text")
    chain = F.coalesce("url", F.concat_ws("\x1f", "kind", "title")).alias("chain")
    rows = captured.select(chain, F.concat(F.lit("src-"), F.substring(F.sha2(text, 256), 1, 12)).alias("id"), "captured_at", F.coalesce("stale_after_days", F.lit(0)).cast("long").alias("days"))
    day = 86_400_000

    def follow(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, id_, days, alerted = state.get if state.exists else (None, None, 0, False)
        out = []
        if state.hasTimedOut:
            out.append((key[0], id_, pd.Timestamp(at + days * day, unit="ms"), "stale"))
            alerted = True
        for part in parts:
            for when, new, its_days in sorted(zip(part["captured_at"], part["id"], part["days"], strict=True)):
                when = when.value // 1_000_000
                if new == id_ or (at is not None and (when, new) < (at, id_)):
                    continue  # the first capture of a text counts; an older source is superseded already
                if alerted:
                    out.append((key[0], id_, pd.Timestamp(when, unit="ms"), "fresh"))
                at, id_, days, alerted = when, new, int(its_days), False
        state.update((at, id_, days, alerted))
        if days > 0 and not alerted:
            due = at + days * day
            if due > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(due)
            else:  # over already, by the time that the stream has reached
                out.append((key[0], id_, pd.Timestamp(due, unit="ms"), "stale"))
                state.update((at, id_, days, True))
        yield pd.DataFrame(out, columns=["chain", "id", "at", "state"])

    keyed = rows.withWatermark("captured_at", late).groupBy("chain")
    return keyed.applyInPandasWithState(follow, "chain string, id string, at timestamp, state string", "at long, id string, days long, alerted boolean", "append", GroupStateTimeout.EventTimeTimeout)
