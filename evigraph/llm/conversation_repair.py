"""Conversation structure repair by Wagner-Fischer alignment.

A conversation is well formed if the initials of its roles spell ``(s?(ua)+)?``.
Its turns are aligned with that grammar's strings.  Keep costs 0, a new role (user or
assistant) 2, delete 3, an inserted empty turn 2; blank and repeated turns must go, and a
truncated turn that stays adds 1.  All strings of one ending share the distances of
suffixes, so one table of suffix distances serves every feasible length; it is banded
after Ukkonen: a cell whose rows and letters left differ so much that deletes or inserts
alone would cost more than the incumbent, a plain pass from left to right, is left out.
Every length that reaches the least cost is traced back, and of all audits the least in
ASCII order is taken.

Conversations of up to ``most_turns`` turns are read from partitions sorted by
conversation and turn, one at a time.  Longer ones, whose table would grow with the
square of their turns, are never gathered: their rows are dealt into ranges, a
range's effect is a 4 x 4 table of least costs between states of the grammar, the tables
of a conversation are chained, and each range is then traced by itself.  Both ways give
the same audits.  Only the hash of a repaired conversation reads it in order in one
task, as a stream; SHA-256 allows nothing else.

Edge cases: null roles and texts are one blank; a null turn comes first; a null id is a
conversation of its own; equal turns are ordered by role and text; rows whose mark
``is_turn`` is false only name their conversation; a conversation without turns has
zeros, an empty audit and the hash of the empty string; an empty table gives no rows;
other columns are not carried.
"""
import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import ASCII_SPACE, durable

#: Turns of a conversation that one task aligns; a row of a longer one goes to a range of about this many rows.
MOST_TURNS, RANGE_ROWS = 2048, 100_000
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
LEGAL = {"su", "ua", "au"}
ROLE = {"u": "user", "a": "assistant"}
FAR = 1 << 40

COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
#: A turn's code: its role's initial (o: none of the grammar's), in capitals if truncated; x if it must go.
Turn = tuple[int | None, str, str]


def fault_of(role: str, text: str, seen: set[bytes]) -> str:
    """blank, duplicate, truncated or nothing; ``seen`` gets the turn."""
    key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
    again = key in seen
    seen.add(key)
    end = text.rstrip(ASCII_SPACE)[-1:]
    return "blank" if not end else "duplicate" if again else "" if end in ".!?" else "truncated"


def code_of(role: str, fault: str) -> str:
    if fault in ("blank", "duplicate"):
        return "x"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return initial.upper() if fault else initial


def incumbent(codes: str) -> int:
    """The cost of a pass from left to right: an upper bound."""
    cost, want, out = 0, "u", 0
    for c in codes:
        if c == "x":
            cost += DELETE
            continue
        cost += TRUNCATED * c.isupper()
        if c.lower() == "s" and not out:
            out = 1
            continue
        cost += REROLE * (c.lower() != want)
        want, out = "a" if want == "u" else "u", 2
    cost += INSERT if want == "a" else 2 * INSERT if out == 1 else 0
    return min(cost, DELETE * len(codes))


def suffix_distances(codes: str, most: int) -> tuple[np.ndarray, int]:
    """Distances of the turns from each place on to the last r letters of ``...uaua``: row i, column r - (turns left) + low, and low."""
    n, low, high = len(codes), most // DELETE, most // INSERT
    width = low + high + 1
    shift = np.arange(width) - low
    table = np.full((n + 1, width + 1), FAR, np.int64)
    table[n, :width] = np.where(shift >= 0, INSERT * shift, FAR)
    for i in range(n - 1, -1, -1):
        letters = n - i + shift
        best = table[i + 1, 1:] + DELETE
        c = codes[i]
        if c != "x":
            fits = (letters % 2 == 0) if c in "uU" else (letters % 2 == 1) if c in "aA" else np.zeros(width, bool)
            stay = table[i + 1, :width] + np.where(fits, 0, REROLE) + TRUNCATED * c.isupper()
            best = np.minimum(best, np.where(letters >= 1, stay, FAR))
        best = np.where(letters >= 0, best, FAR)
        table[i, :width] = np.minimum.accumulate(best - INSERT * shift) + INSERT * shift
        table[i, :width][letters < 0] = FAR
    return np.minimum(table, FAR), low


def traced(codes: str, table: np.ndarray, low: int, i: int, letters: int) -> str:
    """The ASCII-least audit of an alignment of the turns from i on with the last ``letters`` letters: edits come as D, I, K, R."""
    n, out = len(codes), []
    cell = lambda i, r: int(table[i, r - (n - i) + low]) if 0 <= r - (n - i) + low < table.shape[1] - 1 and r >= 0 else FAR
    while i < n or letters:
        here = cell(i, letters)
        if i < n and cell(i + 1, letters) + DELETE == here:
            out.append("D")
            i += 1
        elif letters and cell(i, letters - 1) + INSERT == here:
            out.append("I")
            letters -= 1
        else:
            out.append("K" if codes[i].lower() == ("a" if letters % 2 else "u") else "R")
            i, letters = i + 1, letters - 1
    return "".join(out)


def aligned(codes: str) -> tuple[int, str]:
    """The least cost and the least audit of that cost."""
    n, most = len(codes), incumbent(codes)
    table, low = suffix_distances(codes, most)
    at = lambda i, r: int(table[i, r - (n - i) + low]) if 0 <= r - (n - i) + low < table.shape[1] - 1 else FAR
    lengths = range(0, n + most // INSERT + 1, 2)
    # (cost, turns deleted before a system turn that opens, or -1; letters after it)
    ways = [(at(0, r), -1, r) for r in lengths]
    for i in range(min(n, most // DELETE + 1)):
        if codes[i] in "sS":
            ways += [(DELETE * i + TRUNCATED * (codes[i] == "S") + at(i + 1, r), i, r) for r in lengths[1:]]
    cost = min(w[0] for w in ways)
    audits = (traced(codes, table, low, 0, r) if i < 0 else "D" * i + "K" + traced(codes, table, low, i + 1, r) for c, i, r in ways if c == cost)
    return cost, min(audits)


class Aligner:
    """Alignments by code string, each made once while it is remembered."""

    def __init__(self, most: int = 100_000):
        self.most, self.known = most, {}

    def __call__(self, codes: str) -> tuple[int, str]:
        found = self.known.get(codes)
        if found is None:
            if len(self.known) >= self.most:
                self.known.clear()
            found = aligned(codes)
            if len(codes) <= 64:
                self.known[codes] = found
        return found


def repaired(turns: list[Turn], audit: str, state: int = 0) -> Iterator[tuple[str, int | None, str, str]]:
    """(edit, turn, role, text) of the turns that stay and those put in, from a state of the grammar on."""
    rest = iter(turns)
    for edit in audit:
        turn, role, text = (None, "", "") if edit == "I" else next(rest)
        if edit == "D":
            continue
        if edit == "K" and role[:1] == "s":
            state = 1
        else:
            state, letter = GOES[state]
            role = role if edit == "K" else ROLE[letter]
        yield edit, turn, role, text


def digest_of(turns: list[Turn], align: Aligner) -> tuple:
    """The columns of COUNTS for one conversation."""
    faults, seen = [], set()
    for _, role, text in turns:
        faults.append(fault_of(role, text, seen))
    cost, audit = align("".join(code_of(role, fault) for (_, role, _), fault in zip(turns, faults, strict=True)))
    known = {t for t, _, _ in turns if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in LEGAL for a, b in zip(turns, turns[1:], strict=False))
    text = "\n".join(f"{role}:{text}" for _, _, role, text in repaired(turns, audit))
    sha = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha


def turns_of(turns: list[Turn], align: Aligner) -> Iterator[tuple]:
    seen: set[bytes] = set()
    codes = "".join(code_of(role, fault_of(role, text, seen)) for _, role, text in turns)
    for place, (edit, turn, role, text) in enumerate(repaired(turns, align(codes)[1])):
        yield place, edit, turn, role, text


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[Turn]]]:
    """Conversations of a sorted partition, one at a time."""
    current, turns, begun = None, [], False
    for batch in batches:
        for conv, is_turn, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if begun and conv != current:
                yield current, turns
                turns = []
            current, begun = conv, True
            if is_turn:
                turns.append((turn, role, text))
    if begun:
        yield current, turns


def _each(rows: DataFrame, schema: str, made: Callable[[list[Turn], Aligner], Iterator[tuple]]) -> DataFrame:
    """``made`` of every conversation, with its id."""
    fields = [x.split() for x in f"conv_id long, {schema}".split(", ")]
    arrow = pa.schema([(name, pa.int64() if kind == "long" else pa.string()) for name, kind in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align, out, size = Aligner(), [], 0

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[] for _ in fields]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for conv, turns in _conversations(batches):
            for row in made(turns, align):
                out.append((conv, *row))
                size += len(row[-1])
                if len(out) >= 10_000 or size > 1 << 24:
                    yield batch()
                    out, size = [], 0
        yield batch()

    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return dealt.mapInArrow(run, f"conv_id long, {schema}")


# ---- conversations of any length: states of the grammar are 0 nothing yet, 1 after s, 2 after u, 3 after a

STATES = range(4)
#: The state after a user's or assistant's turn; a system turn leads from 0 to 1.
GOES = {0: (2, "u"), 1: (2, "u"), 2: (3, "a"), 3: (2, "u")}
#: What is left to pay behind the last turn.
ENDS = (0, 2 * INSERT, INSERT, 0)


def with_inserts(cost: list[int]) -> list[int]:
    """Costs to go, when turns may be put in first."""
    cost = list(cost)
    for _ in STATES:
        for s in STATES:
            cost[s] = min(cost[s], INSERT + cost[GOES[s][0]])
    return cost


def moves(code: str, s: int) -> Iterator[tuple[str, int, int]]:
    """(edit, cost, next state) of a turn met in state s."""
    yield "D", DELETE, s
    if code != "x":
        more = TRUNCATED * code.isupper()
        after, letter = GOES[s]
        if code in "sS" and s == 0:
            yield "K", more, 1
        if code.lower() == letter:
            yield "K", more, after
        yield "R", REROLE + more, after


def backward(codes: str, cost: list[int]) -> list[list[int]]:
    """Costs to go before each turn (turns may be put in there), given those behind the last."""
    out = [list(cost)]
    for code in reversed(codes):
        behind = out[-1]
        out.append(with_inserts([min(c + behind[t] for _, c, t in moves(code, s)) for s in STATES]))
    return out[::-1]


def range_costs(codes: str) -> list[list[int]]:
    """Least costs from each state before a range to each state behind its last turn."""
    columns = [backward(codes, [0 if s == t else FAR for s in STATES])[0] for t in STATES]
    return [[columns[t][s] for t in STATES] for s in STATES]


def range_trace(codes: str, state: int, cost: list[int]) -> tuple[str, int]:
    """The least audit of a range entered in ``state``, with ``cost`` to go behind it, and the state it leaves."""
    table, out = backward(codes, cost), []
    for i, code in enumerate(codes):
        while True:
            found = sorted((edit, t) for edit, c, t in moves(code, state) if c + table[i + 1][t] == table[i][state] < FAR)
            put_in = INSERT + table[i][GOES[state][0]] == table[i][state]
            if put_in and not (found and found[0][0] == "D"):
                out.append("I")
                state = GOES[state][0]
                continue
            edit, state = found[0]
            out.append(edit)
            break
    return "".join(out), state


def closing(state: int) -> str:
    """The turns put in behind the last turn."""
    return "I" * (ENDS[state] // INSERT)


def _conv() -> Column:
    """A conversation's id as text; no text is a null id."""
    return F.coalesce(F.col("conv_id").cast("string"), F.lit(""))


def _ranges_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with their place (conv, part, id, turn, role, text), and codes by place (conv, part, id, turn, fault, initial, code)."""
    spark = rows.sparkSession
    turns = rows.where("is_turn").select(_conv().alias("conv"), "turn", "role", "text")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(turns.count() / RANGE_ROWS))
    # Equal turns are told apart by any number, so that they too can be dealt into several ranges.
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text", "any"]
    ranged = turns.withColumn("any", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("any")
    placed = durable(ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id")))
    key = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    marked = placed.select("conv", "part", "id", "turn", key.alias("key"), F.substring("role", 1, 1).alias("initial"), F.regexp_extract("text", r"(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1).alias("end"))
    seen = marked.join(marked.groupBy("conv", "key").agg(F.min("id").alias("first")), ["conv", "key"])
    fault = F.when(F.col("end") == "", "blank").when(F.col("id") > F.col("first"), "duplicate").when(F.col("end").isin(".", "!", "?"), "").otherwise("truncated")
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    return placed, durable(seen.withColumn("fault", fault).select("conv", "part", "id", "turn", "fault", "initial", code.alias("code")))


def _costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each range, its table of costs and the joints inside it that break the grammar."""
    for batch in batches:
        initials = batch["initials"].to_pylist()
        yield pa.RecordBatch.from_arrays([
            batch["conv"], batch["part"], batch["codes"],
            pa.array([[c for row in range_costs(codes) for c in row] for codes in batch["codes"].to_pylist()], pa.list_(pa.int64())),
            pa.array([x[0] for x in initials]), pa.array([x[-1] for x in initials]),
            pa.array([sum(a + b not in LEGAL for a, b in zip(x, x[1:], strict=False)) for x in initials], pa.int64()),
        ], names=["conv", "part", "codes", "costs", "initial", "final", "illegal"])


def _chain(x: pd.DataFrame) -> pd.DataFrame:
    """Costs to go behind each range of a conversation, its cost, and the joints between ranges that break the grammar."""
    x = x.sort_values("part").reset_index(drop=True)
    tables = [np.array(c, np.int64).reshape(4, 4) for c in x["costs"]]
    behind = [np.array(ENDS)]
    for t in reversed(tables[1:]):
        behind.append(np.array(with_inserts((t + behind[-1]).min(axis=1).tolist())))
    behind.reverse()
    joints = sum(a + b not in LEGAL for a, b in zip(x["final"], x["initial"].iloc[1:], strict=False))
    first, last = np.arange(len(x)) == 0, np.arange(len(x)) == len(x) - 1
    total = min((tables[0] + behind[0]).min(axis=1)[0], FAR)
    return pd.DataFrame({"conv": x["conv"], "part": x["part"], "behind": [b.tolist() for b in behind], "cost": np.where(first, total, 0), "illegal": x["illegal"] + np.where(first, joints, 0), "last": last})


def _traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each range, for every state it may begin in: its audit and the state it leaves."""
    for batch in batches:
        found = [[range_trace(codes, s, behind) for s in STATES] for codes, behind in zip(batch["codes"].to_pylist(), batch["behind"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([
            *(batch[c] for c in ("conv", "part", "cost", "illegal", "last")),
            pa.array([[a for a, _ in x] for x in found], pa.list_(pa.string())), pa.array([[t for _, t in x] for x in found], pa.list_(pa.int32())),
        ], names=["conv", "part", "cost", "illegal", "last", "audits", "after"])


def _follow(x: pd.DataFrame) -> pd.DataFrame:
    """The state that each range of a conversation begins in, and what is put in behind it."""
    x, state, states = x.sort_values("part"), 0, []
    for after in x["after"]:
        states.append(state)
        state = int(after[state])
    ends = np.where(x["last"], closing(state), "")
    return pd.DataFrame({"conv": x["conv"], "part": x["part"], "state": states, "closing": ends})


def _repair_long(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations of any length: (the columns of COUNTS but the hash, edited turns by part and k)."""
    placed, coded = _ranges_of(rows)
    in_order = lambda name: F.transform(F.col("turns"), lambda x: x[name])
    ranges = coded.groupBy("conv", "part").agg(F.array_sort(F.collect_list(F.struct("id", "code", "initial"))).alias("turns"))
    ranges = ranges.select("conv", "part", F.array_join(in_order("code"), "").alias("codes"), in_order("initial").alias("initials"))
    costs = durable(ranges.mapInArrow(_costs, "conv string, part int, codes string, costs array<long>, initial string, final string, illegal long"))
    chained = costs.drop("codes").groupBy("conv").applyInPandas(_chain, "conv string, part int, behind array<long>, cost long, illegal long, last boolean")
    known = costs.select("conv", "part", "codes").join(chained, ["conv", "part"])
    traces = durable(known.mapInArrow(_traces, "conv string, part int, cost long, illegal long, last boolean, audits array<string>, after array<int>"))
    states = traces.select("conv", "part", "after", "last").groupBy("conv").applyInPandas(_follow, "conv string, part int, state int, closing string")
    audits = durable(
        traces.join(states, ["conv", "part"]).select("conv", "part", "cost", "illegal", "state", F.concat(F.get("audits", F.col("state")), "closing").alias("audit"))
    )
    whole = audits.groupBy("conv").agg(
        F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"]), "").alias("audit"),
    )
    count = lambda name: F.count_if(F.col("fault") == name).alias(name)
    counts = coded.groupBy("conv").agg(count("blank"), count("duplicate"), count("truncated"), (F.max("turn") - F.min("turn") + 1).alias("span"))
    known_turns = coded.where("turn IS NOT NULL").select("conv", "turn").distinct().groupBy("conv").agg(F.count("*").alias("known"))
    gaps = F.coalesce(F.col("span") - F.col("known"), F.lit(0)).alias("gaps")
    summary = whole.join(counts, "conv").join(known_turns, "conv", "left").select("conv", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    def edit(turns: pd.DataFrame, range_: pd.DataFrame) -> pd.DataFrame:
        turns = turns.sort_values("id")
        done = repaired(list(zip(turns["turn"], turns["role"], turns["text"], strict=True)), range_["audit"].iloc[0], int(range_["state"].iloc[0]))
        out = pd.DataFrame(list(done), columns=["edit", "turn", "role", "text"], dtype=object)
        return pd.DataFrame({"conv": turns["conv"].iloc[0], "part": turns["part"].iloc[0], "k": np.arange(len(out)), **{c: out[c] for c in out}})

    by_range = placed.withColumn("turn", F.col("turn").cast("string")).groupBy("conv", "part")
    edited = by_range.cogroup(audits.groupBy("conv", "part")).applyInPandas(edit, "conv string, part int, k long, edit string, turn string, role string, text string")
    return summary, durable(edited)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of conversations whose turns come in order: a stream, of which nothing is kept."""
    current, sha, out = None, None, []
    for batch in batches:
        for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if conv != current:
                if sha:
                    out.append((current, sha.hexdigest()))
                current, sha = conv, hashlib.sha256()
            elif sha:
                sha.update(b"\n")
            sha.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
    if sha:
        out.append((current, sha.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.string()), pa.array([h for _, h in out], pa.string())], names=["conv", "repaired_sha256"])


def _conv_id() -> Column:
    return F.when(F.col("conv") != "", F.col("conv").cast("long")).alias("conv_id")


def _parted(rows: DataFrame, most_turns: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of conversations up to ``most_turns`` turns, and those of longer ones if there are any."""
    rows = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), (F.col("is_turn") if "is_turn" in rows.columns else F.lit(True)).alias("is_turn"),
        F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    )
    long = durable(rows.where("is_turn").groupBy(_conv().alias("conv")).agg(F.count("*").alias("n")).where(F.col("n") > most_turns).select("conv"))
    if long.isEmpty():
        return rows, None
    return rows.join(long, _conv() == long["conv"], "left_anti"), rows.join(long, _conv() == long["conv"], "left_semi")


def repair_conversations(rows: DataFrame, most_turns: int = MOST_TURNS) -> DataFrame:
    """A row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``rows`` has conv_id, turn, role, text and perhaps ``is_turn``.
    """
    short, long = _parted(rows, most_turns)
    out = _each(short, COUNTS, lambda turns, align: iter([digest_of(turns, align)]))
    if long is None:
        return out
    summary, edited = _repair_long(long)
    hashes = edited.select("conv", "role", "text", "part", "k").repartition("conv").sortWithinPartitions("conv", "part", "k").select("conv", "role", "text").mapInArrow(_hashes, "conv string, repaired_sha256 string")
    nothing = F.lit(hashlib.sha256().hexdigest())
    whole = summary.join(hashes, "conv", "left").select(_conv_id(), *summary.columns[1:], F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
    return out.unionByName(whole)


def repaired_turns(rows: DataFrame, most_turns: int = MOST_TURNS) -> DataFrame:
    """The turns of repaired conversations: conv_id, place (their order, with gaps in long ones), edit (K, R or I), turn, role, text."""
    short, long = _parted(rows, most_turns)
    out = _each(short, "place long, edit string, turn long, role string, text string", turns_of)
    if long is None:
        return out
    _, edited = _repair_long(long)
    place = (F.shiftleft(F.col("part").cast("long"), 40) + F.col("k")).alias("place")
    return out.unionByName(edited.select(_conv_id(), place, "edit", F.col("turn").cast("long").alias("turn"), "role", "text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults, by the remainder of crc32("conv_id:turn") by 20; dropped rows stay as names of their conversations."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), fault.alias("_fault"))
    return rows.select(
        "conv_id", "turn", (F.col("_fault") != 0).alias("is_turn"),
        F.when(F.col("_fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")
