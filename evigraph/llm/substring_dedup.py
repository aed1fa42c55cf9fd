"""Substring dedup by collinear chaining of shared k-mer seeds.

Seeds are all k-mers of ``WORDS`` words: of 50 words with 10 changed, 40 equal ones lie in 11
runs at most, so the two texts share seven seeds at least, wherever the changes are.  Exact copies
are whole passages of the smallest id among them and have no seeds of their own.

A seed's occurrences are not paired with each other; all are matched with its first occurrence
(smallest document, then place).  To find it, the seeds of a run of texts are dealt by hash
into parts, each packed into one small compressed value (sorted hashes as differences, places in
planes of bytes), so that one shuffle of about five bytes a word brings a part together.  A seed that
a run of texts holds so often that, at that rate, it would fill a part alone, sends its first place alone to its
part; the others are dealt evenly and meet the first occurrence in a join, which adaptive execution splits, so
no task holds all rows of a frequent seed.

The short runs of a passage may each have occurred before, in documents that have nothing else of it, and they occur the more often the
larger a corpus is.  So long seeds, the smallest of each ``WINDOW`` neighbouring runs of ``RUNS`` short seeds in a row, go with them; one of these
is matched with its previous occurrence, not its first.  Any ``RUNS * WORDS + WINDOW - 1`` equal words hold one.

In each document the matches with one earlier document are chained: ordered in both texts,
scored by what they cover less a cost for gaps, the best predecessor found in a Fenwick tree.  A
chain of short seeds is kept if it spans as many words as two of them and as many matched seeds as a passage shares at least, with whatever earlier documents, lie
so near that one passage could hold them.  Chains are aligned word by word in both texts, and what
aligned parts cover without a break, against whichever earlier documents, is a passage if it
has at least ``min_words`` words.  A part is ``PART`` words long at least: shorter ones are phrases that
any two texts may share.  Words are compared by 32-bit hashes here.

Edge cases: words are ``[^\\x20\\x09-\\x0D]+``; null, empty and short texts hold no passage; of
equal texts the smallest id keeps its words; repeats within one document are not
passages; rows without an id are neither matched nor changed; ids are taken to be unique (a
repeated id's rows share their passages); other columns pass through; an empty table gives no rows.
"""
import difflib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import bounded_batches, discard, durable, in_parts, mix64, word_hashes

WORDS = 4
MIN_WORDS, SIMILARITY = 50, 0.8
#: Words between two parts of one alignment at most, and what a word of a gap costs a chain.
MAX_GAP, GAP_COST = 40, 0.15
BREAK = 2
#: Words that a part of an alignment has at least.
PART = 19
#: Words of a run of texts whose seeds are packed together, and seeds of a part.
RUN_WORDS, PART_SEEDS = 600_000, 3_000_000
#: Places of a slice of a text are rounded to so many words, so that requests repeat.
SLICE = 32

CHAIN = "doc long, lead long, start int, end int, lead_start int, lead_end int"
MATCH = "doc long, pos int, lead long, lead_pos int, seed long, sparse boolean"
#: Short seeds in a row that make a long one, and neighbours of which the smallest is taken.
RUNS, WINDOW = 3, 16


def planes(values: np.ndarray) -> bytes:
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def from_planes(data: bytes, kind: type, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, n).T.copy().view(kind).reshape(n)


def pack(keys: np.ndarray, docs: np.ndarray, pos: np.ndarray) -> bytes:
    """Sorted 64-bit ``keys`` with their documents and places, small."""
    known, index = np.unique(docs, return_inverse=True)
    longest = int(pos.max()) + 1
    place = index.astype(np.uint64) * np.uint64(longest) + pos.astype(np.uint64)
    head = np.array([len(keys), len(known), longest], np.uint64).tobytes()
    return zlib.compress(head + planes(np.diff(known, prepend=0)) + planes(np.diff(keys, prepend=np.uint64(0))) + planes(place), 1)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = zlib.decompress(data)
    n, k, longest = (int(x) for x in np.frombuffer(data[:24], np.uint64))
    known = np.cumsum(from_planes(data[24:24 + 8 * k], np.int64, k))
    keys = np.cumsum(from_planes(data[24 + 8 * k:24 + 8 * (k + n)], np.uint64, n))
    place = from_planes(data[24 + 8 * (k + n):], np.uint64, n)
    return keys, known[(place // np.uint64(longest)).astype(np.int64)], (place % np.uint64(longest)).astype(np.int32)


def seeds_of(texts: pd.Series, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, text, pos) of the k-mers of some texts."""
    flat, sizes = word_hashes(texts)
    ends = np.cumsum(sizes)
    own = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(np.repeat(ends, sizes) - np.arange(len(flat)) >= words)
    grams = np.zeros(len(at), np.uint64)
    for k in range(words):
        grams = mix64(grams + np.uint64(0x9E3779B97F4A7C15) + flat[at + k])
    own = own[at]
    return grams, own, at - (ends - sizes)[own]


def first_of_runs(grams: np.ndarray, own: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one seed again and again only the first."""
    if not len(grams):
        return grams, own, pos
    new = np.concatenate([[True], (grams[1:] != grams[:-1]) | (own[1:] != own[:-1])])
    return grams[new], own[new], pos[new]


def long_seeds(grams: np.ndarray, own: np.ndarray, pos: np.ndarray, words: int, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, text, pos) of runs of three k-mers in a row that are the smallest of ``window`` neighbours; ``window`` is a power of two."""
    n = len(grams) - 2 * words
    if n < window:
        return grams[:0], own[:0], pos[:0]
    whole = own[:n] == own[2 * words:]
    keys = mix64(mix64(grams[:n] + np.uint64(1)) + mix64(grams[words:words + n] + np.uint64(2)) + grams[2 * words:])
    keys = np.where(whole, np.maximum(keys, np.uint64(1)), ~np.uint64(0))
    least, most, shift = keys, np.zeros(n + window - 1, np.uint64), 1
    while shift < window:
        least = np.minimum(least[:-shift], least[shift:])
        shift *= 2
    inside = whole[window - 1:] & (own[:n - window + 1] == own[window - 1:n])
    most[window - 1:n] = np.where(inside, least, np.uint64(0))
    shift = 1
    while shift < window:  # a run is taken if it is the least of any window over it: the largest of their least ones
        most = np.maximum(most[:-shift], most[shift:])
        shift *= 2
    taken = whole & (most == keys)
    return keys[taken], own[:n][taken], pos[:n][taken]


def packed_seeds(docs: DataFrame, words: int, bits: int, parts: int, hot: int) -> DataFrame:
    """(part, kind, data): a run's seeds of a part (kind 0, long ones 3), the first places of its frequent seeds (1), and the other places of those (2), dealt evenly to parts from ``parts`` on."""
    edges = np.array([(k << bits) // parts for k in range(parts)] , np.uint64)

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for cut in in_parts(batch["text"].str.len().fillna(0).to_numpy(np.int64), 6 * RUN_WORDS, 100_000):
                ids = batch["doc_id"].to_numpy()[cut]
                every = seeds_of(batch["text"].iloc[cut], words)
                rows = []
                for plain, (keys, own, pos) in ((0, first_of_runs(*every)), (3, long_seeds(*every, words))):
                    if not len(keys):
                        continue
                    keys, doc = keys >> np.uint64(64 - bits), ids[own]
                    order = np.lexsort((pos, doc, keys)) if hot < len(keys) else np.argsort(keys, kind="stable")
                    keys, doc, pos = keys[order], doc[order], pos[order]
                    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                    often = np.diff(np.append(start, len(keys)))
                    kind = np.repeat(np.where(often > hot, 2, plain), often)
                    kind[start[often > hot]] = 1
                    for what in (plain, 1, 2):
                        k, d, p = (x[kind == what] for x in (keys, doc, pos))
                        if what == 2:
                            rows += [(parts + int(mix64(d[:1] + at)[0] % np.uint64(parts)), 2, pack(k[at:at + RUN_WORDS], d[at:at + RUN_WORDS], p[at:at + RUN_WORDS])) for at in range(0, len(k), RUN_WORDS)]
                            continue
                        low = np.searchsorted(k, edges)
                        high = np.append(low[1:], len(k))
                        rows += [(part, what, pack(k[x:y], d[x:y], p[x:y])) for part, (x, y) in enumerate(zip(low.tolist(), high.tolist(), strict=True)) if x < y]
                yield pd.DataFrame(rows, columns=["part", "kind", "data"])

    return docs.select("doc_id", "text").mapInPandas(packed, "part int, kind int, data binary")


def first_matches(keys: np.ndarray, doc: np.ndarray, pos: np.ndarray, frequent: np.ndarray) -> pd.DataFrame:
    """Rows of MATCH: each occurrence in a later document with the seed's first; for frequent seeds their first occurrence too, without a document."""
    order = np.argsort(keys, kind="stable")
    keys, doc, pos, frequent = keys[order], doc[order], pos[order], frequent[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    often = np.diff(np.append(start, len(keys)))
    lead, last, hot = np.minimum.reduceat(doc, start), np.maximum.reduceat(doc, start), np.logical_or.reduceat(frequent, start)
    lead_pos = np.minimum.reduceat(np.where(doc == np.repeat(lead, often), pos, np.iinfo(np.int32).max), start)
    later = doc != np.repeat(lead, often)
    n, firsts = int(later.sum()), int(hot.sum())
    none = np.arange(n + firsts) >= n
    return pd.DataFrame({
        "doc": pd.arrays.IntegerArray(np.concatenate([doc[later], np.zeros(firsts, np.int64)]), none),
        "pos": np.concatenate([pos[later], np.zeros(firsts, np.int32)]),
        "lead": np.concatenate([np.repeat(lead, often)[later], lead[hot]]),
        "lead_pos": np.concatenate([np.repeat(lead_pos, often)[later], lead_pos[hot]]),
        "seed": pd.arrays.IntegerArray(np.concatenate([np.zeros(n, np.int64), keys[start][hot].view(np.int64)]), ~none), "sparse": False,
    })


def previous_matches(keys: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> pd.DataFrame:
    """Rows of MATCH: of each seed, every document's first occurrence with that of the document before."""
    order = np.lexsort((pos, doc, keys))
    keys, doc, pos = keys[order], doc[order], pos[order]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])])
    keys, doc, pos = keys[new], doc[new], pos[new]
    again = np.flatnonzero(keys[1:] == keys[:-1]) + 1
    return pd.DataFrame({"doc": doc[again], "pos": pos[again], "lead": doc[again - 1], "lead_pos": pos[again - 1], "seed": pd.array([pd.NA] * len(again), "Int64"), "sparse": True})


def matches_of(packed: DataFrame, parts: int) -> DataFrame:
    """Rows of MATCH: matches; first occurrences of frequent seeds (no doc); occurrences of those (no lead)."""

    def matched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held = None, []

        def joined() -> Iterator[pd.DataFrame]:
            for long in (False, True):
                found = [(*unpack(data), kind) for kind, data in held if (kind == 3) == long]
                if found:
                    keys, doc, pos = (np.concatenate([x[c] for x in found]) for c in range(3))
                    yield previous_matches(keys, doc, pos) if long else first_matches(keys, doc, pos, np.concatenate([np.full(len(x[0]), x[3] == 1) for x in found]))

        for batch in batches:
            for now, kind, data in zip(batch["part"], batch["kind"], batch["data"], strict=True):
                if kind == 2:
                    keys, doc, pos = unpack(data)
                    yield pd.DataFrame({"doc": doc, "pos": pos, "lead": pd.array([pd.NA] * len(doc), "Int64"), "lead_pos": 0, "seed": keys.view(np.int64), "sparse": False})
                    continue
                if now != part and held:
                    yield from joined()
                    held = []
                part = now
                held.append((kind, data))
        if held:
            yield from joined()

    return packed.repartition(parts, "part").sortWithinPartitions("part").mapInPandas(matched, MATCH)


def seed_matches(docs: DataFrame, words: int = WORDS, hot: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The table that holds what was found, and from it (doc, pos, lead, lead_pos, sparse): each occurrence of a k-mer with its first one in an earlier document, of a long seed (``sparse``) with its previous one.

    ``hot``: occurrences in a run beyond which a seed is frequent; by default so many that the rows of one seed in its part stay below ``PART_SEEDS``.
    """
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.count("*").alias("rows")).first()
    n_words = max(1, size["chars"] // 6)
    if hot is None:
        hot = PART_SEEDS // (n_words // RUN_WORDS + size["rows"] // 1000 + int(spark.conf.get("spark.sql.shuffle.partitions")))
    # As many bits as leave about a thousand chance matches, which alignment refuses.
    bits = min(64, max(40, 2 * n_words.bit_length() - 12))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_words // PART_SEEDS))
    found = durable(matches_of(packed_seeds(docs, words, bits, parts, hot), parts))
    first = found.where("doc IS NULL").groupBy("seed").agg(F.min(F.struct("lead", "lead_pos")).alias("f"))
    often = found.where("lead IS NULL").select("doc", "pos", "seed", "sparse").join(first, "seed").select("doc", "pos", F.col("f.lead").alias("lead"), F.col("f.lead_pos").alias("lead_pos"), "sparse")
    return found, found.where("seed IS NULL").drop("seed").unionByName(often.where("doc <> lead"))


def chain(pos: np.ndarray, lead: np.ndarray, weight: float = WORDS, gap_cost: float = GAP_COST, max_gap: int = MAX_GAP) -> list[np.ndarray]:
    """Chains of matches, best first: index arrays, increasing in both texts.

    score(i) = weight + max(0, best score(j) - gap_cost * (distance in both texts)) over
    earlier j; as the cost is a sum of ends, the best j is a prefix maximum over the lead's
    positions of score(j) + gap_cost * (pos + lead)(j), kept in a Fenwick tree.
    """
    order = np.lexsort((lead, pos))
    p, q = pos[order], lead[order]
    steps = np.diff(p), np.diff(q)
    if len(p) == 1 or ((steps[0] > 0) & (steps[1] > 0) & (steps[0] <= max_gap) & (steps[1] <= max_gap)).all():
        return [order]  # the matches are one chain as they stand
    ranks = np.unique(q)
    rank = np.searchsorted(ranks, q) + 1
    n = len(p)
    tree = [(-np.inf, -1)] * (len(ranks) + 1)
    score, before = [0.0] * n, [-1] * n
    waiting: list[int] = []
    for i in range(n):
        if i and p[i] != p[i - 1]:  # matches at one place of the text do not chain with each other
            for j in waiting:
                value, k = (score[j] + gap_cost * (int(p[j]) + int(q[j])), j), int(rank[j])
                while k < len(tree):
                    tree[k] = max(tree[k], value)
                    k += k & -k
            waiting = []
        best, k = (-np.inf, -1), int(rank[i]) - 1
        while k:
            best = max(best, tree[k])
            k -= k & -k
        j = best[1]
        gain = best[0] - gap_cost * (int(p[i]) + int(q[i]))
        if j >= 0 and gain > 0:
            score[i], before[i] = weight + gain, j
        else:
            score[i] = weight
        waiting.append(i)
    out, used = [], np.zeros(n, bool)
    for i in np.argsort(-np.array(score), kind="stable"):
        own = []
        while i >= 0 and not used[i]:
            used[i] = True
            own.append(i)
            i = before[i]
        if own:
            at = np.array(own[::-1])
            # Alignment meets again within ``max_gap`` words only, so a chain ends at a wider gap.
            out += np.split(order[at], np.flatnonzero((np.diff(p[at]) > max_gap) | (np.diff(q[at]) > max_gap)) + 1)
    return out


def runs(spans: list[tuple[int, int]], gap: int) -> list[tuple[int, int]]:
    """Union of spans, joined over gaps of at most ``gap`` words."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1] + gap:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def chains(matches: DataFrame, words: int = WORDS, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Chains of (doc, pos, lead, lead_pos, sparse) matches that a passage can hold: of short seeds those that span two of them.

    Matches of long seeds, single ones too, make chains of their own, but for those inside of a chain that is a passage as it stands.
    Rows come grouped by document; one document's matches are bounded by its length.
    """
    # A changed word spoils ``words`` seeds at most.
    least = max(1, min_words - words + 1 - round(min_words * (1 - similarity)) * words)

    def of_document(doc: int, pos: np.ndarray, lead: np.ndarray, lead_pos: np.ndarray, sparse: np.ndarray) -> list[tuple]:
        out, sure = [], []
        places = np.unique(pos[~sparse])

        def near(first: np.ndarray, last: np.ndarray) -> np.ndarray:
            return np.searchsorted(places, last + min_words, "right") - np.searchsorted(places, first - min_words)

        def row(i: np.ndarray, size: int) -> tuple:
            return doc, int(lead[i[0]]), int(pos[i[0]]), int(pos[i[-1]]) + size, int(lead_pos[i[0]]), int(lead_pos[i[-1]]) + size

        start = np.flatnonzero(np.concatenate([[True], (np.diff(lead) != 0) | (np.diff(sparse) != 0)]))
        end = np.append(start[1:], len(pos))
        first, last = pos[start], pos[end - 1]
        for x, y in zip(start[hold := sparse[start] | ((last - first >= words) & (near(first, last) >= least))].tolist(), end[hold].tolist(), strict=True):
            for found in chain(pos[x:y], lead_pos[x:y], RUNS * words if sparse[x] else words):
                i = found + x
                made = row(i, RUNS * words if sparse[x] else words)
                if sparse[x]:
                    if not any(s <= made[2] and made[3] <= e for s, e in sure):
                        out.append(made)
                elif made[3] - made[2] >= 2 * words and near(pos[i[0]], pos[i[-1]]) >= least:
                    out.append(made)
                    held = words + int(np.minimum(np.diff(pos[i]), words).sum())
                    if made[3] - made[2] >= min_words and held >= similarity * max(made[3] - made[2], made[5] - made[4]):
                        sure.append((made[2], made[3]))
        return out

    def chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            now = batch if rest is None else pd.concat([rest, batch])
            last = now["doc"].iloc[-1]
            whole, rest = now[now["doc"] != last], now[now["doc"] == last]
            if len(whole):
                yield of_rows(whole)
        if rest is not None:
            yield of_rows(rest)

    def of_rows(rows: pd.DataFrame) -> pd.DataFrame:
        doc, *columns = (rows[c].to_numpy() for c in ("doc", "pos", "lead", "lead_pos", "sparse"))
        out = []
        for own in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(doc)) + 1):
            out += of_document(int(doc[own[0]]), *(x[own] for x in columns))
        return pd.DataFrame(out, columns=["doc", "lead", "start", "end", "lead_start", "lead_end"])

    return matches.select("doc", "lead", "pos", "lead_pos", "sparse").repartition("doc").sortWithinPartitions("doc", "sparse", "lead", "pos").mapInPandas(chained, CHAIN)


def aligned(a: np.ndarray, b: np.ndarray, max_gap: int = MAX_GAP, sure: int = 4, tail: bool = False) -> list[tuple[int, int, int]]:
    """Runs (start in a, start in b, length) of equal words from the start of both on, as far as they meet again within ``max_gap`` words; ``tail`` adds equal words at equal distances beyond that."""
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        n = min(len(a) - i, len(b) - j)
        differ = a[i:i + n] != b[j:j + n]
        same = int(differ.argmax()) if differ.any() else n
        if same:
            out.append((i, j, same))
        i, j = i + same, j + same
        if same == n:
            break
        x, y = a[i:i + max_gap + sure], b[j:j + max_gap + sure]
        need = min(sure, len(x), len(y))
        equal = np.lib.stride_tricks.sliding_window_view(x, need)[:, None] == np.lib.stride_tricks.sliding_window_view(y, need)[None]
        at = np.argwhere(equal.all(2))
        if not len(at):
            n = min(len(x), len(y)) if tail else 0
            out += [(i + int(k), j + int(k), 1) for k in np.flatnonzero(x[:n] == y[:n])]
            break
        di, dj = map(int, at[(at.sum(1)).argmin()])
        if di == dj:
            inside = [(int(k), int(k), 1) for k in np.flatnonzero(a[i:i + di] == b[j:j + dj])]
        else:
            inside = difflib.SequenceMatcher(None, a[i:i + di].tolist(), b[j:j + dj].tolist(), autojunk=False).get_matching_blocks()
        out += [(i + k, j + l, n) for k, l, n in inside if n]
        i, j = i + di, j + dj
    return out


def passages_of(a: np.ndarray, b: np.ndarray, at: int, lead_at: int, similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> list[tuple[int, int, int, int, int]]:
    """Aligned parts around a common seed: (start, end, lead_start, lead_end, equal words), each at least ``similarity`` alike.

    Where no part has ``min_words`` words, the last few words of a passage after its last changed one may be what lacks.
    """
    out = _parts(a, b, at, lead_at, similarity, False)
    return out if any(x[1] - x[0] >= min_words for x in out) else _parts(a, b, at, lead_at, similarity, True)


def _parts(a: np.ndarray, b: np.ndarray, at: int, lead_at: int, similarity: float, tail: bool) -> list[tuple[int, int, int, int, int]]:
    right = [(at + i, lead_at + j, n) for i, j, n in aligned(a[at:], b[lead_at:], tail=tail)]
    left = [(at - i - n, lead_at - j - n, n) for i, j, n in aligned(a[:at][::-1], b[:lead_at][::-1], tail=tail)][::-1]
    met = np.array(left + right).reshape(-1, 3)
    start, lead_start, n = met.T
    end, lead_end, equal = start + n, lead_start + n, np.concatenate([[0], np.cumsum(n)])
    out, open_ = [], [(0, len(met))]
    while open_:
        low, high = open_.pop()
        best = (0, low, low)
        for x in range(low, high):  # the longest part first, then those beside it
            if end[high - 1] - start[x] <= best[0]:
                break
            fit = np.flatnonzero(equal[x + 1:high + 1] - equal[x] >= similarity * np.maximum(end[x:high] - start[x], lead_end[x:high] - lead_start[x]))
            y = x + int(fit[-1])
            best = max(best, (int(end[y] - start[x]), x, y + 1), key=lambda v: v[0])
        _, x, y = best
        if x < y:
            out.append((int(start[x]), int(end[y - 1]), int(lead_start[x]), int(lead_end[y - 1]), int(equal[y] - equal[x])))
            open_ += [(low, x), (y, high)]
    return sorted(out)


def pairs_met(a: np.ndarray, b: np.ndarray) -> int:
    """Pairs of adjacent words of ``a`` that ``b`` holds too."""
    x, y = ((w[:-1].astype(np.uint64) << np.uint64(32)) | w[1:] for w in (a, b))
    y = np.sort(y)
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(y) else 0


def slices(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """(lead, from, to, words): 32-bit hashes of the words asked for; asked: (lead, from, to).  A text's requests are bounded by its length."""

    @F.pandas_udf("array<struct<from:int,to:int,words:binary>>")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for part in in_parts(text.str.len().fillna(0).to_numpy(np.int64), 1_000_000, 1000):
            flat, sizes = word_hashes(text.iloc[part])
            flat, ends = flat.astype(np.uint32), np.cumsum(sizes)
            for own, end, n in zip(spans.iloc[part], ends, sizes, strict=True):
                out.append([{"from": s["from"], "to": s["to"], "words": flat[end - n + min(n, s["from"]):end - n + min(n, s["to"])].tobytes()} for s in own])
        return pd.Series(out)

    spans = asked.distinct().groupBy("lead").agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    cuts = texts.withColumnRenamed("doc_id", "lead").join(spans, "lead").select("lead", F.explode(cut("text", "spans")).alias("s"))
    return cuts.select("lead", "s.from", "s.to", "s.words")


def aligned_passages(linked: DataFrame, texts: DataFrame, min_words: int, similarity: float) -> DataFrame:
    """Passages of the documents of ``linked`` chains (see ``CHAIN``)."""
    margin = min_words + MAX_GAP
    # Of the pairs of adjacent words of a part, a changed word spoils two.
    least = PART - 1 - 2 * int(PART * (1 - similarity) + 1e-9)
    low = F.greatest(F.lit(0), F.col("lead_start") - margin)
    asked = linked.withColumns({"from": (low - F.pmod(low, F.lit(SLICE))).cast("int"), "to": (F.ceil((F.col("lead_end") + margin) / SLICE) * SLICE).cast("int")})
    cuts = slices(texts, asked.select("lead", "from", "to"))
    # All chains of a document meet its text; both are bounded by its length.
    whole = asked.join(cuts, ["lead", "from", "to"]).groupBy("doc").agg(F.collect_list(F.struct("start", "end", "lead", "lead_start", "from", "words")).alias("chains"))

    @F.pandas_udf("array<struct<start_word:int,end_word:int,source_id:long,source_start:int,similarity:double>>")
    def merged(text: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for t, own in zip(text, found, strict=True):
            flat = word_hashes([t])[0].astype(np.uint32)
            parts, covered = set(), []
            for c in sorted(own, key=lambda c: (c["start"] - c["end"], c["start"], c["lead"], c["lead_start"])):
                if any(x <= c["start"] and c["end"] <= y for x, y in covered):
                    continue  # inside of a passage with another text
                s, f = max(0, c["start"] - margin), c["from"]
                a, b = flat[s:c["end"] + margin], np.frombuffer(c["words"], np.uint32)
                if c["end"] - c["start"] < PART and pairs_met(flat[max(0, c["start"] - min_words):c["end"] + min_words], b) < least:
                    continue  # too little in common for a part
                here = {(s + p, s + q, c["lead"], f + u, f + v, n) for p, q, u, v, n in passages_of(a, b, c["start"] - s, c["lead_start"] - f, similarity, min_words) if q - p >= PART}
                parts |= here
                covered += [x[:2] for x in here if x[1] - x[0] >= min_words]
            parts, here = sorted(parts), []
            for start, end in runs([(x[0], x[1]) for x in parts], BREAK):
                if end - start >= min_words:
                    best = max((x for x in parts if start <= x[0] < end), key=lambda x: (x[5], -x[2], -x[3]))
                    here.append({"start_word": start, "end_word": end, "source_id": best[2], "source_start": best[3], "similarity": best[5] / max(best[1] - best[0], best[4] - best[3])})
            out.append(here)
        return pd.Series(out)

    rows = whole.join(texts.withColumnRenamed("doc_id", "doc"), "doc")
    return rows.select(F.col("doc").alias("doc_id"), F.explode(merged("text", "chains")).alias("m")).select("doc_id", "m.start_word", "m.end_word", "m.source_id", "m.source_start", "m.similarity")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """A row for each passage of a document that an earlier one holds: doc_id, start_word, end_word, n_words, source_id, source_start, similarity."""
    bounded_batches(docs.sparkSession)
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    keyed = texts.select("doc_id", F.md5(F.col("text").cast("binary")).alias("_key"))
    first = keyed.groupBy("_key").agg(F.min("doc_id").alias("source_id"), F.max("doc_id").alias("_last")).where("source_id < _last").drop("_last")
    copies = durable(keyed.join(first, "_key").where("doc_id <> source_id").select("doc_id", "source_id").distinct())
    heads = texts.join(copies.select("doc_id"), "doc_id", "left_anti")
    found, matches = seed_matches(heads, words)
    linked = durable(chains(matches, words, min_words, similarity))
    discard(found)
    passages = aligned_passages(linked, heads, min_words, similarity)
    size = F.size(F.split(F.rtrim(F.ltrim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))), " "))
    whole = texts.join(copies, "doc_id").select("doc_id", F.lit(0).alias("start_word"), size.alias("end_word"), "source_id", F.lit(0).alias("source_start"), F.lit(1.0).alias("similarity")).where(F.col("end_word") >= min_words)
    out = passages.unionByName(whole)
    return out.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "source_id", "source_start", "similarity")


WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and the white space after them."""
    raw = text.encode("utf-8", "surrogatepass")
    starts = [m.start() for m in WORD.finditer(raw)] + [len(raw)]
    out, at = [], 0
    for start, end in sorted(spans):
        out.append(raw[at:starts[start]])
        at = starts[min(end, len(starts) - 1)]
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "surrogatepass").rstrip() if out[0] or at < len(raw) else ""


def drop_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """Documents without the words of their passages, with their own columns; n_chars follows the text, and documents left without a word go."""
    spans = passages.groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "end_word")).alias("_spans"))

    @F.pandas_udf("string")
    def cut(text: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or s is None else without_words(t, [(x["start_word"], x["end_word"]) for x in s]) for t, s in zip(text, found, strict=True)])

    out = docs.join(spans, "doc_id", "left").withColumn("text", cut("text", "_spans"))
    out = out.where(F.col("_spans").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.length("text")))
    return out.select(*docs.columns)
