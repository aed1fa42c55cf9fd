"""Ranked lexical search by presence masks.

Documents are ranked for each item by an integer form of BM25.  The items form a
stated query set: they are taken in blocks of at most ``MOST_ITEMS`` items and about
``MOST_TERMS`` different terms, and each block's terms are broadcast.

1. Every document is read once a block: its number of terms, and which of the block's
   terms it holds how often (a forward index, written to the shared folder).
2. Counts over all documents give the weight of each term and the length norm.
3. A partition of that index is a bitmap of documents for each term.  For an item the
   bitmaps of its terms are packed into one presence mask a document; documents are
   grouped by mask.  A mask's bound is the sum, over its terms, of weight times the
   term's highest impact.  Masks are scored exactly, highest bound first, until the next
   bound lies under the k-th best score that the partition has seen.
4. At most k rows an item and partition are merged in two steps.

Edge cases: a text that is null or has no term is no document and takes part in no
count; a null id is kept and comes last among equal scores; rows with one id are
documents of their own; an item without a known term returns nothing; items with one
id are ranked apart; with no documents or no items there are no rows; other columns
are not carried.  Ids are 64-bit integers.
"""
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigraph.llm.common import bounded_batches, durable

#: Bounds of a block of items, and of the cells (terms x documents) of a bitmap held at once.
MOST_ITEMS, MOST_TERMS, CELLS = 1000, 20_000, 1 << 23

_separators = bytes(b for b in range(128) if not chr(b).isalnum())
#: Every byte that ends a term becomes a blank; only A to Z become small.
_FOLD = bytes.maketrans(_separators + bytes(range(65, 91)), b" " * len(_separators) + bytes(range(97, 123)))

#: Impact of a term: SCALE * tf div (TF * tf + NORM * m), m = BASE - SLOPE + (SLOPE * n * N) div L.
SCALE, TF, NORM, BASE, SLOPE, WEIGHT = 1_000_000_000, 1000, 8, 100, 75, 1000
NO_ID = (1 << 63) - 1


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


@dataclass
class Block:
    """Some items and the numbers of their terms."""

    items: list[tuple[int, dict[int, int]]] = field(default_factory=list)
    vocabulary: dict[bytes, int] = field(default_factory=dict)

    def add(self, number: int, terms: list[bytes]) -> None:
        self.items.append((number, {self.vocabulary.setdefault(t, len(self.vocabulary)): n for t, n in Counter(terms).items()}))


def blocks_of(items: DataFrame, most_items: int, most_terms: int) -> Iterator[tuple[Block, list[int | None]]]:
    """Blocks of items with the ids of all items read so far in the block; the driver holds one block at a time."""
    block, ids = Block(), []
    for item_id, text in items.toLocalIterator():
        terms = terms_of(text)
        if block.items and (len(ids) >= most_items or len(block.vocabulary) + len(set(terms)) > most_terms):
            yield block, ids
            block, ids = Block(), []
        block.add(len(ids), terms)
        ids.append(item_id)
    if ids:
        yield block, ids


def forward_index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """A row for each document with a term: id, n (its terms), and of those in ``vocabulary`` numbers and counts as 32-bit integers."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = known.value.get
        for batch in batches:
            rows = []
            for doc, text in zip(batch["id"].tolist(), batch["text"].tolist(), strict=True):
                words = terms_of(text)
                if words:
                    found = np.fromiter(map(number, words, repeat(-1)), np.int32, len(words))
                    held, tf = np.unique(found[found >= 0], return_counts=True)
                    rows.append((doc, len(words), len(held), held.tobytes(), tf.astype(np.int32).tobytes()))
            yield pd.DataFrame(rows, columns=["id", "n", "held", "terms", "tf"])

    return docs.mapInPandas(read, "id long, n long, held int, terms binary, tf binary")


def count_terms(index: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """N, L and the number of documents of each of the block's terms, summed within partitions first."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, docs, length = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch["terms"]), np.int32), minlength=size)
            docs, length = docs + len(batch), length + int(batch["n"].sum())
        some = np.flatnonzero(df)
        yield pd.DataFrame({"term": np.concatenate([[-2, -1], some]), "n": np.concatenate([[docs, length], df[some]])})

    rows = index.select("n", "terms").mapInPandas(counted, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r["term"]: r["n"] for r in rows}
    return found.get(-2, 0), found.get(-1, 0), np.array([found.get(t, 0) for t in range(size)], np.int64)


def norms(n: np.ndarray, n_docs: int, length: int) -> np.ndarray:
    """m of documents with ``n`` terms, in integers of any size."""
    if SLOPE * int(n.max(initial=0)) * n_docs < 1 << 63:
        return BASE - SLOPE + SLOPE * n * n_docs // length
    return np.array([BASE - SLOPE + SLOPE * x * n_docs // length for x in n.tolist()], np.int64)


class Best:
    """The k best (score, id) of one item: highest score, then smallest id."""

    def __init__(self, k: int):
        self.k, self.score, self.id = k, np.empty(0, np.int64), np.empty(0, np.int64)

    def floor(self) -> int:
        """No lower score can enter."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        keep = score >= self.floor()
        score, doc = np.concatenate([self.score, score[keep]]), np.concatenate([self.id, doc[keep]])
        order = np.lexsort((doc, -score))[:self.k]
        self.score, self.id = score[order], doc[order]


def masks_of(present: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct presence masks (rows of 0 and 1 by term) of the documents of a terms x documents bitmap, the documents in order of their mask, and where each mask's begin."""
    packed = np.packbits(present, axis=0)
    width = -(-len(packed) // 8) * 8
    keys = np.zeros((present.shape[1], width), np.uint8)
    keys[:, :len(packed)] = packed.T
    whole = keys.view(np.uint64) if width == 8 else keys.view(f"V{width}")
    _, first, of = np.unique(whole.ravel(), return_index=True, return_inverse=True)
    of = of.ravel()
    order = np.argsort(of, kind="stable")
    starts = np.searchsorted(of[order], np.arange(len(first) + 1))
    return np.unpackbits(keys[first], axis=1)[:, :len(present)], order, starts


def search_masks(impact: np.ndarray, doc: np.ndarray, weight: np.ndarray, best: Best) -> int:
    """Add the documents of a terms x documents table of impacts to ``best``; returns how many were scored."""
    masks, order, starts = masks_of(impact > 0)
    bounds = masks.astype(np.int64) @ (weight * impact.max(axis=1).astype(np.int64))
    ranked = np.argsort(-bounds, kind="stable")
    at, scored = 0, 0
    step = best.k
    while at < len(ranked) and bounds[ranked[at]] >= best.floor():
        group, end = [], at
        while end < len(ranked) and len(group) < step and bounds[ranked[end]] >= best.floor():
            group.extend(order[starts[ranked[end]]:starts[ranked[end] + 1]])
            end += 1
        some = np.array(group, np.intp)
        best.add(weight @ impact[:, some].astype(np.int64), doc[some])
        at, step, scored = end, step * 2, scored + len(some)
    return scored


def ranked_in_blocks(index: DataFrame, block: Block, weight: np.ndarray, n_docs: int, length: int, k: int) -> DataFrame:
    """At most k rows an item and partition: _item, part, id, score."""
    size = len(block.vocabulary)
    plan = index.sparkSession.sparkContext.broadcast([
        (number, terms := np.array([t for t in counts if weight[t] > 0], np.intp), np.array([counts[t] * weight[t] for t in terms.tolist()], np.int64))
        for number, counts in block.items
    ])
    rows = max(64, min(4096, CELLS // max(1, size)))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = {number: Best(k) for number, _, _ in plan.value}
        for batch in batches:
            for at in range(0, len(batch), rows):
                part = batch.iloc[at:at + rows]
                term, tf = (np.frombuffer(b"".join(part[c]), np.int32) for c in ("terms", "tf"))
                column = np.repeat(np.arange(len(part)), part["held"])
                tf, m = tf.astype(np.int64), norms(part["n"].to_numpy(), n_docs, length)
                impact = np.zeros((size, len(part)), np.int32)
                impact[term, column] = SCALE * tf // (TF * tf + NORM * m[column])
                doc = part["id"].to_numpy()
                for number, terms, by in plan.value:
                    if len(terms):
                        search_masks(impact[terms], doc, by, best[number])
        part = TaskContext.get().partitionId()
        found = [(number, part, d, s) for number, b in best.items() for d, s in zip(b.id.tolist(), b.score.tolist(), strict=True)]
        yield pd.DataFrame(found, columns=["_item", "part", "id", "score"])

    return index.mapInPandas(search, "_item int, part int, id long, score long")


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    most_items: int = MOST_ITEMS, most_terms: int = MOST_TERMS,
) -> DataFrame:
    """item_id, rank, doc_id, score of each item's k best documents with a score above 0."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text).alias("text"))
    item_type = items.schema[item_id].dataType
    out = spark.createDataFrame([], T.StructType([T.StructField("item_id", item_type), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())]))
    for block, ids in blocks_of(items.select(item_id, item_text), most_items, most_terms):
        if not block.vocabulary:
            continue
        index = durable(forward_index(docs, block.vocabulary))
        n_docs, length, df = count_terms(index, len(block.vocabulary))
        weight = np.array([math.floor(WEIGHT * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        found = ranked_in_blocks(index, block, weight, n_docs, length, k)
        order = [F.col("score").desc(), F.col("id")]
        groups = max(1, math.isqrt(index.rdd.getNumPartitions()))
        near = Window.partitionBy("_item", F.col("part") % groups).orderBy(*order)
        found = found.withColumn("_n", F.row_number().over(near)).where(F.col("_n") <= k)
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("_item").orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(ids)), T.StructType([T.StructField("_item", T.IntegerType()), T.StructField("item_id", item_type)]))
        out = out.unionByName(
            found.join(F.broadcast(names), "_item").select("item_id", "rank", F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "score")
        )
    return out
