"""Near-duplicates by BagMinHash over the multiset of word shingles.

Signatures: a shingle with count c draws, for each dyadic range of weights
[0, 1), [1, 2), [2, 4), ... that c reaches, the points of a Poisson process whose
rate is the range's width; every point falls on one of ``m`` components and at one
weight of its range, and counts if that weight is below c.  A component keeps its
earliest point, so two documents agree in it with a probability equal to their
weighted Jaccard similarity.  Points are only generated up to the time at which the
slowest component is likely filled (and on from there if it is not), for all texts of a
batch at once.

Candidates share a band of components.  Exact copies are one document from the start.

1. Every document meets the smallest id of each bucket it lies in; the multiset overlap of
   these pairs is verified on whole texts and classes are formed.  That settles buckets whose
   texts all resemble one of them, however large.
2. Rows of buckets that still hold several classes meet in groups of at most two blocks of
   ``BLOCK`` rows, as sketches of a byte a component.  Each row names its ``PARTNERS`` most
   agreeing partners of other classes, and these pairs are verified: what is made grows with the
   rows, not with the square of a bucket.
3. Rows that even then have an untested partner of another class have their texts brought
   together block by block, and the overlaps of all pairs come from products of shingle matrices;
   only links that join two classes leave the task.

Nothing depends on how rows are dealt to partitions.  Steps 2 and 3 pass over pairs that agree
in fewer components than all but one in ``MISSED`` pairs at the threshold do, and take a pair in the first
band that it shares only; a link at exactly 0.8 is lost by the bands with probability 3e-6 and so with 4e-6 in all.

Edge cases: words are ``[^\\x20\\x09-\\x0D]+``; a text of fewer words than a shingle is
one shingle; null texts and texts without words are near nothing, each its own
class; rows without an id are not listed (and kept by ``keep_one_of_each``); repeated ids with equal text are one document; an empty table gives no rows;
other columns are ignored.
"""
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import bounded_batches, discard, durable, gram_hashes, in_parts, mix64, word_hashes
from evigraph.operators.components import connected_components

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 24, 4
#: Sketches of a block of a large bucket, and the best partners that each row names.
BLOCK, PARTNERS = 1024, 2
#: One in so many pairs at the threshold agrees in fewer components than step 2 asks for.
MISSED = 1_000_000
#: Shingles of the texts of a block of a large bucket, and of one matrix product.
SHINGLES, COLUMNS = 200_000, 2048
#: Words of the texts that are signed at once.
BATCH_WORDS = 250_000
KEY_BITS = 54
KEY_MASK = np.uint64(2**KEY_BITS - 1)


class ShingleHasher:
    """Shingles of a text as sorted 64-bit hashes with their counts."""

    def __init__(self, size: int = SHINGLE):
        self.size = size

    def bags(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, counts, text): the shingles of up to 1,024 texts, ordered by text; keys have 54 bits."""
        words, sizes = word_hashes(texts)
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
        left = np.repeat(ends, sizes) - np.arange(len(owner))  # words from here to the text's end
        flat = np.concatenate([words, np.zeros(self.size, np.uint64)])
        grams = np.zeros(len(owner), np.uint64)
        for k in range(self.size):
            grams = mix64(grams + np.uint64(0x9E3779B97F4A7C15) + flat[k:k + len(owner)])
        whole = left >= self.size
        short = [k for k in np.flatnonzero((sizes > 0) & (sizes < self.size))]
        keys = np.concatenate([grams[whole], np.array([gram_hashes(words[ends[k] - sizes[k]:ends[k]], self.size)[0] for k in short], np.uint64)])
        owner = np.concatenate([owner[whole], np.array(short, np.uint64)])
        found = np.sort((owner << np.uint64(KEY_BITS)) | (keys & KEY_MASK))
        if not len(found):
            return found, np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
        return found[at] & KEY_MASK, np.diff(np.append(at, len(found))), (found[at] >> np.uint64(KEY_BITS)).astype(np.int64)

    def all_bags(self, texts: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``bags``, for any number of texts."""
        parts = in_parts(texts.str.len().fillna(0).to_numpy(np.int64), 6 * BATCH_WORDS, 1000)
        found = [self.bags(texts.iloc[part]) for part in parts]
        return tuple(np.concatenate([f[k] + part.start if k == 2 else f[k] for f, part in zip(found, parts, strict=True)]) for k in range(3))

    def bag(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        return self.bags([text])[:2]


def bag_min_hashes(keys: np.ndarray, counts: np.ndarray, text: np.ndarray, n: int, m: int) -> np.ndarray:
    """Earliest point of each of ``m`` components of ``n`` texts, as float64 bits; rows of texts without shingles are of no meaning."""
    out = np.full((n, m), np.inf)
    weight = np.bincount(text, counts, n)
    until = (np.log(m) + 3) / np.maximum(weight, 1)
    while len(keys):
        level = np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64)  # the top range that a count reaches
        own = np.repeat(np.arange(len(keys)), level + 1)
        rank = np.arange(len(own)) - np.repeat(np.cumsum(level + 1) - level - 1, level + 1)
        low = np.where(rank == 0, 0, 2.0 ** (rank - 1))
        wide = np.maximum(low, 1.0)
        seed = mix64(keys[own] + rank.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        at, limit, place = np.zeros(len(own)), counts[own], text[own]
        end = until[place]
        while len(at):
            seed = mix64(seed + np.uint64(0x9E3779B97F4A7C15))
            at = at - np.log(((seed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (m * wide)
            live = np.flatnonzero(at < end)
            at, seed, wide, low, limit, place, end = at[live], seed[live], wide[live], low[live], limit[live], place[live], end[live]
            draw = mix64(seed ^ np.uint64(0x5851F42D4C957F2D))
            hit = np.flatnonzero(low + wide * ((draw >> np.uint64(32)).astype(np.float64) * 2.0**-32) < limit)
            np.minimum.at(out.reshape(-1), place[hit] * m + ((draw[hit] & np.uint64(0xFFFFFFFF)) % np.uint64(m)).astype(np.int64), at[hit])
        open_ = (~np.isfinite(out)).any(1)
        again = open_[text]
        keys, counts, text = keys[again], counts[again], text[again]
        until = until * 2
    return out.view(np.uint64)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each text and band; ``signatures`` has a row a text."""
    parts = signatures[:, :bands * rows].reshape(-1, bands, rows)
    out = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=np.uint64)), parts.shape[:2])
    for k in range(rows):
        out = mix64(out + np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return out.view(np.int64)


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """(doc_id, copy_key, n, bands, sketch): n shingles, band keys (none where there are no words) and the low byte of each component."""
    m = bands * rows

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = ShingleHasher(size)
        for batch in batches:
            for part in in_parts(batch["text"].str.len().fillna(0).to_numpy(np.int64), 6 * BATCH_WORDS, 1000):
                own = batch.iloc[part]
                keys, counts, text = hasher.bags(own["text"])
                n = np.bincount(text, counts, len(own)).astype(np.int64)
                signature = bag_min_hashes(keys, counts, text, len(own), m)
                found, sketches = band_keys(signature, bands, rows), signature.astype(np.uint8)
                none = np.empty(0, np.int64)
                yield pd.DataFrame({"doc_id": own["doc_id"].to_numpy(), "copy_key": own["copy_key"].to_numpy(), "n": n, "bands": [x if k else none for x, k in zip(found, n, strict=True)], "sketch": [x.tobytes() if k else b"" for x, k in zip(sketches, n, strict=True)]})

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text", F.md5(F.col("text").cast("binary")).alias("copy_key")).mapInPandas(signed, "doc_id long, copy_key string, n long, bands array<long>, sketch binary")


def fewest_agreeing(threshold: float, m: int, missed: int = MISSED) -> int:
    """All but one in ``missed`` pairs of similarity ``threshold`` agree in so many of ``m`` components."""
    below = 0.0
    for k in range(m + 1):
        below += math.comb(m, k) * threshold**k * (1 - threshold) ** (m - k)
        if below > 1 / missed:
            return k
    return m


def best_partners(doc: np.ndarray, label: np.ndarray, n: np.ndarray, sketch: np.ndarray, own: np.ndarray, across: bool, band: int, band_rows: int, threshold: float, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, partner, agreement) of the rows of one bucket of ``band``: partners of another class that agree enough, meet in this band first and whose sizes allow the threshold; ``across``: in the other block only."""
    classes, often = np.unique(label, return_counts=True)
    minor = np.flatnonzero(label != classes[often.argmax()])  # rows of the commonest class have no pair among them
    for low in range(0, len(minor), 64):
        x = minor[low:low + 64]
        equal = sketch[x][:, None, :] == sketch[None]
        agree = equal.sum(2, dtype=np.int16)
        fit = (agree >= least) & (label[x][:, None] != label[None]) & (np.minimum(n[x][:, None], n[None]) >= threshold * np.maximum(n[x][:, None], n[None]))
        if across:
            fit &= own[x][:, None] != own[None]
        i, j = np.nonzero(fit)
        if band and len(i):
            before = equal[i, j, :band * band_rows].reshape(len(i), band, band_rows).all(2).any(1)
            i, j = i[~before], j[~before]
        if len(i):
            yield x[i], j, agree[i, j]


def in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Deals the rows of each bucket, which has ``size``, to blocks of about ``block``: each two blocks, and so each two rows, meet in one group (bucket, x, y)."""
    dealt = rows.withColumn("_of", F.ceil(F.col("size") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("doc"), "_of").cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)))
    return dealt.withColumn("x", F.least("own", "_other")).withColumn("y", F.greatest("own", "_other")).drop("_of", "_other")


def in_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows as one frame for each (bucket, x, y), which batches may cut."""
    rest = None
    for batch in batches:
        now = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        key = now[["bucket", "x", "y"]].to_numpy()
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1)]
        for a, b in zip(cuts, cuts[1:]):
            yield now.iloc[a:b]
        rest = now.iloc[cuts[-1]:]
    if rest is not None and len(rest):
        yield rest


def partners(rows: DataFrame, threshold: float, bands: int, band_rows: int, most: int | None) -> DataFrame:
    """What is left to compare in mixed buckets.  rows: (bucket, band, doc, label, n, sketch, size).

    With ``most``: (a, b), a > b, the most agreeing pairs of each row, so many of them.
    Without: (bucket, doc, n) of all rows that have such a partner, and those partners.
    """
    least, m = fewest_agreeing(threshold, bands * band_rows), bands * band_rows

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in in_groups(batches):
            doc, label, n, own = (group[c].to_numpy() for c in ("doc", "label", "n", "own"))
            if (label == label[0]).all():
                continue
            sketch = np.frombuffer(b"".join(group["sketch"]), np.uint8).reshape(len(group), m)
            bucket, band, x, y = group.iloc[0][["bucket", "band", "x", "y"]]
            for i, j, agree in best_partners(doc, label, n, sketch, own, x != y, int(band), band_rows, threshold, least):
                if most is None:
                    both = np.union1d(i, j)
                    yield pd.DataFrame({"bucket": bucket, "doc": doc[both], "n": n[both]})
                else:
                    order = np.lexsort((doc[j], -agree, i))
                    i, j = i[order], j[order]
                    start = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
                    rank = np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i))))
                    p, q = doc[i[rank < most]], doc[j[rank < most]]
                    yield pd.DataFrame({"a": np.maximum(p, q), "b": np.minimum(p, q)})

    dealt = in_blocks(rows, BLOCK).repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "doc")
    return dealt.mapInPandas(compared, "bucket long, doc long, n int" if most is None else "a long, b long").distinct()


def overlaps(keys: np.ndarray, counts: np.ndarray, text: np.ndarray, n: int, some: np.ndarray) -> np.ndarray:
    """Multiset overlap of ``some`` of ``n`` bags with each other bag: a shingle of count c is c different ones, and a product of 0-1 matrices counts what is common."""
    rank = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    token, owner = mix64(np.repeat(keys, counts) + rank.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)), np.repeat(text, counts)
    _, column, often = np.unique(token, return_inverse=True, return_counts=True)
    shared = often[column] > 1
    column, owner = (np.cumsum(often > 1) - 1)[column[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(some), n), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        own = slice(*np.searchsorted(column, [low, low + COLUMNS]))
        matrix = np.zeros((n, COLUMNS), np.float32)
        matrix[owner[own], column[own] - low] = 1
        out += matrix[some] @ matrix.T
    return out


def exact_links(rows: DataFrame, texts: DataFrame, threshold: float, size: int) -> DataFrame:
    """(a, b, similarity), a > b: verified links that join all classes of a bucket that any pair of its texts joins.  rows: (bucket, doc, label, size), size: the shingles of the bucket's rows."""

    def decided(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        doc, label, own = (group[c].to_numpy() for c in ("doc", "label", "own"))
        out = []
        if (label != label[0]).any():
            keys, counts, text = ShingleHasher(size).all_bags(group["text"])
            n, (classes, often) = np.bincount(text, counts, len(group)), np.unique(label, return_counts=True)
            minor = np.flatnonzero(label != classes[often.argmax()])  # rows of the commonest class have no pair among them
            both = overlaps(keys, counts, text, len(group), minor)
            joined: dict[int, int] = {}

            def root(x: int) -> int:
                while x in joined:
                    x = joined[x]
                return x

            for x, common in zip(minor, both, strict=True):
                alike = common / (n[x] + n - common.astype(np.float64))
                fit = (alike >= threshold) & (label[x] != label)
                if key[1] != key[2]:
                    fit &= own[x] != own
                for y in np.flatnonzero(fit):
                    p, q = root(int(label[x])), root(int(label[y]))
                    if p != q:
                        joined[max(p, q)] = min(p, q)
                        out.append((max(doc[x], doc[y]), min(doc[x], doc[y]), float(alike[y])))
        return pd.DataFrame(out, columns=["a", "b", "similarity"])

    dealt = in_blocks(rows, SHINGLES).select("bucket", "x", "y", "doc", "label", "own")
    return dealt.join(texts.withColumnRenamed("doc_id", "doc"), "doc").groupBy("bucket", "x", "y").applyInPandas(decided, "a long, b long, similarity double").dropDuplicates(["a", "b"])


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float, size: int) -> DataFrame:
    """The pairs (a, b) whose multiset Jaccard similarity is at least the threshold, with it."""

    @F.pandas_udf("double")
    def similarity(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        hasher = ShingleHasher(size)
        for left, right in batches:
            bags: dict[str, tuple[np.ndarray, np.ndarray]] = {}
            out = []
            for x, y in zip(left, right, strict=True):
                if y not in bags:
                    if len(bags) > 50:
                        bags.clear()
                    bags[y] = hasher.bag(y)
                (k1, n1), (k2, n2) = hasher.bag(x), bags[y]
                _, i, j = np.intersect1d(k1, k2, assume_unique=True, return_indices=True)
                both = np.minimum(n1[i], n2[j]).sum()
                out.append(both / (n1.sum() + n2.sum() - both))
            yield pd.Series(out, dtype="float64")

    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("_ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("_tb"))
    scored = pairs.join(left, "a").join(right, "b").select("a", "b", similarity("_ta", "_tb").alias("similarity"))
    return scored.where(F.col("similarity") >= threshold)


def near_links(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(copies, links, classes): copies maps each doc_id to the smallest of its exact copies; links are verified pairs (a > b) of those, enough of them to join all of a class; classes (doc, label) lists linked ones."""
    bounded_batches(docs.sparkSession)
    signed = durable(signatures(docs, bands, rows, size))
    worded = signed.where(F.size("bands") > 0)
    first = worded.groupBy("copy_key").agg(F.min("doc_id").alias("copy_of"))
    copies = worded.select("doc_id", "copy_key").join(first, "copy_key").select("doc_id", "copy_of").distinct()
    alone = signed.where(F.size("bands") == 0).select("doc_id", F.col("doc_id").alias("copy_of")).distinct()
    copies = durable(copies.unionByName(alone))
    heads = worded.join(first.select(F.col("copy_of").alias("doc_id")), "doc_id", "left_semi")
    keyed = heads.select(F.col("doc_id").alias("doc"), F.col("n").cast("int").alias("n"), F.posexplode("bands").alias("band", "bucket"))
    shared = keyed.groupBy("bucket").agg(F.min(F.struct("doc", "n")).alias("low"), F.max("doc").alias("high"), F.count("*").alias("size")).where("low.doc < high").select("bucket", F.col("low.doc").alias("low"), F.col("low.n").alias("low_n"), "size")
    buckets = durable(keyed.join(shared, "bucket"))
    wanted = buckets.select(F.col("doc").alias("doc_id")).distinct()
    texts = durable(docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]))

    def labels(links: DataFrame) -> DataFrame:
        return connected_components(links, "a", "b").select(F.col("id").alias("doc"), F.col("component").alias("label"))

    def mixed(rows: DataFrame, classes: DataFrame) -> DataFrame:
        """The rows of buckets of more than one class, each with its own."""
        own = rows.drop("label").join(classes, "doc", "left").withColumn("label", F.coalesce("label", "doc"))
        several = own.groupBy("bucket").agg(F.min("label").alias("_x"), F.max("label").alias("_y")).where("_x < _y").select("bucket")
        return durable(own.join(several, "bucket", "left_semi"))

    allowed = F.least("n", "low_n") >= threshold * F.greatest("n", "low_n")
    tested = durable(buckets.where((F.col("doc") != F.col("low")) & allowed).select(F.col("doc").alias("a"), F.col("low").alias("b")).distinct())
    links = durable(_verified(tested, texts, threshold, size))
    classes = labels(links)
    # In a bucket of two, both have met.
    open_ = mixed(buckets.where("size > 2").drop("low", "low_n"), classes)
    sketched = open_.join(signed.select(F.col("doc_id").alias("doc"), "sketch").dropDuplicates(["doc"]), "doc")
    best = durable(partners(sketched, threshold, bands, rows, PARTNERS).join(tested, ["a", "b"], "left_anti"))
    done = [signed, buckets, texts, tested, open_, best]
    if not best.isEmpty():
        links = durable(links.unionByName(_verified(best, texts, threshold, size)))
        classes = labels(links)
        sketched = mixed(sketched, classes)
        done.append(sketched)
    left = durable(partners(sketched, threshold, bands, rows, None))
    if not left.isEmpty():
        of = left.groupBy("bucket").agg(F.sum("n").alias("size"))
        found = durable(exact_links(left.join(of, "bucket").join(classes, "doc", "left").withColumn("label", F.coalesce("label", "doc")), texts, threshold, size))
        links = durable(links.unionByName(found))
        classes = labels(links)
        done.append(found)
    discard(*done, left)
    return copies, links, classes


def near_duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """One row per doc_id: class_id (smallest id of its class), copy_of (smallest exact copy) and n_links (verified links of that copy that were needed)."""
    copies, links, classes = near_links(docs, threshold, bands, rows, size)
    degree = links.select(F.explode(F.array("a", "b")).alias("copy_of")).groupBy("copy_of").agg(F.count("*").alias("n_links"))
    known = classes.select(F.col("doc").alias("copy_of"), F.col("label").alias("class_id")).join(degree, "copy_of", "left")
    return copies.join(known, "copy_of", "left").select("doc_id", F.coalesce("class_id", "copy_of").alias("class_id"), "copy_of", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without all but the smallest id of each class, with their own columns."""
    gone = near_duplicate_classes(docs, threshold).where("doc_id <> class_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
