"""Best-fit packing by minimum bin slack.

Documents are tokenised and cut where they are longer than a sequence.  Which
lengths share a sequence is planned on the histogram of lengths alone (at most
``capacity`` numbers, whatever the corpus): the longest length left opens a bin, a
bitset subset-sum over the lengths left finds the fullest completion, and that
combination is taken as often as the counts allow.  Pieces then find their place
from their rank within their length; ranks are counted per (length, bucket) and
shifted by the buckets before, so that a length which most documents have is not
ranked in one task.

Edge cases: a null text counts as empty; a document always ends with
``end_id``, so an empty one is one token; equal documents are packed one by one;
an empty table gives no rows; a null id stays null; other columns are not carried.
"""
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm.common import durable

#: Words a worker remembers the ids of.
CACHED_WORDS = 500_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: How the tokenizer cuts a normalised word before its merges; fixed by the tokenizer's file.
CUT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Words of these characters alone are in normal form and lower-cased character by character.
PLAIN = re.compile(r"[!-~\u00A1-\u012F\u0131-\u0148\u014A-\u017E]+")


def byte_symbols() -> list[str]:
    """The character by which byte-level vocabularies write each byte: itself if it prints, else the next one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(other)) for b in range(256)]


class WordTokenizer:
    """Ids of whole texts.  No token of the tokenizer spans a blank or a line break, so texts are encoded word by word, each word once.

    Plain words are cut here and only their parts go to the tokenizer's merges; any other word goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.merges = self.encoder.model
        self.symbols = byte_symbols()
        self.ids: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def of_part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            if len(self.parts) >= CACHED_WORDS:
                self.parts.clear()
            tokens = self.merges.tokenize(part if part.isascii() else "".join(map(self.symbols.__getitem__, part.encode())))
            found = self.parts[part] = b"".join([t.id.to_bytes(4, "little") for t in tokens])
        return found

    def of_word(self, word: str) -> bytes:
        if "<|" not in word and PLAIN.fullmatch(word):
            lower = word.lower() if word.isascii() else "".join(map(str.lower, word))
            if lower.isalpha():
                return self.of_part(lower)
            if lower[:-1].isalpha() and lower[-1] in ".,!?;:":
                return self.of_part(lower[:-1]) + self.of_part(lower[-1])
            return b"".join(map(self.of_part, CUT.findall(lower)))
        return np.array(self.encoder.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Of each text, little-endian unsigned 32-bit ids."""
        known = self.ids
        for text in texts:
            words = text.replace("\n", " ").split(" ")
            new = set(words).difference(known)
            if len(known) + len(new) > CACHED_WORDS:
                known.clear()
                new = set(words)
            for word in new:
                known[word] = self.of_word(word) if word else b""
            yield b"".join(map(known.__getitem__, words))


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """A row for each piece of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = WordTokenizer(tokenizer_path)
        for batch in batches:
            rows = []
            texts = ["" if t is None else t for t in batch["text"]]
            for doc_id, ids in zip(batch["doc_id"].astype("Int64"), tokenizer.encode(texts), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(cut, PIECES)


def fullest(left: dict[int, int], room: int, order: list[int]) -> dict[int, int]:
    """The multiset of available lengths with the largest sum up to ``room``: subset sums as bits of one integer."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in order:
        count = min(left.get(length, 0), room // length)
        take = 1
        while count > 0 and not reach >> room & 1:
            take = min(take, count)
            steps.append((length, take, reach))
            reach |= reach << (take * length) & mask
            count -= take
            take *= 2
    total, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= take * length
    return chosen


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(combination, times): minimum bin slack over a histogram of lengths."""
    left = {length: n for length, n in histogram.items() if n > 0}
    order, out = sorted(left, reverse=True), []
    for first in order:
        while left.get(first, 0):
            left[first] -= 1
            combination = fullest(left, capacity - first, [x for x in order if x <= capacity - first and left.get(x)])
            left[first] += 1
            combination[first] = combination.get(first, 0) + 1
            times = min(left[x] // n for x, n in combination.items())
            for x, n in combination.items():
                left[x] -= n * times
            out.append((combination, times))
    return out


def place_pieces(pieces: DataFrame, capacity: int = 2048, rows_per_bucket: int = 20_000) -> DataFrame:
    """Adds sequence_id and offset to pieces; ``pieces`` is read three times and should be a written table."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    buckets = max(64, sum(histogram.values()) // rows_per_bucket)
    used: dict[int, int] = {}
    spans, bins = [], 0
    for combination, times in plan_bins(histogram, capacity):
        offset = 0
        for length, n in sorted(combination.items(), reverse=True):
            spans.append((length, used.get(length, 0), n, bins, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        bins += times
    spans.sort()
    plan = pieces.sparkSession.sparkContext.broadcast(np.array(spans, np.int64).reshape(-1, 5))

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank, spans = length.to_numpy(), rank.to_numpy(), plan.value
        at = np.searchsorted(spans[:, 0] << 40 | spans[:, 1], length << 40 | rank, side="right") - 1
        _, first, n, base, offset = spans[at].T
        turn, nth = np.divmod(rank - first, n)
        return pd.DataFrame({"sequence_id": base + turn, "offset": offset + nth * length})

    keyed = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    sizes = keyed.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = sizes.select("length", "_bucket", (F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    ranked = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")) - 1)
    return (
        ranked.join(before, ["length", "_bucket"])
        .withColumn("_place", placed("length", F.col("_before") + F.col("_rank")))
        .select(*pieces.columns, "_place.sequence_id", "_place.offset")
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return place_pieces(durable(tokenized_pieces(docs, tokenizer_path, capacity, end_id)), capacity)
