"""SentencePiece encoding by forward-filtering backward-sampling, and lossless decoding.

The lattice of a text has an edge for each piece of the model that fits, and the
bytes of a character that no piece holds.  An edge's weight is a Zipf law of the
piece's rank, to the power ``alpha``.  Forward filtering sums the weights of all
ways to each position; backward sampling then draws a segmentation with its exact
probability.  No piece crosses from a non-blank to a blank, so the lattice falls
apart into chunks that are filtered once and sampled many times.  Random numbers
come from the row key and the chunk's number alone: any partitioning, retry or
lost executor gives the same ids.

Edge cases: a null text gives null ids, an empty one none; blanks, line breaks,
U+2581 and characters outside the vocabulary survive decoding unchanged; rows with
equal key and text get equal ids; a null key counts as the key ''.
"""
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import mix64

CHUNKS = re.compile(r" +[^ \n]*|[^ \n]+|\n")
GOLDEN = 0x9E3779B97F4A7C15
#: Chunks up to these lengths are filtered together, in one matrix for each length; longer ones one by one.
LENGTHS = (4, 8, 12, 20, 32)
#: Chunks handled at once: bounds the matrices.
CHUNKS_AT_ONCE = 150_000


class PieceTable:
    """The pieces of a model, found by a rolling hash of their code points: hash table slots, the rare collisions in a dict-like second table."""

    SLOT_BITS = 19

    def __init__(self, model_path: str, alpha: float = 1.0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = self.size = model.vocab_size()
        self.bytes: list[bytes] = [b""] * size
        self.byte_ids: dict[int, int] = {}
        self.weights = np.zeros(size + 1)
        self.ids: dict[str, int] = {}
        for i in range(size):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:5], 16)
                self.byte_ids[value], self.bytes[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i)):
                piece = model.id_to_piece(i).replace("▁", " ")
                self.bytes[i] = piece.encode()
                self.ids[piece] = i
                self.weights[i] = (1.0 / (min(-model.get_score(i), size) + 3)) ** alpha
        #: A character without a piece has one way only, so its weight does not matter.
        self.fallback = 1.0 / size
        self.longest = max(map(len, self.ids))
        if not all(re.fullmatch(r" *[^ \n]*|\n", piece) for piece in self.ids):
            raise ValueError("the model has pieces that go on behind a blank or a line break, where texts are cut")
        self.keys = np.zeros(size + 1, np.uint64)
        for piece, i in self.ids.items():
            key = 0
            for c in piece:
                key = (key * GOLDEN + ord(c) + 1) & ((1 << 64) - 1)
            self.keys[i] = key
        self.slots = [np.full(1 << self.SLOT_BITS, size, np.int32) for _ in range(3)]
        left = np.array(sorted(self.ids.values()))
        for k, slots in enumerate(self.slots):
            at = self.slot(self.keys[left], k)
            slots[at] = left
            left = left[slots[at] != left]
        if len(left):
            raise ValueError("the model has pieces that the hash table cannot hold")
        self.used = [k for k, slots in enumerate(self.slots) if (slots != size).any()]

    def slot(self, keys: np.ndarray, k: int) -> np.ndarray:
        return (keys * np.uint64(0xD1342543DE82EF95 + 2 * k * 0x2545F491) >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes; ``size`` where there is none."""
        out = self.slots[0][self.slot(keys, 0)]
        out[self.keys[out] != keys] = self.size
        for k in self.used[1:]:
            miss = np.flatnonzero(out == self.size)
            found = self.slots[k][self.slot(keys.ravel()[miss] if keys.ndim == 1 else keys.reshape(-1)[miss], k)]
            found[self.keys[found] != keys.reshape(-1)[miss]] = self.size
            out.reshape(-1)[miss] = found
        return out


def uniforms(seeds: np.ndarray) -> np.ndarray:
    return (mix64(seeds) >> np.uint64(11)).astype(np.float64) * 2.0**-53


class PieceSampler:
    """Encodes and decodes whole texts."""

    def __init__(self, table: PieceTable, seed: int = 0):
        self.table, self.seed = table, seed

    def filtered(self, chunks: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Forward filtering of chunks of at most ``width`` characters.

        (sums, ids) by chunk, end position and piece length - 1: sums are running totals
        of the weights of all ways through the edges of up to that length.
        """
        table, n, most = self.table, len(chunks), min(width, self.table.longest)
        points = np.frombuffer("".join(c.ljust(width, "\n") for c in chunks).encode("utf-32-le", "surrogatepass"), "<u4").reshape(n, width).astype(np.uint64) + np.uint64(1)
        ids = np.full((n, width + 1, most), table.size, np.int32)
        keys = np.zeros((n, width), np.uint64)
        for length in range(1, most + 1):
            # The hash of the piece of this length that ends at each position.
            if length == 1:
                keys = points.copy()
                old = keys
            else:
                # prepend a character: key = first * G^(length-1) + key of the rest
                keys = points[:, : width - length + 1] * np.uint64(pow(GOLDEN, length - 1, 1 << 64)) + old[:, 1:]
                old = keys
            ids[:, length:, length - 1] = table.find(keys)
        single = ids[:, 1:, 0]
        lost = single == table.size
        ways = np.zeros((n, width + 1))
        ways[:, 0] = 1.0
        weight = table.weights[ids]
        weight[:, 1:, 0][lost] = table.fallback
        if lost.any():
            single[lost] = table.size + 1 + (points[lost] - np.uint64(1)).astype(np.int32)
        for i in range(1, width + 1):
            reach = min(i, most)
            weight[:, i, :reach] *= ways[:, i - 1::-1][:, :reach]
            np.cumsum(weight[:, i], axis=1, out=weight[:, i])
            ways[:, i] = weight[:, i, -1]
        return weight, ids

    def sampled(self, chunks: list[str], which: np.ndarray, seeds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward sampling of occurrences ``which`` of chunks: (occurrence, piece number from the end, id)."""
        sums, ids = self.filtered(chunks, width)
        at = np.array([len(c) for c in chunks])[which]
        live = np.arange(len(which))
        out = []
        step = 0
        while len(live):
            row, end = which[live], at[live]
            ways = sums[row, end]
            x = uniforms(seeds[live] + np.uint64(step * GOLDEN & (1 << 64) - 1)) * ways[:, -1]
            length = np.minimum((ways <= x[:, None]).sum(1), ways.shape[1] - 1)
            out.append((live, np.full(len(live), step), ids[row, end, length]))
            at[live] -= length + 1
            live = live[at[live] > 0]
            step += 1
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def sampled_long(self, chunk: str, seed: int) -> list[int]:
        """The same for one chunk of any length: only the ratios between the ways into a position count, so they are rescaled as they shrink."""
        table, n, edges = self.table, len(chunk), []
        ways = [1.0]
        for end in range(1, n + 1):
            if ways[-1] < 1e-200:
                ways = ways[:-table.longest] + [w * 1e200 for w in ways[-table.longest:]]
            into = []
            for start in range(max(0, end - table.longest), end):
                i = table.ids.get(chunk[start:end])
                if i is not None:
                    into.append((ways[start] * table.weights[i], start, i))
            if chunk[end - 1] not in table.ids:
                into.append((ways[end - 1] * table.fallback, end - 1, table.size + 1 + ord(chunk[end - 1])))
            into.reverse()  # short pieces first
            edges.append(into)
            ways.append(sum(w for w, _, _ in into))
        out, at, step = [], n, 0
        draws = uniforms(np.uint64(seed) + np.arange(n, dtype=np.uint64) * np.uint64(GOLDEN)).tolist()
        while at:
            x = draws[step] * sum(w for w, _, _ in edges[at - 1])
            for w, before, i in edges[at - 1]:
                if x < w:
                    break
                x -= w
            out.append(i)
            at, step = before, step + 1
        return out[::-1]

    def encode(self, keys: list[str], texts: list[str]) -> Iterator[np.ndarray]:
        """Of each text, its ids."""
        group: list[tuple[str, list[str]]] = []
        for key, text in zip(keys, texts, strict=True):
            group.append((key, CHUNKS.findall(" " + text) if text else []))  # the model starts a text with a blank
            if sum(len(c) for _, c in group[-1:]) and sum(len(c) for _, c in group) >= CHUNKS_AT_ONCE:
                yield from self._encode(group)
                group = []
        yield from self._encode(group)

    def _encode(self, group: list[tuple[str, list[str]]]) -> Iterator[np.ndarray]:
        sizes = np.array([len(c) for _, c in group], np.int64)
        place: dict[str, int] = {}
        which = np.fromiter((place.setdefault(c, len(place)) for _, chunks in group for c in chunks), np.int64, sizes.sum())
        kinds = list(place)
        with np.errstate(over="ignore"):
            bases = np.array([xxhash.xxh64_intdigest(k.encode("utf-8", "surrogatepass"), self.seed) for k, _ in group], np.uint64)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            seeds = mix64(np.repeat(bases, sizes) + (nth + 1).astype(np.uint64) * np.uint64(GOLDEN))
        lengths = np.array([len(c) for c in kinds], np.int64)
        found = []
        low = 0
        for width in LENGTHS:
            own = np.flatnonzero((lengths > low) & (lengths <= width))
            low = width
            for part in np.array_split(own, max(1, len(own) * width * width // 4_000_000)):
                if len(part):
                    number = np.full(len(kinds), -1)
                    number[part] = np.arange(len(part))
                    occ = np.flatnonzero(number[which] >= 0)
                    who, step, ids = self.sampled([kinds[k] for k in part], number[which[occ]], seeds[occ], width)
                    found.append((occ[who], step, ids))
        for occ in np.flatnonzero(lengths[which] > LENGTHS[-1]) if len(which) else []:
            ids = self.sampled_long(kinds[which[occ]], int(seeds[occ]))
            found.append((np.full(len(ids), occ), np.arange(len(ids))[::-1], np.array(ids)))
        if not found:
            yield from (np.empty(0, "<u4") for _ in group)
            return
        occ, step, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        pieces = np.bincount(occ, minlength=len(which))
        out = np.empty(len(ids), np.int64)
        out[np.cumsum(pieces)[occ] - 1 - step] = ids
        ends = np.concatenate([[0], np.cumsum(pieces)])[np.cumsum(sizes)]
        for start, end in zip([0, *ends[:-1]], ends, strict=True):
            own = out[start:end]
            if (own > self.table.size).any():
                own = np.array([x for i in own.tolist() for x in ([i] if i < self.table.size else map(self.table.byte_ids.__getitem__, chr(i - self.table.size - 1).encode("utf-8", "surrogatepass")))])
            yield own.astype("<u4")

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.table.bytes.__getitem__, ids.tolist()))
        return raw.decode("utf-8", "surrogatepass")[1:]


def encode_sampled(df: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """Adds ids array<int>: a segmentation drawn for each row from its key."""

    @F.pandas_udf("array<int>")
    def encoded(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        sampler = PieceSampler(PieceTable(model_path, alpha), seed)
        for keys, texts in batches:
            found = sampler.encode([k or "" for k in keys], [t or "" for t in texts])
            yield pd.Series([None if t is None else ids.astype(np.int32) for t, ids in zip(texts, found, strict=True)])

    return df.withColumn("ids", encoded(F.col(key).cast("string"), F.col(text)))


def decode_ids(df: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """Adds decoded: the text that ``ids`` encode."""

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sampler = PieceSampler(PieceTable(model_path))
        for rows in batches:
            yield pd.Series([None if x is None else sampler.decode(np.asarray(x)) for x in rows])

    return df.withColumn("decoded", decoded(F.col(ids)))


def encoding_digest(df: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """Adds n_ids, ids_crc32 and lossless (the ids decode to the whole text again); ids are made and read back in one pass."""

    @F.pandas_udf("n_ids long, ids_crc32 long, lossless boolean")
    def digested(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        sampler = PieceSampler(PieceTable(model_path, alpha), seed)
        for keys, texts in batches:
            rows = []
            for t, ids in zip(texts, sampler.encode([k or "" for k in keys], [t or "" for t in texts]), strict=True):
                rows.append((len(ids), zlib.crc32(ids.tobytes()), sampler.decode(ids) == (t or "")))
            yield pd.DataFrame(rows, columns=["n_ids", "ids_crc32", "lossless"])

    return df.withColumn("_d", digested(F.col(key).cast("string"), F.col(text))).select(*df.columns, "_d.*")
