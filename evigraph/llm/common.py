"""Helpers that several corpus operators share."""
import contextlib
import contextvars
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from evigraph.operators.components import shared_dir

#: ASCII white space, the only characters that separate words here.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The lists that ``recorded`` keeps in this thread.
_record: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("recorded", default=())


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/evigraph/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    for paths in _record.get():
        paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of the tables that ``durable`` writes meanwhile in this thread."""
    paths: list[str] = []
    before = _record.set((*_record.get(), paths))
    try:
        yield paths
    finally:
        _record.reset(before)


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete tables that nothing reads any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop(path), True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``durable`` from which all that follows has been written."""
    for table_ in tables:
        remove(table_.sparkSession, [table_._written_to])


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts of any length go to Python: hold the rows of an Arrow batch down, so that a batch of long ones fits."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, str(rows))


def byte_words(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8: ``bytes.split`` splits at just these characters."""
    return text.encode("utf-8", "surrogatepass").split()


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser, a bijection on 64 bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bytes that are hashed at once; a longer text is cut at white space.
PIECE = 1 << 20
_SPACE = np.isin(np.arange(256), list(ASCII_SPACE.encode()))
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64))
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans of ``values`` (uint64): a polynomial, from differences of prefix sums modulo 2^64, so alike wherever a span lies."""
    if not _powers or len(_powers[0]) <= len(values):
        n = max(len(values), PIECE) + 1
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)])) for base in (_BASE, pow(_BASE, -1, 2**64))]
    power, inverse = _powers
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * power[:len(values)])])
    return mix64((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def spans_of(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    return edge[::2], edge[1::2]


def _hashed(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the words of ``raw``."""
    x = np.frombuffer(raw, np.uint8)
    start, end = spans_of(~_SPACE[x])
    return span_hashes(_BYTES[x], start, end), start


def word_hashes(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words ``[^\\x20\\x09-\\x0D]+`` of the texts, one text after the other, and the number of words of each."""
    out, sizes, group = [np.empty(0, np.uint64)], [], []

    def flush() -> None:
        hashes, start = _hashed(b" ".join(group))
        ends = np.cumsum([len(x) + 1 for x in group])
        out.append(hashes)
        sizes.extend(np.diff(np.searchsorted(start, ends), prepend=0))
        group.clear()

    length = 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if group and length + len(raw) > PIECE:
            flush()
            length = 0
        if len(raw) <= PIECE:
            group.append(raw)
            length += len(raw) + 1
            continue
        at, n = 0, 0
        while at < len(raw):
            cut = re.compile(rb"[\x20\x09-\x0D]").search(raw, min(len(raw), at + PIECE))
            end = cut.start() if cut else len(raw)
            hashes, _ = _hashed(raw[at:end])
            out.append(hashes)
            n, at = n + len(hashes), end
        sizes.append(n)
    if group:
        flush()
    return np.concatenate(out), np.array(sizes, np.int64)


def gram_hashes(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all runs of ``size`` words; a text with fewer words is one run."""
    n = len(word_hashes)
    if not n:
        return np.empty(0, np.uint64)
    size = min(size, n)
    out = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        out = mix64(out + np.uint64(0x9E3779B97F4A7C15) + word_hashes[k:n - size + 1 + k])
    return out


def in_parts(sizes: np.ndarray, most: int, rows: int) -> list[slice]:
    """Cuts of a row of texts into runs of at most ``rows`` texts and, but for a single one, ``most`` characters."""
    out, start, total = [], 0, 0
    for k, n in enumerate(sizes):
        if k > start and (total + n > most or k - start == rows):
            out.append(slice(start, k))
            start, total = k, 0
        total += n
    return [*out, slice(start, len(sizes))] if len(sizes) else out
