"""Quality classifier: a factorisation machine over hashed words, structure statistics and the text's size.

score = sigmoid(b + w.x + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]): all pairwise
interactions in time linear in the features.  The fit uses a bounded sample of
labelled documents; scoring streams whole texts.

Edge cases: a null or empty text has no words and neutral statistics and still gets
a score; repeated rows score alike; a label that is null teaches nothing; without
labels, or with one kind only, the score is the sample's mean label (0.5 if empty).
"""
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import byte_words
from evigraph.llm.quality_rules import NUMBERS, base_counts

BUCKETS, RANK = 4096, 8
#: Bound of the fit: about so many labelled documents, chosen by a hash of their id.
MAX_LABELLED = 6000
CACHED_WORDS = 300_000
STATISTICS = 11


def statistics(text: str | None) -> list[float]:
    """Structure of a text, before standardising."""
    c = dict(zip(NUMBERS, base_counts(text), strict=True))
    n = max(c["n_words"], 1)
    return [
        np.log1p(c["n_words"]), c["word_chars"] / n, c["n_symbols"] / n, c["n_dup_lines"] / max(c["n_lines"], 1), c["n_repeat_words"] / n,
        c["n_upper"] / max(c["n_letters"], 1), c["n_letters"] / max(c["word_chars"], 1), c["n_distinct"] / np.sqrt(n), c["n_distinct"] / n,
        np.log1p(c["n_lines"]), np.log1p(len(text or "")),
    ]


class WordHasher:
    def __init__(self, buckets: int = BUCKETS):
        self.buckets, self.known = buckets, {}

    def features(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(sorted buckets, values): log counts scaled to unit length."""
        words = byte_words((text or "").lower())
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = zlib.crc32(w) % self.buckets
        counts = np.bincount(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), minlength=self.buckets)
        at = np.flatnonzero(counts)
        value = np.log1p(counts[at])
        return at, value / max(np.sqrt((value**2).sum()), 1e-9)


@dataclass
class FactorizationMachine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    buckets: int = BUCKETS

    def scaled(self, raw: np.ndarray) -> np.ndarray:
        return np.clip((raw - self.mean) / self.spread, -4, 4) / 2

    def score(self, at: np.ndarray, value: np.ndarray, raw: list[float]) -> float:
        x = np.concatenate([value, self.scaled(np.array(raw))])
        rows = np.concatenate([at, np.arange(self.buckets, self.buckets + len(raw))])
        v = self.factors[rows] * x[:, None]
        pairs = 0.5 * (v.sum(0) ** 2 - (v**2).sum(0)).sum()
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[rows] @ x + pairs, -30, 30))))


def fit_machine(rows: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], buckets: int = BUCKETS, rank: int = RANK, epochs: int = 12, batch: int = 128, rate: float = 0.05, decay: float = 1e-4, seed: int = 7) -> FactorizationMachine:
    """AdaGrad on the log loss over (label, buckets, values, statistics) rows."""
    raw = np.array([r[3] for r in rows], float).reshape(-1, STATISTICS)
    labels = np.array([r[0] for r in rows], float)
    mean, spread = (raw.mean(0), np.maximum(raw.std(0), 1e-6)) if len(rows) else (np.zeros(STATISTICS), np.ones(STATISTICS))
    share = np.clip(labels.mean() if len(rows) else 0.5, 1e-3, 1 - 1e-3)
    size, rng = buckets + STATISTICS, np.random.default_rng(seed)
    out = FactorizationMachine(float(np.log(share / (1 - share))), np.zeros(size), np.zeros((size, rank)), mean, spread, buckets)
    if len(set(labels)) < 2:
        return out
    out.factors = rng.normal(0, 0.02, (size, rank))
    past_w, past_v, past_b = np.full(size, 1e-8), np.full((size, rank), 1e-8), 1e-8
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            picked = order[at:at + batch]
            x = np.zeros((len(picked), size), np.float32)
            for k, r in enumerate(picked):
                x[k, rows[r][1]] = rows[r][2]
            x[:, buckets:] = out.scaled(raw[picked])
            sums, squares = x @ out.factors, x * x
            y = out.bias + x @ out.weights + 0.5 * (sums**2 - squares @ out.factors**2).sum(1)
            error = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels[picked]) / len(picked)
            grad_w = x.T @ error + decay * out.weights
            grad_v = x.T @ (error[:, None] * sums) - out.factors * (squares.T @ error)[:, None] + decay * out.factors
            past_w += grad_w**2
            past_v += grad_v**2
            past_b += error.sum() ** 2
            out.weights -= rate * grad_w / np.sqrt(past_w)
            out.factors -= rate * grad_v / np.sqrt(past_v)
            out.bias -= rate * error.sum() / np.sqrt(past_b)
    return out


def fit_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, buckets: int = BUCKETS) -> FactorizationMachine:
    """From documents (doc_id, text) and labels (doc_id, quality): a hash sample of about ``max_labelled`` of them, whatever their number."""
    known = labels.where(F.col("quality").isNotNull()).select("doc_id", "quality")
    share = min(1.0, max_labelled / max(known.count(), 1))
    # Bounded by max_labelled rows of two numbers, so this side may be broadcast.
    sample = known.where(F.pmod(F.xxhash64(F.lit("fit"), F.col("doc_id").cast("string")), F.lit(1_000_000)) < 1e6 * share)

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher(buckets)
        for batch in batches:
            found = [hasher.features(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "quality": batch["quality"], "at": [a.astype(np.int32) for a, _ in found], "value": [v.astype(np.float32) for _, v in found], "raw": [statistics(t) for t in batch["text"]]})

    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").mapInPandas(featured, "doc_id long, quality int, at array<int>, value array<float>, raw array<double>").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    return fit_machine([(int(q), np.asarray(a), np.asarray(v), np.asarray(r)) for q, a, v, r in zip(rows["quality"], rows["at"], rows["value"], rows["raw"], strict=True)], buckets)


def quality_score(df: DataFrame, text: str, model: FactorizationMachine) -> Column:
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher = WordHasher(shared.value.buckets)
        for texts in batches:
            yield pd.Series([shared.value.score(*hasher.features(t), statistics(t)) for t in texts], dtype="float64")

    return scored(F.col(text))
