"""Quality rules under weak supervision.

Each rule votes good, bad or abstains.  Expectation-maximisation over the counts
of vote patterns (at most 3 ** rules of them, whatever the corpus) estimates how
accurate each rule's good and bad votes are; a document is kept if its posterior probability
of being good reaches the threshold.

Edge cases: a null or empty text has no words, so all counts are 0 and the base
rules fail it; a text of white space only likewise; repeated rows vote alike;
counts cover whole texts; an empty table fits the prior alone; all columns pass
through, but ``with_counts`` replaces those named like its own.
"""
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import ASCII_SPACE, byte_words, durable, mix64

SYMBOLS = "#*$%&|<>"
RULES = ["length", "word_length", "symbols", "repeat_lines", "repeat_words", "upper_case", "word_variety", "letters"]
NUMBERS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_distinct", "n_lines"]


def base_counts(text: str | None) -> tuple[int, ...]:
    """The numbers named in NUMBERS."""
    if not text:
        return (0,) * len(NUMBERS)
    words = byte_words(text)
    n = len(words)
    word_chars = len(text) - sum(map(text.count, ASCII_SPACE))
    n_symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    n_dup, n_lines = 0, 0
    for line in text.split("\n"):
        if line.strip(ASCII_SPACE):
            n_lines += 1
            n_dup += line in seen
            seen.add(line)
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.uint64, n)
    n_repeat = 0
    if n >= 4:
        # Ids are dense, so three of them fit into one exact key while there are under 2 ** 21 kinds of words.
        keys = (ids[:-2] << np.uint64(42)) | (ids[1:-1] << np.uint64(21)) | ids[2:] if len(codes) < 1 << 21 else mix64(mix64(mix64(ids[:-2]) + ids[1:-1]) + ids[2:])
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        same = ranked[1:] == ranked[:-1]
        again = np.zeros(len(keys), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k:n - 2 + k] |= again
        n_repeat = int(covered.sum())
    ascii_only = text.isascii()
    raw = np.frombuffer(text.encode() if ascii_only else text.encode("utf-32-le", "surrogatepass"), np.uint8 if ascii_only else "<u4")
    upper = int(((raw >= 65) & (raw <= 90)).sum())
    letters = upper + int(((raw >= 97) & (raw <= 122)).sum())
    if not ascii_only:
        rest = "".join(map(chr, raw[raw > 127]))
        upper += sum(map(str.isupper, rest))
        letters += sum(map(str.isalpha, rest))
    return n, word_chars, n_symbols, n_dup, n_repeat, upper, letters, len(codes), n_lines


def votes(c: pd.DataFrame) -> np.ndarray:
    """A row for each document, a column for each rule: 1 good, -1 bad, 0 abstains."""
    n = np.maximum(c["n_words"].to_numpy(), 1)
    share = lambda x, of: c[x].to_numpy() / np.maximum(of, 1)

    def vote(value: np.ndarray, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
        return np.where(bad, -1, np.where(good, 1, 0))

    length, symbols, lines = share("word_chars", n), share("n_symbols", n), share("n_dup_lines", c["n_lines"].to_numpy())
    repeats, upper, letters = share("n_repeat_words", n), share("n_upper", c["n_letters"].to_numpy()), share("n_letters", c["word_chars"].to_numpy())
    variety = share("n_distinct", np.sqrt(n))
    size = c["n_words"].to_numpy()
    none = np.zeros(len(size), bool)
    return np.stack([
        vote(size, size >= 100, none),
        vote(length, none, (length < 2) | (length > 15)),
        vote(symbols, none, symbols > 0.1),
        vote(lines, none, lines > 0.3),
        vote(repeats, none, repeats > 0.4),
        vote(upper, none, (upper > 0.4) & (size >= 3)),
        vote(variety, variety >= 5, (variety < 2) & (size >= 30)),
        vote(letters, letters >= 0.92, letters < 0.75),
    ], axis=1)


def pattern_codes(found: np.ndarray) -> np.ndarray:
    return (found + 1) @ (3 ** np.arange(found.shape[1]))


def pattern_votes(code: int, rules: int = len(RULES)) -> np.ndarray:
    return np.array([code // 3 ** k % 3 - 1 for k in range(rules)])


#: Beliefs before the data: a rule's accuracy where it votes, the share of good documents, and how many votes or
#: documents these count as, whatever the corpus' size.
ACCURACY, SHARE, TRUST = 0.9, 0.8, 50.0


@dataclass
class FittedRules:
    """What expectation-maximisation found: the share of good documents, how often each rule's good and bad votes are right, and P(good | votes) by pattern."""

    share: float
    good: np.ndarray
    bad: np.ndarray
    posteriors: dict[int, float]

    def accuracies(self) -> dict[str, tuple[float, float]]:
        """Of each rule: the share of its good and of its bad votes that are right."""
        return dict(zip(RULES, zip(self.good.tolist(), self.bad.tolist(), strict=True), strict=True))


def fit_patterns(patterns: dict[int, int], rounds: int = 200, trust: float = TRUST, rules: int = len(RULES)) -> FittedRules:
    """P(good | votes) of each pattern, by expectation-maximisation over pattern counts.

    A vote speaks by its own accuracy, which is estimated from all documents, against the share of good documents; a rule
    that abstains says nothing, so a document without any vote is as likely good as any.  Beliefs count as ``trust`` votes
    of each kind.  The start takes any bad vote as a sign of a bad document.
    """
    codes = np.array(sorted(patterns), np.int64)
    n = np.array([patterns[int(c)] for c in codes], float)
    table = np.stack([pattern_votes(int(c), rules) for c in codes]) if len(codes) else np.zeros((0, rules), int)
    good, bad = (table == 1).astype(float), (table == -1).astype(float)
    p = np.where(bad.any(1), 0.02, 0.98)
    share, right = SHARE, np.full((2, rules), ACCURACY)
    for _ in range(rounds if len(codes) else 0):
        before = p
        share = ((n * p).sum() + trust * SHARE) / (n.sum() + trust)
        right = np.stack([((n * p) @ good + trust * ACCURACY) / (n @ good + trust), ((n * (1 - p)) @ bad + trust * ACCURACY) / (n @ bad + trust)])
        # What a vote adds to the log odds: those of being good given this vote, less those of any document.
        odds = np.log(share / (1 - share))
        said = good @ (np.log(right[0] / (1 - right[0])) - odds) + bad @ (np.log((1 - right[1]) / right[1]) - odds)
        p = 1 / (1 + np.exp(-np.clip(odds + said, -500, 500)))
        if np.abs(p - before).max() < 1e-9:
            break
    return FittedRules(float(share), *right, {int(c): float(x) for c, x in zip(codes, p, strict=True)})


def counts_column(text: str) -> Column:
    """struct of NUMBERS and the document's vote pattern."""

    @F.pandas_udf(", ".join(f"{x} long" for x in NUMBERS) + ", pattern int")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = pd.DataFrame(list(map(base_counts, texts)), columns=NUMBERS)
            out["pattern"] = pattern_codes(votes(out)).astype("int32")
            yield out

    return counted(F.col(text))


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds NUMBERS and pattern, in the place of columns of those names."""
    added = [*NUMBERS, "pattern"]
    counted = docs.select(*[c for c in docs.columns if c not in added], counts_column(text).alias("_counts"))
    return counted.select(*counted.columns[:-1], *[F.col(f"_counts.{c}").alias(c) for c in added])


def fit_rules(counted: DataFrame) -> FittedRules:
    """From a table that has ``pattern``; what reaches the driver is bounded by 3 ** rules."""
    return fit_patterns({r["pattern"]: r["n"] for r in counted.groupBy("pattern").agg(F.count("*").alias("n")).collect()})


def posterior(pattern: Column, fitted: FittedRules) -> Column:
    """Probability that a document with this pattern is good."""
    if not fitted.posteriors:
        return F.lit(fitted.share)
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in sorted(fitted.posteriors.items()) for x in pair]), pattern)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def keep_quality(docs: DataFrame, text: str = "text", threshold: float = 0.5, base: bool = False) -> DataFrame:
    """The documents whose posterior reaches the threshold (and that pass the base rules, if asked), with their own columns."""
    counted = durable(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), counts_column(text).alias("_counts")))
    out = counted.where(posterior(F.col("_counts.pattern"), fit_rules(counted.select("_counts.pattern"))) >= threshold)
    if base:
        out = out.where((F.col("_counts.n_words") >= 50) & (100 * F.col("_counts.n_repeat_words") <= 50 * F.col("_counts.n_words")))
    return out.select("_doc.*")
