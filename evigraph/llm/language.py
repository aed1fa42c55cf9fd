"""Language ID: one interpolated Kneser-Ney character model per language.

Models are counted and fitted by Spark, a language a group, over a bounded sample of labelled
documents, then held in sorted hash arrays, an order each with a column a language, and broadcast.
A text's language is the one whose model has the lowest cross-entropy per character.  Rejection
is calibrated on labelled documents that the counts did not see.  The different words of many texts
are scored at once, in all languages.

Edge cases: a null text, or one without a letter, is ``und`` with score 0 and
rejected; ties go to the language that sorts first; repeated rows are judged
alike; a language label that is null teaches nothing; with no labelled rows at
all every text is ``und``; columns named like the added ones are replaced.  Whole texts are
read, however long; a word of more than a million letters counts as several.
"""
import functools
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import in_parts, mix64, span_hashes, spans_of

LETTERS = re.compile(r"[^\W\d_]+")
#: Bound of the fit: labelled documents sampled for each language, by a hash of their id.
MAX_DOCS_PER_LANGUAGE = 3000
ORDER, ALPHABET = 4, 1000
CACHED_WORDS = 200_000
#: Characters of the texts that are read at once.
CHARS = 1_000_000
#: Of the sampled documents, one in so many calibrates instead of being counted.
CALIBRATION_SHARE = 10
#: Allowance for chance in short texts: this many nats by the square root of the characters.
SHORT_TEXT = 9.0
#: And this many nats for any text: few unusual words, often repeated, are still of their language.
LEAST_MARGIN = 0.8


def gram_keys(points: np.ndarray, order: int) -> np.ndarray:
    """Hash of the ``order`` code points that end at each position (positions before have wrapped garbage; callers mask them)."""
    out = np.full(len(points), order, np.uint64)
    for back in range(order - 1, -1, -1):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + np.roll(points, back))
    return out


def kneser_ney(counts: dict[str, int], order: int = ORDER, alphabet: int = ALPHABET) -> tuple[list[dict[str, float]], list[dict[str, float]]]:
    """log p of the n-grams seen and log of the back-off weight of the contexts seen, by order.

    From counts of words padded with a blank on both sides cut into n-grams of ``order`` or, at a word's start, less.
    """
    level = {k: defaultdict(int) for k in range(1, order + 1)}
    for gram, n in counts.items():
        level[len(gram)][gram] += n
    for k in range(order, 1, -1):  # a lower order counts the kinds of characters before
        for gram in level[k]:
            level[k - 1][gram[1:]] += 1
    grams, contexts, lower = [], [], {"": 1.0 / alphabet}
    for k in range(1, order + 1):
        once = sum(1 for n in level[k].values() if n == 1)
        twice = sum(1 for n in level[k].values() if n == 2)
        discount = once / (once + 2 * twice) if once and twice else 0.5
        total, kinds = defaultdict(int), defaultdict(int)
        for gram, n in level[k].items():
            total[gram[:-1]] += n
            kinds[gram[:-1]] += 1
        weight = {h: discount * kinds[h] / total[h] for h in total}
        here = {gram: (n - discount) / total[gram[:-1]] + weight[gram[:-1]] * (lower[""] if k == 1 else lower[gram[1:]]) for gram, n in level[k].items()}
        grams.append({g: math.log(p) for g, p in here.items()})
        contexts.append({h: math.log(w) for h, w in weight.items()})
        lower = here
    return grams, contexts


def hash_arrays(values: dict[str, float], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of strings of ``size`` characters, and their values."""
    if not size:
        return np.full(len(values), EMPTY), np.array(list(values.values()))
    points = np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    return gram_keys(points, size)[size - 1::size], np.array(list(values.values()))


#: The key of the empty context.
EMPTY = gram_keys(np.zeros(1, np.uint64), 0)[0]


@dataclass
class LanguageModel:
    languages: list[str]
    #: By order from 1: sorted keys, and a column a language, NaN where it has not seen the key.
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    #: Of each language, cross-entropy above which a text is none of its own, and its spread.
    limits: np.ndarray
    spreads: np.ndarray
    unseen: float

    @staticmethod
    def of(languages: list[str], tables: dict[tuple[str, int, bool], tuple[np.ndarray, np.ndarray]], order: int = ORDER, alphabet: int = ALPHABET) -> "LanguageModel":
        """From (keys, values) of each language, order and kind (true for contexts)."""
        empty = np.empty(0, np.uint64), np.empty(0)

        def joined(k: int, context: bool) -> tuple[np.ndarray, np.ndarray]:
            own = [tables.get((x, k, context), empty) for x in languages]
            keys = np.unique(np.concatenate([x[0] for x in own] + [empty[0]]))
            values = np.full((len(keys), len(languages)), np.nan)
            for c, (k_, v) in enumerate(own):
                values[np.searchsorted(keys, k_), c] = v
            return keys, values

        n = len(languages)
        return LanguageModel(languages, [joined(k, False) for k in range(1, order + 1)], [joined(k, True) for k in range(1, order + 1)], np.full(n, math.inf), np.ones(n), -math.log(alphabet))

    def word_scores(self, points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Negative log p of each word in each language.  points: a blank, then each word and a blank; sizes: of the words with their closing blank."""
        order, n = len(self.grams), len(points)
        keys = [np.full(n, EMPTY)] + [gram_keys(points, k) for k in range(1, order + 1)]
        ends = np.cumsum(sizes)
        usable = np.concatenate([[0], np.arange(1, n) - np.repeat(ends - sizes, sizes) + 1])
        out, backed, open_ = np.zeros((n, len(self.languages))), np.zeros((n, len(self.languages))), np.ones((n, len(self.languages)), bool)
        for k in range(order, 0, -1):
            at = np.flatnonzero(open_.any(1) & (usable >= k))
            if not len(at):
                continue
            value = _lookup(self.grams[k - 1], keys[k][at])
            hit = open_[at] & ~np.isnan(value)
            out[at] = np.where(hit, backed[at] + value, out[at])
            open_[at] &= ~hit
            at = at[open_[at].any(1)]
            weight = _lookup(self.contexts[k - 1], keys[k - 1][at - 1] if k > 1 else keys[0][at])
            backed[at] += np.where(open_[at], np.nan_to_num(weight), 0)
        out = np.where(open_, backed + self.unseen, out)
        return -np.add.reduceat(out[1:], ends - sizes)


def _lookup(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    known, values = table
    if not len(known):
        return np.full((len(keys), values.shape[1]), np.nan)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where((known[at] == keys)[:, None], values[at], np.nan)


@functools.cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: does it stand in a word (``[^\\W\\d_]``), and is it a letter."""
    inside, alpha = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    for low in range(0, 0x110000, 0x4000):  # in parts, as a million strings at once take 60 MB
        chars = list(map(chr, range(low, low + 0x4000)))
        own = slice(low, low + 0x4000)
        alpha[own] = np.fromiter(map(str.isalpha, chars), bool, 0x4000)
        inside[own] = alpha[own] | (np.fromiter(map(str.isalnum, chars), bool, 0x4000) & ~np.fromiter(map(str.isdecimal, chars), bool, 0x4000))
    return inside, alpha


class LanguageScorer:
    """Scores whole texts with a broadcast model; each worker remembers words it has scored."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.known, self.scores = np.empty(0, np.uint64), np.empty((0, len(model.languages)))

    def _of_words(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Scores of the words that lie at these spans of ``points``."""
        hashes, first, own = np.unique(span_hashes(mix64(points), start, end), return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, hashes)
        new = np.flatnonzero(hashes != self.known[np.minimum(at, len(self.known) - 1)]) if len(self.known) else np.arange(len(hashes))
        if len(new):
            low, sizes = start[first[new]], (end - start)[first[new]] + 1
            ends = np.cumsum(sizes)
            take = np.repeat(low - (ends - sizes), sizes) + np.arange(ends[-1])
            text = points[np.minimum(take, len(points) - 1)]
            text[ends - 1] = 32
            scores = self.model.word_scores(np.concatenate([np.full(1, 32, np.uint64), text]), sizes)
            if len(self.known) > CACHED_WORDS:
                keep = at[np.setdiff1d(np.arange(len(hashes)), new)]
                self.known, self.scores = self.known[keep], self.scores[keep]
            known, scores = np.concatenate([self.known, hashes[new]]), np.concatenate([self.scores, scores])
            order = np.argsort(known)
            self.known, self.scores = known[order], scores[order]
        return self.scores[np.searchsorted(self.known, hashes)][own]

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text: cross-entropy per character in each language, and the characters scored (0 where there is no letter)."""
        sums, chars, alpha = np.zeros((len(texts), len(self.model.languages))), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        pieces = [(k, piece) for k, t in enumerate(texts) for piece in _pieces((t or "").lower())]
        inside, letters = _letters()
        for part in in_parts(np.array([len(p) for _, p in pieces]), CHARS, len(pieces)):
            own = pieces[part]
            points = np.frombuffer("\n".join(p for _, p in own).encode("utf-32-le", "surrogatepass"), "<u4")
            text = np.array([k for k, _ in own])
            ends = np.cumsum([len(p) + 1 for _, p in own])
            alpha += np.bincount(text[np.searchsorted(ends, np.flatnonzero(letters[points]), "right")], minlength=len(texts))
            start, end = spans_of(inside[points])
            if not len(start):
                continue
            scores, of = self._of_words(points.astype(np.uint64), start, end), text[np.searchsorted(ends, start, "right")]
            chars += np.bincount(of, end - start + 1, len(texts))
            for c in range(scores.shape[1]):
                sums[:, c] += np.bincount(of, scores[:, c], len(texts))
        chars[alpha == 0] = 0
        return sums / np.maximum(chars, 1)[:, None], chars

    def judge(self, texts: pd.Series) -> pd.DataFrame:
        """language, score, rejected and cross_entropy of each text."""
        model, n = self.model, len(texts)
        out = pd.DataFrame({"language": ["und"] * n, "score": 0.0, "rejected": True, "cross_entropy": np.nan})
        if not model.languages or not n:
            return out
        found, chars = self.entropies(texts.tolist())
        best = found.argmin(1)
        low = found[np.arange(n), best]
        share = 1 / np.exp(-8 * (found - low[:, None])).sum(1)
        over = (low - model.limits[best] - SHORT_TEXT / np.sqrt(np.maximum(chars, 1))) / model.spreads[best]
        known = chars > 0
        out.loc[known, "language"] = np.array(model.languages, object)[best[known]]
        out.loc[known, "score"] = (share / (1 + np.exp(np.minimum(50, over))))[known]
        out.loc[known, "rejected"] = (over > 0)[known]
        out.loc[known, "cross_entropy"] = low[known]
        return out


def _pieces(text: str) -> list[str]:
    """A long text cut at white space, or where there is none within ``CHARS`` characters, anywhere."""
    out = []
    while len(text) > CHARS:
        cut = max(text.rfind(" ", 1, CHARS), text.rfind("\n", 1, CHARS))
        cut = cut if cut > 0 else CHARS
        out.append(text[:cut])
        text = text[cut:]
    return [*out, text]


def _sample(docs: DataFrame, lang: str, max_docs: int) -> DataFrame:
    """About ``max_docs`` rows of each language, by a hash of doc_id; all rows of a rarer one."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col("text").isNotNull())
    sizes = {r[lang]: r["n"] for r in labelled.groupBy(lang).agg(F.count("*").alias("n")).collect()}
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, max_docs / n))]) if sizes else F.lit(None).cast("map<string,double>")
    return labelled.select("doc_id", "text", F.col(lang).alias("lang")).where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000)) < 1e6 * F.try_element_at(share, F.col("lang")))


def fit_languages(docs: DataFrame, lang: str = "lang", max_docs: int = MAX_DOCS_PER_LANGUAGE, order: int = ORDER) -> LanguageModel:
    """Models of the languages of labelled ``docs`` (doc_id, text, and the label column)."""
    sample = _sample(docs, lang, max_docs)
    held = F.pmod(F.xxhash64(F.lit("calibrate"), F.col("doc_id").cast("string")), F.lit(CALIBRATION_SHARE)) == 0

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, Counter] = defaultdict(Counter)

        def flush() -> pd.DataFrame:
            grams: dict[tuple[str, str], int] = defaultdict(int)
            for code, words in total.items():
                for word, n in words.items():
                    padded = f" {word} "
                    for end in range(2, len(padded) + 1):
                        grams[code, padded[max(0, end - order):end]] += n
            total.clear()
            return pd.DataFrame([(c, g, n) for (c, g), n in grams.items()], columns=["lang", "gram", "n"])

        for batch in batches:
            for text, code in zip(batch["text"], batch["lang"], strict=True):
                total[code].update(LETTERS.findall(text.lower()))
            if sum(map(len, total.values())) > 300_000:
                yield flush()
        yield flush()

    counted = sample.where(~held).select("text", "lang").mapInPandas(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))

    def fitted(group: pd.DataFrame) -> pd.DataFrame:
        grams, contexts = kneser_ney(dict(zip(group["gram"], group["n"], strict=True)), order)
        rows = []
        for context, found in ((False, grams), (True, contexts)):
            for k, values in enumerate(found, 1):
                keys, logs = hash_arrays(values, k - context)
                rows.append((group["lang"].iloc[0], k, context, keys.tobytes(), logs.tobytes()))
        return pd.DataFrame(rows, columns=["lang", "order", "context", "keys", "logs"])

    rows = counted.groupBy("lang").applyInPandas(fitted, "lang string, order int, context boolean, keys binary, logs binary").collect()
    languages = sorted({r["lang"] for r in rows})
    open_model = LanguageModel.of(languages, {(r["lang"], r["order"], r["context"]): (np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["logs"])) for r in rows}, order)
    calibrated = score_languages(sample.where(held), open_model).where("language = lang").groupBy("lang").agg(F.avg("cross_entropy").alias("mean"), F.stddev_pop("cross_entropy").alias("sd")).collect()
    own = {r["lang"]: (r["mean"], r["sd"]) for r in calibrated}
    mean, sd = own.get("", (0, 0)) if not own else tuple(np.mean(list(own.values()), 0))
    spreads = np.array([max(0.05, own.get(x, (mean, sd))[1]) for x in languages])
    open_model.limits = np.array([own.get(x, (mean, sd))[0] for x in languages]) + np.maximum(6 * spreads, LEAST_MARGIN)
    open_model.spreads = spreads
    return open_model


def language_column(df: DataFrame, text: str, model: LanguageModel) -> Column:
    """struct<language, score, rejected, cross_entropy> of a text column."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("language string, score double, rejected boolean, cross_entropy double")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = LanguageScorer(shared.value)
        for texts in batches:
            yield scorer.judge(texts)

    return judged(F.col(text))


def score_languages(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Adds language, score, rejected and cross_entropy."""
    added = ("language", "score", "rejected", "cross_entropy")
    return df.select(*[c for c in df.columns if c not in added], language_column(df, text, model).alias("_language")).select("*", *[F.col(f"_language.{c}").alias(c) for c in added]).drop("_language")


def keep_languages(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows that the model does not reject, with their own columns only."""
    return df.where(~language_column(df, text, model)["rejected"])
