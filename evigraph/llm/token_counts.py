"""Token counts by finite-state tokenizer compilation.

A byte-level BPE file is compiled into two deterministic transducers.

*Cuts.*  A small complete automaton over classes of characters marks where the
tokenizer's pattern cuts a text before merging.  A stream of texts is dealt into
chunks; each chunk's state map (the state it ends in, for every state it may
begin in) is found in lock step over all chunks, maps compose by a parallel prefix
scan, and with the states known each chunk emits its cuts.

*Merges.*  Between cuts, a state holds what of the bytes read so far can still
change: for every place where a longer token may have begun, the node of the
vocabulary's trie, the token before it and its count of tokens.  A transition is
annotated with the tokens that it adds to the encoding of what was read (fewer
than none where a longer token replaces shorter ones), so a word's count is the sum
of its transitions.  Two tokens may stand side by side exactly if no merge across
their border comes before the merges that made them.  States are compiled when
first met; the table is bounded by ``MOST_STATES`` and begun anew beyond it.

Character classes are asked from the tokenizer's own pattern, so its Unicode
version is the one that counts.

Edge cases: a null text counts as empty (0 bytes, 0 tokens); strings of special
tokens inside a text are one token each, as the library has it; texts of any length
are counted whole; repeated rows count alike; an empty table gives no rows; columns
named like the new ones are replaced, all others pass through.  Files that are not
plain byte-level BPE (a normaliser, dropout, byte fallback, another pattern) are
refused with a ValueError.
"""
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import in_parts
from evigraph.llm.packing import byte_symbols

#: Characters counted at once, characters of a chunk, states kept.
PART, CHUNK, MOST_STATES = 1 << 20, 256, 1 << 16
#: Sets of tokens that may follow a token, kept at once (6 KB each).
MOST_SETS = 8192

END = 0x110000
CLASSES = ["end", "blank", "space", "letter", "s", "r", "e", "l", "digit", "apostrophe", "other"]
STATES = ["start", "blank", "space", "blanks", "spaces", "letters", "digits", "others", "apostrophe", "apostrophe_r", "apostrophe_l", "contraction"]
LETTERS = {"letter", "s", "r", "e", "l"}
#: A cut before this character, a cut before the one before it.
HERE, BEFORE = 1, 2


def cut_step(state: str, kind: str) -> tuple[str, int]:
    """The automaton of ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``: next state and cuts."""
    run = "letters" if kind in LETTERS else "digits" if kind == "digit" else "others"
    if state in ("apostrophe_r", "apostrophe_l"):
        if (state, kind) in (("apostrophe_r", "e"), ("apostrophe_l", "l")):
            return "contraction", 0
        after, cuts = cut_step("letters", kind)  # the apostrophe was no contraction: a word begins after it
        return after, cuts | BEFORE
    if kind == "end":
        return "start", HERE
    if kind in ("blank", "space"):
        if state in ("blank", "space", "blanks", "spaces"):
            return kind + "s", 0
        return kind, HERE
    if state == "blank":
        return run, 0
    if state == "blanks":
        return run, BEFORE
    if state == "spaces":
        return cut_step("start", kind)[0], HERE | BEFORE
    if state == run:
        return run, 0
    if state == "apostrophe":
        if kind in ("s", "r", "l"):
            return {"s": "contraction", "r": "apostrophe_r", "l": "apostrophe_l"}[kind], 0
        if run == "others":
            return "others", 0
    return ("apostrophe" if kind == "apostrophe" else run), HERE


def _cut_tables() -> tuple[np.ndarray, np.ndarray]:
    step = [[cut_step(s, k) for s in STATES] for k in CLASSES]
    return np.array([[STATES.index(s) for s, _ in row] for row in step], np.uint8), np.array([[c for _, c in row] for row in step], np.uint8)


NEXT, CUTS = _cut_tables()


def chunk_maps(kinds: np.ndarray) -> np.ndarray:
    """Of each row of ``kinds`` (a chunk of character classes), the state after it for every state before it."""
    width, flat = len(STATES), NEXT.ravel()
    maps = np.tile(np.arange(width, dtype=np.intp), (len(kinds), 1))
    for column in kinds.T.astype(np.intp) * width:
        maps = flat[column[:, None] + maps].astype(np.intp)
    return maps


def scan_maps(maps: np.ndarray, first: int = 0) -> np.ndarray:
    """The state before each chunk, if the first begins in state ``first``: a parallel prefix scan under composition."""
    maps, reach = maps.copy(), 1
    while reach < len(maps):
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], axis=1)
        reach *= 2
    return np.concatenate([[first], maps[:-1, first]]).astype(np.intp) if len(maps) else np.empty(0, np.intp)


def cut_marks(kinds: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Whether a piece begins at each character of a stream of classes, which ends in ``end``."""
    n = len(kinds)
    rows = -(-n // chunk)
    padded = np.zeros(rows * chunk, np.uint8)
    padded[:n] = kinds
    padded = padded.reshape(rows, chunk)
    state, width = scan_maps(chunk_maps(padded)), len(STATES)
    cuts = np.empty((chunk, rows), np.uint8)
    for k, column in enumerate(padded.T.astype(np.intp) * width):
        at = column + state
        cuts[k] = CUTS.ravel()[at]
        state = NEXT.ravel()[at].astype(np.intp)
    cuts = cuts.T.ravel()[:n]
    marks = (cuts & HERE).astype(bool)
    marks[:-1] |= (cuts[1:] & BEFORE).astype(bool)
    return marks


class TooManyStates(Exception):
    pass


class MergeTransducer:
    """The encoding of byte strings by ranked merges, as a transducer that counts tokens."""

    def __init__(self, tokens: list[bytes], merges: list[tuple[int, int, int]], most_states: int = MOST_STATES):
        """``merges``: (left, right, merged) token numbers by rank."""
        self.most_states = most_states
        n = len(tokens)
        self.rank_of = {(a, b): r for r, (a, b, _) in enumerate(merges)}
        self.made: list[tuple[int, int, int] | None] = [None] * n
        self.partners: dict[int, list[tuple[int, int]]] = {}
        children: list[list[int]] = [[] for _ in range(n)]
        for r, (a, b, c) in enumerate(merges):
            self.made[c] = (a, b, r)
            self.partners.setdefault(a, []).append((r, b))
            children[a].append(c)
        # Preorder of the tree of left halves, later merges first: the tokens that begin with y and keep it until rank r are one run.
        self.first, self.run_ends, self.run_ranks = np.zeros(n, np.int64), {}, {}
        at = 0
        stack: list[tuple[int, bool]] = [(t, False) for t in range(n) if self.made[t] is None]
        ends = np.zeros(n, np.int64)
        while stack:
            t, done = stack.pop()
            if done:
                ends[t] = at
                continue
            self.first[t] = at
            at += 1
            stack.append((t, True))
            stack.extend((c, False) for c in children[t])  # the last pushed, of the highest rank, comes first
        for t, below in enumerate(children):
            if below:
                self.run_ranks[t] = np.array([self.made[c][2] for c in below])
                self.run_ends[t] = ends[below]
        usable = [t for t in range(n) if self._is_reached(t)]
        by_bytes = sorted(usable, key=tokens.__getitem__)
        self.place = np.full(n, -1, np.int64)
        self.place[by_bytes] = np.arange(len(by_bytes))
        self.in_tree_order = self.first[by_bytes]
        self.n = n
        self._trie([tokens[t] for t in by_bytes], by_bytes)
        self.any = (1 << len(by_bytes)) - 1
        self.clear()

    def _right_spine(self, t: int) -> list[tuple[int, float]]:
        """The tokens at the right end of ``t`` while it is made, with the rank of the merge that ends each."""
        out, until = [], float("inf")
        while True:
            out.append((t, until))
            if self.made[t] is None:
                return out
            _, t, until = self.made[t]

    def _is_reached(self, t: int) -> bool:
        """Whether the bytes of ``t`` are encoded as ``t``: no merge across its halves' border comes before theirs."""
        if self.made[t] is None:
            return True
        a, b, rank = self.made[t]
        left, until = [], float("inf")
        y = b
        while True:
            left.append((y, until))
            if self.made[y] is None:
                break
            y, _, until = self.made[y]
        for x, x_until in self._right_spine(a):
            for y, y_until in left:
                r = self.rank_of.get((x, y))
                if r is not None and r < rank and r < x_until and r <= y_until:
                    return False
        return True

    def _trie(self, strings: list[bytes], tokens: list[int]) -> None:
        """Nodes by (node, byte); of each, its token, and the run of tokens (in the order of their bytes) that go on below it."""
        self.child: dict[int, int] = {}
        self.token, self.low, self.high = [-1], [0], [len(strings)]
        for k, s in enumerate(strings):
            node = 0
            for b in s:
                key = node << 8 | b
                node = self.child.get(key, 0)
                if not node:
                    node = self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.low.append(k)
                    self.high.append(k)
                self.high[node] = k + 1
            self.token[node], self.low[node] = tokens[k], k + 1

    def may_follow(self, last: int) -> int:
        """The tokens that may stand after ``last``, as bits in the order of their bytes."""
        change = np.zeros(self.n + 1, np.int64)
        for x, until in self._right_spine(last):
            for r, y in self.partners.get(x, ()):
                if r >= until:
                    break
                start = self.first[y]
                kept = np.searchsorted(self.run_ranks[y], r) if y in self.run_ranks else 0
                end = self.run_ends[y][kept] if y in self.run_ranks and kept < len(self.run_ranks[y]) else start + 1
                change[start] += 1
                change[end] -= 1
        free = np.cumsum(change[:-1])[self.in_tree_order] == 0
        return int.from_bytes(np.packbits(free, bitorder="little").tobytes(), "little")

    def _class(self, node: int, free: int) -> int:
        """The number of a place where a longer token may have begun: the bytes since, and which tokens may yet come of it."""
        number = self.class_of.get((node, free))
        if number is None:
            number = self.class_of[node, free] = len(self.places)
            self.places.append((node, free))
        return number

    def _after(self, token: int) -> int:
        """The class of the place behind ``token``."""
        number = self.behind.get(token)
        if number is None:
            number = self.behind[token] = self._class(0, self.may_follow(token))
        return number

    def _advance(self, key: int) -> tuple[int, int]:
        """Of a class and a byte: the class after it (-1 if no longer token can come) and the token that ends with it (-1 if none)."""
        node, free = self.places[key >> 8]
        below = self.child.get(node << 8 | key & 255, 0)
        if not below:
            return -1, -1
        shift, token = self.low[node], self.token[below]
        rest = free >> (self.low[below] - shift) & ((1 << (self.high[below] - self.low[below])) - 1)
        ended = token if token >= 0 and free >> (int(self.place[token]) - shift) & 1 else -1
        return self._class(below, rest) if rest else -1, ended

    def step(self, state: tuple, byte: int) -> tuple[tuple, int]:
        """The state after ``byte`` and the tokens it adds; a state is a tuple of class << 9 | (tokens up to there less all tokens, + 256)."""
        out, last, added = [], -1, 0
        for entry in state:
            key = entry >> 9 << 8 | byte
            moved = self.moves.get(key)
            if moved is None:
                moved = self.moves[key] = self._advance(key)
            if moved[1] >= 0:
                last, added = moved[1], (entry & 511) - 255
            if moved[0] >= 0:
                out.append(moved[0] << 9 | entry & 511)
        return (*[entry - added for entry in out], self._after(last) << 9 | 256), added

    def clear(self) -> None:
        self.class_of: dict[tuple[int, int], int] = {}
        self.places: list[tuple[int, int]] = []
        self.behind: dict[int, int] = {}
        self.moves: dict[int, tuple[int, int]] = {}
        self.states = [(self._class(0, self.any) << 9 | 256,)]
        self.number = {self.states[0]: 0}
        self.next = np.full(256 * 1024, -1, np.int32)
        self.added = np.zeros(256 * 1024, np.int16)

    def compile(self, keys: np.ndarray) -> None:
        for key in keys.tolist():
            state, added = self.step(self.states[key >> 8], key & 255)
            number = self.number.get(state)
            if number is None:
                number = len(self.states)
                if number >= self.most_states:
                    raise TooManyStates
                self.number[state] = number
                self.states.append(state)
                if 256 * number >= len(self.next):
                    self.next = np.concatenate([self.next, np.full(len(self.next), -1, np.int32)])
                    self.added = np.concatenate([self.added, np.zeros(len(self.added), np.int16)])
            self.next[key], self.added[key] = number, added

    def counts(self, raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Tokens of each of the byte strings ``raw[start:start + length]``: all advance by a byte at a time."""
        try:
            return self._lock_step(raw, start, length)
        except TooManyStates:
            self.clear()
        if len(start) == 1:
            state, n = self.states[0], 0
            for byte in raw[start[0]:start[0] + length[0]].tolist():
                state, added = self.step(state, byte)
                n += added
            return np.array([n])
        half = len(start) // 2
        return np.concatenate([self.counts(raw, start[:half], length[:half]), self.counts(raw, start[half:], length[half:])])

    def _lock_step(self, raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        order = np.argsort(-length, kind="stable")
        at, sizes = start[order], length[order]
        state, total = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        active = len(at) - np.cumsum(np.bincount(sizes, minlength=1))  # lanes longer than each length
        for k in range(int(sizes[0]) if len(sizes) else 0):
            m = int(active[k])
            key = state[:m] << 8 | raw[at[:m] + k]
            after = self.next[key]
            if after.min() < 0:
                self.compile(np.unique(key[after < 0]))
                after = self.next[key]
            total[:m] += self.added[key]
            state[:m] = after
        out = np.empty(len(at), np.int64)
        out[order] = total
        return out


class CompiledTokenizer:
    """Counts tokens of whole texts by the transducers of a tokenizer file."""

    def __init__(self, path: str, most_states: int = MOST_STATES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cutter = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or spec["normalizer"] or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True):
            raise ValueError(f"{path} is no plain byte-level BPE tokenizer")
        for t in spec["added_tokens"]:
            if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
                raise ValueError(f"{path}: the added token {t['content']!r} takes more than its own string")
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.cutter = Tokenizer.from_file(path).pre_tokenizer
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        names = [t for t in model["vocab"] if t not in special]
        number = {t: k for k, t in enumerate(names)}
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.merges = MergeTransducer([bytes(byte_of[c] for c in t) for t in names], [(number[a], number[b], number[a + b]) for a, b in pairs], most_states)
        self.kinds = np.full(END + 1, 255, np.uint8)
        self.kinds[END] = CLASSES.index("end")

    def kind(self, point: int) -> int:
        """The class of a character, as the tokenizer's own pattern has it."""
        c = chr(point)
        named = {" ": "blank", "'": "apostrophe", "s": "s", "t": "s", "m": "s", "d": "s", "r": "r", "v": "r", "e": "e", "l": "l"}
        if c in named:
            return CLASSES.index(named[c])
        for lead, kind in (("b", "letter"), ("1", "digit"), ("!", "other")):
            if len(self.cutter.pre_tokenize_str(lead + c)) == 1:
                return CLASSES.index(kind)
        return CLASSES.index("space")

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes and tokens of each text."""
        owner, segments = [], []
        n_bytes, n_tokens = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            parts = [text or ""]
            if self.special and self.special.search(parts[0]):
                parts = self.special.split(parts[0])
                n_tokens[k] += len(parts) - 1
                n_bytes[k] += len(text.encode()) - sum(len(p.encode()) for p in parts)
            for part in parts:
                for piece in stretches(part):
                    owner.append(k)
                    segments.append(piece)
        owner = np.array(owner, np.int64)
        for span in in_parts(np.array([len(s) for s in segments], np.int64), PART, 1 << 20):
            sizes, tokens = self._segments(segments[span])
            np.add.at(n_bytes, owner[span], sizes)
            np.add.at(n_tokens, owner[span], tokens)
        return n_bytes, n_tokens

    def _segments(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(segments)
        raw = np.frombuffer(joined.encode(), np.uint8)
        chars = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.int64)
        ends = np.cumsum([len(s) for s in segments])
        chars = np.insert(chars, ends, END)  # a sentinel after each segment
        kinds = self.kinds[chars]
        if (kinds == 255).any():
            for point in np.unique(chars[kinds == 255]).tolist():
                self.kinds[point] = self.kind(point)
            kinds = self.kinds[chars]
        width = np.where(chars == END, 0, 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000))
        offset = np.concatenate([[0], np.cumsum(width)])
        begin = np.flatnonzero(cut_marks(kinds))
        start, stop = offset[begin], offset[np.append(begin[1:], len(chars))]
        real = chars[begin] != END
        tokens = self.merges.counts(raw, start[real], (stop - start)[real])
        sentinels = ends + np.arange(len(segments))
        of = np.searchsorted(sentinels, begin[real])
        total = np.zeros(len(segments), np.int64)
        np.add.at(total, of, tokens)
        return np.diff(offset[sentinels], prepend=0), total


_after_word = re.compile(r"[A-Za-z0-9](?= )")


def stretches(text: str, most: int = PART) -> Iterator[str]:
    """A long text in stretches, each cut after a letter or digit before a blank, where the pattern always cuts."""
    at = 0
    while len(text) - at > most:
        found = _after_word.search(text, at + most)
        if not found:
            break
        yield text[at:found.end()]
        at = found.end()
    yield text[at:] if at else text


_compiled: dict[str, CompiledTokenizer] = {}


def compiled(path: str) -> CompiledTokenizer:
    """The tokenizer of a file, compiled once in each worker."""
    if path not in _compiled:
        _compiled.clear()
        _compiled[path] = CompiledTokenizer(path)
    return _compiled[path]


def counts_column(text: str, tokenizer_path: str) -> Column:
    """struct<n_bytes, n_tokens> of a text column."""

    @F.pandas_udf("n_bytes long, n_tokens long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tokenizer = compiled(tokenizer_path)
        for texts in batches:
            n_bytes, n_tokens = tokenizer.counts(texts.tolist())
            yield pd.DataFrame({"n_bytes": n_bytes, "n_tokens": n_tokens})

    return counted(F.col(text))


def with_token_counts(docs: DataFrame, tokenizer_path: str, text: str = "text", limit: int = 512) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit, in the place of columns of those names."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    counted = docs.select(*kept, counts_column(text, tokenizer_path).alias("_counts"))
    return counted.select(*kept, "_counts.n_bytes", "_counts.n_tokens", (F.col("_counts.n_tokens") > limit).alias("over_limit"))
