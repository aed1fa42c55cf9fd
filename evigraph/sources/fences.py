"""Source texts between fences that say they are untrusted, and that the text itself can neither close nor open."""
import functools
import itertools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters of other scripts that pass for those of a fence, brackets that pass for its own, and what prints as a blank.
LOOKALIKES = {
    "c": "сϲ", "d": "ԁᴅ", "e": "еεᴇ", "n": "пոνɴ", "r": "гʀ", "s": "ѕꜱ", "t": "тτᴛ", "u": "иυսᴜ",
    "[": "⁅❲⟦⟬⟮⌈⌊⎡⎣⦋⦍⦏【〔〖〘〚", " ": "\u115f\u1160\u3164\uffa0\u2800",
}
_SAME = {ord(x): letter for letter, group in LOOKALIKES.items() for x in group}
#: A bracket before the word, or the word itself as a fence has it.
_FENCE = re.compile(r"(?P<bracket>\[\s*)untrusted|(?<!\(quoted\) )(?<![\[\w])untrusted\s*src\b")
#: Characters that a shown text never has: controls but tab and line end, and marks of direction.
UNSHOWN = r"[\x00-\x08\x0b-\x1f\x7f-\x9f\x{061c}\x{200e}\x{200f}\x{2028}-\x{202e}\x{2066}-\x{2069}]"
#: Lines that may hold a fence: the word, or anything that is not plain.
SUSPECT = r"(?i)untrusted|[^\x00-\x7f]"


@functools.lru_cache(maxsize=1 << 16)
def read_as(c: str) -> str:
    """How a character reads: small, without marks and what does not print, a lookalike as what it passes for."""
    known = c.translate(_SAME)
    kept = (x for x in unicodedata.normalize("NFKD", known).translate(_SAME) if x == "\t" or unicodedata.category(x) not in ("Cc", "Cf", "Mn", "Me"))
    return "".join(kept).casefold().translate(_SAME)


def defused_line(line: str) -> str:
    """The line with ``(quoted)`` before what reads as a fence; such a line loses what does not print."""
    reads = [read_as(c) for c in line]
    places = [*itertools.chain.from_iterable(itertools.repeat(i, len(r)) for i, r in enumerate(reads)), len(line)]
    out, at = [], 0
    for m in _FENCE.finditer("".join(reads)):
        start, word = places[m.start()], places[m.end("bracket") if m["bracket"] else m.start()]
        out += [line[at:start], "[(quoted) " if m["bracket"] else "(quoted) "]
        at = word
    if not out:
        return line
    shown = "".join(out) + line[at:]
    return "".join(c for c in shown if c == "\t" or unicodedata.category(c) not in ("Cc", "Cf"))


def _defused(text: str) -> str:
    return "\n".join(defused_line(line) if not line.isascii() or "untrusted" in line.lower() else line for line in text.split("\n"))


@F.pandas_udf(T.StringType())
def _defused_udf(texts: pd.Series) -> pd.Series:
    return texts.map(_defused, na_action="ignore")


def defused(text: Column) -> Column:
    """A text in which nothing reads as a fence; only texts that a looser native pattern flags reach the UDF."""
    shown = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), UNSHOWN, "")
    flagged = shown.rlike(SUSPECT)
    return F.when(flagged, _defused_udf(F.when(flagged, shown))).otherwise(shown)


def fenced(src: Column, loc: Column, text: Column) -> Column:
    """``[untrusted src:<id> begins <loc>]``, the defused text, ``[untrusted src:<id> ends]``."""
    return F.concat(F.lit("[untrusted src:"), src, F.lit(" begins "), loc, F.lit("]\n"), defused(text), F.lit("\n[untrusted src:"), src, F.lit(" ends]"))
