"""Text sources: extraction by format, chunks, redaction, secret scans, quarantined JSON lines, canonical lines."""
import bisect
import itertools
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCKS = frozenset("p div section article header footer nav aside main ul ol li dl dt dd table tr td th h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption form fieldset hr br title body".split())
SKIPPED = frozenset("script style svg template noscript math head".split())


def _no_repeats(pairs: list[tuple]) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise ValueError("repeated key")
    return dict(pairs)


def _refused(name: str):
    raise ValueError(name)


def is_strict_object(line: str | None) -> bool:
    """A JSON object without repeated keys, NaN or infinities."""
    try:
        return isinstance(json.loads(line or "", object_pairs_hook=_no_repeats, parse_constant=_refused), dict)
    except (ValueError, RecursionError):
        return False


@F.pandas_udf(T.BooleanType())
def strict_object(lines: pd.Series) -> pd.Series:
    return lines.map(is_strict_object).astype("boolean")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, problems): lines that are objects of the schema, and (code, file, line) of those that cannot be read; none is dropped silently.

    Blank lines are neither.  A line that is no object, repeats a key, holds NaN or does not fit the schema is a problem.
    """
    full = T.StructType.fromDDL(schema).add("_bad", "string")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")).where(F.trim("line") != "")
    read = lines.withColumn("r", F.from_json("line", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})).withColumn("ok", F.col("r").isNotNull() & F.col("r._bad").isNull() & strict_object("line"))
    return read.where("ok").select("r.*").drop("_bad"), read.where("not ok").select(F.lit("P01").alias("code"), "file", "line")


def canonical_lines(df: DataFrame, key: str = "id") -> DataFrame:
    """(value): one JSON line for each row, keys sorted, without blanks, ordered by key across partitions."""
    return df.repartitionByRange(key).sortWithinPartitions(key).select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))


class _Visible(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.title, self.skip, self.in_title = [], [], 0, False

    def handle_starttag(self, tag, attrs):
        if tag == "title":
            self.in_title = True
        elif tag in SKIPPED:
            self.skip += tag != "head"
        elif tag in BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        elif tag in SKIPPED:
            self.skip = max(0, self.skip - (tag != "head"))
        elif tag in BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.skip:
            self.out.append(data)


def visible_text(page: str | None) -> str | None:
    """Title first, then the visible text, a line for each block."""
    if page is None:
        return None
    parser = _Visible()
    parser.feed(page)
    parser.close()
    lines = [" ".join(x.split()) for x in ["".join(parser.title), *"".join(parser.out).split("\n")]]
    return "\n".join(x for x in lines if x)


@F.pandas_udf(T.StringType())
def html_text(pages: pd.Series) -> pd.Series:
    return pages.map(visible_text, na_action="ignore")


def csv_lines(df: DataFrame, names: list[str], row: str = "row") -> DataFrame:
    """(row, line): ``row N: a=1 | c=3`` of each record; empty cells are left out."""
    cells = F.filter(F.array(*[F.when(F.trim(F.col(c).cast("string")) != "", F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in names]), lambda x: x.isNotNull())
    return df.select(row, F.concat(F.lit("row "), F.col(row).cast("string"), F.lit(": "), F.array_join(cells, " | ")).alias("line"))


def cue_lines(text) -> object:
    """Lines ``T<hh:mm:ss> <cue>`` of WebVTT or SRT text: voice tags become ``Speaker: ``, other markup goes."""
    blocks = F.split(F.regexp_replace(text, "\r\n?", "\n"), r"\n\s*\n")

    def cue(block):
        stamp = F.regexp_extract(block, r"(?:(\d{1,2}):)?(\d{2}):(\d{2})[.,]\d{3}\s*-->", 0)
        hour, minute, second = (F.regexp_extract(block, r"(?:(\d{1,2}):)?(\d{2}):(\d{2})[.,]\d{3}\s*-->", k) for k in (1, 2, 3))
        body = F.regexp_replace(block, r"(?s)^.*?-->[^\n]*\n?", "")
        body = F.regexp_replace(F.regexp_replace(body, r"<v(?:\.[^ >]*)? ([^>]+)>", "$1: "), r"<[^>]*>", "")
        clean = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(body, "&lt;", "<"), "&gt;", ">"), "&amp;", "&"), r"\s+", " "))
        return F.when((stamp != "") & (clean != ""), F.concat(F.lit("T"), F.lpad(F.when(hour == "", "00").otherwise(hour), 2, "0"), F.lit(":"), minute, F.lit(":"), second, F.lit(" "), clean))

    return F.array_join(F.filter(F.transform(blocks, cue), lambda x: x.isNotNull()), "\n")


def chunk_spans(text: str | None, size: int = 1500) -> list[tuple[int, int, int, str]]:
    """(n, first line, last line, text): paragraphs packed up to ``size`` characters; a longer paragraph is cut at line ends.

    Over running sums of line lengths: a piece of a long paragraph ends at the last line whose sum still fits.  A chunk takes
    the next piece if both, without the blank lines between them, fit.
    """
    lines = (text or "").split("\n")
    upto = [0, *itertools.accumulate(len(x) + 1 for x in lines)]
    pieces = []
    for filled, run in itertools.groupby(range(len(lines)), lambda k: bool(lines[k].strip())):
        at, end = (span := list(run))[0], span[-1] + 1
        while filled and at < end:
            cut = min(end, max(at + 1, bisect.bisect_right(upto, upto[at] + size) - 1))
            pieces.append((at, cut))
            at = cut
    out: list[tuple[int, int]] = []
    for a, b in pieces:
        if out and upto[out[-1][1]] - upto[out[-1][0]] + upto[b] - upto[a] <= size:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return [(n, a + 1, b, "\n".join(lines[a:b])) for n, (a, b) in enumerate(out, 1)]


def chunks(df: DataFrame, key: str, text: str = "text", size: int = 1500) -> DataFrame:
    """(key, n, first, last, chunk)."""

    @F.pandas_udf("array<struct<n:int,first:int,last:int,chunk:string>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(("n", "first", "last", "chunk"), c, strict=True)) for c in chunk_spans(t, size)])

    return df.select(key, F.explode(cut(text)).alias("c")).select(key, "c.*")


#: Credentials are refused; personal data is masked.  Public formats.
CREDENTIALS = {
    "private_key": r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", "aws_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", "github_token": r"\bgh[pousr]_[A-Za-z0-9]{36,}\b", "slack_token": r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
    "bearer": r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]{16,}", "url_credentials": r"\b[a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s/@]+@", "credential": r"""(?i)\b[A-Za-z0-9_.-]*(?:(?:password|passwd|pwd|secret)["']?\s*[:=]\s*["']?[^\s,;"']{8,}|(?:key|token)["']?\s*[:=]\s*["']?[A-Za-z0-9_./+=-]{16,})""",
}
PERSONAL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", "government_id": r"\b(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b", "phone": r"(?<![\w+])(?<!\d[ .-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?![ .-]?\d)(?!\w)",
}
CARD = r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


#: First digits of card networks (Visa, American Express, Diners, JCB, Mastercard, UnionPay, Discover and Maestro) and how many digits they issue.
NETWORKS = [
    ("4", (13, 16, 19)), ("3[47]", (15,)), ("3[0689]", (14, 15, 16, 17, 18, 19)), ("35", (16, 17, 18, 19)), ("5[1-5]", (16,)), ("222[1-9]|22[3-9]|2[3-6]|27[01]|2720", (16,)), ("6|5[0678]", (13, 14, 15, 16, 17, 18, 19)),
]


def is_card(digits: str) -> bool:
    """Length by network prefix, and the Luhn sum."""
    return any(len(digits) in lengths and re.match(prefix, digits) for prefix, lengths in NETWORKS) and luhn(digits)


#: Typographic blanks, hyphens and full-width forms that stand for one ASCII character each.
FOLD = {c: " " for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)} | {c: "-" for c in (*range(0x2010, 0x2016), 0x2212, 0xFE58, 0xFE63)} | {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
ESCAPES = re.compile("(?:%[0-9A-Fa-f]{2})+")
#: Names of JSON fields whose text is a credential, those whose number is one too, and those that hold phone numbers.
SECRET_NAME = re.compile(r"(?i)(?:.*[^a-z0-9])?(?:pass(?:word|wd|phrase)|pwd|secret|(?:api|access|private|secret|signing|encryption)[^a-z0-9]?key|(?:auth|access|refresh|session|bearer|api|id)?[^a-z0-9]?token|client[^a-z0-9]?secret|credentials?)")
NUMBER_NAME = re.compile(r"(?i).*(?:password|passwd|pwd|secret|key)")
PHONE_NAME = re.compile(r"(?i)(?:.*[^a-z])?(?:phone|mobile|tel|telephone|cell|fax)(?:[^a-z].*)?|.*(?:Phone|Mobile)(?:Number|No)?")
PHONE_VALUE = re.compile(r"\+?[\d ().-]{7,40}")
#: What stands where a credential would: a variable, or a word that says so.
PLACEHOLDER = re.compile(r"(?is)\$\{?\w+\}?|\{\{.*\}\}|<.*>|%\w+%|(?:your|my|change|example|placeholder|redacted|\[redacted|none|null|todo|dummy|test).*")
TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s{}\[\],:"]+')


def percent_decoded(text: str) -> tuple[str, list[int]]:
    """The text with its escapes read as UTF-8, and where each of its characters began; one entry more for the end."""
    out, starts, at = [], [], 0
    for run in ESCAPES.finditer(text):
        out.append(text[at:run.start()])
        starts += range(at, run.start())
        place = run.start()
        for c in bytes.fromhex(run[0].replace("%", "")).decode("utf-8", "surrogateescape"):
            out.append("\ufffd" if "\udc80" <= c <= "\udcff" else c)
            starts.append(place)
            place += 3 * len(c.encode("utf-8", "surrogateescape"))
        at = run.end()
    out.append(text[at:])
    return "".join(out), [*starts, *range(at, len(text) + 1)]


def _copies(text: str) -> Iterator[tuple[str, list[int] | None]]:
    """The text and what it reads as when decoded or folded, with the places that spans of these come from."""
    yield text, None
    if ESCAPES.search(text):
        decoded, starts = percent_decoded(text)
        yield decoded, starts
        if (folded := decoded.translate(FOLD)) != decoded:
            yield folded, starts
    if (folded := text.translate(FOLD)) != text:
        yield folded, None


def _personal(text: str, policy: dict[str, str]) -> Iterator[tuple[int, int, str]]:
    """Spans of personal data and their kind."""
    for m in re.finditer(CARD, text):
        if policy.get("payment_card", "redact") != "keep" and is_card(re.sub(r"\D", "", m[0])):
            yield *m.span(), "payment_card"
    for kind, rule in PERSONAL.items():
        if policy.get(kind, "redact") != "keep":
            yield from ((*m.span(), kind) for m in re.finditer(rule, text))


class _Finding:
    """What was found in a text: counts of what was written over, and kinds that refuse the text."""

    def __init__(self, policy: dict[str, str]):
        self.policy, self.counts, self.refused = policy, {}, set()

    def over(self, kind: str) -> str:
        if self.policy.get(kind, "redact") == "refuse":
            self.refused.add(kind)
        else:
            self.counts[kind] = self.counts.get(kind, 0) + 1
        return f"[redacted:{kind}]"

    def plain(self, text: str) -> str:
        """One pass over the text and its copies; spans that overlap are written over as one, under the kind of the first and longest."""
        hits = []
        for copy, starts in _copies(text):
            self.refused |= {kind for kind, rule in CREDENTIALS.items() if re.search(rule, copy)}
            hits += [(s, -e, kind) if starts is None else (starts[s], -starts[e], kind) for s, e, kind in _personal(copy, self.policy)]
        out, at, merged = [], 0, []
        for s, less, kind in sorted(hits, key=lambda h: (h[0], h[1], h[2] != "payment_card", h[2])):
            if merged and s < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], -less)
            else:
                merged.append([s, -less, kind])
        for s, e, kind in merged:
            out += [text[at:s], self.over(kind)]
            at = e
        return "".join(out) + text[at:]

    def of_json(self, text: str) -> str:
        """The texts inside of a JSON value, by the names they stand under; all else stays as it is spelled."""
        out, at, names, name = [], 0, [], None
        tokens = list(TOKEN.finditer(text))
        for m, following in zip(tokens, [*(t[0] for t in tokens[1:]), ""], strict=True):
            word = m[0]
            if word in "{[":
                names.append(name)
            elif word in "}]":
                name = names.pop() if names else None
            elif word in ",:":
                continue
            else:
                value = json.loads(word) if word[0] == '"' else None
                kind, new = None, value
                if following == ":":
                    name, new = value, self.plain(value)
                elif value is not None:
                    if name and SECRET_NAME.fullmatch(name) and len(set(value)) > 2 and not PLACEHOLDER.fullmatch(value):
                        kind = "credential"
                    elif name and PHONE_NAME.fullmatch(name) and PHONE_VALUE.fullmatch(value.strip()):
                        kind = "phone"
                    else:
                        new = self.plain(value)
                elif name and re.fullmatch(r"-?\d.*", word):
                    if SECRET_NAME.fullmatch(name) and NUMBER_NAME.fullmatch(name):
                        kind = "credential"
                    elif PHONE_NAME.fullmatch(name) and re.fullmatch(r"\d{7,15}", word):
                        kind = "phone"
                if kind == "credential":
                    self.refused.add(kind)
                elif kind == "phone" and self.policy.get(kind, "redact") != "keep":
                    new = self.over(kind)
                if new != value and kind != "credential":
                    out += [text[at:m.start()], json.dumps(new, ensure_ascii=False)]
                    at = m.end()
        return "".join(out) + text[at:]

    def whole(self, text: str) -> str:
        """Lines that are JSON objects or lists, or a whole text that is one, are read by their fields, all else as text."""
        if _is_json(text):
            return self.of_json(text)
        out, run = [], []
        for line in text.splitlines(keepends=True):
            if _is_json(line):
                out += [self.plain("".join(run)), self.of_json(line)]
                run = []
            else:
                run.append(line)
        return "".join(out) + self.plain("".join(run))


def _is_json(text: str) -> bool:
    if text.lstrip()[:1] not in ("{", "["):
        return False
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return False
    return True


def redacted(text: str, policy: dict[str, str], most: int = 8) -> tuple[str | None, dict[str, int], list[str]]:
    """(clean text or None if refused, counts by kind, kinds refused): as it stands, decoded, folded and by JSON fields, again until it is stable."""
    found = _Finding(policy)
    for _ in range(most):
        before, text = text, found.whole(text)
        if text == before:
            break
    else:
        found.refused.add("unsettled")
    return (None if found.refused else text), found.counts, sorted(found.refused)


#: Texts without any of this hold nothing to redact.
SUSPECT = r"@|\d{2}|-----BEGIN|AKIA|ASIA|://|(?i)bearer|pass|pwd|secret|key|token|credential|gh[pousr]_|xox|%[0-9a-f]{2}|[\x{a0}\x{1680}\x{2000}-\x{200a}\x{2010}-\x{2015}\x{202f}\x{205f}\x{2212}\x{3000}\x{fe58}\x{fe63}\x{ff01}-\x{ff5e}]"


def redact(df: DataFrame, text: str = "text", policy: dict[str, str] | None = None) -> DataFrame:
    """Adds clean (null if refused), redactions and refused.  Only texts that a looser native pattern flags reach the UDF."""
    rules = dict(policy or {})

    @F.pandas_udf("clean string, redactions map<string,int>, refused array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([redacted(t, rules) if t is not None else (None, {}, []) for t in texts], columns=["clean", "redactions", "refused"])

    suspect = F.col(text).rlike(SUSPECT)
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))
    flagged = df.withColumn("_r", run(F.when(suspect, F.col(text))))
    return flagged.select(*df.columns, F.when(suspect, F.col("_r.clean")).otherwise(F.col(text)).alias("clean"), F.when(suspect, F.col("_r.redactions")).otherwise(empty).alias("redactions"), F.when(suspect, F.col("_r.refused")).otherwise(F.array().cast("array<string>")).alias("refused"))


def secret_scan(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line, kind, prefix): the line and first six characters of each credential; never more of it."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("line", "t")).select(key, (F.col("line") + 1).alias("line"), "t")

    def found(kind: str, rule: str):
        return F.transform(F.regexp_extract_all("t", F.lit(rule), F.lit(0)), lambda x: F.struct(F.lit(kind).alias("kind"), F.substring(x, 1, 6).alias("prefix")))

    hits = F.flatten(F.array(*[found(kind, rule) for kind, rule in CREDENTIALS.items()]))
    return lines.select(key, "line", F.explode(hits).alias("h")).select(key, "line", "h.kind", "h.prefix")


def find_text(tables: dict[str, tuple[DataFrame, str, list[str]]], wanted: str) -> DataFrame:
    """(table, id, path): every text field that holds a text, case and spacing ignored.  tables: name -> (rows, key, columns)."""
    from evigraph.functions.scalars import normalize_ws

    needle, out = " ".join(wanted.split()).lower(), None
    for name, (df, key, cols) in tables.items():
        fields = F.explode(F.array(*[F.struct(F.lit(c).alias("path"), F.col(c).cast("string").alias("value")) for c in cols])).alias("f")
        one = df.select(F.lit(name).alias("table"), F.col(key).cast("string").alias("id"), fields).where(F.contains(F.lower(normalize_ws(F.col("f.value"))), F.lit(needle))).select("table", "id", F.col("f.path").alias("path"))
        out = one if out is None else out.unionByName(one)
    return out


