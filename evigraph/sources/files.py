"""Files as rows: a folder's bytes, their decoding, and text by format."""
import csv
import io
import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigraph.sources import texts

#: First bytes (hex) of formats that hold no text, and of the byte order marks.
BINARY = ("25504446", "89504E47", "504B0304", "47494638", "FFD8FF", "1F8B", "7F454C46")
WIDE_MARKS = ("FFFE", "FEFF", "0000FEFF")
#: Suffixes that are read, with the locator that quotes of them take.
LOCATORS = {"txt": "L", "md": "L", "json": "L", "jsonl": "L", "csv": "L", "tsv": "L", "html": "L", "vtt": "T", "srt": "T"}
#: Levels that JSON may nest.
DEEPEST = 500
TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s{}\[\],:"]+')


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of all files below a folder but hidden ones."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(~F.col("path").rlike(r"/\.[^/]*")).select("path", "content")


@F.pandas_udf(T.StringType())
def _wide(content: pd.Series) -> pd.Series:
    def text(data):
        if data is None:
            return None
        wide = data[:4] in (b"\xff\xfe\0\0", b"\0\0\xfe\xff")
        try:
            return data.decode("utf-32" if wide else "utf-16")
        except UnicodeDecodeError:
            return None

    return content.map(text, na_action="ignore")


def decoded(files: DataFrame) -> DataFrame:
    """Adds text and problem (``missing``, ``binary``, ``encoding`` or null): a byte order mark decides, else UTF-8; a NUL or a known first number is no text.

    Only files that are marked as two or four bytes a letter reach Python.
    """
    head = F.hex(F.substring("content", 1, 4))
    wide = F.exists(F.array(*[F.lit(m) for m in WIDE_MARKS]), lambda m: F.startswith(head, m))
    known = F.exists(F.array(*[F.lit(m) for m in BINARY]), lambda m: F.startswith(head, m))
    body = F.when(F.startswith(head, F.lit("EFBBBF")), F.expr("substring(content, 4)")).otherwise(F.col("content")).cast("string")
    plain = F.when(F.is_valid_utf8(body), body)
    binary = known | (~wide & F.contains(body, F.lit("\0")))
    text = F.when(~binary, F.when(wide, _wide(F.when(wide, F.col("content")))).otherwise(plain))
    out = files.withColumn("text", text)
    return out.withColumn("problem", F.when(F.col("content").isNull(), "missing").when(binary, "binary").when(F.col("text").isNull(), "encoding"))


def _refused(name: str):
    raise ValueError(name)


def indented(text: str | None) -> str | None:
    """JSON with one key a line, one blank a level, in its order and with its spelling of numbers; null where it is no JSON, holds NaN or an infinity, or nests deeper than ``DEEPEST``."""
    try:
        json.loads(text, parse_constant=_refused)
    except (TypeError, ValueError, RecursionError):
        return None
    out, depth, words = [], 0, TOKEN.findall(text)
    for before, word, after in zip(["", *words], words, [*words[1:], ""]):
        if word in ("{", "["):
            depth += 1
            if depth > DEEPEST:
                return None
            out.append(word if after in ("}", "]") else word + "\n" + " " * depth)
        elif word in ("}", "]"):
            depth -= 1
            out.append(word if before in ("{", "[") else "\n" + " " * depth + word)
        else:
            out.append(",\n" + " " * depth if word == "," else ": " if word == ":" else word)
    return "".join(out) + "\n"


@F.pandas_udf(T.StringType())
def json_text(values: pd.Series) -> pd.Series:
    return values.map(indented, na_action="ignore")


def cells_of(text: str | None) -> list[list[str]] | None:
    """The records of delimited text that hold anything, white space in a cell folded; null where it cannot be read.

    The mark that the first line has most often delimits; of equals the first of comma, tab, semicolon and bar.
    """
    body = (text or "").lstrip("\n")
    first = body.partition("\n")[0]
    try:
        csv.field_size_limit(max(len(body) + 1, 131_072))  # a cell may be as long as its text
        records = list(csv.reader(io.StringIO(body), delimiter=max(",\t;|", key=first.count)))
    except csv.Error:
        return None
    folded = [[" ".join(c.split()) for c in r] for r in records]
    return [r for r in folded if any(r)]


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def table_cells(values: pd.Series) -> pd.Series:
    return values.map(cells_of, na_action="ignore")


def table_text(cells):
    """``header: a | b`` and ``row N: a=1 | b=2`` of ``table_cells``; empty cells are left out.

    A column without a name is ``col<k>``, one past the header too; a name that stood before takes its count, as in `` (2)``.
    """
    width = F.size(F.get(cells, F.lit(0)))
    plain = F.transform(F.get(cells, F.lit(0)), lambda c, k: F.when(c == "", F.concat(F.lit("col"), k + 1)).otherwise(c))
    count = lambda c, k: F.size(F.filter(F.slice(plain, F.lit(1), k + 1), lambda x: x == c))
    names = F.transform(plain, lambda c, k: F.when(count(c, k) == 1, c).otherwise(F.concat(c, F.lit(" ("), count(c, k), F.lit(")"))))
    named = lambda c, k: F.when(c != "", F.concat(F.when(k < width, F.get(names, k)).otherwise(F.concat(F.lit("col"), k + 1)), F.lit("="), c))
    row = lambda r, n: F.concat(F.lit("row "), n + 1, F.lit(": "), F.array_join(F.transform(r, named), " | "))
    lines = F.transform(F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0))), row)
    head = F.concat(F.lit("header: "), F.array_join(names, " | "))
    return F.when(F.size(cells) == 0, "").otherwise(F.concat(F.array_join(F.concat(F.array(head), lines), "\n"), F.lit("\n")))


def extracted(files: DataFrame) -> DataFrame:
    """(path, kind, locator, text, problem) of files (path, content): text by suffix; another suffix is ``unsupported``, bad JSON ``json``, an unreadable table ``csv`` or ``tsv``."""
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    of = lambda *kinds: F.when(F.col("kind").isin(*kinds), F.col("text"))
    rows = decoded(files).withColumn("kind", F.when(kind == "htm", "html").otherwise(kind)).withColumn("_cells", table_cells(of("csv", "tsv")))
    text = F.when(F.col("kind") == "json", json_text(of("json"))).when(F.col("kind").isin("csv", "tsv"), table_text(F.col("_cells"))).when(F.col("kind") == "html", texts.html_text(of("html")))
    text = text.when(F.col("kind").isin("vtt", "srt"), texts.cue_lines(F.col("text"))).otherwise(F.col("text"))
    locators = F.create_map(*[F.lit(x) for pair in LOCATORS.items() for x in pair])
    locator = F.try_element_at(locators, F.col("kind"))
    rows = rows.withColumns({"_t": text, "locator": locator})
    problem = F.coalesce(F.col("problem"), F.when(F.col("locator").isNull(), "unsupported").when(F.col("_t").isNull(), F.col("kind")))
    return rows.select("path", "kind", "locator", F.when(problem.isNull(), F.col("_t")).alias("text"), problem.alias("problem"))


#: A source's text and its original file, by the name below the folder.
STORED = r"(?:^|/)(src-[0-9a-f]{12,64})(?:\.txt|\.orig(?:\.[A-Za-z0-9]+)?)$"


def stored_problems(index: DataFrame, files: DataFrame) -> DataFrame:
    """(code, id, path, problem): P14 rows where a folder of source texts and its index do not agree.

    index: (id, sha256, bytes) and perhaps erased; files: (path, content).  A source's text is missing, has another hash or size, or another
    hash than the id says; a file that no source has, hidden ones apart, is not listed.  An erased source's text may read as anything.
    """
    name = F.element_at(F.split("path", "/"), -1)
    own = F.nullif(F.regexp_extract("path", STORED, 1), F.lit(""))
    found = files.where(~F.startswith(name, F.lit("."))).select("path", own.alias("_of"), F.sha2("content", 256).alias("_sha"), F.octet_length("content").cast("long").alias("_bytes"), F.endswith("path", F.lit(".txt")).alias("_text"))
    erased = F.coalesce("erased", F.lit(False)) if "erased" in index.columns else F.lit(False)
    rows = index.select("id", "sha256", F.col("bytes").cast("long").alias("bytes"), erased.alias("_erased"))
    listed = rows.join(found.where("_text"), rows["id"] == found["_of"], "full_outer")
    problem = (
        F.when(F.col("id").isNull(), "is a file that the index does not list").when(F.col("path").isNull(), "has no text file").when(F.col("_erased"), None)
        .when(F.col("_sha") != F.col("sha256"), "has another sha256 than the index").when(~F.startswith(F.col("_sha"), F.substring("id", 5, 64)), "has an id that is not its text's sha256").when(F.col("_bytes") != F.col("bytes"), "has another size than the index")
    )
    texts_ = listed.select("id", "path", problem.alias("problem"))
    others = found.where("NOT _text").join(rows.select(F.col("id").alias("_of")), "_of", "left_anti").select(F.lit(None).cast("string").alias("id"), "path", F.lit("is a file that the index does not list").alias("problem"))
    return texts_.unionByName(others).where("problem IS NOT NULL").select(F.lit("P14").alias("code"), "id", "path", "problem")
