"""Records read line by line as variants: wrong-typed fields read as empty, and texts that may not stand where they stand are told."""
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields that every reader walks, and what they hold.
NODE = {"aliases": "list", "gaps": "list", "prov": "list", "attrs": "object", "name": "text", "summary": "text", "archived": "object"}
EDGE = {"prov": "list", "note": "text", "archived": "object"}
KINDS = {"list": "ARRAY", "object": "OBJECT", "text": "STRING"}
NAMES = {"list": "a list", "object": "an object", "text": "text"}
#: Texts of a record by path, and the role of each: ``line`` is one line, ``block`` may have several, ``quote`` stands as its source has it.
NODE_TEXTS = [("name", "line"), ("aliases", "line"), ("attrs", "line"), ("summary", "block"), ("gaps.note", "block"), ("prov.quote", "quote")]
EDGE_TEXTS = [("note", "line"), ("key", "line"), ("prov.quote", "quote")]

#: Characters that no text may hold, line ends, and marks that show a text other than it reads (joiners stay).
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\x{2028}\x{2029}]"
BREAK = r"[\t\n\r]"
FORMAT = r"[\x{061c}\x{200b}\x{200e}\x{200f}\x{202a}-\x{202e}\x{2060}\x{2066}-\x{2069}\x{feff}]"
#: Half a character, as a JSON line spells it.
HALF = r"(?i)(?<!\\)(?:\\\\)*(\\ud[89ab][0-9a-f]{2}(?!\\ud[c-f][0-9a-f]{2})|(?<!\\ud[89ab][0-9a-f]{2})\\ud[c-f][0-9a-f]{2})"
#: A field's name, or a text (its group), where no quote is escaped; what stands for escaped backslashes and quotes meanwhile.
_LITERAL = r'"[^"]*"\s*:|("[^"]*")'
_ESCAPED = [("\\\\", "\ue000"), ('\\"', "\ue001")]


def variants(lines: DataFrame) -> DataFrame:
    """Adds ``v``: the JSON of ``line`` as a variant; null where it is none, or repeats a key."""
    return lines.withColumn("v", F.try_parse_json("line"))


def _at(path: str) -> Column:
    return F.try_variant_get("v", f"$.{path}", "variant")


def kind_of(path: str) -> Column:
    """``STRING``, ``ARRAY``, ``OBJECT``, a number's type, ``VOID`` for null; null where there is no such field."""
    return F.regexp_extract(F.schema_of_variant(_at(path)), "^[A-Z]+", 0)


def wrong_fields(shape: dict[str, str]) -> Column:
    """Names of the fields that hold another type than ``shape`` has; null and absent fields do not."""
    found = [F.when((kind_of(name) != KINDS[want]) & (kind_of(name) != "VOID"), F.struct(F.lit(name).alias("field"), F.lit(NAMES[want]).alias("want"))) for name, want in shape.items()]
    return F.array_compact(F.array(*found))


def typed(name: str, want: str, as_: str) -> Column:
    """The field as ``as_``, empty where it is absent, null or of another type; an object that is not one is null."""
    empty = {"list": F.array(), "text": F.lit("")}.get(want, F.lit(None)).cast(as_)
    return F.coalesce(F.when(kind_of(name) == KINDS[want], F.try_variant_get("v", f"$.{name}", as_)), empty).alias(name)


def read_nodes(lines: DataFrame) -> DataFrame:
    """id, name, summary, aliases, attrs (values as JSON), gaps, prov, archived (as JSON) of node lines (line) that are JSON objects."""
    rows = variants(lines).where("v IS NOT NULL").where(F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0) == "OBJECT")
    attrs = F.when(kind_of("attrs") == "OBJECT", F.try_variant_get("v", "$.attrs", "map<string,variant>"))
    return rows.select(
        F.try_variant_get("v", "$.id", "string").alias("id"), typed("name", "text", "string"), typed("summary", "text", "string"), typed("aliases", "list", "array<string>"),
        F.coalesce(F.transform_values(attrs, lambda _, x: F.to_json(x)), F.create_map().cast("map<string,string>")).alias("attrs"),
        typed("gaps", "list", "array<struct<field:string,note:string>>"), typed("prov", "list", "array<struct<src:string,loc:string,quote:string,by:string>>"),
        F.when(kind_of("archived") == "OBJECT", F.to_json(_at("archived"))).alias("archived"),
    )


def strings_of(value: Column) -> Column:
    """Every text in a variant, at any depth; the names of an object's fields are none."""
    plain = F.to_json(value)
    for spelt, mark in _ESCAPED:
        plain = F.replace(plain, F.lit(spelt), F.lit(mark))
    literals = F.filter(F.regexp_extract_all(plain, F.lit(_LITERAL), F.lit(1)), lambda x: x != "")
    restored = lambda x: F.replace(F.replace(x, F.lit(_ESCAPED[0][1]), F.lit(_ESCAPED[0][0])), F.lit(_ESCAPED[1][1]), F.lit(_ESCAPED[1][0]))
    return F.transform(literals, lambda x: F.try_variant_get(F.try_parse_json(restored(x)), "$", "string"))


def text_slots(lines: DataFrame, texts: list[tuple[str, str]]) -> DataFrame:
    """(id, path, role, text) of every text of records (line, v); ``a.b`` reads b of each item of a list a."""
    def slots_of(path: str, role: str) -> Column:
        head, _, inner = path.partition(".")
        if inner:
            items = F.when(kind_of(head) == "ARRAY", F.try_variant_get("v", f"$.{head}", "array<variant>"))
            found = F.flatten(F.transform(items, lambda x: strings_of(F.try_variant_get(x, f"$.{inner}", "variant"))))
        else:
            found = strings_of(_at(head))
        return F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda t: F.struct(F.lit(path).alias("path"), F.lit(role).alias("role"), t.alias("text")))

    slots = [slots_of(path, role) for path, role in texts]
    return lines.select(F.try_variant_get("v", "$.id", "string").alias("id"), F.explode(F.concat(*slots)).alias("s")).select("id", "s.*")


def character_problem(text: Column, role: Column) -> Column:
    """Why a text may not stand in a slot of this role: a control character anywhere, a line end in one line, a mark that hides how it reads outside of a quote.  The character is named, never shown."""
    named = lambda rule: F.concat(F.lit("U+"), F.lpad(F.hex(F.conv(F.hex(F.encode(F.regexp_extract(text, f"({rule})", 1), "UTF-16BE")), 16, 10).cast("long")), 4, "0"))
    control, line, mark = text.rlike(CONTROL), (role == "line") & text.rlike(BREAK), (role != "quote") & text.rlike(FORMAT)
    return (
        F.when(control, F.concat(F.lit("holds the control character "), named(CONTROL))).when(line, F.concat(F.lit("holds a tab or line break "), named(BREAK)))
        .when(mark, F.concat(F.lit("holds the invisible formatting character "), named(FORMAT)))
    )


def shape_problems(lines: DataFrame, shape: dict[str, str], texts: list[tuple[str, str]]) -> DataFrame:
    """(code, id, path, problem): P02 rows of lines (line): fields of another type, characters that may not stand there, halves of characters; P01 rows of lines that are no JSON object."""
    read = variants(lines)
    whole = F.coalesce(F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0) == "OBJECT", F.lit(False))
    own = F.try_variant_get("v", "$.id", "string").alias("id")
    unread = read.where(~whole & (F.trim("line") != "")).select(F.lit("P01").alias("code"), F.lit(None).cast("string").alias("id"), F.lit("").alias("path"), F.lit("is no JSON object").alias("problem"))
    rows = read.where(whole)
    fields = rows.select(own, F.explode(wrong_fields(shape)).alias("w")).select(F.lit("P02").alias("code"), "id", F.col("w.field").alias("path"), F.concat(F.lit("is not "), F.col("w.want"), F.lit("; it reads as empty until the line is mended")).alias("problem"))
    half = F.upper(F.substring(F.regexp_extract("line", HALF, 1), 3, 4))
    halves = rows.where(F.col("line").rlike(HALF)).select(F.lit("P02").alias("code"), own, F.lit("").alias("path"), F.concat(F.lit("holds U+"), half, F.lit(", half of a character")).alias("problem"))
    told = text_slots(rows, texts).withColumn("problem", character_problem(F.col("text"), F.col("role"))).where("problem IS NOT NULL").select(F.lit("P02").alias("code"), "id", "path", "problem")
    return reduce(lambda a, b: a.unionByName(b), [unread, fields, halves, told])
