"""Explicit schemas of the graph tables and the registry's small dimension tables."""
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

PROV = "array<struct<src:string,loc:string,quote:string,by:string>>"
ARCHIVED = "struct<on:date,reason:string,decision:string,superseded_by:array<string>>"
NODES = (
    "ns string, id string, kind string, name string, summary string, status string, trust string, conf double, visibility string, attrs map<string,string>, aliases array<string>, "
    f"gaps array<struct<field:string,note:string>>, prov {PROV}, created date, updated date, change string, archived {ARCHIVED}, erased boolean"
)
EDGES = f"ns string, id string, src string, rel string, dst string, key string, status string, trust string, conf double, note string, background boolean, prov {PROV}, created date, updated date, change string, archived {ARCHIVED}"
SOURCES = "ns string, id string, kind string, title string, sha256 string, bytes long, lines long, captured_at timestamp, url string, fetched_at timestamp, via string, stale_after_days int, trust string, redactions map<string,int>, supersedes string, erased boolean, text string"
DECISIONS = "id string, at timestamp, question string, options array<struct<id:string,label:string>>, chosen string, chosen_text string, rationale string, scope array<string>, settles array<struct<id:string,field:string,values:array<string>>>, narrows string, status string, supersedes string, superseded_by string"
ANSWERS = "id string, at timestamp, q string, node string, status string, src string, proposal string, seq long"
CHANGES = "id string, at timestamp, type string, by string, ids array<string>, proposal string, source string, before string, after string, summary string"
HISTORY = "at timestamp, kind string, label string, values map<string,double>, denominators map<string,long>, breakdowns string, missing map<string,string>"
PROBLEMS = "code string, record_id string, message string"

STATUS_RANK = {"proposed": 0, "confirmed": 1, "archived": 2}
TRUST_RANK = {"untrusted": 0, "agent": 1, "reviewed": 2, "user": 3}


@dataclass
class Registry:
    """Kinds, relations and what kinds expect; a few hundred rows of configuration, so always broadcast."""

    kinds: DataFrame
    relations: DataFrame
    signatures: DataFrame
    expected_fields: DataFrame
    expected_relations: DataFrame
    dimensions: DataFrame


def registry(spark: SparkSession, kinds: list[tuple], relations: list[tuple], fields: list[tuple], expects: list[tuple], dimensions: list[tuple]) -> Registry:
    """kinds: (kind, hub, priority, boost, dimension); relations: (rel, inverse, symmetric, from, to); fields: (kind, field);
    expects: (kind, rel, direction, least); dimensions: (dimension, target)."""
    pairs = [(rel, a, b, False) for rel, _, _, src, dst in relations for a in src for b in dst]
    pairs += [(rel, b, a, False) for rel, _, symmetric, src, dst in relations for a in src for b in dst if symmetric]
    return Registry(
        spark.createDataFrame(kinds, "kind string, hub boolean, priority int, boost double, dimension string"),
        spark.createDataFrame([r[:3] for r in relations], "rel string, inverse string, symmetric boolean"),
        spark.createDataFrame([p[:3] for p in sorted(set(pairs))], "rel string, src_kind string, dst_kind string"),
        spark.createDataFrame(fields, "kind string, field string"),
        spark.createDataFrame(expects, "kind string, rel string, direction string, least int"),
        spark.createDataFrame(dimensions, "dimension string, target int"),
    )
