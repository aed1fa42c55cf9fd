"""URL filter: a trie over reversed host labels and path segments; the longest rule wins.

The rule list is compiled on the driver and broadcast only while it has at most
``MAX_TRIE_RULES`` rules; a longer list is joined on the (host suffix, path
directory) keys of the distinct urls instead, with the same result.

Edge cases: a null url, or one without ``://``, has empty host and path and gets
the default verdict; an empty path starts with no rule path ``/``; of an allow
and a block entry with equal host and path, block wins; repeated urls are judged
alike; other columns, whatever their names, pass through untouched as long as
they are not the four that are added.
"""
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (host, path, verdict)
Rule = tuple[str, str, str]

#: Rules above this number are joined, not broadcast (about 100 MB of trie).
MAX_TRIE_RULES = 200_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url):
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, ASCII lower case; '' if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url):
    """What follows the host up to ``?``, ``#`` or the end; '' if there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def unique_rules(rules: list[Rule]) -> list[Rule]:
    best: dict[tuple[str, str], str] = {}
    for host, path, verdict in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"a rule allows or blocks, not {verdict!r}")
        if best.get((host, path)) != "block":
            best[host, path] = verdict
    return [(host, path, verdict) for (host, path), verdict in best.items()]


class UrlTrie:
    """Nodes are dicts: reversed host labels lead to a path trie, path segments to the rules that end there."""

    def __init__(self, rules: list[Rule]):
        self.root: dict = {"labels": {}, "paths": None}
        for host, path, verdict in unique_rules(rules):
            node = self.root
            for label in reversed(host.split(".")):
                node = node["labels"].setdefault(label, {"labels": {}, "paths": None})
            if node["paths"] is None:
                node["paths"] = {"segments": {}, "ends": {}, "sizes": []}
            at = node["paths"]
            *whole, start = path.split("/")
            for segment in whole:
                at = at["segments"].setdefault(segment, {"segments": {}, "ends": {}, "sizes": []})
            at["ends"][start] = (len(host) + len(path), host + path, verdict)
            if len(start) not in at["sizes"]:
                at["sizes"] = sorted([*at["sizes"], len(start)], reverse=True)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        best = (-1, "", "")
        node, segments = self.root, path.split("/")
        for label in reversed(host.split(".")):
            node = node["labels"].get(label)
            if node is None:
                break
            at = node["paths"]
            for segment in segments:
                if at is None:
                    break
                # The longest end that the segment starts with, by look-up: one for each length of an end, however many rules end here.
                for size in at["sizes"]:
                    found = at["ends"].get(segment[:size]) if size <= len(segment) else None
                    if found is not None:
                        best = max(best, found, key=lambda rule: rule[0])
                        break
                at = at["segments"].get(segment)
        return best[1:] if best[0] >= 0 else None


def judge_urls(df: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow", max_trie_rules: int = MAX_TRIE_RULES) -> DataFrame:
    """Adds host, path, rule (``host + path`` of the longest rule that fits, else null) and verdict.

    A rule fits its host and all subdomains, if the url's path starts with the rule's.
    """
    parts = df.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    if len(rules) > max_trie_rules:
        return _judge_by_join(parts, rules, default)
    trie = df.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judged(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        match = trie.value.match
        for hosts, paths in batches:
            found = [match(h, p) or (None, default) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame(found, columns=["rule", "verdict"])

    return parts.withColumn("_judged", judged("host", "path")).select(*parts.columns, "_judged.rule", "_judged.verdict")


def _judge_by_join(parts: DataFrame, rules: list[Rule], default: str) -> DataFrame:
    """The same by equi-joins on every (host suffix, path directory) of the distinct (host, path) pairs."""
    table = parts.sparkSession.createDataFrame([(h, p[: p.rfind("/") + 1], p, h + p, v, len(h) + len(p), len(h)) for h, p, v in unique_rules(rules)], "r_host string, r_dir string, r_path string, rule string, verdict string, r_len int, r_host_len int")
    keys = parts.select("host", "path").distinct()
    labels, segments = F.split("host", r"\."), F.split("path", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    folders = F.transform(F.sequence(F.lit(0), F.size(segments) - 1), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(segments, F.lit(1), i), "/"), F.lit("/"))))
    hits = (
        keys.withColumn("r_host", F.explode(suffixes)).withColumn("r_dir", F.explode(folders))
        .join(table, ["r_host", "r_dir"]).where(F.startswith("path", "r_path"))
        .groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct("r_len", "r_host_len")).alias("_hit"))
    )
    return parts.join(hits, ["host", "path"], "left").select(*parts.columns, F.col("_hit.rule").alias("rule"), F.coalesce("_hit.verdict", F.lit(default)).alias("verdict"))
