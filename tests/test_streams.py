"""Streams against their batch twins on the same rows, and the readers of texts and files."""
import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from evigraph.functions import scalars as S
from evigraph.operators import evidence, logs, quality, search
from evigraph.sources import files
from evigraph.streaming import streams

START = dt.datetime(2024, 1, 1)
LINES = [(k, f"q{k % 3}", f"n{k % 4}", ["answered", "skipped", "later", "na"][k % 5 % 4], START + dt.timedelta(hours=k * 5 % 97)) for k in range(60)]


def streamed(spark, tmp_path, df, build, mode):
    """The rows of a stream over a table that arrives as one file."""
    source, name = str(tmp_path / "in"), "s" + tmp_path.name.replace("-", "_")
    df.coalesce(1).write.parquet(source)
    query = build(spark.readStream.schema(df.schema).parquet(source)).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return spark.table(name)


@pytest.fixture
def log(spark):
    return spark.createDataFrame(LINES, "seq long, q string, node string, status string, at timestamp")


def test_streamed_activity_equals_the_batch(spark, tmp_path, log):
    got = streamed(spark, tmp_path, log, streams.activity, "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, logs.activity(log).collect()))


def test_streamed_answers_equal_the_fold(spark, tmp_path, log):
    got = streamed(spark, tmp_path, log, streams.latest_answers, "update")
    want = logs.answer_fold(log).select("q", "node", "status", "seq", "skips")
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_streamed_points_equal_the_changed_ones(spark, tmp_path):
    points = spark.createDataFrame([(f"k{n % 2}", START + dt.timedelta(days=n), float(n // 4)) for n in range(20)], "key string, at timestamp, value double")
    got = streamed(spark, tmp_path, points, streams.changed_points, "append")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, logs.changed_points(points).select("key", "at", "value").collect()))


def test_streamed_texts_are_stored_once(spark, tmp_path):
    rows = spark.createDataFrame([(START + dt.timedelta(hours=k), text) for k, text in enumerate(["a", "a\n", "a\r\n", "b", "b", "c"])], "captured_at timestamp, text string")
    assert streamed(spark, tmp_path, rows, streams.stored_once, "append").count() == 3


def test_stems_of_columns_equal_plain_ones(spark):
    groups = {"water": "water waters watered watering", "creat": "create creates created creating", "polici": "policy policies", "rotat": "rotate rotates rotated rotating", "manage": "management", "run": "run runs running", "glas": "glasses"}
    # Checked by hand; the words of a group meet.
    assert {w: S._stem(w) for g in groups.values() for w in g.split()} == {w: s for s, g in groups.items() for w in g.split()} | {"management": "manag", "glasses": "glass"}
    assert [S._stem(w) for w in ("station", "nation", "ration", "information", "spring", "gas", "status", "basis", "boss", "x12s", "agreement", "hopped", "bed", "flies")] == ["station", "nation", "ration", "inform", "spr", "gas", "status", "basis", "boss", "x12s", "agr", "hop", "bed", "fly"]
    words = "stories glasses dishes boxes gas class status basis runs running noted billed buzzing sing red bed king agreed passing flies ties s ss hopped nation foundations movements employees x1s policy".split() + [w for g in groups.values() for w in g.split()]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", S.stem_of(F.col("w")).alias("s")).collect()
    assert {r["w"]: r["s"] for r in got} == {w: S._stem(w) for w in words}


def test_search_by_stem_takes_whole_words_only(spark):
    rows = spark.createDataFrame([("x:1", "x", "confirmed", "x:1", "meal plan", "meal planning for weeks", 0.0), ("x:2", "x", "confirmed", "x:2", "generated", "generated", 0.0), ("meals:3", "x", "archived", "meals:3", "old", "old", 0.0)], "id string, kind string, status string, nid string, lname string, hay string, boost double")
    found = {(r["q"], r["id"]): r["score"] for r in search.search(["plans", "rating", "week meals", "meal", ""], rows).collect()}
    assert found == {("plans", "x:1"): 140, ("week meals", "x:1"): 12, ("meal", "x:1"): 250}


def test_json_and_tables_as_text(spark):
    text = '{"b":[1.50,2e3,{"c":"x, {y}:\\"z"}],"a":{},"e":[]}'
    assert files.indented(text) == '{\n "b": [\n  1.50,\n  2e3,\n  {\n   "c": "x, {y}:\\"z"\n  }\n ],\n "a": {},\n "e": []\n}\n'
    assert json.loads(files.indented(text)) == json.loads(text)
    assert files.indented("{") is files.indented(None) is files.indented("[NaN]") is files.indented("[" * 501 + "]" * 501) is None and files.indented("7") == "7\n"
    long = "x" * 200_000
    tables = {
        'a;a;\n1;"x;y";\n;;\n;2;3;4\n': "header: a | a (2) | col3\nrow 1: a=1 | a (2)=x;y\nrow 2: a (2)=2 | col3=3 | col4=4\n", "": "", "\n \n": "", "a\tb\n\"p\n q\"\t2": "header: a | b\nrow 1: a=p q | b=2\n",
        f'a,b\n"{long},1': f"header: a | b\nrow 1: a={long},1\n", "name,name,name\n1,,3": "header: name | name (2) | name (3)\nrow 1: name=1 | name (3)=3\n", "a": "header: a\n", "a,b\n1\0,2": None,
    }
    rows = spark.createDataFrame([(t,) for t in tables], "t string").select("t", files.table_cells("t").alias("c")).select("t", files.table_text(F.col("c")).alias("x")).collect()
    assert {r.t: r.x for r in rows if "\0" not in r.t} == {k: v for k, v in tables.items() if "\0" not in k}


def test_files_of_a_folder(spark, tmp_path):
    for name, data in {"a.txt": b"\xef\xbb\xbfone", "b.md": "zwei ü".encode("utf-16"), "c.json": b"{", "d.bin": b"x", "e.txt": b"a\0b", "f.txt": b"\xff\x41", ".hidden.txt": b"no", "g.html": b"<title>T</title><p>a<p>b"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["problem"]) for r in files.extracted(files.read_folder(spark, str(tmp_path))).collect()}
    assert got == {"a.txt": ("one", None), "b.md": ("zwei ü", None), "c.json": (None, "json"), "d.bin": (None, "unsupported"), "e.txt": (None, "binary"), "f.txt": (None, "encoding"), "g.html": ("T\na\nb", None)}


def test_late_lines_across_blocks_and_first_records(spark):
    log = spark.createDataFrame([(k, 10 if k == 0 else k) for k in range(25)], "seq long, at long")
    assert sorted(r["seq"] for r in evidence.log_disorder(log, block=4).collect()) == list(range(1, 10))
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, None), ("b", 4, "y")], "id string, line int, name string")
    assert sorted(map(tuple, evidence.first_records(rows).collect())) == [("a", 2, "P05"), ("a", 3, "P06")]


def test_sources_against_a_folder_of_files(spark, tmp_path):
    sha = lambda data: hashlib.sha256(data).hexdigest()
    data = {n: f"text {n}\n".encode() for n in range(6)}
    ids = {n: "src-" + sha(d)[:12] for n, d in data.items()}
    for n in (0, 1, 2, 4, 5):
        (tmp_path / f"{ids[n]}.txt").write_bytes(data[n] if n != 1 else b"changed")
    for name in (f"{ids[0]}.orig.pdf", "src-000000000000.orig.pdf", "src-000000000000.txt", "loose.md", ".hidden"):
        (tmp_path / name).write_bytes(b"x")
    index = [(ids[n], sha(data[n]), len(data[n]) + (n == 2), n == 5) for n in range(5)] + [("src-ffffffffffff", sha(data[5]), 7, True)]
    rows = spark.createDataFrame(index, "id string, sha256 string, bytes long, erased boolean")
    got = {(r.id, r.path.rsplit("/", 1)[1] if r.path else None): r.problem for r in files.stored_problems(rows, files.read_folder(spark, str(tmp_path))).collect()}
    unlisted = "is a file that the index does not list"
    assert got == {
        (ids[1], f"{ids[1]}.txt"): "has another sha256 than the index", (ids[2], f"{ids[2]}.txt"): "has another size than the index", (ids[3], None): "has no text file", ("src-ffffffffffff", None): "has no text file",
        (None, f"{ids[5]}.txt"): unlisted, (None, "src-000000000000.txt"): unlisted, (None, "src-000000000000.orig.pdf"): unlisted, (None, "loose.md"): unlisted,
    }


def test_stale_alerts_equal_the_batch_at_three_moments(spark, tmp_path):
    day = lambda n: START + dt.timedelta(days=n)
    schema = "doc_id long, kind string, title string, url string, text string, captured_at timestamp, stale_after_days int"
    parts = [
        [(1, "file", "t", "u1", "one", day(0), 3), (2, "file", "t", "u2", "two", day(1), 10), (3, "file", "a", None, "three", day(1), 2), (4, "file", "b", None, "four", day(0), None), (5, "file", "t", "u1", "one\n", day(2), 9), (6, "web", "c", "u6", "six", day(2), 1)],
        [(7, "file", "t", "u1", "one b", day(2.5), 30), (8, "file", "c", None, "eight", day(6), 0), (9, "file", "t", "u2", "two b", day(5), 1)],
        [(10, "file", "a", None, "three b", day(12), 40), (11, "file", "d", None, "eleven", day(13), 1), (12, "file", "c", None, "eight b", day(20), 2)],
    ]
    source, seen = tmp_path / "in", []
    source.mkdir()
    for n, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(source / f"p{n}"))
        seen += part
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(source))
        query = streams.stale_alerts(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        last = {}
        for r in sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=lambda r: (r["at"], r["state"] == "fresh")):
            last[r["id"]] = r["state"]
        now = max(r[5] for r in seen)
        store = logs.source_store(spark.createDataFrame(seen, schema))
        want = {r["id"] for r in logs.stale_sources(store, F.lit(now)).collect()}
        assert {i for i, s in last.items() if s == "stale"} == want and (n == 0 or want)


def test_streamed_sessions_equal_the_batch(spark, tmp_path, log):
    late = spark.createDataFrame([(999, "q0", "far", "answered", START + dt.timedelta(days=400))], log.schema)  # moves the watermark past all sessions
    got = streamed(spark, tmp_path, log.unionByName(late), streams.answer_sessions, "append")
    want = logs.sessions(log, ["node"]).select("node", "started", "n").collect()
    assert sorted((r.node, r.started, r.n) for r in got.collect() if r.node != "far") == sorted(map(tuple, want))


def test_streamed_quotes_equal_the_batch(spark, tmp_path):
    texts = spark.createDataFrame([("s", "one two\nthree  four\nfive")], "id string, text string")
    prov = spark.createDataFrame([("r", 1, "s", "L1-L2", "two three four"), ("r", 2, "s", "L1-L1", "three"), ("r", 3, "s", "P", "four five"), ("q", 1, "none", "P", "x")], "record_id string, ord int, src string, loc string, quote string")
    got = streamed(spark, tmp_path, prov, lambda p: streams.verified_quotes(p, texts), "append")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, quality.quote_check(prov, texts).collect())) and got.count() == 3
