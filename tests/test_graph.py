"""Graph queries against their SQL on the smallest tables, and operators against hand-made cases."""
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from evigraph.functions import scalars as S
from evigraph.operators import changes, components, logs, quality, resolve, search, traverse
from evigraph.plans import oracle, queries
from evigraph.sources import texts

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SMALL}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = queries.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    want = duck.sql(oracle.oracle_sql()[name])
    assert sorted(want.columns) == cols
    rows = lambda found: sorted(repr(tuple(map(plain, r))) for r in found)
    quoted = ",".join(f'"{c}"' for c in cols)
    assert rows(df.select(*[f"`{c}`" for c in cols]).collect()) == rows(want.project(quoted).fetchall())


def test_components_of_a_chain_a_star_and_a_loop(spark):
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(40)]
    star = [("s0", f"s{i}") for i in range(1, 200)]
    edges = spark.createDataFrame([*chain, *star, ("z", "z"), ("c001", "c000"), (None, "q")], "src string, dst string")
    got = {r["id"]: r["component"] for r in components.connected_components(edges).collect()}
    assert got == {**{f"c{i:03}": "c000" for i in range(41)}, **{f"s{i}": "s0" for i in range(200)}, "z": "z"}
    assert components.connected_components(edges.limit(0)).count() == 0


def test_supersession_ends_and_loops(spark):
    rows = [("a", "b"), ("b", "c"), ("c", None), ("x", "y"), ("y", "x"), ("m", "gone")]
    df = spark.createDataFrame([(i, n, "superseded" if n else "active") for i, n in rows], "id string, superseded_by string, status string")
    got = {r["id"]: (r["state"], r["end"], r["steps"]) for r in traverse.supersession_ends(df).collect()}
    assert got["a"] == ("active", "c", 2) and got["c"] == ("active", "c", 0) and got["m"] == ("missing", "gone", 1)
    assert got["x"][0] == got["y"][0] == "loop"


def test_long_supersession_chains_are_no_loops(spark):
    rows = [(f"c{i:03}", f"c{i + 1:03}") for i in range(150)] + [("c150", None), ("x", "y"), ("y", "z"), ("z", "y")]
    df = spark.createDataFrame([(i, n, "superseded" if n else "active") for i, n in rows], "id string, superseded_by string, status string")
    got = {r["id"]: (r["state"], r["end"], r["steps"]) for r in traverse.supersession_ends(df).collect()}
    assert all(got[f"c{i:03}"] == ("active", "c150", 150 - i) for i in range(151))
    assert {got[i] for i in "xyz"} == {("loop", None, None)}
    merges = spark.createDataFrame([(f"c{i + 1:03}", f"c{i:03}") for i in range(150)], "keep string, drop string")
    assert {tuple(r) for r in changes.merge_targets(merges).select("drop", "keep").collect()} == {(f"c{i:03}", "c150") for i in range(150)}


def test_names_distances_and_slugs(spark):
    df = spark.createDataFrame([("Crème  Brûlée!", "creme brulee"), ("ABC-1", "abc 1"), ("Straße­", "strasse"), ("ca", "abc")], "a string, b string")
    rows = df.select(S.name_key("a").alias("k"), S.slugify("a").alias("s"), S.edit_distance(df.a, df.b, 3).alias("d"), "b").collect()
    assert [r["k"] for r in rows] == ["creme brulee", "abc 1", "strasse", "ca"]
    assert rows[0]["s"] == "creme-brulee" and rows[3]["d"] == 3
    assert S.alignment_distances(["abcd"], ["abdc"], 3).tolist() == [1]


def test_answer_fold_keeps_an_answer(spark):
    rows = [("q", "n", "answered", 1, 1), ("q", "n", "skipped", 2, 2), ("q", "m", "answered", 1, 3), ("q", "m", "na", 2, 4), ("q", "m", "later", 3, 5)]
    df = spark.createDataFrame(rows, "q string, node string, status string, t int, seq long").selectExpr("q", "node", "status", "timestamp_seconds(t) at", "seq")
    got = {r["node"]: (r["status"], r["skips"]) for r in logs.answer_fold(df).collect()}
    assert got == {"n": ("answered", 1), "m": ("later", 0)}


def test_duplicates_score_and_blocks(spark):
    nodes = spark.createDataFrame([("k:a", "k", "self", "Garden Shed", "confirmed", []), ("k:b", "k", "self", "garden shed!", "confirmed", []), ("k:c", "k", "self", "gardne shed", "confirmed", []), ("o:d", "o", "self", "Garden shed", "confirmed", []), ("k:e", "k", "self", "bed 1", "confirmed", []), ("k:f", "k", "self", "bed 2", "confirmed", [])], "id string, kind string, ns string, name string, status string, aliases array<string>")
    got = {(r["a"], r["b"]): r["score"] for r in resolve.duplicates(nodes).collect()}
    assert got[("k:a", "k:b")] == 1.0 and got[("k:a", "o:d")] == 0.7 and got[("k:a", "k:c")] == 0.7
    assert ("k:e", "k:f") not in got


def test_spelling_and_scopes(spark):
    vocab = spark.createDataFrame([("garden", 5), ("wardens", 1), ("bed", 2)], "word string, n long")
    got = {r["q"]: r["word"] for r in search.suggestions(spark.createDataFrame([("gadren",), ("bd",), ("zzzzzz",)], "q string"), vocab).collect()}
    assert got == {"gadren": "garden", "bd": "bed"}
    records = spark.createDataFrame([("a/b:c",), ("a/bx",)], "id string")
    scopes = spark.createDataFrame([("1", "a/b"), ("2", "a/b:c#attrs.x"), ("3", "a/b:")], "scope_id string, scope string")
    assert {tuple(r) for r in search.scope_overlaps(records, scopes).collect()} == {("a/b:c", "1"), ("a/b:c", "2"), ("a/b:c", "3")}


def test_phrases_of_many_words(spark):
    phrases = spark.createDataFrame([("a", "One two three, four five six"), ("b", "two three"), ("c", "!")], "id string, phrase string")
    t = spark.createDataFrame([("s", "nothing\nand one two three four five six seven"), ("r", "one two three four five")], "src string, text string")
    assert {(r["id"], r["src"], r["line"]) for r in search.phrase_lines(phrases, t).collect()} == {("a", "s", 2), ("b", "s", 2), ("b", "r", 1)}


def test_quotes_over_lines(spark):
    t = spark.createDataFrame([("s", "one two\nthree  four\nfive")], "id string, text string")
    prov = spark.createDataFrame([("r", 1, "s", "L1-L2", "two three four"), ("r", 2, "s", "L1-L1", "three"), ("r", 3, "s", "P", "four five"), ("r", 4, "s", "L2-L9", "five")], "record_id string, ord int, src string, loc string, quote string")
    assert {r["ord"]: r["found"] for r in quality.quote_check(prov, t).collect()} == {1: True, 2: False, 3: True, 4: True}


def test_new_ids_step_over_taken_ones(spark):
    names = spark.createDataFrame([("1", "k", "Bed"), ("2", "k", "bed"), ("3", "k", "bed!"), ("4", "k", "Shed")], "ref string, kind string, name string")
    got = {r["ref"]: r["id"] for r in changes.new_ids(names, spark.createDataFrame([("k:bed",), ("k:bed-3",)], "id string")).collect()}
    assert got == {"1": "k:bed-2", "2": "k:bed-4", "3": "k:bed-5", "4": "k:shed"}


def test_redaction_chunks_and_text():
    clean, counts, refused = texts.redacted("mail a@b.org, card 4111 1111 1111 1111, no 4111 1111 1111 1112", {})
    assert clean == "mail [redacted:email], card [redacted:payment_card], no 4111 1111 1111 1112" and counts == {"payment_card": 1, "email": 1} and not refused
    assert texts.redacted("password: hunter2hunter2", {})[0] is None
    spans = texts.chunk_spans("a\n\nb\nb\n\n" + "\n".join(["x" * 700] * 3), 1500)
    assert [(a, b) for _, a, b, _ in spans] == [(1, 7), (8, 8)]
    assert texts.visible_text("<html><head><title>T &amp; U</title><style>x</style></head><body><p>a<br>b</p><script>z</script></body></html>") == "T & U\na\nb"


def test_cues_and_bad_json_lines(spark, tmp_path):
    vtt = "WEBVTT\n\n00:01.000 --> 00:02.000\n<v Ann>Hi &amp; bye</v>\n\n1\n01:02:03,000 --> 01:02:04,000\n<b>x</b>\ny\n"
    got = spark.createDataFrame([(vtt,)], "t string").select(texts.cue_lines("t")).first()[0]
    assert got == "T00:00:01 Ann: Hi & bye\nT01:02:03 x y"
    (tmp_path / "n.jsonl").write_text('{"id":"a"}\n{"id":\n{"id":"b"}\n\n{"id":"c","id":"d"}\n{"id":"e","x":NaN}\n[1]\n3\n')
    rows, bad = texts.read_jsonl(spark, str(tmp_path), "id string")
    assert sorted(r["id"] for r in rows.collect()) == ["a", "b"] and bad.count() == 5
    assert {r["code"] for r in bad.collect()} == {"P01"} and bad.where("line = '[1]'").count() == 1


def test_secrets_are_found_under_their_kind_and_refused(spark):
    key, token = "AKIA" + "ABCDEFGHIJKLMNOP", "0123456789abcdef" * 2
    rows = [(1, f"x\nid {key} y"), (2, f'token = "{token}"\npassword: hunter22x'), (3, "the key: of the door"), (4, "card 4111 1111 1111 1111, not 4111 1111 1111 1112"), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = sorted(tuple(r) for r in texts.secret_scan(df, "id").collect())
    assert got == [(1, 2, "aws_key", "AKIAAB"), (2, 1, "credential", "token "), (2, 2, "credential", "passwo")]
    clean = {r["id"]: r for r in texts.redact(df).collect()}
    assert clean[1]["clean"] is None and clean[2]["refused"] == ["credential"] and clean[3]["clean"] == rows[2][1]
    assert clean[4]["clean"] == "card [redacted:payment_card], not 4111 1111 1111 1112" and clean[5]["clean"] is None and clean[6]["clean"] == ""


def test_accented_and_long_names_are_found_in_lines(spark):
    texts_ = spark.createDataFrame([("s", "first\nLa Caf\u00e9 de la Gare du Nord, Paris")], "src string, text string")
    names = spark.createDataFrame([("a", "caf\u00e9"), ("b", "Cafe de la gare du nord"), ("c", "nord de")], "id string, phrase string")
    assert {(r["id"], r["line"]) for r in search.phrase_lines(names, texts_).collect()} == {("a", 2), ("b", 2)}


def test_pages_short_ids_and_namespaces(spark):
    from evigraph.operators import answers

    df = spark.createDataFrame([(f"{i:02}", i % 3) for i in range(10)], "id string, n int")
    got = answers.page(df, [df.n.desc(), df.id], 3, 2).collect()
    assert [(r["id"], r["total"]) for r in got] == [("08", 10), ("01", 10), ("04", 10)]
    ids = spark.createDataFrame([("aabbcc",), ("aabbdd",), ("aaee00",), ("ffffff",)], "id string")
    assert {r["id"]: r["short"] for r in answers.short_ids(ids, 2).collect()} == {"aabbcc": "aabbcc", "aabbdd": "aabbdd", "aaee00": "aaee", "ffffff": "ff"}
    parts = answers.split_namespace(spark.createDataFrame([("x/part:1",), ("part:2",), ("self/part:3/4",)], "id string")).collect()
    assert [(r["ns"], r["local"]) for r in parts] == [("x", "part:1"), ("self", "part:2"), ("self", "part:3/4")]


def test_entry_point_without_the_corpus_folder(tmp_path):
    """A copy without the corpus folder and the pipeline still imports and lists the graph queries."""
    here = os.path.join(os.path.dirname(__file__), "..")
    shutil.copytree(os.path.join(here, "evigraph"), tmp_path / "evigraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(here, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op1_') or k == 'pipeline' for k in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == [str(len(queries.queries())), str(len(oracle.oracle_sql())), "False"], out.stderr
