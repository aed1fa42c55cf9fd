"""Wrong types and characters of records, line by line."""
import json

from evigraph.sources import shapes


def test_wrong_types_read_as_empty_and_are_told(spark):
    good = {"id": "a:1", "name": "One", "aliases": ["x", "y"], "attrs": {"n": 1.50, "t": "v", "deep\u2028": {"k": ["z"]}}, "summary": "two\nlines", "gaps": [{"field": "f", "note": "why"}], "prov": [{"src": "s", "quote": "q"}], "archived": {"on": "2024"}}
    bad = {"id": "a:2", "name": 5, "aliases": "x", "attrs": [1], "summary": ["s"], "gaps": {}, "prov": True, "archived": "gone"}
    none = {"id": "a:3", "name": None, "aliases": None}
    lines = [json.dumps(good), json.dumps(bad), json.dumps(none), "[1]", "{", "", '{"id":"a:4","id":"a:5"}', "7"]
    frame = spark.createDataFrame([(x,) for x in lines], "line string")
    rows = {r.id: r for r in shapes.read_nodes(frame).collect()}
    assert set(rows) == {"a:1", "a:2", "a:3"}
    one = rows["a:1"]
    assert (one.name, one.aliases, one.summary, one.gaps[0].note, one.prov[0].quote, json.loads(one.archived)) == ("One", ["x", "y"], "two\nlines", "why", "q", {"on": "2024"})
    assert one.attrs["t"] == '"v"' and json.loads(one.attrs["deep\u2028"]) == {"k": ["z"]} and float(one.attrs["n"]) == 1.5
    for i in ("a:2", "a:3"):
        r = rows[i]
        assert (r.name, r.aliases, r.summary, r.gaps, r.prov, r.attrs, r.archived) == ("", [], "", [], [], {}, None)
    found = [tuple(r) for r in shapes.shape_problems(frame, shapes.NODE, shapes.NODE_TEXTS).collect()]
    assert sorted(p for c, i, p, _ in found if i == "a:2") == sorted(shapes.NODE) and not [f for f in found if f[1] in ("a:1", "a:3")]
    assert [c for c, i, _, _ in found if i is None] == ["P01"] * 4


def test_characters_by_role(spark):
    rows = [
        {"id": "1", "name": "a\tb"}, {"id": "2", "summary": "a\tb\nc"}, {"id": "3", "summary": "bell\x07"}, {"id": "4", "aliases": ["ok", "x\u202ey"]}, {"id": "5", "prov": [{"quote": "x\u202ey\n"}]}, {"id": "6", "prov": [{"quote": "x\x85"}]},
        {"id": "7", "attrs": {"a": {"b": ["deep\u2028"]}}}, {"id": "8", "gaps": [{"note": "\u200b"}]}, {"id": "9", "name": "e\u200de"}, {"id": "10", "attrs": {"bad\x07key": "v"}},
    ]
    rows += [{"id": "11", "summary": 'say "\\\\" ' * 20_000 + "\x07"}]
    lines = [json.dumps(r) for r in rows] + [r'{"id":"h1","name":"cut \ud83d"}', r'{"id":"h2","name":"whole 😀"}', r'{"id":"h3","name":"\ude00 cut"}', r'{"id":"h4","name":"not one \\ud83d"}']
    got = {(r.id, r.path): r.problem for r in shapes.shape_problems(spark.createDataFrame([(x,) for x in lines], "line string"), shapes.NODE, shapes.NODE_TEXTS).collect()}
    assert {k: v.rsplit("U+", 1)[1] for k, v in got.items()} == {
        ("1", "name"): "0009", ("3", "summary"): "0007", ("4", "aliases"): "202E", ("6", "prov.quote"): "0085", ("7", "attrs"): "2028", ("8", "gaps.note"): "200B", ("11", "summary"): "0007", ("h1", ""): "D83D, half of a character", ("h3", ""): "DE00, half of a character",
    }
