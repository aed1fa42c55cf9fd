"""Corpus operators against brute force, exact round trips and held-out labels, and their edge cases."""
import collections
import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from evigraph.llm import factorization, html_extract, language, near_dup, packing, piece_sampling, quality_rules, queries, substring_dedup, url_filter, voronoi_knn

SMALL = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copy_of string, pattern string"


def odd_docs(spark, extra=()):
    """Nulls in every column, empty and blank texts, a long text, repeated rows, and columns whose names clash."""
    rng = random.Random(5)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(8000))
    rows = [(1, None, None, None, None, None, None), (2, "", "en", "s", 0, "x", "y"), (3, " \n\t", "en", "s", 3, "x", "y"), (4, long, "en", "s", len(long), "x", "y"), (5, long, "en", "s", len(long), "x", "y"), (6, "12 34 !!", "en", "s", 8, "x", "y"), (7, "one", None, None, None, None, None), (7, "one", None, None, None, None, None), (None, "two three", "en", None, None, None, None)]
    return spark.createDataFrame([*rows, *extra], SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- 1


def test_url_rules_by_trie_and_join(spark):
    hosts = ["org", "a.org", "example.org", "x.example.org", "notexample.org", "com", "b.com", "net", "EXAMPLE.org", "example.org.", "example.org:80", ""]
    paths = ["", "/", "/es/", "/es", "/es/1", "/en/1", "/en/12/x", "/en/2", "/fr/", "/de/x?q=/fr/", "/fr/#x", "?x=1", "#/es/"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "org/es/", "http:/x", "a://b://org/es/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = [*queries.URL_RULES, ("example.org", "/es/", "block"), ("example.org", "/es/", "allow")]

    def expected(url):
        if not url or "://" not in url:
            return "", "", None, "allow"
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:end].lower(), rest[end:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        fits = [(len(h + p), h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[1:] if fits else (None, "allow")))

    for limit in (1000, 0):
        got = {r["page_id"]: tuple(r[c] for c in ("host", "path", "rule", "verdict")) for r in url_filter.judge_urls(pages, rules, max_trie_rules=limit).collect()}
        assert got == {i: expected(u) for i, u in enumerate(urls)}
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


# ---- 2


def test_passages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r["doc_id"]: r["text"].split() for r in docs.select("doc_id", "text").collect()}
    covered = collections.defaultdict(set)
    for r in substring_dedup.repeated_passages(docs).collect():
        assert r["source_id"] < r["doc_id"] and r["n_words"] >= 50
        covered[r["doc_id"]] |= set(range(r["start_word"], r["end_word"]))
    first, windows = {}, 0
    for i in sorted(texts):
        for k in range(len(texts[i]) - 49):
            if first.setdefault(tuple(texts[i][k:k + 50]), i) != i:
                windows += 1
                assert set(range(k, k + 50)) <= covered[i]
    assert windows


def test_passages_shared_by_many_and_fuzzy(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(70)]
    changed = [word() if k % 20 == 10 else w for k, w in enumerate(passage)]
    rows = [(i, " ".join([word() for _ in range(30)] + (changed if i % 3 == 2 else passage) + [word() for _ in range(30)])) for i in range(60)]
    rows.append((100, " ".join(word() for _ in range(500))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in substring_dedup.repeated_passages(docs).collect()}
    assert set(found) == set(range(1, 60))
    assert all(abs(r["start_word"] - 30) <= 1 and abs(r["end_word"] - 100) <= 1 for r in found.values())
    kept = {r["doc_id"]: r["text"].split() for r in substring_dedup.drop_passages(docs, substring_dedup.repeated_passages(docs)).collect()}
    assert len(kept[0]) == 130 and all(58 <= len(kept[i]) <= 62 for i in range(1, 60)) and len(kept[100]) == 500


def test_passages_with_many_changed_words(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, want = [], set()
    for k in range(160):
        passage = [word() for _ in range(60)]
        every = (5, 8, 10, 12)[k % 4]
        # Regular changes, or as many at random: 0.8 to 0.92 alike.  Both ends of a passage stay as they are.
        at = set(range(every // 2, 59, every)) if k < 80 else set(rng.sample(range(1, 59), 60 // every))
        changed = [word() if i in at else w for i, w in enumerate(passage)]
        rows += [(2 * k, " ".join([word() for _ in range(20)] + passage + [word() for _ in range(20)])), (2 * k + 1, " ".join([word() for _ in range(20)] + changed + [word() for _ in range(20)]))]
        want.add(2 * k + 1)
    found = {r["doc_id"]: r for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(found) == want
    assert all(r["source_id"] == r["doc_id"] - 1 and r["similarity"] >= 0.8 for r in found.values())


def test_seeds_meet_their_first_occurrence(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("abcdef") for _ in range(rng.randrange(0, 60)))) for i in range(300)] + [(900, "a " * 50), (901, "a " * 9)]
    rng.shuffle(rows)
    first, want = {}, set()
    for i, text in sorted(rows):
        w = text.split()
        for k in range(len(w) - 3):
            own = tuple(w[k:k + 4])
            lead = first.setdefault(own, (i, k))
            if lead[0] != i and (k == 0 or tuple(w[k - 1:k + 3]) != own):
                want.add((i, k, *lead))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (None, 2, 0):  # seeds of every frequency by either way
        got = [tuple(r) for r in substring_dedup.seed_matches(docs.repartition(3), hot=hot)[1].where("NOT sparse").select("doc", "pos", "lead", "lead_pos").collect()]
        assert len(got) == len(set(got)) and set(got) == want
    keys = np.sort(np.random.default_rng(1).integers(0, 2**63, 500, dtype=np.uint64))
    docs_, pos = np.random.default_rng(2).integers(-5, 2**62, 500), np.arange(500, dtype=np.int64)
    assert all((x == y).all() for x, y in zip(substring_dedup.unpack(substring_dedup.pack(keys, docs_, pos)), (keys, docs_, pos), strict=True))


def test_exact_passages_whose_short_runs_are_old(spark):
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, at, planted = [], 0, []
    passages = [[word() for _ in range(60)] for _ in range(20)]
    for p in passages:  # each of a passage's 57 seeds lies in an earlier document of its own
        for k in range(57):
            rows.append((at, " ".join([word() for _ in range(10)] + p[k:k + 4] + [word() for _ in range(10)])))
            at += 1
    for times in range(2):
        for n, p in enumerate(passages):
            before = rng.randrange(5, 40)
            rows.append((at, " ".join([word() for _ in range(before)] + p + [word() for _ in range(30)])))
            planted += [(at, before, before + 60)] * times
            at += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.start_word, r.end_word) for r in substring_dedup.repeated_passages(docs.repartition(5)).collect()}
    assert found == set(planted)


def test_long_seeds_are_the_least_of_their_windows_and_meet_the_one_before(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(map(str, rng.integers(0, 50, n))) for n in (0, 3, 12, 26, 27, 28, 60, 200, 200)]
    grams, own, pos = substring_dedup.seeds_of(pd.Series(texts), 4)
    keys, text, place = substring_dedup.long_seeds(grams, own, pos, 4)
    want = set()
    for t, words in enumerate(x.split() for x in texts):
        g = grams[own == t]
        n = len(words) - 11
        if n < substring_dedup.WINDOW:
            continue
        long = [int(substring_dedup.mix64(substring_dedup.mix64(g[k:k + 1] + np.uint64(1)) + substring_dedup.mix64(g[k + 4:k + 5] + np.uint64(2)) + g[k + 8:k + 9])[0]) for k in range(n)]
        for s in range(n - substring_dedup.WINDOW + 1):
            least = min(long[s:s + substring_dedup.WINDOW])
            want |= {(t, k, least) for k in range(s, s + substring_dedup.WINDOW) if long[k] == least}
    assert set(zip(text.tolist(), place.tolist(), keys.tolist(), strict=True)) == want
    got = substring_dedup.previous_matches(np.array([5, 5, 5, 5, 7, 7], np.uint64), np.array([3, 1, 3, 2, 4, 4]), np.array([9, 1, 2, 3, 4, 5], np.int32))
    assert sorted(zip(got["doc"], got["pos"], got["lead"], got["lead_pos"], strict=True)) == [(2, 3, 1, 1), (3, 2, 2, 3)]


def test_passages_of_odd_rows(spark):
    rng = random.Random(11)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    same, long = text(60), text(30_000)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, same), (6, same), (None, same), (7, long), (8, long + " more"), (9, f"{text(40)} {same}"), (10, f"{same} {same}")]
    docs = spark.createDataFrame([(i, t, 1, "x", 9) for i, t in rows], "doc_id long, text string, start_word int, lead string, n_words int")
    got = {(r["doc_id"], r["start_word"], r["end_word"], r["source_id"]) for r in substring_dedup.repeated_passages(docs).collect()}
    assert got == {(6, 0, 60, 5), (8, 0, 30_000, 7), (9, 40, 100, 5), (10, 0, 120, 5)}
    kept = substring_dedup.drop_passages(docs, substring_dedup.repeated_passages(docs))
    assert kept.columns == docs.columns and {r["doc_id"]: r["text"] for r in kept.where("doc_id IN (1, 4, 5, 8)").collect()} == {1: None, 4: "one two", 5: same, 8: "more"}
    assert kept.where("doc_id IS NULL").first()["text"] == same and kept.where("doc_id IN (6, 10)").count() == 0
    assert substring_dedup.repeated_passages(docs.limit(0)).count() == 0


def test_chain_is_the_best_one():
    rng = np.random.default_rng(3)
    for _ in range(50):
        pos, lead = rng.integers(0, 30, 12), rng.integers(0, 30, 12)
        found = substring_dedup.chain(pos, lead, weight=8, gap_cost=0.15, max_gap=40)
        assert sorted(np.concatenate(found).tolist()) == list(range(12))
        assert all((np.diff(pos[c]) > 0).all() and (np.diff(lead[c]) > 0).all() for c in found)
        best = {}
        for i in np.lexsort((lead, pos)):
            best[i] = 8 + max([0, *(best[j] - 0.15 * (pos[i] - pos[j] + lead[i] - lead[j]) for j in best if pos[j] < pos[i] and lead[j] < lead[i])])
        c = found[0]
        assert 8 * len(c) - 0.15 * (pos[c[-1]] - pos[c[0]] + lead[c[-1]] - lead[c[0]]) == pytest.approx(max(best.values()))


# ---- 3


def test_sampled_pieces_decode_and_follow_their_distribution(spark):
    sampler = piece_sampling.PieceSampler(piece_sampling.PieceTable(PIECES))
    texts = ["", " ", "  a  b ", "\n\n x\t▁y é😀漢字 ▁", "a" * 3000, "\x00\ufffd", "hello world " * 50, "😀" * 40, "x" * 33]
    for text, ids in zip(texts, sampler.encode(["k"] * len(texts), texts), strict=True):
        assert sampler.decode(ids) == text
    n = 4000
    seen = collections.Counter(tuple(x.tolist()) for x in sampler.encode([str(i) for i in range(n)], ["hand"] * n))
    again = collections.Counter(tuple(sampler.sampled_long(" hand", i * 7919)) for i in range(n))
    weights = sampler.table.weights
    exact = {}

    def walk(rest, ids, p):
        if not rest:
            exact[ids] = p
        for k in range(1, len(rest) + 1):
            if rest[:k] in sampler.table.ids:
                i = sampler.table.ids[rest[:k]]
                walk(rest[k:], (*ids, i), p * weights[i])

    walk(" hand", (), 1.0)
    total = sum(exact.values())
    for ids, p in exact.items():
        assert abs(seen[ids] / n - p / total) < 0.03 and abs(again[ids] / n - p / total) < 0.03
    got = piece_sampling.decode_ids(piece_sampling.encode_sampled(odd_docs(spark), PIECES), PIECES)
    assert all(r["decoded"] == r["text"] for r in got.collect())
    one, four = (sorted(map(tuple, piece_sampling.encoding_digest(odd_docs(spark).repartition(k).select("doc_id", "text"), PIECES).collect()), key=str) for k in (1, 4))
    assert one == four and piece_sampling.encoding_digest(empty_docs(spark), PIECES).count() == 0


# ---- 4


def test_factorization_identity_and_held_out(spark):
    rng = np.random.default_rng(0)
    m = factorization.FactorizationMachine(0.1, rng.normal(size=20 + factorization.STATISTICS), rng.normal(size=(20 + factorization.STATISTICS, 3)), np.zeros(factorization.STATISTICS), np.ones(factorization.STATISTICS), 20)
    at, value, raw = np.array([2, 5]), np.array([0.5, -1.0]), rng.normal(size=factorization.STATISTICS)
    x = np.zeros(20 + factorization.STATISTICS)
    x[at], x[20:] = value, m.scaled(raw)
    pairs = sum((m.factors[i] @ m.factors[j]) * x[i] * x[j] for i in range(len(x)) for j in range(i))
    assert m.score(at, value, list(raw)) == pytest.approx(1 / (1 + np.exp(-(0.1 + m.weights @ x + pairs))))
    rows = queries.op4_quality_classifier(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.93
    flat = factorization.fit_quality(empty_docs(spark), spark.createDataFrame([], "doc_id long, quality int"))
    assert {r[0] for r in odd_docs(spark).select(factorization.quality_score(odd_docs(spark), "text", flat)).collect()} == {0.5}


# ---- 5


def brute_classes(texts):
    bags = {}
    for i, t in texts.items():
        w = t.split()
        bags[i] = collections.Counter(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter()
    holders = collections.defaultdict(list)
    for i, bag in bags.items():
        for x in bag:
            holders[x].append(i)
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in {(a, b) for own in holders.values() for a in own for b in own if a < b}:
        both = sum((bags[a] & bags[b]).values())
        if both >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - both):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in texts}


def test_near_duplicates_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(150)]
    extra = [(10_000 + i, " ".join(w if rng.random() > 0.02 else word() for w in base)) for i in range(60)]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicate_classes(docs).collect()}
    assert got == brute_classes(texts)


def test_large_mixed_buckets_are_decided_exactly(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(150)]
    # Independent edits of one text, most pairs below the threshold, and a near copy of some of them far off in any order of ids.
    first = [[w if rng.random() > 0.055 else word() for w in base] for _ in range(400)]
    second = [[*x[:60], word(), *x[61:]] for x in first[::10]]
    texts = {i: " ".join(x) for i, x in enumerate(first)} | {10_000 + i: " ".join(x) for i, x in enumerate(second)}
    hasher = near_dup.ShingleHasher()
    some = [*list(texts.values())[:20], *["a b c d e f a b c d e f"] * 2]
    few = [hasher.bag(x) for x in some]
    plain = np.array([[sum(min(c, dict(zip(*y)).get(k, 0)) for k, c in zip(*x)) for y in few] for x in few])
    keys, counts, text = hasher.bags(some)
    rows = np.array([3, 20])
    apart = rows[:, None] != np.arange(22)[None]
    assert near_dup.overlaps(keys, counts, text, 22, rows)[apart].tolist() == plain[rows][apart].tolist()
    # One bucket of all of them, each a class of its own: the blocks must find every class.
    rows = spark.createDataFrame([(1, i, i, 1_500_000) for i in texts], "bucket long, doc long, label long, size long")
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    links = near_dup.exact_links(rows, frame, 0.8, 5)
    got = {r["id"]: r["component"] for r in near_dup.connected_components(links, "a", "b").collect()}
    want = brute_classes(texts)
    assert {i: got.get(i, i) for i in texts} == want
    for parts in (1, 7, 200):
        assert {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicate_classes(frame.repartition(parts)).collect()} == want


def signature(hasher, text, m):
    keys, counts = hasher.bag(text)
    return near_dup.bag_min_hashes(keys, counts, np.zeros(len(keys), int), 1, m)[0]


def test_links_at_the_threshold_whose_signatures_agree_less(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    hasher, docs = near_dup.ShingleHasher(), []
    while len(docs) < 6:
        base = [word() for _ in range(94)]
        pair = " ".join(base), " ".join([*base[:84], *[word() for _ in range(10)]])  # 80 of 90 shingles each: 80 / 100
        a, b = (signature(hasher, x, 96) for x in pair)
        if (a == b).sum() < 66 and set(near_dup.band_keys(a[None], 24, 4)[0]) & set(near_dup.band_keys(b[None], 24, 4)[0]):
            docs += [(len(docs), pair[0]), (len(docs) + 1, pair[1])]
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicate_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4}


def test_signature_agreement_is_weighted_jaccard():
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 2**63, 60, dtype=np.uint64)
    a, b = rng.integers(1, 9, 60), rng.integers(1, 9, 60)
    a[:10] = 0
    m = 4096
    x, y = (near_dup.bag_min_hashes(keys[c > 0], c[c > 0], np.zeros((c > 0).sum(), int), 1, m)[0] for c in (a, b))
    assert (x == y).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.03)


# ---- 6


def test_trie_equals_a_scan_of_many_rules_in_one_folder():
    rng = np.random.default_rng(1)
    word = lambda most: "".join(rng.choice(list("ab"), rng.integers(0, most)))
    rules = [(h, "/" + "/".join(word(4) for _ in range(rng.integers(1, 4))), ("allow", "block")[rng.integers(2)]) for h in ("x.org", "org") for _ in range(150)]
    trie = url_filter.UrlTrie(rules)
    plain = url_filter.unique_rules(rules)
    for _ in range(500):
        host, path = ("a.x.org", "x.org", "y.org", "zx.org")[rng.integers(4)], "/" + "/".join(word(6) for _ in range(3))
        fits = [(len(h) + len(p), h + p, v) for h, p, v in plain if (host == h or host.endswith("." + h)) and path.startswith(p)]
        got = trie.match(host, path)
        assert got == (max(fits)[1:] if fits else None) or got in [f[1:] for f in fits if f[0] == max(fits)[0]]


def test_pivots_grow_within_a_broadcast():
    assert [voronoi_knn.pivot_count(n, 64) for n in (0, 500, 10**6, 10**9, 10**12)] == [64, 64, 1000, 16_384, 16_384]
    assert voronoi_knn.pivot_count(10**12, 4096) * 8 * 4096 <= voronoi_knn.PIVOT_BYTES


@pytest.mark.parametrize("query_rows", [16_000, 2])
def test_top_k_against_brute_force(spark, query_rows):
    rng = np.random.default_rng(6)
    vectors = [(int(i), [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(450, 6)))]
    vectors += [(1000 + i, vectors[7][1]) for i in range(300)] + [(2000, None), (2001, [1.0, None] * 3), (2002, [float("nan")] * 6), (2003, []), (2100, [float("inf")] * 6), (None, vectors[0][1])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    q = voronoi_knn.quantized(df)
    rows = {r["vec_id"]: np.array(r["v"]) for r in q.collect()}
    assert not rows.keys() & {2000, 2001, 2002, 2003, 2100}
    got = collections.defaultdict(list)
    for r in voronoi_knn.top_k_by_inner_product(q, F.col("vec_id") % 100 == 0, max_pivots=8, block_rows=50, query_rows=query_rows).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    for i in [i for i in rows if i % 100 == 0]:
        assert got[i] == sorted(((j, int(v @ rows[i])) for j, v in rows.items() if j != i), key=lambda x: (-x[1], x[0]))[:10]
    assert voronoi_knn.top_k_by_inner_product(q.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_top_k_refuses_products_that_could_wrap(spark):
    q = spark.createDataFrame([(k, [1 << 40, 1], 2) for k in range(3)], "vec_id long, v array<long>, dim int")
    with pytest.raises(Exception, match="63 bits"):
        voronoi_knn.top_k_by_inner_product(q, F.col("vec_id") == 0).collect()


# ---- 7


def test_packing_is_gapless_exact_and_tight(spark):
    from tokenizers import Tokenizer

    docs = odd_docs(spark, [(50 + i, "word " * (i * 37 % 900), "en", "s", 1, "x", "y") for i in range(80)])
    got = [r.asDict() for r in packing.pack_documents(docs, WORDS, capacity=512).collect()]
    whole = Tokenizer.from_file(WORDS)
    want = []
    for r in docs.collect():
        ids = np.array([*whole.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(r["doc_id"], k // 512, k, len(ids[k:k + 512]), zlib.crc32(ids[k:k + 512].tobytes())) for k in range(0, len(ids), 512)]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str) == sorted(want, key=str)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 512
    assert len(bins) <= -(-sum(r["length"] for r in got) // 512) + 1
    assert packing.pack_documents(empty_docs(spark), WORDS).count() == 0


def test_words_are_encoded_as_whole_texts_are():
    from tokenizers import Tokenizer

    rng = random.Random(1)
    letters = "aZ'sStT reVEml d.,!?0123456789²½éÉßŒœÿŸİıΣσς漢😀\u0301\u00a0\x85\x1c\t\n<|>ªµº__--¿«»ŉſ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["it's <|endoftext|> x<|startoftext|>y I'LL can't", "ΑΣ Σ"]
    whole = Tokenizer.from_file(WORDS)
    for text, ids in zip(texts, packing.WordTokenizer(WORDS).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_fullest_combination():
    rng = random.Random(3)
    for _ in range(100):
        left = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(5)}
        room = rng.randint(1, 90)
        sums = {0}
        for x, n in left.items():
            sums |= {s + x * k for s in sums for k in range(n + 1)}
        chosen = packing.fullest(left, room, sorted(left, reverse=True))
        assert sum(x * n for x, n in chosen.items()) == max(s for s in sums if s <= room)
        assert all(n <= left[x] for x, n in chosen.items())


# ---- 8


def test_languages_held_out_and_edges(spark):
    rows = queries.op8_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.98 and not any(r["rejected"] for r in rows)
    model = language.fit_languages(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    odd = language.score_languages(odd_docs(spark, [(60, "漢字漢字漢字漢字漢字漢字漢字漢字", "en", "s", 1, "x", "y")]), model)
    got = {r["doc_id"]: r for r in odd.collect()}
    assert all(got[i]["language"] == "und" and got[i]["rejected"] and got[i]["score"] == 0 for i in (1, 2, 3, 6))
    assert got[60]["rejected"] and 0 <= got[60]["score"] <= 1
    none = language.fit_languages(empty_docs(spark))
    assert {r["language"] for r in language.score_languages(odd_docs(spark), none).collect()} == {"und"}


def test_kneser_ney_against_plain_code():
    order, alphabet = 3, "abc "
    rng = random.Random(3)
    counts = {}
    for name, letters in (("x", "abc"), ("y", "bbca")):
        counts[name] = collections.Counter()
        for _ in range(30):
            padded = f" {''.join(rng.choice(letters) for _ in range(rng.randrange(1, 6)))} "
            for end in range(2, len(padded) + 1):
                counts[name][padded[max(0, end - order):end]] += 1

    def plain(own):
        """p(next | before) by the textbook recursion."""
        level = [collections.Counter() for _ in range(order + 1)]
        for g, n in own.items():
            level[len(g)][g] += n
        for k in range(order, 1, -1):
            for g in level[k]:
                level[k - 1][g[1:]] += 1

        def p(before, c):
            k = len(before) + 1
            lower = p(before[1:], c) if before else 1 / len(alphabet)
            total = sum(n for g, n in level[k].items() if g[:-1] == before)
            if not total:
                return lower
            ones, twos = (sum(1 for n in level[k].values() if n == x) for x in (1, 2))
            d = ones / (ones + 2 * twos) if ones and twos else 0.5
            kinds = sum(1 for g in level[k] if g[:-1] == before)
            return max(level[k][before + c] - d, 0) / total + d * kinds / total * lower

        return p

    tables, probability = {}, {name: plain(own) for name, own in counts.items()}
    for name, own in counts.items():
        for context, found in zip((False, True), language.kneser_ney(own, order, len(alphabet)), strict=True):
            for k, values in enumerate(found, 1):
                tables[name, k, context] = language.hash_arrays(values, k - context)
        for before in ("", "a", "ab", " a", "bc", " "):
            assert sum(probability[name](before, c) for c in alphabet) == pytest.approx(1)
    model = language.LanguageModel.of(["x", "y"], tables, order, len(alphabet))
    scorer = language.LanguageScorer(model)
    texts = ["abc", "b", "cc aab", "abcabcabc b a", "bb-ca 7 a_c", "", "12", None, "aaa " * 50]
    got, chars = scorer.entropies(texts)
    for text, row, n in zip(texts, got, chars, strict=True):
        words = [w for w in "".join(c if c.isalpha() else " " for c in text or "").split()]
        assert n == sum(len(w) + 1 for w in words)
        for c, name in enumerate(("x", "y")):
            want = 0
            for w in words:
                padded = f" {w} "
                want -= sum(np.log(probability[name](padded[max(0, i - order + 1):i], padded[i])) for i in range(1, len(padded)))
            assert row[c] * max(n, 1) == pytest.approx(want)
    again, _ = scorer.entropies(texts[::-1])
    assert np.allclose(again, got[::-1])


# ---- 9


def test_main_text_and_wrappers(spark):
    assert html_extract.main_text("<article><nav>m</nav><h1>T</h1><p>t\n u&nbsp;&amp;v</p><div id=comments>c</div></article><aside>x</aside>") == "T\nt u &v"
    for page, text in ((None, ""), ("", ""), ("plain", "plain"), ("<p>1 < 2", "1 < 2"), ("</div></p>x<script>a</scr", "x"), ("<p>a<p>b<div>c", "a\nb\nc")):
        assert html_extract.main_text(page) == text
    pages = [f"<html><body><div class=top>Welcome</div><div class=post><p>{k} one two three four five six seven eight</p>" + f"<p>more words that differ {k}</p>" * k + "</div><div class=low>The end</div></body></html>" for k in range(1, 6)]
    rules = html_extract.rules_of(pages)
    assert rules["constants"] == ["The end", "Welcome"] and rules["root"] == ["html", "body", "div.post"]
    shapes = " ".join(map(html_extract.shape, html_extract.infer_wrapper(pages)))
    assert "(<p> # </p>)+" in shapes
    df = spark.createDataFrame([(k, "http://h/", p, "clash") for k, p in enumerate(pages)] + [(9, None, None, None)], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(df).collect()}
    assert got[9] == "" and got[1] == "2 one two three four five six seven eight\nmore words that differ 2\nmore words that differ 2"


def test_blocks_of_a_single_page_are_no_template():
    bodies = ["<p>first body</p><blockquote>a quoted line</blockquote>", "<p>second body</p><h2>A lone heading</h2><p>more</p>", "<p>third body</p>"]
    pages = [f"<html><body><div class=top>Welcome</div><div class=post>{b}</div><div class=low>The end</div></body></html>" for b in bodies]
    rules = html_extract.rules_of(pages)
    assert rules["constants"] == ["The end", "Welcome"]
    got = [html_extract.main_text(p, rules) for p in pages]
    assert got == ["first body\na quoted line", "second body\nA lone heading\nmore", "third body"]


def plain_pages(spark):
    """Pages of the test data without semantic elements and class names that tell anything."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    bare = F.regexp_replace(F.regexp_replace("html", r"(</?)(nav|article|footer|header|aside|main)\b", "$1div"), 'class="ad"', 'class="x1"')
    return pages, pages.withColumn("html", bare)


def test_nameless_containers_give_the_same_articles(spark):
    named, bare = plain_pages(spark)
    texts = [{r["page_id"]: r["text"] for r in html_extract.extract_main_text(x).collect()} for x in (named, bare)]
    assert texts[0] == texts[1] and sum(map(bool, texts[0].values())) == len(texts[0])
    # The hosts' wrappers decide: some of these pages read alone give something else.
    assert any(html_extract.main_text(r["html"]) != texts[0][r["page_id"]] for r in bare.collect())


def test_template_texts_inside_of_the_article_go_with_a_wrapper_only(spark):
    body = lambda k: "".join(f"<p>Story {k} part {i} with words of its own</p>" for i in range(k + 2))
    pages = [f"<div><p>Our latest offers for all readers of this page, {k * 7}</p></div><div><h1>Title {k}</h1>{body(k)}<h4>Read more stories like this</h4></div><ul><li><a href=x>one {k}</a></li></ul>" for k in range(6)]
    rules = html_extract.rules_of(pages)
    assert "Read more stories like this" in rules["constants"]
    for k, page in enumerate(pages):
        want = "\n".join([f"Title {k}", *[f"Story {k} part {i} with words of its own" for i in range(k + 2)]])
        assert want in html_extract.main_text(page, rules) and "Read more" not in html_extract.main_text(page, rules) and "Read more" in html_extract.main_text(page)
    long = f"<html><body><div class=menu>{'<a href=x>menu</a> ' * 50}</div><article>{'<p>para</p>' * 20_000}</article></body></html>"
    assert html_extract.main_text(long) == "\n".join(["para"] * 20_000)
    odd = spark.createDataFrame([(1, None, None, "a", "b"), (2, "http://h/", "", "a", "b"), (3, "http://h/", long, "a", "b"), (3, "http://h/", long, "a", "b")], "page_id long, url string, html string, text string, _host string")
    got = html_extract.extract_main_text(odd)
    assert got.columns == ["page_id", "url", "html", "_host", "text", "n_chars"]
    assert sorted((r["page_id"], r["n_chars"], r["_host"]) for r in got.collect()) == [(1, 0, "b"), (2, 0, "b"), (3, 99_999, "b"), (3, 99_999, "b")]
    assert html_extract.extract_main_text(odd.limit(0)).count() == 0


def test_wrappers_accept_their_pages():
    """Brute force: every page matches the wrapper's regular expression, slots matching any text."""
    def pattern(nodes):
        out = []
        for x in nodes:
            if x[0] == "tag":
                out.append(re.escape(x[1]))
            elif x[0] == "text":
                out.append(re.escape(f"[{x[2]}]") if x[2] is not None else r"\[[^\]]*\]")
            else:
                out.append(f"(?:{pattern(x[1])}){html_extract.MARK[x[0]]}")
        return "".join(out)

    def flat(page):
        out, text = [], ""
        for kind, _, name, _, _ in html_extract.walked(page):
            if kind == "text":
                text += name
                continue
            out.append(f"[{text.strip()}]" if text.strip() else "")
            text = ""
            out.append({"open": f"<{name}>", "close": f"</{name}>"}.get(kind, ""))
        return "".join(out) + (f"[{text.strip()}]" if text.strip() else "")

    rng = random.Random(4)
    for _ in range(60):
        pages = []
        for k in range(4):
            parts = ["<div class=top>Welcome</div>", *[f"<p>text {rng.randrange(99)}</p>" for _ in range(rng.randrange(1, 6))]]
            if rng.random() < 0.5:
                parts.insert(1, "<h2>Offer</h2>")
            pages.append(f"<html><body>{''.join(parts)}<ul>{''.join(f'<li>{rng.randrange(9)}</li>' for _ in range(rng.randrange(1, 4)))}</ul></body></html>")
        whole = re.compile(pattern(html_extract.infer_wrapper(pages)))
        assert all(whole.fullmatch(flat(p)) for p in pages)


# ---- 10


def test_base_counts_against_plain_code(spark):
    import re

    def plain(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
        often = collections.Counter(windows)
        repeated = {k + d for k, w in enumerate(windows) if often[w] > 1 for d in range(3)}
        seen, dups = set(), 0
        for line in (text or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dups += line in seen
                seen.add(line)
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dups, len(repeated)

    rng = random.Random(9)
    texts = [None, "", " \n", "a\u00a0b \x1cc", "x\n x\nx\nx", *("".join(rng.choice("ab #é\n\t\u2028😀") for _ in range(rng.randint(0, 200))) for _ in range(300))]
    for text in texts:
        assert quality_rules.base_counts(text)[:5] == plain(text)
    rows = queries.op10_quality_rules(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    assert np.mean([(r["posterior"] >= 0.5) == bool(r["quality"]) for r in rows]) > 0.97
    assert quality_rules.keep_quality(empty_docs(spark)).count() == 0
    assert quality_rules.keep_quality(odd_docs(spark)).columns == odd_docs(spark).columns
    counted = quality_rules.with_counts(odd_docs(spark).withColumn("n_words", F.lit("x")))
    assert counted.columns.count("n_words") == 1 and {r["n_words"] for r in counted.where("doc_id IN (4, 5)").collect()} == {8000}


def test_accuracies_of_planted_rules_are_found():
    rng = np.random.default_rng(5)
    share, n = 0.7, 200_000
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.9, 0.75, 0.95, 0.85])
    good = rng.random(n) < share
    votes = np.where(rng.random((n, 8)) < right, 1, -1) * np.where(good, 1, -1)[:, None]
    votes[rng.random((n, 8)) < 0.4] = 0
    fitted = quality_rules.fit_patterns(dict(collections.Counter(quality_rules.pattern_codes(votes).tolist())))
    assert fitted.share == pytest.approx(share, abs=0.03)
    for k, name in enumerate(quality_rules.RULES):
        means_good, means_bad = good[votes[:, k] == 1].mean(), 1 - good[votes[:, k] == -1].mean()
        assert fitted.accuracies()[name] == (pytest.approx(means_good, abs=0.05), pytest.approx(means_bad, abs=0.05))
    kept = np.array([fitted.posteriors[int(c)] for c in quality_rules.pattern_codes(votes)]) >= 0.5
    assert (kept == good).mean() > 0.95
    # The same beliefs for a corpus of any size: copies of it change nothing but their weight.
    twice = quality_rules.fit_patterns({c: 50 * k for c, k in collections.Counter(quality_rules.pattern_codes(votes).tolist()).items()})
    assert twice.share == pytest.approx(fitted.share, abs=0.01)


# ---- all stages


def test_pipeline_stages_on_odd_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = docs.unionByName(odd_docs(spark).select(*docs.columns))
    for data in (odd, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, data, SMALL)
            assert out.columns == docs.columns
            assert out.count() <= data.count()


def test_pipeline_keeps_clean_documents_and_no_duplicates(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SMALL).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    kept = {r["doc_id"] for r in rows}
    classes = brute_classes(docs)
    assert not any(a != b and classes[a] == classes[b] for a in kept for b in kept)
    good = {r["doc_id"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 1").collect()}
    alone = {i for i in good if collections.Counter(classes.values())[classes[i]] == 1}
    assert len(alone & kept) >= 0.97 * len(alone)
