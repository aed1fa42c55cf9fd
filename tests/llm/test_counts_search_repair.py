"""Token counts, ranked search and conversation repair against the library, plain code and exhaustive search."""
import collections
import functools
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evigraph.llm import conversation_repair, lexical_search, queries, token_counts

SMALL = "/root/testdata/sf0.001"
BYTES = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, n_tokens string, rank string, score string"

# ---- 11


@functools.cache
def library():
    return Tokenizer.from_file(BYTES)


def counted_by_library(texts):
    return [len(e.ids) for e in library().encode_batch([t or "" for t in texts], add_special_tokens=False)]


def random_texts(n=400):
    rng = random.Random(1)
    pools = [" ab'srevltmd\n\t1!é ", "aeiou thern", "abcdefghijklmnopqrstuvwxyz", " \n\t\r\x85　x", "'srevl ", "0123456789 .-", "===---   ", "日本語テキ 你好", "ÃÂ", "👍🏽é́ñ "]
    return ["".join(rng.choice(p) for _ in range(rng.randint(0, 60))) for p in pools for _ in range(n)]


def test_transducers_count_as_the_library_does():
    texts = ["", None, "a<|endoftext|>b <|endoftext|> <|endoftext|>", "<|endoftext|>", "don't 'tis we'll I'ver 'lx 'rx ''s '", " " * 5000, "x" * 5000, "\n \n", *random_texts()]
    texts += ["".join(map(chr, range(a, a + 300))) for a in (0, 0x250, 0x530, 0x2000, 0x3000, 0x1F300, 0x11DD0)]
    for most in (token_counts.MOST_STATES, 50):
        n_bytes, n_tokens = token_counts.CompiledTokenizer(BYTES, most).counts(texts if most > 50 else texts[:600])
        assert n_tokens.tolist() == counted_by_library(texts)[:len(n_tokens)]
        assert n_bytes.tolist() == [len((t or "").encode()) for t in texts][:len(n_bytes)]


def test_chunk_maps_compose_to_the_plain_automaton():
    rng = np.random.default_rng(2)
    kinds = np.append(rng.integers(0, len(token_counts.CLASSES), 5000), 0).astype(np.uint8)
    state, cuts = "start", []
    for k in kinds:
        state, cut = token_counts.cut_step(state, token_counts.CLASSES[k])
        cuts.append(cut)
    expected = [bool(c & token_counts.HERE) or (i + 1 < len(cuts) and bool(cuts[i + 1] & token_counts.BEFORE)) for i, c in enumerate(cuts)]
    for chunk in (1, 7, 256, 10_000):
        assert token_counts.cut_marks(kinds, chunk).tolist() == expected


def test_long_texts_are_cut_where_the_pattern_cuts():
    rng = random.Random(4)
    text = "".join(rng.choice("ab c'd \n") for _ in range(20_000))
    parts = list(token_counts.stretches(text, 100))
    assert "".join(parts) == text and len(parts) > 50
    assert sum(counted_by_library(parts)) == counted_by_library([text])[0]
    assert list(token_counts.stretches("x" * 500, 100)) == ["x" * 500] and list(token_counts.stretches("")) == [""]


def test_other_tokenizer_files_are_refused():
    with pytest.raises(ValueError):
        token_counts.CompiledTokenizer(public_tokenizers.path("word_bpe_49k.json"))


def test_token_counts_query_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    expected = {d.doc_id: (len((d.text or "").encode()), n, n > 512) for d, n in zip(docs, counted_by_library([d.text for d in docs]), strict=True)}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op11_token_counts(spark, SMALL).collect()}
    assert got == expected
    odd = spark.createDataFrame([(1, None, "x", None, None), (2, "", None, None, None), (3, "one two", None, None, None), (3, "one two", None, None, None), (None, "word " * 50_000, None, None, None)], SCHEMA)
    out = token_counts.with_token_counts(odd, BYTES)
    assert out.columns == ["doc_id", "text", "rank", "score", "n_bytes", "n_tokens", "over_limit"]
    assert sorted((r.doc_id or 0, r.n_tokens) for r in out.collect()) == [(0, counted_by_library(["word " * 50_000])[0]), (1, 0), (2, 0), (3, 2), (3, 2)]
    assert token_counts.with_token_counts(odd.limit(0), BYTES).count() == 0


# ---- 12


def ranked_plainly(docs, items, k=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    small = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: pattern.findall((t or "").translate(small))
    known = [(i, collections.Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, length = len(known), sum(sum(c.values()) for _, c in known)
    df = collections.Counter(t for _, c in known for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in known:
            m = 25 + 75 * sum(c.values()) * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                scores.append((-score, doc is None, doc))
        out += [(item, rank, doc, -score) for rank, (score, _, doc) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def test_ranked_search_equals_plain_scores(spark):
    rng = random.Random(7)
    words = ["the", "The", "of", "naïve", "x1", "42", "über", "été", *(f"w{k}" for k in range(40))]
    sentence = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "-", "\x1f"]) for _ in range(n))
    docs = [(k, sentence(rng.randint(1, 60))) for k in range(300)] + [(300 + k, "the of w1 w2") for k in range(20)]
    docs += [(500, None), (501, ""), (502, "?! --"), (503, "w1 " * 3000), (7, "w1 w2"), (7, "w1 w2"), (None, "w1 w2 w3"), (None, "w1 w2 w3")]
    items = [(1, "The w1 w2 w2 unknown"), (2, None), (3, "nothing here"), (4, " ".join(f"w{k}" for k in range(40)) + " naïve ÜBER über"), (None, "w3 w3"), (6, "the")]
    items.append((7, " ".join(f"w{k % 40} z{k}" for k in range(200))))
    wide = "doc_id long, text string"
    frame, asked = spark.createDataFrame(docs, wide).repartition(5), spark.createDataFrame(items, "item_id long, text string")
    expected = ranked_plainly(docs, items)
    for most_items, most_terms in ((1000, 20_000), (2, 20_000), (1000, 3)):
        got = lexical_search.rank_documents(frame, asked, most_items=most_items, most_terms=most_terms).collect()
        assert sorted((tuple(r) for r in got), key=repr) == expected
    assert lexical_search.rank_documents(frame.limit(0), asked).count() == 0
    assert lexical_search.rank_documents(frame, asked.limit(0)).count() == 0


def test_masks_are_left_once_no_bound_can_reach_the_best():
    impact = np.zeros((2, 5000), np.int32)
    impact[0, :] = 5
    impact[1, :20] = 100
    best = lexical_search.Best(10)
    scored = lexical_search.search_masks(impact, np.arange(5000), np.array([1, 1]), best)
    assert best.id.tolist() == list(range(10)) and scored == 20
    masks, order, starts = lexical_search.masks_of(np.random.default_rng(1).integers(0, 2, (130, 50)).astype(bool))
    assert masks.shape[1] == 130 and sorted(order.tolist()) == list(range(50)) and starts[-1] == 50


# ---- 13


def repaired_by_search(codes):
    """Every sequence of edits whose cost is not above deleting all."""
    best = [3 * len(codes) + 1, ""]

    def go(i, out, cost, audit):
        if cost > best[0]:
            return
        if i == len(codes) and re.fullmatch(r"(s?(ua)+)?", out) and (cost, audit) < tuple(best):
            best[:] = cost, audit
        for x in "ua":
            if re.fullmatch(r"s?(ua)*u?", out + x):
                go(i, out + x, cost + 2, audit + "I")
        if i < len(codes):
            go(i + 1, out, cost + 3, audit + "D")
            for x in "sua" if codes[i] != "x" else "":
                if re.fullmatch(r"s?(ua)*u?", out + x):
                    late = codes[i].isupper()
                    if codes[i].lower() == x:
                        go(i + 1, out + x, cost + late, audit + "K")
                    if x != "s":
                        go(i + 1, out + x, cost + 2 + late, audit + "R")

    go(0, "", 0, "")
    return tuple(best)


def by_ranges(codes, cut):
    parts = [codes[k:k + cut] for k in range(0, len(codes), cut)] or [""]
    behind = [list(conversation_repair.ENDS)]
    for part in reversed(parts[1:]):
        costs = np.array(conversation_repair.range_costs(part)) + np.array(behind[-1])
        behind.append(conversation_repair.with_inserts(costs.min(axis=1).tolist()))
    audit, state = "", 0
    for part, cost in zip(parts, reversed(behind), strict=True):
        piece, state = conversation_repair.range_trace(part, state, cost)
        audit += piece
    first = np.array(conversation_repair.range_costs(parts[0])) + np.array(behind[-1])
    return int(first.min(axis=1)[0]), audit + conversation_repair.closing(state)


def test_alignment_equals_exhaustive_search():
    rng = random.Random(3)
    for length in (0, 1, 2, 3, 4, 5):
        for _ in range(60):
            codes = "".join(rng.choice("suaUAox") for _ in range(length))
            assert conversation_repair.aligned(codes) == repaired_by_search(codes) == by_ranges(codes, 2), codes
    for length in (30, 300):
        codes = "".join(rng.choice("uauauauasUAox") for _ in range(length))
        assert conversation_repair.aligned(codes) == by_ranges(codes, 7)


def digest_plainly(rows):
    """Counts of a damaged conversation, with its audit found by search over short ones and by ranges over others."""
    seen, faults, codes = set(), [], ""
    for _, role, text in rows:
        end = re.sub(r"[\x20\x09-\x0D]", "", text)[-1:]
        fault = "blank" if not end else "duplicate" if (role, text) in seen else "" if end in ".!?" else "truncated"
        seen.add((role, text))
        faults.append(fault)
        initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
        codes += "x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
    cost, audit = repaired_by_search(codes) if len(codes) < 6 else by_ranges(codes, 5)
    out, i, letter = [], 0, 0
    for edit in audit:
        if edit == "I":
            out.append(("user", "assistant")[letter] + ":")
        elif edit in "KR":
            role = rows[i][1] if edit == "K" else ("user", "assistant")[letter]
            out.append(f"{role}:{rows[i][2]}")
        if edit != "D" and not (edit == "K" and rows[i][1][:1] == "s"):
            letter = 1 - letter
        i += edit != "I"
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def conversations(rows):
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        blank = lambda x: " " if x is None else str(x)
        key, role, text = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20, blank(role), blank(text)
        out[conv]
        if key:
            text = "" if key == 1 else re.sub("[.!?]", "", text) if key == 2 else text
            out[conv] += [(turn, "user" if key == 4 else role, text)] * (2 if key == 3 else 1)
    ordered = {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, x in out.items()}
    return {c: digest_plainly(x) for c, x in ordered.items()}


ROWS = [
    (1, 0, "system", "Be brief."), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Yes"), (1, 3, "assistant", "Yes"), (1, 7, "user", " \t"), (2, None, None, None), (2, 5, "tool", "Done."), (2, 5, "tool", "Done."),
    (None, 1, "user", "a?"), (None, None, "assistant", "b?"), (3, 2, "", "no role."), (3, 1, "User", "Upper."), (4, 1, "assistant", "x" * 50_000 + "."),
]


@pytest.mark.parametrize("most_turns", [2048, 3, 0])
def test_repairs_equal_plain_code_whatever_their_length(spark, most_turns):
    rng = random.Random(9)
    rows = [*ROWS, *((10 + k, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["One. ", "Two!", "Three", "Four?\n"]) + str(t % 3) * (t % 2)) for k in range(8) for t in range(rng.randint(1, 25)))]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("cost", F.lit("x"))
    got = {r[0]: tuple(r[1:]) for r in conversation_repair.repair_conversations(conversation_repair.damaged(frame).repartition(3), most_turns).collect()}
    expected = conversations(rows)
    assert got.keys() == expected.keys()
    for conv in expected:
        assert got[conv] == expected[conv], conv
    turns = conversation_repair.repaired_turns(conversation_repair.damaged(frame), most_turns).collect()
    for conv in expected:
        text = "\n".join(f"{r.role}:{r.text}" for r in sorted((r for r in turns if r.conv_id == conv), key=lambda r: r.place))
        assert hashlib.sha256(text.encode()).hexdigest() == expected[conv][-1]


def test_repair_query_and_empty_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r[1:]) for r in queries.op13_conversation_repair(spark, SMALL).collect()}
    assert got == conversations(rows)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_repair.repair_conversations(conversation_repair.damaged(empty)).count() == 0
