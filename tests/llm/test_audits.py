"""SimHash classes, the filter audit and spelling variants: against brute force, on hard tables, and their parts alone."""

import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
import xxhash
from claimlake.llm import simhash, spelling
from claimlake.llm.common import documents
from claimlake.llm.components import components
from claimlake.llm.filter_audit import COLUMNS, FILTERS, filter_audit, outcomes
from hypothesis import given, settings
from hypothesis import strategies as st

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, id long, b string, fp long, rep long, m int, part string, mask int, n long, word string, run string, h long, key long, none boolean, t string, size int"
EXTRA = (None, 7, "b", 1, 2, 3, "p", 4, 5, "w", "r", 6, 8, True, "t", 9)
PROSE = " ".join(f"word{i % 90} Andere" for i in range(300))
LONG = "lorem ipsum dolor " * 20_000
LETTERS = "a" * 300_000
SPELT = "separately separately separately separate1y separatley seperately seperately separatelyy separatelyy eparately eparately " + "separately " * 20


def rows():
    texts = [None, "", " \n\t", None, "one", "ONE", "one two", PROSE, PROSE, PROSE + " $", LONG, LONG + "x", SPELT, "été × ÷ Élan naïvement NAÏVEMENT naïvement", f"{LETTERS} {LETTERS} {LETTERS}b {LETTERS}b", "a" + chr(0) + "b"]
    out = [(i, t, "en" if i % 2 else "fr", *EXTRA) for i, t in enumerate(texts)]
    out += [(6, "one two", "de", *EXTRA), (6, PROSE, None, *EXTRA), (7, PROSE, "fr", *EXTRA), (None, PROSE, "", *EXTRA), (None, None, None, *EXTRA), (None, None, "en", *EXTRA)]
    return out


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 3 == 0, i % 5 == 0) for i in range(30)] + [(None, True, True), (8, None, None), (8, True, None)], "doc_id long, q boolean, x boolean").selectExpr("doc_id", "int(q) as quality", "int(x) as toxic", "1 as mask", "'a' as part")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def print_of(text):
    words = WORD.findall(lowered(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return find


def simhash_by_hand(table):
    """(id, text) -> rows; a row without an id links to nothing."""
    prints = [(i, print_of(t)) for i, t in table]
    ids = [(i, f) for i, f in prints if i is not None]
    find = linked((a, b) for a, f in ids for b, g in ids if bin(f ^ g).count("1") <= 2)
    return Counter((i, f"{f:016x}", None if i is None else find(i)) for i, f in prints)


def test_simhash_against_every_pair(spark, sf, hard):
    docs = documents(spark, sf)
    want = simhash_by_hand([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert Counter(map(tuple, simhash.simhash_duplicates(docs).collect())) == want
    assert Counter(map(tuple, simhash.simhash_duplicates(hard).collect())) == simhash_by_hand([r[:2] for r in rows()])


def near_prints(seed, centres=8, each=60):
    draw = np.random.default_rng(seed)
    flips = draw.choice(64, 9, replace=False)
    out = {int(c) ^ sum(1 << int(b) for b in draw.choice(flips, draw.integers(0, 6), replace=False)) for c in draw.integers(0, 2**64, centres, dtype=np.uint64) for _ in range(each)}
    return np.array(sorted(out), np.uint64)


@given(st.integers(0, 10**6), st.integers(0, 3))
@settings(max_examples=30, deadline=None)
def test_tries_give_every_pair_once(seed, budget):
    values = near_prints(seed)
    node = np.array([[0, len(values)]])
    got = [tuple(sorted(p)) for i, j in simhash.trie_links(values, node, node, budget) for p in zip(i.tolist(), j.tolist(), strict=True)]
    want = np.argwhere(np.triu(np.bitwise_count(values[:, None] ^ values) <= budget, 1))
    assert sorted(got) == sorted(map(tuple, want.tolist()))
    half = len(values) // 2
    sides = [tuple(p) for i, j in simhash.trie_links(values, np.array([[0, half]]), np.array([[half, len(values)]]), budget) for p in zip(i.tolist(), j.tolist(), strict=True)]
    assert sorted(sides) == sorted((i, j) for i, j in want.tolist() if i < half <= j)


@pytest.mark.parametrize(("node_rows", "levels"), [(1 << 16, 6), (12, 3), (40, 6)])
def test_large_subtrees_are_taken_down(spark, node_rows, levels):
    values = near_prints(5)
    classes = spark.createDataFrame([(int(v.astype(np.int64)), i) for i, v in enumerate(values)], "fp long, rep long")
    got = {r["node"]: r["component"] for r in components(simhash.similar(classes, node_rows=node_rows, levels=levels)).collect()}
    find = linked(map(tuple, np.argwhere(np.triu(np.bitwise_count(values[:, None] ^ values) <= 2, 1)).tolist()))
    assert {i: got.get(i, i) for i in range(len(values))} == {i: find(i) for i in range(len(values))}


def failures(text, id_, ids_of_text):
    words = WORD.findall(text)
    fails = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search("[#$%&*|]", text)))
    smaller = any(x is not None and (id_ is None or x < id_) for x in ids_of_text)
    return {f for f, x in zip(FILTERS, (*fails, smaller), strict=True) if x}


def audit_by_hand(table, labelled):
    ids, good, toxic = {}, {i for i, q, _ in labelled if q == 1}, {i for i, _, x in labelled if x == 1}
    for i, t, _ in table:
        ids.setdefault(t or "", set()).add(i)
    docs = [(part or "", failures(t or "", i, ids[t or ""]), i is not None and i in good, i is not None and i in toxic) for i, t, part in table]
    out, removals = {}, Counter()
    for part, fails, is_good, is_toxic in docs:
        for order in map("".join, permutations(FILTERS)):
            gone = False
            for step, own in enumerate(order, 1):
                row = out.setdefault((part, order, step), [0] * 6)
                hit = own in fails
                values = (not gone and not hit, not gone and hit, gone and hit, fails == {own}, not gone and hit and is_good, not gone and hit and is_toxic)
                removals[part, own] += not gone and hit
                for k, v in enumerate(values):
                    row[k] += v
                gone |= hit
    return {(*k, *v, removals[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_by_hand(spark, hard, labels):
    got = filter_audit(hard, labels).collect()
    want = audit_by_hand([r[:3] for r in rows()], [(r["doc_id"], r["quality"], r["toxic"]) for r in labels.collect()])
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_matrices_share_out_every_failure():
    m = outcomes()
    assert all(x.shape == (32, len(COLUMNS)) and x.dtype == np.int64 for x in m.values())
    own = np.array([order[step - 1] for order, step in COLUMNS])
    for mask in range(32):
        assert sum(m["removed"][mask, own == f].sum() for f in FILTERS) == (120 if mask else 0)
        assert m["kept"][mask].sum() + m["removed"][mask].sum() <= 600


def spelling_by_hand(table):
    counts = Counter()
    for i, text in table:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            k = h % len(run)
            counts[run[:k] + run[k + 1 :] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        p = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        return a[p + (len(a) >= len(b)) :] == b[p + (len(b) >= len(a)) :]

    out, form = [], {}
    for w, n in words.items():
        close = sorted((-m, x) for x, m in words.items() if near(w, x))
        if close and -close[0][0] >= 10 * n:
            form[w] = close[0][1]
        out.append((w, n, len(close)))
    root = lambda w: root(form[w]) if w in form else w
    return {(w, form.get(w), root(w), n, m, words.get(form.get(w))) for w, n, m in out}


def test_spelling_by_hand(hard, spark):
    got = spelling.spelling_variants(hard).collect()
    assert {tuple(r) for r in got} == spelling_by_hand([r[:2] for r in rows()]) and len(got) == len({r["word"] for r in got})
    assert {r["word"]: r["form"] for r in got}["seperately"] == "separately"
    chain = "".join(f"{w} " * n for w, n in (("abcdefgh", 400), ("abcdefgi", 39), ("abcdefji", 3), ("aabcdefgh", 400), ("bcdefgh", 7)))
    table = [(i, chain) for i in range(3)]
    got = {tuple(r) for r in spelling.spelling_variants(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert got == spelling_by_hand(table)


@given(st.lists(st.text("abé", min_size=1, max_size=6), min_size=2, max_size=40, unique=True))
@settings(max_examples=15, deadline=None)
def test_near_words_of_small_alphabets(spark, words):
    from pyspark.sql import functions as F

    vocabulary = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long").select("word", F.xxhash64("word").alias("w1"), F.xxhash64(F.lit(1), "word").alias("w2"), "n")
    got = {r["word"]: (r["n_near"], r["near"]) for r in spelling.near_words(vocabulary).collect()}
    by = {}
    for w in words:
        edits = {w[:k] + w[k + 1 :] for k in range(len(w))} | {w[:k] + c + w[k + d :] for k in range(len(w) + 1) for c in "abé" for d in (0, 1) if k + d <= len(w)}
        close = [x for x in words if x in edits and x != w]
        if close:
            by[w] = (len(close), max(close, key=words.index))
    assert got == by


def test_empty_tables(empty, labels):
    assert simhash.simhash_duplicates(empty).collect() == []
    assert filter_audit(empty, labels).collect() == []
    assert spelling.spelling_variants(empty).collect() == []
