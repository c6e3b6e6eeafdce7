"""Vectorised primitives against plain Python."""

import functools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from claimlake.llm import langid, quality_rules, textkit, token_counts, tokens
from claimlake.llm.components import stars
from claimlake.llm.exact_dedup import PatriciaTrie
from claimlake.llm.near_dedup import collisions, links
from claimlake.llm.packing import Complements, plan
from claimlake.llm.quality_classifier import FEATURES, features
from claimlake.llm.sharding import fisher_yates
from claimlake.llm.token_output import best_fit_decreasing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = {i: i + 32 for i in range(65, 91)}
texts = st.lists(st.text(alphabet="aAbÉß \n\t  z!", max_size=60), min_size=1, max_size=8)


def shingles(text, size=5):
    w = WORD.findall(text.translate(ASCII_LOWER))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def batch(values):
    return next(iter(textkit.chunks(pa.array([v.encode() for v in values], pa.binary()))))[2:]


@settings(max_examples=200, deadline=None)
@given(texts)
def test_shingle_sets_count_and_intersect_like_sets_of_words(values):
    found = textkit.shingle_sets(*batch(values))
    for text, hashes in zip(values, found, strict=True):
        assert len(hashes) == len(shingles(text))
    for i in range(len(values) - 1):
        assert len(np.intersect1d(found[i], found[i + 1])) == len(shingles(values[i]) & shingles(values[i + 1]))


def test_chunks_cover_nulls_empty_and_long_texts(monkeypatch):
    monkeypatch.setattr(textkit, "CHUNK", 10)
    column = pa.chunked_array([pa.array([b"ab", None, b""], pa.binary()), pa.array([], pa.binary()), pa.array([b"x" * 100, b"y"], pa.binary())])
    got = [bytes(data[o[k] : o[k + 1]]) for _, _, data, o in textkit.chunks(column) for k in range(len(o) - 1)]
    assert got == [b"ab", b"", b"", b"x" * 100, b"y"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=6), st.one_of(st.none(), st.integers(0, 50))), max_size=40), st.booleans())
def test_trie_owns_like_a_dictionary(rows, largest):
    trie, want = PatriciaTrie(largest), {}
    for key, owner in rows:
        trie.insert(key, owner)
        known, n = want.get(key, (None, 0))
        ids = [x for x in (known, owner) if x is not None]
        want[key] = ((max if largest else min)(ids) if ids else None, n + 1)
    got = list(trie.spill())
    assert [k for k, _, _ in got] == sorted(want) and {k: (o, n) for k, o, n in got} == want
    assert list(trie.spill()) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=6), max_size=30), st.sets(st.integers(0, 30)))
def test_a_spill_of_complete_subtrees_leaves_the_path_of_the_last_key(texts, spills):
    trie, got = PatriciaTrie(False), []
    keys = sorted(t.encode() for t in texts)
    for k, key in enumerate(keys):
        trie.insert(key, k)
        if k in spills:
            held = trie.held
            gone = list(trie.spill(key))
            assert all(x < key for x, _, _ in gone) and trie.held <= held - sum(200 for _ in gone)
            got += gone
    got += list(trie.spill())
    assert sorted(got) == sorted((key, keys.index(key), keys.count(key)) for key in set(keys))


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 40), max_size=12))
def test_plan_uses_every_piece_once_and_overfills_nothing(counts):
    slots = plan(counts, 32)
    rows = {}
    for length, first, n, sequence, offset in slots.tolist():
        for k in range(n):
            rows.setdefault(sequence + k, []).append((offset, length, (length, first + k)))
    seen = [p for row in rows.values() for _, _, p in row]
    assert sorted(seen) == sorted((length, r) for length, n in counts.items() for r in range(n))
    for row in rows.values():
        at = 0
        for offset, length, _ in sorted(row):
            assert offset == at
            at += length
        assert at <= 32
    fills = sorted(sum(length for _, length, _ in row) for row in rows.values())
    assert len(fills) < 2 or fills[0] + fills[1] > 32  # what one row holds fitted no row before it


def test_plan_finds_exact_singles_pairs_and_triples():
    assert len(set(plan({20: 2, 12: 2}, 32)[:, 3])) == 1  # twice the same row
    assert plan({20: 1, 7: 1, 5: 1}, 32)[:, 3].max() == 0
    assert plan({20: 1, 6: 1, 4: 1, 2: 1}, 32)[:, 3].max() == 0
    assert plan({}, 32).shape == (0, 5)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(1, 4), max_size=10), st.data())
def test_complements_index_every_exact_filling_under_the_counts(counts, data):
    """Before and after pieces are taken, against all combinations."""
    import itertools

    free = np.zeros(25, np.int64)
    for length, n in counts.items():
        free[length] = n
    index = Complements(free)
    while True:
        pieces = [length for length in range(25) for _ in range(min(3, free[length]))]
        sums = {sum(c): len(c) for k in (3, 2, 1) for c in itertools.combinations(pieces, k)}
        for gap in range(1, 25):
            found = index.fill(gap)
            assert (len(found) if found else None) == sums.get(gap)
            if found:
                assert sum(found) == gap and all(free[x] >= found.count(x) for x in found)
        if not pieces:
            break
        length = data.draw(st.sampled_from(pieces))
        index.take(length, data.draw(st.integers(1, int(free[length]))))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=40))
def test_best_fit_decreasing_like_a_search_over_all_rows(lengths):
    rows = best_fit_decreasing(lengths, 16)
    assert sorted(i for row in rows for i in row) == list(range(len(lengths)))
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= n]
        room.remove(min(fits)) if fits else None
        room.append((min(fits) if fits else 16) - n)
    assert sorted(16 - sum(lengths[i] for i in row) for row in rows) == sorted(room)


def test_fisher_yates_is_a_seeded_uniform_permutation():
    assert sorted(fisher_yates(100, 1, 2)) == list(range(100)) and (fisher_yates(100, 1, 2) == fisher_yates(100, 1, 2)).all()
    first = np.bincount([fisher_yates(4, s, 0)[0] for s in range(4000)], minlength=4)
    assert first.min() > 900
    assert len(fisher_yates(0, 1)) == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["naïve café", "<|endoftext|>", "a  b\n\n c", "日本語 テキスト", "it's 12345", " 　x", "🙂🙂", "x" * 300]), max_size=5).map(" ".join))
def test_tokens_are_those_of_the_json_vocabulary(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder, widths = tokens.load(tokens.vocabulary())
    ids = tokens.encode(encoder, text)
    assert ids.tolist() == slow.encode(text, add_special_tokens=False).ids
    assert widths[ids].sum() == len(text.encode())
    plain = tokens.encode(encoder, text, added=False)
    assert widths[plain].sum() == len(text.encode()) and 50256 not in plain


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([" ", "\n", "\u3000", "\x85", "  \n", "     ", "\t" * 7, "a", "é!", "7", "<|endoftext|>", "\x1c\x1c\x1c", "'s"]), max_size=12).map("".join))
def test_long_runs_are_cut_as_the_pattern_cuts_them(text):
    encoder, widths = tokens.load(tokens.vocabulary())
    before, tokens.LONG_RUN = tokens.LONG_RUN, 2
    try:
        ids = tokens.encode(encoder, text)
    finally:
        tokens.LONG_RUN = before
    assert ids.tolist() == unmodified().encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 10**7, "x" + "\n" * 10**7 + "y", "a" * 10**7, "x" + " " * 1_500_000 + "<|endoftext|>" + "\n \u3000" * 400_000 + " y"], ids=["spaces", "newlines", "letter", "mixed"])
def test_texts_of_one_character_have_the_ids_of_the_unmodified_vocabulary(text):
    encoder, _ = tokens.load(tokens.vocabulary())
    assert (tokens.encode(encoder, text) == np.array(unmodified().encode(text, add_special_tokens=False).ids)).all()


@functools.cache
def unmodified():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["naïve café", "<|endoftext|>", "<|endoftext|", " ", "\n\n", "日本語", "it's 12345", "🙂"]), max_size=7).map("".join))
def test_added_tokens_are_those_of_the_unmodified_json_vocabulary(text):
    encoder, widths = tokens.load(tokens.vocabulary())
    ids = tokens.encode(encoder, text)
    assert ids.tolist() == unmodified().encode(text, add_special_tokens=False).ids
    assert widths[ids].sum() == len(text.encode())


@pytest.mark.parametrize(("rule", "want"), [("first", [0, 0, 2]), ("most", [0, 1, 2])])
def test_boundary_tokens_follow_the_rule(rule, want):
    own, crossing = token_counts.attribute(np.array([0, 3, 9]), np.array([3, 9, 12]), np.array([0, 4, 9]), rule)
    assert own.tolist() == want and crossing.tolist() == [False, True, False]


@settings(max_examples=120, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 40), st.integers(1, 3), st.booleans())
def test_merged_lists_find_the_pairs_with_enough_collisions(seed, m, groups, small):
    draw = np.random.default_rng(seed)
    group = np.sort(draw.integers(0, groups if small else 1, m))
    sig, n, label = draw.integers(0, 2, (m, 8)) + 100, draw.integers(8, 12, m), draw.integers(0, 4, m)
    i, j = collisions(sig, group, n, label, 5, 75, small)
    pairs = [(a, b) for a in range(m) for b in range(a + 1, m) if group[a] == group[b] and label[a] != label[b]]
    want = [(a, b) for a, b in pairs if (sig[a] == sig[b]).sum() >= 5 and 100 * min(n[a], n[b]) >= 75 * max(n[a], n[b])]
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == want


@settings(max_examples=120, deadline=None)
@given(st.lists(st.sets(st.integers(0, 24), max_size=20), min_size=2, max_size=40), st.booleans(), st.data())
def test_links_are_those_of_the_full_sets(sets, small, data):
    group = np.sort([data.draw(st.integers(0, 2 if small else 0)) for _ in sets])
    label = np.array([data.draw(st.integers(0, 5)) for _ in sets])
    i, j = links([np.array(sorted(s), np.uint64) for s in sets], group, label, 75, small)
    pairs = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if group[a] == group[b] and label[a] != label[b]]
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == [(a, b) for a, b in pairs if sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(-9, 9), st.integers(-9, 9)), min_size=1, max_size=30))
def test_stars_lead_to_the_smallest_node(edges):
    node, root = stars(*np.array(edges).T)
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert dict(zip(node.tolist(), root.tolist(), strict=True)) == label


def test_features_are_finite_and_independent_of_neighbours():
    values = ["", "a", "a a a a a a a a", "Hi there.\nHi there.\n", "###", "\n\n", "é ß", "x " * 5000]
    together = features(*batch(values))
    assert together.shape == (len(values), len(FEATURES)) and np.isfinite(together).all()
    for text, row in zip(values, together, strict=True):
        alone = features(*(batch([text]) if text else (np.zeros(0, np.uint8), np.array([0, 0]))))
        assert np.allclose(alone[0], row)


def test_gram_counts_do_not_cross_texts():
    joined = np.concatenate(list(langid.gram_counts(pa.array([b"ab", b"", b"cd", b"12"], pa.binary()))))
    assert joined.sum(1).tolist() == [1, 0, 1, 0]
    assert (joined[2] == np.concatenate(list(langid.gram_counts(pa.array([b"CD"], pa.binary()))))[0]).all()


def test_estimate_learns_which_texts_are_bad():
    good, bad = (1, 1, 1), (0, 0, 1)
    prior, tables = quality_rules.estimate([(good, 900), (bad, 80), ((1, 1, 0), 20)])
    assert quality_rules.posterior(good, prior, tables) > 0.9 > 0.1 > quality_rules.posterior(bad, prior, tables)
    assert quality_rules.estimate([]) == (0.8, [])


def test_crc_is_zlib():
    assert zlib.crc32(b"12") % 4 in range(4)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2)), max_size=40), st.lists(st.integers(0, 7), max_size=12))
def test_runs_never_cut_a_key(keys, sizes):
    from claimlake.llm.common import runs

    keys = sorted(keys)
    table = pa.table({"a": pa.array([k[0] for k in keys], pa.int64()), "b": pa.array([k[1] for k in keys], pa.int64())})
    batches, at = [], 0
    for size in [*sizes, len(keys)]:
        batches += table.slice(at, size).combine_chunks().to_batches() or [pa.record_batch({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})]
        at += size
    parts = [list(zip(p["a"].to_pylist(), p["b"].to_pylist(), strict=True)) for p in runs(iter(batches), ["a", "b"])]
    assert [k for p in parts for k in p] == keys
    assert all(x[-1] != y[0] for x, y in zip(parts, parts[1:], strict=False))
