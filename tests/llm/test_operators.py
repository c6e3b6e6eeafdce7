"""Each operator on hard little tables: nulls in any column, empty and very long texts, ties and repeated rows, empty
tables, extra columns with clashing names; and against brute force on the small data."""

import re
import zlib
from collections import Counter

import corpus_pipeline
import pytest
from claimlake.llm import langid, mixing, packing, quality_classifier, quality_rules, sharding, token_counts, token_output
from claimlake.llm.common import documents
from claimlake.llm.components import components
from claimlake.llm.exact_dedup import exact_duplicates
from claimlake.llm.near_dedup import near_duplicates
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, id int, b string, n int, rep long, size string, sha string, token int, row string, rate int, copies int, "
    "shard int, slot int, bucket int, place int, x int, y int, s string, w string, kept boolean, owner long, component long, rejected boolean, p int, h int, salt int, rank int, length int"
)
EXTRA = (7, "b", None, 3, "size", None, 1, "row", 2, 3, 4, 5, 6, 7, 8, 9, "s", "w", True, 1, 2, False, 3, 4, 5, 6, 7)
LONG = "lorem ipsum dolor " * 30_000
WORDY = " ".join(f"w{i}" for i in range(60))


def rows():
    texts = [None, "", " \n\t", "###", "one two three", "one two three", "ONE two three", WORDY, WORDY + " end", WORDY + " end", LONG, LONG + "x", "été où ça naïve", "1234 5678"]
    texts += ["a b" + " " * 1_200_000 + "x", "\n" * 1_200_000, "a" * 1_200_000, "hello <|endoftext|> world"]
    out = [(i, t, "en" if i % 2 else "fr", "a" if i % 3 else None, 0, *EXTRA) for i, t in enumerate(texts)]
    out += [(5, "one two three", None, "b", None, *EXTRA), (None, "one two three", "en", "a", 1, *EXTRA), (None, None, None, None, None, *EXTRA)]
    return out


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, n=40):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(n)] + [(None, 1, 0), (3, None, None), (3, 1, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "langid": langid.identify,
    "rules": quality_rules.quality,
    "tokens": token_counts.token_counts,
    "classifier": lambda df: quality_classifier.classify(df, labels(df.sparkSession)),
    "near": near_duplicates,
    "exact": exact_duplicates,
    "shards": sharding.document_shards,
    "output": token_output.packed_ids,
    "mixture": mixing.mixture,
    "mixed": mixing.mixed,
    "packed": packing.packed,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_give_no_rows(name, empty):
    assert OPERATORS[name](empty).collect() == []


@pytest.mark.parametrize("name", ["langid", "rules", "classifier", "near", "exact", "shards", "mixture"])
def test_one_row_for_each_row(name, hard):
    got = OPERATORS[name](hard).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows())


def test_langid_defines_und(hard):
    got = {r["doc_id"]: r for r in langid.identify(hard).collect()}
    for i in (0, 1, 2, 3, 13):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True)
    assert got[7]["lang_pred"] in ("en", "fr") and 0 <= got[7]["score"] <= 1


def test_langid_without_labels(hard):
    from pyspark.sql import functions as F

    assert {r["lang_pred"] for r in langid.identify(hard.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_langid_held_out_accuracy(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = [r for r in langid.identify(docs).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in got) >= 0.98 * len(got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)


def test_langid_learns_every_language(spark):
    texts = [(f"l{i}", " ".join("".join(chr(97 + (i * 7 + k * j) % 26) for k in range(5)) for j in range(1, 30)) + f" {n}") for i in range(300) for n in range(3)]
    model = langid.fit(spark.createDataFrame(texts, "lang string, text string"))
    assert model.languages == sorted({x for x, _ in texts})


def test_langid_rejects_what_is_far_and_keeps_short_clean_texts(spark):
    import pyarrow as pa

    docs = documents(spark, "/root/testdata/sf0.1")
    model = langid.fit(docs)
    import base64
    import random

    draw = random.Random(1)
    far = [
        "".join(draw.choice("abcdefghijklmnopqrstuvwxyz  ") for _ in range(400)),
        base64.b64encode(bytes(draw.randrange(256) for _ in range(500))).decode(),
        " ".join(f"{draw.getrandbits(32):08x}" for _ in range(60)),
        "SELECT a.id, count(*) FROM t1 a JOIN t2 b ON a.id = b.id WHERE x > 3 GROUP BY a.id; " * 3,
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах.",
        "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
    ]
    assert model.predict(pa.array([x.encode() for x in far]))[2].all()
    good = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("quality = 1").select("doc_id")
    clean = [r["text"] for r in docs.join(good, "doc_id").collect()]
    for size in (40, 100, 400, 10**9):
        assert model.predict(pa.array([x[:size].encode() for x in clean], pa.binary()))[2].mean() < 0.005


def test_langid_against_plain_vectors(spark, sf):
    """TF-IDF, cosine and the nearest centroid in plain Python, over whole texts."""
    import math

    import numpy as np
    import pyarrow as pa

    docs = documents(spark, sf)
    model = langid.fit(docs)
    texts = [r["text"] or "" for r in docs.orderBy("doc_id").limit(60).collect()]

    def grams(text):
        data = "".join(chr(b) if b >= 128 or chr(b).isalpha() else " " for b in text.encode()).encode("latin-1")
        data = bytes(b + 32 if 65 <= b <= 90 else b for b in data)
        data = bytes(b + 32 if i and data[i - 1] == 0xC3 and 0x80 <= b <= 0x9E else b for i, b in enumerate(data))
        out = Counter()
        for width in (2, 3):
            for i in range(len(data) - width + 1):
                gram = data[i : i + width]
                if gram.strip(b" "):
                    out[((int.from_bytes(gram, "big") * 2654435761 + (width * 0x85EBCA6B & 0xFFFFFFFF)) & 0xFFFFFFFF) >> 20] += 1
        return out

    every = [grams(r["text"] or "") for r in docs.where("lang is not null and text is not null").collect()]
    seen = Counter(g for one in every for g in one)
    idf = {g: math.log((1 + len(every)) / (1 + n)) + 1 for g, n in seen.items()}
    assert all(abs(model.idf[g] - x) < 1e-5 for g, x in idf.items())
    number, score, _ = model.predict(pa.array([t.encode() for t in texts], pa.binary()))
    for text, k, s in zip(texts, number, score, strict=True):
        v = np.zeros(langid.DIMENSIONS)
        for g, n in grams(text).items():
            v[g] = n * model.idf[g]
        cosines = model.centroids @ v / max(np.linalg.norm(v), 1e-12)
        assert abs(cosines.max() - s) < 1e-4 and cosines[model.language_of == k].max() > cosines.max() - 1e-4


def base(text):
    w = WORD.findall(text or "")
    windows = {}
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_rules_base_statistics_against_brute_force(spark, sf, hard):
    for docs in (documents(spark, sf), hard):
        text = {(r["doc_id"], r["text"]) for r in docs.collect()}
        by_id = {i: t for i, t in text if i is not None}
        for r in quality_rules.quality(docs).collect():
            if r["doc_id"] is not None:
                want = base(by_id[r["doc_id"]])
                assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
                assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r["base_failed"] and r["kept"])


def test_rules_posterior_against_estimation_text_by_text(spark, sf):
    """Expectation-maximisation over single texts in numpy, not over vote patterns."""
    import numpy as np

    got = quality_rules.quality(documents(spark, sf)).collect()
    names = [f"v_{r}" for r in quality_rules.RULES]
    some = [r for r in got if r["n_words"] > 0]
    votes = np.array([[r[n] for n in names] for r in some]) % 3  # 0 bad, 1 good, 2 none
    prior, g, b = 0.8, np.tile([0.005, 0.895, 0.1], (len(names), 1)), np.tile([0.3, 0.6, 0.1], (len(names), 1))

    def posterior():
        rule = np.arange(len(names))
        good, bad = prior * g[rule, votes].prod(1), (1 - prior) * b[rule, votes].prod(1)
        return good / (good + bad)

    for _ in range(500):
        p = posterior()
        on_good, on_bad = np.tile([0.005, 0.895, 0.1], (len(names), 1)), np.tile([0.3, 0.6, 0.1], (len(names), 1))
        for v in range(3):
            on_good[:, v] += (p[:, None] * (votes == v)).sum(0)
            on_bad[:, v] += ((1 - p)[:, None] * (votes == v)).sum(0)
        g, b = on_good / on_good.sum(1, keepdims=True), on_bad / on_bad.sum(1, keepdims=True)
        for k in np.flatnonzero(g[:, 0] > b[:, 0]):
            rest = b[k, 1:] * (1 - g[k, 0]) / max(1e-9, b[k, 1:].sum())
            b[k] = [g[k, 0], *rest]
        prior = min(0.99, max(0.05, p.mean()))
    for r, p in zip(some, posterior(), strict=True):
        assert abs(r["posterior"] - p) < 1e-3
        assert r["kept"] == (not r["base_failed"] and r["posterior"] >= quality_rules.KEEP_AT)


def test_classifier_score_against_dense_algebra(spark, sf):
    """Covariances of whole matrices, log-densities by solving and determinants, text by text."""
    import numpy as np
    import pyarrow as pa

    docs, marks = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    rows = docs.select("doc_id", "text").collect()
    x = np.array(quality_classifier._features(pa.array([(r["text"] or "").encode() for r in rows], pa.binary())).to_pylist())
    at = {r["doc_id"]: i for i, r in enumerate(rows)}
    known = [(at[r["doc_id"]], r["quality"]) for r in marks.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    train, y = x[[i for i, _ in known]], np.array([q for _, q in known])
    centre, scale = train.mean(0), np.sqrt(np.maximum(train.var(0), 1e-8))
    z, every = (train - centre) / scale, (x - centre) / scale
    own = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    pooled = sum((y == k).sum() * c for k, c in enumerate(own)) / len(y)
    to_diagonal, to_pooled = quality_classifier.TOWARDS_DIAGONAL, quality_classifier.TOWARDS_POOLED
    pooled = (1 - to_diagonal) * pooled + to_diagonal * np.diag(np.diag(pooled))
    density = []
    for k, c in enumerate(own):
        c = (1 - to_pooled) * c + to_pooled * pooled + quality_classifier.RIDGE * np.eye(len(c))
        off = every - z[y == k].mean(0)
        density.append(-0.5 * np.einsum("ij,ji->i", off, np.linalg.solve(c, off.T)) - 0.5 * np.linalg.slogdet(c)[1] + np.log((y == k).sum()))
    want = 1 / (1 + np.exp(-np.clip(density[1] - density[0], -500, 500)))
    for r in quality_classifier.classify(docs, marks).collect():
        assert abs(r["score"] - want[at[r["doc_id"]]]) < 1e-4 and r["predicted"] == int(r["score"] >= 0.7)


def test_rules_and_classifier_tell_junk(spark):
    path = "/root/testdata/sf0.1"
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    kept = {r["doc_id"]: r for r in quality_rules.quality(documents(spark, path)).collect()}
    scored = {r["doc_id"]: r for r in quality_classifier.classify(documents(spark, path), spark.read.parquet(f"{path}/labels.parquet")).collect()}
    good, bad = ([i for i, q in marks.items() if q == y] for y in (1, 0))
    assert sum(kept[i]["kept"] for i in bad) < 0.1 * len(bad)
    assert sum(not kept[i]["kept"] and not kept[i]["base_failed"] for i in good) < 0.02 * len(good)
    unseen = [i for i in marks if scored[i]["held_out"]]
    assert sum(scored[i]["predicted"] == marks[i] for i in unseen) > 0.97 * len(unseen)


def test_classifier_with_one_class_or_none(spark, hard):
    one = spark.createDataFrame([(i, 1) for i in range(8)], "doc_id long, quality int")
    assert all(r["score"] > 0.99 for r in quality_classifier.classify(hard, one).collect())
    assert {r["score"] for r in quality_classifier.classify(hard, one.limit(0)).collect()} == {0.5}


def test_token_counts_add_up(spark, sf, hard):
    from claimlake.llm.tokens import encode, load, vocabulary

    encoder, _ = load(vocabulary())
    want = {r["doc_id"]: len(encode(encoder, r["text"] or "")) for r in documents(spark, sf).collect()}
    for rule in token_counts.RULES:
        got = Counter()
        for r in token_counts.token_counts(documents(spark, sf), rule=rule).collect():
            got[r["doc_id"]] += r["n_tokens"]
        assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
    by_field = token_counts.token_counts(hard, fields=("text", "lang"), by="fields").collect()
    assert Counter(r["doc_id"] for r in by_field) == Counter({i: 2 * n for i, n in Counter(r[0] for r in rows()).items()})


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_attribution_token_by_token(spark, sf, rule):
    """Ids of the unmodified tokenizer, each token's bytes laid end to end, lines found by looking at every character."""
    import public_tokenizers
    from claimlake.llm.tokens import load, vocabulary
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    _, widths = load(vocabulary())
    extra = [(10**6, "a\n\n\nb\n\n  c\n"), (10**6 + 1, "é\n\n日本\n\n\n"), (10**6 + 2, None), (10**6 + 3, "\n")]
    docs = documents(spark, sf).select("doc_id", "text").limit(60).union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {(r["doc_id"], r["section"]): (r["char_start"], r["char_end"], r["n_tokens"], r["n_crossing"]) for r in token_counts.token_counts(docs, rule=rule).collect()}
    want = {}
    for r in docs.collect():
        text = r["text"] or ""
        raw, line_of, starts = text.encode(), [], [0]
        for i, c in enumerate(text):
            line_of.append(len(starts) - 1)
            if c == "\n":
                starts.append(i + 1)
        line_of.append(len(starts) - 1)
        counts, at = [[0, 0] for _ in starts], 0
        for token in tokenizer.encode(text, add_special_tokens=False).ids:
            a, b = (len(raw[:k].decode("utf-8", "ignore")) + (len(raw[:k]) > len(raw[:k].decode("utf-8", "ignore").encode())) for k in (at, at + int(widths[token])))
            at += int(widths[token])
            held = Counter(line_of[i] for i in range(a, b)) or Counter([line_of[a]])
            own = min(held) if rule == "first" else min(held, key=lambda k: (-held[k], k))
            counts[own][0] += 1
            counts[own][1] += len(held) > 1
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(text)], strict=True)):
            want[r["doc_id"], k] = (a, b, *counts[k])
    assert got == want


def test_operators_read_added_tokens_like_the_unmodified_json_vocabulary(spark):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = dict(enumerate(["hello <|endoftext|> world", "<|endoftext|>", "one\n<|endoftext|>two\n", "no such token"]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    ids = {k: tokenizer.encode(t, add_special_tokens=False).ids for k, t in texts.items()}
    counted = Counter()
    for r in token_counts.token_counts(docs).collect():
        counted[r["doc_id"]] += r["n_tokens"]
    assert counted == {k: len(v) for k, v in ids.items()}
    got = {}
    for r in token_output.packed_ids(docs).collect():
        row = np.frombuffer(bytes(r["input_ids"]), "<u2").tolist()
        got |= {doc: row[a:b] for doc, a, b in zip(r["doc_ids"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False)}
    assert got == {k: [*v, token_output.END] for k, v in ids.items()}
    crcs = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in packing.packed(docs).collect()}
    assert crcs == {k: (len(v) + 1, zlib.crc32(np.array([*v, packing.END], "<u4").tobytes())) for k, v in ids.items()}


def links(texts):
    """doc -> component over (id, text), by all pairs."""
    sets = {}
    for i, t in texts:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and label[a] != label[b]:
                x, y = sorted((label[a], label[b]))
                label = {i: x if v == y else v for i, v in label.items()}
    return label, sets


def near_against_all_pairs(df, **options):
    want, sets = links([(r["doc_id"], r["text"]) for r in df.collect()])
    got = near_duplicates(df, **options).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) and r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_against_all_pairs(spark, sf):
    near_against_all_pairs(documents(spark, sf))


def test_near_duplicates_in_blocks(spark):
    """Chains and a hub, in lists and groups that are cut into many blocks."""
    import random

    draw = random.Random(5)
    words = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(120):
        copy = list(words)
        for _ in range(draw.randrange(0, 5)):
            copy[draw.randrange(len(copy))] = f"z{draw.randrange(10**6)}"
        texts.append((i, " ".join(copy)))
    texts += [(200 + i, " ".join(words[3 * i :] + [f"t{k}" for k in range(3 * i)])) for i in range(30)]  # a chain
    df = spark.createDataFrame(texts, "doc_id long, text string")
    near_against_all_pairs(df)
    near_against_all_pairs(df, list_block=16, group_members=12, group_block=2000)
    near_against_all_pairs(df, list_block=5, group_members=100, group_block=900)


def test_a_family_of_50000_different_near_copies_meets_in_bounded_blocks(spark, monkeypatch):
    """One word in sixty differs, so copies with far changes are no links and the family holds together by chains."""
    import random

    from claimlake.llm import near_dedup

    draw, words, most, dealt = random.Random(3), [f"w{i}" for i in range(60)], [], near_dedup._dealt

    def watched(df, keys, fn):
        most.append(df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0)
        return dealt(df, keys, fn)

    texts = []
    for i in range(50_000):
        at = draw.randrange(60)
        texts.append((i, " ".join([*words[:at], f"z{i}", *words[at + 1 :]])))
    monkeypatch.setattr(near_dedup, "_dealt", watched)
    got = near_duplicates(spark.createDataFrame(texts, "doc_id long, text string").repartition(8)).select("component_id").distinct().collect()
    assert [r[0] for r in got] == [0] and max(most) < 3 * near_dedup.GROUP_MEMBERS


def test_near_duplicates_of_hard_rows(hard):
    got = {}
    for r in near_duplicates(hard).collect():
        got.setdefault(r["doc_id"], set()).add((r["n_shingles"], r["component_id"], r["kept"]))
    assert got[4] == {(1, 4, True)} and got[5] == {(1, 4, False)} and got[6] == {(1, 4, False)}
    assert got[0] == {(0, 0, True)} and got[2] == {(0, 2, True)}
    assert {c for _, c, _ in got[8] | got[9]} == {7}
    assert {(c, k) for _, c, k in got[None]} == {(None, True)}


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    for local in (1_000_000, 7, 0):
        got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long"), local_edges=local).collect()}
        assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100)}
        assert components(spark.createDataFrame([], "u long, v long"), local_edges=local).collect() == []


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("budget", [1, 1 << 25])
def test_exact_duplicates(spark, sf, hard, keep, budget):
    for docs in (documents(spark, sf), hard):
        groups = {}
        for r in docs.collect():
            groups.setdefault(r["text"] or "", []).append(r["doc_id"])
        text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
        for r in exact_duplicates(docs, keep=keep, budget=budget).collect():
            if r["doc_id"] is None:
                continue
            ids = groups[text[r["doc_id"]]]
            assert r["group_size"] == len(ids) and r["keep_id"] == (min if keep == "smallest" else max)(i for i in ids if i is not None)
            assert r["kept"] == (r["doc_id"] == r["keep_id"])


def test_exact_duplicates_of_large_groups_by_broadcast(spark, hard, monkeypatch):
    from claimlake.llm import exact_dedup

    want = sorted(map(str, exact_duplicates(hard).collect()))
    monkeypatch.setattr(exact_dedup, "LARGE", 1)
    assert sorted(map(str, exact_duplicates(hard).collect())) == want


def test_shards_are_even_gapless_and_grow_with_the_data(spark, sf, hard):
    for docs, bucket in ((documents(spark, sf), 10_000), (hard, 1 << 20)):
        got = sharding.document_shards(docs, 7, bucket_bytes=bucket).collect()
        slots = {}
        for r in got:
            slots.setdefault(r["shard"], []).append(r["slot"])
        sizes = [len(slots.get(k, [])) for k in range(7)]
        assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
        assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
        text = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert all(r["size"] == len((text[r["doc_id"]] or "").encode()) + 16 and r["text_crc32"] == zlib.crc32((text[r["doc_id"]] or "").encode()) for r in got if r["doc_id"] is not None)


def test_written_shards_hold_whole_records(spark, hard, tmp_path):
    sharding.write_shards(hard, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows()) and {"text", "shard_", "slot_", "size"} <= set(back.columns)


def test_shards_of_the_query_come_from_whole_records_and_are_the_written_ones(spark, sf, tmp_path, monkeypatch):
    docs = documents(spark, sf)
    sharding.write_shards(docs, str(tmp_path / "out"), 7, bucket_bytes=10_000)
    written = {(r["doc_id"], r["shard"], r["slot"]) for r in spark.read.parquet(str(tmp_path / "out")).select("doc_id", "shard", "slot").collect()}
    got = sharding.document_shards(docs, 7, bucket_bytes=10_000).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in got} == written and len(got) == len(written)
    whole = sharding.sharded

    def marked(records, *args, **options):
        assert set(docs.columns) <= set(records.columns)
        return whole(records, *args, **options).withColumn("text", F.lit("carried"))

    monkeypatch.setattr(sharding, "sharded", marked)
    assert {(r["size"], r["text_crc32"]) for r in sharding.document_shards(docs, 7).collect()} == {(7 + 16, zlib.crc32(b"carried"))}


def test_token_output_round_trip(spark, sf, hard):
    import numpy as np
    from claimlake.llm.tokens import encode, load, vocabulary

    encoder, _ = load(vocabulary())
    for docs, wide in ((documents(spark, sf), False), (hard, True)):
        pieces = Counter()
        for r in token_output.packed_ids(docs, capacity=256, block_tokens=5000, wide=wide).collect():
            ids = np.frombuffer(bytes(r["input_ids"]), "<u4" if wide else "<u2")
            positions = np.frombuffer(bytes(r["position_ids"]), "<u4" if wide else "<u2")
            cuts = r["cu_seqlens"]
            assert len(ids) == r["n_tokens"] == cuts[-1] <= 256
            for doc, start, a, b in zip(r["doc_ids"], r["starts"], cuts, cuts[1:], strict=False):
                pieces[(doc, start, tuple(ids[a:b].tolist()))] += 1
                assert positions[a:b].tolist() == list(range(b - a))
        want = Counter()
        for r in docs.collect():
            ids = [*encode(encoder, r["text"] or "").tolist(), token_output.END]
            want.update((r["doc_id"], s, tuple(ids[s : s + 256])) for s in range(0, len(ids), 256))
        assert pieces == want


def test_token_output_does_not_depend_on_partitions(spark, sf):
    docs = documents(spark, sf)
    want = None
    for n in (1, 3, 11):
        got = Counter(map(str, token_output.packed_ids(docs.repartition(n), block_tokens=20_000).collect()))
        assert want in (None, got)
        want = got


def test_token_output_matrix(spark, hard, tmp_path):
    token_output.write(token_output.packed_ids(hard), str(tmp_path / "m"))
    assert {len(r[0]) for r in spark.read.parquet(str(tmp_path / "m")).select("input_ids").collect()} == {2 * token_output.CAPACITY}


def test_mixture_targets_and_copies(spark, sf, hard):
    for docs in (documents(spark, sf), hard):
        got = mixing.mixture(docs).collect()
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mixture(docs).collect()), key=str)
        assert all(r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"] for r in got)
        emitted = Counter(r["doc_id"] for r in mixing.mixed(docs).collect())
        want = Counter()
        for r in got:
            want[r["doc_id"]] += r["copies"]
        assert emitted == Counter({k: v for k, v in want.items() if v})
    assert mixing.mixed(hard).columns == hard.columns


def test_targets_fill_by_weight(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 100), (None, 0)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert got["a"] == 20 and got[None] == 0 and abs(got["c"] / got["b"] - 2) < 1e-9 or got["c"] == 200
    assert abs(sum(got.values()) - 315) < 1e-9


def test_packing_round_trip(spark, sf, hard):
    import numpy as np
    from claimlake.llm.tokens import encode, load, vocabulary

    encoder, _ = load(vocabulary())
    for docs in (documents(spark, sf), hard):
        got = packing.packed(docs, capacity=128).collect()
        ids = {r["doc_id"]: np.append(encode(encoder, r["text"] or ""), np.uint32(2)) for r in docs.collect() if r["doc_id"] is not None}
        rows_of = {}
        for r in got:
            rows_of.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            if r["doc_id"] is not None:
                part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
                assert zlib.crc32(part.astype("<u4").tobytes()) == r["ids_crc32"] and (r["length"] == 128 or r["piece"] == 0)
        for row in rows_of.values():
            at = 0
            for offset, length in sorted(row):
                assert offset == at
                at += length
            assert at <= 128
        assert len(rows_of) <= 1.02 * sum(r["length"] for r in got) / 128 + 1


def test_packed_sequences_hold_their_ids(spark, sf, hard):
    import numpy as np
    import public_tokenizers
    from claimlake.llm import queries
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for pack in (lambda docs: packing.packed(docs, capacity=128), lambda docs: corpus_pipeline.pack(spark, docs, sf)):
        got, want, sequences = Counter(), Counter(), {}
        for r in pack(hard).collect():
            ids = np.frombuffer(bytes(r["ids"]), "<u4")
            assert len(ids) == r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
            got[r["doc_id"]] += 1 if r["piece"] == 0 else 0
            sequences.setdefault(r["sequence_id"], []).append((r["offset"], ids.tolist()))
            want.update([(r["doc_id"], r["start"], tuple(ids.tolist()))])
        whole = Counter((r["doc_id"], (*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, packing.END)) for r in hard.collect())
        assert sum(len(ids) * n for (_, ids), n in whole.items()) == sum(len(i) for s in sequences.values() for _, i in s)
        pieces = Counter(doc for doc, _ in whole.elements())
        assert got == pieces
        texts = {doc: ids for doc, ids in whole if pieces[doc] == 1}
        assert all(texts[doc][start : start + len(ids)] == ids for doc, start, ids in want if doc in texts)
    assert queries.op10_best_fit_packing(spark, sf).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_pipeline_against_brute_force(spark, sf):
    """Deduplication stages against all pairs on what the stage before kept; packing against the mixture."""
    docs = documents(spark, sf)
    first = corpus_pipeline.language(spark, docs, sf).collect()
    assert len(first) >= 0.99 * docs.count()
    frame = spark.createDataFrame(first, docs.schema)
    owners = {}
    for r in first:
        owners[r["text"]] = min(owners.get(r["text"], r["doc_id"]), r["doc_id"])
    second = corpus_pipeline.exact(spark, frame, sf)
    assert second.columns == docs.columns and sorted(r["doc_id"] for r in second.collect()) == sorted(owners.values())
    want, _ = links([(r["doc_id"], r["text"]) for r in second.collect()])
    third = corpus_pipeline.near(spark, second, sf)
    assert sorted(r["doc_id"] for r in third.collect()) == sorted(set(want.values()))
    fourth = corpus_pipeline.mix(spark, third, sf)
    assert fourth.columns == docs.columns
    last = corpus_pipeline.pack(spark, fourth, sf).collect()
    assert Counter(r["doc_id"] for r in last if r["piece"] == 0) == Counter(r["doc_id"] for r in fourth.collect())


def test_exact_stage_judges_rows_not_ids(spark, sf):
    """One id with two texts, rows without an id, and full repeats."""
    rows = [(1, "a b"), (2, "a b"), (2, "c d"), (3, "c d"), (None, "e f"), (None, "e f"), (None, "c d"), (4, "g"), (4, "g"), (5, None), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, sha long").repartition(3)
    got = corpus_pipeline.exact(spark, docs, sf)
    assert got.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in got.collect()) == [("1", "a b"), ("2", "c d"), ("4", "g"), ("5", None), ("None", "e f")]


def test_pipeline_of_hard_and_no_rows(spark, hard, empty, sf):
    for docs in (hard, empty):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
        docs.collect()
