"""Spelling variants: words one edit apart, by merging the light subtrees of an errata trie.

1. Words of all whole texts are counted, combined where they lie.
2. The trie of the words is a table of its edges, each with the number of words below it. Of the children of a
   node the one with most words continues the heavy path; the others, and a word that ends at a node with children,
   are light. A word lies in at most log2(words) light subtrees, wherever it goes, so only so many of its positions are
   erred.
3. Each light subtree is merged into its node with one character in error, all subtrees at once: a light word with its
   character replaced by the heavy one, or skipped, or with the heavy character skipped ahead of it, is a terminal of
   the merged trie, and where it coincides with a terminal that was there the two words are near: an equi-join on whole
   strings, spread by their hash. Light siblings are merged with each other under a wildcard; there the members of a
   terminal are at most as many as the alphabet has letters, and each gets the count and the best of the others.
   Two near words part at one node of the trie, so each pair is found there, once.
4. Each word's form is its most frequent near word, if ten times as frequent; roots follow forms by pointer doubling. A
   step multiplies the frequency by ten, so no chain has more than 19 and five rounds are enough.

Nodes are named by the hash of their prefix, so a word of a million letters costs a million small rows and not their
strings. Nodes that many words pass through are counted before they are shuffled; their subtrees meet the words by
broadcast, and no more than MOST_HOT of them can be so large. Joins, counts and groups are DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlake.llm.common import table
from claimlake.llm.textkit import CHUNK, prefix_hashes

#: Runs of letters; only runs that can give a word of MIN_LENGTH are looked at.
LETTERS = "A-Za-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT = 7, 2
#: One run in so many loses a character; a form is so many times as frequent.
TYPO, RATIO = 31, 10
#: Nodes with more words below than this are broadcast; the bound rises with the words so that no more than MOST_HOT can have so many.
HOT, MOST_HOT = 1000, 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _cut(word: Column | str, at: Column, length: Column | int = 1) -> Column:
    """``word`` without ``length`` characters from ``at`` (from 0)."""
    word = F.col(word) if isinstance(word, str) else word
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 1 + length, F.length(word)))


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> word, n: the words of all texts, after the planted typos, that occur often enough."""
    runs = F.regexp_extract_all(F.col("t"), F.lit(f"[{LETTERS}]{{{MIN_LENGTH},}}"), F.lit(0))
    df = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("t")).select("id", F.explode(runs).alias("run"))
    df = df.select("id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", _UPPER, _LOWER)).otherwise(F.col("run")).alias("run"))
    df = df.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    word = F.when(F.col("h") % TYPO == 0, _cut("run", (F.col("h") % F.length("run")).cast("int"))).otherwise(F.col("run"))
    return df.select(word.alias("word")).where(F.length("word") >= MIN_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words to the edges of their path in the trie: the node above (depth of the edge, hash of what was read so far) and
    the character, for the word's end the empty one. Nodes that share a hash share their heavy character, which any may be."""
    for batch in batches:
        texts = batch["word"].to_pylist()
        sizes = np.array([len(w) for w in texts])
        at = 0
        while at < len(texts):
            to = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at:]), CHUNK, "right")))
            part, n = texts[at:to], sizes[at:to] + 1
            starts = np.cumsum(n) - n
            codes = np.frombuffer("\0".join([*part, ""]).encode("utf-32-le"), np.uint32)
            place = np.arange(len(codes)) - np.repeat(starts, n)
            above = prefix_hashes(codes.astype(np.uint64), starts, n)
            char = pa.array(np.frombuffer("\0".join([*part, ""]).replace("\0", " ").encode("utf-32-le"), "U1"))
            ends = np.zeros(len(codes), bool)
            ends[starts + n - 1] = True
            char = pc.if_else(pa.array(ends), "", char)
            ids = [pa.array(np.repeat(batch[c].to_numpy()[at:to], n)) for c in ("w1", "w2")]
            yield pa.RecordBatch.from_arrays([*ids, pa.array((place + 1).astype(np.int32)), pa.array(above.view(np.int64)), char], names=["w1", "w2", "depth", "above", "char"])
            at = to


def _edges(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.select("word", "w1", "w2").mapInArrow(_nodes, "w1 long, w2 long, depth int, above long, char string")


def light_positions(vocabulary: DataFrame) -> DataFrame:
    """(word, w1, w2, n) -> word, n, depth, char, heavy for every light subtree that a word lies in, and with an empty
    ``char`` for every word that ends where others go on; ``heavy`` continues the heavy path there."""
    nodes = table(_edges(vocabulary).groupBy("depth", "above", "char").agg(F.count("*").alias("below")), "nodes")
    heavy = nodes.groupBy("depth", "above").agg(F.max(F.when(F.col("char") != "", F.struct("below", "char")))["char"].alias("heavy"), F.count("*").alias("children"))
    light = table(nodes.join(heavy.where("children > 1"), ["depth", "above"]).where("char <> heavy").select("depth", "above", "char", "heavy", "below"), "light")
    bound = max(HOT, (nodes.agg(F.sum("below")).first()[0] or 0) // MOST_HOT)
    edge = ["depth", "above", "char"]
    hot = nodes.where(F.col("below") > bound).select(*edge)  # under MOST_HOT rows
    paths = _edges(vocabulary)
    large = paths.join(F.broadcast(light.where(F.col("below") > bound).drop("below")), edge)
    small = paths.join(F.broadcast(hot), edge, "left_anti").join(light.where(F.col("below") <= bound).drop("below"), edge)
    both = large.select("w1", "w2", "depth", "char", "heavy").union(small.select("w1", "w2", "depth", "char", "heavy"))
    return both.join(vocabulary, ["w1", "w2"]).select("word", "n", "depth", "char", "heavy")


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, w1, w2, n) of distinct words -> word, n_near, near_n and near: of the most frequent near word, of equally
    frequent ones the first. Words without a near one have no row. ``vocabulary`` is read more than once; give a table."""
    erred = table(light_positions(vocabulary), "erred")
    own, following = F.col("char"), F.substring("word", F.col("depth") + 1, F.lit(1))
    head, rest, tail = F.substring("word", F.lit(1), F.col("depth") - 1), F.substring("word", F.col("depth"), F.length("word")), F.substring("word", F.col("depth") + 1, F.length("word"))
    terminals = F.array(
        F.when(own != "", F.concat(head, "heavy", tail)),
        F.concat(head, "heavy", rest),
        F.when(own != following, F.concat(head, tail)),  # else the two part further on
    )
    tried = erred.select("word", "n", F.explode(terminals).alias("other")).where("other is not null")
    pairs = table(tried.join(vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other").select("word", "n", "other", "other_n"), "pairs")
    best = lambda n, word: F.struct((-n).alias("less"), word.alias("word"))
    both = pairs.select("word", F.lit(1).alias("near"), best(F.col("other_n"), F.col("other")).alias("best"))
    both = both.union(pairs.select("other", F.lit(1), best(F.col("n"), F.col("word"))))
    siblings = erred.where("char <> ''").groupBy(head.alias("head"), tail.alias("tail")).agg(F.sort_array(F.collect_list(best(F.col("n"), F.col("word")))).alias("g")).where(F.size("g") > 1)
    others = F.transform("g", lambda m, i: F.struct(m["word"].alias("word"), F.when(i == 0, F.col("g")[1]).otherwise(F.col("g")[0]).alias("best")))
    siblings = siblings.select(F.size("g").alias("size"), F.explode(others).alias("m"))
    both = both.union(siblings.select("m.word", F.col("size") - 1, "m.best"))
    found = both.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    return found.select("word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.word").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) without cycles -> word, root: the last form that is reached."""
    now = table(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        moved = now.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved"))
        now = table(moved, "forms")
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> one row per word: word, form, root, n, n_near, form_n.

    Null and empty texts have no words, texts of any length are taken whole, a null id counts as the empty text in the
    typos' hash, and each of repeated rows counts. Of near words equally frequent the first in code-point order is the
    form. A table without words gives no rows; other columns are not looked at.
    """
    # Two hashes stand for a word where it would be repeated for each of its characters.
    vocabulary = table(words(docs, id_col, text_col).select("word", F.xxhash64("word").alias("w1"), F.xxhash64(F.lit(1), "word").alias("w2"), "n"), "vocabulary")
    found = table(vocabulary.join(near_words(vocabulary), "word", "left"), "near")
    formed = F.col("near_n") >= RATIO * F.col("n")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("near")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n"))
    out = found.join(roots(found.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
