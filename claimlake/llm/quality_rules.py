"""Quality by weak supervision, in DataFrame expressions only.

Statistics of each whole text are array expressions within its row (no explode, no shuffle). Nine rules vote good or
bad or abstain on them. Votes are counted by pattern (at most 3 ** 9 rows, whatever the corpus), and
expectation-maximisation over the patterns estimates how often each rule is right on good and on bad texts and how
common good texts are, without labels. A text's verdict is its posterior probability of being good.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlake.llm.common import table

#: name: (statistic, good where it is at most / at least, bad where it is at least / at most). Between: abstain.
RULES: dict[str, tuple[str, float, float]] = {
    "length": ("n_words", 50, 20),
    "word_length": ("abs(log(word_chars / n_words) - log(5.5D))", 0.7, 1.2),
    "symbols": ("n_symbols / n_words", 0.02, 0.15),
    "marks": ("n_marks / word_chars", 0.1, 0.28),
    "capitals": ("n_upper / word_chars", 0.15, 0.45),
    "shouting": ("n_exclaim / n_words", 0.05, 0.3),
    "lines": ("n_dup_lines / n_lines", 0.1, 0.35),
    "repeats": ("n_repeat_words / n_words", 0.05, 0.3),
    "variety": ("n_distinct / least(n_words, 200)", 0.35, 0.15),
}
KEEP_AT = 0.5
WINDOW = 8
#: What most of a text is made of; statistics of other characters look at the rest only.
_PLAIN = "abcdefghijklmnopqrstuvwxyz \n"
_SPACES = " \t\n\x0b\x0c\r"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _without(text: str, characters: str) -> Column:
    return F.translate(F.col(text), characters, "")


def _count(text: str, characters: str) -> Column:
    """Of ASCII characters: each is one byte less."""
    return (F.octet_length(text) - F.octet_length(_without(text, characters))).cast("long")


def _hash_ahead(hashes: Column, distance: int) -> Column:
    """Each hash joined with the one ``distance`` further on; as many fewer at the end."""
    return F.zip_with(hashes, F.slice(hashes, F.lit(distance + 1), F.greatest(F.size(hashes) - distance, F.lit(0))), lambda a, b: F.xxhash64(a, b))


def statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and the base statistics of each row; null counts as the empty text."""
    df = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    df = df.withColumns({"w": F.array_remove(F.split("t", r"[\x20\x09-\x0D]+", -1), ""), "lines": F.split("t", "\n", -1), "odd": _without("t", _PLAIN)})
    df = df.select(
        "id",
        F.char_length(_without("t", _SPACES)).cast("long").alias("word_chars"),
        _count("odd", "#*$%&|<>").alias("n_symbols"),
        _count("odd", _CAPITALS).alias("n_upper"),
        _count("odd", "!").alias("n_exclaim"),
        _count("odd", _MARKS).alias("n_marks"),
        F.size("lines").cast("long").alias("n_lines"),
        F.filter("lines", lambda x: F.translate(x, _SPACES, "") != "").alias("full"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    df = df.withColumns({"n_words": F.size("h").cast("long"), "n_dup_lines": (F.size("full") - F.size(F.array_distinct("full"))).cast("long"), "n_distinct": F.size(F.array_distinct("h")).cast("long")}).drop("full")
    # Hashes of 2, 4 and then 8 words; zip_with leaves nulls hashed at the end, which the slice takes off.
    for distance in (1, 2, 4):
        df = df.withColumn("h", _hash_ahead(F.col("h"), distance))
    df = df.withColumn("win", F.slice("h", F.lit(1), F.greatest(F.size("h") - WINDOW + 1, F.lit(0)))).drop("h")
    # Few texts repeat a window; only theirs are sorted.
    pairs = F.when(F.size("win") > F.size(F.array_distinct("win")), F.sort_array(F.transform("win", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    df = df.withColumn("s", pairs).drop("win")
    s = F.col("s")
    twice = F.filter(s, lambda e, i: ((i > 0) & (F.get(s, i - 1)["x"] == e["x"])) | (F.coalesce(F.get(s, i + 1)["x"] == e["x"], F.lit(False))))
    df = df.withColumn("at", F.sort_array(F.transform(twice, lambda e: e["i"]))).drop("s")
    at = F.col("at")
    covered = F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("at")


def votes() -> dict[str, Column]:
    """1 good, 0 bad, -1 abstains; a text without words gets a vote on its length only."""
    out = {}
    for name, (statistic, good, bad) in RULES.items():
        x = F.expr(f"case when n_words > 0 then {statistic} end").cast("double") if name != "length" else F.col("n_words").cast("double")
        up = good > bad
        vote = F.when(x >= good if up else x <= good, 1).when(x <= bad if up else x >= bad, 0)
        out[f"v_{name}"] = F.coalesce(vote, F.lit(-1))
    return out


#: What a rule may do: vote bad, vote good, abstain; the index is the vote, so that -1 is the last.
Outcomes = tuple[float, float, float]


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 500) -> tuple[float, list[tuple[Outcomes, Outcomes]]]:
    """Expectation-maximisation over (votes, count): the share of good texts, and for each rule how often it votes
    bad, votes good and abstains on good texts and on bad ones. A rule's accuracy on a class is its share of right
    votes among its votes. Start and bounds hold each rule to vote bad more often on bad texts, which fixes which
    class is which."""
    m = len(patterns[0][0]) if patterns else 0
    prior, tables = 0.8, [((0.005, 0.895, 0.1), (0.3, 0.6, 0.1))] * m
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        good = 0.0
        seen = [([0.005, 0.895, 0.1], [0.3, 0.6, 0.1]) for _ in range(m)]  # one pseudo-text of each class
        for pattern, n in patterns:
            p = posterior(pattern, prior, tables)
            good += n * p
            for (on_good, on_bad), vote in zip(seen, pattern, strict=True):
                on_good[vote] += n * p
                on_bad[vote] += n * (1 - p)
        now = []
        for on_good, on_bad in seen:
            g, b = ([x / sum(c) for x in c] for c in (on_good, on_bad))
            if g[0] > b[0]:  # no better than the reverse: its bad votes say nothing
                g, b = (g, [g[0], b[1] * (1 - g[0]) / max(1e-9, b[1] + b[2]), b[2] * (1 - g[0]) / max(1e-9, b[1] + b[2])])
            now.append((tuple(g), tuple(b)))
        share = min(0.99, max(0.05, good / total))
        moved = abs(share - prior) + sum(abs(x - y) for a, b in zip(now, tables, strict=True) for c, d in zip(a, b, strict=True) for x, y in zip(c, d, strict=True))
        prior, tables = share, now
        if moved < 1e-9:
            break
    return prior, tables


def weights(prior: float, tables: list[tuple[Outcomes, Outcomes]]) -> tuple[float, list[Outcomes]]:
    """Log-odds of good over bad: of the prior, and of each outcome of each rule."""
    return math.log(prior / (1 - prior)), [tuple(math.log(max(g, 1e-9) / max(b, 1e-9)) for g, b in zip(on_good, on_bad, strict=True)) for on_good, on_bad in tables]


def posterior(pattern: tuple[int, ...], prior: float, tables: list[tuple[Outcomes, Outcomes]]) -> float:
    base, odds = weights(prior, tables)
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, base + sum(o[v] for v, o in zip(pattern, odds, strict=True))))))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, keep_at: float = KEEP_AT) -> DataFrame:
    """-> one row per row of ``docs``: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, posterior and the votes.

    Null and empty texts have no words and fail the base rules. An empty table gives no rows. Texts of any length
    are taken whole; equal texts get equal verdicts within a run. Rows repeated under one id are judged each for itself,
    and each counts in the estimate; a null id stays null; a posterior at ``keep_at`` keeps. Other columns are not looked at.
    """
    found = statistics(docs, id_col, text_col)
    rated = found.withColumns(votes())
    rated = table(rated.drop("n_lines", "n_upper", "n_exclaim", "n_marks", "n_distinct"), "votes")
    names = [f"v_{r}" for r in RULES]
    counted = rated.where("n_words > 0").groupBy(*names).count().collect()  # at most 3 ** len(RULES) rows
    base, odds = weights(*estimate(sorted((tuple(int(r[n]) for n in names), r["count"]) for r in counted)))
    logit = F.lit(base)
    for name, (bad, good, neither) in zip(names, odds, strict=bool(odds)):
        logit = logit + F.when(F.col(name) == 1, F.lit(good)).when(F.col(name) == 0, F.lit(bad)).otherwise(F.lit(neither))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = rated.withColumns({"posterior": 1 / (1 + F.exp(-logit)), "base_failed": failed})
    return out.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("posterior") >= keep_at)).alias("kept"), "posterior", *names
    )
