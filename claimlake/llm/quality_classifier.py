"""Quality by a regularised quadratic discriminant.

Each whole text becomes ``FEATURES`` transformed statistics. Per class, sums and sums of products over all labelled
training rows give mean and covariance; covariances shrink towards the pooled one and towards its diagonal. A score
is the logistic of the difference of the two log-densities, each from a Mahalanobis distance through a Cholesky
factor computed once, plus the log-odds of the classes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlake.llm.common import held_out, table, text_bytes
from claimlake.llm.textkit import LOWER, SPACE, chunks, word_hashes, words

FEATURES = ("log_words", "word_length", "log_line_length", "symbols", "digits", "capitals", "marks", "variety", "repeats", "same_lines", "same_next", "entropy")
#: Shrinkage of a class covariance towards the pooled one, and of that towards its diagonal.
TOWARDS_POOLED, TOWARDS_DIAGONAL = 0.3, 0.1
#: Added to every variance of the standardised statistics, so that a constant one divides by no zero.
RIDGE = 0.02

_SYMBOL, _DIGIT, _CAPITAL, _MARK = np.zeros((4, 256), bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_DIGIT[ord("0") : ord("9") + 1] = True
_CAPITAL[ord("A") : ord("Z") + 1] = True
_MARK[[ord(c) for c in "!?,.;:'\"()[]{}-_/\\=+@^~`"]] = True


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)


def _distinct(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Number of distinct keys of each document; first: where its keys begin."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    return np.bincount(d[new], minlength=len(first) - 1).astype(float)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each document of a batch; a document without words gets zeros in all ratios."""
    docs = len(offsets) - 1
    starts, ends, first = words(data, offsets)
    n = np.diff(first).astype(float)
    safe = np.maximum(n, 1)
    letters = np.maximum(_per_doc(~SPACE[data], offsets), 1)
    share = lambda table: _per_doc(table[data], offsets) / letters
    hashes = word_hashes(LOWER[data], starts, ends)
    doc = np.repeat(np.arange(docs), np.diff(first))
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    four = np.zeros(len(hashes), np.uint64)
    for k in range(min(4, len(hashes))):
        four[: len(hashes) - k] += hashes[k:] * np.uint64(2 * k + 3)
    windows = np.maximum(n - 3, 0)
    inside = np.arange(len(hashes)) < (first[1:][doc] - 3 if len(doc) else 0)
    window_first = np.concatenate([[0], np.cumsum(windows)]).astype(np.int64)
    different = _distinct(four[inside], window_first)
    lines = _per_doc(data == 0x0A, offsets) + 1
    line_starts = np.union1d(np.flatnonzero(data == 0x0A) + 1, offsets[:-1])
    line_starts = line_starts[line_starts < len(data)]
    if len(line_starts) and len(hashes):
        total = np.concatenate([[0], np.cumsum(hashes * np.uint64(3) + np.uint64(1), dtype=np.uint64)])
        a = np.searchsorted(starts, line_starts)
        b = np.append(a[1:], len(starts))
        keys, line_doc = total[b] - total[a], np.searchsorted(offsets, line_starts, "right") - 1
        full = b > a
        counts = np.bincount(line_doc[full], minlength=docs)
        unlike = _distinct(keys[full], np.concatenate([[0], np.cumsum(counts)]))
        same_lines = 1 - unlike / np.maximum(counts, 1)
        same_lines[counts == 0] = 0
    else:
        same_lines = np.zeros(docs)
    entropy = np.zeros(docs)
    for d in range(docs):
        c = np.bincount(data[offsets[d] : offsets[d + 1]], minlength=256)
        c = c[c > 0] / max(1, offsets[d + 1] - offsets[d])
        entropy[d] = -(c * np.log2(c)).sum()
    root = lambda x: np.sqrt(np.clip(x, 0, 1))  # noqa: E731  spreads small shares
    return np.stack(
        [
            np.log1p(n),
            np.log1p(letters * (n > 0) / safe),
            np.log1p(n / lines),
            root(share(_SYMBOL)),
            root(share(_DIGIT)),
            root(share(_CAPITAL)),
            root(share(_MARK)),
            _distinct(hashes, first) / np.sqrt(safe),
            root(1 - different / np.maximum(windows, 1)) * (windows > 0),
            root(same_lines),
            root(np.bincount(doc[same], minlength=docs) / safe),
            entropy,
        ],
        1,
    )


def _features(b: pa.Array) -> pa.Array:
    found = [np.zeros((0, len(FEATURES)))]
    for i, j, data, offsets in chunks(b):
        for a in range(i, j, 4096):
            z = min(a + 4096, j)
            part = offsets[a - i : z - i + 1]
            found.append(features(data[part[0] : part[-1]], part - part[0]))
    return pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(found).ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))


def text_features(text: Column) -> Column:
    """FEATURES of whole texts; null counts as empty."""
    return F.arrow_udf(_features, "array<double>")(text_bytes(text))


@dataclass
class Discriminant:
    """For each class the mean, the inverse of the Cholesky factor and the log-determinant, over standardised
    statistics; log_odds is that of class 1."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    inverses: np.ndarray
    log_dets: np.ndarray
    log_odds: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        density = [-0.5 * (((z - m) @ inv.T) ** 2).sum(1) - 0.5 * det for m, inv, det in zip(self.means, self.inverses, self.log_dets, strict=True)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.log_odds, -500, 500)))


def discriminant(counts: list[float], sums: list[np.ndarray], products: list[np.ndarray]) -> Discriminant:
    """From each class's count, sums and sums of products. A class without rows leaves the score at the other's
    share; without any rows the score is 0.5."""
    d = len(FEATURES)
    total = sum(counts)
    if not all(counts):
        odds = 0.0 if not total else (20.0 if counts[1] else -20.0)
        return Discriminant(np.zeros(d), np.ones(d), np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2), odds)
    centre = sum(sums) / total
    variance = np.diag(sum(products)) / total - centre**2
    scale = np.sqrt(np.maximum(variance, 1e-8))
    means, covariances = [], []
    for n, s, p in zip(counts, sums, products, strict=True):
        mean = s / n
        means.append((mean - centre) / scale)
        covariances.append((p / n - np.outer(mean, mean)) / np.outer(scale, scale))
    pooled = sum(n * c for n, c in zip(counts, covariances, strict=True)) / total
    pooled = (1 - TOWARDS_DIAGONAL) * pooled + TOWARDS_DIAGONAL * np.diag(np.diag(pooled))
    inverses, log_dets = [], []
    for c in covariances:
        factor = np.linalg.cholesky((1 - TOWARDS_POOLED) * c + TOWARDS_POOLED * pooled + RIDGE * np.eye(d))
        inverses.append(np.linalg.inv(factor))
        log_dets.append(2 * np.log(np.diag(factor)).sum())
    return Discriminant(centre, scale, np.array(means), np.array(inverses), np.array(log_dets), float(np.log(counts[1] / counts[0])))


def fit(labelled: DataFrame) -> Discriminant:
    """``labelled``: x (array of statistics), y (0 or 1; other values are left out). One aggregate over all rows."""
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    x = [F.col("x")[i] for i in range(d)]
    sums = [F.count("*").cast("double"), *[F.sum(c) for c in x], *[F.sum(x[i] * x[j]) for i, j in pairs]]
    rows = {int(r["y"]): [float(v or 0) for v in r[1:]] for r in labelled.where("y in (0, 1)").groupBy("y").agg(*[s.alias(f"a{k}") for k, s in enumerate(sums)]).collect()}
    counts, totals, products = [], [], []
    for y in (0, 1):
        values = rows.get(y, [0.0] * len(sums))
        counts.append(values[0])
        totals.append(np.array(values[1 : 1 + d]))
        p = np.zeros((d, d))
        for (i, j), v in zip(pairs, values[1 + d :], strict=True):
            p[i, j] = p[j, i] = v
        products.append(p)
    return discriminant(counts, totals, products)


def scored(x: Column, model: Discriminant) -> Column:
    """The score of a column of statistics, in [0, 1]."""

    @F.arrow_udf("double")
    def score(rows: pa.Array) -> pa.Array:
        flat = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), len(FEATURES))
        return pa.array(model.score(flat))

    return score(x)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, threshold: float = 0.7) -> DataFrame:
    """-> one row per row of ``docs``: id, held_out, score, predicted.

    Learns from the rows of ``labels`` whose crc32(id as text) mod 4 is not 2 and whose label is 0 or 1; several
    labels of one id count as several. Null texts count as empty; they and wordless ones are scored like any other. Texts of
    any length are taken whole; equal texts have equal scores, and a score at ``threshold`` predicts 1. Rows repeated under
    one id are scored each for itself, and each learns with its id's labels; a null id is scored and learns nothing.
    An empty table gives no rows; other columns are not looked at.
    """
    rows = table(docs.select(F.col(id_col).alias("id"), text_features(F.col(text_col)).alias("x")), "features")
    known = labels.select(F.col(id_col).alias("of"), F.col(label_col).alias("y")).where(~held_out(F.col("of")))
    model = fit(rows.join(known, F.col("id") == F.col("of")).select("x", "y"))
    out = rows.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), scored(F.col("x"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
