"""Language identification by nearest clustered centroid.

A text is the L2-normalised TF-IDF vector of its byte bigrams and trigrams (letters only: digits, punctuation and
white space become one space; grams are hashed to ``DIMENSIONS``). Document frequencies cover every training row.
Each language has up to ``CLUSTERS`` centroids from spherical k-means over all its training rows; k-means has to start
somewhere, and starts from the centroids of some rows that a hash of the text draws. A text takes the language of the
centroid with the largest cosine.

Rejection is by distance, under a law for each centroid: the cosine that a text must reach depends on how many different
grams it has, since short and repetitive texts of a language lie farther from its centroids than long ones. The law
comes from windows of many lengths cut out of every training row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlake.llm.common import drop, held_out, table, text_bytes
from claimlake.llm.textkit import chunks

DIMENSIONS, CLUSTERS = 4096, 4
#: Training rows that k-means starts from, shared evenly by the languages. Each language has one at least, so driver and
#: workers hold 16 KB for max(SAMPLE_ROWS, languages) rows, however large the table.
SAMPLE_ROWS = 2000
#: Rounds of k-means over all training rows, fewer if no centroid moves farther than this cosine from where it was.
ROUNDS, STILL = 5, 1 - 1e-6
#: Vectors are added up in whole numbers of this part of one, so sums do not depend on the order of rows.
UNIT = 1 << 20
#: Cosines of windows are counted in this many steps.
STEPS = 10_000
#: A centroid that holds a smaller share of its language's rows stands for outliers and is left out.
LEAST_SHARE = 0.01
#: Bytes of the windows that the law of rejection is learned from; the bands of different grams that it knows; and the
#: windows of a band that a centroid needs for a law of its own.
WINDOWS = (16, 48, 128, 384, 1024, 4096)
BANDS, OWN_LAW = 12, 100
#: A cosine under this fraction of the one that 99 of 100 windows with as many different grams reach is rejected.
REJECT_FRACTION = 0.4
#: Documents that share one dense block of counts.
BLOCK = 64

_MAP = np.full(256, 0x20, np.uint8)
_MAP[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_MAP[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_MAP[0x80:] = np.arange(0x80, 0x100)


def gram_counts(column: pa.Array) -> Iterator[np.ndarray]:
    """Blocks of gram counts, a row for each text in order."""
    for i, j, data, offsets in chunks(column):
        data = _MAP[data]
        after = np.flatnonzero(data[:-1] == 0xC3) + 1  # the capital letters of Latin-1 in UTF-8
        upper = after[(data[after] >= 0x80) & (data[after] <= 0x9E)]
        data[upper] += 0x20
        for a in range(0, j - i, BLOCK):
            b = min(a + BLOCK, j - i)
            part = data[offsets[a] : offsets[b]].astype(np.uint32)
            edges = offsets[a : b + 1] - offsets[a]
            doc = np.repeat(np.arange(b - a, dtype=np.int64), np.diff(edges)) * DIMENSIONS
            counts = np.zeros((b - a) * DIMENSIONS, np.int64)
            code = part
            for width in (2, 3):
                if len(part) < width:
                    break
                code = code[: len(part) - width + 1] * np.uint32(256) + part[width - 1 :]
                ok = (doc[: len(code)] == doc[width - 1 :]) & (code != (0x2020 if width == 2 else 0x202020))
                hashed = (code[ok] * np.uint32(2654435761) + np.uint32(width * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(20)
                counts += np.bincount(doc[: len(code)][ok] + hashed, minlength=len(counts))
            yield counts.reshape(b - a, DIMENSIONS)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = counts.astype(np.float32) * idf
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def band(counts: np.ndarray) -> np.ndarray:
    """Twos logarithm of the number of different grams."""
    return np.log2(np.maximum((counts > 0).sum(1), 1))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    language_of: np.ndarray
    #: The least cosine by centroid and band; between bands it is interpolated.
    law: np.ndarray

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centroid and cosine (0 to 1)."""
        scores = vectors(counts, self.idf) @ self.centroids.T
        top = scores.argmax(1)
        return top, np.clip(scores[np.arange(len(top)), top], 0, 1)

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, cosine and rejection of each text."""
        number, cosine, rejected = [np.zeros(0, np.int64)], [np.zeros(0, np.float32)], [np.zeros(0, bool)]
        for counts in gram_counts(column):
            top, score = self.nearest(counts)
            at = np.minimum(band(counts), BANDS - 1)
            low = np.minimum(at.astype(np.int64), BANDS - 2)
            least = self.law[top, low] * (1 - (at - low)) + self.law[top, low + 1] * (at - low)
            number.append(self.language_of[top]), cosine.append(score), rejected.append(score < least)
        return np.concatenate(number), np.concatenate(cosine), np.concatenate(rejected)


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each gram that the partition has, and one (-1) with its number of texts."""
    total, rows = np.zeros(DIMENSIONS, np.int64), 0
    for batch in batches:
        for counts in gram_counts(batch["b"]):
            total += (counts > 0).sum(0)
            rows += len(counts)
    gram = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(gram, -1)), pa.array(np.append(total[gram], rows))], names=["gram", "n"])


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's texts once each: copies of a drawn text are not sent on."""
    seen: set[tuple[str, int]] = set()
    for batch in batches:
        fresh = [pair not in seen and not seen.add(pair) for pair in zip(batch["lang"].to_pylist(), batch["h"].to_pylist(), strict=True)]
        yield batch.filter(pa.array(fresh, pa.bool_()))


def _sample_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = 0
        for counts in gram_counts(batch["b"]):
            packed = [np.minimum(row, 65535).astype(np.uint16).tobytes() for row in counts]
            yield pa.RecordBatch.from_arrays([batch["lang"].slice(done, len(packed)), pa.array(packed, pa.binary())], names=["lang", "counts"])
            done += len(packed)


def windows(text: bytes) -> list[bytes]:
    """The text, and a window of each length that it has room for, at places that depend on the text alone."""
    place = zlib.crc32(text)
    return [text, *[text[place % (len(text) - n + 1) :][:n] for n in WINDOWS if len(text) >= n]]


def _window_cosines(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """How many windows of a batch have a centroid, band and cosine, as one number."""
    for batch in batches:
        keys = [np.zeros(0, np.int64)]
        for a in range(0, batch.num_rows, BLOCK):
            cut = [w for text in batch["b"].slice(a, BLOCK).to_pylist() for w in windows(text)]
            for counts in gram_counts(pa.array(cut, pa.binary())):
                top, score = model.value.nearest(counts)
                near = np.clip(np.round(band(counts)), 0, BANDS - 1).astype(np.int64)
                keys.append((top * BANDS + near) * (STEPS + 1) + np.rint(score.astype(np.float64) * STEPS).astype(np.int64))
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        step = [key // (STEPS + 1) // BANDS, key // (STEPS + 1) % BANDS, key % (STEPS + 1), n]
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in step], names=["centroid", "band", "step", "n"])


def law_of(rows: DataFrame, model: Model) -> np.ndarray:
    """The least cosine by centroid and band, from the windows of all ``rows`` (b), nearest to each centroid; a band where a
    centroid has few has that of all windows. Never falls with the band; bands without windows take the next lower one's."""
    shipped, number = rows.sparkSession.sparkContext.broadcast(model), len(model.centroids)
    seen = rows.select("b").mapInArrow(partial(_window_cosines, model=shipped), "centroid long, band long, step long, n long")
    seen = table(seen.groupBy("centroid", "band", "step").agg(F.sum("n").alias("n")), "windows")
    least = [F.sum("n").alias("n"), (F.percentile("step", 0.01, F.col("n")) / STEPS).alias("least")]  # of STEPS + 1 values a group at most
    law = np.zeros((number, BANDS))
    for r in seen.groupBy("band").agg(*least).where("n >= 20").collect():
        law[:, r["band"]] = r["least"]
    for r in seen.groupBy("centroid", "band").agg(*least).where(F.col("n") >= OWN_LAW).collect():
        law[r["centroid"], r["band"]] = r["least"]
    drop(seen)
    shipped.destroy()
    return REJECT_FRACTION * np.maximum.accumulate(law, 1)


def _cluster_sums(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """What a partition adds to each centroid: sums by gram, and under -1 its rows. Texts without a gram belong to none."""
    model = model.value
    number = {lang: i for i, lang in enumerate(model.languages)}
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        lang = np.array([number[x] for x in batch["lang"].to_pylist()], np.int64)
        done = 0
        for counts in gram_counts(batch["b"]):
            x = vectors(counts, model.idf)
            own = np.where(model.language_of == lang[done : done + len(x), None], x @ model.centroids.T, -2).argmax(1)
            done += len(x)
            own[~counts.any(1)] = -1
            x = np.rint(x * np.float32(UNIT))
            for c in np.unique(own[own >= 0]).tolist():
                mine = own == c
                sums = total.setdefault(c, np.zeros(DIMENSIONS + 1))
                sums[:-1] += x[mine].sum(0, dtype=np.float64)  # whole numbers below 2 ** 53, so exact
                sums[-1] += mine.sum()
    for c, sums in total.items():
        gram = np.flatnonzero(sums)
        n = sums[gram].astype(np.int64)
        gram[gram == DIMENSIONS] = -1
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), c)), pa.array(gram), pa.array(n)], names=["centroid", "gram", "n"])


def refined(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Centroids after a round of k-means over all ``rows`` (lang, b), and how many rows each was the nearest of its language
    to. Partitions add up; the sums of a centroid, not its rows, go to the driver."""
    shipped = rows.sparkSession.sparkContext.broadcast(model)
    found = rows.select("lang", "b").mapInArrow(partial(_cluster_sums, model=shipped), "centroid long, gram long, n long")
    found = found.groupBy("centroid", "gram").agg(F.sum("n").alias("n")).toArrow()
    shipped.destroy()
    centroid, gram, n = (found[c].to_numpy() for c in ("centroid", "gram", "n"))
    total, held = np.zeros(model.centroids.shape), np.zeros(len(model.centroids), np.int64)
    total[centroid[gram >= 0], gram[gram >= 0]] = n[gram >= 0]
    held[centroid[gram < 0]] = n[gram < 0]
    total /= np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
    return np.where(held[:, None] > 0, total, model.centroids).astype(np.float32), held


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from the row nearest the mean and rows drawn by their distance from the centres so far; draws
    are seeded and the order of rows decides ties."""
    draw = np.random.Generator(np.random.PCG64(20260303))
    centres = [x[int((x @ x.mean(0)).argmax())]]
    near = x @ centres[0]
    while len(centres) < min(k, len(x)):
        far = np.cumsum(np.maximum(1 - near, 0))
        if far[-1] <= 1e-6:
            break
        centres.append(x[int(np.searchsorted(far, draw.random() * far[-1]))])
        near = np.maximum(near, x @ centres[-1])
    c = np.array(centres)
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = np.array([x[own == i].sum(0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", *, sample_rows: int = SAMPLE_ROWS, clusters: int = CLUSTERS) -> Model:
    """Learns from text and language of the rows of ``docs`` that have both; every language that occurs is learned.
    Languages, the bounded rows that k-means starts from and sums go to the driver, nothing else."""
    spark = docs.sparkSession
    text = text_bytes(F.col(text_col))
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), text.alias("b"), F.pmod(F.xxhash64(F.lit("sample"), text), F.lit(1 << 30)).alias("h"))
    found = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"), F.min("h").alias("least")).collect()
    if not found:
        return Model([], np.ones(DIMENSIONS, np.float32), np.zeros((1, DIMENSIONS), np.float32), np.zeros(1, np.int64), np.full((1, BANDS), 2.0))
    frequency = rows.select("b").mapInArrow(_document_frequency, "gram long, n long").groupBy("gram").sum("n").collect()
    df, total = np.zeros(DIMENSIONS), 0
    for gram, n in frequency:
        if gram < 0:
            total = n
        else:
            df[gram] = n
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)
    quota = max(1, sample_rows // len(found))
    drawn = [(r["lang"], max(r["least"], int(min(1.0, quota / max(1, r["n"])) * (1 << 30)))) for r in found]  # one text of each at least
    limits = spark.createDataFrame(drawn, "lang string, most long")
    some = rows.join(F.broadcast(limits), "lang").where("h <= most").select("lang", "h", "b")
    sample = table(some.mapInArrow(_first, "lang string, h long, b binary").dropDuplicates(["lang", "h"]).select("lang", "b"), "sample")
    by_lang: dict[str, list[bytes]] = {}
    for lang, packed in sorted((r["lang"], bytes(r["counts"])) for r in sample.mapInArrow(_sample_counts, "lang string, counts binary").collect()):
        by_lang.setdefault(lang, []).append(packed)
    languages, centroids, owner = sorted(by_lang), [], []
    for number, lang in enumerate(languages):
        x = vectors(np.array([np.frombuffer(p, np.uint16) for p in by_lang[lang]]), idf)
        x = x[np.abs(x).sum(1) > 0] if (np.abs(x).sum(1) > 0).any() else x
        centroids.append(kmeans(x, clusters))
        owner += [number] * len(centroids[-1])
    drop(sample)
    model = Model(languages, idf, np.concatenate(centroids), np.array(owner), np.zeros((len(owner), BANDS)))
    for _ in range(ROUNDS):
        before = model.centroids
        model.centroids, held = refined(rows, model)
        if ((before * model.centroids).sum(1) >= STILL * (before * before).sum(1)).all():
            break
    every, most = np.zeros(len(languages)), np.zeros(len(languages))
    np.add.at(every, model.language_of, held)
    np.maximum.at(most, model.language_of, held)
    kept = held >= np.minimum(LEAST_SHARE * every, most)[model.language_of]
    model.centroids, model.language_of = model.centroids[kept], model.language_of[kept]
    model.law = law_of(rows, model)
    return model


_RESULT = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])


def _score(text: pa.Array, letter: pa.Array, model) -> pa.Array:
    model = model.value
    number, score, rejected = model.predict(text)
    some = letter.fill_null(False).to_numpy(zero_copy_only=False) & bool(model.languages)
    names = np.array([*model.languages, "und"], object)
    return pa.StructArray.from_arrays(
        [pa.array(names[np.where(some, number, len(model.languages))], pa.string()), pa.array(np.where(some, score, 0.0).astype(np.float64)), pa.array(~some | rejected)],
        fields=list(_RESULT),
    )


def classify(text: Column, model: Model, spark) -> Column:
    """Struct of lang, score (cosine, 0 to 1) and rejected. ``und``, 0 and true where the text is null or has no
    letter, or the model has learned nothing. Whole texts, any length; equal texts get equal results. Of centroids
    equally near the first in order of language decides."""
    shipped = spark.sparkContext.broadcast(model)  # bounded by SAMPLE_ROWS and the number of languages

    @F.arrow_udf("lang string, score double, rejected boolean")
    def scored(b: pa.Array, letter: pa.Array) -> pa.Array:
        return _score(b, letter, shipped)

    return scored(text_bytes(text), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """-> one row per row of ``docs``: id, held_out, lang_pred, score, rejected. Learns from the rows whose
    crc32(id as text) mod 4 is not 2; predicts from the text alone. No labelled rows: every text is ``und``.
    Rows repeated under one id are told each for itself. An empty table gives no rows; other columns are not looked
    at."""
    known = docs.where(~held_out(F.col(id_col)))
    model = fit(known, lang_col, text_col, **options)
    found = classify(F.col(text_col), model, docs.sparkSession)
    out = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), found.alias("p"))
    return out.select(id_col, "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.rejected").alias("rejected"))
