"""Centroids and the law of rejection of operator 1 come from every training row."""

import numpy as np
import pyarrow as pa
from claimlake.llm import langid

WORDS = {"x": "alpha beta gamma delta epsilon zeta eta theta", "y": "uno dos tres cuatro cinco seis siete ocho"}


def texts():
    draw = np.random.default_rng(5)
    return [(lang, " ".join(draw.choice(words.split(), 3 + i % 60))) for lang, words in WORDS.items() for i in range(150)]


def test_centroids_and_law_take_all_rows(spark):
    rows = texts()
    docs = spark.createDataFrame(rows, "lang string, text string")
    model = langid.fit(docs, sample_rows=2, clusters=1)
    again = langid.fit(docs.repartition(7), sample_rows=2, clusters=1)
    assert (model.centroids == again.centroids).all() and np.allclose(model.law, again.law, atol=1e-4)
    vectors = {lang: np.concatenate([langid.vectors(c, model.idf) for c in langid.gram_counts(pa.array([t.encode() for k, t in rows if k == lang], pa.binary()))]) for lang in WORDS}
    for lang, centroid in zip(model.languages, model.centroids, strict=True):
        mean = vectors[lang].sum(0)
        assert np.abs(mean / np.linalg.norm(mean) - centroid).max() < 1e-5
    cut = [w for _, t in rows for w in langid.windows(t.encode())]
    counts = np.concatenate(list(langid.gram_counts(pa.array(cut, pa.binary()))))
    top, score = model.nearest(counts)
    near = np.clip(np.round(langid.band(counts)), 0, langid.BANDS - 1)
    law = np.zeros((2, langid.BANDS))
    for k in range(langid.BANDS):
        for c in range(2):
            own, every = score[(near == k) & (top == c)], score[near == k]
            law[c, k] = np.quantile(own if len(own) >= langid.OWN_LAW else every, 0.01) if len(every) >= 20 else 0
    assert np.abs(langid.REJECT_FRACTION * np.maximum.accumulate(law, 1) - model.law).max() < 2e-4
