"""Brute-force vector search: exact cosine, one broadcast query vector, a bounded heap of k in every task."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


Embedder = Callable[[list[str]], list[list[float]]]


def hashed(texts: list[str], size: int = 64) -> list[list[float]]:
    """An embedder without a model: words counted under a hash."""
    out = []
    for text in texts:
        row = [0.0] * size
        for word in text.lower().split():
            row[zlib.crc32(word.encode()) % size] += 1.0
        out.append(row)
    return out


def embedded(rows: DataFrame, embed: Embedder, text_col: str = "text") -> DataFrame:
    """Adds ``embedding`` by an injected embedder, a batch of texts at a time."""

    @F.pandas_udf("array<double>")
    def vectors(texts: pd.Series) -> pd.Series:
        return pd.Series([[float(x) for x in v] for v in embed(texts.fillna("").tolist())])

    return rows.withColumn("embedding", vectors(text_col))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def top_k(vectors: DataFrame, query: list[float], k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", digits: int = 5) -> DataFrame:
    """id and score (rounded) of the k nearest; ties by id. TakeOrdered: k rows leave a task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    score = F.round(cosine(F.col(vector_col), q), digits)
    return vectors.select(id_col, score.alias("score")).orderBy(F.desc_nulls_last("score"), id_col).limit(k)


def top_k_for_id(vectors: DataFrame, query_id: int, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", digits: int = 5) -> DataFrame:
    """The query is a stored vector, fetched by a scalar subquery: no trip over the driver."""
    q = vectors.where(F.col(id_col) == query_id).agg(F.first(vector_col).alias("q"))
    score = F.round(cosine(F.col(vector_col), F.col("q")), digits)
    return vectors.join(F.broadcast(q)).select(id_col, score.alias("score")).orderBy(F.desc_nulls_last("score"), id_col).limit(k)
