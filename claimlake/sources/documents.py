"""Files to documents, blocks, candidates and a plan of the work; logs and text sinks."""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from claimlake.functions import ids
from claimlake.functions.scalar import chunk_estimate, newlines
from claimlake.sources import formats

BLOCKS = "path string, format string, block_idx int, text string, locator map<string, string>, error string"
CANDIDATES = "path string, ordinal long, subject string, predicate string, object string, evidence string, error string"
SECONDS_PER_CHUNK, SECONDS_PER_TIER = 8.0, 0.5


def files(spark: SparkSession, path: str, extensions: tuple[str, ...] = ()) -> DataFrame:
    """path, name, content of the files below a folder."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if extensions:
        reader = reader.option("pathGlobFilter", "*{" + ",".join(extensions) + "}")
    return reader.load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content", "length")


def _failing(frame: pd.DataFrame) -> Iterator[tuple[str, str, formats.Parsed | None, str | None]]:
    for row in frame.itertuples():
        try:
            yield row.path, row.name.rpartition(".")[2].lower(), formats.parse(row.name, row.content), None
        except Exception as error:  # one unreadable file is a row with its error, not the end of the job
            yield row.path, row.name.rpartition(".")[2].lower(), None, f"{type(error).__name__}: {error}"


def blocks(found: DataFrame) -> DataFrame:
    """Blocks of every file by the parser of its extension; a file that cannot be read is one row with its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, kind, parsed, error in _failing(frame):
                if parsed is None:
                    out.append((path, kind, 0, None, None, error))
                else:
                    out += [(path, kind, i, t, {k: str(v) for k, v in locator.items()}, None) for i, (t, locator) in enumerate(parsed.blocks)]
            yield pd.DataFrame(out, columns=["path", "format", "block_idx", "text", "locator", "error"])

    return found.select("path", "name", "content").mapInPandas(run, BLOCKS)


def lifted(found: DataFrame) -> DataFrame:
    """Tier-0 candidates of structured files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(path, i, *c, None) for path, _, parsed, _ in _failing(frame) if parsed for i, c in enumerate(parsed.candidates)]
            yield pd.DataFrame(out, columns=["path", "ordinal", "subject", "predicate", "object", "evidence", "error"])

    return found.select("path", "name", "content").mapInPandas(run, CANDIDATES)


def _nfc(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())


def normalise(text: Column) -> Column:
    """NFC (by an Arrow function, as no expression has it) and LF line ends."""
    return newlines(F.when(text.rlike(r"[^\x00-\x7F]"), F.arrow_udf(_nfc, "string")(text)).otherwise(text))


def ingest(found: DataFrame) -> DataFrame:
    """doc_id, text, file_name."""
    text = F.decode("content", "UTF-8")
    doc_id = ids.b32_id("doc:", F.col("path"), F.left(text, F.lit(2048)))
    return found.select(doc_id.alias("doc_id"), text.alias("text"), F.col("name").alias("file_name"))


def plan_job(found: DataFrame) -> DataFrame:
    """One row: files, bytes, lines, chunks and the estimated seconds of a run with a model."""
    lines = F.size(F.split(F.decode("content", "UTF-8"), "\n", -1))
    total = found.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"), F.coalesce(F.sum(lines), F.lit(0)).alias("n_lines"))
    total = total.withColumn("n_chunks", chunk_estimate(F.col("n_lines")))
    return total.withColumn("seconds", F.col("n_chunks") * SECONDS_PER_CHUNK + 2 * SECONDS_PER_TIER)


#: The column of a line that could not be read.
BAD = "_malformed"


def read_log(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines; blank lines are skipped, a missing file is an empty table. Lines that are not JSON of ``schema`` are
    left to ``malformed_lines``."""
    found = _lines(spark, path, schema)
    return found.where(f"{BAD} is null").drop(BAD)


def malformed_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """line: what ``read_log`` does not read."""
    found = _lines(spark, path, schema)
    return found.where(f"{BAD} is not null").select(F.col(BAD).alias("line"))


def _lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    schema = spark.createDataFrame([], schema).schema.add(BAD, "string")
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path).where("trim(value) <> ''")
    return lines.select(F.from_json("value", schema, {"columnNameOfCorruptRecord": BAD}).alias("row")).select("row.*")


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines, one file per partition."""
    df.write.mode("overwrite").json(path)


def append_line(path: str, record: dict) -> None:
    import json

    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(record, sort_keys=True) + "\n")


def html_pages(pages: DataFrame) -> DataFrame:
    """Structural blocks of stored pages (page_id, html)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for page, markup in zip(frame["page_id"], frame["html"], strict=True):
                out += [(page, i, locator.get("tag"), text) for i, (text, locator) in enumerate(formats.html((markup or "").encode()).blocks)]
            yield pd.DataFrame(out, columns=["page_id", "element_index", "tag", "text"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, element_index int, tag string, text string")
