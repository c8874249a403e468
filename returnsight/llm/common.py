"""Shared pieces of the training-data operators: inputs, written tables and sliced batches."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from returnsight.session import ensure_checkpoint_dir

#: Characters of text that one step inside a task works on at a time (a longer text is taken alone).
SLICE_CHARS = 6_000_000


#: Rows of a batch sent to Python: whole texts are large, and Spark's 10,000 of them fill a worker.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_shipped: set[str] = set()


def ready(df: DataFrame) -> DataFrame:
    """Prepare ``df``'s session for Python stages over texts: smaller Arrow batches, unless the user
    has set their size, and this package on the executors."""
    spark = df.sparkSession
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "1000")
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        package = Path(__file__).resolve().parent.parent
        if package.is_dir():  # not already inside an archive
            base = f"{tempfile.mkdtemp(prefix='package-')}/{package.name}-{uuid.uuid4().hex[:8]}"
            spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", package.parent, package.name))
        _shipped.add(application)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back: the lineage ends
    there, so a lost executor costs the readers nothing, and every reader sees the same rows."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def chunked(rows: DataFrame, keys: list[str], limit: int) -> tuple[Column, int]:
    """A column that deals the written table ``rows``, whose ``keys`` differ, out to chunks of at most
    ``limit`` rows, and the number of chunks: their sizes are counted, and the number doubles until all
    fit."""
    chunks = max(1, -(-rows.count() // limit))
    while True:
        chunk = F.pmod(F.xxhash64(*keys), F.lit(chunks))
        if chunks == 1 or rows.groupBy(chunk.alias("chunk")).count().agg(F.max("count")).first()[0] <= limit:
            return chunk, chunks
        chunks *= 2


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(text, label) of at most ``bound`` labelled rows outside the held-out third, in the order of
    a hash of the id. The ids sent to every task are at most ``bound``, so they are broadcast."""
    ids = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("fit_id"))
        .agg(F.max(F.col(label).cast("int")).alias("fit_label"))
        .orderBy(F.xxhash64("fit_id"), "fit_id")
        .limit(bound)
    )
    rows = docs.select(F.col("doc_id").alias("own_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.join(F.broadcast(ids), F.col("own_id") == F.col("fit_id")).select("own_id", "text", "fit_label")


def gathered(batches: Iterator[pa.RecordBatch], text: int, limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches whose texts (column number ``text``) hold about ``limit``
    bytes; a longer batch passes as it is."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        own = pc.sum(pc.binary_length(batch.column(text))).as_py() or 0
        if held and size + own > limit:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += own
    if held:
        yield pa.concat_batches(held)
    pa.default_memory_pool().release_unused()


def slices(sizes: Sequence[int], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of the given sizes that hold at most ``limit`` together, one text at least."""
    start = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)
