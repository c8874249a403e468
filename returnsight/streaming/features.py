"""The feature build over a stream of transaction lines (Structured Streaming).

New line files are joined to the static order table (stream-static inner join), windowed,
decoded and reduced to per-SKU partial sums; Spark's state store keeps one row per SKU, so the
state grows with the SKU count, not with the lines. Each trigger writes the complete partial
table to a folder of its own, named by its epoch; an epoch that is run again replaces its folder, and
readers take the newest finished one, so they never see a half-written table. The feature table is
finished from it with the same code as the batch plan.
No watermark is needed: state is keyed by SKU, not by event time, and the date window is a
plain filter.
"""

from __future__ import annotations

import os
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from returnsight.config import Params
from returnsight.operators.features import features_from_partials, line_partials
from returnsight.session import ensure_checkpoint_dir
from returnsight.sources import fixture_detail, fixture_sku, read_parquet_table


class FeatureStream(NamedTuple):
    query: StreamingQuery
    folder: str

    def latest(self) -> str | None:
        """Folder of the newest finished epoch."""
        spark = SparkSession.getActiveSession()
        root = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        done = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/epoch=*/_SUCCESS"))
        return max((f.getPath().getParent().toString() for f in done), default=None)


def start_feature_stream(
    spark: SparkSession,
    sf_dir: str,
    params: Params,
    out_dir: str | None = None,
    *,
    max_files_per_trigger: int | None = None,
    available_now: bool = True,
) -> FeatureStream:
    """Start the stream; with ``available_now`` it ends by itself once all files present are read,
    else the caller stops ``query``."""
    base = out_dir or os.path.join(ensure_checkpoint_dir(spark), f"feature-stream-{uuid.uuid4().hex}")
    sink, ckpt = os.path.join(base, "partials"), os.path.join(base, "_checkpoint")
    schema = read_parquet_table(spark, sf_dir, "lineitem").schema
    # Each trigger writes the complete per-SKU partial table (one row per SKU), so a backlog is
    # best taken in few large micro-batches: no per-trigger file cap unless one is asked for.
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = (
        reader
        # a one-alternative glob: the file source then accepts a table stored as a single file
        .parquet(f"{sf_dir.rstrip('/')}/lineitem.{{parquet}}")
    )
    partials = line_partials(fixture_detail(spark, sf_dir, lineitem=lines), params)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(sink, f"epoch={epoch:012d}"))

    writer = partials.writeStream.outputMode("complete").option("checkpointLocation", ckpt).foreachBatch(write)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return FeatureStream(writer.start(), sink)


def run_feature_stream(spark: SparkSession, sf_dir: str, params: Params, out_dir: str | None = None, *, max_files_per_trigger: int | None = None) -> str:
    """Read all files present; returns the folder of the last epoch's partial table."""
    stream = start_feature_stream(spark, sf_dir, params, out_dir, max_files_per_trigger=max_files_per_trigger)
    stream.query.awaitTermination()
    return stream.latest()


def streaming_sku_features(spark: SparkSession, sf_dir: str, params: Params) -> DataFrame:
    sink = run_feature_stream(spark, sf_dir, params)
    return features_from_partials(spark.read.parquet(sink), fixture_sku(spark, sf_dir), params)
