"""The streaming feature build equals the batch plan and resumes from its checkpoint."""

import os
import tempfile

from pyspark.sql import functions as F

from returnsight.config import FIXTURE
from returnsight.operators.features import features_from_partials, sku_features_eager
from returnsight.sources import fixture_detail, fixture_sku
from returnsight.streaming.features import run_feature_stream, start_feature_stream
from tests.conftest import SF001


def _rows(df):
    return sorted(tuple(r) for r in df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]).collect())


def test_stream_equals_batch_and_restart_is_idempotent(spark):
    out = tempfile.mkdtemp(prefix="returnsight-stream-")
    sink = run_feature_stream(spark, SF001, FIXTURE, out)
    sku = fixture_sku(spark, SF001)
    first = _rows(features_from_partials(spark.read.parquet(sink), sku, FIXTURE))
    batch = _rows(sku_features_eager(fixture_detail(spark, SF001), sku, FIXTURE))
    assert first == batch and len(first) == 116
    # a second run with the same checkpoint sees no new files: nothing is counted twice
    run_feature_stream(spark, SF001, FIXTURE, out)
    again = _rows(features_from_partials(spark.read.parquet(sink), sku, FIXTURE))
    assert again == first
    assert os.path.isdir(os.path.join(out, "_checkpoint", "offsets"))


def test_stream_with_a_file_cap_per_trigger(spark):
    out = tempfile.mkdtemp(prefix="returnsight-stream-")
    sink = run_feature_stream(spark, SF001, FIXTURE, out, max_files_per_trigger=1)
    sku = fixture_sku(spark, SF001)
    assert features_from_partials(spark.read.parquet(sink), sku, FIXTURE).count() == 116


def test_a_running_stream_can_be_stopped(spark):
    stream = start_feature_stream(spark, SF001, FIXTURE, tempfile.mkdtemp(prefix="returnsight-stream-"), available_now=False)
    stream.query.processAllAvailable()
    assert stream.query.isActive and spark.read.parquet(stream.latest()).count() > 0
    stream.query.stop()
    assert not stream.query.isActive
