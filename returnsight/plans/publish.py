"""Replacing a table without a gap.

Dropping a table and building it again leaves readers without one for as long as the build takes, and
for good if it fails. Here every build is written to a location of its own; the catalog view of the
table's name is switched over to it in one statement once all files are there. Readers that began
before the switch finish on the files they have listed, which stay until ``keep`` further builds have
been published; a failed build leaves the view where it was."""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_NAME = re.compile(r"v(\d{20})-[0-9a-f]{8}")


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, root: str) -> list[str]:
    """Locations of the complete versions under ``root``, oldest first."""
    fs, at = _folder(spark, root)
    if not fs.exists(at):
        return []
    found = [s.getPath() for s in fs.listStatus(at) if s.isDirectory() and _NAME.fullmatch(s.getPath().getName())]
    done = [p for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted((p.toString() for p in done), key=lambda p: p.rsplit("/", 1)[1])


def publish(df: DataFrame, view: str, root: str, *, keep: int = 2, partition_by: list[str] | None = None) -> str:
    """Write ``df`` to a new version under ``root``, switch ``view`` (a catalog name) to it and remove
    all but the ``keep`` versions before it. Returns the new location."""
    spark = df.sparkSession
    path = f"{root.rstrip('/')}/v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    spark.sql("CREATE OR REPLACE VIEW IDENTIFIER(:view) AS SELECT * FROM parquet.`" + path.replace("`", "``") + "`", args={"view": view})
    for old in versions(spark, root)[: -(keep + 1)]:
        fs, at = _folder(spark, old)
        fs.delete(at, True)
    return path
