"""Session construction and lineage cutting."""

from __future__ import annotations

import hashlib
import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "returnsight") -> SparkSession:
    """A session with AQE on, the UI off, UTC time and ANSI left at Spark's default (on)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # remove checkpoint files once their frames are garbage-collected on the driver
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; only a local session may fall back to /tmp."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="returnsight-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def session_key(spark: SparkSession) -> str:
    """Identifies the running application (for per-session memoisation)."""
    try:
        return spark.sparkContext.applicationId
    except Exception:  # pragma: no cover - sessions without a local SparkContext
        return spark.conf.get("spark.app.id", None) or str(id(spark))


def materialise(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: writes to the shared checkpoint folder and cuts lineage, so a lost
    executor never forces recomputation of upstream scans, joins or shuffles."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scan_bytes(df: DataFrame) -> int:
    """Bytes of the base relations a plan reads, as the planner sizes them (file sizes for file
    sources). Join estimates are not used: without cost-based statistics they multiply."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_sized: dict[str, str] = {}  # application -> the value this module set last


def size_shuffles(spark: SparkSession, source: DataFrame, *, bytes_per_partition: int = 512 << 20) -> int:
    """Size AQE's initial shuffle partition count for jobs over ``source``: one partition per
    ``bytes_per_partition`` of scanned input, at least the cluster's parallelism. AQE then coalesces
    the ranges that turn out small towards ``spark.sql.adaptive.advisoryPartitionSizeInBytes``. A
    value the user configured is kept; one set by an earlier call is sized anew. Returns the count
    in effect."""
    current = spark.conf.get(INITIAL_PARTITIONS, None)
    if current is not None and current != _sized.get(session_key(spark)):
        return int(current)
    n = max(spark.sparkContext.defaultParallelism, math.ceil(scan_bytes(source) / max(1, bytes_per_partition)))
    _sized[session_key(spark)] = str(n)
    spark.conf.set(INITIAL_PARTITIONS, str(n))
    return n


def files_version(*frames: DataFrame) -> str:
    """Digest of the paths, sizes and modification times of the files that the frames read, from the
    listings their scans already hold. A source that is not files (a database) counts as changed
    every time."""
    seen = hashlib.sha256()
    for df in frames:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        for i in range(leaves.size()):
            leaf = leaves.apply(i)
            kind = leaf.getClass().getSimpleName()
            if kind == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
                seen.update(leaf.relation().location().allFiles().mkString("\n").encode())
            elif kind in ("LocalRelation", "LogicalRDD", "Range", "OneRowRelation"):
                seen.update(leaf.toString().encode())
            else:
                seen.update(uuid.uuid4().bytes)
    return seen.hexdigest()


def listed_version(spark: SparkSession, paths: list[str]) -> str:
    """``files_version`` of whatever files lie under ``paths``, from one listing: no schema is read and
    nothing is planned."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    leaf = files._jdf.queryExecution().analyzed().collectLeaves().head()
    return hashlib.sha256(leaf.relation().location().allFiles().mkString("\n").encode()).hexdigest()
