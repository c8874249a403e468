"""From raw documents to packed training sequences, stage by stage.

Toxic and low-quality documents go, one document of each SimHash group stays, secrets are masked,
and the rest is tokenised and packed. ``run`` writes each stage's result as Parquet in the shared
folder and the next stage reads it from there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from returnsight.llm import quality, toxicity
from returnsight.llm.common import staged, table
from returnsight.llm.packing import best_fit_packing
from returnsight.llm.secret_scan import without_secrets
from returnsight.llm.simhash import fingerprint_of, rooted_fingerprints
from returnsight.llm.tokens import vocabulary_path
from returnsight.operators.features import broadcast_if_small

#: Stages fit models and cluster by hashes; tests hold the result against brute force instead.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity operator scores below its threshold."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality operator keeps."""
    return quality.good_only(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every SimHash group: of the rows with its smallest doc_id the one with the smallest
    fingerprint, then the smallest row. Rows without an id come last, so one stays only in a group
    where no row has an id."""
    groups = staged(rooted_fingerprints(docs, words=4, max_bits=4), "groups")
    known = groups.where("doc_id IS NOT NULL")
    repeated = staged(known.groupBy(F.col("doc_id").alias("again_id")).count().where("count > 1").select("again_id"), "repeated")
    gone = staged(known.where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).join(repeated, F.col("gone_id") == F.col("again_id"), "left_anti"), "gone")
    gone = broadcast_if_small(gone)  # within measured bounds, so that texts are not shuffled by id
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))  # whatever its columns are called
    left = rows.join(gone, F.col("row.doc_id") == F.col("gone_id"), "left_anti")
    if repeated.isEmpty() and groups.where("doc_id IS NULL").isEmpty():
        return left.select("row.*")
    # ids do not tell these rows apart: id and fingerprint do, and rows equal in both are copies
    same = F.col("row.doc_id") == F.col("again_id")
    unclear = rows.join(repeated, same, "left_semi").unionByName(rows.where("row.doc_id IS NULL"))
    keyed = unclear.select(F.col("row.doc_id").cast("long").alias("key_id"), fingerprint_of(F.col("row.text")).alias("key_fp"), "row")
    smallest = F.min("row") if _orderable(docs) else F.min_by("row", F.to_json("row"))
    single = keyed.groupBy("key_id", "key_fp").agg(smallest.alias("row"))  # tasks take their minima first
    first = groups.where("component_id IS NULL OR doc_id = component_id").groupBy("root", "doc_id").agg(F.min("fp").alias("first_fp"))
    kept = F.col("key_id").eqNullSafe(F.col("doc_id")) & (F.col("key_fp") == F.col("first_fp"))
    single = single.join(first, kept, "left_semi").select("row")
    plain = left.join(repeated, same, "left_anti").where("row.doc_id IS NOT NULL")
    return plain.unionByName(single).select("row.*")


def _orderable(docs: DataFrame) -> bool:
    """Whether rows can be compared: maps and variants cannot."""
    kinds = docs.schema.simpleString()
    return "map<" not in kinds and "variant" not in kinds


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets in their texts masked."""
    return without_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 4096 ids."""
    return best_fit_packing(docs, vocabulary_path(), capacity=4096, end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_low_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
