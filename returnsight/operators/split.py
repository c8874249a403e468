"""Hold-out split and k-fold assignment of exact size.

Rows are ranked by a hash of their key and a seed (ties by key), so a row's side and fold do not
depend on partitioning or task retries, and the SQL oracle can rank the same way. The ranking is a
distributed sort; no window holds more than one partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from returnsight.functions import key_hash
from returnsight.operators.ranking import range_index


def _ranked(df: DataFrame, key: str, seed: int) -> DataFrame:
    """``df`` with ``_pos``, the 0-based rank of its key's hash, and ``_rows``, its number of rows."""
    ranked = range_index(df.withColumn("_hash", key_hash(key, seed)), [F.col("_hash").asc(), F.col(key).asc()])
    return ranked.drop("_hash")


def holdout_split(df: DataFrame, key: str = "sku_key", test_fraction: float = 0.3, seed: int = 10) -> DataFrame:
    """Adds ``is_test`` (boolean): true for the first ceil(n * ``test_fraction``) rows in hash order."""
    held = F.ceil(F.col("_rows") * F.lit(test_fraction).cast("decimal(9,6)"))
    return _ranked(df, key, seed).withColumn("is_test", F.col("_pos") < held).drop("_pos", "_rows")


def fold_assignment(df: DataFrame, key: str = "sku_key", n_folds: int = 10, seed: int = 1) -> DataFrame:
    """Adds ``fold`` in ``[0, n_folds)``; sizes differ by one row at most. Fewer rows than folds raise."""
    ranked = _ranked(df, key, seed)
    first = ranked.select("_rows").first()  # the total stands in every row
    if not first or first["_rows"] < n_folds:
        raise ValueError(f"cannot make {n_folds} folds of {first['_rows'] if first else 0} rows")
    return ranked.withColumn("fold", (F.col("_pos") % n_folds).cast("int")).drop("_pos", "_rows")
