from returnsight.sources.tables import (
    Source,
    as_source,
    fixture_detail,
    fixture_sku,
    read_jdbc,
    read_parquet_table,
    read_table,
)
from returnsight.sources.sinks import write_table

__all__ = ["Source", "as_source", "fixture_detail", "fixture_sku", "read_jdbc", "read_parquet_table", "read_table", "write_table"]
