from returnsight.functions.scalars import (
    decode_flag,
    key_hash,
    icontains,
    nan_to_null,
    round_doubles,
    safe_ln,
    ship_by_value,
)

__all__ = ["decode_flag", "key_hash", "icontains", "nan_to_null", "round_doubles", "safe_ln", "ship_by_value"]
