from returnsight.streaming.features import run_feature_stream, streaming_sku_features

__all__ = ["run_feature_stream", "streaming_sku_features"]
