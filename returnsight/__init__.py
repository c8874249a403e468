"""returnsight: product-return analytics on Spark.

Transaction lines and a SKU dimension become one feature row per SKU; those rows are labelled,
cleaned, explored, modelled with Spark ML, explained with Shapley values, and summarised into
top-k product reports. Every operator is a function from DataFrame to DataFrame built from
Spark's own expressions, so Catalyst and adaptive execution plan the work.
"""

from returnsight.config import FIXTURE, REFERENCE, Params, predictors

__all__ = ["FIXTURE", "REFERENCE", "Params", "predictors"]
