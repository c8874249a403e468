"""Parameters of the analysis.

Every knob the reference hard-codes is a field here, so one run can use the reference's
production values and another the values fitted to the driver's test tables.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

# --- Fixed values from the reference (must stay equal for the same results) ----------------
# Predictor set "All", in the reference's order.
BASE_PREDICTORS = ("receipted_rate", "sku_color", "sku_size", "avg_price_product", "quantity", "ecom_rate")
# Predictor-set variants: "All" = base; "Footwear" adds the family flag; "Brand" adds the brand flag.
PREDICTOR_SETS = {"All": (), "Footwear": ("footwear",), "Brand": ("brand",)}
# Columns whose z-score the cleaning step reports.
ZSCORE_COLUMNS = ("quantity", "receipted_rate", "avg_price_product", "ecom_rate")
# Reference production values: one calendar year, more than 100 sale lines, footwear and
# brand patterns (note the space before ADIDAS), report brand filter "Adidas", IQR factor 0.5,
# 30 % hold-out with seed 10, 10 folds with seed 1, boosted trees at rate 0.09 / depth 3 /
# seed 42, random forest of 100 trees at depth 3.


@dataclass(frozen=True)
class Params:
    # feature build
    date_lo: str = "2021-01-01"
    date_hi: str = "2022-01-01"
    min_sale_lines: int = 100
    # text flags and report filters (matched case-insensitively)
    family_pattern: str = "shoes|cleats|footwear"
    brand_pattern: str = "NIKE| ADIDAS"
    report_brand_pattern: str = "Adidas"
    top_k: int = 5
    # cleaning
    iqr_columns: tuple[str, ...] = ("ecom_rate",)
    iqr_factor: float = 0.5
    log_columns: tuple[str, ...] = ("quantity", "avg_price_product")
    impute_columns: tuple[str, ...] = ("receipted_rate",)
    # splitting
    test_fraction: float = 0.3
    split_seed: int = 10
    n_folds: int = 10
    fold_seed: int = 1
    # models
    gbt_step: float = 0.09
    gbt_depth: int = 3
    gbt_iters: int = 100
    gbt_seed: int = 42
    rf_trees: int = 100
    rf_depth: int = 3
    rf_seed: int = 42
    lr_iters: int = 100
    predictor_set: str = "All"
    # boosting rounds between checkpoints of the fit's intermediate data (-1: none)
    gbt_checkpoint_interval: int = 25

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)


REFERENCE = Params()
# --- end of the fixed values ---------------------------------------------------------------

# Values for the driver's TPC-H-shaped test tables (FIXTURES.md): a part has ~30 lines over all
# years, so the window is three years and the threshold 8 sale lines; the patterns hit p_type/p_name.
FIXTURE = Params(
    date_lo="1997-01-01",
    date_hi="2000-01-01",
    min_sale_lines=8,
    family_pattern="ring|gear|bolt",
    brand_pattern="PROMO| RING",
    report_brand_pattern="Ring",
)


def predictors(variant: str = "All") -> list[str]:
    """Predictor columns of a variant; unknown names raise instead of leaving state unset."""
    if variant not in PREDICTOR_SETS:
        raise ValueError(f"unknown predictor set {variant!r}; expected one of {sorted(PREDICTOR_SETS)}")
    return list(BASE_PREDICTORS) + list(PREDICTOR_SETS[variant])
