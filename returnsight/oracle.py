"""ANSI SQL twins of the Spark queries, for the DuckDB oracle.

Each statement starts from the raw test tables (``lineitem``, ``orders``, ``part``) through the
same fixture mapping as ``returnsight.sources``; CTEs chain the stages so every query can be
read on its own. Float outputs are rounded to 6 decimals on both sides (summation order differs
between engines in the last bits); integer outputs are cast to BIGINT / INTEGER to match Spark.
"""

from __future__ import annotations

from returnsight.config import Params


def _re(p: str) -> str:
    return p.replace("'", "''")


def base_ctes(p: Params) -> str:
    """``lines``: the windowed lines with 0/1 flags; ``parts``: the dimension's derived columns;
    ``per_part``: counts and sums of a part's lines; ``features``: their ratios."""
    return f"""
lines AS (
  SELECT l_partkey AS sku_key, l_quantity AS quantity,
         l_extendedprice / l_quantity AS plu_amt,
         l_extendedprice * l_discount AS tran_discount_amt,
         l_extendedprice * l_tax AS override_amt,
         l_extendedprice * (1 - l_discount) AS extended_amt,
         CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS INTEGER) AS ecom,
         CAST(l_returnflag <> 'R' AS INTEGER) AS sale,
         CAST(l_returnflag = 'R' AS INTEGER) AS ret,
         CASE WHEN l_tax <> 0 THEN CAST(l_linestatus = 'F' AS INTEGER) END AS receipted
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  WHERE o_orderdate BETWEEN TIMESTAMP '{p.date_lo}' AND TIMESTAMP '{p.date_hi}' - INTERVAL 1 MICROSECOND
),
parts AS (
  SELECT p_partkey AS sku_key, concat(p_type, ' ', p_name) AS product_desc, p_retailprice * 0.6 AS sku_cost,
         split_part(p_name, ' ', 1) AS sku_color,
         CASE WHEN p_size % 10 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END AS sku_size
  FROM part
),
per_part AS (
  SELECT sku_key, count(*) AS n_lines, count(*) FILTER (WHERE ret = 1) AS n_returns, count(*) FILTER (WHERE sale = 1) AS n_sales,
         sum(quantity) FILTER (WHERE sale = 1) AS units,
         sum(plu_amt) FILTER (WHERE sale = 1) AS price_total, count(plu_amt) FILTER (WHERE sale = 1) AS n_prices,
         count(*) FILTER (WHERE sale = 1 AND ecom = 1) AS n_online,
         count(*) FILTER (WHERE ret = 1 AND receipted = 1) AS n_with_receipt,
         count(*) FILTER (WHERE ret = 1 AND receipted IS NOT NULL) AS n_receipt_known
  FROM lines GROUP BY sku_key
),
features AS (
  SELECT sku_key, n_returns / CAST(n_lines AS DOUBLE) AS return_rate, product_desc, sku_color, sku_size, sku_cost,
         price_total / nullif(n_prices, 0) AS avg_price_product, units AS quantity,
         n_online / nullif(CAST(n_sales AS DOUBLE), 0) AS ecom_rate,
         n_with_receipt / nullif(CAST(n_receipt_known AS DOUBLE), 0) AS receipted_rate
  FROM per_part JOIN parts USING (sku_key)
  WHERE n_sales > {p.min_sale_lines}
)"""


def line_table_sql(p: Params) -> str:
    return with_ctes(
        p,
        "",
        """
SELECT sku_key, quantity, plu_amt, tran_discount_amt, override_amt, extended_amt,
       ecom, sale, ret AS "return", receipted, product_desc, sku_cost, sku_color, sku_size
FROM lines JOIN parts USING (sku_key)""",
    )


def with_ctes(p: Params, extra: str, body: str) -> str:
    ctes = base_ctes(p)
    if extra.strip():
        ctes += ",\n" + extra.strip()
    return f"WITH {ctes}\n{body.strip()}"


def active_skus_sql(p: Params) -> str:
    return with_ctes(
        p, "", f"SELECT sku_key, n_sales AS sale_lines FROM per_part JOIN parts USING (sku_key) WHERE n_sales > {p.min_sale_lines}"
    )


# --- preparation chain -------------------------------------------------------------------------

def _place(key: str, salt: int) -> str:
    """0-based rank of a key's hash."""
    return f"(row_number() OVER (ORDER BY md5(CAST({key} AS VARCHAR) || '|{salt}'), {key}) - 1)"


def is_test_sql(p: Params) -> str:
    return f"{_place('sku_key', p.split_seed)} < ceil(count(*) OVER () * {p.test_fraction})"


def fold_sql(p: Params) -> str:
    return f"CAST({_place('sku_key', p.fold_seed)} % {p.n_folds} AS INTEGER)"


def _icontains(col: str, pattern: str) -> str:
    return f"COALESCE(regexp_matches({col}, '{_re(pattern)}', 'i'), false)"


def prep_ctes(p: Params) -> str:
    """lab -> enc (codes + flags) -> logged -> q (IQR bounds) -> filtered -> cleaned."""
    iqr_col = p.iqr_columns[0]
    k = p.iqr_factor
    return f"""
lab AS (
  SELECT f.*, CAST(COALESCE(f.return_rate > (SELECT median(return_rate) FROM features), false) AS INTEGER) AS label
  FROM features f
),
size_codes AS (
  SELECT sku_size, CAST(dense_rank() OVER (ORDER BY sku_size NULLS LAST) - 1 AS INTEGER) AS code
  FROM (SELECT DISTINCT sku_size FROM lab) d
),
color_codes AS (
  SELECT sku_color, CAST(dense_rank() OVER (ORDER BY sku_color NULLS LAST) - 1 AS INTEGER) AS code
  FROM (SELECT DISTINCT sku_color FROM lab) d
),
enc AS (
  SELECT l.sku_key, l.return_rate, l.product_desc, cc.code AS sku_color, sc.code AS sku_size, l.sku_cost,
         l.avg_price_product, l.quantity, l.ecom_rate, l.receipted_rate, l.label,
         CAST({_icontains('l.product_desc', p.family_pattern)} AS INTEGER) AS footwear,
         CAST({_icontains('l.product_desc', p.brand_pattern)} AS INTEGER) AS brand
  FROM lab l
  LEFT JOIN size_codes sc ON l.sku_size IS NOT DISTINCT FROM sc.sku_size
  LEFT JOIN color_codes cc ON l.sku_color IS NOT DISTINCT FROM cc.sku_color
),
logged AS (
  SELECT * REPLACE (
    CASE WHEN quantity > 0 THEN ln(quantity) END AS quantity,
    CASE WHEN avg_price_product > 0 THEN ln(avg_price_product) END AS avg_price_product)
  FROM enc
),
q_ranked AS (
  SELECT {iqr_col} AS v, row_number() OVER (ORDER BY {iqr_col}) - 1 AS pos, count(*) OVER () AS n
  FROM logged WHERE {iqr_col} IS NOT NULL
),
q AS (
  SELECT CASE WHEN (SELECT count(*) FROM logged WHERE {iqr_col} IS NULL) > 0 THEN NULL ELSE
           (max(v) FILTER (WHERE pos = floor((n - 1) * 0.25)) + max(v) FILTER (WHERE pos = ceil((n - 1) * 0.25))) / 2 END AS q1,
         CASE WHEN (SELECT count(*) FROM logged WHERE {iqr_col} IS NULL) > 0 THEN NULL ELSE
           (max(v) FILTER (WHERE pos = floor((n - 1) * 0.75)) + max(v) FILTER (WHERE pos = ceil((n - 1) * 0.75))) / 2 END AS q3
  FROM q_ranked
),
bounds AS (SELECT q1 - {k} * (q3 - q1) AS lb, q3 + {k} * (q3 - q1) AS ub FROM q),
filtered AS (
  SELECT l.* FROM logged l, bounds b
  WHERE b.lb IS NULL OR b.ub IS NULL OR (
    NOT COALESCE(l.{iqr_col} >= b.ub, false)
    AND (b.ub <= b.lb OR NOT COALESCE(l.{iqr_col} <= b.lb, false)))
),
cleaned AS (
  SELECT * REPLACE (COALESCE(receipted_rate, (SELECT avg(receipted_rate) FROM filtered)) AS receipted_rate)
  FROM filtered
),
scored AS (
  SELECT sku_key, label, ecom_rate AS score, CAST(ecom_rate > 0.5 AS INTEGER) AS prediction,
         {is_test_sql(p)} AS is_test
  FROM lab
)"""


def prep_sql(p: Params, body: str) -> str:
    return with_ctes(p, prep_ctes(p), body)


def _r(c: str, alias: str | None = None) -> str:
    return f"round({c}, 6) AS {alias or c}"


def describe_sql(p: Params, cols: list[str]) -> str:
    parts = []
    for c in cols:
        v = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"""SELECT '{c}' AS column_name, CAST(count({c}) AS BIGINT) AS count, {_r(f'avg({v})', 'mean')},
       {_r(f'stddev_samp({v})', 'std')}, {_r(f'min({v})', 'min')},
       {_r(f'quantile_cont({v}, 0.25)', 'p25')}, {_r(f'quantile_cont({v}, 0.5)', 'p50')},
       {_r(f'quantile_cont({v}, 0.75)', 'p75')}, {_r(f'max({v})', 'max')}
FROM enc"""
        )
    return prep_sql(p, "\nUNION ALL\n".join(parts))


def correlation_sql(p: Params, cols: list[str]) -> str:
    parts = []
    for a in cols:
        for b in cols:
            x, y = sorted([a, b], key=cols.index)
            parts.append(
                f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, "
                f"round(corr(CAST({x} AS DOUBLE), CAST({y} AS DOUBLE)), 6) AS corr FROM enc"
            )
    return prep_sql(p, "\nUNION ALL\n".join(parts))


def box_stats_sql(p: Params, cols: list[str]) -> str:
    parts = []
    for c in cols:
        parts.append(
            f"""SELECT '{c}' AS column_name, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
       round((SELECT min(v) FROM long_{c} WHERE v >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_lo,
       round((SELECT max(v) FROM long_{c} WHERE v <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_hi,
       (SELECT count(*) FROM long_{c} WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.75) AS q3 FROM long_{c}) s"""
        )
    extra = prep_ctes(p) + ",\n" + ",\n".join(
        f"long_{c} AS (SELECT CAST({c} AS DOUBLE) AS v FROM logged WHERE {c} IS NOT NULL)" for c in cols
    )
    return with_ctes(p, extra, "\nUNION ALL\n".join(parts))


def midpoint_quartiles_sql(p: Params, cols: list[str]) -> str:
    k = p.iqr_factor
    ranked = ",\n".join(
        f"""mq_{c} AS (
  SELECT '{c}' AS column_name,
         (SELECT count(*) FROM logged WHERE {c} IS NULL) AS n_missing,
         (max(v) FILTER (WHERE pos = floor((n - 1) * 0.25)) + max(v) FILTER (WHERE pos = ceil((n - 1) * 0.25))) / 2 AS q1,
         (max(v) FILTER (WHERE pos = floor((n - 1) * 0.75)) + max(v) FILTER (WHERE pos = ceil((n - 1) * 0.75))) / 2 AS q3
  FROM (SELECT CAST({c} AS DOUBLE) AS v, row_number() OVER (ORDER BY {c}) - 1 AS pos, count(*) OVER () AS n
        FROM logged WHERE {c} IS NOT NULL) r
)"""
        for c in cols
    )
    body = "\nUNION ALL\n".join(
        f"""SELECT column_name,
       round(CASE WHEN n_missing > 0 THEN NULL ELSE q1 END, 6) AS q1,
       round(CASE WHEN n_missing > 0 THEN NULL ELSE q3 END, 6) AS q3,
       round(CASE WHEN n_missing > 0 THEN NULL ELSE q1 - {k} * (q3 - q1) END, 6) AS lower_bound,
       round(CASE WHEN n_missing > 0 THEN NULL ELSE q3 + {k} * (q3 - q1) END, 6) AS upper_bound
FROM mq_{c}"""
        for c in cols
    )
    return with_ctes(p, prep_ctes(p) + ",\n" + ranked, body)


def category_order_sql(p: Params, cols: list[str], smoothing: float = 10.0) -> str:
    """Categories of the training rows by smoothed label mean."""
    k = f"CAST({smoothing} AS DOUBLE)"
    extra = prep_ctes(p) + f""",
training AS (SELECT * FROM (SELECT *, {is_test_sql(p)} AS is_test FROM cleaned) s WHERE NOT is_test),
codes AS (
{" UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS code, label FROM training" for c in cols)}
),
held AS (
  SELECT column_name, code, count(*) AS n, sum(label) AS positives,
         sum(sum(label)) OVER (PARTITION BY column_name) / CAST(sum(count(*)) OVER (PARTITION BY column_name) AS DOUBLE) AS overall
  FROM codes GROUP BY column_name, code
),
smoothed AS (SELECT *, (positives + {k} * overall) / (n + {k}) AS label_mean FROM held)"""
    return with_ctes(p, extra, """
SELECT column_name, code, n, round(label_mean, 6) AS label_mean,
       CAST(row_number() OVER (PARTITION BY column_name ORDER BY smoothed.label_mean, code NULLS LAST) - 1 AS INTEGER) AS place,
       CAST(count(*) FILTER (WHERE smoothed.label_mean < overall) OVER (PARTITION BY column_name) - 0.5 AS DOUBLE) AS unseen
FROM smoothed""")


def explanation_sql(p: Params, weights: dict[str, float], intercept: float, rows: tuple[int, ...]) -> dict[str, str]:
    """Twins of the explanations of a fixed linear model and of two fixed trees."""
    split = prep_ctes(p) + f""",
framed AS (SELECT *, {is_test_sql(p)} AS is_test, row_number() OVER (ORDER BY sku_key) - 1 AS place FROM cleaned),
means AS (SELECT {", ".join(f"avg({c}) AS {c}" for c in weights)} FROM framed WHERE NOT is_test),
base AS (SELECT {intercept} + {" + ".join(f"{w} * {c}" for c, w in weights.items())} AS base_value FROM means),
linear AS (
{" UNION ALL ".join(f"SELECT sku_key, place, '{c}' AS feature, CAST(f.{c} AS DOUBLE) AS value, {w} * (f.{c} - m.{c}) AS phi FROM framed f, means m" for c, w in weights.items())}
)"""
    shown = "sku_key, feature, round(value, 6) AS value"
    picked = ", ".join(map(str, rows))
    # one tree over two features: v(S) for S none, a, b, both; a feature's value is the mean of its two
    # steps. Numbers are written as 6e-1, which is a DOUBLE; 0.6 would be a DECIMAL.
    trees = split + """,
sides AS (
  SELECT sku_key, ecom_rate, quantity, avg_price_product,
         CASE WHEN COALESCE(ecom_rate <= 0.5, false) THEN 1e0 ELSE 0e0 END AS a, CASE WHEN COALESCE(quantity <= 5, false) THEN 1e0 ELSE -5e-1 END AS b,
         CASE WHEN COALESCE(avg_price_product <= 7.2, false) THEN 7e-1 ELSE -3e-1 END AS c
  FROM framed
),
worth AS (
  SELECT *, 6e-1 * (5e-1 * 1e0 + 5e-1 * -5e-1) + 4e-1 * 25e-2 AS v0, a * (5e-1 * 1e0 + 5e-1 * -5e-1) + (1 - a) * 25e-2 AS va,
         6e-1 * b + 4e-1 * 25e-2 AS vb, a * b + (1 - a) * 25e-2 AS vab, 4e-1 * 7e-1 + 6e-1 * -3e-1 AS w0
  FROM sides
)"""
    # against the training rows: the features outside S are theirs, averaged
    apart = trees + """,
held AS (SELECT avg(s.a) AS a, avg(s.b) AS b, avg(s.c) AS c, avg(s.a * s.b + (1 - s.a) * 25e-2) AS v0 FROM sides s JOIN framed f USING (sku_key) WHERE NOT f.is_test),
steps AS (
  SELECT s.sku_key, s.ecom_rate, s.quantity, s.avg_price_product, s.c, h.c AS w0, h.v0, s.a * h.b + (1 - s.a) * 25e-2 AS va,
         h.a * s.b + (1 - h.a) * 25e-2 AS vb, s.a * s.b + (1 - s.a) * 25e-2 AS vab
  FROM sides s, held h
)"""
    tree_rows = (
        ("ecom_rate", "((va - v0) + (vab - vb)) / 2"), ("quantity", "((vb - v0) + (vab - va)) / 2"), ("avg_price_product", "5e-1 * (c - w0)"),
    )
    return {
        "linear_explanation": with_ctes(p, split, f"SELECT {shown}, round(phi, 6) AS phi, round(base_value, 6) AS base_value FROM linear, base"),
        "linear_explanation_global": with_ctes(p, split, "SELECT feature, round(avg(abs(phi)), 6) AS mean_abs_phi FROM linear GROUP BY feature"),
        "linear_explanation_class0": with_ctes(p, split, f"SELECT {shown}, round(-phi, 6) AS phi FROM linear"),
        "linear_explanation_rows": with_ctes(p, split, f"""
SELECT {shown}, round(phi, 6) AS phi,
       round(base_value + sum(phi) OVER (PARTITION BY sku_key ORDER BY abs(phi) DESC, feature), 6) AS cumulative,
       CAST(row_number() OVER (PARTITION BY sku_key ORDER BY abs(phi) DESC, feature) AS INTEGER) AS rank
FROM linear, base WHERE place IN ({picked})"""),
        **{name: with_ctes(p, ctes, " UNION ALL ".join(
            f"SELECT sku_key, '{c}' AS feature, round({c}, 6) AS value, round({phi}, 6) AS phi, round(v0 + 5e-1 * w0, 6) AS base_value FROM {rows}" for c, phi in tree_rows
        )) for name, ctes, rows in (("tree_explanation", trees, "worth"), ("tree_explanation_background", apart, "steps"))},
    }
