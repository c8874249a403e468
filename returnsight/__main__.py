"""Command line: run the whole analysis and write its tables.

    python -m returnsight --sf-dir /root/testdata/sf0.01 --out /shared/returns --model GBT
    python -m returnsight --detail /lake/std_clnt_detail --sku /lake/std_clnt_sku \\
        --reference-params --out /shared/returns

    python -m returnsight --sql-schema retail --reference-params

    python -m returnsight --detail /lake/std_clnt_detail --append-days /lake/daily --window 2021-06-01 2021-06-02
    python -m returnsight --daily /lake/daily --sku /lake/std_clnt_sku --window 2020-06-02 2021-06-02 --out /shared/returns

``--sql-schema`` runs the feature build as SQL statements against the reference's table names in
that schema (``std_clnt_detail``, ``std_clnt_sku`` -> ``parameters_for_analysis_cln`` and the
report table ``plot_1``) and stops there; with ``--publish-root`` both names are views, switched to a
new version under that folder once it is complete. ``--append-days`` writes the daily sums of the
window's lines and stops there; ``--daily`` runs the analysis from such sums. ``--sf-dir`` maps the TPC-H-shaped test tables (and uses the test-table parameters unless
``--reference-params``); ``--detail`` / ``--sku`` read production tables with the reference's
column names (``--format table`` for catalog tables).
"""

from __future__ import annotations

import argparse
import json

from returnsight.config import FIXTURE, REFERENCE
from returnsight.plans.run import run
from returnsight.session import get_session, size_shuffles
from returnsight.sources import Source


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="returnsight", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--sf-dir", help="folder of the TPC-H-shaped test tables")
    src.add_argument("--detail", help="transaction-line table (path or catalog name)")
    src.add_argument("--daily", help="folder of daily sums instead of the lines (needs --sku)")
    src.add_argument("--sql-schema", help="catalog schema holding the reference's tables (SQL feature build)")
    ap.add_argument("--sku", help="SKU dimension table (path or catalog name)")
    ap.add_argument("--format", default="parquet", help="input format, 'table' for catalog tables or 'jdbc'")
    ap.add_argument("--url", help="database address (with --format jdbc)")
    ap.add_argument("--partition", nargs=4, metavar=("COLUMN", "LOW", "HIGH", "N"), help="read the lines as N range queries (with --format jdbc)")
    ap.add_argument("--append-days", metavar="FOLDER", help="write the window's daily sums to this folder and stop")
    ap.add_argument("--publish-root", metavar="FOLDER", help="with --sql-schema: keep versions here and switch views")
    ap.add_argument("--out", help="output folder (shared storage on a cluster)")
    ap.add_argument("--model", default="GBT", choices=["GBT", "RF", "LR"])
    ap.add_argument("--predictors", default="All", choices=["All", "Footwear", "Brand"])
    ap.add_argument("--reference-params", action="store_true", help="use the reference's production window and threshold")
    ap.add_argument("--window", nargs=2, metavar=("FROM", "TO"), help="date window [FROM, TO) of the lines")
    ap.add_argument("--min-sale-lines", type=int, help="keep SKUs with more sale lines than this")
    ap.add_argument("--no-cv", action="store_true", help="skip the 3 x k-fold cross-validation")
    ap.add_argument("--only", nargs="*", help="write only these tables")
    ap.add_argument("--master", default=None, help="Spark master (default: from the environment)")
    a = ap.parse_args(argv)
    if (a.daily or a.detail and not a.append_days) and not a.sku:
        ap.error(f"--{'daily' if a.daily else 'detail'} needs --sku")
    if a.append_days and not (a.detail or a.sf_dir):
        ap.error("--append-days reads the lines of --detail or --sf-dir")
    if not (a.sql_schema or a.append_days or a.out):
        ap.error("--out is required")
    params = REFERENCE if (a.reference_params or a.detail or a.daily or a.sql_schema) else FIXTURE
    params = params.with_(predictor_set=a.predictors)
    if a.window:
        params = params.with_(date_lo=a.window[0], date_hi=a.window[1])
    if a.min_sale_lines is not None:
        params = params.with_(min_sale_lines=a.min_sale_lines)
    if a.sql_schema:
        from returnsight.plans import sql_build as S

        spark = get_session(a.master)
        tables = S.reference_tables(a.sql_schema)
        size_shuffles(spark, spark.table(tables["detail_table"]))
        if a.publish_root:
            S.publish_tables(spark, params, a.publish_root, **tables)
        else:
            S.build_feature_table(spark, params, **tables)
            S.build_report_table(spark, **tables)
        print(json.dumps({"tables": [tables["feature_table"], tables["report_table"]]}))
        return
    source = Source(sf_dir=a.sf_dir) if a.sf_dir else Source(
        detail=a.detail, sku=a.sku or a.detail, fmt=a.format, url=a.url, daily=a.daily,
        partition=(a.partition[0], *map(int, a.partition[1:])) if a.partition else None,
    )
    spark = get_session(a.master)
    if a.append_days:
        from returnsight.plans.daily import append_days

        append_days(spark, source.lines(spark), a.append_days, params)
        print(json.dumps({"daily": a.append_days, "window": [params.date_lo, params.date_hi]}))
        return
    written = run(spark, source, params, a.out, a.model, cross_validate=not a.no_cv, only=a.only)
    print(json.dumps({"out": a.out, "tables": written}))


if __name__ == "__main__":
    main()
