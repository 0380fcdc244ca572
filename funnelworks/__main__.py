"""Full rebuild from the command line (for ``spark-submit``).

    python -m funnelworks --raw DIR --out DIR [--no-checks] [--join-strategy split]
    spark-submit path/to/funnelworks/__main__.py --raw /shared/gtm/raw --out /shared/gtm/marts
    python -m funnelworks --raw-database gtm_case --database marts

For ``spark-submit`` the folder that holds ``funnelworks`` has to be on
``PYTHONPATH``.

Reads ``<raw>/leads``, ``<raw>/opportunities``, ``<raw>/expenses_advertising``
and ``<raw>/expenses_salary_and_commissions`` (Parquet by default), writes
every mart as a new version under ``<out>/<name>`` and, unless ``--no-checks``,
the data-test summary under ``<out>/data_quality_summary``, publishes them by
one commit and prints their folders and the failing tests.  Exit status 1 when a test fails and ``--fail-on-violations`` is given.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from funnelworks.plans.build import build_project
from funnelworks.plans.project import Models
from funnelworks.session import RECOMMENDED_CONF, ensure_checkpoint_dir
from funnelworks.sources.io import raw_sources_from_tables, read_raw_sources


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="funnelworks", description=__doc__.splitlines()[0])
    raw_from = ap.add_mutually_exclusive_group(required=True)
    raw_from.add_argument("--raw", help="folder holding the four raw tables")
    raw_from.add_argument("--raw-database", help="catalog database holding them")
    to = ap.add_mutually_exclusive_group(required=True)
    to.add_argument("--out", help="folder for the mart tables")
    to.add_argument("--database", help="catalog database for them")
    ap.add_argument("--format", default="parquet", help="format of the raw tables")
    ap.add_argument("--join-strategy", default="split", choices=["split", "salt", "plain"])
    ap.add_argument("--hot-key-rows", type=int, default=1_000_000,
                    help="leads per opportunity above which a join key is split (0 = never)")
    ap.add_argument("--no-checks", action="store_true", help="skip the 40 data tests")
    ap.add_argument("--fail-on-violations", action="store_true")
    args = ap.parse_args(argv)

    existing = SparkSession.getActiveSession()
    builder = SparkSession.builder.appName("funnelworks-build")
    for k, v in RECOMMENDED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)

    if args.raw_database:
        raw = raw_sources_from_tables(spark, args.raw_database)
    else:
        raw = read_raw_sources(spark, args.raw, args.format)
    models = Models(raw, join_strategy=args.join_strategy, hot_key_rows=args.hot_key_rows or None)
    paths = build_project(models, args.out, run_checks=not args.no_checks, database=args.database)
    for name, path in paths.items():
        print(f"{name}\t{path}")
    status = 0
    if not args.no_checks:
        summary = paths["data_quality_summary"]
        results = spark.table(summary) if args.database else spark.read.parquet(summary)
        failing = results.where("violations > 0").collect()
        for r in failing:
            print(f"FAIL\t{r.model}\t{r.test}\t{r.column_name}\t{r.violations}")
        status = 1 if (failing and args.fail_on_violations) else 0
    if existing is None:
        spark.stop()
    return status


if __name__ == "__main__":
    sys.exit(main())
