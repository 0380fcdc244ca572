"""Build the whole project: views for staging and intermediate models, tables
for marts (full rebuild), then optionally the data tests.

The lead journey (the main join) feeds the funnel and a dozen data tests, so it
is stored once for the build.  The lead funnel feeds six other marts and both
analyses: it is written once.  The account-LTV mart reads it, and one rollup of
it feeds the four marts by month and channel, so it is scanned twice in all.
A lost executor later re-runs only the small mart stages from the stored files,
not the join and dedupe.  ``fct_unit_economics`` reads the stored
channel-economics and account-LTV tables.

The not_null and accepted_values tests of every table written are counted while
it is written, so they scan no table again.

All tables of a build are published by one commit when they are whole
(:mod:`funnelworks.sources.versions`).

Tables are written unpartitioned (partitioning by month would make each write
task emit a file per month); the funnel is range-clustered by month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from funnelworks.plans.project import INTERMEDIATE, MARTS, STAGING, Models
from funnelworks.plans import quality_suite
from funnelworks.session import discard, scratch_path, stored
from funnelworks.sources.io import as_view, show_table
from funnelworks.sources.versions import Pending, Store


def register_views(m: Models) -> None:
    """Staging and intermediate models as temporary views (lazy)."""
    for name in STAGING + INTERMEDIATE:
        as_view(m[name], name)


def build_project(
    m: Models, out_dir: str | None = None, run_checks: bool = True, database: str | None = None
) -> dict[str, str]:
    """Write every mart as a new version under ``out_dir/<name>`` and publish
    them together, by one commit, when all are written; return name -> folder
    of the new version.  ``read_table(spark, f"{out_dir}/<name>")`` reads the
    current version.  A build that fails or stops publishes nothing.

    With ``database`` the marts are catalog names ``<database>.<name>``
    instead, switched one after the other at the end, and the names are
    returned.  Without either the tables go to a per-run folder under the
    shared ``spark.checkpoint.dir``.

    With ``run_checks`` the 40 data tests run against the new tables before
    they are published, and their summary is stored as
    ``data_quality_summary`` beside them.
    """
    spark = m.raw.leads.sparkSession
    if database is not None:
        out_dir = f"{spark.catalog.getDatabase(database).locationUri.rstrip('/')}/marts.versions"
    out_dir = out_dir or scratch_path(spark, "build")
    register_views(m)
    summaries: dict[str, DataFrame] = {}
    joined = "int_lead_opportunity_joined"
    journey = quality_suite.written(joined, m[joined], lambda df: stored(df, "journey"), summaries)
    rollup = None
    try:
        with Store(spark, out_dir).begin() as pending:
            based = m.with_overrides(int_lead_opportunity_joined=journey)
            built: dict[str, DataFrame] = {}

            def write(name: str, df: DataFrame) -> None:
                save = lambda df: spark.read.parquet(pending.write(df, name))
                built[name] = quality_suite.written(name, df, save, summaries)

            # clustered by month, so that a query over some months reads some files; the id splits a large month
            funnel = based.fct_lead_funnel.repartitionByRange("lead_created_month", "lead_id")
            write("fct_lead_funnel", funnel)
            based = based.with_overrides(**built)
            rollup = stored(based.funnel_rollup, "rollup")
            based = based.with_overrides(funnel_rollup=rollup).over_rollup()
            for name in MARTS[1:]:  # the last, unit economics, reads two of the others
                write(name, based[name])
                based = based.with_overrides(**built)
            if run_checks:
                write("data_quality_summary", quality_suite.run_checks(based, summaries))
            places = {name: pending.path(name) for name in built}
            if database is not None:
                places = {name: show_table(spark, f"{database}.{name}", path) for name, path in places.items()}
    finally:
        discard(journey)
        if rollup is not None:
            discard(rollup)
    return places
