"""Named queries over the driver's test tables.

Every entry takes ``(spark, sf_dir)``, derives the four raw inputs from
``orders`` with Spark (:mod:`funnelworks.sources.fixtures`) and returns a lazy
DataFrame over the whole input.  Pipelines (P1-P16) come first, then
operator-level queries that exercise one building block each.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelworks import config
from funnelworks.functions.columns import (
    days_between_sql,
    fix_year_offset_sql,
    parse_currency_sql,
    parse_month_sql,
    predicted_sales_tier_sql,
    resolve_stage_sql,
    safe_div_sql,
    speed_to_lead_bucket_sql,
    stage_category_sql,
)
from funnelworks.operators import quality as Q
from funnelworks.operators.frames import share_within, unpivot
from funnelworks.plans import intermediate, quality_suite, staging
from funnelworks.plans.build import build_project
from funnelworks.plans.project import Models
from funnelworks.session import remove_at_end, scratch_path, stored
from funnelworks.sources.fixtures import RawSources, raw_sources_from_orders
from funnelworks.sources.io import (
    as_view,
    read_raw_sources,
    read_table,
    save_bucketed,
    write_raw_sources,
    write_table,
)
from funnelworks.sources.versions import Store

Query = Callable[[SparkSession, str], DataFrame]


def models(spark: SparkSession, sf_dir: str, join_strategy: str = "split", **kwargs) -> Models:
    return Models(raw_sources_from_orders(spark, sf_dir), join_strategy=join_strategy, **kwargs)


def _model(name: str) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return models(spark, sf_dir)[name]

    q.__name__ = name
    return q


# --- operator-level queries -------------------------------------------------


def dedupe_latest_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw opportunity row kept for each opportunity id."""
    return staging.dedupe_opportunities(models(spark, sf_dir).raw.opportunities)


def month_spine_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = models(spark, sf_dir)
    return intermediate.expense_month_spine(m.stg_expenses_advertising, m.stg_expenses_salary)


def unpivot_channels_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Salary table wide -> long: one row per month x team."""
    m = models(spark, sf_dir)
    return unpivot(
        m.stg_expenses_salary,
        keep=["expense_month"],
        label_col="channel",
        value_cols=["people_cost"],
        branches=[
            (config.INBOUND, ["inbound_team_cost"]),
            (config.OUTBOUND, ["outbound_team_cost"]),
        ],
    )


def _stage_counts(m: Models) -> DataFrame:
    return m.fct_lead_funnel.groupBy("lead_created_month", "channel", "current_funnel_stage").agg(
        F.expr("count(1) AS lead_count"),
        F.expr("count_if(is_converted) AS converted"),
        F.expr("count_if(demo_held) AS demos_held"),
    )


def share_within_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each funnel stage among the leads of a month x channel."""
    counts = _stage_counts(models(spark, sf_dir)).select(
        "lead_created_month", "channel", "current_funnel_stage", "lead_count"
    )
    return share_within(counts, "lead_count", ["lead_created_month", "channel"], "share_of_leads")


def safe_div_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demo rate per month x channel x stage; stages without opportunities give 0."""
    c = _stage_counts(models(spark, sf_dir))
    return c.selectExpr(
        "lead_created_month", "channel", "current_funnel_stage", "converted", "demos_held",
        f"{safe_div_sql('demos_held', 'converted')} AS demo_rate",
    )


def parse_currency_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct currency text of the three raw tables and its parsed value."""
    raw = models(spark, sf_dir).raw

    def texts(df: DataFrame, col: str) -> DataFrame:
        return df.selectExpr(f"'{col}' AS source_column", f"{col} AS raw_text")

    all_texts = (
        texts(raw.leads, "predicted_sales_with_owner")
        .unionByName(texts(raw.expenses_advertising, "advertising"))
        .unionByName(texts(raw.expenses_salary, "outbound_sales_team"))
        .unionByName(texts(raw.expenses_salary, "inbound_sales_team"))
    )
    return all_texts.groupBy("source_column", "raw_text").count().selectExpr(
        "source_column", "raw_text", "count AS n_rows", f"{parse_currency_sql('raw_text')} AS parsed_value"
    )


def fix_year_offset_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored-too-low date of the raw tables next to its corrected value."""
    raw = models(spark, sf_dir).raw

    def part(df: DataFrame, id_col: str, col: str) -> DataFrame:
        return df.where(f"{col} IS NOT NULL").selectExpr(
            f"'{col}' AS source_column", f"{id_col} AS record_id", f"{col} AS raw_date",
            f"{fix_year_offset_sql(col)} AS fixed_date",
        )

    return (
        part(raw.leads, "lead_id", "form_submission_date")
        .unionByName(part(raw.opportunities, "opportunity_id", "demo_set_date"))
        .unionByName(part(raw.opportunities, "opportunity_id", "close_date"))
    )


def parse_month_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = models(spark, sf_dir).raw
    months = raw.expenses_advertising.selectExpr("'expenses_advertising' AS source_table", "month AS raw_text")
    months = months.unionByName(
        raw.expenses_salary.selectExpr("'expenses_salary_and_commissions' AS source_table", "month AS raw_text")
    )
    return months.groupBy("source_table", "raw_text").count().selectExpr(
        "source_table", "raw_text", "count AS n_rows", f"{parse_month_sql('raw_text')} AS expense_month"
    )


def bucketize_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = models(spark, sf_dir).fct_lead_funnel
    return f.selectExpr(
        "lead_id", "channel", "days_lead_to_first_contact",
        f"{speed_to_lead_bucket_sql('days_lead_to_first_contact')} AS response_speed_bucket",
        "predicted_monthly_sales",
        f"{predicted_sales_tier_sql('predicted_monthly_sales')} AS predicted_sales_tier",
    )


def resolve_stage_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every raw opportunity row as if it were a lead's: whether the demo was
    held decides if the journey has the opportunity at all."""
    rows = models(spark, sf_dir).raw.opportunities.selectExpr(
        "opportunity_id AS record_id",
        f"CASE WHEN demo_held THEN {stage_category_sql('stage_name')} END AS category",
        "CASE WHEN demo_held THEN opportunity_id END AS opportunity",
        "demo_time AS meeting",
        "last_sales_call_date_time AS call",
    )
    stage = resolve_stage_sql("category", "opportunity", "meeting", "call")
    return rows.selectExpr("record_id", "category", "opportunity", "meeting", "call", f"{stage} AS funnel_stage")


def days_between_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day counts between raw dates and timestamps, in both directions."""
    pairs = {
        "form_to_call": ("form_submission_date", "first_sales_call_date"),
        "call_to_meeting": ("first_sales_call_date", "first_meeting_booked_date"),
        "meeting_to_text": ("first_meeting_booked_date", "first_text_sent_date"),
        "email_to_activity": ("last_sales_email_date", "last_sales_activity_date"),
    }
    return models(spark, sf_dir).raw.leads.selectExpr(
        "lead_id", *[f"{days_between_sql(start, end)} AS {name}" for name, (start, end) in pairs.items()]
    )


def lead_join_hot_keys_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lead journey with every repeated opportunity key treated as hot, so
    that the hot branch of the join takes rows."""
    return models(spark, sf_dir, hot_key_rows=1).int_lead_opportunity_joined


# --- data quality ----------------------------------------------------------------


def _checks(builder) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return quality_suite.union_checks(builder(models(spark, sf_dir)))

    return q


def _reconcile(builder) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return builder(models(spark, sf_dir))

    return q


def accepted_values_found_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted-values checks against lists that leave values out."""
    m = models(spark, sf_dir)
    return quality_suite.union_checks(
        [
            Q.accepted_values_check(m.stg_opportunities, "stg_opportunities", "stage_category", [config.CLOSED_WON]),
            Q.accepted_values_check(m.stg_leads, "stg_leads", "channel", [config.INBOUND]),
            Q.profile_checks(m.raw.opportunities, "opportunities", accepted={"stage_name": ["Closed Won"]}),
        ]
    )


def relationship_orphans_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw leads that point to an opportunity that does not exist."""
    m = models(spark, sf_dir)
    return Q.relationship_check(m.raw.leads, "leads", "converted_opportunity_id", m.stg_opportunities, "opportunity_id")


def relationship_orphans_filtered_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same check with a filter of the opportunities' keys, and of leads
    whose keys mostly name nothing."""
    m = models(spark, sf_dir)
    wrong = m.raw.leads.withColumn("converted_opportunity_id", F.expr("concat(converted_opportunity_id, right(lead_id, 1))"))
    checks = [
        Q.filtered_relationship_check(df, name, "converted_opportunity_id", m.stg_opportunities, "opportunity_id")
        for name, df in (("leads", m.raw.leads), ("leads_renamed", wrong))
    ]
    return quality_suite.union_checks(checks)


def unique_combination_found_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = models(spark, sf_dir)
    return quality_suite.union_checks(
        [
            Q.unique_combination_check(m.raw.opportunities, "opportunities", ["account_id", "stage_name"]),
            Q.unique_combination_check(m.int_monthly_expenses, "int_monthly_expenses", ["channel"]),
        ]
    )


def reconcile_found_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three reconciliations against a model that lacks the second half of every year."""
    m = models(spark, sf_dir)
    part = m.with_overrides(int_monthly_expenses=m.int_monthly_expenses.where("month(expense_month) <= 6"))
    checks = (quality_suite.reconcile_advertising, quality_suite.reconcile_inbound, quality_suite.reconcile_outbound)
    return quality_suite.union_checks([check(part) for check in checks])


def uniqueness_found_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four uniqueness checks of the raw opportunities in one shuffle."""
    return Q.uniqueness_checks(
        models(spark, sf_dir).raw.opportunities,
        "opportunities",
        unique=["opportunity_id", "account_id", "close_date"],
        combinations=[["account_id", "stage_name"], ["opportunity_id", "stage_name", "close_date"]],
    )


def checks_while_written_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks that find violations, counted while the rows are stored."""
    m, out = models(spark, sf_dir), []
    for name, df, not_null, accepted in [
        ("stg_leads", m.stg_leads, ["lead_id", "lead_created_date"], {"channel": [config.INBOUND]}),
        ("opportunities", m.raw.opportunities, ["opportunity_id", "close_date"], {"stage_name": ["Closed Won"]}),
        ("stg_opportunities", m.stg_opportunities, ["opportunity_id"], {"stage_category": list(config.STAGE_CATEGORIES)}),
    ]:
        profile = Q.observed_profile(df, name, not_null, accepted)
        out.append(profile.summary(stored(profile.df, name)))
    return quality_suite.union_checks(out)


# --- sources and sinks -----------------------------------------------------------


def source_scan_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw opportunities, written as files and read with their declared schema."""
    path = scratch_path(spark, "raw")
    remove_at_end(spark, path)
    write_raw_sources(models(spark, sf_dir).raw, path)
    return read_raw_sources(spark, path).opportunities


def view_sink_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads and their first calls per channel, from the staging model's view by name."""
    as_view(models(spark, sf_dir).stg_leads, "stg_leads")
    return spark.sql(
        "SELECT channel, count(1) AS leads, count(first_sales_call_date) AS called FROM stg_leads GROUP BY channel"
    )


def table_sink_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mart's table as a reader finds it after a build of half the months,
    a rebuild of all, and one that stopped before its commit."""
    mart = models(spark, sf_dir).fct_funnel_stage_conversion
    path = scratch_path(spark, "published")
    remove_at_end(spark, path)
    write_table(mart.where("month(lead_created_month) <= 6"), path)
    write_table(mart, path)
    Store(spark, path).begin().write(mart.limit(1))
    return read_table(spark, path)


def _over_rollup(name: str) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = models(spark, sf_dir)
        return m.with_overrides(funnel_rollup=stored(m.funnel_rollup, "rollup")).over_rollup()[name]

    return q


def built_quality_summary_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data tests as a whole build stores them beside its marts."""
    path = scratch_path(spark, "build")
    remove_at_end(spark, path)
    build_project(models(spark, sf_dir), path)
    return read_table(spark, f"{path}/data_quality_summary")


def bucketed_join_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lead journey over opportunities stored bucketed by the join key."""
    m, path = models(spark, sf_dir), scratch_path(spark, "bucketed")
    remove_at_end(spark, path)
    table = save_bucketed(m.raw.opportunities, f"opportunities_{uuid.uuid4().hex[:12]}", "opportunity_id", 8, path)
    raw = RawSources(m.raw.leads, table, m.raw.expenses_advertising, m.raw.expenses_salary)
    return Models(raw).int_lead_opportunity_joined


def data_quality_summary_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 40 tests.  The lead journey feeds a dozen of them (directly and
    through every mart), so it is stored once in the shared folder instead of
    computed once per check; that job runs when the query is built."""
    m, done = models(spark, sf_dir), {}
    name = "int_lead_opportunity_joined"
    journey = quality_suite.written(name, m[name], lambda df: stored(df, "journey"), done)
    return quality_suite.run_checks(m.with_overrides(int_lead_opportunity_joined=journey), done)


MODEL_QUERIES = [
    "stg_leads",
    "stg_opportunities",
    "stg_expenses_advertising",
    "stg_expenses_salary",
    "int_lead_opportunity_joined",
    "int_monthly_expenses",
    "fct_lead_funnel",
    "fct_account_ltv",
    "fct_channel_economics",
    "fct_funnel_stage_conversion",
    "fct_loss_reason_analysis",
    "fct_activity_efficiency",
    "fct_unit_economics",
    "speed_to_lead",
    "predicted_sales_tier",
]

QUERIES: dict[str, Query] = {
    **{name: _model(name) for name in MODEL_QUERIES},
    "data_quality_summary": data_quality_summary_q,
    "dedupe_latest": dedupe_latest_q,
    "month_spine": month_spine_q,
    "unpivot_channels": unpivot_channels_q,
    "share_within": share_within_q,
    "parse_currency": parse_currency_q,
    "fix_year_offset": fix_year_offset_q,
    "parse_month": parse_month_q,
    "safe_div": safe_div_q,
    "bucketize": bucketize_q,
    "resolve_stage": resolve_stage_q,
    "days_between": days_between_q,
    "lead_join_hot_keys": lead_join_hot_keys_q,
    "accepted_values_found": accepted_values_found_q,
    "relationship_orphans": relationship_orphans_q,
    "relationship_orphans_filtered": relationship_orphans_filtered_q,
    "unique_combination_found": unique_combination_found_q,
    "reconcile_found": reconcile_found_q,
    "uniqueness_found": uniqueness_found_q,
    "checks_while_written": checks_while_written_q,
    "source_scan": source_scan_q,
    "view_sink": view_sink_q,
    "table_sink": table_sink_q,
    "rollup_channel_economics": _over_rollup("fct_channel_economics"),
    "rollup_stage_conversion": _over_rollup("fct_funnel_stage_conversion"),
    "rollup_loss_reasons": _over_rollup("fct_loss_reason_analysis"),
    "rollup_activity_efficiency": _over_rollup("fct_activity_efficiency"),
    "built_quality_summary": built_quality_summary_q,
    "bucketed_join": bucketed_join_q,
    "unique_violations": _checks(quality_suite.unique_checks),
    "not_null_violations": _checks(quality_suite.not_null_checks),
    "accepted_values_violations": _checks(quality_suite.accepted_values_checks),
    "relationship_violations": _checks(quality_suite.relationship_checks),
    "unique_combination_violations": _checks(quality_suite.unique_combination_checks),
    "reconcile_advertising": _reconcile(quality_suite.reconcile_advertising),
    "reconcile_inbound": _reconcile(quality_suite.reconcile_inbound),
    "reconcile_outbound": _reconcile(quality_suite.reconcile_outbound),
}
