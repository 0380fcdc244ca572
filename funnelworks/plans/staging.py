"""Staging models: type, clean and dedupe the four raw inputs (P1-P4).

Each function is a narrow transformation (no shuffle) except the
opportunity dedupe, which shuffles once on ``opportunity_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from funnelworks import config
from funnelworks.config import DEFAULT, Assumptions
from funnelworks.functions.columns import (
    days_between_sql,
    fix_year_offset_sql,
    parse_currency_sql,
    parse_month_sql,
    stage_category_sql,
)
from funnelworks.operators.frames import dedupe_latest


def stg_leads(leads: DataFrame, a: Assumptions = DEFAULT) -> DataFrame:
    """One row per lead with channel, unified contact/created dates,
    activity total and parsed predicted sales."""
    form_fixed = fix_year_offset_sql("form_submission_date", a.year_offset)
    call = "CAST(first_sales_call_date AS DATE)"
    text = "CAST(first_text_sent_date AS DATE)"
    money = parse_currency_sql("predicted_sales_with_owner", a.currency_precision, a.currency_scale)
    return leads.selectExpr(
        "lead_id",
        "converted_opportunity_id",
        f"CASE WHEN form_submission_date IS NOT NULL THEN '{config.INBOUND}' ELSE '{config.OUTBOUND}' END AS channel",
        f"{form_fixed} AS form_submission_date",
        f"{call} AS first_sales_call_date",
        f"{text} AS first_text_sent_date",
        # a call wins over a text even when the text came first
        f"coalesce({call}, {text}) AS first_contact_date",
        "CAST(first_meeting_booked_date AS DATE) AS first_meeting_booked_date",
        f"coalesce({form_fixed}, {call}, {text}) AS lead_created_date",
        "last_sales_call_date",
        "last_sales_activity_date",
        "last_sales_email_date",
        "sales_call_count",
        "sales_text_count",
        "sales_email_count",
        "coalesce(sales_call_count, 0) + coalesce(sales_text_count, 0) + coalesce(sales_email_count, 0)"
        " AS total_activity_count",
        f"{money} AS predicted_monthly_sales",
        "marketplaces_used",
        "online_ordering_used",
        "cuisine_types",
        "location_count",
        "connected_with_decision_maker",
        "status",
        "converted_opportunity_id IS NOT NULL AS is_converted",
    )


# Raw columns after the ordering column, in schema order: the deterministic
# tiebreak when two rows of one opportunity share the same created timestamp.
_OPP_TIEBREAK = [
    "account_id",
    "stage_name",
    "lost_reason_c",
    "closed_lost_notes_c",
    "business_issue_c",
    "how_did_you_hear_about_us_c",
    "demo_held",
    "demo_set_date",
    "demo_time",
    "close_date",
    "last_sales_call_date_time",
]


def dedupe_opportunities(opportunities: DataFrame) -> DataFrame:
    """Latest raw row per ``opportunity_id``.

    Ordered by the raw ``created_date`` timestamp descending with NULLs
    first (the reference dialect's default for DESC), then the remaining raw
    columns.
    """
    return dedupe_latest(
        opportunities,
        "opportunity_id",
        ["created_date DESC NULLS FIRST"],
        tiebreak=_OPP_TIEBREAK,
    )


def stg_opportunities(opportunities: DataFrame, a: Assumptions = DEFAULT) -> DataFrame:
    """One row per opportunity with stage category, fixed dates and velocity."""
    o = dedupe_opportunities(opportunities)
    demo_set = fix_year_offset_sql("demo_set_date", a.year_offset)
    close = fix_year_offset_sql("close_date", a.year_offset)
    demo_date = "CAST(demo_time AS DATE)"
    created = "CAST(created_date AS DATE)"
    return o.selectExpr(
        "opportunity_id",
        "account_id",
        "stage_name",
        f"{stage_category_sql('stage_name')} AS stage_category",
        "lost_reason_c AS lost_reason",
        "closed_lost_notes_c AS closed_lost_notes",
        "business_issue_c AS business_issue",
        "how_did_you_hear_about_us_c AS attribution_source",
        "demo_held",
        f"{demo_set} AS demo_set_date",
        "demo_time",
        f"{demo_date} AS demo_date",
        f"{created} AS created_date",
        f"{close} AS close_date",
        "last_sales_call_date_time",
        "CAST(last_sales_call_date_time AS DATE) AS last_sales_call_date",
        f"{days_between_sql(created, close)} AS days_to_close",
        f"{days_between_sql(demo_set, demo_date)} AS days_demo_set_to_held",
    )


def stg_expenses_advertising(expenses_advertising: DataFrame, a: Assumptions = DEFAULT) -> DataFrame:
    return expenses_advertising.selectExpr(
        f"{parse_month_sql('month')} AS expense_month",
        f"{parse_currency_sql('advertising', a.currency_precision, a.currency_scale)} AS advertising_spend",
    )


def stg_expenses_salary(expenses_salary: DataFrame, a: Assumptions = DEFAULT) -> DataFrame:
    p, s = a.currency_precision, a.currency_scale
    return expenses_salary.selectExpr(
        f"{parse_month_sql('month')} AS expense_month",
        f"{parse_currency_sql('outbound_sales_team', p, s)} AS outbound_team_cost",
        f"{parse_currency_sql('inbound_sales_team', p, s)} AS inbound_team_cost",
    )
