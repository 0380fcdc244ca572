"""DuckDB oracle: one SQL string per registered query.

Each string is self-contained: it derives the raw inputs from the
pre-registered ``orders`` view (``fixture.FIXTURE_CTES``), builds the models
with the reference's semantics in DuckDB dialect (``models.MODEL_CTES``) and
ends with the query's own SELECT.  DuckDB inlines only the CTEs a query uses.
"""

from __future__ import annotations

from oracle.fixture import FIXTURE_CTES
from oracle.models import (
    MODEL_CTES,
    PREDICTED_SALES_TIER,
    SPEED_TO_LEAD,
    avg,
    cnt_if,
    div0,
    parse_currency,
    parse_month,
    year_fix,
)

PRELUDE = "WITH" + FIXTURE_CTES + "," + MODEL_CTES + "\n"

CHANNELS = "('inbound', 'outbound')"
STAGE_CATEGORIES = "('closed_won', 'closed_lost', 'open')"
FUNNEL_STAGES = "('new_lead', 'contacted', 'meeting_booked', 'opportunity_open', 'closed_won', 'closed_lost')"


def _row(model: str, test: str, column: str, body: str) -> str:
    return (
        f"SELECT '{model}' AS model, '{test}' AS test, '{column}' AS column_name, "
        f"CAST(count(*) AS BIGINT) AS violations FROM {body}"
    )


def unique_sql(rel: str, model: str, col: str) -> str:
    return _row(model, "unique", col, f"(SELECT {col} FROM {rel} WHERE {col} IS NOT NULL GROUP BY {col} HAVING count(*) > 1)")


def not_null_sql(rel: str, model: str, col: str) -> str:
    return _row(model, "not_null", col, f"{rel} WHERE {col} IS NULL")


def accepted_sql(rel: str, model: str, col: str, values: str) -> str:
    return _row(model, "accepted_values", col, f"(SELECT {col} FROM {rel} WHERE {col} NOT IN {values} GROUP BY {col})")


RELATIONSHIP = _row(
    "int_lead_opportunity_joined", "relationships", "opportunity_id",
    "int_lead_opportunity_joined c LEFT JOIN stg_opportunities p ON c.opportunity_id = p.opportunity_id "
    "WHERE c.opportunity_id IS NOT NULL AND p.opportunity_id IS NULL",
)

UNIQUE_COMBINATION = _row(
    "int_monthly_expenses", "unique_combination_of_columns", "expense_month,channel",
    "(SELECT expense_month, channel FROM int_monthly_expenses GROUP BY 1, 2 HAVING count(*) > 1)",
)


def reconcile_sql(name: str, src_rel: str, src_col: str, model_col: str, channel: str | None) -> str:
    where = f" WHERE channel = '{channel}'" if channel else ""
    return f"""
SELECT '{name}' AS check_name, s.total AS source_total, m.total AS model_total,
       CAST(abs(s.total - m.total) AS DECIMAL(38,2)) AS difference,
       CAST(CASE WHEN abs(s.total - m.total) > 0.01 THEN 1 ELSE 0 END AS BIGINT) AS violations
FROM (SELECT CAST(coalesce(sum({src_col}), 0) AS DECIMAL(38,2)) AS total FROM {src_rel}) s,
     (SELECT CAST(coalesce(sum({model_col}), 0) AS DECIMAL(38,2)) AS total FROM int_monthly_expenses{where}) m"""


RECONCILE = {
    "reconcile_advertising": reconcile_sql(
        "assert_advertising_spend_matches_source", "stg_expenses_advertising", "advertising_spend",
        "advertising_cost", None,
    ),
    "reconcile_inbound": reconcile_sql(
        "assert_inbound_salary_matches_source", "stg_expenses_salary", "inbound_team_cost", "people_cost", "inbound"
    ),
    "reconcile_outbound": reconcile_sql(
        "assert_outbound_salary_matches_source", "stg_expenses_salary", "outbound_team_cost", "people_cost",
        "outbound",
    ),
}

RECONCILE_COLUMN = {
    "reconcile_advertising": "advertising_cost",
    "reconcile_inbound": "people_cost",
    "reconcile_outbound": "people_cost",
}


def reconcile_row(key: str) -> str:
    return (
        f"SELECT 'int_monthly_expenses' AS model, check_name AS test, '{RECONCILE_COLUMN[key]}' AS column_name, "
        f"violations FROM ({RECONCILE[key]})"
    )


UNIQUE = [
    unique_sql("raw_leads", "leads", "lead_id"),
    unique_sql("raw_opportunities", "opportunities", "opportunity_id"),
    unique_sql("stg_leads", "stg_leads", "lead_id"),
    unique_sql("stg_opportunities", "stg_opportunities", "opportunity_id"),
    unique_sql("int_lead_opportunity_joined", "int_lead_opportunity_joined", "lead_id"),
    unique_sql("fct_lead_funnel", "fct_lead_funnel", "lead_id"),
]

NOT_NULL = [
    not_null_sql("raw_leads", "leads", "lead_id"),
    not_null_sql("raw_leads", "leads", "form_submission_date"),
    not_null_sql("raw_opportunities", "opportunities", "opportunity_id"),
    not_null_sql("stg_leads", "stg_leads", "lead_id"),
    not_null_sql("stg_leads", "stg_leads", "lead_created_date"),
    not_null_sql("stg_opportunities", "stg_opportunities", "opportunity_id"),
    not_null_sql("stg_expenses_advertising", "stg_expenses_advertising", "expense_month"),
    not_null_sql("stg_expenses_salary", "stg_expenses_salary", "expense_month"),
    not_null_sql("int_lead_opportunity_joined", "int_lead_opportunity_joined", "lead_id"),
    *[not_null_sql("int_monthly_expenses", "int_monthly_expenses", c)
      for c in ["expense_month", "channel", "total_cost", "advertising_cost", "people_cost"]],
    not_null_sql("fct_lead_funnel", "fct_lead_funnel", "lead_id"),
    not_null_sql("fct_account_ltv", "fct_account_ltv", "account_id"),
    not_null_sql("fct_channel_economics", "fct_channel_economics", "lead_created_month"),
    not_null_sql("fct_funnel_stage_conversion", "fct_funnel_stage_conversion", "lead_created_month"),
    not_null_sql("fct_unit_economics", "fct_unit_economics", "lead_created_month"),
]

ACCEPTED = [
    accepted_sql("stg_leads", "stg_leads", "channel", CHANNELS),
    accepted_sql("stg_opportunities", "stg_opportunities", "stage_category", STAGE_CATEGORIES),
    accepted_sql("int_lead_opportunity_joined", "int_lead_opportunity_joined", "channel", CHANNELS),
    accepted_sql("int_monthly_expenses", "int_monthly_expenses", "channel", CHANNELS),
    accepted_sql("fct_lead_funnel", "fct_lead_funnel", "channel", CHANNELS),
    accepted_sql("fct_lead_funnel", "fct_lead_funnel", "current_funnel_stage", FUNNEL_STAGES),
    accepted_sql("fct_account_ltv", "fct_account_ltv", "channel", CHANNELS),
    accepted_sql("fct_channel_economics", "fct_channel_economics", "channel", CHANNELS),
    accepted_sql("fct_funnel_stage_conversion", "fct_funnel_stage_conversion", "channel", CHANNELS),
    accepted_sql("fct_unit_economics", "fct_unit_economics", "channel", CHANNELS),
]


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


FINAL = {
    "stg_leads": "SELECT * FROM stg_leads",
    "stg_opportunities": "SELECT * FROM stg_opportunities",
    "stg_expenses_advertising": "SELECT * FROM stg_expenses_advertising",
    "stg_expenses_salary": "SELECT * FROM stg_expenses_salary",
    "int_lead_opportunity_joined": "SELECT * FROM int_lead_opportunity_joined",
    "int_monthly_expenses": "SELECT * FROM int_monthly_expenses",
    "fct_lead_funnel": "SELECT * FROM fct_lead_funnel",
    "fct_account_ltv": "SELECT * FROM fct_account_ltv",
    "fct_channel_economics": "SELECT * FROM fct_channel_economics",
    "fct_funnel_stage_conversion": "SELECT * FROM fct_funnel_stage_conversion",
    "fct_loss_reason_analysis": "SELECT * FROM fct_loss_reason_analysis",
    "fct_activity_efficiency": "SELECT * FROM fct_activity_efficiency",
    "fct_unit_economics": "SELECT * FROM fct_unit_economics",
    "speed_to_lead": SPEED_TO_LEAD,
    "predicted_sales_tier": PREDICTED_SALES_TIER,
    "data_quality_summary": _union(
        UNIQUE + NOT_NULL + ACCEPTED + [RELATIONSHIP, UNIQUE_COMBINATION] + [reconcile_row(k) for k in RECONCILE]
    ),
    "dedupe_latest": "SELECT * FROM opp_dedup",
    "month_spine": "SELECT expense_month FROM exp_spine",
    "unpivot_channels": """
SELECT expense_month, 'inbound' AS channel, inbound_team_cost AS people_cost FROM stg_expenses_salary
UNION ALL
SELECT expense_month, 'outbound' AS channel, outbound_team_cost AS people_cost FROM stg_expenses_salary""",
    "share_within": """
SELECT lead_created_month, channel, current_funnel_stage, count(*) AS lead_count,
       CAST(count(*) AS DOUBLE)
         / CAST(nullif(sum(count(*)) OVER (PARTITION BY lead_created_month, channel), 0) AS DOUBLE) AS share_of_leads
FROM fct_lead_funnel GROUP BY 1, 2, 3""",
    "safe_div": f"""
SELECT lead_created_month, channel, current_funnel_stage,
       {cnt_if('is_converted')} AS converted, {cnt_if('demo_held')} AS demos_held,
       {div0(cnt_if('demo_held'), cnt_if('is_converted'))} AS demo_rate
FROM fct_lead_funnel GROUP BY 1, 2, 3""",
    "parse_currency": f"""
SELECT source_column, raw_text, count(*) AS n_rows, {parse_currency('raw_text')} AS parsed_value
FROM (
    SELECT 'predicted_sales_with_owner' AS source_column, predicted_sales_with_owner AS raw_text FROM raw_leads
    UNION ALL SELECT 'advertising', advertising FROM raw_expenses_advertising
    UNION ALL SELECT 'outbound_sales_team', outbound_sales_team FROM raw_expenses_salary
    UNION ALL SELECT 'inbound_sales_team', inbound_sales_team FROM raw_expenses_salary
) GROUP BY 1, 2""",
    "fix_year_offset": f"""
SELECT 'form_submission_date' AS source_column, lead_id AS record_id, form_submission_date AS raw_date,
       {year_fix('form_submission_date')} AS fixed_date
FROM raw_leads WHERE form_submission_date IS NOT NULL
UNION ALL
SELECT 'demo_set_date', opportunity_id, demo_set_date, {year_fix('demo_set_date')}
FROM raw_opportunities WHERE demo_set_date IS NOT NULL
UNION ALL
SELECT 'close_date', opportunity_id, close_date, {year_fix('close_date')}
FROM raw_opportunities WHERE close_date IS NOT NULL""",
    "parse_month": f"""
SELECT source_table, raw_text, count(*) AS n_rows, {parse_month('raw_text')} AS expense_month
FROM (
    SELECT 'expenses_advertising' AS source_table, month AS raw_text FROM raw_expenses_advertising
    UNION ALL SELECT 'expenses_salary_and_commissions', month FROM raw_expenses_salary
) GROUP BY 1, 2""",
    "bucketize": """
SELECT lead_id, channel, days_lead_to_first_contact,
       CASE WHEN days_lead_to_first_contact <= 0 THEN 'same_day'
            WHEN days_lead_to_first_contact = 1 THEN 'next_day'
            WHEN days_lead_to_first_contact BETWEEN 2 AND 7 THEN '2_to_7_days'
            ELSE '8_plus_days' END AS response_speed_bucket,
       predicted_monthly_sales,
       CASE WHEN predicted_monthly_sales IS NULL THEN 'unknown'
            WHEN predicted_monthly_sales < 5000 THEN 'tier_1_under_5k'
            WHEN predicted_monthly_sales < 15000 THEN 'tier_2_5k_to_15k'
            WHEN predicted_monthly_sales < 30000 THEN 'tier_3_15k_to_30k'
            ELSE 'tier_4_30k_plus' END AS predicted_sales_tier
FROM fct_lead_funnel""",
    "resolve_stage": """
SELECT opportunity_id AS record_id, kind AS category, opp AS opportunity, demo_time AS meeting,
       last_sales_call_date_time AS call,
       coalesce(nullif(kind, 'open'), CASE WHEN opp IS NOT NULL THEN 'opportunity_open' END,
                if(demo_time IS NULL, NULL, 'meeting_booked'), if(last_sales_call_date_time IS NULL, 'new_lead', 'contacted'))
           AS funnel_stage
FROM (SELECT *, if(demo_held, opportunity_id, NULL) AS opp,
             CASE WHEN NOT coalesce(demo_held, false) THEN NULL
                  WHEN contains(lower(stage_name), 'closed won') THEN 'closed_won'
                  WHEN contains(lower(stage_name), 'closed lost') THEN 'closed_lost' ELSE 'open' END AS kind
      FROM raw_opportunities)""",
    "days_between": """
SELECT lead_id,
       CAST(CAST(first_sales_call_date AS DATE) - form_submission_date AS INTEGER) AS form_to_call,
       CAST(CAST(first_meeting_booked_date AS DATE) - CAST(first_sales_call_date AS DATE) AS INTEGER) AS call_to_meeting,
       CAST(CAST(first_text_sent_date AS DATE) - CAST(first_meeting_booked_date AS DATE) AS INTEGER) AS meeting_to_text,
       CAST(CAST(last_sales_activity_date AS DATE) - CAST(last_sales_email_date AS DATE) AS INTEGER) AS email_to_activity
FROM raw_leads""",
    "lead_join_hot_keys": "SELECT * FROM int_lead_opportunity_joined",
    "accepted_values_found": _union(
        [
            accepted_sql("stg_opportunities", "stg_opportunities", "stage_category", "('closed_won')"),
            accepted_sql("stg_leads", "stg_leads", "channel", "('inbound')"),
            accepted_sql("raw_opportunities", "opportunities", "stage_name", "('Closed Won')"),
        ]
    ),
    "relationship_orphans": _row(
        "leads", "relationships", "converted_opportunity_id",
        "raw_leads WHERE converted_opportunity_id NOT IN (SELECT opportunity_id FROM raw_opportunities)",
    ),
    "relationship_orphans_filtered": _union(
        [
            _row("leads", "relationships", "converted_opportunity_id",
                 "raw_leads WHERE converted_opportunity_id NOT IN (SELECT opportunity_id FROM raw_opportunities)"),
            _row("leads_renamed", "relationships", "converted_opportunity_id",
                 "(SELECT converted_opportunity_id || right(lead_id, 1) AS k FROM raw_leads) "
                 "WHERE k NOT IN (SELECT opportunity_id FROM raw_opportunities)"),
        ]
    ),
    "unique_combination_found": _union(
        [
            _row("opportunities", "unique_combination_of_columns", "account_id,stage_name",
                 "(FROM (SELECT DISTINCT account_id, stage_name, count(*) OVER (PARTITION BY account_id, stage_name) AS n "
                 "FROM raw_opportunities) WHERE n > 1)"),
            _row("int_monthly_expenses", "unique_combination_of_columns", "channel",
                 "(SELECT channel FROM int_monthly_expenses GROUP BY 1 HAVING count(*) > 1)"),
        ]
    ),
    "uniqueness_found": _union(
        [
            unique_sql("raw_opportunities", "opportunities", "opportunity_id"),
            unique_sql("raw_opportunities", "opportunities", "account_id"),
            unique_sql("raw_opportunities", "opportunities", "close_date"),
            _row("opportunities", "unique_combination_of_columns", "account_id,stage_name",
                 "(FROM raw_opportunities SELECT account_id, stage_name GROUP BY ALL HAVING count(*) > 1)"),
            _row("opportunities", "unique_combination_of_columns", "opportunity_id,stage_name,close_date",
                 "(FROM raw_opportunities SELECT opportunity_id, stage_name, close_date GROUP BY ALL HAVING count(*) > 1)"),
        ]
    ),
    "checks_while_written": _union(
        [
            not_null_sql("stg_leads", "stg_leads", "lead_id"),
            not_null_sql("stg_leads", "stg_leads", "lead_created_date"),
            accepted_sql("stg_leads", "stg_leads", "channel", "('inbound')"),
            not_null_sql("raw_opportunities", "opportunities", "opportunity_id"),
            not_null_sql("raw_opportunities", "opportunities", "close_date"),
            accepted_sql("raw_opportunities", "opportunities", "stage_name", "('Closed Won')"),
            not_null_sql("stg_opportunities", "stg_opportunities", "opportunity_id"),
            accepted_sql("stg_opportunities", "stg_opportunities", "stage_category", STAGE_CATEGORIES),
        ]
    ),
    "source_scan": "SELECT * FROM raw_opportunities",
    "view_sink": "SELECT channel, count(*) AS leads, count(first_sales_call_date) AS called FROM stg_leads GROUP BY channel",
    "table_sink": "SELECT * FROM fct_funnel_stage_conversion",
    "rollup_channel_economics": "SELECT * FROM fct_channel_economics",
    "rollup_stage_conversion": "SELECT * FROM fct_funnel_stage_conversion",
    "rollup_loss_reasons": "SELECT * FROM fct_loss_reason_analysis",
    "rollup_activity_efficiency": "SELECT * FROM fct_activity_efficiency",
    "bucketed_join": "SELECT * FROM int_lead_opportunity_joined",
    "reconcile_found": _union(
        [
            f"SELECT * FROM ({sql.replace('FROM int_monthly_expenses', 'FROM (FROM int_monthly_expenses WHERE month(expense_month) <= 6)')})"
            for sql in RECONCILE.values()
        ]
    ),
    "unique_violations": _union(UNIQUE),
    "not_null_violations": _union(NOT_NULL),
    "accepted_values_violations": _union(ACCEPTED),
    "relationship_violations": RELATIONSHIP,
    "unique_combination_violations": UNIQUE_COMBINATION,
    **RECONCILE,
}

FINAL["built_quality_summary"] = FINAL["data_quality_summary"]

ORACLE_SQL: dict[str, str] = {k: PRELUDE + v for k, v in FINAL.items()}

__all__ = ["ORACLE_SQL", "PRELUDE", "FINAL", "avg"]
