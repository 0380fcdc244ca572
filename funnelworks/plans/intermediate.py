"""Intermediate models: the lead journey and monthly expenses (P5, P6)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from funnelworks import config
from funnelworks.config import DEFAULT, Assumptions
from funnelworks.functions.columns import days_between_sql, estimated_ltv_sql, resolve_stage_sql
from funnelworks.operators.frames import HOT_KEY_ROWS, left_join_sparse_key, month_spine, unpivot

# (source column, output name) in output order
_LEAD_COLUMNS = [
    "lead_id",
    "channel",
    "lead_created_date",
    "form_submission_date",
    "first_contact_date",
    "first_sales_call_date",
    "first_text_sent_date",
    "first_meeting_booked_date",
    ("last_sales_call_date", "lead_last_sales_call_date"),
    "last_sales_activity_date",
    "last_sales_email_date",
    "sales_call_count",
    "sales_text_count",
    "sales_email_count",
    "total_activity_count",
    "predicted_monthly_sales",
    "marketplaces_used",
    "online_ordering_used",
    "cuisine_types",
    "location_count",
    "connected_with_decision_maker",
    ("status", "lead_status"),
    "is_converted",
]

_OPPORTUNITY_COLUMNS = [
    "opportunity_id",
    "account_id",
    "stage_name",
    "stage_category",
    "lost_reason",
    "closed_lost_notes",
    "business_issue",
    "attribution_source",
    "demo_held",
    "demo_set_date",
    "demo_time",
    "demo_date",
    ("created_date", "opportunity_created_date"),
    "close_date",
    "days_to_close",
    "days_demo_set_to_held",
]


def _pairs(spec) -> list[tuple[str, str]]:
    return [c if isinstance(c, tuple) else (c, c) for c in spec]


def lead_opportunity_joined(
    stg_leads: DataFrame,
    stg_opportunities: DataFrame,
    a: Assumptions = DEFAULT,
    join_strategy: str = "split",
    hot_key_rows: int | None = HOT_KEY_ROWS,
) -> DataFrame:
    """One row per lead: the lead, its (deduped) opportunity if any, the
    current funnel stage, seven velocity measures and the 24-month LTV of won
    deals.

    The join key is null for every unconverted lead (most of them), so the
    join uses :func:`left_join_sparse_key` to keep those rows out of the
    shuffle; leads of an opportunity referenced more than ``hot_key_rows``
    times join a broadcast of that opportunity instead of being shuffled
    (``None`` turns that off).  The opportunity side is unique per key after
    the dedupe, and the cold join reuses the dedupe's partitioning.
    """
    lead_src = list(dict.fromkeys([s for s, _ in _pairs(_LEAD_COLUMNS)] + ["converted_opportunity_id"]))
    leads = stg_leads.selectExpr(*[f"{c} AS l_{c}" for c in lead_src])
    opps = stg_opportunities.selectExpr(*[f"{s} AS o_{s}" for s, _ in _pairs(_OPPORTUNITY_COLUMNS)])
    j = left_join_sparse_key(
        leads, opps, "l_converted_opportunity_id", "o_opportunity_id",
        strategy=join_strategy, salt_col="l_lead_id", hot_key_rows=hot_key_rows, right_unique=True,
    )
    stage = resolve_stage_sql(
        "o_stage_category", "o_opportunity_id", "l_first_meeting_booked_date", "l_first_sales_call_date"
    )
    velocity = {
        "days_lead_to_first_contact": ("l_lead_created_date", "l_first_contact_date"),
        "days_contact_to_meeting": ("l_first_contact_date", "l_first_meeting_booked_date"),
        "days_meeting_booked_to_demo_set": ("l_first_meeting_booked_date", "o_demo_set_date"),
        "days_demo_held_to_close": ("o_demo_date", "o_close_date"),
        "days_lead_to_opportunity": ("l_lead_created_date", "o_created_date"),
        "days_last_activity_to_close": ("l_last_sales_activity_date", "o_close_date"),
        "days_lead_to_close": ("l_lead_created_date", "o_close_date"),
    }
    return j.selectExpr(
        *[f"l_{s} AS {d}" for s, d in _pairs(_LEAD_COLUMNS)],
        *[f"o_{s} AS {d}" for s, d in _pairs(_OPPORTUNITY_COLUMNS)],
        f"{stage} AS current_funnel_stage",
        *[f"{days_between_sql(start, end)} AS {name}" for name, (start, end) in velocity.items()],
        f"CASE WHEN o_stage_category = '{config.CLOSED_WON}' THEN {estimated_ltv_sql('l_predicted_monthly_sales', a)}"
        " END AS estimated_ltv_24mo",
    )


def expense_month_spine(stg_expenses_advertising: DataFrame, stg_expenses_salary: DataFrame) -> DataFrame:
    """Every month between the first and last expense month of either table."""
    months = stg_expenses_advertising.select("expense_month").unionByName(
        stg_expenses_salary.select("expense_month")
    )
    return month_spine(months, "expense_month")


def monthly_expenses(
    stg_expenses_advertising: DataFrame,
    stg_expenses_salary: DataFrame,
    a: Assumptions = DEFAULT,
) -> DataFrame:
    """One row per month x channel on a gap-free month spine.

    inbound: total = advertising + inbound team; outbound: total = outbound
    team, advertising 0.  The spine holds one row per calendar month between
    the bounds, but the expense tables are raw inputs with no proven size
    bound (duplicate months fan out exactly as in the reference and are
    reported by the uniqueness check), so no broadcast is forced: adaptive
    execution measures both sides after the first stage and broadcasts only
    what is actually small.
    """
    spine = expense_month_spine(stg_expenses_advertising, stg_expenses_salary)
    money = a.currency_type
    zero = f"CAST(0 AS {money})"
    prep = (
        spine.join(stg_expenses_advertising, "expense_month", "left")
        .join(stg_expenses_salary, "expense_month", "left")
        .selectExpr(
            "expense_month",
            f"coalesce(advertising_spend, {zero}) AS ad",
            f"coalesce(inbound_team_cost, {zero}) AS inbound_people",
            f"coalesce(outbound_team_cost, {zero}) AS outbound_people",
        )
    )
    long = unpivot(
        prep,
        keep=["expense_month"],
        label_col="channel",
        value_cols=["total_cost", "advertising_cost", "people_cost"],
        branches=[
            (config.INBOUND, ["ad + inbound_people", "ad", "inbound_people"]),
            (config.OUTBOUND, ["outbound_people", zero, "outbound_people"]),
        ],
    )
    return long.selectExpr(
        "expense_month",
        "channel",
        f"CAST(total_cost AS {money}) AS total_cost",
        f"CAST(advertising_cost AS {money}) AS advertising_cost",
        f"CAST(people_cost AS {money}) AS people_cost",
    )
