"""Mart models (P7-P13).

Shape of every aggregation here: a partial hash aggregate in each map task,
then a shuffle of at most one row per group per task.  The groups are
month x channel (x stage or reason), a few hundred keys whatever the data
volume, so the shuffles stay tiny and no key can skew a reducer; the account
rollup has many keys but also combines map-side first, so a hot account costs
one row per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelworks import config
from funnelworks.config import DEFAULT, Assumptions
from funnelworks.functions.columns import (
    named_aggs,
    estimated_monthly_revenue_sql,
    exact_avg_sql,
    guarded_div_sql,
    hash_with_texts_sql,
    month_start_sql,
    safe_div_sql,
    subscription_revenue_sql,
    transaction_revenue_sql,
)
from funnelworks.functions.measures import FROM_ROWS, Measures, Rollup
from funnelworks.operators.frames import share_within


def _avgs(spec: dict[str, str]) -> dict[str, str]:
    """{output name: column} -> {output name: exact average expression}."""
    return {name: exact_avg_sql(col) for name, col in spec.items()}


VELOCITY = {
    "days_lead_to_first_contact": "days_lead_to_first_contact",
    "days_contact_to_meeting": "days_contact_to_meeting",
    "days_meeting_to_demo_set": "days_meeting_booked_to_demo_set",
    "days_demo_set_to_held": "days_demo_set_to_held",
    "days_demo_held_to_close": "days_demo_held_to_close",
    "days_lead_to_opportunity": "days_lead_to_opportunity",
    "days_opp_to_close": "days_to_close",
    "days_lead_to_close": "days_lead_to_close",
    "days_last_activity_to_close": "days_last_activity_to_close",
}


def _velocity_avgs(
    q: Measures, rename: dict[str, str] | None = None, drop: tuple[str, ...] = ()
) -> dict[str, str]:
    rename = rename or {}
    return {
        "avg_" + rename.get(k, k): q.mean(col) for k, col in VELOCITY.items() if k not in drop
    }


_FUNNEL_PASSTHROUGH_1 = [
    "lead_id", "opportunity_id", "account_id", "channel", "lead_status", "current_funnel_stage",
    "stage_name AS opportunity_stage_name", "stage_category AS opportunity_stage_category",
    "lost_reason", "closed_lost_notes", "business_issue", "attribution_source", "cuisine_types",
]
_FUNNEL_PASSTHROUGH_2 = [
    "marketplaces_used", "online_ordering_used", "location_count", "connected_with_decision_maker",
    "is_converted", "demo_held",
]
_FUNNEL_DATES = [
    "form_submission_date", "first_sales_call_date", "first_text_sent_date", "first_meeting_booked_date",
    "first_contact_date", "demo_set_date", "demo_time", "demo_date", "opportunity_created_date", "close_date",
    "last_sales_activity_date", "lead_created_date",
]
_FUNNEL_MEASURES = [
    "sales_call_count", "sales_text_count", "sales_email_count", "total_activity_count",
    "days_lead_to_first_contact", "days_contact_to_meeting", "days_meeting_booked_to_demo_set",
    "days_demo_set_to_held", "days_demo_held_to_close", "days_lead_to_opportunity", "days_to_close",
    "days_lead_to_close", "days_last_activity_to_close", "predicted_monthly_sales",
]


def lead_funnel(journey: DataFrame, a: Assumptions = DEFAULT) -> DataFrame:
    """One row per lead with a known created month (the core fact, P7)."""
    month = month_start_sql("lead_created_date")
    return journey.where(f"{month} IS NOT NULL").selectExpr(
        *_FUNNEL_PASSTHROUGH_1,
        # string length of the list text, not a number of cuisines (as in the reference)
        "length(cuisine_types) AS cuisine_count",
        *_FUNNEL_PASSTHROUGH_2,
        f"current_funnel_stage = '{config.CLOSED_WON}' AS is_closed_won",
        f"current_funnel_stage = '{config.CLOSED_LOST}' AS is_closed_lost",
        *_FUNNEL_DATES,
        f"{month} AS lead_created_month",
        *_FUNNEL_MEASURES,
        f"{transaction_revenue_sql('predicted_monthly_sales', a)} AS predicted_monthly_transaction_revenue",
        f"{subscription_revenue_sql(a)} AS monthly_subscription_revenue",
        f"{estimated_monthly_revenue_sql('predicted_monthly_sales', a)} AS predicted_monthly_total_revenue",
        "estimated_ltv_24mo",
    )


_LTV_AVERAGES = {
    "avg_predicted_monthly_sales": "predicted_monthly_sales",
    "avg_monthly_transaction_revenue": "predicted_monthly_transaction_revenue",
    "avg_monthly_subscription_revenue": "monthly_subscription_revenue",
    "avg_monthly_total_revenue": "predicted_monthly_total_revenue",
    "avg_days_lead_to_close": "days_lead_to_close",
    "avg_days_demo_held_to_close": "days_demo_held_to_close",
}


def account_ltv(funnel: DataFrame) -> DataFrame:
    """Won deals rolled up per account x channel (P8): one shuffle, rows of an
    account combined by hashing in the tasks that read them."""
    won = funnel.where("is_closed_won AND lead_created_date IS NOT NULL AND account_id IS NOT NULL")
    average = _avgs(_LTV_AVERAGES)
    names = list(_LTV_AVERAGES)
    return won.groupBy("account_id", "channel").agg(
        *named_aggs(
            {
                "total_won_deals": f"count(1) + {hash_with_texts_sql()}",
                **{name: average[name] for name in names[:4]},
                "total_monthly_revenue": "sum(predicted_monthly_total_revenue)",
                "total_estimated_ltv_24mo": "sum(estimated_ltv_24mo)",
                "location_count": "max(location_count)",
                "cuisine_types": "max(cuisine_types)",
                "cuisine_count": "max(length(cuisine_types))",
                "marketplaces_used": "max(marketplaces_used)",
                "online_ordering_used": "max(online_ordering_used)",
                "first_lead_created_date": "min(lead_created_date)",
                "first_close_date": "min(close_date)",
                "latest_close_date": "max(close_date)",
                **{name: average[name] for name in names[4:]},
            }
        )
    )


def _outcomes(q: Measures) -> dict[str, str]:
    return {
        "total_leads": q.rows(),
        "converted_leads": q.where("is_converted"),
        "demos_held": q.where("demo_held"),
        "closed_won_deals": q.where("is_closed_won"),
        "closed_lost_deals": q.where("is_closed_lost"),
        **_velocity_avgs(q, rename={"days_lead_to_first_contact": "days_to_first_contact"}),
        "avg_activities_per_lead": q.mean("total_activity_count"),
        "avg_activities_per_won_deal": q.mean("CASE WHEN is_closed_won THEN total_activity_count END"),
    }


def channel_economics(
    funnel: DataFrame, expenses: DataFrame, a: Assumptions = DEFAULT, q: Measures = FROM_ROWS
) -> DataFrame:
    """Volume, cost, conversion, CAC and velocity per created month x channel (P9).

    Cost is looked up for the *lead-created* month.  Months without cost are
    dropped, which also makes the left join an inner join (Catalyst rewrites
    it).  Both join inputs are aggregates of a few hundred rows; AQE sees
    their measured size and broadcasts at run time.

    ``funnel``: the lead funnel, or its rollup with ``q`` the rollup's measures
    (so for the marts below).
    """
    outcomes = funnel.groupBy("lead_created_month", "channel").agg(*named_aggs(_outcomes(q)))
    e = expenses.selectExpr(
        "expense_month", "channel AS e_channel", "total_cost AS e_total_cost",
        "advertising_cost AS e_advertising_cost", "people_cost AS e_people_cost",
    )
    zero = f"CAST(0 AS {a.currency_type})"
    joined = outcomes.join(
        e, (outcomes["lead_created_month"] == e["expense_month"]) & (outcomes["channel"] == e["e_channel"]), "left"
    ).where(f"lead_created_month IS NOT NULL AND coalesce(e_total_cost, {zero}) > 0")
    total_cost = f"coalesce(e_total_cost, {zero})"
    velocity = [f"avg_{v}" for v in ["days_to_first_contact"] + list(VELOCITY)[1:]]
    return joined.selectExpr(
        "lead_created_month",
        "channel",
        "total_leads",
        "converted_leads",
        "demos_held",
        "closed_won_deals",
        "closed_lost_deals",
        f"{total_cost} AS total_cost",
        f"coalesce(e_advertising_cost, {zero}) AS advertising_cost",
        f"coalesce(e_people_cost, {zero}) AS people_cost",
        f"{safe_div_sql('converted_leads', 'total_leads')} AS lead_to_opportunity_rate",
        f"{safe_div_sql('demos_held', 'converted_leads')} AS opportunity_to_demo_rate",
        f"{safe_div_sql('closed_won_deals', 'demos_held')} AS demo_to_close_rate",
        f"{safe_div_sql('closed_won_deals', 'total_leads')} AS lead_to_close_rate",
        f"{guarded_div_sql(total_cost, 'closed_won_deals', 'closed_won_deals > 0')} AS cac",
        *velocity,
        "avg_activities_per_lead",
        "avg_activities_per_won_deal",
    )


def _conversion(q: Measures) -> dict[str, str]:
    contacted = q.where("first_contact_date IS NOT NULL")
    meetings = q.where("first_meeting_booked_date IS NOT NULL")
    converted = q.where("is_converted")
    demos = q.where("demo_held")
    won = q.where("is_closed_won")
    dm = q.where("connected_with_decision_maker")
    total = q.rows()
    converted_after_meeting = q.where("is_converted AND first_meeting_booked_date IS NOT NULL")
    return {
        "total_leads": total,
        "contacted": contacted,
        "connected_dm": dm,
        "meetings_booked": meetings,
        "opportunities_created": converted,
        "demos_held": demos,
        "closed_won": won,
        "closed_lost": q.where("is_closed_lost"),
        "rate_lead_to_contact": safe_div_sql(contacted, total),
        # not limited to contacted leads: can exceed 1 (as in the reference)
        "rate_contact_to_dm": safe_div_sql(dm, contacted),
        "rate_contact_to_meeting": safe_div_sql(meetings, contacted),
        "rate_meeting_to_opportunity": safe_div_sql(converted_after_meeting, meetings),
        "rate_opportunity_to_demo": safe_div_sql(demos, converted),
        "rate_demo_to_close": safe_div_sql(won, demos),
        "rate_lead_to_close": safe_div_sql(won, total),
        **_velocity_avgs(q, rename={"days_lead_to_first_contact": "days_lead_to_contact"}),
    }


def funnel_stage_conversion(funnel: DataFrame, q: Measures = FROM_ROWS) -> DataFrame:
    """Stage volumes, stage-to-stage rates and velocity per month x channel (P10)."""
    months = funnel.where("lead_created_month IS NOT NULL").groupBy("lead_created_month", "channel")
    return months.agg(*named_aggs(_conversion(q)))


def _loss_reason_sql() -> str:
    unknown = config.UNKNOWN_LOSS_REASON.replace("'", "\\'")
    return f"coalesce(lost_reason, '{unknown}')"


def _losses(q: Measures) -> dict[str, str]:
    return {
        "lost_count": q.rows(),
        "avg_activities_before_loss": q.mean("total_activity_count"),
        "avg_days_to_loss": q.mean("days_lead_to_close"),
        "avg_predicted_sales_lost": q.mean("predicted_monthly_sales"),
    }


def loss_reason_analysis(funnel: DataFrame, q: Measures = FROM_ROWS) -> DataFrame:
    """Closed-lost deals per month x channel x reason with the reason's share (P11).

    The missing reason is folded into the explicit 'Unknown / Not Specified'
    label *before* grouping, so both end up in one group.  The total of a
    month x channel is an aggregate of its own, so no task holds all reasons.
    """
    lost = funnel.where("lead_created_month IS NOT NULL AND is_closed_lost")
    reasons = lost.groupBy("lead_created_month", "channel", F.expr(f"{_loss_reason_sql()} AS lost_reason"))
    agg = reasons.agg(*named_aggs(_losses(q)))
    return share_within(agg, "lost_count", ["lead_created_month", "channel"], "pct_of_channel_losses").select(
        "lead_created_month", "channel", "lost_reason", "lost_count", "pct_of_channel_losses",
        "avg_activities_before_loss", "avg_days_to_loss", "avg_predicted_sales_lost",
    )


def _activities(q: Measures) -> dict[str, str]:
    velocity = _velocity_avgs(
        q,
        rename={"days_lead_to_first_contact": "days_to_first_contact", "days_lead_to_close": "days_to_close"},
        drop=("days_opp_to_close",),
    )
    won_ltv = f"CASE WHEN current_funnel_stage = '{config.CLOSED_WON}' THEN estimated_ltv_24mo END"
    return {
        "lead_count": q.rows(),
        "total_calls": q.total("sales_call_count"),
        "total_texts": q.total("sales_text_count"),
        "total_emails": q.total("sales_email_count"),
        "total_activities": q.total("total_activity_count"),
        "avg_calls_per_lead": q.mean("sales_call_count"),
        "avg_texts_per_lead": q.mean("sales_text_count"),
        "avg_emails_per_lead": q.mean("sales_email_count"),
        "avg_activities_per_lead": q.mean("total_activity_count"),
        **velocity,
        "avg_ltv_won_deals": q.mean(won_ltv),
    }


def activity_efficiency(funnel: DataFrame, q: Measures = FROM_ROWS) -> DataFrame:
    """Touches and velocity per month x channel x current stage (P12)."""
    stages = funnel.where("lead_created_month IS NOT NULL").groupBy(
        "lead_created_month", "channel", F.expr("current_funnel_stage AS outcome")
    )
    return stages.agg(*named_aggs(_activities(q)))


def rollup_measures() -> Rollup:
    """What the marts P9 to P12 ask of a rollup."""
    q = Rollup()
    for mart in (_outcomes, _conversion, _losses, _activities):
        mart(q)
    return q


def funnel_rollup(funnel: DataFrame) -> DataFrame:
    """Counts and exact sums of the funnel from which P9 to P12 add up theirs.

    One row per month x channel x stage, and for lost deals x reason: finer
    than the groups of each of these marts.  So one pass over the leads with
    one map-side aggregate and one shuffle feeds all four, without a copy of
    every lead for each grouping.
    """
    keys = funnel.where("lead_created_month IS NOT NULL").groupBy(
        "lead_created_month", "channel", "current_funnel_stage", "is_closed_lost",
        F.expr(f"CASE WHEN is_closed_lost THEN {_loss_reason_sql()} END AS lost_reason"),
    )
    return keys.agg(*named_aggs(rollup_measures().parts))


#: Decimals of the per-account average revenue.
RATIO_DIGITS = 8


def mean_of_ratios_sql(total: str, count: str, digits: int = RATIO_DIGITS) -> str:
    """Mean over rows of ``total / count`` (decimal by positive integer),
    reproducible in any engine.

    Each ratio is a decimal rounded half away from zero to ``digits`` decimals;
    the ratios are summed exactly and a single double division finishes the
    mean.  Averaging already-averaged doubles instead would depend on the order
    the rows are added in.  Totals and sums of 30 digits before the point fit.
    """
    whole = f"DECIMAL(38,{digits})"
    ratio = f"CAST(CAST({total} AS {whole}) / CAST({count} AS DECIMAL(20,0)) AS {whole})"
    return f"CAST(sum({ratio}) AS DOUBLE) / CAST(count({ratio}) AS DOUBLE)"


def ltv_by_close_month(account_ltv_df: DataFrame) -> DataFrame:
    """Accounts won, LTV and revenue per *first-close* month x channel.

    ``avg_monthly_revenue_per_account`` is the mean over accounts of each
    account's average monthly revenue (total revenue / won deals).
    """
    return account_ltv_df.groupBy(F.expr(f"{month_start_sql('first_close_date')} AS close_month"), "channel").agg(
        *named_aggs(
            {
                "accounts_won": "count(1)",
                "total_ltv_24mo": "sum(total_estimated_ltv_24mo)",
                "avg_ltv_per_account": exact_avg_sql("total_estimated_ltv_24mo"),
                "avg_monthly_revenue_per_account": mean_of_ratios_sql("total_monthly_revenue", "total_won_deals"),
            }
        )
    )


def unit_economics(channel_econ: DataFrame, account_ltv_df: DataFrame) -> DataFrame:
    """CAC (by lead-created month) against LTV (by first-close month) (P13).

    The two month clocks differ; they are joined as if equal, as in the
    reference, so ``accounts_won`` is not ``closed_won_deals``.
    """
    c = channel_econ.select(
        "lead_created_month", "channel", "total_leads", "closed_won_deals", "total_cost", "cac",
        "lead_to_close_rate",
    )
    lt = ltv_by_close_month(account_ltv_df).withColumnRenamed("channel", "l_channel")
    joined = c.join(
        lt, (c["lead_created_month"] == lt["close_month"]) & (c["channel"] == lt["l_channel"]), "left"
    ).where("lead_created_month IS NOT NULL AND coalesce(total_cost, 0) > 0")
    cac_ok = "cac IS NOT NULL AND cac > 0"
    return joined.selectExpr(
        "lead_created_month",
        "channel",
        "total_leads",
        "closed_won_deals",
        "total_cost",
        "cac",
        "lead_to_close_rate",
        "coalesce(accounts_won, CAST(0 AS BIGINT)) AS accounts_won",
        "total_ltv_24mo",
        "avg_ltv_per_account",
        "avg_monthly_revenue_per_account",
        f"{guarded_div_sql('avg_ltv_per_account', 'cac', f'{cac_ok} AND avg_ltv_per_account IS NOT NULL')}"
        " AS ltv_to_cac_ratio",
        f"{guarded_div_sql('cac', 'avg_monthly_revenue_per_account', f'{cac_ok} AND avg_monthly_revenue_per_account > 0')}"
        " AS payback_period_months",
    )
