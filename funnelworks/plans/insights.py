"""The two ad-hoc insight queries run against the lead funnel (P14, P15)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelworks.functions.columns import (
    named_aggs,
    count_where_sql,
    exact_avg_sql,
    predicted_sales_tier_sql,
    safe_div_sql,
    speed_to_lead_bucket_sql,
)


def speed_to_lead(funnel: DataFrame) -> DataFrame:
    """Close rate and LTV by how fast a called lead was first contacted."""
    won = count_where_sql("is_closed_won")
    return (
        funnel.where("first_sales_call_date IS NOT NULL")
        .groupBy("channel", F.expr(f"{speed_to_lead_bucket_sql('days_lead_to_first_contact')} AS response_speed_bucket"))
        .agg(
            *named_aggs(
                {
                    "lead_count": "count(1)",
                    "won_count": won,
                    "close_rate": safe_div_sql(won, "count(1)"),
                    "avg_ltv_won": exact_avg_sql("estimated_ltv_24mo"),
                }
            )
        )
        .orderBy("channel", "response_speed_bucket")
    )


def predicted_sales_tier(funnel: DataFrame) -> DataFrame:
    """Conversion, LTV and LTV per activity by predicted monthly sales tier."""
    won = count_where_sql("is_closed_won")
    return (
        funnel.groupBy("channel", F.expr(f"{predicted_sales_tier_sql('predicted_monthly_sales')} AS predicted_sales_tier"))
        .agg(
            *named_aggs(
                {
                    "total_leads": "count(1)",
                    "converted": count_where_sql("is_converted"),
                    "won": won,
                    "close_rate": safe_div_sql(won, "count(1)"),
                    "avg_ltv": exact_avg_sql("CASE WHEN is_closed_won THEN estimated_ltv_24mo END"),
                    "avg_activities": exact_avg_sql("total_activity_count"),
                    "ltv_per_activity": safe_div_sql(
                        "sum(CASE WHEN is_closed_won THEN estimated_ltv_24mo ELSE 0 END)", "sum(total_activity_count)"
                    ),
                }
            )
        )
        .orderBy("channel", "predicted_sales_tier")
    )
