"""Typed schemas of the four raw inputs.

The reference declares no types; these follow from how every column is used
(date arithmetic, ``::date`` casts, ``count_if`` on booleans, currency text).
Reading with an explicit schema avoids inference passes over the data and
makes a wrongly typed file fail at read time instead of mid-pipeline.
"""

from __future__ import annotations

from pyspark.sql import types as T

LEADS = T.StructType(
    [
        T.StructField("lead_id", T.StringType(), False),
        T.StructField("converted_opportunity_id", T.StringType()),
        T.StructField("form_submission_date", T.DateType()),
        T.StructField("first_sales_call_date", T.TimestampNTZType()),
        T.StructField("first_text_sent_date", T.TimestampNTZType()),
        T.StructField("first_meeting_booked_date", T.TimestampNTZType()),
        T.StructField("last_sales_call_date", T.TimestampNTZType()),
        T.StructField("last_sales_activity_date", T.TimestampNTZType()),
        T.StructField("last_sales_email_date", T.TimestampNTZType()),
        T.StructField("sales_call_count", T.IntegerType()),
        T.StructField("sales_text_count", T.IntegerType()),
        T.StructField("sales_email_count", T.IntegerType()),
        T.StructField("predicted_sales_with_owner", T.StringType()),
        T.StructField("marketplaces_used", T.StringType()),
        T.StructField("online_ordering_used", T.StringType()),
        T.StructField("cuisine_types", T.StringType()),
        T.StructField("location_count", T.IntegerType()),
        T.StructField("connected_with_decision_maker", T.BooleanType()),
        T.StructField("status", T.StringType()),
    ]
)

OPPORTUNITIES = T.StructType(
    [
        T.StructField("opportunity_id", T.StringType(), False),
        T.StructField("account_id", T.StringType()),
        T.StructField("stage_name", T.StringType()),
        T.StructField("lost_reason_c", T.StringType()),
        T.StructField("closed_lost_notes_c", T.StringType()),
        T.StructField("business_issue_c", T.StringType()),
        T.StructField("how_did_you_hear_about_us_c", T.StringType()),
        T.StructField("demo_held", T.BooleanType()),
        T.StructField("demo_set_date", T.DateType()),
        T.StructField("demo_time", T.TimestampNTZType()),
        T.StructField("created_date", T.TimestampNTZType()),
        T.StructField("close_date", T.DateType()),
        T.StructField("last_sales_call_date_time", T.TimestampNTZType()),
    ]
)

EXPENSES_ADVERTISING = T.StructType(
    [
        T.StructField("month", T.StringType()),
        T.StructField("advertising", T.StringType()),
    ]
)

EXPENSES_SALARY = T.StructType(
    [
        T.StructField("month", T.StringType()),
        T.StructField("outbound_sales_team", T.StringType()),
        T.StructField("inbound_sales_team", T.StringType()),
    ]
)

RAW_SCHEMAS = {
    "leads": LEADS,
    "opportunities": OPPORTUNITIES,
    "expenses_advertising": EXPENSES_ADVERTISING,
    "expenses_salary_and_commissions": EXPENSES_SALARY,
}
