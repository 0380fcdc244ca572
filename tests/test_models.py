"""Pipelines on tiny hand-made inputs: one test per semantic trap of the
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest

from funnelworks.plans.project import Models
from funnelworks.plans import quality_suite
from funnelworks.sources import schemas
from funnelworks.sources.fixtures import RawSources

D = dt.date
T = dt.datetime


def frame(spark, schema, rows):
    names = [f.name for f in schema.fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def lead(i, **kw):
    base = {"lead_id": f"L{i}"}
    base.update(kw)
    return base


def opp(i, **kw):
    base = {"opportunity_id": f"O{i}", "created_date": T(2024, 1, 5, 12)}
    base.update(kw)
    return base


ADV = [{"month": "Jan-24", "advertising": "US$ 100,00"}, {"month": "Feb-24", "advertising": "US$ 50,00"}]
SAL = [{"month": "Jan-24", "outbound_sales_team": "US$ 10,00", "inbound_sales_team": "US$ 20,00"}]


def build(spark, leads=(), opps=(), adv=ADV, sal=SAL) -> Models:
    raw = RawSources(
        frame(spark, schemas.LEADS, list(leads)),
        frame(spark, schemas.OPPORTUNITIES, list(opps)),
        frame(spark, schemas.EXPENSES_ADVERTISING, list(adv)),
        frame(spark, schemas.EXPENSES_SALARY, list(sal)),
    )
    return Models(raw)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_t1_dedupe_prefers_null_created_date(spark):
    m = build(spark, opps=[opp(1, stage_name="Closed Won"), opp(1, stage_name="Closed Lost", created_date=None)])
    assert rows(m.stg_opportunities, "opportunity_id", "stage_category") == [("O1", "closed_lost")]


def test_t1_dedupe_keeps_latest(spark):
    m = build(spark, opps=[opp(1, stage_name="Closed Won"), opp(1, stage_name="Demo", created_date=T(2024, 2, 1))])
    assert rows(m.stg_opportunities, "stage_category", "days_to_close") == [("open", None)]


def test_channel_and_created_date(spark):
    m = build(spark, leads=[
        lead(1, form_submission_date=D(24, 3, 5), first_sales_call_date=T(2024, 1, 1, 9)),
        lead(2, first_text_sent_date=T(2024, 2, 1, 9), first_sales_call_date=T(2024, 2, 3, 9)),
        lead(3),
    ])
    got = rows(m.stg_leads, "lead_id", "channel", "lead_created_date", "first_contact_date")
    assert got == [
        ("L1", "inbound", D(2024, 3, 5), D(2024, 1, 1)),
        ("L2", "outbound", D(2024, 2, 3), D(2024, 2, 3)),  # a call wins over an earlier text
        ("L3", "outbound", None, None),
    ]
    # leads without any date leave the funnel
    assert m.fct_lead_funnel.count() == 2


def test_total_activity_count_treats_null_as_zero(spark):
    m = build(spark, leads=[lead(1, sales_call_count=2, sales_email_count=3), lead(2)])
    assert rows(m.stg_leads, "lead_id", "total_activity_count", "sales_text_count") == [
        ("L1", 5, None), ("L2", 0, None)]


def test_t8_converted_without_matching_opportunity(spark):
    m = build(spark, leads=[lead(1, converted_opportunity_id="O404", first_sales_call_date=T(2024, 1, 2, 9))])
    got = rows(m.fct_lead_funnel, "is_converted", "opportunity_id", "current_funnel_stage")
    assert got == [(True, None, "contacted")]


def test_t9_text_only_lead_is_new_but_counted_contacted(spark):
    m = build(spark, leads=[lead(1, first_text_sent_date=T(2024, 1, 2, 9))])
    assert rows(m.fct_lead_funnel, "current_funnel_stage") == [("new_lead",)]
    assert rows(m.fct_funnel_stage_conversion, "total_leads", "contacted") == [(1, 1)]


def test_t5_missing_and_literal_unknown_reason_share_a_group(spark):
    won_call = {"first_sales_call_date": T(2024, 1, 2, 9)}
    m = build(
        spark,
        leads=[lead(i, converted_opportunity_id=f"O{i}", **won_call) for i in range(3)],
        opps=[opp(0, stage_name="Closed Lost"), opp(1, stage_name="closed lost", lost_reason_c="Unknown / Not Specified"),
              opp(2, stage_name="Closed Lost", lost_reason_c="Price")],
    )
    got = rows(m.fct_loss_reason_analysis, "lost_reason", "lost_count", "pct_of_channel_losses")
    assert got == [("Price", 1, pytest.approx(1 / 3)), ("Unknown / Not Specified", 2, pytest.approx(2 / 3))]


def test_ltv_only_for_won_and_revenue_for_all(spark):
    call = {"first_sales_call_date": T(2024, 1, 2, 9)}
    m = build(
        spark,
        leads=[lead(1, converted_opportunity_id="O1", predicted_sales_with_owner="US$ 30000,00", **call),
               lead(2, converted_opportunity_id="O2", predicted_sales_with_owner="US$ 3000,00", **call),
               lead(3, predicted_sales_with_owner="n/a", **call)],
        opps=[opp(1, stage_name="Closed Won", account_id="A"), opp(2, stage_name="Demo Set", account_id="A")],
    )
    got = rows(m.fct_lead_funnel, "lead_id", "estimated_ltv_24mo", "predicted_monthly_total_revenue")
    assert got == [("L1", Decimal("48000.0000"), Decimal("2000.0000")),
                   ("L2", None, Decimal("650.0000")),
                   ("L3", None, Decimal("500.0000"))]


def test_t19_two_leads_on_one_opportunity_double_ltv(spark):
    call = {"first_sales_call_date": T(2024, 1, 2, 9)}
    m = build(
        spark,
        leads=[lead(1, converted_opportunity_id="O1", **call), lead(2, converted_opportunity_id="O1", **call)],
        opps=[opp(1, stage_name="Closed Won", account_id="A", close_date=D(24, 2, 1))],
    )
    assert rows(m.fct_account_ltv, "account_id", "total_won_deals", "total_estimated_ltv_24mo") == [
        ("A", 2, Decimal("24000.0000"))]


def test_t20_contact_to_dm_can_exceed_one(spark):
    m = build(spark, leads=[
        lead(1, form_submission_date=D(24, 1, 1), connected_with_decision_maker=True),
        lead(2, form_submission_date=D(24, 1, 1), connected_with_decision_maker=True,
             first_sales_call_date=T(2024, 1, 3, 9)),
    ])
    assert rows(m.fct_funnel_stage_conversion, "contacted", "connected_dm", "rate_contact_to_dm") == [(1, 2, 2.0)]


def test_t11_cost_months_without_leads_vanish_and_zero_cost_months_drop(spark):
    m = build(spark, leads=[
        lead(1, form_submission_date=D(24, 1, 10)),  # inbound, Jan: cost 100 + 20
        lead(2, first_sales_call_date=T(2024, 2, 3, 9)),  # outbound, Feb: no salary row -> cost 0 -> dropped
    ])
    assert rows(m.fct_channel_economics, "lead_created_month", "channel", "total_cost", "cac") == [
        (D(2024, 1, 1), "inbound", Decimal("120.00"), None)]
    assert m.int_monthly_expenses.count() == 4  # Jan and Feb, both channels


def test_cac_and_unit_economics(spark):
    call = {"form_submission_date": D(24, 1, 10)}
    m = build(
        spark,
        leads=[lead(i, converted_opportunity_id=f"O{i}", predicted_sales_with_owner="US$ 10000,00", **call)
               for i in range(2)],
        opps=[opp(i, stage_name="Closed Won", account_id=f"A{i}", close_date=D(24, 1, 20)) for i in range(2)],
    )
    ce = rows(m.fct_channel_economics, "closed_won_deals", "total_cost", "cac")
    assert ce == [(2, Decimal("120.00"), 60.0)]
    ue = rows(m.fct_unit_economics, "accounts_won", "avg_ltv_per_account", "ltv_to_cac_ratio", "payback_period_months")
    # LTV = (500 + 10000 * 0.05) * 24 = 24000; monthly revenue 1000
    assert ue == [(2, 24000.0, 400.0, 0.06)]


def test_t12_duplicate_and_unparseable_expense_months_are_reported(spark):
    adv = ADV + [{"month": "Jan-24", "advertising": "US$ 1,00"}, {"month": "Sept-24", "advertising": "US$ 7,00"}]
    m = build(spark, adv=adv)
    # the duplicate January fans out: two inbound rows for one month
    assert m.int_monthly_expenses.filter("channel = 'inbound'").count() == 3
    summary = {(r.model, r.test, r.column_name): r.violations
               for r in quality_suite.union_checks(quality_suite.unique_combination_checks(m)
                                                   + quality_suite.reconcile_checks(m)
                                                   + quality_suite.not_null_checks(m)).collect()}
    # January is duplicated for both channels
    assert summary[("int_monthly_expenses", "unique_combination_of_columns", "expense_month,channel")] == 2
    # the unparseable month drops 7.00 of advertising -> reconcile fails
    assert summary[("int_monthly_expenses", "assert_advertising_spend_matches_source", "advertising_cost")] == 1
    # the duplicate month doubles January's salary on the inbound side
    assert summary[("int_monthly_expenses", "assert_inbound_salary_matches_source", "people_cost")] == 1
    assert summary[("stg_expenses_advertising", "not_null", "expense_month")] == 1


def test_reconcile_values(spark):
    m = build(spark)
    r = quality_suite.reconcile_advertising(m).first()
    assert (r.source_total, r.model_total, r.difference, r.violations) == (
        Decimal("150.00"), Decimal("150.00"), Decimal("0.00"), 0)


def test_empty_inputs(spark):
    m = build(spark, leads=[], opps=[], adv=[], sal=[])
    assert m.int_monthly_expenses.count() == 0
    assert m.fct_unit_economics.count() == 0
    r = quality_suite.reconcile_outbound(m).first()
    assert (r.source_total, r.model_total, r.violations) == (0, 0, 0)


def test_hot_opportunity_key_through_the_model_graph(spark):
    """Forty leads on one opportunity with a 5-row budget: the journey is split
    over 8 buckets and still equals the unsplit result."""
    call = {"first_sales_call_date": T(2024, 1, 2, 9)}
    leads = [lead(i, converted_opportunity_id="O1", **call) for i in range(40)] + [
        lead(100, converted_opportunity_id="O2", **call), lead(101, **call)]
    opps = [opp(1, stage_name="Closed Won", account_id="A"), opp(2, stage_name="Closed Lost", account_id="B")]
    m = build(spark, leads=leads, opps=opps)
    hot = Models(m.raw, hot_key_rows=5)
    cold = Models(m.raw, hot_key_rows=None)
    assert hot.int_lead_opportunity_joined.exceptAll(cold.int_lead_opportunity_joined).count() == 0
    assert cold.int_lead_opportunity_joined.exceptAll(hot.int_lead_opportunity_joined).count() == 0
    assert rows(hot.fct_account_ltv, "account_id", "total_won_deals") == [("A", 40)]
    plan = hot.int_lead_opportunity_joined._jdf.queryExecution().executedPlan().toString()
    assert "__hot_key" in plan or "__bucket" in plan


def test_with_overrides_keeps_settings(spark):
    m = build(spark)
    m2 = Models(m.raw, join_strategy="salt", hot_key_rows=7).with_overrides(stg_leads=m.stg_leads)
    assert (m2.join_strategy, m2.hot_key_rows) == ("salt", 7)
    assert m2.stg_leads is m.stg_leads


def test_custom_assumptions_flow_through(spark):
    from dataclasses import replace

    from funnelworks.config import DEFAULT

    call = {"first_sales_call_date": T(2024, 1, 2, 9)}
    m = build(
        spark,
        leads=[lead(1, converted_opportunity_id="O1", predicted_sales_with_owner="US$ 30000,00", **call)],
        opps=[opp(1, stage_name="Closed Won", account_id="A")],
    )
    a = replace(DEFAULT, ltv_months=36, take_rate=Decimal("0.10"), monthly_subscription=Decimal("400.0"))
    custom = Models(m.raw, a)
    # (400 + 30000 * 0.10) * 36 = 122400; monthly revenue 3400
    assert rows(custom.fct_lead_funnel, "estimated_ltv_24mo", "predicted_monthly_total_revenue") == [
        (Decimal("122400.0000"), Decimal("3400.0000"))]
    assert rows(custom.fct_account_ltv, "total_estimated_ltv_24mo", "avg_monthly_subscription_revenue") == [
        (Decimal("122400.0000"), 400.0)]


def _accounts(spark, rows):
    return spark.createDataFrame(
        [("a", "inbound", Decimal(total), n, Decimal(1)) for total, n in rows],
        "account_id string, channel string, total_monthly_revenue decimal(38,4), total_won_deals long, total_estimated_ltv_24mo decimal(38,4)",
    ).selectExpr("*", "DATE'2024-03-05' AS first_close_date")


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_revenue_per_account_over_large_and_negative_totals(spark, ansi):
    from funnelworks.plans.marts import ltv_by_close_month

    cases = [
        ([("50000000000", 100_000_000)], 500.0),  # 1e8 won deals on one account
        ([("46000000000000000", 92_000_000)], 500_000_000.0),
        ([("40000000000", 1)] * 3, 4e10),
        ([("100000000", 1)] * 2000, 1e8),
        ([("-1", 3)], -0.33333333),
        ([("-2", 3), ("1", 3)], -0.16666667),
        ([("1", 3), ("2", 3)], 0.5),
    ]
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        for rows, want in cases:
            got = ltv_by_close_month(_accounts(spark, rows)).first()["avg_monthly_revenue_per_account"]
            assert got == pytest.approx(want, rel=1e-12), rows[0]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")
