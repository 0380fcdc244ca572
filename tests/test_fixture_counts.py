"""Independent expected values: FIXTURES.md section 3 at all three scales.

These numbers were produced outside this code base (a separate SQL run), so
they guard against a misunderstanding shared by the Spark models and the
DuckDB oracle.
"""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from funnelworks.plans.catalog import models

EXPECTED = {
    "0.001": dict(leads=1500, opps_raw=287, opps=282, dup_ids=5, dup_kept_null=2, adv=75, sal=71,
                  no_created=200, funnel=1300, conv_no_opp=18, null_pms=350, expenses=160,
                  zero_cost=(5, 9), ltv=52, chan=145, cac_null=96, ratio_null=128, stage=159,
                  loss=125, act=600, total_ltv="1836664.7160", adv_sum="4080511.15",
                  in_sum="1551629.55", out_sum="2870130.95"),
    "0.01": dict(leads=15000, opps_raw=2879, opps=2823, dup_ids=56, dup_kept_null=28, adv=75, sal=71,
                 no_created=2000, funnel=13000, conv_no_opp=177, null_pms=3500, expenses=160,
                 zero_cost=(5, 9), ltv=521, chan=145, cac_null=5, ratio_null=16, stage=159,
                 loss=615, act=945, total_ltv="19439022.0480", adv_sum="4545477.39",
                 in_sum="1748599.01", out_sum="3118014.09"),
    "0.1": dict(leads=150000, opps_raw=28799, opps=28235, dup_ids=564, dup_kept_null=282, adv=75, sal=71,
                no_created=20000, funnel=130000, conv_no_opp=1765, null_pms=35000, expenses=160,
                zero_cost=(5, 9), ltv=5216, chan=146, cac_null=1, ratio_null=3, stage=160,
                loss=795, act=957, total_ltv="189587358.4200", adv_sum="4432012.34",
                in_sum="1774497.57", out_sum="3130189.13"),
}


@pytest.mark.parametrize("sf", sorted(EXPECTED))
def test_fixtures_section_3(spark, sf):
    e = EXPECTED[sf]
    m = models(spark, f"/root/testdata/sf{sf}")
    raw = m.raw
    assert raw.leads.count() == e["leads"]
    assert raw.opportunities.count() == e["opps_raw"]
    assert m.stg_opportunities.count() == e["opps"]
    dup = raw.opportunities.groupBy("opportunity_id").count().where("count > 1")
    assert dup.count() == e["dup_ids"]
    kept_null = m.stg_opportunities.join(dup, "opportunity_id", "left_semi").where("created_date IS NULL")
    assert kept_null.count() == e["dup_kept_null"]
    assert (raw.expenses_advertising.count(), raw.expenses_salary.count()) == (e["adv"], e["sal"])
    assert m.stg_leads.where("lead_created_date IS NULL").count() == e["no_created"]

    f = m.fct_lead_funnel
    counts = f.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("is_converted") & F.col("opportunity_id").isNull()).alias("conv_no_opp"),
        F.count_if(F.col("predicted_monthly_sales").isNull()).alias("null_pms"),
        F.sum("estimated_ltv_24mo").alias("ltv"),
    ).first()
    assert (counts.n, counts.conv_no_opp, counts.null_pms) == (e["funnel"], e["conv_no_opp"], e["null_pms"])
    assert counts.ltv == Decimal(e["total_ltv"])

    x = m.int_monthly_expenses
    assert x.count() == e["expenses"]
    zero = {r.channel: r.n for r in x.where("total_cost = 0").groupBy("channel").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert (zero.get("inbound", 0), zero.get("outbound", 0)) == e["zero_cost"]
    sums = x.groupBy("channel").agg(F.sum("advertising_cost").alias("ad"), F.sum("people_cost").alias("people"))
    by = {r.channel: r for r in sums.collect()}
    assert by["inbound"].ad == Decimal(e["adv_sum"])
    assert by["inbound"].people == Decimal(e["in_sum"])
    assert by["outbound"].people == Decimal(e["out_sum"])

    assert m.fct_account_ltv.count() == e["ltv"]
    ce = m.fct_channel_economics
    assert ce.count() == e["chan"] == m.fct_unit_economics.count()
    assert ce.where("cac IS NULL").count() == e["cac_null"]
    assert m.fct_unit_economics.where("ltv_to_cac_ratio IS NULL").count() == e["ratio_null"]
    assert m.fct_funnel_stage_conversion.count() == e["stage"]
    assert m.fct_loss_reason_analysis.count() == e["loss"]
    assert m.fct_activity_efficiency.count() == e["act"]


def test_stage_and_speed_splits_sf001(spark):
    m = models(spark, "/root/testdata/sf0.01")
    stages = {(r.channel, r.current_funnel_stage): r["count"]
              for r in m.fct_lead_funnel.groupBy("channel", "current_funnel_stage").count().collect()}
    assert stages == {
        ("inbound", "new_lead"): 1500, ("outbound", "new_lead"): 1000,
        ("inbound", "contacted"): 1500, ("outbound", "contacted"): 3000,
        ("inbound", "meeting_booked"): 1059, ("outbound", "meeting_booked"): 2118,
        ("inbound", "opportunity_open"): 244, ("outbound", "opportunity_open"): 490,
        ("inbound", "closed_won"): 226, ("outbound", "closed_won"): 451,
        ("inbound", "closed_lost"): 471, ("outbound", "closed_lost"): 941,
    }
    speed = {(r.channel, r.response_speed_bucket): r.lead_count for r in m.speed_to_lead.collect()}
    assert speed == {
        ("inbound", "same_day"): 319, ("inbound", "next_day"): 319, ("inbound", "2_to_7_days"): 1908,
        ("inbound", "8_plus_days"): 954, ("outbound", "same_day"): 7000,
    }
