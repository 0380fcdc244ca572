"""Driver contract and the materialized build."""

from __future__ import annotations

import tempfile
import uuid

import pytest

import __spark_entry__ as entry
from funnelworks.plans.build import build_project
from funnelworks.sources.io import raw_sources_from_tables, read_raw_sources, read_table, save_table, write_raw_sources
from funnelworks.sources.schemas import RAW_SCHEMAS
from funnelworks.plans.project import MARTS, Models


def test_entry_runs_and_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() == 145
    assert {"lead_created_month", "channel", "cac", "ltv_to_cac_ratio", "payback_period_months"} <= set(df.columns)


def test_queries_and_oracles_cover_survey_keys():
    import re

    own = lambda names: {k for k in names if not re.match(r"op\d+_|pipeline$", k)}
    keys = own(entry.queries())
    assert keys == own(entry.oracle_sql())
    pipelines = {
        "stg_leads", "stg_opportunities", "stg_expenses_advertising", "stg_expenses_salary",
        "int_lead_opportunity_joined", "int_monthly_expenses", "fct_lead_funnel", "fct_account_ltv",
        "fct_channel_economics", "fct_funnel_stage_conversion", "fct_loss_reason_analysis",
        "fct_activity_efficiency", "fct_unit_economics", "speed_to_lead", "predicted_sales_tier",
        "data_quality_summary",
    }
    operators = {
        "dedupe_latest", "month_spine", "unpivot_channels", "share_within", "parse_currency", "fix_year_offset",
        "parse_month", "safe_div", "bucketize", "resolve_stage", "days_between", "unique_violations",
        "not_null_violations", "accepted_values_violations", "relationship_violations",
        "lead_join_hot_keys", "accepted_values_found", "relationship_orphans", "unique_combination_found", "reconcile_found",
        "unique_combination_violations", "reconcile_advertising", "reconcile_inbound", "reconcile_outbound",
        "uniqueness_found", "checks_while_written", "source_scan", "view_sink", "table_sink", "rollup_channel_economics",
        "rollup_stage_conversion", "rollup_loss_reasons", "rollup_activity_efficiency", "built_quality_summary", "bucketed_join",
        "relationship_orphans_filtered",
    }
    assert pipelines | operators == keys


def test_build_project_round_trip(spark, models_small):
    out = tempfile.mkdtemp(prefix="funnelworks-test-build-")
    paths = build_project(models_small, out)
    assert set(paths) == set(MARTS) | {"data_quality_summary"}
    stored = spark.read.parquet(paths["fct_unit_economics"])
    direct = models_small.fct_unit_economics
    assert stored.exceptAll(direct).count() == 0 and direct.exceptAll(stored).count() == 0
    assert spark.read.parquet(paths["data_quality_summary"]).count() == 40
    assert spark.catalog.tableExists("stg_leads")


def test_raw_sources_round_trip_through_files(spark, models_small):
    out = tempfile.mkdtemp(prefix="funnelworks-test-raw-")
    write_raw_sources(models_small.raw, out)
    m = Models(read_raw_sources(spark, out))
    assert m.fct_lead_funnel.count() == 1300
    def shape(df):
        return [(f.name, f.dataType) for f in df.schema.fields]

    assert shape(m.raw.leads) == shape(models_small.raw.leads)


def test_command_line_build(spark, models_small, capsys):
    from funnelworks.__main__ import main

    root = tempfile.mkdtemp(prefix="funnelworks-test-cli-")
    write_raw_sources(models_small.raw, f"{root}/raw")
    assert main(["--raw", f"{root}/raw", "--out", f"{root}/marts"]) == 0
    assert main(["--raw", f"{root}/raw", "--out", f"{root}/marts2", "--fail-on-violations"]) == 1
    out = capsys.readouterr().out
    assert "FAIL\tleads\tnot_null\tform_submission_date\t1000" in out
    assert read_table(spark, f"{root}/marts/fct_unit_economics").count() == 145


def test_catalog_tables_as_sources_and_sinks(spark, models_small):
    tag = uuid.uuid4().hex[:8]
    spark.sql(f"CREATE DATABASE raw_{tag}")
    spark.sql(f"CREATE DATABASE marts_{tag}")
    for name, df in zip(RAW_SCHEMAS, models_small.raw):
        df.selectExpr("*", "1 AS other").write.saveAsTable(f"raw_{tag}.{name}")
    m = Models(raw_sources_from_tables(spark, f"raw_{tag}"))
    places = build_project(m, database=f"marts_{tag}")
    assert set(places) == set(MARTS) | {"data_quality_summary"}
    funnel = spark.table(f"marts_{tag}.fct_lead_funnel")
    assert funnel.count() == 1300
    with pytest.raises(Exception, match="lost"):
        save_table(spark.range(9).selectExpr("raise_error('lost') AS x"), f"marts_{tag}.fct_lead_funnel")
    assert spark.table(f"marts_{tag}.fct_lead_funnel").count() == 1300
    save_table(spark.range(4), f"marts_{tag}.fct_lead_funnel")
    assert spark.table(f"marts_{tag}.fct_lead_funnel").count() == 4
    assert {t.name for t in spark.catalog.listTables(f"marts_{tag}") if not t.isTemporary} == set(places)
    for side in ("raw", "marts"):
        spark.sql(f"DROP DATABASE {side}_{tag} CASCADE")


@pytest.mark.parametrize(("name", "second"), [("speed_to_lead", "response_speed_bucket"), ("predicted_sales_tier", "predicted_sales_tier")])
def test_insights_are_in_order(models_small, name, second):
    rows = [(r["channel"], r[second]) for r in models_small[name].collect()]
    assert len(rows) > 4 and rows == sorted(rows) and all(None not in r for r in rows)
