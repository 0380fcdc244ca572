"""Plan checks: the physical plans stay JVM-side, prune columns, combine
map-side and keep the null-key majority out of the join shuffle."""

from __future__ import annotations

import pytest

from funnelworks.plans.catalog import QUERIES, models
from tests.conftest import SF_SMALL


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_cartesian_product(spark, name):
    p = plan_of(QUERIES[name](spark, SF_SMALL))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in p, f"{name}: {bad}"


def test_funnel_scans_only_needed_columns(spark):
    text = plan_of(models(spark, SF_SMALL).fct_funnel_stage_conversion)
    schemas = [part.split(",")[0] for part in text.split("ReadSchema: ")[1:]]
    assert schemas and all("o_totalprice" not in s and "o_orderpriority" not in s for s in schemas)


def _find(node, name):
    if node.nodeName() == name:
        return node
    children = node.children()
    for i in range(children.size()):
        hit = _find(children.apply(i), name)
        if hit is not None:
            return hit
    return None


def test_unconverted_leads_are_not_shuffled(spark):
    """The branch of null and hot keys reaches the union with its left rows
    unshuffled: broadcast joins only."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        j = models(spark, SF_SMALL).int_lead_opportunity_joined
        union = _find(j._jdf.queryExecution().executedPlan(), "Union")
        cold, stays = [union.children().apply(i) for i in range(2)]
        assert "SortMergeJoin" in cold.toString() and union.children().size() == 2
        assert "SortMergeJoin" not in stays.toString().split("BroadcastExchange")[0]
        node = stays
        while node.children().size():  # down the streamed side to the scan
            assert node.nodeName() not in ("Exchange", "SortMergeJoin", "ShuffledHashJoin")
            node = node.children().apply(0)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_aggregates_are_partial_then_final(spark):
    p = plan_of(models(spark, SF_SMALL).fct_channel_economics)
    assert p.count("HashAggregate") >= 2


def test_won_rows_are_hashed_in_one_shuffle(spark, models_small):
    """Account LTV, which has maxima of texts, combines won rows by hashing
    before its only shuffle, and sorts nothing."""
    from funnelworks.plans import marts

    won = spark.createDataFrame(models_small.fct_lead_funnel.limit(5).collect(), models_small.fct_lead_funnel.schema)
    p = plan_of(marts.account_ltv(won))
    assert p.count("ObjectHashAggregate") == 2 and p.count("Exchange hashpartitioning") == 1
    assert "Sort" not in p and "partial_max(cuisine_types" in p


def test_unit_economics_reuses_the_funnel_exchanges(spark):
    """Both branches of unit economics derive from the same join; identical
    shuffles are computed once (ReusedExchange) when AQE is off."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan_of(models(spark, SF_SMALL).fct_unit_economics)
        assert "ReusedExchange" in p
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")


def test_split_predicates_reach_the_parquet_scans(spark, models_small):
    """On stored raw tables the cold branch filters in the scan, the hot-key
    count reads the key column only, and the leads are read three times."""
    import re
    import tempfile

    from funnelworks.plans.project import Models
    from funnelworks.sources.io import read_raw_sources, write_raw_sources

    out = tempfile.mkdtemp(prefix="funnelworks-test-pushdown-")
    write_raw_sources(models_small.raw, out)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # shows reused exchanges as such
    try:
        p = plan_of(Models(read_raw_sources(spark, out)).int_lead_opportunity_joined)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    scans = re.findall(r"FileScan parquet \[([^\]]*)\].*?PushedFilters: (\[[^\]]*\])", p)
    leads = [(cols, pushed) for cols, pushed in scans if "converted_opportunity_id#" in cols]
    assert len(leads) == 3
    assert sum(pushed == "[IsNotNull(converted_opportunity_id)]" for _, pushed in leads) >= 2
    assert any(cols.startswith("converted_opportunity_id#") and "," not in cols for cols, _ in leads)


def test_checks_read_the_stored_journey(spark):
    """The 40 checks hold no lead join, and a check of one column reads one."""
    import re

    p = plan_of(QUERIES["data_quality_summary"](spark, SF_SMALL))
    scans = re.findall(r"FileScan parquet \[([^\]]*)\][^\n]*/journey-", p)
    assert scans and min(len(s.split(",")) for s in scans) == 1
    assert "orders.parquet" in p and "converted_opportunity_id" not in "".join(
        line for line in p.splitlines() if "Join" in line
    )


def test_opportunities_are_shuffled_once(spark):
    """With sort-merge joins the cold join reuses the dedupe's partitioning:
    exactly one real shuffle on opportunity_id, hot branch via broadcast."""
    import re

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = plan_of(models(spark, SF_SMALL).int_lead_opportunity_joined)
        ids = set(re.findall(r"Exchange hashpartitioning\(opportunity_id#\d+, \d+\), ENSURE_REQUIREMENTS, \[plan_id=(\d+)\]", p))
        assert len(ids) == 1  # one shuffle of the opportunities; other uses are ReusedExchange
        assert "SortMergeJoin" in p and "LeftAnti" in p and "LeftSemi" in p
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
