"""Reports that share a pass: rollup, checks while writing, uniqueness in one
shuffle, shares without a window, joins over bucketed tables."""

from __future__ import annotations

import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from funnelworks.functions.measures import Rollup
from funnelworks.operators import quality as Q
from funnelworks.operators.frames import share_within
from funnelworks.plans import marts, quality_suite
from funnelworks.plans.build import build_project
from funnelworks.plans.project import Models
from funnelworks.session import stored
from funnelworks.sources.fixtures import RawSources
from funnelworks.sources.io import raw_sources_from_tables, save_bucketed
from funnelworks.sources.schemas import RAW_SCHEMAS
from tests.test_plans import plan_of


def same(a, b):
    assert [(f.name, f.dataType) for f in a.schema] == [(f.name, f.dataType) for f in b.schema]
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


# -- rollup


FROM_ROLLUP = ["fct_channel_economics", "fct_funnel_stage_conversion", "fct_loss_reason_analysis", "fct_activity_efficiency"]


def test_marts_over_the_rollup_equal_those_over_leads(models_small):
    funnel = stored(models_small.fct_lead_funnel, "funnel")
    direct = models_small.with_overrides(fct_lead_funnel=funnel)
    rolled = direct.with_overrides(funnel_rollup=stored(direct.funnel_rollup, "rollup")).over_rollup()
    for name in [*FROM_ROLLUP, "fct_unit_economics"]:
        same(rolled[name], direct[name])


def test_rollup_of_odd_rows(spark, models_small):
    """Missing and repeated reasons, reasons of deals that are not lost, no rows."""
    f = models_small.fct_lead_funnel
    odd = f.withColumn("lost_reason", F.expr("CASE pmod(hash(lead_id), 4) WHEN 0 THEN 'price' WHEN 1 THEN '' WHEN 2 THEN 'Unknown / Not Specified' END"))
    for funnel in (stored(odd, "odd"), f.limit(0)):
        rollup, q = marts.funnel_rollup(funnel), marts.rollup_measures()
        for mart in (marts.funnel_stage_conversion, marts.loss_reason_analysis, marts.activity_efficiency):
            same(mart(rollup, q), mart(funnel))


def test_rollup_takes_one_pass_and_one_shuffle(spark, models_small):
    rollup = marts.funnel_rollup(stored(models_small.fct_lead_funnel, "funnel"))
    p = plan_of(rollup)
    assert p.count("FileScan") == 1 and p.count("Exchange") == 1 and p.count("HashAggregate") == 2 and "Expand" not in p
    assert rollup.count() < models_small.fct_lead_funnel.count()


def test_the_build_scans_the_funnel_twice(spark, models_small, monkeypatch):
    """Once for the rollup behind four marts, once for account LTV."""
    from funnelworks.sources.versions import Pending

    plans, write = {}, Pending.write
    monkeypatch.setattr(Pending, "write", lambda self, df, table="", *more: plans.update({table: plan_of(df)}) or write(self, df, table, *more))
    build_project(models_small, tempfile.mkdtemp(prefix="funnelworks-test-scan-"), run_checks=False)
    assert [name for name, p in plans.items() if "/fct_lead_funnel/" in p] == ["fct_account_ltv"]
    assert sorted(name for name, p in plans.items() if "/rollup-" in p) == sorted(FROM_ROLLUP)


def test_rollup_names_are_of_one_aggregate():
    q = Rollup()
    assert q.where("a > 1") == "sum(rows_a_1)" and q.where("a > 1") == "sum(rows_a_1)"
    with pytest.raises(ValueError):
        q.where("a < 1")


# -- checks while writing


def test_checks_counted_while_written_equal_those_of_a_scan(spark):
    rows = [(i, None if i % 3 else "x", ["a", "b", "c", None, "a"][i % 5]) for i in range(1000)]
    df = spark.createDataFrame(rows, "id int, v string, w string").repartition(7)
    for accepted in ({"w": ["a"], "v": ["x"]}, {"w": ["a", "b", "c"]}, {}):
        profile = Q.observed_profile(df, "t", ["id", "v"], accepted)
        got = profile.summary(stored(profile.df, "t"))
        same(got, Q.profile_checks(df, "t", ["id", "v"], accepted))
    empty = Q.observed_profile(df.limit(0), "t", ["id"], {"w": ["a"]})
    assert [r["violations"] for r in empty.summary(stored(empty.df, "t")).collect()] == [0, 0]


def test_no_scan_of_a_built_table_for_its_profile(spark, models_small, monkeypatch):
    scanned = []
    monkeypatch.setattr(Q, "profile_checks", lambda df, model, **k: scanned.append(model) or _summary_of(df, model))

    def _summary_of(df, model):
        return df.sparkSession.createDataFrame([(model, "t", "c", 0)], "model string, test string, column_name string, violations long")

    build_project(models_small, tempfile.mkdtemp(prefix="funnelworks-test-observed-"))
    assert sorted(scanned) == sorted(
        ["leads", "opportunities", "stg_leads", "stg_opportunities", "stg_expenses_advertising", "stg_expenses_salary", "int_monthly_expenses"]
    )  # views and raw tables, which no build writes


def test_a_built_table_with_violations_is_reported(spark, models_small):
    bad = models_small.int_lead_opportunity_joined.withColumn("channel", F.expr("CASE WHEN lead_id LIKE '%1' THEN concat('odd', right(lead_id, 2)) ELSE channel END"))
    m = models_small.with_overrides(int_lead_opportunity_joined=bad)
    from funnelworks.sources.io import read_table

    out = tempfile.mkdtemp(prefix="funnelworks-test-bad-")
    build_project(m, out)
    got = {(r.model, r.test, r.column_name): r.violations for r in read_table(spark, f"{out}/data_quality_summary").collect()}
    want = {(r.model, r.test, r.column_name): r.violations for r in quality_suite.run_checks(m).collect()}
    assert got == want and got["fct_lead_funnel", "accepted_values", "channel"] > 5


# -- uniqueness


def test_uniqueness_checks_equal_single_ones_in_one_shuffle(spark):
    rows = [(i % 90 or None, i % 7 or None, f"s{i % 40}") for i in range(200)] + [(None, None, None)] * 3
    df = spark.createDataFrame(rows, "a int, b int, c string")
    got = Q.uniqueness_checks(df, "t", ["a", "c", "b"], [["a"], ["b", "c"], ["c", "a", "b"]])
    single = [Q.unique_check(df, "t", c) for c in "acb"] + [Q.unique_combination_check(df, "t", c) for c in (["a"], ["b", "c"], ["c", "a", "b"])]
    same(got, quality_suite.union_checks(single))
    assert plan_of(got).count("Exchange hashpartitioning") == 1
    assert [r["violations"] for r in Q.uniqueness_checks(df.limit(0), "t", ["a"], [["a", "b"]]).collect()] == [0, 0]


# -- relationships


@pytest.mark.parametrize("most", [1 << 14, 3, 0])
def test_filtered_relationship_check_is_exact(spark, monkeypatch, most):
    """Sound children, orphans, nulls and a hot orphan; parents in one bitmap, in several, too many for any."""
    monkeypatch.setattr(Q, "MOST_BITMAPS", most)
    parents = spark.range(6000).selectExpr("concat('p', id) AS k").unionByName(spark.sql("SELECT CAST(NULL AS STRING) AS k"))
    child = spark.range(9000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL WHEN id % 5 = 0 THEN 'gone' ELSE concat('p', id) END AS c")
    for few in (parents, parents.limit(1), parents.limit(0)):
        few = stored(few, "parents")
        same(Q.filtered_relationship_check(child, "t", "c", few, "k"), Q.relationship_check(child, "t", "c", few, "k"))
    same(Q.filtered_relationship_check(child.limit(0), "t", "c", parents, "k"), Q.relationship_check(child.limit(0), "t", "c", parents, "k"))


def test_filter_holds_every_key_and_few_others(spark):
    keys = spark.range(20_000).selectExpr("concat('p', id) AS k")
    held = Q.key_filter(keys, "k", 7)
    asked = spark.range(40_000).selectExpr("concat('p', id) AS k", "id < 20000 AS own").withColumn("at", F.expr(Q._bitmap_sql("k", 7)))
    inside = " AND ".join(Q._set_sql(bit) for bit in Q._bits_sql("k"))
    told = asked.join(held, asked["at"] == held["__bitmap"]).groupBy("own").agg(F.expr(f"count_if({inside}) AS n")).collect()
    n = {r["own"]: r["n"] for r in told}
    assert n[True] == 20_000 and n[False] < 0.03 * 20_000


def shuffled_rows(node) -> int:
    """Rows written by the shuffles of a plan that has run."""
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        return shuffled_rows(node.executedPlan())
    if name.endswith("QueryStage"):
        return shuffled_rows(node.plan())
    own = node.metrics().apply("shuffleRecordsWritten").value() if name == "Exchange" else 0
    return own + sum(shuffled_rows(node.children().apply(i)) for i in range(node.children().size()))


def test_orphans_outside_the_filter_are_not_shuffled(spark):
    """Orphans are told where they are read, so few of their keys move."""
    parents = stored(spark.range(1000).selectExpr("concat('p', id) AS k"), "parents")
    child = stored(spark.range(100_000).selectExpr("concat('x', id) AS c"), "child")
    moved = {}
    for check in (Q.relationship_check, Q.filtered_relationship_check):
        out = check(child, "t", "c", parents, "k")
        assert out.collect()[0]["violations"] == 100_000
        moved[check] = shuffled_rows(out._jdf.queryExecution().executedPlan())
    assert moved[Q.relationship_check] >= 100_000 and moved[Q.filtered_relationship_check] < 10_000


# -- shares


def test_a_million_reasons_of_one_month_are_spread(spark):
    df = spark.range(1_000_000, numPartitions=8).selectExpr("1 AS month", "'x' AS channel", "id AS reason", "1 + id % 3 AS n")
    df = stored(df.unionByName(spark.sql("SELECT 2 AS month, CAST(NULL AS STRING) AS channel, 5L AS reason, 4L AS n")), "reasons")
    small = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1m", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m"}
    for joins in (small, {**small, "spark.sql.autoBroadcastJoinThreshold": "-1"}):
        before = {k: spark.conf.get(k, None) for k in joins}
        for k, v in joins.items():
            spark.conf.set(k, v)
        try:
            out = share_within(df, "n", ["month", "channel"], "s")
            assert "Window" not in plan_of(out)
            told = out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.sum("s").alias("s"), F.max("reason")).collect()
            assert sum(r["n"] for r in told) == 1_000_001 and max(r["n"] for r in told) < 400_000
            assert abs(sum(r["s"] for r in told) - 2) < 1e-6 and out.where("month = 2").first()["s"] == 1
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)


# -- bucketed tables


def test_bucketed_opportunities_are_not_shuffled(spark, models_small):
    db = f"bucketed_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE DATABASE {db}")
    for name, df in zip(RAW_SCHEMAS, models_small.raw):
        if name == "opportunities":
            save_bucketed(df, f"{db}.{name}", "opportunity_id", 8)
        else:
            df.write.saveAsTable(f"{db}.{name}")
    raw = raw_sources_from_tables(spark, db)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        p = plan_of(Models(raw).int_lead_opportunity_joined)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    assert not [line for line in p.splitlines() if "Exchange hashpartitioning(opportunity_id" in line]
    assert "Exchange hashpartitioning(l_converted_opportunity_id" in p and p.count("Bucketed: true") == 2
    same(Models(raw).int_lead_opportunity_joined, models_small.int_lead_opportunity_joined)
    hot = Models(raw, hot_key_rows=1).int_lead_opportunity_joined
    same(hot, models_small.int_lead_opportunity_joined)
    doubled = RawSources(raw.leads.unionAll(raw.leads), raw.opportunities, raw.expenses_advertising, raw.expenses_salary)
    assert Models(doubled).int_lead_opportunity_joined.count() == 2 * models_small.int_lead_opportunity_joined.count()
    spark.sql(f"DROP DATABASE {db} CASCADE")
