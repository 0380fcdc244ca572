"""The 40 declared data tests on the sf0.001 fixture."""

from __future__ import annotations

from funnelworks.plans import quality_suite


def test_summary_has_40_checks_with_expected_counts(models_small):
    rows = quality_suite.run_checks(models_small).collect()
    assert len(rows) == 40
    got = {(r.model, r.test, r.column_name): r.violations for r in rows}
    assert len(got) == 40
    failing = {k: v for k, v in got.items() if v}
    # declared expectations the models knowingly contradict (reported, not raised)
    assert failing == {
        ("opportunities", "unique", "opportunity_id"): 5,
        ("leads", "not_null", "form_submission_date"): 1000,
        ("stg_leads", "not_null", "lead_created_date"): 200,
    }


def test_check_counts_by_kind(models_small):
    rows = quality_suite.run_checks(models_small).collect()
    kinds = {}
    for r in rows:
        kind = r.test if not r.test.startswith("assert_") else "reconcile"
        kinds[kind] = kinds.get(kind, 0) + 1
    assert kinds == {
        "unique": 6, "not_null": 19, "accepted_values": 10, "relationships": 1,
        "unique_combination_of_columns": 1, "reconcile": 3,
    }


def test_accepted_values_counts_distinct_bad_values(spark):
    from funnelworks.operators.quality import accepted_values_check, profile_checks

    df = spark.createDataFrame([("a",), ("x",), ("x",), ("y",), (None,)], "c string")
    assert accepted_values_check(df, "m", "c", ["a"]).first().violations == 2
    prof = {r.test: r.violations for r in profile_checks(df, "m", ["c"], {"c": ["a"]}).collect()}
    assert prof == {"not_null": 1, "accepted_values": 2}


def test_relationship_counts_orphan_rows(spark):
    from funnelworks.operators.quality import relationship_check

    child = spark.createDataFrame([("k1",), ("k2",), ("k2",), (None,)], "fk string")
    parent = spark.createDataFrame([("k1",)], "pk string")
    assert relationship_check(child, "c", "fk", parent, "pk").first().violations == 2


def test_unique_ignores_nulls(spark):
    from funnelworks.operators.quality import unique_check

    df = spark.createDataFrame([(None,), (None,), ("a",), ("a",), ("b",)], "c string")
    assert unique_check(df, "m", "c").first().violations == 1
