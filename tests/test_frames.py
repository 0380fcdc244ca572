"""DataFrame operators: semantics and the properties that matter at scale."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from funnelworks.operators import frames as FR


def test_dedupe_latest_nulls_first_then_latest(spark):
    rows = [
        ("a", dt.datetime(2024, 1, 1), "old"),
        ("a", dt.datetime(2024, 2, 1), "new"),
        ("b", dt.datetime(2024, 2, 1), "dated"),
        ("b", None, "undated"),  # NULL sorts first on DESC in the reference dialect
        ("c", None, "only"),
    ]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v string")
    got = dict((r.k, r.v) for r in FR.dedupe_latest(df, "k", ["ts DESC NULLS FIRST"]).collect())
    assert got == {"a": "new", "b": "undated", "c": "only"}


def test_dedupe_latest_ties_are_deterministic(spark):
    rows = [("a", 1, "z"), ("a", 1, "m"), ("a", 1, "b")]
    df = spark.createDataFrame(rows, "k string, t int, v string")
    for n in (1, 3):
        out = FR.dedupe_latest(df.repartition(n), "k", ["t DESC"]).collect()
        assert [r.v for r in out] == ["b"]


def test_dedupe_plans_partial_limit_before_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("t"))
    plan = FR.dedupe_latest(df, "k", ["t DESC"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_month_spine_fills_gaps_and_handles_empty(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 4, 1),), (None,)], "m date")
    got = [r.m for r in FR.month_spine(df, "m").orderBy("m").collect()]
    assert got == [dt.date(2024, m, 1) for m in (1, 2, 3, 4)]
    empty = spark.createDataFrame([(None,)], "m date")
    assert FR.month_spine(empty, "m").count() == 0


def test_unpivot_single_scan(spark):
    df = spark.createDataFrame([(1, 10, 20)], "id int, a int, b int")
    out = FR.unpivot(df, ["id"], "label", ["v"], [("a", ["a"]), ("b", ["b"])])
    assert sorted(map(tuple, out.collect())) == [(1, "a", 10), (1, "b", 20)]
    assert "Generate" in out._jdf.queryExecution().executedPlan().toString()


def test_unpivot_validates_branch_width():
    with pytest.raises(ValueError):
        FR.unpivot(None, ["id"], "label", ["v", "w"], [("a", ["a"])])


def test_share_within(spark):
    df = spark.createDataFrame([("x", 1), ("x", 3), ("y", 0)], "g string, n long")
    got = sorted(map(tuple, FR.share_within(df, "n", ["g"], "s").collect()))
    assert got == [("x", 1, 0.25), ("x", 3, 0.75), ("y", 0, None)]


def _sparse_inputs(spark):
    left = spark.createDataFrame(
        [(f"L{i}", None if i % 5 else f"O{i}") for i in range(200)] + [("L_dangling", "O_missing")],
        "lead string, fk string",
    )
    right = spark.createDataFrame([(f"O{i}", i) for i in range(0, 200, 5)], "oid string, val int")
    return left, right


@pytest.mark.parametrize("strategy", ["split", "salt", "plain"])
def test_left_join_sparse_key_strategies_agree(spark, strategy):
    left, right = _sparse_inputs(spark)
    expected = sorted(map(tuple, left.join(right, left.fk == right.oid, "left").collect()), key=str)
    got = FR.left_join_sparse_key(left, right, "fk", "oid", strategy=strategy, salt_col="lead")
    assert got.columns == ["lead", "fk", "oid", "val"]
    assert sorted(map(tuple, got.collect()), key=str) == expected


def test_left_join_sparse_key_spreads_null_keys(spark):
    """Salted null keys must not pile into one reducer (plain join does)."""
    left, right = _sparse_inputs(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        def biggest_partition(df):
            return max(df.rdd.glom().map(len).collect())

        plain = FR.left_join_sparse_key(left, right, "fk", "oid", strategy="plain")
        salted = FR.left_join_sparse_key(left, right, "fk", "oid", strategy="salt", salt_col="lead")
        assert biggest_partition(plain) >= 160  # all 160 null keys in one task
        assert biggest_partition(salted) < 80
        split = FR.left_join_sparse_key(left, right, "fk", "oid", strategy="split")
        plan = split._jdf.queryExecution().executedPlan().toString()
        # the null-key branch is a plain scan + filter appended by Union
        assert "Union" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_left_join_sparse_key_rejects_clashing_names(spark):
    left = spark.createDataFrame([("a", "b")], "x string, k string")
    right = spark.createDataFrame([("a", "b")], "x string, k2 string")
    with pytest.raises(ValueError):
        FR.left_join_sparse_key(left, right, "k", "k2")


def _hot_inputs(spark):
    # key "H" holds 100 of 130 keyed rows (a hot key), plus cold keys and one orphan
    rows = [(f"L{i}", "H") for i in range(100)] + [(f"C{i}", f"K{i % 10}") for i in range(30)]
    rows += [("X", "missing")]
    left = spark.createDataFrame(rows, "lead string, fk string")
    right = spark.createDataFrame([("H", -1)] + [(f"K{i}", i) for i in range(10)], "oid string, val int")
    return left, right


def test_skew_safe_join_equals_plain_join(spark):
    left, right = _hot_inputs(spark)
    expected = sorted(map(tuple, left.join(right, left.fk == right.oid, "left").collect()), key=str)
    got = FR.skew_safe_left_join(left, right, "fk", "oid", hot_key_rows=10)
    assert got.columns == ["lead", "fk", "oid", "val"]
    assert sorted(map(tuple, got.collect()), key=str) == expected


def test_skew_safe_join_spreads_a_hot_key(spark):
    left, right = _hot_inputs(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        def biggest_partition(df):
            return max(df.rdd.glom().map(len).collect())

        plain = left.join(right, left.fk == right.oid, "left")
        salted = FR.skew_safe_left_join(left, right, "fk", "oid", hot_key_rows=10)
        assert biggest_partition(plain) >= 100
        assert biggest_partition(salted) <= 60
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_split_join_uses_hot_key_path(spark):
    left, right = _hot_inputs(spark)
    expected = sorted(map(tuple, left.join(right, left.fk == right.oid, "left").collect()), key=str)
    got = FR.left_join_sparse_key(left, right, "fk", "oid", strategy="split", salt_col="lead", hot_key_rows=10)
    assert sorted(map(tuple, got.collect()), key=str) == expected
