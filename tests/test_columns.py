"""Golden values and branch coverage of the Column -> Column functions."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from funnelworks.functions import columns as C

NB = "\u00a0"


def one_col(spark, values, dtype, expr):
    df = spark.createDataFrame([(v,) for v in values], f"x {dtype}")
    return [r[0] for r in df.select(expr("x")).collect()]


CURRENCY_GOLDEN = [
    (f"US$ 1{NB}234,56", Decimal("1234.56")),
    (f"US${NB}39{NB}900,69", Decimal("39900.69")),
    ("US$ 696,80\t", Decimal("696.80")),
    ("US$1,234", Decimal("1.23")),
    ("US$ 1.234,56", None),
    ("$1,234", None),
    ("-US$ 5,00", Decimal("-5.00")),
    ("12.345", Decimal("12.35")),
    ("-0.005", Decimal("-0.01")),
    ("1e3", Decimal("1000.00")),
    ("", None),
    ("n/a", None),
    ("US$", None),
    (None, None),
    # 'US$' is removed before spaces: 'U S$1' keeps its letters and fails
    ("U S$1", None),
]


def test_parse_currency_golden(spark):
    got = one_col(spark, [v for v, _ in CURRENCY_GOLDEN], "string", C.parse_currency)
    assert got == [e for _, e in CURRENCY_GOLDEN]


def test_parse_currency_type(spark):
    df = spark.createDataFrame([("1",)], "x string").select(C.parse_currency("x").alias("v"))
    assert df.schema["v"].dataType.simpleString() == "decimal(38,2)"


def test_parse_month_golden(spark):
    values = ["Jan-24", "jan-24", "JAN-24", "Jan-85", "bad", "January-24", "Sept-24", "Jan-2024", "", " Jan-24", None]
    got = one_col(spark, values, "string", C.parse_month)
    d = dt.date
    assert got == [d(2024, 1, 1), d(2024, 1, 1), d(2024, 1, 1), d(2085, 1, 1)] + [None] * 7


def test_fix_year_offset_keeps_leap_day(spark):
    got = one_col(spark, [dt.date(24, 2, 29), dt.date(24, 1, 31), None], "date", C.fix_year_offset)
    assert got == [dt.date(2024, 2, 29), dt.date(2024, 1, 31), None]


def test_fix_year_offset_is_unconditional(spark):
    # a date that is already right still moves (kept as in the reference)
    assert one_col(spark, [dt.date(2024, 5, 1)], "date", C.fix_year_offset) == [dt.date(4024, 5, 1)]


def test_ltv_formula_golden(spark):
    got = one_col(spark, [Decimal("30000"), Decimal("3000"), None], "decimal(38,2)", C.estimated_ltv)
    assert got == [Decimal("48000.0000"), Decimal("15600.0000"), Decimal("12000.0000")]


def test_safe_div(spark):
    df = spark.createDataFrame([(1, 0), (1, 4), (None, 0), (3, None), (0, 0)], "a long, b long")
    got = [r[0] for r in df.select(C.safe_div("a", "b")).collect()]
    assert got == [0.0, 0.25, 0.0, None, 0.0]


def test_exact_avg_matches_definition_and_skips_nulls(spark):
    df = spark.createDataFrame([(1, 1), (1, None), (1, 2), (2, None)], "g int, x int")
    got = dict(df.groupBy("g").agg(C.exact_avg("x").alias("a")).collect())
    assert got == {1: 1.5, 2: None}


def test_exact_avg_independent_of_partitioning(spark):
    df = spark.range(0, 5000).select((F.col("id") % 7).alias("g"), (F.col("id") * 0.01).cast("decimal(38,2)").alias("x"))
    a = sorted(df.repartition(1).groupBy("g").agg(C.exact_avg("x")).collect())
    b = sorted(df.repartition(37).groupBy("g").agg(C.exact_avg("x")).collect())
    assert a == b


def test_days_between_order_and_timestamps(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2024, 1, 1, 23, 0), dt.date(2024, 1, 2)), (None, dt.date(2024, 1, 2))],
        "a timestamp_ntz, b date",
    )
    assert [r[0] for r in df.select(C.days_between("a", "b")).collect()] == [1, None]


@pytest.mark.parametrize(
    "days,label",
    [(-3, "same_day"), (0, "same_day"), (1, "next_day"), (2, "2_to_7_days"), (7, "2_to_7_days"),
     (8, "8_plus_days"), (None, "8_plus_days")],
)
def test_speed_bucket(spark, days, label):
    assert one_col(spark, [days], "int", C.speed_to_lead_bucket) == [label]


def test_sales_tier(spark):
    vals = [None, Decimal("4999.99"), Decimal("5000"), Decimal("14999.99"), Decimal("15000"), Decimal("29999.99"),
            Decimal("30000")]
    got = one_col(spark, vals, "decimal(38,2)", C.predicted_sales_tier)
    assert got == ["unknown", "tier_1_under_5k", "tier_2_5k_to_15k", "tier_2_5k_to_15k", "tier_3_15k_to_30k",
                   "tier_3_15k_to_30k", "tier_4_30k_plus"]


def test_bucketize_validates_labels():
    with pytest.raises(ValueError):
        C.bucketize("x", [1, 2], ["a", "b"])


def test_stage_category(spark):
    vals = ["Closed Won", "closed won - upsell", "CLOSED LOST - no response", "Demo Set", None, "won"]
    assert one_col(spark, vals, "string", C.stage_category) == [
        "closed_won", "closed_won", "closed_lost", "open", "open", "open"]


def test_resolve_stage_first_match(spark):
    rows = [
        ("closed_won", "O1", dt.date(2024, 1, 1), dt.date(2024, 1, 1)),
        ("closed_lost", "O1", None, None),
        ("open", "O1", None, None),
        (None, None, dt.date(2024, 1, 1), None),
        (None, None, None, dt.date(2024, 1, 1)),
        (None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "cat string, opp string, meet date, call date")
    got = [r[0] for r in df.select(C.resolve_stage("cat", "opp", "meet", "call")).collect()]
    assert got == ["closed_won", "closed_lost", "opportunity_open", "meeting_booked", "contacted", "new_lead"]


def test_parse_currency_independent_of_literal_escaping(spark):
    values = [v for v, _ in CURRENCY_GOLDEN]
    spark.conf.set("spark.sql.parser.escapedStringLiterals", "true")
    try:
        got = one_col(spark, values, "string", C.parse_currency)
    finally:
        spark.conf.set("spark.sql.parser.escapedStringLiterals", "false")
    assert got == [e for _, e in CURRENCY_GOLDEN]
