"""Property tests: Spark operators against brute-force Python models on
random inputs (each generated batch runs as one Spark job)."""

from __future__ import annotations

import datetime as dt
import re
from decimal import ROUND_HALF_UP, Decimal, InvalidOperation

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from funnelworks.functions import columns as C
from funnelworks.operators import frames as FR

SETTINGS = settings(
    max_examples=int(__import__("os").environ.get("PROPERTY_EXAMPLES", "15")),
    deadline=None,
    derandomize=not __import__("os").environ.get("PROPERTY_RANDOM"),
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)

# --- currency text ---------------------------------------------------------

_PIECES = ["US$", " ", "\u00a0", "\t", ",", ".", "-", "0", "1", "5", "9", "12", "345", "$"]
_NUMBER = re.compile(r"^[+-]?(\d+\.?\d*|\.\d+)$")


def currency_model(text: str | None) -> Decimal | None:
    """The macro: drop 'US$', then spaces, NBSP and tabs; ',' -> '.'; parse or null; round half-up to 2."""
    if text is None:
        return None
    s = text.replace("US$", "")
    for ch in (" ", "\u00a0", "\t"):
        s = s.replace(ch, "")
    s = s.replace(",", ".")
    if not _NUMBER.match(s):
        return None
    try:
        v = Decimal(s).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)
    except InvalidOperation:
        return None
    return v if len(v.as_tuple().digits) <= 38 else None


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(_PIECES), max_size=8).map("".join)), min_size=1, max_size=40))
def test_parse_currency_matches_model(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    got = [r[0] for r in df.select(C.parse_currency("x")).collect()]
    assert got == [currency_model(t) for t in texts]


# --- dedupe ------------------------------------------------------------------

_ROW = st.tuples(
    st.sampled_from(["a", "b", "c", "d"]),
    st.one_of(st.none(), st.integers(0, 3)),
    st.one_of(st.none(), st.sampled_from(["x", "y", "z"])),
)


def dedupe_model(rows):
    """Per key: t DESC NULLS FIRST, then v ASC NULLS FIRST; first row wins."""
    out = {}
    for k in {r[0] for r in rows}:
        group = [r for r in rows if r[0] == k]
        group.sort(key=lambda r: (r[1] is not None, -(r[1] or 0), r[2] is not None, r[2] or ""))
        out[k] = group[0]
    return out


@SETTINGS
@given(st.lists(_ROW, min_size=1, max_size=30), st.integers(1, 5))
def test_dedupe_latest_matches_model(spark, rows, parts):
    df = spark.createDataFrame(rows, "k string, t int, v string").repartition(parts)
    got = {r.k: tuple(r) for r in FR.dedupe_latest(df, "k", ["t DESC NULLS FIRST"], tiebreak=["v"]).collect()}
    want = dedupe_model(rows)
    # rows equal on (t, v) are indistinguishable, so compare the chosen (t, v)
    assert {k: v[1:] for k, v in got.items()} == {k: v[1:] for k, v in want.items()}


# --- month spine -------------------------------------------------------------


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.dates(dt.date(2000, 1, 1), dt.date(2030, 12, 31)).map(lambda d: d.replace(day=1))), max_size=12))
def test_month_spine_matches_model(spark, months):
    df = spark.createDataFrame([(m,) for m in months], "m date")
    got = [r.m for r in FR.month_spine(df, "m").orderBy("m").collect()]
    present = [m for m in months if m is not None]
    want = []
    if present:
        y, mo = min(present).year, min(present).month
        hi = max(present)
        while (y, mo) <= (hi.year, hi.month):
            want.append(dt.date(y, mo, 1))
            y, mo = (y + 1, 1) if mo == 12 else (y, mo + 1)
    assert got == want


# --- buckets and day differences ---------------------------------------------


def speed_model(d):
    if d is None:
        return "8_plus_days"
    if d <= 0:
        return "same_day"
    if d == 1:
        return "next_day"
    if 2 <= d <= 7:
        return "2_to_7_days"
    return "8_plus_days"


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.integers(-30, 30)), min_size=1, max_size=40))
def test_speed_bucket_matches_model(spark, days):
    df = spark.createDataFrame([(d,) for d in days], "d int")
    assert [r[0] for r in df.select(C.speed_to_lead_bucket("d")).collect()] == [speed_model(d) for d in days]


@SETTINGS
@given(st.lists(st.tuples(st.one_of(st.none(), st.datetimes(dt.datetime(2020, 1, 1), dt.datetime(2030, 1, 1))),
                          st.one_of(st.none(), st.dates(dt.date(2020, 1, 1), dt.date(2030, 1, 1)))),
                min_size=1, max_size=30))
def test_days_between_matches_model(spark, pairs):
    df = spark.createDataFrame(pairs, "a timestamp_ntz, b date")
    got = [r[0] for r in df.select(C.days_between("a", "b")).collect()]
    want = [None if a is None or b is None else (b - a.date()).days for a, b in pairs]
    assert got == want


# --- hot-key join ------------------------------------------------------------


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.sampled_from(["k0", "k1", "k2", "k9"])), min_size=1, max_size=60),
       st.integers(1, 6))
def test_sparse_key_join_matches_plain_join(spark, keys, budget):
    left = spark.createDataFrame([(f"L{i}", k) for i, k in enumerate(keys)], "lead string, fk string")
    right = spark.createDataFrame([("k0", 0), ("k1", 1), ("k2", 2)], "oid string, val int")
    want = sorted(map(tuple, left.join(right, left.fk == right.oid, "left").collect()), key=str)
    for strategy in ("split", "salt"):
        got = FR.left_join_sparse_key(left, right, "fk", "oid", strategy=strategy, salt_col="lead",
                                      hot_key_rows=budget)
        assert sorted(map(tuple, got.collect()), key=str) == want


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5)), min_size=1, max_size=30))
def test_exact_avg_matches_model(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x int")
    got = df.agg(C.exact_avg("x")).first()[0]
    vals = [x for x in xs if x is not None]
    assert got == (float(sum(vals)) / len(vals) if vals else None)
    assert df.agg(F.count_if(F.col("x") > 0)).first()[0] == sum(1 for x in vals if x > 0)


@SETTINGS
@given(st.lists(st.tuples(st.integers(-(10**9), 10**18), st.integers(1, 50)), min_size=1, max_size=25))
def test_mean_of_ratios_matches_model(spark, pairs):
    """Each total/count rounded half away from zero at 8 decimals, summed
    exactly, the sum as a double divided once."""
    from fractions import Fraction

    from funnelworks.plans.marts import mean_of_ratios_sql

    rows = [(Decimal(t).scaleb(-4), n) for t, n in pairs]
    df = spark.createDataFrame(rows, "total decimal(38,4), n bigint")
    got = df.select(F.expr(mean_of_ratios_sql("total", "n"))).first()[0]
    q = [(1 if t >= 0 else -1) * int(abs(Fraction(t)) * 10**8 / n + Fraction(1, 2)) for t, n in rows]
    assert got == float(Fraction(sum(q), 10**8)) / len(q)
    exact = sum(Fraction(t) / n for t, n in rows) / len(rows)
    assert abs(got - float(exact)) <= 1e-8 + 1e-15 * abs(float(exact))


# --- data-quality operators ----------------------------------------------------

_VALS = st.one_of(st.none(), st.sampled_from(["a", "b", "c", "x", "y"]))


@SETTINGS
@given(st.lists(_VALS, min_size=1, max_size=40), st.lists(_VALS, max_size=10))
def test_quality_checks_match_model(spark, child, parent):
    from collections import Counter

    from funnelworks.operators import quality as Q

    cdf = spark.createDataFrame([(v,) for v in child], "c string")
    pdf = spark.createDataFrame([(v,) for v in parent], "p string")
    counts = Counter(v for v in child if v is not None)
    allowed = ["a", "b"]
    got = {r.test: r.violations for r in Q.profile_checks(cdf, "m", ["c"], {"c": allowed}).collect()}
    assert got == {
        "not_null": sum(v is None for v in child),
        "accepted_values": len({v for v in child if v is not None and v not in allowed}),
    }
    assert Q.unique_check(cdf, "m", "c").first().violations == sum(1 for n in counts.values() if n > 1)
    parents = {v for v in parent if v is not None}
    orphans = sum(1 for v in child if v is not None and v not in parents)
    assert Q.relationship_check(cdf, "m", "c", pdf, "p").first().violations == orphans


@SETTINGS
@given(st.lists(st.integers(-10**6, 10**6), max_size=20), st.lists(st.integers(-10**6, 10**6), max_size=20))
def test_reconcile_matches_model(spark, src, mdl):
    from funnelworks.operators import quality as Q

    s = spark.createDataFrame([(Decimal(v).scaleb(-2),) for v in src], "v decimal(38,2)")
    m = spark.createDataFrame([(Decimal(v).scaleb(-2),) for v in mdl], "w decimal(38,2)")
    r = Q.reconcile(s, "v", m, "w").first()
    st_, mt = sum(Decimal(v).scaleb(-2) for v in src), sum(Decimal(v).scaleb(-2) for v in mdl)
    assert (r.source_total, r.model_total) == (st_, mt)
    assert r.violations == (1 if abs(st_ - mt) > Decimal("0.01") else 0)


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.sampled_from(["k0", "k1", "k2"])), min_size=1, max_size=40),
       st.lists(st.sampled_from(["k0", "k1", "k9"]), max_size=6), st.integers(1, 4))
def test_hot_key_join_exact_with_duplicate_right_keys(spark, keys, right_keys, budget):
    left = spark.createDataFrame([(f"L{i}", k) for i, k in enumerate(keys)], "lead string, fk string")
    right = spark.createDataFrame([(k, i) for i, k in enumerate(right_keys)], "oid string, val int")
    want = sorted(map(tuple, left.join(right, left.fk == right.oid, "left").collect()), key=str)
    got = FR.left_join_sparse_key(left, right, "fk", "oid", strategy="split", hot_key_rows=budget)
    assert sorted(map(tuple, got.collect()), key=str) == want
