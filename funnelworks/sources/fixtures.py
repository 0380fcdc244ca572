"""Derive the four raw go-to-market inputs from the driver's ``orders`` table.

The reference ships no data, so tests and benchmarks use a deterministic,
integer-only mapping of ``orders`` (FIXTURES.md section 2).  It is a pure
projection plus one small aggregate, so the derived inputs grow with
``orders``.  The rules are written as Spark SQL expressions (one parse per
column) over a few shared integer terms computed once per row.  The DuckDB
oracle computes the same rows independently (``oracle/fixture.py``).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelworks.sources import schemas

NBSP = "chr(160)"  # SQL expressions, independent of string-literal escaping
TAB = "chr(9)"


def _ts(days: str, hour: str) -> str:
    """timestamp_ntz at ``days`` after ``bd``, hour ``hour``."""
    return f"timestampadd(HOUR, {hour}, cast(date_add(bd, cast({days} AS INT)) AS TIMESTAMP_NTZ))"


def _low(d: str) -> str:
    """The date 2000 years earlier (the raw tables store years too low)."""
    return f"add_months({d}, -24000)"


def _pad(x: str, n: int) -> str:
    return f"lpad(cast({x} AS STRING), {n}, '0')"


def _s(x: str) -> str:
    return f"cast({x} AS STRING)"


def _case(x: str, values: list) -> str:
    """values[x] for x in 0..len-1 (None entries give null)."""
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None)
    return f"CASE {x} {arms} END"


_LEADS = {
    "lead_id": "'L' || " + _s("k"),
    "converted_opportunity_id": "CASE WHEN k % 5 = 0 THEN 'O' || " + _s("k") + " END",
    "form_submission_date": f"CASE WHEN k % 3 = 0 THEN {_low('bd')} END",
    "first_sales_call_date": f"CASE WHEN k % 10 < 7 THEN {_ts('k % 11', 'k % 24')} END",
    "first_text_sent_date": f"CASE WHEN k % 4 = 1 THEN {_ts('k % 5', 'k % 13')} END",
    "first_meeting_booked_date": f"CASE WHEN k % 5 < 2 THEN {_ts('12 + k % 9', '9')} END",
    "last_sales_call_date": f"CASE WHEN k % 10 < 7 THEN {_ts('13 + k % 20', '8')} END",
    "last_sales_activity_date": f"CASE WHEN k % 29 <> 0 THEN {_ts('15 + k % 30', '17')} END",
    "last_sales_email_date": f"CASE WHEN k % 6 < 4 THEN {_ts('14 + k % 25', '11')} END",
    "sales_call_count": "CASE WHEN k % 13 <> 0 THEN k % 17 END",
    "sales_text_count": "CASE WHEN k % 11 <> 0 THEN k % 7 END",
    "sales_email_count": "CASE WHEN k % 19 <> 0 THEN k % 5 END",
    "predicted_sales_with_owner": (
        "CASE WHEN k % 12 = 0 THEN NULL WHEN k % 12 = 1 THEN 'n/a' WHEN k % 12 = 2 THEN 'US$ 1.234,56' "
        f"WHEN cents >= 100000 THEN 'US$' || {NBSP} || {_s('cents div 100000')} || {NBSP} || "
        f"{_pad('(cents div 100) % 1000', 3)} || ',' || {_pad('cents % 100', 2)} "
        f"ELSE 'US$ ' || {_s('cents div 100')} || ',' || {_pad('cents % 100', 2)} || {TAB} END"
    ),
    "marketplaces_used": _case("k % 4", ['["MarketA"]', '["MarketA", "MarketB"]', "[]", None]),
    "online_ordering_used": _case("k % 3", ['["Direct"]', '["OrderX"]', None]),
    "cuisine_types": (
        "CASE WHEN k % 9 = 0 THEN NULL WHEN k % 9 = 1 THEN '[\"Pizza\"]' "
        "WHEN k % 9 = 2 THEN '[\"Pizza\", \"Italian\"]' ELSE '[\"Thai\", \"Vegan\", \"Bar\"]' END"
    ),
    "location_count": "CASE WHEN k % 31 <> 0 THEN 1 + k % 4 END",
    "connected_with_decision_maker": "CASE WHEN k % 8 <> 0 THEN k % 7 < 2 END",
    "status": "CASE st WHEN 'F' THEN 'Converted' WHEN 'O' THEN 'Working' ELSE 'New' END",
}

_OPPORTUNITIES = {
    "opportunity_id": "'O' || " + _s("k"),
    "account_id": "CASE WHEN k % 35 <> 0 THEN 'A' || " + _s("c") + " END",
    "stage_name": _case("s", ["Closed Won", "Closed Lost", "CLOSED LOST - no response", "Demo Set"]),
    "lost_reason_c": "CASE WHEN s IN (1, 2) THEN "
    + _case("j % 7", ["Price", "Timing", "Competitor", "Price", "No Decision", "Unknown / Not Specified", None])
    + " END",
    "closed_lost_notes_c": "CASE WHEN s IN (1, 2) AND j % 2 = 0 THEN 'note ' || " + _s("j") + " END",
    "business_issue_c": _case("j % 3", ["Commission fees", "Low traffic", None]),
    "how_did_you_hear_about_us_c": _case("j % 4", ["Google", "Referral", "Facebook", None]),
    "demo_held": "CASE WHEN s = 0 THEN true WHEN s IN (1, 2) THEN j % 6 < 4 END",
    "demo_set_date": f"CASE WHEN j % 23 <> 0 THEN {_low('date_add(bd, cast(20 + j % 6 AS INT))')} END",
    "demo_time": f"CASE WHEN s <> 3 THEN {_ts('24 + j % 8', '10 + j % 9')} END",
    "created_date": f"CASE WHEN NOT (dup = 1 AND k % 500 = 0) THEN {_ts('18 + j % 5 + 10 * dup', '12')} END",
    "close_date": f"CASE WHEN s <> 3 THEN {_low('date_add(bd, cast(30 + j % 60 AS INT))')} END",
    "last_sales_call_date_time": f"CASE WHEN j % 5 <> 0 THEN {_ts('22 + j % 9', '15')} END",
}


def _money_thousands(x: str) -> str:
    return (
        f"'US$ ' || {_s(f'{x} div 100000')} || {NBSP} || {_pad(f'({x} div 100) % 1000', 3)}"
        f" || ',' || {_pad(f'{x} % 100', 2)}"
    )


def _money_plain(x: str) -> str:
    return f"'US$ ' || {_s(f'{x} div 100')} || ',' || {_pad(f'{x} % 100', 2)}"


def _typed(exprs: dict[str, str], schema) -> list[str]:
    return [f"cast(({exprs[f.name]}) AS {f.dataType.simpleString()}) AS {f.name}" for f in schema.fields]


class RawSources:
    """The four raw inputs.  Each is built on first access, so a query that
    needs only the expense tables never plans the lead and opportunity
    mappings."""

    def __init__(
        self,
        leads: DataFrame | None = None,
        opportunities: DataFrame | None = None,
        expenses_advertising: DataFrame | None = None,
        expenses_salary: DataFrame | None = None,
        orders: DataFrame | None = None,
    ):
        self._given = {
            "leads": leads,
            "opportunities": opportunities,
            "expenses_advertising": expenses_advertising,
            "expenses_salary": expenses_salary,
        }
        self._orders = orders

    def __iter__(self):
        return iter([self.leads, self.opportunities, self.expenses_advertising, self.expenses_salary])

    def _pick(self, name: str, build) -> DataFrame:
        given = self._given[name]
        if given is not None:
            return given
        if self._orders is None:
            raise ValueError(f"raw table {name!r} was not given")
        return build(self._orders)

    @cached_property
    def leads(self) -> DataFrame:
        return self._pick("leads", leads)

    @cached_property
    def opportunities(self) -> DataFrame:
        return self._pick("opportunities", opportunities)

    @cached_property
    def expenses_advertising(self) -> DataFrame:
        return self._pick("expenses_advertising", expenses_advertising)

    @cached_property
    def expenses_salary(self) -> DataFrame:
        return self._pick("expenses_salary", expenses_salary)


def orders_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared integer terms of the mapping, one row per order."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.selectExpr(
        "o_orderkey AS k",
        "o_custkey AS c",
        "o_orderstatus AS st",
        "o_orderkey div 5 AS j",
        "add_months(to_date(o_orderdate), 336) AS bd",
    )


def leads(o: DataFrame) -> DataFrame:
    return o.selectExpr("*", "(k * 7919 + c * 104729) % 4000000 AS cents").selectExpr(
        *_typed(_LEADS, schemas.LEADS)
    )


def opportunities(o: DataFrame) -> DataFrame:
    rows = o.where("k % 5 = 0 AND k % 85 <> 0").selectExpr(
        "*", "explode(CASE WHEN k % 250 = 0 THEN array(0, 1) ELSE array(0) END) AS dup"
    )
    return rows.selectExpr("*", "(j + dup) % 4 AS s").selectExpr(*_typed(_OPPORTUNITIES, schemas.OPPORTUNITIES))


def _monthly(o: DataFrame) -> DataFrame:
    """One row per month of ``bd``: month text, S = sum of keys, month index."""
    g = o.groupBy(F.trunc("bd", "month").alias("m")).agg(F.sum("k").alias("S"))
    return g.selectExpr("date_format(m, 'MMM-yy') AS month", "S", "year(m) * 12 + month(m) AS mi")


def expenses_advertising(o: DataFrame) -> DataFrame:
    # (S * 31) mod 2000000 computed as ((S mod 2000000) * 31) mod 2000000: same value, no overflow
    g = _monthly(o).where("mi % 17 <> 5").selectExpr("month", "5000000 + ((S % 2000000) * 31) % 2000000 AS a")
    exprs = {"month": "month", "advertising": _money_thousands("a")}
    return g.selectExpr(*_typed(exprs, schemas.EXPENSES_ADVERTISING))


def expenses_salary(o: DataFrame) -> DataFrame:
    g = _monthly(o).where("mi % 17 <> 5 AND mi % 19 <> 7").selectExpr(
        "month",
        "3800000 + ((S % 1200000) * 17) % 1200000 AS o",
        "2000000 + ((S % 900000) * 13) % 900000 AS i",
    )
    exprs = {"month": "month", "outbound_sales_team": _money_plain("o"), "inbound_sales_team": _money_plain("i")}
    return g.selectExpr(*_typed(exprs, schemas.EXPENSES_SALARY))


def raw_sources_from_orders(spark: SparkSession, sf_dir: str) -> RawSources:
    return RawSources(orders=orders_terms(spark, sf_dir))
