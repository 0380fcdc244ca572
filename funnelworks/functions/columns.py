"""Column building blocks.

Each helper comes in two forms: ``<name>_sql`` returns Spark SQL expression
text (so helpers compose, e.g. ``safe_div(count_where_sql(p), "count(*)")``)
and ``<name>`` wraps it in a :class:`Column` with ``F.expr``.  Arguments are
SQL expressions too: a column name or any expression text.

Why text: the resulting Catalyst expressions are identical to the
``functions`` API ones, but building them costs one call into the JVM
instead of one per operator, which matters for the wide projections and the
dozens of aggregates of the marts (plan construction otherwise dominates the
run time of small inputs).

All expressions stay inside whole-stage codegen, need no Python at run time
and are safe under ANSI mode (parsing uses ``try_*`` and every division is
guarded).
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from funnelworks import config
from funnelworks.config import DEFAULT, Assumptions


def _q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


# ---------------------------------------------------------------------------
# The two macros of the reference
# ---------------------------------------------------------------------------


def fix_year_offset_sql(c: str, years: int = DEFAULT.year_offset) -> str:
    return f"add_months({c}, {12 * years})"


def fix_year_offset(c: str, years: int = DEFAULT.year_offset) -> Column:
    """Add ``years`` to a date whose year was stored too low (0024 -> 2024).

    ``add_months`` by a whole number of years keeps Feb 29 valid because the
    offset (2000) is a multiple of 400.  Applied unconditionally, as in the
    reference: a date that is already correct moves as well.
    """
    return F.expr(fix_year_offset_sql(c, years))


def parse_currency_sql(
    c: str, precision: int = DEFAULT.currency_precision, scale: int = DEFAULT.currency_scale
) -> str:
    no_prefix = f"replace({c}, {_q(config.CURRENCY_PREFIX)}, '')"
    # translate: ',' -> '.', the remaining matching characters are deleted.
    # Characters are spelled with chr() so the expression does not depend on
    # how the session unescapes string literals; Catalyst folds it to a constant.
    matching = config.CURRENCY_DECIMAL_COMMA + "".join(config.CURRENCY_DROP_CHARS)
    chars = ", ".join(f"chr({ord(ch)})" for ch in matching)
    return f"try_cast(translate({no_prefix}, concat({chars}), '.') AS DECIMAL({precision},{scale}))"


def parse_currency(
    c: str, precision: int = DEFAULT.currency_precision, scale: int = DEFAULT.currency_scale
) -> Column:
    """Currency text -> decimal(precision, scale), or null when unparseable.

    Remove the 'US$' prefix first, then spaces, U+00A0 and tabs, then read a
    comma as the decimal point.  The four single-character edits commute, so
    one ``translate`` does them in a single pass.  Extra fraction digits are
    rounded half-up by the cast; '1.234,56' becomes '1.234.56' and so null.
    """
    return F.expr(parse_currency_sql(c, precision, scale))


# ---------------------------------------------------------------------------
# Parsing, dates, arithmetic
# ---------------------------------------------------------------------------


def parse_month_sql(c: str, fmt: str = config.MONTH_TEXT_FORMAT) -> str:
    return f"try_to_date({c}, {_q(fmt)})"


def parse_month(c: str, fmt: str = config.MONTH_TEXT_FORMAT) -> Column:
    """'Jan-24' -> 2024-01-01 (any letter case); null when it does not parse."""
    return F.expr(parse_month_sql(c, fmt))


def month_start_sql(c: str) -> str:
    return f"trunc({c}, 'MM')"


def month_start(c: str) -> Column:
    """First day of the month, as a DATE (``date_trunc`` would give a timestamp)."""
    return F.expr(month_start_sql(c))


def days_between_sql(start: str, end: str) -> str:
    return f"datediff({end}, {start})"


def days_between(start: str, end: str) -> Column:
    """Calendar days from ``start`` to ``end`` (end - start); null if either is null.

    Note the argument order: Spark's ``datediff`` takes (end, start).
    Timestamps are compared by their calendar date.
    """
    return F.expr(days_between_sql(start, end))


def safe_div_sql(numerator: str, denominator: str) -> str:
    return (
        f"CASE WHEN ({denominator}) = 0 THEN CAST(0.0 AS DOUBLE) "
        f"ELSE CAST({numerator} AS DOUBLE) / CAST({denominator} AS DOUBLE) END"
    )


def safe_div(numerator: str, denominator: str) -> Column:
    """Division that returns 0 for a zero denominator (null stays null).

    Both operands are read as double so the result type does not depend on
    the input decimal widths.  ``CASE`` is lazy, so the division is never
    evaluated for a zero denominator even with ANSI on.
    """
    return F.expr(safe_div_sql(numerator, denominator))


def guarded_div_sql(numerator: str, denominator: str, when: str) -> str:
    return f"CASE WHEN {when} THEN CAST({numerator} AS DOUBLE) / CAST({denominator} AS DOUBLE) END"


def guarded_div(numerator: str, denominator: str, when: str) -> Column:
    """``numerator / denominator`` as double where ``when`` holds, else null."""
    return F.expr(guarded_div_sql(numerator, denominator, when))


def exact_avg_sql(c: str) -> str:
    return f"CASE WHEN count({c}) > 0 THEN CAST(sum({c}) AS DOUBLE) / count({c}) END"


def exact_avg(c: str) -> Column:
    """Average that skips nulls and is independent of partitioning.

    The sum is exact (long or decimal) whatever the order rows arrive in, and
    there is a single rounding, the final division in double.  Null when there
    is no non-null input, like ``avg``.
    """
    return F.expr(exact_avg_sql(c))


def count_where_sql(predicate: str) -> str:
    return f"count_if({predicate})"


def count_where(predicate: str) -> Column:
    """Number of rows where ``predicate`` is true (null counts as false)."""
    return F.expr(count_where_sql(predicate))


def named_aggs(spec: dict[str, str]) -> list[Column]:
    """``{output name: SQL aggregate expression}`` -> aliased Columns for ``agg``."""
    return [F.expr(f"{sql} AS {name}") for name, sql in spec.items()]


def hash_with_texts_sql() -> str:
    """0, to add to a count of an aggregate that also has a ``max`` or ``min``
    of text.

    Text does not fit the fixed-width buffers of a hash aggregate, so Spark
    would sort the rows by their keys on both sides of the shuffle.  An
    aggregate with a function on objects hashes with a buffer that holds text
    as well, and this one collects nothing.  How many keys a task keeps before
    it sorts after all is ``spark.sql.objectHashAggregate.sortBased.fallbackThreshold``
    (raised in ``session.RECOMMENDED_CONF``).
    """
    return "size(collect_set(CAST(NULL AS INT)))"


# ---------------------------------------------------------------------------
# Classification
# ---------------------------------------------------------------------------


def first_match_sql(rules: Sequence[tuple[str, str]], default: str | None) -> str:
    """Label of the first rule whose predicate is true, else ``default``.

    A null predicate does not match, exactly like a searched ``CASE``.
    """
    default_sql = "NULL" if default is None else _q(default)
    if not rules:
        return default_sql
    arms = " ".join(f"WHEN {p} THEN {_q(label)}" for p, label in rules)
    return f"CASE {arms} ELSE {default_sql} END"


def first_match(rules: Sequence[tuple[str, str]], default: str | None) -> Column:
    return F.expr(first_match_sql(rules, default))


def bucketize_sql(
    c: str, upper_bounds: Sequence[float | int], labels: Sequence[str], null_label: str | None = None
) -> str:
    if len(labels) != len(upper_bounds) + 1:
        raise ValueError("need one more label than upper bounds")
    rules = [(f"{c} IS NULL", null_label)] if null_label is not None else []
    rules += [(f"{c} < {b}", lab) for b, lab in zip(upper_bounds, labels[:-1])]
    return first_match_sql(rules, labels[-1])


def bucketize(
    c: str, upper_bounds: Sequence[float | int], labels: Sequence[str], null_label: str | None = None
) -> Column:
    """Threshold bucketing: ``labels[i]`` for ``c < upper_bounds[i]`` (first hit),
    ``labels[-1]`` otherwise; ``null_label`` for null input.

    ``len(labels)`` must be ``len(upper_bounds) + 1``.
    """
    return F.expr(bucketize_sql(c, upper_bounds, labels, null_label))


def stage_category_sql(stage_name: str) -> str:
    return first_match_sql(
        [(f"{stage_name} ILIKE '%closed won%'", config.CLOSED_WON),
         (f"{stage_name} ILIKE '%closed lost%'", config.CLOSED_LOST)],
        config.OPEN,
    )


def stage_category(stage_name: str) -> Column:
    """closed_won / closed_lost / open from a free-text stage name (case-insensitive)."""
    return F.expr(stage_category_sql(stage_name))


def resolve_stage_sql(
    stage_category_col: str, opportunity_id: str, first_meeting_booked_date: str, first_sales_call_date: str
) -> str:
    return first_match_sql(
        [
            (f"{stage_category_col} = {_q(config.CLOSED_WON)}", "closed_won"),
            (f"{stage_category_col} = {_q(config.CLOSED_LOST)}", "closed_lost"),
            (f"{opportunity_id} IS NOT NULL", "opportunity_open"),
            (f"{first_meeting_booked_date} IS NOT NULL", "meeting_booked"),
            (f"{first_sales_call_date} IS NOT NULL", "contacted"),
        ],
        "new_lead",
    )


def resolve_stage(
    stage_category_col: str, opportunity_id: str, first_meeting_booked_date: str, first_sales_call_date: str
) -> Column:
    """Current funnel stage of a lead journey; the furthest stage wins.

    'contacted' tests the first *call* only: a lead reached by text alone stays
    'new_lead' (kept as in the reference).
    """
    return F.expr(
        resolve_stage_sql(stage_category_col, opportunity_id, first_meeting_booked_date, first_sales_call_date)
    )


def speed_to_lead_bucket_sql(days: str) -> str:
    same, nxt, week, late = config.SPEED_BUCKETS
    return first_match_sql([(f"{days} <= 0", same), (f"{days} = 1", nxt), (f"{days} BETWEEN 2 AND 7", week)], late)


def speed_to_lead_bucket(days_to_first_contact: str) -> Column:
    return F.expr(speed_to_lead_bucket_sql(days_to_first_contact))


def predicted_sales_tier_sql(predicted_monthly_sales: str) -> str:
    return bucketize_sql(
        predicted_monthly_sales, config.SALES_TIER_EDGES, config.SALES_TIER_LABELS,
        null_label=config.SALES_TIER_UNKNOWN,
    )


def predicted_sales_tier(predicted_monthly_sales: str) -> Column:
    return F.expr(predicted_sales_tier_sql(predicted_monthly_sales))


# ---------------------------------------------------------------------------
# Revenue model
# ---------------------------------------------------------------------------


def _dec(v: Decimal) -> str:
    """Exact decimal literal (Spark reads 0.05 as DECIMAL(2,2))."""
    return format(v, "f")


def transaction_revenue_sql(predicted_monthly_sales: str, a: Assumptions = DEFAULT) -> str:
    return f"CAST(coalesce({predicted_monthly_sales}, 0) * {_dec(a.take_rate)} AS {a.money_type})"


def estimated_monthly_revenue_sql(predicted_monthly_sales: str, a: Assumptions = DEFAULT) -> str:
    """Subscription + take rate on predicted sales (null sales count as 0)."""
    return (
        f"CAST({_dec(a.monthly_subscription)} + coalesce({predicted_monthly_sales}, 0) * {_dec(a.take_rate)}"
        f" AS {a.money_type})"
    )


def estimated_ltv_sql(predicted_monthly_sales: str, a: Assumptions = DEFAULT) -> str:
    """(subscription + take_rate * predicted sales) * horizon, as money."""
    return f"CAST({estimated_monthly_revenue_sql(predicted_monthly_sales, a)} * {a.ltv_months} AS {a.money_type})"


def estimated_ltv(predicted_monthly_sales: str, a: Assumptions = DEFAULT) -> Column:
    return F.expr(estimated_ltv_sql(predicted_monthly_sales, a))


def subscription_revenue_sql(a: Assumptions = DEFAULT) -> str:
    return f"CAST({_dec(a.monthly_subscription)} AS {a.money_type})"
