"""DataFrame -> DataFrame operators shared by the pipelines.

Each one is a composition of built-in operators chosen for how it behaves on
a large cluster; the docstrings say what shuffles and why it stays balanced
when one key holds a large share of the rows.  Expressions are passed as
Spark SQL text (see :mod:`funnelworks.functions.columns`).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def dedupe_latest(
    df: DataFrame,
    key: str | Sequence[str],
    order: Sequence[str],
    tiebreak: Sequence[str] | None = None,
) -> DataFrame:
    """Keep one row per ``key``: the first under ``order`` (SQL ordering terms,
    e.g. ``"created_date DESC NULLS FIRST"``), then ``tiebreak``.

    ``row_number() = 1`` over a key window is planned as a partial
    ``WindowGroupLimit`` before the shuffle and a final one after it, so each
    map task forwards at most one row per key: a key that owns a third of the
    input costs one row per map task in the exchange, not a third of the data.
    ``tiebreak`` columns (ascending, nulls first; default: all other columns)
    make the choice deterministic when the ordering ties, so results do not
    depend on task scheduling.
    """
    keys = _keys(key)
    rest = [c for c in (tiebreak if tiebreak is not None else df.columns) if c not in keys]
    terms = list(order) + [f"{c} ASC NULLS FIRST" for c in rest]
    window = f"row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY {', '.join(terms)})"
    return df.selectExpr("*", f"{window} AS __rn").where("__rn = 1").drop("__rn")


def month_spine(months: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Every month from the earliest to the latest value of ``column``, inclusive.

    One global min/max aggregate (partial per task, one row shuffled per task)
    and one ``explode(sequence(...))``.  The output size is the number of
    calendar months between the bounds, independent of the input size.  No
    rows when the input has no non-null month.
    """
    out = out or column
    bounds = months.selectExpr(f"min({column}) AS lo", f"max({column}) AS hi")
    return bounds.selectExpr(f"explode(sequence(lo, hi, interval 1 month)) AS {out}")


def unpivot(
    df: DataFrame,
    keep: Sequence[str],
    label_col: str,
    value_cols: Sequence[str],
    branches: Sequence[tuple[str, Sequence[str]]],
) -> DataFrame:
    """Wide -> long: one output row per branch for every input row.

    ``branches`` is ``[(label, [value expressions...]), ...]``; every branch
    must yield the same number (and compatible types) of values, named
    ``value_cols``.  Planned as a single ``Generate(stack)`` over one scan,
    unlike a UNION ALL of projections which reads its input once per branch.
    """
    args = [str(len(branches))]
    for label, values in branches:
        if len(values) != len(value_cols):
            raise ValueError("each branch needs one expression per value column")
        args.append("'" + label.replace("'", "\\'") + "'")
        args.extend(values)
    names = ", ".join([label_col, *value_cols])
    return df.selectExpr(*keep, f"stack({', '.join(args)}) AS ({names})")


def share_within(df: DataFrame, value: str, partition_by: Sequence[str], out: str) -> DataFrame:
    """``value / sum(value) over (partition by ...)`` as double; null when the sum is 0.

    The totals are an aggregate with a map-side combine, joined back, instead
    of a window, which would gather all members of a group in one task.  The
    join has no hint: adaptive execution broadcasts the totals when they are
    measured to be small, and splits a large group's partition otherwise.
    ``df`` is planned twice; over an aggregate the second use reads the shuffle
    of the first.
    """
    keys = [f"__k{i}" for i in range(len(partition_by))]
    named = df.groupBy(*[F.col(c).alias(k) for c, k in zip(partition_by, keys)])
    totals = named.agg(F.expr(f"nullif(sum({value}), 0) AS __total"))
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(partition_by, keys)]
    share = f"CAST({value} AS DOUBLE) / CAST(__total AS DOUBLE) AS {out}"
    return df.join(totals, reduce(and_, same)).selectExpr(*df.columns, share)


#: A key is hot from this many left rows on, but at most ``HOT_KEYS`` of them
#: are treated so, the most frequent ones, whatever the input's size.
HOT_KEY_ROWS = 1_000_000
HOT_KEYS = 200


def hot_keys(left: DataFrame, key: str, hot_key_rows: int) -> DataFrame:
    """__hot_key: the ``HOT_KEYS`` most frequent keys of more than
    ``hot_key_rows`` rows.  Only the key column is read; counts are combined
    map-side and the top is taken per task before one task sees it."""
    counts = left.where(f"{key} IS NOT NULL").groupBy(F.col(key).alias("__hot_key")).count()
    return counts.where(f"count > {int(hot_key_rows)}").orderBy(F.desc("count"), "__hot_key").limit(HOT_KEYS).select("__hot_key")


def skew_safe_left_join(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    hot_key_rows: int = HOT_KEY_ROWS,
) -> DataFrame:
    """Exact equi LEFT JOIN that keeps null and hot keys out of the shuffle.
    ``right`` must hold at most one row per key.

    * left rows with a null key or one of the :func:`hot_keys` join a broadcast
      of the hot keys' right rows, in the tasks that read them: no shuffle, so
      a key holding a third of the rows costs no more than any other rows, and
      a null key finds nothing there;
    * the remaining (cold) left rows take the ordinary shuffle join, whose
      right side keeps any partitioning it already has on ``right_key`` (the
      opportunity dedupe's), so the right side is not shuffled again.  Keys
      that are frequent but not among the hottest are left to adaptive
      execution there.

    Both broadcasts hold at most ``HOT_KEYS`` rows.  Result equals the plain
    join.
    """
    hot = F.broadcast(hot_keys(left, left_key, hot_key_rows))
    hot_right = F.broadcast(right.join(hot, right[right_key] == hot["__hot_key"], "left_semi"))
    marked = left.join(hot, left[left_key] == hot["__hot_key"], "left")
    stays = marked.where(F.col(left_key).isNull() | F.col("__hot_key").isNotNull()).drop("__hot_key")
    cold = left.join(hot, left[left_key] == hot["__hot_key"], "left_anti").where(F.col(left_key).isNotNull())
    in_place = stays.join(hot_right, stays[left_key] == hot_right[right_key], "left")
    return cold.join(right, cold[left_key] == right[right_key], "left").unionByName(in_place)


def left_join_sparse_key(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    strategy: str = "split",
    salt_col: str | None = None,
    hot_key_rows: int | None = HOT_KEY_ROWS,
    right_unique: bool = False,
) -> DataFrame:
    """LEFT JOIN on a nullable key that is null for most left rows.

    In a plain shuffle join every null key hashes to the same reducer, so the
    unmatched majority piles up in one task.  Two exact rewrites:

    * ``"split"`` (default): rows with a null key can never match, so they
      skip the join and the shuffle entirely and are appended with null right
      columns.  Only keyed rows are shuffled.  Costs a second read of the
      left input (a scan is much cheaper than shuffling those rows).
    * ``"salt"``: one pass; the join key of a null-key row is replaced by its
      own unique ``salt_col`` value and an extra ``left_key IS NOT NULL``
      predicate guarantees it never matches.  Null-key rows spread evenly over
      the reducers but are still shuffled.
    * ``"plain"``: the ordinary join, kept for comparison.

    With ``split`` and a right side known to be unique per key
    (``right_unique``), :func:`skew_safe_left_join` also keeps non-null hot
    keys out of the shuffle, unless ``hot_key_rows`` is None.  A right side
    that may repeat a key is never broadcast by hint.

    Output columns: all left columns then all right columns (right columns
    null when unmatched).  Right column names must not clash with left ones.
    """
    clash = set(left.columns) & set(right.columns)
    if clash:
        raise ValueError(f"column names on both sides: {sorted(clash)}")
    if strategy == "plain":
        return left.join(right, left[left_key] == right[right_key], "left")
    if strategy == "salt":
        if salt_col is None:
            raise ValueError("salt strategy needs a unique non-null salt column")
        salted = left.selectExpr("*", f"coalesce({left_key}, {salt_col}) AS __join_key")
        cond = (salted["__join_key"] == right[right_key]) & salted[left_key].isNotNull()
        return salted.join(right, cond, "left").drop("__join_key")
    if strategy != "split":
        raise ValueError(f"unknown strategy {strategy!r}")
    if hot_key_rows is not None and right_unique:
        return skew_safe_left_join(left, right, left_key, right_key, hot_key_rows)
    keyed = left.where(f"{left_key} IS NOT NULL")
    unkeyed = left.where(f"{left_key} IS NULL")
    joined = keyed.join(right, keyed[left_key] == right[right_key], "left")
    padding = [f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}" for f in right.schema.fields]
    return joined.unionByName(unkeyed.selectExpr("*", *padding))
