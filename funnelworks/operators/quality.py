"""Data-quality checks (Q1-Q8).

A check reports how many rows its test query would return; 0 means pass.
That is: the number of duplicated values (unique), null rows (not_null),
distinct unaccepted values (accepted_values), orphan child rows
(relationships), duplicated key combinations (unique_combination) and 0 or 1
for a reconciliation.

Every check is a distributed aggregate that returns one small row, so
nothing is collected; simple predicate checks on one frame share a single
pass (:func:`profile_checks`).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

SUMMARY_COLUMNS = ["model", "test", "column_name", "violations"]


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _in_list(values: Sequence[str]) -> str:
    return "(" + ", ".join(_lit(v) for v in values) + ")"


def _summary(df: DataFrame, model: str, test: str, column: str, violations_sql: str) -> DataFrame:
    return df.selectExpr(f"CAST({violations_sql} AS BIGINT) AS violations").selectExpr(
        f"{_lit(model)} AS model", f"{_lit(test)} AS test", f"{_lit(column)} AS column_name", "violations"
    )


def unique_check(df: DataFrame, model: str, column: str) -> DataFrame:
    """Values (nulls ignored) that occur more than once.

    A partial aggregate runs before the shuffle, so a value repeated in a
    third of the rows reaches the reducer as one row per map task.
    """
    dups = df.where(f"{column} IS NOT NULL").groupBy(column).count().where("count > 1")
    return _summary(dups, model, "unique", column, "count(1)")


def unique_combination_check(df: DataFrame, model: str, columns: Sequence[str]) -> DataFrame:
    dups = df.groupBy(*columns).count().where("count > 1")
    return _summary(dups, model, "unique_combination_of_columns", ",".join(columns), "count(1)")


def uniqueness_checks(
    df: DataFrame, model: str, unique: Sequence[str] = (), combinations: Sequence[Sequence[str]] = ()
) -> DataFrame:
    """All uniqueness checks of one frame with one scan and one shuffle.

    Grouping sets: each row is sent once per distinct key, tagged with its set
    and combined map-side, and all sets are aggregated together.
    """
    sets = list(dict.fromkeys([(c,) for c in unique] + [tuple(c) for c in combinations]))
    if not sets:
        raise ValueError("no checks given")
    columns = list(dict.fromkeys(c for s in sets for c in s))

    def number(s: tuple[str, ...]) -> int:  # of a grouping set: a bit for each column it leaves out
        return sum(1 << i for i, c in enumerate(reversed(columns)) if c not in s)

    counted = df.groupingSets([list(s) for s in sets], *columns).agg(F.grouping_id().alias("__set"), F.count("*").alias("__n"))
    found, labels = [], []
    for c in unique:
        found.append(f"count_if(__set = {number((c,))} AND {c} IS NOT NULL)")
        labels.append(("unique", c))
    for c in combinations:
        found.append(f"count_if(__set = {number(tuple(c))})")
        labels.append(("unique_combination_of_columns", ",".join(c)))
    row = counted.where("__n > 1").selectExpr(*[f"CAST({f} AS BIGINT) AS v{i}" for i, f in enumerate(found)])
    return _stacked(row, model, labels)


def _stacked(row: DataFrame, model: str, labels: Sequence[tuple[str, str]]) -> DataFrame:
    """A summary row per check from one row of violations v0, v1, ..."""
    args = [str(len(labels))]
    for i, (test, c) in enumerate(labels):
        args += [_lit(test), _lit(c), f"v{i}"]
    return row.selectExpr(f"{_lit(model)} AS model", f"stack({', '.join(args)}) AS (test, column_name, violations)")


def not_null_check(df: DataFrame, model: str, column: str) -> DataFrame:
    return _summary(df, model, "not_null", column, f"count_if({column} IS NULL)")


def accepted_values_check(df: DataFrame, model: str, column: str, values: Sequence[str]) -> DataFrame:
    """Distinct non-null values outside ``values``."""
    bad = df.where(f"{column} IS NOT NULL AND {column} NOT IN {_in_list(values)}").groupBy(column).count()
    return _summary(bad, model, "accepted_values", column, "count(1)")


def profile_checks(
    df: DataFrame,
    model: str,
    not_null: Sequence[str] = (),
    accepted: dict[str, Sequence[str]] | None = None,
) -> DataFrame:
    """All not_null and accepted_values checks of one frame in one scan.

    One aggregate computes every null count; the distinct unaccepted values
    are counted in the same pass (Spark expands each row once per distinct
    aggregate before the partial aggregation).  Output: one summary row per
    check, via ``stack``.
    """
    accepted = accepted or {}
    aggs, labels = [], []
    for c in not_null:
        aggs.append(f"CAST(count_if({c} IS NULL) AS BIGINT)")
        labels.append(("not_null", c))
    for c, values in accepted.items():
        aggs.append(f"CAST(count(DISTINCT CASE WHEN {c} NOT IN {_in_list(values)} THEN {c} END) AS BIGINT)")
        labels.append(("accepted_values", c))
    if not aggs:
        raise ValueError("no checks given")
    return _stacked(df.selectExpr(*[f"{a} AS v{i}" for i, a in enumerate(aggs)]), model, labels)


@dataclass
class Profile:
    """The not_null and accepted_values checks of a frame, counted while its
    rows are written.  Write ``df``, then ask for ``summary``."""

    model: str
    not_null: Sequence[str]
    accepted: dict[str, Sequence[str]]
    df: DataFrame
    observation: Observation

    def summary(self, written: DataFrame) -> DataFrame:
        """A summary row per check.  ``written``: the stored rows, read only
        where a column has unaccepted values, to count the distinct ones."""
        told = self.observation.get
        rows = [(self.model, "not_null", c, told[f"null_{c}"]) for c in self.not_null]
        found = [c for c in self.accepted if told[f"other_{c}"]]
        rows += [(self.model, "accepted_values", c, 0) for c in self.accepted if c not in found]
        known = written.sparkSession.createDataFrame(rows, "model string, test string, column_name string, violations long")
        if not found:
            return known
        return known.unionByName(profile_checks(written, self.model, accepted={c: self.accepted[c] for c in found}))


def observed_profile(
    df: DataFrame, model: str, not_null: Sequence[str] = (), accepted: dict[str, Sequence[str]] | None = None
) -> Profile:
    """Count the violations of these checks as ``df`` is written, without
    another pass.  The counts are taken in the tasks that write, each of which
    ends once, so a lost executor does not count rows twice; do not add
    operators that shuffle before writing ``Profile.df``."""
    accepted = accepted or {}
    metrics = [F.expr(f"count_if({c} IS NULL) AS null_{c}") for c in not_null]
    metrics += [F.expr(f"count_if({c} NOT IN {_in_list(v)}) AS other_{c}") for c, v in accepted.items()]
    if not metrics:
        raise ValueError("no checks given")
    observation = Observation()
    return Profile(model, list(not_null), accepted, df.observe(observation, *metrics), observation)


def relationship_check(
    child: DataFrame, model: str, column: str, parent: DataFrame, parent_column: str
) -> DataFrame:
    """Child rows whose non-null key has no parent row.

    The child keys are first reduced to (key, rows) with a map-side combine,
    so a key held by a third of the children costs one row per map task; the
    anti join then runs on distinct keys only.
    """
    keys = child.where(f"{column} IS NOT NULL").groupBy(child[column].alias("__k")).count()
    parents = parent.selectExpr(f"{parent_column} AS __p").where("__p IS NOT NULL")
    orphans = keys.join(parents, keys["__k"] == parents["__p"], "left_anti")
    return _summary(orphans, model, "relationships", column, "coalesce(sum(count), 0)")


#: A bitmap aggregate of Spark holds so many bits.
BITMAP_BITS = 1 << 15
#: Bits a key: with three bits set, about one key in sixty is taken for a parent's.
BITS_PER_KEY = 10
#: A filter of more bitmaps (4 KB each) is not sent to every task.
MOST_BITMAPS = 1 << 14


def key_filter(keys: DataFrame, column: str, bitmaps: int) -> DataFrame:
    """A Bloom filter of the keys: __bitmap, __bits, a row for each of
    ``bitmaps`` that is not empty.  A key has three bits in one bitmap; the
    bits are combined map-side, so no key is shuffled."""
    places = keys.where(f"{column} IS NOT NULL").selectExpr(
        f"{_bitmap_sql(column, bitmaps)} AS __bitmap", f"explode(array({', '.join(_bits_sql(column))})) AS __bit"
    )
    return places.groupBy("__bitmap").agg(F.expr("bitmap_construct_agg(__bit) AS __bits"))


def _bitmap_sql(key: str, bitmaps: int) -> str:
    return f"pmod(xxhash64({key}), {bitmaps}L)"


def _bits_sql(key: str) -> list[str]:
    return [f"pmod(shiftright(xxhash64({key}, 1), {20 * i}), {BITMAP_BITS}L)" for i in range(3)]


def _set_sql(bit: str) -> str:
    byte = f"conv(hex(substring(__bits, CAST({bit} DIV 8 AS INT) + 1, 1)), 16, 10)"
    return f"getbit(CAST({byte} AS BIGINT), CAST({bit} % 8 AS INT)) = 1"


def filtered_relationship_check(
    child: DataFrame, model: str, column: str, parent: DataFrame, parent_column: str
) -> DataFrame:
    """:func:`relationship_check` for children of which many have no parent.

    A Bloom filter of the parents' keys, sized from their count (a job), goes
    to every task that reads children.  Rows outside it are orphans at once and
    are not shuffled; those inside take the exact join, so the count is exact.
    Parents too many for a filter of ``MOST_BITMAPS`` take the plain check.
    Where nearly every child has its parent, the plain check does less.
    """
    parents = parent.selectExpr(f"{parent_column} AS __p").where("__p IS NOT NULL")
    bitmaps = max(1, -(-parents.count() * BITS_PER_KEY // BITMAP_BITS))
    if bitmaps > MOST_BITMAPS:
        return relationship_check(child, model, column, parent, parent_column)
    keys = child.where(f"{column} IS NOT NULL").selectExpr(f"{column} AS __k", f"{_bitmap_sql(column, bitmaps)} AS __at")
    held = F.broadcast(key_filter(parents, "__p", bitmaps))
    inside = " AND ".join(["__bits IS NOT NULL", *(_set_sql(bit) for bit in _bits_sql("__k"))])
    marked = keys.join(held, keys["__at"] == held["__bitmap"], "left").selectExpr("__k", f"{inside} AS __inside")
    outside = marked.where("NOT __inside").selectExpr("count(1) AS n")
    unsure = marked.where("__inside").groupBy("__k").count()
    missing = unsure.join(parents, unsure["__k"] == parents["__p"], "left_anti").selectExpr("sum(count) AS n")
    return _summary(outside.unionByName(missing), model, "relationships", column, "coalesce(sum(n), 0)")


def reconcile(
    source: DataFrame,
    source_column: str,
    model: DataFrame,
    model_column: str,
    where: str | None = None,
    tolerance: Decimal = Decimal("0.01"),
    name: str = "reconcile",
) -> DataFrame:
    """Compare the total of ``source_column`` with the total of ``model_column``.

    One row: source_total, model_total, difference (absolute) and violations
    (1 when the difference exceeds ``tolerance``).  Both totals come from one
    aggregate over the tagged union of the two inputs, so there is no join.
    Empty inputs total 0.
    """
    m = model.where(where) if where else model
    tagged = source.selectExpr("true AS __src", f"{source_column} AS __v").unionByName(
        m.selectExpr("false AS __src", f"{model_column} AS __v")
    )
    totals = tagged.selectExpr(
        "coalesce(sum(CASE WHEN __src THEN __v END), 0) AS source_total",
        "coalesce(sum(CASE WHEN NOT __src THEN __v END), 0) AS model_total",
    )
    tol = format(tolerance, "f")
    return totals.selectExpr(
        f"{_lit(name)} AS check_name",
        "source_total",
        "model_total",
        "abs(source_total - model_total) AS difference",
        f"CAST(CASE WHEN abs(source_total - model_total) > {tol} THEN 1 ELSE 0 END AS BIGINT) AS violations",
    )


def reconcile_summary(rec: DataFrame, model: str, column: str) -> DataFrame:
    return rec.selectExpr(
        f"{_lit(model)} AS model", "check_name AS test", f"{_lit(column)} AS column_name", "violations"
    )
