"""Benchmark decontamination by template windows.

A text becomes tokens (letter runs and numbers, punctuation ignored) and each
token a template symbol: numbers, names (a capital first letter) and units (a
known unit straight after a number) become typed placeholders, other tokens
stay.  Windows of ``WINDOW`` symbols of the documents are joined by hash with
those of the benchmark items; only windows around a seed, the longest word of
some benchmark window, can match, so only those are built.  The symbols are
compared exactly, and the values in
the slots checked: each benchmark value has to stand for one document value and
the other way round, so a question with other numbers and names is caught and a
chance template is not.  That holds when both windows have the same slot pattern
(which slots are equal to which), so benchmark windows of one template and
pattern are one row to join with, named by the least item_id: a document window
meets at most one template, however many items were made from it
(``template_items`` lists them).  A window in which placeholders outnumber words
counts only with the very same values, whatever its symbols.

A window counts for the item whose very values it has (of several the least
item_id), else for its template's.  An item of fewer than ``WINDOW`` tokens is one window of its
own length; with fewer than ``LEAST`` tokens it counts with its very values only.

Defined results: a null text has no tokens, and an item without tokens matches
nothing; an empty benchmark or table gives no rows; rows that share a doc_id (or
have none) count together, and repeated rows once; items without an id are named
by null; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelworks.llm.common import stored, table

WINDOW = 13
LEAST = 5
#: Benchmark windows and seeds up to this many rows, and bytes of their tokens,
#: are broadcast; more are joined by shuffle.  The rows found are the same.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20

TOKEN = r"\p{L}+|[0-9]+(?:[.,][0-9]+)*"
UNITS = (
    "mm cm m km kg g mg lb oz l ml s ms min h mph kmh hz kw w v a mb gb tb inch inches feet foot miles mile yards "
    "meters metres kilometers grams kilograms pounds liters litres seconds minutes hours days weeks months years "
    "percent dollars cents euros degrees"
).split()
NUMBER, NAME, UNIT = "<number>", "<name>", "<unit>"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def _is_number(token: Column) -> Column:
    return token < "A"  # tokens start with a digit or a letter


def _symbol(t: Column, before: Column) -> Column:
    """The symbol of token ``t`` after token ``before`` (null at the start).
    Plain ranges settle tokens that start in ASCII."""
    first = F.substring(t, 1, 1)
    return (
        F.when(_is_number(t), NUMBER)
        .when(t < "[", NAME)
        .when((t >= "{") & (first != F.lower(first)), NAME)
        .when(_is_number(before) & t.isin(UNITS), UNIT)
        .otherwise(t)
    )


def template(toks: Column, before: Column | None = None) -> Column:
    """One symbol per token; ``before`` is the token ahead of the first, if any."""

    def symbol(t: Column, i: Column) -> Column:
        last = F.get(toks, i - 1)
        return _symbol(t, last if before is None else F.when(i == 0, before).otherwise(last))

    return F.transform(toks, symbol)


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, n, symbols, values and seed (token and its place) of the benchmark's windows."""
    items = (
        benchmark.select("item_id", tokens(F.col("text")).alias("values"))
        .groupBy("values").agg(F.min("item_id").alias("item_id"))
        .withColumn("symbols", template(F.col("values")))
        .withColumn("n", F.least(F.size("values"), F.lit(WINDOW)))
        .where(F.col("n") > 0)
    )
    starts = items.withColumn("i", F.explode(F.sequence(F.lit(1), F.size("values") - F.col("n") + 1)))
    windows = starts.select(
        "item_id",
        "n",
        F.slice("symbols", F.col("i"), F.col("n")).alias("b_symbols"),
        F.slice("values", F.col("i"), F.col("n")).alias("b_values"),
    ).dropDuplicates(["item_id", "b_symbols", "b_values"])
    # a window of placeholders counts only with its own values, so any of them can be the seed
    placed = F.transform(
        "b_values",
        lambda v, j: F.struct((~_is_slot(F.get("b_symbols", j))).alias("word"), F.length(v).alias("chars"), v.alias("token"), j.alias("at")),
    )
    return windows.withColumn("seed", F.array_max(placed))


def _is_slot(symbol: Column) -> Column:
    return symbol.isin(NUMBER, NAME, UNIT)


def _slots(symbols: Column, values: Column) -> Column:
    """The values in a window's slots, in order."""
    return F.filter(values, lambda v, j: _is_slot(F.get(symbols, j)))


def _pattern(slots: Column) -> Column:
    """For each slot the place of the first slot with its value."""
    return F.transform(slots, lambda v: F.array_position(slots, v).cast("int"))


def _templates(windows: DataFrame) -> DataFrame:
    """item_id, n, b_symbols, b_pattern of the windows that count as templates."""
    slots = _slots(F.col("b_symbols"), F.col("b_values"))
    able = windows.where(F.col("n") >= LEAST).withColumn("slots", slots).where(F.size("slots") * 2 <= F.col("n"))
    return able.select("item_id", "n", "b_symbols", _pattern(F.col("slots")).alias("b_pattern"))


def template_items(benchmark: DataFrame) -> DataFrame:
    """Which items share a template: template (the least item_id, as ``matches``
    names it), n, symbols, pattern, item_id; a row for each item."""
    each = _templates(benchmark_windows(benchmark)).distinct()
    named = each.groupBy("n", "b_symbols", "b_pattern").agg(F.min("item_id").alias("template"))
    return each.join(named, ["n", "b_symbols", "b_pattern"]).select(
        "template", "n", F.col("b_symbols").alias("symbols"), F.col("b_pattern").alias("pattern"), "item_id"
    )


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every consistent window, once: doc_id, text_key, item_id, n, i, exact."""
    wanted = stored(benchmark_windows(benchmark), "benchmark-windows")
    sizes = wanted.agg(F.count("*").alias("rows"), F.sum(F.octet_length(F.array_join("b_values", " "))).alias("bytes")).first()
    small = sizes["rows"] <= BROADCAST_ROWS and (sizes["bytes"] or 0) <= BROADCAST_BYTES
    seeds = wanted.select(F.col("seed.token").alias("token"), F.col("seed.at").alias("seed_at"), "n").distinct()
    templates = _templates(wanted).groupBy("n", "b_symbols", "b_pattern").agg(F.min("item_id").alias("t_item"))
    templates = templates.withColumn("t_h", F.xxhash64("b_symbols", "b_pattern")).withColumnRenamed("n", "t_n")
    same_values = wanted.groupBy("n", "b_values").agg(F.min("item_id").alias("e_item"))
    same_values = same_values.withColumn("e_h", F.xxhash64("b_values")).withColumnRenamed("n", "e_n")
    read = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), tokens(F.col("text")).alias("toks"))
    # explode_outer and eqNullSafe keep the optimizer from testing whole token
    # lists for null or emptiness, which would build them twice
    if small:
        met = read.select("*", F.posexplode_outer("toks").alias("at", "token")).join(F.broadcast(seeds), "token")
        templates, same_values = F.broadcast(templates), F.broadcast(same_values)
    else:
        # places move without the texts, and meet them again by key
        places = read.select("doc_id", "text_key", F.posexplode_outer("toks").alias("at", "token")).join(seeds, "token")
        d, p = read.dropDuplicates(["doc_id", "text_key"]).alias("d"), places.drop("token").distinct().alias("p")
        same = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.text_key") == F.col("p.text_key"))
        met = p.join(d, same).select("p.*", "d.toks")
    # the windows are cut out by generated code before anything copies a row, so a long text is not copied per window
    cut = (
        met.withColumn("i", F.col("at") - F.col("seed_at"))
        .where((F.col("i") >= 0) & (F.col("i") + F.col("n") <= F.size("toks")))
        .select("doc_id", "text_key", "i", "n", F.get("toks", F.col("i") - 1).alias("before"), F.slice("toks", F.greatest(F.col("i") + 1, F.lit(1)), F.col("n")).alias("values"))
    )
    built = (
        cut.withColumn("symbols", template(F.col("values"), F.col("before")))
        .withColumn("pattern", _pattern(_slots(F.col("symbols"), F.col("values"))))
        .withColumn("h", F.xxhash64("symbols", "pattern"))
        .withColumn("vh", F.xxhash64("values"))
    )
    same_template = (
        (F.col("n") == F.col("t_n")) & (F.col("h") == F.col("t_h"))
        & F.col("symbols").eqNullSafe(F.col("b_symbols")) & F.col("pattern").eqNullSafe(F.col("b_pattern"))
    )
    same = (F.col("n") == F.col("e_n")) & (F.col("vh") == F.col("e_h")) & F.col("values").eqNullSafe(F.col("b_values"))
    return (
        built.join(templates, same_template, "left").join(same_values, same, "left")
        .where(F.col("t_n").isNotNull() | F.col("e_n").isNotNull())
        .select("doc_id", "text_key", F.when(F.col("e_n").isNotNull(), F.col("e_item")).otherwise(F.col("t_item")).alias("item_id"), "n", "i", F.col("e_n").isNotNull().alias("exact"))
        .distinct()
    )


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold a benchmark item: doc_id, item_id (of the item or its
    template), windows found and how many of them have the item's own values."""
    return matches(docs, benchmark).groupBy("doc_id", "item_id").agg(
        F.count("*").alias("n_windows"), F.count(F.when(F.col("exact"), 1)).alias("n_exact")
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns kept."""
    bad = matches(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & (key == bad["_key"]), "left_anti")


def op7_template_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contaminated(docs, table(spark, sf_dir, "benchmark"))


_UNITS_SQL = ", ".join(f"'{u}'" for u in UNITS)
_SYMBOLS_SQL = f"""list_transform(v, lambda t, i: CASE WHEN t < 'A' THEN '{NUMBER}'
    WHEN substr(t, 1, 1) <> lower(substr(t, 1, 1)) THEN '{NAME}'
    WHEN t IN ({_UNITS_SQL}) AND i > 1 AND v[i - 1] < 'A' THEN '{UNIT}' ELSE t END)"""

_SLOTS_SQL = f"""list_filter(list_transform(range(1, {{n}} + 1), lambda j: CASE WHEN {{s}}[j] IN ('{NUMBER}', '{NAME}', '{UNIT}') THEN {{v}}[j] END),
    lambda x: x IS NOT NULL)"""

OP7_SQL = rf"""
WITH items AS (
  SELECT v, min(item_id) AS item_id FROM (SELECT item_id, regexp_extract_all(coalesce(text, ''), '{TOKEN}') AS v FROM benchmark) GROUP BY v
), item_symbols AS (SELECT item_id, v, {_SYMBOLS_SQL} AS s, least(len(v), {WINDOW}) AS n FROM items WHERE len(v) > 0),
bench AS (
  SELECT DISTINCT item_id, n, s[i:i + n - 1] AS bs, v[i:i + n - 1] AS bv
  FROM item_symbols, unnest(range(1, len(v) - n + 2)) u(i)
), bench_slots AS (SELECT *, {_SLOTS_SQL.format(n="n", s="bs", v="bv")} AS sv FROM bench),
templates AS (
  SELECT n, bs, list_transform(sv, lambda x: list_position(sv, x)) AS bp, min(item_id) AS t_item, true AS is_template
  FROM bench_slots WHERE n >= {LEAST} AND 2 * len(sv) <= n GROUP BY n, bs, bp
), same_values AS (SELECT n, bv, min(item_id) AS e_item, true AS is_exact FROM bench GROUP BY n, bv),
sizes AS (SELECT DISTINCT n FROM bench),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(text, '{TOKEN}') AS v FROM (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents)),
doc_symbols AS (SELECT r, doc_id, v, {_SYMBOLS_SQL} AS s FROM docs),
wins AS (
  SELECT r, doc_id, n, i, s[i:i + n - 1] AS ds, v[i:i + n - 1] AS dv
  FROM doc_symbols, sizes, unnest(range(1, len(v) - n + 2)) u(i)
), met AS (  -- windows with a template's symbols, before their slots are compared
  SELECT w.*, {_SLOTS_SQL.format(n="w.n", s="ds", v="dv")} AS sv
  FROM wins w SEMI JOIN templates t ON w.n = t.n AND ds = bs
), by_template AS (
  SELECT r, doc_id, met.n, i, t_item FROM met JOIN templates t ON met.n = t.n AND ds = bs AND list_transform(sv, lambda x: list_position(sv, x)) = bp
), by_values AS (
  SELECT r, doc_id, wins.n, i, e_item, is_exact FROM wins JOIN same_values e ON wins.n = e.n AND dv = bv
)
SELECT coalesce(t.doc_id, e.doc_id) AS doc_id, CASE WHEN is_exact THEN e_item ELSE t_item END AS item_id, count(*) AS n_windows, count(is_exact) AS n_exact
FROM by_template t FULL JOIN by_values e USING (r, n, i)
GROUP BY ALL
"""
