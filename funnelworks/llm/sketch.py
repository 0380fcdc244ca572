"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every distinct shingle hash below a fixed fraction of the hash
range, so two sketches merge by set union and compare at any pair of lengths:
the share of one sketch found in the other estimates containment.  Hashes are
the first 12 hex digits of the MD5 of five words joined by spaces (a text of
fewer words is one shingle; white space separates words); the threshold
compares digits as text.

Short texts would keep too few hashes for a useful estimate, so a text of at
most ``DENSE`` shingles keeps all of them, and says so by its scale.  Two
sketches always compare at the coarser of their scales, where both hold the
same fraction.

A fingerprint is ``<scale>:<hashes in order, comma-joined>``, scale ``1`` (all)
or ``8`` (one in eight).  Equal texts have equal fingerprints.

Defined results: a null text counts as empty and has the fingerprint ``1:``;
the likeness of two empty sketches is 1 when the fingerprints are equal and 0
otherwise; repeated rows are returned each; rows with equal doc_id are ordered
by the MD5 of their text, so of a repeated row's copies each but the last has the
same text next; a null doc_id sorts first; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelworks.llm.common import table, with_position

WORDS = 5
DIGITS = 12
#: Hashes below this are kept: two of sixteen leading digits.
BELOW = "2"
DENSE = 256

_SPACE = r"[\x20\x09-\x0D]+"


def shingle_hashes(text: Column) -> Column:
    """Every shingle's hash in text order, as hex text."""
    words = F.array_remove(F.split(text, _SPACE), "")

    def of(words: Column) -> Column:
        n = F.size(words)
        starts = F.sequence(F.lit(1), F.greatest(n - (WORDS - 1), F.lit(1)))
        digest = lambda i: F.substring(F.md5(F.array_join(F.slice(words, i, F.lit(WORDS)), " ")), 1, DIGITS)
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(starts, digest))

    return F.flatten(F.transform(F.array(words), of))  # binds the words once


def sketch(text: Column) -> Column:
    """struct<dense: boolean, hashes: array<string>>, hashes distinct and sorted."""

    def keep(all_hashes: Column) -> Column:
        dense = F.size(all_hashes) <= DENSE
        kept = F.when(dense, all_hashes).otherwise(F.filter(all_hashes, lambda h: h < BELOW))
        return F.struct(dense.alias("dense"), F.array_sort(F.array_distinct(kept)).alias("hashes"))

    return F.get(F.transform(F.array(shingle_hashes(text)), keep), F.lit(0))


def fingerprint(sk: Column) -> Column:
    return F.concat(F.when(sk["dense"], F.lit("1:")).otherwise(F.lit("8:")), F.array_join(sk["hashes"], ","))


def parse(printed: Column) -> Column:
    """The sketch of a fingerprint."""
    hashes = F.array_remove(F.split(F.substring(printed, F.lit(3), F.length(printed)), ","), "")
    return F.struct(printed.startswith("1:").alias("dense"), hashes.alias("hashes"))


def merge(a: Column, b: Column) -> Column:
    """The sketch of both texts' shingles together, at the coarser scale."""
    x, y = _same_scale(a, b)
    return F.struct((a["dense"] & b["dense"]).alias("dense"), F.array_sort(F.array_union(x, y)).alias("hashes"))


def _same_scale(a: Column, b: Column) -> tuple[Column, Column]:
    both = a["dense"] & b["dense"]
    cut = lambda s: F.when(both | ~s["dense"], s["hashes"]).otherwise(F.filter(s["hashes"], lambda h: h < BELOW))
    return cut(a), cut(b)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets."""
    x, y = _same_scale(a, b)
    shared = F.size(F.array_intersect(x, y))
    either = F.size(x) + F.size(y) - shared
    return F.when(either > 0, shared / either).otherwise(F.when(a == b, 1.0).otherwise(0.0))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` holds."""
    x, y = _same_scale(a, b)
    shared = F.size(F.array_intersect(x, y))
    return F.when(F.size(x) > 0, shared / F.size(x)).otherwise(F.when(a == b, 1.0).otherwise(0.0))


def with_next(docs: DataFrame) -> DataFrame:
    """The documents with the head and fingerprint of the next one in ascending
    doc_id (after the last: the first): doc_id, text, head (as many code points
    as asked for), next_print, copies (how many rows this one stands for).  A
    repeated row gives two: its last copy, and the ones before it, whose next
    one is a copy again (next_print is null: the text's own).

    Only ids and lengths are sorted.  The texts are dealt once, by key; what a
    document's predecessor needs of it (a quarter text and a sketch) moves to it.
    """
    keyed = docs.select(
        "doc_id",
        F.coalesce("doc_id", F.lit(0)).alias("k"),
        F.concat(F.when(F.col("doc_id").isNull(), "-").otherwise("+"), F.md5(F.coalesce("text", F.lit("")))).alias("tie"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = keyed.groupBy("doc_id", "k", "tie").agg(F.floor(F.first(F.length("text")) / 4).cast("int").alias("quarter"), F.count("*").alias("n"))
    placed = with_position(rows, F.col("doc_id").asc_nulls_first(), F.col("tie"), name="doc-order")
    count = placed.count()
    after = placed.select("k", "tie", "position")
    before = placed.select(
        ((F.col("position") + 1) % F.lit(max(count, 1))).alias("position"),
        F.struct("doc_id", "k", "tie", "quarter", "n").alias("prev"),
    )
    links = after.join(before, "position").select("k", "tie", "prev")
    texts = keyed.groupBy("k", "tie").agg(F.first("text").alias("text"))
    sent = texts.join(links, ["k", "tie"]).select(
        F.col("prev.k").alias("k"),
        F.col("prev.tie").alias("tie"),
        F.col("prev.doc_id").alias("doc_id"),
        F.col("prev.n").alias("n"),
        F.substring("text", F.lit(1), F.col("prev.quarter")).alias("head"),
        fingerprint(sketch(F.col("text"))).alias("next_print"),
    )
    last = F.struct("head", "next_print", F.lit(1).cast("long").alias("copies"))
    own_head = F.substring("text", F.lit(1), F.floor(F.length("text") / 4).cast("int"))
    earlier = F.struct(own_head.alias("head"), F.lit(None).cast("string").alias("next_print"), (F.col("n") - 1).alias("copies"))
    ways = F.when(F.col("n") > 1, F.array(last, earlier)).otherwise(F.array(last))
    return texts.join(sent, ["k", "tie"]).select("doc_id", "text", F.explode(ways).alias("way")).select("doc_id", "text", "way.*")


def each_copy(rows: DataFrame) -> DataFrame:
    """Every row as often as its column ``copies`` says, in lists of bounded length."""
    step = 1 << 16
    parts = rows.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(step).cast("long"))))
    left = F.least(F.col("copies") - F.col("_from"), F.lit(step)).cast("int")
    return parts.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), left))).drop("_from", "_copy", "copies")


def op2_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.length("text")
    kept = F.substring("text", F.lit(1), n - F.floor(n / 4).cast("int"))
    prints = (
        docs.withColumn("edited", F.concat(kept, F.col("head")))
        .select(
            "doc_id",
            n.cast("long").alias("n_chars"),
            F.sha2("edited", 256).alias("edited_sha256"),
            sketch(F.col("text")).alias("own"),
            sketch(F.col("edited")).alias("changed"),
            "next_print",
            "copies",
        )
        .withColumn("next", F.when(F.col("next_print").isNull(), F.col("own")).otherwise(parse(F.col("next_print"))))
    )
    own, changed, nxt = F.col("own"), F.col("changed"), F.col("next")
    done = prints.select(
        "copies",
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(own).alias("fingerprint"),
        fingerprint(changed).alias("edited_fingerprint"),
        likeness(own, changed).alias("near_edited"),
        likeness(own, nxt).alias("near_next"),
        containment(own, nxt).alias("held_by_next"),
    )
    return each_copy(done)


def _sql_sketch(name: str, text: str) -> str:
    """CTEs that add ``<name>_all`` (hashes) and ``<name>`` (kept, sorted) for a text column."""
    return f"""
{name}_words AS (SELECT r, list_filter(string_split_regex({text}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM docs),
{name}_all AS (SELECT r, CASE WHEN len(w) = 0 THEN []::VARCHAR[] ELSE
    list_transform(range(1, greatest(len(w) - {WORDS - 1}, 1) + 1),
                   lambda i: substr(md5(array_to_string(w[i:i + {WORDS - 1}], ' ')), 1, {DIGITS})) END AS h FROM {name}_words),
{name} AS (SELECT r, len(h) <= {DENSE} AS dense, list_sort(list_distinct(
    CASE WHEN len(h) <= {DENSE} THEN h ELSE list_filter(h, lambda x: x < '{BELOW}') END)) AS h FROM {name}_all)"""


OP2_SQL = f"""
WITH docs AS (
  SELECT r, doc_id, text, n, quarter, substr(text, 1, n - quarter) || substr(next_text, 1, quarter) AS edited, next_r
  FROM (SELECT r, doc_id, text, length(text) AS n, length(text) // 4 AS quarter,
               coalesce(lead(text) OVER o, first(text) OVER o) AS next_text, coalesce(lead(r) OVER o, first(r) OVER o) AS next_r
        FROM (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents)
        WINDOW o AS (ORDER BY doc_id NULLS FIRST, md5(text), r ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
), {_sql_sketch("own", "text")}, {_sql_sketch("changed", "edited")},
sides AS (
  SELECT d.doc_id, d.n, d.edited, o.dense AS od, o.h AS oh, c.dense AS cd, c.h AS ch, x.dense AS xd, x.h AS xh
  FROM docs d JOIN own o USING (r) JOIN changed c USING (r) JOIN own x ON x.r = d.next_r
), cut AS (
  SELECT *, CASE WHEN od AND cd OR NOT od THEN oh ELSE list_filter(oh, lambda v: v < '{BELOW}') END AS o1,
            CASE WHEN od AND cd OR NOT cd THEN ch ELSE list_filter(ch, lambda v: v < '{BELOW}') END AS c1,
            CASE WHEN od AND xd OR NOT od THEN oh ELSE list_filter(oh, lambda v: v < '{BELOW}') END AS o2,
            CASE WHEN od AND xd OR NOT xd THEN xh ELSE list_filter(xh, lambda v: v < '{BELOW}') END AS x2
  FROM sides
), counted AS (
  SELECT *, len(list_intersect(o1, c1)) AS s1, len(list_intersect(o2, x2)) AS s2 FROM cut
)
SELECT doc_id, n::BIGINT AS n_chars, sha256(edited) AS edited_sha256,
       CASE WHEN od THEN '1:' ELSE '8:' END || array_to_string(oh, ',') AS fingerprint,
       CASE WHEN cd THEN '1:' ELSE '8:' END || array_to_string(ch, ',') AS edited_fingerprint,
       CASE WHEN len(o1) + len(c1) - s1 > 0 THEN s1::DOUBLE / (len(o1) + len(c1) - s1)
            WHEN od = cd AND oh = ch THEN 1.0 ELSE 0.0 END::DOUBLE AS near_edited,
       CASE WHEN len(o2) + len(x2) - s2 > 0 THEN s2::DOUBLE / (len(o2) + len(x2) - s2)
            WHEN od = xd AND oh = xh THEN 1.0 ELSE 0.0 END::DOUBLE AS near_next,
       CASE WHEN len(o2) > 0 THEN s2::DOUBLE / len(o2)
            WHEN od = xd AND oh = xh THEN 1.0 ELSE 0.0 END::DOUBLE AS held_by_next
FROM counted
"""
