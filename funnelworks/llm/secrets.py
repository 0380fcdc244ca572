"""Secret scans: an incremental ledger of content-addressed blobs.

Every version of every document is a blob named by the SHA-256 of its text.
The ledger is a Parquet table with one row per blob and scan: which rules (with
their versions) were run, and the spans they found.  ``scan`` runs only the
(blob, rule version) pairs that the ledger lacks, appends them, and
``findings`` joins the current rules' spans back to every row that holds the
blob.

Spans are whole matches, in code points, end exclusive; per rule leftmost and
non-overlapping.  Positions come from the pieces between matches, summed in a
window per blob, so a text with very many matches stays linear.

Defined results: a null text counts as empty; repeated rows and copies are
scanned once and reported each; an empty table gives no rows; extra columns are
ignored; rows with a null id are reported as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from funnelworks.llm.common import table
from funnelworks.session import remove_at_end, scratch_path


@dataclass(frozen=True)
class Rule:
    """``keep`` is a pattern that a match has to satisfy from its start, or None."""

    kind: str
    version: int
    pattern: str
    keep: str | None = None

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_VALUE = r"[A-Za-z0-9+/_.=-]"
_ASSIGN = rf"(?:{_NAMES})[\"']?\x20*[:=]\x20*[\"']?"

#: In the order in which kinds that start together are listed.  The hex and
#: access patterns ask for their least length at once: a run of their class is
#: either long enough as a whole or has no long enough part.  A short
#: assignment still uses up its text, so that rule filters afterwards.
RULES = (
    Rule("assign", 1, rf"{_ASSIGN}{_VALUE}+", rf"^{_ASSIGN}{_VALUE}{{6}}"),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)

LEDGER_SCHEMA = "blob_id binary, rules array<string>, spans array<struct<rule:string, start:long, stop:long>>"


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _hits(rule: Rule) -> Column:
    """Per match: its place in the list, the text before it since the last one,
    its length, whether it is kept.  ``_gaps`` holds the text between matches."""

    def hit(match: Column, i: Column) -> Column:
        kept = F.lit(True) if rule.keep is None else F.rlike(match, F.lit(rule.keep))
        return F.struct(
            F.lit(rule.key).alias("rule"),
            i.cast("long").alias("i"),
            F.length(F.get("_gaps", i)).cast("long").alias("gap"),
            F.length(match).cast("long").alias("chars"),
            kept.alias("kept"),
        )

    return F.transform(F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0)), hit)


def scan(blobs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows for the (blob, rule version) pairs of ``blobs`` (blob_id,
    text) that ``ledger`` lacks; blobs with nothing left to scan give none."""
    wanted = F.array(*[F.lit(r.key) for r in rules])
    unique = blobs.dropDuplicates(["blob_id"])
    if ledger is None:
        todo = unique.withColumn("rules", wanted)
    else:
        done = ledger.groupBy("blob_id").agg(F.flatten(F.collect_set("rules")).alias("done"))
        todo = (
            unique.join(done, "blob_id", "left")
            .withColumn("rules", F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>"))))
            .where(F.size("rules") > 0)
            .drop("done")
        )
    lists = []
    for n, rule in enumerate(rules):
        due = F.array_contains("rules", rule.key) & F.rlike("text", F.lit(rule.pattern))
        gaps = F.when(due, F.split("text", rule.pattern, -1))
        todo = todo.withColumn("_gaps", gaps).withColumn(f"_hits{n}", F.when(F.col("_gaps").isNotNull(), _hits(rule)))
        lists.append(F.coalesce(f"_hits{n}", F.array().cast("array<struct<rule:string,i:long,gap:long,chars:long,kept:boolean>>")))
    rows = todo.select("blob_id", "rules", F.explode_outer(F.concat(*lists)).alias("h"))
    upto = Window.partitionBy("blob_id", "h.rule").orderBy("h.i").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("h.gap") + F.col("h.chars")).over(upto)
    placed = rows.withColumn("stop", stop)
    span = F.struct(F.col("h.rule").alias("rule"), (F.col("stop") - F.col("h.chars")).alias("start"), F.col("stop"))
    return placed.groupBy("blob_id").agg(
        F.first("rules").alias("rules"),
        F.collect_list(F.when(F.col("h.kept"), span)).alias("spans"),
    )


def update_ledger(blobs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger at ``path`` lacks, append it, return the ledger."""
    spark = blobs.sparkSession
    new = scan(blobs, read_ledger(spark, path), rules)
    new.write.mode("append").parquet(path)
    return read_ledger(spark, path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)


def blob_findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per blob the spans of the current rules, by start and then as listed:
    blob_id, found array<struct<start, place, stop, kind>>.  A pair that was
    scanned twice (two writers at once) counts once."""
    place = F.create_map(*[F.lit(x) for n, r in enumerate(rules) for x in (r.key, n)])
    kinds = F.array(*[F.lit(r.kind) for r in rules])

    def ordered(s: Column) -> Column:
        at = F.try_element_at(place, s["rule"])
        return F.struct(s["start"].alias("start"), at.alias("place"), s["stop"].alias("stop"), F.get(kinds, at).alias("kind"))

    current = F.filter("spans", lambda s: F.array_contains(F.array(*[F.lit(r.key) for r in rules]), s["rule"]))
    return (
        ledger.withColumn("spans", current)
        .where(F.size("spans") > 0)
        .groupBy("blob_id")
        .agg(F.array_sort(F.array_distinct(F.transform(F.flatten(F.collect_list("spans")), ordered))).alias("found"))
    )


def findings(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Every row of ``docs`` (columns kept, plus blob_id) with what its blob holds.
    Copies of one text are many rows of one join key on the left side only,
    which adaptive execution splits."""
    empty = F.array().cast(found.schema["found"].dataType)
    return docs.withColumn("blob_id", blob_id(F.col("text"))).join(found, "blob_id", "left").withColumn(
        "found", F.coalesce("found", empty)
    )


def span_text(spans: Column) -> Column:
    said = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))
    return F.array_join(F.transform(spans, said), ",")


def own_ledger(docs: DataFrame) -> DataFrame:
    """The ledger of ``docs`` alone, in the shared folder until the driver ends."""
    path = scratch_path(docs.sparkSession, "secret-ledger")
    remove_at_end(docs.sparkSession, path)
    return update_ledger(blobs_of(docs), path)


def blobs_of(docs: DataFrame) -> DataFrame:
    return docs.select(blob_id(F.col("text")).alias("blob_id"), F.coalesce("text", F.lit("")).alias("text"))


def op3_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = own_ledger(docs)
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    digests = blob_findings(ledger).select(
        "blob_id",
        *[count(r.kind).alias(f"n_{r.kind}") for r in RULES],
        span_text(F.col("found")).alias("spans"),
    )
    rows = docs.select("doc_id", blob_id(F.col("text")).alias("blob_id")).join(digests, "blob_id", "left")
    spans = F.coalesce("spans", F.lit(""))
    return rows.select(
        "doc_id",
        *[F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in RULES],
        F.sha2(spans, 256).alias("base_sha256"),
        spans.alias("spans"),
    )


#: What stands in place of a secret.
REDACTED = "[redacted]"


def redact(docs: DataFrame, found: DataFrame, mask: str = REDACTED) -> DataFrame:
    """``docs`` with every span of a text replaced by ``mask``; spans that
    overlap share one.  All columns stay, whatever their names."""
    rows = docs.select(F.struct("*").alias("row"), F.col("text").alias("read"), blob_id(F.col("text")).alias("blob_id"))
    joined = rows.join(found.select("blob_id", F.col("found").alias("spans")), "blob_id", "left")

    def cut(acc: Column, s: Column) -> Column:
        merged = F.struct(acc["text"].alias("text"), F.greatest(acc["at"], s["stop"]).alias("at"))
        until = F.substring("read", (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        extended = F.struct(F.concat(acc["text"], until, F.lit(mask)).alias("text"), s["stop"].alias("at"))
        return F.when(s["start"] < acc["at"], merged).otherwise(extended)

    whole = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at"))
    rest = lambda acc: F.concat(acc["text"], F.substring("read", (acc["at"] + 1).cast("int"), F.length("read")))
    clean = F.when(F.size("spans") > 0, F.aggregate("spans", whole, cut, rest)).otherwise(F.col("read"))
    return joined.withColumn("clean", clean).select(
        *[F.col("clean").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    )


_BASE_ASSIGN = rf"({_NAMES})[\"'']?\x20*[:=]\x20*[\"'']?({_VALUE}+)"

OP3_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
rules(kind, place, pattern, least) AS (
  VALUES ('assign', 0, '{_BASE_ASSIGN}', 6), ('access', 1, '(AKIA[A-Z0-9]+)', 20), ('hex', 2, '([0-9a-f]+)', 24)
), cuts AS (
  SELECT r, 'assign' AS kind, 0 AS place, 6 AS least, string_split_regex(text, '{_BASE_ASSIGN}') AS gaps,
         regexp_extract_all(text, '{_BASE_ASSIGN}', 0) AS hits, regexp_extract_all(text, '{_BASE_ASSIGN}', 2) AS vals FROM docs
  UNION ALL
  SELECT r, 'access', 1, 20, string_split_regex(text, 'AKIA[A-Z0-9]+'),
         regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0), regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0) FROM docs
  UNION ALL
  SELECT r, 'hex', 2, 24, string_split_regex(text, '[0-9a-f]+'),
         regexp_extract_all(text, '[0-9a-f]+', 0), regexp_extract_all(text, '[0-9a-f]+', 0) FROM docs
), each AS (
  SELECT r, kind, place, least, i, length(hits[i]) AS n, length(vals[i]) AS v, length(gaps[i]) AS gap
  FROM cuts, unnest(range(1, len(hits) + 1)) u(i)
), placed AS (
  SELECT *, sum(gap + n) OVER (PARTITION BY r, kind ORDER BY i) AS stop FROM each
), kept AS (SELECT r, kind, place, stop - n AS start, stop FROM placed WHERE v >= least),
per AS (
  SELECT r, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
         count(*) FILTER (WHERE kind = 'hex') AS n_hex,
         string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, place) AS spans
  FROM kept GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN per USING (r)
"""
