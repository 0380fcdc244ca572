"""The corpus pipeline: documents to packed training sequences.

``STAGES`` run in order; each works on the whole table that the one before it
kept, written as Parquet and read again.  All but the last return the columns
of their input.

1. language: rejects texts without a letter and texts that even the best
   language model codes far longer than plain bytes (mostly bytes that no
   learned language has); fills in a missing ``lang``.
2. near_duplicates: keeps one document of each class of near duplicates.
3. decontaminate: drops documents that hold a benchmark item.
4. secrets: replaces secrets in the texts (``n_chars`` follows).
5. pack: cuts the documents' token ids into sequences.

Empty tables give empty tables at every stage; null texts go at the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelworks.llm import decontaminate, language, near, packing, secrets
from funnelworks.llm.common import stored, table

#: Bits a byte of the best language from which on a text is in no learned language.
REJECT_BITS = 14.0


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.learn(docs.where(~language.held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    rows = docs.select(F.struct("*").alias("row"), "text")
    told = language.predict(rows, model, ["row"])
    kept = told.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("bits_per_byte") < REJECT_BITS))
    lang = F.coalesce("row.lang", "lang_pred")
    return kept.select(*[lang.alias(c) if c == "lang" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact(docs, secrets.blob_findings(secrets.own_ledger(docs)))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("secrets", redact_secrets),
    ("pack", pack),
]

#: The language model and the token ids have no SQL form; tests hold the
#: pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
