"""Packing by power-of-two decomposition.

A document's ids (closed by the end id) are cut into as many pieces of
``MAX_LENGTH`` as fit and, for what is left, one piece for each set bit of its
length, longest first.  A piece is a sequence of its own: none crosses
documents and none needs padding.  Sequence ids run through the buckets of
equal length, longest first, so a batch of one length is a range of ids.

Defined results: a null or empty text is the end id alone, a sequence of one;
repeated rows are packed each; rows with a null id are packed too; an empty
table gives no sequences; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelworks.llm.common import stored, table, with_position
from funnelworks.llm.tokens import default_ranks_path, token_ids

MAX_LENGTH = 2048

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def piece_lengths(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """Powers of two, at most ``longest``, in falling order, that add up to ``n``."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces(docs: DataFrame, ranks: str | None = None, longest: int = MAX_LENGTH) -> DataFrame:
    """One row per piece of every document, without the ids (see ``piece_ids``)."""
    path = ranks or default_ranks_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = token_ids(text.as_py(), path)
                at = 0
                for n in piece_lengths(len(ids), longest):
                    rows.append((doc_id, at, n, zlib.crc32(ids[at : at + n].data), len(ids)))
                    at += n
            columns = list(zip(*rows)) or [[]] * 5
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def pack(docs: DataFrame, ranks: str | None = None, longest: int = MAX_LENGTH) -> DataFrame:
    """Every piece with its sequence: sequence_id, and offset 0 in it."""
    order = [F.col("length").desc(), *map(F.col, ("doc_id", "start", "ids_crc32", "doc_tokens"))]
    cut = stored(pieces(docs, ranks, longest), "pieces")  # else the sort's sampling would encode every text again
    placed = with_position(cut, *order, position="sequence_id", name="sequences")
    return placed.withColumn("offset", F.lit(0).cast("long"))


def piece_ids(docs: DataFrame, ranks: str | None = None, longest: int = MAX_LENGTH) -> DataFrame:
    """doc_id, start, ids (array of int) of every piece, for writing them out."""
    path = ranks or default_ranks_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = token_ids(text.as_py(), path).astype("int32")
                starts, at = [], 0
                for n in piece_lengths(len(ids), longest):
                    starts.append(at)
                    at += n
                lists = pa.ListArray.from_arrays(pa.array([*starts, len(ids)], pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id] * len(starts), pa.int64()), pa.array(starts, pa.int64()), lists],
                    names=["doc_id", "start", "ids"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, start long, ids array<int>")


def op6_power_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
