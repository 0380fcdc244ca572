"""Training-order materialisation.

Documents become sequences of at most ``LENGTH`` ids, numbered without gaps; a
keyed Feistel network with cycle-walking maps the numbers 0..n-1 onto the slots
0..n-1 of the training order, so any row's slot is arithmetic and any order is
a key.  Rows go to range partitions of the slots, one a shard, and become
records of fixed stride: record r of shard s is slot s * per_shard + r, at byte
r * stride, so a reader seeks to any step and reads on from there.

Numbers follow a total order (doc_id, a hash of the text, place in the text),
whatever partitions the documents come in: the same documents and key give the
same slots in any run.  The numbered sequences are stored once
(``spark.checkpoint.dir``), so a lost task repeats its slots as well.

Defined results: a null or empty text is one sequence of the end id; repeated
rows are sequences of their own; an empty table gives no rows; extra columns
are ignored; a null doc_id is kept as null and comes first; an id that a record
cannot hold (another vocabulary) is an error.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelworks.llm.common import stored, table
from funnelworks.llm.tokens import default_ranks_path, token_ids
from funnelworks.llm.words import mix

LENGTH = 512
PER_SHARD = 16_384
PAD = 0
ROUNDS = 6
#: Ids are below 2**16, so a record holds little-endian unsigned 16-bit ids.
ID_TYPE = np.dtype("<u2")

SEQUENCES = "doc_id long, seq long, n_tokens int, ids binary"
RECORDS = "shard long, record long, slot long, doc_id long, seq long, n_tokens int, bytes binary"
SHARDS = "shard long, first_slot long, records long, bytes long, crc32 long, file string"


def permute(numbers: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """The keyed permutation of 0..n-1, or its inverse.

    The network works on the least even number of bits that holds n-1; values
    it sends to n or above go through it again until they fall below.
    """
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    shift = np.uint64(half)
    keys = [np.uint64((key + 0x9E3779B97F4A7C15 * (r + 1)) % (1 << 64)) for r in range(ROUNDS)]

    def through(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & low
        for k in reversed(keys) if inverse else keys:
            if inverse:
                left, right = right ^ (mix(left ^ k) & low), left
            else:
                left, right = right, left ^ (mix(right ^ k) & low)
        return (left << shift) | right

    out = through(np.asarray(numbers, np.uint64))
    while (over := out >= np.uint64(n)).any():
        out[over] = through(out[over])
    return out.astype(np.int64)


def fitting(ids: np.ndarray) -> np.ndarray:
    """The ids in a record's type; an error where one does not fit."""
    if len(ids) and ids.max() > np.iinfo(ID_TYPE).max:
        raise ValueError(f"token id {ids.max()} does not fit in {ID_TYPE.itemsize} bytes")
    return ids.astype(ID_TYPE)


def sequences(docs: DataFrame, ranks: str | None = None, length: int = LENGTH) -> DataFrame:
    """doc_id, seq, n_tokens, ids: each document's ids, closed by the end id, cut every ``length``."""
    path = ranks or default_ranks_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = fitting(token_ids(text.as_py(), path))
                for k, at in enumerate(range(0, len(ids), length)):
                    part = ids[at : at + length]
                    rows.append((doc_id, k, len(part), part.tobytes()))
            columns = list(zip(*rows)) or [[]] * 4
            types = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "seq", "n_tokens", "ids"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, SEQUENCES)


def in_training_order(
    docs: DataFrame, key: int, ranks: str | None = None, length: int = LENGTH, per_shard: int = PER_SHARD
) -> DataFrame:
    """One row per record, dealt by shard and sorted by slot within it."""
    spark = docs.sparkSession
    # ranges of the total order, each sorted: a sequence's place follows from the order alone
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64(F.coalesce("text", F.lit("")))]
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(*order).sortWithinPartitions(*order)
    rows = sequences(ordered, ranks, length).withColumn("at", F.monotonically_increasing_id())
    numbered = stored(rows, "sequences", compression="zstd")
    part = F.shiftright("at", 33).alias("part")
    sizes = sorted((r["part"], r["n"]) for r in numbered.groupBy(part).agg(F.count("*").alias("n")).collect())
    starts, n = [], 0
    for p, m in sizes:
        starts.append((p, n))
        n += m
    offsets = F.broadcast(spark.createDataFrame(starts, "part long, first long"))  # a row per partition
    total = n

    @F.pandas_udf("long")
    def slot(number: pd.Series) -> pd.Series:
        return pd.Series(permute(number.to_numpy(), total, key))

    stride = length * ID_TYPE.itemsize
    padding = np.full(length, PAD, ID_TYPE).tobytes()
    number = F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = (
        numbered.withColumn("part", F.shiftright("at", 33))
        .join(offsets, "part")
        .select(slot(number).alias("slot"), "doc_id", "seq", "n_tokens", "ids")
        .withColumn("shard", F.floor(F.col("slot") / per_shard))
    )
    shards = max(1, -(-n // per_shard))
    return (
        placed.repartitionById(shards, F.col("shard").cast("int"))
        .sortWithinPartitions("slot")
        .select(
            "shard",
            (F.col("slot") % per_shard).alias("record"),
            "slot",
            "doc_id",
            "seq",
            "n_tokens",
            F.substring(F.concat("ids", F.lit(padding)), 1, stride).alias("bytes"),
        )
    )


def shard_file(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def write_shards(records: DataFrame, uri: str) -> DataFrame:
    """Write the records of ``in_training_order`` as one file a shard under
    ``uri`` (a folder every executor reaches: file, hdfs, s3, gs) and return
    the manifest.  A file appears under its name when it is whole, so a retried
    or second attempt writes the same bytes and a reader never sees half."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(uri)
        store.create_dir(folder, recursive=True)
        out, done = None, []

        def close() -> None:
            out["to"].close()
            store.move(out["temp"], f"{folder}/{shard_file(out['shard'])}")
            done.append((out["shard"], out["slot"], out["records"], out["bytes"], out["crc"], shard_file(out["shard"])))

        for batch in batches:
            for shard, slot, record in zip(*(batch.column(c).to_pylist() for c in ("shard", "slot", "bytes"))):
                if out is None or out["shard"] != shard:
                    if out is not None:
                        close()
                    temp = f"{folder}/.{shard_file(shard)}.{uuid.uuid4().hex}"
                    out = {"shard": shard, "slot": slot, "records": 0, "bytes": 0, "crc": 0, "temp": temp, "to": store.open_output_stream(temp)}
                out["to"].write(record)
                out["records"] += 1
                out["bytes"] += len(record)
                out["crc"] = zlib.crc32(record, out["crc"])
        if out is not None:
            close()
        columns = list(zip(*done)) or [[]] * 6
        types = [pa.int64()] * 5 + [pa.string()]
        names = [x.split()[0] for x in SHARDS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return records.select("shard", "slot", "bytes").mapInArrow(write, SHARDS)


def read_slots(uri: str, first: int, count: int, length: int = LENGTH, per_shard: int = PER_SHARD) -> Iterator[np.ndarray]:
    """The ids of ``count`` records from slot ``first`` on, read in order by seeking."""
    from pyarrow import fs

    store, folder = fs.FileSystem.from_uri(uri)
    stride = length * ID_TYPE.itemsize
    slot = first
    while slot < first + count:
        shard, record = divmod(slot, per_shard)
        take = min(per_shard - record, first + count - slot)
        with store.open_input_file(f"{folder}/{shard_file(shard)}") as f:
            f.seek(record * stride)
            for _ in range(take):
                data = f.read(stride)
                if len(data) < stride:
                    return
                yield np.frombuffer(data, ID_TYPE)
        slot += take


#: The order of the registered query.
ORDER_KEY = 2024


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_training_order(table(spark, sf_dir, "documents").select("doc_id", "text"), ORDER_KEY)
