"""Tokenising, packing and training order against plain Python."""

from __future__ import annotations

import tempfile
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from funnelworks.llm import packing, tokens, training_order
from tests.conftest import SF_SMALL

ODD = [None, "", "a", "<|endoftext|>", "x <|endoftext|> y", "  \n\t é中👍\x00 \x85", "word " * 5000, "z" * 9000]


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "extra") for i, t in enumerate(ODD)] + [(None, "no id", "extra"), (2, "a", "extra")]
    return spark.createDataFrame(rows, "doc_id long, text string, length string")


def expected_ids(reference, text):
    return [*reference.encode(text or "", add_special_tokens=False).ids, 1]


def test_ids_equal_the_reference_tokenizer(spark, reference):
    path = tokens.default_ranks_path()
    texts = [r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    for text in [*ODD, *texts]:
        assert tokens.token_ids(text, path).tolist() == expected_ids(reference, text)


def check_pieces(rows, docs, reference):
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    sequences = [r["sequence_id"] for r in rows]
    assert sorted(sequences) == list(range(len(rows)))
    for doc_id, texts in docs.items():
        ids = expected_ids(reference, texts[0])
        mine = sorted(by_doc[doc_id], key=lambda r: (r["start"], r["sequence_id"]))[:: len(texts)]
        assert [r["start"] for r in mine] == [sum(r["length"] for r in mine[:i]) for i in range(len(mine))]
        assert sum(r["length"] for r in mine) == len(ids)
        for r in mine:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert r["ids_crc32"] == zlib.crc32(part.tobytes())
            assert r["doc_tokens"] == len(ids) and r["offset"] == 0
            assert r["length"] <= 2048 and r["length"] & (r["length"] - 1) == 0


def test_pack_odd_rows(odd, reference):
    docs = {}
    for r in odd.collect():
        docs.setdefault(r["doc_id"], []).append(r["text"])
    rows = packing.pack(odd).collect()
    check_pieces(rows, docs, reference)
    ordered = sorted(rows, key=lambda r: r["sequence_id"])
    assert [r["length"] for r in ordered] == sorted((r["length"] for r in rows), reverse=True)


def test_pack_query_on_the_whole_table(spark, reference):
    docs = {r["doc_id"]: [r["text"]] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    check_pieces(packing.op6_power_of_two(spark, SF_SMALL).collect(), docs, reference)


def test_piece_ids_and_lengths(odd, reference):
    assert packing.piece_lengths(4096 + 13) == [2048, 2048, 8, 4, 1]
    assert packing.piece_lengths(1) == [1]
    texts = {}
    for r in sorted(packing.piece_ids(odd.where("doc_id <> 2")).collect(), key=lambda r: (r["doc_id"], r["start"])):
        texts.setdefault(r["doc_id"], []).extend(r["ids"])
    assert texts == {i: expected_ids(reference, t) for i, t in enumerate(ODD) if i != 2}


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(none).collect() == []
    assert training_order.in_training_order(none, 1).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 65_537])
def test_permutation_is_a_bijection(n):
    numbers = np.arange(n)
    for key in (0, 7):
        slots = training_order.permute(numbers, n, key)
        assert sorted(slots.tolist()) == numbers.tolist()
        assert training_order.permute(slots, n, key, inverse=True).tolist() == numbers.tolist()
    if n == 1000:
        assert (training_order.permute(numbers, n, 0) != training_order.permute(numbers, n, 7)).mean() > 0.9
        assert np.abs(np.corrcoef(numbers, training_order.permute(numbers, n, 7))[0, 1]) < 0.1


def test_slots_do_not_depend_on_the_partitions(spark, odd):
    more = odd.unionByName(spark.createDataFrame([(i % 7, f"text {i} " * (i % 40), "x") for i in range(200)], odd.schema))
    rows = lambda docs: sorted((r["slot"], r["doc_id"], r["seq"], bytes(r["bytes"])) for r in training_order.in_training_order(docs, 5, length=16).fillna(-1, ["doc_id"]).collect())
    first = rows(more)
    assert rows(more.repartition(3)) == first and rows(more.coalesce(1)) == first and rows(more.repartition(11, "text")) == first


def test_ids_that_do_not_fit_are_an_error():
    assert training_order.fitting(np.array([0, 65_535], np.uint32)).tolist() == [0, 65_535]
    with pytest.raises(ValueError):
        training_order.fitting(np.array([65_536], np.uint32))


def test_training_order_round_trip(odd, reference):
    records = training_order.in_training_order(odd, key=5, length=16, per_shard=100).cache()
    rows = sorted(records.collect(), key=lambda r: r["slot"])
    n = len(rows)
    assert [r["slot"] for r in rows] == list(range(n)) and n > 500
    assert all(r["slot"] == r["shard"] * 100 + r["record"] for r in rows)
    got = {}
    for r in rows:
        ids = np.frombuffer(r["bytes"], "<u2")
        assert len(ids) == 16 and not ids[r["n_tokens"] :].any()
        got.setdefault((r["doc_id"], r["seq"]), []).append(ids[: r["n_tokens"]].tolist())
    for i, text in enumerate(ODD):
        ids = expected_ids(reference, text)
        parts = [ids[at : at + 16] for at in range(0, len(ids), 16)]
        assert [got[i, k][0] for k in range(len(parts))] == parts and (i, len(parts)) not in got
    assert len(got[2, 0]) == 2 and (None, 0) in got
    assert sum(a["doc_id"] == b["doc_id"] for a, b in zip(rows, rows[1:])) < 0.8 * n

    uri = "file://" + tempfile.mkdtemp(prefix="funnelworks-test-shards-")
    for _ in range(2):  # a second run writes the same files
        manifest = sorted(training_order.write_shards(records, uri).collect(), key=lambda r: r["shard"])
        assert [r["first_slot"] for r in manifest] == list(range(0, n, 100))
        assert sum(r["records"] for r in manifest) == n
        for r in manifest:
            data = open(f"{uri[7:]}/{r['file']}", "rb").read()
            assert len(data) == r["bytes"] == r["records"] * 32 and zlib.crc32(data) == r["crc32"]
    resumed = list(training_order.read_slots(uri, 95, 30, length=16, per_shard=100))
    assert [x.tobytes() for x in resumed] == [r["bytes"] for r in rows[95:125]]
    assert len(list(training_order.read_slots(uri, n - 3, 3, length=16, per_shard=100))) == 3
