"""Seed and extend against brute force over all windows."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from funnelworks.llm import substrings
from tests.conftest import SF_MEDIUM, SF_SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """(doc_id, text) rows to {(doc_id, n_words, n_removed, sha)} as a sorted list."""
    rank = lambda d: -(1 << 63) if d is None else d
    earliest = {}
    split = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - 12):
            key = tuple(w[i : i + 13])
            earliest[key] = min(earliest.get(key, rank(d)), rank(d))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - 12):
            if earliest[tuple(w[i : i + 13])] < rank(d):
                gone.update(range(i, i + 13))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    rows = df.collect()
    return sorted(
        ((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in rows), key=str
    )


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MEDIUM])
def test_query_equals_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in substrings.op9_seed_extend(spark, sf).collect()), key=str)
    assert got == brute(rows)
    assert sum(r[2] > 0 for r in got) > 10


def test_odd_rows_and_many_groups(spark, monkeypatch):
    pick = random.Random(3)
    words = [f"w{i}é" for i in range(400)]
    passage = [pick.choice(words) for _ in range(40)]
    rows = [(None, " ".join(passage)), (5, None), (6, ""), (7, " \n\t "), (8, " ".join(passage[:12])), (9, "same " * 60), (10, "same " * 13)]
    rows += [(11, "same x " * 20), (12, "z" * 300_000 + " " + "\r\n".join(passage[5:30])), (13, "a b"), (13, "a b")]
    for d in range(20, 220):
        text = [pick.choice(words) for _ in range(pick.randint(1, 90))]
        at = pick.randint(0, len(text))
        a, b = sorted(pick.sample(range(41), 2))
        rows.append((d if d % 9 else d - 1, pick.choice([" ", "\n ", "\t"]).join([*text[:at], *passage[a:b], *text[at:]])))
    rows += rows[20:40]
    pick.shuffle(rows)
    docs = spark.createDataFrame([(d, t, "g", 1) for d, t in rows], "doc_id long, text string, g string, keys int")
    want = brute(rows)
    assert result(substrings.remove_repeats(docs)) == want
    monkeypatch.setattr(substrings, "GROUP_BYTES", 20_000)
    monkeypatch.setattr(substrings, "RANGE_BYTES", 40_000)
    assert result(substrings.remove_repeats(docs)) == want


def test_rows_without_an_id_spread(spark, monkeypatch):
    """Rows of one id, or none, are dealt over the groups; anchors fill their ranges evenly."""
    pick = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    passage = " ".join(pick.choice(words) for _ in range(30))
    rows = [(pick.choice([None, None, 4]), " ".join(pick.choice(words) for _ in range(60)) + (passage if i % 3 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(substrings, "GROUP_BYTES", 8_000)
    monkeypatch.setattr(substrings, "RANGE_BYTES", 16_000)
    sizes, ranges = [], []
    windows = substrings._windows_of_group

    def counted(n):
        ranges.append(n)
        return windows(n)

    monkeypatch.setattr(substrings, "_windows_of_group", counted)
    done = substrings.remove_repeats(docs)
    assert result(done) == brute(rows)
    block = next(b for _, b in substrings._blocks(pa.chunked_array([pa.array([t for _, t in rows])])))
    anchors = np.unique(substrings._window_anchors(block)[2])
    sizes = [s.stop - s.start for _, s in substrings._by_range(anchors, 16)]
    assert len(sizes) == 16 and max(sizes) < 2 * min(sizes) and ranges[0] > 5


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.remove_repeats(none).collect() == []
