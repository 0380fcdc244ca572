"""The context-tree code lengths against a plain implementation, and held-out accuracy."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from funnelworks.llm import language
from tests.conftest import SF_MEDIUM

TRAIN = [("en", "the cat and the hat"), ("fr", "le chat et le chapeau"), ("en", "then the end"), ("fr", "été"), ("fr", "la")]


def grams(order):
    out = Counter()
    for lang, text in TRAIN:
        data = text.encode()
        for k in range(order + 1):
            for i in range(len(data) - k):
                out[lang, k, int.from_bytes(data[i : i + k + 1], "big")] += 1
    return out


def model_of(order):
    counted = grams(order)
    langs, ks, numbers = zip(*counted)
    return language.build(langs, ks, numbers, list(counted.values()), order)


def plain_bits(text, lang, order, contexts):
    """PPM, method C, with the contexts that the model kept."""
    counts = defaultdict(Counter)
    for name, sample in TRAIN:
        if name == lang:
            data = sample.encode()
            for k in range(order + 1):
                for i in range(len(data) - k):
                    counts[data[i : i + k]][data[i + k]] += 1
    data, total = text.encode(), 0.0
    for i, byte in enumerate(data):
        k = 0
        while k < order and i - k - 1 >= 0 and data[i - k - 1 : i] in contexts:
            k += 1
        while True:
            after = counts[data[i - k : i]] if k else counts[b""]
            n, distinct = sum(after.values()), len(after)
            if after[byte]:
                total += math.log2((n + distinct) / after[byte])
                break
            if n:
                total += math.log2((n + distinct) / distinct)
            if k == 0:
                total += 8
                break
            k -= 1
    return total


@pytest.mark.parametrize("order", [0, 1, 2, 3])
def test_code_lengths_equal_plain_ppm(order, monkeypatch):
    model = model_of(order)
    contexts = {t.encode()[i : i + k] for _, t in TRAIN for k in range(1, order + 1) for i in range(len(t.encode()) - k)}
    texts = ["the chat", "", "été et l'hat", "zzz\x00", "e", "then the hat and le chapeau " * 5]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *[len(t.encode()) for t in texts]])
    for piece in (1 << 18, 16):  # in one go, and long texts piece by piece
        monkeypatch.setattr(language, "PIECE_BYTES", piece)
        got = model.code_lengths(data, offsets) / language.UNIT
        want = [[plain_bits(t, lang, order, contexts) for lang in ("en", "fr")] for t in texts]
        assert np.allclose(got, want, atol=0.01)


def test_odd_rows(spark):
    model = model_of(2)
    rows = [(1, "the hat", "fr"), (2, None, "en"), (3, "12 34!", "en"), (4, "le chat", None), (None, "the hat", None), (6, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").withColumnRenamed("score", "lang")
    got = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4, None, 6)] == ["en", "und", "und", "fr", "en", "und"]
    assert got[1]["score"] == got[None]["score"] > 0.5 and got[2]["score"] == 0.0 and got[3]["bits_per_byte"] is None
    assert [got[i]["text"] for i in (1, 2)] == ["the hat", None]
    nothing = language.learn(docs.where("false"))
    assert {r["lang_pred"] for r in language.predict(docs, nothing).collect()} == {"und"}
    assert language.predict(docs.where("false"), model).count() == 0
    assert language.learn(docs, least=1).languages == ["en", "fr"]


def test_many_languages_and_repeated_rows(spark):
    """A hundred languages, one of them with nearly all texts: each is learned, with its own contexts."""
    rows, n = [], 100
    for j in range(n):
        pick = random.Random(j)
        words = ["".join(pick.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(12)]
        for i in range(200 if j == 0 else 6):
            rows.append((len(rows), " ".join(pick.choice(words) for _ in range(40)), f"l{j:03}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(docs.where("doc_id % 6 <> 1"), least=4, nodes=300)
    assert len(model.languages) == n and len(model.child) - 1 <= n * 301
    assert len(set(np.diff([*model.roots, len(model.child) - 1]))) <= n and max(np.diff(model.roots)) <= 301
    got = language.predict(docs.union(docs), model).collect()
    assert len(got) == 2 * len(rows)
    assert sum(r["lang"] == r["lang_pred"] for r in got if r["doc_id"] % 6 == 1) > 0.97 * sum(r["doc_id"] % 6 == 1 for r in got)
    once = {tuple(r) for r in got}
    assert len(once) == len(rows)  # copies score equal


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_MEDIUM}/documents.parquet").select("doc_id", "lang")
    rows = language.op1_ppm_language(spark, SF_MEDIUM).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    asked = [r for r in rows if r["held_out"]]
    assert len(asked) > 150 and all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in asked) / len(asked) > 0.97
