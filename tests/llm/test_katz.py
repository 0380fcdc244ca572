"""Katz backoff against a plain implementation, and its probabilities' sums."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from funnelworks.llm import katz
from tests.conftest import SF_SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
END = ("end",)


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(low), END]


class Plain:
    """The model by definition, over dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        self.counts = [Counter() for _ in range(order + 1)]
        for text in texts:
            t = tokens(text)
            for k in range(1, order + 1):
                self.counts[k].update(tuple(t[i : i + k]) for i in range(len(t) - k + 1))
        self.after = defaultdict(dict)  # history to the tokens seen after it
        for k in range(1, order + 1):
            for gram, c in self.counts[k].items():
                self.after[gram[:-1]][gram[-1]] = c
        self.discount = [None] + [self._discounts(Counter(c.values())) for c in self.counts[1:]]
        self.tokens = sum(self.counts[1].values())
        self.known = {}

    @staticmethod
    def _discounts(n):
        out = {}
        beyond = 6 * n[6] / n[1] if n[1] else 1
        for r in range(1, 6):
            d = ((r + 1) * n[r + 1] / (r * n[r]) - beyond) / (1 - beyond) if n[r] and beyond < 1 else 1
            out[r] = d if 0 < d < 1 else 1
        return out

    def _seen(self, history):
        seen, d = self.after.get(history, {}), self.discount[len(history) + 1]
        total = sum(seen.values())
        kept = math.fsum(d.get(c, 1) * c for c in seen.values())
        if kept >= total:
            total += 1
        return {w: d.get(c, 1) * c / total for w, c in seen.items()}, (total - kept) / total

    def prob(self, word, history):
        history = history[len(history) - self.order + 1 :] if self.order > 1 else ()
        if history not in self.known:
            seen, left = self._seen(history)
            rest = 1 - math.fsum(self.prob(w, history[1:]) for w in seen) if history and seen else 1
            self.known[history] = seen, left / rest
        seen, weight = self.known[history]
        if word in seen:
            return seen[word]
        return weight * (self.prob(word, history[1:]) if history else 1)

    def scores(self, text):
        t = tokens(text)
        base = sum(math.log10((self.counts[1][(w,)] + 0.1) / (self.tokens + 0.1 * (len(self.counts[1]) + 1))) for w in t)
        score = sum(math.log10(self.prob(w, tuple(t[max(0, i - self.order + 1) : i]))) for i, w in enumerate(t))
        return len(t), sum((w,) in self.counts[1] for w in t), base, score


def some_texts(n, seed=1):
    pick = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    return [" ".join(pick.choices(vocabulary, weights, k=pick.randint(0, 60))) for _ in range(n)]


ODD = [None, "", " \t\n", "W0 w1", "ÉTÉ été", "never seen words", "w0 " * 5000, "x" * 100_000, "w0\x00w1 w2\x1fw3", "W0 W1 w2 w3 w4"]


def close(rows, want):
    assert len(rows) == len(want)
    for r in rows:
        n, known, base, score = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"]) == (n, known)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-9)


def as_docs(spark, texts):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, g int, k int")


@pytest.mark.parametrize("order, small", [(1, True), (2, False), (2, True), (3, True)])
def test_equals_plain_katz(spark, monkeypatch, order, small):
    """In one range, and in many with split histories and groups."""
    if small:
        monkeypatch.setattr(katz, "LEAST_BYTES", 1000)
        monkeypatch.setattr(katz, "PAYLOAD", 1)
    train, asked = some_texts(300) + ["w0 w1 w2"] * 40 + [None, ""], some_texts(60, 2) + ODD
    model = katz.learn(as_docs(spark, train), order)
    plain = Plain(train, order)
    assert (model.tokens, model.distinct) == (plain.tokens, len(plain.counts[1]))
    if small:
        assert model.ranges > 10
        if order > 1:
            assert len(model.levels[1].hot.keys) > 2
    rows = katz.score(as_docs(spark, asked), model).collect()
    close(rows, {i: plain.scores(t) for i, t in enumerate(asked)})


def test_probabilities_sum_to_one():
    plain = Plain(some_texts(300) + ["w0 w1 w2"] * 40, 3)
    words = [w for (w,) in plain.counts[1]]
    for history in [(), ("w0",), ("w5",), ("w0", "w1"), ("w58", "w59"), ("no",), ("no", "w0")]:
        assert math.isclose(math.fsum(plain.prob(w, history) for w in [*words, "unknown"]), 1, rel_tol=1e-9)


def test_nothing_learned_and_repeats(spark):
    docs = as_docs(spark, ODD)
    rows = katz.score(docs, katz.learn(docs.where("false"))).collect()
    assert {r["score"] for r in rows} == {0.0} == {r["base_score"] for r in rows}
    model = katz.learn(docs)
    assert katz.score(docs.where("false"), model).collect() == []
    twice = docs.selectExpr("cast(null AS long) AS doc_id", "text").where("text LIKE 'W0%'")
    rows = katz.score(twice.union(twice), model).collect()
    assert len(rows) == 4 and len({r["score"] for r in rows}) == 2
    certain = katz.learn(as_docs(spark, ["a b"] * 9))  # discounts leave a history nothing: its total is one larger
    rows = katz.score(as_docs(spark, ["a b", "a a"]), certain).collect()
    close(rows, {i: Plain(["a b"] * 9, 2).scores(t) for i, t in enumerate(["a b", "a a"])})


def test_query_equals_plain_katz(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    out = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 10 == 0}
    plain = Plain([t for i, t in docs if i not in out], 2)
    rows = katz.op12_katz_backoff(spark, SF_SMALL).collect()
    close(rows, {i: plain.scores(t) for i, t in docs})
    assert {r["doc_id"] for r in rows if r["held_out"]} == out and {r["train_tokens"] for r in rows} == {plain.tokens}
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    texts = dict(docs)
    by_text = defaultdict(set)
    for r in rows:
        by_text[texts[r["doc_id"]]].add((r["base_score"], r["score"]))
    assert all(len(s) == 1 for s in by_text.values())
