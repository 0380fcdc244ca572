"""Importance resampling against plain Python."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from funnelworks.llm import importance
from tests.conftest import SF_SMALL
from tools.compare import norm

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return w, Counter(zlib.crc32(f.encode()) % 10_000 for f in [*w, *(" ".join(p) for p in zip(w, w[1:]))])


def plain(docs, bench):
    """Sorted (doc_id, n_features, weight, score) of all rows, and the drawn ids in order."""
    own = [(i, *plain_features(t)) for i, t in docs]
    s, t = Counter(), Counter()
    for _, _, f in own:
        s.update(f)
    for text in bench:
        t.update(plain_features(text)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
    rows = []
    for i, w, f in own:
        n = sum(f.values())
        weight = sum(gain(b) * k for b, k in f.items()) // n if n else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= 20))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return Counter(r[:4] for r in rows), [r[0] for r in able[: 25 * len(able) // 100]]


TEXTS = [
    None, "", " \t", "One two THREE ÉTÉ été 4 5-6 seven'eight\x00nine{ten}", "a" * 70 + " " + "B" * 65 + "x" + " c" * 30,
    "words and words " * 40, "x" * 200_000 + " end of it", "long text here " * 50_000, "👍 中文 字\x7f字 " * 12, "0 1 2 3 4 5 6 7 8 9 " * 3,
]


def frames(spark, docs, bench):
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, rank int, _x int")
    return d, spark.createDataFrame([(t,) for t in bench], "text string")


def run(d, b):
    gain = importance.gains(importance.bucket_counts(d.select("text")), importance.bucket_counts(b.select("text")))
    return importance.draw(importance.scored(d, gain)).collect()


def check(spark, docs, bench):
    rows = run(*frames(spark, docs, bench))
    want, drawn = plain(docs, bench)
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in rows) == want
    ranked = sorted((r for r in rows if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [r["doc_id"] for r in ranked] == drawn
    return rows


def test_odd_rows(spark):
    docs = list(enumerate(TEXTS)) + [(None, TEXTS[5]), (None, None), (5, TEXTS[5]), (5, TEXTS[5]), (5, "other text " * 30)]
    check(spark, docs, ["Words and more", None, "", "été 4 5"])
    check(spark, docs, [])
    assert run(*[f.where("false") for f in frames(spark, docs, ["a"])]) == []
    check(spark, [(1, "too short")], ["a"])


@pytest.mark.parametrize("around", [0.005, 0.2, 1e-6])
def test_many_ties_and_a_hot_key(spark, monkeypatch, around):
    """A third of the rows share id and text, so one score; any first bracket leads to the same draw."""
    monkeypatch.setattr(importance, "AROUND", around)
    docs = [(i, f"text number {i} " * 8) for i in range(200)] + [(None, "same text every time " * 9)] * 60 + [(-4, "same text every time " * 9)] * 60
    rows = check(spark, docs, ["text number"])
    assert sum(r["rank"] is not None for r in rows) == 80


@pytest.mark.parametrize("start", [(0.0, 0.0), (1.0, 1.0), (0.4, 0.4)])
def test_bracket_moves_to_the_cutoff(spark, start, monkeypatch):
    scores = spark.range(1000).select((F.col("id") * 3 - 700).alias("score"))
    monkeypatch.setattr(importance.F, "percentile_approx", lambda c, p, n: F.array(*[F.lit(int(2997 * s) - 700) for s in start]))
    for wanted in (1, 2, 300, 1000):
        low, high, above = importance.bracket(scores, wanted, 1000)
        cutoff = 999 * 3 - 700 - 3 * (wanted - 1)
        assert low <= cutoff <= high and above == scores.where(F.col("score") > high).count() < wanted


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    bench = [r["text"] for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    rows = importance.op11_importance_resampling(spark, SF_SMALL).collect()
    want, drawn = plain(docs, bench)
    assert Counter(tuple(r)[:4] for r in rows) == want
    assert [r["doc_id"] for r in sorted((r for r in rows if r["rank"]), key=lambda r: r["rank"])] == drawn


def test_query_equals_sql_on_odd_rows(spark, tmp_path):
    docs = list(enumerate(t for t in TEXTS if len(t or "") < 10_000)) + [(None, "null id " * 20), (90, None)]
    docs += [(100 + i, f"some text {i % 5} of several words " * (i % 7)) for i in range(60)]
    d, b = frames(spark, docs, ["Some text", "words of ÉTÉ été", None])
    d.write.parquet(f"{tmp_path}/documents.parquet")
    b.withColumn("item_id", F.lit(1)).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    rel, df = con.sql(importance.OP11_SQL), importance.op11_importance_resampling(spark, str(tmp_path))
    order = sorted(df.columns)
    assert sorted(rel.columns) == order
    want = sorted(tuple(norm(v, None) for v in (r[rel.columns.index(c)] for c in order)) for r in rel.fetchall())
    assert sorted(tuple(norm(r[c], None) for c in order) for r in df.collect()) == want
