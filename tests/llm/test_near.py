"""Consistent weighted sampling, and classes against brute force over all pairs."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from math import log

import numpy as np
import pyarrow as pa
import pytest

from funnelworks.llm import near
from funnelworks.llm.words import column_words
from tests.conftest import SF_MEDIUM, SF_SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def weights(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
    return Counter(grams)


def brute_classes(rows):
    """(doc_id, text) rows to doc_id -> class_id, by every pair of texts that share a shingle."""
    tf = [weights(t) for _, t in rows]
    n = len(rows)
    df = Counter(g for f in tf for g in f)
    idf = {g: log(1 + n / max(c, n / 3)) / log(4) for g, c in df.items()}
    feats = [{g: (1 + log(c)) * idf[g] for g, c in f.items()} for f in tf]
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    shared = defaultdict(list)
    for i, f in enumerate(feats):
        for g in f:
            shared[g].append(i)
    pairs = {(a, b) for ids in shared.values() for k, a in enumerate(ids) for b in ids[k + 1 :]}
    same = defaultdict(list)
    for i, (_, t) in enumerate(rows):
        same[t or ""].append(i)
    links = [(ids[0], x) for ids in same.values() for x in ids[1:]]
    for a, b in pairs:
        low = sum(min(w, feats[b].get(g, 0)) for g, w in feats[a].items())
        if low / (sum(feats[a].values()) + sum(feats[b].values()) - low) >= 0.8:
            links.append((a, b))
    for a, b in links:
        parent[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}


def block_features(texts, common=None):
    return near.features(next(column_words(pa.array(texts)))[1], common)


def test_samples_agree_as_often_as_weighted_jaccard(monkeypatch):
    pick = random.Random(1)
    base = [pick.choice("abcdefghijklmnop") + str(pick.randint(0, 99)) for _ in range(300)]
    texts = [" ".join(base), " ".join(base[:240] + base[:60]), " ".join(base[:150] * 2), " ".join(base[:5] * 40 + base[5:])]
    monkeypatch.setattr(near, "_KEYS", near.mix(np.arange(1, 4001, dtype=np.uint64)))
    f = block_features(texts)
    drawn = near.samples(f)
    assert (f.weights != 1).any()
    for i in range(4):
        for j in range(i):
            want = near.weighted_jaccard(f, i, f, j)
            assert abs((drawn[i] == drawn[j]).mean() - want) < 0.03, (i, j)


def test_weight_one_and_general_path_agree():
    """The short way for weight 1 is the general formula at ln w = 0."""
    f = block_features(["the quick brown fox jumps over the lazy dog again and again " * 2])
    z = near.mix(f.keys)
    e = -np.log(near._uniform(z))
    c = e - np.log(near._uniform(near.mix(z ^ np.uint64(1))))
    x = np.log(c / e)
    r = x - np.log(near._uniform(near.mix(z ^ np.uint64(2))))
    b = 1 - x / r
    assert ((b > 0) & (b < 1)).all() and np.allclose(c * np.exp(-r * (0 - b + 1)), e)


def test_weighted_jaccard_value():
    f = block_features(["a b c d e f", "a b c d e f a b c d e", "a b", "a b", "b a", ""])
    tf = 1 + log(2)
    assert near.weighted_jaccard(f, 0, f, 1) == pytest.approx(2 / (tf + 5), abs=1e-9)
    assert near.weighted_jaccard(f, 2, f, 3) == 1 and near.weighted_jaccard(f, 2, f, 4) == 0 == near.weighted_jaccard(f, 5, f, 5)


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MEDIUM])
def test_query_equals_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: r["class_id"] for r in near.op8_weighted_minhash(spark, sf).collect()}
    assert got == brute_classes(rows)
    assert len(set(got.values())) < len(got)


def test_odd_rows_hot_groups_and_kept_rows(spark):
    pick = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    rows = [(i, None if i % 2 else "") for i in range(4)] + [(4, " "), (5, "two words"), (6, "two  words"), (7, "words two")]
    base = [pick.choice(words) for _ in range(120)]
    for i in range(100, 160):  # near copies of one text: over a third of all rows
        text = list(base)
        text[pick.randrange(120)] = f"edit{i}"
        rows.append((i, " ".join(text)))
    rows += [(i, " ".join(base)) for i in range(160, 180)]
    rows += [(i, " ".join(pick.choice(words) for _ in range(60))) for i in range(200, 240)]
    rows += [(300, "long " + " ".join(pick.choice(words) for _ in range(50_000)))]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, node int, bands string")
    got = {r["doc_id"]: r["class_id"] for r in near.classes(docs).collect()}
    assert got == brute_classes(rows)
    assert {got[i] for i in range(100, 180)} == {100} and got[5] == got[6] == 5 and got[7] == 7 and got[1] == got[3] == 0
    twice = docs.union(docs).union(spark.createDataFrame([(None, "no id here at all", 1, "x")], docs.schema))
    again = near.classes(twice).collect()
    assert len(again) == 2 * len(rows) + 1 and {(r["doc_id"], r["class_id"]) for r in again if r["doc_id"] is not None} == set(got.items())
    kept = near.one_of_each(twice)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(set(got.values()))
    assert kept.where("doc_id is null").count() == 1


def test_idf_of_every_shingle_by_its_own_count(spark):
    """Shingles in well under a third of the documents have weights of their own, by their exact counts."""
    pick = random.Random(7)
    held = {f"v{k} w{k} x{k} y{k} z{k}": n for k, n in enumerate((1, 2, 3, 9, 40, 130, 400))}
    texts = [[f"o{pick.randrange(10**9)}" for _ in range(20)] for _ in range(600)]
    for passage, n in held.items():
        for i in pick.sample(range(600), n):
            texts[i].append(passage)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    common = near.common_shingles(docs.repartition(5))
    f = block_features(list(held), common)
    got = dict(zip(held.values(), f.weights))
    n = 600

    def want(c):
        share = 0.85 + 0.15 * log(1 + n / c) / log(1 + 256)
        return share * min(log(1 + n / c) / log(4), 1) if c > n / 256 else 1.0

    assert got == pytest.approx({c: want(c) for c in held.values()}, abs=1e-12)
    assert got[1] == got[2] == 1 > got[3] > got[9] > got[40] > got[130] > got[400]


def test_near_texts_fall_apart_by_idf(spark):
    """Texts near by their counts alone are not near where what they share is common."""
    pick = random.Random(11)

    def some(n):
        return [f"w{pick.randrange(10**9)}" for _ in range(n)]

    passage, pair = some(330), some(330)
    rows = [" ".join(passage + some(38)) for _ in range(90)]  # J 0.81 by counts
    rows += [" ".join(pair + some(38)) for _ in range(2)] + [" ".join(some(40)) for _ in range(228)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near.classes(docs).collect()}
    assert len({got[i] for i in range(90)}) == 90 and got[90] == got[91] == 90


def template_family(seed):
    """Texts with one long passage, J about 0.73 to each other, in pairs of J
    about 0.82 and some single ones, among other texts."""
    pick = random.Random(seed)

    def some(n):
        return [f"w{pick.randrange(10**6)}" for _ in range(n)]

    passage, rows = some(300), []
    for _ in range(30):
        pair = some(24)
        rows += [" ".join(pair + some(30) + passage) for _ in range(2)]
    rows += [" ".join(some(54) + passage) for _ in range(40)]
    rows += [" ".join(some(30)) for _ in range(220)]
    pick.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_pairs_of_a_template_family(spark, seed):
    """Most buckets of such a family are led by a text near to no other one there."""
    rows = template_family(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near.classes(docs).collect()}
    want = brute_classes(rows)
    assert len(set(want.values())) == len(rows) - 30
    assert got == want


def test_shingles_of_one_class_are_not_stored_per_class_of_weights(spark, monkeypatch):
    """As in a large table, where every cell of the shingles' order has several shingles: what is kept
    to look up texts by is a row per leading shingle, then only those that several classes share."""
    rows = template_family(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept, real = defaultdict(list), near.stored

    def stored(df, name, **options):
        out = real(df, name, **options)
        kept[name].append((out.columns, out.count()))
        return out

    monkeypatch.setattr(near, "stored", stored)
    monkeypatch.setattr(near, "cell_counts", lambda texts: np.full(64, 2, np.int32))
    got = {r["doc_id"]: r["class_id"] for r in near.classes(docs).collect()}
    assert got == brute_classes(rows)
    n = sum(len(weights(t)) for _, t in rows)  # all shingles of all texts
    per_shingle = {name: rows for name, found in kept.items() for columns, rows in found if {"rest", "node"} <= set(columns)}
    assert 0 < max(per_shingle.values()) < 0.25 * n
    assert 0 < per_shingle["mixed-leads"] < per_shingle["leads"]
    assert per_shingle["sets"] > 0


def test_rows_per_class_of_weights_are_made_of_sets_not_of_shingles(spark, monkeypatch):
    """Texts three times as long share three times as many shingles, but meet in the same sets: the rows
    made for each class of weights do not follow."""
    made, real = [], near.postings

    def postings(rows):
        out = real(rows)
        made.append(out.count())
        return out

    monkeypatch.setattr(near, "postings", postings)
    for words in (1, 3):
        rows = [(i, " ".join(f"{w}{k}" for w in t.split() for k in range(words))) for i, t in template_family(4)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert {r["doc_id"]: r["class_id"] for r in near.classes(docs).collect()} == brute_classes(rows)
    short, long = made
    assert 0 < long < 1.5 * short


def test_sets_of_the_same_texts_are_one(spark):
    rows = [(k, n, n // 2, 10.0 + n, 5.0 + k) for k, nodes in ((1, (0, 1, 4)), (2, (0, 1, 4)), (3, (0, 1)), (4, (2, 4)), (5, (4,))) for n in nodes]
    led = spark.createDataFrame(rows, "shingle long, node long, class long, weight double, rest double")
    found = defaultdict(set)
    for r in near.sets(led, "shingle").collect():
        found[r["set"]].add((r["node"], r["class"], r["weight"], r["rest"], r["lightest"], r["heaviest"]))
    one = {(n, n // 2, 10.0 + n, 7.0, 10.0, 14.0) for n in (0, 1, 4)}  # the most that shingles 1 and 2 leave
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, [one, {(n, n // 2, 10.0 + n, 9.0, 12.0, 14.0) for n in (2, 4)}]))


def test_near_texts_share_a_prefix_key():
    pick = random.Random(3)
    base = [f"w{pick.randrange(40)}" for _ in range(400)]
    texts = [" ".join(base)]
    for k in range(60):  # with repeated shingles, shorter and longer ones
        cut = base[pick.randrange(40) : 400 - pick.randrange(40)]
        for _ in range(pick.randrange(6)):
            cut[pick.randrange(len(cut))] = f"new{k}"
        texts.append(" ".join(cut + cut[: pick.randrange(60)]))
    f = block_features(texts)
    for counts in (np.full(8, 2, np.int32), np.random.default_rng(1).integers(2, 50, 1 << 12).astype(np.int32)):
        found = defaultdict(dict)
        for key, doc, weight, rest in zip(*near.prefixes(f, counts)):
            found[doc][key] = (weight, rest)
        n_near = 0
        for i in range(len(texts)):
            for j in range(i):
                met = [
                    min(found[i][k][1], found[j][k][1]) >= near.needed(found[i][k][0], found[j][k][0]) for k in found[i].keys() & found[j].keys()
                ]
                if near.weighted_jaccard(f, i, f, j) >= near.THRESHOLD:
                    n_near += 1
                    assert any(met), (i, j)
        assert n_near > 100


def test_no_table_of_the_documents_goes_through_the_driver(spark, monkeypatch):
    """Every join but that of the positions (a row per partition) deals out both sides, however small,
    and the rows kept are looked up by the classes' first texts, without the rows of every copy."""
    pick = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = [pick.choice(words) for _ in range(120)]
    rows = [(i, " ".join([*base[:i], f"edit{i}", *base[i + 1 :]])) for i in range(40)]
    rows += [(100 + i, " ".join(pick.choice(words) for _ in range(40))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plans, real = {}, near.stored

    def stored(df, name, **options):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name, **options)

    monkeypatch.setattr(near, "stored", stored)
    kept = near.one_of_each(docs)
    plans["kept"] = [kept._jdf.queryExecution().executedPlan().toString()]
    assert {r["doc_id"] for r in kept.collect()} == set(brute_classes(rows).values())
    assert {"bucket-members", "candidate-texts", "links", "labels"} <= set(plans)
    assert [n for n, found in plans.items() if n != "nodes" and any("Broadcast" in p for p in found)] == []
    assert plans["kept"][0].count("SortMergeJoin") == 2


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near.classes(none).collect() == [] and near.one_of_each(none).collect() == []
