"""Ptolemaic clustering against comparing every vector with every centroid."""

from __future__ import annotations

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from funnelworks.llm import centroids
from tests.conftest import SF_SMALL
from tools.compare import norm

NAN, INF = float("nan"), float("inf")


def plain(rows, clusters, rounds, width, seed="1"):
    """Sorted (vec_id, cluster, distance), and the final centroids."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    told = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (told(r[0]), r[1]))[:clusters]]
    for r in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres)) for _, v in kept]
        for k in range(len(centres) if r < rounds else 0):
            own = [v for (_, v), (_, n) in zip(kept, near) if n == k]
            if own:
                centres[k] = [sum(x) // len(own) for x in zip(*own)]
    return sorted(((i is None, i or 0), k, d) for (i, _), (d, k) in zip(kept, near)), centres


def got(spark, rows, clusters, rounds, width, extra=False):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    if extra:
        df = df.selectExpr("*", "1 AS x", "2 AS far", "3 AS cluster")
    told, centres = centroids.cluster(df, clusters, rounds, width)
    return sorted(((r["vec_id"] is None, r["vec_id"] or 0), r["cluster"], r["distance"]) for r in told.collect()), centres.tolist()


def as_floats(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


@pytest.mark.parametrize("kind", ["random", "grouped", "ties"])
def test_equals_brute_force(spark, kind):
    pick = random.Random(kind)
    far = [[pick.uniform(-9, 9) for _ in range(6)] for _ in range(5)]
    one = {
        "random": lambda: [pick.gauss(0, 1) for _ in range(6)],
        "grouped": lambda: [x + pick.gauss(0, 0.1) for x in pick.choice(far)],
        "ties": lambda: [pick.choice([0.0, 1 / 64]) for _ in range(6)],
    }[kind]
    rows = as_floats([(i, one()) for i in range(600)])
    want, centres = plain(rows, 7, 3, 6)
    assert got(spark, rows, 7, 3, 6) == (want, centres)


def test_odd_rows(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [-1.0, 0.5]), (None, [3.0, 3.0]), (None, [-3.0, 2.0]), (2, None), (3, []), (4, [1.0]), (5, [1.0, 2.0, 3.0])]
    rows += [(6, [NAN, 1.0]), (7, [1.0, INF]), (8, [-INF, 1.0]), (9, [None, 1.0]), (10, [-0.001, 1e4]), (11, [0.0, -0.0])]
    rows += [(20 + i, [5.0, 5.0]) for i in range(200)]  # one vector many times, as first centroids too
    want, centres = plain(rows, 4, 2, 2)
    assert got(spark, rows, 4, 2, 2, extra=True) == (want, centres)
    few = rows[:3]
    want, centres = plain(few, 16, 3, 2)
    assert len(centres) == 3 and got(spark, few, 16, 3, 2) == (want, centres)
    assert got(spark, rows[5:13], 16, 3, 2) == ([], [])
    with pytest.raises(Exception, match="after scaling"):
        got(spark, [(1, [3e6, 0.0])], 2, 1, 2)


def test_bounds_hold_and_spare_work(spark):
    rng = np.random.default_rng(5)
    middle = rng.integers(-4000, 4000, (16, 64))
    x = middle[rng.integers(0, 16, 4000)] + rng.integers(-60, 60, (4000, 64))
    for moved in (0, 40, 4000):
        pivots = centroids.Pivots.of(middle)
        centres = middle + rng.integers(-moved, moved + 1, middle.shape)
        bound = centroids.lower_bounds(centroids.distances(x, middle), centroids.distances(centres, middle), pivots)
        exact = ((x[:, None, :] - centres[None]) ** 2).sum(2)
        assert (bound * bound <= exact).all()
        cluster, distance, measured = centroids.nearest(x, centroids.distances(x, middle), centres, pivots)
        assert (cluster == exact.argmin(1)).all() and (distance == exact.min(1)).all()
        if moved < 4000:
            assert measured < len(x) * 1.5  # of 16 each


def test_query_equals_sql_on_odd_rows(spark, tmp_path):
    pick = random.Random(8)
    rows = [(i // 2, [pick.gauss(0, 0.2) for _ in range(64)], i) for i in range(60)]
    rows += [(None, [0.25] * 64, 1), (None, None, 2), (70, [0.1] * 63, 3), (71, [0.1] * 63 + [NAN], 4), (72, [0.1] * 63 + [None], 5), (73, [INF] * 64, 6)]
    rows += [(80 + i, [-0.01] * 64, 7) for i in range(40)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, x int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    rel, df = con.sql(centroids.OP13_SQL), centroids.op13_ptolemaic_pivots(spark, str(tmp_path))
    order = sorted(df.columns)
    assert sorted(rel.columns) == order
    want = sorted(tuple(norm(v, None) for v in (r[rel.columns.index(c)] for c in order)) for r in rel.fetchall())
    assert len(want) == 101 and sorted(tuple(norm(r[c], None) for c in order) for r in df.collect()) == want


def test_query_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want, centres = plain(rows, 16, 3, 64)
    df = centroids.op13_ptolemaic_pivots(spark, SF_SMALL).collect()
    assert sorted(((False, r["vec_id"]), r["cluster"], r["distance"]) for r in df) == want
    whole = sum(d for *_, d in want)
    for r in df:
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centres[r["cluster"]])).encode()).hexdigest()
        assert r["inertia"] == whole and r["cluster_inertia"] == sum(d for _, k, d in want if k == r["cluster"])
