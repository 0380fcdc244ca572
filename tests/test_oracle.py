"""Differential test: every registered query against its DuckDB oracle (sf0.001)."""

from __future__ import annotations

import pytest

from funnelworks.plans.catalog import QUERIES
from oracle import ORACLE_SQL as ORACLE
from tests.conftest import SF_SMALL
from tools.compare import duck, norm, spark_type

# Floats are compared exactly (repr): every average is an exact sum and a
# single final division, so both engines produce the same doubles.
FLOAT_DIGITS: dict[str, int] = {}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    rel = con.sql(ORACLE[name])
    assert sorted(sdf.columns) == sorted(rel.columns)
    s_types = {f.name: spark_type(f.dataType) for f in sdf.schema.fields}
    d_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    assert s_types == d_types
    order = sorted(sdf.columns)
    digits = FLOAT_DIGITS.get(name)

    def canon(cols, data):
        idx = [cols.index(c) for c in order]
        return sorted(tuple(norm(r[i], digits) for i in idx) for r in data)

    s_rows = canon(sdf.columns, [tuple(r) for r in sdf.collect()])
    d_rows = canon(rel.columns, rel.fetchall())
    assert len(s_rows) == len(d_rows)
    assert s_rows == d_rows
