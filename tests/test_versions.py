"""Published tables: a writer that stops anywhere leaves a whole table."""

from __future__ import annotations

import os
import tempfile
import uuid

import pytest

from funnelworks.plans import quality_suite
from funnelworks.plans.build import build_project
from funnelworks.plans.project import MARTS
from funnelworks.sources import versions
from funnelworks.sources.io import read_table, save_table, write_table
from funnelworks.sources.versions import Pending, Store


class Stop(BaseException):
    """As if the driver had died: no handler of the writer runs."""


@pytest.fixture
def out():
    return tempfile.mkdtemp(prefix="funnelworks-test-versions-")


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_failed_rebuild_keeps_the_old_table(spark, out):
    write_table(spark.range(10), f"{out}/t")
    bad = spark.range(10).selectExpr("CASE WHEN id = 7 THEN raise_error('lost') ELSE id END AS id")
    with pytest.raises(Exception, match="lost"):
        write_table(bad, f"{out}/t")
    assert ids(read_table(spark, f"{out}/t")) == list(range(10))
    assert os.listdir(out) == ["t"] and len(os.listdir(f"{out}/t")) == 2  # the commits and one version
    write_table(spark.range(3), f"{out}/t")
    assert ids(read_table(spark, f"{out}/t")) == [0, 1, 2]


@pytest.mark.parametrize("step", ["write", "commit", "clean"])
def test_stop_between_the_steps(spark, out, monkeypatch, step):
    """Half written; written but not committed; committed but not cleaned up."""
    write_table(spark.range(10), f"{out}/t")
    with monkeypatch.context() as patch:
        patch.setattr(Pending, "__exit__", lambda self, kind, *_: self.commit() if kind is None else None)  # dead: nothing is tidied
        if step == "write":

            def half(self, df, *_):
                df.limit(1).write.parquet(f"{self.path()}/_temporary/0")
                raise Stop

            patch.setattr(Pending, "write", half)
        elif step == "commit":
            patch.setattr(Store, "_create", lambda *_: (_ for _ in ()).throw(Stop))
        else:
            patch.setattr(Store, "clean", lambda *_: (_ for _ in ()).throw(Stop))
        with pytest.raises(Stop):
            write_table(spark.range(4), f"{out}/t")
    assert ids(read_table(spark, f"{out}/t")) == (list(range(4)) if step == "clean" else list(range(10)))
    write_table(spark.range(6), f"{out}/t")
    assert ids(read_table(spark, f"{out}/t")) == list(range(6))
    monkeypatch.setattr(versions, "ABANDONED_SECONDS", -60)
    write_table(spark.range(7), f"{out}/t")
    assert len(os.listdir(f"{out}/t")) == 3 and ids(read_table(spark, f"{out}/t")) == list(range(7))


def test_a_query_that_has_begun_ends_on_its_version(spark, out):
    write_table(spark.range(5), f"{out}/t")
    before = read_table(spark, f"{out}/t")
    write_table(spark.range(2).selectExpr("id", "'x' AS more"), f"{out}/t", partition_by=["more"])
    assert ids(before) == list(range(5))
    now = read_table(spark, f"{out}/t")
    assert ids(now) == [0, 1] and now.columns == ["id", "more"]
    write_table(spark.range(1), f"{out}/t")
    assert len(Store(spark, f"{out}/t").versions()) == 2


def test_two_writers_at_once(spark, out):
    store = Store(spark, out)
    one, two = store.begin(), store.begin()
    one.write(spark.range(1)), two.write(spark.range(2))
    one.commit(), two.commit()
    last = max(one, two, key=lambda p: p.version)
    assert store.current() == last.version and ids(read_table(spark, out)) == list(range(1 if last is one else 2))
    with store.begin() as three:
        three.write(spark.range(3))
    assert ids(read_table(spark, out)) == [0, 1, 2]


def test_files_of_others_and_no_table(spark, out):
    spark.range(4).write.parquet(f"{out}/plain")
    assert ids(read_table(spark, f"{out}/plain")) == list(range(4)) and Store(spark, f"{out}/none").current() is None
    write_table(spark.range(2), f"{out}/plain")  # from now on its versions count
    assert ids(read_table(spark, f"{out}/plain")) == [0, 1]


def test_marts_change_together(spark, models_small, out, monkeypatch):
    build_project(models_small, out, run_checks=False)
    first = {name: read_table(spark, f"{out}/{name}").count() for name in MARTS}
    later = models_small.with_overrides(int_lead_opportunity_joined=models_small.int_lead_opportunity_joined.where("channel = 'Inbound'"))
    write = Pending.write

    def dies(self, df, table="", *more):
        if table == "fct_unit_economics":
            raise RuntimeError("lost")
        return write(self, df, table, *more)

    with monkeypatch.context() as patch:
        patch.setattr(Pending, "write", dies)
        with pytest.raises(RuntimeError, match="lost"):
            build_project(later, out, run_checks=False)
    assert {name: read_table(spark, f"{out}/{name}").count() for name in MARTS} == first
    assert len(os.listdir(f"{out}/fct_lead_funnel")) == 1  # what was written is gone
    places = build_project(later, out, run_checks=False)
    now = {name: read_table(spark, f"{out}/{name}").count() for name in MARTS}
    assert now == {name: spark.read.parquet(path).count() for name, path in places.items()}
    assert all(now[name] < first[name] for name in ("fct_lead_funnel", "fct_unit_economics", "fct_activity_efficiency"))


def test_checks_run_before_anything_is_published(spark, models_small, out, monkeypatch):
    seen = []
    checks = quality_suite.run_checks
    monkeypatch.setattr(quality_suite, "run_checks", lambda *a, **k: seen.append(Store(spark, out).current()) or checks(*a, **k))
    build_project(models_small, out)
    assert seen == [None] and read_table(spark, f"{out}/data_quality_summary").count() == 40


def test_catalog_name_always_stands_for_a_whole_table(spark, monkeypatch):
    db = f"sink_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE DATABASE {db}")
    spark.range(3).write.saveAsTable(f"{db}.t")  # saved by something else
    for rows in (5, 6):
        save_table(spark.range(rows), f"{db}.t")
        assert ids(spark.table(f"{db}.t")) == list(range(rows))
    with monkeypatch.context() as patch:
        patch.setattr(versions.Pending, "abandon", lambda self: None)
        patch.setattr("funnelworks.sources.io.show_table", lambda *_: (_ for _ in ()).throw(Stop))
        with pytest.raises(Stop):
            save_table(spark.range(9), f"{db}.t")
    assert ids(spark.table(f"{db}.t")) == list(range(6))
    with monkeypatch.context() as patch:
        patch.setattr(versions.Pending, "commit", lambda *_: (_ for _ in ()).throw(Stop))
        with pytest.raises(Stop):
            save_table(spark.range(2).selectExpr("id", "id AS other"), f"{db}.t")  # other columns, and no clean-up
    assert ids(spark.table(f"{db}.t")) == [0, 1] and spark.table(f"{db}.t").columns == ["id", "other"]
    save_table(spark.range(1), f"{db}.t")
    assert ids(spark.table(f"{db}.t")) == [0] and [t.name for t in spark.catalog.listTables(db)].count("t") == 1
    spark.sql(f"DROP DATABASE {db} CASCADE")
