"""The match store: versions, failures between writing and committing, deletions."""

import pytest
from pyspark.sql import functions as F

from strandlake.operators.match_store import MatchStore


def rows(spark, data):
    return spark.createDataFrame(data, "sample_id string, day string, hmm_cost double").select("sample_id", F.col("day").cast("date").alias("match_date"), "hmm_cost")


def held(store, version=None):
    return sorted((r.sample_id, str(r.match_date)) for r in store.read(version).collect())


@pytest.mark.parametrize("period", ["month", "day"])
def test_versions(spark, tmp_path, period):
    store = MatchStore(spark, str(tmp_path / "store"), period)
    with pytest.raises(ValueError):
        store.read()
    store.initialise()
    with pytest.raises(ValueError):
        store.initialise()
    first = store.add(rows(spark, [("a", "2020-01-01", 0.0), ("a", "2020-01-01", 0.0), ("b", "2020-01-31", 1.0), ("c", "2020-02-01", 2.0)]))
    second = store.add(rows(spark, [("b", "2020-01-31", 1.0), ("d", "2020-02-02", 0.0)]))
    every = [("a", "2020-01-01"), ("b", "2020-01-31"), ("c", "2020-02-01"), ("d", "2020-02-02")]
    assert held(store) == every and held(store, first) == every[:3]
    store.delete_newer("2020-02-01")
    assert held(store) == every[:3]
    store.delete_newer("2019-12-31")
    assert held(store) == []
    store.rollback(second)
    assert held(store) == every
    store.replace_periods(rows(spark, [("x", "2020-02-01", 0.0)]))
    assert ("x", "2020-02-01") in held(store) and ("c", "2020-02-01") not in held(store) and ("a", "2020-01-01") in held(store)
    assert store.vacuum(keep=1) > 0 and len(held(store)) >= 3 and len(store.versions()) == 1
    with pytest.raises(ValueError, match="no version"):
        store.read(second)


def test_failure_between_write_and_commit(spark, tmp_path, monkeypatch):
    """A day that fails leaves the store as it was, and can be run again."""
    store = MatchStore(spark, str(tmp_path / "store"))
    store.add(rows(spark, [("a", "2020-01-01", 0.0)]))
    day = rows(spark, [("b", "2020-01-02", 0.0), ("c", "2020-02-02", 0.0)])
    with monkeypatch.context() as m:
        m.setattr(MatchStore, "_commit", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        for step in (lambda: store.add(day), lambda: store.replace_periods(day), lambda: store.delete_newer("2019-01-01")):
            with pytest.raises(OSError):
                step()
            assert held(store) == [("a", "2020-01-01")]
    store.add(day)
    assert len(held(store)) == 3
    with pytest.raises(ValueError, match="without a date"):
        store.add(rows(spark, [("z", None, 0.0)]))
    assert len(held(store)) == 3


def test_two_writers(spark, tmp_path):
    store = MatchStore(spark, str(tmp_path / "store"))
    store.add(rows(spark, [("a", "2020-01-01", 0.0)]))
    stale = store.manifest()
    store.add(rows(spark, [("b", "2020-01-02", 0.0)]))
    with pytest.raises(RuntimeError, match="somebody else"):
        store._commit(stale, periods={})
    assert held(store) == [("a", "2020-01-01"), ("b", "2020-01-02")]


def test_batches_of_a_stream_count_once(spark, tmp_path):
    store = MatchStore(spark, str(tmp_path / "store"))
    version = store.add(rows(spark, [("a", "2020-01-01", 0.0)]), stream="s", batch=0)
    assert store.add(rows(spark, [("q", "2020-01-01", 0.0)]), stream="s", batch=0) == version
    assert store.add(rows(spark, [("b", "2020-01-01", 0.0)]), stream="s", batch=1) == version + 1
    assert held(store) == [("a", "2020-01-01"), ("b", "2020-01-01")]
