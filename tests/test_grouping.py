"""The daily loop's state: restarts and the spread of rows over batches don't change it."""

import datetime
import random

import pytest

from strandlake.streaming import grouping

SCHEMA = "key string, match_time timestamp, exact boolean"


def brute(rows, window, least, least_days, last):
    """key, day and numbers of every closed day, from all rows at once."""
    out = []
    for key in {k for k, _, _ in rows if k}:
        days = {}
        for k, t, exact in rows:
            if k == key and t is not None:
                d = (t.date() - datetime.date(1970, 1, 1)).days
                e, i = days.get(d, (0, 0))
                days[d] = (e + bool(exact), i + (not exact))
        total, own = 0, set(days)
        for day in range(min(days), last + 1):
            if day in own or any(d + window == day for d in days if d < day):
                days, row = grouping.closed_day(days, day, total, window, least, least_days)
                total = row[1]
                out.append((key, datetime.date(1970, 1, 1) + datetime.timedelta(day), *row))
    return sorted(out)


def test_closed_day():
    days = {10: (0, 2), 12: (1, 1), 20: (3, 4)}
    assert grouping.closed_day(days, 12, 5, 7, 3, 2) == ({20: (3, 4)}, (1, 6, 0, 3, 0))  # three of two days
    assert grouping.closed_day(days, 12, 5, 7, 3, 3) == ({10: (0, 2), 12: (0, 1), 20: (3, 4)}, (1, 6, 3, 0, 0))
    assert grouping.closed_day({10: (0, 2), 12: (0, 1), 17: (2, 0)}, 17, 1, 7, 9, 1) == ({12: (0, 1)}, (2, 3, 1, 0, 2))


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, before)


def run(spark, source, sink, state, **kinds):
    stream = grouping.daily_groups(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", kinds.pop("files", 1)).parquet(source), **kinds)
    stream.writeStream.format("parquet").outputMode("append").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def test_restarts_and_batches_equal_all_at_once(rocks, tmp_path):
    spark, rng = rocks, random.Random(5)
    start = datetime.datetime(2020, 1, 1)
    rows = [(rng.choice(["a", "a", "a", "b", "c"]), start + datetime.timedelta(hours=rng.randint(0, 24 * 20)), rng.random() < 0.3) for _ in range(160)]
    rows.sort(key=lambda r: r[1] + datetime.timedelta(hours=rng.randint(0, 20)))  # somewhat out of order, within the watermark
    # What comes last only moves the watermark on; null keys and times are left out.
    end = [("z", start + datetime.timedelta(days=60), True), ("z", start + datetime.timedelta(days=61), True), (None, start, True), ("a", None, True)]
    kinds = {"late": "2 days", "window": 5, "least": 9, "least_days": 2}
    last = (datetime.date(2020, 1, 1) - datetime.date(1970, 1, 1)).days + 40
    want = [r for r in brute(rows, 5, 9, 2, last)]
    assert any(r[5] for r in want) and any(r[6] for r in want)
    for name, cuts, files in (("often", [40, 41, 90, 130, 160], 1), ("once", [160], 9)):
        source, sink, state = (str(tmp_path / name / x) for x in ("in", "out", "state"))
        at = 0
        for cut in cuts:
            spark.createDataFrame(rows[at:cut], SCHEMA).coalesce(1).write.mode("append").parquet(source)
            at = cut
            run(spark, source, sink, state, files=files, **kinds)  # stopped and started again after each
        spark.createDataFrame(end, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        run(spark, source, sink, state, files=files, **kinds)
        got = sorted(tuple(r) for r in spark.read.parquet(sink).collect() if r.key != "z")
        assert got == want


def test_rows_later_than_the_watermark_are_left_out(rocks, tmp_path):
    spark = rocks
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    day = lambda n: datetime.datetime(2020, 1, n)
    for rows in ([("a", day(1), True)], [("z", day(10), True)], [("a", day(2), True), ("z", day(11), True)], [("z", day(25), True), ("z", day(26), True)]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        run(spark, source, sink, state, late="1 days", window=5, least=9, least_days=2)
    got = sorted((str(r.day), r.exact, r.total_exact) for r in spark.read.parquet(sink).where("key = 'a'").collect())
    assert got == [("2020-01-01", 1, 1)]
