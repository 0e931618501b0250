"""Groups of samples of one match, against brute force."""

import datetime
import hashlib

from strandlake.operators import matching


def test_sample_groups_are_streamed(spark):
    day = lambda i: datetime.date(2021, 1, 1 + i)
    rows = [(f"S{i}", day(i % 3), float(i % 2), i % 4 if i % 5 else None) for i in range(100)] + [("S1", day(0), float("nan"), 9), ("S2", day(1), float("nan"), 9), (None, None, -0.0, 7), ("é", day(2), 0.0, 7), ("z", day(3), 0.0, 7), ("lone", day(0), 3.0, 1)]
    frame = spark.createDataFrame(rows, "sample_id string, match_date date, hmm_cost double, parent bigint")
    groups = {}
    for sample, date, cost, parent in rows:
        groups.setdefault((str(cost + 0.0), parent), []).append((sample, date))
    want = set()
    for (_, parent), own in groups.items():
        ids = sorted((s for s, _ in own if s is not None), key=lambda s: s.encode())
        dates = {d for _, d in own if d is not None}
        if len(own) >= 2 and len(dates) >= 2:
            want.add((hashlib.md5("".join(ids).encode()).hexdigest(), parent, len(own), len(dates)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = matching.sample_groups(frame, min_size=2, min_dates=2)
        assert {tuple(r)[:4] for r in found.collect()} == want
        assert "collect_list" not in found._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
