"""Repeats come where the schedule puts their demand."""

from pyspark.sql import functions as F

from strandlake.llm import mixing, queries


def test_repeats_follow_the_schedule(spark):
    rows = [(i, f"s{i % 2}", "w " * (1 + i % 3)) for i in range(240)]
    frame = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    settings = {"weights": (1,), "slopes": (0.0,)}
    placed = {r.doc_id: r for r in mixing._placed(frame, **settings).collect()}
    want = []
    for i, r in placed.items():
        for copy in range(-(-r.taken // r["size"])):
            want.append((min(1.0, r["__mix_share"] + copy * r.source_size / r.target), i))
    got = [r.doc_id for r in mixing.training_order(frame, **settings).collect()]
    assert got == [i for _, i in sorted(want)]
    # A source taken 1.5 times begins its second pass at two thirds.
    second = [k / len(got) for k, i in enumerate(got) if i in got[:k]]
    assert 0.6 < min(second) < 0.72 and len(got) > len(rows)


def test_schedule_has_all_uses_in_order(spark):
    rows = [(i, ("a", "b", None)[i % 3], "w " * (i % 6)) for i in range(200)] + [(7, "b", "w w w"), (7, "b", "w w w"), (8, None, None), (None, "a", "x y"), (None, "a", "x y"), (None, "b", "x y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumn("Time", F.lit("clash"))
    uses = mixing.schedule(docs).collect()
    times = [r.time for r in uses if r.copy is not None]
    assert times == sorted(times) and all(r.time is None and r.words == 0 for r in uses if r.copy is None)
    assert max(r.copy or 0 for r in uses) == 1 and all(0 < r.words <= r.size for r in uses if r.copy is not None)
    got, want = mixing.rows_of(mixing.schedule(docs)), mixing.mix(docs)
    names = ["doc_id", "source", "size", "source_size", "target", "taken", "position"]
    key = lambda r: str([v if not isinstance(v, float) else round(v, 9) for v in r])
    assert sorted(map(key, got.collect())) == sorted(map(key, want.select(*names).collect())) and got.columns == names
    assert mixing.rows_of(mixing.schedule(docs.where("false"))).count() == 0


def test_op9_comes_from_the_schedule(spark, monkeypatch):
    """Without the second uses the query takes fewer words, so its rows are those of the range-sorted uses."""
    path = "/root/testdata/sf0.001"
    taken = lambda: {r.doc_id: (r["size"], r.taken) for r in queries.op9_mixing_sources(spark, path).collect()}
    whole, keep = taken(), mixing.schedule
    monkeypatch.setattr(mixing, "schedule", lambda docs: keep(docs).where("coalesce(copy, 0) = 0"))
    assert {d: (n, min(n, t)) for d, (n, t) in whole.items()} == taken() != whole
