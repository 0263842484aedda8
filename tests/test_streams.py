"""Streams with state: ingest by content, and the live status of runs."""

import datetime as dt
import time

from pyspark.sql import functions as F

from corpusdeck.streaming import ingest as I
from corpusdeck.streaming import status as N

DOC = "doc_id long, text string, extra string"


def test_contents_are_taken_once_over_restarts(spark, tmp_path):
    source, target, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    batches = [[(3, "a", "x"), (1, "a", "y"), (2, "b", None)], [(4, "b", None), (0, "a", None), (5, "c", None), (6, None, None), (7, "", None)], [], [(None, "d", None), (8, "d", None)]]
    want = {1, 2, 5, 6, 8}
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, DOC).coalesce(1).write.mode("append").parquet(source)
        I.ingest_stream(spark, source, DOC, target, log).awaitTermination()
        if i == 0:
            assert sorted(r.doc_id for r in spark.read.parquet(target).collect()) == [1, 2]
    got = spark.read.parquet(target)
    assert {r.doc_id for r in got.collect()} == want and got.count() == len(want)
    assert got.columns == ["doc_id", "text", "extra", "content_key"] and got.where("doc_id = 1").first().extra == "y"
    batch = I.first_by_content(spark.read.schema(DOC).parquet(source).where("doc_id is not null"))
    assert {r.content_key for r in batch.collect()} == {r.content_key for r in got.collect()}


def test_a_batch_looks_up_its_own_keys_only(spark, tmp_path):
    """The second batch reads no more rows than it brings, though the corpus has a thousand."""
    source, target, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    for batch in ([(i, f"text {i}", None) for i in range(1000)], [(2000, "text 5", None), (2001, "new", None)]):
        spark.createDataFrame(batch, DOC).coalesce(1).write.mode("append").parquet(source)
        query = I.ingest_stream(spark, source, DOC, target, log)
        query.awaitTermination()
    last = [p for p in query.recentProgress if p["numInputRows"]][-1]
    state = last["stateOperators"][0]
    assert last["numInputRows"] == 2 and state["numRowsUpdated"] == 1 and state["numRowsTotal"] == 1001
    assert spark.read.parquet(target).count() == 1001


def test_ten_times_the_contents_take_less_than_three_times_as_long(spark, tmp_path):
    """No work in Python per content: 2.8 and 18.2 s when each content was a group of its own, 1.5 and 1.7 s since."""
    seconds = []
    for n in (100, 4000, 40000):  # the first only starts the workers
        source, target, log = (str(tmp_path / f"{x}{n}") for x in ("in", "out", "log"))
        rows = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit(f"text {n} "), F.col("id")).alias("text"), F.lit(None).cast("string").alias("extra"))
        rows.write.parquet(source)
        begin = time.monotonic()
        I.ingest_stream(spark, source, DOC, target, log).awaitTermination()
        seconds.append(time.monotonic() - begin)
        assert spark.read.parquet(target).count() == n
    assert seconds[2] < 3 * seconds[1]


def test_smallest_ids_over_arrow_batches_of_a_bucket(spark, tmp_path, monkeypatch):
    """Few buckets of many small Arrow batches, contents that repeat within and between batches of the stream, null ids and texts."""
    monkeypatch.setattr(I, "BUCKET_DIGITS", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        source, target, log = (str(tmp_path / x) for x in ("in", "out", "log"))
        want = {}
        for batch in range(2):
            rows = [(None if i % 7 == 0 else (i * 611) % 1009 + 2000 * batch, None if i % 40 == 0 else f"text {i % 40 + 20 * batch}", f"{batch} {i}") for i in range(400)]
            spark.createDataFrame(rows, DOC).repartition(3).write.mode("append").parquet(source)
            I.ingest_stream(spark, source, DOC, target, log).awaitTermination()
            first = {}
            for id, text, extra in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
                first.setdefault(text or "", (id, text, extra))
            want = first | want
        got = spark.read.parquet(target).drop("content_key")
        assert sorted(tuple(r) for r in got.where("text is not null").collect()) == sorted(r for r in want.values() if r[1] is not None)
        assert [tuple(r) for r in got.where("text is null").collect()] == [want[""]]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


EVENT = "run long, owner string, stage string, ts timestamp, event_id long, seconds double"
STAGES = ["load", "split", "score"]


def at(minute, day=1):
    return dt.datetime(2024, 1, day, 0, 0) + dt.timedelta(minutes=minute)


def follow(spark, tmp_path, batches, **k):
    source, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    for batch in batches:
        spark.createDataFrame(batch, EVENT).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(EVENT).parquet(source)
        N.write_status(N.live_status(stream, STAGES, **k), out, log).awaitTermination()
    return spark.read.parquet(out).drop("batch")


def test_out_of_order_and_tied_events(spark, tmp_path):
    batches = [
        [(1, "ann", "load", at(1), 1, 2.0), (2, None, "split", at(50), 9, 1.0), (1, "ann", "split", at(9), 2, 3.0)],
        [(1, "ann", "score", at(5), 3, 1.0), (2, "", "other", at(50), 8, None), (3, "bob", "load", at(40), 4, 1.0), (None, "x", "load", at(41), 5, 1.0)],  # older than what run 1 has seen; a tie with a smaller id
        [(3, "bob", "split", at(40), 4, 1.0), (3, "bob", "split", at(40), 4, 1.0), (2, None, "score", at(50), 10, 0.5)],  # a tie of ids, twice; a tie with a larger id
    ]
    updates = follow(spark, tmp_path, batches)
    got = {x.run: tuple(x) for x in N.latest(updates).collect()}
    table = spark.createDataFrame([x for b in batches for x in b], EVENT)
    assert got == {x.run: tuple(x) for x in N.run_status(table, STAGES).collect()}
    assert got[1][1:6] == ("ann", "split", at(9), 2, 3) and got[1][7] == 1.0
    assert got[2][1:5] == ("anonymous", "score", at(50), 10) and got[3][2] == "split" and got[3][5] == 3
    assert [x.run for x in N.latest(updates, "bob").collect()] == [3] and [x.run for x in N.run_status(table, STAGES, "bob").collect()] == [3]


def test_late_events_and_idle_runs(spark, tmp_path):
    batches = [
        [(1, "a", "load", at(0), 1, 1.0)],
        [(2, "b", "load", at(0, 5), 2, 1.0)],  # four days on: run 1 is idle
        [(1, "a", "split", at(10), 3, 1.0), (2, "b", "split", at(-30, 5), 4, 1.0)],  # beyond the watermark; within it
        [(1, "a", "score", at(0, 6), 5, 1.0)],  # run 1 again, from nothing
    ]
    updates = follow(spark, tmp_path, batches, late="1 hour", idle="1 day")
    got = sorted((x.run, x.stage, x.n_events) for x in updates.collect())
    assert got == [(1, "load", 1), (1, "score", 1), (2, "load", 1), (2, "load", 2)]


def test_an_empty_table_of_events(spark):
    assert N.run_status(spark.createDataFrame([], EVENT), STAGES).count() == 0
