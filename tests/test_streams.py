"""Streams with late, missing, surplus and badly flagged batches."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.sources import readers
from tessera.streaming import handoff

SCHEMA = "id long, quality_pass string, at timestamp"


def put(spark, path, name, ids, flag="pass"):
    """A batch file, as a producer leaves it."""
    spark.createDataFrame([(i, flag, None) for i in ids], SCHEMA).coalesce(1).write.parquet(f"{path}/{name}/{time.time_ns()}")


def batch(a, b):
    return f"batch_{a:09d}_{b:09d}"


def test_arrivals_with_late_missing_and_surplus_batches(spark, tmp_path):
    source, out = f"file://{tmp_path}/source", f"file://{tmp_path}/out"
    put(spark, source, batch(0, 4), [0, 1, 2, 3])
    put(spark, source, batch(4, 8), [4, 5])  # the rest comes late
    put(spark, source, batch(8, 12), [8, None, 8, 9])  # two rows never come
    put(spark, source, batch(12, 14), [12, 13, 14])  # one too many
    put(spark, source, "nothing", [1])
    rows = handoff.batch_stream(spark, source, SCHEMA)
    seen = []
    arrived = handoff.arrivals(rows, "id", stale_ms=4000, alarms=2)
    query = arrived.writeStream.foreachBatch(lambda df, i: seen.extend((i, *r) for r in df.collect())).option("checkpointLocation", f"{out}/mark").trigger(processingTime="500 milliseconds").start()
    try:
        def wait(done, seconds=90):
            end = time.time() + seconds
            while not done() and time.time() < end and query.isActive:
                time.sleep(0.3)
            assert done(), (seen, query.exception())

        wait(lambda: len([s for s in seen if s[2] in ("complete", "surplus", "unnamed")]) >= 4)
        put(spark, source, batch(4, 8), [5, 6, 7])  # late, one row again
        put(spark, source, batch(0, 4), [0, 1])  # a replay
        wait(lambda: (batch(4, 8), "complete") in [s[1:3] for s in seen])
        wait(lambda: len([s for s in seen if s[1:3] == (batch(8, 12), "stale")]) == 2)
        # nothing waits any more: states go with the timers
        wait(lambda: sum(p["numRowsTotal"] for p in query.lastProgress["stateOperators"]) == 0)
    finally:
        query.stop()
    events = [s[1:] for s in seen]
    assert sorted(e for e in events if e[1] == "complete") == [(batch(0, 4), "complete", 4, 4, 0), (batch(4, 8), "complete", 4, 4, events[[x[:2] for x in events].index((batch(4, 8), "complete"))][4]), (batch(12, 14), "complete", 2, 2, 0)]
    assert [e for e in events if e[:2] == (batch(8, 12), "stale")] == [(batch(8, 12), "stale", 2, 4, 1), (batch(8, 12), "stale", 2, 4, 2)]
    assert (batch(12, 14), "surplus", 3, 2, 0) in events
    assert [e[:2] for e in events if e[1] == "unnamed"] == [("", "unnamed")]


def test_heartbeats_and_state_of_the_run(spark, tmp_path):
    source, target = f"file://{tmp_path}/source", f"file://{tmp_path}/target"
    put(spark, source, batch(0, 2), [0, 1])
    put(spark, source, batch(4, 6), [4, 5])
    run = lambda: handoff.consume(spark, source, SCHEMA, target, f"file://{tmp_path}/mark", "id", ["quality_pass"], expected=6).awaitTermination()
    run()
    first = handoff.run_state(spark, target, "1 hour").first()
    assert (first.n_batches, first.n_rows, first.covered_to, first.finished, first.status) == (2, 4, 2, False, "running")
    assert handoff.run_state(spark, target, "0 seconds").first().status == "stale"
    put(spark, source, batch(2, 4), [2, 3])
    run()
    last = handoff.run_state(spark, target, "0 seconds").first()
    assert (last.number, last.n_batches, last.covered_to, last.status) == (1, 3, 6, "finished")


def settled(spark, tmp_path, step):
    """Jobs that ``step`` took in the fourth of four micro-batches, in a session set as a stream sets its own."""
    target = f"file://{tmp_path}/target"
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for number in range(4):
            path = f"file://{tmp_path}/in{number}"
            put(spark, path, batch(2 * number, 2 * number + 2), [2 * number, 2 * number + 1])
            rows = spark.read.schema(SCHEMA).parquet(f"{path}/*/*").withColumn("batch", F.lit(batch(2 * number, 2 * number + 2)))
            spark.sparkContext.setJobGroup(f"settle-{tmp_path}-{number}", "")
            handoff._settle(spark, rows, number, target, "id", ["quality_pass"], None)
            spark.sparkContext.setJobGroup(f"other-{tmp_path}-{number}", "")
            step(target, number)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    jobs = lambda what: len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"{what}-{tmp_path}-3"))
    found = jobs("settle"), jobs("other")
    spark.sparkContext.setJobGroup("rest", "")
    return target, *found


def test_micro_batch_takes_few_jobs(spark, tmp_path):
    target, jobs, _ = settled(spark, tmp_path, lambda target, number: None)
    assert jobs <= 3  # its rows, its ledger, whether anything waits
    assert sorted(r.id for r in readers.read_table(spark, f"{target}/rows").collect()) == list(range(8))
    assert handoff.waiting_versions(spark, target) == []


def test_heartbeat_is_one_job(spark, tmp_path):
    target, _, jobs = settled(spark, tmp_path, lambda target, number: handoff.beat(spark, target, number, 8))
    assert jobs == 1
    last = handoff.run_state(spark, target, "1 hour").first()
    assert (last.number, last.n_batches, last.n_rows, last.covered_to, last.status) == (3, 4, 8, 8, "finished")


def test_progress_is_one_job_and_the_same_as_by_joins(spark, tmp_path):
    cases = [[], [(0, 4)], [(2, 4)], [(0, 4), (4, 6), (6, 9)], [(0, 4), (0, 6)], [(4, 6), (0, 4), (4, 8), (8, 9)], [(0, 9), (3, 5), (5, 7)], [(0, 4), (6, 8), (8, 9)], [(0, 2), (2, 9), (4, 6)]]
    rows = [[(batch(a, b), a, b, b - a, True, 0) for a, b in case] + [(batch(50, 60), 50, 60, 3, False, 0)] for case in cases]
    status = spark.sparkContext.statusTracker()
    for k, case in enumerate(rows):
        made = spark.createDataFrame(case, handoff.LEDGER)  # of unknown size: by joins
        made.coalesce(1).write.parquet(f"file://{tmp_path}/{k}")
        spark.sparkContext.setJobGroup(f"progress-{tmp_path}-{k}", "")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            got = handoff.progress(spark.read.schema(handoff.LEDGER).parquet(f"file://{tmp_path}/{k}"), 9).first()
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
            spark.sparkContext.setJobGroup("rest", "")
        assert got == handoff.progress(made, 9).first(), cases[k]
        assert len(status.getJobIdsForGroup(f"progress-{tmp_path}-{k}")) == 1


def test_merged_parts_may_differ_in_types(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "MAX_PARTS", 3)
    path = f"file://{tmp_path}/t"
    parts = [spark.createDataFrame([(1, 1)], "id int, v int"), spark.createDataFrame([(2, 2**40)], "id int, v long"), spark.createDataFrame([(1, 3, "x")], "id int, v int, w string"), spark.createDataFrame([(3, 4)], "id int, v int")]
    for part in parts:
        readers.upsert(spark, path, part, ["id"])
    assert sorted(tuple(r) for r in readers.read_table(spark, path).select("id", "v", "w").collect()) == [(1, 3, "x"), (2, 2**40, None), (3, 4, None)]


def test_unknown_flag_stops_the_stream_and_failed_rows_leave_no_state(spark, tmp_path):
    source = f"file://{tmp_path}/source"
    moment = F.timestamp_seconds(F.col("id") + 1_700_000_000)
    spark.range(40).select("id", F.when(F.col("id") % 4 == 0, "fail").when(F.col("id") % 4 == 1, None).otherwise("PASS ").alias("quality_pass"), moment.alias("at")).coalesce(1).write.parquet(source)
    stream = handoff.deduplicated_stream(handoff.gated_stream(spark.readStream.schema(SCHEMA).parquet(source), ["quality_pass"]), ["id"], "at", "10 seconds")
    seen, rows = [], []
    query = stream.writeStream.foreachBatch(lambda df, i: seen.extend(r.id for r in df.collect())).option("checkpointLocation", f"file://{tmp_path}/mark").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(seen) == [i for i in range(40) if i % 4 > 1]
    states = [s for p in query.recentProgress for s in p["stateOperators"]]
    rows = [s["numRowsTotal"] for s in states]
    assert max(rows) == 20 and rows[-1] < 12  # passed rows alone, and the watermark has taken old ones out
    spark.createDataFrame([(99, "maybe", None)], SCHEMA).withColumn("at", moment).write.mode("append").parquet(source)
    query = stream.writeStream.foreachBatch(lambda df, i: df.collect()).option("checkpointLocation", f"file://{tmp_path}/mark").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="maybe"):
        query.awaitTermination()


def test_listed_run_reads_only_the_batches_it_takes(spark, tmp_path):
    source, target = f"file://{tmp_path}/source", f"file://{tmp_path}/target"
    put(spark, source, batch(0, 2), [])  # no rows, no batch
    put(spark, source, batch(2, 4), [2, 3])
    put(spark, source, batch(4, 6), [4])
    put(spark, source, batch(4, 6), [5])  # a batch of two files
    put(spark, source, batch(6, 8), [6, 7])
    bad = tmp_path / "source" / batch(8, 10)
    bad.mkdir()
    (bad / "part.parquet").write_text("still being written")
    run = lambda most: handoff.consume_listed(spark, source, SCHEMA, target, "id", ["quality_pass"], most)
    complete = lambda: sorted((r.batch, r.n_rows) for r in handoff.ledger(spark, target).filter("complete").collect())
    run(2)
    assert complete() == [(batch(2, 4), 2), (batch(4, 6), 2)]
    run(1)
    assert complete()[2:] == [(batch(6, 8), 2)]
    (bad / "part.parquet").unlink()
    run(3)
    run(None)
    assert len(complete()) == 3
    put(spark, source, batch(8, 10), [8, 9])
    run(None)
    assert complete()[3:] == [(batch(8, 10), 2)]


def test_batch_files_are_one_for_each_batch(spark, sf_dir, monkeypatch):
    from tessera.plans import streams

    monkeypatch.setattr(streams, "SIZE", 30)
    folder = streams._batches(spark, sf_dir)
    names = sorted(p.name for p in Path(folder.removeprefix("file://")).iterdir() if not p.name.startswith("."))
    ids = sorted(r.event_id for r in spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id").collect())
    assert names == [f"{batch(i, i + 30)}.parquet" for i in range(0, len(ids), 30)]
    found = {}
    for r in spark.read.parquet(folder).withColumn("file", F.regexp_extract(F.input_file_name(), "batch_[0-9]+_[0-9]+", 0)).collect():
        found.setdefault(r.file, []).append(r.event_id)
    assert {n: sorted(v) for n, v in found.items()} == {batch(i, i + 30): ids[i : i + 30] for i in range(0, len(ids), 30)}
