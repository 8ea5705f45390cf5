"""Queries of the streaming family: each runs a stream over the events table to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import windows
from ..sources import readers
from ..sources.shared import new_folder
from ..streaming import handoff
from .registry import query, table


SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def _events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _finished(spark, stream, mode: str):
    """What a stream has put out once its input is used up."""
    out, mark = new_folder(spark, "stream"), new_folder(spark, "stream")
    if mode == "append":
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    stream.writeStream.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/v{i}")).option("checkpointLocation", mark).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    versions = sorted(int(n.removeprefix("v")) for n in readers._names(spark, f"{out}/v*"))
    return spark.read.schema(stream.schema).parquet(*([f"{out}/v{versions[-1]}"] if mode == "complete" else [f"{out}/v{n}" for n in versions]))


def _source(spark, d):
    folder = new_folder(spark, "stream")
    _events(spark, d).repartition(3).write.parquet(folder)
    return spark.readStream.schema(SCHEMA).parquet(folder)


@query("r01_tumbling_counts", "select strftime(time_bucket(interval '1 hour', ts), '%Y-%m-%d %H:%M') as start, event_type, count(*) as n, round(sum(value), 4) as value_sum from events group by 1, 2")
def r01(spark, d):
    out = _finished(spark, handoff.windowed_counts(_source(spark, d), "ts", "1 hour", "365 days", ["event_type"]), "complete")
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("value_sum", 4).alias("value_sum"))


@query("r01_sliding_counts", "with w as (select unnest([time_bucket(interval '30 minutes', ts), time_bucket(interval '30 minutes', ts) - interval '30 minutes']) as start, value from events) select strftime(start, '%Y-%m-%d %H:%M') as start, count(*) as n, round(sum(value), 4) as value_sum from w group by 1")
def r01s(spark, d):
    out = _finished(spark, handoff.windowed_counts(_source(spark, d), "ts", "1 hour", "365 days", (), "30 minutes"), "complete")
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "n", F.round("value_sum", 4).alias("value_sum"))


@query("r02_session_counts", "with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end as fresh from events), s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows between unbounded preceding and current row) as k from g) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from s group by user_id, k")
def r02(spark, d):
    out = _finished(spark, handoff.session_counts(_source(spark, d), "ts", "30 minutes", "365 days", "user_id"), "complete")
    return out.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


# windows that the watermark has passed are put out and leave the state; those still open are not
@query("r01_closed_windows", "with w as (select time_bucket(interval '1 hour', ts) as start, event_type, value from events) select strftime(start, '%Y-%m-%d %H:%M') as start, event_type, count(*) as n, round(sum(value), 4) as value_sum from w where start + interval '1 hour' <= (select max(ts) from events) - interval '3 hours' group by 1, 2")
def r01c(spark, d):
    out = _finished(spark, handoff.windowed_counts(_source(spark, d), "ts", "1 hour", "3 hours", ["event_type"]), "append")
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("value_sum", 4).alias("value_sum"))


SIZE = 250  # rows of a batch; the last one is short and waits
FULL = f"(select count(*) // {SIZE} * {SIZE} from events)"
BATCHED = "with r as (select event_id, user_id, value, user_id % 3 != 0 as ok, row_number() over (order by event_id) - 1 as k from events) "


def _batches(spark, d) -> str:
    """All events as batch files of ``SIZE`` rows in the order of their ids, written by many tasks into one folder; the last one lacks rows."""
    folder = new_folder(spark, "batches")
    rows = table(spark, d, "events").select("event_id", "user_id", "value", F.when(F.col("user_id") % 3 != 0, "pass").otherwise("fail").alias("quality_pass"))
    first = F.floor((F.col("_k") - 1) / SIZE) * SIZE
    named = windows.numbered(rows, "event_id", "_k").withColumn("part", F.format_string("batch_%09d_%09d", first, first + SIZE)).drop("_k")

    def write(rows):
        return _batch_file(folder, rows)

    # a batch is one file, as it would arrive
    named.groupBy("part").applyInArrow(write, "path string, n_rows long").agg(F.sum("n_rows")).collect()
    return folder


def _batch_file(folder: str, rows):
    """The file of one batch. It gets its name when it is whole; a task that runs again replaces it by the same rows."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, where = fs.FileSystem.from_uri(folder)
    name = f"{rows['part'][0]}.parquet"
    store.create_dir(where, recursive=True)
    hidden = f"{where}/.{uuid.uuid4().hex}-{name}"
    pq.write_table(rows.drop_columns(["part"]).sort_by("event_id"), hidden, filesystem=store)
    store.move(hidden, f"{where}/{name}")
    return pa.table({"path": [f"{folder}/{name}"], "n_rows": pa.array([rows.num_rows], pa.int64())})


def _consumed(spark, d) -> str:
    source, target, mark = _batches(spark, d), new_folder(spark, "target"), new_folder(spark, "mark")
    schema = "event_id long, user_id long, value double, quality_pass string"
    handoff.consume(spark, source, schema, target, mark, "event_id", ["quality_pass"], max_files=40).awaitTermination()
    return target


@query("r04_handoff_rows", BATCHED + f"select event_id, user_id, value from r where ok and k < {FULL}")
def r04(spark, d):
    return readers.read_table(spark, f"{_consumed(spark, d)}/rows").select("event_id", "user_id", "value")


@query("r05_handoff_progress", f"select {FULL} // {SIZE} as n_batches, {FULL} as n_rows, {FULL} as covered_to, count(*) % {SIZE} = 0 as finished from events")
def r05(spark, d):
    return handoff.progress(handoff.ledger(spark, _consumed(spark, d)), table(spark, d, "events").count())


STOPPED = f"with n as (select count(*) // {SIZE} as n from events) "


@query("r06_stopped_and_resumed", STOPPED + f"select run, cast(case run when 1 then least(n, 2) else n end as bigint) as n_batches, cast(case run when 1 then least(n, 2) else n end * {SIZE} as bigint) as n_rows from n, (select unnest([1, 2]) as run)")
def r06(spark, d):
    source, target = _batches(spark, d), new_folder(spark, "target")
    schema = "event_id long, user_id long, value double, quality_pass string"
    out = None
    # a first run stops after two new batches, a later one takes the rest
    for run, most in ((1, 2), (2, None)):
        handoff.consume_listed(spark, source, schema, target, "event_id", ["quality_pass"], most)
        done = handoff.ledger(spark, target).filter("complete").agg(F.count("*").alias("n_batches"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"))
        row = spark.createDataFrame([(run, *done.first())], "run int, n_batches long, n_rows long")
        out = row if out is None else out.unionByName(row)
    return out


@query("r07_restart_tokens", "with l as (select source, cast(n_chars % 3 as bigint) as bytes, doc_id as i from documents), s as (select distinct source, 1::bigint as bytes from documents) select s.source, coalesce(max(l.i) + 1, 0) as next_index from s left join l using (source, bytes) group by 1")
def r07(spark, d):
    ledger = table(spark, d, "documents").select("source", (F.col("n_chars") % 3).alias("bytes"), F.lit(0).alias("mtime"), F.col("doc_id").alias("member_index"))
    sources = ledger.select("source").distinct().withColumns({"bytes": F.lit(1).cast("long"), "mtime": F.lit(0)})
    return handoff.restart_tokens(sources, ledger)


@query("r08_dedupe_stream", "select distinct event_type, user_id from events")
def r08(spark, d):
    stream = handoff.deduplicated_stream(_source(spark, d), ["event_type", "user_id"], "ts", "3650 days")
    return _finished(spark, stream.select("event_type", "user_id"), "append")


# rows that fail the gate or have no flag never enter the state of the deduplication; a watermark of a day bounds it
@query("r08_gated_dedupe_stream", "select distinct event_type, user_id from events where event_id % 4 not in (0, 1)")
def r08g(spark, d):
    k = F.col("event_id") % 4
    flagged = _source(spark, d).withColumn("quality_pass", F.when(k == 0, "fail").when(k == 2, "pass").when(k == 3, "1"))
    stream = handoff.deduplicated_stream(handoff.gated_stream(flagged, ["quality_pass"]), ["event_type", "user_id"], "ts", "1 day")
    return _finished(spark, stream.select("event_type", "user_id"), "append")


@query("r05_batch_arrivals", f"with n as (select count(*) as n from events), b as (select i * {SIZE} as start, least({SIZE}, n - i * {SIZE}) as rows from n, range(0, (select count(*) from events)) r(i) where i * {SIZE} < n) select printf('batch_%09d_%09d', start, start + {SIZE}) as batch, 'complete' as event, rows as n_rows, {SIZE}::bigint as expected from b where rows = {SIZE}")
def r05a(spark, d):
    rows = handoff.batch_stream(spark, _batches(spark, d), "event_id long, user_id long, value double, quality_pass string")
    out, mark, seen = new_folder(spark, "stream"), new_folder(spark, "mark"), handoff.arrivals(rows, "event_id", 3_600_000)
    # its timers never rest, so the stream would not end by itself
    seen.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(once=True).start().awaitTermination()
    return spark.read.schema(seen.schema).parquet(out).filter("event = 'complete'").select("batch", "event", "n_rows", "expected")


@query("r05_run_state", f"select {FULL} // {SIZE} as n_batches, {FULL} as n_rows, {FULL} as covered_to, 'finished' as status")
def r05s(spark, d):
    expected = table(spark, d, "events").count() // SIZE * SIZE
    source, target, mark = _batches(spark, d), new_folder(spark, "target"), new_folder(spark, "mark")
    handoff.consume(spark, source, "event_id long, user_id long, value double, quality_pass string", target, mark, "event_id", ["quality_pass"], max_files=40, expected=expected).awaitTermination()
    return handoff.run_state(spark, target, "1 hour").select("n_batches", "n_rows", "covered_to", "status")


@query("r09_rollup_stream", "select event_type, round(sum(value) / count(value), 6) as mean, count(value) as n from events group by 1")
def r09(spark, d):
    target, mark = new_folder(spark, "stream"), new_folder(spark, "stream")
    handoff.rollup_stream(spark, _source(spark, d), ["event_type"], "value", target, mark).awaitTermination()
    return handoff.rollup_result(spark, target, ["event_type"]).select("event_type", F.round("mean", 6).alias("mean"), "n")
