"""Live handoff of batches: a file stream that emits each complete batch once, gated, into an idempotent table."""

from __future__ import annotations

import json
import re

from collections.abc import Callable, Sequence
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.clean import closed_flag
from ..operators.checks import signature
from ..operators.windows import contiguous
from ..sources.readers import _delete, _names, _number, _write, read_table, tasks_for, upsert

BATCH_NAME = r"batch_(\d{9})_(\d{9})"
LEDGER = "batch string, start long, stop long, n_rows long, complete boolean, batch_id int"


def batch_interval(name: Column) -> tuple[Column, Column]:
    """(start, stop) that a batch name encodes; null if it encodes none."""
    part = lambda i: F.nullif(F.regexp_extract(name, BATCH_NAME, i), F.lit("")).cast("long")
    return part(1), part(2)


def complete_batches(rows: DataFrame, key: str, required: Sequence[str]) -> DataFrame:
    """(batch, start, stop, n_rows, complete): as many rows as the name says, keys known and unique, required columns there."""
    start, stop = batch_interval(F.col("batch"))
    out = rows.groupBy("batch").agg(F.count("*").alias("n_rows"), F.count(key).alias("n_keys"), F.count_distinct(key).alias("n_distinct"))
    fine = F.lit(all(c in rows.columns for c in required))
    out = out.withColumns({"start": start, "stop": stop})
    ok = fine & (F.col("n_rows") == F.col("stop") - F.col("start")) & (F.col("n_keys") == F.col("n_rows")) & (F.col("n_distinct") == F.col("n_rows"))
    return out.withColumn("complete", F.coalesce(ok, F.lit(False))).select("batch", "start", "stop", "n_rows", "complete")


def gate(rows: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Rows that pass every quality flag; an unknown word is an error."""
    return rows.filter(_passed(flags))


def _passed(flags: Sequence[str]) -> Column:
    passed = F.lit(True)
    for f in flags:
        passed = passed & closed_flag(F.col(f))
    return passed


def batch_stream(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    """Rows of the batch files under ``path`` with their batch name; a file is read once per checkpoint."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path).withColumn("batch", F.regexp_extract(F.input_file_name(), f"({BATCH_NAME})", 1))


def consume(
    spark: SparkSession,
    source: str,
    schema: str,
    target: str,
    checkpoint: str,
    key: str,
    flags: Sequence[str] = (),
    process: Callable[[DataFrame], DataFrame] | None = None,
    max_files: int | None = None,
    available_now: bool = True,
    expected: int | None = None,
) -> StreamingQuery:
    """Starts the consumer: gated rows go to ``target``/rows, the ledger to ``target``/ledger, rows of incomplete batches wait in
    ``target``/pending and are tried again with the next files. Rows and ledger are parts of the micro-batch, which is all that it writes besides the
    rows that still wait; a repeated micro-batch replaces its parts. Each micro-batch leaves a heartbeat in ``target``/heartbeats; coverage of ``expected`` rows
    is what finishes the run.
    """

    passed = _passed(flags)  # long lists of words, made once

    def each(df: DataFrame, batch_id: int) -> None:
        _settle(spark, df, batch_id, target, key, flags, process, passed)
        beat(df.sparkSession, target, batch_id, expected)

    stream = batch_stream(spark, source, schema, max_files).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if available_now else stream.trigger(processingTime="30 seconds")).start()


def _settle(spark: SparkSession, df: DataFrame, number: int, target: str, key: str, flags: Sequence[str], process: Callable[[DataFrame], DataFrame] | None, passed: Column | None = None) -> None:
    """One micro-batch: complete batches, with what waited, are gated and written; the others wait under the micro-batch's number."""
    before = [n for n in waiting_versions(spark, target) if n < number]
    waiting = spark.read.schema(df.schema).parquet(f"{target}/pending={before[-1]:09d}") if before else None
    rows = df if waiting is None else df.unionByName(waiting)
    # one exchange: what follows stays in each batch, and a micro-batch of a stream is not cut to its size by itself
    parts = tasks_for(rows)
    parts = parts if parts == 1 else min(parts, rows.rdd.getNumPartitions())
    own = Window.partitionBy("batch")
    start, stop = batch_interval(F.col("batch"))
    rows = rows.repartition(parts, "batch").dropDuplicates(["batch", key])
    # keys are unique in a batch now, so known ones are distinct
    n, known = F.count("*").over(own), F.count(key).over(own)
    fine = F.lit(all(c in df.columns for c in [key, *flags])) & (n == stop - start) & (known == n)
    rows = rows.withColumns({"_n": n, "_complete": F.coalesce(fine, F.lit(False))}).persist()
    marks = ["_n", "_complete"]
    try:
        out = rows.filter("_complete").drop(*marks).filter(_passed(flags) if passed is None else passed)
        upsert(spark, f"{target}/rows", out if process is None else process(out), ["batch", key], part=number, unique=process is None)
        state = rows.groupBy("batch").agg(F.first("_n").alias("n_rows"), F.first("_complete").alias("complete"))
        state = state.select("batch", start.alias("start"), stop.alias("stop"), "n_rows", "complete", F.lit(number).alias("batch_id"))
        upsert(spark, f"{target}/ledger", state, ["batch"], part=number, unique=True)
        left = rows.filter("not _complete").drop(*marks)
        # where nothing waited and nothing has to wait there is nothing to write down
        if before or not left.isEmpty():
            left.write.mode("overwrite").parquet(f"{target}/pending={number:09d}")
        for n in before[:-1]:
            _delete(spark, f"{target}/pending={n:09d}")
    finally:
        rows.unpersist()


def waiting_versions(spark: SparkSession, target: str) -> list[int]:
    return [_number(n) for n in _names(spark, f"{target}/pending=*")]


def ledger(spark: SparkSession, target: str) -> DataFrame:
    """(batch, start, stop, n_rows, complete, batch_id): the last state of each batch."""
    return read_table(spark, f"{target}/ledger", LEDGER, ["batch"])


def consume_listed(spark: SparkSession, source: str, schema: str, target: str, key: str, flags: Sequence[str] = (), most: int | None = None) -> None:
    """One run without a stream: the first ``most`` batches (by name) that the ledger does not hold as complete. A later run goes on from there.

    Batches are listed by the names of their files; only files of batches that a run takes are read, once. Files without rows make no batch.
    """
    done = read_table(spark, f"{target}/ledger")
    named = lambda df, path: df.withColumn("batch", F.regexp_extract(path, f"({BATCH_NAME})", 1))
    new = lambda df: df if done is None else df.join(done.filter("complete").select("batch"), "batch", "left_anti")
    files = spark.read.schema(schema).option("recursiveFileLookup", True)
    if most is None:
        rows = new(named(files.parquet(source), F.input_file_name()))
    else:
        listed = new(named(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source).select("path"), F.col("path"))).persist()
        try:
            taken, last = [], None
            while len(taken) < most:
                # as many names as are still wanted; more than once only where files are empty
                later = listed if last is None else listed.filter(F.col("batch") > last)
                names = [r.batch for r in later.select("batch").distinct().orderBy("batch").limit(most - len(taken)).collect()]
                if not names:
                    break
                paths = [r.path for r in listed.filter(F.col("batch").isin(names)).select("path").collect()]
                taken += [r.batch for r in named(files.parquet(*paths), F.input_file_name()).select("batch").distinct().collect()]
                last = names[-1]
            paths = [r.path for r in listed.filter(F.col("batch").isin(taken)).select("path").collect()] if taken else []
        finally:
            listed.unpersist()
        rows = named(files.parquet(*paths), F.input_file_name()) if paths else named(spark.createDataFrame([], schema), F.lit(""))
    numbers = [_number(n) for n in _names(spark, f"{target}/ledger/*=*")]
    _settle(spark, rows, max([-1, *numbers]) + 1, target, key, flags, None)


def progress(ledger: DataFrame, expected: int) -> DataFrame:
    """One row: complete batches, rows, how far coverage reaches without a gap, whether all is covered."""
    done = ledger.filter("complete").withColumn("_g", F.lit(1))
    n_rows = F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows")
    if tasks_for(ledger) == 1:
        # what one task holds is read in order: coverage ends before the first start that is not where the interval before it ends
        row = Window.partitionBy("_g").orderBy("start")
        odd = F.col("start") != F.coalesce(F.lag("stop").over(row), F.lit(0))
        broken = F.sum(F.col("_odd").cast("int")).over(row)  # with all intervals of the same start
        out = done.withColumn("_odd", odd).withColumn("_broken", broken).agg(F.count("*").alias("n_batches"), n_rows, F.coalesce(F.max(F.when(F.col("_broken") == 0, F.col("stop"))), F.lit(0).cast("long")).alias("covered_to"))
    else:
        reach = contiguous(done, ["_g"], "start", "stop").select("covered_to")
        out = done.agg(F.count("*").alias("n_batches"), n_rows).join(reach, F.lit(True), "left").withColumn("covered_to", F.coalesce("covered_to", F.lit(0).cast("long")))
    return out.withColumn("finished", F.col("covered_to") >= expected)


def unchanged(current: DataFrame, ledger: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inputs (source, bytes, mtime) that the ledger has with the same signature."""
    return current.join(ledger.select(*keys).distinct(), list(keys), "left_semi")


def restart_tokens(sources: DataFrame, ledger: DataFrame) -> DataFrame:
    """(source, next_index): after the last committed member where identity (bytes, mtime) is the same, else 0."""
    last = ledger.groupBy("source", "bytes", "mtime").agg(F.max("member_index").alias("last"))
    return sources.join(last, ["source", "bytes", "mtime"], "left").select("source", F.coalesce(F.col("last") + 1, F.lit(0)).alias("next_index"))


# arrival of batches as a stateful stream

ARRIVED = "batch string, event string, n_rows long, expected long, alarms int"
ARRIVAL_STATE = "hashes array<long>, alarms int, done boolean"


def arrivals(stream: DataFrame, key: str, stale_ms: int, alarms: int = 3, keep_ms: int | None = None) -> DataFrame:
    """What happens to each batch of a stream of rows with a batch name: (batch, event, n_rows, expected, alarms).

    complete: as many distinct keys as its name says have come, emitted once. stale: nothing came for ``stale_ms`` and rows are missing; after ``alarms`` of them
    in a row the batch is given up. surplus: more distinct keys than its name says, or rows after it was complete with keys that it didn't have.
    unnamed: the name encodes no interval.

    The state of a batch is one 64-bit hash for each key, as many as its name says and one more, until it is complete; then its hashes stay for
    ``keep_ms`` (``stale_ms`` if not given), so that a replay says nothing, and go. Given up batches leave no state. Timers are of processing time: a stream that
    gets no rows still raises alarms.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    rest = stale_ms if keep_ms is None else keep_ms
    start, stop = batch_interval(F.col("batch"))
    rows = stream.select("batch", F.xxhash64(key).alias("h"), F.col(key).isNotNull().alias("known"), (stop - start).alias("expected"))
    return rows.groupBy("batch").applyInPandasWithState(_arrival(stale_ms, alarms, rest), ARRIVED, ARRIVAL_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def _arrival(stale_ms: int, most: int, rest: int):
    import pandas as pd

    def step(name, frames, state):
        batch = name[0]
        hashes, alarms, done = state.get if state.exists else ([], 0, False)
        found = re.search(BATCH_NAME, batch or "")
        expected = int(found[2]) - int(found[1]) if found else None

        def event(kind: str, n: int):
            return pd.DataFrame([(batch, kind, n, expected, alarms)], columns=["batch", "event", "n_rows", "expected", "alarms"])

        if state.hasTimedOut:
            if done:
                state.remove()
            else:
                alarms += 1
                if alarms < most:
                    state.update((hashes, alarms, done))
                    state.setTimeoutDuration(stale_ms)
                else:
                    state.remove()
                yield event("stale", len(hashes))
            return
        had, seen, surplus = set(hashes), set(hashes), 0
        for frame in frames:
            for h in frame.loc[frame.known, "h"].tolist():
                if h in seen:
                    continue
                if expected is not None and len(seen) >= expected:
                    surplus += 1  # not kept: the state stays as large as the batch
                else:
                    seen.add(h)
        if expected is None:
            yield event("unnamed", len(seen))
            return
        if surplus:
            yield event("surplus", len(seen) + surplus)
        if len(seen) == expected and not done:
            done = True
            yield event("complete", len(seen))
        if seen != had:
            alarms = 0
        state.update((list(seen), alarms, done))
        state.setTimeoutDuration(rest if done else stale_ms)

    return step


def gated_stream(stream: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Rows of a stream that pass every flag. An unknown word stops the stream; what fails or has no flag never reaches the operators (and their state) behind."""
    return gate(stream, flags)


BEAT = "number long, at timestamp, n_batches long, n_rows long, covered_to long, finished boolean"


def beat(spark: SparkSession, target: str, number: int, expected: int | None = None) -> None:
    """A heartbeat of the run in ``target``/heartbeats: when, how many batches and rows are complete, how far coverage reaches. A replay replaces its own.

    It is one line of JSON, written whole under another name first: a job that writes a row takes longer than the one that finds it."""
    row = progress(ledger(spark, target), expected if expected is not None else 2**62).first().asDict()
    line = json.dumps({"number": number, "at": datetime.now(UTC).isoformat(), **row})
    _write(spark, f"{target}/heartbeats/beat-{number:09d}.json", line)


def run_state(spark: SparkSession, target: str, stale: str) -> DataFrame:
    """One row: the last heartbeat, and status finished, running, or stale where none came for ``stale`` (an interval such as "5 minutes")."""
    beats = spark.read.schema(BEAT).json(f"{target}/heartbeats")
    last = beats.agg(F.max(F.struct("number", "at", "n_batches", "n_rows", "covered_to", "finished")).alias("b")).select("b.*")
    old = F.col("at") < F.current_timestamp() - F.expr(f"interval {stale}")
    return last.withColumn("status", F.when(F.col("finished"), "finished").when(old, "stale").otherwise("running"))


def content_signature(rows: DataFrame, columns: Sequence[str]) -> tuple:
    """A digest to tell whether a batch's content changed."""
    return tuple(signature(rows, columns).first())


def deduplicated_stream(stream: DataFrame, keys: Sequence[str], event_time: str, late: str) -> DataFrame:
    """Each key once within the watermark; state is bounded by it."""
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark(list(keys))


def windowed_counts(stream: DataFrame, event_time: str, width: str, late: str, by: Sequence[str] = (), slide: str | None = None) -> DataFrame:
    """Tumbling or sliding event-time counts and sums with a watermark."""
    span = F.window(event_time, width, slide) if slide else F.window(event_time, width)
    return stream.withWatermark(event_time, late).groupBy(span, *by).agg(F.count("*").alias("n"), F.sum("value").alias("value_sum"))


def session_counts(stream: DataFrame, event_time: str, gap: str, late: str, by: str) -> DataFrame:
    return stream.withWatermark(event_time, late).groupBy(F.session_window(event_time, gap), by).agg(F.count("*").alias("n"))


def rollup_stream(spark: SparkSession, stream: DataFrame, keys: Sequence[str], value: str, target: str, checkpoint: str) -> StreamingQuery:
    """Participant rollup over batches: each micro-batch's sums and counts are a part of its own, so a replay replaces its part."""

    def each(df: DataFrame, batch_id: int) -> None:
        part = df.groupBy(*keys).agg(F.sum(value).alias("value_sum"), F.count(value).alias("n")).withColumn("batch_id", F.lit(batch_id))
        part.write.mode("overwrite").parquet(f"{target}/part={batch_id}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rollup_result(spark: SparkSession, target: str, keys: Sequence[str]) -> DataFrame:
    parts = spark.read.parquet(target).drop("part")
    return parts.groupBy(*keys).agg((F.sum("value_sum") / F.sum("n")).alias("mean"), F.sum("n").alias("n"))
