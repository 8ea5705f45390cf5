"""Sources and sinks: releases, inventories, batches, partitioned writes and keyed upserts."""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.clean import eye_code, extension, member_class, path_identity

MAX_COLUMNS = 10_000
MEMBER_SCHEMA = "archive_path string, member_path string, member_index int, bytes long, stored_bytes long, crc32 long, encrypted boolean"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or glob) has anything, in any file system that Spark reads."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Recursive listing by metadata alone: file content is never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    base = F.lit(root.rstrip("/").removeprefix("file://"))
    relative = F.expr("substr(path, locate(_root, path) + length(_root) + 1)")
    return files.withColumn("_root", base).select("path", relative.alias("relative_path"), F.element_at(F.split("path", "/"), -1).alias("name"), extension(F.col("path")).alias("extension"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def discover(inventory: DataFrame, pattern: str) -> DataFrame:
    return inventory.filter(F.col("path").rlike(pattern)).select("path").orderBy("path")


def read_release(spark: SparkSession, path: str | Sequence[str], sep: str = ",") -> DataFrame:
    """Quoted, multi-line, all-string, wide releases; a broken row fails. A multi-line file is one task, so rows are spread after it."""
    df = spark.read.options(header=True, sep=sep, quote='"', escape='"', multiLine=True, mode="FAILFAST", maxColumns=MAX_COLUMNS, inferSchema=False).csv(path)
    return df.repartition(spark.sparkContext.defaultParallelism)


def read_auto(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, Delta (where that package is), delimited text, by name."""
    low = path.lower().rstrip("/")
    if low.endswith((".csv", ".csv.gz")):
        return read_release(spark, path)
    if low.endswith((".tsv", ".txt", ".txt.gz")):
        return read_release(spark, path, "\t")
    if exists(spark, f"{path}/_delta_log"):
        return spark.read.format("delta").load(path)
    if low.endswith(".parquet") or exists(spark, f"{path}/*.parquet") or exists(spark, f"{path}/*/*.parquet"):
        return spark.read.parquet(path)
    if low.endswith((".json", ".jsonl")):
        return spark.read.json(path)
    if low.endswith(".orc"):
        return spark.read.orc(path)
    raise ValueError(f"no reader for {path}")


def read_whitespace(spark: SparkSession, path: str) -> DataFrame:
    """Blank-delimited text; a line that begins with the header's first name (that of the first file) is a header, in whatever order a file has its columns."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_path").alias("file")).filter("line != ''")
    first = lines.first()
    if first is None:
        raise ValueError(f"{path}: no header")
    names = first.line.split()
    cells = F.split("line", r"\s+")
    # a header for each file: as many rows as files, matched by name
    heads = lines.filter(F.element_at(cells, 1) == names[0]).groupBy("file").agg(F.min("line").alias("head")).select("file", F.split("head", r"\s+").alias("head"))
    rows = lines.filter(F.element_at(cells, 1) != names[0]).join(heads, "file", "left").withColumn("head", F.coalesce("head", F.array(*map(F.lit, names))))
    at = lambda n: F.array_position("head", F.lit(n)).cast("int")
    return rows.select(*[F.when(at(n) > 0, F.get(cells, at(n) - 1)).alias(n) for n in names])


def header_profile(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, delimiter, n_columns, columns_json, error) from the first line of each delimited file."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    # the line at the start of a file is the first of its first block, which keeps file order
    numbered = lines.filter("block = 0").withColumn("n", F.monotonically_increasing_id())
    first = numbered.groupBy("path").agg(F.min_by("value", "n").alias("line"))
    counts = {d: F.size(F.split("line", r)) - 1 for d, r in ((",", ","), ("\t", "\t"), (";", ";"), ("|", r"\|"))}
    most = F.greatest(*counts.values())
    pick = F.when(most == 0, None)
    for d, c in counts.items():
        pick = pick.when(c == most, d)
    cells = F.transform(F.when(F.col("delimiter").isNull(), F.array("line")).otherwise(F.split("line", F.concat(F.lit("\\Q"), F.col("delimiter"), F.lit("\\E")))), lambda x: F.trim(F.regexp_replace(x, '^"|"$', "")))
    return first.withColumn("delimiter", pick).withColumn("cells", cells).select("path", "delimiter", F.size("cells").alias("n_columns"), F.to_json("cells").alias("columns_json"), F.when(F.trim("line") == "", "empty header").alias("error"))


def archive_members(archives: DataFrame, path: str = "path") -> DataFrame:
    """One row per member of each archive, from the central directory alone; archives are spread over tasks.

    Identity and class of members are columns of their paths.
    """

    def run(batches):
        from pyarrow import fs

        for pdf in batches:
            rows = []
            for p in pdf[path]:
                store, where = fs.FileSystem.from_uri(p) if ":" in p else (fs.LocalFileSystem(), p)
                with store.open_input_file(where) as f, zipfile.ZipFile(f) as z:
                    rows += [(p, m.filename, i, m.file_size, m.compress_size, m.CRC, bool(m.flag_bits & 1)) for i, m in enumerate(m for m in z.infolist() if not m.is_dir())]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in MEMBER_SCHEMA.split(", ")])

    members = archives.select(path).repartition(path).mapInPandas(run, MEMBER_SCHEMA)
    who, eye = path_identity(F.col("member_path"))
    return members.withColumns({"extension": extension(F.col("member_path")), "member_class": member_class(F.col("member_path")), "participant_id": who, "eye": eye_code(eye)})


def read_batches(spark: SparkSession, glob: str, schema: StructType | str, keys: Sequence[str] = ()) -> DataFrame:
    """Batches of Parquet with drifting types as one stable projection.

    Names of files are rows: tasks read their footers and give a row for each row group; tasks read row groups, one at a time, and cast the
    columns of the projection. Columns that a file lacks are null; a value that its type can't hold fails the job. Large files are read by many tasks.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    from ..operators.checks import assert_unique

    target = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    kinds = {f.name: to_arrow_type(f.dataType) for f in target.fields}
    files = spark.read.format("binaryFile").load(glob).select("path")
    if not files.limit(1).count():
        raise FileNotFoundError(glob)

    def opened(path: str):
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, where = fs.FileSystem.from_uri(path)
        return pq.ParquetFile(store.open_input_file(where))

    def footers(batches):
        for pdf in batches:
            yield pd.DataFrame([(p, g) for p in pdf["path"] for g in range(opened(p).num_row_groups)], columns=["path", "row_group"])

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            for path, g in zip(*(batch.column(c).to_pylist() for c in ("path", "row_group")), strict=True):
                with opened(path) as f:
                    table = f.read_row_group(g, columns=[c for c in f.schema_arrow.names if c in kinds])
                out = [table.column(c).cast(k, safe=not pa.types.is_floating(table.column(c).type)) if c in table.column_names else pa.nulls(table.num_rows, k) for c, k in kinds.items()]
                yield from pa.table(out, names=list(kinds)).to_batches(max_chunksize=50_000)

    groups = files.repartition("path").mapInPandas(footers, "path string, row_group int")
    out = groups.repartition("path", "row_group").mapInArrow(rows, target)
    return assert_unique(out, keys, glob) if keys else out


def first_source(spark: SparkSession, choices: Sequence[tuple[str, str]]) -> tuple[DataFrame, str, str]:
    """(rows, path, mode) of the first choice (mode, path) that is there."""
    for mode, path in choices:
        if mode == "table" and spark.catalog.tableExists(path):
            return spark.table(path), path, mode
        if mode != "table" and exists(spark, path):
            return read_auto(spark, path) if mode != "batches" else spark.read.parquet(path), path, mode
    raise FileNotFoundError(str(choices))


def scan_for_ids(df: DataFrame, ids: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Some columns of a large table for a cohort: pruned scan and semi-join."""
    return df.select(key, *[c for c in columns if c != key]).join(ids.select(key).distinct(), key, "left_semi")


def write_partitioned(df: DataFrame, path: str, *by: str, form: str = "parquet") -> None:
    """Overwrite by partition columns; rows of a partition value are brought together first, so files stay few (skew is split by size)."""
    rows = df.hint("rebalance", *by) if by else df
    writer = rows.write.mode("overwrite").format(form)
    (writer.partitionBy(*by) if by else writer).save(path)


def merged(current: DataFrame | None, batch: DataFrame, keys: Sequence[str], version: str | None = None) -> DataFrame:
    """What a keyed upsert leaves: a batch row replaces the row of its key, others stay; columns either side lacks are null.

    Within the batch the highest ``version`` (then the whole row) wins. Running a batch again changes nothing.
    """
    both = batch.withColumn("_new", F.lit(1))
    if current is not None:  # a union loses how the batch's rows are dealt out
        both = current.withColumn("_new", F.lit(0)).unionByName(both, allowMissingColumns=True)
    rest = [F.col(c) for c in batch.columns if c not in keys]
    order = [F.desc("_new"), *([F.desc_nulls_last(version)] if version else []), F.desc(F.xxhash64(*rest) if rest else F.lit(0))]
    return both.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r", "_new")


TASK_BYTES = 32 << 20
MAX_PARTS = 16  # parts, or runs of one level, of a keyed table that wait to be merged


def _names(spark: SparkSession, pattern: str) -> list[str]:
    """Names of the folders that a glob finds and whose write has ended, ascending."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{pattern}/_SUCCESS")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(f.getPath().getParent().getName() for f in found or [])


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _write(spark: SparkSession, path: str, text: str) -> None:
    """A small file in any file system that Spark writes; it gets its name when it is whole and replaces what had it."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    hidden = jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}-{uuid.uuid4().hex}")
    files = p.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(hidden, True)
    out.write(bytearray(text.encode()))
    out.close()
    files.delete(p, False)
    if not files.rename(hidden, p):
        raise OSError(f"{path} was not written")


def _number(name: str) -> int:
    return int(name.rpartition("=")[2])


def _held(spark: SparkSession, path: str) -> tuple[list[tuple[int, int, int, str]], list[str]]:
    """(what makes up a table, what nothing reads any more): parts and runs as (level, first and last number, name), oldest first.

    A part is of level 0. A run holds all parts from its first to its last number and stands for everything that lies inside of it.
    """
    found = [(0, n, n, name) for name in _names(spark, f"{path}/part=*") for n in [_number(name)]]
    for name in _names(spark, f"{path}/run=*"):
        level, first, last = map(int, name.removeprefix("run=").split("-"))
        found.append((level, first, last, name))
    inside = lambda x: any(y[0] > x[0] and y[1] <= x[1] and x[2] <= y[2] for y in found)
    return sorted((x for x in found if not inside(x)), key=lambda x: x[2]), [x[3] for x in found if inside(x)]


def tasks_for(df: DataFrame) -> int:
    """How many tasks a table is worth by what Spark thinks it holds: one for each 32 MB, never more than shuffle partitions."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, min(-(-size // TASK_BYTES), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def _read(spark: SparkSession, path: str, names: Sequence[str], schema: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """The newest row of each key of parts and runs, the last one being the newest. Columns that some of them lack are null there.

    All of them are one scan; with a schema and keys that are known, no file is opened before. Parts whose types differ are read one by one."""
    paths = [f"{path}/{n}" for n in names]
    keys = keys if schema else [r.key for r in spark.read.schema("key string").parquet(f"{path}/keys").collect()] if len(names) > 1 else []
    try:
        found = spark.read.schema(schema).parquet(*paths) if schema else spark.read.option("mergeSchema", True).parquet(*paths)
    except Exception as e:  # of analysis, or of the job that reads the footers
        if "MERGE" not in str(e).upper():
            raise
        found = None
    if found is None:
        for place, one in enumerate(paths):
            rows = spark.read.parquet(one).withColumn("_part", F.lit(place))
            found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
    elif len(names) == 1:
        return found
    else:
        # the last number of a folder's name orders parts and runs
        found = found.withColumn("_part", F.regexp_extract(F.input_file_name(), "([0-9]+)/[^/]*$", 1).cast("long"))
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_part")))
    return found.repartition(tasks_for(found), *keys).withColumn("_r", newest).filter("_r = 1").drop("_r", "_part")


def upsert(spark: SparkSession, path: str, batch: DataFrame, keys: Sequence[str], version: str | None = None, part: int | None = None, unique: bool = False) -> None:
    """Keyed upsert of a Parquet table by parts: a batch is written once, as a part; the newest part that has a key wins when the table is read.

    ``MAX_PARTS`` parts are merged into a run of level 1, as many runs of a level into one of the next. So a row is written once for each level, and
    upserts write n log n rows together, whatever the table holds; a reader opens ``MAX_PARTS`` parts and runs of each level at most. A run counts when its
    write has ended; what it holds goes with the next upsert. ``part`` names a part: writing it again replaces it, so a repeated micro-batch changes
    nothing. Parts that a run already holds are not written again. ``unique``: no key comes twice in the batch.
    """
    if not _names(spark, f"{path}/keys"):
        spark.createDataFrame([(k,) for k in keys], "key string").coalesce(1).write.mode("overwrite").parquet(f"{path}/keys")
    held, over = _held(spark, path)
    number = part if part is not None else max([-1, *(x[2] for x in held)]) + 1
    if any(level and first <= number <= last for level, first, last, _ in held):
        return
    rows, name = batch if unique else merged(None, batch, keys, version), f"part={number:09d}"
    rows.write.mode("overwrite").parquet(f"{path}/{name}")
    for old in over:
        _delete(spark, f"{path}/{old}")
    held, level = sorted({*held, (0, number, number, name)}, key=lambda x: x[2]), 0
    while len(mine := [x for x in held if x[0] == level]) >= MAX_PARTS:
        _read(spark, path, [x[3] for x in mine]).write.mode("overwrite").parquet(f"{path}/run={level + 1:02d}-{mine[0][1]:09d}-{mine[-1][2]:09d}")
        held, level = _held(spark, path)[0], level + 1


def read_table(spark: SparkSession, path: str, schema: str | None = None, keys: Sequence[str] = ()) -> DataFrame | None:
    """The newest row of each key of an upserted table; None where there is none. Schema and keys may be given where they are known."""
    held, _ = _held(spark, path)
    if not held:
        return None
    names = [x[3] for x in held]
    return _read(spark, path, names, schema, keys) if schema else _read(spark, path, names)


def with_column(df: DataFrame, name: str, kind: str) -> DataFrame:
    """Schema evolution: the column if it is there, else typed nulls."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))


def dictionary_sheets(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """Exported dictionary sheets: all text, header as schema."""
    return {name: read_release(spark, p) for name, p in paths.items()}


def release_report(catalog: DataFrame, members: DataFrame, needed: DataFrame) -> DataFrame:
    """Catalogued releases with what was found and what their report still lacks."""
    from ..operators.aggregate import release_summary

    found = release_summary(members, "release", "member_class", ("stored_bytes", "bytes"), "participant_id", "eye")
    return catalog.join(found, "release", "left").join(needed.groupBy("release").agg(F.count("*").alias("n_needed")), "release", "left")
