"""Result files of finished analyses applied to the tables of a property graph as they arrive.

The tables live in one folder, the log: ``base=<n>`` holds vertices, partition relationships and recommendations as of
batch n, ``delta=<m>`` the changes of batch m > n alone, keyed and partitioned by table. A batch writes its changes and
nothing else; readers merge the newest base with the deltas after it; ``compact`` makes a new base from both.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vertexloom.sources.text import RECOMMENDATIONS, content_lines

SOURCE_SCHEMA = "value string"
TABLES = ("vertices", "relationships", "recommendations")
# A change: owner is a partition, a user or null; id a vertex or a rank; name a property or an analysis.
KEY = ["owner", "id", "name"]
CHANGES = "owner long, id long, name string, value double, item long, delta long, table string"
# The last folders of a path that say which mode and analysis its lines are from.
ROUTE = r".*/(?:unpartitioned|partitioned/(?:partition_id=)?(\d+))/(?:analysis=)?(\w+)/"
COMPACT_AFTER = 50  # deltas that a reader merges at most

Route = Callable[[DataFrame], DataFrame]


def _files(spark: SparkSession, path: str):
    """File system, path and path class. Works on sessions with a JVM of their own, not on remote ones."""
    paths = spark._jvm.org.apache.hadoop.fs.Path
    folder = paths(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder, paths


def _numbers(spark: SparkSession, target: str, kind: str) -> list[int]:
    """Numbers of the bases or deltas in ``target``, complete ones only, in order."""
    files, folder, paths = _files(spark, target)
    if not files.exists(folder):
        return []
    marker = "complete/_SUCCESS" if kind == "base" else "_SUCCESS"
    found = [status.getPath() for status in files.listStatus(folder)]
    return sorted(int(path.getName().split("=")[1]) for path in found
                  if path.getName().startswith(f"{kind}=") and files.exists(paths(path, marker)))


def _folder(target: str, kind: str, number: int) -> str:
    return f"{target}/{kind}={number:010d}"


def current_version(spark: SparkSession, target: str) -> int | None:
    """Number of the newest change in the log, 0 before any."""
    return max(_numbers(spark, target, "base") + _numbers(spark, target, "delta"), default=None)


def _base(spark: SparkSession, target: str) -> int:
    numbers = _numbers(spark, target, "base")
    if not numbers:
        raise FileNotFoundError(f"no tables in {target}")
    return numbers[-1]


def _write_base(spark: SparkSession, tables: dict[str, DataFrame], target: str, number: int) -> None:
    folder = _folder(target, "base", number)
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")
    spark.range(1).select(F.lit(",".join(tables)).alias("value")).write.mode("overwrite").text(f"{folder}/complete")


def create_log(
    target: str,
    vertices: DataFrame | None = None,
    relationships: DataFrame | None = None,
    recommendations: DataFrame | None = None,
) -> None:
    """A log that starts with the given tables; changes to a table that isn't given fail.

    ``vertices`` have an ``id`` each; ``relationships`` are ``(partition_id, id, analysis, value double)``,
    ``recommendations`` ``(user, item, rank)``, both unique by their keys. A folder that holds a log is left as it is.
    """
    tables = {name: rows for name, rows in zip(TABLES, (vertices, relationships, recommendations)) if rows is not None}
    if not tables:
        raise ValueError("a log needs a table")
    if relationships is not None and relationships.schema["value"].dataType.simpleString() != "double":
        raise ValueError("values of relationships in a log are doubles, as those in result files")
    spark = next(iter(tables.values())).sparkSession
    if current_version(spark, target) is not None:
        raise FileExistsError(f"{target} holds tables already")
    _write_base(spark, tables, target, 0)


def create_target(rows: DataFrame, target: str) -> None:
    """A log of one table: relationships if the rows have a partition, else vertices."""
    create_log(target, **{"relationships" if "partition_id" in rows.columns else "vertices": rows})


def _table_names(spark: SparkSession, target: str, base: int) -> list[str]:
    return spark.read.text(f"{_folder(target, 'base', base)}/complete").first()["value"].split(",")


def _changes(spark: SparkSession, target: str, base: int, table: str) -> DataFrame:
    """Changes of one table after ``base``: one row per key and delta."""
    folders = [_folder(target, "delta", n) for n in _numbers(spark, target, "delta") if n > base]
    if not folders:
        return spark.createDataFrame([], CHANGES)
    found = spark.read.schema(CHANGES).option("basePath", target).parquet(*folders)
    return found.filter(F.col("table") == table)


def _merged(spark: SparkSession, target: str, table: str, base: int) -> DataFrame:
    rows = spark.read.parquet(f"{_folder(target, 'base', base)}/{table}")
    changes = _changes(spark, target, base, table)
    if table == "vertices":
        names = sorted(row["name"] for row in changes.select("name").distinct().collect())  # one per analysis
        if not names:
            return rows
        newest = [F.max_by("value", F.when(F.col("name") == name, F.col("delta"))).alias(f"_new_{i}")
                  for i, name in enumerate(names)]
        joined = rows.join(changes.groupBy("id").agg(*newest), "id", "left")
        old = [F.col(name) if name in rows.columns else F.lit(None).cast("double") for name in names]
        columns = [*rows.columns, *[name for name in names if name not in rows.columns]]
        return joined.withColumns(
            {name: F.coalesce(f"_new_{i}", old[i]) for i, name in enumerate(names)}).select(*columns)
    if table == "relationships":
        key, value, cast = ["partition_id", "id", "analysis"], "value", {"partition_id": "owner", "id": "id", "analysis": "name"}
    else:
        key, value, cast = ["user", "rank"], "item", {"user": "owner", "rank": "id"}
    renamed = changes.select(*[F.col(own).cast(rows.schema[name].dataType).alias(name) for name, own in cast.items()],
                             F.col(value).cast(rows.schema[value].dataType).alias("_value"), "delta")
    newest = renamed.groupBy(*key).agg(F.max_by("_value", "delta").alias("_new"))
    joined = rows.join(newest, key, "full_outer").withColumn(value, F.coalesce("_new", value))
    return joined.select(*rows.columns)


def read_table(spark: SparkSession, target: str, table: str) -> DataFrame:
    """``vertices``, ``relationships`` or ``recommendations`` with all changes so far.

    A vertex has the columns it started with, then one per analysis that came in; null where it has no result.
    """
    base = _base(spark, target)
    if table not in _table_names(spark, target, base):
        raise ValueError(f"{target} has no {table}")
    return _merged(spark, target, table, base)


def read_current(spark: SparkSession, target: str) -> DataFrame:
    """The first table of the log, which is the only one after ``create_target``."""
    return read_table(spark, target, _table_names(spark, target, _base(spark, target))[0])


def compact(spark: SparkSession, target: str) -> int:
    """Write a base as of the newest delta and return its number.

    The base before it and the deltas between the two stay, for readers that have begun; what is older is deleted.
    Not to be run beside a running stream, which compacts by itself.
    """
    base = _base(spark, target)
    newest = max([base, *_numbers(spark, target, "delta")])
    if newest == base:
        return base
    _write_base(spark, {name: _merged(spark, target, name, base) for name in _table_names(spark, target, base)}, target, newest)
    files, _, paths = _files(spark, target)
    for kind, last in (("base", base - 1), ("delta", base)):
        for number in _numbers(spark, target, kind):
            if number <= last:
                files.delete(paths(_folder(target, kind, number)), True)
    return newest


def by_path(lines: DataFrame) -> DataFrame:
    """Add ``table``, ``owner`` and ``name`` from ``file_path``.

    ``.../partitioned/<partition>/<analysis>/...`` goes to the relationships of the partition,
    ``.../unpartitioned/collaborative_filtering/...`` to recommendations, any other ``.../unpartitioned/<analysis>/...``
    to the vertex property of that name. Folders may be written ``partition_id=<partition>`` and ``analysis=<analysis>``.
    A file elsewhere, and results named ``id`` for vertices, fail the batch.
    """
    owner, name = (F.regexp_extract("file_path", ROUTE, group) for group in (1, 2))
    lost = F.raise_error(F.concat(F.lit("no table for results in "), F.col("file_path"))).cast("string")
    table = (F.when((name == "") | ((owner == "") & (name == "id")), lost).when(owner != "", "relationships")
             .when(name == RECOMMENDATIONS, "recommendations").otherwise("vertices"))
    return lines.withColumns({"table": table, "owner": F.when(owner != "", owner).cast("long"), "name": name})


def by_parameters(name: str, partition_id: int | None, lines: DataFrame) -> DataFrame:
    """All lines are results of one analysis, of vertices or of one partition."""
    return lines.withColumns({
        "table": F.lit("vertices" if partition_id is None else "relationships"),
        "owner": F.lit(partition_id).cast("long"), "name": F.lit(name)})


def changes_of(lines: DataFrame) -> DataFrame:
    """One change per key from routed lines: the one in the file that arrived last; within a file the largest value, or of
    recommendations the lowest item.

    Lines are ``id value``, those of recommendations ``user,item,rank``; one without the fields of its form fails.
    """
    text, ranked = F.trim("value"), F.col("table") == "recommendations"
    parts = F.when(ranked, F.split(text, r"\s*,\s*")).otherwise(F.split(text, r"\s+"))
    fields = content_lines(lines).withColumn("_parts", parts)
    problem = F.raise_error(F.concat(F.lit("not a result: "), F.col("value"))).cast("boolean")
    fits = F.size("_parts") == F.when(ranked, 3).otherwise(2)
    first, second = F.col("_parts")[0], F.col("_parts")[1]
    rows = fields.filter(F.when(fits, True).otherwise(problem)).select(
        "table",
        F.when(ranked, first.cast("long")).otherwise(F.col("owner")).alias("owner"),
        F.when(ranked, F.get("_parts", F.lit(2)).cast("long")).otherwise(first.cast("long")).alias("id"),
        F.when(~ranked, F.col("name")).alias("name"),
        F.when(~ranked, second.cast("double")).alias("value"),
        F.when(ranked, second.cast("long")).alias("item"),
        "file_time", "file_path")
    last = F.struct("file_time", "file_path", "value", -F.col("item"))
    kept = rows.groupBy("table", *KEY).agg(F.max_by(F.struct("value", "item"), last).alias("_last"))
    return kept.select("table", *KEY, "_last.value", "_last.item")


def append_changes(target: str, unknown: str, compact_after: int, route: Route, batch: DataFrame, number: int) -> None:
    """Write the changes of batch ``number``, counted from 0, as delta ``number + 1``.

    A batch that comes again replaces its own delta; one that a base holds already is passed over, for its changes are
    in that base.
    """
    spark = batch.sparkSession
    base, delta = _base(spark, target), number + 1
    if delta <= base:
        return
    names = _table_names(spark, target, base)
    changes = changes_of(route(batch)).persist()
    try:
        for row in changes.select("table").distinct().collect():
            if row["table"] not in names:
                raise ValueError(f"{target} has no {row['table']}")
        if unknown == "raise" and "vertices" in names:
            known = spark.read.parquet(f"{_folder(target, 'base', base)}/vertices").select("id")
            lost = changes.filter(F.col("table") == "vertices").select("id").join(known, "id", "left_anti").take(1)
            if lost:
                raise ValueError(f"no vertex with id {lost[0]['id']}")
        changes.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("table").parquet(
            _folder(target, "delta", delta))
    finally:
        changes.unpersist()
    if sum(n > base for n in _numbers(spark, target, "delta")) >= compact_after:
        compact(spark, target)


def _start(
    spark: SparkSession, source_dir: str, checkpoint: str, max_files: int | None, recursive: bool,
    apply: Callable[[DataFrame, int], None],
) -> StreamingQuery:
    source = spark.readStream.schema(SOURCE_SCHEMA).option("recursiveFileLookup", str(recursive).lower())
    if max_files is not None:
        source = source.option("maxFilesPerTrigger", max_files)
    lines = source.text(source_dir).select(
        "value", F.col("_metadata.file_modification_time").alias("file_time"), F.col("_metadata.file_path").alias("file_path")
    )
    return lines.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def import_results_stream(
    spark: SparkSession,
    source_dir: str,
    target: str,
    unknown: str = "raise",
    max_files: int | None = None,
    compact_after: int = COMPACT_AFTER,
) -> StreamingQuery:
    """Apply all result files below ``source_dir`` to the log at ``target``, each to the table that its path names.

    A batch writes one row per changed key, in one commit for all tables. A batch that fails (a line that doesn't parse, a
    path that names no table, an id that no vertex has unless ``unknown="ignore"``) stops the query and is tried again
    at the next start; no result is passed over. Progress is kept in the log, so a log belongs to one source folder.
    The query works off the files present and stops; start it again for more.
    """
    if unknown not in ("raise", "ignore"):
        raise ValueError(f"unknown must be 'raise' or 'ignore', not {unknown!r}")
    apply = partial(append_changes, target, unknown, compact_after, by_path)
    return _start(spark, source_dir, f"{target}/progress", max_files, True, apply)


def apply_updates_stream(
    spark: SparkSession,
    source_dir: str,
    target: str,
    checkpoint: str,
    name: str,
    partition_id: int | None = None,
    max_files: int | None = None,
) -> StreamingQuery:
    """Apply result files of one analysis (``id value`` lines) from ``source_dir`` to the log at ``target``.

    They set property ``name`` of vertices, or with ``partition_id`` the relationships of that partition. Otherwise as
    ``import_results_stream``, but progress is kept in ``checkpoint``, which must be that of the log's earlier runs.
    """
    apply = partial(append_changes, target, "raise", COMPACT_AFTER, partial(by_parameters, name, partition_id))
    return _start(spark, source_dir, checkpoint, max_files, False, apply)
