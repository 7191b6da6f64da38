"""Session helpers: table access and lineage cuts that survive executor loss.

One configured root holds whatever is staged.  ``release`` drops the tables a caller no longer reads,
``release_all`` everything the application staged; a long-lived application calls them.

Iterative operators write each round as a parquet table in the shared folder named by
``spark.checkpoint.dir``.  A written table is computed once, is readable from every
executor, and carries size statistics, so Catalyst can decide about broadcasts itself.  Its files may be
hundreds of times smaller than its rows, which the driver would hold: the statistics are those of the rows.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}
_OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"
_FACTOR = "spark.sql.sources.fileCompressionFactor"
#: Files below this many bytes keep the estimate by file size: even their rows fit into a driver.
SMALL_FILES = 1 << 18
_READERS: dict[tuple, object] = {}
_FACTORS: dict[tuple, int] = {}


def stage_root(spark: SparkSession) -> str:
    """Folder for round tables: the cluster's checkpoint folder, or a fresh one in local mode."""
    app = spark.sparkContext.applicationId
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return f"{configured.rstrip('/')}/weftgraph/{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="weftgraph-")
    return _LOCAL_ROOTS[app]


def _reader(spark: SparkSession, factor: int):
    """A session of the same application that takes files for ``factor`` times as large as they are;
    a relation asks the session that read it."""
    key = (spark.sparkContext.applicationId, factor)
    if key not in _READERS:
        _READERS[key] = spark._jsparkSession.newSession()
    conf = _READERS[key].conf()
    for name, value in spark.conf.getAll.items():
        if conf.isModifiable(name):
            conf.set(name, value)
    conf.set(_FACTOR, str(factor))
    return _READERS[key]


def _factor(read: DataFrame) -> int:
    """How many times larger the rows of a read folder are than its files, a power of two."""
    size, factor = read._jdf.queryExecution().optimizedPlan().stats().sizeInBytes(), 1
    if size >= SMALL_FILES:
        # Counted from the footers.  8 bytes a row as Catalyst adds them.
        wanted = read.count() * (read._jdf.schema().defaultSize() + 8)
        while factor * size < wanted:
            factor *= 2
    return factor


def _sized(read: DataFrame, path: str, factor: int) -> DataFrame:
    """``read`` (of ``path``) with ``factor`` times the size of its files as its statistics.

    A broadcast is decided by the size of the files; compressed ids and texts may take a hundredth of what
    the driver needs for them.
    """
    if factor == 1:
        return read
    spark = read.sparkSession
    plan = _reader(spark, factor).read().schema(read._jdf.schema()).format("parquet").load(path).logicalPlan()
    return DataFrame(
        spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a round table and read it back with the same schema and the size of its rows."""
    path = _written(df, name, partition_by)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    return _sized(read, path, _factor(read)).select(*df.columns)


def stage_as_is(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """As ``stage``, with the size of the files as the table's statistics."""
    path = _written(df, name, partition_by)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def _written(df: DataFrame, name: str, partition_by: list[str] | None) -> str:
    spark = df.sparkSession
    path = f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if not partition_by:
        writer.parquet(path)
    else:
        # Rows go to the open files of their partitions; a sort by partition would spill all of them.
        before = spark.conf.get(_OPEN_FILES)
        spark.conf.set(_OPEN_FILES, "16")
        try:
            writer.partitionBy(*partition_by).parquet(path)
        finally:
            spark.conf.set(_OPEN_FILES, before)
    return path


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def table_exists(spark: SparkSession, path: str) -> bool:
    files, where = _file_system(spark, path)
    return files.exists(where)


def release(*staged: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in staged:
        spark, root = df.sparkSession, stage_root(df.sparkSession).split(":", 1)[-1]
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if root.lstrip("/") in folder:  # never anything outside the stage root
                files, where = _file_system(spark, folder)
                files.delete(where, True)


def release_all(spark: SparkSession) -> None:
    """Delete everything this application staged."""
    files, where = _file_system(spark, stage_root(spark))
    files.delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table with the size of its rows; they are counted once an application."""
    path = f"{sf_dir}/{name}.parquet"
    read = spark.read.parquet(path)
    key = (spark.sparkContext.applicationId, path)
    if key not in _FACTORS:
        _FACTORS[key] = _factor(read)
    return _sized(read, path, _FACTORS[key])


def table_as_is(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
