"""Session helpers shared by every module: tables, workers and shared scratch space."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def build_session(cores: int | str = "*", app: str = "quillon", memory: str = "8g") -> SparkSession:
    """A local session with the settings the engine is tested with."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package when it is run from a checkout."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


#: Plan nodes that keep the splits of the scan below them.
NARROW = {"Project", "Filter", "Generate", "LogicalRelation", "Union", "LogicalRDD", "LocalRelation", "SubqueryAlias"}


def _nodes(plan) -> set[str]:
    """Names of the nodes of a logical plan."""
    names, children = {plan.nodeName()}, plan.children()
    for i in range(children.size()):
        names |= _nodes(children.apply(i))
    return names


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy Python stages at least one partition a core; starts no job.

    A plan without a shuffle has the splits of its scans, which are known before it runs. Behind a shuffle adaptive
    execution makes partitions of the advisory size, so only results smaller than that a core are dealt out again:
    what is shuffled for this is at most that size times the cores, however large the table.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    execution = df._jdf.queryExecution()
    if _nodes(execution.optimizedPlan()) <= NARROW:
        splits = execution.sparkPlan().execute().getNumPartitions()
        return df if splits >= cores else df.repartition(cores)
    advisory = spark._jsparkSession.sessionState().conf().getConf(spark._jvm.org.apache.spark.sql.internal.SQLConf.ADVISORY_PARTITION_SIZE_IN_BYTES())
    size = int(str(execution.optimizedPlan().stats().sizeInBytes()))
    return df if size >= cores * int(advisory) else df.repartition(cores)


def filesystem(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it knows it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir).

    Where none is set, a local session gets a folder of its own; on a cluster that is an error, as tasks
    would write to the disks of their machines.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="spark-quillon-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


#: Tables written by this process and not yet deleted, with their names in the catalog (empty: none).
_WRITTEN: dict[str, str] = {}


def materialise(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back: it is computed once and its lineage is cut.

    With ``by`` the table is bucketed by that column, so that joins and groups on it need no further shuffle. The
    table stays until it is discarded, released or the process ends.
    """
    spark = df.sparkSession
    path, named = f"{scratch_root(spark)}/quillon/{name}-{uuid.uuid4().hex}", ""
    if not _WRITTEN:
        atexit.register(release, spark)
    if by is None:
        df.write.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    else:
        parts, named = int(spark.conf.get("spark.sql.shuffle.partitions")), f"quillon_{uuid.uuid4().hex}"
        df.repartition(parts, by).write.format("parquet").bucketBy(parts, by).sortBy(by).option("path", path).saveAsTable(named)
        out = spark.table(named)
    _WRITTEN[path] = named
    out.written_to = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    if path in _WRITTEN:
        if named := _WRITTEN.pop(path):
            spark.sql(f"DROP TABLE IF EXISTS {named}")
        fs, place = filesystem(spark, path)
        fs.delete(place, True)


def discard(*tables: DataFrame | None) -> None:
    """Delete materialised tables that nothing reads any more; others are left alone."""
    for t in tables:
        if t is not None and hasattr(t, "written_to"):
            _delete(t.sparkSession, t.written_to)


def release(spark: SparkSession) -> None:
    """Delete everything this process materialised; results that still read it can't be collected afterwards."""
    if spark.sparkContext._jsc is None:
        return
    for path in sorted(_WRITTEN):
        _delete(spark, path)
