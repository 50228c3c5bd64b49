"""Parquet tables partitioned by run date, and lineage cuts through shared storage."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from threading import Lock

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# Lines of snapshots take ten to twenty times as much room in a sort as in a shuffle file.
PORTION = "16m"
# Half the room of Spark's default: texts and digests of many runs are most of what is stored.
CODEC = "zstd"
# Dates that one task writes side by side; with more of them it sorts the rows that are left.
OPEN_DATES = 64

_held: dict[tuple[str, str], tuple[int, str]] = {}  # settings held, by how many, and what they were before
_held_lock = Lock()


@contextmanager
def held(spark: SparkSession, setting: str, value: str) -> Iterator[None]:
    """A session setting for the time of a job. Such jobs may run side by side: the last one to end sets it back."""
    key = (spark.sparkContext.applicationId, setting)
    with _held_lock:
        running, before = _held.get(key, (0, spark.conf.get(setting)))
        _held[key] = running + 1, before
        spark.conf.set(setting, value)
    try:
        yield
    finally:
        with _held_lock:
            running, before = _held.pop(key)
            if running > 1:
                _held[key] = running - 1, before
            else:
                spark.conf.set(setting, before)


def run_date() -> Column:
    """Run ids start with the date of the run."""
    return F.substring("run_id", 1, 8)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. In local mode, where one machine is all there is, a temporary one if none is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="fleetlens-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def partition_for(spark: SparkSession, portions: int) -> None:
    """Let shuffles start with as many partitions as an input has portions. Spark merges small ones, but divides none on its own, so with
    too few of them the rows of a task, and what it spills, grow with the input. An application that already has as many stays as it is."""
    first, aim = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if portions > int(spark.conf.get(first, None) or spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(first, str(portions))
        spark.conf.set(aim, PORTION)


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors and cuts the lineage."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def write_table(df: DataFrame, root: str, name: str, mode: str = "overwrite", in_place: bool = False) -> str:
    """Write a table; run tables are partitioned by run date and clustered by run inside their files.

    Rows are first dealt out by date in portions of the size that Spark aims at, so a large date has several files and a small one a single file. Rows that come out of
    blocks (`in_place`) follow each other by run already, and there are far more of them than blocks: each task writes its own to their dates, without a shuffle or a sort.
    """
    path = f"{root}/{name}"
    if "run_id" in df.columns:
        order = ["run_id"] if name != "run_commands" else ["command_tag", "run_id"]
        dated = df.withColumn("run_date", run_date())
        if in_place and mode == "overwrite":
            with held(df.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", str(OPEN_DATES)):
                dated.write.partitionBy("run_date").mode(mode).option("compression", CODEC).parquet(path)
            return path
        dealt = df.sparkSession.sql("SELECT /*+ REBALANCE(run_date) */ * FROM {dated}", dated=dated)
        out = dealt.sortWithinPartitions("run_date", *order)
        writer = out.write.partitionBy("run_date").option("partitionOverwriteMode", "dynamic" if mode == "replace" else "static")
    else:
        writer = df.write
    writer.mode("overwrite" if mode == "replace" else mode).option("compression", CODEC).parquet(path)
    return path


def read_table(spark: SparkSession, root: str, name: str, dates: list[str] | None = None, like: DataFrame | None = None) -> DataFrame:
    """A stored table; with `dates`, only the partitions of those run dates. `like` gives the schema of a table that may have no rows yet."""
    reader = spark.read
    if like is not None:
        reader = reader.schema((like.withColumn("run_date", run_date()) if "run_id" in like.columns else like).schema)
    table = reader.parquet(f"{root}/{name}")
    if dates is not None and "run_date" in table.columns:
        table = table.filter(F.col("run_date").cast("string").isin(dates))
    return table.drop("run_date")


def dates_of(runs: DataFrame) -> list[str]:
    """The run dates of some runs: as many as days at most."""
    return sorted(r[0] for r in runs.select(run_date()).distinct().collect())


def replace_in_table(fresh: DataFrame, fresh_runs: DataFrame, root: str, name: str, dates: list[str] | None = None) -> None:
    """Add the rows of fresh runs. Runs that the table has already are replaced, and only their dates are read and rewritten.

    Replaying the same batch gives the same table, so a repeated micro-batch does no harm.
    """
    spark = fresh.sparkSession
    dates = dates_of(fresh_runs) if dates is None else dates
    try:
        stored = spark.read.schema(fresh.withColumn("run_date", run_date()).schema).parquet(f"{root}/{name}")
    except AnalysisException as e:  # first batch: nothing stored yet
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        write_table(fresh, root, name)
        return
    stored = stored.filter(F.col("run_date").isin(dates)).drop("run_date")
    runs = fresh_runs.select("run_id").distinct()
    again = dates_of(stored.select("run_id").join(runs, "run_id", "left_semi"))
    if again:
        kept = stored.filter(run_date().isin(again)).join(runs, "run_id", "left_anti")
        # the target is also a source: go through the shared folder before overwriting its partitions
        write_table(checkpoint(kept.unionByName(fresh.filter(run_date().isin(again)))), root, name, mode="replace")
    if len(again) < len(dates):
        write_table(fresh.filter(~run_date().isin(again)) if again else fresh, root, name, mode="append")
