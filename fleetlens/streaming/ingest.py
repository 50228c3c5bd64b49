"""Incremental ingest: new snapshot files -> blocks, registry, extracted and derived tables."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.operators.blocks import split_blocks
from fleetlens.plans.fleet import EXTRACTIONS, OVERALL, PER_RUN, Fleet
from fleetlens.sources import snapshots as src
from fleetlens.sources.warehouse import dates_of, read_table, replace_in_table, shared_folder, write_table

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
#: Tables that are written at the same time; files that one batch of ingest_new takes.
WRITERS = 4
BATCH_FILES = 50_000


def ingest_fresh(spark: SparkSession, directory: str, root: str, tables: list[str] | None = None) -> None:
    """Full rebuild: every table is overwritten."""
    snaps = src.snapshots(src.read_files(spark, directory))
    write_table(src.runs_registry(snaps), root, "run_registry")
    write_table(split_blocks(snaps), root, "run_commands")
    fleet = Fleet(spark, snaps)
    for name in ("run_registry", "run_commands"):
        fleet.put(name, read_table(spark, root, name))

    def keep(name: str) -> None:
        df = fleet(name)
        write_table(df, root, name)
        fleet.put(name, read_table(spark, root, name, like=df))

    _each(keep, [n for n in EXTRACTIONS if tables is None or n in tables])
    for name in PER_RUN:
        if tables is None or name in tables:
            keep(name)
    refresh(spark, directory, root, tables)


def _each(fn, names: list[str]) -> None:
    """Independent writes side by side, so that small tables do not wait for each other."""
    with ThreadPoolExecutor(WRITERS) as pool:
        list(pool.map(fn, names))


def ingest_batch(spark: SparkSession, files: DataFrame, root: str, tables: list[str] | None = None) -> None:
    """Add (or re-add) the given files: the rows of their runs are replaced in every run table.

    The batch's blocks are written once, clustered by tag; extractions read their tags from that copy. Tables derived per run read the
    batch's rows of the tables before them. Call refresh() for the tables over all runs.
    """
    snaps = src.snapshots(files)
    scratch = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    write_table(src.runs_registry(snaps), scratch, "run_registry")
    write_table(split_blocks(snaps), scratch, "run_commands")
    runs = read_table(spark, scratch, "run_registry")
    dates = dates_of(runs)
    if not dates:
        return
    fleet = Fleet(spark, snaps)
    fleet.put("run_commands", read_table(spark, scratch, "run_commands"))
    fleet.put("run_registry", runs)
    replace_in_table(fleet("run_commands"), runs, root, "run_commands", dates)

    def add(name: str) -> None:
        df = fleet(name)
        replace_in_table(df, runs, root, name, dates)
        fleet.put(name, read_table(spark, root, name, dates, df).join(runs.select("run_id"), "run_id", "left_semi"))

    _each(add, [n for n in EXTRACTIONS if tables is None or n in tables])
    for name in PER_RUN:
        if tables is None or name in tables:
            add(name)
    # the registry goes last: a run is known only when all its rows are stored
    replace_in_table(runs, runs, root, "run_registry", dates)


def refresh(spark: SparkSession, directory: str, root: str, tables: list[str] | None = None) -> None:
    """Write the tables over all runs (identity, latest runs, current state) anew."""
    names = [n for n in OVERALL if tables is None or n in tables]
    if names:
        fleet = _opened(spark, directory, root, ["run_registry", "run_commands", *EXTRACTIONS, *PER_RUN], None)
        for name in names:
            df = fleet(name)
            write_table(df, root, name)
            fleet.put(name, read_table(spark, root, name, like=df))


def known_paths(spark: SparkSession, root: str) -> DataFrame:
    try:
        return read_table(spark, root, "run_registry").select("source_path")
    except AnalysisException as e:  # nothing stored yet
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "source_path string")


def ingest_new(spark: SparkSession, directory: str, root: str, tables: list[str] | None = None, batch_files: int = BATCH_FILES) -> dict[str, int]:
    """Ingest only files whose path is not in the registry yet; the store may be empty. Returns how many were new and how many skipped.

    Paths are compared first, without reading a file; the contents of new files are then read in batches.
    """
    paths = src.list_files(spark, directory)
    fresh = src.new_files(paths, known_paths(spark, root))
    total = paths.count()
    pending = f"{shared_folder(spark)}/pending-{uuid.uuid4().hex}"
    fresh.write.parquet(pending)
    left, new, last = spark.read.schema("path string").parquet(pending), 0, None
    while True:
        after = left if last is None else left.filter(F.col("path") > last)
        some = [r["path"] for r in after.orderBy("path").limit(batch_files).collect()]
        if not some:
            break
        ingest_batch(spark, src.load_files(spark, some), root, tables)
        new, last = new + len(some), some[-1]
    if new:
        refresh(spark, directory, root, tables)
    return {"new": new, "skipped": total - new}


def stream_ingest(spark: SparkSession, directory: str, root: str, checkpoint_dir: str, tables: list[str] | None = None):
    """Structured Streaming over the snapshot folder and those below it: process what is new, then stop.

    The file source remembers what it has read; a batch repeated after a failure
    replaces its own rows. Returns the streaming query.
    """
    files = (
        spark.readStream.options(**src.RAW_FS).format("binaryFile").schema(FILE_SCHEMA)
        .option("pathGlobFilter", C.SNAPSHOT_GLOB).option("recursiveFileLookup", "true").load(directory).select("path", "content", "length")
    )

    def write(batch: DataFrame, _batch_id: int) -> None:
        ingest_batch(batch.sparkSession, batch, root, tables)
        refresh(batch.sparkSession, directory, root, tables)

    return (
        files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True).start()
    )


def _opened(spark: SparkSession, directory: str, root: str, names: list[str], store: str | None) -> Fleet:
    fleet = Fleet(spark, src.snapshots(src.read_files(spark, directory)), store=store)
    for name in names:
        try:
            # the schema is that of the plan over the snapshots, so a table without rows can be read
            like = Fleet(spark, fleet.snapshots())(name) if name in EXTRACTIONS else None
            fleet.put(name, read_table(spark, root, name, like=like), stored=store is not None)
        except AnalysisException as e:  # a store that holds chosen tables only, or a derived table without rows
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    return fleet


def open_store(spark: SparkSession, directory: str, root: str) -> Fleet:
    """A Fleet over an ingested store: stored tables are read, the rest is derived."""
    return _opened(spark, directory, root, ["run_registry", "run_commands", *EXTRACTIONS, *PER_RUN, *OVERALL], root)
