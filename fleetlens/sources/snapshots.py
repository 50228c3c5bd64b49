"""Snapshot files -> `snapshots` and `runs`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.functions.scalars import let, snapshot_ip, snapshot_time
from fleetlens.functions.text import normalize_newlines

# Snapshot names contain ':'. Hadoop's checksummed local file system cannot build
# the side-file path for such names, the raw one can; other file systems ignore this.
RAW_FS = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def read_files(spark: SparkSession, directory: str) -> DataFrame:
    """`path`, `content`, `length` of every snapshot file below a directory (one row per file)."""
    return (
        spark.read.options(**RAW_FS)
        .format("binaryFile")
        .option("pathGlobFilter", C.SNAPSHOT_GLOB)
        .option("recursiveFileLookup", "true")
        .load(directory)
        .select("path", "content", "length")
    )


def list_files(spark: SparkSession, directory: str) -> DataFrame:
    """`path` of every snapshot file below a directory; no content is read."""
    return read_files(spark, directory).select("path")


def load_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """`path`, `content`, `length` of the given files."""
    return spark.read.options(**RAW_FS).format("binaryFile").load(paths).select("path", "content", "length")


def snapshots(files: DataFrame) -> DataFrame:
    """Decode files: invalid UTF-8 becomes U+FFFD, line ends become \\n, name gives address and time.

    run_id is `<yyyymmdd>-<MD5 of the path>`: stable across re-ingests and free of
    a global counter, 128 bits make accidental collisions negligible, and the date
    in front lets every table be partitioned by run date without a join.
    """
    return (
        files.select(
            F.concat_ws("-", F.date_format(snapshot_time("path"), "yyyyMMdd"), F.md5(F.col("path").cast("binary")))
            .alias("run_id"),
            F.col("path").alias("source_path"),
            snapshot_ip("path").alias("source_ip"),
            snapshot_time("path").alias("collected_at_utc"),
            F.sha2("content", 256).alias("source_sha256"),
            F.md5("content").alias("source_md5"),
            F.octet_length("content").cast("bigint").alias("size_bytes"),
            # behind an explode a text is decoded once, however often later steps refer to it
            F.explode(F.array(let(F.make_valid_utf8(F.col("content").cast("string")), normalize_newlines))).alias("text"),
        )
        .filter(F.col("source_ip").isNotNull() & F.col("collected_at_utc").isNotNull())
    )


def runs_registry(snaps: DataFrame) -> DataFrame:
    """One row per snapshot; the text column is pruned away."""
    return snaps.select(
        "run_id", "source_ip", "collected_at_utc", "source_path", "source_sha256", "source_md5", "size_bytes",
        F.lit(C.PARSER_VERSION).alias("parser_version"),
    )


def new_files(files: DataFrame, known_runs: DataFrame) -> DataFrame:
    """Files whose path is not registered yet. Spark broadcasts the registry if its size allows it."""
    return files.join(known_runs.select(F.col("source_path").alias("path")), "path", "left_anti")


def replace_runs(stored: DataFrame, fresh: DataFrame, fresh_runs: DataFrame) -> DataFrame:
    """Table after re-ingesting `fresh_runs`: their old rows go, the new ones come in."""
    return stored.join(fresh_runs.select("run_id").distinct(), "run_id", "left_anti").unionByName(
        fresh, allowMissingColumns=True
    )
