"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one step inside a task holds at a time; a longer text makes a step of its own.
STEP_CHARS = 4_000_000


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, the folder that driver and executors share."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        top = spark.sparkContext.getCheckpointDir()
    if not top:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="llm-")  # one machine is all there is
        spark.sparkContext.setCheckpointDir(top)
    return os.path.join(top, f"{name}-{uuid.uuid4().hex[:12]}")


def stored(df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there, and lost executors lose nothing. file_rows: as many rows in a file at most, for
    wide rows, since Spark reads and writes some thousand rows at a time."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_bucket(col: str, of: int) -> Column:
    """crc32 of the id as text, modulo `of`; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % F.lit(of)


def steps(batches: Iterator[pa.RecordBatch], text: str, limit: int = STEP_CHARS) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose texts have about `limit` bytes at most (one row at least)."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if total and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < batch.num_rows:
            yield batch.slice(start)


def salts(n: int) -> Column:
    """An array 0..n-1, to explode the small side of a salted join."""
    return F.array(*[F.lit(i) for i in range(n)])




def salted_join(large: DataFrame, small: DataFrame, keys: list[str], spread_by: str, how: str = "inner", n: int = 16) -> DataFrame:
    """Equi-join in which each key's rows of `large` are dealt over n tasks by the column spread_by, and the rows of `small` are repeated n times."""
    left = large.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(n)).cast("int"))
    right = small.withColumn("_salt", F.explode(salts(n)))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
