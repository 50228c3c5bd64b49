"""Inventory CSV files -> expected inventory and asset upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens import constants as C
from fleetlens.functions.text import blank_to_null, last_wins, strip


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Header CSV as text columns, numbered by position in the file so that "last row wins" is defined."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return (
        spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
        .withColumn("row_no", F.monotonically_increasing_id())
    )


def expected_inventory(rows: DataFrame) -> DataFrame:
    """Typed expected inventory: blanks and zeros are unknown (NULL), one row per hostname, last one wins."""

    def typed(name: str):
        text = strip(name)
        if name in C.INVENTORY_INTS:
            return F.nullif(text.try_cast("int"), F.lit(0)).alias(name)
        if name in C.INVENTORY_DOUBLES:
            return F.nullif(text.try_cast("double"), F.lit(0.0)).alias(name)
        return blank_to_null(text).alias(name)

    typed_rows = rows.select("row_no", *[typed(c) for c in C.INVENTORY_COLUMNS])
    return last_wins(typed_rows.filter("hostname IS NOT NULL"), ["hostname"], "row_no").drop("row_no")


def upsert_assets(assets: DataFrame, rows: DataFrame) -> DataFrame:
    """Assets and their inventory after an asset CSV: rows need an asset_id and a hostname, numbers may be `4.0`."""
    text = ["hostname", "domain", "fqdn", "classification", "location", "os_name", "os_version", "arch",
            "server_manufacturer", "server_model_series", "server_model_no",
            "proc_manufacturer", "proc_model_series", "proc_model_no",
            "gpu_manufacturer", "gpu_model_series", "gpu_model_no", "primary_ip", "interface", "mac_addr", "vlan"]
    # the CSV misspells two capacity columns
    doubles = {"memory_capacity_gb": "memory_capacity_gb", "storage_hdd_capacity_gb": "storage_hdd_capacity_gb",
               "storage_nvme_capacity_gb": "storage_nvme_capabity_gb",
               "storage_ssd_capacity_gb": "storage_ssd_capabity_gb"}
    present = set(rows.columns)
    incoming = rows.select(
        "row_no",
        strip("asset_id").alias("asset_id"),
        *[blank_to_null(strip(c)).alias(c) for c in text if c in present],
        *[strip(c).try_cast("double").cast("int").alias(c) for c in C.INVENTORY_INTS if c in present],
        *[strip(src).try_cast("double").alias(dst) for dst, src in doubles.items() if src in present],
    ).filter("asset_id IS NOT NULL AND asset_id <> '' AND hostname IS NOT NULL")
    incoming = last_wins(incoming, ["asset_id"], "row_no").drop("row_no")
    kept = assets.join(incoming.select("asset_id"), "asset_id", "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)
