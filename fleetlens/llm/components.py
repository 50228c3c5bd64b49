"""Connected components of links, on Spark from end to end: only one count a round reaches the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import salts, stored

#: A vertex with very many links is dealt out over so many tasks.
SALTS = 8


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, smallest vertex it reaches) for every vertex but the smallest of each component of the links a-b."""
    if not len(a):
        return a, b
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for ends in (label[x], label[y], x, y):
            np.minimum.at(new, ends, low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    some = label != np.arange(len(ids))
    return ids[some], ids[label[some]]


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) of every id in links (a long, b long): component is the smallest id it reaches.

    Each round takes the smallest label among the neighbours, then follows labels of labels, so that long chains shrink fast. Links
    to a hub are salted. Self links, repeated links and an empty table are fine; links with a null end are ignored.
    """
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    both = links.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(links.select(F.col("b").alias("src"), F.col("a").alias("dst"))).distinct()
    both = stored(both.withColumn("salt", F.pmod(F.xxhash64("src"), F.lit(SALTS)).cast("int")), f"{name}-links")
    labels = stored(both.groupBy("src").agg(F.min("dst").alias("low")).select(F.col("src").alias("id"), F.least("src", "low").alias("component")), f"{name}-0")
    round_no = 0
    while True:
        round_no += 1
        far = labels.select(F.col("id").alias("dst"), F.col("component").alias("far"), F.explode(salts(SALTS)).alias("salt"))
        near = both.join(far, ["dst", "salt"]).groupBy("src").agg(F.min("far").alias("far"))
        hooked = labels.join(near.withColumnRenamed("src", "id"), "id", "left").select("id", F.col("component").alias("was"), F.least("component", "far").alias("component"))
        hooked = stored(hooked.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")), f"{name}-{round_no}h")
        up = hooked.select(F.col("id").alias("component"), F.col("component").alias("top"), F.explode(salts(SALTS)).alias("salt"))
        labels = stored(hooked.join(up, ["component", "salt"]).select("id", "was", F.col("top").alias("component")), f"{name}-{round_no}")
        if not labels.filter("component <> was").limit(1).count():
            return labels.select("id", "component")
        labels = labels.select("id", "component")
