"""Comparison of snapshots, block by block and line by line, for many run pairs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def consecutive_pairs(previous_runs: DataFrame) -> DataFrame:
    """(first_run, second_run) of every asset with at least two runs, from v_asset_previous_run."""
    return previous_runs.filter("previous_run_id IS NOT NULL").select(
        F.col("previous_run_id").alias("first_run"), F.col("last_run_id").alias("second_run"))


def _keyed(met: DataFrame, by: str) -> DataFrame:
    """Blocks of run pairs with their key: the position in the file, or the tag and its occurrence number, which survives inserted commands.

    Occurrences are counted where the blocks of a pair have met, so that takes no shuffle of its own.
    """
    if by == "position":
        return met.withColumn("block_key", F.col("command_index").cast("string"))
    w = Window.partitionBy("first_run", "second_run", "side_one", "command_tag").orderBy("command_index")
    return met.withColumn("block_key", F.concat_ws("#", "command_tag", F.dense_rank().over(w).cast("string")))


def diff_blocks(blocks: DataFrame, pairs: DataFrame, by: str = "position") -> DataFrame:
    """Per pair and block of the first run: same, changed, or missing in the second run.

    A digest stands for a block: the wide text stays out of joins. Rows are dealt out by pair once; keys and comparison follow from that.
    """
    sides = pairs.select("first_run", "second_run", F.explode(F.array(
        F.struct(F.col("first_run").alias("run_id"), F.lit(True).alias("is_first")),
        F.struct(F.col("second_run").alias("run_id"), F.lit(False).alias("is_first")))).alias("s")
    ).select("first_run", "second_run", "s.run_id", F.col("s.is_first").alias("side_one"))
    narrow = blocks.select(
        "run_id", "command_index", "command", *(["command_tag"] if by != "position" else []),
        F.unhex(F.sha2(F.concat_ws("\n", "command", "output_text"), 256)).alias("digest"))
    # both sides come from one scan of the blocks and meet in one aggregation
    one, two = F.col("side_one"), ~F.col("side_one")
    dealt = sides.join(narrow, "run_id").drop("run_id").withColumn("command", F.when(one, F.col("command"))).repartition("first_run", "second_run")
    met = _keyed(dealt, by).groupBy("first_run", "second_run", "block_key").agg(
        F.max(F.when(one, F.col("command_index"))).alias("command_index"), F.max(F.when(two, F.col("command_index"))).alias("second_index"),
        F.max("command").alias("command"), F.max(F.when(one, F.col("digest"))).alias("d1"), F.max(F.when(two, F.col("digest"))).alias("d2"))
    return met.filter("d1 IS NOT NULL").select(
        "first_run", "second_run", "block_key", "command_index", "second_index", "command",
        F.when(F.col("d2").isNull(), "missing").when(F.col("d1") == F.col("d2"), "same").otherwise("changed").alias("status"))


def diff_lines(blocks: DataFrame, pairs: DataFrame, by: str = "position") -> DataFrame:
    """Lines added to or removed from the changed blocks, with how often.

    Only changed blocks are exploded, after both texts of a block have met: texts are shuffled, lines are not. Each line counts +1 for the
    second run and -1 for the first, so one aggregation gives the multiset difference in both directions.
    """
    changed = diff_blocks(blocks, pairs, by).filter("status = 'changed'")
    sides = changed.select("first_run", "second_run", "block_key", "command", F.explode(F.array(
        F.struct(F.col("first_run").alias("run_id"), F.col("command_index").alias("command_index"), F.lit(-1).alias("sign")),
        F.struct(F.col("second_run").alias("run_id"), F.col("second_index").alias("command_index"), F.lit(1).alias("sign")))).alias("s")
    ).select("first_run", "second_run", "block_key", "command", "s.run_id", "s.command_index", "s.sign")
    text = blocks.select("run_id", "command_index", "output_text")
    dealt = sides.join(text, ["run_id", "command_index"]).drop("run_id", "command_index").repartition("first_run", "second_run", "block_key")
    lines = dealt.select("first_run", "second_run", "block_key", "command", "sign", F.explode(F.split("output_text", "\n")).alias("line"))
    net = lines.groupBy("first_run", "second_run", "block_key", "command", "line").agg(F.sum("sign").alias("net"))
    return net.filter("net <> 0").select(
        "first_run", "second_run", "block_key", "command", "line",
        F.when(F.col("net") > 0, "added").otherwise("removed").alias("change_type"), F.abs("net").alias("copies"))


def diff_text(blocks: DataFrame, pairs: DataFrame, by: str = "position") -> DataFrame:
    """The differing lines of each changed block as text: a header, then removed lines and added lines in the order of their texts.

    Lines are compared as bags, as in diff_lines; a line that only moved does not differ.
    """
    changed = diff_lines(blocks, pairs, by)
    entry = F.struct((F.col("change_type") == "added").alias("added"), "line", "copies")
    texts = changed.groupBy("first_run", "second_run", "block_key", "command").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    shown = lambda e: F.concat(F.when(e["added"], "\n+").otherwise("\n-"), e["line"])
    body = F.array_join(F.transform("entries", lambda e: F.repeat(shown(e), e["copies"].cast("int"))), "")
    return texts.select("first_run", "second_run", "block_key", "command", F.concat(F.lit("--- \n+++ "), body).alias("diff"))


def diff_summary(blocks: DataFrame, runs: DataFrame, pairs: DataFrame, by: str = "position") -> DataFrame:
    """Header of a comparison (address, time, size and MD5 of both files) and the commands that differ."""
    compared = diff_blocks(blocks, pairs, by)
    label = F.when(F.col("status") == "missing", F.concat("command", F.lit(" (missing in second)"))).otherwise(F.col("command"))
    differing = F.when(F.col("status") != "same", F.struct("command_index", label.alias("label")))
    lists = compared.groupBy("first_run", "second_run").agg(
        F.count_if(F.col("status") != "same").alias("changed_count"), F.array_sort(F.collect_list(differing)).alias("c"))
    side = lambda n: runs.select(F.col("run_id").alias(f"{n}_run"), F.col("source_ip").alias(f"{n}_ip"),
                                 F.col("collected_at_utc").alias(f"{n}_collected_at"), F.col("size_bytes").alias(f"{n}_size"),
                                 F.col("source_md5").alias(f"{n}_md5"))
    return lists.join(side("first"), "first_run").join(side("second"), "second_run").withColumn(
        "changed_commands", F.transform("c", lambda x: x["label"])).drop("c")
