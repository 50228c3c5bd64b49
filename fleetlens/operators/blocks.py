"""Snapshot text -> command blocks: split, section, tag, first-per-tag. Map-only: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.functions.scalars import zone_name
from fleetlens.functions.text import literal_map, RUN_COLS, at, blank_to_null, col, strip


def command_tag(command: Column | str) -> Column:
    """Stable tag of a command line: exact name, loop prefix, or a slug of the text.

    The name table has a fixed size, so it is a literal map in the projection
    rather than a join.
    """
    c = strip(command)
    names = literal_map(C.COMMAND_TAGS)
    loops = F.lit(None).cast("string")
    for prefix, word, tag in reversed(C.LOOP_COMMAND_TAGS):
        hit = c.startswith(prefix)
        if word:
            hit = hit & F.contains(c, F.lit(word))
        loops = F.when(hit, tag).otherwise(loops)
    slug = F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))
    short = F.concat_ws("_", F.substring(slug, 1, C.SLUG_LENGTH), F.substring(F.md5(slug.cast("binary")), 1, 16))
    slug = F.coalesce(blank_to_null(F.when(F.length(slug) > C.SLUG_LENGTH, short).otherwise(slug)), F.lit("unknown"))
    return F.coalesce(F.try_element_at(names, c), loops, slug)


_MARK = "\x1e"


def split_blocks(snaps: DataFrame) -> DataFrame:
    """One row per command block, with the section it started in.

    Everything happens inside the row of its file (split, section lookup, tag,
    first-per-tag), so a block keeps its position without a window or a shuffle.
    Only small per-file arrays (tags, section headers) travel through the
    explode. The same pass notes the host time zone, which later jobs need next
    to every line.
    """
    # a byte search finds the commands; the mark is a line break that normalized text does not have
    marked = F.replace(F.col("text"), F.lit("\n$ "), F.lit(f"\n{_MARK}$ "))
    pieces = snaps.select("run_id", "source_ip", "collected_at_utc", F.split(marked, _MARK).alias("pieces"))
    command_of = lambda p: strip(F.substr(F.substring_index(p, "\n", 1), F.lit(3)))
    clean = lambda h: strip(F.regexp_replace(F.regexp_replace(h, r"\*", " "), r"\s+", " "))
    starred = lambda p: F.contains(p, F.lit("*****"))
    header_names = lambda p: F.filter(
        F.transform(F.regexp_extract_all(p, F.lit(rf"(?m)^({C.SECTION_HEADER})$"), F.lit(1)), clean), lambda h: h != ""
    )
    # A chrony file that could not be read must not hide the one at the other path,
    # so it competes under another name.
    unread = lambda p: p.startswith("$ cat /etc/chrony") & ~p.rlike(r"(?m)^\s*(?:server|pool)\s+\S")
    indexed = pieces.select(
        "run_id", "source_ip", "collected_at_utc", "pieces",
        F.transform(
            "pieces",
            lambda p: F.when(
                p.startswith("$ "), F.concat(command_tag(command_of(p)), F.when(unread(p), " unread").otherwise(""))
            ),
        ).alias("tags"),
        F.filter(
            F.transform(
                "pieces", lambda p, i: F.struct(
                    i.alias("i"), F.when(starred(p), F.try_element_at(header_names(p), F.lit(-1))).alias("name"))
            ),
            lambda h: h["name"].isNotNull(),
        ).alias("headers"),
    )
    zoned = indexed.select(
        "run_id", "source_ip", "collected_at_utc", "pieces", "tags", "headers",
        zone_name(
            F.regexp_extract(
                at(F.col("pieces"), (F.array_position("tags", F.lit("timedatectl")) - 1).cast("int")),
                r"(?m)^\s*Time zone:\s*(\S+)", 1,
            )
        ).alias("host_zone"),
        F.when(at(F.col("pieces"), 0).startswith("$ "), 0).otherwise(1).alias("preamble"),
    )
    exploded = zoned.select(
        *RUN_COLS, "tags", "headers", "preamble", F.posexplode("pieces").alias("pos", "piece")
    ).filter(F.col("piece").startswith("$ "))
    tag = at(F.col("tags"), F.col("pos"))
    # byte searches decide whether the text has to go through a regex
    first_break = F.instr("piece", "\n")
    body = F.when(first_break > 0, F.substr("piece", first_break + 1)).otherwise("")
    ruled = starred(F.col("piece")) | F.contains("piece", F.lit("\n="))
    body = F.when(ruled, F.regexp_replace(body, rf"(?m)^(?:{C.SECTION_HEADER}|=+)(?:\n|\z)", "")).otherwise(body)
    section = F.try_element_at(F.filter("headers", lambda h: h["i"] < F.col("pos")), F.lit(-1))["name"]
    # filters on the output stay behind the explode, those on tags go before it: a text is cleaned once, and only if its tag is wanted
    return exploded.select(
        *RUN_COLS,
        F.coalesce(section, F.lit(C.INITIAL_SECTION)).alias("section"),
        (F.col("pos") - F.col("preamble")).alias("command_index"),
        command_of(F.col("piece")).alias("command"),
        F.substring_index(tag, " ", 1).alias("command_tag"),
        F.explode(F.array(F.btrim(body, F.lit("\n")))).alias("output_text"),
        ((F.array_position("tags", tag) == F.col("pos") + 1) & ~tag.endswith(" unread")).alias("is_first"),
    )


def command_catalog(blocks: DataFrame, parsed_tags: list[str], overrides: DataFrame | None = None) -> DataFrame:
    """One row per tag: its latest section and command, descriptions, sensitivity and parse status.

    `overrides` (command_tag, short_desc, long_desc) replaces the generic texts.
    """
    seen_at = F.struct("collected_at_utc", "run_id", "command_index")
    cat = blocks.groupBy("command_tag").agg(
        F.max_by("section", seen_at).alias("section"), F.max_by("command", seen_at).alias("command")
    )
    short = F.concat(F.lit("Output of: "), F.col("command"))
    long = F.concat(F.lit("Raw output of `"), F.col("command"), F.lit("`, kept losslessly in run_commands."))
    if overrides is not None:
        o = overrides.select("command_tag", F.col("short_desc").alias("_s"), F.col("long_desc").alias("_l"))
        cat = cat.join(o, "command_tag", "left")
        short, long = F.coalesce("_s", short), F.coalesce("_l", long)
    return cat.select(
        "command_tag", "section", "command", short.alias("short_desc"), long.alias("long_desc"),
        F.when(F.col("command_tag").isin(C.SENSITIVE_TAGS), "sensitive").otherwise("normal").alias("data_sensitivity"),
        F.when(F.col("command_tag").isin(parsed_tags), "parsed").otherwise("raw").alias("parse_status"),
    )
