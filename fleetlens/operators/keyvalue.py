"""Extraction of key/value outputs and of the one-row-per-run tables pivoted from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.functions.scalars import dmi_value, human_size_to_bytes
from fleetlens.functions.text import (
    RUN_COLS, at, blank_to_null, block, extract, first_line, keyed_lines, last_wins, lines, literal_map, pair_key, split_pair,
    strip, tokens, word_key,
)


def kv_table(rows: DataFrame) -> DataFrame:
    return last_wins(rows, ["run_id", "k"]).select("run_id", "k", "v")


def word_pairs(rows: DataFrame) -> DataFrame:
    """`KEY rest of line`; a key without a value gets an empty one."""
    parts = F.split("line", r"\s+", 2)
    return rows.select(*RUN_COLS, "line_no", at(parts, 0).alias("k"), F.coalesce(at(parts, 1), F.lit("")).alias("v"))


def pivot_keys(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row per run with named keys as columns; the last line of a key wins.

    A plain hash aggregation: partial results are combined before the shuffle.
    """
    by_line = lambda key: F.max_by(F.when(F.col("k") == key, F.col("v")), F.when(F.col("k") == key, F.col("line_no")))
    return rows.groupBy("run_id").agg(*[by_line(key).alias(name) for name, key in columns.items()])


def colon_pairs(blocks: DataFrame, *tags: str) -> DataFrame:
    return split_pair(lines(block(blocks, *tags)), ":")


# ---- key/value tables -----------------------------------------------------------------------------------

def run_os_release_kv(blocks: DataFrame) -> DataFrame:
    rows = split_pair(keyed_lines(block(blocks, "etc_release"), pair_key("=")), "=")
    return rows.select("run_id", "k", F.btrim("v", F.lit('"')).alias("v"))


def run_kernel_cmdline_kv(blocks: DataFrame) -> DataFrame:
    text = strip(first_line(F.btrim("output_text", F.lit(" \t\n"))))
    words = (
        block(blocks, "proc_cmdline")
        .select(*RUN_COLS, F.posexplode(F.split(text, r"\s+")).alias("line_no", "word"))
        .filter("word <> ''")
    )
    eq = F.instr("word", "=")
    rows = words.select(
        *RUN_COLS, "line_no",
        F.when(eq > 0, F.substr("word", F.lit(1), eq - 1)).otherwise(F.col("word")).alias("k"),
        F.when(eq > 0, F.substr("word", eq + 1)).otherwise("1").alias("v"),
    ).filter("k <> ''")
    return kv_table(rows)


def run_sysctl_kv(blocks: DataFrame) -> DataFrame:
    return split_pair(keyed_lines(block(blocks, "sysctl_hardening"), pair_key("=")), "=").select("run_id", "k", "v")


def run_audit_status(blocks: DataFrame) -> DataFrame:
    key = lambda l: F.when(F.size(tokens(l)) > 1, at(tokens(l), 0))
    return word_pairs(keyed_lines(block(blocks, "auditctl_s"), key)).select("run_id", "k", "v")


def run_login_defs_kv(blocks: DataFrame) -> DataFrame:
    return word_pairs(keyed_lines(block(blocks, "login_defs"), word_key)).select("run_id", "k", "v")


def run_sshd_config_kv(blocks: DataFrame) -> DataFrame:
    return word_pairs(keyed_lines(block(blocks, "sshd_T"), word_key)).select("run_id", "k", "v")


def run_selinux_status(blocks: DataFrame) -> DataFrame:
    return split_pair(keyed_lines(block(blocks, "sestatus"), pair_key(":")), ":").select("run_id", "k", "v")


def run_selinux_booleans(blocks: DataFrame) -> DataFrame:
    key = lambda l: F.when(l.rlike(r"-->\s*\S"), pair_key("-->")(l))
    rows = split_pair(keyed_lines(block(blocks, "getsebool_a"), key), "-->")
    return rows.select("run_id", F.col("k").alias("boolean_name"), F.lower(at(tokens("v"), 0)).alias("state"))


# ---- one row per run --------------------------------------------------------------------------------------

HOSTINFO_KEYS = {
    "static_hostname": "Static hostname", "icon_name": "Icon name", "chassis": "Chassis",
    "machine_id": "Machine ID", "boot_id": "Boot ID", "operating_system": "Operating System",
    "kernel": "Kernel", "architecture": "Architecture",
    "hardware_vendor": "Hardware Vendor", "hardware_model": "Hardware Model",
}
RELEASE_KEYS = {
    "name": "NAME", "distrib_id": "DISTRIB_ID", "version_id": "VERSION_ID",
    "distrib_release": "DISTRIB_RELEASE", "version": "VERSION", "id": "ID",
}


def run_hostinfo(blocks: DataFrame) -> DataFrame:
    """hostnamectl fields plus distribution name, version and id from the release files.

    Both outputs feed one aggregation by run; there is no join.
    """
    host = colon_pairs(blocks, "hostnamectl").select(*RUN_COLS, "line_no", F.concat(F.lit("h:"), "k").alias("k"), "v")
    release = split_pair(lines(block(blocks, "etc_release")), "=").select(
        *RUN_COLS, "line_no", F.concat(F.lit("r:"), "k").alias("k"), F.btrim("v", F.lit('"')).alias("v"))
    keys = {n: "h:" + k for n, k in HOSTINFO_KEYS.items()} | {"_" + n: "r:" + k for n, k in RELEASE_KEYS.items()}
    rows = host.unionByName(release).withColumn("v", F.col("v"))
    wide = rows.groupBy("run_id").agg(
        F.bool_or(F.col("k").startswith("h:")).alias("_host"),
        *[F.max_by(F.when(F.col("k") == key, F.col("v")), F.when(F.col("k") == key, F.col("line_no"))).alias(n)
          for n, key in keys.items()],
    ).filter("_host")
    first_of = lambda *names: F.coalesce(*[blank_to_null(n) for n in names])
    return wide.select(
        "run_id", "static_hostname", "icon_name", "chassis", "machine_id", "boot_id", "operating_system",
        first_of("_name", "_distrib_id").alias("os_name"),
        first_of("_version_id", "_distrib_release", "_version").alias("os_version"),
        first_of("_id", "_distrib_id").alias("os_id"),
        "kernel", "architecture", "hardware_vendor", "hardware_model",
    )


def asset_domain(blocks: DataFrame) -> DataFrame:
    """fqdn and domain per run: an explicit field, else a dotted static or transient hostname."""
    wide = pivot_keys(colon_pairs(blocks, "hostnamectl"), {
        "static": "Static hostname", "transient": "Transient hostname",
        "f1": "FQDN", "f2": "DNS Domain", "f3": "Domain"})
    dotted = lambda c: F.when(F.contains(F.col(c), F.lit(".")), F.col(c))
    fqdn = F.coalesce(blank_to_null("f1"), blank_to_null("f2"), blank_to_null("f3"), dotted("static"), dotted("transient"))
    named = wide.select("run_id", fqdn.alias("fqdn"))
    dot = F.instr("fqdn", ".")
    return named.select(
        "run_id", "fqdn", F.when(dot > 0, strip(F.substr("fqdn", dot + 1))).alias("domain")
    ).filter("fqdn IS NOT NULL")


def run_secure_boot(blocks: DataFrame) -> DataFrame:
    """1 / 0, or NULL when the state is unknown."""
    t = F.lower("output_text")
    said = lambda word: t.rlike(rf"secure ?boot {word}")
    return block(blocks, "mokutil_sb_state").select(
        "run_id",
        F.when(said("enabled"), 1).when(said("disabled"), 0).alias("secure_boot_enabled"),
        F.btrim("output_text", F.lit(" \t\n")).alias("raw_text"),
    )


def run_uname(blocks: DataFrame) -> DataFrame:
    return block(blocks, "uname_a").select("run_id", F.btrim("output_text", F.lit(" \t\n")).alias("uname_a"))


def run_timedate(blocks: DataFrame) -> DataFrame:
    return pivot_keys(colon_pairs(blocks, "timedatectl"), {
        "local_time": "Local time", "universal_time": "Universal time", "rtc_time": "RTC time",
        "time_zone": "Time zone", "system_clock_synchronized": "System clock synchronized",
        "ntp_service": "NTP service", "rtc_in_local_tz": "RTC in local TZ"})


def run_uptime(blocks: DataFrame) -> DataFrame:
    line = strip(first_line(F.btrim("output_text", F.lit(" \t\n"))))
    loads = F.split(F.regexp_extract(line, r"load average:\s*(.*)$", 1), r"\s*,\s*")
    values = [at(loads, i).try_cast("double") for i in range(3)]
    complete = values[0].isNotNull() & values[1].isNotNull() & values[2].isNotNull()
    return block(blocks, "uptime").select(
        "run_id", line.alias("raw_line"),
        *[F.when(complete, v).alias(n) for v, n in zip(values, ["load_1", "load_5", "load_15"])],
    )


def run_memory(blocks: DataFrame) -> DataFrame:
    words = tokens("line")
    size = lambda i: human_size_to_bytes(at(words, i))
    mem = F.col("line").startswith("Mem:") & (F.size(words) >= 7)
    swap = F.col("line").startswith("Swap:") & (F.size(words) >= 4)
    fields = {
        "mem_total_bytes": (mem, 1), "mem_used_bytes": (mem, 2), "mem_free_bytes": (mem, 3),
        "mem_available_bytes": (mem, 6),
        "swap_total_bytes": (swap, 1), "swap_used_bytes": (swap, 2), "swap_free_bytes": (swap, 3),
    }
    rows = lines(block(blocks, "free_h"))
    return rows.groupBy("run_id").agg(
        *[F.max_by(size(i), F.when(kind, F.col("line_no"))).alias(n) for n, (kind, i) in fields.items()])


def run_nmcli_summary(blocks: DataFrame) -> DataFrame:
    """The line under the STATE/CONNECTIVITY header, by column."""
    below = F.regexp_extract("output_text", r"(?m)^[ \t]*STATE[^\n]*CONNECTIVITY[^\n]*\n+([^\n]*\S)", 1)
    words = F.when(below != "", tokens(below))
    names = ["state", "connectivity", "wifi_hw", "wifi", "wwan_hw", "wwan"]
    return block(blocks, "nmcli").select(
        "run_id", *[at(words, i).alias(n) for i, n in enumerate(names)],
        F.btrim("output_text", F.lit(" \t\n")).alias("raw_text"))


def run_dmi_system(blocks: DataFrame) -> DataFrame:
    """Identity fields of the first System Information section; vendor placeholders are dropped."""
    section = F.regexp_extract("output_text", r"(?ms)^\s*System Information\s*?\n(.*?)(?=^Handle |\z)", 1)
    pairs = split_pair(lines(block(blocks, "dmidecode").withColumn("section_text", section), "section_text"), ":")
    known = pairs.withColumn("v", dmi_value("k", "v")).filter("v IS NOT NULL")
    return pivot_keys(known, {
        "manufacturer": "Manufacturer", "product_name": "Product Name", "version": "Version",
        "serial_number": "Serial Number", "uuid": "UUID", "sku_number": "SKU Number", "family": "Family"})


def run_apparmor_status(blocks: DataFrame) -> DataFrame:
    raw = F.btrim("output_text", F.lit(" \t\n"))
    count = lambda phrase: extract(raw, rf"(?i)(\d+)\s+{phrase}").try_cast("int")
    return block(blocks, "aa_status").select(
        "run_id", raw.alias("raw_text"),
        count("profiles are loaded").alias("profiles_loaded"),
        count("profiles are in enforce mode").alias("profiles_enforce"),
        count("profiles are in complain mode").alias("profiles_complain"),
        count("processes are in enforce mode").alias("processes_enforce"),
        count("processes are in complain mode").alias("processes_complain"),
    )


def run_nft_ruleset(blocks: DataFrame) -> DataFrame:
    return block(blocks, "nft_ruleset").select("run_id", F.col("output_text").alias("raw_text"))


def run_auth_log_stats(blocks: DataFrame) -> DataFrame:
    """Phrase counts per log; the text is scanned in place, not exploded."""
    count = lambda phrase: F.regexp_count("output_text", F.lit(rf"(?i)\b{phrase}\b"))
    source = literal_map(C.AUTH_LOG_SOURCES)
    return block(blocks, *C.AUTH_LOG_SOURCES).select(
        "run_id", F.try_element_at(source, F.col("command_tag")).alias("source"),
        *[count(phrase).alias(n) for n, phrase in C.AUTH_LOG_PHRASES.items()],
        F.regexp_count("output_text", F.lit(r"(?m)^.*\S.*$")).alias("raw_line_count"),
    )


# ---- facts ------------------------------------------------------------------------------------------------

def _fact(rows: DataFrame, group: str, key: Column | str, value: Column | str) -> DataFrame:
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return rows.select("run_id", F.lit(group).alias("fact_group"), as_col(key).alias("fact_key"), as_col(value).alias("fact_value"))


def fact_rsyslog(blocks: DataFrame) -> DataFrame:
    """Remote log destinations in order of appearance, without repeats; `[]` when there are none.

    Comment lines are cut out of the text, so the array never leaves its row.
    """
    active = F.regexp_replace("output_text", r"(?m)^[ \t]*#[^\n]*$", "")
    found = F.regexp_extract_all(active, F.lit(r"[*.]+[ \t]+(@@?\[[^\]\n]+\](?::\d+)?|@@?[^\s#]+)"), F.lit(1))
    return _fact(block(blocks, "rsyslog_conf"), "rsyslog", F.lit("remote_destinations"),
                 F.regexp_replace(F.to_json(F.array_distinct(found)), '","', '", "'))


def fact_journald(blocks: DataFrame) -> DataFrame:
    """Forwarding and audit keys of the [Journal] section, commented defaults included."""
    section = (
        block(blocks, "journald_conf")
        .select(*RUN_COLS, F.posexplode(F.split("output_text", r"(?m)^(?=[ \t]*\[)")).alias("chunk_no", "chunk"))
        .filter(strip(first_line("chunk")) == "[Journal]")
    )
    rows = lines(section, "chunk", keep=("chunk_no",)).withColumn(
        "line", strip(F.regexp_replace("line", r"^#+", "")))
    pairs = split_pair(rows, "=", keep=("chunk_no", "line_no")).filter(F.col("k").rlike("Forward|Remote|Syslog|Audit"))
    kept = last_wins(pairs.withColumn("ord", F.struct("chunk_no", "line_no")), ["run_id", "k"], "ord")
    return _fact(kept, "journald", "k", "v")


def sudo_rule_lines(blocks: DataFrame) -> DataFrame:
    return lines(block(blocks, "sudoers", "sudoers_d_cat")).filter(
        ~F.col("line").startswith("#") & ~F.col("line").startswith("cat: ") & ~F.contains("line", F.lit("No such file")))


def run_facts(blocks: DataFrame) -> DataFrame:
    host = split_pair(keyed_lines(block(blocks, "hostnamectl"), pair_key(":")), ":").filter("k IN ('Operating System', 'Kernel') AND v <> ''")
    os_facts = _fact(host, "os", F.lower(F.regexp_replace("k", " ", "_")), "v")
    boot = _fact(run_kernel_cmdline_kv(blocks).filter(F.col("k").isin(C.BOOT_FACT_KEYS)), "boot", "k", "v")
    sshd = _fact(run_sshd_config_kv(blocks).filter(F.col("k").isin(C.SSHD_FACT_KEYS)), "sshd", "k", "v")
    counts = sudo_rule_lines(blocks).groupBy("run_id").agg(
        F.count_if(F.contains(F.lower("line"), F.lit("nopasswd"))).cast("string").alias("nopasswd_rule_count"),
        F.count_if(F.col("line").rlike(r"ALL ?= ?\(ALL") & (F.contains("line", F.lit("ALL=(ALL")) | F.contains("line", F.lit("ALL = (ALL"))))
        .cast("string").alias("all_all_rule_count"),
    )
    sudo = counts.unpivot("run_id", ["nopasswd_rule_count", "all_all_rule_count"], "fact_key", "fact_value").select(
        "run_id", F.lit("sudo").alias("fact_group"), "fact_key", "fact_value")
    nft = _fact(block(blocks, "nft_ruleset"), "firewall", F.lit("nft_has_table"),
                F.col("output_text").rlike(r"(?m)^\s*table\s").cast("int").cast("string"))
    out = os_facts
    for part in (boot, sshd, sudo, fact_rsyslog(blocks), fact_journald(blocks), nft):
        out = out.unionByName(part)
    return out
