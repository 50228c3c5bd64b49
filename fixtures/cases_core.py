"""Cases for sources, sinks, incremental ingest, block splitting and the scalar rules."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixtures.cases import CASES, DUCK, FACTS, Case, R, case, iso, plain, union, utc
from fixtures.cases_fleet import FILE_TEXT, report_sql  # noqa: F401
from fixtures.facts import Dialect, div, i, s, with_facts
from fixtures.render import dialect, fleet, rendered
from fleetlens.constants import INVENTORY_COLUMNS
from fleetlens.functions import scalars as S
from fleetlens.operators.blocks import command_catalog, split_blocks
from fleetlens.plans import report
from fleetlens.plans.fleet import PARSED_TAGS
from fleetlens.sources import inventory, snapshots as src
from fleetlens.sources.warehouse import read_table, shared_folder, write_table
from fleetlens.streaming import ingest

_folders: dict[tuple, str] = {}


def folder(spark: SparkSession, what: str) -> str:
    """A fresh folder below the shared one."""
    key = (spark.sparkContext.applicationId, what)
    _folders[key] = f"{shared_folder(spark)}/{what}-{spark.sparkContext.applicationId}-{len(_folders)}"
    return _folders[key]


FILE_TAGS = ("uname_a", "priv_groups")


def snapshot_folder(spark: SparkSession, sf_dir: str) -> str:
    """Rendered snapshots as real files with ':' in their names, written by the tasks into the shared folder."""
    key = (spark.sparkContext.applicationId, "files:" + sf_dir)
    if key not in _folders:
        target = folder(spark, "snapshots").removeprefix("file:")

        def write(rows) -> None:
            os.makedirs(target, exist_ok=True)
            for row in rows:
                with open(os.path.join(target, row.path.rsplit("/", 1)[1]), "wb") as f:
                    f.write(row.content)

        rendered(spark, sf_dir, FILE_TAGS).foreachPartition(write)
        _folders[key] = target
    return _folders[key]


def core(name: str, fn, sql: str | None) -> None:
    CASES[name] = Case(lambda spark, sf_dir: plain(fn(utc(spark), sf_dir)), None if sql is None else with_facts(sql, FACTS))


def _snaps(spark: SparkSession, sf_dir: str, tags=FILE_TAGS) -> DataFrame:
    return src.snapshots(rendered(spark, sf_dir, tuple(tags)))


# ---- 2.1 sources, sinks, registry -------------------------------------------------------------------------

core("src_snapshots", lambda spark, d: src.snapshots(src.read_files(spark, snapshot_folder(spark, d))).select(
        F.substring_index("source_path", "/", -1).alias("file_name"), "source_ip", "collected_at_utc", F.md5(F.col("text").cast("binary")).alias("text_md5")),
     f"SELECT list_extract(string_split(path, '/'), -1) AS file_name, ip AS source_ip, {iso('ts')} AS collected_at_utc, md5(text) AS text_md5 FROM fx_ftext")
core("src_hash", lambda spark, d: _snaps(spark, d).select("run_id", "source_sha256"), "SELECT run_id, sha256(text) AS source_sha256 FROM fx_ftext")
core("runs_registry", lambda spark, d: src.runs_registry(_snaps(spark, d)),
     f"SELECT run_id, ip AS source_ip, {iso('ts')} AS collected_at_utc, path AS source_path, sha256(text) AS source_sha256, md5(text) AS source_md5, strlen(text) AS size_bytes, '1.0.0' AS parser_version FROM fx_ftext")


def _incremental(spark: SparkSession, d: str) -> DataFrame:
    files = rendered(spark, d, FILE_TAGS)
    known = src.runs_registry(src.snapshots(files)).filter("collected_at_utc < '2024-02-15'")
    return src.new_files(files, known).select(F.col("path").alias("source_path"))


core("ingest_incremental", _incremental, "SELECT path AS source_path FROM fx_runs WHERE ts >= TIMESTAMP '2024-02-15 00:00:00'")


def _replace(spark: SparkSession, d: str) -> DataFrame:
    f = fleet(spark, d, stored=False)
    users = f("run_users")
    late = src.runs_registry(f.snapshots()).filter("collected_at_utc >= '2024-02-15'")
    fresh = users.join(late.select("run_id"), "run_id", "left_semi").withColumn("batch", F.lit("new"))
    return src.replace_runs(users.withColumn("batch", F.lit("old")), fresh, late).groupBy("run_id", "batch").agg(F.count(F.lit(1)).alias("users"))


core("ingest_replace", _replace, f"SELECT x.run_id, CASE WHEN x.r = 2 THEN 'new' ELSE 'old' END AS batch, count(*) AS users FROM {R('fx_users')} GROUP BY 1, 2")
UNAMES = f"SELECT strftime(ts, '%Y%m%d') AS run_date, 'Linux n 5.' || {s('nation')} || '.' || {s('r')} || ' #1 SMP x86_64 GNU/Linux' AS uname_a FROM fx_runs"


def _dated(spark: SparkSession, root: str, name: str) -> DataFrame:
    return read_table(spark, root, name).select(F.substring("run_id", 1, 8).alias("run_date"), "uname_a")


def _fresh(spark: SparkSession, d: str) -> DataFrame:
    root = folder(spark, "fresh")
    ingest.ingest_fresh(spark, snapshot_folder(spark, d), root, ["run_uname"])
    return _dated(spark, root, "run_uname")


def _stream(spark: SparkSession, d: str) -> DataFrame:
    root = folder(spark, "stream")
    ingest.stream_ingest(spark, snapshot_folder(spark, d), root, root + "-progress", ["run_uname"]).awaitTermination()
    return _dated(spark, root, "run_uname")


def _again(spark: SparkSession, d: str) -> DataFrame:
    """Two overlapping batches: the store ends up as after one."""
    root = folder(spark, "batches")
    files = rendered(spark, d, FILE_TAGS)
    ingest.ingest_batch(spark, files.filter(~F.contains("path", F.lit("_20240215_"))), root, ["run_uname"])
    ingest.ingest_batch(spark, files.filter(~F.contains("path", F.lit("_20240201_"))), root, ["run_uname"])
    return _dated(spark, root, "run_uname")


core("ingest_fresh", _fresh, UNAMES)
core("ingest_stream", _stream, UNAMES)
core("ingest_batches", _again, UNAMES)


def _inventory_csv(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "inventory-csv")
    rows = fleet(spark, d)("host_inventory")
    text = rows.select(*[F.coalesce(F.concat(F.lit(" "), F.col(c).cast("string"), F.lit(" ")), F.lit("0" if c.endswith("capabity_gb") else "")).alias(c) for c in INVENTORY_COLUMNS])
    text.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).mode("overwrite").csv(path)
    return inventory.expected_inventory(inventory.read_csv(spark, path, INVENTORY_COLUMNS))


core("src_expected_csv", lambda spark, d: _inventory_csv(spark, d).select(
        "hostname", "domain", "classification", "location", "proc_no_cores", "proc_count", "memory_capacity_gb", "storage_hdd_no_drives", "storage_hdd_capacity_gb", "storage_nvme_capabity_gb", "storage_ssd_capabity_gb", "os_name", "primary_ip"),
     "SELECT hostname, NULL AS domain, classification, location, proc_no_cores, proc_count, memory_capacity_gb, storage_hdd_no_drives, storage_hdd_capacity_gb, storage_nvme_capabity_gb, storage_ssd_capabity_gb, os_name, primary_ip FROM fx_inventory")


def _assets_csv(spark: SparkSession, d: str) -> DataFrame:
    t = lambda name: spark.table(dialect(spark, d).t(name))
    path = folder(spark, "assets-csv")
    rows = t("customer").select(
        F.concat(F.lit("a"), F.col("c_custkey").cast("string")).alias("asset_id"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).otherwise("").alias("hostname"),
        F.concat(F.col("c_nationkey").cast("string"), F.lit(".0")).alias("gpu_count"), F.col("c_acctbal").cast("string").alias("memory_capacity_gb"), F.lit("12.5").alias("storage_nvme_capabity_gb"), F.lit("x").alias("proc_count"))
    rows.write.option("header", True).mode("overwrite").csv(path)
    stored = t("supplier").select(F.concat(F.lit("a"), F.col("s_suppkey").cast("string")).alias("asset_id"), F.col("s_name").alias("hostname"), F.lit("v1").alias("vlan"))
    return inventory.upsert_assets(stored, inventory.read_csv(spark, path, rows.columns)).select("asset_id", "hostname", "vlan", "gpu_count", "memory_capacity_gb", "storage_nvme_capacity_gb", "proc_count")


core("src_assets_csv", _assets_csv, f"""SELECT 'a' || {s('c_custkey')} AS asset_id, c_name AS hostname, NULL AS vlan, c_nationkey AS gpu_count, c_acctbal AS memory_capacity_gb, CAST(12.5 AS DOUBLE) AS storage_nvme_capacity_gb, NULL::INT AS proc_count FROM customer WHERE c_acctbal > 0
    UNION ALL SELECT 'a' || {s('s_suppkey')}, s_name, 'v1', NULL, NULL, NULL, NULL FROM supplier WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = s_suppkey AND c_acctbal > 0)""")

DOC_BODY = "'> ' || replace(f.text, chr(10), chr(10) || '> ')"


def _raw_sink(spark: SparkSession, d: str) -> DataFrame:
    root = folder(spark, "blocks")
    write_table(split_blocks(_snaps(spark, d, ("uname_a", "documents"))), root, "run_commands")
    return spark.read.parquet(f"{root}/run_commands").groupBy(F.col("run_date").cast("string").alias("run_date"), "section").agg(
        F.count(F.lit(1)).alias("commands"), F.sum(F.octet_length("output_text")).alias("bytes"))


core("blocks_raw_sink", _raw_sink, f"""SELECT strftime(x.ts, '%Y%m%d') AS run_date, 'RAW' AS section, count(*) AS commands, CAST(sum(strlen({DOC_BODY})) AS BIGINT) AS bytes FROM {R('fx_docs')} GROUP BY 1
    UNION ALL SELECT strftime(ts, '%Y%m%d'), 'HOST INFO', count(*), CAST(sum(strlen('Linux n 5.' || {s('nation')} || '.' || {s('r')} || ' #1 SMP x86_64 GNU/Linux')) AS BIGINT) FROM fx_runs GROUP BY 1""")


def _tables_sink(spark: SparkSession, d: str) -> DataFrame:
    root = folder(spark, "tables")
    write_table(fleet(spark, d, stored=False)("run_users"), root, "run_users")
    return spark.read.parquet(f"{root}/run_users").select(F.col("run_date").cast("string").alias("run_date"), "run_id", "username", "uid")


core("tables_sink", _tables_sink, f"SELECT strftime(x.ts, '%Y%m%d') AS run_date, x.run_id, f.username, f.uid FROM {R('fx_users')}")


def _report_sink(f) -> DataFrame:
    path = folder(f.spark, "report")
    report.write_report(f, path)
    return f.spark.read.schema("value string, hostname string").text(path).select(F.coalesce("hostname", F.lit("")).alias("hostname"), F.col("value").alias("line"))


case("report_sink", _report_sink, f"SELECT hostname, line FROM ({report_sql()}) r")
case("ingest_summary", lambda f: f.summary(), "SELECT (SELECT count(*) FROM supplier) AS assets, 3 * (SELECT count(*) FROM supplier) AS runs, 9 * (SELECT count(*) FROM supplier) AS commands")

# ---- 2.2 blocks -------------------------------------------------------------------------------------------

NO = "row_number() OVER (PARTITION BY x.run_id ORDER BY f.k) - 1"
DOC_COMMAND = f"'cat /srv/Doc-' || {s('f.k')} || '.txt'"
core("blocks_split", lambda spark, d: split_blocks(_snaps(spark, d, ("documents",))).select("run_id", "command_index", "command", F.md5(F.col("output_text").cast("binary")).alias("output_md5")),
     f"SELECT x.run_id, {NO} AS command_index, {DOC_COMMAND} AS command, md5({DOC_BODY}) AS output_md5 FROM {R('fx_docs')}")
core("blocks_section", lambda spark, d: split_blocks(_snaps(spark, d, ("uname_a", "auditctl_s", "sestatus", "route_n", "documents"))).groupBy("run_id", "section").agg(
        F.min("command_index").alias("first_index"), F.count(F.lit(1)).alias("commands")),
     union("SELECT run_id, 'HOST INFO' AS section, 0 AS first_index, 1 AS commands FROM fx_runs", "SELECT run_id, 'SECURITY', 1, 2 FROM fx_runs", "SELECT run_id, 'NETWORK INFO', 3, 1 FROM fx_runs",
           f"SELECT x.run_id, 'RAW', 4, count(*) FROM {R('fx_docs')} GROUP BY x.run_id"))
core("blocks_tag", lambda spark, d: split_blocks(_snaps(spark, d, ("uname_a", "home_authorized_keys", "modinfo_all", "documents"))).groupBy("command_tag").agg(F.count(F.lit(1)).alias("runs")),
     f"""SELECT 'uname_a' AS command_tag, count(*) AS runs FROM fx_runs UNION ALL SELECT 'home_authorized_keys', count(DISTINCT (h, r)) FROM fx_keys UNION ALL SELECT 'modinfo_all', count(*) FROM fx_runs
         UNION ALL SELECT 'cat_srv_doc_' || {s('k')} || '_txt', count(*) FROM fx_docs GROUP BY k""")
core("blocks_first", lambda spark, d: split_blocks(_snaps(spark, d, ("uname_a", "sestatus", "uname_a"))).select("run_id", "command_index", "command_tag", "is_first"),
     union("SELECT run_id, 0 AS command_index, 'uname_a' AS command_tag, 1 AS is_first FROM fx_runs", "SELECT run_id, 1, 'sestatus', 1 FROM fx_runs", "SELECT run_id, 2, 'uname_a', 0 FROM fx_runs"))
core("catalog_upsert", lambda spark, d: command_catalog(split_blocks(_snaps(spark, d, ("uname_a", "documents"))), PARSED_TAGS),
     f"""SELECT 'uname_a' AS command_tag, 'HOST INFO' AS section, 'uname -a' AS command, 'Output of: uname -a' AS short_desc, 'Raw output of `uname -a`, kept losslessly in run_commands.' AS long_desc, 'normal' AS data_sensitivity, 'parsed' AS parse_status
     UNION ALL SELECT DISTINCT 'cat_srv_doc_' || {s('f.k')} || '_txt', 'RAW', {DOC_COMMAND}, 'Output of: ' || {DOC_COMMAND}, 'Raw output of `' || {DOC_COMMAND} || '`, kept losslessly in run_commands.', 'normal', 'raw' FROM fx_docs f""")

# ---- 2.4 scalar rules -------------------------------------------------------------------------------------


def scalar(name: str, fn, select: str, result: str) -> None:
    """A rule over texts made from a driver table: `select` gives k and the inputs, `result` the expected value."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = spark.sql(select.format(**{t: dialect(spark, d).t(t) for t in ("customer", "supplier", "orders", "part", "events")}))
        return rows.select("k", fn().alias("result"))

    names = {t: t for t in ("customer", "supplier", "orders", "part", "events")}
    core(name, run, f"SELECT k, {result} AS result FROM ({select.format(**names)}) q")


def pick(column: str, *pairs: tuple[str, str]) -> tuple[str, str]:
    """(input CASE, expected CASE) dealing literal pairs over the rows of a table."""
    n = len(pairs)
    inp = " ".join(f"WHEN {j} THEN {a}" for j, (a, _) in enumerate(pairs))
    exp = " ".join(f"WHEN {j} THEN {b}" for j, (_, b) in enumerate(pairs))
    return f"CASE {column} % {n} {inp} END", f"CASE k % {n} {exp} END"


def dealt(name: str, fn, *pairs: tuple[str, str], more: str = "") -> None:
    inp, exp = pick("c_custkey", *pairs)
    scalar(name, fn, f"SELECT c_custkey AS k, {inp} AS x{more} FROM {{customer}}", exp)


q = lambda text: "'" + text.replace("'", "''") + "'"
K = "CAST(c_custkey AS STRING)"
scalar("S1_human_size", lambda: S.human_size_to_bytes("x"),
       "SELECT c_custkey AS k, CAST(c_custkey % 1000 AS STRING) || CASE c_custkey % 6 WHEN 0 THEN 'Ti' WHEN 1 THEN 'M' WHEN 2 THEN 'B' WHEN 3 THEN '.5Gi' WHEN 4 THEN ' kB' ELSE ' lightyears' END AS x FROM {customer}",
       "CASE k % 6 WHEN 0 THEN (k % 1000) * 1099511627776 WHEN 1 THEN (k % 1000) * 1048576 WHEN 2 THEN k % 1000 WHEN 3 THEN (k % 1000) * 1073741824 + 536870912 WHEN 4 THEN (k % 1000) * 1024 END")
core("S2_file_name", lambda spark, d: _snaps(spark, d).select("source_path", S.snapshot_ip("source_path").alias("ip"), S.snapshot_time("source_path").alias("t")),
     f"SELECT path AS source_path, ip, {iso('ts')} AS t FROM fx_runs")
_run = ", CAST('2024-02-10 12:00:00' AS TIMESTAMP) AS run"
dealt("S3_free_text_time", lambda: S.iso(S.free_text_to_utc("x", "run")),
      (q("2024-01-15 14:30:45"), q("2024-01-15T14:30:45Z")), (q("Mon Jan  5 14:30 2024"), q("2024-01-05T14:30:00Z")), (q("Jan 15 14:30"), q("2024-01-15T14:30:00Z")), (q("Dec 15 14:30:01"), q("2023-12-15T14:30:01Z")),
      (q("15/01/2024 14:30"), q("2024-01-15T14:30:00Z")), (q("01/15/24 14:30"), q("2024-01-15T14:30:00Z")), (q("2024-01-15T14:30:45+0200"), q("2024-01-15T12:30:45Z")), (q("2031-01-15 14:30"), q("2023-01-15T14:30:00Z")), (q("not a time"), "NULL"), more=_run)
dealt("S3b_host_time", lambda: S.iso(S.host_text_to_utc("x", "run", S.zone_name(F.lit("Etc/GMT-2 (+02, +0200)")))),
      (q("2024-01-15 14:30:45"), q("2024-01-15T12:30:45Z")), (q("Jan 15 01:30"), q("2024-01-14T23:30:00Z")), (q("2024-01-15T14:30:45Z"), q("2024-01-15T14:30:45Z")), (q("?"), "NULL"), more=_run)
dealt("S4_listing_time", lambda: S.iso(S.listing_time_to_utc("x", "run", F.lit("Etc/GMT-2"))), (q("Nov 13 2023"), q("2023-11-12T22:00:00Z")), (q("Jan  4 22:28"), q("2024-01-04T20:28:00Z")), (q("soon"), "NULL"), more=_run)
dealt("S5_address_type", lambda: S.address_type(F.when(F.contains("x", F.lit(":")), "inet6").otherwise("inet"), "x"),
      *[(q(a), q(b)) for a, b in [("127.0.0.9", "loopback"), ("169.254.3.4", "link_local"), ("172.31.0.1", "private"), ("172.32.0.1", "public"), ("::1", "loopback"), ("FE80::1", "link_local"), ("fd00::1", "private"), ("2001:4860::1", "public")]])
dealt("S5b_interface_type", lambda: S.interface_type("x"),
      *[(q(a), q(b)) for a, b in [("lo", "loopback"), ("veth1@if2", "veth"), ("docker0", "docker"), ("br-12", "bridge"), ("tun0", "virtual"), ("enp3s0", "physical"), ("zt0", "other")]])
scalar("S6_group_type", lambda: S.group_type("x", "gid"), "SELECT c_custkey AS k, CASE WHEN c_nationkey < 5 THEN 'Docker' ELSE 'team' END AS x, c_custkey AS gid, c_nationkey AS nation FROM {customer}",
       "CASE WHEN nation < 5 THEN 'service' WHEN k >= 1000 THEN 'user' ELSE 'rare' END")
dealt("S7_route_and_scope", lambda: F.concat_ws("/", S.route_type("x"), S.bind_scope("x")),
      *[(q(a), q(b)) for a, b in [("0.0.0.0", "default/all_interfaces"), ("127.0.0.1", "host/loopback"), ("169.254.0.0", "link/specific"), ("10.0.0.0", "network/specific"), ("::1", "host/loopback")]])
dealt("S8_octal", lambda: S.permission_octal("x"), (q("drwxr-xr-x"), "755"), (q("-rwsr-sr-T"), "755"), (q("-rw-r-----"), "640"), (q("drwxrwxrwt"), "777"), (q("short"), "NULL"))
dealt("S9_command_parts", lambda: F.concat_ws("|", *S.process_parts("x")),
      (q("/usr/sbin/sshd -D  -p 22"), q("sshd|/usr/sbin/sshd|-D -p 22")), (q("[kworker/0:1]"), q("[kworker/0:1]|[kworker/0:1]|")), (q("\"/opt/my app/run\" --n='a b' c") + " || chr(92) || ' d'", q("run|/opt/my app/run|--n=a b c d")),
      (q("bad \"quote here"), q("bad|bad|\"quote here")), (q("sh -c \"echo ") + " || chr(92) || '\"hi' || chr(92) || '\"\"'", q("sh|sh|-c echo \"hi\"")))
dealt("S10_sudoers_type", lambda: S.sudoers_rule_type("x"),
      *[(q(a), q(b)) for a, b in [("Defaults env_reset", "Defaults"), ("Runas_Alias X = y", "Runas"), ("Cmnd_Alias X = y", "Cmnd"), ("Host_Alias X = y", "Host"), ("root ALL=(ALL) ALL", "User_Host"), ("@includedir /x", "other")]])
dealt("S11_audit_id", lambda: S.audit_id_filter("x", "auid"), (q("-F auid>=1000 -F auid!=-1"), q(">=1000")), (q("-F auid=0"), q("0")), (q("-F auid!=4294967295"), q("!=4294967295")), (q("-F uid=0"), "NULL"))
dealt("S12_unit_type", lambda: S.unit_type("x"), *[(q(a), q(b)) for a, b in [("ssh.service", "service"), ("a.b.timer", "timer"), ("x.device", "other"), ("dev-sda.mount", "mount"), ("plain", "other")]])
dealt("S13_usb_class", lambda: S.usb_class_label("x"), ("9", q("Hub")), ("0", q("Device")), ("265", q("Hub")), ("4", "NULL"), ("255", q("Vendor")))
dealt("S14_dmi_value", lambda: S.dmi_value(F.lit("Product Name"), "x"), (q("To be filled by O.E.M."), "NULL"), (q(" X100 "), q("X100")), (q("product name"), "NULL"), (q("N/A"), "NULL"))
scalar("S15_slug", lambda: F.concat_ws("/", S.normalize_hostname("x"), S.hostname_slug("x")), "SELECT c_custkey AS k, '  ' || c_name || CASE WHEN c_nationkey < 10 THEN '-A.b_C' ELSE '' END AS x FROM {customer}",
       "lower(trim(x)) || '/' || regexp_replace(lower(trim(x)), '[^a-z0-9]+', '', 'g')")
dealt("S16_fake_id", lambda: F.concat_ws("/", *[S.is_fake_identifier(F.lit(t), "x").cast("int").cast("string") for t in ("dmi_uuid", "machine_id", "hostname")]),
      (q("0000"), q("1/1/0")), (q("aaaa"), q("0/1/0")), (q("123456789abc"), q("1/0/0")), (q("FFFF-ffff"), q("1/0/0")), (q("None"), q("1/0/0")), (q("4c4c4544"), q("0/0/0")), (q(" "), q("1/1/1")))
scalar("S17_fingerprint", lambda: S.key_fingerprint("x", F.concat(F.lit("ssh-rsa "), F.col("x"))), "SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || '=x' ELSE 'YWJj' END AS x FROM {customer}",
       "CASE WHEN k % 2 = 0 THEN sha256('ssh-rsa ' || x) ELSE sha256('abc') END")
dealt("S18_report_text", lambda: F.concat_ws("|", F.coalesce(S.uname_arch("x"), F.lit("-")), F.coalesce(S.uname_kernel("x"), F.lit("-")), S.text_or_unknown("x"), S.gigabytes_text(F.length("x").cast("bigint") * F.lit(1024**3))),
      (q("Linux h 6.1 x86_64 GNU"), q("x86_64|6.1|Linux h 6.1 x86_64 GNU|22.0 GB")), (q(""), q("-|-|Unknown|Unknown")), (q("a b"), q("-|-|a b|3.0 GB")))
scalar("S19_array_access", lambda: F.concat_ws("|", F.get(F.split("x", "#"), F.lit(0)), F.coalesce(F.get(F.split("x", "#"), F.lit(5)), F.lit("none")), F.size(F.split("x", "#")).cast("string")),
       "SELECT c_custkey AS k, c_name AS x FROM {customer}", "split_part(x, '#', 1) || '|none|' || CAST(len(string_split(x, '#')) AS STRING)")
scalar("S20_sql_scalars", lambda: F.concat_ws("|", F.coalesce(F.nullif("seg", F.lit("BUILDING")), F.lit("none")), F.format_string("%.1f", F.abs("bal")), F.length("seg").cast("string"), F.col("seg").ilike("%o%").cast("int").cast("string"),
                                              S.iso(F.to_timestamp(F.lit("2024-03-10 00:00:00")) - F.expr("INTERVAL 30 DAYS"))),
       "SELECT c_custkey AS k, c_mktsegment AS seg, abs(round(c_acctbal)) + 0.75 AS bal FROM {customer}",
       "coalesce(nullif(seg, 'BUILDING'), 'none') || '|' || printf('%.1f', CAST(abs(bal) AS DOUBLE)) || '|' || CAST(length(seg) AS STRING) || '|' || CASE WHEN seg LIKE '%O%' THEN '1' ELSE '0' END || '|2024-02-09T00:00:00Z'")
