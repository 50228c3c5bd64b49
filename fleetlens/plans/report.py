"""Security posture report. Each section is one DataFrame over all hosts; top-k limits are per host and
belong to the report. `report_lines` turns the sections into ordered text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.functions.scalars import (
    free_text_to_utc, gigabytes_text, has_login_shell, severity_rank, text_or_unknown, uname_arch, uname_kernel,
)
from fleetlens.functions.text import blank_to_null, extract, first_n, strip
from fleetlens.operators.views import Table, current_runs, of_latest_runs


# ---- fleet ------------------------------------------------------------------------------------------------

def r_severity_counts(table: Table, all_runs: bool = False) -> DataFrame:
    """Findings per severity over the latest runs (or all of them)."""
    rows = table("findings")
    if not all_runs:
        rows = rows.join(table("v_latest_runs").select("run_id"), "run_id", "left_semi")
    return rows.groupBy("severity").agg(F.count(F.lit(1)).alias("finding_count")).orderBy(severity_rank("severity"))


def r_time_span(table: Table) -> DataFrame:
    """Oldest and newest collection and the whole days between them."""
    span = table("runs").agg(F.min("collected_at_utc").alias("oldest_collection"), F.max("collected_at_utc").alias("newest_collection"))
    seconds = F.col("newest_collection").cast("long") - F.col("oldest_collection").cast("long")
    return span.withColumn("span_days", F.floor(seconds / 86400).cast("int"))


def r_fleet_stats(table: Table) -> DataFrame:
    """Hosts, mean memory, distinct users and packages: four independent aggregates, unioned and summed
    (each is one row; joining users with packages would multiply them)."""
    ac = table("v_asset_current")
    latest = table("v_latest_runs").select("run_id")
    hosts = ac.agg(F.count_distinct("asset_id").alias("total_hosts"), (F.avg("mem_total_bytes") / F.lit(float(1024**3))).alias("avg_memory_gb"))
    distinct_count = lambda name, c: table(name).join(latest, "run_id", "left_semi").select(c).distinct().agg(F.count(c).alias("n"))
    users, packages = distinct_count("run_users", "username"), distinct_count("run_packages", "name")
    null = lambda t: F.lit(None).cast(t)
    rows = (
        hosts.select("total_hosts", "avg_memory_gb", null("bigint").alias("total_users"), null("bigint").alias("total_packages"))
        .unionByName(users.select(null("bigint").alias("total_hosts"), null("double").alias("avg_memory_gb"), F.col("n").alias("total_users"), null("bigint").alias("total_packages")))
        .unionByName(packages.select(null("bigint").alias("total_hosts"), null("double").alias("avg_memory_gb"), null("bigint").alias("total_users"), F.col("n").alias("total_packages")))
    )
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


# ---- host header ------------------------------------------------------------------------------------------

@of_latest_runs
def r_host_header(table: Table) -> DataFrame:
    ac = table("v_asset_current").withColumnRenamed("last_run_id", "run_id")
    dmi = table("run_dmi_system").select("run_id", F.col("version").alias("dmi_version"), "serial_number")
    expected = table("host_inventory").select("hostname", "memory_capacity_gb")
    rows = ac.join(table("run_uname"), "run_id", "left").join(dmi, "run_id", "left").join(expected, "hostname", "left")
    either = lambda a, b: F.coalesce(blank_to_null(a), b)
    return rows.select(
        "hostname", text_or_unknown("last_source_ip").alias("ip_address"), text_or_unknown("operating_system").alias("operating_system"),
        text_or_unknown(either("kernel", uname_kernel("uname_a"))).alias("kernel"),
        text_or_unknown(either("architecture", uname_arch("uname_a"))).alias("architecture"),
        text_or_unknown("hardware_vendor").alias("hardware_vendor"), text_or_unknown("hardware_model").alias("hardware_model"),
        text_or_unknown("dmi_version").alias("system_version"), text_or_unknown("serial_number").alias("serial_number"),
        gigabytes_text("mem_total_bytes").alias("memory_observed"),
        F.when(F.col("memory_capacity_gb") > 0, F.format_string("%.1f GB", "memory_capacity_gb")).otherwise("Unknown").alias("memory_inventory"))


@of_latest_runs
def r_disk_capacity(table: Table) -> DataFrame:
    disk = F.col("type") == "disk"
    sums = table("run_block_devices").join(table("v_latest_runs").select("run_id"), "run_id", "left_semi").groupBy("run_id").agg(
        F.sum(F.when(disk, F.col("size_bytes")).otherwise(0)).alias("total_disk_bytes"),
        F.sum(F.when(disk & (F.coalesce("rm", F.lit(0)) == 0), F.col("size_bytes")).otherwise(0)).alias("total_fixed_disk_bytes"))
    ac = table("v_asset_current").select("hostname", F.col("last_run_id").alias("run_id"))
    return ac.join(sums, "run_id", "left").select("hostname", "total_disk_bytes", "total_fixed_disk_bytes")


# ---- ports ------------------------------------------------------------------------------------------------

PORT_COLUMNS = ["proto", "state", "local_addr", "local_port", "peer_addr", "peer_port", "process_name", "pid"]


@of_latest_runs
def r_ports(table: Table) -> DataFrame:
    """Distinct sockets with their process, and the owner resolved by numeric uid or by name."""
    socks = table("run_listening_sockets").select("run_id", *PORT_COLUMNS)
    procs = table("run_processes").select("run_id", "pid", "uid", "cmd")
    rows = current_runs(table).join(socks, "run_id").join(procs, ["run_id", "pid"], "left").select(
        "run_id", "hostname", *PORT_COLUMNS, strip("uid").alias("uid"), "cmd").distinct()
    # one owner per lookup key: a name and a number are both keys, the first account wins
    accounts = table("run_users").select("run_id", "username", "uid", "gid")
    groups = table("run_groups").groupBy("run_id", "gid").agg(F.min("groupname").alias("groupname"))
    owners = accounts.join(groups, ["run_id", "gid"], "left").select(
        "run_id", F.explode(F.array(F.col("uid").cast("string"), F.when(~F.col("username").rlike(r"^\d+$"), F.col("username")))).alias("uid"),
        F.struct(F.col("username"), F.col("uid").alias("owner_uid"), F.col("groupname").alias("owner_group")).alias("owner"))
    owners = owners.filter("uid IS NOT NULL").groupBy("run_id", "uid").agg(F.min("owner").alias("owner"))
    scope = (
        F.when(F.col("local_addr").isin("127.0.0.1", "::1"), "local-only")
        .when(F.col("local_addr").isin("0.0.0.0", "::"), "all-interfaces").otherwise("bound"))
    return rows.join(owners, ["run_id", "uid"], "left").select(
        "run_id", "hostname", *PORT_COLUMNS, "uid", F.coalesce("cmd", "process_name", F.lit("Unknown Process")).alias("cmd"),
        F.col("owner.username").alias("owner_name"), F.coalesce("owner.owner_uid", F.col("uid").try_cast("int")).alias("owner_uid"),
        F.col("owner.owner_group").alias("owner_group"), scope.alias("addr_scope"))


def executable_base(cmd: Column | str) -> Column:
    return F.substring_index(F.substring_index(F.substring_index(strip(cmd), " ", 1), "/", -1), ":", 1)


@of_latest_runs
def r_port_packages(table: Table, k: int = 3) -> DataFrame:
    """Up to k packages whose name contains the executable's base name, starting matches first.

    Sockets shrink to distinct (run, base name) before the in-run pattern join, so
    only names of the same run ever meet.
    """
    bases = table("r_ports").select("run_id", "hostname", executable_base("cmd").alias("base")).filter("base <> ''").distinct()
    packages = table("run_packages").select("run_id", "name", "version")
    hit = F.contains(F.lower("name"), F.lower("base"))
    matched = bases.join(packages, "run_id").filter(hit)
    leading = F.when(F.lower("name").startswith(F.lower("base")), 0).otherwise(1)
    return first_n(matched, ["run_id", "base"], k, leading, "name", "version").select("hostname", "base", "name", "version")


@of_latest_runs
def r_port_firewall(table: Table, k: int = 3) -> DataFrame:
    """Up to k firewall rules that mention the port: ports are pulled out of each rule, then equi-joined."""
    ports = F.array_distinct(F.regexp_extract_all(
        "rule", F.lit(r"(?:\bdpt[:=]\s*|--dport\s+)(\d+)\b"), F.lit(1)))
    named = F.array_distinct(F.regexp_extract_all("rule", F.lit(r"\b(\d+)/(?:tcp|udp)\b"), F.lit(1)))
    mentions = table("run_firewall_rules").select(
        "run_id", F.col("source").alias("rule_source"), "rule", F.explode(F.array_union(ports, named)).alias("p")
    ).select("run_id", "rule_source", "rule", F.col("p").try_cast("int").alias("local_port"))
    open_ports = table("r_ports").filter("local_port IS NOT NULL").select("run_id", "hostname", "local_port").distinct()
    return first_n(open_ports.join(mentions.distinct(), ["run_id", "local_port"]), ["run_id", "local_port"], k, "rule_source", "rule").select(
        "hostname", "local_port", "rule_source", "rule")


@of_latest_runs
def r_unusual_ports(table: Table) -> DataFrame:
    apipa = lambda c: F.coalesce(F.col(c).startswith("169.254."), F.lit(False))
    odd = ~apipa("local_addr") & ~apipa("peer_addr") & (F.col("local_port") > 0) & ~F.col("local_port").isin(C.KNOWN_PORTS)
    return table("r_ports").filter(odd).select("hostname", "proto", "local_addr", "local_port", "cmd").distinct()


# ---- findings and accounts --------------------------------------------------------------------------------

@of_latest_runs
def r_host_findings(table: Table) -> DataFrame:
    return current_runs(table).join(table("findings"), "run_id").select(
        "hostname", "severity", "category", "title", "details").orderBy("hostname", severity_rank("severity"), "category", "title")


def _names(c: str, distinct: bool = False) -> Column:
    collect = F.collect_set if distinct else F.collect_list
    return F.array_join(F.array_sort(collect(c)), ",")


@of_latest_runs
def r_service_shells(table: Table) -> DataFrame:
    """System accounts (uid below 1000) with a login shell, with their groups."""
    users = table("run_users").filter(
        has_login_shell("shell") & (F.col("uid") < 1000) & ~F.col("username").isin(C.EXPECTED_SHELL_ACCOUNTS)
    ).select("run_id", "username", "shell", "uid")
    groups = table("run_group_members").filter("source = 'getent'").groupBy(
        "run_id", F.col("member_username").alias("username")).agg(_names("groupname").alias("groups"))
    return current_runs(table).join(users, "run_id").join(groups, ["run_id", "username"], "left").select(
        "hostname", "username", "shell", "uid", "groups")


@of_latest_runs
def r_privileged_users(table: Table) -> DataFrame:
    members = table("run_group_members").filter(F.col("groupname").isin(C.ADMIN_GROUPS))
    return current_runs(table).join(members, "run_id").groupBy("hostname", "member_username").agg(
        _names("groupname", distinct=True).alias("groups"), F.count(F.lit(1)).alias("group_count"))


def r_unused_keys(table: Table) -> DataFrame:
    return table("v_accounts_never_logged_in_with_keys").groupBy("hostname", "username").agg(F.sum("key_count").alias("key_count"))


# ---- what is special about a host -------------------------------------------------------------------------

def r_rare_processes(table: Table, k: int = 10) -> DataFrame:
    return first_n(table("v_rare_processes"), ["hostname"], k, F.col("host_count"), F.desc("total_instances"), F.col("cmd"), F.col("pid")).select(
        "hostname", "cmd", "host_count")


@of_latest_runs
def r_rare_packages(table: Table, k: int = 15) -> DataFrame:
    rows = current_runs(table).join(table("run_packages").select("run_id", "name", "version"), "run_id")
    counts = rows.select("name", "asset_id").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("host_count")).filter("host_count <= 2")
    return first_n(rows.join(counts, "name"), ["hostname"], k, "host_count", "name", "version").select("hostname", "name", "version", "host_count")


def r_rare_modules(table: Table, k: int = 10) -> DataFrame:
    return first_n(table("v_rare_kernel_modules"), ["hostname"], k, "host_count", "module").select(
        "hostname", "module", "host_count", "description", "license")


@of_latest_runs
def r_usb(table: Table) -> DataFrame:
    return current_runs(table).join(table("run_usb_devices"), "run_id").select(
        "hostname", "vendor_id", "product_id", "vendor_name", "product_name", "serial_number", "bus_number", "device_number"
    ).orderBy("hostname", "bus_number", "device_number")


def r_unique_mounts(table: Table, k: int = 5) -> DataFrame:
    return first_n(table("v_unique_mounts"), ["hostname"], k, "mountpoints", "name")


# ---- configuration ----------------------------------------------------------------------------------------

@of_latest_runs
def r_password_accounts(table: Table) -> DataFrame:
    enabled = F.col("status_code") == "P"
    return current_runs(table).join(table("run_passwd_status"), "run_id").groupBy("hostname").agg(
        F.count_if(enabled).alias("password_enabled"),
        F.array_join(F.array_sort(F.collect_list(F.when(enabled, F.col("username")))), ", ").alias("users"),
        F.count_if(F.col("status_code") == "L").alias("locked_accounts"), F.count(F.lit(1)).alias("total_accounts"))


@of_latest_runs
def r_audit_config(table: Table) -> DataFrame:
    counts = table("run_audit_rules").groupBy("run_id").agg(F.count(F.lit(1)).alias("rule_count"))
    posture = table("run_audit_posture").select("run_id", "audit_enabled", "audit_immutable")
    return current_runs(table).join(counts, "run_id").join(posture, "run_id").select(
        "hostname", "rule_count", "audit_enabled", "audit_immutable")


@of_latest_runs
def r_firewall_config(table: Table) -> DataFrame:
    return current_runs(table).join(table("run_firewall_rules"), "run_id").groupBy("hostname", "source").agg(
        F.count(F.lit(1)).alias("rule_count"))


@of_latest_runs
def r_firewall_allow(table: Table, k: int = 5) -> DataFrame:
    allow = F.col("rule").ilike("%ACCEPT%") | F.col("rule").ilike("%ALLOW%")
    rows = current_runs(table).join(table("run_firewall_rules").filter(allow), "run_id")
    return first_n(rows, ["hostname"], k, "source", "rule").select("hostname", "source", "rule")


@of_latest_runs
def r_logging(table: Table) -> DataFrame:
    """Remote logging targets of each host, sorted, as its rsyslog configuration states them outside comments."""
    fact = table("run_facts").filter("fact_group = 'rsyslog' AND fact_key = 'remote_destinations'").select(
        "run_id", F.array_sort(F.from_json("fact_value", "array<string>")).alias("targets"))
    return table("v_asset_current").select("hostname", F.col("last_run_id").alias("run_id")).join(fact, "run_id", "left").select(
        "hostname", F.array_join("targets", ",").alias("targets"),
        F.when(F.col("targets").isNull(), "not collected").when(F.size("targets") == 0, "none found").otherwise("detected").alias("status"))


@of_latest_runs
def r_logging_services(table: Table) -> DataFrame:
    units = table("run_services_systemctl").filter("unit IN ('rsyslog.service', 'systemd-journald.service')")
    return current_runs(table).join(units, "run_id").select("hostname", "unit", "load", "active", "sub").orderBy("hostname", "unit")


@of_latest_runs
def r_routes(table: Table, k: int = 10) -> DataFrame:
    rows = current_runs(table).join(
        table("run_routes").filter("destination NOT IN ('default', '0.0.0.0', '::/0')"), "run_id")
    return first_n(rows, ["hostname"], k, "destination", "gateway", "iface").select("hostname", "destination", "gateway", "iface")


def _login_time(text: str, run: str) -> Column:
    """Time of a lastlog entry such as `Mon Jan 01 00:00:00 +0000 2024`, or of any other known form."""
    zoned = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(text, r"^\w{3} +(?=[A-Za-z])", ""), " +", " "), F.lit("MMM d H:m:s xx yyyy"))
    return F.coalesce(zoned, free_text_to_utc(text, run))


def _active(table: Table) -> DataFrame:
    log = table("run_lastlog").filter(F.col("latest").isNotNull() & ~F.col("latest").ilike("%never%"))
    return current_runs(table, "last_collected_at_utc").join(log, "run_id").withColumn("latest_utc", _login_time("latest", "last_collected_at_utc"))


@of_latest_runs
def r_active_accounts(table: Table, k: int = 10) -> DataFrame:
    """The k latest lastlog entries per host with account details."""
    top = first_n(_active(table), ["hostname"], k, F.desc_nulls_last("latest_utc"), F.col("username"))
    users = table("run_users").select("run_id", "username", "uid", "gid", "home", "shell")
    groups = table("run_groups").select("run_id", "gid", "groupname")
    domain = F.contains("username", F.lit("\\")) | F.contains("username", F.lit("@"))
    return top.join(users, ["run_id", "username"], "left").join(groups, ["run_id", "gid"], "left").select(
        "hostname", "username", F.when(domain, "domain").otherwise("local").alias("account_type"), "latest", "from_host", "port",
        "uid", "gid", "groupname", "home", "shell")


@of_latest_runs
def r_active_by_node(table: Table) -> DataFrame:
    """Users with a recorded login per host, latest first."""
    # entries without a readable time come last
    since = F.coalesce(F.unix_micros("latest_utc"), F.lit(-(2**63)))
    ordered = F.array_sort(F.collect_list(F.struct((-(since + 1)).alias("order"), "username")))
    return _active(table).groupBy("hostname").agg(
        F.array_join(F.transform(ordered, lambda x: x["username"]), ", ").alias("users"))


def r_password_variance(table: Table) -> DataFrame:
    """Is the list of password accounts the same on all hosts that have any?"""
    lists = table("r_password_accounts").filter("password_enabled > 0")
    return lists.agg(
        F.count(F.lit(1)).alias("host_count"), F.count_distinct("users").alias("distinct_lists"),
        F.when(F.count_distinct("users") == 1, F.min("users")).alias("common_list"))


# ---- text -------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Section:
    """A part of the report: `lines` of each row of a table, rows ordered by `order`."""

    number: int
    rows: Callable[[Table], DataFrame]
    order: list[Column | str]
    lines: list[Column | str]

    @property
    def title(self) -> str:
        return TITLES[self.number][0]

    @property
    def nothing(self) -> str | None:
        return TITLES[self.number][1]

    @property
    def of_host(self) -> bool:
        return is_of_host(self.number)


FIRST_OF_HOST, LAST_OF_HOST = 10, 89

#: Title of every section, and what it says if it finds nothing; without that it is left out then. Those of one host come before number LAST_OF_HOST.
TITLES: dict[int, tuple[str, str | None]] = {
    1: ("Executive summary", "No findings"),
    2: ("Data collection", "Data collection timestamps not available"),
    3: ("Nodes", None),
    10: ("Host", None),
    11: ("Disk capacity", None),
    12: ("Open ports and services", "No listening ports identified"),
    13: ("Possible packages of listening programs", None),
    14: ("Firewall rules for open ports", None),
    15: ("Unusual ports", None),
    16: ("Security findings", "No security findings identified"),
    17: ("Service accounts with interactive shells", None),
    18: ("Privileged users", None),
    19: ("Accounts with SSH keys but never logged in", None),
    20: ("Rare processes on this node", None),
    21: ("Rare packages on this node", None),
    22: ("Rare kernel modules", None),
    23: ("USB devices", "No USB devices detected"),
    24: ("Unique mount points", None),
    25: ("Password accounts", None),
    26: ("Audit", None),
    27: ("Firewall rules", None),
    28: ("Custom and allow rules", None),
    29: ("Logging services", None),
    30: ("Remote logging", None),
    31: ("Routes", "No non-default routes detected"),
    32: ("Active accounts", "No recent account activity detected"),
    90: ("Active accounts by node", "None detected"),
    91: ("Accounts with passwords enabled by node", "None detected"),
}


def is_of_host(section: int) -> bool:
    return FIRST_OF_HOST <= section <= LAST_OF_HOST


HEADER_ITEMS = {
    "IP Address": "ip_address", "Operating System": "operating_system", "Kernel": "kernel", "Architecture": "architecture",
    "Hardware Vendor": "hardware_vendor", "Hardware Model": "hardware_model", "System Version": "system_version",
    "Serial Number": "serial_number", "Memory (Observed)": "memory_observed", "Memory (Inventory)": "memory_inventory"}


def _or(c: str, other: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(other))


def _number(c: str) -> Column:
    """Text that sorts as the number does, nulls first."""
    return F.when(F.col(c).isNull(), "").otherwise(F.lpad(F.col(c).cast("string"), 20, "0"))


def _said(prefix: str, c: Column | str, suffix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.col(c).cast("string") if isinstance(c, str) else c, F.lit(suffix))


def _port_packages(table: Table) -> DataFrame:
    """One row for each program that listens; a program has a few packages at most."""
    package = F.concat_ws(" ", "name", "version")
    return table("r_port_packages").groupBy("hostname", "base").agg(F.array_join(F.array_sort(F.collect_list(package)), ", ").alias("packages"))


def _password_lists(table: Table) -> DataFrame:
    """The accounts with passwords of each host, or one row if all hosts have the same."""
    variance = table("r_password_variance").filter("distinct_lists = 1").select(F.lit("Same across all nodes").alias("hostname"), F.col("common_list").alias("users"))
    several = table("r_password_variance").filter("distinct_lists > 1").select("distinct_lists")
    lists = table("r_password_accounts").filter("password_enabled > 0").join(F.broadcast(several)).select("hostname", "users")  # several has one row or none
    return variance.unionByName(lists)


def sections() -> list[Section]:
    scope = F.concat(F.lit(" ["), _or("state", "unknown"), F.lit(", "), "addr_scope", F.lit("]"))
    peer = F.when((F.col("peer_addr") != "") & (F.col("peer_port") != 0), F.concat(F.lit(" -> "), "peer_addr", F.lit(":"), F.col("peer_port").cast("string"))).otherwise("")
    owner = F.when(F.col("uid").isNotNull(), F.concat(F.lit(" (uid="), F.coalesce(F.col("owner_uid").cast("string"), "uid"), F.lit(", user="), _or("owner_name", "unknown"), F.lit(", group="), _or("owner_group", "unknown"), F.lit(")"))).otherwise("")
    port = F.concat(_said("  ", F.upper(_or("proto", "unknown"))), F.lit(" "), _or("local_addr", "unknown"), F.lit(":"), _or("local_port", "*"), peer, scope)
    only = F.when(F.col("host_count") > 1, F.format_string(" (only on %d nodes)", "host_count")).otherwise(F.format_string(" (only on %d node)", "host_count"))
    utc = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss 'UTC'")
    yes_no = lambda c: F.when(F.col(c) != 0, "Yes").otherwise("No")
    usb_ids = F.when((F.col("vendor_id") != "") & (F.col("product_id") != ""), F.concat("vendor_id", F.lit(":"), "product_id")).otherwise("unknown")
    return [
        Section(1, lambda t: t("r_severity_counts"), [severity_rank("severity")], [F.format_string("%d %s severity findings", "finding_count", F.upper("severity"))]),
        Section(2, lambda t: t("r_time_span").filter("oldest_collection IS NOT NULL"), [], [
            _said("Oldest Data Collection: ", utc("oldest_collection")), _said("Newest Data Collection: ", utc("newest_collection")), _said("Data Time Span: ", "span_days", " days")]),
        Section(3, lambda t: t("r_fleet_stats"), [], [
            _said("Total Nodes Assessed: ", "total_hosts"), _said("Average Memory per Node: ", F.coalesce(F.format_string("%.1f GB", "avg_memory_gb"), F.lit("Unknown"))),
            _said("Total Unique Users Across Nodes: ", "total_users"), _said("Total Unique Packages Across Nodes: ", "total_packages")]),
        Section(10, lambda t: t("r_host_header"), [], [_said(f"{k}: ", c) for k, c in HEADER_ITEMS.items()]),
        Section(11, lambda t: t("r_disk_capacity"), [], [_said("Total Disk Capacity (All): ", gigabytes_text("total_disk_bytes")), _said("Total Disk Capacity (Fixed): ", gigabytes_text("total_fixed_disk_bytes"))]),
        Section(12, lambda t: t("r_ports"), [_number("local_port"), "proto", "local_addr", _number("pid"), "peer_addr"], [
            port, _said("    Process: ", "cmd"), F.when(F.col("pid").isNotNull(), _said("    PID: ", F.concat(F.col("pid").cast("string"), owner)))]),
        Section(13, _port_packages, ["base"], [F.concat(F.lit("  "), "base", F.lit(": "), "packages")]),
        Section(14, lambda t: t("r_port_firewall"), [_number("local_port"), "rule_source", "rule"], [F.concat(F.lit("  "), F.col("local_port").cast("string"), F.lit(": ["), "rule_source", F.lit("] "), "rule")]),
        Section(15, lambda t: t("r_unusual_ports"), [_number("local_port"), "proto", "local_addr", "cmd"], [F.concat(F.lit("  "), F.upper("proto"), F.lit(" "), "local_addr", F.lit(":"), F.col("local_port").cast("string"), F.lit(" - "), "cmd")]),
        Section(16, lambda t: t("r_host_findings"), [severity_rank("severity").cast("string"), "category", "title", "details"], [
            F.concat(F.upper("severity"), F.lit(": "), "title"), F.when(F.col("details") != "", _said("   ", "details"))]),
        Section(17, lambda t: t("r_service_shells"), ["username"], [
            F.concat(F.lit("  User: "), "username", F.lit(" (UID: "), F.col("uid").cast("string"), F.lit(", Shell: "), "shell", F.lit(")")), F.when(F.col("groups") != "", _said("    Groups: ", "groups"))]),
        Section(18, lambda t: t("r_privileged_users"), ["member_username"], [F.concat(F.lit("  "), "member_username", F.lit(": "), "groups")]),
        Section(19, lambda t: t("r_unused_keys"), ["username"], [F.concat(F.lit("  "), "username", F.lit(": "), F.col("key_count").cast("string"), F.lit(" SSH keys"))]),
        Section(20, lambda t: t("r_rare_processes"), [_number("host_count"), "cmd"], [F.concat(F.lit("  "), "cmd", only)]),
        Section(21, lambda t: t("r_rare_packages"), [_number("host_count"), "name", "version"], [F.concat(F.lit("  "), F.concat_ws(" ", "name", "version"), only)]),
        Section(22, lambda t: t("r_rare_modules"), [_number("host_count"), "module"], [
            F.concat(F.lit("  "), "module", F.when(F.col("description") != "", _said(" - ", "description")).otherwise(""), F.when(F.col("license") != "", _said(" [", "license", "]")).otherwise(""), only)]),
        Section(23, lambda t: t("r_usb"), ["bus_number", "device_number"], [
            F.concat(F.lit("  Bus "), _or("bus_number", "unknown"), F.lit(" Device "), _or("device_number", "unknown"), F.lit(": "), _or("vendor_name", "Unknown Vendor"), F.lit(" "), _or("product_name", "Unknown Product"), F.lit(" ["), usb_ids, F.lit("] Serial: "), _or("serial_number", "unknown"))]),
        Section(24, lambda t: t("r_unique_mounts"), ["mountpoints", "name"], [F.concat(F.lit("  "), "mountpoints", F.lit(" ("), "name", F.lit(", "), "type", F.lit(")"))]),
        Section(25, lambda t: t("r_password_accounts"), [], [
            _said("Accounts with Passwords Enabled: ", "password_enabled"), _said("  Users: ", F.when(F.col("users") != "", F.col("users")).otherwise("None")), _said("Locked Accounts: ", "locked_accounts"), _said("Total User Accounts: ", "total_accounts")]),
        Section(26, lambda t: t("r_audit_config"), [], [_said("Audit Rules: ", "rule_count", " rules configured"), _said("Audit Enabled: ", yes_no("audit_enabled")), _said("Audit Immutable: ", yes_no("audit_immutable"))]),
        Section(27, lambda t: t("r_firewall_config"), ["source"], [F.concat(F.lit("  "), "source", F.lit(": "), F.col("rule_count").cast("string"), F.lit(" rules"))]),
        Section(28, lambda t: t("r_firewall_allow"), ["source", "rule"], [F.concat(F.lit("    ["), "source", F.lit("] "), "rule")]),
        Section(29, lambda t: t("r_logging_services"), ["unit"], [F.concat(F.lit("  "), "unit", F.lit(": "), "active", F.lit("/"), "sub", F.lit(" (load="), "load", F.lit(")"))]),
        Section(30, lambda t: t("r_logging"), [], [F.concat(F.lit("Remote logging targets: "), "status"), F.when(F.col("targets") != "", _said("  ", "targets"))]),
        Section(31, lambda t: t("r_routes"), ["destination", "gateway", "iface"], [F.concat(F.lit("  "), "destination", F.lit(" via "), _or("gateway", "None"), F.lit(" dev "), _or("iface", "None"))]),
        Section(32, lambda t: t("r_active_accounts"), ["username"], [
            F.concat(F.lit("  "), "username", F.lit(" ("), "account_type", F.lit("): "), "latest", F.lit(" from "), _or("from_host", "unknown"), F.lit(" ("), _or("port", "n/a"), F.lit(")")),
            F.concat(F.lit("     uid="), _or("uid", "n/a"), F.lit(" gid="), _or("gid", "n/a"), F.lit(" group="), _or("groupname", "unknown"), F.lit(" shell="), _or("shell", "unknown"), F.lit(" home="), _or("home", "unknown"))]),
        Section(90, lambda t: t("r_active_by_node"), ["hostname"], [F.concat(F.lit("  "), "hostname", F.lit(": "), "users")]),
        Section(91, _password_lists, ["hostname"], [F.concat(F.lit("  "), "hostname", F.lit(": "), "users")]),
    ]


# Extractions that the sections read, those of the longest texts first.
READS = (
    "run_packages", "run_processes", "run_listening_sockets", "run_ssh_authorized_keys", "run_firewall_rules", "run_modinfo_kv", "run_file_listings", "run_services_systemctl",
    "run_users", "run_groups", "run_failed_logins", "run_lastlog", "run_passwd_status", "run_lsmod", "run_facts", "run_usb_devices", "run_hostinfo", "run_block_devices",
    "run_dmi_system", "run_interfaces", "run_interface_addrs", "asset_domain", "run_timedate", "run_memory", "run_uname", "run_audit_status", "run_audit_rules", "run_selinux_status",
    "run_selinux_booleans", "run_apparmor_status", "run_resolv_conf_entries", "run_ip_neigh", "run_routes",
)


def report_lines(table: Table) -> DataFrame:
    """(hostname, section, ord, line_no, line) for the whole fleet, to be read in that order; `hostname` is empty for fleet-wide sections.

    Every section begins with its title (ord empty, line 0). Sections say so if they found nothing, or are left out for that host.
    """
    if hasattr(table, "prepare"):
        table.prepare(*READS)
    every = sections()
    ordered = lambda x: F.concat_ws("\x01", F.lit("1"), *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in x.order])
    bodies = [
        x.rows(table).select((F.col("hostname") if x.of_host else F.lit("")).alias("hostname"), F.lit(x.number).alias("section"), ordered(x).alias("ord"),
                             F.posexplode(F.array_compact(F.array(*x.lines))).alias("line_no", "line"), F.lit(True).alias("found"))
        for x in every]
    # a title and what is said of nothing, for each host and section
    said = F.explode(F.array(*[F.struct(F.lit(x.number).alias("section"), F.lit(no).alias("line_no"), F.lit(text).alias("line")) for x in every if x.of_host for no, text in ((0, f"{x.title}:"), (1, x.nothing)) if text]))
    hosts = table("v_asset_current").select("hostname").distinct()
    frames = hosts.select("hostname", said.alias("s")).select("hostname", "s.section", F.lit("").alias("ord"), "s.line_no", "s.line", F.lit(False).alias("found"))
    of_hosts = frames
    for x, body in zip(every, bodies, strict=True):
        if x.of_host:
            of_hosts = of_hosts.unionByName(body)
    # a section of a host is bounded by its snapshot
    any_found = F.max("found").over(Window.partitionBy("hostname", "section"))
    tells = F.col("section").isin([x.number for x in every if x.nothing])
    of_hosts = of_hosts.withColumn("any_found", any_found).filter(
        F.col("found") | F.when(F.col("line_no") == 0, F.col("any_found") | tells).otherwise(~F.col("any_found")))
    out = of_hosts.select("hostname", "section", "ord", "line_no", "line")
    for x, body in zip(every, bodies, strict=True):
        if not x.of_host:
            one = body.agg(F.count(F.lit(1)).alias("n")).filter(F.lit(x.nothing is not None) | (F.col("n") > 0))
            frame = one.select(F.lit("").alias("hostname"), F.lit(x.number).alias("section"), F.lit("").alias("ord"),
                               F.posexplode(F.when(F.col("n") > 0, F.array(F.lit(f"{x.title}:"))).otherwise(F.array(F.lit(f"{x.title}:"), F.lit(x.nothing)))).alias("line_no", "line"))
            out = out.unionByName(frame).unionByName(body.drop("found"))
    return out


def write_report(table: Table, path: str) -> None:
    """One folder per host with its lines in report order. A host's lines are bounded by its snapshot."""
    (
        report_lines(table).repartition("hostname").sortWithinPartitions("hostname", "section", "ord", "line_no", "line")
        .select("hostname", "line").write.partitionBy("hostname").mode("overwrite").text(path)
    )


REPORT = [
    r_severity_counts, r_time_span, r_fleet_stats, r_host_header, r_disk_capacity, r_ports, r_port_packages, r_port_firewall,
    r_unusual_ports, r_host_findings, r_service_shells, r_privileged_users, r_unused_keys, r_rare_processes, r_rare_packages,
    r_rare_modules, r_usb, r_unique_mounts, r_password_accounts, r_audit_config, r_firewall_config, r_firewall_allow,
    r_logging, r_logging_services, r_routes, r_active_accounts, r_active_by_node, r_password_variance,
]
