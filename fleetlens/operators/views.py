"""Fleet views: current state, change between runs, rarity across the fleet, drift from expectations.

Every function maps `table` (a table name -> DataFrame lookup) to a DataFrame.
Per-host counts are aggregated per run first and joined once; rarity keeps only
the rare keys before it joins back, so common values never cross a shuffle twice.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.functions.scalars import has_login_shell
from fleetlens.functions.text import literal_map, starts_with_any

Table = Callable[[str], DataFrame]


def of_latest_runs(fn):
    """Mark a question about latest runs only: run tables are then read from the partitions of their dates (see Fleet.recent)."""

    @functools.wraps(fn)
    def asked(table: Table, *args, **kw) -> DataFrame:
        return fn(getattr(table, "recent", table), *args, **kw)

    return asked


GB = float(1024**3)


# ---- current state ----------------------------------------------------------------------------------------

def v_latest_runs(table: Table) -> DataFrame:
    """Latest run per asset; ties stay, runs without an asset drop out."""
    runs = table("runs").filter("asset_id IS NOT NULL")
    newest = runs.groupBy("asset_id").agg(F.max("collected_at_utc").alias("collected_at_utc"))
    return runs.join(newest, ["asset_id", "collected_at_utc"])


def _of_latest(table: Table, name: str) -> DataFrame:
    """Rows of a run table that belong to a latest run."""
    return table(name).join(table("v_latest_runs").select("run_id"), "run_id", "left_semi")


@of_latest_runs
def primary_ipv4(table: Table) -> DataFrame:
    """The address in the file name if an interface has it, else a global, else any non-loopback one."""
    latest = table("v_latest_runs").select("run_id", "source_ip")
    addrs = _of_latest(table, "run_interface_addrs").filter("family = 'inet'").select("run_id", "ifname", "address", "scope")
    rows = latest.join(addrs, "run_id", "left")
    rank = (
        F.when(F.col("address") == F.col("source_ip"), 0)
        .when((F.col("address") != "127.0.0.1") & (F.col("scope") == "global"), 1)
        .when(F.col("address") != "127.0.0.1", 2)
    )
    order = F.when(rank.isNotNull(), F.struct(rank.alias("rank"), F.col("ifname"), F.col("address")))
    best = rows.groupBy("run_id", "source_ip").agg(F.min_by("address", order).alias("best"))
    return best.select("run_id", F.coalesce("best", "source_ip").alias("primary_ipv4"))


@of_latest_runs
def primary_mac(table: Table) -> DataFrame:
    """MAC of the interface with the file-name address, else of a global one, else any; UP comes first."""
    latest = table("v_latest_runs").select("run_id", "source_ip")
    ifaces = _of_latest(table, "run_interfaces").filter("mac_addr <> ''").select("run_id", "ifname", "mac_addr", "state")
    addrs = _of_latest(table, "run_interface_addrs").filter("family = 'inet'").select("run_id", "ifname", "address", "scope")
    rows = ifaces.join(addrs, ["run_id", "ifname"], "left").join(latest, "run_id")
    rank = (
        F.when(F.col("address") == F.col("source_ip"), 0)
        .when((F.col("ifname") != "lo") & (F.col("scope") == "global"), 1)
        .when(F.col("ifname") != "lo", 2)
    )
    order = F.when(rank.isNotNull(), F.struct(
        rank.alias("rank"), F.when(F.col("state") == "UP", 0).otherwise(1).alias("down"), F.col("ifname")))
    return rows.groupBy("run_id").agg(F.min_by("mac_addr", order).alias("primary_mac"))


@of_latest_runs
def v_asset_current(table: Table) -> DataFrame:
    """One row per asset (and tied latest run) with the facts used nearly everywhere."""
    latest = table("v_latest_runs").select(
        "asset_id", "run_id", F.col("collected_at_utc").alias("last_collected_at_utc"), F.col("source_ip").alias("last_source_ip"))
    facts = latest
    for name, cols in {
        "run_hostinfo": ["machine_id", "hardware_vendor", "hardware_model", "operating_system", "kernel", "architecture"],
        "run_timedate": ["time_zone", "system_clock_synchronized", "ntp_service"],
        "run_memory": ["mem_total_bytes", "swap_total_bytes"],
        "primary_ipv4": ["primary_ipv4"],
        "primary_mac": ["primary_mac"],
    }.items():
        facts = facts.join(table(name).select("run_id", *cols), "run_id", "left")
    facts = facts.withColumnRenamed("run_id", "last_run_id")
    return table("assets").select("asset_id", "hostname", "domain", "fqdn").join(facts, "asset_id", "left")


def current_runs(table: Table, *extra: str) -> DataFrame:
    """Key columns of v_asset_current with the run id ready for joining."""
    return table("v_asset_current").filter("last_run_id IS NOT NULL").select(
        F.col("last_run_id").alias("run_id"), "asset_id", "hostname", *extra)


@of_latest_runs
def v_host_inventory_current(table: Table) -> DataFrame:
    """Observed inventory of the latest run, with expected class and location laid over it."""
    ac = table("v_asset_current")
    run = ac.withColumnRenamed("last_run_id", "run_id")
    cpu = _of_latest(table, "run_lshw_devices").filter("class = 'cpu'").groupBy("run_id").agg(
        F.min_by(F.struct("vendor", "product"), "node_no").alias("cpu"))
    gpu = _of_latest(table, "run_gpu_devices").groupBy("run_id").agg(
        F.count(F.lit(1)).alias("gpu_count"), F.max("vendor").alias("gpu_manufacturer"),
        F.max("description").alias("gpu_model_series"), F.max("device").alias("gpu_model_no"))
    nvme = F.lower("name").contains("nvme")
    size = F.coalesce("size_bytes", F.lit(0)) / F.lit(GB)
    disks = _of_latest(table, "run_block_devices").groupBy("run_id").agg(
        F.count_if((F.col("type") == "disk") & nvme).alias("storage_nvme_no_drives"),
        F.sum(F.when((F.col("type") == "disk") & nvme, size).otherwise(0.0)).alias("storage_nvme_capabity_gb"),
        F.count_if((F.col("type") == "disk") & ~nvme).alias("storage_hdd_no_drives"),
        F.sum(F.when((F.col("type") == "disk") & ~nvme, size).otherwise(0.0)).alias("storage_hdd_capacity_gb"))
    release = _of_latest(table, "run_os_release_kv").filter("k IN ('NAME', 'VERSION_ID')").groupBy("run_id").agg(
        F.max(F.when(F.col("k") == "NAME", F.col("v"))).alias("os_name"),
        F.max(F.when(F.col("k") == "VERSION_ID", F.col("v"))).alias("os_version"))
    owner = _of_latest(table, "run_interface_addrs").filter("family = 'inet'").groupBy(
        "run_id", F.col("address").alias("primary_ipv4")).agg(F.min("ifname").alias("interface"))
    dmi = table("run_dmi_system").select("run_id", "manufacturer", "product_name", F.col("version").alias("dmi_version"))
    expected = table("host_inventory").select("hostname", "classification", "location")
    wide = run
    for part in (dmi, cpu, gpu, disks, release):
        wide = wide.join(part, "run_id", "left")
    wide = wide.join(owner, ["run_id", "primary_ipv4"], "left").join(expected, "hostname", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    null = lambda t: F.lit(None).cast(t)
    return wide.select(
        "asset_id", "hostname", "domain", "fqdn", "classification", "location",
        F.col("manufacturer").alias("server_manufacturer"), F.col("product_name").alias("server_model_series"),
        F.col("dmi_version").alias("server_model_no"), F.col("cpu.vendor").alias("proc_manufacturer"),
        F.col("cpu.product").alias("proc_model_series"), F.col("cpu.product").alias("proc_model_no"),
        null("int").alias("proc_no_cores"), null("int").alias("proc_count"),
        "gpu_manufacturer", "gpu_model_series", "gpu_model_no", zero("gpu_count"),
        (F.col("mem_total_bytes") / F.lit(GB)).alias("memory_capacity_gb"),
        zero("storage_hdd_no_drives"), "storage_hdd_capacity_gb", zero("storage_nvme_no_drives"), "storage_nvme_capabity_gb",
        F.lit(0).alias("storage_ssd_no_drives"), null("double").alias("storage_ssd_capabity_gb"),
        "os_name", "os_version", F.col("architecture").alias("arch"), F.col("primary_ipv4").alias("primary_ip"),
        "interface", F.col("primary_mac").alias("mac_addr"))


def inventory_sync(table: Table) -> DataFrame:
    """Asset inventory after refreshing it from the latest runs: observed rows replace stored ones."""
    observed = table("v_host_inventory_current").drop("domain", "fqdn", "classification", "location", "hostname")
    stored = table("asset_inventory")
    return stored.join(observed.select("asset_id"), "asset_id", "left_anti").unionByName(observed, allowMissingColumns=True)


# ---- change between runs ----------------------------------------------------------------------------------

def v_asset_previous_run(table: Table) -> DataFrame:
    """The newest run older than the latest one, per asset (an aggregate, not a correlated lookup)."""
    ac = table("v_asset_current").select("asset_id", "hostname", "last_run_id", "last_collected_at_utc")
    older = table("runs").select("asset_id", "run_id", "collected_at_utc").join(
        ac.select("asset_id", "last_collected_at_utc").distinct(), "asset_id").filter("collected_at_utc < last_collected_at_utc")
    previous = older.groupBy("asset_id").agg(F.max(F.struct("collected_at_utc", "run_id")).alias("p"))
    return ac.join(previous, "asset_id", "left").select(
        "asset_id", "hostname", "last_run_id", "last_collected_at_utc", F.col("p.run_id").alias("previous_run_id"),
        F.col("p.collected_at_utc").alias("previous_collected_at_utc"))


def v_run_delta_privileged_members(table: Table) -> DataFrame:
    """Members that joined or left a privileged group between the previous and the latest run.

    Both runs are brought together by one aggregation per (asset, group, member):
    present in one run only means added or removed.
    """
    pairs = table("v_asset_previous_run").filter("previous_run_id IS NOT NULL")
    key = ["hostname", "last_run_id", "previous_run_id", "last_collected_at_utc", "previous_collected_at_utc"]
    sides = pairs.select(*key, F.explode(F.array(
        F.struct(F.col("last_run_id").alias("run_id"), F.lit(True).alias("is_last")),
        F.struct(F.col("previous_run_id").alias("run_id"), F.lit(False).alias("is_last")))).alias("s")
    ).select(*key, "s.run_id", "s.is_last")
    groups = table("run_priv_groups").select("run_id", "groupname").withColumn("privileged", F.lit(True))
    members = table("run_group_members").join(sides, "run_id").join(groups, ["run_id", "groupname"], "left")
    both = members.groupBy(*key, "groupname", "member_username").agg(
        F.bool_or("is_last").alias("now"), F.bool_or(~F.col("is_last")).alias("before"),
        # one row per membership row of the run, as a join with its privileged groups would give
        F.count_if("privileged").alias("n"))
    changed = both.filter("now <> before AND n > 0").withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return changed.select("hostname", "groupname", "member_username", F.when(F.col("now"), "added").otherwise("removed").alias("change_type"),
                          "last_run_id", "previous_run_id", "last_collected_at_utc", "previous_collected_at_utc")


# ---- accounts and logins ----------------------------------------------------------------------------------

@of_latest_runs
def v_failed_logins_recent(table: Table, days: int = 30) -> DataFrame:
    ac = current_runs(table, "last_collected_at_utc")
    since = F.col("last_collected_at_utc") - F.expr(f"INTERVAL {days} DAYS")
    return table("run_failed_logins").join(ac, "run_id").filter(F.col("attempt_time_utc") >= since).select(
        "hostname", "username", "remote_host", "tty", "attempt_time_utc", "raw_start_text",
        F.col("last_collected_at_utc").alias("baseline_collected_at"))


def _never_logged_in_with_keys(table: Table) -> DataFrame:
    users = table("run_users").filter(has_login_shell("shell")).select("run_id", "username")
    last = table("run_lastlog").select("run_id", "username", "latest")
    keys = table("run_ssh_authorized_keys").groupBy("run_id", "username").agg(F.count(F.lit(1)).alias("keys"))
    return (
        current_runs(table).join(users, "run_id").join(keys, ["run_id", "username"])
        .join(last, ["run_id", "username"], "left").filter("latest IS NULL OR latest = 'Never logged in'")
        .groupBy("hostname", "username", "latest").agg(F.sum("keys").alias("key_count"))
    )


@of_latest_runs
def v_accounts_never_logged_in_with_keys(table: Table) -> DataFrame:
    return _never_logged_in_with_keys(table).withColumnRenamed("latest", "lastlog_status")


@of_latest_runs
def v_asset_security_summary(table: Table) -> DataFrame:
    """Counts and flags per host. Each source table is aggregated to one row per run before it is joined."""
    ac = table("v_asset_current").select(
        "asset_id", "hostname", F.col("last_run_id").alias("run_id"), "last_collected_at_utc", "primary_ipv4", "primary_mac")
    count = F.count(F.lit(1))
    counts = {
        "run_users": {"local_user_count": count, "login_shell_user_count": F.count_if(has_login_shell("shell"))},
        "run_passwd_status": {"locked_account_count": F.count_if(F.col("status_code") == "L")},
        "run_ssh_authorized_keys": {"authorized_key_count": count},
        "run_packages": {"package_row_count": count},
        "run_firewall_rules": {"firewall_rule_row_count": count},
        "run_group_members": {"privileged_user_count": F.count_distinct(F.when(
            (F.col("source") == "getent") & F.col("groupname").isin(C.ADMIN_GROUPS), F.col("member_username")))},
        "run_audit_rules": {"audit_rule_count": count},
        "run_failed_logins": {"failed_login_count_recent": count},
        "run_file_listings": {"systemd_listing_rows": F.count_if(F.col("source") == "systemd_dirs"),
                              "cron_listing_rows": F.count_if(F.col("source") == "cron_dirs")},
    }
    out = ac
    for name, aggs in counts.items():
        out = out.join(_of_latest(table, name).groupBy("run_id").agg(*[a.alias(n) for n, a in aggs.items()]), "run_id", "left")
    audit = table("run_audit_posture").select(
        "run_id", "audit_enabled", "audit_immutable", F.col("has_critical_auth_rules").alias("audit_has_critical_auth_rules"),
        F.col("has_critical_file_rules").alias("audit_has_critical_file_rules"))
    selinux = table("run_selinux_posture").select(
        "run_id", F.when(F.col("selinux_enabled") == 1, "enabled").otherwise("disabled").alias("selinux_status"),
        F.when(F.col("selinux_enforcing") == 1, "enforcing").when(F.col("selinux_permissive") == 1, "permissive")
        .otherwise("disabled").alias("selinux_mode"),
        F.col("high_risk_booleans_on").alias("selinux_high_risk_booleans_on"))
    apparmor = table("run_apparmor_posture").select("run_id", "apparmor_all_enforcing", "apparmor_mixed_mode")
    for part in (audit, selinux, apparmor):
        out = out.join(part, "run_id", "left")
    names = [n for aggs in counts.values() for n in aggs]
    return out.withColumns({n: F.coalesce(n, F.lit(0)) for n in names}).withColumnRenamed("run_id", "last_run_id")


@of_latest_runs
def v_unexpected_privileged_users(table: Table) -> DataFrame:
    members = table("run_group_members").filter(
        (F.col("source") == "getent") & F.col("groupname").isin(C.ADMIN_GROUPS) & (F.col("member_username") != "root"))
    expected = table("host_inventory").select("hostname", F.col("primary_ip"))
    return current_runs(table).join(members, "run_id").join(expected, "hostname", "left").select(
        "hostname", "groupname", "member_username",
        F.when(F.col("primary_ip").isNotNull(), "baseline_system").otherwise("check_baseline").alias("baseline_status"))


# ---- connected data ---------------------------------------------------------------------------------------

@of_latest_runs
def v_process_sockets(table: Table) -> DataFrame:
    procs = table("run_processes").select("run_id", "pid", "ppid", "uid", "cmd")
    socks = table("run_listening_sockets").select(
        "run_id", "pid", "proto", "local_addr", "local_port", "peer_addr", "peer_port", "state", "process_name")
    return current_runs(table).join(procs, "run_id").join(socks, ["run_id", "pid"], "left").drop("run_id", "asset_id")


@of_latest_runs
def v_usb_kernel_drivers(table: Table) -> DataFrame:
    drivers = literal_map(C.USB_VENDOR_DRIVERS)
    return current_runs(table).join(table("run_usb_devices"), "run_id").select(
        "hostname", "bus_number", "device_number", "vendor_id", "product_id", "vendor_name", "product_name", "device_class",
        "device_subclass", "manufacturer", "product", "serial_number",
        F.coalesce(F.try_element_at(drivers, F.col("vendor_id")), F.lit("unknown")).alias("likely_kernel_module"))


@of_latest_runs
def v_interface_processes(table: Table) -> DataFrame:
    ifaces = table("run_interfaces").select("run_id", "ifname", "mac_addr")
    addrs = table("run_interface_addrs").select("run_id", "ifname", "family", "address", "scope")
    socks = table("run_listening_sockets").select("run_id", F.col("local_addr").alias("address"), "pid", "proto", "local_port", "state")
    procs = table("run_processes").select("run_id", "pid", "uid", "cmd")
    return (
        current_runs(table).join(ifaces, "run_id").join(addrs, ["run_id", "ifname"], "left")
        .join(socks, ["run_id", "address"], "left")
        .join(procs.withColumn("owner", F.col("pid")), ["run_id", "pid"], "left")
        .select("hostname", "ifname", "mac_addr", "family", "address", "scope", F.col("owner").alias("pid"), "uid", "cmd",
                "proto", "local_port", "state")
    )


def _modinfo_pivot(table: Table, keys: list[str]) -> DataFrame:
    rows = table("run_modinfo_kv").filter(F.col("k").isin(keys))
    return rows.groupBy("run_id", "module").agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(k) for k in keys])


@of_latest_runs
def v_module_hardware(table: Table) -> DataFrame:
    """Modules with the USB and GPU devices of the same run. Device names are listed per run first; the
    USB x GPU x module product is never built."""
    usb = _of_latest(table, "run_usb_devices").groupBy("run_id").agg(
        F.array_join(F.array_sort(F.collect_set("product_name")), ",").alias("usb_devices"))
    gpu = _of_latest(table, "run_gpu_devices").groupBy("run_id").agg(
        F.array_join(F.array_sort(F.collect_set("description")), ",").alias("gpu_devices"))
    modules = table("run_lsmod").select("run_id", "module", "size", "used_by_count", "used_by").distinct()
    return (
        current_runs(table).join(modules, "run_id").join(_modinfo_pivot(table, ["license", "signer", "description"]), ["run_id", "module"], "left")
        .join(usb, "run_id", "left").join(gpu, "run_id", "left")
        .select("hostname", "module", "size", "used_by_count", "used_by", F.nullif("usb_devices", F.lit("")).alias("usb_devices"),
                F.nullif("gpu_devices", F.lit("")).alias("gpu_devices"), "license", "signer", "description")
    )


# ---- rarity across the fleet ------------------------------------------------------------------------------

def _rare(rows: DataFrame, keys: list[str], max_hosts: int, instances: bool = True) -> DataFrame:
    """Rows whose key occurs on one asset or two at most, with host and instance counts.

    Counting goes (key, asset) -> key, so a key on every host is reduced on the map side. The same aggregate keeps the first and last asset
    of a key; rows of rare keys are then fetched by (asset, key), so a value that is on every host is in no join key. Null keys are equal.
    """
    assert max_hosts <= 2
    key = F.struct(*keys)
    keyed = rows.withColumn("_key", key)
    per_host = keyed.groupBy("_key", "asset_id").agg(F.count(F.lit(1)).alias("n"))
    counts = per_host.groupBy("_key").agg(
        F.count(F.lit(1)).alias("host_count"), F.sum("n").alias("total_instances"), F.min("asset_id").alias("a"), F.max("asset_id").alias("b"))
    rare = counts.filter(F.col("host_count") <= max_hosts).withColumn("asset_id", F.explode(F.array_distinct(F.array("a", "b")))).drop("a", "b")
    if not instances:
        rare = rare.drop("total_instances")
    return keyed.join(rare, ["asset_id", "_key"]).drop("_key")


def rare_command(cmd: Column | str) -> Column:
    """Command lines that count: not from system directories, no kernel threads, more than ten characters."""
    c = F.col(cmd) if isinstance(cmd, str) else cmd
    lower = F.lower(c)
    return ~starts_with_any(lower, C.SYSTEM_COMMAND_DIRS) & ~c.rlike(r"(?s)^\[.*\]") & (F.length(c) > 10)


@of_latest_runs
def v_rare_processes(table: Table) -> DataFrame:
    rows = current_runs(table).join(table("run_processes").filter(rare_command("cmd")).select("run_id", "cmd", "pid", "uid", "ppid"), "run_id")
    return _rare(rows, ["cmd"], 2).select("hostname", "cmd", "host_count", "total_instances", "pid", "uid", "ppid")


@of_latest_runs
def v_rare_usb_devices(table: Table) -> DataFrame:
    """Devices whose id and names occur on two assets at most, with the hosts that have just those."""
    usb = table("run_usb_devices").filter("vendor_id IS NOT NULL AND product_id IS NOT NULL")
    rows = current_runs(table).join(usb, "run_id").withColumn("device_id", F.concat_ws(":", "vendor_id", "product_id"))
    return _rare(rows, ["device_id", "vendor_name", "product_name"], 2).select(
        "hostname", "device_id", "vendor_name", "product_name", "host_count", "bus_number", "device_number", "serial_number")


@of_latest_runs
def v_rare_kernel_modules(table: Table) -> DataFrame:
    rows = current_runs(table).join(table("run_lsmod").select("run_id", "module", "size", "used_by_count", "used_by"), "run_id")
    info = table("run_modinfo_kv").filter("k IN ('description', 'license')")
    part = lambda k: info.filter(F.col("k") == k).select("run_id", "module", F.col("v").alias(k))
    return (
        _rare(rows, ["module"], 2).join(part("description"), ["run_id", "module"], "left").join(part("license"), ["run_id", "module"], "left")
        .select("hostname", "module", "host_count", "total_instances", "size", "used_by_count", "used_by", "description", "license")
    )


@of_latest_runs
def v_unique_mounts(table: Table) -> DataFrame:
    m = F.col("mountpoints")
    devices = table("run_block_devices").filter(m.isNotNull() & (m != "") & ~starts_with_any(F.lower(m), C.HIDDEN_MOUNTS))
    rows = current_runs(table).join(devices.select("run_id", "mountpoints", "name", "type"), "run_id")
    return _rare(rows, ["mountpoints"], 1).select("hostname", "mountpoints", "name", "type")


# ---- drift from expectations ------------------------------------------------------------------------------

def v_memory_drift(table: Table) -> DataFrame:
    now = F.col("mem_total_bytes") / F.lit(GB)
    want = F.col("memory_capacity_gb")
    expected = table("host_inventory").select("hostname", "memory_capacity_gb")
    return table("v_asset_current").join(expected, "hostname", "left").select(
        "hostname", F.format_string("%.1f", F.coalesce(now, F.lit(0.0))).alias("current_gb"), want.alias("expected_gb"),
        F.when(want.isNull(), "unknown").when(F.abs(now - want) < 0.5, "normal").when(now > want, "increased")
        .otherwise("decreased").alias("status"),
        F.abs(now - want).alias("drift_gb"))


def v_cpu_drift(table: Table) -> DataFrame:
    expected = table("host_inventory").select("hostname", "proc_no_cores", "proc_count")
    return table("v_asset_current").join(expected, "hostname", "left").select(
        "hostname", F.col("proc_no_cores").alias("expected_cores"), F.col("proc_count").alias("expected_sockets"), "operating_system",
        F.when(F.col("proc_no_cores").isNull(), "unknown").otherwise("baseline_loaded").alias("baseline_status"))


@of_latest_runs
def v_storage_drift(table: Table) -> DataFrame:
    """Disk capacity against the expected total, both in binary units; unknown when no disk was observed. A kind of disk that the inventory
    does not state counts as none."""
    parts = ["storage_hdd_capacity_gb", "storage_nvme_capabity_gb", "storage_ssd_capabity_gb"]
    any_known = F.coalesce(*parts).isNotNull()
    expected = table("host_inventory").filter(any_known).select(
        "hostname", sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)).alias("want_gb"))
    disks = _of_latest(table, "run_block_devices").filter("type = 'disk'").groupBy("run_id").agg(
        F.sum(F.col("size_bytes") / F.lit(float(1024**4))).alias("now_tb"))
    ac = table("v_asset_current").select("hostname", F.col("last_run_id").alias("run_id"))
    want = F.col("want_gb") / 1024.0
    return ac.join(disks, "run_id", "left").join(expected, "hostname", "left").select(
        "hostname", F.format_string("%.2f", F.coalesce("now_tb", F.lit(0.0))).alias("current_tb"), want.alias("expected_tb"),
        F.when(F.col("want_gb").isNull(), "no_baseline").when(F.col("now_tb").isNull(), "unknown")
        .when(F.abs(F.col("now_tb") - want) < 0.1, "normal").otherwise("drift_detected").alias("status"))


def v_os_drift(table: Table) -> DataFrame:
    expected = table("host_inventory").select(
        "hostname", F.col("os_name").alias("expected_os_name"), F.col("os_version").alias("expected_os_version"))
    matches = F.contains(F.lower("operating_system"), F.lower("expected_os_name"))
    return table("v_asset_current").join(expected, "hostname", "left").select(
        "hostname", F.col("operating_system").alias("current_os"), "expected_os_name", "expected_os_version",
        F.when(F.col("expected_os_name").isNull(), "no_baseline").when(matches, "matches").otherwise("os_changed").alias("status"))


VIEWS = [
    v_latest_runs, v_asset_current, primary_ipv4, primary_mac, v_host_inventory_current, v_asset_previous_run,
    v_run_delta_privileged_members, v_failed_logins_recent, v_accounts_never_logged_in_with_keys,
    v_asset_security_summary, v_process_sockets, v_usb_kernel_drivers, v_interface_processes, v_module_hardware,
    v_rare_processes, v_rare_usb_devices, v_rare_kernel_modules, v_unique_mounts, v_memory_drift, v_cpu_drift,
    v_storage_drift, v_os_drift, v_unexpected_privileged_users,
]
