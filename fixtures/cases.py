"""Queries and their expected results: name -> (Spark query, DuckDB SQL over the driver tables).

The Spark side renders the driver tables into snapshot text, splits and parses that text and runs the
operator. The SQL side never sees any text: it states the expected rows from the tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixtures.facts import Dialect, div, facts, i, s, with_facts
from fixtures.render import RenderedFleet, fleet, render
from fleetlens.functions.scalars import ISO
from fleetlens.plans.fleet import EXTRACTIONS

DUCK = Dialect("duckdb")
FACTS = facts(DUCK)
GB = "1073741824"


@dataclass
class Case:
    spark: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CASES: dict[str, Case] = {}


def plain(df: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """Comparable columns: timestamps as ISO text, arrays as JSON text, booleans as 0/1."""
    cols = []
    for name, kind in df.dtypes:
        if name in drop:
            continue
        c = F.col(f"`{name}`")
        if kind.startswith("timestamp"):
            c = F.date_format(c, ISO)
        elif kind.startswith("array"):
            c = F.to_json(c)
        elif kind == "boolean":
            c = c.cast("int")
        cols.append(c.alias(name))
    return df.select(*cols)


def utc(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def case(name: str, fn: Callable[[RenderedFleet], DataFrame], sql: str | None, stored: bool = True, drop: tuple[str, ...] = ()) -> None:
    """Register a query over a fleet."""
    CASES[name] = Case(
        lambda spark, sf_dir: plain(fn(fleet(utc(spark), sf_dir, stored)), drop),
        None if sql is None else with_facts(sql, FACTS))


def extraction(name: str, sql: str, drop: tuple[str, ...] = ()) -> None:
    """Register an extraction job: from rendered text to typed rows, nothing stored in between."""
    case(name, lambda f: f(name), sql, stored=False, drop=drop)


def R(fact: str) -> str:
    """A fact with the columns of its run."""
    return f"{fact} f JOIN fx_runs x ON f.h = x.h AND f.r = x.r"


def json_list(expr: str, condition: str = "true") -> str:
    return f"CAST(to_json(coalesce(list({expr} ORDER BY {expr}) FILTER (WHERE {condition}), [])) AS STRING)"


def iso(ts: str) -> str:
    return DUCK.iso(ts)


def union(*selects: str) -> str:
    return "\nUNION ALL ".join(selects)


# ---- 2.3 extraction jobs ----------------------------------------------------------------------------------

extraction("run_hostinfo", f"""SELECT x.run_id, x.hostname AS static_hostname, 'computer-server' AS icon_name, 'server' AS chassis, x.machine_id, md5(x.path) AS boot_id,
    CASE WHEN x.bal > 3000 THEN 'Ubuntu' ELSE 'Rocky Linux' END || ' 22.0' || {s('x.nation % 5')} AS operating_system, q.os_name, q.os_version, 'os' || {s('x.nation')} AS os_id,
    'Linux 5.' || {s('x.nation')} || '.' || {s('x.r')} AS kernel, 'x86-64' AS architecture, 'Vendor ' || x.s_name AS hardware_vendor, 'M' || {s('x.nation')} AS hardware_model
    FROM fx_runs x JOIN fx_host q ON q.run_id = x.run_id""")
extraction("asset_domain", f"SELECT run_id, 'node' || {s('h')} || '.fleet' || {s('nation')} || '.example' AS fqdn, 'fleet' || {s('nation')} || '.example' AS domain FROM fx_runs")
extraction("run_os_release_kv", union("SELECT run_id, 'NAME' AS k, os_name AS v FROM fx_host", "SELECT run_id, 'VERSION_ID', os_version FROM fx_host", f"SELECT run_id, 'ID', 'os' || {s('nation')} FROM fx_host"))
extraction("run_kernel_cmdline_kv", union(
    "SELECT run_id, 'BOOT_IMAGE' AS k, '/vmlinuz-' || kernel AS v FROM fx_host", f"SELECT run_id, 'root', 'UUID=' || {s('h')} FROM fx_host",
    "SELECT run_id, 'ro', '1' FROM fx_host", "SELECT run_id, 'quiet', '1' FROM fx_host", "SELECT run_id, 'audit', audit_enabled FROM fx_host"))
extraction("run_sysctl_kv", union(f"SELECT run_id, 'kernel.kptr_restrict' AS k, {s('nation % 3')} AS v FROM fx_host", f"SELECT run_id, 'net.ipv4.ip_forward', {s('two_routes')} FROM fx_host"))
extraction("run_secure_boot", """SELECT run_id, CASE WHEN bal > 5000 THEN 1 WHEN bal > 1000 THEN 0 END AS secure_boot_enabled,
    CASE WHEN bal > 5000 THEN 'SecureBoot enabled' WHEN bal > 1000 THEN 'Secure Boot Disabled' ELSE 'EFI variables are not supported' END AS raw_text FROM fx_host""")
extraction("run_uname", f"SELECT run_id, 'Linux n 5.' || {s('nation')} || '.' || {s('r')} || ' #1 SMP x86_64 GNU/Linux' AS uname_a FROM fx_host")
extraction("run_timedate", f"""SELECT run_id, {iso('ts')} AS local_time, {iso('ts')} AS universal_time, 'ok' AS rtc_time, time_zone,
    CASE WHEN bal > 100 THEN 'yes' ELSE 'no' END AS system_clock_synchronized, 'active' AS ntp_service, 'no' AS rtc_in_local_tz FROM fx_runs""")
extraction("run_ntp_servers", union(
    f"SELECT run_id, 'ntp' AS server_type, 'ntp' || {s('nation')} || '.example' AS server_address, 'iburst prefer' AS options, 0 AS pool FROM fx_host",
    "SELECT run_id, 'ntp', 'pool.example', NULL, 1 FROM fx_host", f"SELECT run_id, 'chrony', 'chrony' || {s('nation')} || '.example', 'iburst', 0 FROM fx_host",
    "SELECT run_id, 'timesyncd', 't1.example', NULL, 0 FROM fx_host", f"SELECT run_id, 'timesyncd', 't' || {s('nation')} || '.example', NULL, 0 FROM fx_host WHERE nation <> 1",
    "SELECT run_id, 'timesyncd', 'fb.example', NULL, 0 FROM fx_host"))
extraction("run_uptime", f"""SELECT run_id, '10:00:00 up 3 days,  2 users,  load average: 0.' || {s('nation')} || ', 1.5, ' || {s('nation')} || '.25' AS raw_line,
    CAST('0.' || {s('nation')} AS DOUBLE) AS load_1, CAST(1.5 AS DOUBLE) AS load_5, CAST(nation + 0.25 AS DOUBLE) AS load_15 FROM fx_host""")
extraction("run_memory", f"""SELECT run_id, mem_gb::BIGINT * {GB} AS mem_total_bytes, 5::BIGINT * {GB} // 2 AS mem_used_bytes, {GB}::BIGINT // 2 AS mem_free_bytes, mem_gb::BIGINT * {GB} AS mem_available_bytes,
    swap_gb::BIGINT * {GB} AS swap_total_bytes, 0::BIGINT AS swap_used_bytes, NULL::BIGINT AS swap_free_bytes FROM fx_host""")
T4 = "1099511627776"
extraction("run_block_devices", union(
    f"SELECT run_id, 'sda' AS name, 'disk' AS type, NULL AS parent_name, disk_tb::BIGINT * {T4} AS size_bytes, 0 AS rm, 0 AS ro, '' AS mountpoints, 'sda           8:0    0 ' || {s('disk_tb')} || 'T  0 disk' AS raw_line FROM fx_host",
    "SELECT run_id, 'sda1', 'part', 'sda', 536870912, 0, 0, '/boot/efi', '├─sda1        8:1    0  512M  0 part /boot/efi' FROM fx_host",
    f"SELECT run_id, 'sda2', 'part', 'sda', {T4}, 0, 0, '', '└─sda2        8:2    0    1T  0 part' FROM fx_host",
    f"SELECT run_id, 'vg-root', 'lvm', 'sda2', 900::BIGINT * {GB}, 0, 0, '/data/h' || {s('h')}, '  └─vg-root 253:0    0  900G  0 lvm  /data/h' || {s('h')} FROM fx_host",
    f"SELECT run_id, 'sr0', 'rom', NULL, {GB}, 1, 0, '', 'sr0          11:0    1 1024M  0 rom' FROM fx_host",
    f"SELECT run_id, 'nvme0n1', 'disk', NULL, 500::BIGINT * {GB}, 0, 0, '/scratch', 'nvme0n1     259:0    0  500G  0 disk /scratch' FROM fx_host"))
extraction("run_df_mounts", union("SELECT run_id, '/dev/sda2' AS filesystem, mem_gb::BIGINT * 1000 AS size_bytes, 400 AS used_bytes, 600 AS avail_bytes, '40%' AS use_pct, '/' AS mountpoint FROM fx_host",
    f"SELECT run_id, 'tmpfs', NULL, NULL, NULL, '1%', '/mnt/h ' || {s('h')} FROM fx_host"))
extraction("run_dmi_system", f"""SELECT run_id, 'Maker ' || s_name AS manufacturer, 'Model ' || {s('nation')} AS product_name, NULL AS version,
    CASE WHEN h % 17 = 0 THEN NULL ELSE md5('sn' || s_name) END AS serial_number, uuid, NULL AS sku_number, 'F1' AS family FROM fx_runs""")
GPU_NAME = f"CASE nation % 3 WHEN 0 THEN 'NVIDIA Corporation' WHEN 1 THEN 'Intel Corporation' ELSE 'Matrox' END || ' G' || {s('nation')}"
extraction("run_gpu_devices", f"""SELECT run_id, '00:02.0' AS slot, 'VGA compatible controller' AS class, 'VGA compatible controller: ' || {GPU_NAME} AS description,
    CASE nation % 3 WHEN 0 THEN 'NVIDIA Corporation' WHEN 1 THEN 'Intel Corporation' END AS vendor, {GPU_NAME} AS device, 'drv' || {s('nation % 4')} AS kernel_driver_in_use,
    '00:02.0 VGA compatible controller: ' || {GPU_NAME} || chr(10) || chr(9) || 'Flags: bus master' || chr(10) || chr(9) || 'Kernel driver in use: drv' || {s('nation % 4')} AS raw_block FROM fx_host""")
extraction("run_lshw_devices", union(
    "SELECT run_id, 1 AS depth, 'core' AS class, NULL AS logical_name, 'Motherboard' AS description, NULL AS product, NULL AS vendor, NULL AS physical_id, NULL AS bus_info, NULL AS slot, NULL AS size, NULL AS capacity, NULL AS serial, NULL AS version, NULL::INT AS width_bits, NULL::BIGINT AS clock_hz, '*-core' AS raw_line FROM fx_host",
    f"SELECT run_id, 2, 'cpu', '0', NULL, 'CPU ' || {s('nation')}, 'Intel Corp.', '4', 'cpu@0', NULL, NULL, {s('nation + 2')} || 'GHz', NULL, NULL, 64, (nation + 2) * 1000000000::BIGINT, '*-cpu:0' FROM fx_host",
    "SELECT run_id, 2, 'cpu', '1', NULL, 'second', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, '*-cpu:1' FROM fx_host",
    f"SELECT run_id, 2, 'memory', NULL, NULL, NULL, NULL, NULL, NULL, NULL, {s('mem_gb')} || 'GiB', NULL, NULL, NULL, NULL, NULL, '*-memory' FROM fx_host"), drop=("node_no",))
USB_COLS = """f.bus_number, f.device_number, f.vendor_id, f.product_id, f.device_class, 0 AS device_subclass, NULL::INT AS device_protocol, f.vendor_name, f.product_name,
    '1 Maker Inc' AS manufacturer, NULL AS product, f.serial_number, '2.00' AS usb_version, NULL AS max_power, f.device_class_label"""
extraction("run_usb_devices", f"SELECT x.run_id, {USB_COLS} FROM {R('fx_usb')}")
extraction("run_users", f"SELECT x.run_id, f.username, f.uid, f.gid, f.gecos, f.home, f.shell FROM {R('fx_users')}")
extraction("run_groups", f"SELECT x.run_id, f.groupname, f.gid, f.members_csv, CASE WHEN f.gid >= 1000 THEN 'user' ELSE 'rare' END AS group_type FROM {R('fx_groups')}")
extraction("run_priv_groups", f"SELECT x.run_id, f.groupname, f.gid, f.members_csv, 'getent' AS source, 'service' AS group_type FROM {R('fx_priv_groups')}")
extraction("run_passwd_status", f"SELECT x.run_id, f.username, f.status_code, f.last_change, f.min_age, f.max_age, f.warn, f.inactive, NULL AS expire FROM {R('fx_passwd_status')}")
MEMBERS = union(f"SELECT x.run_id, 'etc_group' AS source, 'grp' || {s('f.nation')} AS groupname, f.username AS member_username, f.uid AS member_uid FROM {R('fx_users')}",
                f"SELECT x.run_id, 'getent', f.groupname, f.username, f.uid FROM {R('fx_priv_members')}")
case("run_group_members", lambda f: f("run_group_members"), MEMBERS, stored=False)
extraction("run_who_lines", union(
    "SELECT run_id, 1 AS line_no, 'system_boot' AS record_type, NULL AS username, NULL AS tty, NULL AS event_time, NULL::INT AS pid, NULL AS remote_host, '           system boot  2024-01-15 10:00' AS raw_line FROM fx_runs",
    "SELECT run_id, 2, 'run_level', NULL, NULL, NULL, NULL, NULL, '           run-level 5  2024-01-15 10:00' FROM fx_runs",
    f"""SELECT x.run_id, 2 + row_number() OVER (PARTITION BY x.run_id ORDER BY f.k), CASE f.event_type WHEN 'error' THEN 'login' ELSE 'user' END, CASE f.event_type WHEN 'error' THEN NULL ELSE f.username END,
        CASE WHEN f.event_type IN ('error', 'click') THEN NULL ELSE f.tty END, CASE WHEN f.event_type IN ('error', 'click') THEN NULL ELSE '2024-01-1' || {s('f.k % 9')} || ' 10:' || {s('f.k % 50 + 10')} END,
        CASE WHEN f.event_type IN ('error', 'click') THEN NULL ELSE {i('f.k')} END, CASE WHEN f.event_type IN ('error', 'click') THEN NULL ELSE f.remote_host END,
        CASE f.event_type WHEN 'error' THEN 'LOGIN      tty1         2024-01-15 10:00   ' || {s('f.k')} WHEN 'click' THEN f.username || ' + ' || f.tty || ' x'
            ELSE f.username || ' ' || f.tty || '  2024-01-1' || {s('f.k % 9')} || ' 10:' || {s('f.k % 50 + 10')} || ' pid=' || {s('f.k')} || ' (' || f.remote_host || ')' END FROM {R('fx_events')}"""))
extraction("run_w_sessions", f"""SELECT x.run_id, f.username, f.tty, f.remote_host AS from_host, '10:0' || {s('f.k % 9')} AS login_at, '1:00' AS idle, '0.1s' AS jcpu, '0.2s' AS pcpu, 'vim  ' || {s('f.k')} AS what,
    f.username || '  ' || f.tty || '  ' || f.remote_host || '  10:0' || {s('f.k % 9')} || '  1:00  0.1s  0.2s  vim  ' || {s('f.k')} AS raw_line FROM {R('fx_events')}""")
extraction("run_lastlog", f"""SELECT x.run_id, f.username, f.port, f.from_host, f.latest,
    CASE WHEN f.port IS NULL THEN f.username || '                          **Never logged in**' ELSE f.username || '   ' || f.port || '   ' || f.from_host || '   ' || f.latest END AS raw_line FROM {R('fx_lastlog')}""")
LAST_LINE = """f.username || ' ' || f.tty || ' ' || f.remote_host || ' ' || f.start_text || CASE WHEN f.status_text = 'still_logged_in' THEN '   still logged in' WHEN f.status_text = 'gone_no_logout' THEN '   gone - no logout'
    ELSE ' - ' || f.end_text || '  (' || f.duration_text || ')' END"""
extraction("run_last_events", f"SELECT DISTINCT x.run_id, f.source, f.username, f.tty, f.remote_host, f.start_text, f.end_text, f.duration_text, f.status_text, {LAST_LINE} AS raw_line FROM {R('fx_logins')}")
FAILED = f"SELECT DISTINCT x.run_id, f.username, f.remote_host, f.tty, f.status_text AS state_text, f.minute_ts AS attempt_ts, f.start_text AS raw_start_text, {LAST_LINE} AS raw_line FROM {R('fx_logins')} WHERE f.source = 'btmp'"
extraction("run_failed_logins", f"SELECT run_id, username, remote_host, tty, state_text, {iso('attempt_ts')} AS attempt_time_utc, raw_start_text, raw_line FROM ({FAILED}) q")
case("ref_tty", lambda f: f("ref_tty"), "SELECT DISTINCT tty AS tty_value, CASE WHEN tty LIKE '%pts%' THEN 'pts' WHEN tty LIKE 'tty%' THEN 'tty' ELSE 'other' END AS tty_kind FROM fx_logins WHERE source = 'btmp'")
extraction("run_audit_status", union("SELECT run_id, 'enabled' AS k, audit_enabled AS v FROM fx_host", "SELECT run_id, 'failure', '1' FROM fx_host", "SELECT run_id, 'pid', '77' FROM fx_host"))
RULE1 = f"'-a always,exit -F arch=b64 -F path=/etc/shadow -F perm=wa -F auid>=' || {s('1000 + nation')} || ' -F auid!=-1 -k passwd'"
WATCH = "CASE WHEN bal > 4000 THEN '/usr/bin/sudo' ELSE '/opt/x' END"
CALLS = "CASE WHEN nation > 12 THEN 'settimeofday,stime' ELSE 'openat' END"
extraction("run_audit_rules", union(
    f"SELECT run_id, {RULE1} AS rule_text, 'always' AS action, 'exit' AS list_type, 'b64' AS arch, 'passwd' AS key_name, NULL AS syscall, '/etc/shadow' AS path, 'wa' AS permission, NULL AS uid, NULL AS gid, '>=' || {s('1000 + nation')} AS auid, NULL AS subj, 'file' AS rule_type FROM fx_host",
    f"SELECT run_id, '-w ' || {WATCH} || ' -p x -k priv', NULL, NULL, NULL, 'priv', NULL, {WATCH}, 'x', NULL, NULL, NULL, NULL, 'file' FROM fx_host",
    f"SELECT run_id, '-a always,exit -F arch=b32 -S ' || {CALLS} || ' -F uid=0 -F key=misc', 'always', 'exit', 'b32', 'misc', {CALLS}, NULL, NULL, '0', NULL, NULL, NULL, 'syscall' FROM fx_host",
    "SELECT run_id, '-a never,task -F subj=unconfined_t', 'never', 'task', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'unconfined_t', 'other' FROM fx_host"))
RSYSLOG = f"""'[' || CASE WHEN bal > 1000 THEN '"@@loghost' || {s('nation')} || ':514"' ELSE '' END || CASE WHEN bal > 5000 THEN ', "@[10.0.0.9]:601"' ELSE '' END || ']'"""
extraction("fact_rsyslog", f"SELECT run_id, 'rsyslog' AS fact_group, 'remote_destinations' AS fact_key, {RSYSLOG} AS fact_value FROM fx_host")
JOURNALD = ("SELECT run_id, 'journald' AS fact_group, 'ForwardToSyslog' AS fact_key, 'yes' AS fact_value FROM fx_host", f"SELECT run_id, 'journald', 'ForwardToWall', 'w' || {s('nation')} FROM fx_host")
extraction("fact_journald", union(*JOURNALD))
extraction("run_login_defs_kv", union(f"SELECT run_id, 'PASS_MAX_DAYS' AS k, {s('90 + nation')} AS v FROM fx_host", "SELECT run_id, 'UMASK', '022' FROM fx_host", "SELECT run_id, 'EMPTY_KEY', '' FROM fx_host"))
extraction("run_selinux_status", union("SELECT run_id, 'SELinux status' AS k, CASE WHEN selinux = 'disabled' THEN 'disabled' ELSE 'enabled' END AS v FROM fx_host", "SELECT run_id, 'Current mode', selinux FROM fx_host WHERE selinux <> 'disabled'"))
extraction("run_selinux_booleans", union("SELECT run_id, 'deny_ptrace' AS boolean_name, 'off' AS state FROM fx_host", "SELECT run_id, 'allow_execmem', CASE WHEN bal > 5000 THEN 'on' ELSE 'off' END FROM fx_host", "SELECT run_id, 'httpd_enable_cgi', 'on' FROM fx_host"))
extraction("run_apparmor_status", f"""SELECT run_id, 'apparmor module is loaded.' || chr(10) || {s('profiles_loaded')} || ' profiles are loaded.' || chr(10) || {s('profiles_enforce')} || ' profiles are in enforce mode.' || chr(10) || {s('profiles_complain')} || ' profiles are in complain mode.'
    || chr(10) || '9 processes have profiles defined.' || chr(10) || {s('processes_enforce')} || ' processes are in enforce mode.' || chr(10) || '1 processes are in complain mode.' AS raw_text,
    profiles_loaded, profiles_enforce, profiles_complain, processes_enforce, 1 AS processes_complain FROM fx_host""")
extraction("run_resolv_conf_entries", union("SELECT run_id, 'nameserver' AS entry_type, nameserver AS entry_value, 'nameserver ' || nameserver AS raw_line FROM fx_host", "SELECT run_id, 'search', 'fleet.example', 'search fleet.example' FROM fx_host",
    f"SELECT run_id, 'options', 'ndots:' || {s('nation')}, 'options ndots:' || {s('nation')} FROM fx_host", "SELECT run_id, 'other', '1', 'sortlist 1' FROM fx_host"))
LLADDR = f"CASE WHEN bal > 4000 THEN 'FF:FF:FF:00:00:' ELSE '02:aa:00:00:00:' END || lpad({s('nation')}, 2, '0')"
extraction("run_ip_neigh", union(f"SELECT run_id, '10.0.0.254' AS ip, 'eth0' AS dev, {LLADDR} AS lladdr, 'REACHABLE' AS state, 'private' AS ip_type, '10.0.0.254 dev eth0 lladdr ' || {LLADDR} || ' REACHABLE' AS raw_line FROM fx_host",
    "SELECT run_id, 'fe80::9', 'eth0', NULL, 'FAILED', 'link_local', 'fe80::9 dev eth0 FAILED' FROM fx_host",
    "SELECT run_id, '8.8.4.4', 'eth1', '00:00:00:00:00:00', 'STALE', 'public', '8.8.4.4 dev eth1 lladdr 00:00:00:00:00:00 STALE' FROM fx_host"))
extraction("run_routes", union(
    "SELECT run_id, '0.0.0.0' AS destination, '10.0.0.254' AS gateway, '0.0.0.0' AS genmask, 'UG' AS flags, 100 AS metric, 0 AS ref, 0 AS use, 'eth0' AS iface, 'default' AS dest_type, '0.0.0.0         10.0.0.254      0.0.0.0         UG    100    0        0 eth0' AS raw_line FROM fx_host",
    "SELECT run_id, '0.0.0.0', '10.0.1.254', '0.0.0.0', 'UG', 200, 0, 0, 'eth1', 'default', '0.0.0.0         10.0.1.254      0.0.0.0         UG    200    0        0 eth1' FROM fx_host WHERE two_routes = 1",
    f"SELECT run_id, '10.' || {s('nation')} || '.0.0', '0.0.0.0', '255.255.0.0', 'U', NULL, 0, 0, 'eth0', 'network', '10.' || {s('nation')} || '.0.0        0.0.0.0         255.255.0.0     U     x      0        0 eth0' FROM fx_host",
    "SELECT run_id, '169.254.0.0', '0.0.0.0', '255.255.0.0', 'U', 1000, 0, 0, 'eth0', 'link', '169.254.0.0     0.0.0.0         255.255.0.0     U     1000   0        0 eth0' FROM fx_host"))
WIFI = "CASE WHEN bal > 3000 THEN 'enabled' ELSE 'disabled' END"
extraction("run_nmcli_summary", f"""SELECT run_id, 'connected' AS state, 'full' AS connectivity, 'enabled' AS wifi_hw, {WIFI} AS wifi, 'missing' AS wwan_hw, 'enabled' AS wwan,
    'STATE      CONNECTIVITY  WIFI-HW  WIFI     WWAN-HW  WWAN' || chr(10) || 'connected  full          enabled  ' || {WIFI} || '  missing  enabled' AS raw_text FROM fx_host""")
# start times: a clock later than the run belongs to the day before; the host's zone is applied
LOCAL = "(x.ts + to_seconds(x.utc_offset))"
CLOCK = f"(date_trunc('day', {LOCAL}) + to_seconds(CASE f.start_kind WHEN 1 THEN 36000 ELSE 85800 END + (f.k % 10) * 60))"
START = f"CASE WHEN f.start_kind = 3 THEN TIMESTAMP '2024-01-01 00:00:00' + to_seconds((f.k % 9) * 86400) WHEN {CLOCK} > {LOCAL} THEN {CLOCK} - INTERVAL 1 DAY ELSE {CLOCK} END - to_seconds(x.utc_offset)"
PROCESSES = f"""SELECT x.run_id, f.pid, f.ppid, f.uid, '?' AS tty, 'S' AS stat, f.start, {iso(START)} AS start_normalized_utc, '00:00:01' AS time, f.cmd, f.process_name, f.process_path, f.process_arguments,
    CASE WHEN f.ppid = 1 THEN 'init' ELSE p.process_name END AS parent_process_name, CASE WHEN f.ppid = 1 THEN '/sbin/init' ELSE p.process_path END AS parent_process_path,
    '4 S ' || f.uid || ' ' || {s('f.pid')} || ' ' || {s('f.ppid')} || '  0  80   0 - 41000 -    ' || f.start || ' ?        00:00:01 ' || f.cmd AS raw_line
    FROM fx_cmds f JOIN fx_runs x ON f.h = x.h AND f.r = x.r LEFT JOIN fx_cmds p ON p.h = f.h AND p.r = f.r AND p.pid = f.ppid
    UNION ALL SELECT x.run_id, 1, 0, 'root', '?', 'S', '10:00', {iso(f"CASE WHEN date_trunc('day', {LOCAL}) + to_seconds(36000) > {LOCAL} THEN date_trunc('day', {LOCAL}) - to_seconds(50400) ELSE date_trunc('day', {LOCAL}) + to_seconds(36000) END - to_seconds(x.utc_offset)")},
    '00:00:01', '/sbin/init splash', 'init', '/sbin/init', 'splash', '', '', '4 S root 1 0 0 80 0 - 41000 - 10:00 ? 00:00:01 /sbin/init splash' FROM fx_runs x"""
extraction("run_processes", PROCESSES)
extraction("run_pstree_lines", union("SELECT run_id, 1 AS line_no, 'systemd-+-cron' AS raw_line FROM fx_host", f"SELECT run_id, 2, '        |-sshd-' || {s('nation')} FROM fx_host"))
MODULES = f"SELECT x.run_id, f.module, f.size, f.used_by_count, f.used_by, rtrim(f.module || '   ' || {s('f.size')} || '  ' || {s('f.used_by_count')} || ' ' || f.used_by) AS raw_line FROM {R('fx_modules')}"
extraction("run_lsmod", MODULES)
extraction("run_modinfo_kv", union(f"SELECT x.run_id, f.module, 'filename' AS k, '/lib/' || f.module || '.ko' AS v FROM {R('fx_modules')}", f"SELECT x.run_id, f.module, 'license', f.license FROM {R('fx_modules')}",
    f"SELECT x.run_id, f.module, 'signer', f.signer FROM {R('fx_modules')}", f"SELECT x.run_id, f.module, 'description', f.description FROM {R('fx_modules')}"))
FILE_LINE = f"f.perms || ' 1 root adm ' || {s('f.size_bytes')} || ' ' || f.mtime_text || ' ' || f.name || CASE WHEN f.symlink_target IS NOT NULL THEN ' -> ' || f.symlink_target ELSE '' END"
extraction("run_file_listings", f"""SELECT f.run_id, f.source, f.directory, f.path, f.perms, f.perm_octal, f.owner, f.grp, f.size_bytes, f.mtime_text, {iso('f.mtime_utc')} AS mtime_normalized_utc, f.name, f.name AS filename,
    f.file_type, f.is_symlink, f.symlink_target, {FILE_LINE} AS raw_line FROM fx_files f""")
case("ref_permissions", lambda f: f("ref_permissions"), "SELECT DISTINCT perms AS perm_rwx, perm_octal, file_type AS perm_kind FROM fx_files")
extraction("run_ld_preload_entries", f"SELECT run_id, '/lib/libx' || {s('nation')} || '.so' AS entry FROM fx_host")
extraction("run_file_capabilities", f"SELECT run_id, '/usr/bin/tool' || {s('nation')} AS path, 'cap_net_raw+ep' AS caps FROM fx_host")
extraction("run_containers", union(
    f"SELECT x.run_id, 'docker' AS runtime, f.container_id, f.image, f.status, f.names, f.created_text, NULL AS ports_text, f.container_id || '   ' || f.image || '   \"cmd\"   ' || f.created_text || '   ' || f.status || '   ' || f.names AS raw_line FROM {R('fx_containers')}",
    f"SELECT x.run_id, 'podman', f.container_id, 'pod', 'Up 2 days', 'p' || {s('f.k')}, '3 days ago', NULL, f.container_id || '  pod  \"run\"  3 days ago  Up 2 days  p' || {s('f.k')} FROM {R('fx_pods')}"))
extraction("run_container_summary", union(
    f"SELECT x.run_id, 'docker' AS runtime, 'containers_ps_a_count' AS k, {s('count(*)')} AS v FROM {R('fx_containers')} GROUP BY x.run_id", f"SELECT x.run_id, 'podman', 'containers_ps_a_count', {s('count(*)')} FROM {R('fx_pods')} GROUP BY x.run_id",
    f"SELECT run_id, 'docker', 'Server Version', '24.0.' || {s('nation')} FROM fx_host", "SELECT run_id, 'docker', 'Containers', '5' FROM fx_host", "SELECT run_id, 'podman', 'host', '' FROM fx_host",
    "SELECT run_id, 'podman', 'arch', 'amd64' FROM fx_host", f"SELECT run_id, 'podman', 'cpus', {s('nation')} FROM fx_host"))
KEY_LINE = "f.key_type || ' ' || base64(encode(f.blob)) || ' ' || f.key_comment"
KEYS = union(f"SELECT x.run_id, f.username, f.key_type, sha256(f.blob) AS key_fingerprint_sha256, f.key_comment, sha256({KEY_LINE}) AS raw_line_hash_sha256 FROM {R('fx_keys')}",
    f"SELECT run_id, 'root', 'ssh-rsa', sha256('ssh-rsa !!not-base64!! root@' || {s('h')}), 'root@' || {s('h')}, sha256('ssh-rsa !!not-base64!! root@' || {s('h')}) FROM fx_runs")
extraction("run_ssh_authorized_keys", KEYS)
extraction("run_ssh_host_keys", union("SELECT run_id, 256 AS bits, 'SHA256:' || md5(s_name) AS fingerprint, 'root@h' AS key_file, 'ED25519' AS key_type, '256 SHA256:' || md5(s_name) || ' root@h (ED25519)' AS raw_line FROM fx_runs",
    "SELECT run_id, 3072, 'SHA256:' || md5('rsa' || s_name), 'root@h', 'RSA', '3072 SHA256:' || md5('rsa' || s_name) || ' root@h (RSA)' FROM fx_runs"))
PW_AUTH, ROOT_LOGIN = "CASE WHEN bal > 3000 THEN 'yes' ELSE 'no' END", "CASE WHEN nation > 12 THEN 'no' ELSE 'prohibit-password' END"
extraction("run_sshd_config_kv", union(f"SELECT run_id, 'passwordauthentication' AS k, {PW_AUTH} AS v FROM fx_host", f"SELECT run_id, 'permitrootlogin', {ROOT_LOGIN} FROM fx_host", "SELECT run_id, 'usedns', '' FROM fx_host", f"SELECT run_id, 'maxsessions', '1 ' || {s('nation')} FROM fx_host"))
extraction("run_sudoers_rules", union("SELECT run_id, 'Defaults env_reset' AS rule_text, 'Defaults' AS rule_type FROM fx_host", "SELECT run_id, 'root ALL=(ALL:ALL) ALL', 'User_Host' FROM fx_host",
    f"SELECT run_id, '%grp' || {s('nation')} || ' ALL = (ALL) NOPASSWD: ALL', 'User_Host' FROM fx_host", "SELECT run_id, 'Cmnd_Alias X = /bin/x', 'Cmnd' FROM fx_host", f"SELECT run_id, 'user' || {s('h')} || ' ALL=(root) NOPASSWD: /bin/ls', 'User_Host' FROM fx_host"))


def _auth(source: str, condition: str) -> str:
    n = lambda t: f"count(*) FILTER (WHERE f.event_type = '{t}')"
    return f"""SELECT x.run_id, '{source}' AS source, {n('error')} AS failed_password_count, {n('signup')} AS invalid_user_count, {n('click')} AS accepted_password_count, {n('view')} AS accepted_publickey_count,
        {n('purchase')} AS sudo_count, {n('error')} AS error_count, count(*) AS raw_line_count FROM {R('fx_events')} WHERE {condition} GROUP BY x.run_id"""


extraction("run_auth_log_stats", union(_auth("journalctl_ssh", "true"), _auth("auth_log", "f.value < 50"), _auth("secure", "f.value >= 50")))
extraction("run_interfaces", union("SELECT run_id, 'lo' AS ifname, NULL AS mac_addr, 'UNKNOWN' AS state, 65536 AS mtu, 'loopback' AS iface_type FROM fx_runs", "SELECT run_id, 'eth0', mac, 'UP', 1500, 'physical' FROM fx_runs",
    "SELECT run_id, 'docker0', '0a:00:00:00:00:01', 'DOWN', 1400, 'docker' FROM fx_runs"))
ADDRS = union("SELECT run_id, 'lo' AS ifname, 'inet' AS family, '127.0.0.1' AS address, 8 AS prefixlen, 'host' AS scope, 'loopback' AS addr_type FROM fx_runs", "SELECT run_id, 'lo', 'inet6', '::1', 128, 'host', 'loopback' FROM fx_runs",
    "SELECT run_id, 'eth0', 'inet', ip, 24, 'global', 'private' FROM fx_runs", "SELECT run_id, 'eth0', 'inet6', 'fe80::1', 64, 'link', 'link_local' FROM fx_runs", "SELECT run_id, 'docker0', 'inet', '172.17.0.1', 16, 'global', 'private' FROM fx_runs")
extraction("run_interface_addrs", ADDRS)
SOCKET_LINE = f"f.proto || '   ' || f.state || ' 0      128    ' || CASE WHEN f.local_addr = '::' THEN '[::]' ELSE f.local_addr END || ':' || {s('f.local_port')} || '   ' || CASE WHEN f.peer_port IS NULL THEN '*:*' ELSE f.peer_addr || ':' || {s('f.peer_port')} END || ' users:((\"' || f.process_name || '\",pid=' || {s('f.pid')} || ',fd=3))'"
SOCKETS = f"SELECT x.run_id, f.proto, f.state, f.local_addr, f.local_port, f.peer_addr, f.peer_port, f.process_name, f.pid, f.bind_scope, {SOCKET_LINE} AS raw_line FROM {R('fx_sockets')}"
extraction("run_listening_sockets", SOCKETS)
case("run_sockets", lambda f: f("run_sockets"), SOCKETS)
extraction("run_services_systemctl", f"SELECT x.run_id, f.unit, f.load, f.active, f.sub, f.description, f.unit_type FROM {R('fx_units')}")
extraction("run_systemd_timers", f"""SELECT x.run_id, 'Mon 2024-01-15 10:00:00 UTC' AS next, '1h left' AS "left", 'Sun 2024-01-14 10:00:00 UTC' AS last, '23h ago' AS passed, f.unit || '.timer' AS unit, f.unit AS activates,
    'Mon 2024-01-15 10:00:00 UTC  1h left  Sun 2024-01-14 10:00:00 UTC  23h ago  ' || f.unit || '.timer  ' || f.unit AS raw_line FROM {R('fx_units')}""")
extraction("run_systemd_enabled_unit_files", f"SELECT x.run_id, f.unit AS unit_file, 'enabled' AS state, CASE WHEN f.active = 'active' THEN 'enabled' ELSE '' END AS preset, f.unit_type FROM {R('fx_units')}")
PACKAGES = union(f"SELECT x.run_id, 'dpkg' AS source, f.name, f.version, f.arch, f.status, f.summary FROM {R('fx_packages')}", f"SELECT x.run_id, 'rpm', f.name, '', '', '', NULL FROM {R('fx_rpms')}")
extraction("run_packages", PACKAGES)
extraction("run_firewall_rules", f"SELECT DISTINCT x.run_id, f.source, f.rule, f.chain, f.target FROM {R('fx_firewall')}")
case("ref_firewall_type", lambda f: f("run_firewall_rules").groupBy(F.col("source").alias("source_tag")).agg(F.count(F.lit(1)).alias("rules")).join(f("ref_firewall_type"), "source_tag"),
     f"""SELECT source AS source_tag, count(*) AS rules, CASE source WHEN 'iptables_s' THEN 'iptables save-style rules (-S)' WHEN 'iptables_list' THEN 'iptables list (-L -n -v)' WHEN 'ufw_raw' THEN 'UFW raw iptables rules' ELSE 'firewalld zone configuration' END AS description
     FROM (SELECT DISTINCT h, r, source, rule FROM fx_firewall) q GROUP BY source""")
extraction("run_nft_ruleset", f"SELECT run_id, CASE WHEN bal > 2000 THEN 'table inet filter {{' ELSE '# no tables' END || chr(10) || '  chain c' || {s('nation')} AS raw_text FROM fx_host")
OS = f"CASE WHEN bal > 3000 THEN 'Ubuntu' ELSE 'Rocky Linux' END || ' 22.0' || {s('nation % 5')}"
extraction("run_facts", union(
    f"SELECT run_id, 'os' AS fact_group, 'operating_system' AS fact_key, {OS} AS fact_value FROM fx_host", "SELECT run_id, 'os', 'kernel', 'Linux ' || kernel FROM fx_host", "SELECT run_id, 'boot', 'audit', audit_enabled FROM fx_host",
    f"SELECT run_id, 'sshd', 'passwordauthentication', {PW_AUTH} FROM fx_host", f"SELECT run_id, 'sshd', 'permitrootlogin', {ROOT_LOGIN} FROM fx_host", "SELECT run_id, 'sudo', 'nopasswd_rule_count', '2' FROM fx_host",
    "SELECT run_id, 'sudo', 'all_all_rule_count', '3' FROM fx_host", f"SELECT run_id, 'rsyslog', 'remote_destinations', {RSYSLOG} FROM fx_host", *JOURNALD, "SELECT run_id, 'firewall', 'nft_has_table', CASE WHEN bal > 2000 THEN '1' ELSE '0' END FROM fx_host"))
assert set(EXTRACTIONS) <= set(CASES), set(EXTRACTIONS) - set(CASES)
