"""Cases for posture, findings, identity, views, playbook, report and snapshot comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixtures.cases import (
    ADDRS, CASES, DUCK, FACTS, FAILED, GB, KEYS, LLADDR, MEMBERS, MODULES, OS, PACKAGES, PROCESSES, PW_AUTH, R, RSYSLOG, SOCKETS,
    USB_COLS, case, iso, json_list, union,
)
from fixtures.facts import div, i, s
from fixtures.render import COMMANDS, block_specs, dialect, rendered
from fleetlens.operators import diff, findings, identity, views
from fleetlens.operators.blocks import split_blocks
from fleetlens.plans import playbook, report
from fleetlens.sources import snapshots as src

# ---- 2.5 posture ------------------------------------------------------------------------------------------

AUDIT = """SELECT run_id, CASE WHEN audit_enabled IN ('1', '2') THEN 1 ELSE 0 END AS audit_enabled, CASE WHEN audit_enabled = '2' THEN 1 ELSE 0 END AS audit_immutable,
    CASE WHEN bal > 4000 THEN 1 ELSE 0 END AS has_critical_auth_rules, 1 AS has_critical_file_rules, CASE WHEN bal > 4000 THEN 1 ELSE 0 END AS has_critical_process_rules,
    CASE WHEN nation > 12 THEN 1 ELSE 0 END AS has_time_change_rules, CASE WHEN bal > 4000 THEN 1 ELSE 0 END AS has_sudo_rules, 1 AS has_passwd_rules, CASE WHEN bal > 4000 THEN 1 ELSE 0 END AS has_executable_rules FROM fx_host"""
SELINUX = """SELECT run_id, CASE WHEN selinux <> 'disabled' THEN 1 ELSE 0 END AS selinux_enabled, CASE WHEN selinux = 'enforcing' THEN 1 ELSE 0 END AS selinux_enforcing, CASE WHEN selinux = 'permissive' THEN 1 ELSE 0 END AS selinux_permissive,
    CASE WHEN selinux = 'disabled' THEN 1 ELSE 0 END AS selinux_disabled, CASE WHEN bal > 5000 THEN '["allow_execmem"]' ELSE '[]' END AS high_risk_booleans_on, CASE WHEN bal > 5000 THEN '["deny_ptrace"]' ELSE '["allow_execmem","deny_ptrace"]' END AS high_risk_booleans_off FROM fx_host"""
APPARMOR = """SELECT run_id, 1 AS apparmor_enabled, 1 AS apparmor_profiles_loaded, CASE WHEN bal > 4000 THEN 1 ELSE 0 END AS apparmor_all_enforcing, CASE WHEN bal > 4000 THEN 0 ELSE 1 END AS apparmor_mixed_mode,
    CASE WHEN bal > 8000 THEN 1 ELSE 0 END AS apparmor_processes_unconfined FROM fx_host"""
NETWORK = f"""SELECT run_id, CASE WHEN nation % 4 = 0 THEN '["8.8.8.8"]' ELSE '[]' END AS unexpected_nameservers, two_routes AS multiple_default_routes, '["Suspicious route to 169.254.0.0 via eth0"]' AS suspicious_routes,
    CASE WHEN bal > 4000 THEN '["ff:ff:ff:00:00:' || lpad({s('nation')}, 2, '0') || ' (Broadcast OUI) on eth0"]' ELSE '[]' END AS unknown_mac_ouis,
    CASE nation % 4 WHEN 0 THEN '["Public nameserver: 8.8.8.8"]' WHEN 1 THEN '["Localhost nameserver: 127.0.0.53"]' WHEN 2 THEN '[]' ELSE '["External hostname nameserver: dns.example.com"]' END AS nameserver_flags FROM fx_host"""
ROOT_NOTES = """SELECT h, r, 'PID ' || CAST(pid AS STRING) || ': ' || cmd AS note, 'root' AS kind FROM fx_cmds WHERE uid = 'root' AND (cmd LIKE '%python3 -c import%' OR cmd LIKE 'bash -i%')
    UNION ALL SELECT h, r, 'PID ' || CAST(pid AS STRING) || ': ' || cmd, 'root' FROM fx_cmds WHERE uid = 'root' AND cmd LIKE 'bash -i%'
    UNION ALL SELECT DISTINCT h, r, 'Port ' || CAST(local_port AS STRING) || ' listening (unusual)', 'port' FROM fx_sockets WHERE state = 'LISTEN' AND local_port > 1024 AND local_port NOT IN (3306, 5432, 6379, 27017, 2049)"""
PROC_INSIGHTS = f"""SELECT x.run_id, {json_list('f.note', "f.kind = 'root'")} AS suspicious_root_processes, {json_list('f.note', "f.kind = 'port'")} AS unusual_listening_services, '[]' AS process_tree_issues
    FROM fx_runs x LEFT JOIN ({ROOT_NOTES}) f ON f.h = x.h AND f.r = x.r GROUP BY x.run_id"""
KERNEL = f"""SELECT x.run_id, {json_list('f.module', "f.module <> 'kvm'")} AS unusual_modules, {json_list("f.module || ': Proprietary'", "f.license = 'Proprietary'")} AS suspicious_licenses, {json_list('f.module', "f.signer = 'Unknown'")} AS modules_with_unknown_signer
    FROM {R('fx_modules')} GROUP BY x.run_id"""
PERSISTENCE = f"""SELECT f.run_id, {json_list("'Non-standard service: ' || f.path", "f.source = 'systemd_dirs' AND f.name LIKE '%.service'")} AS suspicious_systemd_units,
    {json_list("'World/group-writable cron file: ' || f.path || ' (' || f.perms || ')'", "f.source = 'cron_dirs' AND substr(f.perms, 6, 1) = 'w'")} AS unusual_cron_permissions,
    {json_list("'Recently modified: ' || f.path || ' (' || f.mtime_text || ')'", "f.source <> 'recent_bins' AND f.mtime_utc <= f.ts AND f.mtime_utc >= f.ts - INTERVAL 30 DAY")} AS recently_modified_persistence_files,
    {json_list("'Cron file in unusual location: ' || f.path", "f.directory = '/var/spool/cron'")} AS suspicious_cron_locations FROM fx_files f GROUP BY f.run_id"""
for _name, _sql in {"run_audit_posture": AUDIT, "run_selinux_posture": SELINUX, "run_apparmor_posture": APPARMOR, "run_network_posture": NETWORK,
                    "run_process_insights": PROC_INSIGHTS, "run_kernel_module_insights": KERNEL, "run_persistence_insights": PERSISTENCE}.items():
    case(_name, lambda f, n=_name: f(n), _sql)

# ---- 2.6 findings -----------------------------------------------------------------------------------------


def _found(table: str, severity: str, category: str, title: str, details: str, source: str) -> str:
    return f"SELECT run_id, '{severity}' AS severity, '{category}' AS category, {title} AS title, {details} AS details, '{table}.' || run_id AS evidence_ref FROM {source}"


FINDINGS = {
    "finding_audit_disabled": _found("run_audit_posture", "high", "audit", "'Audit subsystem disabled'", "'Auditing is off on this host, so security events leave no record'", "fx_host WHERE audit_enabled = '0'"),
    "finding_audit_mutable": _found("run_audit_posture", "medium", "audit", "'Audit rules not immutable'", "'Audit rules are not locked: whoever gains root can switch recording off'", "fx_host WHERE audit_enabled <> '2'"),
    "finding_selinux_disabled": _found("run_selinux_posture", "high", "selinux", "'SELinux disabled'", "'No mandatory access control by SELinux is in force'", "fx_host WHERE selinux = 'disabled'"),
    "finding_selinux_permissive": _found("run_selinux_posture", "medium", "selinux", "'SELinux in permissive mode'", "'SELinux only reports what its policy would forbid'", "fx_host WHERE selinux = 'permissive'"),
    "finding_apparmor_mixed": _found("run_apparmor_posture", "medium", "apparmor", "'AppArmor mixed enforcement mode'", "'Part of the AppArmor profiles only report, the others enforce'", "fx_host WHERE bal <= 4000"),
    "finding_default_routes": _found("run_network_posture", "medium", "network", "'Multiple default routes configured'", "'More than one way out of the network is set; check that each is wanted'", "fx_host WHERE two_routes = 1"),
    "finding_nameservers": _found("run_network_posture", "medium", "network", "'Unexpected nameservers: 8.8.8.8'", "'1 name servers are outside the expected set'", "fx_host WHERE nation % 4 = 0"),
    "finding_root_process": _found("run_process_insights", "high", "process", f"'Suspicious root processes detected (' || {s('n')} || ')'", "'Command lines of root processes match patterns of known abuse'",
        f"(SELECT x.run_id, count(*) AS n FROM ({ROOT_NOTES}) f JOIN fx_runs x ON f.h = x.h AND f.r = x.r WHERE f.kind = 'root' GROUP BY x.run_id) q"),
    "finding_failed_logins": _found("run_failed_logins", "medium", "auth", f"'High number of failed logins (' || {s('n')} || ')'", "'More failed logins than usual; passwords may be being tried out'",
        f"(SELECT run_id, count(*) AS n FROM ({FAILED}) f GROUP BY run_id HAVING count(*) > 10) q"),
    "finding_systemd_units": _found("run_persistence_insights", "medium", "persistence", f"'Suspicious systemd units (' || {s('n')} || ')'", "'Units outside the usual set start with the system'",
        "(SELECT run_id, count(*) AS n FROM fx_files WHERE source = 'systemd_dirs' AND name LIKE '%.service' GROUP BY run_id) q"),
}
for _rule, _table in findings.RULES:
    case(_rule.__name__, lambda f, rule=_rule, t=_table: rule(f(t)), FINDINGS[_rule.__name__])
ALL_FINDINGS = union(*FINDINGS.values())
case("findings", lambda f: f("findings"), ALL_FINDINGS)

# ---- 2.7 identity -----------------------------------------------------------------------------------------

# latest run of each host, with the asset named after its first run
FACTS["fx_cur"] = f"""SELECT a.run_id AS asset_id, x.current_name AS hostname, x.h, x.r, x.run_id, x.ts, x.ip, x.mac, x.machine_id, x.time_zone, x.uuid, x.s_name, x.nation, x.bal,
    'node' || {s('x.h')} || '.fleet' || {s('x.nation')} || '.example' AS fqdn, 'fleet' || {s('x.nation')} || '.example' AS domain, p.run_id AS prev_run, p.ts AS prev_ts, q.mem_gb, q.swap_gb, q.disk_tb, q.selinux, q.audit_enabled, q.two_routes, q.os_name, q.os_version, q.kernel
    FROM fx_runs x JOIN fx_runs a ON a.h = x.h AND a.r = 0 JOIN fx_runs p ON p.h = x.h AND p.r = 1 JOIN fx_host q ON q.run_id = x.run_id WHERE x.r = 2"""
FACTS["fx_run_assets"] = "SELECT x.*, a.run_id AS asset_id FROM fx_runs x JOIN fx_runs a ON a.h = x.h AND a.r = 0"
SERIAL = "CASE WHEN h % 17 = 0 THEN NULL ELSE md5('sn' || s_name) END"
FACTS["fx_idents"] = f"""SELECT run_id, asset_id, ts, 'hostname' AS id_type, hostname AS id_value FROM fx_run_assets UNION ALL SELECT run_id, asset_id, ts, 'machine_id', machine_id FROM fx_run_assets
    UNION ALL SELECT run_id, asset_id, ts, 'dmi_uuid', uuid FROM fx_run_assets UNION ALL SELECT run_id, asset_id, ts, 'serial_number', {SERIAL} FROM fx_run_assets WHERE h % 17 <> 0 UNION ALL SELECT run_id, asset_id, ts, 'primary_mac', mac FROM fx_run_assets"""

case("ident_extract", lambda f: f("identifiers"), f"SELECT run_id, {iso('ts')} AS collected_at_utc, hostname, machine_id, uuid AS dmi_uuid, {SERIAL} AS serial_number, mac AS primary_mac FROM fx_runs")
case("ident_score", lambda f: identity.ident_score(f("identifiers")),
     "SELECT run_id, id_type, id_value, CASE WHEN id_value LIKE '00000000%' THEN 0 ELSE CASE id_type WHEN 'primary_mac' THEN 100 WHEN 'dmi_uuid' THEN 90 WHEN 'hostname' THEN 100 WHEN 'machine_id' THEN 0 ELSE 40 END END AS score FROM fx_idents")
case("ident_resolve", lambda f: identity.ident_resolve(f("identifiers")), "SELECT run_id, asset_id FROM fx_run_assets")
case("ident_merge", lambda f: identity.ident_merge(
        f("identifiers").select("hostname").distinct().join(f("host_inventory").select("hostname").withColumn("has_inventory", F.lit(True)), "hostname", "left")
        .select(F.col("hostname").alias("asset_id"), "hostname", F.coalesce("has_inventory", F.lit(False)).alias("has_inventory"))),
     """SELECT hostname AS asset_id, CASE WHEN hostname LIKE 'srv%' THEN hostname ELSE base_name END AS survivor_id, CASE WHEN hostname LIKE 'host\\_%' ESCAPE '\\' THEN 1 ELSE 0 END AS merged FROM (SELECT DISTINCT hostname, base_name FROM fx_runs) q""")
case("ident_hostname", lambda f: identity.ident_hostname(f("identifiers"), f("run_assets"), f("host_inventory")), "SELECT asset_id, hostname FROM fx_cur")
case("asset_identifiers", lambda f: f("asset_identifiers"), f"SELECT asset_id, id_type, id_value, {iso('min(ts)')} AS first_seen_utc, {iso('max(ts)')} AS last_seen_utc FROM fx_idents GROUP BY asset_id, id_type, id_value")
case("ident_conflicts", lambda f: identity.ident_conflicts(f("asset_identifiers"), f("assets").select("asset_id", "hostname")),
     """SELECT p.id_type, p.id_value, p.asset_count, i.asset_id, c.hostname, CASE WHEN p.id_value LIKE '00000000%' THEN 1 ELSE 0 END AS is_fake FROM
     (SELECT id_type, id_value, count(DISTINCT asset_id) AS asset_count FROM fx_idents GROUP BY id_type, id_value HAVING count(DISTINCT asset_id) > 1) p
     JOIN (SELECT DISTINCT id_type, id_value, asset_id FROM fx_idents) i ON i.id_type = p.id_type AND i.id_value = p.id_value JOIN fx_cur c ON c.asset_id = i.asset_id""")
case("assets", lambda f: f("assets"), "SELECT asset_id, hostname, domain, fqdn FROM fx_cur")
case("inventory_sync", lambda f: views.inventory_sync(
        lambda name: f.spark.table(dialect(f.spark, f.sf_dir).t("customer")).select(F.concat(F.lit("cmdb-"), F.col("c_custkey").cast("string")).alias("asset_id"), F.lit("v1").alias("vlan"))
        if name == "asset_inventory" else f(name)).select("asset_id", "vlan", "server_manufacturer", "memory_capacity_gb", "os_name", "primary_ip"),
     f"SELECT asset_id, NULL AS vlan, 'Maker ' || s_name AS server_manufacturer, CAST(mem_gb AS DOUBLE) AS memory_capacity_gb, os_name, ip AS primary_ip FROM fx_cur UNION ALL SELECT 'cmdb-' || {s('c_custkey')}, 'v1', NULL, NULL, NULL, NULL FROM customer")

# ---- 2.8 views --------------------------------------------------------------------------------------------


def C2(fact: str) -> str:
    """A fact of the latest run, with the current host columns."""
    return f"{fact} f JOIN fx_cur c ON f.h = c.h AND f.r = c.r"


def L(sql: str) -> str:
    """Rows of a run table (SQL with run_id) that belong to a latest run."""
    return f"({sql}) f JOIN fx_cur c ON f.run_id = c.run_id"


SHELL = "lower(f.shell) LIKE '%sh'"
INV = "LEFT JOIN fx_inventory i ON i.hostname = c.hostname"
case("v_latest_runs", lambda f: f("v_latest_runs").select("asset_id", "run_id", "source_ip", "collected_at_utc", "source_path"),
     f"SELECT c.asset_id, c.run_id, c.ip AS source_ip, {iso('c.ts')} AS collected_at_utc, x.path AS source_path FROM fx_cur c JOIN fx_runs x ON x.run_id = c.run_id")
CUR_OS = f"CASE WHEN c.bal > 3000 THEN 'Ubuntu' ELSE 'Rocky Linux' END || ' 22.0' || {s('c.nation % 5')}"
case("v_asset_current", lambda f: f("v_asset_current"), f"""SELECT c.asset_id, c.hostname, c.domain, c.fqdn, c.run_id AS last_run_id, {iso('c.ts')} AS last_collected_at_utc, c.ip AS last_source_ip, c.machine_id, 'Vendor ' || c.s_name AS hardware_vendor,
    'M' || {s('c.nation')} AS hardware_model, {CUR_OS} AS operating_system, 'Linux ' || c.kernel AS kernel, 'x86-64' AS architecture, c.time_zone, CASE WHEN c.bal > 100 THEN 'yes' ELSE 'no' END AS system_clock_synchronized, 'active' AS ntp_service,
    c.mem_gb::BIGINT * {GB} AS mem_total_bytes, c.swap_gb::BIGINT * {GB} AS swap_total_bytes, c.ip AS primary_ipv4, c.mac AS primary_mac FROM fx_cur c""")
case("primary_ipv4", lambda f: f("primary_ipv4"), "SELECT run_id, ip AS primary_ipv4 FROM fx_cur")
case("primary_mac", lambda f: f("primary_mac"), "SELECT run_id, mac AS primary_mac FROM fx_cur")
GPU = f"CASE c.nation % 3 WHEN 0 THEN 'NVIDIA Corporation' WHEN 1 THEN 'Intel Corporation' ELSE 'Matrox' END || ' G' || {s('c.nation')}"
case("v_host_inventory_current", lambda f: f("v_host_inventory_current"), f"""SELECT c.asset_id, c.hostname, c.domain, c.fqdn, i.classification, i.location, 'Maker ' || c.s_name AS server_manufacturer, 'Model ' || {s('c.nation')} AS server_model_series, NULL AS server_model_no,
    'Intel Corp.' AS proc_manufacturer, 'CPU ' || {s('c.nation')} AS proc_model_series, 'CPU ' || {s('c.nation')} AS proc_model_no, NULL AS proc_no_cores, NULL AS proc_count, CASE c.nation % 3 WHEN 0 THEN 'NVIDIA Corporation' WHEN 1 THEN 'Intel Corporation' END AS gpu_manufacturer,
    'VGA compatible controller: ' || {GPU} AS gpu_model_series, {GPU} AS gpu_model_no, 1 AS gpu_count, CAST(c.mem_gb AS DOUBLE) AS memory_capacity_gb, 1 AS storage_hdd_no_drives, CAST(c.disk_tb * 1024 AS DOUBLE) AS storage_hdd_capacity_gb, 1 AS storage_nvme_no_drives,
    CAST(500 AS DOUBLE) AS storage_nvme_capabity_gb, 0 AS storage_ssd_no_drives, NULL AS storage_ssd_capabity_gb, c.os_name, c.os_version, 'x86-64' AS arch, c.ip AS primary_ip, 'eth0' AS interface, c.mac AS mac_addr FROM fx_cur c {INV}""")
case("v_asset_previous_run", lambda f: f("v_asset_previous_run"), f"SELECT asset_id, hostname, run_id AS last_run_id, {iso('ts')} AS last_collected_at_utc, prev_run AS previous_run_id, {iso('prev_ts')} AS previous_collected_at_utc FROM fx_cur")
case("v_run_delta_privileged_members", lambda f: f("v_run_delta_privileged_members"), f"""SELECT c.hostname, d.groupname, d.username AS member_username, d.change_type, c.run_id AS last_run_id, c.prev_run AS previous_run_id, {iso('c.ts')} AS last_collected_at_utc, {iso('c.prev_ts')} AS previous_collected_at_utc FROM fx_cur c JOIN
    (SELECT h, groupname, username, 'added' AS change_type FROM (SELECT h, groupname, username FROM fx_priv_members WHERE r = 2 EXCEPT SELECT h, groupname, username FROM fx_priv_members WHERE r = 1) a
     UNION ALL SELECT h, groupname, username, 'removed' FROM (SELECT h, groupname, username FROM fx_priv_members WHERE r = 1 EXCEPT SELECT h, groupname, username FROM fx_priv_members WHERE r = 2) b) d ON d.h = c.h""")
case("v_failed_logins_recent", lambda f: f("v_failed_logins_recent"), f"SELECT c.hostname, f.username, f.remote_host, f.tty, {iso('f.attempt_ts')} AS attempt_time_utc, f.raw_start_text, {iso('c.ts')} AS baseline_collected_at FROM {L(FAILED)} WHERE f.attempt_ts >= c.ts - INTERVAL 30 DAY")
NEVER = f"""SELECT c.hostname, f.username, 'Never logged in' AS lastlog_status, k.key_count FROM {C2('fx_users')} JOIN (SELECT h, username, count(*) AS key_count FROM fx_keys WHERE r = 2 GROUP BY h, username) k ON k.h = f.h AND k.username = f.username
    WHERE {SHELL} AND f.bal < 1000"""
case("v_accounts_never_logged_in_with_keys", lambda f: f("v_accounts_never_logged_in_with_keys"), NEVER)
_n = lambda sql, alias="n": f"(SELECT run_id, count(*) AS {alias} FROM ({sql}) q GROUP BY run_id)"
_per_h = lambda fact, cond="true", what="count(*)": f"coalesce((SELECT {what} FROM {fact} q WHERE q.h = c.h AND q.r = 2 AND {cond}), 0)"
FACTS["fx_summary"] = f"""SELECT c.asset_id, c.hostname, c.run_id AS last_run_id, {iso('c.ts')} AS last_collected_at_utc, c.ip AS primary_ipv4, c.mac AS primary_mac,
    {_per_h('fx_users')} AS local_user_count, {_per_h('fx_users', "lower(q.shell) LIKE '%sh'")} AS login_shell_user_count, {_per_h('fx_passwd_status', "q.status_code = 'L'")} AS locked_account_count, {_per_h('fx_keys')} + 1 AS authorized_key_count,
    {_per_h('fx_packages')} + {_per_h('fx_rpms')} AS package_row_count, {_per_h('(SELECT DISTINCT h, r, source, rule FROM fx_firewall)')} AS firewall_rule_row_count, {_per_h('fx_priv_members', what='count(DISTINCT q.username)')} AS privileged_user_count, 4 AS audit_rule_count,
    {_per_h("(SELECT DISTINCT h, r, k FROM fx_logins WHERE source = 'btmp')")} AS failed_login_count_recent, {_per_h('fx_files', "q.source = 'systemd_dirs'")} AS systemd_listing_rows, {_per_h('fx_files', "q.source = 'cron_dirs'")} AS cron_listing_rows,
    CASE WHEN c.audit_enabled = '0' THEN 0 ELSE 1 END AS audit_enabled, CASE WHEN c.audit_enabled = '2' THEN 1 ELSE 0 END AS audit_immutable, CASE WHEN c.bal > 4000 THEN 1 ELSE 0 END AS audit_has_critical_auth_rules, 1 AS audit_has_critical_file_rules,
    CASE WHEN c.selinux = 'disabled' THEN 'disabled' ELSE 'enabled' END AS selinux_status, c.selinux AS selinux_mode, CASE WHEN c.bal > 5000 THEN '["allow_execmem"]' ELSE '[]' END AS selinux_high_risk_booleans_on,
    CASE WHEN c.bal > 4000 THEN 1 ELSE 0 END AS apparmor_all_enforcing, CASE WHEN c.bal > 4000 THEN 0 ELSE 1 END AS apparmor_mixed_mode FROM fx_cur c"""
case("v_asset_security_summary", lambda f: f("v_asset_security_summary"), "SELECT * FROM fx_summary")
case("v_unexpected_privileged_users", lambda f: f("v_unexpected_privileged_users"), f"SELECT c.hostname, f.groupname, f.username AS member_username, 'baseline_system' AS baseline_status FROM {C2('fx_priv_members')}")
case("v_process_sockets", lambda f: f("v_process_sockets"), f"SELECT c.hostname, f.pid, f.ppid, f.uid, f.cmd, q.proto, q.local_addr, q.local_port, q.peer_addr, q.peer_port, q.state, q.process_name FROM {L(PROCESSES)} LEFT JOIN fx_sockets q ON q.h = c.h AND q.r = c.r AND q.pid = f.pid")
case("v_usb_kernel_drivers", lambda f: f("v_usb_kernel_drivers"), f"""SELECT c.hostname, f.bus_number, f.device_number, f.vendor_id, f.product_id, f.vendor_name, f.product_name, f.device_class, 0 AS device_subclass, '1 Maker Inc' AS manufacturer, NULL AS product, f.serial_number,
    CASE f.vendor_id WHEN '1d6b' THEN 'usbcore' WHEN '8086' THEN 'iwlwifi' WHEN '0bda' THEN 'rtl8xxxu' WHEN '0e8d' THEN 'mt76x2u' ELSE 'unknown' END AS likely_kernel_module FROM {C2('fx_usb')}""")
case("v_interface_processes", lambda f: f("v_interface_processes"), f"""SELECT c.hostname, f.ifname, CASE f.ifname WHEN 'eth0' THEN c.mac WHEN 'docker0' THEN '0a:00:00:00:00:01' END AS mac_addr, f.family, f.address, f.scope, p.pid, p.uid, p.cmd, q.proto, q.local_port, q.state
    FROM {L(ADDRS)} LEFT JOIN fx_sockets q ON q.h = c.h AND q.r = 2 AND q.local_addr = f.address LEFT JOIN fx_cmds p ON p.h = c.h AND p.r = 2 AND p.pid = q.pid""")
case("v_module_hardware", lambda f: f("v_module_hardware"), f"""SELECT c.hostname, f.module, f.size, f.used_by_count, f.used_by, u.usb_devices, 'VGA compatible controller: ' || {GPU} AS gpu_devices, f.license, f.signer, f.description FROM {C2('fx_modules')}
    LEFT JOIN (SELECT h, string_agg(DISTINCT product_name, ',' ORDER BY product_name) AS usb_devices FROM fx_usb WHERE r = 2 GROUP BY h) u ON u.h = c.h""")
RARE_PROC = f"""SELECT c.hostname, f.cmd, g.host_count, g.total_instances, f.pid, f.uid, f.ppid FROM {L(PROCESSES)} JOIN (SELECT f.cmd, count(DISTINCT c.asset_id) AS host_count, count(*) AS total_instances FROM {L(PROCESSES)}
    WHERE f.cmd NOT LIKE '/usr/bin/%' AND f.cmd NOT LIKE '/bin/%' AND f.cmd NOT LIKE '/sbin/%' AND f.cmd NOT LIKE '[%]%' AND length(f.cmd) > 10 GROUP BY f.cmd HAVING count(DISTINCT c.asset_id) <= 2) g ON g.cmd = f.cmd"""
case("v_rare_processes", lambda f: f("v_rare_processes"), RARE_PROC)
case("v_rare_usb_devices", lambda f: f("v_rare_usb_devices"), f"""SELECT c.hostname, g.device_id, g.vendor_name, g.product_name, g.host_count, f.bus_number, f.device_number, f.serial_number FROM {C2('fx_usb')} JOIN (SELECT f.vendor_id || ':' || f.product_id AS device_id, f.vendor_name, f.product_name, count(DISTINCT c.h) AS host_count
    FROM {C2('fx_usb')} GROUP BY 1, 2, 3 HAVING count(DISTINCT c.h) <= 2) g ON g.device_id = f.vendor_id || ':' || f.product_id AND g.vendor_name IS NOT DISTINCT FROM f.vendor_name AND g.product_name IS NOT DISTINCT FROM f.product_name""")
RARE_MOD = f"""SELECT c.hostname, f.module, g.host_count, g.host_count AS total_instances, f.size, f.used_by_count, f.used_by, f.description, f.license FROM {C2('fx_modules')} JOIN (SELECT module, count(DISTINCT h) AS host_count FROM fx_modules WHERE r = 2 GROUP BY module HAVING count(DISTINCT h) <= 2) g ON g.module = f.module"""
case("v_rare_kernel_modules", lambda f: f("v_rare_kernel_modules"), RARE_MOD)
case("v_unique_mounts", lambda f: f("v_unique_mounts"), f"SELECT hostname, '/data/h' || {s('h')} AS mountpoints, 'vg-root' AS name, 'lvm' AS type FROM fx_cur")
case("v_memory_drift", lambda f: f("v_memory_drift"), f"""SELECT c.hostname, printf('%.1f', CAST(c.mem_gb AS DOUBLE)) AS current_gb, i.memory_capacity_gb AS expected_gb,
    CASE WHEN abs(c.mem_gb - i.memory_capacity_gb) < 0.5 THEN 'normal' WHEN c.mem_gb > i.memory_capacity_gb THEN 'increased' ELSE 'decreased' END AS status, abs(c.mem_gb - i.memory_capacity_gb) AS drift_gb FROM fx_cur c {INV}""")
case("v_cpu_drift", lambda f: f("v_cpu_drift"), f"SELECT c.hostname, i.proc_no_cores AS expected_cores, i.proc_count AS expected_sockets, {CUR_OS} AS operating_system, CASE WHEN i.proc_no_cores IS NULL THEN 'unknown' ELSE 'baseline_loaded' END AS baseline_status FROM fx_cur c {INV}")
WANT = "CASE WHEN coalesce(i.storage_hdd_capacity_gb, i.storage_nvme_capabity_gb, i.storage_ssd_capabity_gb) IS NOT NULL THEN coalesce(i.storage_hdd_capacity_gb, 0) + coalesce(i.storage_nvme_capabity_gb, 0) + coalesce(i.storage_ssd_capabity_gb, 0) END"
NOW = "(CAST(c.disk_tb AS DOUBLE) + CAST(500 AS DOUBLE) / 1024)"
case("v_storage_drift", lambda f: f("v_storage_drift"), f"SELECT c.hostname, printf('%.2f', {NOW}) AS current_tb, ({WANT}) / CAST(1024 AS DOUBLE) AS expected_tb, CASE WHEN ({WANT}) IS NULL THEN 'no_baseline' WHEN abs({NOW} - ({WANT}) / CAST(1024 AS DOUBLE)) < 0.1 THEN 'normal' ELSE 'drift_detected' END AS status FROM fx_cur c {INV}")
case("v_os_drift", lambda f: f("v_os_drift"), f"SELECT c.hostname, {CUR_OS} AS current_os, 'ubuntu' AS expected_os_name, '22.04' AS expected_os_version, CASE WHEN c.bal > 3000 THEN 'matches' ELSE 'os_changed' END AS status FROM fx_cur c")

# ---- 2.9 playbook -----------------------------------------------------------------------------------------

case("q_inventory", lambda f: playbook.q_inventory(f), f"SELECT c.asset_id, c.hostname, c.ip AS primary_ipv4, c.mac AS primary_mac, {CUR_OS} AS operating_system, 'Linux ' || c.kernel AS kernel, 'x86-64' AS architecture, c.mem_gb::BIGINT * {GB} AS mem_total_bytes, {iso('c.ts')} AS last_collected_at_utc FROM fx_cur c")
case("q_posture", lambda f: playbook.q_posture(f), "SELECT hostname, privileged_user_count, local_user_count, locked_account_count, authorized_key_count, package_row_count, firewall_rule_row_count, last_collected_at_utc FROM fx_summary")
case("q_missing_runs", lambda f: playbook.q_missing_runs(lambda name: f.spark.table(dialect(f.spark, f.sf_dir).t("customer")).select(
        F.concat(F.lit("cmdb-"), F.col("c_custkey").cast("string")).alias("asset_id"), F.col("c_name").alias("hostname")).unionByName(f("assets").select("asset_id", "hostname")) if name == "assets" else f(name)),
     f"SELECT 'cmdb-' || {s('c_custkey')} AS asset_id, c_name AS hostname FROM customer")
case("q_privileged", lambda f: playbook.q_privileged(f), f"SELECT c.hostname, f.groupname, f.username AS member_username FROM {C2('fx_priv_members')}")
case("q_shell_accounts", lambda f: playbook.q_shell_accounts(f), f"SELECT c.hostname, f.username, f.uid, f.shell FROM {C2('fx_users')} WHERE {SHELL}")
case("q_locked", lambda f: playbook.q_locked(f), f"SELECT c.hostname, f.username, f.status_code, f.last_change FROM {C2('fx_passwd_status')}")


def _neighbours(f):
    """Each host paired with the next one."""
    hosts = f("v_asset_current").select("hostname", F.split("last_source_ip", "[.]").alias("o"))
    key = lambda i: F.get("o", F.lit(i)).cast("bigint")
    hosts = hosts.select("hostname", (key(1) * 62500 + key(2) * 250 + key(3) - 1).alias("h"))
    return hosts.select(F.col("hostname").alias("host_a"), (F.col("h") + 1).alias("h")).join(hosts.select(F.col("hostname").alias("host_b"), "h"), "h").drop("h")


case("q_pkg_diff", lambda f: playbook.q_pkg_diff(f, _neighbours(f)), """SELECT a.hostname AS host_a, b.hostname AS host_b, d.diff_type, d.name, d.version FROM fx_cur a JOIN fx_cur b ON b.h = a.h + 1 JOIN
    (SELECT p.h AS ha, 'only_in_a' AS diff_type, p.name, p.version FROM fx_packages p WHERE p.r = 2 AND NOT EXISTS (SELECT 1 FROM fx_packages q WHERE q.r = 2 AND q.h = p.h + 1 AND q.name = p.name)
     UNION ALL SELECT p.h - 1, 'only_in_b', p.name, p.version FROM fx_packages p WHERE p.r = 2 AND NOT EXISTS (SELECT 1 FROM fx_packages q WHERE q.r = 2 AND q.h = p.h - 1 AND q.name = p.name)) d ON d.ha = a.h""")
case("q_findings", lambda f: playbook.q_findings(f), f"SELECT c.hostname, f.severity, f.category, f.title, f.details FROM {L(ALL_FINDINGS)}")
case("q_failed_logins", lambda f: playbook.q_failed_logins(f, now=F.expr("TIMESTAMP '2024-02-15 00:00:00'"), more_than=2), f"""SELECT c.hostname, count(*) AS failed_login_count, count(DISTINCT f.username) AS unique_users_targeted, count(DISTINCT f.remote_host) AS unique_source_ips FROM {L(FAILED)}
    WHERE f.attempt_ts >= TIMESTAMP '2024-02-15 00:00:00' - INTERVAL 30 DAY GROUP BY c.hostname HAVING count(*) > 2""")
case("q_many_keys", lambda f: playbook.q_many_keys(f), f"SELECT c.hostname, f.username, count(*) AS key_count, string_agg(DISTINCT k.key_type, ',' ORDER BY k.key_type) AS key_types FROM {C2('fx_users')} JOIN fx_keys k ON k.h = f.h AND k.r = f.r AND k.username = f.username WHERE {SHELL} GROUP BY 1, 2 HAVING count(*) > 5")
_first = lambda js: f"json_extract_string({js}, '$[0]')"
case("q_module_anomalies", lambda f: playbook.q_module_anomalies(f), f"SELECT c.hostname, {_first('f.unusual_modules')} AS unusual_module, {_first('f.suspicious_licenses')} AS suspicious_license, {_first('f.modules_with_unknown_signer')} AS unknown_signer FROM {L(KERNEL)} WHERE f.unusual_modules <> '[]'")
case("q_network_issues", lambda f: playbook.q_network_issues(f), "SELECT hostname, CASE WHEN two_routes = 1 THEN 'Multiple default routes' END AS route_issue, CASE WHEN nation % 4 = 0 THEN '8.8.8.8' END AS unexpected_nameserver, 'Suspicious route to 169.254.0.0 via eth0' AS suspicious_route FROM fx_cur")
case("q_persistence_counts", lambda f: playbook.q_persistence_counts(f), f"""SELECT c.hostname, CASE WHEN f.source = 'cron_dirs' THEN 'Cron jobs' ELSE 'Systemd units' END AS persistence_type, count(*) AS item_count FROM {C2('fx_files')} WHERE f.source = 'cron_dirs' OR (f.source = 'systemd_dirs' AND f.name LIKE '%.service') GROUP BY 1, 2""")
case("q_password_auth", lambda f: playbook.q_password_auth(f), "SELECT hostname, 'yes' AS fact_value FROM fx_cur WHERE bal > 3000")
case("q_no_remote_log", lambda f: playbook.q_no_remote_log(f), "SELECT hostname FROM fx_cur WHERE bal <= 1000")


def _view_sql(f):
    """Plain SQL over registered tables and views."""
    f.register_views("v_asset_current", "run_users", "run_group_members")
    return f.spark.sql("""SELECT ac.hostname, count(DISTINCT u.username) AS users, count(DISTINCT m.groupname) AS admin_groups FROM v_asset_current ac JOIN run_users u ON u.run_id = ac.last_run_id
        LEFT JOIN run_group_members m ON m.run_id = u.run_id AND m.member_username = u.username AND m.source = 'getent' GROUP BY ac.hostname""")


case("view_sql", _view_sql, f"SELECT c.hostname, count(DISTINCT f.username) AS users, count(DISTINCT m.groupname) AS admin_groups FROM {C2('fx_users')} LEFT JOIN fx_priv_members m ON m.h = f.h AND m.r = f.r AND m.username = f.username GROUP BY c.hostname")

# ---- 2.10 report ------------------------------------------------------------------------------------------


#: Expected rows of the report's questions, from which those of its text are put together.
REPORTED: dict[str, str] = {}


def reported(fn, sql: str, drop: tuple[str, ...] = ()) -> None:
    REPORTED[fn.__name__] = sql
    case(fn.__name__, lambda f: f(fn.__name__), sql, drop=drop)


reported(report.r_severity_counts, f"SELECT f.severity, count(*) AS finding_count FROM {L(ALL_FINDINGS)} GROUP BY f.severity")
reported(report.r_time_span, f"SELECT {iso('min(ts)')} AS oldest_collection, {iso('max(ts)')} AS newest_collection, CAST(floor(epoch(max(ts) - min(ts)) / 86400) AS INT) AS span_days FROM fx_runs")
reported(report.r_fleet_stats, "SELECT (SELECT count(*) FROM fx_cur) AS total_hosts, (SELECT avg(mem_gb) FROM fx_cur) AS avg_memory_gb, (SELECT count(DISTINCT username) FROM fx_users WHERE r = 2) AS total_users, (SELECT count(*) FROM (SELECT name FROM fx_packages WHERE r = 2 UNION SELECT name FROM fx_rpms WHERE r = 2) q) AS total_packages")
reported(report.r_host_header, f"""SELECT c.hostname, c.ip AS ip_address, {CUR_OS} AS operating_system, 'Linux ' || c.kernel AS kernel, 'x86-64' AS architecture, 'Vendor ' || c.s_name AS hardware_vendor, 'M' || {s('c.nation')} AS hardware_model, 'Unknown' AS system_version,
    CASE WHEN c.h % 17 = 0 THEN 'Unknown' ELSE md5('sn' || c.s_name) END AS serial_number, printf('%.1f GB', CAST(c.mem_gb AS DOUBLE)) AS memory_observed, printf('%.1f GB', i.memory_capacity_gb) AS memory_inventory FROM fx_cur c {INV}""")
reported(report.r_disk_capacity, f"SELECT hostname, disk_tb::BIGINT * 1099511627776 + 500::BIGINT * {GB} AS total_disk_bytes, disk_tb::BIGINT * 1099511627776 + 500::BIGINT * {GB} AS total_fixed_disk_bytes FROM fx_cur")
FACTS["fx_ports"] = f"""SELECT c.run_id, c.h, c.hostname, f.proto, f.state, f.local_addr, f.local_port, f.peer_addr, f.peer_port, f.process_name, f.pid, o.uid, o.cmd, u.username AS owner_name, coalesce(u.uid, TRY_CAST(o.uid AS INT)) AS owner_uid,
    CASE WHEN u.username IS NOT NULL THEN 'grp' || {s('u.nation')} END AS owner_group, CASE f.local_addr WHEN '127.0.0.1' THEN 'local-only' WHEN '0.0.0.0' THEN 'all-interfaces' WHEN '::' THEN 'all-interfaces' ELSE 'bound' END AS addr_scope
    FROM {C2('fx_sockets')} JOIN fx_cmds o ON o.h = f.h AND o.r = f.r AND o.pid = f.pid LEFT JOIN fx_users u ON u.h = f.h AND u.r = f.r AND (u.username = o.uid OR CAST(u.uid AS STRING) = o.uid)"""
reported(report.r_ports, "SELECT * EXCLUDE (h) FROM fx_ports")
BASE = "split_part(list_extract(string_split(split_part(cmd, ' ', 1), '/'), -1), ':', 1)"
reported(report.r_port_packages, f"""SELECT hostname, base, name, version FROM (SELECT b.hostname, b.base, p.name, p.version, row_number() OVER (PARTITION BY b.run_id, b.base ORDER BY CASE WHEN starts_with(p.name, b.base) THEN 0 ELSE 1 END, p.name, p.version) AS rn
    FROM (SELECT DISTINCT run_id, hostname, {BASE} AS base FROM fx_ports) b JOIN ({PACKAGES}) p ON p.run_id = b.run_id AND contains(p.name, b.base)) q WHERE rn <= 3""")
reported(report.r_port_firewall, f"""SELECT hostname, local_port, rule_source, rule FROM (SELECT p.hostname, p.local_port, m.source AS rule_source, m.rule, row_number() OVER (PARTITION BY p.run_id, p.local_port ORDER BY m.source, m.rule) AS rn FROM (SELECT DISTINCT run_id, h, hostname, local_port FROM fx_ports) p
    JOIN (SELECT DISTINCT w.h, w.source, w.rule, q.local_port FROM fx_firewall w JOIN fx_sockets q ON q.h = w.h AND q.r = w.r AND q.k = w.k WHERE w.r = 2 AND w.source <> 'firewalld_zones') m ON m.h = p.h AND m.local_port = p.local_port) z WHERE rn <= 3""")
reported(report.r_unusual_ports, "SELECT DISTINCT hostname, proto, local_addr, local_port, cmd FROM fx_ports WHERE local_addr NOT LIKE '169.254.%' AND local_port NOT IN (22, 80, 443, 53, 25, 110, 143, 993, 995, 3306, 5432, 6379, 27017, 2049, 111)")
reported(report.r_host_findings, f"SELECT c.hostname, f.severity, f.category, f.title, f.details FROM {L(ALL_FINDINGS)}")
reported(report.r_service_shells, f"""SELECT c.hostname, f.username, f.shell, f.uid, g.groups FROM {C2('fx_users')} LEFT JOIN (SELECT h, r, username, string_agg(groupname, ',' ORDER BY groupname) AS groups FROM fx_priv_members GROUP BY h, r, username) g ON g.h = f.h AND g.r = f.r AND g.username = f.username
    WHERE {SHELL} AND f.uid < 1000""")
reported(report.r_privileged_users, f"SELECT c.hostname, f.username AS member_username, string_agg(DISTINCT f.groupname, ',' ORDER BY f.groupname) AS groups, count(*) AS group_count FROM {C2('fx_priv_members')} GROUP BY 1, 2")
reported(report.r_unused_keys, f"SELECT hostname, username, key_count FROM ({NEVER}) q")
reported(report.r_rare_processes, f"SELECT hostname, cmd, host_count FROM (SELECT *, row_number() OVER (PARTITION BY hostname ORDER BY host_count, total_instances DESC, cmd, pid) AS rn FROM ({RARE_PROC}) q) z WHERE rn <= 10")
reported(report.r_rare_packages, f"""SELECT hostname, name, version, host_count FROM (SELECT c.hostname, f.name, f.version, g.host_count, row_number() OVER (PARTITION BY c.hostname ORDER BY g.host_count, f.name, f.version) AS rn FROM {L(PACKAGES)}
    JOIN (SELECT f.name, count(DISTINCT c.h) AS host_count FROM {L(PACKAGES)} GROUP BY f.name HAVING count(DISTINCT c.h) <= 2) g ON g.name = f.name) z WHERE rn <= 15""")
reported(report.r_rare_modules, f"SELECT hostname, module, host_count, description, license FROM (SELECT *, row_number() OVER (PARTITION BY hostname ORDER BY host_count, module) AS rn FROM ({RARE_MOD}) q) z WHERE rn <= 10")
reported(report.r_usb, f"SELECT c.hostname, f.vendor_id, f.product_id, f.vendor_name, f.product_name, f.serial_number, f.bus_number, f.device_number FROM {C2('fx_usb')}")
reported(report.r_unique_mounts, f"SELECT hostname, '/data/h' || {s('h')} AS mountpoints, 'vg-root' AS name, 'lvm' AS type FROM fx_cur")
PW = f"""SELECT c.hostname, count(*) FILTER (WHERE f.status_code = 'P') AS password_enabled, coalesce(string_agg(f.username, ', ' ORDER BY f.username) FILTER (WHERE f.status_code = 'P'), '') AS users, count(*) FILTER (WHERE f.status_code = 'L') AS locked_accounts, count(*) AS total_accounts
    FROM {C2('fx_passwd_status')} GROUP BY c.hostname"""
reported(report.r_password_accounts, PW)
reported(report.r_audit_config, "SELECT hostname, 4 AS rule_count, CASE WHEN audit_enabled = '0' THEN 0 ELSE 1 END AS audit_enabled, CASE WHEN audit_enabled = '2' THEN 1 ELSE 0 END AS audit_immutable FROM fx_cur")
FW = "(SELECT DISTINCT h, r, source, rule FROM fx_firewall)"
reported(report.r_firewall_config, f"SELECT c.hostname, f.source, count(*) AS rule_count FROM {C2(FW)} GROUP BY 1, 2")
reported(report.r_firewall_allow, f"SELECT hostname, source, rule FROM (SELECT c.hostname, f.source, f.rule, row_number() OVER (PARTITION BY c.hostname ORDER BY f.source, f.rule) AS rn FROM {C2(FW)} WHERE f.rule LIKE '%ACCEPT%') q WHERE rn <= 5")
reported(report.r_logging, f"SELECT hostname, CASE WHEN bal > 1000 THEN '@@loghost' || {s('nation')} || ':514' ELSE '' END || CASE WHEN bal > 5000 THEN ',@[10.0.0.9]:601' ELSE '' END AS targets, CASE WHEN bal > 1000 THEN 'detected' ELSE 'none found' END AS status FROM fx_cur")
reported(report.r_logging_services, f"SELECT c.hostname, f.unit, f.load, f.active, f.sub FROM {C2('fx_units')} WHERE f.unit IN ('rsyslog.service', 'systemd-journald.service')")
reported(report.r_routes, f"SELECT hostname, '10.' || {s('nation')} || '.0.0' AS destination, '0.0.0.0' AS gateway, 'eth0' AS iface FROM fx_cur UNION ALL SELECT hostname, '169.254.0.0', '0.0.0.0', 'eth0' FROM fx_cur")
ACTIVE = f"SELECT c.hostname, f.*, row_number() OVER (PARTITION BY c.hostname ORDER BY (f.k % 30) * 86400 + (f.k % 1440) * 60 DESC, f.username) AS rn FROM {C2('fx_lastlog')} WHERE f.port IS NOT NULL"
reported(report.r_active_accounts, f"SELECT a.hostname, a.username, 'local' AS account_type, a.latest, a.from_host, a.port, u.uid, u.gid, 'grp' || {s('u.nation')} AS groupname, u.home, u.shell FROM ({ACTIVE}) a JOIN fx_users u ON u.h = a.h AND u.r = a.r AND u.username = a.username WHERE a.rn <= 10")
reported(report.r_active_by_node, f"SELECT hostname, string_agg(username, ', ' ORDER BY rn) AS users FROM ({ACTIVE}) a GROUP BY hostname")
reported(report.r_password_variance, f"SELECT count(*) AS host_count, count(DISTINCT users) AS distinct_lists, CASE WHEN count(DISTINCT users) = 1 THEN min(users) END AS common_list FROM ({PW}) q WHERE password_enabled > 0")

def told(section: int, source: str, *items: str, host: str = "hostname") -> str:
    """The lines that a section says of every row of a question."""
    return f"""SELECT {host} AS hostname, {section} AS section, CAST(i - 1 AS INT) AS line_no, said[i] AS line FROM (SELECT *, unnest(range(1, len(said) + 1)) AS i
        FROM (SELECT *, [x FOR x IN [{", ".join(items)}] IF x IS NOT NULL] AS said FROM ({source}) q0) q1) q2"""


def text_of(section: int) -> str:
    """Lines of one section, without its title."""
    q, only = REPORTED, "' (only on ' || host_count || CASE WHEN host_count > 1 THEN ' nodes)' ELSE ' node)' END"
    gigabytes = "printf('%.1f GB', {0} / 1073741824.0)"
    socket = "'  ' || upper(proto) || ' ' || local_addr || ':' || coalesce(CAST(local_port AS STRING), '*') || CASE WHEN peer_addr <> '' AND peer_port <> 0 THEN ' -> ' || peer_addr || ':' || peer_port ELSE '' END || ' [' || state || ', ' || addr_scope || ']'"
    owner = "CASE WHEN uid IS NULL THEN '' ELSE ' (uid=' || coalesce(CAST(owner_uid AS STRING), uid) || ', user=' || coalesce(owner_name, 'unknown') || ', group=' || coalesce(owner_group, 'unknown') || ')' END"
    unknown = lambda c, other="unknown": f"coalesce(CAST({c} AS STRING), '{other}')"
    return {
        1: lambda: told(1, q["r_severity_counts"], "finding_count || ' ' || upper(severity) || ' severity findings'", host="''"),
        2: lambda: told(2, q["r_time_span"], "'Oldest Data Collection: ' || replace(replace(oldest_collection, 'T', ' '), 'Z', ' UTC')", "'Newest Data Collection: ' || replace(replace(newest_collection, 'T', ' '), 'Z', ' UTC')", "'Data Time Span: ' || span_days || ' days'", host="''"),
        3: lambda: told(3, q["r_fleet_stats"], "'Total Nodes Assessed: ' || total_hosts", "'Average Memory per Node: ' || printf('%.1f GB', avg_memory_gb)", "'Total Unique Users Across Nodes: ' || total_users", "'Total Unique Packages Across Nodes: ' || total_packages", host="''"),
        10: lambda: told(10, q["r_host_header"], *[f"'{k}: ' || {c}" for k, c in report.HEADER_ITEMS.items()]),
        11: lambda: told(11, q["r_disk_capacity"], f"'Total Disk Capacity (All): ' || {gigabytes.format('total_disk_bytes')}", f"'Total Disk Capacity (Fixed): ' || {gigabytes.format('total_fixed_disk_bytes')}"),
        12: lambda: told(12, q["r_ports"], socket, "'    Process: ' || cmd", f"'    PID: ' || pid || {owner}"),
        13: lambda: told(13, f"SELECT hostname, base, string_agg(name || ' ' || version, ', ' ORDER BY name || ' ' || version) AS packages FROM ({q['r_port_packages']}) y GROUP BY hostname, base", "'  ' || base || ': ' || packages"),
        14: lambda: told(14, q["r_port_firewall"], "'  ' || local_port || ': [' || rule_source || '] ' || rule"),
        15: lambda: told(15, q["r_unusual_ports"], "'  ' || upper(proto) || ' ' || local_addr || ':' || local_port || ' - ' || cmd"),
        16: lambda: told(16, q["r_host_findings"], "upper(severity) || ': ' || title", "CASE WHEN details <> '' THEN '   ' || details END"),
        17: lambda: told(17, q["r_service_shells"], "'  User: ' || username || ' (UID: ' || uid || ', Shell: ' || shell || ')'", "CASE WHEN groups <> '' THEN '    Groups: ' || groups END"),
        18: lambda: told(18, q["r_privileged_users"], "'  ' || member_username || ': ' || groups"),
        19: lambda: told(19, q["r_unused_keys"], "'  ' || username || ': ' || key_count || ' SSH keys'"),
        20: lambda: told(20, q["r_rare_processes"], f"'  ' || cmd || {only}"),
        21: lambda: told(21, q["r_rare_packages"], f"'  ' || concat_ws(' ', name, version) || {only}"),
        22: lambda: told(22, q["r_rare_modules"], f"'  ' || module || CASE WHEN description <> '' THEN ' - ' || description ELSE '' END || CASE WHEN license <> '' THEN ' [' || license || ']' ELSE '' END || {only}"),
        23: lambda: told(23, q["r_usb"], f"'  Bus ' || {unknown('bus_number')} || ' Device ' || {unknown('device_number')} || ': ' || {unknown('vendor_name', 'Unknown Vendor')} || ' ' || {unknown('product_name', 'Unknown Product')} || ' [' || vendor_id || ':' || product_id || '] Serial: ' || {unknown('serial_number')}"),
        24: lambda: told(24, q["r_unique_mounts"], "'  ' || mountpoints || ' (' || name || ', ' || type || ')'"),
        25: lambda: told(25, q["r_password_accounts"], "'Accounts with Passwords Enabled: ' || password_enabled", "'  Users: ' || CASE WHEN users <> '' THEN users ELSE 'None' END", "'Locked Accounts: ' || locked_accounts", "'Total User Accounts: ' || total_accounts"),
        26: lambda: told(26, q["r_audit_config"], "'Audit Rules: ' || rule_count || ' rules configured'", "'Audit Enabled: ' || CASE WHEN audit_enabled <> 0 THEN 'Yes' ELSE 'No' END", "'Audit Immutable: ' || CASE WHEN audit_immutable <> 0 THEN 'Yes' ELSE 'No' END"),
        27: lambda: told(27, q["r_firewall_config"], "'  ' || source || ': ' || rule_count || ' rules'"),
        28: lambda: told(28, q["r_firewall_allow"], "'    [' || source || '] ' || rule"),
        29: lambda: told(29, q["r_logging_services"], "'  ' || unit || ': ' || active || '/' || sub || ' (load=' || load || ')'"),
        30: lambda: told(30, q["r_logging"], "'Remote logging targets: ' || status", "CASE WHEN targets <> '' THEN '  ' || targets END"),
        31: lambda: told(31, q["r_routes"], "'  ' || destination || ' via ' || gateway || ' dev ' || iface"),
        32: lambda: told(32, q["r_active_accounts"], f"'  ' || username || ' (' || account_type || '): ' || latest || ' from ' || {unknown('from_host')} || ' (' || {unknown('port', 'n/a')} || ')'", f"'     uid=' || {unknown('uid', 'n/a')} || ' gid=' || {unknown('gid', 'n/a')} || ' group=' || {unknown('groupname')} || ' shell=' || {unknown('shell')} || ' home=' || {unknown('home')}"),
        90: lambda: told(90, q["r_active_by_node"], "'  ' || hostname || ': ' || users", host="''"),
        91: lambda: told(91, f"SELECT 'Same across all nodes' AS hostname, common_list AS users FROM ({q['r_password_variance']}) v WHERE distinct_lists = 1 UNION ALL SELECT hostname, users FROM ({q['r_password_accounts']}) v WHERE password_enabled > 0 AND (SELECT distinct_lists FROM ({q['r_password_variance']}) w) > 1",
                         "'  ' || hostname || ': ' || users", host="''"),
    }[section]()


FACTS["fx_told"] = " UNION ALL ".join(f"({text_of(number)})" for number in report.TITLES)


def report_sql() -> str:
    """The whole text: lines of all sections, and of each host and section the title, and what is said where nothing was found."""
    parts = ["SELECT hostname, section, line_no, line FROM fx_told"]
    for number, (title, nothing) in report.TITLES.items():
        hosts = "SELECT DISTINCT hostname FROM fx_cur" if report.is_of_host(number) else "SELECT '' AS hostname"
        there = f"EXISTS (SELECT 1 FROM fx_told l WHERE l.hostname = t.hostname AND l.section = {number})"
        parts.append(f"SELECT hostname, {number} AS section, 0 AS line_no, '{title}:' AS line FROM ({hosts}) t" + ("" if nothing else f" WHERE {there}"))
        if nothing:
            parts.append(f"SELECT hostname, {number}, 1, '{nothing}' FROM ({hosts}) t WHERE NOT {there}")
    return " UNION ALL ".join(parts)


case("report_lines", lambda f: report.report_lines(f).drop("ord"), report_sql())


# ---- 2.11 snapshot comparison -----------------------------------------------------------------------------

#: Block kinds of a compared file. All but the last are in every file, so that a block has the same place in both.
DIFF_TAGS = ("hostnamectl", "uname_a", "etc_release", "sysctl_hardening", "timedatectl", "uptime", "ip_addr", "resolv_conf", "route_n", "sshd_T", "auditctl_l", "dpkg_list", "priv_groups")


def _diff_inputs(f, tags=DIFF_TAGS):
    snaps = src.snapshots(rendered(f.spark, f.sf_dir, tags))
    return snaps, split_blocks(snaps), diff.consecutive_pairs(f("v_asset_previous_run"))


FACTS["fx_gtext"] = f"SELECT h, r, string_agg(groupname || ':x:' || {s('gid')} || ':' || members_csv, chr(10) ORDER BY gid) AS body FROM fx_priv_groups GROUP BY h, r"
_specs = block_specs(DUCK)
# lines of the compared blocks; heads are the same in all runs
FACTS["fx_dlines"] = " UNION ALL ".join(f"SELECT h, r, {no} AS idx, '{tag}' AS tag, '{COMMANDS[tag]}' AS command, unnest(string_split(CAST(line AS STRING), chr(10))) AS line FROM ({_specs[tag].sql}) q{no}" for no, tag in enumerate(DIFF_TAGS))
FACTS["fx_dbody"] = "SELECT h, r, idx, tag, command, string_agg(line, chr(10) ORDER BY line) AS body FROM fx_dlines GROUP BY h, r, idx, tag, command"
BLOCK_PAIRS = f"""SELECT c.prev_run AS first_run, c.run_id AS second_run, a.h, a.tag, {s('a.idx')} AS block_key, a.idx AS command_index, b.idx AS second_index, a.command,
    CASE WHEN b.body IS NULL THEN 'missing' WHEN a.body = b.body THEN 'same' ELSE 'changed' END AS status
    FROM fx_cur c JOIN fx_dbody a ON a.h = c.h AND a.r = 1 LEFT JOIN fx_dbody b ON b.h = c.h AND b.r = 2 AND b.idx = a.idx"""
BLOCK_DIFF = f"SELECT first_run, second_run, block_key, command_index, second_index, command, status FROM ({BLOCK_PAIRS}) q"
case("diff_blocks", lambda f: diff.diff_blocks(*_diff_inputs(f)[1:]), BLOCK_DIFF)
case("diff_blocks_by_tag", lambda f: diff.diff_blocks(*_diff_inputs(f)[1:], by="tag").drop("command_index", "second_index"),
     f"SELECT first_run, second_run, tag || '#1' AS block_key, command, status FROM ({BLOCK_PAIRS}) q")
LINE_DIFF = f"""SELECT p.first_run, p.second_run, p.block_key, p.command, n.line, CASE WHEN n.net > 0 THEN 'added' ELSE 'removed' END AS change_type, abs(n.net) AS copies
    FROM ({BLOCK_PAIRS}) p JOIN (SELECT h, idx, line, count(*) FILTER (WHERE r = 2) - count(*) FILTER (WHERE r = 1) AS net FROM fx_dlines GROUP BY h, idx, line) n ON n.h = p.h AND n.idx = p.command_index
    WHERE p.status = 'changed' AND n.net <> 0"""
case("diff_lines", lambda f: diff.diff_lines(*_diff_inputs(f)[1:]), LINE_DIFF)
case("diff_text", lambda f: diff.diff_text(*_diff_inputs(f)[1:]), f"""SELECT first_run, second_run, block_key, command,
    '--- ' || chr(10) || '+++ ' || string_agg(repeat(chr(10) || CASE change_type WHEN 'added' THEN '+' ELSE '-' END || line, CAST(copies AS INT)), '' ORDER BY change_type = 'added', line) AS diff
    FROM ({LINE_DIFF}) q GROUP BY first_run, second_run, block_key, command""")
FILE_TEXT = f"""'***************HOST INFO***************' || chr(10) || '$ uname -a' || chr(10) || 'Linux n 5.' || {s('x.nation')} || '.' || {s('x.r')} || ' #1 SMP x86_64 GNU/Linux' || chr(10) || '===================================' || chr(10)
    || CASE WHEN g.body IS NULL THEN '' ELSE '***************USER INFO***************' || chr(10) || '$ getent group sudo root wheel adm admin' || chr(10) || g.body || chr(10) || '===================================' || chr(10) END"""
FACTS["fx_ftext"] = f"SELECT x.h, x.r, x.run_id, x.ip, x.ts, x.path, {FILE_TEXT} AS text, g.body FROM fx_runs x LEFT JOIN fx_gtext g ON g.h = x.h AND g.r = x.r"


def _summary(f):
    snaps, blocks, pairs = _diff_inputs(f, ("uname_a", "priv_groups"))
    return diff.diff_summary(blocks, src.runs_registry(snaps), pairs)


case("diff_summary", _summary, f"""SELECT a.run_id AS first_run, b.run_id AS second_run, CASE WHEN a.body IS NULL OR a.body = b.body THEN 1 ELSE 2 END AS changed_count, a.ip AS first_ip, {iso('a.ts')} AS first_collected_at, strlen(a.text) AS first_size, md5(a.text) AS first_md5,
    b.ip AS second_ip, {iso('b.ts')} AS second_collected_at, strlen(b.text) AS second_size, md5(b.text) AS second_md5,
    CASE WHEN a.body IS NULL OR a.body = b.body THEN '["uname -a"]' WHEN b.body IS NULL THEN '["uname -a","getent group sudo root wheel adm admin (missing in second)"]' ELSE '["uname -a","getent group sudo root wheel adm admin"]' END AS changed_commands
    FROM fx_ftext a JOIN fx_ftext b ON b.h = a.h AND b.r = 2 WHERE a.r = 1""")
