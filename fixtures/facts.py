"""What a fleet rendered from the driver tables contains, as SQL that Spark and DuckDB both run.

Each fact is one row set keyed by host `h` (a supplier) and run `r` (0, 1, 2). Spark turns facts into
snapshot text; DuckDB uses the same facts directly as the expected rows. Rows are dealt to hosts by
their own key modulo the number of hosts, so every table row is used and no host grows with the data.
"""

from __future__ import annotations

import re


class Dialect:
    """The few spots where the two SQL dialects differ."""

    def __init__(self, engine: str, prefix: str = "", counts: dict[str, int] | None = None, parts: int | None = None):
        self.engine, self.prefix, self.counts, self.parts = engine, prefix, counts or {}, parts

    @property
    def spark(self) -> bool:
        return self.engine == "spark"

    def t(self, name: str) -> str:
        return f"{self.prefix}{name}" if self.spark else name

    def count(self, name: str) -> str:
        """Rows of a table."""
        return f"CAST({self.counts[name]} AS BIGINT)" if name in self.counts else f"(SELECT count(*) FROM {self.t(name)})"

    def host(self, key: str) -> str:
        """The host of a row that `dealt` gives."""
        return "dealt_h" if self.spark else f"{key} % {self.count('supplier')}"

    def runs_of(self, source: str) -> str:
        """FROM clause: every source row in each of the three runs."""
        if self.spark:
            return f"{source} LATERAL VIEW explode(array(0, 1, 2)) rr AS r"
        return f"{source} CROSS JOIN (SELECT unnest([0, 1, 2]) AS r) rr"

    def dealt(self, name: str, key: str) -> str:
        """`runs_of` a table. Spark deals its rows out by host first: narrow rows, once, instead of three runs of rendered lines in every later step."""
        if self.spark:
            return self.runs_of(f"(SELECT {self.by_host('dealt_h')}*, {key} % {self.count('supplier')} AS dealt_h FROM {self.t(name)}) dealt")
        return self.runs_of(name)

    def by_host(self, h: str = "h") -> str:
        return f"/*+ REPARTITION({self.parts}, {h}) */ " if self.spark and self.parts else ""

    def plus_seconds(self, ts: str, seconds: str) -> str:
        return f"timestampadd(SECOND, {seconds}, {ts})" if self.spark else f"({ts} + to_seconds({seconds}))"

    def fmt(self, ts: str, spark_format: str, c_format: str) -> str:
        return f"date_format({ts}, \"{spark_format}\")" if self.spark else f"strftime({ts}, '{c_format}')"

    def iso(self, ts: str) -> str:
        return self.fmt(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'", "%Y-%m-%dT%H:%M:%SZ")

    def ymd(self, ts: str) -> str:
        return self.fmt(ts, "yyyyMMdd", "%Y%m%d")

    def day_month(self, ts: str) -> str:
        """`Jan 5` without padding."""
        if self.spark:
            return f"date_format({ts}, 'MMM d')"
        return f"(strftime({ts}, '%b') || ' ' || CAST(extract(day FROM {ts}) AS STRING))"

    def weekday(self, ts: str) -> str:
        return self.fmt(ts, "EEE", "%a")

    def clock(self, ts: str) -> str:
        return self.fmt(ts, "HH:mm", "%H:%M")

    def minute(self, ts: str) -> str:
        return f"date_trunc('minute', {ts})"

    def sha256(self, s: str) -> str:
        return f"sha2({s}, 256)" if self.spark else f"sha256({s})"

    def base64(self, s: str) -> str:
        return f"base64(CAST({s} AS BINARY))" if self.spark else f"base64(encode({s}))"

    def join_sorted(self, x: str, sep: str = ",") -> str:
        if self.spark:
            return f"array_join(array_sort(collect_list({x})), '{sep}')"
        return f"string_agg({x}, '{sep}' ORDER BY {x})"

    def chr10(self) -> str:
        return "char(10)" if self.spark else "chr(10)"


def div(a: str, b: str) -> str:
    return f"CAST(floor({a} / {b}) AS BIGINT)"


def s(x: str) -> str:
    return f"CAST({x} AS STRING)"


def i(x: str) -> str:
    return f"CAST(floor({x}) AS INT)"


FIRST_RUN = "TIMESTAMP '2024-02-01 00:00:00'"


def facts(d: Dialect) -> dict[str, str]:
    """Fact name -> SELECT text; a fact may use earlier facts by name."""
    t = d.t
    n = d.count("supplier")
    F: dict[str, str] = {}

    # ---- hosts and runs ----
    F["hosts"] = f"""SELECT {d.by_host()}s_suppkey AS h, s_nationkey AS nation, s_acctbal AS bal, s_name,
        'host-' || {s('s_suppkey')} AS base_name,
        '10.' || {s(div('s_suppkey', '62500'))} || '.' || {s(div('s_suppkey', '250') + ' % 250')} || '.' || {s('s_suppkey % 250 + 1')} AS ip
        FROM {t('supplier')}"""
    ts = d.plus_seconds(FIRST_RUN, "h + r * 604800")
    F["fx_runs0"] = f"SELECT h, r, nation, bal, s_name, base_name, ip, {ts} AS ts FROM {d.runs_of('hosts')}"
    F["fx_runs1"] = f"""SELECT h, r, nation, bal, s_name, base_name, ip, ts,
        '/fleet/' || ip || '_' || {d.fmt('ts', "yyyyMMdd_HH:mm:ss", '%Y%m%d_%H:%M:%S')} || 'Z.txt' AS path FROM fx_runs0"""
    # run 1 spells the name with '_', run 2 renames a third of the hosts; the MAC changes after run 0;
    # every 17th host has an all-zero UUID; machine ids are shared by all hosts of a nation (cloned images)
    F["fx_runs"] = f"""SELECT h, r, nation, bal, s_name, base_name, ip, ts, path, {d.ymd('ts')} || '-' || md5(path) AS run_id,
        CASE WHEN r = 1 THEN 'host_' || {s('h')} WHEN r = 2 AND h % 3 = 0 THEN 'srv-' || {s('h')} ELSE base_name END AS hostname,
        CASE WHEN h % 3 = 0 THEN 'srv-' || {s('h')} ELSE base_name END AS current_name,
        CASE WHEN r = 0 AND h % 17 <> 0 THEN '02:00:00:' ELSE '02:00:01:' END || lpad({s(div('h', '10000') + ' % 100')}, 2, '0') || ':' || lpad({s(div('h', '100') + ' % 100')}, 2, '0') || ':' || lpad({s('h % 100')}, 2, '0') AS mac,
        CASE WHEN h % 17 = 0 THEN '00000000-0000-0000-0000-000000000000' ELSE md5('uuid' || {s('h')}) END AS uuid,
        md5('image' || {s('nation')}) AS machine_id,
        CASE WHEN h % 2 = 0 THEN 'Etc/UTC (UTC, +0000)' ELSE 'Etc/GMT-2 (+02, +0200)' END AS time_zone,
        CASE WHEN h % 2 = 0 THEN 0 ELSE 7200 END AS utc_offset,
        (SELECT count(*) FROM {t('supplier')}) AS n
        FROM fx_runs1"""

    # ---- accounts ----
    F["fx_users"] = f"""SELECT {d.host('c_custkey')} AS h, r, 'user' || {s('c_custkey')} AS username, {i('500 + c_custkey')} AS uid,
        {i('900 + c_nationkey * 10')} AS gid, c_name AS gecos, '/home/user' || {s('c_custkey')} AS home,
        CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '/bin/bash' WHEN 'BUILDING' THEN '/bin/sh' WHEN 'FURNITURE' THEN '/usr/sbin/nologin'
            WHEN 'HOUSEHOLD' THEN '/usr/bin/ZSH' ELSE '/bin/false' END AS shell,
        c_custkey AS k, c_acctbal AS bal, c_nationkey AS nation FROM {d.dealt('customer', 'c_custkey')}"""
    F["fx_groups"] = f"""SELECT h, r, 'grp' || {s('nation')} AS groupname, gid, {d.join_sorted('username')} AS members_csv
        FROM fx_users GROUP BY h, r, nation, gid"""
    F["fx_priv_members"] = """SELECT h, r, 'sudo' AS groupname, 27 AS gid, username, uid FROM fx_users WHERE bal > 9000 - 200 * r
        UNION ALL SELECT h, r, 'adm', 4, username, uid FROM fx_users WHERE bal < -700 + 100 * r
        UNION ALL SELECT h, r, 'wheel', 10, username, uid FROM fx_users WHERE bal > 4000 + 50 * r AND bal < 4500"""
    F["fx_priv_groups"] = f"""SELECT h, r, groupname, gid, {d.join_sorted('username')} AS members_csv FROM fx_priv_members GROUP BY h, r, groupname, gid"""
    F["fx_passwd_status"] = f"""SELECT h, r, k, username, CASE WHEN bal > 6000 THEN 'P' WHEN bal > 2000 + r THEN 'L' ELSE 'NP' END AS status_code,
        '11/13/2023' AS last_change, '0' AS min_age, '99999' AS max_age, '7' AS warn, '-1' AS inactive FROM fx_users"""
    login = d.plus_seconds("TIMESTAMP '2024-01-01 00:00:00'", "(k % 30) * 86400 + (k % 1440) * 60")
    F["fx_lastlog"] = f"""SELECT h, r, k, username, CASE WHEN bal >= 1000 THEN 'pts/' || {s('k % 9')} END AS port,
        CASE WHEN bal >= 1000 THEN '10.9.0.' || {s('k % 250')} END AS from_host,
        CASE WHEN bal < 1000 THEN 'Never logged in' ELSE {d.fmt(login, 'EEE MMM dd HH:mm:ss', '%a %b %d %H:%M:%S')} || ' +0000 2024' END AS latest FROM fx_users"""
    # keys: one per order, owned by a customer of the same host
    m = d.count("customer")
    owner = f"(o_orderkey % {m})"
    F["fx_keys"] = f"""SELECT {d.host(owner)} AS h, r, o_orderkey AS k, o_orderkey % {m} AS owner, 'user' || {s(f'o_orderkey % {m}')} AS username,
        CASE WHEN o_totalprice < 100000 THEN 'ssh-rsa' WHEN o_totalprice < 300000 THEN 'ssh-ed25519' ELSE 'ecdsa-sha2-nistp256' END AS key_type,
        'blob-' || {s('o_orderkey')} AS blob, 'key ' || {s('o_orderkey')} AS key_comment
        FROM {d.dealt('orders', owner)}"""
    F["fx_events"] = f"""SELECT {d.host('event_id')} AS h, r, event_id AS k, ts AS event_ts, {d.minute('ts')} AS minute_ts, user_id, event_type, value,
        'user' || {s('user_id')} AS username, CASE WHEN value < 20 THEN 'ssh:notty' WHEN value < 60 THEN 'pts/' || {s('event_id % 7')} ELSE 'tty' || {s('event_id % 5')} END AS tty,
        '10.9.' || {s(div('event_id', '250') + ' % 250')} || '.' || {s('event_id % 250 + 1')} AS remote_host
        FROM {d.dealt('events', 'event_id')}"""
    F["fx_logins"] = f"""SELECT h, r, k, CASE event_type WHEN 'error' THEN 'btmp' WHEN 'view' THEN 'utmp' ELSE 'wtmp' END AS source, username, tty, remote_host,
        {d.weekday('event_ts')} || ' ' || {d.day_month('event_ts')} || ' ' || {d.clock('event_ts')} AS start_text, event_type, minute_ts,
        CASE WHEN event_type IN ('view', 'click') THEN NULL ELSE {d.clock('event_ts')} END AS end_text,
        CASE WHEN event_type IN ('view', 'click') THEN NULL ELSE '00:0' || {s('k % 9')} END AS duration_text,
        CASE event_type WHEN 'view' THEN 'still_logged_in' WHEN 'click' THEN 'gone_no_logout' END AS status_text FROM fx_events"""

    # ---- software ----
    F["fx_packages"] = f"""SELECT DISTINCT {d.host('l_orderkey')} AS h, r, 'pkg' || {s('l_partkey')} || '-' || {s('l_linenumber')} AS name,
        {s(i('l_quantity'))} || '.' || {s("CASE WHEN l_returnflag = 'R' THEN r ELSE 0 END")} AS version,
        CASE WHEN l_linestatus = 'O' THEN 'amd64' ELSE 'all' END AS arch, CASE WHEN l_returnflag = 'A' THEN 'rc' ELSE 'ii' END AS status,
        'part ' || {s('l_partkey')} AS summary FROM {d.dealt('lineitem', 'l_orderkey')}"""
    F["fx_rpms"] = f"SELECT {d.host('page_id')} AS h, r, page_id AS k, 'svc' || {s('page_id % 60')} || '-lib' || {s('page_id')} || '-1.x86_64' AS name FROM {d.dealt('pages', 'page_id')}"
    F["fx_modules0"] = f"""SELECT DISTINCT {d.host('c_custkey')} AS h, r, CASE WHEN c_acctbal < 1000 THEN 'mod_' || {s('c_custkey')} WHEN c_acctbal < 4000 THEN 'pair_' || {s(div('c_custkey', '2'))}
        WHEN c_acctbal < 7000 THEN 'kvm' ELSE 'snd_n' || {s('c_nationkey')} END AS module FROM {d.dealt('customer', 'c_custkey')}"""
    F["fx_modules"] = f"""SELECT h, r, module, {i('length(module) * 4096')} AS size, {i('length(module) % 3')} AS used_by_count,
        CASE WHEN length(module) % 3 > 0 THEN 'bridge,stp' ELSE '' END AS used_by,
        CASE WHEN module LIKE 'mod%' THEN 'Proprietary' ELSE 'GPL' END AS license,
        CASE WHEN module LIKE 'pair%' THEN 'Unknown' ELSE 'Build key' END AS signer, 'driver ' || module AS description FROM fx_modules0"""
    F["fx_orders"] = f"""SELECT {d.host('o_orderkey')} AS h, r, o_orderkey AS k, o_orderstatus AS st, o_orderpriority AS prio, o_totalprice AS price, {i('300 + o_orderkey')} AS pid,
        {i(f'CASE WHEN o_orderkey >= {n} AND o_totalprice > 150000 THEN 300 + o_orderkey - {n} ELSE 1 END')} AS ppid,
        CASE WHEN o_orderstatus = 'F' THEN 'root' WHEN o_orderstatus = 'O' THEN 'user' || {s(f'o_orderkey % {m}')} ELSE {s(f'500 + o_orderkey % {m}')} END AS uid FROM {d.dealt('orders', 'o_orderkey')}"""
    F["fx_processes"] = f"""SELECT h, r, k, st, prio, pid, ppid, uid,
        CASE substr(prio, 1, 1) WHEN '1' THEN '/usr/sbin/svc' || {s('k % 50')} WHEN '2' THEN '/opt/app/run' || {s('k')} WHEN '3' THEN '[kworker/' || {s('k % 8')} || ']'
            WHEN '4' THEN '/usr/bin/python3' ELSE 'bash' END AS process_path,
        CASE substr(prio, 1, 1) WHEN '1' THEN 'svc' || {s('k % 50')} WHEN '2' THEN 'run' || {s('k')} WHEN '3' THEN '[kworker/' || {s('k % 8')} || ']'
            WHEN '4' THEN 'python3' ELSE 'bash' END AS process_name,
        CASE substr(prio, 1, 1) WHEN '1' THEN '--port 80' WHEN '2' THEN '--id ' || {s('k')} WHEN '3' THEN '' WHEN '4' THEN '-c import os' ELSE '-i /tmp/x' || {s('k % 5')} END AS process_arguments,
        CASE WHEN price < 200000 THEN '10:0' || {s('k % 10')} WHEN price < 300000 THEN '23:5' || {s('k % 10')} ELSE 'Jan0' || {s('k % 9 + 1')} END AS start,
        CASE WHEN price < 200000 THEN 1 WHEN price < 300000 THEN 2 ELSE 3 END AS start_kind FROM fx_orders"""
    F["fx_cmds"] = """SELECT h, r, k, st, prio, pid, ppid, uid, process_path, process_name, process_arguments, start, start_kind,
        CASE WHEN process_arguments = '' THEN process_path ELSE process_path || ' ' || process_arguments END AS cmd FROM fx_processes"""
    F["fx_sockets"] = f"""SELECT o.h, o.r, o.k, CASE WHEN o.price > 300000 THEN 'udp' ELSE 'tcp' END AS proto, CASE WHEN o.st = 'O' THEN 'LISTEN' ELSE 'ESTAB' END AS state,
        CASE substr(o.prio, 1, 1) WHEN '1' THEN '0.0.0.0' WHEN '2' THEN '127.0.0.1' WHEN '3' THEN '::' WHEN '4' THEN h.ip ELSE '169.254.0.9' END AS local_addr,
        CASE WHEN o.price < 20000 THEN 22 ELSE {i('1024 + o.k % 60000')} END AS local_port,
        CASE WHEN o.st = 'O' THEN '*' ELSE '10.8.0.' || {s('o.k % 250')} END AS peer_addr, CASE WHEN o.st = 'O' THEN NULL ELSE {i('2000 + o.k % 1000')} END AS peer_port,
        'svc' || {s('o.k % 50')} AS process_name, o.pid, CASE substr(o.prio, 1, 1) WHEN '1' THEN 'all_interfaces' WHEN '2' THEN 'loopback' WHEN '3' THEN 'all_interfaces' ELSE 'specific' END AS bind_scope
        FROM fx_orders o JOIN hosts h ON o.h = h.h"""
    F["fx_parts"] = f"""SELECT {d.host('p_partkey')} AS h, r, p_partkey AS k, p_name, p_type, p_brand, p_size, p_retailprice, {n} AS n FROM {d.dealt('part', 'p_partkey')}"""
    F["fx_units"] = """SELECT h, r, k, CASE WHEN k < n THEN 'rsyslog' ELSE 'unit' || CAST(k AS STRING) END || CASE WHEN p_size < 20 THEN '.service' WHEN p_size < 30 THEN '.socket' WHEN p_size < 40 THEN '.mount' ELSE '.device' END AS unit,
        CASE WHEN p_size < 20 THEN 'service' WHEN p_size < 30 THEN 'socket' WHEN p_size < 40 THEN 'mount' ELSE 'other' END AS unit_type,
        'loaded' AS load, CASE WHEN p_size % 2 = 0 THEN 'active' ELSE 'inactive' END AS active, CASE WHEN p_size % 2 = 0 THEN 'running' ELSE 'dead' END AS sub, p_name AS description FROM fx_parts"""
    mt = d.plus_seconds("TIMESTAMP '2023-03-01 00:00:00'", "(k % 200) * 86400")
    mt2 = d.plus_seconds("TIMESTAMP '2024-01-01 00:00:00'", "(k % 28) * 86400 + (k % 1440) * 60")
    F["fx_files0"] = f"""SELECT h, r, k, p_size, p_brand,
        CASE WHEN p_size < 12 THEN 'ls_etc_cron' WHEN p_size < 18 THEN 'ls_var_spool_cron' WHEN p_size < 32 THEN 'ls_etc_systemd_system' WHEN p_size < 42 THEN 'ls_etc_init_d' ELSE 'recent_bins' END AS tag,
        CASE WHEN p_size < 18 THEN 'cron_dirs' WHEN p_size < 32 THEN 'systemd_dirs' WHEN p_size < 42 THEN 'init_dirs' ELSE 'recent_bins' END AS source,
        CASE WHEN p_size < 12 THEN '/etc/cron.d' WHEN p_size < 18 THEN '/var/spool/cron' WHEN p_size < 32 THEN '/etc/systemd/system' WHEN p_size < 42 THEN '/etc/init.d' END AS directory,
        CASE WHEN p_brand < 'Brand#14' THEN '-rw-r--r--' WHEN p_brand < 'Brand#2' THEN '-rwsrw-rwx' WHEN p_brand < 'Brand#25' THEN 'lrwxrwxrwx' ELSE '-rwxr-xr-x' END AS perms,
        CASE WHEN p_brand < 'Brand#14' THEN 644 WHEN p_brand < 'Brand#2' THEN 767 WHEN p_brand < 'Brand#25' THEN 777 ELSE 755 END AS perm_octal,
        CASE WHEN p_size >= 42 THEN '/usr/bin/' ELSE '' END || 'f' || {s('k')} || CASE WHEN p_size >= 18 AND p_size < 32 THEN '.service' ELSE '' END AS name,
        {i('p_retailprice')} AS size_bytes, CASE WHEN p_retailprice < 950 THEN {d.day_month(mt)} || ' 2023' ELSE {d.day_month(mt2)} || ' ' || {d.clock(mt2)} END AS mtime_text,
        CASE WHEN p_retailprice < 950 THEN date_trunc('day', {mt}) ELSE {mt2} END AS mtime_local FROM fx_parts"""
    F["fx_files"] = f"""SELECT f.h, f.r, f.k, f.tag, f.source, f.directory, CASE WHEN f.directory IS NULL THEN f.name ELSE f.directory || '/' || f.name END AS path, f.perms, f.perm_octal,
        'root' AS owner, 'adm' AS grp, f.size_bytes, f.mtime_text, {d.plus_seconds('f.mtime_local', '-x.utc_offset')} AS mtime_utc, f.name,
        CASE WHEN f.perms LIKE 'l%' THEN 'link' ELSE 'file' END AS file_type, CASE WHEN f.perms LIKE 'l%' THEN 1 ELSE 0 END AS is_symlink,
        CASE WHEN f.perms LIKE 'l%' THEN '/opt/t' || {s('f.k')} END AS symlink_target, x.ts, x.run_id FROM fx_files0 f JOIN fx_runs x ON f.h = x.h AND f.r = x.r"""
    F["fx_containers"] = f"""SELECT {d.host('doc_id')} AS h, r, doc_id AS k, lpad({s('doc_id')}, 12, '0') AS container_id, 'img/' || lang || ':' || source AS image,
        CASE WHEN n_chars > 2000 THEN 'Up ' || {s('doc_id % 20 + 2')} || ' days' ELSE 'Exited (0) ' || {s('doc_id % 20 + 2')} || ' hours ago' END AS status,
        {s('doc_id % 9 + 2')} || ' weeks ago' AS created_text, 'doc' || {s('doc_id')} AS names FROM {d.dealt('documents', 'doc_id')}"""
    F["fx_pods"] = f"""SELECT DISTINCT {d.host('conv_id')} AS h, r, conv_id AS k, lpad({s('conv_id')}, 12, 'a') AS container_id FROM {d.dealt('conversations', 'conv_id')}"""
    F["fx_docs"] = f"SELECT {d.host('doc_id')} AS h, r, doc_id AS k, text FROM {d.dealt('documents', 'doc_id')}"
    F["fx_firewall"] = f"""SELECT h, r, k, 'iptables_s' AS source, '-A INPUT -p tcp --dport ' || {s('local_port')} || ' -j ACCEPT' AS rule, 'INPUT' AS chain, 'ACCEPT' AS target FROM fx_sockets WHERE state = 'LISTEN' AND proto = 'tcp'
        UNION ALL SELECT h, r, k, 'ufw_raw', {s('local_port')} || '/udp DENY from k' || {s('k')}, NULL, NULL FROM fx_sockets WHERE state = 'LISTEN' AND proto = 'udp'
        UNION ALL SELECT h, r, k, 'firewalld_zones', 'zone' || {s('k')} || ' -j NONE', NULL, NULL FROM fx_sockets WHERE state = 'ESTAB' AND proto = 'udp'
        UNION ALL SELECT h, r, k, 'iptables_list', {s('k')} || ' DROP tcp dpt:' || {s('local_port')}, NULL, NULL FROM fx_sockets WHERE state = 'ESTAB' AND proto = 'tcp'"""
    F["fx_usb"] = f"""SELECT {d.host('vec_id')} AS h, r, vec_id AS k, {i('label % 7 + 1')} AS bus_number, {i('vec_id % 1000')} AS device_number,
        CASE label % 5 WHEN 0 THEN '1d6b' WHEN 1 THEN '8086' WHEN 2 THEN '0bda' WHEN 3 THEN '0e8d' ELSE 'abcd' END AS vendor_id, lpad({s(div('vec_id', '3'))}, 4, '0') AS product_id,
        'Vendor ' || {s('label % 5')} AS vendor_name, 'Product ' || {s(div('vec_id', '3'))} AS product_name, CASE label % 3 WHEN 0 THEN 9 WHEN 1 THEN 8 ELSE 255 END AS device_class,
        CASE label % 3 WHEN 0 THEN '9' WHEN 1 THEN '0x08' ELSE 'ff' END AS class_text, CASE label % 3 WHEN 0 THEN 'Hub' WHEN 1 THEN 'Mass Storage' ELSE 'Vendor' END AS device_class_label,
        'SN' || {s('vec_id')} AS serial_number FROM {d.dealt('embeddings', 'vec_id')}"""

    # ---- one row per run ----
    F["fx_host"] = f"""SELECT h, r, ip, run_id, ts, nation, bal, n, {i('8 + abs(bal) / 100')} AS mem_gb, {i('abs(bal) % 8')} AS swap_gb,
        {i('1 + nation % 3')} AS disk_tb, CASE WHEN bal > 3000 THEN 'Ubuntu' ELSE 'Rocky Linux' END AS os_name, '22.0' || {s('nation % 5')} AS os_version,
        '5.' || {s('nation')} || '.' || {s('r')} AS kernel, CASE WHEN bal > 2000 + 500 * r THEN '1' WHEN bal > 500 THEN '2' ELSE '0' END AS audit_enabled,
        CASE WHEN nation % 3 = 0 THEN 'enforcing' WHEN nation % 3 = 1 THEN 'permissive' ELSE 'disabled' END AS selinux,
        {i('nation + 10')} AS profiles_loaded, {i('CASE WHEN bal > 4000 THEN nation + 10 ELSE nation END')} AS profiles_enforce, {i('CASE WHEN bal > 4000 THEN 0 ELSE 10 END')} AS profiles_complain,
        {i('CASE WHEN bal > 8000 THEN 0 ELSE 4 END')} AS processes_enforce,
        CASE nation % 4 WHEN 0 THEN '8.8.8.8' WHEN 1 THEN '127.0.0.53' WHEN 2 THEN '10.0.0.2' ELSE 'dns.example.com' END AS nameserver,
        CASE WHEN bal > 5000 THEN 1 ELSE 0 END AS two_routes FROM fx_runs"""
    F["fx_inventory"] = f"""SELECT current_name AS hostname, CASE WHEN h % 4 = 0 THEN 'restricted' ELSE 'internal' END AS classification, 'rack ' || {s('nation')} AS location,
        CAST(x.mem_gb + CASE WHEN x.bal < 2000 THEN 8 WHEN x.bal < 4000 THEN -2 ELSE 0 END AS DOUBLE) AS memory_capacity_gb,
        {i('CASE WHEN x.bal < 1000 THEN NULL ELSE x.nation + 2 END')} AS proc_no_cores, 2 AS proc_count,
        1 AS storage_hdd_no_drives, CAST(x.disk_tb * 1000 + CASE WHEN x.bal < 3000 THEN 0 ELSE 100 END AS DOUBLE) AS storage_hdd_capacity_gb, 1 AS storage_nvme_no_drives,
        CAST(500 AS DOUBLE) AS storage_nvme_capabity_gb, CASE WHEN x.nation < 5 THEN NULL ELSE CAST(10 AS DOUBLE) END AS storage_ssd_capabity_gb,
        'ubuntu' AS os_name, '22.04' AS os_version, x.ip AS primary_ip FROM (SELECT q.*, w.current_name FROM fx_host q JOIN fx_runs w ON q.h = w.h AND q.r = w.r) x WHERE r = 0"""
    return F


def with_facts(sql: str, fact_sql: dict[str, str]) -> str:
    """Prefix a query with the facts it uses, directly or through other facts."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in fact_sql:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(fact_sql[name])

    visit(sql)
    ctes = [f"{name} AS ({fact_sql[name]})" for name in fact_sql if name in needed]
    body = sql.strip()
    if not ctes:
        return body
    if re.match(r"(?i)with\s", body):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[4:].strip()
    return "WITH " + ",\n".join(ctes) + "\n" + body
