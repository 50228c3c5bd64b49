"""Per-run posture. Each table is one aggregation by run over a union of narrow inputs:
no joins between the inputs, and partial aggregation before the only shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.functions.scalars import is_global_address, is_internal_name, is_loopback_address
from fleetlens.functions.text import literal_map, contains_any, flag


def _notes(rows: DataFrame, kind: str, text: Column | str) -> DataFrame:
    t = F.col(text) if isinstance(text, str) else text
    return rows.select("run_id", F.lit(kind).alias("kind"), t.alias("note"))


def _seen(*tables: DataFrame) -> DataFrame:
    """Marks runs that have any input, so that runs without notes still get a row."""
    out = None
    for t in tables:
        part = t.select("run_id").distinct().select("run_id", F.lit("seen").alias("kind"), F.lit(None).cast("string").alias("note"))
        out = part if out is None else out.unionByName(part)
    return out


def _list(kind: str, distinct: bool = False) -> Column:
    collect = F.collect_set if distinct else F.collect_list
    return F.array_sort(collect(F.when(F.col("kind") == kind, F.col("note"))))


def run_audit_posture(status: DataFrame, rules: DataFrame) -> DataFrame:
    """Flags from the audit status and rules. `enabled 2` means enabled and locked."""
    key, path = F.lower(F.coalesce("key_name", F.lit(""))), F.coalesce("path", F.lit(""))
    calls = F.split(F.lower(F.coalesce("syscall", F.lit(""))), ",")
    has = {}
    for name, (syscalls, paths, keys) in C.AUDIT_FLAG_WORDS.items():
        hit = key.isin(keys) | contains_any(path, paths)
        if syscalls:
            hit = hit | F.arrays_overlap(calls, F.array(*[F.lit(s) for s in syscalls]))
        has[name] = hit
    has["has_executable_rules"] = (F.col("rule_type") == "file") & contains_any(path, C.EXECUTABLE_DIRS)
    none = F.lit(None).cast("boolean")
    k, v = F.col("k"), F.lower("v")
    from_status = status.select(
        "run_id",
        ((k == "enabled") & v.isin("1", "2")).alias("audit_enabled"),
        (((k == "enabled") & (v == "2")) | ((k == "immutable") & (v == "1"))).alias("audit_immutable"),
        *[none.alias(n) for n in has])
    from_rules = rules.select("run_id", none.alias("audit_enabled"), none.alias("audit_immutable"),
                              *[h.alias(n) for n, h in has.items()])
    names = ["audit_enabled", "audit_immutable", *has]
    return from_status.unionByName(from_rules).groupBy("run_id").agg(*[flag(F.bool_or(n)).alias(n) for n in names])


def run_selinux_posture(status: DataFrame, booleans: DataFrame) -> DataFrame:
    risky = F.col("boolean_name").isin(C.HIGH_RISK_BOOLEANS)
    s = status.select("run_id", F.col("k").alias("kind"), F.lower("v").alias("note"))
    b = booleans.select("run_id", F.when(risky, F.when(F.col("state") == "on", "on").otherwise("off")).alias("kind"),
                        F.col("boolean_name").alias("note"))
    is_ = lambda key, value: F.bool_or((F.col("kind") == key) & (F.col("note") == value))
    g = s.unionByName(b).groupBy("run_id").agg(
        F.coalesce(is_("SELinux status", "enabled"), F.lit(False)).alias("on"),
        F.coalesce(is_("Current mode", "enforcing"), F.lit(False)).alias("enforcing"),
        F.coalesce(is_("Current mode", "permissive"), F.lit(False)).alias("permissive"),
        _list("on").alias("high_risk_booleans_on"), _list("off").alias("high_risk_booleans_off"))
    on = F.col("on")
    return g.select(
        "run_id", flag(on).alias("selinux_enabled"), flag(on & F.col("enforcing")).alias("selinux_enforcing"),
        flag(on & F.col("permissive")).alias("selinux_permissive"), flag(~on).alias("selinux_disabled"),
        "high_risk_booleans_on", "high_risk_booleans_off")


def run_apparmor_posture(status: DataFrame) -> DataFrame:
    loaded, enforce, complain, running = (
        F.coalesce(c, F.lit(0)) for c in ("profiles_loaded", "profiles_enforce", "profiles_complain", "processes_enforce"))
    return status.select(
        "run_id", flag(loaded > 0).alias("apparmor_enabled"), flag(loaded > 0).alias("apparmor_profiles_loaded"),
        flag((loaded > 0) & (complain == 0) & (loaded == enforce)).alias("apparmor_all_enforcing"),
        flag((loaded > 0) & (complain > 0)).alias("apparmor_mixed_mode"),
        flag((loaded > 0) & (running == 0)).alias("apparmor_processes_unconfined"))


def run_network_posture(resolv: DataFrame, routes: DataFrame, neigh: DataFrame) -> DataFrame:
    ns = resolv.filter("entry_type = 'nameserver' AND entry_value <> ''").select("run_id", F.col("entry_value").alias("ip"))
    is_public, ip = is_global_address("ip"), F.col("ip")
    labels = (
        F.when(is_public, F.concat(F.lit("Public nameserver: "), ip))
        .when(is_loopback_address("ip"), F.concat(F.lit("Localhost nameserver: "), ip))
        .when(is_public.isNull() & ~is_internal_name("ip"), F.concat(F.lit("External hostname nameserver: "), ip))
    )
    odd = routes.filter(F.col("destination").isin(C.SUSPICIOUS_NETWORKS))
    mac = F.lower("lladdr")
    ouis = literal_map(C.SUSPICIOUS_OUIS)
    oui = F.try_element_at(ouis, F.substring(mac, 1, 8))
    strange = neigh.filter(mac.isNotNull() & (mac != "00:00:00:00:00:00") & oui.isNotNull())
    notes = (
        _seen(resolv, routes, neigh)
        .unionByName(_notes(ns.filter(is_public), "unexpected", "ip"))
        .unionByName(_notes(ns, "flag", labels).filter("note IS NOT NULL"))
        .unionByName(_notes(routes.filter("destination = '0.0.0.0'"), "default", "destination"))
        .unionByName(_notes(odd, "route", F.concat(F.lit("Suspicious route to "), "destination", F.lit(" via "), "iface")))
        .unionByName(_notes(strange, "oui", F.concat(
            mac, F.lit(" ("), oui, F.lit(") on "), F.coalesce("dev", F.lit("unknown")))))
    )
    return notes.groupBy("run_id").agg(
        _list("unexpected").alias("unexpected_nameservers"),
        flag(F.count_if(F.col("kind") == "default") > 1).alias("multiple_default_routes"),
        _list("route").alias("suspicious_routes"), _list("oui").alias("unknown_mac_ouis"),
        _list("flag").alias("nameserver_flags"))


def run_process_insights(processes: DataFrame, sockets: DataFrame) -> DataFrame:
    """Suspicious root commands (one note per matching pattern) and unusual listening ports.

    The pattern list is fixed, so matching is an expression on the row, not a cross join.
    """
    cmd = F.lower("cmd")
    hits = F.array_compact(F.array(*[F.when(cmd.rlike(p), F.lit(i)) for i, p in enumerate(C.SUSPICIOUS_ROOT_COMMANDS)]))
    text = F.concat(F.lit("PID "), F.coalesce(F.col("pid").cast("string"), F.lit("None")), F.lit(": "), cmd)
    root = processes.filter("uid IN ('0', 'root')").select("run_id", text.alias("text"), F.explode(hits).alias("pattern"))
    odd_port = (F.col("state") == "LISTEN") & (F.col("local_port") > 1024) & ~F.col("local_port").isin(C.KNOWN_PORTS)
    port_text = F.concat(F.lit("Port "), F.col("local_port").cast("string"), F.lit(" listening (unusual)"))
    notes = (
        _seen(processes, sockets)
        .unionByName(_notes(root, "root", "text"))
        .unionByName(_notes(sockets.filter(odd_port).select("run_id", "local_port").distinct(), "port", port_text))
    )
    return notes.groupBy("run_id").agg(
        _list("root").alias("suspicious_root_processes"), _list("port", distinct=True).alias("unusual_listening_services"),
        F.array().cast("array<string>").alias("process_tree_issues"))


def run_kernel_module_insights(lsmod: DataFrame, modinfo: DataFrame) -> DataFrame:
    """Modules outside the common set, doubtful licences and signers."""
    info = (
        modinfo.select("run_id", "module", F.lower("k").alias("k"), F.trim("v").alias("v"))
        .filter("k IN ('license', 'signer') AND v <> ''")
        .groupBy("run_id", "module")
        .agg(F.max(F.when(F.col("k") == "license", F.col("v"))).alias("license"),
             F.max(F.when(F.col("k") == "signer", F.col("v"))).alias("signer"))
    )
    rows = lsmod.select("run_id", "module").join(info, ["run_id", "module"], "left")
    bad_license = contains_any(F.col("license"), C.SUSPICIOUS_LICENSES)
    picks = lambda condition, text: F.array_sort(F.collect_list(F.when(condition, text)))
    by_run = rows.groupBy("run_id").agg(
        picks(~F.col("module").isin(C.COMMON_MODULES), F.col("module")).alias("unusual_modules"),
        picks(bad_license, F.concat_ws(": ", "module", "license")).alias("suspicious_licenses"),
        picks(F.lower("signer").isin(C.UNTRUSTED_SIGNERS), F.col("module")).alias("modules_with_unknown_signer"))
    return by_run


def run_persistence_insights(listings: DataFrame, runs: DataFrame, recent_days: int = 30) -> DataFrame:
    """Cron and systemd entries worth a look; "recent" means modified within `recent_days` before the run."""
    rows = listings.join(runs.select("run_id", "collected_at_utc"), "run_id")
    source, path = F.col("source"), F.col("path")
    unit = (source == "systemd_dirs") & F.col("name").endswith(".service") & ~F.col("name").isin(C.COMMON_SYSTEMD_UNITS) & ~F.col("name").startswith("user@")
    writable = (source == "cron_dirs") & ((F.substring("perms", 6, 1) == "w") | (F.substring("perms", 9, 1) == "w"))
    misplaced = (source == "cron_dirs") & F.col("directory").isNotNull() & ~F.col("directory").isin(C.EXPECTED_CRON_DIRS)
    age = F.col("collected_at_utc").cast("long") - F.col("mtime_normalized_utc").cast("long")
    recent = source.isin("cron_dirs", "systemd_dirs", "init_dirs") & age.between(0, recent_days * 86400)
    picks = lambda condition, *text: F.array_sort(F.collect_list(F.when(condition, F.concat(*text))))
    return rows.groupBy("run_id").agg(
        picks(unit, F.lit("Non-standard service: "), path).alias("suspicious_systemd_units"),
        picks(writable, F.lit("World/group-writable cron file: "), path, F.lit(" ("), "perms", F.lit(")")).alias("unusual_cron_permissions"),
        picks(recent, F.lit("Recently modified: "), path, F.lit(" ("), "mtime_text", F.lit(")")).alias("recently_modified_persistence_files"),
        picks(misplaced, F.lit("Cron file in unusual location: "), path).alias("suspicious_cron_locations"))
