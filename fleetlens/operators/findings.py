"""Rule engine: one filtered projection per rule over the posture tables, then a union (no shuffle but the
login count)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAILED_LOGIN_THRESHOLD = 10


def _finding(rows: DataFrame, table: str, severity: str, category: str, title: Column | str, details: Column | str) -> DataFrame:
    text = lambda c: F.lit(c) if isinstance(c, str) else c
    return rows.select(
        "run_id", F.lit(severity).alias("severity"), F.lit(category).alias("category"), text(title).alias("title"),
        text(details).alias("details"), F.concat_ws(".", F.lit(table), "run_id").alias("evidence_ref"))


# Severity, category and title of findings are fixed values; the explanations are our own.

def finding_audit_disabled(audit: DataFrame) -> DataFrame:
    return _finding(audit.filter("audit_enabled = 0"), "run_audit_posture", "high", "audit", "Audit subsystem disabled",
                    "Auditing is off on this host, so security events leave no record")


def finding_audit_mutable(audit: DataFrame) -> DataFrame:
    return _finding(audit.filter("audit_immutable = 0"), "run_audit_posture", "medium", "audit", "Audit rules not immutable",
                    "Audit rules are not locked: whoever gains root can switch recording off")


def finding_selinux_disabled(selinux: DataFrame) -> DataFrame:
    return _finding(selinux.filter("selinux_disabled = 1"), "run_selinux_posture", "high", "selinux", "SELinux disabled",
                    "No mandatory access control by SELinux is in force")


def finding_selinux_permissive(selinux: DataFrame) -> DataFrame:
    return _finding(selinux.filter("selinux_disabled = 0 AND selinux_permissive = 1"), "run_selinux_posture", "medium", "selinux",
                    "SELinux in permissive mode", "SELinux only reports what its policy would forbid")


def finding_apparmor_mixed(apparmor: DataFrame) -> DataFrame:
    return _finding(apparmor.filter("apparmor_mixed_mode = 1"), "run_apparmor_posture", "medium", "apparmor",
                    "AppArmor mixed enforcement mode", "Part of the AppArmor profiles only report, the others enforce")


def finding_default_routes(network: DataFrame) -> DataFrame:
    return _finding(network.filter("multiple_default_routes = 1"), "run_network_posture", "medium", "network",
                    "Multiple default routes configured",
                    "More than one way out of the network is set; check that each is wanted")


def finding_nameservers(network: DataFrame) -> DataFrame:
    servers = F.col("unexpected_nameservers")
    return _finding(
        network.filter(F.size(servers) > 0), "run_network_posture", "medium", "network",
        F.concat(F.lit("Unexpected nameservers: "), F.array_join(servers, ", ")),
        F.format_string("%d name servers are outside the expected set", F.size(servers)))


def finding_root_process(processes: DataFrame) -> DataFrame:
    n = F.size("suspicious_root_processes")
    return _finding(processes.filter(n > 0), "run_process_insights", "high", "process",
                    F.format_string("Suspicious root processes detected (%d)", n),
                    "Command lines of root processes match patterns of known abuse")


def finding_failed_logins(failed_logins: DataFrame) -> DataFrame:
    counted = failed_logins.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > FAILED_LOGIN_THRESHOLD)
    return _finding(counted, "run_failed_logins", "medium", "auth",
                    F.format_string("High number of failed logins (%d)", "n"),
                    "More failed logins than usual; passwords may be being tried out")


def finding_systemd_units(persistence: DataFrame) -> DataFrame:
    n = F.size("suspicious_systemd_units")
    return _finding(persistence.filter(n > 0), "run_persistence_insights", "medium", "persistence",
                    F.format_string("Suspicious systemd units (%d)", n),
                    "Units outside the usual set start with the system")


# rule -> table it reads
RULES = [
    (finding_audit_disabled, "run_audit_posture"),
    (finding_audit_mutable, "run_audit_posture"),
    (finding_selinux_disabled, "run_selinux_posture"),
    (finding_selinux_permissive, "run_selinux_posture"),
    (finding_apparmor_mixed, "run_apparmor_posture"),
    (finding_default_routes, "run_network_posture"),
    (finding_nameservers, "run_network_posture"),
    (finding_root_process, "run_process_insights"),
    (finding_failed_logins, "run_failed_logins"),
    (finding_systemd_units, "run_persistence_insights"),
]


def findings(table) -> DataFrame:
    """All findings; `table` maps a table name to its DataFrame."""
    parts = [rule(table(source)) for rule, source in RULES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
