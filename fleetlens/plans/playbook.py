"""Ready-made fleet questions over the tables and views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.functions.scalars import has_login_shell, severity_rank
from fleetlens.operators.views import Table, current_runs, of_latest_runs


@of_latest_runs
def q_inventory(table: Table) -> DataFrame:
    return table("v_asset_current").select(
        "asset_id", "hostname", "primary_ipv4", "primary_mac", "operating_system", "kernel", "architecture",
        "mem_total_bytes", "last_collected_at_utc").orderBy("asset_id")


@of_latest_runs
def q_posture(table: Table) -> DataFrame:
    return table("v_asset_security_summary").select(
        "hostname", "privileged_user_count", "local_user_count", "locked_account_count", "authorized_key_count",
        "package_row_count", "firewall_rule_row_count", "last_collected_at_utc").orderBy("hostname")


def q_missing_runs(table: Table) -> DataFrame:
    """Assets without a single run."""
    return table("assets").join(table("runs").select("asset_id"), "asset_id", "left_anti").select(
        "asset_id", "hostname").orderBy("asset_id")


@of_latest_runs
def q_privileged(table: Table) -> DataFrame:
    members = table("run_group_members").filter((F.col("source") == "getent") & F.col("groupname").isin(C.ADMIN_GROUPS))
    return current_runs(table).join(members, "run_id").select("hostname", "groupname", "member_username").orderBy(
        "hostname", "groupname", "member_username")


@of_latest_runs
def q_shell_accounts(table: Table) -> DataFrame:
    users = table("run_users").filter(has_login_shell("shell"))
    return current_runs(table).join(users, "run_id").select("hostname", "username", "uid", "shell").orderBy("hostname", "uid")


@of_latest_runs
def q_locked(table: Table) -> DataFrame:
    return current_runs(table).join(table("run_passwd_status"), "run_id").select(
        "hostname", "username", "status_code", "last_change").orderBy("hostname", "username")


@of_latest_runs
def q_pkg_diff(table: Table, pairs: DataFrame) -> DataFrame:
    """dpkg packages found by name on one host of a pair only, for every (host_a, host_b) pair at once.

    A package name of a pair is aggregated over both sides, with the versions that a run has of it; one side missing means
    a difference. Pairs find their runs first, so packages meet them once and are shuffled once more by pair and name.
    """
    sides = pairs.select("host_a", "host_b").distinct().select("host_a", "host_b", F.explode(F.array(
        F.struct(F.col("host_a").alias("hostname"), F.lit("a").alias("side")),
        F.struct(F.col("host_b").alias("hostname"), F.lit("b").alias("side")))).alias("s")
    ).select("host_a", "host_b", "s.hostname", "s.side")
    runs = current_runs(table).join(sides, "hostname").select("run_id", "host_a", "host_b", "side")
    packages = table("run_packages").filter("source = 'dpkg' AND name IS NOT NULL").select("run_id", "name", "version")
    merged = packages.join(runs, "run_id").groupBy("host_a", "host_b", "name").agg(
        F.min("side").alias("side"), F.max("side").alias("other"), F.collect_list(F.struct("version")).alias("found")).filter("side = other")
    rows = merged.select("host_a", "host_b", F.concat(F.lit("only_in_"), "side").alias("diff_type"), "name", F.explode("found").alias("p"))
    return rows.select("host_a", "host_b", "diff_type", "name", "p.version").orderBy("host_a", "host_b", "diff_type", "name", "version")


@of_latest_runs
def q_findings(table: Table) -> DataFrame:
    return current_runs(table).join(table("findings"), "run_id").select(
        "hostname", "severity", "category", "title", "details").orderBy(severity_rank("severity"), "hostname", "category")


@of_latest_runs
def q_failed_logins(table: Table, now=None, days: int = 30, more_than: int = 5) -> DataFrame:
    """Failed logins of the last days up to `now` (a timestamp column; default the current time)."""
    since = (F.current_timestamp() if now is None else now) - F.expr(f"INTERVAL {days} DAYS")
    return (
        current_runs(table).join(table("run_failed_logins"), "run_id").filter(F.col("attempt_time_utc") >= since)
        .groupBy("hostname").agg(
            F.count(F.lit(1)).alias("failed_login_count"), F.count_distinct("username").alias("unique_users_targeted"),
            F.count_distinct("remote_host").alias("unique_source_ips"))
        .filter(F.col("failed_login_count") > more_than).orderBy(F.desc("failed_login_count"), "hostname")
    )


@of_latest_runs
def q_many_keys(table: Table, more_than: int = 5) -> DataFrame:
    users = table("run_users").filter(has_login_shell("shell")).select("run_id", "username")
    keys = table("run_ssh_authorized_keys").groupBy("run_id", "username").agg(
        F.count(F.lit(1)).alias("key_count"), F.array_join(F.array_sort(F.collect_set("key_type")), ",").alias("key_types"))
    keys = keys.filter(F.col("key_count") > more_than)
    return current_runs(table).join(users, "run_id").join(keys, ["run_id", "username"]).select(
        "hostname", "username", "key_count", "key_types").orderBy(F.desc("key_count"), "hostname", "username")


@of_latest_runs
def q_module_anomalies(table: Table) -> DataFrame:
    lists = ["unusual_modules", "suspicious_licenses", "modules_with_unknown_signer"]
    some = F.greatest(*[F.size(c) for c in lists]) > 0
    first = lambda c: F.get(c, F.lit(0))
    return current_runs(table).join(table("run_kernel_module_insights").filter(some), "run_id").select(
        "hostname", first(lists[0]).alias("unusual_module"), first(lists[1]).alias("suspicious_license"),
        first(lists[2]).alias("unknown_signer"))


@of_latest_runs
def q_network_issues(table: Table) -> DataFrame:
    several = F.col("multiple_default_routes") == 1
    some = several | (F.size("unexpected_nameservers") > 0) | (F.size("suspicious_routes") > 0)
    first = lambda c: F.get(c, F.lit(0))
    return current_runs(table).join(table("run_network_posture").filter(some), "run_id").select(
        "hostname", F.when(several, "Multiple default routes").alias("route_issue"),
        first("unexpected_nameservers").alias("unexpected_nameserver"), first("suspicious_routes").alias("suspicious_route"))


@of_latest_runs
def q_persistence_counts(table: Table) -> DataFrame:
    """Cron files and service units per host, in one pass over the listings."""
    kind = F.when(F.col("source") == "cron_dirs", "Cron jobs").when(
        (F.col("source") == "systemd_dirs") & F.col("name").ilike("%.service"), "Systemd units")
    rows = table("run_file_listings").select("run_id", kind.alias("persistence_type")).filter("persistence_type IS NOT NULL")
    return current_runs(table).join(rows, "run_id").groupBy("hostname", "persistence_type").agg(
        F.count(F.lit(1)).alias("item_count")).orderBy("hostname", "persistence_type")


def _hosts_with_fact(table: Table, group: str, key: str, value: str) -> DataFrame:
    fact = table("run_facts").filter((F.col("fact_group") == group) & (F.col("fact_key") == key) & (F.col("fact_value") == value))
    return table("v_latest_runs").select("run_id", "asset_id").join(fact, "run_id").join(
        table("assets").select("asset_id", "hostname"), "asset_id")


@of_latest_runs
def q_password_auth(table: Table) -> DataFrame:
    return _hosts_with_fact(table, "sshd", "passwordauthentication", "yes").select("hostname", "fact_value").distinct()


@of_latest_runs
def q_no_remote_log(table: Table) -> DataFrame:
    return _hosts_with_fact(table, "rsyslog", "remote_destinations", "[]").select("hostname")
