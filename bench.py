"""Times the headline jobs and prints one JSON line.

Snapshot texts are rendered from the driver tables and stored before the clock starts; what is timed is the
engine: splitting, extraction, posture, identity, views, report and comparison. BENCH_SF_DIR and BENCH_CPUS
select data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from fixtures import cases_core, cases_fleet  # noqa: F401
from fixtures.render import fleet, rendered
from fleetlens.operators import diff, findings, identity, posture, views
from fleetlens.operators.blocks import split_blocks
from fleetlens.plans import playbook, report
from fleetlens.plans.fleet import EXTRACTIONS
from fleetlens.sources import snapshots as src

EXTRACTED = ["run_users", "run_packages", "run_processes", "run_file_listings", "run_listening_sockets", "run_last_events", "run_firewall_rules",
             "run_ssh_authorized_keys", "run_modinfo_kv", "run_facts"]
MIXED = ("hostnamectl", "etc_passwd", "dpkg_list", "ps_elf", "ss_punt")


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus) if cpus.isdigit() else 16)).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true").getOrCreate()
    )


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    f, lazy = fleet(spark, sf_dir), fleet(spark, sf_dir, stored=False)
    times: dict[str, float] = {}

    def timed(name: str, build) -> None:
        start = time.time()
        result = build()
        if isinstance(result, DataFrame):
            result.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr)

    def texts(*tags: str) -> DataFrame:
        return src.snapshots(rendered(spark, sf_dir, tags))

    # stored texts first, so that rendering is not timed; a small job warms the JVM up
    mixed = texts(*MIXED)
    for name in EXTRACTED:
        texts(*EXTRACTIONS[name][1])
    texts("hostnamectl").count()

    timed("blocks_split", lambda: split_blocks(mixed))
    for name in EXTRACTED:
        timed(name, lambda n=name: EXTRACTIONS[n][0](lazy.blocks(*EXTRACTIONS[n][1])))

    # tables the fleet questions read are stored, as after an ingest
    base = ["identifiers", "run_assets", "runs", "assets", "run_group_members", "run_priv_groups", "run_audit_status", "run_audit_rules", "run_resolv_conf_entries", "run_routes",
            "run_ip_neigh", "run_processes", "run_listening_sockets", "run_file_listings", "run_users", "run_groups", "run_packages", "findings", "v_asset_current", "run_firewall_rules",
            "run_passwd_status", "run_ssh_authorized_keys", "run_failed_logins", "run_timedate", "run_memory", "run_uname", "run_dmi_system"]
    for name in base:
        f(name)
    # the block kinds of earlier rounds, so that figures compare
    diff_texts = texts("uname_a", "dpkg_list", "priv_groups")
    pairs = diff.consecutive_pairs(f("v_asset_previous_run"))

    timed("run_network_posture", lambda: posture.run_network_posture(f("run_resolv_conf_entries"), f("run_routes"), f("run_ip_neigh")))
    timed("run_process_insights", lambda: posture.run_process_insights(f("run_processes"), f("run_listening_sockets")))
    timed("findings", lambda: findings.findings(f))
    timed("ident_resolve", lambda: identity.ident_resolve(f("identifiers")))
    timed("v_asset_current", lambda: views.v_asset_current(f))
    timed("v_asset_security_summary", lambda: views.v_asset_security_summary(f))
    timed("v_run_delta_privileged_members", lambda: views.v_run_delta_privileged_members(f))
    timed("v_rare_processes", lambda: views.v_rare_processes(f))
    timed("v_process_sockets", lambda: views.v_process_sockets(f))
    timed("q_pkg_diff", lambda: playbook.q_pkg_diff(f, cases_fleet._neighbours(f)))
    timed("q_privileged", lambda: playbook.q_privileged(f))
    timed("r_ports", lambda: report.r_ports(f))
    timed("r_port_packages", lambda: report.r_port_packages(f))
    timed("r_rare_packages", lambda: report.r_rare_packages(f))
    timed("diff_blocks", lambda: diff.diff_blocks(split_blocks(diff_texts), pairs))
    timed("diff_lines", lambda: diff.diff_lines(split_blocks(diff_texts), pairs))
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
