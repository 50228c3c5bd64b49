"""Work and memory of a task do not grow with the tables."""

import re

import pytest

from fixtures import render as R
from fixtures.cases import utc

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


@pytest.mark.parametrize("tags", [["dpkg_list"], ["ps_elf", "timedatectl"], ["iptables_s", "ufw_raw"]])
def test_rendering_shuffles_source_rows_only(spark, tags):
    exchanges = re.findall(r"Exchange (\w+)[^\n]*", plan(R.render(utc(spark), SF, tags)))
    texts = [line for line in plan(R.render(spark, SF, tags)).split("\n") if "Exchange hashpartitioning" in line and "REPARTITION_BY_NUM" not in line]
    assert exchanges and not texts


def test_more_rows_give_more_tasks(spark, monkeypatch):
    before = R.sized(utc(spark), SF, ["SELECT * FROM fx_packages"]).parts
    monkeypatch.setattr(R, "TASK_ROWS", 100)
    after = R.sized(spark, SF, ["SELECT * FROM fx_packages"]).parts
    assert after >= 60 > before
    assert R.render(spark, SF, ["dpkg_list"]).rdd.getNumPartitions() == after


def test_shuffles_start_with_a_partition_for_each_portion(spark):
    from fleetlens.sources.warehouse import partition_for

    first, aim = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    size = spark.conf.get(aim)
    try:
        partition_for(spark, 4)
        assert spark.conf.get(first, None) is None
        partition_for(spark, 400)
        assert spark.conf.get(first) == "400"
        partition_for(spark, 40)
        assert spark.conf.get(first) == "400"
    finally:
        spark.conf.unset(first)
        spark.conf.set(aim, size)


def test_packages_come_from_one_pass_over_the_texts(spark):
    from fleetlens.operators.software import run_packages

    text = "Desired=Unknown\nii  a  1  all  old\nii  a  1  all  new\nii  b  2\n\nzz  c  3  all  x"
    made = [("r1", "dpkg_list", text), ("r1", "rpm_all", "rpm: no\n\n  l-1.x86_64 \nl-1.x86_64\nbash: rpm: command not found")]
    blocks = spark.createDataFrame(made, "run_id string, command_tag string, output_text string").selectExpr(
        "*", "'ip' AS source_ip", "current_timestamp() AS collected_at_utc", "'UTC' AS host_zone", "true AS is_first")
    df = run_packages(blocks)
    assert len(re.findall(r"Scan ", plan(df))) == 1
    assert sorted(map(tuple, df.collect())) == [("r1", "dpkg", "a", "1", "all", "ii", "new"), ("r1", "rpm", "l-1.x86_64", "", "", "", None)]


def blocks_with(spark, *made):
    return spark.createDataFrame(list(made), "run_id string, command_tag string, output_text string").selectExpr(
        "*", "'ip' AS source_ip", "TIMESTAMP '2024-02-01 12:00:00' AS collected_at_utc", "'UTC' AS host_zone", "true AS is_first")


def test_parents_are_found_inside_the_block(spark):
    from fleetlens.operators.software import run_processes

    line = "4 S root {} {} 0 80 0 - 1 - {} ? 00:00:01 {}".format
    text = "\n".join([line(7, 1, "10:05", "/bin/old -a"), line(9, 7, "13:00:30", "sh -c x"), line(7, 1, "25:00", "/opt/new -b"), line("x", 7, "Jan05", "y"), line(0, 0, "2023", "z"), line(9, 7, "13:00:30", "sh -c x")])
    df = run_processes(blocks_with(spark, ("r1", "ps_elf", text), ("r2", "ps_elf", line(9, 7, "10:05", "sh -c x"))))
    assert "Exchange" not in plan(df)
    got = sorted((r.run_id, str(r.pid), r.cmd, r.parent_process_path, str(r.start_normalized_utc)) for r in df.collect())
    assert got == [
        ("r1", "0", "z", "", "2023-01-01 00:00:00"), ("r1", "7", "/bin/old -a", "", "2024-02-01 10:05:00"), ("r1", "7", "/opt/new -b", "", "None"),
        ("r1", "9", "sh -c x", "/opt/new", "2024-01-31 13:00:30"), ("r1", "None", "y", "", "2024-01-05 00:00:00"), ("r2", "9", "sh -c x", "", "2024-02-01 10:05:00")]


def test_sockets_are_compared_inside_the_block(spark):
    from fleetlens.operators.network import run_listening_sockets

    owned = 'tcp LISTEN {} 128 {} *:* users:(("{}",pid={},fd=3))'.format
    known = 'tcp ESTAB {} 128 10.0.0.1:22 [fe80::1]:99 users:(("a",pid=1,fd=3))'.format
    lines = [owned(0, "*:22", "a", 1), owned(1, "*:22", "a", 1), known(0), known(5), known(3), "udp UNCONN 0 0 [::]:53 *", "tcp too few", "tcp LISTEN 0 1 a:1 b:2 nobody"]
    df = run_listening_sockets(blocks_with(spark, ("r1", "ss_punt", "Netid State\n" + "\n".join(lines)), ("r2", "ss_punt", known(9))))
    assert "Exchange" not in plan(df)
    got = sorted((r.run_id, r.raw_line, r.local_addr, r.local_port, r.peer_addr, r.peer_port or 0, r.pid or 0) for r in df.collect())
    assert got == sorted([("r1", lines[0], "*", 22, "*", 0, 1), ("r1", lines[1], "*", 22, "*", 0, 1), ("r1", lines[4], "10.0.0.1", 22, "fe80::1", 99, 1),
                          ("r1", lines[5], "::", 53, "*", 0, 0), ("r2", known(9), "10.0.0.1", 22, "fe80::1", 99, 1)])


def test_a_text_is_cleaned_once(spark):
    from fleetlens.functions.text import block
    from fleetlens.operators.blocks import split_blocks
    from fleetlens.sources.snapshots import snapshots

    files = spark.createDataFrame([("/f/10.0.0.1_20240201_00:00:00Z.txt", bytearray(b"$ uptime\r\nx\n====\n"), 1)], "path string, content binary, length bigint")
    blocks = block(split_blocks(snapshots(files)), "uptime")
    assert [r.output_text for r in blocks.collect()] == ["x"]
    optimized = blocks._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("=+)(?:") == 1 and optimized.count("invoke(") + optimized.count("make_valid_utf8") <= 2, optimized


def compared(spark):
    made = [("r1", 0, "cat x", "x", "a\nb\nb"), ("r1", 1, "uptime", "uptime", "1"), ("r1", 2, "cat x", "x", "c"), ("r1", 3, "w", "w", "same"),
            ("r2", 0, "id", "id", "0"), ("r2", 1, "cat x", "x", "b\na\na\nd"), ("r2", 2, "w", "w", "same"), ("r2", 3, "cat x", "x", "c"), ("r3", 0, "cat x", "x", "z")]
    blocks = spark.createDataFrame(made, "run_id string, command_index int, command string, command_tag string, output_text string")
    return blocks, spark.createDataFrame([("r1", "r2"), ("r1", "r2"), ("r1", "r3"), ("r2", "r2")], "first_run string, second_run string")


def exchanges(df) -> list[str]:
    return re.findall(r"Exchange hashpartitioning\(([^\n]*)", plan(df))


def test_blocks_of_a_tag_are_counted_where_pairs_meet(spark):
    from fleetlens.operators.diff import diff_blocks

    df = diff_blocks(*compared(spark), by="tag")
    assert not [x for x in exchanges(df) if "command_tag" in x or "block_key" in x]
    got = sorted((r.first_run, r.second_run, r.block_key, r.command_index, r.second_index, r.command, r.status) for r in df.filter("second_run <> first_run").collect())
    assert got == [
        ("r1", "r2", "uptime#1", 1, None, "uptime", "missing"), ("r1", "r2", "w#1", 3, 2, "w", "same"), ("r1", "r2", "x#1", 0, 1, "cat x", "changed"), ("r1", "r2", "x#2", 2, 3, "cat x", "same"),
        ("r1", "r3", "uptime#1", 1, None, "uptime", "missing"), ("r1", "r3", "w#1", 3, None, "w", "missing"), ("r1", "r3", "x#1", 0, 0, "cat x", "changed"), ("r1", "r3", "x#2", 2, None, "cat x", "missing")]
    assert {r.status for r in df.filter("second_run = first_run").collect()} == {"same"}


def test_lines_are_compared_where_texts_meet(spark):
    from fleetlens.operators.diff import diff_lines

    df = diff_lines(*compared(spark), by="tag")
    assert not [x for x in exchanges(df) if "line" in x]
    got = sorted((r.second_run, r.block_key, r.line, r.change_type, r.copies) for r in df.collect())
    assert got == [("r2", "x#1", "a", "added", 1), ("r2", "x#1", "b", "removed", 1), ("r2", "x#1", "d", "added", 1),
                   ("r3", "x#1", "a", "removed", 1), ("r3", "x#1", "b", "removed", 2), ("r3", "x#1", "z", "added", 1)]


def test_a_line_is_held_once_until_it_is_shown(spark):
    from fleetlens.operators.diff import diff_text

    df = diff_text(*compared(spark), by="tag")
    assert not [x for x in exchanges(df) if "line" in x]
    assert "collect_list" in (p := plan(df)) and not re.search(r"collect_list\([^\n]*, text, ", p)
    assert sorted((r.second_run, r.diff) for r in df.collect()) == [("r2", "--- \n+++ \n-b\n+a\n+d"), ("r3", "--- \n+++ \n-a\n-b\n-b\n+z")]


def test_extractions_are_written_side_by_side(spark, tmp_path, monkeypatch):
    from threading import Barrier

    from fleetlens.plans.fleet import Fleet
    from fleetlens.sources.snapshots import snapshots

    files = spark.createDataFrame([("/f/10.0.0.1_20240201_00:00:00Z.txt", bytearray(b"$ uname -a\nLinux n 5.1 x\n$ cat /etc/passwd\na:x:1:1:g:/:/bin/sh\n"), 1)], "path string, content binary, length bigint")
    fleet, keep, meet = Fleet(spark, snapshots(files), store=str(tmp_path)), Fleet._keep, Barrier(2, timeout=60)
    kept = []

    def keeping(self, name, df):
        kept.append(name)
        if name != "run_commands":
            meet.wait()
        return keep(self, name, df)

    monkeypatch.setattr(Fleet, "_keep", keeping)
    fleet.prepare("run_uname", "run_users", "run_uname")
    fleet.prepare("run_uname", "run_users")
    assert kept[0] == "run_commands" and sorted(kept[1:]) == ["run_uname", "run_users"]
    assert fleet("run_uname").first().uname_a == "Linux n 5.1 x" and fleet("run_users").first().username == "a"


def test_the_last_rendering_sets_the_threshold_back(spark):
    threshold = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(threshold)
    first, second = R.many_runs(spark), R.many_runs(spark)
    first.__enter__()
    second.__enter__()
    first.__exit__(None, None, None)
    assert spark.conf.get(threshold) == str(R.TASK_ROWS)
    second.__exit__(None, None, None)
    assert spark.conf.get(threshold) == before


def test_module_fields_meet_their_run_once(spark):
    from fleetlens.operators.hardware import run_modinfo_kv

    listed = "Module                  Size  Used by\na   10  1 b\nb\t20  0 \n\nc 30\na   10  1 b"
    told = "license: none\n# modinfo a\nlicense:   GPL\nalias: x:y\nlicense:   GPL\nparm:  debug\nAlias:\nno field\n# modinfo  b\nsigner: k\n# modinfo c\nlicense: GPL\n# modinfo a\nalias: x:y\nalias: z\n# modinfo \nalias: q"
    df = run_modinfo_kv(blocks_with(spark, ("r1", "lsmod", listed), ("r1", "modinfo_all", told), ("r2", "lsmod", "b 1 0"), ("r2", "modinfo_all", "# modinfo a\nalias: x"), ("r3", "modinfo_all", told)))
    assert "Broadcast" not in plan(df) and {x.split("#")[0] for x in exchanges(df)} == {"run_id"} and "Aggregate" not in plan(df)
    assert sorted(map(tuple, df.collect())) == [
        ("r1", "a", "Alias", ""), ("r1", "a", "alias", "x:y"), ("r1", "a", "alias", "z"), ("r1", "a", "license", "GPL"), ("r1", "b", "signer", "k")]


def test_keys_are_compared_inside_the_block(spark):
    from fleetlens.operators.accounts import run_ssh_authorized_keys

    told = "x y\n# cat /home/bob/.ssh/authorized_keys\nrsa YWJj one\nrsa !! b\nshort\n\nrsa YWJj two\n# cat /home/root/.ssh/authorized_keys\nrsa YWJj home\n# cat /home/eve/.ssh/authorized_keys\n  rsa YWJj three 3\n# cat /home/bob/.ssh/authorized_keys\nrsa !! b"
    df = run_ssh_authorized_keys(blocks_with(spark, ("r1", "root_authorized_keys", "rsa YWJj old\nrsa ZGVm"), ("r1", "home_authorized_keys", told), ("r2", "home_authorized_keys", told.split("\n# cat /home/root")[0])))
    shuffled = plan(df).split("Exchange ")
    assert len(shuffled) == 2 and shuffled[1].count("Filter (isnotnull(x") + shuffled[1].count("= root)") >= 2, plan(df)
    assert sorted((r.run_id, r.username, r.key_comment or "") for r in df.collect()) == [
        ("r1", "bob", "b"), ("r1", "bob", "two"), ("r1", "eve", "three 3"), ("r1", "root", ""), ("r1", "root", "home"), ("r2", "bob", "b"), ("r2", "bob", "two")]


def test_lines_of_blocks_are_stored_without_a_shuffle(spark, tmp_path):
    from fleetlens.sources.warehouse import OPEN_DATES, read_table, write_table

    setting = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(setting)
    dates = [f"2024{m:02}{d:02}" for m in (1, 2, 3) for d in range(1, 29)]
    assert len(dates) > OPEN_DATES
    df = spark.createDataFrame([(f"{d}-x", n) for n in range(3) for d in dates], "run_id string, n int").coalesce(1)
    tracker = spark._jsparkSession.sparkContext().env().mapOutputTracker()
    shuffles = lambda: tracker.shuffleStatuses().keySet().toSeq().mkString(",")
    was = shuffles()
    write_table(df, str(tmp_path), "run_x", in_place=True)
    assert shuffles() == was and spark.conf.get(setting) == before
    assert len(list((tmp_path / "run_x").glob("run_date=*/*.zstd.parquet"))) == len(dates)
    assert sorted(map(tuple, read_table(spark, str(tmp_path), "run_x").collect())) == sorted(map(tuple, df.collect()))


def test_owners_of_sockets_are_searched_once_a_line(spark):
    from fleetlens.operators.network import run_listening_sockets

    text = 'tcp LISTEN 0 128 *:22 *:* users:(("a",pid=1,fd=3))\ntcp LISTEN 0 128 *:23 *:* users:((pid=1))'
    df = run_listening_sockets(blocks_with(spark, ("r1", "ss_punt", text)))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") <= 2
    assert [(r.local_port, r.process_name, r.pid) for r in df.collect()] == [(22, "a", 1), (23, None, None)]


def test_packages_of_pairs_are_shuffled_once_by_name(spark):
    from fleetlens.plans.playbook import q_pkg_diff

    tables = {
        "v_asset_current": spark.createDataFrame([("r1", "1", "x"), ("r2", "2", "y"), ("r3", "3", "y"), (None, "4", "z")], "last_run_id string, asset_id string, hostname string"),
        "run_packages": spark.createDataFrame([("r1", "dpkg", "a", "1"), ("r1", "dpkg", "a", "1"), ("r1", "dpkg", "b", None), ("r1", "rpm", "c", "1"), ("r1", "dpkg", None, "1"), ("r2", "dpkg", "d", "2"), ("r3", "dpkg", "d", "3"),
                                               ("r3", "dpkg", "b", "9")], "run_id string, source string, name string, version string")}
    pairs = spark.createDataFrame([("x", "y"), ("x", "y"), ("y", "z"), ("x", "x")], "host_a string, host_b string")
    df = q_pkg_diff(tables.__getitem__, pairs)
    assert len([x for x in exchanges(df) if re.search(r"\bname#", x)]) == 1
    assert list(map(tuple, df.collect())) == [("x", "y", "only_in_a", "a", "1"), ("x", "y", "only_in_a", "a", "1"), ("x", "y", "only_in_b", "d", "2"), ("x", "y", "only_in_b", "d", "3"),
                                              ("y", "z", "only_in_a", "b", "9"), ("y", "z", "only_in_a", "d", "2"), ("y", "z", "only_in_a", "d", "3")]
