"""Properties of ingest, identity and comparison."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import diff, identity
from fleetlens.operators.blocks import split_blocks
from fleetlens.plans import playbook
from fleetlens.plans.fleet import Fleet
from fleetlens.sources import snapshots as src
from fleetlens.sources.warehouse import read_table
from fleetlens.streaming import ingest


def write_snapshots(folder, files):
    for name, text in files.items():
        (folder / name).write_bytes(text.encode())


def snapshot(users, host="h1"):
    return f"*****HOST INFO*****\n$ hostnamectl\n Static hostname: {host}\n$ cat /etc/passwd\n" + "\n".join(f"{u}:x:1:1::/:/bin/sh" for u in users) + "\n"


A, B = "10.0.0.1_20240201_00:00:00Z.txt", "10.0.0.1_20240208_00:00:00Z.txt"


def test_ingest_streaming_and_replacement(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    write_snapshots(folder, {A: snapshot(["a", "b"]), "notes.txt": "x"})
    progress = str(tmp_path / "progress")
    run = lambda: ingest.stream_ingest(spark, str(folder), root, progress, ["run_users"]).awaitTermination()
    users = lambda: sorted(r[0] for r in read_table(spark, root, "run_users").select("username").collect())
    run()
    assert users() == ["a", "b"]
    write_snapshots(folder, {B: snapshot(["c"])})
    run()
    run()
    assert users() == ["a", "b", "c"]
    # the same file again, changed: its rows are replaced, the other run stays
    write_snapshots(folder, {A: snapshot(["z"])})
    ingest.ingest_batch(spark, src.read_files(spark, str(folder)).filter(F.contains("path", F.lit(A))), root, ["run_users"])
    assert users() == ["c", "z"]
    write_snapshots(folder, {"10.0.0.2_20240208_00:00:00Z.txt": snapshot(["n"], "h2")})
    ingest.ingest_new(spark, str(folder), root, ["run_users"])
    assert users() == ["c", "n", "z"]
    ingest.ingest_fresh(spark, str(folder), root, ["run_users"])
    assert users() == ["c", "n", "z"]


def test_fleet_over_a_folder(spark, tmp_path):
    write_snapshots(tmp_path, {A: snapshot(["a"]), B: snapshot(["a", "b"], "H-1"), "10.0.0.2_20240208_00:00:00Z.txt": snapshot(["n"], "h2")})
    fleet = Fleet.from_directory(spark, str(tmp_path))
    assert fleet.summary().first().asDict() == {"assets": 2, "runs": 3, "commands": 6}
    assert sorted(r.hostname for r in fleet("v_asset_current").collect()) == ["h-1", "h2"]
    fleet.register_views("v_asset_current", "run_users")
    assert spark.sql("SELECT count(*) FROM v_asset_current a JOIN run_users u ON u.run_id = a.last_run_id").first()[0] == 3


def identities(spark, rows):
    schema = "run_id string, collected_at_utc timestamp, hostname string, machine_id string, dmi_uuid string, serial_number string, primary_mac string"
    return spark.createDataFrame(rows, schema)


def brute_force(rows):
    """Union-find over uuid, mac and hostname slug, but for those that sit on several values of a stronger type."""
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    slug = lambda r: "s" + "".join(c for c in r[2].lower() if c.isalnum())
    uuid = lambda r: r[4] if r[4] and not r[4].startswith("0000") else None
    several = lambda rows, of: len({of(r) for r in rows} - {None}) > 1
    vague = {"m" + m for m in {r[6] for r in rows if r[6]} if several([r for r in rows if r[6] == m], uuid)}
    for s in {slug(r) for r in rows}:
        own = [r for r in rows if slug(r) == s]
        if several(own, uuid) or several([r for r in own if not uuid(r)], lambda r: r[6]):
            vague.add(s)
    seen = {}
    for r in rows:
        keys = ["s" + "".join(c for c in r[2].lower() if c.isalnum())]
        keys += ["u" + r[4]] if r[4] and not r[4].startswith("0000") else []
        keys += ["m" + r[6]] if r[6] else []
        for k in keys:
            if k in vague:
                continue
            if k in seen:
                parent[find(r[0])] = find(seen[k])
            seen[k] = r[0]
    groups = {}
    for r in rows:
        groups.setdefault(find(r[0]), []).append((r[1], r[0]))
    names = {root: min(g)[1] for root, g in groups.items()}
    return {r[0]: names[find(r[0])] for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_identity_matches_brute_force_in_any_order(spark, seed):
    rng = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(f"r{i:02d}", t0 + dt.timedelta(hours=rng.randrange(99)), f"h{rng.randrange(30)}", "same-machine", rng.choice([None, "00000000-0", f"u{rng.randrange(25)}"]), None, rng.choice([None, f"m{rng.randrange(30)}"])) for i in range(40)]
    # a long chain of renamed hosts linked pairwise
    rows += [(f"c{i:02d}", t0 + dt.timedelta(days=i), f"chain{i // 2}", None, f"cu{(i + 1) // 2}", None, None) for i in range(24)]
    want = brute_force(rows)
    rng.shuffle(rows)
    got = {r.run_id: r.asset_id for r in identity.ident_resolve(identities(spark, rows)).collect()}
    assert got == want


def test_inventory_spelling_wins(spark):
    rows = [("r1", dt.datetime(2024, 1, 1), "ampere1", None, None, None, None), ("r2", dt.datetime(2024, 1, 2), "beta", None, None, None, None)]
    idents = identities(spark, rows)
    inventory = spark.createDataFrame([("Ampere-1",), ("gamma",)], "hostname string")
    got = {r.hostname for r in identity.ident_hostname(idents, identity.ident_resolve(idents), inventory).collect()}
    assert got == {"ampere-1", "beta"}


def test_comparison_is_symmetric_and_empty_for_equal_files(spark):
    files = spark.createDataFrame([(f"/x/{A}", bytearray(snapshot(["a", "b", "b"]).encode())), (f"/x/{B}", bytearray(snapshot(["b", "c"]).encode()))], "path string, content binary")
    blocks = split_blocks(src.snapshots(files))
    ids = [r.run_id for r in blocks.select("run_id").distinct().orderBy("run_id").collect()]
    pair = lambda a, b: spark.createDataFrame([(a, b)], "first_run string, second_run string")
    lines = lambda a, b, kind: sorted((r.line, r.copies) for r in diff.diff_lines(blocks, pair(a, b)).filter(F.col("change_type") == kind).collect())
    assert diff.diff_lines(blocks, pair(ids[0], ids[0])).count() == 0
    assert lines(*ids, "added") == lines(*ids[::-1], "removed") == [("c:x:1:1::/:/bin/sh", 1)]
    assert lines(*ids, "removed") == [("a:x:1:1::/:/bin/sh", 1), ("b:x:1:1::/:/bin/sh", 1)]
    assert {r.status for r in diff.diff_blocks(blocks, pair(ids[0], ids[0])).collect()} == {"same"}


def test_blocks_reproduce_the_file(spark):
    text = snapshot(["a", "b"])
    files = spark.createDataFrame([(f"/x/{A}", bytearray(text.encode()))], "path string, content binary")
    got = split_blocks(src.snapshots(files)).orderBy("command_index").collect()
    body = "".join(f"$ {b.command}\n{b.output_text}\n" for b in got)
    assert "*****HOST INFO*****\n" + body == text


def test_hosts_without_trusted_identifiers_stay_apart(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", t, "主机", None, None, None, None), ("b", t, "服务器", None, None, None, None), ("c", t, "主机", None, None, None, None), ("d", t, None, None, None, None, None), ("e", t, None, None, None, None, None)]
    got = {r.run_id: r.asset_id for r in identity.ident_resolve(identities(spark, rows)).collect()}
    assert got == {"a": "a", "b": "b", "c": "a", "d": "d", "e": "e"}


def test_shared_names_and_cloned_macs_do_not_link(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", t, "localhost", None, "u1", None, "m1"), ("b", t, "localhost", None, "u2", None, "m2"), ("c", t, "x", None, "u3", None, "m3"), ("d", t, "y", None, "u4", None, "m3"),
            ("e", t, "z", None, None, None, "m5"), ("f", t, "z", None, None, None, "m6"), ("g", t, "w", None, "u7", None, "m7"), ("h", t, "w", None, None, None, "m7")]
    got = {r.run_id: r.asset_id for r in identity.ident_resolve(identities(spark, rows)).collect()}
    assert got == {k: k for k in "abcdefg"} | {"h": "g"}


def test_latest_questions_read_the_dates_of_latest_runs(spark, tmp_path):
    """Partition filters in the plans over a store."""
    text = "$ hostnamectl\n Static hostname: h\n$ cat /etc/passwd\nroot:x:0:0:r:/root:/bin/bash\n$ ss -punt\n"
    for day in ("20240101", "20240102", "20240103"):
        (tmp_path / "in" / "deep").mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / "deep" / f"10.0.0.1_{day}_10:00:00Z.txt").write_text(text)
    root = str(tmp_path / "store")
    assert ingest.ingest_new(spark, str(tmp_path / "in"), root, batch_files=2) == {"new": 3, "skipped": 0}
    assert ingest.ingest_new(spark, str(tmp_path / "in"), root) == {"new": 0, "skipped": 3}
    fleet = ingest.open_store(spark, str(tmp_path / "in"), root)
    assert fleet("run_users").count() == 3
    for question in (lambda: fleet("v_asset_security_summary"), lambda: playbook.q_findings(fleet), lambda: fleet("r_ports")):
        plan = question()._jdf.queryExecution().toString()
        assert "run_date IN (20240103)" in plan or "run_date#" in plan and "= 20240103" in plan
    assert fleet("v_asset_security_summary").first().local_user_count == 1
