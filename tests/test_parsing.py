"""Hand-written blocks: formats, malformed lines, repeated keys, odd line ends and the decisions behind them."""

import hashlib

import pytest
from pyspark.sql import functions as F

from fleetlens.constants import COMMAND_TAGS
from fleetlens.operators import accounts, hardware, keyvalue, network, posture, software
from fleetlens.operators.blocks import command_tag, split_blocks
from fleetlens.sources import snapshots as src

COMMANDS = {tag: cmd for cmd, tag in reversed(COMMAND_TAGS)}
COMMANDS["home_authorized_keys"] = 'for u in $users; do echo "# cat /home/$u/.ssh/authorized_keys"; done'
COMMANDS["modinfo_all"] = "for m in $mods; do modinfo $m; done"


def blocks_of(spark, *parts, path="/x/10.0.0.1_20240210_12:00:00Z.txt"):
    """Blocks of one snapshot; parts are (tag, text) pairs or raw text/bytes."""
    body = b""
    for p in parts:
        text = f"$ {COMMANDS.get(p[0], p[0])}\n{p[1]}\n" if isinstance(p, tuple) else p
        body += text if isinstance(text, bytes) else text.encode()
    files = spark.createDataFrame([(path, bytearray(body))], "path string, content binary")
    return split_blocks(src.snapshots(files))


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_sections_start_with_their_block_and_text_is_kept(spark):
    b = blocks_of(spark, "before\n*****FIRST  PART*****\n$ a\nout\n=====\n************\n*****HOST *INFO*****\nstray\n$ b\n\n x=1\n==\n$ c\n")
    got = rows(b, "command_index", "section", "command", "output_text")
    assert got == [(0, "FIRST PART", "a", "out\nstray"), (1, "HOST INFO", "b", " x=1"), (2, "HOST INFO", "c", "")]


def test_line_ends_and_bad_bytes(spark):
    b = blocks_of(spark, b"$ a\r\none\rtwo\x0cthree\xe2\x80\xa8four\n$ b\nbad \xff byte\n")
    assert rows(b, "output_text") == [("bad \ufffd byte",), ("one\ntwo\nthree\nfour",)]


def test_file_starting_with_a_command(spark):
    assert rows(blocks_of(spark, "$ a\n1\n$ a\n2\n"), "command_index", "is_first") == [(0, True), (1, False)]


def test_names_that_are_no_snapshots_are_ignored(spark):
    files = spark.createDataFrame([("/x/readme.txt", bytearray(b"$ a\n"))], "path string, content binary")
    assert src.snapshots(files).count() == 0


def test_tags(spark):
    b = blocks_of(spark, "$ Foo  --bar=1 | baz\n$ !!!\n$ " + "x" * 200 + "\n$ getcap -r /etc /root 2>/dev/null\n$ " + COMMANDS["modinfo_all"] + "\n")
    tags = [t for _, t in rows(b, "command_index", "command_tag")]
    assert tags == ["foo_bar_1_baz", "unknown", "x" * 96 + "_" + hashlib.md5(b"x" * 200).hexdigest()[:16], "getcap_r", "modinfo_all"]


def test_first_block_wins_but_getcap_merges_and_chrony_falls_through(spark):
    b = blocks_of(spark, ("etc_passwd", "a:x:1:1::/:/bin/sh"), ("etc_passwd", "b:x:2:2::/:/bin/sh"),
                  "$ getcap -r /\n/a = cap_x+ep\n$ getcap -r /etc /root 2>/dev/null\n/b = cap_y+ep\n/a = cap_z+ep\n",
                  "$ cat /etc/chrony.conf\ncat: /etc/chrony.conf: No such file or directory\n$ cat /etc/chrony/chrony.conf\npool p iburst\n")
    assert rows(accounts.run_users(b), "username") == [("a",)]
    assert rows(software.run_file_capabilities(b), "path", "caps") == [("/a", "cap_z+ep"), ("/b", "cap_y+ep")]
    assert rows(hardware.run_ntp_servers(b), "server_type", "server_address", "options", "pool") == [("chrony", "p", "iburst", 1)]


def test_empty_output_gives_no_rows(spark):
    b = blocks_of(spark, ("etc_passwd", ""), ("mokutil_sb_state", ""), ("uname_a", "\n\n"))
    assert accounts.run_users(b).count() == keyvalue.run_secure_boot(b).count() == keyvalue.run_uname(b).count() == 0


def test_accounts_drop_malformed_lines_and_keep_the_last(spark):
    b = blocks_of(spark, ("etc_passwd", "# c\nalice:x:1:1:old:/h:/bin/sh\nbad\nx:x:a:1:::\nalice:x:5:6:New:/h:/bin/bash\n:x:1:1:::"),
                  ("etc_group", "sudo:x:27:alice, bob\nteam:x:zz:\nteam:x:2000:\na:b:c"), ("passwd_status", "root P 11/13/2025 0 99999 7 -1\nroot L\nalone"))
    assert rows(accounts.run_users(b), "username", "uid", "gecos", "shell") == [("alice", 5, "New", "/bin/bash")]
    assert rows(accounts.run_groups(b), "groupname", "gid", "group_type") == [("sudo", 27, "service"), ("team", 2000, "user")]
    members = accounts.run_group_members(b, accounts.run_users(b))
    assert rows(members, "groupname", "member_username", "member_uid") == [("sudo", "alice", 5), ("sudo", "bob", None)]
    assert rows(accounts.run_passwd_status(b), "username", "status_code", "last_change") == [("root", "L", None)]


def test_key_values(spark):
    b = blocks_of(spark, ("etc_release", 'NAME="Ubuntu"\nbad\n =x\nNAME="Debian"\nVERSION="1"'), ("proc_cmdline", "root=UUID=1 ro quiet ro=2\nsecond line=1"),
                  ("login_defs", "#UMASK 1\nUMASK\t077\nUMASK 022\nLONELY"), ("getsebool_a", "a --> on\na --> off extra\nb -->\nc"), ("auditctl_s", "enabled 1\nalone\nenabled 2"))
    assert rows(keyvalue.run_os_release_kv(b), "k", "v") == [("NAME", "Debian"), ("VERSION", "1")]
    assert rows(keyvalue.run_kernel_cmdline_kv(b), "k", "v") == [("quiet", "1"), ("ro", "2"), ("root", "UUID=1")]
    assert rows(keyvalue.run_login_defs_kv(b), "k", "v") == [("LONELY", ""), ("UMASK", "022")]
    assert rows(keyvalue.run_selinux_booleans(b), "boolean_name", "state") == [("a", "off")]
    assert rows(keyvalue.run_audit_status(b), "k", "v") == [("enabled", "2")]


def test_never_logged_in_is_one_value(spark):
    b = blocks_of(spark, ("lastlog", "Username Port From Latest\nbin      **Never logged in**\nbob pts/0 10.0.0.1 Mon Jan 15 10:00:00 +0000 2024"))
    assert rows(accounts.run_lastlog(b), "username", "port", "latest") == [("bin", None, "Never logged in"), ("bob", "pts/0", "Mon Jan 15 10:00:00 +0000 2024")]


def test_authorized_keys_hide_key_material(spark):
    b = blocks_of(spark, ("root_authorized_keys", "ssh-rsa YWJj root@h\nssh-rsa YWJj again"), ("home_authorized_keys", "lost line x\n# cat /home/bob/.ssh/authorized_keys\nssh-ed25519 YWJj bob laptop\n# note\nshort\n# cat /root/.ssh/authorized_keys\nssh-rsa ZGVm"))
    df = accounts.run_ssh_authorized_keys(b)
    assert rows(df, "username", "key_type", "key_comment") == [("bob", "ssh-ed25519", "bob laptop"), ("root", "ssh-rsa", "again"), ("root", "ssh-rsa", None)]
    assert not any("YWJj" in str(r) for r in df.collect())


def test_process_parents_and_start_times(spark):
    ps = ("F S UID PID PPID C PRI NI ADDR SZ WCHAN STIME TTY TIME CMD\n4 S root 1 0 0 80 0 - 1 - 10:00 ? 00:00:01 /sbin/init splash\n"
          "4 S root 7 1 0 80 0 - 1 - 23:00 ? 00:00:01 \"/opt/my app/run\" --x 'a b'\n4 S root 8 7 0 80 0 - 1 - Dec20 ? 00:00:01 [kworker/0]\n4 S root x 7 0 80 0 - 1 - 2023 ? 0 sh\nshort")
    df = software.run_processes(blocks_of(spark, ("timedatectl", "  Time zone: Europe/Berlin (CET, +0100)"), ("ps_elf", ps)))
    got = {r.raw_line.split()[3]: r for r in df.collect()}
    assert (got["7"].process_name, got["7"].process_path, got["7"].process_arguments) == ("run", "/opt/my app/run", "--x a b")
    assert (got["7"].parent_process_name, got["8"].parent_process_path, got["1"].parent_process_name) == ("init", "/opt/my app/run", "")
    assert [str(got[k].start_normalized_utc) for k in ("1", "7", "8")] == ["2024-02-10 09:00:00", "2024-02-09 22:00:00", "2023-12-19 23:00:00"]
    assert got["x"].pid is None and got["x"].ppid is None


def test_sockets(spark):
    ss = 'tcp LISTEN 0 128 [::]:22 [::]:* users:(("sshd",pid=1,fd=3),("x",pid=2,fd=1))\nudp UNCONN 0 0 *:68 *:*\ntcp ESTAB 5 0 10.0.0.1:22 10.0.0.2:99\ntcp ESTAB 9 9 10.0.0.1:22 10.0.0.2:99\nbad'
    got = rows(network.run_listening_sockets(blocks_of(spark, ("ss_punt", ss))), "state", "local_addr", "local_port", "peer_addr", "peer_port", "bind_scope")
    # rows with a NULL in their key never collapse
    assert got == [("ESTAB", "10.0.0.1", 22, "10.0.0.2", 99, "specific"), ("ESTAB", "10.0.0.1", 22, "10.0.0.2", 99, "specific"),
                   ("LISTEN", "::", 22, "::", None, "all_interfaces"), ("UNCONN", "*", 68, "*", None, "all_interfaces")]


def test_disks_know_their_parent(spark):
    text = "NAME MAJ:MIN RM SIZE RO TYPE MOUNTPOINTS\nsda 8:0 0 1T 0 disk\n├─sda1 8:1 0 512M 0 part /boot\n└─sda2 8:2 0 1T 0 part\n  └─vg 253:0 0 1G 0 lvm /\nsdb 8:16 1 ? 0 disk\nshort"
    got = rows(hardware.run_block_devices(blocks_of(spark, ("lsblk_a", text))), "name", "parent_name", "size_bytes", "mountpoints")
    assert got == [("sda", None, 1024**4, ""), ("sda1", "sda", 512 * 1024**2, "/boot"), ("sda2", "sda", 1024**4, ""), ("sdb", None, None, ""), ("vg", "sda2", 1024**3, "/")]


def test_file_listings(spark):
    text = "/etc/cron.d:\ntotal 4\ndrwxr-xr-x 2 root root 4096 Nov 13 2023 .\n-rw-rw-r--. 1 root adm 201 Jan  4 22:28 job one\nlrwxrwxrwx 1 root root 9 Jan  4 22:28 l -> /opt/x\n\n/etc/cron.daily:\nls: cannot open"
    got = rows(software.run_file_listings(blocks_of(spark, ("ls_etc_cron", text))), "path", "perm_octal", "file_type", "symlink_target", F.col("mtime_normalized_utc").cast("string"))
    assert got == [("/etc/cron.d/.", 755, "dir", None, "2023-11-13 00:00:00"), ("/etc/cron.d/job one", 664, "file", None, "2024-01-04 22:28:00"), ("/etc/cron.d/l", 777, "link", "/opt/x", "2024-01-04 22:28:00")]


def test_address_scope_is_read_and_inferred(spark):
    text = "2: eth0: <UP> mtu 1500 qdisc x state UP\n    link/ether 02:00:00:00:00:0A brd ff\n    inet 10.0.0.8/24 brd 1 scope global eth0\n    inet 10.0.0.9/24\n    inet6 fe80::1/64\n3: bad line"
    b = blocks_of(spark, ("ip_addr", text))
    assert rows(network.run_interfaces(b), "ifname", "mac_addr", "state", "mtu") == [("eth0", "02:00:00:00:00:0a", "UP", 1500)]
    assert rows(network.run_interface_addrs(b), "address", "scope", "addr_type") == [("10.0.0.8", "global", "private"), ("10.0.0.9", "global", "private"), ("fe80::1", "link", "link_local")]


def test_audit_rules_in_both_syntaxes(spark):
    b = blocks_of(spark, ("auditctl_s", "enabled 2"), ("auditctl_l", "No rules\n-w /etc/shadow -p wa -k passwd\n-a always,exit -S execve,openat -F auid>=1000 -F key=exec\n-w /etc/shadow -p wa -k passwd"))
    rules = software.run_audit_rules(b)
    assert rows(rules, "rule_type", "path", "permission", "syscall", "auid", "key_name") == [("file", "/etc/shadow", "wa", None, None, "passwd"), ("syscall", None, None, "execve,openat", ">=1000", "exec")]
    flags = posture.run_audit_posture(keyvalue.run_audit_status(b), rules).first()
    assert (flags.audit_enabled, flags.audit_immutable, flags.has_critical_auth_rules, flags.has_passwd_rules, flags.has_sudo_rules) == (1, 1, 1, 1, 0)


def test_no_bounds_per_run(spark):
    usb = "\n".join(f"Bus 001 Device {i:03d}: ID 1d6b:{i:04d} Some hub" for i in range(1, 61))
    mods = "\n".join(f"snd_{i:03d} 10 0" for i in range(150)) + "\n" + "\n".join(f"zz_{i:03d} 10 0" for i in range(220))
    info = "\n".join(f"# modinfo zz_{i:03d}\nlicense: GPL\nparm: no\nalias: a\nalias: b" for i in range(220))
    b = blocks_of(spark, ("lsusb_v", usb), ("lsmod", mods), ("modinfo_all", info + "\n# modinfo absent\nlicense: GPL"))
    assert hardware.run_usb_devices(b).count() == 60
    assert hardware.run_lsmod(b).count() == 370
    assert hardware.run_modinfo_kv(b).count() == 660
    long = "x" * 100
    tags = [r[0] for r in spark.createDataFrame([(f"cat /{long}/a",), (f"cat /{long}/b",), ("cat /short",)], "c string").select(command_tag("c")).collect()]
    assert len(set(tags)) == 3 and tags[2] == "cat_short" and tags[0][:90] == tags[1][:90]


@pytest.mark.parametrize("text,want", [("SecureBoot enabled", 1), ("Secure Boot disabled", 0), ("not supported", None)])
def test_unknown_secure_boot_stays_unknown(spark, text, want):
    assert keyvalue.run_secure_boot(blocks_of(spark, ("mokutil_sb_state", text))).first().secure_boot_enabled == want


def test_journald_section_and_rsyslog_targets(spark):
    b = blocks_of(spark, ("journald_conf", "[Journal]\n#ForwardToSyslog=yes\nForwardToSyslog=no\n[Other]\nAudit=x"), ("rsyslog_conf", "# *.* @no\n*.* @@a:514\nlocal.* @[::1]:514\n*.* @@a:514"))
    assert rows(keyvalue.fact_journald(b), "fact_key", "fact_value") == [("ForwardToSyslog", "no")]
    assert keyvalue.fact_rsyslog(b).first().fact_value == '["@@a:514", "@[::1]:514"]'


def test_containers(spark):
    ps = 'CONTAINER ID   IMAGE\n0123456789ab  nginx  "cmd"  2 days ago  Up 2 days  web\nabcdefabcdef  img  "c"  3 weeks ago  Exited (137) 5 hours ago  old\nnot a row'
    b = blocks_of(spark, ("docker_ps_a", ps), ("podman_ps_a", "podman not installed"))
    assert rows(software.run_containers(b), "container_id", "status", "names", "created_text") == [
        ("0123456789ab", "Up 2 days", "web", "2 days ago"), ("abcdefabcdef", "Exited (137) 5 hours ago", "old", "3 weeks ago")]
    assert rows(software.run_container_summary(b), "runtime", "k", "v") == [("docker", "containers_ps_a_count", "3"), ("podman", "containers_ps_a_count", "1")]
