"""Scalar rules as native Column expressions (no Python at run time)."""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.functions.text import literal_map, at, blank_to_null, col, contains_any, extract, starts_with_any, strip

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def iso(c: Column | str) -> Column:
    """Timestamp as ISO-8601 UTC text (session time zone is UTC)."""
    return F.date_format(col(c), ISO)


def human_size_to_bytes(c: Column | str) -> Column:
    """`2.0Ti`, `512M`, `0B`, `17` -> bytes; base 1024; anything else NULL."""
    pattern = r"^\s*(\d+(?:\.\d+)?)\s*(?:([kKmMgGtTpP])(?:[iI]?[bB]?)|[bB])?\s*$"
    number = extract(c, pattern, 1).try_cast("double")
    unit = F.lower(F.regexp_extract(col(c), pattern, 2))
    factor = F.lit(1.0)
    for suffix, power in C.SIZE_UNITS.items():
        factor = F.when(unit == suffix, F.lit(float(1024**power))).otherwise(factor)
    return F.floor(number * factor).cast("bigint")


def snapshot_ip(path: Column | str) -> Column:
    return extract(path, C.SNAPSHOT_NAME, 1)


def snapshot_time(path: Column | str) -> Column:
    return F.try_to_timestamp(extract(path, C.SNAPSHOT_NAME, 2), F.lit(C.SNAPSHOT_TIME_FORMAT))


def let(value: Column, body) -> Column:
    """`body(value)` with `value` evaluated once per row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _with_year(ts: Column, year: Column) -> Column:
    return F.try_make_timestamp(year, F.month(ts), F.dayofmonth(ts), F.hour(ts), F.minute(ts), F.second(ts))


def _not_after_run(ts: Column, collected_at: Column) -> Column:
    """A time from a later year, or more than six months later in the same year, belongs to the year before."""
    y, ry = F.year(ts), F.year(collected_at)
    late = (y > ry) | ((y == ry) & (F.month(ts) - F.month(collected_at) > 6))
    return F.when(late, _with_year(ts, ry - 1)).otherwise(ts)


def free_text_to_utc(text: Column | str, collected_at: Column | str) -> Column:
    """Log-style date text -> timestamp; year-less formats take the year of the run.

    The shape of the text picks the format, so a row costs one or two parses.
    """
    run = col(collected_at)

    def parse(t: Column) -> Column:
        out = F.when(
            t.rlike(C.YEARLESS_SHAPE),
            F.try_to_timestamp(F.concat_ws(" ", F.year(run).cast("string"), t), F.lit("yyyy " + C.YEARLESS_FORMAT)),
        )
        text_ = t
        for shape, formats in C.TIME_FORMATS:
            t = text_
            if formats[0].startswith("M/d/yy "):  # POSIX pivot: two-digit years 69..99 are 19xx
                t = F.when(t.rlike(r"/(?:69|[7-9]\d) "), F.regexp_replace(t, r"/(\d\d) ", "/19$1 ")).otherwise(
                    F.regexp_replace(t, r"/(\d\d) ", "/20$1 "))
                formats = ["M/d/yyyy H:m[:s]"]
            out = out.when(text_.rlike(shape), F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in formats]))
        return out

    squeezed = F.regexp_replace(strip(text), r"\s+", " ")
    no_weekday = F.regexp_replace(squeezed, r"^(?i:Mon|Tue|Wed|Thu|Fri|Sat|Sun) (?=[A-Za-z])", "")
    return let(let(no_weekday, parse), lambda ts: _not_after_run(ts, run))


# one literal: a list of some 600 names would bloat every plan that carries it
_ZONES = "|" + "|".join(sorted(zoneinfo.available_timezones())) + "|"


def zone_name(time_zone: Column | str) -> Column:
    """`Etc/UTC (UTC, +0000)` -> `Etc/UTC`; unknown names become NULL so that they cannot fail a job."""
    token = at(F.split(strip(time_zone), r"\s+"), 0)
    return F.when(F.contains(F.lit(_ZONES), F.concat(F.lit("|"), token, F.lit("|"))), token)


def local_to_utc(ts: Column, zone: Column | str) -> Column:
    return F.to_utc_timestamp(ts, F.coalesce(col(zone), F.lit("UTC")))


def host_text_to_utc(text: Column | str, collected_at: Column | str, zone: Column | str) -> Column:
    explicit = strip(text).rlike(r"T[\d:]+(?:Z|[+-]\d\d:?\d\d)$")
    return let(
        free_text_to_utc(text, collected_at), lambda ts: F.when(explicit, ts).otherwise(local_to_utc(ts, zone))
    )


def utc_to_local(ts: Column | str, zone: Column | str) -> Column:
    return F.from_utc_timestamp(col(ts), F.coalesce(col(zone), F.lit("UTC")))


def process_start_to_utc(start: Column | str, local_run: Column | str, local_day: Column | str, zone: Column | str) -> Column:
    """`ps` start column: `HH:MM` is the run's day (the day before when that is after the run), `MonDD` that date. Time of the run and its
    day (`yyyy-MM-dd`) are local."""
    local_run, day, s = col(local_run), col(local_day), strip(start)
    # one format for both forms: a parse that fails costs more than all the rest of a line
    seconds = F.when(s.rlike(r"^\d{1,2}:\d{2}$"), ":00").otherwise("")
    clock = F.when(s.rlike(r"^\d{1,2}:\d{2}(?::\d{2})?$"), F.try_to_timestamp(F.concat(day, F.lit(" "), s, seconds), F.lit("yyyy-MM-dd H:m:s")))
    clock = F.when(clock > local_run, clock - F.expr("INTERVAL 1 DAY")).otherwise(clock)
    month_day = F.when(
        s.rlike(r"^[A-Z][a-z]{2}\d{1,2}$"),
        F.try_to_timestamp(F.concat(F.year(local_run).cast("string"), F.lit(" "), s), F.lit("yyyy MMMd")),
    )
    month_day = _not_after_run(month_day, local_run)
    year_only = F.when(s.rlike(r"^\d{4}$"), F.try_to_timestamp(s, F.lit("yyyy")))
    return local_to_utc(F.coalesce(clock, month_day, year_only, free_text_to_utc(s, local_run)), zone)


def listing_time_to_utc(mtime: Column | str, collected_at: Column | str, zone: Column | str) -> Column:
    """`ls -l` time: `Nov 13 2025` or `Jan  4 22:28` (the latest such day that is not after the run)."""
    t = F.regexp_replace(strip(mtime), r"\s+", " ")
    run = col(collected_at)
    year = lambda back: F.concat_ws(" ", (F.year(run) - back).cast("string"), t)
    this, last = (F.try_to_timestamp(year(back), F.lit("yyyy MMM d H:m")) for back in (0, 1))
    # a day of room for the zone
    return local_to_utc(
        F.coalesce(F.try_to_timestamp(t, F.lit("MMM d yyyy")), F.when(this > run + F.expr("INTERVAL 1 DAY"), last).otherwise(this)), zone)


def address_type(family: Column | str, address: Column | str) -> Column:
    a = F.lower(strip(address))
    v4 = (
        F.when(a.rlike(r"^127\.\d+\.\d+\.\d+$"), "loopback")
        .when(a.rlike(r"^169\.254\.\d+\.\d+$"), "link_local")
        .when(a.rlike(r"^(?:10\.\d+|172\.(?:1[6-9]|2\d|3[01])|192\.168)\.\d+\.\d+$"), "private")
        .otherwise("public")
    )
    v6 = (
        F.when((a == "::1") | a.startswith("::1/"), "loopback")
        .when(a.startswith("fe80:"), "link_local")
        .when(a.startswith("fd") | a.startswith("fc"), "private")
        .otherwise("public")
    )
    return F.when(col(family) == "inet", v4).when(col(family) == "inet6", v6).otherwise("public")


def is_global_address(address: Column | str) -> Column:
    """True for a routable IPv4/IPv6 literal, false for a reserved one, NULL for text that is no address."""
    a = F.lower(strip(address))
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    is_v4 = a.rlike(rf"^{octet}(?:\.{octet}){{3}}$")
    reserved4 = a.rlike(
        r"^(?:0\.|10\.|127\.|169\.254\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.|192\.0\.[02]\.|198\.1[89]\."
        r"|198\.51\.100\.|203\.0\.113\.|100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|(?:24\d|25[0-5])\.)"
    )
    is_v6 = a.rlike(r"^[0-9a-f:.]*:[0-9a-f:.]*$") & F.contains(a, F.lit(":")) & a.rlike(r"::|^(?:[0-9a-f]{1,4}:){7}")
    reserved6 = a.rlike(r"^(?:::1?$|f[cd]|fe[89ab]|2001:db8)")
    return F.when(is_v4, ~reserved4).when(is_v6, ~reserved6)


def is_loopback_address(address: Column | str) -> Column:
    a = strip(address)
    return a.rlike(r"^127\.\d+\.\d+\.\d+$") | (a == "::1")


def interface_type(name: Column | str) -> Column:
    n = F.lower(strip(name))
    return (
        F.when(n == "lo", "loopback")
        .when(n.startswith("veth") | n.rlike("@.*veth|veth.*@"), "veth")
        .when(n.startswith("docker"), "docker")
        .when(n.startswith("br-") | n.startswith("bridge"), "bridge")
        .when(starts_with_any(n, C.VIRTUAL_IFACES), "virtual")
        .when(starts_with_any(n, C.PHYSICAL_IFACES), "physical")
        .otherwise("other")
    )


def group_type(name: Column | str, gid: Column | str) -> Column:
    return (
        F.when(F.lower(strip(name)).isin(C.WELL_KNOWN_GROUPS), "service")
        .when(col(gid) >= 1000, "user")
        .otherwise("rare")
    )


def route_type(destination: Column | str) -> Column:
    d = strip(destination)
    return (
        F.when(d == "0.0.0.0", "default")
        .when(d.startswith("127.") | (d == "::1"), "host")
        .when(d.startswith("169.254.") | F.lower(d).startswith("fe80:"), "link")
        .otherwise("network")
    )


def bind_scope(address: Column | str) -> Column:
    a = strip(address)
    return (
        F.when(a.startswith("127.") | (a == "::1"), "loopback")
        .when(a.isin("0.0.0.0", "::", "*"), "all_interfaces")
        .otherwise("specific")
    )


def permission_octal(perms: Column | str) -> Column:
    """`drwxr-xr-x` -> 755; setuid/setgid/sticky letters count as executable when lower-case or `S`/`T` as printed."""
    p = col(perms)

    def digit(at_: int, exec_letters: str) -> Column:
        bit = lambda i, letters, w: F.when(F.substring(p, at_ + i, 1).isin(*letters), w).otherwise(0)
        return bit(0, "r", 4) + bit(1, "w", 2) + bit(2, exec_letters, 1)

    value = digit(2, "xsS") * 100 + digit(5, "xsS") * 10 + digit(8, "xstT")
    return F.when(F.length(p) >= 10, value)


# A run of blanks, plain characters, one escape, or one quoted stretch.
_SEGMENT = r"""(\s+|[^\s"'\\]+|\\.|"[^"\\]*(?:\\.[^"\\]*)*"|'[^']*')"""


def shell_words(cmd: Column | str) -> Column:
    """POSIX shell word splitting: quotes removed, escapes resolved.

    Text with an unbalanced quote cannot be split that way and is cut at the
    first whitespace instead. A command is one line, so \n is free to mark word
    boundaries.
    """

    def resolve(seg: Column) -> Column:
        inner = F.substr(seg, F.lit(2), F.length(seg) - 2)
        return (
            F.when(seg.startswith('"'), F.regexp_replace(inner, r'\\(["\\])', "$1"))
            .when(seg.startswith("'"), inner)
            .when(seg.startswith("\\"), F.substr(seg, F.lit(2)))
            .when(F.trim(seg) == "", "\n")
            .otherwise(seg)
        )

    def words(c: Column) -> Column:
        segments = F.regexp_extract_all(c, F.lit(_SEGMENT), F.lit(1))
        quoted = let(segments, lambda s: F.when(
            F.length(F.array_join(s, "")) == F.length(c), F.split(F.array_join(F.transform(s, resolve), ""), "\n")))
        return (
            F.when(~c.rlike(r"""["'\\]"""), F.split(c, r"\s+"))
            .otherwise(F.coalesce(quoted, F.split(c, r"\s+", 2)))
        )

    return let(F.regexp_replace(strip(cmd), "\t", " "), words)


def process_parts(cmd: Column | str, words: Column | str | None = None) -> tuple[Column, Column, Column]:
    """(name, path, arguments) of a command line; kernel threads keep their bracketed name.

    `words` takes the split command when it is already at hand.
    """
    c = strip(cmd)
    kernel = c.startswith("[") & c.endswith("]")
    words = shell_words(c) if words is None else col(words)
    path = F.coalesce(at(words, 0), F.lit(""))
    name = F.substring_index(path, "/", -1)
    args = let(words, lambda w: F.array_join(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), " "))
    return F.when(kernel, c).otherwise(name), F.when(kernel, c).otherwise(path), F.when(kernel, "").otherwise(args)


def sudoers_rule_type(rule: Column | str) -> Column:
    s = strip(rule)
    return (
        F.when(s.startswith("Defaults"), "Defaults")
        .when(s.startswith("Runas"), "Runas")
        .when(s.startswith("Cmnd"), "Cmnd")
        .when(s.startswith("Host"), "Host")
        .when(F.contains(s, F.lit("=")), "User_Host")
        .otherwise("other")
    )


def audit_id_filter(rule: Column | str, name: str) -> Column:
    """Value of an audit id filter; an operator other than plain `=` stays in front of it."""
    pattern = rf"\b{name}([<>=!]*=|[<>])(\S+)"
    op = F.regexp_extract(col(rule), pattern, 1)
    return blank_to_null(F.concat(F.when(op == "=", "").otherwise(op), F.regexp_extract(col(rule), pattern, 2)))


def unit_type(name: Column | str) -> Column:
    return F.coalesce(extract(strip(name), r"\.(" + "|".join(C.UNIT_TYPES) + ")$"), F.lit("other"))


def usb_class_label(code: Column | str) -> Column:
    return F.try_element_at(literal_map(C.USB_CLASS_LABELS), col(code).bitwiseAND(0xFF).cast("string"))


def dmi_value(key: Column | str, value: Column | str) -> Column:
    """Vendor placeholders and values that merely repeat their key become NULL."""
    v = F.lower(strip(value))
    placeholder = v.isin(C.DMI_PLACEHOLDERS) | (v == F.lower(strip(key))) | v.rlike(r"to be filled.*o\.e\.m|o\.e\.m.*to be filled")
    return F.when(~placeholder, strip(value))


def normalize_hostname(name: Column | str) -> Column:
    return F.lower(strip(name))


def hostname_slug(name: Column | str) -> Column:
    return F.regexp_replace(normalize_hostname(name), "[^a-z0-9]+", "")


def is_fake_identifier(id_type: Column | str, value: Column | str) -> Column:
    v = strip(value)
    hardware = col(id_type).isin("serial_number", "dmi_uuid") & F.lower(v).rlike(C.FAKE_HARDWARE_IDS)
    machine = (col(id_type) == "machine_id") & v.rlike(r"^(.)\1*$")
    return v.isNull() | (v == "") | hardware | machine


def identifier_score(id_type: Column | str, value: Column | str, hostname: Column | str) -> Column:
    base = F.lit(10)
    for name, score in C.IDENTIFIER_SCORES.items():
        base = F.when(col(id_type) == name, score).otherwise(base)
    same = (col(id_type) == "hostname") & (normalize_hostname(value) == normalize_hostname(hostname))
    return F.when(is_fake_identifier(id_type, value), 0).otherwise(base + F.when(same, 20).otherwise(0))


def key_fingerprint(key: Column | str, line: Column | str) -> Column:
    """SHA-256 of the decoded key blob, or of the whole line when the key is no base64."""
    return F.coalesce(F.sha2(F.try_to_binary(col(key), F.lit("base64")), 256), F.sha2(col(line), 256))


def uname_arch(uname: Column | str) -> Column:
    return extract(uname, r"\b(x86_64|amd64|aarch64|arm64|i[3-6]86)\b")


def uname_kernel(uname: Column | str) -> Column:
    return at(F.split(strip(uname), r"\s+"), 2)


def gigabytes_text(size: Column | str) -> Column:
    return F.when(col(size) > 0, F.format_string("%.1f GB", col(size) / F.lit(float(1024**3)))).otherwise("Unknown")


def text_or_unknown(c: Column | str) -> Column:
    return F.coalesce(blank_to_null(strip(c)), F.lit("Unknown"))


def tty_kind(tty: Column | str) -> Column:
    t = strip(tty)
    return (
        F.when(F.lower(t) == "ssh", "ssh")
        .when(F.contains(t, F.lit("pts")), "pts")
        .when(t.startswith("tty"), "tty")
        .when(F.contains(F.lower(t), F.lit("console")), "console")
        .otherwise("other")
    )


def severity_rank(severity: Column | str) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in C.SEVERITY_ORDER]), col(severity))


def has_login_shell(shell: Column | str) -> Column:
    return col(shell).ilike("%sh")


def is_internal_name(name: Column | str) -> Column:
    return contains_any(F.lower(col(name)), C.INTERNAL_DNS_MARKERS)
