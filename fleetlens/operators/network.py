"""Extraction of interfaces, addresses, routes, neighbours, name servers, sockets and firewall rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.functions.scalars import address_type, bind_scope, interface_type, let, route_type
from fleetlens.functions.text import (
    RUN_COLS, at, blank_to_null, block, chunks, extract, first_line, last_of_each, last_wins, lines, rstrip, strip, to_int, tokens,
)

def _interface_chunks(blocks: DataFrame) -> DataFrame:
    """One row per numbered header line with the lines below it; header words come as name/value pairs behind the name."""
    words = tokens(first_line("chunk"))
    after = lambda name: at(words, F.array_position(words, F.lit(name)).cast("int"))
    parts = chunks(block(blocks, "ip_addr"), r"\d+:[ \t]")
    return parts.filter(F.array_contains(words, "mtu") & F.array_contains(words, "state") & at(words, 1).endswith(":")).select(
        *RUN_COLS, "chunk_no", "chunk", F.substring_index(at(words, 1), ":", 1).alias("ifname"),
        to_int(after("mtu")).alias("mtu"), after("state").alias("state"))


def run_interfaces(blocks: DataFrame) -> DataFrame:
    mac = F.lower(extract("chunk", r"\n\s+link/ether\s+([0-9a-fA-F:]{17})\b"))
    rows = _interface_chunks(blocks).select(
        "run_id", "chunk_no", "ifname", mac.alias("mac_addr"), "state", "mtu", interface_type("ifname").alias("iface_type"))
    return last_wins(rows, ["run_id", "ifname"], "chunk_no").drop("chunk_no")


def run_interface_addrs(blocks: DataFrame) -> DataFrame:
    """Addresses with the printed scope; a missing scope is inferred."""
    pattern = r"^(inet6?)\s+([0-9a-fA-F.:]+)/(\d+)\b"
    rows = lines(_interface_chunks(blocks), "chunk", keep=("chunk_no", "ifname")).filter(F.col("line").rlike(pattern))
    parsed = rows.select(
        "run_id", "ifname", F.struct("chunk_no", "line_no").alias("ord"),
        F.regexp_extract("line", pattern, 1).alias("family"), F.regexp_extract("line", pattern, 2).alias("address"),
        to_int(F.regexp_extract("line", pattern, 3)).alias("prefixlen"), extract("line", r"\bscope\s+(\S+)").alias("printed"))
    inferred = (
        F.when(F.col("address").isin("127.0.0.1", "::1"), "host")
        .when((F.col("family") == "inet6") & F.lower("address").startswith("fe80:"), "link")
        .otherwise("global")
    )
    typed = parsed.select("run_id", "ifname", "ord", "family", "address", "prefixlen",
                          F.coalesce("printed", inferred).alias("scope"), address_type("family", "address").alias("addr_type"))
    return last_wins(typed, ["run_id", "ifname", "family", "address"], "ord").drop("ord")


def run_resolv_conf_entries(blocks: DataFrame) -> DataFrame:
    p = F.split("line", r"\s+", 2)
    kind = F.lower(at(p, 0))
    rows = lines(block(blocks, "resolv_conf"), distinct=True).filter(~F.col("line").startswith("#") & ~F.col("line").startswith(";"))
    return rows.select(
        "run_id", F.when(kind.isin("nameserver", "search", "options"), kind).otherwise("other").alias("entry_type"),
        F.coalesce(strip(at(p, 1)), F.lit("")).alias("entry_value"), F.col("raw").alias("raw_line"))


def run_ip_neigh(blocks: DataFrame) -> DataFrame:
    t = tokens("line")
    family = F.when(F.contains(at(t, 0), F.lit(":")), "inet6").otherwise("inet")
    return lines(block(blocks, "ip_neigh"), distinct=True).select(
        "run_id", at(t, 0).alias("ip"), extract("line", r"\bdev\s+(\S+)").alias("dev"),
        extract("line", r"\blladdr\s+(\S+)").alias("lladdr"), F.element_at(t, -1).alias("state"),
        address_type(family, at(t, 0)).alias("ip_type"), F.col("raw").alias("raw_line"))


def run_routes(blocks: DataFrame) -> DataFrame:
    header = r"(?ms)^[ \t]*Destination[^\n]*Gateway[^\n]*Iface[^\n]*\n?(.*)\z"
    below = F.when(F.col("output_text").rlike(header), F.regexp_extract("output_text", header, 1)).otherwise(F.col("output_text"))
    t = tokens("line")
    rows = lines(block(blocks, "route_n").withColumn("below", below), "below", distinct=True).filter(F.size(t) >= 8)
    return rows.select(
        "run_id", at(t, 0).alias("destination"), at(t, 1).alias("gateway"), at(t, 2).alias("genmask"),
        at(t, 3).alias("flags"), to_int(at(t, 4)).alias("metric"), to_int(at(t, 5)).alias("ref"),
        to_int(at(t, 6)).alias("use"), at(t, 7).alias("iface"), route_type(at(t, 0)).alias("dest_type"),
        F.col("raw").alias("raw_line"))


def _address_and_port(c: Column) -> Column:
    """`address` and `port` of `10.0.0.1:22`, `[::]:22`, `*`, `*:*`."""
    last = F.substring_index(c, ":", -1)
    ported = F.contains(c, F.lit(":")) & last.rlike(r"^\d+$")
    inside = F.substring_index(F.substr(c, F.lit(2)), "]", 1)
    behind = F.substr(c, F.length(inside) + 3)
    part = lambda address, port: F.struct(address.alias("address"), port.try_cast("int").alias("port"))
    none = F.lit(None).cast("string")
    return (
        F.when(c.isin("*", "*:*"), part(F.lit("*"), none))
        .when(c.startswith("[") & F.contains(c, F.lit("]")), part(inside, F.when(behind.rlike(r"^:\d+$"), F.substr(behind, F.lit(2)))))
        .when(ported, part(F.substr(c, F.lit(1), F.length(c) - F.length(last) - 1), last))
        .otherwise(part(c, none))
    )


_SOCKET_KEY = ["proto", "state", "local_addr", "local_port", "peer_addr", "peer_port", "process_name", "pid"]


def run_listening_sockets(blocks: DataFrame) -> DataFrame:
    """Sockets, the last line of each. A NULL in the key never equals another, so such lines all stay.

    A run's lines are all in its block, so they are parsed and compared there, without a shuffle."""
    owner = r'"([^"]+)".*pid=(\d+)'

    def parsed(raw: Column, no: Column) -> Column:
        # protocol, state, two queues, local and peer address, and the owners, if they are known
        def cells(t: Column, local: Column, peer: Column, name: Column) -> Column:
            key = [at(t, 0), at(t, 1), local["address"], local["port"], peer["address"], peer["port"],
                   blank_to_null(name), F.when(name != "", to_int(F.regexp_extract(at(t, 6), owner, 2)))]
            return F.struct(*[c.alias(n) for c, n in zip(key, _SOCKET_KEY, strict=True)])

        # inside a lambda an expression is evaluated wherever it stands, so what is used again has a name
        def row(x: Column) -> Column:
            alone = F.when(x["local_port"].isNull() | x["peer_port"].isNull() | x["process_name"].isNull() | x["pid"].isNull(), no.cast("string"))
            same = F.concat_ws("\n", *[x[n].cast("string") for n in _SOCKET_KEY], alone)  # a line holds no line break
            return F.struct(same.alias("same"), no.alias("line_no"), x.alias("cells"), raw.alias("raw"))

        known = lambda t: (F.size(t) == 6) | (at(t, 6).startswith("users:((") & at(t, 6).endswith("))"))
        skip = (strip(raw) == "") | raw.startswith("Netid ") | raw.startswith("State ")
        return F.when(~skip, let(tokens(raw, 7), lambda t: F.when(known(t), let(_address_and_port(at(t, 4)), lambda local: let(
            _address_and_port(at(t, 5)), lambda peer: let(F.regexp_extract(at(t, 6), owner, 1), lambda name: let(cells(t, local, peer, name), row)))))))

    of_text = F.transform(F.transform(F.split("output_text", "\n"), rstrip), parsed)
    kept = let(F.filter(of_text, lambda x: x.isNotNull()), lambda xs: last_of_each(xs, "same"))
    rows = block(blocks, "ss_punt").select("run_id", F.explode(kept).alias("x")).select("run_id", "x.cells.*", F.col("x.raw").alias("raw_line"))
    return rows.select("run_id", *_SOCKET_KEY, bind_scope("local_addr").alias("bind_scope"), "raw_line")


def run_firewall_rules(blocks: DataFrame) -> DataFrame:
    sources = [s for s, _ in C.FIREWALL_TYPES]
    # `iptables -S` rules are kept stripped on both sides, so its lines are stripped before they are compared
    text = F.when(F.col("command_tag") == "iptables_s", F.regexp_replace("output_text", r"(?m)^[ \t]+", "")).otherwise(F.col("output_text"))
    rows = lines(block(blocks, *sources).withColumn("rules", text), "rules", keep=("command_tag",), distinct=True)
    zones = F.col("source") == "firewalld_zones"
    return rows.select("run_id", F.col("command_tag").alias("source"), F.col("raw").alias("rule")).select(
        "run_id", "source", "rule",
        F.when(~zones, extract("rule", r"^-A\s+(\S+)")).alias("chain"),
        F.when(~zones, extract("rule", r"\s-j\s+(\S+)")).alias("target"))


def ref_firewall_type(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(C.FIREWALL_TYPES, "source_tag string, description string")
