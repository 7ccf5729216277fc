"""Column expressions shared by the operators; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def identify(src_port: Column, dst_port: Column) -> Column:
    """Protocol by port: the destination port decides, then the source port.

    The port table is one literal map, which keeps the expression short wherever the
    optimizer inlines it.
    """
    by_port = F.create_map(*[F.lit(x) for pair in C.PORT_PROTOCOLS.items() for x in pair])
    return F.coalesce(F.try_element_at(by_port, dst_port), F.try_element_at(by_port, src_port), F.lit("unknown"))


def is_ot(protocol: Column) -> Column:
    return protocol.isin(*C.OT_PROTOCOLS)


def has_any(array: Column, values) -> Column:
    """True if the array holds at least one of the values (false for a null array)."""
    return F.coalesce(F.arrays_overlap(array, F.array(*[F.lit(v) for v in values])), F.lit(False))


def count_of(array: Column, values) -> Column:
    return F.size(F.array_intersect(array, F.array(*[F.lit(v) for v in values])))


def contains_any(text: Column, words) -> Column:
    cond = F.lit(False)
    for word in words:
        cond = cond | text.contains(word)
    return cond


def prefix24(ip: Column) -> Column:
    """First three octets; an address without them is its own prefix."""
    return F.when(F.size(F.split(ip, r"\.")) >= 3, F.substring_index(ip, ".", 3)).otherwise(ip)


def subnet24(ip: Column) -> Column:
    """``a.b.c.0/24`` of an IPv4 address; anything else stays as it is."""
    is_v4 = F.size(F.split(ip, r"\.")) == 4
    return F.when(is_v4, F.concat(F.substring_index(ip, ".", 3), F.lit(".0/24"))).otherwise(ip)


def octet(ip: Column, index: int) -> Column:
    return F.get(F.split(ip, r"\."), index).try_cast("int")


def is_ipv4(ip: Column) -> Column:
    """Dotted quad with four octets of 0–255."""
    octets = F.split(ip, r"\.")
    return (F.size(octets) == 4) & F.coalesce(
        F.forall(octets, lambda o: F.coalesce(o.try_cast("int").between(0, 255), F.lit(False))), F.lit(False)
    )


def ip_number(ip: Column) -> Column:
    """IPv4 address as BIGINT, null if it is not one."""
    total = F.lit(0).cast("bigint")
    for i, weight in enumerate((1 << 24, 1 << 16, 1 << 8, 1)):
        total = total + octet(ip, i).cast("bigint") * F.lit(weight)
    return F.when(is_ipv4(ip), total)


def is_public_ip(ip: Column) -> Column:
    """Internet-routable address; text that is no address counts as not public."""
    a, b = octet(ip, 0), octet(ip, 1)
    private_v4 = (
        a.isin(0, 10, 127)
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168))
        | ((a == 100) & b.between(64, 127))
        | ((a == 169) & (b == 254))
        | (a >= 224)
    )
    low = F.lower(ip)
    local_v6 = (
        low.isin("::", "::1") | low.rlike("^fe[89ab]") | low.rlike("^f[cd]") | low.startswith("ff")
    )
    looks_v6 = low.rlike("^[0-9a-f:]*:[0-9a-f:.]*$")
    return F.coalesce(
        F.when(is_ipv4(ip), ~private_v4).when(looks_v6, ~local_v6).otherwise(F.lit(False)), F.lit(False)
    )


def normalize_mac(mac: Column) -> Column:
    """Lower-case colon form; text without twelve hex digits is only lower-cased."""
    digits = F.lower(F.regexp_replace(mac, "[^0-9a-fA-F]", ""))
    pairs = [F.substring(digits, 2 * i + 1, 2) for i in range(6)]
    return F.when(F.length(digits) == 12, F.concat_ws(":", *pairs)).otherwise(F.lower(mac))


def natural_id(*parts: Column) -> Column:
    """Stable row id: hash of the natural key, equal on every run."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def rank_of(column: Column, ranks: dict) -> Column:
    """Numeric rank of a label by a small fixed table; unknown labels rank -1."""
    out = F.lit(-1)
    for label, rank in ranks.items():
        out = F.when(column == label, F.lit(rank)).otherwise(out)
    return out


def label_of(rank: Column, ranks: dict) -> Column:
    out = F.lit(None).cast("string")
    for label, value in ranks.items():
        out = F.when(rank == value, F.lit(label)).otherwise(out)
    return out
