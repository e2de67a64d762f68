"""Address and protocol expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Private and loopback networks of RFC 1918.
RFC1918 = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8")
#: What the IANA registry calls not globally reachable, less shared address space.
NOT_GLOBAL = (
    "0.0.0.0/8",
    "10.0.0.0/8",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/29",
    "192.0.0.170/31",
    "192.0.2.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "240.0.0.0/4",
    "255.255.255.255/32",
)
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"


def ip_number(ip: Column) -> Column:
    """A dotted IPv4 address as a long; null for anything else."""
    octets = [F.split_part(ip, F.lit("."), F.lit(i)).try_cast("long") for i in range(1, 5)]
    return F.when(ip.rlike(IPV4), reduce(lambda a, b: a * 256 + b, octets))


def network(cidr: str) -> tuple[int, int]:
    """First and last address of a network."""
    base, _, bits = cidr.partition("/")
    number = reduce(lambda a, b: a * 256 + int(b), base.split("."), 0)
    size = 1 << (32 - int(bits or 32))
    return number - number % size, number - number % size + size - 1


def pattern_of(cidr: str) -> str:
    """A regular expression for the addresses of a network."""
    first, last = network(cidr)
    parts = []
    for shift in (24, 16, 8, 0):
        low, high = (first >> shift) & 255, (last >> shift) & 255
        parts.append(str(low) if low == high else OCTET if (low, high) == (0, 255) else "(?:" + "|".join(map(str, range(low, high + 1))) + ")")
    return r"\.".join(parts)


def in_networks(ip: Column, networks: tuple[str, ...]) -> Column:
    """Whether an address lies in one of the networks; false for null and for what is no IPv4 address.

    One regular expression, so that plans stay small however often it is asked.
    """
    return F.coalesce(ip.rlike("^(?:" + "|".join(map(pattern_of, networks)) + ")$"), F.lit(False))


def is_internal(ip: Column) -> Column:
    return in_networks(ip, RFC1918)


def is_private(ip: Column) -> Column:
    return in_networks(ip, NOT_GLOBAL)


def has_private_prefix(ip: Column) -> Column:
    """Private by the look of the address alone."""
    return F.coalesce(ip.rlike(r"^(10\.|192\.168\.|127\.|172\.(1[6-9]|2\d|3[01])\.)"), F.lit(False))


def protocol_name(protocol: Column) -> Column:
    other = F.concat(F.lit("OTHER_"), protocol.cast("string"))
    return F.when(protocol == 6, "TCP").when(protocol == 17, "UDP").when(protocol == 1, "ICMP").otherwise(other)


def canonical_pair(ip_a: Column, port_a: Column, ip_b: Column, port_b: Column) -> tuple[Column, Column]:
    """Both ends of a flow, the smaller first, so that both directions have one key."""
    a, b = F.struct(ip_a.alias("ip"), port_a.alias("port")), F.struct(ip_b.alias("ip"), port_b.alias("port"))
    return F.least(a, b), F.greatest(a, b)


def symmetric_partition(src_ip: Column, dst_ip: Column, partitions: int) -> Column:
    """The same number from 0 to ``partitions`` less one for both directions between two hosts."""
    pair = F.concat(F.least(src_ip, dst_ip), F.lit("|"), F.greatest(src_ip, dst_ip))
    return (F.conv(F.substring(F.md5(pair.cast("binary")), 1, 8), 16, 10).cast("long") % partitions).cast("int")
