"""Fields of binary payloads as column expressions, and TLS fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sixteen values reserved to keep implementations tolerant.
GREASE = tuple(0x0A0A + 0x1010 * n for n in range(16))
#: TLS versions as fingerprints spell them.
TLS_VERSIONS = {0x0304: "13", 0x0303: "12", 0x0302: "11", 0x0301: "10", 0x0300: "s3"}
#: Kerberos message tags, service names looked for, and RPC interfaces.
KERBEROS = {0x6A: "AS-REQ", 0x6B: "AS-REP", 0x6C: "TGS-REQ", 0x6D: "TGS-REP", 0x6E: "AP-REQ", 0x7E: "KRB-ERROR"}
SERVICES = ("MSSQLSvc", "HTTP", "CIFS", "HOST", "krbtgt", "WSMAN", "TERMSRV")
RPC = {
    "svcctl": ("367abb81-9844-35f1-ad32-98f038001003", "HIGH"),
    "drsuapi": ("e3514235-4b06-11d1-ab04-00c04fc2dcd2", "CRITICAL"),
    "samr": ("12345778-1234-abcd-ef00-0123456789ac", "MEDIUM"),
    "lsarpc": ("12345778-1234-abcd-ef00-0123456789ab", "MEDIUM"),
}
HTTP_METHODS = ("GET", "POST", "PUT", "DELETE", "HEAD", "OPTIONS", "PATCH")


def number(data: Column, at: Column | int, size: int) -> Column:
    """An unsigned big-endian number of up to 7 bytes, ``at`` bytes from the start; null past the end."""
    start = (F.lit(at) if isinstance(at, int) else at) + 1
    piece = F.substring(data, start, F.lit(size))
    return F.when(F.length(piece) == size, F.conv(F.hex(piece), 16, 10).cast("long"))


def ip_text(data: Column, at: Column | int) -> Column:
    """A dotted IPv4 address."""
    base = F.lit(at) if isinstance(at, int) else at
    return F.concat_ws(".", *[number(data, base + i, 1).cast("string") for i in range(4)])


def holds(data: Column, hex_text: str) -> Column:
    """Whether the payload has these bytes, at a byte's boundary."""
    return F.hex(data).rlike(f"^(?:..)*?{hex_text.upper()}")


def without_grease(values: Column) -> Column:
    """A list without reserved values; repeated values stay."""
    return F.filter(F.coalesce(values, F.array().cast("array<int>")), lambda v: ~v.isin(*GREASE))


def _hex4(values: Column) -> Column:
    return F.transform(values, lambda v: F.lower(F.lpad(F.hex(v), 4, "0")))


def _digest(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 12)


def ja4(hello: Column, protocol: str = "t") -> Column:
    """The JA4 fingerprint of a hello: a struct of version, ciphers, extensions, sni, alpn and signature_algorithms."""
    ciphers, extensions, signatures = (without_grease(hello[c]) for c in ("ciphers", "extensions", "signature_algorithms"))
    version = None
    for value, text in TLS_VERSIONS.items():
        version = F.when(hello["version"] == value, text) if version is None else version.when(hello["version"] == value, text)
    named = hello["sni"].isNotNull() & (hello["sni"] != "") & ~hello["sni"].rlike(r"^\d+\.\d+\.\d+\.\d+$")
    two = lambda n: F.lpad(F.least(n, F.lit(99)).cast("string"), 2, "0")
    alpn = F.when(F.coalesce(hello["alpn"], F.lit("")) == "", "00").otherwise(F.concat(F.substring(hello["alpn"], 1, 1), F.substring(hello["alpn"], -1, 1)))
    a = F.concat(F.lit(protocol), version.otherwise("00"), F.when(named, "d").otherwise("i"), two(F.size(ciphers)), two(F.size(extensions)), alpn)
    b = F.when(F.size(ciphers) == 0, "0" * 12).otherwise(_digest(F.array_join(F.array_sort(_hex4(ciphers)), ",")))
    kept = F.array_join(F.array_sort(_hex4(F.filter(extensions, lambda e: ~e.isin(0, 16)))), ",")
    signed = F.when(F.size(signatures) > 0, F.concat(kept, F.lit("_"), F.array_join(_hex4(signatures), ","))).otherwise(kept)
    return F.concat_ws("_", a, b, F.when(F.size(extensions) == 0, "0" * 12).otherwise(_digest(signed)))


def ja3(hello: Column) -> Column:
    """The JA3 digest of a hello with legacy_version, ciphers, extensions, groups and point_formats."""
    lists = [F.array_join(without_grease(hello[c]).cast("array<string>"), "-") for c in ("ciphers", "extensions", "groups")]
    points = F.array_join(F.coalesce(hello["point_formats"], F.array().cast("array<int>")).cast("array<string>"), "-")
    return F.md5(F.concat_ws(",", hello["legacy_version"].cast("string"), *lists, points).cast("binary"))


def splt_entropy(lengths: Column) -> Column:
    """Entropy of packet lengths, each weighed by its share of all, to 4 places."""
    sizes = F.transform(lengths, lambda x: F.abs(x).cast("double"))
    total = F.aggregate(sizes, F.lit(0.0), lambda a, x: a + x)
    return F.when(total <= 0, 0.0).otherwise(F.round(F.aggregate(sizes, F.lit(0.0), lambda a, x: a - F.when(x > 0, x / total * F.log2(x / total)).otherwise(0.0)), 4))


def splt_beacon(lengths: Column) -> Column:
    """Whether the client's packets are few, small and alike."""
    sent = F.filter(lengths, lambda x: x > 0)
    n = F.greatest(F.size(sent), F.lit(1))
    mean = F.aggregate(sent, F.lit(0.0), lambda a, x: a + x) / n
    variance = F.aggregate(sent, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
    return (F.size(lengths) >= 4) & (F.size(sent) >= 3) & (mean <= 800) & (variance < 150)


def kerberos(data: Column) -> Column:
    """A struct ``(message, preauth, rc4, services)`` of a Kerberos message, with or without its length in front; null for anything else."""
    framed = (F.length(data) > 4) & (number(data, 0, 4) == F.length(data) - 4)
    body = F.when(framed, F.substring(data, F.lit(5), F.length(data))).otherwise(data)
    name = None
    for tag, text in KERBEROS.items():
        name = F.when(number(body, 0, 1) == tag, text) if name is None else name.when(number(body, 0, 1) == tag, text)
    found = F.array_compact(F.array(*[F.when(holds(body, s.encode().hex()), F.lit(s)) for s in SERVICES]))
    made = F.struct(name.alias("message"), holds(body, "020102").alias("preauth"), holds(body, "020117").alias("rc4"), found.alias("services"))
    return F.when((F.length(data) >= 6) & name.isNotNull(), made)


def rpc_interface(data: Column) -> Column:
    """The known interface that an RPC bind, alteration or request names; null for anything else."""
    import uuid

    kind = number(data, 2, 1)
    fits = (number(data, 0, 2) == 0x0500) & ((kind == 0) | (kind.isin(11, 14) & (F.length(data) >= 44)))
    name = None
    for text, (guid, _) in RPC.items():
        here = holds(data, uuid.UUID(guid).bytes_le.hex())
        name = F.when(here, text) if name is None else name.when(here, text)
    return F.when((F.length(data) >= 16) & fits, name)


def http_request(data: Column) -> Column:
    """A struct ``(method, uri, path, host, user_agent, tenant, headers, body)`` of an HTTP/1 request; null for anything else."""
    text = F.decode(data, "ISO-8859-1")
    parts = F.split(text, "\r?\n\r?\n", 2)
    lines = F.split(F.element_at(parts, 1), "\r?\n")
    first = F.split(F.element_at(lines, 1), " ")
    pairs = F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda h: F.struct(F.lower(F.trim(F.substring_index(h, ":", 1))).alias("k"), F.trim(F.regexp_replace(h, r"^[^:]*:", "")).alias("v")))
    header = lambda *names: F.element_at(F.transform(F.filter(pairs, lambda p: p["k"].isin(*names)), lambda p: p["v"]), 1)
    some = lambda *names: F.when(F.exists(pairs, lambda p: p["k"].isin(*names)), header(*names))
    uri = F.get(first, 1)
    made = F.struct(
        F.get(first, 0).alias("method"),
        uri.alias("uri"),
        F.substring_index(uri, "?", 1).alias("path"),
        some("host").alias("host"),
        some("user-agent").alias("user_agent"),
        some("x-tenant-id", "x-tenant", "x-org-id").alias("tenant"),
        F.substring(F.coalesce(F.get(parts, 1), F.lit("")), 1, 2048).alias("body"),
    )
    return F.when((F.size(first) >= 3) & F.get(first, 0).isin(*HTTP_METHODS) & F.get(first, 2).startswith("HTTP/"), made)


def dhcp(data: Column) -> Column:
    """A BOOTP message with options: a struct ``(mac, ip, message_type, hostname)``; null for anything else.

    Options are walked once, from one option's end to the next; a list cut short gives what came before.
    """
    end = F.length(data)

    def step(acc: Column, i: Column) -> Column:
        code, size = number(data, i, 1), number(data, i + 1, 1)
        here = (acc["next"] == i) & ~acc["over"]
        option = here & ~code.isin(0, 255) & size.isNotNull()
        body = F.substring(data, i + 3, size.cast("int"))
        return F.struct(
            F.when(option, i + 2 + size.cast("int")).when(here, i + 1).otherwise(acc["next"]).alias("next"),
            (acc["over"] | (here & ((code == 255) | ((code != 0) & size.isNull())))).alias("over"),
            F.when(option & (code == 53) & (F.length(body) > 0), number(body, 0, 1).cast("int")).otherwise(acc["message_type"]).alias("message_type"),
            F.when(option & (code == 12), F.make_valid_utf8(body.cast("string"))).otherwise(acc["hostname"]).alias("hostname"),
        )

    start = F.struct(F.lit(240).alias("next"), F.lit(False).alias("over"), F.lit(None).cast("int").alias("message_type"), F.lit(None).cast("string").alias("hostname"))
    options = F.aggregate(F.when(end > 240, F.sequence(F.lit(240), end - 1)).otherwise(F.array().cast("array<int>")), start, step)
    address = F.lower(F.hex(F.substring(data, F.lit(29), F.least(number(data, 2, 1), F.lit(6)).cast("int"))))
    mac = F.regexp_replace(address, "(..)(?!$)", "$1:")
    valid = (end >= 240) & number(data, 0, 1).isin(1, 2) & (F.hex(F.substring(data, 237, 4)) == "63825363")
    return F.when(valid, F.struct(mac.alias("mac"), ip_text(data, 16).alias("ip"), options["message_type"].alias("message_type"), options["hostname"].alias("hostname")))


def big_endian(value: Column, size: int) -> Column:
    """Hexadecimal digits of a number in ``size`` bytes."""
    return F.lpad(F.hex(value.cast("long")), 2 * size, "0")


def little_endian(value: Column, size: int) -> Column:
    digits = big_endian(value, size)
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))])
