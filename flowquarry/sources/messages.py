"""TLS hellos and DNS messages of payloads, which hold nested lengths, by short readers behind pandas UDFs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HELLO = (
    "legacy_version int, version int, ciphers array<int>, extensions array<int>, sni string, alpn string, groups array<int>, "
    "signature_algorithms array<int>, point_formats array<int>"
)
DNS = "id int, response boolean, domain string, qtype int, ips array<string>, ttl long"


def _words(data: bytes) -> list[int]:
    return [int.from_bytes(data[i : i + 2], "big") for i in range(0, len(data) - 1, 2)]


def read_hello(data: bytes | None) -> dict | None:
    """The fields of a TLS ClientHello record; None for anything else."""
    if not data or len(data) < 43 or data[0] != 22 or data[5] != 1:
        return None
    at, out = 9, {"legacy_version": int.from_bytes(data[9:11], "big"), "sni": None, "alpn": None, "groups": [], "signature_algorithms": [], "point_formats": []}
    at += 2 + 32
    at += 1 + data[at]
    size = int.from_bytes(data[at : at + 2], "big")
    out["ciphers"] = _words(data[at + 2 : at + 2 + size])
    at += 2 + size
    if at >= len(data):
        return None
    at += 1 + data[at]
    end = min(len(data), at + 2 + int.from_bytes(data[at : at + 2], "big"))
    at += 2
    kinds, versions = [], []
    while at + 4 <= end:
        kind, size = int.from_bytes(data[at : at + 2], "big"), int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        at += 4 + size
        kinds.append(kind)
        if kind == 0 and len(body) > 5:
            out["sni"] = body[5 : 5 + int.from_bytes(body[3:5], "big")].decode("ascii", "replace")
        elif kind == 16 and len(body) > 3:
            out["alpn"] = body[3 : 3 + body[2]].decode("ascii", "replace")
        elif kind == 10:
            out["groups"] = _words(body[2:])
        elif kind == 13:
            out["signature_algorithms"] = _words(body[2:])
        elif kind == 11 and body:
            out["point_formats"] = list(body[1 : 1 + body[0]])
        elif kind == 43 and body:
            versions = [v for v in _words(body[1:]) if v & 0x0F0F != 0x0A0A]
    return out | {"extensions": kinds, "version": max(versions, default=out["legacy_version"])}


def _name(data: bytes, at: int, depth: int = 0) -> tuple[str, int]:
    labels = []
    while at < len(data) and data[at]:
        if data[at] & 0xC0 == 0xC0:
            if depth < 10 and at + 1 < len(data):
                labels.append(_name(data, int.from_bytes(data[at : at + 2], "big") & 0x3FFF, depth + 1)[0])
            return ".".join(x for x in labels if x), at + 2
        labels.append(data[at + 1 : at + 1 + data[at]].decode("ascii", "replace"))
        at += 1 + data[at]
    return ".".join(labels), at + 1


def read_dns(data: bytes | None) -> dict | None:
    """Question, addresses and least lifetime of a DNS message, with or without its length in front; None for anything else."""
    if not data or len(data) < 12:
        return None
    if int.from_bytes(data[:2], "big") == len(data) - 2:
        data = data[2:]
    questions, answers = int.from_bytes(data[4:6], "big"), int.from_bytes(data[6:8], "big")
    if not 1 <= questions <= 50 or answers > 100:
        return None
    at, domain, qtype, ips, lives = 12, None, None, [], []
    for _ in range(questions):
        name, at = _name(data, at)
        domain, qtype = (name, int.from_bytes(data[at : at + 2], "big")) if domain is None else (domain, qtype)
        at += 4
    for _ in range(answers):
        _, at = _name(data, at)
        if at + 10 > len(data):
            break
        kind, size = int.from_bytes(data[at : at + 2], "big"), int.from_bytes(data[at + 8 : at + 10], "big")
        lives.append(int.from_bytes(data[at + 4 : at + 8], "big"))
        if kind == 1 and size == 4:
            ips.append(".".join(map(str, data[at + 10 : at + 14])))
        at += 10 + size
    return {"id": int.from_bytes(data[:2], "big"), "response": bool(data[2] & 0x80), "domain": domain, "qtype": qtype, "ips": ips, "ttl": min(lives, default=None)}


def _frame(rows: list[dict | None], schema: str) -> pd.DataFrame:
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]
    return pd.DataFrame({n: [None if r is None else r[n] for r in rows] for n in names})


def tls_hello(data: Column) -> Column:
    """A struct of the hello in each payload, with null fields where there is none."""

    @F.pandas_udf(HELLO)
    def run(payloads: pd.Series) -> pd.DataFrame:
        return _frame([read_hello(p) for p in payloads], HELLO)

    return run(data)


def dns_message(data: Column) -> Column:
    """A struct of the DNS message in each payload, with null fields where there is none."""

    @F.pandas_udf(DNS)
    def run(payloads: pd.Series) -> pd.DataFrame:
        return _frame([read_dns(p) for p in payloads], DNS).astype({"id": "Int32", "qtype": "Int32", "ttl": "Int64", "response": "boolean"})

    return run(data)
