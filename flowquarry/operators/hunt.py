"""The hunting language: a boolean filter over flow fields, compiled to one column."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Short field names, protocol numbers and byte units of the language.
ALIASES = {"dpt": "dst_port", "spt": "src_port", "proto": "protocol"}
PROTOCOLS = {"TCP": 6, "UDP": 17, "ICMP": 1}
UNITS = {"K": 1024, "M": 1024**2, "G": 1024**3, "T": 1024**4}
#: The ready-made hunts.
PLAYBOOKS = {
    "HUNT-01": "dst_port == 445 AND proto == TCP AND bytes > 50K",
    "HUNT-02": "dst_port IN [8080, 8443, 50050, 4444] AND packets < 50 AND bytes < 20K",
    "HUNT-03": "dst_port == 53 AND bytes > 4K",
    "HUNT-04": "proto == TCP AND packets < 4 AND bytes < 300",
    "HUNT-05": "(dst_port == 443 OR dst_port == 80) AND bytes > 10M",
}
LEXEME = re.compile(r"""\s*(?:(?P<op>==|!=|>=|<=|=|>|<)|(?P<mark>[()\[\],])|"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<word>[A-Za-z0-9_.:/*]+))""")
WORDS = frozenset({"AND", "OR", "NOT", "IN", "CONTAINS"})
COMPARISONS = frozenset({"==", "=", "!=", ">", ">=", "<", "<=", "IN", "CONTAINS"})


@dataclass(frozen=True)
class Lexeme:
    kind: str
    value: object


def literal(word: str) -> object:
    """A number, with a byte unit if it has one, or the word itself."""
    unit = re.fullmatch(r"(\d+(?:\.\d+)?)([KMGT])B?", word, re.I)
    if unit:
        return int(float(unit[1]) * UNITS[unit[2].upper()])
    if re.fullmatch(r"\d+", word):
        return int(word)
    return float(word) if re.fullmatch(r"\d+\.\d+", word) else word


def lexemes(text: str) -> list[Lexeme]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = LEXEME.match(text, at)
        if not m:
            raise ValueError(f"cannot read the query at {text[at:at + 20]!r}")
        at = m.end()
        word = m["word"]
        if m["op"] or m["mark"]:
            out.append(Lexeme("mark", m["op"] or m["mark"]))
        elif word and word.upper() in WORDS:
            out.append(Lexeme("word", word.upper()))
        else:
            quoted = m["dq"] if m["dq"] is not None else m["sq"]
            out.append(Lexeme("value", quoted if quoted is not None else literal(word)))
    return out


class _Compiler:
    """Reads ``or := and (OR and)*``, ``and := not (AND not)*``, ``not := NOT not | (or) | field op value`` straight to columns."""

    def __init__(self, text: str, columns: list[str]):
        self.queue, self.at, self.columns = lexemes(text), 0, columns

    def peek(self) -> object:
        return self.queue[self.at].value if self.at < len(self.queue) and self.queue[self.at].kind != "value" else None

    def take(self, expected: str | None = None) -> Lexeme:
        if self.at >= len(self.queue):
            raise ValueError("the query ends too early")
        found = self.queue[self.at]
        if expected is not None and (found.kind == "value" or found.value != expected):
            raise ValueError(f"expected {expected!r}, found {found.value!r}")
        self.at += 1
        return found

    def whole(self) -> Column:
        out = self.either()
        if self.at < len(self.queue):
            raise ValueError(f"unexpected {self.queue[self.at].value!r}")
        return out

    def either(self) -> Column:
        out = self.both()
        while self.peek() == "OR":
            self.take()
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.negated()
        while self.peek() == "AND":
            self.take()
            out = out & self.negated()
        return out

    def negated(self) -> Column:
        if self.peek() == "NOT":
            self.take()
            return ~self.negated()
        if self.peek() == "(":
            self.take()
            out = self.either()
            self.take(")")
            return out
        field = self.take()
        op = self.take()
        if field.kind != "value" or op.value not in COMPARISONS:
            raise ValueError(f"expected a comparison at {field.value!r} {op.value!r}")
        return self.leaf(str(field.value), str(op.value), self.operand())

    def operand(self) -> object:
        if self.peek() != "[":
            found = self.take()
            if found.kind != "value":
                raise ValueError(f"expected a value, found {found.value!r}")
            return found.value
        self.take()
        values = []
        while self.peek() != "]":
            values.append(self.take().value)
            if self.peek() == ",":
                self.take()
        self.take("]")
        return values

    def leaf(self, name: str, op: str, value: object) -> Column:
        """A comparison that is false, never null, where the field is missing, null or of another kind."""
        name = ALIASES.get(name.lower(), name)
        if name not in self.columns:
            return F.lit(False)
        field, text = F.col(name), F.col(name).cast("string")
        if name == "protocol" and not isinstance(value, list):
            number = PROTOCOLS.get(str(value).upper(), value if value in PROTOCOLS.values() else None)
            if number is not None:
                known = field.isin(list(PROTOCOLS.values()))
                named = {"==": field == number, "=": field == number, "!=": field != number}.get(op, F.lit(False))
                plain = self.compare(field, text, op, value)
                return F.coalesce(F.when(known, named).otherwise(plain), F.lit(False))
        return F.coalesce(self.compare(field, text, op, value), F.lit(False))

    @staticmethod
    def compare(field: Column, text: Column, op: str, value: object) -> Column:
        if op == "IN":
            if isinstance(value, list):
                return text.isin([str(v) for v in value])
            return F.contains(F.lit(str(value)), text)
        if op == "CONTAINS":
            return F.contains(F.lower(text), F.lit(str(value).lower()))
        if isinstance(value, list):
            return F.lit(False)
        if isinstance(value, (int, float)):
            number = text.try_cast("double")
            return {"==": number == value, "=": number == value, "!=": number != value, ">": number > value, ">=": number >= value, "<": number < value, "<=": number <= value}[op]
        folded = F.lower(F.trim(text))
        same = folded == value.strip().lower()
        return {"==": same, "=": same, "!=": ~same}.get(op, F.lit(False))


def compile_query(text: str, columns: list[str]) -> Column:
    """A hunting query as a boolean column over ``columns``; raises ValueError on bad syntax."""
    return _Compiler(text, columns).whole()


def hunt(flows: DataFrame, text: str, limit: int = 100) -> DataFrame:
    """The first matches in time order."""
    return flows.where(compile_query(text, flows.columns)).orderBy("t_us", "flow_id").limit(limit)


def hunt_report(flows: DataFrame, text: str) -> DataFrame:
    """How many flows were scanned and how many match."""
    return flows.agg(F.count("*").alias("total_scanned"), F.count_if(compile_query(text, flows.columns)).cast("long").alias("total_matched"))
