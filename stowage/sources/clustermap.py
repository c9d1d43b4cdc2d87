"""The text form of a cluster map: read into four tables, or refused with `bad map` and the reason.

A record begins at a line without indent and goes on over indented lines; it is a list of attr=value, the first of
which names its kind. Unknown attributes and kinds are passed over. Attributes are described by tables: a
parser for the value, a check, and whether they are needed. Faults are told apart by a code.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

U64, U32 = (1 << 64) - 1, (1 << 32) - 1
NAME = r"[A-Za-z0-9_-]{1,63}"


class BadMap(ValueError):
    """A text that is no map; code is the kind of fault, where the record or attribute it was found in."""

    def __init__(self, code: str, where: str, detail: str = ""):
        self.code, self.where = code, where
        super().__init__(f"bad map: {code}: {where}" + (f" ({detail})" if detail else ""))


@dataclass
class Attribute:
    """How an attribute is read, and whether a record must have it."""

    read: Callable[[str, str], Any]
    needed: bool = False


def number(most: int, check: Callable[[int], bool] | None = None, wanted: str = "") -> Callable[[str, str], int]:
    def read(name: str, text: str) -> int:
        if not re.fullmatch("[0-9]{1,20}", text) or int(text) > most:
            raise BadMap("malformed", name, f"got {text}, wants decimal digits up to {most}")
        if check and not check(int(text)):
            raise BadMap("range", name, f"got {int(text)}, wants {wanted}")
        return int(text)

    return read


def hexadecimal(digits: int) -> Callable[[str, str], str]:
    def read(name: str, text: str) -> str:
        if not re.fullmatch(f"[0-9a-f]{{{digits}}}", text):
            raise BadMap("malformed", name, f"wants {digits} digits of 0-9a-f")
        return text

    return read


def one_of(*values: str) -> Callable[[str, str], str]:
    def read(name: str, text: str) -> str:
        if text not in values:
            raise BadMap("choice", name, f"got {text}, knows {' '.join(values)}")
        return text

    return read


def matching(pattern: str, what: str) -> Callable[[str, str], str]:
    def read(name: str, text: str) -> str:
        if not re.fullmatch(pattern, text):
            raise BadMap("malformed", name, f"got {text}, wants {what}")
        return text

    return read


def power_of_two(n: int) -> bool:
    return n > 0 and n & (n - 1) == 0


IID = rf"({NAME})\.(0|[1-9][0-9]{{0,8}})"
HEADER = {
    "epoch": Attribute(number(U64), True),
    "monid": Attribute(hexadecimal(32), True),
    "objmax": Attribute(number(U64, lambda n: power_of_two(n) and n >= 1 << 20, "a power of two from 1048576"), True),
    "blksz": Attribute(number(U32, power_of_two, "a power of two"), True),
    "replicas": Attribute(number(U32, lambda n: 1 <= n <= 64, "1 to 64"), True),
    "csumalg": Attribute(one_of("blake2s256"), True),
    "placehash": Attribute(one_of("blake2s256-64"), True),
    "pollms": Attribute(number(U32, lambda n: n >= 1, "1 or more"), True),
    "leasems": Attribute(number(U32), True),
    "replms": Attribute(number(U32), True),
    "deadms": Attribute(number(U32), True),
    "outmins": Attribute(number(U32), True),
    "tombdays": Attribute(number(U32), True),
    "mincopies": Attribute(number(U32, lambda n: n >= 1, "1 or more"), True),
    "retain": Attribute(number(U32, lambda n: n >= 2, "2 or more")),
    "placerule": Attribute(one_of("nodes")),
}
INSTANCE = {
    "onnode": Attribute(matching(NAME, "a node name"), True),
    "addr": Attribute(matching(r"\S{1,127}", "an address"), True),
    "uuid": Attribute(hexadecimal(32), True),
    "class": Attribute(matching(r"\S{1,31}", "a class")),
    "zone": Attribute(matching(NAME, "a node name")),
    "weight": Attribute(number(U32, lambda n: n == 100, "100")),
    "status": Attribute(one_of("new", "in", "out", "dead"), True),
    "up": Attribute(one_of("yes", "heal", "no"), True),
    "since": Attribute(number(U64)),
    "fenced": Attribute(one_of("yes", "no")),
}
STALE = {"reporter": Attribute(matching(IID, "a node, a dot and an index"), True), "since": Attribute(number(U64))}


@dataclass
class ClusterMap:
    header: dict[str, Any] = field(default_factory=dict)
    nodes: list[str] = field(default_factory=list)
    instances: dict[str, dict[str, Any]] = field(default_factory=dict)
    stale: dict[tuple[str, str], int | None] = field(default_factory=dict)


def _records(text: str):
    """Each record's attributes, in order."""
    if not re.fullmatch(r"[\t\n\x20-\x7e]*", text):
        raise BadMap("character", "text", "only ASCII that prints, tabs and ends of line")
    record: list[tuple[str, str]] | None = None
    for line in text.split("\n"):
        if line.startswith("#") or not line.strip():
            continue
        if line[0] in " \t":
            if record is None:
                raise BadMap("indent", "text", "no record to go on with")
        else:
            if record:
                yield record
            record = []
        for word in line.split():
            name, equals, value = word.partition("=")
            if not equals or not name:
                raise BadMap("word", word, "wants a name, an equals sign, a value")
            record.append((name, value))
    if record:
        yield record


def _read(attributes: list[tuple[str, str]], known: dict[str, Attribute], whose: str) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for name, text in attributes:
        if name in known:
            if name in out:
                raise BadMap("repeated", f"{whose} {name}")
            out[name] = known[name].read(name, text)
    return out


def _need(found: dict[str, Any], known: dict[str, Attribute], whose: str) -> None:
    for name, attribute in known.items():
        if attribute.needed and name not in found:
            raise BadMap("missing", f"{whose} {name}")


def _legal(iid: str, x: dict[str, Any]) -> None:
    state = f"status {x['status']}, up {x['up']}, fenced {x.get('fenced', 'no')}"
    silent = x["up"] == "no"
    dead, fenced = x["status"] == "dead", x.get("fenced") == "yes"
    if (dead or fenced) and not silent or dead and fenced or x["status"] == "new" and x["up"] == "heal":
        raise BadMap("state", iid, state)


def parse(text: str) -> ClusterMap:
    """The map that a text stands for; BadMap if it is none."""
    out, seen = ClusterMap(), False
    for (kind, value), *rest in _records(text):
        if kind == "map":
            if seen:
                raise BadMap("repeated", "map")
            seen, out.header = True, {"name": value, **_read(rest, HEADER, "map")}
            _need(out.header, HEADER, "map")
        elif kind == "node":
            if not re.fullmatch(NAME, value):
                raise BadMap("malformed", "node", f"got {value}")
            if value in out.nodes:
                raise BadMap("repeated", f"node {value}")
            out.nodes.append(value)
        elif kind == "instance":
            if not (m := re.fullmatch(IID, value)):
                raise BadMap("malformed", "instance", f"got {value}")
            if value in out.instances:
                raise BadMap("repeated", f"instance {value}")
            x = _read(rest, INSTANCE, value)
            if x.get("onnode", m[1]) != m[1]:
                raise BadMap("owner", value, f"onnode says {x['onnode']}")
            _need(x, INSTANCE, value)
            _legal(value, x)
            out.instances[value] = x | {"node": m[1], "idx": int(m[2])}
        elif kind == "stale":
            if not re.fullmatch(IID, value):
                raise BadMap("malformed", "stale", f"got {value}")
            x = _read(rest, STALE, f"stale {value}")
            _need(x, STALE, f"stale {value}")
            if x["reporter"] == value:
                raise BadMap("owner", f"stale {value}", "reports itself")
            if (value, x["reporter"]) in out.stale:
                raise BadMap("repeated", f"stale {value}", x["reporter"])
            out.stale[value, x["reporter"]] = x.get("since")
    if not seen:
        raise BadMap("missing", "map")
    h = out.header
    for less, more in (("pollms", "leasems"), ("leasems", "deadms")):
        if h[more] <= h[less]:
            raise BadMap("order", more, f"{h[more]}, with {less} {h[less]}")
    if h["replms"] >= h["deadms"]:
        raise BadMap("order", "replms", f"{h['replms']}, with deadms {h['deadms']}")
    zones: dict[str, str | None] = {}
    for x in out.instances.values():
        if zones.setdefault(x["node"], x.get("zone")) != x.get("zone"):
            raise BadMap("zone", x["node"])
    for pair in out.stale:
        for iid in pair:
            if iid not in out.instances:
                raise BadMap("unknown", f"stale {pair[0]}", iid)
    return out


def tables(spark: SparkSession, text: str) -> dict[str, DataFrame]:
    """The map as tables header, node, instance and stale, by epoch."""
    m = parse(text)
    epoch = m.header["epoch"]
    header = [(m.header["name"], *(str(m.header[k]) if k in m.header else None for k in HEADER))]
    instances = [(epoch, i, x["node"], x["idx"], x["addr"], x["uuid"], x.get("class"), x.get("zone"), x["status"], x["up"], x.get("fenced") == "yes", x.get("since")) for i, x in m.instances.items()]
    return {
        "header": spark.createDataFrame(header, "name string, " + ", ".join(f"{k} string" for k in HEADER)),
        "node": spark.createDataFrame([(epoch, n) for n in m.nodes], "epoch long, node string"),
        "instance": spark.createDataFrame(instances, "epoch long, iid string, node string, idx long, addr string, uuid string, class string, zone string, status string, up string, fenced boolean, since long"),
        "stale": spark.createDataFrame([(epoch, *pair, since) for pair, since in m.stale.items()], "epoch long, subject string, reporter string, since long"),
    }


def successor(now: ClusterMap, after: ClusterMap, force: bool = False) -> bool:
    """Whether a map may follow another: the next epoch (any later one under force), nothing immutable changed."""
    same = all(now.header[k] == after.header[k] for k in ("objmax", "blksz", "csumalg", "placehash", "monid"))
    step = after.header["epoch"] - now.header["epoch"]
    return same and (step >= 1 if force else step == 1)
