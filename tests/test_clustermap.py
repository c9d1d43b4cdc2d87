"""Texts of cluster maps, made from the tables of attributes: one that is good, and each way to spoil it."""

import pytest

from stowage.sources import clustermap

#: A value of each attribute that is taken, and one that is not with the code of the fault.
HEADER = {
    "epoch": ("907", [("-1", "malformed"), (str(1 << 64), "malformed")]),
    "monid": ("ab" * 16, [("ab" * 15, "malformed"), ("AB" * 16, "malformed")]),
    "objmax": (str(1 << 22), [(str(1 << 19), "range"), (str(3 << 20), "range"), ("1k", "malformed")]),
    "blksz": ("512", [("0", "range"), ("513", "range"), (str(1 << 32), "malformed")]),
    "replicas": ("3", [("0", "range"), ("65", "range")]),
    "csumalg": ("blake2s256", [("crc32", "choice")]),
    "placehash": ("blake2s256-64", [("modulo", "choice")]),
    "pollms": ("20", [("0", "range"), ("x", "malformed")]),
    "leasems": ("70", [("20", "order"), ("1", "order")]),
    "replms": ("500", [("800", "order"), ("", "malformed")]),
    "deadms": ("800", [("70", "order")]),
    "outmins": ("5", [("5.5", "malformed")]),
    "tombdays": ("2", [("two", "malformed")]),
    "mincopies": ("2", [("0", "range")]),
    "retain": ("4", [("1", "range")]),
    "placerule": ("nodes", [("random", "choice")]),
}
INSTANCE = {
    "onnode": ("alder", [("birch", "owner"), ("a b", "word")]),
    "addr": ("udp!host-a!9", [("h" * 128, "malformed")]),
    "uuid": ("0f" * 16, [("0g" * 16, "malformed"), ("0f" * 17, "malformed")]),
    "class": ("tape", [("t" * 32, "malformed")]),
    "zone": ("west", [("we.st", "malformed")]),
    "weight": ("100", [("99", "range"), ("half", "malformed")]),
    "status": ("in", [("away", "choice")]),
    "up": ("yes", [("perhaps", "choice")]),
    "since": ("900", [("soon", "malformed")]),
    "fenced": ("no", [("0", "choice")]),
}
STALE = {"reporter": ("birch.12", [("birch", "malformed"), ("elm.1", "unknown"), ("alder.3", "owner")]), "since": ("901", [("?", "malformed")])}
OPTIONAL = {"retain", "placerule", "class", "zone", "weight", "since", "fenced"}
OTHER = {"onnode": "birch", "addr": "x", "uuid": "1e" * 16, "status": "dead", "up": "no"}


def record(first, attributes):
    return "\n   ".join([first, *(f"{k}={v}" for k, v in attributes.items())]) + "\n"


def text(header=None, instance=None, stale=None, other=None):
    good = [{k: v[0] for k, v in x.items()} for x in (HEADER, INSTANCE, STALE)]
    h, i, s = (dict(g) if x is None else x for g, x in zip(good, (header, instance, stale), strict=True))
    return "# forest\n" + record("map=forest", h) + "node=alder\nnode=birch\n" + record("instance=alder.3", i) + record("instance=birch.12", other or OTHER) + record("stale=alder.3", s)


def code(of):
    with pytest.raises(clustermap.BadMap) as e:
        clustermap.parse(of)
    assert str(e.value).startswith("bad map: " + e.value.code)
    return e.value.code


def test_tables_are_covered():
    assert [*HEADER] == [*clustermap.HEADER] and [*INSTANCE] == [*clustermap.INSTANCE] and [*STALE] == [*clustermap.STALE]


def test_good():
    m = clustermap.parse(text() + "\nweather=mild wind=2\n\train=0\n")
    assert m.header["epoch"] == 907 and m.header["name"] == "forest" and m.nodes == ["alder", "birch"]
    assert m.stale == {("alder.3", "birch.12"): 901}
    assert [(i, x["node"], x["idx"], x["up"]) for i, x in m.instances.items()] == [("alder.3", "alder", 3, "yes"), ("birch.12", "birch", 12, "no")]


@pytest.mark.parametrize("kind", ["header", "instance", "stale"])
def test_every_attribute(kind):
    table = {"header": HEADER, "instance": INSTANCE, "stale": STALE}[kind]
    good = {k: v[0] for k, v in table.items()}
    for name, (value, wrong) in table.items():
        without = {k: v for k, v in good.items() if k != name}
        if name in OPTIONAL:
            clustermap.parse(text(**{kind: without}))
        else:
            assert code(text(**{kind: without})) == "missing", name
        doubled = good | {name: f"{value} {name}={value}"}
        assert code(text(**{kind: doubled})) == "repeated", name
        for bad, want in wrong:
            assert code(text(**{kind: good | {name: bad}})) == want, (name, bad)


@pytest.mark.parametrize("status", ["new", "in", "out", "dead"])
@pytest.mark.parametrize("up", ["yes", "heal", "no"])
@pytest.mark.parametrize("fenced", ["yes", "no"])
def test_states(status, up, fenced):
    legal = {(s, u, f) for s in ("new", "in", "out") for u in ("yes", "heal", "no") for f in ("yes", "no") if (f == "no" or u == "no") and (s, u) != ("new", "heal")} | {("dead", "no", "no")}
    x = text(instance={k: v[0] for k, v in INSTANCE.items()} | {"status": status, "up": up, "fenced": fenced})
    if (status, up, fenced) in legal:
        assert clustermap.parse(x).instances["alder.3"]["status"] == status
    else:
        assert code(x) == "state"


@pytest.mark.parametrize("again", ["map=other epoch=1", "node=birch", "instance=birch.12 " + " ".join(f"{k}={v}" for k, v in OTHER.items()), "stale=alder.3 reporter=birch.12"])
def test_no_record_twice(again):
    assert code(text() + again + "\n") == "repeated"


@pytest.mark.parametrize(("add", "want"), [("node=a.b\n", "malformed"), ("instance=alder\n", "malformed"), ("instance=alder.007\n", "malformed"), ("stale=alder reporter=birch.12\n", "malformed"), ("word\n", "word"), ("=1\n", "word"), ("node=äsh\n", "character"), ("node=a\rb\n", "character")])
def test_records(add, want):
    assert code(text() + add) == want


def test_beginning():
    assert code("") == code("# nothing\n\n") == code("node=alder\n") == "missing"
    assert code(" map=forest\n") == "indent"
    assert code(text(other=OTHER | {"onnode": "alder"})) == "owner"


def test_zones():
    more = OTHER | {"onnode": "alder", "zone": "east", "status": "in"}
    assert code(text() + record("instance=alder.4", more)) == "zone"
    assert clustermap.parse(text() + record("instance=alder.4", more | {"zone": "west"})).instances["alder.4"]["zone"] == "west"


def test_successor():
    def at(epoch, **changed):
        return clustermap.parse(text(header={k: v[0] for k, v in HEADER.items()} | {"epoch": str(epoch)} | changed))

    assert clustermap.successor(at(5), at(6)) and not clustermap.successor(at(6), at(5)) and not clustermap.successor(at(5), at(5), force=True)
    assert not clustermap.successor(at(5), at(9)) and clustermap.successor(at(5), at(9), force=True)
    assert not clustermap.successor(at(5), at(6, blksz="1024")) and clustermap.successor(at(5), at(6, deadms="900"))


def test_tables(spark):
    t = clustermap.tables(spark, text())
    assert t["instance"].count() == t["node"].count() == 2 and t["stale"].first().reporter == "birch.12" and t["header"].first().epoch == "907"
