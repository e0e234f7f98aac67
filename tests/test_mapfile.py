"""The map-file source: files written here by hand, read in runs of blobs, against what went into them."""

import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusflow.sources import mapfile

draw = random.Random(12)


def number(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def zigzag(n):
    return number(n * 2 if n >= 0 else -n * 2 - 1)


def field(n, value):
    return number(n << 3) + number(value) if isinstance(value, int) else number(n << 3 | 2) + number(len(value)) + value


def steps(values):
    return b"".join(zigzag(b - a) for a, b in zip([0, *values], values))


class Strings:
    def __init__(self):
        self.at = {"": 0}

    def of(self, s):
        return self.at.setdefault(s, len(self.at))

    def pairs(self, tags):
        return b"".join(number(self.of(k)) for k in tags), b"".join(number(self.of(v)) for v in tags.values())


def block(nodes=(), ways=(), relations=(), dense=True, offset=0):
    """One data block; coordinates are in units of 1e-7 degrees."""
    strings, group = Strings(), b""
    if dense and nodes:
        flat = b"" if not any(t for *_, t in nodes) else b"".join(b"".join(number(strings.of(k)) + number(strings.of(v)) for k, v in t.items()) + number(0) for *_, t in nodes)
        body = field(1, steps([i for i, *_ in nodes])) + field(8, steps([a - offset for _, a, _, _ in nodes])) + field(9, steps([o - offset for _, _, o, _ in nodes]))
        group += field(2, body + (field(10, flat) if flat else b""))
    elif nodes:
        for i, a, o, t in nodes:
            k, v = strings.pairs(t)
            group += field(1, number(1 << 3) + zigzag(i) + (field(2, k) + field(3, v) if t else b"") + number(8 << 3) + zigzag(a - offset) + number(9 << 3) + zigzag(o - offset))
    for i, refs, t in ways:
        k, v = strings.pairs(t)
        group += field(3, field(1, i) + field(2, k) + field(3, v) + field(4, field(1, 7)) + field(8, steps(refs)))
    for i, members, t in relations:
        k, v = strings.pairs(t)
        roles = b"".join(number(strings.of(r)) for _, _, r in members)
        group += field(4, field(1, i) + field(2, k) + field(3, v) + field(8, roles) + field(9, steps([m for _, m, _ in members])) + field(10, b"".join(number("nwr".index(x)) for x, _, _ in members)))
    table = field(1, b"".join(field(1, s.encode()) for s in strings.at))
    return table + field(2, group) + (field(17, 100) + field(19, offset * 100) + field(20, offset * 100) if offset else b"")


def blob(body, kind=b"OSMData", packed=True):
    data = field(2, len(body)) + field(3, zlib.compress(body)) if packed else field(1, body)
    head = field(1, kind) + field(3, len(data))
    return len(head).to_bytes(4, "big") + head + data


KINDS = [{"amenity": "cafe"}, {"amenity": "bank"}, {"tourism": "museum"}, {"shop": "supermarket", "brand": "ドン・キホーテ"}, {"shop": "supermarket"}, {"historic": "yes"}, {"railway": "station", "operator": "JR"}, {}, {"leisure": "park"}, {"natural": "tree"}]


def made(seed, first):
    """(nodes, ways, relations) with ids from `first` on."""
    draw = random.Random(seed)
    tags = lambda i: draw.choice(KINDS) | draw.choice([{}, {"name": f"n{i}", "name:en": "x"}])
    nodes = [(first + i * 3, 350_000_000 + draw.randrange(-9_000_000, 9_000_000), draw.choice([1, -1]) * 1_390_000_000 + i, tags(i)) for i in range(700)]
    ids = [n[0] for n in nodes]
    ways = [(first + i, [draw.choice(ids) for _ in range(draw.randrange(1, 9))], tags(i)) for i in range(150)]
    ways += [(first + 1_000, [5], {"amenity": "cafe"}), (first + 1_001, [], {"amenity": "cafe"}), (first + 1_002, [ids[0], 5, ids[1]], {"amenity": "bar"})]
    # areas: one ring of a closed way, one of three ways that hang together, two rings, one that doesn't close
    rings = {2_000: [ids[10], ids[11], ids[12], ids[10]], 2_001: [ids[20], ids[21], ids[22]], 2_002: [ids[30], ids[31], ids[22]], 2_003: [ids[30], ids[20]], 2_004: [ids[40], ids[41], ids[42], ids[43], ids[40]]}
    ways += [(first + i, refs, {}) for i, refs in rings.items()]
    w = lambda *ns: [("w", first + n, "outer") for n in ns]
    park = {"leisure": "park", "type": "multipolygon"}
    relations = [
        (first + 1, w(2_000), park | {"name": "one"}), (first + 2, [*w(2_001, 2_002, 2_003), ("w", first + 2_004, "inner"), ("n", ids[0], "label")], park), (first + 3, w(2_000, 2_004), {"historic": "castle", "type": "boundary"}),
        (first + 4, w(2_001, 2_002), park), (first + 5, w(2_000), {"leisure": "park", "type": "route"}), (first + 6, [("w", first + 2_004, "")], park), (first + 7, w(2_000), {"type": "multipolygon"}),
    ]
    return nodes, ways, relations


def written(path, nodes, ways, relations, dense=True, packed=True):
    parts = [blob(field(4, b"OsmSchema-V0.6"), b"OSMHeader")]
    parts += [blob(block(nodes[i : i + 100], dense=dense, offset=i % 3 * 50), packed=packed) for i in range(0, len(nodes), 100)]
    parts += [blob(block(ways=ways[i : i + 40])) for i in range(0, len(ways), 40)]
    parts += [blob(block(relations=relations), packed=packed)]
    path.write_bytes(b"".join(parts))
    return len(parts) - 1


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("maps")
    first, second = made(1, 10), made(2, 100_000)
    again = [(n[0], n[1] + 77, n[2], {"amenity": "pub", "name": "later"}) for n in first[0][:5]]  # objects of the first file
    written(out / "a.osm.pbf", *first)
    written(out / "b.osm.pbf", [*again, *second[0]], *second[1:], dense=False, packed=False)
    (out / "readme.txt").write_text("not a map")
    return out, [first, ([*again, *second[0]], *second[1:])]


def plainly(files, wanted, kinds="nw"):
    """{osm_id: (tags, lat, lon)} by walking over the objects one by one."""
    out = {}
    for nodes, ways, relations in files:
        place = {i: (a, o) for i, a, o, _ in nodes}
        mean = lambda pts: (sum(a for a, _ in pts) / len(pts) / 1e7, sum(o for _, o in pts) / len(pts) / 1e7)
        out |= {f"n{i}": (t, *mean([(a, o)])) for i, a, o, t in nodes if wanted(t)}
        if "w" in kinds:
            for i, refs, t in ways:
                pts = [place[r] for r in refs if r in place]
                if wanted(t) and pts:
                    out[f"w{i}"] = (t, *mean(pts))
        if "r" in kinds:
            refs_of = {i: refs for i, refs, _ in ways}
            for i, members, t in relations:
                if not wanted(t) or t["type"] not in ("multipolygon", "boundary"):
                    continue
                left = [list(refs_of[m]) for k, m, role in members if k == "w" and role in ("outer", "")]
                pts, whole = [], True
                while left and whole:
                    ring = left.pop(0)
                    while ring[0] != ring[-1]:
                        more = next((x for x in left if ring[-1] in (x[0], x[-1])), None)
                        if more is None:
                            whole = False
                            break
                        left.remove(more)
                        ring += more[1:] if more[0] == ring[-1] else more[-2::-1]
                    points = [place[r] for r in ring[:-1]]
                    pts += [*points, min(points, key=lambda p: (p[1], p[0]))]
                if whole:
                    out[f"r{i}"] = (t, *mean(pts))
    return out


def read(df):
    return {r.osm_id: (dict(r.tags), r.lat, r.lon) for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for k, (t, lat, lon) in want.items():
        assert got[k][0] == t and got[k][1:] == (pytest.approx(lat, abs=1e-12), pytest.approx(lon, abs=1e-12))


def sight(t):
    name = t.get("name", "") + t.get("brand", "")
    return any(k in t and (not v or t[k] in v) for k, v in mapfile.SIGHTS.items()) or (t.get("shop") == "supermarket" and "ドン・キホーテ" in name)


@pytest.mark.parametrize("run_bytes", [1, 3_000, mapfile.RUN_BYTES])
def test_three_scans_equal_a_plain_walk(spark, folder, run_bytes):
    path, files = folder
    found = mapfile.eateries(spark, str(path), run_bytes=run_bytes)
    same(read(found), plainly(files, lambda t: t.get("amenity") in mapfile.EATERIES))
    assert {r.osm_id: dict(r.name) for r in found.collect()}["n10"] == {"name": "later"}
    want = plainly(files, sight, "nwr")
    assert collections.Counter(k[0] for k in want)["r"] == 8
    same(read(mapfile.sights(spark, str(path), run_bytes=run_bytes)), want)
    stops = {r.osm_id: (r.operator, r.lat, r.lon, r.name["name"]) for r in mapfile.stations(spark, str(path), run_bytes=run_bytes).collect()}
    assert stops == {k: ("JR", a, o, t["name"]) for k, (t, a, o) in plainly(files, lambda t: t.get("railway") == "station" and "name" in t, "n").items()} and len(stops) > 20


def test_a_task_has_a_run_of_blobs(spark, folder):
    path, files = folder
    blobs = 2 * (8 + 1) + 2  # nodes, ways and relations of two files; the second has a block of nodes more
    assert mapfile.objects(spark, str(path), run_bytes=1).rdd.getNumPartitions() >= blobs
    whole = mapfile.objects(spark, str(path))
    assert whole.rdd.getNumPartitions() == 2
    counts = {(r.file, r.kind): r.n for r in whole.groupBy("file", "kind").agg(F.count("*").alias("n")).collect()}
    assert counts == {(f, k): len(x) for f, xs in enumerate(files) for k, x in zip("nwr", xs)}
    covered = mapfile.runs(0, str(path / "a.osm.pbf"), 2_000)
    assert all(r.size <= 2_000 for r in covered) and sum(r.size for r in covered) < (path / "a.osm.pbf").stat().st_size  # all but the header
    keyed = mapfile.objects(spark, str(path), kinds="n", keys=["railway"])
    assert keyed.count() == sum("railway" in t for nodes, _, _ in files for *_, t in nodes)
    refs = {r.id: list(r.refs) for r in mapfile.objects(spark, str(path / "a.osm.pbf"), kinds="w").collect()}
    assert refs == {i: r for i, r, _ in files[0][1]}
    members = {r.id: [(m.kind, m.id, m.role) for m in r.members] for r in mapfile.objects(spark, str(path / "a.osm.pbf"), kinds="r").collect()}
    assert members == {i: m for i, m, _ in files[0][2]}


def test_empty_files_and_unknown_packing(spark, tmp_path):
    (tmp_path / "a.osm.pbf").write_bytes(b"")
    (tmp_path / "b.osm.pbf").write_bytes(blob(field(4, b"x"), b"OSMHeader"))
    assert mapfile.sights(spark, str(tmp_path)).count() == 0
    with pytest.raises(ValueError, match="zlib"):
        mapfile.inflated(field(4, b"lzma"))


def test_packed_numbers():
    values = [0, 1, 127, 128, 300, 1 << 31, (1 << 63) - 1]
    assert mapfile.varints(b"".join(map(number, values))).tolist() == values
    moves = [5, -7, 0, 1 << 40, -(1 << 40)]
    assert mapfile.signed(mapfile.varints(b"".join(map(zigzag, moves)))).tolist() == moves
    assert mapfile.deltas(steps(moves)).tolist() == moves and mapfile.deltas(b"").tolist() == []
    assert isinstance(mapfile.varints(b""), np.ndarray)
