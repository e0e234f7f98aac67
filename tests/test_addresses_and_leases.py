"""Address look-up files against a walk bit by bit, and leases that let one exporter at a time move a cursor."""

import ipaddress
import json
import random
import struct
import threading

import pytest
from pyspark.sql import functions as F

from locusflow.sources import addresses
from locusflow.streaming import jobs, lease

draw = random.Random(14)


def encoded(value):
    """A value in the format's data section."""

    def head(kind, size):
        more = b""
        if size >= 285:
            more, size = (size - 285).to_bytes(2, "big"), 30
        elif size >= 29:
            more, size = (size - 29).to_bytes(1, "big"), 29
        return (bytes([kind << 5 | size]) if kind < 8 else bytes([size, kind - 7])) + more

    if isinstance(value, bool):
        return head(14, int(value))
    if isinstance(value, str):
        return head(2, len(value.encode())) + value.encode()
    if isinstance(value, dict):
        return head(7, len(value)) + b"".join(encoded(k) + encoded(v) for k, v in value.items())
    if isinstance(value, list):
        return head(11, len(value)) + b"".join(map(encoded, value))
    if isinstance(value, float):
        return head(3, 8) + struct.pack(">d", value)
    body = value.to_bytes((value.bit_length() + 7) // 8, "big") if value >= 0 else value.to_bytes(4, "big", signed=True)
    return head(8 if value < 0 else 6 if len(body) <= 4 else 9, len(body)) + body


def file_of(networks, version, bits):
    """A look-up file of {network: record}; the first record is also met by a pointer."""
    root, depth = [None, None], 32 if version == 4 else 128
    for network, record in networks.items():
        net = ipaddress.ip_network(network)
        path = f"{int(net.network_address):0{net.max_prefixlen}b}"[: net.prefixlen]
        path = "0" * (depth - net.max_prefixlen) + path
        node = root
        for b in path[:-1]:
            node[int(b)] = node[int(b)] if isinstance(node[int(b)], list) else [None, None]
            node = node[int(b)]
        node[int(path[-1])] = json.dumps(record)
    nodes, at = [root], 0
    while at < len(nodes):
        nodes += [x for x in nodes[at] if isinstance(x, list)]
        at += 1
    place = {id(n): i for i, n in enumerate(nodes)}
    data, offset = b"", {}
    for record in dict.fromkeys(x for n in nodes for x in n if isinstance(x, str)):
        offset[record] = len(data)
        data += encoded(json.loads(record))
    pointer = len(data)
    if offset:
        data += bytes([1 << 5, 0])  # a pointer to the beginning
    first = next(iter(offset), None)
    used = [False]

    def number(x):
        if x is None:
            return len(nodes)
        if isinstance(x, list):
            return place[id(x)]
        if x == first and not used[0]:
            used[0] = True
            return len(nodes) + 16 + pointer
        return len(nodes) + 16 + offset[x]

    tree = b""
    for a, b in nodes:
        a, b = number(a), number(b)
        if bits == 28:
            tree += (a & 0xFFFFFF).to_bytes(3, "big") + bytes([(a >> 24) << 4 | b >> 24]) + (b & 0xFFFFFF).to_bytes(3, "big")
        else:
            tree += a.to_bytes(bits // 8, "big") + b.to_bytes(bits // 8, "big")
    meta = {"node_count": len(nodes), "record_size": bits, "ip_version": version, "languages": ["en"], "database_type": "x" * 40}
    return tree + b"\0" * 16 + data + b"\xab\xcd\xefMaxMind.com" + encoded(meta)


def networks(version, n):
    out = {}
    codes = ["JP", "KR", "日本", "US"]
    while len(out) < n:
        wide = version == 6 and draw.random() < 0.5
        length = draw.randrange(2, 60) if wide else draw.randrange(4, 31)
        net = ipaddress.ip_network((draw.getrandbits(127) | 1 << 127 if wide else draw.getrandbits(32), length), strict=False)
        if not any(net.version == ipaddress.ip_network(x).version and net.overlaps(ipaddress.ip_network(x)) for x in out):
            out[str(net)] = {"country": {"iso_code": draw.choice(codes), "n": draw.randrange(70_000)}, "is_x": bool(draw.randrange(2)), "where": [1.5, -7, "a" * draw.randrange(400)]}
    return out


@pytest.mark.parametrize(("version", "bits"), [(4, 24), (4, 28), (6, 32), (6, 28), (6, 24)])
def test_addresses_are_found_as_by_a_walk(spark, tmp_path, version, bits):
    nets = networks(version, 60)
    (tmp_path / "a.mmdb").write_bytes(file_of(nets, version, bits))
    tree = addresses.prefixes(spark, str(tmp_path / "a.mmdb"))
    assert tree.count() == len(nets)
    asked = [None, "", "testclient", "1.2.3", "::1", "255.255.255.255", "fe80::%eth0", " 8.8.8.8 "]
    for x in nets:
        net = ipaddress.ip_network(x)
        asked += [str(net[0]), str(net[-1]), str(net[draw.randrange(min(net.num_addresses, 10**6))])]
        asked += [str(type(net[0])(int(net[-1]) + 1))] if int(net[-1]) + 1 < 2**net.max_prefixlen else []
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(asked * 2)], "id int, ip string").repartition(3)
    got = {r.id: r.record for r in addresses.located(rows, tree, "ip").collect()}
    held = {ipaddress.ip_network(x): r for x, r in nets.items()}
    for i, text in enumerate(asked * 2):
        try:
            address = ipaddress.ip_address((text or "").strip())
            want = next((r for net, r in held.items() if address in net), None)
        except ValueError:
            want = None
        assert (json.loads(got[i]) if got[i] else None) == want
    countries = addresses.located(rows, tree, "ip").select(F.get_json_object("record", "$.country.iso_code").alias("c")).distinct().collect()
    assert {r.c for r in countries} <= {None, "JP", "KR", "日本", "US"}


def test_look_up_files_without_records_or_mark(spark, tmp_path):
    (tmp_path / "e.mmdb").write_bytes(file_of({}, 6, 24))
    tree = addresses.prefixes(spark, str(tmp_path / "e.mmdb"))
    rows = spark.createDataFrame([("1.1.1.1",)], "ip string")
    assert tree.count() == 0 and [tuple(r) for r in addresses.located(rows, tree, "ip").collect()] == [("1.1.1.1", None)]
    with pytest.raises(ValueError, match="mark"):
        addresses.metadata(b"nothing")


def logs(spark, n):
    return spark.range(n).select("id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("created_at"))


def exported(spark, path):
    return sorted(r.id for r in spark.read.json(path).collect())


def test_two_exporters_at_once(spark, tmp_path):
    """One is refused, no row is there twice, and the next run goes on from the cursor."""
    out, state, got = str(tmp_path / "out"), str(tmp_path / "state"), []
    begin = threading.Barrier(2)

    def run():
        begin.wait()
        try:
            got.append(jobs.export_table(logs(spark, 50), out, state, "2023-12-01"))
        except lease.LeaseHeldError:
            got.append("refused")

    both = [threading.Thread(target=run) for _ in range(2)]
    for t in both:
        t.start()
    for t in both:
        t.join()
    assert sorted(map(str, got)) in (["50", "refused"], ["0", "50"]) and exported(spark, out) == list(range(50))  # the second may have come after the first's end
    assert jobs.export_table(logs(spark, 70), out, state, "2023-12-01") == 20 and exported(spark, out) == list(range(70))
    with lease.held(spark, f"{state}/leases"), pytest.raises(lease.LeaseHeldError, match="is held"):
        jobs.export_table(logs(spark, 90), out, state, "2023-12-01")
    assert jobs.export_table(logs(spark, 90), out, state, "2023-12-01") == 20


def test_a_lease_that_ran_out_is_taken_and_its_holder_fenced_off(spark, tmp_path):
    folder = str(tmp_path / "leases")
    with lease.held(spark, folder, seconds=3600) as old:
        assert old.fence == 1 and not lease.Lease(spark, folder, 1).make()
        old.store.setTimes(old._made(1), old.now() - 5_000_000, -1)
        with lease.held(spark, folder, seconds=3600) as new:
            assert new.fence == 2
            new.renew()
            with pytest.raises(lease.LeaseHeldError, match="taken"):
                old.renew()
    with lease.held(spark, folder) as third:
        assert third.fence == 3 and set(third.leases()) == {1, 2, 3}
