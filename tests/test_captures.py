"""Capture files read by ranges, against a plain reader of whole files."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from loomgraph.sources import pcap


def plain(content: bytes):
    """(timestamp, index, data, link type) of the packets, one after another."""
    order = "<" if content[:4] in (b"\xd4\xc3\xb2\xa1", b"\x4d\x3c\xb2\xa1") else ">"
    magic, limit, link = (struct.unpack_from(order + "I", content, k)[0] for k in (0, 16, 20))
    out, at = [], 24
    while at + 16 <= len(content):
        seconds, part, length, whole = struct.unpack_from(order + "4I", content, at)
        if at + 16 + length > len(content) or length > whole or limit and length > limit:
            break
        out.append((seconds * 1000 + part // (1000 if magic == 0xA1B2C3D4 else 1_000_000), len(out), content[at + 16 : at + 16 + length], link))
        at += 16 + length
    return out


def capture(rows, order="<", magic=0xA1B2C3D4, limit=262_144, link=1):
    return struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, limit, link) + b"".join(struct.pack(order + "IIII", s, p, len(d), whole or len(d)) + d for s, p, d, whole in rows)


def kinds():
    rng = random.Random(10)
    noise = lambda n: [(rng.randrange(1 << 31), rng.randrange(10**6), rng.randbytes(rng.choice((0, 1, 14, 60, 300))), 0) for _ in range(n)]
    inner = capture(noise(40))[24:]  # a packet that holds a capture: its heads look like packets and aren't
    files = {
        "noise": capture(noise(120)),
        "big-endian nano": capture(noise(90), ">", 0xA1B23C4D, link=113),
        "captures inside": capture([r for k in range(6) for r in (*noise(3), (5, 6, b"\x07" * k + inner, 0))]),
        "zeros": capture([(1, 0, bytes(n), 0) for n in (500, 0, 0, 3000, 20)]),
        "one large": capture([(9, 9, rng.randbytes(20_000), 0), *noise(5)]),
        "cut": capture(noise(70))[:-3],
        "cut head": capture(noise(30)) + b"\x01" * 15,
        "over the limit": capture([*noise(20), (1, 1, bytes(301), 0), *noise(20)], limit=300),
        "more than was": capture([*noise(20), (1, 1, bytes(50), 49), *noise(20)]),
        "no limit": capture(noise(50), limit=0),
        "header alone": capture([]),
        "nothing": b"",
    }
    return files


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("captures with spaces")
    for name, content in kinds().items():
        (top / f"{name}.pcap").write_bytes(content)
    return top


@pytest.mark.parametrize("split", [700, pcap.SPLIT])
def test_ranges_equal_whole_files(spark, folder, split):
    got = {}
    for r in pcap.read(spark, str(folder), split).collect():
        got.setdefault(r["path"].rsplit("/", 1)[1][:-5], []).append((r["timestamp"], r["index"], bytes(r["data"]), r["link_type"]))
    expected = {name: plain(content) for name, content in kinds().items() if content}
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items() if v}
    assert len(got) == 10 and all(len(v) > 4 for v in got.values())


def test_wrong_guesses_are_walked_again(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(kinds()["captures inside"])
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "length")
    ranges = pcap._listing(files, 400)
    first = pcap._walked(ranges.withColumn("start", F.when(F.col("begin") == 0, F.lit(24).cast("long"))), 400).orderBy("begin").collect()
    assert any(b["start"] is not None and b["start"] != a["stop"] for a, b in zip(first, first[1:]))  # heads inside of packets were taken
    last = pcap._synchronised(ranges, 400).orderBy("begin").collect()
    assert all(a["stop"] == b["start"] for a, b in zip(last, last[1:])) and last[-1]["stop"] == last[-1]["size"]


def test_guesses_are_right_for_plain_captures(spark, tmp_path):
    rng = random.Random(2)
    rows = [(1_700_000_000 + k // 50, k * 97 % 10**6, rng.randbytes(rng.randrange(60, 1500)), 0) for k in range(3000)]
    (tmp_path / "a.pcap").write_bytes(capture(rows))
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "length")
    found = pcap._walked(pcap._listing(files, 100_000).withColumn("start", F.when(F.col("begin") == 0, F.lit(24).cast("long"))), 100_000).orderBy("begin").collect()
    assert len(found) > 20 and all(a["stop"] == b["start"] for a, b in zip(found, found[1:])) and sum(r["packets"] for r in found) == 3000


def test_not_a_capture(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(b"something else that is long enough")
    with pytest.raises(Exception, match="not a capture file"):
        pcap.read(spark, str(tmp_path)).collect()


def test_saved_files_come_back(spark, tmp_path):
    raw = spark.range(3000).selectExpr("id * 7 % 1000 as timestamp", "cast(concat('packet ', id) as binary) as data", "if(id % 3 = 0, 113, 1) as link_type").repartition(3, "timestamp")
    for link in (1, 113):
        told = pcap.save(raw, f"file://{tmp_path}/{link}", link, size=9000)
        assert told.count() > 3 and told.filter("length < 9000").count() <= 3
        back = pcap.read(spark, f"{tmp_path}/{link}", 2000)
        assert sorted(map(tuple, back.select("timestamp", "data", "link_type").collect())) == sorted(map(tuple, raw.filter(F.col("link_type") == link).select("timestamp", "data", "link_type").collect()))
        assert back.count() == told.agg(F.sum("packets")).first()[0]
        again = pcap.save(raw, f"file://{tmp_path}/{link}", link, size=9000)  # the same names
        assert pcap.read(spark, f"{tmp_path}/{link}").count() == again.agg(F.sum("packets")).first()[0]


def test_new_files_come_as_micro_batches(spark, tmp_path):
    files, seen = kinds(), {}
    (tmp_path / "in").mkdir()

    def sink(rows, epoch):
        seen[epoch] = sorted((r["path"].rsplit("/", 1)[1], r["index"]) for r in rows.collect())

    for name in ("noise", "captures inside"):
        (tmp_path / "in" / f"{name}.pcap").write_bytes(files[name])
        pcap.follow(spark, str(tmp_path / "in"), sink, str(tmp_path / "state"), split=500).awaitTermination()
    assert seen == {0: [("noise.pcap", k) for k in range(120)], 1: [("captures inside.pcap", k) for k in range(len(plain(files["captures inside"])))]}
