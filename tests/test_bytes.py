"""Facts of raw images from their bytes, whatever the cut into chunks."""

import random
import re

import pytest

from argusframe.operators import carving, signatures

HEADER = b"\x82\x80\x01\x00\x80\x07\x38\x04\x10\x00\x00\x00" + b"\x09" * 8


def image(seed, n=4000):
    rng = random.Random(seed)
    parts = [
        b"DHAV", b"\x00\x00\x00\x01", b"\x00\x00\x00\x01\x40", b"\x00\x00\x01\xfd", HEADER,
        b"\x02" + HEADER[1:], HEADER[:8] + b"\x00" * 12, HEADER[:8] + b"\xff" * 12, HEADER[:11], b"\x00" * 9,
        b"\x00\x00\x01\xba", b"text",
    ]
    out = b""
    while len(out) < n:
        out += rng.choice(parts) + bytes(rng.choices(range(256), k=rng.randrange(12)))
    return out


def chunks(spark, images, size, overlap):
    rows = [
        (i, len(x), at, bytearray(x[at : at + size + overlap]))
        for i, x in enumerate(images) for at in range(0, max(len(x), 1), size)
    ]
    return spark.createDataFrame(rows, "evidence_id long, size long, base_offset long, bytes binary").repartition(3)


@pytest.mark.parametrize("size", [7, 64, 1000, 10**6])
def test_marker_facts_do_not_depend_on_chunks(spark, size):
    images = [image(i) for i in range(4)] + [b"", b"DHA"]
    got = {r["evidence_id"]: r for r in signatures.marker_facts(chunks(spark, images, size, 20), size).collect()}
    for i, x in enumerate(images):
        headers = [m for m in re.finditer(rb"(?=[\x82\x02]\x80\x01\x00.{4}(.{4}).{8})", x, re.S)]
        want = {
            "dhav_frames": x.count(b"DHAV"), "nal_starts": len(re.findall(rb"(?=\x00\x00\x00\x01)", x)),
            "xm_markers": x.count(b"\x00\x00\x01\xfd"), "vps_markers": x.count(b"\x00\x00\x00\x01\x40"),
            "nal_headers": sum(0 < int.from_bytes(m[1], "little") <= 100 << 20 for m in headers),
        }
        assert {k: got[i][k] for k in want} == want
        assert got[i]["carved_streams"] == want["nal_starts"]


@pytest.mark.parametrize("size, head", [(100, 256), (300, 200), (256, 256), (10**6, 100)])
def test_block_facts_do_not_depend_on_chunks(spark, size, head):
    images = [image(10 + i) + b"\x00" * 700 + b"\x00\x00\x01\xba" for i in range(4)]
    mark = b"\x00\x00\x01\xba"
    got = carving.block_facts(chunks(spark, images, size, 8), 256, mark, size, head=head).collect()
    want = []
    for i, x in enumerate(images):
        for at in range(0, len(x), 256):
            part = x[at : at + min(256, head)]
            if mark in part:
                want.append((i, at, part.count(0) / len(part), at + part.find(mark)))
    assert sorted((r["evidence_id"], r["offset"], r["zero_share"], r["first_pack"]) for r in got) == sorted(want)
