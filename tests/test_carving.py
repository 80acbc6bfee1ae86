import datetime as dt
import random
import struct

import pytest
from pyspark.sql import functions as F

from argusframe.functions import scalars as S
from argusframe.operators import carving as K, signatures as G
from argusframe.sources import readers as R


def box(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", 8 + len(body)) + kind + body


def images():
    rng = random.Random(4)
    filler = lambda n: bytes(rng.choice(b"\x11\x22\x33\x55\x77") for _ in range(n))
    mp4 = box(b"ftyp", b"isom" + b"\x00\x00\x02\x00") + box(b"mdat", filler(900))
    tag = b"\x09" + (700).to_bytes(3, "big") + b"\x01" * 7 + filler(700)
    flv = b"FLV\x01\x05\x00\x00\x00\x09" + b"\x00" * 4 + tag + b"\x00\x00\x02\xc7" + tag
    avi = b"RIFF" + struct.pack("<I", 2000) + b"AVI " + filler(1996)
    packs = (b"\x00\x00\x01\xba" + filler(300)) * 7
    few = (b"\x00\x00\x01\xba" + filler(300)) * 4
    nal = b"\x00\x00\x00\x01\x67" + filler(20) + (b"\x00\x00\x00\x01\x65" + filler(60)) * 11
    pad = b"\xb9" * 64
    out = []
    for i, (name, body) in enumerate(
        [("mp4", mp4), ("flv", flv), ("avi", avi), ("mpeg_ps", packs), (None, few), ("h264", nal)]
    ):
        head = filler(1000 + 37 * i)
        data = head + body + pad + filler(3000)
        start = len(head)
        if name in ("mp4", "flv", "avi"):
            end = start + len(body)
        elif name == "mpeg_ps":
            end = min(len(data), start + body.rfind(b"\x00\x00\x01\xba") + 2048)
        elif name == "h264":
            end = min(len(data), start + body.rfind(b"\x00\x00\x00\x01") + 65536)
        out.append((i, data, (name, start, end)))
    return out


def test_carved_streams_have_the_known_bounds(spark):
    made = images()
    df = spark.createDataFrame([(i, bytearray(d)) for i, d, _ in made], "evidence_id BIGINT, content BINARY")
    for chunk in (512, 100_000):
        hits = K.scan_markers(R.text_chunks(df, "content", chunk, 64), chunk=chunk)
        got = {r.evidence_id: (r.stream_type, r.start_offset, r.end_offset) for r in K.carve_streams(hits, df, 4096).collect()}
        assert got == {i: want for i, _, want in made if want[0]}


def test_chunk_borders_neither_lose_nor_repeat_markers(spark):
    rng = random.Random(9)
    data = bytes(rng.choice(b"RIFDHAV\x00\x01\xba") for _ in range(20_000))
    df = spark.createDataFrame([(1, bytearray(data))], "evidence_id BIGINT, content BINARY")
    want = sorted((k, i) for k, m in K.MARKERS.items() for i in range(len(data)) if data.startswith(m, i))
    got = K.scan_markers(R.text_chunks(df, "content", 97, 64), chunk=97)
    assert sorted((r.kind, r.offset) for r in got.collect()) == want


def test_files_are_read_in_chunks_and_walked(spark, tmp_path):
    _, data, want = images()[0]
    path = tmp_path / "disk.dd"
    path.write_bytes(data)
    chunks = R.image_chunks(spark, str(tmp_path), chunk=700, overlap=64, glob="*.dd")
    assert chunks.count() == -(-len(data) // 700)
    hits = K.scan_markers(chunks.withColumn("evidence_id", F.lit(0).cast("bigint")), chunk=700)
    sources = spark.createDataFrame([(0, str(path))], "evidence_id BIGINT, path STRING")
    rows = K.carve_streams(hits, sources).collect()
    assert [(r.stream_type, r.start_offset, r.end_offset) for r in rows] == [want]


def test_index_pages_are_followed_through_the_file(spark, tmp_path):
    def entry(ch, start, stop, off, has=0):
        e = bytearray(48)
        struct.pack_into("<Q", e, 8, has)
        e[0x11] = ch
        struct.pack_into("<IIQ", e, 0x18, start, stop, off)
        return bytes(e)

    img = bytearray(40_000)
    img[0x210:0x222] = b"HIKVISION@HANGZHOU"
    img[0x230:0x23E] = b"HIK.2011.03.08"
    struct.pack_into("<QIQ", img, 0x288, 1 << 20, 3, 0x1000)
    struct.pack_into("<I", img, 0x290, 3)
    struct.pack_into("<Q", img, 0x298, 0x1000)
    img[0x1010:0x1018] = b"HIKBTREE"
    struct.pack_into("<Q", img, 0x1058, 0x2000)
    for page, nxt, entries in (
        (0x2000, 0x4000, [entry(1, 1_700_000_000, 1_700_000_060, 0x100000), entry(2, 5, 6, 7, has=9)]),
        (0x4000, 0xFFFFFFFFFFFFFFFF, [entry(3, 0x7FFFFFFF, 0, 0x300000)]),
    ):
        struct.pack_into("<I", img, page + 0x10, len(entries))
        struct.pack_into("<Q", img, page + 0x20, nxt)
        body = b"".join(entries)
        img[page + 0x60 : page + 0x60 + len(body)] = body
    path = tmp_path / "a.img"
    path.write_bytes(bytes(img))
    df = spark.createDataFrame([(1, str(path), bytearray(img[:4096]))], "evidence_id BIGINT, path STRING, head BINARY")
    master = K.master_block(df).join(df.select("evidence_id", "path"), "evidence_id")
    assert master.collect()[0].size_data_block == 1 << 20
    got = K.decode_index_entries(K.index_pages(master)).orderBy("channel").collect()
    assert [(r.channel, r.recovery_status, r.offset_datablock) for r in got] == [
        (1, "ORIGINAL", 0x100000), (3, "PARTIAL", 0x300000),
    ]
    assert got[0].start_time == dt.datetime.fromtimestamp(1_700_000_000, dt.UTC).replace(tzinfo=None)


@pytest.mark.parametrize("blob", [b"", b"\x00" * 20, bytes(range(256)) * 4, b"DHFS4"])
def test_hostile_blobs_match_no_rule(spark, blob):
    df = spark.createDataFrame([(1, ".xyz", len(blob), bytearray(blob))], "evidence_id BIGINT, extension STRING, size BIGINT, head BINARY")
    rows = G.detect_vendors(df).collect()
    assert len(rows) == len(G.VENDORS) and not any(r.matched for r in rows)


def test_superblock_wins_and_later_vendors_are_skipped(spark):
    head = bytearray(0x360)
    head[0x210:0x222] = b"HIKVISION@HANGZHOU"
    df = spark.createDataFrame([(1, ".mp4", 0x360, head)], "evidence_id BIGINT, extension STRING, size BIGINT, head BINARY")
    rows = {r.vendor: r for r in G.detect_vendors(df).collect()}
    assert rows["hikvision"].is_best and rows["generic"].matched
    assert rows["generic"].skipped and not rows["hikvision"].skipped


def test_short_and_long_markers_against_brute_force(spark):
    rng = random.Random(2)
    words = ["aa", "b", "cc", "ddd", "e"]
    docs = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    marks = [d[3 : 3 + rng.randint(2, 30)] for d in docs if len(d) > 8]
    want = {(i, j) for i, d in enumerate(docs) for j, m in enumerate(marks) if m in d}
    t = spark.createDataFrame(list(enumerate(docs)), "text_id BIGINT, text STRING")
    m = spark.createDataFrame(list(enumerate(marks)), "marker_id BIGINT, marker STRING")
    assert {(r.text_id, r.marker_id) for r in G.marker_matches(t, m).collect()} == want


def test_container_timestamps(spark):
    rows = [
        ("mp4", "creation_time", "2026-03-05T10:11:12.000000Z"),
        ("mkv", "CREATION_TIME", "2026-03-05 10:11:12"),
        ("avi", "IDIT", "Thu Mar 05 10:11:12 2026"),
        ("mp4", "creation_time", "2026-03-05T12:11:12+02:00"),
        ("mp4", "date", "2026-03-05T10:11:12Z"),
        ("flv", "creation_time", "2026-03-05T10:11:12Z"),
        ("mp4", "creation_time", "1970-01-01T00:00:00Z"),
        ("mp4", "creation_time", "2001-01-01T00:00:00Z"),
        ("mp4", "creation_time", "1999-05-01T00:00:00Z"),
        ("mp4", "creation_time", "2199-05-01T00:00:00Z"),
        ("mp4", "creation_time", "not a time"),
        ("mp4", "creation_time", None),
    ]
    df = spark.createDataFrame(rows, "s STRING, t STRING, v STRING")
    now = F.lit("2026-06-01 00:00:00").cast("timestamp")
    got = [r[0] for r in df.select(K.container_timestamp(F.col("s"), F.col("t"), F.col("v"), now)).collect()]
    assert got == [dt.datetime(2026, 3, 5, 10, 11, 12)] * 4 + [None] * 8


def test_fixed_decimals_round_the_binary_value(spark):
    values = [0.05, 0.15, 0.25, 0.35, 17.25, 17.75, 1.005, 2.5, 1023.95, 86417.25, 0.0, 1e7 + 0.05]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    got = df.select(S.fixed(F.col("v")), S.fixed(F.col("v"), 2)).collect()
    assert [tuple(r) for r in got] == [(f"{v:.1f}", f"{v:.2f}") for v in values]


def test_rates_and_packed_dates(spark):
    df = spark.createDataFrame([("25",), ("30000/1001",), ("0/0",), ("N/A",), ("5/0",), ("",)], "r STRING")
    got = [r[0] for r in df.select(S.parse_rate(F.col("r"))).collect()]
    assert got == [25.0, 30000 / 1001, None, None, None, None]
    bits = (26 << 26) | (2 << 22) | (29 << 17) | (1 << 12)
    ok = (26 << 26) | (2 << 22) | (28 << 17) | (23 << 12) | (59 << 6) | 58
    dates = spark.createDataFrame([(0,), (bits,), (ok,)], "b BIGINT").select(S.packed_date(F.col("b"))).collect()
    assert [r[0] for r in dates] == [None, None, dt.datetime(2026, 2, 28, 23, 59, 58)]


def plain(data):
    return lambda o, n: bytes(data[o : o + n])


def test_container_walks_end_inside_the_image():
    from argusframe.operators import containers as C

    ftyp = b"\x00\x00\x00\x14ftypisom" + b"\x00" * 8
    for tail, end in [
        (b"\x00\x00\x00\x01" + b"mdat" + b"\xff" * 8 + b"x" * 600, 20),  # 64-bit length beyond the image
        (b"\x00\x00\x00\x01" + b"mdat" + b"\x00" * 8 + b"x" * 600, 20),  # 64-bit length of nothing
        (b"\x00\x00\x00\x01" + b"\x67\x42\x00\x1f" + b"x" * 700, 20),  # a start code, not a box
        (b"\x00\x00\x00\x01" + b"mdat" + (600).to_bytes(8, "big") + b"x" * 700, 620),
        (b"\x00" * 4 + b"mdat" + b"x" * 90, 20),
        (b"\x00\x00\x03\xe8mdat" + b"x" * 50, 20),  # cut off
    ]:
        data = ftyp + tail
        assert C.extent("mp4", plain(data), 4, len(data))[:2] == (0, end)
    whole = b"\x00\x00\x00\x00ftypisom" + b"x" * 50
    assert C.extent("mp4", plain(whole), 4, len(whole)) == (0, len(whole), 1)
    for told in (0, 5, 1 << 31):
        flv = b"FLV\x01\x05" + told.to_bytes(4, "big") + b"\x00" * 4 + b"\x09\x00\x00\x04" + b"x" * 11
        assert C.extent("flv", plain(flv), 0, len(flv)) == (0, 0, 0)


def test_matroska_is_walked_by_its_own_lengths():
    from argusframe.operators import containers as C

    def element(name, body, wide=8):
        return name + ((1 << 7 * wide) + len(body)).to_bytes(wide, "big") + body

    header = element(b"\x1a\x45\xdf\xa3", b"\x42\x86\x81\x01", 1)
    block = element(b"\xa3", b"b" * 3000, 2)
    cluster = element(b"\x1f\x43\xb6\x75", element(b"\xe7", b"\x01", 1) + block * 5)
    long = header + element(b"\x18\x53\x80\x67", cluster * 900)  # over 13 MB
    assert C.extent("mkv", plain(long + b"junk" * 100), 0, len(long) + 400)[1] == len(long)
    endless = header + b"\x18\x53\x80\x67\x01" + b"\xff" * 7 + cluster * 3
    live = endless + b"\x1f\x43\xb6\x75\x01" + b"\xff" * 7 + element(b"\xe7", b"\x02", 1) + block
    assert C.extent("mkv", plain(live + b"\x00" * 50), 0, len(live) + 50)[1] == len(live)
    window = C.Window(plain(long), 64)
    assert C.extent("mkv", window, 0, len(long))[1] == len(long)
    cut = long[: len(long) // 2]
    assert C.extent("mkv", plain(cut), 0, len(cut))[1] == len(cut)


def index_image(tmp_path, links):
    """An image whose index chain visits the given pages."""
    img = bytearray(0x1000 * (max(links) + 2))
    img[0x110:0x118] = b"HIKBTREE"
    struct.pack_into("<Q", img, 0x158, 0x1000 * links[0])
    for a, b in zip(links, [*links[1:], None]):
        struct.pack_into("<I", img, 0x1000 * a + 0x10, 1)
        struct.pack_into("<Q", img, 0x1000 * a + 0x20, 0xFFFFFFFFFFFFFFFF if b is None else 0x1000 * b)
    path = tmp_path / "chain.img"
    path.write_bytes(bytes(img))
    return str(path)


def test_index_chains_are_followed_to_their_end(spark, tmp_path):
    def walked(links):
        df = spark.createDataFrame([(1, index_image(tmp_path, links), 0x100)], "evidence_id BIGINT, path STRING, offset_index BIGINT")
        return [(r.page, r.status) for r in K.index_pages(df).orderBy("page").collect()]

    assert walked(list(range(1, 151))) == [(i, "page") for i in range(150)]
    path = index_image(tmp_path, [1, 2, 3])
    with open(path, "r+b") as f:  # the third page leads back to the second
        f.seek(0x3020)
        f.write(struct.pack("<Q", 0x2000))
    df = spark.createDataFrame([(1, path, 0x100)], "evidence_id BIGINT, path STRING, offset_index BIGINT")
    got = [(r.page, r.status) for r in K.index_pages(df).orderBy("page").collect()]
    assert got == [(0, "page"), (1, "page"), (2, "page"), (3, "cycle")]


def test_every_marker_is_a_recording(spark):
    hits = spark.createDataFrame([(1, 100_000, 100 * i) for i in range(60)], "evidence_id BIGINT, size BIGINT, offset BIGINT")
    got = K.marker_recordings(hits, slice_bytes=700).orderBy("offset").collect()
    assert [r.segment_index for r in got] == list(range(60))


def test_detection_files_of_both_layouts(spark, tmp_path):
    import json

    from pyspark.sql import functions as F

    from argusframe.sources import readers

    rows = [{"timestamp_seconds": i, "bbox": [1, 2, 3, 4], "frame_number": i, "class_name": "car", "confidence": 0.5, "track_id": 1} for i in range(3)]
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "list.json").write_text(json.dumps(rows, indent=1))
    start = F.lit("2026-01-01 00:00:00").cast("timestamp")
    for layout in ("lines", "list"):
        got = readers.detection_files(spark, str(tmp_path / f"{layout}.json"), start, layout)
        assert sorted(r.frame_number for r in got.collect()) == [0, 1, 2]


def test_blocks_are_read_once_whatever_the_recordings(spark):
    recordings = spark.createDataFrame(
        [(1, i, o) for i, o in enumerate((0, 0, 7, 8, 9, None))] + [(2, 6, 0), (None, 7, 0)],
        "evidence_id BIGINT, recording_identifier INT, offset_datablock BIGINT",
    )
    blocks = spark.createDataFrame(
        [(1, 0, b"..PACK"), (1, 7, bytes(9)), (1, 8, b"..pack"), (1, 9, b"PACK"), (1, 9, b"PACK"), (1, 9, b"no"), (2, 0, None), (1, None, b"PACK")],
        "evidence_id BIGINT, offset_datablock BIGINT, block BINARY",
    )
    found = K.block_triage(recordings, blocks, F.lit(b"PACK"))
    got = sorted((r.recording_identifier, r.recovery_status, r.reason) for r in found.collect())
    good, none, bare = ("ORIGINAL", None), ("PARTIAL", "data block empty"), ("PARTIAL", "no pack marker")
    want = [(0, *good), (1, *good), (2, *none), (3, *bare), (4, *good), (4, *good), (4, *bare)]
    want += [(5, "PARTIAL", "missing block offset"), (6, *none), (7, *none)]
    assert sorted(got, key=str) == sorted(want, key=str)
    # the blocks are judged before the join, not once a recording
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "contains(" in plan and "contains(" not in plan.split("join leftouter")[0]


def test_nal_headers_are_read_in_one_place(spark):
    def header(kind=0x82, magic="800100", length=7, us=1704067200000000, more=b""):
        return bytes([kind]) + bytes.fromhex(magic) + b"\x80\x07\x38\x04" + length.to_bytes(4, "little") + us.to_bytes(8, "little") + more

    good = [header(), header(2, us=5), header(more=b"x"), header(us=1 << 60), header(length=100 << 20)]
    bad = [header(0x99), header(magic="800101"), header(length=0), header(length=(100 << 20) + 1), header()[:19], None]
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(good + bad)], "n INT, header BINARY")
    found = K.decode_nal_header(rows)
    got = sorted((r.n, r.frame_type, r.width, r.height, r.nal_len, r.timestamp is not None) for r in found.collect())
    assert got == [
        (0, 0x82, 1920, 1080, 7, True), (1, 2, 1920, 1080, 7, False), (2, 0x82, 1920, 1080, 7, True),
        (3, 0x82, 1920, 1080, 7, False), (4, 0x82, 1920, 1080, 100 << 20, True),
    ]
    assert "conv(" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_scans_of_texts_pass_rows_on_in_bounded_parts(spark, monkeypatch):
    text = "<p>" * (2 * K.PART_ROWS + 5)
    rows = spark.createDataFrame([(1, text), (2, None), (3, "x<p>")], "evidence_id BIGINT, content STRING").coalesce(1)
    sizes = K.text_markers(rows, "content", {"open": "<p>"}).mapInArrow(
        lambda batches: (b.select(["offset"]).slice(0, 1) for b in batches), "offset BIGINT"
    )
    assert K.text_markers(rows, "content", {"open": "<p>"}).count() == 2 * K.PART_ROWS + 6
    assert sizes.count() >= 3
    found = ((1, i) for i in range(K.PART_ROWS + 1))
    import pyarrow as pa
    assert [b.num_rows for b in K._parts(found, ["a", "b"], [pa.int64(), pa.int64()])] == [K.PART_ROWS, 1]
