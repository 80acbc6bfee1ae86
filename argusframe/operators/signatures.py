"""Recorder detection: which vendor's rule an image satisfies, and marker search in texts.

Rules are data. Each vendor's rules are tried in order, the first that holds gives the
vendor's candidate; candidates of all vendors are kept and the best one is marked. The number
of rules is fixed, so they become one projection and no row leaves its task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial, reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from argusframe.functions.scalars import contains_any

# ---- Fixed values: brand texts by vendor ----
BRANDS = {
    "honeywell": ["Honeywell", "MAXPRO", "HEN", "HRHD", "HRHQ", "HRHT", "HRGX", "Ademco"],
    "matrix": ["Matrix Comsec", "SATATYA", "matrixcomsec.com", "MatrixComsec"],
    "tplink_vigi": [
        "TP-LINK", "TP-Link", "TPLINK", "tplink", "VIGI", "Vigi", "vigi",
        "NVR1004", "NVR2016", "NVR4032",
    ],
    "godrej": ["GODREJ", "SeeThru", "STE-UR", "STE-NVR"],
    "uniview": [
        "Uniview", "UNIVIEW", "uniview", "Uni-View", "UNV", "NVR301", "NVR302", "NVR308",
        "NVR316", "NVR504", "NVR516", "IPC32", "IPC36",
    ],
    "cpplus": ["CPPLUS", "CP-PLUS", "CP PLUS", "aditya infotech", "CP-UVR", "CP-VR", "CP-NVR"],
}
EXACT_CASE = {"tplink_vigi", "uniview"}

# ---- Fixed values: superblock and stream signatures, at their offset ----
HIK_SUPERBLOCK = ("HIKVISION@HANGZHOU", 0x210)
HIK_AT_ZERO = ("HIKVISION@HANGZHOU", 0)
DHFS = ("DHFS4.1", 0)
DHAV = ("DHAV", 0)

# ---- Fixed values: file extensions ----
MATRIX_EXT = [".stm", ".mxs", ".avs"]
MATRIX_OWN_EXT = [".stm", ".mxs"]
MAXPRO_EXT = [".mpvc", ".smpvc"]
RAW_EXT = [".dat", ".bin", ".img", ".dd", ".raw"]
VIDEO_EXT = [".mp4", ".avi", ".mkv", ".mov"]


class Rule(NamedTuple):
    """Conditions that must all hold; None or empty means not asked."""

    confidence: float
    format: str
    magic: tuple[str, int] | None = None
    not_magic: tuple[tuple[str, int], ...] = ()
    brand: str | None = None
    no_brands: tuple[str, ...] = ()
    ext: tuple[str, ...] = ()
    facts: tuple[tuple[str, int], ...] = ()
    none_of: tuple[str, ...] = ()


# ---- Fixed values: vendors in the order they are tried, with their highest confidence ----
OEM_BRANDS = ("tplink_vigi", "cpplus", "godrej")
VENDORS: list[tuple[str, float, list[Rule]]] = [
    ("hikvision", 0.90, [Rule(0.90, "superblock", magic=HIK_SUPERBLOCK)]),
    (
        "dahua",
        0.90,
        [
            Rule(0.90, "dhfs_disk_image", magic=DHFS, no_brands=OEM_BRANDS),
            Rule(0.85, "dav_stream", magic=DHAV, no_brands=OEM_BRANDS, ext=(".dav",), facts=(("dhav_frames", 1),)),
            Rule(0.80, "dhav_stream_embedded", no_brands=OEM_BRANDS, facts=(("dhav_frames", 3),)),
        ],
    ),
    (
        "honeywell",
        0.85,
        [
            Rule(0.80, "maxpro_export", not_magic=(DHFS, HIK_AT_ZERO), brand="honeywell", ext=tuple(MAXPRO_EXT)),
            Rule(0.82, "proprietary_fs", not_magic=(DHFS, HIK_AT_ZERO), brand="honeywell", facts=(("nal_headers", 2),)),
            Rule(0.65, "brand_detected", not_magic=(DHFS, HIK_AT_ZERO), brand="honeywell"),
            Rule(0.70, "nal_pattern", not_magic=(DHFS, HIK_AT_ZERO), facts=(("nal_headers", 5),)),
        ],
    ),
    (
        "matrix",
        0.82,
        [
            Rule(0.82, "satatya_export", brand="matrix", ext=tuple(MATRIX_EXT)),
            Rule(0.70, "satatya_extension", ext=tuple(MATRIX_OWN_EXT)),
            Rule(0.78, "satatya_disk_image", brand="matrix", facts=(("nal_starts", 1),)),
            Rule(0.62, "satatya_brand_only", brand="matrix"),
        ],
    ),
    (
        "tplink_vigi",
        0.80,
        [
            Rule(0.80, "dav_stream", magic=DHAV, not_magic=(DHFS,), brand="tplink_vigi", ext=(".dav",)),
            Rule(0.65, "dav_stream", magic=DHAV, not_magic=(DHFS,), ext=(".dav",)),
            Rule(0.78, "dhav_embedded", not_magic=(DHFS,), brand="tplink_vigi", facts=(("dhav_frames", 3),)),
        ],
    ),
    (
        "godrej",
        0.80,
        [
            Rule(0.80, "dhfs_oem", magic=DHFS, brand="godrej"),
            Rule(0.78, "dav_oem", magic=DHAV, brand="godrej", ext=(".dav",)),
            Rule(0.75, "xm_oem", not_magic=(DHFS,), brand="godrej", facts=(("xm_markers", 1),)),
            Rule(0.72, "dhav_oem", not_magic=(DHFS,), brand="godrej", facts=(("dhav_frames", 1),)),
            Rule(0.60, "brand_only", not_magic=(DHFS,), brand="godrej"),
        ],
    ),
    ("heimvision", 0.75, [Rule(0.75, "raw_hevc_dat", ext=tuple(RAW_EXT), facts=(("vps_markers", 2),))]),
    (
        "uniview",
        0.75,
        [
            Rule(0.75, "ubs_disk_image", brand="uniview", facts=(("nal_starts", 1),)),
            Rule(0.60, "ubs_disk_image", brand="uniview"),
        ],
    ),
    (
        "cpplus",
        0.72,
        [
            Rule(0.72, "dhfs_disk_image", magic=DHFS, brand="cpplus"),
            Rule(0.72, "dav_stream", magic=DHAV, brand="cpplus"),
            Rule(0.72, "dhav_embedded", brand="cpplus", facts=(("dhav_frames", 3),)),
        ],
    ),
    ("generic_dvr_carver", 0.65, [Rule(0.65, "carved_streams", facts=(("carved_streams", 1),))]),
    ("generic", 0.30, [Rule(0.30, "video_file", ext=tuple(VIDEO_EXT))]),
]
FACTS = ["dhav_frames", "nal_headers", "nal_starts", "xm_markers", "vps_markers", "carved_streams"]
MIN_SIZE = 32

# ---- Fixed values: byte patterns of recorder frames ----
START_CODE = b"\x00\x00\x00\x01"
VPS_START = b"\x00\x00\x00\x01\x40"
XM_PREFIX = b"\x00\x00\x01\xfd"
DHAV_MARK = b"DHAV"
#: Type, magic, width and height, length of the unit (little-endian, 1 byte to 100 MiB), time.
NAL_HEADER = re.compile(rb"(?=[\x82\x02]\x80\x01\x00.{4}(.{4}).{8})", re.S)
LONGEST_NAL = 100 << 20
_MARKS = re.compile(b"(?=" + b"|".join(b"(%s)" % re.escape(m) for m in (DHAV_MARK, START_CODE, XM_PREFIX)) + b")")


def _count(data: bytes, chunk: int) -> tuple[int, int, int, int, int]:
    """Counts of DHAV frames, unit headers, start codes, XM frames and VPS units that start in a chunk."""
    dhav = starts = xm = vps = 0
    for m in _MARKS.finditer(data):
        if m.start() >= chunk:
            break
        dhav += m.lastindex == 1
        starts += m.lastindex == 2
        xm += m.lastindex == 3
        vps += m.lastindex == 2 and data.startswith(VPS_START, m.start())
    headers = 0
    for m in NAL_HEADER.finditer(data):
        if m.start() >= chunk:
            break
        headers += 0 < int.from_bytes(m[1], "little") <= LONGEST_NAL
    return dhav, headers, starts, xm, vps


def _chunk_facts(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, data = (batch.column(batch.schema.get_field_index(n)) for n in ("evidence_id", "bytes"))
        counts = [_count(x.as_py() or b"", chunk) for x in data]
        yield pa.RecordBatch.from_arrays(
            [ids, *(pa.array([c[i] for c in counts], pa.int64()) for i in range(5))],
            ["evidence_id", *FACTS[:5]],
        )


def marker_facts(chunks: DataFrame, chunk: int = 64 << 20) -> DataFrame:
    """The counts in `FACTS` of every image, from its bytes.

    Chunks hold `chunk` bytes of their own and an overlap of 20 bytes at least, which only
    completes what starts in them, so a marker across a border is counted once. Each chunk becomes
    one row of counts in the task that holds it; the counts are summed before and after the
    shuffle. An elementary stream can be carved from any start code, so `carved_streams` is their count.
    """
    counts = chunks.select("evidence_id", "bytes").mapInArrow(
        partial(_chunk_facts, chunk=chunk), "evidence_id BIGINT, " + ", ".join(f"{f} BIGINT" for f in FACTS[:5])
    )
    summed = counts.groupBy("evidence_id").agg(*(F.sum(f).alias(f) for f in FACTS[:5]))
    return summed.withColumn("carved_streams", F.col("nal_starts"))


def _all(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def _condition(rule: Rule) -> Column:
    head = F.col("_head")
    at = lambda m: F.substring(head, m[1] + 1, len(m[0])) == F.lit(m[0])
    conds = []
    if rule.magic:
        conds.append(at(rule.magic))
    conds += [~at(m) for m in rule.not_magic]
    if rule.brand:
        conds.append(F.col(f"_brand_{rule.brand}"))
    conds += [~F.col(f"_brand_{b}") for b in rule.no_brands]
    if rule.ext:
        conds.append(F.col("extension").isin(list(rule.ext)))
    conds += [F.col(f) >= n for f, n in rule.facts]
    return _all(conds)


def detect_vendors(images: DataFrame) -> DataFrame:
    """Candidates of every vendor for each image, the best one marked.

    `images`: evidence_id, extension, size, head (the bytes searched for brands, all there are)
    and the marker counts in `FACTS` (missing ones count as zero). A vendor tried after another one already
    reached its highest confidence is kept with `skipped`.
    """
    facts = {f: (F.col(f) if f in images.columns else F.lit(0)) for f in FACTS}
    rows = images.withColumns({**facts, "_head": F.decode("head", "ISO-8859-1")})
    brands = {}
    for vendor, texts in BRANDS.items():
        if vendor in EXACT_CASE:
            hit = reduce(lambda a, b: a | b, (F.contains(F.col("_head"), F.lit(t)) for t in texts))
        else:
            hit = contains_any(F.col("_head"), texts)
        brands[f"_brand_{vendor}"] = hit
    rows = rows.withColumns(brands)
    empty = F.lit(None).cast("string")
    found = []
    for rank, (vendor, top, rules) in enumerate(VENDORS):
        fmt, conf = empty, F.lit(0.0)
        for rule in reversed(rules):
            holds = _condition(rule) & (F.col("size") >= MIN_SIZE)
            fmt = F.when(holds, rule.format).otherwise(fmt)
            conf = F.when(holds, rule.confidence).otherwise(conf)
        found.append(
            F.struct(
                F.lit(rank).alias("rank"),
                F.lit(vendor).alias("vendor"),
                F.lit(top).alias("max_confidence"),
                fmt.alias("format"),
                conf.alias("confidence"),
            )
        )
    wide = rows.select("evidence_id", F.array(*found).alias("c"))
    best = F.array_max(F.transform("c", lambda x: x["confidence"]))
    first = F.get(F.filter("c", lambda x: x["confidence"] == best), F.lit(0))["rank"]

    def audit(x: Column) -> Column:
        earlier = F.filter("c", lambda y: (y["rank"] < x["rank"]) & (y["confidence"] > 0))
        top = F.coalesce(F.array_max(F.transform(earlier, lambda y: y["confidence"])), F.lit(-1.0))
        return F.struct(
            x.alias("x"),
            (top >= x["max_confidence"]).alias("skipped"),
            ((x["rank"] == first) & (best > 0)).alias("is_best"),
        )

    return wide.select("evidence_id", F.explode(F.transform("c", audit)).alias("a")).select(
        "evidence_id",
        F.col("a.x.rank").alias("rank"),
        F.col("a.x.vendor").alias("vendor"),
        (F.col("a.x.confidence") > 0).alias("matched"),
        F.col("a.x.format").alias("format"),
        F.col("a.x.confidence").alias("confidence"),
        "a.skipped",
        "a.is_best",
    )


def _tokens(text: Column) -> Column:
    return F.split(text, " ")


def marker_matches(texts: DataFrame, markers: DataFrame) -> DataFrame:
    """(text_id, marker_id) where the whole text contains the marker.

    A marker of five or more words is anchored on three of its inner words: a text that
    contains the marker has those words whole and in order. Texts meet markers by an
    equi-join on the anchor, and containment is checked on the few pairs left. Shorter markers, when there
    are any, are anchored on their first characters.

    `texts`: text_id, text. `markers`: marker_id, marker.
    """
    m = markers.withColumn("_w", _tokens(F.col("marker")))
    mid = F.floor(F.size("_w") / 2).cast("int")
    anchored = m.where(F.size("_w") >= 5).select(
        "marker_id", F.array_join(F.slice("_w", mid, F.lit(3)), " ").alias("anchor")
    )
    words = texts.select("text_id", _tokens(F.col("text")).alias("_w"))
    grams = words.select(
        "text_id",
        F.explode(
            F.transform(
                "_w",
                lambda x, i: F.concat_ws(" ", x, F.get("_w", i + 1), F.get("_w", i + 2)),
            )
        ).alias("anchor"),
    )
    pairs = grams.join(anchored, "anchor").select("text_id", "marker_id").distinct()
    checked = (
        pairs.join(texts, "text_id")
        .join(markers, "marker_id")
        .where(F.contains("text", F.col("marker")))
        .select("text_id", "marker_id")
    )
    short = m.where(F.size("_w") < 5).select("marker_id", "marker")
    if short.isEmpty():
        return checked
    # short markers: anchored on their first three characters (or fewer)
    heads = short.select("marker_id", F.substring("marker", 1, 3).alias("anchor"))
    runs = texts.select(
        "text_id",
        F.explode(
            F.array_distinct(
                F.flatten(
                    F.transform(
                        F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text"))),
                        lambda i: F.array(
                            *(F.substring(F.col("text"), i, F.lit(n)) for n in (1, 2, 3))
                        ),
                    )
                )
            )
        ).alias("anchor"),
    )
    close = (
        runs.join(heads, "anchor")
        .join(texts, "text_id")
        .join(short, "marker_id")
        .where(F.contains("text", F.col("marker")))
        .select("text_id", "marker_id")
    )
    return checked.unionByName(close)


def best_match(matches: DataFrame, rules: DataFrame) -> DataFrame:
    """All candidates of a text with their confidence; ties go to the earlier rule."""
    scored = matches.join(rules.select("marker_id", "confidence"), "marker_id")
    best = Window.partitionBy("text_id").orderBy(F.desc("confidence"), "marker_id")
    top = (
        scored.withColumn("_rn", F.row_number().over(best))
        .where("_rn = 1")
        .select("text_id", F.col("marker_id").alias("best_id"))
    )
    return scored.join(top, "text_id").select(
        "text_id", "marker_id", "confidence", (F.col("marker_id") == F.col("best_id")).alias("is_best")
    )
