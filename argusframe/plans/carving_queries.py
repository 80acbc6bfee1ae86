"""Byte evidence over the page texts, packed frames and index entries."""

from pyspark.sql import functions as F

from argusframe.checks.views import BLOBS, INDEX, PACKED, RECORDINGS
from argusframe.functions import scalars as S
from argusframe.operators import carving as K, signatures as G
from argusframe.plans.registry import query
from argusframe.sources import fixtures as X, readers as R
from argusframe.sources.session import materialize

TAGS = {"open": "<p>", "close": "</p>", "item": "<li>"}
_POS = """(SELECT evidence_id, length(content) AS size, '{kind}' AS kind,
   list_sum(list_transform(p[1:i], lambda x: length(x))) + (i-1)*{n} AS "offset"
   FROM (SELECT evidence_id, content, p, unnest(range(1, len(p))) AS i FROM (SELECT *, string_split(content, '{m}') AS p FROM blobs)))"""
HITS = f"{BLOBS}, hits AS (" + " UNION ALL ".join(
    _POS.format(kind=k, m=m, n=len(m)) for k, m in TAGS.items()
) + ")"


def hits(spark, sf):
    return K.text_markers(X.blobs(spark, sf), "content", TAGS)


@query(
    "scan_blob_chunks",
    f"""WITH {BLOBS}, b AS (SELECT evidence_id, length(content) AS size, content, unnest(range(0, greatest(1,length(content)), 1000)) AS base_offset FROM blobs)
    SELECT evidence_id, size, base_offset, length(substr(content, base_offset+1, 1016)) AS chunk_length, md5(substr(content, base_offset+1, 1016)) AS chunk_md5 FROM b""",
)
def scan_blob_chunks(spark, sf):
    return R.text_chunks(X.blobs(spark, sf), "content", 1000, 16).select(
        "evidence_id", "size", "base_offset",
        F.length("bytes").alias("chunk_length"), F.md5("bytes").alias("chunk_md5"),
    )


@query("find_markers", f"WITH {HITS} SELECT * FROM hits")
def find_markers(spark, sf):
    return hits(spark, sf)


_CL = """{name} AS (SELECT evidence_id, size, kind, "offset", sum(CASE WHEN pv IS NULL OR "offset"-pv>{gap} THEN 1 ELSE 0 END) OVER (PARTITION BY evidence_id, kind ORDER BY "offset") AS g
  FROM (SELECT *, lag("offset") OVER (PARTITION BY evidence_id, kind ORDER BY "offset") AS pv FROM hits))"""
CLUSTERS = f"""{HITS}, {_CL.format(name='cg', gap=150)},
clu AS (SELECT evidence_id, kind, min("offset") AS start_offset, least(max(size), max("offset")+100) AS end_offset, count(*) AS markers FROM cg GROUP BY evidence_id, kind, g HAVING count(*)>=2)"""


def clusters(spark, sf):
    return K.marker_clusters(
        hits(spark, sf), 150, 2, 100, slice_bytes=1000, keys=["evidence_id", "kind"]
    )


@query(
    "marker_clusters",
    f"WITH {CLUSTERS} SELECT evidence_id, kind, start_offset, end_offset, end_offset-start_offset AS size_bytes, markers FROM clu",
)
def marker_clusters(spark, sf):
    return clusters(spark, sf)


def streams(spark, sf):
    return clusters(spark, sf).withColumnRenamed("kind", "stream_type")


@query(
    "carve_summary",
    f"""WITH {CLUSTERS} SELECT evidence_id, count(*) AS streams_found, array_to_string(list_sort(list(DISTINCT kind)),'|') AS stream_types,
    sum(end_offset-start_offset) AS total_carved_bytes FROM clu GROUP BY 1""",
)
def carve_summary(spark, sf):
    return K.carve_summary(streams(spark, sf))


@query(
    "prune_overlaps",
    f"""WITH RECURSIVE {CLUSTERS}, o AS (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY start_offset, end_offset, kind) AS rn FROM clu),
    r AS (SELECT evidence_id, rn AS i, [{{'s':start_offset,'e':end_offset,'k':kind}}] AS kept FROM o WHERE rn=1
      UNION ALL SELECT r.evidence_id, r.i+1, CASE WHEN o.start_offset >= r.kept[-1].e THEN list_append(r.kept, {{'s':o.start_offset,'e':o.end_offset,'k':o.kind}})
        WHEN o.end_offset-o.start_offset > r.kept[-1].e-r.kept[-1].s THEN list_append(r.kept[1:len(r.kept)-1], {{'s':o.start_offset,'e':o.end_offset,'k':o.kind}}) ELSE r.kept END
      FROM r JOIN o ON o.evidence_id=r.evidence_id AND o.rn=r.i+1),
    f AS (SELECT evidence_id, unnest(arg_max(kept, i)) AS k FROM r GROUP BY 1)
    SELECT evidence_id, k.s AS start_offset, k.e AS end_offset, k.k AS stream_type FROM f""",
)
def prune_overlaps(spark, sf):
    return K.prune_overlaps(streams(spark, sf), slice_bytes=2000)


@query(
    "lead_segments",
    f"""WITH {HITS} SELECT evidence_id, "offset" AS start_offset, lead("offset",1,size) OVER (PARTITION BY evidence_id ORDER BY "offset") AS end_offset FROM hits WHERE kind='open'""",
)
def lead_segments(spark, sf):
    return K.lead_segments(hits(spark, sf).where("kind = 'open'"), slice_bytes=700)


@query(
    "marker_recordings",
    f"""WITH {HITS}, r AS (SELECT evidence_id, "offset", row_number() OVER (PARTITION BY evidence_id ORDER BY "offset") AS rn FROM hits WHERE kind='item')
    SELECT evidence_id, rn-1 AS segment_index, "offset", printf('xm-%04d', rn-1) AS recording_id, 'ORIGINAL' AS recovery_status FROM r""",
)
def marker_recordings(spark, sf):
    return K.marker_recordings(hits(spark, sf).where("kind = 'item'"))


def _nal(gap: int, tail: int) -> str:
    return f"""WITH {PACKED}, z AS (SELECT *, max("offset") OVER (PARTITION BY evidence_id) + 3000 AS size, lag("offset") OVER (PARTITION BY evidence_id ORDER BY "offset") AS pv FROM packed),
    g AS (SELECT *, sum(CASE WHEN pv IS NULL OR "offset"-pv>{gap} THEN 1 ELSE 0 END) OVER (PARTITION BY evidence_id ORDER BY "offset") AS seg FROM z),
    s AS (SELECT evidence_id, seg, min("offset") AS start_offset, max("offset") AS l, count(*) AS nal_count, max(size) AS size FROM g GROUP BY ALL),
    e AS (SELECT evidence_id, max(seg) AS fin FROM s GROUP BY 1), v AS (SELECT evidence_id, bool_or(frame_type=253 AND channel=3) AS hv FROM packed GROUP BY 1)
    SELECT s.evidence_id, start_offset, CASE WHEN seg=fin THEN least(l+{tail}, size) ELSE l+{tail} END AS end_offset, nal_count,
      CASE WHEN hv THEN 'hevc' ELSE 'h264' END AS codec_hint FROM s JOIN e USING (evidence_id) JOIN v USING (evidence_id)"""


def _starts(spark, sf):
    packed = X.packed_frames(spark, sf)
    sizes = packed.groupBy("evidence_id").agg((F.max("offset") + 3000).alias("size"))
    return packed.join(sizes, "evidence_id").withColumn(
        "is_vps", (F.col("frame_type") == 253) & (F.col("channel") == 3)
    )


@query("nal_segments", _nal(1048576, 65536))
def nal_segments(spark, sf):
    return K.nal_segments(_starts(spark, sf), 1048576, 65536, slice_bytes=2 << 20)


@query("nal_segments_near", _nal(262144, 4096))
def nal_segments_near(spark, sf):
    return K.nal_segments(_starts(spark, sf), 262144, 4096, slice_bytes=1 << 20)


@query(
    "idr_segments",
    f"""WITH {PACKED}, f AS (SELECT *, CASE WHEN date_raw=0 THEN NULL ELSE make_timestamp({X.EPOCH_US} + date_raw*1000000 % 86400000000) END AS ts FROM packed),
    g AS (SELECT *, sum((frame_type=240)::INT) OVER (PARTITION BY evidence_id ORDER BY "offset") AS seg FROM f)
    SELECT evidence_id, min("offset") AS first_offset, sum(length+20) AS total_bytes, count(*) AS frame_count, max("offset") AS last_offset,
      arg_min(1280+channel, "offset") AS width, 720 AS height, min(ts) AS start_time FROM g GROUP BY evidence_id, seg""",
)
def idr_segments(spark, sf):
    frames = X.packed_frames(spark, sf).selectExpr(
        "evidence_id", "offset", "frame_type", "length AS nal_len", "1280 + channel AS width", "720 AS height",
        f"CASE WHEN date_raw = 0 THEN NULL ELSE timestamp_micros({X.EPOCH_US} + date_raw * 1000000 % 86400000000) END AS timestamp",
    )
    return K.idr_segments(frames, 240, slice_bytes=300000)


_DATE = """CASE WHEN date_raw=0 THEN NULL ELSE make_timestamp(2000 + (date_raw>>26), (date_raw>>22)&15, (date_raw>>17)&31, (date_raw>>12)&31, (date_raw>>6)&63, (date_raw&63)::DOUBLE) END"""


@query("decode_packed_date", f'WITH {PACKED} SELECT evidence_id, "offset", {_DATE} AS at FROM packed')
def decode_packed_date(spark, sf):
    return X.packed_frames(spark, sf).select(
        "evidence_id", "offset", S.packed_date(F.col("date_raw")).alias("at")
    )


@query(
    "channel_recordings",
    f"""WITH {PACKED} SELECT evidence_id, channel, min({_DATE}) AS start_time, sum(length) AS file_size, count(*) AS frame_count,
    min("offset") AS first_offset, max("offset") AS last_offset, printf('CH-%02d', channel) AS camera_id FROM packed GROUP BY evidence_id, channel""",
)
def channel_recordings(spark, sf):
    return K.channel_recordings(X.packed_frames(spark, sf))


@query(
    "dvr_frame_scan",
    f"""WITH RECURSIVE {PACKED}, c AS (SELECT evidence_id, "offset", length*500 AS length, channel, row_number() OVER (PARTITION BY evidence_id ORDER BY "offset") AS rn FROM packed),
    r AS (SELECT evidence_id, rn AS i, "offset"+24+length+8 AS till, "offset" AS kept FROM c WHERE rn=1
      UNION ALL SELECT r.evidence_id, r.i+1, CASE WHEN c."offset">=r.till THEN c."offset"+24+c.length+8 ELSE r.till END, CASE WHEN c."offset">=r.till THEN c."offset" END
      FROM r JOIN c ON c.evidence_id=r.evidence_id AND c.rn=r.i+1)
    SELECT c.evidence_id, c."offset", c.length, c.channel FROM r JOIN c ON c.evidence_id=r.evidence_id AND c."offset"=r.kept""",
)
def dvr_frame_scan(spark, sf):
    cand = X.packed_frames(spark, sf).withColumn("length", F.col("length") * 500)
    return K.dvr_frame_scan(cand, slice_bytes=200000).select("evidence_id", "offset", "length", "channel")


def _hex_le(value: str, size: int) -> str:
    """SQL text: little-endian hex of a number."""
    big = f"lpad(hex({value}), {2 * size}, '0')"
    return "concat(" + ", ".join(f"substring({big}, {2 * i + 1}, 2)" for i in reversed(range(size))) + ")"


@query(
    "decode_nal_header",
    f"""WITH {RECORDINGS}, r AS (SELECT *, CASE version%3 WHEN 0 THEN 130 WHEN 1 THEN 2 ELSE 153 END AS ft,
      CASE WHEN version%17=0 THEN 0 ELSE CAST(floor(file_size) AS BIGINT) END AS nl,
      CASE WHEN version%13=0 THEN 5 ELSE epoch_us(original_timestamp) END AS us FROM recordings)
    SELECT evidence_id, recording_identifier, version, ft AS frame_type, 1920 AS width, 1080 AS height, nl AS nal_len,
      CASE WHEN us>=946684800000000 THEN make_timestamp(us) END AS timestamp FROM r WHERE ft IN (130,2) AND nl>0""",
)
def decode_nal_header(spark, sf):
    rows = X.recordings(spark, sf).selectExpr(
        "evidence_id", "recording_identifier", "version",
        "CASE version % 3 WHEN 0 THEN '82' WHEN 1 THEN '02' ELSE '99' END AS ft",
        "CASE WHEN version % 17 = 0 THEN 0 ELSE CAST(floor(file_size) AS BIGINT) END AS nl",
        "CASE WHEN version % 13 = 0 THEN 5 ELSE unix_micros(original_timestamp) END AS us",
    ).selectExpr(
        "evidence_id", "recording_identifier", "version",
        f"unhex(concat(ft, '800100', {_hex_le('1920', 2)}, {_hex_le('1080', 2)}, {_hex_le('nl', 4)}, {_hex_le('us', 8)})) AS header",
    )
    return K.decode_nal_header(rows)


@query(
    "decode_index_entries",
    f"""WITH {RECORDINGS}, r AS (SELECT evidence_id, recording_identifier, version, epoch_us(original_timestamp)//1000000 AS s,
      row_number() OVER (PARTITION BY evidence_id ORDER BY recording_identifier, version, original_timestamp)-1 AS entry FROM recordings)
    SELECT evidence_id, entry, recording_identifier AS channel, version%7=0 AS recording,
      CASE WHEN version%7<>0 THEN make_timestamp(s*1000000) END AS start_time, CASE WHEN version%7<>0 THEN make_timestamp((s+60)*1000000) END AS end_time,
      version*1048576 AS offset_datablock, CASE WHEN version%7=0 THEN 'PARTIAL' ELSE 'ORIGINAL' END AS recovery_status FROM r WHERE version%11<>0""",
)
def decode_index_entries(spark, sf):
    t = "unix_micros(original_timestamp) DIV 1000000"
    begin = f"(CASE WHEN version % 7 = 0 THEN 2147483647 ELSE {t} END)"
    entry = (
        f"concat(repeat('00', 8), CASE WHEN version % 11 = 0 THEN repeat('FF', 8) ELSE repeat('00', 8) END, '00', {_hex_le('recording_identifier', 1)},"
        f" repeat('00', 6), {_hex_le(begin, 4)}, {_hex_le(f'({t} + 60)', 4)}, {_hex_le('(version * 1048576)', 8)}, repeat('00', 8))"
    )
    pages = (
        X.recordings(spark, sf)
        .selectExpr("evidence_id", f"struct(recording_identifier, version, original_timestamp, {entry} AS h) AS s")
        .groupBy("evidence_id")
        .agg(F.array_sort(F.collect_list("s")).alias("es"))
        .select(
            "evidence_id",
            F.lit(0).alias("page"),
            F.size("es").alias("entry_count"),
            F.unhex(F.array_join(F.transform("es", lambda s: s["h"]), "")).alias("entries"),
        )
    )
    return K.decode_index_entries(pages).drop("page")


@query(
    "block_triage",
    f"""WITH {BLOBS}, e AS (SELECT l_orderkey%500 AS evidence_id, l_linenumber AS recording_identifier, CASE WHEN l_partkey%11=0 THEN NULL ELSE l_partkey%3 END AS offset_datablock FROM lineitem),
    b AS (SELECT evidence_id, evidence_id%3 AS offset_datablock, CASE WHEN evidence_id%7=0 THEN '' ELSE content END AS block FROM blobs),
    j AS (SELECT e.*, block FROM e LEFT JOIN b ON e.evidence_id=b.evidence_id AND e.offset_datablock=b.offset_datablock),
    r AS (SELECT evidence_id, recording_identifier, offset_datablock, CASE WHEN offset_datablock IS NULL THEN 'missing block offset' WHEN block IS NULL OR block='' THEN 'data block empty'
       WHEN NOT contains(block, '<h1') THEN 'no pack marker' END AS reason FROM j)
    SELECT evidence_id, recording_identifier, offset_datablock, CASE WHEN reason IS NULL THEN 'ORIGINAL' ELSE 'PARTIAL' END AS recovery_status, reason FROM r""",
)
def block_triage(spark, sf):
    entries = X.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey % 500 AS evidence_id", "l_linenumber AS recording_identifier",
        "CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_partkey % 3 END AS offset_datablock",
    )
    blocks = X.blobs(spark, sf).selectExpr(
        "evidence_id", "evidence_id % 3 AS offset_datablock",
        "CASE WHEN evidence_id % 7 = 0 THEN encode('', 'UTF-8') ELSE encode(content, 'UTF-8') END AS block",
    )
    return K.block_triage(entries, blocks, F.lit(b"<h1"))


BS = 1048576
UNALLOC = f"""{INDEX},
mk AS (SELECT DISTINCT event_id%64 AS evidence_id, (event_id*7919007)%536870912 AS "offset" FROM events),
known AS (SELECT DISTINCT evidence_id, offset_datablock AS "offset" FROM idx_entries),
fc AS (SELECT DISTINCT evidence_id, ("offset"//{BS} - d)*{BS} AS "offset" FROM mk, (VALUES (0),(1)) t(d)),
al AS (SELECT evidence_id, "offset" FROM fc WHERE "offset">=4096 AND "offset"+{BS}<=536870912 AND (("offset"//{BS})*37+evidence_id)%100/100.0 < 0.98
  AND NOT EXISTS (SELECT 1 FROM known k WHERE k.evidence_id=fc.evidence_id AND k."offset"=fc."offset")),
wk AS (SELECT evidence_id, min("offset") AS p FROM mk WHERE "offset">=4096 GROUP BY 1
  UNION ALL SELECT w.evidence_id, min(m."offset") FROM wk w JOIN mk m ON m.evidence_id=w.evidence_id AND m."offset">=w.p+{BS} GROUP BY w.evidence_id, w.p),
kn AS (SELECT * FROM known UNION ALL SELECT * FROM al),
orp AS (SELECT evidence_id, p AS "offset" FROM wk WHERE NOT EXISTS (SELECT 1 FROM kn WHERE kn.evidence_id=wk.evidence_id AND abs(kn."offset"-p)<{BS}))"""


@query(
    "unallocated_blocks",
    f"""WITH RECURSIVE {UNALLOC} SELECT evidence_id, "offset", 'aligned' AS kind, 'RECOVERED' AS recovery_status FROM al
    UNION ALL SELECT evidence_id, "offset", 'orphan', 'RECOVERED' FROM orp""",
)
def unallocated_blocks(spark, sf):
    index = X.index_entries(spark, sf).select("evidence_id", F.col("offset_datablock").alias("offset"))
    markers = X.table(spark, sf, "events").selectExpr(
        "event_id % 64 AS evidence_id", "(event_id * 7919007) % 536870912 AS offset"
    ).distinct()
    images = markers.select("evidence_id").distinct().withColumn("size", F.lit(536870912).cast("bigint"))
    facts = (
        markers.select("evidence_id", F.explode(F.array(F.floor(F.col("offset") / BS), F.floor(F.col("offset") / BS) - 1)).alias("b"))
        .distinct()
        .select("evidence_id", (F.col("b") * BS).alias("offset"), (F.pmod(F.col("b") * 37 + F.col("evidence_id"), F.lit(100)) / 100).alias("zero_share"))
    )
    return K.unallocated_blocks(images, index, facts, markers, block_size=BS)


@query(
    "printable_strings",
    """SELECT doc_id AS evidence_id, length(r) AS run_length, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[ -~]{6,}')) AS r FROM documents) GROUP BY ALL""",
)
def printable_strings(spark, sf):
    docs = X.table(spark, sf, "documents").withColumnRenamed("doc_id", "evidence_id")
    return (
        K.printable_runs(docs, "text")
        .groupBy("evidence_id", F.length("run").alias("run_length"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


_PAIR = "substr(lower(hex(encode(c))), 2*{i}+1, 2)"
_LEFT = "rtrim(concat_ws(' ', " + ", ".join(_PAIR.format(i=i) for i in range(8)) + "))"
_RIGHT = "rtrim(concat_ws(' ', " + ", ".join(_PAIR.format(i=i) for i in range(8, 16)) + "))"


@query(
    "hex_dump",
    f"""WITH s AS (SELECT c_custkey AS evidence_id, unnest(range(0, length(c_name), 16)) AS "offset", c_name FROM customer),
    k AS (SELECT evidence_id, "offset", substr(c_name, "offset"+1, 16) AS c FROM s)
    SELECT evidence_id, "offset", lpad(lower(hex("offset")), 8, '0') || '  ' || rpad(rtrim(rpad({_LEFT}, 23, ' ') || '  ' || {_RIGHT}), 48, ' ') || '  |' || c || '|' AS line FROM k""",
)
def hex_dump(spark, sf):
    rows = X.table(spark, sf, "customer").selectExpr("c_custkey AS evidence_id", "encode(c_name, 'UTF-8') AS raw")
    return K.hex_dump(rows, "raw")


@query(
    "signature_match",
    """WITH m AS (SELECT doc_id AS text_id, item_id AS marker_id, 0.5::DOUBLE + (item_id%5)/10.0::DOUBLE AS confidence FROM documents JOIN benchmark b ON contains(documents.text, b.text)),
    r AS (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY confidence DESC, marker_id) AS rn FROM m)
    SELECT text_id, marker_id, confidence, rn=1 AS is_best FROM r""",
    "confidence",
)
def signature_match(spark, sf):
    docs = X.table(spark, sf, "documents").selectExpr("doc_id AS text_id", "text")
    rules = X.table(spark, sf, "benchmark").selectExpr(
        "item_id AS marker_id", "text AS marker", "0.5D + (item_id % 5) / 10D AS confidence"
    )
    return G.best_match(G.marker_matches(docs, rules.select("marker_id", "marker")), rules)


@query(
    "container_ts",
    """WITH r AS (SELECT o_orderkey AS evidence_id, o_orderdate AS d, CASE o_orderkey%4 WHEN 0 THEN 'mp4' WHEN 1 THEN 'mkv' WHEN 2 THEN 'avi' ELSE 'flv' END AS st,
      CASE o_orderkey%5 WHEN 0 THEN 'date' WHEN 1 THEN 'IDIT' ELSE 'creation_time' END AS tag FROM orders),
    v AS (SELECT *, (st IN ('mp4','mkv') AND tag='creation_time') OR (st='avi' AND tag='IDIT') AS ok FROM r)
    SELECT evidence_id, st AS stream_type, CASE WHEN ok AND year(d)>=2000 AND CAST(d AS DATE)<>DATE '2001-01-01' AND d<=TIMESTAMP '2001-09-01 00:00:00' THEN d END AS created FROM v""",
)
def container_ts(spark, sf):
    rows = X.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS evidence_id", "CAST(o_orderdate AS TIMESTAMP) AS d",
        "CASE o_orderkey % 4 WHEN 0 THEN 'mp4' WHEN 1 THEN 'mkv' WHEN 2 THEN 'avi' ELSE 'flv' END AS stream_type",
        "CASE o_orderkey % 5 WHEN 0 THEN 'date' WHEN 1 THEN 'IDIT' ELSE 'creation_time' END AS tag",
    ).withColumn(
        "value",
        F.when(F.col("evidence_id") % 3 == 0, F.date_format("d", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(F.col("evidence_id") % 3 == 1, F.date_format("d", "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.date_format("d", "EEE MMM dd HH:mm:ss yyyy")),
    )
    now = F.lit("2001-09-01 00:00:00").cast("timestamp")
    return rows.select(
        "evidence_id", "stream_type",
        K.container_timestamp(F.col("stream_type"), F.col("tag"), F.col("value"), now).alias("created"),
    )


def vendor_images(spark, sf):
    """Image heads derived from the pages: their text behind a vendor's marks."""
    marks = F.element_at(
        F.array(
            *(
                F.lit(m)
                for m in (
                    "DHFS4.1 ", "DHAV frame ", "DHAV vigi ", "plain ", "SATATYA NVR ", "Godrej ACE ",
                    "UNV box ", "DHFS4.1 CP PLUS ", "Honeywell ",
                )
            )
        ),
        (F.pmod("evidence_id", F.lit(9)) + 1).cast("int"),
    )
    ext = F.element_at(
        F.array(*(F.lit(e) for e in (".dd", ".dav", ".stm", ".mp4"))),
        (F.pmod("evidence_id", F.lit(4)) + 1).cast("int"),
    )
    latin = X.blobs(spark, sf).select("evidence_id", F.col("content"))
    body = F.col("content")
    for tag, mark in FRAME_MARKS.items():
        body = F.replace(body, F.lit(tag), F.lit(mark))
    # one byte a character: the frame marks of a recorder stand where the page has tags
    head = F.concat(F.encode(marks, "ISO-8859-1"), F.encode(body, "ISO-8859-1"))
    images = latin.select("evidence_id", ext.alias("extension"), F.length(head).cast("bigint").alias("size"), head.alias("head"))
    facts = G.marker_facts(R.text_chunks(images, "head", 4096, 64), 4096)
    return images.join(facts, "evidence_id")


#: Tags of a page and the recorder bytes put in their place (as ISO-8859-1).
FRAME_MARKS = {
    "<b>": "DHAV", "<br>": "\x00\x00\x00\x01@", "</li>": "\x02\x80\x01\x00\x80\x07\x38\x04\x10" + "\x00" * 11,
    "<h1>": "\x00\x00\x00\x01", "<article>": "\x00\x00\x01\xfd",
}


_VC = [
    ("hikvision", 0.90, "0"),
    ("dahua", 0.90, "CASE WHEN oem THEN 0 WHEN k IN (0,7) THEN 0.90 WHEN k IN (1,2) AND ext='.dav' AND dh>=1 THEN 0.85 WHEN dh>=3 THEN 0.80 ELSE 0 END"),
    ("honeywell", 0.85, "CASE WHEN dhfs THEN 0 WHEN hon AND nh>=2 THEN 0.82 WHEN hon THEN 0.65 WHEN nh>=5 THEN 0.70 ELSE 0 END"),
    ("matrix", 0.82, "CASE WHEN mat AND ext='.stm' THEN 0.82 WHEN ext='.stm' THEN 0.70 WHEN mat AND ns>=1 THEN 0.78 WHEN mat THEN 0.62 ELSE 0 END"),
    ("tplink_vigi", 0.80, "CASE WHEN dhfs THEN 0 WHEN dhav AND tp AND ext='.dav' THEN 0.80 WHEN dhav AND ext='.dav' THEN 0.65 WHEN tp AND dh>=3 THEN 0.78 ELSE 0 END"),
    ("godrej", 0.80, "CASE WHEN god AND dhfs THEN 0.80 WHEN god AND dhav AND ext='.dav' THEN 0.78 WHEN dhfs THEN 0 WHEN god AND xm>=1 THEN 0.75 WHEN god AND dh>=1 THEN 0.72 WHEN god THEN 0.60 ELSE 0 END"),
    ("heimvision", 0.75, "CASE WHEN ext='.dd' AND vp>=2 THEN 0.75 ELSE 0 END"),
    ("uniview", 0.75, "CASE WHEN unv AND ns>=1 THEN 0.75 WHEN unv THEN 0.60 ELSE 0 END"),
    ("cpplus", 0.72, "CASE WHEN cp AND (dhfs OR dhav OR dh>=3) THEN 0.72 ELSE 0 END"),
    ("generic_dvr_carver", 0.65, "CASE WHEN ns>=1 THEN 0.65 ELSE 0 END"),
    ("generic", 0.30, "CASE WHEN ext='.mp4' THEN 0.30 ELSE 0 END"),
]


def _has(words: list[str], exact: bool = False) -> str:
    col = "h" if exact else "lower(h)"
    return "(" + " OR ".join(f"contains({col}, '{w if exact else w.lower()}')" for w in words) + ")"


VENDOR_SQL = f"""
WITH {BLOBS}, b AS (SELECT evidence_id, evidence_id%9 AS k,
   (length(content)-length(replace(content,'<b>','')))//3 + (evidence_id%9 IN (1,2))::INT AS dh, (length(content)-length(replace(content,'</li>','')))//5 AS nh,
   (length(content)-length(replace(content,'<br>','')))//4 + (length(content)-length(replace(content,'<h1>','')))//4 AS ns,
   (length(content)-length(replace(content,'<br>','')))//4 AS vp, (length(content)-length(replace(content,'<article>','')))//9 AS xm,
   ['.dd','.dav','.stm','.mp4'][evidence_id%4+1] AS ext,
   substr(['DHFS4.1 ','DHAV frame ','DHAV vigi ','plain ','SATATYA NVR ','Godrej ACE ','UNV box ','DHFS4.1 CP PLUS ','Honeywell '][evidence_id%9+1] || content, 1) AS h FROM blobs),
f AS (SELECT *, starts_with(h,'DHFS4.1') AS dhfs, starts_with(h,'DHAV') AS dhav, {_has(G.BRANDS['honeywell'])} AS hon, {_has(G.BRANDS['matrix'])} AS mat,
   {_has(G.BRANDS['tplink_vigi'], True)} AS tp, {_has(G.BRANDS['godrej'])} AS god, {_has(G.BRANDS['uniview'], True)} AS unv, {_has(G.BRANDS['cpplus'])} AS cp FROM b),
g AS (SELECT *, tp OR cp OR god AS oem FROM f),
c AS ({" UNION ALL ".join(f"SELECT evidence_id, {i} AS rank, '{v}' AS vendor, {m}::DOUBLE AS mx, ({e})::DOUBLE AS confidence FROM g" for i, (v, m, e) in enumerate(_VC))}),
w AS (SELECT *, max(CASE WHEN confidence>0 THEN confidence END) OVER (PARTITION BY evidence_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top,
   row_number() OVER (PARTITION BY evidence_id ORDER BY confidence DESC, rank) AS rn FROM c)"""


@query(
    "vendor_detect",
    f"{VENDOR_SQL} SELECT evidence_id, vendor, confidence FROM w WHERE rn=1 AND confidence>0",
    "confidence",
)
def vendor_detect(spark, sf):
    return G.detect_vendors(vendor_images(spark, sf)).where("is_best").select("evidence_id", "vendor", "confidence")


@query(
    "marker_facts",
    f"{VENDOR_SQL} SELECT evidence_id, dh AS dhav_frames, nh AS nal_headers, ns AS nal_starts, xm AS xm_markers, vp AS vps_markers, ns AS carved_streams FROM b",
)
def marker_facts(spark, sf):
    return vendor_images(spark, sf).select("evidence_id", *G.FACTS)


@query(
    "block_facts",
    f"""WITH {BLOBS}, b AS (SELECT evidence_id, unnest(range(0, (length(content)+1023)//1024)) AS i, content FROM blobs),
    s AS (SELECT evidence_id, i*1024 AS "offset", substr(content, i*1024+1, 1000) AS s FROM b)
    SELECT evidence_id, "offset", (length(s)-length(replace(s,'e','')))/length(s) AS zero_share, "offset"+strpos(s,'<p>')-1 AS first_pack FROM s WHERE contains(s,'<p>')""",
    "zero_share",
)
def block_facts(spark, sf):
    images = X.blobs(spark, sf).select("evidence_id", F.encode("content", "ISO-8859-1").alias("content"))
    chunks = R.text_chunks(images, "content", 1500, 16)
    return K.block_facts(chunks, 1024, b"<p>", chunk=1500, filler=ord("e"), head=1000)


@query(
    "candidate_audit",
    f"{VENDOR_SQL} SELECT evidence_id, rank, vendor, confidence>0 AS matched, confidence, coalesce(top>=mx,false) AS skipped FROM w",
    "confidence",
)
def candidate_audit(spark, sf):
    return G.detect_vendors(vendor_images(spark, sf)).select(
        "evidence_id", "rank", "vendor", "matched", "confidence", "skipped"
    )


def binary_images(spark, sf):
    """Raw images derived from the pages: text, then a stream of one of six kinds."""
    text = F.encode(F.col("content"), "UTF-8")
    size = F.length(text) + 8
    be4 = lambda n: F.unhex(F.lpad(F.hex(n), 8, "0"))
    raw = lambda h: F.unhex(F.lit(h))
    many = lambda h, n: F.unhex(F.repeat(F.lit(h), n))
    tag = F.concat(raw("09"), F.unhex(F.lpad(F.hex(F.length(text)), 6, "0")), many("00", 7), text)
    kinds = [
        F.concat(be4(F.lit(16)), F.encode(F.lit("ftypisom"), "UTF-8"), be4(F.lit(512)), be4(size), F.encode(F.lit("mdat"), "UTF-8"), text),
        F.concat(raw("464C56010500000009"), raw("00000000"), tag, raw("00000000"), tag, many("EE", 40)),
        F.concat(F.encode(F.lit("RIFF"), "UTF-8"), F.unhex(F.lit("00020000")), F.encode(F.lit("AVI "), "UTF-8"), text),
        many("000001BA" + "11" * 60, 9),
        many("44484156F0" + "22" * 90, 6),
        F.concat(raw("0000000167" + "33" * 20), many("0000000165" + "44" * 50, 12)),
    ]
    body = kinds[-1]
    for i in reversed(range(5)):
        body = F.when(F.pmod("evidence_id", F.lit(6)) == i, kinds[i]).otherwise(body)
    return X.blobs(spark, sf).select("evidence_id", F.concat(text, body, many("EE", 700)).alias("content"))


@query("carve_streams")
def carve_streams(spark, sf):
    """Streams carved from binary images derived from the pages (checked in the tests)."""
    images = binary_images(spark, sf)
    chunks = R.text_chunks(images, "content", 4096, 512)
    found = materialize(K.scan_markers(chunks, chunk=4096))
    return K.carve_streams(found, images, slice_bytes=1 << 20)
