"""Frame timing, duplicates, discontinuities and integrity scores."""

from pyspark.sql import functions as F

from argusframe.checks.views import FRAMES, SIGNATURES
from argusframe.operators import integrity as N
from argusframe.plans.registry import query
from argusframe.sources import fixtures as X

_L = f"""{FRAMES}, fl AS (SELECT *, lag(pts) OVER w AS ppts, lag(mean_luma) OVER w AS pm, lag(std_luma) OVER w AS ps, lag(frame_number) OVER w AS pf
  FROM frames WINDOW w AS (PARTITION BY video_id ORDER BY frame_number))"""
_S = f"""{_L}, fs AS (SELECT video_id, frame_number, 1.0::DOUBLE/(pts-ppts) AS fps FROM fl WHERE pts-ppts>0)"""


@query(
    "pts_gaps",
    f"WITH {_L} SELECT video_id, frame_number, pts, pts-ppts AS delta_s, 'gap' AS kind FROM fl WHERE pts-ppts > 2.75/nominal_fps",
    "pts delta_s",
)
def pts_gaps(spark, sf):
    return N.pts_gaps(X.frames(spark, sf), slice_frames=16)


@query(
    "pts_gaps_report",
    f"""WITH {_L} SELECT video_id, frame_number, pts, pts-ppts AS delta_s, CASE WHEN pts-ppts < -0.001 THEN 'backwards' ELSE 'gap' END AS kind
    FROM fl WHERE pts-ppts < -0.001 OR pts-ppts > greatest(2.5/nominal_fps, 0.15)""",
    "pts delta_s",
)
def pts_gaps_report(spark, sf):
    return N.pts_gaps(X.frames(spark, sf), "report")


@query(
    "fps_changes",
    f"""WITH {_S}, l AS (SELECT *, lag(fps) OVER (PARTITION BY video_id ORDER BY frame_number) AS previous_fps FROM fs)
    SELECT video_id, frame_number, fps, previous_fps FROM l WHERE abs(fps-previous_fps) > greatest(previous_fps*0.20, 5.0)""",
    "fps previous_fps",
)
def fps_changes(spark, sf):
    return N.fps_changes(X.frames(spark, sf))


_FAST = f"""{FRAMES}, fl AS (SELECT *, lag(pts) OVER (PARTITION BY video_id ORDER BY frame_number) AS ppts FROM frames),
fs AS (SELECT video_id, frame_number, 1.0::DOUBLE/((pts-ppts)/8) AS fps FROM fl WHERE pts-ppts>0)"""


@query(
    "fps_changes_fast",
    f"""WITH {_FAST}, l AS (SELECT *, lag(fps) OVER (PARTITION BY video_id ORDER BY frame_number) AS previous_fps FROM fs)
    SELECT video_id, frame_number, fps, previous_fps FROM l WHERE abs(fps-previous_fps) > greatest(previous_fps*0.20, 5.0)""",
    "fps previous_fps",
)
def fps_changes_fast(spark, sf):
    return N.fps_changes(X.frames(spark, sf).withColumn("pts", F.col("pts") / 8), slice_frames=7)


@query(
    "fps_consistency",
    f"""WITH {_S}, m AS (SELECT video_id, median(fps) AS median_fps FROM fs GROUP BY 1),
    o AS (SELECT fs.video_id, median_fps, count(*) AS samples, count(*) FILTER (abs(fps-median_fps) > greatest(0.75, median_fps*0.15)) AS outliers
      FROM fs JOIN m USING (video_id) GROUP BY 1,2)
    SELECT *, outliers <= greatest(3, samples//20) AS consistent FROM o""",
    "median_fps",
)
def fps_consistency(spark, sf):
    return N.fps_consistency(X.frames(spark, sf))


@query(
    "resolution_changes",
    f"WITH {FRAMES} SELECT video_id, count(DISTINCT (width,height)) AS resolutions, count(DISTINCT (width,height))-1 AS changes FROM frames GROUP BY 1",
)
def resolution_changes(spark, sf):
    return N.resolution_changes(X.frames(spark, sf))


@query(
    "off_size_frames",
    f"WITH {FRAMES} SELECT video_id, frame_number, width, height FROM frames WHERE width<>1920 OR height<>1080",
)
def off_size_frames(spark, sf):
    return N.off_size_frames(X.frames(spark, sf), 1920, 1080)


_J = "abs(mean_luma-pm)>70 AND abs(std_luma-ps)>35"


@query(
    "visual_jumps",
    f"""WITH {_L}, g AS (SELECT video_id, count(*) AS frames_checked, count(*) FILTER ({_J}) AS jumps FROM fl GROUP BY 1)
    SELECT *, jumps <= greatest(5, CAST(floor(frames_checked*0.08) AS BIGINT)) AS consistent FROM g""",
)
def visual_jumps(spark, sf):
    return N.visual_jumps(X.frames(spark, sf), slice_frames=16)


@query(
    "duplicate_runs",
    f"""WITH {_L}, d AS (SELECT *, coalesce(abs(mean_luma-pm)<80, false) AS dup FROM fl),
    r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_number) - row_number() OVER (PARTITION BY video_id, dup ORDER BY frame_number) AS grp FROM d),
    g AS (SELECT video_id, grp, min(pf) AS start_frame, max(frame_number) AS end_frame, count(*) AS duplicates FROM r WHERE dup GROUP BY 1,2)
    SELECT video_id, start_frame, end_frame, duplicates FROM g WHERE duplicates>=5""",
)
def duplicate_runs(spark, sf):
    return N.duplicate_runs(
        X.frames(spark, sf),
        ["mean_luma"],
        lambda prev: F.abs(F.col("mean_luma") - prev["mean_luma"]),
        below=80.0,
        slice_frames=16,
    )


_SG = f"""{SIGNATURES}"""


@query(
    "dup_signatures",
    f"""WITH {_SG}, s AS (SELECT *, lag(signature) OVER (PARTITION BY video_id ORDER BY frame_number) AS prev FROM sigs WHERE frame_number%5=0),
    c AS (SELECT video_id, frame_number, list_sum(list_transform(list_zip(signature, prev), lambda z: z[1]::DOUBLE*z[2]::DOUBLE))
      / (sqrt(list_sum(list_transform(signature, lambda x: x::DOUBLE*x::DOUBLE)))*sqrt(list_sum(list_transform(prev, lambda x: x::DOUBLE*x::DOUBLE)))) AS similarity
      FROM s WHERE prev IS NOT NULL)
    SELECT * FROM c WHERE similarity>=0.2""",
    "similarity",
)
def dup_signatures(spark, sf):
    return N.similar_signatures(X.frame_signatures(spark, sf), at_least=0.2, slice_frames=50)


@query(
    "change_score",
    f"""WITH {_SG}, s AS (SELECT *, lag(signature) OVER (PARTITION BY video_id ORDER BY frame_number) AS prev FROM sigs)
    SELECT video_id, frame_number, len(list_filter(list_zip(signature, prev), lambda z: abs(z[1]::DOUBLE-z[2]::DOUBLE)>0.1::DOUBLE))::DOUBLE/len(signature) AS score
    FROM s WHERE prev IS NOT NULL""",
    "score",
)
def change_score(spark, sf):
    return N.change_scores(X.frame_signatures(spark, sf), delta=0.1)


_CHK = f"""{_S}, mm AS (SELECT video_id, median(fps) AS med FROM fs GROUP BY 1),
rc AS (SELECT fs.video_id, count(*) FILTER (abs(fps-med) > greatest(0.75, med*0.15)) <= greatest(3, count(*)//20) AS rate_ok FROM fs JOIN mm USING (video_id) GROUP BY 1),
ck AS (SELECT video_id, count(*) AS n, count(*) FILTER (pts-ppts > greatest(2.5/nominal_fps,0.15)) AS gaps,
   count(*) FILTER (nominal_fps > 0 AND pts-ppts > 2.75/nominal_fps) AS decoder_gaps, count(*) FILTER (pts-ppts < -0.001) AS back,
   count(*) FILTER ({_J}) AS jumps, count(DISTINCT (width,height)) AS sizes, count(*) FILTER (mean_luma IS NULL) AS bad FROM fl GROUP BY 1)"""

_SIM = f"""{_SG}, s5 AS (SELECT *, lag(signature) OVER (PARTITION BY video_id ORDER BY frame_number) AS prev FROM sigs WHERE frame_number%5=0),
sm AS (SELECT video_id, count(*) AS alike FROM s5 WHERE prev IS NOT NULL AND list_sum(list_transform(list_zip(signature, prev), lambda z: z[1]::DOUBLE*z[2]::DOUBLE))
  / (sqrt(list_sum(list_transform(signature, lambda x: x::DOUBLE*x::DOUBLE)))*sqrt(list_sum(list_transform(prev, lambda x: x::DOUBLE*x::DOUBLE)))) >= 0.995 GROUP BY 1)"""


@query(
    "integrity_score_pct",
    f"""WITH {_CHK}, {_SIM}, p AS (SELECT ck.video_id, (decoder_gaps=0)::INT AS c1, (bad=0)::INT AS c2, coalesce(rate_ok,true)::INT AS c3,
      (coalesce(alike,0)=0)::INT AS c4, (sizes=1)::INT AS c6 FROM ck LEFT JOIN rc USING (video_id) LEFT JOIN sm USING (video_id))
    SELECT video_id, round((c1+c2+c3+c4+1+c6+1)/7.0::DOUBLE*100, 1) AS integrity_score,
      CASE WHEN c1+c2+c3+c6=4 THEN 'PASS' ELSE 'WARNING' END AS overall_status FROM p""",
    "integrity_score",
)
def integrity_score_pct(spark, sf):
    return N.score_percent(N.decoder_checks(X.frames(spark, sf), X.frame_signatures(spark, sf), slice_frames=16))


@query(
    "integrity_score_penalty",
    f"""WITH {_CHK}, fc AS (SELECT video_id, count(*) AS changes FROM
        (SELECT video_id, fps, lag(fps) OVER (PARTITION BY video_id ORDER BY frame_number) AS pfps FROM fs) WHERE abs(fps-pfps) > greatest(pfps*0.20, 5.0) GROUP BY 1),
    d AS (SELECT *, coalesce(abs(mean_luma-pm)<1, false) AS dup FROM fl),
    r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_number) - row_number() OVER (PARTITION BY video_id, dup ORDER BY frame_number) AS grp FROM d),
    g AS (SELECT video_id, grp, count(*) AS k FROM r WHERE dup GROUP BY 1,2), dr AS (SELECT video_id, count(*) AS runs FROM g WHERE k>=5 GROUP BY 1),
    p AS (SELECT ck.video_id, greatest(0, least(100, 100 - CASE WHEN gaps=0 AND back=0 THEN 0 ELSE 15 END - CASE WHEN gaps=0 AND bad=0 THEN 0 ELSE 15 END
      - CASE WHEN coalesce(changes,0)=0 THEN 0 ELSE 10 END - CASE WHEN coalesce(runs,0)=0 THEN 0 ELSE 15 END - CASE WHEN bad>0 THEN 20 ELSE 0 END
      - CASE WHEN gaps>0 THEN 15 ELSE 0 END - CASE WHEN sizes=1 THEN 0 ELSE 10 END
      - CASE WHEN jumps<=greatest(5, CAST(floor(n*0.08) AS BIGINT)) THEN 0 ELSE 10 END)) AS integrity_score
      FROM ck LEFT JOIN fc USING (video_id) LEFT JOIN dr USING (video_id))
    SELECT *, CASE WHEN integrity_score>=90 THEN 'PASS' WHEN integrity_score>=70 THEN 'REVIEW' ELSE 'ANOMALY' END AS overall_status FROM p""",
)
def integrity_score_penalty(spark, sf):
    return N.score_penalty(N.report_checks(X.frames(spark, sf), slice_frames=16))
