"""Queries over the driver's tables, one for each operator, and the SQL that the ones expressible in it are compared with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import sql, views
from .functions import body, geometry, pixels, pose, quality, text, vectors
from .functions.categories import CATEGORIES
from .functions.text import PALETTE
from .operators import clustering, dedup, reports, sampling, selection, synthesis
from .params import Clustering, Dedup, Sampling, Selection

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The stand-in data is spread over days: links need a wide window and a loose hash to occur at all.
DEDUP = Dedup(window=21600.0)
CLUSTERS = Clustering(cosine=0.1, merge_cosine=0.9, min_size=4)


#: Numbers with a point are decimals in DuckDB, doubles here.
DECIMAL = re.compile(r"(?<![\w.'])(\d*\.\d+)(?![\w.:'])")


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = DECIMAL.sub(r"(\1::DOUBLE)", oracle)
        return f

    return add


def r6(c):
    return F.round(c, 6)


LOOKS = f"WITH {sql.DIMS}, c AS (SELECT *, 0.9 AS conf FROM d), {sql.looks('c')}"
CANDS = f"WITH {sql.SIGHTINGS}, {sql.looks('s')}"

URLS = [
    "https://www.youtube.com/watch?v=dQw4w9WgXcQ", "http://youtu.be/dQw4w9WgXcQ?t=3", "youtube.com/shorts/abcdefghijk", "https://m.youtube.com/live/ABCDEFGHIJKL", "https://music.youtube.com/watch?list=1&v=___________",
    "https://www.youtube-nocookie.com/embed/a1b2c3d4e5f", "  https://www.youtube.com/videos/aaaaaaaaaaa  ", "https://www.youtube.com/watch?v=short", "https://example.com/watch?v=dQw4w9WgXcQ", "ftp://youtube.com/watch?v=dQw4w9WgXcQ", "", "   ", None,
]
_URL_ROWS = f"{sql.values([(u,) for u in URLS], 'url')}, u AS (SELECT url FROM t UNION ALL SELECT url FROM pages)"
_ID = "coalesce(nullif(regexp_extract({0}, '(?:v=|/videos/|embed/|shorts/|live/)([A-Za-z0-9_-]{{11}})', 1), ''), nullif(regexp_extract({0}, 'youtu\\.be/([A-Za-z0-9_-]{{11}})', 1), ''))"


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(u,) for u in URLS], "url string").union(views.read(spark, sf_dir, "pages").select("url"))


@query(f"WITH {_URL_ROWS} SELECT url, coalesce(regexp_matches(trim(url), '(?i)^(https?://)?(www\\.|m\\.|music\\.)?(youtube\\.com|youtube-nocookie\\.com|youtu\\.be)/') AND {_ID.format('trim(url)')} IS NOT NULL, false) AS ok FROM u")
def s1_url_validate(spark, sf_dir):
    return _urls(spark, sf_dir).select("url", text.is_video_url(F.col("url")).alias("ok"))


@query(f"WITH {_URL_ROWS} SELECT url, {_ID.format('url')} AS video_id FROM u")
def s2_video_id(spark, sf_dir):
    return _urls(spark, sf_dir).select("url", text.video_id(F.col("url")).alias("video_id"))


MESSAGES = ["ERROR: Private video. Sign in", "Sign in to confirm your age", "This is age restricted", "restricted page", "Video unavailable", "it has been removed by the user", "Unsupported URL: x", "HTTP 500", "", None]
_MSG = "lower(msg)"


@query(f"""WITH {sql.values([(m,) for m in MESSAGES], 'msg')} SELECT msg, CASE WHEN contains({_MSG}, 'private video') THEN 'SourceUnavailable' WHEN contains({_MSG}, 'sign in to confirm your age') OR (contains({_MSG}, 'age') AND contains({_MSG}, 'restrict')) THEN 'SourceUnavailable'
    WHEN contains({_MSG}, 'video unavailable') OR contains({_MSG}, 'has been removed') THEN 'SourceUnavailable' WHEN contains({_MSG}, 'unsupported url') THEN 'InvalidSource' ELSE 'FetchFailed' END AS error FROM t""")
def s4_error_mapping(spark, sf_dir):
    return spark.createDataFrame([(m,) for m in MESSAGES], "msg string").select("msg", text.error_class(F.col("msg")).alias("error"))


VIDEOS = [("a", 30.0, 900), ("b", 25.0, 500), ("c", 0.0, 61), ("d", None, 100), ("e", 29.97, 3000), ("f", 60.0, 20000), ("g", 24.0, 0), ("h", 5.0, 1)]
_VIDEOS = sql.values(VIDEOS, "video_id, fps, total_frames")


def _videos(spark):
    return spark.createDataFrame(VIDEOS, "video_id string, fps double, total_frames long")


@query(f"WITH {_VIDEOS} SELECT video_id, coalesce(nullif(fps, 0), 30.0) AS fps, total_frames, round(total_frames / coalesce(nullif(fps, 0), 30.0), 6) AS duration FROM t")
def s6_probe(spark, sf_dir):
    p = sampling.probe(F.col("total_frames"), F.col("fps"))
    return _videos(spark).select("video_id", p.alias("p")).select("video_id", "p.fps", "p.total_frames", r6(F.col("p.duration")).alias("duration"))


@query(f"""WITH {_VIDEOS}, r AS (SELECT *, coalesce(nullif(fps, 0), 30.0) AS rate FROM t),
    q AS (SELECT *, round_even(1.5 * rate, 0)::BIGINT AS first, least(CASE WHEN total_frames > 0 THEN round_even(least(total_frames / rate, 61.5) * rate, 0)::BIGINT ELSE 0 END, total_frames) AS last, greatest(1, round_even(rate / 3.0, 0)::BIGINT) AS s0 FROM r),
    p AS (SELECT *, greatest(1, last - first) AS span FROM q), o AS (SELECT *, CASE WHEN span // s0 > 40 THEN greatest(s0, ceil(span / 40.0)::BIGINT) ELSE s0 END AS stride FROM p)
    SELECT video_id, unnest(range(first, least(last, first + stride * 40), stride)) AS frame_number, round(unnest(range(first, least(last, first + stride * 40), stride)) / rate, 6) AS "timestamp" FROM o WHERE last > first""")
def p1_stride_sampling(spark, sf_dir):
    got = sampling.sample_frames(_videos(spark), Sampling(fps=3.0, max_frames=40, start=1.5, max_duration=60.0))
    return got.select("video_id", "frame_number", r6(F.col("timestamp")).alias("timestamp"))


@query(f"WITH {sql.DIMS}, x AS (SELECT id, unnest(range(3)) AS position, e FROM d), y AS (SELECT id, position, abs(e[position + 1]) AS score FROM x) SELECT id, position, round(score, 6) AS score FROM y WHERE score >= 0.1")
def p2_explode_detections(spark, sf_dir):
    det = F.array(*(F.struct(F.abs(views.e(k)).alias("score")) for k in range(3)))
    got = sampling.explode_detections(views.dims(spark, sf_dir).select("id", det.alias("detections")), least_score=0.1)
    return got.select("id", F.col("position").cast("long").alias("position"), r6(F.col("detection.score")).alias("score"))


@query(f"""WITH {sql.DIMS}, b AS (SELECT id, id // 4 AS frame, trunc(abs({sql.e(56)}) * 400)::INT AS w, trunc(abs({sql.e(57)}) * 400)::INT AS h FROM d),
    k AS (SELECT *, least(w, h) >= 40 AS ok, bool_or(least(w, h) >= 40) OVER (PARTITION BY frame) AS any_ok, row_number() OVER (PARTITION BY frame ORDER BY w * h DESC, id) AS rn FROM b) SELECT frame, id, w, h FROM k WHERE ok OR (NOT any_ok AND rn = 1)""")
def p3_small_detection_filter(spark, sf_dir):
    b = geometry.box(F.lit(0), F.lit(0), F.abs(views.e(56)) * 400, F.abs(views.e(57)) * 400)
    rows = views.dims(spark, sf_dir).select("id", F.expr("id div 4").alias("frame"), b.alias("bbox"))
    return sampling.keep_large(rows, ["frame"], ["id"]).select("frame", "id", "bbox.w", "bbox.h")


_CROP = ["x1", "y1", "x2", "y2"]


def _crop(df: DataFrame, crop) -> DataFrame:
    return df.select("id", crop.alias("c")).select("id", *(F.col(f"c.{k}").cast("int").alias(k) for k in _CROP))


_HALF = "greatest(w, h) * 1.7 / 2.0"


@query(f"""{LOOKS}, p AS (SELECT id, x, y, w, h, trunc(greatest(0.0, x + w / 2.0 - {_HALF}))::INT AS x1, trunc(greatest(0.0, y + h / 2.0 - {_HALF}))::INT AS y1, trunc(least(1920.0, x + w / 2.0 + {_HALF}))::INT AS x2, trunc(least(1080.0, y + h / 2.0 + {_HALF}))::INT AS y2 FROM k)
    SELECT id, CASE WHEN x2 <= x1 OR y2 <= y1 THEN x ELSE x1 END AS x1, CASE WHEN x2 <= x1 OR y2 <= y1 THEN y ELSE y1 END AS y1, CASE WHEN x2 <= x1 OR y2 <= y1 THEN x + w ELSE x2 END AS x2, CASE WHEN x2 <= x1 OR y2 <= y1 THEN y + h ELSE y2 END AS y2 FROM p""")
def p5_landmark_crop(spark, sf_dir):
    return _crop(views.looks(spark, sf_dir), geometry.landmark_crop(F.col("bbox"), F.lit(1920), F.lit(1080)))


@query(f"WITH {sql.DIMS} SELECT id, round(len(list_filter(range(1, 33), lambda i: e[2 * i - 1] * 8 BETWEEN -0.05 AND 1.05 AND e[2 * i] * 8 BETWEEN -0.05 AND 1.05)) / 32.0, 6) AS plausibility FROM d")
def p6_landmark_plausibility(spark, sf_dir):
    points = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct((F.get("e", 2 * i) * 8).alias("x"), (F.get("e", 2 * i + 1) * 8).alias("y")))
    return views.dims(spark, sf_dir).select("id", r6(quality.plausibility(points)).alias("plausibility"))


@query(f"WITH {sql.DIMS} SELECT id, round(least(1.0, greatest(0.0, 0.9 * (0.5 + 0.5 * abs({sql.e(3)})))), 6) AS confidence FROM d")
def p7_landmark_confidence(spark, sf_dir):
    return views.dims(spark, sf_dir).select("id", r6(quality.landmark_confidence(F.lit(0.9), F.abs(views.e(3)))).alias("confidence"))


@query(f"{LOOKS}, p AS (SELECT id, x + w / 2.0 AS cx, y + h / 2.0 - h * 0.15 AS cy, greatest(w, h) * 2.6 AS side FROM k) SELECT id, round_even(cx - side / 2, 0)::INT AS x1, round_even(cy - side / 2, 0)::INT AS y1, round_even(cx + side / 2, 0)::INT AS x2, round_even(cy + side / 2, 0)::INT AS y2 FROM p")
def p8_face_crop(spark, sf_dir):
    return _crop(views.looks(spark, sf_dir), geometry.face_crop(F.col("bbox")))


@query(f"""{LOOKS}, p AS (SELECT id, x + w / 2.0 AS cx, w * 2.4 AS cw, w * 2.4 * 5 / 4 AS ch, y - h * 0.9 AS top FROM k), q AS (SELECT *, (least(top + ch, 1080.0) - greatest(top, 0.0)) / ch >= 0.7 AS ok FROM p)
    SELECT id, CASE WHEN ok THEN round_even(cx - cw / 2, 0)::INT END AS x1, CASE WHEN ok THEN round_even(top, 0)::INT END AS y1, CASE WHEN ok THEN round_even(cx + cw / 2, 0)::INT END AS x2, CASE WHEN ok THEN round_even(top + ch, 0)::INT END AS y2 FROM q""")
def p9_portrait_crop(spark, sf_dir):
    return _crop(views.looks(spark, sf_dir), geometry.portrait_crop(F.col("bbox"), F.lit(1080)))


@query(f"{LOOKS} SELECT id, round_even(x + w / 2.0 - least(1920.0, w * 4.0) / 2, 0)::INT AS x1, 0 AS y1, round_even(x + w / 2.0 + least(1920.0, w * 4.0) / 2, 0)::INT AS x2, 1080 AS y2 FROM k")
def p10_body_crop(spark, sf_dir):
    return _crop(views.looks(spark, sf_dir), geometry.body_crop(F.col("bbox"), F.lit(1920), F.lit(1080)))


RAW = [("1",), ("2.5",), ("x",), (None,), ("",), ("-3",)]


@query(f"WITH {sql.values(RAW, 'raw')} SELECT raw, try_cast(raw AS DOUBLE) AS value FROM t WHERE try_cast(raw AS DOUBLE) IS NOT NULL")
def p11_skip_bad_items(spark, sf_dir):
    return spark.createDataFrame(RAW, "raw string").withColumn("value", F.expr("try_cast(raw AS DOUBLE)")).where("value is not null")


@query(f"{LOOKS} SELECT id, pose, array_to_string(tags, ',') AS tags, array_to_string(cats, ',') AS categories FROM k")
def p12_categories(spark, sf_dir):
    return views.looks(spark, sf_dir).select("id", "pose", F.array_join("expressions", ",").alias("tags"), F.array_join("categories", ",").alias("categories"))


# Joins.

_MISMATCH = "len(list_filter(range(1, 65), lambda i: (x.e[i] >= 0) <> (y.e[i] >= 0)))"
_DOT = "list_sum(list_transform(range(1, 65), lambda i: x.e[i] * y.e[i]))"
_NORM = "sqrt(list_sum(list_transform({0}.e, lambda v: v * v)))"
_BDOT = "list_sum(list_transform(range(1, 29), lambda i: least(1.0, 2.5 * abs(x.e[i])) * least(1.0, 2.5 * abs(y.e[i]))))"
_BNORM = "sqrt(list_sum(list_transform(range(1, 29), lambda i: least(1.0, 2.5 * abs({0}.e[i])) * least(1.0, 2.5 * abs({0}.e[i])))))"
EDGES = f"""edges AS (SELECT x.id AS a, y.id AS b, x.identity FROM s x JOIN s y ON x.identity = y.identity AND (x.t < y.t OR (x.t = y.t AND x.ord < y.ord)) AND y.t - x.t <= {DEDUP.window}
    WHERE {_MISMATCH} <= 8 AND {_DOT} / ({_NORM.format('x')} * {_NORM.format('y')}) >= 0.93 AND {_BDOT} / ({_BNORM.format('x')} * {_BNORM.format('y')}) >= 0.97)"""


@query(f"WITH {sql.SIGHTINGS}, {EDGES} SELECT a, b FROM edges")
def j1_d5_window_duplicate_edges(spark, sf_dir):
    return dedup.duplicate_edges(views.candidates(spark, sf_dir), DEDUP).select("a", "b")


_CENTS = f"""WITH {sql.DIMS}, m AS (SELECT label, i, avg(e[i]) AS v FROM d, range(1, 65) r(i) GROUP BY label, i), n AS (SELECT label, sqrt(sum(v * v)) + 1e-8 AS len FROM m GROUP BY label),
    c AS (SELECT label, list(v / len ORDER BY i) AS e FROM m JOIN n USING (label) GROUP BY label)"""


def _label_centroids(spark, sf_dir):
    return clustering.centroids(views.dims(spark, sf_dir), "label", "e")


@query(f"{_CENTS} SELECT x.label AS a, y.label AS b, round({_DOT}, 6) AS similarity FROM c x JOIN c y ON x.label < y.label WHERE {_DOT} >= 0.05")
def j2_centroid_pairs(spark, sf_dir):
    got = clustering.centroid_pairs(_label_centroids(spark, sf_dir), 0.05, "label")
    return got.select("a", "b", r6(F.col("similarity")).alias("similarity"))


REFERENCE = [((i * 37) % 19 - 9) / 10.0 for i in range(64)]


@query(f"{_CENTS}, r AS (SELECT {REFERENCE!r}::DOUBLE[] AS e), q AS (SELECT x.label, {_DOT} / ({_NORM.format('x')} * {_NORM.format('y')}) AS s FROM c x, r y) SELECT label, round(s, 6) AS similarity FROM q ORDER BY s DESC, label LIMIT 1")
def j3_nearest_centroid(spark, sf_dir):
    got = clustering.nearest_centroid(_label_centroids(spark, sf_dir), REFERENCE, "label")
    return got.select("label", r6(F.col("similarity")).alias("similarity"))


def _poses(spark, sf_dir):
    """Four poses of 33 landmarks a frame, and two faces."""
    at = lambda i, j: F.get("e", F.pmod(i * 3 + j, F.lit(64)))
    landmark = lambda i: F.struct((0.5 + 2.0 * at(i, 0)).alias("x"), (0.5 + 2.0 * at(i, 1)).alias("y"), F.when(F.pmod(F.col("id") + i, F.lit(7)) == 0, F.lit(None)).otherwise(4.0 * F.abs(at(i, 2))).alias("visibility"))
    poses = views.dims(spark, sf_dir).select(F.expr("id div 4").alias("frame"), (F.col("id") % 4).alias("pose_no"), F.transform(F.sequence(F.lit(0), F.lit(32)), landmark).alias("pose"))
    faces = views.dims(spark, sf_dir).where("id % 4 < 2").select(F.expr("id div 4").alias("frame"), F.col("id").alias("face_id"), (0.5 + views.e(20)).alias("cx"), (0.5 + views.e(21)).alias("cy"))
    return faces, poses


_AT = "e[(({0} * 3 + {1}) % 64) + 1]"
_VIS = "CASE WHEN (id + {0}) % 7 = 0 THEN NULL ELSE 4.0 * abs(" + _AT.format("{0}", 2) + ") END"
_SEEN = lambda at: "greatest(" + ", ".join(f"coalesce({_VIS.format(i)}, 0.0)" for i in at) + ") >= 0.5"


@query(f"""WITH {sql.DIMS}, p AS (SELECT id // 4 AS frame, id % 4 AS pose_no, 0.5 + 2.0 * {_AT.format(0, 0)} AS nx, 0.5 + 2.0 * {_AT.format(0, 1)} AS ny, {_VIS.format(0)} AS nv,
        CASE WHEN {_SEEN((25, 26, 27, 28))} THEN 'full_body' WHEN {_SEEN((23, 24))} THEN 'half_body' WHEN {_SEEN((11, 12))} THEN 'upper_body' ELSE 'none' END AS body FROM d),
    f AS (SELECT id // 4 AS frame, id AS face_id, 0.5 + {sql.e(20)} AS cx, 0.5 + {sql.e(21)} AS cy FROM d WHERE id % 4 < 2),
    j AS (SELECT f.frame, face_id, coalesce(body, 'none') AS body, row_number() OVER (PARTITION BY face_id ORDER BY (nx - cx) * (nx - cx) + (ny - cy) * (ny - cy) NULLS LAST, pose_no) AS rn FROM f LEFT JOIN p ON p.frame = f.frame AND (nv IS NULL OR nv >= 0.5))
    SELECT frame, face_id, body FROM j WHERE rn = 1""")
def j4_f12_body_visibility(spark, sf_dir):
    faces, poses = _poses(spark, sf_dir)
    return body.nearest_pose(faces, poses).select("frame", "face_id", body.visibility(F.col("pose")).alias("body"))


_RGB = [f"floor(abs({sql.e(k)}) * 600)" for k in (30, 31, 32)]


@query(f"""WITH {sql.DIMS}, {sql.values([(i, n, *c) for i, (n, c) in enumerate(PALETTE.items())], 'i, name, pr, pg, pb')}, v AS (SELECT id, {_RGB[0]} AS r, {_RGB[1]} AS g, {_RGB[2]} AS b FROM d),
    q AS (SELECT id, name, row_number() OVER (PARTITION BY id ORDER BY (r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb), i) AS rn FROM v, t) SELECT id, name AS colour FROM q WHERE rn = 1""")
def j5_nearest_colour(spark, sf_dir):
    r, g, b = (F.floor(F.abs(views.e(k)) * 600) for k in (30, 31, 32))
    return views.dims(spark, sf_dir).select("id", text.nearest_colour(r, g, b).alias("colour"))


@query("SELECT o.o_orderkey AS id, c.c_name AS name FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey")
def j6_id_lookup(spark, sf_dir):
    """Ids looked up in a dimension; misses are left out."""
    orders = views.read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return orders.join(views.read(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey").select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("name"))


@query(f"{LOOKS}, f AS (SELECT id, 'out/faces/' || printf('frame_%08d.jpg', id) AS file FROM k) SELECT id, regexp_extract(file, '[^/]+$') AS base FROM f")
def j7_file_reverse_lookup(spark, sf_dir):
    files = views.dims(spark, sf_dir).select("id", F.concat(F.lit("out/faces/"), F.format_string("frame_%08d.jpg", "id")).alias("file"))
    wanted = files.select(F.regexp_extract("file", "[^/]+$", 0).alias("base"))
    return files.withColumn("base", F.regexp_extract("file", "[^/]+$", 0)).join(wanted, "base").select("id", "base")


_CATS = sql.values([(i, n) for i, (n, _, _) in enumerate(CATEGORIES, 1)], "rank, category")


@query(f"{LOOKS}, {_CATS}, h AS (SELECT DISTINCT unnest(cats) AS category FROM k WHERE quality >= 0.75) SELECT rank, category FROM t WHERE category NOT IN (SELECT category FROM h)")
def j8_f17_missing_categories(spark, sf_dir):
    return synthesis.missing_categories(views.looks(spark, sf_dir), 0.75).select("rank", "category")


@query(f"{LOOKS} SELECT id FROM k WHERE id NOT IN (SELECT id FROM k WHERE pose = 'front')")
def j9_already_used(spark, sf_dir):
    rows = views.looks(spark, sf_dir)
    return rows.select("id").join(rows.where("pose = 'front'").select("id"), "id", "left_anti")


_ADJ = sql.values([(i, n, k, p) for i, (n, (own, _)) in enumerate(synthesis.SPEC.items(), 1) for k, p in enumerate(synthesis.ADJACENCY[own] if own else synthesis.ANY_POSE, 1)], "rank, category, k, pose")


@query(f"""{LOOKS}, {_ADJ}, u AS (SELECT DISTINCT category FROM t),
    q AS (SELECT u.category, s.id, s.pose, row_number() OVER (PARTITION BY u.category ORDER BY coalesce(t.k, 99), s.quality DESC, s.id) AS rn FROM u, k s LEFT JOIN t ON t.category = u.category AND t.pose = s.pose)
    SELECT category, id AS base_id, pose AS base_pose FROM q WHERE rn = 1""")
def j10_f18_base_pick(spark, sf_dir):
    rows = views.looks(spark, sf_dir).withColumn("ord", F.col("id"))
    return synthesis.pick_bases(rows, synthesis.category_table(rows)).select("category", "base_id", "base_pose")


# Aggregates.


@query(f"{_CENTS} SELECT label, pos, round(v, 6) AS v FROM (SELECT label, unnest(range(64)) AS pos, unnest(e) AS v FROM c)")
def a2_c1_centroids(spark, sf_dir):
    return _label_centroids(spark, sf_dir).select("label", F.posexplode("centroid").alias("pos", "v")).select("label", F.col("pos").cast("long").alias("pos"), r6(F.col("v")).alias("v"))


@query(f"{CANDS} SELECT identity AS identity_cluster, count(*) AS n, printf('frame_%08d.jpg', arg_max(ord, {{'c': conf, 'o': -ord}})) AS representative FROM k GROUP BY identity")
def a3_cluster_summary(spark, sf_dir):
    return clustering.summarize(views.candidates(spark, sf_dir))


@query(f"WITH {sql.SIGHTINGS}, z AS (SELECT identity, count(*) AS n, min(id) AS first FROM s GROUP BY identity HAVING count(*) >= 4), o AS (SELECT identity, row_number() OVER (ORDER BY n DESC, first) - 1 AS k FROM z) SELECT id, k::INT AS identity_cluster FROM s LEFT JOIN o USING (identity)")
def a1_a4_a5_renumber(spark, sf_dir):
    rows = views.sightings(spark, sf_dir).select("id", F.col("identity_cluster").alias("cluster"))
    return clustering.number_clusters(rows, 4)


@query(f"WITH {sql.SIGHTINGS}, z AS (SELECT identity, count(*) AS n FROM s GROUP BY identity) SELECT round(max(n) / sum(n), 6) AS ratio, max(n) / sum(n) >= 0.7 AS dominant FROM z")
def a6_dominance(spark, sf_dir):
    sizes = views.sightings(spark, sf_dir).groupBy("identity_cluster").agg(F.count("*").alias("n"))
    ratio = F.max("n") / F.sum("n")
    return sizes.agg(r6(ratio).alias("ratio"), (ratio >= Clustering().dominance).alias("dominant"))


@query(f"{LOOKS}, b AS (SELECT least(90, trunc(quality * 10)::INT * 10) AS lo FROM k) SELECT lo || '-' || (lo + 10) || '%' AS bin, count(*) AS n FROM b GROUP BY 1")
def a7_quality_histogram(spark, sf_dir):
    return reports.quality_distribution(views.looks(spark, sf_dir))


@query(f"{CANDS}, x AS (SELECT unnest(tags) AS tag FROM k) SELECT tag, count(*) AS n FROM x GROUP BY tag")
def a8_tag_distribution(spark, sf_dir):
    return reports.tag_distribution(views.candidates(spark, sf_dir))


@query(f"{LOOKS} SELECT pose, count(*) AS n FROM k GROUP BY pose")
def a9_pose_distribution(spark, sf_dir):
    return reports.pose_distribution(views.looks(spark, sf_dir))


@query(f"""{LOOKS}, g AS (SELECT least(90, trunc(quality * 10)::INT * 10) AS lo FROM k), x AS (SELECT unnest(tags) AS tag FROM k)
    SELECT 'v1' AS video, (SELECT count(*) FROM k) AS faces_found, (SELECT string_agg(id::VARCHAR, ',' ORDER BY id) FROM k) AS images, (SELECT string_agg(b || '=' || n, ',' ORDER BY b) FROM (SELECT lo || '-' || (lo + 10) || '%' AS b, count(*) AS n FROM g GROUP BY 1)) AS quality,
        (SELECT string_agg(tag || '=' || n, ',' ORDER BY tag) FROM (SELECT tag, count(*) AS n FROM x GROUP BY 1)) AS expressions""")
def a10_manifest(spark, sf_dir):
    """A manifest of all looks, flattened."""
    images = views.looks(spark, sf_dir).select(F.col("id").alias("position"), "id", "quality", "pose", "expressions")
    m = reports.manifest(images, {"id": "v1"}, {"faces_found": images.count()})
    flat = lambda c: F.array_join(F.transform(F.sort_array(F.map_entries(c)), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")
    return m.select(F.col("video.id").alias("video"), "faces_found", F.array_join(F.transform("images", lambda i: i["id"].cast("string")), ",").alias("images"), flat("quality_distribution").alias("quality"), flat("expression_distribution").alias("expressions"))


_BEST = "row_number() OVER (PARTITION BY {0} ORDER BY quality DESC, id) AS rn"


@query(f"{LOOKS} SELECT pose, id FROM (SELECT pose, id, {_BEST.format('pose')} FROM k) WHERE rn = 1")
def a11_best_per_pose(spark, sf_dir):
    return reports.best_by(views.looks(spark, sf_dir), "pose", order="id").select("pose", "id")


@query(f"{LOOKS}, x AS (SELECT unnest(tags) AS tag, id, quality FROM k) SELECT tag, id FROM (SELECT tag, id, {_BEST.format('tag')} FROM x) WHERE rn = 1")
def a11_best_per_tag(spark, sf_dir):
    return reports.best_by(views.looks(spark, sf_dir).withColumn("tag", F.explode("expressions")), "tag", order="id").select("tag", "id")


@query(f"{LOOKS}, a AS (SELECT id, 0 AS part, row_number() OVER (ORDER BY id) AS pos FROM k WHERE pose = 'front' UNION ALL SELECT id, 1, row_number() OVER (ORDER BY id DESC) FROM k WHERE quality >= 0.6), f AS (SELECT id, min({{'p': part, 'a': pos}}) AS m FROM a GROUP BY id) SELECT id, row_number() OVER (ORDER BY m, id) AS position FROM f")
def a12_ordered_union(spark, sf_dir):
    rows = views.looks(spark, sf_dir)
    a = rows.where("pose = 'front'").select("id", F.col("id").alias("pick"))
    b = rows.where("quality >= 0.6").select("id", (-F.col("id")).alias("pick"))
    return reports.union_ordered([a, b]).select("id", F.col("position").cast("long").alias("position"))


@query(f"WITH {sql.values([(n,) for n in sorted(views.BLENDSHAPES)], 'name')} SELECT name FROM t")
def a13_global_keys(spark, sf_dir):
    return reports.blend_keys(views.looks(spark, sf_dir))


_GRAY = "list_transform(e, lambda v: least(255, floor(abs(v) * 900))::INT)"


@query(f"WITH {sql.DIMS}, g AS (SELECT unnest({_GRAY}) AS bin FROM d) SELECT bin, count(*) AS n FROM g GROUP BY bin")
def a14_intensity_histogram(spark, sf_dir):
    gray = F.transform("e", lambda v: F.least(F.lit(255), F.floor(F.abs(v) * 900)).cast("int"))
    return views.dims(spark, sf_dir).select(F.explode(gray).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


# Clustering: in SQL a merge of the nearest two clusters a round, over all pairs.

_LINKAGE = f"""WITH RECURSIVE {sql.DIMS}, unit AS (SELECT id, list_transform(e, lambda v: v / (sqrt(list_sum(list_transform(e, lambda w: w * w))) + 1e-8)) AS e FROM d),
    pairs AS MATERIALIZED (SELECT x.id AS i, y.id AS j, round(greatest(0, list_sum(list_transform(x.e, lambda v: v * v)) + list_sum(list_transform(y.e, lambda v: v * v)) - 2 * list_dot_product(x.e, y.e)), 12) AS far FROM unit x JOIN unit y ON x.id <> y.id),
    link AS (SELECT 0 AS step, id AS i, id AS label FROM d UNION ALL
        SELECT step + 1, l.i, CASE WHEN l.label = p.m.b THEN p.m.a ELSE l.label END FROM link l,
            (SELECT arg_min({{'a': a, 'b': b}}, {{'far': far, 'a': a, 'b': b}}) AS m FROM (SELECT x.label AS a, y.label AS b, max(far) AS far FROM link x JOIN pairs ON pairs.i = x.i JOIN link y ON y.i = pairs.j WHERE x.label < y.label GROUP BY 1, 2 HAVING max(far) < {2 - 2 * CLUSTERS.cosine})) p
        WHERE p.m IS NOT NULL),
    found AS (SELECT i AS id, label AS cluster FROM link WHERE step = (SELECT max(step) FROM link))"""


@query(f"{_LINKAGE} SELECT id, cluster FROM found")
def c2_complete_linkage(spark, sf_dir):
    return clustering.linkage_clusters(views.dims(spark, sf_dir).select("id", F.col("e").alias("embedding")), CLUSTERS)


@query(f"""{_CENTS.replace('WITH', 'WITH RECURSIVE', 1)}, p AS (SELECT x.label AS a, y.label AS b FROM c x JOIN c y ON x.label <> y.label WHERE {_DOT} >= 0.12), r AS (SELECT label AS a, label AS b FROM c UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b),
    z AS (SELECT a AS label, min(b) AS component FROM r GROUP BY a) SELECT d.id, component AS cluster FROM d JOIN z USING (label)""")
def c3_centroid_merge(spark, sf_dir):
    rows = views.dims(spark, sf_dir).select("id", F.col("e").alias("embedding"), F.col("label").alias("cluster"))
    return clustering.merge_clusters(rows.select("id", "cluster"), rows, 0.12)


@query(f"""{_LINKAGE}, m AS (SELECT cluster, k, avg(e[k]) AS v FROM found JOIN d USING (id), range(1, 65) r(k) GROUP BY cluster, k), n AS (SELECT cluster, sqrt(sum(v * v)) + 1e-8 AS len FROM m GROUP BY cluster),
    c AS (SELECT cluster, list(v / len ORDER BY k) AS e FROM m JOIN n USING (cluster) GROUP BY cluster), near AS (SELECT x.cluster AS a, y.cluster AS b FROM c x JOIN c y ON x.cluster <> y.cluster WHERE {_DOT} >= {CLUSTERS.merge_cosine}),
    reach AS (SELECT cluster AS a, cluster AS b FROM c UNION SELECT reach.a, near.b FROM reach JOIN near ON near.a = reach.b), merged AS (SELECT id, min(b) AS cluster FROM found JOIN reach ON reach.a = found.cluster GROUP BY id),
    sizes AS (SELECT cluster, count(*) AS n, min(id) AS first FROM merged GROUP BY cluster HAVING count(*) >= {CLUSTERS.min_size}), numbered AS (SELECT cluster, (row_number() OVER (ORDER BY n DESC, first) - 1)::INT AS identity_cluster FROM sizes)
    SELECT id, identity_cluster FROM merged LEFT JOIN numbered USING (cluster)""")
def c4_cluster_identities(spark, sf_dir):
    rows = views.dims(spark, sf_dir).select("id", F.col("e").alias("embedding"))
    return clustering.cluster_identities(rows, CLUSTERS).select("id", "identity_cluster")


@query(f"WITH {sql.SIGHTINGS}, z AS (SELECT identity, count(*) AS n FROM s GROUP BY identity) SELECT identity AS target, 'largest' AS why FROM z ORDER BY n DESC, identity LIMIT 1")
def c5_target_choice(spark, sf_dir):
    rows = views.sightings(spark, sf_dir).withColumns({"frame_path": F.lit("x"), "detection_confidence": F.lit(1.0)})
    target, why = clustering.choose_target(clustering.summarize(rows))
    return spark.createDataFrame([(target, why)], "target long, why string")


@query(f"WITH {sql.SIGHTINGS}, z AS (SELECT identity, count(*) AS n FROM s GROUP BY identity) SELECT identity AS target, 'number' AS why FROM z ORDER BY n DESC, identity LIMIT 1 OFFSET 2")
def c5_target_by_number(spark, sf_dir):
    """The third largest, as asked for."""
    rows = views.sightings(spark, sf_dir).withColumns({"frame_path": F.lit("x"), "detection_confidence": F.lit(1.0)})
    return spark.createDataFrame([clustering.choose_target(clustering.summarize(rows), person=3)], "target long, why string")


@query(f"""WITH {sql.SIGHTINGS}, m AS (SELECT identity, i, avg(e[i]) AS v FROM s, range(1, 65) r(i) GROUP BY identity, i), n AS (SELECT identity, sqrt(sum(v * v)) + 1e-8 AS len FROM m GROUP BY identity), c AS (SELECT identity, list(v / len ORDER BY i) AS e FROM m JOIN n USING (identity) GROUP BY identity),
    r AS (SELECT {REFERENCE!r}::DOUBLE[] AS e), q AS (SELECT x.identity, {_DOT} / ({_NORM.format('x')} * {_NORM.format('y')}) AS sim FROM c x, r y) SELECT identity AS target, CASE WHEN sim >= {Clustering().cosine} THEN 'reference' ELSE 'weak reference' END AS why FROM q ORDER BY sim DESC, identity LIMIT 1""")
def c5_target_by_reference(spark, sf_dir):
    """The identity whose centroid is most like a reference vector."""
    rows = views.candidates(spark, sf_dir)
    return spark.createDataFrame([clustering.choose_target(clustering.summarize(rows), rows, reference=REFERENCE)], "target long, why string")


# Near-duplicates.


@query(f"WITH {sql.SIGHTINGS}, o AS (SELECT *, lead(id) OVER (PARTITION BY identity ORDER BY t, ord) AS after FROM s) SELECT x.id AS a, y.id AS b, {_MISMATCH} AS hamming, round({_DOT} / ({_NORM.format('x')} * {_NORM.format('y')}), 6) AS cosine, round({_BDOT} / ({_BNORM.format('x')} * {_BNORM.format('y')}), 6) AS blend_cosine FROM o x JOIN s y ON y.id = x.after")
def d2_d3_d4_distances(spark, sf_dir):
    """Distances of every sighting from the next one of its person."""
    rows = views.candidates(spark, sf_dir)
    following = F.lead(F.struct("id", "phash", "embedding", "blendshapes")).over(Window.partitionBy("identity_cluster").orderBy("timestamp", "ord"))
    pairs = rows.select("id", "phash", "embedding", "blendshapes", following.alias("after")).where("after is not null")
    return pairs.select(F.col("id").alias("a"), F.col("after.id").alias("b"), vectors.hamming(F.col("phash"), F.col("after.phash")).cast("long").alias("hamming"), r6(vectors.cosine(F.col("embedding"), F.col("after.embedding"))).alias("cosine"), r6(vectors.map_cosine(F.col("blendshapes"), F.col("after.blendshapes"))).alias("blend_cosine"))


GROUPS = f"""WITH RECURSIVE {sql.SIGHTINGS}, {sql.looks('s')}, {EDGES}, both_ AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges), r AS (SELECT a AS id, a AS root FROM both_ UNION SELECT both_.b, r.root FROM r JOIN both_ ON both_.a = r.id),
    m AS (SELECT id, min(root) AS group_id FROM r GROUP BY id), g AS (SELECT k.id, coalesce(group_id, k.id) AS group_id, quality, t, ord FROM k LEFT JOIN m USING (id))"""


@query(f"{GROUPS} SELECT id, group_id FROM g")
def d6_duplicate_groups(spark, sf_dir):
    rows = views.candidates(spark, sf_dir)
    return dedup.groups(rows, dedup.duplicate_edges(rows, DEDUP)).select("id", "group_id")


@query(f"{GROUPS}, q AS (SELECT id, group_id, row_number() OVER w AS rank_in_group, first_value(id) OVER w AS best FROM g WINDOW w AS (PARTITION BY group_id ORDER BY quality DESC, t, ord)) SELECT id, group_id, rank_in_group, rank_in_group <= 2 AS kept, CASE WHEN rank_in_group > 2 THEN best END AS duplicate_of FROM q")
def d7_deduplicate(spark, sf_dir):
    got = dedup.deduplicate(views.candidates(spark, sf_dir), DEDUP)
    return got.select("id", "group_id", F.col("rank_in_group").cast("long").alias("rank_in_group"), "kept", "duplicate_of")


_SURVIVORS = f"{GROUPS}, q AS (SELECT id, group_id, row_number() OVER (PARTITION BY group_id ORDER BY quality DESC, t, ord) AS rk, min({{'t': t, 'o': ord}}) OVER (PARTITION BY group_id) AS first FROM g), kept AS (SELECT * FROM q WHERE rk <= 2)"


@query(f"{_SURVIVORS} SELECT (SELECT count(*) FROM events) AS frames_examined, (SELECT count(*) FROM s) AS faces_found, (SELECT count(DISTINCT identity) FROM s) AS identities_found, (SELECT count(*) FROM kept) AS after_dedup")
def a15_run_counts(spark, sf_dir):
    rows = views.candidates(spark, sf_dir)
    return reports.run_counts(views.read(spark, sf_dir, "events"), rows, rows.select("identity_cluster").distinct(), _survivors(spark, sf_dir))


# Selection: from what is left of each person in each video. In SQL a fold goes through its rules and rows one a round.


def _survivors(spark, sf_dir):
    return dedup.deduplicate(views.candidates(spark, sf_dir), DEDUP, ("video_id", "identity_cluster")).where("kept")


_SPACED = Selection(spacing=600.0)
_NAMES = [n for n, _, _ in CATEGORIES]


@query(f"""{_SURVIVORS}, w AS (SELECT video_id, identity, k.id, k.t, quality, cats, row_number() OVER (PARTITION BY video_id, identity ORDER BY quality DESC, first, rk) AS place FROM k JOIN kept USING (id) WHERE quality > 0),
    turns AS (SELECT 1 AS phase, list_position({_NAMES!r}, cat) AS rule, * EXCLUDE (cat) FROM (SELECT *, unnest(cats) AS cat FROM w WHERE quality >= {_SPACED.min_category_quality})
        UNION ALL SELECT 2, {len(_NAMES) + 1}, * FROM w WHERE quality >= {_SPACED.min_fill_quality} UNION ALL SELECT 3, {len(_NAMES) + 2}, * FROM w WHERE quality >= {_SPACED.min_fill_quality}),
    o AS (SELECT *, row_number() OVER (PARTITION BY video_id, identity ORDER BY rule, place) AS turn FROM turns),
    f AS (SELECT DISTINCT video_id, identity, 0::BIGINT AS turn, 0 AS rule, 0 AS phase, []::BIGINT[] AS picked, []::DOUBLE[] AS times, {[0] * len(_NAMES)} AS used, 0 AS covered, NULL::BIGINT AS id, NULL::VARCHAR[] AS cats, false AS ok FROM o
        UNION ALL SELECT video_id, identity, turn, rule, phase, CASE WHEN ok THEN list_append(picked, id) ELSE picked END, CASE WHEN ok THEN list_append(times, t) ELSE times END,
            CASE WHEN ok THEN list_transform(range(1, {len(_NAMES) + 1}), lambda i: used[i] + CASE WHEN phase = 1 THEN (i = rule)::INT ELSE list_contains(cats, ({_NAMES!r})[i])::INT END) ELSE used END, CASE WHEN ok AND phase = 1 THEN rule ELSE covered END, id, cats, ok
        FROM (SELECT f.video_id, f.identity, o.turn, o.rule, o.phase, f.picked, f.times, f.used, f.covered, o.id, o.cats, o.t, len(f.picked) < {_SPACED.pack} AND NOT list_contains(f.picked, o.id)
                AND CASE o.phase WHEN 1 THEN f.covered <> o.rule WHEN 2 THEN len(list_filter(f.times, lambda x: abs(x - o.t) < {_SPACED.spacing})) = 0 AND (len(o.cats) = 0 OR len(list_filter(o.cats, lambda c: f.used[list_position({_NAMES!r}, c)] < {_SPACED.per_category})) > 0) ELSE true END AS ok
            FROM f JOIN o ON o.video_id = f.video_id AND o.identity = f.identity AND o.turn = f.turn + 1))
    SELECT video_id, identity AS identity_cluster, id, len(picked)::INT AS pick, phase, array_to_string(cats, ',') AS categories FROM f WHERE ok""")
def k1_k4_diverse_pack(spark, sf_dir):
    got = selection.diverse_pack(_survivors(spark, sf_dir), _SPACED)
    return got.select("video_id", "identity_cluster", "id", "pick", "phase", F.array_join("categories", ",").alias("categories"))


_BONUS = "CASE pose WHEN 'front' THEN 1.0 WHEN 'three_quarter_left' THEN 0.85 WHEN 'three_quarter_right' THEN 0.85 WHEN 'looking_up' THEN 0.6 WHEN 'looking_down' THEN 0.6 ELSE 0.5 END"


@query(f"{LOOKS} SELECT id, round(0.55 * quality + 0.25 * sharpness + 0.20 * {_BONUS}, 6) AS score FROM k")
def k5_reference_score(spark, sf_dir):
    return views.looks(spark, sf_dir).select("id", r6(selection.reference_score(F.col("quality"), F.col("sharpness"), F.col("pose"))).alias("score"))


_PLACES = [n for n, _, _ in CATEGORIES] + [selection.UNCATEGORIZED]
_REF, _PER = Selection().reference, Selection().reference_per_category


@query(f"""{_SURVIVORS}, u AS (SELECT video_id, identity, k.id, 0.55 * quality + 0.25 * sharpness + 0.20 * {_BONUS} AS score, CASE WHEN len(cats) > 0 THEN cats ELSE ['{selection.UNCATEGORIZED}'] END AS cats, first, rk FROM k JOIN kept USING (id)),
    w AS (SELECT *, row_number() OVER (PARTITION BY video_id, identity ORDER BY score DESC, first, rk) AS place FROM u),
    f AS (SELECT DISTINCT video_id, identity, 0::BIGINT AS place, 0 AS n, {[0] * len(_PLACES)} AS used, NULL::BIGINT AS id, NULL::DOUBLE AS score, false AS ok FROM w
        UNION ALL SELECT video_id, identity, place, n + ok::INT, CASE WHEN ok THEN list_transform(range(1, {len(_PLACES) + 1}), lambda i: used[i] + list_contains(cats, ({_PLACES!r})[i])::INT) ELSE used END, id, score, ok
        FROM (SELECT f.video_id, f.identity, w.place, f.n, f.used, w.cats, w.id, w.score, f.n < {_REF} AND (f.n < {_REF // 2} OR len(list_filter(w.cats, lambda c: f.used[list_position({_PLACES!r}, c)] < {_PER})) > 0) AS ok FROM f JOIN w ON w.video_id = f.video_id AND w.identity = f.identity AND w.place = f.place + 1))
    SELECT video_id, identity AS identity_cluster, id, row_number() OVER (PARTITION BY video_id, identity ORDER BY place)::INT AS pick, round(score, 6) AS score FROM f WHERE ok""")
def k6_reference_pack(spark, sf_dir):
    got = selection.reference_pack(_survivors(spark, sf_dir))
    return got.select("video_id", "identity_cluster", "id", "pick", r6(F.col("score")).alias("score"))


@query(f"WITH {sql.SIGHTINGS}, q AS (SELECT identity AS identity_cluster, id, row_number() OVER (PARTITION BY identity ORDER BY ord) AS place FROM s) SELECT * FROM q WHERE place <= 12")
def k7_first_members(spark, sf_dir):
    got = reports.first_members(views.sightings(spark, sf_dir))
    return got.select("identity_cluster", "id", F.col("place").cast("long").alias("place"))


@query(f"WITH {_CATS} SELECT rank, category FROM t ORDER BY rank LIMIT 5")
def k8_cap_categories(spark, sf_dir):
    return synthesis.missing_categories(views.looks(spark, sf_dir), mode="full", most=5)


# Scalar functions.


@query(f"WITH {sql.DIMS} SELECT id, round(5000.0 * abs({sql.e(5)}) / (5000.0 * abs({sql.e(5)}) + 350.0), 6) AS sharpness FROM d")
def f1_sharpness(spark, sf_dir):
    return views.dims(spark, sf_dir).select("id", r6(quality.sharpness(5000.0 * F.abs(views.e(5)))).alias("sharpness"))


@query(f"WITH {sql.DIMS}, g AS (SELECT id, {_GRAY} AS g FROM d), m AS (SELECT id, len(list_filter(g, lambda v: v < 5)) / 64.0 AS lo, len(list_filter(g, lambda v: v >= 251)) / 64.0 AS hi, list_sum(g) / 64.0 AS mean FROM g) SELECT id, round(least(1.0, greatest(0.0, 1.0 - 0.7 * least(1.0, (lo + hi) * 3.0) - 0.3 * least(1.0, abs(mean - 128.0) / 128.0))), 6) AS exposure FROM m")
def f2_exposure(spark, sf_dir):
    gray = F.transform("e", lambda v: F.least(F.lit(255), F.floor(F.abs(v) * 900)).cast("int"))
    return views.dims(spark, sf_dir).select("id", gray.alias("g")).select("id", r6(quality.exposure(F.col("g"))).alias("exposure"))


@query(f"{LOOKS} SELECT id, round(face_resolution, 6) AS face_resolution, round(obstruction, 6) AS obstruction FROM k")
def f3_f5_resolution_obstruction(spark, sf_dir):
    return views.looks(spark, sf_dir).select("id", r6(F.col("face_resolution")).alias("face_resolution"), r6(F.col("obstruction")).alias("obstruction"))


@query(f"{LOOKS} SELECT id, round(quality, 6) AS quality FROM k")
def f6_quality(spark, sf_dir):
    return views.looks(spark, sf_dir).select("id", r6(F.col("quality")).alias("quality"))


@query(f"WITH {sql.DIMS} SELECT id, round(80.0 * {sql.e(1)}, 4) AS pitch, round(80.0 * {sql.e(2)}, 4) AS yaw, round(170.0 * {sql.e(3)}, 4) AS roll FROM d")
def f7_f8_euler_round_trip(spark, sf_dir):
    """Angles to a matrix and back are the same angles."""
    angles = [80.0 * views.e(1), 80.0 * views.e(2), 170.0 * views.e(3)]
    got = views.dims(spark, sf_dir).select("id", pose.rotation(*angles).alias("m")).select("id", pose.euler(F.col("m")).alias("a"))
    return got.select("id", *(F.round(F.col(f"a.{c}"), 4).alias(c) for c in ("pitch", "yaw", "roll")))


@query(f"{LOOKS} SELECT id, round(yaw, 6) AS yaw, round(pitch, 6) AS pitch, pose FROM k")
def f9_pose_bucket(spark, sf_dir):
    return views.looks(spark, sf_dir).select("id", r6(F.col("yaw")).alias("yaw"), r6(F.col("pitch")).alias("pitch"), "pose")


@query(f"WITH {sql.DIMS} SELECT id, CASE WHEN id % 2 = 0 THEN 0.0 ELSE round(30.0 * {sql.e(2)}, 4) END AS yaw, 'front' AS pose FROM d")
def f10_null_pose(spark, sf_dir):
    """Even ids have no matrix. The yaw's sign stays where it rounds to zero."""
    m = F.when(F.col("id") % 2 == 0, None).otherwise(pose.rotation(F.lit(0.0), 30.0 * views.e(2), F.lit(0.0)))
    got = views.dims(spark, sf_dir).select("id", m.alias("m")).select("id", pose.head_pose(F.col("m")).alias("p"))
    return got.select("id", (F.signum("p.yaw") * F.round(F.abs("p.yaw"), 4)).alias("yaw"), "p.pose")


@query(f"{LOOKS} SELECT id, array_to_string(tags, ',') AS tags FROM k")
def f11_expression_tags(spark, sf_dir):
    return views.looks(spark, sf_dir).select("id", F.array_join("expressions", ",").alias("tags"))


_PHRASES = "CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.TAG_PHRASES.items() if v) + " END"


@query(f"{LOOKS} SELECT id, array_to_string(list_concat(['person'], list_filter(list_transform(tags, lambda x: {_PHRASES}), lambda x: x IS NOT NULL), CASE WHEN id % 3 = 0 THEN ['red shirt'] ELSE [] END), ', ') AS caption FROM k")
def f13_caption(spark, sf_dir):
    colour = F.when(F.col("id") % 3 == 0, "red")
    return views.looks(spark, sf_dir).select("id", text.caption(F.lit("person"), F.col("expressions"), colour).alias("caption"))


@query(f"""{LOOKS}, p AS (SELECT id, greatest(0, x - trunc(w * 0.3)::INT) AS x1, least(1080, y + trunc(h * 1.3)::INT) AS y1, least(1920, x + w + trunc(w * 0.3)::INT) AS x2, h FROM k), q AS (SELECT *, least(1080, y1 + trunc(h * 1.2)::INT) AS y2 FROM p)
    SELECT id, CASE WHEN y2 > y1 AND x2 > x1 THEN x1 END AS x1, CASE WHEN y2 > y1 AND x2 > x1 THEN y1 END AS y1, CASE WHEN y2 > y1 AND x2 > x1 THEN x2 END AS x2, CASE WHEN y2 > y1 AND x2 > x1 THEN y2 END AS y2 FROM q""")
def f14_clothing_region(spark, sf_dir):
    return _crop(views.looks(spark, sf_dir), geometry.clothing_region(F.col("bbox"), F.lit(1920), F.lit(1080)))


_ALL = [n for n, _, _ in CATEGORIES] + ["something_else"]


@query(f"WITH {sql.values([(n, round(synthesis.STRENGTH.get((synthesis.SPEC.get(n) or (None,))[0], 0.0), 2)) for n in _ALL], 'category, adjust')}, b AS (SELECT unnest([0.0, 0.3, 0.6, 0.7, 0.9]) AS base) SELECT category, base, round(least(0.75, greatest(0.05, base + adjust)), 6) AS strength FROM t, b")
def f15_strength(spark, sf_dir):
    rows = spark.createDataFrame([(n, b) for n in _ALL for b in (0.0, 0.3, 0.6, 0.7, 0.9)], "category string, base double")
    return rows.withColumn("strength", r6(synthesis.strength(F.col("category"), F.col("base"))))


_POSE_TEXT = "CASE p " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in synthesis.POSE_PHRASES.items()) + " END"
_SPEC = sql.values([(n, *((synthesis.SPEC[n][0], (synthesis.SPEC[n][1] or [None])[0]) if n in synthesis.SPEC else (None, None))) for n in _ALL], "category, p, x")


@query(f"WITH {_SPEC} SELECT category, concat_ws(', ', {_POSE_TEXT}, {_PHRASES}, '{synthesis.PROMPT_SUFFIX}') AS prompt FROM t")
def f16_prompt(spark, sf_dir):
    return spark.createDataFrame([(n,) for n in _ALL], "category string").withColumn("prompt", synthesis.prompt(F.col("category")))


TRISTATE = [(None, "full"), (None, "missing"), (True, "missing"), (False, "full"), (True, "full"), (False, "missing")]


@query(f"WITH {sql.values(TRISTATE, 'explicit, mode')} SELECT explicit, mode, coalesce(explicit, mode = 'full') AS restore FROM t")
def f19_face_restore(spark, sf_dir):
    return spark.createDataFrame(TRISTATE, "explicit boolean, mode string").withColumn("restore", synthesis.face_restore(F.col("explicit"), F.col("mode")))


@query(f"{LOOKS}, z AS (SELECT id, x + 1 AS w, y + 1 AS h, 512.0 / greatest(x + 1, y + 1) AS scale FROM k) SELECT id, CASE WHEN greatest(w, h) <= 512 THEN w ELSE greatest(1, round_even(w * scale, 0)::INT) END AS w, CASE WHEN greatest(w, h) <= 512 THEN h ELSE greatest(1, round_even(h * scale, 0)::INT) END AS h FROM z")
def f20_working_size(spark, sf_dir):
    size = geometry.working_size(F.col("bbox.x") + 1, F.col("bbox.y") + 1)
    return views.looks(spark, sf_dir).select("id", size.alias("s")).select("id", "s.w", "s.h")


FILENAMES = ["a b?c*.jpg", "  x/y\\z  ", "v(1)_final-2.mp4", "né:ü", "a" * 200, ""]


@query(f"WITH {sql.values([(n,) for n in FILENAMES], 'name')} SELECT name, left(trim(regexp_replace(name, '[^\\p{{L}}\\p{{N}}\\-_.() ]', '', 'g')), 150) AS safe FROM t")
def f21_safe_filename(spark, sf_dir):
    return spark.createDataFrame([(n,) for n in FILENAMES], "name string").withColumn("safe", text.safe_filename(F.col("name")))


@query(f"""{LOOKS}, p AS (SELECT a.id, a.w * a.h AS area_a, b.w * b.h AS area_b, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS o FROM k a JOIN k b ON b.id = a.id + 1) SELECT id, round(o / (area_a + area_b - o), 6) AS iou FROM p""")
def f22_iou(spark, sf_dir):
    rows = views.looks(spark, sf_dir).select("id", "bbox")
    pairs = rows.join(rows.select((F.col("id") - 1).alias("id"), F.col("bbox").alias("other")), "id")
    return pairs.select("id", r6(geometry.iou(F.col("bbox"), F.col("other"))).alias("iou"))


_CID = "printf('f%08d_%d_%d_%d_%d', id, x, y, w, h)"


@query(f"{LOOKS} SELECT id, {_CID} AS candidate_id, printf('frame_%08d_', id) || {_CID} AS stem, printf('frame_%08d_', id) || right({_CID}, 8) AS short_stem FROM k")
def f23_names(spark, sf_dir):
    cid = text.candidate_id(F.col("id"), F.col("bbox"))
    return views.looks(spark, sf_dir).select("id", cid.alias("candidate_id"), text.stem(F.col("id"), cid).alias("stem"), text.short_stem(F.col("id"), cid).alias("short_stem"))


@query(f"WITH {_CATS} SELECT category, array_to_string(list_transform(string_split(category, '_'), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS label FROM t")
def f24_labels(spark, sf_dir):
    return synthesis.category_table(views.looks(spark, sf_dir)).select("category", text.label(F.col("category")).alias("label"))


# Sinks and layouts.


@query(f"{LOOKS} SELECT category, id FROM (SELECT unnest(cats) AS category, id FROM k)")
def w5_category_links(spark, sf_dir):
    from .sources.sinks import links_by_category

    return links_by_category(views.looks(spark, sf_dir))


@query(f"""{LOOKS}, b AS (SELECT pose, id FROM (SELECT pose, id, {_BEST.format('pose')} FROM k) WHERE rn = 1), o AS (SELECT pose, id, row_number() OVER (ORDER BY list_position({reports.POSE_SHEET!r}, pose)) - 1 AS i, count(*) OVER () AS n FROM b)
    SELECT pose, id, (i // least(4, n))::INT AS row, (i % least(4, n))::INT AS col, ((n + least(4, n) - 1) // least(4, n))::INT AS rows FROM o""")
def w6_contact_sheet(spark, sf_dir):
    return reports.sheet(reports.best_by(views.looks(spark, sf_dir), "pose", order="id"), "pose", reports.POSE_SHEET, 4)


# The pipeline's core in one query: the flagship.


@query(f"""{GROUPS}, q AS (SELECT id, row_number() OVER (PARTITION BY group_id ORDER BY quality DESC, t, ord) AS rk FROM g), j AS (SELECT pose, quality FROM k JOIN q USING (id) WHERE rk <= 2), b AS (SELECT pose, least(90, trunc(quality * 10)::INT * 10) AS lo FROM j)
    SELECT pose, lo || '-' || (lo + 10) || '%' AS bin, count(*) AS n FROM b GROUP BY 1, 2""")
def flagship_survivor_distribution(spark, sf_dir):
    """Candidates scored, deduplicated in windows, and counted by pose and quality."""
    kept = dedup.deduplicate(views.candidates(spark, sf_dir), DEDUP).where("kept")
    return kept.groupBy("pose", reports.quality_bin(F.col("quality")).alias("bin")).agg(F.count("*").alias("n"))


# What needs pixels: rows only in the driver's check, unit tests against known images.


def _images(spark, sf_dir):
    """An 8 by 8 image of each embedding, scaled up to 32 by 32."""
    pixel = F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda i: F.floor(128 + 400 * F.get("e", (F.floor(i / 128) * 8 + F.floor((i % 32) / 4)).cast("int"))))
    return views.dims(spark, sf_dir).select("id", pixel.cast("array<double>").alias("gray"), F.lit(32).alias("width"))


@query()
def d1_perceptual_hash(spark, sf_dir):
    return _images(spark, sf_dir).select("id", pixels.perceptual_hash(F.col("gray"), F.col("width")).alias("phash"))


@query()
def f1_f4_pixel_scores(spark, sf_dir):
    g, w = F.col("gray"), F.col("width")
    return _images(spark, sf_dir).select("id", r6(quality.sharpness(pixels.laplacian(g, w))).alias("sharpness"), r6(pixels.artifact(g, w)).alias("artifact"))


# Sources and set operations.


@query("SELECT event_id AS id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def s9_json_read(spark, sf_dir):
    """JSON text parsed into a map; what can't be parsed has no entries."""
    props = F.from_json("props", "map<string,string>", {"mode": "PERMISSIVE"})
    return views.read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.explode(props).alias("key", "value"))


@query(f"{LOOKS} SELECT 'frame_' || printf('%08d', id) || '_' || id AS file, array_to_string(list_concat(['person'], list_filter(list_transform(tags, lambda x: {_PHRASES}), lambda x: x IS NOT NULL)), ', ') AS caption FROM k WHERE id % 4 <> 0")
def w4_caption_dataset(spark, sf_dir):
    from .sources.sinks import caption_rows

    rows = views.looks(spark, sf_dir).withColumns({"frame_number": F.col("id"), "frame_path": F.when(F.col("id") % 4 != 0, F.lit("x.jpg")), "caption": text.caption(F.lit("person"), F.col("expressions"))})
    return caption_rows(rows)


@query(f"""{LOOKS}, a AS (SELECT id FROM k WHERE pose = 'front'), b AS (SELECT id FROM k WHERE quality >= 0.6) SELECT 'union' AS op, id FROM (SELECT id FROM a UNION SELECT id FROM b) UNION ALL SELECT 'except', id FROM (SELECT id FROM a EXCEPT SELECT id FROM b)
    UNION ALL SELECT 'intersect', id FROM (SELECT id FROM a INTERSECT SELECT id FROM b)""")
def sets_union_except_intersect(spark, sf_dir):
    rows = views.looks(spark, sf_dir)
    a, b = rows.where("pose = 'front'").select("id"), rows.where("quality >= 0.6").select("id")
    tag = lambda name, df: df.select(F.lit(name).alias("op"), "id")
    return tag("union", a.union(b).distinct()).union(tag("except", a.exceptAll(b).distinct())).union(tag("intersect", a.intersect(b)))


@query(f"{LOOKS} SELECT id, list_has_any(tags, ['talking', 'focused']) AS overlaps, len(list_filter(['neutral', 'talking'], lambda x: NOT list_contains(tags, x)))::INT AS missing FROM k")
def sets_overlap_difference(spark, sf_dir):
    want = lambda *t: F.array(*map(F.lit, t))
    return views.looks(spark, sf_dir).select("id", F.arrays_overlap("expressions", want("talking", "focused")).alias("overlaps"), F.size(F.array_except(want("neutral", "talking"), F.col("expressions"))).alias("missing"))
