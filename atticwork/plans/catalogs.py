"""Video catalogues over ``orders`` (videos), ``lineitem`` (tracks) and ``part`` (local persons)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import crop_box
from ..operators import paging, videos as v
from .catalog import Tables, query


def videos(t: Tables) -> DataFrame:
    name = F.concat(F.substring("o_orderpriority", 3, 20), F.lit("_"), F.col("o_orderkey").cast("string"), F.lit(".mp4"))
    return t.orders.select(F.col("o_orderkey").alias("id"), name.alias("filename"), F.col("o_orderdate").alias("start_time"))


_TRACK_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def tracks(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in _TRACK_ID]).alias("id"),
        F.col("l_orderkey").alias("video_id"),
        F.col("l_partkey").alias("local_person_id"),
        F.col("l_extendedprice").alias("best_quality"),
        F.when(F.col("l_linestatus") == "O", F.col("l_suppkey")).alias("best_frame_index"),
    )


def segments(t: Tables) -> DataFrame:
    """Returned items have a segment; most parts have some, a few have none."""
    own = t.lineitem.filter("l_returnflag = 'A' and l_discount > 0.08")
    tid = F.concat_ws("-", *[F.col(c).cast("string") for c in _TRACK_ID])
    return own.select(
        F.concat(F.lit("s"), tid).alias("id"), tid.alias("face_track_id"), F.col("l_quantity").alias("quality"),
        F.col("l_linenumber").cast("long").alias("frame_index"),
    )


def local(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("label"),
        F.when(F.col("p_size") > 25, F.col("p_brand")).alias("known_name"), F.col("p_size").alias("track_count"),
    )


_V = """v AS (SELECT o_orderkey AS id, substring(o_orderpriority, 3, 20) || '_' || CAST(o_orderkey AS VARCHAR) || '.mp4' AS filename,
    o_orderdate AS start_time FROM orders)"""
_T = """t AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_orderkey AS video_id, l_partkey AS local_person_id,
    l_extendedprice AS best_quality, CASE WHEN l_linestatus = 'O' THEN l_suppkey END AS best_frame_index FROM lineitem)"""
_S = """s AS (SELECT 's' || concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id,
    concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS face_track_id, l_quantity AS quality,
    CAST(l_linenumber AS BIGINT) AS frame_index FROM lineitem WHERE l_returnflag = 'A' AND l_discount > 0.08)"""
_L = "l AS (SELECT p_partkey AS id, p_name AS label, CASE WHEN p_size > 25 THEN p_brand END AS known_name, p_size AS track_count FROM part)"


@query(f"WITH {_V} SELECT DISTINCT upper(left(filename, 1)) AS letter FROM v")
def video_letters(t: Tables) -> DataFrame:
    return v.letters(videos(t))


@query(f"WITH {_V} SELECT id, filename FROM v WHERE contains(lower(filename), '12') AND upper(left(filename, 1)) = 'M'")
def videos_by_letter(t: Tables) -> DataFrame:
    return v.filter_videos(videos(t), q="12", letter="m").select("id", "filename")


_CAT = f"""WITH {_V}, {_T}, k AS (SELECT v.id, v.filename, v.start_time, count(DISTINCT t.local_person_id) AS person_count,
    count(t.id) AS track_count FROM v LEFT JOIN t ON t.video_id = v.id GROUP BY ALL)"""


@query(_CAT + "SELECT id, filename, person_count, track_count FROM k")
def video_catalog(t: Tables) -> DataFrame:
    return v.video_catalog(videos(t), tracks(t)).select("id", "filename", "person_count", "track_count")


@query(_CAT + "SELECT id, person_count FROM k ORDER BY person_count DESC, start_time DESC, id LIMIT 50 OFFSET 50")
def video_page(t: Tables) -> DataFrame:
    ordered = v.video_catalog(videos(t), tracks(t)).orderBy(*v.video_order("persons_desc"))
    return paging.page(ordered, 2, 50).select("id", "person_count")


_FACES = f"""WITH {_V}, {_T}, {_S}, {_L}, x AS (SELECT t.video_id, t.local_person_id, t.id AS track_id, s.id AS segment_id,
    coalesce(s.quality, t.best_quality) AS quality, coalesce(s.frame_index, t.best_frame_index) AS frame_index
    FROM t LEFT JOIN s ON s.face_track_id = t.id)"""


@query(
    _FACES
    + """, p AS (SELECT video_id, local_person_id, count(segment_id) AS segment_count, max(quality) AS best_quality FROM x GROUP BY ALL)
    SELECT video_id, local_person_id, segment_count, best_quality, l.label, coalesce(l.known_name, '') AS known_name,
        row_number() OVER (PARTITION BY video_id ORDER BY segment_count DESC, best_quality DESC NULLS LAST, local_person_id NULLS FIRST) AS rank
    FROM p LEFT JOIN l ON l.id = local_person_id"""
)
def video_persons(t: Tables) -> DataFrame:
    out = v.video_persons(tracks(t), segments(t), local(t))
    return out.withColumn("known_name", F.coalesce("known_name", F.lit("")))


@query(
    _FACES
    + """SELECT video_id, local_person_id, 0 AS part, to_json(list({'segment_id': segment_id, 'track_id': track_id, 'quality': quality,
    'frame_index': frame_index} ORDER BY frame_index NULLS LAST, track_id, segment_id)) AS segments FROM x GROUP BY ALL"""
)
def video_segments(t: Tables) -> DataFrame:
    return v.video_segments(tracks(t), segments(t)).withColumn("segments", F.col("segments").cast("string"))


@query(
    f"""WITH {_V}, {_T} SELECT local_person_id, count(DISTINCT CAST(start_time AS DATE)) AS distinct_days
    FROM t JOIN v ON v.id = t.video_id GROUP BY 1"""
)
def person_days(t: Tables) -> DataFrame:
    return v.person_days(tracks(t), videos(t))


_LOCAL = f"""WITH {_V}, {_T}, {_L}, d AS (SELECT local_person_id, count(DISTINCT CAST(start_time AS DATE)) AS n FROM t JOIN v ON v.id = t.video_id GROUP BY 1),
    b AS (SELECT local_person_id, id FROM t QUALIFY row_number() OVER (PARTITION BY local_person_id ORDER BY best_quality DESC, id) = 1),
    o AS (SELECT l.*, coalesce(d.n, 0) AS distinct_days, b.id AS best_track_id FROM l LEFT JOIN d ON d.local_person_id = l.id LEFT JOIN b ON b.local_person_id = l.id)
"""


@query(_LOCAL + "SELECT id, label, distinct_days, coalesce(best_track_id, '') AS best_track_id FROM o WHERE distinct_days >= 30")
def local_persons(t: Tables) -> DataFrame:
    out = v.local_persons(local(t), tracks(t), videos(t), min_days=30)
    return out.select("id", "label", "distinct_days", F.coalesce("best_track_id", F.lit("")).alias("best_track_id"))


@query(
    _LOCAL
    + """SELECT id, distinct_days FROM o WHERE contains(lower(label), 'ring') OR contains(lower(known_name), 'ring')
    ORDER BY distinct_days DESC, track_count DESC, id LIMIT 20"""
)
def local_person_page(t: Tables) -> DataFrame:
    out = v.local_persons(local(t), tracks(t), videos(t), q="ring")
    return paging.page(out.orderBy(*v.person_order("days_desc")), 1, 20).select("id", "distinct_days")


@query(
    f"""WITH {_V}, {_T} SELECT t.local_person_id, t.video_id, v.filename, 0 AS part,
    to_json(list({{'track_id': t.id, 'best_quality': best_quality}} ORDER BY best_quality DESC, t.id)) AS tracks
    FROM t JOIN v ON v.id = t.video_id GROUP BY ALL"""
)
def person_files(t: Tables) -> DataFrame:
    return v.person_files(tracks(t), videos(t)).select("local_person_id", "video_id", "filename", "part", "tracks")


@query(
    f"""WITH {_T}, {_S}, a AS (SELECT t.local_person_id, s.id AS segment_id, t.id AS face_track_id, s.quality FROM s JOIN t ON t.id = s.face_track_id),
    u AS (FROM a UNION ALL SELECT local_person_id, NULL, id, best_quality FROM t WHERE local_person_id NOT IN (SELECT local_person_id FROM a)),
    r AS (SELECT *, row_number() OVER (PARTITION BY local_person_id ORDER BY quality DESC, face_track_id, segment_id) AS rank FROM u QUALIFY rank <= 16)
    SELECT local_person_id, coalesce(segment_id, '') AS segment_id, face_track_id, rank FROM r"""
)
def best_faces(t: Tables) -> DataFrame:
    out = v.best_faces(segments(t), tracks(t), videos(t))
    return out.select("local_person_id", F.coalesce("segment_id", F.lit("")).alias("segment_id"), "face_track_id", "rank")


@query(
    f"""WITH {_V}, {_T}, {_S} SELECT 'videos' AS name, count(*) AS rows FROM v WHERE id <> 3
    UNION ALL SELECT 'tracks', count(*) FROM t WHERE video_id <> 3
    UNION ALL SELECT 'segments', count(*) FROM s WHERE face_track_id NOT IN (SELECT id FROM t WHERE video_id = 3)
    UNION ALL SELECT 'facts', count(*) FROM t WHERE video_id <> 3"""
)
def tables_without_video(t: Tables) -> DataFrame:
    facts = tracks(t).select(F.col("id").alias("face_track_id"), "best_quality")
    left = v.delete_video({"videos": videos(t), "tracks": tracks(t), "segments": segments(t), "facts": facts}, 3)
    counts = [df.agg(F.count(F.lit(1)).alias("rows")).withColumn("name", F.lit(name)) for name, df in left.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query(
    """WITH b AS (SELECT p_partkey AS id, p_size * 10 AS x, CAST(p_partkey % 700 AS INT) AS y FROM part),
    s AS (SELECT id, CAST(floor(x / 1000.0 * 640) AS INT) AS x1, CAST(floor((x + 200) / 1000.0 * 640) AS INT) AS x2,
                 CAST(floor(y / 800.0 * 480) AS INT) AS y1, CAST(floor((y + 160) / 800.0 * 480) AS INT) AS y2 FROM b),
    p AS (SELECT *, CAST(floor((x2 - x1) * 0.25) AS INT) AS dx, CAST(floor((y2 - y1) * 0.25) AS INT) AS dy FROM s)
    SELECT id, greatest(0, x1 - dx) AS x1, greatest(0, y1 - dy) AS y1, least(640, x2 + dx) AS x2, least(480, y2 + dy) AS y2 FROM p"""
)
def crop_boxes(t: Tables) -> DataFrame:
    x, y = F.col("p_size") * 10, (F.col("p_partkey") % 700).cast("int")
    box = crop_box(x, y, x + 200, y + 160, F.lit(1000), F.lit(800), F.lit(640), F.lit(480))
    return t.part.select(F.col("p_partkey").alias("id"), box.alias("b")).select("id", "b.*")
