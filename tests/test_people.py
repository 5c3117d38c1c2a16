import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from atticwork.functions.geometry import crop_box
from atticwork.operators import dedup, paging, people, videos


def rows(df):
    return sorted(tuple(r) for r in df.collect())


pairs = st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 5)), max_size=12)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(pairs, pairs)
def test_plan_applied_to_current_gives_target(spark, wanted, present):
    schema = "label string, asset_id int"
    plan = people.sync_plan(spark.createDataFrame(wanted, schema), spark.createDataFrame(present, schema)).collect()
    state = set(present)
    for r in plan:
        (state.add if r.action == "add" else state.discard)((r.label, r.asset_id))
        assert r.create_label == (r.label not in {lab for lab, _ in present})
    labels = {lab for lab, _ in wanted}
    assert {p for p in state if p[0] in labels} == set(wanted)
    # A label that nobody asks for is not touched.
    assert {p for p in state if p[0] not in labels} == {p for p in present if p[0] not in labels}


def test_add_only_never_removes(spark):
    a = spark.createDataFrame([("x", 1)], "label string, asset_id int")
    b = spark.createDataFrame([("x", 2)], "label string, asset_id int")
    assert rows(people.sync_plan(a, b, "add").select("asset_id", "action")) == [(1, "add")]
    with pytest.raises(ValueError):
        people.sync_plan(a, b, "mirror")


def test_names_merge_and_ids_keep_an_empty_name(spark):
    ppl = spark.createDataFrame([("1", "Ann"), ("2", "Ann"), ("3", None), ("4", "Bob")], "id string, name string")
    refs = spark.createDataFrame([("name", "Ann"), ("id", "3"), ("id", "9"), ("name", ""), ("id", "4")], "kind string, value string")
    assert rows(people.resolve_groups(refs, ppl)) == [("", "3"), ("Ann", "1"), ("Ann", "2"), ("Bob", "4")]
    assert rows(people.unresolved_refs(refs, ppl)) == [("id", "9"), ("name", "")]


@pytest.fixture(scope="module")
def assets(spark):
    data = [
        (1, "h1", "/m/a", "f", "active", None), (2, "h1", "/m/a", "f", "active", None), (3, "h1", "/m/b", None, "active", None),
        (4, "h2", "/m/a", "f", "active", None), (5, None, "/m/c", "f", "active", None), (6, None, "/m/c", "f", "active", None),
        (7, "h3", "/x/d", "f", "trashed", "t"), (8, "h3", "/m/e", "f", "active", None),
    ]
    return spark.createDataFrame(data, "id long, thumbhash string, originalPath string, originalFileName string, status string, deletedAt string")


def test_same_path_delete_only_looks_at_repeated_hashes(assets):
    assert rows(dedup.same_path_duplicates(assets, "thumbhash", "originalPath", "id").select("id")) == [(2,)]
    left = dedup.delete_same_path(assets, "thumbhash", "originalPath", "id")
    assert rows(left.select("id")) == [(1,), (3,), (4,), (5,), (6,), (7,), (8,)]
    assert dedup.same_path_duplicates(left, "thumbhash", "originalPath", "id").count() == 0


def test_trash_counts_active_copies_only(assets):
    out = {r.id: (r.status, r.deletedAt) for r in dedup.trash_duplicates(assets, "/m/", F.lit("now")).collect()}
    assert {i for i, v in out.items() if v == ("trashed", "now")} == {2, 3}
    assert out[7] == ("trashed", "t") and out[8] == ("active", None)
    prefix = dedup.trash_duplicates(assets, "/m/b", F.lit("now"))
    assert rows(prefix.filter("deletedAt = 'now'").select("id")) == [(3,)]


def test_removal_policies(spark):
    files = spark.createDataFrame([("h", "/a", 5), ("h", "/b", 9), ("h", "/c", 9), ("u", "/z", 1)], "hash string, path string, size long")
    removed = {k: rows(dedup.dedup_plan(files, k).select("remove", "kept", "freed_bytes")) for k in ("first", "last", "largest")}
    assert removed["first"] == [("/b", "/a", 5), ("/c", "/a", 5)]
    assert removed["last"] == [("/a", "/c", 5), ("/b", "/c", 5)]
    assert removed["largest"] == [("/a", "/b", 5), ("/c", "/b", 5)]
    with pytest.raises(ValueError):
        dedup.dedup_plan(files, "newest")


def test_group_report_as_csv(spark, tmp_path):
    files = spark.createDataFrame([("h", "/a", 5), ("h", "/b", 9), ("u", "/z", 1)], "hash string, path string, size long")
    out = str(tmp_path / "report")
    dedup.write_groups_csv(dedup.export_groups(files), out)
    back = spark.read.option("header", True).csv(out).collect()
    assert [(r.hash, r.file_count, r.size, r.file_paths) for r in back] == [("h", "2", "5", "/a|/b")]


def test_repeat_visitors(spark):
    t0 = dt.datetime(2024, 1, 1)
    h = lambda n: t0 + dt.timedelta(hours=n)
    person = lambda *p: [{"id": i, "name": n} for i, n in p]
    data = [
        ("a1", h(0), "/x/Cam/1.jpg", person((1, ""), (2, "Two"))),
        ("a2", h(1), "/x/cam/2.jpg", person((2, "Two"))),
        ("a3", h(1.5), "/x/cam/3.jpg", person((1, "One"), (3, "Once"))),
        ("a4", h(99), "/x/other/4.jpg", person((2, "Two"), (3, "Once"))),
    ]
    df = spark.createDataFrame(data, "id string, file_created_at timestamp, original_path string, people array<struct<id:int,name:string>>")
    seen = people.appearances(people.in_scope(df, ["CAM"]))
    found = people.frequent_persons(seen, 1)
    # Person 2 is back after exactly one hour, which is not above the threshold; person 3 is seen once.
    assert [(r.person_id, r.name, r.appearances, r.max_gap_hours) for r in found.collect()] == [(1, "One", 2, 1.5)]
    assert [r.asset_ids for r in people.frequent_assets(seen, found).collect()] == [["a1", "a3"]]
    assets = df.select("id", F.array(F.lit("Old")).alias("tags"))
    persons = spark.createDataFrame([(1, False), (2, None), (3, True)], "id int, is_favorite boolean")
    tagged, liked = people.tag_frequent(assets, persons, seen, found, "Frequent")
    assert {r.id: r.tags for r in tagged.collect()} == {"a1": ["Old", "Frequent"], "a3": ["Old", "Frequent"], "a2": ["Old"], "a4": ["Old"]}
    assert {r.id: r.is_favorite for r in liked.collect()} == {1: True, 2: None, 3: True}


def test_rename_and_merge(spark):
    persons = spark.createDataFrame([(1, "A"), (2, "B")], "id int, name string")
    assert rows(people.rename_person(persons, 1, "  ").filter("name is null").select("id")) == [(1,)]
    faces = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, None)], "id int, person_id int")
    assert rows(people.merge_persons(faces, 1, 2).filter("person_id = 2").select("id")) == [(1,), (2,), (3,)]
    at = F.lit("2024-01-02 03:04:05").cast("timestamp")
    log = people.merge_log(people.merge_record(persons, faces, 1, 2, at)).first()
    assert (log.source_person_name, log.target_person_name, log.face_count_moved, log.merged_at) == ("A", "B", 2, "2024-01-02T03:04:05Z")
    assert people.merge_record(persons, faces, 1, 9, at).count() == 0


def test_merge_log_table(spark):
    persons = spark.createDataFrame([(1, "A"), (2, "B")], "id int, name string")
    faces = spark.createDataFrame([(1, 1)], "id int, person_id int")
    for day in ("2024-01-01", "2024-01-03", "2024-01-02"):
        people.append_log(people.merge_record(persons, faces, 1, 2, F.lit(day).cast("timestamp")), "merge_log_t")
    assert [r.merged_at[:10] for r in people.merge_log(spark.table("merge_log_t"), 2).collect()] == ["2024-01-03", "2024-01-02"]


def test_unknown_sort_key_means_default(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a")], "id int, n string")
    allowed = {"n": [F.col("n")], "id": [F.desc("id")]}
    assert [r.id for r in paging.sort_by(df, "nonsense", allowed, "id").collect()] == [2, 1]
    assert [r.id for r in paging.page(paging.sort_by(df, "n", allowed, "id"), 2, 1).collect()] == [1]
    assert tuple(paging.page_totals(df.limit(0), 10).first()) == (0, 0)


@pytest.fixture(scope="module")
def film(spark):
    return {
        "videos": spark.createDataFrame([(1, "a.mp4", "2024-01-01"), (2, "B.mp4", "2024-01-01"), (3, "c.mp4", None)], "id int, filename string, start_time string").withColumn("start_time", F.to_timestamp("start_time")),
        "tracks": spark.createDataFrame([(10, 1, 100, 0.5, 7), (11, 1, 100, 0.9, None), (12, 2, 100, 0.9, 1), (13, 3, 101, 0.2, 4)], "id int, video_id int, local_person_id int, best_quality double, best_frame_index int"),
        "segments": spark.createDataFrame([(20, 10, 0.4, 3), (21, 10, 0.8, None)], "id int, face_track_id int, quality double, frame_index int"),
        "persons": spark.createDataFrame([(100, "p", "Known", 3), (101, "q", None, 1), (102, "r", None, 0)], "id int, label string, known_name string, track_count int"),
    }


def test_video_catalog_and_segments(film):
    cat = {r.id: (r.person_count, r.track_count) for r in videos.video_catalog(film["videos"], film["tracks"]).collect()}
    assert cat == {1: (1, 2), 2: (1, 1), 3: (1, 1)}
    seg = {r.video_id: r.segments for r in videos.video_segments(film["tracks"], film["segments"]).collect()}
    # By frame, missing frames last: segment 20, then segment 21 (its frame falls back to the track's 7), then track 11.
    assert [x for x in __import__("json").loads(seg[1])] == [
        {"segment_id": 20, "track_id": 10, "quality": 0.4, "frame_index": 3},
        {"segment_id": 21, "track_id": 10, "quality": 0.8, "frame_index": 7},
        {"segment_id": None, "track_id": 11, "quality": 0.9, "frame_index": None},
    ]


def test_local_persons(film):
    out = {r.id: (r.distinct_days, r.best_track_id) for r in videos.local_persons(film["persons"], film["tracks"], film["videos"]).collect()}
    assert out == {100: (1, 11), 101: (0, 13), 102: (0, None)}
    ordered = videos.local_persons(film["persons"], film["tracks"], film["videos"]).orderBy(*videos.person_order("name_asc"))
    assert [r.id for r in ordered.collect()] == [100, 101, 102]


def test_best_faces_fall_back_to_tracks(film):
    out = rows(videos.best_faces(film["segments"], film["tracks"], film["videos"]).select("local_person_id", "face_track_id", "rank"))
    assert out == [(100, 10, 1), (100, 10, 2), (101, 13, 1)]


def test_delete_video_cascades(film):
    facts = film["segments"].select("face_track_id")
    left = videos.delete_video({**film, "facts": facts}, 1)
    assert {k: v.count() for k, v in left.items()} == {"videos": 2, "tracks": 2, "segments": 0, "facts": 0}


def test_crop_box_is_padded_and_clamped(spark):
    lit = F.lit
    one = spark.range(1).select(crop_box(lit(10), lit(10), lit(50), lit(90), lit(100), lit(100), lit(200), lit(100)).alias("b")).first().b
    assert tuple(one) == (0, 0, 120, 100)
    none = spark.range(1).select(crop_box(lit(0), lit(0), lit(1), lit(1), lit(0), lit(None).cast("int"), lit(8), lit(8)).alias("b")).first().b
    assert tuple(none) == (0, 0, 8, 8)


def test_wanted_labels_without_assets_are_emptied_or_created(spark):
    schema = "label string, asset_id int"
    target = spark.createDataFrame([("kept", 1)], schema)
    current = spark.createDataFrame([("kept", 1), ("empty", 2), ("other", 3)], schema)
    asked = spark.createDataFrame([("empty",), ("new",), ("kept",)], "label string")
    plan = people.sync_plan(target, current, wanted=asked).collect()
    assert sorted(map(tuple, plan), key=repr) == [("empty", 2, "remove", False), ("new", None, "create", True)]
