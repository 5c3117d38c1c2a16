import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from atticwork.functions import payload as pl
from atticwork.operators import camera, gaps


def message(before=None, after=None, **extra):
    return json.dumps({"type": "new", "before": before, "after": after, **extra})


@pytest.fixture(scope="module")
def events(spark):
    full = {"id": "e1", "camera": "gate", "label": "car", "has_clip": True, "has_snapshot": True, "start_time": 1700000000.5, "end_time": None}
    rows = [
        (1, message(full, None), "h"),
        (2, message(None, {**full, "id": "e2"}), "h"),
        (3, message({**full, "camera": "old"}, {"id": "e3", "camera": None, "has_clip": False}), "h"),
        (4, "not json", "h"),
        (5, "", "h"),
        (6, message({"id": "e6", "has_clip": "true", "start_time": "1700000001"}), None),
    ]
    return spark.createDataFrame(rows, "id long, data string, source string")


@pytest.fixture(scope="module")
def flat(spark, events):
    read = spark.createDataFrame(
        [(1, "DONE", '{"adjusted": "A123BC", "plates": ["A123BC", "X"]}'), (2, "PENDING", None)],
        "event_id long, status string, result string",
    )
    return {r.id: r for r in camera.events_media(events, read).collect()}


def test_fields_fall_back_one_by_one(flat):
    assert (flat[1].camera, flat[1].event_id, flat[1].has_clip) == ("gate", "e1", True)
    # In the third event the camera and times come from before, id and has_clip from after.
    assert (flat[3].camera, flat[3].event_id, flat[3].has_clip) == ("old", "e3", False)
    assert flat[3].media == "http://h:5000/api/events/e3/snapshot.jpg"


def test_thumbnail_link_has_no_fallback(flat):
    assert flat[1].thumbnail_url is None
    assert flat[2].thumbnail_url == "http://h:5000/api/events/e2/thumbnail.jpg"
    assert flat[2].media == "http://h:5000/api/events/e2/clip.mp4, http://h:5000/api/events/e2/snapshot.jpg"


def test_times_plates_and_bad_rows(flat):
    assert flat[1].start_time == dt.datetime(2023, 11, 14, 22, 13, 20, 500000) and flat[1].end_time is None
    assert (str(flat[1].start_date_date), flat[1].start_date_month, flat[1].start_date_dayofweek) == ("2023-11-14", "2023-11", "Tue")
    assert (flat[1].PLATE_NO, flat[1].plates, flat[1].status) == ("A123BC", "A123BC, X", "DONE")
    assert flat[4].type is None and flat[4].media == "" and flat[5].camera is None
    assert flat[6].has_clip is True and flat[6].start_time is not None and flat[6].media == ""


def test_only_json_is_kept(events):
    assert sorted(r.id for r in camera.valid_messages(events).collect()) == [1, 2, 3, 6]


@pytest.mark.parametrize(
    "body, expected",
    [
        ({"has_clip": False}, False),
        ({"a": {"has_clip": True}}, True),
        ({"has_clip": "true"}, False),
        ({"x": "/media/frigate/1.mp4"}, True),
        ({"a": ["big thumb picture"]}, True),
        ({"clip": 1, "thumb": None}, False),
        ({"x": 'say "clip" now'}, True),
        ({"data": {"detections": []}}, True),
        ({"a": [{"data": {"n": {"m": [1]}, "objects": ["car"]}}]}, True),
        ({"data": {"n": {"objects": 1}}}, False),
        ({"data": ["detections"]}, False),
        ({"data": {"a": [[[[[[[[{"b": [1]}]]]]]]]], "objects": []}}, True),
        ({"data": {"a": [[[[[[[[{"objects": [1]}]]]]]]]]}}, False),
        ({"a": {"b": {"c": {"d": {"e": {"f": {"g": {"h": {"data": {"x": {}, "detections": 1}}}}}}}}}}, True),
        ({"data": {"x": {"data": 1}, "y": {"objects": 2}}, "objects": 1}, False),
        ({"data": 5, "x": {"objects": 1}}, False),
        ({"data": {"x": 'a " } " objects'}, "detections": []}, False),
        ({"path": "/media/frigate/x"}, True),
        ({"x": "y" * 200_000 + "clip"}, True),
        ({"x": ['"' * 100_000], "data": {"k": "z" * 100_000, "objects": []}}, True),
    ],
)
def test_video_rule(spark, body, expected):
    for text in (json.dumps(body), json.dumps(body, separators=(",", ":"))):
        assert spark.createDataFrame([(text,)], "p string").select(pl.has_video("p").alias("v")).first().v is expected


@pytest.mark.parametrize(
    "body, expected",
    [
        ({"objects": ["car"]}, True),
        ({"after": {"label": "dog"}}, True),
        ({"x": "a car here"}, False),
        ({"x": "cars"}, False),
        ({"car": 1}, True),
    ],
)
def test_label_rule(spark, body, expected):
    df = spark.createDataFrame([(json.dumps(body),)], "p string")
    assert df.select(pl.has_token("p", ["car", "dog"]).alias("v")).first().v is expected


def test_summary_takes_first_values_in_text_order(spark):
    body = {
        "before": {"id": "b1", "camera": "gate", "start_time": 0.0, "end_time": None, "label": "car", "data": {"objects": ["dog", "car"]}},
        "after": {"id": "a1", "camera": "yard", "end_time": 60, "thumb_path": "", "thumb": "t.jpg", "label": "cat"},
    }
    df = spark.createDataFrame([(1, json.dumps(body)), (2, "{}")], "id long, data string")
    got = {r.id: r for r in camera.event_summary(df).collect()}
    assert (got[1].camera, got[1].clip_id, got[1].labels, got[1].thumb) == ("gate", "b1", "dog, car, cat", "t.jpg")
    assert (got[1].start_time, got[1].end_time) == ("1970-01-01 00:00:00", "1970-01-01 00:01:00")
    assert (got[2].camera, got[2].start_time, got[2].labels, got[2].clip_id) == ("unknown", "unknown", "", "none")


def test_ingest_keeps_one_row_per_hash(spark):
    df = spark.createDataFrame([(2, "x"), (1, "x"), (3, "y")], "id long, data string")
    out = camera.ingest_events(df, F.lit("now"))
    assert sorted((r.id, r.created_at) for r in out.collect()) == [(1, "now"), (3, "now")]


def test_plate_visits_split_above_one_minute(spark):
    base = dt.datetime(2024, 1, 1)
    at = lambda s: base + dt.timedelta(seconds=s)
    rows = [
        (1, "K123AA", at(0)), (2, "K123BB", at(60)), (3, "K123AA", at(121)),
        (4, "____", at(0)), (5, "", at(0)), (6, None, at(0)), (7, "M9", at(5)),
    ]
    df = spark.createDataFrame(rows, "id long, PLATE_NO string, start_time timestamp")
    assert [tuple(r) for r in gaps.plate_visits(df).collect()] == [("123", 2), ("9", 1)]


def test_rows_without_time_come_last(spark):
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, "a", None), (2, "a", base), (3, "a", None)], "id long, k string, ts timestamp")
    got = {r.id: r.is_new for r in gaps.gap_flag(df, "k", "ts", F.expr("interval 1 minute"), ["id"]).collect()}
    assert got == {2: 1, 1: 0, 3: 1}


def test_label_words_match_only_themselves(spark):
    df = spark.createDataFrame([('{"label": "axb"}',), ('{"label": "a.b"}',)], "p string")
    assert [r.v for r in df.select(pl.has_token("p", ["a.b"]).alias("v")).collect()] == [False, True]
