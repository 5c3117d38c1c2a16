"""A stream fed file by file gives what the batch operators give."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from atticwork.operators import gaps, transcripts
from atticwork.session import shared_dir
from atticwork.streaming import events as s

BASE = dt.datetime(2024, 1, 1)


def at(seconds):
    return BASE + dt.timedelta(seconds=seconds)


def feed(spark, tmp_path, batches, schema):
    """One file per batch, read one per trigger in name order."""
    folder = tmp_path / "in"
    folder.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
        part = next((tmp_path / f"b{i}").glob("part-*"))
        target = folder / f"{i:03d}.parquet"
        target.write_bytes(part.read_bytes())
        import os

        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


VISITS = "k string, ts timestamp, id long"


def visit_batches():
    rows = [("a", at(0), 1), ("a", at(60), 2), ("a", at(121), 3), ("b", at(30), 4), ("c", at(0), 8), ("c", at(60.000001), 9)]
    later = [("a", at(400), 5), ("b", at(95), 6), ("d", at(10), 10), ("d", at(69.999999), 11)]
    end = [("z", at(9000), 7)]
    return [rows, later, end]


@pytest.mark.parametrize("strict", [True, False])
def test_sessions_equal_batch_visits(spark, tmp_path, strict):
    stream = feed(spark, tmp_path, visit_batches(), VISITS)
    out = s.run_available(s.visit_sessions(stream, "k", "ts", "1 minute", "10 minutes", strict), "t-visits")
    got = sorted((r.k, r.first_ts, r.events) for r in out.collect() if r.k != "z")
    rows = spark.createDataFrame([r for b in visit_batches() for r in b if r[0] != "z"], VISITS)
    grouped = gaps.gap_groups(rows, "k", "ts", F.expr("interval 1 minute"), ["id"], strict)
    want = grouped.groupBy("k", "group_id").agg(F.min("ts").alias("f"), F.count("id").alias("n")).collect()
    assert got == sorted((r.k, r.f, r.n) for r in want)


def test_repeats_are_dropped_within_the_delay(spark, tmp_path):
    batches = [[("x", at(0)), ("y", at(1))], [("x", at(5)), ("z", at(6))], [("x", at(7))]]
    stream = feed(spark, tmp_path, batches, "h string, ts timestamp")
    out = s.run_available(s.ingest_stream(stream, ["h"], "ts", "1 hour"), "t-ingest")
    assert sorted(r.h for r in out.collect()) == ["x", "y", "z"]


def test_late_rows_are_dropped(spark, tmp_path):
    batches = [[("a", at(0))], [("a", at(200_000))], [("a", at(200_001))], [("a", at(10))], [("a", at(400_000))]]
    stream = feed(spark, tmp_path, batches, "k string, ts timestamp")
    out = s.run_available(s.calendar_counts_stream(stream, "ts", ["k"], "10 minutes"), "t-late")
    # The fourth file is two days late: the first day was closed with one event.
    assert {r.window_start.day: r.events for r in out.collect()} == {1: 1, 3: 2}


def test_alert_needs_more_than_the_gap(spark, tmp_path):
    hour = 3600
    batches = [[("a", at(0), 1), ("b", at(0), 2)], [("a", at(2 * hour), 3), ("b", at(2 * hour + 1), 4)], [("z", at(900 * hour), 5)]]
    stream = feed(spark, tmp_path, batches, VISITS)
    alerts = s.repeat_alerts(s.visit_sessions(stream, "k", "ts", "2 hours", "10 minutes"), "k")
    out = s.run_available(alerts, "t-alerts").collect()
    # "a" is back after exactly two hours, which is one visit; "b" comes one second later.
    assert [(r.person_id, r.last_seen, r.seen_again) for r in out] == [("b", at(0), at(2 * hour + 1))]


@pytest.mark.parametrize("bucket,strict", [("1 minute", True), ("7 minutes", False), ("1 day", True)])
def test_a_busy_key_is_cut_and_put_together(spark, tmp_path, bucket, strict):
    rnd = random.Random(bucket)
    times = sorted(rnd.sample(range(0, 40_000, 5), 900))
    rows = [("hot" if i % 3 == 0 else f"k{i % 40}", at(x), i) for i, x in enumerate(times)] + [("hot", at(x), 9000 + i) for i, x in enumerate(range(20_000, 21_000, 30))]
    rnd.shuffle(rows)
    rows.sort(key=lambda r: r[1] + dt.timedelta(seconds=rnd.randrange(500)))
    batches = [rows[i : i + 160] for i in range(0, len(rows), 160)]
    stream = feed(spark, tmp_path, batches, VISITS)
    build = lambda df: s.visit_sessions(df, "k", "ts", "1 minute", "10 minutes", strict, bucket)
    got = sorted((r.k, r.first_ts, r.last_ts, r.events, r.prev_ts) for r in s.run_to_the_end(stream, "ts", build, "t-hot").collect())
    grouped = gaps.gap_groups(spark.createDataFrame(rows, VISITS), "k", "ts", F.expr("interval 1 minute"), ["id"], strict)
    want = grouped.groupBy("k", "group_id").agg(F.min("ts").alias("f"), F.max("ts").alias("l"), F.count("id").alias("n"))
    want = want.withColumn("p", F.lag("l").over(W.partitionBy("k").orderBy("f"))).collect()
    assert got == sorted((r.k, r.f, r.l, r.n, r.p) for r in want)


def test_ends_are_forgotten(spark, tmp_path):
    batches = [[("a", at(0), 1)], [("z", at(10_000), 2)], [("z", at(10_001), 3)], [("a", at(20_000), 4)], [("z", at(90_000), 5)], [("z", at(90_001), 6)]]
    for forget, alerts in ((None, 1), ("1 hour", 0)):
        (tmp_path / str(forget)).mkdir()
        stream = feed(spark, tmp_path / str(forget), batches, VISITS)
        out = s.run_available(s.repeat_alerts(s.visit_sessions(stream, "k", "ts", "1 minute", "1 minute", forget=forget), "k"), "t-forget")
        assert out.filter("person_id = 'a'").count() == alerts


def test_closing_in_one_run(spark, tmp_path):
    rows = [("a", at(x), x) for x in (0, 30, 400, 9_000)]
    (tmp_path / "in").mkdir()
    spark.createDataFrame(rows, VISITS).write.parquet(str(tmp_path / "in" / "events.parquet"))
    build = lambda df: s.visit_sessions(df, "k", "ts", "1 minute", "10 minutes")
    out = s.run_to_the_end(s.table_stream(spark, str(tmp_path / "in"), "events"), "ts", build, "t-once", at_once=True)
    assert sorted((r.first_ts, r.events) for r in out.collect()) == [(at(0), 2), (at(400), 1), (at(9_000), 1)]


def test_pause_blocks(spark, tmp_path):
    rows = [[("f", at(0), 1, 2.0), ("f", at(4), 2, 1.0)], [("f", at(7), 3, 1.0), ("f", at(9.9), 4, 0.5)], [("z", at(9000), 5, 1.0)]]
    stream = feed(spark, tmp_path, rows, "file string, ts timestamp, id long, seconds double")
    out = s.run_available(s.pause_blocks_stream(stream, "file", "ts", "id", F.col("seconds"), 2, "5 minutes"), "t-pause")
    # Pauses of 2, 2 and 1.9 seconds: a pause equal to the limit splits.
    got = sorted((r.block_start, r.block_end, r.sentences) for r in out.collect() if r.file == "f")
    assert got == [(at(0), at(2), 1), (at(4), at(5), 1), (at(7), at(10.4), 2)]


def test_pause_blocks_of_overlapping_sentences_equal_the_batch(spark, tmp_path):
    rnd = random.Random(9)
    rows = [(rnd.choice(["f", "g", "h", None]), rnd.randrange(0, 4000) / 2, i, rnd.choice([0.5, 1.0, 3.0, 30.0])) for i in range(500)]
    rows.sort(key=lambda r: r[1] + rnd.randrange(200))
    batches = [[(f, at(x), i, d) for f, x, i, d in rows[k : k + 70]] for k in range(0, len(rows), 70)]
    stream = feed(spark, tmp_path, batches, "file string, ts timestamp, id long, seconds double")
    build = lambda df: s.pause_blocks_stream(df, "file", "ts", "id", F.col("seconds"), 2.0, "5 minutes")
    out = s.run_to_the_end(stream, "ts", build, "t-overlap")
    got = sorted(((r.file, r.block_start, r.block_end, r.sentences) for r in out.collect()), key=str)
    batch = spark.createDataFrame([(f, i, x, x + d, "t") for f, x, i, d in rows], "file string, id long, start double, end double, text string")
    want = transcripts.pause_blocks(batch, 2.0).collect()
    assert got == sorted(((r.file, at(r.start_sec), at(r.end_sec), r.sentences) for r in want), key=str)


def test_pause_blocks_of_many_keys_share_their_calls_to_the_state_store(spark, tmp_path):
    """A batch asks for state by groups of keys, so time does not grow with the keys."""
    rnd = random.Random(12)
    rows = [(f"k{rnd.randrange(6000)}", float(rnd.randrange(4000)), i, rnd.choice([0.5, 3.0, 700.0])) for i in range(20_000)]
    rows.sort(key=lambda r: r[1])
    batches = [[(f, at(x), i, d) for f, x, i, d in rows[k : k + 7000]] for k in range(0, len(rows), 7000)]
    stream = feed(spark, tmp_path, batches, "file string, ts timestamp, id long, seconds double")
    build = lambda df: s.pause_blocks_stream(df, "file", "ts", "id", F.col("seconds"), 60.0, "5 minutes")
    folder = str(tmp_path / "many")
    out = s.run_to_the_end(stream, "ts", build, "t-many", folder=folder)
    got = sorted((r.file, r.block_start, r.block_end, r.sentences) for r in out.where("file IS NOT NULL").collect())
    batch = spark.createDataFrame([(f, i, x, x + d, "t") for f, x, i, d in rows], "file string, id long, start double, end double, text string")
    assert got == sorted((r.file, at(r.start_sec), at(r.end_sec), r.sentences) for r in transcripts.pause_blocks(batch, 60.0).collect())
    plan = build(stream)._jdf.queryExecution().analyzed().toString()
    assert "dealt" in plan and s.PAUSE_GROUPS < len({r[0] for r in rows})


def test_late_rows_are_a_result(spark, tmp_path):
    batches = [[("a", at(0)), ("b", None)], [("a", at(2_000)), ("c", at(-50_000))], [("b", at(1_399)), ("b", at(1_400)), ("b", at(1_401))], [("d", at(5_000))]]
    stream = feed(spark, tmp_path, batches, "k string, ts timestamp")
    folder = str(tmp_path / "split")
    in_time, late = s.split_late(stream, "ts", "10 minutes", folder)
    assert sorted((r.k, r.ts) for r in late.collect()) == [("b", at(1_399)), ("b", at(1_400)), ("c", at(-50_000))]
    assert in_time.count() == 5
    spark.createDataFrame([("e", at(4_000)), ("f", at(4_401))], "k string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    in_time, late = s.split_late(stream, "ts", "10 minutes", folder)
    assert sorted(r.k for r in late.collect()) == ["b", "b", "c", "e"] and in_time.count() == 6


def test_filter_and_enrichment_of_messages(spark, tmp_path):
    folder = tmp_path / "text"
    folder.mkdir()
    good = json.dumps({"after": {"id": "e1", "camera": "gate", "label": "car", "has_clip": True, "start_time": 0}})
    lines = [good, "", "nonsense", json.dumps({"after": {"label": "cat", "has_clip": True}}), json.dumps({"label": "car"})]
    (folder / "1.txt").write_text("\n".join(lines))
    summaries = s.filter_events(s.event_stream(spark, str(folder)), ["car", "dog"])
    names = spark.createDataFrame([("gate", "Front gate")], "camera string, shown string")
    out = s.run_available(s.enrich(summaries, names, "camera"), "t-filter").collect()
    assert [(r.clip_id, r.camera, r.labels, r.shown) for r in out] == [("e1", "gate", "car", "Front gate")]


def test_shared_folder_comes_from_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark, "x").startswith(root) and shared_dir(spark, "x") != shared_dir(spark, "x")


def test_tables_of_one_file_and_of_parts(spark, tmp_path):
    spark.range(50).withColumn("ts", F.lit(BASE)).repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    out = s.run_available(s.table_stream(spark, str(tmp_path), "events"), "t-parts")
    assert out.count() == 50
    part = next((tmp_path / "events.parquet").glob("part-*"))
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "events.parquet").write_bytes(part.read_bytes())
    out = s.run_available(s.table_stream(spark, str(tmp_path / "one"), "events"), "t-one")
    assert out.count() == spark.read.parquet(str(part)).count() > 0


def test_open_visits_are_closed_at_the_end(spark, tmp_path):
    stream = feed(spark, tmp_path, visit_batches(), VISITS)
    build = lambda df: s.visit_sessions(df, "k", "ts", "1 minute", "10 minutes")
    out = s.run_to_the_end(stream, "ts", build, "t-end")
    assert [r.events for r in out.filter("k = 'z'").collect()] == [1]
    assert out.filter("k IS NULL").count() == 0
    assert out.agg(F.sum("events")).first()[0] == 11


def test_a_second_run_goes_on(spark, tmp_path):
    stream = feed(spark, tmp_path, [[("x", at(0)), ("y", at(1))]], "h string, ts timestamp")
    build = s.ingest_stream(stream, ["h"], "ts", "1 hour")
    folder = str(tmp_path / "kept")
    assert s.run_available(build, "t-resume", folder=folder).count() == 2
    spark.createDataFrame([("x", at(2)), ("z", at(3))], "h string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert sorted(r.h for r in s.run_available(build, "t-resume", folder=folder).collect()) == ["x", "y", "z"]


def test_alerts_without_visits(spark, tmp_path):
    stream = feed(spark, tmp_path, [[]], VISITS)
    alerts = s.repeat_alerts(s.visit_sessions(stream, "k", "ts", "2 hours", "10 minutes"), "k")
    assert s.run_available(alerts, "t-none-alerts").count() == 0
