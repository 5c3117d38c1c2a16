"""Segmented scans equal plain windows, whatever the skew."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from atticwork.operators import dedup, gaps, ordered


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    data = []
    for i in range(3000):
        key = 0 if i % 3 == 0 else rnd.randrange(40)
        ts = None if rnd.random() < 0.02 else start + dt.timedelta(seconds=rnd.randrange(50_000))
        data.append((None if rnd.random() < 0.01 else key, i, ts, rnd.randrange(5)))
    return spark.createDataFrame(data, "k int, id long, ts timestamp, v int").repartition(5).cache()


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_hot_keys_are_cut(rows, split_everything):
    seg = ordered.with_segments(rows.select("k", "ts", "id"), ["k"], ["ts", "id"])
    per_key = seg.groupBy("k").agg(F.count_distinct("_seg").alias("n")).collect()
    assert max(r.n for r in per_key) > 20


def test_ranked(rows, split_everything):
    w = W.partitionBy("k").orderBy("ts", "id")
    same(
        ordered.ranked(rows, ["k"], ["ts", "id"]).select("id", "row_num"),
        rows.select("id", F.row_number().over(w).cast("long").alias("row_num")),
    )


def test_lagged_and_running_sum(rows, split_everything):
    w = W.partitionBy("k").orderBy("ts", "id")
    same(
        ordered.lagged(rows, ["k"], ["ts", "id"], "v", "p").select("id", "p"),
        rows.select("id", F.lag("v").over(w).alias("p")),
    )
    same(
        ordered.running_sum(rows, ["k"], ["ts", "id"], "v", "s").select("id", "s"),
        rows.select("id", F.sum("v").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("s")),
    )


def test_groups_and_places(rows, split_everything):
    def flag(d):
        return F.when(d["p"].isNull() | (d["p"] != d["v"]), 1).otherwise(0)

    mine = ordered.lag_then_group(rows, ["k"], ["ts", "id"], "v", flag, "g", "p")
    w = W.partitionBy("k").orderBy("ts", "id")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    plain = rows.withColumn("p", F.lag("v").over(w))
    plain = plain.withColumn("f", flag(plain)).withColumn("g", F.sum("f").over(upto))
    plain = plain.withColumn("place", F.row_number().over(W.partitionBy("k", "g").orderBy("ts", "id")).cast("long"))
    same(mine.select("id", "g", "place"), plain.select("id", "g", "place"))


def test_parts_are_whole_and_bounded(rows, split_everything):
    parts = ordered.in_parts(rows, ["k"], ["ts", "id"], F.col("id"), "ids", part_rows=50).collect()
    assert max(len(p.ids) for p in parts) == 50
    got = {}
    for p in sorted(parts, key=lambda p: (str(p.k), p.part)):
        got.setdefault(p.k, []).extend(p.ids)
    expected = {}
    for r in sorted(rows.collect(), key=lambda r: (r.ts is not None, r.ts or 0, r.id)):
        expected.setdefault(r.k, []).append(r.id)
    assert got == expected


@pytest.mark.parametrize("strict", [True, False])
def test_visits_equal_one_plus_gaps(rows, split_everything, strict):
    gap = F.expr("interval 5 minutes")
    mine = {r.k: r.groups_count for r in gaps.visit_counts(rows.filter("k is not null"), "k", "ts", gap, ["id"], strict).collect()}
    times = {}
    for r in rows.filter("k is not null").collect():
        times.setdefault(r.k, []).append(r.ts)
    for k, all_ in times.items():
        ordered_ = sorted(t for t in all_ if t) + [None] * sum(t is None for t in all_)
        count = 0
        for i, t in enumerate(ordered_):
            prev = ordered_[i - 1] if i else None
            if prev is None:
                count += 1
            elif t is not None:
                d = t - prev
                limit = dt.timedelta(minutes=5)
                count += d > limit if strict else d >= limit
        assert mine[k] == count


def test_dedup_is_idempotent(rows, split_everything):
    once = dedup.first_per_key(rows, ["k", "v"], ["id"])
    same(once, dedup.first_per_key(once, ["k", "v"], ["id"]))


def test_split_choice_does_not_change_results(rows, monkeypatch):
    plain = sorted(map(str, ordered.ranked(rows, ["k"], ["id"]).select("id", "row_num").collect()))
    monkeypatch.setattr(ordered, "THIN", 1)
    for points in (16, 64, 4096):
        monkeypatch.setattr(ordered, "POINTS", points)
        assert plain == sorted(map(str, ordered.ranked(rows, ["k"], ["id"]).select("id", "row_num").collect()))


@pytest.mark.parametrize("scan", ["ranked", "lagged", "groups", "sum", "parts", "grouped_parts"])
def test_one_exchange_of_the_rows(spark, rows, split_everything, tmp_path, scan):
    path = str(tmp_path / "rows")
    rows.withColumn("text", F.lit("full row")).write.parquet(path)
    table = spark.read.parquet(path)
    keys, order = ["k"], ["ts", "id"]
    flag = lambda d: F.when(d["p"].isNull() | (d["p"] != d["v"]), 1).otherwise(0)
    made = {
        "ranked": lambda: ordered.ranked(table, keys, order, count="n"),
        "lagged": lambda: ordered.lagged(table, keys, order, "v", "p"),
        "groups": lambda: ordered.lag_then_group(table, keys, order, "v", flag, "g", "p"),
        "sum": lambda: ordered.running_sum(table, keys, order, "v", "s"),
        "parts": lambda: ordered.in_parts(table, keys, order, F.struct("id", "text"), "ids", 50),
        "grouped_parts": lambda: ordered.grouped_parts(table, keys, order, "v", flag, "g", F.struct("id", "text"), "ids", "p", 50),
    }[scan]
    # The consumer reads few of the columns; the exchange stays one all the same.
    for df in (made(), made().groupBy("k").agg(F.count("*").alias("n"))):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("Scan parquet") == 2, plan
        whole_rows = [line for line in plan.splitlines() if "REPARTITION" in line and "ReusedExchange" not in line]
        assert len(whole_rows) == 1, plan


def test_counts_and_grouped_lists(rows, split_everything):
    w = W.partitionBy("k")
    same(
        ordered.ranked(rows, ["k"], ["ts", "id"], "r", count="n").select("id", "n"),
        rows.select("id", F.count(F.lit(1)).over(w).alias("n")),
    )
    flag = lambda d: F.when(d["p"].isNull() | (d["p"] != d["v"]), 1).otherwise(0)
    lists = ordered.grouped_parts(rows, ["k"], ["ts", "id"], "v", flag, "g", F.col("id"), "ids", "p", part_rows=3)
    grouped = ordered.lag_then_group(rows, ["k"], ["ts", "id"], "v", flag, "g", "p")
    plain = grouped.withColumn("part", F.floor((F.col("place") - 1) / 3).cast("int")).groupBy("k", "g", "part").agg(
        F.array_sort(F.collect_list(F.struct("place", "id")))["id"].alias("ids")
    )
    same(lists.select("k", "g", "part", "ids"), plain)
