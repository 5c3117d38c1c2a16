"""Exact ordered scans (row number, lag, running sum, groups) that survive a hot key, with one exchange of the rows.

``Window.partitionBy(key)`` sends every row of one key to one task. When a key holds a large share of
the table that task decides the run time, so each scan here works in two levels:

1. A deterministic hash picks at most ``POINTS`` rows of the table as split points; this reads keys and
   order only. A key that owns ``HOT_POINTS`` or more of them is hot and its order range is cut at those points.
2. The rows are dealt once, by key and segment, packed into one column. Everything else reads that one
   exchange: windows per (key, segment), and one summary row per hot segment, which carries the state
   over the segment borders and is joined back by broadcast.

Packing keeps the exchange the same for all its readers. Were the columns loose, each reader would have
the ones it does not use removed below the exchange, and Spark would shuffle the rows once per reader.

Split points and summaries hold at most a few times ``POINTS`` rows whatever the input size, which is what
makes broadcasting them safe. The split points only decide where a range is cut; results are exact.

``order`` is a list of column names, ascending, nulls first. Its last member should make rows unique.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# A key with HOT_POINTS of POINTS split points holds about 1/2000 of the rows or more and is cut into
# pieces of about 1/8000; all the split points together stay below a few megabytes.
POINTS = 8192
HOT_POINTS = 4
# One row in THIN takes part in choosing split points; a table too small to yield any needs none.
THIN = 64

# Split points are looked up in two levels, so that a row meets two short lists and not one long one.
_CHUNK = 96


def _attach(df: DataFrame, small: DataFrame, names: list[str]) -> DataFrame:
    """Left join with a table of proven small size on null-safe keys, keeping the left keys once."""
    renamed = small.select(
        *[F.col(n).alias(f"_r_{n}") for n in names], *[c for c in small.columns if c not in names]
    )
    on = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_r_{n}")) for n in names])
    return df.join(F.broadcast(renamed), on, "left").drop(*[f"_r_{n}" for n in names])


def _count_up_to(df: DataFrame, points: str, here: str, most: int, name: str) -> DataFrame:
    """Add how many members of a sorted list of at most ``most`` lie at or before ``here``.

    The steps of the binary search are plain columns, each built on the one before, so that they are
    compiled; a lambda would be interpreted row by row.
    """
    df = df.withColumn(name, F.lit(0))
    for step in [2**n for n in range(most.bit_length() - 1, -1, -1)]:
        beyond = F.get(F.col(points), F.col(name) + (step - 1)) <= F.col(here)
        df = df.withColumn(name, F.col(name) + F.when(beyond, step).otherwise(0))
    return df


def _split_points(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Sorted split points per hot key, at most ``POINTS`` in all."""
    mark = F.xxhash64(*keys, *order)
    picks = (
        df.select(*keys, F.struct(*order).alias("_o"), mark.alias("_h"))
        .filter(F.pmod(F.shiftright("_h", 32), F.lit(THIN)) == 0)
        .groupBy(F.pmod("_h", F.lit(POINTS)).alias("_b"))
        .agg(F.min(F.struct("_h", *keys, "_o")).alias("_p"))
    )
    return (
        picks.select(*[F.col(f"_p.{k}").alias(k) for k in keys], F.col("_p._o").alias("_o"))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list("_o")).alias("_splits"))
        .filter(F.size("_splits") >= HOT_POINTS)
    )


def with_segments(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add ``_seg``: the number of a row's segment where its key is hot, in the order of the rows, and null elsewhere."""
    splits = _split_points(df, keys, order)
    chunks = F.sequence(F.lit(0), F.floor((F.size("_splits") - 1) / _CHUNK).cast("int"))
    coarse = splits.select(*keys, F.transform(chunks, lambda i: F.get("_splits", i * _CHUNK)).alias("_coarse"))
    fine = splits.select(
        *keys, F.posexplode(F.transform(chunks, lambda i: F.slice("_splits", i * _CHUNK + 1, _CHUNK))).alias("_chunk", "_fine")
    )
    placed = _attach(df.withColumn("_here", F.struct(*order)), coarse, keys).withColumn("_hot", F.col("_coarse").isNotNull())
    placed = _count_up_to(placed, "_coarse", "_here", POINTS // _CHUNK + 1, "_before").drop("_coarse")
    placed = placed.withColumn("_chunk", F.when(F.col("_hot"), F.col("_before") - 1))
    within = _attach(placed, fine, [*keys, "_chunk"])
    within = _count_up_to(within, "_fine", "_here", _CHUNK, "_inside")
    seg = F.when(F.col("_hot"), F.coalesce(F.col("_chunk") * _CHUNK + F.col("_inside"), F.lit(0)))
    return within.withColumn("_seg", seg).drop("_fine", "_chunk", "_before", "_inside", "_here", "_hot")


class _Dealt:
    """The rows of a table, dealt once by key and segment."""

    def __init__(self, df: DataFrame, keys: list[str], order: list[str]) -> None:
        self.keys, self.order, self.columns = keys, order, df.columns
        self._packed = [c for c in df.columns if c not in keys]
        row = F.struct(*(self._packed or [F.lit(True).alias("_")]))
        seg = with_segments(df, keys, order)
        self._rows = seg.select(*keys, "_seg", F.array(row).alias("_row")).repartition(*keys, "_seg")

    def _unpacked(self, rows: DataFrame) -> DataFrame:
        row = F.col("_row")[0]
        return rows.select(*self.keys, "_seg", *[row[c].alias(c) for c in self._packed])

    def _only(self, wanted: Column | None = None) -> DataFrame:
        # Always true, but it depends on the packed row and on the partition: so the test stays above the
        # exchange and the row stays in it. Else the exchange would not be the one the other readers use.
        here = F.spark_partition_id() + F.size("_row") > 0
        return self._unpacked(self._rows.filter(here if wanted is None else F.when(wanted, here).otherwise(False)))

    def rows(self) -> DataFrame:
        return self._only()

    def hot(self) -> DataFrame:
        return self._only(F.col("_seg").isNotNull())

    def cold(self) -> DataFrame:
        return self._only(F.col("_seg").isNull())

    def window(self):
        return W.partitionBy(*self.keys, "_seg").orderBy(*self.order)

    def upto(self):
        return self.window().rowsBetween(W.unboundedPreceding, 0)

    def before(self):
        """All segments of a key before this one, among the summaries."""
        return W.partitionBy(*self.keys).orderBy("_seg").rowsBetween(W.unboundedPreceding, -1)

    def segments(self):
        return W.partitionBy(*self.keys).orderBy("_seg")

    def attach(self, rows: DataFrame, summaries: DataFrame) -> DataFrame:
        return _attach(rows, summaries, [*self.keys, "_seg"])


def _ranked(dealt: _Dealt, rows: DataFrame, name: str, count: str | None = None) -> DataFrame:
    offset = F.coalesce(F.sum("_n").over(dealt.before()), F.lit(0)).alias("_offset")
    summary = dealt.hot().groupBy(*dealt.keys, "_seg").agg(F.count(F.lit(1)).alias("_n"))
    total = [F.sum("_n").over(W.partitionBy(*dealt.keys)).alias("_all")] if count else []
    local = rows.withColumn(name, F.row_number().over(dealt.window()).cast("long"))
    out = dealt.attach(local, summary.select(*dealt.keys, "_seg", offset, *total))
    out = out.withColumn(name, F.col(name) + F.coalesce("_offset", F.lit(0)))
    if count:
        out = out.withColumn(count, F.coalesce("_all", F.count(F.lit(1)).over(W.partitionBy(*dealt.keys, "_seg"))))
    return out.drop("_offset", "_all")


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str = "row_num", count: str | None = None) -> DataFrame:
    """``row_number() over (partition by keys order by order)`` as column ``name``, and ``count(*) over (partition by
    keys)`` as column ``count`` if that is named."""
    dealt = _Dealt(df, keys, order)
    added = [name, *([count] if count else [])]
    return _ranked(dealt, dealt.rows(), name, count).select(*[c for c in df.columns if c not in added], *added)


def lagged(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``lag(value) over (partition by keys order by order)`` as column ``name``."""
    dealt = _Dealt(df, keys, order)
    last = F.max(F.struct(*order, F.col(value).alias("_v"))).alias("_last")
    carries = (
        dealt.hot().groupBy(*keys, "_seg").agg(last)
        .select(*keys, "_seg", F.lag(F.col("_last._v")).over(dealt.segments()).alias("_carry"))
    )
    w = dealt.window()
    local = dealt.rows().withColumns({"_local": F.lag(value).over(w), "_first": F.row_number().over(w) == 1})
    return (
        dealt.attach(local, carries)
        .withColumn(name, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_local")))
        .select(*[c for c in df.columns if c != name], name)
    )


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Sum of ``value`` from the first row of the key up to and including this row."""
    dealt = _Dealt(df, keys, order)
    offsets = (
        dealt.hot()
        .groupBy(*keys, "_seg")
        .agg(F.sum(value).alias("_s"))
        .select(*keys, "_seg", F.sum("_s").over(dealt.before()).alias("_offset"))
    )
    local = dealt.rows().withColumn(name, F.sum(value).over(dealt.upto()))
    return (
        dealt.attach(local, offsets)
        .withColumn(name, F.col(name) + F.coalesce("_offset", F.lit(0)))
        .select(*[c for c in df.columns if c != name], name)
    )


Flag = Callable[[DataFrame], Column]


def _local_groups(dealt: _Dealt, rows: DataFrame, flag: Flag, group: str, place: str, known: bool) -> DataFrame:
    """Flags, numbers of groups and places as far as one segment tells.

    ``rows`` have the previous value and ``_pos``. Unless ``known``, the first row of a segment does not
    know what precedes it and has no flag yet.
    """
    is_new = flag(rows) if known else F.when(F.col("_pos") > 1, flag(rows)).otherwise(0)
    flagged = rows.withColumn("is_new", is_new)
    started = F.max(F.when(F.col("is_new") == 1, F.col("_pos"))).over(dealt.upto())
    return flagged.withColumns({group: F.sum("is_new").over(dealt.upto()), place: started})


def _grouped(dealt: _Dealt, rows: DataFrame, value: str, flag: Flag, group: str, prev: str, place: str) -> DataFrame:
    w = dealt.window()

    def positioned(df: DataFrame) -> DataFrame:
        return df.withColumns({prev: F.lag(value).over(w), "_pos": F.row_number().over(w).cast("long")})

    inside = _local_groups(dealt, positioned(dealt.hot()), flag, "_g", "_start", known=False)
    whole = F.struct(*dealt.order, *[F.col(c).alias(f"_v_{c}") for c in dealt.columns])
    summary = (
        inside.groupBy(*dealt.keys, "_seg")
        .agg(
            F.min(whole).alias("_first"), F.max(F.struct(*dealt.order, F.col(value).alias("_v"))).alias("_last"),
            F.count(F.lit(1)).alias("_n"), F.sum("is_new").alias("_new"), F.max("_start").alias("_start"),
        )
        .withColumn("_carry", F.lag(F.col("_last._v")).over(dealt.segments()))
    )
    # The first row of each segment, now with the value before it, is judged by the same rule.
    kept = ["_seg", "_n", "_new", "_start", "_carry"]
    firsts = summary.select(*kept, *[F.col(f"_first._v_{c}").alias(c) for c in dealt.columns], F.col("_carry").alias(prev))
    before = dealt.before()
    carried = (
        firsts.withColumn("_opens", flag(firsts))
        .withColumn("_n0", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn("_g0", F.coalesce(F.sum(F.col("_new") + F.col("_opens")).over(before), F.lit(0)))
        .withColumn("_at", F.col("_n0") + F.coalesce("_start", F.when(F.col("_opens") == 1, F.lit(1))))
        .withColumn("_s0", F.last("_at", ignorenulls=True).over(before))
        .select(*dealt.keys, "_seg", "_n0", "_g0", "_s0", "_carry")
    )
    joined = dealt.attach(positioned(rows), carried)
    joined = joined.withColumn(prev, F.when(F.col("_pos") == 1, F.col("_carry")).otherwise(F.col(prev)))
    local = _local_groups(dealt, joined, flag, group, place, known=True)
    rows_before = F.coalesce("_n0", F.lit(0))
    started = F.coalesce(rows_before + F.col(place), F.col("_s0"))
    return local.withColumns(
        {group: F.col(group) + F.coalesce("_g0", F.lit(0)), place: rows_before + F.col("_pos") - started + 1}
    ).drop("_pos", "_n0", "_g0", "_s0", "_carry")


def lag_then_group(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: str,
    flag: Flag,
    group: str,
    prev: str = "prev_value",
    place: str = "place",
) -> DataFrame:
    """Groups of consecutive rows.

    ``flag`` maps a DataFrame that has column ``prev`` (the lag of ``value``) to 1 where a group starts.
    Adds ``is_new``, the running number ``group`` and the row's ``place`` within its group, from 1.
    """
    dealt = _Dealt(df, keys, order)
    added = [prev, "is_new", group, place]
    return _grouped(dealt, dealt.rows(), value, flag, group, prev, place).select(*[c for c in df.columns if c not in added], *added)


PART_ROWS = 1000


def _parts(rows: DataFrame, keys: list[str], near: list[str], place: str, item: Column, name: str, part_rows: int) -> DataFrame:
    """Lists of at most ``part_rows`` items in order of their place. ``near`` are columns that do not change within
    a key but are part of how the rows are dealt, so that rows which lie together are not dealt again."""
    return (
        rows.withColumn("part", F.floor((F.col(place) - 1) / part_rows).cast("int"))
        .groupBy(*keys, *near, "part")
        .agg(F.array_sort(F.collect_list(F.struct(F.col(place).alias("_rn"), item.alias("_item")))).alias("_items"))
        .select(*keys, "part", F.col("_items._item").alias(name))
    )


def parts_by_place(
    df: DataFrame, keys: list[str], place: str, item: Column, name: str, part_rows: int = PART_ROWS
) -> DataFrame:
    """Ordered lists as in ``in_parts``, of rows that already know their ``place`` within the key, from 1."""
    return _parts(df, keys, [], place, item, name, part_rows)


def in_parts(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    item: Column,
    name: str,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Ordered list aggregation with bounded rows.

    One output row per key and ``part`` (0, 1, 2, …), each holding at most ``part_rows`` items in
    order. Nothing is dropped: the parts of a key put together are the whole list.

    Lists of keys that are not hot are made where the rows lie; only rows of hot keys, whose parts may
    cross a segment border, are dealt a second time.
    """
    dealt = _Dealt(df, keys, order)
    whole = dealt.cold().withColumn("_rn", F.row_number().over(dealt.window()).cast("long"))
    cut = _ranked(dealt, dealt.hot(), "_rn")
    return _parts(whole, keys, ["_seg"], "_rn", item, name, part_rows).unionByName(_parts(cut, keys, [], "_rn", item, name, part_rows))


def grouped_parts(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: str,
    flag: Flag,
    group: str,
    item: Column,
    name: str,
    prev: str = "prev_value",
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """The groups of ``lag_then_group`` as ordered lists, one row per key, group and ``part``, as in ``in_parts``."""
    dealt = _Dealt(df, keys, order)
    w = dealt.window()
    cold = dealt.cold().withColumns({prev: F.lag(value).over(w), "_pos": F.row_number().over(w).cast("long")})
    whole = _local_groups(dealt, cold, flag, group, "_start", known=True).withColumn("_rn", F.col("_pos") - F.col("_start") + 1)
    cut = _grouped(dealt, dealt.hot(), value, flag, group, prev, "_rn")
    lists = [_parts(whole, [*keys, group], ["_seg"], "_rn", item, name, part_rows), _parts(cut, [*keys, group], [], "_rn", item, name, part_rows)]
    return lists[0].unionByName(lists[1])
