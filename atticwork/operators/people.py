"""Persons, faces and assets: counts, lists, merging, memberships and repeat visitors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from .gaps import max_gap
from .ordered import in_parts
from .paging import top_per_key

# --- persons and faces: persons(id, name), faces(id, asset_id, person_id, score, …) ---


def person_stats(persons: DataFrame, faces: DataFrame) -> DataFrame:
    """One row of totals: two single-row aggregates, stacked and folded into one row."""
    named = F.col("name").isNotNull() & (F.col("name") != "")
    p = persons.agg(F.count_if(named).alias("named_persons"), F.count(F.lit(1)).alias("total_persons"))
    f = faces.agg(
        F.count(F.lit(1)).alias("total_faces"),
        F.count_distinct("asset_id").alias("assets_with_faces"),
        F.count_if(F.col("person_id").isNull()).alias("unassigned_faces"),
    )
    both = p.unionByName(f, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def face_counts(faces: DataFrame) -> DataFrame:
    return faces.filter("person_id is not null").groupBy("person_id").agg(F.count("id").alias("face_count"))


def list_persons(persons: DataFrame, faces: DataFrame, q: str | None = None, named_only: bool = False) -> DataFrame:
    """Persons with their number of faces, largest first. Faces are counted before the join, so the
    join sees one row per person."""
    if named_only:
        persons = persons.filter("name is not null and name <> ''")
    if q:
        persons = persons.filter(t.contains_ci("name", q))
    counts = face_counts(faces).withColumnRenamed("person_id", "id")
    return (
        persons.select("id", "name")
        .join(counts, "id", "left")
        .withColumn("face_count", F.coalesce("face_count", F.lit(0)))
        .orderBy(F.desc("face_count"), F.asc_nulls_last("name"), "id")
    )


def assets_with_faces(faces: DataFrame, assets: DataFrame) -> DataFrame:
    """Assets that have faces, with the number of all and of assigned faces."""
    per_asset = faces.groupBy("asset_id").agg(
        F.count("id").alias("face_count"), F.count_if(F.col("person_id").isNotNull()).alias("named_count")
    )
    return per_asset.join(assets.withColumnRenamed("id", "asset_id"), "asset_id").orderBy(
        F.desc("face_count"), "asset_id"
    )


def asset_faces(faces: DataFrame, persons: DataFrame) -> DataFrame:
    """Faces of assets with the name of their person, if any."""
    names = persons.select(F.col("id").alias("person_id"), F.col("name").alias("person_name"))
    return faces.join(names, "person_id", "left")


def faces_by_score(faces: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The ``n`` best-scored faces per person (or asset), faces without score last."""
    return top_per_key(faces, keys, [F.desc_nulls_last("score"), F.col("id")], n)


def unassigned_faces(faces: DataFrame) -> DataFrame:
    return faces.filter("person_id is null").orderBy(F.desc_nulls_last("score"), "id")


def rename_person(persons: DataFrame, id_: int | str, name: str, column: str = "name") -> DataFrame:
    """New version of the table; a blank name becomes null."""
    value = F.lit(name.strip() or None).cast("string")
    return persons.withColumn(column, F.when(F.col("id") == id_, value).otherwise(F.col(column)))


def merge_persons(faces: DataFrame, source: int | str, target: int | str) -> DataFrame:
    """New version of the face table with the faces of ``source`` given to ``target``."""
    return faces.withColumn(
        "person_id", F.when(F.col("person_id") == source, F.lit(target)).otherwise(F.col("person_id"))
    )


def merge_record(persons: DataFrame, faces: DataFrame, source: int | str, target: int | str, at: Column) -> DataFrame:
    """The audit row of a merge; no row when one of the two persons does not exist."""
    one = lambda id_: F.max(F.when(F.col("id") == id_, F.struct("id", "name")))
    pair = persons.filter(F.col("id").isin(source, target)).agg(one(source).alias("s"), one(target).alias("t"))
    moved = faces.filter(F.col("person_id") == source).agg(F.count("id").alias("moved"))
    both = pair.unionByName(moved, allowMissingColumns=True)
    folded = both.agg(F.max("s").alias("s"), F.max("t").alias("t"), F.max("moved").alias("face_count_moved"))
    return folded.filter("s is not null and t is not null").select(
        F.col("s.id").alias("source_person_id"), F.col("t.id").alias("target_person_id"),
        F.col("s.name").alias("source_person_name"), F.col("t.name").alias("target_person_name"),
        "face_count_moved", at.alias("merged_at"),
    )


def append_log(record: DataFrame, table: str) -> None:
    record.write.mode("append").saveAsTable(table)


def iso_utc(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def merge_log(log: DataFrame, limit: int = 100) -> DataFrame:
    """Newest entries first, the time as ISO text."""
    newest = log.orderBy(F.desc("merged_at"), "source_person_id").limit(limit)
    return newest.withColumn("merged_at", iso_utc("merged_at"))


# --- memberships ---


def sync_plan(target: DataFrame, current: DataFrame, mode: str = "sync", wanted: DataFrame | None = None) -> DataFrame:
    """What to do so that ``current(label, asset_id)`` becomes ``target(label, asset_id)``.

    ``action`` is add or remove; ``create_label`` tells that the label has no rows yet and must be
    created. Mode ``add`` never removes. ``wanted`` (label) names labels to bring in line even if the target has no assets
    for them: those present are emptied, the others get one row with action create and no asset. All other
    labels missing from the target are left alone.

    Both sides are stacked and folded per (label, asset): a set operation with map-side combine that
    needs no join and cannot be skewed by one label.
    """
    if mode not in ("sync", "add"):
        raise ValueError("mode must be 'sync' or 'add'")
    both = target.select("label", "asset_id", F.lit(1).alias("t"), F.lit(0).alias("c")).unionByName(
        current.select("label", "asset_id", F.lit(0).alias("t"), F.lit(1).alias("c"))
    )
    pairs = both.groupBy("label", "asset_id").agg(F.max("t").alias("t"), F.max("c").alias("c"))
    labels = both.groupBy("label").agg(F.max("t").alias("wanted"), F.max("c").alias("present"))
    changes = pairs.filter("t <> c" if mode == "sync" else "t = 1 and c = 0")
    new = None
    if wanted is not None:
        asked = wanted.select("label").distinct()
        new = asked.join(labels, "label", "left_anti")
        labels = labels.join(asked.withColumn("_asked", F.lit(1)), "label", "left").withColumn("wanted", F.greatest("wanted", "_asked"))
    plan = (
        changes.join(labels.filter("wanted = 1"), "label")
        .select(
            "label",
            "asset_id",
            F.when(F.col("t") == 1, "add").otherwise("remove").alias("action"),
            (F.col("present") == 0).alias("create_label"),
        )
    )
    if new is None:
        return plan
    nothing = F.lit(None).cast(plan.schema["asset_id"].dataType).alias("asset_id")
    return plan.unionByName(new.select("label", nothing, F.lit("create").alias("action"), F.lit(True).alias("create_label")))


def sync_summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("label").agg(
        F.count_if(F.col("action") == "add").alias("added"),
        F.count_if(F.col("action") == "remove").alias("removed"),
        F.max("create_label").alias("created"),
    )


def sync_totals(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.count(F.lit(1)).alias("persons"),
        F.coalesce(F.sum("added"), F.lit(0)).alias("added"),
        F.coalesce(F.sum("removed"), F.lit(0)).alias("removed"),
    )


def set_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` not in ``b``; swap the arguments for the other direction."""
    return a.select(*a.columns).distinct().join(b.select(*a.columns).distinct(), a.columns, "left_anti")


def resolve_groups(refs: DataFrame, people: DataFrame) -> DataFrame:
    """Person references ``refs(kind, value)`` as (label, person_id).

    A name stands for every person of that name, an id for the one person under that person's name.
    Unnamed people cannot be found by name, but by id they can, under an empty label.
    """
    people = people.select(F.col("id").cast("string").alias("person_id"), F.coalesce("name", F.lit("")).alias("label"))
    by_id = refs.filter("kind = 'id'").select(F.col("value").alias("person_id")).join(people, "person_id")
    by_name = refs.filter("kind = 'name'").select(F.col("value").alias("label")).join(
        people.filter("label <> ''"), "label"
    )
    return by_id.select("label", "person_id").unionByName(by_name.select("label", "person_id")).distinct()


def unresolved_refs(refs: DataFrame, people: DataFrame) -> DataFrame:
    known = people.select(F.lit("id").alias("kind"), F.col("id").cast("string").alias("value")).unionByName(
        people.filter("name is not null and name <> ''").select(F.lit("name").alias("kind"), F.col("name").alias("value"))
    )
    return refs.join(known, ["kind", "value"], "left_anti")


# --- repeat visitors: assets(id, file_created_at, original_path, people: array<struct<id, name>>) ---


def scan_assets(*feeds: DataFrame) -> DataFrame:
    """One table from the separate feeds (available and offline assets)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)


def in_scope(assets: DataFrame, folders: list[str], path: str = "original_path") -> DataFrame:
    """Assets below any folder of that name, any case."""
    low = F.lower(path)
    return assets.filter(reduce(lambda a, b: a | b, [F.contains(low, F.lit(f"/{f.lower()}/")) for f in folders]))


def appearances(assets: DataFrame) -> DataFrame:
    return assets.select("id", "file_created_at", F.explode("people").alias("p")).select(
        F.col("p.id").alias("person_id"), F.col("p.name").alias("name"), F.col("id").alias("asset_id"), "file_created_at"
    )


def frequent_persons(seen: DataFrame, gap_hours: float = 1) -> DataFrame:
    """Persons with more than ``gap_hours`` between two consecutive appearances.

    ``name`` is the first non-empty one in time. The assets of these persons are a table of their own
    (``frequent_assets``), since a busy person has any number of them.
    """
    gaps = max_gap(seen, "person_id", "file_created_at", ["asset_id"])
    names = (
        seen.filter("name is not null and name <> ''")
        .groupBy("person_id")
        .agg(F.min(F.struct("file_created_at", "asset_id", "name")).alias("first"))
        .select("person_id", F.col("first.name").alias("name"))
    )
    return (
        gaps.filter(F.col("max_gap_us") > F.lit(int(gap_hours * 3_600_000_000)))
        .join(names, "person_id", "left")
        .select(
            "person_id",
            F.coalesce("name", F.lit("")).alias("name"),
            "appearances",
            "first_seen",
            "last_seen",
            (F.col("max_gap_us") / 3_600_000_000).alias("max_gap_hours"),
        )
        .orderBy(F.desc("appearances"), "person_id")
    )


def frequent_assets(seen: DataFrame, candidates: DataFrame) -> DataFrame:
    """Appearances of the qualifying persons, in parts of at most 1000 assets per row, in time order."""
    own = seen.join(candidates.select("person_id"), "person_id", "left_semi")
    return in_parts(own, ["person_id"], ["file_created_at", "asset_id"], F.col("asset_id"), "asset_ids")


def assets_to_tag(seen: DataFrame, candidates: DataFrame) -> DataFrame:
    return seen.join(candidates.select("person_id"), "person_id", "left_semi").select("asset_id").distinct()


def tag_frequent(
    assets: DataFrame, persons: DataFrame, seen: DataFrame, candidates: DataFrame, tag: str, favorite: bool = True
) -> tuple[DataFrame, DataFrame]:
    """New versions of assets (``tags`` gains the tag) and persons (``is_favorite`` set)."""
    to_tag = assets_to_tag(seen, candidates).select(F.col("asset_id").alias("id"), F.lit(True).alias("_hit"))
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    tagged = assets.join(to_tag, "id", "left").withColumn(
        "tags", F.when(F.col("_hit"), F.array_union(tags, F.array(F.lit(tag)))).otherwise(F.col("tags"))
    ).drop("_hit")
    if not favorite:
        return tagged, persons
    hit = candidates.select(F.col("person_id").alias("id"), F.lit(True).alias("_hit"))
    liked = persons.join(hit, "id", "left").withColumn(
        "is_favorite", F.coalesce(F.col("_hit") | F.col("is_favorite"), F.col("_hit"), F.col("is_favorite"))
    ).drop("_hit")
    return tagged, liked
