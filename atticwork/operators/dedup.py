"""Repeated rows: finding them, choosing which copy stays, and planning the removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import in_parts, ranked


def duplicate_keys(df: DataFrame, key: str, name: str = "copies") -> DataFrame:
    """Keys held by more than one row. Null keys never match anything and are left out."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(name)).filter(F.col(name) > 1)


def duplicate_rows(df: DataFrame, key: str) -> DataFrame:
    """All rows whose key is repeated.

    A semi join against the repeated keys: the counting side is combined before its shuffle and AQE
    splits a hot key on the row side, which a ``count() over (partition by key)`` could not.
    """
    return df.join(duplicate_keys(df, key).select(key), key, "left_semi")


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order`` (ascending, nulls first).

    A ``min`` over a struct is combined on the map side, so copies of a hot key collapse before the
    shuffle. All columns are in that struct: for rows with long texts or vectors see ``first_of_equal``.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    picked = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_row"))
    return picked.select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def _digest(columns: list[str]) -> Column:
    """A digest of several values; each is written with its length, or as null."""
    def part(c: str) -> Column:
        text = F.col(c).cast("string")
        return F.when(text.isNull(), "-").otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*[part(c) for c in columns]).cast("binary"), 256)


def first_of_equal(df: DataFrame, keys: list[str], place: list[str]) -> DataFrame:
    """Of rows with equal ``keys`` the first one by ``place``, which tells the rows of a key apart.

    In two steps, so that neither the keys nor the other columns are ever sorted or held in an aggregate: the first
    place per digest of the keys, combined before the shuffle, then the rows that are at such a place.
    """
    marked = df.withColumn("_digest", _digest(keys))
    first = marked.groupBy("_digest").agg(F.min(F.struct(*place)).alias("_place"))
    winners = first.select(F.col("_digest").alias("_d"), *[F.col(f"_place.{c}").alias(f"_p_{c}") for c in place])
    same = F.col("_digest") == F.col("_d")
    for c in place:
        same = same & F.col(c).eqNullSafe(F.col(f"_p_{c}"))
    # The winners, a few numbers each, are hashed; the rows pass by unsorted.
    return marked.join(winners.hint("shuffle_hash"), same, "left_semi").drop("_digest")


def rank_copies(df: DataFrame, key: str, order: list[str], name: str = "row_num") -> DataFrame:
    """Repeated rows numbered within their key. Number and count of a key come from the same pass."""
    return ranked(df.filter(F.col(key).isNotNull()), [key], order, name, count="_copies").filter("_copies > 1").drop("_copies")


def same_path_duplicates(assets: DataFrame, key: str, path: str, id_: str) -> DataFrame:
    """Second and later rows of one path, looking only at rows whose ``key`` is repeated."""
    return ranked(duplicate_rows(assets, key), [path], [path, id_], "row_num1").filter("row_num1 > 1")


def delete_same_path(assets: DataFrame, key: str, path: str, id_: str) -> DataFrame:
    """The asset table without its same-path duplicates.

    Only the first row of each path has to be known, which takes an aggregate and no ranking."""
    copies = duplicate_rows(assets.select(id_, key, path), key).select(id_, path)
    firsts = copies.groupBy(path).agg(F.min(id_).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    victims = copies.join(firsts, path).filter(F.col(id_) != F.col("_first")).select(id_)
    return assets.join(victims, id_, "left_anti")


def active_assets(df: DataFrame, deleted: str = "deletedAt", status: str = "status") -> DataFrame:
    return df.filter(F.col(deleted).isNull() & (F.col(status) == "active"))


def trash_duplicates(
    assets: DataFrame,
    prefix: str,
    now: Column,
    key: str = "thumbhash",
    path: str = "originalPath",
    id_: str = "id",
) -> DataFrame:
    """Soft delete: every active copy but the first one, if it lies under ``prefix``, becomes trashed."""
    active = active_assets(assets).select(id_, key, path).filter(F.col(key).isNotNull())
    firsts = (
        active.groupBy(key)
        .agg(F.min(F.struct(path, id_)).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1")
        .select(key, F.col(f"_first.{id_}").alias("_first_id"))
    )
    under = active.filter(F.col(path).startswith(prefix))
    victims = under.join(firsts, key).filter(F.col(id_) != F.col("_first_id")).select(id_, F.lit(True).alias("_victim"))
    hit = F.coalesce(F.col("_victim"), F.lit(False))
    return (
        assets.join(victims, id_, "left")
        .withColumn("status", F.when(hit, F.lit("trashed")).otherwise(F.col("status")))
        .withColumn("deletedAt", F.when(hit, now).otherwise(F.col("deletedAt")))
        .drop("_victim")
    )


def duplicate_groups(files: DataFrame, hash_: str = "hash", size: str = "size", path: str = "path") -> DataFrame:
    """Per repeated hash: members, redundant copies and the bytes they waste (by the first member's size)."""
    return (
        files.groupBy(hash_)
        .agg(F.count(F.lit(1)).alias("file_count"), F.min(F.struct(path, size)).alias("_first"))
        .filter("file_count > 1")
        .select(
            hash_,
            "file_count",
            (F.col("file_count") - 1).alias("redundant"),
            F.col(f"_first.{path}").alias("first_path"),
            F.col(f"_first.{size}").alias("size"),
            (F.col(f"_first.{size}") * (F.col("file_count") - 1)).alias("wasted_bytes"),
        )
    )


def duplicate_totals(groups: DataFrame) -> DataFrame:
    return groups.agg(
        F.count(F.lit(1)).alias("groups"),
        F.coalesce(F.sum("redundant"), F.lit(0)).alias("redundant"),
        F.coalesce(F.sum("wasted_bytes"), F.lit(0)).alias("wasted_bytes"),
    )


def dedup_plan(
    files: DataFrame, keep: str = "first", hash_: str = "hash", size: str = "size", path: str = "path"
) -> DataFrame:
    """Files to remove under a keep policy: ``first``, ``last`` (by path) or ``largest``. A dry run:
    no file is touched.

    Only the file to keep is needed per group, so this is an aggregate and a join instead of a rank.
    """
    pick = {
        "first": F.min(F.struct(path)),
        "last": F.max(F.struct(path)),
        "largest": F.min(F.struct((-F.col(size)).alias("_s"), path)),
    }
    if keep not in pick:
        raise ValueError(f"keep must be one of {sorted(pick)}, got {keep!r}")
    groups = (
        files.groupBy(hash_)
        .agg(
            pick[keep].alias("_keep"),
            F.min(F.struct(path, size)).alias("_first"),
            F.count(F.lit(1)).alias("_n"),
        )
        .filter("_n > 1")
        .select(hash_, F.col(f"_keep.{path}").alias("kept"), F.col(f"_first.{size}").alias("freed_bytes"))
    )
    return (
        files.select(hash_, path, size)
        .join(groups, hash_)
        .filter(F.col(path) != F.col("kept"))
        .select(hash_, F.col(path).alias("remove"), "kept", "freed_bytes")
    )


def export_groups(files: DataFrame, hash_: str = "hash", size: str = "size", path: str = "path") -> DataFrame:
    """Duplicate groups as report rows with ``|``-joined paths.

    A group of more than 1000 files spans several rows with ``part`` 0, 1, 2, …; ``file_count`` is
    always that of the whole group.
    """
    groups = duplicate_groups(files, hash_, size, path).select(hash_, "file_count", "size", "first_path")
    members = in_parts(files.select(hash_, path).filter(F.col(hash_).isNotNull()), [hash_], [path], F.col(path), "paths")
    return members.join(groups, hash_).select(
        hash_, "file_count", "size", "part", F.array_join("paths", "|").alias("file_paths")
    )


def write_groups_csv(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").option("header", True).csv(path)
