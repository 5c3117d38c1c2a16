"""Repeated rows over ``documents`` (text digest = hash, source path, n_chars = size)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dedup as d
from .catalog import Tables, query


def files(t: Tables) -> DataFrame:
    path = F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".txt"))
    return t.documents.select(F.md5("text").alias("hash"), path.alias("path"), F.col("n_chars").alias("size"))


def assets(t: Tables) -> DataFrame:
    """Documents as assets. The path is that of the source and language, so paths repeat too; the file
    name is missing and the row already deleted for some."""
    return t.documents.select(
        F.col("doc_id").alias("id"),
        F.md5("text").alias("thumbhash"),
        F.concat_ws("/", F.lit("/photos"), "source", "lang").alias("originalPath"),
        F.when(F.col("lang") == "de", F.lit("trashed")).otherwise("active").alias("status"),
        F.lit(None).cast("string").alias("deletedAt"),
    )


_FILES = """
    f AS (SELECT md5(text) AS hash, '/' || source || '/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.txt' AS path,
                 n_chars AS size FROM documents)
"""
_ASSETS = """
    a AS (SELECT doc_id AS id, md5(text) AS thumbhash, '/photos/' || source || '/' || lang AS originalPath,
                 CASE WHEN lang = 'de' THEN 'trashed' ELSE 'active' END AS status FROM documents),
    dup AS (SELECT *, row_number() OVER (PARTITION BY thumbhash ORDER BY originalPath, id) AS row_num,
                   row_number() OVER (PARTITION BY originalPath ORDER BY originalPath, id) AS row_num1
            FROM a WHERE thumbhash IN (SELECT thumbhash FROM a GROUP BY thumbhash HAVING count(*) > 1))
"""


@query("SELECT md5(text) AS thumbhash, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(t: Tables) -> DataFrame:
    return d.duplicate_keys(assets(t), "thumbhash")


@query(f"WITH {_ASSETS} SELECT id, thumbhash, originalPath FROM dup")
def duplicate_rows(t: Tables) -> DataFrame:
    return d.duplicate_rows(assets(t), "thumbhash").select("id", "thumbhash", "originalPath")


@query(f"WITH {_ASSETS} SELECT id, thumbhash, row_num FROM dup")
def ranked_copies(t: Tables) -> DataFrame:
    return d.rank_copies(assets(t), "thumbhash", ["originalPath", "id"]).select("id", "thumbhash", "row_num")


@query(f"WITH {_ASSETS} SELECT id, originalPath, row_num1 FROM dup WHERE row_num1 > 1")
def same_path_duplicates(t: Tables) -> DataFrame:
    found = d.same_path_duplicates(assets(t), "thumbhash", "originalPath", "id")
    return found.select("id", "originalPath", "row_num1")


@query(f"WITH {_ASSETS} SELECT id, originalPath FROM a WHERE id NOT IN (SELECT id FROM dup WHERE row_num1 > 1)")
def assets_without_same_path_copies(t: Tables) -> DataFrame:
    return d.delete_same_path(assets(t), "thumbhash", "originalPath", "id").select("id", "originalPath")


@query(
    f"""
    WITH {_ASSETS},
    act AS (SELECT *, count(*) OVER (PARTITION BY thumbhash) AS n FROM a WHERE status = 'active'),
    r AS (SELECT *, row_number() OVER (PARTITION BY thumbhash ORDER BY originalPath, id) AS rn FROM act WHERE n > 1),
    v AS (SELECT id FROM r WHERE rn > 1 AND originalPath LIKE '/photos/src1%')
    SELECT id, CASE WHEN id IN (SELECT id FROM v) THEN 'trashed' ELSE status END AS status,
           CASE WHEN id IN (SELECT id FROM v) THEN '2024-02-01' ELSE '' END AS deletedAt
    FROM a
    """
)
def trashed_duplicates(t: Tables) -> DataFrame:
    out = d.trash_duplicates(assets(t), "/photos/src1", F.lit("2024-02-01"))
    return out.select("id", "status", F.coalesce("deletedAt", F.lit("")).alias("deletedAt"))


@query(
    f"""
    WITH {_FILES}
    SELECT hash, count(*) AS file_count, count(*) - 1 AS redundant, min(path) AS first_path,
           arg_min(size, path) AS size, arg_min(size, path) * (count(*) - 1) AS wasted_bytes
    FROM f GROUP BY hash HAVING count(*) > 1
    """
)
def duplicate_groups(t: Tables) -> DataFrame:
    return d.duplicate_groups(files(t))


@query(
    f"""
    WITH {_FILES},
    g AS (SELECT hash, count(*) - 1 AS redundant, arg_min(size, path) * (count(*) - 1) AS wasted
          FROM f GROUP BY hash HAVING count(*) > 1)
    SELECT count(*) AS groups, CAST(sum(redundant) AS BIGINT) AS redundant, CAST(sum(wasted) AS BIGINT) AS wasted_bytes FROM g
    """
)
def duplicate_totals(t: Tables) -> DataFrame:
    return d.duplicate_totals(d.duplicate_groups(files(t)))


_PLAN = f"""
    WITH {_FILES},
    k AS (SELECT *, count(*) OVER (PARTITION BY hash) AS n,
                 row_number() OVER (PARTITION BY hash ORDER BY {{order}}) AS rn,
                 first_value(path) OVER (PARTITION BY hash ORDER BY {{order}}) AS kept,
                 first_value(size) OVER (PARTITION BY hash ORDER BY path) AS freed_bytes FROM f)
    SELECT hash, path AS remove, kept, freed_bytes FROM k WHERE n > 1 AND rn > 1
"""


@query(_PLAN.format(order="path"))
def removal_plan_keep_first(t: Tables) -> DataFrame:
    return d.dedup_plan(files(t), "first")


@query(_PLAN.format(order="path DESC"))
def removal_plan_keep_last(t: Tables) -> DataFrame:
    return d.dedup_plan(files(t), "last")


@query(_PLAN.format(order="size DESC, path"))
def removal_plan_keep_largest(t: Tables) -> DataFrame:
    return d.dedup_plan(files(t), "largest")


@query(
    f"""
    WITH {_FILES},
    k AS (SELECT *, count(*) OVER (PARTITION BY hash) AS file_count,
                 row_number() OVER (PARTITION BY hash ORDER BY path) AS rn FROM f)
    SELECT hash, max(file_count) AS file_count, (SELECT arg_min(size, path) FROM f WHERE f.hash = k.hash) AS size,
           (rn - 1) // 1000 AS part, string_agg(path, '|' ORDER BY rn) AS file_paths
    FROM k WHERE file_count > 1 GROUP BY hash, part
    """
)
def duplicate_group_report(t: Tables) -> DataFrame:
    return d.export_groups(files(t))


@query(
    """
    SELECT source, lang, md5(text) AS digest, min(doc_id) AS doc_id FROM documents GROUP BY ALL
    """
)
def first_copies(t: Tables) -> DataFrame:
    rows = t.documents.select("source", "lang", F.md5("text").alias("digest"), "doc_id")
    return d.first_per_key(rows, ["source", "lang", "digest"], ["doc_id"])
