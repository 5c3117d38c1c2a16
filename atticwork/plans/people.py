"""Persons, faces, assets and memberships over ``customer`` (persons) and ``orders`` (faces, by day)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import paging, people
from .catalog import Tables, query


def persons(t: Tables) -> DataFrame:
    name = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_name"))
    return t.customer.select(F.col("c_custkey").alias("id"), name.alias("name"))


def faces(t: Tables) -> DataFrame:
    """Orders as faces: the order day is the photo, pending orders are not assigned, low priority has no score."""
    return t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("asset_id"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("person_id"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")).alias("score"),
    )


def assets(t: Tables) -> DataFrame:
    days = t.orders.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("id")).distinct()
    return days.select("id", F.concat(F.lit("IMG_"), "id", F.lit(".jpg")).alias("originalFileName"))


_P = "p AS (SELECT c_custkey AS id, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_name END AS name FROM customer)"
_F = """f AS (SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS asset_id,
    CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS person_id,
    CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END AS score FROM orders)"""


@query(
    f"""WITH {_P}, {_F} SELECT (SELECT count(*) FROM p WHERE name IS NOT NULL AND name <> '') AS named_persons,
    (SELECT count(*) FROM p) AS total_persons, (SELECT count(*) FROM f) AS total_faces,
    (SELECT count(DISTINCT asset_id) FROM f) AS assets_with_faces,
    (SELECT count(*) FROM f WHERE person_id IS NULL) AS unassigned_faces"""
)
def person_stats(t: Tables) -> DataFrame:
    return people.person_stats(persons(t), faces(t))


@query(f"WITH {_P}, {_F} SELECT p.id, coalesce(p.name, '') AS name, count(f.id) AS face_count FROM p LEFT JOIN f ON f.person_id = p.id GROUP BY ALL")
def person_counts(t: Tables) -> DataFrame:
    return people.list_persons(persons(t), faces(t)).select("id", F.coalesce("name", F.lit("")).alias("name"), "face_count")


@query(
    f"""WITH {_P}, {_F} SELECT p.id, p.name, count(f.id) AS face_count FROM p LEFT JOIN f ON f.person_id = p.id
    WHERE p.name ILIKE '%7%' AND p.name <> '' GROUP BY ALL ORDER BY 3 DESC, 2, 1 LIMIT 50 OFFSET 50"""
)
def person_page(t: Tables) -> DataFrame:
    return paging.page(people.list_persons(persons(t), faces(t), q="7", named_only=True), 2, 50)


@query(
    f"""WITH {_F} SELECT asset_id, 'IMG_' || asset_id || '.jpg' AS "originalFileName", count(id) AS face_count,
    count(id) FILTER (WHERE person_id IS NOT NULL) AS named_count FROM f GROUP BY asset_id"""
)
def assets_with_faces(t: Tables) -> DataFrame:
    return people.assets_with_faces(faces(t), assets(t))


@query(f"WITH {_P}, {_F} SELECT f.id, f.asset_id, coalesce(p.name, '') AS person_name FROM f LEFT JOIN p ON p.id = f.person_id")
def asset_faces(t: Tables) -> DataFrame:
    return people.asset_faces(faces(t), persons(t)).select("id", "asset_id", F.coalesce("person_name", F.lit("")).alias("person_name"))


@query(
    f"""WITH {_F} SELECT person_id, id, row_number() OVER (PARTITION BY person_id ORDER BY score DESC NULLS LAST, id) AS rank
    FROM f WHERE person_id IS NOT NULL QUALIFY rank <= 5"""
)
def best_scored_faces(t: Tables) -> DataFrame:
    best = people.faces_by_score(faces(t).filter("person_id is not null"), ["person_id"], 5)
    return best.select("person_id", "id", "rank")


@query(
    f"""WITH {_F} SELECT asset_id, id, row_number() OVER (PARTITION BY asset_id ORDER BY score DESC NULLS LAST, id) AS rank
    FROM f QUALIFY rank <= 300"""
)
def faces_of_assets(t: Tables) -> DataFrame:
    return people.faces_by_score(faces(t), ["asset_id"], 300).select("asset_id", "id", "rank")


@query(f"WITH {_F} SELECT id, asset_id FROM f WHERE person_id IS NULL ORDER BY score DESC NULLS LAST, id LIMIT 50 OFFSET 100")
def unassigned_page(t: Tables) -> DataFrame:
    return paging.page(people.unassigned_faces(faces(t)), 3, 50).select("id", "asset_id")


@query(f"WITH {_P} SELECT id, coalesce(CASE WHEN id = 7 THEN 'New name' ELSE name END, '') AS name FROM p")
def renamed_person(t: Tables) -> DataFrame:
    return people.rename_person(persons(t), 7, " New name ").select("id", F.coalesce("name", F.lit("")).alias("name"))


@query(f"WITH {_F} SELECT id, coalesce(CASE WHEN person_id = 10 THEN 20 ELSE person_id END, -1) AS person_id FROM f")
def merged_faces(t: Tables) -> DataFrame:
    return people.merge_persons(faces(t), 10, 20).select("id", F.coalesce("person_id", F.lit(-1)).alias("person_id"))


@query(
    f"""WITH {_P}, {_F} SELECT 10 AS source_person_id, 20 AS target_person_id,
    coalesce((SELECT name FROM p WHERE id = 10), '') AS source_person_name, coalesce((SELECT name FROM p WHERE id = 20), '') AS target_person_name,
    (SELECT count(*) FROM f WHERE person_id = 10) AS face_count_moved, '2024-02-01T10:00:00Z' AS merged_at"""
)
def merge_audit(t: Tables) -> DataFrame:
    record = people.merge_record(persons(t), faces(t), 10, 20, F.lit("2024-02-01 10:00:00").cast("timestamp_ntz"))
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return people.merge_log(record).select(
        "source_person_id", "target_person_id", blank("source_person_name"), blank("target_person_name"), "face_count_moved", "merged_at"
    )


@query(
    """SELECT o_orderkey AS source_person_id, o_custkey AS target_person_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS merged_at
    FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100"""
)
def merge_log(t: Tables) -> DataFrame:
    log = t.orders.select(
        F.col("o_orderkey").alias("source_person_id"), F.col("o_custkey").alias("target_person_id"), F.col("o_orderdate").alias("merged_at")
    )
    return people.merge_log(log)


@query("SELECT o_orderkey AS id FROM orders WHERE o_custkey = 12 ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def most_recent_assets(t: Tables) -> DataFrame:
    own = t.orders.filter("o_custkey = 12").select(F.col("o_orderkey").alias("id"), "o_orderdate")
    return paging.most_recent(own, "o_orderdate", 10, "id").select("id")


# --- memberships ---


def target(t: Tables) -> DataFrame:
    return t.orders.filter("o_orderstatus = 'O'").select(F.col("o_orderpriority").alias("label"), F.col("o_custkey").alias("asset_id"))


def current(t: Tables) -> DataFrame:
    own = t.orders.filter("o_orderstatus = 'F' and o_orderpriority <> '1-URGENT'")
    return own.select(F.col("o_orderpriority").alias("label"), F.col("o_custkey").alias("asset_id"))


_SYNC = """
    t AS (SELECT DISTINCT o_orderpriority AS label, o_custkey AS asset_id FROM orders WHERE o_orderstatus = 'O'),
    c AS (SELECT DISTINCT o_orderpriority AS label, o_custkey AS asset_id FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT'),
    plan AS (
        SELECT coalesce(t.label, c.label) AS label, coalesce(t.asset_id, c.asset_id) AS asset_id,
               CASE WHEN c.label IS NULL THEN 'add' ELSE 'remove' END AS action,
               CASE WHEN coalesce(t.label, c.label) IN (SELECT label FROM c) THEN 0 ELSE 1 END AS create_label
        FROM t FULL JOIN c ON t.label = c.label AND t.asset_id = c.asset_id WHERE t.label IS NULL OR c.label IS NULL)
"""


@query(f"WITH {_SYNC} SELECT * FROM plan")
def sync_plan(t: Tables) -> DataFrame:
    return people.sync_plan(target(t), current(t)).withColumn("create_label", F.col("create_label").cast("int"))


@query(f"WITH {_SYNC} SELECT label, asset_id FROM plan WHERE action = 'add'")
def sync_add_only(t: Tables) -> DataFrame:
    return people.sync_plan(target(t), current(t), "add").select("label", "asset_id")


@query(
    f"""WITH {_SYNC} SELECT label, count(*) FILTER (WHERE action = 'add') AS added, count(*) FILTER (WHERE action = 'remove') AS removed,
    max(create_label) AS created FROM plan GROUP BY label"""
)
def sync_summary(t: Tables) -> DataFrame:
    out = people.sync_summary(people.sync_plan(target(t), current(t)))
    return out.withColumn("created", F.col("created").cast("int"))


@query(
    f"""WITH {_SYNC} SELECT count(DISTINCT label) AS persons, count(*) FILTER (WHERE action = 'add') AS added,
    count(*) FILTER (WHERE action = 'remove') AS removed FROM plan"""
)
def sync_totals(t: Tables) -> DataFrame:
    return people.sync_totals(people.sync_summary(people.sync_plan(target(t), current(t))))


@query(f"WITH {_SYNC} FROM t EXCEPT FROM c")
def set_difference(t: Tables) -> DataFrame:
    return people.set_diff(target(t), current(t))


def refs(t: Tables) -> DataFrame:
    by_id = F.col("s_acctbal") > 3000
    return t.supplier.select(
        F.when(by_id, "id").otherwise("name").alias("kind"),
        F.when(by_id, F.col("s_suppkey").cast("string")).otherwise(F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string"))).alias("value"),
    )


def known_people(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_nationkey").alias("id"), F.when(F.col("n_regionkey") != 4, F.col("n_name")).alias("name"))


_REFS = """
    r AS (SELECT CASE WHEN s_acctbal > 3000 THEN 'id' ELSE 'name' END AS kind,
                 CASE WHEN s_acctbal > 3000 THEN CAST(s_suppkey AS VARCHAR) ELSE 'NATION_' || CAST(s_nationkey AS VARCHAR) END AS value FROM supplier),
    k AS (SELECT CAST(n_nationkey AS VARCHAR) AS id, CASE WHEN n_regionkey <> 4 THEN n_name ELSE '' END AS name FROM nation)
"""


@query(
    f"""WITH {_REFS} SELECT k.name AS label, k.id AS person_id FROM r JOIN k ON r.kind = 'id' AND r.value = k.id
    UNION SELECT k.name, k.id FROM r JOIN k ON r.kind = 'name' AND r.value = k.name AND k.name <> ''"""
)
def resolved_groups(t: Tables) -> DataFrame:
    return people.resolve_groups(refs(t), known_people(t))


@query(
    f"""WITH {_REFS} SELECT kind, value FROM r WHERE NOT (kind = 'id' AND value IN (SELECT id FROM k))
    AND NOT (kind = 'name' AND value IN (SELECT name FROM k WHERE name <> ''))"""
)
def unresolved_refs(t: Tables) -> DataFrame:
    return people.unresolved_refs(refs(t), known_people(t))


def pictures(t: Tables) -> DataFrame:
    path = F.concat(F.lit("/media/"), F.initcap("event_type"), F.lit("/"), F.col("event_id").cast("string"), F.lit(".jpg"))
    return t.events.select(
        F.col("event_id").alias("id"), F.col("ts").alias("file_created_at"), path.alias("original_path"),
        (F.col("event_type") == "error").alias("is_offline"),
        F.array(F.struct(F.col("user_id").alias("id"), F.col("event_type").alias("name"))).alias("people"),
    )


@query("SELECT event_id AS asset_id, user_id AS person_id FROM events WHERE event_type IN ('click', 'view', 'error')")
def scoped_appearances(t: Tables) -> DataFrame:
    own = pictures(t)
    feeds = people.scan_assets(own.filter("not is_offline"), own.filter("is_offline"))
    seen = people.appearances(people.in_scope(feeds, ["CLICK", "view", "error"]))
    return seen.select("asset_id", "person_id")
