"""Mixing sources to target weights by whole copies and Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

CAP = 3
SEED = 20_240_601
BUCKETS = 4096
WEIGHTS = (1, 2, 3)
#: Inclusion odds rise with the size of a document by this factor for each doubling of its words.
SIZE_GAIN = 1.05


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, weight, target) from (source, size).

    Sources in code-point order, null last, take the weights in turn and share the sum of all sizes. A target
    stops at cap times its source's size; the excess goes to the others by weight until no target is above.
    One row per source is kept; each round of sharing is one aggregate over these rows.
    """
    per = written(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    ordered = per.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    ordered = written(ordered.withColumn("part", F.spark_partition_id()), "mix-ordered")
    # Positions: number within the range, plus the counts of the ranges before (one row per range).
    before = ordered.groupBy("part").agg(F.count("*").alias("n")).select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")
    )
    own = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    placed = ordered.withColumn("place", F.row_number().over(own)).join(F.broadcast(before), "part")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("before") + F.col("place") - 1) % len(weights) + 1).cast("int"))
    per = written(placed.select("source", "source_size", turn.cast("double").alias("weight")), "mix-weights")
    level, held = None, None
    while True:
        full = F.lit(False) if level is None else F.col("weight") * level >= cap * F.col("source_size")
        row = per.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, cap * F.col("source_size"))).alias("fixed"),
            F.sum(F.when(~full, F.col("weight"))).alias("open"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        if not row["open"] or row["n"] == held:
            break
        held, level = row["n"], (float(row["all"]) - float(row["fixed"] or 0)) / row["open"]
    share = F.lit(level if level is not None else 0.0) * F.col("weight")
    return per.select("source", "source_size", "weight", F.least(share, (cap * F.col("source_size")).cast("double")).alias("target"))


def _per_source_level(light: DataFrame, targets: DataFrame, cap: int) -> DataFrame:
    """The targets with the level that makes a source's expected words equal to its target.

    Documents of a source fall into at most 64 size classes, so each source is one short array."""
    classes = (
        light.groupBy("source", "kind")
        .agg(F.sum("size").alias("words"))
        .groupBy("source")
        .agg(F.collect_list(F.struct("kind", "words")).alias("classes"))
        .withColumnRenamed("source", "c_source")
    )

    def words_at(level: Column) -> Column:
        part = lambda c: c["words"] * F.least(F.lit(float(cap)), level * F.pow(F.lit(SIZE_GAIN), c["kind"]))
        return F.aggregate("classes", F.lit(0.0), lambda acc, c: acc + part(c))

    def halve(acc: Column, _: Column) -> Column:
        middle = (acc["low"] + acc["high"]) / 2
        return F.when(
            words_at(middle) < F.col("target"), F.struct(middle.alias("low"), acc["high"].alias("high"))
        ).otherwise(F.struct(acc["low"].alias("low"), middle.alias("high")))

    start = F.struct(F.lit(0.0).alias("low"), F.lit(float(cap)).alias("high"))
    level = F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, halve, lambda acc: acc["high"])
    plan = targets.join(classes, F.col("source").eqNullSafe(F.col("c_source")))
    return plan.select(F.col("source").alias("p_source"), "source_size", "target", level.alias("level"))


def _with_order(light: DataFrame, plan: DataFrame, cap: int) -> DataFrame:
    """Adds certain (whole copies) and, where a part is open, order (0 to 1, monotone in the ratio of odds) and bucket."""
    u = (F.shiftrightunsigned("h", 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    expected = F.least(F.lit(float(cap)), F.col("level") * F.pow(F.lit(SIZE_GAIN), F.col("kind")))
    rows = light.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")
    rows = rows.withColumn("e", F.when(F.col("size") > 0, expected).otherwise(0.0))
    rows = rows.withColumn("certain", F.floor(F.col("e") + 1e-9)).withColumn("p", F.col("e") - F.col("certain"))
    ratio = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    rows = rows.withColumn("order", F.when(F.col("p") > 1e-9, ratio / (1 + ratio)))
    return rows.withColumn("bucket", F.floor(F.col("order") * BUCKETS).cast("int")).drop("e", "p", "level")


def _cuts(rows: DataFrame) -> DataFrame:
    """Per source where its order is cut: rest (words still needed after the whole copies), cut (bucket), last."""
    sums = rows.groupBy("source", "bucket").agg(
        F.sum("size").alias("words"), F.sum(F.col("certain") * F.col("size")).alias("sure"), F.first("target").alias("target")
    )
    by = Window.partitionBy("source")  # at most BUCKETS + 2 rows
    upto = F.sum(F.when(F.col("bucket").isNotNull(), F.col("words")).otherwise(0)).over(
        by.orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    )
    sums = written(
        sums.select("source", "bucket", "words", (F.col("target") - F.sum("sure").over(by)).alias("rest"), upto.alias("upto")),
        "mix-buckets",
    )
    rest = sums.groupBy("source").agg(F.first("rest").alias("rest"))
    cut = written(
        sums.where("bucket IS NOT NULL AND upto - words < rest AND upto >= rest").select(
            F.col("source").alias("c_source"), F.col("bucket").alias("cut"), (F.col("rest") - F.col("upto") + F.col("words")).alias("need")
        ),
        "mix-cut",
    )
    inside = rows.where("bucket IS NOT NULL").join(cut, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("bucket") == F.col("cut")))
    run = Window.partitionBy("source").orderBy("order", "h").rowsBetween(Window.unboundedPreceding, 0)
    edge = (
        inside.withColumn("used", F.sum("size").over(run))
        .where(F.col("used") <= F.col("need"))
        .groupBy("source")
        .agg(F.max(F.struct("order", "h")).alias("last"), F.max("used").alias("used"))
        .withColumnRenamed("source", "e_source")
    )
    limits = (
        rest.join(cut, F.col("source").eqNullSafe(F.col("c_source")), "left")
        .join(edge, F.col("source").eqNullSafe(F.col("e_source")), "left")
        .select(F.col("source").alias("s_source"), "rest", "cut", "last", (F.col("need") - F.coalesce("used", F.lit(0))).alias("short"))
    )
    limits = written(limits, "mix-limits")
    # One more document, the one whose size is nearest to the words that are still missing.
    place = F.struct("order", "h")
    beyond = (F.col("bucket") > F.col("cut")) | ((F.col("bucket") == F.col("cut")) & F.coalesce(place > F.col("last"), F.lit(True)))
    spare = rows.where("bucket IS NOT NULL").join(limits, F.col("source").eqNullSafe(F.col("s_source"))).where(beyond)
    off = F.abs(F.col("size") - F.col("short"))
    best = spare.where(off < F.col("short")).groupBy("source").agg(F.min(F.struct(off.alias("off"), "order", "h")).alias("b"))
    best = best.select(F.col("source").alias("b_source"), F.struct("b.order", "b.h").alias("extra"))
    return limits.join(best, F.col("s_source").eqNullSafe(F.col("b_source")), "left").select("s_source", "rest", "cut", "last", "extra")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source") -> DataFrame:
    """All columns of docs plus size, source_size, target and copies (0 to cap), so that the copies of a source
    together come as near to its target as whole documents allow.

    A document's expected copies are e = min(cap, level * gain^floor(log2 size)); the level of a source makes the
    expected words equal to the target. The whole part of e is certain. The rest p gives inclusion odds, and the
    documents are ranked by (u / (1 - u)) / (p / (1 - p)) with u from a seeded hash of id and text: Pareto order
    sampling. The first documents in this order are taken while the source's words stay within the target, and one more,
    the one whose size comes nearest to what is missing. The order is cut in two steps (buckets of odds, then rows of the one bucket
    that the target falls into), so a source with a third of all rows is no single task.

    Sizes are words; null and empty texts have size 0 and take no copies. A null source is a source of its own.
    Rows with equal id and text share one place in the order and are taken alike. An empty table gives an empty
    table. Other columns pass through; input columns called size, source_size, target or copies are replaced.
    """
    names = [n for n in docs.columns if n not in ("size", "source_size", "target", "copies")]
    size = word_count(docs[text_col])
    core = {
        "source": docs[source_col],
        "size": size,
        "kind": F.when(size > 0, F.floor(F.log2(size))).otherwise(0).cast("int"),
        "h": F.xxhash64(F.lit(seed), docs[id_col], docs[text_col]),
    }
    light = written(docs.select(*[c.alias(n) for n, c in core.items()]), "mix-sizes")
    plan = written(_per_source_level(light, source_targets(light, weights, cap), cap), "mix-plan")
    cuts = _cuts(written(_with_order(light, plan, cap), "mix-order"))
    plan = written(plan.join(cuts, F.col("p_source").eqNullSafe(F.col("s_source"))).drop("s_source"), "mix-final")
    full = docs.select(F.struct(*[docs[n] for n in names]).alias("row"), *[c.alias(n) for n, c in core.items()])
    full = _with_order(full, plan, cap)
    taken = (
        F.when(F.col("bucket").isNull() | (F.col("rest") <= 0), 0)
        .when(F.col("cut").isNull() | (F.col("bucket") < F.col("cut")), 1)
        .when((F.col("bucket") == F.col("cut")) & F.coalesce(F.struct("order", "h") <= F.col("last"), F.lit(False)), 1)
        .when(F.coalesce(F.struct("order", "h") == F.col("extra"), F.lit(False)), 1)
        .otherwise(0)
    )
    return full.select(
        *[F.col("row").getField(n).alias(n) for n in names], "size", "source_size", "target", (F.col("certain") + taken).cast("int").alias("copies")
    )


def query(docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "text", "source")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken")
    )
