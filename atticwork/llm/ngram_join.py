"""N-gram Jaccard join: rare-first prefixes with length, positional and suffix filters, each pair verified once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, partitions_for, per_batch, record, shingles, text_batches, word_blocks, written
from .components import components

#: Rounds in which each prefix n-gram offers only one partner; groups of near copies become one component there.
LEADER_ROUNDS = 2
GROUP_SHINGLES = 2_500_000
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sid", pa.int64())])
_POSTED = pa.schema([("part", pa.int32()), ("sids", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary()), ("codes", pa.binary())])
_SHARED = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("sids", pa.binary()), ("sizes", pa.binary()), ("codes", pa.binary()), ("freqs", pa.binary())])
_SETS = pa.schema([("sid", pa.int64()), ("n", pa.int64()), ("skip", pa.int32()), ("prefix", pa.list_(pa.int64())), ("codes", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _set_ids(owner: np.ndarray, code: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Set size and a 64-bit digest of the set, the same in whatever order it is summed."""
    size = np.bincount(owner, minlength=rows)
    sums = np.zeros(rows + 1, dtype=np.uint64)
    starts = np.concatenate([[0], np.cumsum(size)])
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(code))])
        sums = total[starts[1:]] - total[starts[:-1]]
        sid = mix64(sums + size.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
    return size, sid


def shingle_sets(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, sid): set size and digest of the distinct word n-grams of each whole text."""

    def digest(batch: pa.RecordBatch) -> Iterator[dict]:
        ids = batch.column(0)
        for at, to, offsets, hashes in word_blocks(batch, "text"):
            size, sid = _set_ids(*shingles(offsets, hashes, words), to - at)
            yield {"doc_id": ids.slice(at, to - at), "n": size, "sid": sid.view(np.int64)}

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        per_batch(digest, _DIGEST), _ddl(_DIGEST)
    )


def needed(n: Column | int, percent: int):
    """Least overlap with any partner: a link needs 100 * overlap >= percent * union, and the union has n at least."""
    return -(-percent * n // 100)


def _post(docs: DataFrame, words: int, parts: int, text_col: str) -> DataFrame:
    """The n-grams of all texts, packed by hash group: per block of texts and group the set ids, sizes, counts and codes.

    A code is six bytes of the hash; with the group's number it stands for the n-gram. Equal sets of a block are posted once.
    """

    def post(batch: pa.RecordBatch) -> Iterator[dict]:
        for at, to, offsets, hashes in word_blocks(batch, "text"):
            owner, code = shingles(offsets, hashes, words)
            size, sid = _set_ids(owner, code, to - at)
            _, first = np.unique(sid, return_index=True)
            once = np.zeros(to - at, bool)
            once[first] = True
            owner, code = owner[once[owner]], code[once[owner]]
            part = ((code & np.uint64(0xFFFFFFFF)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")  # within a group still by text and code
            owner, code, part = owner[order], code[order], part[order]
            bounds = np.searchsorted(part, np.arange(parts + 1))
            out: dict[str, list] = {name: [] for name in _POSTED.names}
            for p in np.flatnonzero(np.diff(bounds)):
                a, b = bounds[p], bounds[p + 1]
                own, counts = np.unique(owner[a:b], return_counts=True)
                out["part"].append(p)
                out["sids"].append(sid[own].tobytes())
                out["sizes"].append(size[own].astype("<u4").tobytes())
                out["counts"].append(counts.astype("<u4").tobytes())
                out["codes"].append(code[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes())
            yield out

    return docs.select(F.col(text_col).alias("text")).mapInArrow(per_batch(post, _POSTED), _ddl(_POSTED))


def _joined(column: pa.ChunkedArray | pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind)


def _wide(raw: np.ndarray) -> np.ndarray:
    """Six-byte codes as uint64 in the upper 48 bits."""
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, 2:] = raw.reshape(-1, 6)
    return out.view("<u8").ravel()


def _count_shared(buckets: int):
    """For one hash group: the n-grams that two sets or more hold, with their document frequency, packed by set bucket."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        counts = _joined(table.column("counts"), "<u4")
        sid = np.repeat(_joined(table.column("sids"), "<u8"), counts)
        size = np.repeat(_joined(table.column("sizes"), "<u4"), counts)
        code = _wide(_joined(table.column("codes"), "u1"))
        order = np.argsort(code)
        ordered = code[order]
        same = ordered[1:] == ordered[:-1]
        several = np.zeros(len(code), bool)
        several[1:] = same
        several[:-1] |= same
        use = order[several]
        code, sid, size = code[use], sid[use], size[use]
        order = np.lexsort((sid, code))
        code, sid, size = code[order], sid[order], size[order]
        once = np.ones(len(code), bool)
        once[1:] = (code[1:] != code[:-1]) | (sid[1:] != sid[:-1])
        code, sid, size = code[once], sid[once], size[once]
        first = np.ones(len(code), bool)
        first[1:] = code[1:] != code[:-1]
        freq = np.diff(np.append(np.flatnonzero(first), len(code)))
        freq = np.repeat(freq, freq)
        keep = freq > 1
        code, sid, size, freq = code[keep], sid[keep], size[keep], freq[keep]
        bucket = (sid % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        code, sid, size, freq, bucket = code[order], sid[order], size[order], freq[order], bucket[order]
        bounds = np.searchsorted(bucket, np.arange(buckets + 1))
        out: dict[str, list] = {name: [] for name in _SHARED.names}
        for b in np.flatnonzero(np.diff(bounds)):
            a, z = bounds[b], bounds[b + 1]
            out["bucket"].append(b)
            out["part"].append(part)
            out["sids"].append(sid[a:z].tobytes())
            out["sizes"].append(size[a:z].tobytes())
            out["codes"].append(code[a:z].view(np.uint8).reshape(-1, 8)[:, 2:].tobytes())
            out["freqs"].append(np.minimum(freq[a:z], 0xFFFF).astype("<u2").tobytes())
        return pa.Table.from_batches([record(out, _SHARED)])

    return run


def _assemble(percent: int):
    """For one bucket of sets: each set's shared n-grams, rarest first, and the part of its prefix that is shared.

    N-grams of no other set come first in the rare-first order and only take up places (skip). A set whose
    shared n-grams are fewer than any link needs is left out.
    """

    def run(table: pa.Table) -> pa.Table:
        lengths = np.array([len(x) // 8 for x in table.column("sids").to_pylist()], dtype=np.int64)
        part = np.repeat(np.array(table.column("part").to_pylist(), dtype=np.uint64), lengths)
        sid, size = _joined(table.column("sids"), "<u8"), _joined(table.column("sizes"), "<u4")
        key = _wide(_joined(table.column("codes"), "u1")) | (part & np.uint64(0xFFFF))
        freq = _joined(table.column("freqs"), "<u2")
        order = np.lexsort((key, freq, sid))
        sid, size, key = sid[order], size[order], key[order]
        starts = np.flatnonzero(np.concatenate([[True], sid[1:] != sid[:-1]])) if len(sid) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(sid))
        out: dict[str, list] = {name: [] for name in _SETS.names}
        for a, z in zip(starts, ends, strict=True):
            n = int(size[a])
            skip = n - int(z - a)
            prefix = n - needed(n, percent) + 1 - skip
            if prefix > 0:
                out["sid"].append(int(sid[a : a + 1].view(np.int64)[0]))
                out["n"].append(n)
                out["skip"].append(skip)
                out["prefix"].append(key[a : a + prefix].view(np.int64))
                out["codes"].append(np.sort(key[a:z]).tobytes())
        return pa.Table.from_batches([record(out, _SETS)])

    return run


def candidate_sets(docs: DataFrame, words: int, percent: int, total: int, text_col: str = "text") -> DataFrame:
    """(sid, n, skip, prefix, codes) of the sets that can have a link at all."""
    parts = partitions_for(docs.sparkSession, total, GROUP_SHINGLES)
    shared = _post(docs, words, parts, text_col).groupBy("part").applyInArrow(_count_shared(parts), _ddl(_SHARED))
    return shared.groupBy("bucket").applyInArrow(_assemble(percent), _ddl(_SETS))


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs whose sets overlap enough."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def check(batch: pa.RecordBatch) -> Iterator[dict]:
        a, b, na, nb, left, right = (batch.column(i).to_pylist() for i in range(6))
        hits: list[int] = []
        for i in range(len(a)):
            x, y = np.frombuffer(left[i], "<u8"), np.frombuffer(right[i], "<u8")
            least = -(-percent * (na[i] + nb[i]) // (100 + percent))
            # Suffix filter: over equal ranges of codes the overlap is at most the smaller of both counts.
            cuts = np.arange(33, dtype=np.uint64)[:-1] << np.uint64(59)
            cx, cy = (np.diff(np.append(np.searchsorted(v, cuts), len(v))) for v in (x, y))
            if int(np.minimum(cx, cy).sum()) < least:
                continue
            if int(np.isin(x, y, assume_unique=True).sum()) >= least:
                hits.append(i)
        yield {"a": [a[i] for i in hits], "b": [b[i] for i in hits]}

    one = sets.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("codes").alias("left"))
    two = sets.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("codes").alias("right"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "left", "right")
    return both.mapInArrow(per_batch(check, schema), "a long, b long")


def _possible(percent: int) -> Column:
    """Length, positional and shared-count filters for two prefix places a and b of one n-gram.

    No more than the n-grams from the first common place on can overlap, nor those that any other set has. A pair that
    links passes at its first common n-gram, so rows can be judged one by one.
    """
    least = F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / (100 + percent))
    length = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return length & (F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"), F.col("na") - F.col("ka"), F.col("nb") - F.col("kb")) >= least)


def _side(name: str) -> list[Column]:
    return [F.col("sid").alias(name), F.col("n").alias(f"n{name}"), F.col("i").alias(f"i{name}"), F.col("skip").alias(f"k{name}"), F.col("c").alias(f"c{name}")]


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def link_components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, sid, component_id) for every row of docs (id, text).

    Texts are lower-cased in A-Z and split into words ``[^\\x20\\x09-\\x0D]+``. A set has the distinct n-grams of `words`
    words; with fewer words the whole sequence is its only element, without words (or with a null text) it is
    empty and links with nothing. Two documents link when 100 * overlap >= percent * union; component_id is the
    least doc_id that can be reached. N-grams are 64-bit hashes. Rows with one id are separate rows; a null id is
    no component's name unless it stands alone. An empty table gives an empty table.

    Copies with equal sets are one set. Groups of near copies are joined in rounds in which a prefix n-gram offers
    one partner only; what is left after that is compared in full, but only between different components, so no
    bucket emits all of its pairs.
    """
    text_batches(docs.sparkSession)
    rows = written(shingle_sets(docs, words, id_col, text_col), "shingle-sets")
    total = rows.agg(F.sum("n")).first()[0] or 0
    sets = written(candidate_sets(docs, words, percent, total, text_col), "candidate-sets")
    posts = written(
        sets.select("sid", "n", "skip", F.posexplode("prefix").alias("i", "key")).select(
            "key", "sid", "n", "skip", (F.col("i") + F.col("skip")).alias("i")
        ),
        "prefixes",
    )
    links, labels = None, None
    for turn in range(LEADER_ROUNDS + 1):
        if labels is None:
            now = posts.withColumn("c", F.col("sid"))
        else:
            now = written(
                posts.join(labels, posts["sid"] == labels["node"], "left").select(*posts.columns, F.coalesce("component", "sid").alias("c")),
                "labelled",
            )
        pairs = _led(now, turn, percent) if turn < LEADER_ROUNDS else _across(now, percent)
        found = written(_verify(_ordered(pairs), sets, percent), "links")
        links = found if links is None else links.unionByName(found)
        labels = written(components(links), "components")
    reps = rows.groupBy("sid", "n").agg(F.min("doc_id").alias("rep"))
    named = reps.join(labels, reps["sid"] == labels["node"], "left").select("sid", "n", "rep", F.coalesce("component", "sid").alias("c"))
    named = written(named, "classes")
    least = named.where("n > 0").groupBy("c").agg(F.min("rep").alias("component_id"))
    classes = written(named.where("n > 0").join(written(least, "least"), "c").select("sid", "component_id"), "class-names")
    return (
        rows.join(classes, "sid", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), "sid", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    )


def _led(posts: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs of each set with the leader of each of its prefix n-grams, where both are in different components.

    The first leader is the set with the smallest share of n-grams of its own: the middle of a group of near copies. Later
    ones are of a component drawn by a hash.
    """
    draw = F.xxhash64("c", F.lit(turn)) if turn else F.lit(0)
    offer = F.struct(draw.alias("draw"), (F.col("skip") / F.col("n")).alias("own"), "sid", "n", "i", "skip", "c")
    keys = posts.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min(offer).alias("lead"))
    keys = written(keys.where("low <> high").select("key", "lead.*"), "leaders")
    one = posts.select("key", *_side("a")).join(keys.select("key", *_side("b")), "key")
    return one.where((F.col("ca") != F.col("cb")) & _possible(percent)).select("a", "b")


def _across(posts: DataFrame, percent: int) -> DataFrame:
    """All pairs of sets with a common prefix n-gram and different components.

    Per n-gram the sets outside its largest component meet all sets of other components.
    """
    sizes = posts.groupBy("key", "c").agg(F.count("*").alias("held"))
    main = sizes.groupBy("key").agg(F.max(F.struct("held", "c")).alias("m"), F.count("*").alias("k")).where("k > 1")
    main = written(main.select("key", F.col("m.c").alias("main")), "main")
    mixed = written(posts.join(main, "key").withColumn("big", F.col("c") == F.col("main")), "mixed")
    one = mixed.where("NOT big").select("key", *_side("a"))
    two = mixed.select("key", *_side("b"), "big")
    return one.join(two, "key").where((F.col("ca") != F.col("cb")) & (F.col("big") | (F.col("a") < F.col("b"))) & _possible(percent)).select("a", "b")


def query(docs: DataFrame) -> DataFrame:
    return link_components(docs.select("doc_id", "text"), words=4, percent=85).select("doc_id", "n_shingles", "component_id")


def one_per_group(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are the least id of their group; documents without words all stay.

    Rows with one id are judged by id: all rows of an id that is kept somewhere stay. Null ids stay.
    """
    found = link_components(docs.select(id_col, text_col), words, percent, id_col, text_col)
    gone = written(
        found.groupBy("doc_id").agg(F.max((F.col("component_id") == F.col("doc_id")).cast("int")).alias("kept")).where("kept = 0").select(F.col("doc_id").alias("gone_id")),
        "gone",
    )
    return docs.join(gone, docs[id_col] == gone["gone_id"], "left_anti")
