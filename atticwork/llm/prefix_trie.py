"""Conversation prefix trie: double-array tries over ranges of conversations, their shared upper nodes merged.

Turns become 128-bit keys, conversations become paths of keys. Equal paths are one row with counts. The distinct paths
are dealt by range of their order, so a shard holds neighbouring prefixes whatever their frequency, and only the nodes
above a border between two shards are shared. Each shard packs its paths into BASE and CHECK arrays and traverses them;
shared nodes come out as partial aggregates, which are added up in a second step.

Paths longer than a band are cut into bands of equal depth, worked off from the deepest one: a band's paths hang below
the node where they start, and that node's totals are handed to the band above.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import ranked
from .common import written

#: Every conversation starts with up to HEADS - 1 turns of the conversation whose id is the multiple of FAMILY below.
FAMILY, HEADS = 100, 6
#: Turns of one band at least, and bands at most: a longer conversation gets longer bands.
BAND, BANDS = 4096, 64
#: Turns of a shard.
SHARD_TURNS = 1 << 20
#: Ids that are hashed as one piece.
PIECE = 512
KEY = 16
#: Where a node with several children looks for room: slots from the first free one on, and free ones that are tried.
STRETCH, TRIES = 4096, 32
EMPTY = hashlib.sha256(b"").hexdigest()


# --------------------------------------------------------------------------------------------------
# Conversations as paths


def own_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, key, size): turns numbered from 1, key for (role, text), size in code points."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # The length of the role keeps ("ab", "c") and ("a", "bc") apart.
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), key.alias("key"), F.length(text).alias("size")
    )
    return ranked(turns, ["conv_id"], ["turn", "key"], "place").select("conv_id", "place", "key", "size")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, key, size) of the rebuilt conversations, and (conv_id, turns) with their number of turns."""
    heads = (
        turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("place") < HEADS))
        .groupBy(F.col("conv_id").alias("base"))
        .agg(F.array_sort(F.collect_list(F.struct("place", "key", "size"))).alias("head"))
    )
    borrowed = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    convs = (
        turns.groupBy("conv_id").agg(F.count("*").alias("own"))
        .withColumns({"h": borrowed, "base": F.col("conv_id") - F.col("conv_id") % FAMILY})
        .join(heads, "base", "left")
        .withColumn("head", F.coalesce(F.slice("head", F.lit(1), F.col("h").cast("int")), F.array().cast("array<struct<place:bigint,key:binary,size:int>>")))
        .select("conv_id", "h", "head", (F.size("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).cast("long").alias("turns"))
    )
    convs = written(convs, "conversations")
    first = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", F.col("t.place").alias("depth"), "t.key", "t.size")
    shift = convs.select("conv_id", "h", F.size("head").alias("taken"))
    rest = (
        turns.join(shift, "conv_id").where("place > h")
        .select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "key", "size")
    )
    return first.unionByName(rest), convs.select("conv_id", "turns")


def band_paths(turns: DataFrame, convs: DataFrame, band: int) -> DataFrame:
    """One row per conversation and band: path (keys one after the other), sizes, digest of the path, chain (digests of
    all bands before, empty in the first band), ends (the conversation's last band)."""
    path = (
        turns.groupBy("conv_id", F.floor((F.col("depth") - 1) / band).cast("int").alias("band"))
        .agg(F.array_sort(F.collect_list(F.struct("depth", F.hex("key").alias("key"), "size"))).alias("t"))
        .select("conv_id", "band", F.unhex(F.array_join("t.key", "")).alias("path"), F.col("t.size").alias("sizes"))
    )
    silent = convs.where("turns = 0").select("conv_id", F.lit(0).alias("band"), F.lit(b"").alias("path"), F.array().cast("array<int>").alias("sizes"))
    last = convs.select("conv_id", F.floor(F.greatest(F.col("turns") - 1, F.lit(0)) / band).cast("int").alias("last"))
    rows = written(path.unionByName(silent).withColumn("digest", F.md5("path")).join(last, "conv_id"), "conversation-bands")
    # At most BANDS digests of a conversation.
    digests = F.array_sort(F.collect_list(F.struct("band", "digest")))
    before = F.array_join(F.slice("all.digest", F.lit(1), F.col("band")), "")
    longer = rows.where("last > 0").groupBy("conv_id").agg(digests.alias("all"))
    chains = longer.select("conv_id", F.posexplode("all").alias("band", "_"), "all").select("conv_id", "band", before.alias("chain"))
    return (
        rows.join(chains, ["conv_id", "band"], "left")
        .withColumn("chain", F.coalesce("chain", F.lit("")))
        .withColumns({"start": _start("chain"), "ends": F.col("band") == F.col("last")})
    )


def _start(chain: str) -> Column:
    """Name of the node where a band's paths start."""
    return F.when(F.col(chain) == "", "").otherwise(F.md5(F.col(chain).cast("binary")))


def _hash_lists(members: DataFrame, group: list[str]) -> DataFrame:
    """SHA-256 of each group's ids, ascending and comma-joined.

    A hash over an ordered list takes its bytes one after the other. So the ids are sorted by range, which spreads a
    large group over many tasks, become pieces of text there, and only the pieces pass one task's running hash.
    """
    names = [*group, "conv_id"]
    text = pa.schema([*[(g, pa.string()) for g in group], ("first_id", pa.int64()), ("ids", pa.string())])

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(*[batch.column(i).to_pylist() for i in range(len(group))], strict=True))
            ids = batch.column(len(group)).to_pylist()
            cuts = [i for i in range(len(ids)) if i == 0 or keys[i] != keys[i - 1]] + [len(ids)]
            out = [
                (*keys[at], ids[at], ",".join(map(str, ids[at : min(at + PIECE, to)])))
                for a, to in zip(cuts, cuts[1:], strict=False)
                for at in range(a, to, PIECE)
            ]
            yield _rows(out, text)

    done = pa.schema([*[(g, pa.string()) for g in group], ("sha", pa.string())])

    def running(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            keys = list(zip(*[batch.column(i).to_pylist() for i in range(len(group))], strict=True))
            for key, ids in zip(keys, batch.column(len(group) + 1).to_pylist(), strict=True):
                if key != now:
                    if state:
                        out.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _rows(out, done)
        if state:
            yield _rows([(*now, state.hexdigest())], done)

    kind = ", ".join(f"{g} string" for g in group)
    packed = members.select(*names).repartitionByRange(*names).sortWithinPartitions(*names).mapInArrow(pieces, f"{kind}, first_id long, ids string")
    packed = packed.repartition(*group).sortWithinPartitions(*group, "first_id")
    return packed.mapInArrow(running, f"{kind}, sha string")


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def distinct_paths(rows: DataFrame) -> DataFrame:
    """Equal paths from the same start as one row: n, the smallest conv_id, and the hash of those that end here."""
    group = ["band", "start", "digest"]
    paths = written(
        rows.groupBy(*group).agg(
            *[F.any_value(c).alias(c) for c in ("path", "sizes", "chain")], F.count("*").alias("n"), F.min("conv_id").alias("conv_id"),
            F.count_if("ends").alias("n_end"), F.min(F.when(F.col("ends"), F.col("conv_id"))).alias("end_id"),
        ),
        "paths",
    )
    many = paths.where("n_end > 1").select(F.col("band").cast("string").alias("band"), "start", "digest")
    members = rows.where("ends").select(F.col("band").cast("string").alias("band"), "start", "digest", "conv_id")
    hashes = _hash_lists(members.join(many, group, "left_semi"), group).withColumn("band", F.col("band").cast("int"))
    alone = F.when(F.col("n_end") == 1, F.sha2(F.col("end_id").cast("string").cast("binary"), 256))
    return written(paths.join(hashes, group, "left").withColumn("sha", F.coalesce("sha", alone)).drop("n_end", "end_id"), "hashed-paths")


# --------------------------------------------------------------------------------------------------
# One shard


@dataclass
class DoubleArray:
    """A trie over sequences of dense ids (from 1): the child of node s by id c is BASE[s] + c if CHECK there is s.

    Slot 0 is free for good; node 1 is the root. ``ends[i]`` is the node at which sequence i ends.
    """

    base: np.ndarray
    check: np.ndarray
    used: np.ndarray
    ends: np.ndarray

    def child(self, nodes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Next nodes, 0 where there is none."""
        to = self.base[nodes] + ids
        there = (to > 0) & (to < len(self.check))
        to = np.where(there, to, 0)
        return np.where(self.check[to] == nodes, to, 0)


def pack(ids: np.ndarray, offsets: np.ndarray) -> DoubleArray:
    """Double array of the sequences ids[offsets[i]:offsets[i + 1]], level by level.

    All children of a level are placed at once: the only child of a node goes to the next free slot; of several, the
    first goes to the first free slot from which all others fall on free slots too, looked for in a bounded stretch,
    and else behind all that is used.
    """
    lengths = np.diff(offsets)
    size = 16 + 2 * len(ids)
    base, check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
    check[0], check[1] = -2, 0
    state = np.ones(len(lengths), np.int64)
    low, top, depth = 2, 2, 0

    def grow(least: int) -> None:
        nonlocal base, check
        if least > len(base):
            more = max(least, 2 * len(base)) - len(base)
            base, check = np.concatenate([base, np.zeros(more, np.int64)]), np.concatenate([check, np.full(more, -1, np.int64)])

    while True:
        alive = np.flatnonzero(lengths > depth)
        if not len(alive):
            break
        at, token = state[alive], ids[offsets[alive] + depth]
        order = np.lexsort((token, at))
        parents, tokens = at[order], token[order]
        first = np.ones(len(order), bool)
        first[1:] = (parents[1:] != parents[:-1]) | (tokens[1:] != tokens[:-1])
        parents, tokens = parents[first], tokens[first]
        starts = np.flatnonzero(np.r_[True, parents[1:] != parents[:-1]])
        counts = np.diff(np.r_[starts, len(parents)])
        for s, k in zip(starts[counts > 1], counts[counts > 1], strict=True):
            kids = tokens[s : s + k]
            apart = kids - kids[0]
            place = top
            grow(top + int(apart[-1]) + 1)
            for slot in (np.flatnonzero(check[low : min(low + STRETCH, top)] == -1)[:TRIES] + low).tolist():
                if (check[slot + apart] == -1).all():
                    place = slot
                    break
            check[place + apart] = parents[s]
            base[parents[s]] = place - kids[0]
            top = max(top, place + int(apart[-1]) + 1)
            while low < len(check) and check[low] != -1:
                low += 1
        single = starts[counts == 1]
        if len(single):
            grow(top + len(single) + 1)
            free = np.flatnonzero(check[low : top + len(single)] == -1)[: len(single)] + low
            check[free] = parents[single]
            base[parents[single]] = free - tokens[single]
            top = max(top, int(free[-1]) + 1)
            while low < len(check) and check[low] != -1:
                low += 1
        state[alive] = base[at] + token
        depth += 1
    return DoubleArray(base[:top], check[:top], np.flatnonzero(check[:top] >= 0), state)


_PART = pa.schema([
    ("kind", pa.string()), ("node", pa.string()), ("parent", pa.string()), ("start", pa.string()), ("depth", pa.int64()), ("conv_id", pa.int64()),
    ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("size", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
    ("saved", pa.int64()), ("sha", pa.string()),
])
_PART_SQL = (
    "kind string, node string, parent string, start string, depth long, conv_id long, parent_conv_id long, n_convs long, size long, "
    "n_children long, n_leaves long, saved long, sha string"
)


def _names(start: str, path: bytes, depth: int) -> list[str]:
    """Names of the nodes of a path at depths 0 to depth below its start."""
    running = hashlib.md5(start.encode())
    out = [running.hexdigest()]
    for d in range(depth):
        running.update(path[KEY * d : KEY * (d + 1)])
        out.append(running.hexdigest())
    return out


def _trie_nodes(start: str, rows: dict[str, list], band_start: int, low: int, high: int) -> Iterator[tuple]:
    """Rows of _PART for the paths from one start; the first path is shared with the shard before down to depth low,
    the last one with the shard after down to depth high (-1: not at all)."""
    order = sorted(range(len(rows["path"])), key=lambda i: rows["path"][i])
    paths = [rows["path"][i] for i in order]
    column = lambda name: [rows[name][i] for i in order]
    lengths = np.array([len(p) // KEY for p in paths])
    offsets = np.r_[0, np.cumsum(lengths)]
    keys = np.frombuffer(b"".join(paths), dtype=f"V{KEY}")
    # Dense ids in order of first sight, level by level: turns that follow the same turns get neighbouring ids.
    by_level = np.argsort(np.arange(len(keys)) - np.repeat(offsets[:-1], lengths), kind="stable")
    _, seen, code = np.unique(keys[by_level], return_index=True, return_inverse=True)
    rank, ids = np.empty(len(seen), np.int64), np.empty(len(keys), np.int64)
    rank[np.argsort(seen)] = np.arange(1, len(seen) + 1)
    ids[by_level] = rank[code]
    sizes = np.array([s for own in column("sizes") for s in own], dtype=np.int64)
    trie = pack(ids, offsets)

    slots = len(trie.check)
    n, least = np.zeros(slots, np.int64), np.full(slots, np.iinfo(np.int64).max)
    depth, size = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    count, conv = np.array(column("n"), np.int64), np.array(column("conv_id"), np.int64)
    state = np.ones(len(paths), np.int64)
    np.add.at(n, state, count)
    np.minimum.at(least, state, conv if rows["start_id"][0] is None else np.array(column("start_id"), np.int64))
    for d in range(int(lengths.max()) if len(lengths) else 0):
        alive = np.flatnonzero(lengths > d)
        state[alive] = trie.child(state[alive], ids[offsets[alive] + d])
        at = state[alive]
        np.add.at(n, at, count[alive])
        np.minimum.at(least, at, conv[alive])
        depth[at], size[at] = d + 1, sizes[offsets[alive] + d]

    shared = np.zeros(slots, bool)
    name: dict[int, str] = {}
    for path, row, to in ((paths[0], 0, low), (paths[-1], len(paths) - 1, high)):
        node = np.array([1])
        for d, label in enumerate(_names(start, path, to) if to >= 0 else []):
            if d:
                node = trie.child(node, ids[offsets[row] + d - 1 : offsets[row] + d])
            shared[node[0]] = True
            name[int(node[0])] = label

    children, leaves, saved = (np.zeros(slots, np.int64) for _ in range(3))
    sha: dict[int, str] = {}
    for i, end in enumerate(trie.ends.tolist()):
        if rows["sha"][order[i]] is not None:
            sha[end] = rows["sha"][order[i]]
        if rows["below_children"][order[i]] is not None:
            children[end] += rows["below_children"][order[i]]
            leaves[end] += rows["below_leaves"][order[i]]
            saved[end] += rows["below_saved"][order[i]]
    nodes = trie.used
    inner = nodes[(nodes != 1) & ~shared[nodes]]
    np.add.at(children, trie.check[inner], 1)
    for d in range(int(depth.max()) if len(nodes) else 0, -1, -1):
        at = nodes[(depth[nodes] == d) & ~shared[nodes]]
        leaves[at] += children[at] == 0
        saved[at] += (n[at] - 1) * size[at]
        up = at[at != 1]
        np.add.at(leaves, trie.check[up], leaves[up])
        np.add.at(saved, trie.check[up], saved[up])
    for node in nodes.tolist():
        parent = int(trie.check[node]) if node != 1 else None
        above = None if parent is None or shared[parent] else int(least[parent])
        if node == 1 and band_start:
            kind = "start-part" if shared[node] else "start"
        else:
            kind = "part" if shared[node] else "node"
        yield (
            kind, name.get(node), name.get(parent) if parent is not None else None, start, int(depth[node]) + band_start, int(least[node]),
            above, int(n[node]), int(size[node]), int(children[node]), int(leaves[node]), int(saved[node]), sha.get(node),
        )


def _shard(band_start: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        groups: dict[str, list[int]] = {}
        for i, start in enumerate(rows["start"]):
            groups.setdefault(start, []).append(i)
        names = sorted(groups)
        out: list[tuple] = []
        for start in names:
            own = {c: [v[i] for i in groups[start]] for c, v in rows.items()}
            low = rows["low"][0] if start == names[0] else -1
            high = rows["high"][0] if start == names[-1] else -1
            out.extend(_trie_nodes(start, own, band_start, low, high))
        return pa.Table.from_batches([_rows(out, _PART)])

    return run


def _borders(shards: DataFrame) -> DataFrame:
    """(shard, low, high): how many turns its first path shares with the shard before and its last with the one after."""
    ends = shards.groupBy("shard").agg(F.min(F.struct("start", "path")).alias("first"), F.max(F.struct("start", "path")).alias("last"))
    schema = pa.schema([("shard", pa.int32()), ("low", pa.int32()), ("high", pa.int32())])

    def common(a: tuple, b: tuple) -> int:
        if a[0] != b[0]:
            return -1
        x, y = (np.frombuffer(p, dtype=f"V{KEY}") for p in (a[1], b[1]))
        k = min(len(x), len(y))
        differ = np.flatnonzero(x[:k] != y[:k])
        return int(differ[0]) if len(differ) else k

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            out = []
            for shard, first_start, first_path, last_start, last_path in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                low = common(last[1], (first_start, first_path)) if last else -1
                if last:
                    out.append((last[0], last[2], low))
                last = (shard, (last_start, last_path), low)
            yield _rows(out, schema)
        if last:
            yield _rows([(last[0], last[2], -1)], schema)

    # Two paths per shard, one after the other through one task.
    line = ends.select("shard", "first.*", F.col("last.start").alias("last_start"), F.col("last.path").alias("last_path"))
    return line.repartition(1).sortWithinPartitions("shard").mapInArrow(run, "shard int, low int, high int")


def _merged(start: tuple, table: pa.Table) -> pa.Table:
    """Totals of the shared nodes of one start, from the deepest up; they know their children by name."""
    rows = table.to_pydict()
    place = {name: i for i, name in enumerate(rows["node"])}
    for i in sorted(range(len(rows["node"])), key=lambda i: -rows["depth"][i]):
        rows["n_leaves"][i] += rows["n_children"][i] == 0
        rows["saved"][i] += (rows["n_convs"][i] - 1) * rows["size"][i] if rows["kind"][i] == "part" else 0
        up = place.get(rows["parent"][i])
        if up is not None:
            rows["n_children"][up] += 1
            rows["n_leaves"][up] += rows["n_leaves"][i]
            rows["saved"][up] += rows["saved"][i]
            rows["parent_conv_id"][i] = rows["conv_id"][up]
    rows["kind"] = ["node" if k == "part" else "start" for k in rows["kind"]]
    return pa.Table.from_pydict({f.name: pa.array(rows[f.name], f.type) for f in _PART}, schema=_PART)


def _band_nodes(paths: DataFrame, below: DataFrame | None, band: int, band_turns: int, shard_turns: int) -> DataFrame:
    """Final nodes of one band, and its starts (which are nodes of the band above) with their totals."""
    own = paths.where(F.col("band") == band)
    if below is None:
        none = F.lit(None).cast("long")
        own = own.withColumns({"below_children": none, "below_leaves": none, "below_saved": none})
    else:
        own = own.withColumn("_chain", F.concat("chain", "digest")).withColumn("next", _start("_chain")).join(below, "next", "left")
    turns = own.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    parts = max(4, -(-int(turns) // shard_turns))
    order = ["start", "path"]
    # A start's smallest id may be that of a conversation that ends there, which the band above knows.
    next_start = paths.withColumn("_chain", F.concat("chain", "digest")).where(F.col("band") == band - 1)
    firsts = next_start.select(_start("_chain").alias("start"), F.col("conv_id").alias("start_id"))
    own = own.join(firsts, "start") if band else own.withColumn("start_id", F.lit(None).cast("long"))
    shards = own.select("start", "path", "sizes", "n", "conv_id", "sha", "start_id", "below_children", "below_leaves", "below_saved")
    shards = written(shards.repartitionByRange(parts, *order).withColumn("shard", F.spark_partition_id()), "trie-shards")
    borders = written(_borders(shards), "trie-borders")
    found = shards.join(F.broadcast(borders), "shard").groupBy("shard").applyInArrow(_shard(band * band_turns), _PART_SQL)
    found = written(found, "trie-nodes")
    partial = found.where("kind IN ('part', 'start-part')").groupBy("node").agg(
        *[F.any_value(c).alias(c) for c in ("kind", "start", "depth", "size")], F.max("parent").alias("parent"),
        F.min("conv_id").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")],
        F.max("sha").alias("sha"),
    )
    upper = written(partial.select(*_PART.names).groupBy("start").applyInArrow(_merged, _PART_SQL), "trie-upper")
    named = upper.select(F.col("node").alias("parent"), F.col("conv_id").alias("_above"))
    single = found.where("kind IN ('node', 'start')")
    # Children of shared nodes get their parent's id from the merged table.
    waiting = single.where("parent IS NOT NULL").join(named, "parent").withColumn("parent_conv_id", F.col("_above")).select(*_PART.names)
    return single.where("parent IS NULL").unionByName(waiting).unionByName(upper)


def nodes(conversations: DataFrame, band_turns: int = BAND, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations.

    Turns are ordered by ``turn``, null first; turns of equal number by the MD5 of role and text, so repeated rows are
    turns of their own. Null role or text is empty. Rows without conv_id take no part, an empty table has no nodes.
    Other columns are ignored. Turns are compared by the MD5 of (role, text).
    """
    turns = written(own_turns(conversations), "turns")
    all_turns, convs = rebuilt(turns)
    longest = convs.agg(F.max("turns")).first()[0]
    band_turns = max(band_turns, -(-(longest or 0) // BANDS))
    rows = band_paths(all_turns, convs, band_turns)
    paths = distinct_paths(rows)
    below, out = None, None
    for band in range(max(0, -(-(longest or 0) // band_turns) - 1), -1, -1):
        found = _band_nodes(paths, below, band, band_turns, shard_turns)
        if band:
            below = written(found.where("kind = 'start'").select(
                F.col("start").alias("next"), F.col("n_children").alias("below_children"), F.col("n_leaves").alias("below_leaves"), F.col("saved").alias("below_saved")
            ), "trie-below")
        real = found.where("kind = 'node'")
        out = real if out is None else out.unionByName(real)
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("sha", F.lit(EMPTY)).alias("ends_sha256"),
    )


def query(conversations: DataFrame) -> DataFrame:
    return nodes(conversations.select("conv_id", "turn", "role", "text"))


ORACLE = f"""
WITH own AS MATERIALIZED (
    SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS l
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
bits AS (
    SELECT conv_id, list_transform(range(0, 8 * len(CAST(conv_id AS VARCHAR))),
        lambda i: (ascii(substring(CAST(conv_id AS VARCHAR), CAST(i // 8 + 1 AS BIGINT), 1)) >> CAST(i % 8 AS INT)) & 1) AS b
    FROM own
),
heads AS (
    SELECT conv_id, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(b, lambda x: CAST(x AS BIGINT))),
        lambda a, x: xor(a >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295) % {HEADS} AS h FROM bits
),
rebuilt AS MATERIALIZED (
    SELECT c.conv_id, list_concat(coalesce(b.l[1:h], []), c.l[h + 1:]) AS l
    FROM own c JOIN heads USING (conv_id) LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % {FAMILY}
),
prefixes AS MATERIALIZED (
    SELECT conv_id, d, l[1:d] AS p, len(l) AS n, CASE WHEN d > 0 THEN length(l[d].t) ELSE 0 END AS size
    FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM rebuilt)
),
node AS MATERIALIZED (
    SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
           sha256(coalesce(string_agg(CASE WHEN n = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
    FROM prefixes GROUP BY d, p
),
linked AS MATERIALIZED (
    SELECT node.*, parent.conv_id AS parent_conv_id, (SELECT count(*) FROM node k WHERE k.d = node.d + 1 AND k.p[1:node.d] = node.p) AS n_children
    FROM node LEFT JOIN node parent ON parent.d = node.d - 1 AND parent.p = node.p[1:node.d - 1]
),
below AS (
    SELECT a AS d, p[1:a] AS p, CAST(sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * size) AS BIGINT) AS saved_tokens
    FROM (SELECT linked.*, unnest(range(0, d + 1)) AS a FROM linked) GROUP BY ALL
)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM linked JOIN below USING (d, p)
"""
