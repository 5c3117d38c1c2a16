"""Best-fit packing of token pieces into sequences, after a dominance reduction on the table of lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import per_batch, single_threaded, text_batches, written

CAPACITY = 1024
END_ID = 2
SALTS = 512

_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("row_key", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())]
)


def load_encoder(vocabulary: str):
    """text -> ids (uint32 array) as the tokenizers library gives them for the byte-level file.

    ``vocabulary`` is the .json file; the same vocabulary as ranks, a .tiktoken file beside it, is used where it is
    there, as it is several times faster for the same ids (a test compares both). Otherwise the .json itself is used.
    """
    import os

    single_threaded()
    ranks = os.path.splitext(vocabulary)[0] + ".tiktoken"
    if os.path.exists(ranks):
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={"<|endoftext|>": len(table)})
        return lambda text: encoding.encode_to_numpy(text, allowed_special="all")
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(vocabulary)
    return lambda text: np.array(model.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def cut_starts(length: int, capacity: int) -> list[int]:
    """Starts of the pieces: whole pieces of the capacity at the end, the first one takes what is left over."""
    return [0] if length <= capacity else [0, *range(length % capacity or capacity, length, capacity)]


def token_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(doc_id, row_key, piece, start, length, ids_crc32, ids): each text's ids and the end id, cut where longer than capacity.

    A null text counts as empty: one piece with the end id alone. ``ids`` are little-endian uint32 (null without
    with_ids). ``row_key`` tells repeated rows of one id apart only through their text.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    text_batches(docs.sparkSession)
    state: dict = {}

    def encode(batch: pa.RecordBatch) -> Iterator[dict]:
        encoder = state.get("f") or state.setdefault("f", load_encoder(vocabulary))
        rows: list[tuple] = []
        held = 0
        for doc, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            ids = np.append(encoder(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
            starts = cut_starts(len(ids), capacity)
            for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                raw = ids[a:b].tobytes()
                rows.append((doc, key, piece, a, b - a, zlib.crc32(raw), raw if with_ids else None))
                held += len(raw)
            if held > 4 << 20 or len(rows) > 20_000:
                yield dict(zip(_PIECES.names, map(list, zip(*rows, strict=True)), strict=True))
                rows, held = [], 0
        if rows:
            yield dict(zip(_PIECES.names, map(list, zip(*rows, strict=True)), strict=True))

    schema = T.StructType.fromDDL("doc_id long, row_key long, piece int, start long, length long, ids_crc32 long, ids binary")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("row_key"), F.col(text_col).alias("text"))
    return source.mapInArrow(per_batch(encode, _PIECES), schema)


# --------------------------------------------------------------------------------------------------
# The plan works on the count per length: at most `capacity` numbers, however many pieces there are.


def dominated(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Takes pieces out of counts that Martello and Toth's dominance criterion fixes: [(lengths of a sequence, how often)].

    From the longest length x down, with free = capacity - x and k the longest other length that still fits:
    * nothing fits: x is alone;
    * k fills the rest exactly: {x, k} dominates, since whatever else could stand with x sums up to k at most and can
      take the place of k elsewhere;
    * no two others fit with x together: {x, k} dominates, as k is at least as long as any single one;
    * no three others fit, and no two sum up to more than k: {x, k} dominates for the same reason.
    The last three hold for the items that are left, so lengths are looked at again after each change.
    """
    fixed: list[tuple[tuple[int, ...], int]] = []
    lengths = sorted(x for x, n in counts.items() if n)

    def take(x: int, n: int) -> None:
        counts[x] -= n
        if not counts[x]:
            lengths.pop(bisect_left(lengths, x))

    def smallest(several: int, without: int) -> int:
        """Sum of the `several` smallest pieces, one piece of length `without` set aside."""
        total, left = 0, several
        for x in lengths:
            here = min(left, counts[x] - (x == without))
            total, left = total + here * x, left - here
            if not left:
                return total
        return capacity + 1

    def best_pair(x: int, free: int) -> int:
        """Largest sum of two others that fits beside x."""
        best, low, high = 0, 0, bisect_left(lengths, free + 1) - 1
        while low <= high and low < len(lengths):
            a, b = lengths[low], lengths[high]
            if a + b > free:
                high -= 1
                continue
            if a != b or counts[a] - (a == x) >= 2:
                best = max(best, a + b)
            low += 1
        return best

    changed = True
    while changed:
        changed = False
        for x in reversed(lengths.copy()):
            while counts.get(x):
                free = capacity - x
                at = bisect_left(lengths, free + 1) - 1
                if at >= 0 and lengths[at] == x and counts[x] < 2:
                    at -= 1
                if at < 0:
                    n = counts[x]
                    take(x, n)
                    fixed.append(((x,), n))
                    changed = True
                    break
                k = lengths[at]
                pairs = counts[x] // 2 if k == x else min(counts[x], counts[k])
                alone = smallest(2, x) > free or (smallest(3, x) > free and best_pair(x, free) <= k)
                if k != free and not alone:
                    break
                n = pairs  # taking pieces away only makes the conditions easier, so they hold for all pairs at once
                if k == x:
                    take(x, 2 * n)
                else:
                    take(x, n)
                    take(k, n)
                fixed.append(((x, k), n))
                changed = True
    return fixed


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on counts: alike sequences are one entry (lengths, how often)."""
    by_free: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    frees: list[int] = []

    def add(pattern: tuple[int, ...], free: int, n: int) -> None:
        if free not in by_free:
            by_free[free] = []
            insort(frees, free)
        by_free[free].append((pattern, n))

    for x in sorted((x for x, n in counts.items() if n), reverse=True):
        left = counts[x]
        while left:
            at = bisect_left(frees, x)
            if at == len(frees):
                fit = capacity // x
                whole, rest = divmod(left, fit)
                if whole:
                    add((x,) * fit, capacity - fit * x, whole)
                if rest:
                    add((x,) * rest, capacity - rest * x, 1)
                break
            free = frees[at]
            pattern, n = by_free[free].pop()
            if not by_free[free]:
                del by_free[free]
                frees.pop(at)
            used = min(n, left)
            add((*pattern, x), free - x, used)
            if n > used:
                add(pattern, free, n - used)
            left -= used
    return [entry for entries in by_free.values() for entry in entries]


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a sequence, how many such sequences)] that use up the counts per length."""
    left = {x: n for x, n in counts.items() if n}
    if left and (min(left) < 1 or max(left) > capacity):
        raise ValueError("lengths must be 1 to capacity")
    return dominated(left, capacity) + best_fit(left, capacity)


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, low, high, first sequence, offset): the pieces with ranks low to high - 1 of a length, in order."""
    used: dict[int, int] = {}
    slots, sequence = [], 0
    for lengths, n in patterns:
        offset = 0
        for x in lengths:
            low = used.get(x, 0)
            slots.append((x, low, low + n, sequence, offset))
            used[x] = low + n
            offset += x
        sequence += n
    return slots


def pack(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "row_key", "piece")) -> DataFrame:
    """Adds sequence_id and offset to rows with a length column of 1 to capacity.

    Only the count per (length, salt) comes to the driver, at most capacity * SALTS numbers; the packing itself works on
    the count per length. Each piece then finds its place from its rank among the pieces of its length. The rank
    comes in two levels, within (length, salt) and from the counts before that salt, so that a length that a third
    of all pieces have is no single task. Rows of equal order columns may swap places. Nulls in order columns are allowed; an
    empty table gives an empty table. Input columns called sequence_id or offset are replaced.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    salt = F.pmod(F.xxhash64(*order), F.lit(SALTS)).cast("int")
    salted = pieces.withColumn("_salt", salt)
    counted = sorted((r[0], r[1], r[2]) for r in salted.groupBy("length", "_salt").count().collect())
    totals: dict[int, int] = {}
    before: list[tuple[int, int, int]] = []
    for length, s, n in counted:
        before.append((length, s, totals.get(length, 0)))
        totals[length] = totals.get(length, 0) + n
    slots = _slots(plan_sequences(totals, capacity))
    by_length: dict[int, list] = {}
    for length, low, high, first, offset in sorted(slots):
        by_length.setdefault(length, []).append((low, high, first, offset))
    lookup = spark.sparkContext.broadcast(
        ({(a, b): n for a, b, n in before}, {x: np.array(v, dtype=np.int64) for x, v in by_length.items()})
    )
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)) - 1)

    def place(batches):
        starts, slots = lookup.value
        for batch in batches:
            n = batch.num_rows
            length, s, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "_salt", "_rank"))
            rank = rank + np.fromiter((starts[a, b] for a, b in zip(length.tolist(), s.tolist(), strict=True)), np.int64, n)
            sequence, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for x in np.unique(length):
                own = np.flatnonzero(length == x)
                runs = slots[int(x)]
                run = runs[np.searchsorted(runs[:, 0], rank[own], side="right") - 1]
                sequence[own], offset[own] = run[:, 2] + rank[own] - run[:, 0], run[:, 3]
            keep = [i for i, name in enumerate(batch.schema.names) if name not in ("_salt", "_rank")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in keep] + [pa.array(sequence), pa.array(offset)],
                names=[batch.schema.names[i] for i in keep] + ["sequence_id", "offset"],
            )

    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, schema)


def query(docs: DataFrame) -> DataFrame:
    pieces = written(token_pieces(docs.select("doc_id", "text"), with_ids=False).drop("ids"), "pieces")
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
