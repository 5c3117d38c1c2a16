"""Transcripts: cut points, sentence times, overlap copies, pause blocks, speaker turns, names.

Sentences are ``(file, start, end, text[, speaker])`` with a unique row id where order needs one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as t
from .ordered import grouped_parts, ranked

# Fixed values.
MIN_WINDOW_SECONDS = 5
WORDS_PER_MINUTE = 150
SAME_TEXT = 0.8


def window_bounds(df: DataFrame, total: str, length: float, overlap: float) -> DataFrame:
    """Overlapping windows over ``total`` seconds; the list ends before the first window shorter than
    five seconds.

    Window k starts at k × step and only shrinks towards the end, so the stop rule is a bound on k.
    """
    step = length - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than length")
    if length < MIN_WINDOW_SECONDS:
        return df.select("*", F.lit(0).alias("window_no"), F.lit(0.0).alias("start_sec"), F.lit(0.0).alias("end_sec")).limit(0)
    last = F.floor((F.col(total) - MIN_WINDOW_SECONDS) / step).cast("int")
    numbers = F.when(F.col(total) >= MIN_WINDOW_SECONDS, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    start = F.col("window_no") * F.lit(float(step))
    return df.select("*", F.explode(numbers).alias("window_no")).select(
        "*", start.alias("start_sec"), F.least(start + F.lit(float(length)), F.col(total)).alias("end_sec")
    )


def spread_timestamps(sentences: DataFrame, keys: list[str], order: list[str], start: str, duration: str) -> DataFrame:
    """Start and end of each sentence by its share of the characters of its piece.

    ``keys`` name a piece; ``start`` and ``duration`` describe it and are repeated on its rows. The
    sentences of a piece come from one recognised text, that is one row, so a plain window is bounded.
    """
    sized = sentences.withColumn("_len", F.length("text").cast("long"))
    piece = W.partitionBy(*keys)
    upto = piece.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = (
        sized.withColumn("_upto", F.sum("_len").over(upto))
        .withColumn("_total", F.sum("_len").over(piece))
        .filter("_total > 0")
    )

    def at(chars: Column) -> Column:
        return F.col(start) + F.col(duration) * chars / F.col("_total")

    return (
        out.withColumn("start", at(F.col("_upto") - F.col("_len")))
        .withColumn("end", at(F.col("_upto")))
        .drop("_len", "_total", "_upto")
    )


def dedupe_overlap(sentences: DataFrame, overlap: float, file: str = "file", id_: str = "id") -> DataFrame:
    """Drop a sentence when a later one, starting within twice the overlap, says the same (word Jaccard
    above 0.8). The later copy stays.

    A file is cut into stretches of time as long as the look-ahead, and a sentence is shown to its own stretch and to the
    one before. No task gets a whole file, and the input is read once.
    """
    reach = 2.0 * overlap
    stretch = F.floor(F.col("start") / F.lit(max(reach, 1.0)))
    spread = sentences.withColumn("_home", stretch).withColumn("_words", F.array_distinct(t.words("text")))
    spread = spread.withColumn("_run", F.explode(F.array(F.col("_home"), F.col("_home") - 1)))
    # The Python window takes whole numbers only as a range.
    near = F.expr(
        f"collect_list(struct(`start`, `{id_}` AS id, _words AS words)) OVER "
        f"(PARTITION BY `{file}`, _run ORDER BY `start` RANGE BETWEEN CURRENT ROW AND {reach!r}D FOLLOWING)"
    )
    later = lambda n: (n["start"] > F.col("start")) | ((n["start"] == F.col("start")) & (n["id"] > F.col(id_)))
    repeated = F.exists("_near", lambda n: later(n) & (t.jaccard(F.col("_words"), n["words"]) > SAME_TEXT))
    return spread.withColumn("_near", near).filter("_run = _home").filter(~repeated).drop("_home", "_words", "_run", "_near")


def pause_blocks(sentences: DataFrame, min_pause: float, file: str = "file", id_: str = "id") -> DataFrame:
    """Text blocks split where the pause reaches ``min_pause``; one sentence per line, blocks of more
    than 1000 sentences in parts."""
    parts = grouped_parts(
        sentences.select(file, id_, "start", "end", "text"),
        [file],
        ["start", id_],
        "end",
        lambda d: F.when(d["prev_end"].isNotNull() & (d["start"] - d["prev_end"] < min_pause), 0).otherwise(1),
        "block",
        F.struct("start", "end", "text"),
        "items",
        prev="prev_end",
    )
    return parts.select(
        file,
        "block",
        "part",
        F.get("items", F.lit(0))["start"].alias("start_sec"),
        F.array_max(F.transform("items", lambda s: s["end"])).alias("end_sec"),
        F.size("items").alias("sentences"),
        F.array_join(F.transform("items", lambda s: s["text"]), "\n").alias("text"),
    )


def speaking_end(start: Column, text: Column) -> Column:
    """When a block ends if spoken at 150 words a minute."""
    return start + F.size(t.words(text)) / F.lit(WORDS_PER_MINUTE) * 60


def speaker_turns(blocks: DataFrame, min_pause: float, file: str = "file", id_: str = "id") -> DataFrame:
    """Consecutive blocks of one speaker as one turn; a pause of ``min_pause`` after the estimated end
    also starts a new turn, even for the same speaker."""
    ended = blocks.withColumn(
        "_was", F.struct("speaker", speaking_end(F.col("start_sec"), F.col("text")).alias("end"))
    )
    parts = grouped_parts(
        ended.select(file, id_, "start_sec", "speaker", "text", "_was"),
        [file],
        ["start_sec", id_],
        "_was",
        lambda d: F.when(
            d["_prev"].isNotNull()
            & d["_prev.speaker"].eqNullSafe(d["speaker"])
            & (d["start_sec"] - d["_prev.end"] < min_pause),
            0,
        ).otherwise(1),
        "turn",
        F.struct("start_sec", "speaker", "text"),
        "items",
        prev="_prev",
    )
    first = F.get("items", F.lit(0))
    return parts.select(
        file,
        "turn",
        "part",
        first["start_sec"].alias("start_sec"),
        first["speaker"].alias("speaker"),
        F.size("items").alias("blocks"),
        F.array_join(F.transform("items", lambda b: b["text"]), " ").alias("text"),
    )


def timed_lines(blocks: DataFrame) -> DataFrame:
    """Blocks as ``[HH:MM:SS] text`` lines."""
    return blocks.withColumn("line", F.concat_ws(" ", t.clock("start_sec"), "text"))


def speaker_names(speakers: DataFrame, names: list[str], file: str = "file", seed: int = 0) -> DataFrame:
    """A display name for every speaker id of a file.

    Ids in order get the names in an order drawn per file from the seed; when the names run out they are
    used again with ``-2``, ``-3``, … Distinct (file, speaker) pairs are made first.
    """
    if not names:
        raise ValueError("no names")
    ids = ranked(speakers.select(file, "speaker").distinct(), [file], ["speaker"], "_n")
    slot = (F.col("_n") - 1) % len(names)
    drawn = F.transform(
        F.array(*[F.lit(n) for n in names]),
        lambda n: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(file).cast("string"), n)).alias("h"), n.alias("n")),
    )
    name = F.get(F.sort_array(drawn), slot.cast("int"))["n"]
    lap = F.floor((F.col("_n") - 1) / len(names)) + 1
    return ids.select(
        file, "speaker", F.when(lap == 1, name).otherwise(F.concat_ws("-", name, lap.cast("string"))).alias("display_name")
    )
