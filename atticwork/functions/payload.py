"""Reading JSON event payloads of unknown nesting with expressions only.

Keys are looked for in the payload text. In valid JSON a quoted word followed by a colon is a key, and
text order is the order of a depth-first walk, so "first value of this key anywhere" is the first
textual match. Callers keep only valid JSON.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Possessive and without alternatives, so that the length of a string does not matter.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_SCALAR = r'[^,\]}\s"]+'

# Words in a string value that tell of recorded media.
MEDIA_MARKERS = ["/media/frigate", "clips", "thumb", "thumb_path", "clip"]


def _key(name: str) -> str:
    return rf'"{re.escape(name)}"\s*:\s*'


def first_string(payload: Column | str, name: str) -> Column:
    """First non-empty string value of a key, at any depth."""
    found = F.regexp_extract(payload, _key(name) + r'"(?!")([^"\\]*+(?:\\.[^"\\]*+)*+)"', 1)
    return F.when(found != "", found)


def first_scalar(payload: Column | str, name: str, skip_null: bool = False) -> Column:
    """First value of a key at any depth, as text: a string without its quotes, a number or a boolean.
    A null value gives null, or is passed over with ``skip_null``."""
    guard = r"(?!null\b)" if skip_null else ""
    value = F.regexp_extract(payload, f"{_key(name)}{guard}({_STRING}|{_SCALAR})", 1)
    bare = F.substring(value, F.lit(2), F.length(value) - 2)
    return F.when(value.startswith('"'), bare).when((value != "") & (value != "null"), value)


def all_strings(payload: Column | str, name: str) -> Column:
    """String values of a key in text order."""
    return F.regexp_extract_all(payload, F.lit(_key(name) + r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"'), 1)


def array_strings(payload: Column | str, name: str) -> Column:
    """String members of the flat arrays under a key, in text order."""
    bodies = F.regexp_extract_all(payload, F.lit(_key(name) + r"\[([^\[\]{}]*)\]"), 1)
    members = F.transform(bodies, lambda b: F.regexp_extract_all(b, F.lit(r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"'), 1))
    return F.flatten(members)


def _plain(word: str) -> str:
    """The word as a pattern that matches only itself."""
    return re.escape(word)


def has_token(payload: Column | str, words: list[str]) -> Column:
    """Any of the words occurs as a complete quoted token. Arrays named ``objects`` and ``label`` values
    are such tokens, so this one test covers all the places a label may be in."""
    text = F.col(payload) if isinstance(payload, str) else payload
    return text.rlike('"(?:' + "|".join(_plain(w) for w in words) + ')"')


def _is_key(token: Column, names: list[str]) -> Column:
    return token.endswith(":") & token.rlike('^"(?:' + "|".join(_plain(n) for n in names) + ')"')


def _lists_in(payload: Column, name: str, keys: list[str]) -> Column:
    """An object under the key ``name``, at any depth, has one of ``keys`` at its own level.

    A walk over the strings and brackets of the text that knows how deep it is and at which depths such objects are
    open, the innermost first."""
    tokens = F.regexp_extract_all(payload, F.lit(rf"{_STRING}\s*+:?+|[{{}}\[\]]"), 0)

    def step(at: Column, token: Column) -> Column:
        opens, closes = token.isin("{", "["), token.isin("}", "]")
        depth, inner = at["depth"], F.get(at["open"], F.lit(0))
        held = F.when((token == "{") & at["named"], F.concat(F.array(depth + 1), at["open"])).when(
            closes & (inner == depth), F.slice(at["open"], 2, F.greatest(F.size(at["open"]) - 1, F.lit(0)))
        ).otherwise(at["open"])
        return F.struct(
            F.when(opens, depth + 1).when(closes, depth - 1).otherwise(depth).alias("depth"),
            held.alias("open"),
            _is_key(token, [name]).alias("named"),
            (at["found"] | (F.coalesce(inner == depth, F.lit(False)) & _is_key(token, keys))).alias("found"),
        )

    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<int>").alias("open"), F.lit(False).alias("named"), F.lit(False).alias("found"))
    return F.aggregate(tokens, start, step, lambda at: at["found"])


def has_video(payload: Column | str) -> Column:
    """A ``has_clip`` flag is true, a string *value* mentions media, or a ``data`` object lists
    detections or objects."""
    text = F.col(payload) if isinstance(payload, str) else payload
    markers = "|".join(_plain(m) for m in MEDIA_MARKERS)
    strings = F.regexp_extract_all(F.replace(text, F.lit("\\/"), F.lit("/")), F.lit(rf"{_STRING}\s*+:?+"), 0)
    mentioned = F.exists(strings, lambda s: ~s.endswith(":") & s.rlike(markers))
    keys = ["detections", "objects"]
    # The walks are only taken where a plain search does not rule them out.
    possible = text.rlike(_key("data") + r"\{") & text.rlike("|".join(_key(k) for k in keys))
    return (
        text.rlike(_key("has_clip") + r"true\b")
        | F.when(text.rlike(markers.replace("/", r"\\?/")), mentioned).otherwise(False)
        | F.when(possible, _lists_in(text, "data", keys)).otherwise(False)
    )
