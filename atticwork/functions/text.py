"""Text columns: search predicates, cleaning, sentence and title rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_ci(col: Column | str, needle: str) -> Column:
    """Substring test that folds case for every alphabet."""
    return F.contains(F.lower(col), F.lower(F.lit(needle)))


def contains_all(col: Column | str, words: list[str]) -> Column:
    """All words occur, in any order; no words means no condition."""
    return reduce(lambda a, b: a & b, [contains_ci(col, w) for w in words], F.lit(True))


def match_count(col: Column | str, terms: list[str]) -> Column:
    """How many of the terms occur."""
    return reduce(lambda a, b: a + b, [contains_ci(col, t).cast("int") for t in terms], F.lit(0))


def folded(pattern: str) -> str:
    """A pattern that ignores case in every alphabet."""
    return f"(?iu){pattern}"


# Link and attribute forms removed from headings, cells and paragraphs.
MARKDOWN_CLEANUP = [
    (r"\[([^\]]+)\]\([^)]*\)", "$1"),
    (r"\(#[^)]+\)", ""),
    (r"\{[^}]+\}", ""),
]


def markdown_clean(col: Column | str) -> Column:
    """Links become their text; anchors and attribute blocks go."""
    out = F.col(col) if isinstance(col, str) else col
    for pattern, replacement in MARKDOWN_CLEANUP:
        out = F.regexp_replace(out, pattern, replacement)
    return strip(out)


# The characters of the Unicode white-space class.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(col: Column | str) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(col, F.lit(WHITE_SPACE))


# An IPv4 address, its prefix length, and lines that are only table rules.
_ADDRESS = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
_PREFIX = r"/\d{1,2}\b"
_RULE_LINES = r"(?mdU)^[\s|+\-=:]+$"
# Pieces of a text: in group 1 an address, a word or other white space; outside it a run of punctuation, blanks and line
# ends. An address with a prefix length wins over one that starts before it and ends inside it.
_PIECE = (
    rf"(?U)({_ADDRESS}{_PREFIX}|(?!(?:\d{{1,3}}\.){{1,3}}{_ADDRESS}{_PREFIX}){_ADDRESS}\b|\w++|[\s&&[^ \r\n\t]]++)|[ \r\n\t[^\w\s]]++"
)


def embedding_text(col: Column | str) -> Column:
    """Text as it is given to an embedding function: the words of a text, or of the cells of a JSON array, with one
    blank for what stands between them. Table rules go; IPv4 addresses are kept with their optional prefix length."""
    raw = F.col(col) if isinstance(col, str) else col
    cells = F.from_json(strip(raw), "array<string>")
    unpacked = F.array_join(F.filter(cells, lambda c: c.isNotNull() & (c != "")), " ")
    text = F.when(strip(raw).startswith("[") & cells.isNotNull(), unpacked).otherwise(raw)
    pieces = F.regexp_extract_all(F.regexp_replace(text, _RULE_LINES, " "), F.lit(_PIECE), F.lit(1))
    return strip(F.array_join(F.transform(pieces, lambda piece: F.when(piece == "", " ").otherwise(piece)), ""))


# What makes a short or digit-heavy chunk worth keeping.
MIN_CHUNK_CHARS = 20
MIN_ALPHANUMERICS = 3
MIN_LETTER_RATIO = 0.15
VALUABLE = "|".join(
    [
        r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}",
        r"(?:порт|port)\s*:?\s*\d{2,5}",
        r"(?:vlan|влан)\s*:?\s*\d+",
        r"\b0x[0-9a-f]{4,}\b",
        r"\b[а-яa-z]{2,}-\d+(?:\.\d+)*\b",
    ]
)


def is_embeddable(col: Column | str) -> Column:
    """Long enough, not only symbols, and either letters or a recognisable technical value."""
    text = strip(col)
    # Runs of other characters are removed at once, which is cheaper than counting letters one by one;
    # the patterns are only tried where the letters do not decide.
    letters = F.length(F.regexp_replace(text, r"\P{L}+", ""))
    return (
        (F.length(text) >= MIN_CHUNK_CHARS)
        & text.rlike(rf"(?s)(?:[\p{{L}}\p{{N}}].*?){{{MIN_ALPHANUMERICS}}}")
        & ((letters >= MIN_LETTER_RATIO * F.length(text)) | text.rlike(f"(?iuU)(?:{VALUABLE})"))
    )


def sentences(col: Column | str) -> Column:
    """Split after ``.``, ``!`` or ``?`` where white space follows."""
    parts = F.split(strip(col), r"(?U)(?<=[.!?])\s+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def words(col: Column | str) -> Column:
    return F.filter(F.split(F.lower(strip(col)), r"(?U)\s+"), lambda w: w != "")


def word_jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct words; zero when a side has none."""
    wa, wb = F.array_distinct(words(a)), F.array_distinct(words(b))
    return jaccard(wa, wb)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        both / (F.size(a) + F.size(b) - both)
    )


def file_title(col: Column | str) -> Column:
    """A title as a file-name part: its words in lower case, without other signs, joined by underscores.

    White space, dashes and underscores part words. The title is not cut, so different ones stay different."""
    bare = F.transform(F.split(F.lower(col), r"(?U)[\s_-]+"), lambda word: F.regexp_replace(word, r"(?U)\W", ""))
    return F.array_join(F.filter(bare, lambda word: word != ""), "_")


def numbered_file_title(title: Column | str, idx: Column | str) -> Column:
    name = file_title(title)
    return F.concat_ws("_", F.format_string("%04d", idx), F.when(name != "", name))


def trailing_number(col: Column | str) -> Column:
    """The number after the last dash at the end of a title, or null."""
    digits = F.regexp_extract(col, r"-\s*(\d+)\s*$", 1)
    return F.when(digits != "", digits).try_cast("int")


# The date in a file name, and its first plausible year below.
FILE_DATE = r"_(\d{4})([-._])(\d{2})\2(\d{2})"


def file_month(col: Column | str, this_year: Column) -> Column:
    """``yyyy-MM`` from ``_yyyy?MM?dd`` in a file name, the same separator twice; null when there is
    no such date or the year or month is not plausible."""
    year = F.regexp_extract(col, FILE_DATE, 1)
    month = F.regexp_extract(col, FILE_DATE, 3)
    plausible = year.try_cast("int").between(1981, this_year) & month.try_cast("int").between(1, 12)
    return F.when((year != "") & plausible, F.concat_ws("-", year, month))


def clock(seconds: Column | str) -> Column:
    """``[HH:MM:SS]``; whole days are written as ``[1 day, H:MM:SS]`` and ``[2 days, H:MM:SS]``."""
    whole = F.floor(seconds).cast("long")
    days, rest = F.floor(whole / 86400).cast("long"), whole % 86400
    h, m, s = F.floor(rest / 3600).cast("long"), F.floor(rest % 3600 / 60).cast("long"), rest % 60
    return F.when(days == 0, F.format_string("[%02d:%02d:%02d]", h, m, s)).otherwise(
        F.format_string("[%d %s, %d:%02d:%02d]", days, F.when(days == 1, "day").otherwise("days"), h, m, s)
    )


def abbreviation_pattern(abbreviation: str) -> str | None:
    """Pattern for the words an abbreviation may stand for, or null when it has other characters than
    Latin or Cyrillic letters and digits.

    A letter matches a word that starts with it, a run of digits matches itself, white space separates.
    """
    import re

    pieces = re.findall(r"\d+|[A-Za-z]|[А-Яа-яЁё]|.", abbreviation, flags=re.S)
    words_: list[str] = []
    for piece in pieces:
        if piece[0].isdigit():
            words_.append(piece)
        elif re.fullmatch("[A-Za-z]", piece):
            words_.append(f"{piece.upper()}[a-z]*")
        elif re.fullmatch("[А-Яа-яЁё]", piece):
            words_.append(f"{piece.upper()}[а-яё]*")
        else:
            return None
    return r"\s+".join(words_) if words_ else None


def digits_only(col: Column | str) -> Column:
    return F.regexp_replace(col, r"\D", "")


def phone_display(col: Column | str) -> Column:
    """Digits as ``+C (AAA) BBB-DD-EE``. Ten digits get country code 7; from 11 digits on the code is
    the first one, two or three digits; anything else is shown as it is."""
    phone = F.col(col) if isinstance(col, str) else col
    size = F.length(phone)
    code = F.when(size == 10, 0).when(size <= 12, 1).when(size == 13, 2).otherwise(3)

    def part(start: int, length: int) -> Column:
        return F.substring(phone, code + 1 + start, F.lit(length))

    shown = F.concat(
        F.lit("+"),
        F.when(size == 10, F.lit("7")).otherwise(F.left(phone, code)),
        F.lit(" ("), part(0, 3), F.lit(") "), part(3, 3), F.lit("-"), part(6, 2), F.lit("-"), part(8, 2),
    )
    return F.when(phone.rlike(r"^\d{10,}$"), shown).otherwise(phone)
