"""String clean-up: repeated characters and transliteration to ASCII."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexforge.functions import scripts

ColumnOrName = Column | str

#: Longest run of one character that reduce_lengthening leaves.
LONGEST_RUN = 3

#: Letters without a canonical decomposition, and punctuation, in ASCII.
SPECIAL = {
    "ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th", "ĳ": "ij", "Ĳ": "IJ",
    "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ł": "l", "Ł": "L", "ı": "i", "ħ": "h", "Ħ": "H",
    "ŋ": "ng", "Ŋ": "NG", "ĸ": "k", "ŧ": "t", "Ŧ": "T", "ŉ": "'n", "ſ": "s",
    "‘": "'", "’": "'", "‚": ",", "‛": "'", "“": '"', "”": '"', "„": ",,", "‟": '"', "«": "<<", "»": ">>",
    "–": "-", "—": "--", "…": "...", "\xa0": " ", "€": "EUR", "¡": "!", "¢": "C/", "£": "PS", "¤": "$?", "¥": "Y=", "¦": "|",
    "§": "SS", "¨": '"', "©": "(c)", "ª": "a", "¬": "!", "®": "(r)", "¯": "-", "°": "deg", "±": "+-", "²": "2", "³": "3",
    "´": "'", "µ": "u", "¶": "P", "·": "*", "¸": ",", "¹": "1", "º": "o", "¼": "1/4", "½": "1/2", "¾": "3/4", "¿": "?",
    "×": "x", "÷": "/",
}


def column(col: ColumnOrName) -> Column:
    return F.col(col) if isinstance(col, str) else col


def squeeze(col: ColumnOrName) -> Column:
    """Each run of one character becomes that character once."""
    return F.regexp_replace(column(col), r"(?s)(.)\1+", "$1")


def reduce_lengthening(col: ColumnOrName) -> Column:
    """Runs of more than three of one character become three; numeric characters stay."""
    return F.regexp_replace(column(col), rf"([^\p{{N}}])\1{{{LONGEST_RUN},}}", "$1" * LONGEST_RUN)


@lru_cache(1)
def _one_to_one() -> tuple[str, str]:
    """Letters of the Latin blocks that decompose to one ASCII letter and marks."""
    pairs = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = [c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)]
        if len(base) == 1 and base[0].isascii() and chr(code) not in SPECIAL:
            pairs[chr(code)] = base[0]
    pairs |= {k: v for k, v in SPECIAL.items() if len(v) == 1}
    return "".join(pairs), "".join(pairs.values())


@lru_cache(1)
def _table() -> dict[str, str]:
    ones, puts = _one_to_one()
    return scripts.letters() | dict(zip(ones, puts, strict=True)) | SPECIAL


def unidecode(col: ColumnOrName) -> Column:
    """Letters of the scripts that ``scripts`` names, Latin ones and common signs in ASCII; any other character beyond ASCII goes.

    Most Latin words only need one-to-one replacements; what is left of others is read by a table.
    """
    col = column(col)
    latin = bind(F.translate(col, *_one_to_one()), lambda c: F.when(c.rlike(r"[^\x00-\x7F]"), _by_table(c)).otherwise(c))
    return F.when(col.rlike(r"[^\x00-\x7F]"), latin).otherwise(col)


def _by_table(col: Column) -> Column:
    read = scripts.by_code_point(F.translate(col, scripts.SMALL_SIGN, ""), _table())
    return bind(read, lambda c: F.when(F.contains(c, F.lit(scripts.SMALL_SIGN)), scripts.kana_joined(c)).otherwise(c))


def bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)
