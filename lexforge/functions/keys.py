"""Keys for matching records: word fingerprints and omission keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexforge.functions.normalize import ColumnOrName, bind, column, unidecode

#: Consonants from the rarest in misspellings on.
OMISSION_ORDER = "JKQXZVWYBFMGPDHCLNTSR"


def fingerprint_tokens(col: ColumnOrName) -> Column:
    """Words in lower case without anything but ASCII letters and digits: distinct, in order."""
    words = F.transform(F.split(column(col), r"(?U)\s+"), lambda w: F.lower(F.regexp_replace(w, "[^A-Za-z0-9]", "")))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: w != "")))


def fingerprint(col: ColumnOrName) -> Column:
    return F.array_join(fingerprint_tokens(col), " ")


def omission_key(col: ColumnOrName) -> Column:
    """The consonants of a word in a fixed order and then its vowels as they first appear."""

    def key(u: Column) -> Column:
        consonants = [F.when(F.contains(u, F.lit(c)), c).otherwise("") for c in OMISSION_ORDER]
        vowels = F.array_join(F.array_distinct(F.regexp_extract_all(u, F.lit("[AEIOU]"), F.lit(0))), "")
        return F.concat(*consonants, vowels)

    return bind(F.upper(unidecode(col)), key)
