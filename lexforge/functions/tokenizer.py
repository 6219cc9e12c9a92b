"""Configured tokenizers: options chosen when a plan is made, applied as one filter."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexforge.functions.lexer import KINDS, VOWELS_BOTH, checked_kind, simple_tokens, word_tokens
from lexforge.functions.normalize import ColumnOrName, column

#: Longest word in bytes, and runs of vowels or consonants that no word has.
JUNK_BYTES, JUNK_PAIRS, JUNK_VOWELS, JUNK_CONSONANTS = 30, 3, 7, 8


def starts_with_vowel(col: ColumnOrName) -> Column:
    return column(col).rlike(f"^[{VOWELS_BOTH}]")


def is_junk(col: ColumnOrName) -> Column:
    """Whether a word is no plausible word.

    It is if it has more than 30 bytes, at least three characters equal to the one before, seven
    vowels or eight consonants in a row, or neither a vowel nor any character but letters.
    """
    w = column(col)
    runs = w.rlike(rf"[{VOWELS_BOTH}]{{{JUNK_VOWELS}}}|[\p{{IsAlphabetic}}&&[^{VOWELS_BOTH}]]{{{JUNK_CONSONANTS}}}")
    # most words are too short for the dearer conditions
    return (
        (F.octet_length(w) > JUNK_BYTES)
        | ~w.rlike(rf"[{VOWELS_BOTH}]|[^\p{{IsAlphabetic}}]")
        | ((F.length(w) >= min(JUNK_VOWELS, JUNK_CONSONANTS)) & runs)
        | ((F.length(w) > JUNK_PAIRS) & (F.regexp_count(w, F.lit(r"(?s)(.)(?=\1)")) >= JUNK_PAIRS))
    )


def is_junk_token(token: ColumnOrName) -> Column:
    """Only tokens of kind ``word`` can be junk."""
    token = column(token)
    return (token["kind"] == "word") & is_junk(token["text"])


@dataclass(frozen=True)
class WordTokenizer:
    """Which tokens to keep. Each method returns a new tokenizer."""

    stoplist: frozenset[str] = frozenset()
    excluded: frozenset[str] = frozenset()
    min_chars: int | None = None
    max_chars: int | None = None
    no_junk: bool = False

    def insert_stopword(self, word: str) -> WordTokenizer:
        return self.stopwords([word])

    def stopwords(self, words: Iterable[str]) -> WordTokenizer:
        """Words to drop besides those so far: whole tokens of any kind, in any case."""
        return replace(self, stoplist=self.stoplist | {w.lower() for w in words if w})

    def kind_blacklist(self, kinds: Iterable[str]) -> WordTokenizer:
        return replace(self, excluded=frozenset(map(checked_kind, kinds)))

    def kind_whitelist(self, kinds: Iterable[str]) -> WordTokenizer:
        return replace(self, excluded=frozenset(KINDS) - frozenset(map(checked_kind, kinds)))

    def min_token_chars(self, n: int) -> WordTokenizer:
        return replace(self, min_chars=n)

    def max_token_chars(self, n: int) -> WordTokenizer:
        return replace(self, max_chars=n)

    def filter_junk(self) -> WordTokenizer:
        return replace(self, no_junk=True)

    def accepts(self, token: Column) -> Column:
        """The conditions, cheap ones first."""
        kept = F.lit(True)
        if self.excluded:
            kept = kept & ~token["kind"].isin(sorted(self.excluded))
        if self.min_chars is not None:
            kept = kept & (F.char_length(token["text"]) >= self.min_chars)
        if self.max_chars is not None:
            kept = kept & (F.char_length(token["text"]) <= self.max_chars)
        if self.stoplist:
            kept = kept & ~F.lower(token["text"]).isin(sorted(self.stoplist))
        if self.no_junk:
            kept = kept & ~is_junk_token(token)
        return kept

    def tokenize(self, col: ColumnOrName) -> Column:
        return self._kept(word_tokens(col))

    def simple_tokenize(self, col: ColumnOrName) -> Column:
        return self._kept(simple_tokens(col))

    def _kept(self, tokens: Column) -> Column:
        return tokens if self == WordTokenizer() else F.filter(tokens, self.accepts)
