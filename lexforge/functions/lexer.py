"""The word lexer: one regular expression whose groups tell the kinds of tokens."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexforge.functions.normalize import ColumnOrName, bind, column

#: Kinds of tokens.
KINDS = ("word", "hashtag", "mention", "emoji", "punct", "number", "url", "email")
#: Vowels in lower case.
VOWELS = "aáàâäąåoôóøeéèëêęiíïîıuúùûüyÿæœ"
VOWELS_BOTH = VOWELS + "".join(c.upper() for c in VOWELS if len(c.upper()) == 1)

#: What surrounds a field and a token in the rewritten text: noncharacters, and others for texts that have one of them.
_MARKS = (("\ufdd1", "\ufdd0"), ("\ufdd3", "\ufdd2"))
#: Of these a text with marks of both pairs takes the first two that it does not have: all noncharacters, and private characters.
_SPARE = [chr(c) for c in [*range(0xFDD0, 0xFDF0), *(p << 16 | c for p in range(17) for c in (0xFFFE, 0xFFFF)), *range(0xF0000, 0xF0040)]]


@lru_cache(None)
def _ranges(prop: str) -> str:
    """The characters of a Unicode property as ranges of a character class."""
    import regex

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    runs = regex.findall(rf"\p{{{prop}}}+", every)
    return "".join(rf"\x{{{ord(r[0]):X}}}-\x{{{ord(r[-1]):X}}}" for r in runs)


@lru_cache(1)
def pattern() -> str:
    """Alternatives in order of precedence, in eight kinds of groups, over all of a text."""
    alpha, alnum = r"\p{IsAlphabetic}", r"[\p{IsAlphabetic}\p{Nd}]"
    emoji = f"[{_ranges('Emoji')}]"
    compound = rf"(?>{alnum}++(?:[\-_·]++{alnum}['’\p{{IsAlphabetic}}\p{{Nd}}]*+)++)"
    clitic = r"-(?iu:je|tu|ils?|elles?|[nv]ous|on|les?|la|moi|toi|lui|y)"
    contraction = "(?iu:ll|re|ve|[dms])"
    words = "|".join(
        [
            r"\p{Lu}(?:\.\p{Lu})++\.?",
            rf"(?iu:aujourd['’]hui|{alpha}+n['’]t)",
            r"(?iu:['’](?:twas|tis|ll|re|ve|[dms]))\b",
            rf"(?iu:qu|[cdjlmnst])['’](?=[{VOWELS_BOTH}hH#@]{alpha}*\b)",
            rf"{alpha}(?=['’]{contraction}\b)",
            rf"(?iu:[dlmno])['’]{alpha}+\b",
        ]
    )
    emojis = "|".join(
        [
            r"[\x{1F1E6}-\x{1F1FF}]+",
            rf"{emoji}(?:\x{{200D}}{emoji})++\x{{FE0F}}?",
            rf"[{_ranges('Emoji_Modifier_Base')}](?:\x{{FE0F}}?[\x{{1F3FB}}-\x{{1F3FF}}])?",
            rf"[{_ranges('Emoji_Presentation')}]\x{{FE0F}}?",
        ]
    )
    # common tokens come first where no rule after them could match anything else there: words before a blank or before a sign and a blank
    # (no abbreviation has five letters), and signs before a blank; what stands in front of other groups only says early that they cannot match
    groups = [
        rf"({alpha}++(?=\s|\z|[,;:!?](?:\s|\z))|{alpha}{{5,}}+(?=\.(?:\s|\z)))",
        r"([.,;:!?])(?=\s|\z)",
        rf"(?={alnum}++[\-_·])(?:((?={compound}(?<={clitic}))[^\-]+)-|({compound}(?<!{clitic})))",
        rf"([#$]{alpha}{alnum}+\b)",
        rf"(@{alpha}[\p{{IsAlphabetic}}\p{{Nd}}_]+\b)",
        r"(-?\p{Nd}+(?:[.,]\p{Nd}+)?\b)",
        rf"(?=[#*0-9©®\x{{203C}}-\x{{10FFFF}}])({emojis})",
        rf"(?={alpha}{{1,4}}+\.)((?iu:app?t|etc|[djs]r|prof|mlle|mgr|min|mrs|m[rs]|m|no|pp?|st|vs)\.)",
        r"((?iu:https?)://[^\s,;]+)",
        r"((?iu:[a-z0-9!#$%&*+\-/=?^_`{|}~]{1,64}@[a-z]{2,8}\.[a-z]{2,8}(?:\.[a-z]{2,8})*+))",
        rf"({words})",
        r"([^\p{IsAlphabetic}\p{N}])",
        r"([\p{IsAlphabetic}\p{N}]++)",
    ]
    junk = r"[\x00-\x1f\s]"
    return rf"(?U){junk}*+(?:{'|'.join(groups)})|{junk}+\z"


#: Groups of each kind's field in the pattern, by KINDS.
_FIELDS = ("$1$3$4$9$12$14", "$5", "$6", "$8", "$2$13", "$7", "$10", "$11")


def word_tokens(col: ColumnOrName) -> Column:
    """All tokens of a text as an array of (kind, text), in order; a null text gives null."""
    text, (first, second) = column(col), [tuple(map(F.lit, m)) for m in _MARKS]
    has = lambda marks: F.contains(text, marks[0]) | F.contains(text, marks[1])
    free = F.array_except(F.array(*map(F.lit, _SPARE)), F.split(text, ""))
    others = bind(free, lambda m: _lexed(text, F.element_at(m, 1), F.element_at(m, 2)))
    return F.when(~has(first), _lexed(text, *first)).when(~has(second), _lexed(text, *second)).otherwise(others)


def _lexed(text: Column, field: Column, token_mark: Column) -> Column:
    put = F.concat(token_mark, F.lit(_FIELDS[0]), *(x for f in _FIELDS[1:] for x in (field, F.lit(f))))
    marked = F.regexp_replace(text, F.lit(pattern()), put)
    kinds = F.array(*[F.lit(k) for k in KINDS])
    empty = F.repeat(field, len(KINDS) - 1)

    def token(piece: Column) -> Column:
        body = F.replace(piece, field, F.lit(""))  # as many fields stand before it as its kind's number
        return F.struct(F.element_at(kinds, F.instr(piece, body)).alias("kind"), body.alias("text"))

    pieces = F.filter(F.split(marked, token_mark), lambda p: (p != "") & (p != empty))
    return F.transform(pieces, token)


def simple_tokens(col: ColumnOrName) -> Column:
    """Every maximal run of word characters as a token of kind ``word``."""
    found = F.regexp_extract_all(column(col), F.lit(r"(?U)\b\w+\b"), F.lit(0))
    return F.transform(found, lambda t: F.struct(F.lit("word").alias("kind"), t.alias("text")))


def token_struct(text: ColumnOrName, kind: str = "word") -> Column:
    """One token of a kind."""
    return F.struct(F.lit(checked_kind(kind)).alias("kind"), column(text).alias("text"))


def token_pair(token: ColumnOrName) -> Column:
    """A token as (text, kind)."""
    token = column(token)
    return F.struct(token["text"].alias("text"), token["kind"].alias("kind"))


def parsed_kind(col: ColumnOrName) -> Column:
    """The kind that a string names, as tokens write it; null for any other string."""
    name = column(col)
    return F.when(name.isin(*KINDS), name)


def checked_kind(kind: str) -> str:
    if kind not in KINDS:
        raise ValueError(f"unknown word token kind {kind!r}")
    return kind
