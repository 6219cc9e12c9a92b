"""SQL for the registered queries, for DuckDB. Its logic and small tables are written apart from the Spark expressions; rules of stemmers and of the name code are shared."""

from __future__ import annotations

import re

from lexforge.functions import phonetics
from lexforge.functions.stemmers import FIRST, SECOND, STEP2, STEP3, STEP4, THIRD


#: The vowels of all rules, in both cases.
VOWELS_BOTH = "aáàâäąåoôóøeéèëêęiíïîıuúùûüyÿæœAÁÀÂÄĄÅOÔÓØEÉÈËÊĘIÍÏÎUÚÙÛÜYŸÆŒ"


def _text(x: str | None) -> str:
    if x is None:
        return "NULL"
    parts, plain = [], ""
    for c in x:
        if c < " ":
            parts += [f"'{plain}'", f"chr({ord(c)})"]
            plain = ""
        else:
            plain += "''" if c == "'" else c
    parts = [p for p in [*parts, f"'{plain}'"] if p != "''"] or ["''"]
    return " || ".join(parts)


WORDS = r"SELECT DISTINCT unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS word FROM documents"

#: The lexer on plain texts: no elisions, contractions or emoji; alternatives by precedence.
LEXER = "|".join(
    [
        r"[\p{L}\p{Nd}]+(?:[-_·]+[\p{L}\p{Nd}][''’\p{L}\p{Nd}]*)+",
        r"[#$]\p{L}[\p{L}\p{Nd}]+",
        r"@\p{L}[\p{L}\p{Nd}_]+",
        r"\p{Nd}+[\p{L}\p{N}]*\p{L}[\p{L}\p{N}]*",
        r"-?\p{Nd}+(?:[.,]\p{Nd}+)?",
        r"(?i:app?t|etc|[djs]r|prof|mlle|mgr|min|mrs|m[rs]|m|no|pp?|st|vs)\.",
        r"\p{Lu}(?:\.\p{Lu})+\.?",
        r"[\p{L}\p{N}]+",
        r"[^\p{L}\p{N}\s]",
    ]
)
TOKENS = rf"""
    SELECT doc_id, pos - 1 AS pos, text,
        CASE WHEN regexp_matches(text, '^[#$]\p{{L}}') THEN 'hashtag' WHEN regexp_matches(text, '^@\p{{L}}') THEN 'mention'
             WHEN regexp_full_match(text, '-?\p{{Nd}}+([.,]\p{{Nd}}+)?') THEN 'number'
             WHEN regexp_full_match(text, '[^\p{{L}}\p{{N}}]') THEN 'punct' ELSE 'word' END AS kind
    FROM (SELECT doc_id, unnest(t) AS text, generate_subscripts(t, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '{LEXER}') AS t FROM documents))
"""


def _simple() -> str:
    return r"SELECT doc_id, generate_subscripts(t, 1) - 1 AS pos, 'word' AS kind, unnest(t) AS text FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS t FROM documents)"


def _grams(lists: str) -> str:
    return f"""SELECT p_partkey, generate_subscripts(g, 1) - 1 AS pos, array_to_string(unnest(g), ' ') AS gram
        FROM (SELECT p_partkey, {lists} AS g FROM (SELECT p_partkey, string_split(p_name, ' ') AS t FROM part))"""


def _windows(n: str, size: str = "len(t)") -> str:
    return f"list_transform(range(1, greatest({size} - {n} + 2, 2)), lambda i: t[i : i + {n} - 1])"


_RANGE = f"""CASE WHEN len(t) < 3 THEN flatten(list_transform(range(1, len(t) + 1), lambda n: {_windows('n')}))
    ELSE list_concat(flatten(list_transform(range(1, 4), lambda n: {_windows('n', '3')})),
                     flatten(list_transform(range(4, len(t) + 1), lambda j: list_transform(range(1, 4), lambda n: t[j - n + 1 : j])))) END"""


def _ascii(x: str) -> str:
    return f"regexp_replace(replace(strip_accents({x}), 'ß', 'ss'), '[^\\x00-\\x7F]', '', 'g')"


def _squeezed(x: str) -> str:
    return f"array_to_string(list_filter(string_split({x}, ''), lambda c, i: i = 1 or c <> string_split({x}, '')[i - 1]), '')"


def _consonants(u: str) -> str:
    return " || ".join(f"CASE WHEN contains({u}, '{c}') THEN '{c}' ELSE '' END" for c in "JKQXZVWYBFMGPDHCLNTSR")


#: Which letters have which digit; W and H have none.
_SOUNDEX = {"0": "AEIOUY", "1": "BPFV", "2": "CSKGJQXZ", "3": "DT", "4": "L", "5": "MN", "6": "R"}
_REFINED = {"0": "AEIOUY", "1": "BP", "2": "FV", "3": "CKS", "4": "GJ", "5": "QXZ", "6": "DT", "7": "L", "8": "MN", "9": "R"}


def _digits(x: str, digits: dict[str, str]) -> str:
    for digit, letters in {"": "WH", **digits}.items():
        x = f"regexp_replace({x}, '[{letters}]', '{digit}', 'g')"
    return x


def _measure(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[{VOWELS_BOTH}]+[^{VOWELS_BOTH}]+'))"


def _rewritten(x: str, rules) -> str:
    for pattern, replacement in rules:
        pattern = pattern.removeprefix("(?iu)")
        x = f"regexp_replace({x}, {_text(pattern)}, {_text(replacement.replace('$', chr(92)))}, 'g')"
    return x


def _sorted_out(name: str, x: str, source: str) -> str:
    return f"SELECT word, {x} AS {name} FROM ({source})"


def _soundex(source: str = WORDS, keys: str = "word", name: str = "word") -> str:
    u = f"SELECT {keys}, regexp_replace(upper({_ascii(name)}), '[^A-Z]', '', 'g') AS u FROM ({source})"
    r = f"SELECT {keys}, u, {_digits('u[1:1]', _SOUNDEX)} AS f, {_digits('u[2:]', _SOUNDEX)} AS r FROM ({u})"
    q = f"SELECT {keys}, u, CASE WHEN r <> '' AND f = r[1:1] THEN r[2:] ELSE r END AS q FROM ({r})"
    s = f"SELECT {keys}, u, {_squeezed('q')} AS s FROM ({q})"
    return f"SELECT {keys}, CASE WHEN u = '' THEN '' ELSE rpad((u[1:1] || replace(s, '0', ''))[1:4], 4, '0') END AS soundex FROM ({s})"


def _refined(source: str = WORDS, keys: str = "word", name: str = "word") -> str:
    u = f"SELECT {keys}, regexp_replace(upper({_ascii(name)}), '[^A-Z]', '', 'g') AS u FROM ({source})"
    r = f"SELECT {keys}, u, {_digits('u[2:]', _REFINED)} AS r FROM ({u})"
    return f"SELECT {keys}, u[1:1] || {_squeezed('r')} AS refined_soundex FROM ({r})"


def _phonogram(source: str, name: str, latin: bool = True) -> str:
    before = [(p.replace(r"\z", "$"), r) for p, r in phonetics.BEFORE if latin]
    before = [("(?i)" + p.removeprefix("(?iu)"), r) for p, r in before]
    a = f"SELECT *, regexp_replace(lower({_ascii(_rewritten(name, before))}), '[^a-z]', '', 'g') AS a FROM ({source})"
    b = f"SELECT *, {_rewritten('a', phonetics.SOUNDS)} AS b FROM ({a})"
    c = f"SELECT *, regexp_replace({_squeezed('b')}, '[aeiouy]', '', 'g') AS c FROM ({b})"
    short = " ".join(f"WHEN a = '{k}' THEN '{v}'" for k, v in phonetics.SHORT.items())
    d = f"SELECT *, CASE {short} ELSE {_rewritten('c', phonetics.AFTER)} END AS d FROM ({c})"
    return f"SELECT * EXCLUDE (a, b, c, d), CASE WHEN d = '' THEN lower({_ascii(name)}) ELSE d END AS phonogram FROM ({d})"


def _first_rule(w: str, rules) -> str:
    listed = ", ".join(f"{{'s': '{s}', 'r': '{r}', 'm': {m}}}" for m, s, r in rules)
    made = f"{w}[1 : length({w}) - length(r.s)] || r.r"
    hits = f"list_filter([{listed}], lambda r: ends_with({w}, r.s) AND {_measure(made)} > r.m)"
    return f"coalesce(list_transform({hits}[1:1], lambda r: {made})[1], {w})"


def _carry() -> str:
    q = f"SELECT word, lower(word) AS w0 FROM ({WORDS})"
    for k, rules in enumerate((FIRST, SECOND, THIRD)):
        q = f"SELECT *, {_first_rule(f'w{k}', rules)} AS w{k + 1} FROM ({q})"
    return f"SELECT word, w3 AS stem FROM ({q})"


def _porter() -> str:
    v, o = f"[{VOWELS_BOTH}]", f"[^{VOWELS_BOTH}][{VOWELS_BOTH}][^{VOWELS_BOTH}wxWX]$"
    cut = lambda w, n: f"{w}[1 : length({w}) - {n}]"
    twice = lambda w, but="": f"(length({w}) > 1 AND {w}[-1:] = {w}[-2:-2] AND NOT contains('aeiouy{but}', {w}[-1:]))"
    steps = [
        lambda w: f"CASE WHEN regexp_matches({w}, '^.+?(ss|i)es$') THEN {cut(w, 2)} ELSE {w} END",
        lambda w: f"CASE WHEN regexp_matches({w}, '^.+?[^s]s$') THEN {cut(w, 1)} ELSE {w} END",
        lambda w: f"CASE WHEN ends_with({w}, 'eed') THEN CASE WHEN {_measure(cut(w, 1))} > 0 THEN {cut(w, 1)} ELSE {w} END"
        f" WHEN regexp_matches({w}, '(ed|ing)$') AND regexp_matches(regexp_replace({w}, '(ed|ing)$', ''), '{v}') THEN regexp_replace({w}, '(ed|ing)$', '') || '+' ELSE {w} END",
        lambda w: f"CASE WHEN NOT ends_with({w}, '+') THEN {w} WHEN regexp_matches({w}, '(at|bl|iz)[+]$') THEN {cut(w, 1)} || 'e'"
        f" WHEN {twice(cut(w, 1).join('()'), 'lsz')} THEN {cut(w, 2)} WHEN {_measure(cut(w, 1))} = 1 AND regexp_matches({cut(w, 1)}, '{o}') THEN {cut(w, 1)} || 'e' ELSE {cut(w, 1)} END",
        lambda w: f"CASE WHEN ends_with({w}, 'y') AND regexp_matches({cut(w, 1)}, '{v}') THEN {cut(w, 1)} || 'i' ELSE {w} END",
    ]
    put = lambda w, s, r, least: f"CASE WHEN {_measure(cut(w, len(s)))} > {least} THEN {cut(w, len(s))} || '{r}' ELSE {w} END"
    letter = lambda w: f"CASE strlen({w}) - length({w}) WHEN 0 THEN {w}[-2:-2] WHEN 1 THEN {w}[-1:] ELSE '' END"
    steps.append(lambda w: "CASE " + " ".join(f"WHEN {letter(w)} = '{s[-2]}' AND ends_with({w}, '{s}') THEN {put(w, s, r, 0)}" for s, r in STEP2) + f" ELSE {w} END")
    steps += [lambda w, s=s, r=r: f"CASE WHEN ends_with({w}, '{s}') THEN {put(w, s, r, 0)} ELSE {w} END" for s, r in STEP3]
    steps += [lambda w, s=s: f"CASE WHEN ends_with({w}, '{s}') THEN {put(w, s, '', 1)} ELSE {w} END" for s in STEP4]
    steps += [
        lambda w: f"CASE WHEN regexp_matches({w}, '[st]ion$') AND {_measure(cut(w, 3))} > 1 THEN {cut(w, 3)} ELSE {w} END",
        lambda w: f"CASE WHEN ends_with({w}, 'e') AND ({_measure(cut(w, 1))} > 1 OR ({_measure(cut(w, 1))} = 1 AND NOT regexp_matches({cut(w, 1)}, '{o}'))) THEN {cut(w, 1)} ELSE {w} END",
        lambda w: f"CASE WHEN ends_with({w}, 'll') AND {_measure(cut(w, 1))} > 1 THEN {cut(w, 1)} ELSE {w} END",
    ]
    q = f"SELECT word, lower(word) AS w FROM ({WORDS})"
    for step in steps:
        q = f"SELECT word, {step('w')} AS w FROM ({q})"
    return f"SELECT word, CASE WHEN strlen(lower(word)) < 3 THEN lower(word) ELSE w END AS stem FROM ({q})"


def _junk(w: str = "word") -> str:
    pairs = f"len(list_filter(range(2, length({w}) + 1), lambda i: {w}[i:i] = {w}[i - 1 : i - 1]))"
    letters = f"regexp_replace({w}, '[{VOWELS_BOTH}]', '.', 'g')"
    return f"(strlen({w}) > 30 OR {pairs} >= 3 OR regexp_matches({w}, '[{VOWELS_BOTH}]{{7}}') OR regexp_matches({letters}, '\\p{{L}}{{8}}') OR NOT regexp_matches({w}, '[{VOWELS_BOTH}]|[^\\p{{L}}]'))"


def _tags() -> str:
    """A capital and lower case stay together, so each word is a part, and so is the number."""
    whole = lambda i: f"CASE WHEN len(w) >= 4 * tag + {i} THEN upper(w[4 * tag + {i}][1:1]) || lower(w[4 * tag + {i}][2:]) END"
    parts = f"list_filter([{whole(1)}, {whole(2)}, CAST(tag AS VARCHAR), {whole(3)}, {whole(4)}], lambda x: x IS NOT NULL)"
    words = "SELECT doc_id, w, unnest(range((len(w) + 3) // 4)) AS tag FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]{2,}') AS w FROM documents)"
    return f"SELECT doc_id, tag, generate_subscripts(p, 1) - 1 AS pos, unnest(p) AS part FROM (SELECT doc_id, tag, {parts} AS p FROM ({words}))"


#: The tokens of each way in which the catalogue makes words; "w" stands for a word, "|" ends a kind. The way without any is a word twice with a hyphen.
_MADE = (
    ["w"], ["'l'''", "'a' || w"], ["w || 'n''t'"], ["hashtag|'#ab' || w"], ["mention|'@ab' || w"], ["url|'https://ab.cd/' || w || '?q=1.'"], ["email|w || '@mail.example.com'"],
    ["emoji|'🙂'", "w"], ["w", "'''s'"], ["'o''b' || w"], [], ["w", "'je'"], ["number|i || ',' || length(w)"], ["'Mr.'", "w"], ["'A.B.'", "w"], ["hashtag|'$ab' || w"],
    ["'''tis'"], ["w", "punct|'!'", "punct|'?'"], ["punct|'('", "w", "punct|')'"], ["w || '_' || w"], ["emoji|'👍🏾'", "emoji|'🇫🇷'"],
    ["number|'-' || i", "punct|'-'", "w"], ["w || i || 'º'"], ["'d’'", "'é' || w"],
)
#: After a hyphen these are words of their own.
_CLITICS = "'ils', 'elle', 'elles', 'nous', 'vous', 'les', 'moi', 'toi', 'lui'"


def _made() -> str:
    def listed(tokens: list[str]) -> str:
        parts = [t.split("|", 1) if re.match(r"[a-z]+\|[^|]", t) else ["word", t] for t in tokens]
        return "[" + ", ".join(f"{{'kind': '{kind}', 'text': {text}}}" for kind, text in parts) + "]"

    ways = [listed(t) if t else f"CASE WHEN w IN ({_CLITICS}) THEN {listed(['w', 'w'])} ELSE {listed(['w || chr(45) || w'])} END" for t in _MADE]
    cases = " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(ways))
    words = "SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) - 1 AS i FROM (SELECT doc_id, regexp_extract_all(text, '[a-z]{3,}') AS t FROM documents)"
    tokens = f"SELECT doc_id, i, generate_subscripts(l, 1) AS k, unnest(l) AS t FROM (SELECT doc_id, i, CASE i % {len(_MADE)} {cases} END AS l FROM ({words}))"
    return f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1 AS pos, t.kind AS kind, t.text AS text FROM ({tokens})"


def _paragraphs(aerated: bool) -> str:
    newline = r"(?:\n\r|\r\n|\r|\n)"
    return rf"SELECT doc_id, generate_subscripts(p, 1) - 1 AS par, unnest(p) AS paragraph FROM (SELECT doc_id, regexp_split_to_array(text, '{newline}[\t\s]*{newline}{'+' if aerated else '*'}') AS p FROM documents)"


#: What each letter that the catalogue writes in another script is in ASCII, a to z; and the parts of Hangul syllables.
_READ = {
    "georgian": "a b ts d e p g h i j k l m n o p q r s t u v ts kh gh z",
    "armenian": "A b ts d e f g h i j k l m n o p k r s t ow v w kh y Z",
    "hebrew": "a b ts d ' p g h y z k l m n v p q r s t v v sh kh y z",
    "arabic": "a b ch d y f g h y j k l m n w p q r s t w th w kh y z",
    "hiragana": "a ba cha da e fu gyo ha i ju kka ru ma n o ppu kwe ri sha tta u va wa tchi ya ze",
    "katakana": "a bi che dyu e fa gu he i jo kyu - mi na o ppo tu ro shu ti zu vi wi ssa yu tsu",
}
_LEAD = "g gg n d dd r m b bb s ss - j jj c k t p h"
_VOWEL = "a ae ya yae eo e yeo ye o wa wae oe yo u weo we wi yu eu yi i"
_TAIL = "- g gg gs n nj nh d l lg lm lb ls lt lp lh m b bs s ss ng j c k t p h"


def _list(words: str) -> str:
    return "[" + ", ".join("''" if w == "-" else _text(w) for w in words.split()) + "]"


def _scripts() -> str:
    rows = "[" + ", ".join(_list(v) for v in _READ.values()) + "]"
    names = _list(" ".join(_READ))
    read = f"array_to_string(list_transform(string_split(word, ''), lambda c: {rows}[k + 1][ascii(c) - 96]), '')"
    words = f"SELECT word, {names}[k + 1] AS script, {read} AS ascii FROM (SELECT word, (length(word) + ascii(word)) % {len(_READ)} AS k FROM ({WORDS}) WHERE regexp_full_match(word, '[a-z]+'))"
    return _coded("word, script", words, phonogram=True)


def _coded(keys: str, source: str, phonogram: bool = False) -> str:
    """The codes of names that ``source`` gives in ASCII."""
    sound, refined = _soundex(source, keys, "ascii"), _refined(source, keys, "ascii")
    omission = f"SELECT {keys}, ascii, {_omission()} AS omission_key FROM (SELECT {keys}, ascii, u, regexp_extract_all(u, '[AEIOU]') AS v FROM (SELECT {keys}, ascii, upper(ascii) AS u FROM ({source})))"
    more = f" JOIN (SELECT {keys}, phonogram FROM ({_phonogram(source, 'ascii', latin=False)})) USING ({keys})" if phonogram else ""
    return f"SELECT * FROM ({omission}) JOIN ({sound}) USING ({keys}) JOIN ({refined}) USING ({keys}){more}"


def _omission() -> str:
    return f"{_consonants('u')} || array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i), '')"


def _hangul() -> str:
    read = " || ".join(f"{_list(_LEAD)}[n{i} // 588 + 1] || {_list(_VOWEL)}[n{i} // 28 % 21 + 1] || {_list(_TAIL)}[n{i} % 28 + 1]" for i in range(3))
    return _coded("p_partkey", f"SELECT p_partkey, {read} AS ascii FROM (SELECT p_partkey, {', '.join(f'(p_partkey * 7919 + {i * 613}) % 11172 AS n{i}' for i in range(3))} FROM part)")


#: White space of Unicode, for patterns and for trimming; what stands before a sentence may be any control character too.
_W = r"[\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STOP = rf"[.?!…]+(?:{_W}[.?!…])*[«»„‟“”\")}}\]]?{_W}+"
_NO_STOP = rf"(?:^|[^\p{{L}}\p{{M}}\p{{N}}_])(?i:[A-Z0-9]{_W}*|prof|me?lle|mgr|mrs|mme?|[djms]r|st|etc|ms?|pp?)$"


def _sentences(source: str, keys: str) -> str:
    """keys, sent and sentence, from keys and text: a walk from each place where a sentence may end to the next.

    ``now`` is the sentence as far as it has come, ``ends`` whether it is over.
    """
    listed = [k.strip() for k in keys.split(",")]
    of = lambda t: ", ".join(f"{t}.{k}" for k in listed)
    odd = lambda x, chars: f"len(regexp_extract_all({x}, '{chars}')) % 2 = 1"
    return rf"""WITH RECURSIVE texts AS MATERIALIZED ({source}),
    parts AS MATERIALIZED (SELECT {keys}, generate_subscripts(p, 1) AS i, unnest(p) AS part, len(p) AS n FROM (SELECT {keys}, regexp_extract_all(text, '(?s).*?{_STOP}|(?s).+') AS p FROM texts)),
    walk AS (SELECT {keys}, CAST(0 AS BIGINT) AS i, CAST(1 AS BIGINT) AS n, CAST(0 AS BIGINT) AS sent, '' AS now, false AS ends FROM texts
        UNION ALL
        SELECT {keys}, i, n, sent, now || part, regexp_matches(part, '{_STOP}$') AND NOT regexp_matches(near || body, '{_NO_STOP}') AND NOT {odd('near || part', '[«»„‟“”"]')} AND (NOT {odd('near || part', r'[(){}\[\]]')} OR regexp_matches(near || part, '^[A-Z0-9]\)'))
        FROM (SELECT {keys}, i, n, sent, now, part, regexp_replace(part, '{_STOP}$', '') AS body,
                CASE WHEN strlen(now) <= 256 THEN now ELSE right(now, list_filter(range(64, 257), lambda k: strlen(right(now, k)) >= 256)[1]) END AS near
            FROM (SELECT {of('p')}, p.i, p.n, CASE WHEN w.ends THEN w.sent + 1 ELSE w.sent END AS sent, CASE WHEN w.ends THEN '' ELSE w.now END AS now,
                    CASE WHEN w.ends OR w.now = '' THEN regexp_replace(p.part, '^(?:[\x00-\x1f]|{_W})+', '') ELSE p.part END AS part
                FROM walk w JOIN parts p ON {' AND '.join(f'p.{k} = w.{k}' for k in listed)} AND p.i = w.i + 1)))
SELECT {keys}, sent, regexp_replace(now, '{_W}+$', '') AS sentence FROM walk WHERE i > 0 AND (ends OR i = n) AND now <> ''"""


def _segmented() -> str:
    lines = _paragraphs(False)
    cut = _sentences(f"SELECT doc_id, par, paragraph AS text FROM ({lines})", "doc_id, par")
    return rf"SELECT doc_id, par, sent, CAST(n AS BIGINT) AS n_tokens FROM (SELECT doc_id, par, sent, len(regexp_extract_all(sentence, '{LEXER}')) AS n FROM ({cut})) WHERE n > 0"


def all_sql(stopwords: tuple[str, ...]) -> dict[str, str]:
    stop = ", ".join(f"'{w}'" for w in stopwords)
    size = "len(string_split(p_name, ' '))"
    estimate = lambda n: f"CASE WHEN {size} < {n} - 1 THEN 1 ELSE {size} - ({n} - 1) END"
    counted = lambda by, where="true": f"SELECT {by}, count(*) AS n FROM ({TOKENS}) WHERE {where} GROUP BY {by}"
    words_ = lambda name, x: _sorted_out(name, x, WORDS)
    return {
        "simple_tokens": _simple(),
        "simple_token_counts": f"SELECT text, count(*) AS n FROM ({_simple()}) WHERE length(text) >= 3 AND lower(text) NOT IN ({stop}) GROUP BY text",
        "word_tokens_docs": TOKENS,
        "token_kind_counts": counted("kind"),
        "tokens_blacklist": counted("doc_id", "kind NOT IN ('punct', 'number')"),
        "tokens_whitelist": counted("kind, text", "kind IN ('number', 'mention')"),
        "tokens_min_max": counted("doc_id", "length(text) BETWEEN 4 AND 7"),
        "tokens_stopwords": counted("doc_id", f"lower(text) NOT IN ({stop})"),
        "tokens_insert_stopword": f"SELECT doc_id, count(*) AS n FROM ({_simple()}) WHERE lower(text) NOT IN ('the', 'que') GROUP BY doc_id",
        "token_pairs": _simple(),
        "token_kinds": f"SELECT DISTINCT input, CASE WHEN input IN ('word', 'hashtag', 'mention', 'emoji', 'punct', 'number', 'url', 'email') THEN input END AS kind FROM (SELECT role AS input FROM conversations UNION ALL SELECT unnest(['word', 'hashtag', 'mention', 'emoji', 'punct', 'number', 'url', 'email', 'Word', '', 'smiley']))",
        "tokens_marked_docs": _made(),
        "hashtag_parts_docs": _tags(),
        "ngrams_docs_2": rf"SELECT gram, count(*) AS n FROM (SELECT unnest(CASE WHEN len(t) = 0 THEN [] ELSE list_transform(range(1, greatest(len(t), 2)), lambda i: array_to_string(t[i : i + 1], ' ')) END) AS gram FROM (SELECT regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+') AS t FROM documents)) GROUP BY gram",
        "tokens_no_junk": counted("doc_id", f"NOT (kind = 'word' AND {_junk('text')})"),
        "junk_words": f"SELECT word, {_junk()} AS junk, regexp_matches(word, '^[{VOWELS_BOTH}]') AS vowel FROM ({WORDS})",
        "ngrams_2": _grams(_windows("2")),
        "ngrams_3": _grams(_windows("3")),
        "ngrams_short": _grams(_windows("9")),
        "ngrams_range_1_3": _grams(_RANGE),
        "ngrams_len": f"SELECT p_partkey, {', '.join(f'CAST({estimate(n)} AS BIGINT) AS n{n}' for n in (1, 2, 5, 6, 9))}, CAST({' + '.join(f'({estimate(n)})' for n in (1, 2, 3, 4))} AS BIGINT) AS r1_4, CAST(CASE WHEN {size} < 7 THEN 1 ELSE {estimate(7)} + {estimate(8)} END AS BIGINT) AS r7_8 FROM part",
        "paragraphs": _paragraphs(True),
        "paragraphs_spaced_docs": f"SELECT doc_id, generate_subscripts(p, 1) - 1 AS par, unnest(p) AS paragraph FROM (SELECT doc_id, list_transform(string_split(text, '. '), lambda x, i: CASE WHEN i > 1 THEN '  ' || x ELSE x END || CASE WHEN i < len(string_split(text, '. ')) THEN '.' ELSE '' END) AS p FROM documents)",
        "paragraphs_lines": _paragraphs(False),
        "sentences": _sentences("SELECT doc_id, text FROM documents", "doc_id"),
        "doc_pipeline": _segmented(),
        "fingerprint_key": r"SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(p_name, '\s+'), lambda w: lower(regexp_replace(w, '[^A-Za-z0-9]', '', 'g'))), lambda w: w <> ''))), ' ') AS fingerprint FROM part",
        "fingerprint_tokens": r"SELECT doc_id, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS token FROM (SELECT doc_id, list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(text, '\s+'), lambda w: lower(regexp_replace(w, '[^A-Za-z0-9]', '', 'g'))), lambda w: w <> ''))) AS t FROM documents)",
        "omission_key": f"SELECT word, {_consonants('u')} || array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i), '') AS omission_key FROM (SELECT word, u, regexp_extract_all(u, '[AEIOU]') AS v FROM (SELECT word, upper({_ascii('word')}) AS u FROM ({WORDS})))",
        "soundex": _soundex(),
        "refined_soundex": _refined(),
        "phonogram": _phonogram(WORDS, "word"),
        "csv_phonogram_roundtrip": _phonogram("SELECT p_name, CAST(p_partkey AS VARCHAR) AS p_partkey FROM part", "p_name"),
        "names_phonogram": _phonogram("SELECT DISTINCT p_name AS name FROM part", "name"),
        "s_stem": words_("stem", "CASE WHEN strlen(word) < 3 THEN word WHEN regexp_matches(word, '[^ae]ies$') THEN regexp_replace(word, 'ies$', 'y') WHEN regexp_matches(word, '(us|ss|[iaoe]es)$') THEN word ELSE regexp_replace(word, 's$', '') END"),
        "porter_stem": _porter(),
        "carry_stem": _carry(),
        "stem_measure": words_("measure", f"CAST({_measure('word')} AS BIGINT)"),
        "squeeze": "SELECT doc_id, array_to_string(list_transform(list_zip(c, list_prepend('', c)), lambda p: CASE WHEN p[1] = p[2] THEN '' ELSE p[1] END), '') AS squeezed FROM (SELECT doc_id, string_split(text, '') AS c FROM documents)",
        "reduce_lengthening": "SELECT doc_id, coalesce(string_agg(CASE WHEN c = a AND c = b AND c = d AND NOT regexp_matches(c, '\\p{N}') THEN '' ELSE c END, '' ORDER BY i), '') AS reduced FROM (SELECT doc_id, i, c, lag(c, 1) OVER w AS a, lag(c, 2) OVER w AS b, lag(c, 3) OVER w AS d FROM (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM documents) WINDOW w AS (PARTITION BY doc_id ORDER BY i)) GROUP BY doc_id",
        "codes_of_scripts": _scripts(),
        "soundex_tokens": f"SELECT doc_id, soundex AS code, count(*) AS n FROM ({_simple()}) t JOIN ({_soundex()}) s ON t.text = s.word GROUP BY ALL",
        "tokens_large_stoplist": f"""SELECT doc_id, count(*) AS n FROM ({_simple()}) t ANTI JOIN (
            SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'))) AS w FROM (SELECT text FROM benchmark UNION ALL SELECT p_name FROM part)
            UNION SELECT CAST(range AS VARCHAR) FROM range(1000000)) s ON lower(t.text) = s.w GROUP BY doc_id""",
        "ngrams_range_docs": rf"""SELECT doc_id, generate_subscripts(g, 1) - 1 AS pos, array_to_string(unnest(g), ' ') AS gram FROM (SELECT doc_id, CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 3 THEN [t]
            ELSE list_concat([t[1:2], t[2:3], t[1:3]], flatten(list_transform(range(4, len(t) + 1), lambda j: [t[j - 1 : j], t[j - 2 : j]]))) END AS g
            FROM (SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+') AS t FROM documents))""",
        "codes_of_hangul": _hangul(),
        "unidecode": words_("ascii", _ascii("word")),
    }
