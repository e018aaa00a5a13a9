"""DuckDB SQL fragments that restate the Column functions for the oracle.

Each helper takes SQL expression text and returns SQL expression text.  The
oracle is written independently of the Spark code (relational where Spark
uses arrays, look-ahead-free regexes where Spark uses Java look-ahead) so the
two sides check each other.
"""

from __future__ import annotations

from versify.functions.rhyme import RHYME_ACCENTED_VOWELS
from versify.functions.syllable import ALPHA, CONSONANTS, LETTERS, MARK, STRONG_VOWELS, VOWELS

NL = "chr(10)"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"


VERSE_CTE = f"""
vw AS (SELECT doc_id, lang, regexp_extract_all(text, '\\S+') AS words FROM documents),
vp AS (SELECT doc_id, lang, words, unnest(range(0, (len(words) + 83) // 84)) AS p FROM vw WHERE len(words) > 0),
vq AS (SELECT doc_id, lang, CAST(p + 1 AS INTEGER) AS poem_no, list_slice(words, p * 84 + 1, p * 84 + 84) AS pw FROM vp),
vl AS (SELECT doc_id, lang, poem_no,
              list_transform(range(0, (len(pw) + 5) // 6),
                             lambda i: array_to_string(list_slice(pw, i * 6 + 1, i * 6 + 6), ' ')) AS ls
       FROM vq),
verse AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(poem_no AS INTEGER) AS poem_no, lang,
         array_to_string(list_transform(ls, lambda l, i:
             CASE WHEN i - 1 IN (4, 8, 11) AND doc_id % 5 <> 0 THEN {NL} || l ELSE l END), {NL}) AS text
  FROM vl
)"""

VERSE_LINES_CTE = (
    VERSE_CTE
    + f""",
vlines AS (
  SELECT doc_id, poem_no, lang, CAST(ln AS BIGINT) AS line_no, line FROM (
    SELECT doc_id, poem_no, lang, unnest(string_split(text, {NL})) AS line,
           generate_subscripts(string_split(text, {NL}), 1) AS ln
    FROM verse))"""
)


def normalize_word(e: str) -> str:
    return f"lower(regexp_replace(strip_accents({e}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'))"


def rhyme_suffix(w: str) -> str:
    acc = RHYME_ACCENTED_VOWELS
    chunk = f"(string_split_regex(lower(replace({w}, '’', '''')), '[''-]'))[-1]"
    original = f"regexp_replace({chunk}, '[^\\p{{L}}\\p{{N}}_\\s{acc}]', '', 'g')"
    normalized = normalize_word(chunk)
    from_acc = f"regexp_extract({original}, '[{acc}][^{acc}]*$')"
    two = f"regexp_extract({normalized}, '[aeiou][^aeiou]*[aeiou][^aeiou]*$')"
    one = f"regexp_extract({normalized}, '[aeiou][^aeiou]*$')"
    last3 = f"regexp_extract({normalized}, '.{{0,3}}$')"
    return (
        f"(CASE WHEN {chunk} = '' THEN '' WHEN {normalized} = '' THEN '' "
        f"WHEN {from_acc} <> '' THEN {from_acc} WHEN {two} <> '' THEN {two} "
        f"WHEN {one} <> '' THEN {one} ELSE {last3} END)"
    )


def last_word(line: str) -> str:
    return f"coalesce(regexp_extract_all({line}, '\\S+')[-1], '')"


def last_word_for_tagging(line: str) -> str:
    cleaned = f"regexp_replace({line}, '[^\\p{{L}}\\p{{N}}_'']+$', '', 'g')"
    return last_word(cleaned)


def first_occurrence_signature(lst: str) -> str:
    """W5 without ordered list_distinct: position of the first equal element."""
    return f"array_to_string(list_transform({lst}, lambda x: chr(64 + CAST(list_position({lst}, x) AS INTEGER) - 0)), '')"


# ---- syllables, look-ahead free (RE2) ----------------------------------
_V, _S, _C = VOWELS.replace("'", "''"), STRONG_VOWELS, CONSONANTS
_L = LETTERS.replace("'", "''")
_M = MARK
_CLUSTER = "ch|gh|gn|gl|sc|[pbcftvdg][rl]|s[bcdfghjlmnpqrtvwxz]+"


def _cons_minus(chars: str) -> str:
    return "".join(c for c in "bcdfghjlmnpqrstvwxz" if c not in chars)


def mark_syllables(e: str) -> str:
    r1 = [
        ("s", "s"),
        ("c", _cons_minus("hrl")),
        ("g", _cons_minus("hnlr")),
        ("pbftvd", _cons_minus("rl")),
        ("hjlmnqrwxz", "bcdfghjlmnpqrstvwxz"),
    ]
    for a, b in r1:
        e = f"regexp_replace({e}, '(?i)([{_V}])([{a}])([{b}])', '\\1\\2{_M}\\3', 'g')"
    for _ in range(2):
        e = f"regexp_replace({e}, '(?i)([{_V}])({_CLUSTER})([{_V}])', '\\1{_M}\\2\\3', 'g')"
    e = f"regexp_replace({e}, '(?i)([{_S}])([{_S}])', '\\1{_M}\\2', 'g')"
    for _ in range(2):
        e = f"regexp_replace({e}, '(?i)([{_V}])([{_C}])([{_V}])', '\\1{_M}\\2\\3', 'g')"
    return e


def syllable_blocks(line: str) -> str:
    return f"regexp_extract_all({mark_syllables(line)}, '^[^{_L}]+|[{_L}]+[^{_L}{_M}]*')"


def letters_only(e: str) -> str:
    return f"regexp_replace({e}, '[^{_L}]', '', 'g')"


def should_merge(cur: str, nxt: str) -> str:
    cc, nc = letters_only(cur), letters_only(nxt)
    starts_vowel = f"regexp_matches({nc}, '(?i)^[hH]?[{_V}]')"
    return (
        f"({cc} <> '' AND {nc} <> '' AND ("
        f"(regexp_matches({cc}, '[’'']$') AND {starts_vowel}) OR "
        f"(regexp_matches({cc}, '(?i)[{_V}’''][hH]?$') AND {starts_vowel} AND regexp_matches({cur}, '[^{_L}]$'))))"
    )


def kept_whole(block: str) -> str:
    return f"(contains({strip(block)}, ' ') OR regexp_matches({block}, '[’'']'))"


def block_syllables(block: str) -> str:
    """Syllable tokens produced by one merged block."""
    return (
        f"(CASE WHEN {kept_whole(block)} THEN (CASE WHEN regexp_matches({block}, '[{ALPHA}]') "
        f"AND NOT starts_with({block}, '<') THEN 1 ELSE 0 END) "
        f"ELSE len(regexp_extract_all({block}, '[{ALPHA}]+')) END)"
    )


RHYME_LINE = "^(<RHYME_[A-Z]>)\\s+([^|]+?)\\s+\\|\\s+(.*)$"
