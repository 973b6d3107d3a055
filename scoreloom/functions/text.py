"""Text expressions: trimming, lines and answer extraction.

Patterns spell out Unicode classes instead of ``\\b``, ``\\w`` and ``\\s``, whose
meaning in Java differs from the one the answers are defined by.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space at the ends of a text, what breaks a
# line, and the shapes of the identifiers looked for in answers.
WHITESPACE = "".join(
    map(
        chr,
        [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680]
        + [*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000],
    )
)
LINE_BREAK = r"[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
WEAKNESS_ID = r"CWE-\p{Nd}+"
SEVERITY_VECTOR = (
    r"(?:CVSS:3\.[01]/)?AV:[A-Za-z]+/AC:[A-Za-z]+/PR:[A-Za-z]+/UI:[A-Za-z]+"
    r"/S:[A-Za-z]+/C:[A-Za-z]+/I:[A-Za-z]+/A:[A-Za-z]+"
)
TECHNIQUE_ID = r"(T\p{Nd}{4})(?:\.\p{Nd}{3})?"
LETTERS = ("A", "B", "C", "D")
TAIL_LINES = 5

# A letter standing alone, or one after an underscore at the end of its line. In
# any line the first kind lies left of the second, so the leftmost match over the
# lines joined last-to-first is the answer. Letters are tried before the look at
# what precedes them, which keeps the scan cheap; the character beyond the basic
# plane in the class makes Java step back by characters and not by code units.
_WORD = r"[\p{L}\p{N}_" + chr(0x10FFFF) + "]"
_TAIL_LETTER = rf"(?s)[ABCD](?:(?<!{_WORD}.)(?!{_WORD})|(?<=_.)(?=\n|\z))"


def strip(text: Column) -> Column:
    """Remove white space of any script from both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def nonblank_lines(text: Column) -> Column:
    """Lines of a text, each stripped, blank ones dropped."""
    lines = F.transform(F.split(text, LINE_BREAK), strip)
    return F.filter(lines, lambda line: line != "")


def first_response(texts: Column) -> Column:
    """The scored response: the first of the list, null when there is none."""
    return F.get(texts, F.lit(0))


def extract_choice_letter(text: Column) -> Column:
    """The letter A-D a response settles on, null when it settles on none.

    Looks at the last five non-blank lines, last line first; failing that, takes
    the only capital among A-D that occurs anywhere in the text.
    """
    tail = F.slice(F.reverse(nonblank_lines(text)), 1, TAIL_LINES)
    joined = F.replace(F.array_join(tail, "\n"), F.lit("**"), F.lit(" "))
    hits = F.regexp_extract_all(joined, F.lit(_TAIL_LETTER), F.lit(0))

    seen = [F.contains(text, F.lit(letter)) for letter in LETTERS]
    how_many = sum((s.cast("int") for s in seen[1:]), seen[0].cast("int"))
    only = F.coalesce(*[F.when(s, F.lit(x)) for s, x in zip(seen, LETTERS)])
    return F.coalesce(F.get(hits, F.lit(0)), F.when(how_many == 1, only))


def _last_match(text: Column, pattern: str) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lit(-1))


def find_weakness_id(text: Column) -> Column:
    """Last weakness id in the text, null when there is none."""
    return _last_match(text, WEAKNESS_ID)


def extract_weakness_id(text: Column) -> Column:
    """Last weakness id in the text, else the text itself."""
    return F.coalesce(find_weakness_id(text), text)


def find_severity_vector(text: Column) -> Column:
    """Last severity vector in the text, null when there is none."""
    return _last_match(text, SEVERITY_VECTOR)


def extract_severity_vector(text: Column) -> Column:
    """Last severity vector in the text, else the text itself."""
    return F.coalesce(find_severity_vector(text), text)


def extract_techniques(text: Column) -> Column:
    """Distinct main technique ids, in order of first mention."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TECHNIQUE_ID), F.lit(1)))


def parse_technique_list(text: Column) -> Column:
    """Entries of a comma list that start like a technique id, cut at the dot."""
    entries = F.transform(F.split(text, ","), strip)
    kept = F.filter(entries, lambda entry: entry.rlike(r"^T\p{Nd}{4}"))
    return F.transform(kept, lambda entry: F.substring_index(entry, ".", 1))


def cut_at_stops(text: Column, stops) -> Column:
    """Cut a response at each stop string in turn.

    ``stops`` is a list known when the job is written, or an array column when it
    differs by row.
    """
    if isinstance(stops, Column):
        usable = F.filter(F.coalesce(stops, F.array().cast("array<string>")), lambda s: s != "")
        return F.aggregate(usable, text, lambda kept, s: F.split_part(kept, s, F.lit(1)))
    for stop in stops or ():
        if stop:
            text = F.substring_index(text, stop, 1)
    return text
