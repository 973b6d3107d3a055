"""Markup as column expressions: tokens of a page, character references, text blocks.

A page is read by patterns that take, at each place, the first of: a comment, an element whose
content is no text (``RAW``), a declaration, a tag. So a tag in a script or a script in a
comment is not one. What has no end reaches to the end of the page, as in browsers. In a tag,
a quoted value may hold any character; a quote without a partner is a character like others.
Quantifiers are possessive, so that time grows with the length of the page only.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements whose content is no page text, elements that break the text, and
# elements and words in a class, id or role that stand for navigation and advertising.
RAW = ("script", "style", "noscript", "template", "title", "textarea", "svg", "iframe", "select")
BLOCK = (
    "address article aside blockquote body br button caption center dd details dialog div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main "
    "menu nav ol option p pre section summary table tbody td tfoot th thead tr ul"
).split()
ASIDE = ("aside", "footer", "form", "menu", "nav")
ASIDE_WORDS = (
    "ad ads advert advertisement banner breadcrumb breadcrumbs cookie cookies footer menu nav "
    "navbar navigation promo share sidebar social sponsor sponsored widget"
).split()

#: Marks for tags once these are gone: a link, its end, a break, a break before what stands aside,
#: and the end of an element that breaks. A page's own such characters become blanks.
LINK, LINK_END, BREAK, ASIDE_BREAK, CLOSE = "\x01", "\x02", "\x03", "\x04", "\x05"
_MARKS = r"[\x01-\x05]"
#: White space of a page, no-break space included.
BLANK = r"[\x20\x09-\x0D\x{85}\x{A0}]"
_S = r"[\x20\x09-\x0D]"

# Behind a tag's name or inside a tag, to its end.
_IN_TAG = r"""(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+(?:>|\z)"""
_REST = rf"(?:[\x20\x09-\x0D/]{_IN_TAG}|>|\z)"
_NO_TEXT = (
    r"(?is)<!--(?:.*?-->|.*\z)"
    rf"|<({'|'.join(RAW)}){_REST}(?:.*?</\1(?:[\x20\x09-\x0D/][^>]*+)?(?:>|\z)|.*\z)"
    r"|<[!?][^>]*+(?:>|\z)|</[^a-z>][^>]*+(?:>|\z)"
)
_WORD = "|".join(ASIDE_WORDS)
_VALUE = "|".join(
    rf"{q}(?:[^{q}]*[^A-Za-z0-9{q}])?(?:{_WORD})(?:[^A-Za-z0-9{q}][^{q}]*+)?{q}" for q in ("\"", "'")
)
_TAGS = (
    (rf"(?i)<a{_REST}", LINK),
    (rf"(?i)</a{_REST}", LINK_END),
    (rf"(?i)<(?:{'|'.join(ASIDE)}){_REST}", ASIDE_BREAK),
    (
        rf"(?i)<(?:div|header|ol|p|section|table|ul){_S}(?:[^>]*?{_S})?"
        rf"(?:class|id|role){_S}*={_S}*(?:{_VALUE}){_IN_TAG}",
        ASIDE_BREAK,
    ),
    (rf"(?i)<(?:{'|'.join(BLOCK)}){_REST}", BREAK),
    (rf"(?i)</(?:{'|'.join(BLOCK)}){_REST}", CLOSE),
    (rf"(?i)</?[a-z][^\x20\x09-\x0D/>]*+{_REST}", ""),
)


def marked(html: Column) -> Column:
    """The text of a page with marks where links begin and end and where tags break it."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), _MARKS, " ")
    text = F.regexp_replace(text, _NO_TEXT, " ")
    for pattern, mark in _TAGS:
        text = F.regexp_replace(text, pattern, mark)
    return text


def breaks_joined(text: Column) -> Column:
    """White space as single blanks and runs of breaks as one: a run is a break before what
    stands aside if such an element begins in it and is not empty."""
    text = F.regexp_replace(text, BLANK + "+", " ")
    text = F.regexp_replace(text, r"\x04 ?\x05", BREAK)
    text = F.regexp_replace(text, r"[\x03\x05][\x03\x05 ]*+", BREAK)
    return F.regexp_replace(text, r" ?\x03?\x04[\x03\x04 ]*+", ASIDE_BREAK)


def blocks(text: Column) -> Column:
    """The pieces between breaks that have words, in order: ``aside``, number of ``words``,
    of these ``linked``, and ``text``."""

    def plain(piece: Column) -> Column:
        return F.btrim(F.regexp_replace(F.regexp_replace(piece, _MARKS, ""), " +", " "))

    def count(text: Column) -> Column:
        blanks = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
        return F.when(text == "", 0).otherwise(blanks + 1)

    def one(piece: Column) -> Column:
        unlinked = F.regexp_replace(piece, r"\A[^\x01\x02]*+\x02|\x01[^\x02]*+(?:\x02|\z)", " ")
        return F.struct(
            F.startswith(piece, F.lit(ASIDE_BREAK)).alias("aside"),
            plain(piece).alias("text"),
            plain(unlinked).alias("unlinked"),
        )

    def counted(block: Column) -> Column:
        words = count(block["text"])
        return F.struct(
            block["aside"].alias("aside"),
            words.alias("words"),
            (words - count(block["unlinked"])).alias("linked"),
            block["text"].alias("text"),
        )

    pieces = F.regexp_extract_all(text, F.lit(r"[\x03\x04]?[^\x03\x04]+"), F.lit(0))
    return F.transform(F.filter(F.transform(pieces, one), lambda b: b["text"] != ""), counted)


def references(text: Column) -> Column:
    """Character references as the characters they stand for, each once. Numbers that stand for
    no character become U+FFFD, control characters a blank; unknown names stay as they are."""
    listed = "\n".join(f"{name}\t{chr(code)}" for name, code in [*name2codepoint.items(), ("apos", 39)])
    names = F.str_to_map(F.lit(listed), F.lit("\n"), F.lit("\t"))

    def one(part: Column) -> Column:
        digits = F.regexp_extract(part, r"^#([0-9]{1,9});", 1)
        hexadecimal = F.regexp_extract(part, r"^#[xX]([0-9A-Fa-f]{1,8});", 1)
        code = F.when(digits != "", digits.cast("bigint")).otherwise(F.conv(hexadecimal, 16, 10).cast("bigint"))
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        no_char = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        name = F.regexp_extract(part, r"^([A-Za-z][A-Za-z0-9]*);", 1)
        named = F.element_at(names, name)
        rest = F.substring(part, F.instr(part, ";") + 1, F.length(part))
        numeric = (digits != "") | (hexadecimal != "")
        return (
            F.when(numeric, F.concat(F.when(no_char, "�").when(code < 32, " ").otherwise(char), rest))
            .when(named.isNotNull(), F.concat(named, rest))
            .otherwise(F.concat(F.lit("&"), part))
        )

    parts = F.split(text, "&", -1)
    decoded = F.transform(parts, lambda part, i: F.when(i == 0, part).otherwise(one(part)))
    return F.when(F.contains(text, F.lit("&")), F.array_join(decoded, "")).otherwise(text)
