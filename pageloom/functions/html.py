"""HTML expressions: a single regular-expression pass finds tags the way an
HTML tokenizer would (comments, raw-text elements and quoted attribute values
are skipped as units). Possessive quantifiers keep the matcher iterative, so
long tags cannot exhaust the stack."""

from __future__ import annotations

from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import _let

# Elements whose content is text, never markup.
RAW_TEXT_ELEMENTS = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript")

_TAG_BODY = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
_COMMENT = r"<!--(?:-?>|.*?(?:--!?>|\z))"
_ATTRIBUTE_VALUE = r"""(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'][^\s]*+)?+)?+"""


def _raw_text(names: tuple[str, ...], group: int) -> str:
    return rf"<({'|'.join(names)})(?=[\s/>]).*?(?:</\{group}(?=[\s/>])|\z)"


# What the tokenizer steps over: other tags, declarations, and a tag that is
# never closed, which takes the rest of the text.
OTHER_TAGS = rf"</?[a-z]{_TAG_BODY}>|<[!?/][^>]*+>|<(?:/?[a-z]|[!?/]).*+\z"
MARKUP = f"(?is){_COMMENT}|{OTHER_TAGS}"


def without_tags(html: Column) -> Column:
    """Text between tags: ``>`` in quoted values and a lone ``<`` end and begin nothing."""
    return F.regexp_replace(html, MARKUP, "")


def pieces(html: Column, raw_elements: bool = True) -> Column:
    """The text cut into tags, comments and what lies between, in order; elements
    of raw text are one piece. A tag that is never closed is the last piece."""
    raw = rf"{_raw_text(RAW_TEXT_ELEMENTS, 1)}(?:[^>]*+>)?+|" if raw_elements else ""
    return F.regexp_extract_all(html, F.lit(f"(?is){_COMMENT}|{raw}{OTHER_TAGS}|[^<]++|<"), F.lit(0))


def is_markup(piece: Column) -> Column:
    """Whether a piece is a tag, a comment or a declaration."""
    return piece.rlike("^<(?:/?[a-zA-Z]|[!?/])")


def tag_pattern(*names: str) -> str:
    """Pattern whose group 2 is ``name attributes`` of each wanted start tag
    and empty for everything else the tokenizer steps over."""
    wanted = rf"<((?:{'|'.join(names)})(?=[\s/>]){_TAG_BODY})>"
    return f"(?is){_COMMENT}|{_raw_text(RAW_TEXT_ELEMENTS, 1)}|{wanted}|{OTHER_TAGS}"


def start_tags(html: Column, *names: str) -> Column:
    """Array of ``name attributes`` of the wanted tags, in document order."""
    found = F.regexp_extract_all(html, F.lit(tag_pattern(*names)), F.lit(2))
    return F.filter(found, lambda tag: tag != "")


def _before(name: str) -> str:
    skipped = rf"(?:[\s/]++(?!{name}(?:[\s=/]|\z))[^\s/][^\s/=]*+{_ATTRIBUTE_VALUE})*+"
    return rf"(?is)^[a-z0-9]++{skipped}[\s/]++{name}"


def has_attribute(tag: Column, name: str) -> Column:
    return tag.rlike(_before(name) + r"(?:[\s=/]|\z)")


def raw_attribute(tag: Column, name: str) -> Column:
    """Value of the first attribute of that name as it is written, '' when absent."""
    quoted = F.regexp_extract(
        tag, _before(name) + r"""\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'][^\s]*+)""", 1
    )
    return _let(
        quoted,
        lambda v: F.when(
            v.startswith('"') | v.startswith("'"), F.substring(v, F.lit(2), F.length(v) - F.lit(2))
        ).otherwise(v),
    )


def attribute(tag: Column, name: str) -> Column:
    """Decoded value of the first attribute of that name, '' when absent."""
    return _let(raw_attribute(tag, name), lambda v: decode_entities(v, in_attribute=True))


def _entity_table() -> str:
    """Characters by name, the common HTML 4 names first; C1 numbers are read
    as windows-1252, as browsers do, where that defines them."""
    table = {name: chr(code) for name, code in name2codepoint.items()}
    table.update({name.removesuffix(";"): chars for name, chars in html5.items()})
    for code in range(0x80, 0xA0):
        byte = bytes([code])
        table[f"#{code}"] = byte.decode("cp1252") if code not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(code)
    return _ENTRY.join(f"{name}{_VALUE}{chars}" for name, chars in table.items())


_ENTRY, _VALUE = "\x01", "\x02"  # no reference stands for these
_ENTITIES = _entity_table()
_NUMBER = r"^&#([0-9]+|[xX][0-9A-Fa-f]+)"
# Names that may stand without a semicolon, longest first.
_BARE_NAMES = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))


def _named_text(name: Column) -> Column:
    return F.try_element_at(F.str_to_map(F.lit(_ENTITIES), F.lit(_ENTRY), F.lit(_VALUE)), name)


def _numeric_text(number: Column) -> Column:
    """The character of a number with any count of leading zeros; one too large is replaced."""
    digits = F.regexp_replace(number, "^[xX]?0*", "")
    code = (
        F.when(F.length(digits) > 8, F.lit(0x110000))
        .when(digits == "", F.lit(0))
        .when(number.rlike("^[xX]"), F.conv(digits, 16, 10).try_cast("bigint"))
        .otherwise(digits.try_cast("bigint"))
    )
    return _let(code, lambda c: F.coalesce(_named_text(F.concat(F.lit("#"), c.cast("string"))), _character(c)))


def _character(code: Column) -> Column:
    bad = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    return F.when(bad, F.lit("\ufffd")).otherwise(
        F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    )


def decode_entities(text: Column, in_attribute: bool = False) -> Column:
    """Character references to characters; text without ``&`` is untouched.

    Some old names count without a semicolon too, and then as the longest
    prefix; in an attribute only if no letter, digit or ``=`` follows.
    """
    bare = rf"^&({_BARE_NAMES})" + (r"(?![A-Za-z0-9=])" if in_attribute else "")

    def replaced(p: Column, text: Column, consumed: Column) -> Column:
        rest = F.substring(p, consumed + 1, F.length(p))
        return F.concat(text, F.regexp_replace(rest, "^;", ""))

    def numeric(p: Column) -> Column:
        return _let(
            F.regexp_extract(p, _NUMBER, 1),
            lambda n: F.when(n == "", p).otherwise(replaced(p, _numeric_text(n), F.length(n) + 2)),
        )

    def named(p: Column) -> Column:
        def choose(names: Column) -> Column:
            text = _named_text(names.getField("closed"))
            return (
                F.when(text.isNotNull(), replaced(p, text, F.length(names.getField("closed")) + 1))
                .when(names.getField("bare") == "", p)
                .otherwise(replaced(p, _named_text(names.getField("bare")), F.length(names.getField("bare")) + 1))
            )

        found = F.struct(
            F.regexp_extract(p, r"^&([A-Za-z][A-Za-z0-9]{0,31});", 1).alias("closed"),
            F.regexp_extract(p, bare, 1).alias("bare"),
        )
        return _let(found, choose)

    def piece(p: Column) -> Column:
        return F.when(p.startswith("&#"), numeric(p)).when(p.startswith("&"), named(p)).otherwise(p)

    decoded = F.array_join(F.transform(F.split(text, "(?=&)"), piece), "")
    return F.when(text.contains("&"), decoded).otherwise(text)


def without_elements(html: Column, *names: str, replacement: str = "") -> Column:
    """Drop comments and the named elements with their content."""
    return F.regexp_replace(
        html, f"(?is){_COMMENT}|{_raw_text(names, 1)}(?:[^>]*+>)?+", replacement
    )


# Elements that start a new line of text.
BLOCK_ELEMENTS = (
    "address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr li main nav ol p pre section table td th tr ul"
).split()


def plain_text(html: Column) -> Column:
    """Text without tags: page furniture dropped, one line per paragraph,
    white space collapsed."""
    kept = without_elements(
        html, "script", "style", "noscript", "template", "iframe", "head", "nav", "header", "footer"
    )
    block = rf"(?i)^</?(?:{'|'.join(BLOCK_ELEMENTS)})[\s/>]"
    lines = F.transform(
        pieces(kept, raw_elements=False), lambda p: F.when(~is_markup(p), p).when(p.endswith(">") & p.rlike(block), F.lit("\n")).otherwise("")
    )
    text = decode_entities(F.array_join(lines, ""))
    text = F.regexp_replace(text, r"[ \t\r\f\x{A0}]+", " ")
    text = F.regexp_replace(text, r" ?\n[ \n]*", "\n")
    return F.regexp_replace(text, r"^[ \n]+|[ \n]+\z", "")


def cleaned_html(html: Column) -> Column:
    """Markup without scripts, styles, frames, page furniture and tracking
    attributes."""
    kept = without_elements(html, "script", "style", "noscript", "iframe", "nav", "footer", "aside")
    tracking = r"""(?is)\s(?:on[a-z]+|data-analytics-[a-z0-9\-]+)\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)"""
    parts = F.regexp_extract_all(kept, F.lit(rf"(?is)<[a-z]{_TAG_BODY}>|<[a-z].*+\z|[^<]++|<"), F.lit(0))
    start = lambda p: p.endswith(">") & p.rlike("^<[a-zA-Z]")
    clean = F.transform(parts, lambda p: F.when(start(p), F.regexp_replace(p, tracking, "")).otherwise(p))
    return F.array_join(clean, "")


def first_element_text(html: Column, name: str) -> Column:
    inner = F.regexp_extract(html, rf"(?is)<{name}(?=[\s/>])[^>]*+(?:>(.*?)(?:</{name}(?=[\s/>])|\z)|\z)", 1)
    return F.trim(F.regexp_replace(decode_entities(without_tags(inner)), r"\s+", " "))


def meta_entries(tags: Column) -> Column:
    """``struct(property, name, content)`` of every ``meta`` tag, read once."""
    metas = F.filter(tags, lambda t: t.rlike(r"(?i)^meta(?=[\s/])"))
    return F.transform(
        metas,
        lambda t: F.struct(
            attribute(t, "property").alias("property"),
            F.lower(attribute(t, "name")).alias("name"),
            attribute(t, "content").alias("content"),
        ),
    )


def meta_content(entries: Column, key: str) -> Column:
    """Content of the first entry whose property or name is ``key``, or NULL."""
    hits = F.filter(entries, lambda m: (m.property == key) | (m.getField("name") == key))
    return F.get(hits, F.lit(0)).getField("content")
