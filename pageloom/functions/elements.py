"""Elements of a page as spans of its pieces, found by running depth.

A start tag opens an element of its name, further start tags of that name nest
in it and its span ends with the end tag that brings the depth back to zero.
Only tags of wanted names are walked, once each; texts are cut by slices, so a
page costs in proportion to its length.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .html import RAW_TEXT_ELEMENTS, decode_entities, is_markup, pieces, raw_attribute, without_tags
from .urls import _let

# Elements without content, and those that a start tag of the same name ends.
VOID_ELEMENTS = "area base br col embed hr img input link meta source track wbr".split()
NOT_NESTING = "p a button option h1 h2 h3 h4 h5 h6".split()
# Where an application puts its page.
MAIN_SELECTORS = ("main", "#root", "#app", "#__next")

_SPANS = "array<struct<first:int,last:int>>"
#: Tags that are walked before their spans join those before.
CHUNK = 256


def _selected(piece: Column, name: Column, selectors: tuple[str, ...]) -> Column:
    """Whether a start tag is one of ``name``, ``#id`` or ``.class``."""
    names = [s.lower() for s in selectors if s[0] not in "#."]
    ids = [s[1:] for s in selectors if s[0] == "#"]
    classes = [s[1:] for s in selectors if s[0] == "."]
    tag = F.regexp_extract(piece, r"(?s)^<([^>]*+)", 1)
    tests = []
    if names:
        tests.append(name.isin(names))
    # the value is looked for only in tags that hold it
    if ids:
        tests.append(F.when(_holds(piece, ids), raw_attribute(tag, "id").isin(ids)).otherwise(F.lit(False)))
    if classes:
        listed = F.split(raw_attribute(tag, "class"), r"\s+")
        overlap = F.arrays_overlap(listed, F.array(*[F.lit(c) for c in classes]))
        tests.append(F.when(_holds(piece, classes), overlap).otherwise(F.lit(False)))
    return reduce(or_, tests)


def _holds(piece: Column, words: list[str]) -> Column:
    return reduce(or_, [piece.contains(word) for word in words])


def _tags(parts: Column) -> Column:
    """Start and end tags of a page: ``struct(at, piece, name, step)`` with step 1,
    -1 or 0 for an element that is one piece."""
    markup = F.filter(
        F.transform(parts, lambda p, at: F.struct(at.cast("int").alias("at"), p.alias("piece"))),
        lambda t: t.piece.rlike("^</?[a-zA-Z]"),
    )

    def tag(t: Column) -> Column:
        return _let(
            F.lower(F.regexp_extract(t.piece, r"^</?([a-zA-Z][^\s/>]*)", 1)),
            lambda name: F.struct(
                t.at.alias("at"),
                t.piece.alias("piece"),
                name.alias("name"),
                F.when(t.piece.startswith("</"), F.lit(-1))
                .when(name.isin(*RAW_TEXT_ELEMENTS, *VOID_ELEMENTS), F.lit(0))
                .otherwise(F.lit(1))
                .alias("step"),
            ),
        )

    return F.transform(markup, tag)


def _relevant(tags: Column, selectors: tuple[str, ...]) -> Column:
    """``struct(at, name, step, hit)`` of the tags that may open, nest in or end a
    selected element: those of the names that selected elements have."""

    def judged(t: Column) -> Column:
        hit = F.when(t.step >= 0, _selected(t.piece, t.getField("name"), selectors)).otherwise(F.lit(False))
        return F.struct(t.at.alias("at"), t.getField("name").alias("name"), t.step.alias("step"), hit.alias("hit"))

    def of_selected_names(found: Column) -> Column:
        names = F.array_distinct(F.transform(F.filter(found, lambda t: t.hit), lambda t: t.getField("name")))
        return _let(names, lambda wanted: F.filter(found, lambda t: F.array_contains(wanted, t.getField("name"))))

    return _let(F.transform(tags, judged), of_selected_names)


def _state(name: Column, depth: Column, first: Column, spans: Column) -> Column:
    return F.struct(name.alias("name"), depth.alias("depth"), first.alias("first"), spans.alias("spans"))


def _span(first: Column, last: Column) -> Column:
    return F.struct(first.alias("first"), last.alias("last"))


def _step(s: Column, t: Column) -> Column:
    """The state after a tag: which element is open, how deep, and the spans so far."""
    name, nobody = s.getField("name"), F.lit("")
    zero = F.lit(0)
    whole = F.array_append(s.spans, _span(t.at, t.at))
    ended = F.array_append(s.spans, _span(s.first, t.at))
    until = F.array_append(s.spans, _span(s.first, t.at - 1))
    outside = (
        F.when(~t.hit, s)
        .when(t.step == 0, _state(nobody, zero, zero, whole))
        .otherwise(_state(t.getField("name"), F.lit(1), t.at, s.spans))
    )
    replaced = F.when(t.hit, _state(t.getField("name"), F.lit(1), t.at, until)).otherwise(_state(nobody, zero, zero, until))
    return (
        F.when(s.depth == 0, outside)
        .when((t.getField("name") != name) | (t.step == 0), s)
        .when((t.step == 1) & t.getField("name").isin(NOT_NESTING), replaced)
        .when(s.depth + t.step == 0, _state(nobody, zero, zero, ended))
        .otherwise(_state(name, s.depth + t.step, s.first, s.spans))
    )


def element_spans(parts: Column, selectors: tuple[str, ...]) -> Column:
    """``spans_of_tags`` of the ``pieces`` of a page."""
    return spans_of_tags(_tags(parts), F.size(parts) - 1, selectors)


def spans_of_tags(tags: Column, last: Column, selectors: tuple[str, ...]) -> Column:
    """Spans ``struct(first, last)`` of the outermost selected elements, places
    counted from 0. An element that is never ended reaches to the ``last`` piece."""
    none = F.array().cast(_SPANS)

    def walk(s: Column, tags: Column) -> Column:
        # a chunk keeps spans of its own, as each step copies what it adds to
        start = _state(s.getField("name"), s.depth, s.first, none)
        return _let(
            F.aggregate(tags, start, _step),
            lambda r: _state(r.getField("name"), r.depth, r.first, F.concat(s.spans, r.spans)),
        )

    def chunks(tags: Column) -> Column:
        starts = F.when(F.size(tags) > 0, F.sequence(F.lit(0), F.size(tags) - 1, F.lit(CHUNK)))
        return F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda i: F.slice(tags, i + 1, F.lit(CHUNK)))

    nothing = _state(F.lit(""), F.lit(0), F.lit(0), none)
    finish = lambda s: F.when(s.depth > 0, F.array_append(s.spans, _span(s.first, last))).otherwise(s.spans)
    return F.aggregate(_let(_relevant(tags, selectors), chunks), nothing, walk, finish)


def _slice(parts: Column, first: Column, last: Column) -> Column:
    return F.slice(parts, first + 1, F.greatest(last - first + 1, F.lit(0)))


def only_elements(html: Column, *selectors: str) -> Column:
    """The markup of the outermost selected elements, one below the other."""

    def cut(parts: Column) -> Column:
        spans = element_spans(parts, selectors)
        return F.array_join(F.transform(spans, lambda s: F.array_join(_slice(parts, s.first, s.last), "")), "\n")

    return F.when(html.isNotNull(), _let(pieces(html), cut))


def without_selected(html: Column, *selectors: str) -> Column:
    """The markup without the selected elements and what they hold."""

    def cut(parts: Column) -> Column:
        def keep(spans: Column) -> Column:
            # what lies before each span, and behind the last
            ends = F.concat(F.array(F.lit(-1)), F.transform(spans, lambda s: s.last))
            starts = F.concat(F.transform(spans, lambda s: s.first), F.array(F.size(parts)))
            gaps = F.zip_with(ends, starts, lambda e, s: F.array_join(_slice(parts, e + 1, s - 1), ""))
            return F.array_join(gaps, "")

        return _let(element_spans(parts, selectors), keep)

    return F.when(html.isNotNull(), _let(pieces(html), cut))


def main_text(html: Column, selectors: tuple[str, ...] = MAIN_SELECTORS) -> Column:
    """Text of the page's main containers in page order, each with what is nested in it; an
    element that several selectors name counts once."""

    def text(piece: Column) -> Column:
        inner = piece.rlike(rf"(?i)^<(?:{'|'.join(n for n in RAW_TEXT_ELEMENTS if n not in ('script', 'style'))})[\s/>]")
        return F.when(~is_markup(piece), piece).when(inner, without_tags(piece)).otherwise("")

    def read(parts: Column) -> Column:
        def spans(tags: Column) -> Column:
            # as numbers, which are told apart by hash
            return F.concat(
                *[
                    F.transform(spans_of_tags(tags, F.size(parts) - 1, (s,)), lambda x: F.shiftleft(x.first.cast("bigint"), 32) + x.last)
                    for s in selectors
                ]
            )

        found = F.array_sort(F.array_distinct(_let(_tags(parts), spans)))
        ends = lambda x: (F.shiftright(x, 32).cast("int"), (x % F.lit(1 << 32)).cast("int"))
        held = F.transform(found, lambda x: F.array_join(F.transform(_slice(parts, *ends(x)), text), ""))
        return F.regexp_replace(decode_entities(F.array_join(held, "")), r"^\s+|\s+\z", "")

    return F.when(html.isNotNull(), _let(pieces(html), read))
