"""HTML to Markdown for one document: a small helper run in Arrow batches."""

from __future__ import annotations

import html as entities
import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Python workers get this module's code with the task, installed or not.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_TOKEN = re.compile(
    r"""(?is)<!--.*?(?:-->|\Z)|<[!?][^>]*>|(?P<raw><(?P<rawname>script|style|head|noscript|template|iframe|svg|textarea|select)"""
    r"""(?=[\s/>]).*?(?:</(?P=rawname)\s*>|\Z))|<(?P<close>/?)(?P<name>[a-z][a-z0-9]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*)>"""
)
_ATTR = re.compile(r"""(?is)([a-z\-:]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_BLOCKS = frozenset(
    "address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_WRAP = {"strong": "**", "b": "**", "em": "*", "i": "*", "del": "~~", "s": "~~", "strike": "~~"}
_SPACE = re.compile(r"\s+")
_SPECIAL = re.compile(r"([\\`*_\[\]])")
_BLOCK_START = re.compile(r"(?m)^(\s*)(#{1,6}(?=\s|$)|[-+>](?=\s)|\d+(?=[.)]\s))")


def _escape_start(text: str) -> str:
    def escaped(match: re.Match) -> str:
        lead, mark = match.groups()
        return f"{lead}{mark}\\" if mark.isdigit() else f"{lead}\\{mark}"

    return _BLOCK_START.sub(escaped, text)


def _wrapped(inner: str, mark: str) -> str:
    core = inner.strip()
    if not core:
        return inner
    lead = " " if inner[0].isspace() else ""
    tail = " " if inner[-1].isspace() else ""
    return f"{lead}{mark}{core}{mark}{tail}" if "\n\n" not in core else inner


def _tidy(text: str) -> str:
    text = re.sub(r"[ \t]*\n[ \t]*\n\s*?(?=\S|\Z)", "\n\n", text)
    return text.strip("\n ")


def _indent(text: str, first: str, rest: str) -> str:
    lines = text.split("\n")
    return "\n".join([first + lines[0], *[(rest + line) if line else line for line in lines[1:]]])


def _render(name: str, attrs: dict[str, str], pieces: list[str], parent: str, number: int) -> str:
    """Markdown of a closed element from the Markdown of its children."""
    inner = "".join(pieces)
    if name in _WRAP:
        return _wrapped(inner, _WRAP[name])
    if name == "a":
        label, href = _SPACE.sub(" ", inner).strip(), attrs.get("href", "")
        title = attrs.get("title", "").replace('"', '\\"')
        if not label or not href:
            return inner
        return f'[{label}]({href} "{title}")' if title else f"[{label}]({href})"
    if name in ("code", "kbd", "samp", "tt") and parent != "pre":
        fence = "``" if "`" in inner else "`"
        return f"{fence}{inner.strip()}{fence}" if inner.strip() else ""
    if name == "pre":
        body = inner.strip("\n")
        fence = "````" if "```" in body else "```"
        return f"\n\n{fence}\n{body}\n{fence}\n\n"
    if len(name) == 2 and name[0] == "h" and name[1] in "123456":
        title = _SPACE.sub(" ", inner).strip()
        return f"\n\n{'#' * int(name[1])} {title}\n\n" if title else ""
    if name == "li":
        marker = f"{number}. " if parent == "ol" else "- "
        return _indent(_tidy(inner), marker, " " * len(marker)) + "\n"
    if name in ("ul", "ol"):
        body = inner.strip("\n ")
        return f"\n{body}\n" if parent == "li" else f"\n\n{body}\n\n"
    if name == "blockquote":
        body = _tidy(inner)
        return "\n\n" + "\n".join(("> " + line).rstrip() for line in body.split("\n")) + "\n\n" if body else ""
    if name in ("td", "th"):
        return f"| {_SPACE.sub(' ', inner).strip()} "
    if name == "tr":
        row = inner.strip()
        rule = "\n|" + " --- |" * row.count("| ") if "th" in attrs else ""
        return f"\n{row} |{rule}" if row else ""
    if name in _BLOCKS:
        body = inner.strip()
        return f"\n\n{_escape_start(body) if name == 'p' else body}\n\n" if body else ""
    return inner


def to_markdown(document: str) -> str:
    """Headings, paragraphs, emphasis, links, images, code, quotes, lists and
    tables; white space is collapsed, blocks are one blank line apart."""
    stack: list[tuple[str, dict[str, str], list[str]]] = [("", {}, [])]
    counts: list[int] = [0]
    in_pre = 0

    def close_top() -> None:
        nonlocal in_pre
        name, attrs, pieces = stack.pop()
        counts.pop()
        in_pre -= name == "pre"
        parent, parent_attrs, target = stack[-1]
        if name == "li":
            counts[-1] += 1
        if name == "th":
            parent_attrs["th"] = "1"
        target.append(_render(name, attrs, pieces, parent, counts[-1]))

    def close_until(names, stop=()) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth][0] in names:
                while len(stack) > depth:
                    close_top()
                return
            if stack[depth][0] in stop:
                return

    def add_text(text: str) -> None:
        if not text:
            return
        text = entities.unescape(text)
        pieces = stack[-1][2]
        if in_pre:
            pieces.append(text)
            return
        text = _SPACE.sub(" ", text)
        if stack[-1][0] not in ("code", "kbd", "samp", "tt"):
            text = _SPECIAL.sub(r"\\\1", text)
        if text[0] == " " and pieces and pieces[-1][-1:] in (" ", "\n"):
            text = text[1:]
        if text:
            pieces.append(text)

    at = 0
    for token in _TOKEN.finditer(document):
        add_text(document[at : token.start()])
        at = token.end()
        name = token["name"]
        if not name:
            continue
        name = name.lower()
        if token["close"]:
            close_until((name,))
            continue
        if name == "br":
            stack[-1][2].append("\n" if in_pre else "  \n")
        elif name == "hr":
            close_until(("p",), _BLOCKS - {"p"})
            stack[-1][2].append("\n\n* * *\n\n")
        elif name == "img":
            attrs = _attributes(token["attrs"])
            if attrs.get("src"):
                stack[-1][2].append(f"![{attrs.get('alt', '')}]({attrs['src']})")
        elif name not in _VOID:
            if name in _BLOCKS:
                close_until(("p",), _BLOCKS - {"p"})
            if name == "li":
                close_until(("li",), ("ul", "ol"))
            elif name in ("td", "th", "tr"):
                close_until((name,) if name == "tr" else ("td", "th"), ("table",))
            stack.append((name, _attributes(token["attrs"]) if name == "a" else {}, []))
            counts.append(0)
            in_pre += name == "pre"
    add_text(document[at:])
    while len(stack) > 1:
        close_top()
    return _tidy("".join(stack[0][2]))


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for match in _ATTR.finditer(text):
        value = next((v for v in match.groups()[1:] if v is not None), "")
        found.setdefault(match[1].lower(), entities.unescape(value))
    return found


@F.pandas_udf(T.StringType())
def _markdown_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(to_markdown, na_action="ignore")


def markdown(html: Column) -> Column:
    return _markdown_batches(html)
