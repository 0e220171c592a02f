"""URL expressions (RFC 3986 reading and resolving, percent-encoding).

``parse_url`` throws on spaces and loses underscore hosts, so the parts are
taken with regular expressions. Long forms are built with ``_let``, which
binds a value to a lambda variable so it is computed once; the usual URL takes
a short branch before any of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reuse import reuse

SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*:"
_PCT = r"%[0-9A-Fa-f]{2}"
_CTL = r"\x00-\x1F\x7F"
_PATH_SAFE = r"A-Za-z0-9\-_.~!$&'()*+,;=:@\[\]/"
_HOST = r"A-Za-z0-9\-_.~!$&'()*+,;=\[\]<>\"\x{80}-\x{10FFFF}"
_HOST_RUN = rf"(?:[{_HOST}]|%25|%[89A-Fa-f][0-9A-Fa-f])"

# A reference that can be parsed at all: no control characters, whole percent
# escapes outside the query, digits as port, no colon in a first relative
# segment, only host characters in the host.
_PARSABLE = (
    rf"^(?:{SCHEME}(?!/)[^#{_CTL}]*"
    rf"|(?:(?:{SCHEME})?//|(?=//)(?!///)//)"
    rf"(?:(?:[A-Za-z0-9\-._:~!$&'()*+,;=@]|{_PCT})*@)?"
    rf"(?:\[[^\]/?#{_CTL}]*\](?::[0-9]*)?|(?:(?:{_HOST_RUN}|:)*:[0-9]*|{_HOST_RUN}*))"
    rf"(?:/(?:[^%?#{_CTL}]|{_PCT})*+)?(?:\?[^#{_CTL}]*)?"
    rf"|(?:{SCHEME})?/(?!/(?!/))(?:[^%?#{_CTL}]|{_PCT})*+(?:\?[^#{_CTL}]*)?"
    rf"|(?![^/?#]*:)(?:[^%?#{_CTL}/]|{_PCT})(?:[^%?#{_CTL}]|{_PCT})*+(?:\?[^#{_CTL}]*)?"
    rf"|(?:\?[^#{_CTL}]*)?"
    rf")(?:#(?:[^%{_CTL}]|{_PCT})*+)?\z"
)

# The usual absolute URL: parsing and re-serialising it changes nothing but the
# fragment.
_PLAIN_ABSOLUTE = (
    r"^[a-z][a-z0-9+.\-]*://[A-Za-z0-9.\-_]+(?::[0-9]*)?"
    rf"(?:/(?:[{_PATH_SAFE}]|{_PCT})*+)?(?:\?[^#{_CTL}]*)?(?:#(?:[^%{_CTL}]|{_PCT})*+)?\z"
)
# The usual root-relative link: safe characters, no dot segment, no query.
_PLAIN_ROOTED = rf"^/(?!/)(?!.*/\.)(?!\.)(?:[{_PATH_SAFE}]|{_PCT})*+\z"

_SAFE_PATH = rf"^(?:[{_PATH_SAFE}]|{_PCT})*+\z"

# Characters a path keeps unescaped although url_encode escapes
# them (escape, character).
_PATH_KEPT = (
    ("%24", "$"),
    ("%26", "&"),
    ("%2B", "+"),
    ("%2C", ","),
    ("%2F", "/"),
    ("%3A", ":"),
    ("%3B", ";"),
    ("%3D", "="),
    ("%40", "@"),
    ("%7E", "~"),
)
_KEPT_ESCAPE = r"^%(?:2[46BCDEF]|3[0-9ABD]|4[0-9A-F]|5[0-9AF]|6[1-9A-F]|7[0-9AE])\z"

# Extensions of links that are not pages.
RESOURCE_EXTENSIONS = (
    ".pdf .jpg .jpeg .png .gif .svg .webp .ico .mp4 .mp3 .avi .mov .zip .tar .gz .rar "
    ".css .js .woff .woff2 .ttf .eot .xml .rss .json .txt"
).split()

# Link prefixes that are never followed.
SKIPPED_HREF_PREFIXES = ("mailto:", "tel:", "javascript:", "#")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_parsable_url(url: Column) -> Column:
    open_bracket = rf"^(?:{SCHEME})?//(?:[^/?#]*@)?\[[^\]/?#]*(?:[/?#]|\z)"
    return url.rlike(_PARSABLE) & ~url.rlike(open_bracket)


def url_scheme(url: Column) -> Column:
    """Lower-case scheme with its colon, or ''."""
    return F.lower(F.regexp_extract(url, rf"^({SCHEME})", 1))


def url_authority(url: Column) -> Column:
    """``//user@host:port`` as written, or ''."""
    return F.regexp_extract(url, rf"^(?:{SCHEME})?(//[^/?#]*)", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, rf"^(?:{SCHEME})?(?://[^/?#]*)?([^?#]*)", 1)


def url_query(url: Column) -> Column:
    """Query with its question mark, or ''."""
    return F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)


def hostname(url: Column) -> Column:
    """Host without port, user and brackets; '' when there is none."""
    host = F.regexp_extract(
        url, rf"^(?:{SCHEME})?//(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#]*?)(?::[0-9]*)?(?:[/?#]|\z)", 1
    )
    bare = F.regexp_replace(host, r"^\[|\]\z", "")
    decoded = F.when(
        bare.contains("%"), F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)
    ).otherwise(bare)
    return F.when(is_parsable_url(url), decoded).otherwise(F.lit(""))


def strip_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"#(?s:.*)\z", "")


def _encode_run(text: Column) -> Column:
    """Percent-encode a run that holds no escapes of its own."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    out = F.replace(out, F.lit("*"), F.lit("%2A"))
    for escape, char in _PATH_KEPT:
        out = F.replace(out, F.lit(escape), F.lit(char))
    return out


def _encode_piece(piece: Column) -> Column:
    """One piece that may begin with an escape: ``%41bc`` -> ``Abc``."""
    escape = F.upper(F.substring(piece, 1, 3))
    kept = F.decode(F.unhex(F.substring(piece, 2, 2)), "ISO-8859-1")
    return F.when(
        piece.startswith("%"),
        F.concat(F.when(escape.rlike(_KEPT_ESCAPE), kept).otherwise(escape), _encode_run(F.substring(piece, 4, 1 << 30))),
    ).otherwise(_encode_run(piece))


def escape_path(path: Column) -> Column:
    """The path as it is re-serialised: kept when every character is allowed,
    else decoded and escaped anew as a whole."""
    pieces = F.transform(F.split(path, "(?=%)"), _encode_piece)
    return (
        F.when(path.rlike(_SAFE_PATH), path)
        .when(~path.contains("%"), _encode_run(path))
        .otherwise(F.array_join(pieces, ""))
    )


def remove_dot_segments(path: Column) -> Column:
    """RFC 3986 5.2.4 as a push/pop fold; result always starts with one '/'."""
    segments = F.split(path, "/")

    def step(stack: Column, segment: Column) -> Column:
        return (
            F.when(segment == ".", F.when(F.size(stack) == 0, F.array(F.lit(""))).otherwise(stack))
            .when(segment == "..", F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0))))
            .otherwise(F.array_append(stack, segment))
        )

    folded = F.array_join(F.aggregate(segments, F.array().cast("array<string>"), step), "/")
    tail = F.when(path.rlike(r"(?:^|/)\.\.?\z"), F.lit("/")).otherwise(F.lit(""))
    joined = F.regexp_replace(F.concat(F.lit("/"), folded, tail), "^//", "/")
    rooted = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return (
        F.when(path == "", path)
        .when(~path.rlike(r"(?:^|/)\.\.?(?:/|\z)"), rooted)
        .otherwise(joined)
    )


def _escape_authority(authority: Column) -> Column:
    """Non-ASCII host characters become escapes; the rest stays."""
    chars = F.transform(
        F.split(authority, ""), lambda c: F.when(c.rlike(r"[^\x00-\x7F]"), F.url_encode(c)).otherwise(c)
    )
    return F.when(authority.rlike(r"[^\x00-\x7F]"), F.array_join(chars, "")).otherwise(authority)


def canonical_url(url: Column) -> Column:
    """Parse, drop the fragment and write the URL back; unparsable text is
    returned as it is."""
    opaque = url.rlike(rf"^{SCHEME}(?!/)")
    rewritten = F.concat(
        url_scheme(url),
        F.when(opaque, F.lit("")).otherwise(_escape_authority(url_authority(url))),
        F.when(opaque, url_path(url)).otherwise(_let(url_path(url), escape_path)),
        url_query(url),
    )
    return (
        F.when(url.rlike(_PLAIN_ABSOLUTE), strip_fragment(url))
        .when(~is_parsable_url(url), url)
        .otherwise(rewritten)
    )


def normalize_url(url: Column) -> Column:
    """Key of a page: canonical form without any trailing slashes."""
    out = _let(
        canonical_url(url), lambda u: F.when(F.length(u) > 1, F.regexp_replace(u, r"/+\z", "")).otherwise(u)
    )
    return F.when(
        url.rlike(_PLAIN_ABSOLUTE), F.regexp_replace(strip_fragment(url), r"/+\z", "")
    ).when(~is_parsable_url(url), url).otherwise(out)


@reuse
def key_of(name: str) -> Column:
    """``normalize_url`` of a named column."""
    return normalize_url(F.col(name))


@reuse
def base_of(name: str) -> Column:
    """``base_parts`` of a named column."""
    return base_parts(F.col(name))


@reuse
def host_of(name: str) -> Column:
    """``hostname`` of a named column."""
    return hostname(F.col(name))


def base_parts(base: Column) -> Column:
    """What resolving needs of the page's own URL, computed once per page.

    Bound with ``_let`` because the optimizer copies the fields of a plain
    struct into every lambda that reads them.
    """
    parts = F.struct(
        url_scheme(base).alias("scheme"),
        _escape_authority(url_authority(base)).alias("authority"),
        _let(url_path(base), escape_path).alias("path"),
        url_query(base).alias("query"),
        is_parsable_url(base).alias("ok"),
    )
    return _let(parts, lambda p: p)


def explode_positions(df: DataFrame, keys: list[str], array: str, value: str) -> DataFrame:
    """``keys, pos, value`` per element. The outer form keeps the optimizer
    from computing the array again in a not-empty filter below it."""
    rows = df.select(*keys, F.posexplode_outer(array).alias("pos", value))
    return rows.filter(F.col("pos").isNotNull())


def resolve_with_parts(parts: Column, href: Column, keep_fragment: bool = False) -> Column:
    """Resolve ``href`` against ``base_parts``; NULL when either is unparsable."""
    b_scheme, b_authority = parts.getField("scheme"), parts.getField("authority")
    b_path, b_query = parts.getField("path"), parts.getField("query")

    def assemble(path: Column) -> Column:
        scheme, authority, query = url_scheme(href), url_authority(href), url_query(href)
        own = (scheme != "") | (authority != "")
        target = (
            F.when(own | path.startswith("/"), path)
            .when(path == "", b_path)
            .otherwise(F.concat(F.regexp_extract(b_path, r"^(.*/)", 1), path))
        )
        return F.concat(
            F.when(scheme != "", scheme).otherwise(b_scheme),
            F.when(own, _escape_authority(authority)).otherwise(b_authority),
            _let(target, remove_dot_segments),
            F.when(own | (path != "") | (query != ""), query).otherwise(b_query),
        )

    opaque = href.rlike(rf"^{SCHEME}(?!/)")
    fragment = F.regexp_extract(href, r"(#(?s:.+))\z", 1) if keep_fragment else F.lit("")
    return (
        F.when(~parts.getField("ok"), F.lit(None).cast("string"))
        .when(href.rlike(_PLAIN_ROOTED) & (b_authority != ""), F.concat(b_scheme, b_authority, href))
        .when(~is_parsable_url(href), F.lit(None).cast("string"))
        .when(opaque, F.concat(url_scheme(href), url_path(href), url_query(href), fragment))
        .otherwise(F.concat(_let(_let(url_path(href), escape_path), assemble), fragment))
    )


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute URL of ``href`` on page ``base``, without fragment."""
    return _let(base_parts(base), lambda parts: resolve_with_parts(parts, href))


def resolve_image_url(raw: Column, page: Column) -> Column:
    """Image address on a page: ``data:`` and unparsable give '', an absolute
    address is kept verbatim."""
    return _let(base_parts(page), lambda parts: image_url_with_parts(parts, raw))


def image_url_with_parts(parts: Column, raw: Column) -> Column:
    return (
        F.when(raw.startswith("data:") | ~is_parsable_url(raw), F.lit(""))
        .when(raw.rlike(rf"^{SCHEME}"), raw)
        .otherwise(F.coalesce(resolve_with_parts(parts, raw, keep_fragment=True), F.lit("")))
    )


def path_extension(path: Column) -> Column:
    """Lower-case suffix from the last dot of the last segment, or ''."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)\z", 1))


def is_resource_file(path: Column) -> Column:
    return path_extension(path).isin(*RESOURCE_EXTENSIONS)


def is_skipped_href(href: Column) -> Column:
    skip = href == ""
    for prefix in SKIPPED_HREF_PREFIXES:
        skip = skip | href.startswith(prefix)
    return skip
