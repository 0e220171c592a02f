"""Markdown, text, metadata and the extended heuristics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.elements import main_text, only_elements, without_selected
from ..functions.urls import hostname
from ..operators.documents import detect_framework, domain_override, first_paragraph, host_profile, page_metadata, page_signals, page_texts
from ..operators.markdown import pages_to_markdown
from .inputs import SQL_IMAGES, SQL_MARKED, SQL_SHELL, illustrated_pages, marked_pages
from .registry import SQL_HOST, load, query

_ENTITIES = """replace(replace(replace(replace(replace({x}, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '&amp', '&')"""


def _decoded(x):
    return _ENTITIES.format(x=x)


_BODY = "regexp_replace(html, '(?s)<!--.*?-->|<head>.*?</head>|<script.*?</script>|<style.*?</style>|<noscript>.*?</noscript>', '', 'g')"
_VISIBLE = f"trim(regexp_replace({_decoded(f'''regexp_replace({_BODY}, '<[^>]*>', '', 'g')''')}, '\\s+', ' ', 'g'))"


@query(
    f"""SELECT page_id, len(regexp_extract_all(html, '<a href="[^"]*">[^<]', 0)) AS links, 1 AS headings,
  md5(regexp_replace({_decoded("regexp_replace(regexp_replace(" + _BODY + ", '<a href=\"([^\"]*)\">([^<]*)</a>', '\\2\\1', 'g'), '<[^>]*>', '', 'g')")}, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS letters_md5
FROM pages"""
)
def page_markdown(spark, folder):
    """Every page as Markdown. Compared by its headings, its links and all
    its letters and digits in order."""
    out = pages_to_markdown(load(spark, folder, "pages"))
    text = F.col("markdown")
    return out.select(
        "page_id",
        F.regexp_count(text, F.lit(r"\]\(/")).cast("bigint").alias("links"),
        F.regexp_count(text, F.lit(r"(?m)^# ")).alias("headings"),
        F.md5(F.regexp_replace(text, r"[^\p{L}\p{N}]", "").cast("binary")).alias("letters_md5"),
    )


@query(
    """SELECT page_id, 0 AS links,
  md5(regexp_replace(trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)), '[^a-zA-Z]', '', 'g')) AS title_md5 FROM pages"""
)
def page_markdown_article(spark, folder):
    """Only the article, without paragraphs."""
    out = pages_to_markdown(load(spark, folder, "pages"), exclude_tags=("p",), include_tags=("h1",))
    heading = F.regexp_replace(F.replace("markdown", F.lit("&"), F.lit("&amp;")), "[^a-zA-Z]", "")
    return out.select(
        "page_id",
        F.regexp_count("markdown", F.lit(r"\]\(")).alias("links"),
        F.md5(heading.cast("binary")).alias("title_md5"),
    )


@query(
    f"""WITH cut AS (
  SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->|<head>.*?</head>|<script.*?</script>|<style.*?</style>|<nav>.*?</nav>|<footer>.*?</footer>|<header>.*?</header>|<noscript>.*?</noscript>', '', 'g') AS h,
    regexp_replace(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>|<nav>.*?</nav>|<footer>.*?</footer>|<noscript>.*?</noscript>', '', 'g') AS c FROM pages),
lines AS (SELECT page_id, c, {_decoded("regexp_replace(regexp_replace(h, '</?(p|div|h1|article|ul|li)(>| [^>]*>)', chr(10), 'g'), '<[/!a-zA-Z][^>]*>', '', 'g')")} AS t FROM cut),
spaced AS (SELECT page_id, c, regexp_replace(regexp_replace(t, '[ \\t\\r\\f]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g') AS t FROM lines)
SELECT page_id, md5(regexp_replace(t, '^[ \\n]+|[ \\n]+$', '', 'g')) AS text_md5, md5(c) AS cleaned_md5 FROM spaced"""
)
def page_text(spark, folder):
    """Plain text and cleaned markup."""
    out = page_texts(load(spark, folder, "pages"))
    return out.select(
        "page_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.md5(F.col("cleaned").cast("binary")).alias("cleaned_md5")
    )


@query(
    f"""WITH {SQL_IMAGES.format(cap=10)}
SELECT p.page_id, nullif(trim(regexp_replace({_decoded("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}, '\\s+', ' ', 'g')), '') AS title,
  '/img/' || page_id || '.jpg' AS og_image, CASE WHEN page_id % 3 = 0 THEN 'card' || page_id || '.png' END AS twitter_image,
  'utf-8' AS charset, regexp_extract(html, '<html lang="([^"]*)">', 1) AS language, CAST(NULL AS VARCHAR) AS description,
  CAST(0 AS BIGINT) AS n_tags FROM pages p"""
)
def page_head(spark, folder):
    """Head fields."""
    out = page_metadata(illustrated_pages(spark, folder))
    return out.select(
        "page_id", "title", "og_image", "twitter_image", "charset", "language", "description", F.size("tags").cast("bigint").alias("n_tags")
    )


@query(
    """SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'docusaurus' WHEN page_id % 4 = 1 THEN 'nextjs' WHEN page_id % 4 = 2 THEN 'angular' END AS framework
FROM pages"""
)
def page_frameworks(spark, folder):
    """Framework from generator text or markup."""
    n = F.col("page_id") % 4
    generator = F.when(n == 0, "Docusaurus v2").when(n == 1, "Next.js 14")
    html = F.when(n == 2, F.concat(F.lit('<app-root ng-version="1">'), "html")).otherwise(F.col("html"))
    return load(spark, folder, "pages").select("page_id", detect_framework(html, generator).alias("framework"))


# Containers by hand: name, start of a page with its number put in for @, and the text of its main containers.
_CONTAINERS = (
    ("plain", "<main>A @</main>", "A @"),
    ("nested", '<div id="root"><div>in @</div> and <div><div>deep</div></div> out</div><div>after</div>', "in @ and deep out"),
    ("both", '<div id="app">a<main>b @</main></div>', "ab @b @"),
    ("once", '<main id="root"> x @ </main>', "x @"),
    ("script", '<MAIN>up &amp; @<script>"</main>"</script> on</MAIN>', "up & @ on"),
    ("none", "<section>@</section>", ""),
)
_SQL_CONTAINERS = ", ".join(
    "({}, '{}', '{}')".format(i, start.replace("'", "''"), text) for i, (_, start, text) in enumerate(_CONTAINERS)
)


def _contained(spark, folder):
    n = F.col("page_id")
    start = F.element_at(F.array(*[F.lit(s) for _, s, _ in _CONTAINERS]), (n % len(_CONTAINERS) + 1).cast("int"))
    return load(spark, folder, "pages").withColumn("html", F.concat(F.replace(start, F.lit("@"), n.cast("string")), "html"))


@query(
    f"""SELECT page_id, replace(text, '@', CAST(page_id AS VARCHAR)) AS main_text,
  md5(CASE page_id % 6 WHEN 1 THEN replace(start, '@', CAST(page_id AS VARCHAR))[:-length('<div>after</div>') - 1]
    WHEN 3 THEN replace(start, '@', CAST(page_id AS VARCHAR)) ELSE '' END) AS root_md5,
  md5(CASE page_id % 6 WHEN 1 THEN '<div>after</div>' WHEN 3 THEN '' ELSE replace(start, '@', CAST(page_id AS VARCHAR)) END || html) AS rest_md5
FROM pages JOIN (VALUES {_SQL_CONTAINERS}) c(i, start, text) ON page_id % 6 = i"""
)
def page_elements(spark, folder):
    """Main containers and a selected element, with nesting."""
    html = F.col("html")
    return _contained(spark, folder).select(
        "page_id",
        main_text(html).alias("main_text"),
        F.md5(only_elements(html, "#root").cast("binary")).alias("root_md5"),
        F.md5(without_selected(html, "#root").cast("binary")).alias("rest_md5"),
    )


# Scripts and containers put at the end of the article of some pages.
_SCRIPTS = (
    "<script>axios.get(a); fetch(b)</script>",
    "<script>window.__INITIAL_STATE__ = 1</script>",
    '<div id="app"><p>' + "long " * 30 + "</p></div>",
    '<div id="app"><div>short</div></div>',
)
_SQL_SCRIPTED = "scripted AS (SELECT page_id, url, replace(html, '</article>', CASE page_id % 10 " + " ".join(
    f"WHEN {i + 1} THEN '{s}'" for i, s in enumerate(_SCRIPTS)
) + " ELSE '' END || '</article>') AS html FROM marked)"


def _scripted(pages):
    more = F.element_at(F.array(F.lit(""), *[F.lit(s) for s in _SCRIPTS], *[F.lit("")] * (9 - len(_SCRIPTS))), (F.col("page_id") % 10 + 1).cast("int"))
    return pages.withColumn("html", F.replace("html", F.lit("</article>"), F.concat(more, F.lit("</article>"))))


@query(
    f"""WITH {SQL_MARKED}, {_SQL_SCRIPTED}, read AS (
  SELECT page_id, url, html, {_VISIBLE} AS text, len(regexp_extract_all(html, '(?i)<script[\\s/>]')) AS scripts,
    len(regexp_extract_all(html, '<[a-zA-Z]')) AS elements, len(regexp_extract_all(html, '(?i)<a[\\s/>]')) AS links FROM scripted),
signals AS (
  SELECT *, octet_length(encode(html)) < 4096 AS small, length(text) < 0.02 * length(html) AS low_density, length(text) < 400 AS short_text,
    contains(html, 'id="root"') OR contains(html, 'id="app"') AS root_marker, scripts * 4 > elements AS script_heavy,
    NOT regexp_matches(html, '(?i)<(main|article)[\\s/>]') AS no_main, links * 2 > elements AND length(text) < 400 AS link_shell,
    contains(html, '__INITIAL_STATE__') AS ssr FROM read),
scored AS (
  SELECT *, small::INT + low_density::INT + short_text::INT + root_marker::INT + script_heavy::INT + no_main::INT + link_shell::INT + ssr::INT AS score FROM signals)
SELECT page_id, score, CASE WHEN score >= 3 THEN 'dynamic' WHEN score = 2 THEN 'retry' ELSE 'static' END AS decision,
  CAST(length(text) AS BIGINT) AS text_length, contains(lower(html), '<noscript>') AND contains(lower(html), 'enable javascript') AS noscript_ext,
  contains(html, 'id="root"') OR contains(html, '__INITIAL_STATE__') OR contains(html, 'id="app"') AND (octet_length(encode(html)) < 5000 OR page_id % 10 = 4) AS shell_ext,
  octet_length(encode(html)) < 2000 AND contains(lower(html), '<script') AND length(text) < 200 AS tiny_ext,
  contains(html, 'axios.get') AS ajax_heavy, {SQL_SHELL} AS needs_dynamic FROM scored"""
)
def page_scores(spark, folder):
    """Extended and scored heuristics."""
    out = page_signals(_scripted(marked_pages(spark, folder)))
    return out.select(
        "page_id", "score", "decision", F.col("text_length").cast("bigint").alias("text_length"),
        "noscript_ext", "shell_ext", "tiny_ext", "ajax_heavy", "needs_dynamic",
    )


@query(
    f"""WITH {SQL_MARKED}, named AS (
  SELECT page_id, html, CASE WHEN page_id % 6 = 0 THEN 'm.twitter.com' WHEN page_id % 6 = 1 THEN 'github.com' WHEN page_id % 6 = 2 THEN 'nottwitter.com'
    ELSE replace({SQL_HOST}, 'example', 'sample') END AS host FROM marked)
SELECT page_id, CASE WHEN page_id % 6 = 0 THEN TRUE WHEN page_id % 6 = 1 THEN FALSE ELSE {SQL_SHELL} END AS needs_dynamic FROM named"""
)
def site_overrides(spark, folder):
    """Known sites settle the mode."""
    from ..functions.predicates import needs_dynamic

    n = F.col("page_id") % 6
    host = (
        F.when(n == 0, "m.twitter.com").when(n == 1, "github.com").when(n == 2, "nottwitter.com")
        .otherwise(F.replace(hostname(F.col("url")), F.lit("example"), F.lit("sample")))
    )
    return marked_pages(spark, folder).select("page_id", domain_override(host, needs_dynamic(F.col("html"))).alias("needs_dynamic"))


@query(
    f"""WITH {SQL_MARKED}, read AS (
  SELECT {SQL_HOST} AS host, {SQL_SHELL} AS dynamic, length({_VISIBLE}) AS n FROM marked),
sums AS (
  SELECT host, count(*) AS pages, count(*) FILTER (dynamic) AS dynamic_pages, count(*) FILTER (n = 0) AS empty_pages,
    count(*) FILTER (n < 100) AS short_pages FROM read GROUP BY 1)
SELECT *, dynamic_pages * 10 > pages * 3 AS alert_dynamic, empty_pages * 10 > pages AS alert_empty FROM sums"""
)
def host_profiles(spark, folder):
    """Per host shares and alerts."""
    return host_profile(marked_pages(spark, folder))


@query(
    """SELECT page_id, left(trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?s)<article><h1>[^<]*</h1><p>(.*?)(?:<p>|</p>|</article>)', 1), '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;', '&'), '&amp', '&'), '\\s+', ' ', 'g')), 200) AS summary
FROM pages"""
)
def summaries(spark, folder):
    """First paragraph with text, cut to 200 characters."""
    return first_paragraph(load(spark, folder, "pages"))
