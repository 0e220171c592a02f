"""URLs, links, page flags."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import predicates, urls
from ..operators.links import extract_links, link_details
from ..operators.pages import lookup_pages, page_index, with_page_key
from ..operators.search import page_of, ranked
from ..sources.snapshots import read_snapshots
from .inputs import SQL_MARKED, SQL_SHELL, marked_pages
from .registry import SQL_HOST, SQL_KEY, load, query

_ORIGIN = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"
_CLEAN = (
    "regexp_replace(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>|<title.*?</title>', '', 'g')"
)
_ENCODED = "replace(replace(url_encode(href), '%2F', '/'), '%2C', ',')"

SQL_LINKS = f"""
WITH tags AS (
  SELECT page_id, {_ORIGIN} AS origin, {SQL_KEY} AS page_key,
    regexp_extract_all({_CLEAN}, '<a href="([^"]*)">', 1) AS hrefs FROM pages),
flat AS (
  SELECT page_id, origin, page_key, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) AS ord FROM tags),
resolved AS (
  SELECT page_id, page_key, ord, origin || {_ENCODED} AS link FROM flat
  WHERE href LIKE '/%' AND NOT regexp_matches(lower(href), '\\.(pdf|jpe?g|png|gif|svg|webp|ico|mp[34]|avi|mov|zip|tar|gz|rar|css|js|woff2?|ttf|eot|xml|rss|json|txt)$')),
firsts AS (SELECT page_id, page_key, link, min(ord) AS ord FROM resolved GROUP BY ALL)
SELECT page_id, page_key, CAST(row_number() OVER (PARTITION BY page_id ORDER BY ord) - 1 AS BIGINT) AS pos,
  link, rtrim(link, '/') AS link_norm
FROM firsts"""


@query(SQL_LINKS)
def link_table(spark, folder):
    """Followable links of every page."""
    links = extract_links(load(spark, folder, "pages"))
    return links.withColumn("pos", F.col("pos").cast("bigint"))


@query(
    f"""SELECT page_id, {SQL_KEY} AS page_key, {SQL_HOST} AS host, regexp_replace(url, '#.*$', '') AS bare,
  regexp_extract(lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '(\\.[^./]*)$', 1) AS extension,
  regexp_matches(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '\\.(xml|json|txt)$') AS is_resource
FROM pages"""
)
def url_parts(spark, folder):
    """U1, U4, U5, U7, F2 on page URLs."""
    path = urls.url_path(F.col("url"))
    return load(spark, folder, "pages").select(
        "page_id",
        urls.normalize_url(F.col("url")).alias("page_key"),
        urls.hostname(F.col("url")).alias("host"),
        urls.strip_fragment(F.col("url")).alias("bare"),
        urls.path_extension(path).alias("extension"),
        urls.is_resource_file(path).alias("is_resource"),
    )


_FORMS = (
    ("sibling x", "{dir}sibling%20x"),
    ("./cur/../other/", "{dir}other/"),
    ("../up?q=1#f", "{parent}up?q=1"),
    ("../../../../top", "{origin}/top"),
    ("..", "{parent}"),
    (".", "{dir}"),
    ("?only=q", "{page}?only=q"),
    ("#frag", "{self}"),
    ("//cdn.example.com/a/./b/../c", "{scheme}://cdn.example.com/a/c"),
    ("HTTPS://Host.example/q%20r/%C3%BC", "https://Host.example/q%20r/%C3%BC"),
    ("/abs/für,x.html", "{origin}/abs/f%C3%BCr,x.html"),
    ("mailto:a@b.c", "mailto:a@b.c"),
    ("/bad%zz", None),
    ("a:b/c", "a:b/c"),
)


def _form_sql(result):
    if result is None:
        return "CAST(NULL AS VARCHAR)"
    pieces = {
        "{dir}": "dir", "{parent}": "parent", "{origin}": "origin", "{page}": "page", "{self}": "self", "{scheme}": "scheme"
    }
    for mark, column in pieces.items():
        if result.startswith(mark):
            return f"{column} || '{result[len(mark):]}'"
    return f"'{result}'"


_FORM_ROWS = " UNION ALL ".join(
    f"SELECT page_id, '{href}' AS href, {_form_sql(result)} AS resolved FROM parts" for href, result in _FORMS
)


@query(
    f"""WITH cut AS (
  SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS scheme, {_ORIGIN} AS origin,
    regexp_replace(url, '#.*$', '') AS self, regexp_replace(url, '[?#].*$', '') AS page FROM pages),
dirs AS (SELECT *, regexp_extract(page, '^(.*/)', 1) AS dir FROM cut),
parts AS (
  SELECT *, CASE WHEN dir = origin || '/' THEN dir ELSE regexp_replace(dir, '[^/]+/$', '') END AS parent FROM dirs)
{_FORM_ROWS}"""
)
def url_resolution(spark, folder):
    """Every form of reference resolved on every page."""
    forms = F.array(*[F.lit(href) for href, _ in _FORMS])
    pages = load(spark, folder, "pages").select("page_id", urls.base_parts(F.col("url")).alias("base"))
    rows = pages.select("page_id", "base", F.explode(forms).alias("href"))
    return rows.select("page_id", "href", urls.resolve_with_parts(F.col("base"), F.col("href")).alias("resolved"))


@query(
    f"""WITH {SQL_MARKED}
SELECT page_id, html <> '' AND contains(lower(html), '<noscript>') AND contains(lower(html), 'enable javascript') AS asks,
  octet_length(encode(html)) < 5000 AND contains(html, 'id="root"') AS shell,
  octet_length(encode(html)) < 2000 AND contains(lower(html), '<script') AS tiny, {SQL_SHELL} AS needs_dynamic
FROM marked"""
)
def dynamic_pages(spark, folder):
    """F1, F1a, F1b, F1c."""
    html = F.col("html")
    return marked_pages(spark, folder).select(
        "page_id",
        predicates.asks_for_javascript(html).alias("asks"),
        predicates.is_app_shell(html).alias("shell"),
        predicates.is_tiny_script_page(html).alias("tiny"),
        predicates.needs_dynamic(html).alias("needs_dynamic"),
    )


@query(
    f"""WITH {SQL_MARKED}, keyed AS (
  SELECT {SQL_KEY} AS page_key, page_id, html, row_number() OVER (PARTITION BY {SQL_KEY} ORDER BY page_id) AS rn FROM marked)
SELECT page_key, page_id AS static_id, CASE WHEN html = '' THEN 'empty response' END AS static_error, {SQL_SHELL} AS needs_dynamic
FROM keyed WHERE rn = 1"""
)
def page_index_table(spark, folder):
    """Narrow index of one row per page key."""
    return page_index(marked_pages(spark, folder)).select("page_key", "static_id", "static_error", "needs_dynamic")


@query(
    f"""WITH {SQL_MARKED}, keyed AS (
  SELECT {SQL_KEY} AS page_key, html, row_number() OVER (PARTITION BY {SQL_KEY} ORDER BY page_id) AS rn FROM marked),
asked AS (
  SELECT page_id, CASE WHEN page_id % 4 = 1 THEN url || 'x/absent' ELSE {SQL_KEY} || '//#again' END AS url FROM pages)
SELECT a.page_id, a.url, md5(k.html) AS html_md5,
  CASE WHEN k.page_key IS NULL THEN 'page not found' WHEN k.html = '' THEN 'empty response' END AS error
FROM (SELECT *, {SQL_KEY} AS key FROM asked) a LEFT JOIN keyed k ON a.key = k.page_key AND k.rn = 1"""
)
def page_lookup(spark, folder):
    """URLs to pages or errors."""
    asked = load(spark, folder, "pages").select(
        "page_id",
        F.when(F.col("page_id") % 4 == 1, F.concat("url", F.lit("x/absent")))
        .otherwise(F.concat(urls.normalize_url(F.col("url")), F.lit("//#again")))
        .alias("url"),
    )
    found = lookup_pages(asked.withColumnRenamed("page_id", "request_id"), marked_pages(spark, folder))
    return found.select(F.col("request_id").alias("page_id"), "url", F.md5(F.col("html").cast("binary")).alias("html_md5"), "error")


@query(
    f"""WITH tags AS (
  SELECT page_id, {_ORIGIN} AS origin, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS hrefs,
    regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS texts FROM pages),
flat AS (
  SELECT page_id, origin, unnest(hrefs) AS href, unnest(texts) AS text, generate_subscripts(hrefs, 1) AS ord FROM tags)
SELECT page_id, CAST(ord - 1 AS BIGINT) AS pos, origin || {_ENCODED} AS href, trim(text) AS text, '' AS rel, TRUE AS is_internal
FROM flat"""
)
def link_list(spark, folder):
    """All anchors with text, rel and whether they stay on the host."""
    return link_details(load(spark, folder, "pages")).withColumn("pos", F.col("pos").cast("bigint"))


@query(
    f"""SELECT {SQL_KEY} AS page_key, count(*) AS snapshots, min(page_id) AS first_id FROM pages GROUP BY 1"""
)
def page_copies(spark, folder):
    """U1 as a grouping key: how many snapshots share a page."""
    keyed = with_page_key(load(spark, folder, "pages"))
    return keyed.groupBy("page_key").agg(F.count(F.lit(1)).alias("snapshots"), F.min("page_id").alias("first_id"))


@query("SELECT page_id, url, md5(html) AS html_md5 FROM pages WHERE page_id >= 7 AND (page_id < 40 OR page_id % 2 = 0)")
def snapshot_source(spark, folder):
    """Pages through the snapshot source, a filter taken and one left to Spark."""
    n = F.col("page_id")
    pages = read_snapshots(spark, f"{folder}/pages.parquet").filter((n >= 7) & ((n < 40) | (n % 2 == 0)))
    return pages.select("page_id", "url", F.md5(F.col("html").cast("binary")).alias("html_md5"))


@query(
    f"""WITH scored AS (
  SELECT page_id, url, len(regexp_extract_all(html, '<a href=')) * 10 + page_id % 3 AS score FROM pages WHERE contains(lower(html), 'the'))
SELECT row_number() OVER (ORDER BY score DESC, page_id) - 1 AS idx, page_id, {SQL_HOST} AS domain, score FROM scored WHERE score > 0
ORDER BY score DESC, page_id LIMIT 50"""
)
def scored_snapshots(spark, folder):
    """A caller's scorer over the snapshot source."""
    pages = read_snapshots(spark, f"{folder}/pages.parquet")
    corpus = pages.select(F.col("page_id").alias("id"), F.lit("").alias("title"), "url", F.lit("").alias("description"), F.col("html").alias("text"))
    scorer = (F.regexp_count("text", F.lit("<a href=")) * 10 + F.col("id") % 3).cast("bigint")
    found = page_of(ranked(corpus, "links", required=["the"], scorer=scorer).select("id", "url", "score"), 0, 50)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1  # of 50 rows
    return found.select(rank.cast("bigint").alias("idx"), F.col("id").alias("page_id"), urls.hostname(F.col("url")).alias("domain"), "score")
