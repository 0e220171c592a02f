"""Inputs derived from the given tables, in Spark and in SQL alike.

The page table has no images, no markers and no links between its pages, so
these relations add them row by row to the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import load


def marked_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with script-shell markers in some rows and empty bodies in others."""
    n, html = F.col("page_id"), F.col("html")
    marked = (
        F.when(n % 17 == 3, F.lit(""))
        .when(
            n % 7 == 0,
            F.replace(
                html, F.lit("</article>"), F.lit("<noscript>Please Enable JavaScript now</noscript></article>")
            ),
        )
        .when(n % 11 == 0, F.replace(html, F.lit("<article>"), F.lit('<div id="root"></div><article>')))
        .otherwise(html)
    )
    return load(spark, folder, "pages").select("page_id", "url", marked.alias("html"))


SQL_MARKED = """marked AS (
  SELECT page_id, url, CASE
    WHEN page_id % 17 = 3 THEN ''
    WHEN page_id % 7 = 0 THEN replace(html, '</article>', '<noscript>Please Enable JavaScript now</noscript></article>')
    WHEN page_id % 11 = 0 THEN replace(html, '<article>', '<div id="root"></div><article>')
    ELSE html END AS html
  FROM pages)"""

SQL_SHELL = """(octet_length(encode(html)) < 2000 AND contains(lower(html), '<script')
    OR octet_length(encode(html)) < 5000 AND (contains(html, 'id="root"') OR contains(html, 'id="app"')
      OR contains(html, 'id="__next"') OR contains(html, 'data-reactroot') OR contains(html, '__NEXT_DATA__')
      OR contains(html, 'ng-version') OR contains(html, '<app-root>'))
    OR contains(lower(html), '<noscript>') AND (contains(lower(html), 'enable javascript')
      OR contains(lower(html), 'need javascript') OR contains(lower(html), 'requires javascript')))"""


def rendered_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Rendered snapshots; some failed, some are empty."""
    n = F.col("page_id")
    failed = F.when(n % 5 == 0, F.lit("chromedp failed: timeout"))
    html = F.when(n % 9 == 4, F.lit("")).otherwise(
        F.replace(F.col("html"), F.lit("<nav>"), F.lit('<nav data-rendered="1">'))
    )
    return load(spark, folder, "pages").select("page_id", "url", html.alias("html"), failed.alias("error"))


SQL_RENDERED = """rendered AS (
  SELECT page_id, url,
    CASE WHEN page_id % 9 = 4 THEN '' ELSE replace(html, '<nav>', '<nav data-rendered="1">') END AS html,
    CASE WHEN page_id % 5 = 0 THEN 'chromedp failed: timeout' END AS error
  FROM pages)"""


def illustrated_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with a preview image, sometimes a card image, and content images:
    relative, repeated, inline and tracking ones."""
    n = F.col("page_id")
    text = n.cast("string")
    head = F.concat(
        F.lit('<meta property="og:image" content="/img/'),
        text,
        F.lit('.jpg">'),
        F.when(n % 3 == 0, F.concat(F.lit("<meta name='twitter:image' content='card"), text, F.lit(".png'>"))).otherwise(
            F.lit("")
        ),
        F.lit("</head>"),
    )
    body = F.concat(
        F.lit('<img src="/img/'),
        text,
        F.lit('.jpg" alt="again"><img alt="Photo '),
        text,
        F.lit('" title="T&amp;C" src="photo'),
        (n % 5).cast("string"),
        F.lit('.png"><img src="data:image/png;base64,AAAA"><img src="/t/pixel.gif"><img src="">'),
        F.lit("<img src=https://cdn.example.com/"),
        (n % 4).cast("string"),
        F.lit("/logo.webp><img src='/m/a'/><img src='/m/b'/></article>"),
    )
    html = F.replace(F.replace(F.col("html"), F.lit("</head>"), head), F.lit("</article>"), body)
    return load(spark, folder, "pages").select("page_id", "url", html.alias("html"))


# The same images as a list, resolved by hand: origin is scheme and host, dir
# the page's path up to its last slash.
SQL_IMAGES = """parts AS (
  SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin,
    regexp_extract(url, '^([a-z]+://[^/?#]*/(?:[^?#]*/)?)', 1) AS dir, page_id % 3 = 0 AS card
  FROM pages),
candidates AS (
  SELECT page_id, 1 AS rank, origin || '/img/' || page_id || '.jpg' AS url, '' AS alt, '' AS title, 'og:image' AS source FROM parts
  UNION ALL
  SELECT page_id, 2, dir || 'card' || page_id || '.png', '', '', 'twitter:image' FROM parts WHERE card
  UNION ALL
  SELECT page_id, 3, dir || 'photo' || (page_id % 5) || '.png', 'Photo ' || page_id, 'T&C', 'content' FROM parts
  UNION ALL
  SELECT page_id, 4, 'https://cdn.example.com/' || (page_id % 4) || '/logo.webp', '', '', 'content' FROM parts
  UNION ALL
  SELECT page_id, 5, origin || '/m/a', '', '', 'content' FROM parts
  UNION ALL
  SELECT page_id, 6, origin || '/m/b', '', '', 'content' FROM parts),
ranked_images AS (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY rank) - 1 AS pos FROM candidates),
images AS (SELECT page_id, pos, url, alt, title, source FROM ranked_images WHERE pos < {cap})"""


def image_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """Stored answers for every preview image, with wrong and missing types."""
    n = F.col("page_id")
    origin = F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1)
    content = F.concat(
        F.when(n % 4 == 0, F.unhex(F.lit("FFD8FFE0"))).otherwise(F.unhex(F.lit("89504E470D0A1A0A"))),
        F.encode(F.col("html"), "UTF-8"),
    )
    return load(spark, folder, "pages").select(
        F.concat(origin, F.lit("/img/"), n.cast("string"), F.lit(".jpg")).alias("url"),
        F.when(n % 6 == 1, F.lit(404)).otherwise(F.lit(200)).alias("status"),
        F.when(n % 3 == 0, F.lit("image/png; charset=binary"))
        .when(n % 3 == 1, F.lit("text/html"))
        .alias("content_type"),
        content.alias("content"),
    )


SQL_IMAGE_BYTES = """image_bytes AS (
  SELECT regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/img/' || page_id || '.jpg' AS url,
    CASE WHEN page_id % 6 = 1 THEN 404 ELSE 200 END AS status,
    CASE WHEN page_id % 3 = 0 THEN 'image/png' WHEN page_id % 4 = 0 THEN 'image/jpeg' ELSE 'image/png' END AS mime,
    (CASE WHEN page_id % 4 = 0 THEN unhex('FFD8FFE0') ELSE unhex('89504E470D0A1A0A') END) || encode(html) AS content
  FROM pages)"""


def site_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Sites of 50 pages that link to each other, with empty pages between."""
    n = F.col("page_id")
    site, local = F.floor(n / 50), n % 50

    def anchor(number, suffix=""):
        return F.concat(F.lit('<a href="/p/'), number.cast("string"), F.lit(f'{suffix}">x</a>'))

    html = F.concat(
        anchor((2 * local + 1) % 50),
        anchor((2 * local + 2) % 50, "#part"),
        anchor(F.floor(local / 2), "/"),
        anchor((local * 7 + 3) % 50),
        F.lit('<a href="/file.pdf">f</a><a href="https://other.example.org/p/1">o</a>'),
        F.col("html"),
    )
    return load(spark, folder, "pages").select(
        "page_id",
        F.concat(
            F.lit("https://site"), site.cast("string"), F.lit(".example.com/p/"), local.cast("string")
        ).alias("url"),
        F.when(n % 13 == 5, F.lit("")).otherwise(html).alias("html"),
    )


def site_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """One crawl per page, with differing depth, limit and mode."""
    n = F.col("page_id")
    return load(spark, folder, "pages").select(
        n.cast("string").alias("crawl_id"),
        F.concat(
            F.lit("https://site"),
            F.floor(n / 50).cast("string"),
            F.lit(".example.com/p/"),
            (n % 50).cast("string"),
            F.lit("/#top"),
        ).alias("url"),
        F.when(n % 3 == 0, F.lit("smart")).otherwise(F.lit("static")).alias("mode"),
        (n % 5).cast("int").alias("maxDepth"),
        (n % 23).cast("int").alias("limit"),
        (n % 41 == 7).alias("cancelled"),
    )


# The links that survive in a crawl are written down here by hand in link
# order: own nav links are resolved on the site, all are normalised.
SQL_SITE = (
    """nav AS (
  SELECT page_id, list_transform(regexp_extract_all(html, '<a href="([^"]*)">', 1), lambda h:
    replace(replace(url_encode(h), '%2F', '/'), '%2C', ',')) AS hrefs FROM pages),
site0 AS (
  SELECT p.page_id, 'https://site' || (p.page_id // 50) || '.example.com' AS origin, p.page_id % 50 AS m,
    p.page_id % 13 = 5 AS gone, p.html, n.hrefs
  FROM pages p JOIN nav n USING (page_id)),
site1 AS (
  SELECT *, CASE WHEN gone THEN [] ELSE list_concat(
      ['/p/' || ((2*m+1) % 50), '/p/' || ((2*m+2) % 50), '/p/' || (m // 2), '/p/' || ((m*7+3) % 50)], hrefs) END AS raw,
    CASE WHEN gone THEN '' ELSE '<a href="/p/' || ((2*m+1) % 50) || '">x</a><a href="/p/' || ((2*m+2) % 50)
      || '#part">x</a><a href="/p/' || (m // 2) || '/">x</a><a href="/p/' || ((m*7+3) % 50)
      || '">x</a><a href="/file.pdf">f</a><a href="https://other.example.org/p/1">o</a>' || html END AS page
  FROM site0),
site AS (
  SELECT page_id, origin || '/p/' || m AS page_key,
    list_filter(list_transform(raw, lambda h: origin || rtrim(h, '/')),
      lambda h, i: list_position(list_transform(raw, lambda g: origin || rtrim(g, '/')), h) = i) AS links,
    CASE WHEN gone THEN 'empty response' END AS static_error, """
    + SQL_SHELL.replace("html", "page")
    + """ AS shell
  FROM site1),
jobs AS (
  SELECT CAST(page_id AS VARCHAR) AS crawl_id, page_id,
    'https://site' || (page_id // 50) || '.example.com/p/' || (page_id % 50) AS url,
    CASE WHEN page_id % 3 = 0 THEN 'smart' ELSE 'static' END AS mode,
    CASE WHEN page_id % 5 = 0 THEN 2 ELSE page_id % 5 END AS max_depth,
    CASE WHEN page_id % 23 = 0 THEN 10 ELSE page_id % 23 END AS lim, page_id % 41 = 7 AS cancelled
  FROM pages),
run AS (
  SELECT crawl_id, mode, max_depth, lim, 0 AS step, CAST(NULL AS VARCHAR) AS url, CAST(NULL AS BIGINT) AS depth,
    CAST(NULL AS VARCHAR) AS error, [{'u': url, 'd': CAST(0 AS BIGINT)}] AS queue, [url] AS visited, 0 AS done
  FROM jobs WHERE NOT cancelled
  UNION ALL
  SELECT crawl_id, mode, max_depth, lim, step + 1, queue[1].u, queue[1].d, failure,
    list_concat(queue[2:], list_transform(fresh, lambda x: {'u': x, 'd': queue[1].d + 1})),
    list_concat(visited, fresh), done + CASE WHEN failure IS NULL THEN 1 ELSE 0 END
  FROM (
    SELECT *, CASE WHEN failure IS NULL AND queue[1].d < max_depth
      THEN list_filter(links, lambda x: NOT list_contains(visited, x))[1:greatest(lim - (len(queue) - 1) - (done + 1), 0)]
      ELSE [] END AS fresh
    FROM (
      SELECT r.*, s.links, CASE WHEN s.page_key IS NULL THEN 'page not found'
        WHEN s.static_error IS NOT NULL THEN s.static_error
        WHEN r.mode = 'smart' AND s.shell THEN 'dynamic scraper not configured' END AS failure
      FROM run r LEFT JOIN site s ON r.queue[1].u = s.page_key
      WHERE len(r.queue) > 0 AND r.done < r.lim))),
visits AS (SELECT crawl_id, CAST(step - 1 AS BIGINT) AS seq, url, depth, error FROM run WHERE step > 0)"""
)
