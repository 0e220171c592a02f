"""Images and data URIs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import media, predicates
from ..operators.images import encode_images, extract_images, within_blob_budget
from .inputs import SQL_IMAGE_BYTES, SQL_IMAGES, illustrated_pages, image_bytes
from .registry import load, query

_BLOBS = """blobs AS (
  SELECT i.page_id, i.pos, i.url,
    CASE WHEN b.status IS NULL THEN 'fetch failed: no stored response'
      WHEN b.status <> 200 THEN 'fetch returned status ' || b.status END AS error,
    b.mime, b.content
  FROM images i LEFT JOIN image_bytes b USING (url))"""


def _by_position(df):
    return df.withColumn("pos", F.col("pos").cast("bigint"))


@query(f"WITH {SQL_IMAGES.format(cap=10)} SELECT * FROM images")
def image_list(spark, folder):
    """Images in priority order."""
    return _by_position(extract_images(illustrated_pages(spark, folder)))


@query(
    f"""WITH {SQL_IMAGES.format(cap=10)}
SELECT page_id, pos, url, alt, title, source FROM images WHERE pos < 2 OR source <> 'content'"""
)
def image_list_capped(spark, folder):
    """The cap only limits content images."""
    return _by_position(extract_images(illustrated_pages(spark, folder), max_images=2))


@query(
    f"""WITH {SQL_IMAGES.format(cap=10)}, {SQL_IMAGE_BYTES}, {_BLOBS}
SELECT page_id, pos, url, error, CASE WHEN error IS NULL THEN mime END AS mime_type,
  CASE WHEN error IS NULL THEN CAST(octet_length(content) AS BIGINT) END AS size_bytes,
  CASE WHEN error IS NULL THEN md5('data:' || mime || ';base64,' || to_base64(content)) END AS blob_md5
FROM blobs"""
)
def image_blobs(spark, folder):
    """Image rows with stored bytes."""
    images = _by_position(extract_images(illustrated_pages(spark, folder))).select("page_id", "pos", "url")
    encoded = encode_images(images, image_bytes(spark, folder))
    return encoded.select(
        "page_id", "pos", "url", "error", "mime_type", "size_bytes", F.md5(F.col("blob").cast("binary")).alias("blob_md5")
    )


@query(
    f"""WITH {SQL_IMAGES.format(cap=10)}, {SQL_IMAGE_BYTES}, {_BLOBS},
sizes AS (SELECT page_id, pos, CASE WHEN error IS NULL THEN octet_length(content) ELSE 0 END AS size FROM blobs)
SELECT page_id, pos, CAST(sum(size) OVER w AS BIGINT) AS total_bytes, sum(size) OVER w <= 4000 AS within_budget
FROM sizes WINDOW w AS (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING)"""
)
def image_budget(spark, folder):
    """Running blob size per page."""
    images = _by_position(extract_images(illustrated_pages(spark, folder))).select("page_id", "pos", "url")
    encoded = encode_images(images, image_bytes(spark, folder))
    return within_blob_budget(encoded, budget=4000).select("page_id", "pos", "total_bytes", "within_budget")


@query(
    """SELECT doc_id, md5('data:text/plain;base64,' || to_base64(encode(text))) AS uri_md5,
  CASE WHEN doc_id % 4 = 1 THEN 'not a data URI' WHEN doc_id % 4 = 2 THEN 'invalid data URI format'
    WHEN doc_id % 4 = 3 THEN 'base64 decode failed' END AS error,
  CASE WHEN doc_id % 4 = 0 THEN 'text/plain' END AS mime, CASE WHEN doc_id % 4 = 0 THEN md5(text) END AS data_md5
FROM documents"""
)
def data_uris(spark, folder):
    """Documents to data URIs and back; three kinds of broken ones."""
    uri = media.encode_data_uri(F.encode("text", "UTF-8"), F.lit("text/plain"))
    rows = load(spark, folder, "documents").select("doc_id", uri.alias("uri"))
    n = F.col("doc_id") % 4
    given = (
        F.when(n == 1, F.concat(F.lit("http:"), F.col("uri")))
        .when(n == 2, F.lit("data:text/plain;base64"))
        .when(n == 3, F.concat(F.col("uri"), F.lit("!")))
        .otherwise(F.col("uri"))
    )
    decoded = rows.select("doc_id", "uri", media.decode_data_uri(given).alias("d"))
    return decoded.select(
        "doc_id",
        F.md5(F.col("uri").cast("binary")).alias("uri_md5"),
        F.col("d.error").alias("error"),
        F.col("d.mime").alias("mime"),
        F.md5("d.data").alias("data_md5"),
    )


@query(
    """WITH named AS (
  SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'https://' WHEN 1 THEN 'http://' WHEN 2 THEN 'ftp://' ELSE '/' END
    || CASE WHEN event_type = 'view' THEN 'e.com/Tracking-' WHEN event_type = 'click' THEN 'Pixel.example/'
      ELSE 'e.com/photo' END || user_id || '.gif' AS url FROM events)
SELECT event_id, url, regexp_matches(lower(url), 'pixel|tracking|beacon|analytics|1x1|spacer|blank') AS tracker,
  regexp_matches(url, '^https?://') AS valid FROM named"""
)
def image_url_checks(spark, folder):
    """F6, F7."""
    n = F.col("event_id") % 4
    url = F.concat(
        F.when(n == 0, "https://").when(n == 1, "http://").when(n == 2, "ftp://").otherwise("/"),
        F.when(F.col("event_type") == "view", "e.com/Tracking-")
        .when(F.col("event_type") == "click", "Pixel.example/")
        .otherwise("e.com/photo"),
        F.col("user_id").cast("string"),
        F.lit(".gif"),
    )
    rows = load(spark, folder, "events").select("event_id", url.alias("url"))
    return rows.select(
        "event_id",
        "url",
        predicates.is_tracking_pixel(F.col("url")).alias("tracker"),
        predicates.is_valid_image_url(F.col("url")).alias("valid"),
    )
