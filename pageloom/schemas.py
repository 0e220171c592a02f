"""Explicit schemas of every relation; nothing is inferred."""

from pyspark.sql import types as T


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


STR, BOOL, INT, LONG, DOUBLE, TS, BIN = (
    T.StringType(),
    T.BooleanType(),
    T.IntegerType(),
    T.LongType(),
    T.DoubleType(),
    T.TimestampType(),
    T.BinaryType(),
)

PAGE = _struct(page_id=LONG, url=STR, html=STR)
RENDERED_PAGE = _struct(url=STR, html=STR, engine=STR, error=STR)

IMAGE = _struct(
    url=STR, blob=STR, alt=STR, title=STR, width=INT, height=INT, format=STR, size_bytes=LONG, source=STR
)
BLOB = _struct(blob=STR, mime_type=STR, raw=BIN)
SCREENSHOT = _struct(
    blob=STR, url=STR, format=STR, width=INT, height=INT, full_page=BOOL, size_bytes=LONG, captured_at=TS
)
SCREENSHOT_OPTIONS = _struct(full_page=BOOL, width=INT, height=INT, format=STR, quality=INT)
SCRAPE_OPTIONS = _struct(
    mode=STR,
    screenshot=BOOL,
    images=BOOL,
    image_format=STR,
    screenshot_opts=SCREENSHOT_OPTIONS,
    max_images=INT,
    max_image_size_kb=INT,
)
SCRAPE_RESULT = _struct(
    url=STR,
    markdown=STR,
    html=STR,
    metadata=T.MapType(STR, STR),
    screenshot=SCREENSHOT,
    images=T.ArrayType(IMAGE),
)

SCRAPE_PAYLOAD = _struct(url=STR, render=BOOL, mode=STR, screenshot=BOOL, images=BOOL)
CRAWL_PAYLOAD = _struct(
    url=STR, render=BOOL, mode=STR, screenshot=BOOL, images=BOOL, maxDepth=INT, limit=INT
)
TASK = _struct(task_id=STR, task_type=STR, ts=TS, payload=STR)

FAILED_URL = _struct(url=STR, error=STR)
CRAWL_RESULT = _struct(
    status=STR,
    total=INT,
    maxDepth=INT,
    limit=INT,
    data=T.ArrayType(SCRAPE_RESULT),
    failedUrls=T.ArrayType(FAILED_URL),
)

SEARCH_HIT = _struct(title=STR, url=STR, description=STR)
SEARCH_PROVIDER_RESPONSE = _struct(web=_struct(results=T.ArrayType(SEARCH_HIT)))
SEARCH_RESULT = _struct(title=STR, url=STR, description=STR, id=STR, domain=STR, relevance=DOUBLE)
SEARCH_REQUEST = _struct(
    query=STR,
    offset=INT,
    limit=INT,
    includeDomains=T.ArrayType(STR),
    excludeDomains=T.ArrayType(STR),
    requiredText=T.ArrayType(STR),
    maxAge=INT,
    mode=STR,
)

RUN_LOG = _struct(id=STR, queue=STR, state=STR, max_retry=INT, retried=INT, payload=STR, result=STR)
CACHE_ENTRY = _struct(cache_key=STR, cached_at=TS, result=SCRAPE_RESULT)
ACCESS_LOG = _struct(ts=TS, method=STR, path=STR, status=INT, latency_ms=DOUBLE, ip=STR)

IMAGE_TRANSPORT_FORMATS = ("url", "blob")
