import pytest
from pyspark.sql import functions as F

from pageloom.functions import media
from pageloom.operators.images import encode_images, extract_images, within_blob_budget
from pageloom.operators.links import extract_links

H = "https://harbour.test"

# Each rule by links of a made-up harbour's site.
LINKS = {
    "own pages in order": (H, ["/tides", "/ferries", "/ferries/night", "/tides"], [f"{H}/tides", f"{H}/ferries", f"{H}/ferries/night"]),
    "the start page": (H, ["/", H], [f"{H}/", H]),
    "other hosts": (H, ["https://weather.test/north", "/quay", "http://harbour.test.evil.test/"], [f"{H}/quay"]),
    "no scheme": (H, ["//maps.test/quay", "//harbour.test/quay"], [f"{H}/quay"]),
    "hosts above and below": ("https://crew.harbour.test/roster", [f"{H}/crew", "https://night.crew.harbour.test/", "week"], ["https://crew.harbour.test/week"]),
    "not for reading": (H, ["mailto:pilot@harbour.test", "tel:0800", "javascript:dock()", "#", "/pilot"], [f"{H}/pilot"]),
    "files": (H, ["/chart.pdf", "/gull.JPEG", "/signal.mp4", "/gull.html", "/v1.2/list"], [f"{H}/gull.html", f"{H}/v1.2/list"]),
    "parts of a page": (H, ["/rules#speed", "/rules#wake", "/rules"], [f"{H}/rules"]),
    "queries tell pages apart": (H, ["/berths?free=1", "/berths?free=0", "/berths?free=1#x"], [f"{H}/berths?free=1", f"{H}/berths?free=0"]),
    "from where it stands": (f"{H}/ferries/night/", ["boat", "../day", "./boat?x", "."], [f"{H}/ferries/night/boat", f"{H}/ferries/day", f"{H}/ferries/night/boat?x", f"{H}/ferries/night/"]),
    "ports": (H, ["https://harbour.test:444/log", "https://harbour.test/log"], ["https://harbour.test:444/log", f"{H}/log"]),
    "escapes stay": (H, ["/s?for=two%20masts", "/m%C3%B6we"], [f"{H}/s?for=two%20masts", f"{H}/m%C3%B6we"]),
    "letters are escaped": (H, ["/möwe", "/m%C3%B6we", "/chart%2Epdf"], [f"{H}/m%C3%B6we"]),
    "nothing": (H, [], []),
}


def test_extract_links(spark):
    rows = [
        (i, url, "".join(f'<a href="{h}">t</a>' for h in hrefs)) for i, (url, hrefs, _) in enumerate(LINKS.values())
    ]
    out = extract_links(spark.createDataFrame(rows, "page_id int, url string, html string")).orderBy("page_id", "pos").collect()
    for i, (name, (_, _, expected)) in enumerate(LINKS.items()):
        assert [r.link for r in out if r.page_id == i] == expected, name


IMAGES = {
    "og": (f'<meta property="og:image" content="{H}/mole.jpg">', [(f"{H}/mole.jpg", "og:image")]),
    "twitter": ('<meta name="twitter:image" content="/buoy.webp">', [(f"{H}/buoy.webp", "twitter:image")]),
    "content": ("<img src='/gull.jpg'><img src=deck/rope.png><IMG SRC=knot.gif />", [(f"{H}/gull.jpg", "content"), (f"{H}/deck/rope.png", "content"), (f"{H}/knot.gif", "content")]),
    "inline": ('<img src="data:image/gif;base64,R0lG"><img src="/gull.jpg">', [(f"{H}/gull.jpg", "content")]),
    "trackers": ('<img src="/1x1-pixel.gif"><img src="/analytics/wave.png"><img src="/wave.png">', [(f"{H}/wave.png", "content")]),
    "duplicates": ('<meta property="og:image" content="/mole.jpg"><img src="mole.jpg"><img src="gull.jpg"><img src="./gull.jpg">', [(f"{H}/mole.jpg", "og:image"), (f"{H}/gull.jpg", "content")]),
    "none": ('<p>fog</p><img src=""><img><img alt=fog>', []),
    "order": ('<img src=gull.jpg><meta name="twitter:image" content=buoy.jpg><meta property="og:image" content=mole.jpg>', [(f"{H}/mole.jpg", "og:image"), (f"{H}/buoy.jpg", "twitter:image"), (f"{H}/gull.jpg", "content")]),
    "og tracker kept": ('<meta property="og:image" content="/pixel/mole.jpg">', [(f"{H}/pixel/mole.jpg", "og:image")]),
    "og empty": ('<meta property="og:image" content="">', [(f"{H}/", "og:image")]),
    "first og only": ('<meta property="og:image"><meta property="og:image" content=mole.jpg>', []),
}


def test_extract_images(spark):
    rows = [(i, f"{H}/", h) for i, (h, _) in enumerate(IMAGES.values())]
    out = extract_images(spark.createDataFrame(rows, "page_id int, url string, html string")).orderBy("page_id", "pos").collect()
    for i, (name, (_, expected)) in enumerate(IMAGES.items()):
        assert [(r.url, r.source) for r in out if r.page_id == i] == expected, name


def test_image_cap_and_texts(spark):
    page = '<meta property="og:image" content=o.jpg><meta name="twitter:image" content=t.jpg>' + "".join(
        f'<img src="p{i}.jpg" alt="Photo {i}" title="T{i}">' for i in range(5)
    )
    pages = spark.createDataFrame([(1, f"{H}/blog/post", page)], "page_id int, url string, html string")
    assert [r.source for r in extract_images(pages, max_images=1).orderBy("pos").collect()] == ["og:image", "twitter:image"]
    got = extract_images(pages, max_images=3).orderBy("pos").collect()
    assert [(r.url, r.alt, r.title) for r in got][2] == (f"{H}/blog/p0.jpg", "Photo 0", "T0") and len(got) == 3


def test_encode_images(spark):
    png = bytes.fromhex("89504E470D0A1A0A")
    stored = [
        (f"{H}/ok.png", 200, "image/png", png),
        (f"{H}/big.png", 200, "image/png", bytes(5 * 1024 * 1024 + 1)),
        (f"{H}/max.png", 200, "image/png", bytes(5 * 1024 * 1024)),
        (f"{H}/gone.png", 404, "image/png", png),
        (f"{H}/sniffed", 200, "text/html", png),
        (f"{H}/params", 200, "image/jpeg; charset=utf-8", png),
    ]
    bytes_df = spark.createDataFrame(stored, "url string, status int, content_type string, content binary")
    urls = [s[0] for s in stored] + ["ftp://e.com/x.png", f"{H}/absent.png"]
    images = spark.createDataFrame([(1, i, u) for i, u in enumerate(urls)], "page_id int, pos int, url string")
    out = encode_images(images, bytes_df).orderBy("pos").collect()
    assert [r.error for r in out] == [
        None, "image exceeded size limit (5242880 bytes max)", None, "fetch returned status 404", None, None,
        "invalid image URL: ftp://e.com/x.png", "fetch failed: no stored response",
    ]
    assert [r.mime_type for r in out][:6] == ["image/png", None, "image/png", None, "image/png", "image/jpeg"]
    assert out[0].blob == "data:image/png;base64,iVBORw0KGgo=" and out[0].size_bytes == 8
    budget = within_blob_budget(encode_images(images, bytes_df), budget=100).orderBy("pos").collect()
    assert [r.within_budget for r in budget][:3] == [True, True, False]


@pytest.mark.parametrize("mime", ["image/png", "image/jpeg", "image/webp", "image/gif", "image/svg+xml"])
def test_data_uri_round_trip(evaluate, mime):
    uri = media.encode_data_uri(F.col("v"), F.lit(mime))
    assert evaluate([b"test image data" * 20], uri, "v binary")[0].startswith(f"data:{mime};base64,")
    back = evaluate([b"test image data" * 20], media.decode_data_uri(uri), "v binary")[0]
    assert (bytes(back["data"]), back.mime, back.error) == (b"test image data" * 20, mime, None)


def test_broken_data_uris(evaluate):
    bad = ["https://example.com/image.png", "data:image/png;base64", "data:image/png;base64,!!!invalid!!!", "data:image/png;base64,AAA"]
    errors = [r.error for r in evaluate(bad, media.decode_data_uri(F.col("v")))]
    assert errors == ["not a data URI", "invalid data URI format", "base64 decode failed", "base64 decode failed"]
