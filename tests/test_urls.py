import pytest
from pyspark.sql import functions as F

from pageloom.functions import urls

H = "https://harbour.test"

# address, key
NORMALIZED = [
    (f"{H}/rules#wake", f"{H}/rules"),
    (f"{H}/rules/", f"{H}/rules"),
    (f"{H}/rules///#wake/", f"{H}/rules"),
    (f"{H}/berths?free=1&deep=2", f"{H}/berths?free=1&deep=2"),
    (f"{H}/", H),
    (f"{H}/?free=1/", f"{H}/?free=1"),
    (f"{H}/möwe", f"{H}/m%C3%B6we"),
    (f"{H}/two masts/%41ö", f"{H}/two%20masts/A%C3%B6"),
    (f"{H}/a!*'()", f"{H}/a!*'()"),
    (f"{H}/a!ö*", f"{H}/a%21%C3%B6%2A"),
    (f"{H}/%zz/", f"{H}/%zz/"),
    ("://quay", "://quay"),
    ("http://h.test:80a/", "http://h.test:80a/"),
    ("HTTP://Harbour.test/x", "http://Harbour.test/x"),
    ("mailto:pilot@quay", "mailto:pilot@quay"),
    ("", ""),
]

HOSTS = [
    (f"{H}/tides", "harbour.test"),
    ("https://night.crew.harbour.test/roster/2", "night.crew.harbour.test"),
    ("https://harbour.test", "harbour.test"),
    ("http://quay:9000/log", "quay"),
    ("", ""),
    ("http://pilot:pw@[::1]:80/x", "::1"),
    ("https://low_tide.test/a b", "low_tide.test"),
    ("//quay/x", "quay"),
    ("://quay", ""),
    ("harbour.test/tides", ""),
    ("http://möwe.test:1/x", "möwe.test"),
]

# base, reference, address
RESOLVED = [
    (f"{H}/ferries/night", "day", f"{H}/ferries/day"),
    (f"{H}/ferries/night", "../tides", f"{H}/tides"),
    (f"{H}/ferries/night", "./boat", f"{H}/ferries/boat"),
    (H, "/", f"{H}/"),
    (H, "tides", f"{H}/tides"),
    (f"{H}/tides", "//maps.test/quay", "https://maps.test/quay"),
    (f"{H}/berths?free=1", "", f"{H}/berths?free=1"),
    (f"{H}/berths?free=1", "?free=0", f"{H}/berths?free=0"),
    (f"{H}/one/two/three", "../../../../tides", f"{H}/tides"),
    (f"{H}/one/two/", "..", f"{H}/one/"),
    (f"{H}/one/two/", "three/.", f"{H}/one/two/three/"),
    (f"{H}/tides", "/m%C3%B6we", f"{H}/m%C3%B6we"),
    (f"{H}/tides", "/s?for=two%20masts", f"{H}/s?for=two%20masts"),
    (f"{H}/tides", "b:c", "b:c"),
    (f"{H}/tides", "/p\x01", None),
    (f"{H}/tides", "/%g1", None),
    (f"{H}/tides", "//h:port/x", None),
]

IMAGES = [
    ("https://maps.test/quay.jpg", f"{H}/tides", "https://maps.test/quay.jpg"),
    ("/pictures/gull.jpg", f"{H}/log/today", f"{H}/pictures/gull.jpg"),
    ("gull.jpg", f"{H}/log/", f"{H}/log/gull.jpg"),
    ("data:image/gif;base64,R0lG", f"{H}/", ""),
    ("HTTPS://Maps.test/../a b", f"{H}/", "HTTPS://Maps.test/../a b"),
    ("", f"{H}/log", f"{H}/log"),
    ("%zz", f"{H}/log", ""),
]

RESOURCES = "/chart.pdf /gull.jpg /gull.JPEG /buoy.png /deck.css /tide.js /sign.woff2 /logs.zip /news.xml /signal.mp4".split()
PAGES = ["/ferries/night", "/v1.2/list", "/", "", "/gull.html", "/gull.htm", "/tide.php", "/tide.aspx", "/chart.pdf/two"]


def test_normalize_url(evaluate):
    assert evaluate([u for u, _ in NORMALIZED], urls.normalize_url(F.col("v"))) == [n for _, n in NORMALIZED]


def test_hostname(evaluate):
    assert evaluate([u for u, _ in HOSTS], urls.hostname(F.col("v"))) == [h for _, h in HOSTS]


def test_resolve_url(evaluate):
    got = evaluate([(b, h) for b, h, _ in RESOLVED], urls.resolve_url(F.col("b"), F.col("h")), "b string, h string")
    assert got == [r for *_, r in RESOLVED]


def test_resolve_image_url(evaluate):
    got = evaluate([(r, p) for r, p, _ in IMAGES], urls.resolve_image_url(F.col("r"), F.col("p")), "r string, p string")
    assert got == [u for *_, u in IMAGES]


@pytest.mark.parametrize("paths, expected", [(RESOURCES, True), (PAGES, False)])
def test_is_resource_file(evaluate, paths, expected):
    assert set(evaluate(paths, urls.is_resource_file(F.col("v")))) == {expected}


def test_skipped_hrefs(evaluate):
    hrefs = ["", "mailto:a", "tel:1", "javascript:void(0)", "#", "#x", "MAILTO:a", "/valid"]
    assert evaluate(hrefs, urls.is_skipped_href(F.col("v"))) == [True] * 6 + [False] * 2
