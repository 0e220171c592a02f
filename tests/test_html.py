import time

from pyspark.sql import functions as F

from pageloom.functions import html as H
from pageloom.functions import predicates as P
from pageloom.functions.elements import main_text, only_elements, without_selected
from pageloom.functions.markdown import to_markdown
from pageloom.operators.documents import first_paragraph

# One document per rule and threshold: sizes just below and at 2000 and 5000
# bytes, several bytes per letter, a marker in the wrong case, a phrase outside its tag.
def sized(start: str, size: int, fill: str = "k") -> str:
    room = size - len(start.encode())
    return start + fill * (room // len(fill.encode()))


DYNAMIC = [
    ("<p>Harbour news</p><noscript>The tide map requires JavaScript</noscript>", True),
    ("<p>Our ferries need javascript developers</p><noscript>no map here</noscript>", True),
    ("<p>Our ferries need javascript developers</p>", False),
    ("<p>JavaScript is a language</p><noscript>Pictures are missing</noscript>", False),
    ("<noscript>we like tea</noscript>", False),
    (sized('<main id="root">tide', 4999), True),
    (sized('<main id="root">tide', 5000), False),
    (sized('<main ID="ROOT">tide', 600), False),
    (sized("<script>", 1999), True),
    (sized("<script>", 2000), False),
    (sized("<script>", 2400, "ß"), False),
    (sized("<em>short</em>", 300), False),
    ("", False),
]


def test_needs_dynamic(evaluate):
    assert evaluate([h for h, _ in DYNAMIC], P.needs_dynamic(F.col("v"))) == [e for _, e in DYNAMIC]


def test_tracking_pixel(evaluate):
    urls = ["/t/pixel?id=7", "http://a.org/beacon/44", "/i/1x1.png", "/spacer.webp", "/boats/ketch.jpg", "/2x2.png"]
    assert evaluate(urls, P.is_tracking_pixel(F.col("v"))) == [True] * 4 + [False] * 2


def test_valid_image_url(evaluate):
    urls = ["https://e.com/a.png", "http://e.com/a.jpg", "ftp://e.com/a", "data:image/png", "/relative", ""]
    assert evaluate(urls, P.is_valid_image_url(F.col("v"))) == [True, True, False, False, False, False]


def test_tags_and_attributes(evaluate):
    page = (
        "<a href='/x'>t</a><a class=\"href=1\" data-href=2 HREF = /y>k</a><!-- <a href=/no> --><script><a href='/no'></script>"
        '<A title="a>b" href="/z?a=1&amp;b=2&copy=3">q</A><a/href=/w><div title=\'<a href=/no>\'><noscript><a href=/no></noscript>'
        '<a name=x><a href><a href=""><a href=/q&#233;&euro;&#x41;&nope;&#x1F600;><abbr href=/no><textarea><a href=/no></textarea><title><a href=/no>'
    )
    tags = H.start_tags(F.col("v"), "a")
    got = evaluate([page], F.transform(tags, lambda t: H.attribute(t, "href")))[0]
    assert got == ["/x", "/y", "/z?a=1&b=2&copy=3", "/w", "", "", "", "/qé€A&nope;\U0001f600"]
    assert evaluate([page], F.transform(tags, lambda t: H.has_attribute(t, "href")))[0] == [True] * 4 + [False] + [True] * 3


def test_long_tags_do_not_exhaust_the_stack(evaluate):
    page = "<a " + " ".join(f'd{i}="{i}>"' for i in range(50_000)) + ' href="/end">x</a><!--' + "x" * 500_000
    tags = H.start_tags(F.col("v"), "a")
    assert evaluate([page], F.transform(tags, lambda t: H.attribute(t, "href"))) == [["/end"]]


def test_entities(evaluate):
    texts = ["&ampx &AMP;&notit; &am &;", "a&amp;b &lt;i&gt; &#39;x&#x27; &hellip;", "&copy &copyx; &#0; &#1114112; &#128;", "no reference & here"]
    assert evaluate(texts, H.decode_entities(F.col("v"))) == [
        "&x &¬it; &am &;",
        "a&b <i> 'x' …",
        "© ©x; � � €",
        "no reference & here",
    ]


def test_entities_of_html5_and_long_numbers(evaluate):
    texts = ["&check;&lbrace;&comma;&sol;a", "&NotEqualTilde;", "&#000000065;&#x0000041;", "&#129;&#x81;", "&#99999999999999;&#xFFFFFFFFFF;"]
    assert evaluate(texts, H.decode_entities(F.col("v"))) == ["✓{,/a", "≂̸", "AA", "\x81\x81", "\ufffd\ufffd"]


def test_text_is_not_taken_for_tags(evaluate):
    page = 'a < b and c > d <a title="x>y">t</a> once = 5 euros <b'
    assert evaluate([page], H.plain_text(F.col("v"))) == ["a < b and c > d t once = 5 euros"]


def test_cleaned_html_changes_tags_alone(evaluate):
    page = '<p onclick="go()" class=k>sold once = 5 euros</p><i data-analytics-id=4>x</i>'
    assert evaluate([page], H.cleaned_html(F.col("v"))) == ["<p class=k>sold once = 5 euros</p><i>x</i>"]


def test_unclosed_tags_are_linear(evaluate):
    pages = ["<a " * 350_000, "<!x" * 350_000, "</a" * 350_000, "x" + "<a href='" * 120_000]
    assert evaluate(pages, F.size(H.start_tags(F.col("v"), "a"))) == [0] * 4
    assert [len(t) for t in evaluate(pages, H.plain_text(F.col("v")))] == [0, 0, 0, 1]


def test_plain_text(evaluate):
    page = "<head><title>T</title></head><nav>skip</nav><p>One  <b>two</b>&nbsp;x</p><script>no()</script><p>Three<br>four</p><footer>f</footer>"
    assert evaluate([page], H.plain_text(F.col("v"))) == ["One two x\nThree\nfour"]


def test_markdown():
    page = (
        "<head><title>no</title></head><h1>A  b</h1><p>x <b>bold</b> and <i>it</i><br>new &amp; <a href='/q?a=1&amp;b=2' title='T'>l</a></p>"
        "<ul><li>1<li>2<ul><li>n</li></ul></li></ul><ol><li>a</li><li>b</li></ol><pre><code>x  y\n z</code></pre>"
        "<blockquote><p>q1</p><p>q2</p></blockquote><p><code>c</code> 1_x<hr><p># no</p><img src=a.png alt=z>"
        "<table><tr><th>h</th><th>k</th></tr><tr><td>1</td><td>2</td></tr></table>"
    )
    assert to_markdown(page) == (
        "# A b\n\nx **bold** and *it*  \nnew & [l](/q?a=1&b=2 \"T\")\n\n- 1\n- 2\n  - n\n\n1. a\n2. b\n\n"
        "```\nx  y\n z\n```\n\n> q1\n>\n> q2\n\n`c` 1\\_x\n\n* * *\n\n\\# no\n\n![z](a.png)\n\n"
        "| h | k |\n| --- | --- |\n| 1 | 2 |"
    )


def test_markdown_of_odd_markup():
    assert to_markdown("") == ""
    assert to_markdown("plain") == "plain"
    assert to_markdown("<p>a</b></p></div><b>c") == "a\n\n**c**"
    assert to_markdown("<b>" * 3000 + "x") .count("x") == 1


MB = 1 << 20


def test_broken_markup_is_linear(spark):
    """A megabyte of open tags, each in about a second or less."""
    texts = ["<p " * (MB // 3), "<title>" * (MB // 7), "<p>x" * (MB // 4), '<div id="root">' * (MB // 15), "</p " * (MB // 4), "<" * MB, "<p a='" * (MB // 6)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "page_id int, html string").repartition(1).cache()
    assert df.count() == len(texts)
    html = F.col("html")
    for name, out in {
        "plain": H.plain_text(html), "cleaned": H.cleaned_html(html), "title": H.first_element_text(html, "title"),
        "main": main_text(html), "without": without_selected(html, "div", "p"), "only": only_elements(html, "main", "div"),
    }.items():
        start = time.time()
        df.select(F.sum(F.length(out))).collect()
        assert time.time() - start < 2.5 * len(texts), name
    start = time.time()
    first_paragraph(df).collect()
    assert time.time() - start < 2.5 * len(texts)


def test_elements(evaluate):
    cases = [
        ("a<main>b<main>c</main>d</main>e", "<main>b<main>c</main>d</main>", "ae"),
        ("<main>1</main>x<main>2</main>", "<main>1</main>\n<main>2</main>", "x"),
        ("<main>open <b>end", "<main>open <b>end", ""),
        ("</main>a<main>b</main></main>", "<main>b</main>", "</main>a</main>"),
        ("<mainly>a</mainly><!-- <main> --><script>'<main>'</script>", "", "<mainly>a</mainly><!-- <main> --><script>'<main>'</script>"),
        ("<MAIN class=\"a > b\">x</Main>y", "<MAIN class=\"a > b\">x</Main>", "y"),
        ("", "", ""), (None, None, None),
    ]
    values = [c[0] for c in cases]
    assert evaluate(values, only_elements(F.col("v"), "main")) == [c[1] for c in cases]
    assert evaluate(values, without_selected(F.col("v"), "main")) == [c[2] for c in cases]


def test_selectors(evaluate):
    page = '<nav>n</nav><div id="ad" class="box wide">1<div>2</div></div><p class="x">3<p>4</p><img id="ad"><div class="boxes">5</div><script id="s">6</script>'
    picks = {
        ("nav",): "<nav>n</nav>", ("#ad",): '<div id="ad" class="box wide">1<div>2</div></div>\n<img id="ad">', (".box",): '<div id="ad" class="box wide">1<div>2</div></div>',
        ("p",): '<p class="x">3\n<p>4</p>', (".x",): '<p class="x">3', ("#s",): '<script id="s">6</script>', ("nav", ".boxes"): '<nav>n</nav>\n<div class="boxes">5</div>', ("#none",): "",
    }
    for selectors, want in picks.items():
        assert evaluate([page], only_elements(F.col("v"), *selectors)) == [want], selectors
    assert evaluate([page], without_selected(F.col("v"), "nav", "#ad", "p", ".boxes")) == ['<script id="s">6</script>']
