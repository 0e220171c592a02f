import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom.llm import gam, html_blocks, licenses, secret_scan
from pageloom.llm.common import fold
from pageloom.llm.queries import QUERIES

# ---- quality


def test_model_finds_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.train(x, y)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.9
    assert any({a, b} == {0, 1} for a, b, _ in model.pairs)


def test_model_of_one_class_or_none():
    assert gam.train(np.empty((0, 3)), np.empty(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert (gam.train(np.ones((9, 3)), np.ones(9)).score(np.zeros((1, 3))) > 0.8).all()


def test_features_do_not_depend_on_blocks(monkeypatch, prose):
    text = prose(1, 300) + "!! $$$ Äb 12\n| x |"
    whole = gam.features(text)
    monkeypatch.setattr(gam, "_BLOCK", 11)
    assert gam.features(text) == pytest.approx(whole)
    assert len(whole) == len(gam.FEATURES) and gam.features("") == [0.0] * len(whole)
    assert all(np.isfinite(gam.features(t)).all() for t in (" ", "\n", "$", "é", "\x00"))


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op6_quality"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    held = rows.filter("held_out").join(labels, "doc_id").filter("quality is not null")
    assert held.filter(F.col("predicted") == F.col("quality")).count() > 0.97 * held.count()
    assert rows.filter(F.col("score").isNull() | ~F.col("score").between(0, 1)).count() == 0


def test_quality_edges(spark, frame, edges):
    labels = spark.createDataFrame(
        [(5, 1, "x"), (6, 0, "x"), (6, 0, "x"), (7, None, "x"), (None, 1, "x"), (2, 0, "x")], "doc_id bigint, quality int, text string"
    )
    model = gam.fit_quality(frame(edges), labels, fold(3) != 1)
    scored = gam.score_quality(frame(edges), model)
    assert scored.count() == len(edges) and scored.filter("score is null").count() == 0
    assert gam.keep_good(frame(edges), labels).columns == frame(edges).columns
    nothing = labels.limit(0)
    assert gam.score_quality(frame([]), gam.fit_quality(frame([]), nothing)).count() == 0


# ---- main text


def test_unseen_pages():
    tree = html_blocks.train()
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>"</script></head>
    <body class="page with-sidebar"><div class="site-header"><a href=/>Home</a></div>
    <div class="cookie-banner"><p>This site uses cookies to keep you signed in and to measure how many people read it.</p></div>
    <div class="layout"><div class="article-body"><h1>Rain &amp; wind</h1><p>It rained   for
    nine days, and the river rose by two metres before the dam was opened at last.</p><p>No.</p>
    <p title="a>b">Later 3 &lt; 4 boats &#x2014; or five &mdash; came back.<br>All of them.</p>
    <!-- <p>hidden</p> --><div class="advert"><p>Buy new boots today and get the second pair for half of the price.</p></div>
    <form><label>Mail</label><input name=q><p>Sign up to hear from us every week, free of charge and without obligation.</p></form></div>
    <div id="comments"><h3>2 comments</h3><p>I saw it myself, the water stood as high as the second step of my house.</p></div></div>
    <aside><p>Other stories that people read this week, about boats and about dams.</p></aside>
    <footer><p>All rights reserved by the publisher and its partners.</p></footer></body></html>"""
    assert html_blocks.main_text(page, tree) == (
        "Rain & wind\nIt rained for nine days, and the river rose by two metres before the dam was opened at last.\n"
        "No.\nLater 3 < 4 boats — or five — came back. All of them."
    )


def test_articles_of_the_table(spark, data):
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    for r in QUERIES["op5_html"](spark, data).collect():
        article = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S).group(1)
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", article).replace("<br>", " "))
        want = "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)
        assert r.text == want and r.n_chars == len(want)


def test_odd_markup_is_linear():
    tree = html_blocks.train()
    for piece in ("<a ", "<p>x ", "<div>", "</p>", "<!--", "<b>x", '<p a="', "&amp", "<script>"):
        html_blocks.main_text(piece * 20_000, tree)


def test_html_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain words only"), (3, "u", "<p>"), (None, "u", "<article><p>One.</p></article>")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, text string, n_chars int")
    got = {(r.page_id, r.html): (r.text, r.n_chars) for r in html_blocks.extract_text(pages).collect()}
    assert got[1, None] == got[2, ""] == got[3, "<p>"] == ("", 0)
    assert got[None, rows[4][2]] == ("One.", 4)
    assert html_blocks.extract_text(pages.limit(0)).count() == 0


# ---- secrets


@pytest.fixture(scope="module")
def forest(spark):
    return secret_scan.train_forest(secret_scan.labelled_findings(spark, each=30))


def test_held_out_findings(spark):
    table = secret_scan.labelled_findings(spark, each=30)
    part = secret_scan.train_forest(table.filter("id % 5 <> 0"))
    rest = table.filter("id % 5 = 0").withColumnRenamed("id", "doc_id").cache()
    hits = {r.doc_id for r in secret_scan.scan_secrets(rest, part, path=F.col("path")).collect()}
    right = [(r.doc_id in hits) == bool(r.label) for r in rest.collect()]
    assert sum(right) > 0.95 * len(right)


SECRET = "9f2c4e6a8b0d1f3a5c7e9b1d3f5a7c9e0b2d4f6a"


def test_scan_and_mask(frame, edges, forest):
    rows = edges + [
        (10, f'first line\nthen token = "{SECRET}" and more\nlast {SECRET}'),
        (11, f"see commit {SECRET} for the change"),
        (12, "Geschwindigkeitsbegrenzungen und internationalisation 4785380592391139"),
        (None, f'password: "{SECRET}"'),
    ]
    found = secret_scan.scan_secrets(frame(rows), forest, path=F.col("source")).collect()
    assert {(r.doc_id, r.line, r.secret) for r in found if r.doc_id} == {(10, 2, SECRET)}
    assert [r.secret for r in found if r.doc_id is None] == [SECRET]
    masked = secret_scan.redact_secrets(frame(rows), forest)
    by_id = {r.doc_id: r for r in masked.collect()}
    assert masked.columns == frame(rows).columns and masked.count() == len(rows)
    assert by_id[10].text == f'first line\nthen token = "[SECRET]" and more\nlast [SECRET]'
    assert by_id[10].n_chars == len(by_id[10].text) and by_id[11].text == rows[-3][1] and by_id[1].text is None
    assert secret_scan.scan_secrets(frame([]), forest).count() == 0


def test_rows_are_masked_by_their_own_texts(frame, forest):
    """Rows without an id share nothing, and no column name is taken."""
    line = f'then token = "{SECRET}" and more'
    rows = [(None, line), (None, "of " + SECRET[:6] + " alone"), (7, line), (7, "no secret"), (None, None), (8, "")]
    extra = "row int, key int, found string, place string, masked string, hash int, __id int, __found string"
    masked = secret_scan.redact_secrets(frame(rows, extra), forest)
    assert masked.columns == frame(rows, extra).columns
    clean = line.replace(SECRET, "[SECRET]")
    want = [(None, clean), rows[1], (7, clean), *rows[3:]]
    assert sorted(((r.doc_id, r.text) for r in masked.collect()), key=str) == sorted(want, key=str)


def test_main_path_has_no_python(frame, forest):
    plan = secret_scan.redact_secrets(frame([(1, "a")]), forest)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---- licences


def test_notices_and_inheritance(spark):
    rows = [
        ("a/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software. MIT License"),
        ("a/b/c/x.py", "code without notice"), ("a/b/COPYING.txt", "Licensed under the Apache License, Version 2.0."),
        ("a/y.py", None), ("z.py", "nothing"), (None, "Licensed under CC BY-NC 4.0."), ("d/w.py", "x\nReleased under the MIT License.\n" + "y " * 90),
        ("d/v.py", "no"), ("a/b/c/x.py", "code without notice"), ("d/LICENSE", "all rights reserved"),
    ]
    files = spark.createDataFrame([(*r, 1, "n") for r in rows], "path string, text string, score int, notice string")
    got = sorted(((r.path, r.license, r.origin, r.declared_in) for r in licenses.scan_licenses(files).collect()), key=str)
    assert got == sorted(
        [
            ("a/LICENSE", "MIT", "own", "a/LICENSE"), ("a/b/COPYING.txt", "Apache-2.0", "own", "a/b/COPYING.txt"),
            ("a/b/c/x.py", "Apache-2.0", "inherited", "a/b/COPYING.txt"), ("a/b/c/x.py", "Apache-2.0", "inherited", "a/b/COPYING.txt"),
            ("a/y.py", "MIT", "inherited", "a/LICENSE"), ("z.py", None, None, None), (None, "CC-BY-NC-4.0", "own", None),
            ("d/w.py", "MIT", "own", "d/w.py"), ("d/v.py", None, None, None), ("d/LICENSE", None, None, None),
        ],
        key=str,
    )
    assert licenses.scan_licenses(files.limit(0)).count() == 0
    plan = licenses.scan_licenses(files)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan


def test_standard_texts_headers_and_tags(spark):
    """Texts, headers and tags as they are found in the wild, wrapped and commented."""
    import textwrap

    def comment(text, mark):
        return "\n".join(f"{mark} {line}".rstrip() for line in textwrap.wrap(text, 70))

    apache = (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    )
    gpl = (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    )
    code = "\n\nimport os\n\n\ndef run(path, other):\n    return os.listdir(path) + other\n" * 5
    tag = "SPDX-License-Identifier:"
    rows = [(f"full/{n}/x", "Copyright (c) 2020 Jane Doe\n\n" + t, n) for n, t in licenses.full_texts()] + [
        ("h/apache.py", "# Copyright 2021 Somebody\n#\n" + comment(apache, "#") + code, "Apache-2.0"),
        ("h/gpl.py", comment(gpl, " *") + code, "GPL-3.0"), ("s/a.c", f"// {tag} MIT" + code, "MIT"),
        ("s/b.c", f"/* {tag} GPL-2.0-or-later */" + code, "GPL-2.0"), ("s/c.c", f"# {tag} Apache-2.0" + code, "Apache-2.0"),
        ("s/d.c", "the licence of the text and of the words is a matter for the owner" + code, None),
    ]
    files = spark.createDataFrame([r[:2] for r in rows], "path string, text string")
    got = {r.path: r.license if r.origin == "own" else None for r in licenses.scan_licenses(files).collect()}
    assert got == {path: name for path, _, name in rows}


def test_licences_equal_sql(spark, data):
    import duckdb

    from pageloom.llm.queries import ORACLES

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{data}/documents.parquet'")
    want = con.execute(ORACLES["op3_licenses"]).fetchall()
    assert sorted(map(tuple, QUERIES["op3_licenses"](spark, data).collect()), key=str) == sorted(want, key=str)
