"""License scans: TF-IDF cosine of notices to templates, inherited from the nearest directory.

A notice is a sentence with a word about licensing. Equal notices are scored
once, so that a line which a third of all files share is one row. Whole texts,
leading comments and paragraphs are compared as such with standard headers and
full texts, and SPDX tags are read as they stand.
"""

from __future__ import annotations

from functools import reduce
from operator import or_
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import whole_text

# How licences are usually named in notices; one licence may have several.
TEMPLATES = (
    ("MIT", "released under the mit license"),
    ("MIT", "permission is hereby granted free of charge to any person obtaining a copy of this software mit license"),
    ("Apache-2.0", "licensed under the apache license version 2.0"),
    ("GPL-2.0", "this work is licensed under the gnu general public license version 2"),
    ("GPL-3.0", "this work is licensed under the gnu general public license version 3"),
    ("LGPL-3.0", "this work is licensed under the gnu lesser general public license version 3"),
    ("AGPL-3.0", "this work is licensed under the gnu affero general public license version 3"),
    ("MPL-2.0", "subject to the terms of the mozilla public license version 2.0"),
    ("BSD-2-Clause", "released under the bsd 2 clause simplified license"),
    ("BSD-3-Clause", "released under the bsd 3 clause new license"),
    ("ISC", "released under the isc license"),
    ("Unlicense", "released into the public domain under the unlicense"),
    ("CC0-1.0", "dedicated to the public domain under cc0 1.0 universal license"),
    ("CC-BY-4.0", "licensed under cc by 4.0"),
    ("CC-BY-4.0", "licensed under a creative commons attribution 4.0 international license"),
    ("CC-BY-SA-4.0", "licensed under cc by sa 4.0"),
    ("CC-BY-NC-4.0", "licensed under cc by nc 4.0"),
    ("CC-BY-NC-4.0", "licensed under a creative commons attribution noncommercial 4.0 international license"),
    ("CC-BY-ND-4.0", "licensed under cc by nd 4.0"),
)

CUES = "(licen[sc]e|spdx|copyright|public domain|redistribution|hereby granted)"
#: Plain words of which every cue holds one; looked for before any expression is.
CUE_WORDS = ("licen", "spdx", "copyright", "public domain", "redistribution", "hereby granted")
SENTENCES = "\n+|[.!?][ \t\r]+"
TERMS = "[a-z0-9]+(?:[.][0-9]+)*"
FILE_NAMES = "(?i)(^|/)(licen[sc]e|copying|notice|unlicense)([.-][^/]*)?$"
THRESHOLD = 0.6


_GNU = (
    "this program is free software you can redistribute it and/or modify it under the terms of the gnu {0}general public "
    "license as published by the free software foundation either version {1} of the license or at your option any later version"
)
_GNU_REST = (
    " this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty "
    "of merchantability or fitness for a particular purpose see the gnu {0}general public license for more details you should "
    "have received a copy of the gnu {0}general public license along with this program if not see http www gnu org licenses"
)
_GNUS = (("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-3.0", "lesser ", "3"), ("AGPL-3.0", "affero ", "3"))
_APACHE = (
    "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the "
    "license you may obtain a copy of the license at http www.apache.org licenses license 2.0"
)
_APACHE_REST = (
    " unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as "
    "is basis without warranties or conditions of any kind either express or implied see the license for the specific language "
    "governing permissions and limitations under the license"
)
# Standard headers, the naming paragraph alone and the whole.
HEADERS = (
    ("Apache-2.0", _APACHE), ("Apache-2.0", _APACHE + _APACHE_REST),
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not "
     "distributed with this file you can obtain one at https mozilla.org mpl 2.0"),
    *((name, (_GNU + rest).format(kind, version)) for name, kind, version in _GNUS for rest in ("", _GNU_REST)),
)
BLOCK_THRESHOLD = 0.8
PARAGRAPHS = r"\n[^\p{L}\p{N}\n]*(?=\n)"
LEADING_COMMENT = r"^(?:[ \t]*(?:#|//|/?[*]|;|--|<!--)[^\n]*(?:\n|$))+"
SPDX = r"(?i)SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+() \t-]*[A-Za-z0-9.+)])"


def full_texts() -> list[tuple[str, str]]:
    """(license, text) of the standard texts beside this module."""
    folder = Path(__file__).with_name("license_texts")
    return [(p.stem, p.read_text(encoding="utf-8")) for p in sorted(folder.glob("*.txt"))]


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERMS), F.lit(0))


def notices(files: DataFrame) -> DataFrame:
    """(file columns, notice, words): every sentence with a cue and its number of terms."""
    sentences = F.filter(F.split("text", SENTENCES), lambda s: F.lower(s).rlike(CUES))
    found = files.select("path", F.explode(sentences).alias("notice"))
    return found.withColumn("words", F.size(terms(F.col("notice"))))


def judge_notices(found: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(notice, license, score) of the distinct notices that come near a template.

    Weights are term counts times ln((1 + N) / (1 + df)) + 1, with N and df
    over all notices, repeats included. The best template counts, of equals
    the first name.
    """
    spark = found.sparkSession
    distinct = found.groupBy("notice").agg(F.count(F.lit(1)).alias("n"))
    counted = distinct.select("notice", "n", F.explode(terms(F.col("notice"))).alias("term"))
    counted = counted.groupBy("notice", "n", "term").agg(F.count(F.lit(1)).alias("tf"))
    known = counted.groupBy("term").agg(F.sum("n").alias("df"))
    total = distinct.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).scalar()
    rows = [(i, name, text) for i, (name, text) in enumerate(TEMPLATES)]
    templates = spark.createDataFrame(rows, "template int, license string, text string")
    parts = templates.select("template", "license", F.explode(terms(F.col("text"))).alias("term"))
    parts = parts.groupBy("template", "license", "term").agg(F.count(F.lit(1)).alias("tf"))

    def weighed(table: DataFrame) -> DataFrame:
        idf = F.log((1 + total) / (1 + F.coalesce("df", F.lit(0)))) + 1
        return table.join(known, "term", "left").withColumn("w", F.col("tf") * idf).drop("df", "tf")

    mine, theirs = weighed(counted), weighed(parts)
    norms = mine.groupBy("notice").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    sizes = theirs.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    small = F.broadcast(theirs.join(sizes, "template").withColumnRenamed("w", "v"))  # the fixed templates
    dots = mine.join(small, "term").groupBy("notice", "template", "license", "size")
    dots = dots.agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    scored = dots.join(norms, "notice").withColumn("score", F.round(F.col("dot") / (F.col("norm") * F.col("size")), 6))
    best = scored.groupBy("notice").agg(
        F.min(F.struct((-F.col("score")).alias("low"), "license")).alias("best")
    )
    return best.select("notice", F.col("best.license").alias("license"), (-F.col("best.low")).alias("score")).filter(
        F.col("score") >= threshold
    )


def judge_blocks(rows: DataFrame, threshold: float = BLOCK_THRESHOLD) -> DataFrame:
    """(path, license, score, words) of whole texts, leading comments and
    paragraphs with a cue that come near a standard header or full text.

    Equal blocks of all files add up under one hash, which leaves their cosine
    as it is. Weights are those of notices, with N and df over the templates.
    """
    spark = rows.sparkSession
    blocks = F.concat(
        F.array(F.col("text"), F.regexp_extract("text", LEADING_COMMENT, 0)), F.split("text", PARAGRAPHS)
    )
    blocks = F.array_distinct(F.transform(F.filter(blocks, lambda b: F.lower(b).rlike(CUES)), lambda b: F.trim(b)))
    found = rows.select("path", F.explode(blocks).alias("block")).select(
        "path", terms(F.col("block")).alias("terms"), F.xxhash64("block").alias("block")
    )
    found = materialize(found, "licence-blocks")
    names = [*HEADERS, *full_texts()]
    templates = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(names)], "template int, text string")
    parts = templates.select("template", F.explode(terms(F.col("text"))).alias("term"))
    parts = parts.groupBy("template", "term").agg(F.count(F.lit(1)).alias("tf"))
    rare = F.log(F.lit(1.0 + len(names))) + 1
    idf = parts.groupBy("term").agg((rare - F.log(1.0 + F.count(F.lit(1)))).alias("idf"))
    theirs = parts.join(idf, "term").withColumn("v", F.col("tf") * F.col("idf"))
    sizes = theirs.groupBy("template").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("size"))
    unit = F.map_from_entries(F.collect_list(F.struct("template", F.col("v") / F.col("size"))))
    unit = theirs.join(sizes, "template").groupBy("term", "idf").agg(unit.alias("units"))
    unit = unit.select("term", "idf", F.array(*[F.coalesce(F.col("units")[i], F.lit(0.0)) for i in range(len(names))]).alias("unit"))
    counted = found.select("block", F.explode("terms").alias("term")).groupBy("block", "term").agg(F.count(F.lit(1)).alias("tf"))
    mine = counted.join(F.broadcast(unit), "term", "left")  # the terms of the fixed templates
    mine = mine.withColumn("w", F.col("tf") * F.coalesce("idf", rare))
    dots = [F.sum(F.col("w") * F.col("unit")[i]).alias(f"d{i}") for i in range(len(names))]
    sums = mine.groupBy("block").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), *dots)
    scores = F.array_min(
        F.array(
            *[
                F.struct((-F.round(F.coalesce(f"d{i}", F.lit(0.0)) / F.col("norm"), 6)).alias("low"), F.lit(name).alias("license"))
                for i, (name, _) in enumerate(names)
            ]
        )
    )
    judged = sums.select("block", scores.alias("best")).filter(-F.col("best.low") >= threshold)
    return found.select("path", "block", F.size("terms").alias("words")).join(judged, "block").select(
        "path", F.col("best.license").alias("license"), (-F.col("best.low")).alias("score"), "words"
    )


def spdx_tags(rows: DataFrame) -> DataFrame:
    """(path, license, score, words) of the licences that SPDX tags name, with score 1.

    Each known name of an expression counts, whatever ``AND``, ``OR`` or ``WITH``
    stands between; GNU names lose their "only" or "or later". Other words after
    a tag name nothing.
    """
    known = sorted({name for name, _ in (*TEMPLATES, *HEADERS, *full_texts())})
    tag = F.explode(F.regexp_extract_all("text", F.lit(SPDX), F.lit(1)))
    names = F.regexp_extract_all("tag", F.lit("[A-Za-z0-9.+-]+"), F.lit(0))
    plain = F.transform(names, lambda n: F.regexp_replace(n, r"(?i)(GPL-[0-9.]*[0-9])(-only|-or-later|[+])$", "$1"))
    found = rows.select("path", tag.alias("tag"))
    found = found.select("path", (3 + F.size(terms(F.col("tag")))).alias("words"), F.explode(plain).alias("license"))
    return found.filter(F.col("license").isin(known)).select("path", "license", F.lit(1.0).alias("score"), "words")


def with_cues(rows: DataFrame) -> DataFrame:
    """The rows with a cue anywhere in their text. Sentences, blocks and tags
    without one name no licence, so all else reads this table."""
    lowered = F.lower("text")
    return rows.filter(reduce(or_, [lowered.contains(word) for word in CUE_WORDS])).filter(F.lower("text").rlike(CUES))


def scan_licenses(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(path, license, score, origin, declared_in) of every row of ``files`` (path, text).

    ``origin`` is ``own`` if a notice, SPDX tag, header or full text names the licence (the best
    score, then the first name), ``inherited`` if the nearest directory above
    with a licence file gives it, else null. A licence file is one so named, or
    one of whose terms at least half are in notices that name a licence (or in one such block); of several in a
    directory the first path counts. Null texts are empty; a null path has no
    directory. Repeated paths are one file; repeated rows stay.

    All texts are read once, for cues; what has one is written down and read by
    the rest.
    """
    files = files.select("path", whole_text().alias("text"))
    rows = materialize(with_cues(files), "licence-cues")
    found = materialize(notices(rows), "licence-notices")
    named = found.join(judge_notices(found, threshold), "notice")
    lines = named.select("path", "license", "score", "words", F.col("words").alias("line_words"))
    larger = judge_blocks(rows).union(spdx_tags(rows)).withColumn("line_words", F.lit(0))
    own = lines.union(larger).groupBy("path").agg(
        F.min(F.struct((-F.col("score")).alias("low"), "license")).alias("best"),
        F.greatest(F.sum("line_words"), F.max("words")).alias("noticed"),
    )
    own = own.select(
        F.col("path").alias("own_path"), F.col("best.license").alias("own"), (-F.col("best.low")).alias("own_score"), "noticed"
    )
    own = materialize(own, "licence-own")
    sized = rows.select("path", F.size(terms(F.col("text"))).alias("terms"))
    same = F.col("path").eqNullSafe(F.col("own_path"))
    marked = files.select("path").join(own, same, "left")
    whole = F.col("path").rlike(FILE_NAMES) | (2 * F.col("noticed") >= F.col("terms"))
    declared = (
        sized.join(own, same)
        .filter(F.col("path").contains("/") & whole)
        .groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("dir"))
        .agg(F.min(F.struct("path", "own", "own_score")).alias("file"))
    )
    pieces = F.split("path", "/")
    above = F.transform(
        F.filter(F.sequence(F.lit(0), F.size(pieces) - 1), lambda i: i > 0),
        lambda i: F.array_join(F.slice(pieces, F.lit(1), i), "/"),
    )
    bare = marked.filter(F.col("own").isNull() & F.col("path").isNotNull()).select("path").distinct()
    inherited = (
        bare.select("path", F.explode(above).alias("dir"))
        .join(declared, "dir")
        .groupBy(F.col("path").alias("heir"))
        .agg(F.max_by("file", F.length("dir")).alias("file"))
    )
    out = marked.join(inherited, F.col("path") == F.col("heir"), "left")
    return out.select(
        "path",
        F.coalesce("own", "file.own").alias("license"),
        F.coalesce("own_score", "file.own_score").alias("score"),
        F.when(F.col("own").isNotNull(), "own").when(F.col("file").isNotNull(), "inherited").alias("origin"),
        F.when(F.col("own").isNotNull(), F.col("path")).otherwise(F.col("file.path")).alias("declared_in"),
    )


_TEMPLATE_ROWS = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(TEMPLATES))

#: The same over ``documents``, whose paths are source, language and id.
SQL = f"""
with files as (
    select concat_ws('/', source, lang, cast(doc_id as varchar)) as path, coalesce(text, '') as text from documents
), templates(template, license, text) as (values {_TEMPLATE_ROWS}),
found as (
    select path, notice, len(regexp_extract_all(lower(notice), '{TERMS}')) as words
    from (select path, unnest(string_split_regex(text, '{SENTENCES}')) as notice from files)
    where regexp_matches(lower(notice), '{CUES}')
), different as (select notice, count(*) as n from found group by notice),
counted as (
    select notice, n, term, count(*) as tf
    from (select notice, n, unnest(regexp_extract_all(lower(notice), '{TERMS}')) as term from different) group by all
), known as (select term, sum(n) as df from counted group by term),
total as (select coalesce(sum(n), 0) as total from different),
parts as (
    select template, license, term, count(*) as tf
    from (select template, license, unnest(regexp_extract_all(text, '{TERMS}')) as term from templates) group by all
), mine as (
    select notice, term, tf * (ln((1 + total) / (1 + coalesce(df, 0))) + 1) as w
    from counted left join known using (term), total
), theirs as (
    select template, license, term, tf * (ln((1 + total) / (1 + coalesce(df, 0))) + 1) as v
    from parts left join known using (term), total
), norms as (select notice, sqrt(sum(w * w)) as norm from mine group by notice),
sizes as (select template, sqrt(sum(v * v)) as size from theirs group by template),
dots as (
    select notice, template, license, sum(w * v) as dot from mine join theirs using (term) group by all
), scored as (
    select notice, license, round(dot / (norm * size), 6) as score
    from dots join norms using (notice) join sizes using (template)
), judged as (
    select notice, license, score
    from (select *, row_number() over (partition by notice order by score desc, license) as k from scored)
    where k = 1 and score >= {THRESHOLD}
), own as (
    select path, license as own, score as own_score, noticed
    from (
        select path, license, score, sum(words) over (partition by path) as noticed,
            row_number() over (partition by path order by score desc, license) as k
        from found join judged using (notice)
    ) where k = 1
), marked as (
    select path, len(regexp_extract_all(lower(text), '{TERMS}')) as terms, own, own_score, noticed
    from files left join own using (path)
), declared as (
    select dir, path as file_path, own as file_own, own_score as file_score
    from (
        select *, regexp_replace(path, '/[^/]*$', '') as dir,
            row_number() over (partition by regexp_replace(path, '/[^/]*$', '') order by path) as k
        from marked
        where own is not null and contains(path, '/')
            and (regexp_matches(path, '{FILE_NAMES}') or 2 * noticed >= terms)
    ) where k = 1
), inherited as (
    select path, file_path, file_own, file_score
    from (
        select *, row_number() over (partition by path order by length(dir) desc) as k
        from (
            select distinct path, unnest(list_transform(range(1, len(string_split(path, '/'))),
                lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) as dir
            from marked where own is null
        ) join declared using (dir)
    ) where k = 1
)
select m.path, coalesce(own, file_own) as license, coalesce(own_score, file_score) as score,
    case when own is not null then 'own' when file_own is not null then 'inherited' end as origin,
    case when own is not null then m.path else file_path end as declared_in
from marked m left join inherited i on m.path = i.path
"""
