"""Phrases whose words stand together more often than their parts suggest.

The corpus becomes count streams, one per phrase length. Of each stream two
orders matter: sorted by all words but the last (prefix order) and by all words
but the first (suffix order). In prefix order a phrase lies beside its first
part, in suffix order beside its last, so merge joins that advance through both
streams in lockstep give the counts of left part, right part and extensions; no
table of phrases is looked up by hash. Phrases of three words join the stream
of two-word phrases only, which already carries the counts of its own parts.

Counting is two passes over the texts: words and pairs, then triples. A phrase
is at least as rare as each of its parts, so the second pass drops a triple if
one of its pairs is surely too rare. Pairs frequent enough are marked in a bit
table of fixed size: a pair without its bit is too rare, a bit set by another
pair merely keeps a row that the exact count drops later.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import heavy_keys
from ..session import materialize
from .common import bound_batches, whole_text

#: Bytes of text counted at once by a task.
CHUNK = 16 << 20
#: Bits of the table of frequent pairs (8 MB), whatever the corpus.
BITS = 1 << 26
#: Parts into which a language's phrases are dealt before its best are chosen.
SALTS = 64

SEPARATOR = b"\xff"  # occurs in no UTF-8 text
_BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
_UPPER = bytes(range(0x41, 0x5B))
#: Lower case for A-Z, one separator for all breaks, blanks for tabs.
_TABLE = bytes.maketrans(_UPPER + _BREAKS + b"\t", _UPPER.lower() + SEPARATOR * len(_BREAKS) + b" ")
_COUNTS = pa.schema([("lang", pa.string()), ("size", pa.int8()), ("phrase", pa.string()), ("n", pa.int64())])


def _chunks(text: bytes) -> Iterator[bytes]:
    """``text`` cut at blanks or separators into pieces of about ``CHUNK`` bytes."""
    start = 0
    cut = re.compile(rb"[ \xff]")
    while start < len(text):
        found = cut.search(text, start + CHUNK) if len(text) - start > CHUNK else None
        end = found.start() if found else len(text)
        yield text[start:end]
        start = end


class Coded:
    """A chunk's words as numbers; 0 stands for a separator.

    ``carried`` words at the front were counted with the chunk before, and are
    there so that phrases across the cut are found.
    """

    def __init__(self, tokens: list[bytes], carried: int):
        vocabulary: defaultdict[bytes, int] = defaultdict(count().__next__)
        vocabulary[SEPARATOR]
        self.codes = np.fromiter(map(vocabulary.__getitem__, tokens), np.int64, len(tokens))
        self.words = list(vocabulary)
        self.column = pa.array([b"", *self.words[1:]], pa.binary())
        self.carried = carried

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of all pairs, per pair of neighbours its place in them (-1: not
        one), and whether it ends behind what was carried."""
        left, right = self.codes[:-1], self.codes[1:]
        whole = (left > 0) & (right > 0)
        distinct, place = np.unique(left[whole] * len(self.words) + right[whole], return_inverse=True)
        places = np.full(len(left), -1, np.int64)
        places[whole] = place
        return distinct, places, np.arange(1, len(self.codes)) >= self.carried

    def phrase(self, *codes: np.ndarray) -> pa.Array:
        parts = [self.column.take(pa.array(c)) for c in codes]
        return pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary())).cast(pa.string())


def _rows(lang: str, size: int, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    n = len(phrases)
    columns = [pa.array([lang] * n, pa.string()), pa.array(np.full(n, size, np.int8)), phrases, pa.array(counts, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, schema=_COUNTS)


def _words_and_pairs(lang: str, coded: Coded) -> Iterator[pa.RecordBatch]:
    new = coded.codes[coded.carried :]
    counts = np.bincount(new[new > 0], minlength=len(coded.words))
    present = np.flatnonzero(counts)
    yield _rows(lang, 0, pa.array([""], pa.string()), counts.sum(keepdims=True))
    yield _rows(lang, 1, coded.phrase(present), counts[present])
    distinct, places, new = coded.pairs()
    counts = np.bincount(places[new & (places >= 0)], minlength=len(distinct))
    kept = np.flatnonzero(counts)
    left, right = np.divmod(distinct[kept], len(coded.words))
    yield _rows(lang, 2, coded.phrase(left, right), counts[kept])


def _word_hash(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh32_intdigest(lang.encode())
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64)


def _slots(left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    """The bit of a pair, from the hashes of its words."""
    mixed = (left * np.uint64(0x9E3779B97F4A7C15)) ^ (right + (left >> np.uint64(31)))
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(32)) % np.uint64(bits)


def _triples(lang: str, coded: Coded, marked: np.ndarray) -> Iterator[pa.RecordBatch]:
    distinct, places, _ = coded.pairs()
    hashes = _word_hash(lang, coded.words)
    left, right = np.divmod(distinct, len(coded.words))
    slots = _slots(hashes[left], hashes[right], len(marked) * 8).astype(np.int64)
    likely = np.append((marked[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1, 0).astype(bool)
    first, second = places[:-1], places[1:]
    new = np.arange(2, len(coded.codes)) >= coded.carried
    at = np.flatnonzero(likely[first] & likely[second] & new)
    last = coded.codes[2:][at]
    triples, counts = np.unique(first[at] * len(coded.words) + last, return_counts=True)
    pair, third = np.divmod(triples, len(coded.words))
    yield _rows(lang, 3, coded.phrase(left[pair], right[pair], third), counts)


def _counter(emit, carry: int):
    """A function from batches of (lang, text) to partial counts of ``emit``."""

    def run(batches):
        for batch in batches:
            texts = defaultdict(list)
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                texts[lang].append(text.encode())
            for lang, parts in texts.items():
                tail: list[bytes] = []
                for chunk in _chunks(SEPARATOR.join(parts).translate(_TABLE)):
                    tokens = chunk.replace(SEPARATOR, b" \xff ").split()
                    if tokens:
                        yield from emit(lang, Coded(tail + tokens, len(tail)))
                        tail = (tail + tokens)[-carry:]

    return run


def _summed(partial: DataFrame, at_least: int) -> DataFrame:
    """Totals of at least ``at_least``. Tasks have combined their chunks, so a
    phrase comes once per chunk and no key is hot: rows go straight to their
    place, without another table of phrases in the sending task."""
    dealt = partial.repartition("lang", "size", "phrase")
    totals = dealt.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))
    return totals.filter((F.col("n") >= at_least) | (F.col("size") == 0))


def _frequent_pairs(pairs: DataFrame, bits: int) -> np.ndarray:
    """The bit table of ``pairs`` as bytes: bits are gathered per 64 by Spark, at
    most ``bits / 64`` rows come to the driver."""

    def mark(batches):
        for batch in batches:
            both = [p.encode().split(b" ") for p in batch.column("phrase").to_pylist()]
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in set(langs):
                at = np.flatnonzero(langs == lang)
                left = _word_hash(lang, [both[i][0] for i in at])
                right = _word_hash(lang, [both[i][1] for i in at])
                slots = np.unique(_slots(left, right, bits))
                set_ = (np.uint64(1) << (slots % np.uint64(64))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((slots >> np.uint64(6)).astype(np.int64)), pa.array(set_)], ["slot", "bits"])

    marks = pairs.select("lang", "phrase").mapInArrow(mark, "slot long, bits long")
    rows = marks.groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[rows.column("slot").to_numpy()] = rows.column("bits").to_numpy()
    return table.view(np.uint8)


def count_phrases(
    documents: DataFrame, at_least: int = 10, text_col: str = "text", lang_col: str = "lang", bits: int = BITS
) -> DataFrame:
    """(lang, size, phrase, n): phrases of one to three words that occur at least
    ``at_least`` times, and per language one row of size 0 with all its words."""
    spark = documents.sparkSession
    bound_batches(spark)
    rows = documents.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), whole_text(text_col).alias("text"))
    schema = "lang string, size byte, phrase string, n long"
    short = materialize(_summed(rows.mapInArrow(_counter(_words_and_pairs, 1), schema), at_least), "phrase-counts")
    marked = spark.sparkContext.broadcast(_frequent_pairs(short.filter("size = 2"), bits))
    triples = _counter(lambda lang, coded: _triples(lang, coded, marked.value), 2)
    long = materialize(_summed(rows.mapInArrow(triples, schema), at_least), "phrase-counts")
    marked.destroy()
    return short.unionByName(long)


def _lockstep(stream: DataFrame, parts: DataFrame, part: str) -> DataFrame:
    """``stream`` with the columns of ``parts``, whose phrase is its column ``part``.

    A merge join of two sorted streams. A part with a large share of the stream
    (a very common word) is dealt into salts on both sides.
    """
    heavy = heavy_keys(stream, ["lang", part])
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    spread = F.pmod(F.xxhash64("phrase"), salts).cast("int")
    left = stream.join(F.broadcast(heavy), ["lang", part], "left").withColumn("_salt", spread).drop("_salts")
    copies = F.explode(F.sequence(F.lit(0), salts - 1))
    right = parts.withColumnRenamed("phrase", part).join(F.broadcast(heavy), ["lang", part], "left")
    right = right.withColumn("_salt", copies).drop("_salts")
    return left.join(right.hint("merge"), ["lang", part, "_salt"]).drop("_salt")


def _score(a: str, left: str, right: str):
    """floor(1000000 a a / (l r)) without rounding: integers of up to 38 digits."""
    whole = "decimal(18,0)"
    above = F.col(a).cast(whole) * F.col(a).cast(whole) * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", above, F.col(left).cast(whole) * F.col(right).cast(whole))


def collocations(
    documents: DataFrame,
    at_least: int = 10,
    inside: int = 50,
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """Candidates (lang, phrase, size, a, l, r, n, score) with ``kept``.

    Texts are lower-cased (A-Z only) and cut at ``. , ; : ! ?`` and line ends
    into pieces, these at blanks and tabs into words; phrases lie within one
    piece. ``a`` counts the phrase, ``l`` and ``r`` the two parts of its cut
    with the lowest score (the first on ties), ``n`` all words of its language.
    ``kept`` is false for phrases of which a longer candidate takes up at least
    ``inside`` percent. Null and empty texts have no words, a null language is
    ``und``; repeated rows count as often as they are there; an empty table
    gives no rows; other columns are not read.
    """
    counts = count_phrases(documents, at_least, text_col, lang_col)
    size, words = F.col("size"), F.substring_index
    single = counts.filter("size = 1").select("lang", "phrase", "n")
    double = counts.filter("size = 2").select(
        "lang", "phrase", F.col("n").alias("a"), words("phrase", " ", 1).alias("head"), words("phrase", " ", -1).alias("tail")
    )
    triple = counts.filter("size = 3").select(
        "lang", "phrase", F.col("n").alias("a"), words("phrase", " ", 2).alias("head"), words("phrase", " ", -2).alias("tail")
    )
    # prefix order: beside the part without the last word; suffix order: without the first
    two = _lockstep(double, single.withColumnRenamed("n", "l"), "head")
    two = materialize(_lockstep(two, single.withColumnRenamed("n", "r"), "tail"), "collocation-pairs")
    heads = two.select("lang", "phrase", F.col("l").alias("l1"), F.col("a").alias("l2"))
    tails = two.select("lang", "phrase", F.col("a").alias("r1"), F.col("r").alias("r2"))
    three = _lockstep(_lockstep(triple, heads, "head"), tails, "tail")
    three = three.withColumns({"first": _score("a", "l1", "r1"), "second": _score("a", "l2", "r2")})
    three = materialize(
        three.select(
            "lang",
            "phrase",
            "head",
            "tail",
            "a",
            F.when(F.col("first") <= F.col("second"), F.col("l1")).otherwise(F.col("l2")).alias("l"),
            F.when(F.col("first") <= F.col("second"), F.col("r1")).otherwise(F.col("r2")).alias("r"),
            F.least("first", "second").alias("score"),
        ),
        "collocation-triples",
    )
    around = three.select("lang", F.explode(F.array("head", "tail")).alias("phrase"), F.col("a").alias("longer"))
    longest = around.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    two = two.join(longest.hint("merge"), ["lang", "phrase"], "left")
    covered = F.coalesce(F.lit(100) * F.col("longer") >= F.lit(inside) * F.col("a"), F.lit(False))
    both = two.select("lang", "phrase", F.lit(2).alias("size"), "a", "l", "r", _score("a", "l", "r").alias("score"), (~covered).alias("kept"))
    both = both.unionByName(three.select("lang", "phrase", F.lit(3).alias("size"), "a", "l", "r", "score", F.lit(True).alias("kept")))
    totals = counts.filter(size == 0).groupBy("lang").agg(F.sum("n").alias("n"))
    # one row per language, a side that has at most as many rows as there are languages
    return both.join(totals, "lang").select("lang", "phrase", "size", "a", "l", "r", "n", "score", "kept")


def best_collocations(candidates: DataFrame, k: int = 2000) -> DataFrame:
    """The ``k`` best kept candidates per language by score, then count, then
    phrase, with their ``rank``. The best of 64 parts of a language are chosen
    first, so that no task orders all of its phrases."""
    best = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    salted = candidates.filter("kept").withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    part = F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*best))
    leading = salted.withColumn("rank", part).filter(F.col("rank") <= k).drop("_salt", "rank")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*best))
    return leading.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= k)


#: The same by joins of all phrases in DuckDB.
SQL = r"""
WITH lowered AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
cut AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS words FROM lowered),
pieces AS MATERIALIZED (SELECT row_number() OVER () AS piece, lang, words FROM cut),
listed AS MATERIALIZED (
  SELECT lang, piece, list_filter(string_split_regex(words, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
placed AS MATERIALIZED (SELECT lang, piece, unnest(w) AS w1, unnest(range(1, len(w) + 1)) AS i FROM listed),
rows AS MATERIALIZED (
  SELECT lang, w1, lead(w1) OVER p AS w2, lead(w1, 2) OVER p AS w3 FROM placed WINDOW p AS (PARTITION BY piece ORDER BY i)),
grams AS MATERIALIZED (
  SELECT lang, 1 AS size, w1 AS phrase, count(*) AS c FROM rows GROUP BY 1, 2, 3
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM rows WHERE w2 IS NOT NULL GROUP BY 1, 2, 3
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM rows WHERE w3 IS NOT NULL GROUP BY 1, 2, 3),
totals AS (SELECT lang, sum(c)::BIGINT AS n FROM grams WHERE size = 1 GROUP BY 1),
frequent AS MATERIALIZED (SELECT lang, size, phrase, lang || ' ' || phrase AS id, c, string_split(phrase, ' ') AS w FROM grams WHERE c >= 10),
cuts AS MATERIALIZED (SELECT lang, size, phrase, c AS a, unnest(range(1, size)) AS k, w FROM frequent WHERE size > 1),
scored AS MATERIALIZED (
  SELECT x.lang, x.size, x.phrase, x.a, x.k, p.c AS l, q.c AS r,
    (1000000::HUGEINT * x.a * x.a) // (p.c::HUGEINT * q.c) AS score
  FROM cuts x
  JOIN frequent p ON p.id = x.lang || ' ' || array_to_string(x.w[1:x.k], ' ')
  JOIN frequent q ON q.id = x.lang || ' ' || array_to_string(x.w[x.k + 1:], ' ')),
lowest AS MATERIALIZED (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
around AS MATERIALIZED (
  SELECT lang, phrase, max(c) AS longer FROM (
    SELECT lang, w[1] || ' ' || w[2] AS phrase, c FROM frequent WHERE size = 3
    UNION ALL SELECT lang, w[2] || ' ' || w[3], c FROM frequent WHERE size = 3) GROUP BY 1, 2),
kept AS MATERIALIZED (
  SELECT x.* FROM lowest x LEFT JOIN around y ON x.size = 2 AND x.lang = y.lang AND x.phrase = y.phrase
  WHERE y.longer IS NULL OR 100 * y.longer < 50 * x.a),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT x.lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked x JOIN totals USING (lang) WHERE rank <= 2000
"""
