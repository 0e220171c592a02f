"""Search from stored postings: a query reads its own words, never a text.

The score of a row is how often the query's terms occur in its lower-cased text,
inside longer words too. A term holds no white space, so each occurrence lies
within one word, and the score is the sum over words of how often the word
occurs times how often it contains the term. Three tables are written once:

* ``words``: the vocabulary under each three-letter gram of a word. A term's
  candidates are the words under its first gram.
* ``postings``: word, id and count, with the columns that filters ask for,
  bucketed by slot. A word's slot is its hash; a very frequent word is dealt
  over as many slots as it needs, so no file holds one word of a whole corpus.
* ``results``: what a result shows, bucketed by id.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import _let
from ..session import materialize

GRAM = 3
#: Postings of one word in a slot, slots at most, and words that a plan may name.
SLOT_ROWS, MOST_SLOTS = 1_000_000, 20_000
FEW_WORDS = 2_000

_BLANK = r"[ \t\n\x0B\f\r]+"


@dataclass(frozen=True)
class SearchStore:
    words: DataFrame  # gram, leads, word, salts
    postings: DataFrame  # slot, word, id, n, domain[, ts]
    results: DataFrame  # id, title, url, description
    slots: int

    @property
    def dated(self) -> bool:
        return "ts" in self.postings.columns


def _words(text: str) -> Column:
    return F.filter(F.split(F.lower(F.col(text)), _BLANK), lambda w: w != "")


def _grams(word: Column) -> Column:
    """The distinct grams of a word; a shorter one is its own."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(word) - (GRAM - 1), F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(word, i, F.lit(GRAM))))


def _home(slots: int) -> Column:
    """The first slot of a word."""
    return F.pmod(F.xxhash64("word"), F.lit(slots))


def _save(df: DataFrame, name: str, folder: str, part: str, buckets: int, key: str, order: list[str]) -> None:
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(*order)
    writer.option("path", f"{folder}/{part}").option("compression", "zstd").mode("overwrite").saveAsTable(f"{name}_{part}")


def _counted(words: Column) -> Column:
    """``struct(word, n)`` of the distinct words of one row: heads of equal runs in order."""

    def runs(ordered: Column) -> Column:
        heads = F.filter(
            F.transform(ordered, lambda w, i: F.when((i == 0) | (w != F.get(ordered, i - 1)), i)), lambda i: i.isNotNull()
        )
        return _let(
            heads,
            lambda at: F.transform(
                at,
                lambda i, k: F.struct(
                    F.get(ordered, i).alias("word"),
                    (F.coalesce(F.get(at, k + 1), F.size(ordered)) - i).cast("bigint").alias("n"),
                ),
            ),
        )

    return _let(F.sort_array(words), runs)


def write_search_store(corpus: DataFrame, name: str, folder: str, slot_rows: int = SLOT_ROWS) -> SearchStore:
    """Write the tables ``name_words``, ``name_postings`` and ``name_results`` of
    ``corpus(id, title, url, description, text, domain[, ts])`` below ``folder``.

    Words are counted within their row, so a posting moves once, to its slot; the
    text is read once for the vocabulary and once for the postings. Rows that share
    an id have postings each, which queries add up. Rows with null or empty text
    have no postings and so match nothing.
    """
    spark = corpus.sparkSession
    beside = ["domain", *(["ts"] if "ts" in corpus.columns else [])]
    vocabulary = corpus.select(F.explode(F.array_distinct(_words("text"))).alias("word"))
    vocabulary = materialize(vocabulary.groupBy("word").agg(F.count(F.lit(1)).alias("rows")), "vocabulary")
    sizes = vocabulary.agg(F.sum("rows").alias("total"), F.count(F.lit(1)).alias("size")).first()
    total, size = sizes["total"] or 0, sizes["size"]
    slots = max(1, min(MOST_SLOTS, -(-total // slot_rows)))
    salts = F.least(F.ceil(F.col("rows") / slot_rows), F.lit(slots)).cast("int")
    vocabulary = vocabulary.select("word", salts.alias("salts"))
    grams = vocabulary.select(F.posexplode(_grams(F.col("word"))).alias("at", "gram"), "word", "salts")
    words = grams.select("gram", (F.col("at") == 0).alias("leads"), "word", "salts")
    _save(words, name, folder, "words", max(1, min(MOST_SLOTS, size // 50_000)), "gram", ["gram", "word"])
    # words that fill slots of their own are few: each has slot_rows postings
    frequent = vocabulary.filter("salts > 1")
    counted = corpus.select("id", *beside, F.inline(_counted(_words("text"))))
    dealt = counted.join(F.broadcast(frequent) if total // slot_rows <= 100_000 else frequent, "word", "left")
    further = F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1)))
    slot = F.pmod(_home(slots) + further, F.lit(slots))
    postings = dealt.select(slot.cast("int").alias("slot"), "word", "id", "n", *beside)
    _save(postings, name, folder, "postings", slots, "slot", ["slot", "word"])
    results = corpus.select("id", "title", "url", "description")
    _save(results, name, folder, "results", slots, "id", ["id"])
    return open_search_store(spark, name)


def open_search_store(spark: SparkSession, name: str) -> SearchStore:
    words, postings, results = (spark.table(f"{name}_{part}") for part in ("words", "postings", "results"))
    rows = spark.sql(f"DESCRIBE EXTENDED {name}_postings").filter("col_name = 'Num Buckets'").first()
    return SearchStore(words, postings, results, int(rows.data_type))


def _times(terms: list[str]) -> Column:
    """How often ``word`` contains the terms, each without overlap."""
    left = [F.length(F.replace("word", F.lit(term), F.lit(""))) for term in terms]
    return reduce(add, [((F.length("word") - size) / F.lit(len(term))).cast("bigint") for term, size in zip(terms, left)])


def _named(store: SearchStore, terms: list[str], times: Column, few: int) -> list | None:
    """The words that contain one of ``terms``, with their salts; None if they are
    more than ``few``. Terms shorter than a gram look through the vocabulary, each
    word of which leads one row."""

    def under(term: str) -> Column:
        return (F.col("gram") == term[:GRAM] if len(term) >= GRAM else F.col("leads")) & F.col("word").contains(term)

    most = few * len(terms)  # a word is met once per term at most
    found = store.words.filter(reduce(or_, [under(term) for term in terms])).limit(most + 1)
    found = found.select("word", _home(store.slots).cast("int").alias("home"), "salts", times.alias("times")).collect()
    distinct = {row.word: row for row in found}
    return list(distinct.values()) if len(found) <= most and len(distinct) <= few else None


def _postings_of(store: SearchStore, terms: list[str], times: Column, where: Column | None, few: int) -> DataFrame:
    """Postings of the words that contain one of ``terms``, with ``times``. Up to
    ``few`` words are named in the plan, so that only their slots are read; for
    more, the postings are read where they lie and their words looked at: none is
    moved to meet its word."""
    rows = store.postings if where is None else store.postings.filter(where)
    named = _named(store, terms, times, few)
    if named is None:
        return rows.filter(reduce(or_, [F.col("word").contains(term) for term in terms])).withColumn("times", times)
    counts = rows.sparkSession.createDataFrame([(row.word, row.times) for row in named], "word string, times bigint")
    slots = {(row.home + i) % store.slots for row in named for i in range(min(row.salts, store.slots))}
    pruned = rows.filter(F.col("slot").isin(sorted(slots)) & F.col("word").isin([row.word for row in named]))
    return pruned.join(F.broadcast(counts), "word")


def scores(
    store: SearchStore, terms: list[str], required: list[str], where: Column | None, few: int = FEW_WORDS
) -> DataFrame:
    """(id, score) of rows with a score above 0 that contain every word of
    ``required``, lower-cased terms without white space. Terms and required words
    are looked for in one reading of the postings."""
    hits = _postings_of(store, list(dict.fromkeys([*terms, *required])), _times(terms), where, few)
    holds = {f"has_{i}": F.max(F.col("word").contains(term)) for i, term in enumerate(required)}
    score = F.sum(F.col("n") * F.col("times")).alias("score")
    ranked = hits.groupBy("id").agg(score, *[held.alias(name) for name, held in holds.items()]).filter(F.col("score") > 0)
    if required:  # a row without id is not known to hold a word
        ranked = ranked.filter(reduce(and_, [F.col(name) for name in holds]) & F.col("id").isNotNull())
    return ranked.select("id", "score")


def shown(store: SearchStore, page: DataFrame) -> DataFrame:
    """What the results of ``page(id, ...)``, of at most 100 rows, show: their ids
    are named in the plan, so only their buckets are read."""
    rows = page.collect()
    ids = [row["id"] for row in rows]
    page = page.sparkSession.createDataFrame(rows, page.schema)
    return store.results.filter(F.col("id").isin(ids)).join(F.broadcast(page), "id")
