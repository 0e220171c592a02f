"""SimHash near-duplicates, with candidates pruned by pigeonring chains.

Fingerprints of 64 bits lie on a ring of m segments. If two differ in at most
t bits, some start on the ring has every chain of l segments differ in at most
l*t/m bits. With m = 2t+1 the first two segments of that chain are equal, so
their value is the join key; the longer chains and then the whole Hamming
distance are checked on the joined pairs.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import heavy_keys, salted_join
from ..session import materialize
from .common import bound_batches, whole_text
from .components import connected_components

BITS = 64
SEED = 42
BUCKET = 32  # larger buckets are linked by shared neighbours instead of pairs
BLOCK = 1 << 16  # shingles whose bits are counted at once


def fingerprint(text: str, shingle: int) -> int:
    """SimHash of a text: unsigned, 0 if it has no words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_digest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(ends), BLOCK):
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK])])
        rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
        counts += np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(ends)).tobytes(), "big")


def _fingerprint_column(shingle: int):
    @F.pandas_udf("bigint")
    def run(texts: pd.Series) -> pd.Series:
        values = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts))
        return pd.Series(values.astype(np.int64))

    return run


def _segments(count: int) -> list[int]:
    """Bit masks of ``count`` segments around the ring, as signed numbers."""
    edges = [round(i * BITS / count) for i in range(count + 1)]
    return [_signed(sum(1 << b for b in range(lo, hi))) for lo, hi in itertools.pairwise(edges)]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >= 1 << (BITS - 1) else value


def _flips(bits: int) -> list[int]:
    """Masks with at most ``bits`` bits set."""
    return [
        _signed(sum(1 << b for b in chosen))
        for n in range(bits + 1)
        for chosen in itertools.combinations(range(BITS), n)
    ]


def _buckets(prints: DataFrame, max_bits: int) -> DataFrame:
    """A row per fingerprint and start on the ring: start, key, fp and the bucket's size."""
    masks = _segments(2 * max_bits + 1)
    keys = [masks[i] | masks[(i + 1) % len(masks)] for i in range(len(masks))]
    starts = F.array(
        *[F.struct(F.lit(i).alias("start"), F.col("fp").bitwiseAND(F.lit(k)).alias("key")) for i, k in enumerate(keys)]
    )
    rows = prints.select("fp", F.explode(starts).alias("s")).select("s.start", "s.key", "fp")
    sizes = rows.groupBy("start", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return rows.join(sizes, ["start", "key"])


def _ring_links(buckets: DataFrame, max_bits: int) -> DataFrame:
    masks = _segments(2 * max_bits + 1)
    m = len(masks)
    differ = F.col("u").bitwiseXOR(F.col("v"))
    per_segment = F.array(*[F.bit_count(differ.bitwiseAND(F.lit(mask))) for mask in masks])
    left = buckets.filter(F.col("size") <= BUCKET).select("start", "key", F.col("fp").alias("u"))
    right = left.withColumnRenamed("u", "v")
    pairs = left.join(right, ["start", "key"]).filter("u < v").withColumn("d", per_segment)
    chain, within = F.lit(0), F.lit(True)
    for length in range(1, m + 1):
        chain = chain + F.get("d", (F.col("start") + F.lit(length - 1)) % m)
        within = within & (chain * m <= length * max_bits)
    return pairs.filter(within).filter(F.bit_count(differ) <= max_bits).select("u", "v")


def _crowded_links(buckets: DataFrame, max_bits: int) -> DataFrame:
    """Links within large buckets, without pairs: two fingerprints are near if
    and only if flipping few bits of each gives one value; all that share a
    value are tied to the least of them that is half the distance away."""
    crowded = buckets.filter(F.col("size") > BUCKET).select("fp").distinct()
    near, far = max_bits // 2, (max_bits + 1) // 2
    flips = F.explode(F.array(*[F.lit(x) for x in _flips(far)])).alias("flip")
    values = crowded.select("fp", flips).withColumn("value", F.col("fp").bitwiseXOR(F.col("flip")))
    centre = F.min(F.when(F.bit_count("flip") <= near, F.col("fp")))
    centres = values.groupBy("value").agg(centre.alias("v"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return values.join(centres, "value").filter("fp <> v").select(F.col("fp").alias("u"), "v").distinct()


def near_links(prints: DataFrame, max_bits: int) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs within ``max_bits``.

    ``prints`` has distinct fingerprints in ``fp``. Every edge is within the
    distance; buckets of up to 32 give all their pairs, larger ones a star per
    shared neighbour, which keeps rows linear in the input.
    """
    if max_bits == 0:
        return prints.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0)
    buckets = materialize(_buckets(prints, max_bits), "simhash-buckets")
    return _ring_links(buckets, max_bits).union(_crowded_links(buckets, max_bits))


def simhash_groups(
    documents: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, fingerprint, component_id) of every row of ``documents``.

    Fingerprints are linked at ``max_bits`` differing bits or fewer and a
    component is everything reachable; ``component_id`` is its smallest id.
    Null and empty texts have fingerprint zero and are linked like others. A
    null id never names a component, unless it has no other id; repeated rows
    give repeated rows. Other columns are not read.
    """
    bound_batches(documents.sparkSession)
    hashed = documents.select(
        F.col(id_col).alias("id"), _fingerprint_column(shingle)(whole_text(text_col)).alias("fp")
    )
    hashed = materialize(hashed, "simhash")
    named = _least_of_groups(hashed, "id", max_bits).withColumnRenamed("least", "component_id")
    # a fingerprint that a large share of all rows have is dealt into salts
    return salted_join(hashed, named, ["fp"], heavy_keys(hashed, ["fp"]), ["id"], "inner").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _least_of_groups(hashed: DataFrame, value: str, max_bits: int) -> DataFrame:
    """(fp, least): every fingerprint with the least ``value`` of its whole group."""
    firsts = hashed.groupBy("fp").agg(F.min(value).alias("first"))
    edges = materialize(near_links(firsts.select("fp"), max_bits), "simhash-links")
    roots = connected_components(edges)
    members = roots.select(F.col("node").alias("fp"), "root").union(roots.select("root", "root").distinct())
    linked = members.join(firsts, "fp")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    groups = materialize(linked.join(least, "root").select("fp", "least"), "simhash-groups")
    return firsts.join(groups, "fp", "left").select("fp", F.coalesce("least", "first").alias("least"))


def drop_near_duplicates(documents: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of ``documents`` that keep one document of each group, the one
    with the smallest ``doc_id`` (nulls last), then the smallest text hash.

    Rows are judged one by one: a row goes only if its own group keeps another
    document. Rows with the same id and text are one document and stay
    together; rows without id are documents of their own, and of those with one
    text the one with the least hash of all columns stays. Null and empty texts
    have fingerprint zero. Columns stay as they are, whatever their names.
    """
    bound_batches(documents.sparkSession)
    no_id, text = F.col("doc_id").isNull(), whole_text()
    tie = F.when(no_id, F.xxhash64(F.to_json(F.struct("*")))).otherwise(F.lit(0).cast("bigint"))
    key = F.struct(
        no_id.alias("no_id"), F.col("doc_id").alias("id"), F.xxhash64(text).alias("text_hash"), tie.alias("tie")
    )
    hashed = materialize(documents.select(key.alias("key"), _fingerprint_column(shingle)(text).alias("fp")), "simhash")
    named = _least_of_groups(hashed, "key", max_bits)
    judged = salted_join(hashed, named, ["fp"], heavy_keys(hashed, ["fp"]), ["key"], "inner")
    dropped = judged.filter(~F.col("key").eqNullSafe(F.col("least"))).select(F.col("key").alias("dropped")).distinct()
    same = [F.col("key")[c].eqNullSafe(F.col("dropped")[c]) for c in ("id", "text_hash", "tie")]
    kept = documents.select(F.struct("*").alias("row"), key.alias("key")).join(dropped, same, "left_anti")
    # rows without id that are left with one key are equal in all columns
    alone = kept.filter("key.id is null").dropDuplicates(["key"])
    return kept.filter("key.id is not null").union(alone).select("row.*")
