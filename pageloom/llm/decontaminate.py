"""Benchmark decontamination by greedy string tiling.

A document shares a seed with a benchmark item if some run of tokens has the
same running Karp-Rabin hash in both. Items whose shared seeds could not cover
enough of them are left out. For the others the seeds at which a maximal match
begins are grown to their full length; the longest match that overlaps no marked
token is marked, again and again, so that passages count in whatever order they
stand. The share of an item's tokens that are marked is its coverage.

Places are paired only where a match begins, so memory follows the number of
maximal matches, not that of equal tokens.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import bound_batches, whole_text

MATCH = 5  # tokens of the shortest tile
COVERAGE = 0.5  # share of an item at which a document counts as contaminated
BLOCK_CHARS = 16 << 20  # benchmark text that is broadcast at once
BASE = np.uint64(0x9E3779B97F4A7C15)

_WIDE_GAP = re.compile(rb"\xe2\x80[\x80-\xbf]|\xc2[\xa0-\xbf]|\xe3\x80[\x80-\x82]")  # general and CJK punctuation
_UNSPACED = re.compile(rb"[\xe3-\xe9][\x80-\xbf]{2}|\xe0[\xb8-\xbb][\x80-\xbf]|\xf0[\xa0-\xb3][\x80-\xbf]{2}")
_GAPS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))

OVERLAP = (
    "array<struct<item_id:bigint,item_tokens:int,covered:int,coverage:double,"
    "tiles:array<struct<doc_at:int,item_at:int,length:int>>>>"
)


def tokens(text: str) -> list[bytes]:
    """Lower-case words without white space and punctuation, as UTF-8.

    Each character of a script that sets no spaces (Chinese, Japanese, Thai, Lao) is a token.
    """
    raw = text.lower().encode("utf-8", "surrogatepass")
    if not raw.isascii():
        raw = _UNSPACED.sub(rb" \g<0> ", _WIDE_GAP.sub(b" ", raw))
    return raw.translate(_GAPS).split()


def running_hashes(ids: np.ndarray, length: int, at: np.ndarray) -> np.ndarray:
    """Karp-Rabin hashes of the runs of ``length`` ids that begin at ``at``, all rolled on together."""
    out = np.zeros(len(at), np.uint64)
    for j in range(length):
        out = out * BASE + ids[at + j].astype(np.uint64)
    return out


def match_starts(doc: np.ndarray, at: np.ndarray, own: np.ndarray, item: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Places (in doc, in item) at which seeds have the same hash and the tokens before them differ.

    ``own`` has the hashes of the seeds at ``at`` of the document, ``seeds`` those of all places of the item.
    """
    before_doc = np.where(at > 0, doc[at - 1], -1).astype(np.int64)
    before_item = np.concatenate(([-2], item[: len(seeds) - 1])).astype(np.int64)
    known, group = np.unique(seeds, return_inverse=True)
    codes = (group.astype(np.int64) << 32) + before_item + 2
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    mine = np.searchsorted(known, own)
    hit = known[np.minimum(mine, len(known) - 1)] == own
    at, mine, before_doc = at[hit], mine[hit].astype(np.int64) << 32, before_doc[hit]
    first, last = np.searchsorted(codes, mine), np.searchsorted(codes, mine + (1 << 32))
    same = np.searchsorted(codes, mine + before_doc + 2), np.searchsorted(codes, mine + before_doc + 3)
    parts = []
    for lo, hi in ((first, same[0]), (same[1], last)):  # all places of the seed but those with the same token before
        count = hi - lo
        place = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
        parts.append(np.stack([np.repeat(at, count), order[place]], axis=1))
    return np.concatenate(parts)


def common_lengths(doc: np.ndarray, item: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many tokens are equal from each pair of places on.

    Runs of 1, 2, 4, ... tokens are numbered, equal ones alike, and steps of falling size are taken.
    """
    i, j = starts[:, 0].copy(), starts[:, 1].copy()
    levels = [(doc.astype(np.int32), item.astype(np.int32))]
    while 2 << (len(levels) - 1) <= min(len(doc), len(item)):
        half = 1 << (len(levels) - 1)
        codes = [(x[:-half].astype(np.int64) << 32) | x[half:] for x in levels[-1]]
        number = np.unique(np.concatenate(codes), return_inverse=True)[1].astype(np.int32)
        levels.append((number[: len(codes[0])], number[len(codes[0]) :]))
    for a, b in reversed(levels):
        size = len(doc) - len(a) + 1
        fits = (i < len(a)) & (j < len(b))
        fits &= a[np.minimum(i, len(a) - 1)] == b[np.minimum(j, len(b) - 1)]
        i += np.where(fits, size, 0)
        j += np.where(fits, size, 0)
    return i - starts[:, 0]


def tile(doc: np.ndarray, item: np.ndarray, starts: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """Tiles (doc_at, item_at, length) of the greedy tiling.

    ``starts`` holds the places (in doc, in item) at which maximal matches
    begin; those of fewer than ``length`` tokens do not count. Ties between
    equally long matches go to the first place in the document, then in the item.
    """
    sizes = common_lengths(doc, item, starts)
    enough = sizes >= length
    heap = [(-n, i, j) for n, (i, j) in zip(sizes[enough].tolist(), starts[enough].tolist())]
    heapq.heapify(heap)
    in_doc, in_item, tiles = np.zeros(len(doc), bool), np.zeros(len(item), bool), []
    free = len(item)
    while heap and free >= length:
        n, i, j = heapq.heappop(heap)
        n = -n
        taken = np.nonzero(in_doc[i : i + n] | in_item[j : j + n])[0]
        if len(taken) == 0:
            tiles.append((i, j, n))
            in_doc[i : i + n] = in_item[j : j + n] = True
            free -= n
            continue
        edges = np.concatenate(([-1], taken, [n]))
        gaps = np.diff(edges) - 1
        for k in np.nonzero(gaps >= length)[0].tolist():
            at = int(edges[k]) + 1
            heapq.heappush(heap, (-int(gaps[k]), i + at, j + at))
    return tiles


class Items:
    """A block of benchmark items, indexed by the hashes of their seeds."""

    def __init__(self, rows: list[tuple[int, str]], match: int):
        self.names: dict[bytes, int] = {}
        self.items: list[tuple[int, np.ndarray, np.ndarray]] = []
        seeds: dict[int, list] = {}
        for item_id, text in rows:
            ids = np.array([self.names.setdefault(t, len(self.names) + 1) for t in tokens(text)], np.int32)
            if len(ids) == 0:
                continue
            length = min(match, len(ids))
            hashes = running_hashes(ids, length, np.arange(len(ids) - length + 1))
            seeds.setdefault(length, []).append((len(self.items), hashes))
            self.items.append((item_id, ids, hashes))
        self.seeds = {}
        for length, parts in seeds.items():
            hashes = np.concatenate([h for _, h in parts])
            owner = np.concatenate([np.full(len(h), k) for k, h in parts])
            place = np.concatenate([np.arange(len(h)) for _, h in parts])
            order = np.argsort(hashes, kind="stable")
            self.seeds[length] = hashes[order], owner[order], place[order]

    def promising(self, length: int, own: np.ndarray, coverage: float) -> list[int]:
        """Items of which the seeds that occur among the hashes ``own`` cover enough."""
        hashes, owner, place = self.seeds[length]
        own = np.unique(own)
        first, count = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
        count -= first
        index = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
        if len(index) == 0:
            return []
        index = index[np.lexsort((place[index], owner[index]))]
        owner, place = owner[index], place[index]
        covered = np.full(len(index), length)
        together = owner[1:] == owner[:-1]
        covered[:-1][together] = np.minimum(length, np.diff(place)[together])
        found, starts = np.unique(owner, return_index=True)
        sizes = np.array([len(self.items[k][1]) for k in found.tolist()])
        return found[np.add.reduceat(covered, starts) >= coverage * sizes].tolist()

    def overlaps(self, text: str, coverage: float) -> list[tuple]:
        """The items of which ``text`` covers at least ``coverage``, by id."""
        words = tokens(text)
        ids = np.fromiter(map(self.names.get, words, repeat(0)), np.int32, len(words))
        strange = np.concatenate(([0], np.cumsum(ids == 0)))
        found = []
        for length in self.seeds:
            if len(ids) < length:
                continue
            at = np.nonzero(strange[length:] == strange[:-length])[0]
            own = running_hashes(ids, length, at)
            for k in self.promising(length, own, coverage):
                item_id, tokens_of_item, seeds = self.items[k]
                starts = match_starts(ids, at, own, tokens_of_item, seeds)
                tiles = tile(ids, tokens_of_item, starts, length)
                covered = sum(n for _, _, n in tiles)
                if covered >= coverage * len(tokens_of_item) and tiles:
                    share = covered / len(tokens_of_item)
                    found.append((item_id, len(tokens_of_item), covered, share, sorted(tiles)))
        return sorted(found, key=lambda x: (x[0] is None, x[0], x[1:]))


def _item_blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The distinct items in blocks of about ``block_chars`` characters.

    Each block is bounded, so it may be collected and broadcast; a larger
    benchmark has more blocks, each matched against all documents.
    """
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), whole_text().alias("text")).distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + chars // block_chars
    for k in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        yield [(r.item_id, r.text) for r in mine.collect()]


def benchmark_overlaps(
    documents: DataFrame,
    benchmark: DataFrame,
    match: int = MATCH,
    coverage: float = COVERAGE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """A row (doc_id, item_id, item_tokens, covered, coverage, tiles) for every
    document and item of which it covers at least ``coverage`` by tiles of
    ``match`` tokens or more (items shorter than that must occur whole).

    Null and empty texts of either side match nothing; repeated documents give
    repeated rows, repeated items one; null ids are kept. Rows are not
    shuffled: each document meets the broadcast items in its own task.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    out = None
    for rows in _item_blocks(benchmark, block_chars):
        matched = documents.select("doc_id", F.explode(_matcher(spark, rows, match, coverage)(whole_text())).alias("m"))
        out = matched if out is None else out.union(matched)
    return out.select("doc_id", "m.*")


def _matcher(spark, rows, match: int, coverage: float):
    shared = spark.sparkContext.broadcast(rows)

    @F.pandas_udf(OVERLAP)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        items = Items(shared.value, match)
        for texts in batches:
            yield pd.Series([[_record(x) for x in items.overlaps(t, coverage)] for t in texts], dtype=object)

    return run


def _record(found: tuple) -> dict:
    item_id, count, covered, share, tiles = found
    places = [{"doc_at": i, "item_at": j, "length": n} for i, j, n in tiles]
    return {"item_id": item_id, "item_tokens": count, "covered": covered, "coverage": share, "tiles": places}


def drop_contaminated(
    documents: DataFrame,
    benchmark: DataFrame,
    match: int = MATCH,
    coverage: float = COVERAGE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The rows of ``documents`` that cover less than ``coverage`` of every item, columns unchanged.

    Null and empty texts stay, and rows with null ids are judged like others, as
    each row is judged by its own text; repeated rows stay or go together. An
    empty benchmark drops nothing. No column is added, so none can clash.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    kept, blocks = documents, 0
    for rows in _item_blocks(benchmark, block_chars):
        if blocks:  # one block in memory at a time
            kept = materialize(kept, "decontaminated")
        kept, blocks = kept.filter(F.size(_matcher(spark, rows, match, coverage)(whole_text())) == 0), blocks + 1
    return kept
