"""Document fingerprints by winnowing.

Of the hashes of all runs of ``gram`` code points, the least in every window of
``window`` runs is kept, the rightmost of equals, with its position. Two texts
that share a passage of ``gram + window - 1`` code points share a hash.

Runs overhang both ends of a text by half their length, and windows both ends of
the runs, so that lengths are the same for every text: a short text has several
hashes too, and shares those of its beginning and end with longer texts that
begin or end alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, whole_text

GRAM = 12
WINDOW = 24
BASE = 0x9E3779B97F4A7C15
CHUNK = 1 << 19  # runs hashed at once
PART_BYTES = 32 << 20
MOST_PARTS = 20_000  # shuffle partitions; ranges beyond it are longer streams, not more memory


def gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of every run of ``gram`` codes: shorter runs are put together until they are long enough."""
    out, length, half, size = None, 0, codes.astype(np.uint64) + np.uint64(1), 1
    rest = gram
    while rest:
        if rest & 1:
            if out is None:
                out, length = half, size
            else:
                n = len(codes) - length - size + 1
                out = out[:n] * np.uint64(pow(BASE, size, 1 << 64)) + half[length : length + n]
                length += size
        rest >>= 1
        if rest:
            n = len(codes) - 2 * size + 1
            half = half[:n] * np.uint64(pow(BASE, size, 1 << 64)) + half[size : size + n]
            size *= 2
    out = out ^ (out >> np.uint64(32))
    out = out * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def rightmost_minima(values: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least value of every window, the rightmost of equals; one window if values are fewer."""
    window = min(window, len(values))
    least, size = np.arange(len(values)), 1

    def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(values[a] < values[b], a, b)

    while 2 * size <= window:
        least, size = better(least[:-size], least[size:]), 2 * size
    count = len(values) - window + 1
    least = better(least[:count], least[window - size : window - size + count])
    return least[np.concatenate(([True], least[1:] != least[:-1]))]


def first_minima(values: np.ndarray) -> np.ndarray:
    """Positions of the least value of every beginning of ``values``, the rightmost of equals."""
    return np.nonzero(values == np.minimum.accumulate(values))[0]


def last_minima(values: np.ndarray) -> np.ndarray:
    """Positions of the least value of every ending of ``values``, the rightmost of equals."""
    back = values[::-1]
    lower = np.append(True, back[1:] < np.minimum.accumulate(back)[:-1])
    return len(values) - 1 - np.nonzero(lower)[0]


def winnow(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of a text; an empty text has none.

    A position is the run's first code point, below zero where it overhangs the start.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) == 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    over = gram // 2
    codes = np.pad(codes.astype(np.int64), over, constant_values=-1)  # no code point
    runs = len(codes) - gram + 1
    hashes, positions = [], []
    for at in range(0, runs, CHUNK):
        end = min(runs, at + CHUNK + window - 1)  # windows that begin in this chunk
        values = gram_hashes(codes[at : end + gram - 1], gram)
        kept = rightmost_minima(values, window)
        hashes.append(values[kept])
        positions.append(kept + at)
        if end == runs:
            break
    reach = min(runs, window - 1)  # runs that a window which overhangs an end may hold
    if reach:
        for at, least in ((0, first_minima), (runs - reach, last_minima)):
            values = gram_hashes(codes[at : at + reach + gram - 1], gram)
            kept = least(values)
            hashes.append(values[kept])
            positions.append(kept + at)
    h, p = np.concatenate(hashes), np.concatenate(positions)
    p, first = np.unique(p, return_index=True)
    return h[first], p - over


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common hashes among all distinct ones; two empty fingerprints are alike."""
    a, b = np.unique(a), np.unique(b)
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if len(a) or len(b) else 1.0


def to_string(hashes: np.ndarray, positions: np.ndarray) -> str:
    """The hashes in hexadecimal, a colon, and the first position and the gaps to the others."""
    if len(hashes) == 0:
        return ""
    gaps = np.diff(positions, prepend=0)
    return hashes.astype(">u8").tobytes().hex() + ":" + ",".join(map(str, gaps.tolist()))


def fingerprint_documents(documents: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``documents`` with ``hashes`` (array of bigint, in order of position) and
    ``positions`` (array of bigint, code points from 0, those of overhanging runs
    below), which replace columns of those names; all others stay. Null and empty
    texts have empty arrays, repeated rows equal ones. Nothing is shuffled."""
    bound_batches(documents.sparkSession)

    @F.pandas_udf("hashes array<bigint>, positions array<bigint>")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [winnow(t, gram, window) for t in texts]
        return pd.DataFrame({"hashes": [h.view(np.int64) for h, _ in rows], "positions": [p for _, p in rows]})

    marked = documents.select(F.struct("*").alias("row"), run(whole_text()).alias("prints"))
    kept = [F.col("row")[c].alias(c) for c in documents.columns if c not in ("hashes", "positions")]
    return marked.select(*kept, "prints.hashes", "prints.positions")


RESULT = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _compare(gram: int, window: int):
    """Walks rows sorted by part; each is compared with the row after it in its part."""
    import hashlib

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = None
        for frame in frames:
            out = []
            for part, guest, doc_id, text in zip(frame["part"], frame["guest"], frame["id"], frame["text"]):
                prints = winnow(text, gram, window)
                if before is not None and before[0] == part:
                    _, last_id, last, (hashes, positions) = before
                    cut = len(last) // 3
                    edited = last[: len(last) - cut] + text[:cut]
                    changed = winnow(edited, gram, window)
                    out.append(
                        (
                            last_id,
                            len(last),
                            hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                            to_string(hashes, positions),
                            to_string(*changed),
                            likeness(hashes, changed[0]),
                            likeness(hashes, prints[0]),
                        )
                    )
                before = None if guest else (part, None if pd.isna(doc_id) else int(doc_id), text, prints)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")], dtype=object)

    return run


def compare_edited(
    documents: DataFrame, parts: int | None = None, gram: int = GRAM, window: int = WINDOW
) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike they are.

    The edited text has its last third of code points (rounded down) replaced
    by as many of the next document's first ones, or all of them; documents
    follow each other by descending ``doc_id`` (equal ids by text, null ids
    last), and the first follows the last. Null texts count as empty; repeated
    rows each have their place. One document follows itself.

    Rows are dealt by ranges of ids into ``parts`` (by default of 32 MB of
    text), one to a task, each a sorted stream. The first row of each range is the one that another
    range needs: these rows, one per range, are sent along as guests.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    rows = documents.select(F.col("doc_id").cast("bigint").alias("id"), whole_text().alias("text"))
    if parts is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(2 * spark.sparkContext.defaultParallelism, min(MOST_PARTS, size // PART_BYTES))
    shares = F.array(*[F.lit(k / parts) for k in range(1, parts)])
    cuts = rows.agg(F.percentile_approx("id", shares, 100 * parts).alias("cuts")).first()["cuts"] or []
    edges = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        """Ranges count from the highest ids on; null ids have the last one."""
        known = ids.fillna(0).astype("int64").to_numpy()
        part = len(edges) - np.searchsorted(edges, known, side="left")
        return pd.Series(np.where(ids.isna(), len(edges) + 1, part)).astype("int32")

    placed = rows.withColumn("part", part_of("id"))
    firsts = placed.groupBy("part").agg(F.max("id").alias("id"))
    order = sorted((r["part"], r["id"]) for r in firsts.collect())
    before = {part: order[k - 1][0] for k, (part, _) in enumerate(order)}
    heads = spark.createDataFrame(
        [(before[part], head) for part, head in order], "part int, head bigint"
    )
    guests = (
        rows.join(F.broadcast(heads), F.col("id").eqNullSafe(F.col("head")))
        .groupBy("part", "id")
        .agg(F.min("text").alias("text"))
        .select("id", "text", "part", F.lit(1).alias("guest"))
    )
    stream = (
        placed.select("id", "text", "part", F.lit(0).alias("guest"))
        .unionByName(guests)
        .repartitionById(len(edges) + 2, F.col("part"))
        .sortWithinPartitions("part", "guest", F.desc_nulls_last("id"), "text")
    )
    return stream.mapInPandas(_compare(gram, window), RESULT)
