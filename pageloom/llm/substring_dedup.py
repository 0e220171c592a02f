"""Removal of passages that an earlier document holds, by suffix automata of shards.

Windows of consecutive words are dealt to shards by a minimizer: the least hash
of the short runs of words in a window. Equal windows have equal minimizers, so
a shard holds every copy of its windows. A stretch is what windows with one
minimizer cover. First only hashes are shuffled: a minimizer that one document
has alone needs nothing more, and a stretch that a smaller id has as a whole is
repeated. The words of the others meet in their shard by ascending id: each
stretch is walked through the suffix automaton of those before it, which gives
the longest match that ends at every word (matching statistics) and the first
document that has it, and is then added to the automaton.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, whole_text
from .winnowing import BASE

WINDOW = 13  # words of a passage that counts as repeated
GRAM = 5  # words of a minimizer
LONGEST = 64  # windows of a stretch at most
HELD = 400_000  # stretches a task combines before it passes them on
NO_ID = (1 << 63) - 1  # null ids come after all others


def split_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size, out = 1, values
    while 2 * size <= width:
        out, size = np.minimum(out[:-size], out[size:]), 2 * size
    count = len(values) - width + 1
    return np.minimum(out[:count], out[width - size : width - size + count])


def stretches(words: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimizers, starts, counts): runs of windows with one minimizer, ``LONGEST`` at most."""
    windows = len(words) - window + 1
    if windows < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    gram = min(GRAM, window)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(map(digest, words), np.uint64, len(words))
    grams = len(words) - gram + 1
    mixed = np.zeros(grams, np.uint64)
    for j in range(gram):
        mixed = mixed * np.uint64(BASE) + hashes[j : j + grams]
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    least = _sliding_min(mixed >> np.uint64(16), window - gram + 1).astype(np.int64)
    changes = np.concatenate(([0], np.nonzero(least[1:] != least[:-1])[0] + 1))
    counts = np.diff(np.concatenate((changes, [windows])))
    pieces = (counts + LONGEST - 1) // LONGEST
    starts = np.repeat(changes, pieces)
    nth = np.arange(len(starts)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = starts + nth * LONGEST
    ends = np.repeat(changes + counts, pieces)
    return least[starts], starts, np.minimum(LONGEST, ends - starts)


class Automaton:
    """Suffix automaton of word sequences added one after another, with the first owner of every state."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [None]

    def _state(self, length: int, first: int, arcs: dict) -> int:
        self.next.append(arcs)
        self.link.append(0)
        self.length.append(length)
        self.first.append(first)
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: bytes) -> int:
        clone = self._state(self.length[p] + 1, self.first[q], dict(self.next[q]))
        self.link[clone], self.link[q] = self.link[q], clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[bytes], owner: int) -> None:
        """Add a sequence; owners must not descend from one call to the next."""
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
                continue
            state, p = self._state(self.length[last] + 1, owner, {}), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = state
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
            last = state

    def first_owners(self, words: list[bytes], least: int) -> list[int | None]:
        """For every word the first owner of the ``least`` words that end there, None where none has them."""
        out, state, matched = [], 0, 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            to = self.next[state].get(word)
            state, matched = (0, 0) if to is None else (to, matched + 1)
            if matched < least:
                out.append(None)
                continue
            while self.length[self.link[state]] >= least:
                state = self.link[state]
                matched = self.length[state]
            out.append(self.first[state])
        return out


FOUND = "key bigint, id bigint, text_hash bigint, place bigint, content bigint"
COLUMNS = [c.split()[0] for c in FOUND.split(", ")]


def _repeated_whole(key: np.ndarray, id_: np.ndarray, content: np.ndarray) -> np.ndarray:
    """Whether a smaller id has the same stretch under the same key."""
    order = np.lexsort((id_, content, key))
    k, c, i = key[order], content[order], id_[order]
    new = np.concatenate(([True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])))
    out = np.empty(len(key), bool)
    out[order] = i > i[new][np.cumsum(new) - 1]
    return out


def _find(window: int):
    """Hashes of the stretches of every document. ``place`` is the first word, the
    number of windows and whether the stretch is known to be repeated: of equal
    stretches in a task only those of the smallest id meet those of others."""

    def emit(parts: list) -> pd.DataFrame:
        key, id_, text_hash, place, content = (np.concatenate([p[i] for p in parts]) for i in range(5))
        known = _repeated_whole(key, id_, content)
        spread = (key * np.int64(31) + id_ + place) & ((1 << 48) - 1)
        columns = (np.where(known, spread, key), id_, text_hash, (place << 1) | known, np.where(known, 0, content))
        return pd.DataFrame(dict(zip(COLUMNS, columns)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, held = [], 0
        for frame in frames:
            for id_, text_hash, text in zip(frame["id"], frame["text_hash"], frame["text"]):
                words = split_words(text)
                key, starts, counts = stretches(words, window)
                n = len(key)
                if n == 0:
                    continue
                joined = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                begins = np.concatenate(([0], ends[:-1] + 1))[starts].tolist()
                closes = ends[starts + counts + window - 2].tolist()
                digest = xxhash.xxh64_intdigest
                content = np.fromiter([digest(joined[a:b]) for a, b in zip(begins, closes)], np.uint64, n)
                ids, hashes = np.full(n, id_, np.int64), np.full(n, text_hash, np.int64)
                parts.append((key, ids, hashes, (starts << 7) | counts, content.view(np.int64)))
                held += n
            if held > HELD:
                yield emit(parts)
                parts, held = [], 0
        if parts:
            yield emit(parts)

    return run


JUDGED = "id bigint, text_hash bigint, place bigint, key bigint"


def _judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows sorted by key, those that are repeated as a whole (key null) and
    those that may be in part, as others with their key differ from them."""
    rest = None
    for frame in frames:
        table = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        key = table["key"].to_numpy()
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
        rest = table.iloc[cut:]
        yield _judged(table.iloc[:cut])
    if rest is not None:
        yield _judged(rest)


def _judged(table: pd.DataFrame) -> pd.DataFrame:
    key, id_, text_hash, place, content = (table[c].to_numpy(np.int64) for c in COLUMNS)
    known = (place & 1).astype(bool)
    at = np.nonzero(~known)[0]
    whole, partly = np.empty(0, bool), np.empty(0, bool)
    if len(at):
        k, i, c = key[at], id_[at], content[at]
        whole = _repeated_whole(k, i, c)
        new = np.concatenate(([True], k[1:] != k[:-1]))
        group = np.cumsum(new) - 1
        several, differ = np.zeros(group[-1] + 1, bool), np.zeros(group[-1] + 1, bool)
        several[group[i != i[new][group]]] = True
        differ[group[c != c[new][group]]] = True
        partly = (several & differ)[group] & ~whole
    sure, open_ = np.concatenate([np.nonzero(known)[0], at[whole]]), at[partly]
    order = np.concatenate([sure, open_])
    keys = pd.array(key[order], dtype="Int64")
    keys[: len(sure)] = pd.NA
    return pd.DataFrame({"id": id_[order], "text_hash": text_hash[order], "place": place[order] >> 1, "key": keys})


SPANS = "shard bigint, id bigint, text_hash bigint, lo int, hi int, words binary"


def _cut_out(window: int):
    """The words of stretches that may be repeated in part, and, without words,
    the ranges that are repeated for certain, put together where they touch."""
    columns = [c.split()[0] for c in SPANS.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for id_, text_hash, text, found in zip(frame["id"], frame["text_hash"], frame["text"], frame["found"]):
                words, sure = split_words(text), []
                for item in sorted(found, key=lambda x: x["place"]):
                    lo = item["place"] >> 7
                    hi = lo + (item["place"] & 127) + window - 1
                    if item["key"] is not None:
                        out.append((item["key"], id_, text_hash, lo, hi, b" ".join(words[lo:hi])))
                    elif sure and lo <= sure[-1][1]:
                        sure[-1][1] = max(hi, sure[-1][1])
                    else:
                        sure.append([lo, hi])
                out += [(hash((id_, lo)), id_, text_hash, lo, hi, None) for lo, hi in sure]
            yield pd.DataFrame(out, columns=columns, dtype=object)

    return run


class Shard:
    """Stretches of one minimizer, in order of document id."""

    def __init__(self, window: int):
        self.window, self.seen, self.automaton = window, {}, None

    def repeated(self, id_: int, content: bytes) -> list[tuple[int, int]]:
        """The word ranges of a stretch that smaller ids have, and the stretch becomes known."""
        words = content.split(b" ")
        known = self.seen.get(content)
        if known is not None and known < id_:
            return [(0, len(words))]
        found: list[tuple[int, int]] = []
        if self.automaton is None and len(self.seen) > (known is not None):
            self.automaton = Automaton()
            for before, owner in self.seen.items():
                self.automaton.add(before.split(b" "), owner)
        if self.automaton is not None:
            for end, owner in enumerate(self.automaton.first_owners(words, self.window), 1):
                if owner is not None and owner < id_:
                    if found and end - self.window <= found[-1][1]:
                        found[-1] = (found[-1][0], end)
                    else:
                        found.append((end - self.window, end))
        if known is None:
            self.seen[content] = id_
            if self.automaton is not None:
                self.automaton.add(words, id_)
        return found


def _match(window: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, shard = None, None
        for frame in frames:
            out = []
            for key, id_, text_hash, lo, hi, content in frame.itertuples(index=False, name=None):
                if content is None:
                    out.append((id_, text_hash, lo, hi))
                    continue
                if shard is None or key != current:
                    current, shard = key, Shard(window)
                out += [(id_, text_hash, lo + a, lo + b) for a, b in shard.repeated(id_, content)]
            yield pd.DataFrame(out, columns=["id", "text_hash", "lo", "hi"])

    return run


def _kept_words(text: str, ranges) -> tuple[int, int, str]:
    words = split_words(text)
    if ranges is None or len(ranges) == 0:
        return len(words), 0, b" ".join(words).decode("utf-8", "surrogatepass")
    keep = np.ones(len(words), bool)
    for r in ranges:
        keep[r["lo"] : r["hi"]] = False
    kept = [words[i] for i in np.nonzero(keep)[0].tolist()]
    return len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")


def remove_repeated(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row of ``documents``.

    A word goes if it lies in ``window`` consecutive words that a document with
    a smaller ``doc_id`` holds too, judged on the texts as they come. ``kept``
    is what is left, joined by single spaces. Null and empty texts have no
    words; null ids come after all others and not before each other; rows with
    one id do not remove each other's words. Other columns are not read.

    Of a passage that many documents of a task share, one copy is shuffled for
    all, so that a hot passage does not fill a shard.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    id_, text = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)), whole_text()
    rows = documents.select(id_.alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    judged = (
        rows.mapInPandas(_find(window), FOUND)
        .repartition("key")
        .sortWithinPartitions("key")
        .mapInPandas(_judge, JUDGED)
    )
    found = judged.groupBy("id", "text_hash").agg(F.collect_list(F.struct("place", "key")).alias("found"))
    ranges = (
        rows.join(found, ["id", "text_hash"])
        .select("id", "text_hash", "text", "found")
        .mapInPandas(_cut_out(window), SPANS)
        .repartition("shard")
        .sortWithinPartitions("shard", "id")
        .mapInPandas(_match(window), "id bigint, text_hash bigint, lo int, hi int")
        .groupBy("id", "text_hash")
        .agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    )

    @F.pandas_udf("n_words bigint, n_removed bigint, kept string")
    def kept(texts: pd.Series, ranges: pd.Series) -> pd.DataFrame:
        out = [_kept_words(t, r) for t, r in zip(texts, ranges)]
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept"], dtype=object)

    out = rows.join(ranges, ["id", "text_hash"], "left").select("id", kept("text", "ranges").alias("k"))
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "k.*")
