"""Language-model scores by prediction by partial matching (PPM).

A text is coded as its class and then its tokens, each with a gap after it, and
one end. The class, one of 32, is a hash of the text's most frequent token, and
tells languages and kinds of junk apart. All else is coded byte by byte, each
byte and the end after the ``ORDER`` bytes before it, over the ends of tokens
and back to the class. The contexts are learned from all training texts. A byte
that its longest context has not seen costs an escape (method C: as many parts
as the context has seen symbols) and is looked for in the next shorter context,
where the symbols that the longer one has seen are excluded; below the empty
context all symbols not yet seen are equally likely.

A byte in its longest context is a gram. Grams are counted and met with their
counts by a shuffle; contexts that share their last two bytes are scored
together, every distinct gram once. Documents add up scores: of a bounded number
of frequent grams and tokens where they are read, of all others by a join.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import bound_batches, whole_text

ORDER = 6  # bytes of the longest context
SYMBOLS = 257  # bytes and the end of a text
END = 256
CLASSES = 32
END_WORD = b" "  # with the class behind it stands for the end in tables; no token has white space
FREQUENT = 1 << 18  # tokens whose counts are broadcast
FREQUENT_GRAMS = 1 << 21  # grams whose scores are broadcast
SLOT_BITS = 22  # slots that frequent grams are looked up in
BLOCK_GRAMS = 300_000  # grams scored at once, or all that share two bytes
FLUSH = 400_000  # distinct tokens counted before a task passes them on
FLUSH_GRAMS = 3_000_000  # the same of grams
FRESH_GRAMS = 1 << 20  # grams of texts put together with those counted before at once
POSITIONS = 1 << 18  # bytes keyed at once, and grams passed on at once
TEXTS = 500  # texts counted or added up at once

_CTX = np.int64(9)  # a key is length, context and symbol: 3, 48 and 9 bits
_LEN = np.int64(9 + 48)
_TRAIN = np.int64(1) << np.int64(60)  # marks grams of training texts while they are counted


def tokens(text: str) -> list[bytes]:
    """Words of a text as UTF-8, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def suffix(contexts: np.ndarray) -> np.ndarray:
    """Contexts (length and bytes, without symbol) less their first byte."""
    size = contexts >> 48
    shorter = np.maximum(size - 1, 0)
    return (shorter << 48) | (contexts & ((np.int64(1) << (8 * shorter)) - 1))


def text_class(counts: dict[bytes, int]) -> int:
    """The class of a text by the counts of its tokens; of equally frequent ones the greatest counts."""
    best = max(counts.items(), key=lambda x: (x[1], x[0]))[0] if counts else b""
    return zlib.crc32(best) % CLASSES


@dataclass
class Texts:
    """Texts of a batch: their coded rows, and per text and distinct token how often it has it."""

    words: pa.Array  # distinct tokens of the batch
    owner: np.ndarray  # texts, ascending
    token: np.ndarray  # places in words
    times: np.ndarray
    sizes: np.ndarray  # tokens per text, without the end
    kinds: list[int]
    rows: list[bytes]

    @classmethod
    def of(cls, texts: list[str]) -> Texts:
        lists = [tokens(text) for text in texts]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        encoded = pa.array(chain.from_iterable(lists), pa.binary()).dictionary_encode()
        words, distinct = encoded.dictionary, max(1, len(encoded.dictionary))
        pairs = np.repeat(np.arange(len(lists)), sizes) * distinct + encoded.indices.to_numpy()
        pairs, times = np.unique(pairs, return_counts=True)
        owner, token = np.divmod(pairs, distinct)
        order = pc.array_sort_indices(words).to_numpy()
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        kinds = [text_class({})] * len(lists)
        if len(pairs):
            first = np.nonzero(np.diff(owner, prepend=-1))[0]
            most = order[np.maximum.reduceat(times * distinct + rank[token], first) % distinct]
            for text, word in zip(owner[first].tolist(), words.take(pa.array(most)).to_pylist()):
                kinds[text] = text_class({word: 1})
        return cls(words, owner, token, times, sizes, kinds, list(map(coded, kinds, lists)))

    def counts(self, train: np.ndarray) -> pa.Table:
        """(word, c, n): how often training texts and all have every distinct token and end."""
        parts = []
        for words, token, times, trained in (
            (self.words, self.token, self.times, train[self.owner]),
            (pa.array([END_WORD + bytes([k]) for k in range(CLASSES)]), self.kinds, np.ones(len(train), np.int64), train),
        ):
            c, n = (np.bincount(token, weight, len(words)).astype(np.int64) for weight in (times * trained, times))
            parts.append(pa.table({"word": words, "c": c, "n": n}).filter(pc.field("n") > 0))
        return pa.concat_tables(parts)


def coded(kind: int, words: list[bytes]) -> bytes:
    """A text in a row: class, gap, every token with a gap, and a line feed for the end."""
    return b"%c %b\n" % (kind, b" ".join([*words, b""]))


def keys(rows: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Grams of coded texts in pieces of at most ``POSITIONS`` bytes: the first row
    of a piece, where in it each of its rows begins, and a key per byte. Class and
    first gap are not coded and have -1."""
    joined = b"".join([bytes(7), *rows])
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    starts = np.cumsum(sizes) - sizes
    ends, total = starts + sizes - 1, len(joined) - 7
    words = np.ndarray((total,), ">i8", joined, strides=(1,))  # each byte with the seven before it
    for lo in range(0, total, POSITIONS):
        hi = min(lo + POSITIONS, total)
        piece = words[lo:hi].astype(np.int64)
        key = (((piece >> 8) & ((1 << 48) - 1)) << _CTX) | (piece & 255) | (np.int64(ORDER) << _LEN)
        first, last = np.searchsorted(starts, lo, "right") - 1, np.searchsorted(starts, hi, "left")
        begin, end = starts[first:last], ends[first:last]
        at = end[end < hi] - lo
        key[at] = (key[at] & ~np.int64(511)) | END
        for size in range(ORDER):
            at = begin + size
            at = at[(at >= lo) & (at < hi) & (at <= end)] - lo
            context = (key[at] >> _CTX) & ((1 << 8 * size) - 1)
            key[at] = (size << _LEN) | (context << _CTX) | (key[at] & 511) if size > 1 else -1
        yield int(first), np.maximum(begin - lo, 0), key


def merged(key: np.ndarray, *numbers: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, with the sums of their numbers."""
    order = np.argsort(key, kind="stable")  # quick where sorted parts are put together
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.nonzero(new)[0]
    return key[first], *(np.add.reduceat(n[order], first) if len(first) else n for n in numbers)


def add_counts(held: list[np.ndarray], key: np.ndarray, n: np.ndarray) -> None:
    """Adds the numbers of distinct, sorted keys to ``held`` (the same of others): known keys where they lie, new ones between them."""
    place = np.searchsorted(held[0], key)
    known = place < len(held[0])
    known[known] = held[0][place[known]] == key[known]
    held[1][place[known]] += n[known]
    place, new = place[~known], ~known
    for i, column in enumerate((key, n)):
        held[i] = np.insert(held[i], place, column[new])


@dataclass
class Trie:
    """Contexts of all orders in sorted arrays: counts of their symbols, and what they hand on when they escape."""

    grams: np.ndarray  # keys
    log_count: np.ndarray
    contexts: np.ndarray
    log_total: np.ndarray  # log10 of count and escape parts, met first
    log_escape: np.ndarray
    left_total: np.ndarray  # the same of the next shorter context, without the symbols seen here
    left_escape: np.ndarray  # minus infinity if it has seen no others
    unseen: float  # log10 of each symbol's share below the empty context

    @classmethod
    def build(cls, longest: np.ndarray, counts: np.ndarray) -> Trie:
        """From the counts of keys with their longest contexts: shorter ones are sums over longer."""
        level_keys, level_counts, parts = longest, counts.astype(np.int64), []
        for order in range(ORDER, -1, -1):
            here = (level_keys >> _LEN) == order
            found, where = np.unique(level_keys[here], return_inverse=True)
            sums = np.bincount(where, level_counts[here], len(found)).astype(np.int64)
            parts.append((found, sums))
            if order:
                down = (suffix(found >> _CTX) << _CTX) | (found & 511)
                level_keys = np.concatenate([level_keys[~here], down])
                level_counts = np.concatenate([level_counts[~here], sums])
        grams = np.concatenate([k for k, _ in reversed(parts)])
        number = np.concatenate([n for _, n in reversed(parts)])
        contexts, owner, kinds = np.unique(grams >> _CTX, return_inverse=True, return_counts=True)
        total = np.bincount(owner, number, len(contexts))
        shorter = np.searchsorted(contexts, suffix(contexts))
        inherited = (suffix(grams >> _CTX) << _CTX) | (grams & 511)
        seen_below = number[np.searchsorted(grams, inherited)]
        excluded = np.bincount(owner, seen_below, len(contexts))
        left, left_kinds = total[shorter] - excluded, kinds[shorter] - kinds
        empty = int(kinds[0]) if len(contexts) else 0
        with np.errstate(divide="ignore"):
            return cls(
                grams,
                np.log10(number),
                contexts,
                np.log10(total + kinds),
                np.log10(kinds),
                np.log10(left + left_kinds),
                np.log10(left_kinds),
                -float(np.log10(max(1, SYMBOLS - empty))),
            )

    def log_probabilities(self, wanted: np.ndarray) -> np.ndarray:
        """log10 of the probability of every key's symbol after its context."""
        out, context, symbol = np.zeros(len(wanted)), wanted >> _CTX, wanted & 511
        if len(self.contexts) == 0:
            return np.full(len(wanted), self.unseen)
        open_ = np.arange(len(wanted))
        above = np.full(len(wanted), -1)  # the longer context that was left
        for _ in range(ORDER + 1):
            now = context[open_]
            place = np.minimum(np.searchsorted(self.contexts, now), len(self.contexts) - 1)
            known = self.contexts[place] == now
            key = (now << _CTX) | symbol[open_]
            gram = np.minimum(np.searchsorted(self.grams, key), len(self.grams) - 1)
            hit = self.grams[gram] == key
            longer = above[open_]
            first = longer < 0
            total = np.where(first, self.log_total[place], self.left_total[longer])
            escape = np.where(first, self.log_escape[place], self.left_escape[longer])
            out[open_[hit]] += self.log_count[gram[hit]] - total[hit]
            left = known & ~hit & np.isfinite(escape)  # else no symbol remains, or the context is new
            out[open_[left]] += escape[left] - total[left]
            above[open_] = np.where(known, place, longer)
            miss = ~hit
            done = miss & (now >> 48 == 0)
            out[open_[done]] += self.unseen
            open_ = open_[miss & ~done]
            context[open_] = suffix(context[open_])
            if len(open_) == 0:
                break
        return out


COUNTS = "word binary, key bigint, c bigint, n bigint"


def _no_words(size: int) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), size, [None, pa.py_buffer(bytes(4 * (size + 1))), pa.py_buffer(b"")])


def gram_rows(key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of counted grams, distinct and sorted, those of training texts with their mark: by ranges of few grams."""
    limits = np.unique(key[::POSITIONS] & ~_TRAIN)
    others, train = (np.searchsorted(key, [mark, *(limits | mark), mark + _TRAIN]).tolist() for mark in (np.int64(0), _TRAIN))
    for a, b, c, d in zip(others, others[1:], train, train[1:]):
        if a < b or c < d:
            number = np.concatenate([n[a:b], n[c:d]])
            trained = np.concatenate([np.zeros(b - a, np.int64), n[c:d]])
            part = merged(np.concatenate([key[a:b], key[c:d] & ~_TRAIN]), trained, number)
            yield pa.RecordBatch.from_arrays([_no_words(len(part[0])), *map(pa.array, part)], ["word", "key", "c", "n"])


def count(documents: DataFrame, training: Column, text_col: str = "text") -> DataFrame:
    """(word, key, c, n): every distinct token (key 0) and every distinct gram
    (empty word) with its count in training rows and in all. The end of a text
    counts as a token of its class, ``END_WORD`` and the class."""
    bound_batches(documents.sparkSession)

    def of_words(table: pa.Table) -> list[pa.RecordBatch]:
        key = pa.array(np.zeros(len(table), np.int64))
        return table.add_column(1, "key", key).select(["word", "key", "c", "n"]).to_batches()

    def added(tables: list[pa.Table]) -> pa.Table:
        sums = pa.concat_tables(tables).group_by("word", use_threads=False).aggregate([("c", "sum"), ("n", "sum")])
        return sums.rename_columns(["word", "c", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fresh, size, words = [np.empty(0, np.int64)] * 2, [], 0, []

        def put_together() -> None:
            counts = merged(*map(np.concatenate, zip(*fresh)))
            fresh.clear()
            add_counts(held, *counts)

        for batch in (b.slice(lo, TEXTS) for b in batches for lo in range(0, len(b), TEXTS)):
            train = np.array(batch["train"].to_pylist(), bool)
            texts = Texts.of(batch["text"].to_pylist())
            words.append(texts.counts(train))
            if sum(map(len, words[1:])) > FLUSH // 2:
                words = [added(words)]
                if len(words[0]) > FLUSH:
                    yield from of_words(words.pop())
            for mark, wanted in ((_TRAIN, train), (np.int64(0), ~train)):
                for _, _, key in keys([texts.rows[i] for i in np.nonzero(wanted)[0]]):
                    key, n = np.unique(key[key >= 0], return_counts=True)
                    fresh.append((key | mark, n))
                    size += len(key)
                    if size > FRESH_GRAMS:
                        put_together()
                        size = 0
                        if len(held[0]) > FLUSH_GRAMS:
                            yield from gram_rows(*held)
                            held[:] = [np.empty(0, np.int64)] * 2
        if words:
            yield from of_words(added(words))
        if fresh:
            put_together()
        yield from gram_rows(*held)

    rows = documents.select(whole_text(text_col).alias("text"), training.alias("train"))
    counted = rows.mapInArrow(run, COUNTS).repartition("word", "key")
    return counted.groupBy("word", "key").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def score_grams(grams: DataFrame, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """(key, n, score) of ``grams`` (key, c, n): the log10 probability of each by the counts ``c``.

    Contexts that share their last two bytes are scored by one task, which holds
    those of about ``block_grams`` grams at once. The counts of single bytes after
    single bytes, at most 65,792, are broadcast, as they belong to many tasks.
    """
    pairs = grams.filter(F.col("c") > 0).groupBy(F.col("key").bitwiseAND(F.lit((1 << 17) - 1)).alias("key"))
    singles = pairs.agg(F.sum("c").alias("n")).toArrow()
    one_key = singles["key"].to_numpy() | (np.int64(1) << _LEN)
    shared = grams.sparkSession.sparkContext.broadcast((one_key, singles["n"].to_numpy()))

    def score(frame: pd.DataFrame) -> pd.DataFrame:
        key, c = frame["key"].to_numpy(np.int64), frame["c"].to_numpy(np.int64)
        last = np.zeros(256, bool)
        last[(key >> _CTX) & 255] = True
        trie = Trie.build(*_with_singles(key[c > 0], c[c > 0], last, *shared.value))
        return pd.DataFrame({"key": key, "n": frame["n"], "score": trie.log_probabilities(key)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, most = [], 0, block_grams
        for frame in frames:
            held.append(frame)
            size += len(frame)
            if size > most:
                block = pd.concat(held, ignore_index=True)
                whole = int(np.searchsorted(block["pair"].to_numpy(), block["pair"].iloc[-1]))
                if whole:
                    yield score(block[:whole])
                held, size = [block[whole:]], size - whole
                most = max(block_grams, 2 * size)  # a pair that goes on is put together seldom
        if size:
            yield score(pd.concat(held, ignore_index=True))

    pair = F.shiftright("key", 9).bitwiseAND(F.lit(0xFFFF)).cast("int")
    dealt = grams.select("key", "c", "n", pair.alias("pair")).repartition("pair").sortWithinPartitions("pair")
    return dealt.mapInPandas(run, "key bigint, n bigint, score double")


def _with_singles(
    longest: np.ndarray, counts: np.ndarray, last: np.ndarray, one_key: np.ndarray, one_n: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Grams with counts that stand for the grams of other tasks: in contexts of one of the ``last`` bytes, and in none."""
    one = (np.int64(1) << _LEN) | (longest & ((1 << 17) - 1))
    mine = last[(one_key >> _CTX) & 255]
    rest_key, rest_n = merged(np.concatenate([one_key[mine], one]), np.concatenate([one_n[mine], -counts]))
    none_key, none_n = merged(one_key[~mine] & 511, one_n[~mine])
    rest_key, rest_n = rest_key[rest_n > 0], rest_n[rest_n > 0]
    return np.concatenate([longest, rest_key, none_key]), np.concatenate([counts, rest_n, none_n])


class Frequent:
    """Scores of frequent grams, the most frequent first; of those that share a slot the first is found."""

    def __init__(self, key: np.ndarray, score: np.ndarray):
        self.key, self.score = key, score
        self.slot = np.zeros(1 << SLOT_BITS, np.int32)  # a slot that is not taken shows the first, as any other key does
        self.slot[self._slots(key[::-1])] = np.arange(len(key) - 1, -1, -1, dtype=np.int32)

    @staticmethod
    def _slots(key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores, 0 where there are none, and where there are some."""
        if not len(self.key):
            return np.zeros(len(key)), np.zeros(len(key), bool)
        place = self.slot[self._slots(key)]
        hit = self.key[place] == key
        return np.where(hit, self.score[place], 0.0), hit


def _most_frequent(table: DataFrame, size: int) -> DataFrame:
    """The rows above a level of the count that at most ``size`` reach."""
    level = F.floor(F.log2("n") * 16).cast("int")
    held, least = 0, None
    for row in sorted(table.groupBy(level.alias("level")).count().collect(), reverse=True):
        held += row["count"]
        if held > size:
            break
        least = row["level"]
    return table.limit(0) if least is None else table.filter(level >= least)


PARTS = (
    "row bigint, word binary, key bigint, times bigint, "
    "of struct<doc_id:bigint, held_out:boolean, n_tokens:bigint, n_known:bigint, base:double, score:double>"
)
_OF = pa.struct(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())]
)


def _add_up(shared):
    """Per document a row with the sums over frequent tokens and grams, and a row per other token or gram."""

    def parts(row, word, key, times, of=None) -> pa.RecordBatch:
        columns = [pa.array(row, pa.int64()), word, pa.array(key, pa.int64()), pa.array(times, pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, pa.nulls(len(word), _OF) if of is None else of], ["row", "word", "key", "times", "of"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, grams_known, ends, class_scores = shared.value
        grams, c = Frequent(*grams_known), np.append(often["c"].to_numpy(), 0)  # a token's place without a count is the last
        for batch in (b.slice(lo, TEXTS) for b in batches for lo in range(0, len(b), TEXTS)):
            ids, texts = batch["row"].to_numpy(), Texts.of(batch["text"].to_pylist())
            place = pc.index_in(texts.words, value_set=often["word"]).fill_null(len(c) - 1).to_numpy()[texts.token]
            known = int(ends > 0) + np.bincount(texts.owner, texts.times * (c[place] > 0), len(ids))
            base = float(np.log10(ends + 1)) + np.bincount(texts.owner, texts.times * np.log10(c[place] + 1), len(ids))
            rare = np.nonzero(place == len(c) - 1)[0]
            word = texts.words.take(pa.array(texts.token[rare]))
            yield parts(ids[texts.owner[rare]], word, np.zeros(len(rare), np.int64), texts.times[rare])
            score = np.array([class_scores[kind] for kind in texts.kinds])
            for first, begin, key in keys(texts.rows):
                value, hit = grams.find(key)
                score[first : first + len(begin)] += np.add.reduceat(value, begin)
                miss = np.nonzero(~hit & (key >= 0))[0]
                owner = np.searchsorted(begin, miss, "right") - 1
                order = np.lexsort((key[miss], owner))
                wanted, owner = key[miss][order], first + owner[order]
                new = np.ones(len(miss), bool)
                new[1:] = (wanted[1:] != wanted[:-1]) | (owner[1:] != owner[:-1])
                at = np.nonzero(new)[0]
                yield parts(ids[owner[at]], _no_words(len(at)), wanted[at], np.diff(at, append=len(miss)))
            alone = [b" %d" % row for row in ids.tolist()]  # are no tokens: rows of documents match none and are spread
            none = np.zeros(len(ids), np.int64)
            sums = [pa.array(texts.sizes + 1), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)]
            of = pa.StructArray.from_arrays([batch["doc_id"], batch["held_out"], *sums], fields=list(_OF))
            yield parts(ids, pa.array(alone, pa.binary()), none, none, of)

    return run


def score_documents(
    documents: DataFrame, held_out: Column, text_col: str = "text", frequent: int = FREQUENT, frequent_grams: int = FREQUENT_GRAMS
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    The model and the add-one base learn from the rows that are not
    ``held_out`` (an expression over the columns; null counts as false). Null
    and empty texts consist of the end alone. Rows that repeat are scored and
    learned from each; without training rows all symbols are equally likely.

    Tokens and grams that are frequent (a bounded number) are added up where
    documents are read; only the others are shuffled to meet their scores.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    held = F.coalesce(held_out, F.lit(False))
    counted = materialize(count(documents, ~held, text_col), "ppm-counts")
    is_word, is_end = F.length("word") > 0, F.substring("word", 1, 1) == F.lit(END_WORD)
    kinds = {r["word"][1]: r["c"] for r in counted.filter(is_end).select("word", "c").collect()}
    words = counted.filter(is_word & ~is_end).select("word", "c", "n")
    grams = materialize(score_grams(counted.filter(~is_word).select("key", "c", "n"), BLOCK_GRAMS), "ppm-grams")
    totals = words.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    texts = sum(kinds.values())
    train_tokens, distinct = (totals["n"] or 0) + texts, totals["v"] + int(texts > 0)
    class_scores = [float(np.log10((kinds.get(k, 0) + 1) / (texts + CLASSES))) for k in range(CLASSES)]
    often = _most_frequent(words, frequent).filter(F.length("word") <= 256).select("word", "c").toArrow()
    often_grams = _most_frequent(grams, frequent_grams).toArrow()
    first = np.argsort(-often_grams["n"].to_numpy(), kind="stable")
    scores = often_grams["key"].to_numpy()[first], often_grams["score"].to_numpy()[first]
    shared = spark.sparkContext.broadcast((often, scores, texts, class_scores))
    rows = documents.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        held.alias("held_out"),
        whole_text(text_col).alias("text"),
    ).mapInArrow(_add_up(shared), PARTS)
    found = words.select("word", F.lit(0).cast("bigint").alias("key"), "c", F.lit(0.0).alias("score")).unionByName(
        grams.select(F.lit(b"").alias("word"), "key", F.lit(None).cast("bigint").alias("c"), "score")
    )
    met = rows.join(found.hint("shuffle_hash"), ["word", "key"], "left")  # distinct on this side, so not sorted
    times = F.col("times")
    log_c = F.log10(F.coalesce("c", F.lit(0)) + 1)
    sums = met.groupBy("row").agg(
        F.max("of.doc_id").alias("doc_id"),
        F.max("of.held_out").alias("held_out"),
        F.max("of.n_tokens").alias("n_tokens"),
        F.sum(F.coalesce("of.n_known", F.lit(0)) + F.when(F.col("c") > 0, times).otherwise(0)).alias("n_known"),
        F.sum(F.coalesce("of.base", F.lit(0.0)) + times * log_c).alias("base"),
        F.sum(F.coalesce("of.score", F.lit(0.0)) + times * F.coalesce("score", F.lit(0.0))).alias("score"),
    )
    share = float(np.log10(train_tokens + distinct + 1))
    return sums.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(int(train_tokens)).cast("bigint").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(share)).alias("base_score"),
        "score",
    )
