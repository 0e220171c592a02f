"""Byte-level BPE over a lexicon compiled into a minimal acyclic transducer.

The words that are frequent in the corpus are encoded once on the driver and
compiled into an automaton that shares prefixes and suffixes; numbers on its
arcs add up to a word's index, which leads to its ids. Tasks map it into
memory. Words outside the lexicon are merged exactly, pair by pair.
"""

from __future__ import annotations

import gc
import heapq
import json
import mmap
import os
import re
import struct
import tempfile
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import bound_batches, whole_text

# Fixed value: how byte-level BPE splits text into words before any merge.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

# The same for texts of ASCII alone.
ASCII_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"

LEXICON = 65_536  # words compiled; only speed depends on it
MEMO = 250_000  # results in each of the two generations that a task remembers
SHORT = 48  # symbols up to which a word is merged by scanning
NEVER = 1 << 60
NONE = np.int32((1 << 31) - 1)  # rank of a pair that is never merged
MARKS = 1 << 22  # bits that tell which words a lexicon may hold
SLICE = 1 << 16  # ids whose bytes are put together at once
TEXTS = 250  # texts cut at once
TOGETHER = 8192  # words merged in one block


def _uneven(text: str) -> bool:
    """Whether a text must not be cut at its spaces: it has white space other than
    spaces and line ends, a space beside one of these, or one at an end."""
    if "  " in text or "\n " in text or " \n" in text or text[:1] == " " or text[-1:] == " ":
        return True
    solid = text.replace(" ", "").replace("\n", "")
    return solid != "" and solid.split(None, 1)[:1] != [solid]


def splitter():
    """A function that splits a text into its words."""
    every, ascii_only = regex.compile(WORDS).findall, re.compile(ASCII_WORDS, re.ASCII).findall
    return lambda text: ascii_only(text) if text.isascii() else every(text)


def byte_symbols() -> list[str]:
    """The printable symbol that stands for each byte in vocabulary files:
    itself where it prints, else the next code point from 256 on."""
    prints = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return [chr(b if b in prints else next(others)) for b in range(256)]


def packed(ids) -> bytes:
    """Ids as 32-bit numbers in a row, as they stand in a column."""
    return array("i", ids).tobytes()


class Vocabulary:
    """Ids of bytes and pairs, and the bytes of ids, of a byte-level vocabulary file."""

    def __init__(self, text: str):
        data = json.loads(text)
        model, kind = data["model"], (data.get("pre_tokenizer") or {})
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if model["type"] != "BPE" or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not plain:
            raise ValueError("only plain byte-level BPE vocabularies are supported")
        added = data.get("added_tokens", [])
        if data.get("normalizer") or any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("normalisers and trimming special tokens are not supported")
        symbols = byte_symbols()
        byte_of = {s: b for b, s in enumerate(symbols)}
        ids = model["vocab"]
        self.byte_ids = [ids[s] for s in symbols]
        self.bytes_of = {i: bytes(byte_of[c] for c in token) for token, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in added}
        self.bytes_of |= {i: token.encode() for token, i in self.special.items()}
        self.ranks: list[dict[int, int]] = [{} for _ in range(1 + max(ids.values()))]
        self.merged: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[ids[a]].setdefault(ids[b], rank)
            self.merged.append(ids[a + b])
        self.spelled: tuple | None = None
        self._tables()

    def _tables(self) -> None:
        """Ranks as arrays: by pair of bytes, and by pair of ids in order."""
        size = len(self.ranks)
        rows = sorted((a * size + b, rank) for a, row in enumerate(self.ranks) for b, rank in row.items())
        self.pair_keys = np.array([key for key, _ in rows] or [-1], np.int64)
        self.pair_ranks = np.array([rank for _, rank in rows] or [NONE], np.int32)
        self.id_of_byte = np.array(self.byte_ids, np.int32)
        self.id_of_rank = np.array(self.merged or [0], np.int32)
        a, b = np.divmod(np.arange(1 << 16), 256)
        self.byte_pairs = self._ranks_of(self.id_of_byte[a], self.id_of_byte[b])

    def _ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) * len(self.ranks) + b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE)

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """``merge`` of many words, ids packed into bytes: each step merges one pair
        in every word that has one left. Words of like length stand in one block."""
        out = [b""] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        short = order[(lengths[order] > 0) & (lengths[order] <= SHORT)].tolist()
        for i in np.flatnonzero(lengths > SHORT).tolist():
            out[i] = packed(self.merge(words[i]))
        for start in range(0, len(short), TOGETHER):
            block = short[start : start + TOGETHER]
            for i, ids in zip(block, self._merge_block([words[i] for i in block])):
                out[i] = ids
        return out

    def _merge_block(self, words: list[bytes]) -> list[bytes]:
        lengths = np.array([len(w) for w in words])
        width = int(lengths.max())
        raw = np.array(words, f"S{width}").view(np.uint8).reshape(len(words), width)
        ids = self.id_of_byte[raw]
        places = np.arange(width)
        ranks = np.full((len(words), width), NONE, np.int32)
        ranks[:, :-1] = self.byte_pairs[raw[:, :-1].astype(np.int32) * 256 + raw[:, 1:]]
        ranks[places >= lengths[:, None] - 1] = NONE
        after = np.broadcast_to(places + 1, ids.shape).copy()
        before = np.broadcast_to(places - 1, ids.shape).copy()
        rows = np.arange(len(words))
        while True:
            left = ranks[rows]
            at = left.argmin(axis=1)  # the leftmost of equals
            best = left[np.arange(len(rows)), at]
            some = best < NONE
            rows, at, best = rows[some], at[some], best[some]
            if not len(rows):
                break
            gone = after[rows, at]
            then = after[rows, gone]
            merged = self.id_of_rank[best]
            ids[rows, at], ids[rows, gone] = merged, -1
            ranks[rows, gone] = NONE
            after[rows, at] = then
            ranks[rows, at] = NONE
            more = then < lengths[rows]
            r, p, q = rows[more], at[more], then[more]
            before[r, q] = p
            ranks[r, p] = self._ranks_of(ids[r, p], ids[r, q])
            earlier = before[rows, at]
            more = earlier >= 0
            r, p, q = rows[more], earlier[more], at[more]
            ranks[r, p] = self._ranks_of(ids[r, p], ids[r, q])
        left = (ids >= 0) & (places < lengths[:, None])
        flat, ends = ids[left].tobytes(), (4 * np.cumsum(left.sum(axis=1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def decode_all(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids one after the other, and how many each has."""
        if self.spelled is None:
            tokens = [self.bytes_of.get(i, b"") for i in range(1 + max(self.bytes_of))]
            sizes = np.array([len(t) for t in tokens], np.int64)
            self.spelled = (np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes, sizes)
        spelled, starts, sizes = self.spelled
        parts, counts = [], sizes[ids]
        for at in range(0, len(ids), SLICE):
            some, n = ids[at : at + SLICE], counts[at : at + SLICE]
            shift = starts[some] - (np.cumsum(n) - n)
            parts.append(spelled[np.repeat(shift, n) + np.arange(n.sum())])
        return np.concatenate(parts) if parts else np.empty(0, np.uint8), counts

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Ids of one word: the pair of lowest rank, the leftmost of equals, is merged until none is left."""
        ids = [self.byte_ids[b] for b in word]
        return tuple(self._scan(ids) if len(ids) <= SHORT else self._heap(ids))

    def _scan(self, ids: list[int]) -> list[int]:
        ranks = self.ranks
        pairs = [ranks[a].get(b, NEVER) for a, b in zip(ids, ids[1:])]
        while pairs:
            best = min(pairs)
            if best == NEVER:
                break
            i = pairs.index(best)
            ids[i : i + 2] = [self.merged[best]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks[ids[i - 1]].get(ids[i], NEVER)
            if i < len(pairs):
                pairs[i] = ranks[ids[i]].get(ids[i + 1], NEVER)
        return ids

    def _heap(self, ids: list[int]) -> list[int]:
        """The same for long words, in n log n steps over a linked list."""
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (r := self.ranks[ids[i]].get(ids[j])) is not None:
                heap.append((r, i, ids[i], ids[j])) if building else heapq.heappush(heap, (r, i, ids[i], ids[j]))

        building = True
        for i in range(len(ids) - 1):
            offer(i)
        heapq.heapify(heap)
        building = False
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.merged[rank], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x in ids if x >= 0]


def compile_lexicon(entries: dict[bytes, tuple[int, ...]]) -> bytes:
    """The transducer of ``entries`` as bytes that can be memory-mapped.

    Words are added in order; a state is shared as soon as no later word can
    change it. Arcs hold a label, a target and the number of smaller words
    they pass over, so that the numbers along a word are its index.
    """
    shared: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []
    words: list[int] = []  # words below each state

    def close(node: list) -> int:
        arcs = tuple((label, target) for label, target in node[1])
        key = (node[0], arcs)
        if key not in shared:
            shared[key] = len(states)
            states.append(key)
            words.append(node[0] + sum(words[t] for _, t in arcs))
        return shared[key]

    path: list[list] = [[False, []]]
    last = b""
    ordered = sorted(entries)
    for word in ordered:
        same = len(os.path.commonprefix([word, last]))
        while len(path) > same + 1:
            done = close(path.pop())
            path[-1][1].append((last[len(path) - 1], done))
        path += [[False, []] for _ in word[same:]]
        path[-1][0] = True
        last = word
    while len(path) > 1:
        done = close(path.pop())
        path[-1][1].append((last[len(path) - 1], done))
    root = close(path[0])

    first, labels, targets, skips, final = [0], bytearray(), [], [], []
    for accepts, arcs in states:
        passed = int(accepts)
        for label, target in arcs:
            labels.append(label)
            targets.append(target)
            skips.append(passed)
            passed += words[target]
        first.append(len(labels))
        final.append(int(accepts))
    ends, ids = [0], []
    for word in ordered:
        ids.extend(entries[word])
        ends.append(len(ids))
    tables = (first, targets, skips, final, ends, ids)
    marks = bytearray(MARKS // 8)
    for word in ordered:
        mark = crc32(word) % MARKS
        marks[mark >> 3] |= 1 << (mark & 7)
    head = struct.pack("<9i", root, len(labels), *map(len, tables), 0)
    return head + b"".join(struct.pack(f"<{len(t)}i", *t) for t in tables) + bytes(marks) + bytes(labels)


_BYTES = [bytes((b,)) for b in range(256)]


class Lexicon:
    """Look-ups in a compiled transducer that is mapped into memory."""

    def __init__(self, data: bytes):
        with tempfile.TemporaryFile() as file:  # has no name: nothing stays behind
            file.write(data)
            file.flush()
            self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        self.root, arcs, *sizes, _ = struct.unpack_from("<9i", self.map)
        view, at, tables = memoryview(self.map), 36, []
        for size in sizes:
            tables.append(view[at : at + 4 * size].cast("i"))
            at += 4 * size
        self.first, self.targets, self.skips, self.final, self.ends, self.ids = tables
        self.marks, self.labels = np.frombuffer(self.map, np.uint8, MARKS // 8, at), at + MARKS // 8

    def get(self, word: bytes) -> tuple[int, ...] | None:
        found = self.packed(word)
        return None if found is None else tuple(memoryview(found).cast("i"))

    def likely(self, words: list[bytes]) -> list[int]:
        """Places of the words that may be here: most others have no mark."""
        marks = np.fromiter(map(crc32, words), np.int64, len(words)) % MARKS
        return np.flatnonzero(self.marks[marks >> 3] >> (marks & 7).astype(np.uint8) & 1).tolist()

    def packed(self, word: bytes) -> bytes | None:
        state, index, base, find = self.root, 0, self.labels, self.map.find
        first, skips, targets = self.first, self.skips, self.targets
        for byte in word:
            arc = find(_BYTES[byte], base + first[state], base + first[state + 1]) - base
            if arc < 0:
                return None
            index += skips[arc]
            state = targets[arc]
        if not self.final[state]:
            return None
        return self.ids[self.ends[index] : self.ends[index + 1]].tobytes()


class Memo(dict):
    """Remembers the latest results of a function, between ``MEMO`` and twice as many."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> tuple[int, ...]:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= MEMO:
            self.older = dict(self)
            self.clear()
        if len(key) <= 64:
            self[key] = value
        return value


class Codec:
    """Encodes and decodes texts, and remembers the ids of words and of stretches between spaces."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None):
        self.vocabulary, self.lexicon, self.split = vocabulary, lexicon, splitter()
        self.learned: dict[str, bytes] = {}
        self.words = Memo(self._word)
        self.stretches = Memo(self._stretch)
        self.specials = list(vocabulary.special)
        names = sorted(self.specials, key=len, reverse=True)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, names)) + ")").split if names else None

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """``encode`` of many texts, packed: what stands between spaces in any of
        them and is not known yet is merged at once, then the texts are joined."""
        cut = [None if self._special(text) or _uneven(text) else text.split(" ") for text in texts]
        between: set[str] = set()
        for parts in cut:
            if parts:
                between.update(parts[1:])
        known = self._learn(between)
        out = []
        for text, parts in zip(texts, cut):
            if parts is None:
                out.append(packed(self.encode(text)))
            else:
                first = packed(self._plain(parts[0]))
                out.append(first + b"".join(map(known.__getitem__, parts[1:])))
        return out

    def _learn(self, between: set[str]) -> dict[str, bytes]:
        """The packed ids of all stretches in ``between``, each after a space."""
        if len(self.learned) > MEMO:
            self.learned = {s: self.learned[s] for s in between if s in self.learned}
        known = self.learned
        new = between.difference(known)
        # most are one word of plain letters
        alone = [s for s in new if s.isascii() and s.isalpha()]
        raw = ("\n".join([" " + s for s in alone])).encode().split(b"\n") if alone else []
        known.update(zip(alone, self._resolve(raw)))
        mixed = list(new.difference(alone))
        cut = [self.split(" " + s) for s in mixed]
        ids, unseen = {}, []
        for word in set(chain.from_iterable(cut)):
            found = known.get(word[1:]) if word[0] == " " else None
            if found is None:
                unseen.append(word)
            else:
                ids[word] = found
        ids.update(zip(unseen, self._resolve([word.encode("utf-8", "surrogatepass") for word in unseen])))
        known.update(zip(mixed, [b"".join([ids[w] for w in words]) for words in cut]))
        return known

    def _resolve(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of distinct words, from the lexicon or by merging."""
        out: list[bytes | None] = [None] * len(words)
        if self.lexicon:
            for i in self.lexicon.likely(words):
                out[i] = self.lexicon.packed(words[i])
        unseen = [i for i, found in enumerate(out) if found is None]
        for i, found in zip(unseen, self.vocabulary.merge_all([words[i] for i in unseen])):
            out[i] = found
        return out

    def _special(self, text: str) -> bool:
        return any(name in text for name in self.specials)

    def _word(self, word: str) -> tuple[int, ...]:
        raw = word.encode("utf-8", "surrogatepass")
        ids = self.lexicon.get(raw) if self.lexicon else None
        return self.vocabulary.merge(raw) if ids is None else ids

    def _stretch(self, stretch: str) -> tuple[int, ...]:
        """What stands between two spaces, with the first of them."""
        one_word = stretch.isascii() and stretch.isalpha()
        return self._word(" " + stretch) if one_word else self._plain(" " + stretch)

    def _plain(self, text: str) -> tuple[int, ...]:
        words = self.words
        return tuple(chain.from_iterable([words[w] for w in self.split(text)]))

    def encode(self, text: str) -> list[int]:
        """Ids of a text; the strings of special tokens stand for their ids.

        A space between two characters that are no white space always begins a
        word, so that what lies between such spaces may be encoded on its own.
        """
        if self._special(text):
            out: list[int] = []
            for i, part in enumerate(self.special_split(text)):
                out += [self.vocabulary.special[part]] if i % 2 else self._between(part)
            return out
        return self._between(text)

    def _between(self, text: str) -> list[int]:
        if _uneven(text):
            return list(self._plain(text))
        first, *others = text.split(" ")
        stretches = self.stretches
        out = list(self._plain(first))
        out.extend(chain.from_iterable([stretches[s] for s in others]))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens included."""
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def stretch_counts(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """(stretch, n): how often each run without white space occurs in all texts."""
    bound_batches(documents.sparkSession)

    def counts(seen: Counter) -> pa.RecordBatch:
        short = [(s, n) for s, n in seen.items() if len(s) <= 64]
        columns = [pa.array([s for s, _ in short], pa.string()), pa.array([n for _, n in short], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["stretch", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(text.split())
                if len(seen) > MEMO:
                    yield counts(seen)
                    seen.clear()
        yield counts(seen)

    rows = documents.select(whole_text(text_col).alias("text")).mapInArrow(count, "stretch string, n bigint")
    return rows.groupBy("stretch").agg(F.sum("n").alias("n"))


def frequent_words(documents: DataFrame, size: int = LEXICON, text_col: str = "text") -> set[str]:
    """The words of the most frequent stretches of all texts, with a space in front and without.

    Stretches are taken down to the level of the count at which there would be
    more than ``size``. Levels are logarithmic, so that their table is small
    whatever the corpus, and only what is chosen comes to the driver.
    """
    level = F.floor(F.log2("n") * 16).cast("int")
    counts = materialize(stretch_counts(documents, text_col).withColumn("level", level), "words")
    held, least = 0, None
    for row in sorted(counts.groupBy("level").count().collect(), reverse=True):
        held += row["count"]
        if held > size:
            break
        least = row["level"]
    if least is None:
        return set()
    split = splitter()
    chosen = counts.filter(F.col("level") >= least).select("stretch").collect()
    return {word for r in chosen for word in (*split(r.stretch), *split(" " + r.stretch))}


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode_documents(
    documents: DataFrame, vocabulary_path: str, lexicon_size: int = LEXICON, text_col: str = "text"
) -> DataFrame:
    """``documents`` with ``token_ids`` (array of int) and ``decoded`` (the text
    of these ids), which replace columns of those names.

    Ids are those of the vocabulary file, whatever the lexicon holds. Null and
    empty texts have no ids and decode to the empty text. The file is read on
    the driver; its text and the compiled lexicon (both bounded: by the file
    and by ``lexicon_size``) are broadcast.
    """
    spark = documents.sparkSession
    source = read_vocabulary(vocabulary_path)
    vocabulary = Vocabulary(source)
    words = [w.encode("utf-8", "surrogatepass") for w in frequent_words(documents, lexicon_size, text_col)]
    compiled = compile_lexicon({w: vocabulary.merge(w) for w in words})
    shared, run_name = spark.sparkContext.broadcast((source, compiled)), uuid.uuid4().hex
    bound_batches(spark)

    @F.arrow_udf("token_ids array<int>, decoded string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(run_name, shared)
        for texts in batches:
            # hundreds of thousands of small objects come at once, none in a cycle
            gc.disable()
            try:
                yield _columns(codec, texts.to_pylist())
            finally:
                gc.enable()

    coded = documents.select(F.struct("*").alias("row"), run(whole_text(text_col)).alias("coded"))
    kept = [F.col("row")[c].alias(c) for c in documents.columns if c not in ("token_ids", "decoded")]
    return coded.select(*kept, "coded.token_ids", "coded.decoded")


def _columns(codec: Codec, texts: list[str]) -> pa.Array:
    """Ids and decoded texts as columns, without an object per id."""
    coded = []
    for lo in range(0, len(texts), TEXTS):
        coded += codec.encode_all(texts[lo : lo + TEXTS])
    ids = np.frombuffer(b"".join(coded), np.int32)
    ends = np.cumsum([0, *(len(c) // 4 for c in coded)])
    decoded, sizes = codec.vocabulary.decode_all(ids)
    bytes_before = np.concatenate(([0], np.cumsum(sizes)))[ends]
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
    strings = pa.StringArray.from_buffers(
        len(texts), pa.py_buffer(bytes_before.astype(np.int32).tobytes()), pa.py_buffer(decoded.tobytes())
    )
    strings.validate(full=True)  # what encodes a text decodes to it, which is UTF-8
    return pa.StructArray.from_arrays([lists, strings], ["token_ids", "decoded"])


_KEPT: dict[str, Codec] = {}


def _codec(run: str, shared) -> Codec:
    """The codec of a run, kept by a worker for its next tasks."""
    if run not in _KEPT:
        _KEPT.clear()
        source, compiled = shared.value
        _KEPT[run] = Codec(Vocabulary(source), Lexicon(compiled))
    return _KEPT[run]
