"""Words one code point apart, and the common spelling of each.

Near words are found in a bit-sliced index: for each (position, letter) a bitset
over the words of a block. For a word, recurrences over its letters keep four
sets for the whole block at once, 64 words per machine word: those that agree so
far (zero errors), and those that agree but for one replaced, one deleted or one
inserted letter, where the last two compare with the position before or after.

Blocks make the work proportional to the vocabulary. One edit leaves the first
three or the last three letters of a word of six or more as they are, so words
are dealt once by their first and once by their last three, and a pair counts in
the first deal if it shares the first three, else in the second: every near pair
is seen exactly once from either side. Blocks above ``BLOCK`` words are cut into
chunks, and every chunk meets every chunk in a task of its own.
"""

from __future__ import annotations

from collections import Counter
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, materialize_counted
from .common import bound_batches, whole_text

LETTERS = re.compile("[A-Za-zÀ-ÿ]{6,}")
#: Code points that an edit leaves at one end of a word.
AFFIX = 3
SHORTEST = 2 * AFFIX
#: Words of a block on average, and at most in a chunk of one.
BLOCK = 4096
#: Distinct words that a counting task keeps before it passes them on.
HELD = 1 << 20

_NEAR = "word string, n_near long, best string, best_n long"


def _lower(text: str) -> str:
    """A-Z in lower case, all else as it is."""
    return text.lower() if text.isascii() else text.encode().lower().decode()


def _count_runs(modulus: int):
    """From batches of (id, text) to partial counts of words. Runs below six
    letters are not looked at: deleting a letter cannot make them longer."""

    def rows(counts: Counter):
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                start = crc32(f"{key}:".encode())
                for word, n in Counter(LETTERS.findall(_lower(text))).items():
                    h = crc32(word.encode(), start)
                    if h % modulus == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < SHORTEST:
                            continue
                    counts[word] += n
                if len(counts) > HELD:
                    yield rows(counts)
                    counts = Counter()
        yield rows(counts)

    return run


def count_words(
    documents: DataFrame, at_least: int = 5, modulus: int = 199, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(word, n): runs of Latin letters of six code points or more with at least
    ``at_least`` occurrences over all texts, A-Z lower-cased.

    A run whose crc32 of ``<id>:<run>`` is divisible by ``modulus`` loses one
    code point first (simulated misspellings); an absent id is written ``null``.
    """
    bound_batches(documents.sparkSession)
    rows = documents.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), whole_text(text_col).alias("text")
    )
    counted = rows.mapInArrow(_count_runs(modulus), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= at_least)


def _letters(words: list[str], width: int) -> np.ndarray:
    """Words as rows of letters (all are below code point 256); 0 behind the end."""
    flat = np.array([w.encode("latin-1") for w in words], dtype=f"S{width}")
    return flat.view(np.uint8).reshape(len(words), width)


class Index:
    """Bitsets per (position, letter) over words in order of preference.

    They are made one position at a time, as the recurrences ask for them: only
    three positions are held, however long the words are.
    """

    def __init__(self, words: list[str], width: int):
        self.slots = -(-len(words) // 64)
        self.matrix = _letters(words, width)
        self.lengths = np.array([len(w) for w in words])
        self.alphabet = np.unique(self.matrix)
        self.place = np.zeros(256, np.int64)
        self.place[self.alphabet] = np.arange(len(self.alphabet))
        self.absent = np.zeros((len(self.alphabet) + 1, self.slots), np.uint64)

    def bits(self, mask: np.ndarray) -> np.ndarray:
        """Rows of booleans over the words as bitsets."""
        padded = np.zeros((len(mask), self.slots * 64), bool)
        padded[:, : mask.shape[1]] = mask
        return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)

    def position(self, at: int) -> np.ndarray:
        """A bitset for each letter of the alphabet; the last, for a letter that no
        word has, is empty."""
        if not 0 <= at < self.matrix.shape[1]:
            return self.absent
        sets = self.bits(self.matrix[:, at][None, :] == self.alphabet[:, None])
        return np.vstack([sets, np.zeros((1, self.slots), np.uint64)])

    def codes(self, letters: np.ndarray) -> np.ndarray:
        known = np.isin(letters, self.alphabet)
        return np.where(known, self.place[letters], len(self.alphabet))

    def near(self, letters: np.ndarray, shared: bool) -> np.ndarray:
        """Per query, of one length, the bitset of words one edit away: those that
        share the first three letters, or only those that don't."""
        n, length = letters.shape
        codes = self.codes(letters)
        zero = np.repeat(self.bits(np.ones((1, len(self.lengths)), bool)), n, axis=0)
        replaced, deleted, inserted = (np.zeros_like(zero) for _ in range(3))
        before, here = self.absent, self.position(0)
        head = zero
        for at in range(length):
            after = self.position(at + 1)
            letter = codes[:, at]
            agree = here[letter]
            inserted = (inserted | zero) & after[letter]
            deleted = (deleted & before[letter]) | zero
            replaced = (replaced & agree) | (zero & ~agree)
            zero = zero & agree
            if at == AFFIX - 1:
                head = zero
            before, here = here, after
        lengths = self.bits(np.stack([self.lengths == length - 1, self.lengths == length, self.lengths == length + 1]))
        # words that agree to the end have one letter more behind it
        found = (deleted & lengths[0]) | (replaced & lengths[1]) | ((inserted | zero) & lengths[2])
        return found & head if shared else found & ~head


def _first_bits(sets: np.ndarray) -> np.ndarray:
    """The lowest bit of each row; rows have at least one."""
    slot = (sets != 0).argmax(axis=1)
    value = sets[np.arange(len(sets)), slot]
    lowest = value & (~value + np.uint64(1))
    return slot * 64 + np.bitwise_count(lowest - np.uint64(1)).astype(np.int64)


def near_in_block(queries: pd.DataFrame, words: pd.DataFrame, shared: bool) -> pd.DataFrame:
    """Per query (word, n) with near words among ``words``: how many, and the best
    of them, the one with the largest n, then the smallest in code points."""
    words = words.sort_values(["n", "word"], ascending=[False, True])
    every, counts = words["word"].tolist(), words["n"].to_numpy()
    lengths = np.array([len(w) for w in every], np.int64)
    found = []
    for length, asked in queries["word"].groupby(queries["word"].str.len()):
        # bits stand in order of preference, so the best word is the lowest bit
        at = np.flatnonzero(np.abs(lengths - length) <= 1)
        if not len(at):
            continue
        index = Index([every[i] for i in at], length + 1)
        sets = index.near(_letters(asked.tolist(), length), shared)
        hit = np.flatnonzero(sets.any(axis=1))
        if len(hit):
            best = at[_first_bits(sets[hit])]
            n_near = np.bitwise_count(sets[hit]).sum(axis=1, dtype=np.int64)
            found.append((asked.to_numpy()[hit], n_near, [every[i] for i in best], counts[best]))
    columns = ["word", "n_near", "best", "best_n"]
    if not found:
        return pd.DataFrame({c: pd.Series(dtype=object if c in ("word", "best") else "int64") for c in columns})
    return pd.concat([pd.DataFrame(dict(zip(columns, part))) for part in found])


def _near_words(words: DataFrame, total: int) -> DataFrame:
    """(word, n_near, best, best_n) of words with near words."""
    blocks = max(1, total // BLOCK)

    def block(affix: Column) -> Column:
        return F.pmod(F.xxhash64(affix), F.lit(blocks)).cast("int")

    first = F.struct(F.lit(True).alias("shared"), block(F.substring("word", 1, AFFIX)).alias("block"))
    last = F.struct(F.lit(False).alias("shared"), block(F.substring("word", -AFFIX, AFFIX)).alias("block"))
    dealt = words.select("word", "n", F.explode(F.array(first, last)).alias("d")).select("word", "n", "d.*")
    sizes = dealt.groupBy("shared", "block").agg(F.ceil(F.count(F.lit(1)) / (2 * BLOCK)).cast("int").alias("chunks"))
    # one row per block, of thousands of words each
    sized = dealt.join(sizes, ["shared", "block"]).withColumn("chunk", F.pmod(F.xxhash64("word", F.lit(1)), F.col("chunks")).cast("int"))
    other = F.sequence(F.lit(0), F.col("chunks") - 1)
    asking = sized.withColumn("asked", F.explode(other)).select("shared", "block", F.col("chunk").alias("asking"), "asked", F.lit(True).alias("query"), "word", "n")
    asked = sized.withColumn("asking", F.explode(other)).select("shared", "block", "asking", F.col("chunk").alias("asked"), F.lit(False).alias("query"), "word", "n")

    def near(rows: pd.DataFrame) -> pd.DataFrame:
        query = rows["query"].astype(bool)
        return near_in_block(rows.loc[query], rows.loc[~query, ["word", "n"]], bool(rows["shared"].iat[0]))

    found = asking.unionByName(asked).groupBy("shared", "block", "asking", "asked").applyInPandas(near, _NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("rank"), F.col("best"))).alias("b")
    parts = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return parts.select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.rank")).alias("best_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last form reached. A form has several
    times the count of its word, so chains end; each step doubles their reach."""
    current, moving = materialize_counted(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while moving:
        beyond = current.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = current.join(beyond, "root", "left")
        step = materialize(step.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        moving = step.filter("moved").count()
        current = step.select("word", "root")
    return current


def spelling_forms(
    documents: DataFrame,
    at_least: int = 5,
    factor: int = 5,
    modulus: int = 199,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(word, form, root, n, n_near, form_n), a row per word of ``count_words``.

    ``n_near`` words are one inserted, deleted or replaced code point away; the
    one with the largest n (ties: smallest) is the ``form`` if it occurs
    ``factor`` times as often, and ``root`` is the last of the chain of forms,
    the word itself without one. Null and empty texts have no words, repeated
    rows count as often as they are there, an empty table gives no rows, other
    columns are not read.
    """
    words, total = materialize_counted(count_words(documents, at_least, modulus, id_col, text_col), "spelling-words")
    judged = words.join(_near_words(words, total), "word", "left")
    wins = F.col("best_n") >= F.lit(factor) * F.col("n")
    judged = materialize(
        judged.select(
            "word",
            F.when(wins, F.col("best")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(wins, F.col("best_n")).alias("form_n"),
        ),
        "spelling-forms",
    )
    roots = _roots(judged.filter("form is not null"))
    out = judged.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
