import math
import tracemalloc
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pageloom.llm import ppm
from pageloom.llm.common import fold


class Plain:
    """The same model over dictionaries of contexts."""

    def __init__(self, texts):
        self.contexts, self.kinds, self.counts, self.texts = {}, Counter(), Counter(), len(texts)
        for text in texts:
            words = Counter(ppm.tokens(text))
            kind = ppm.text_class(words)
            self.kinds[kind] += 1
            self.counts.update(words)
            for context, symbol in self.places(kind, ppm.tokens(text)):
                self.feed(context, symbol, 1)
        self.total = sum(self.counts.values()) + self.texts
        self.distinct = len(self.counts) + (self.texts > 0)

    @staticmethod
    def places(kind, words):
        row = [kind, *b" ", *b"".join(w + b" " for w in words), ppm.END]
        return [(bytes(row[max(0, p - ppm.ORDER) : p]), row[p]) for p in range(2, len(row))]

    def feed(self, context, symbol, n):
        for k in range(len(context) + 1):
            self.contexts.setdefault(context[k:], Counter())[symbol] += n

    def probability(self, context, symbol):
        out, excluded = 1.0, set()
        while True:
            seen = {s: n for s, n in self.contexts.get(context, {}).items() if s not in excluded}
            parts = sum(seen.values()) + len(seen)
            if symbol in seen:
                return out * seen[symbol] / parts
            if seen:
                out *= len(seen) / parts
                excluded |= set(seen)
            if not context:
                return out / (ppm.SYMBOLS - len(excluded))
            context = context[1:]

    def scores(self, text):
        words = ppm.tokens(text)
        kind = ppm.text_class(Counter(words))
        score = math.log10((self.kinds[kind] + 1) / (self.texts + ppm.CLASSES))
        score += sum(math.log10(self.probability(c, s)) for c, s in self.places(kind, words))
        space = self.total + self.distinct + 1
        base = sum(math.log10((self.counts[w] + 1) / space) for w in words) + math.log10((self.texts + 1) / space)
        return len(words) + 1, sum(self.counts[w] > 0 for w in words) + (self.texts > 0), base, score


def check(frame, rows, frequent, **options):
    held = fold(7) == 2
    model = Plain([t or "" for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2])
    got = ppm.score_documents(frame(rows), held, frequent=frequent).collect()
    assert len(got) == len(rows)
    want = sorted(((i, *model.scores(t or "")) for i, t in rows), key=str)
    for mine, (i, n, known, base, score) in zip(sorted(got, key=lambda r: str((r.doc_id, r.n_tokens, r.n_known, r.base_score))), want):
        assert (mine.doc_id, mine.n_tokens, mine.n_known, mine.train_tokens) == (i, n, known, model.total)
        assert mine.held_out == (i is not None and zlib.crc32(str(i).encode()) % 7 == 2)
        assert mine.base_score == pytest.approx(base, rel=1e-9)
        assert mine.score == pytest.approx(score, rel=1e-9)


@pytest.mark.parametrize("frequent", [0, 20, 65_536])
def test_against_dictionaries(frame, prose, frequent):
    check(frame, [(i, prose(i, 15) + " é" + "x" * (i % 5) + "Ü\x0bq") for i in range(30)], frequent)


def test_edges_of_a_table(frame):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "no id"), (5, "word " * 3000), (6, "one"), (6, "one"), (7, "z" * 5000)]
    check(frame, rows, 5)
    assert ppm.score_documents(frame([]), fold(7) == 2).count() == 0


def test_no_training_rows(frame):
    rows = ppm.score_documents(frame([(1, "ab c"), (2, None)]), F.lit(True)).collect()
    even = math.log10(1 / ppm.SYMBOLS)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[2].score == pytest.approx(even + math.log10(1 / ppm.CLASSES)) and by_id[2].train_tokens == 0
    assert by_id[1].score == pytest.approx(6 * even + math.log10(1 / ppm.CLASSES)) and by_id[1].n_known == 0


def test_probabilities_add_up_to_one(prose):
    texts = [prose(i, 30) for i in range(6)]
    model = Plain(texts)
    for context in list(model.contexts)[:40] + [b"nowhere", b""]:
        assert sum(model.probability(context, s) for s in range(ppm.SYMBOLS)) == pytest.approx(1)


def test_blocks_give_the_same(frame, prose):
    documents = frame([(i, prose(i, 25)) for i in range(20)])
    counted = ppm.count(documents, F.col("doc_id") < 15).filter(F.length("word") == 0).select("key", "c", "n")
    score = {r.key: r.score for r in ppm.score_grams(counted).collect()}
    many = ppm.score_grams(counted, block_grams=40).collect()
    assert len(many) == len(score)
    for r in many:
        assert r.score == pytest.approx(score[r.key])


def test_contexts_reach_over_the_ends_of_tokens(frame):
    rows = [(i, "the cat sat on the mat " * 5) for i in range(1, 9)] + [(98, "on the mat the cat sat"), (99, "mat the sat cat the on")]
    score = {r.doc_id: r.score for r in ppm.score_documents(frame(rows), F.col("doc_id") > 90).collect()}
    assert score[98] > score[99] + 1


@pytest.mark.parametrize("frequent_grams", [0, 50])
def test_grams_joined_or_not(frame, prose, frequent_grams):
    check(frame, [(i, prose(i, 15) + f" é{i}") for i in range(30)], 65_536, frequent_grams=frequent_grams)


def test_pieces_of_long_rows(monkeypatch, prose):
    rows = [ppm.coded(3, []), ppm.coded(4, ppm.tokens(prose(1, 40))), ppm.coded(5, [b"a"]), ppm.coded(6, [b"xy"] * 50)]
    whole = [key for _, _, piece in ppm.keys(rows) for key in piece.tolist()]
    for size in (1, 2, 5, 7, 64):
        monkeypatch.setattr(ppm, "POSITIONS", size)
        owners, found = [], []
        for first, begin, piece in ppm.keys(rows):
            owners += (first + ppm.np.searchsorted(begin, range(len(piece)), "right") - 1).tolist()
            found += piece.tolist()
        assert found == whole
        assert owners == [i for i, row in enumerate(rows) for _ in row]


def test_little_through_the_driver(frame, prose, monkeypatch):
    seen = []
    kind = type(frame([]))
    arrow = kind.toArrow
    monkeypatch.setattr(kind, "toPandas", None)
    monkeypatch.setattr(kind, "toArrow", lambda df: seen.append(len(out := arrow(df))) or out)
    ppm.score_documents(frame([(i, prose(i, 40)) for i in range(60)]), fold(7) == 2, frequent=10, frequent_grams=10).count()
    letters = 20
    assert max(seen) <= (letters + ppm.CLASSES) * letters


def test_counts_are_added_where_they_lie():
    rng = ppm.np.random.default_rng(3)
    held, want = [ppm.np.empty(0, ppm.np.int64)] * 2, {}
    for size in (0, 1, 300, 5, 300):
        key = ppm.np.unique(rng.integers(0, 500, size))
        n = rng.integers(1, 9, len(key))
        ppm.add_counts(held, key, n)
        for k, v in zip(key.tolist(), n.tolist()):
            want[k] = want.get(k, 0) + v
        assert list(zip(*(x.tolist() for x in held))) == sorted(want.items())
    held = [ppm.np.arange(1 << 20), ppm.np.ones(1 << 20, ppm.np.int64)]
    tracemalloc.start()
    ppm.add_counts(held, ppm.np.arange(0, 1 << 21, 16), ppm.np.ones(1 << 17, ppm.np.int64))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(held[0]) == (1 << 20) + (1 << 16) and peak < 32 << 20


def test_grams_are_passed_on_by_ranges(monkeypatch):
    rng = ppm.np.random.default_rng(4)
    for size in (1, 3, 16, 1000):
        monkeypatch.setattr(ppm, "POSITIONS", size)
        for plain, marked in ((200, 150), (0, 40), (40, 0), (0, 0), (3, 300)):
            other, train = (ppm.np.unique(rng.integers(0, 400, k)) for k in (plain, marked))
            key = ppm.np.concatenate([other, train | ppm._TRAIN])
            n = rng.integers(1, 9, len(key))
            want: dict = {}
            for k, v in zip(key.tolist(), n.tolist()):
                c, all_ = want.get(k & ~int(ppm._TRAIN), (0, 0))
                want[k & ~int(ppm._TRAIN)] = (c + v * (k >= ppm._TRAIN), all_ + v)
            batches = list(ppm.gram_rows(key, n))
            assert all(0 < len(b) <= 2 * size for b in batches)
            assert {r["key"]: (r["c"], r["n"]) for b in batches for r in b.to_pylist()} == want
            assert sum(map(len, batches)) == len(want)
