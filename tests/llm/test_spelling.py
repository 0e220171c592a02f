import random
import re
from collections import Counter
from zlib import crc32

import pandas as pd
import pytest

from pageloom.llm import spelling


def near(a, b):
    """Exactly one inserted, deleted or replaced code point apart."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, at_least=5, factor=5, modulus=199):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = crc32(f"{'null' if key is None else key}:{run}".encode())
            if h % modulus == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= at_least}
    around = {w: [v for v in words if near(w, v)] for w in words}
    forms = {}
    for w, others in around.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= factor * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, n, len(around[w]), words[forms[w]] if forms[w] else None))
    return sorted(out, key=str)


def run(spark, rows, **options):
    frame = spark.createDataFrame([(k, t, "a", 1) for k, t in rows], "doc_id long, text string, word string, n int")
    return sorted((tuple(r) for r in spelling.spelling_forms(frame, **options).collect()), key=str)


def corpus(seed, texts=30):
    """Texts over few stems with many edits at all places."""
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdeéÿ") for _ in range(rng.randint(6, 11))) for _ in range(25)]
    letters = "abcdeéÿ"

    def edited(word):
        at = rng.randrange(len(word))
        return rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice(letters) + word[at:], word[:at] + rng.choice(letters) + word[at + 1 :], word + rng.choice(letters)])

    variants = [edited(w) for w in stems for _ in range(12)]
    variants += [edited(v) for v in variants[:60]]
    pool = stems * 20 + variants
    return [(i, " ".join(rng.choice(pool).title() for _ in range(200))) for i in range(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    got = run(spark, rows, modulus=7)
    assert got == brute(rows, modulus=7)
    assert any(r[1] for r in got) and any(r[4] > 1 for r in got)


def test_many_blocks_and_chunks(spark, monkeypatch):
    rows = corpus(3)
    want = brute(rows, at_least=1)
    monkeypatch.setattr(spelling, "BLOCK", 40)
    assert run(spark, rows, at_least=1) == want


def test_chains_of_forms(spark):
    counts = {"abcdef": 5, "abcdefg": 25, "abcdefgh": 125, "abcdefghi": 625, "abcdefghj": 625}
    rows = [(1, " ".join(" ".join([w] * n) for w, n in counts.items()))]
    assert run(spark, rows, modulus=10**9) == brute(rows, modulus=10**9)
    assert {r[0]: r[2] for r in run(spark, rows, modulus=10**9)}["abcdef"] == "abcdefghi"


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "Straße straße " * 5), (3, "ÀÉÎÕÜŸ àéîõü× " * 6), (3, "ÀÉÎÕÜŸ àéîõü× " * 6), (4, "short " * 9), (5, ("x" * 20_000 + " ") * 5 + ("x" * 20_001 + " ") * 30)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_random_words_near_in_block():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(6, 9))) for _ in range(300)})
    table = pd.DataFrame({"word": words, "n": [rng.randint(5, 9) for _ in words]})
    count = dict(zip(table["word"], table["n"]))
    for shared in (True, False):
        got = {r.word: (r.n_near, r.best, r.best_n) for r in spelling.near_in_block(table, table, shared).itertuples()}
        for w in words:
            others = [v for v in words if near(w, v) and (v[:3] == w[:3]) == shared]
            best = min(others, key=lambda v: (-count[v], v), default=None)
            assert got.get(w) == (None if best is None else (len(others), best, count[best]))
