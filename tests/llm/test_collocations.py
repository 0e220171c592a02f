import re
from collections import Counter

import pytest

from pageloom.llm import collocations


def brute(rows, at_least, inside, k):
    """Phrases by their definition, counted in dictionaries."""
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\\n\\x0b\\x0c\\r]", lowered):
            words = re.findall("[^ \\t]+", piece)
            total[lang] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    counts[lang, tuple(words[i : i + size])] += 1
    candidates = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= at_least}
    found = []
    for (lang, words), a in candidates.items():
        parts = [(counts[lang, words[:cut]], counts[lang, words[cut:]]) for cut in range(1, len(words))]
        score, _, (left, right) = min((1000000 * a * a // (x * y), i, (x, y)) for i, (x, y) in enumerate(parts))
        longer = [b for (other, w), b in candidates.items() if other == lang and len(w) > len(words) and words in (w[:2], w[1:])]
        if not any(100 * b >= inside * a for b in longer):
            found.append((lang, " ".join(words), a, left, right, total[lang], score))
    out = []
    for lang in total:
        ranked = sorted((f for f in found if f[0] == lang), key=lambda f: (-f[6], -f[2], f[1].encode()))
        out += [(lang, rank, *f[1:]) for rank, f in enumerate(ranked[:k], 1)]
    return sorted(out)


def run(spark, rows, at_least=3, inside=50, k=2000):
    frame = spark.createDataFrame([(i, t, lang, "x", "y") for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, n string")
    best = collocations.best_collocations(collocations.collocations(frame, at_least, inside), k)
    return sorted(tuple(r) for r in best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_equals_brute_force(spark, prose):
    rows = [("en" if i % 3 else "fr", prose(i, 90).replace("ke", "ke,", i % 2).replace("mi", "Mi\t ")) for i in range(40)]
    rows += [("en", "red green blue. Red green blue; RED  green blue! red green"), ("en", "É é É é É é")]
    assert run(spark, rows) == brute(rows, 3, 50, 2000)
    assert run(spark, rows, k=5) == brute(rows, 3, 50, 5)


def test_edges(spark):
    rows = [(None, "a b a b a b"), ("en", None), ("en", ""), ("fr", " \t\n.,"), ("en", "x" * 100_000), ("de", "la " * 40_000), ("de", "\x1f \x1f \x1f \x1f")]
    assert run(spark, rows) == brute(rows, 3, 50, 2000)
    assert run(spark, rows + rows) == brute(rows + rows, 3, 50, 2000)
    assert run(spark, []) == []


def test_phrases_across_chunks(spark, prose, monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 50)
    rows = [("en", prose(i, 60)) for i in range(6)] + [("en", "one two three. " * 20)]
    got = list(collocations._counter(collocations._words_and_pairs, 1)([_batch(rows)]))
    counts = Counter()
    for batch in got:
        for row in batch.to_pylist():
            counts[row["phrase"]] += row["n"]
    words = [re.findall("[^ ]+", piece) for _, t in rows for piece in t.split(".")]
    assert counts[""] == sum(map(len, words))
    pairs = Counter(" ".join(p) for w in words for p in zip(w, w[1:]))
    assert {p: n for p, n in counts.items() if " " in p} == pairs


def _batch(rows):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["lang", "text"])


def test_full_bit_table_changes_nothing(spark, prose):
    frame = spark.createDataFrame([("en", prose(i, 80)) for i in range(20)], "lang string, text string")
    roomy, full = (collocations.count_phrases(frame, 3, bits=bits).collect() for bits in (1 << 20, 64))
    assert sorted(roomy) == sorted(full)


def test_merge_joins(spark, prose):
    rows = [("en", prose(i, 80)) for i in range(10)]
    frame = spark.createDataFrame(rows, "lang string, text string")
    counts = collocations.count_phrases(frame, 3)
    from pyspark.sql import functions as F

    pairs = counts.filter("size = 2").select("lang", "phrase", "n", F.substring_index("phrase", " ", 1).alias("head"))
    singles = counts.filter("size = 1").select("lang", "phrase", F.col("n").alias("l"))
    plan = collocations._lockstep(pairs, singles, "head")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan


@pytest.mark.parametrize("a, left, right", [(10**12, 10**12, 10**12), (999_999_937, 1_000_000_007, 1_000_000_009)])
def test_large_counts(spark, a, left, right):
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    assert row.select(collocations._score("a", "l", "r")).first()[0] == 1000000 * a * a // (left * right)
