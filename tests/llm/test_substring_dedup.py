import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pageloom.llm import substring_dedup as S


def brute(rows, window):
    """(id, words, removed, kept) by a table of all windows."""
    texts = [(i if i is not None else S.NO_ID, S.split_words(t or "")) for i, t in rows]
    first = {}
    for i, words in texts:
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, words in texts:
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            if first[tuple(words[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = b" ".join(w for w, g in zip(words, gone) if not g).decode()
        out.append((None if i == S.NO_ID else i, len(words), sum(gone), kept))
    return sorted(out, key=str)


def rows_with_copies(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(6)]
    passages = [[rng.choice(words) for _ in range(rng.randint(5, 25))] for _ in range(4)]
    rows = []
    for i in range(40):
        text = []
        for _ in range(rng.randint(0, 5)):
            text += rng.choice(passages) if rng.random() < 0.6 else [rng.choice(words) for _ in range(rng.randint(1, 9))]
            if rng.random() < 0.2 and text:
                text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((rng.choice([i, i, i, i // 2, None]), rng.choice([" ", "\n", " \t "]).join(text)))
    return rows


@pytest.mark.parametrize("held", [400_000, 8])
@pytest.mark.parametrize("seed", range(3))
def test_against_all_windows(frame, monkeypatch, seed, held):
    monkeypatch.setattr(S, "HELD", held)
    rows = rows_with_copies(seed)
    got = S.remove_repeated(frame(rows), 7).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == brute(rows, 7)


def test_edges_of_a_table(frame, edges, prose):
    copies = [(100 + i, prose(3, 40) + f" own{i}") for i in range(50)]
    rows = edges + copies + [(99, "word " * 50), (200, None)]
    got = S.remove_repeated(frame(rows)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == brute(rows, 13)
    assert S.remove_repeated(frame([])).count() == 0


def test_automaton_against_search():
    rng = random.Random(4)
    for _ in range(40):
        automaton, before = S.Automaton(), []
        for owner in range(6):
            words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 14))]
            got = automaton.first_owners(words, 3)
            for end in range(1, len(words) + 1):
                part = words[end - 3 : end] if end >= 3 else None
                owners = [o for o, w in before if part and any(w[k : k + 3] == part for k in range(len(w) - 2))]
                assert got[end - 1] == (min(owners) if owners else None)
            automaton.add(words, owner)
            before.append((owner, words))


def test_equal_windows_have_equal_shards():
    rng = random.Random(2)
    passage = [str(rng.random()).encode() for _ in range(30)]
    found = []
    for seed in (1, 2):
        pad = [str(random.Random(seed).random()).encode() for _ in range(seed * 20)]
        key, starts, counts = S.stretches(pad + passage + pad)
        shard = {}
        for k, a, n in zip(key.tolist(), starts.tolist(), counts.tolist()):
            shard.update({w - len(pad): k for w in range(a, a + n)})
        found.append([shard[w] for w in range(len(passage) - S.WINDOW + 1)])
        assert counts.sum() == len(pad) * 2 + len(passage) - S.WINDOW + 1
    assert found[0] == found[1]


def test_query_digests(spark, data):
    from pageloom.llm.queries import QUERIES

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    want = {r[0]: r for r in brute(docs, 13)}
    for r in QUERIES["op10_substrings"](spark, data).collect():
        _, n, gone, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())


def test_rows_without_id_are_told_apart_by_more_than_32_bits(spark, frame):
    """Two texts of one 32-bit hash: only the repeated one loses words."""
    words = F.concat(F.lit("w"), F.col("id").cast("string"))
    text = F.concat_ws(" ", *[F.concat(words, F.lit(f"_{i}")) for i in range(14)])
    hashed = spark.range(150_000).select(text.alias("text")).withColumn("h", F.hash("text"))
    same = hashed.groupBy("h").agg(F.collect_list("text").alias("t")).filter("size(t) > 1").first().t
    rows = S.remove_repeated(frame([(1, same[0]), (None, same[0]), (None, same[1])])).collect()
    assert sorted((r.doc_id is None, r.n_removed, r.kept) for r in rows) == sorted([(False, 0, same[0]), (True, 14, ""), (True, 0, same[1])])
