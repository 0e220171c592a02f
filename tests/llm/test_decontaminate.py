import numpy as np

from pageloom.llm import decontaminate as D
from pageloom.llm.queries import QUERIES


def plain_tiling(doc, item, match):
    """Greedy tiling by looking at every pair of places, again for every tile."""
    marked_doc, marked_item, tiles = [False] * len(doc), [False] * len(item), []
    while True:
        best = (match - 1, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while (
                    i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n]
                    and not marked_doc[i + n] and not marked_item[j + n]
                ):
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < match:
            return sorted(tiles)
        tiles.append((i, j, n))
        marked_doc[i : i + n] = marked_item[j : j + n] = [True] * n


def test_tiling_against_all_pairs():
    rng = np.random.default_rng(0)
    for _ in range(60):
        words = [f"w{k}" for k in rng.integers(0, 4, 14)]
        doc = [f"w{k}" for k in rng.integers(0, 4, 30)]
        doc[5:12] = words[:7]
        items = D.Items([(1, " ".join(words))], 3)
        found = items.overlaps(" ".join(doc), 0.0)
        assert (found[0][4] if found else []) == plain_tiling(doc, words, 3)


ITEM = "The quick brown fox jumps over the lazy dog while seven wizards brew potions under a pale moon tonight"


def test_reordered_and_edited_passages_are_caught(frame, spark, prose):
    words = ITEM.split()
    turned = " ".join(words[9:] + words[:9]).upper().replace(" ", ", ")
    rows = [(1, prose(1) + " " + ITEM + " " + prose(2)), (2, f"{prose(3)} “{turned}” {prose(4)}"), (3, prose(5)),
            (4, " ".join(words[:7])), (5, None), (6, "")]
    benchmark = spark.createDataFrame([(10, ITEM, "x"), (10, ITEM, "x"), (11, None, "x"), (12, "", "x"), (None, "no id at all", "x")],
                                      "item_id bigint, text string, doc_id string")
    got = {(r.doc_id, r.item_id): r.coverage for r in D.benchmark_overlaps(frame(rows), benchmark).collect()}
    assert got == {(1, 10): 1.0, (2, 10): 1.0}
    kept = D.drop_contaminated(frame(rows), benchmark)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6] and kept.columns == frame(rows).columns
    blocks = D.benchmark_overlaps(frame(rows), benchmark, block_chars=20)
    assert {(r.doc_id, r.item_id): r.coverage for r in blocks.collect()} == got
    assert sorted(r.doc_id for r in D.drop_contaminated(frame(rows), benchmark, block_chars=20).collect()) == [3, 4, 5, 6]


def test_short_items_must_occur_whole(frame, spark):
    benchmark = spark.createDataFrame([(1, "rare words")], "item_id bigint, text string")
    got = D.benchmark_overlaps(frame([(1, "some Rare, words here"), (2, "rare other words"), (None, "rare words")]), benchmark)
    assert sorted((r.doc_id or 0) for r in got.collect()) == [0, 1]


def test_long_repetitive_text(frame, spark):
    benchmark = spark.createDataFrame([(1, "word " * 40)], "item_id bigint, text string")
    got = D.benchmark_overlaps(frame([(1, "word " * 20_000)]), benchmark).collect()
    assert got[0].covered == 40


def test_equal_tokens_make_no_pairs():
    """40,000 x 1,000 equal tokens, and two that take turns, in bounded memory."""
    import tracemalloc

    for word in ("word ", "one two "):
        items = D.Items([(1, word * 1_000)], 5)
        tracemalloc.start()
        (found,) = items.overlaps(word * 40_000, 0.5)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert found[2] == found[1] and peak < 200 << 20


def test_seed_of_very_many_items():
    """Items that share a seed only are passed over before any tiling."""
    items = D.Items([(k, f"a b c d e f{k} g{k} h{k} i{k} j{k} k{k}") for k in range(20_000)], 5)
    assert items.promising(5, D.running_hashes(np.arange(1, 6), 5, np.array([0])), 0.5) == []
    found = items.overlaps("a b c d e " * 300 + "f7 g7 h7 i7 j7", 0.5)
    assert [f[0] for f in found] == [7]


def test_tiling_of_two_words_against_all_pairs():
    rng = np.random.default_rng(1)
    for size in (1, 2, 3, 5, 17):
        for _ in range(12):
            words = [f"w{k}" for k in rng.integers(0, 2, size)]
            doc = [f"w{k}" for k in rng.integers(0, 3, 25)]
            match = min(3, size)
            found = D.Items([(1, " ".join(words))], 3).overlaps(" ".join(doc), 0.0)
            assert (found[0][4] if found else []) == plain_tiling(doc, words, match)


def test_scripts_without_spaces(frame, spark):
    item = "\u5317\u4eac\u5927\u5b66\u5386\u53f2\u7cfb\u4f4d\u4e8e"
    benchmark = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    rows = [(1, "\u6211\u4eec\u77e5\u9053" + item + "\u6d77\u6dc0\u533a"), (2, "\u6211\u4eec\u77e5\u9053\u6d77\u6dc0\u533a")]
    got = D.benchmark_overlaps(frame(rows), benchmark).collect()
    assert [(r.doc_id, r.coverage) for r in got] == [(1, 1.0)]


def test_empty_tables(frame, spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert D.benchmark_overlaps(frame([(1, "a b c d e f")]), none).count() == 0
    assert D.benchmark_overlaps(frame([]), none).count() == 0
    assert D.drop_contaminated(frame([(1, "a")]), none).count() == 1


def test_query_finds_whole_items(spark, data):
    got = {(r.doc_id, r.item_id) for r in QUERIES["op4_decontamination"](spark, data).collect()}
    items = spark.read.parquet(f"{data}/benchmark.parquet").collect()
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    assert {(d.doc_id, i.item_id) for d in docs for i in items if i.text in (d.text or "")} <= got
