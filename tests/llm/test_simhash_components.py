import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pageloom.llm import simhash
from pageloom.llm.components import connected_components
from pageloom.llm.queries import QUERIES


def roots(nodes, near):
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {n: find(n) for n in nodes}


def plain_fingerprint(text, shingle=3):
    words = text.encode().lower().split()
    if not words:
        return 0
    size = min(shingle, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_by_counting_bits():
    for text in ("", " \n", "One", "a b", "A b C d e a B c", "é É x\x0by z", "a b c " * 50):
        assert simhash.fingerprint(text, 3) == plain_fingerprint(text)


def test_fingerprint_in_blocks(monkeypatch):
    text = " ".join(str(i * i) for i in range(500))
    whole = simhash.fingerprint(text, 3)
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(text, 3) == whole == plain_fingerprint(text)


def test_builtin_hash_is_the_same(spark):
    got = spark.sql("select xxhash64('one two three') as h").first().h
    assert got % (1 << 64) == xxhash.xxh64_intdigest(b"one two three", 42)


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
@pytest.mark.parametrize("bucket", [32, 2])
def test_links_against_all_pairs(spark, monkeypatch, bits, bucket):
    """Both ways of linking, small buckets and large, give the components of all pairs."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    if bits == 3 and bucket == 2:
        pytest.skip("two flips of 64 bits are many rows for a laptop")
    rng = np.random.default_rng(bits)
    prints = {int(x) for x in rng.integers(-(1 << 63), (1 << 63) - 1, 40)}
    for x in list(prints)[:25]:
        for _ in range(2):
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= int(simhash._signed(1 << int(b)))
            prints.add(x)
    df = spark.createDataFrame([(x,) for x in prints], "fp bigint")
    got = {r.node: r.root for r in connected_components(simhash.near_links(df, bits)).collect()}
    want = roots(prints, lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= bits)
    assert {n: got.get(n, n) for n in prints} == want


def test_crowded_group_has_linear_rows(spark):
    """A thousand fingerprints around one: no pairs are made of them."""
    rng = np.random.default_rng(1)
    prints = {0}
    while len(prints) < 1000:
        prints.add(simhash._signed(sum(1 << int(b) for b in rng.choice(64, 2, replace=False))))
    df = spark.createDataFrame([(x,) for x in prints], "fp bigint")
    edges = simhash.near_links(df, 2)
    assert edges.count() < 70 * len(prints)
    assert connected_components(edges).select("root").distinct().count() == 1


def test_components_of_chain_and_hub(spark):
    chain = [(i, i + 1) for i in range(60)]
    hub = [(1000, i) for i in range(2000, 2300)]
    got = connected_components(spark.createDataFrame(chain + hub + [(5, 5)], "u bigint, v bigint"))
    assert {r.root for r in got.collect()} == {0, 1000}
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_edges_of_a_table(frame, edges, spark):
    rows = simhash.simhash_groups(frame(edges)).collect()
    assert len(rows) == len(edges)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].component_id == by_id[2].component_id == by_id[3].component_id == 1
    assert by_id[1].fingerprint == "0" * 16 and by_id[6].component_id == 6
    kept = simhash.drop_near_duplicates(frame(edges))
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == [1, 5, 6, 6]
    assert kept.columns == frame(edges).columns
    assert simhash.simhash_groups(frame([])).count() == 0


def test_one_document_of_each_group(spark, frame, prose):
    """Null and repeated ids against brute force over rows: every group keeps one document."""
    a, b, c = prose(1), prose(2), prose(3)
    rows = [
        (None, a), (7, a), (None, b), (3, c), (5, c), (5, prose(4)), (None, prose(5)), (None, prose(5)), (9, prose(6)), (9, prose(6)),
        (8, prose(7)), (8, prose(8)), (None, None), (None, ""), (2, prose(9)), (None, prose(9)), (2, prose(9)), (None, prose(10).upper()), (None, prose(10)),
    ]
    prints = [simhash._signed(plain_fingerprint(t or "")) for _, t in rows]
    root = roots(set(prints), lambda x, y: ((x ^ y) % (1 << 64)).bit_count() <= 2)
    groups = {}
    for (id_, text), fp in zip(rows, prints):
        groups.setdefault(root[fp], []).append((id_, text or ""))
    kept = [(r.doc_id, r.text or "") for r in simhash.drop_near_duplicates(frame(rows)).collect()]
    assert not set(kept) - {(i, t or "") for i, t in rows}
    for members in groups.values():
        mine = [m for m in kept if m in members]
        least = min((i for i, _ in members if i is not None), default=None)
        assert len(set(mine)) == 1 and mine[0][0] == least
        assert len(mine) == (1 if least is None else members.count(mine[0]))
    assert len(kept) == sum(len([m for m in kept if m in members]) for members in groups.values())


def test_names_of_columns_are_free(frame, prose):
    extra = "row int, key int, fp int, least int, dropped int, __key string, _salt int"
    rows = frame([(1, prose(1)), (2, prose(1)), (None, None)], extra)
    kept = simhash.drop_near_duplicates(rows)
    assert kept.columns == rows.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "None"]


def test_query_has_every_document(spark, data):
    rows = QUERIES["op7_simhash"](spark, data)
    assert rows.columns == ["doc_id", "fingerprint", "component_id"]
    assert rows.count() == spark.read.parquet(f"{data}/documents.parquet").count()
    assert rows.filter(F.col("component_id") > F.col("doc_id")).count() == 0
