import corpus_pipeline
from pageloom.llm import bpe, gam, simhash
from pageloom.llm.common import fold, table
from pageloom.llm.queries import vocabulary_path


def test_stages_against_brute_force(spark, data):
    """Every stage on what the one before it kept."""
    docs = table(spark, data, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        rows = out.collect()
        seen[name] = rows
        if name != "encoding":
            assert out.columns == columns
            docs = spark.createDataFrame(rows, docs.schema)
    texts = {r.doc_id: r.text for r in table(spark, data, "documents").collect()}
    model = gam.fit_quality(table(spark, data, "documents"), table(spark, data, "labels"), fold(3) != 1)
    import numpy as np

    good = {i for i, t in texts.items() if model.score(np.array([gam.features(t)]))[0] >= 0.5}
    assert {r.doc_id for r in seen["quality"]} == good
    groups = {}
    for i in sorted(good):
        groups.setdefault(simhash.fingerprint(texts[i], 3), i)
    prints, kept = sorted(groups, key=groups.get), set()
    parent = {p: p for p in prints}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a in prints:
        for b in prints:
            if groups[a] < groups[b] and (a ^ b).bit_count() <= 2:
                x, y = sorted((find(a), find(b)), key=groups.get)
                parent[y] = x
    kept = {groups[p] for p in prints if find(p) == p}
    assert {r.doc_id for r in seen["near_duplicates"]} == kept
    items = [r.text for r in table(spark, data, "benchmark").collect()]
    leaked = {i for i in kept if any(x in texts[i] for x in items)}
    assert {r.doc_id for r in seen["decontamination"]} == kept - leaked
    assert {r.doc_id for r in seen["secret_scan"]} == kept - leaked
    assert not any('token = "' in r.text and "[SECRET]" not in r.text for r in seen["secret_scan"])
    codec = bpe.Codec(bpe.Vocabulary(bpe.read_vocabulary(vocabulary_path())))
    masked = {r.doc_id: r.text for r in seen["secret_scan"]}
    for r in seen["encoding"]:
        assert r.token_ids == codec.encode(masked[r.doc_id]) and r.exact and r.n_tokens == len(r.token_ids)
    assert len(seen["encoding"]) == len(masked)


def test_run_is_the_stages(spark, data):
    rows = corpus_pipeline.run(spark, data)
    assert rows.columns == ["doc_id", "lang", "source", "n_tokens", "token_ids", "exact"] and rows.count() > 0
