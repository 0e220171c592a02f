import hashlib

import numpy as np

from pageloom.llm import winnowing as W


def brute(text, gram=W.GRAM, window=W.WINDOW):
    """Every window that holds a run of the padded text, each looked through alone."""
    if not text:
        return [], []
    over = gram // 2
    codes = np.array([-1] * over + [ord(c) for c in text] + [-1] * over, np.int64)
    hashes = [int(W.gram_hashes(codes[i : i + gram], gram)[0]) for i in range(len(codes) - gram + 1)]
    kept = set()
    for i in range(1 - window, len(hashes)):
        held = range(max(0, i), min(len(hashes), i + window))
        least = min(hashes[j] for j in held)
        kept.add(max(j for j in held if hashes[j] == least))
    return [hashes[p] for p in sorted(kept)], [p - over for p in sorted(kept)]


def test_against_brute_force(monkeypatch, prose):
    texts = ["", "a", "abc", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", prose(1, 30), prose(2, 400), "é🙂" * 90]
    for chunk in (W.CHUNK, 17):
        monkeypatch.setattr(W, "CHUNK", chunk)
        for text in texts:
            hashes, positions = W.winnow(text)
            assert (hashes.tolist(), positions.tolist()) == brute(text)


def test_gram_hash_is_of_the_gram_alone():
    for gram in (1, 2, 3, 5, 8, 12, 13):
        codes = np.frombuffer(("xy" + "m" * 20 + "xy" + "m" * 20).encode("utf-32-le"), np.uint32)
        hashes = W.gram_hashes(codes, gram)
        assert len(hashes) == len(codes) - gram + 1 and hashes[0] == hashes[22]


def test_short_near_copies_are_alike(prose):
    """A few characters more leave a likeness, at every length."""
    for length in [*range(8, 70), 100, 191, 192, 193, 250]:
        for seed in range(10):
            text = prose(seed, 80)[:length]
            longer = W.winnow(text + "xyz!")[0]
            assert W.likeness(W.winnow(text)[0], longer) > 0
    likenesses = [W.likeness(W.winnow(prose(k, 40)[:40])[0], W.winnow(prose(k, 40)[:40] + "abcd")[0]) for k in range(50)]
    strange = [W.likeness(W.winnow(prose(k, 40)[:40])[0], W.winnow(prose(k + 99, 40)[:40])[0]) for k in range(50)]
    assert np.mean(likenesses) > 0.4 and np.mean(strange) < 0.1


def test_string_holds_what_is_compared(prose):
    hashes, positions = W.winnow(prose(3, 50))
    digits, gaps = W.to_string(hashes, positions).split(":")
    assert [int(digits[k : k + 16], 16) for k in range(0, len(digits), 16)] == hashes.tolist()
    assert np.cumsum([int(g) for g in gaps.split(",")]).tolist() == positions.tolist()


def test_one_range_to_a_task(frame, prose):
    rows = frame([(i, prose(i, 8)) for i in range(400)])
    plan = W.compare_edited(rows, 40)
    sizes = plan.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert max(sizes) <= 3 * 400 / 40


def test_shared_passage_is_found(prose):
    """Any passage as long as a run and a window gives a common hash, wherever it stands."""
    passage = prose(9, 40)[: W.GRAM + W.WINDOW - 1]
    for seed in range(20):
        a = prose(100 + seed, 60).upper() + passage + prose(200 + seed, 90).upper()
        b = "0" * seed + passage + prose(300 + seed, 70).title()
        assert set(W.winnow(a)[0].tolist()) & set(W.winnow(b)[0].tolist())


def expected(rows):
    known = sorted(((i, t or "") for i, t in rows if i is not None), key=lambda x: (-x[0], x[1]))
    order = known + sorted(((i, t or "") for i, t in rows if i is None), key=lambda x: x[1])
    out = []
    for k, (i, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        mine, other, changed = W.winnow(text), W.winnow(following), W.winnow(edited)
        out.append(
            (i, len(text), hashlib.sha256(edited.encode()).hexdigest(), W.to_string(*mine), W.to_string(*changed),
             W.likeness(mine[0], changed[0]), W.likeness(mine[0], other[0]))
        )
    return sorted(out, key=str)


def test_edited_texts(frame, edges, prose):
    for rows in (edges, [(i * i, prose(i, 5 + i)) for i in range(60)], [(7, "alone in the table")], []):
        for parts in (1, 5, 200):
            got = W.compare_edited(frame(rows), parts).collect()
            assert sorted((tuple(r) for r in got), key=str) == expected(rows)


def test_fingerprints_of_a_table(frame, edges):
    rows = W.fingerprint_documents(frame(edges)).collect()
    assert [len(r.hashes) for r in rows if r.doc_id in (1, 2)] == [0, 0]
    assert all(len(r.hashes) == len(r.positions) for r in rows) and len(rows) == len(edges)
