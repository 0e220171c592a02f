import random
import tracemalloc

import pytest
from tokenizers import Tokenizer

from pageloom.llm import bpe
from pageloom.llm.queries import QUERIES, vocabulary_path


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.read_vocabulary(vocabulary_path()))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path())


TEXTS = (
    "", " ", "\n", "a", " a", "a ", "a  b", "a\n b", "a \nb", "a\n\nb c", "don't we'll 'sx", "x 's it's", "\r\n a\tb",
    "Ünïcödé déjà vu", "数字 123四五", "a b   c", "\x00\x1f\x85", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>",
    "<|endoftext", "🙂🙂 👩‍👩‍👧", "ab" * 3000, "x" * 5000 + " y" * 300, "   trailing   ", "1234567890 12.5%",
)


def test_same_ids_as_the_library(vocabulary, library):
    lexicon = bpe.Lexicon(bpe.compile_lexicon({w: vocabulary.merge(w) for w in (b" a", b"a", b" vu", b"xx")}))
    for codec in (bpe.Codec(vocabulary), bpe.Codec(vocabulary, lexicon)):
        for text in TEXTS:
            ids = library.encode(text, add_special_tokens=False).ids
            assert codec.encode(text) == ids, text
            assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_every_code_point_is_split_alike(vocabulary, library):
    codec = bpe.Codec(vocabulary)
    texts = [f"a {chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}" for c in [*range(0x3100), *range(0xE000, 0x20000, 37)]]
    assert [codec.encode(t) for t in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_scan_and_heap_merge_alike(vocabulary):
    for word in (b"internationalisation", b"aaaaaaaaaaaaaaaaaaaaaaaaa", "Größenordnung".encode(), bytes(range(256))):
        ids = [vocabulary.byte_ids[b] for b in word]
        assert vocabulary._scan(list(ids)) == vocabulary._heap(list(ids))


def test_words_merged_together(vocabulary):
    rng = random.Random(4)
    letters = "aeioutnrslthing é" + "\U0001f642\n."
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))).encode() for _ in range(3000)]
    words += [b"", b"a", b"aaaaaaaaaaaaaaaaaaaaaaaa", bytes(range(48)), bytes(range(256)), b"x" * 300, b"\x00\x00", b"\x00a\x00"]
    assert vocabulary.merge_all(words) == [bpe.packed(vocabulary.merge(w)) for w in words]
    assert vocabulary.merge_all([]) == [] and vocabulary.merge_all([b""]) == [b""]


def test_texts_encoded_together(vocabulary, library, prose, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 40)
    lexicon = bpe.Lexicon(bpe.compile_lexicon({w: vocabulary.merge(w) for w in (b" ba", b" kera")}))
    codec = bpe.Codec(vocabulary, lexicon)
    texts = [prose(i) for i in range(5)] + list(TEXTS)
    for _ in range(2):
        coded = [bpe.packed(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
        assert codec.encode_all(texts) == coded
        columns = bpe._columns(codec, texts)
        assert [bpe.packed(x) for x in columns.field("token_ids").to_pylist()] == coded
        assert columns.field("decoded").to_pylist() == texts and bpe._columns(codec, []).to_pylist() == []


def test_memo_is_bounded(monkeypatch, vocabulary):
    monkeypatch.setattr(bpe, "MEMO", 10)
    codec = bpe.Codec(vocabulary)
    text = " ".join(f"w{i}x" for i in range(200))
    assert codec.decode(codec.encode(text)) == text
    assert len(codec.stretches) + len(codec.stretches.older) <= 20


def test_transducer_is_minimal_and_exact():
    words = {f"{a}{b}ing".encode(): (i, i + 1) for i, (a, b) in enumerate((a, b) for a in "abcdef" for b in "xyz")}
    lexicon = bpe.Lexicon(bpe.compile_lexicon(words))
    assert all(lexicon.get(w) == ids for w, ids in words.items())
    assert [lexicon.get(w) for w in (b"", b"a", b"axin", b"axings", b"zzz")] == [None] * 5
    assert len(lexicon.final) == 6  # all words share one suffix chain
    empty = bpe.Lexicon(bpe.compile_lexicon({}))
    assert empty.get(b"a") is None
    assert bpe.Lexicon(bpe.compile_lexicon({b"": (7,)})).get(b"") == (7,)


def test_edges_of_a_table(frame, edges):
    rows = bpe.encode_documents(frame(edges), vocabulary_path(), lexicon_size=50).collect()
    assert len(rows) == len(edges)
    for row in rows:
        assert row.decoded == (row.text or "")
    assert [r.token_ids for r in rows if r.doc_id in (1, 2)] == [[], []]
    assert bpe.encode_documents(frame([]), vocabulary_path()).count() == 0


def test_unsupported_vocabularies_are_refused():
    with pytest.raises(ValueError):
        bpe.Vocabulary('{"model": {"type": "WordPiece", "vocab": {}, "merges": []}}')


def test_query_against_the_library(spark, data, library):
    import hashlib

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for row in QUERIES["op8_bpe"](spark, data).collect():
        ids = library.encode(texts[row.doc_id], add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def test_names_of_columns_are_free(frame):
    """``token_ids`` and ``decoded`` are replaced, all others stay."""
    extra = "row int, coded int, __coded int, token_ids int, decoded int"
    coded = bpe.encode_documents(frame([(1, "a b"), (None, None)], extra), vocabulary_path())
    assert sorted(coded.columns) == sorted(frame([], extra).columns)
    assert {r.doc_id: r.decoded for r in coded.collect()} == {1: "a b", None: ""}


def test_few_texts_and_ids_at_once(vocabulary, prose, monkeypatch):
    ids = bpe.np.resize(bpe.np.array(vocabulary.merge(b" international"), bpe.np.int32), 1 << 20)
    want, _ = vocabulary.decode_all(ids)
    tracemalloc.start()
    vocabulary.decode_all(ids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * len(want) + (24 << 20)
    codec, sizes = bpe.Codec(vocabulary), []
    encode_all = codec.encode_all
    monkeypatch.setattr(codec, "encode_all", lambda texts: sizes.append(len(texts)) or encode_all(texts))
    texts = [prose(i, 5) + f" {i}" for i in range(1003)]
    out = bpe._columns(codec, texts)
    assert max(sizes) <= 250 and sum(sizes) == len(texts)
    assert out.field("decoded").to_pylist() == texts and len(out.field("token_ids")) == len(texts)
    assert len(bpe._columns(codec, [])) == 0
