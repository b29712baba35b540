import hashlib
import random
import tracemalloc

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm import bpe
from millrace.llm.bpe import TreeBpe, encode, encode_digests, halves

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def pair():
    return TreeBpe(PATH), Tokenizer.from_file(PATH)


EDGE = ["", " ", "\u1df9\u0327", "\u0928\u093c\u0941 \u05d1\u05bc\u05b8", "a\x1cb\x1f c\x0bd\x7f", "'S'll x'D_9__", "".join(map(chr, range(128))), "".join(map(chr, range(1, 600))), "Hello World's", "ΣΑΣ İx", "a" * 5000, "ab" * 3000 + "c", "<|endoftext|>x<|startoftext|>", "é é", "՘Ɤz", "12345 3.14", "don't we'll", "中文" * 500, "!!!***\n\n###", "\x1c\x1d a\x85b", "<|endoftext", "\U0001f600" * 200]


def test_edge_texts_equal_the_library(pair):
    ours, library = pair
    for text in EDGE:
        want = library.encode(text, add_special_tokens=False).ids
        assert ours.encode(text) == want, text[:40]
        assert ours.decode(want) == library.decode(want, skip_special_tokens=False)


def test_random_unsplit_texts_equal_the_library(pair):
    ours, library = pair
    rng = random.Random(7)
    for alphabet in ("ab", "aeinrst", "abcdefghijklmnopqrstuvwxyz", "éèñü"):
        for n in (95, 96, 97, 193, 1000, 7000):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            assert ours.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_digests(spark, pair):
    rows = [(i, t, "x") for i, t in enumerate(EDGE)] + [(99, None, "x"), (99, None, "x"), (None, "a b", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string")
    _, library = pair
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, encode_digests(docs, PATH).collect()), key=str) == sorted(want, key=str)
    assert encode_digests(docs.limit(0), PATH).count() == 0
    assert {len(r.ids) == r.n_tokens for r in encode(docs, PATH).collect()} == {True}


def by_tree(coder, text, piece):
    """Ids of a text without special tokens, through pieces of at most so many code points."""
    old, bpe.PIECE = bpe.PIECE, piece
    try:
        cut = halves(coder.normal(text))
    finally:
        bpe.PIECE = old
    parts = [coder.part(t, coder.encode_piece(t, k + 1 < len(cut)), k + 1 < len(cut)) for k, t in enumerate(cut)]
    while len(parts) > 1:
        parts = [coder.join_parts(*parts[k : k + 2]) for k in range(0, len(parts), 2)]
    return parts[0].ids.tolist()


@pytest.mark.parametrize("piece", (1, 2, 3, 5, 17, 100))
def test_halves_join_wherever_they_are_cut(pair, piece):
    ours, library = pair
    rng = random.Random(piece)
    texts = [t for t in EDGE if "<|" not in t and len(t) < 700]
    for alphabet in ("ab '", "a1!' \n", "I'll'VE're d's x", "éèñü ' mß", "aeiou", "!?-' 12"):
        texts += ["".join(rng.choice(alphabet) for _ in range(n)) for n in (2, 7, 30, 120, 400)]
    for text in texts:
        assert by_tree(ours, text, piece) == library.encode(text, add_special_tokens=False).ids, (piece, text)


def test_long_texts_go_through_the_tree(spark, pair, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 300)
    _, library = pair
    rows = [(k, t) for k, t in enumerate([*EDGE, "a" * 20_000, "word and 'll " * 3000, ("<|endoftext|>" + "é!" * 500) * 3, " " * 2000])] + [(7, "b c" * 900), (7, "b c" * 900), (None, "x'" * 900)]
    got = sorted(((r.doc_id, r.ids, r.decoded) for r in encode(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()), key=str)
    want = [(i, library.encode(t, add_special_tokens=False).ids) for i, t in rows]
    assert got == sorted(((i, ids, library.decode(ids, skip_special_tokens=False)) for i, ids in want), key=str)


def test_documents_of_the_table_are_halved(spark, pair):
    """Production parameters send documents of the table through the tree, and the ids are the library's."""
    ours, library = pair
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    long = docs.where(f"length(text) > {bpe.PIECE}").collect()
    assert len(long) > 5
    before = ours.joins
    for r in long:
        assert by_tree(ours, r.text, bpe.PIECE) == library.encode(r.text, add_special_tokens=False).ids
    assert ours.joins - before >= len(long)
    got = {r.doc_id: r.ids for r in encode(docs, PATH).collect()}
    assert got == {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids for r in docs.collect()}


def test_words_met_once_are_remembered_packed(pair):
    ours, library = TreeBpe(PATH), pair[1]
    rng = random.Random(3)
    words = ["".join(rng.choice("aeinrstlo") for _ in range(11)) for _ in range(20_000)]
    tracemalloc.start()
    first = [ours.encode(w) == library.encode(w, add_special_tokens=False).ids for w in words[:200]]
    before = tracemalloc.get_traced_memory()[0]
    for w in words[200:]:
        ours.encode(w)
    held = tracemalloc.get_traced_memory()[0] - before
    tracemalloc.stop()
    assert held < 300 * (len(words) - 200)
    assert all(first) and not ours.words
    again = [(ours.encode_parts(w), library.encode(w, add_special_tokens=False).ids) for w in words[:500]]
    assert all(list(ids) == want and shown == " ".join(map(str, want)) and decoded == library.decode(want, skip_special_tokens=False) for [(ids, shown, decoded)], want in again)
    assert len(ours.words) == 500 and len(ours.once) == len(set(words)) - 500


def test_turns_of_remembered_words_lose_no_result(pair, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    ours, library = TreeBpe(PATH), pair[1]
    rng = random.Random(5)
    for _ in range(300):
        text = " ".join(rng.choice(["one", "two", "three", "fourteen", "éèñ", "unwordly", "x9"]) for _ in range(6))
        assert ours.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert len(ours.words) + len(ours.once) <= 3
