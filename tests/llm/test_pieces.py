import hashlib
import random

import public_tokenizers
import pytest

from palimpsest.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a", "a  b   c", "\n", "a\nb", "\n\n x", "▁", "a▁b", "日本語テキスト", "</s> <s> <0x41>", "\x00a", "\t", "é😀", "a" * 1000, "ab " * 3, "   ", "x\n ", "�", "\r\n", "aa" * 300 + "日本", "１２３"]


def texts():
    rnd = random.Random(1)
    parts = ["a", "b", " ", "the", "▁", "\n", "日", "é", "in", "  ", "er", "0", "="]
    return ODD + ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 30))) for _ in range(400)]


def test_ids_and_decoding():
    model = pieces.load(PATH)
    for text in texts():
        ids = model.library.encode(text, add_eos=True)
        assert model.encode(text) == ids
        assert model.decode(ids) == model.library.decode(ids)


def test_all_planes():
    """Random code points of all planes: ids and decoded texts of a row are the library's."""
    rnd, model = random.Random(9), pieces.load(PATH)
    draw = lambda: chr(rnd.choice([rnd.randrange(0x20, 0x7F), 0x20, 0x2581, rnd.randrange(0xD800), rnd.randrange(0xE000, 0x110000)]))
    many = ["".join(draw() for _ in range(rnd.randint(1, 40))) for _ in range(10_000)] + texts()
    want = model.library.encode(many, num_threads=1)
    assert [[int(i) for i in ids.split()] for ids, _ in model.batch(many)] == want
    assert [back for _, back in model.batch(many)] == model.library.decode(want)


def test_heap_and_rounds_agree():
    model = pieces.load(PATH)
    words = ["▁" + w for w in ("international", "characteristics", "zzzz", "éééé日本")]
    heap = [model._heap([s if (s := int(model.char[ord(c)])) >= 0 else -2 - ord(c) for c in w]) for w in words]
    assert [h for h in heap][:3] == model.stretches(words)[:3]


def test_difference_raises(monkeypatch):
    model = pieces.Pieces(PATH)
    monkeypatch.setattr(model, "stretches", lambda t: [[1] for _ in t])
    with pytest.raises(ValueError):
        model.batch(["hello"])


def test_digest(spark, odd, empty):
    model = pieces.load(PATH)
    rows = pieces.digest(odd, PATH, with_ids=True, with_text=True).collect()
    assert len(rows) == odd.count()
    given = sorted((r["text"] or "" for r in odd.collect()))
    expect = sorted((hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.library.decode(ids).encode()).hexdigest(), len(ids)) for ids in (model.library.encode(t, add_eos=True) for t in given))
    assert sorted((r["ids_sha256"], r["decoded_sha256"], r["n_tokens"]) for r in rows) == expect
    assert all(r["ids"] == model.library.encode(r["decoded"], add_eos=True) for r in rows)
    assert pieces.digest(empty, PATH).count() == 0


def test_kept_stretches_turn_over(monkeypatch):
    """The table of stretches may be full at any time; ids stay the library's."""
    model = pieces.Pieces(PATH)
    monkeypatch.setattr(pieces, "CACHE", 5)
    for text in ["a b c d", "c d e f g h", "a b a b", "", "x y\nz  w", "a c e x h"] * 2:
        assert model.encode(text) == model.library.encode(text, add_eos=True)
