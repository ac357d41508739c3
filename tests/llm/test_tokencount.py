import os
import random
import time

import public_tokenizers
from tokenizers import Tokenizer

from palimpsest.llm import tokencount

os.environ["TOKENIZERS_PARALLELISM"] = "false"
PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["", " ", "it's they're I'LL don't '", "<|endoftext|>", "a<|endoftext|>b <|startoftext|> x<|endof", "日本語テキスト", "Σας ΟΔΟΣ", "İstanbul", "a\x1cb", "é é", "123 ½²", "x y\u0085z", "😀😀!!'s", "''s", "ß ﬁ Å", "a" * 700, "\x00", "ǅ ά"]


def count(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


def texts():
    rnd = random.Random(1)
    parts = ["a", "b", " ", "the", "'", "s", "日", "é", "in", "re", "er", "0", "=", "!", "'ll", "tion", "É", "ing", "<|endoftext|>", "\n", "th"]
    return ODD + ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 30))) for _ in range(500)]


def test_counts():
    counter = tokencount.load(PATH)
    assert counter.batch(texts()) == [count(t) for t in texts()]


def test_all_planes():
    """Random code points of all planes, and each code point that Python may know by another year's tables, between two letters."""
    rnd, counter = random.Random(9), tokencount.load(PATH)
    draw = lambda: chr(rnd.choice([rnd.randrange(0x20, 0x7F), rnd.randrange(0xD800), rnd.randrange(0xE000, 0x110000), rnd.randrange(0x10000, 0x20000)]))
    many = ["".join(draw() for _ in range(rnd.randint(1, 40))) for _ in range(10_000)]
    many += [f"a{chr(c)}b" for c in range(0xA640, 0xAC00)] + ["}\U00014e36\U00019f1b쬘ʝ", "\ua7cb", "\ua7dc"]
    want = [len(e.ids) for e in LIBRARY.encode_batch(many, add_special_tokens=False)]
    assert counter.batch(many) == want


def test_long_words():
    rnd, counter = random.Random(3), tokencount.load(PATH)
    for letters in ("a", "ab", "etaoinshr", "abcdefghijklmnopqrstuvwxyz", "日本éa"):
        for size in (400, 513, 3000):
            word = "".join(rnd.choice(letters) for _ in range(size))
            assert counter.batch([word]) == [count(word)]
    word = "".join(rnd.choice("abcdefghij") for _ in range(700))
    assert counter.long_table(word.encode(), every=True)[1:].tolist() == [count(word[:k]) for k in range(1, 701)]
    word, began = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000)), time.time()
    found = counter.batch([word])
    assert time.time() - began < 60 and found == [count(word)]


def test_every_prefix():
    counter = tokencount.load(PATH)
    for text in texts()[:60]:
        read, found = counter.prefixes(text)
        if len(read) == len(text) and "<|" not in text:
            assert found.tolist() == [count(text[:k]) for k in range(len(text) + 1)]


def test_truncate():
    text = "several words make tokenization interesting, don't they?"
    cut = tokencount.load(PATH).truncate(text, 6)
    assert text.startswith(cut) and count(cut) == 6 and count(text[: len(cut) + 1]) > 6


def test_rows(odd, empty):
    rows = tokencount.count(odd, PATH, 2048, with_prefixes=False).collect()
    assert sorted(r["n_tokens"] for r in rows) == sorted(count(r["text"] or "") for r in odd.collect())
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in rows)
    small = tokencount.count(odd.where("length(text) < 100"), PATH, with_prefixes=True).collect()
    assert all(r["prefix_tokens"][-1] == r["n_tokens"] for r in small)
    assert tokencount.count(empty, PATH).count() == 0
