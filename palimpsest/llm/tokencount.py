"""Token counts by prefix dynamic programming over a merge vocabulary with word ends.

For every prefix of a word the table holds the exact number of tokens the
merges make of it, and its last token.  A token that ends at a byte extends the
prefix it begins at if the merges keep it apart from that prefix's last token;
exactly one does.  From these counts, truncation and budget questions are
answered for any prefix of a text without encoding anything again.  The words of
an Arrow batch go through the table together in numpy.

Defined cases: a null or empty text has 0 tokens; repeated rows are counted each
by itself; a null doc_id stays null; texts of any length are counted whole;
strings of special tokens inside a text count as one token, as the library's
default has it.  Texts with characters that Python's Unicode tables treat in another way
than the library's are normalised and cut by the library; the counting stays the same.
"""

from __future__ import annotations

import json
import re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .pieces import groups

END = "</w>"
NEVER = np.int64(1) << 40
BLOCK, CACHE = 8000, 600_000
#: Bytes from which a word is counted by itself, and starts of it that are looked up together.
LONG, LONG_BLOCK = 512, 1 << 16
#: Stands before a piece that the library cut itself; no other stretch begins with white space.
PIECE = "\n"
#: Characters that are compared with the library when a vocabulary is loaded, as ranges; the library reads texts with others.
SCANNED = [(0x1, 0x3100), (0x3400, 0xA000), (0xAC00, 0xD7A4), (0xFF00, 0xFFF0), (0x1F300, 0x1FB00)]


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class PairTable:
    """Numbers of pairs by hash; those whose place is taken stand in sorted arrays beside it."""

    def __init__(self, pairs: dict[int, int]):
        self.keys = np.array(sorted(pairs), np.int64)
        self.value = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.slot = np.full(1 << 20, -1, np.int64)
        order = np.arange(len(self.keys))[::-1]
        self.slot[self._hash(self.keys[order])] = order
        self.lost = np.setdiff1d(order, self.slot)
        self.spare = self.keys[self.lost]

    def _hash(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def look(self, key: np.ndarray) -> np.ndarray:
        at = self.slot[self._hash(key)]
        hit = self.keys[at] == key
        again = np.flatnonzero(~hit & (at >= 0))
        if len(again) and len(self.spare):
            spot = np.minimum(np.searchsorted(self.spare, key[again]), len(self.spare) - 1)
            good = self.spare[spot] == key[again]
            at[again[good]], hit[again[good]] = self.lost[spot[good]], True
        return np.where(hit, self.value[at], NEVER)


class Counter:
    """Counts of a tokenizers file whose model is BPE with a word end."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.many = max(vocab.values()) + 1
        to_byte = byte_of_char()
        self.birth = np.full(self.many, -1, np.int64)
        self.left, self.right = np.zeros(self.many, np.int64), np.zeros(self.many, np.int64)
        pairs = {}
        for rank, (a, b) in enumerate(merges):
            made = vocab[a + b]
            self.birth[made], self.left[made], self.right[made] = rank, vocab[a], vocab[b]
            pairs[vocab[a] * self.many + vocab[b]] = rank
        self.pairs = PairTable(pairs)
        made = {vocab[a + b] for a, b in merges}
        next_node: list[dict[int, int]] = [{}]
        whole, closed = [-1], [-1]
        for text, token in vocab.items():
            end = text.endswith(END) and len(text) > len(END)
            raw = text[: -len(END)] if end else text
            if token not in made and len(raw) > 1:
                continue  # a symbol that no merge makes
            node = 0
            for char in raw:
                if to_byte[char] not in next_node[node]:
                    next_node[node][to_byte[char]] = len(next_node)
                    next_node.append({})
                    whole.append(-1)
                    closed.append(-1)
                node = next_node[node][to_byte[char]]
            (closed if end else whole)[node] = token
        self.next = np.full((len(next_node), 256), -1, np.int32)
        for node, steps in enumerate(next_node):
            for byte, to in steps.items():
                self.next[node, byte] = to
        self.whole, self.closed = np.array(whole), np.array(closed)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.piece = regex.compile(pattern)
        self.normalizer = tokenizers.Tokenizer.from_file(path).normalizer
        self.splitter = tokenizers.pre_tokenizers.Split(tokenizers.Regex(pattern), behavior="removed", invert=True)
        self.unsafe = self._unsafe()
        self.kept: dict[str, int] = {}
        # for long words, one at a time
        self.merge, self.made_by = pairs, (self.birth.tolist(), self.left.tolist(), self.right.tolist())
        self.known_apart: dict[int, bool] = {}

    def _unsafe(self) -> re.Pattern:
        """Characters outside of SCANNED, or that Python and the library lower-case, compose or class differently: they follow Unicode of different years."""
        every = [chr(c) for low, high in SCANNED for c in range(low, high) if chr(c) != "|"]
        ours = regex.sub(r"\s+", " ", self.plain("|".join(every))).split("|")
        theirs = self.normalizer.normalize_str("|".join(every)).split("|")
        if len(ours) == len(theirs) == len(every):
            safe = [c for c, a, b in zip(every, ours, theirs, strict=True) if a == b]
        else:
            safe = [c for c in every if regex.sub(r"\s+", " ", self.plain(c)) == self.normalizer.normalize_str(c)]
        for other in "x!":  # a letter, and neither letter nor number
            line = [other + self.plain(c) for c in safe]
            found = [p for p, _ in self.splitter.pre_tokenize_str(" ".join(line))]
            if found != self.piece.findall(" ".join(line)):
                safe = [c for c, w in zip(safe, line, strict=True) if [p for p, _ in self.splitter.pre_tokenize_str(w)] == self.piece.findall(w)]
        code, ranges = sorted(map(ord, [*safe, "|"])), []
        for c in code:
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
        return re.compile("[^" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in ranges) + "]")

    def read(self, segment: str) -> tuple[str, list[tuple[str, int]]]:
        """A text without special tokens as the vocabulary reads it, and its pieces with their places."""
        if segment.isascii() or not self.unsafe.search(segment):
            segment = self.plain(segment)
            return segment, [(m[0], m.start()) for m in self.piece.finditer(segment)]
        segment = self.normalizer.normalize_str(segment)
        return segment, [(p, at) for p, (at, _) in self.splitter.pre_tokenize_str(segment)]

    def apart(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether the merges leave token ``one`` before token ``two`` as they are.

        Undo the later of both tokens' merges step by step; ``one`` and ``two``
        join if their facing parts merge before either part was taken up.
        """
        ok, index = np.ones(len(one), bool), np.arange(len(one))
        gone_one = gone_two = np.full(len(one), NEVER - 1)
        while len(index):
            merge = self.pairs.look(one * self.many + two)
            joins = (merge < gone_one) & (merge <= gone_two)
            ok[index[joins]] = False
            born_one, born_two = self.birth[one], self.birth[two]
            more = ~joins & ((born_one >= 0) | (born_two >= 0))
            first = born_one > born_two
            gone_one, gone_two = np.where(first, born_one, gone_one)[more], np.where(first, gone_two, born_two)[more]
            one, two = np.where(first, self.right[one], one)[more], np.where(first, two, self.left[two])[more]
            index = index[more]
        return ok

    def _apart(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """``apart``, for every different pair once; a word's beginning (-1) is always apart."""
        key, back = np.unique(one * self.many + two, return_inverse=True)
        ok = np.ones(len(key), bool)
        real = key >= 0
        ok[real] = self.apart(key[real] // self.many, key[real] % self.many)
        return ok[back]

    def table(self, words: np.ndarray, every: bool = False) -> np.ndarray:
        """Tokens of words of one length (rows of bytes): of the whole word, or with ``every`` of each prefix."""
        n, size = words.shape
        opened, last = np.zeros((n, size + 1), np.int64), np.full((n, size + 1), -1, np.int64)
        known = np.zeros((n, size + 1), bool)
        out = np.zeros((n, size + 1), np.int64)
        for start in range(size):
            index, node = np.arange(n), np.zeros(n, np.int64)
            for end in range(start + 1, size + 1):
                node = self.next[node, words[index, end - 1]]
                index, node = index[node >= 0], node[node >= 0]
                if not len(index):
                    break
                for of, whole in ((self.whole, True), (self.closed, False)):
                    if whole and end == size or not whole and end < size and not every:
                        continue
                    token = of[node]
                    able = (token >= 0) & ~(known if whole else out > 0)[index, end]
                    if not able.any():
                        continue
                    at, token = index[able], token[able]
                    good = self._apart(np.where(last[at, start] < 0, -self.many, last[at, start]), token) if start else slice(None)
                    at, token = at[good], token[good]
                    if whole:
                        opened[at, end], last[at, end], known[at, end] = opened[at, start] + 1, token, True
                    else:
                        out[at, end] = opened[at, start] + 1
        return out if every else out[:, -1]

    def _one_apart(self, one: int, two: int) -> bool:
        """``apart`` of one pair."""
        birth, left, right = self.made_by
        gone_one = gone_two = int(NEVER) - 1
        while True:
            merge = self.merge.get(one * self.many + two, int(NEVER))
            if merge < gone_one and merge <= gone_two:
                return False
            if birth[one] < 0 and birth[two] < 0:
                return True
            if birth[one] > birth[two]:
                gone_one, one = birth[one], right[one]
            else:
                gone_two, two = birth[two], left[two]

    def long_table(self, word: bytes, every: bool = False) -> np.ndarray:
        """``table`` of one long word: tokens from all starts of a block are found together, then taken up start by start."""
        data, size = np.frombuffer(word, np.uint8), len(word)
        opened, last, out = [-1] * (size + 1), [-1] * (size + 1), [0] * (size + 1)
        opened[0], known = 0, self.known_apart
        for low in range(0, size, LONG_BLOCK):
            start, node, found = np.arange(low, min(size, low + LONG_BLOCK)), np.zeros(min(size, low + LONG_BLOCK) - low, np.int64), []
            for length in range(1, size - low + 1):
                node = self.next[node, data[start + length - 1]]
                start, node = start[node >= 0], node[node >= 0]
                if not len(start):
                    break
                for whole, of in ((True, self.whole), (False, self.closed)):
                    token = of[node]
                    end = start + length
                    some = (token >= 0) & ((end < size) if whole else ((end == size) | every))
                    found.append(np.stack([start[some], end[some], token[some], np.full(some.sum(), whole)]))
                start, node = start[start + length < size], node[start + length < size]
            found = np.concatenate(found, axis=1)
            for s, e, token, whole in found[:, np.argsort(found[0], kind="stable")].T.tolist():
                if (opened[e] >= 0) if whole else out[e]:
                    continue
                before = last[s]
                if before >= 0:
                    key = before * self.many + token
                    good = known.get(key)
                    if good is None:
                        if len(known) >= CACHE:
                            known.clear()
                        good = known[key] = self._one_apart(before, token)
                    if not good:
                        continue
                if whole:
                    opened[e], last[e] = opened[s] + 1, token
                else:
                    out[e] = opened[s] + 1
        return np.array(out, np.int64)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word."""
        out, size = np.zeros(len(words), np.int64), np.array([*map(len, words)], np.int64)
        order = np.argsort(size, kind="stable")
        size = size[order]
        for length in np.unique(size).tolist():
            low, high = np.searchsorted(size, [length, length + 1])
            if length > LONG:
                out[order[low:high]] = [self.long_table(words[i])[-1] for i in order[low:high]]
                continue
            block = max(1, min(BLOCK, (1 << 22) // max(1, length)))
            for at in range(low, high, block):
                part = order[at : min(high, at + block)]
                if length:
                    out[part] = self.table(np.frombuffer(b"".join([words[i] for i in part]), np.uint8).reshape(len(part), length))
        return out

    def plain(self, text: str) -> str:
        """NFC, lower case character by character."""
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()

    def _parts(self, text: str) -> list[str]:
        """Stretches between white space; special tokens' strings stand alone."""
        if self.special_cut and "<|" in text:
            cut = self.special_cut.split(text)
        else:
            cut = [text]
        out = []
        for k, part in enumerate(cut):
            if k % 2:
                out.append(part)
            elif part and not part.isascii() and self.unsafe.search(part):
                out += [PIECE + p for p, _ in self.read(part)[1]]
            elif part:
                part = self.plain(part)
                # these count as spaces for str.split only
                out += part.split() if not SEPARATORS.search(part) else regex.split(r"\s+", part)
        return out

    def batch(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        kept, parts = self.kept, [self._parts(t) for t in texts]
        wanted = set(chain.from_iterable(parts))
        new = list(wanted.difference(kept))
        if len(kept) + len(new) > CACHE:
            self.kept = kept = {p: kept[p] for p in wanted if p in kept}
        if new:
            special = set(self.special)
            pieces = [[] if p in special else [p[1:]] if p[0] == PIECE else self.piece.findall(p) for p in new]
            one = list(set(chain.from_iterable(pieces)))
            count = dict(zip(one, self.counts([p.encode() for p in one]).tolist(), strict=True)).__getitem__
            kept.update((p, 1 if p in special else sum(map(count, row))) for p, row in zip(new, pieces, strict=True))
        get = kept.__getitem__
        return [sum(map(get, row)) for row in parts]

    def prefixes(self, text: str) -> tuple[str, np.ndarray]:
        """The text as the vocabulary reads it, and the tokens of each of its prefixes (one more than characters)."""
        segments = self.special_cut.split(text) if self.special_cut else [text]
        read, out, before = [], [0], 0
        for k, segment in enumerate(segments):
            if k % 2:  # a special token is one token once its string is whole; cut short, it is text
                for end in range(1, len(segment)):
                    out.append(before + self.batch([segment[:end]])[0])
                before += 1
                out.append(before)
                read.append(segment)
                continue
            segment, pieces = self.read(segment)
            read.append(segment)
            place = 0
            for piece, start in pieces:
                out += [before] * (start - place)
                place = start + len(piece)
                if piece[0] == "'" and len(piece) > 1 and piece[1].isalpha():  # cut short it is another split
                    cut = [int(sum(self.counts([p.encode() for p, _ in self.read(piece[:e])[1]]))) for e in range(1, len(piece) + 1)]
                else:
                    raw = piece.encode()
                    row = self.long_table(raw, every=True) if len(raw) > LONG else self.table(np.frombuffer(raw, np.uint8)[None, :], every=True)[0]
                    cut = row[np.cumsum([len(c.encode()) for c in piece])].tolist()
                out += [before + c for c in cut]
                before += cut[-1]
            out += [before] * (len(segment) - place)
        return "".join(read), np.array(out)

    def truncate(self, text: str, budget: int) -> str:
        """The longest prefix (of the text as read) of at most ``budget`` tokens."""
        read, count = self.prefixes(text)
        return read[: int(np.flatnonzero(count <= budget)[-1])]


SEPARATORS = re.compile("[\x1c-\x1f]")


def load(path: str) -> Counter:
    return tk.held(__name__, path, Counter)


def count(docs: DataFrame, path: str, limit: int = 2048, with_prefixes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text; ``with_prefixes`` adds the tokens of each prefix."""
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean" + ", prefix_tokens array<long>" * with_prefixes

    def run(batches):
        counter = load(path)
        for batch in batches:
            ids, row = batch.column("doc_id"), 0
            for texts in groups([t or "" for t in batch.column("text").to_pylist()]):
                tokens = counter.batch(texts)
                cols = [ids.slice(row, len(texts)), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens])]
                if with_prefixes:
                    cols.append(pa.array([counter.prefixes(t)[1].tolist() for t in texts], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in schema.split(", ")])
                row += len(texts)

    tk.tune(docs.sparkSession, 200)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tk.tidy(run), schema)
