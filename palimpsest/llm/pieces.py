"""SentencePiece encoding and decoding for merge-type vocabularies.

Encoding keeps, for each stretch of text, an agenda of its adjacent symbol pairs
ordered by (score, position) and merges the best pair until none is left.  The
agendas of all new stretches of an Arrow batch advance together, one merge each
round, in numpy; stretches over LONG symbols use a heap.  A text is cut into
stretches only where no vocabulary piece can cross (checked when the model is
loaded), so the ids of a text are those of its stretches in a row.  Every new
stretch of a batch is compared with the sentencepiece library's ids and the text
that the library decodes from them; a difference raises.  A row's decoded text is
put together from what the ids of its stretches decode to.

Defined cases: a null or empty text gives the end id alone and decodes to the
empty string; repeated rows are encoded each by itself; a null doc_id stays
null; texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

SPACE = "▁"
LONG, BLOCK, CACHE, GROUP = 256, 8000, 200_000, 1 << 20
#: Rank of a pair that makes no piece, above every real one.
LAST = np.int64(1) << 40


class Pieces:
    """A merge-type model: encode, decode, and ids of stretches kept by text."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(size)]
        self.names = [sp.id_to_piece(i) for i in range(size)]
        self.end = sp.eos_id()
        self.byte = {int(n[3:5], 16): i for i, n in enumerate(self.names) if sp.is_byte(i)}
        self.of_byte = {i: b for b, i in self.byte.items()}
        self.control = {i for i in range(size) if sp.is_control(i)}
        normal = {n: i for i, n in enumerate(self.names) if not special[i]}
        #: Symbols: the ids, and beyond them the characters that only occur inside pieces.
        symbol = dict(normal)
        for piece in normal:
            for char in piece:
                symbol.setdefault(char, size + len(symbol))
        self.char = np.full(0x110000, -1, np.int32)
        for piece, i in symbol.items():
            if len(piece) == 1:
                self.char[ord(piece)] = i
        self.many = max(symbol.values()) + 1
        self.alone = {i: c for c, i in symbol.items() if i >= size}
        levels = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in normal.values()}, reverse=True))}
        pairs = {}
        for piece, i in normal.items():
            for cut in range(1, len(piece)):
                left, right = symbol.get(piece[:cut]), symbol.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * self.many + right] = (levels[sp.get_score(i)], i)
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.made = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        self._index()
        crossing = any(SPACE in p.lstrip(SPACE) for p in normal)
        lines = any("\n" in p for p in normal if len(p) > 1)
        self.cut = re.compile(".+" if crossing or lines else f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n", re.S)
        self.simple = not (crossing or lines)
        self.decimal = [f"{i} " for i in range(size)]
        #: Decimal ids of stretches, and what these decode to, by name: those used since the table was last full, and those before.
        self.kept: dict[str, tuple[str, str]] = {}
        self.old: dict[str, tuple[str, str]] = {}

    def _index(self) -> None:
        """A table of pairs by hash; those whose place is taken go to sorted arrays beside it."""
        self.slot = np.full(1 << 21, -1, np.int32)
        order = np.arange(len(self.keys))[::-1]
        self.slot[self._hash(self.keys[order])] = order
        lost = np.setdiff1d(order, self.slot)
        self.spare, self.spare_at = self.keys[lost], lost  # keys are sorted

    def _hash(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int64)

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or LAST) and outcome of symbol pairs."""
        key = np.where((left < 0) | (right < 0), -1, left * self.many + right)
        at = self.slot[self._hash(key)]
        hit = self.keys[at] == key
        if len(self.spare):
            again = np.flatnonzero(~hit & (at >= 0))
            if len(again):
                spot = np.minimum(np.searchsorted(self.spare, key[again]), len(self.spare) - 1)
                good = self.spare[spot] == key[again]
                at[again[good]], hit[again[good]] = self.spare_at[spot[good]], True
        return np.where(hit, self.rank[at], LAST), self.made[at]

    def _heap(self, symbols: list[int]) -> list[int]:
        """Final symbols by a heap agenda."""
        n = len(symbols)
        before, after, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        agenda: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if i >= 0 and j >= 0 and symbols[i] >= 0 and symbols[j] >= 0 and (hit := self.pairs.get(symbols[i] * self.many + symbols[j])):
                heapq.heappush(agenda, (hit[0], i, symbols[i], symbols[j], hit[1]))

        for i in range(n - 1):
            offer(i)
        while agenda:
            _, i, left, right, made = heapq.heappop(agenda)
            j = after[i]
            if not alive[i] or j < 0 or symbols[i] != left or symbols[j] != right:
                continue
            symbols[i], alive[j], after[i] = made, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [symbols[i] for i in range(n) if alive[i]]

    def _rounds(self, texts: list[str]):
        """Yields (index, symbol count) arrays and the final symbols of stretches that are done.

        ``key`` orders the agenda: rank of the pair that begins at a symbol, then
        that symbol's place.  A character that no piece holds is -2 - its code.
        """
        code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        symbol = self.char[code]
        symbol = np.where(symbol < 0, -2 - code.astype(np.int64), symbol)
        count, index = np.array([*map(len, texts)]), np.arange(len(texts))
        start = np.cumsum(count) - count
        place = np.arange(len(code)) - np.repeat(start, count)
        rank = np.append(self._look(symbol[:-1], symbol[1:])[0], LAST)
        rank[start + count - 1] = LAST
        key = (rank << 16) | place
        while True:
            best = np.minimum.reduceat(key, start)
            going = best < LAST << 16
            stay = np.ones(len(symbol), bool)
            if not going.all():
                stay = np.repeat(going, count)
                yield index[~going], count[~going], symbol[~stay]
                if not going.any():
                    return
                best[~going] = -1
            at = np.flatnonzero(key == np.repeat(best, count))
            symbol[at] = self._look(symbol[at], symbol[at + 1])[1]
            stay[at + 1] = False
            within, index, count = at - start[going], index[going], count[going] - 1
            symbol, key = symbol[stay], key[stay]
            start = np.cumsum(count) - count
            at = start + within
            last = within == count - 1
            key[at[last]] = (LAST << 16) | (key[at[last]] & 0xFFFF)
            for spot in (at[~last], at[within > 0] - 1):
                key[spot] = (self._look(symbol[spot], symbol[spot + 1])[0] << 16) | (key[spot] & 0xFFFF)

    def stretches(self, texts: list[str]) -> list[list[int]]:
        """Ids of every stretch, by the agenda."""
        out: list = [None] * len(texts)
        size = len(self.names)

        def plain(symbols: list[int]) -> list[int]:
            """A character without a piece becomes its bytes."""
            return [i for s in symbols for i in ([s] if 0 <= s < size else [self.byte[b] for b in (chr(-2 - s) if s < 0 else self.alone[s]).encode()])]

        short = [k for k, t in enumerate(texts) if len(t) <= LONG]
        for low in range(0, len(short), BLOCK):
            part = short[low : low + BLOCK]
            for index, count, symbol in self._rounds([texts[k] for k in part]):
                odd, end = bool(((symbol < 0) | (symbol >= size)).any()), 0
                symbol = symbol.tolist()
                for k, n in zip(index.tolist(), count.tolist(), strict=True):
                    out[part[k]] = plain(symbol[end : end + n]) if odd else symbol[end : end + n]
                    end += n
        for k, text in enumerate(texts):
            if out[k] is None:
                out[k] = plain(self._heap([s if (s := int(self.char[ord(c)])) >= 0 else -2 - ord(c) for c in text]))
        return out

    def _check(self, texts: list[str], found: list[list[int]]) -> None:
        """Compare with the library, many stretches between line ends at a time, and with their decoding."""
        for low in range(0, len(texts), 256):
            part, ids = texts[low : low + 256], found[low : low + 256]
            want = self.library.encode("\n" + "\n".join(part).replace(SPACE, " ") + "\n", num_threads=1)
            line = want[1:2]
            have = want[:2] + [i for row in ids for i in (*row, *line)]
            if have != want:
                wrong = [(t, i) for t, i in zip(part, ids, strict=True) if self.library.encode("\n" + t.replace(SPACE, " "))[2:] != i]
                raise ValueError(f"ids differ from the library's: {wrong[:5]}")
            back = self.decode(have)
            if back != self.library.decode(have):
                raise ValueError(f"ids decode to another text than the library's: {part}")
            if back != "\n" + "\n".join(part).replace(SPACE, " ") + "\n":
                raise ValueError(f"a stretch does not decode to itself: {part}")

    def decode(self, ids: list[int], whole: bool = True) -> str:
        """Pieces in a row, byte pieces as UTF-8, spaces restored; of a ``whole`` text without the space put before it."""
        out, run = [], bytearray()
        for i in ids:
            if i in self.of_byte:
                run.append(self.of_byte[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            if i not in self.control:
                out.append(self.names[i])
        if run:
            out.append(run.decode("utf-8", "replace"))
        text = "".join(out).replace(SPACE, " ")
        return text.removeprefix(" ") if whole else text

    def _words(self, text: str) -> list[str]:
        """Stretches of a text, of which one after a single space is named without it, and one after a line end with it.

        So most texts need but a split: ``a`` stands for a space and ``a``, the
        empty name for a space alone, ``\\na`` for a line end and ``a``.
        """
        if not text:
            return []
        if "  " not in text and text[0] != " " and SPACE not in text and self.simple:
            return text.replace("\n", " \n").split(" ")
        return [SPACE + p for p in self.cut.findall(SPACE + text.replace(" ", SPACE))]

    def batch(self, texts: list[str], checked: bool = True) -> list[tuple[str, str]]:
        """For each text its decimal ids, a space after each, without the end id; and the text that the ids decode to.

        A stretch holds the bytes of its characters whole, so a text's ids decode to what its stretches' ids do in a row.
        """
        kept, old, parts = self.kept, self.old, [self._words(t) for t in texts]
        wanted = set(chain.from_iterable(parts))
        new = wanted.difference(kept)
        kept.update({p: old[p] for p in new if p in old})
        new = list(new.difference(kept))
        if len(kept) + len(new) > CACHE:  # what this group needs stays
            self.old, self.kept = kept, {p: kept[p] for p in wanted if p in kept}
            kept = self.kept
        if new:
            # A name that begins with the space sign is a stretch as it stands behind it.
            real = [n[1:] if n[:1] == SPACE else n if n[:1] == "\n" else SPACE + n for n in new]
            pieces = [self.cut.findall(r) for r in real]
            one = list({p for row in pieces for p in row})
            found = self.stretches(one)
            if checked:
                self._check(one, found)
            name = self.decimal
            both = {p: ("".join([name[i] for i in ids]), self.decode(ids, whole=False)) for p, ids in zip(one, found, strict=True)}
            kept.update(zip(new, [tuple(map("".join, zip(*[both[p] for p in row], strict=True))) for row in pieces], strict=True))
        out = []
        for row in parts:
            ids, back = zip(*map(kept.__getitem__, row), strict=True) if row else ((), ())
            out.append(("".join(ids), "".join(back).removeprefix(" ")))
        return out

    def encode(self, text: str) -> list[int]:
        return [*map(int, self.batch([text])[0][0].split()), self.end]


def load(path: str) -> Pieces:
    return tk.held(__name__, path, Pieces)


def groups(texts: list[str], limit: int = GROUP):
    """Runs of whole texts of about ``limit`` characters."""
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += len(text)
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run


def digest(docs: DataFrame, path: str, with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text; ``with_ids`` adds ids, ``with_text`` the decoded text."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text

    def run(batches):
        model = load(path)
        for batch in batches:
            ids, row = batch.column("doc_id"), 0
            for texts in groups([t or "" for t in batch.column("text").to_pylist()]):
                count, one, two, numbers, back = [], [], [], [], []
                for decimal, decoded in model.batch(texts):
                    decimal += str(model.end)
                    count.append(decimal.count(" ") + 1)
                    one.append(hashlib.sha256(decimal.encode()).hexdigest())
                    two.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if with_ids:
                        numbers.append(np.fromstring(decimal, np.int32, sep=" "))
                    if with_text:
                        back.append(decoded)
                cols = [ids.slice(row, len(texts)), pa.array(count, pa.int64()), pa.array(one), pa.array(two)]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *count]), pa.int32()), pa.array(np.concatenate(numbers))))
                if with_text:
                    cols.append(pa.array(back, pa.string()))
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in schema.split(", ")])
                row += len(texts)

    tk.tune(docs.sparkSession, 200)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tk.tidy(run), schema)
