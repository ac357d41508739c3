"""Quality rules: a linear-chain conditional random field labels the lines of a document.

Each line with a word gets binary features.  A two-label chain (content,
boilerplate) is fitted by maximum likelihood on labelled documents; Viterbi
decoding labels every line of every document, and the share of words in content
lines decides retention.  Plain counts (words, symbols, equal lines, repeated
8-word windows) form the base rules in front of it.

Defined cases: a null or empty text has no words and is not kept; a null doc_id
stays null; repeated rows are judged each by itself; columns beside ``doc_id``
and ``text`` are ignored.  Without labelled rows fixed default weights are used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk

FEATURES = ("symbol_heavy", "symbol_some", "upper_heavy", "bars", "repeats_line", "few_words", "low_variety", "long_words", "no_stop", "digits_heavy", "bangs")
#: Bounds of the training sample: labelled documents, and bytes of one of them.
SAMPLE_DOCS, SAMPLE_BYTES = 1200, 20_000
#: Lines, with padding, of labelled documents that the driver takes up at once while it fits.
CELLS = 100_000
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
RANGE = np.zeros((6, 256), bool)
RANGE[0, 65:91] = True
RANGE[1, 97:123] = True
RANGE[2, 48:58] = True
RANGE[3, ord("!")] = True
RANGE[4, ord("|")] = True
RANGE[5, list(b".?!:;")] = True
POLY = tk.Poly(8)
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, content_lines long, content_words long"


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the \\n-split lines, and the first line of each row (one more than rows)."""
    cut = np.flatnonzero(data == 10)
    row = np.searchsorted(offsets, cut, "right") - 1
    n = len(offsets) - 1
    start = np.concatenate([offsets[:-1], cut + 1])
    owner = np.concatenate([np.arange(n), row])
    order = np.lexsort((start, owner))
    start, owner = start[order], owner[order]
    first = np.searchsorted(owner, np.arange(n + 1))
    end = np.empty(len(start), np.int64)
    end[:-1] = start[1:] - 1
    last = first[1:] - 1
    end[last] = offsets[1:]
    return start, end, first


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each document and the feature code of each of its lines with a word."""
    start, end, first = tk.words(data, offsets)
    prefix = POLY.prefix(data)
    word = POLY.ranges(prefix, start, end)
    chars = tk.total(((data & 0xC0) != 0x80) & ~tk.WS[data], offsets)
    out = {"n_words": np.diff(first), "word_chars": chars, "n_symbols": tk.total(SYMBOLS[data], offsets)}

    key, row, at = tk.windows(word, first, 8)
    full = out["n_words"][row] >= 8
    key, row, at = key[full], row[full], at[full]
    again = tk.twice(tk.mix(key + row.astype(np.uint64) * tk.U(0x9E3779B97F4A7C15)))
    edge = np.zeros(len(word) + 9, np.int64)
    edge[at[again]] += 1
    edge[at[again] + 8] -= 1
    out["n_repeat_words"] = tk.total(np.cumsum(edge)[: len(word)] > 0, first)

    begin, stop, of = lines(data, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(of))
    count = np.searchsorted(start, stop) - np.searchsorted(start, begin)
    live = count > 0
    begin, stop, doc, count = begin[live], stop[live], doc[live], count[live]
    key = tk.mix(POLY.ranges(prefix, begin, stop) + doc.astype(np.uint64) * tk.U(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    later = np.zeros(len(key), bool)
    later[order[1:]] = key[order][1:] == key[order][:-1]
    out["n_dup_lines"] = np.bincount(doc[later], minlength=len(offsets) - 1)

    def within(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return sums[stop] - sums[begin]

    size = np.maximum(within((data & 0xC0) != 0x80), 1)
    upper, lower, digit, bang, bar, ends = (within(RANGE[i][data]) for i in range(6))
    signs = within(SYMBOLS[data])
    line_of_word = np.searchsorted(begin, start, "right") - 1
    seen = tk.mix(word + line_of_word.astype(np.uint64) * tk.U(0xC2B2AE3D27D4EB4F))
    order = np.argsort(seen)
    repeat = np.zeros(len(seen), bool)
    repeat[order[1:]] = seen[order][1:] == seen[order][:-1]
    distinct = count - np.bincount(line_of_word[repeat], minlength=len(begin)) if len(begin) else count
    flags = (
        signs * 10 > size, signs * 50 > size, upper > lower, bar * 4 > count, later, count < 3,
        distinct * 2 < count, size > 11 * count, ends == 0, digit * 5 > size, bang * 3 > count,
    )
    code = np.zeros(len(begin), np.int64)
    for i, flag in enumerate(flags):
        code |= flag.astype(np.int64) << i
    return out | {"line_doc": doc, "line_words": count, "line_code": code}


def bits(code: np.ndarray) -> np.ndarray:
    return np.concatenate([(code[..., None] >> np.arange(len(FEATURES))) & 1, np.ones((*code.shape, 1), np.int64)], -1).astype(float)


def default_weights() -> dict[str, list]:
    """Weights used where no labelled rows exist: every feature speaks for boilerplate."""
    return {"emit": [2.0] * len(FEATURES) + [-2.5], "step": [[0.5, -0.5], [-0.5, 0.5]]}


def by_length(sequences: list[np.ndarray], cells: int = CELLS) -> list[list[int]]:
    """Indices of chains of like length, so many at a time that their padded table has about ``cells`` cells."""
    out: list[list[int]] = []
    for i in sorted(range(len(sequences)), key=lambda i: len(sequences[i])):
        if not out or (len(out[-1]) + 1) * len(sequences[i]) > cells or len(sequences[i]) > 2 * len(sequences[out[-1][0]]) + 8:
            out.append([])
        out[-1].append(i)
    return out


def group(sequences: list[np.ndarray], labels: np.ndarray, part: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line codes of chains, padded to the longest, which places are live, and the labels that each line may have."""
    longest = max(len(sequences[i]) for i in part)
    code, live = np.zeros((len(part), longest), np.int64), np.zeros((len(part), longest), bool)
    for row, i in enumerate(part):
        code[row, : len(sequences[i])], live[row, : len(sequences[i])] = sequences[i], True
    y, allowed = labels[part], np.ones((*code.shape, 2), bool)
    allowed[y == 0, :, 1] = False
    allowed[(y == 1)[:, None] & (code != 0), 0] = False
    return code, live, allowed


def fit(sequences: list[np.ndarray], labels: list[int], rounds: int = 60, rate: float = 0.8) -> dict[str, list]:
    """Maximum-likelihood chain weights from documents' line codes; all lines of one bear its label (1: boilerplate).

    The lines of rejected documents that no rejecting feature marks are left
    unlabelled: their label is summed out, so clean lines inside junk do not
    teach that clean lines are boilerplate.
    """
    if len(set(labels)) < 2:
        return default_weights()
    every = bits(np.arange(1 << len(FEATURES)))  # the features of each line code
    weight, step = np.zeros(every.shape[1]), np.zeros((2, 2))
    grown = [np.zeros_like(weight), np.zeros_like(step)]
    groups = [group(sequences, np.array(labels), part) for part in by_length(sequences)]

    def expect(code: np.ndarray, live: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected boilerplate marks and steps under the labels that ``mask`` allows."""
        n, longest = code.shape
        score = np.where(mask, np.stack([np.zeros((n, longest)), (every @ weight)[code]], -1), -1e9)
        forward = np.empty((n, longest, 2))
        forward[:, 0] = score[:, 0]
        for t in range(1, longest):
            forward[:, t] = np.logaddexp(forward[:, t - 1, :1] + step[0], forward[:, t - 1, 1:] + step[1]) + score[:, t]
            forward[:, t] = np.where(live[:, t, None], forward[:, t], forward[:, t - 1])
        backward = np.zeros((n, longest, 2))
        for t in range(longest - 2, -1, -1):
            ahead = score[:, t + 1] + backward[:, t + 1]
            value = np.logaddexp(ahead[:, :1] + step[:, 0], ahead[:, 1:] + step[:, 1])
            backward[:, t] = np.where(live[:, t + 1, None], value, 0)
        norm = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        mark = np.exp(forward + backward - norm[:, None, None])[..., 1] * live
        pair = forward[:, :-1, :, None] + step + (score + backward)[:, 1:, None, :] - norm[:, None, None, None]
        return np.bincount(code.ravel(), mark.ravel(), len(every)) @ every, (np.exp(np.minimum(pair, 0)) * live[:, 1:, None, None]).sum((0, 1))

    total = max(1, sum(map(len, sequences)))
    for _ in range(rounds):
        told, free = ([sum(x) for x in zip(*(expect(code, live, mask if bound else np.ones_like(mask)) for code, live, mask in groups), strict=True)] for bound in (True, False))
        for part, (a, b, g) in enumerate(zip(told, free, grown, strict=True)):
            slope = (a - b) / total - 1e-4 * (weight, step)[part]
            g += slope**2
            (weight, step)[part][...] += rate * slope / np.sqrt(g + 1e-12)
    return {"emit": weight.tolist(), "step": step.tolist()}


def viterbi(doc: np.ndarray, code: np.ndarray, model: dict[str, list]) -> np.ndarray:
    """1 for boilerplate, 0 for content: the best labels of all chains, one position of every chain at a time."""
    if not len(doc):
        return np.zeros(0, np.int64)
    emit, step = bits(code) @ np.array(model["emit"]), np.array(model["step"])
    begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    length = np.diff(np.concatenate([begin, [len(doc)]]))
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    back = np.zeros((len(doc), 2), np.int8)
    best = np.stack([np.zeros(len(begin)), emit[begin]], -1)
    for t in range(1, int(length[0])):
        k = int(np.searchsorted(-length, -t))  # chains longer than t
        move = best[:k, :, None] + step
        back[begin[:k] + t] = move.argmax(1)
        best[:k] = move.max(1)
        best[:k, 1] += emit[begin[:k] + t]
    label = np.zeros(len(doc), np.int64)
    now = best.argmax(1)
    for t in range(int(length[0]) - 1, -1, -1):
        k = int(np.searchsorted(-length, -t))
        label[begin[:k] + t] = now[:k]
        now[:k] = back[begin[:k] + t, now[:k]]
    return label


def judge(docs: DataFrame, model: dict[str, list], share: float = 0.5) -> DataFrame:
    """One row per document: base counts, labelled lines, ``kept``."""

    def run(batches):
        for batch in batches:
            data, offsets = tk.flat(batch.column("text"))
            ids = batch.column("doc_id")
            for row, part, off in tk.chunks(data, offsets):
                m = measure(part, off)
                label, n = viterbi(m["line_doc"], m["line_code"], model), len(off) - 1
                content = label == 0
                words = np.bincount(m["line_doc"], m["line_words"] * content, n).astype(np.int64)
                failed = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
                kept = ~failed & (words >= share * m["n_words"])
                cols = [m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"], failed, kept]
                cols += [np.bincount(m["line_doc"], minlength=n), np.bincount(m["line_doc"][content], minlength=n), words]
                yield pa.RecordBatch.from_arrays([ids.slice(row, n), *map(pa.array, cols)], [c.split()[0] for c in SCHEMA.split(", ")])

    tk.tune(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tk.tidy(run), SCHEMA)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> dict[str, list]:
    """Weights from at most SAMPLE_DOCS labelled documents of at most SAMPLE_BYTES, taken in the order of a hash of their id."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality IN (0, 1) AND doc_id IS NOT NULL")
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = labels.where("quality = 0").orderBy(*order).limit(SAMPLE_DOCS // 2).union(labels.where("quality = 1").orderBy(*order).limit(SAMPLE_DOCS // 2))
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .where(F.octet_length("text") <= SAMPLE_BYTES)
        .join(F.broadcast(chosen.dropDuplicates(["doc_id"])), "doc_id")
        .orderBy("doc_id", F.xxhash64("text")).limit(SAMPLE_DOCS).collect()
    )
    if not rows:
        return default_weights()
    data, offsets = tk.flat(pa.array([r["text"] for r in rows], pa.string()))
    m = measure(data, offsets)
    cut = np.searchsorted(m["line_doc"], np.arange(len(rows) + 1))
    taken = [(m["line_code"][cut[i] : cut[i + 1]], 1 - r["quality"]) for i, r in enumerate(rows) if cut[i + 1] > cut[i]]
    return fit([s for s, _ in taken], [y for _, y in taken]) if taken else default_weights()


def keep(docs: DataFrame, model: dict[str, list]) -> DataFrame:
    """``docs`` without the documents that the rules reject, all columns as they were.

    The verdict is taken beside each row's own text, so rows with equal or null
    ids need no join and no shuffle.
    """
    names, schema = docs.columns, docs.schema

    def run(batches):
        for batch in batches:
            data, offsets = tk.flat(batch.column(names.index("text")).cast(pa.string()))
            kept = np.zeros(len(offsets) - 1, bool)
            for row, part, off in tk.chunks(data, offsets):
                m = measure(part, off)
                n = len(off) - 1
                content = viterbi(m["line_doc"], m["line_code"], model) == 0
                words = np.bincount(m["line_doc"], m["line_words"] * content, n)
                kept[row : row + n] = (m["n_words"] >= 20) & (100 * m["n_repeat_words"] <= 30 * m["n_words"]) & (words >= 0.5 * m["n_words"])
            yield batch.filter(pa.array(kept))

    tk.tune(docs.sparkSession)
    return docs.mapInArrow(tk.tidy(run), schema)
