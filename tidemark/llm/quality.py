"""Quality rules: gradient-boosted trees over document statistics.

One pass over each whole text gives its statistics, the fixed rules read some of them, and trees learnt from labelled
documents give a verdict on the rest. Trees are grown on quantile bins by second-order gains; for chosen statistics a tree
may only fall as they grow (more repetition never makes a text better), which bounds handed down to both sides of each
split ensure. The grown trees are flattened into numpy node arrays of one shape, and a batch of documents walks all trees
at once, level by level.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import id_and_text, raw_texts, ship, tidy

# The base rules.
LEAST_WORDS, WINDOW, MOST_REPEATED = 10, 5, 20
SYMBOLS = b"#*$%&|<>"
_SPACE, _LINE = re.compile(rb"[ \t-\r]"), re.compile(rb"\n")
_BLANKS, _UPPER, _DIGITS, _MARKS = b" \t\n\x0b\x0c\r", bytes(range(65, 91)), bytes(range(48, 58)), b".,;:!?"
_CONTINUED = bytes(range(128, 192))  # bytes of UTF-8 that don't start a character
_ODD = 0x9E3779B185EBCA87

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the trees read. -1: the score may only fall as the value grows.
FEATURES = {
    "words": 0, "word_length": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "distinct_share": 0, "words_per_line": 0,
    "digit_share": 0, "upper_share": 0, "marks_per_word": 0, "non_ascii_share": 0, "longest_word": 0,
}
SAMPLE = 20_000  # labelled documents that the trees learn from, at most
TREES, DEPTH, BINS, RATE, RIDGE, LEAST = 80, 4, 64, 0.15, 1.0, 0.5  # LEAST: sum of second derivatives in a leaf
THRESHOLD = 0.5


def _blocks(raw: bytes, cut: re.Pattern, most: int = 1 << 20) -> Iterator[bytes]:
    """A text in parts of about `most` bytes that end behind a match of cut."""
    at = 0
    while at < len(raw):
        found = cut.search(raw, min(at + most, len(raw)))
        end = found.end() if found else len(raw)
        yield raw[at:end]
        at = end


def _count(raw: bytes, members: bytes) -> int:
    return len(raw) - len(raw.translate(None, members))


def _hashes(parts: Iterator[list[bytes]]) -> np.ndarray:
    arrays = [np.fromiter(map(xxhash.xxh3_64_intdigest, part), np.uint64, len(part)) for part in parts]
    return arrays[0] if len(arrays) == 1 else np.concatenate([np.zeros(0, np.uint64), *arrays])


def repeated_words(words: np.ndarray, window: int = WINDOW) -> int:
    """Words that stand in a window of `window` words which the text has twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed += words[k : k + n] * np.uint64(pow(_ODD, 2 * k + 1, 1 << 64))
        mixed ^= mixed >> np.uint64(31)
    _, place, times = np.unique(mixed, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(times[place] > 1)
    inside = np.zeros(len(words) + 1, np.int64)
    np.add.at(inside, twice, 1)
    np.add.at(inside, twice + window, -1)
    return int((np.cumsum(inside[:-1]) > 0).sum())


def statistics(raw: bytes) -> tuple[list[int], list[float]]:
    """The values of COUNTS and of FEATURES for one text.

    Words and lines are compared by 64-bit hashes, windows by a hash of five; two different ones of one text are taken
    for equal with a chance of about n^2 / 2^65.
    """
    longest = 0

    def words() -> Iterator[list[bytes]]:
        nonlocal longest
        for block in _blocks(raw, _SPACE):
            part = block.split()
            longest = max(longest, max(map(len, part), default=0))
            yield part

    own = _hashes(words())
    lines = _hashes([line for line in block.split(b"\n") if line.strip()] for block in _blocks(raw, _LINE))
    n, n_lines = len(own), len(lines)
    blank, continued = _count(raw, _BLANKS), _count(raw, _CONTINUED)
    chars = len(raw) - blank - continued
    symbols, dups, repeats = _count(raw, SYMBOLS), n_lines - len(np.unique(lines)), repeated_words(own)
    some, some_lines, some_chars = max(n, 1), max(n_lines, 1), max(chars, 1)
    values = [
        n, chars / some, symbols / some, dups / some_lines, repeats / some, len(np.unique(own)) / some, n / some_lines,
        _count(raw, _DIGITS) / some_chars, _count(raw, _UPPER) / some_chars, _count(raw, _MARKS) / some, _count(raw, bytes(range(192, 256))) / some_chars, longest,
    ]
    return [n, chars, symbols, dups, repeats], [float(v) for v in values]


def failed(counts: np.ndarray) -> np.ndarray:
    """The base rules over rows of COUNTS."""
    return (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])


@dataclass
class Forest:
    """Trees as arrays: node i of a tree has the children 2i + 1 (value <= threshold) and 2i + 2; a node that was not
    split sends all to the left. Values belong to the last level."""

    feature: np.ndarray  # (trees, nodes) int16
    threshold: np.ndarray  # (trees, nodes) float64
    value: np.ndarray  # (trees, leaves) float64
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        trees, nodes = self.feature.shape
        if not trees:
            return np.full(len(x), self.bias)
        at, tree, row = np.zeros((len(x), trees), np.int64), np.arange(trees), np.arange(len(x))[:, None]
        for _ in range((nodes + 1).bit_length() - 1):
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.threshold[tree, at])
        return self.bias + self.value[tree, at - nodes].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Estimated chance of label 1."""
        parts = [1 / (1 + np.exp(-np.clip(self.margin(x[k : k + 4096]), -40, 40))) for k in range(0, len(x), 4096)]
        return np.concatenate([np.zeros(0), *parts])


def _grow(binned: np.ndarray, g: np.ndarray, h: np.ndarray, signs: np.ndarray, depth: int, ridge: float, least: float, bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, cut, value) of one tree: rows whose bin is at most cut go to the left."""
    nodes, width = (1 << depth) - 1, binned.shape[1]
    feature, cut, value = np.zeros(nodes, np.int16), np.full(nodes, bins, np.int64), np.zeros(nodes + 1)
    node, low, high = np.zeros(len(g), np.int64), {0: -np.inf}, {0: np.inf}
    weight = lambda a, b: -a / (b + ridge)
    for level in range(depth):
        first = (1 << level) - 1
        for k in range(first, 2 * first + 1):
            lo, hi = low[k], high[k]
            own = np.flatnonzero(node == k)
            low[2 * k + 1] = low[2 * k + 2] = lo
            high[2 * k + 1] = high[2 * k + 2] = hi
            best, chosen = 1e-6, None
            if len(own) and h[own].sum() >= 2 * least:
                gs, hs = g[own], h[own]
                flat = (binned[own] + np.arange(width) * bins).ravel()
                sums = lambda x: np.bincount(flat, np.repeat(x, width), width * bins).reshape(width, bins).cumsum(axis=1)[:, :-1]  # noqa: E731, B023
                gl, hl = sums(gs), sums(hs)
                gr, hr = gs.sum() - gl, hs.sum() - hl
                wl, wr = np.clip(weight(gl, hl), lo, hi), np.clip(weight(gr, hr), lo, hi)
                gain_of = lambda a, b, w: -(2 * a * w + (b + ridge) * w * w)
                gain = gain_of(gl, hl, wl) + gain_of(gr, hr, wr) - gain_of(gs.sum(), hs.sum(), np.clip(weight(gs.sum(), hs.sum()), lo, hi))
                # A statistic with a sign allows only splits whose sides' weights are in that order.
                gain[(hl < least) | (hr < least) | (signs[:, None] * (wr - wl) < 0)] = 0
                f, b = np.unravel_index(int(gain.argmax()), gain.shape)
                best, chosen = gain[f, b], (int(f), int(b)) if gain[f, b] > best else None
            if chosen:
                f, b = chosen
                feature[k], cut[k] = f, b
                if signs[f]:
                    middle = (wl[f, b] + wr[f, b]) / 2
                    (high if signs[f] > 0 else low)[2 * k + 1] = middle
                    (low if signs[f] > 0 else high)[2 * k + 2] = middle
            node[own] = 2 * k + 1 + (binned[own, feature[k]] > cut[k])
    for k in range(nodes, 2 * nodes + 1):
        own = node == k
        if own.any():
            value[k - nodes] = np.clip(weight(g[own].sum(), h[own].sum()), low[k], high[k])
        else:  # no row of the sample comes here; stay within what the path allows
            value[k - nodes] = np.clip(0.0, low[k], high[k])
    return feature, cut, value


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, ridge: float = RIDGE, least: float = LEAST) -> Forest:
    """Boosted trees for the logistic loss. Without both labels there are no trees and the score is the share of label 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    bias, nodes = float(np.log(share / (1 - share))), (1 << depth) - 1
    if len(y) == 0 or y.min() == y.max():
        return Forest(np.zeros((0, nodes), np.int16), np.zeros((0, nodes)), np.zeros((0, nodes + 1)), bias)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    margin, found = np.full(len(y), bias), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        feature, cut, value = _grow(binned, p - y, np.maximum(p * (1 - p), 1e-6), np.array(signs), depth, ridge, least, bins)
        threshold = np.array([edges[f][c] if c < len(edges[f]) else np.inf for f, c in zip(feature.tolist(), cut.tolist(), strict=True)])
        found.append(Forest(feature[None], threshold[None], value[None] * rate, 0.0))
        margin = margin + found[-1].margin(x)
    return Forest(*(np.concatenate([getattr(t, c) for t in found]) for c in ("feature", "threshold", "value")), bias)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **how: object) -> Forest:
    """Learns quality from labelled documents, the `sample` labels whose ids have the smallest hashes.

    A label that is null is left out; of repeated labels of one id the smallest counts, and of repeated documents the one
    with the least statistics. The statistics of the drawn documents go to one executor task, which returns the trees.
    """
    ship(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # Twice the hashes that are wanted on average, of which the smallest are taken: few rows are sorted at any scale.
    share = min(1.0, 2 * sample / max(known.count(), 1))
    known = known.withColumn("h", F.xxhash64("doc_id")).filter(F.col("h") <= F.lit(-(1 << 63) + min((1 << 64) - 1, int(share * (1 << 64)))))
    drawn = known.orderBy("h", "doc_id").limit(sample).select("doc_id", "quality")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [statistics(raw)[1] for raw in raw_texts(batch.column(2))]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(values, pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = [np.zeros((0, len(FEATURES)))], [np.zeros(0)]
        for batch in batches:
            x.append(batch.column(1).flatten().to_numpy().reshape(len(batch), -1))
            y.append((batch.column(0).to_numpy() > 0).astype(float))
        m = fit(np.concatenate(x), np.concatenate(y), list(FEATURES.values()), **how)
        arrays = (m.feature.astype(float), m.threshold, m.value, np.array([m.bias]))
        yield pa.record_batch([pa.array([a.ravel().tolist()], pa.list_(pa.float64())) for a in arrays], ["feature", "threshold", "value", "bias"])

    # The drawn labels are `sample` rows at most, so they can be broadcast whatever the corpus.
    seen = id_and_text(docs).join(F.broadcast(drawn), "doc_id").select("doc_id", "quality", "text").mapInArrow(tidy(read), "doc_id long, quality int, x array<double>")
    seen = seen.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("x").alias("x"))
    seen = seen.repartition(1).sortWithinPartitions("doc_id").select("quality", "x")
    found = seen.mapInArrow(tidy(learn), "feature array<double>, threshold array<double>, value array<double>, bias array<double>").toArrow().to_pylist()
    if not found:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0), list(FEATURES.values()), **how)
    nodes = (1 << int(how.get("depth", DEPTH))) - 1
    m = {name: np.array(v, float) for name, v in found[0].items()}
    return Forest(m["feature"].reshape(-1, nodes).astype(np.int16), m["threshold"].reshape(-1, nodes), m["value"].reshape(-1, nodes + 1), float(m["bias"][0]))


def quality_report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept, score and the values of FEATURES for every whole text.

    A null text has no words and fails the base rules, like every text of fewer than LEAST_WORDS. Null ids and repeated
    rows are scored like others; an empty table gives no rows. With no labels at all every score is 0.5, so the base rules
    alone decide. Other columns do no harm.
    """
    forest = train(docs, labels, sample)
    shared = docs.sparkSession.sparkContext.broadcast(forest)  # TREES * 2^DEPTH nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(raw) for raw in raw_texts(batch.column(1))]
            counts, x = np.array([r[0] for r in rows], np.int64).reshape(-1, len(COUNTS)), np.array([r[1] for r in rows]).reshape(-1, len(FEATURES))
            fail, score = failed(counts), shared.value.score(x)
            yield pa.record_batch([batch.column(0), *map(pa.array, counts.T), pa.array(fail), pa.array(~fail & (score >= threshold)), pa.array(score), *map(pa.array, x.T)], names)

    names = ["doc_id", *COUNTS, "base_failed", "kept", "score", *FEATURES]
    schema = ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS), "base_failed boolean, kept boolean, score double", *(f"{c} double" for c in FEATURES)])
    return id_and_text(docs).mapInArrow(tidy(run), schema)
