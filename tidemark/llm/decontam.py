"""Benchmark decontamination: a BM25 inverted index of test items, searched with block-max WAND by every training passage.

Weights are normalised: the weight of a word in an item is its BM25 contribution over the sum of the item's own, so an
item scores 1 against a passage that holds all of it, and one threshold RHO serves all items. A passage is a
window of words, long enough that an item's text lies whole in some window. All passages of a batch first meet an upper bound
in numpy: the weights of an item's rare words seen in the window, plus all its common words. Only windows whose bound
reaches RHO for an item are searched: block-max WAND retrieves every item whose score reaches RHO, and each is verified
by the five-word shingles that the passage holds: OVERLAP of the whole item's, or of its question's and of its answer's,
between which a passage may have words of its own. An item of fewer than five words says nothing inside a longer text: it
leaks where a document consists of its words alone.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from .common import ALNUM, id_and_text, pieces, private, raw_texts, spans_of, tidy

K1, B = 1.2, 0.75
RHO = 0.6
OVERLAP = 0.8
SHINGLE = 5
BLOCK = 16
BETWEEN = 8  # words between question and answer for which a window has room, wherever it begins
RARE = 3  # items at most that a rare word may be in
SHARD = 20_000  # items in the indexes of one broadcast, and
SHARD_BYTES = 16 << 20  # bytes of their texts, about: a broadcast is bounded, and more items make more of them
LENGTH = 64  # items of up to 64, 128, 256, … words are in indexes of their own, as the window follows their length
_ANSWER = re.compile(r"(?s)^(.*[.?!:\n])\s*(\S.*)$")


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(ALNUM).split()


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence is the answer; a text of one sentence is a question alone."""
    m = _ANSWER.match(text.strip().rstrip(".?!"))
    return (m[1], m[2]) if m else (text, "")


def length_class(n: int) -> int:
    """The bound of the index that an item of n words is in."""
    bound = LENGTH
    while bound < n:
        bound *= 2
    return bound


def shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)} or ({tuple(words)} if words else set())


def held(part: set[tuple[bytes, ...]], passage: set[tuple[bytes, ...]], words: list[bytes]) -> float | None:
    """Share of an item part's shingles in a passage; null for an empty part."""
    if not part:
        return None
    first = next(iter(part))
    if len(first) < SHINGLE:  # a part shorter than a shingle: as one sequence
        return float(any(tuple(words[i : i + len(first)]) == first for i in range(len(words) - len(first) + 1)))
    return len(part & passage) / len(part)


def follows(question: list[bytes], answer: list[bytes], words: list[bytes]) -> bool:
    """Whether the answer stands after the question, with BETWEEN words between them at most."""
    n, m = len(question), len(answer)
    for i in range(len(words) - n - m + 1):
        if words[i : i + n] == question and any(words[j : j + m] == answer for j in range(i + n, i + n + BETWEEN + 1)):
            return True
    return False


@dataclass
class Statistics:
    """What BM25 needs of the whole benchmark: items, their mean length, and how many items have a word."""

    n: int
    mean: float
    df: dict[bytes, int]

    @classmethod
    def of(cls, texts: list[str]) -> Statistics:
        words = [w for t in texts if (w := words_of(t.encode("utf-8", "replace")))]
        return cls(len(words), sum(map(len, words)) / max(len(words), 1), Counter(w for ws in words for w in set(ws)))


class Index:
    """Items of one class of lengths with postings in blocks, each with its largest weight. An item's weights and windows follow
    from itself and the statistics of the whole benchmark, not from the items beside it."""

    def __init__(self, items: list[tuple[int, str]], statistics: Statistics | None = None):
        about = statistics or Statistics.of([t or "" for _, t in items])
        self.item_ids = [i for i, _ in items]
        self.words = [words_of((t or "").encode("utf-8", "replace")) for _, t in items]
        self.part_words = [tuple(words_of(p.encode("utf-8", "replace")) for p in question_and_answer(t or "")) for _, t in items]
        self.parts = [tuple(map(shingles, p)) for p in self.part_words]
        self.whole = [shingles(w) for w in self.words]
        n, df = about.n, about.df
        mean = max(1.0, about.mean)
        self.postings: dict[bytes, list[tuple[int, float]]] = {}
        rare: dict[bytes, list[tuple[int, float]]] = {}
        self.short: dict[tuple[bytes, ...], list[int]] = {}
        self.rest = np.zeros(len(items))  # weight of the words by which an item isn't looked for
        for k, ws in enumerate(self.words):
            if len(ws) < SHINGLE:
                self.short.setdefault(tuple(ws), []).append(k)
                continue
            tf = Counter(ws)
            raw = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(ws) / mean)) for w, c in tf.items()}
            total = sum(raw.values()) or 1.0
            self.rest[k] = 1.0
            for w, x in sorted(raw.items(), key=lambda v: (df[v[0]], v[0])):
                self.postings.setdefault(w, []).append((k, x / total))
                # Looked for by its rare words; an item of common words by as many of its rarest as it can't do without.
                if df[w] <= RARE or self.rest[k] >= RHO - 1e-6:
                    rare.setdefault(w, []).append((k, x / total))
                    self.rest[k] -= x / total
        self.blocks = {w: [(p[min(s + BLOCK, len(p)) - 1][0], max(x for _, x in p[s : s + BLOCK])) for s in range(0, len(p), BLOCK)] for w, p in self.postings.items()}
        self.most = {w: max(x for _, x in p) for w, p in self.postings.items()}
        self.rare = {w: r for r, w in enumerate(sorted(rare))}
        lists = [rare[w] for w in sorted(rare)]
        self.rare_at = spans_of(np.array([len(x) for x in lists], int))
        self.rare_item = np.array([k for x in lists for k, _ in x], np.int64)
        self.rare_weight = np.array([x for p in lists for _, x in p])
        self.stride = max(map(length_class, map(len, self.words)), default=LENGTH) + BETWEEN
        self.window = 2 * self.stride

    def search(self, words: list[bytes], rho: float = RHO) -> list[tuple[int, float]]:
        """(item, score) of every item whose score reaches rho: block-max WAND over the passage's distinct words."""
        slack = rho - 1e-9
        lists = [(w, self.postings[w], self.blocks[w]) for w in dict.fromkeys(words) if w in self.postings]
        at = [0] * len(lists)
        found = []
        live = list(range(len(lists)))
        while live:
            live.sort(key=lambda i: lists[i][1][at[i]][0])
            bound, pivot = 0.0, -1
            for p, i in enumerate(live):
                bound += self.most[lists[i][0]]
                if bound >= slack:
                    pivot = p
                    break
            if pivot < 0:
                return found
            item = lists[live[pivot]][1][at[live[pivot]]][0]
            while pivot + 1 < len(live) and lists[live[pivot + 1]][1][at[live[pivot + 1]]][0] == item:
                pivot += 1
            # What the blocks that hold the pivot item can give, and where the nearest of them ends.
            block_bound, nearest = 0.0, 1 << 60
            for i in live[: pivot + 1]:
                blocks = lists[i][2]
                b = at[i] // BLOCK
                while b < len(blocks) and blocks[b][0] < item:
                    b += 1
                if b < len(blocks):
                    block_bound += blocks[b][1]
                    nearest = min(nearest, blocks[b][0])
            if block_bound >= slack:
                if lists[live[0]][1][at[live[0]]][0] == item:
                    score = 0.0
                    for i in live[: pivot + 1]:
                        score += lists[i][1][at[i]][1]
                        at[i] += 1
                    if score >= slack:
                        found.append((item, score))
                else:
                    for i in live[:pivot]:
                        at[i] = bisect_left(lists[i][1], item, at[i], key=lambda x: x[0])
            else:
                target = nearest + 1
                if pivot + 1 < len(live):
                    target = min(target, lists[live[pivot + 1]][1][at[live[pivot + 1]]][0])
                for i in live[: pivot + 1]:
                    at[i] = bisect_left(lists[i][1], target, at[i], key=lambda x: x[0])
            live = [i for i in live if at[i] < len(lists[i][1])]
        return found

    def candidates(self, hits: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
        """(document, window) pairs whose upper bound reaches RHO for some item.

        hits: rare-word number of every word of consecutive documents, -1 for others; sizes: words of each document.
        """
        offsets = spans_of(sizes)
        n_windows = np.maximum(1, -(-sizes // self.stride))
        base = spans_of(n_windows)
        keys: list[np.ndarray] = []
        place = np.flatnonzero(hits >= 0)
        if len(place):
            term = hits[place]
            count = self.rare_at[term + 1] - self.rare_at[term]
            posting = np.repeat(self.rare_at[term], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            doc = np.searchsorted(offsets, place, "right") - 1
            own = (place - offsets[doc]) // self.stride
            n_items = len(self.item_ids)
            window = np.repeat(base[doc] + own, count)
            item, weight = self.rare_item[posting], self.rare_weight[posting]
            first = np.repeat(own, count) > 0  # a word is also in the window that began one stride before
            key = np.concatenate((window * n_items + item, (window[first] - 1) * n_items + item[first]))
            weight = np.concatenate((weight, weight[first]))
            key, inverse = np.unique(key, return_inverse=True)
            total = np.bincount(inverse, weight)
            keys.append(key[total + self.rest[key % n_items] >= RHO - 1e-6] // n_items)
        windows = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        doc = np.searchsorted(base, windows, "right") - 1
        return list(zip(doc.tolist(), (windows - base[doc]).tolist(), strict=True))

    def apart(self, item: int, question: float | None, answer: float | None, words: list[bytes]) -> bool:
        """Whether a passage holds question and answer, each by its own overlap. Two parts shorter than a shingle say
        little about each other when far apart, so they must follow each other; items shorter than a shingle are whole."""
        q, a = self.part_words[item]
        if question is None or answer is None or min(question, answer) < OVERLAP or len(q) + len(a) < SHINGLE:
            return False
        return max(len(q), len(a)) >= SHINGLE or follows(q, a, words)

    def leaks(self, texts: list[bytes]) -> list[tuple[int, int, int, float, float, float | None, float | None]]:
        """(place of the text, item, first word, score, overlap, question overlap, answer overlap), the best window of each item."""
        words = [words_of(raw) for raw in texts]
        get = self.rare.get
        sizes = np.array([len(w) for w in words], np.int64)
        total = int(sizes.sum())
        hits = np.fromiter((get(w, -1) for ws in words for w in ws), np.int64, total)
        best: dict[tuple[int, int], tuple] = {}
        for doc, n in self.candidates(hits, sizes):
            start = n * self.stride
            passage = words[doc][start : start + self.window]
            found = self.search(passage)
            if not found:
                continue
            own = shingles(passage)
            for item, score in found:
                overlap = held(self.whole[item], own, passage) or 0.0
                question, answer = (held(p, own, passage) for p in self.parts[item])
                if overlap < OVERLAP and not self.apart(item, question, answer, passage):
                    continue
                row = (doc, item, start, score, overlap, question, answer)
                old = best.get((doc, item))
                if old is None or (overlap, round(score, 9)) > (old[4], round(old[3], 9)):  # sums of other orders are equal
                    best[doc, item] = row
        for doc, ws in enumerate(words if self.short else ()):
            for item in self.short.get(tuple(ws), ()) if len(ws) < SHINGLE else ():
                best[doc, item] = (doc, item, 0, 1.0, 1.0, *(held(p, shingles(ws), ws) for p in self.parts[item]))
        return [best[k] for k in sorted(best)]


def indexes(benchmark: DataFrame, shard: int = SHARD) -> Iterator[Broadcast]:
    """Broadcasts of an index for each class of lengths, over `shard` items or SHARD_BYTES at most (about, as shards are dealt
    by a hash), built one after another: the driver holds one at a time, as a broadcast is kept in files. Numbers of items
    and words, on which scores rest, are counted over the whole benchmark before; a shard is given those of its own words."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(raw) for raw in raw_texts(batch.column(1))]
            own = [sorted(set(w)) for w in words]
            lists = pa.ListArray.from_arrays(pa.array(spans_of(np.array([len(w) for w in own], int)), pa.int32()), pa.array([x for w in own for x in w], pa.binary()))
            yield pa.record_batch([batch.column(0), pa.array([len(w) for w in words], pa.int64()), lists], ["shard", "length", "words"])

    held = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()
    shards = max(1, -(-held.n // shard), -(-held["size"] // SHARD_BYTES))
    of = F.pmod(F.xxhash64("item_id", "text"), F.lit(shards))
    read = items.select(of.alias("shard"), "text").mapInArrow(run, "shard long, length long, words array<binary>").filter("length > 0")
    whole = read.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    words = read.select("shard", F.explode("words").alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("df"))
    for s in range(shards):
        own = counts if shards == 1 else counts.join(words.filter(F.col("shard") == s).select("word").distinct(), "word")
        statistics = Statistics(whole.n, whole.mean or 0.0, {bytes(r.word): r.df for r in own.collect()})
        rows = [(r.item_id, r.text) for r in items.filter(of == s).collect()]
        rows = sorted(((i, t) for i, t in rows if words_of(t.encode("utf-8", "replace"))), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        classes: dict[int, list[tuple[int, str]]] = {}
        for i, t in rows:
            classes.setdefault(length_class(len(words_of(t.encode("utf-8", "replace")))), []).append((i, t))
        if classes:
            yield spark.sparkContext.broadcast([Index(classes[c], statistics) for c in sorted(classes)])


LEAK = "doc_id long, item_id long, first_word long, score double, overlap double, question_overlap double, answer_overlap double"


def find_leaks(docs: DataFrame, benchmark: DataFrame, shard: int = SHARD) -> DataFrame:
    """Rows of LEAK: each document and item whose score and verified overlap reach the thresholds, at the best window.

    Null or empty texts hold nothing; items without words are left out; of a repeated item or document every row is
    reported; empty tables give no rows. How many items there are besides, and how they are dealt over shards, changes no row
    but through the counts of the whole benchmark. Whole texts are searched; other columns of any name play no part.
    """
    docs = id_and_text(docs)
    out = None
    for shared in indexes(benchmark, shard):

        def run(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in pieces(batch, 8 << 20):
                    ids, texts = part.column(0).to_pylist(), raw_texts(part.column(1))
                    rows = [(ids[d], index.item_ids[i], *more) for index in shared.value for d, i, *more in index.leaks(texts)]
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.float64())
                    yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "item_id", "first_word", "score", "overlap", "question_overlap", "answer_overlap"])

        found = docs.mapInArrow(tidy(run), LEAK)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], LEAK) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns. Documents without text stay; empty tables change nothing."""
    docs = private(docs)
    names = docs.columns
    column = names.index("text")
    for shared in indexes(benchmark):

        def run(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in pieces(batch, 8 << 20, column):
                    texts = raw_texts(part.column(column))
                    bad = {d for index in shared.value for d, *_ in index.leaks(texts)}
                    yield part.filter(pa.array([k not in bad for k in range(part.num_rows)])) if bad else part

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs
