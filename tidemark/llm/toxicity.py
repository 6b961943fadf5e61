"""Toxicity: a factorization machine over hashed terms.

Terms are a document's distinct words and their first four and five characters (so that inflected forms share a term),
hashed into SPACE buckets. A bucket carries a weight and a vector of FACTORS numbers if it tells the labels of the
training sample apart by itself (by the Wilson bound of the share of label 1), or if it does so together with another:
of the PAIRED most frequent buckets all pairs are counted, and both ends of a pair are taken whose share of label 1 is
surely above that of either end. The score is the logistic of
    bias + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j,
so a pair such as an insult and a group mention can weigh more than the two alone. x_i is 4/sqrt(RAMP + n) with n active
terms. Learning uses a sample of SAMPLE labelled documents at most, in one executor task; the driver only passes the
model on. Labels are never an input of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import ALNUM, fold_of, id_and_text, private, raw_texts, ship, spans_of, tidy

SPACE = 1 << 18
SELECTED = 2048
PAIRED = 1024  # most frequent buckets whose pairs are counted, beside as many that tell the labels apart alone
SURE, PAIR_SURE = 2.5, 4.5  # standard errors of the bounds: a pair is one of millions
FACTORS = 4
SAMPLE = 12_000
RAMP = 4.0
THRESHOLD = 0.7
MEMO = 300_000


def term_buckets(word: str) -> list[int]:
    """Buckets of a word, of its first four and of its first five characters."""
    terms = {"w" + word, "4" + word[:4], "5" + word[:5]} if len(word) > 3 else {"w" + word}
    return [xxhash.xxh3_64_intdigest(t) & (SPACE - 1) for t in terms]


def distinct_words(raw: bytes, most: int = 1 << 20) -> set[bytes]:
    """Distinct lower-case words of a text; a long text is taken in parts, cut between words."""
    if len(raw) <= most:
        return set(raw.translate(ALNUM).split())
    words, at = set(), 0
    while at < len(raw):
        end = min(at + most, len(raw))
        while end < len(raw) and ALNUM[raw[end]] != 32:
            end += 1
        words.update(raw[at:end].translate(ALNUM).split())
        at = end
    return words


class Machine:
    """The trained model: chosen buckets with their weights and factors."""

    def __init__(self, chosen: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray):
        self.chosen, self.bias, self.w, self.v = chosen, bias, w, v
        self.slot = {int(b): k for k, b in enumerate(chosen)}
        self._memo: dict[bytes, tuple[int, ...]] = {}

    def slots(self, words: set[bytes]) -> np.ndarray:
        """Active terms of a document, as places among the chosen buckets."""
        memo, found = self._memo, set()
        for w in words:
            got = memo.get(w)
            if got is None:
                if len(memo) >= MEMO:
                    memo.clear()
                got = memo[w] = tuple(self.slot[b] for b in term_buckets(w.decode("utf-8", "replace")) if b in self.slot)
            if got:
                found.update(got)
        return np.array(sorted(found), np.int64)

    def score(self, active: list[np.ndarray]) -> np.ndarray:
        margin, _, _ = _margins(self.bias, self.w, self.v, active)
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _margins(bias, w, v, active):
    sizes = np.array([len(a) for a in active])
    out = np.full(len(active), bias)
    if not sizes.sum():
        return out, sizes, None
    flat, doc = np.concatenate(active), np.repeat(np.arange(len(active)), sizes)
    x = 4 / np.sqrt(RAMP + sizes)
    sums = np.zeros((len(active), v.shape[1]))
    squares = np.zeros(len(active))
    np.add.at(sums, doc, v[flat])
    np.add.at(squares, doc, (v[flat] ** 2).sum(1))
    out += np.bincount(doc, w[flat], len(active)) * x + 0.5 * ((sums**2).sum(1) - squares) * x * x
    return out, sizes, sums


def _bounds(toxic: np.ndarray, total: np.ndarray, z: float) -> tuple[np.ndarray, np.ndarray]:
    """Wilson bounds of the share toxic / total."""
    total = np.maximum(total, 1)
    middle, half = (toxic + z * z / 2) / (total + z * z), z * np.sqrt(toxic * (total - toxic) / total + z * z / 4) / (total + z * z)
    return middle - half, middle + half


def _pair_gain(active: list[np.ndarray], y: np.ndarray, upper: np.ndarray, base: float) -> np.ndarray:
    """For each of len(upper) terms the best gain of a pair it is in: the lower bound of the pair's share of label 1 over
    the base share, where it is above the upper bounds of both terms alone; else 0."""
    k = len(upper)
    both, toxic = np.zeros((k, k), np.float32), np.zeros((k, k), np.float32)
    for at in range(0, len(active), 1024):
        part = active[at : at + 1024]
        x = np.zeros((len(part), k), np.float32)
        x[np.repeat(np.arange(len(part)), [len(p) for p in part]), np.concatenate([np.zeros(0, np.int64), *part])] = 1
        both += x.T @ x
        own = x[y[at : at + 1024] == 1]
        toxic += own.T @ own
    best = np.zeros(k)
    for i in range(k):
        low, _ = _bounds(toxic[i].astype(float), both[i].astype(float), PAIR_SURE)
        low[i] = 0
        best[i] = max(0.0, np.where(low > np.maximum(upper, upper[i]), low / base - 1, 0).max())
    return best


def _chosen(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The buckets that get weights and factors."""
    toxic, total = np.zeros(SPACE), np.zeros(SPACE, np.int64)
    for r, label in zip(rows, y.tolist(), strict=True):  # the buckets of a document are distinct
        total[r] += 1
        toxic[r] += label
    base = y.mean()
    low, high = _bounds(toxic, total, SURE)
    gain = np.maximum(low / base - 1.25, np.where(total >= 30, 0.5 - high / base, 0))
    gain[total < 2] = 0
    alone = np.argsort(-gain, kind="stable")[: min(PAIRED, int((gain > 0).sum()))]
    frequent = np.where((gain > 0) | (total > len(rows) / 2) | (total < 5), 0, total)
    common = np.argsort(-frequent, kind="stable")[: min(PAIRED, int((frequent > 0).sum()))]
    terms = np.sort(np.concatenate((alone, common)))
    place = np.full(SPACE, -1)
    place[terms] = np.arange(len(terms))
    active = [np.unique(p[p >= 0]) for p in (place[r] for r in rows)]
    alone = np.argsort(-gain, kind="stable")[: min(SELECTED, int((gain > 0).sum()))]
    pair = np.zeros(SPACE)
    pair[terms] = _pair_gain(active, y, high[terms], base)
    pair[alone] = 0
    paired = np.argsort(-pair, kind="stable")[: min(PAIRED // 4, int((pair > 0).sum()))]
    return np.sort(np.concatenate((alone, paired)))


def fit(rows: list[np.ndarray], y: np.ndarray, epochs: int = 40, batch: int = 256, rate: float = 0.15, decay: float = 1e-4, seed: int = 11) -> Machine:
    """rows: the buckets of each training document. Without both labels the score is the share of label 1."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Machine(np.zeros(0, np.int64), bias, np.zeros(0), np.zeros((0, FACTORS)))
    chosen = _chosen(rows, y)
    place = np.full(SPACE, -1)
    place[chosen] = np.arange(len(chosen))
    active = [np.unique(p[p >= 0]) for p in (place[r] for r in rows)]
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(chosen)), rng.normal(0, 0.05, (len(chosen), FACTORS))
    gw, gv, gb = np.full(len(chosen), 1e-8), np.full(v.shape, 1e-8), 1e-8
    for _ in range(epochs):
        order = rng.permutation(len(active))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            part = [active[k] for k in own]
            margin, sizes, sums = _margins(bias, w, v, part)
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[own]) / len(own)
            gb += error.sum() ** 2
            bias -= rate * error.sum() / np.sqrt(gb)
            if sums is None:
                continue
            ids, d = np.concatenate(part), np.repeat(np.arange(len(part)), sizes)
            x = 4 / np.sqrt(RAMP + sizes)
            dw = np.bincount(ids, error[d] * x[d], len(w)) + decay * w
            dv = np.zeros_like(v)
            np.add.at(dv, ids, (error * x * x)[d][:, None] * (sums[d] - v[ids]))
            dv += decay * v
            gw += dw * dw
            gv += dv * dv
            w -= rate * dw / np.sqrt(gw)
            v -= rate * dv / np.sqrt(gv)
    return Machine(chosen, float(bias), w, v)


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, sample: int = SAMPLE) -> Machine:
    """Learns from labelled documents outside the held-out fold: the `sample` labels whose ids have the smallest hashes.

    A label that is null is left out; of repeated labels of one id the largest counts, and of repeated documents the one
    with the least list of terms. The drawn documents' terms go to one executor task, which trains and returns the model.
    """
    ship(docs.sparkSession)
    docs = id_and_text(docs)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    known = known.filter(fold_of(F.col("doc_id"), folds) != held_out).groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.first(F.xxhash64("doc_id")).alias("h"))
    # Twice the hashes that are wanted on average, of which the smallest are taken: few rows are sorted at any scale.
    share = min(1.0, 2 * sample / max(known.count(), 1))
    drawn = known.filter(F.col("h") <= F.lit(-(1 << 63) + min((1 << 64) - 1, int(share * (1 << 64))))).orderBy("h", "doc_id").limit(sample)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.unique(np.array([b for w in distinct_words(raw) for b in term_buckets(w.decode("utf-8", "replace"))], np.int32)) for raw in raw_texts(batch.column(2))]
            offsets = pa.array(spans_of(np.array([len(r) for r in rows], int)), pa.int32())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(rows)))], ["doc_id", "toxic", "terms"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, y = [], []
        for batch in batches:
            terms = batch.column(1)
            flat, offsets = terms.values.to_numpy(), terms.offsets.to_numpy()
            rows += [flat[a:b].copy() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            y.append(batch.column(0).to_numpy() > 0)
        m = fit(rows, np.concatenate([np.zeros(0, bool), *y]).astype(np.int64))
        yield pa.record_batch([pa.array([x], t) for x, t in ((m.chosen.tolist(), pa.list_(pa.int64())), (m.bias, pa.float64()), (m.w.tolist(), pa.list_(pa.float64())), (m.v.ravel().tolist(), pa.list_(pa.float64())))], ["chosen", "bias", "w", "v"])

    # The drawn labels are `sample` rows at most, so they can be broadcast whatever the corpus.
    seen = docs.join(F.broadcast(drawn.select("doc_id", "toxic")), "doc_id").select("doc_id", "toxic", "text").mapInArrow(tidy(read), "doc_id long, toxic int, terms array<int>")
    seen = seen.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("terms").alias("terms"))
    seen = seen.repartition(1).sortWithinPartitions("doc_id").select("toxic", "terms")
    found = seen.mapInArrow(tidy(learn), "chosen array<long>, bias double, w array<double>, v array<double>").toArrow().to_pylist()
    model = found[0] if found else {"chosen": [], "bias": 0.0, "w": [], "v": []}
    return Machine(np.array(model["chosen"], np.int64), model["bias"], np.array(model["w"], float), np.array(model["v"], float).reshape(-1, FACTORS))


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold) of every whole text.

    A null or empty text has no term: its score follows the bias alone. A null doc_id is not held out. Repeated rows are
    scored alike; an empty table gives no rows; with no labels at all every score is 0.5.
    """
    docs = private(docs)
    machine = train(docs, labels, folds, held_out, sample)
    shared = docs.sparkSession.sparkContext.broadcast((machine.chosen, machine.bias, machine.w, machine.v))  # SELECTED terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(*shared.value)
        for batch in batches:
            score = machine.score([machine.slots(distinct_words(raw)) for raw in raw_texts(batch.column(2))])
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    docs = id_and_text(docs)
    return docs.select("doc_id", (fold_of(F.col("doc_id"), folds) == held_out).alias("held_out"), "text").mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the documents whose score reaches the threshold, with all their columns; see toxicity_scores()."""
    docs = private(docs)
    machine = train(docs, labels, sample=sample)
    shared = docs.sparkSession.sparkContext.broadcast((machine.chosen, machine.bias, machine.w, machine.v))
    column = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(*shared.value)
        for batch in batches:
            score = machine.score([machine.slots(distinct_words(raw)) for raw in raw_texts(batch.column(column))])
            yield batch.filter(pa.array(score < threshold))

    return docs.mapInArrow(tidy(run), docs.schema)
