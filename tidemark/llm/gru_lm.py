"""Language-model scores: a gated recurrent network in numpy with a class-factored output softmax.

P(token | past) = P(class | state) * P(token | class, state). The HEAD most frequent tokens of the corpus share CLASSES
classes of equal size, each with a softmax of its own; every other token is in the tail class, where its share follows
the corpus counts. Counts, N and V come from all training documents, and so do the recurrent weights: every training
document goes by a hash of its id and text to one of the shards, of SHARD_TOKENS tokens on average, and to one of ROUNDS
rounds. In a round each shard's task starts from the weights so far and learns from its documents of that round by
truncated backpropagation; the results are averaged by tokens, in two steps of bounded size. So every token is learned
from once, the work is spread whatever the corpus, and nothing depends on how the table is partitioned. A document is
scored in windows, and the state goes from one window to the next, so the score covers the complete text.
"""

from __future__ import annotations

import copy
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from .common import fold_of, id_and_text, pieces, raw_texts, spans_of, stored, tidy, word_lists

STATE = 16
CLASSES = 32
IN_CLASS = 32
HEAD = CLASSES * IN_CLASS
BUCKETS = 1024  # input rows shared by tokens outside the head
KNOWN = 200_000  # most frequent tokens whose counts every worker holds
ROUNDS = 3
SHARD_TOKENS = 2_000_000
SCORED_TOKENS = 4_000_000  # scored together, about
TAIL = CLASSES  # the class after the last
COUNTER_LIMIT = 400_000
END = ""  # no word is empty, so this key is free for the end


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, c) over all whole texts of docs, one end for each document. Workers count first, in bounded counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            texts = raw_texts(batch.column(0))
            seen[b""] += len(texts)
            for raw in texts:
                for words in word_lists(raw):
                    seen.update(words)
                if len(seen) > COUNTER_LIMIT:
                    yield from _count_rows(seen)
                    seen = Counter()
        yield from _count_rows(seen)

    return docs.select("text").mapInArrow(tidy(run), "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


def _count_rows(seen: Counter) -> Iterator[pa.RecordBatch]:
    keys, values = list(seen), list(seen.values())
    for k in range(0, len(keys), 50_000):
        yield pa.record_batch([pa.array(keys[k : k + 50_000], pa.binary()).cast(pa.string()), pa.array(values[k : k + 50_000], pa.int64())], ["token", "c"])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.minimum(x, x.dtype.type(30), out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _row_sums(x: np.ndarray) -> np.ndarray:
    return x @ np.ones(x.shape[1], x.dtype)  # a product: rows are too short for sums along them


class Model:
    """Weights: x (input rows of the three gates), u (state to gates), wc, bc (classes), wi, bi (within each class)."""

    def __init__(self, head_counts: np.ndarray, tail_mass: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        full = np.full(HEAD, 1e-3)
        full[: len(head_counts)] = head_counts + 0.5
        within = full.reshape(CLASSES, IN_CLASS)
        share = np.append(within.sum(1), max(tail_mass, 0.5))
        self.p = {
            "x": rng.normal(0, 0.3, (HEAD + BUCKETS, 3 * STATE)),
            "u": rng.normal(0, 0.2, (STATE, 3 * STATE)),
            "wc": rng.normal(0, 0.05, (STATE, CLASSES + 1)),
            "bc": np.log(share / share.sum()),
            "wi": rng.normal(0, 0.05, (CLASSES, STATE, IN_CLASS)),
            "bi": np.log(within / within.sum(1, keepdims=True)),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def step(self, ids: np.ndarray, h: np.ndarray) -> tuple:
        return tuple(v.T for v in self._gates(self.p["x"].take(ids, axis=0).T, h.T))

    def _gates(self, a: np.ndarray, h: np.ndarray) -> tuple:
        """A step from input rows a and states h, both in columns: so each gate is one block of memory."""
        g = self.p["u"].T @ h
        gn = g[2 * STATE :]
        zr = _sigmoid(g[: 2 * STATE] + a[: 2 * STATE])
        z, r = zr[:STATE], zr[STATE:]
        n = r * gn
        n += a[2 * STATE :]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return new, z, r, gn, n

    def _output(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the classes and within them, each with its bias as the last row, for states that end in a one."""
        p = self.p
        return np.concatenate((p["wc"], p["bc"][None])), np.concatenate((p["wi"], p["bi"][:, None]), 1)

    def _shares(self, hs: np.ndarray, target: np.ndarray, outer: np.ndarray, within: np.ndarray) -> tuple:
        """For states that end in a one: the class of each target; exponentials over the classes and the target's logit; rows
        with a head target sorted by class, bounds of the classes among them, their states, exponentials within the class and
        the target's logit there."""
        cls = np.minimum(target // IN_CLASS, TAIL).astype(np.int16)  # 16 bits are sorted by radix
        e = hs @ outer
        own = e[np.arange(len(e)), cls]
        np.exp(e, out=e)
        bounds = np.concatenate(([0], np.cumsum(np.bincount(cls, minlength=CLASSES + 1)[:CLASSES])))
        rows = np.argsort(cls, kind="stable")[: bounds[-1]]
        sorted_hs = hs.take(rows, axis=0)
        inner = np.empty((len(rows), IN_CLASS), hs.dtype)
        for c, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            if a < b:
                np.matmul(sorted_hs[a:b], within[c], out=inner[a:b])
        own_inner = inner[np.arange(len(rows)), target[rows] % IN_CLASS]
        np.exp(inner, out=inner)
        return cls, e, own, rows, bounds, sorted_hs, inner, own_inner

    def log_probs(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log of P(class) * P(token in class) for head targets, of P(tail class) for others (HEAD or more)."""
        return self._log_probs(np.concatenate((h, np.ones((len(h), 1), h.dtype)), 1), target, *self._output())

    def _log_probs(self, hs: np.ndarray, target: np.ndarray, outer: np.ndarray, within: np.ndarray) -> np.ndarray:
        _, e, out, rows, _, _, inner, own_inner = self._shares(hs, target, outer, within)
        out -= np.log(_row_sums(e))
        out[rows] += own_inner - np.log(_row_sums(inner))
        return out

    def train(self, sequences: list[np.ndarray], streams: int | None = None, window: int = 16, rate: float = 0.01, first: int = 0) -> int:
        """Truncated backpropagation over `window` tokens in parallel streams; the state outlives the window, the gradient
        doesn't. Every token of every sequence is a target once. Returns their number. Weights move by Adam, input rows when
        they occur. More streams make wider products, and a stream should be long beside its window, so there are as many
        as leave each 2,048 tokens, 8 at least and 256 at most. first: the input before the first token."""
        # A document follows another in its stream; a stream's first input is the token before it, the end for the first.
        line = np.concatenate([np.zeros(0, np.int64), *sequences])
        if not len(line):
            return 0
        streams = streams or max(8, min(256, len(line) // 2048))
        streams = min(streams, len(line))
        ends = np.arange(1, streams + 1) * len(line) // streams  # streams differ by one token at most
        starts = np.concatenate(([0], ends[:-1]))
        place = starts + np.arange((ends - starts).max())[:, None]
        held = place < ends
        targets = line[np.minimum(place, len(line) - 1)]
        inputs = np.concatenate(([first], line))[np.minimum(place, len(line) - 1)]
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        t, h = 0, np.zeros((streams, STATE), np.float32)
        for at in range(0, len(place), window):
            grads, rows, h = self._gradients(inputs[at : at + window], targets[at : at + window], h, held[at : at + window])
            t += 1
            step = rate / (1 + t / 400) * math.sqrt(1 - 0.99**t) / (1 - 0.9**t)
            for k, g in grads.items():
                m, v = (x[rows] if k == "x" else x for x in moments[k])
                np.clip(g, -1, 1, out=g)
                move = g - m
                move *= 0.1
                m += move
                g *= g
                g -= v
                g *= 0.01
                v += g
                np.sqrt(v, out=move)
                move += 1e-7
                np.divide(m, move, out=move)
                move *= step
                if k == "x":
                    moments[k][0][rows], moments[k][1][rows] = m, v
                    self.p[k][rows] -= move
                else:
                    self.p[k] -= move
        return len(line)

    def _gradients(self, inputs: np.ndarray, targets: np.ndarray, h: np.ndarray, held: np.ndarray | None = None) -> tuple[dict, np.ndarray, np.ndarray]:
        """Gradients of the mean loss over the targets that are held (all, unless told otherwise), that of "x" for the rows
        returned beside them; and the last state. What the recurrence doesn't need is done for all steps at once."""
        n_steps, n = inputs.shape
        kind = self.p["u"].dtype
        flat = inputs.ravel().astype(np.int16)
        a = np.ascontiguousarray(self.p["x"].take(flat, axis=0).reshape(n_steps, n, 3 * STATE).transpose(0, 2, 1))
        all_h, gates = np.empty((n_steps + 1, STATE, n), kind), np.empty((4, n_steps, STATE, n), kind)
        all_h[0] = h.T
        for t in range(n_steps):
            all_h[t + 1], *gates[:, t] = self._gates(a[t], all_h[t])
        z, r, gn, cand = gates
        before = all_h[:-1]
        held = np.ones(n_steps * n, bool) if held is None else held.ravel()
        scale = (held / np.float32(max(1, held.sum()))).astype(np.float32)[:, None]
        hs = np.ones((n_steps, n, STATE + 1), kind)
        hs[:, :, :STATE] = all_h[1:].transpose(0, 2, 1)
        hs = hs.reshape(-1, STATE + 1)
        target = targets.ravel()
        outer, within = self._output()
        cls, e, _, rows, bounds, sorted_hs, inner, _ = self._shares(hs, target, outer, within)
        e *= scale / _row_sums(e)[:, None]
        e[np.arange(len(e)), cls] -= scale[:, 0]
        dh_out = e @ outer[:STATE].T
        of_outer = hs.T @ e
        own_scale = scale[rows]
        inner *= own_scale / _row_sums(inner)[:, None]
        inner[np.arange(len(rows)), target[rows] % IN_CLASS] -= own_scale[:, 0]
        of_within, back = np.zeros_like(within), np.empty((len(rows), STATE), kind)
        for c, (i, j) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            if i < j:
                np.matmul(sorted_hs[i:j].T, inner[i:j], out=of_within[c])
                np.matmul(inner[i:j], within[c, :STATE].T, out=back[i:j])
        dh_out[rows] += back
        dh_out = np.ascontiguousarray(dh_out.reshape(n_steps, n, STATE).transpose(0, 2, 1))
        # A state's gradient times `per` is that of the step's sums from the state; `of_cand`: of the candidate's sum.
        per, of_cand = np.empty((n_steps, 3, STATE, n), kind), (1 - z) * (1 - cand * cand)
        per[:, 0] = (before - cand) * z * (1 - z)
        np.multiply(of_cand, r, out=per[:, 2])
        per[:, 1] = per[:, 2] * gn * (1 - r)
        dh, u = np.zeros((STATE, n), kind), self.p["u"]
        for t in range(n_steps - 1, -1, -1):
            dh_out[t] += dh
            per[t] *= dh_out[t]
            dh = u @ per[t].reshape(3 * STATE, n)
            dh += dh_out[t] * z[t]
        of_cand *= dh_out
        out_of = per.reshape(n_steps, 3 * STATE, n)
        g = {"wc": of_outer[:STATE], "bc": of_outer[STATE], "wi": of_within[:, :STATE], "bi": of_within[:, STATE]}
        g["u"] = (before @ out_of.transpose(0, 2, 1)).sum(0)
        per[:, 2] = of_cand
        into = np.ascontiguousarray(out_of.transpose(0, 2, 1)).reshape(-1, 3 * STATE).view(np.result_type(kind, np.complex64))  # two sums in one
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
        g["x"] = np.add.reduceat(into.take(order, axis=0), first, axis=0).view(kind)
        return g, flat[first].astype(np.int64), np.ascontiguousarray(all_h[-1].T)

    def score(self, sequences: list[np.ndarray], first: int, budget: int = 32_768) -> np.ndarray:
        """Summed natural log probability of each sequence, which follows the token `first`; the state is carried on
        from window to window, and a window holds about `budget` tokens of all sequences still running."""
        lengths = np.array([len(s) for s in sequences])
        order = np.argsort(-lengths, kind="stable")
        falling = -lengths[order]
        offsets = spans_of(lengths)[:-1][order]
        line = np.concatenate(sequences) if len(sequences) else np.zeros(0, int)
        total = np.zeros(len(sequences))
        running = len(sequences)
        weights, x = self._output(), self.p["x"]
        hs = np.ones((budget + running, STATE + 1), x.dtype)
        targets = np.empty(budget + running, np.int64)
        h, ids, at = np.zeros((STATE, running), x.dtype), np.full(running, first), offsets.copy()
        t = 0
        while running:
            owners, held = [], 0
            while held < budget:
                if falling[running - 1] >= -t:
                    running = int(np.searchsorted(falling[:running], -t))
                    if not running:
                        break
                    h, ids, at = h[:, :running].copy(), ids[:running], at[:running]
                h = self._gates(np.ascontiguousarray(x.take(ids, axis=0).T), h)[0]
                ids = targets[held : held + running] = line.take(at)
                hs[held : held + running, :STATE] = h.T
                owners.append(running)
                held += running
                at += 1
                t += 1
            if held:
                logp = self._log_probs(hs[:held], targets[:held], *weights)
                done = 0
                for n in owners:
                    total[:n] += logp[done : done + n]
                    done += n
        out = np.empty(len(sequences))
        out[order] = total
        return out


def _most_frequent(counts: DataFrame, most: int = KNOWN) -> pa.Table:
    """The most frequent tokens, `most` at most, by falling count. A histogram of counts with steps of 4 % (some hundred rows)
    says from which count on; of the step that no longer fits whole, tokens are taken by their hash."""
    step = F.floor(F.log2("c") * 16)
    held, least, share = 0, None, 0.0
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.step):
        least, share = r.step, min(1.0, (most - held) / r.n)
        held += r.n
        if held >= most:
            break
    if least is None:
        return pa.table({"token": pa.array([], pa.string()), "c": pa.array([], pa.int64())})
    drawn = F.xxhash64("token") < F.lit(-(1 << 63) + min((1 << 64) - 1, int(share * (1 << 64)))) if share < 1 else F.lit(True)
    rows = counts.filter((step > least) | ((step == least) & drawn)).select("token", "c").toArrow()
    return rows.sort_by([("c", "descending"), ("token", "ascending")]).slice(0, most)


class _Known(dict):
    """Token -> rank by count; a token outside gets KNOWN plus its input bucket."""

    def __missing__(self, word: bytes) -> int:
        return KNOWN + xxhash.xxh3_64_intdigest(word) % BUCKETS


def _model_ids(ranks: np.ndarray) -> np.ndarray:
    """Input rows: the rank itself in the head, else one of the shared rows."""
    return np.where(ranks < HEAD, ranks, HEAD + (ranks - HEAD) % BUCKETS)


_ENCODED = "doc_id long, held_out boolean, h long, n_tokens long, n_known long, log_c double, log_c_tail double, n_tail long, ids binary, tail array<struct<token: string, n: long>>"


def _encoded(docs: DataFrame, shared: Broadcast, end: int) -> DataFrame:
    """Rows of _ENCODED from (doc_id, held_out, h, text). Of all tokens with the end: input rows as 16-bit numbers, and for those
    known, sums of log10(c + 0.5); log_c_tail is the part outside the head, whose tokens are n_tail. tail: counts of the others.
    shared: known tokens and by rank log10(c + 0.5), 0 for others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, log_c = shared.value
        lookup, n_known = known.__getitem__, len(known)
        for batch in batches:
            for part in pieces(batch, 8 << 20, 3):
                ranks_of, sizes, tails = [], [], []
                for raw in raw_texts(part.column(3)):
                    size, tail = 1, Counter()
                    for words in word_lists(raw):
                        ranks = np.fromiter(map(lookup, words), np.int32, len(words))
                        ranks_of.append(ranks)
                        size += len(words)
                        tail.update([words[k] for k in np.flatnonzero(ranks >= n_known).tolist()])
                    ranks_of.append(np.array([end], np.int32))
                    sizes.append(size)
                    tails.append(tail)
                flat, ends = np.concatenate(ranks_of), spans_of(np.array(sizes))
                starts, value = ends[:-1], log_c[flat]
                inside, in_tail = flat < n_known, flat >= HEAD
                ids = _model_ids(flat).astype("<u2").tobytes()
                words = pa.array([w for x in tails for w in x], pa.binary()).cast(pa.string())
                times = pa.array([c for x in tails for c in x.values()], pa.int64())
                columns = {
                    "n_tokens": pa.array(sizes, pa.int64()),
                    "n_known": pa.array(np.add.reduceat(inside, starts, dtype=np.int64)),
                    "log_c": pa.array(np.add.reduceat(value, starts)),
                    "log_c_tail": pa.array(np.add.reduceat(np.where(in_tail, value, 0.0), starts)),
                    "n_tail": pa.array(np.add.reduceat(in_tail | ~inside, starts, dtype=np.int64)),
                    "ids": pa.array([ids[2 * a : 2 * b] for a, b in zip(starts.tolist(), ends[1:].tolist(), strict=True)], pa.binary()),
                    "tail": pa.ListArray.from_arrays(pa.array(spans_of(np.array([len(x) for x in tails])), pa.int32()), pa.StructArray.from_arrays([words, times], ["token", "n"])),
                }
                yield pa.record_batch([*(part.column(k) for k in range(3)), *columns.values()], ["doc_id", "held_out", "h", *columns])

    return docs.mapInArrow(tidy(run), _ENCODED)


def _ids_of(column: pa.Array) -> Iterator[np.ndarray]:
    return (np.frombuffer(x, "<u2") for x in column.to_pylist())


def _together(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Batches with an n_tokens column in tables of about `most` tokens: steps over few long texts are shared by more texts."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += pc.sum(batch.column("n_tokens")).as_py() or 0
        if size >= most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


_WEIGHTS = "place int, n long, weights binary"


def _averaged(rows: DataFrame, shards: int) -> DataFrame:
    """One row of _WEIGHTS, the mean by n, summed in two steps of about sqrt(shards) rows each, in the order of places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, n, total = 0, 0, None
        for batch in batches:
            for p, k, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(w, np.float64) * k
                place, n, total = p, n + k, own if total is None else total + own
        if n:
            yield pa.record_batch([pa.array([place], pa.int32()), pa.array([n], pa.int64()), pa.array([(total / n).tobytes()], pa.binary())], ["place", "n", "weights"])

    groups = math.isqrt(shards) + 1
    some = rows.withColumn("g", F.pmod("place", F.lit(groups))).repartition(groups, "g").sortWithinPartitions("place").drop("g")
    return some.mapInArrow(tidy(run), _WEIGHTS).repartition(1).sortWithinPartitions("place").mapInArrow(tidy(run), _WEIGHTS)


def _train(encoded: DataFrame, model: Model, shards: int, first: int) -> None:
    """Sets the model's weights to what all rows of `encoded` outside the held-out fold teach; see the module's text."""
    context, names = encoded.sparkSession.sparkContext, sorted(model.p)
    flat = lambda p: np.concatenate([p[k].ravel() for k in names]).astype(np.float64).tobytes()

    def filled(model: Model, weights: bytes) -> Model:
        values, at = np.frombuffer(weights, np.float64), 0
        for k in names:
            model.p[k] = values[at : at + model.p[k].size].reshape(model.p[k].shape).astype(np.float32)
            at += model.p[k].size
        return model

    rows = encoded.filter("not held_out").select(F.pmod("h", F.lit(shards)).cast("int").alias("shard"), F.pmod(F.shiftright("h", 40), F.lit(ROUNDS)).alias("round"), "h", "ids")
    for r in range(ROUNDS):
        shared = context.broadcast(model)

        def learn(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            def row() -> pa.RecordBatch:
                return pa.record_batch([pa.array([shard], pa.int32()), pa.array([n], pa.int64()), pa.array([flat(own.p)], pa.binary())], ["place", "n", "weights"])

            start, shard, own, n, held, size = flat(shared.value.p), None, None, 0, [], 0
            for batch in batches:
                for k, ids in zip(batch.column(0).to_pylist(), _ids_of(batch.column(1)), strict=True):
                    if k != shard or size > SHARD_TOKENS:  # a crowded shard is learned in parts
                        if held:
                            n += own.train(held, first=first)
                            held, size = [], 0
                        if k != shard:
                            if shard is not None:
                                yield row()
                            shard, own, n = k, filled(copy.deepcopy(shared.value), start), 0
                    held.append(ids)
                    size += len(ids)
            if shard is not None:
                n += own.train(held, first=first)
                yield row()

        dealt = rows.filter(F.col("round") == r).repartition(shards, "shard").sortWithinPartitions("shard", "h").select("shard", "ids")
        found = _averaged(dealt.mapInArrow(tidy(learn), _WEIGHTS), shards).toArrow()
        if found.num_rows:
            filled(model, found.column("weights")[0].as_py())
        shared.unpersist()


def lm_scores(docs: DataFrame, folds: int = 5, held_out: int = 1, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Scores of all whole texts, learned from the documents outside the held-out fold.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10). A null text is empty: one
    token, the end. A null doc_id trains and keeps its row. Repeated rows count as often as they stand there. Without
    training documents every token is unseen. An empty table gives no rows; columns of other names play no part. Tokens
    beyond the KNOWN most frequent are joined with their counts, so nothing that grows with the corpus is broadcast or
    collected.
    """
    docs = id_and_text(docs)
    spark = docs.sparkSession
    fold = fold_of(F.col("doc_id"), folds) == held_out
    counts = stored(token_counts(docs.filter(~fold)), "lm-counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_tokens, n_distinct = int(total.n), int(total.v)
    mass = n_tokens + 0.5 * (n_distinct + 1)
    top = _most_frequent(counts)
    known = _Known((w.encode(), k) for k, w in enumerate(top.column("token").to_pylist()))
    known_c = top.column("c").to_numpy().astype(np.float64)
    log_c = np.concatenate((np.log10(known_c + 0.5), np.zeros(KNOWN - len(known_c) + BUCKETS)))  # others' are joined later
    end = known.get(b"", KNOWN)
    tail_mass = mass - (known_c[:HEAD] + 0.5).sum()
    words = spark.sparkContext.broadcast((known, log_c))  # KNOWN tokens at most
    source = docs.select("doc_id", fold.alias("held_out"), F.xxhash64("doc_id", "text").alias("h"), "text")
    encoded = stored(_encoded(source, words, end).withColumn("row", F.monotonically_increasing_id()), "lm-encoded")
    model = Model(known_c[:HEAD], tail_mass)
    first = int(_model_ids(np.array([end]))[0])
    _train(encoded, model, max(1, -(-n_tokens // shard_tokens)), first)
    log_mass, log_tail = np.log10(mass), np.log10(max(tail_mass, 0.5))
    shared = spark.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _together(batches, SCORED_TOKENS):
            n, base, in_tail, n_tail = (table.column(k).to_numpy() for k in ("n_tokens", "log_c", "log_c_tail", "n_tail"))
            score = shared.value.score(list(_ids_of(table.column("ids"))), first) / np.log(10) + in_tail - n_tail * log_tail
            own = table.select(["doc_id", "held_out", "row", "n_tokens", "n_known"])
            yield from own.append_column("base_score", pa.array(base - n * log_mass)).append_column("score", pa.array(score)).combine_chunks().to_batches()

    scored = encoded.drop("h", "tail").mapInArrow(tidy(run), "doc_id long, held_out boolean, row long, n_tokens long, n_known long, base_score double, score double")
    tail = encoded.select("row", F.inline("tail")).join(counts.hint("merge"), "token", "left")
    tail = tail.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("log_c"), F.sum(F.when(F.col("c").isNotNull(), F.col("n"))).alias("more"))
    more, log_sum = F.coalesce("more", F.lit(0)), F.coalesce("log_c", F.lit(0.0))
    return scored.join(tail, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + more).alias("n_known"), F.lit(n_tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + log_sum).alias("base_score"), (F.col("score") + log_sum).alias("score"),
    )
