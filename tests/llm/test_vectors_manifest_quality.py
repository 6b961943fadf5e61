"""Centroid clustering, the Merkle manifest and quality rules against brute force, on hard rows."""

import collections
import hashlib
import math
import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import DATA, by_row, docs, expected, frame, rows  # noqa: F401
from tidemark.llm import centroids, merkle, quality

VECTORS = "vec_id long, embedding array<float>, label int, q string, cluster string, m long"
LEAVES = "doc_id long, text string, lang string, source string, n_chars long, tree string, node string, at int, proof string"


def hard_vectors():
    rnd = random.Random(5)
    float32 = lambda x: float(np.float32(x))
    base = [[float32(rnd.gauss(0, 0.2)) for _ in range(64)] for _ in range(40)]
    vectors = [(i, v) for i, v in enumerate(base)] + [(100 + i, [x + 1e-5 for x in base[0]]) for i in range(30)]
    vectors += [(200, [0.0] * 64), (201, [-0.0] * 64), (202, [-1e-30] * 64), (203, [float("nan")] + [0.0] * 63), (204, [float("inf")] + [0.0] * 63), (205, [None] + [0.0] * 63)]
    vectors += [(206, None), (207, []), (208, [0.0] * 63), (209, [0.0] * 65), (None, base[3]), (3, base[3]), (7, base[8]), (210, [float32(1e30)] + [0.0] * 63)]
    return [(i, None if v is None else [None if x is None else float32(x) for x in v]) for i, v in vectors]


def plain_clusters(vectors, k=16, rounds=3):
    """The same clustering in whole numbers of Python, vector by vector."""
    kept = [(i, tuple(max(-(1 << 27), min(1 << 27, math.floor(64 * x))) for x in v)) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    cents = [v for _, v in sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)][:k]
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    assign = lambda: [min((away(v, c), n) for n, c in enumerate(cents)) for _, v in kept]
    for _ in range(rounds):
        members = collections.defaultdict(list)
        for (_, v), (_, n) in zip(kept, assign(), strict=True):
            members[n].append(v)
        cents = [tuple(sum(x) // len(members[n]) for x in zip(*members[n], strict=True)) if n in members else c for n, c in enumerate(cents)]
    found = assign()
    inertia = collections.Counter()
    for d, n in found:
        inertia[n] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted([(i, n, d, inertia[n], sum(inertia.values()), digest[n]) for (i, _), (d, n) in zip(kept, found, strict=True)], key=repr)


def vector_frame(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "x", "y", 2) for i, v in vectors], VECTORS)


NAMES = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@pytest.mark.parametrize("hot", [centroids.HOT, 20])
def test_clusters_equal_plain_lloyd(spark, monkeypatch, hot):
    monkeypatch.setattr(centroids, "HOT", hot)  # with 20 the group of 30 copies takes the broadcast way
    monkeypatch.setattr(centroids, "ROWS", 7)
    vectors = hard_vectors()
    got = centroids.cluster_vectors(vector_frame(spark, vectors).repartition(3)).collect()
    assert by_row(got, *NAMES) == plain_clusters(vectors)


def test_clusters_of_few_or_no_vectors(spark):
    few = [(1, [0.5] * 64), (2, [0.5] * 64), (None, [-3.0] * 64)]
    assert by_row(centroids.cluster_vectors(vector_frame(spark, few)).collect(), *NAMES) == plain_clusters(few)
    for nothing in ([], [(1, None), (2, [1.0])], [(None, [1.0] * 64)]):
        found = centroids.cluster_vectors(vector_frame(spark, nothing))
        assert found.columns == list(NAMES) and found.count() == 0
    short = centroids.cluster_vectors(spark.createDataFrame([(1, [0.5, 2.0]), (2, [9.0, 9.0])], "vec_id long, embedding array<double>"), k=1, rounds=1, dim=2, scale=2).collect()
    assert sorted((r.vec_id, r.cluster, r.distance) for r in short) == [(1, 0, 113), (2, 0, 130)]  # the mean of (1, 4) and (18, 18) is (9, 11)


def plain_manifest(leaves, fanout=8):
    """Per row (doc_id, leaf, subroot, root, proof digest, folded root, verified), each path walked by itself."""
    h = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: h(*(field(r[c]) for c in ("doc_id", "source", "lang", "n_chars")), field(text))
    lower = lambda t: t if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][k : k + fanout]) for k in range(0, len(levels[-1]), fanout)])
        return levels

    def walk(levels, at, node):
        proof = []
        for nodes in levels[:-1]:
            run = nodes[at - at % fanout :][:fanout]
            proof += run[: at % fanout] + run[at % fanout + 1 :]
            node = h(*run[: at % fanout], node, *run[at % fanout + 1 :])
            at //= fanout
        return node, proof

    groups = collections.defaultdict(list)
    for r in leaves:
        groups[r["lang"]].append(r)
    langs = sorted(groups, key=lambda v: (v is not None, (v or "").encode()))
    ordered = {v: sorted(groups[v], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]))) for v in langs}
    trees = {v: tree([leaf(r, r["text"]) for r in ordered[v]]) for v in langs}
    top, out = tree([trees[v][-1][0] for v in langs]), []
    for k, v in enumerate(langs):
        for at, r in enumerate(ordered[v]):
            own, hit = leaf(r, r["text"]), r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            sub, low = walk(trees[v], at, leaf(r, lower(r["text"])) if hit else own)
            folded, high = walk(top, k, sub)
            out.append((r["doc_id"], own, trees[v][-1][0], top[-1][0], h(*low, *high), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def leaf_rows(n, langs, seed=1):
    rnd = random.Random(seed)
    texts = [None, "", "Ü Ñ", "Mixed Case", "lower", "x" * 3000]
    return [dict(doc_id=rnd.choice([None, rnd.randrange(n), 10**17 + k]), source=rnd.choice([None, "s1", "é"]), lang=rnd.choice(langs), n_chars=rnd.choice([None, 0, 5]), text=rnd.choice(texts), tree="t", node="n", at=1, proof="p") for k in range(n)]


MANIFEST = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("n, langs, levels", [(0, ["en"], 2), (1, ["en"], 2), (1, [None], 4), (8, ["en"], 1), (9, ["en"], 2), (700, ["en", "en", "en", None, "", "-", "é"], 1), (300, [f"l{k}" for k in range(90)], 2)])
def test_manifest_equals_plain_paths(spark, n, langs, levels):
    leaves = leaf_rows(n, langs)
    got = merkle.tamper_report(spark.createDataFrame([tuple(r.values()) for r in leaves], "doc_id long, source string, lang string, n_chars long, text string, tree string, node string, at int, proof string").repartition(3), levels=levels)
    assert by_row(got.collect(), *MANIFEST) == plain_manifest(leaves)


def test_manifest_with_one_hot_row(spark):
    """A third of all rows the same in every column: each copy is a leaf of its own, and copies spread over the parts."""
    leaves = [dict(doc_id=5, source="s", lang="en", n_chars=1, text="Copy")] * 300 + [dict(doc_id=k, source="s", lang="en", n_chars=1, text=f"T{k}") for k in range(600)]
    table = spark.createDataFrame([tuple(r.values()) for r in leaves], "doc_id long, source string, lang string, n_chars long, text string").repartition(4)
    assert by_row(merkle.tamper_report(table, levels=2).collect(), *MANIFEST) == plain_manifest(leaves)


def test_manifest_proofs_verify_leaf_by_leaf(spark):
    leaves = leaf_rows(100, ["de", "en", None], 3)
    found = merkle.manifest(spark.createDataFrame([tuple(r.values())[:5] for r in leaves], "doc_id long, source string, lang string, n_chars long, text string"), levels=1).collect()
    for r in found:
        subroot, rest = merkle.fold(r.leaf, r.proof, r.at, r.n)
        assert subroot == r.subroot and merkle.fold(subroot, rest, r.tree_at, r.trees) == (r.root, "")
        assert merkle.fold(merkle.digest(r.leaf), r.proof, r.at, r.n)[0] != r.subroot
    assert {r.lang for r in found} == {"de", "en", None}


def plain_counts(text):
    raw = text.encode()
    w = raw.split()
    lines, seen, dup = [x for x in raw.split(b"\n") if x.strip()], set(), 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    n_repeat = len(inside)
    return len(w), sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"), dup, n_repeat, len(w) < 10 or 100 * n_repeat > 20 * len(w)


def rule_rows(rows):  # noqa: F811
    more = ["a b c d e f\na b c d e f\n\n a b c d e f\r\n x", "# $ % & | < > *\n" * 9, "aaaa " * 40, "one two three four five six one two three four five", "\x0b\x0c\x1c\n\x85 x", "L\n" * 30 + "é é é é é " * 3]
    return [*rows, *((5000 + k, t) for k, t in enumerate(more))]


@pytest.mark.parametrize("block", [None, 16])
def test_quality_counts_equal_brute_force(spark, rows, monkeypatch, block):  # noqa: F811
    if block:  # every text in parts of a few words or lines
        monkeypatch.setattr(quality._blocks, "__defaults__", (block,))
    table = rule_rows(rows)
    for _, t in table:
        counts, _ = quality.statistics((t or "").encode())
        assert (*counts, bool(quality.failed(np.array([counts]))[0])) == plain_counts(t or ""), t


def test_quality_report_on_hard_rows(spark, rows):  # noqa: F811
    table = rule_rows(rows)
    labels = spark.createDataFrame([(1, 0), (20, 1), (20, 0), (21, 1), (None, 1), (22, None), (99999, 1), (3, 1)], "doc_id long, quality int")
    got = quality.quality_report(frame(spark, table), labels).collect()
    assert by_row(got, "doc_id", *quality.COUNTS, "base_failed") == expected(table, plain_counts)
    assert all(0 <= r.score <= 1 and r.kept == (not r.base_failed and r.score >= quality.THRESHOLD) for r in got)
    nothing = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.quality_report(frame(spark, table), nothing).collect()} == {0.5}
    assert quality.quality_report(frame(spark, []), labels).count() == 0


def walked(forest, x):
    """A score by following one tree after the other."""
    total = forest.bias
    for feature, threshold, value in zip(forest.feature, forest.threshold, forest.value, strict=True):
        at = 0
        while at < len(feature):
            at = 2 * at + (2 if x[feature[at]] > threshold[at] else 1)
        total += value[at - len(feature)]
    return total


def toy(n=3000, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)).round(2)
    y = ((np.sin(3 * x[:, 0]) - x[:, 1] + 0.8 * x[:, 2] * (x[:, 3] > 0) + rng.normal(0, 0.3, n)) > 0).astype(float)
    return x, y


def test_flat_trees_equal_walked_trees():
    x, y = toy()
    forest = quality.fit(x, y, [0, -1, 0, 0], trees=30)
    assert np.allclose(forest.margin(x[:200]), [walked(forest, r) for r in x[:200]])
    assert ((forest.score(x) > 0.5) == (y > 0)).mean() > 0.85


def test_every_boosting_step_lowers_the_loss():
    x, y = toy()
    losses = []
    for trees in (1, 5, 20, 60):
        p = quality.fit(x, y, [0, 0, 0, 0], trees=trees).score(x)
        losses.append(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())
    assert losses == sorted(losses, reverse=True) and losses[-1] < 0.3


@pytest.mark.parametrize("sign", [-1, 1])
def test_signed_statistics_are_monotonic(sign):
    x, y = toy()
    signs = [0, -1, sign, 0]
    forest = quality.fit(x, y, signs, trees=40)
    for k in (1, 2):
        grid = np.repeat(x[:300, None, :], 60, axis=1)
        grid[:, :, k] = np.linspace(-4, 4, 60)
        steps = np.diff(forest.margin(grid.reshape(-1, 4)).reshape(300, 60), axis=1) * signs[k]
        assert steps.min() >= -1e-9
    free = quality.fit(x, y, [0, 0, 0, 0], trees=40).margin(grid.reshape(-1, 4)).reshape(300, 60)
    assert (np.diff(free, axis=1).min() < -1e-6) and (np.diff(free, axis=1).max() > 1e-6)


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the supplied tables")
def test_quality_of_documents_not_learned_from(spark):
    folder = DATA.replace("sf0.001", "sf0.1")
    table, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    report = quality.quality_report(table.join(labels, "doc_id").select("doc_id", "text"), labels.filter(~out)).join(labels.filter(out), "doc_id").toPandas()
    left = report[~report.base_failed]
    assert len(left) > 1000 and (left.kept == (left.quality == 1)).mean() > 0.97
    assert left[left.quality == 1].kept.mean() > 0.99
