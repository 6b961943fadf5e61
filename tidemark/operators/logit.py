"""Logistic regressions over tables, for many resamples of clusters at once.

A resample is a vector of multiplicities, one for each cluster. A Newton step needs the score and the information of every
resample at its own coefficients: each task works through its rows in blocks, for all resamples together, and passes on one row
of sums for each group; those are added up and the small systems solved. So a step is one job over the rows whatever the
number of resamples, rows are never copied or collected, and what is broadcast is resamples times clusters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.functions.stats import chi2_tail_even, interval, joint_p, normal_p, sandwich

from . import resample

# Where Newton starts (0, 1, 0, …), how many steps it may take, its last step, and what counts as running away.
STEPS, SETTLED, RUNAWAY = 100, 1e-10, 50.0
SINGULAR = 1e-12  # a determinant of that share of its terms is their rounding error
BLOCK = 1024  # rows times resamples that a task holds at once


def terms(k: int) -> int:
    """Numbers in a score and the upper triangle of an information of k coefficients."""
    return k + k * (k + 1) // 2


def sums_of(x: np.ndarray, y: np.ndarray, weight: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """(resamples, terms): scores and informations over rows x, y, of which resample d counts row i weight[d, i] times."""
    k = x.shape[1]
    upper = np.triu_indices(k)
    pairs = x[:, upper[0]] * x[:, upper[1]]
    out = np.zeros((len(beta), terms(k)))
    for at in range(0, len(x), BLOCK):
        part = slice(at, at + BLOCK)
        chance = 0.5 * (1 + np.tanh(0.5 * (beta @ x[part].T)))
        w = weight[:, part]
        out[:, :k] += (w * (y[part] - chance)) @ x[part]
        out[:, k:] += (w * chance * (1 - chance)) @ pairs[part]
    return out


@dataclass
class Resamples:
    """Multiplicities of each group's clusters, the first resample being the sample itself."""

    times: dict[int, np.ndarray] = field(default_factory=dict)
    numbers: DataFrame | None = None

    @classmethod
    def of(cls, rows: DataFrame, by: str, cluster: str, draws: int, seed: int, stratum: str | None = None) -> Resamples:
        """Clusters are resampled within their stratum, each as often as it has clusters; a cluster is in one stratum."""
        of = F.lit(0) if stratum is None else F.col(stratum).cast("int")
        held = rows.groupBy(by, cluster).agg(F.min(of).alias("stratum"), F.max(of).alias("other"))  # a row a cluster of each group
        numbered = resample.numbered_clusters(held, [by], cluster).select(by, cluster, "stratum", "other", "number")
        found: dict[int, list[tuple[int, int]]] = {}
        for r in numbered.orderBy(by, "number").collect():
            if r["stratum"] != r["other"]:
                raise ValueError("a cluster spans both strata")
            found.setdefault(r[by], []).append((r["number"], r["stratum"]))
        times = {}
        for group, clusters in found.items():
            out = np.ones((draws + 1, len(clusters)))
            for s in sorted({s for _, s in clusters}):
                own = [n for n, of in clusters if of == s]
                out[1:, own] = resample.multiplicities(len(own), draws, seed + 7919 * s)
            times[group] = out
        return cls(times, numbered.drop("stratum", "other"))


def step_sums(rows: DataFrame, by: str, x: list[str], y: str, resamples: Resamples, betas: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(by, place, value): for each group the sums of the resamples in betas, (their numbers, their coefficients), flattened."""
    shared = rows.sparkSession.sparkContext.broadcast({g: (resamples.times[g][which], beta) for g, (which, beta) in betas.items()})
    size = terms(len(x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            group, number, target = (batch.column(k).to_numpy() for k in range(3))
            design = np.stack([batch.column(k).to_numpy() for k in range(3, 3 + len(x))], axis=1)
            for g in np.unique(group).tolist():
                if g in shared.value:
                    own = group == g
                    times, beta = shared.value[g]
                    found = sums_of(design[own], target[own], times[:, number[own]], beta)
                    out[g] = out[g] + found if g in out else found
        if out:
            yield pa.record_batch([pa.array(list(out), pa.int32()), pa.array([v.ravel().tolist() for v in out.values()], pa.list_(pa.float64()))], [by, "sums"])

    parts = rows.select(F.col(by).cast("int"), "number", F.col(y).cast("double"), *(F.col(c).cast("double") for c in x)).mapInArrow(run, f"{by} int, sums array<double>")
    flat = parts.select(by, F.posexplode("sums").alias("place", "value"))
    return flat.groupBy(by, "place").agg(F.sum("value").alias("value")).withColumn("draw", F.expr(f"place div {size}")).withColumn("term", F.col("place") % size)


def _unpacked(sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    information = np.zeros((k, k))
    information[np.triu_indices(k)] = sums[k:]
    return sums[:k], information + np.triu(information, 1).T


def fit(rows: DataFrame, by: str, x: list[str], y: str, resamples: Resamples) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """(coefficients by resample, NaN where there is no finite solution; the sample's information) for each group.

    rows has the groups (integers), the cluster's `number`, and doubles without nulls; an empty table gives empty results.
    """
    k = len(x)
    rows = rows.persist()
    beta = {g: np.tile(np.eye(k)[1] if k > 1 else np.zeros(1), (len(t), 1)) for g, t in resamples.times.items()}
    live = {g: np.arange(len(t)) for g, t in resamples.times.items()}
    known: dict[int, np.ndarray] = {}
    for _ in range(STEPS):
        live = {g: which for g, which in live.items() if len(which)}
        if not live:
            break
        sums = {g: np.zeros((len(which), terms(k))) for g, which in live.items()}
        for r in step_sums(rows, by, x, y, resamples, {g: (which, beta[g][which]) for g, which in live.items()}).collect():  # groups x resamples x terms
            sums[r[by]][r["draw"], r["term"]] = r["value"]
        for g, which in live.items():
            left = []
            for at, d in enumerate(which.tolist()):
                score, information = _unpacked(sums[g][at], k)
                if d == 0:
                    known[g] = information
                try:
                    step = np.linalg.solve(information, score)
                except np.linalg.LinAlgError:
                    step = np.full(k, np.inf)
                beta[g][d] += step
                if not np.abs(beta[g][d]).max() <= RUNAWAY:
                    beta[g][d] = np.nan
                elif np.abs(step).max() >= SETTLED:
                    left.append(d)
            live[g] = np.array(left, int)
    for g, which in live.items():  # not settled
        beta[g][which] = np.nan
    rows.unpersist()
    return beta, known


def fixed_steps(rows: DataFrame, by: str, z: str, y: str, steps: int) -> dict[int, tuple[float, float]]:
    """Intercept and slope of y on z after exactly `steps` Newton steps from 0 and 1 for each group, settled, running away or
    neither; NaN from a step on whose information is singular, because forecasts of one value bear all of it. What rounding leaves
    of such a determinant depends on the order of the sums. A step is one job, which returns a row of sums a group."""
    rows = rows.select(by, F.col(z).cast("double").alias("z"), F.col(y).cast("double").alias("y")).persist()
    beta = {r[by]: (0.0, 1.0) for r in rows.select(by).distinct().collect()}
    c = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("a") + F.col("b") * F.col("z"))))
    rest, spread = F.col("y") - F.col("c"), F.col("c") * (1 - F.col("c"))
    sums = (rest, F.col("z") * rest, spread, F.col("z") * F.col("c") * (1 - F.col("c")), F.col("z") * F.col("z") * F.col("c") * (1 - F.col("c")))
    for _ in range(steps if beta else 0):
        table = rows.sparkSession.createDataFrame([(g, *b) for g, b in beta.items()], f"{by} int, a double, b double")
        chances = rows.join(F.broadcast(table), by).withColumn("c", c)
        for r in chances.groupBy(by).agg(*(F.sum(s).alias(f"t{k}") for k, s in enumerate(sums))).collect():
            s0, s1, i0, i1, i2 = (np.float64(r[f"t{k}"]) for k in range(5))
            determinant = i0 * i2 - i1 * i1
            with np.errstate(all="ignore"):
                determinant = determinant if determinant > SINGULAR * i0 * i2 else np.nan
                beta[r[by]] = float(beta[r[by]][0] + (i2 * s0 - i1 * s1) / determinant), float(beta[r[by]][1] + (i0 * s1 - i1 * s0) / determinant)
    rows.unpersist()
    return beta


def cluster_scores(rows: DataFrame, by: str, x: list[str], y: str, beta: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """The score sums of each group's clusters at the given coefficients, a row a cluster."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(g, *map(float, b)) for g, b in beta.items()], f"{by} int, " + ", ".join(f"beta{j} double" for j in range(len(x))))
    margin = sum((F.col(f"beta{j}") * F.col(c) for j, c in enumerate(x)), F.lit(0.0))
    rest = F.col(y) - 1 / (1 + F.exp(-margin))
    found: dict[int, list[list[float]]] = {}
    per = rows.join(F.broadcast(table), by).groupBy(by, "number").agg(*(F.sum(F.col(c) * rest).alias(f"s{j}") for j, c in enumerate(x)))
    for r in per.orderBy(by, "number").collect():  # a row a cluster of each group
        found.setdefault(r[by], []).append([r[f"s{j}"] for j in range(len(x))])
    return {g: np.array(v) for g, v in found.items()}


def _numbered(rows: DataFrame, by: str, cluster: str, resamples: Resamples) -> DataFrame:
    return rows.join(resamples.numbers, [by, cluster])


def _spread(draws: np.ndarray, names: list[str]) -> dict[str, float | None]:
    ends = {}
    for j, name in enumerate(names):
        low, high = interval(draws[:, j])
        ends |= {f"{name}_low": low, f"{name}_high": high}
    return ends


CALIBRATION = "a double, b double, se_a double, se_b double, p_a double, p_b double, p_joint double, a_low double, a_high double, b_low double, b_high double, joint_p double, boot_ok double"


def calibration(rows: DataFrame, by: str, cluster: str, draws: int = resample.DRAWS, seed: int = resample.SEED) -> DataFrame:
    """(by, CALIBRATION) of the outcome y on the forecast's log odds z, for each group: coefficients, clustered errors, p-values
    of intercept 0 and slope 1, alone and together (chi-square), intervals and a joint p over resampled clusters, and the
    share of resamples that could be fitted. A group without a finite fit, or of one cluster, has nulls; draws that
    have none are left out of the intervals."""
    rows = rows.select(by, cluster, F.col("y").cast("double").alias("y"), F.lit(1.0).alias("one"), F.col("z").cast("double").alias("z"))
    resamples = Resamples.of(rows, by, cluster, draws, seed)
    numbered = _numbered(rows, by, cluster, resamples)
    beta, information = fit(numbered, by, ["one", "z"], "y", resamples)
    fitted = {g: b[0] for g, b in beta.items() if np.isfinite(b[0]).all() and resamples.times[g].shape[1] > 1}
    scores = cluster_scores(numbered, by, ["one", "z"], "y", fitted) if fitted else {}
    names, out = [c.split()[0] for c in CALIBRATION.split(", ")], []
    for g, b in beta.items():
        found = dict.fromkeys(names)
        if g in fitted:
            clusters, off = len(scores[g]), b[0] - np.array([0.0, 1.0])
            cov = sandwich(np.linalg.inv(information[g]), scores[g], clusters / (clusters - 1))
            error = np.sqrt(np.diag(cov))
            held = b[1:][np.isfinite(b[1:]).all(axis=1)]
            p = [normal_p(d / e) if e > 0 else None for d, e in zip(off, error, strict=True)]
            chi = chi2_tail_even(float(off @ np.linalg.pinv(cov) @ off), 2)
            found |= dict(zip(names[:7], (*b[0], *error, *p, chi), strict=True)) | _spread(held, ["a", "b"]) | {"joint_p": joint_p(held, b[0], np.array([0.0, 1.0])), "boot_ok": len(held) / max(draws, 1)}
        out.append((g, *(None if found[n] is None else float(found[n]) for n in names)))
    return rows.sparkSession.createDataFrame(sorted(out), f"{by} int, {CALIBRATION}")


REGIMES = "d_a double, d_b double, a_low double, a_high double, b_low double, b_high double, joint_p double"


def regimes(rows: DataFrame, by: str, cluster: str, draws: int = resample.DRAWS, seed: int = resample.SEED) -> DataFrame:
    """(by, REGIMES): whether intercept and slope differ after a change, the column `after` (0 or 1). Clusters are resampled
    within their regime; one with rows in both raises an error."""
    z, after = F.col("z").cast("double"), F.col("after").cast("double")
    rows = rows.select(by, cluster, F.col("after").cast("int").alias("regime"), F.col("y").cast("double").alias("y"), F.lit(1.0).alias("one"), z.alias("z"), after.alias("after"), (after * z).alias("az"))
    resamples = Resamples.of(rows, by, cluster, draws, seed, "regime")
    beta, _ = fit(_numbered(rows, by, cluster, resamples), by, ["one", "z", "after", "az"], "y", resamples)
    names, out = [c.split()[0] for c in REGIMES.split(", ")], []
    for g, b in beta.items():
        found = dict.fromkeys(names)
        if np.isfinite(b[0]).all():
            held = b[1:][np.isfinite(b[1:]).all(axis=1)][:, 2:]
            found |= {"d_a": b[0, 2], "d_b": b[0, 3], **_spread(held, ["a", "b"]), "joint_p": joint_p(held, b[0, 2:], np.zeros(2))}
        out.append((g, *(None if found[n] is None else float(found[n]) for n in names)))
    return rows.sparkSession.createDataFrame(sorted(out), f"{by} int, {REGIMES}")
