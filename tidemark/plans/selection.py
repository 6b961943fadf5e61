"""Model evaluation over the meetings' panel: expanding windows, out-of-sample scores, ablations and verdicts.

Every linear fit here needs nothing of its training rows but the sums of products of (1, features, target). They are added up
once for each meeting and for the first later meeting at which they may be known, and cumulated over meetings; a fold's fit is
then a small solve and no row is copied into later folds. A product counts as a whole number of 1e-9, so sums are the same in
any order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import domain as D
from tidemark.operators import resample

from .adapters import Views
from .meetings import FEATURES, GROUPS, HORIZONS, SIGNS, TABLE, USES, Meetings
from .panels import R
from .registry import query

# What is tried and how verdicts are reached.
LEAST_MEETINGS, TUNED = 8, 3
ALPHAS = tuple(10.0**k for k in range(-2, 6))
FREE = "gap"  # never shrunk
P_CUT, STABLE = 0.05, 0.9
UNIT = 1e9
Z = ["one", *FEATURES, "y"]
PAIRS = [(i, j) for i in range(len(Z)) for j in range(i, len(Z))]
SUMS = [f"g{k}" for k in range(len(PAIRS))]
SPECS = {"all": FEATURES} | {f"without {g}": [f for f in FEATURES if GROUPS[f] != g] for g in dict.fromkeys(GROUPS.values())} | {f"without {f}": [x for x in FEATURES if x != f] for f in FEATURES}
MODELS = ["none", "ar1", *SPECS]


def horizon_rows(m: Meetings) -> DataFrame:
    """(h, event, day, due, one, FEATURES, y): the rows whose features and target are known, for each horizon. Kept for the
    steps that read them again: a row a meeting, day and horizon, whatever the tables behind."""
    each = F.explode(F.array(*(F.struct(F.lit(h).alias("h"), F.col(f"target_{h}").alias("y"), F.col(f"date_{h}").alias("due")) for h in HORIZONS))).alias("t")
    return m.features.select("event", "day", F.lit(1.0).alias("one"), *FEATURES, each).select("t.*", "event", "day", "one", *FEATURES).na.drop().persist()


def packed(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, sums): the values of (by, place, value) in the order of places."""
    return rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda s: s["value"]).alias("sums"))


def added(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, sums): arrays of sums added place by place."""
    return packed(rows.select(*by, F.posexplode("sums").alias("place", "value")).groupBy(*by, "place").agg(F.sum("value").alias("value")), by)


def product_sums(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, sums): sums of all products of (1, FEATURES, y), in units of 1e-9, as one array."""
    products = F.array(*(F.round(F.col(Z[i]) * F.col(Z[j]) * UNIT).cast("long") for i, j in PAIRS))
    return added(rows.select(*by, products.alias("sums")), by)


def spread_out(rows: DataFrame, *others: str) -> DataFrame:
    """The sums as columns SUMS."""
    return rows.select(*others, *(F.get("sums", F.lit(k)).alias(g) for k, g in enumerate(SUMS)))


def folds_of(rows: DataFrame) -> DataFrame:
    """(h, event, start): every meeting with its first day; where a later meeting starts earlier, that day, so that what is
    known at a meeting is known at all later ones."""
    first = rows.groupBy("h", "event").agg(F.min("day").alias("first"))
    later = Window.partitionBy("h").orderBy("event").rowsBetween(0, Window.unboundedFollowing)  # a row a meeting
    return first.withColumn("start", F.min("first").over(later))


def known_sums(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """(h, event, known, sums): sums of each meeting's rows by the first later meeting that starts after their targets' days."""
    listing = folds.groupBy("h").agg(F.collect_list(F.struct("event", "start")).alias("folds"))  # a meeting each
    after = F.array_min(F.transform(F.filter("folds", lambda f: (f["event"] > F.col("event")) & (f["start"] > F.col("due"))), lambda f: f["event"]))
    return product_sums(rows.join(F.broadcast(listing), "h").withColumn("known", after).filter("known is not null"), ["h", "event", "known"])


def prefix_sums(cells: DataFrame, folds: DataFrame) -> DataFrame:
    """(h, event, sums): for every meeting the sums over all rows that were known when it started."""
    new = added(cells.select("h", F.col("known").alias("event"), "sums"), ["h", "event"])
    nothing = F.array_repeat(F.lit(0).cast("long"), len(PAIRS))
    rows = folds.select("h", "event").join(new, ["h", "event"], "left").select("h", "event", F.posexplode(F.coalesce("sums", nothing)).alias("place", "value"))
    upto = Window.partitionBy("h", "place").orderBy("event").rowsBetween(Window.unboundedPreceding, 0)  # a row a meeting
    return packed(rows.withColumn("value", F.sum("value").over(upto)), ["h", "event"])


def windows(rows: DataFrame) -> DataFrame:
    """(h, event, train, inner, tune): product sums of each fold's training rows, of those known before its last TUNED
    training meetings, and of these meetings' own; folds with fewer than LEAST_MEETINGS training meetings are left out."""
    folds = folds_of(rows)
    cells = known_sums(rows, folds).persist()  # a row or two a meeting
    prefix = prefix_sums(cells, folds).persist()  # a row a meeting
    entered = cells.groupBy("h", "event").agg(F.min("known").alias("known")).groupBy("h").agg(F.sort_array(F.collect_list(F.struct("event", "known"))).alias("entered"))
    trained = F.transform(F.filter("entered", lambda e: e["known"] <= F.col("event")), lambda e: e["event"])
    fold = folds.select("h", "event").join(F.broadcast(entered), "h").withColumn("trained", trained).filter(F.size("trained") >= LEAST_MEETINGS)
    fold = fold.select("h", "event", F.slice("trained", -TUNED, TUNED).alias("last"))
    tune = fold.select("h", F.col("event").alias("fold"), F.explode("last").alias("event")).join(cells, ["h", "event"]).filter(F.col("known") <= F.col("fold"))
    tune = added(tune.select("h", F.col("fold").alias("event"), "sums"), ["h", "event"]).withColumnRenamed("sums", "tune")
    out = fold.select("h", "event", F.get("last", F.lit(0)).alias("tuned")).join(prefix.withColumnRenamed("sums", "train"), ["h", "event"]).join(tune, ["h", "event"])
    return out.join(prefix.withColumnsRenamed({"event": "tuned", "sums": "inner"}), ["h", "tuned"]).select("h", "event", "train", "inner", "tune")


def gram(sums: np.ndarray) -> np.ndarray:
    """The symmetric matrix of products from its upper triangle."""
    g = np.zeros((len(Z), len(Z)))
    for value, (i, j) in zip(np.asarray(sums, float) / UNIT, PAIRS, strict=True):
        g[i, j] = g[j, i] = value
    return g


def ridge(g: np.ndarray, names: list[str], alpha: float) -> np.ndarray:
    """(intercept, coefficient of every feature) of a ridge on features scaled by the rows of g; FREE isn't penalised, nor is
    the intercept. Coefficients are of the unscaled features, 0 for those not in names."""
    at, n, y = [Z.index(f) for f in names], g[0, 0], len(Z) - 1
    mean, level = g[0, at] / n, g[0, y] / n
    spread = g[np.ix_(at, at)] - n * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(spread), 0) / max(n - 1, 1))
    scale[scale < 1e-9] = 1.0
    penalty = np.diag([0.0 if f == FREE else alpha for f in names])
    slopes = np.linalg.lstsq(spread / np.outer(scale, scale) + penalty, (g[at, y] - n * mean * level) / scale, rcond=None)[0] / scale
    out = np.zeros(len(Z) - 1)
    out[0], out[at] = level - mean @ slopes, slopes
    return out


def squared_error(g: np.ndarray, beta: np.ndarray) -> float:
    """Of a fit over the rows of g."""
    c = np.append(beta, -1.0)
    return float(c @ g @ c)


def tuned(train: np.ndarray, inner: np.ndarray, tune: np.ndarray, names: list[str]) -> tuple[np.ndarray, float]:
    """The ridge whose alpha predicts the tuning rows best from the inner ones, refit on all training rows; the smallest alpha
    where there is nothing to tune on."""
    errors = [squared_error(tune, ridge(inner, names, a)) for a in ALPHAS] if inner[0, 0] > 1 else [0.0]
    alpha = ALPHAS[int(np.argmin(errors))]
    return ridge(train, names, alpha), alpha


def fits(folds: DataFrame) -> DataFrame:
    """(h, event, model, alpha, beta) of every model for each fold."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                train, inner, tune = gram(r.train), gram(r.inner), gram(r.tune)
                out.append((r.h, r.event, "none", None, [0.0] * (len(Z) - 1)))
                out.append((r.h, r.event, "ar1", None, ridge(train, [FREE], 0.0).tolist()))
                for name, names in SPECS.items():
                    beta, alpha = tuned(train, inner, tune, names)
                    out.append((r.h, r.event, name, alpha, beta.tolist()))
            yield pd.DataFrame(out, columns=["h", "event", "model", "alpha", "beta"])

    return folds.mapInPandas(run, "h int, event long, model string, alpha double, beta array<double>")


def predictions(m: Meetings) -> DataFrame:
    """(h, event, day, model, alpha, actual, pred) of every test row and model, kept for the steps that read it again: a row a
    meeting, day, horizon and model."""
    rows = horizon_rows(m)
    z = F.array(*Z[:-1])
    pred = F.aggregate(F.zip_with(z, "beta", lambda x, b: x * b), F.lit(0.0), lambda s, x: s + x)
    return rows.join(fits(windows(rows)), ["h", "event"]).select("h", "event", "day", "model", "alpha", F.col("y").alias("actual"), pred.alias("pred")).persist()


@query("gram_prefix", "M-11 M-12 A-20", f"""WITH {TABLE}, hr AS ({" UNION ALL ".join(f"SELECT {h} AS h, event, day, date_{h} AS due, 1.0::DOUBLE AS one, {', '.join(FEATURES)}, target_{h} AS y FROM feats WHERE target_{h} IS NOT NULL AND gap_chg_5 IS NOT NULL" for h in HORIZONS)}),
  fo AS (SELECT h, event, min(day) AS first FROM hr GROUP BY h, event)
  SELECT fo.h, fo.event, count(*) AS n, {", ".join(f"CAST((sum(CAST(round({Z[i]} * {Z[j]} * {UNIT}) AS BIGINT)) + 500) // 1000 AS BIGINT) AS {g}" for g, (i, j) in zip(SUMS, PAIRS, strict=True))}
  FROM fo JOIN hr ON hr.h = fo.h AND hr.event < fo.event AND hr.due < fo.first GROUP BY fo.h, fo.event""", USES)
def gram_prefix(v: Views) -> DataFrame:
    """What each fold's models are fitted from, in units of 1e-6. The SQL adds up every fold's rows anew."""
    rows = horizon_rows(Meetings.of(v))
    folds = folds_of(rows)
    found = spread_out(prefix_sums(known_sums(rows, folds), folds), "h", "event").filter("g0 > 0")
    return found.select("h", "event", F.round(F.col("g0") / UNIT).cast("long").alias("n"), *(F.expr(f"({g} + 500) div 1000").alias(g) for g in SUMS))


@query("expanding_window", "M-12 M-11 M-10")
def expanding_window(v: Views) -> DataFrame:
    return predictions(Meetings.of(v)).withColumn("day", F.col("day").cast("string"))


def squared_errors(preds: DataFrame) -> DataFrame:
    """(h, event, a column of summed squared errors for each model), a row for each test meeting."""
    error = (F.col("actual") - F.col("pred")) ** 2
    return preds.groupBy("h", "event").pivot("model", MODELS).agg(F.sum(error))


def nested_gains(preds: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(h, small, big, t, p): Clark-West of each bigger model against the smaller one nested in it, clustered by meeting."""
    wide = preds.groupBy("h", "event", "day", "actual").pivot("model", sorted({x for p in pairs for x in p})).agg(F.first("pred"))
    small, big = (lambda p: F.col(f"`{p[0]}`")), (lambda p: F.col(f"`{p[1]}`"))
    gain = lambda p: (F.col("actual") - small(p)) ** 2 - ((F.col("actual") - big(p)) ** 2 - (small(p) - big(p)) ** 2)
    each = F.explode(F.array(*(F.struct(F.lit(p[0]).alias("small"), F.lit(p[1]).alias("big"), gain(p).alias("f")) for p in pairs))).alias("g")
    per = wide.select("h", "event", each).groupBy("h", "event", "g.small", "g.big").agg(F.sum("g.f").alias("s"), F.count("*").alias("c"))
    mean = per.groupBy("h", "small", "big").agg((F.sum("s") / F.sum("c")).alias("mean"), F.sum("c").alias("n"))
    rest = per.join(mean, ["h", "small", "big"]).groupBy("h", "small", "big").agg(F.first("mean").alias("mean"), (F.sqrt(F.sum((F.col("s") - F.col("c") * F.col("mean")) ** 2)) / F.first("n")).alias("se"))
    t = F.when(F.col("se") > 0, F.col("mean") / F.col("se"))
    return rest.select("h", "small", "big", t.alias("t"), D.one_sided_p(t).alias("p"))


def scores(preds: DataFrame, models: list[str]) -> DataFrame:
    """(h, model, n, events, hits, r2_none, none_low, none_high, r2_ar1, ar1_low, ar1_high) with intervals over resampled meetings."""
    sse = squared_errors(preds)
    total = sse.groupBy("h").agg(F.count("*").alias("events"), *(F.sum(f"`{c}`").alias(c) for c in MODELS))
    draws = resample.draw_totals(sse, ["h"], "event", MODELS)
    against = lambda model, base: 1 - F.try_divide(F.col(f"`{model}`"), F.col(base))
    parts = lambda df: F.explode(F.array(*(F.struct(F.lit(c).alias("model"), against(c, "none").alias("r2_none"), against(c, "ar1").alias("r2_ar1")) for c in models))).alias("m")
    point = total.select("h", "events", parts(total)).select("h", "events", "m.*")
    spread = draws.select("h", parts(draws)).select("h", "m.*").groupBy("h", "model")
    spread = spread.agg(*(c.alias(f"{name}_{end}") for name, of in (("none", "r2_none"), ("ar1", "r2_ar1")) for end, c in zip(("low", "high"), resample.interval(of), strict=True)))
    hits = preds.filter(F.col("model").isin(models)).groupBy("h", "model").agg(F.count("*").alias("n"), F.avg(F.when(F.col("actual") != 0, (F.signum("pred") == F.signum("actual")).cast("int"))).alias("hits"))
    return point.join(spread, ["h", "model"]).join(hits, ["h", "model"])


_AR1 = f"""{TABLE}, hr AS ({" UNION ALL ".join(f"SELECT {h} AS h, event, day, date_{h} AS due, gap, target_{h} AS y FROM feats WHERE target_{h} IS NOT NULL AND gap_chg_5 IS NOT NULL" for h in HORIZONS)}),
  fo AS (SELECT h, event, min(day) AS first FROM hr GROUP BY h, event),
  ft AS (SELECT fo.h, fo.event, regr_slope(y, gap) AS b, regr_intercept(y, gap) AS a FROM fo JOIN hr ON hr.h = fo.h AND hr.event < fo.event AND hr.due < fo.first GROUP BY fo.h, fo.event HAVING count(DISTINCT hr.event) >= {LEAST_MEETINGS}),
  pr AS (SELECT hr.h, hr.event, y, a + b * gap AS pred FROM hr JOIN ft ON ft.h = hr.h AND ft.event = hr.event),
  se AS (SELECT h, event, sum(y * y) AS e0, sum(pow(y - pred, 2)) AS e1, sum(y * y - (pow(y - pred, 2) - pred * pred)) AS s, count(*) AS c, count(*) FILTER (WHERE sign(pred) = sign(y) AND y <> 0) AS hit, count(*) FILTER (WHERE y <> 0) AS moved FROM pr GROUP BY h, event)"""


@query("oos_ar1", "M-13 M-14 M-12 X-11", f"""WITH {_AR1}, dr AS {resample.draw_totals_sql("se", "h", "event", ["e0", "e1"])},
  q AS (SELECT h, quantile_cont(1 - e1 / e0, 0.025) AS low, quantile_cont(1 - e1 / e0, 0.975) AS high FROM dr GROUP BY h),
  mn AS (SELECT h, count(*) AS events, CAST(sum(c) AS BIGINT) AS n, sum(s) / sum(c) AS mean, 1 - sum(e1) / sum(e0) AS r2, sum(hit) / sum(moved) AS hits FROM se GROUP BY h),
  cw AS (SELECT h, any_value(mean) / (sqrt(sum(pow(s - c * mean, 2))) / any_value(n)) AS t FROM se JOIN mn USING (h) GROUP BY h)
  SELECT h, events, n, round(r2, 5) AS r2, round(low, 5) AS low, round(high, 5) AS high, round(hits, 5) AS hits, round(t, 4) AS t, round({D.erfc_sql("t / sqrt(2)")} / 2, 6) AS p FROM mn JOIN q USING (h) JOIN cw USING (h)""", USES)
def oos_ar1(v: Views) -> DataFrame:
    """Mean reversion against no change, out of sample: the part of oos_r2 that SQL can say, draws included."""
    preds = predictions(Meetings.of(v))
    found = scores(preds, ["ar1"]).join(nested_gains(preds, [("none", "ar1")]).select("h", "t", "p"), "h")
    return found.select("h", "events", "n", R("r2_none", 5).alias("r2"), R("none_low", 5).alias("low"), R("none_high", 5).alias("high"), R("hits", 5).alias("hits"), R("t", 4).alias("t"), R("p").alias("p"))


@query("oos_r2", "M-13 M-14")
def oos_r2(v: Views) -> DataFrame:
    """Mean reversion against no change, and the full ridge against mean reversion, each with intervals, hits and Clark-West."""
    preds = predictions(Meetings.of(v))
    tests = nested_gains(preds, [("none", "ar1"), ("ar1", "all")]).select("h", F.col("big").alias("model"), "t", "p")
    return scores(preds, ["ar1", "all"]).join(tests, ["h", "model"])


def drop_losses(preds: DataFrame, names: list[str]) -> DataFrame:
    """(h, dropped, loss, low, high, t, p): what leaving a group or a feature out costs, in units of the AR(1)'s error."""
    sse = squared_errors(preds)
    columns = ["ar1", "all", *(f"without {x}" for x in names)]
    loss = lambda x: F.try_divide(F.col(f"`without {x}`") - F.col("`all`"), F.col("ar1"))
    each = F.explode(F.array(*(F.struct(F.lit(x).alias("dropped"), loss(x).alias("loss")) for x in names))).alias("x")
    point = sse.groupBy("h").agg(*(F.sum(f"`{c}`").alias(c) for c in columns)).select("h", each).select("h", "x.*")
    low, high = resample.interval("loss")
    spread = resample.draw_totals(sse, ["h"], "event", columns).select("h", each).select("h", "x.*").groupBy("h", "dropped").agg(low.alias("low"), high.alias("high"))
    tests = nested_gains(preds, [(f"without {x}", "all") for x in names]).select("h", F.expr("substring(small, 9)").alias("dropped"), "t", "p")
    return point.join(spread, ["h", "dropped"]).join(tests, ["h", "dropped"])


@query("ablation_verdicts", "M-16 M-14")
def ablation_verdicts(v: Views) -> DataFrame:
    """The loss from leaving each group of features out, with its interval and the full model's Clark-West against the rest."""
    found = drop_losses(predictions(Meetings.of(v)), list(dict.fromkeys(GROUPS.values())))
    return found.withColumn("keep", (F.col("low") > 0) & (F.col("p") < P_CUT))


def standardised(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and standard deviations of the features over the rows of g."""
    at, n = slice(1, len(Z) - 1), g[0, 0]
    mean = g[0, at] / n
    scale = np.sqrt(np.maximum(np.diag(g)[at] - n * mean**2, 0) / max(n - 1, 1))
    scale[scale < 1e-9] = 1.0
    return mean, scale


def scaled(g: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The products of (1, standardised features, y) from those of the raw ones."""
    to = np.eye(len(Z))
    to[1:-1, 1:-1] = np.diag(1 / scale)
    to[1:-1, 0] = -mean / scale
    return to @ g @ to.T


def clustered_fit(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and clustered errors (G/(G-1) (n-1)/(n-k)) of an OLS from one product matrix for each cluster."""
    whole, k = grams.sum(0), len(Z) - 1
    inverse = np.linalg.pinv(whole[:k, :k])
    beta = inverse @ whole[:k, k]
    scores = grams[:, :k, k] - grams[:, :k, :k] @ beta
    n, groups = whole[0, 0], len(grams)
    cov = inverse @ (scores.T @ scores) @ inverse * groups / (groups - 1) * (n - 1) / (n - k)
    return beta, np.sqrt(np.maximum(np.diag(cov), 0))


@query("ridge_path", "M-10 M-8")
def ridge_path(v: Views) -> DataFrame:
    """Ridge coefficients of standardised features over alphas, with intervals over resampled meetings: every draw is a sum of
    the meetings' products, made and solved on executors."""
    sums = product_sums(horizon_rows(Meetings.of(v)), ["h", "event"]).persist()  # a row a meeting
    whole = added(sums, ["h"]).withColumnRenamed("sums", "whole")
    draws = resample.draw_totals(spread_out(sums, "h", "event"), ["h"], "event", SUMS).select("h", "draw", F.array(*SUMS).alias("sums")).join(F.broadcast(whole), "h")
    draws = draws.unionByName(whole.select("h", F.lit(-1).alias("draw"), F.col("whole").alias("sums"), "whole"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                mean, scale = standardised(gram(r.whole))
                g = scaled(gram(r.sums), mean, scale)
                k = len(Z) - 1
                for alpha in (0.0, *ALPHAS):
                    penalty = np.diag([0.0, *(0.0 if f == FREE else alpha for f in FEATURES)])
                    beta = np.linalg.lstsq(g[:k, :k] + penalty, g[:k, k], rcond=None)[0]
                    out += [(r.h, r.draw, alpha, f, float(b)) for f, b in zip(FEATURES, beta[1:], strict=True)]
            yield pd.DataFrame(out, columns=["h", "draw", "alpha", "feature", "beta"])

    found = draws.mapInPandas(run, "h int, draw int, alpha double, feature string, beta double").groupBy("h", "alpha", "feature")
    drawn = F.when(F.col("draw") >= 0, F.col("beta"))
    sign = F.create_map(*(x for f, s in SIGNS.items() for x in (F.lit(f), F.lit(float(s)))))
    stable = F.avg((F.signum(drawn) == sign[F.col("feature")]).cast("int"))
    return found.agg(F.max(F.when(F.col("draw") < 0, F.col("beta"))).alias("beta"), F.percentile(drawn, F.lit(0.025)).alias("low"), F.percentile(drawn, F.lit(0.975)).alias("high"), stable.alias("stability"))


def holm_adjusted(rows: DataFrame, by: str, p: str, name: str) -> DataFrame:
    """rows with Holm's step-down of p within each group; a group is a handful of tests."""
    order, whole = Window.partitionBy(by).orderBy(p, "feature"), Window.partitionBy(by)
    left = F.count("*").over(whole) - F.row_number().over(order) + 1
    rows = rows.withColumn(name, left * F.col(p))
    return rows.withColumn(name, F.least(F.max(name).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0)))


def clustered_table(m: Meetings) -> DataFrame:
    """(h, feature, coef, t) of an OLS on all standardised features, clustered by meeting, from the meetings' products."""
    sums = product_sums(horizon_rows(m), ["h", "event"])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        grams = np.stack([gram(s) for s in frame.sort_values("event")["sums"]])
        mean, scale = standardised(grams.sum(0))
        beta, error = clustered_fit(np.stack([scaled(g, mean, scale) for g in grams]))
        t = np.where(error[1:] > 0, beta[1:] / np.where(error[1:] > 0, error[1:], 1), np.nan)
        return pd.DataFrame({"h": frame["h"].iat[0], "feature": FEATURES, "coef": beta[1:], "t": t})

    return sums.groupBy("h").applyInPandas(run, "h int, feature string, coef double, t double")  # a row a meeting


@query("feature_verdicts", "M-16 M-15 M-8 M-6")
def feature_verdicts(v: Views) -> DataFrame:
    """Four checks of each feature: sign, clustered significance after Holm, stability over draws, and loss when left out."""
    m = Meetings.of(v)
    table = clustered_table(m).withColumn("p", D.two_sided_p(F.col("t")))
    table = holm_adjusted(table, "h", "p", "holm_p")
    stable = ridge_path(v).filter("alpha = 0").select("h", "feature", "stability")
    losses = drop_losses(predictions(m), FEATURES).select("h", F.col("dropped").alias("feature"), "loss", F.col("p").alias("loss_p"))
    rows = table.join(stable, ["h", "feature"]).join(losses, ["h", "feature"])
    sign = F.create_map(*(x for f, s in SIGNS.items() for x in (F.lit(f), F.lit(s))))[F.col("feature")]
    checks: list[Column] = [F.col("holm_p") < P_CUT, F.coalesce(F.col("loss_p"), F.lit(1.0)) < P_CUT]
    signed = [F.signum("coef") == sign, F.col("stability") >= STABLE]
    all_of = lambda xs: F.aggregate(F.array(*xs), F.lit(True), lambda a, b: a & b)
    any_of = lambda xs: F.aggregate(F.array(*xs), F.lit(False), lambda a, b: a | b)
    verdict = F.when(F.when(sign == 0, all_of(checks)).otherwise(all_of(checks + signed)), "effect").when(F.when(sign == 0, any_of(checks)).otherwise(any_of(checks + signed)), "weak").otherwise("none")
    group = F.create_map(*(x for f, g in GROUPS.items() for x in (F.lit(f), F.lit(g))))[F.col("feature")]
    return rows.withColumn("verdict", verdict).withColumn("group", group).withColumn("sign", sign).withColumn("stability", F.when(sign != 0, F.col("stability")))


CONVERGENCE = ("n", "sz", "sg", "sk", "sf", "szg", "szk", "szf")


def convergence_sums(m: Meetings) -> DataFrame:
    """(h, iv, event, CONVERGENCE): each meeting's sums for the slopes of both sources' changes on the gap; with iv the gap two
    rows earlier is the instrument. h and iv as one key `of`."""
    w = Window.partitionBy("event").orderBy("day")
    move = lambda c, h: (F.lead(c, h).over(w) - F.col(c)).alias(f"d{c}")
    rows = m.features.select("event", "gap", F.lag("gap", 2).over(w).alias("before"), F.array(*(F.struct(F.lit(h).alias("h"), move("k", h), move("f", h)) for h in HORIZONS)).alias("t"))
    rows = rows.select("event", "gap", "before", F.inline("t"))
    each = F.explode(F.array(F.struct(F.lit(0).alias("iv"), F.col("gap").alias("z")), F.struct(F.lit(1).alias("iv"), F.col("before").alias("z")))).alias("i")
    rows = rows.select("event", "gap", "h", "dk", "df", each).select("event", "gap", "dk", "df", (F.col("h") * 10 + F.col("i.iv")).alias("of"), "i.z").na.drop()
    whole = lambda x: F.sum(F.round(x * UNIT).cast("long"))
    z, g, k, f = (F.col(c) for c in ("z", "gap", "dk", "df"))
    terms = dict(zip(CONVERGENCE, (F.lit(1), z, g, k, f, z * g, z * k, z * f), strict=True))
    return rows.groupBy("of", "event").agg(*(whole(x).alias(c) for c, x in terms.items()))


def _slopes(row: str = "") -> tuple[Column, Column, Column]:
    c = {x: F.col(x).cast("double") / UNIT for x in CONVERGENCE}
    slope = lambda y: F.try_divide(c["n"] * c[f"sz{y}"] - c["sz"] * c[f"s{y}"], c["n"] * c["szg"] - c["sz"] * c["sg"])
    return slope("k"), slope("f"), F.try_divide(slope("k"), slope("k") - slope("f"))


_CHANGES = " UNION ALL ".join(f"SELECT event, {h * 10 + iv} AS of, gap, {'lag(gap, 2) OVER w' if iv else 'gap'} AS z, lead(k, {h}) OVER w - k AS dk, lead(f, {h}) OVER w - f AS df FROM feats WINDOW w AS (PARTITION BY event ORDER BY day)" for h in HORIZONS for iv in (0, 1))
_TERMS = dict(zip(CONVERGENCE, ("1", "z", "gap", "dk", "df", "z * gap", "z * dk", "z * df"), strict=True))
_SLOPE = lambda y: f"((n * sz{y} - sz * s{y}) / (n * szg - sz * sg))"


@query("convergence", "M-9 M-7 M-3", f"""WITH {TABLE}, cv AS (SELECT of, event, {", ".join(f"CAST(sum(CAST(round({x} * {UNIT}) AS BIGINT)) AS BIGINT) AS {c}" for c, x in _TERMS.items())} FROM ({_CHANGES}) WHERE z IS NOT NULL AND dk IS NOT NULL AND df IS NOT NULL GROUP BY of, event),
  dr AS (SELECT of, draw, {", ".join(f"{c} / {UNIT} AS {c}" for c in CONVERGENCE)} FROM {resample.draw_totals_sql("cv", "of", "event", list(CONVERGENCE))}), pt AS (SELECT of, {", ".join(f"sum({c}) / {UNIT} AS {c}" for c in CONVERGENCE)} FROM cv GROUP BY of),
  ds AS (SELECT of, {_SLOPE("k")} AS b, {_SLOPE("f")} AS d FROM dr),
  q AS (SELECT of, {", ".join(f"quantile_cont({x}, {p}) AS {n}_{e}" for n, x in (("b", "b"), ("d", "d"), ("share", "b / (b - d)")) for e, p in (("low", 0.025), ("high", 0.975)))} FROM ds GROUP BY of)
  SELECT of // 10 AS h, of % 10 AS iv, CAST(round(n) AS BIGINT) AS n, round(b, 5) AS b, round(d, 5) AS d, round(b / (b - d), 5) AS share, {", ".join(f"round({n}_{e}, 4) AS {n}_{e}" for n in ("b", "d", "share") for e in ("low", "high"))}
  FROM (SELECT *, {_SLOPE("k")} AS b, {_SLOPE("f")} AS d FROM pt) JOIN q USING (of)""", USES)
def convergence(v: Views) -> DataFrame:
    """How the gap closes: both sources' slopes on it and the first one's share, plain and instrumented, with intervals."""
    sums = convergence_sums(Meetings.of(v))
    b, d, share = _slopes()
    point = sums.groupBy("of").agg(*(F.sum(c).alias(c) for c in CONVERGENCE)).select("of", F.round(F.col("n") / UNIT).cast("long").alias("rows"), b.alias("b"), d.alias("d"), share.alias("share"))
    draws = resample.draw_totals(sums, ["of"], "event", list(CONVERGENCE)).select("of", b.alias("b"), d.alias("d"), share.alias("share"))
    ends = [c.alias(f"{x}_{e}") for x in ("b", "d", "share") for e, c in zip(("low", "high"), resample.interval(x), strict=True)]
    found = point.join(draws.groupBy("of").agg(*ends), "of")
    return found.select(F.expr("of div 10").cast("int").alias("h"), (F.col("of") % 10).alias("iv"), F.col("rows").alias("n"), *(R(x, 5).alias(x) for x in ("b", "d", "share")), *(R(f"{x}_{e}", 4).alias(f"{x}_{e}") for x in ("b", "d", "share") for e in ("low", "high")))
