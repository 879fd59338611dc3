"""Fits and evaluation.

Moments and metrics are Spark aggregates; only matrices of a few features by a
few features reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import rules
from touchline.sources.landing import keep, keep_columns


def correlation(a: str, b: str) -> Column:
    """Pearson correlation; null where either has no spread (the builtin raises under ANSI)."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def total(weight: str | None, x: Column | str | None = None) -> Column:
    """The sum of ``x`` over rows, each as many times as its weight; without ``x``, the number of rows."""
    if x is None:
        return F.coalesce(F.sum(weight), F.lit(0)) if weight else F.count(F.lit(1))
    return F.sum(F.col(weight) * (F.col(x) if isinstance(x, str) else x)) if weight else F.sum(x)


def mean(weight: str | None, x: Column | str) -> Column:
    """The mean of the known values of ``x`` over rows, each as many times as its weight."""
    if not weight:
        return F.avg(x)
    x = F.col(x) if isinstance(x, str) else x
    return F.try_divide(total(weight, x.cast("double")), F.sum(F.when(x.isNotNull(), F.col(weight))))


def deviation(weight: str | None, x: str) -> Column:
    """The sample deviation over rows, each as many times as its weight."""
    if not weight:
        return F.stddev_samp(x)
    n = total(weight)
    return F.when(F.min(x) == F.max(x), 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), F.try_divide(total(weight, F.col(x) * F.col(x)) - total(weight, x) * total(weight, x) / n, n - 1))))


def signed_ridge(df: DataFrame, group: str, features: dict[str, int], target: str, alpha: float = 1000.0, rounds: int = 500, weight: str | None = None) -> DataFrame:
    """Ridge weights for each group on standardised features, each held to a sign (1, -1, or 0 for free).  A row counts ``weight`` times.

    One pass gives all first and second moments; projected coordinate descent
    solves the small systems.  Rows: (group, feature, weight), with the intercept.
    """
    return ridge_of_moments(moments(df, [group], [*features, target], weight), group, features, target, alpha, rounds)


def moments(df: DataFrame, keys: list[str], names: list[str], weight: str | None = None) -> DataFrame:
    """(keys, n, sums of each of ``names``, sums of the products of any two), each row ``weight`` times: of finer keys they add up to those of coarser.  Values must be known."""
    products = [total(weight, F.col(a) * F.col(b)).alias(f"{a}*{b}") for i, a in enumerate(names) for b in names[i:]]
    return df.groupBy(*keys).agg(total(weight).alias("n"), *(total(weight, a).alias(a) for a in names), *products)


def ridge_of_moments(told: DataFrame, group: str, features: dict[str, int], target: str, alpha: float = 1000.0, rounds: int = 500) -> DataFrame:
    """``signed_ridge`` of rows' ``moments``, which may be of more keys than the group and of more features."""
    names = list(features)
    of = lambda a, b: f"{a}*{b}" if f"{a}*{b}" in told.columns else f"{b}*{a}"
    used = ["n", target, *names, *dict.fromkeys(of(a, b) for i, a in enumerate(names) for b in [*names[i:], target])]
    rows = told.groupBy(group).agg(*(F.sum(f"`{c}`").alias(c) for c in used)).collect()  # one row a group
    out = []
    for r in rows:
        n, p = r["n"], len(names)
        mean = np.array([r[a] for a in names]) / n
        cross = np.array([[r[of(a, b)] for b in names] for a in names]) / n - np.outer(mean, mean)
        scale = np.sqrt(np.maximum(np.diag(cross), 0))
        scale[scale == 0] = 1
        gram = n * cross / np.outer(scale, scale)
        moment = (np.array([r[of(a, target)] for a in names]) - mean * r[target]) / scale
        w = np.zeros(p)
        for _ in range(rounds):
            was = w.copy()
            for i, name in enumerate(names):
                w[i] = (moment[i] - gram[i] @ w + gram[i, i] * w[i]) / (gram[i, i] + alpha)
                if features[name]:
                    w[i] = features[name] * max(0.0, features[name] * w[i])
            if np.abs(w - was).max() < 1e-12:
                break
        w /= scale
        out += [(r[group], name, float(x)) for name, x in zip(names, w, strict=True)] + [(r[group], "intercept", float(r[target] / n - mean @ w))]
    return told.sparkSession.createDataFrame(out, f"{group} {told.schema[group].dataType.simpleString()}, feature string, weight double")


def logistic(df: DataFrame, features: list[str], target: str, c: float = 10.0, multinomial: bool = False):
    """MLlib logistic regression with the penalty of inverse strength ``c``; features are standardised first."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    n = df.count()
    steps = [
        VectorAssembler(inputCols=features, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True),
        LogisticRegression(featuresCol="_x", labelCol=target, regParam=1 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False, family="multinomial" if multinomial else "binomial", maxIter=200, tol=1e-9),
    ]
    return Pipeline(stages=steps).fit(df)


_PAIRS = ((0, 1), (0, 2), (1, 2))


def fold_slopes(x: np.ndarray, at: np.ndarray, y: np.ndarray, folds: np.ndarray, w: np.ndarray) -> np.ndarray:
    """For each fold the slopes of the three classes, and for each two classes the rows' products, of which an upper half is enough, weighed by both chances.

    ``x``: rows x features; ``at``, ``y``: their months and classes; ``folds``: months in order, of which a row
    trains those after its own; ``w``: folds x classes x features.  Rows that are close in time pass over most other folds.
    """
    left, right = np.triu_indices(x.shape[1])
    out = np.zeros((len(folds), 3 * x.shape[1] + 3 * len(left)))
    first = np.searchsorted(folds, at.min(), side="right")
    if first == len(folds):
        return out
    p = x @ w[first:].transpose(1, 2, 0)  # classes x rows x folds
    p -= p.max(axis=0)
    np.exp(p, out=p)
    p /= p.sum(axis=0)
    trains = at[:, None] < folds[first:]
    if not trains.all():
        p *= trains
    x2 = x[:, left] * x[:, right]
    products = [(p[k] * p[m]).T @ x2 for k, m in _PAIRS]
    own = trains.astype(float).T
    slopes = [p[k].T @ x - own[:, y == k] @ x[y == k] for k in range(3)]
    out[first:] = np.hstack(slopes + products)
    return out


def walk_forward(df: DataFrame, month: str, sets: dict[str, list[str]], target: str, least: int = 300, c: float = 1.0, rounds: int = 12) -> DataFrame:
    """Adds feature_set and p (chances of classes 0, 1, 2) to each row: by a model of all months before its own.

    A fold is a month; folds with fewer than ``least`` rows before them, or one
    class only, are passed over.  All folds of all feature sets are fitted at once by Newton's
    method on the penalised multinomial likelihood: a round is one pass over the
    rows, in which each row adds to the slopes and curvatures of the folds after
    its month, and only their sums (some numbers for each fold and set) come to
    the driver.  Features are standardised on the rows before the fold.
    """
    names = list(dict.fromkeys(f for own in sets.values() for f in own))
    moments = [F.sum(x).alias(f"{k}{i}") for i, f in enumerate(names) for k, x in (("s", F.col(f)), ("q", F.col(f) * F.col(f)))]
    months = df.groupBy(month).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(target) == k).alias(f"y{k}") for k in range(3)), *moments).orderBy(month).collect()  # one row a month
    labels = [r[month] for r in months]
    before = lambda column: np.concatenate([[0.0], np.cumsum([float(r[column] or 0) for r in months])[:-1]])
    n = before("n")
    folds = np.flatnonzero((n >= least) & (sum(before(f"y{k}") > 0 for k in range(3)) > 1))
    n = n[folds]
    mean = np.stack([before(f"s{i}")[folds] / n for i in range(len(names))], axis=1) if len(folds) else np.zeros((0, len(names)))
    spread = np.stack([np.sqrt(np.maximum(0, before(f"q{i}")[folds] - n * mean[:, i] ** 2) / np.maximum(n - 1, 1)) for i in range(len(names))], axis=1) if len(folds) else mean
    spread[spread < 1e-12] = 1
    width, every = len(names) + 1, list(sets)
    used = np.array([[f in own for f in names] + [True] for own in sets.values()])
    # From features with a one to standardised features with a one, for each fold.
    to_z = np.zeros((len(folds), width, width))
    for i in range(width - 1):
        to_z[:, i, i], to_z[:, i, -1] = 1 / spread[:, i], -mean[:, i] / spread[:, i]
    to_z[:, -1, -1] = 1
    weights = np.zeros((len(sets), len(folds), 3, width))

    def chances(x: np.ndarray, w: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Rows x folds x classes."""
        logits = (x @ (w @ to_z[: len(w)] if at is None else w @ to_z[at]).reshape(-1, width).T).reshape(len(x), len(w), 3)
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        return e / e.sum(axis=2, keepdims=True)

    def inputs(batch):
        x = np.stack([*(batch[f].to_numpy(float) for f in names), np.ones(len(batch))], axis=1)
        return x, np.searchsorted(labels, batch[month].to_numpy()), batch[target].to_numpy(int)

    schema = "feature_set int, fold int, values array<double>"
    rows = df.select(month, target, *names)
    owns = [np.flatnonzero(u) for u in used]

    def slopes(weights: np.ndarray, live: list[int]):
        def run(batches):
            import pandas as pd

            own_w = {s: weights[s][:, :, owns[s]] @ to_z[:, owns[s][:, None], owns[s]] for s in live}
            total = {s: 0 for s in live}
            for batch in batches:
                for lo in range(0, len(batch), 2000):
                    x, at, y = inputs(batch.iloc[lo : lo + 2000])
                    for s in live:
                        total[s] = total[s] + fold_slopes(x[:, owns[s]], at, y, folds, own_w[s])
            told = [(s, f, values) for s in live if np.ndim(total[s]) for f, values in enumerate(total[s])]
            yield pd.DataFrame({"feature_set": [s for s, _, _ in told], "fold": [f for _, f, _ in told], "values": [v for *_, v in told]})

        return run

    def added(batches):
        """The sum of the arrays of each fold and set, a row for each task that had rows."""
        import pandas as pd

        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for s, f, values in zip(batch["feature_set"].tolist(), batch["fold"].tolist(), batch["values"], strict=True):
                total[s, f] = total.get((s, f), 0) + np.asarray(values)
        yield pd.DataFrame({"feature_set": [s for s, _ in total], "fold": [f for _, f in total], "values": list(total.values())})

    live = list(range(len(sets)))
    for _ in range(rounds if len(folds) else 0):
        sums = rows.mapInPandas(slopes(weights, live), schema).repartition("feature_set", "fold").mapInPandas(added, schema).collect()
        most = np.zeros(len(sets))
        for r in sums:
            s, f = r["feature_set"], r["fold"]
            own = owns[s]
            t = to_z[f][np.ix_(own, own)]
            flat = np.array(r["values"])
            slope = flat[: 3 * len(own)].reshape(3, -1) @ t.T
            curve = np.zeros((3, len(own), 3, len(own)))
            upper = np.triu_indices(len(own))
            for (k, m), values in zip(_PAIRS, flat[3 * len(own) :].reshape(len(_PAIRS), -1), strict=True):
                h = np.zeros((len(own), len(own)))
                h[upper] = h.T[upper] = values
                h = t @ h @ t.T
                curve[k, :, m] = curve[m, :, k] = -h
                curve[k, :, k] += h  # chances add up to one
                curve[m, :, m] += h
            free = np.append(np.ones(len(own) - 1), 0) / c  # the intercept isn't penalised
            w = weights[s, f][:, own]
            slope = (slope + free * w).ravel()
            curve = curve.reshape(3 * len(own), -1) + np.diag(np.tile(free + 1e-9, 3))
            step = np.linalg.solve(curve, slope).reshape(3, -1)
            weights[s, f][:, own] = w - step
            most[s] = max(most[s], float(np.abs(step).max()))
        live = [s for s in live if most[s] >= 1e-8]
        if not live:
            break

    def predict(batches):
        import pandas as pd

        for batch in batches:
            x, at, _ = inputs(batch)
            fold = np.searchsorted(folds, at)
            known = np.flatnonzero((fold < len(folds)) & (np.append(folds, -1)[fold] == at))
            for s, name in enumerate(every):
                p = [None] * len(known)
                for f in np.unique(fold[known]):
                    own = np.flatnonzero(fold[known] == f)
                    for i, chance in zip(own, chances(x[known[own]], weights[s][f : f + 1], slice(f, f + 1))[:, 0].tolist(), strict=True):
                        p[i] = chance
                yield batch.iloc[known].drop(columns=names).assign(feature_set=name, p=pd.Series(p, index=batch.index[known], dtype=object))

    rest = [f for f in df.schema.fields if f.name not in names]
    return df.mapInPandas(predict, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest) + ", feature_set string, p array<double>")


def running_counts(df: DataFrame, value: str, *counts: str, by: list[str] | None = None, dealt: bool = False) -> DataFrame:
    """Adds ``before_x`` to distinct values (within ``by``) with counts: the sum of each count x over all lesser values.

    With ``dealt``, rows are by ranges of (by, value) in their tasks; else they are dealt so.  They are dealt by ranges of value and kept there once; sums of whole ranges are
    a few rows for each task, and the rest of a running sum stays within its range.
    """
    by = by or []
    dealt = keep_columns((df if dealt else df.repartitionByRange(*by, value)).withColumn("_range", F.spark_partition_id()))
    edges = dealt.groupBy("_range", *by).agg(*(F.sum(c).alias(f"_sum_{c}") for c in counts))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    edges = edges.select("_range", *(F.col(c).alias(f"_by_{c}") for c in by), *(F.coalesce(F.sum(f"_sum_{c}").over(earlier), F.lit(0)).alias(f"_start_{c}") for c in counts))
    inside = Window.partitionBy("_range", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in counts}).withColumnRenamed("_range", "_own")
    out = out.join(edges, (F.col("_own") == F.col("_range")) & (F.lit(True) if not by else F.forall(F.array(*(F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by)), lambda x: x)))
    return out.withColumns({f"before_{c}": F.col(f"before_{c}") + F.col(f"_start_{c}") for c in counts}).select(*df.columns, *(f"before_{c}" for c in counts))


def auc(df: DataFrame, score: str, label: str, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Area under the ROC curve (for each ``by``) by mean ranks: scores are counted first, so ranks are over distinct scores.  Null where there is one class only."""
    by = by or []
    counted = df.groupBy(*by, score).agg(total(weight).alias("_n"), total(weight, label).alias("_p"))
    ranked = running_counts(counted, score, "_n", by=by).withColumn("_rank", F.col("before__n") + (F.col("_n") + 1) / 2)
    pos, neg = F.sum("_p"), F.sum(F.col("_n") - F.col("_p"))
    return ranked.groupBy(*by).agg(F.try_divide(F.sum(F.col("_p") * F.col("_rank")) - pos * (pos + 1) / 2, pos * neg).alias("auc"))


def probability_metrics(df: DataFrame, p: Column, y: Column, clip: float = 1e-4, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    q = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), p))
    return df.groupBy(*(by or [])).agg(total(weight).alias("n"), (-mean(weight, y * F.ln(q) + (1 - y) * F.ln(1 - q))).alias("log_loss"), mean(weight, (p - y) * (p - y)).alias("brier"))


def outcome_metrics(df: DataFrame, p: tuple[Column, Column, Column], y: Column) -> DataFrame:
    """Log loss and ranked probability score of home, draw, away chances; y is 0, 1 or 2."""
    own = F.when(y == 0, p[0]).when(y == 1, p[1]).otherwise(p[2])
    a = p[0] - F.when(y == 0, 1.0).otherwise(0.0)
    b = p[0] + p[1] - F.when(y <= 1, 1.0).otherwise(0.0)
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(-F.ln(F.greatest(F.lit(1e-9), own))).alias("log_loss"), F.avg((a * a + b * b) / 2).alias("rps"))


def quantiles(df: DataFrame, value: str, shares: list[float], weight: str | None = None) -> DataFrame:
    """One row (least, cuts): the least value and its linear quantiles at ``shares``, exactly, from counts of distinct values."""
    by = running_counts(df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(total(weight).alias("n")), "v", "n")
    every = by.agg(F.sum("n").alias("total"))
    spots = by.join(F.broadcast(every)).withColumn("share", F.explode(F.array(*map(F.lit, shares)))).withColumn("at", F.col("share") * (F.col("total") - 1))
    holds = lambda place: (F.col("before_n") <= place) & (place < F.col("before_n") + F.col("n"))
    low, high = F.floor("at"), F.least(F.floor("at") + 1, F.col("total") - 1)
    cuts = spots.filter(holds(low) | holds(high)).groupBy("share").agg(F.max(F.when(holds(low), F.col("v"))).alias("low"), F.max(F.when(holds(high), F.col("v"))).alias("high"), F.first("at").alias("at"))
    cut = F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at"))
    cuts = cuts.agg(F.sort_array(F.collect_list(F.struct("share", cut.alias("cut")))).alias("c")).select(F.transform("c", lambda x: x["cut"]).alias("cuts"))
    return df.agg(F.min(value).alias("least")).join(cuts)  # a row each


def calibration(df: DataFrame, p: str, y: str, bins: int = 10, weight: str | None = None) -> DataFrame:
    """(bin, n, predicted, realised) in quantile bins: linear quantiles, equal edges merged, right-closed, the least value included."""
    edges = quantiles(df, p, [i / bins for i in range(1, bins)], weight).select(F.array_distinct(F.filter("cuts", lambda c: c > F.col("least"))).alias("cuts"))
    # one row of at most bins - 1 numbers
    rows = df.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("cuts", lambda c: c < F.col(p))))
    return rows.groupBy("bin").agg(total(weight).alias("n"), mean(weight, p).alias("predicted"), mean(weight, y).alias("realised"))


def paired_difference(df: DataFrame, group: str, a: str, b: str) -> DataFrame:
    d = F.col(a) - F.col(b)
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_diff"), (1.96 * F.stddev_samp(d) / F.sqrt(F.count(F.lit(1)))).alias("half_width"))


def poisson_steps() -> list[float]:
    """The chances of a Poisson number of mean 1 being at most 0, 1, 2, ... 11."""
    return [float(x) for x in np.cumsum([np.exp(-1) / math.factorial(k) for k in range(12)])]


def poisson_weights(cluster: str, draw: str, seed: int) -> Column:
    """How often a draw takes a cluster: Poisson of mean 1, by md5 of cluster, four draws and seed."""
    digits = F.substring(F.md5(F.concat_ws("-", F.col(cluster).cast("string"), F.floor(F.col(draw) / 4).cast("string"), F.lit(str(seed))).cast("binary")), 1 + 8 * (F.col(draw) % 4).cast("int"), F.lit(8))
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 32)
    return sum((F.when(u > s, 1).otherwise(0) for s in poisson_steps()), F.lit(0))


def clustered_bootstraps(df: DataFrame, cluster: str, diffs: list[str], draws: int = 300, seed: int = 1, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """([by,] mean_x, spread_x for each x of ``diffs``): means over clusters drawn anew.

    All differences and groups share a draw's weights of clusters, worked out once for each
    cluster and draw, so no draw is gathered.
    """
    by = by or []
    sums = df.groupBy(*by, cluster).agg(*(total(weight, x).alias(f"_d_{x}") for x in diffs), total(weight).alias("_n"))
    drawn = sums.withColumn("_draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("_w", poisson_weights(cluster, "_draw", seed))
    means = drawn.groupBy(*by, "_draw").agg(*(F.try_divide(F.sum(F.col("_w") * F.col(f"_d_{x}")), F.sum(F.col("_w") * F.col("_n"))).alias(f"_m_{x}") for x in diffs))
    return means.groupBy(*by).agg(*(f for x in diffs for f in (F.avg(f"_m_{x}").alias(f"mean_{x}"), F.stddev_pop(f"_m_{x}").alias(f"spread_{x}"))))


def clustered_bootstrap(df: DataFrame, cluster: str, diff: str, draws: int = 300, seed: int = 1, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(mean_diff, spread) of one difference."""
    out = clustered_bootstraps(df, cluster, [diff], draws, seed, by, weight)
    return out.select(*(by or []), F.col(f"mean_{diff}").alias("mean_diff"), F.col(f"spread_{diff}").alias("spread"))


def r_squared(df: DataFrame, group: str, predicted: str, actual: str, weight: str | None = None) -> DataFrame:
    """R2 in one pass from sums of squares, and the correlation; rows of both values, each ``weight`` times."""
    p, y = F.col(predicted), F.col(actual)
    n, spread = total(weight), lambda a, b: total(weight, a * b) - total(weight, a) * total(weight, b) / total(weight)
    corr = F.when((F.min(p) < F.max(p)) & (F.min(y) < F.max(y)), F.try_divide(spread(p, y), F.sqrt(spread(p, p) * spread(y, y)))) if weight else correlation(predicted, actual)
    return df.groupBy(group).agg(n.alias("n"), (1 - F.try_divide(total(weight, (y - p) * (y - p)), spread(y, y))).alias("r2"), corr.alias("corr"))


def partial_correlation(df: DataFrame, x: str, y: str, given: str) -> DataFrame:
    """Correlation of the residuals of x and y after a line in ``given``, from the three plain correlations."""
    r = df.agg(correlation(x, y).alias("xy"), correlation(x, given).alias("xz"), correlation(y, given).alias("yz"))
    return r.select(F.try_divide(F.col("xy") - F.col("xz") * F.col("yz"), F.sqrt((1 - F.col("xz") ** 2) * (1 - F.col("yz") ** 2))).alias("partial"))


def predicted(df: DataFrame, weights: DataFrame, group: str, features: list[str], name: str) -> DataFrame:
    """Adds the prediction of weight rows (group, feature, weight), which are few."""
    wide = weights.groupBy(group).pivot("feature", [*features, "intercept"]).agg(F.first("weight"))
    wide = wide.select(F.col(group).alias("_g"), *(F.col(f).alias(f"_w_{f}") for f in [*features, "intercept"]))
    total = F.col("_w_intercept")
    for f in features:
        total = total + F.col(f"_w_{f}") * F.col(f)
    return df.join(F.broadcast(wide), F.col(group) == F.col("_g")).withColumn(name, total).drop("_g", *(f"_w_{f}" for f in [*features, "intercept"]))


def incremental_value(train: DataFrame, test: DataFrame, group: str, base: dict[str, int], extra: dict[str, int], target: str, cluster: str, draws: int = 300, weight: str | None = None) -> DataFrame:
    """(group, n, gain, spread): how much further features lower the squared error of a signed ridge, over clusters drawn anew."""
    names = [*base, *extra, target]
    return value_of_moments(moments(train, [group], names, weight), moments(test, [group, cluster], names, weight), group, base, extra, target, cluster, draws)


def squared_error(told: DataFrame, weights: DataFrame, group: str, features: list[str], target: str, name: str) -> DataFrame:
    """Adds to ``moments`` the sum of squared errors of weight rows (group, feature, weight), which are few."""
    wide = weights.groupBy(group).pivot("feature", [*features, "intercept"]).agg(F.first("weight"))
    wide = wide.select(F.col(group).alias("_g"), *(F.col(f).alias(f"_w_{f}") for f in [*features, "intercept"]))
    of = lambda a, b: F.col(f"`{a}*{b}`" if f"{a}*{b}" in told.columns else f"`{b}*{a}`")
    w = {f: F.col(f"_w_{f}") for f in features}
    # an error is target - intercept - sum of weight * feature; its square is of products of two
    out = of(target, target) - 2 * F.col("_w_intercept") * F.col(target) + F.col("_w_intercept") * F.col("_w_intercept") * F.col("n")
    for i, a in enumerate(features):
        out = out - 2 * w[a] * (of(a, target) - F.col("_w_intercept") * F.col(a)) + w[a] * w[a] * of(a, a)
        for b in features[i + 1 :]:
            out = out + 2 * w[a] * w[b] * of(a, b)
    return told.join(F.broadcast(wide), F.col(group) == F.col("_g")).withColumn(name, out).drop("_g", *(f"_w_{f}" for f in [*features, "intercept"]))


def value_of_moments(train: DataFrame, test: DataFrame, group: str, base: dict[str, int], extra: dict[str, int], target: str, cluster: str, draws: int = 300) -> DataFrame:
    """``incremental_value`` of rows' ``moments``; those of ``test`` are of a cluster or a part of one, so nothing reads rows again."""
    both = {**base, **extra}
    told = squared_error(test, ridge_of_moments(train, group, base, target), group, list(base), target, "_base")
    told = squared_error(told, ridge_of_moments(train, group, both, target), group, list(both), target, "_both")
    told = told.select(group, cluster, "n", ((F.col("_base") - F.col("_both")) / F.col("n")).alias("_gain"))
    means = told.groupBy(group).agg(total("n").alias("n"), mean("n", "_gain").alias("gain"))
    return means.join(clustered_bootstrap(told, cluster, "_gain", draws, by=[group], weight="n").select(group, "spread"), group)


def context_swap(train: DataFrame, test: DataFrame, group: str, features: dict[str, int], contexts: dict[str, tuple[Column, Column, Column]], swap, target: str, cluster: str, against: str, draws: int = 300, weight: str | None = None) -> DataFrame:
    """(group, context, n, mse, gain, spread): a signed ridge fitted once and scored under several contexts.

    ``contexts``: chances of a win, a loss and a draw by name; ``swap`` makes of them
    the features that depend on them (by name; all others stay).  Contexts are rows, so
    each test row is scored under all of them in one pass; ``gain`` is how much lower the
    squared error is than under the context ``against``, and ``spread`` its deviation over
    clusters drawn anew, with the same draws for all groups and contexts.
    """
    weights = signed_ridge(train, group, features, target, weight=weight)
    told = F.array(*(F.struct(F.lit(k).alias("context"), *(x.cast("double").alias(n) for x, n in zip(c, ("_win", "_loss", "_draw"), strict=True))) for k, c in contexts.items()))
    rows = test.withColumn("_c", F.explode(told)).select(*test.columns, "_c.*")
    rows = rows.withColumns({k: v for k, v in swap(F.col("_win"), F.col("_loss"), F.col("_draw")).items() if k in features})
    rows = predicted(rows, weights, group, list(features), "_p").withColumn("_e", F.pow(F.col(target) - F.col("_p"), F.lit(2)))
    errors = rows.groupBy(group, "context").agg(total(weight).alias("n"), mean(weight, "_e").alias("mse"))
    names = list(contexts)
    per = lambda k: total(weight, F.when(F.col("context") == k, F.col("_e")))
    wide = rows.groupBy(group, cluster).agg(*((per(against) - per(k)).alias(f"d{i}") for i, k in enumerate(names)), total(weight, F.when(F.col("context") == against, 1).otherwise(0)).alias("_n"))
    drawn = wide.withColumn("_draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("_w", poisson_weights(cluster, "_draw", 1))
    means = drawn.groupBy(group, "_draw").agg(*(F.try_divide(F.sum(F.col("_w") * F.col(f"d{i}")), F.sum(F.col("_w") * F.col("_n"))).alias(f"m{i}") for i in range(len(names))))
    spread = means.groupBy(group).agg(*(F.stddev_pop(f"m{i}").alias(f"s{i}") for i in range(len(names))))
    gain = wide.groupBy(group).agg(*((F.sum(f"d{i}") / F.sum("_n")).alias(f"g{i}") for i in range(len(names))))
    each = gain.join(spread, group).select(group, F.explode(F.array(*(F.struct(F.lit(k).alias("context"), F.col(f"g{i}").alias("gain"), F.col(f"s{i}").alias("spread")) for i, k in enumerate(names)))).alias("x")).select(group, "x.*")
    return errors.join(each, [group, "context"])


def fit_features(rows: DataFrame, xg: tuple[str, str]) -> DataFrame:
    """Adds the inputs of the points model: sr, wp, owp, dp, xgb, csb_wp, csb_nowp.

    rows: those of ``match_features``, and cur and pri (this and last season's rating).
    """
    return match_features(rows.withColumn("sr", rules.season_rating(F.col("cur"), F.col("pri"), F.col("c_apps"))), xg)


def match_features(rows: DataFrame, xg: tuple[str, str]) -> DataFrame:
    """Adds the inputs of the points model but the rating: wp, owp, dp, xgb, csb_wp, csb_nowp.

    rows: c_apps, p_apps, own, opp and draw (odds, null where unknown), diff, goal_bonus,
    cs_bonus, and totals ``xg`` of both seasons.
    """
    c = F.col
    none = F.lit(None).cast("double")
    win, loss, draw = rules.match_context(c("own"), c("opp"), c("draw"), (none, none, none), c("diff"))
    rate = rules.per_match(c(xg[0]), c(xg[1]), c("c_apps"), c("p_apps"))
    return rows.withColumns({"wp": win, "owp": loss, "dp": draw, "xgb": rate * c("goal_bonus")}).withColumns({"csb_wp": c("cs_bonus") * c("wp"), "csb_nowp": -c("cs_bonus") * c("owp")})
