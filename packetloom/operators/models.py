"""Anomaly models: normalisation, isolation forests, autoencoder, fusion, conformal tests.

Training samples are bounded by the model (trees times sample size), so a model is a small
table whatever the data. Scoring is one Arrow-batched pass over the rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.scalars import sigmoid
from packetloom.operators.runs import fold_runs
from packetloom.operators.ordered import OrderedGroups, Running, order_statistics, percentile_at

SECOND = 1_000_000
EPS = 1e-10

# ---- normalisation ------------------------------------------------------------------------------


def fit_zscore(df: DataFrame, names: list[str]) -> DataFrame:
    """One row with mean and population deviation of each feature; constants get 1."""
    stats = df.agg(*[F.avg(n).alias(f"mean_{n}") for n in names], *[F.stddev_pop(n).alias(f"std_{n}") for n in names])
    return stats.withColumns({f"std_{n}": F.when(F.col(f"std_{n}") < EPS, 1.0).otherwise(F.col(f"std_{n}")) for n in names})


def apply_zscore(df: DataFrame, stats: DataFrame, names: list[str]) -> DataFrame:
    one = F.lit(0).alias("_all")
    joined = df.select("*", one).join(F.broadcast(stats.select("*", one)), "_all").drop("_all")  # one row
    z = {n: (F.col(n) - F.col(f"mean_{n}")) / F.col(f"std_{n}") for n in names}
    return joined.withColumns(z).drop(*[f"{p}_{n}" for n in names for p in ("mean", "std")])


def with_vector(df: DataFrame, names: list[str], out: str = "features") -> DataFrame:
    return df.withColumn(out, F.array(*[F.col(n).cast("double") for n in names]))


def feature_projection(df: DataFrame, level: Column, vector: str = "features") -> DataFrame:
    """Keep 5, 14 or 18 features by threat level, and the 14 the forest scores.

    ``vector`` holds the 18 features in canonical order; the baseline level sees rates and
    protocol shares only, padded with zeros to 14 for scoring.
    """
    v = F.col(vector)
    five = F.array(*[v[i] for i in (0, 1, 6, 7, 8)])
    kept = (F.when(level == "BASELINE", five).when(level == "WATCH", F.slice(v, 1, 14)).otherwise(v))
    scored = F.when(level == "BASELINE", F.concat(five, F.array_repeat(F.lit(0.0), 9))).otherwise(F.slice(v, 1, 14))
    return df.withColumns({"kept": kept, "scored": scored})


def heuristic_score(vector: Column) -> Column:
    """Spread relative to mean size, for use without a model."""
    n = F.size(vector)
    zero = F.lit(0.0)
    size = F.aggregate(vector, zero, lambda a, x: a + F.abs(x)) / n
    mean = F.aggregate(vector, zero, lambda a, x: a + x) / n
    var = F.aggregate(vector, zero, lambda a, x: a + (x - mean) * (x - mean)) / n
    return F.when((n == 0) | (size < EPS), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(zero, F.sqrt(var) / size / 5.0)))


def top_contributors(df: DataFrame, z: str, names: list[str], k: int = 5) -> DataFrame:
    """The ``k`` features furthest from the baseline, with direction and weight."""
    parts = F.array(*[F.struct(F.abs(F.col(z)[i]).alias("z"), F.lit(-i).alias("i"), F.lit(n).alias("feature"),
                               (F.col(z)[i] > 0).alias("above")) for i, n in enumerate(names)])
    best = F.slice(F.sort_array(parts, asc=False), 1, k)
    shaped = F.transform(best, lambda e: F.struct(
        e["feature"].alias("feature"), e["z"].alias("z"), F.when(e["above"], "above").otherwise("below").alias("direction"),
        F.least(F.lit(1.0), e["z"] / 5.0).alias("weight")))
    return df.withColumn("contributors", shaped)


# ---- isolation forests ----------------------------------------------------------------------------


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


@dataclass
class Forest:
    """Flattened trees: arrays of shape (trees, nodes); a leaf points to itself."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray
    sample: int
    height: int
    normal: np.ndarray | None = None
    threshold: float = 0.5

    def scores(self, x: np.ndarray) -> np.ndarray:
        c = average_path(self.sample)
        if c == 0 or len(x) == 0:
            return np.full(len(x), 0.5)
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for t in range(len(self.value)):
            at = np.zeros(len(x), dtype=np.int64)
            # project on all normals at once; a gather per level is then enough
            split = x @ self.normal[t].T if self.normal is not None else None
            for _ in range(self.height):
                v = split[rows, at] if split is not None else x[rows, self.feature[t][at]]
                at = np.where(v < self.value[t][at], self.left[t][at], self.right[t][at])
            total += self.path[t][at]
        return np.power(2.0, -total / len(self.value) / c)


def _grow(x: np.ndarray, rng, height: int, extension: int | None):
    """Nodes of one tree as (node, feature, normal, value, left, right, path)."""
    nodes, todo, fresh = [], [(0, np.arange(len(x)), 0)], 1
    d = x.shape[1]
    while todo:
        node, idx, depth = todo.pop()
        part, leaf = x[idx], (node, 0, None, 0.0, node, node, depth + average_path(len(idx)))
        lo, hi = (part.min(axis=0), part.max(axis=0)) if len(idx) else (0, 0)
        if len(idx) <= 1 or depth >= height or not np.any(hi > lo):
            nodes.append(leaf)
            continue
        if extension is None:
            feature, normal = int(rng.choice(np.flatnonzero(hi > lo))), None
            along = part[:, feature]
        else:
            normal = rng.standard_normal(d)
            drop = d - 1 - min(extension, d - 1)
            if drop:
                normal[rng.choice(d, drop, replace=False)] = 0.0
            norm = np.linalg.norm(normal)
            if norm < EPS:
                nodes.append(leaf)
                continue
            feature, normal = 0, normal / norm
            along = part @ normal
        a, b = along.min(), along.max()
        cut = rng.uniform(a, b)
        goes = along < cut
        if b - a < 1e-12 or goes.all() or not goes.any():
            nodes.append(leaf)
            continue
        nodes.append((node, feature, normal, cut, fresh, fresh + 1, 0.0))
        todo += [(fresh, idx[goes], depth + 1), (fresh + 1, idx[~goes], depth + 1)]
        fresh += 2
    return nodes


def training_pool(df: DataFrame, row_id: str, size: int, seed: int) -> DataFrame:
    """A uniform sample of exactly ``min(size, rows)`` rows: those with the smallest hashes.
    The sample depends on ids and seed only, never on partitioning. A hash threshold leaves a few
    times ``size`` rows for the final ordering, however many partitions there are; it is raised until
    enough rows pass, so the result is that of ordering all rows."""
    hashed = df.withColumn("_h", F.xxhash64(F.col(row_id), F.lit(seed)))
    rows, share = df.count(), 2.0
    while rows and share * size < rows:
        below = hashed.filter(F.col("_h") < int(share * size / rows * 2**64) - 2**63)
        if below.count() >= size:
            hashed = below
            break
        share *= 2
    return hashed.orderBy("_h", row_id).limit(size).drop("_h")


def fit_forest(df: DataFrame, row_id: str = "row_id", vector: str = "features", trees: int = 100, sample: int = 256,
               seed: int = 42, extension: int | None = None, contamination: float = 0.0,
               hot_rows=None, parts=None) -> Forest:
    """Grow ``trees`` isolation trees on ``sample`` rows each. ``extension`` switches to random
    hyperplanes with that many extra dimensions. A sampling operator: the pool the trees draw
    from has ``trees * sample`` rows at most, and so has everything that follows."""
    pool = training_pool(df.select(F.col(row_id).alias("_rid"), F.col(vector).alias("_x")), "_rid", trees * sample, seed)
    # a seeded random order per tree; its first rows are the tree's sample
    pool = pool.persist()
    ids = pool.select("_rid", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("_tree"))
    ids = ids.withColumn("_h", F.xxhash64("_rid", "_tree", F.lit(seed + 1)))
    place = F.row_number().over(Window.partitionBy("_tree").orderBy("_h", "_rid"))
    # only ids are ranked; a vector goes to the trees that drew it
    tagged = ids.withColumn("_place", place).filter(F.col("_place") <= sample).drop("_place").join(pool, "_rid")
    shape = "tree int, n int, node int, feature int, normal array<double>, value double, lft int, rgt int, path double"

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["_tree"].iloc[0])
        chosen = pdf.sort_values(["_h", "_rid"])
        x = np.stack(chosen["_x"].to_numpy()).astype(float)
        height = max(1, math.ceil(math.log2(max(len(x), 2))))
        nodes = _grow(x, np.random.default_rng([seed, tree]), height, extension)
        return pd.DataFrame([(tree, len(x), *n) for n in nodes],
                            columns=["tree", "n", "node", "feature", "normal", "value", "lft", "rgt", "path"])

    # at most trees * 2 * sample nodes
    table = tagged.groupBy("_tree").applyInPandas(grow, shape).toPandas()
    pool.unpersist()
    if table.empty:
        raise ValueError("no rows to train on")
    n = int(table["n"].max())
    width = int(table["node"].max()) + 1
    grid = {c: np.zeros((trees, width), dtype=float if c in ("value", "path") else np.int64)
            for c in ("feature", "value", "lft", "rgt", "path")}
    for c, g in grid.items():
        g[table["tree"], table["node"]] = table[c]
    normal = None
    if extension is not None:
        d = max((len(v) for v in table["normal"] if v is not None), default=1)
        normal = np.zeros((trees, width, d))
        inner = table[table["normal"].notna()]
        for t, i, v in zip(inner["tree"], inner["node"], inner["normal"]):
            normal[t, i] = v
    forest = Forest(grid["feature"], grid["value"], grid["lft"], grid["rgt"], grid["path"], n,
                    max(1, math.ceil(math.log2(max(n, 2)))), normal)
    if contamination > 0:
        scored = score_forest(df, forest, vector)
        forest.threshold = calibrate_percentile(scored, contamination, hot_rows, parts).first()["threshold"]
    return forest


def score_forest(df: DataFrame, forest: Forest, vector: str = "features", out: str = "score") -> DataFrame:
    model = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.value.scores(np.stack(x.to_numpy()).astype(float)) if len(x) else [])

    return df.withColumn(out, score(F.col(vector)))


def predict_forest(df: DataFrame, forest: Forest, vector: str = "features") -> DataFrame:
    return score_forest(df, forest, vector).withColumn("predicted", (F.col("score") >= forest.threshold).cast("int"))


def calibrate_percentile(scored: DataFrame, contamination: float, hot_rows=None, parts=None) -> DataFrame:
    """Decision threshold: the (1 - contamination) percentile of the scores, .5 without one."""
    if contamination <= 0:
        return scored.sparkSession.range(1).select(F.lit(0.5).alias("threshold"))
    return order_statistics(scored, "score", {"threshold": percentile_at(1 - contamination)}, hot_rows=hot_rows, parts=parts)


def feature_importance(df: DataFrame, forest: Forest, names: list[str], row_id: str = "row_id", vector: str = "features",
                       seed: int = 42, hot_rows=None, parts=None) -> DataFrame:
    """Mean change of the score when one feature comes from a randomly chosen other row.

    Rows are numbered once by id and once by a random hash; equal numbers make the pairs, so
    every row lends each feature exactly once.
    """
    base = df.select(F.col(row_id).alias("_id"), F.col(vector).alias("_x")).withColumn("_h", F.xxhash64("_id", F.lit(seed)))
    mine = OrderedGroups(base, [], ["_id"], hot_rows, parts).numbered("_n").df.select("_n", "_x")
    other = OrderedGroups(base, [], ["_h", "_id"], hot_rows, parts).numbered("_n").df.select("_n", F.col("_x").alias("_y"))
    model = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("array<double>")
    def change(x: pd.Series, y: pd.Series) -> pd.Series:
        a, b = np.stack(x.to_numpy()).astype(float), np.stack(y.to_numpy()).astype(float)
        start, out = model.value.scores(a), np.zeros_like(a)
        for i in range(a.shape[1]):
            mixed = a.copy()
            mixed[:, i] = b[:, i]
            out[:, i] = np.abs(model.value.scores(mixed) - start)
        return pd.Series(list(out))

    pairs = mine.join(other, "_n").select(change("_x", "_y").alias("_c"))
    sums = pairs.agg(*[F.avg(F.col("_c")[i]).alias(f"c{i}") for i in range(len(names))])
    total = reduce(lambda a, b: a + b, [F.col(f"c{i}") for i in range(len(names))])
    rows = F.array(*[F.struct(F.lit(n).alias("feature"), F.when(total > 0, F.col(f"c{i}") / total).otherwise(0.0).alias("importance"))
                     for i, n in enumerate(names)])
    return sums.select(F.explode(rows).alias("r")).select("r.*")


# ---- autoencoder ------------------------------------------------------------------------------------


@dataclass
class Autoencoder:
    """Dense layers with ReLU between them and linear bottleneck and output."""

    weights: list
    biases: list
    base_error: float = 1.0
    threshold: float = 1.0
    history: list = None

    def forward(self, x):
        """Activations per layer; the last one is the reconstruction."""
        out = [x]
        for i, (w, b) in enumerate(zip(self.weights, self.biases)):
            z = out[-1] @ w + b
            out.append(np.maximum(z, 0.0) if i not in (1, len(self.weights) - 1) else z)
        return out

    def errors(self, x):
        return ((self.forward(x)[-1] - x) ** 2).mean(axis=1)

    def gradients(self, x):
        acts = self.forward(x)
        delta = 2.0 * (acts[-1] - x) / x.shape[1]
        grads = []
        for i in range(len(self.weights) - 1, -1, -1):
            if i not in (1, len(self.weights) - 1):
                delta = delta * (acts[i + 1] > 0)
            grads.append((acts[i].T @ delta, delta.sum(axis=0)))
            delta = delta @ self.weights[i].T
        return grads[::-1]


def fit_autoencoder(df: DataFrame, row_id: str = "row_id", vector: str = "features", hidden=(8, 4, 8), epochs: int = 30,
                    rate: float = 0.01, patience: int = 5, contamination: float = 0.05, seed: int = 42,
                    hot_rows=None, parts=None) -> Autoencoder:
    """Train on (already normalised) vectors with full-batch Adam.

    Every epoch is one pass: each partition adds up gradients and errors, and only those sums
    (the size of the model) come to the driver. A fifth of the rows, chosen by hash, validates
    and stops the training early.
    """
    rows = df.select(F.col(vector).alias("_x"), (F.pmod(F.xxhash64(F.col(row_id), F.lit(seed)), F.lit(5)) == 0).alias("_val")).persist()
    width = rows.select(F.size("_x").alias("d")).first()["d"]
    sizes, rng = [width, *hidden, width], np.random.default_rng(seed)
    net = Autoencoder([rng.standard_normal((a, b)) * math.sqrt(2.0 / a) for a, b in zip(sizes, sizes[1:])],
                      [np.zeros(b) for b in sizes[1:]], history=[])
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in [*net.weights, *net.biases]]
    best, kept, waited = float("inf"), None, 0

    def partials(model):
        def run(batches):
            size = sum(p.size for p in [*model.weights, *model.biases])
            total, tail, seen = np.zeros(size), np.zeros(4), False
            for pdf in batches:
                if not len(pdf):
                    continue
                x, val = np.stack(pdf["_x"].to_numpy()).astype(float), pdf["_val"].to_numpy(bool)
                seen = True
                tail[2:] += val.sum(), model.errors(x[val]).sum()
                x = x[~val]
                if len(x):
                    total += np.concatenate([g.ravel() for pair in model.gradients(x) for g in pair])
                    tail[:2] += len(x), model.errors(x).sum()
            if seen:
                yield pd.DataFrame({"g": [np.concatenate([tail, total])]})

        return run

    for epoch in range(1, epochs + 1):
        # numbers, errors and gradients in one array, added up per position on the executors: one pass, and
        # the driver sees one row per weight
        sums = rows.mapInPandas(partials(net), "g array<double>").select(F.posexplode("g").alias("i", "g"))
        both = sums.groupBy("i").agg(F.sum("g").alias("g")).toPandas().sort_values("i")["g"].to_numpy()
        (n, loss, vn, vloss), grad = both[:4], both[4:] / max(both[0], 1)
        offset, grads_w, grads_b = 0, [], []
        for w, b in zip(net.weights, net.biases):
            grads_w.append(grad[offset:offset + w.size].reshape(w.shape))
            offset += w.size
            grads_b.append(grad[offset:offset + b.size])
            offset += b.size
        validation = vloss / vn if vn else loss / max(n, 1)
        net.history.append({"epoch": epoch, "train_loss": loss / max(n, 1), "val_loss": validation})
        if validation < best:
            best, waited = validation, 0
            kept = ([w.copy() for w in net.weights], [b.copy() for b in net.biases])
        else:
            waited += 1
            if waited >= patience:
                break
        for p, g, m in zip([*net.weights, *net.biases], [*grads_w, *grads_b], moments):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.999 * m[1] + 0.001 * g * g
            p -= rate * (m[0] / (1 - 0.9**epoch)) / (np.sqrt(m[1] / (1 - 0.999**epoch)) + 1e-8)
    net.weights, net.biases = kept
    scored = reconstruction_error(rows, net, "_x").select(F.col("error").alias("score"))
    net.base_error = max(scored.agg(F.avg("score").alias("m")).first()["m"], EPS)
    net.threshold = calibrate_percentile(scored, contamination, hot_rows, parts).first()["threshold"]
    rows.unpersist()
    return net


def reconstruction_error(df: DataFrame, net: Autoencoder, vector: str = "features") -> DataFrame:
    model = df.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def error(x: pd.Series) -> pd.Series:
        return pd.Series(model.value.errors(np.stack(x.to_numpy()).astype(float)) if len(x) else [])

    return df.withColumn("error", error(F.col(vector)))


def score_autoencoder(df: DataFrame, net: Autoencoder, vector: str = "features", out: str = "score") -> DataFrame:
    """Error against the usual error through a sigmoid; the flag compares the raw error."""
    e = reconstruction_error(df, net, vector)
    return e.withColumns({out: sigmoid(3.0 * (F.col("error") / net.base_error - 1.0)),
                          "predicted": (F.col("error") >= net.threshold).cast("int")})


# ---- fusion -------------------------------------------------------------------------------------------


def _clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def combined_score(eif: Column, autoencoder: Column, forest: Column) -> Column:
    return _clip(0.50 * eif + 0.35 * autoencoder + 0.15 * forest)


def combined_score_pair(forest: Column, autoencoder: Column) -> Column:
    return _clip(0.30 * forest + 0.70 * autoencoder)


def combined_score_forests(eif: Column, forest: Column) -> Column:
    return _clip(0.7385 * eif + 0.2615 * forest)


def hybrid_batch(forest: Column, max_z: Column, z_norm: float = 5.0) -> Column:
    """Without a flow history: forest score and volume deviation only."""
    return _clip(0.55 * forest + 0.30 * sigmoid(max_z / z_norm * 5.0 - 2.5))


def hybrid_score(scores: DataFrame, threshold: float = 0.45, z_norm: float = 5.0, buffer: int = 10, hot_rows=None, parts=None) -> DataFrame:
    """Forest score, volume deviation and the rising trend of the flow's own combined scores.

    The trend is read before the current score joins the buffer, and what joins is the combined
    score, so a flow is a fold over its windows. Input: flow_key, ts_us, row_id, score, max_z.
    """
    def step(state, ts, score, z):
        boost = 0.0
        if len(state) >= 3:
            ts0 = state[0][0]
            t = [(a - ts0) / SECOND for a, _ in state]
            s = [b for _, b in state]
            tm, sm = sum(t) / len(t), sum(s) / len(s)
            den = sum((a - tm) ** 2 for a in t)
            slope = sum((a - tm) * (b - sm) for a, b in zip(t, s)) / den if den >= 1e-12 else 0.0
            if slope > 0:
                boost = min(1.0, slope * 20.0) * (sum(s[-3:]) / 3)
        volume = 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, z / z_norm * 5.0 - 2.5))))
        combined = max(0.0, min(1.0, 0.55 * score + 0.30 * volume + 0.15 * boost))
        return [*state[-(buffer - 1):], (ts, combined)], (volume, boost, combined)

    out = fold_runs(scores, ["flow_key"], ["ts_us", "row_id"], ["ts_us", "score", "max_z"], list, step,
                    "ewma_component double, temporal_boost double, combined double", None, hot_rows, parts)
    return out.withColumn("is_anomaly", F.col("combined") >= threshold)


# ---- conformal prediction and drift ----------------------------------------------------------------------


def conformal_pvalues(calibration: DataFrame, test: DataFrame, row_id: str = "row_id", epsilon: float = 0.05,
                      hot_rows=None, parts=None) -> DataFrame:
    """p = (calibration scores at or above + 1) / (n + 1) for every test row.

    Both sides count per distinct score and meet in one running count, so neither the
    calibration set nor a frequent score has to fit anywhere.
    """
    c = calibration.groupBy("score").agg(F.count(F.lit(1)).alias("_n"))
    t = test.select("score").distinct().withColumn("_n", F.lit(0).cast("bigint"))
    both = c.unionByName(t).groupBy("score").agg(F.sum("_n").alias("_n"))
    run = OrderedGroups(both, [], ["score"], hot_rows, parts).running(_below=Running("sum", F.col("_n"), inclusive=False)).df
    n = c.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("calibration_size")).withColumn("_all", F.lit(0))
    run = run.withColumn("_all", F.lit(0)).join(F.broadcast(n), "_all")
    p = (F.col("calibration_size") - F.col("_below") + 1) / (F.col("calibration_size") + 1)
    table = run.select("score", p.alias("p_value"), "calibration_size")
    out = test.join(table, "score")
    return out.withColumns({"is_anomaly": F.col("p_value") <= epsilon, "confidence": 1.0 - F.col("p_value")})


def conformal_coverage(pvalues: DataFrame, epsilon: float = 0.05) -> DataFrame:
    """False-positive rate against its guarantee, and detection rate, from rows with ``y``."""
    hit = (F.col("p_value") <= epsilon).cast("double")
    c = pvalues.agg(
        F.avg(F.when(F.col("y") == 0, hit)).alias("fpr"), F.avg(F.when(F.col("y") == 1, hit)).alias("tpr"),
        F.count(F.when(F.col("y") == 0, 1)).alias("n_normal"), F.count(F.when(F.col("y") == 1, 1)).alias("n_anomaly"),
        F.avg(hit).alias("anomaly_rate"))
    return c.withColumns({"significance": F.lit(epsilon), "fpr_valid": F.col("fpr") <= epsilon + 0.02})


def ks_drift(recent: DataFrame, historical: DataFrame, alpha: float = 0.01, hot_rows=None, parts=None) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov test on ``score`` from two running counts over the values."""
    a = recent.groupBy("score").agg(F.count(F.lit(1)).alias("_a")).withColumn("_b", F.lit(0).cast("bigint"))
    b = historical.groupBy("score").agg(F.count(F.lit(1)).alias("_b")).withColumn("_a", F.lit(0).cast("bigint"))
    both = a.unionByName(b).groupBy("score").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    run = OrderedGroups(both, [], ["score"], hot_rows, parts).running(
        _fa=Running("sum", F.col("_a")), _fb=Running("sum", F.col("_b"))).df
    totals = both.agg(F.sum("_a").alias("n1"), F.sum("_b").alias("n2")).withColumn("_all", F.lit(0))
    run = run.withColumn("_all", F.lit(0)).join(F.broadcast(totals), "_all")
    gap = F.abs(F.col("_fa") / F.col("n1") - F.col("_fb") / F.col("n2"))
    d = run.agg(F.max(gap).alias("statistic"), F.max("n1").alias("n1"), F.max("n2").alias("n2"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    en = F.sqrt(n1 * n2 / (n1 + n2))
    lam = (en + 0.12 + 0.11 / en) * F.col("statistic")
    tail = reduce(lambda x, y: x + y, [2.0 * (-1.0) ** (k - 1) * F.exp(-2.0 * k * k * lam * lam) for k in (1, 2, 3, 4)])
    p = F.when(lam <= 0, 1.0).otherwise(_clip(tail))
    critical = (1.628 if alpha <= 0.01 else 1.358) * F.sqrt((n1 + n2) / (n1 * n2))
    enough = (F.col("n1") >= 30) & (F.col("n2") >= 30)
    d = d.withColumns({"p_value": p, "critical": critical})
    drift = enough & ((F.col("statistic") > F.col("critical")) | (F.col("p_value") < alpha))
    return d.withColumns({"drift": drift, "severity": F.when(drift, F.when(F.col("statistic") > 2 * F.col("critical"), "CRITICAL").otherwise("WARNING"))})


def calibration_statistics(df: DataFrame, hot_rows=None, parts=None) -> DataFrame:
    v, n = F.col("score"), F.col("n")
    extra = {"size": F.sum("n"), "mean": F.sum(v * n) / F.sum("n"), "square": F.sum(v * v * n) / F.sum("n"),
             "min": F.min(v), "max": F.max(v)}
    out = order_statistics(df, "score", {"median": percentile_at(0.5)}, extra=extra, hot_rows=hot_rows, parts=parts)
    return out.withColumn("std", F.sqrt(F.greatest(F.col("square") - F.col("mean") ** 2, F.lit(0.0)))).drop("square")


# ---- composed pipelines --------------------------------------------------------------------------------------


def pca_2d(df: DataFrame, vector: str = "features") -> DataFrame:
    """Projection of the centred vectors on their two main axes."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = df.withColumn("_v", array_to_vector(F.col(vector)))
    centred = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(v).transform(v)
    out = PCA(k=2, inputCol="_c", outputCol="_p").fit(centred).transform(centred)
    xy = vector_to_array("_p")
    return out.withColumns({"pc1": xy[0], "pc2": xy[1]}).drop("_v", "_c", "_p")


def baseline_then_detect(windows: DataFrame, names: list[str], train: int = 20, trees: int = 100, threshold: float = 0.45,
                         cooldown_s: float = 60.0, seed: int = 42) -> DataFrame:
    """Train on the first ``train`` windows, then score the others and alert with a cooldown."""
    from packetloom.functions.scalars import score_severity
    from packetloom.operators.folds import cooldown

    numbered = OrderedGroups(windows, [], ["window_start_us"]).numbered("_n").df
    base = numbered.filter(F.col("_n") <= train)
    stats = fit_zscore(base, names)
    scaled = with_vector(apply_zscore(numbered, stats, names), names)
    forest = fit_forest(scaled.filter(F.col("_n") <= train), "window_start_us", trees=trees, seed=seed)
    later = score_forest(scaled.filter(F.col("_n") > train), forest)
    z = F.array_max(F.transform("features", lambda x: F.abs(x)))
    scored = later.withColumn("combined", hybrid_batch(F.col("score"), z))
    hits = scored.filter(F.col("combined") >= threshold).withColumn("_k", F.lit("windows"))
    kept = cooldown(hits.select("_k", "window_start_us", "combined", "features"), ["_k"], cooldown_s, order=("window_start_us",))
    out = top_contributors(kept, "features", names)
    return out.select("window_start_us", "combined", score_severity(F.col("combined")).alias("severity"), "contributors")


def score_flows(flows: DataFrame, names: list[str], keys: list[str], trees: int = 100, seed: int = 42) -> DataFrame:
    """Normalise flow features, train on them and score every flow, most anomalous first."""
    named = flows.withColumn("_id", F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))
    scaled = with_vector(apply_zscore(named, fit_zscore(named, names), names), names)
    forest = fit_forest(scaled, "_id", trees=trees, seed=seed)
    return score_forest(scaled, forest).select(*keys, "score").orderBy(F.desc("score"), *keys)


def retrain_with_feedback(training: DataFrame, hostile: DataFrame, names: list[str], row_id: str = "row_id",
                          least: int = 100, trees: int = 100, seed: int = 42):
    """Refit normalisation and forest on training plus confirmed hostile vectors.

    Needs ``least`` confirmations; returns None before that, else (statistics, forest).
    """
    if hostile.limit(least).count() < least:
        return None
    both = training.select(row_id, *names).unionByName(hostile.select(row_id, *names))
    stats = fit_zscore(both, names)
    scaled = with_vector(apply_zscore(both, stats, names), names)
    return stats, fit_forest(scaled, row_id, trees=trees, seed=seed)


def false_alarms(levels: DataFrame, hot_rows=None, parts=None) -> DataFrame:
    """Flows that went from HOSTILE back to BASELINE: ``flow_key, ts_us, row_id, score`` of the window that ended the alarm and
    ``windows``, how many were scored while it lasted. ``levels``: the rows of ``threat_levels``."""
    hostile = F.col("from_level") == "HOSTILE"
    rise = ((F.col("to_level") == "HOSTILE") & ~hostile).cast("int")
    run = OrderedGroups(levels, ["flow_key"], ["ts_us", "forced", "row_id"], hot_rows, parts).running(_alarm=Running("sum", rise)).df
    ended = hostile & (F.col("to_level") == "BASELINE")
    out = run.filter(hostile).groupBy("flow_key", "_alarm").agg(
        F.max(F.when(ended, F.struct("ts_us", "row_id", "score"))).alias("end"), F.count(F.when(F.col("forced") == 0, 1)).alias("windows"))
    return out.filter(F.col("end").isNotNull()).select("flow_key", "end.*", "windows")


def conformal_with_feedback(calibration: DataFrame, alarms: DataFrame, test: DataFrame, **kw) -> DataFrame:
    """Conformal p-values after false alarms: every window of one counts as a normal with the score the alarm ended on."""
    told = alarms.select(F.col("score"), F.explode(F.sequence(F.lit(1).cast("bigint"), "windows"))).select("score")
    return conformal_pvalues(calibration.select("score").unionByName(told), test, **kw)
