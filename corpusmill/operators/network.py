"""Networks and small matrices: sufficient statistics in Spark, dense algebra of a few variables on the driver."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.stats import spearman

#: Variables that a matrix on the driver may have.
MOST_VARIABLES = 64


def spearman_matrix(df: DataFrame) -> pd.DataFrame:
    """Pairwise-complete rank correlations of all columns; the driver gets one number a pair."""
    if len(df.columns) > MOST_VARIABLES:
        raise ValueError(f"at most {MOST_VARIABLES} variables")
    out = pd.DataFrame(np.eye(len(df.columns)), df.columns, df.columns)
    # ranks need an order of all rows; the number of distinct values bounds what one task holds
    for a, b in itertools.combinations(df.columns, 2):
        both = df.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull())
        ranks = []
        for c in (a, b):
            counts = both.groupBy(c).agg(F.count("*").alias("n"))
            from pyspark.sql.window import Window

            ranks.append(counts.select(c, (F.sum("n").over(Window.orderBy(c)) - (F.col("n") - 1) / 2.0).alias(f"r_{c}")))
        ranked = both.join(ranks[0], a).join(ranks[1], b)
        x, y = f"r_{a}", f"r_{b}"
        rho = ranked.agg(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))).first()[0]
        out.loc[a, b] = out.loc[b, a] = 0.0 if rho is None else rho
    return out


def graphical_lasso(s: np.ndarray, penalty: float, rounds: int = 200, tolerance: float = 1e-6) -> np.ndarray:
    """Sparse inverse of a correlation matrix, by coordinate descent over its columns (Friedman and others, 2008)."""
    p = len(s)
    w = s + penalty * np.eye(p)
    betas = np.zeros((p, p))
    for _ in range(rounds):
        last = w.copy()
        for j in range(p):
            rest = np.delete(np.arange(p), j)
            v, u, b = w[np.ix_(rest, rest)], s[rest, j], betas[rest, j].copy()
            for _ in range(rounds):
                old = b.copy()
                for k in range(p - 1):
                    r = u[k] - v[k] @ b + v[k, k] * b[k]
                    b[k] = np.sign(r) * max(abs(r) - penalty, 0) / v[k, k]
                if np.abs(b - old).max() < tolerance:
                    break
            betas[rest, j] = b
            w[rest, j] = w[j, rest] = v @ b
        if np.abs(w - last).max() < tolerance:
            break
    theta = np.zeros((p, p))
    for j in range(p):
        rest = np.delete(np.arange(p), j)
        theta[j, j] = 1 / (w[j, j] - w[rest, j] @ betas[rest, j])
        theta[rest, j] = -betas[rest, j] * theta[j, j]
    return (theta + theta.T) / 2


def partial_network(r: np.ndarray, n: int, gamma: float = 0.5, ratio: float = 0.1, steps: int = 30) -> np.ndarray:
    """Partial correlations of the lasso path's best extended BIC."""
    p = len(r)
    top = np.abs(r - np.eye(p)).max()
    best, chosen = math.inf, np.zeros((p, p))
    for penalty in np.exp(np.linspace(math.log(max(top, 1e-6)), math.log(max(top, 1e-6) * ratio), steps)):
        theta = graphical_lasso(r, penalty)
        sign, log_det = np.linalg.slogdet(theta)
        if sign <= 0:
            continue
        edges = np.count_nonzero(np.abs(np.triu(theta, 1)) > 1e-10)
        score = -n * (log_det - np.trace(r @ theta)) + edges * math.log(n) + 4 * edges * gamma * math.log(p)
        if score < best:
            d = np.sqrt(np.diag(theta))
            best, chosen = score, -theta / np.outer(d, d)
    np.fill_diagonal(chosen, 0)
    return chosen


def network(spark: SparkSession, correlations: pd.DataFrame, n: int) -> DataFrame:
    """Edges ``a, b, w`` of the partial-correlation network."""
    w = partial_network(correlations.to_numpy(), n)
    names = list(correlations.columns)
    rows = [(names[i], names[j], float(w[i, j])) for i, j in itertools.combinations(range(len(names)), 2)]
    return spark.createDataFrame(rows, "a string, b string, w double")


def strength(edges: DataFrame) -> DataFrame:
    """Sums of absolute and signed weights of each node's edges."""
    both = edges.select(F.col("a").alias("node"), "w").union(edges.select(F.col("b").alias("node"), "w"))
    return both.groupBy("node").agg(F.sum(F.abs("w")).alias("strength"), F.sum("w").alias("influence"))


def communities(w: np.ndarray, steps: int = 4) -> np.ndarray:
    """Walktrap: join the neighbours whose short random walks are most alike, and keep the cut of the best modularity."""
    a = np.abs(w)
    p = len(a)
    degree = a.sum(1)
    if not degree.any():
        return np.arange(p)
    live = np.where(degree > 0, degree, 1)
    walk = np.linalg.matrix_power(a / live[:, None], steps)
    group = {i: [i] for i in range(p)}
    mean = {i: walk[i] for i in range(p)}
    total = a.sum()

    def modularity() -> float:
        return sum(a[np.ix_(g, g)].sum() / total - (degree[g].sum() / total) ** 2 for g in group.values())

    best, kept = modularity(), {k: list(v) for k, v in group.items()}
    while len(group) > 1:
        cost = {}
        for x, y in itertools.combinations(group, 2):
            if a[np.ix_(group[x], group[y])].any():
                n, m = len(group[x]), len(group[y])
                cost[(x, y)] = n * m / (n + m) * (((mean[x] - mean[y]) ** 2) / live).sum()
        if not cost:
            break
        x, y = min(cost, key=lambda k: (cost[k], k))
        n, m = len(group[x]), len(group[y])
        mean[x] = (n * mean[x] + m * mean[y]) / (n + m)
        group[x] += group.pop(y)
        if (q := modularity()) > best + 1e-12:
            best, kept = q, {k: list(v) for k, v in group.items()}
    out = np.empty(p, int)
    for label, members in enumerate(sorted(kept.values(), key=min)):
        out[members] = label
    return out


def topological_overlap(w: np.ndarray) -> np.ndarray:
    """Weighted topological overlap of each pair of nodes."""
    a = np.abs(w)
    shared, k = a @ a, a.sum(1)
    out = (shared + a) / (np.minimum.outer(k, k) + 1 - a)
    np.fill_diagonal(out, 1)
    return out


def r_squared(r: np.ndarray, y: int, xs: tuple[int, ...]) -> float:
    if not xs:
        return 0.0
    v = r[list(xs), y]
    return float(v @ np.linalg.lstsq(r[np.ix_(xs, xs)], v, rcond=None)[0])


def relative_importance(spark: SparkSession, correlations: pd.DataFrame, target: str) -> DataFrame:
    """Mean gain of R squared over all orders (LMG), and the loss of leaving each out last."""
    names = list(correlations.columns)
    r, y = correlations.to_numpy(), names.index(target)
    xs = [i for i in range(len(names)) if i != y]
    if len(xs) > 12:
        raise ValueError("at most 12 predictors, as every subset is fitted")
    fit = {s: r_squared(r, y, s) for k in range(len(xs) + 1) for s in itertools.combinations(xs, k)}
    rows = []
    for x in xs:
        rest = [i for i in xs if i != x]
        lmg = 0.0
        for k in range(len(rest) + 1):
            weight = math.factorial(k) * math.factorial(len(xs) - k - 1) / math.factorial(len(xs))
            lmg += weight * sum(fit[tuple(sorted((*s, x)))] - fit[s] for s in itertools.combinations(rest, k))
        rows.append((names[x], lmg, fit[tuple(xs)] - fit[tuple(rest)]))
    return spark.createDataFrame(rows, "variable string, lmg double, last double")


def nmf_fit(df: DataFrame, col: str, k: int, rounds: int = 200, tolerance: float = 1e-4) -> np.ndarray:
    """Components of non-negative vectors, by multiplicative updates over all rows.

    In each round every task finds its rows' loadings on the components so far, and gives their
    products with the rows and with each other, which are of fixed size; the driver adds these up, by
    task, and updates the components. It ends early once no component changes by ``tolerance``.
    """
    vectors = df.where(F.col(col).isNotNull()).select(F.col(col).alias("x"))
    first = vectors.first()
    random = np.random.default_rng(42)
    h = random.random((k, len(first[0]) if first else 1)) + 0.1

    def sums(h):
        def run(batches):
            wx, ww = np.zeros(h.shape), np.zeros((k, k))
            for b in batches:
                if len(b):
                    x = np.stack([np.asarray(v, float) for v in b["x"]])
                    w = nmf_loadings_of(x, h)
                    wx, ww = wx + w.T @ x, ww + w.T @ w
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "wx": [wx.ravel()], "ww": [ww.ravel()]})

        return run

    for _ in range(rounds if first else 0):
        found = sorted(vectors.mapInPandas(sums(h), "part int, wx array<double>, ww array<double>").collect(), key=lambda r: r.part)
        wx = np.sum([r.wx for r in found], axis=0).reshape(h.shape)
        ww = np.sum([r.ww for r in found], axis=0).reshape(k, k)
        last = h
        for _ in range(10):
            h = h * wx / (ww @ h + 1e-12)
        if np.abs(h - last).max() <= tolerance * np.abs(last).max():
            break
    return h


def nmf_loadings_of(x: np.ndarray, h: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Loadings of vectors on fixed components."""
    w = np.full((len(x), len(h)), 1.0)
    for _ in range(rounds):
        w *= (x @ h.T) / (w @ h @ h.T + 1e-12)
    return w


def nmf_transform(df: DataFrame, key: str, col: str, h: np.ndarray, rounds: int = 50, keep: int = 0) -> DataFrame:
    """Loadings of every vector on fixed components; ``keep`` names the strongest alone."""
    kind = dict(df.dtypes)[key]

    def run(batches):
        for b in batches:
            x = np.stack([np.asarray(v, float) for v in b[col]]) if len(b) else np.zeros((0, h.shape[1]))
            w = nmf_loadings_of(x, h, rounds)
            yield pd.DataFrame({key: b[key], "component": w.argmax(1) if len(w) else [], "loading": w.max(1).round(4) if len(w) else []})

    return df.where(F.col(col).isNotNull()).select(key, col).mapInPandas(run, f"`{key}` {kind}, component int, loading double")
