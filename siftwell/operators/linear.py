"""Regressions: sums over rows in the cluster, small systems on the driver.

A design is a list of named columns plus categorical terms coded against their first level. Every partition adds up X'WX and
X'Wz over its Arrow batches, Spark adds up the partitions, and only matrices of the size of the design reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TERMS = 200


@dataclass
class Fit:
    names: list[str]
    coef: np.ndarray
    cov: np.ndarray
    n: int
    scale: float = 1.0

    def p(self, name: str) -> float:
        """Two-sided normal p-value of a coefficient."""
        i = self.names.index(name)
        se = math.sqrt(max(self.cov[i, i], 0.0))
        return math.erfc(abs(self.coef[i]) / se / math.sqrt(2)) if se else float("nan")

    def __getitem__(self, name: str) -> float:
        return float(self.coef[self.names.index(name)])


def design(df: DataFrame, numeric: list[str], categories: list[str] = ()) -> list[tuple[str, Column]]:
    """Names and columns of an intercept, the numeric terms and the levels of the categorical terms but the first."""
    terms: list[tuple[str, Column]] = [("Intercept", F.lit(1.0)), *((c, F.col(c).cast("double")) for c in numeric)]
    for c in categories:
        levels = sorted(r[0] for r in df.select(c).distinct().limit(MAX_TERMS + 1).collect() if r[0] is not None)
        terms += [(f"{c}={level}", (F.col(c) == level).cast("double")) for level in levels[1:]]
    if len(terms) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms")
    return terms


def _flat(df: DataFrame, terms: list[Column], y: str, by: str | None = None, cluster: str | None = None) -> DataFrame:
    """x, y, key, cluster: the design as one array per row, for the Arrow passes."""
    key = F.col(by).cast("string") if by else F.lit("")
    return df.select(F.array(*(t.cast("double") for t in terms)).alias("x"), F.col(y).cast("double").alias("y"), key.alias("key"), (F.col(cluster).cast("string") if cluster else F.lit("")).alias("cluster"))


def _arrays(batch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
    return x, batch.column(1).to_numpy(zero_copy_only=False), np.array(batch.column(2).to_pylist(), object)


def _sums(rows: DataFrame, k: int, size: int, part) -> dict[str, np.ndarray]:
    """Per key the sum of part(x, y, key), a vector of `size` numbers: added up in each partition, then over partitions."""

    def run(batches):
        total: dict = {}
        for batch in batches:
            if batch.num_rows:
                x, y, keys = _arrays(batch, k)
                for key in set(keys):
                    own = keys == key
                    total[key] = total.get(key, 0.0) + part(x[own], y[own], key)
        for key, values in total.items():
            columns = [pa.array([key] * size), pa.array(np.arange(size, dtype=np.int32)), pa.array(values)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "i", "value"])

    summed = rows.mapInArrow(run, "key string, i int, value double").groupBy("key", "i").agg(F.sum("value").alias("value"))
    out: dict[str, np.ndarray] = {}
    for r in summed.collect():
        out.setdefault(r.key, np.zeros(size))[r.i] = r.value
    return out


def _system(weigh):
    """A part for _sums: X'WX, X'Wz, z'Wz and n, where weigh(x, y, key) gives W and z."""

    def part(x, y, key):
        w, z = weigh(x, y, key)
        return np.concatenate([((x * w[:, None]).T @ x).ravel(), x.T @ (w * z), [float((w * z * z).sum()), len(y)]])

    return part


def _split(values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, float, int]:
    return values[: k * k].reshape(k, k), values[k * k : k * k + k], float(values[-2]), int(values[-1])


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(a, b, rcond=None)[0]


def _plain(x, y, key):
    return np.ones(len(y)), y


def _logit(coef: dict[str, np.ndarray]):
    def weigh(x, y, key):
        mu = 1 / (1 + np.exp(-(x @ coef[key])))
        w = np.maximum(mu * (1 - mu), 1e-300)
        return w, (y - mu) / w

    return weigh


def least_squares(df: DataFrame, y: str, numeric: list[str], categories: list[str] = (), robust: str | None = None) -> Fit:
    """Ordinary least squares; robust='HC3' weights squared residuals by (1 - leverage)^-2."""
    kept = df.dropna(subset=[y, *numeric, *categories])
    terms = design(kept, numeric, categories)
    names, k = [n for n, _ in terms], len(terms)
    rows = _flat(kept, [c for _, c in terms], y)
    a, b, yy, n = _split(_sums(rows, k, k * k + k + 2, _system(_plain))[""], k)
    inverse = np.linalg.pinv(a)
    coef = inverse @ b
    residual = max(yy - coef @ b, 0.0) / max(n - np.linalg.matrix_rank(a), 1)
    if robust != "HC3":
        return Fit(names, coef, residual * inverse, n, residual)

    def hc3(x, y, key):
        leverage = np.minimum(np.einsum("ij,jk,ik->i", x, inverse, x), 1 - 1e-9)
        return ((y - x @ coef) / (1 - leverage)) ** 2, np.zeros(len(y))

    middle, *_ = _split(_sums(rows, k, k * k + k + 2, _system(hc3))[""], k)
    return Fit(names, coef, inverse @ middle @ inverse, n, residual)


def _iterate(rows: DataFrame, k: int, keys: list[str], rounds: int, tolerance: float) -> tuple[dict, dict]:
    """Coefficients and last systems of a logistic regression per key, all advanced by the same pass over the rows."""
    coef = {key: np.zeros(k) for key in keys}
    systems: dict = {}
    for _ in range(rounds):
        sums = _sums(rows, k, k * k + k + 2, _system(_logit(coef)))
        systems = {key: _split(v, k) for key, v in sums.items()}
        moved = 0.0
        for key, (a, b, _, _) in systems.items():
            step = _solve(a, b)
            coef[key] = coef[key] + step
            moved = max(moved, float(np.abs(step).max()))
        if moved < tolerance:
            break
    return coef, systems


def logistic(df: DataFrame, y: str, numeric: list[str], categories: list[str] = (), cluster: str | None = None, rounds: int = 25, tolerance: float = 1e-8) -> Fit:
    """Logistic regression by reweighted least squares, one pass a round; `cluster` gives the cluster-robust covariance."""
    kept = df.dropna(subset=[y, *numeric, *categories])
    terms = design(kept, numeric, categories)
    names, k = [n for n, _ in terms], len(terms)
    rows = _flat(kept, [c for _, c in terms], y, cluster=cluster).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        coef, systems = _iterate(rows, k, [""], rounds, tolerance)
        beta, (a, _, _, n) = coef[""], systems[""]
        bread = np.linalg.pinv(a)
        if cluster is None:
            return Fit(names, beta, bread, n)
        eta = F.aggregate(F.zip_with("x", F.array(*(F.lit(float(c)) for c in beta)), lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
        scored = rows.select("cluster", "x", (F.col("y") - 1 / (1 + F.exp(-eta))).alias("r"))
        sums = scored.groupBy("cluster").agg(*(F.sum(F.col("r") * F.col("x")[i]).alias(f"s{i}") for i in range(k)))
        flat = sums.select(F.array(*(f"s{i}" for i in range(k))).alias("x"), F.lit(0.0).alias("y"), F.lit("").alias("key"))
        meat, _, _, groups = _split(_sums(flat, k, k * k + k + 2, _system(_plain))[""], k)
    finally:
        rows.unpersist()
    correction = groups / max(groups - 1, 1) * (n - 1) / max(n - k, 1)
    return Fit(names, beta, correction * bread @ meat @ bread, n)


def logistic_by(df: DataFrame, by: str, y: str, x: list[Column], rounds: int = 25, tolerance: float = 1e-8) -> dict[str, Fit]:
    """A logistic regression of each group; x holds the columns, intercept included."""
    groups = [r[0] for r in df.select(by).distinct().limit(MAX_TERMS + 1).collect()]
    if len(groups) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} groups")
    rows = _flat(df, x, y, by=by).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        coef, systems = _iterate(rows, len(x), groups, rounds, tolerance)
    finally:
        rows.unpersist()
    return {g: Fit([f"x{i}" for i in range(len(x))], coef[g], np.linalg.pinv(systems[g][0]), systems[g][3]) for g in groups}


def held_out_errors(cells: DataFrame, y: str, numeric: list[str], categories: list[str], fold: str) -> tuple[float, int]:
    """(mean absolute error, n) of leave-one-fold-out least squares: each fold's system is the total less its own sums."""
    kept = cells.dropna(subset=[y, *numeric, *categories])
    terms = design(kept, numeric, categories)
    k = len(terms)
    rows = _flat(kept, [c for _, c in terms], y, by=fold)
    parts = {f: _split(v, k) for f, v in _sums(rows, k, k * k + k + 2, _system(_plain)).items()}
    total = sum(p[0] for p in parts.values()), sum(p[1] for p in parts.values())
    beta = {f: _solve(total[0] - p[0], total[1] - p[1]) for f, p in parts.items()}
    errors = _sums(rows, k, 2, lambda x, y, key: np.array([np.abs(y - x @ beta[key]).sum(), len(y)]))
    n = int(sum(e[1] for e in errors.values()))
    return float(sum(e[0] for e in errors.values()) / n), n


def mixed_model(y: np.ndarray, x: np.ndarray, z: np.ndarray, groups: np.ndarray, reml: bool = True) -> dict:
    """Linear mixed model with random effects z per group, for tables of cells: coef, cov, random covariance, scale, loglik."""
    whole = np.column_stack([x, z, y])
    return mixed_model_of_sums([whole[groups == g].T @ whole[groups == g] for g in np.unique(groups)], x.shape[1], z.shape[1], len(y), reml)


def mixed_model_of_sums(grams: list[np.ndarray], k: int, q: int, n: int, reml: bool = True) -> dict:
    """The model from each group's sums of products of (x, z, y), so that the rows themselves may stay where they are.

    The profiled likelihood is minimised over the Cholesky factor F of the relative covariance by the simplex method. The
    inverse of I + Z F F'Z' is I - Z F (I + F'Z'Z F)^-1 F'Z', so only matrices of the random effects' size are solved.
    """
    index = np.tril_indices(q)
    fixed = [*range(k), k + q]  # x and y

    def system(theta):
        factor = np.zeros((q, q))
        factor[index] = theta
        total, logdet = np.zeros((k + 1, k + 1)), 0.0
        for gram in grams:
            inner = np.eye(q) + factor.T @ gram[k : k + q, k : k + q] @ factor
            side = factor.T @ gram[np.ix_(range(k, k + q), fixed)]
            total += gram[np.ix_(fixed, fixed)] - side.T @ np.linalg.solve(inner, side)
            logdet += np.linalg.slogdet(inner)[1]
        xx, xy, yy = total[:k, :k], total[:k, k], total[k, k]
        beta = np.linalg.lstsq(xx, xy, rcond=None)[0]
        rss = max(yy - beta @ xy, 1e-300)
        m = n - k if reml else n
        loss = m * math.log(rss / m) + logdet + (np.linalg.slogdet(xx)[1] if reml else 0.0)
        return loss, beta, xx, rss / m, factor @ factor.T

    start = np.eye(q)[index] * 0.5
    best = simplex(lambda t: system(t)[0], start)
    loss, beta, xx, scale, psi = system(best)
    return {"coef": beta, "cov": scale * np.linalg.pinv(xx), "random": scale * psi, "scale": scale, "loglik": -loss / 2}


def simplex(f, start: np.ndarray, rounds: int = 2000, tolerance: float = 1e-10) -> np.ndarray:
    """Nelder-Mead minimiser."""
    points = [start, *(start + 0.4 * e for e in np.eye(len(start)))]
    values = [f(p) for p in points]
    for _ in range(rounds):
        order = np.argsort(values)
        points, values = [points[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) < tolerance:
            break
        centre = np.mean(points[:-1], axis=0)
        reflected = 2 * centre - points[-1]
        fr = f(reflected)
        if fr < values[0]:
            further = centre + 2 * (centre - points[-1])
            fe = f(further)
            points[-1], values[-1] = (further, fe) if fe < fr else (reflected, fr)
        elif fr < values[-2]:
            points[-1], values[-1] = reflected, fr
        else:
            inner = centre + 0.5 * (points[-1] - centre)
            fi = f(inner)
            if fi < values[-1]:
                points[-1], values[-1] = inner, fi
            else:
                points = [points[0], *(points[0] + 0.5 * (p - points[0]) for p in points[1:])]
                values = [values[0], *(f(p) for p in points[1:])]
    return points[int(np.argmin(values))]


def marginal_r2(x: np.ndarray, fit: dict) -> float:
    """Share of the variance of the fixed effects' predictions in that, the random effects' and the residual variance."""
    fixed = float(np.var(x @ fit["coef"]))
    return fixed / (fixed + float(np.trace(fit["random"])) + fit["scale"])
