"""Scores between Gaussians: closed forms for diagonal covariances as columns, and general ones as Arrow functions.

A Gaussian has a mean, a diagonal of variances and, in the general case, a factor with Sigma = diag(v) + L L'.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldspar.functions.vectors import Vec, col, squared_distance, total, zip_total

FLOOR = 1e-9


def floored(x: Column, floor: float = FLOOR) -> Column:
    return F.greatest(x, F.lit(floor))


def trace(sigma: Vec, factor: Vec | None = None) -> Column:
    """Trace of the covariance; a null factor counts as none."""
    out = total(col(sigma))
    if factor is None:
        return out
    flat = F.flatten(F.coalesce(col(factor), F.array().cast("array<array<double>>")))
    return out + F.aggregate(flat, F.lit(0.0), lambda s, v: s + v * v)


def confidence(tr: Column) -> Column:
    return 1 / (1 + F.greatest(tr, F.lit(0.0)))


def uncertainty(conf: Column) -> Column:
    return F.when(conf >= 0.5, "low").when(conf >= 0.2, "medium").otherwise("high")


def elk_diagonal(mu_q: Vec, var_q: Vec | None, mu_d: Vec, var_d: Vec) -> Column:
    """Logarithm of the expected-likelihood kernel over the dimension, without its constant; higher is better.

    ``var_q`` None is a point query, whose variances count as the floor.
    """
    var = F.transform(col(var_d), lambda v: floored(v)) if var_q is None else None
    spread = F.transform(var, lambda v: v + FLOOR) if var is not None else F.zip_with(col(var_q), col(var_d), lambda a, b: floored(a) + floored(b))
    gap = F.zip_with(col(mu_q), col(mu_d), lambda a, b: (a - b) * (a - b))
    mahal = zip_total(gap, spread, lambda g, v: g / v)
    logs = F.aggregate(spread, F.lit(0.0), lambda s, v: s + F.ln(v))
    return -0.5 * (F.greatest(mahal, F.lit(0.0)) + logs) / F.size(col(mu_d))


def elk_rank_one(mu_q: Vec, var_q: Vec | None, mu_d: Vec, var_d: Vec, weight: float) -> Column:
    """The same with a document factor L = var_d (outer) w of squared norm ``weight`` of w, by Sherman and Morrison."""
    q = F.transform(col(mu_d), lambda _: F.lit(FLOOR)) if var_q is None else F.transform(col(var_q), lambda v: floored(v))
    spread = F.zip_with(q, F.transform(col(var_d), lambda v: floored(v)), lambda a, b: a + b)
    gap = F.zip_with(col(mu_q), col(mu_d), lambda a, b: a - b)
    mahal = zip_total(F.transform(gap, lambda g: g * g), spread, lambda g, v: g / v)
    s = zip_total(F.transform(col(var_d), lambda v: v * v), spread, lambda x, v: x / v)
    t = zip_total(F.zip_with(col(var_d), gap, lambda v, g: v * g), spread, lambda x, v: x / v)
    logs = F.aggregate(spread, F.lit(0.0), lambda a, v: a + F.ln(v)) + F.ln(1 + weight * s)
    return -0.5 * (F.greatest(mahal - weight * t * t / (1 + weight * s), F.lit(0.0)) + logs) / F.size(col(mu_d))


def bures_diagonal(a: Vec, b: Vec) -> Column:
    root = zip_total(a, b, lambda x, y: F.sqrt(floored(floored(x) * y)))
    return F.greatest(total(col(a)) + total(col(b)) - 2 * root, F.lit(0.0))


def wasserstein_diagonal(mu_a: Vec, a: Vec, mu_b: Vec, b: Vec) -> Column:
    return F.sqrt(squared_distance(mu_a, mu_b) + bures_diagonal(a, b))


def fisher_rao_diagonal(mu_a: Vec, a: Vec, mu_b: Vec, b: Vec) -> Column:
    logs = zip_total(a, b, lambda x, y: F.pow(F.ln(floored(floored(y) / floored(x))), 2))
    return F.sqrt(squared_distance(mu_a, mu_b) + logs)


def _log_determinant(x: Vec) -> Column:
    product = F.aggregate(col(x), F.lit(1.0), lambda s, v: s * v)
    return F.ln(floored(product))


def kl_diagonal(mu_a: Vec, a: Vec, mu_b: Vec, b: Vec) -> Column:
    """KL(a || b); both determinants are floored, so their logarithms cancel in high dimension."""
    ratio = zip_total(a, b, lambda x, y: x / y)
    gap = F.zip_with(col(mu_a), col(mu_b), lambda x, y: (x - y) * (x - y))
    return 0.5 * (_log_determinant(b) - _log_determinant(a) - F.size(col(a)) + ratio + zip_total(gap, b, lambda g, v: g / v))


def bhattacharyya_diagonal(mu_a: Vec, a: Vec, mu_b: Vec, b: Vec) -> Column:
    middle = F.zip_with(col(a), col(b), lambda x, y: (x + y) / 2)
    gap = F.zip_with(col(mu_a), col(mu_b), lambda x, y: (x - y) * (x - y))
    return zip_total(gap, middle, lambda g, v: g / v) / 8 + 0.5 * (_log_determinant(middle) - 0.5 * (_log_determinant(a) + _log_determinant(b)))


# General covariances: Arrow batches, in which the rows of one shape are computed together as stacked matrices.


def _shapes(*columns: pd.Series):
    """Places of the rows without a null, and their arrays, by shape: ``(places, stacked arrays)``."""
    groups: dict[tuple, list[int]] = {}
    rows = list(zip(*columns))
    for i, row in enumerate(rows):
        if not any(x is None for x in row):
            groups.setdefault(tuple(np.shape(x) for x in row), []).append(i)
    for places in groups.values():
        yield places, [np.stack([rows[i][c] for i in places]) for c in range(len(columns))]


def _factor(value, d: int) -> np.ndarray:
    """A factor's columns, as a matrix of d rows."""
    if value is None or len(value) == 0:
        return np.zeros((d, 0))
    return np.stack([np.asarray(c, float) for c in value], axis=1)


def elk_low_rank_matrix(mu_q, var_q, l_q, mu_d, var_d, l_d) -> np.ndarray:
    """With D the sum of the floored diagonals and U both factors, by Woodbury and Sylvester; leading axes are batches."""
    d = mu_q.shape[-1]
    spread = np.maximum(var_q, FLOOR) + np.maximum(var_d, FLOOR)
    gap = mu_q - mu_d
    u = np.concatenate([l_q, l_d], axis=-1)
    mahal, logdet = (gap * gap / spread).sum(axis=-1), np.log(spread).sum(axis=-1)
    if u.shape[-1]:
        m = np.eye(u.shape[-1]) + np.einsum("...ir,...i,...is->...rs", u, 1 / spread, u)
        c = np.linalg.cholesky(m)
        y = np.linalg.solve(c, np.einsum("...ir,...i->...r", u, gap / spread)[..., None])[..., 0]
        mahal = np.maximum(mahal - (y * y).sum(axis=-1), 0.0)
        logdet = logdet + 2 * np.log(np.diagonal(c, axis1=-2, axis2=-1)).sum(axis=-1)
    return -0.5 * (mahal + logdet) / d


@F.pandas_udf(T.DoubleType())
def elk_low_rank(mu_q: pd.Series, var_q: pd.Series, l_q: pd.Series, mu_d: pd.Series, var_d: pd.Series, l_d: pd.Series) -> pd.Series:
    """ELK with factors of any rank; null variances of the query count as zeros, null factors as none."""
    out = np.full(len(mu_q), np.nan)
    size = [0 if m is None else len(m) for m in mu_d]
    zeros = pd.Series([np.zeros(n) if v is None else v for v, n in zip(var_q, size)], index=mu_q.index, dtype=object)
    lq, ld = (pd.Series([_factor(x, n) for x, n in zip(c, size)], index=mu_q.index, dtype=object) for c in (l_q, l_d))
    for places, stacked in _shapes(mu_q, zeros, lq, mu_d, var_d, ld):
        out[places] = elk_low_rank_matrix(*stacked)
    return pd.Series(out).astype(object).where(~np.isnan(out), None).astype("float64")


def clipped(s: np.ndarray, floor: float = FLOOR) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, floored, and eigenvectors of the symmetric part."""
    w, v = np.linalg.eigh((s + np.swapaxes(s, -1, -2)) / 2)
    return np.maximum(w, floor), v


def elk_matrix(m1, s1, m2, s2) -> float:
    """ELK of full covariances, whose eigenvalues, and those of their sum, are floored."""
    both = sum((v * w) @ v.T for w, v in (clipped(np.nan_to_num(s)) for s in (s1, s2)))
    w, v = clipped(both)
    gap = v.T @ (m1 - m2)
    return float(-0.5 * ((gap * gap / w).sum() + np.log(w).sum()) / max(len(m1), 1))


def kl_matrix(m1, s1, m2, s2, floor: float = FLOOR) -> float:
    """KL(1 || 2); both determinants are floored."""
    inverse = np.linalg.inv(s2)
    gap = m2 - m1
    logs = np.log(max(np.linalg.det(s2), floor)) - np.log(max(np.linalg.det(s1), floor))
    return float(0.5 * (logs - len(m1) + np.trace(inverse @ s1) + gap @ inverse @ gap))


def bhattacharyya_matrix(m1, s1, m2, s2, floor: float = FLOOR) -> float:
    middle = (s1 + s2) / 2
    gap = m1 - m2
    dets = [max(np.linalg.det(s), floor) for s in (middle, s1, s2)]
    return float(gap @ np.linalg.solve(middle, gap) / 8 + 0.5 * (np.log(dets[0]) - 0.5 * (np.log(dets[1]) + np.log(dets[2]))))


def spd_root(s: np.ndarray, floor: float = FLOOR) -> np.ndarray:
    w, v = np.linalg.eigh((s + s.T) / 2)
    return (v * np.sqrt(np.maximum(w, floor))) @ v.T


def spd_log(s: np.ndarray, floor: float = FLOOR) -> np.ndarray:
    w, v = np.linalg.eigh((s + s.T) / 2)
    return (v * np.log(np.maximum(w, floor))) @ v.T


def spd_project(s: np.ndarray, floor: float = 1e-6) -> np.ndarray:
    w, v = np.linalg.eigh((s + s.T) / 2)
    return (v * np.maximum(w, floor)) @ v.T


def geodesic(s1: np.ndarray, s2: np.ndarray, t: float) -> np.ndarray:
    """Point at ``t`` on the affine-invariant geodesic from s1 to s2."""
    w, v = np.linalg.eigh(spd_project(s1))
    root, inverse = (v * np.sqrt(w)) @ v.T, (v / np.sqrt(w)) @ v.T
    u, x = np.linalg.eigh(spd_project(inverse @ spd_project(s2) @ inverse))
    return root @ ((x * u**t) @ x.T) @ root


def full(var: np.ndarray, factor: np.ndarray) -> np.ndarray:
    return np.diag(var) + factor @ factor.T


def wasserstein_matrix(m1, s1, m2, s2) -> float:
    r = spd_root(s1)
    bures = max(float(np.trace(s1) + np.trace(s2) - 2 * np.trace(spd_root(r @ s2 @ r))), 0.0)
    return float(np.sqrt(((m1 - m2) ** 2).sum() + bures))


def fisher_rao_matrix(m1, s1, m2, s2) -> float:
    w, v = np.linalg.eigh((s1 + s1.T) / 2)
    i = (v / np.sqrt(np.maximum(w, FLOOR))) @ v.T
    return float(np.sqrt(((m1 - m2) ** 2).sum() + (spd_log(i @ s2 @ i) ** 2).sum()))


def _pairwise(f):
    @F.pandas_udf(T.DoubleType())
    def apply(mu_a: pd.Series, var_a: pd.Series, l_a: pd.Series, mu_b: pd.Series, var_b: pd.Series, l_b: pd.Series) -> pd.Series:
        out = []
        for m1, v1, l1, m2, v2, l2 in zip(mu_a, var_a, l_a, mu_b, var_b, l_b):
            if any(x is None for x in (m1, v1, m2, v2)):
                out.append(None)
                continue
            m1, m2 = np.asarray(m1, float), np.asarray(m2, float)
            s1, s2 = full(np.asarray(v1, float), _factor(l1, len(m1))), full(np.asarray(v2, float), _factor(l2, len(m2)))
            out.append(f(m1, s1, m2, s2))
        return pd.Series(out, dtype="float64")

    return apply


wasserstein = _pairwise(wasserstein_matrix)
fisher_rao = _pairwise(fisher_rao_matrix)
elk_dense = _pairwise(elk_matrix)
kl = _pairwise(kl_matrix)
bhattacharyya = _pairwise(bhattacharyya_matrix)


def diagonal_plus_low_rank(cov: np.ndarray, rank: int, floor: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """The diagonal, floored, and the ``rank`` largest eigenpairs of what is off it, as a factor."""
    cov = (cov + cov.T) / 2
    diagonal = np.maximum(np.diag(cov), floor)
    w, v = np.linalg.eigh(cov - np.diag(diagonal))
    top = np.argsort(w)[::-1][:rank]
    return diagonal, v[:, top] * np.sqrt(np.maximum(w[top], 0))
