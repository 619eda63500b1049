"""Rounding and tail probabilities; kernels over arrays are numpy, and run in grouped or batched UDFs."""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def signif(v: Column, digits: int) -> Column:
    """v rounded to significant digits; 0 stays."""
    e = F.floor(F.log10(F.abs(v)))
    return F.when(v == 0, F.lit(0.0)).otherwise(F.round(v / F.pow(F.lit(10.0), e), digits - 1) * F.pow(F.lit(10.0), e))


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """x rounded to decimal places, halves away from zero, as SQL does; nan stays and no zero is negative."""
    y = x * 10.0**digits
    return np.trunc(y + np.copysign(0.5, y)) / 10.0**digits + 0.0


def holm(p: str, by: str, tie: str) -> Column:
    """Holm's adjusted p-values within `by`."""
    w = W.partitionBy(by).orderBy(p, tie)
    n = F.count("*").over(W.partitionBy(by))
    return F.max(F.least(F.lit(1.0), (n - F.row_number().over(w) + 1) * F.col(p))).over(w)


def benjamini_hochberg(p: str, by: str, tie: str) -> Column:
    w = W.partitionBy(by).orderBy(p, tie)
    n = F.count("*").over(W.partitionBy(by))
    return F.min(F.least(F.lit(1.0), n / F.row_number().over(w) * F.col(p))).over(W.partitionBy(by).orderBy(F.desc(p), F.desc(tie)))


@functools.lru_cache(maxsize=4096)
def rank_sum_ways(n1: int, n2: int) -> tuple[int, ...]:
    """In how many ways n1 of n1 + n2 cells have each rank sum, from the least on: the last cell is of one side or the other."""
    ways = [[int(not k), *[0] * (n1 * n2)] for k in range(n1 + 1)]  # of k cells among those seen so far, shifted by the least sum
    for seen in range(1, n1 + n2 + 1):
        for k in range(min(seen, n1), max(0, seen - n2) - 1, -1):
            if k and seen > k - 1:
                low, shift = ways[k - 1], seen - k  # the cell of rank `seen` as the k-th: others of its side before it
                ways[k] = [a + (low[i - shift] if i >= shift else 0) for i, a in enumerate(ways[k])] if seen > k else low[:]
    return tuple(ways[n1])


def rank_sum_two_sided(w: int, n1: int, n2: int) -> float:
    """Exact p-value of the rank sum statistic w (from 0 to n1 * n2) without ties."""
    ways = rank_sum_ways(n1, n2)
    tail = sum(ways[w:]) if w > n1 * n2 / 2 else sum(ways[: w + 1])
    return min(1.0, 2 * tail / math.comb(n1 + n2, n1))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * scale)
    tiny, b = 1e-300, x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, scale * h)


def chi2_tail(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * h


def t_two_sided(t: float, df: float) -> float:
    return beta_i(df / 2, 0.5, df / (df + t * t)) if df > 0 else float("nan")


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Sum of the probabilities of tables as unlikely as this one or more so."""
    n1, n2, k = a + b, c + d, a + c
    lg = math.lgamma
    base = lg(n1 + 1) + lg(n2 + 1) + lg(k + 1) + lg(n1 + n2 - k + 1) - lg(n1 + n2 + 1)
    p = [math.exp(base - lg(x + 1) - lg(n1 - x + 1) - lg(k - x + 1) - lg(n2 - k + x + 1)) for x in range(max(0, k - n2), min(n1, k) + 1)]
    own = p[a - max(0, k - n2)]
    return min(1.0, sum(x for x in p if x <= own * (1 + 1e-7)))


def normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(min(1 - 1e-16, max(1e-300, p)))


def effect_size(p: float | None, n1: int, n2: int, power: float = 0.8) -> float | None:
    """Cohen's h that two proportions of n1 and n2 cases show with this power at level p."""
    if p is None or p != p:
        return None
    alpha = min(0.8, max(1e-100, p))
    return (-normal_quantile(alpha / 2) + normal_quantile(power)) * math.sqrt((n1 + n2) / (n1 * n2))


def assign(cost: np.ndarray) -> np.ndarray:
    """The column of each row in a least-cost matching (rows <= columns): shortest augmenting paths."""
    n, m = cost.shape
    if n > m:
        back = assign(cost.T)
        out = np.full(n, -1)
        out[back] = np.arange(m)
        return out
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            free = ~used[1:]
            cur = cost[match[j0] - 1] - u[match[j0]] - v[1:]
            better = free & (cur < low[1:])
            low[1:][better] = cur[better]
            way[1:][better] = j0
            j1 = int(np.where(free, low[1:], np.inf).argmin()) + 1
            delta = low[j1]
            u[match[used]] += delta
            v[used] -= delta
            low[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    out = np.empty(n, int)
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out
