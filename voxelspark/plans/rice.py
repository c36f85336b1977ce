"""The Rice density: exact Bessel functions, derivatives in the signal and in log sigma, and expected information."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from numpy.polynomial import chebyshev


def _series(terms: int, factor: Callable[[int], float]) -> list[float]:
    """1, then each coefficient as factor(k) times the one before."""
    return list(itertools.accumulate(range(1, terms), lambda c, k: c * factor(k), initial=1.0))


#: Of I0 and 2 I1 / x in x^2 / 4, and of both asymptotic series in 1 / (8 x).
_LOW = _series(45, lambda k: 1 / (k * k)), _series(45, lambda k: 1 / (k * (k + 1)))
_HIGH = _series(22, lambda k: (2 * k - 1) ** 2 / k), _series(22, lambda k: ((2 * k - 1) ** 2 - 4) / k)
_PIECE = 1 << 14


def _horner(c: list[float], x: np.ndarray) -> np.ndarray:
    out = np.full_like(x, c[-1])
    for k in c[-2::-1]:
        out *= x
        out += k
    return out


def bessel_ratio(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln(I0(x) exp(-x)) and I1(x) / I0(x) for x >= 0: power series up to 12, asymptotic series above, each for its own values only."""
    x = np.asarray(x, float)
    flat = x.ravel()
    value, ratio = np.empty_like(flat), np.empty_like(flat)
    for begin in range(0, len(flat), _PIECE):  # pieces that fit a cache
        here = flat[begin : begin + _PIECE]
        big = here > 12
        for at, far in ((np.flatnonzero(big), True), (np.flatnonzero(~big), False)):
            if not len(at):
                continue
            y = here[at]
            if far:
                i0, i1 = (_horner(c, 1 / (8 * y)) for c in _HIGH)
                value[begin + at], ratio[begin + at] = np.log(i0) - 0.5 * np.log(2 * np.pi * y), i1 / i0
            else:
                i0, i1 = (_horner(c, y * y / 4) for c in _LOW)
                value[begin + at], ratio[begin + at] = np.log(i0) - y, y / 2 * i1 / i0
    return value.reshape(x.shape), ratio.reshape(x.shape)


def rice_loglik(data: np.ndarray, a: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    x = data * np.abs(a) / sigma**2
    return np.log(data) - 2 * np.log(sigma) - (data - np.abs(a)) ** 2 / (2 * sigma**2) + bessel_ratio(x)[0]


def log_rice_logsigma(data: np.ndarray, a: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Log density at sigma = exp(s), its derivatives in a and s, and the second ones: value, a, s, aa, as, ss."""
    sign, a = np.where(a < 0, -1.0, 1.0), np.abs(a)
    v = np.exp(2 * s)
    z = data * a / v
    value, ratio = bessel_ratio(z)
    # derivative of I1 / I0; I1 / (I0 z) is 1/2 at 0
    turn = 1 - np.where(z > 1e-6, ratio / np.maximum(z, 1e-300), 0.5 - z * z / 16) - ratio * ratio
    value = np.log(data) - 2 * s - (data - a) ** 2 / (2 * v) + value
    of_a = (data * ratio - a) / v
    of_s = (data * data + a * a) / v - 2 - 2 * z * ratio
    of_aa = (data / v) ** 2 * turn - 1 / v
    of_as = -2 * of_a - 2 * data * z * turn / v
    of_ss = -2 * (data * data + a * a) / v + 4 * z * ratio + 4 * z * z * turn
    return value, sign * of_a, of_s, of_aa, sign * of_as, of_ss


def information_by_quadrature(a: np.ndarray, points: int = 400) -> np.ndarray:
    """Expected information at sigma 1 of each a >= 0: rows aa, as, ss (about a and log sigma)."""
    x, w = np.polynomial.legendre.leggauss(points)
    lo, hi = np.maximum(0, a - 13), a + 13
    t, dt = (hi - lo)[:, None] / 2 * x + ((hi + lo) / 2)[:, None], (hi - lo)[:, None] / 2 * w
    value, of_a, of_s, *_ = log_rice_logsigma(t, a[:, None] + 0 * t, np.zeros_like(t))
    p = np.exp(value) * dt
    return np.stack([(p * of_a * of_a).sum(1), (p * of_a * of_s).sum(1), (p * of_s * of_s).sum(1)])


_ENDS = (0.0, 1.0, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0, 16.0, 24.0, 32.0)
_DEGREE = 26


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Chebyshev coefficients of each stretch of a, and those in 1 / a^2 beyond the last; made once in a process."""
    nodes = np.cos(np.pi * (np.arange(_DEGREE + 1) + 0.5) / (_DEGREE + 1))
    fit = lambda values: chebyshev.chebfit(nodes, values.T, _DEGREE)
    near = [fit(information_by_quadrature((hi - lo) / 2 * nodes + (hi + lo) / 2)) for lo, hi in zip(_ENDS, _ENDS[1:])]
    u = (nodes + 1) / 2 / _ENDS[-1] ** 2
    values = information_by_quadrature(1 / np.sqrt(u))
    values[1] *= 1 / np.sqrt(u)  # about 1 / a far out
    return np.stack(near), chebyshev.chebfit(nodes, values.T, 8)


#: Cells to a unit of a, and the degree of the polynomial of each.
_CELLS, _LOCAL = 16, 6


@lru_cache(maxsize=1)
def _cells() -> np.ndarray:
    """The stretches in short cells: coefficients of powers of the place in its cell (-1/2 to 1/2) x aa, as, ss x cells."""
    near, _ = _tables()
    nodes = np.cos(np.pi * (np.arange(_LOCAL + 1) + 0.5) / (_LOCAL + 1)) / 2
    a = (np.arange(int(_ENDS[-1]) * _CELLS)[:, None] + 0.5 + nodes) / _CELLS
    values = np.empty((3, *a.shape))
    for k, (lo, hi) in enumerate(zip(_ENDS, _ENDS[1:])):
        at = slice(int(lo) * _CELLS, int(hi) * _CELLS)
        values[:, at] = chebyshev.chebval((2 * a[at] - lo - hi) / (hi - lo), near[k])
    return np.ascontiguousarray((values @ np.linalg.inv(np.vander(nodes, increasing=True)).T).transpose(2, 0, 1))


def rice_information_joint(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected information of a Rice distribution about its location and its log sigma, at sigma 1: aa, as, ss. Within 1e-11 of quadrature."""
    cells, far = _cells(), _tables()[1]
    a = np.asarray(a, float)
    flat = np.abs(a).ravel()
    place = np.minimum(flat, _ENDS[-1]) * _CELLS
    cell = np.minimum(place.astype(int), cells.shape[2] - 1)
    place -= cell + 0.5
    out = cells[-1].take(cell, 1)
    for c in cells[-2::-1]:
        out *= place
        out += c.take(cell, 1)
    at = np.flatnonzero(~(flat < _ENDS[-1]))
    if len(at):
        out[:, at] = chebyshev.chebval(2 * (_ENDS[-1] / flat[at]) ** 2 - 1, far)
        out[1, at] /= flat[at]
    return tuple(x.reshape(a.shape) for x in out)


def rice_information(a: np.ndarray) -> np.ndarray:
    """Expected information of a Rice distribution about its location, at sigma 1."""
    return rice_information_joint(a)[0]
