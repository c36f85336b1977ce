"""Column expressions: no Python runs for any of them."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def angles_to_unit(theta: Column, phi: Column) -> Column:
    """Unit vector of a polar and an azimuth angle."""
    return F.array(F.sin(theta) * F.cos(phi), F.sin(theta) * F.sin(phi), F.cos(theta))


def unit_to_angles(v: Column) -> Column:
    """struct(theta, phi) of a unit vector."""
    z = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v[2]))
    return F.struct(F.acos(z).alias("theta"), F.atan2(v[1], v[0]).alias("phi"))


def angles_to_frame(a1: Column, a2: Column, a3: Column) -> Column:
    """Three orthonormal vectors (array of arrays) of three rotation angles."""
    c1, s1, c2, s2, c3, s3 = F.cos(a1), F.sin(a1), F.cos(a2), F.sin(a2), F.cos(a3), F.sin(a3)
    return F.array(
        F.array(c2 * c3, c1 * s3 + s1 * s2 * c3, s1 * s3 - c1 * s2 * c3),
        F.array(-c2 * s3, c1 * c3 - s1 * s2 * s3, s1 * c3 + c1 * s2 * s3),
        F.array(s2, -s1 * c2, c1 * c2),
    )


def cross(a: Column, b: Column) -> Column:
    return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def dot(a: Column, b: Column) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def frame_to_angles(v1: Column, v2: Column) -> Column:
    """Rotation angles of a frame; the third axis is made right-handed, the gimbal case has a3 = 0."""
    v3 = cross(v1, v2)
    a2 = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v3[0])))
    free = F.abs(F.abs(a2) - math.pi / 2) > 2.220446049250313e-16
    return F.struct(F.when(free, F.atan2(-v3[1], v3[2])).otherwise(F.atan2(v2[2], v2[1])).alias("a1"), a2.alias("a2"), F.when(free, F.atan2(-v2[0], v1[0])).otherwise(F.lit(0.0)).alias("a3"))


def mean_diffusivity(l1: Column, l2: Column, l3: Column) -> Column:
    return (l1 + l2 + l3) / 3


def fractional_anisotropy(l1: Column, l2: Column, l3: Column) -> Column:
    """0 where all are 0."""
    top = (l1 - l2) * (l1 - l2) + (l2 - l3) * (l2 - l3) + (l3 - l1) * (l3 - l1)
    below = l1 * l1 + l2 * l2 + l3 * l3
    return F.when(below > 0, F.sqrt(top / (2 * below))).otherwise(F.lit(0.0))


def tensor_eigenvalues(d: Column) -> Column:
    """struct(l1, l2, l3, not_positive) of [xx yy zz xy xz yz], descending (closed form).

    Non-finite entries count as 0; negative eigenvalues become 0; either sets
    not_positive.
    """
    bad = F.exists(d, lambda x: F.isnan(x) | x.isNull() | (F.abs(x) == float("inf")))
    e = [F.when(F.isnan(d[i]) | d[i].isNull() | (F.abs(d[i]) == float("inf")), 0.0).otherwise(d[i]) for i in range(6)]
    q = (e[0] + e[1] + e[2]) / 3
    off = e[3] * e[3] + e[4] * e[4] + e[5] * e[5]
    p = F.sqrt(((e[0] - q) * (e[0] - q) + (e[1] - q) * (e[1] - q) + (e[2] - q) * (e[2] - q) + 2 * off) / 6)
    x, y, z = e[0] - q, e[1] - q, e[2] - q
    det = x * (y * z - e[5] * e[5]) - e[3] * (e[3] * z - e[5] * e[4]) + e[4] * (e[3] * e[5] - y * e[4])
    r = F.when(p > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / (2 * p * p * p)))).otherwise(0.0)
    angle = F.acos(r) / 3
    l1, l3 = q + 2 * p * F.cos(angle), q + 2 * p * F.cos(angle + 2 * math.pi / 3)
    l2 = 3 * q - l1 - l3
    return F.struct(F.greatest(l1, F.lit(0.0)).alias("l1"), F.greatest(l2, F.lit(0.0)).alias("l2"), F.greatest(l3, F.lit(0.0)).alias("l3"), (bad | (l3 < 0)).alias("not_positive"))


def fractions(c1: Column, c2: Column) -> Column:
    """struct(f_iso, f1, f2) of the nested fractions."""
    return F.struct(c1.alias("f_iso"), (c2 - c1 * c2).alias("f1"), (1 - c1 - c2 + c1 * c2).alias("f2"))


def log_normal(x: Column, mu: Column, sigma: Column) -> Column:
    """Log density; NaN where sigma is not positive."""
    r = (x - mu) / sigma
    return F.when(sigma > 0, -r * r / 2 - F.ln(sigma) - 0.5 * math.log(2 * math.pi)).otherwise(float("nan"))


def log_robust_normal(x: Column, mu: Column, sigma: Column, offset: float = 16.0) -> Column:
    """Normal for small residuals, with fourth-root tails."""
    r = (x - mu) / sigma
    tail = F.pow(r * r + offset, F.lit(0.25)) - offset**0.25
    return -2 * offset / offset**0.25 * tail - F.ln(sigma) - 0.5 * math.log(2 * math.pi)


#: Published polynomial approximations of I0 (relative error below 2e-7), for x <= 3.75 and above.
_I0_SMALL = (1.0, 3.5156229, 3.0899424, 1.2067492, 0.2659732, 0.0360768, 0.0045813)
_I0_LARGE = (0.39894228, 0.01328592, 0.00225319, -0.00157565, 0.00916281, -0.02057706, 0.02635537, -0.01647633, 0.00392377)


def _polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[-1])
    for c in coefficients[-2::-1]:
        out = out * x + c
    return out


def log_i0_scaled(x: Column) -> Column:
    """ln(I0(x) exp(-|x|))."""
    a = F.abs(x)
    small = F.ln(_polynomial(a * a / 14.0625, _I0_SMALL)) - a
    return F.when(a <= 3.75, small).otherwise(F.ln(_polynomial(3.75 / F.greatest(a, F.lit(3.75)), _I0_LARGE)) - 0.5 * F.ln(F.greatest(a, F.lit(3.75))))


def log_rice(x: Column, a: Column, sigma: Column) -> Column:
    """Log density of a Rice distribution (for reports; fits use exact Bessel functions)."""
    r = (x - F.abs(a)) / sigma
    return F.ln(x) - 2 * F.ln(sigma) - r * r / 2 + log_i0_scaled(x * a / (sigma * sigma))


def orientation_prior(v: Column, prior: Column, width: float = 25.0, noise: float = 0.04, offset: float = 0.0) -> Column:
    """Pseudo-datum: the angle to the prior in degrees over width / noise."""
    c = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(v, prior)))
    return offset + F.acos(c) * 180 / math.pi / (width / noise)


def direction_to_tensor(v: Column) -> Column:
    """Dyad of a direction, with 0.2 on the diagonal and the sign pattern of a left-handed frame."""
    return F.array(v[0] * v[0] + 0.2, -v[0] * v[1], v[1] * v[1] + 0.2, -v[0] * v[2], v[1] * v[2], v[2] * v[2] + 0.2)


def fold_periodic(theta: Column, periodic: tuple[int, ...], n: int) -> Column:
    """Modulo 2 pi for the (0-based) periodic parameters."""
    return F.array(*[F.pmod(theta[i], F.lit(2 * math.pi)) if i in periodic else theta[i] for i in range(n)])


def complex_to_real(re: Column, im: Column) -> Column:
    return F.flatten(F.array(re, im))


def phase_to_real(phase: Column) -> Column:
    """exp(i phase) as real parts, then imaginary parts."""
    return F.flatten(F.array(F.transform(phase, F.cos), F.transform(phase, F.sin)))


def sort_pairs(values: list[Column], vectors: list[Column]) -> Column:
    """array<struct(l, v)>, descending by l."""
    return F.reverse(F.array_sort(F.array(*[F.struct(a.alias("l"), b.alias("v")) for a, b in zip(values, vectors)])))


def halton(index: Column, base: int, digits: int = 40) -> Column:
    """Digit reversal of a positive integer in a prime base."""
    whole = index.cast("bigint")
    out = F.lit(0.0)
    for k in range(min(digits, int(52 / math.log2(base)))):
        out = out + F.floor(whole / base**k) % base * base ** -(k + 1.0)
    return out
