"""Maps of a stored theta, for every built-in model: column expressions only, no fit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelspark.functions import columns as C
from voxelspark.plans.models import FitOptions

Maps = dict[str, Column]
LEAST_S0 = 1e-10  # keeps the likelihood of an empty voxel finite


def _s0(t: Column) -> Column:
    return F.greatest(t, F.lit(LEAST_S0))


def tensor_of(values: list[Column], vectors: list[Column]) -> Column:
    """[xx yy zz xy xz yz] of eigenvalues and their vectors."""
    entry = lambda i, j: sum((l * v[i] * v[j] for l, v in zip(values[1:], vectors[1:])), values[0] * vectors[0][i] * vectors[0][j])  # noqa: E731, E741
    return F.array(*[entry(i, j) for i, j in ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2))])


def _tensor(t: Column, values: list[Column], f: Column, s0: Column) -> Maps:
    frame = C.angles_to_frame(t[0], t[1], t[2])
    pairs = C.sort_pairs(values, [frame[i] for i in range(3)])
    out = {"s0": _s0(s0), "f_tensor": f, "f_iso": 1 - f, "fa": C.fractional_anisotropy(*values), "md": C.mean_diffusivity(*values)}
    out |= {f"l{i + 1}": pairs[i]["l"] for i in range(3)} | {f"v{i + 1}": pairs[i]["v"] for i in range(3)}
    return out | {"dt": tensor_of(values, [frame[i] for i in range(3)])}


def _axial(v: Column, par: Column, perp: Column) -> Column:
    one = [F.when(F.lit(i < 3), perp).otherwise(F.lit(0.0)) for i in range(6)]
    return F.array(*[p + (par - perp) * v[i] * v[j] for p, (i, j) in zip(one, ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2)))])


def _pick(swap: Column, a: Column, b: Column) -> Column:
    return F.when(swap, b).otherwise(a)


def _dual(c: list[Column], o: FitOptions) -> Maps:
    """Two axial tensors and a ball; tensor 1 has the larger fraction."""
    fr, par = C.fractions(c[0], c[1]), c[2] * o.d_max
    swap = fr["f1"] < fr["f2"]
    v = C.angles_to_unit(c[5], c[6]), C.angles_to_unit(c[7], c[8])
    perp = c[3] * par, c[4] * par
    out = {"f_iso": fr["f_iso"], "f1": _pick(swap, fr["f1"], fr["f2"]), "f2": _pick(swap, fr["f2"], fr["f1"]), "s0": _s0(c[9]), "ad": par}
    for k, (a, b) in enumerate(((0, 1), (1, 0)), 1):
        u, r = _pick(swap, v[a], v[b]), _pick(swap, perp[a], perp[b])
        out |= {f"v{k}": u, f"rd{k}": r, f"fa{k}": C.fractional_anisotropy(par, r, r), f"md{k}": C.mean_diffusivity(par, r, r), f"dt{k}": _axial(u, par, r)}
    return out


def _single_axial(t: Column, k: int, o: FitOptions) -> Maps:
    par = t[k] * o.d_max
    perp, v = t[k + 1] * par, C.angles_to_unit(t[k + 2], t[k + 3])
    f_iso = t[0] if k else F.lit(0.0)
    return {"f_iso": f_iso, "s0": _s0(t[k + 4]), "ad": par, "rd": perp, "fa": C.fractional_anisotropy(par, perp, perp), "md": C.mean_diffusivity(par, perp, perp), "v1": v, "dt": _axial(v, par, perp)}


def _sticks(t: Column, o: FitOptions, ordered: bool) -> Maps:
    fr, v = C.fractions(t[0], t[1]), (C.angles_to_unit(t[3], t[4]), C.angles_to_unit(t[5], t[6]))
    swap = (fr["f1"] < fr["f2"]) if ordered else F.lit(False)
    return {"f_iso": fr["f_iso"], "f1": _pick(swap, fr["f1"], fr["f2"]), "f2": _pick(swap, fr["f2"], fr["f1"]), "d": t[2] * o.d_max, "s0": _s0(t[7]), "v1": _pick(swap, *v), "v2": _pick(swap, v[1], v[0])}


def _times(t: Column, n: int, o: FitOptions, ordered: bool) -> Maps:
    """Maps of each time point (suffix _a, _b, _c) with common directions; ordered by the fractions of all together, as sticks must keep their meaning over time."""
    each = [C.fractions(t[4 * k], t[4 * k + 1]) for k in range(n)]
    v = C.angles_to_unit(t[4 * n], t[4 * n + 1]), C.angles_to_unit(t[4 * n + 2], t[4 * n + 3])
    total = lambda name: sum((fr[name] for fr in each[1:]), each[0][name])
    swap = (total("f1") < total("f2")) if ordered else F.lit(False)
    out = {"v1": _pick(swap, *v), "v2": _pick(swap, v[1], v[0])}
    for k, (fr, name) in enumerate(zip(each, "abc")):
        out |= {f"f_iso_{name}": fr["f_iso"], f"f1_{name}": _pick(swap, fr["f1"], fr["f2"]), f"f2_{name}": _pick(swap, fr["f2"], fr["f1"]), f"d_{name}": t[4 * k + 2] * o.d_max, f"s0_{name}": _s0(t[4 * k + 3])}
    return out


def _bitensor_mdc(t: Column, o: FitOptions) -> Maps:
    l1 = t[3] * 3 * o.md
    l2 = t[4] * (3 * o.md - l1)
    return _tensor(t, [l1, l2, 3 * o.md - l1 - l2], t[5], t[6])


def _of(*at) -> Callable[[Column, FitOptions], Maps]:
    """Parameters of the dual tensor: a theta index (int), a constant (float) or a field ("f", index)."""
    return lambda t, o: _dual([t[a] if isinstance(a, int) else F.lit(a) if isinstance(a, float) else F.col("f")[a[1]] for a in at], o)


MAPS: dict[str, Callable[[Column, FitOptions], Maps]] = {
    "st_original": lambda t, o: _tensor(t, [t[i] * o.d_max for i in (3, 4, 5)], F.lit(1.0), t[6]),
    "stv1": lambda t, o: _single_axial(t, 1, o),
    "stv2": lambda t, o: _single_axial(t, 0, o),
    "bitensor": lambda t, o: _tensor(t, [t[i] * o.d_max for i in (3, 4, 5)], t[6], t[7]),
    "bitensor_mdc": _bitensor_mdc,
    "bitensor_adc": lambda t, o: _tensor(t, [F.lit(o.ad), t[3] * o.ad, t[4] * o.ad], t[5], t[6]),
    "dtv1": _of(*range(10)),
    "dtv2": _of(0, 1, 2, 3, 3, 4, 5, 6, 7, 8),
    "dtv3": _of(0.0, 0, 1, 2, 2, 3, 4, 5, 6, 7),
    "dtv4": _of(0.0, 0.5, 0, 1, 1, 2, 3, 4, 5, 6),
    "dtv3_constrainedangles": _of(0.0, 0, 1, 2, 2, ("f", 0), ("f", 1), ("f", 2), ("f", 3), 3),
    "balland1stick": lambda t, o: {"f_iso": t[0], "f1": 1 - t[0], "d": t[1] * o.d_max, "s0": _s0(t[4]), "v1": C.angles_to_unit(t[2], t[3])},
    "balland2sticks": lambda t, o: _sticks(t, o, True),
    "balland2sticks_orientationprior": lambda t, o: _sticks(t, o, False),
    "balland2sticks_2timepoints": lambda t, o: _times(t, 2, o, False),
    "balland2sticks_3timepoints": lambda t, o: _times(t, 3, o, False),
    "balland2sticks_3timepoints_noprior": lambda t, o: _times(t, 3, o, True),
    "exponential_decay": lambda t, o: {"a": t[0], "r2": t[1]},
    "spoiled_echo": lambda t, o: {"a": t[0], "r1": t[1]},
}


def derive_maps(fitted: DataFrame, model: str, options: FitOptions | None = None) -> DataFrame:
    """Maps of a stored theta by model: fractions, diffusivities, anisotropy, directions, tensors, S0. dtv3_constrainedangles needs f too."""
    if model not in MAPS:
        raise ValueError(f"no maps for {model}")
    maps = MAPS[model](F.col("theta"), options or FitOptions())
    return fitted.select(*fitted.columns, *[e.alias(n) for n, e in maps.items()])
