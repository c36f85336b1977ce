"""Signal models: one vectorised function each; Jacobians in closed form, or by complex steps, which are exact to rounding too."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np


@dataclass(frozen=True)
class FitOptions:
    """Fixed diffusivities (mm^2/s), the orientation prior and the iteration limits."""

    d_max: float = 3e-3
    d_iso: float = 3e-3
    md: float = 0.7e-3
    ad: float = 1.7e-3
    prior_width: float = 25.0
    prior_noise: float = 0.04
    max_iterations: int = 100


@dataclass(frozen=True)
class Model:
    """signal(theta, protocol, fields, options) -> (voxels, measurements); indices are 0-based.

    protocol is an array of b, gx, gy, gz; with several time points the
    measurements of each stand one after the other. slopes takes the same and
    returns the signal and its derivatives, (voxels, parameters, measurements);
    a model without it is differentiated by complex steps.
    """

    name: str
    signal: Callable
    n: int
    bounded: tuple[int, ...]
    periodic: tuple[int, ...]
    s0: tuple[int, ...]
    pseudo: int = 0
    times: int = 1
    n_fields: int = 0
    names: tuple[str, ...] = field(default=())
    slopes: Callable | None = None


def _unit(theta, phi):
    return np.stack([np.sin(theta) * np.cos(phi), np.sin(theta) * np.sin(phi), np.cos(theta)], axis=-1)


def _along(protocol, v):
    """b (g.v)^2 of every voxel and measurement."""
    return protocol[:, 0] * (v @ protocol[:, 1:].T) ** 2


def _frame(a1, a2, a3):
    c1, s1, c2, s2, c3, s3 = np.cos(a1), np.sin(a1), np.cos(a2), np.sin(a2), np.cos(a3), np.sin(a3)
    return (
        np.stack([c2 * c3, c1 * s3 + s1 * s2 * c3, s1 * s3 - c1 * s2 * c3], -1),
        np.stack([-c2 * s3, c1 * c3 - s1 * s2 * s3, s1 * c3 + c1 * s2 * s3], -1),
        np.stack([s2, -s1 * c2, c1 * c2], -1),
    )


def _col(t, i):
    return t[:, i, None]


def _tensor(t, protocol, lambdas):
    return np.exp(-sum(_col(lambdas, i) * _along(protocol, v) for i, v in enumerate(_frame(t[:, 0], t[:, 1], t[:, 2]))))


def _st(t, p, f, o):
    return _col(t, 6) * _tensor(t, p, t[:, 3:6] * o.d_max)


def _mixed(t, p, lambdas, f, s0, o):
    return s0 * (f * _tensor(t, p, lambdas) + (1 - f) * np.exp(-p[:, 0] * o.d_iso))


def _bitensor(t, p, f, o):
    return _mixed(t, p, t[:, 3:6] * o.d_max, _col(t, 6), _col(t, 7), o)


def _bitensor_mdc(t, p, f, o):
    l1 = t[:, 3] * 3 * o.md
    l2 = t[:, 4] * (3 * o.md - l1)
    return _mixed(t, p, np.stack([l1, l2, 3 * o.md - l1 - l2], 1), _col(t, 5), _col(t, 6), o)


def _bitensor_adc(t, p, f, o):
    return _mixed(t, p, np.stack([np.full_like(t[:, 3], o.ad), t[:, 3] * o.ad, t[:, 4] * o.ad], 1), _col(t, 5), _col(t, 6), o)


def _axial(p, v, par, perp):
    return np.exp(-(par - perp)[:, None] * _along(p, v) - perp[:, None] * p[:, 0])


def dual_tensor(c1, c2, c3, c4, c5, th1, ph1, th2, ph2, s0, p, o):
    """Two axially symmetric tensors with one axial diffusivity, and a ball."""
    par = c3 * o.d_max
    one, two = _axial(p, _unit(th1, ph1), par, c4 * par), _axial(p, _unit(th2, ph2), par, c5 * par)
    c1, c2, s0 = c1[:, None], c2[:, None], s0[:, None]
    return s0 * (c1 * np.exp(-p[:, 0] * o.d_iso) + (c2 - c1 * c2) * one + (1 - c1 - c2 + c1 * c2) * two)


def _dual(where: dict[int, int | float | tuple[str, int]]):
    """A restriction of dual_tensor: for each of its parameters a theta index (int), a constant (float) or a field."""

    def signal(t, p, f, o):
        take = [t[:, w] if isinstance(w, int) else np.full_like(t[:, 0], w) if isinstance(w, float) else f[:, w[1]] + 0 * t[:, 0] for w in (where[i] for i in range(10))]
        return dual_tensor(*take, p, o)

    return signal


def _map(*w):
    return dict(enumerate(w))


def _stick(p, v, d):
    return np.exp(-d[:, None] * _along(p, v))


def _one_stick(t, p, f, o):
    d = t[:, 1] * o.d_max
    return _col(t, 4) * ((1 - _col(t, 0)) * _stick(p, _unit(t[:, 2], t[:, 3]), d) + _col(t, 0) * np.exp(-p[:, 0] * d[:, None]))


def _sticks(c1, c2, c3, v1, v2, s0, p, o):
    d = c3 * o.d_max
    c1, c2 = c1[:, None], c2[:, None]
    return s0[:, None] * (c1 * np.exp(-p[:, 0] * d[:, None]) + (c2 - c1 * c2) * _stick(p, v1, d) + (1 - c1 - c2 + c1 * c2) * _stick(p, v2, d))


def _two_sticks(t, p, f, o):
    return _sticks(t[:, 0], t[:, 1], t[:, 2], _unit(t[:, 3], t[:, 4]), _unit(t[:, 5], t[:, 6]), t[:, 7], p, o)


def _prior(v, prior, o):
    c = (v * prior).sum(-1)
    edge = 1 - 1e-12
    c = np.where(c.real > edge, edge, np.where(c.real < -edge, -edge, c))
    return np.arccos(c) * 180 / np.pi / (o.prior_width / o.prior_noise)


def _with_prior(signal, a):
    """Two pseudo-data: the angles of both sticks to their prior directions (fields 0-2 and 3-5)."""

    def out(t, p, f, o):
        v1, v2 = _unit(t[:, a], t[:, a + 1]), _unit(t[:, a + 2], t[:, a + 3])
        return np.concatenate([signal(t, p, f, o), _prior(v1, f[:, :3], o)[:, None], _prior(v2, f[:, 3:6], o)[:, None]], axis=1)

    return out


def _times(n: int):
    """Own fractions, diffusivity and S0 for each time point; shared directions in the last four."""

    def signal(t, p, f, o):
        each = np.split(p, n)
        v1, v2 = _unit(t[:, 4 * n], t[:, 4 * n + 1]), _unit(t[:, 4 * n + 2], t[:, 4 * n + 3])
        return np.concatenate([_sticks(*(t[:, 4 * k + i] for i in range(3)), v1, v2, t[:, 4 * k + 3], each[k], o) for k in range(n)], axis=1)

    return signal


def _decay(t, p, f, o):
    """A exp(-TE R2): echo times stand in the b column."""
    return _col(t, 0) * np.exp(-p[:, 0] * _col(t, 1))


def _complex_decay(t, p, f, o):
    """A exp(-TE R2) turned by an angle that grows with the echo time: real parts, then imaginary parts."""
    size, turn = _decay(t, p, f, o), _turn(t[:, 2:], p, f, o)
    return np.concatenate([size * np.cos(turn), size * np.sin(turn)], axis=1)


def _turn(t, p, f, o):
    """A phase that is linear in the echo time."""
    return _col(t, 0) + p[:, 0] * _col(t, 1)


def _spoiled_echo(t, p, f, o):
    """Steady state of a spoiled gradient echo: A sin(flip) (1 - E) / (1 - E cos(flip)), E = exp(-TR R1). TR stands in the b column, the flip angle in gx."""
    e = np.exp(-p[:, 0] * _col(t, 1))
    below = 1 - e * np.cos(p[:, 1])
    return _col(t, 0) * np.sin(p[:, 1]) * (1 - e) / np.where(below == 0, 1, below)  # no signal without flip and repetition


def _constant(t, p, f, o):
    return _col(t, 0) + 0 * p[:, 0]


# derivatives in closed form: (signal, its slopes as voxels x parameters x measurements)


def _turned(protocol, theta, phi):
    """b (g.v)^2 of a direction and its derivatives in both angles, and the direction with its own."""
    st, ct, sp, cp = np.sin(theta), np.cos(theta), np.sin(phi), np.cos(phi)
    v, of_th, of_ph = np.stack([st * cp, st * sp, ct], -1), np.stack([ct * cp, ct * sp, -st], -1), np.stack([-st * sp, st * cp, 0 * st], -1)
    g = protocol[:, 1:].T
    u = v @ g
    twice = 2 * protocol[:, 0] * u
    return protocol[:, 0] * u * u, twice * (of_th @ g), twice * (of_ph @ g), (v, of_th, of_ph)


def _dual_slopes(n: int, where: dict[int, int | float | tuple[str, int]]):
    """Of the restriction of dual_tensor; see _dual."""

    def slopes(t, p, f, o):
        c1, c2, c3, c4, c5, th1, ph1, th2, ph2, s0 = (t[:, w] if isinstance(w, int) else np.full(len(t), w) if isinstance(w, float) else f[:, w[1]] for w in (where[i] for i in range(10)))
        par, b = c3 * o.d_max, p[:, 0]
        (a1, th1_, ph1_, _), (a2, th2_, ph2_, _) = _turned(p, th1, ph1), _turned(p, th2, ph2)
        c1, c2, c4, c5, s0, par = (x[:, None] for x in (c1, c2, c4, c5, s0, par))
        ball = np.exp(-b * o.d_iso)
        k1, k2 = (1 - c4) * par, (1 - c5) * par
        one, two = np.exp(-k1 * a1 - c4 * par * b), np.exp(-k2 * a2 - c5 * par * b)
        w1, w2 = c2 - c1 * c2, 1 - c1 - c2 + c1 * c2
        whole = c1 * ball + w1 * one + w2 * two
        one_, two_ = s0 * w1 * one, s0 * w2 * two
        each = {
            0: lambda: s0 * (ball - c2 * one - (1 - c2) * two), 1: lambda: s0 * (1 - c1) * (one - two),
            2: lambda: -o.d_max * (((1 - c4) * a1 + c4 * b) * one_ + ((1 - c5) * a2 + c5 * b) * two_),
            3: lambda: -par * (b - a1) * one_, 4: lambda: -par * (b - a2) * two_,
            5: lambda: -k1 * th1_ * one_, 6: lambda: -k1 * ph1_ * one_, 7: lambda: -k2 * th2_ * two_, 8: lambda: -k2 * ph2_ * two_, 9: lambda: whole,
        }
        out = np.zeros((len(t), n, len(p)))
        for i, w in where.items():
            if isinstance(w, int):
                out[:, w] += each[i]()
        return s0 * whole, out

    return slopes


def _tensor_slopes(n: int, lambdas: Callable, f_at: int | None):
    """Of a tensor, mixed with free water where f_at says which parameter its share is; lambdas gives the eigenvalues and {parameter: their derivatives}."""

    def slopes(t, p, f, o):
        c1, s1, c2, s2, c3, s3 = (h(t[:, i]) for i in range(3) for h in (np.cos, np.sin))
        v1, v2, v3 = _frame(t[:, 0], t[:, 1], t[:, 2])
        zero = 0 * c1
        first = [np.stack(x, -1) for x in ([zero, -v1[:, 2], v1[:, 1]], [zero, -v2[:, 2], v2[:, 1]], [zero, -v3[:, 2], v3[:, 1]])]
        second = [np.stack(x, -1) for x in ([-s2 * c3, s1 * c2 * c3, -c1 * c2 * c3], [s2 * s3, -s1 * c2 * s3, c1 * c2 * s3], [c2, s1 * s2, -c1 * s2])]
        g, b, (l, chain) = p[:, 1:].T, p[:, 0], lambdas(t, o)
        u = [v @ g for v in (v1, v2, v3)]
        a = [b * x * x for x in u]
        tensor = np.exp(-sum(l[i][:, None] * a[i] for i in range(3)))
        s0 = t[:, n - 1, None]
        share = 1.0 if f_at is None else t[:, f_at, None]
        water = np.exp(-b * o.d_iso)
        whole = tensor if f_at is None else share * tensor + (1 - share) * water
        heavy = -s0 * share * tensor
        out = np.zeros((len(t), n, len(p)))
        for k, moved in enumerate((first, second)):
            out[:, k] = 2 * b * heavy * sum(l[i][:, None] * u[i] * (moved[i] @ g) for i in range(3))
        out[:, 2] = 2 * b * heavy * (l[0] - l[1])[:, None] * u[0] * u[1]
        for k, of in chain.items():
            out[:, k] = heavy * sum(np.reshape(of[i], (-1, 1)) * a[i] for i in range(3) if of[i] is not None)
        if f_at is not None:
            out[:, f_at] = s0 * (tensor - water)
        out[:, n - 1] = whole
        return s0 * whole, out

    return slopes


def _free_lambdas(t, o):
    return [t[:, i] * o.d_max for i in (3, 4, 5)], {3: (o.d_max, None, None), 4: (None, o.d_max, None), 5: (None, None, o.d_max)}


def _mdc_lambdas(t, o):
    whole = 3 * o.md
    l1 = t[:, 3] * whole
    l2 = t[:, 4] * (whole - l1)
    return [l1, l2, whole - l1 - l2], {3: (whole, -whole * t[:, 4], whole * (t[:, 4] - 1)), 4: (None, whole - l1, l1 - whole)}


def _adc_lambdas(t, o):
    return [np.full(len(t), o.ad), t[:, 3] * o.ad, t[:, 4] * o.ad], {3: (None, o.ad, None), 4: (None, None, o.ad)}


def _one_stick_slopes(t, p, f, o):
    c1, c2, s0, b = _col(t, 0), _col(t, 1), _col(t, 4), p[:, 0]
    d = c2 * o.d_max
    a, th, ph, _ = _turned(p, t[:, 2], t[:, 3])
    stick, ball = np.exp(-d * a), np.exp(-b * d)
    whole, heavy = (1 - c1) * stick + c1 * ball, s0 * (1 - c1) * stick
    out = np.stack([s0 * (ball - stick), -o.d_max * (a * heavy + b * s0 * c1 * ball), -d * th * heavy, -d * ph * heavy, whole], axis=1)
    return s0 * whole, out


def _sticks_slopes(times: int, prior: bool):
    """Two sticks at one or several time points, with pseudo-data of the prior behind them; parameters as in _two_sticks and _times."""
    at = [(0, 1, 2, 7)] if times == 1 else [tuple(range(4 * k, 4 * k + 4)) for k in range(times)]
    angle = 3 if times == 1 else 4 * times
    n = 8 if times == 1 else 4 * times + 4

    def slopes(t, p, f, o):
        m = len(p) // times
        value, out = np.empty((len(t), len(p) + 2 * prior)), np.zeros((len(t), n, len(p) + 2 * prior))
        for k, (i1, i2, i3, i0) in enumerate(at):
            q, here = p[k * m : (k + 1) * m], slice(k * m, (k + 1) * m)
            c1, c2, d, s0, b = _col(t, i1), _col(t, i2), _col(t, i3) * o.d_max, _col(t, i0), q[:, 0]
            (a1, th1, ph1, one_v), (a2, th2, ph2, two_v) = (_turned(q, t[:, j], t[:, j + 1]) for j in (angle, angle + 2))
            ball, one, two = np.exp(-b * d), np.exp(-d * a1), np.exp(-d * a2)
            w1, w2 = c2 - c1 * c2, 1 - c1 - c2 + c1 * c2
            whole = c1 * ball + w1 * one + w2 * two
            one_, two_ = s0 * w1 * one, s0 * w2 * two
            out[:, i1, here] = s0 * (ball - c2 * one - (1 - c2) * two)
            out[:, i2, here] = s0 * (1 - c1) * (one - two)
            out[:, i3, here] = -o.d_max * (s0 * c1 * b * ball + a1 * one_ + a2 * two_)
            out[:, i0, here] = whole
            one_, two_ = d * one_, d * two_
            for j, slope in enumerate((th1 * one_, ph1 * one_, th2 * two_, ph2 * two_)):
                out[:, angle + j, here] = -slope
            value[:, here] = s0 * whole
        if prior:
            for j, moved in enumerate((one_v, two_v)):
                toward = f[:, 3 * j : 3 * j + 3]
                value[:, len(p) + j] = _prior(moved[0], toward, o)
                c = (moved[0] * toward).sum(-1)
                inner = np.abs(c) <= 1 - 1e-12
                bend = np.where(inner, -180 / np.pi / (o.prior_width / o.prior_noise) / np.sqrt(np.where(inner, 1 - c * c, 1.0)), 0.0)
                for k in (1, 2):
                    out[:, angle + 2 * j + k - 1, len(p) + j] = bend * (moved[k] * toward).sum(-1)
        return value, out

    return slopes


def _decay_slopes(t, p, f, o):
    e = np.exp(-p[:, 0] * _col(t, 1))
    return _col(t, 0) * e, np.stack([e, -p[:, 0] * _col(t, 0) * e], axis=1)


def _dual_model(name: str, n: int, where: tuple, *rest, **more) -> Model:
    where = _map(*where)
    return Model(name, _dual(where), n, *rest, slopes=_dual_slopes(n, where), **more)


MODELS: dict[str, Model] = {
    m.name: m
    for m in (
        Model("st_original", _st, 7, (3, 4, 5), (0, 1, 2), (6,), slopes=_tensor_slopes(7, _free_lambdas, None)),
        _dual_model("stv1", 6, (0, 1.0, 1, 2, 0.0, 3, 4, 0.0, 0.0, 5), (0, 1, 2), (3, 4), (5,)),
        _dual_model("stv2", 5, (0.0, 1.0, 0, 1, 0.0, 2, 3, 0.0, 0.0, 4), (0, 1), (2, 3), (4,)),
        Model("bitensor", _bitensor, 8, (3, 4, 5, 6), (0, 1, 2), (7,), slopes=_tensor_slopes(8, _free_lambdas, 6)),
        Model("bitensor_mdc", _bitensor_mdc, 7, (3, 4), (0, 1, 2), (6,), slopes=_tensor_slopes(7, _mdc_lambdas, 5)),
        Model("bitensor_adc", _bitensor_adc, 7, (3, 4), (0, 1, 2), (6,), slopes=_tensor_slopes(7, _adc_lambdas, 5)),
        _dual_model("dtv1", 10, tuple(range(10)), (0, 1, 2, 3, 4), (5, 6, 7, 8), (9,)),
        _dual_model("dtv2", 9, (0, 1, 2, 3, 3, 4, 5, 6, 7, 8), (0, 1, 2, 3), (4, 5, 6, 7), (8,)),
        _dual_model("dtv3", 8, (0.0, 0, 1, 2, 2, 3, 4, 5, 6, 7), (0, 1, 2), (3, 4, 5, 6), (7,)),
        _dual_model("dtv4", 7, (0.0, 0.5, 0, 1, 1, 2, 3, 4, 5, 6), (0, 1), (2, 3, 4, 5), (6,)),
        _dual_model("dtv3_constrainedangles", 4, (0.0, 0, 1, 2, 2, ("f", 0), ("f", 1), ("f", 2), ("f", 3), 3), (0, 1, 2), (), (3,), n_fields=4),
        Model("balland1stick", _one_stick, 5, (0, 1), (2, 3), (4,), slopes=_one_stick_slopes),
        Model("balland2sticks", _two_sticks, 8, (0, 1, 2), (3, 4, 5, 6), (7,), slopes=_sticks_slopes(1, False)),
        Model("balland2sticks_orientationprior", _with_prior(_two_sticks, 3), 8, (0, 1, 2), (3, 4, 5, 6), (7,), pseudo=2, n_fields=6, slopes=_sticks_slopes(1, True)),
        Model("balland2sticks_2timepoints", _with_prior(_times(2), 8), 12, (0, 1, 2, 4, 5, 6), (8, 9, 10, 11), (3, 7), pseudo=2, times=2, n_fields=6, slopes=_sticks_slopes(2, True)),
        Model("balland2sticks_3timepoints", _with_prior(_times(3), 12), 16, (0, 1, 2, 4, 5, 6, 8, 9, 10), (12, 13, 14, 15), (3, 7, 11), pseudo=2, times=3, n_fields=6, slopes=_sticks_slopes(3, True)),
        Model("balland2sticks_3timepoints_noprior", _times(3), 16, (0, 1, 2, 4, 5, 6, 8, 9, 10), (12, 13, 14, 15), (3, 7, 11), times=3, slopes=_sticks_slopes(3, False)),
        Model("exponential_decay", _decay, 2, (), (), (0,), slopes=_decay_slopes),
        Model("complex_decay", _complex_decay, 4, (), (2,), (0,)),
        Model("linear_phase", _turn, 2, (), (0,), ()),
        Model("spoiled_echo", _spoiled_echo, 2, (), (), (0,)),
        Model("constant", _constant, 1, (), (), (0,)),
    )
}


def register(model: Model) -> None:
    """Add a model of one's own."""
    MODELS[model.name] = model


def combine(name: str, parts: list[tuple[str, np.ndarray, np.ndarray]], n: int) -> Model:
    """Several models that share parameters: part k sees mixing_k @ theta + offset_k; measurements stand one after the other."""
    models = [(MODELS[m], np.asarray(a, float), np.asarray(c, float)) for m, a, c in parts]

    def signal(t, p, f, o):
        each = np.split(p, len(models))
        return np.concatenate([m.signal(t @ a.T + c, q, f, o) for (m, a, c), q in zip(models, each)], axis=1)

    return Model(name, signal, n, (), (), (), times=len(models))


def signal_and_slopes(model: Model, theta: np.ndarray, protocol: np.ndarray, fields: np.ndarray, options: FitOptions) -> tuple[np.ndarray, np.ndarray]:
    """The signal and its derivatives, (voxels, parameters, measurements)."""
    if model.slopes:
        return model.slopes(theta, protocol, fields, options)
    out = []
    for k in range(model.n):
        t = theta.astype(complex)
        t[:, k] += 1e-30j
        out.append(model.signal(t, protocol, fields, options).imag / 1e-30)
    return model.signal(theta, protocol, fields, options), np.stack(out, axis=1)


def jacobian(model: Model, theta: np.ndarray, protocol: np.ndarray, fields: np.ndarray, options: FitOptions) -> np.ndarray:
    """(voxels, measurements, parameters)."""
    return signal_and_slopes(model, theta, protocol, fields, options)[1].transpose(0, 2, 1)


def weighted_square(j: np.ndarray, w: np.ndarray) -> np.ndarray:
    """j' w j of each voxel: j as jacobian gives it, w (voxels, measurements)."""
    t = j.transpose(0, 2, 1)
    return (t * w[:, None, :]) @ j


# starts from an eigen-decomposition of the log-linear tensor


def starts(model: Model, dt: np.ndarray, s0: np.ndarray, options: FitOptions) -> list[np.ndarray]:
    """Candidate starts of the tensor models from tensors [xx yy zz xy xz yz] and signals at b=0."""
    full = np.nan_to_num(dt[:, [0, 3, 4, 3, 1, 5, 4, 5, 2]], posinf=0, neginf=0).reshape(-1, 3, 3)
    w, v = np.linalg.eigh(full)
    w, v = np.clip(w[:, ::-1], 1e-5, 2.99e-3), v[:, :, ::-1].transpose(0, 2, 1)
    n, base = len(dt), s0[:, 0]
    one = lambda x: np.full(n, float(x))
    polar = lambda u: (np.arccos(np.clip(u[:, 2], -1, 1)), np.arctan2(u[:, 1], u[:, 0]))
    e1, e2 = v[:, 0], v[:, 1]
    frame = np.stack([e1, e2, np.cross(e1, e2)], 1)
    a2 = np.arcsin(np.clip(frame[:, 2, 0], -1, 1))
    a1, a3 = np.arctan2(-frame[:, 2, 1], frame[:, 2, 2]), np.arctan2(-frame[:, 1, 0], frame[:, 0, 0])
    flat = np.clip((w[:, 1] - w[:, 2]) / np.maximum(w[:, 0] - w[:, 2], 1e-12), 0.05, 0.95)[:, None]

    def pair(c):
        p, q = e1 + c * e2, e1 - c * e2
        return [*polar(p / np.linalg.norm(p, axis=1, keepdims=True)), *polar(q / np.linalg.norm(q, axis=1, keepdims=True))]

    splits = [pair(flat), pair(one(1)[:, None]), [*polar(e1), *polar(e2)]]
    cl = w / options.d_max
    perp = np.clip((w[:, 1] + w[:, 2]) / 2 / w[:, 0], 0.02, 0.98)
    md = w.mean(1)
    iso = np.clip((md - 0.7e-3) / (options.d_iso - 0.7e-3), 0.05, 0.9)
    stack = lambda *c: np.stack(c, 1)
    name = model.name
    if name == "st_original":
        return [stack(a1, a2, a3, *cl.T, base), stack(a1, a2, a3, one(0.5), one(0.5), one(0.5), base)]
    if name.startswith("bitensor"):
        three = {"bitensor": list(cl.T), "bitensor_mdc": [np.clip(w[:, 0] / w.sum(1), 0.05, 0.95), np.clip(w[:, 1] / (w[:, 1] + w[:, 2]), 0.05, 0.95)], "bitensor_adc": [np.clip(w[:, 1] / w[:, 0], 0.05, 0.95), np.clip(w[:, 2] / w[:, 0], 0.05, 0.95)]}[name]
        return [stack(a1, a2, a3, *three, f, base) for f in (1 - iso, one(0.9))]
    if name == "stv1":
        return [stack(c, cl[:, 0], perp, *polar(e1), base) for c in (iso, one(0.1))]
    if name == "stv2":
        return [stack(cl[:, 0], perp, *polar(e), base) for e in (e1, e2)]
    if name == "dtv3_constrainedangles":
        return [stack(one(f), np.clip(cl[:, 0] * 1.3, 0.05, 0.95), perp, base) for f in (0.3, 0.7)]
    if name.startswith("dtv"):
        head = {"dtv1": [iso, one(0.5), np.clip(cl[:, 0] * 1.3, 0.05, 0.95), perp * 0.5, perp * 0.5], "dtv2": [iso, one(0.5), np.clip(cl[:, 0] * 1.3, 0.05, 0.95), perp * 0.5], "dtv3": [one(0.5), np.clip(cl[:, 0] * 1.3, 0.05, 0.95), perp * 0.5], "dtv4": [np.clip(cl[:, 0] * 1.3, 0.05, 0.95), perp * 0.5]}[name]
        return [stack(*head, *s, base) for s in splits]
    raise ValueError(f"{name} needs given starts")
