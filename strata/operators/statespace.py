"""Exact Gaussian likelihood of seasonal ARIMA models, for many series at once.

The differenced series is written in Harvey's state-space form and run through a Kalman filter that starts
from the stationary covariance, so the likelihood is exact. From there the covariance changes by a matrix of rank one
per step (Chandrasekhar recursions), so a step costs the state's size and not its square. Level and regression coefficients
and the innovation variance are concentrated out: the filter is linear, so it also filters every regressor, and
generalised least squares on the innovations gives them. What is left, the AR and MA polynomials
and their seasonal factors, is searched as partial autocorrelations in (-1, 1), which keeps every
point stationary and invertible, by BFGS steps of bounded length with numeric gradients.

All series of a batch, all starting points and all gradient points are one array axis: a pass of the
filter is one loop over time however many series there are. Series of unequal length are padded
and their state is frozen at their own end.
"""

from __future__ import annotations

import math

import numpy as np

MOST_STEPS = 60
BOUND = 4.0  # of an unconstrained parameter: partial autocorrelations up to 0.9993


def _from_partial(x: np.ndarray) -> np.ndarray:
    """Coefficients (batch, p) of a stationary polynomial 1 - c1 B - ... from unconstrained numbers."""
    r = np.tanh(x)
    out = np.zeros((len(x), 0))
    for k in range(x.shape[1]):
        a = r[:, k, None]
        out = np.concatenate([out - a * out[:, ::-1], a], axis=1)
    return out


def _product(short: np.ndarray, seasonal: np.ndarray, s: int) -> np.ndarray:
    """Coefficients c1.. of (1 - short(B)) (1 - seasonal(B^s)), as 1 - c1 B - ..."""
    n, p = short.shape
    P = seasonal.shape[1]
    full = np.zeros((n, p + P * s + 1))
    one = np.concatenate([np.ones((n, 1)), -short], axis=1)
    for j in range(P + 1):
        w = np.ones((n, 1)) if j == 0 else -seasonal[:, j - 1:j]
        full[:, j * s:j * s + p + 1] += w * one
    return -full[:, 1:]


class Model:
    """Orders (p, d, q) and (P, D, Q, s); parameters are partial autocorrelations of ar, ma, seasonal ar, seasonal ma."""

    def __init__(self, order, seasonal):
        self.p, self.d, self.q = order
        self.P, self.D, self.Q, self.s = seasonal
        self.k = self.p + self.q + self.P + self.Q

    def polynomials(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        """(phi, theta, terms): z_t = sum phi_i z_{t-i} + e_t + sum theta_j e_{t-j}."""
        cut = np.cumsum([self.p, self.q, self.P])
        ar, ma, sar, sma = (_from_partial(b) for b in np.split(x, cut, axis=1))
        terms = {f"ar.L{i + 1}": ar[:, i] for i in range(self.p)} | {f"ma.L{i + 1}": -ma[:, i] for i in range(self.q)}
        terms |= {f"ar.S.L{(i + 1) * self.s}": sar[:, i] for i in range(self.P)} | {f"ma.S.L{(i + 1) * self.s}": -sma[:, i] for i in range(self.Q)}
        return _product(ar, sar, self.s), -_product(ma, sma, self.s), terms


def _times(phi: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Companion matrix of phi times x (batch, r, ...)."""
    out = phi.reshape(*phi.shape, *[1] * (x.ndim - 2)) * x[:, :1]
    out[:, :-1] += x[:, 1:]
    return out


def _start(phi: np.ndarray, load: np.ndarray) -> np.ndarray:
    """First column (batch, r) of the stationary state covariance, from the process's own autocovariances.

    State i holds sum_l phi_{i+1+l} z_{t-1-l} + theta_{i+l} e_{t-l}, and the Yule-Walker equations with moving
    average, of r + 1 unknowns, give the autocovariances."""
    b, r = phi.shape
    psi = load.copy()  # z_t = sum psi_l e_{t-l}
    for j in range(1, r):
        psi[:, j] += np.einsum("bi,bi->b", phi[:, :j], psi[:, j - 1::-1])
    eq, side = np.zeros((b, r + 1, r + 1)), np.zeros((b, r + 1))
    for k in range(r + 1):
        eq[:, k, k] += 1
        side[:, k] = np.einsum("bi,bi->b", load[:, k:], psi[:, :r - k])
        for j in range(1, r + 1):
            eq[:, k, abs(k - j)] -= phi[:, j - 1]
    gamma = np.linalg.solve(eq, side[:, :, None])[:, :, 0]
    return np.stack([np.einsum("bi,bi->b", phi[:, i:], gamma[:, 1:r + 1 - i]) + np.einsum("bi,bi->b", load[:, i:], psi[:, :r - i])
                     for i in range(r)], axis=1)


def likelihood(phi: np.ndarray, theta: np.ndarray, z: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """Concentrated log-likelihood and what comes with it.

    ``z`` (batch, time, 1 + regressors): the series and its regressors, padded; ``n``: lengths."""
    b, t_max, m = z.shape
    r = max(phi.shape[1], theta.shape[1] + 1, 1)
    phi = np.pad(phi, ((0, 0), (0, r - phi.shape[1])))
    load = np.concatenate([np.ones((b, 1)), np.pad(theta, ((0, 0), (0, r - 1 - theta.shape[1])))], axis=1)
    p = _start(phi, load)
    f = np.maximum(p[:, 0], 1e-300)
    g = _times(phi, p)  # f times the gain
    w, c = g, -1 / f  # the covariance changes by c w w'
    a = np.zeros((b, r, m))
    log_f = np.zeros(b)
    gram, plain = np.zeros((b, m, m)), np.zeros((b, m, m))
    last = n.min()
    for t in range(t_max):
        on = t < n
        v = z[:, t] - a[:, 0]
        if t >= last:
            v = np.where(on[:, None], v, 0.0)
        log_f += np.where(on, np.log(f), 0.0)
        outer = v[:, :, None] * v[:, None, :]
        plain += outer
        gram += outer / f[:, None, None]
        k = g / f[:, None]
        new_a = _times(phi, a) + k[:, :, None] * v[:, None, :]
        a = new_a if t + 1 <= last else np.where(on[:, None, None], new_a, a)
        tw, w0 = _times(phi, w), w[:, 0]
        new_f = np.maximum(f + c * w0 * w0, 1e-300)
        g = g + tw * (c * w0)[:, None]
        w = tw - k * w0[:, None]
        c = c * f / new_f
        f = new_f
    yy, xy, xx = gram[:, 0, 0], gram[:, 1:, 0], gram[:, 1:, 1:]
    beta = np.einsum("bij,bj->bi", np.linalg.pinv(np.nan_to_num(xx, posinf=0, neginf=0)), xy) if m > 1 else np.zeros((b, 0))
    rss = np.maximum(yy - np.einsum("bi,bi->b", beta, xy), 1e-300)
    sigma2 = rss / n
    value = -n / 2 * (np.log(2 * math.pi * sigma2) + 1) - log_f / 2
    return {"llf": np.where(np.isfinite(value), value, -np.inf), "beta": beta, "sigma2": sigma2, "mse": _residual(plain, beta) / n, "state": a, "phi": phi}


def _residual(gram: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Sum of squares of the first column without the others times beta."""
    c = np.concatenate([np.ones((len(beta), 1)), -beta], axis=1)
    return np.einsum("bi,bij,bj->b", c, gram, c)


def fit(model: Model, z: np.ndarray, n: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(parameters, likelihood at them) of every series. ``starts``: (series, starting points, k)."""
    series, points, k = starts.shape
    if k == 0:
        x = np.zeros((series, 0))
        return x, likelihood(*model.polynomials(x)[:2], z, n)
    x = starts.reshape(series * points, k).clip(-BOUND, BOUND)
    zz, nn = np.repeat(z, points, axis=0), np.repeat(n, points)

    def loss(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return -likelihood(*model.polynomials(x)[:2], zz[rows], nn[rows])["llf"]

    def slopes(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        h = 1e-5
        many = np.concatenate([x + h * e for e in np.eye(k)] + [x - h * e for e in np.eye(k)])
        f = loss(many, np.tile(rows, 2 * k)).reshape(2, k, len(rows))
        g = (f[0] - f[1]).T / (2 * h)
        return np.where(np.isfinite(g), g, 0.0)

    every = np.arange(len(x))
    f, g = loss(x, every), slopes(x, every)
    hess = np.tile(np.eye(k), (len(x), 1, 1)) / np.maximum(np.linalg.norm(g, axis=1), 1.0)[:, None, None]
    alive = every
    for _ in range(MOST_STEPS):
        if not len(alive):
            break
        d = -np.einsum("bij,bj->bi", hess[alive], g[alive])
        down = np.einsum("bi,bi->b", d, g[alive])
        d = np.where((down < 0)[:, None], d, -g[alive])
        d /= np.maximum(np.abs(d).max(axis=1) / 1.0, 1.0)[:, None]  # bounded step
        down = np.einsum("bi,bi->b", d, g[alive])
        best, step = f[alive].copy(), np.zeros(len(alive))
        todo, size = np.arange(len(alive)), 1.0
        for _ in range(12):  # halve until the loss falls enough
            trial = loss((x[alive[todo]] + size * d[todo]).clip(-BOUND, BOUND), alive[todo])
            ok = trial <= f[alive[todo]] + 1e-4 * size * down[todo]
            best[todo[ok]], step[todo[ok]] = trial[ok], size
            todo, size = todo[~ok], size / 2
            if not len(todo):
                break
        moved = step > 0
        rows = alive[moved]
        if not len(rows):
            break
        new = (x[rows] + step[moved, None] * d[moved]).clip(-BOUND, BOUND)
        s, gain = new - x[rows], f[rows] - best[moved]
        x[rows], f[rows] = new, best[moved]
        fresh = slopes(new, rows)
        y = fresh - g[rows]
        g[rows] = fresh
        sy = np.einsum("bi,bi->b", s, y)
        use = sy > 1e-12
        rho = np.where(use, 1 / np.where(use, sy, 1.0), 0.0)[:, None, None]
        left = np.eye(k) - rho * s[:, :, None] * y[:, None, :]
        hess[rows] = np.where(use[:, None, None], left @ hess[rows] @ left.transpose(0, 2, 1) + rho * s[:, :, None] * s[:, None, :], hess[rows])
        alive = rows[(gain > 1e-9 * (1 + np.abs(f[rows]))) & (np.abs(fresh).max(axis=1) > 1e-5)]
    best = f.reshape(series, points).argmin(axis=1) + np.arange(series) * points
    x = x[best]
    return x, likelihood(*model.polynomials(x)[:2], z, n)


def predict(found: dict[str, np.ndarray], future: np.ndarray) -> np.ndarray:
    """Forecasts (series, steps) of the differenced series; ``future``: (series, steps, regressors)."""
    a = found["state"][:, :, 0] - np.einsum("brm,bm->br", found["state"][:, :, 1:], found["beta"])
    out = []
    for h in range(future.shape[1]):
        out.append(a[:, 0] + np.einsum("bm,bm->b", future[:, h], found["beta"]))
        a = _times(found["phi"], a)
    return np.stack(out, axis=1) if out else np.zeros((len(a), 0))
