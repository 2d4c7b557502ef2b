"""Forecasting kernels over many series at once.

A kernel takes `lanes`, a list of histories (oldest first), and a horizon, and returns one forecast for each lane. The
recursive models step through time once for all lanes and all parameter candidates, so the cost of a step is shared by a
whole Arrow batch of series and folds. Forecasts are never negative.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

SEASON = 7
Lanes = Sequence[np.ndarray]


def _checked(lanes: Lanes) -> list[np.ndarray]:
    out = [np.asarray(y, dtype=float) for y in lanes]
    for y in out:
        if not len(y) or not np.isfinite(y).all():
            raise ValueError("a history is empty or not finite")
    return out


def _stack(lanes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Histories as columns of (time, lane), padded at the end, and their lengths."""
    n = np.array([len(y) for y in lanes])
    out = np.zeros((n.max(initial=0), len(lanes)))
    for i, y in enumerate(lanes):
        out[: n[i], i] = y
    return out, n


def seasonal_naive(lanes: Lanes, horizon: int) -> list[np.ndarray]:
    """The last week again and again; the mean of shorter histories."""
    return [np.maximum(np.resize(y[-SEASON:], horizon) if len(y) >= SEASON else np.full(horizon, y.mean()), 0) for y in _checked(lanes)]


def moving_average(lanes: Lanes, horizon: int, window: int = 28, weeks: int = 8) -> list[np.ndarray]:
    """The mean of the last four weeks times the weekday profile of the last eight."""
    out = []
    for y in _checked(lanes):
        tail = y[-weeks * SEASON :] if len(y) >= weeks * SEASON else y
        profile = np.ones(SEASON)
        if len(tail) >= 2 * SEASON and tail.mean() > 0:
            day = np.arange(len(tail)) % SEASON
            profile = np.bincount(day, tail, SEASON) / np.bincount(day, minlength=SEASON)
            profile = np.roll(profile / profile.mean(), -(len(tail) % SEASON))
        out.append(np.maximum(y[-window:].mean() * np.resize(profile, horizon), 0))
    return out


#: Smoothing candidates (alpha, beta, gamma), in the order in which ties are settled, and the damping of the trend.
HW_GRID = tuple((a, b, g) for a in (0.15, 0.3, 0.5) for b in (0.02, 0.1) for g in (0.1, 0.3))
HW_DEFAULT = (0.3, 0.05, 0.2)
HW_DAMPING = 0.95


def holt_winters(lanes: Lanes, horizon: int) -> list[np.ndarray]:
    """Additive seasons and a damped trend; the candidate with the least squared error of each lane."""
    lanes = _checked(lanes)
    out: list[np.ndarray | None] = [None] * len(lanes)
    for grid, own in ((HW_GRID, [i for i, y in enumerate(lanes) if len(y) >= 3 * SEASON]), ((HW_DEFAULT,), [i for i, y in enumerate(lanes) if len(y) < 3 * SEASON])):
        for i, f in zip(own, _holt_winters([lanes[i] for i in own], horizon, np.array(grid)) if own else ()):
            out[i] = f
    return out


def _holt_winters(lanes: list[np.ndarray], horizon: int, grid: np.ndarray) -> list[np.ndarray]:
    y, n = _stack(lanes)
    alpha, beta, gamma = grid.T
    k = np.minimum(2, n // SEASON)
    level = np.array([v[:SEASON].mean() if c else v.mean() for v, c in zip(lanes, k)])
    trend = np.array([(v[SEASON : 2 * SEASON].mean() - v[:SEASON].mean()) / SEASON if c == 2 else 0.0 for v, c in zip(lanes, k)])
    season = np.stack([v[:SEASON] - m if c else np.zeros(SEASON) for v, m, c in zip(lanes, level, k)], axis=0)
    size = (len(lanes), len(grid))
    level, trend = (np.repeat(x[:, None], len(grid), axis=1) for x in (level, trend))
    season = np.repeat(season.T[:, :, None], len(grid), axis=2)
    error = np.zeros(size)
    for t in range(len(y)):
        live = (t < n)[:, None]
        j = t % SEASON
        drift = HW_DAMPING * trend
        e = np.where(live, y[t][:, None] - (level + drift + season[j]), 0.0)
        error += e * e
        level = np.where(live, level + drift + alpha * e, level)
        trend = np.where(live, drift + alpha * beta * e, trend)
        season[j] += gamma * (1 - alpha) * e
    best = error.argmin(axis=1)
    at = np.arange(len(lanes))
    damp = np.cumsum(HW_DAMPING ** np.arange(1, horizon + 1))
    index = (n[:, None] + np.arange(horizon)) % SEASON
    forecast = level[at, best][:, None] + damp * trend[at, best][:, None] + season[index, at[:, None], best[:, None]]
    return list(np.maximum(forecast, 0))


THETA_ALPHAS = (0.1, 0.2, 0.3, 0.5)


def theta(lanes: Lanes, horizon: int) -> list[np.ndarray]:
    """The mean of a trend line and of simple smoothing of the line's double curvature, on week-adjusted data."""
    lanes = _checked(lanes)
    index, line, bent, own = [], [], [], []
    out = [np.zeros(horizon) for _ in lanes]
    for i, y in enumerate(lanes):
        if y.mean() <= 0:
            continue
        n = len(y)
        day = np.arange(n) % SEASON
        ratio = np.ones(SEASON)
        if n >= 2 * SEASON:
            ratio = np.clip(np.bincount(day, y, SEASON) / np.bincount(day, minlength=SEASON) / y.mean(), 0.1, 10)
        x, t = y / ratio[day], np.arange(n)
        slope = ((t - t.mean()) @ (x - x.mean())) / ((t - t.mean()) @ (t - t.mean())) if n > 1 else 0.0
        start = x.mean() - slope * t.mean()
        own.append(i)
        index.append(ratio)
        line.append((start, slope))
        bent.append(2 * x - (start + slope * t))
    if own:
        z, n = _stack(bent)
        alpha = np.array(THETA_ALPHAS)
        level = np.repeat(z[0][:, None], len(alpha), axis=1)
        error = np.zeros_like(level)
        for t in range(1, len(z)):
            e = np.where((t < n)[:, None], z[t][:, None] - level, 0.0)
            error += e * e
            level = level + alpha * e
        last = level[np.arange(len(own)), error.argmin(axis=1)]
        for i, ratio, (start, slope), m, flat in zip(own, index, line, n, last):
            h = m + np.arange(horizon)
            out[i] = np.maximum((0.5 * (start + slope * h) + 0.5 * flat) * ratio[h % SEASON], 0)
    return out


def croston_sba(lanes: Lanes, horizon: int, alpha: float = 0.1) -> list[np.ndarray]:
    """Smoothed demand size over smoothed gap between demands, with the bias correction."""
    out = []
    for y in _checked(lanes):
        when = np.flatnonzero(y > 0)
        rate = 0.0
        if len(when):
            size, gap = y[when[0]], when[0] + 1.0
            for before, now in zip(when, when[1:]):
                size += alpha * (y[now] - size)
                gap += alpha * (now - before - gap)
            rate = (1 - alpha / 2) * size / max(gap, 1e-9)
        out.append(np.full(horizon, rate))
    return out


BASES: dict[str, Callable[[Lanes, int], list[np.ndarray]]] = {
    "seasonal_naive": seasonal_naive,
    "moving_average": moving_average,
    "holt_winters": holt_winters,
    "theta": theta,
    "croston_sba": croston_sba,
}
PROMO_BASES = ("moving_average", "holt_winters", "theta")
MODELS = (*BASES, *(f"promo_{b}" for b in PROMO_BASES))
MIN_PROMO_DAYS, MIN_BASE_DAYS, MAX_LIFT = 7, 28, 5.0


def is_intermittent(y: np.ndarray, share: float = 0.5) -> bool:
    return bool(np.mean(np.asarray(y) == 0) >= share)


def has_promo_signal(flags: np.ndarray | None) -> bool:
    if flags is None:
        return False
    n = int(np.sum(np.asarray(flags) > 0))
    return n >= MIN_PROMO_DAYS and len(flags) - n >= MIN_BASE_DAYS


def estimate_lift(y: np.ndarray, flags: np.ndarray) -> float:
    """Promotion days' mean over other days' mean, shrunk towards 1 by the number of promotion days, within [1, 5]."""
    on = np.asarray(flags) > 0
    n = int(on.sum())
    if n < MIN_PROMO_DAYS or n == len(y) or y[~on].mean() <= 0:
        return 1.0
    return float(np.clip(1 + (y[on].mean() / y[~on].mean() - 1) * n / (n + MIN_PROMO_DAYS), 1, MAX_LIFT))


def forecast(name: str, lanes: Lanes, horizon: int, flags: Sequence[np.ndarray | None] | None = None, future: Sequence[np.ndarray | None] | None = None) -> list[np.ndarray]:
    """Forecasts of a model by name; promo_ models divide promotion days by the lift before, and multiply after."""
    if name in BASES:
        return BASES[name](lanes, horizon)
    base = name.removeprefix("promo_")
    if name == base or base not in BASES:
        raise ValueError(f"unknown model {name!r}")
    lanes = _checked(lanes)
    flags = flags or [None] * len(lanes)
    future = future or [None] * len(lanes)
    lift = [estimate_lift(y, f) if f is not None else 1.0 for y, f in zip(lanes, flags)]
    flat = [np.where(np.asarray(f) > 0, y / k, y) if f is not None else y for y, f, k in zip(lanes, flags, lift)]
    return [np.where(np.asarray(f[:horizon]) > 0, p * k, p) if f is not None else p for p, f, k in zip(BASES[base](flat, horizon), future, lift)]
