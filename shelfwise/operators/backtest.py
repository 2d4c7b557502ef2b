"""Rolling-origin backtests, intervals and the choice of a model, over a batch of series."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np

from . import models

CRITERIA = ("mae", "wape", "mase")
INTERVALS = ("empirical", "normal")


def mae(y: np.ndarray, p: np.ndarray) -> float:
    return float(np.mean(np.abs(y - p)))


def bias(y: np.ndarray, p: np.ndarray) -> float:
    return float(np.mean(p - y))


def wape(y: np.ndarray, p: np.ndarray) -> float | None:
    total = np.abs(y).sum()
    return float(np.abs(y - p).sum() / total) if total > 0 else None


def mase(y: np.ndarray, p: np.ndarray, train: np.ndarray) -> float | None:
    if len(train) <= models.SEASON:
        return None
    scale = np.mean(np.abs(train[models.SEASON :] - train[: -models.SEASON]))
    return mae(y, p) / float(scale) if scale > 0 else None


@dataclass(frozen=True)
class Interval:
    """Offsets of the forecast that widen with the step."""

    level: float
    low: float
    high: float
    growth: float = 0.0

    def apply(self, forecast: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scale = 1 + self.growth * np.arange(len(forecast))
        return np.maximum(0, forecast + self.low * scale), forecast + self.high * scale


def empirical_interval(folds: Sequence[tuple[np.ndarray, np.ndarray]], level: float) -> Interval:
    """Quantiles of the residuals, widening by the growth of errors from the first half of the horizon to the second."""
    e = np.concatenate([y - p for y, p in folds])
    h = len(folds[0][0])
    low, high = np.quantile(e, [(1 - level) / 2, (1 + level) / 2])
    growth = 0.0
    if len(e) >= 20 and h >= 4:
        step = np.concatenate([np.arange(1, len(y) + 1) for y, _ in folds])
        near = step <= -(-h // 2)
        first = np.mean(np.abs(e[near]))
        if first > 0:
            growth = float(np.clip((np.mean(np.abs(e[~near])) / first - 1) / (h / 2), 0, 0.03))
    return Interval(level, float(min(0, low)), float(max(0, high)), growth)


def normal_interval(sigma: float, level: float) -> Interval:
    z = NormalDist().inv_cdf((1 + level) / 2) * sigma
    return Interval(level, -z, z)


def origins(n: int, horizon: int, n_folds: int = 4, step: int | None = None, min_train: int = 56) -> list[int]:
    """Fold origins, oldest first; none before `min_train`."""
    step = step or horizon
    return [o for o in (n - horizon - k * step for k in range(n_folds - 1, -1, -1)) if o >= min_train]


def candidates(y: np.ndarray, flags: np.ndarray | None, allowed: Sequence[str] | None = None) -> list[str]:
    """Models for a series: Croston only if it is intermittent, promo models only with enough promotion days."""
    out = [m for m in models.BASES if m != "croston_sba" or models.is_intermittent(y)]
    if models.has_promo_signal(flags):
        out += [f"promo_{b}" for b in models.PROMO_BASES]
    out = [m for m in out if not allowed or m in allowed]
    if not out:
        raise ValueError("no candidate model is left")
    return out


@dataclass
class Score:
    model: str
    folds: int
    mae: float
    wape: float | None
    bias: float
    mase: float | None
    sigma: float
    interval: Interval
    coverage: float

    def rank(self, criterion: str) -> tuple:
        own = getattr(self, criterion)
        return (own is None, own or 0.0, abs(self.bias), self.model)


def backtest(series: Sequence[np.ndarray], flags: Sequence[np.ndarray | None], names: Sequence[Sequence[str]], horizon: int, n_folds: int = 4, level: float = 0.8, method: str = "empirical", min_train: int = 56) -> list[list[Score]]:
    """Scores of each series' candidate models. The folds of all series are lanes of one kernel call a model."""
    cuts = [origins(len(y), horizon, n_folds, min_train=min_train) for y in series]
    scores: list[list[Score]] = [[] for _ in series]
    for name in dict.fromkeys(m for own in names for m in own):
        who = [(i, o) for i, own in enumerate(names) if name in own for o in cuts[i]]
        if not who:
            continue
        past = [flags[i][:o] if flags[i] is not None else None for i, o in who]
        ahead = [flags[i][o : o + horizon] if flags[i] is not None else None for i, o in who]
        found = models.forecast(name, [series[i][:o] for i, o in who], horizon, past, ahead)
        folds: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for (i, o), p in zip(who, found):
            folds.setdefault(i, []).append((series[i][o : o + horizon], p))
        for i, own in folds.items():
            y, p = (np.concatenate([f[k] for f in own]) for k in (0, 1))
            sigma = float(np.std(y - p, ddof=1)) if len(y) > 1 else 0.0
            interval = normal_interval(sigma, level) if method == "normal" else empirical_interval(own, level)
            inside = [(lo <= a) & (a <= hi) for a, b in own for lo, hi in [interval.apply(b)]]
            scores[i].append(Score(name, len(own), mae(y, p), wape(y, p), bias(y, p), mase(y, p, series[i][: cuts[i][0]]), sigma, interval, float(np.mean(np.concatenate(inside)))))
    return scores


def select(scores: Sequence[Score], criterion: str = "mae") -> Score:
    return min(scores, key=lambda s: s.rank(criterion))
