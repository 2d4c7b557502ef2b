import numpy as np
import pytest

from shelfwise.operators import backtest, models, replenish


def test_croston_trace():
    y = np.array([0, 0, 3, 0, 0, 0, 5, 2, 0, 0, 0, 4.0])
    assert models.croston_sba([y], 3)[0] == pytest.approx([1.004132] * 3, abs=1e-5)
    assert models.croston_sba([np.ones(12), np.zeros(5)], 1) == [pytest.approx([0.95]), pytest.approx([0.0])]


def test_seasonal_naive_and_profile():
    assert list(models.seasonal_naive([np.array([3, 5, 7.0])], 7)[0]) == [5.0] * 7
    week = np.array([0.8, 0.9, 0.9, 1, 1.1, 1.3, 1])
    y = np.resize(20 * week, 140)
    assert np.allclose(models.moving_average([y], 7)[0], 20 * week)


def scalar_holt_winters(y, h):
    best = None
    for a, b, g in models.HW_GRID if len(y) >= 21 else (models.HW_DEFAULT,):
        k = min(2, len(y) // 7)
        level = y[:7].mean() if k else y.mean()
        trend = (y[7:14].mean() - level) / 7 if k == 2 else 0.0
        s = list(y[:7] - level) if k else [0.0] * 7
        sse = 0.0
        for t, v in enumerate(y):
            f = level + 0.95 * trend + s[t % 7]
            sse += (v - f) ** 2
            new = a * (v - s[t % 7]) + (1 - a) * (level + 0.95 * trend)
            trend = b * (new - level) + (1 - b) * 0.95 * trend
            s[t % 7] = g * (v - new) + (1 - g) * s[t % 7]
            level = new
        if best is None or sse < best[0] - 1e-12:
            best = (sse, [max(0, level + sum(0.95**i for i in range(1, k + 1)) * trend + s[(len(y) + k - 1) % 7]) for k in range(1, h + 1)])
    return best[1]


def test_holt_winters_lanes_equal_scalar():
    pick = np.random.default_rng(2)
    lanes = [np.round(pick.gamma(2, 5, n)) for n in (5, 10, 20, 21, 60, 133)]
    for y, f in zip(lanes, models.holt_winters(lanes, 10)):
        assert f == pytest.approx(scalar_holt_winters(y, 10), rel=1e-6, abs=1e-6)
    t = np.arange(210)
    y = 30 + 0.05 * t + 5 * np.sin(2 * np.pi * t / 7)
    assert np.mean(np.abs(models.holt_winters([y[:196]], 14)[0] - y[196:])) < 1.5


def test_theta_follows_a_line():
    t = np.arange(100.0)
    assert np.allclose(models.theta([10 + t], 7)[0], 10 + np.arange(100, 107), rtol=0.1)
    assert not models.theta([np.zeros(30)], 7)[0].any()


def test_lift():
    flags = np.zeros(100)
    flags[:20] = 1
    y = np.where(flags > 0, 20.0, 10.0)
    assert models.estimate_lift(y, flags) == pytest.approx(1 + 20 / 27)
    assert models.has_promo_signal(np.r_[np.ones(7), np.zeros(28)]) and not models.has_promo_signal(np.r_[np.ones(7), np.zeros(27)])


def test_intervals():
    e = np.arange(-50.0, 51)
    got = backtest.empirical_interval([(e[:1] + 0, np.zeros(1))] + [(np.array([x]), np.zeros(1)) for x in e[1:]], 0.8)
    assert (got.low, got.high, got.growth) == (pytest.approx(-40), pytest.approx(40), 0)
    fold = (np.r_[np.ones(4), 1.04 * np.ones(4)], np.zeros(8))
    assert backtest.empirical_interval([fold] * 5, 0.8).growth == pytest.approx(0.01)


def test_policy_golden():
    got = replenish.decide(replenish.Need([4.0] * 12, 2.0, 10, 0, 5, 7, 0.95, 6))
    assert (got.reorder_point, got.order_up_to, got.order_qty) == (pytest.approx(31.3964, abs=1e-3), pytest.approx(59.3964, abs=1e-3), 54)
    shelf = replenish.decide(replenish.Need([4.0] * 12, 2.0, 0, 0, 5, 7, 0.95, 1, shelf_life=3))
    assert shelf.order_qty == 12 and "shelf life" in shelf.reason


def test_budget_first_fit():
    orders = [((1, 1), 10, 5.0, 9), ((1, 2), 4, 10.0, 7), ((2, 1), 6, 5.0, 7), ((2, 2), 2, 20.0, 1)]
    assert replenish.allocate(orders, 80) == {(1, 1): 10, (1, 2): 0, (2, 1): 6, (2, 2): 0}
