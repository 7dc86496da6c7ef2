from __future__ import annotations

import numpy as np
import pytest

from tallyline.operators import arima as A


def simulated(ar=0.0, ma=0.0, sma=0.0, n=240, seed=0):
    """A series whose yearly difference follows the given coefficients."""
    e = np.random.default_rng(seed).normal(size=n)
    w = np.zeros(n)
    for t in range(n):
        w[t] = e[t] + (ar * w[t - 1] + ma * e[t - 1] if t else 0) + (sma * e[t - 12] if t >= 12 else 0)
    y = np.concatenate([10 * np.sin(np.arange(12)), np.zeros(n)])
    for t in range(n):
        y[12 + t] = y[t] + w[t]
    return (100 + y).tolist()


@pytest.fixture(scope="module")
def series(make_series):
    data = {"ar": simulated(ar=0.8, seed=1), "ma": simulated(ma=0.7, seed=2), "sma": simulated(sma=-0.6, seed=3), "none": simulated(seed=4),
            "short": [5.0, 7.0, 6.0] * 6, "tiny": [1.0, 2.0], "constant": [3.0] * 60, "nulls": [None if t % 10 == 3 else float(t % 12) for t in range(60)]}
    return make_series(data, (2000, 1)), data


def test_orders_and_coefficients_are_found(series):
    got = {r["unique_id"]: r for r in A.fit(series[0]).collect()}
    assert got["ar"]["ar1"] == pytest.approx(0.8, abs=0.12)
    assert got["ma"]["ma1"] + got["ma"]["ar1"] == pytest.approx(0.7, abs=0.3)
    assert got["sma"]["sma1"] == pytest.approx(-0.6, abs=0.3)
    assert abs(got["none"]["ar1"]) < 0.3 and abs(got["none"]["sma1"]) < 0.3
    assert "constant" not in got or got["constant"]["order"] is None


def plain_fit(values):
    """The two stages by least squares, straight from their definition."""
    y = np.array([0.0 if v is None else v for v in values])
    w = y[12:] - y[:-12]
    x = np.stack([w[1:-1], w[:-2]], axis=1)
    b = np.linalg.lstsq(x, w[2:], rcond=None)[0]
    e = w[2:] - x @ b
    rows = {"ar1": w[13:-1], "ma1": e[11:-1], "sma1": e[:-12]}
    target = w[14:]
    best = None
    for order in A.ORDERS:
        k, n = len(order) + 1, len(target)
        weights = np.linalg.lstsq(np.stack([rows[c] for c in order], axis=1), target, rcond=None)[0] if order else []
        error = target - sum((c * rows[r] for c, r in zip(weights, order)), np.zeros(n))
        aicc = n * np.log((error ** 2).sum() / n) + 2 * k + 2 * k * (k + 1) / (n - k - 1)
        if best is None or aicc < best[0]:
            best = (aicc, order, dict(zip(order, weights)), w, np.concatenate([np.zeros(2), e]), y)
    return best


@pytest.mark.parametrize("name", ["ar", "ma", "sma", "none"])
def test_fit_and_forecast_equal_least_squares(series, name):
    table, data = series
    _, order, weights, w, e, y = plain_fit(data[name])
    row = A.fit(table).filter(f"unique_id = '{name}'").first()
    assert row["order"] == A.order_name(order)
    for c in A.REGRESSORS:
        assert row[c] == pytest.approx(weights.get(c, 0.0), rel=1e-6, abs=1e-9)
    w, e, y = list(w), list(e), list(y)
    for _ in range(30):
        x = weights.get("ar1", 0) * w[-1] + weights.get("ma1", 0) * e[-1] + weights.get("sma1", 0) * e[-12]
        y.append(y[-12] + x)
        w.append(x)
        e.append(0.0)
    got = [r["arima"] for r in A.arima(table.filter(f"unique_id = '{name}'"), 30).orderBy("ds").collect()]
    assert got == pytest.approx(y[-30:], rel=1e-7)


def test_short_series(series):
    rows = {}
    for r in A.arima(series[0], 12).orderBy("ds").collect():
        rows.setdefault(r["unique_id"], []).append(r["arima"])
    assert rows["tiny"] == [None] * 10 + [1.0, 2.0]  # a year after its two months
    assert rows["constant"] == [3.0] * 12
    assert rows["short"] == series[1]["short"][-12:]  # too short for a regression: last year again
    assert all(v is not None for v in rows["nulls"])
