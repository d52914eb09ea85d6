import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ionframe.functions.isotopes import pattern
from ionframe.operators.calibrate import better_by_cdf, boundary, error_boundary, gaussian_sigma, lowess
from ionframe.operators.quant import pick_peak
from ionframe.operators.solve import nnls


def test_nnls_golden():
    assert np.allclose(nnls(np.array([[1.0, 0], [1, 1], [0, 1]]), np.array([1.0, 3, 2])), [1, 2])
    assert np.allclose(nnls(np.array([[1.0, 1], [0, 1]]), np.array([1.0, -1])), [1, 0])


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 8), st.integers(1, 12), st.integers(0, 10**6))
def test_nnls_meets_the_optimality_conditions(n, m, seed):
    r = np.random.default_rng(seed)
    a, b = r.normal(size=(m, n)), r.normal(size=m)
    x = nnls(a, b)
    grad = a.T @ (a @ x - b)
    assert (x >= 0).all()
    assert (grad >= -1e-6).all()
    assert abs(grad @ x) < 1e-6


def test_boundaries_golden():
    assert boundary(0.1, 0.99, "exponential") == pytest.approx(0.6643856190)
    assert boundary(0.1, 0.99, "half-normal") == pytest.approx(0.3818924525, abs=1e-6)


def test_error_boundary_tells_the_models_apart():
    r = np.random.default_rng(0)
    assert error_boundary(r.normal(0, 1, 5000))[1] == "half-normal"
    assert error_boundary(r.laplace(0, 1, 5000))[1] == "exponential"
    assert error_boundary([0, 0, 0])[0] == 0


def test_carbon_ratio_golden():
    p = pattern((50, 0, 0, 0, 0), 2)
    assert p[1] / p[0] == pytest.approx(0.5407864146, abs=1e-6)
    assert pattern((0, 0, 0, 0, 0), 3).tolist() == [1, 0, 0]


def test_gaussian_sigma():
    mean, sigma = gaussian_sigma(np.random.default_rng(1).normal(2, 0.5, 20000))
    assert mean == pytest.approx(2, abs=0.03) and sigma == pytest.approx(0.5, abs=0.03)


def test_lowess_follows_a_line_despite_outliers():
    x = np.linspace(0, 10, 200)
    y = 3 * x + 1
    y[50] += 100
    xs, f = lowess(x, y, 0.2)
    assert np.abs(f - (3 * xs + 1)).max() < 0.2


def test_better_by_cdf():
    assert better_by_cdf(np.array([5.0, 6, 7]), np.array([0.1, 0.2, 0.3])) == 1


def test_pick_peak():
    v = np.array([0, 1, 5, 1, 0, 2, 9, 2, 0.0])
    assert pick_peak(v, 2)[1] == 2 and pick_peak(v, 7)[1] == 6
    assert pick_peak(np.array([3.0, 2, 1]), 1) == (0, 0, 2)
    assert pick_peak(np.array([0.0, 4, 4, 0]), 1)[1] == 1
