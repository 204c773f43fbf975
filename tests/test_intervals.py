"""Beta quantiles against sums of the binomial terms, golden values and known edges."""

import numpy as np
import pytest

from evidentia.functions import intervals, stats


def test_equals_the_sums():
    cases = [(k, n) for n in (1, 2, 7, 40, 437) for k in sorted({0, 1, n // 3, n // 2, n - 1, n}) if k <= n]
    low, high = intervals.clopper_pearson_arrays(*np.array(cases).T)
    for (k, n), a, b in zip(cases, low, high):
        assert (a, b) == pytest.approx(stats.clopper_pearson_interval(k, n), abs=1e-12)


def test_golden_and_empty():
    low, high = intervals.clopper_pearson_arrays(np.array([31, 0, 0]), np.array([437, 0, 5]))
    assert (low[0], high[0]) == pytest.approx((0.048704858507320856, 0.0991823168362104), abs=1e-12)
    assert (low[1], high[1]) == (0.0, 0.0) and low[2] == 0.0


# an end near 1 is a double, so its distance from 1 has eight digits here and the tail seven at most
@pytest.mark.parametrize(("k", "n", "rel"), [(10**6, 3 * 10**6, 1e-7), (17, 10**9, 1e-7), (10**9 - 3, 10**9, 2e-6)])
def test_large_counts_have_the_stated_tails(k, n, rel):
    low, high = intervals.clopper_pearson_arrays(np.array([k]), np.array([n]))
    assert intervals.beta_parts(np.array([float(k)]), np.array([n - k + 1.0]), low)[0][0] == pytest.approx(0.025, rel=rel)
    assert intervals.beta_parts(np.array([k + 1.0]), np.array([float(n - k)]), high)[1][0] == pytest.approx(0.025, rel=rel)
