"""Distribution functions against published pairs and identities."""

import math

import pytest

from lexloom.functions import dist


@pytest.mark.parametrize(("rho", "n", "p"), [(0.5359689380511595, 200, 2.875457039852924e-16), (0.8999999999999998, 5, 0.03738607346849875), (-0.03152958948585267, 200, 0.6576130814665244)])
def test_correlation_p(rho, n, p):
    assert dist.correlation_p(rho, n) == pytest.approx(p, rel=1e-9)


def test_partial_correlation_p():
    assert dist.correlation_p(0.2644531206417494, 200, 1) == pytest.approx(0.0001603358655541482, rel=1e-9)


def test_chi2_and_f():
    assert dist.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)
    assert dist.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05, rel=1e-9)
    assert dist.f_sf(4.964602743730711, 1, 10) == pytest.approx(0.05, rel=1e-8)
    assert dist.gamma_sf(1, 2.0) == pytest.approx(math.exp(-2))


def test_signed_rank_exact():
    # all of five pairs positive: two of the 32 sign patterns are as extreme
    assert dist.signed_rank_p(15, 0, 5, 0, True) == pytest.approx(2 / 32)
    assert dist.signed_rank_p(15, 0, 5, 0, True, greater=True) == pytest.approx(1 / 32)
    assert sum(dist.signed_rank_counts(10)) == 1024
    assert dist.signed_rank_p(0, 0, 0, 0, False) == 1.0
