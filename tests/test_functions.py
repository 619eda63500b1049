from __future__ import annotations

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mosaiq.functions import numeric as n


def test_known_tails():
    assert n.normal_two_sided(1.959963985) == pytest.approx(0.05, abs=1e-8)
    assert n.chi2_tail(3.841458821, 1) == pytest.approx(0.05, abs=1e-8)
    assert n.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert n.fisher_two_sided(3, 1, 1, 3) == pytest.approx(0.4857142857, abs=1e-8)
    assert n.effect_size(None, 3, 4) is None


def test_assignment_of_the_worked_example():
    c = np.array([[4, 1, 3], [2, 0, 5], [3, 2, 2]], float)
    assert c[np.arange(3), n.assign(c)].sum() == 5


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10**6))
def test_assignment_equals_brute_force(a, b, seed):
    c = np.random.default_rng(seed).integers(0, 20, (a, b)).astype(float)
    at = n.assign(c)
    got = sum(c[i, j] for i, j in enumerate(at) if j >= 0)
    small, large = (c, c.shape) if a <= b else (c.T, c.T.shape)
    want = min(sum(small[i, p[i]] for i in range(large[0])) for p in itertools.permutations(range(large[1]), large[0]))
    assert got == want


def test_signif_and_holm(spark):
    df = spark.createDataFrame([("g", "a", 0.01), ("g", "b", 0.04), ("g", "c", 0.03)], "g string, t string, p double")
    got = {r["t"]: round(r["h"], 9) for r in df.withColumn("h", n.holm("p", "g", "t")).collect()}
    assert got == {"a": 0.03, "b": 0.06, "c": 0.06}
    from pyspark.sql import functions as F

    r = spark.createDataFrame([(123456.0, -0.00123456, 0.0)], "a double, b double, c double").select(*[n.signif(F.col(c), 3) for c in "abc"]).first()
    assert [round(x, 8) for x in r] == [123000.0, -0.00123, 0.0]


def test_louvain_finds_two_cliques():
    from mosaiq.operators.segment import louvain

    w = np.zeros((8, 8))
    w[:4, :4] = w[4:, 4:] = 1
    np.fill_diagonal(w, 0)
    w[0, 4] = w[4, 0] = 0.1
    lab = louvain(w)
    assert len(set(lab[:4])) == len(set(lab[4:])) == 1 and lab[0] != lab[4]
    assert louvain(w, refine=True) == lab
