"""Correlations from pair moments against pandas, also of wide tables."""

import numpy as np
import pandas as pd
import pytest

from tabulon.operators import stats


def as_matrix(df, cols):
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in df.collect()}
    assert len(got) == len(cols) ** 2
    return np.array([[np.nan if got[a, b] is None else got[a, b] for b in cols] for a in cols])


def test_pairwise_complete(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 6)) * [1, 10, 1e-3, 1, 1, 1] + [0, 1e6, 5, 0, 0, 7]
    x[:, 3] = x[:, 0] * 2 + 1e-3 * x[:, 3]
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 4] = 3.25                                   # constant
    x[:, 5] = np.where(np.arange(400) < 5, x[:, 5], np.nan)
    x[:200, 1] = np.nan
    pdf = pd.DataFrame(x, columns=list("abcdef"))
    df = spark.createDataFrame([tuple(None if v != v else float(v) for v in r) for r in x], ", ".join(f"{c} double" for c in "abcdef")).repartition(7)
    got = as_matrix(stats.corr_matrix(df, digits=None), list("abcdef"))
    want = pdf.corr(min_periods=2).to_numpy()
    want[4, :] = want[:, 4] = np.nan
    assert np.allclose(got, want, atol=1e-9, equal_nan=True)


def test_constant_where_the_other_is_present(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (5.0, None), (None, 4.0)], "a double, b double")
    assert np.isnan(as_matrix(stats.corr_matrix(df), ["a", "b"])[0, 1])
    never = spark.createDataFrame([(1.0, None), (2.0, None), (None, 1.0), (None, 3.0)], "a double, b double")
    assert np.isnan(as_matrix(stats.corr_matrix(never), ["a", "b"])[0, 1])
    odd = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (float("nan"), 1.0), (float("inf"), 1.0)], "a double, b double")
    assert as_matrix(stats.corr_matrix(odd), ["a", "b"])[0, 1] == 1.0


@pytest.mark.parametrize("p", [300])
def test_wide_tables(spark, p):
    rng = np.random.default_rng(2)
    x = np.round(rng.standard_normal((150, p)) @ rng.standard_normal((p, p)), 3)
    cols = [f"c{i}" for i in range(p)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=cols))
    assert np.allclose(as_matrix(stats.corr_matrix(df, digits=None), cols), np.corrcoef(x.T), atol=1e-9)
