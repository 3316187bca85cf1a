"""Long grids of quantiles: a value meets the few grid points near its own ranks, not the whole grid."""

import contextlib
import io

import numpy as np
import pandas as pd

from plumbline.operators import ranks


def test_grid_of_distinct_hot_and_missing_values_is_exact(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=3000)
    hot = np.where(rng.random(3000) < 0.6, 7.0, np.round(rng.normal(size=3000), 2))
    frame = pd.DataFrame({"x": x, "hot": hot, "same": 1.5, "few": np.r_[[2.0, 1.0], np.full(2998, np.nan)]})
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "x double, hot double, same double, few double")
    df = df.selectExpr("*", "cast(null as double) as none")
    probs = [i / 200 for i in range(201)]
    found = {(r["column"], r["prob"]): r["value"] for r in ranks._ranked_quantiles(df, df.columns, probs).collect()}
    assert len(found) == 5 * 201
    for c in ("x", "hot", "same", "few"):
        assert np.allclose([found[c, p] for p in probs], np.quantile(frame[c].dropna(), probs), rtol=0, atol=1e-12)
    assert all(found["none", p] is None for p in probs)


def test_no_value_walks_the_whole_grid(spark):
    df = spark.range(1000).selectExpr("cast(id as double) as x")
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        ranks._ranked_quantiles(df, ["x"], [i / 200 for i in range(201)]).explain(True)
    assert "lambdafunction" not in said.getvalue() and "stretch" in said.getvalue()
