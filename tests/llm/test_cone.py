"""Recall among crowded embeddings."""

import numpy as np

from prefixloom.llm import projections


def test_pairs_in_a_cone_are_found(spark):
    # mean cosine 0.85, pairs at 0.955; a window of 2 crowds 4,000 rows as 32 would a table 16 times as large
    r = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    n, d = 2000, 64
    x = unit(np.sqrt(0.85) * unit(r.standard_normal(d)) + np.sqrt(0.15) * unit(r.standard_normal((n, d))))
    side = r.standard_normal((n, d))
    side = unit(side - (side * x).sum(axis=1, keepdims=True) * x)
    x = np.concatenate([x, 0.955 * x + np.sqrt(1 - 0.955**2) * side])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {g.vec_id: g.group_id for g in projections.groups(df, window=2).collect()}
    assert np.mean([i in got and got[i] == got.get(i + n) for i in range(n)]) >= 0.9
