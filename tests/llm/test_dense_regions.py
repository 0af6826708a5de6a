"""Embedding links inside a dense region, where a fixed number of passes misses many."""

import numpy as np

from jobgrain.llm import embedding_dedup


def clustered(rows, share, pairs, dims, seed=3):
    """Unit vectors of which ``share`` lie at cosine 0.85 of each other, with planted pairs at 0.905 among those; ids are the positions."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    dense = int(rows * share)
    centre, off = unit(rng.standard_normal((1, dims))), rng.standard_normal((dense, dims))
    off = unit(off - (off @ centre.T) * centre)
    x = np.sqrt(0.85) * centre + np.sqrt(0.15) * off
    away = rng.standard_normal((pairs, dims))
    own = x[:pairs]
    away = unit(away - (away * own).sum(axis=1, keepdims=True) * own)
    x[pairs : 2 * pairs] = 0.905 * own + np.sqrt(1 - 0.905**2) * away
    return np.concatenate([x, unit(rng.standard_normal((rows - dense, dims)))]), [(i, pairs + i) for i in range(pairs)]


def frame_of(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def test_links_in_a_dense_region_are_found(spark):
    x, planted = clustered(4000, 1 / 3, 300, 192)
    got = embedding_dedup.embedding_components(frame_of(spark, x), window=16).toPandas().set_index("vec_id").sort_index()
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    assert (got.n_links.to_numpy() == near.sum(axis=1)).mean() > 0.999
    assert np.mean([got.component_id[a] == got.component_id[b] for a, b in planted]) > 0.999


def test_chance_counts_local_density_and_edges():
    even = np.sort(np.random.default_rng(1).integers(0, 2**62, 5000))
    gains = embedding_dedup._gains(even, 0.9, 64)
    assert (gains[400:-400] > 0).all() and (gains[[0, -1]] == 0).all()
    dense = np.sort(np.concatenate([even, even[2500] + np.arange(3000)]))
    assert embedding_dedup._gains(dense, 0.9, 64)[3500] < gains[2500] / 100
