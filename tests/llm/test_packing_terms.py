"""A seed asks its shard's index with every term it has."""

import numpy as np

from polysafe.llm import packing


def test_long_seeds_ask_with_all_terms():
    rng = np.random.default_rng(3)
    seed = np.arange(300, dtype=np.uint32)
    docs = [seed] + [np.append(np.uint32(k), rng.integers(300, 400, 20)).astype(np.uint32) for k in range(300)]
    df = np.zeros(400)
    for d in docs:
        df[np.unique(d)] += 1
    idf = np.log1p((len(docs) - df + 0.5) / (df + 0.5)).astype(np.float32)
    assert set(packing.Shard(docs, idf, np.mean([len(d) for d in docs])).neighbours(0)) == set(range(301))
