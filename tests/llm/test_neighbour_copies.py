"""Copies of blocks and query groups: made one at a time and joined by shuffle, and results whatever the tiles."""

import numpy as np
import pytest

from tidemark.llm import neighbours


@pytest.mark.parametrize("most", [7, 1000])
def test_copies_are_neither_exploded_nor_broadcast(spark, monkeypatch, most):
    for name, size in (("LEAST_BLOCK", 2), ("LEAST_GROUP", 2), ("MOST_BLOCK", 10 * most), ("MOST_GROUP", most), ("LEAST_TILE", 100), ("MOST_BYTES", 4096)):
        monkeypatch.setattr(neighbours, name, size)
    plans, durable = [], neighbours.durable
    monkeypatch.setattr(neighbours, "durable", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or durable(df))
    x = np.random.default_rng(7).normal(size=(1500, 4)).astype(np.float32)
    got = {}
    for r in neighbours.nearest_rows(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    assert set(got) == set(range(0, 1500, 50))
    for q, found in got.items():
        score = unit @ unit[q]
        score[q] = -2
        assert [v for _, v in sorted(found)] == np.argsort(-score)[:5].tolist()
    joined = [p for p in plans if "Join" in p]
    assert len(joined) == 1 and not any("Broadcast" in p or "Generate" in p for p in joined)
