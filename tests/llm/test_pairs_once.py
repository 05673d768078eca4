"""Meetings of the near-duplicate stage: a pair is made once, however many meetings it has, and none is lost."""

import random

from pyspark.sql import functions as F

from tidemark.llm import minhash

SCHEMA = "key long, doc_id long, size long, root long, inside long, common long, n long"


def meetings_of(spark, groups, root):
    rows = [(key, d, 100, root.get(d, d), 100, 0, len(group)) for key, group in groups.items() for d in group]
    return spark.createDataFrame(rows, SCHEMA)


def unlinked(groups, root):
    return {(max(x, y), min(x, y)) for group in groups.values() for x in group for y in group if root.get(x, x) != root.get(y, y)}


def test_a_pair_of_many_meetings_is_made_once(spark):
    """20 texts in each of 30 meetings: 190 pairs, not 5700."""
    groups = {key: range(20) for key in range(30)}
    made = minhash.pairs(meetings_of(spark, groups, {}), 64).collect()
    assert len(made) == 190 and {(r.a, r.b) for r in made} == unlinked(groups, {})


def test_no_pair_is_lost_where_meetings_overlap(spark, monkeypatch):
    """Texts with more meetings than are listed, some linked already, under one root that most have or several."""
    rng = random.Random(31)
    root = {d: 0 for d in range(40)} | {d: 40 for d in range(40, 55)}
    groups = {rng.getrandbits(62) - (1 << 61): rng.sample(range(90), rng.randrange(2, 30)) for _ in range(120)}
    for first in (0, 3, minhash.FIRST):
        monkeypatch.setattr(minhash, "FIRST", first)
        made = minhash.pairs(meetings_of(spark, groups, root), 64).where(~F.col("star"))
        assert {(r.a, r.b) for r in made.collect()} == unlinked(groups, root)


def test_larger_meetings_take_no_pair_away(spark):
    """A pair that shares a meeting of centres first is still made in a small one."""
    groups = {1: range(50), 2: [3, 4], 3: [3, 4]}
    made = minhash.pairs(meetings_of(spark, groups, {}), 16).where(~F.col("star")).collect()
    assert [(r.a, r.b) for r in made] == [(4, 3)]
