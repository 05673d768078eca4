"""Chain fill: earlier rows count only if their input hash is that of the folded state."""

import json

from tests.test_operators import REDUCERS, STATE, parcel
from tidemark.operators import materialize as M


def test_chain_checks_input_hashes(spark):
    shelf, weighed = {"log": [], "cost": 1, "place": "shelf"}, {"log": ["12 kg"], "cost": 3, "place": "shelf"}
    hashes = [None, M.canonical_hash(shelf), M.canonical_hash(weighed), "other", M.canonical_hash(weighed), None]
    rows = []
    for run, rank in (("r1", 1), ("r2", 2)):
        for r, h in zip(parcel(), hashes):
            if rank == 1 or r[4] in (0, 2):
                rows.append((*r[:2], run, rank, *r[4:11], h, *r[12:]))
    rows.append((*rows[-1][:4], 7, *rows[-1][5:]))  # the latest run has the path of the label twice
    row = M.fold(spark.createDataFrame(rows, STATE), REDUCERS, chain=True).first()
    assert row.run_id == "r2" and json.loads(row.state) == {"log": ["12 kg", "label 7", "label 7"], "cost": 10, "place": "shelf"}
    assert (row.rows_used, row.chain_rows_used) == (3, 2)
