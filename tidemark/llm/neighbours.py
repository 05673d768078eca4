"""Nearest neighbours by block matrix products of 8-bit vectors, with error bounds and exact recomputation.

Vectors are scaled to length one and rounded to 8 bits; what rounding loses is kept as a length e. For two vectors the
product of the rounded ones is off by at most e_q + e_c + e_q * e_c, so of a tile (a block of queries times a block of
candidates) only pairs whose upper bound reaches the k-th best lower bound can be among the k nearest. Those are
recomputed in double precision from the original vectors; each tile keeps k of them for each query in a heap, and the
heaps of all tiles are merged. The result is exact.

Every candidate lies in one block, every query in one group of the stated query set; a tile, the product of a block and
a group, is a task's unit of work, so neither the queries of a block nor the blocks of a query pile up in one task.
Tiles carry vectors in the width of the column (lossless, 4 bytes for floats), because what survives the bounds is
recomputed inside the tile: where a third of all vectors are alike, the surviving pairs of a query have no bound, but
the heap that leaves the tile has. A table is dealt into as many tiles as tasks can share, in the proportion that copies
the fewest bytes; blocks and groups have a bound of rows and bytes.

Every block is sent to all groups and every group to all blocks. The copies are made one at a time, and joined by
shuffle: an exploded row's copies are held at once by generated code, and the copies of a small file, taken for small
themselves, would be built in the driver as a broadcast (2.6 GB for 14,400 queries in 704 copies).

Vectors are scaled by a power of two to components below one, which changes no bit of a cosine, so components as large
as 1e200 or as small as 1e-200 neither overflow nor vanish.

Defined results: rows whose vector is null, zero, or holds null or non-finite components take no part, neither as
query nor as candidate, and so do rows with a null vec_id. Vectors are compared with those of the same length only. A
query has as many rows as it has candidates, if fewer than k. Rows that share the query's vec_id are its own; several
rows of one vec_id are candidates each, and as queries share one list of k. Equal scores are ordered by vec_id. An empty
table gives an empty result. Columns other than ``vec_id`` and ``embedding`` take no part, whatever their names.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import durable, forget

K = 5
EVERY = 50
LEAST_GROUP, MOST_GROUP = 1024, 65_536
LEAST_BLOCK, MOST_BLOCK = 1024, 65_536
#: Bytes of vectors in a group or block, and products that a tile is worth (where the table has so many).
MOST_BYTES = 16 << 20
LEAST_TILE = 1 << 25
MERGE_QUERIES = 32
#: Products of this many 8-bit components are exact in single precision.
EXACT_DIMS = 1000


def usable(batch_column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Indices and vectors (double) of the rows that take part."""
    column = batch_column.combine_chunks() if isinstance(batch_column, pa.ChunkedArray) else batch_column
    index, out = [], []
    lengths = column.value_lengths().fill_null(0).to_numpy()
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    for i, (n, end) in enumerate(zip(lengths.tolist(), ends.tolist())):
        v = flat[end - n : end]
        if n and np.isfinite(v).all() and v.any():
            index.append(i)
            out.append(v)
    return np.array(index, np.int64), out


def scaled(x: np.ndarray) -> np.ndarray:
    """Each vector times the power of two that brings its largest component below one: exact, and without effect on
    cosines."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def norms(x: np.ndarray) -> np.ndarray:
    """Lengths, summed component by component in order."""
    return np.sqrt(np.cumsum(x * x, axis=1)[:, -1])


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """8-bit vectors (held as single precision for the product), their scales, and the lengths of what is lost."""
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127
    rounded = np.rint(unit / scale[:, None]).astype(np.int8)
    lost = np.sqrt(((unit - rounded * scale[:, None]) ** 2).sum(axis=1))
    return rounded.astype(np.float32), scale, lost


def tile(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, float, int]]:
    """(query, score, candidate) of the k nearest candidates of each query id in one tile."""
    q, c = scaled(q), scaled(c)
    q_bits, q_scale, q_lost = quantise(q)
    c_bits, c_scale, c_lost = quantise(c)
    q_norm, c_norm = norms(q), norms(c)
    heaps: dict[int, list[tuple[float, int]]] = {}
    rows = max(1, 4_000_000 // len(cid))
    for low in range(0, len(qid), rows):
        part = slice(low, low + rows)
        product = np.zeros((len(qid[part]), len(cid)))
        for d in range(0, q.shape[1], EXACT_DIMS):
            product += q_bits[part, d : d + EXACT_DIMS] @ c_bits[:, d : d + EXACT_DIMS].T
        product *= q_scale[part, None] * c_scale[None]
        error = q_lost[part, None] + c_lost[None] + q_lost[part, None] * c_lost[None] + 1e-9
        own = qid[part, None] == cid[None]
        lower = np.where(own, -np.inf, product - error)
        reach = np.partition(lower, -k, axis=1)[:, -k] if len(cid) > k else np.full(len(lower), -np.inf)
        who, which = np.nonzero((product + error >= reach[:, None]) & ~own)
        score = np.empty(len(who))
        for at in range(0, len(who), 100_000):
            a, b = who[at : at + 100_000], which[at : at + 100_000]
            dot = np.cumsum(q[low + a] * c[b], axis=1)[:, -1]
            score[at : at + 100_000] = dot / (q_norm[low + a] * c_norm[b])
        cuts = np.searchsorted(who, np.arange(len(qid[part]) + 1))
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            best = heapq.nsmallest(k, zip((-score[a:b]).tolist(), cid[which[a:b]].tolist()))
            mine = heaps.setdefault(int(qid[low + i]), best)
            if mine is not best:
                mine[:] = heapq.nsmallest(k, mine + best)
    return [(query, -s, v) for query, best in heaps.items() for s, v in best]


PACKED = "dim int, part int, ids binary, data binary"


def _pack(group: pa.Table) -> pa.Table:
    index, vectors = usable(group.column("embedding"))
    ids = group.column("vec_id").to_numpy()[index].astype("<i8")
    data = np.stack(vectors).astype("<f4" if pa.types.is_float32(group.schema.field("embedding").type.value_type) else "<f8")
    return pa.table({"dim": pa.array([data.shape[1]], pa.int32()), "part": pa.array([group.column("part")[0].as_py()], pa.int32()), "ids": [ids.tobytes()], "data": [data.tobytes()]})


def nearest(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows of ``vectors(vec_id, embedding)`` for every row for which
    the column ``is_query`` is true."""
    spark = vectors.sparkSession
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    whole = F.col("embedding").isNotNull() & F.forall("embedding", fine) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & whole).select("vec_id", "embedding", F.size("embedding").alias("dim"), is_query.alias("asks"))
    kind = "<f4" if dict(rows.dtypes)["embedding"] == "array<float>" else "<f8"
    size = lambda test: (F.count_if(test), F.coalesce(F.sum(F.when(test, F.col("dim").cast("long"))), F.lit(0)))
    n, dims, q, q_dims = rows.agg(*size(F.lit(True)), *size(F.col("asks"))).first()
    tiles = min(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, n * q // LEAST_TILE))
    parts = lambda n, dims, least, most, wanted: max(1, -(-n // min(most, max(least, n // max(1, wanted)))), -(-dims * int(kind[-1]) // MOST_BYTES))
    blocks = parts(n, dims, LEAST_BLOCK, MOST_BLOCK, round((tiles * n / max(1, q)) ** 0.5))
    groups = parts(q, q_dims, LEAST_GROUP, MOST_GROUP, -(-tiles // blocks))

    def packed(some: DataFrame, count: int) -> DataFrame:
        """Rows dealt evenly, however often a vec_id is repeated; a file holds few blocks, which readers take at once."""
        part = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(count)).cast("int")
        dealt = some.select("vec_id", "embedding", "dim", part.alias("part")).repartition(count, "dim", "part")
        return durable(dealt.groupBy("dim", "part").applyInArrow(_pack, PACKED))

    def copied(some: DataFrame, count: int, names: str) -> DataFrame:
        """Each row once for each part of the other side."""

        def copies(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    for other in range(count):
                        yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, pa.array([other], pa.int32())], [x.split()[0] for x in names.split(", ")])

        return some.mapInArrow(copies, names)

    candidates, queries = packed(rows, blocks), packed(rows.where("asks"), groups)
    left = copied(candidates, groups, "dim int, block int, ids binary, data binary, group int")
    right = copied(queries, blocks, "dim int, group int, q_ids binary, q_data binary, block int")
    found = "query_id long, score double, vec_id long"

    def multiply(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                dim, ids, data, q_ids, q_data = (column[i].as_py() for column in batch.columns)
                shaped = lambda x, d=dim: np.frombuffer(x, kind).reshape(-1, d).astype(float)
                best = tile(np.frombuffer(q_ids, "<i8"), shaped(q_data), np.frombuffer(ids, "<i8"), shaped(data), k)
                kinds = (pa.int64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in best], t) for j, t in enumerate(kinds)], ["query_id", "score", "vec_id"])

    pairs = left.join(right.hint("merge"), ["dim", "block", "group"]).select("dim", "ids", "data", "q_ids", "q_data")
    partial = durable(pairs.mapInArrow(multiply, found))
    forget(candidates)
    forget(queries)
    merges = -(-max(1, q) // MERGE_QUERIES)

    def merge(group: pa.Table) -> pa.Table:
        heaps: dict[int, list] = {}
        for query, score, vec in zip(*(group.column(c).to_pylist() for c in ("query_id", "score", "vec_id"))):
            heap = heaps.setdefault(query, [])
            (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (score, -vec))
        rows = [(q, r, -v, s) for q, heap in heaps.items() for r, (s, v) in enumerate(sorted(heap, reverse=True), 1)]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["query_id", "rank", "vec_id", "score"])

    merged = partial.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(merges)))
    return merged.groupBy("part").applyInArrow(merge, "query_id long, rank int, vec_id long, score double")


def nearest_rows(embeddings: DataFrame) -> DataFrame:
    """Contract rows: queries are the rows whose vec_id is divisible by 50."""
    return nearest(embeddings, F.coalesce(F.col("vec_id") % EVERY == 0, F.lit(False)))


#: The contract in DuckDB SQL.
NEAREST_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) / (q.norm * c.norm) AS score
      FROM n q JOIN n c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""
