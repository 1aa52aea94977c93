"""Approximate nearest neighbours by collision-counting hashing.

Every vector is projected on ``PROJECTIONS`` single lines; an index of a block
of vectors is one sorted array per line. A query looks at the window of each
array centred on its own projection; at radius R a window reaches ``REACH * R``
to each side. Virtual rehashing widens all windows together by ``GROWTH`` and
takes a step back by halves where it leaves many vectors to verify at once. A
vector that lies in at least ``THRESHOLD`` windows is verified by its exact
distance. Entries are counted on the side that has fewer of them, inside the
windows or outside; both give the same number of collisions.

The lines are rows of random orthogonal matrices, so the projections of a
difference have a fixed sum of squares and the number of collisions varies less
than on independent lines. A vector at distance R lies in about 87 % of the
windows, hence reaches the threshold (82 %) with probability over 0.9, a nearer
one more often; farther ones are left out the more lines there are.

The ``k``-th best distance found bounds what is still of interest: the radius
never passes it, and the search of a block ends when R has reached it. A query
first searches its home block; its bound there is the radius in all the others.

Vectors are split into blocks by a hash of the id and queries likewise; every
(block, query block) pair is one group, so memory is bounded by the block
sizes whatever the table's size, and a block's ``k`` best per query are all
that leaves it. All vectors are indexed and nothing is sampled.

Vectors that are null, empty, all zero or hold a null or non-finite component
take no part, nor do rows without an id. Rows that share an id are one vector
(the smallest). Only vectors of equal length are compared. Equal distances are
ordered by id. Fewer candidates than ``k`` are all returned. Components of any
finite size are searched (a block is scaled by a power of two first); a distance
beyond the largest double is infinity. An empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from distkpi.llm.common import materialize

PROJECTIONS = 128
THRESHOLD = 105
REACH = 1.5
GROWTH = 2.0
FINE = 1.05          # a radius is taken back between two steps until it is this close to the smaller one
SEED = 11
BLOCK = 8192         # vectors of a block
QUERY_BLOCK = 16384  # queries of a block
BATCH = 256          # queries whose windows are looked up together
SLACK = 1e-9         # of the largest component: projections are rounded


def lines(dim: int) -> np.ndarray:
    """Random directions of length sqrt(dim), orthogonal in runs of ``dim``; the same for every block."""
    rng = np.random.default_rng([SEED, dim])
    runs = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-PROJECTIONS // dim))]
    return np.concatenate(runs, axis=1)[:, :PROJECTIONS] * np.sqrt(dim)


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances; scaled where squares leave the range of doubles."""
    with np.errstate(over="ignore", invalid="ignore"):
        d = np.sqrt(((vectors - query) ** 2).sum(axis=1))
        for i in np.flatnonzero(~((d > 1e-140) & (d < 1e150))):
            half = vectors[i] / 2 - query / 2
            top = np.abs(half).max()
            d[i] = 2 * (top * np.sqrt(((half / top) ** 2).sum())) if top else np.abs(vectors[i] - query).max()
    return d


class Index:
    """Sorted projections of a block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.exponent = int(np.frexp(np.abs(vectors).max())[1])
        self.lines = lines(vectors.shape[1])
        values = np.ldexp(vectors, -self.exponent) @ self.lines
        self.order = np.argsort(values, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(values, self.order.T, axis=0).T.copy()
        self.verified = 0       # vectors whose distance was computed

    def _first_radius(self, at: np.ndarray, k: int) -> np.ndarray:
        """Per query: few windows hold more than ``2 k`` entries."""
        n, reach = len(self.ids), np.empty(at.shape)
        for j, row in enumerate(self.sorted):
            i = np.searchsorted(row, at[:, j])
            reach[:, j] = np.maximum(at[:, j] - row[np.maximum(i - k, 0)], row[np.minimum(i + k, n - 1)] - at[:, j])
        return np.maximum(np.median(reach, axis=1) / REACH, SLACK)

    def _collisions(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Windows that hold each vector, for one query's windows ``[lo, hi)``."""
        n = len(self.ids)
        if 2 * (hi - lo).sum() <= n * PROJECTIONS:
            return np.bincount(np.concatenate([o[a:b] for o, a, b in zip(self.order, lo, hi)]), minlength=n)
        out = [o[:a] for o, a in zip(self.order, lo)] + [o[b:] for o, b in zip(self.order, hi)]
        return PROJECTIONS - np.bincount(np.concatenate(out), minlength=n)

    def search(self, own: np.ndarray, queries: np.ndarray, k: int,
               bounds: np.ndarray | None = None) -> list[list[tuple[float, int]]]:
        """(distance, id) of the ``k`` nearest found by query, without its own id; none beyond ``bounds`` is looked for."""
        bounds = np.full(len(own), np.inf) if bounds is None else bounds
        out = []
        for i in range(0, len(own), BATCH):
            out += self._batch(own[i:i + BATCH], queries[i:i + BATCH], k, bounds[i:i + BATCH])
        return out

    def _batch(self, own, queries, k, bounds):
        n = len(self.ids)
        with np.errstate(over="ignore", invalid="ignore"):
            at = np.ldexp(queries, -self.exponent) @ self.lines
            at = np.nan_to_num(at, nan=0.0)     # a query far beyond the block's scale
            bounds = np.ldexp(bounds, -self.exponent)
        slack = SLACK * np.maximum(1.0, np.abs(at).max(axis=1))
        radius = np.where(np.isfinite(bounds), bounds, self._first_radius(at, k))
        found = [np.full(n, np.nan) for _ in own]
        if n <= k + 1:
            radius[:] = np.inf
        low = radius / FINE                 # the last radius at which too few were left to verify
        active = np.arange(len(own))
        while len(active):
            half = REACH * radius[active] + slack[active]
            lo, hi = np.empty((2, len(active), PROJECTIONS), np.int64)
            for j, row in enumerate(self.sorted):
                lo[:, j] = np.searchsorted(row, at[active, j] - half, "left")
                hi[:, j] = np.searchsorted(row, at[active, j] + half, "right")
            again = []
            for r, q in enumerate(active):
                known = found[q]
                todo = np.flatnonzero((self._collisions(lo[r], hi[r]) >= THRESHOLD) & np.isnan(known) & (self.ids != own[q]))
                if len(todo) > 4 * k and np.isinf(bounds[q]) and low[q] * FINE < radius[q] < np.inf:
                    radius[q] = np.sqrt(low[q] * radius[q])     # widened too far: nothing is verified yet
                    again.append(q)
                    continue
                low[q] = radius[q]
                known[todo] = distances(self.vectors[todo], queries[q])
                self.verified += len(todo)
                have = known[~np.isnan(known)]
                kth = np.ldexp(np.partition(have, k - 1)[k - 1], -self.exponent) if len(have) >= k else np.inf
                limit = min(kth, bounds[q])
                if radius[q] >= limit or not lo[r].any() and (hi[r] == n).all():
                    continue
                radius[q] = min(radius[q] * GROWTH, limit)
                again.append(q)
            active = np.array(again, np.int64)
        out = []
        for known in found:
            i = np.flatnonzero(~np.isnan(known))
            i = i[np.lexsort((self.ids[i], known[i]))[:k]]
            out.append(list(zip(known[i].tolist(), self.ids[i].tolist())))
        return out


def usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)


def _spread(col: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(n)).cast("int")


def nearest(vectors: DataFrame, query: Column, k: int = 10, block: int = BLOCK,
            query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score for the rows that satisfy ``query``, against all rows."""
    valid = vectors.filter("vec_id IS NOT NULL").select(
        F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"), query.alias("asks"))
    valid = materialize(valid.filter(usable(F.col("v"))).groupBy("vec_id").agg(
        F.min("v").alias("v"), F.max("asks").alias("asks")).withColumn("dim", F.size("v")), "ann-vectors")
    n, q = valid.agg(F.count(F.lit(1)), F.count(F.when(F.col("asks"), 1))).first()
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-q // query_block))

    def all_of(m: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(m - 1)))

    def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        v = t.column("v").combine_chunks()
        flat = v.flatten().to_numpy(zero_copy_only=False)
        return t.column("vec_id").to_numpy(), flat.reshape(len(t), -1)

    def answers(own: np.ndarray, lists: list[list[tuple[float, int]]]) -> pa.Table:
        rows = [(int(o), i, d) for o, some in zip(own, lists) for d, i in some]
        columns = list(zip(*rows)) or [[], [], []]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()),
                         "score": pa.array(columns[2], pa.float64())})

    def at_home(block: pa.Table) -> pa.Table:
        ids, v = matrix(block)
        asks = block.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        return answers(ids[asks], Index(ids, v).search(ids[asks], v[asks], k) if asks.any() else [])

    def abroad(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (len(left) and len(right)):
            return answers(np.zeros(0), [])
        own, v = matrix(right)
        bounds = right.column("bound").to_numpy(zero_copy_only=False)
        return answers(own, Index(*matrix(left)).search(own, v, k, bounds))

    schema = "query_id bigint, vec_id bigint, score double"
    placed = valid.select("dim", _spread(F.col("vec_id"), blocks).alias("block"), "vec_id", "v",
                          F.coalesce("asks", F.lit(False)).alias("asks"))
    home = materialize(placed.groupBy("dim", "block").applyInArrow(at_home, schema), "ann-home")
    bounds = home.groupBy("query_id").agg(F.max("score").alias("bound"), F.count(F.lit(1)).alias("found"))
    asked = materialize(placed.filter("asks").withColumnRenamed("block", "own").join(
        bounds, F.col("vec_id") == F.col("query_id"), "left").select(
        "dim", "own", "vec_id", "v", F.when(F.col("found") >= k, F.col("bound")).otherwise(float("inf")).alias("bound")),
        "ann-queries")

    keys = ["dim", "block", "query_block"]
    stored = placed.select("dim", "block", all_of(query_blocks).alias("query_block"), "vec_id", "v")
    asked = asked.select("dim", "own", all_of(blocks).alias("block"),
                         _spread(F.col("vec_id"), query_blocks).alias("query_block"), "vec_id", "v", "bound")
    found = home.unionByName(stored.groupBy(*keys).cogroup(
        asked.filter("own <> block").drop("own").groupBy(*keys)).applyInArrow(abroad, schema))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
