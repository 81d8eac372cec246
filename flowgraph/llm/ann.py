"""Approximate nearest neighbours with a hash-prefix forest.

Every tree gives a vector a long hash string, the signs of its products with random directions, and is kept as the sorted
array of its strings: a prefix is a range of it. A query descends in each tree to the longest prefix that any entry shares
with its own string; then all trees ascend together, level by level, until their ranges hold enough entries. A row's rank is
the length of the prefixes that it shares with the query, summed over the trees, and only the rows of best rank, a small
share of the block, are scored exactly. For inner products the vectors of a block get one component more, that makes their
lengths equal, and a query gets 0 there, which leaves the products as they are.

Blocks of bounded size have forests of their own; every query of the stated set is searched in every block, with a
number of candidates that is a share of the block, so that recall does not fall as rows are added.

Cases: vectors that are null, zero or hold null or non-finite components take no part, nor do rows of null id; equal
vectors, ties, repeated rows and an id on several vectors: see vectors; rows of a query's own id are not its candidates;
shorter vectors count as ending in zeros; an empty table gives an empty result. Extra columns are not read, and may have
any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import materialise, ship
from .vectors import BLOCK_ROWS, best, distinct_vectors, matrix, nearest, query_vectors, search, usable

TREES, BITS = 100, 24
#: The ascent ends when the trees' ranges hold so many times the block's rows together; scored exactly is then the share of
#: best rank, and at least so many times the rows asked for.
ENTRIES, SHARE, LEAST = 12.0, 0.2, 8
SEED = 11


class Forest:
    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = SEED):
        self.trees, self.bits = trees, bits
        norms = np.linalg.norm(vectors, axis=1)
        self.scale = norms.max(initial=0.0) or 1.0
        rest = np.sqrt(np.maximum(0.0, 1.0 - (norms / self.scale) ** 2))
        self.planes = np.random.default_rng(seed).standard_normal((vectors.shape[1] + 1, trees * bits))
        codes = self._codes(np.column_stack([vectors / self.scale, rest]))
        self.order = np.argsort(codes, axis=1, kind="stable").astype(np.int32)
        self.codes = np.take_along_axis(codes, self.order, axis=1)

    def _codes(self, vectors: np.ndarray) -> np.ndarray:
        """The hash strings, a row for each tree."""
        signs = (vectors @ self.planes > 0).reshape(len(vectors), self.trees, self.bits)
        return (signs @ (1 << np.arange(self.bits - 1, -1, -1))).T.astype(np.int64)

    def ranges(self, queries: np.ndarray, entries: float = ENTRIES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The queries' strings, and where the ascent of each ends: the ranges (from, to) of each tree and query."""
        norms = np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-300)
        codes = self._codes(np.column_stack([queries / norms, np.zeros(len(queries))]))
        low, high = np.zeros(codes.shape, np.int64), np.zeros(codes.shape, np.int64)
        open_ = np.ones(len(queries), bool)
        for level in range(self.bits, -1, -1):
            at, shift = np.flatnonzero(open_), self.bits - level
            if not len(at):
                break
            for t in range(self.trees):
                prefix = codes[t, at] >> shift << shift
                low[t, at] = np.searchsorted(self.codes[t], prefix)
                high[t, at] = np.searchsorted(self.codes[t], prefix + (1 << shift))
            open_[at] = (high[:, at] - low[:, at]).sum(axis=0) < entries * self.order.shape[1]
        return codes, low, high

    def candidates(self, codes: np.ndarray, low: np.ndarray, high: np.ndarray, most: int) -> np.ndarray:
        """The `most` rows of best rank for one query."""
        n = self.order.shape[1]
        if n <= most:
            return np.arange(n)
        rows = np.concatenate([self.order[t, a:b] for t, (a, b) in enumerate(zip(low, high))])
        apart = np.concatenate([self.codes[t, a:b] ^ code for t, (a, b, code) in enumerate(zip(low, high, codes))])
        met = np.bincount(rows, self.bits - np.frexp(apart.astype(np.float64))[1], minlength=n)
        return np.sort(np.argpartition(-met, most - 1)[:most])


def nearest_products(
    df: DataFrame, is_query, k: int = 20, key: str = "vec_id", vector: str = "embedding", share: float = SHARE, trees: int = TREES
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with is_query (a condition on the column id) the k rows found of largest inner product."""
    ship(df.sparkSession)
    rows = materialise(usable(df, key, vector, zero=False), "vectors")
    reps = materialise(distinct_vectors(rows, k), "distinct")
    n_blocks = max(1, -(-reps.count() // BLOCK_ROWS))
    blocks = reps.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(n_blocks)).cast("int"))
    of, queries = query_vectors(rows, is_query)

    def find(block: pa.Table, chunk: pa.Table) -> tuple[list, list, list]:
        vectors, ids = matrix(block["v"]), block["ids"].to_pylist()
        asked, reps = matrix(chunk["v"], vectors.shape[1]), chunk["rep"].to_pylist()
        forest = Forest(vectors, trees)
        codes, low, high = forest.ranges(asked)
        most = max(LEAST * (k + 1), int(np.ceil(share * len(vectors))))
        out: tuple[list, list, list] = ([], [], [])
        for i, rep in enumerate(reps):
            near = forest.candidates(codes[:, i], low[:, i], high[:, i], most)
            found, scores = best(vectors[near] @ asked[i], [ids[j] for j in near.tolist()], k)
            out[0].extend([rep] * len(found))
            out[1].extend(found)
            out[2].extend(map(float, scores))
        return out

    return nearest(of, search(blocks, queries.withColumn("least", F.lit(None).cast("double")), n_blocks, k, find, "double"), k)
