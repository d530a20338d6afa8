"""Operator 5: exact top-k inner products by pivot-table elimination.

Vectors are made whole numbers. In each block of candidates pivots that lie far apart are
chosen, and a table holds where the candidates' distances to all of them put each: its place in
the space that the pivots span, and its distance from that space. The same for a query gives the largest
lower bound of their distance that distances to the pivots allow, and with it an upper
bound of their inner product. Candidates are evaluated in the order of that bound, and the search
of a block ends when the next bound is below the k-th best score. Bounds carry a
margin for rounding, so the result is exact.

The query set meets all rows in blocks: each task holds one block of queries and one of
candidates, and the best k of every block are ranked per query. A first round over a share of
the rows gives each query a k-th best score to begin with in the blocks of all rows.

Defined cases: a null vec_id, a null vector and one with a null or non-finite
component take no part; vectors of other lengths count as padded with zeros; of
several query rows of one id the smallest vector is asked; a candidate with the query's
id is never its answer; repeated rows of other ids count each (of equal ones k are
enough); ties go to the smaller id; no queries or candidates: no rows; scores beyond a long
stay at its ends; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SCALE = 1024
PIVOTS = 48
#: A block has n / SPREAD rows, within these bounds; the upper one bounds a task's memory.
SPREAD, LEAST, MOST = 64, 4096, 1 << 16
#: One in so many rows takes part in the first round.
FIRST = 8
#: Candidates evaluated at a time in the order of their bounds, and queries bounded at a time.
CHUNK, TOGETHER = 128, 64


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def _scores(x: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of the rows of x with q; whole numbers below 2^53 are exact in doubles."""
    if exact:
        return (x @ q).astype(np.int64)
    ends = np.iinfo(np.int64)
    whole = [sum(int(a) * int(b) for a, b in zip(row, q)) for row in x]
    return np.array([min(max(v, ends.min), ends.max) for v in whole], np.int64)


class PivotTable:
    """Upper bounds of inner products with the rows of x from their distances to pivots."""

    def __init__(self, x: np.ndarray, pivots: int):
        # each pivot is the row farthest from those before it
        chosen = [0]
        apart = ((x - x[0]) ** 2).sum(1)
        for _ in range(min(pivots, len(x)) - 1):
            far = int(apart.argmax())
            if not apart[far]:
                break
            chosen.append(far)
            apart = np.minimum(apart, ((x - x[far]) ** 2).sum(1))
        self.axes = np.linalg.qr(x[chosen].T)[0]
        self.place, self.off = self._of(x)

    def _of(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = v @ self.axes
        return place, np.sqrt(np.maximum(0, (v * v).sum(1) - (place * place).sum(1)))

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """A row per query. The margin covers rounding, also that of a small root of a difference of large squares."""
        place, off = self._of(q)
        size = np.outer(np.sqrt((q * q).sum(1)), np.sqrt((self.place**2).sum(1) + self.off**2))
        return place @ self.place.T + np.outer(off, self.off) + 1 + 1e-6 * size


def search_block(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, pivots: int = PIVOTS, floor: np.ndarray | None = None) -> tuple[list[tuple[int, int, int]], int]:
    """((query id, candidate id, score) of the best k candidates of each query in a block, how many
    were evaluated). Those below a query's `floor` may be missing."""
    by_id = np.argsort(x_ids, kind="stable")
    x, x_ids = x[by_id], x_ids[by_id]
    top = max(np.abs(q).max(initial=0), np.abs(x).max(initial=0))
    exact = bool(top * top * max(1, x.shape[1]) < 2.0**53)
    table = PivotTable(x, pivots) if exact and x.shape[1] else None
    out, evaluated = [], 0
    for i in range(len(q)):
        if table:
            if i % TOGETHER == 0:
                bounds = table.bounds(q[i : i + TOGETHER])
            bound = bounds[i % TOGETHER]
            order = np.flatnonzero(bound >= floor[i]) if floor is not None else np.arange(len(x))
            order = order[np.argsort(-bound[order], kind="stable")]
        else:  # too large for doubles: every candidate is evaluated in whole numbers
            order = np.arange(len(x))
        order = order[x_ids[order] != q_ids[i]]
        best_s, best_id = np.empty(0, np.int64), np.empty(0, np.int64)
        for at in range(0, len(order), CHUNK):
            if table and len(best_s) == k and bound[order[at]] < best_s[-1]:
                break
            some = order[at : at + CHUNK]
            evaluated += len(some)
            best_s = np.r_[best_s, _scores(x[some], q[i], exact)]
            best_id = np.r_[best_id, x_ids[some]]
            keep = np.lexsort((best_id, -best_s if exact else [-int(s) for s in best_s]))[:k]
            best_s, best_id = best_s[keep], best_id[keep]
        out += [(int(q_ids[i]), int(b), int(s)) for b, s in zip(best_id, best_s)]
    return out, evaluated


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of `vectors` for each row of `queries`."""

    def whole(df: DataFrame) -> DataFrame:
        """Rows that take part, their components as whole numbers."""
        v = F.transform(F.col(vec_col), lambda c: F.floor(c.cast("double") * SCALE).cast("double"))
        fine = F.forall(F.col(vec_col), lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
        return df.where(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"))

    def blocks(n: int) -> int:
        return max(1, -(-n // min(MOST, max(LEAST, n // SPREAD))))

    n, m = vectors.count(), queries.count()
    x_blocks, q_blocks = blocks(n), blocks(m)
    # rows are dealt by what they hold, so a task that runs again gets the same ones; of equal rows no more than k can be answers
    x = whole(vectors).groupBy("id", "v").agg(F.count("*").alias("n"))
    x = x.select("id", "v", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least("n", F.lit(k).cast("bigint")))).alias("copy")).withColumn("h", F.xxhash64("id", "v", "copy"))
    x = x.select("id", "v", F.pmod("h", F.lit(x_blocks)).cast("int").alias("x_block"), (F.pmod(F.shiftrightunsigned("h", 32), F.lit(FIRST)) == 0).alias("first"))
    x = x.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    q = whole(queries).groupBy("id").agg(F.min("v").alias("v")).withColumn("q_block", F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            width = max(left["v"].map(len).max(), right["v"].map(len).max())
            floor = left["floor"].to_numpy(float, na_value=-np.inf)
            found, _ = search_block(_matrix(left["v"], width), left["id"].to_numpy(np.int64), _matrix(right["v"], width), right["id"].to_numpy(np.int64), k, pivots, floor)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    def best(asked: DataFrame, among: DataFrame) -> DataFrame:
        asked = asked.withColumn("x_block", F.explode(F.sequence(F.lit(0), F.lit(x_blocks - 1))))
        found = asked.groupBy("q_block", "x_block").cogroup(among.groupBy("q_block", "x_block")).applyInPandas(run, "query_id long, vec_id long, score long")
        place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
        return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    first = best(q.withColumn("floor", F.lit(None).cast("double")), x.where("first"))
    floors = first.where(F.col("rank") == k).select(F.col("query_id").alias("of"), F.col("score").cast("double").alias("floor"))
    return best(q.join(floors, F.col("id") == F.col("of"), "left").select("id", "v", "q_block", "floor"), x.select("id", "v", "x_block", "q_block"))
