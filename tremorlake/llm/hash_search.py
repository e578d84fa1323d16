"""Nearest neighbours by largest inner product with multi-index hashing.

Codes are signs after learned rotations: vectors get one more component that makes all norms equal (so the largest
inner product is the smallest angle), are centred and rotated by principal axes, and ``TURNS`` rotations are fitted so that
signs lose little (iterative quantisation), all on a bounded sample.  The radius that holds the true neighbours of sample
queries is learned too.

A code is split into 16-bit substrings and each is indexed: the different values and the rows of each.  By the pigeonhole
principle a code within radius r differs from the query in at most r // m bits in one of the m substrings (fewer by one
beyond the first r % m + 1), so the values within that distance, of every substring, give every row within r; rows are
then held against r on the whole code and ranked by the exact inner product.  If a block has fewer than k such rows, the radius grows.
Rows longer than every sampled one (about one in ``SAMPLE``) are not on the common sphere, so their codes say nothing
of the inner product: they are ranked for every query.

All queries meet all rows in a grid of blocks of bounded size; a block returns its k best and a window
merges them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tremorlake.llm.text import checkpointed, table

K = 20
TURNS = 2
WORD = 16
SAMPLE = 8000
SAMPLE_QUERIES = 400
KEPT = 0.985  # share of the sample queries' true neighbours that the radius holds
BLOCK_ROWS = 16_384
QUERY_ROWS = 4096
STEPS = 20
SEED = 29


def usable(vector: str) -> Column:
    """Not null, not zero, and every component a finite number."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)


class Codes:
    """Learned sign codes and the search radius."""

    def __init__(self, sample: np.ndarray, k: int, kept: float = KEPT):
        rng = np.random.default_rng(SEED)
        self.norm = float(np.sqrt((sample**2).sum(1).max()))
        x = self._lifted(sample)
        self.mean = x.mean(0)
        _, axes = np.linalg.eigh(np.cov((x - self.mean).T) if len(x) > 1 else np.eye(x.shape[1]))
        dims = max(1, sample.shape[1] // WORD) * WORD
        axes = axes[:, ::-1][:, :dims]
        y = (x - self.mean) @ axes
        turns = []
        for _ in range(TURNS):
            r, _ = np.linalg.qr(rng.normal(size=(dims, dims)))
            r = r[: axes.shape[1]]
            for _ in range(STEPS if len(x) > dims else 0):
                u, _, v = np.linalg.svd(np.sign(y @ r).T @ y, full_matrices=False)
                r = (u @ v).T
            turns.append(axes @ r)
        self.turn = np.concatenate(turns, axis=1)
        self.bits = self.turn.shape[1]
        self.radius = self._learn_radius(sample, k, kept)

    def _lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0, self.norm**2 - (x**2).sum(1)))
        return np.column_stack([x, rest])

    def _words(self, y: np.ndarray) -> np.ndarray:
        return np.packbits((y - self.mean) @ self.turn > 0, axis=1).view(np.uint16)

    def index(self, x: np.ndarray) -> np.ndarray:
        return self._words(self._lifted(x))

    def query(self, x: np.ndarray) -> np.ndarray:
        """Queries have no added component; their length does not matter, so they get the rows' greatest norm."""
        return self._words(np.column_stack([x * (self.norm / np.sqrt((x**2).sum(1)))[:, None], np.zeros(len(x))]))

    def _learn_radius(self, x: np.ndarray, k: int, kept: float) -> int:
        q = x[:SAMPLE_QUERIES]
        score = q @ x.T
        score[np.arange(len(q)), np.arange(len(q))] = -np.inf
        # the sample is thinner than the table: its nearest few stand for the table's k nearest
        near = min(k, max(1, len(x) - 1))
        best = np.argpartition(-score, near - 1, axis=1)[:, :near] if len(x) > 1 else np.zeros((len(q), 0), int)
        a, b = self.query(q), self.index(x)
        gaps = np.concatenate([distance(b[best[i]], a[i]) for i in range(len(q))]) if best.size else np.zeros(1)
        return int(np.quantile(gaps, kept))


def distance(words: np.ndarray, word: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words ^ word).sum(1, dtype=np.int64)


class Index:
    """The substring indexes of a block."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.values = [np.unique(words[:, j], return_inverse=True) for j in range(words.shape[1])]

    def within(self, word: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code is within the radius."""
        m = len(self.values)
        hit = np.zeros(len(self.words), bool)
        for j, (value, where) in enumerate(self.values):
            most = radius // m if j <= radius % m else radius // m - 1
            if most >= 0:
                hit |= (np.bitwise_count(value ^ word[j]) <= most)[where]
        rows = np.flatnonzero(hit)
        return rows[distance(self.words[rows], word) <= radius]


def _block_search(codes: Codes, k: int):
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            x, ids = np.stack(rows["embedding"]).astype(float), rows["vec_id"].to_numpy()
            q, names = np.stack(queries["embedding"]).astype(float), queries["vec_id"].to_numpy()
            index, words = Index(codes.index(x)), codes.query(q)
            longer = np.flatnonzero((x**2).sum(1) > codes.norm**2)
            for i in range(len(q)):
                radius = codes.radius
                while True:
                    found = index.within(words[i], radius)
                    found = found[ids[found] != names[i]]
                    if len(found) >= k or radius >= codes.bits:
                        break
                    radius = min(codes.bits, radius + max(4, codes.bits // 16))
                found = np.union1d(found, longer[ids[longer] != names[i]])
                score = (x[found] * q[i]).sum(1)
                if len(found) > k:
                    least = np.partition(score, -k)[-k]
                    found, score = found[score >= least], score[score >= least]
                best = np.lexsort((ids[found], -score))[:k]
                out.append(pd.DataFrame({"query_id": names[i], "vec_id": ids[found[best]], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = K, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query row of ``vectors`` (vec_id, embedding).

    A row with the query's own vec_id is no candidate.  Rows take no part if the vector is null, empty, zero or
    holds a null or non-finite component, if its length is not that of most rows, or if vec_id is null.  Of several
    query rows with one vec_id the smallest vector asks.  Ties go to the smaller vec_id.  Fewer candidates than k are all
    returned; no vectors or no queries give an empty result.  Other columns are not read.
    """
    good = vectors.where(usable("embedding") & F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    lengths = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "query_id long, vec_id long, score double"
    if not lengths:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    good = checkpointed(good.where(F.size("embedding") == lengths[0]["d"]))
    asks = good.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    n, nq = good.count(), asks.count()
    share = F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(1_000_000)) / 1_000_000
    sample = good.where(share < SAMPLE / n).toPandas().sort_values("vec_id") if n > SAMPLE else good.toPandas().sort_values("vec_id")
    codes = Codes(np.stack(sample["embedding"]).astype(float), k)
    ib, qb = max(1, -(-n // block_rows)), max(1, -(-nq // query_rows))
    own = lambda blocks: F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>"))
    rows = good.select("vec_id", "embedding", own(ib).alias("ib"), every(qb).alias("qb"))
    asks = asks.select("vec_id", "embedding", every(ib).alias("ib"), own(qb).alias("qb"))
    found = rows.groupBy("ib", "qb").cogroup(asks.groupBy("ib", "qb")).applyInPandas(_block_search(codes, k), schema)
    order = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op2_hash_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {"op2_hash_search": op2_hash_search}
ORACLE: dict[str, str] = {}
