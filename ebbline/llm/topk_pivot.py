"""Exact top-k search by pivot-table elimination.

Inner products become distances: with M the largest norm, x' = (x, sqrt(M^2 - |x|^2)) and
q' = (q, 0) give |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so the nearest x' have the highest
scores. A table holds every row's distances to many pivots. For a query, the largest
|d(q', p) - d(x', p)| over the pivots is a lower bound of its distance to x'. Candidates are
evaluated in the order of their bounds, until the next bound exceeds the k-th distance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbline.llm.common import materialize, store, stored

#: Rows that the pivots are chosen from (by hash of the id).
MAX_SAMPLE = 2_000
PIVOTS = 48
#: Rows of the table per block, and queries that a task holds at once.
BLOCK = 8_192
QUERIES_AT_ONCE = 4_096


def valid_vectors(df: DataFrame, id_col: str, vec_col: str, zero_ok: bool = True) -> DataFrame:
    """(vec_id, v array<double>) of vectors without null or non-finite components.

    The dimension is that of most rows' vectors; others, and empty ones, take no part, nor
    do rows without id.
    """
    v = F.col(vec_col).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    out = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", bad))
    return out if zero_ok else out.where(F.exists("v", lambda x: x != 0))


def main_dimension(vectors: DataFrame) -> int | None:
    rows = vectors.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return rows[0]["d"] if rows else None


def as_matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def blocks_of(vectors: DataFrame, size: int = BLOCK) -> tuple[DataFrame, int]:
    """The rows dealt in turn, repeated ids too, into partitions of about ``size`` rows, and their count."""
    n = vectors.count()
    return vectors.repartition(max(1, -(-n // size))), n


class Pivots:
    """Lifted pivots and distances to them, in float64 with a margin for rounding."""

    def __init__(self, points: np.ndarray, top: float):
        self.points, self.top = points, top

    @staticmethod
    def lift(x: np.ndarray, top: float) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0.0))[:, None]])

    @classmethod
    def choose(cls, sample: np.ndarray, top: float, count: int = PIVOTS) -> Pivots:
        """Points far from each other, farthest first."""
        x = cls.lift(sample, top)
        picked = [int(np.argmax((x * x).sum(axis=1)))]
        near = ((x - x[picked[0]]) ** 2).sum(axis=1)
        while len(picked) < min(count, len(x)) and near.max() > 0:
            picked.append(int(np.argmax(near)))
            near = np.minimum(near, ((x - x[picked[-1]]) ** 2).sum(axis=1))
        return cls(x[picked], top)

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        p = self.points
        sq = (lifted * lifted).sum(axis=1)[:, None] + (p * p).sum(axis=1) - 2 * lifted @ p.T
        return np.sqrt(np.maximum(sq, 0.0))


def search_block(ids: np.ndarray, x: np.ndarray, table: np.ndarray, q_ids: np.ndarray, q: np.ndarray, q_table: np.ndarray, top: float, k: int) -> list[tuple[int, int, int]]:
    """(query, row, score) of each query's best k of one block, exact, ties to smaller ids."""
    out = []
    slack = 1e-6 * (1.0 + np.sqrt(top))  # over the rounding of distances of integer vectors
    for j in range(len(q)):
        bound = np.abs(table - q_table[j]).max(axis=1)
        order = np.argsort(bound, kind="stable")
        norm = float(q[j] @ q[j])
        best_s, best_i, at, step = np.zeros(0), np.zeros(0, np.int64), 0, max(64, 4 * k)
        while at < len(order):
            part = order[at : at + step]
            if len(best_s) == k and bound[part[0]] > np.sqrt(max(norm + top - 2 * best_s[-1], 0.0)) + slack:
                break  # no row further on can reach the k-th score, not even as a tie
            at += step
            step = min(2 * step, 4096)
            part = part[ids[part] != q_ids[j]]
            s = np.concatenate([best_s, x[part] @ q[j]])
            i = np.concatenate([best_i, ids[part]])
            pick = np.lexsort((i, -s))[:k]
            best_s, best_i = s[pick], i[pick]
        out += [(int(q_ids[j]), int(i), int(s)) for i, s in zip(best_i, best_s, strict=True)]
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products.

    Both frames are (vec_id, v) of integer-valued components, as ``valid_vectors`` leaves
    them. A query's own id is no candidate; ties go to the smaller id; fewer candidates
    give fewer rows; repeated candidates rank separately; an empty side gives no rows.
    Vectors of another dimension than most take no part. The table of distances is stored
    once, and so are the queries; each task reads them in blocks of ``QUERIES_AT_ONCE``, so
    that neither driver nor task holds them all, searches its block of rows exactly and
    passes on k rows a query. Exact in float64 while sums stay below 2^53.
    """
    spark = vectors.sparkSession
    d = main_dimension(vectors)
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if d is None:
        return nothing
    vectors = vectors.where(F.size("v") == d)
    rows, _ = blocks_of(vectors)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    top = float(vectors.agg(F.max(square)).first()[0])
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(MAX_SAMPLE).toPandas()
    sample = np.stack(sample["v"].to_list())
    chosen = Pivots.choose(sample, top, pivots)
    shared = spark.sparkContext.broadcast((chosen.points, top))

    def tabulate(batches):
        points, most = shared.value
        p = Pivots(points, most)
        for b in batches:
            x = as_matrix(b.column(1), d)
            t = p.distances(p.lift(x, most))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(t), pa.list_(pa.float64()))], names=["vec_id", "v", "t"])

    table = materialize(rows.mapInArrow(tabulate, "vec_id long, v array<double>, t array<double>"), "topk-table")
    asked = store(blocks_of(queries.where(F.size("v") == d).select("vec_id", "v"), QUERIES_AT_ONCE)[0], "topk-queries")

    def search(batches):
        points, most = shared.value
        p = Pivots(points, most)
        for b in _whole(batches):
            x, t = as_matrix(b.column(1), d), as_matrix(b.column(2), len(points))
            for wanted in stored(asked, QUERIES_AT_ONCE):
                q = as_matrix(wanted.column(1), d)
                q_table = p.distances(np.hstack([q, np.zeros((len(q), 1))]))
                found = search_block(b.column(0).to_numpy(), x, t, wanted.column(0).to_numpy(), q, q_table, most, k)
                cols = list(zip(*found, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    return ranked(table.mapInArrow(search, "query_id long, vec_id long, score long"), k, "score")


def _whole(batches, most: int = 2 * BLOCK):
    """Batches of a task joined to at most ``most`` rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= most:
            yield _joined(held)
            held, n = [], 0
    if n:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def ranked(found: DataFrame, k: int, score: str) -> DataFrame:
    """The k best of each query over the blocks' own bests."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), "vec_id")
    out = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", score)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = valid_vectors(table, "vec_id", "embedding")
    rows = rows.select("vec_id", F.transform("v", lambda x: F.floor(x * 256).cast("double")).alias("v"))
    return top_k(rows, rows.where(F.col("vec_id") % 50 == 0), 5)


#: Brute force over all pairs of query and candidate, for the small tables of the SQL check.
SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
