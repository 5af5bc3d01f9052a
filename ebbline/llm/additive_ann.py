"""Approximate nearest neighbours by additive quantisation.

A vector is the sum of one word from each of M codebooks, all of full dimension. Codebooks
are fitted on residuals and refined jointly; encoding is a beam search that keeps the best
partial sums, so later words may mend earlier ones. Codes and each row's distance to its
sum, which bounds the error of its scores for any query, are
stored. A query makes one table of inner products with all words; a row's approximate
score is the sum of M looked-up entries. The best rows are reranked on original vectors,
and so is every other row whose approximate score and error could still reach the k-th.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.llm.common import materialize, slices, store, stored
from ebbline.llm.topk_pivot import BLOCK, _whole, as_matrix, blocks_of, main_dimension, ranked, valid_vectors

#: Rows the codebooks are fitted on (by hash of the id).
MAX_SAMPLE = 8_192
CODEBOOKS = 8
WORDS = 256
BEAM = 8
#: Rows of each block that are reranked first, per query; the error bound adds the rest.
RERANK = 1_000
QUERIES_AT_ONCE = 4_096


class AdditiveQuantiser:
    def __init__(self, books: np.ndarray):
        self.books = books  # (M, K, d) float32

    @classmethod
    def fit(cls, x: np.ndarray, m: int = CODEBOOKS, words: int = WORDS, rounds: int = 6, seed: int = 7) -> AdditiveQuantiser:
        rng = np.random.default_rng(seed)
        x = x.astype(np.float32)
        words = max(1, min(words, len(x)))
        residual, books = x.copy(), []
        for _ in range(m):
            book = residual[rng.choice(len(x), words, replace=False)].copy()
            for _ in range(rounds):
                near = cls._nearest(residual, book)
                n = np.bincount(near, minlength=words)
                sums = np.zeros_like(book)
                np.add.at(sums, near, residual)
                book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], residual[rng.choice(len(x), words)])
            books.append(book)
            residual = residual - book[cls._nearest(residual, book)]
        out = cls(np.stack(books).astype(np.float32))
        for _ in range(2):  # joint refinement: least squares of all words at once on beam codes
            codes = out.encode(x, beam=2)
            out._refit(x, codes)
        return out

    @staticmethod
    def _nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
        return np.concatenate([((book * book).sum(axis=1) - 2 * x[a : a + 4096] @ book.T).argmin(axis=1) for a in range(0, len(x), 4096)])

    def _refit(self, x: np.ndarray, codes: np.ndarray, ridge: float = 1e-2) -> None:
        m, k, d = self.books.shape
        a = np.zeros((m * k, m * k), np.float32)
        cols = codes.astype(np.int64) + np.arange(m) * k
        b = np.zeros((m * k, d), np.float32)
        for i in range(m):
            np.add.at(b, cols[:, i], x)
            for j in range(m):
                a += np.bincount(cols[:, i] * (m * k) + cols[:, j], minlength=(m * k) ** 2).reshape(m * k, m * k)
        # stay near the words at hand where codes are too few to tell
        prior = self.books.reshape(m * k, d)
        a[np.arange(m * k), np.arange(m * k)] += ridge * max(1.0, len(x) / k)
        self.books = np.linalg.solve(a.astype(np.float64), b + ridge * max(1.0, len(x) / k) * prior).astype(np.float32).reshape(m, k, d)

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes (n, M) by beam search: each step keeps the ``beam`` best sums so far."""
        return np.concatenate([self._encode(x[a : a + 1024].astype(np.float32), beam) for a in range(0, len(x), 1024)]) if len(x) else np.zeros((0, len(self.books)), np.int16)

    def _encode(self, x: np.ndarray, beam: int) -> np.ndarray:
        m, k, _ = self.books.shape
        n = len(x)
        residual, err = x[:, None, :], (x * x).sum(axis=1)[:, None]
        codes = np.zeros((n, 1, 0), np.int16)
        for i in range(m):
            book = self.books[i]
            cost = err[:, :, None] + (book * book).sum(axis=1) - 2 * residual @ book.T
            flat = cost.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            pick = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(keep), (n, 1))
            parent, word = pick // k, pick % k
            rows = np.arange(n)[:, None]
            err = flat[rows, pick]
            residual = residual[rows, parent] - book[word]
            codes = np.concatenate([codes[rows, parent], word[:, :, None].astype(np.int16)], axis=2)
        return codes[np.arange(n), err.argmin(axis=1)]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), self.books.shape[2]), np.float32)
        for i, book in enumerate(self.books):
            out += book[codes[:, i]]
        return out

    def lookup(self, q: np.ndarray) -> np.ndarray:
        """(M, K, queries) inner products of the words with each query."""
        return self.books @ q.astype(np.float32).T


def search_block(ids: np.ndarray, x: np.ndarray, codes: np.ndarray, error: np.ndarray, q_ids: np.ndarray, q: np.ndarray, tables: np.ndarray, k: int, rerank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query ids, row ids and exact scores of each query's best k of a block.

    ``error``: at least |row - decoded row|. The ``rerank`` rows of the best approximate
    scores give a k-th score to beat; every other row that could reach it, as a tie too,
    is scored exactly as well, however many there are.
    """
    out = ([], [], [])
    m = len(tables)
    biggest = float(np.sqrt((x * x).sum(axis=1).max())) if len(x) else 0.0
    for a in range(0, len(q), 64):
        part = tables[:, :, a : a + 64]
        approx = part[0][codes[:, 0]]
        for i in range(1, m):
            approx += part[i][codes[:, i]]
        take = min(rerank + 1, len(ids))
        approx = np.ascontiguousarray(approx.T)
        near = np.argpartition(-approx, take - 1, axis=1)[:, :take] if take < len(ids) else np.tile(np.arange(take), (approx.shape[0], 1))
        for j, rows in enumerate(near):
            own, norm = q[a + j], float(np.sqrt(q[a + j] @ q[a + j]))
            slack = 1e-12 * norm * biggest  # over the rounding of double sums
            rows = rows[ids[rows] != q_ids[a + j]]
            s = x[rows] @ own
            if take < len(ids):
                least = np.partition(s, len(s) - k)[len(s) - k] if len(s) >= k else -np.inf
                could = ~(approx[j] + norm * error < least - slack)  # not a number could too
                could[near[j]] = False
                more = np.flatnonzero(could & (ids != q_ids[a + j]))
                rows, s = np.concatenate([rows, more]), np.concatenate([s, x[more] @ own])
            if len(s) > k:  # the order among those that can be one of k is by exact sums
                rows = rows[s >= np.partition(s, len(s) - k)[len(s) - k] - 2 * slack]
            s = exact(x[rows], own)
            pick = np.lexsort((ids[rows], -s))[:k]
            out[0].append(np.full(len(pick), q_ids[a + j]))
            out[1].append(ids[rows[pick]])
            out[2].append(s[pick])
    return tuple(np.concatenate(c) if c else np.zeros(0) for c in out)


def error_bound(x: np.ndarray, sums: np.ndarray, books: np.ndarray) -> np.ndarray:
    """|x - its decoded sum| of each row, and room for what single precision loses in decoding and in scores."""
    most = float(np.sqrt((books.astype(np.float64) ** 2).sum(axis=2)).max(axis=1).sum())
    gap = x - sums
    return np.sqrt((gap * gap).sum(axis=1)) * (1 + 1e-9) + 1e-6 * (len(books) + books.shape[2]) * most


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component to the last."""
    return np.cumsum(x * q, axis=1)[:, -1]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, rerank: int = RERANK, m: int = CODEBOOKS) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products.

    Frames are (vec_id, v array<double>). Every row is indexed; codebooks are fitted on at
    most ``MAX_SAMPLE`` rows. A query's own id is no candidate; ties go to the smaller id;
    fewer candidates give fewer rows; vectors of another dimension than most take no part;
    repeated rows rank separately; empty tables give no rows. Queries are stored, and each
    task reads them in blocks of ``QUERIES_AT_ONCE`` against its rows, so that neither driver
    nor task holds them all; it passes on k rows a query.
    """
    spark = vectors.sparkSession
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = main_dimension(vectors)
    if d is None:
        return nothing
    vectors = vectors.where(F.size("v") == d)
    rows, _ = blocks_of(vectors)
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(MAX_SAMPLE).toPandas()
    books = spark.sparkContext.broadcast(AdditiveQuantiser.fit(np.stack(sample["v"].to_list()), m).books)

    def index(batches):
        aq = AdditiveQuantiser(books.value)
        for b in batches:
            codes = aq.encode(as_matrix(b.column(1), d))
            error = error_bound(as_matrix(b.column(1), d), aq.decode(codes), aq.books)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(codes), pa.list_(pa.int16())), pa.array(error)], names=["vec_id", "v", "codes", "error"])

    table = materialize(rows.mapInArrow(index, "vec_id long, v array<double>, codes array<short>, error double"), "ann-index")
    asked = store(blocks_of(queries.where(F.size("v") == d).select("vec_id", "v"), QUERIES_AT_ONCE)[0], "ann-queries")

    def search(batches):
        aq = AdditiveQuantiser(books.value)
        for b in (part for whole in _whole(batches, BLOCK) for part in slices(whole, BLOCK)):
            ids, x, codes, error = b.column(0).to_numpy(), as_matrix(b.column(1), d), as_matrix(b.column(2), len(aq.books)), b.column(3).to_numpy()
            for wanted in stored(asked, QUERIES_AT_ONCE):
                q = as_matrix(wanted.column(1), d)
                found = search_block(ids, x, codes, error, wanted.column(0).to_numpy(), q, aq.lookup(q), k, rerank)
                yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], names=["query_id", "vec_id", "score"])

    return ranked(table.mapInArrow(search, "query_id long, vec_id long, score double"), k, "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = valid_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", zero_ok=False)
    return nearest(rows, rows.where(F.col("vec_id") % 20 == 0), 20)
