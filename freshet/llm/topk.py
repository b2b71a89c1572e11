"""Exact top-k search by inner product: columnar branch and bound.

Queries are taken in blocks of ``block`` rows (the only vectors that ever reach the driver), up
to eight of which share a job; each is matched against all rows in one parallel pass. A task holds its candidates in
vertical layout, one row of the matrix per dimension, and adds up scores one block of
dimensions after another. After each block the candidates whose score so far plus the bound
on the remaining dimensions (product of the remaining norms, Cauchy-Schwarz) stays below the
query's k-th best score are compacted away. That k-th best score rises while the task goes on;
where the queries are known to be rows of the table, it starts from the block's own rows.

Scores are integers held in doubles; they are exact below 2**53. Those vectors whose components
are too large for that are scored by Python integers; the others of their batch aren't.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch_path, struct_of

SCALE = 1024
#: Queries whose first block of dimensions is scored together; larger components go apart.
TILE, LARGE = 128, 2.0**20
#: Components of a block of queries.
MOST_VALUES = 1 << 20
_LONG = 2**63 - 1
HITS = struct_of(("query_id", T.LongType()), ("vec_id", T.LongType()), ("score", T.LongType()))


def quantized(ids: pa.Array, vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: ids and floor(1024 x) as doubles, one column per vector.

    Null ids, null vectors and vectors with null or non-finite components are left out.
    """
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    n = len(vectors)
    lengths = np.asarray(vectors.value_lengths().fill_null(-1), dtype=np.int64)
    starts = np.asarray(vectors.offsets, dtype=np.int64)[:-1] if n else np.zeros(0, np.int64)
    flat = vectors.values.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    keep = np.asarray(vectors.is_valid()) & np.asarray(ids.is_valid())
    names = np.asarray(ids.fill_null(0), dtype=np.int64)
    out = {}
    for d in np.unique(lengths[keep]).tolist():
        rows = np.flatnonzero(keep & (lengths == d))
        with np.errstate(over="ignore"):
            x = np.floor(flat[starts[rows][None, :] + np.arange(d)[:, None]] * SCALE)
        fine = np.isfinite(x).all(axis=0)
        out[d] = (names[rows][fine], np.ascontiguousarray(x[:, fine]))
    return out


def _long(x: int) -> int:
    """Cut to a long's range."""
    return max(-_LONG - 1, min(_LONG, x))


def _top(scores, ids, k: int):
    """The k best distinct ids: highest score, ties to the smaller id; a repeated id counts
    with its best score."""
    order = np.lexsort((ids, -scores))
    scores, ids = scores[order], ids[order]
    _, first = np.unique(ids, return_index=True)
    first.sort()
    return scores[first[:k]], ids[first[:k]]


def _safe(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each column of x whether doubles hold its scores with all of q exactly."""
    return np.abs(x).max(axis=0, initial=0.0) * (float(np.abs(q).max(initial=0.0)) * max(1, len(q))) < 2.0**52


class BlockSearch:
    """Searches one block of queries of one dimension through chunk after chunk."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray, width: int):
        self.ids, self.q, self.k, self.width = ids, q, k, width
        self.floor = floor.copy()
        self.best = [(np.zeros(0), np.zeros(0, np.int64))] * len(ids)
        self.rest = suffix_norms(q, width)
        self.touched = 0

    def feed(self, ids: np.ndarray, x: np.ndarray) -> None:
        safe = _safe(self.q, x)
        if not safe.all():
            self._feed_big(ids[~safe], x[:, ~safe])
            ids, x = ids[safe], np.ascontiguousarray(x[:, safe])
        if not len(ids):
            return
        cuts = list(range(0, max(1, len(x)), self.width))
        rest = suffix_norms(x, self.width)
        first = np.zeros((0, len(ids)))
        for j in range(len(self.ids)):
            if j % TILE == 0:  # the first block is scored for some queries at a time
                first = self.q[: self.width, j : j + TILE].T @ x[: self.width]
            score, alive = first[j % TILE], None
            for b, cut in enumerate(cuts):
                if b:
                    block = x[cut : cut + self.width]
                    score = score + self.q[cut : cut + self.width, j] @ (block if alive is None else block[:, alive])
                self.touched += len(score)
                if b + 1 < len(cuts):
                    bound = (self.rest[b + 1, j] * (1 + 1e-9)) * (rest[b + 1] if alive is None else rest[b + 1][alive]) + 1
                    stays = np.flatnonzero(score + bound >= self.floor[j])
                    if len(stays) < 0.7 * len(score):
                        score, alive = score[stays], stays if alive is None else alive[stays]
                        if not len(score):
                            break
            stays = np.flatnonzero(score >= self.floor[j])
            if len(stays):
                self._add(j, score[stays], ids[stays if alive is None else alive[stays]])

    def _add(self, j: int, scores, ids) -> None:
        other = ids != self.ids[j]
        s, i = _top(np.concatenate([self.best[j][0], scores[other]]), np.concatenate([self.best[j][1], ids[other]]), self.k)
        self.best[j] = (s, i)
        if len(s) == self.k:
            self.floor[j] = max(self.floor[j], s[-1])

    def _feed_big(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Components beyond what doubles add up exactly."""
        wide = [[int(v) for v in column] for column in x.T]
        for j in range(len(self.ids)):
            q = [int(v) for v in self.q[:, j]]
            scores = np.array([_long(sum(a * b for a, b in zip(q, w, strict=True))) for w in wide], dtype=object)
            self._add(j, scores, ids)

    def hits(self) -> Iterator[tuple[int, int, int]]:
        for j, (scores, ids) in enumerate(self.best):
            for s, i in zip(scores.tolist(), ids.tolist(), strict=True):
                yield int(self.ids[j]), i, _long(int(s))


def suffix_norms(x: np.ndarray, width: int) -> np.ndarray:
    """Row b: the norm over all dimensions from block b on."""
    squares = [np.square(x[c : c + width]).sum(axis=0) for c in range(0, max(1, len(x)), width)]
    return np.sqrt(np.cumsum(squares[::-1], axis=0)[::-1])


def _floors(ids: np.ndarray, q: np.ndarray, k: int, of: int = 1024) -> np.ndarray:
    """A k-th best score that each query is sure to reach: among up to ``of`` of the block."""
    floor = np.full(len(ids), -np.inf)
    if len(ids) > k and len(np.unique(ids)) == len(ids) and _safe(q, q).all():
        for at in range(0, len(ids), of):
            scores = q[:, at : at + of].T @ q[:, :of]
            if at == 0:
                np.fill_diagonal(scores, -np.inf)
            floor[at : at + of] = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else -np.inf
    return floor


def _blocks(queries: DataFrame, block: int) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Blocks of queries in id order, of ``block`` rows or, if wide, MOST_VALUES components; the
    driver holds one at a time. Of rows that repeat a query id the smallest vector asks."""
    rows: list = []
    last, held = None, 0

    def ready():
        return quantized(pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.float64())))

    for r in queries.toLocalIterator(prefetchPartitions=False):
        if r[0] != last:
            rows.append(r)
            last, held = r[0], held + len(r[1])
        if len(rows) == block or held >= MOST_VALUES:
            yield ready()
            rows, held = [], 0
    if rows:
        yield ready()


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id: str = "vec_id", vector: str = "embedding", block: int = 8192, width: int = 8, within: bool = False) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of highest integer inner product.

    A row is no candidate for its own id. Null ids, null vectors and vectors with null or
    non-finite components take no part, vectors meet only vectors of their own length,
    repeated ids count once with their best score, and scores beyond a long are cut to its
    range before they are ranked. Finite components beyond 2**1013, which no double holds times
    1024, count as non-finite. Fewer candidates than k give fewer rows; empty tables give none.

    within: all queries are rows of vectors, so that their own scores are bounds to start from.
    """
    spark = vectors.sparkSession
    finite = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    ask = queries.select(F.col(id).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v")).where(F.col("i").isNotNull() & F.col("v").isNotNull()).where(finite)
    pool = vectors.select(F.col(id).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v"))
    parts, folder = [], None
    for found in _blocks(ask.orderBy("i", "v"), block):
        seeds = []
        for d, (ids, q) in found.items():
            large = np.abs(q).max(axis=0, initial=0.0) > LARGE
            for some in (~large, large):
                if some.any():
                    own = np.ascontiguousarray(q[:, some])
                    seeds.append((d, ids[some], own, _floors(ids[some], own, k) if within else np.full(int(some.sum()), -np.inf)))

        def search(batches: Iterator[pa.RecordBatch], seeds=seeds) -> Iterator[pa.RecordBatch]:
            states = [(d, BlockSearch(ids, q, k, floor, width)) for d, ids, q, floor in seeds]
            for batch in batches:
                for d, (ids, x) in quantized(batch.column(0), batch.column(1)).items():
                    for wide, state in states:
                        if wide == d:
                            state.feed(ids, x)
            hits = [h for _, s in states for h in s.hits()]
            yield pa.RecordBatch.from_arrays([pa.array([h[c] for h in hits], pa.int64()) for c in range(3)], names=HITS.names)

        parts.append(pool.mapInArrow(search, HITS))
        if len(parts) == 8:  # many blocks: what is done goes to files, so that plans stay small
            folder = folder or scratch_path(spark, "topk")
            for p in parts:
                p.write.mode("append").parquet(folder)
            parts = []
    if folder:
        parts.append(spark.read.schema(HITS).parquet(folder))
    if not parts:
        parts = [spark.createDataFrame([], HITS)]
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    best = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_exact_top_k(spark, sf_dir: str) -> DataFrame:
    """The 10 best partners of every vector whose id is divisible by 100, among all rows."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(rows, rows.where(F.col("vec_id") % 100 == 0), within=True)


OP1_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
f AS (SELECT vec_id, list_transform(v, lambda x: floor(1024 * x)) AS q FROM e
  WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM f a JOIN f b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
