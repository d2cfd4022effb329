"""Exact top-k inner products by a pivot-distance index: vectors keyed by nearest pivot and distance, sorted annuli, triangle-inequality stops."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

#: Pivots, and the rows (lowest hashes of vec_id) that they are fitted on.
PIVOTS, PIVOT_SAMPLE = 64, 4096
#: Vectors of one annulus of the index, of one task, and queries that one pass over the index answers.
ANNULUS_ROWS, TASK_ROWS, QUERIES_PER_PASS = 512, 65_536, 32768
#: Bytes of annuli that a task holds at once.
HELD_BYTES = 32 << 20
#: Beyond this, products are summed as integers, below it as doubles, both exact.
EXACT_DOUBLE = 1 << 21
INDEX = "pivot int, low double, high double, ids binary, vectors binary, dimension int"
SEED = "query_id bigint, least bigint, vector binary, dimension int"
FOUND = "query_id bigint, query_key bigint, vec_id bigint, score bigint"


@dataclass
class Space:
    """Pivots in the space where the largest inner product is the smallest distance.

    A vector v gets one more coordinate, sqrt(radius2 - |v|^2), a query q gets 0 there; then
    |q' - v'|^2 = |q|^2 + radius2 - 2 <q, v>, and distances obey the triangle inequality.
    """

    pivots: np.ndarray
    radius2: float

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, self.radius2 - np.einsum("ij,ij->i", vectors, vectors)))
        return np.column_stack([vectors, rest])

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        squared = np.einsum("ij,ij->i", lifted, lifted)[:, None] + np.einsum("ij,ij->i", self.pivots, self.pivots)[None] - 2 * lifted @ self.pivots.T
        return np.sqrt(np.maximum(0.0, squared))


def usable(vector: Column) -> Column:
    """Not null or empty, and every component finite."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def _fit(sample: np.ndarray, pivots: int, radius2: float) -> Space:
    """Pivots by a few rounds of k-means from spread starts, on the lifted sample."""
    space = Space(np.zeros((0, sample.shape[1] + 1)), radius2)
    lifted = space.lift(sample)
    chosen = [0]
    nearest = np.full(len(lifted), np.inf)
    for _ in range(1, min(pivots, len(lifted))):
        nearest = np.minimum(nearest, np.square(lifted - lifted[chosen[-1]]).sum(axis=1))
        chosen.append(int(nearest.argmax()))
    centres = lifted[chosen]
    for _ in range(6):
        space.pivots = centres
        own = space.distances(lifted).argmin(axis=1)
        centres = np.array([lifted[own == k].mean(axis=0) if (own == k).any() else centres[k] for k in range(len(centres))])
    space.pivots = centres
    return space


def _rows(batch: pa.RecordBatch, column: int) -> np.ndarray:
    values = batch.column(column)
    return np.asarray(values.flatten().to_numpy(zero_copy_only=False), dtype=np.int64).reshape(batch.num_rows, -1)


def _keyed(space: Space):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = space.distances(space.lift(_rows(batch, 1).astype(np.float64)))
                near = far.argmin(axis=1)
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(near, pa.int32()), pa.array(far[np.arange(len(near)), near])], names=["vec_id", "vector", "pivot", "distance"])

    return run


def _product(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    if max(np.abs(queries).max(initial=0), np.abs(vectors).max(initial=0)) <= EXACT_DOUBLE:
        return np.rint(queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    return queries @ vectors.T


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Annuli of rows that come sorted by pivot and distance."""
    left: pa.Table | None = None
    names = ["pivot", "low", "high", "ids", "vectors", "dimension"]

    def pack(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        batch = rows.to_batches()[0]
        ids, vectors = batch.column(0).to_numpy(), _rows(batch, 1)
        pivot, distance = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        edges = np.flatnonzero(pivot[1:] != pivot[:-1]) + 1
        cuts = np.unique(np.concatenate([np.arange(a, b, ANNULUS_ROWS) for a, b in zip([0, *edges], [*edges, len(pivot)], strict=True)] + [[len(pivot)]]))
        out = [(int(pivot[a]), float(distance[a]), float(distance[b - 1]), ids[a:b].tobytes(), vectors[a:b].tobytes(), vectors.shape[1]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        kinds = [pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.int32()]
        return pa.record_batch([pa.array([x[k] for x in out], kinds[k]) for k in range(6)], names=names)

    for batch in batches:
        if batch.num_rows:
            now = pa.Table.from_batches([batch])
            left = now if left is None else pa.concat_tables([left, now])
            if left.num_rows >= 8 * ANNULUS_ROWS:
                yield pack(left)
                left = None
    if left is not None:
        yield pack(left)


def _seeds(every: int, k: int):
    """Queries of each annulus with the k-th best score inside it, a bound from which the search starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ids, vectors, dimension in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                ids, vectors = np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.int64).reshape(-1, dimension)
                own = np.flatnonzero(ids % every == 0)
                if len(own):
                    scores = _product(vectors[own], vectors)
                    scores[ids[own][:, None] == ids[None]] = np.iinfo(np.int64).min
                    least = np.sort(scores, axis=1)[:, -k] if len(ids) >= k else np.full(len(own), np.iinfo(np.int64).min)
                    rows += [(int(ids[i]), int(x), vectors[i].tobytes(), dimension) for i, x in zip(own, least, strict=True)]
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32()]
            yield pa.record_batch([pa.array([x[j] for x in rows], kinds[j]) for j in range(4)], names=["query_id", "least", "vector", "dimension"])

    return run


def _merge(row, score, vec, k: int):
    """The k best of each row by score, then smaller id."""
    order = np.lexsort((vec, -score, row))
    row, score, vec = row[order], score[order], vec[order]
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, np.int64)
    place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    keep = place < k
    return row[keep], score[keep], vec[keep], place[keep]


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Annuli in groups of about ``HELD_BYTES``."""
    held, size = [], 0
    for batch in batches:
        for p, a, b, i, v, d in zip(*batch.columns, strict=True):
            held.append((p.as_py(), a.as_py(), b.as_py(), np.frombuffer(i.as_py(), np.int64), np.frombuffer(v.as_py(), np.int64).reshape(-1, d.as_py())))
            size += held[-1][4].nbytes
            if size >= HELD_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def _search(space: Space, query_ids: np.ndarray, query_keys: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int):
    """Each task expands its annuli outward for every query, nearest bound first, until no bound reaches the query's k-th score.

    A task takes its annuli in groups of bounded size; what a query has found goes from one to the next.
    """

    def expand(held: list[tuple], part: slice, floor: np.ndarray, found: tuple) -> tuple:
        pivot, low, high = (np.array([x[j] for x in held]) for j in range(3))
        own, ids = queries[part], query_ids[part]
        real = own.astype(np.float64)
        norm2 = np.einsum("ij,ij->i", real, real)
        far = space.distances(np.column_stack([real, np.zeros(len(real))]))[:, pivot]
        bound = np.maximum(0.0, np.maximum(far - high[None], low[None] - far))
        best = (norm2[:, None] + space.radius2 - np.square(bound)) / 2
        best += 1 + 1e-9 * (norm2[:, None] + space.radius2)
        order = np.argsort(-best, axis=1, kind="stable")
        row, score, vec = found
        for step in range(len(held)):
            at = order[:, step]
            live = np.flatnonzero(best[np.arange(len(own)), at] >= floor)
            if not len(live):
                break
            new = []
            for block in np.unique(at[live]):
                q = live[at[live] == block]
                products = _product(own[q], held[block][4])
                r, c = np.nonzero((products >= floor[q][:, None]) & (held[block][3][None] != ids[q][:, None]))
                new.append((q[r], products[r, c], held[block][3][c]))
            row, score, vec, place = _merge(np.concatenate([row, *(x[0] for x in new)]), np.concatenate([score, *(x[1] for x in new)]), np.concatenate([vec, *(x[2] for x in new)]), k)
            full = place == k - 1
            floor[row[full]] = np.maximum(floor[row[full]], score[full])
        return row, score, vec

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [slice(start, start + 2048) for start in range(0, len(queries), 2048)]
        floors = [least[part].copy() for part in parts]
        found = [(np.zeros(0, np.int64),) * 3 for _ in parts]
        for held in _held(batches):
            for n, part in enumerate(parts):
                found[n] = expand(held, part, floors[n], found[n])
        for part, (row, score, vec) in zip(parts, found, strict=True):
            yield pa.record_batch([pa.array(query_ids[part][row]), pa.array(query_keys[part][row]), pa.array(vec), pa.array(score)], names=["query_id", "query_key", "vec_id", "score"])

    return run


def top_products(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, pivots: int = PIVOTS) -> DataFrame:
    """For every vector whose id is divisible by ``every``, the k highest inner products with all other vectors.

    Components are floor(scale * x); scores are exact integers. Returns query_id, rank (from 1),
    vec_id and score, ties to the smaller vec_id. Reads vec_id and embedding only.

    The index is a table of annuli: rows in order of nearest pivot and distance, cut by ranges of
    (pivot, distance, vec_id), so that neither a crowded pivot nor equal vectors land in one task.
    Pivots are fitted on ``PIVOT_SAMPLE`` rows; every row is indexed. The k-th score inside a
    query's own annulus is its first bound, and tasks give back only what reaches it. The number
    of tasks follows the table, and a task holds a bounded part of its annuli at a time. Queries
    go in passes of ``QUERIES_PER_PASS``, which bounds what a pass sends to the workers.

    Cases: vectors null, empty, or with null or non-finite components take no part, nor do null
    ids; vectors of different lengths are not compared; all rows with the query's id count as
    its own; a query with fewer others gets them all; an empty table gives no rows.
    """
    base = small_batches(vectors).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    whole = base.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(scale) * x).cast("bigint")).alias("vector"))
    result = None
    shapes = whole.groupBy(F.size("vector").alias("n")).agg(F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("radius2")).orderBy("n").collect()
    for shape in shapes:
        own = whole.where(F.size("vector") == shape["n"])
        found = _of_one_length(own, float(shape["radius2"]), k, every, pivots)
        result = found if result is None else result.union(found)
    if result is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    place = F.expr("row_number() over (partition by query_id, query_key order by score desc, vec_id)")
    return result.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _of_one_length(whole: DataFrame, radius2: float, k: int, every: int, pivots: int) -> DataFrame:
    sample = whole.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).select("vector").collect()
    space = _fit(np.array([r["vector"] for r in sample], dtype=np.float64), pivots, radius2)
    keyed = materialize(whole.mapInArrow(_keyed(space), "vec_id bigint, vector array<bigint>, pivot int, distance double"), "topk-keyed")
    tasks = max(1, -(-keyed.count() // TASK_ROWS))
    ranged = keyed.repartitionByRange(tasks, "pivot", "distance", "vec_id").sortWithinPartitions("pivot", "distance", "vec_id")
    index = materialize(ranged.mapInArrow(_packed, INDEX), "topk-index")
    seeds = materialize(index.mapInArrow(_seeds(every, k), SEED).withColumn("query_key", F.xxhash64("vector")).dropDuplicates(["query_id", "query_key"]).withColumn("pass", F.pmod(F.xxhash64("query_id", F.lit("pass")), F.lit(1 << 30))), "topk-seeds")
    passes = max(1, -(-seeds.count() // QUERIES_PER_PASS))
    result = None
    for turn in range(passes):
        rows = seeds.where(F.col("pass") % passes == turn).select("query_id", "query_key", "vector", "least").orderBy("query_id").collect()
        if not rows:
            continue
        queries = np.frombuffer(b"".join(bytes(r["vector"]) for r in rows), dtype=np.int64).reshape(len(rows), -1)
        ids, keys, least = (np.array([r[c] for r in rows], dtype=np.int64) for c in ("query_id", "query_key", "least"))
        found = index.mapInArrow(_search(space, ids, keys, queries, least, k), FOUND)
        if passes > 1:
            found = materialize(found, f"topk-pass{turn}")
        result = found if result is None else result.union(found)
    return result if result is not None else whole.sparkSession.createDataFrame([], FOUND)
