"""Exact top-k inner products by MaxScore.

A term is a vector component, its posting the column of that component's values. Candidates are cut into shards of
bounded size. Within a shard each query knows how much a term can add above its least possible share; the terms with the
largest such bounds, just enough of them that the rest together cannot lift a vector over the query's k-th best score,
are essential. Their postings are traversed for all candidates; the other terms are probed in order of bound, only for
candidates that remain competitive. Shards' best k merge by (score, smaller id).

Queries are a stated set met in blocks of bounded size: a block is broadcast to the tasks that hold the shards, so that
vectors are never shuffled. A task carries each query's k-th best score from shard to shard. Scores are integers, so sums
are exact whatever the order; where a sum could pass what doubles or 64 bits hold, it is taken in wider numbers.

Cases: vectors that are null, hold a null or non-finite component, or whose id is null take no part; vectors of other
lengths than the query's are never its candidates; ties go to the smaller id; rows that repeat an id are separate
candidates, and all rows of the query's own id are left out; components beyond 64 bits count as the nearest 64-bit number;
scores beyond 64 bits rank by their true value and are returned as the nearest 64-bit number; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regista.llm.common import materialize, shared_dir

SHARD = 8192
BLOCK = 16384
#: The widest score that is told from others (38 decimal digits).
WIDEST = 10**38 - 1
GROUP = 8  # terms probed at a time


def usable(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """id and integer components of the vectors that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    ok = ok.where(F.col("id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return ok.select("id", F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x)).alias("v"))


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Shards: (dim, shard, ids, vectors) with at most ``size`` vectors of one length, as packed little-endian longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            lists = batch.column(1)
            dims = np.diff(lists.offsets.to_numpy())
            flat, starts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for dim in np.unique(dims):
                pick = np.flatnonzero(dims == dim)
                for lo in range(0, len(pick), size):
                    part = pick[lo : lo + size]
                    block = np.concatenate([flat[starts[i] : starts[i + 1]] for i in part]) if dim else np.zeros(0, np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(dim)], pa.int32()), pa.array([ids[part].astype("<i8").tobytes()]), pa.array([block.astype("<i8").tobytes()])], names=["dim", "ids", "vectors"]
                    )

    return rows.mapInArrow(run, "dim int, ids binary, vectors binary")


def maxscore(ids: np.ndarray, postings: np.ndarray, query_id: int, q: np.ndarray, high: np.ndarray, low: np.ndarray, k: int, floor: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best candidates of one shard, of those that reach ``floor`` (the k-th best score of shards met
    before); ``postings`` has a row per term, ``high`` and ``low`` its extremes."""
    most, least = np.maximum(q * high, q * low), np.minimum(q * high, q * low)
    order = np.argsort(least - most, kind="stable")  # the widest bounds first
    rest = np.append(np.cumsum(most[order][::-1])[::-1], 0)  # what the terms from the d-th on can add at most
    other = ids != query_id
    first = np.flatnonzero(other)[: 16 * k]
    if not first.size:
        return ids[:0], ids[:0]
    known = np.sort(q @ postings[:, first])[-k] if first.size >= k else -np.inf
    floor = known if floor is None else max(floor, known)
    enough = np.flatnonzero(rest < floor)  # all that the terms from there on add stays below the k-th best
    essential = int(enough[0]) if len(enough) else len(q)
    score = q[order[:essential]] @ postings[order[:essential]]
    alive = np.flatnonzero(other & (score + rest[essential] >= floor))
    score = score[alive]
    for lo in range(essential, len(q), GROUP):
        terms = order[lo : lo + GROUP]
        if len(alive) > k:  # the k-th best so far, were the rest to add as little as they can
            floor = max(floor, np.partition(score, -k)[-k] + least[order[lo:]].sum())
        score = score + q[terms] @ postings[np.ix_(terms, alive)]
        competitive = score + rest[min(lo + GROUP, len(q))] >= floor
        alive, score = alive[competitive], score[competitive]
    best = np.lexsort((ids[alive], -score))[:k]
    return ids[alive][best], score[best].astype(np.int64)


def matrix(raw: bytes, rows: int, dim: int) -> tuple[np.ndarray, int]:
    """A row per term, and the largest magnitude; as doubles where they hold every component."""
    x = np.frombuffer(raw, "<i8").reshape(rows, dim).T
    most = max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
    return x.astype(np.float64) if most < 2**53 else x.copy(), most


class Best:
    """The k best candidates of each query of one length so far, over the shards that a task meets."""

    def __init__(self, query_ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.k, self.found = query_ids, vectors, k, [([], [])] * len(query_ids)
        self.most = [max(map(abs, v.tolist()), default=0) for v in vectors]

    def meet(self, ids: np.ndarray, raw: bytes) -> None:
        dim = self.vectors.shape[1]
        x, most = matrix(raw, len(ids), dim)
        high, low, whole = (x.max(1), x.min(1), None) if dim else (x[:, :0].sum(1), x[:, :0].sum(1), None)
        for i, (query, q) in enumerate(zip(self.ids.tolist(), self.vectors, strict=True)):
            was_ids, was = self.found[i]
            floor = was[-1] if len(was) >= self.k else None
            bound = dim * most * self.most[i]
            if bound < 2**52:
                new, score = maxscore(ids, x, query, q.astype(np.float64), high, low, self.k, floor)
            else:
                if whole is None:
                    whole = np.frombuffer(raw, "<i8").reshape(len(ids), dim).T.astype(np.int64)
                if bound < 2**62:
                    new, score = maxscore(ids, whole, query, q, whole.max(1), whole.min(1), self.k, floor)
                else:  # beyond what machine words hold
                    other = np.flatnonzero(ids != query)
                    new, score = ids[other], [int(s) for s in q.astype(object) @ whole[:, other].astype(object)]
            merged = sorted(zip([*was, *map(int, score)], [*was_ids, *np.asarray(new).tolist()], strict=True), key=lambda x: (-x[0], x[1]))[: self.k]
            self.found[i] = ([m[1] for m in merged], [m[0] for m in merged])

    def rows(self) -> Iterator[tuple[int, int, Decimal]]:
        for query, (ids, scores) in zip(self.ids.tolist(), self.found, strict=True):
            for vec, score in zip(ids, scores, strict=True):
                yield query, vec, Decimal(max(-WIDEST, min(WIDEST, score)))


def met(pieces: DataFrame, asked: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """(query_id, vec_id, wide): the best candidates of each query of one block in each task's shards."""
    shared = pieces.sparkSession.sparkContext.broadcast(asked)  # one block of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}
        for batch in batches:
            for dim, ids, raw in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("dim", "ids", "vectors")), strict=True):
                dim = dim.as_py()
                if dim in shared.value:
                    if dim not in best:
                        best[dim] = Best(*shared.value[dim], k)
                    best[dim].meet(np.frombuffer(ids.as_py(), "<i8"), raw.as_py())
        rows = [r for b in best.values() for r in b.rows()]
        kinds = (pa.int64(), pa.int64(), pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["query_id", "vec_id", "wide"])

    return pieces.select("dim", "ids", "vectors").mapInArrow(run, "query_id long, vec_id long, wide decimal(38,0)")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of ``vectors`` (id, v) for each row of ``queries`` (id, v); of rows that
    repeat a query's id the best results count together."""
    spark = vectors.sparkSession
    queries = materialize(queries.select("id", "v").distinct(), "queries")
    number = max(1, -(-queries.count() // block))
    path = f"{shared_dir(spark)}/asked-{uuid.uuid4().hex}"
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(number)))
    dealt.write.partitionBy("block").parquet(path)
    pieces = materialize(packed(vectors, shard), "shards")
    found = None
    for b in range(number):  # the vectors stay where they are; each block of queries comes to them
        rows = spark.read.schema("id long, v array<long>, block long").parquet(path).where(F.col("block") == b).collect()  # about ``block`` rows
        asked: dict[int, list] = {}
        for r in sorted(rows, key=lambda r: (r.id, r.v)):
            asked.setdefault(len(r.v), []).append(r)
        blocks = {dim: (np.array([r.id for r in some], np.int64), np.array([r.v for r in some], np.int64).reshape(len(some), dim)) for dim, some in asked.items()}
        part = met(pieces, blocks, k)
        if number > 1:
            part = materialize(part, "best")
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("wide"), "vec_id"))
    limit = F.lit(2**63 - 1).cast("decimal(38,0)")
    score = F.greatest(F.least("wide", limit), -limit).cast("long").alias("score")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score)
