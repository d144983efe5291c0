"""Exact top-k search by distributed histogram selection.

Queries come in blocks of bounded size. For each block every candidate is scored in each round; tasks count
their scores in bins of the interval that still holds a query's k-th score, best bins first and no further
than k scores, since a lower bin of the same task can't hold it. The summed histograms say which bin holds
the k-th score, and the next round divides that bin, until it is one score wide. Then all scores above it
pass, and of those that equal it the ones with the smallest ids.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, session, table

#: Queries of a block: their vectors and intervals are all that the driver and a task hold of them.
QUERY_BLOCK = 8192
#: Scores held at once in a task.
SCORES = 1 << 20
BINS = 1024
LONG = (-(1 << 63), (1 << 63) - 1)


def _usable(vectors: DataFrame, scale: int) -> DataFrame:
    """``(vec_id, v array<double>)`` with floor(scale * x), of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    sound = F.col("vec_id").isNotNull() & x.isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    # floor() of a double gives a long; rint of x - 0.5 wouldn't floor whole numbers
    floor = lambda e: F.when(F.abs(e * scale) < 9e18, F.floor(e * scale).cast("double")).otherwise(e * scale)
    return vectors.where(F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long"), F.transform(x, floor).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors as rows; shorter ones end in zeros."""
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    out = np.zeros((len(column), max(dim, int(np.diff(offsets).max(initial=0)))))
    lengths = np.diff(offsets)
    out[np.repeat(np.arange(len(column)), lengths), np.arange(len(flat)) - np.repeat(offsets[:-1], lengths)] = flat
    return out


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products. Doubles serve while all sums stay under 2**53; else whole numbers of any size, held to a long's range."""
    dim = min(q.shape[1], c.shape[1])
    q, c = q[:, :dim], c[:, :dim]
    if dim * np.abs(q).max(initial=0) * np.abs(c).max(initial=0) < 2.0**53:
        return (q @ c.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = whole(q).dot(whole(c).T) if q.size and c.size else np.zeros((len(q), len(c)), object)
    return np.vectorize(lambda x: min(max(x, LONG[0]), LONG[1]), otypes=[np.int64])(exact)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, bins: int = BINS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k candidates with the highest inner products for each query.

    ``vectors`` and ``queries`` have ``(vec_id, embedding)``; components become floor(scale * x). A candidate
    with the query's own id doesn't count. Ties go to the smaller vec_id; fewer candidates than k are all
    returned. Vectors without id, null, or with null or non-finite components take no part. Of vectors of
    different lengths the shorter counts as ending in zeros; a score beyond a long is held to its range.
    A repeated vec_id: each row is a candidate, and equal queries are answered once (for the row that comes
    first by its components). Empty tables give an empty result.
    """
    spark = session(vectors)
    scratch = Scratch(spark)
    base = scratch.save(_usable(vectors, scale), "vectors")
    asked = _usable(queries, scale).groupBy("vec_id").agg(F.min("v").alias("v"))
    ids = Window.partitionBy("part").orderBy("vec_id")
    # numbered without one task for all: ranges of ids, and each range's rows before it
    ranged = scratch.save(asked.repartitionByRange(F.col("vec_id")).withColumn("part", F.spark_partition_id()), "queries")
    numbered = ranged.withColumn("__pw_n", F.row_number().over(ids) - 1)
    out = None
    for parts, at in _blocks(ranged):
        held = numbered.where(F.col("part").isin(parts) & F.col("__pw_n").between(at, at + QUERY_BLOCK - 1)).select("vec_id", "v").toArrow()
        found = scratch.save(_answer(spark, base, held, k, bins), "found")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def _blocks(ranged: DataFrame) -> list[tuple[list[int], int]]:
    """Blocks as (partitions, first row in each): a large partition makes several, small neighbours are asked together."""
    out, parts, held = [], [], 0
    for row in ranged.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():
        if parts and held + row.n > QUERY_BLOCK:
            out.append((parts, 0))
            parts, held = [], 0
        if row.n > QUERY_BLOCK:
            out += [([row.part], at) for at in range(0, row.n, QUERY_BLOCK)]
        else:
            parts, held = [*parts, row.part], held + row.n
    return [*out, (parts, 0)] if parts else out


def _answer(spark: SparkSession, base: DataFrame, held: pa.Table, k: int, bins: int) -> DataFrame:
    """The answers for one block of queries."""
    order = np.argsort(held.column("vec_id").to_numpy())
    ids = held.column("vec_id").to_numpy()[order]
    lists = held.column("v").combine_chunks()
    q = _matrix(lists if isinstance(lists, pa.ListArray) else lists.cast(pa.list_(pa.float64())), 0)[order]
    n = len(ids)

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """Queries, candidates' ids, scores, and where they are the query itself."""
        mine, vectors = sent.value
        for batch in batches:
            cand = batch.column("vec_id").to_numpy()
            c = _matrix(batch.column("v"), vectors.shape[1])
            step = max(1, SCORES // max(1, len(cand)))
            for a in range(0, len(mine), step):
                part = slice(a, min(a + step, len(mine)))
                yield part, cand, _scores(vectors[part], c), mine[part][:, None] == cand[None, :]

    def bounds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, count = np.full(n, LONG[1]), np.full(n, LONG[0]), np.zeros(n, np.int64)
        for part, _, s, own in blocks(batches):
            low[part] = np.minimum(low[part], np.where(own, LONG[1], s).min(axis=1))
            high[part] = np.maximum(high[part], np.where(own, LONG[0], s).max(axis=1))
            count[part] += (~own).sum(axis=1)
        has = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (has, low[has], high[has], count[has])], names=["q", "low", "high", "n"])

    sent = spark.sparkContext.broadcast((ids, q))
    found = base.mapInArrow(bounds, "q long, low long, high long, n long").groupBy("q").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).toArrow()
    live = found.column("q").to_numpy()
    low, high, want = np.zeros(n, object), np.full(n, -1, object), np.zeros(n, np.int64)
    # the k-th score of each query lies in low..high, and `want` scores of that interval are still to be taken
    low[live], high[live] = found.column("low").to_numpy().astype(object), found.column("high").to_numpy().astype(object)
    want[live] = np.minimum(k, found.column("n").to_numpy())

    while True:
        width = np.array([max(1, -(-(int(h) - int(w) + 1) // bins)) for w, h in zip(low, high)], object)
        wide = np.array([bool(h > w) for w, h in zip(low, high)])
        if not wide.any():
            break
        state = spark.sparkContext.broadcast((low.astype(np.int64), high.astype(np.int64), np.minimum(width, LONG[1]).astype(np.int64), wide))

        def counts(batches: Iterable[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            lo, hi, by, todo = state.value
            held: dict[int, dict[int, int]] = {}
            for part, _, s, own in blocks(batches):
                able = (s >= lo[part, None]) & (s <= hi[part, None]) & todo[part, None] & ~own
                if s.shape[1] > k:  # lower ones than this block's k-th can't be the k-th of all
                    able &= s >= np.partition(np.where(able, s, LONG[0]), -k, axis=1)[:, -k, None]
                rows, cols = np.nonzero(able)
                if not len(rows):
                    continue
                at = rows + part.start
                gap = s[rows, cols].astype(np.uint64) - lo[at].astype(np.uint64)
                bin_ = (gap // by[at].astype(np.uint64)).astype(np.int64)
                keys, sums = np.unique(at * bins + bin_, return_counts=True)
                for key, m in zip(keys.tolist(), sums.tolist()):
                    one = held.setdefault(key // bins, {})
                    one[key % bins] = one.get(key % bins, 0) + m
            out = []
            for i, one in held.items():
                total = 0
                for b in sorted(one, reverse=True):
                    out.append((i, b, one[b]))
                    total += one[b]
                    if total >= k:
                        break
            cols = list(zip(*out)) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["q", "bin", "n"])

        summed = base.mapInArrow(counts, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        better = Window.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
        summed = summed.withColumn("above", F.coalesce(F.sum("n").over(better), F.lit(0)))
        wants = spark.createDataFrame(pa.table({"q": np.arange(n), "want": want}))
        kth = summed.join(F.broadcast(wants), "q").where("above < want and above + n >= want").select("q", "bin", "above").toArrow()  # at most a row a query
        at, bin_, above = (kth.column(c).to_numpy() for c in ("q", "bin", "above"))
        low[at] = low[at] + bin_.astype(object) * width[at]
        high[at] = np.minimum(high[at], low[at] + width[at] - 1)
        want[at] -= above
        state.unpersist()

    edge = spark.sparkContext.broadcast((low.astype(np.int64), np.isin(np.arange(n), live)))

    def passed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, has = edge.value
        ties: list[list[int]] = [[] for _ in range(n)]
        for part, cand, s, own in blocks(batches):
            able = ~own & has[part, None]
            rows, cols = np.nonzero((s > least[part, None]) & able)
            if len(rows):
                yield _rows(ids[rows + part.start], cand[cols], s[rows, cols])
            rows, cols = np.nonzero((s == least[part, None]) & able)
            for i in np.unique(rows):
                mine = cand[cols[rows == i]] if len(rows) < 4096 else cand[cols[np.searchsorted(rows, i) : np.searchsorted(rows, i, "right")]]
                ties[i + part.start] = sorted([*ties[i + part.start], *(np.partition(mine, k - 1)[:k] if len(mine) > k else mine).tolist()])[:k]
        sizes = [len(x) for x in ties]
        yield _rows(np.repeat(ids, sizes), np.array([x for t in ties for x in t], np.int64), np.repeat(least, sizes))

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    got = base.mapInArrow(passed, "query_id long, vec_id long, score long")
    return got.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _rows(q: np.ndarray, c: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (q, c, s)], names=["query_id", "vec_id", "score"])


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best candidates of each row whose vec_id is divisible by 50, among all other rows."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))
