"""Exact top-k by inner product with MaxScore.

The components of a vector are its terms. Vectors are taken in shards of a scan, each with the postings of every term
and the bounds of its weights there. For each query, the terms whose score bounds together can't reach its k-th best
score so far are non-essential. The postings of the essential terms are traversed for all vectors of the shard; the
others are probed one by one, as long as a vector can still compete. Queries of which all terms are essential are
traversed together, as one product. A task carries each query's k best from shard to shard, and tasks' results are
merged by rank. Queries are sent to the tasks in blocks of a fixed size, vectors are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

#: Vectors of a shard, bytes of the queries that are broadcast at once, and queries of one product.
SHARD_ROWS, BLOCK_BYTES, TOGETHER = 8_192, 1 << 25, 256

#: A query whose non-essential terms are fewer than this share of all is traversed together with others.
LEAST_SKIPPED = 0.25


def scaled(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component, as a double, which is exact; null if the vector or a component is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    value = F.transform(vector, lambda x: x.cast("double") * scale)
    # floor() of a double gives a long; components beyond it are whole numbers already
    return F.when(fine, F.transform(value, lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)))


def matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """A row for each list, ending in zeros."""
    values, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    sizes = np.diff(ends, prepend=0)
    out = np.zeros((len(lists), width))
    rows = np.repeat(np.arange(len(lists)), sizes)
    out[rows, np.arange(len(values)) - np.repeat(ends - sizes, sizes)] = values
    return out


class Best:
    """The k best of each query so far: scores, ids and rows, best first; ties to the smaller id, then the smaller row."""

    def __init__(self, queries: int, k: int):
        self.k, self.found = k, [(np.empty(0, object), np.empty(0, np.int64), np.empty(0, np.int64))] * queries

    def floor(self, q: int):
        """The k-th best score, None as long as there are fewer."""
        scores = self.found[q][0]
        return scores[-1] if len(scores) == self.k else None

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        own = self.found[q]
        scores, ids, rows = np.concatenate([own[0], scores]), np.concatenate([own[1], ids]), np.concatenate([own[2], rows])
        top = np.lexsort((rows, ids, -scores))[: self.k] if scores.dtype != object else np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i], rows[i]))[: self.k], np.int64)
        self.found[q] = scores[top], ids[top], rows[top]


def traverse(queries: np.ndarray, query_rows: np.ndarray, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, best: Best) -> int:
    """Take the vectors of one shard into account; returns how many probes of single weights were skipped."""
    postings = np.ascontiguousarray(vectors.T)
    # a term's contributions are moved to start at zero; what they were moved by is added at the end
    low, high = postings.min(axis=1), postings.max(axis=1)
    at_low, at_high = queries * low, queries * high
    lows, bounds = np.minimum(at_low, at_high), np.abs(at_high - at_low)
    orders = np.argsort(bounds, axis=1, kind="stable")  # least first
    reach = np.cumsum(np.take_along_axis(bounds, orders, axis=1), axis=1)
    floors = np.array([-np.inf if (f := best.floor(q)) is None else f for q in range(len(queries))], float)
    cuts = (reach < (floors - lows.sum(axis=1))[:, None]).sum(axis=1)  # so many terms are non-essential
    skipped = 0
    alone = cuts >= LEAST_SKIPPED * vectors.shape[1]
    together = np.flatnonzero(~alone)
    for at in range(0, len(together), TOGETHER):
        block = together[at : at + TOGETHER]
        for q, scores in zip(block, queries[block] @ postings, strict=True):
            near = np.flatnonzero((scores >= floors[q]) & (rows != query_rows[q]))
            if len(near) > best.k:  # all that tie with the k-th of these
                least = np.partition(scores[near], len(near) - best.k)[len(near) - best.k]
                near = near[scores[near] >= least]
            if len(near):
                best.add(q, scores[near], ids[near], rows[near])
    for q in np.flatnonzero(alone):
        rest, essential = orders[q, : cuts[q]][::-1], orders[q, cuts[q] :]
        scores = queries[q, essential] @ postings[essential]
        slack, near = bounds[q, rest].sum() + lows[q, rest].sum(), np.flatnonzero(rows != query_rows[q])
        near = near[scores[near] + slack >= floors[q]]
        for i, term in enumerate(rest):
            if not len(near):
                skipped += (len(rest) - i) * vectors.shape[0]
                break
            scores[near] += queries[q, term] * postings[term, near]
            slack -= bounds[q, term] + lows[q, term]
            skipped += vectors.shape[0] - len(near)
            near = near[scores[near] + slack >= floors[q]]
        if len(near):
            best.add(q, scores[near], ids[near], rows[near])
    return skipped


def traverse_exactly(queries: np.ndarray, query_rows: np.ndarray, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, best: Best) -> None:
    """The same by whole numbers of any size, for weights whose products a double doesn't hold."""
    whole = [[int(x) for x in v] for v in vectors]
    for q, query in enumerate(queries):
        own = [int(x) for x in query]
        scores = np.array([sum(a * b for a, b in zip(own, v, strict=True)) for v in whole], object)
        near = np.flatnonzero(rows != query_rows[q])
        best.add(q, scores[near], ids[near], rows[near])


def search(embeddings: DataFrame, every: int = 100, k: int = 10, scale: float = 1024.0) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each row whose vec_id is divisible by ``every``.

    Components become floor(scale * x), exactly; rows with a null id, or whose vector is null or holds a null or a
    component that isn't finite, take no part. Shorter vectors count as ending in zeros. The query's own row is no
    candidate, but others of its id are; queries that share an id are answered each. No queries or candidates give no
    rows. Weights too large for products in doubles are multiplied as whole numbers; a score of the k best beyond 64
    bits is an error. Other columns are ignored.
    """
    spark = embeddings.sparkSession
    vectors = stored(embeddings.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding"), scale).alias("v")).where("vec_id is not null and v is not null"))
    asked = stored(vectors.where(F.col("vec_id") % every == 0))
    size = asked.agg(F.count("*").alias("q")).first()["q"]
    width = vectors.agg(F.coalesce(F.max(F.size("v")), F.lit(0)).alias("w")).first()["w"]
    blocks = max(1, -(-size * 8 * max(width, 1) // BLOCK_BYTES))

    def found_of(block: int) -> tuple[Broadcast, DataFrame]:
        rows = asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).toArrow()  # about BLOCK_BYTES
        sent = spark.sparkContext.broadcast((rows["row"].to_numpy(), rows["vec_id"].to_numpy(), matrix(rows["v"].combine_chunks(), width)))

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            query_rows, query_ids, queries = sent.value
            best, held = Best(len(queries), k), []
            widest = np.abs(queries).max(initial=0)

            def close() -> None:
                own, ids, rows = (np.concatenate(x) for x in zip(*held, strict=True))
                fits = widest * np.abs(own).max(initial=0) * max(width, 1) < 2.0**52
                (traverse if fits else traverse_exactly)(queries, query_rows, own, ids, rows, best)

            for b in batches:
                if len(queries):
                    held.append((matrix(b.column("v"), width), b.column("vec_id").to_numpy(), b.column("row").to_numpy()))
                    if sum(len(x) for x, *_ in held) >= SHARD_ROWS:
                        close()
                        held = []
            if sum(len(x) for x, *_ in held):
                close()
            for q, (scores, ids, _) in enumerate(best.found):
                if len(ids):
                    values = [int(x) for x in scores]
                    if max(map(abs, values)) >= 1 << 63:
                        raise OverflowError(f"a score of query {query_ids[q]} doesn't fit 64 bits")
                    n = len(ids)
                    yield pa.record_batch([pa.array(np.full(n, query_rows[q])), pa.array(np.full(n, query_ids[q])), pa.array(ids), pa.array(values, pa.int64())], ["query_row", "query_id", "vec_id", "score"])

        return sent, vectors.mapInArrow(each, "query_row long, query_id long, vec_id long, score long")

    def found_and_stored(block: int) -> DataFrame:
        sent, found = found_of(block)
        found = stored(found)
        sent.destroy()  # so that driver and executors hold one block at a time
        return found

    found = found_of(0)[1] if blocks == 1 else reduce(DataFrame.unionByName, map(found_and_stored, range(blocks)))
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
