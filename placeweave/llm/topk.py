"""Exact top-k by inner product with MaxScore over shards (operator 8)."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries and rows of a task, at most about; both sides are cut into as many blocks and shards as the tables need.
QUERY_BLOCK, SHARD_ROWS = 16384, 32768
#: Rows of a shard at least, if there are shards enough for all cores.
LEAST_ROWS = 2048
#: Queries and rows that are scored at a time.
AT_ONCE, ROWS_AT_ONCE = 256, 2048
#: Rows that all queries are scored against first, for thresholds that hold over all shards.
LOOK = 2048
#: How many times a score by itself costs what it costs within a product of matrices.
PROBE_COST = 24


def integer_vectors(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """(vec_id, v): components as floor(scale * x), x as double. Null ids, null vectors and vectors with null or non-finite components are left out."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & ~bad)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double"))).alias("v"))


def _floats(largest: int) -> type:
    """Floats in which sums of products up to `largest` in total are exact."""
    if largest >= 2**53:
        raise ValueError("scores of 2**53 and more are not exact")
    return np.float32 if largest < 2**24 else np.float64


def matrix_of(lists: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, short ones padded with zeros."""
    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lists.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def best_of(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k highest scores, ties to the smaller id, in the order of queries and ranks."""
    order = np.lexsort((ids, -scores, query))
    sorted_ = query[order]
    return order[np.arange(len(order)) - np.searchsorted(sorted_, sorted_, "left") < k]


def first_look(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(score, id) of each query's k-th best among some rows, its own id left out; what comes behind it can't be among the k best of all."""
    theta, last = np.full(len(queries), -(2.0**62)), np.full(len(queries), 2**63 - 1, np.int64)
    if len(rows) < k:
        return theta, last
    kind = _floats(int(np.abs(queries).max(initial=0)) * int(np.abs(rows).sum(axis=1).max()))
    by_id = np.argsort(row_ids, kind="stable")
    row_ids, r = row_ids[by_id], rows[by_id].astype(kind).T
    for at in range(0, len(queries), AT_ONCE):
        score = queries[at : at + AT_ONCE].astype(kind) @ r
        score[query_ids[at : at + AT_ONCE, None] == row_ids] = -np.inf
        kth = np.partition(score, len(row_ids) - k, axis=1)[:, len(row_ids) - k]
        more = k - (score > kth[:, None]).sum(axis=1)  # so many of those with the k-th score count, by id
        ties = np.cumsum(score == kth[:, None], axis=1) == more[:, None]
        ok = np.isfinite(kth)
        theta[at : at + AT_ONCE][ok], last[at : at + AT_ONCE][ok] = kth[ok], row_ids[ties.argmax(axis=1)][ok]
    return theta, last


def maxscore(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, theta: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, row id, score) of the rows of a shard that can be among a query's k best, at most k for each, its own id left out.

    A dimension is a term and a row's component its weight. theta and last are the score and id to beat, as of first_look,
    and rise with every block of rows. Rows come by falling length, so blocks too short for all thresholds are skipped.
    In a block, terms are ordered by what they can add at most, which the block's extreme values bound. Essential are the
    leading ones: without them no row reaches a query's threshold. Their postings are traversed for all rows. The other
    terms are probed for the rows that can still compete, for which a row's length in these terms is a second bound; where
    most can, they are probed for all rows at once. Integers are held in floats that are exact for all sums at hand.
    """
    length = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))
    order = np.lexsort((row_ids, -length))
    rows, row_ids, length = rows[order], row_ids[order], length[order]
    largest = int(np.abs(queries).max(initial=0)) * int(np.abs(rows).sum(axis=1).max(initial=0))
    kind = _floats(largest)
    reach = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
    near = np.lexsort(queries.T[np.argsort(np.abs(queries).sum(axis=0))])  # like queries side by side
    theta, last = theta.copy(), last.copy()
    out: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(queries), AT_ONCE):
        mine = near[at : at + AT_ONCE]
        q, own = queries[mine].astype(kind), query_ids[mine]
        held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float64))
        for top in range(0, len(rows), ROWS_AT_ONCE):
            block, ids = rows[top : top + ROWS_AT_ONCE], row_ids[top : top + ROWS_AT_ONCE]
            if (reach[mine] * length[top] * (1 + 1e-9) < theta[mine]).all():
                break
            high, low = block.max(axis=0), block.min(axis=0)
            most = np.maximum(q * high, q * low).astype(np.float64)
            terms = np.argsort(-most.max(axis=0), kind="stable")
            rest = np.cumsum(most[:, terms][:, ::-1], axis=1)[:, ::-1]  # what terms from the j-th on can add
            needed = (rest >= theta[mine, None]).any(axis=0)
            split = int(np.flatnonzero(needed)[-1]) + 1 if needed.any() else 0
            if not split:
                continue
            qt, bt = q[:, terms], block[:, terms].astype(kind)
            score = (qt[:, :split] @ bt[:, :split].T).astype(np.float64)
            score[own[:, None] == ids] = -np.inf
            goal, tie = theta[mine, None], last[mine, None]
            if split < len(terms):
                tail = np.sqrt((qt[:, split:].astype(np.float64) ** 2).sum(axis=1))[:, None] * np.sqrt((bt[:, split:].astype(np.float64) ** 2).sum(axis=1))
                alive = score + np.minimum(rest[:, split : split + 1], tail * (1 + 1e-9) + 1e-6) >= goal
                if PROBE_COST * np.count_nonzero(alive) < alive.size:
                    i, j = np.nonzero(alive)
                    found = score[i, j] + np.einsum("nd,nd->n", qt[i, split:].astype(np.float64), bt[j, split:])
                    keep = (found > goal[i, 0]) | (found == goal[i, 0]) & (ids[j] <= tie[i, 0])
                    i, j, found = i[keep], j[keep], found[keep]
                else:
                    score += qt[:, split:] @ bt[:, split:].T
                    i, j = np.nonzero((score > goal) | (score == goal) & (ids <= tie))
                    found = score[i, j]
            else:
                i, j = np.nonzero((score > goal) | (score == goal) & (ids <= tie))
                found = score[i, j]
            if not len(i):
                continue
            real = np.isfinite(found)
            held = tuple(np.concatenate(x) for x in zip(held, (i[real], ids[j[real]], found[real]), strict=True))
            best = best_of(held[0], held[1], held[2], k)
            held = tuple(x[best] for x in held)
            n = np.bincount(held[0], minlength=len(mine))
            full = np.flatnonzero(n >= k)
            kth = np.cumsum(n)[full] - 1  # beats or is what was to beat
            theta[mine[full]], last[mine[full]] = held[2][kth], held[1][kth]
        out.append((mine[held[0]], held[1], held[2].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products over all rows but its own id.

    vectors(vec_id, v) as of integer_vectors; is_query picks the queries among them. Ties go to the smaller vec_id; with
    fewer rows all are ranked. Vectors of unequal length count as padded with zeros. Repeated rows are ranked each; an id
    that comes with several vectors is as many queries. No queries, or no rows, give an empty result. Other columns are
    ignored, whatever their names.

    Every query first gets a threshold from the same LOOK rows, which is valid for all shards. Queries are then cut into
    blocks and rows into shards by a hash; a task scores a block against a shard, and the shards' k best of each query are
    merged by rank. So no task holds more than a block and a shard; up to QUERY_BLOCK queries no row is copied.
    """
    vectors = vectors.select("vec_id", "v")
    counted = vectors.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q"), F.max(F.size("v")).alias("d")).first()
    spark, width = vectors.sparkSession, counted["d"] or 1
    cores = spark.sparkContext.defaultParallelism
    blocks = max(1, math.ceil(counted["q"] / QUERY_BLOCK))
    shards = max(1, math.ceil(counted["n"] / SHARD_ROWS), min(2 * cores // blocks, counted["n"] // LEAST_ROWS))
    spread = F.xxhash64("vec_id", "v")
    row = vectors.select("vec_id", "v", F.lit(None).cast("double").alias("theta"), F.lit(None).cast("long").alias("last"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.pmod(spread, F.lit(shards)).cast("int").alias("s"))
    look = vectors.orderBy(F.xxhash64("vec_id", "v", F.lit("look")), "vec_id", "v").limit(LOOK).toArrow()  # LOOK rows at most
    look_ids, look_rows = look["vec_id"].to_numpy(), matrix_of(look["v"].combine_chunks(), width)

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            theta, last = first_look(matrix_of(batch.column(1), width), batch.column(0).to_numpy(), look_rows, look_ids, k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(theta), pa.array(last)], ["vec_id", "v", "theta", "last"])

    aimed = vectors.where(is_query).dropDuplicates(["vec_id", "v"]).mapInArrow(aim, "vec_id long, v array<long>, theta double, last long")
    ask = aimed.select("vec_id", "v", "theta", "last", F.pmod(F.xxhash64("vec_id", "v", F.lit("block")), F.lit(blocks)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"))

    def run(group: pa.Table) -> pa.Table:
        asks = group["theta"].is_valid().to_numpy()
        ids, matrix = group["vec_id"].to_numpy(), matrix_of(group["v"].combine_chunks(), width)
        theta, last = (group[c].combine_chunks().fill_null(0).to_numpy()[asks] for c in ("theta", "last"))
        q, own = matrix[asks], ids[asks]
        place, found, scores = maxscore(q, own, matrix[~asks], ids[~asks], k, theta, last)
        key = np.array([zlib.crc32(x.tobytes()) for x in q], np.int64)
        return pa.table([pa.array(x.astype(np.int64)) for x in (own[place], key[place], found, scores)], names=["query_id", "query", "vec_id", "score"])

    found = row.unionByName(ask).groupBy("b", "s").applyInArrow(run, "query_id long, query long, vec_id long, score long")
    w = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
