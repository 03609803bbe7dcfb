"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation.

Vectors are turned into integers. Queries and candidates are dealt into blocks by a hash of their id, and every pair
of a query block with a candidate block is one bounded group of a Spark shuffle. Inside a group the query block is
inverted into postings (component -> queries with a non-zero weight), and the candidates are worked through in slices:
each posting list is scattered, weighted with the slice's component, into a dense score array, from which a partition
selection keeps the k best of each query so far. So a block gives k survivors a query however many slices it has, and a
window merges the blocks' survivors.

Defined results: vectors that are null, or hold a null, NaN or infinite component, take no part, nor do rows without
an id. Missing components of a shorter vector count as zero; an empty vector scores zero with everything. Of rows that
repeat an id, the smallest vector counts (they always meet in one block). An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship

QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 8192
SLICE = 512


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, vector of long): floor(scale * component), components as double."""
    v = F.col(vec_col)
    whole = v.isNotNull() & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    )
    return vectors.where(F.col(id_col).isNotNull() & F.coalesce(whole, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("vec"),
    )


def _matrix(frame: pd.DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ids in ascending order, each once (with its smallest vector), and the vectors."""
    ids = frame["id"].to_numpy(np.int64)
    vecs = [np.asarray(v, dtype=np.int64) for v in frame["vec"]]
    if len(np.unique(ids)) < len(ids):
        best: dict[int, np.ndarray] = {}
        for i, v in zip(ids.tolist(), vecs, strict=True):
            if i not in best or v.tolist() < best[i].tolist():
                best[i] = v
        ids, vecs = np.array(list(best), dtype=np.int64), list(best.values())
    order = np.argsort(ids)
    return ids[order], [vecs[i] for i in order]


def _dense(vecs: list[np.ndarray], width: int) -> np.ndarray:
    if vecs and all(len(v) == width for v in vecs):
        return np.stack(vecs)
    out = np.zeros((len(vecs), width), dtype=np.int64)
    for i, v in enumerate(vecs):
        out[i, : len(v)] = v
    return out


def score_block(queries: pd.DataFrame, rows: pd.DataFrame, k: int, size: int = SLICE) -> pd.DataFrame:
    """The k best rows of a block for each query of a block: score descending, then id ascending."""
    empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
    if queries.empty or rows.empty:
        return empty
    qid, q = _matrix(queries)
    vid, v = _matrix(rows)
    width = max((len(x) for x in [*q, *v]), default=0)
    qs = _dense(q, width)
    postings = [np.flatnonzero(qs[:, term]) for term in range(width)]
    best_id, best = np.zeros((len(qid), 0), np.int64), np.zeros((len(qid), 0), np.int64)
    for at in range(0, len(vid), size):
        ids, terms = vid[at : at + size], np.ascontiguousarray(_dense(v[at : at + size], width).T)
        scores = np.zeros((len(qid), len(ids)), dtype=np.int64)
        for term, posting in enumerate(postings):
            if len(posting):
                scores[posting] += qs[posting, term, None] * terms[term]
        own = ids[np.minimum(np.searchsorted(ids, qid), len(ids) - 1)] == qid
        best_id, best = _merged(best_id, best, ids, scores, np.where(own, qid, -1), own, k)
    keep = best > NONE
    return pd.DataFrame({"query_id": np.repeat(qid, keep.sum(axis=1)), "vec_id": best_id[keep], "score": best[keep]})


#: below every score
NONE = np.iinfo(np.int64).min


def _merged(best_id, best, ids, scores, own_id, own, k):
    """The k best of those known and a slice: ids ascend from slice to slice, so of equal scores the earlier ones stay."""
    scores[own, np.searchsorted(ids, own_id[own])] = NONE
    both = np.concatenate([best, scores], axis=1)
    all_ids = np.concatenate([best_id, np.broadcast_to(ids, scores.shape)], axis=1)
    if both.shape[1] <= k:
        return all_ids, both
    bound = np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k]
    over = both > bound[:, None]
    ties = both == bound[:, None]
    room = k - over.sum(axis=1)
    pick = over | ties & (np.cumsum(ties, axis=1) <= room[:, None])
    return all_ids[pick].reshape(len(both), k), both[pick].reshape(len(both), k)


def exact_top_k(
    queries: DataFrame,
    rows: DataFrame,
    k: int = 10,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    scale: int = 1024,
    query_block: int = QUERY_BLOCK,
    candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product for each query, ties to the smaller id."""
    ship(rows.sparkSession)
    q, c = quantised(queries, id_col, vec_col, scale), quantised(rows, id_col, vec_col, scale)
    n_q = max(1, -(-queries.select(id_col).count() // query_block))
    n_c = max(1, -(-rows.select(id_col).count() // candidate_block))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(n_q)).cast("int")).withColumn("cb", spread(n_c))
    c = c.withColumn("cb", F.pmod(F.xxhash64("id"), F.lit(n_c)).cast("int")).withColumn("qb", spread(n_q))
    best = (
        q.groupBy("qb", "cb")
        .cogroup(c.groupBy("qb", "cb"))
        .applyInPandas(lambda a, b: score_block(a, b, k), "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        best.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
