"""Approximate nearest neighbours over sharded, robust-pruned directed graphs.

Vectors are dealt into shards of about ``SHARD_ROWS``, a bound on what one task holds. Each shard builds a graph: points go in by
batches, a greedy beam search proposes neighbours, relaxed distance pruning
(``alpha``) keeps a diverse few of them, and back edges are pruned alike. A dense cluster would fill all edges of its points and
cut itself off, so each point also has a few random links that are never pruned, and searches start from several points.

Graphs are built once and written to the shared folder, and so are the queries, in blocks of about ``BLOCK_ROWS``. A search
task takes one block and up to ``SHARDS_A_TASK`` shards, maps their files, searches by beam and returns the best of
those shards; so vectors are shuffled once, whatever the number of shards, and no task holds more than a block and a shard. The
tasks' bests are merged by a window. Scores are the cosines of the original vectors in double precision; each vector is first
scaled by a power of two, which changes no digit and keeps huge and tiny components from overflowing.

Rows with one and the same vector form a class: one representative enters the graph, so a vector
that a third of the rows share costs one point, and the class is opened at the end. An answer of k needs
at most the k + 1 smallest ids of a class; a window limit takes them before the shuffle.

Edge cases: vectors that are null, zero, or hold a null or non-finite component take no part, nor do
null ids. Repeated rows (one id, one vector) count once. Vectors are compared with those of their own
length. With fewer candidates than k all are returned; with none, or an empty table, nothing. Ties go
to the smaller id. Further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from gleanery.llm.common import open_mapped, put_file, shared_path, small, stored
from gleanery.session import table

SHARD_ROWS = 1 << 14
BLOCK_ROWS = 1 << 12
SHARDS_A_TASK = 8
DEGREE = 24
LONG_LINKS = 4
ENTRIES = 48
BEAM = 64
ALPHA = 1.2
BATCH = 256


def beam_search(x: np.ndarray, graph: np.ndarray, starts: np.ndarray, queries: np.ndarray, beam: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Per query the best ``beam`` points met (ids, cosines), best first, -1 where there are fewer."""
    nq = len(queries)
    rows = np.arange(nq)[:, None]
    ids = np.full((nq, beam), -1)
    sims = np.full((nq, beam), -np.inf, np.float32)
    done = np.ones((nq, beam), bool)
    seen = np.zeros((nq, len(x) + 1), bool)  # the last column takes the place of no neighbour
    first = queries @ x[starts].T
    best = np.argsort(-first, axis=1, kind="stable")[:, :beam]
    n = best.shape[1]
    ids[:, :n], sims[:, :n], done[:, :n] = starts[best], np.take_along_axis(first, best, 1), False
    seen[:, starts] = True
    while not done.all():
        order = np.argsort(np.where(done, np.inf, -sims), axis=1, kind="stable")[:, :width]
        open_ = ~done[rows, order]
        at = np.where(open_, ids[rows, order], -1)
        done[rows, order] = True
        near = np.where(at[:, :, None] >= 0, graph[at], -1).reshape(nq, -1)
        near = np.sort(near, axis=1)
        fresh = (near >= 0) & ~seen[rows, near]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        seen[rows, np.where(fresh, near, -1)] = True
        s = np.where(fresh, np.einsum("qd,qnd->qn", queries, x[near]), -np.inf).astype(np.float32)
        all_ids = np.concatenate([ids, np.where(fresh, near, -1)], axis=1)
        all_sims = np.concatenate([sims, s], axis=1)
        all_done = np.concatenate([done, ~fresh], axis=1)
        best = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        ids, sims, done = all_ids[rows, best], all_sims[rows, best], all_done[rows, best]
    return ids, sims


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Diverse neighbours for each point out of its candidates (-1: none), nearest first.

    The nearest live candidate is kept; those that are ``alpha`` times nearer to it than to the
    point are dropped; and so on.
    """
    candidates = np.sort(candidates, axis=1)
    live = (candidates >= 0) & (candidates != points[:, None])
    live[:, 1:] &= candidates[:, 1:] != candidates[:, :-1]
    cx = x[candidates]
    dist = np.where(live, np.maximum(2 - 2 * np.einsum("pd,pcd->pc", x[points], cx), 0), np.inf)
    between = np.maximum(2 - 2 * np.einsum("pcd,pkd->pck", cx, cx), 0)
    rows = np.arange(len(points))
    out = np.full((len(points), degree), -1)
    for k in range(degree):
        pick = np.argmin(dist, axis=1)
        ok = np.isfinite(dist[rows, pick])
        if not ok.any():
            break
        out[ok, k] = candidates[rows, pick][ok]
        near = alpha * alpha * between[rows, pick] <= dist
        dist = np.where(near, np.inf, dist)
        dist[rows, pick] = np.inf
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, batch: int = BATCH) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours of each unit row of x (-1: none; pruned ones, then random links) and where to start."""
    n = len(x)
    rng = np.random.default_rng(n)
    graph = np.full((n + 1, degree + LONG_LINKS), -1)  # the last row is that of no point
    graph[:n, degree:] = rng.integers(0, n, (n, LONG_LINKS))
    starts = np.unique(np.append(rng.integers(0, n, ENTRIES), np.argmax(x @ x.mean(axis=0))))
    for a in (1.0, alpha):
        order = rng.permutation(n)
        for lo in range(0, n, batch):
            points = order[lo : lo + batch]
            found, _ = beam_search(x, graph, starts, x[points], beam)
            graph[points, :degree] = robust_prune(x, points, np.concatenate([found, graph[points, :degree]], axis=1), a, degree)
            source = np.repeat(points, degree)
            target = graph[points, :degree].ravel()
            source, target = source[target >= 0], target[target >= 0]
            by = np.argsort(target, kind="stable")
            source, target = source[by], target[by]
            hit, first, count = np.unique(target, return_index=True, return_counts=True)
            back = np.full((len(hit), int(count.max(initial=0))), -1)
            back[np.repeat(np.arange(len(hit)), count), np.arange(len(target)) - np.repeat(first, count)] = source
            for part in range(0, len(hit), batch):
                h = hit[part : part + batch]
                graph[h, :degree] = robust_prune(x, h, np.concatenate([graph[h, :degree], back[part : part + batch, : 2 * beam]], axis=1), a, degree)
    return graph, starts


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component to 0.5 to 1."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])


def _packed(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys (two longs and the least id each) and scaled vectors of rows, in order of ids, as ties go by them."""
    rows = rows.sort_values(["least", "h1", "h2"], kind="stable")
    return rows[["h1", "h2", "least"]].to_numpy(np.int64), scaled(np.stack(rows["v"].to_numpy()).astype(np.float64))


def best_first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Per row the places of the k largest scores, the smaller id first among equal ones."""
    by_id = np.argsort(ids, axis=1, kind="stable")
    order = np.argsort(-np.take_along_axis(scores, by_id, 1), axis=1, kind="stable")[:, :k]
    return np.take_along_axis(by_id, order, 1)


def _writer(path: str, kind: str, with_graph: bool):
    """Writes a group's keys and vectors, and its graph, and names it by (dim, part, rows, starts)."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        part, dim = key
        keys, v = _packed(rows)
        name, n_starts = f"{path}/{kind}-{dim}-{part}", 0
        put_file(f"{name}.keys", keys.tobytes())
        put_file(f"{name}.vectors", v.tobytes())
        if with_graph:
            graph, starts = build_graph((v / np.sqrt((v * v).sum(axis=1))[:, None]).astype(np.float32))
            put_file(f"{name}.graph", graph.astype(np.int32).tobytes())
            put_file(f"{name}.starts", starts.astype(np.int64).tobytes())
            n_starts = len(starts)
        return pd.DataFrame({"dim": [dim], "part": [part], "size": [len(v)], "n_starts": [n_starts]})

    return run


PARTS = "dim int, part bigint, size bigint, n_starts bigint"


def _search(path: str, k: int, beam: int):
    def load(kind: str, dim: int, part: int, suffix: str, dtype) -> np.ndarray:
        return np.frombuffer(open_mapped(f"{path}/{kind}-{dim}-{part}.{suffix}"), dtype)

    def best_of(dim: int, block: int, shards: list[int]) -> pd.DataFrame:
        asked = load("block", dim, block, "keys", np.int64).reshape(-1, 3)
        q = load("block", dim, block, "vectors", np.float64).reshape(-1, dim)
        q_norm = np.sqrt((q * q).sum(axis=1))
        keys, scores = np.zeros((len(q), 0, 3), np.int64), np.zeros((len(q), 0))
        for shard in shards:
            own = load("shard", dim, shard, "keys", np.int64).reshape(-1, 3)
            p = load("shard", dim, shard, "vectors", np.float64).reshape(-1, dim)
            p_norm = np.sqrt((p * p).sum(axis=1))
            x = (p / p_norm[:, None]).astype(np.float32)
            graph = load("shard", dim, shard, "graph", np.int32).reshape(len(p) + 1, -1)
            starts = load("shard", dim, shard, "starts", np.int64)
            out_keys, out_scores = [], []
            for lo in range(0, len(q), BATCH):
                few = slice(lo, lo + BATCH)
                found, _ = beam_search(x, graph, starts, (q[few] / q_norm[few, None]).astype(np.float32), beam)
                score = np.einsum("qd,qnd->qn", q[few], p[found]) / (q_norm[few, None] * p_norm[found])
                out_scores.append(np.where(found >= 0, score, -np.inf))
                out_keys.append(own[found])
            keys = np.concatenate([keys, np.concatenate(out_keys)], axis=1)
            scores = np.concatenate([scores, np.concatenate(out_scores)], axis=1)
            best = best_first(scores, keys[:, :, 2], k)
            keys, scores = np.take_along_axis(keys, best[:, :, None], 1), np.take_along_axis(scores, best, 1)
        row, col = np.nonzero(np.isfinite(scores))
        return pd.DataFrame({"q1": asked[row, 0], "q2": asked[row, 1], "h1": keys[row, col, 0], "h2": keys[row, col, 1], "least": keys[row, col, 2], "score": scores[row, col]})

    def run(tasks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in tasks:
            for t in frame.itertuples():
                yield best_of(t.dim, t.block, sorted(t.shards))

    return run


def nearest(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row where ``is_query`` holds.

    ``is_query``: a condition on the column vec_id.
    """
    v = F.col("v")
    good = (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    clean = (
        vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"))
        .where(F.col("vec_id").isNotNull() & v.isNotNull())
        .where(good)
        .withColumn("v", F.transform("v", lambda c: c.cast("double") + 0.0))
        .withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(23), "v")})
    )
    first = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    members = stored(clean.groupBy("vec_id", "h1", "h2").agg(F.first("v").alias("v")).withColumn("nth", first).where(F.col("nth") <= k + 1), "ann-members")
    asked = stored(clean.where(is_query).select("vec_id", "h1", "h2", "v").dropDuplicates(["vec_id", "h1", "h2"]), "ann-asked")
    path = shared_path(vectors.sparkSession, "ann")
    deal = lambda of, size: F.pmod(F.xxhash64("h1", "h2", F.lit(3)), F.lit(max(1, math.ceil(of.count() / size)))).alias("part")
    # The least id of a class stands for it in ties; ids that are no integers tie by hash.
    least = (F.col("vec_id").cast("bigint") if isinstance(vectors.schema[id_col].dataType, IntegralType) else F.col("h1")).alias("least")
    points, wanted = members.where("nth = 1"), asked.dropDuplicates(["h1", "h2"])
    write = lambda of, size, kind, graph: stored(
        of.select("h1", "h2", least, "v", deal(of, size)).groupBy("part", F.size("v").alias("dim")).applyInPandas(_writer(path, kind, graph), PARTS), f"ann-{kind}"
    )
    shards, blocks = write(points, shard_rows, "shard", True), write(wanted, BLOCK_ROWS, "block", False)
    # One row a task: a list of files, not of vectors; both lists have a row for thousands of vectors.
    runs = shards.groupBy("dim", F.floor(F.col("part") / SHARDS_A_TASK).alias("run")).agg(F.collect_list("part").alias("shards"))
    tasks = runs.join(small(blocks.select("dim", F.col("part").alias("block"))), "dim")
    found = tasks.repartition("run", "block").select("dim", "block", "shards").mapInPandas(_search(path, k + 1, beam), "q1 bigint, q2 bigint, h1 bigint, h2 bigint, least bigint, score double")
    nth = F.row_number().over(Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "least", "h1", "h2"))
    # One class more than k, as the query's own may hold nothing else. By score and least id, the first classes hold the first answers.
    classes = found.withColumn("nth", nth).where(F.col("nth") <= k + 1).drop("nth", "least")
    asked = asked.select(F.col("vec_id").alias("query_id"), F.col("h1").alias("q1"), F.col("h2").alias("q2"))
    opened = asked.join(classes, ["q1", "q2"]).join(members.select("h1", "h2", "vec_id"), ["h1", "h2"]).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return opened.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {"op9_ann_search": op9_ann_search}
