"""Approximate nearest neighbours by learned partitions.

1. *Fit* on at most ``SAMPLE`` vectors (the smallest hashes of id; a documented
   bound): neighbour graph of the sample by inner product, cut into equal
   parts by recursive bisection (the slowest direction of a random walk on the
   graph, halved at its median, then swaps across the cut while they save
   edges).  A small network (one hidden layer) learns, for a vector, how its
   neighbours spread over the parts.
2. *Index*: every vector goes to its most probable part.
3. *Route*: a query goes to its most probable parts; how many is measured on
   held-out sample vectors: the fewest that give ``TARGET`` recall there.
4. *Rerank*: inside a part all vectors are compared in double precision.  Parts
   are cut into blocks by hash of the id, so a part of any size (say a third of
   all rows being one vector) is many tasks, and queries go to all blocks of
   their parts.

Ties go to the smaller id; equal vectors have equal scores.  Defined cases:
vectors that are null, all zero, or hold null or non-finite components, and
rows with a null id, take no part; nor do vectors of another length than most.
Of rows with one id the smallest vector stays.  Fewer candidates than ``k``:
all of them.  No rows, or no queries: an empty result.  Extra columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.store import table

SAMPLE = 4096
PART_ROWS = 256      # rows a part aims at, within MOST_PARTS
MOST_PARTS = 64
BLOCK_ROWS = 8192
QUERY_ROWS = 1024
GRAPH = 10
TARGET = 0.97


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): the vectors that take part."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")) \
        .where(F.col("id").isNotNull() & v.isNotNull()) \
        .where(~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0))
    rows = table(rows.groupBy("id").agg(F.min("v").alias("v")), "ann-vectors")
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (size["n"] if size else 0))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest others of each row by inner product."""
    out = np.empty((len(x), min(k, len(x) - 1)), dtype=np.int64)
    for lo in range(0, len(x), 512):
        s = x[lo:lo + 512] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
        out[lo:lo + 512] = np.argpartition(-s, out.shape[1] - 1, axis=1)[:, :out.shape[1]]
    return out


def _bisect(a: np.ndarray, b: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Halve a graph (edge ends a, b) into equal parts: False / True per node."""
    degree = np.maximum(np.bincount(a, minlength=n) + np.bincount(b, minlength=n), 1).astype(float)
    f = rng.standard_normal(n)
    for _ in range(60):  # lazy random walk, the constant direction taken out
        f -= (f * degree).sum() / degree.sum()
        f = 0.5 * f + 0.5 * (np.bincount(a, f[b], n) + np.bincount(b, f[a], n)) / degree
        f /= np.linalg.norm(f) or 1.0
    side = np.zeros(n, dtype=bool)
    side[np.argsort(f, kind="stable")[n // 2:]] = True
    for _ in range(20):  # swap equal numbers across the cut while it saves edges
        cross = side[a] != side[b]
        gain = np.bincount(a, np.where(cross, 1, -1), n) + np.bincount(b, np.where(cross, 1, -1), n)
        left = np.flatnonzero(~side)[np.argsort(-gain[~side], kind="stable")]
        right = np.flatnonzero(side)[np.argsort(-gain[side], kind="stable")]
        m = min(len(left), len(right), max(1, n // 50))
        good = gain[left[:m]] + gain[right[:m]] > 2
        if not good.any():
            break
        moved = side.copy()
        moved[left[:m][good]], moved[right[:m][good]] = True, False
        if (moved[a] != moved[b]).sum() >= cross.sum():
            break
        side = moved
    return side


def balanced_parts(nbrs: np.ndarray, parts: int, seed: int = 5) -> np.ndarray:
    """Part of each node: equal sizes, few neighbour edges between parts."""
    n = len(nbrs)
    rng = np.random.default_rng(seed)
    a, b = np.repeat(np.arange(n), nbrs.shape[1]), nbrs.reshape(-1)
    part = np.zeros(n, dtype=np.int64)
    width = 1
    while width < parts:
        new = part * 2
        for p in range(width):
            at = np.flatnonzero(part == p)
            local = np.full(n, -1)
            local[at] = np.arange(len(at))
            inside = (local[a] >= 0) & (local[b] >= 0)
            new[at] += _bisect(local[a[inside]], local[b[inside]], len(at), rng)
        part, width = new, width * 2
    return part


class Router:
    """Small classifier: vector -> probabilities of the parts."""

    def __init__(self, dim: int, parts: int, hidden: int = 128, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.w = [rng.standard_normal((dim, hidden)) * np.sqrt(2 / dim), np.zeros(hidden),
                  rng.standard_normal((hidden, parts)) * np.sqrt(1 / hidden), np.zeros(parts)]
        self.scale = 1.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(x / self.scale @ self.w[0] + self.w[1], 0)
        return h @ self.w[2] + self.w[3]

    def train(self, x: np.ndarray, target: np.ndarray, steps: int = 400, rate: float = 0.01, seed: int = 7) -> Router:
        self.scale = max(float(np.sqrt((x * x).mean())), 1e-30)
        x = x / self.scale
        rng = np.random.default_rng(seed)
        m, v = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        for t in range(1, steps + 1):
            at = rng.integers(0, len(x), min(512, len(x)))
            xb, yb = x[at], target[at]
            h = np.maximum(xb @ self.w[0] + self.w[1], 0)
            z = h @ self.w[2] + self.w[3]
            p = np.exp(z - z.max(1, keepdims=True))
            d = (p / p.sum(1, keepdims=True) - yb) / len(at)
            dh = (d @ self.w[2].T) * (h > 0)
            for i, g in enumerate((xb.T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                self.w[i] -= rate * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(v[i] / (1 - 0.999 ** t)) + 1e-8)
        return self


def fit(x: np.ndarray, parts: int, k: int, target: float = TARGET) -> tuple[Router, int]:
    """(router, parts to probe) from sample vectors ``x``."""
    router = Router(x.shape[1], parts)
    if parts == 1:
        return router, 1
    nbrs = neighbour_graph(x, GRAPH)
    part = balanced_parts(nbrs, parts)
    # what is to be learned: where a vector's neighbours (and itself) lie
    soft = np.zeros((len(x), parts))
    np.add.at(soft, (np.repeat(np.arange(len(x)), nbrs.shape[1]), part[nbrs.reshape(-1)]), 1.0)
    soft[np.arange(len(x)), part] += 1.0
    router.train(x, soft / soft.sum(1, keepdims=True))
    home = router.scores(x).argmax(1)
    ask = np.arange(0, len(x), max(1, len(x) // 512))
    order = np.argsort(-router.scores(x[ask]), axis=1)
    rank = np.empty_like(order)
    rank[np.arange(len(ask))[:, None], order] = np.arange(parts)
    near = neighbour_graph(x, k)[ask]
    need = rank[np.arange(len(ask))[:, None], home[near]]
    recall = [(need < m).mean() for m in range(1, parts + 1)]
    return router, next((m for m, r in enumerate(recall, 1) if r >= target), parts)


def _best(q: np.ndarray, x: np.ndarray, qid: np.ndarray, xid: np.ndarray, k: int):
    """The k best of x for each query: (query, id, score), ties to smaller ids."""
    out = []
    for lo in range(0, len(q), 256):
        s = q[lo:lo + 256] @ x.T
        s[qid[lo:lo + 256, None] == xid[None, :]] = -np.inf
        for r in range(len(s)):
            row = s[r]
            if len(row) > k:  # rounding of the product must not part equal vectors
                edge = np.partition(row, len(row) - k)[len(row) - k]
                pick = np.flatnonzero(row >= edge - 1e-9 * max(1.0, abs(edge)) if np.isfinite(edge) else np.isfinite(row))
            else:
                pick = np.flatnonzero(np.isfinite(row))
            exact = (x[pick] * q[lo + r]).sum(axis=1)
            best = np.lexsort((xid[pick], -exact))[:k]
            out.append((np.full(len(best), qid[lo + r]), xid[pick[best]], exact[best]))
    cols = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 2 + [np.empty(0)]
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), cols)))


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
           sample: int = SAMPLE, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query.

    ``is_query`` is a condition over the column ``id``.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    total = rows.count()
    taken = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()  # at most ``sample`` rows
    parts = 1
    while parts * 2 * PART_ROWS <= total and parts * 2 <= MOST_PARTS and parts * 2 * 16 <= len(taken):
        parts *= 2
    if len(taken):
        router, probes = fit(np.stack(taken["v"].to_numpy()), parts, k, target)
    else:
        router, probes = Router(1, 1), 1
    held = spark.sparkContext.broadcast(router)

    def route(batches):
        for pdf in batches:
            if len(pdf):
                order = np.argsort(-held.value.scores(np.stack(pdf["v"].to_numpy())), axis=1, kind="stable")
                yield pdf.assign(parts=list(order[:, :probes].astype(np.int32)))

    placed = table(rows.mapInPandas(route, "id long, v array<double>, parts array<int>"), "ann-parts")
    base = placed.select("id", "v", F.col("parts")[0].alias("part"))
    counts = base.groupBy("part").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    sizes = {r["part"]: r["blocks"] for r in counts.collect()}  # at most MOST_PARTS rows
    blocks = F.create_map(*[F.lit(int(x)) for kv in (sizes or {0: 1}).items() for x in kv])
    base = base.withColumn("block", F.pmod(F.xxhash64("id"), blocks[F.col("part")]).cast("int"))
    queries = placed.where(is_query).select("id", "v", F.explode("parts").alias("part"))
    many = max(1, -(-placed.where(is_query).count() // QUERY_ROWS))
    queries = queries.where(blocks[F.col("part")].isNotNull()) \
        .withColumn("block", F.explode(F.sequence(F.lit(0), blocks[F.col("part")] - 1))) \
        .withColumn("qblock", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(many)).cast("int"))
    spread = base.withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))

    def rerank(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return _best(np.stack(q["v"].to_numpy()), np.stack(x["v"].to_numpy()), q["id"].to_numpy(np.int64),
                     x["id"].to_numpy(np.int64), k)

    by = ["part", "block", "qblock"]
    found = queries.groupBy(*by).cogroup(spread.groupBy(*by)) \
        .applyInPandas(rerank, "query_id long, vec_id long, score double")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
