"""Vectors: element-wise means, L1 norms, shifts, sinusoidal features, exact
k-nearest neighbours, k-NN KL divergence and Gram off-diagonals.

Pairwise work runs through ``quire.plans.pairs.block_cogroup``: bounded
block pairs reduced in numpy inside tasks, never a pair table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.plans.pairs import DEFAULT_BLOCK, GID, block_cogroup, group_sums, pair_index
from quire.session import cut_lineage


def mean_vector(df: DataFrame, by: Sequence[str], pos: str, x: str) -> DataFrame:
    """Element-wise mean per group from the long (pos, x) layout."""
    return df.groupBy(*by, pos).agg(F.avg(x).alias("mean"))


def mean_vector_array(df: DataFrame, by: Sequence[str], vec: str) -> DataFrame:
    """Element-wise mean per group straight from an array column."""
    e = df.select(*by, F.posexplode(vec).alias("pos", "_x"))
    return e.groupBy(*by, "pos").agg(F.avg("_x").alias("mean"))


def l1_mean(df: DataFrame, by: Sequence[str], component: str, x: str) -> DataFrame:
    """Mean |x| per component, summed over the components of each group."""
    per = df.groupBy(*by, component).agg(F.avg(F.abs(F.col(x))).alias("_m"))
    return per.groupBy(*by).agg(F.sum("_m").alias("l1"))


def shift(vec: Column, v: Column, beta: float) -> Column:
    """x + beta * v element-wise."""
    return F.zip_with(vec, v, lambda a, b: a + F.lit(beta) * b)


def shift_by_mean(df: DataFrame, vec: str, of: Column, beta: float) -> DataFrame:
    """``df`` with ``shifted`` = vector + beta · mean vector of the rows where
    ``of`` holds.  The mean is one row of the same plan (its size is that of a
    vector); nulls where no row holds."""
    e = df.where(of).select(F.posexplode(vec).alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mean = e.agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("m")).scalar()
    out = df.withColumn("_mean", mean)
    return out.withColumn("shifted", shift(F.transform(vec, lambda x: x.cast("double")), F.col("_mean"), beta)).drop("_mean")


def sinusoidal(x: Column, dim: int, scale: float = 1.0) -> Column:
    """[sin(x·s·f_i)..., cos(x·s·f_i)...] with f_i = exp(-ln(10000)·i/(dim/2 - 1))."""
    half = dim // 2
    k = math.log(10000.0) / (half - 1)
    freqs = F.array(*[F.lit(math.exp(-k * i)) for i in range(half)])
    xs = x * F.lit(scale)
    return F.concat(F.transform(freqs, lambda f: F.sin(xs * f)), F.transform(freqs, lambda f: F.cos(xs * f)))


def positional_encoding(x: Column, n_freqs: int) -> Column:
    """Power-of-two frequencies: [sin(x·2^i)..., cos(x·2^i)...]."""
    freqs = F.array(*[F.lit(float(2 ** i)) for i in range(n_freqs)])
    return F.concat(F.transform(freqs, lambda f: F.sin(x * f)), F.transform(freqs, lambda f: F.cos(x * f)))


# ---------------------------------------------------------------- k-NN


def _dist(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of all rows of ``a`` to all rows of ``b``."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        # direct differences (not the |a|²+|b|²-2ab shortcut) keep distances exact
        diff = a[:, j][:, None] - b[:, j][None, :]
        if metric == "chebyshev":
            np.maximum(out, np.abs(diff), out=out)
        elif metric == "euclidean":
            out += diff * diff
        else:
            raise ValueError(metric)
    return np.sqrt(out) if metric == "euclidean" else out


def _pair_dist(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of row-aligned pairs (a[k], b[k])."""
    if metric == "chebyshev":
        return np.max(np.abs(a - b), axis=1) if len(a) else np.zeros(0)
    if metric == "euclidean":
        diff = a - b
        np.multiply(diff, diff, out=diff)
        return np.sqrt(np.add.accumulate(diff, axis=1)[:, -1]) if a.shape[1] else np.zeros(len(a))  # added in their order
    raise ValueError(metric)


FIRST = 8  # components in which all pairs are compared before the rest of a pair is
NEAR_CELLS = 1 << 18  # pairs of two blocks that are compared at a time
NEAR_PAIRS = 1 << 15  # pairs whose distances are computed at a time


def _squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared Euclidean distances by a matrix product, and how far each row may be off."""
    aa, bb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    err = 1e-12 * (aa + bb.max(initial=0.0)) + 1e-300
    return np.maximum(aa[:, None] + bb[None, :] - 2 * (a @ b.T), 0.0), err


def _steps(rows: int, columns: int) -> range:
    return range(0, rows, max(1, NEAR_CELLS // max(1, columns)))


def _near(a: np.ndarray, b: np.ndarray, limit: np.ndarray, metric: str):
    """(rows of a, rows of b) of the pairs that a cheap bound leaves, some rows of
    ``a`` at a time: all with a distance of at most the row's limit, and others.

    Euclidean: a product of float32 matrices around the middle of ``b``, less what
    rounding can make of it.  Chebyshev: components as whole steps in one byte,
    compared until few pairs are left."""
    if not len(a) or not len(b):
        return
    steps, middle = _steps(len(a), len(b)), (b.min(axis=0) + b.max(axis=0)) / 2
    if metric == "euclidean":
        x, y = a - middle, b - middle
        xx, yy = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
        if max(xx.max(initial=0.0), yy.max(initial=0.0)) < 1e30:
            # d <= limit if and only if x.y - yy / 2 >= (xx - limit * limit) / 2
            off = (2 * a.shape[1] + 32) * 2.0 ** -24 * (xx + yy.max(initial=0.0)) + 1e-36
            least = np.nextafter(((xx - limit * limit * (1 + 1e-12) - off) / 2).astype(np.float32), np.float32(-np.inf))
            x, y = np.column_stack([x, np.ones(len(x))]).astype(np.float32), np.column_stack([y, yy / -2]).astype(np.float32).T
            for lo in steps:
                i, j = np.divmod(np.flatnonzero(x[lo:lo + steps.step] @ y >= least[lo:lo + steps.step, None]), len(b))
                yield i + lo, j
            return
    step = np.abs(b - middle).max(initial=0.0) / 127
    if metric == "chebyshev" and 1e-300 < step < 1e300 and np.isfinite(a).all():
        # a difference of limit is one of limit / step and 1 steps at most; cut off at 0 and 255 it is not more
        x, y = ((np.clip(np.floor((v - middle) / step), -128, 127) + 128).astype(np.uint8) for v in (a, b))
        far = np.minimum(np.floor(limit / step * (1 + 1e-9) + 1e-6) + 1, 128).astype(int)
        most = np.minimum(2 * far, 255).astype(np.uint8)  # from 128 steps on all pairs are near
        x -= far.astype(np.uint8)[:, None]  # y - x of a near pair is then 0 to 2 x far, modulo 256
        xt, yt = (np.ascontiguousarray(v.T) for v in (x, y))
        worst, one = (np.empty((steps.step, len(b)), np.uint8) for _ in range(2))
        for lo in steps:
            at = slice(lo, lo + steps.step)
            w, o = worst[:len(x[at])], one[:len(x[at])]
            w[:] = 0
            for c in range(0, a.shape[1], FIRST):
                for p in range(c, min(c + FIRST, a.shape[1])):
                    np.maximum(w, np.subtract(yt[p], xt[p, at, None], out=o), out=w)
                near = w <= most[at, None]
                if np.count_nonzero(near) * 32 <= near.size:
                    break
            i, j = np.divmod(np.flatnonzero(near), len(b))
            i += lo
            if c + FIRST < a.shape[1]:
                keep = (y[j, c + FIRST:] - x[i, c + FIRST:]).max(axis=1) <= most[i]
                i, j = i[keep], j[keep]
            yield i, j
        return
    for lo in steps:
        at = slice(lo, lo + steps.step)
        if metric == "euclidean":  # vectors far too long for float32, or infinite
            sq, err = _squares(a[at], b)
            i, j = np.nonzero(sq <= (limit[at] * limit[at] * (1 + 1e-12) + err)[:, None])
        else:
            i, j = np.nonzero(_dist(a[at, :FIRST], b[:, :FIRST], metric) <= limit[at, None])
        yield i + lo, j


def _parts_within(a: np.ndarray, b: np.ndarray, limit: np.ndarray, metric: str):
    """``_within``, some pairs at a time."""
    waiting, n = [], 0

    def measured():
        i, j = (np.concatenate(p) for p in zip(*waiting))
        for lo in range(0, len(i), NEAR_PAIRS):
            x, y = i[lo:lo + NEAR_PAIRS], j[lo:lo + NEAR_PAIRS]
            if metric == "chebyshev":
                for c in range(FIRST, a.shape[1], FIRST):
                    keep = np.abs(a[x, c:c + FIRST] - b[y, c:c + FIRST]).max(axis=1) <= limit[x]
                    x, y = x[keep], y[keep]
            d = _pair_dist(a[x], b[y], metric)
            keep = d <= limit[x]
            yield x[keep], y[keep], d[keep]

    for pairs in _near(a, b, limit, metric):
        waiting.append(pairs)
        n += len(pairs[0])
        if n >= NEAR_PAIRS:
            yield from measured()
            waiting, n = [], 0
    if n:
        yield from measured()


def _within(a: np.ndarray, b: np.ndarray, limit: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, distance) of the pairs with a distance of at most the
    row's limit; the distances are those of ``_pair_dist``, computed for pairs only
    that a cheaper bound leaves (see ``_near``)."""
    found = [*_parts_within(a, b, limit, metric)]
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(p) for p in zip(*found))


def knn(left: DataFrame, right: DataFrame, lid: str, rid: str, coords: Sequence[str], k: int,
        metric: str = "euclidean", exclude_self: bool = False, group: Sequence[str] = (),
        block_size: int = DEFAULT_BLOCK) -> DataFrame:
    """Exact k nearest right rows for every left row (ties by right id).

    Each block-pair task keeps the k best per left row; the merge keeps the
    k best of at most (right blocks × k) candidates per left row."""
    cols = list(coords)
    keys = list(group)

    def fn(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        if lp.empty or rp.empty:
            return pd.DataFrame({"_lid": [], "_rid": [], "dist": []})
        i, j = pair_index(lp, rp)
        li = lp[lid].to_numpy()[i]
        ri = rp[rid].to_numpy()[j]
        if exclude_self:
            keep = li != ri
            i, j, li, ri = i[keep], j[keep], li[keep], ri[keep]
        d = _pair_dist(lp[cols].to_numpy(float)[i], rp[cols].to_numpy(float)[j], metric)
        # k best per left row, ties by right id: sort by (left, distance, right id)
        order = np.lexsort((ri, d, i))
        i, d, li, ri = i[order], d[order], li[order], ri[order]
        rank = pd.Series(i).groupby(i).cumcount().to_numpy()
        keep = rank < k
        return pd.DataFrame({"_lid": li[keep], "_rid": ri[keep], "dist": d[keep]})

    lt = dict(left.dtypes)[lid]
    rt = dict(right.dtypes)[rid]
    cand = block_cogroup(left.select(*keys, lid, *cols), right.select(*keys, rid, *cols), keys, lid, rid, fn,
                         f"_lid {lt}, _rid {rt}, dist double", block_size)
    w = Window.partitionBy("_lid").orderBy("dist", "_rid")
    return (cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .withColumnRenamed("_lid", lid if lid != rid else "left_id")
            .withColumnRenamed("_rid", rid if lid != rid else "right_id"))


MOST_PIVOTS = 1024   # pivots that are handed to the tasks
PIVOT_BLOCK = 2048   # vectors of a packed block
HELD_BYTES = 32 << 20  # bytes of right vectors that a task holds


def _usable(df: DataFrame, id_col: str, vec: str, width: int, kind: str = "double") -> DataFrame:
    v = F.col(vec)
    good = (F.size(v) == width) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")))
    return df.where(F.col(id_col).isNotNull() & v.isNotNull() & good) \
        .select(F.col(id_col).alias("id"), F.transform(v, lambda x: x.cast(kind)).alias("v"))


class PivotBlocks:
    """Vectors in packed blocks around pivots.

    The pivots are rows with the smallest hashes, about half the root of the
    table and ``MOST_PIVOTS`` at most.  A vector belongs to its nearest pivot;
    pivots with more than ``PIVOT_BLOCK`` vectors are cut by a hash of the id.
    A block is one row: ids, vectors as bytes of their own type, radius around its pivot."""

    def __init__(self, base: DataFrame, metric: str):
        self.metric = metric
        self.kind = base.schema["v"].dataType.elementType.simpleString()
        self.dtype = np.dtype(np.float32 if self.kind == "float" else np.float64)
        base = base.persist(StorageLevel.DISK_ONLY)  # until it is packed
        count = base.count()
        n = min(MOST_PIVOTS, max(1, math.isqrt(count) // 2))
        rows = base.select("v").orderBy(F.xxhash64("v"), "v").limit(n).collect()  # bounded
        points = sorted({tuple(r["v"]) for r in rows})
        self.pivots = np.array(points, float).reshape(len(points), len(points[0]) if points else 0)
        self.shares = max(1, math.ceil(count * self.pivots.shape[1] * self.dtype.itemsize / HELD_BYTES))  # of the blocks, each held by a task
        self.tasks = max(int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")), 16)
        self.blocks = cut_lineage(self.pack(base)) if rows else None
        base.unpersist()

    def pack(self, vectors: DataFrame) -> DataFrame:
        """(pivot, part, ids, data, radius) of ``vectors`` (id, v)."""
        pivots, metric, kind, dtype = self.pivots, self.metric, self.kind, self.dtype
        id_type = vectors.schema["id"].dataType.simpleString()

        def assign(batches):
            for pdf in batches:
                if pdf.empty:
                    continue
                v = np.stack(pdf["v"].to_numpy()).astype(float)
                best = (_squares(v, pivots)[0] if metric == "euclidean" else _dist(v, pivots, metric)).argmin(axis=1)
                yield pd.DataFrame({"id": pdf["id"], "v": pdf["v"], "pivot": best.astype(np.int32), "away": _pair_dist(v, pivots[best], metric)})

        near = vectors.mapInPandas(assign, f"id {id_type}, v array<{kind}>, pivot int, away double")
        sizes = near.groupBy("pivot").agg(F.ceil(F.count("*") / PIVOT_BLOCK).alias("parts"))  # a row per pivot
        cut = near.join(F.broadcast(sizes), "pivot").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))

        def packed(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id", kind="stable")
            return pd.DataFrame({"pivot": pdf["pivot"].iloc[:1].to_numpy(), "part": pdf["part"].iloc[0], "ids": [pdf["id"].to_numpy()],
                                 "data": [np.stack(pdf["v"].to_numpy()).astype(dtype).tobytes()], "radius": pdf["away"].max()})

        cut = cut.repartition(max(self.shares, self.tasks), "pivot", "part")
        return cut.groupBy("pivot", "part").applyInPandas(packed, f"pivot int, part int, ids array<{id_type}>, data binary, radius double")


class _Best:
    """The k nearest vectors found so far of every vector of a left block, ties by id."""

    def __init__(self, key: tuple, ids: np.ndarray, vectors: np.ndarray, limit: np.ndarray, k: int, id_type: np.dtype):
        self.key, self.ids, self.vectors, self.limit, self.k = key, ids, vectors, limit.copy(), k
        self.count = np.zeros(len(ids), int)
        self.rids, self.dist = np.zeros((len(ids), k), id_type), np.full((len(ids), k), np.inf)

    def add(self, i: np.ndarray, rids: np.ndarray, dist: np.ndarray) -> None:
        """Take in right vectors of rows i; a full row's limit falls to its k-th distance."""
        if not len(i):
            return
        rows = np.unique(i)
        r, c = np.nonzero(np.arange(self.k) < self.count[rows, None])
        i, rids, dist = (np.concatenate(p) for p in ((i, rows[r]), (rids, self.rids[rows[r], c]), (dist, self.dist[rows[r], c])))
        order = np.lexsort((rids, dist, i))
        i, rids, dist = i[order], rids[order], dist[order]
        begins = np.searchsorted(i, rows)
        sizes = np.diff(np.append(begins, len(i)))
        rank = np.arange(len(i)) - np.repeat(begins, sizes)
        keep = rank < self.k
        self.rids[i[keep], rank[keep]], self.dist[i[keep], rank[keep]] = rids[keep], dist[keep]
        self.count[rows] = np.minimum(sizes, self.k)
        self.limit[rows] = np.where(sizes >= self.k, np.minimum(self.limit[rows], self.dist[rows, self.k - 1]), self.limit[rows])

    def rows(self) -> pd.DataFrame:
        r, c = np.nonzero(np.arange(self.k) < self.count[:, None])
        return pd.DataFrame({"left_id": self.ids[r], "right_id": self.rids[r, c], "dist": self.dist[r, c]})


def knn_vectors(left: DataFrame, right: DataFrame, lid: str, rid: str, vec: str, k: int, metric: str = "euclidean",
                exclude_self: bool = False, skipped: list | None = None) -> DataFrame:
    """(left_id, right_id, dist, rank): the exact k nearest right vectors of
    every left vector over all components (ties by right id).

    Right vectors are packed into ``PivotBlocks``, left ones into blocks around
    the same pivots.  One block near each left block gives an upper limit for
    the k-th distance of its rows; then a block pair is met only if the
    triangle inequality leaves room for a distance within the largest limit,
    a row only if it does for its own limit.  A task meets some left blocks, one
    after the other, with a share of the right ones (``HELD_BYTES``), both read
    from the shared folder and not shuffled; it returns the k best of each left
    row in its share, whose limit falls as they are found.  ``skipped`` (a list)
    receives (pairs met, all pairs).

    Rows with a null id or vector, a null or NaN component or another number
    of components than the first right vector take no part."""
    first = right.where(F.col(vec).isNotNull()).select(F.size(vec).alias("n")).first()
    width = first["n"] if first else 0
    lt, rt = (df.schema[c].dataType.simpleString() for df, c in ((left, lid), (right, rid)))
    schema = f"left_id {lt}, right_id {rt}, dist double"
    kind = "float" if all(df.schema[vec].dataType.simpleString() == "array<float>" for df in (left, right)) else "double"
    index = PivotBlocks(_usable(right, rid, vec, width, kind), metric)
    if index.blocks is None:
        return left.sparkSession.createDataFrame([], schema + ", rank int")
    pivots, dtype = index.pivots, index.dtype

    def matrix(data) -> np.ndarray:
        return np.frombuffer(data, dtype).reshape(-1, width).astype(float)

    reach = np.zeros(len(pivots))
    for r in index.blocks.groupBy("pivot").agg(F.max("radius").alias("r")).collect():  # a row per pivot
        reach[r["pivot"]] = r["r"]

    def upper(q, b, qids, bids):
        """The k-th distances, or a little more."""
        if len(b) < k:
            return np.full(len(q), np.inf)
        if metric == "euclidean":
            sq, err = _squares(q, b)
            d = np.sqrt(sq + err[:, None])
        else:
            d = _dist(q, b, metric)
        if exclude_self:
            d[np.asarray(qids)[:, None] == np.asarray(bids)[None, :]] = np.inf
        return np.partition(d, k - 1, axis=1)[:, k - 1]

    def limits(batches):
        for pdf in batches:
            within, near = [], []
            for r in pdf.itertuples(index=False):
                q, b, bids = matrix(r.qdata), matrix(r.data or b""), r.ids if r.data is not None else []
                steps = _steps(len(q), len(b))
                out = np.concatenate([upper(q[lo:lo + steps.step], b, r.qids[lo:lo + steps.step], bids) for lo in steps])
                least = _dist(pivots[r.pivot][None, :], pivots, metric)[0] - r.qradius - reach
                within.append(out.tobytes())
                near.append(least <= out.max() * (1 + 1e-9) + 1e-12)
            keep = pdf[["pivot", "qpart", "qids", "qdata"]].copy()
            keep["within"], keep["near"] = within, near
            yield keep

    query = {"part": "qpart", "ids": "qids", "data": "qdata", "radius": "qradius"}
    if lid == rid and left.sameSemantics(right):  # a block's own vectors give its limits
        asked = index.blocks.select("pivot", *[F.col(c).alias(q) for c, q in query.items()], "ids", "data")
    else:
        asked = index.pack(_usable(left, lid, vec, width, kind)).withColumnsRenamed(query) \
            .join(index.blocks.where("part = 0").select("pivot", "ids", "data"), "pivot", "left").repartition(index.tasks, "pivot", "qpart")
    bounded = cut_lineage(asked.mapInPandas(
        limits, f"pivot int, qpart int, qids array<{lt}>, qdata binary, within binary, near array<boolean>")).withColumnRenamed("pivot", "qpivot")
    # a product by partitions: its tasks read theirs where they were written
    shares = index.blocks.select("pivot", "ids", "data", "radius").coalesce(index.shares)
    met = bounded.hint("shuffle_replicate_nl").join(shares, F.get("near", F.col("pivot")))
    if skipped is not None:
        skipped.append((met.count(), bounded.count() * index.blocks.count()))

    def meet(batches):
        best = None
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                bids = np.asarray(r.ids)
                if best is None or best.key != (r.qpivot, r.qpart):
                    if best is not None:
                        yield best.rows()
                    best = _Best((r.qpivot, r.qpart), np.asarray(r.qids), matrix(r.qdata), np.frombuffer(r.within, float), k, bids.dtype)
                q = best.vectors
                away = _pair_dist(q, pivots[r.pivot][None, :], metric)
                rows = np.flatnonzero(away - r.radius <= best.limit * (1 + 1e-9) + 1e-12)
                if not len(rows):
                    continue
                for i, j, d in _parts_within(q[rows], matrix(r.data), best.limit[rows], metric):
                    i, rids = rows[i], bids[j]
                    if exclude_self:
                        other = best.ids[i] != rids
                        i, rids, d = i[other], rids[other], d[other]
                    best.add(i, rids, d)
        if best is not None:
            yield best.rows()

    found = met.select("qpivot", "qpart", "qids", "qdata", "within", "pivot", "ids", "data", "radius").mapInPandas(meet, schema)
    w = Window.partitionBy("left_id").orderBy("dist", "right_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def kth_distance(neigh: DataFrame, id_col: str, k: int) -> DataFrame:
    return neigh.where(F.col("rank") == k).select(id_col, F.col("dist").alias("kdist"))


def kl_estimate(rho: DataFrame, nu: DataFrame, n: Column, m: Column, d: int | Column, base: float) -> DataFrame:
    """KL divergence from k-th neighbour distances (id, kdist) inside the first
    sample (rho) and from it to the second (nu):
    (ln m - ln(n-1) + d·(mean ln nu - mean ln rho)) / ln(base)."""
    key = rho.columns[0]
    j = rho.withColumnRenamed("kdist", "rho").join(nu.withColumnRenamed("kdist", "nu"), key)
    const = F.log(m.cast("double")) - F.log((n - 1).cast("double"))
    width = F.lit(float(d)) if not isinstance(d, Column) else d
    return j.agg(((const + width * (F.avg(F.log("nu")) - F.avg(F.log("rho")))) / F.lit(math.log(base))).alias("kl"))


def kl_knn_vectors(p: DataFrame, q: DataFrame, pid: str, qid: str, vec: str, d: int, k: int = 5, metric: str = "chebyshev",
                   base: float = 2.0) -> DataFrame:
    """k-NN estimate of KL(p || q) over all ``d`` components (see ``kl_estimate``)."""
    rho = kth_distance(knn_vectors(p, p, pid, pid, vec, k, metric, exclude_self=True), "left_id", k)
    nu = kth_distance(knn_vectors(p, q, pid, qid, vec, k, metric), "left_id", k)
    return kl_estimate(rho, nu, p.agg(F.count("*")).scalar(), q.agg(F.count("*")).scalar(), d, base)


def kl_knn(p: DataFrame, q: DataFrame, pid: str, qid: str, coords: Sequence[str], k: int = 5,
           metric: str = "chebyshev", base: float = 2.0) -> DataFrame:
    """k-NN estimate of KL(p || q) for samples with few coordinate columns (see ``kl_estimate``)."""
    q2 = q.withColumnRenamed(qid, "_qid")
    rho = kth_distance(knn_self(p, pid, coords, k, metric), pid, k)
    nu = kth_distance(knn(p, q2, pid, "_qid", coords, k, metric), pid, k)
    return kl_estimate(rho, nu, p.agg(F.count("*")).scalar(), q.agg(F.count("*")).scalar(), len(coords), base)


def knn_self(points: DataFrame, pid: str, coords: Sequence[str], k: int, metric: str = "euclidean",
             group: Sequence[str] = ()) -> DataFrame:
    """k nearest other points of the same set (self excluded)."""
    other = points.select(*group, F.col(pid).alias("_other"), *coords)
    return knn(points, other, pid, "_other", coords, k, metric, exclude_self=True, group=group)


GRAM_ROWS = 1024  # left rows of a matrix product


def gram_offdiag(vecs: DataFrame, group: Sequence[str], vid: str, vec: str,
                 block_size: int = 8192) -> DataFrame:
    """Per group mean |<v_i, v_j>| over ordered pairs i != j.

    Inner products of a block pair are matrix products of ``GRAM_ROWS`` rows at
    a time; pairs of equal ids are taken out by id."""
    keys = list(group)

    def fn(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        if lp.empty or rp.empty:
            return pd.DataFrame({**{c: [] for c in keys}, "s": [], "n": []})
        sums, counts = np.zeros(len(lp)), np.zeros(len(lp), "int64")
        right = {g: (np.stack(r[vec].to_numpy()).astype(float), r[vid].to_numpy()) for g, r in rp.groupby(GID, sort=False)}
        at, ids = np.arange(len(lp)), lp[vid].to_numpy()
        for g, rows in pd.Series(at).groupby(lp[GID].to_numpy(), sort=False):
            if g not in right:
                continue
            b, bids = right[g]
            for lo in range(0, len(rows), GRAM_ROWS):
                mine = rows.to_numpy()[lo:lo + GRAM_ROWS]
                dots = np.abs(np.stack(lp[vec].to_numpy()[mine]).astype(float) @ b.T)
                same = ids[mine][:, None] == bids[None, :]
                sums[mine] = np.where(same, 0.0, dots).sum(axis=1)
                counts[mine] = len(bids) - same.sum(axis=1)
        return group_sums(lp, keys, {"s": sums, "n": counts})

    types = dict(vecs.dtypes)
    schema = ", ".join([f"{c} {types[c]}" for c in keys] + ["s double", "n long"])
    part = block_cogroup(vecs.select(*keys, vid, vec), vecs.select(*keys, vid, vec), keys, vid, vid, fn, schema,
                         block_size, pack_factor=1)
    return part.groupBy(*keys).agg((F.sum("s") / F.sum("n")).alias("gram_offdiag"))
