"""Ordered series: crossings, best-so-far, phase changes, smoothing, running
means, cumulative products, transmittance, future-window labels, gaps, EMA,
top-k softmax, peaks, block means, modular operation tables, noise schedules.

Per-key order statistics use the bucketed helpers of ``quire.plans.ordering``
(``positions``, ``running``, ``neighbour``) so that a key holding a large share
of the rows is spread over many tasks instead of one window partition.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.plans.ordering import global_row_number, neighbour, positions, running, running_totals

# ---------------------------------------------------------------- crossings


def first_crossing_agg(step: str, cond: Column, default: int | Column) -> Column:
    """Aggregate: first ``step`` where ``cond`` holds, else ``default``."""
    d = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.min(F.when(cond, F.col(step))), d)


def first_crossing(df: DataFrame, key: Sequence[str], step: str, value: str, thr: float,
                   default: Column | int | None = None) -> DataFrame:
    """First step with value > thr per key; default = number of steps of the key."""
    d = F.count("*") if default is None else (default if isinstance(default, Column) else F.lit(default))
    return df.groupBy(*key).agg(first_crossing_agg(step, F.col(value) > thr, d).alias("first_step"))


def best_so_far(df: DataFrame, key: Sequence[str], order: str, value: str, mode: str = "min",
                start: float | None = None) -> DataFrame:
    """Best value strictly before each row (start value when none) and a
    strict-improvement flag (``<`` for losses, ``>`` for accuracies)."""
    if start is None:
        start = 1e9 if mode == "min" else 0.0
    r = running(df, [order], {"_prev": (F.col(value), mode)}, inclusive=False, partition_by=list(key))
    prev = F.coalesce(F.col("_prev"), F.lit(float(start)))
    better = F.col(value) < prev if mode == "min" else F.col(value) > prev
    best = F.least(prev, F.col(value)) if mode == "min" else F.greatest(prev, F.col(value))
    return (r.withColumn("best_before", prev).withColumn("improved", better).withColumn("best", best)
            .drop("_prev"))


def phase_changes(df: DataFrame, key: Sequence[str], order: str, phase: str, default: str = "full1") -> DataFrame:
    """Rows whose phase (missing -> ``default``) differs from the previous row's."""
    s = neighbour(df.withColumn("_ph", F.coalesce(F.col(phase), F.lit(default))), key, [order], ["_ph"])
    return s.where(F.col("prev__ph").isNotNull() & (F.col("prev__ph") != F.col("_ph"))).drop("_ph", "prev__ph")


# ---------------------------------------------------------------- smoothing

# The named numpy windows (symmetric, length m).
def kernel(name: str, m: int) -> list[float]:
    if m == 1:
        return [1.0]
    n = np.arange(m)
    if name == "flat":
        w = np.ones(m)
    elif name == "hanning":
        w = 0.5 - 0.5 * np.cos(2 * np.pi * n / (m - 1))
    elif name == "hamming":
        w = 0.54 - 0.46 * np.cos(2 * np.pi * n / (m - 1))
    elif name == "bartlett":
        w = 1 - np.abs(2 * n / (m - 1) - 1)
    elif name == "blackman":
        w = 0.42 - 0.5 * np.cos(2 * np.pi * n / (m - 1)) + 0.08 * np.cos(4 * np.pi * n / (m - 1))
    else:
        raise ValueError(f"unknown window {name}")
    return [float(x) for x in w / w.sum()]


def smooth(df: DataFrame, key: Sequence[str], order: str, value: str, w: int = 10,
           kernel_name: str = "hanning") -> DataFrame:
    """Kernel smoothing with reflected ends; output length n + w - 1 per key.

    Every input row is emitted once per reflected copy and once per kernel tap
    (at most 3·w rows, independent of the series length), then summed by
    output index: no window, no self-join, no whole-series group.
    """
    kern = kernel(kernel_name, w)
    keys = list(key)
    pos = positions(df, keys, [order], "_i")
    n = pos.groupBy(*keys).agg(F.count("*").alias("_n"))
    p = pos.join(n, keys)
    i, nn = F.col("_i"), F.col("_n")
    L = F.least(F.lit(w - 1), nn - 1)
    R = F.least(F.lit(w - 1), nn - 1)
    t_mid = i + L
    t_left = F.when((i >= 1) & (i <= L), L - i)
    t_right = F.when((i >= nn - 1 - R) & (i <= nn - 2), L + nn + (nn - 2 - i))
    ts = F.filter(F.array(t_mid, t_left, t_right), lambda x: x.isNotNull())
    taps = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(kern[j]).alias("kw")) for j in range(w)])
    e = p.select(*keys, F.col(value).alias("_v"), L.alias("_L"), R.alias("_R"), nn.alias("_n"),
                 F.explode(ts).alias("_t")).select("*", F.inline(taps))
    k = F.col("_t") - (w - 1) + F.col("j")
    last = F.col("_L") + F.col("_n") + F.col("_R") - w
    contrib = e.where((k >= 0) & (k <= last)).select(*keys, k.alias("k"), (F.col("kw") * F.col("_v")).alias("_c"))
    return contrib.groupBy(*keys, "k").agg(F.sum("_c").alias("smoothed"))


# ------------------------------------------------------------ running means


def running_mean(df: DataFrame, key: Sequence[str], order: str, loss: str, n: str, correct: str,
                 every: int = 1) -> DataFrame:
    """Running mean loss (over batches so far) and running percent accuracy
    inside each key (epoch), logged for batch indices divisible by ``every``."""
    keys = list(key)
    one = F.lit(1).cast("long")
    r = running_totals(df, [order], {"_i": one, "_l": F.col(loss), "_c": F.col(correct), "_t": F.col(n)}, partition_by=keys)
    r = r.withColumn("batch_idx", F.col("_i") - 1)
    return (r.where(F.pmod(F.col("batch_idx"), F.lit(every)) == 0)
            .select(*keys, "batch_idx", (F.col("_l") / (F.col("batch_idx") + 1)).alias("loss"),
                    (100.0 * F.col("_c") / F.col("_t")).alias("acc")))


# ------------------------------------------------------ cumulative products


def cumulative_product(df: DataFrame, key: Sequence[str], order: str, x: str, shift: bool = False,
                       name: str = "cumprod") -> DataFrame:
    """Inclusive (or shifted, leading 1) cumulative product per key via sums of
    logs of |x|, a running count of negatives and of zeros."""
    xc = F.col(x)
    r = running_totals(
        df, [order],
        {"_ln": F.when(xc != 0, F.log(F.abs(xc))).otherwise(F.lit(0.0)),
         "_neg": (xc < 0).cast("long"), "_zero": (xc == 0).cast("long")},
        inclusive=not shift, partition_by=list(key))
    sign = F.when(F.pmod(F.col("_neg"), F.lit(2)) == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    val = F.when(F.col("_zero") > 0, F.lit(0.0)).otherwise(sign * F.exp(F.col("_ln")))
    return r.withColumn(name, val).drop("_ln", "_neg", "_zero")


def composite(samples: DataFrame, ray: str, order: str, sigma: str, dist: str, values: Sequence[str],
              white_bg: bool = False) -> DataFrame:
    """Volume compositing: alpha = 1 - exp(-sigma*dist); T = exclusive product
    of (1 - alpha + 1e-10); weight = alpha*T; per ray the weight sum and the
    weighted value sums (+ background), clamped to [0, 1]."""
    a = samples.withColumn("_alpha", 1 - F.exp(-F.col(sigma) * F.col(dist)))
    a = a.withColumn("_keep", 1 - F.col("_alpha") + F.lit(1e-10))
    t = cumulative_product(a, [ray], order, "_keep", shift=True, name="_T")
    wgt = F.col("_alpha") * F.col("_T")
    agg = t.groupBy(ray).agg(F.sum(wgt).alias("acc_map"), *[F.sum(wgt * F.col(v)).alias(v) for v in values])
    out = agg
    for v in values:
        col = F.col(v) + (1 - F.col("acc_map")) if white_bg else F.col(v)
        out = out.withColumn(v, F.least(F.greatest(col, F.lit(0.0)), F.lit(1.0)))
    return out


# ------------------------------------------------------- future-window label


def future_label(df: DataFrame, key: str, day: str, value: str, thr: float, lo: int = 10,
                 hi: int = 50) -> DataFrame:
    """label(t) = 1 iff some value > thr on days [t+lo, t+hi) of the key.

    Each exceeding row marks the (hi-lo) days it labels; distinct marks are
    left-joined back.  Rows are kept for t < T - hi (T = number of days,
    counted from the first day 0), as the reference shortens the series."""
    hits = (df.where(F.col(value) > thr)
            .select(key, F.explode(F.sequence(F.col(day) - (hi - 1), F.col(day) - lo)).alias(day))
            .distinct().withColumn("label", F.lit(1)))
    total_days = df.agg(F.max(day)).scalar() + 1
    base = df.where(F.col(day) < total_days - hi).select(key, day)
    return base.join(hits, [key, day], "left").withColumn("label", F.coalesce("label", F.lit(0)))


# ---------------------------------------------------------------------- gaps


def gaps(df: DataFrame, key: Sequence[str], order: str, x: str, pad: float = 1e10, scale: Column | float = 1.0
         ) -> DataFrame:
    """Adjacent difference next(x) - x, the last element padded, times ``scale``."""
    s = neighbour(df, key, [order], [x], ahead=True, prefix="next_")
    sc = scale if isinstance(scale, Column) else F.lit(scale)
    d = F.coalesce(F.col("next_" + x) - F.col(x), F.lit(pad)) * sc
    return s.withColumn("gap", d).drop("next_" + x)


# ------------------------------------------------------------------------ EMA

EMA_BLOCK = 1 << 16  # rows of a key that are scanned together


def ema_gain(step: Column, beta: float, after: int, every: int, gamma: float, power: float, least: float) -> Column:
    """How far the average moves to the value at each step (0-based): not at
    all between updates, all the way up to ``after`` and at the first update
    beyond it, then 1 - decay with decay = 1 - (1 + n / gamma) ** -power,
    n = step - after, kept within [least, beta]."""
    past = F.greatest(step - after, F.lit(0))
    decay = 1.0 - F.pow(1.0 + past / F.lit(float(gamma)), F.lit(-float(power)))
    move = 1.0 - F.least(F.greatest(decay, F.lit(float(least))), F.lit(float(beta)))
    whole = (step <= after) | (step < (after // every + 1) * every + 1)
    return F.when(step == 0, 1.0).when(F.pmod(step, F.lit(every)) != 0, 0.0).when(whole, 1.0).otherwise(move)


def affine_scan(a: np.ndarray, b: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running compositions of the maps v -> a·v + b, each run starting where
    ``place`` (0, 1, 2, ... in a run) is 0: the map from the run's start to
    each row.  Doubles the reach of every row in each pass over the arrays."""
    a, b, reach = a.copy(), b.copy(), 1
    most = int(place.max(initial=0))
    while reach <= most:
        far = np.flatnonzero(place >= reach)
        a_far, b_far = a[far], b[far]
        b[far], a[far] = a_far * b[far - reach] + b_far, a_far * a[far - reach]
        reach *= 2
    return a, b


def _scan_blocks(rows: DataFrame, keys: list[str], order: str, a: str, b: str) -> DataFrame:
    """``rows`` with (a, b) replaced by the map from the start of the row's
    ``keys`` group; a group is a task's sorted run of rows, of any length."""

    def run(batches):
        last, held = None, (1.0, 0.0)
        for pdf in batches:
            if not len(pdf):
                continue
            cols = [pdf[k].to_numpy() for k in keys]
            fresh = np.zeros(len(pdf), bool)
            for c in cols:
                fresh[1:] |= (c[1:] != c[:-1]) & ~(pd.isna(c[1:]) & pd.isna(c[:-1]))
            now = tuple(c[0] for c in cols)
            goes_on = last is not None and all(x == y or (pd.isna(x) and pd.isna(y)) for x, y in zip(now, last))
            fresh[0] = True
            at = np.arange(len(pdf))
            place = at - np.maximum.accumulate(np.where(fresh, at, 0))
            pa, pb = affine_scan(pdf[a].to_numpy(float), pdf[b].to_numpy(float), place)
            if goes_on:  # the run began in the batch before
                n = int(np.flatnonzero(fresh)[1]) if fresh[1:].any() else len(pdf)
                pb[:n] += pa[:n] * held[1]
                pa[:n] *= held[0]
            last, held = tuple(c[-1] for c in cols), (pa[-1], pb[-1])
            yield pdf.assign(**{a: pa, b: pb})

    return rows.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(run, rows.schema)


def ema(df: DataFrame, key: str, order: str, value: str, beta: float = 0.9999, update_after: int = 100,
        update_every: int = 10, inv_gamma: float = 1.0, power: float = 2 / 3, min_value: float = 0.0) -> DataFrame:
    """EMA of a series with a warm-up schedule (see ``ema_gain``); the average
    starts at the first value of the key.

    An update is a map e -> (1 - g)·e + g·x, and maps compose, so a series is a
    two-level scan: blocks of ``EMA_BLOCK`` rows are scanned by themselves (a
    hot key is as many tasks as it has blocks), the maps of whole blocks are
    scanned per key (a row per block), and the average at the start of each
    block is put into the block's maps.  Rows of a null value keep the average."""
    pos = positions(df.select(key, order, value), [key], [order], "step")
    gain = F.when(F.col(value).isNull(), F.lit(0.0)).otherwise(
        ema_gain(F.col("step"), beta, update_after, update_every, inv_gamma, power, min_value))
    maps = pos.withColumn("_g", gain).select(
        key, "step", value, F.call_function("div", F.col("step"), F.lit(EMA_BLOCK)).alias("_block"),
        F.when(F.col("step") == 0, F.lit(0.0)).otherwise(1.0 - F.col("_g")).alias("_a"),
        F.coalesce(F.col("_g") * F.col(value), F.lit(0.0)).cast("double").alias("_b"))
    local = _scan_blocks(maps, [key, "_block"], "step", "_a", "_b")
    # maps of whole blocks: only keys that go on after one have any
    long = pos.where(F.col("step") == EMA_BLOCK).select(F.struct(key).alias("_k"))
    more = maps.withColumn("_k", F.struct(key)).join(long, "_k", "left_semi").drop("_k")
    ends = F.pmod("step", F.lit(EMA_BLOCK)) == EMA_BLOCK - 1
    whole = _scan_blocks(more, [key, "_block"], "step", "_a", "_b").where(ends).select(key, "_block", "_a", "_b")
    start = _scan_blocks(whole, [key], "_block", "_a", "_b").select(
        F.struct(key).alias("_k"), (F.col("_block") + 1).alias("_next"), F.col("_b").alias("_start"))  # the first map has a = 0
    out = local.join(start, (F.struct(key) == F.col("_k")) & (F.col("_block") == F.col("_next")), "left")
    e = F.col("_b") + F.when(F.col("_block") > 0, F.col("_a") * F.col("_start")).otherwise(0.0)
    return out.select(key, "step", value, e.alias("ema"))


# ------------------------------------------------------------- top-k softmax


def topk_softmax(df: DataFrame, key: str, cls: str, score: str, k: int, temperature: float = 1.0) -> DataFrame:
    """Scores / temperature, values below the k-th largest removed (ties kept),
    softmax over the rest.  One group = one distribution over classes."""
    s = F.col(score) / temperature
    w = Window.partitionBy(key).orderBy(F.desc(score))
    kept = df.withColumn("_s", s).withColumn("_r", F.rank().over(w)).where(F.col("_r") <= k)
    agg = kept.groupBy(key).agg(F.max("_s").alias("_m"))
    z = kept.join(agg, key).withColumn("_e", F.exp(F.col("_s") - F.col("_m")))
    tot = z.groupBy(key).agg(F.sum("_e").alias("_z"))
    return z.join(tot, key).select(key, cls, (F.col("_e") / F.col("_z")).alias("prob"))


# ---------------------------------------------------------------- summaries


def peak(df: DataFrame, key: Sequence[str], order: str, value: str) -> DataFrame:
    """Step of the maximum (first on ties), the maximum, and the last value."""
    return df.groupBy(*key).agg(
        F.min_by(F.col(order), F.struct(-F.col(value), F.col(order))).alias("peak_step"),
        F.max(value).alias("peak"),
        F.max_by(F.col(value), F.col(order)).alias("last_value"))


def block_mean(df: DataFrame, key: Sequence[str], step: str, value: str, k: int) -> DataFrame:
    """Mean since the last report every k steps: step 0 is its own block,
    then blocks of steps (1..k), (k+1..2k), ..."""
    blk = F.when(F.col(step) == 0, F.lit(-1)).otherwise(F.floor((F.col(step) - 1) / k))
    return df.groupBy(*key, blk.alias("block")).agg(F.avg(value).alias("mean"), F.max(step).alias("last_step"))


# ------------------------------------------------------ modular arithmetic


def mod_add(a: Column, b: Column, p: int) -> Column:
    return F.pmod(a + b, F.lit(p))


def mod_sub(a: Column, b: Column, p: int) -> Column:
    return F.pmod(a - b, F.lit(p))


def mod_pow(b: Column, e: int, p: int) -> Column:
    """b**e mod p by square-and-multiply over the bits of e (exact longs)."""
    result = F.lit(1).cast("long")
    base = F.pmod(b.cast("long"), F.lit(p))
    while e > 0:
        if e & 1:
            result = F.pmod(result * base, F.lit(p))
        base = F.pmod(base * base, F.lit(p))
        e >>= 1
    return result


def mod_div(a: Column, b: Column, p: int) -> Column:
    """a * b^(p-2) mod p (p prime, b != 0)."""
    return F.pmod(a.cast("long") * mod_pow(b, p - 2, p), F.lit(p))


LISTED = 6  # permutations of so many and fewer are listed


def compose(a: Column, b: Column) -> Column:
    """Permutation composition: result[i] = a[b[i]] (0-based entries)."""
    return F.transform(b, lambda i: F.element_at(a, (i + 1).cast("int")))


def unrank(rank: Column, k: int) -> Column:
    """Permutation of 0..k-1 with lexicographic number ``rank`` (0-based).

    The factorial digits of the rank (Lehmer code) say which of the values
    still left comes next.  Up to ``LISTED`` a rank looks its permutation up in
    the list of all k!."""
    if k <= LISTED:
        every = F.lit([list(p) for p in itertools.permutations(range(k))])  # in lexicographic order
        at = F.pmod(rank, F.lit(math.factorial(k))).cast("int")
        return F.when(rank >= 0, F.get(every, at)).otherwise(_unrank_by_digits(rank, k))
    return _unrank_by_digits(rank, k)


def _unrank_by_digits(rank: Column, k: int) -> Column:
    digits = F.array(*[F.pmod(F.call_function("div", rank, F.lit(math.factorial(k - 1 - i))), F.lit(k - i)).cast("int")
                       for i in range(k)])
    empty = F.array().cast("array<int>")
    start = F.struct(F.sequence(F.lit(0), F.lit(k - 1)).alias("left"), empty.alias("out"))

    def step(state, d):
        picked = F.element_at(state["left"], d + 1)
        return F.struct(F.filter(state["left"], lambda x: x != picked).alias("left"),
                        F.array_append(state["out"], picked).alias("out"))

    return F.aggregate(digits, start, step, lambda s: s["out"])


def rank_of(perm: Column, k: int) -> Column:
    """Lexicographic number of a permutation of 0..k-1: at each place the
    smaller values that come later, weighted by factorials."""
    x = [F.get(perm, F.lit(i)) for i in range(k)]
    later = [F.coalesce((x[j] < x[i]).cast("long"), F.lit(0)) * math.factorial(k - 1 - i) for i in range(k) for j in range(i + 1, k)]
    if 1 < k <= LISTED:
        return F.when(F.size(perm) == k, sum(later[1:], later[0])).otherwise(_rank_by_parts(perm, k))
    return _rank_by_parts(perm, k)


def _rank_by_parts(perm: Column, k: int) -> Column:
    weights = F.array(*[F.lit(math.factorial(k - 1 - i)).cast("long") for i in range(k)])
    smaller = F.transform(perm, lambda x, i: F.size(F.filter(F.slice(perm, i + 1, F.lit(k)), lambda y: y < x)).cast("long"))
    return F.aggregate(F.zip_with(smaller, weights, lambda n, w: n * w), F.lit(0).cast("long"), lambda acc, x: acc + x)


# operation name -> result of (a, b) modulo a prime p; division has no result for b = 0
MODULAR = {"add": mod_add, "sub": mod_sub, "div": mod_div}


def operation_table(elements: DataFrame, col: str, p: int, op: str = "add") -> DataFrame:
    """All pairs (a, b) of the element set with b in [0, p) generated per row
    (no join), result by the modular operation; division skips b = 0."""
    t = elements.select(F.col(col).alias("a"), F.explode(F.sequence(F.lit(0), F.lit(p - 1))).alias("b"))
    a, b = F.col("a"), F.col("b")
    return (t.where(b != 0) if op == "div" else t).withColumn("c", MODULAR[op](a, b, p))


def pair_from_index(idx: Column, n: Column | int) -> tuple[Column, Column]:
    """Places (in the first set, in the second set of n elements) of pair ``idx``."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.call_function("div", idx, n), F.pmod(idx, n)


def ordered_set(df: DataFrame, col: str, name: str = "element") -> DataFrame:
    """(place, element): the distinct values of a column in ascending order, from 0."""
    distinct = df.select(F.col(col).alias(name)).where(F.col(name).isNotNull()).distinct()
    return global_row_number(distinct, [name], name="_rn").select((F.col("_rn") - 1).alias("place"), name)


def pair_table(first: DataFrame, second: DataFrame, op, allowed=None) -> DataFrame:
    """(idx, a, b, c) of all pairs of two ``ordered_set`` tables, the second
    one fastest; ``op(a, b)`` is any Column expression, and the second set is
    cut by ``allowed`` (a predicate on the element) beforehand.

    Every element of the first set counts out the places of the second, which
    are then looked up by an equi-join on the place: the rows made are the
    table itself."""
    if allowed is not None:
        kept = second.where(allowed(F.col("element")))
        second = ordered_set(kept, "element")
    n = second.agg(F.count("*")).scalar()  # lazy scalar subquery
    places = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1))
    left = first.select(F.col("place").alias("i"), F.col("element").alias("a"), F.explode(places).alias("j"))
    right = second.select(F.col("place").alias("j"), F.col("element").alias("b"))
    return left.join(right, "j").select((F.col("i") * n + F.col("j")).alias("idx"), "a", "b", op(F.col("a"), F.col("b")).alias("c"))


def permutation_example(idx: Column, k: int) -> tuple[Column, Column, Column]:
    """(a, b, composition) of the pair ``idx`` in the table of all
    permutations of k by themselves: places by division, elements by unranking."""
    i, j = pair_from_index(idx, math.factorial(k))
    a, b = unrank(i, k), unrank(j, k)
    return a, b, F.array(*[F.get(a, F.get(b, F.lit(n))) for n in range(k)])  # compose(a, b), its length being known


# --------------------------------------------------------- noise schedules


# power of the value that grows evenly from start to end, per kind
SCHEDULE_POWER = {"linear": 1, "quadratic": 2}


def noise_schedule(spark, n: int, kind: str = "linear", beta_start: float = 0.0001,
                   beta_end: float = 0.02) -> DataFrame:
    """Per timestep: beta, alpha, alphas_cumprod (and shifted), sqrt factors.
    ``n`` rows: a bounded table (one row per timestep)."""
    power = SCHEDULE_POWER[kind]
    low, high = beta_start ** (1 / power), beta_end ** (1 / power)
    t = spark.range(n).select(F.col("id").cast("int").alias("t"))
    even = F.lit(low) + (high - low) * F.col("t") / max(n - 1, 1)
    beta = even if power == 1 else F.pow(even, power)
    s = t.select("t", beta.alias("beta"), (1 - beta).alias("alpha"), F.lit(0).alias("_g"))
    s = cumulative_product(s, ["_g"], "t", "alpha", name="alphas_cumprod")
    s = cumulative_product(s, ["_g"], "t", "alpha", shift=True, name="alphas_cumprod_prev")
    return s.select("t", "beta", "alpha", "alphas_cumprod", "alphas_cumprod_prev",
                    F.sqrt("alphas_cumprod").alias("sqrt_ac"), F.sqrt(1 - F.col("alphas_cumprod")).alias("sqrt_1m_ac"))


def mix(df: DataFrame, schedule: DataFrame, t: str, x: str, eps: str) -> DataFrame:
    """Forward noising sqrt(ac_t)·x + sqrt(1-ac_t)·eps (schedule broadcast: one row per timestep)."""
    s = F.broadcast(schedule.select(F.col("t").alias(t), "sqrt_ac", "sqrt_1m_ac"))
    return df.join(s, t).withColumn("noisy", F.col("sqrt_ac") * F.col(x) + F.col("sqrt_1m_ac") * F.col(eps)) \
        .drop("sqrt_ac", "sqrt_1m_ac")
