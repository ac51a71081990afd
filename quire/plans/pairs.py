"""Blocked pair computation for operators that are pairwise by definition
(distances inside a group, k nearest neighbours, Gram off-diagonals, line
pairs).

Rows of each group are hashed into blocks of at most ~``block_size`` rows;
small groups share a task (keyed by a hash bucket of the group), large
groups span many blocks.  Every (bucket, left block, right block) triple is
one cogroup task: each left row is replicated to the right blocks of its
group and vice versa, so a task holds two bounded blocks and reduces their
same-group pairs in numpy to a few numbers (or to a per-row top-k).  No
pair row is written to a shuffle or returned, no task holds more than two
blocks, and a hot group simply yields more block-pair tasks.  Work stays
quadratic within a group, as the operators are; memory and skew do not.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut_lineage

DEFAULT_BLOCK = 2048
GID = "_gid"


def block_cogroup(left: DataFrame, right: DataFrame, group: Sequence[str], left_id: str, right_id: str,
                  fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str,
                  block_size: int = DEFAULT_BLOCK, pack_factor: int = 8, cut: bool = True) -> DataFrame:
    """Apply ``fn(left_rows, right_rows)`` to every block pair.

    A group larger than ``block_size`` is cut into blocks of that size (the
    bound on pairs per task); small groups are packed about
    ``block_size * pack_factor`` rows per task, since they only pair within
    themselves.  Both frames carry ``_gid`` (a hash of the group key); ``fn``
    must only combine rows with equal ``_gid`` (see ``pair_index``).  ``cut``
    writes the inputs once; without it they are read by each branch, which
    suits inputs that are mostly empty."""
    # the inputs feed four branches (group counts, total, both replicated
    # sides): write each once to the shared checkpoint folder instead of
    # recomputing a derived input four times
    same_input = right is left
    if cut:
        left = cut_lineage(left)
        right = left if same_input else cut_lineage(right)
    keys = list(group) or ["_g"]
    if not group:
        same0 = right is left
        left = left.withColumn("_g", F.lit(0))
        right = left if same0 else right.withColumn("_g", F.lit(0))
    same = right is left
    left = left.withColumn(GID, F.xxhash64(*keys))
    right = left if same else right.withColumn(GID, F.xxhash64(*keys))
    nl = left.groupBy(*keys).agg(F.count("*").alias("_nl"))
    if right is left:  # self pairs: one aggregation serves both sides
        counts = nl.withColumn("_nr", F.col("_nl"))
    else:
        counts = nl.join(right.groupBy(*keys).agg(F.count("*").alias("_nr")), keys)
    # bucket count from a scalar subquery (part of the same plan, no eager job)
    total = left.agg(F.count("*")).scalar()
    n_buckets = F.greatest(F.ceil(total / F.lit(block_size * pack_factor)), F.lit(1))
    nbl = F.greatest(F.ceil(F.col("_nl") / block_size), F.lit(1))
    nbr = F.greatest(F.ceil(F.col("_nr") / block_size), F.lit(1))
    gb = F.pmod(F.col(GID), n_buckets)
    lrep = (left.join(counts, keys).withColumn("_gb", gb)
            .withColumn("_lb", F.pmod(F.xxhash64(F.col(left_id)), nbl))
            .withColumn("_rb", F.explode(F.sequence(F.lit(0).cast("long"), nbr - 1)))
            .drop("_nl", "_nr"))
    rrep = (right.join(counts, keys).withColumn("_gb", gb)
            .withColumn("_rb", F.pmod(F.xxhash64(F.col(right_id)), nbr))
            .withColumn("_lb", F.explode(F.sequence(F.lit(0).cast("long"), nbl - 1)))
            .drop("_nl", "_nr"))
    # fresh attribute ids: both sides often derive from the same DataFrame,
    # and a cogroup (unlike a join) does not de-duplicate them itself
    rrep = rrep.select(*[F.col(c).alias(c) for c in rrep.columns])
    gk = ["_gb", "_lb", "_rb"]
    return lrep.groupBy(*gk).cogroup(rrep.groupBy(*gk)).applyInPandas(fn, schema)


def pair_index(lp: pd.DataFrame, rp: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of all same-group (left, right) row pairs in a task:
    a hash merge on ``_gid``, so packed small groups cost only their own
    pairs, not the full block product."""
    left = pd.DataFrame({"g": lp[GID].to_numpy(), "i": np.arange(len(lp))})
    right = pd.DataFrame({"g": rp[GID].to_numpy(), "j": np.arange(len(rp))})
    m = left.merge(right, on="g", how="inner")
    return m["i"].to_numpy(), m["j"].to_numpy()


def per_left(i: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sum pair values onto their left rows."""
    return np.bincount(i, weights=values, minlength=n)


def group_sums(lp: pd.DataFrame, keys: Sequence[str], values: dict[str, np.ndarray]) -> pd.DataFrame:
    """Sum per-left-row values by the left rows' group key columns."""
    frame = lp[list(keys)].copy()
    for k, v in values.items():
        frame[k] = v
    return frame.groupby(list(keys), as_index=False, sort=False).sum()
